"""Word lists of the text rules: parameters, with defaults in the languages of the given corpus.

Rules name a list in their expressions: `has(column, list)` is true where the lower-cased text holds any
of its terms, `terms(column, list)` counts the different terms found. `expand` writes both out for
either engine.
"""

from __future__ import annotations

import re

#: Terms in English, German, French and Spanish; a blank keeps a short word from matching inside others.
LEXICON: dict[str, tuple[str, ...]] = {
    "policy": ("licen", "lizenz", "regulation", "subsid", "ordinance", "verordnung", "gesetz", "décret", "règlement", "normativa", "copyright", "public domain"),
    "driver": ("demand", "capacity", "expansion", "growth", "margin", "price", "efficien", "software", "nachfrage", "wachstum", "kapazität", "croissance", "demande", "crecimiento"),
    "event": ("announce", "releas", "launch", "signed", "acqui", "approved", "granted", "veröffentlicht", "angekündigt", "publié", "lancé", "anunci", "lanz"),
    "mechanism": ("because", "due to", "as a result", "so that", "leads to", "weil ", "deshalb", "dadurch", "parce que", "grâce à", "porque", "debido a", "under the"),
    "logic": ("because", "therefore", "however", "thus", "hence", "due to", "weil ", "daher", "jedoch", "parce que", "donc ", "cependant", "porque", "sin embargo", "debido", " with ", " that ", " for ", " by ", " mit ", " auch ", " von ", " für ", " avec ", " que ", " pour ", " par ", " dans ", " con ", " para ", " por "),
    "risk": ("lawsuit", "breach", "loss", "decline", "default", "fraud", "penalty", "worthless", "klage", "verlust", "rückgang", "procès", "perte", "pérdida", "caída", "stupid"),
    "abuse": ("stupid", "moron", "clown", "disgusting", "worthless", "idiot", "dummkopf", "imbécile", "idiota"),
    "not_abuse": ("not stupid", "not a moron", "nicht dumm", "pas idiot", "no idiota"),
    "secret": ("password", "passwd", "token =", "secret", "api_key", "akia", "passwort", "mot de passe", "contraseña"),
    "contact": ("@", "555-", "phone", "telefon", "téléphone", "teléfono"),
    "own": ("we ", "our ", "the company", "wir ", "unser", "nous ", "notre ", "nosotros", "nuestr", "the "),
    "peer": ("competitor", "peer", "rival", "wettbewerb", "konkurren", "concurrent", "competidor", "other compan"),
    "plan": ("plans to", "expects", "intends", "will ", "version", "plant ", "erwartet", "prévoit", "espera", "prevé"),
    "structure": ("|", "segment", "share of", "anteil", "part de", "cuota"),
    "claim": ("will ", "expects", "believe", "licensed", "released", "erwartet", "glaub", "estime", "considera", "is one of"),
    "signal": ("growth", "order", "contract", "margin", "demand", "capacity", "licen", "releas", "wachstum", "auftrag", "commande", "pedido", "mail", "version"),
    "title": ("results", "earnings", "outlook", "valuation", "order", "ergebnis", "ausblick", "résultats", "perspectives", "resultados", "the ", "der ", "les ", "los "),
    "product": ("product", "model", "platform", "software", "produkt", "modell", "produit", "modèle", "producto", "modelo"),
    "status": ("released", "licensed", "in production", "testing", "planned", "in betrieb", "en service", "en producción"),
    "strong": ("confirmed", "proven", "certain", "guarantee", "undoubtedly", "bestätigt", "garantiert", "confirmé", "garanti", "confirmado", "hereby"),
    "finance": ("revenue", "profit", "cash", "umsatz", "gewinn", "chiffre d'affaires", "bénéfice", "ingresos", "beneficio", " | "),
    "strategy": ("strategy", "invest", "acqui", "expansion", "strategie", "stratégie", "estrategia"),
    "annual_report": ("annual report", "geschäftsbericht", "jahresbericht", "rapport annuel", "informe anual", "memoria anual"),
    "half_report": ("half-year", "interim report", "halbjahr", "semestriel", "semestral"),
    "quarter_report": ("quarterly", "first quarter", "third quarter", "quartal", "trimestriel", "trimestral"),
    "clean_opinion": ("unqualified opinion", "true and fair view", "uneingeschränkter bestätigungsvermerk", "sans réserve", "opinión favorable"),
    "qualified_opinion": ("qualified opinion", "except for", "adverse opinion", "disclaimer of opinion", "eingeschränkt", "avec réserve", "opinión con salvedades"),
    # risk observations by keyword
    "k_dilution": ("dilution", "share issue", "rights issue", "private placement", "convertible bond", "kapitalerhöhung", "augmentation de capital", "ampliación de capital"),
    "k_dispute": ("lawsuit", "litigation", "arbitration", "court", "klage", "rechtsstreit", "procès", "litige", "demanda judicial", "litigio"),
    "k_delisting": ("delisting", "trading halt", "suspension of trading", "börsenaustritt", "radiation de la cote", "exclusión de cotización"),
    "k_pledge": ("share pledge", "pledged shares", "margin call", "verpfändung", "nantissement", "pignoración"),
    "k_leak": ("password", "api_key", "akia", "secret key", "passwort", "mot de passe", "contraseña"),
    "k_licence": ("license", "licence", "lizenz", "licencia"),
    # the ten topics of consolidated items, in their order
    "t_results": ("revenue", "net profit", "earnings", "quarterly report", "annual report", "eps", "gross margin", "umsatz", "jahresüberschuss", "gewinn", "chiffre d'affaires", "bénéfice", "ingresos", "beneficio neto"),
    "t_valuation": ("valuation", "price target", "market cap", "share price", "undervalued", "overvalued", "p/e", "p/b", "bewertung", "kursziel", "valorisation", "objectif de cours", "valoración", "precio objetivo"),
    "t_substitution": ("import substitution", "domestic substitution", "self-sufficien", "supply independence", "eigenversorgung", "souveraineté", "autosuficiencia"),
    "t_cycle": ("price increase", "supply and demand", "inventory", "capacity", "upcycle", "preiserhöhung", "lagerbestand", "kapazität", "hausse des prix", "stocks", "subida de precios", "existencias"),
    "t_technology": ("product launch", "breakthrough", "research and development", "patent", "chip design", "tape-out", "mass production", "produkteinführung", "durchbruch", "brevet", "lancement de produit", "licen"),
    "t_competition": ("competit", "market share", "industry leader", "moat", "barrier", "wettbewerb", "marktanteil", "concurren", "part de marché", "competencia", "cuota de mercado"),
    "t_flows": ("net inflow", "institutional holding", "stake increase", "stake reduction", "margin buying", "mittelzufluss", "flux de capitaux", "entrada de capital"),
    "t_policy": ("subsid", "tariff", "interest rate", "central bank", "federal reserve", "macroeconom", "monetary policy", "zoll", "leitzins", "zentralbank", "droits de douane", "taux d'intérêt", "arancel", "tipo de interés"),
    "t_orders": ("order intake", "supply chain", "key customer", "contract signed", "customer qualification", "auftragseingang", "lieferkette", "carnet de commandes", "cartera de pedidos"),
    "t_mood": ("sentiment", "panic", "optimis", "bearish", "bullish", "buy the dip", "sell-off", "shakeout", "retail investor", "stimmung", "panik", "optimisme", "pánico", "worthless", "stupid"),
    # the thirteen groups of required financial metrics
    "m_profit": ("net profit", "profit for the year", "jahresüberschuss", "gewinn", "bénéfice net", "beneficio neto"),
    "m_cash_flow": ("operating cash flow", "cash flow", "mittelzufluss", "flux de trésorerie", "flujo de caja"),
    "m_inventory": ("inventor", "vorräte", "stocks", "existencias"),
    "m_receivables": ("receivable", "forderungen", "créances", "cuentas por cobrar"),
    "m_supplier": ("supplier", "lieferant", "fournisseur", "proveedor"),
    "m_capex": ("capital expenditure", "capex", "construction in progress", "investitionen", "investissements", "inversiones"),
    "m_impairment": ("impairment", "wertminderung", "dépréciation", "deterioro"),
    "m_assets": ("financial assets", "finanzanlagen", "actifs financiers", "activos financieros"),
    "m_leverage": ("borrowings", "gearing", "liquidity", "verschuldung", "endettement", "endeudamiento"),
    "m_goodwill": ("goodwill", "geschäftswert", "écart d'acquisition", "fondo de comercio"),
    "m_audit": ("audit", "abschlussprüf", "commissaire aux comptes", "auditor"),
    "m_grants": ("government grant", "subsid", "fördermittel", "subvention", "subvención"),
    "m_actions": ("dividend", "share buyback", "rights issue", "dividende", "aktienrückkauf", "rachat d'actions", "recompra"),
}
#: Figures: decimals, years, per cent, money and units.
DATA = ("[0-9]+[.,][0-9]+", "(?:19|20)[0-9][0-9]", "[0-9] ?%", "[$€£]|\\b(?:USD|EUR|GBP)\\b|[0-9] ?(?:million|billion|Mio|Mrd|milliard|millones|kg|km|GW|tons)")
TOPICS = tuple(k for k in LEXICON if k.startswith("t_"))
METRIC_GROUPS = tuple(k for k in LEXICON if k.startswith("m_"))

_CALL = re.compile(r"\b(has|terms)\((\w+), (\w+)\)")


def _quoted(term: str) -> str:
    return "'" + term.replace("'", "''") + "'"


def expand(sql: str, spark: bool) -> str:
    """`has` and `terms` written out."""

    def write(m: re.Match) -> str:
        call, column, name = m.groups()
        if spark:  # a loop over the list: written out, the terms of several lists outgrow a compiled method
            loop = f"array({', '.join(map(_spark_quoted, LEXICON[name]))}), x -> contains(low, x)"
            found = f"exists({loop})" if call == "has" else f"size(filter({loop}))"
            return f"transform(array(lower({column})), low -> {found})[0]"  # bound to a name, the text is lowered once, not once a term
        found = [f"contains(lower({column}), {_quoted(t)})" for t in LEXICON[name]]
        return "(" + " OR ".join(found) + ")" if call == "has" else "(" + " + ".join(f"CAST({f} AS INT)" for f in found) + ")"

    return _CALL.sub(write, sql) if "has(" in sql or "terms(" in sql else sql


def _spark_quoted(term: str) -> str:
    return "'" + term.replace("'", "\\'") + "'"
