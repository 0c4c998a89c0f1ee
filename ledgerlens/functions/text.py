"""Text expressions in both dialects: pairs (Spark, other) and their composition."""

from __future__ import annotations

from ..plans.stages import Expr, pick


def both(template: str, *parts: Expr) -> tuple[str, str]:
    """Fill the {0}, {1}, ... of a template with pairs."""
    return template.format(*(pick(p, True) for p in parts)), template.format(*(pick(p, False) for p in parts))


def count_re(column: str, pattern: str) -> tuple[str, str]:
    return f"regexp_count({column}, r'{pattern}')", f"len(regexp_extract_all({column}, '{pattern}'))"


def match_re(column: str, pattern: str) -> tuple[str, str]:
    return f"({column} RLIKE r'{pattern}')", f"regexp_matches({column}, '{pattern}')"


def first_re(column: str, pattern: str, group: int = 1) -> tuple[str, str]:
    return f"regexp_extract({column}, r'{pattern}', {group})", f"regexp_extract({column}, '{pattern}', {group})"


def all_re(column: str, pattern: str, group: int = 0) -> tuple[str, str]:
    return f"regexp_extract_all({column}, r'{pattern}', {group})", f"regexp_extract_all({column}, '{pattern}', {group})"


def replace_re(column: str, pattern: str, by: str) -> tuple[str, str]:
    return f"regexp_replace({column}, r'{pattern}', '{by}')", f"regexp_replace({column}, '{pattern}', '{by}', 'g')"


def sha256(column: str) -> tuple[str, str]:
    return f"sha2({column}, 256)", f"sha256({column})"


def host(url: str) -> tuple[str, str]:
    """Lower-case host of a URL with any scheme or none; NULL unless it has a dot and no blank."""
    pattern = "^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)"
    h = f"regexp_extract(lower(trim({url})), '{pattern}', 1)"
    e = f"CASE WHEN contains({h}, '.') AND NOT contains({h}, ' ') THEN {h} END"
    return e, e
