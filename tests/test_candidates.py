"""Editorial rows are cut in parts of a source, in many tasks, before a source is looked at as a whole."""

from __future__ import annotations

from ledgerlens.plans.editorial import _RANKED, _WORTH, _candidates


def test_the_best_of_a_source_are_among_the_best_of_its_parts(spark):
    rows = spark.range(60_000).selectExpr(
        "id", "'one' AS source", "CASE WHEN id % 3 = 0 THEN 'r' ELSE 's' END AS role", "CAST(id % 2 AS INT) AS dimensions", "CASE WHEN id % 5 = 0 THEN 'cash' END AS core",
        "CAST((id * 7919) % 31 AS INT) AS score", "CAST((id * 31) % 17 AS INT) AS penalty", "CAST((id * 104729) % 23 AS INT) AS insight", "CASE WHEN id % 7 = 0 THEN CAST((id * 13) % 9 AS INT) END AS portrait",
    )
    best = f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY source, role, dimensions, core ORDER BY {_RANKED}) AS a, row_number() OVER (PARTITION BY source, role, dimensions, core ORDER BY {_WORTH}) AS b,
      row_number() OVER (PARTITION BY source ORDER BY coalesce(portrait, -1) DESC, id) AS c FROM {{t}}) x WHERE a <= 12 OR b <= 12 OR c <= 1"""
    cut = _candidates(rows)
    chosen = lambda t: {r.id for r in spark.sql(best, t=t).collect()}
    assert chosen(cut) == chosen(rows) and cut.columns == rows.columns
    assert cut.count() <= 64 * (8 * 24 + 1) < 60_000
