"""Queries over documents on sources of any name, null texts, repeated rows and ids."""

from __future__ import annotations

import pytest

from ledgerlens import catalog

NAMES = ("q_c05_credit", "q_c06_pair_score", "q_c07_verify", "q_c08_plan_summary", "q_e08", "q_e02_units", "q_e03_scope", "q_a07_incremental", "q_a06_editorial", "q_x16_project_evidence", "q_d10_topic_clusters", "q_n01_news_relevance", "q_c02_claim_merge", "q_d08_record_dedupe", "q_v09_keyword_risks", "q_q16_research_select")


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n.startswith(NAMES)))
def test_no_query_raises(spark, tmp_path, name):
    rows = [(1, None, None, None, None), (2, "", "en", "books", 0), (3, "Licensed under the MIT License. It will grow by 3 % in 2024.", "en", "s1", 5), (3, "Licensed under the MIT License. It will grow by 3 % in 2024.", "en", "s1", 5), (4, "The password is token = abc. " * 300, "de", "src", 9), (4, "Ω " * 40, "zz", "src12", 9), (5, "中文 许可证 增长。需求", "zh", "src7", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    catalog.QUERIES[name](spark, str(tmp_path)).collect()
