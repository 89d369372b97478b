"""A sample of the queries against their SQL on the smallest tables; the driver compares all."""

import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["note_scan", "frontmatter_titles", "llm_response_parse", "model_listing", "search_lexical", "section_split", "chunk_notes", "chunk_windows", "bm25_topk", "idf", "fnv1a_hash", "knn_exact", "knn_ann", "grounding_check", "search_hybrid", "eval_all_modes", "hash_diff", "change_log_apply", "debounce_sessions", "index_reload", "chat_prompt", "chat_ask_batch", "qrels_build", "llm_request_build"]


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if hasattr(value, "tzinfo"):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", NAMES)
def test_matches(spark, name):
    import __spark_entry__ as entry

    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    rel = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    place = [rel.columns.index(c) for c in columns]
    ours = sorted(repr([shown(r[c]) for c in columns]) for r in df.collect())
    theirs = sorted(repr([shown(r[i]) for i in place]) for r in rel.fetchall())
    assert ours == theirs


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    # every query has SQL but what the subpackage leaves out
    missing = {q for q in entry.queries() if not q.startswith("op") and q != "pipeline"} - set(entry.oracle_sql())
    assert not missing
