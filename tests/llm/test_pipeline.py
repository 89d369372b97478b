"""The pipeline stage by stage against plain versions."""

import re

import corpus_pipeline
from corvane.llm import packing, secret_scan, toxicity
from tests.llm.common import LOW
from tests.llm.test_join import brute
from tests.llm.test_scans import plain

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        seen[name] = ([r.asDict() for r in docs.collect()], [r.asDict() for r in spark.read.parquet(f"{tmp_path}/{k}").collect()])
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == columns
    before, after = seen["near_duplicates"]
    rows = [eval(x) for x in brute([(r["doc_id"], r["text"]) for r in before])]  # noqa: S307
    assert {r["doc_id"] for r in after} == {d for d, _, c in rows if d == c}
    before, after = seen["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r["doc_id"] for r, x in zip(before, plain([r["text"] for r in before], items), strict=True) if x[4]}
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - bad
    before, after = seen["secrets"]
    texts = {r["doc_id"]: r["text"] for r in after}
    for r in before:
        assert texts[r["doc_id"]] == secret_scan.redacted(r["text"])
    before, after = seen["packing"]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    for r in before:
        own = [x for x in after if x["doc_id"] == r["doc_id"]]
        assert sum(x["length"] for x in own) == own[0]["doc_tokens"]
        assert sorted(x["length"] for x in own) == sorted(packing.lengths(own[0]["doc_tokens"]))
    before, after = seen["toxicity"]
    words = re.compile(r"\b(idiot|moron|scum|pathetic|worthless|clown|loser|trash|disgusting|stupid)\b")
    toxic = lambda rows: sum(len(set(words.findall((r["text"] or "").translate(LOW)))) >= 3 for r in rows)
    assert toxic(after) < toxic(before) and len(after) > 0.8 * len(before)


def test_toxicity_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    after = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SF).select("doc_id").collect()}
    model = toxicity.trained(spark, docs.select("doc_id", "text"), SF).value
    rows = docs.select("doc_id", "text").collect()
    assert after == {r["doc_id"] for r in rows if model.scorer().score(r["text"] or "") < 0.5}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean, toxic = ({d for d, x in labels.items() if x == k} for k in (0, 1))
    assert len(clean - after) <= 0.05 * len(clean) and len(toxic - after) >= 0.8 * len(toxic)
