"""The corpus pipeline, stage by stage."""

import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quillon.llm import ngram_join

SF = "/root/testdata/sf0.01"
WORDS = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor".split()


def test_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    d = spark.read.parquet(f"{SF}/documents.parquet")
    columns, inputs = d.columns, [d]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, inputs[-1], SF).write.parquet(f"{tmp_path}/{k}")
        inputs.append(spark.read.parquet(f"{tmp_path}/{k}"))
    counts = [x.count() for x in inputs[:5]]
    assert all(x.columns == columns for x in inputs[:5]) and counts == sorted(counts, reverse=True) and counts[0] > counts[1] > counts[4] > 0
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in inputs[1].select("doc_id").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(i in kept) == labels[i] for i in held]) > 0.9
    lines = Counter(x for r in inputs[2].collect() for x in r["text"].split("\n") if len(x.split()) >= 50)
    assert lines and max(lines.values()) == 1
    assert ngram_join.ngram_join(inputs[3], 5, 80).where("doc_id <> component_id").count() == 0
    before = ngram_join.ngram_join(inputs[2], 5, 80).where("doc_id = component_id").select("doc_id").collect()
    assert {r[0] for r in before} == {r["doc_id"] for r in inputs[3].select("doc_id").collect()}  # one of each class, and all else
    items = [" ".join(r["text"].split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: " ".join(r["text"].split()) for r in inputs[3].collect()}
    last = {r["doc_id"] for r in inputs[4].collect()}
    leaks = {i for i, t in texts.items() if any(x in t for x in items)}
    assert leaks and last == set(texts) - leaks
    pieces = inputs[5].collect()
    assert {r["doc_id"] for r in pieces} == last
    total = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(total.values())
    assert corpus_pipeline.run(spark, SF).count() == len(pieces)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_edges(spark, name):
    """Nulls, empty texts, repeated rows and ids, columns with the names that stages use inside, and an empty table."""
    stage = dict(corpus_pipeline.STAGES)[name]
    prose = [" ".join(np.random.default_rng(i).choice(WORDS, 90)) for i in range(4)]
    rows = [(7, prose[0]), (7, prose[0]), (9, prose[0] + " x"), (9, prose[1]), (None, prose[2]), (None, None), (1, None), (2, ""), (3, " \n "), (4, "w " * 20000)]
    names = ["_score", "_leaked", "_row", "_gone", "n_deleted", "_k", "_runs", "score", "component_id"]
    d = spark.createDataFrame([(i, t, *[1] * len(names)) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    out = stage(spark, d, SF)
    if name != "packing":
        assert out.columns == d.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect()) if name != "packing" else Counter((r["doc_id"], r["start"]) for r in out.collect())
    if name == "ngram_join":
        assert got == Counter([r for r in rows[1:2] + rows[3:]])
    if name == "decontamination":
        assert got == Counter(rows)
    if name == "line_dedup":
        assert got == Counter(rows)  # no line stands twice but in rows that are one document
    if name == "packing":
        assert got[7, 0] == 2 and sum(got.values()) >= len(rows)
    assert stage(spark, d.where("false"), SF).count() == 0
