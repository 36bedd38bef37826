"""The corpus pipeline: each stage keeps its promise on its own input."""

import corpus_pipeline
from sheetwise.llm import common
from sheetwise.llm.common import prepare

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, key string"
SF = "/root/testdata/sf0.001"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_on_the_smallest_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = common.materialise(stage(spark, docs, SF), name)
        rows = out.collect()
        if name != "sentencepiece":
            assert out.columns == columns
        assert {r.doc_id for r in rows} <= set(before)
        if name == "language_id":
            assert all(re.search(r"[^\W\d_]", r.text or "") for r in rows) and len(rows) >= 0.9 * len(before)
        if name == "line_dedup":
            assert len(rows) == len(before)
            for r in rows:
                kept = iter((before[r.doc_id].text or "").split("\n"))
                assert r.text is None or r.text == "" or all(any(line == k for k in kept) for line in r.text.split("\n"))
        if name == "near_dedup":
            kept = [shingles(r.text) for r in rows]
            ids = {r.doc_id for r in rows}
            sets = {i: shingles(r.text) for i, r in before.items()}
            near = lambda a, b: a and b and 100 * len(a & b) >= 75 * len(a | b)
            assert not any(near(a, b) for i, a in enumerate(kept) for b in kept[:i])
            assert all(any(near(s, sets[j]) for j in sets if j != i) for i, s in sets.items() if i not in ids)
        docs = out
    assert docs.count() >= 1


def test_an_empty_table_and_odd_rows(spark, monkeypatch, tmp_path):
    prepare(spark)
    rows = [(None, "the quick one and the other", "en", None, 1, "r", "k"), (1, None, None, "s", None, "r", "k"), (1, None, None, "s", None, "r", "k"), (2, "", "en", "s", 0, "r", "k")]
    odd = spark.createDataFrame(rows, SCHEMA)
    for table in (odd, odd.limit(0)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            docs = common.materialise(stage(spark, docs, SF), name)
        assert docs.count() >= 0
