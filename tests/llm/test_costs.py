"""What text operators hold, move and look up: bounds that results alone do not show."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from sheetwise.llm import langid, linededup, pieces
from sheetwise.llm.common import prepare
from sheetwise.plans.fixtures import tables

ADVISORY, FIRST = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def test_the_language_sample_is_unpacked_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    kinds = {"aa": "tion ing the ed", "bb": "keit ung sch der", "cc": "eau oux ent le"}
    data = [(i, " ".join(rng.choice(kinds[k].split()) for _ in range(20)), k) for i in range(300) for k in [rng.choice(sorted(kinds))]]
    df = prepare(spark).createDataFrame(data, "doc_id bigint, text string, lang string")
    whole, sizes, unpacked = langid.fit(df), [], langid.unpacked
    monkeypatch.setattr(langid, "BLOCK", 50)
    monkeypatch.setattr(langid, "unpacked", lambda part: sizes.append(len(part)) or unpacked(part))
    parts = langid.fit(df)
    assert max(sizes) == 50 and sum(sizes) > 300  # every row twice, held-out ones never
    assert np.allclose(parts.trust, whole.trust)
    best = [{r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()} for model in (whole, parts)]
    assert best[0] == best[1]


def test_text_operators_leave_the_number_of_pieces_to_the_session(spark):
    prepare(spark)
    assert spark.conf.get(ADVISORY) == "16m" and spark.conf.get(FIRST, None) is None
    tables(spark, "/root/testdata/sf0.001")
    assert spark.conf.get(ADVISORY) == "4m" and spark.conf.get(FIRST) == "1000"


def test_only_lines_that_meet_others_travel_with_their_texts(spark, monkeypatch):
    texts = [(i, f"line number {i} of its own kind, {i * 7919}\nthe same long line but for its end {i % 9}") for i in range(60)]
    df = prepare(spark).createDataFrame(texts, "doc_id bigint, text string")
    plans, found, store = {}, {}, linededup.materialise
    monkeypatch.setattr(linededup, "materialise", lambda rows, name: plans.update({name: rows._jdf.queryExecution().executedPlan().toString()}) or store(rows, name))
    for most in (linededup.BROADCAST_IDS, 0):
        monkeypatch.setattr(linededup, "BROADCAST_IDS", most)
        found[most] = {tuple(r) for r in linededup.removed_lines(df).collect()}
        assert ("BroadcastHashJoin [spot" in plans["entries"]) == (most > 0)
    assert len({frozenset(rows) for rows in found.values()}) == 1 and len(found[0]) >= 59


class Word(str):
    looked_up = 0

    def __hash__(self):
        Word.looked_up += 1
        return str.__hash__(self)

    def __eq__(self, other):
        return str.__eq__(self, other)


def test_a_word_is_looked_up_once_and_the_store_starts_anew(monkeypatch):
    from sentencepiece import SentencePieceProcessor

    rng = random.Random(7)
    odd = ["a  b   c", "▁", "   ", "    x", "\n\n", "ab" * 60, "é" * 70, "x̀\U0001F600", "word" + " " * 40 + "word", "", "\t\ttab"]
    texts = odd + [" ".join("".join(rng.choice("aehinorst,.ß") for _ in range(rng.randrange(1, 14))) for _ in range(40)) for _ in range(200)]
    library, p = SentencePieceProcessor(model_file=pieces.MODEL), pieces.Pieces(pieces.MODEL)
    want = [library.encode(text) for text in texts]
    same = [i for i, text in enumerate(texts) if pieces.MARK not in text]
    for most, together in ((400_000, 1 << 22), (50, 300)):
        monkeypatch.setattr(pieces, "CACHED_WORDS", most)
        monkeypatch.setattr(pieces, "TOGETHER", together)
        got = p.encode_all(texts)
        assert all(got[i].tolist() == want[i] for i in same) and len(got) == len(texts)

    class Words:
        findall = staticmethod(lambda text: [Word(word) for word in p.words.findall(text)])

    fresh = pieces.Pieces(pieces.MODEL)
    n = sum(len(p.words.findall(pieces.MARK + pieces.shown(text))) for text in texts if text)
    fresh.words = Words()
    fresh.encode_all(texts)
    assert Word.looked_up <= 2 * n  # once to find it, once to number it if it is new


def test_a_chunk_is_encoded_once(monkeypatch):
    p = pieces.Pieces(pieces.MODEL)
    text = pieces.shown(" some words of a long text " * 40)
    whole = p.path(text)
    monkeypatch.setattr(p, "encode", None)  # the matrix asks for no ids
    cuts = [0, 300, 600, len(text)]
    at = pieces.borders([p.matrix(text, a, b) for a, b in zip(cuts, cuts[1:])])
    monkeypatch.undo()
    parts = [p.trace(text, a, b, s, e) for a, b, s, e in zip(cuts, cuts[1:], at, at[1:])]
    assert np.concatenate(parts).tolist() == p.numbers(whole).tolist()


def test_keys_of_lines_are_made_by_compiled_code(spark):
    """The JVM interprets methods over 8,000 bytes; a text is hashed once and does not travel with each of its lines."""
    df = prepare(spark).createDataFrame([(1, "a line that is long enough\nand a second one, too")], "doc_id bigint, text string")
    lines = linededup.lines_of(df, linededup.MIN_CHARS)
    plan = linededup.with_keys(lines, linededup.EDITS, F.lit(True))._jdf.queryExecution()
    package = getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$")
    code = getattr(package, "MODULE$").codegenString(plan.executedPlan())
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", code))) < 8000
    assert "text" not in re.sub(r"#\d+L?", "", re.search(r"Generate posexplode.*\), \[(.*?)\], false", plan.executedPlan().toString(), re.S).group(1)).split(", ")
