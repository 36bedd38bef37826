"""Toxic passages: segments against brute force, held-out accuracy, odd rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import toxicity
from sheetwise.llm.common import prepare

WORDS = [a + b for a in ("lor", "mip", "sanu", "tevo", "quar", "bel") for b in ("a", "en", "ist", "orum", "")]
RUDE = ["vexlo", "vexlout", "vexloid", "grumb"]


def best_first(scores, low, high):
    """Maximal segments by definition: the best (shortest, first) one, then left and right of it."""
    best = max(((round(sum(scores[i:j]), 9), -(j - i), -i) for i in range(low, high) for j in range(i + 1, high + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i = -best[2]
    j = i - best[1]
    return best_first(scores, low, i) + [(i, j - 1, best[0])] + best_first(scores, j, high)


def test_segments_equal_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        scores = [rng.choice([-3, -2, -1, 1, 2, 4, 0.5, -0.25]) for _ in range(rng.randrange(14))]
        got = [(i, j, round(s, 9)) for i, j, s in toxicity.maximal_segments(np.array(scores))]
        assert got == best_first(scores, 0, len(scores)), scores


@pytest.fixture(scope="module")
def tables(spark):
    prepare(spark)
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(1200):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(RUDE) for _ in range(4)]
        docs.append((i, " ".join(words).capitalize(), "en", "s", "x"))
        labels.append((i, 1, int(toxic) if i % 11 else None))
    labels += [(None, 1, 1), (99999, 0, 0), (6, 1, 1)]
    odd = [(5000, None), (5001, ""), (5002, " \t\n. "), (None, "vexlo grumb vexlo vexlout vexloid"), (5003, "é中 Vexloö, VEXLO! grumb; vexloid\nend"), (5003, "lora"),
           (5004, "mipa " * 60_000 + "vexlo grumb vexlout vexlo vexlo " + "mipa " * 60_000)]
    docs += [(i, t, "en", "s", "x") for i, t in odd]
    return (spark.createDataFrame(docs, "doc_id bigint, text string, lang string, score string, passages string"),
            spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), docs, labels)


def test_held_out_rows(tables):
    docs, labels, rows, truth = tables
    got = {(r.doc_id, r.n_words): r for r in toxicity.score_documents(docs, labels).collect()}
    assert sum(1 for _ in got) == len(rows)
    known = {i: y for i, _, y in truth if y is not None and i is not None}
    test = [r for (i, _), r in got.items() if r.held_out and i in known]
    assert len(test) > 150
    right = sum(r.predicted == known[r.doc_id] for r in test)
    assert right / len(test) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert got[5000, 0].predicted == got[5001, 0].predicted == got[5002, 0].predicted == 0
    assert got[None, 5].predicted == 1 and not got[None, 5].held_out
    assert got[5004, 120_005].predicted == 1


def test_passages_point_at_the_text(tables):
    docs, labels, *_ = tables
    model = toxicity.learn(docs, labels, ~toxicity.held_out())
    rows = {(r.doc_id, r.n_words): r for r in toxicity.passages(docs.filter("doc_id IN (5003, 5004)"), model).collect()}
    texts = {(r.doc_id, len(r.text)): r.text for r in docs.filter("doc_id IN (5003, 5004)").collect()}
    (inside,) = rows[5003, 6].passages
    text = next(t for (i, n), t in texts.items() if i == 5003 and n > 10)
    assert text[inside.start: inside.end] == "Vexloö, VEXLO! grumb; vexloid" and (inside.first_word, inside.last_word) == (1, 4)
    (far,) = rows[5004, 120_005].passages
    assert (far.first_word, far.last_word) == (60_000, 60_004) and far.start == 300_000 and far.p_value < 0.05


def test_without_labels_or_rows(tables):
    docs, labels, *_ = tables
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score_documents(docs, labels.filter("toxic = 1")).collect()} == {1.0}
    assert toxicity.score_documents(docs.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.score_documents(docs.filter("text IS NULL"), labels).collect()} == {0}


def test_sample_is_bounded(tables):
    _, labels, *_ = tables
    got = toxicity.sample(labels, "toxic", ~toxicity.held_out(), 10).groupBy("y").agg(F.count("*").alias("n")).collect()
    assert sorted((r.y, r.n) for r in got) == [(0, 10), (1, 10)]
