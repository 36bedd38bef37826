"""Collocations and the index against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sheetwise.llm import collocations as co
from sheetwise.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, gram string, n int, id string, word string"


def pieces(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(rows, least, top):
    f, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            size[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i: i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        cands = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cands.items():
            inside = lambda q: any(q[i: i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * b >= 80 * a and inside(q) for q, b in cands.items()):
                continue
            score, _, l, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, size[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    words = ["New", "york", "city", "hall", "ö", "中文", "a", "b", "the", "x\x1fy"]
    out = []
    for i in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ", ", "\n", ". "]) for _ in range(rng.randrange(60)))
        out.append((rng.choice(["en", "en", "de", None, ""]), text))
    out += [("en", "alpha beta gamma delta epsilon")] * 70 + [("en", None), (None, ""), ("fr", " .,\n "), ("en", "tik " * 400), ("und", "a b c a b c")]
    return out


@pytest.mark.parametrize(("least", "top"), [(30, 2000), (2, 25), (1, 40), (9, 3)])
def test_equals_brute_force(spark, rows, least, top):
    prepare(spark)
    df = spark.createDataFrame([(i, t, lang, "g", 1, "i", "w") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(5)
    assert got(co.collocations(df, least, top)) == brute(rows, least, top)


def test_long_and_empty_tables(spark, rows):
    prepare(spark)
    df = spark.createDataFrame([(1, ("one two three. " * 20_000), "en", "g", 1, "i", "w")], SCHEMA)
    assert [r[2] for r in got(co.collocations(df))] == ["one two three"]
    assert co.collocations(df.limit(0)).count() == 0
    assert co.collocations(df.select("lang", "doc_id").selectExpr("lang", "'a b' AS text")).count() == 0


def test_extensions(spark):
    prepare(spark)
    df = spark.createDataFrame([("en", "a b c"), ("en", "d b c"), ("en", "b e")], "lang string, text string")
    words, phrases, _ = co.frequent_phrases(df, 1)
    name = {r.id: r.word for r in words.collect()}
    found = {" ".join(name[i] for i in r.gram): (r.n, r.n_left, r.n_right) for r in co.extensions(phrases).collect()}
    assert found["b c"] == (2, 2, 0) and found["b"] == (3, 2, 2) and found["a b"] == (1, 0, 1) and found["d b c"] == (1, 0, 0)


def test_index_extends_both_ways():
    rng = np.random.Generator(np.random.PCG64(5))
    text = np.concatenate([[0], rng.integers(0, 4, 300)])
    index, mirror = co.Index(text), co.Index(text[::-1])
    ring = text.tolist()
    one = co._single(index, mirror)
    for phrases in (
        co.extend_left(index, co.extend_left(index, one)), co.extend_right(mirror, co.extend_right(mirror, one)),
        co.extend_right(mirror, co.extend_left(index, co.extend_right(mirror, one))),
    ):
        k = phrases.symbols.shape[1]
        want = Counter(tuple(ring[i: i + k]) for i in range(len(ring) - k + 1) if 0 not in ring[i: i + k])
        assert dict(zip(map(tuple, phrases.symbols.tolist()), phrases.size.tolist())) == want
