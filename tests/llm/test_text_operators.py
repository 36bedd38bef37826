"""Text operators on small tables: brute force, round trips and odd rows."""

import math
import random
import re
import textwrap

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheetwise.llm import chat, hilbert, langid, licenses, linededup, lmscore, minhash, mixing, pieces, quality
from sheetwise.llm.common import prepare

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, key string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def low(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    base = [text(60) + "\n" + text(30) for _ in range(8)]
    out = [(i, t) for i, t in enumerate(base)]
    for i in range(8, 30):  # near copies, a third of them of one text
        parts = base[0 if i % 3 else i % 8].split(" ")
        for _ in range(rng.randrange(4)):
            parts[rng.randrange(len(parts))] = rng.choice(WORDS)
        out.append((i, " ".join(parts)))
    out += [(40, None), (41, ""), (42, " \t\n "), (43, "one two"), (44, "ONE two"), (45, "12 34 ###"), (None, base[1]), (46, base[2]), (46, base[2]),
            (47, "released under the MIT license. MIT License\nand CC  BY-nc 4.0 licensed under"), (48, "x" * 5000), (49, "é 中文 \u2581 😀")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(i, t, "en" if k % 2 else None, None if k % 5 == 0 else f"s{k % 3}", 1, "h", "k") for k, (i, t) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def test_near_duplicates_equal_brute_force(docs, rows, nothing):
    def shingles(t):
        w = words(low(t))
        return {tuple(w[i: i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    known = [(i, shingles(t)) for i, t in rows if i is not None]
    comp = {i: i for i, _ in known}
    for _ in known:
        for a, x in known:
            for b, y in known:
                if x and 100 * len(x & y) >= 75 * len(x | y):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).filter("doc_id IS NOT NULL").collect())
    assert got == sorted((i, len(s), comp[i], comp[i] == i) for i, s in known)
    lone = minhash.near_duplicates(docs).filter("doc_id IS NULL").first()
    assert lone.kept and lone.component_id is None
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id IS NOT NULL").collect()) == sorted({i for i in comp if comp[i] == i})
    assert minhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("n", range(5))
def test_near_duplicates_of_one_short_text(spark, n):
    prepare(spark)
    df = spark.createDataFrame([(7, " ".join(WORDS[:n]))], "doc_id bigint, text string").coalesce(1)
    assert [tuple(r) for r in minhash.near_duplicates(df).collect()] == [(7, min(n, 1), 7, True)]


def test_bit_signatures_lose_no_more_than_the_keys():
    """Share of pairs at similarity 0.75 whose single bits lie beyond the distance."""
    beyond = range(minhash.FINE_DISTANCE + 1, minhash.FINE_BITS + 1)
    assert sum(math.comb(minhash.FINE_BITS, k) * 0.125**k * 0.875 ** (minhash.FINE_BITS - k) for k in beyond) < 1e-7


def test_line_dedup_equals_brute_force(spark, docs, nothing):
    rng = random.Random(3)
    line = lambda: "".join(rng.choice("abc ") for _ in range(rng.randrange(18, 30))).strip() + "z"
    lines = [line() for _ in range(40)]

    def edited(text):
        at = rng.randrange(len(text))
        return rng.choice([text[:at] + text[at + 1:], text[:at] + "q" + text[at:], text[:at] + "q" + text[at + 1:]])

    texts = []
    for i in range(60):
        chosen = [rng.choice(lines) for _ in range(3)]
        for _ in range(rng.randrange(4)):
            chosen[0] = edited(chosen[0])
        texts.append((i, "\n".join(chosen)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    first = {}
    for i, t in texts:
        for k, text in enumerate(t.split("\n")):
            first.setdefault(text.strip(" "), (i, k))
    long = [x for x in first if len(x) >= 20]
    near = {x for x in long if any(first[y] < first[x] and distance(x, y) <= 2 for y in long)}
    want = {(i, k) for i, t in texts for k, x in enumerate(t.split("\n")) if x.strip(" ") in near or first[x.strip(" ")] != (i, k)}
    got = {(r.doc_id, r.line_no) for r in linededup.removed_lines(df).collect()}
    assert got == want and near
    clean = {r.doc_id: r.text for r in linededup.dedup_lines(df).collect()}
    assert clean == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in want) for i, t in texts}
    # Without words too: lines of every length from the minimum on, edited at both ends and in the middle.
    texts = []
    for n in [*range(20, 75), 107, 108, 109, 200, 350]:
        text = "".join(rng.choice("abcdefgh") for _ in range(n))
        texts += [text] + [edited(edited(text)) for _ in range(4)] + [text[2:], text[:-2], "x" + text + "y", text[1:-1], text[: n // 2] + "xy" + text[n // 2:]]
    pairs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    ids = {text: i for i, text in reversed(list(enumerate(texts)))}
    close = {b for a, b in ((a, b) for a in ids for b in ids if abs(len(a) - len(b)) <= 2 and ids[a] < ids[b] and min(len(a), len(b)) >= 20) if distance(a, b) <= 2}
    assert {r.doc_id for r in linededup.removed_lines(pairs).collect()} == {i for i, text in enumerate(texts) if text in close or ids[text] != i}
    odd = linededup.keep_first_lines(docs)
    assert odd.columns == docs.columns and odd.count() == docs.count()
    assert odd.filter("doc_id = 40").first().text is None
    assert linededup.dedup_lines(nothing).count() == 0


def test_line_dedup_of_short_lines_repeated_ids_and_rows_without_id(spark):
    menu, own = "Home | About us", "a line of its own, number "
    texts = [(i, f"{menu}\n{own * 2}{i * 7919}\n\n---") for i in range(50)] + [(60, f"{menu}\nfirst text"), (60, f"{menu}\nsecond text"), (None, f"{menu}\nno id"), (None, "no id\nat all")]
    texts += [(70, "word " * 40000 + "end\nno id")]
    df = spark.createDataFrame([(*row, "x", "y") for row in texts], "doc_id bigint, text string, removed string, line_no string")
    got = linededup.dedup_lines(df, edits=0).collect()
    assert len(got) == len(texts)
    clean = sorted(r.text for r in got)
    assert sum(menu in t for t in clean) == 1 and {"first text", "second text", "at all"} < set(clean)
    assert sum(t.endswith("\n\n---") for t in clean) == 50 and sum("no id" in t for t in clean) == 1 and {r.line_no for r in got} == {"y"}


def test_pieces_are_the_librarys_and_come_back(spark, docs, rows, nothing):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=pieces.MODEL)
    long = [(i, t) for i, t in rows] + [(100, "ab" * 3000), (100, "ab" * 3000), (101, "word " * 2000)]
    df = spark.createDataFrame(long, "doc_id bigint, text string")
    for chunk in (pieces.CHUNK, 64):
        found = {}
        for n, r in enumerate(pieces.decode(pieces.encode(df, chunk=chunk)).collect()):
            found.setdefault((r.doc_id, n if r.row is None else f"row {r.row}"), []).append(r)
        texts = []
        for (doc, _), parts in found.items():
            parts.sort(key=lambda r: r.chunk)
            text = b"".join(bytes(p.bytes) for p in parts).decode()
            texts.append((str(doc), text))
            if pieces.MARK not in text:
                assert [i for p in parts for i in p.ids] == library.encode(text)
        assert sorted(texts) == sorted((str(i), t or "") for i, t in long)
    assert pieces.encode(nothing).count() == 0


def test_chat_round_trip_and_parts(spark):
    turns = spark.createDataFrame(
        [(1, 0, "user", "<|im_end|> <\\|x|> \\n"), (1, 1, "assistant", None), (2, 0, "sys\ntem\\", "a"), (2, 0, None, "b"), (None, None, "assistant", "x" * 9), (-1, 0, "assistant", "<|")],
        "conv_id bigint, turn bigint, role string, text string",
    )
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.as_messages(turns))).collect()}
    assert {k: (r.n_turns, r.loss_chars) for k, r in got.items()} == {1: (2, 0), 2: (2, 0), None: (1, 9), -1: (1, 2)}
    import hashlib
    assert got[1].turns_sha256 == hashlib.sha256("user\n<|im_end|> <\\|x|> \\n\nassistant\n\n".encode()).hexdigest()
    part = "named_struct('kind', '{}', 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})"
    parts = ", ".join([part.format("text", "'see <|image|>'", "null", "null", "null", "null", "null"), part.format("image", "null", "'a.png'", 56, 57, "null", "null"),
                       part.format("audio", "null", "'b.wav'", "null", "null", "2.0D", "null"), part.format("document", "null", "'c.pdf'", "null", "null", "null", 2)])
    row = chat.format_turns(spark.sql(f"SELECT 1L AS conv_id, 0L AS turn, 'user' AS role, CAST(array({parts}) AS {chat.PARTS}) AS parts")).first()
    assert row.segment == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|document|><|im_end|>\n"
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in row.attachments] == [(0, "image", "a.png", 6), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 1200)]
    assert row.n_expanded == 1256


def test_language_id_on_unseen_rows(spark, docs, nothing):
    rng = random.Random(5)
    kinds = {"aa": "tion ing the ed", "bb": "keit ung sch der", "cc": "eau oux ent le"}
    data = [(i, " ".join("".join(rng.choice(kinds[k].split()) for _ in range(3)) for _ in range(20)), k) for i in range(400) for k in [rng.choice(sorted(kinds))]]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string")
    out = langid.identify(df).join(df, "doc_id").filter("held_out")
    assert out.count() > 60 and out.filter("lang_pred = lang").count() >= 0.98 * out.count()
    model = langid.fit(df)
    odd = {r.doc_id: r for r in langid.predict(docs, model).collect()}
    assert all((odd[i].lang_pred, odd[i].score) == ("und", 0.0) for i in (40, 41, 42, 45)) and odd[43].lang_pred in kinds
    assert langid.identify(nothing).count() == 0 and langid.keep_identified(docs).columns == docs.columns
    assert (langid.codewords(12) @ langid.codewords(12).T - 100 * np.eye(12)).max() < langid.codewords(12).shape[1]


def test_mix_follows_weights(spark, nothing):
    df = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 100 == 1, None).otherwise("mid").alias("source"), F.lit("x").alias("copy"))
    got = {r.source: r.n for r in mixing.replicate(df, {"big": 3.0, "mid": 1.0}).groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert set(got) == {"big", "mid"} and abs(got["big"] - 22500) < 900 and abs(got["mid"] - 7500) < 500
    once = mixing.replicate(df).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("c"))
    assert once.filter("n <> c").isEmpty() and mixing.replicate(nothing).count() == 0


def test_neighbours_reach_recall_and_copies(spark):
    prepare(spark)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8)).astype("float32")
    x[200:400] = x[200]  # a third of all rows are one vector
    data = [(i, x[i].tolist()) for i in range(600)] + [(700, None), (701, [0.0] * 8), (702, [float("nan")] * 8), (703, [1.0]), (5, x[5].tolist())]
    out = hilbert.neighbours(spark.createDataFrame(data, "vec_id bigint, embedding array<float>")).collect()
    wide = x.astype(float)
    for q in range(0, 600, 20):
        s = wide @ wide[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -np.round(s, 9)))[:20]
        found = [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q]
        assert len(found) == 20 and len(set(found) & set(best.tolist())) >= 18
    assert not {r.query_id for r in out} & {700}


def _recall(spark, x, asked):
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    out = hilbert.nearest(rows, rows.filter(F.col("vec_id").isin(asked)).select("vec_id")).collect()
    found = {q: {r.vec_id for r in out if r.query_id == q} for q in asked}
    hit = 0
    for q in asked:
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hit += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    return hit / (20 * len(asked))


def test_neighbour_blocks_keep_their_share_of_the_points():
    for n in (51_200, 200_000, 500_000, 10_000_000):
        assert 3 * hilbert.block_size(n) * hilbert.SHARE >= 3 * n
    assert hilbert.block_size(10) == hilbert.BLOCK


def test_one_long_vector_does_not_flatten_the_grid(spark, monkeypatch):
    prepare(spark)
    monkeypatch.setattr(hilbert, "BLOCK", 64)
    x = np.random.default_rng(5).normal(size=(4000, 16)).astype("float32")
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[3999] *= 1000
    assert _recall(spark, x, list(range(0, 800, 20))) >= 0.9


def test_quality_statistics_and_rules(docs, rows, nothing):
    got = quality.judge(docs, []).collect()
    want = []
    for i, t in rows:
        w = words(t)
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k: k + 3]), []).append(k)
        lines = [x for x in (t or "").split("\n") if words(x)]
        n_repeat = len({p + j for v in at.values() if len(v) > 1 for p in v for j in range(3)})
        want.append((i or -1, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), n_repeat, len(w) < 50 or 100 * n_repeat > 50 * len(w)))
    assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    rng = random.Random(1)
    sample = [((100.0, 5.0, s, 0.0, 0.0, 0.1, 0.5), s > 0.5) for s in (rng.random() for _ in range(400))]
    rules = quality.learn(sample)
    assert len(rules) == 1 and str(rules[0]).count("symbols_per_word")
    assert quality.judge(nothing, rules).count() == 0


def test_lm_scores_equal_a_plain_count(docs, rows, nothing):
    from collections import Counter
    from math import log

    w = [words(low(t)) for _, t in rows]
    one, two, total = Counter(x for d in w for x in d), Counter(p for d in w for p in zip(d, d[1:])), sum(map(len, w))
    want = []
    for (i, _), d in zip(rows, w):
        o1, o2, n, v = Counter(d), Counter(zip(d, d[1:])), total - len(d), 0.0
        for k, x in enumerate(d):
            p = (d[k - 1], x) if k else None
            if p and two[p] > o2[p]:
                v += log(two[p] - o2[p]) - log(one[p[0]] - o1[p[0]])
            elif one[x] > o1[x]:
                v += log(0.4) + log(one[x] - o1[x]) - log(n)
            else:
                v += 2 * log(0.4) - log(n + 1)
        want.append((i or -1, len(d), round(v, 6) if d else None))
    for batch in (1 << 24, 3000):
        got = [(r.doc_id or -1, r.n_words, None if r.log_score is None else round(r.log_score, 6)) for r in lmscore.lm_scores(docs, batch_bytes=batch, count_bytes=2000).collect()]
        order = lambda r: (r[0], r[1], r[2] or 0)
        assert sorted(got, key=order) == sorted(want, key=order)
    assert lmscore.lm_scores(nothing).count() == 0


def test_licenses_equal_brute_force(spark, docs, rows, nothing):
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = list(rows) + [(200 + k, f"intro\n{t.upper() if k % 2 else t} more words") for k, t in enumerate(licenses.TEMPLATES.values())]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_words): r for r in licenses.license_scan(df).collect()}
    for i, t in texts:
        w = re.findall(word, low(t))
        places = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(w)) if w[k: k + len(phrase.split())] == phrase.split()]
        labels = {label for _, label in places}
        for line in low(t).split("\n"):
            held = set(re.findall(word, line))
            for label, template in licenses.TEMPLATES.items():
                need = set(re.findall(word, low(template)))
                if len(held & need) >= 0.8 * len(need):
                    labels.add(label)
        r = got[i, len(w)]
        starts = [k for k, _ in places]
        assert (r.n_base, r.first_word, r.last_word) == (len(places), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and r.labels == ",".join(sorted(labels))
    assert licenses.license_scan(nothing).count() == 0


def test_licenses_across_lines_and_in_long_lines(spark):
    prepare(spark)
    wrap = lambda t, mark: "\n".join(mark + line for line in textwrap.wrap(t, 72))
    filler = lambda n: " ".join(WORDS[k % len(WORDS)] for k in range(n))
    templates = list(licenses.TEMPLATES.items())
    texts = [(k, f"{filler(k * 7)}\n{wrap(t, ' * ')}\n{filler(90)}") for k, (_, t) in enumerate(templates)]
    texts += [(100 + k, f"{filler(1000 + k)} {t} {filler(1000)}") for k, (_, t) in enumerate(templates)]
    texts += [(200 + k, "\n".join(f"rem {line}" for line in textwrap.wrap(t, 30))) for k, (_, t) in enumerate(templates)]
    texts += [(300 + k, f" {filler(80)} ".join(re.findall("[A-Za-z0-9]+", t))) for k, (_, t) in enumerate(templates)]
    labels = {r.doc_id: r.labels.split(",") for r in licenses.license_scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for k, (label, _) in enumerate(templates):
        assert all(label in labels[k + at] for at in (0, 100, 200))
        assert labels[300 + k] == [""]


def test_rows_without_id_spread_over_batches(spark):
    rows = spark.createDataFrame([(None, f"text {k:04d}") for k in range(400)], "doc_id bigint, text string")
    assert rows.select(lmscore.batch_of(8).alias("batch")).distinct().count() == 8


def test_near_duplicates_of_repeated_ids(spark):
    prepare(spark)
    a, b, c = (" ".join(WORDS[i: i + 9]) for i in (0, 7, 11))
    df = spark.createDataFrame([(5, a), (5, b), (6, a), (7, b), (9, c), (9, c), (3, ""), (3, None)], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(3, 3, True), (3, 3, True), (5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (9, 9, True), (9, 9, True)]
    kept = sorted((r.doc_id, r.text or "") for r in minhash.keep_one_of_each(df).collect())
    assert kept == [(3, ""), (3, ""), (5, a), (5, b), (9, c)]


def test_near_duplicates_of_a_crowd_round_one_text(spark):
    """Copies of one text with more and more words changed: most pairs lie just under the threshold."""
    rng = random.Random(31)
    prepare(spark)
    base = [rng.choice(WORDS) + str(i) for i in range(60)]
    texts = []
    for i in range(150):
        parts = list(base[rng.randrange(3):])
        for _ in range(rng.randrange(8)):
            parts[rng.randrange(len(parts))] = f"new{rng.randrange(4)}"
        texts.append((i, " ".join(parts)))
    sets = {i: {tuple(t.split()[k: k + 5]) for k in range(len(t.split()) - 4)} for i, t in texts}
    comp = {i: i for i in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in linked:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == comp and len(set(comp.values())) > 10


def test_mix_spreads_rows_without_id(spark):
    prepare(spark)
    df = spark.createDataFrame([(None, f"text {i:04d}", "s") for i in range(500)], "doc_id bigint, text string, source string")
    assert mixing.replicate(df).select("text", "copy", "shuffle_key").distinct().groupBy("shuffle_key").count().filter("count > 1").count() == 0
