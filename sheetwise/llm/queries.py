"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from sheetwise.llm import chat, collocations, hilbert, langid, licenses, linededup, lmscore, minhash, mixing, pieces, quality, toxicity, trie
from sheetwise.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    tricky = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return chat.read_back(chat.format_turns(chat.as_messages(rows.unionByName(tricky))))


def encode_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and a digest of the bytes they decode to."""
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "row", "chunk", F.size("ids").cast("bigint").alias("n_ids"), "ids", F.md5("bytes").alias("bytes_md5"))


def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.replicate(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "text", "lang", "source", "n_chars", "copy", "n_copies")


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.neighbours(table(spark, sf_dir, "embeddings"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lmscore.lm_scores(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: F.round(c, 4) for c in ("log_score", "mean_score")})


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "removed", "text")


def toxic_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x20\x09-\x0D]+')"

NEAR_DEDUP_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS shingle FROM d WHERE len(w) >= 5
    UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * common >= 75 * (na.n + nb.n - common)),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other),
comp AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN comp ON comp.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

CHAT_SQL = r"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
e AS (SELECT *, length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')) AS escaped FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + escaped + 24) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_attachments, CAST(0 AS BIGINT) AS n_expanded
FROM e GROUP BY conv_id"""

MIX_SQL = """
WITH c AS (SELECT source, count(*) AS n, sqrt(count(*)) AS target FROM documents GROUP BY source),
r AS (SELECT source, n, target / sum(target) OVER () * sum(n) OVER () / n AS rate FROM c),
p AS (SELECT source, CAST(greatest(1, ceil(rate / 16)) AS INTEGER) AS parts, rate / greatest(1, ceil(rate / 16)) AS mean FROM r),
cdf AS (SELECT source, parts, k, sum(exp(k * ln(mean) - mean - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS upto
        FROM (SELECT *, unnest(range(0, 96)) AS k FROM p)),
u AS (SELECT d.*, source IS NULL AS no_source, part, CAST(('0x' || md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) || '|' || part)[1:13]) AS BIGINT) / 4503599627370496.0 AS u
      FROM (SELECT documents.*, unnest(range(1, parts + 1)) AS part FROM documents JOIN p ON documents.source IS NOT DISTINCT FROM p.source) d),
n AS (SELECT doc_id, text, lang, u.source, n_chars, CAST(sum((SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND upto <= u.u)) AS INTEGER) AS n_copies
      FROM u GROUP BY ALL)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(range(1, n_copies + 1)) AS INTEGER) AS copy, n_copies FROM n"""

LM_SQL = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS MATERIALIZED (SELECT doc_id, i, w[i] AS word, CASE WHEN i > 1 THEN w[i - 1] END AS before FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
total AS (SELECT count(*) AS n FROM t),
c1 AS (SELECT word, count(*) AS n FROM t GROUP BY 1),
o1 AS (SELECT doc_id, word, count(*) AS n FROM t GROUP BY 1, 2),
c2 AS (SELECT before, word, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2),
o2 AS (SELECT doc_id, before, word, count(*) AS n FROM t WHERE before IS NOT NULL GROUP BY 1, 2, 3),
own AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
s AS (
  SELECT t.doc_id, CASE
      WHEN c2.n - o2.n > 0 AND cb.n - ob.n > 0 THEN ln(c2.n - o2.n) - ln(cb.n - ob.n)
      WHEN cw.n - ow.n > 0 THEN ln(0.4) + ln(cw.n - ow.n) - ln(total.n - own.n)
      ELSE 2 * ln(0.4) - ln(total.n - own.n + 1) END AS v
  FROM t JOIN own ON own.doc_id = t.doc_id JOIN total ON true
  JOIN c1 cw ON cw.word = t.word JOIN o1 ow ON ow.doc_id = t.doc_id AND ow.word = t.word
  LEFT JOIN c1 cb ON cb.word = t.before LEFT JOIN o1 ob ON ob.doc_id = t.doc_id AND ob.word = t.before
  LEFT JOIN c2 ON c2.before = t.before AND c2.word = t.word LEFT JOIN o2 ON o2.doc_id = t.doc_id AND o2.before = t.before AND o2.word = t.word),
a AS (SELECT doc_id, sum(v) AS v FROM s GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(a.v, 4) AS log_score, round(a.v / len(w), 4) AS mean_score
FROM d LEFT JOIN a ON a.doc_id = d.doc_id"""

PHRASE_SQL = f"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM t),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
      FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (SELECT *, unnest(range(1, 5)) AS k FROM w))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cut AS (SELECT *, unnest(range(1, len(w))) AS k FROM c),
s AS (SELECT cut.lang, cut.phrase, cut.a, cut.k, x.a AS l, y.a AS r, CAST(CAST(2000000 AS HUGEINT) * cut.a // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
      FROM (SELECT *, array_to_string(w[:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest FROM cut) cut
      JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = rest),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
part AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS a
         FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT *, unnest(range(2, len(w))) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT best.* FROM best LEFT JOIN part ON part.lang = best.lang AND part.phrase = best.phrase
         WHERE part.a IS NULL OR 100 * CAST(part.a AS HUGEINT) < 80 * CAST(best.a AS HUGEINT)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM kept)
SELECT ranked.lang, rank, phrase, a, l, r, CAST(total.n AS BIGINT) AS n, score FROM ranked JOIN total ON total.lang = ranked.lang WHERE rank <= 2000"""

# crc32 of an ASCII text, bit by bit.
_CRC32 = """xor(CAST(4294967295 AS UBIGINT), list_reduce(
  flatten(list_transform(range(1, length({0}) + 1), lambda i: [CAST(ascii({0}[i]) AS UBIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN CAST(3988292384 AS UBIGINT) ELSE CAST(0 AS UBIGINT) END),
  CAST(4294967295 AS UBIGINT)))"""

TRIE_SQL = r"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
e AS (SELECT c, turn, md5(CAST(strlen(role) AS VARCHAR) || ':' || role || text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w FROM t),
o AS (SELECT c, list({'id': id, 'w': w} ORDER BY turn NULLS FIRST, id) AS s, CAST(c AS VARCHAR) AS name FROM e GROUP BY c),
g AS (SELECT c, s, CAST(""" + _CRC32.format("name") + r""" % 4 AS INTEGER) AS h FROM o),
b AS (SELECT g.c, coalesce(x.s[1:g.h], []) || g.s[g.h + 1:] AS s FROM g LEFT JOIN g x ON x.c = g.c - g.c % 20),
p AS MATERIALIZED (SELECT c, d, len(s) AS n, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w, list_transform(s[1:d], lambda x: x.id) AS node,
        CASE WHEN d > 0 THEN list_transform(s[1:d - 1], lambda x: x.id) END AS outer_node
      FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM b)),
k AS MATERIALIZED (SELECT node, any_value(outer_node) AS outer_node, any_value(d) AS d, any_value(w) AS w, min(c) AS c, count(*) AS n,
        sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM p GROUP BY node),
f AS (SELECT outer_node AS node, count(*) AS n FROM k WHERE outer_node IS NOT NULL GROUP BY 1),
a AS (SELECT k.*, coalesce(f.n, 0) AS children FROM k LEFT JOIN f ON f.node = k.node),
under AS (SELECT up.node, count(*) FILTER (a.children = 0) AS leaves, sum((a.n - 1) * a.w) AS saved
          FROM (SELECT *, unnest(range(0, d + 1)) AS u FROM a) a JOIN k up ON up.node = a.node[1:a.u] GROUP BY up.node)
SELECT a.c AS conv_id, a.d AS depth, k.c AS parent_conv_id, a.n AS n_convs, a.children AS n_children, under.leaves AS n_leaves,
       CAST(under.saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM a JOIN under ON under.node = a.node LEFT JOIN k ON k.node = a.outer_node"""

ENTRIES: dict[str, tuple[Query, str | None]] = {
    "op1_near_dedup": (near_dedup, NEAR_DEDUP_SQL),
    "op2_language_id": (language_id, None),
    "op3_chat_format": (chat_format, CHAT_SQL),
    "op4_sentencepiece": (encode_pieces, None),
    "op5_poisson_mix": (mix_sources, MIX_SQL),
    "op6_hilbert_neighbours": (neighbours, None),
    "op7_quality_rules": (quality_rules, None),
    "op8_stupid_backoff": (lm_scores, LM_SQL),
    "op9_license_scan": (license_scan, None),
    "op10_line_dedup": (line_dedup, None),
    "op11_toxic_passages": (toxic_passages, None),
    "op12_collocations": (phrase_collocations, PHRASE_SQL),
    "op13_conversation_trie": (conversation_trie, TRIE_SQL),
    "pipeline": (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL),
}
