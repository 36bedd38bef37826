"""Prefix trie against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from sheetwise.llm import trie
from sheetwise.llm.common import prepare

SCHEMA = "conv_id bigint, turn bigint, role string, text string, path string, words int, key string"


def brute(rows):
    """Nodes of the rebuilt conversations, from the definition."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        built[c] = own.get(base, [])[:h] + ts[h:]
    nodes = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    children = defaultdict(set)
    for key in nodes:
        if key:
            children[key[:-1]].add(key)
    out = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(key)))
        out.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), len(children[key]), sum(not children[k] for k in below),
            sum((len(nodes[k]) - 1) * count(k[-1][1]) for k in below if k), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def table(spark, rows):
    prepare(spark)
    return spark.createDataFrame([(*r, "p", 1, "k") for r in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [3, 40, 10**6])
def test_equals_brute_force(spark, shard_turns):
    rng = random.Random(shard_turns)
    rows = []
    for c in range(160):
        n = rng.choice([1, 1, 2, 3, 5, 8])
        for t in range(n):
            # A third of the conversations are alike, many share openings.
            said = "same words here" if c % 3 == 0 else f"a{rng.randrange(2)} b  c" if t < 3 else f"word{rng.randrange(3)}"
            rows.append((c, t, rng.choice(["user", None]) if c % 7 == 0 else "user", said))
    rows += [(500 + i, None if t == 0 else t, "user", None if t == 1 else "x y") for i in range(12) for t in range(4)]
    rows += [(700, 1, "a", "b"), (700, 1, "a", "b"), (700, 1, "", "ab"), (None, 0, "user", "lost"), (-3, 0, "user", "minus"), (-41, 2, "", "")]
    rows += [(900, t, "user", f"turn {t % 4}") for t in range(90)]
    rows += [(920 + i, t, "user", f"turn {t % 4}") for i in range(3) for t in range(70 + i)]
    assert got(trie.conversation_trie(table(spark, rows), shard_turns)) == brute(rows)


def test_odd_tables(spark):
    assert got(trie.conversation_trie(table(spark, []))) == []
    assert got(trie.conversation_trie(table(spark, [(None, 1, "user", "x")]))) == []
    one = [(7, None, None, None)]
    assert got(trie.conversation_trie(table(spark, one))) == brute(one)
    long = [(3, 0, "user", "w " * 200_000)]
    assert got(trie.conversation_trie(table(spark, long))) == brute(long)


def test_maximal_depth_in_blocks_and_keys():
    assert trie._keys(b"a" * 32, 2)[0] == hashlib.md5(b"").digest()
    assert trie._keys(b"a" * 32, 2)[2] == hashlib.md5(b"a" * 32).digest()
