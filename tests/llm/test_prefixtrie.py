"""The prefix trie of rebuilt conversations against a trie built from the texts themselves."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import prefixtrie
from tessera.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth int, k1 string, words long"


def spark_hash(text):
    value = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - (1 << 64) if value >> 63 else value


def brute(rows):
    turns = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), spark_hash(role), spark_hash(text), role, text))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        rebuilt = turns.get(base, [])[:h] + turns[c][h:]
        for d in range(len(rebuilt) + 1):
            members[tuple(rebuilt[:d])].append(c)
        ends[tuple(rebuilt)].append(c)
    out = {}
    for node, convs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(len(y) == len(x) + 1 and y[:-1] == x for y in below)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        digest = hashlib.sha256(",".join(map(str, ends[node])).encode()).hexdigest()
        out[(len(node), node)] = (convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(children), len(leaves), saved, digest)
    return sorted(out.values(), key=repr)


def nodes(frame, **options):
    found = prefixtrie.trie_nodes(frame, **options)
    return sorted((tuple(r)[:8] for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng, out = random.Random(5), []
    for conv in [*range(0, 65), 100, 101, 102, 103, 104, 105, 106, 107, 141, -5, -3, 7_000_000_000, 7_000_000_003]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 6])):
            out.append((conv, turn, rng.choice(["user", "bot", None]), rng.choice(["hello there", "Yes  no\tmaybe", "", None, "a longer text here"]), 1, "k", 2))
    out += [(40, t, "user", "word " * (t % 3), 1, "k", 2) for t in range(10, 200)]  # a very long conversation
    out += [(41, None, "user", "null turn", 1, "k", 2), (41, None, "user", "another null turn", 1, "k", 2), (42, 0, "user", "twice", 1, "k", 2), (42, 0, "user", "twice", 1, "k", 2)]
    out += [(None, 1, "user", "no conversation", 1, "k", 2), (43, 50, "bot", "long " * 20_000, 1, "k", 2)]
    out += [(60 + 20 * c, t, "user", "the same", 1, "k", 2) for c in range(10, 40) for t in range(3)]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_nodes(spark, rows, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert nodes(spark.createDataFrame(rows, SCHEMA).repartition(parts), salts=parts) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_agreeing_hashes_are_noticed(spark, rows, monkeypatch):
    """Under the first seed all turns hash to one of two values: groups mix texts, so another seed must be taken."""
    sound, seeds = prefixtrie.turn_hashes, []

    def weak(role, text, seed):
        seeds.append(seed)
        return [F.pmod(F.octet_length(text), F.lit(2)).cast("long")] * 2 if seed == 0 else sound(role, text, seed)

    monkeypatch.setattr(prefixtrie, "turn_hashes", weak)
    some = [r for r in rows if r[0] is not None and r[0] < 25]
    assert nodes(spark.createDataFrame(some, SCHEMA)) == brute(some)
    assert set(seeds) == {0, 1}


def test_references_name_the_last_turn(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA)
    plain = [r for r in rows if r[0] is not None and r[0] not in (41, 42)]
    order = {(c, i + 1): t for c in {r[0] for r in plain} for i, t in enumerate(sorted(r[1] for r in plain if r[0] == c))}
    for r in prefixtrie.trie_nodes(frame).where("depth > 0 AND ref_conv NOT IN (41, 42)").collect():
        assert (r["ref_conv"], r["ref_turn"]) in order


def test_empty_and_turnless(spark):
    assert nodes(spark.createDataFrame([], SCHEMA)) == []
    rows = [(c, 0, "user", "x", 1, "k", 2) for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4]
    assert nodes(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_given_tables(spark):
    import duckdb

    path = "/root/testdata/sf0.01"
    got = QUERIES["op11_prefix_trie"](spark, path).collect()
    source = spark.read.parquet(f"{path}/conversations.parquet").collect()
    assert sorted((tuple(r)[:8] for r in got), key=repr) == brute([tuple(r) for r in source])
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got[0].__fields__)} FROM ({ORACLE_SQL['op11_prefix_trie']})").fetchall()
    assert sorted(want, key=repr) == sorted(map(tuple, got), key=repr)
