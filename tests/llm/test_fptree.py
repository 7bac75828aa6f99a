"""Ranked search over document FP-trees against scoring every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tessera.llm import fptree
from tessera.llm.queries import ORACLE_SQL, QUERIES

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS = "doc_id long, text string, rank int, score string, terms array<int>"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    vectors = [(i, Counter(terms(t))) for i, t, *_ in docs if terms(t)]
    n_docs, n_terms = len(vectors), sum(sum(c.values()) for _, c in vectors)
    df = Counter(t for _, c in vectors for t in c)
    out = []
    for item_id, text, *_ in items:
        scores = []
        for doc_id, counts in vectors:
            m = 25 + 75 * sum(counts.values()) * n_docs // n_terms
            score = 0
            for t in terms(text):
                if counts[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * counts[t] // (1000 * counts[t] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        out += [(item_id, rank, d, -s) for rank, (s, _, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4_000)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 20, 80, 300]))), 1, "s", [1]) for i in range(900)]
    copy = "Copied passage, w1 w2-w3 ÜnïÉ naïve ÀB w4"
    docs += [(2_000 - i, copy, 1, "s", [1]) for i in range(70)] + [(3_000, copy.upper(), 1, "s", [1])]
    docs += [(4_000, None, 1, "s", [1]), (4_001, "", 1, "s", [1]), (4_002, "!? .", 1, "s", [1]), (None, copy, 1, "s", [1]), (5, "again w9", 1, "s", [1]), (4_003, "w7 " * 400_000 + "tail", 1, "s", [1])]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 30])))) for i in range(40)]
    items += [(50, copy), (51, "w1 w1 W1"), (52, None), (53, ""), (54, "unknown"), (None, "w3 naïve"), (50, "tail w8"), (55, " ".join(sorted(set(words))))]
    return docs, items


@pytest.mark.parametrize("parts,item_bytes", [(1, fptree.ITEM_BYTES), (5, 500)])
def test_ranking(spark, corpus, parts, item_bytes):
    docs, items = corpus
    got = fptree.best_documents(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, "item_id long, text string"), item_bytes=item_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark, corpus):
    docs, items = (spark.createDataFrame(*x) for x in ((corpus[0], DOCS), (corpus[1], "item_id long, text string")))
    assert fptree.best_documents(docs.where("false"), items).count() == 0 == fptree.best_documents(docs, items.where("false")).count()
    assert fptree.best_documents(docs.where("text IS NULL"), items).count() == 0


def random_docs(rng, n, vocabulary):
    docs = []
    for i in range(n):
        held = np.array(sorted(rng.sample(range(vocabulary), rng.randrange(1, 30))), np.int32)
        docs.append((held, np.array([rng.choice([1, 1, 2, 9]) for _ in held], np.int32), rng.randrange(25, 400), (False, i)))
    return docs + [(t, f, m, (False, n + i)) for i, (t, f, m, _) in enumerate(docs[: n // 3])]


def test_bounds_hold_and_branches_are_left_out(monkeypatch):
    rng = random.Random(2)
    docs = random_docs(rng, 3_000, 300)
    room = np.zeros(300, np.int64)
    tree = fptree.tree_of(docs, 10, room)
    assert not room.any()
    weight = np.zeros(300, np.int64)
    asked = rng.sample(range(100, 300), 12)
    weight[asked] = [rng.randrange(1, 9_000) for _ in asked]

    def exact(node):
        found = node.vectors.scores(weight)
        if isinstance(node, fptree.Bucket):
            return max(found)
        below = [exact(child) for child in node.children]
        assert all(bound >= score for bound, score in zip(found, below))
        return max(below)

    exact(tree)
    scored, sound = [0], fptree.Vectors.scores

    def counting(self, weight):
        scored[0] += len(self.m)
        return sound(self, weight)

    monkeypatch.setattr(fptree.Vectors, "scores", counting)
    best = []
    fptree.walk(tree, weight, best, 10)
    want = sorted((-sound(fptree.Vectors([t], [f], [m], [i]), weight)[0], i) for t, f, m, i in docs)
    assert best == [w for w in want if w[0] < 0][:10]
    assert scored[0] < 0.8 * len(docs)


def test_values_take_bounded_room():
    """A comb, in which each document leaves the common path one step later than the one before."""
    docs = [(np.array([*range(i), 5_000 + i], np.int32), np.ones(i + 1, np.int32), 30, (False, i)) for i in range(1_200)]
    tree = fptree.tree_of(docs, 10, np.zeros(7_000, np.int64))

    def entries(node):
        return len(node.vectors.terms) + (0 if isinstance(node, fptree.Bucket) else sum(map(entries, node.children)))

    assert entries(tree) <= math.log2(len(docs)) * sum(len(d[0]) for d in docs)


def test_given_tables(spark):
    path = "/root/testdata/sf0.01"
    for name in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{path}/{name}.parquet'")
    got = QUERIES["op12_ranked_search"](spark, path).collect()
    want = duckdb.sql(ORACLE_SQL["op12_ranked_search"]).fetchall()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(want, key=repr)
