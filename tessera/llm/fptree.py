"""Ranked lexical search over document FP-trees.

The items are the stated query set; they are taken in blocks of bounded text. For a block, every document becomes its vector of
(term, tf) over the block's terms. Terms are ordered by how many documents hold them, so vectors that start alike share the path
of a trie. A task builds a trie for each bounded group of its documents, one path step per term with its branches only where
vectors differ; equal vectors share one leaf. A subtree keeps the largest tf of each of its terms, its smallest m and its smallest
doc_id. A term's score rises with tf and falls with m, so the score of these values bounds every document below. Each item walks
the trie depth first, highest bound first, and leaves out subtrees that cannot reach its k best so far. The best of all tasks are
ranked in two steps. Results are exact.

A subtree that holds more than half of the documents of the one above it has no values of its own (its branches hang below the
upper one), so the values of a tree take at most log2(documents) times the room of its vectors.

Defined cases: null text has no term and is no document of the statistics. Every row is a document and every item row an item of its
own, repeated ones too; among equal scores a null doc_id goes last. Items without a known term have no result. Empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.staging import Scratch

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
#: Bytes of item text in a block; documents and vector entries in one trie; leaves below which a branch is one bucket.
ITEM_BYTES, TREE_DOCS, TREE_ENTRIES, BUCKET = 4 << 20, 8_192, 1_000_000, 24
LONG_TEXT, OUT_ROWS, SALTS = 1 << 20, 2_048, 64


def terms_of(text: str | None):
    """The terms of a text in order; only A-Z are lower-cased (as bytes, so other letters stay). Very long texts come as a stream."""
    if not text:
        return []
    text = text.encode().lower().decode()
    return TERM.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in TERM.finditer(text))


def restricted_vectors(docs: DataFrame, term_ids: dict[str, int]) -> DataFrame:
    """(doc_id, n, terms, tfs) of every document with a term: n counts all its terms, the vector only those of `term_ids`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))],
                                              names=["doc_id", "n", "terms", "tfs"])

        ids, sizes, terms, tfs, held = [], [], [], [], 0
        for batch in batches:
            doc_id, text = batch.columns
            for i in range(batch.num_rows):
                n, counts = 0, Counter()
                words = terms_of(text[i].as_py())
                if isinstance(words, list):
                    n = len(words)
                    counts = Counter(t for t in map(term_ids.get, words) if t is not None)
                else:
                    for word in words:
                        n += 1
                        if word in term_ids:
                            counts[term_ids[word]] += 1
                if n:
                    ids.append(doc_id[i].as_py())
                    sizes.append(n)
                    terms.append(np.fromiter(counts.keys(), np.int32, len(counts)))
                    tfs.append(np.fromiter(counts.values(), np.int32, len(counts)))
                    held += len(counts)
                if len(ids) >= OUT_ROWS or held >= TREE_ENTRIES:
                    yield flush()
                    ids, sizes, terms, tfs, held = [], [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<int>")


def contributions(terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Scores (or bounds) of vectors laid end to end: vector v has the entries from ends[v] to ends[v + 1] and length norm m[v]."""
    w = weight[terms]
    held = np.flatnonzero(w)
    tf = tfs[held]
    vector = np.searchsorted(ends, held, "right") - 1
    parts = w[held] * ((1_000_000_000 * tf) // (1_000 * tf + 8 * m[vector]))
    running = np.zeros(len(held) + 1, np.int64)
    np.cumsum(parts, out=running[1:])
    edges = running[np.searchsorted(held, ends)]
    return edges[1:] - edges[:-1]


class Vectors:
    """Vectors laid end to end, with the smallest m and doc_id of what each stands for."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], m: list[int], least_id: list[int]):
        self.ends = np.zeros(len(terms) + 1, np.int64)
        np.cumsum([len(t) for t in terms], out=self.ends[1:])
        self.terms = np.concatenate(terms) if terms else np.zeros(0, np.int32)
        self.tfs = (np.concatenate(tfs) if tfs else np.zeros(0)).astype(np.int64)
        self.m, self.least_id = np.array(m, np.int64), least_id

    def scores(self, weight: np.ndarray) -> list[int]:
        return contributions(self.terms, self.tfs, self.ends, self.m, weight).tolist()

    def maxima(self, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms and their largest tf over all vectors; `room` is a zeroed array over all terms."""
        np.maximum.at(room, self.terms, self.tfs)
        terms = np.unique(self.terms)
        tfs = room[terms].copy()
        room[terms] = 0
        return terms, tfs


class Bucket:
    """A few leaves, scored exactly."""

    def __init__(self, leaves: list[tuple]):
        self.ids = [leaf[3] for leaf in leaves]
        self.vectors = Vectors([leaf[0] for leaf in leaves], [leaf[1] for leaf in leaves], [leaf[2] for leaf in leaves], [leaf[3][0] for leaf in leaves])


class Branch:
    """Subtrees under one node with their bounds' values."""

    def __init__(self, children: list, room: np.ndarray):
        self.children = children
        tops = [c.vectors.maxima(room) for c in children]
        self.vectors = Vectors([t for t, _ in tops], [f for _, f in tops], [int(c.vectors.m.min()) for c in children], [min(c.vectors.least_id) for c in children])


def tree_of(docs: list[tuple], k: int, room: np.ndarray):
    """The trie of documents (terms in frequency order, tfs, m, id key): leaves of equal documents keep the k smallest ids, as no more can rank."""
    docs = sorted(((t.astype(">u4").tobytes(), f.tobytes(), m, i, t, f) for t, f, m, i in docs), key=lambda d: d[:4])
    leaves, last = [], None
    for path, counts, m, i, terms, tfs in docs:
        if (path, counts, m) != last:
            leaves.append((terms, tfs, m, []))
            last = (path, counts, m)
        if len(leaves[-1][3]) < k:
            leaves[-1][3].append(i)
    shared = [0]
    for a, b in zip(leaves, leaves[1:]):
        n = min(len(a[0]), len(b[0]))
        differ = np.flatnonzero(a[0][:n] != b[0][:n])
        shared.append(int(differ[0]) if len(differ) else n)

    # branching nodes as (depth, first leaf, children): where the shared length of neighbouring leaves falls, a node is complete
    stack = [[0, 0, []]]
    for at in range(1, len(leaves) + 1):
        depth, piece = (shared[at] if at < len(leaves) else 0), (at - 1, at, [])
        while stack[-1][0] > depth:
            top = stack.pop()
            top[2].append(piece)
            piece = (top[1], at, top[2])
        if stack[-1][0] == depth:
            stack[-1][2].append(piece)
        else:
            stack.append([depth, piece[0], [piece]])
    return _placed((0, len(leaves), stack[0][2]), leaves, room)


def _placed(node: tuple, leaves: list[tuple], room: np.ndarray):
    """A node with values: subtrees of at most half its leaves are nodes of their own, larger ones are opened, small ones joined to buckets."""
    first, end, _ = node
    if end - first <= BUCKET:
        return Bucket(leaves[first:end])
    ready, small, queue = [], [], [node]
    while queue:
        low, high, children = queue.pop()
        for child in reversed(children) if children else [(low, high, [])]:
            if child[1] - child[0] > (end - first) // 2 and child[2]:
                queue.append(child)
            elif child[1] - child[0] > BUCKET and child[2]:
                ready.append(_placed(child, leaves, room))
            else:
                small += leaves[child[0]:child[1]]
                if len(small) >= BUCKET:
                    ready.append(Bucket(small))
                    small = []
    if small:
        ready.append(Bucket(small))
    return Branch(ready, room)


def walk(tree, weight: np.ndarray, best: list[tuple], k: int) -> None:
    """Bring the k best (-score, id key) of one item up to date with the documents of one tree."""
    stack = [(0, None, tree)]
    while stack:
        bound, least_id, node = stack.pop()
        if least_id is not None and len(best) == k and (-bound, least_id) > best[-1]:
            continue
        found = node.vectors.scores(weight)
        if isinstance(node, Bucket):
            for score, ids in zip(found, node.ids):
                if score > 0:
                    for i in ids:
                        if len(best) == k:
                            if (-score, i) >= best[-1]:
                                break
                            best.pop()
                        bisect.insort(best, (-score, i))
        else:
            open_ = [(b, i, c) for b, i, c in zip(found, node.vectors.least_id, node.children) if b > 0 and not (len(best) == k and (-b, i) > best[-1])]
            stack += sorted(open_, key=lambda o: (o[0], [-x for x in o[1]]))


def local_best(vectors: DataFrame, order: np.ndarray, weights: np.ndarray, items: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's k best documents of every item. `order` is a term's place by frequency, `weights` goes by place,
    an item is (places, repeats)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [[] for _ in items]
        room, weight = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)

        def search(docs):
            tree = tree_of(docs, k, room)
            for (places, repeats), ranked in zip(items, best):
                weight[places] = weights[places] * repeats
                walk(tree, weight, ranked, k)
                weight[places] = 0

        docs, held = [], 0
        for batch in batches:
            ids, sizes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            starts = [batch.column(2).offsets.to_numpy(), batch.column(3).offsets.to_numpy()]
            flat = [batch.column(2).values.to_numpy(), batch.column(3).values.to_numpy()]
            for i, (doc_id, n) in enumerate(zip(ids, sizes)):
                terms, tfs = (flat[j][starts[j][i]:starts[j][i + 1]] for j in (0, 1))
                if len(terms):
                    places = order[terms]
                    by = np.argsort(places)
                    docs.append((places[by], tfs[by], 25 + (75 * n * n_docs) // n_terms, (doc_id is None, doc_id or 0)))
                    held += len(terms)
                if len(docs) >= TREE_DOCS or held >= TREE_ENTRIES:
                    search(docs)
                    docs, held = [], 0
        if docs:
            search(docs)
        rows = [(item, None if i[0] else i[1], -score) for item, ranked in enumerate(best) for score, i in ranked]
        for at in range(0, len(rows), 1 << 16):
            part = rows[at:at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in part], pa.int32() if j == 0 else pa.int64()) for j in range(3)], names=["item", "doc_id", "score"])

    return vectors.mapInArrow(run, "item int, doc_id long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of every item over all tasks, first per salt."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    some = found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents (doc_id, text) of every item (item_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "fp-tree")
    stated = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = stated.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out, totals = max(1, math.ceil(size / item_bytes)), [], None
    for block in range(blocks):
        rows = stated.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        counts = [Counter(terms_of(r["text"])) for r in rows]
        vocabulary = {term: i for i, term in enumerate(sorted(set().union(*counts)))}
        vectors = scratch.keep(restricted_vectors(docs, vocabulary), f"vectors-{block}")
        if totals is None:
            totals = vectors.agg(F.count("*"), F.sum("n")).first()
        n_docs, n_terms = totals
        df = np.zeros(len(vocabulary), np.int64)
        for term, n in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = n
        frequent = np.argsort(-df, kind="stable")
        order = np.empty(len(df), np.int32)
        order[frequent] = np.arange(len(df), dtype=np.int32)
        weights = np.array([math.floor(1_000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df[frequent]], np.int64)
        wanted = [(np.array([order[vocabulary[t]] for t in c], np.int64), np.array(list(c.values()), np.int64)) for c in counts]
        best = ranked(local_best(vectors, order, weights, wanted, n_docs, n_terms, k), k)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], "item int, item_id long")
        best = best.join(names, "item").select("item_id", "rank", "doc_id", "score")
        out.append(scratch.keep(best, f"best-{block}"))
        scratch.drop(f"vectors-{block}")
    return reduce(DataFrame.union, out)
