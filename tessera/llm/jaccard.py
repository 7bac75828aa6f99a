"""Exact Jaccard join of documents on sets of 5-word shingles, by size-banded tiles with hashed bitmap signatures.

Two documents link when `100 * |A & B| >= threshold * |A | B|`. The result is one row per document with its component, so a
group of copies costs work in proportion to its size and never all of its pairs.

1. Equal sets become one class. Only one document of a class per batch goes on.
2. Tiles. A linked pair must share one of the first `|A| - ceil(t |A|) + 1` shingles of either set in any common order. The
   order here is: shingles that no batch has seen twice first, then the known frequent ones, rarest first. Documents that
   only share a common passage therefore never meet. The order may come from any statistic; it does not affect the result.
3. Stars. Each document of a tile is compared with one leader of the tile. That joins most of every large group.
4. Crossing tiles. Only tiles that still hold several components go on. Documents outside the tile's largest component
   meet the documents of it in their own and the two adjacent size bands, block by block. Signatures are parity bitmaps whose length follows the size band: a differing bit needs a
   differing shingle, so `(|A| + |B| - differing bits) / 2` bounds the overlap from above. First the best pair between a
   document and a component is verified, then every pair that still crosses components.
5. Verification intersects the sorted arrays of shingle hashes. Each set travels once to each of its leaders.

Hashes have 64 bits, so two given documents are judged wrongly with a chance of about 1e-13.

Defined cases: null or blank text gives an empty set, linked with nothing. Rows with the same doc_id and the same text are
one document; with different texts they are separate documents of one id. A null doc_id takes part like any other value and
comes out as null, its component being that of the smallest id that is not null, if any. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm import shingles
from tessera.llm.components import components
from tessera.llm.staging import Scratch

HOT_KEYS = 65_536  # frequent shingles that are ordered last; a bound of the broadcast, not of the result
HOT_COUNT = 8  # documents of batches that make a shingle frequent
BLOCK = 2_048  # documents of a tile that meet in one task
STAR_ROWS = 20_000  # documents of a frequent shingle that share one star
KEYS, KEY_PARTS = 8_000_000, 8  # shingles of a batch that are counted together, in parts of their range
SALTS = 64  # parts of a large group of equal sets
FILTER_BITS = (26, 30)  # the node filter that is broadcast has 16 bits a node, from 8 MB up to 128 MB
PAIRS = 1_000_000  # candidates that a task looks at together

_DOCS = "kind string, node long, n long, d1 long, d2 long, bits binary, key long, docs long"


def _signature(values: np.ndarray) -> bytes:
    """Parity bitmap: bit (hash mod length) is flipped by each shingle. The length is the size rounded up to a power of two."""
    length = max(64, 1 << max(0, (len(values) - 1).bit_length()))
    odd = np.bincount((values & np.uint64(length - 1)).astype(np.int64), minlength=length) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _first(values: np.ndarray, threshold: int) -> int:
    return len(values) - -(-threshold * len(values) // 100) + 1


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _repeated(runs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values that stand more than once in sorted runs, and how often: a part of the value range at a time."""
    keys, counts = [], []
    for part in range(KEY_PARTS):
        low, high = (np.uint64(min((1 << 64) // KEY_PARTS * p, (1 << 64) - 1)) for p in (part, part + 1))
        cut = [r[np.searchsorted(r, low) : len(r) if part == KEY_PARTS - 1 else np.searchsorted(r, high)] for r in runs]
        found = np.concatenate(cut)
        found.sort()
        edges = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1], [True])))
        times = np.diff(edges)
        keys.append(found[edges[:-1][times > 1]])
        counts.append(times[times > 1])
    return np.concatenate(keys), np.concatenate(counts)


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document (size, digest of the set, signature) and a row per shingle that a batch holds in two classes. Sets are made a
    slice of the batch at a time; of their shingles, at most KEYS are held before they are counted."""

    def counted(runs):
        keys, count = _repeated(runs)
        k, none = len(keys), [None] * len(keys)
        return _record(["key"] * k, pa.nulls(k, pa.int64()), none, none, none, none, keys.view(np.int64), count)

    for batch in batches:
        known, runs, held = set(), [], 0
        for piece in shingles.slices([batch]):
            node, n, d1, d2, bits, seen = piece.column("node"), [], [], [], [], []
            for values in shingles.shingle_sets(piece.column("text")):
                digest = _digest(values)
                n.append(len(values))
                d1.append(int.from_bytes(digest[:8], "little", signed=True))
                d2.append(int.from_bytes(digest[8:], "little", signed=True))
                bits.append(_signature(values) if len(values) else b"")
                if len(values) and digest not in known:
                    known.add(digest)
                    seen.append(values)
            m = len(n)
            yield _record(["doc"] * m, node, n, d1, d2, bits, [None] * m, [None] * m)
            if seen:
                runs.append(np.sort(np.concatenate(seen)))
                held += len(runs[-1])
            if held > KEYS:
                yield counted(runs)
                runs, held = [], 0
        if runs:
            yield counted(runs)


def _record(kind, node, n, d1, d2, bits, key, docs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(kind, pa.string()), node, pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary()), pa.array(key, pa.int64()), pa.array(docs, pa.int64())],
        names=["kind", "node", "n", "d1", "d2", "bits", "key", "docs"])


def _postings(threshold: int, frequent):
    """For one document of each class of a batch: its first shingles in the common order, with their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, rank, salts = frequent.value
        for batch in batches:
            known = set()
            for piece in shingles.slices([batch]):
                yield from posted(piece, known, hot, rank, salts)

    def posted(batch, known, hot, rank, salts):
        node, parts, ids, sizes = batch.column("node").to_numpy(zero_copy_only=False), [], [], []
        places, salt = [], []
        for values, doc in zip(shingles.shingle_sets(batch.column("text")), node):
            same = _digest(values)
            if not len(values) or same in known:
                continue
            known.add(same)
            keep, star = _first(values, threshold), np.zeros(len(values), np.int32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
                is_hot = hot[at] == values
                order = np.lexsort((values, np.where(is_hot, rank[at], 0)))[:keep]
                star = np.where(is_hot & (salts[at] > 1), int(doc) % salts[at] + 1, 0)[order]  # 0 only if the key has one star
                values, size = values[order], len(values)
            else:
                values, size, star = values[:keep], len(values), star[:keep]
            parts.append(values)
            ids.append(np.full(len(values), doc, np.int64))
            sizes.append(np.full(len(values), size, np.int32))
            places.append(np.arange(len(values), dtype=np.int32))
            salt.append(star.astype(np.int32))
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in ([p.view(np.int64) for p in parts], ids, sizes, places, salt)], names=["key", "node", "n", "place", "star"])

    return run


def size_band(n, threshold: int):
    """Sizes of a linked pair lie in one band or in two adjacent ones; a band is a little wider than the largest ratio of such sizes."""
    return F.floor(F.log(n) / float(np.log(100 / threshold * (1 + 1e-6))))


def _required(a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    """Smallest overlap that links sets of these sizes."""
    total = a.astype(np.int64) + b
    return -(-threshold * total // (100 + threshold))


def _folded(bits: list[bytes], length: int) -> np.ndarray:
    """Signatures as rows of 64-bit words, long ones folded onto `length` bits."""
    out = np.zeros((len(bits), length // 64), np.uint64)
    for i, b in enumerate(bits):
        row = np.frombuffer(b, np.uint64)
        while len(row) > length // 64:
            row = row[: len(row) // 2] ^ row[len(row) // 2 :]
        out[i] = row
    return out


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _bounded_pairs(threshold: int):
    """Pairs (a, b) with sizes and signatures whose bitmap bound still allows a link."""

    def run(frames):
        for f in frames:
            if f.empty:
                continue
            small = np.minimum(f["bits_a"].map(len), f["bits_b"].map(len)).to_numpy() * 8
            keep = np.zeros(len(f), bool)
            for length in np.unique(small):
                rows = np.flatnonzero(small == length)
                gap = _differing(_folded(f["bits_a"].iloc[rows].tolist(), length), _folded(f["bits_b"].iloc[rows].tolist(), length))
                na, nb = f["n_a"].to_numpy()[rows], f["n_b"].to_numpy()[rows]
                keep[rows] = (np.minimum(na, nb) * 100 >= threshold * np.maximum(na, nb)) & ((na + nb - gap) // 2 >= _required(na, nb, threshold))
            yield f.loc[keep, ["a", "b"]]

    return run


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, end to end."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _whole_tiles(frames):
    """Frames of whole tiles from frames sorted by tile."""
    import pandas as pd

    kept = None
    for f in frames:
        if f.empty:
            continue
        f = f if kept is None else pd.concat([kept, f], ignore_index=True)
        last = (f[["key", "band", "l", "r"]] == f[["key", "band", "l", "r"]].iloc[-1]).all(axis=1).to_numpy()
        kept = f[last]
        if not last.all():
            yield f[~last]
    if kept is not None:
        yield kept


def _crossing(threshold: int, best_only: bool):
    """Pairs between components of a tile whose place and bitmap bounds allow a link; `best_only`: per document and component
    the pair with the largest bound. Tiles of a frame are handled together, at most about PAIRS candidates at a time."""
    import pandas as pd

    def chunk(f, bits, right, starts, counts):
        i, j = np.repeat(right, counts), _ranges(starts, counts)
        n, place, comp = f["n"].to_numpy(), f["place"].to_numpy(), f["comp"].to_numpy()
        ok = (comp[i] != comp[j]) & (np.minimum(n[i], n[j]) * np.int64(100) >= np.maximum(n[i], n[j]) * np.int64(threshold))
        i, j = i[ok], j[ok]
        need = _required(n[i], n[j], threshold)
        ok = np.minimum(n[i] - place[i], n[j] - place[j]) >= need
        i, j, need = i[ok], j[ok], need[ok]
        bound = np.zeros(len(i), np.int64)
        size = np.array([len(b) * 8 for b in bits])
        common = np.minimum(size[i], size[j])
        for length in np.unique(common):
            pairs = np.flatnonzero(common == length)
            rows, at = np.unique(np.concatenate([i[pairs], j[pairs]]), return_inverse=True)
            words = _folded([bits[x] for x in rows], length)
            bound[pairs] = (n[i[pairs]].astype(np.int64) + n[j[pairs]] - _differing(words[at[: len(pairs)]], words[at[len(pairs) :]])) // 2
        ok = bound >= need
        node = f["node"].to_numpy()
        found = pd.DataFrame({"a": node[i[ok]], "b": node[j[ok]], "comp": comp[j[ok]], "bound": bound[ok]})
        if best_only:
            found = found.sort_values(["bound", "b"], ascending=[False, True]).drop_duplicates(["a", "comp"])
        return pd.DataFrame({"a": np.minimum(found["a"], found["b"]), "b": np.maximum(found["a"], found["b"])}).drop_duplicates()

    def run(frames):
        for f in _whole_tiles(frames):
            f = f.reset_index(drop=True)
            tile = f[["key", "band", "l", "r"]].to_numpy()
            new = np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1)))
            group, side = np.cumsum(new) - 1, f["side"].to_numpy()
            first = np.flatnonzero(new)
            lefts = np.bincount(group[side == 0], minlength=len(first))
            right = np.flatnonzero(side == 1)
            starts, counts, bits = first[group[right]], lefts[group[right]], f["bits"].tolist()
            cut = np.searchsorted(np.cumsum(counts), np.arange(PAIRS, counts.sum() + PAIRS, PAIRS), side="left") + 1
            low = 0
            for high in np.unique(np.minimum(cut, len(right))):
                yield chunk(f, bits, right[low:high], starts[low:high], counts[low:high])
                low = high

    return run


def _passing(shared):
    """Rows whose node may be among those of the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            at = batch.column("node").to_numpy(zero_copy_only=False) & (len(bits) * 8 - 1)
            yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in shingles.slices(batches):
        values = [v.tobytes() for v in shingles.shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(values, pa.binary())], names=["node", "shingles"])


def _intersect(threshold: int):
    def run(frames):
        for f in frames:
            keep = []
            for x, y in zip(f["set_a"], f["set_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield f.loc[np.array(keep, dtype=bool), ["a", "b"]]

    return run


class _Join:
    def __init__(self, docs: DataFrame, threshold: int, scratch: Scratch):
        self.threshold, self.scratch, self.spark = threshold, scratch, docs.sparkSession
        #: Rows with one id and one text are one node.
        self.texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        self.texts = self.texts.withColumn("node", F.xxhash64("doc_id", F.xxhash64("text")))

    def profiles(self) -> DataFrame:
        """Stage the documents' classes; return (node, doc_id, n, class, bits)."""
        rows = self.texts.select("node", "text").mapInArrow(_profiles, _DOCS)
        self.scratch.write(rows.write.partitionBy("kind"), "profiles")
        read = self.spark.read.schema(_DOCS).parquet(self.scratch.path("profiles"))
        self.keys = read.where("kind = 'key'").select("key", "docs")
        docs = read.where("kind = 'doc'").select("node", "n", "d1", "d2", "bits")
        # a large group of copies is one row per salt before it meets its class, and no key of the last join holds all of it
        docs = docs.withColumn("salt", F.pmod("node", F.lit(SALTS)))
        some = docs.where("n > 0").groupBy("d1", "d2", "salt").agg(F.min("node").alias("least"))
        least = some.groupBy("d1", "d2").agg(F.min("least").alias("class"))
        some = some.join(least, ["d1", "d2"]).select("d1", "d2", "salt", "class")
        classed = docs.join(some, ["d1", "d2", "salt"], "left")
        self.nodes = self.scratch.keep(classed.select("node", "n", "bits", F.coalesce("class", "node").alias("class")).distinct(), "nodes")
        return self.nodes

    def postings(self) -> DataFrame:
        hot = self.keys.groupBy("key").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= HOT_COUNT).orderBy(F.desc("docs"), "key").limit(HOT_KEYS).toPandas()
        values, docs = hot["key"].to_numpy(np.int64).view(np.uint64), hot["docs"].to_numpy(np.int64)
        order = np.argsort(values)
        frequent = self.spark.sparkContext.broadcast((values[order], docs[order], docs[order] // STAR_ROWS + 1))
        posted = self.texts.select("node", "text").mapInArrow(_postings(self.threshold, frequent), "key long, node long, n int, place int, star int")
        tile = Window.partitionBy("key", "star")
        # a shingle of one document makes no tile, but a star of one document does: its key's other documents are in other stars;
        # equal sets of other batches fall onto their class here
        met = posted.withColumn("rows", F.count("*").over(tile)).withColumn("leader", F.min("node").over(tile)).where("rows > 1 or star > 0")
        # kept on its own, so the shuffle of all postings is gone before the few that met anything are joined
        met = self.scratch.keep(met, "met-postings")
        classes = self.nodes.select("node", "class")
        met = met.join(classes, "node").withColumnRenamed("class", "own").join(classes.select(F.col("node").alias("leader"), F.col("class").alias("lead")), "leader")
        tiles = self.scratch.keep(met.select("key", F.col("own").alias("node"), "n", "place", "lead"), "tiles")
        self.scratch.drop("met-postings")
        return tiles

    def links(self, pairs: DataFrame, name: str) -> DataFrame:
        """Pairs whose sets truly reach the threshold."""
        met = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        met = self.scratch.keep(met, f"met-{name}")
        sets = self.likely(met).join(met, "node", "left_semi").select("node", "text").dropDuplicates(["node"]).mapInArrow(_sets, "node long, shingles binary")
        sets = self.scratch.keep(sets, f"sets-{name}")
        a, b = (sets.select(F.col("node").alias(k), F.col("shingles").alias(f"set_{k}")) for k in "ab")
        checked = pairs.join(b, "b").join(a, "a").select("a", "b", "set_a", "set_b")
        found = self.scratch.keep(checked.mapInPandas(_intersect(self.threshold), "a long, b long"), f"links-{name}")
        self.scratch.drop(f"sets-{name}", f"met-{name}")
        return found

    def likely(self, nodes: DataFrame) -> DataFrame:
        """The texts that a filter of bounded size lets pass: all of these nodes and few others, so few texts are shuffled."""
        low, high = FILTER_BITS
        size = min(high, max(low, (16 * nodes.count()).bit_length()))
        place = F.col("node").bitwiseAND(F.lit((1 << size) - 1)) + 1
        parts = nodes.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        bits = np.zeros(1 << (size - 3), np.uint8)
        for r in parts.collect():
            low = (r["part"] - 1) * 4096
            bits[low : low + 4096] = np.frombuffer(r["bits"], np.uint8)
        return self.texts.select("node", "text").mapInArrow(_passing(self.spark.sparkContext.broadcast(bits)), "node long, text string")

    def star_links(self) -> DataFrame:
        sides = self.nodes.select("node", "n", "bits")
        a, b = (sides.select(*(F.col(c).alias(d) for c, d in (("node", k), ("n", f"n_{k}"), ("bits", f"bits_{k}")))) for k in "ab")
        pairs = self.tiles.where("node <> lead").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        bounded = pairs.join(a, "a").join(b, "b").mapInPandas(_bounded_pairs(self.threshold), "a long, b long")
        return self.links(self.scratch.keep(bounded, "star-pairs"), "stars")

    def open_rows(self, rows: DataFrame, edges: DataFrame, name: str) -> DataFrame:
        """Rows (key, node, n, place, comp) of the tiles that still hold several components."""
        found = components(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), self.scratch, name)
        tile = Window.partitionBy("key")
        rows = rows.select("key", "node", "n", "place").join(found, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
        rows = rows.withColumn("low", F.min("comp").over(tile)).withColumn("high", F.max("comp").over(tile)).where("low < high").drop("low", "high")
        return self.scratch.keep(rows.dropDuplicates(["key", "node"]), f"rows-{name}")

    def banded_tiles(self, rows: DataFrame, name: str) -> DataFrame:
        """Rows of open tiles dealt to blocks (key, band, l, r): only documents of equal or adjacent size bands meet. A tile is a key and
        a band: documents of the band on the left, those outside the main component of the band and its neighbours on the right."""
        shares = rows.groupBy("key", "comp").agg(F.count("*").alias("rows"))
        main = shares.groupBy("key").agg(F.max_by("comp", F.struct("rows", "comp")).alias("main"))
        rows = self.scratch.keep(rows.join(main, "key").withColumn("size_band", size_band(F.col("n"), self.threshold)), f"banded-{name}")
        left = rows.withColumn("band", F.col("size_band"))
        right = rows.where("comp <> main").withColumn("band", F.explode(F.array(*[F.col("size_band") + d for d in (-1, 0, 1)])))
        tiles = left.groupBy("key", "band").agg(F.count("*").alias("total")).join(right.groupBy("key", "band").agg(F.count("*").alias("rest")), ["key", "band"])
        lefts, rights = (F.ceil(F.col(c) / F.lit(BLOCK)).cast("int").alias(d) for c, d in (("total", "lefts"), ("rest", "rights")))
        tiles = tiles.select("key", "band", lefts, rights)
        cols = ["key", "band", "l", "r", "side", "node", "n", "place", "comp", "size_band"]
        left = left.join(tiles, ["key", "band"]).withColumn("side", F.lit(0)).withColumn("l", F.pmod("node", "lefts").cast("int")).withColumn("r", F.explode(F.sequence(F.lit(0), F.col("rights") - 1)))
        right = right.join(tiles, ["key", "band"]).withColumn("side", F.lit(1)).withColumn("r", F.pmod("node", "rights").cast("int")).withColumn("l", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)))
        # signatures come last, so they are shuffled once
        return left.select(cols).union(right.select(cols)).join(self.nodes.select("node", "bits"), "node").repartition("key", "band", "l", "r").sortWithinPartitions("key", "band", "l", "r", "side", "n")

    def crossing_links(self, rows: DataFrame, name: str, best_only: bool) -> DataFrame:
        tiles = self.banded_tiles(rows, name).drop("size_band")
        pairs = tiles.mapInPandas(_crossing(self.threshold, best_only), "a long, b long").distinct()
        pairs = self.scratch.keep(pairs, f"pairs-{name}")
        self.scratch.drop(f"banded-{name}")
        return self.links(pairs, name)

    def run(self) -> DataFrame:
        nodes = self.profiles()
        self.tiles = self.postings()
        edges, rows, last = self.star_links(), self.tiles, "tiles"
        for name, best_only in (("best", True), ("rest", False)):
            rows = self.open_rows(rows, edges, name)
            self.scratch.drop(last)
            edges, last = edges.union(self.crossing_links(rows, name, best_only)), f"rows-{name}"
        found = components(edges.select(F.col("b").alias("u"), F.col("a").alias("v")), self.scratch, "whole")
        whole = nodes.select("node", "n", "class").join(found.select(F.col("node").alias("class"), "component"), "class", "left").select("node", "n", F.coalesce("component", "class").alias("group"))
        rows = self.texts.select("doc_id", "node").join(whole, "node")
        least = rows.groupBy("group").agg(F.min("doc_id").alias("component_id"))
        out = self.scratch.keep(rows.join(least, "group").select("doc_id", F.col("n").alias("n_shingles"), "component_id"), "result")
        self.scratch.drop("profiles", "nodes", "rows-rest", "star-pairs", "pairs-best", "pairs-rest")
        return out


def jaccard_components(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """doc_id, n_shingles (set size) and component_id (smallest doc_id reachable by links) of every row of `docs`
    (doc_id, text). `threshold` is the smallest Jaccard similarity in per cent."""
    return _Join(docs, threshold, Scratch(docs.sparkSession, "jaccard")).run()
