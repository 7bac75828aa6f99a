"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Every document is encoded once; longer ones are cut from the end into whole sequences, so only the first piece may be
shorter. The shorter pieces are packed in rounds. In a round groups of at most about GROUP items are packed best-fit, largest
first, in one task each. Bins that no remaining item could use are emitted; the other bins go on as items of the next
round, where FAN groups merge into one, until one group is left. Best fit leaves at most one bin per group that is no more than half
full, so a group can use at most one fuller bin from elsewhere: besides that bin it hands on the KEEP emptiest bins and
emits the rest as sequences that stay as they are. So the last group holds few bins, whatever the input.

Defined cases: null text is empty and is one piece of one id (0). Repeated rows are packed each. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.staging import Scratch
from tessera.llm.tokens import encode_all, vocabulary_path

GROUP = 8_192  # items of a group in the first round
FAN = 16  # groups that merge in a round
KEEP = 256  # underfull bins that a group hands on
FULL = 0.998  # share of a sequence from which a bin counts as full

_PIECES = "doc_id long, row long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            docs, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for doc, row, ids in zip(docs, rows, encode_all(batch.column("text").to_pylist(), path)):
                ids = np.array([*ids, 0], dtype="<u4")
                first = len(ids) % limit or limit
                cuts = [0, *range(first, len(ids) + 1, limit)]
                for piece, (low, high) in enumerate(zip(cuts, cuts[1:])):
                    out.append((doc, row, piece, low, high - low, zlib.crc32(ids[low:high].tobytes())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each item, items given largest first. The room of open bins is one set bit per size in an
    integer, so the tightest bin is the lowest set bit from the item's size on."""
    bins, offsets, room, open_sizes, count = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), [[] for _ in range(limit + 1)], 0, 0
    for i, size in enumerate(sizes.tolist()):
        fits = open_sizes >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                open_sizes &= ~(1 << left)
        else:
            left, b = limit, count
            count += 1
        bins[i], offsets[i] = b, limit - left
        left -= size
        if left:
            room[left].append(b)
            open_sizes |= 1 << left
    return bins, offsets


def _round(limit: int, final: bool):
    """Packs one group's items; gives each item its bin, its offset there, and whether the bin is finished."""

    def run(group):
        import pandas as pd

        group = group.sort_values(["size", "item"], ascending=[False, True])
        number = int(group["grp"].iloc[0])
        bins, offsets = best_fit(group["size"].to_numpy(), limit)
        fill = np.bincount(bins, weights=group["size"].to_numpy()).astype(np.int64)
        done = fill >= limit * FULL
        rest = np.flatnonzero(~done)
        done[rest[np.argsort(fill[rest], kind="stable")[KEEP:]]] = True
        done |= final
        return pd.DataFrame({"item": group["item"].to_numpy(), "bin": number * (1 << 32) + bins, "place": offsets, "fill": fill[bins], "done": done[bins]})

    return run


def pack(docs: DataFrame, limit: int = 2048, vocabulary: str | None = None) -> DataFrame:
    """One row per piece of `docs` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    rows = docs.select("doc_id", "text").withColumn("row", F.monotonically_increasing_id()).select(F.col("doc_id").cast("long"), "row", "text")
    pieces = rows.mapInArrow(_pieces(vocabulary or vocabulary_path(), limit), _PIECES)
    # numbers are given once and stored, so a repeated task cannot change them
    pieces = scratch.keep(pieces.withColumn("item", F.monotonically_increasing_id()), "pieces")
    items = pieces.where(F.col("length") < limit).select("item", F.col("length").alias("size"))
    groups = -(-items.count() // GROUP)
    placed, level = None, 0
    schema = "item long, bin long, place long, fill long, done boolean"
    while groups:
        # whole sequences keep ids below those of the rounds
        packed = items.withColumn("grp", F.pmod(F.xxhash64("item"), F.lit(groups)).cast("int") if level == 0 else F.floor(F.col("item") / (1 << 32) / F.lit(FAN)).cast("int"))
        packed = scratch.keep(packed.groupBy("grp").applyInPandas(_round(limit, groups == 1), schema), f"round-{level}")
        here = packed.select("item", "bin", "place", "done")
        if placed is None:
            placed = here.select("item", F.struct(F.lit(level).alias("level"), "bin").alias("at"), "place", "done")
        else:
            moved = here.select(F.struct(F.lit(level - 1).alias("level"), F.col("item").alias("bin")).alias("from"), F.col("bin").alias("to"), F.col("place").alias("shift"), F.col("done").alias("ended"))
            placed = placed.join(moved, placed["at"] == moved["from"], "left").select(
                "item", F.when(F.col("to").isNull(), F.col("at")).otherwise(F.struct(F.lit(level).alias("level"), F.col("to").alias("bin"))).alias("at"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"), F.coalesce("ended", "done").alias("done"))
            placed = scratch.keep(placed, f"placed-{level}")
        if groups == 1:
            break
        items = packed.where("NOT done").select(F.col("bin").alias("item"), F.col("fill").alias("size")).distinct()
        groups, level = -(-groups // FAN), level + 1
    if placed is None:
        placed = spark.createDataFrame([], "item long, at struct<level: int, bin: bigint>, place long, done boolean")
    # an id is the round in the top bits and the bin below; sequences of one whole piece come after all rounds
    number = F.coalesce(F.col("at.level").cast("long") * F.lit(1 << 56) + F.col("at.bin"), F.lit(1 << 61) + F.col("item"))
    return pieces.join(placed, "item", "left").select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), F.coalesce("place", F.lit(0)).cast("long").alias("offset"))
