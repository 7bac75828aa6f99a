"""Mixing sources to target weights as a time-varying curriculum.

Every source has its own weight schedule w(t) over training time t in [0, 1], which integrates to its cumulative token demand
D(t) = target * (W(t) / W(1)), where W is the integral. The source's documents stand in a fixed hashed order, pass after
pass; a document whose words begin at place c of that stream is due at the time the source's D inverted gives for c. The mix is
the documents range-sorted by that position. Schedules are linear, w(t) = 1 + tilt * (2 t - 1) with the source's tilt from -1
(from double weight down to none) to 1 (from none up to double); the inverse is a square root. Sources take `tilts` in turn, as
they take `weights`. A source's share of the mix therefore changes over the training time wherever the tilts differ.

Places in a stream are running sums over a source. They are taken in three levels (blocks of blocks of documents), each
split by a hash, so that a source with a third of all rows is spread over many tasks.

Targets: sources weigh `weights` in turn, by code point with null last, and share `share` times all words. A target stops at
`most` times its source's size; the excess goes to the others by weight until none is above. That is the level at which
min(cap, level * weight) fills the share, found with running sums over the sources.

Defined cases: null or blank text has size 0 and is never taken. Repeated rows of one doc_id are each taken in turn. A null
doc_id counts as the empty text in the order. Without any words all targets are 0. Extra columns are ignored by `mix_plan` and
stay in `mixed_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.staging import Scratch

WEIGHTS = (5, 2, 1)
TILTS = (0.5, -0.5, 0.0)
SHARE, MOST = 1.5, 2
FINE, COARSE = 1 << 24, 1 << 12  # parts of the hashed order


def words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """(source, source_size, target, tilt) from (source, size)."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.orderBy("ratio", "turn")

    def in_turn(values: tuple) -> Column:
        return F.element_at(F.array(*(F.lit(float(x)) for x in values)), F.pmod(F.col("turn") - 1, F.lit(len(values))) + 1)

    before = every.rowsBetween(Window.unboundedPreceding, -1)
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("turn", F.row_number().over(by_name))
    rows = rows.withColumn("weight", in_turn(weights)).withColumn("tilt", in_turn(tilts)).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("ratio", F.col("cap") / F.col("weight"))
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    first = F.first(F.when(F.col("ratio") >= F.col("level"), F.col("level")), ignorenulls=True).over(whole)
    rows = rows.withColumn("level", first)
    return rows.select("source", "source_size", F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))).alias("target"), "tilt")


def _places(rows: DataFrame) -> DataFrame:
    """Adds `place`: words of the source before the document in the hashed order."""
    rows = rows.withColumn("order", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = rows.withColumn("fine", F.conv(F.substring("order", 1, 6), 16, 10).cast("long")).withColumn("coarse", F.floor(F.col("fine") / (FINE // COARSE)))

    def before(keys: list[str], order: list) -> Window:
        return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)

    def sums(df: DataFrame, keys: list[str], by: str, name: str) -> DataFrame:
        return df.withColumn(name, F.coalesce(F.sum("size").over(before(keys, [by])), F.lit(0))).drop("size")

    fine = rows.groupBy("source", "coarse", "fine").agg(F.sum("size").alias("size"))
    coarse = fine.groupBy("source", "coarse").agg(F.sum("size").alias("size"))
    starts = sums(fine, ["source", "coarse"], "fine", "in_coarse").withColumnsRenamed({"source": "s1", "coarse": "c1", "fine": "f1"})
    tops = sums(coarse, ["source"], "coarse", "in_source").withColumnsRenamed({"source": "s2", "coarse": "c2"})
    rows = rows.join(starts, rows["source"].eqNullSafe(F.col("s1")) & (rows["fine"] == F.col("f1"))).drop("s1", "c1", "f1")
    rows = rows.join(tops, rows["source"].eqNullSafe(F.col("s2")) & (rows["coarse"] == F.col("c2"))).drop("s2", "c2")
    inside = before(["source", "fine"], [F.col("order"), F.col("doc_id"), F.col("version")])
    return rows.withColumn("place", F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("in_coarse") + F.col("in_source")).drop("fine", "coarse", "in_coarse", "in_source", "order")


def _key(doc: str, version: str, source: str) -> Column:
    """One value for an id, text and source, nulls included: window and join then share one shuffle of the texts."""
    return F.md5(F.to_json(F.struct(F.col(doc).cast("string").alias("d"), F.col(version).alias("v"), F.col(source).cast("string").alias("s"))))


def due(place: Column, target: Column, tilt: Column) -> Column:
    """The training time at which `place` words of a source are demanded: D inverted, in the form that holds for a tilt of 0."""
    share, start = F.try_divide(place, target), 1.0 - tilt
    whole = start + F.sqrt(F.greatest(F.lit(0.0), start * start + share * tilt * 4.0))
    return F.when(share == 0, F.lit(0.0)).otherwise(F.try_divide(share * 2.0, whole))


def mix_plan(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """One row per document of `docs` (doc_id, text, source): size, source_size, target, tilt, taken, its place in the source's stream, and `position`, the training time of its
    first taken word (null if none is taken). Range-sorted by position. Pass p of the stream covers the places from (p - 1) source_size on, and words up to the rounded target are taken."""
    rows = docs.select("doc_id", F.col("source"), F.xxhash64("text").alias("version"), words(F.col("text")).alias("size"))
    rows = Scratch(docs.sparkSession, "mixing").keep(rows, "sizes")
    goals = targets(rows, share, most, weights, tilts).withColumnRenamed("source", "goal")
    rows = _places(rows)
    rows = rows.join(goals, rows["source"].eqNullSafe(F.col("goal"))).drop("goal")
    whole = F.round("target").cast("long")
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), whole - F.col("source_size") * p - F.col("place"))) for p in range(most)]
    rows = rows.withColumn("passes", F.array(*passes)).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda a, x: a + x))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, due(F.col("place").cast("double"), F.col("target"), F.col("tilt"))))
    return rows.select("doc_id", "size", "source_size", "target", "tilt", "taken", "position", "place", "passes", "source", "version").orderBy(F.col("position").asc_nulls_last(), "doc_id")


def mixed_documents(docs: DataFrame, share: float = SHARE, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, tilts: tuple[float, ...] = TILTS) -> DataFrame:
    """The mix itself: each document once per pass that takes it, range-sorted by training position, columns as in `docs`. The one document per source and pass at
    which the target is reached keeps only its taken words; `n_chars` is recounted for it."""
    plan = mix_plan(docs, share, most, weights, tilts).where("taken > 0")
    plan = plan.select(F.col("doc_id").alias("_doc"), F.col("version").alias("_version"), F.col("source").alias("_source"), F.col("size").alias("_whole"), F.col("source_size").alias("_total"), F.col("target").alias("_target"), F.col("tilt").alias("_tilt"), F.col("place").alias("_place"), F.posexplode("passes").alias("_pass", "_taken"))
    plan = plan.where("_taken > 0").withColumn("_position", due((F.col("_place") + F.col("_pass") * F.col("_total")).cast("double"), F.col("_target"), F.col("_tilt")))
    # the n-th row of one id, text and source takes the n-th plan row
    plan = plan.withColumn("_same", _key("_doc", "_version", "_source")).withColumn("_nth", F.dense_rank().over(Window.partitionBy("_same").orderBy("_place"))).drop("_doc", "_version", "_source", "_total", "_target", "_tilt", "_place", "_pass")
    rows = docs.withColumn("_hash", F.xxhash64("text")).withColumn("_row_key", _key("doc_id", "_hash", "source")).drop("_hash")
    rows = rows.withColumn("_nth_row", F.row_number().over(Window.partitionBy("_row_key").orderBy(F.lit(0))))
    rows = rows.join(plan, F.col("_row_key") == F.col("_same")).where("_nth_row = _nth")
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+"), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), "")
    rows = rows.withColumn("_part", F.col("_taken") < F.col("_whole")).withColumn("text", F.when(F.col("_part"), head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_part"), F.char_length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return rows.orderBy("_position", "doc_id").select(docs.columns)
