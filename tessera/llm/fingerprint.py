"""One-permutation MinHash fingerprints with optimal densification and packed low-order bits.

A text's words (lower case, split at space and `\\t-\\r`) give 5-word shingles, each hashed once to 64 signed bits; fewer words
are one shingle. The top 8 bits choose one of 256 bins, and a bin keeps its smallest hash. Appending one sentinel per bin and
sorting makes the first entry of every bin its minimum, so nothing is exploded or shuffled. An empty bin j takes the value
of the first filled bin in its own pseudo-random sequence of bins (optimal densification). Four low bits of every bin are
kept as one hexadecimal digit. Two unlike bins agree by chance once in 16, so likeness is `(m - 1/16) / (1 - 1/16)` for a
share m of equal digits, not below 0.

Defined cases: null text is empty; an empty text has the one shingle of no words, so empty texts are alike. Rows of one doc_id
and the same text are one document for the order; null doc_ids come first. Extra columns are ignored.

Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.staging import Scratch

BINS, BITS, WIDTH = 256, 4, 5
_LOW = (1 << 56) - 1  # a sentinel has all bits below the bin number


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the fingerprint of a text column as `out`, a string of one hexadecimal digit per bin."""
    words = F.split(F.btrim(F.lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r")), "[\\x20\\x09-\\x0D]+", -1)
    df = df.withColumn("_words", F.transform(words, lambda w: F.xxhash64(w)))
    w = F.col("_words")
    # five words by three pairings: (w0 w1) (w2 w3), then w4
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.xxhash64(x, y))
    df = df.withColumn("_pairs", F.when(F.size(w) >= WIDTH, pairs))
    p, n = F.col("_pairs"), F.size(w) - (WIDTH - 1)
    fours = F.zip_with(F.slice(p, 1, n), F.slice(p, 3, n), lambda x, y: F.xxhash64(x, y))
    many = F.zip_with(fours, F.slice(w, WIDTH, n), lambda x, y: F.xxhash64(x, y))
    few = F.array(F.xxhash64(F.array_join(F.transform(w, lambda x: x.cast("string")), " ")))
    df = df.withColumn("_hashes", F.when(F.size(w) >= WIDTH, many).otherwise(few))
    sentinels = F.array(*(F.lit((b << 56) | _LOW).cast("long") for b in range(-BINS // 2, BINS // 2)))
    df = df.withColumn("_sorted", F.sort_array(F.concat("_hashes", sentinels)))
    s = F.col("_sorted")
    first = F.filter(s, lambda h, i: (i == 0) | (F.shiftright(h, 56) != F.shiftright(F.get(s, i - 1), 56)))
    df = df.withColumn("_bins", first)
    bins = F.col("_bins")

    def empty(h: Column) -> Column:
        return h.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)

    def probes(j: Column, low: int, high: int) -> Column:
        tried = F.transform(F.sequence(F.lit(low), F.lit(high)), lambda t: F.get(bins, F.pmod(F.xxhash64(j, t), F.lit(BINS)).cast("int")))
        return F.get(F.filter(tried, lambda h: ~empty(h)), 0)

    df = df.withColumn("_full", F.filter(bins, lambda h: ~empty(h)))

    def direct(j: Column) -> Column:
        """The filled bin of least hash with j: what the sequence of bin j would come to, for texts of few shingles."""
        return F.array_min(F.transform("_full", lambda h: F.struct(F.xxhash64(j, F.shiftright(h, 56)), h.alias("h"))))["h"]

    filled = F.transform(bins, lambda h, j: F.when(~empty(h), h).otherwise(F.coalesce(probes(j, 1, 2), probes(j, 3, 16), direct(j))))
    digits = F.transform(filled, lambda h: F.hex(h.bitwiseAND(F.lit((1 << BITS) - 1))))
    return df.withColumn(out, F.array_join(digits, "")).drop("_words", "_pairs", "_hashes", "_sorted", "_bins", "_full")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the texts behind two fingerprints, corrected for chance agreement."""
    chance = 1.0 / (1 << BITS)
    equal = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda same: same))
    return F.greatest(F.lit(0.0), (equal / F.lit(float(BINS)) - chance) / (1.0 - chance))


def following(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, version, next_id, next_version): each document's successor in ascending doc_id, the first after the last. Ids are range-sorted once; only one row per range meets in one task."""
    order = [F.col("doc_id").asc_nulls_first(), F.col("version")]
    ids = docs.select("doc_id", "version").distinct()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = scratch.keep(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ids")
    this = F.struct("doc_id", "version")
    one = Window.partitionBy("part").orderBy(*order)
    rows = ids.withColumn("after", F.lead(this).over(one))
    heads = ids.withColumn("place", F.row_number().over(one)).where("place = 1")
    every = Window.orderBy("part")
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("part", F.coalesce(F.lead(this).over(every), F.first(this).over(whole)).alias("head"))
    rows = rows.join(heads, "part").withColumn("after", F.coalesce("after", "head"))
    return rows.select("doc_id", "version", F.col("after.doc_id").alias("next_id"), F.col("after.version").alias("next_version"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """For every row of `docs` (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next. The edited text has its last floor(n_chars / 2) code points replaced by the first as many
    (or all) of the next document's text."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("version", F.xxhash64("text"))
    pairs = scratch.keep(following(docs, scratch), "next")
    half = F.floor(F.char_length("text") / 2).cast("int")
    sizes = docs.select("doc_id", "version", half.alias("half")).distinct()
    wanted = pairs.join(sizes, (pairs.doc_id.eqNullSafe(sizes.doc_id)) & (pairs.version == sizes.version)).select(pairs.doc_id.alias("for_id"), pairs.version.alias("for_version"), "next_id", "next_version", "half")
    heads = wanted.join(docs, wanted.next_id.eqNullSafe(docs.doc_id) & (wanted.next_version == docs.version)).select("for_id", "for_version", F.substring("text", F.lit(1), F.col("half")).alias("head")).dropDuplicates(["for_id", "for_version"])
    rows = docs.join(heads, docs.doc_id.eqNullSafe(heads.for_id) & (docs.version == heads.for_version))
    n = F.char_length("text")
    rows = rows.select("doc_id", "version", "text", n.cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int")), "head").alias("edited"))
    rows = with_fingerprint(with_fingerprint(rows, "text", "fingerprint"), "edited", "edited_fingerprint")
    rows = scratch.keep(rows.select("doc_id", "version", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint"), "prints")
    prints = rows.select(F.col("doc_id").alias("n_id"), F.col("version").alias("n_version"), F.col("fingerprint").alias("next_print")).distinct()
    near = pairs.join(prints, pairs.next_id.eqNullSafe(prints.n_id) & (pairs.next_version == prints.n_version)).select(F.col("doc_id").alias("p_id"), F.col("version").alias("p_version"), "next_print")
    return rows.join(near, rows.doc_id.eqNullSafe(near.p_id) & (rows.version == near.p_version)).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"))
