"""Prefix trie of rebuilt conversations through composable fingerprints.

A conversation c is rebuilt from the first h turns of its base conversation (c - c % 20) and its own turns after the first h.
No rebuilt text is ever made. A sequence of turns is an element (length n, product g) of a monoid,
(n, g) o (m, f) = (n + m, g + B^n * f) modulo a prime, with four independent products per sequence. So

* original turns are dealt over tasks by range, each task builds the products of its own stretch, and the stretches of a
  conversation are combined by their elements: a conversation with a third of all rows is not one task's work;
* a rebuilt prefix is (base head) o (own suffix), and the own suffix is the own prefix with its first h turns divided out.

Nodes are groups of equal (depth, product). Every row keeps a reference (conversation, turn) to the stored turn it ends with, and
equality is verified, not assumed: within a group the referenced turns have one hash and one parent group, and texts and roles
behind one turn hash are compared themselves. Any disagreement rebuilds everything with other bases and hash seeds.

Sums over subtrees need no walk: a conversation owns the nodes whose smallest member it is, which are the deeper part of
its path. A childless node counts once through its owner; the saved tokens of a subtree are the words on that part of each
member's path, from the top on, that others own. Groups that many conversations share are first reduced per salt.

Defined cases: null role or text is empty; turns go by number, null first, and rows of one number by the hashes of role and text
(a fixed order). Rows with a null conv_id belong to no conversation. Repeated rows are repeated turns. An empty table has no
conversation and no node. Other columns are ignored. The ids that end at a node pass in order through one task as a stream,
because SHA-256 is sequential; they are never held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.staging import Scratch

PRIME = (1 << 31) - 1
HEADS, FAMILY = 4, 20
CHANNELS = 4
DIGIT, DIGITS = 256, 4
ATTEMPTS = 5
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def turn_hashes(role: Column, text: Column, seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(2 * seed), role, text), F.xxhash64(F.lit(2 * seed + 1), text, role)]


def base_of(channel: int, seed: int) -> int:
    """A base that depends on channel and seed, spread over the residues."""
    return pow(7, 1_000_003 * (CHANNELS * seed + channel + 1), PRIME)


def power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo the prime for 0 <= exponent < 256 ** 4, from the powers of each base-256 digit."""
    out = None
    for k in range(DIGITS):
        step = pow(base, DIGIT**k, PRIME)
        table, value = [], 1
        for _ in range(DIGIT):
            table.append(value)
            value = value * step % PRIME
        digit = F.shiftright(exponent, 8 * k).bitwiseAND(F.lit(DIGIT - 1)).cast("int")
        factor = F.get(F.lit(table).cast("array<bigint>"), digit)
        out = factor if out is None else (out * factor) % PRIME
    return out


def products(values: list[Column]) -> list[Column]:
    """Four residues as two keys."""
    return [values[0] * (1 << 31) + values[1], values[2] * (1 << 31) + values[3]]


def residues(frame: str = "") -> list[Column]:
    return [F.col(f"{frame}g{k}") for k in range(CHANNELS)]


def hashed_turns(conversations: DataFrame, seed: int) -> DataFrame:
    """(conv_id, turn, t1, t2, words) of every turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    t1, t2 = turn_hashes(F.col("role"), F.col("text"), seed)
    return rows.select("conv_id", "turn", t1.alias("t1"), t2.alias("t2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"), F.xxhash64("role").alias("o1"), F.xxhash64("text").alias("o2"))


def original_prefixes(conversations: DataFrame, seed: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns as (conv_id, part, i, t1, t2, words, all_words, g0..g3), where i counts from 1 and g is the product of the first i
    turns; and the stretches (conv_id, part)."""
    order = [F.asc_nulls_first("turn"), F.asc("o1"), F.asc("o2")]
    dealt = hashed_turns(conversations, seed).repartitionByRange(F.asc("conv_id"), *order).withColumn("part", F.spark_partition_id())
    dealt = scratch.keep(dealt, f"turns-{seed}")

    stretch = Window.partitionBy("conv_id", "part").orderBy(*order)
    running = stretch.rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.withColumn("k", F.row_number().over(stretch).cast("long"))
    bits = [F.col("t1"), F.shiftrightunsigned("t1", 31), F.col("t2"), F.shiftrightunsigned("t2", 31)]
    for c in range(CHANNELS):
        local = local.withColumn(f"x{c}", F.pmod(bits[c], F.lit(PRIME)))
    # each term is below 2^31, so a stretch may hold 2^32 turns before a running sum leaves 63 bits
    local = local.select("conv_id", "part", "k", "t1", "t2", "words", *[f"x{c}" for c in range(CHANNELS)], F.sum("words").over(running).alias("w"),
                         *[F.pmod(F.sum((F.col(f"x{c}") * power(base_of(c, seed), F.col("k"))) % PRIME).over(running), F.lit(PRIME)).alias(f"l{c}") for c in range(CHANNELS)])
    local = scratch.keep(local, f"local-{seed}")

    ends = local.groupBy("conv_id", "part").agg(F.max("k").alias("n"), F.max_by("w", "k").alias("w"), *[F.max_by(f"l{c}", "k").alias(f"l{c}") for c in range(CHANNELS)])
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifts = {c: power(base_of(c, seed), F.col("start")) for c in range(CHANNELS)}
    ends = ends.select("conv_id", "part", "n", "start", F.coalesce(F.sum("w").over(before), F.lit(0)).alias("w_before"), *[shifts[c].alias(f"p{c}") for c in range(CHANNELS)], *[f"l{c}" for c in range(CHANNELS)])
    ends = ends.select("conv_id", "part", "n", "start", "w_before", *[f"p{c}" for c in range(CHANNELS)],
                       *[F.pmod(F.coalesce(F.sum((F.col(f"l{c}") * F.col(f"p{c}")) % PRIME).over(before), F.lit(0)), F.lit(PRIME)).alias(f"s{c}") for c in range(CHANNELS)])
    ends = scratch.keep(ends, f"stretches-{seed}")

    placed = local.join(ends.drop("n"), ["conv_id", "part"]).select(
        "conv_id", "part", (F.col("start") + F.col("k")).alias("i"), "t1", "t2", "words", (F.col("w") + F.col("w_before")).alias("all_words"), *[f"x{c}" for c in range(CHANNELS)],
        *[((F.col(f"s{c}") + F.col(f"p{c}") * F.col(f"l{c}")) % PRIME).alias(f"g{c}") for c in range(CHANNELS)])
    return scratch.keep(placed, f"placed-{seed}"), ends


def rebuilt_prefixes(placed: DataFrame, stretches: DataFrame, seed: int) -> DataFrame:
    """One row per conversation and depth of its rebuilt form: conv_id, seg, depth, size (its last depth), the node (k1, k2), the parent's
    (q1, q2), the stored turn it ends with (ref_conv, ref_turn, t1, t2), that turn's words and the words before it."""
    fields = ["i", "t1", "t2", "words", "all_words", *[f"x{c}" for c in range(CHANNELS)], *[f"g{c}" for c in range(CHANNELS)]]
    heads = placed.where(F.col("i") < HEADS).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("head"))
    convs = stretches.groupBy("conv_id").agg(F.sum("n").alias("n")).join(heads, "conv_id")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS))
    convs = convs.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), F.col("head").alias("own"))
    convs = convs.join(heads.select(F.col("conv_id").alias("base"), F.col("head").alias("_base_head")), "base", "left")
    empty = F.array().cast(heads.schema["head"].dataType)
    convs = convs.withColumn("head", F.slice(F.coalesce("_base_head", empty), F.lit(1), F.col("h").cast("int"))).drop("_base_head")
    convs = convs.withColumn("taken", F.size("head").cast("long")).withColumn("size", F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    last, cut = F.get("head", F.col("taken").cast("int") - 1), F.get("own", F.col("h").cast("int") - 1)
    zero = F.lit(0).cast("long")
    # what the own suffix is combined with: the base head's product and words, less the own first h turns
    convs = convs.select("conv_id", "base", "size", "taken", "h", "head", F.coalesce(last["all_words"], zero).alias("head_words"), F.coalesce(cut["all_words"], zero).alias("cut_words"),
                         *[F.coalesce(last[f"g{c}"], zero).alias(f"b{c}") for c in range(CHANNELS)], *[F.coalesce(cut[f"g{c}"], zero).alias(f"c{c}") for c in range(CHANNELS)])

    def parent(g: Column, x: Column, depth: Column, c: int) -> Column:
        return F.pmod(g - (x * power(base_of(c, seed), depth)) % PRIME, F.lit(PRIME))

    per_stretch = stretches.select("conv_id", "part").join(convs.drop("head", "base"), "conv_id")
    own = placed.join(per_stretch, ["conv_id", "part"]).where("i > h").withColumn("depth", F.col("i") - F.col("h") + F.col("taken"))
    shift = []
    for c in range(CHANNELS):
        base, table = base_of(c, seed), []
        for e in range(1 - HEADS, 1):  # taken - h
            table.append(pow(base, e, PRIME))
        shift.append(F.get(F.lit(table).cast("array<bigint>"), (F.col("taken") - F.col("h") + (HEADS - 1)).cast("int")))
    own = own.select("conv_id", F.col("part").alias("seg"), "depth", "size", F.col("conv_id").alias("ref_conv"), F.col("i").alias("ref_turn"), "t1", "t2", "words",
                     (F.col("head_words") + F.col("all_words") - F.col("cut_words") - F.col("words")).alias("before"), *[f"x{c}" for c in range(CHANNELS)],
                     *[((F.col(f"b{c}") + F.pmod(F.col(f"g{c}") - F.col(f"c{c}"), F.lit(PRIME)) * shift[c]) % PRIME).alias(f"g{c}") for c in range(CHANNELS)])
    head = convs.select("conv_id", "size", "base", F.explode("head").alias("e")).select(
        "conv_id", F.lit(-1).alias("seg"), F.col("e.i").alias("depth"), "size", F.col("base").alias("ref_conv"), F.col("e.i").alias("ref_turn"), "e.t1", "e.t2", "e.words", (F.col("e.all_words") - F.col("e.words")).alias("before"),
        *[F.col(f"e.x{c}") for c in range(CHANNELS)], *[F.col(f"e.g{c}") for c in range(CHANNELS)])
    rows = own.unionByName(head)
    up = products([parent(F.col(f"g{c}"), F.col(f"x{c}"), F.col("depth"), c) for c in range(CHANNELS)])
    k1, k2 = products(residues())
    rows = rows.select("conv_id", "seg", "depth", "size", k1.alias("k1"), k2.alias("k2"), up[0].alias("q1"), up[1].alias("q2"), "ref_conv", "ref_turn", "t1", "t2", "words", "before")
    none = F.lit(None).cast("long")
    root = convs.select("conv_id", F.lit(-1).alias("seg"), zero.alias("depth"), "size", zero.alias("k1"), zero.alias("k2"), none.alias("q1"), none.alias("q2"), none.alias("ref_conv"), none.alias("ref_turn"),
                        none.alias("t1"), none.alias("t2"), zero.alias("words"), zero.alias("before"))
    return rows.unionByName(root)


def ends_digests(rows: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): conversations whose last node this is, streamed in order through one running hash."""
    ends = rows.where("depth = size").select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([d[j] for d in done], pa.int64() if j < 3 else pa.string()) for j in range(4)], names=[*KEY, "ends_sha256"])

        for batch in batches:
            for *node, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if node != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = node, hashlib.sha256(str(conv).encode())
                else:
                    state.update(b",%d" % conv)
            if len(done) > 4_096:
                yield flush()
                done = []
        if key is not None:
            done.append((*key, state.hexdigest()))
        if done:
            yield flush()

    return ends.mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


def disagreements(conversations: DataFrame, groups: DataFrame, seed: int) -> bool:
    """Whether a node group mixes parents or turn hashes, or a turn hash mixes texts or roles."""
    mixed = " OR ".join(f"{c}_low <> {c}_high" for c in ("q1", "q2", "t1", "t2"))
    if groups.where(mixed).limit(1).count():
        return True
    turns = conversations.where("conv_id IS NOT NULL").select(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t1, t2 = turn_hashes(F.col("role"), F.col("text"), seed)
    turns = turns.select(t1.alias("t1"), t2.alias("t2"), "role", "text").groupBy("t1", "t2").agg(*[fn(c).alias(f"{c}_{end}") for c in ("role", "text") for fn, end in ((F.min, "low"), (F.max, "high"))])
    return turns.where("role_low <> role_high OR text_low <> text_high").limit(1).count() > 0


def trie_nodes(conversations: DataFrame, salts: int | None = None) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    and the stored turn it ends with (ref_conv, ref_turn: the turn's place in its original conversation)."""
    spark = conversations.sparkSession
    salts = salts or max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    scratch = Scratch(spark, "prefix-trie")
    for seed in range(ATTEMPTS):
        placed, stretches = original_prefixes(conversations, seed, scratch)
        rows = rebuilt_prefixes(placed, stretches, seed).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts)))
        rows = scratch.keep(rows, f"rows-{seed}")
        checked = ("q1", "q2", "t1", "t2")
        parts = rows.groupBy(*KEY, "salt").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("size").alias("longest"),
                                               *[fn(c).alias(f"{c}_{end}") for c in checked for fn, end in ((F.min, "low"), (F.max, "high"))])
        parts = scratch.keep(parts, f"parts-{seed}")
        groups = parts.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("longest").alias("longest"),
                                         *[fn(f"{c}_{end}").alias(f"{c}_{end}") for c in checked for fn, end in ((F.min, "low"), (F.max, "high"))])
        groups = scratch.keep(groups, f"groups-{seed}")
        if not disagreements(conversations, groups, seed):
            break
    else:
        raise RuntimeError(f"fingerprints of different prefixes agreed under {ATTEMPTS} seeds")
    scratch.drop(f"turns-{seed}", f"local-{seed}", f"placed-{seed}", f"stretches-{seed}")

    # the owner of a node for every salt that its members have: no join key holds a whole hot group
    owners = parts.select(*KEY, "salt").join(groups.select(*KEY, F.col("conv_id").alias("owner"), "longest"), KEY)
    owners = scratch.keep(owners, "owners")
    owned = scratch.keep(rows.join(owners, [*KEY, "salt"]), "owned")
    shared = F.col("owner") < F.col("conv_id")
    per_stretch = owned.groupBy("conv_id", "seg").agg(F.max(F.when(shared, F.col("before") + F.col("words"))).alias("shared_words"),
                                                      F.max(((F.col("depth") == F.col("size")) & ~shared & (F.col("longest") == F.col("depth"))).cast("long")).alias("leaf"))
    per_conv = per_stretch.groupBy("conv_id").agg(F.coalesce(F.max("shared_words"), F.lit(0)).alias("shared_words"), F.max("leaf").alias("leaf"))
    per_stretch = per_stretch.select("conv_id", "seg").join(per_conv, "conv_id")
    below = owned.join(per_stretch, ["conv_id", "seg"]).groupBy(*KEY).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.lit(0), F.col("shared_words") - F.col("before"))).alias("saved_tokens"),
        F.min(F.when(~shared, F.col("ref_conv"))).alias("ref_conv"), F.min(F.when(~shared, F.col("ref_turn"))).alias("ref_turn"))

    nodes = groups.select(*KEY, "conv_id", "n_convs", F.col("q1_low").alias("q1"), F.col("q2_low").alias("q2"))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"), F.col("q2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = owners.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"), "salt", F.col("owner").alias("parent_conv_id"))
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(salts))).join(parents, ["depth", "q1", "q2", "salt"], "left")
    found = nodes.join(children, KEY, "left").join(below, KEY).join(ends_digests(rows), KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"), "ref_conv", "ref_turn")
