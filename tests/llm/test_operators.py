"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import ann, fingerprint, jaccard, linededup, mixing, packing, quality, secrets, tokencount, warc
from tessera.llm.queries import ORACLE_SQL

WORD, BLANKS = re.compile(r"[^\x20\x09-\x0D]+"), " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, size long, score double, place int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n):
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "épsilon", "ZETA", "eta", "theta", "iota", "Éta"]) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng, rows = random.Random(7), []
    texts = [None, "", "  \n ", "one two", "One  TWO", "x" * 5, prose(rng, 30_000)]
    base = prose(rng, 80)
    for i in range(12):  # near copies, in a chain and in a star
        words = base.split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [base, base, base.upper(), "shared license line of ten\n" + prose(rng, 20), "Shared License line of TEN  \n" + prose(rng, 20) + "\n\nshort\nshort", "short\n\tshared license line of ten\n"]
    texts += [prose(rng, rng.randrange(1, 60)) for _ in range(30)] + ["a<|endoftext|>b"]
    for i, text in enumerate(texts):
        rows.append((100 - i, text, None, [None, "s1", "s2", "hot", "hot"][i % 5], len(text or ""), 1, "k", 2, 0.5, 3))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(docs, spark):
    """The same with a null id and a row repeated."""
    more = spark.createDataFrame([(None, "text without an id that is long enough to be a line", None, None, 3, 1, "k", 2, 0.5, 3), (100 - 10, "again", None, "s1", 5, 1, "k", 2, 0.5, 3)], SCHEMA)
    return docs.union(more).union(docs.where("doc_id = 90"))


def texts_of(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def shingle_set(text):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(texts, threshold=75):
    sets, parent = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_jaccard_components(docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == brute_components(texts_of(docs))


def test_jaccard_in_small_tiles(docs, monkeypatch):
    for name, value in (("BLOCK", 3), ("STAR_ROWS", 2), ("HOT_COUNT", 2), ("PAIRS", 5)):
        monkeypatch.setattr(jaccard, name, value)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs.repartition(3)).collect()}
    assert got == {i: c for i, (_, c) in brute_components(texts_of(docs)).items()}


def test_jaccard_pairs_of_a_very_common_passage(spark, monkeypatch):
    """Two near copies that consist mostly of a passage which many long documents hold: their prefix keys have many stars."""
    for name, value in (("STAR_ROWS", 2), ("HOT_COUNT", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rows = []
    for p in range(20):
        passage = " ".join(f"p{p}w{k}" for k in range(40))
        rows += [(100 * p + i, f"{passage} at{i}") for i in range(2)]
        rows += [(100 * p + i, passage + " " + " ".join(f"d{p}x{i}y{k}" for k in range(200))) for i in range(10, 22)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame).collect()}
    assert got == brute_components(dict(rows))
    assert all(got[100 * p + 1][1] == 100 * p for p in range(20))


def test_jaccard_tiles_hold_adjacent_size_bands(spark, docs):
    join = jaccard._Join(docs, 75, jaccard.Scratch(spark, "test"))
    sizes = [1, 2, 3, 4, 5, 8, 11, 15, 20, 30, 40, 55, 75, 100, 140, 200, 300]
    rows = spark.createDataFrame([(1, 100 + i, n, 0, 100 + i % 7) for i, n in enumerate(sizes * 4)], "key long, node long, n int, place int, comp long")
    join.nodes = rows.select("node").withColumn("bits", F.lit(bytearray(8)))
    tiles = join.banded_tiles(rows, "test").collect()
    blocks = defaultdict(list)
    for r in tiles:
        blocks[(r["key"], r["band"], r["l"], r["r"])].append(r)
    assert max(abs(a["size_band"] - b["size_band"]) for block in blocks.values() for a in block for b in block if a["side"] != b["side"]) == 1
    met = {frozenset((a["node"], b["node"])) for block in blocks.values() for a in block for b in block if a["side"] != b["side"]}
    main = max(range(7), key=lambda c: (sum(i % 7 == c for i in range(len(sizes) * 4)), c)) + 100
    for a in rows.collect():
        for b in rows.collect():
            if a["comp"] != b["comp"] and main != b["comp"] and min(a["n"], b["n"]) * 100 >= 75 * max(a["n"], b["n"]):
                assert frozenset((a["node"], b["node"])) in met


def test_jaccard_sets_come_in_slices_of_bounded_text():
    """10,000 texts of 10 KB in one batch: a worker holds the sets of a slice, not of the batch."""
    import pyarrow as pa
    import tracemalloc

    text = [f"{i} " + f"w{i % 97} x y z " * 700 for i in range(10_000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(text)), pa.int64()), pa.array(text)], names=["node", "text"])
    del text
    assert batch.nbytes > 60 << 20
    pieces = list(jaccard.shingles.slices([batch]))
    assert sum(p.num_rows for p in pieces) == batch.num_rows and max(pa.compute.sum(pa.compute.binary_length(p.column("text"))).as_py() for p in pieces) <= jaccard.shingles.SLICE
    tracemalloc.start()
    rows = sum(r.num_rows for r in jaccard._profiles(iter([batch])) if r.num_rows and r.column("kind")[0].as_py() == "doc")
    assert rows == batch.num_rows and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


def test_jaccard_odd_rows(odd):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == odd.count() and jaccard.jaccard_components(odd.where("false")).count() == 0


def brute_lines(texts, least=10):
    owners = defaultdict(set)
    for i, t in texts.items():
        for line in t.split("\n"):
            owners[lower(line.strip(BLANKS))].add(i)
    out = {}
    for i, t in texts.items():
        stay = [x for x in t.split("\n") if len(k := lower(x.strip(BLANKS))) < least or min(owners[k]) == i]
        out[i] = (t.count("\n") + 1, t.count("\n") + 1 - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, batches):
    got = {r["doc_id"]: tuple(r)[1:] for r in linededup.line_digests(docs, batches=batches).collect()}
    assert got == brute_lines(texts_of(docs))


def test_line_dedup_odd_rows(odd, docs):
    kept = linededup.drop_repeated_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert {r["text"] for r in kept.where("doc_id IS NULL").collect()} == {"text without an id that is long enough to be a line"}
    assert linededup.line_digests(docs.where("false")).count() == 0
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_line_dedup_of_tables_without_keys(spark, docs):
    """Empty tables, tables without a long line, a batch without a key in the middle, and one id only."""
    short = [(i, "short") for i in range(8)]
    gap = [(i, "a line that repeats" if i in (0, 1, 14, 15) else "short") for i in range(16)]
    one = [(7, "a line that repeats\na line that repeats\nshort"), (7, "a line that repeats")]
    for rows in ([], short, gap, one):
        for batches in (1, 4, None):
            got = linededup.line_digests(spark.createDataFrame(rows, "doc_id long, text string"), batches=batches).collect()
            want = brute_lines(dict(rows))
            if rows is one:
                assert sorted(r["n_dropped"] for r in got) == [0, 0]
            else:
                assert {r["doc_id"]: tuple(r)[1:] for r in got} == want


def _operators_over_runs(plan):
    """For each bucketed scan of a plan, the operators between it and the join above."""
    lines, out = plan.split("\n"), []
    for at, line in enumerate(lines):
        if "Bucketed: true" in line:
            depth, above = len(line) - len(line.lstrip(" :+-*()0123456789")), []
            for upper in reversed(lines[:at]):
                d = len(upper) - len(upper.lstrip(" :+-*()0123456789"))
                if d < depth:
                    depth = d
                    above.append(upper.lstrip(" :+-*()0123456789").split(" ")[0].split("(")[0])
                    if "Join" in above[-1]:
                        break
            out.append(above)
    return out


def test_line_runs_are_joined_in_place(spark, docs):
    store = linededup.LineRuns(spark, fanout=10)
    for low in (60, 80):
        store.add(docs.where(f"doc_id >= {low} AND doc_id < {low + 20}"))
    keys = store._rows(store._write(linededup.hashed_lines(docs, 10).groupBy("h1", "h2").agg(F.min("doc_id").alias("first")), "batch"))
    with linededup._in_place(spark):
        for frame in (store.fresh(keys), store.older(keys), store.merged(store.runs)):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            over = _operators_over_runs(plan)
            assert len(over) >= 2 and all(a[-1] == "SortMergeJoin" for a in over), plan
            assert not any(op.startswith(("Exchange", "Sort")) and op != "SortMergeJoin" for a in over for op in a), plan
        assert "Anti" in store.fresh(keys)._jdf.queryExecution().executedPlan().toString()
        a, b = (store._rows(run).select("h1", "h2") for run in store.runs)
        assert a.intersect(b).count() == 0
    store.close()


def test_line_store_is_opened_again(spark, docs, tmp_path):
    texts = texts_of(docs)
    first = linededup.LineRuns(spark, root=str(tmp_path / "lines"), buckets=3)
    first.add(docs.where("doc_id < 60"))
    first.add(docs.where("doc_id >= 60 AND doc_id < 80"))
    first.close()
    again = linededup.LineRuns(spark, root=str(tmp_path / "lines"))
    assert again.buckets == 3 and len(again.runs) == 1
    lost = {r["doc_id"]: len(r["gone"]) for r in again.add(docs.where("doc_id >= 80")).collect()}
    assert lost == {i: n for i, (_, n, _) in brute_lines(texts).items() if n and i >= 80}
    again.close()


def test_line_runs_compact(spark, docs):
    store = linededup.LineRuns(spark, buckets=2, fanout=2)
    for low in range(40, 110, 10):
        store.add(docs.where(f"doc_id >= {low} AND doc_id < {low + 10}")).count()
    assert len(store.levels) >= 3 and all(len(level) < 2 for level in store.levels)
    store.close()


def test_fingerprints(docs):
    texts = texts_of(docs)
    ids = sorted(texts)
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    prints, errors = {}, []
    for i, following in zip(ids, ids[1:] + ids[:1]):
        r, t, n = got[i], texts[i], texts[following]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"] and len(r["fingerprint"]) == fingerprint.BINS
        a, b = shingle_set(t), shingle_set(edited)
        if len(a) >= 20:
            errors.append(r["near_edited"] - len(a & b) / len(a | b))
        assert r["near_edited"] == 1 or t != edited
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


def test_fingerprints_odd_rows(odd):
    rows = fingerprint.fingerprints(odd)
    assert rows.count() == odd.count() and fingerprint.fingerprints(odd.where("false")).count() == 0
    assert fingerprint.fingerprints(odd.where("doc_id = 99")).first()["near_next"] == 1


@pytest.mark.parametrize("group", [8_192, 6])
def test_packing(odd, group, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", group)
    monkeypatch.setattr(packing, "FAN", 2)
    tokenizer, limit = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 64
    rows = packing.pack(odd, limit).collect()
    pieces, total = Counter(), 0
    for r in odd.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        cuts = [0, *range(len(ids) % limit or limit, len(ids) + 1, limit)]
        pieces.update((r["doc_id"], k, low, high - low, zlib.crc32(ids[low:high].tobytes())) for k, (low, high) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    assert len(sequences) <= 1.1 * total / limit + 2
    assert packing.pack(odd.where("false")).count() == 0


def test_ids_of_unusual_texts():
    from tessera.llm.tokens import encode_all, vocabulary_path

    texts = ["", None, " " * 1_100_000 + "x", "a<|endoftext|>b", "\n\n  \t x\u00a0\u2003y \r\n", "it's I'LL 12\u00b2\u0663 \U0001f600\u0301 \u4e2d\u6587", "<|endoftext|><|endoftext"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(encode_all(texts, vocabulary_path())) == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_token_counts(odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    lengths = sorted(len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.collect())
    table = tokencount.token_counts(odd)
    for r in table.collect():
        at = r["n_tokens"]
        assert r["n_docs"] == lengths.count(at) and r["docs_at_least"] == sum(n >= at for n in lengths) and r["tokens_at_least"] == sum(n for n in lengths if n >= at)
        assert r["truncated_tokens"] == sum(min(n, at) for n in lengths) and r["all_tokens"] == sum(lengths)
    got = {r["share"]: r["n_tokens"] for r in tokencount.length_quantiles(table, [0.25, 0.9]).collect()}
    assert got == {s: lengths[math.ceil(s * len(lengths)) - 1] for s in (0.25, 0.9)}
    assert tokencount.token_counts(odd.where("false")).count() == 0


def test_mixing(docs):
    documents = docs.select("doc_id", "text", "source").toPandas()  # noqa: F841 - read by duckdb
    want = {r[0]: r[1:] for r in duckdb.sql(ORACLE_SQL["op5_mixing"]).fetchall()}
    plan = mixing.mix_plan(docs).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], pytest.approx(r["target"]), r["taken"]) for r in plan} == want
    sums = {r["source"]: (r["target"], sum(x["taken"] for x in plan if x["source"] == r["source"])) for r in plan}
    assert all(abs(t - s) <= 0.5 for t, s in sums.values()) and all(r["taken"] <= 2 * r["size"] for r in plan)
    due = [r["position"] for r in plan if r["position"] is not None]
    assert due == sorted(due) and 0 <= due[0] and due[-1] <= 1


def test_mixing_schedules_differ(spark):
    """Sources with different schedules: the mix of early positions is not that of late ones, and every position inverts its own source's demand."""
    rows = [(i, " ".join(["w"] * (3 + i % 5)), "abc"[i % 3]) for i in range(600)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan, tilt = [r for r in mixing.mix_plan(frame).collect() if r["taken"] > 0], dict(zip("abc", mixing.TILTS))
    for r in plan:
        t, k = r["position"], tilt[r["source"]]
        assert r["tilt"] == k and r["target"] * ((1 - k) * t + k * t * t) == pytest.approx(r["place"], abs=1e-6)
    mixed = [r["source"] for r in mixing.mixed_documents(frame).collect()]
    third = len(mixed) // 3
    early, late = Counter(mixed[:third]), Counter(mixed[-third:])
    assert late["a"] > 1.2 * early["a"] and early["b"] > 1.2 * late["b"]
    ends = mixing.mix_plan(frame, tilts=(1.0, -1.0, 0.0)).where("taken > 0").collect()
    assert all(0 <= r["position"] <= 1 for r in ends) and [r["position"] for r in ends] == sorted(r["position"] for r in ends)


def test_mixed_documents(odd):
    mixed, taken = mixing.mixed_documents(odd), sum(r["taken"] for r in mixing.mix_plan(odd).collect())
    assert mixed.columns == odd.columns
    assert sum(len(WORD.findall(r["text"])) for r in mixed.collect()) == taken
    assert mixing.mixed_documents(odd.where("false")).count() == 0 and mixing.mix_plan(odd.select("doc_id", "source", "text").where("doc_id = 99")).first()["taken"] == 0


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.score_documents(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in got)
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.93 * len(got)


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(50, 101)] + [(None, 1, None), (51, None, 1), (52, 7, 1)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.where("quality = 1"), labels.where("false")):
        rows = quality.score_documents(odd, marks).collect()
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert quality.accept(odd, labels).columns == odd.columns and quality.score_documents(odd.where("false"), labels).count() == 0


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double, rank int")


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "SEGMENT", 700)
    monkeypatch.setattr(ann, "RERANK_LEAST", 300)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rng = np.random.default_rng(3)
    data = rng.normal(size=(2_000, 16)).astype("f4")
    data[500:1_100] = data[500]  # a vector that is very common
    rows = [(i, v.tolist(), 0, 0.0, 1) for i, v in enumerate(data)]
    odd = [(None, [1.0] * 16, 0, 0.0, 1), (5_000, None, 0, 0.0, 1), (5_100, [0.0] * 16, 0, 0.0, 1), (5_200, [float("nan")] * 16, 0, 0.0, 1), (5_300, [1.0, None] * 8, 0, 0.0, 1), (5_400, [1.0] * 3, 0, 0.0, 1), (0, rows[0][1], 0, 0.0, 1)]
    frame = vectors_frame(spark, rows + odd)
    hits = total = 0
    for rerank in (0.1, 1.0):
        got = defaultdict(list)
        for r in ann.nearest(frame, "vec_id % 100 = 0", rerank=rerank).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert set(got) == set(range(0, 2_000, 100))
        for q, found in got.items():
            gap = np.sqrt(((data.astype("f8") - data[q].astype("f8")) ** 2).sum(1))
            gap[q] = np.inf
            want = np.lexsort((np.arange(len(gap)), gap))[:10]
            assert all(abs(gap[v] - s) < 1e-12 for v, s in found)
            if rerank == 1.0:
                assert [v for v, _ in found] == want.tolist()
            else:
                hits, total = hits + len({v for v, _ in found} & set(want.tolist())), total + 10
    assert hits >= 0.9 * total
    few = ann.nearest(vectors_frame(spark, rows[:4]), "vec_id % 100 = 0").collect()
    assert len(few) == 3 and ann.nearest(frame.where("false"), "vec_id % 100 = 0").count() == 0


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ", 300)
    pages = [(i, f"http://h/{i}?q= x", f"<p>é page {i}</p>" * (i + 1)) for i in range(20)] + [(i, None if i == 33 else "u", "<same>\r\n\r\nWARC/1.1") for i in range(30, 40)]
    pages += [(50, "a", None), (51, "b", ""), (60, "long", "z" * 300_000), (None, "n", "<same>\r\n\r\nWARC/1.1"), (None, "m", "only null ids")]
    frame = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, offset int").repartition(3)
    rows = warc.archive_round_trip(frame).collect()
    largest = {}
    for i, _, h in pages:
        largest[h or ""] = max(largest.get(h or "", -1), -1 if i is None else i)
    want = Counter()
    for i, _, h in pages:
        data, top = (h or "").encode(), largest[h or ""]
        first = i == top or top < 0
        want[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first else top)] += 1
    assert Counter(tuple(r) for r in rows) == want
    assert warc.archive_round_trip(frame.where("false")).count() == 0


def test_warc_selected_ranges(spark):
    from tessera.llm.staging import Scratch

    scratch = Scratch(spark, "warc-test")
    frame = spark.createDataFrame([(i, f"u{i}", f"page {i} " * 50) for i in range(200)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_archives(frame, scratch)
    few = index.where("page_id % 50 = 7")
    assert warc.read_ranges(index).count() == 1
    assert {(r["page_id"], r["url"], r["payload"]) for r in warc.read_archives(few, scratch).collect()} == {(i, f"u{i}", f"page {i} " * 50) for i in range(7, 200, 50)}


def brute_base(text):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark):
    rng, rows = random.Random(5), []
    hexa = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    for i in range(150):
        key = "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
        rows.append((i, f"é {prose(rng, 30)} {['password=', 'API_KEY: ', 'Token = \"'][i % 3]}{hexa(18)} and {hexa(40)}; {key} {prose(rng, 5)}", 0))
    rows += [(1_000, None, 0), (1_001, "", 0), (1_002, "password: token: abcdef secret=abc api-key=1234567 AKIAAKIA12 " + "0" * 23, 0), (1_003, f"bare {hexa(20)} here", 0), (1_003, "again", 0), (None, "token=abcdefgh", 0), (1_004, "x " * 100_000 + "passwd=123456", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secrets.find_secrets(frame).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got if r["doc_id"] != 1_003}
    for i, text, _ in rows:
        if i == 1_003:
            continue
        base = brute_base(text or "")
        own = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in base)
        r = by_id[i]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r["base_sha256"] == hashlib.sha256(own.encode()).hexdigest() and r["spans"] == own
    assert {r["spans"].split(":", 1)[-1] for r in got if r["doc_id"] == 1_003} == {"5:25", ""}
    assert secrets.find_secrets(frame.where("false")).count() == 0


def test_secrets_of_few_documents(spark):
    """The fit sees every labelled value and every ordinary word of a table, however few documents hold them."""
    rng = random.Random(11)
    key = lambda: "AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16))
    rows = spark.range(40_000).select("id", F.concat(F.lit("some ordinary words of document "), F.col("id").cast("string")).alias("text"))
    keys = [key() for _ in range(6)]
    few = spark.createDataFrame([(50_000 + i, f"the key is {k} here") for i, k in enumerate(keys)], "id long, text string")
    docs = rows.union(few).withColumnRenamed("id", "doc_id").repartition(4, "doc_id")
    grammar = secrets.fit(docs)
    want = secrets.infer(sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest()))
    assert grammar.kinds == {"access": want}
    assert grammar.ordinary.pairs["rd"] == 80_000 and grammar.ordinary.pairs["oc"] == 40_000 and "ke" not in grammar.ordinary.pairs
    assert grammar.ordinary.firsts["d"] == sum(n for pair, n in grammar.ordinary.pairs.items() if pair[0] == "d")
    one = secrets.fit(docs, fit_values=2)
    assert one.kinds == {"access": secrets.infer(sorted(keys, key=lambda k: hashlib.md5(k.encode()).hexdigest())[:2])}


def test_inferred_automaton_generalises():
    rng = random.Random(1)
    automaton = secrets.infer(["K-" + "".join(rng.choice("01") for _ in range(rng.randrange(6, 12))) for _ in range(400)])
    assert len(automaton.moves) < 40
    assert automaton.log_likelihood("K-0110101") > automaton.log_likelihood("0110101K-") + 10


def test_token_counts_at_any_limit(spark, odd):
    table = tokencount.token_counts(odd)
    lengths = [len(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(r["text"] or "", add_special_tokens=False).ids) for r in odd.select("text").collect()]
    limits = [0, 1, 7, 33, 100, 5_000, max(lengths), max(lengths) + 1, 10**9]
    got = {r["context"]: tuple(r)[1:] for r in tokencount.at_limits(table, limits).collect()}
    assert got == {c: (sum(n > c for n in lengths), sum(min(n, c) for n in lengths), sum(max(0, n - c) for n in lengths)) for c in limits}


def test_secret_candidates_of_a_text_with_very_many_spans():
    import time

    def text(n):
        return " ".join(f"password={'a' * 6}{k} token abcdef{k:08d}x" for k in range(n))

    t = text(300)
    spans = secrets.base_spans(t)
    got = list(secrets.candidates(t, spans))
    want = [(m.start(), m.end(), m[0]) for m in secrets.CANDIDATE.finditer(t) if any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and not any(s[0] < m.end() and m.start() < s[1] for s in spans)]
    assert got == want and len(got) == 300
    t = text(20_000)
    spans, start = secrets.base_spans(t), time.process_time()
    assert len(list(secrets.candidates(t, spans))) == 20_000 and time.process_time() - start < 2


def test_archives_are_read_back_by_many_tasks(spark):
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("page "), F.col("id")).alias("html"))
    scratch = warc.Scratch(spark, "test")
    found = warc.read_archives(warc.write_archives(pages.repartition(9), scratch), scratch)
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1 and found.count() == 400


def test_quality_learns_from_all_of_a_long_text(monkeypatch):
    seen = []
    import zstandard

    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, pieces, **_: seen.extend(pieces) or (_ for _ in ()).throw(zstandard.ZstdError()))
    quality._dictionary(["a" * 200_000 + "the very end"])
    assert len(seen) == quality.PIECES and len(set(map(len, seen))) <= 2


def test_repeated_values_of_sorted_runs():
    rng = np.random.default_rng(1)
    runs = [np.sort(rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2) + np.uint64(k % 2)) for k in range(3)]
    runs += [runs[0][::3].copy(), np.array([0, 0, (1 << 64) - 1], np.uint64), np.array([(1 << 64) - 1], np.uint64)]
    keys, counts = jaccard._repeated(runs)
    want = {k: n for k, n in Counter(np.concatenate(runs).tolist()).items() if n > 1}
    assert dict(zip(keys.tolist(), counts.tolist())) == want and len(keys) == len(want)
