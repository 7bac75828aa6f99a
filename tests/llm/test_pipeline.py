"""The corpus pipeline, stage by stage, against brute force on the smallest tables."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import corpus_pipeline
from tessera.llm import quality
from test_operators import WORD, brute_components, brute_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = ({r["doc_id"]: r["text"] for r in before.collect()}, docs.collect())
        assert name == "packing" or docs.columns == columns

    before, after = seen["quality"]
    scores = {r["doc_id"]: r["score"] for r in quality.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in after} == {i for i in before if scores[i] >= quality.ACCEPTED}

    before, after = seen["line_dedup"]
    want = brute_lines(before)
    assert {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in after} == {i: h for i, (_, _, h) in want.items()}

    before, after = seen["near_duplicates"]
    assert sorted(r["doc_id"] for r in after) == sorted({c for _, c in brute_components(before).values()})

    before, after = seen["mix"]
    size = sum(len(WORD.findall(t)) for t in before.values())
    taken = sum(len(WORD.findall(r["text"])) for r in after)
    assert abs(taken - 1.5 * size) <= len({r["source"] for r in after})
    copies = defaultdict(int)
    for r in after:
        copies[r["doc_id"]] += 1
        assert before[r["doc_id"]].startswith(r["text"].rstrip()) or r["text"] == before[r["doc_id"]]
    assert max(copies.values()) <= 2

    _, packed = seen["packing"]
    fill = defaultdict(int)
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and len(fill) <= 1.02 * sum(fill.values()) / 2048 + 2


def test_run_is_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_duplicates", "mix", "packing"]
