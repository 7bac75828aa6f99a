"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.ann import nearest
from tessera.llm.bpe import round_trip_digests
from tessera.llm.fingerprint import fingerprints
from tessera.llm.fptree import best_documents
from tessera.llm.jaccard import jaccard_components
from tessera.llm.linededup import line_digests
from tessera.llm.mixing import mix_plan
from tessera.llm.packing import pack
from tessera.llm.prefixtrie import trie_nodes
from tessera.llm.quality import score_documents
from tessera.llm.secrets import find_secrets
from tessera.llm.tokencount import token_counts
from tessera.llm.warc import archive_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = sql
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op6_ngram_jaccard")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"))


LINE_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
owners AS (SELECT key, min(doc_id) AS owner FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT k.*, o.owner IS NOT NULL AND o.owner <> k.doc_id AS gone FROM keyed k LEFT JOIN owners o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@_query("op3_line_dedup", LINE_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_digests(_table(spark, sf_dir, "documents"))


@_query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_table(spark, sf_dir, "documents"))


@_query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


@_query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


@_query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS spot
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS turn FROM sized GROUP BY source),
weighed AS (SELECT *, CAST([5, 2, 1][(turn - 1) % 3 + 1] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS ratio,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level FROM levels WHERE ratio >= level ORDER BY ratio, turn LIMIT 1),
goals AS (SELECT source, source_size, CASE WHEN (SELECT level FROM chosen) IS NULL THEN cap ELSE least(cap, (SELECT level FROM chosen) * weight) END AS target FROM levels),
placed AS (
  SELECT s.*, g.source_size, g.target, CAST(round(g.target) AS BIGINT) AS whole,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY spot, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, whole - place)) + greatest(0, least(size, whole - source_size - place)) AS BIGINT) AS taken
FROM placed
"""


@_query("op5_mixing", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@_query("op2_permutation_index")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@_query("op7_warc")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


@_query("op8_secret_scan")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(_table(spark, sf_dir, "documents"))


@_query("op13_bpe")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(_table(spark, sf_dir, "documents"))


TRIE_SQL = """
WITH RECURSIVE bytes AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                    lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bytes),
turns AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], t.turns[c.h + 1:]) AS turns
  FROM convs c JOIN turns t ON t.conv_id = c.conv_id LEFT JOIN turns b ON b.conv_id = c.base),
prefixes AS (
  SELECT conv_id, d AS depth, turns[1:d] AS node, turns[1:d - 1] AS parent, len(turns) AS size,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(turns[d].text, '[^\\x20\\x09-\\x0D]+')) END AS words
  FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, any_value(CASE WHEN depth > 0 THEN parent END) AS parent, count(*) AS n_convs, max(size) AS longest, any_value(words) AS words,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY depth, node),
kids AS (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent),
under AS (
  SELECT node AS below, node AS top, depth FROM nodes
  UNION ALL SELECT u.below, n.parent, n.depth - 1 FROM under u JOIN nodes n ON n.node = u.top WHERE n.depth > 0),
sums AS (
  SELECT u.top, count(*) FILTER (WHERE n.longest = n.depth) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved_tokens
  FROM under u JOIN nodes n ON n.node = u.below GROUP BY u.top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.top = n.node LEFT JOIN kids k ON k.parent = n.node LEFT JOIN nodes p ON p.node = n.parent
"""


@_query("op11_prefix_trie", TRIE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_nodes(_table(spark, sf_dir, "conversations")).drop("ref_conv", "ref_turn")


RANK_SQL = """
WITH rows AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL),
docs AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM rows WHERE len(terms) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM docs),
items AS (
  SELECT row_number() OVER () AS item, item_id,
    unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark),
asked AS (SELECT item, item_id, term, count(*) AS times FROM items GROUP BY item, item_id, term),
tf AS (SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weighed AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(t.docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, totals t GROUP BY term),
scored AS (
  SELECT a.item, a.item_id, d.row, d.doc_id, CAST(sum(a.times * w.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (25 + (75 * d.n * t.docs) // t.terms)))) AS BIGINT) AS score
  FROM asked a JOIN tf f USING (term) JOIN weighed w USING (term) JOIN docs d ON d.row = f.row, totals t GROUP BY a.item, a.item_id, d.row, d.doc_id),
placed AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= 10
"""


@_query("op12_ranked_search", RANK_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
