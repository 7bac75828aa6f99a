"""Byte-pair encoding and decoding of whole texts with a byte-level vocabulary file.

A text is cut at the vocabulary's special strings, the stretches between them into words by the vocabulary's own word rule.
A short word is held as a contiguous array of part boundaries and an array with the merge rank of every two adjacent parts:
the smallest rank is looked up by a scan, its boundary deleted, and the ranks of its neighbours refreshed, until no adjacent
parts merge. The scan is quadratic in the word's length, so words above `SHORT` bytes keep the same boundaries as a linked
list with a heap of ranks; both merge the leftmost pair of least rank first and give the same ids. Decoding joins the
bytes of the ids; bytes that are not UTF-8 become U+FFFD.

Work is one pass without a shuffle: every task reads the vocabulary file where it runs, encodes text after text, and
remembers the ids of at most twice `REMEMBERED` short words.

Defined cases: null text is empty and has no ids. Repeated rows are encoded each. An empty table gives no rows. A special
string in a text is one id. Other columns stay as they are; `encoded` and `decoded` replace a column of the name they write.
Ids outside the vocabulary cannot be decoded and fail the job.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.llm.tokens import vocabulary_path

SHORT, REMEMBERED = 48, 200_000
#: Encoded bytes after which a batch of results leaves the worker.
BATCH = 4 << 20
NONE = 1 << 30
#: Code points from here on get their word class from the vocabulary's library, whose Unicode tables may be older.
SHARED_CLASSES = 0x530


class Merges:
    """Merge ranks of adjacent parts. A part is known by its id; `made[rank]` is the id that a merge makes."""

    def __init__(self, byte_ids: list[int], merges: list[tuple[int, int, int]]):
        self.byte_ids = byte_ids
        self.rank = {left << 20 | right: i for i, (left, right, _) in enumerate(merges)}
        self.made = [made for _, _, made in merges]

    def short(self, word: bytes) -> list[int]:
        """The ids of a word: parts between its boundaries and ranks of adjacent parts as arrays, the minimum found by a scan."""
        get, made = self.rank.get, self.made
        parts = [self.byte_ids[b] for b in word]
        adjacent = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while adjacent:
            least = min(adjacent)
            if least == NONE:
                break
            i = adjacent.index(least)
            parts[i] = made[least]
            del parts[i + 1], adjacent[i]  # the boundary between the two parts goes
            if i < len(adjacent):
                adjacent[i] = get(parts[i] << 20 | parts[i + 1], NONE)
            if i:
                adjacent[i - 1] = get(parts[i - 1] << 20 | parts[i], NONE)
        return parts

    def long(self, word: bytes) -> list[int]:
        """The same ids in n log n steps: the parts as a linked list, the ranks in a heap."""
        n, get = len(word), self.rank.get
        parts = [self.byte_ids[b] for b in word]
        following, before = list(range(1, n + 2)), list(range(-1, n))
        version, heap = [0] * (n + 1), []

        def offer(start: int) -> None:
            if following[start] < n:
                found = get(parts[start] << 20 | parts[following[start]])
                if found is not None:
                    heapq.heappush(heap, (found, start, version[start]))

        for start in range(n - 1):
            offer(start)
        while heap:
            least, start, seen = heapq.heappop(heap)
            if seen != version[start]:
                continue
            gone = following[start]
            parts[start] = self.made[least]
            following[start] = following[gone]
            before[following[gone]] = start
            version[start] += 1
            version[gone] = -1
            offer(start)
            if before[start] >= 0:
                version[before[start]] += 1
                offer(before[start])
        out, start = [], 0
        while start < n:
            out.append(parts[start])
            start = following[start]
        return out


class Vocabulary(dict):
    """Encoder and decoder of one vocabulary file. As a dict it remembers the packed ids of words."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        super().__init__()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}

        def plain(token: str) -> bytes:
            return bytes(letters[c] for c in token)

        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        byte_ids = {letters[t]: i for t, i in vocab.items() if len(t) == 1}
        self.merges = Merges([byte_ids[b] for b in range(256)], [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        self.older: dict[str, bytes] = {}
        self.bytes_of: list[bytes | None] = [None] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.bytes_of[i] = plain(token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.other = regex.compile(f"[^\\x00-\\u{SHARED_CLASSES - 1:04x}]")
        self.library_words = Tokenizer.from_file(path).pre_tokenizer

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            raw = word.encode()
            if len(raw) > SHORT:
                return np.array(self.merges.long(raw), "<u4").tobytes()
            parts = self.merges.short(raw)
            ids = struct.pack(f"<{len(parts)}I", *parts)
        if len(self) >= REMEMBERED:  # the newest words stay at hand
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def _words(self, stretch: str) -> list[str]:
        if self.other.search(stretch):
            return [stretch[a:b] for _, (a, b) in self.library_words.pre_tokenize_str(stretch)]
        return self.words.findall(stretch)

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        stretches = self.cut.split(text) if self.cut else [text]
        out = []
        for k, stretch in enumerate(stretches):
            if k % 2:
                out.append(self.special[stretch].to_bytes(4, "little"))
            elif stretch:
                out.extend(map(self.__getitem__, self._words(stretch)))
        return b"".join(out)

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _mapped(docs: DataFrame, source: str, into: str, kind, convert, batch_bytes: int) -> DataFrame:
    """`docs` with column `into` made from `source`, batch by batch; results leave in pieces of bounded size."""
    names = [c for c in docs.columns if c != into]
    schema = StructType([docs.schema[c] for c in names] + [StructField(into, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(source))
            rest = batch.select(names)
            start, size, made = 0, 0, []
            for i in range(batch.num_rows):
                value, cost = convert(column[i])
                made.append(value)
                size += cost
                if size >= batch_bytes or i == batch.num_rows - 1:
                    array = pa.array(made, pa.list_(pa.int32()) if isinstance(kind, ArrayType) else pa.string())
                    yield pa.RecordBatch.from_arrays([*rest.slice(start, len(made)).columns, array], names=[*names, into])
                    start, size, made = i + 1, 0, []

    return docs.mapInArrow(run, schema)


def encoded(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None, batch_bytes: int = BATCH) -> DataFrame:
    """`docs` with the ids of column `text` as an array of integers."""
    path = path or vocabulary_path()

    def convert(value):
        ids = np.frombuffer(vocabulary(path).encode(value.as_py()), "<i4")
        return ids, ids.nbytes

    return _mapped(docs, text, into, ArrayType(IntegerType()), convert, batch_bytes)


def decoded(docs: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None, batch_bytes: int = BATCH) -> DataFrame:
    """`docs` with the text that the ids of column `ids` stand for; null ids give an empty text."""
    path = path or vocabulary_path()

    def convert(value):
        found = vocabulary(path).decode(value.as_py() or [])
        return found, len(found)

    return _mapped(docs, ids, into, StringType(), convert, batch_bytes)


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of `docs` (doc_id, text): each text is encoded and its ids
    are decoded again."""
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(path)
        for batch in batches:
            doc_id, text = batch.columns
            n, ids_sha, text_sha = [], [], []
            for i in range(batch.num_rows):
                ids = coder.encode(text[i].as_py())
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(coder.decode(np.frombuffer(ids, "<u4").tolist()).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return rows.mapInArrow(run, schema)
