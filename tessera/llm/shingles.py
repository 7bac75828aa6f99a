"""Word and shingle hashes of whole texts, computed a batch at a time with numpy inside Spark tasks.

Words are maximal runs outside space, tab, line feed, vertical tab, form feed and carriage return; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

WIDTH = 5
_CHUNK = 1 << 20  # bytes hashed at once; longer words make a longer chunk
SLICE = 3 << 20  # bytes of text whose sets are held at once
_MASK = (1 << 64) - 1
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _splitmix(seed: int, count: int) -> np.ndarray:
    """`count` well mixed 64-bit numbers, the same in every process."""
    out, state = [], seed
    for _ in range(count):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        x = state
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append(x ^ (x >> 31))
    return np.array(out, dtype=np.uint64)


_BYTE = _splitmix(1, 256)
_BYTE[65:91] = _BYTE[97:123]
_STEP = int(_splitmix(2, 1)[0]) | 1
_PLACE = _splitmix(3, WIDTH) | np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power_tables(count: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < count:
        for name, base in (("up", _STEP), ("down", pow(_STEP, -1, 1 << 64))):
            steps = np.full(count, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts of a column and the offsets of each; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, in order, and the offsets of each text's words."""
    if len(data) == 0:
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, dtype=bool)  # a text begins here
    cut[offsets] = True
    starts = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1] | cut[1:-1])))
    ends = np.flatnonzero(inside & np.concatenate((~inside[1:] | cut[1:-1], [True]))) + 1
    hashes = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _CHUNK, side="right")))
        low, high = starts[i], ends[j - 1]
        up, down = _power_tables(max(_CHUNK + 1, int(high - low) + 1))
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[data[low:high]] * up[: high - low], out=sums[1:])
        hashes[i:j] = (sums[ends[i:j] - low] - sums[starts[i:j] - low]) * down[starts[i:j] - low]
        i = j
    return mix(hashes), np.searchsorted(starts, offsets)


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of at most `limit` bytes of text; a longer text is a piece of its own. What a task
    holds beside its input then depends on this limit and on the longest text, not on how many rows a batch has."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(batch.schema.names.index("text"))).fill_null(0).to_numpy(zero_copy_only=False)
        ends, low = np.cumsum(sizes, dtype=np.int64), 0
        while low < batch.num_rows:
            before = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(low, high - low)
            low = high


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its 5-word shingles; with fewer words the one hash of the whole
    sequence; without words nothing."""
    words, at = word_hashes(*text_bytes(column))
    runs = np.empty(0, np.uint64)
    if len(words) >= WIDTH:
        runs = np.zeros(len(words) - WIDTH + 1, np.uint64)
        for k in range(WIDTH):
            runs += words[k : k + len(runs)] * _PLACE[k]
        runs = mix(runs)
    for low, high in zip(at[:-1].tolist(), at[1:].tolist()):
        if high - low >= WIDTH:
            yield np.unique(runs[low : high - WIDTH + 1])
        elif high > low:
            few = words[low:high]
            yield mix((few * _PLACE[: len(few)]).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(few)))
        else:
            yield np.empty(0, np.uint64)
