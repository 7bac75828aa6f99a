"""Secret scan: fixed base patterns, plus spans that a grammar inferred from labelled credentials finds likely.

Base patterns mark credentials by kind. Their values, labelled by kind, make one prefix tree per kind; states whose futures are
statistically compatible (Hoeffding bound on every symbol's and the end's frequency) are merged, in the red-blue order, into a
probabilistic automaton. Every other token of credential shape in every text is then scored: the mean log-likelihood per
symbol under an automaton, less that under a letter-pair model of ordinary tokens. Tokens that gain MARGIN and as much as all
but a twentieth of the kind's own labelled values, less SLACK, become spans `like_<kind>`.

Only the fit's labelled values are bounded: of those of all documents at most `fit_values` different ones per kind, by smallest
hash. Letter pairs of ordinary tokens are counted over all texts. The scan reads every text whole.

Defined cases: null text is empty. Kinds without labelled values add no spans. Repeated rows give repeated results. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm.staging import Scratch

# fixed values: the base patterns by kind, in their order, and the least length of what they must find
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
ORDINARY = "ordinary"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
WORDS = re.compile(r"[A-Za-z0-9+/_=-]{4,}")
HINTS = ("passw", "secret", "token", "api")
ALPHA, MARGIN, SLACK, BLUR = 0.01, 0.5, 0.25, 1e-3

_RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of the base patterns' matches, ordered by start, then kind. A run of hexadecimal digits
    is matched whole, so asking for 24 of them drops the same runs as a later test of length."""
    found = []
    lower = text.lower()
    if any(h in lower for h in HINTS):
        found += [(m.start(), m.end(), 0, m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2, m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, spans: list[tuple[int, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Tokens of credential shape that overlap no base span: both a digit and a letter, in ASCII."""
    at = 0
    for m in CANDIDATE.finditer(text):
        token = m[0]
        if token.isalpha() or not any(c.isdigit() for c in token) or not any(c.isalpha() for c in token):
            continue
        while at < len(spans) and spans[at][1] <= m.start():
            at += 1
        k = at  # spans go by start, so only those that begin before the token's end can overlap it
        while k < len(spans) and spans[k][0] < m.end() and spans[k][1] <= m.start():
            k += 1
        if k == len(spans) or spans[k][0] >= m.end():
            yield m.start(), m.end(), token


@dataclass
class Automaton:
    """States number from 0, the start. moves[q][symbol] = (state, probability); ends[q] = probability to stop."""

    moves: list[dict[str, tuple[int, float]]]
    ends: list[float]
    symbols: int

    def log_likelihood(self, token: str) -> float:
        state, total, even = 0, 0.0, 1.0 / (self.symbols + 1)
        for c in token:
            target, p = self.moves[state].get(c, (state, 0.0)) if state is not None else (None, 0.0)
            total += math.log((1 - BLUR) * p + BLUR * even)
            state = target
        stop = self.ends[state] if state is not None else 0.0
        return total + math.log((1 - BLUR) * stop + BLUR * even)


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """Merge compatible states of the prefix tree of the values."""
    moves: list[dict[str, int]] = [{}]
    uses: list[Counter] = [Counter()]  # how often each symbol leaves a state
    total, final = [0], [0]
    for value in values:
        state = 0
        total[0] += 1
        for c in value:
            uses[state][c] += 1
            if c not in moves[state]:
                moves[state][c] = len(moves)
                moves.append({})
                uses.append(Counter())
                total.append(0)
                final.append(0)
            state = moves[state][c]
            total[state] += 1
        final[state] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(red: int, blue: int) -> bool:
        todo = [(red, blue)]
        while todo:
            q, r = todo.pop()
            if differ(final[q], total[q], final[r], total[r]):
                return False
            for c in uses[q].keys() | uses[r].keys():
                if differ(uses[q][c], total[q], uses[r][c], total[r]):
                    return False
                if c in moves[q] and c in moves[r]:
                    todo.append((moves[q][c], moves[r][c]))
        return True

    def fold(red: int, blue: int) -> None:
        todo = [(red, blue)]
        while todo:
            q, r = todo.pop()
            total[q] += total[r]
            final[q] += final[r]
            uses[q].update(uses[r])
            for c, target in moves[r].items():
                if c in moves[q]:
                    todo.append((moves[q][c], target))
                else:
                    moves[q][c] = target

    red = [0]
    while True:
        fringe = sorted({(q, c) for q in red for c, t in moves[q].items() if t not in set(red)}, key=lambda x: (-total[moves[x[0]][x[1]]], x))
        if not fringe:
            break
        q, c = fringe[0]
        blue = moves[q][c]
        for r in red:
            if compatible(r, blue):
                moves[q][c] = r
                fold(r, blue)
                break
        else:
            red.append(blue)
    number = {q: i for i, q in enumerate(red)}
    symbols = len({c for v in values for c in v})
    return Automaton([{c: (number[t], uses[q][c] / total[q]) for c, t in moves[q].items()} for q in red], [final[q] / total[q] for q in red], symbols)


@dataclass
class Ordinary:
    """Letter pairs of ordinary tokens, smoothed over 256 symbols."""

    pairs: dict[str, int]
    firsts: dict[str, int]

    def log_likelihood(self, token: str) -> float:
        chain = f" {token} "
        return sum(math.log((self.pairs.get(chain[i : i + 2], 0) + 0.05) / (self.firsts.get(chain[i], 0) + 0.05 * 96)) for i in range(len(chain) - 1))


@dataclass
class Grammar:
    kinds: dict[str, Automaton]
    ordinary: Ordinary
    levels: dict[str, float]

    def gain(self, kind: str, token: str) -> float:
        return (self.kinds[kind].log_likelihood(token) - self.ordinary.log_likelihood(token)) / (len(token) + 1)

    def kind_of(self, token: str) -> str | None:
        gains = {kind: self.gain(kind, token) for kind in self.kinds}
        likely = [kind for kind in gains if gains[kind] >= self.levels[kind]]
        return max(likely, key=lambda kind: gains[kind]) if likely else None


def _is_candidate(word: str) -> bool:
    """A word of WORDS that is a token of credential shape."""
    return len(word) >= 12 and not word.isalpha() and any(c.isalpha() for c in word) and any(c.isdigit() for c in word)


def _counts(most: int):
    """Of a task's texts: the `most` labelled values of smallest hash of each kind, and how often each letter pair stands in
    ordinary words. What has itself the shape of a candidate is no example of an ordinary word."""

    def smallest(values: dict[str, str]) -> dict[str, str]:
        return dict(sorted(values.items(), key=lambda x: (x[1], x[0]))[:most])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled: dict[str, dict[str, str]] = {kind: {} for kind in KINDS}
        pairs = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                text = text.as_py() or ""
                rest, at = [], 0
                for start, end, k, value in base_spans(text):
                    rest.append(text[at:start])
                    at = max(at, end)
                    if value not in labelled[KINDS[k]]:
                        labelled[KINDS[k]][value] = hashlib.md5(value.encode()).hexdigest()
                        if len(labelled[KINDS[k]]) > 8 * most:
                            labelled[KINDS[k]] = smallest(labelled[KINDS[k]])
                words = [word for part in [*rest, text[at:]] for word in WORDS.findall(part) if not _is_candidate(word)]
                if words:
                    chain = np.frombuffer(f" {' '.join(words)} ".encode(), np.uint8).astype(np.uint16)
                    found, times = np.unique((chain[:-1] << 8) | chain[1:], return_counts=True)
                    pairs[found] += times
        rows = [(kind, value, 1) for kind in KINDS for value in smallest(labelled[kind])]
        rows += [(ORDINARY, chr(code >> 8) + chr(code & 255), int(pairs[code])) for code in np.flatnonzero(pairs).tolist()]
        kinds = (pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["kind", "value", "n"])

    return run


def fit(docs: DataFrame, fit_values: int = 600) -> Grammar:
    scratch = Scratch(docs.sparkSession, "secrets")
    found = docs.select("text").mapInArrow(_counts(fit_values), "kind string, value string, n long")
    found = scratch.keep(found.groupBy("kind", "value").agg(F.sum("n").alias("n")), "counts")
    pairs = {r["value"]: r["n"] for r in found.where(F.col("kind") == ORDINARY).collect()}
    values = {kind: [r["value"] for r in found.where(F.col("kind") == kind).orderBy(F.md5("value"), "value").limit(fit_values).collect()] for kind in KINDS}
    scratch.drop("counts")
    firsts: Counter = Counter()
    for pair, n in pairs.items():
        firsts[pair[0]] += n
    grammar = Grammar({k: infer(values[k]) for k in KINDS if values[k]}, Ordinary(pairs, dict(firsts)), {})
    for kind in grammar.kinds:
        gains = sorted(grammar.gain(kind, v) for v in values[kind])
        grammar.levels[kind] = max(MARGIN, gains[len(gains) // 20] - SLACK)
    return grammar


def scan(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """Base counts and digest and all spans of every row of `docs` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, out_names = shared.value, [c.split()[0] for c in _RESULT.split(", ")]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                base = base_spans(text or "")
                marks = [(s, e, KINDS[k], k) for s, e, k, _ in base]
                added = [(s, e, f"like_{kind}", len(KINDS) + KINDS.index(kind)) for s, e, token in candidates(text or "", base) if (kind := grammar.kind_of(token))]
                counts = Counter(k for _, _, k, _ in base)
                own = ",".join(f"{kind}:{s}:{e}" for s, e, kind, _ in marks)
                every = ",".join(f"{kind}:{s}:{e}" for s, e, kind, _ in sorted(marks + added, key=lambda m: (m[0], m[3])))
                rows.append((doc_id, counts[0], counts[1], counts[2], hashlib.sha256(own.encode()).hexdigest(), every))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=out_names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RESULT)


def find_secrets(docs: DataFrame, fit_values: int = 600) -> DataFrame:
    return scan(docs, fit(docs, fit_values))
