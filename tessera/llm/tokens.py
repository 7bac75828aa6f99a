"""Byte-level BPE ids of whole texts. The vocabulary file is a parameter and is read where the task runs."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    """A fast encoder of a byte-level BPE vocabulary file, and its special strings. Merges of such a file, in order, are ranks
    of the tokens they make, so the same greedy merging gives the same ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocabulary = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
    ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items()}
    return tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


@functools.lru_cache(maxsize=2)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_all(texts, path: str) -> Iterator[list[int]]:
    """The ids of each text as the vocabulary's own library gives them without added special tokens: a special string
    that stands in a text counts as one token. None counts as empty."""
    encoder = _encoder(path)
    for text in texts:
        try:
            ids = encoder.encode(text, allowed_special="all") if text else []
        except ValueError:  # the fast encoder's pattern gives up on runs of about a million blanks
            ids = _library(path).encode(text, add_special_tokens=False).ids
        yield ids


__all__ = ["VOCABULARY", "encode_all", "vocabulary_path"]
