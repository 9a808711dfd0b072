"""Vocabularies of public tokenizers, loaded once per worker."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@lru_cache(maxsize=4)
def rank_encoding(path: str) -> tiktoken.Encoding:
    """The encoding of a rank file (``.tiktoken``), without special tokens."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable bytes as they are, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def json_tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def special_tokens(path: str) -> dict[str, int]:
    return {t.content: i for i, t in json_tokenizer(path).get_added_tokens_decoder().items()}


@lru_cache(maxsize=4)
def special_pattern(path: str) -> regex.Pattern:
    """Matches a special string, which the library cuts out of texts before it pre-tokenises."""
    return regex.compile("|".join(map(regex.escape, sorted(special_tokens(path), key=len, reverse=True))) or r"(?!)")


@lru_cache(maxsize=4)
def json_as_ranks(path: str) -> tiktoken.Encoding:
    """A ``.json`` byte-level vocabulary as ranks: faster piece by piece, with equal ids.

    Its merges are ranked as its ids are, and every entry is reached by its own merges
    (``tests/llm/test_tokens.py`` holds each entry and random texts against the library),
    so merging by rank makes the same pieces.
    """
    byte_of = {letter: byte for byte, letter in byte_letters().items()}
    special = special_tokens(path)
    ranks = {bytes(byte_of[c] for c in token): i for token, i in json_tokenizer(path).get_vocab().items() if token not in special}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class PieceIds(dict):
    """Ids of pre-tokens, as little-endian unsigned 32-bit integers; forgets all when it holds ``most``."""

    def __init__(self, encoding: tiktoken.Encoding, most: int = 400_000):
        super().__init__()
        self.core, self.most = encoding._core_bpe, most

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.core.encode_single_piece(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()


class PieceCounts(dict):
    """Number of tokens of pre-tokens, by the library of a ``.json`` vocabulary itself."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        self.model, self.most = json_tokenizer(path).model, most
        self.letters = {b: s for b, s in byte_letters().items()}

    def __missing__(self, piece: str) -> int:
        n = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters)))
        if len(piece) <= 64:
            self[piece] = n
        return n

    def trim(self) -> None:
        if len(self) > self.most:
            self.clear()
