"""Vectorised pre-tokenisation with the pattern that the public byte-level vocabularies share.

The pattern is memoryless at its boundaries and every alternative is a run of one
character class (letters, numbers, other, white space) with an optional leading space, or
one of seven contractions.  So the boundaries of a whole batch of texts follow from run
starts over a class table, without a regex engine: about ten times as fast as ``regex``.
Libraries know different versions of Unicode, so each has a table of its own.
``tests/llm/test_pretoken.py`` holds every code point and random texts against them.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import regex

OTHER, LETTER, NUMBER, WHITE, EDGE = 0, 1, 2, 3, 4

#: The contractions of the pattern, after the apostrophe.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")

_CUT = regex.compile(r"(?<=\S)(?=[ \t\n\r])")


def _joined_by_tokenizers(before: str, points: list[int]) -> np.ndarray:
    """Whether the tokenizers library leaves each point in one pre-token with what is before it."""
    from tokenizers.pre_tokenizers import ByteLevel

    text = "\n".join(f"{before}{chr(p)}" for p in points)
    ends = np.zeros(len(text) + 1, bool)
    ends[[end for _, (_, end) in ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]] = True
    return ~ends[1::3]


def _joined_by_tiktoken(before: str, points: list[int]) -> np.ndarray:
    """The same by tiktoken, with a vocabulary that merges ``before`` with any first byte."""
    import public_tokenizers
    import tiktoken

    first = sorted({chr(p).encode()[:1] for p in points})
    ranks = {bytes([b]): b for b in range(256)} | {before.encode() + b: 256 + k for k, b in enumerate(first)}
    ids = np.array(tiktoken.Encoding("probe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary("\n".join(f"{before}{chr(p)}" for p in points)))
    return ids[np.concatenate([[0], np.flatnonzero(ids == 10) + 1])] >= 256


def asked_classes(points: np.ndarray, library: str) -> np.ndarray:
    """Classes of code points above U+0020, by what a library leaves them together with."""
    joined = {"tokenizers": _joined_by_tokenizers, "tiktoken": _joined_by_tiktoken}[library]
    kinds = [joined(before, points.tolist()) for before in "a1!"]
    return np.select(kinds, [LETTER, NUMBER, OTHER], WHITE).astype(np.uint8)


#: Tables that the driver made, by library.
_MADE: dict[str, np.ndarray] = {}


def table_data(library: str) -> bytes:
    """The table for tasks, which would take seconds to ask the library each."""
    return zlib.compress(class_table(library).tobytes(), 1)


def use(library: str, data: bytes) -> None:
    if library not in _MADE:
        _MADE[library] = np.frombuffer(zlib.decompress(data), np.uint8)


def class_table(library: str = "regex") -> np.ndarray:
    return _MADE[library] if library in _MADE else _class_table(library)


@lru_cache(maxsize=3)
def _class_table(library: str) -> np.ndarray:
    """Class of every code point, as ``regex``, ``tiktoken`` or ``tokenizers`` have it.

    Points on which two versions of Unicode, those of ``regex`` and of Python, disagree are asked of the library itself.
    """
    if library != "regex":
        table = class_table().copy()
        points = np.concatenate([np.arange(33, 0xD800), np.arange(0xE000, 0x110000)])
        known = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(p))[0], WHITE if chr(p).isspace() else OTHER) for p in points.tolist()], np.uint8)
        open_ = points[table[points] != known]
        table[open_] = asked_classes(open_, library)
        return table
    table = np.zeros(0x110000, np.uint8)
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype("<u4")
    everything = points.tobytes().decode("utf-32-le")
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (WHITE, r"\s+")):
        for m in regex.finditer(pattern, everything):
            table[points[m.start() : m.end()]] = kind
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _starts(points: np.ndarray, edges: np.ndarray, library: str = "regex") -> np.ndarray:
    """Mask of pre-token starts; at ``edges`` stands one separator slot after each text."""
    kind = class_table(library)[points]
    kind[edges] = EDGE
    start = np.empty(len(kind), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[edges] = True
    start[edges[:-1] + 1] = True
    # A run of letters, numbers or others takes one blank before it; any other white
    # space before it is a pre-token of its own, split from a longer run.
    words = np.flatnonzero(start & (kind < WHITE))
    words = words[words > 0]
    after = words[kind[words - 1] == WHITE]
    blank = points[after - 1] == 32
    start[after - 1] = True
    start[after[blank]] = False
    quote = np.flatnonzero(start & (points == 39) & (kind == OTHER))
    quote = quote[kind[np.minimum(quote + 1, len(kind) - 1)] == LETTER]
    if len(quote):
        first = points[quote + 1]
        one = quote[np.isin(first, [ord(c) for c in ONE_LETTER])]
        second = points[np.minimum(quote + 2, len(points) - 1)]
        pairs = np.zeros(len(quote), bool)
        for a, b in TWO_LETTERS:
            pairs |= (first == ord(a)) & (second == ord(b))
        for found, width in ((one, 2), (quote[pairs], 3)):
            start[found + 1] = False
            rest = found + width
            start[rest[kind[rest] == LETTER]] = True
    return start


def split_batch(texts: list[str], library: str = "regex") -> tuple[list[str], np.ndarray]:
    """Pre-tokens of all texts in a row, as a library splits them, and the number of each text's pre-tokens."""
    if not any(texts):
        return [], np.zeros(len(texts), np.int64)
    joined = "\n".join(texts) + "\n"
    points = code_points(joined)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    edges = np.cumsum(lengths + 1) - 1
    start = _starts(points, edges, library)
    start[edges] = False
    running = np.concatenate([[0], np.cumsum(start)])
    counts = running[edges] - running[edges - lengths]
    mark = 0x10FFFF
    present = points.max()
    while mark == present or (present > 0xF0000 and (points == mark).any()):
        mark -= 1
    keep = np.ones(len(points), bool)
    keep[edges] = False
    points, start = points[keep], start[keep]
    at = np.flatnonzero(start)
    spread = np.full(len(points) + len(at), mark, "<u4")
    spread[np.arange(len(points)) + np.cumsum(start)] = points
    pieces = spread.tobytes().decode("utf-32-le", "surrogatepass").split(chr(mark))
    return pieces[1:], counts


def boundaries(text: str, library: str = "regex") -> np.ndarray:
    """Starts of the pre-tokens of one text."""
    if not text:
        return np.zeros(0, np.int64)
    return np.flatnonzero(_starts(code_points(text + "\n"), np.array([len(text)]), library)[:-1])


def cuts(text: str, most: int) -> Iterator[str]:
    """The text in parts of about ``most`` characters, cut only where any scan has a boundary.

    Between a character that is not white space and white space every alternative of the
    pattern ends, so parts can be pre-tokenised apart.  A stretch without such a place
    stays whole.
    """
    at = 0
    while len(text) - at > most:
        m = _CUT.search(text, at + most)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def batches(rows: Iterable[tuple[int, str]], most: int = 2_000_000) -> Iterator[tuple[list[int], list[str]]]:
    """Rows of (owner, text) gathered until they hold ``most`` characters."""
    owners, texts, size = [], [], 0
    for owner, text in rows:
        owners.append(owner)
        texts.append(text)
        size += len(text) + 1
        if size >= most:
            yield owners, texts
            owners, texts, size = [], [], 0
    if owners:
        yield owners, texts
