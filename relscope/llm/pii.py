"""Personal data: four base patterns, and spans that a semi-Markov CRF adds.

The CRF scores whole candidate segments (digits, grouping, check sums, separators, borders,
words before), and its dynamic programme chooses boundaries and types jointly among
segments of at most ``LONGEST`` tokens, however many characters these have.  It looks at
islands: digits, @ and written-out (at), outside what the base patterns found, with
``LONGEST`` tokens on either side.  It is trained on the driver, in a few seconds, on
templates of its own (:func:`examples`), never on the documents.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runtime

KINDS = ("email", "ip", "card", "phone")
#: Tokens of a segment at most, and those whose segments are scored at once.
LONGEST, STEP = 20, 256
#: Templates the CRF is trained on, passes over them, and the margin a span must win by.
EXAMPLES, EPOCHS, MARGIN = 160, 12, 1.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A run of digits that fails from its start fails from every other place.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """Whether the number is at most 255, however many zeros lead it."""
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then by kind as listed."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        # The leftmost start is that of the run of local characters before the @.
        start = done + len(text[done:at].rstrip(_LOCAL))
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(_octet(p) for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# The semi-Markov CRF.

_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|[^A-Za-z0-9\s]")
_TRIGGER = re.compile(r"[0-9]+|@|[(\[](?:at|AT)[)\]]")
_AT = re.compile(r"[A-Za-z0-9._+-]++ ?(?:@|[(\[](?:at|AT)[)\]]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[A-Za-z0-9-]++)++")
_OCTETS = re.compile(r"[0-9]{1,3}(?: ?(?:\.|[(\[](?:dot|DOT)[)\]]) ?[0-9]{1,3}){3}")
#: Words that announce a kind; fixed values of the features.
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server"), "card": ("card", "visa", "pay"), "phone": ("tel", "phone", "call", "fax")}
GROUPINGS = ("3-3-4", "4-4-4-4", "4-6-5", "3-4", "2-4-4", "3-3-3")
_BUCKETS = (6, 9, 10, 12, 13, 15, 16, 19)
N_FEATURES = 1 + len(_BUCKETS) + 1 + 14 + len(GROUPINGS) + len(CUES)


def features(text: str, start: int, end: int) -> np.ndarray:
    """Of the whole span text[start:end] in its place."""
    span, f = text[start:end], np.zeros(N_FEATURES)
    digits = _digits(span)
    f[0] = 1
    f[1 + sum(len(digits) > b for b in _BUCKETS)] = 1
    at = 2 + len(_BUCKETS)
    runs = re.findall("[0-9]+", span)
    inner = set(span) - set("0123456789")
    before, after = text[start - 1 : start], text[end : end + 1]
    flags = (
        13 <= len(digits) <= 19 and luhn(digits),
        span[:1] == "+",
        span[:1] == "(",
        bool(_AT.fullmatch(span)),
        bool(_OCTETS.fullmatch(span)) and all(_octet(r) for r in runs),
        inner <= set(" .-()+"),
        len(runs) == 1 and span.isdigit(),
        len(inner & set(" .-")) > 1,
        before.isalnum(),
        after.isalnum(),
        not (span[:1].isalnum() or span[:1] in "+("),
        not span[-1:].isalnum(),
        any(c.isalpha() for c in span),
        bool(inner - set(" .-()+@[]_%") - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )
    f[at : at + 14] = flags
    grouping = "-".join(str(len(r)) for r in runs)
    f[at + 14 : at + 14 + len(GROUPINGS)] = [grouping.endswith(g) for g in GROUPINGS]
    lead = text[max(0, start - 16) : start].lower()
    f[at + 14 + len(GROUPINGS) :] = [any(w in lead for w in words) for words in CUES.values()]
    return f


_NUMERIC = re.compile(r"[0-9+(](?:[0-9 .()+\[\]-]|dot|DOT)*[0-9]")


def _candidate(span: str) -> bool:
    """Whether the dynamic programme takes a segment for an entity at all: written like an address, or of 7 to 19 digits."""
    if span[0].isalpha() or "@" in span:
        return bool(_AT.fullmatch(span))
    return bool(_NUMERIC.fullmatch(span)) and (7 <= len(_digits(span)) <= 19 or bool(_OCTETS.fullmatch(span)))


def _segments(text: str, edges: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Candidates as numbers of edges, by end, those that end after edge ``low`` and up to edge ``high``."""
    begins = [text[e].isascii() and (text[e].isalnum() or text[e] in "+(._-") for e in edges[:-1]]
    return [(i, j) for j in range(low + 1, high + 1) if text[edges[j] - 1].isascii() and (text[edges[j] - 1].isalnum() or text[edges[j] - 1] == "-") for i in range(max(0, j - LONGEST), j) if begins[i] and _candidate(text[edges[i] : edges[j]])]


def _scored(text: str, edges: list[int], spans: list[tuple[int, int]]) -> np.ndarray:
    return np.array([features(text, edges[i], edges[j]) for i, j in spans]).reshape(-1, N_FEATURES)


class Lattice:
    """Segments of a short text, for training: single tokens for no entity, up to ``LONGEST`` tokens for one."""

    def __init__(self, text: str):
        self.edges = [m.start() for m in _TOKEN.finditer(text)] + [len(text)]
        self.n = len(self.edges) - 1
        self.spans = _segments(text, self.edges, 0, self.n)
        self.phi = _scored(text, self.edges, self.spans)

    def marginals(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each span and kind."""
        score = self.phi @ weights
        prefix, suffix = np.zeros(self.n + 1), np.zeros(self.n + 1)
        ends, begins = {}, {}
        for s, (i, j) in enumerate(self.spans):
            ends.setdefault(j, []).append(s)
            begins.setdefault(i, []).append(s)
        for j in range(1, self.n + 1):
            prefix[j] = _log_sum([prefix[j - 1], *(x for s in ends.get(j, ()) for x in (prefix[self.spans[s][0]] + score[s]).tolist())])
        for i in range(self.n - 1, -1, -1):
            suffix[i] = _log_sum([suffix[i + 1], *(x for s in begins.get(i, ()) for x in (suffix[self.spans[s][1]] + score[s]).tolist())])
        i, j = np.array(self.spans).reshape(-1, 2).T
        return np.exp(score + (prefix[i] + suffix[j] - prefix[-1])[:, None])


def best(text: str, start: int, end: int, weights: np.ndarray, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """The best segmentation's entities in a stretch; each costs ``margin``, so weak ones don't displace a strong one.

    A few numbers are kept per token; candidates are scored ``STEP`` tokens at a time.
    """
    edges = [m.start() for m in _TOKEN.finditer(text, start, end)] + [end]
    n = len(edges) - 1
    prefix, back, kind = np.zeros(n + 1), np.full(n + 1, -1, np.int64), np.zeros(n + 1, np.int8)
    for low in range(0, n, STEP):
        high = min(n, low + STEP)
        spans = _segments(text, edges[max(0, low - LONGEST) : high + 1], min(low, LONGEST), high - max(0, low - LONGEST))
        spans = [(i + max(0, low - LONGEST), j + max(0, low - LONGEST)) for i, j in spans]
        score = _scored(text, edges, spans) @ weights
        top, which = (score.max(axis=1) - margin).tolist(), score.argmax(axis=1).tolist()
        at = 0
        for j in range(low + 1, high + 1):
            prefix[j] = prefix[j - 1]
            while at < len(spans) and spans[at][1] == j:
                i = spans[at][0]
                if prefix[i] + top[at] > prefix[j]:
                    prefix[j], back[j], kind[j] = prefix[i] + top[at], i, which[at]
                at += 1
    out, j = [], n
    while j:
        if back[j] < 0:
            j -= 1
            continue
        out.append((edges[back[j]], edges[j], KINDS[kind[j]]))
        j = int(back[j])
    return out[::-1]


def _log_sum(ways: list[float]) -> float:
    top = max(ways)
    return top + math.log(sum(math.exp(w - top) for w in ways))


def examples(count: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with entities in many written forms, and with numbers that are none."""
    rng = random.Random(seed)
    d = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))

    def card() -> str:
        n = rng.choice([15, 16, 16, 16])
        body = rng.choice("3456") + d(n - 2)
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        sep = rng.choice([" ", "-", ".", "."])
        sizes = (4, 6, 5) if n == 15 else (4, 4, 4, 4)
        at = [sum(sizes[:k]) for k in range(len(sizes))]
        return sep.join(whole[a : a + s] for a, s in zip(at, sizes, strict=True))

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = rng.choice([("@", "."), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), (" @ ", ".")])
            return f"{word()}{at}{word()}{dot}{rng.choice(['com', 'org', 'net', 'de'])}"
        if kind == "ip":
            dot = rng.choice([".", " . ", "[dot]", "(dot)"])
            return dot.join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            return card()
        area, mid, last = rng.randint(201, 989), d(3), d(4)
        return rng.choice([f"({area}) {mid}-{last}", f"{area}-{mid}-{last}", f"{area}.{mid}.{last}", f"+{rng.randint(1, 99)} {area} {mid} {last}", f"({area}) {mid} {last}"])

    def other() -> str:
        return rng.choice([f"20{d(2)}-{rng.randint(10, 12)}-{d(2)}", f"{d(2)}:{d(2)}:{d(2)}", f"{d(1)}.{d(1)}.{d(2)}", f"#{d(8)}", f"{d(16)}", f"{d(3)},{d(3)},{d(3)}", f"{d(9)}", f"{d(13)}", f"{d(4)}-{d(4)}", f"{d(2)}/{d(2)}/{d(4)}", "".join(rng.choices("0123456789abcdef", k=16)), f"{d(3)} {d(3)}", f"{d(4)} {d(4)} {d(4)}", f"${d(4)}.{d(2)}", f"{word()}{d(8)}", f"{d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)}", f"@{word()}{d(4)}", f"{d(10)}", f"{d(3)}.{d(3)}.{d(3)}.{d(3)}.{d(3)}"])

    out = []
    for _ in range(count):
        text, spans = word(), []
        for _ in range(rng.randint(1, 2)):
            text += " " + (rng.choice([*sum(CUES.values(), ()), word(), word()]) + rng.choice([" ", ": "]))
            if rng.random() < 0.5:
                kind = rng.choice(KINDS)
                spans.append((len(text), len(text := text + entity(kind)), kind))
            else:
                text += other()
            text += rng.choice([" ", ". ", ", "]) + word()
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(count: int = EXAMPLES, epochs: int = EPOCHS) -> np.ndarray:
    """Weights by feature and kind: conditional likelihood, AdaGrad, a small penalty."""
    data = []
    for text, spans in examples(count):
        lattice = Lattice(text)
        gold = np.zeros((len(lattice.spans), len(KINDS)))
        place = {(lattice.edges[i], lattice.edges[j]): s for s, (i, j) in enumerate(lattice.spans)}
        for start, end, kind in spans:
            gold[place[start, end], KINDS.index(kind)] = 1
        if len(lattice.spans):
            data.append((lattice, lattice.phi.T @ gold))
    weights, seen = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-6)
    for _ in range(epochs):
        for lattice, gold in data:
            step = gold - lattice.phi.T @ lattice.marginals(weights) - 1e-3 * weights
            seen += step * step
            weights += 0.5 * step / np.sqrt(seen)
    return weights


def islands(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Stretches for the CRF: triggers with ``LONGEST`` tokens on either side, outside the taken spans."""
    at, end, mirror = 0, len(text), None
    for start, stop in [*((s, e) for s, e, _ in sorted(taken)), (end, end)]:
        if at < start:
            lo = hi = None
            for m in _TRIGGER.finditer(text, at, start):
                if hi is None or m.start() > hi:
                    mirror = text[::-1] if mirror is None else mirror
                    begin = end - max((t.end() for t in islice(_TOKEN.finditer(mirror, end - m.start(), end - at), LONGEST)), default=end - m.start())
                    if hi is not None and begin > hi:
                        yield lo, hi
                        lo = None
                    lo = begin if lo is None else lo
                hi = max((t.end() for t in islice(_TOKEN.finditer(text, m.end(), start), LONGEST)), default=m.end())
            if lo is not None:
                yield lo, hi
        at = max(at, stop)


_SIGN = re.compile(r"@|[(\[](?:at|AT)[)\]]")


def added_spans(text: str, base: list[tuple[int, int, str]], weights: np.ndarray) -> list[tuple[int, int, str]]:
    out = []
    for start, end in islands(text, base):
        stretch = text[start:end]
        # Fewer digits or runs of them can make no candidate.
        if sum(map(stretch.count, "0123456789")) >= 7 or _SIGN.search(stretch) or len(re.findall("[0-9]+", stretch)) >= 4:
            out += best(text, start, end, weights)
    return out


def find(text: str, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and all spans, each by start and then by kind as listed."""
    base = base_spans(text)
    return base, sorted(base + added_spans(text, base, weights), key=lambda s: (s[0], KINDS.index(s[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])
FOUND_DDL = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"


def personal_data(docs: DataFrame) -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, for every row.

    A null text counts as empty and has no spans; a null doc_id stays null; repeated rows
    give repeated results; an empty table gives none.  Columns besides doc_id and text are
    not read.
    """
    runtime.tune(docs.sparkSession)
    weights = trained()

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for doc_id, text in rows:
            base, spans = find(text, weights)
            counts = [sum(k == kind for _, _, k in base) for kind in KINDS]
            yield doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)

    return runtime.with_text(docs).mapInArrow(runtime.by_rows(run, FOUND), FOUND_DDL)


def masked_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or stretch of overlapping spans, as its first kind in brackets."""
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, column: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The rows with personal data masked in ``column``, and ``length``, if there is one, counted anew where the text changed."""
    runtime.tune(docs.sparkSession)
    weights, names = trained(), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            old = batch[column].to_pylist()
            new = [t and masked_text(t, find(t, weights)[1]) for t in old]
            columns = [pa.array(new, batch.schema.field(c).type) if c == column else batch[c] for c in names]
            if length in names:
                i = names.index(length)
                columns[i] = pa.array([n if a == b else len(b) for n, a, b in zip(batch[length].to_pylist(), old, new, strict=True)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(runtime.read(spark, sf_dir, "documents")).select("doc_id", *(F.col(f"n_{k}") for k in KINDS), "base_sha256", "spans")
