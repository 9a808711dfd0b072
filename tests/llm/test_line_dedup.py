"""Repeated lines against a plain count over all documents."""

import hashlib
import random
from collections import defaultdict

import pytest

from relscope.llm import line_dedup

SCHEMA = "doc_id long, text string, first long, digest string, n_lines long"
SPACE = " \t\n\x0b\x0c\r"


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACE))


def plain(docs, least=10):
    held = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if doc_id is not None and len(key_of(line)) >= least:
                held[key_of(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc_id is None or len(held[key_of(x)]) < 2 or doc_id == min(held[key_of(x)])]
        out.append((doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def left(spark, docs, **kind):
    table = [(i, t, 7, "x", 1) for i, t in docs]
    return sorted(map(tuple, line_dedup.without_repeats(spark.createDataFrame(table, SCHEMA).repartition(5), **kind).collect()), key=str)


def invented(seed, n=120):
    draw = random.Random(seed)
    shared = [f"This passage {i} is found in many documents  " for i in range(40)] + ["ÄÖÜäöüßéè", "ÄÖÜäöüßéèà", "\tAll rights reserved.", "all RIGHTS reserved.\r"]
    docs = []
    for i in range(n):
        lines = [draw.choice(shared) if draw.random() < 0.4 else f"Line {draw.random()} of its own" for _ in range(draw.randrange(1, 12))]
        docs.append((draw.randrange(10_000), "\n".join(lines + ["Footer that a third of all documents have"] * (i % 3 == 0))))
    docs += [(5, docs[0][1]), (5, "Within the same document\nWithin the same document"), (6, "WITHIN the same document \n\n\n")]
    return docs + [(None, docs[1][1]), (None, "only rows without an id have this line"), (None, "only rows without an id have this line"), (7, None), (8, ""), (9, "\n"), (10, "short\nshort"), (11, "short")]


@pytest.mark.parametrize("kind", [{}, {"segments": 0}, {"few": 0}, {"segments": 0, "few": 0}])
def test_against_a_plain_count(spark, monkeypatch, kind):
    monkeypatch.setattr(line_dedup, "LINES", 200)
    monkeypatch.setattr(line_dedup, "HELD", 50)
    docs = invented(1)
    assert left(spark, docs, **kind) == plain(docs)


def test_suspects_are_few(spark, monkeypatch):
    """Nearly all that is suspected does repeat."""
    docs = [(i, "\n".join(f"unique line {i} {j}" for j in range(100)) + "\na line of two documents" * (i < 2)) for i in range(200)]
    table = spark.createDataFrame([(i, t.encode()) for i, t in docs], "doc_id long, text binary")
    filters, n = line_dedup.twice_seen(table, 10, 20_002)
    assert n == 1
    own = spark.sparkContext.broadcast({r["segment"]: bytes(r["twice"]) for r in filters.collect()})
    found = table.mapInArrow(line_dedup._suspected(own, n, 10), "doc_id long, digest binary").collect()
    repeat = hashlib.sha256(b"a line of two documents").digest()
    assert {r.doc_id for r in found if bytes(r.digest) == repeat} == {0, 1}
    assert len(found) < 100


def test_other_lengths_and_nothing(spark):
    docs = [(1, "ab\nabc\nabcd"), (2, "ab\nabc\nabcd"), (3, "ABC ")]
    assert left(spark, docs, least=3) == plain(docs, 3)
    assert left(spark, []) == []


def test_very_long_text(spark):
    line = "word " * 60_000
    docs = [(1, "\n".join(f"row {i} of many rows" for i in range(60_000))), (2, line), (3, line + "\n" + line), (4, "\n" * 100_000)]
    assert left(spark, docs) == plain(docs)
