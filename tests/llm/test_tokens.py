"""Token counts and packing against the libraries themselves."""

import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from relscope.llm import packing, token_counts, vocab

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "Hello  world's end\n\n<|endoftext|>x<|endoftext|>",
    None,
    "",
    "a" * 5000,
    "漢字 é \x1f\x85 ½ <|endoftext|",
    "the cat " * 6000,
    "same",
    "same",
    "!!\U00011de0!! x\U00011de0's \u0558\U00012550 9\U00016ff4",
]
ROWS = [(i if i != 6 else 7, t, "ignored") for i, t in enumerate(TEXTS)] + [(None, "no id", "x")]
SCHEMA = "doc_id long, text string, n_tokens string"


def ids_of(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_every_entry_is_reached_by_its_own_merges():
    letters = vocab.byte_letters()
    byte_of = {s: b for b, s in letters.items()}
    model, core = vocab.json_tokenizer(PATH).model, vocab.json_as_ranks(PATH)._core_bpe
    for token, i in vocab.json_tokenizer(PATH).get_vocab().items():
        if token not in vocab.special_tokens(PATH):
            assert core.encode_single_piece(bytes(byte_of[c] for c in token)) == [i]
            assert [t.id for t in model.tokenize(token)] == [i]


def test_random_pieces_merge_alike():
    rng, letters = random.Random(5), vocab.byte_letters()
    model, core = vocab.json_tokenizer(PATH).model, vocab.json_as_ranks(PATH)._core_bpe
    for _ in range(3000):
        piece = bytes(rng.choices(b" etaoinshrdlu\xc3\xa9\xe6-=_09AZ", k=rng.randint(1, 24)))
        assert core.encode_single_piece(piece) == [t.id for t in model.tokenize("".join(letters[b] for b in piece))]


def test_counts(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = sorted(map(tuple, token_counts.token_counts(docs).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), len(ids_of(t))) for i, t, _ in ROWS), key=str)
    assert got == want


def test_counts_of_nothing(spark):
    assert token_counts.token_counts(spark.createDataFrame([], SCHEMA)).collect() == []


def test_packing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    got = packing.pack_documents(docs).collect()
    want = []
    for i, t, _ in ROWS:
        ids = [*ids_of(t), 0]
        first = (len(ids) - 1) % 2048 + 1
        for piece, to in enumerate(range(first, len(ids) + 1, 2048)):
            start = to - 2048 if piece else 0
            own = np.array(ids[start:to], "<u4").tobytes()
            want.append((i, piece, start, to - start, zlib.crc32(own), own))
    assert sorted(((*r[:5], bytes(r[5])) for r in got), key=str) == sorted(want, key=str)
    check_places([(r.length, r.sequence_id, r.offset) for r in got], 2048)


def check_places(places, capacity):
    by = {}
    for length, sequence, offset in places:
        by.setdefault(sequence, []).append((offset, length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expanded(placements):
    return [(p.length, p.sequence + k, p.offset) for p in placements for k in range(p.count)]


def test_plan_places_every_piece_once():
    rng = random.Random(6)
    for _ in range(200):
        capacity = rng.choice([1, 2, 7, 30, 100])
        histogram = {x: rng.randint(0, 9) for x in range(1, capacity + 1)}
        placements = packing.plan(histogram, capacity)
        for x, n in histogram.items():
            ranks = sorted(p.rank + k for p in placements if p.length == x for k in range(p.count))
            assert ranks == list(range(n))
        total = sum(x * n for x, n in histogram.items())
        bins = check_places(expanded(placements), capacity)
        large = sum(n for x, n in histogram.items() if 2 * x > capacity)
        assert max(large, -(-total // capacity)) <= bins <= 1.25 * max(large, total / capacity) + 2


def test_large_items_pair_as_well_as_any_pairing():
    rng = random.Random(8)

    def fewest(items):
        if not items:
            return 0
        rest = items[1:]
        return 1 + min([fewest(rest), *(fewest(rest[:k] + rest[k + 1 :]) for k in range(len(rest)) if items[0] + rest[k] <= 30)])

    for _ in range(60):
        items = [rng.randint(11, 30) for _ in range(rng.randint(1, 7))]
        placements = packing.plan({x: items.count(x) for x in set(items)}, 30)
        assert len({s for _, s, _ in expanded(placements)}) == fewest(items)


def test_sequences_are_as_few_as_best_fit_decreasing_makes():
    rng = random.Random(12)
    for _ in range(150):
        capacity = rng.choice([12, 30, 97])
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(1, 80))), reverse=True)
        gaps: list[int] = []
        for x in items:
            fitting = [g for g in gaps if g >= x]
            if fitting:
                gaps.remove(min(fitting))
                gaps.append(min(fitting) - x)
            else:
                gaps.append(capacity - x)
        placements = packing.plan({x: items.count(x) for x in set(items)}, capacity)
        assert len({s for _, s, _ in expanded(placements)}) <= len(gaps) + (1 if len(gaps) > 9 else 0)


def test_packing_of_nothing(spark):
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA)).collect() == []
