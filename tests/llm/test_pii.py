"""Base spans against the patterns themselves, the dynamic programme against all segmentations."""

import itertools
import random
import re

import numpy as np

from relscope.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_ip int"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def fits(kind, text):
    digits = [c for c in text if "0" <= c <= "9"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and pii.luhn("".join(digits))
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    out = [(*m.span(), kind) for kind, p in PATTERNS.items() for m in re.finditer(p, text) if fits(kind, m.group())]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    parts = ["a", "b@", "@", ".", "-", "+", " ", "12", "255", "300", "0", "4111 1111 1111 1111", "+1 (826) 555-4081", "x@y.z", "1.2.3.4", "é", "٣", "(", "_"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12)))
        assert pii.base_spans(text) == plain(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 300_000 + "@", "1" * 300_000, "1." * 100_000, "@" * 50_000, "+" * 200_000, "a.b" * 100_000, "12 345 " * 5_000):
        pii.find(text, pii.trained())


def test_best_is_the_best_of_all_segmentations(monkeypatch):
    weights = pii.trained()
    for step in (256, 3):
        monkeypatch.setattr(pii, "STEP", step)
        for text in ("(201) 555-0199 x", "a (at) b.de", "4222 0831", "10[dot]0[dot]0[dot]5 y"):
            lattice = pii.Lattice(text)
            score = lattice.phi @ weights - pii.MARGIN
            most = 0.0
            for r in range(4):
                for pick in itertools.combinations(range(len(lattice.spans)), r):
                    own = sorted(lattice.spans[s] for s in pick)
                    if all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False)):
                        most = max(most, sum(score[s].max() for s in pick))
            found = pii.best(text, 0, len(text), weights)
            place = {(lattice.edges[i], lattice.edges[j]): s for s, (i, j) in enumerate(lattice.spans)}
            assert np.isclose(most, sum(score[place[a, b], pii.KINDS.index(k)] for a, b, k in found)), text


def test_candidates_are_those_of_all_short_token_runs():
    rng = random.Random(6)
    parts = ["a", "@", ".", "-", "+", " ", "12", "555", "(at)", "[dot]", "é", "(", ")", "_", "\n"]
    for _ in range(300):
        text = "".join(rng.choices(parts, k=rng.randint(1, 25)))
        lattice = pii.Lattice(text)
        want = {(i, j) for i in range(lattice.n) for j in range(i + 1, min(lattice.n, i + pii.LONGEST) + 1) if pii._candidate(text[lattice.edges[i] : lattice.edges[j]])}
        assert set(lattice.spans) == want


def test_long_words_and_digits_are_no_limit():
    weights = pii.trained()
    for n in (5, 39, 42, 300, 5000):
        text = "mail " + "a" * n + " (at) ex (dot) org now"
        assert pii.find(text, weights)[1] == [(5, len(text) - 4, "email")], n
        text = "bob (at) " + "x" * n + " (dot) org"
        assert pii.find(text, weights)[1] == [(0, len(text), "email")], n
    for zeros in (5000, 100_000):
        text = "x " + "0" * zeros + ".1.2.3"
        assert pii.base_spans(text) == [(2, len(text), "ip")] and pii.find(text, weights)[0] == [(2, len(text), "ip")]
        assert pii.base_spans("x " + "1" * zeros + ".1.2.3") == []
    assert [s[2] for s in pii.find("host 10[dot]0[dot]0[dot]5 is up", weights)[1]] == ["ip"]


def test_islands_far_apart_and_long_stretches():
    weights = pii.trained()
    text = " ".join(["call (201) 555-0199 now", *["word"] * 100] * 50)
    assert [k for *_, k in pii.find(text, weights)[1]] == ["phone"] * 50
    pii.find(" ".join(str(k) for k in range(8000)), weights)


def test_model_on_held_out_examples():
    weights, right, found, wanted = pii.trained(), 0, 0, 0
    for text, spans in pii.examples(300, seed=77):
        own = set(pii.best(text, 0, len(text), weights))
        right += len(own & set(spans))
        found += len(own)
        wanted += len(spans)
    assert right / found > 0.9 and right / wanted > 0.9


def test_query_and_masks(spark):
    texts = ["mail a.b@c.org or (312) 555-0142", None, "", "plain 12 words", "+1 (826) 555-4081\n190.137.20.1"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, texts[0], "x", 1), (0, texts[0], "x", 1)], SCHEMA)
    assert sorted(tuple(r) for r in pii.personal_data(docs).where("doc_id = 0").collect())[0][1:] == tuple(pii.personal_data(docs).where("doc_id = 0").collect()[1])[1:]
    got = {r.doc_id: r for r in pii.personal_data(docs).collect()}
    assert got[0].n_email == 1 and got[0].n_phone == 0 and got[0].spans == "email:5:14,phone:18:32"
    assert got[None].spans == got[0].spans and got[1].spans == got[2].spans == got[3].spans == ""
    assert got[4].spans.startswith("phone:0:17,ip:18:30")
    table = spark.createDataFrame([(i, t, "en", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_chars long")
    masked = {r.doc_id: r for r in pii.masked(table).collect()}
    assert masked[0].text == "mail [EMAIL] or [PHONE]" and masked[0].n_chars == len(masked[0].text)
    assert masked[1].text is None and masked[3].text == texts[3]
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
