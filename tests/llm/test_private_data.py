"""Personal data: base spans against the plain patterns, the rest by planted cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.llm import private_data as pii

SCHEMA = "doc_id long, text string"
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits or "1"),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def mine(text):
    return [(pii.KINDS[s.kind], s.start, s.end) for s in pii.base_spans(text)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(1)
    pieces = ["a@b.c", "x_y", "@", ".", "-", " ", "+", "(", ")", "4111111111111111", "4111 1111-1111 1111", "1", "25", "256", "é", "٣"]
    for n in range(6_000):
        alphabet = pieces if n % 2 else list("0123456789.-+ ()@ab_%é")
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert mine(text) == plain_spans(text), text


@pytest.mark.parametrize("unit", ["a", "1", "1.", "a@", "a.", "+1", "1 ", "1-", "(at)", " at ", ":", "a@b.", "1 2345 ", "+1 (", "4111 1111 1111 1111 "])
def test_long_runs_take_time_in_proportion(unit):
    start = time.time()
    pii.candidates(unit * (400_000 // len(unit)))
    assert time.time() - start < 8


def luhn_number(rng):
    body = "4" + "".join(rng.choice("0123456789") for _ in range(14))
    return next(body + c for c in "0123456789" if plain_luhn(body + c))


@pytest.fixture(scope="module")
def planted(spark):
    """(doc_id, text, kind, the added span) beside many plain cases."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 8)))
    prose = lambda: " ".join(word() for _ in range(8))
    rows = []
    for i in range(400):
        case = [
            f"{word()}{i}@mail.example.com", f"{rng.randint(1, 223)}.{i % 250}.7.{rng.randint(1, 250)}", luhn_number(rng),
            f"+1 ({rng.randint(200, 900)}) 555-{rng.randint(1000, 9999)}", f'token = "{rng.randrange(16**39):040x}"',
        ][i % 5]
        rows.append((i, f"{prose()} {case} {prose()}", None, None))
    card = [luhn_number(rng), luhn_number(rng)]
    extra = [
        ("email", "write to anna.lind (at) mailbox.example.org", "anna.lind (at) mailbox.example.org"),
        ("email", "contact jo at corner dot net", "jo at corner dot net"),
        ("phone", "call (377) 555-0271", "(377) 555-0271"),
        ("card", f"card {card[0]} {card[1]}", card[0]),
    ]
    for j, (kind, text, span) in enumerate(extra):
        rows.append((1000 + j, f"{prose()} {text} {prose()}", kind, span))
    clean = [
        "born on 2021-03-14 in spring", "invoice 20391 of 2020", "version 10.2.300.4001 is out", "look at this dot and go on",
        "serial 4111111111111112", "at 12:30:45 we left", "pages 1990-2000 and 33",
    ]
    rows += [(2000 + j, f"{prose()} {t} {prose()}", None, None) for j, t in enumerate(clean)]
    return rows


def test_planted_spans_are_added_and_clean_texts_left_alone(spark, planted):
    docs = spark.createDataFrame([r[:2] for r in planted], SCHEMA)
    out = {r["doc_id"]: r for r in pii.scan(docs).collect()}
    for doc_id, text, kind, span in planted:
        base = plain_spans(text)
        want = list(base)
        if kind:
            at = text.index(span)
            want.append((kind, at, at + len(span)))
        r = out[doc_id]
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(told.encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == k for b in base) for k in pii.KINDS]
        got = [tuple(s.split(":")) for s in r["spans"].split(",") if s]
        if kind == "card":  # two numbers side by side are no base card, each alone is one
            assert len(got) == 2 and all(g[0] == "card" for g in got)
        else:
            assert got == [(k, str(a), str(b)) for k, a, b in sorted(want, key=lambda s: (pii.KINDS.index(s[0]), s[1]))], text


def test_odd_rows(spark):
    long = "word " * 60_000 + "last@mail.example.com"
    rows = [(1, None), (2, ""), (3, " \n"), (4, long), (4, long), (None, "a@b.cd"), (5, "😀 a@b.cd"), (6, "no. 7")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("spans", "base", "kind", "start", "votes", "features", "n_email"):
        docs = docs.withColumn(name, F.lit("x"))
    out = pii.scan(docs).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    found = {r["doc_id"]: r["spans"] for r in out}
    at = len(long) - len("last@mail.example.com")
    assert found[4] == f"email:{at}:{len(long)}" and found[None] == "email:0:6" and found[5] == "email:2:8"
    assert found[1] == found[2] == found[3] == found[6] == ""
    assert pii.scan(docs.limit(0)).collect() == []


def test_estimate_finds_the_labelers_that_lie():
    """Votes drawn from known reliabilities; the estimate comes near them."""
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.4
    right = np.array([0.95, 0.93, 0.55, 0.8, 0.75, 0.9, 0.9])
    signs = np.where(rng.random((len(truth), 7)) < right, np.where(truth, 1, -1)[:, None], np.where(truth, -1, 1)[:, None])
    signs[rng.random(signs.shape) < 0.3] = 0
    patterns, counts = np.unique(signs, axis=0, return_counts=True)
    found = pii.estimate(patterns, counts * 100)
    assert abs(found.share - 0.4) < 0.02
    assert np.abs(found.for_true - right).max() < 0.05 and np.abs(1 - found.for_false - right).max() < 0.05


def test_overlapping_candidates_leave_the_most_probable():
    class Fixed:
        def probability(self, kind, found):
            return found[0] / 10

    model = pii.Model({}, Fixed())
    span = lambda a, b, p, base=False: {"kind": 3, "start": a, "end": b, "base": base, "features": [p]}
    spans = [span(0, 9, 6), span(5, 12, 8), span(11, 20, 7), span(12, 15, 6), span(30, 31, 4), span(40, 50, 9, True)]
    assert sorted(model.added(spans)) == [(3, 5, 12), (3, 12, 15)]
