"""The filter audit against a direct replay of every order."""

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from voltrail.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def fails(rows, i):
    doc_id, text, _ = rows[i]
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    copy = doc_id is not None and any(r[0] is not None and r[0] < doc_id and (r[1] or "") == t for r in rows)
    return {
        f
        for f, bad in {
            "A": len(w) < 100,
            "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": copy,
        }.items()
        if bad
    }


def replay(rows, labels):
    found = [fails(rows, i) for i in range(len(rows))]
    part = [r[2] or "" for r in rows]
    good = {x[0] for x in labels if x[0] is not None and x[1] == 1}
    toxic = {x[0] for x in labels if x[0] is not None and x[2] == 1}
    out, total = {}, {}
    for p in set(part):
        mine = [i for i in range(len(rows)) if part[i] == p]
        for order in itertools.permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                gone = [i for i in left if f in found[i]]
                left = [i for i in left if f not in found[i]]
                failing = sum(f in found[i] for i in mine)
                out[p, "".join(order), step] = (
                    len(left), len(gone), failing - len(gone), sum(found[i] == {f} for i in mine),
                    sum(rows[i][0] in good for i in gone), sum(rows[i][0] in toxic for i in gone),
                )
                total[p, f] = total.get((p, f), 0) + len(gone)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got(df):
    return {
        (r["part"], r["filter_order"], r["step"]): (
            r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"], r["shapley"]
        )
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    texts = [fresh(120), fresh(20), "a b " * 80, "LOUD " * 130, fresh(150) + " 5%", "", None, " \n ", fresh(40_000)]
    out = [(i, rng.choice(texts), rng.choice(["en", "de", None])) for i in range(60)]
    # Repeated rows, one id with two texts, NULL ids, one text that a third of all rows share.
    out += [(7, texts[2], "en"), (7, texts[2], "en"), (7, texts[1], "de"), (None, texts[1], "en"), (None, None, None)]
    return out + [(100 + i, texts[0], "fr") for i in range(30)]


def test_audit_equals_a_replay(spark, rows):
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 130, 2)] + [(7, 1, None), (7, 0, 1), (None, 1, 1), (8, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "good", "prefix", "row_id", "part", "_text", "filter", "step", "total"):
        docs = docs.withColumn(name, F.lit("x"))
    assert got(filter_audit.audit(docs, spark.createDataFrame(labels, LABELS))) == replay(rows, labels)


def test_empty_tables(spark, rows):
    docs, labels = spark.createDataFrame(rows[:9], SCHEMA), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(docs.limit(0), labels).collect() == []
    assert got(filter_audit.audit(docs, labels)) == replay(rows[:9], [])


def test_tables_are_stored_per_filter(spark, rows):
    kept = filter_audit.store(spark.createDataFrame(rows, SCHEMA))
    assert list(kept.failing) == list("ABCDE")
    for ids in kept.failing.values():
        assert ids.columns == ["row_id"] and ids.count() == ids.distinct().count()
        assert ids.inputFiles()
