"""One document of each group stays, also where ids are missing or shared."""

from test_text_operators import docs, prose

from voltrail.llm import jaccard, sieve


def test_groups_without_or_with_one_id_keep_one(spark):
    def near(seed, k):
        words = prose(seed, 150).split()
        words[k] = "other"
        return " ".join(words)

    rows = [(None, near(1, k)) for k in (3, 40, 79)]  # no ids at all
    rows += [(7, near(2, k)) for k in (3, 40)]  # one id for two texts
    rows += [(None, near(3, 5)), (9, near(3, 60)), (8, near(3, 70))]  # an id goes before none
    rows += [(None, near(4, 1))] * 2 + [(11, prose(5, 60)), (None, None), (12, "")]
    table = docs(spark, rows)
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each_group(table).collect()]
    assert len(kept) == len(set(kept)) and set(kept) <= set(rows)
    groups = [{r[1] for r in rows[a:b]} for a, b in ((0, 3), (3, 5), (5, 8), (8, 10))]
    for group in groups:
        assert sum(text in group for _, text in kept) == 1
    assert {d for d, t in kept if t in groups[2]} == {8}
    assert {(11, rows[10][1]), (None, None), (12, "")} <= set(kept) and len(kept) == 7
    assert len(sieve._MADE) >= 0 and sieve.release() is None and not sieve._MADE
