"""Operators of the text package against brute force, on small hand-made rows."""

import collections
import hashlib
import math
import random
import string
import time
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.llm import (
    hashing, html, jaccard, language, language_model, lines, mixing, neighbours, pieces, quality, secrets,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source])."""
    full = [(r[0], r[1], *(r[2:] + (None, None))[:2], len(r[1]) if r[1] else None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """NULLs, empty and long texts, repeated rows, and clashing columns."""
    long = prose(1, 30_000)
    rows = [
        (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (4, "one", None, "s"),
        (5, long, "en", None), (5, long, "en", None), (None, prose(2, 60), "de", "t"), (6, prose(3, 40), "de", "t"),
        (7, "ж " * 50, "ru", "t"), (8, "1234 !!", "en", "t"),
    ]
    clash = docs(spark, rows)
    for name in (
        "size", "copies", "target", "ids", "n_lines", "_words", "failures", "words", "score", "lang_pred", "label",
        "probability", "copy", "set_id", "class_id", "_doc", "_hash", "place", "decoded", "_id",
    ):
        clash = clash.withColumn(name, F.lit("x"))
    return clash


EVERY = {
    "lines": lines.dedup,
    "pieces": pieces.encoded,
    "mixing": mixing.mixed_sizes,
    "jaccard": jaccard.join_counts,
    "language": language.identify,
    "quality": quality.quality,
    "language_model": language_model.score_all,
}


@pytest.mark.parametrize("name", EVERY)
def test_odd_rows_get_one_result_each(spark, odd, name):
    rows = EVERY[name](odd).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in odd.collect())


@pytest.mark.parametrize("name", EVERY)
def test_empty_table(spark, name):
    assert EVERY[name](docs(spark, [])).collect() == []


def test_whole_row_forms_keep_clashing_columns(spark, odd):
    kept = [c for c in odd.columns if c not in {"n_lines"}]
    out = lines.without_repeats(odd)
    assert out.columns == [*kept, "n_lines", "n_removed"] and out.count() == odd.count()
    assert pieces.with_text(pieces.with_ids(odd)).count() == odd.count()
    assert mixing.mix(odd).columns[-1] == "copy"
    # The repeated row is a copy of itself, the others are alone.
    assert jaccard.one_of_each_group(odd).count() == odd.count() - 1
    assert secrets.scan(odd).count() >= 0 and secrets.scan(docs(spark, [])).count() == 0


# --- op 1 ------------------------------------------------------------------


BLANK = " \t\n\x0b\x0c\r"


def brute_lines(rows):
    """Equal to any earlier line with a word, or within one edit of one if both have 20 signs."""

    def near(a, b):
        if a == b:
            return True
        if min(len(a), len(b)) < 20:
            return False
        if abs(len(a) - len(b)) > 1:
            return False
        i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]

    seen, out = [], {}
    for doc_id, text in sorted(rows):
        left = []
        for line in text.split("\n"):
            gone = bool(line.strip(BLANK)) and any(near(line, s) for s in seen)
            seen.append(line)
            if not gone:
                left.append(line)
        out[doc_id] = "\n".join(left)
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(5)
    base = [prose(100 + i, 5)[:24].ljust(24, "z") for i in range(25)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(4):
            line = rng.choice(base)
            for _ in range(rng.randint(0, 2)):
                i = rng.randrange(len(line))
                line = rng.choice([line[:i] + "ß" + line[i:], line[:i] + line[i + 1 :], line[:i] + "q" + line[i + 1 :]])
            text.append(line)
        rows.append((d, "\n".join(text + ["short", f"short {d % 7}", base[0][:19], "\u2003", " \t", "}", ""])))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs(spark, rows)).collect()}
    assert got == brute_lines(rows)


def test_one_edit_variants_meet():
    line = "the quick brown fox jumps over"
    keys, whole = lines.variant_keys(line, [True] * 4)
    for i in (0, 7, len(line) - 1):
        changed, _ = lines.variant_keys(line[:i] + "#" + line[i + 1 :], [True] * 4)
        assert set(keys.tolist()) & set(changed.tolist())
        shorter, self_key = lines.variant_keys(line[:i] + line[i + 1 :], [True] * 4)
        assert set(shorter[self_key].tolist()) & set(keys[~whole].tolist())


# --- op 2 ------------------------------------------------------------------


def test_pieces_equal_the_library(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(3)
    signs = "ab \n\t\r▁éß你🙂Ａ<>s0   theion/=_-́"
    texts = ["", " ", "▁", "<s> </s> <0x0A>", "a" * 800, " " * 90 + "x", prose(4, 200)]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(300)]
    rows = pieces.encoded(docs(spark, list(enumerate(texts)))).collect()
    for r in rows:
        ids = own.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(own.decode(ids).encode()).hexdigest()
    codec = pieces.codec(pieces.default_model())
    for _ in range(500):  # also ids that no text gives
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(32000), 259, 1, 2, 0]) for _ in range(6)]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == own.decode(ids)


def test_long_units_equal_the_library():
    import sentencepiece

    codec = pieces.codec(pieces.default_model())
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    rng = random.Random(7)
    ascii_signs = string.ascii_letters + string.digits + "+/"
    texts = [
        "".join(rng.choices(ascii_signs, k=1_000_000)),
        "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(350_000)),
        "a" * 300_000,
        "the" * 100_000,
        "\x01é🙂" * 2_000,
    ]
    texts += ["".join(rng.choices("abet\n▁的🙂 ", [9, 9, 9, 9, 1, 1, 1, 1, 1], k=rng.randrange(900))) for _ in range(200)]
    began = time.monotonic()
    found = codec.encode(texts)
    assert time.monotonic() - began < 60
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == own.encode(text, add_bos=True, add_eos=True)
    assert max(map(len, codec._cache)) < pieces.LONG_UNIT  # long units are not remembered


# --- op 3 ------------------------------------------------------------------


def test_neighbours_recall_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype("float32")
    x[100:140] = x[50]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(9000, None), (9050, [0.0] * 24), (9100, [math.nan] * 24), (9150, [None] * 24), (9200, [1.0]), (None, [1.0] * 24)]
    found = neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), nearest=64).collect()
    x = x.astype(float)
    norm = np.sqrt((x * x).sum(1))
    hit = 0
    by = collections.defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r["query_id"]].append(r)
    assert sorted(by) == list(range(0, 3000, 50))
    for q, rs in by.items():
        cosine = (x * x[q]).sum(1) / norm / norm[q]
        cosine[q] = -9
        hit += len(set(np.lexsort((np.arange(3000), -cosine))[:5]) & {r["vec_id"] for r in rs})
        assert [r["score"] for r in rs] == pytest.approx([cosine[r["vec_id"]] for r in rs], abs=1e-12)
    assert hit / (5 * len(by)) >= 0.9
    assert [r["vec_id"] for r in by[50]] == [100, 101, 102, 103, 104]


def test_neighbours_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>, extra int, _id int"
    assert neighbours.search(spark.createDataFrame([], schema)).collect() == []
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 1), (1, [1.0, 1.0], 1, 1), (2, [0.0, 1.0], 1, 1)], schema)
    assert [r["vec_id"] for r in neighbours.search(few).orderBy("rank").collect()] == [1, 2]


# --- op 4 ------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / max(sum(weight[s] for s in rest), 1)
        over = [s for s in rest if level * weight[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**full, **{s: level * weight[s] for s in rest}}
        full.update({s: 3.0 * sizes[s] for s in over})


def test_mixing_targets_and_draws(spark):
    rng = random.Random(8)
    rows = []
    for i in range(2500):
        source = rng.choice(["a", "a", "a", "b", "c", None, "d" if i < 40 else "a", "e"])
        rows.append((i, prose(i, rng.randint(0, 12)), "en", source))
    frame = docs(spark, rows)
    got = mixing.mixed_sizes(frame).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    targets = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        source = rows[r["doc_id"]][3]
        assert r["size"] == len(WORD.findall(rows[r["doc_id"]][1])) and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(targets[source]) and r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    for s, t in targets.items():
        assert abs(taken[s] - t) < 0.15 * t
    again = mixing.mixed_sizes(frame.repartition(3)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))
    assert mixing.mix(frame).count() == sum(r["copies"] for r in mixing.with_copies(frame).collect())


# --- op 5 ------------------------------------------------------------------


def brute_groups(rows):
    sets = {}
    for d, text in rows:
        w = WORD.findall(text or "")
        k = min(5, len(w))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    links = collections.Counter()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9:
                links[a] += 1
                links[b] += 1
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (root(d), links[d]) for d in ids}


def test_jaccard_join_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, prose(i, rng.choice([3, 20, 80]))) for i in range(60)]
    for i in range(60, 260):  # copies with a few changed words; long chains and ties
        w = rng.choice(rows)[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = "new"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join_counts(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)


def test_jaccard_join_in_several_chunks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    base = prose(77, 120).split()
    rows = []
    for i in range(90):
        w = list(base)
        w[i % 100 + 5] = f"n{i}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join_counts(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)
    assert [r["doc_id"] for r in jaccard.one_of_each_group(docs(spark, rows)).collect()] == [0]


def test_jaccard_join_of_more_chunks_than_members(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK_SHINGLES", 20)
    rows = []
    for i in range(30):  # clusters of two or three long texts, many chunks each
        w = prose(700 + i, 120).split()
        for k in range(2 + i % 2):
            w[40 + k] = f"n{k}"
            rows.append((3 * i + k, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.join_counts(docs(spark, rows)).collect()}
    assert got == brute_groups(rows)
    starts, cuts = np.array([0, 2, 4]), np.array([0, 2])
    values = np.zeros((4, jaccard.HASHES), dtype="<u2")
    assert len(jaccard.pruned_pairs(values, starts, cuts, jaccard.least_matches(0.8))[0]) == 0


def test_pruning_keeps_pairs_at_the_threshold():
    looks = jaccard.least_matches(0.8)
    assert [n for n, _ in looks] == list(range(16, 97, 16)) and all(m < 0.65 * n for n, m in looks)
    a = np.zeros((2, jaccard.HASHES), dtype="<u2")
    a[1, ::5] = 1  # agrees in 76 of 96 values
    assert jaccard.surviving_pairs(a, None, looks)[0].tolist() == [0]
    a[1, ::2] = 1
    assert jaccard.surviving_pairs(a, None, looks)[0].tolist() == []


# --- op 6 ------------------------------------------------------------------


def _language_rows():
    vowels = {"aa": "aeiou", "bb": "äöüyæ", "cc": "éèêàù"}
    rng = random.Random(4)
    rows, text = [], {}
    for i in range(240):
        lang = rng.choice(list(vowels))
        words = ["".join(rng.choice("bcdlmnrst") + rng.choice(vowels[lang]) for _ in range(3)) for _ in range(40)]
        text[i] = " ".join(words)
        rows.append((i, text[i], lang, "s"))
    return rows


def test_language_on_held_out_documents_and_mixtures(spark):
    rows = _language_rows()
    frame = docs(spark, rows)
    got = {r["doc_id"]: r for r in language.identify(frame).collect()}
    out = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sorted(d for d, r in got.items() if r["held_out"]) == out and len(out) > 30
    assert all(got[i]["lang_pred"] == rows[i][2] and 0 <= got[i]["score"] <= 1 for i in out)
    model = language.Languages.fit(frame)
    one = next(r for r in rows if r[2] == "aa")[1]
    two = next(r for r in rows if r[2] == "bb")[1]
    name, share, chosen, shares = model.mixtures([one + " " + two[: len(two) // 2]])[0]
    assert name == "aa" and set(chosen) == {"aa", "bb"} and sum(shares) == pytest.approx(1)
    assert 0.5 < share < 0.85
    assert model.mixtures(["", "12 ?"]) == [("und", 0.0, [], [])] * 2


def test_language_without_labels(spark):
    rows = language.identify(docs(spark, [(1, "some text"), (2, None)])).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}


# --- op 7 ------------------------------------------------------------------


def test_quality_measures_equal_brute_force(spark):
    rng = random.Random(6)
    texts = [None, "", "a b", "x\n\nx\n x \nx", "De " * 40, "### a && b " * 9, "A! " * 30]
    for _ in range(60):
        w = [rng.choice("ab#é") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))]
        texts.append("".join(x + rng.choice(" \n\t") for x in w))
    got = {r["doc_id"]: r for r in quality.quality(docs(spark, list(enumerate(texts)))).collect()}
    for d, text in enumerate(texts):
        text = text or ""
        w = WORD.findall(text)
        places = collections.defaultdict(list)
        for i in range(len(w) - 4):
            places[tuple(w[i : i + 5])].append(i)
        inside = {i + k for v in places.values() if len(v) > 1 for i in v for k in range(5)}
        real = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(real) - len(set(real)), len(inside),
        )
        assert r["base_failed"] == (len(w) < 10 or 100 * len(inside) > 20 * len(w))
        assert not (r["base_failed"] and r["kept"])


def test_policies_and_ablations(spark):
    frame = docs(spark, [(1, prose(1, 50)), (2, "a b"), (3, "De " * 40), (4, prose(5, 50).upper())])
    entries = quality.ledger(frame).cache()
    kept = {r["doc_id"]: (r["kept_base"], r["kept_v1"]) for r in quality.apply_policies(entries).collect()}
    assert kept == {1: (True, True), 2: (False, False), 3: (False, False), 4: (True, False)}
    by = {r["rule"]: r for r in quality.ablations(entries, quality.POLICIES["v1"]).collect()}
    assert by["few_words"]["n_failed"] == 1 and by["capitals"]["n_failed_alone"] == 1
    assert {r["n_docs"] for r in by.values()} == {4}


# --- op 8 ------------------------------------------------------------------


def test_main_text():
    body = "<p>" + "word &amp; text " * 12 + "<p>Short.</p><p>a<br>b <b>c</b></p>"
    want = ("word & text " * 12).strip() + "\nShort.\na b c"
    page = f"""<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li>Home
    </li></ul></nav><div class="ad">{'buy ' * 60}</div><article><h1>Head</h1>{body}<aside>{'x ' * 80}</aside>
    <p>End.</p></article><div id="comments"><p>{'nice ' * 60}</p></div><form><p>{'f ' * 80}</p></form><footer>c</footer>"""
    assert html.main_text(page) == f"Head\n{want}\nEnd."
    plain = f'<div id="nav">a b</div><div><h2>Head</h2>{body}</div><div class="cookie-notice">{"ok " * 60}</div>'
    assert html.main_text(plain) == f"Head\n{want}"
    assert html.main_text(None) == html.main_text("") == ""
    assert html.main_text("<p>hi</p>") == "hi"
    assert html.main_text("<article><p>cut &am") == "cut &am"
    assert html.main_text("<article><p>x<a href='a>b'>y</a> <!-- no") == "xy"


def test_main_text_outside_articles_and_short():
    long = "word and text " * 20
    body = f"<div><h1>Head</h1><p>{long}</p><p>Short.</p></div><div class='ad'>buy</div>"
    cards = "<article><h3>Card</h3><p>Read on</p></article>" * 3
    want = f"Head\n{long.strip()}\nShort."
    assert html.main_text(body + cards) == html.main_text(cards + "<hr><nav>n</nav>" + body) == want
    inside = f"<div><p>{long}</p><article><p>Card</p></article><p>End.</p></div>"
    assert html.main_text(inside) == f"{long.strip()}\nCard\nEnd."
    assert html.main_text(f"<article>{body}<p>End.</p></article>") == f"{want}\nEnd."
    short = "<nav>Home</nav><h1>Closed</h1><p>We are closed today.</p><footer>f</footer>"
    assert html.main_text(short) == "Closed\nWe are closed today."
    assert html.main_text("<p>Yes</p><nav>n</nav><p>A short body here.</p>") == "A short body here."


def test_main_text_names_of_parts():
    long = "A long sentence of plain words that goes on for a while. " * 4
    p, want = f"<p>{long}</p>", long.strip()
    end = "A short closing sentence."
    for page, text in [
        (f'<div id="page" class="no-header"><article>{p}</article></div>', want),
        (f'<div class="content has-sidebar">{p}</div>', want),
        (f"<div>{p}<aside>x</aside><p>{end}</p></div>", f"{want}\n{end}"),
        (f'<article>{p}</article><article class="comment">{p}</article>', want),
        (f'<div class="sidebar main"><main>{p}</main></div>', want),
        (f'<div class="related"><div id="header"><article>{p}{p}</article></div></div><p>x</p>', f"{want}\n{want}\nx"),
        (f'<div class="comments"><h2>Say</h2><article class="comment-body">{long}</article></div><div>{p}</div>', want),
        (f'<div class="related-posts"><article>Card {long}</article></div><div>{p}{p}</div>', f"{want}\n{want}"),
        (f'<div class="site-header">{p}</div><div class="share-buttons">{p}</div>{p}<ul id="comment-list">{p}</ul>', want),
    ]:
        assert html.main_text(page) == text


def test_main_text_of_a_very_long_page(spark):
    page = "<div class=ad><main>" + "<p>some words of a paragraph</p>" * 40_000 + "</main></div>"
    pages = spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")
    assert [r["n_chars"] for r in html.extract(pages).collect()] == [40_000 * 26 - 1]
    assert html.extract(pages.filter("page_id = 0")).count() == 0


def test_surge_and_dive():
    lengths = np.array([5, 0, 0, 0, 4, 90, 3, 50, 0, 0, 0, 6, 0])
    kept = html.between_surge_and_dive(lengths, 80)
    assert np.flatnonzero(kept & (lengths > 0)).tolist() == [4, 5, 6, 7]


def test_extract_pages(spark):
    rows = [(1, "u", None), (2, None, "<article><p>a\tb</p></article>"), (2, None, "<article><p>a\tb</p></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(pages).collect()) == [
        (1, "", 0), (2, "a b", 3), (2, "a b", 3),
    ]


# --- op 9 ------------------------------------------------------------------


def test_language_model_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [prose(i, 1) + str(i) for i in range(300)]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice([5, 40, 300])]) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts[3] = "The THE the Éa éa"
    frame = docs(spark, list(enumerate(texts)))
    train = frame.filter(~language_model.held_out())
    model = language_model.Model.fit(train, word_block=64, range_tokens=500)
    assert len(model.words.keys) > 2 and len(model.pairs.keys) > 2
    got = {r["doc_id"]: r for r in language_model.score(frame, model).collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    tokens = [WORD.findall(t.translate(low)) + ["\0"] for t in texts]
    train = [x for i, x in enumerate(tokens) if zlib.crc32(str(i).encode()) % 5 != 1]
    one = collections.Counter(w for x in train for w in x)
    two = collections.Counter(p for x in train for p in zip(["\0", *x], x))
    kinds = collections.Counter(b for _, b in two)

    def taken_off(values):
        n = collections.Counter(values)
        return language_model.discounts(np.array([n[i] for i in (1, 2, 3, 4)], dtype=float))

    high, lower = taken_off(two.values()), taken_off(kinds.values())
    after = collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), n in two.items():
        after[a][min(n, 3) - 1] += 1
    spare = sum(lower[min(n, 3)] for n in kinds.values())

    def p(a, b):
        n = kinds.get(b, 0)
        base = (max(n - lower[min(n, 3)], 0) + spare / (len(one) + 1)) / len(two)
        if a not in one:
            return base
        n = two.get((a, b), 0)
        return max(n - high[min(n, 3)], 0) / one[a] + sum(h * k for h, k in zip(high[1:], after[a])) / one[a] * base

    total, size = sum(one.values()), len(one)
    for i, x in enumerate(tokens):
        r = got[i]
        assert (r["n_tokens"], r["train_tokens"]) == (len(x), total)
        assert r["n_known"] == sum(w in one for w in x)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.5) / (total + 0.5 * (size + 1))) for w in x))
        assert r["score"] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["\0", *x], x)))
    known = next(iter(one))
    assert sum(p(known, w) for w in one) + p(known, "?") == pytest.approx(1)


# --- op 10 -----------------------------------------------------------------


def test_secret_scan_learns_and_redacts(spark):
    rng = random.Random(10)
    rows = []
    for i in range(240):
        key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
        kind = i % 3
        if kind == 0:
            text = f'{prose(i, 8)} token = "{key}" {prose(i + 1, 8)}'
        elif kind == 1:
            text = f"{prose(i, 8)} {rng.randrange(10**15, 10**16)} {prose(i + 1, 8)}"
        else:
            text = f"{prose(i, 8)} see /usr/lib/{'abcdefgh' * 3}/file.txt {prose(i + 1, 8)}"
        rows.append((i, text))
    frame = docs(spark, rows)
    found = secrets.scan(frame).cache()
    held = [r for r in found.collect() if r["held_out"]]
    assert len(held) > 30 and all(bool(r["label"]) == r["is_secret"] for r in held)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame, found).collect()}
    assert clean[0].count("[secret]") == 1 and clean[1] == rows[1][1] and len(clean) == 240


def test_secret_candidates_are_whole_values(spark):
    texts = {
        1: ('x password = "Tr0ub4dor&3" y', "Tr0ub4dor&3"), 2: ("a passwd: hunter2, b", "hunter2"),
        3: ("Authorization: Bearer abc.def-123 z", "abc.def-123"), 4: ("api_key=p@ss:w0rd! z", "p@ss:w0rd!"),
        5: ("secret: 'two words' z", "two words"), 6: ("token = " + "0a" * 20, "0a" * 20),
    }
    rows = [(k, t) for k, (t, _) in texts.items()] + [(7, f"id {'0a' * 20} here"), (8, "the bearer of news, author: Smith")]
    found = secrets.assigned_labels(secrets.candidates(docs(spark, rows))).collect()
    assert sorted((r["doc_id"], r["candidate"], r["label"]) for r in found) == [
        *[(k, v, 1.0) for k, (_, v) in texts.items()], (7, "0a" * 20, None),
    ]
    frame = docs(spark, rows)
    secret = secrets.candidates(frame).filter("keyed").withColumn("is_secret", F.lit(True))
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(frame, secret).collect()}
    assert clean[1] == 'x password = "[secret]" y' and clean[4] == "api_key=[secret] z" and clean[8] == rows[7][1]


def test_secret_scan_of_one_label(spark):
    only = secrets.scan(docs(spark, [(1, "number 1234567890123456 here"), (2, None)])).collect()
    assert [(r["doc_id"], r["probability"], r["is_secret"]) for r in only] == [(1, 0.0, False)]


# --- shared ----------------------------------------------------------------


def test_hashes_do_not_depend_on_place():
    a, _ = hashing.word_hashes(["one two", "", "  two\n"])
    assert a[1] == a[2] and len(set(a.tolist())) == 2
    assert hashing.word_hashes(["ÀB ab"], fold=True)[0][1] == hashing.word_hashes(["AB"], fold=True)[0][0]
