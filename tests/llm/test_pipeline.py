"""The pipeline against a brute-force version of all its stages."""

import hashlib
import random

import corpus_pipeline
from test_text_operators import WORD, brute_groups, brute_lines, brute_targets, docs, prose


def _rows():
    rng = random.Random(12)
    rows = [(0, None, "en", "a"), (1, "", "en", "a"), (2, "12 34 ?", None, "b")]
    for i in range(3, 90):
        text = "\n".join(prose(1000 + i * 3 + k, 25) for k in range(3))
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "a", "b", None])))
    for i in range(90, 150):  # copies, near copies by a word or a line, shared lines
        lines = rng.choice(rows[3:])[1].split("\n")
        kind = rng.randrange(3)
        if kind == 1:
            k = rng.randrange(len(lines))
            words = lines[k].split()
            words[3:5] = ["new", f"word{i}"]
            lines[k] = " ".join(words)
        if kind == 2:
            lines[0] = prose(5000 + i, 25)
        rows.append((i, "\n".join(lines), "en", "b"))
    return rows


def _brute(rows):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    left = brute_lines([(r[0], r[1]) for r in rows])
    rows = [(r[0], left[r[0]], r[2], r[3]) for r in rows if WORD.search(left[r[0]])]
    groups = brute_groups([(r[0], r[1]) for r in rows])
    rows = [r for r in rows if groups[r[0]][0] == r[0]]
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    targets = brute_targets(sizes)
    out = []
    for r in rows:
        rate = targets[r[3]] / sizes[r[3]]
        draw = int(hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()[:12], 16) / 16**12
        out += [(r[0], r[1])] * (int(rate) + (draw < rate - int(rate)))
    return sorted(out)


def test_stages_equal_brute_force(spark, tmp_path):
    import sentencepiece

    from voltrail.llm import pieces

    docs(spark, _rows()).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == _brute(_rows())
    own = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    assert all(list(r["ids"]) == own.encode(r["text"], add_bos=True, add_eos=True) for r in got)
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert len(corpus_pipeline.STAGES) == 5


def test_no_documents(spark, tmp_path):
    docs(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
