"""Secret scans with a random forest over candidate features.

Any run of sixteen or more signs that keys and tokens are made of is a
candidate, and so is the whole value after a name like a credential's or after
``Bearer``, whatever its length and signs.  Most are none: numbers, hashes, paths, long words.  A random forest
on the candidate's length, its character transitions, how much of it the
corpus's own dictionary covers, path marks and the neighbouring words tells
them apart; it is trained from labelled findings.

Everything is Spark SQL and Spark's own forest.  Candidates are few, so only
the dictionary moves rows: words are counted with a partial aggregate, and
fragments meet the dictionary as distinct strings first.

``FIT_FINDINGS`` bounds the labelled findings per label that the forest is
fitted on, drawn by a hash; the dictionary, the candidates and the verdicts
cover everything.

Where a corpus brings no labels of its own, ``assigned_labels`` labels a
finding by how it is written: as the value of a key that is named like a
credential.  What looks like a key but has no such name is judged, not fitted
on.  The forest does not see that name.

Defined cases: a NULL text has no candidates; a NULL id is kept; repeated rows
each have their findings; with no findings, or findings of one label only,
there is nothing to learn and every finding gets that label's probability, 0
or 1; other input columns are ignored.
"""

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import BLANKS, id_remainder, whole, words
from voltrail.session import checkpointed

# What candidates are made of, names of credentials.
CANDIDATE = "[A-Za-z0-9+/=_-]{16,}"
CREDENTIAL = (
    "(?i)(token|secret|passw(or)?d|api[_-]?key|access[_-]?key|auth(?!or(?!i[sz]))|bearer|credential|private[_-]?key)"
)
# A credential's name before its sign, the sign, and the scheme without one.
_NAMED = CREDENTIAL + "[A-Za-z0-9_.-]*[\"'`\\])]*"
_SIGN = "(=>|:=|=|:)"
_IN_WORD = _NAMED + _SIGN + "(?!//)[\"'`]?[^\\s\"'`]"
_BEARER = "(?i)(^|[^A-Za-z])bearer$"

FIT_FINDINGS = 20_000
TREES, DEPTH, SEED = 30, 6, 7
#: A word is in the dictionary from this number of documents on.
DICTIONARY_DOCS = 5
NEIGHBOUR_BUCKETS = 8

_FEATURES = (
    "length", "digits", "lowers", "uppers", "others", "class_changes", "vowel_changes", "repeats",
    "hex", "coverage", "slashes", "dots", "url", "quoted", "assigned", "before_length", "after_length",
    "before_letters", "after_letters", "place", *[f"near_{i}" for i in range(NEIGHBOUR_BUCKETS)],
)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate, with the words around it."""
    split = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_w"))
    w = F.col("_w")
    every = F.when(F.size(w) > 0, F.sequence(F.lit(0), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))

    def word(i: Column) -> Column:
        return F.coalesce(F.get(w, i), F.lit(""))

    def follows(i: Column) -> Column:
        """Does the word at ``i`` follow a credential's name or scheme?"""
        before, before_2 = word(i - 1), word(i - 2)
        bearer = before.rlike(_BEARER) & (
            before.rlike("[=:]") | before_2.rlike("[=:]$") | word(i).rlike(f"[0-9]|{CANDIDATE}")
        )
        named = before.rlike(f"{_NAMED}{_SIGN}$") | before.rlike(f"^{_SIGN}$") & before_2.rlike(f"{_NAMED}$")
        return bearer | named & ~word(i).rlike("(?i)^[\"'`]?(bearer|basic)$")

    at = split.select(
        "doc_id",
        "_w",
        F.explode(
            F.filter(every, lambda i: word(i).rlike(CANDIDATE) | word(i).rlike(_IN_WORD) | follows(i))
        ).alias("word_no"),
    )
    n = F.col("word_no")
    named = at.select(
        "doc_id",
        "word_no",
        word(n).alias("word"),
        word(n - 1).alias("before"),
        word(n - 2).alias("before_2"),
        word(n + 1).alias("after"),
        F.when(F.col("_w")[n].rlike(_IN_WORD), F.regexp_replace(word(n), f"^.*?{_NAMED}{_SIGN}(?!//)", ""))
        .when(follows(n), word(n))
        .alias("_raw"),
        "_w",
    )
    # A value in quotes goes to the closing one, which may stand in a later word.
    raw = F.col("_raw")
    rest = F.array_join(F.concat(F.array(raw), F.slice("_w", n + 2, F.size("_w"))), " ")
    quoted = F.when(raw.rlike("^([\"'`]).+?\\1"), F.regexp_extract(raw, "^([\"'`])(.+?)\\1", 2)).when(
        raw.rlike("^[\"'`]"), F.regexp_extract(rest, "^([\"'`])(.+?)\\1", 2)
    )
    bare = F.regexp_replace(raw, "^[\"'`(\\[{<]+|[\"'`,;.)\\]}>]+$", "")
    value = F.when(F.length(quoted) > 0, quoted).otherwise(bare)
    valued = named.select(*[c for c in named.columns if c not in ("_w", "_raw")], F.nullif(value, F.lit("")).alias("_value"))

    def runs(text: Column, keyed: bool = False) -> Column:
        return F.transform(
            F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)),
            lambda c: F.struct(c.alias("candidate"), F.lit(keyed).alias("keyed")),
        )

    # The value is one candidate; what stands around it in its word is searched.
    v = F.col("_value")
    head = F.call_function("substring_index", v, F.lit(" "), F.lit(1))
    prefix = F.call_function("substring_index", F.col("word"), head, F.lit(1))
    suffix = F.substring(F.col("word"), F.length(prefix) + F.length(head) + 1, F.length("word"))
    parts = F.when(v.isNull(), runs(F.col("word"))).otherwise(
        F.concat(
            runs(prefix), F.array(F.struct(v.alias("candidate"), F.lit(True).alias("keyed"))), runs(suffix)
        )
    )
    found = valued.select(*[c for c in valued.columns if c != "_value"], F.posexplode(parts).alias("part_no", "_part"))
    return found.select(*[c for c in found.columns if c != "_part"], "_part.candidate", "_part.keyed")


def dictionary(docs: DataFrame, text_col: str = "text", least: int = DICTIONARY_DOCS) -> DataFrame:
    """``fragment``: letter runs that stand in ``least`` documents or more."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower(whole(F.col(text_col))), F.lit("[a-z]{3,12}"), F.lit(0)))
    return (
        docs.select(F.explode(runs).alias("fragment"))
        .groupBy("fragment")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= least)
        .select("fragment")
    )


def _prefix() -> Column:
    """What stands before the candidate in its word."""
    head = F.call_function("substring_index", F.col("candidate"), F.lit(" "), F.lit(1))
    return F.call_function("substring_index", F.col("word"), head, F.lit(1))


def _count(text: str, kind: str) -> Column:
    return F.regexp_count(text, F.lit(kind)).cast("double")


def featured(found: DataFrame, known: DataFrame) -> DataFrame:
    """Candidates with their features; ``known`` is the dictionary."""
    runs = F.array_distinct(F.regexp_extract_all(F.lower("candidate"), F.lit("[a-z]{3,12}"), F.lit(0)))
    strings = found.select("candidate").distinct()
    pieces = strings.select("candidate", F.explode(runs).alias("fragment"))
    covered = (
        pieces.join(known, "fragment").groupBy("candidate").agg(F.sum(F.length("fragment")).alias("_covered"))
    )
    joined = found.join(covered, "candidate", "left")
    size = F.length("candidate")
    prefix = _prefix()
    stem = F.lower(F.regexp_replace("before", "[^A-Za-z]", ""))
    bucket = F.pmod(F.xxhash64(F.length(stem), F.substring(stem, -2, 2)), F.lit(NEIGHBOUR_BUCKETS))
    values = {
        "length": size.cast("double"),
        "digits": _count("candidate", "[0-9]") / size,
        "lowers": _count("candidate", "[a-z]") / size,
        "uppers": _count("candidate", "[A-Z]") / size,
        "others": _count("candidate", "[^A-Za-z0-9]") / size,
        "class_changes": _count(
            "candidate", "(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"
        ) / size,
        "vowel_changes": _count("candidate", "(?i)(?<=[aeiou])(?=[b-df-hj-np-tv-z])") / size,
        "repeats": _count("candidate", "(.)(?=\\1)") / size,
        "hex": F.col("candidate").rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "coverage": F.coalesce(F.col("_covered") / size, F.lit(0.0)),
        "slashes": _count("word", "/"),
        "dots": _count("word", "\\."),
        "url": F.col("word").contains("://").cast("double"),
        "quoted": prefix.rlike("[\"'`]$").cast("double"),
        "assigned": (F.col("before").rlike("[=:]$") | prefix.rlike("[=:][\"'`]?$")).cast("double"),
        "before_length": F.length("before").cast("double"),
        "after_length": F.length("after").cast("double"),
        "before_letters": F.col("before").rlike("^[a-z]+$").cast("double"),
        "after_letters": F.col("after").rlike("^[a-z]+$").cast("double"),
        "place": F.col("part_no").cast("double"),
        **{f"near_{i}": (bucket == i).cast("double") for i in range(NEIGHBOUR_BUCKETS)},
    }
    return joined.select(*found.columns, *[v.alias(k) for k, v in values.items()])


def assigned_labels(found: DataFrame) -> DataFrame:
    """Add ``label``: 1 for the value of a key named like a credential, NULL
    for what looks like a key but is named nowhere, else 0."""
    sign = F.col("before").rlike("^[^A-Za-z0-9]*(=|:=?)$")
    key = F.when(sign, F.col("before_2")).otherwise(
        F.concat_ws(" ", F.col("before"), _prefix())
    )
    stated = sign | F.col("before").rlike("[=:]$") | _prefix().rlike("[=:]")
    known = F.col("keyed") | stated & key.rlike(CREDENTIAL)
    like_key = (
        F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
        & ~F.col("word").contains("://") & ~F.col("word").rlike("^[\"'`(]*[./~]*/")
    )
    return found.withColumn("label", F.when(known, 1.0).when(~like_key, 0.0))


def fit(labelled: DataFrame, per_label: int = FIT_FINDINGS):
    """A fitted forest, or the one label there is (0.0 where there is none)."""
    labelled = labelled.filter("label is not null")
    counts = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return next(iter(counts), 0.0)
    draw = F.pmod(F.xxhash64("doc_id", "word_no", "part_no", "candidate"), F.lit(1_000_000)) / 1_000_000
    share = F.when(F.col("label") == 1, min(1.0, per_label / counts[1.0])).otherwise(
        min(1.0, per_label / counts[0.0])
    )
    rows = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(
        labelled.filter(draw < share)
    )
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED)
    return forest.fit(rows.select("features", "label"))


def judge(rows: DataFrame, model) -> DataFrame:
    """Add ``probability`` and ``is_secret``."""
    if isinstance(model, float):
        scored = rows.withColumn("probability", F.lit(model))
    else:
        vectors = VectorAssembler(inputCols=list(_FEATURES), outputCol="features").transform(rows)
        scored = model.transform(vectors.drop("probability")).withColumn(
            "probability", vector_to_array("probability")[1]
        )
    return scored.withColumn("is_secret", F.col("probability") >= 0.5)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(id_remainder(F.col(id_col), 4) == 2, F.lit(False))


def scan(docs: DataFrame) -> DataFrame:
    """All findings with the forest's verdict, learned from the documents
    that are not held out."""
    rows = checkpointed(assigned_labels(featured(candidates(docs), dictionary(docs))))
    model = fit(rows.filter(~held_out()))
    return judge(rows, model).select(
        "doc_id",
        "word_no",
        "part_no",
        "candidate",
        held_out().alias("held_out"),
        F.col("label").cast("int").alias("label"),
        "probability",
        "is_secret",
    )


def redact(docs: DataFrame, findings: DataFrame, mark: str = "[secret]") -> DataFrame:
    """Documents with every found secret replaced in the text."""
    strings = (
        findings.filter("is_secret")
        .groupBy(F.col("doc_id").alias("__vt_id"))
        .agg(F.collect_set("candidate").alias("__vt_secrets"))
    )

    def literal(s: Column) -> Column:
        """The secret with any blanks between its words, not inside a longer word."""
        safe = F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))
        spaced = F.replace(safe, F.lit(" "), F.lit(f"\\E[{BLANKS}]+\\Q"))
        return F.concat(F.lit("(?<![A-Za-z0-9])\\Q"), spaced, F.lit("\\E(?![A-Za-z0-9])"))

    joined = docs.join(strings, docs["doc_id"].eqNullSafe(F.col("__vt_id")), "left")
    clean = F.aggregate(
        F.array_sort(F.coalesce("__vt_secrets", F.array().cast("array<string>")), lambda a, b: F.length(b) - F.length(a)),
        F.col("text"),
        lambda text, s: F.regexp_replace(text, literal(s), F.lit(mark)),
    )
    return joined.select(*[clean.alias(c) if c == "text" else F.col(c) for c in docs.columns])
