"""Personal data by weak supervision.

1. Every text is read once.  Exact patterns give the base spans; broader ones
   give candidates: numbers that look like cards or phones without passing
   them, addresses written with "(at)" and "dot", addresses of the longer IP
   form.  Labelers - patterns and checksums, gazetteers, words around the span -
   vote for or against each candidate, or abstain.  What is kept of a document
   is one row of spans, votes and features; texts are not read again.
2. Votes are counted per kind and pattern of votes, in Spark.  Expectation-
   maximisation over these counts estimates how far each labeler can be
   trusted and gives each pattern its probability.  There are at most
   3 ** (number of labelers) patterns a kind, however many documents.
3. A logistic classifier over features of the span and its surroundings is
   fitted to these probabilities, on at most ``FIT_SPANS`` candidates a kind,
   taken in the order of a hash.  It judges every candidate, so it also decides
   where labelers abstain or disagree.
4. Base spans always stay.  A candidate that touches no base span is added if
   its probability is at least ``THRESHOLD``; of those that overlap the most
   probable one is.

All patterns take time in proportion to the text, also on long runs of digits
or letters.

Defined cases: a NULL or empty text has no spans; NULL ids and repeated rows
keep a row each; a kind without candidates has no model and adds nothing; an
empty table gives no rows; other columns are ignored, whatever their names.
"""

import bisect
import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import bounded_batches, whole
from voltrail.session import scratch

#: Candidates per kind that the classifier is fitted on.
FIT_SPANS = 5_000
THRESHOLD = 0.5
EM_ROUNDS = 50
FIT_ROUNDS = 150
#: Features are numbers below this, by hash.
FEATURES = 1 << 12
#: Signs looked at on either side of a span.
NEAR = 48

# Kinds in the order of results, and their base patterns.
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)++")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Gazetteers and words around personal data, in the languages of
# the corpus.
TOP_DOMAINS = frozenset(
    "com org net edu gov mil int info biz name io co me app dev ai tv us uk de fr es it nl be ch at se no dk fi pl cz "
    "pt gr ie ru ua tr in cn jp kr au nz ca mx br ar cl za eu".split()
)
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|35|6011|65|30|36|38")
CALLING_CODES = re.compile(r"1|7|20|27|3[0-46-9]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")
NOT_A_HOST = re.compile(r"0\.|127\.|22[4-9]\.|2[34][0-9]\.|25[0-5]\.")
WORDS = {
    EMAIL: frozenset("mail email e-mail contact write address adresse correo courriel kontakt escribe contacto".split()),
    IP: frozenset("ip host server address client adresse dirección login from".split()),
    CARD: frozenset("card visa mastercard credit debit karte carte tarjeta kreditkarte crédito crédit account".split()),
    PHONE: frozenset("phone tel call fax mobile cell telefon téléphone teléfono anruf llame appelez ring dial".split()),
}
OTHER_NUMBERS = frozenset(
    "version v release section chapter isbn issn invoice order serial token key hash sha id ref page figure no nr".split()
)


@dataclass(frozen=True)
class Span:
    kind: int
    start: int
    end: int
    base: bool


# --- base spans ------------------------------------------------------------


def luhn(digits: str) -> bool:
    values = np.frombuffer(digits.encode(), dtype=np.uint8)[::-1].astype(np.int64) - 48
    values[1::2] *= 2
    return int((values - 9 * (values > 9)).sum()) % 10 == 0


def _octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _bare(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield Span(EMAIL, start, done, True)
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for run in _DOTTED.finditer(text):
        parts, at = run[0].split("."), run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if _octets(four):
                yield Span(IP, at, end, True)
            at = end + 1


def _cards(text: str) -> Iterator[Span]:
    for run in _DIGITS.finditer(text):
        if len(run[0]) >= 13 and 13 <= len(d := _bare(run[0])) <= 19 and luhn(d):
            yield Span(CARD, *run.span(), True)


def _phones(text: str) -> Iterator[Span]:
    for run in _PLUS.finditer(text):
        if 9 <= len(_bare(run[0])) <= 15:
            yield Span(PHONE, *run.span(), True)


def base_spans(text: str) -> list[Span]:
    """All base spans by kind, then start."""
    return [*_emails(text), *_ips(text), *_cards(text), *_phones(text)]


# --- candidates ------------------------------------------------------------

_DOT = r"(?: ?(?:\[dot\]|\(dot\)|\{dot\}) ?| dot )"
_AT = re.compile(
    rf" ?(?:\[at\]|\(at\)|\{{at\}}) ?(?=[A-Za-z0-9-]++(?:\.|{_DOT})[A-Za-z0-9-])| at (?=[A-Za-z0-9-]++{_DOT}[A-Za-z0-9-])", re.I
)
_SPELLED = re.compile(rf"[A-Za-z0-9-]++(?:(?:\.|{_DOT})[A-Za-z0-9-]++)++", re.I)
_LONG_IP = re.compile(r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4})?(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")
_NUMBERS = re.compile(r"[0-9]++(?:[ ().-]{1,2}[0-9]++)*+")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"[\w-]+")
_CARD_SHAPES = {(4, 4, 4, 4), (4, 6, 5), (4, 4, 4, 4, 3), (4, 4, 4, 1), (4, 4, 5)}


def _spelled_emails(text: str) -> Iterator[Span]:
    done = 0
    for at in _AT.finditer(text):
        start = at.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _SPELLED.match(text, at.end())
        if domain and at[0] == " at " and _WORD.findall(domain[0])[-1].lower() not in TOP_DOMAINS:
            continue  # plain words
        if start < at.start() and domain:
            done = domain.end()
            yield Span(EMAIL, start, done, False)


def _long_ips(text: str) -> Iterator[Span]:
    if text.count(":") >= 2:
        for m in _LONG_IP.finditer(text):
            if len(_GROUP.findall(m[0])) + m[0].count("::") > 0 and len(m[0].strip(":")) > 0:
                yield Span(IP, *m.span(), False)


def _numbers(text: str) -> Iterator[Span]:
    """Cards and phones among runs of digit groups: a group alone, groups that
    have a card's shape, or a whole run of short groups."""
    for run in _NUMBERS.finditer(text):
        if run.end() - run.start() < 7:
            continue
        groups = [(run.start() + g.start(), run.start() + g.end()) for g in _GROUP.finditer(run[0])]
        sizes = [b - a for a, b in groups]
        for (a, b), n in zip(groups, sizes, strict=True):
            if 13 <= n <= 19:
                yield Span(CARD, a, b, False)
        for k in {len(s) for s in _CARD_SHAPES}:
            for i in range(len(groups) - k + 1):
                if tuple(sizes[i : i + k]) in _CARD_SHAPES:
                    yield Span(CARD, groups[i][0], groups[i + k - 1][1], False)
        dotted = len(sizes) == 4 and re.fullmatch("[0-9.]+", run[0])  # an address or a version
        if 7 <= sum(sizes) <= 15 and not dotted and (len(sizes) == 1 or max(sizes) <= 5):
            a = run.start()
            yield Span(PHONE, a - (a > 0 and text[a - 1] in "+("), run.end(), False)


def candidates(text: str) -> list[Span]:
    """Base spans and every other candidate that touches none of them."""
    base = base_spans(text)
    more = [*_spelled_emails(text), *_long_ips(text), *_numbers(text)]
    if base and more:
        # The widest reach of the base spans that start before a candidate's end.
        ordered = sorted(base, key=lambda s: s.start)
        starts = np.array([s.start for s in ordered])
        reach = np.maximum.accumulate(np.array([s.end for s in ordered]))
        before = np.searchsorted(starts, np.array([s.end for s in more])) - 1
        more = [s for s, k in zip(more, before.tolist(), strict=True) if k < 0 or reach[k] <= s.start]
    return base + list(dict.fromkeys(more))


# --- labelers --------------------------------------------------------------


@dataclass(frozen=True)
class Scene:
    """A span with what stands around it."""

    kind: int
    span: str
    digits: str
    groups: tuple[int, ...]
    before: str
    after: str
    near: tuple[str, ...]  # words before, nearest first
    base: bool


def scene(text: str, s: Span) -> Scene:
    span, before = text[s.start : s.end], text[max(0, s.start - NEAR) : s.start]
    near = tuple(w.lower() for w in _WORD.findall(before)[::-1][:4])
    groups = tuple(len(g) for g in _GROUP.findall(span))
    return Scene(s.kind, span, _bare(span), groups, before, text[s.end : s.end + NEAR], near, s.base)


def _pattern(x: Scene) -> int:
    return 1 if x.base else 0


_DATE = re.compile(r"(?:19|20)[0-9]{2}([ .-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([ .-])[0-9]{1,2}\2(?:19|20)?[0-9]{2}")
_YEARS = re.compile(r"(?:19|20)[0-9]{2}(?:[ ().-]{1,2}(?:19|20)[0-9]{2})+")


def _dated(x: Scene) -> bool:
    return bool(_DATE.fullmatch(x.span) or _YEARS.fullmatch(x.span))


def _checksum(x: Scene) -> int:
    if x.kind == CARD:
        return 1 if luhn(x.digits) else -1
    if x.kind == IP:
        if ":" in x.span:
            return 1 if "::" in x.span or x.span.count(":") == 7 else -1
        return 1 if x.base else -1
    if x.kind == PHONE:
        return -1 if _dated(x) or len(x.digits) < 7 else 1 if 9 <= len(x.digits) <= 15 else 0
    return 1 if re.search(r"[A-Za-z]{2,}$", x.span) else -1


def _form(x: Scene) -> int:
    if x.kind == CARD:
        return 1 if x.groups in _CARD_SHAPES or x.groups in {(15,), (16,)} else -1
    if x.kind == PHONE:
        if _dated(x) or len(x.groups) == 1 or (len(x.groups) == 2 and "(" not in x.span):
            return -1
        return 1 if x.span[0] in "+(" or len(x.groups) >= 3 else 0
    if x.kind == IP:
        return 0 if ":" in x.span else -1 if re.search(r"(?:^|\.)0[0-9]", x.span) else 1
    return -1 if ".." in x.span or x.span[0] in ".-" else 1


def _edges(x: Scene) -> int:
    """Part of a longer word or number."""
    a, b = x.before[-1:], x.after[:2]
    inside = a.isalnum() or a in {"_", "=", '"', "'"} or b[:1].isalnum() or b[:1] in {"_", '"', "'"}
    return -1 if inside or re.match(r"[.-][0-9]", b) or re.search(r"[0-9][.-]$", x.before) else 1


def _gazetteer(x: Scene) -> int:
    if x.kind == EMAIL:
        return 1 if x.span.rpartition(".")[2].rpartition(" ")[2].lower().strip("])}") in TOP_DOMAINS else -1
    if x.kind == CARD:
        return 1 if ISSUERS.match(x.digits) else -1
    if x.kind == IP:
        return 0 if ":" in x.span else -1 if NOT_A_HOST.match(x.span) else 1
    return 0 if x.span[0] != "+" else 1 if CALLING_CODES.match(x.digits) else -1


def _named(x: Scene) -> int:
    return 1 if any(w in WORDS[x.kind] for w in x.near) else 0


def _other_number(x: Scene) -> int:
    return -1 if any(w in OTHER_NUMBERS for w in x.near[:2]) else 0


@dataclass(frozen=True)
class Labeler:
    """How often it is believed beforehand to vote for a true and for a false
    span, if it votes, and how many votes that belief counts for."""

    name: str
    vote: Callable[[Scene], int]
    for_true: float
    for_false: float
    weight: float


LABELERS = (
    Labeler("pattern", _pattern, 0.95, 0.05, 20),
    Labeler("checksum", _checksum, 0.9995, 0.1, 2000),
    Labeler("form", _form, 0.7, 0.3, 20),
    Labeler("edges", _edges, 0.8, 0.2, 50),
    Labeler("gazetteer", _gazetteer, 0.7, 0.3, 20),
    Labeler("named", _named, 0.85, 0.15, 50),
    Labeler("other_number", _other_number, 0.85, 0.15, 50),
)


def votes(x: Scene) -> str:
    """A sign per labeler: + for, - against, 0 abstains."""
    return "".join("-0+"[f.vote(x) + 1] for f in LABELERS)


def _side(c: str) -> str:
    return "" if not c else "9" if c.isdigit() else "a" if c.isalpha() else c


def features(x: Scene) -> list[int]:
    """Numbers of the features a span has, each below ``FEATURES``."""
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", x.span))
    told = [
        f"shape {shape[:24]}", f"digits {min(len(x.digits), 24)}", f"groups {x.groups[:6]}",
        f"left {_side(x.before[-1:])}", f"right {_side(x.after[:1])}", f"sum {_checksum(x)}", f"form {_form(x)}",
        f"known {_gazetteer(x)}", f"edges {_edges(x)}", f"first {x.span[:1]}", f"named {_named(x)}",
        f"other {_other_number(x)}", f"sum {_checksum(x)} form {_form(x)} edges {_edges(x)}",
        *[f"near {w[:24]}" for w in x.near[:2]],
    ]
    hashed = {int.from_bytes(hashlib.blake2b(f"{x.kind} {t}".encode(), digest_size=4).digest(), "little") for t in told}
    return sorted({h % FEATURES for h in hashed})


_SPAN = "struct<kind:int,start:int,end:int,base:boolean,votes:string,features:array<int>>"


def _found(text: str) -> list[tuple]:
    out = []
    for s in candidates(text):
        x = scene(text, s)
        out.append((s.kind, s.start, s.end, s.base, votes(x), features(x)))
    return out


def find(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the candidates of every text, with votes and features;
    written once."""

    @F.pandas_udf(f"array<{_SPAN}>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([_found(t) for t in texts], dtype=object)

    bounded_batches(docs)
    path = scratch(docs.sparkSession, "private-data")
    docs.select("doc_id", found(whole(F.col("text"))).alias("spans")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


# --- reliabilities ---------------------------------------------------------


@dataclass(frozen=True)
class Reliability:
    """Of one kind: the share of personal data among candidates, and for each
    labeler how often it votes for a true and for a false one, if it votes."""

    share: float
    for_true: np.ndarray
    for_false: np.ndarray

    def probability(self, signs: np.ndarray) -> np.ndarray:
        """``signs``: a row per pattern of votes, -1, 0 or 1 per labeler."""
        yes, no = signs > 0, signs < 0
        true = yes @ np.log(self.for_true) + no @ np.log1p(-self.for_true)
        false = yes @ np.log(self.for_false) + no @ np.log1p(-self.for_false)
        odds = np.clip(true - false + np.log(self.share) - np.log1p(-self.share), -50, 50)
        return 1 / (1 + np.exp(-odds))


def estimate(signs: np.ndarray, counts: np.ndarray, rounds: int = EM_ROUNDS) -> Reliability:
    """Expectation-maximisation over patterns of votes and how often each occurs.

    A labeler's abstention says nothing; beliefs held beforehand count as votes.
    """
    for_true, for_false, weight = (np.array(v) for v in zip(*[(f.for_true, f.for_false, f.weight) for f in LABELERS], strict=True))
    now = Reliability(0.5, for_true, for_false)
    yes, no, n = signs > 0, signs < 0, counts.astype(float)
    for _ in range(rounds):
        p = now.probability(signs)

        def share_of(p: np.ndarray, belief: np.ndarray) -> np.ndarray:
            up, down = (n * p) @ yes, (n * p) @ no
            return np.clip((up + weight * belief) / (up + down + weight), 1e-4, 1 - 1e-4)

        share = (n @ p + 1) / (n.sum() + 2)
        now = Reliability(float(share), share_of(p, for_true), share_of(1 - p, for_false))
    return now


def _signs(patterns: list[str]) -> np.ndarray:
    return np.array([["-0+".index(c) - 1 for c in p] for p in patterns]).reshape(len(patterns), len(LABELERS))


def reliabilities(found: DataFrame) -> dict[int, Reliability]:
    """Per kind, from the counts of its patterns of votes."""
    spread = found.select(F.inline("spans")).groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n"))
    rows = sorted(spread.collect())  # at most 3 ** labelers a kind
    out = {}
    for kind, own in itertools.groupby(rows, key=lambda r: r["kind"]):
        own = list(own)
        out[kind] = estimate(_signs([r["votes"] for r in own]), np.array([r["n"] for r in own]))
    return out


# --- classifier ------------------------------------------------------------


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # per kind and feature; the last is the kind's own

    def probability(self, kind: int, found: list[int]) -> float:
        z = self.weights[kind, -1] + self.weights[kind, found].sum()
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def fit(found: DataFrame, known: dict[int, Reliability], fit_spans: int = FIT_SPANS) -> Classifier:
    """Logistic regression on the probabilities of a bounded sample per kind."""
    weights = np.zeros((len(KINDS), FEATURES + 1))
    weights[:, -1] = -50.0  # a kind that was never seen
    spread = found.select("doc_id", F.inline("spans"))
    for kind, reliability in known.items():
        rows = (
            spread.filter(F.col("kind") == kind)
            .orderBy(F.xxhash64("doc_id", "start"), "start", "votes")
            .limit(fit_spans)
            .select("votes", "features")
            .collect()
        )
        target = reliability.probability(_signs([r["votes"] for r in rows]))
        weights[kind] = _logistic([r["features"] for r in rows], target)
    return Classifier(weights)


def _logistic(rows: list[list[int]], target: np.ndarray, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Adaptive gradient steps with a small penalty on all but the constant."""
    sizes = [len(r) for r in rows]
    at, row = np.array([f for r in rows for f in r], dtype=np.int64), np.repeat(np.arange(len(rows)), sizes)
    w, seen = np.zeros(FEATURES + 1), np.full(FEATURES + 1, 1e-8)
    for _ in range(rounds):
        z = w[-1] + np.bincount(row, w[at], len(rows))
        gap = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(rows)
        slope = np.bincount(at, gap[row], FEATURES + 1) + 1e-4 * w
        slope[-1] = gap.sum()
        seen += slope**2
        w -= 0.5 * slope / np.sqrt(seen)
    return w


# --- results ---------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    reliability: dict[int, Reliability]
    classifier: Classifier

    @classmethod
    def of(cls, found: DataFrame, fit_spans: int = FIT_SPANS) -> "Model":
        known = reliabilities(found)
        return cls(known, fit(found, known, fit_spans))

    def added(self, spans: list[dict], threshold: float = THRESHOLD) -> list[tuple[int, int, int]]:
        """The candidates to add, as (kind, start, end): the most probable of
        those that overlap."""
        judged = []
        for s in spans:
            if not s["base"] and (p := self.classifier.probability(s["kind"], list(s["features"]))) >= threshold:
                judged.append((-p, s["start"] - s["end"], s["start"], s["end"], s["kind"]))
        taken, out = [], []
        for _, _, start, end, kind in sorted(judged):
            i = bisect.bisect(taken, (start, end))
            if (i == 0 or taken[i - 1][1] <= start) and (i == len(taken) or taken[i][0] >= end):
                taken.insert(i, (start, end))
                out.append((kind, start, end))
        return out


def spans_of(found: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``base`` and ``spans``: arrays of (kind, start, end), sorted."""
    shared = model

    @F.pandas_udf("array<struct<kind:int,start:int,end:int>>")
    def added(spans: pd.Series) -> pd.Series:
        return pd.Series([shared.added(list(s)) for s in spans], dtype=object)

    def places(s: Column) -> Column:
        return F.transform(s, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    base = places(F.filter("spans", lambda x: x["base"]))
    # Only documents with other candidates are judged.
    rest = F.filter("spans", lambda x: ~x["base"])
    more = F.when(F.size(rest) > 0, added(rest)).otherwise(F.slice(base, 1, 0))
    bounded_batches(found)
    return found.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, more)).alias("spans"))


def as_text(spans: str) -> Column:
    """``kind:start:end`` of all spans, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string")),
        ),
        ",",
    )


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: counts and digest of its base spans, all spans."""
    found = find(docs)
    placed = spans_of(found, Model.of(found))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return placed.select(
        "doc_id", *map(count, range(len(KINDS))), F.sha2(as_text("base"), 256).alias("base_sha256"), as_text("spans").alias("spans")
    )
