"""Main text of web pages by line-block distribution.

The markup is stripped to lines, one per block element.  Parts that a page
declares to be something else - navigation, headers, footers, asides, forms,
scripts, adverts, notices, comments - become a gap of empty lines.  The text
lengths of a sliding window of lines then show where text surges and where it
dives to nothing; the lines between the two points are kept, all of them,
short ones included.  The search and its bound are the same for all lines of
all pages.  An article only gives weight: its short runs stay too, where no
more text surges outside of articles.  A short paragraph beside surging ones,
in the same element, stays as well.  Where nothing surges, the run that comes
closest is the text.

A page is worked on in its own row, in time proportional to its length;
nothing is shuffled.

Defined cases: NULL or empty html gives an empty text; a page that ends inside
a tag or a comment ends there; repeated rows each get their row; other input
columns are ignored.
"""

import html as entities
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.llm.text import bounded_batches

#: Lines in the sliding window, and the empty lines that part two regions.
WINDOW = 3
#: Characters in a window where text surges.
SURGE = 80

# Element names of the markup language.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav "
    "ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = "script|style|noscript|template|textarea|iframe|svg|math|canvas|object|select|title|xmp|noembed|noframes"
OUTSIDE = frozenset("nav header footer aside form menu dialog button label fieldset search head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
CLOSED_BY_BLOCK = frozenset(("p",))
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())

# Names by which pages mark a part as no main text.  A name counts
# as a whole word of a class or id, or joined with one of the affixes below;
# `has-sidebar` or `no-header` say something about the page around them.
_COMMENTS = "comments?|commentlist|respond|replies|disqus"
_PARTS = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|newsletter|subscribe|"
    r"signup|login|nav\w*|menu|breadcrumbs?|sidebar|footer|header|masthead|toolbar|share|sharing|social|related|"
    rf"recommend\w*|{_COMMENTS}|pagination|pager|widget|copyright"
)
_BEFORE = "site|page|global|main|top|bottom|left|right|primary|secondary|post|user|reader|social|cookie|consent|advert"
_AFTER = (
    "list|section|area|wrap|wrapper|container|box|bar|block|links?|buttons?|item|slot|unit|form|inner|body|thread|"
    "posts?|articles?|stories|notice|banner|nav|menu"
)


def _named(words: str) -> re.Pattern:
    one = rf"(?:(?:{_BEFORE})[_-]+)*(?:{words})(?:[_-]+(?:{_AFTER}|{words}|\d+))*"
    return re.compile(rf"(?:^|\s)(?:{one}|byline-links|skip-link|hidden|sr-only)(?=\s|$)", re.IGNORECASE)


_NOT_TEXT = _named(_PARTS)
_OF_READERS = _named(_COMMENTS)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_TOKEN = re.compile(
    rf"<!--(?:.*?--!?>|.*)|<(?P<raw>{RAW})\b(?:[^'\">]|\"[^\"]*\"|'[^']*')*+>(?:.*?</(?P=raw)\s*>|.*)"
    r"|<(?P<close>/)?(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>(?:[^'\">]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.IGNORECASE | re.DOTALL,
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_SPACE = re.compile(r"\s+")


def _outside(name: str, attrs: str) -> tuple[bool, bool]:
    """Does an element declare that it holds no main text; is it by its name
    in a class or id alone?"""
    if name in OUTSIDE:
        return True, False
    named = False
    for key, value in _ATTR.findall(attrs) if attrs.strip() else ():
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id") and name not in ("html", "body", "main"):
            named |= bool((_OF_READERS if name == "article" else _NOT_TEXT).search(value))
        if key == "role" and value.lower() in _ROLES:
            return True, False
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return True, False
        if key == "style" and "display:none" in value.replace(" ", "").lower():
            return True, False
    return named, named


@dataclass(frozen=True)
class Line:
    text: str
    main: bool = False  # stands in an article
    block: str = ""  # name of its innermost block element
    parent: int = -1  # where the element around that one begins


@dataclass
class _Open:
    """An element that is open, or text that is outside by its name alone."""

    name: str
    at: int
    outside: bool
    named: bool
    main: bool
    before: int  # signs of text before it
    holds_main: bool = False


def lines(page: str) -> list[Line]:
    """Lines of text in page order.

    A part that declares itself no main text leaves a gap of ``WINDOW`` empty
    lines.  A name in a class or id does not count for an element that holds a
    ``main`` or an article and at least half of the page's text.
    """
    out, spared = _lines(page, frozenset())
    return _lines(page, spared)[0] if spared else out


def _lines(page: str, spared: frozenset[int]) -> tuple[list[Line], frozenset[int]]:
    """The lines, and the places of elements that a name put outside wrongly."""
    out: list[Line] = []
    open_tags: list[_Open] = []
    parts: list[str] = []
    wrapping: list[tuple[int, int]] = []  # place and signs of text within
    depth_out = depth_main = seen = 0

    def flush() -> None:
        line = _SPACE.sub(" ", entities.unescape("".join(parts))).strip()
        parts.clear()
        if line:
            blocks = [t for t in reversed(open_tags) if t.name in BLOCKS][:2]
            block = blocks[0].name if blocks else ""
            out.append(Line(line, depth_main > 0, block, blocks[1].at if len(blocks) > 1 else -1))

    def shut(k: int) -> None:
        """Close the element at place ``k`` and all inside it."""
        nonlocal depth_out, depth_main
        while len(open_tags) > k:
            tag = open_tags.pop()
            depth_main -= tag.main
            if tag.holds_main:
                wrapping.append((tag.at, seen - tag.before))
            if tag.outside:
                depth_out -= 1
                if not depth_out:
                    out.extend([Line("", depth_main > 0)] * WINDOW)

    at = 0
    for tag in _TOKEN.finditer(page):
        if not depth_out:
            parts.append(page[at : tag.start()])
        seen += len(page[at : tag.start()].strip())
        at = tag.end()
        name = (tag["name"] or "").lower()
        if not name:
            continue
        block = name in BLOCKS
        if block or name == "br":
            parts.append(" ")
        if tag["close"]:
            if block and not depth_out:
                flush()
            k = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k].name == name), None)
            if k is not None and (block or not any(t.name in BLOCKS for t in open_tags[k + 1 :])):
                shut(k)
        else:
            if block and not depth_out:
                flush()
            if block and open_tags:  # an open paragraph ends where a block begins
                k = next((k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k].name in BLOCKS), None)
                if k is not None and open_tags[k].name in CLOSED_BY_BLOCK:
                    shut(k)
            if name in VOID or tag["attrs"].endswith("/") and not block:
                continue
            outside, named = _outside(name, tag["attrs"])
            if tag.start() in spared:
                outside = named = False
            main = name in MAIN and not outside
            if main and depth_out:
                for around in open_tags:
                    around.holds_main |= around.named
            if outside:
                if not block and not depth_out:
                    flush()
                depth_out += 1
            open_tags.append(_Open(name, tag.start(), outside, named, main, seen))
            depth_main += main
    if not depth_out:
        parts.append(page[at:])
        flush()
    seen += len(page[at:].strip())
    shut(0)
    return out, frozenset(place for place, within in wrapping if 2 * within >= seen)


def between_surge_and_dive(lengths: np.ndarray, surge: int) -> np.ndarray:
    """Which lines lie between a surge and the dive that follows it.

    ``lengths`` are summed over windows that start at each line.  Text surges
    in a window that reaches ``surge``, and dives where a window sums to 0.
    A run of windows with text is kept as a whole if it surges anywhere.
    """
    padded = np.r_[lengths, np.zeros(WINDOW - 1, dtype=lengths.dtype)]
    sums = np.convolve(padded, np.ones(WINDOW, dtype=lengths.dtype), "valid")
    text = sums > 0
    starts = np.flatnonzero(text & ~np.r_[False, text[:-1]])
    ends = np.flatnonzero(text & ~np.r_[text[1:], False]) + 1
    kept = np.zeros(len(lengths), dtype=bool)
    for a, b in zip(starts, ends, strict=True):
        if sums[a:b].max() >= surge:
            kept[a:b] = True
    return kept


def main_text(page: str | None) -> str:
    """The main text of a page, one line per block."""
    found = lines(page or "")
    if not found:
        return ""
    lengths = np.array([len(line.text) for line in found])
    declared = np.array([line.main for line in found]) & (lengths > 0)
    kept = between_surge_and_dive(lengths, SURGE)
    # A short run of an article stays where articles hold most of the text.
    if lengths[declared].sum() >= lengths[kept & ~declared].sum():
        kept |= between_surge_and_dive(np.where(declared, lengths, 0), 1) & declared
    # So does a block of prose right beside a block that surges.
    prose = [line.parent if line.block in PROSE else None for line in found]
    surging = {p for p, k in zip(prose, kept, strict=True) if k} - {None}
    kept |= np.array([p in surging for p in prose])
    if not kept.any():
        kept = _peak(lengths)
    return "\n".join(line.text for line, n, k in zip(found, lengths, kept, strict=True) if k and n)


def _peak(lengths: np.ndarray) -> np.ndarray:
    """The run with the longest window, on a page where no text surges."""
    text = between_surge_and_dive(lengths, 1)
    best, most, at = np.zeros(len(lengths), dtype=bool), 0, 0
    for end in [*np.flatnonzero(~text), len(lengths)]:
        run = slice(at, end)
        at = end + 1
        height = max((lengths[k : k + WINDOW].sum() for k in range(run.start, run.stop)), default=0)
        if height > most:
            best[:], most = False, height
            best[run] = True
    return best


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page."""

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return page.map(main_text, na_action=None)

    bounded_batches(pages)
    found = pages.select("page_id", "url", text(html_col).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
