"""Main text of HTML pages as the maximum-scoring subsequence of their words and tags.

A page is a sequence of words and tags.  Every item has a weight, positive for what is met more often inside the main content than
outside it and negative for the reverse; one linear scan finds the contiguous run with the highest sum.
Weights are log odds counted on labelled pages: those whose markup names its content (``article`` or ``main``), up to about
``rows`` of them.  Words count by the element around them, tags by name.

From the run, what sits in elements that are never main text is left out (menus, headers outside the content, footers, sidebars,
notices, adverts, forms, scripts, styles, reader comments, named by tag, role, class or id).  Blocks are joined by one
space in page order; white space inside a block becomes one space; character references are decoded.

Null and empty pages, and pages without a positive run, give the empty text.  Unclosed elements end where a content element or
the body ends.  Pages are read whole, one by one, in time linear in their length whatever their markup; repeated pages get equal texts.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import log

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotlens.llm.common import sample_by_count

# Fixed values of HTML.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "select")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p br h1 h2 h3 h4 h5 h6 blockquote pre b i em strong".split())
CONTENT = frozenset(("article", "main"))
NEVER = frozenset("nav aside footer form button head title dialog menu".split())
_BAD_NAME = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|comments?|discuss\w*|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"newsletter|subscribe|sidebar|side|widget|related|recommend\w*|share|sharing|social|menu|nav\w*|breadcrumbs?|footer|header|masthead|copyright|login|search|pagination|pager|tags?)(?:$|[\s_-])", re.I)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

# A quote opens a value only after "=", so values without quotes may hold one; possessive parts never go back.
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)>")
_BEGINS_TAG = re.compile(r"</?[A-Za-z]")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+>?", re.I) for name in RAW}
_ATTRIBUTE = re.compile(r"([^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")


@dataclass
class Weights:
    """Log odds of words by element and of tags by name; items never met have the defaults."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    word: float = 1.0
    tag: float = -1.0

    def of_word(self, element: str) -> float:
        return self.words.get(element, self.word)

    def of_tag(self, name: str) -> float:
        return self.tags.get(name, -0.05 if name.lstrip("/") in PROSE else self.tag)


def never(name: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never main text; ``inside`` is true within a content element."""
    if name in NEVER:
        return True
    if name == "header" and not inside:
        return True
    if not attributes:
        return False
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):  # the first of equal names counts
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if found.get("role", "").lower() in _BAD_ROLE or "hidden" in found or found.get("aria-hidden", "").lower() == "true":
        return True
    if name in ("body", "html", "p") or re.fullmatch("h[1-6]", name):
        return False
    named = f"{found.get('class', '')} {found.get('id', '')}"
    return bool(_BAD_NAME.search(named)) and not (name in CONTENT and "comment" not in named.lower())


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, text or name, attributes)`` in one forward scan: kind is ``text``, ``open``, ``close`` or ``raw`` (nothing to read).

    Comments, declarations and raw elements without an end run to the end of the page, as does a tag without ``>``.  Once quotes of a
    tag run over the end, tags end at their next ``>``.
    """
    at, quotes = 0, True
    while at < len(page):
        begin = page.find("<", at)
        if begin != at:
            yield "text", page[at:] if begin < 0 else page[at:begin], ""
        if begin < 0:
            return
        if page.startswith(("<!", "<?"), begin):
            mark = "-->" if page.startswith("<!--", begin) else ">"
            end = page.find(mark, begin + 2)
            yield "raw", "", ""
            at = len(page) if end < 0 else end + len(mark)
            continue
        tag = (_TAG if quotes else _PLAIN_TAG).match(page, begin)
        if tag is None and not _BEGINS_TAG.match(page, begin):
            yield "text", "<", ""
            at = begin + 1
            continue
        if tag is None and quotes:
            quotes, tag = False, _PLAIN_TAG.match(page, begin)
        if tag is None:
            yield "raw", "", ""
            return
        at, name = tag.end(), tag[2].lower()
        if not tag[1] and name in _RAW_END and not (name == "svg" and tag[3].endswith("/")):
            end = _RAW_END[name].search(page, at)
            yield "raw", "", ""
            at = end.end() if end else len(page)
        else:
            yield "close" if tag[1] else "open", name, tag[3]


class _Open:
    """Open elements, with a count per name so that a closing tag without a partner costs nothing."""

    def __init__(self) -> None:
        self.names: list[str] = []
        self.count: dict[str, int] = defaultdict(int)

    def push(self, name: str) -> None:
        self.names.append(name)
        self.count[name] += 1

    def pop(self) -> str:
        name = self.names.pop()
        self.count[name] -= 1
        return name

    def close(self, name: str) -> bool:
        """Closes up to and with the innermost element of the name, if there is one."""
        if not self.count[name]:
            return False
        while self.pop() != name:
            pass
        return True

    def clear(self) -> None:
        self.names.clear()
        self.count.clear()


_ENDS_P = ("p", "b", "i", "em", "strong", "span", "a")


def items(page: str | None) -> Iterator[tuple[str, str, str, bool, bool]]:
    """``(kind, name, text, left out, inside content)``: kind is ``tag``, ``text`` or ``raw``; a text's name is its element."""
    stack, skipping = _Open(), _Open()  # skipping: open elements since the outermost one that is left out

    def inside() -> bool:
        return stack.count["article"] > 0 or stack.count["main"] > 0

    for kind, name, attributes in tokens(page or ""):
        if kind == "text":
            yield "text", stack.names[-1] if stack.names else "", name, bool(skipping.names), inside()
        elif kind == "close":
            if skipping.names and not skipping.close(name) and name in ("body", "html", *CONTENT):
                skipping.clear()
            stack.close(name)
            yield "tag", "/" + name, "", bool(skipping.names), inside()
        elif kind == "open":
            bad = never(name, attributes, inside())
            if skipping.names and name in CONTENT and not bad and not inside():
                skipping.clear()  # an unclosed element before the content
            void = name in VOID or attributes.endswith("/")
            if (skipping.names or bad) and not void:
                skipping.push(name)
            if not void:
                if name == "p" and stack.names and stack.names[-1] in _ENDS_P:
                    while stack.names and stack.names[-1] in _ENDS_P:
                        stack.pop()
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack.names and stack.names[-1] == name:
                    stack.pop()
                stack.push(name)
            yield "tag", name, "", bool(skipping.names), inside()
        else:
            yield "raw", "", "", True, inside()


def main_text(page: str | None, weights: Weights) -> str:
    """Text of the maximum-scoring run."""
    seen = list(items(page))
    best = total = 0.0
    start = first = last = 0
    for k, (kind, name, text, out, inside) in enumerate(seen):
        if out and inside:
            pass  # left out of named content: no reason to end the run
        elif kind == "text":
            n = len(text.split())
            total += n * (-abs(weights.of_word(name)) if out else weights.of_word(name))
        elif kind == "tag":
            total += weights.of_tag(name)
        if total <= 0:
            total, start = 0.0, k + 1
        elif total > best:
            best, first, last = total, start, k + 1
    blocks: list[str] = []
    block: list[str] = []
    for kind, name, text, out, _ in seen[first:last]:
        if kind == "text" and not out:
            block.append(text)
        elif kind == "tag" and name.lstrip("/") not in INLINE:
            blocks.append("".join(block))
            block = []
        elif kind == "tag" and name == "br":
            block.append(" ")
    blocks.append("".join(block))
    clean = (" ".join(entities.unescape(b).split()) for b in blocks)
    return " ".join(b for b in clean if b)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for b in batches:
        for page in b.column(0).to_pylist():
            for kind, name, text, out, inside in items(page):
                if kind == "text":
                    counts["word", name, inside and not out] += len(text.split())
                elif kind == "tag":
                    counts["tag", name, inside and not out] += 1
    keys = [k for k in counts if len(k[1]) <= 40]
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.bool_()), pa.array([counts[k] for k in keys], pa.int64())],
        ["kind", "name", "inside", "n"])


def fit(pages: DataFrame, html: str = "html", rows: int = 5000, names: int = 500) -> Weights:
    """Weights from pages that name their content; the ``names`` most frequent items are kept."""
    page = F.col(html)
    known = pages.select(page.alias("_html")).filter(F.lower(page).rlike("<(article|main)[\\s>]")).withColumn("_one", F.lit(1))
    known = sample_by_count(known, "_one", rows, F.col("_html")).select("_html")
    counted = known.mapInArrow(_counts, "kind string, name string, inside boolean, n long").groupBy("kind", "name").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("no"))
    found = counted.orderBy(F.desc(F.col("yes") + F.col("no")), "kind", "name").limit(names).collect()
    out = Weights()
    yes, no = (sum(r[c] for r in found if r["kind"] == "word") for c in ("yes", "no"))
    if not yes or not no:
        return out
    for r in found:
        odds = log((r["yes"] + 0.5) / (yes + 1)) - log((r["no"] + 0.5) / (no + 1))
        if r["kind"] == "word":  # at least a tenth, so long content is never cut by its own words
            out.words[r["name"]] = max(0.1, min(3.0, odds)) if r["yes"] >= r["no"] else max(-3.0, min(0.1, odds))
        else:  # tags are never better than neutral
            out.tags[r["name"]] = min(-0.05, max(-4.0, odds))
    return out


def extract(weights: Weights, html: Column) -> Column:
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p, weights) for p in batch], index=batch.index, dtype=object)

    return run(html)
