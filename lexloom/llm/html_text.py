"""Main text of web pages as the maximum-scoring subsequence of their tokens.

A page becomes a sequence of tags and runs of words. Every word scores by the open elements around it (tag names, parts of class, id,
role and label, each also by whether it stands within an article or main) and by its block (link density, length, end of a sentence);
every tag by its name. Weights are learned on labelled pages (html_labels.py): words score the log-odds that all elements around them and their block pass, fitted
as a noisy AND of logistic models, so content words score positive and boilerplate words negative; tags score log-odds, never
above a small cost. A linear scan (Kadane) finds the contiguous region with the highest sum; runs that score negative inside the region
are left out of its text. No list of names decides: a name only counts as much as the labelled pages taught.

A negative run costs as INSET words at most, so an advert does not part an article.
Scripts, styles, templates, comments and head elements hold no words.

Text: character references decoded, white space in a block made one space, blocks joined in page order by one line feed.
A block ends at any tag that is not inline; <br> is white space.

Defined results: a null or empty page, or one without a positive region, gives an empty text; unclosed elements end as HTML
implies, with their parent or the page; a tie between regions takes the first, the shorter one; repeated rows give equal texts; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lexloom.llm import html_labels
from lexloom.llm.common import small_batches

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|select|object|canvas|math)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)>"
    r"|<[!?][^>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
#: elements that a tag ends if it finds them open below the given parents
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words that a run of boilerplate costs at most; bounds of a word's score; least and greatest cost of a tag.
INSET, BOUND, TAG, TAG_MOST = 4, 2.0, 0.05, 0.25


@dataclass
class Run:
    """A tag, or words between tags: features of each element around words, whether in an article or main, and the block's number."""

    name: str
    text: str = ""
    context: tuple[tuple[str, ...], ...] = ()
    inside: bool = False
    block: int = 0


def element_features(name: str, attrs: str, inside: bool, nested: bool) -> list[tuple[str, ...]]:
    """What an element says of the words in it: a set of features for each of its names (class, id, role, label), or one for
    its tag alone. A tag with names is a feature of its own beside each of them."""
    places = ("", "@in") if inside else ("",)
    named = []
    if attrs:
        for key, a, b, c in _ATTR.findall(attrs):
            for token in (a or b or c).split():
                token = _CAMEL.sub("-", token).lower()
                parts = _PARTS.findall(token)
                names = [f".{p}" for p in (*parts, "-".join(parts))] + [f"role={token}"] * (key.lower() == "role") + [f"<{name}>."]
                named.append(tuple(dict.fromkeys(n + p for n in names for p in places)))
    if not named and name not in INLINE:
        named.append(tuple(f"<{name}>{p}" for p in places))
    if nested:
        named.append(("<article>@article",))
    return named


def runs_of(page: str) -> list[Run]:
    """Tags and word runs of a page in order."""
    out: list[Run] = []
    open_: list[tuple[str, tuple[tuple[str, ...], ...], bool]] = []  # element, features of each open one, in an article or main
    at, block = 0, 0

    def words(text: str) -> None:
        if text and not text.isspace():
            context, inside = (open_[-1][1], open_[-1][2]) if open_ else ((), False)
            out.append(Run("", text, context, inside, block))

    def end(names: set[str], bounds: set[str]) -> None:
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in names:
                del open_[i:]
                return
            if open_[i][0] in bounds:
                return

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            words(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name not in INLINE:
            block += 1
        out.append(Run(name, block=block))
        if m["close"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    del open_[i:]
                    break
            continue
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if name not in INLINE:  # a block ends an open paragraph
            i = len(open_) - 1
            while i >= 0 and open_[i][0] in INLINE:
                i -= 1
            if i >= 0 and open_[i][0] == "p":
                del open_[i:]
        if name in _ENDS:
            end(*_ENDS[name])
        context, inside = (open_[-1][1], open_[-1][2]) if open_ else ((), False)
        nested = name == "article" and any(n == "article" for n, *_ in open_)
        more = element_features(name, m["attrs"], inside, nested)
        if more:
            context = (*context, *(f for f in more if f not in context))
        open_.append((name, context, inside or name in CONTENT))
    if at < len(page):
        words(page[at:])
    return out


def block_features(parts: list[Run], linked: list[bool], inside: bool) -> tuple[str, ...]:
    """What the shape of a block says: words in links, length, and whether it ends like a sentence."""
    sizes = [len(r.text.split()) for r in parts]
    n = sum(sizes)
    share = sum(s for s, a in zip(sizes, linked) if a) / max(n, 1)
    place = "@in" if inside else ""
    links = "all" if share > 0.8 else "many" if share > 0.4 else "few" if share > 0 else "none"
    length = next(k for k, most in (("1", 2), ("2", 6), ("3", 14), ("4", 40), ("5", math.inf)) if n <= most)
    ends = parts[-1].text.rstrip()[-1:] in ".!?:;\"'”»…。"
    return f"links={links}", f"links={links}{place}", f"length={length}{place}", f"sentence={ends}{place}"


def described(page: str) -> tuple[list[Run], dict[int, tuple[str, ...]]]:
    """Runs of a page, and the features of each block that has words."""
    runs = runs_of(page)
    blocks: dict[int, tuple[list[Run], list[bool]]] = {}
    in_link = False
    for r in runs:
        if r.name == "a":
            in_link = not in_link
        elif r.name and r.name not in INLINE:
            in_link = False
        elif not r.name:
            parts, linked = blocks.setdefault(r.block, ([], []))
            parts.append(r)
            linked.append(in_link)
    return runs, {k: block_features(parts, linked, parts[0].inside) for k, (parts, linked) in blocks.items()}


class Weights:
    """Learned weights of the features of elements and blocks, and of tags; elements, contexts and blocks are scored once each.

    Words are content if every element around them and their block pass: the chance of each is logistic in its features, that of
    the words their product (a noisy AND), so no amount of paragraphs makes an advert content.
    """

    def __init__(self, features: dict[str, float], tags: dict[str, float]):
        self.features, self.tags = features, tags
        self._passes: dict[tuple, float] = {}

    def passes(self, element: tuple[str, ...]) -> float:
        """Log of the chance that an element or block passes."""
        found = self._passes.get(element)
        if found is None:
            found = self._passes[element] = -math.log1p(math.exp(-max(-30.0, sum(self.features.get(f, 0.0) for f in ("", *element)))))
        return found

    def context(self, elements: tuple[tuple[str, ...], ...]) -> float:
        found = self._passes.get(elements)
        if found is None:
            if len(self._passes) > 50_000:
                self._passes.clear()
            found = self._passes[elements] = sum(map(self.passes, elements))
        return found

    def run(self, r: Run, block: tuple[str, ...]) -> float:
        """Score of each word of a run: the log-odds of its chance, bounded."""
        x = min(self.context(r.context) + self.passes(block), -1e-9)
        return max(-BOUND, min(BOUND, x - math.log(-math.expm1(x))))

    def tag(self, name: str) -> float:
        return self.tags.get(name, -TAG)


def fit(pages: list[str], ridge: float = 1e-5, steps: int = 400, rate: float = 0.1) -> Weights:
    """Weights from labelled pages: Adam steps on the likelihood of the noisy AND over all runs, log-odds of tags."""
    seen, inside, outside = {}, Counter(), Counter()  # seen: runs and content runs of each set of elements
    for page in pages:
        marked = [html_labels.MARK in r.text for r in runs_of(page)]
        runs, blocks = described(page.replace(html_labels.MARK, ""))
        on = [i for i, m in enumerate(marked) if m]
        for i, (r, m) in enumerate(zip(runs, marked)):
            if not r.name:
                n = seen.setdefault((*r.context, blocks[r.block]), [0, 0])
                n[0] += 1
                n[1] += m
            elif on and on[0] <= i <= on[-1]:
                inside[r.name] += 1
            else:
                outside[r.name] += 1
    elements = {e: i for i, e in enumerate(dict.fromkeys(e for row in seen for e in row))}
    names = {f: i for i, f in enumerate(["", *sorted({f for e in elements for f in e})])}
    has = np.zeros((len(elements), len(names)))
    has[:, 0] = 1
    for e, i in elements.items():
        has[i, [names[f] for f in e]] = 1
    row = np.repeat(np.arange(len(seen)), [len(r) for r in seen])
    col = np.array([elements[e] for r in seen for e in r])
    n, y = np.array(list(seen.values()), float).T
    w, mean, square = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
    w[0] = 1.0
    for step in range(1, steps + 1):
        s = np.clip(has @ w, -30, 30)
        log_p = -np.log1p(np.exp(-s))
        x = np.minimum(np.bincount(row, log_p[col], len(seen)), -1e-9)
        pull = y - (n - y) * np.exp(x) / -np.expm1(x)  # of each row on the log chance of its elements
        grad = has.T @ (np.bincount(col, pull[row], len(elements)) * (1 - np.exp(log_p))) / n.sum() - ridge * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        w += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    a, b = inside.total() + len(inside | outside), outside.total() + len(inside | outside)
    tags = {t: max(-TAG_MOST, min(-TAG, math.log((inside[t] + 1) / a) - math.log((outside[t] + 1) / b))) for t in inside | outside}
    return Weights({f: float(w[i]) for f, i in names.items()}, tags)


@lru_cache(maxsize=1)
def learned_weights() -> Weights:
    return fit(html_labels.pages())


def _clean(text: str) -> str:
    return _SPACE.sub(" ", unescape(text)).strip()


def region(scores: list[float]) -> tuple[int, int]:
    """The maximum-scoring contiguous part of scores as (start, end exclusive); (0, 0) if nothing is positive."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, best_at = total, (start, i + 1)
    return best_at


def scored(page: str, weights: Weights) -> tuple[list[Run], list[float], list[bool]]:
    """Runs of a page, their scores, and whether each one's words are content by themselves."""
    runs, blocks = described(page)
    each = [0.0 if r.name else weights.run(r, blocks[r.block]) for r in runs]
    good = {r.block for r, w in zip(runs, each) if w > 0}
    scores = []
    for r, w in zip(runs, each):
        n = len(r.text.split())
        cost = 0 if r.block in good else min(n, INSET)  # within a block of content, what is left out costs nothing
        scores.append(weights.tag(r.name) if r.name else w * (n if w > 0 else cost))
    return runs, scores, [w > 0 for w in each]


def main_text(page: str | None, weights: Weights | None = None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    runs, scores, content = scored(page, learned_weights() if weights is None else weights)
    lo, hi = region(scores)
    blocks: dict[int, list[str]] = {}
    for r, keep in zip(runs[lo:hi], content[lo:hi]):
        if keep:
            blocks.setdefault(r.block, []).append(r.text)
        elif r.name == "br" and r.block in blocks:
            blocks[r.block].append(" ")
    return "\n".join(t for b in blocks.values() if (t := _clean("".join(b))))


def extract_text(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the main text of every page, from its whole html, in place of the html column."""
    small_batches(pages.sparkSession)
    keep = [c for c in pages.columns if c not in (html, into)]

    sent = pages.sparkSession.sparkContext.broadcast(learned_weights())  # some hundred weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = sent.value
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string())], [*keep, into])

    rows = pages.select(*keep, html)
    return rows.mapInArrow(run, T.StructType([*(rows.schema[c] for c in keep), T.StructField(into, T.StringType())]))
