"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive and tags negative; one scan finds the
contiguous region of the greatest sum. How much a tag costs is learnt from labelled pages, which are
those whose own markup delimits the content (one ``article``, or else one ``main``): a tag costs more
the more often it stands outside the content and the less often inside. Elements of kinds that
hold no article text (menus, adverts, forms, comments ...), whether from the fixed lists or found by
the labelled pages to hold words outside the content only, are holes: the region may span them,
but their words neither score nor count as text.

With ``lists`` the fixed lists of such kinds are used, for learning and for extraction: tags within
listed elements then teach nothing, as they are never scored. Without ``lists`` all but elements without
text is scored, and what the labelled pages teach decides alone. The lists are needed for what stands
inside a page's own content element, such as adverts, forms and comments: the labels call it content.
"""

from __future__ import annotations

import html
import math
import re
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuewright.llm._shared import small_batches, written

MIN_SEEN = 20
MOST_FEATURES = 50_000
WORD = 1.0
UNSEEN = 0.02
SCALE = 6.0

# Element names without article text, class and id words that mark such elements,
# elements whose content is not text at all, elements that begin a block of their own.
HOLES = frozenset("nav header footer aside form menu dialog button select option label fieldset input".split())
HOLE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox sponsor sponsored promo promotion banner
    nav navbar navigation menu breadcrumb breadcrumbs sidebar rail widget widgets toc pager pagination
    header masthead topbar footer copyright legal cookie cookies consent gdpr notice notification alert
    popup modal overlay newsletter subscribe subscription signup login paywall share sharing social
    related recommended recommendations trending popular comment comments commentlist
    replies reply respond disqus discussion respond search searchbox skip skiplink tags tagcloud""".split()
)
# Those of the words that name nothing else, wherever they stand; the others may name a part of an article as well.
SURE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adbox sponsor sponsored newsletter paywall consent gdpr
    comment comments commentlist disqus""".split()
)
CONTROLS = frozenset("form input button select textarea fieldset option label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAST_PROSE = 15
DEAD = frozenset("script style noscript template svg math iframe object embed canvas head title textarea audio video map".split())
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
    optgroup option p pre section summary table tbody td tfoot th thead tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|template|iframe)\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</\1\s*>|\Z)"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?][^>]*>|<[!?/a-zA-Z][^>]*\Z""",
    re.DOTALL | re.IGNORECASE,
)
_MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_MARK_WORD = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+")

Token = tuple[str, str, tuple[str, ...]]  # kind "t" text, "o" open, "c" close; text or name; class words


def tokens(page: str) -> list[Token]:
    """Text runs and tags in page order; comments and elements without text are left out."""
    out: list[Token] = []
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(("t", page[at : m.start()], ()))
        at = m.end()
        if name := m[3]:
            name = name.lower()
            if m[2]:
                out.append(("c", name, ()))
            else:
                words: tuple[str, ...] = ()
                if "=" in m[4]:
                    words = tuple(w for found in _MARKS.findall(m[4]) for w in map(str.lower, _MARK_WORD.findall("".join(found))))
                out.append(("o", name, words))
                if m[4].endswith("/") and name not in VOID:
                    out.append(("c", name, ()))
    if at < len(page):
        out.append(("t", page[at:], ()))
    return out


def _ends(page: list[Token]) -> dict[int, int]:
    """For each opening tag that is closed, the place of its closing tag. A ``p`` or ``li`` also ends
    before the next block or item."""
    ends: dict[int, int] = {}
    open_: dict[str, list[int]] = {}
    for i, (kind, name, _) in enumerate(page):
        if kind == "t":
            continue
        if name in BLOCKS and open_.get("p") and (kind == "o" or name != "p"):
            for k in open_.pop("p"):
                ends[k] = i - 1
        if kind == "o" and name not in VOID:
            if name == "li" and open_.get("li") and not any(page[k][1] in ("ul", "ol") for k in range(open_["li"][-1], i) if page[k][0] == "o"):
                ends[open_["li"].pop()] = i - 1
            open_.setdefault(name, []).append(i)
        elif kind == "c" and open_.get(name):
            ends[open_[name].pop()] = i
    return ends


def features(name: str, words: tuple[str, ...]) -> list[str]:
    return [name, *(f"{name}.{w}" for w in words)]


@dataclass
class Weights:
    """What the labelled pages teach: the cost of tags by feature, and features of holes."""

    costs: dict[str, float] = field(default_factory=dict)
    holes: frozenset[str] = frozenset()
    lists: bool = True

    def is_hole(self, name: str, words: tuple[str, ...], inside: bool, around: bool, prose: bool = False) -> bool:
        """``inside``: the element lies in the page's own content element; ``around``: it holds one, or a title; ``prose``: it reads
        as a part of an article. Inside the content element a listed word does not decide against prose, unless it is a sure one."""
        if name in HOLES and self.lists:
            return not (name == "header" and inside)
        if around or not words or name in ("html", "body", "article", "main"):
            return False
        if inside and prose and SURE_WORDS.isdisjoint(words):
            return False
        return (self.lists and not HOLE_WORDS.isdisjoint(words)) or not self.holes.isdisjoint(features(name, words)[1:])

    def cost(self, name: str, words: tuple[str, ...]) -> float:
        return max(self.costs.get(f, UNSEEN) for f in features(name, words))


def _masked(page: list[Token], ends: dict[int, int], weights: Weights) -> bytearray:
    """1 for tokens in holes and in elements without text."""
    mask = bytearray(len(page))
    content = [i for i, (k, n, _) in enumerate(page) if k == "o" and n in ("article", "main") and i in ends]
    spans = [(i, ends[i]) for i in content]
    titles = [0]
    for kind, name, _ in page:
        titles.append(titles[-1] + (kind == "o" and name in ("article", "main", "h1")))
    prose = _prose(page, ends) if spans else None
    i = 0
    while i < len(page):
        kind, name, words = page[i]
        if kind == "o" and (end := ends.get(i)):
            inside = any(a < i < b for a, b in spans)
            if name in DEAD or weights.is_hole(name, words, inside, titles[end] > titles[i], bool(inside and words and prose and prose(i, end))):
                mask[i : end + 1] = b"\1" * (end + 1 - i)
                i = end
        i += 1
    return mask


def _prose(page: list[Token], ends: dict[int, int]) -> Callable[[int, int], bool]:
    """Whether an element, from its opening to its closing tag, reads as a part of an article: no controls, few words in links, and
    ``LEAST_PROSE`` words or a heading with a paragraph."""
    sums = [(0, 0, 0, 0, 0)]  # words, those in links, controls, headings, paragraphs
    linked = -1
    for i, (kind, name, _) in enumerate(page):
        n = len(name.split()) if kind == "t" else 0
        opens = kind == "o"
        if opens and name == "a":
            linked = max(linked, ends.get(i, i))
        a, b, c, d, e = sums[-1]
        sums.append((a + n, b + n * (i <= linked), c + (opens and name in CONTROLS), d + (opens and name in HEADINGS), e + (opens and name == "p")))

    def reads(start: int, end: int) -> bool:
        words, links, controls, headings, paragraphs = (z - a for a, z in zip(sums[start], sums[end], strict=True))
        return not controls and 3 * links <= words and (words >= LEAST_PROSE or (headings > 0 and paragraphs > 0))

    return reads


def _labelled(page: list[Token], ends: dict[int, int]) -> tuple[int, int] | None:
    """The content that the page's own markup delimits, if it does so once."""
    for name in ("article", "main"):
        found = [i for i, t in enumerate(page) if t[0] == "o" and t[1] == name and i in ends]
        if len(found) == 1:
            return found[0], ends[found[0]]
    return None


def observe(page: str, seen: Counter, lists: bool = True) -> None:
    """Add a page's counts to ``seen``, if the page is labelled: (feature, inside) -> tags outside listed holes,
    (feature + " words", inside) -> words of closed elements by their classes, in listed holes too."""
    page_ = tokens(page)
    ends = _ends(page_)
    label = _labelled(page_, ends)
    if label is None:
        return
    mask, dead = _masked(page_, ends, Weights(lists=lists)), _masked(page_, ends, Weights(lists=False))
    low, high = label
    sizes = [len(t[1].split()) if t[0] == "t" else 0 for t in page_]
    sums = [0]
    for n in sizes:
        sums.append(sums[-1] + n)
    stack: list[tuple[str, tuple[str, ...]]] = []
    for i, (kind, name, words) in enumerate(page_):
        if kind == "t" or dead[i]:
            continue
        if kind == "o":
            if name not in VOID:
                stack.append((name, words))
        else:
            while stack and stack[-1][0] != name:
                stack.pop()
            words = stack.pop()[1] if stack else ()
        inside = low < i < high
        if not mask[i]:
            for f in features(name, words):
                seen[f, inside] += 1
        if kind == "o" and words and (end := ends.get(i)):
            for f in features(name, words)[1:]:
                seen[f + " words", inside or i <= low <= end] += sums[end] - sums[i]


def learnt(seen: dict[tuple[str, bool], int], lists: bool = True) -> Weights:
    """Costs are log ratios of a tag's counts outside and inside; holes are features with words outside only."""
    names = {f for f, _ in seen}
    costs, holes = {}, set()
    for f in names:
        inside, outside = seen.get((f, True), 0), seen.get((f, False), 0)
        if f.endswith(" words"):
            if not inside and outside >= MIN_SEEN:
                holes.add(f.removesuffix(" words"))
        elif inside + outside >= MIN_SEEN:
            costs[f] = UNSEEN + SCALE * max(0.0, math.log((outside + 1) / (inside + 1)))
    return Weights(costs, frozenset(holes), lists)


def _totals(pages: DataFrame, html_col: str, lists: bool) -> DataFrame:
    """``(feature, i, o)``: the counts inside and outside of all features seen often enough on labelled
    pages. Counts are summed in each task before they move."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                observe((page or b"").decode("utf-8", "replace"), seen, lists)
            if len(seen) > 100_000:
                yield flush(seen)
        yield flush(seen)

    def flush(seen: Counter) -> pa.RecordBatch:
        rows = list(seen.items())
        seen.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([f for (f, _), _ in rows], pa.string()), pa.array([b for (_, b), _ in rows], pa.bool_()), pa.array([n for _, n in rows], pa.int64())],
            names=["feature", "inside", "n"],
        )

    counts = pages.select(F.col(html_col).cast("binary")).mapInArrow(run, "feature string, inside boolean, n long")
    total = counts.groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("o"))
    return total.where(f"i + o >= {MIN_SEEN}")


def _learnt_rows(rows: list, lists: bool = True) -> Weights:
    return learnt({(r["feature"], inside): r[c] for r in rows for inside, c in ((True, "i"), (False, "o"))}, lists)


def train(pages: DataFrame, html_col: str = "html", lists: bool = True) -> Weights:
    """Weights of all features from all labelled pages, on the driver. No labelled page: no costs learnt."""
    return _learnt_rows(_totals(pages, html_col, lists).collect(), lists)


def _split(pages: DataFrame, html_col: str, most_features: int, lists: bool = True) -> tuple[Weights, DataFrame | None, frozenset[str]]:
    """Weights of the ``most_features`` most frequent features, those of all others as ``(feature, cost, hole)``
    if there are any, and in that case the names of the former."""
    total = written(_totals(pages, html_col, lists), "features")
    rows = total.orderBy(F.desc(F.col("i") + F.col("o")), "feature").limit(most_features + 1).collect()
    weights = _learnt_rows(rows[:most_features], lists)
    if len(rows) <= most_features:
        return weights, None, frozenset()
    last = rows[most_features]
    n = last["i"] + last["o"]
    rest = total.where((F.col("i") + F.col("o") < n) | ((F.col("i") + F.col("o") == n) & (F.col("feature") >= last["feature"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _learnt_rows(batch.to_pylist())
            # What costs no more than an unseen feature need not be looked up.
            found = [(f, c, False) for f, c in own.costs.items() if c != UNSEEN] + [(f, None, True) for f in own.holes]
            columns = list(zip(*found, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.float64(), pa.bool_()), strict=True)], names=["feature", "cost", "hole"])

    return weights, written(rest.select("feature", "i", "o").mapInArrow(run, "feature string, cost double, hole boolean"), "rare"), frozenset(r["feature"] for r in rows[:most_features])


def _rare(slim: DataFrame, known: frozenset[str], rest: DataFrame) -> DataFrame:
    """``slim(id, url, html, ka, kb)`` with ``rare``, the weights in ``rest`` of the page's own features;
    frequent features, which are ``known``, are not looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for ka, kb, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = {f for kind, name, words in tokens((page or b"").decode("utf-8", "replace")) if kind != "t" for f in features(name, words)}
                rows += [(ka, kb, f) for f in sorted(own) if f not in known or ("." in f and f + " words" not in known)]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["ka", "kb", "feature"])

    asked = slim.select("ka", "kb", "html").mapInArrow(run, "ka long, kb int, feature string")
    met = asked.join(rest.hint("merge"), "feature").groupBy("ka", "kb").agg(F.collect_set(F.struct("feature", "cost", "hole")).alias("rare"))
    return slim.join(met.hint("merge"), ["ka", "kb"], "left").select("id", "url", "html", "rare")


def _with(weights: Weights, rare: list | None) -> Weights:
    """``weights`` and those of the page's rare features."""
    if not rare:
        return weights
    costs = ChainMap({r["feature"]: r["cost"] for r in rare if not r["hole"]}, weights.costs)
    return Weights(costs, weights.holes | {r["feature"] for r in rare if r["hole"]}, weights.lists)


def best_region(scores: list[float]) -> tuple[int, int]:
    """The half-open range of the greatest sum, the first of equals; (0, 0) if no score is positive."""
    best, at, sum_, start = 0.0, (0, 0), 0.0, 0
    for i, x in enumerate(scores):
        if sum_ <= 0:
            sum_, start = 0.0, i
        sum_ += x
        if sum_ > best:
            best, at = sum_, (start, i + 1)
    return at


def main_text(page: str, weights: Weights) -> str:
    """The page's main text: blocks in page order joined by one newline, white space within a block
    one space, character references decoded. Empty if there is none."""
    page_ = tokens(page)
    ends = _ends(page_)
    mask = _masked(page_, ends, weights)
    texts = [html.unescape(t[1]) if t[0] == "t" and not mask[i] else "" for i, t in enumerate(page_)]
    scores = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    for i, (kind, name, words) in enumerate(page_):
        if mask[i]:
            scores.append(0.0)
        elif kind == "t":
            scores.append(WORD * len(texts[i].split()))
        else:
            if kind == "o":
                if name not in VOID:
                    stack.append((name, words))
            elif any(name == n for n, _ in stack):
                while stack[-1][0] != name:
                    stack.pop()
                words = stack.pop()[1]
            scores.append(-weights.cost(name, words))
    low, high = best_region(scores)
    blocks, run = [], []
    for i in range(low, high):
        kind, name, _ = page_[i]
        if kind == "t":
            if not mask[i]:
                run.append(texts[i])
        elif name in BLOCKS:
            blocks.append(run)
            run = []
        elif name == "br":
            run.append(" ")
    blocks.append(run)
    return "\n".join(x for x in (" ".join("".join(run).split()) for run in blocks) if x)


def extract(
    pages: DataFrame, weights: Weights | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_features: int = MOST_FEATURES, lists: bool = True
) -> DataFrame:
    """``id_col, url_col, text, n_chars`` for every row of ``pages``, repeated rows and null ids included.

    Null and empty pages give an empty text. ``weights`` are learnt from ``pages`` if not given: those of
    the ``most_features`` most frequent features go to all tasks, those of all others are joined to
    the pages that have them, so the texts do not depend on the number. ``lists``: see above. Pages of any
    length are read whole. Other columns are not read.
    """
    small_batches(pages.sparkSession)
    weights, rest, known = _split(pages, html_col, most_features, lists) if weights is None else (weights, None, frozenset())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rare = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            texts = [main_text((p or b"").decode("utf-8", "replace"), _with(weights, r)) for p, r in zip(batch.column(2).to_pylist(), rare, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["id", "url", "text", "n_chars"])

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("binary").alias("html"))
    if rest is not None:
        slim = _rare(slim.withColumns({"ka": F.xxhash64("html"), "kb": F.hash("html")}), known, rest)
    return slim.mapInArrow(run, f"id {kinds[0]}, url {kinds[1]}, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
