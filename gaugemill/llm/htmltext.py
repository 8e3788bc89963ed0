"""Main text of raw pages: the contiguous stretch of a page with the greatest sum of word and tag scores."""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugemill.llm.common import map_texts

# Names that HTML and common page templates give to what is not an article.
RAW = "script style noscript template iframe textarea title svg math select object canvas"
LEFT_OUT = "nav footer aside form button dialog menu head fieldset label option datalist"
ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
CLASSES = (
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead topbar ad ads advert advertisement adverts "
    "advertising sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social related recommended recommendations "
    "comment comments commentlist disqus reply replies respond discussion pagination pager toolbar widget widgets banner "
    "skip copyright"
)
#: Of these, what names readers' comments; and ids of sections that no article's heading makes.
COMMENTS = "comment comments commentlist disqus reply replies respond discussion"
SECTION_IDS = "nav navbar breadcrumb breadcrumbs sidebar masthead topbar ad ads advert adverts newsletter comment comments commentlist disqus respond"
CONTAINERS = "section div ol ul li"
HEADINGS = "h1 h2 h3 h4 h5 h6"
VOID = "area base br col embed hr img input link meta param source track wbr"
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr td th button input label progress meter output"
)
#: Elements that an opening tag ends if they are still open.
ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
ENDS_P = (
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main "
    "nav ol p pre section table ul"
)

_RAW, _LEFT_OUT, _ROLES, _CLASSES, _VOID, _INLINE, _ENDS_P = (
    frozenset(s.split()) for s in (RAW, LEFT_OUT, ROLES, CLASSES, VOID, INLINE, ENDS_P))
_COMMENTS, _SECTION_IDS, _CONTAINERS, _HEADINGS = (frozenset(s.split()) for s in (COMMENTS, SECTION_IDS, CONTAINERS, HEADINGS))
_COMMENT_NAME = re.compile(r"(?:comment|reply)(?:[_-].*)?|comments|replies", re.S)
_COMMENT_ID = re.compile(r"(?:comment|reply)(?:[_-]?\d+)?")
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(sorted(_RAW)) + r")\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?][^>]*>",
    re.S | re.I)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

#: The feature of all that lies in an element that is left out.
LEFT = "left"
#: Limits of a learned weight, and what stands in for features that no labelled page shows.
LARGEST, UNSEEN_WORD, UNSEEN_TAG, LEAST = 3.0, 1.0, -0.2, 0.01


@dataclass
class Page:
    """What a page's markup turns into: steps in page order, each a feature, a count and, for text, block and string."""

    features: list[str] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)
    inside: list[bool] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    labelled: bool = False


def _left_out(name: str, attributes: str, in_article: bool) -> bool:
    if name in _LEFT_OUT or name == "header" and not in_article:
        return True
    if not attributes or name in ("html", "body", "article", "main"):
        return False
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if key in ("class", "id"):
            tokens = set(re.split(r"[\s_-]+", value))
            if key == "id" and in_article and name in _HEADINGS:
                continue  # made from the heading's words
            if key == "id" and in_article and name == "section":
                if tokens <= _SECTION_IDS:
                    return True
            elif not _CLASSES.isdisjoint(tokens):
                return True
        if key == "role" and value in _ROLES or key == "aria-hidden" and value == "true":
            return True
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def _of_comments(name: str, attributes: str) -> bool:
    """Whether an article is a reader's comment, or a container is one of comments."""
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'").lower()
        if name == "article":
            if key == "class" and any(map(_COMMENT_NAME.fullmatch, value.split())) or key == "id" and _COMMENT_ID.fullmatch(value):
                return True
        elif name in _CONTAINERS and key in ("class", "id") and not _COMMENTS.isdisjoint(re.split(r"[\s_-]+", value)):
            return True
    return False


def parse(source: str) -> Page:
    """Steps of a page. A tag's feature is its name, a text's the element around it. An element that is left out is one
    step, its opening tag; what it holds is worth nothing either way.

    ``<br>`` begins a line of its own, as a block does. The time is linear in the page: the open elements that a step may ask for are
    found from stacks of their places, never by going through all that are open."""
    page, end, block = Page(), 0, 0
    open_: list[tuple[str, bool, bool]] = []  # name, left out, part of an article
    threads: list[bool] = []  # of each open element: left out as comments, or in one that is
    places: defaultdict[str, list[int]] = defaultdict(list)  # of open elements, by name
    solid: list[int] = []  # places of open elements that are no inline ones
    outs: list[int] = []  # of those left out
    marks: list[int] = []  # of articles and mains

    def close(at: int) -> None:
        while len(open_) > at:
            name = open_.pop()[0]
            threads.pop()
            for held in (places[name], solid, outs, marks):
                if held and held[-1] == len(open_):
                    held.pop()

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            name, out, article = open_[-1] if open_ else ("body", False, False)
            piece = html.unescape(piece)
            around = open_[solid[-1]][0] if solid else "body"
            page.features.append(LEFT if out else "word:" + around)
            page.counts.append(len(piece.split()))
            page.inside.append(article)
            page.blocks.append(block)
            page.texts.append("" if out else piece)
        elif piece and page.texts and page.blocks[-1] == block:
            page.texts[-1] += " "

    for found in _MARKUP.finditer(source):
        text(source[end:found.start()])
        end = found.end()
        name = (found[3] or found[6] or "").lower()
        if not name:
            continue
        closing, attributes = found[2] or found[5], found[4] or found[7] or ""
        if name not in _INLINE:
            block += 1
        elif name in ("td", "th") and page.texts and page.blocks[-1] == block:
            page.texts[-1] += " "
        out, article = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
        begins = False
        if closing:
            if places[name]:
                out = open_[places[name][-1]][1]
                close(places[name][-1])
        elif name not in _VOID and not attributes.endswith("/"):
            ends = ENDED_BY.get(name, set()) | ({"p"} if name in _ENDS_P else set())
            if open_ and open_[-1][0] in _INLINE and "p" in ends:  # an inline element left open ends with its paragraph
                if solid and open_[solid[-1]][0] == "p":
                    close(solid[-1])
            elif open_ and open_[-1][0] in ends:
                close(len(open_) - 1)
            if name == "body":
                close(0)
            comment = name == "article" and (_of_comments(name, attributes) or bool(threads and threads[-1]))
            if name in ("article", "main") and not comment:
                if outs and not (marks and marks[0] < outs[0]):
                    close(outs[0])  # what was left out never ended; an article is not part of it
                page.labelled = True
            out, article = (open_[-1][1], open_[-1][2]) if open_ else (False, False)
            article = article or name in ("article", "main") and not comment
            within, out = out, out or comment or _left_out(name, attributes, article)
            for held, belongs in ((places[name], True), (solid, name not in _INLINE), (outs, out), (marks, name in ("article", "main"))):
                if belongs:
                    held.append(len(open_))
            open_.append((name, out, article))
            threads.append(bool(threads and threads[-1]) or comment or out and _of_comments(name, attributes))
            begins = out and not within
        page.features.append("left:" + name if begins else LEFT if out else "tag:" + name)
        page.counts.append(1)
        page.inside.append(article)
        page.blocks.append(block)
        page.texts.append("")
    text(source[end:])
    return page


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Start and end of the contiguous stretch with the greatest positive sum, the first of equals; empty if none is."""
    best, best_at, total, start = 0.0, (0, 0), 0.0, 0
    for at, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, at
        total += score
        if total > best:
            best, best_at = total, (start, at + 1)
    return best_at


def main_text(source: str, weights: dict[str, float]) -> str:
    page = parse(source)
    scores = []
    for feature, count, inside in zip(page.features, page.counts, page.inside, strict=True):
        word = feature.startswith("word:")
        score = 0.0 if feature == LEFT else weights.get(feature, UNSEEN_WORD if word else UNSEEN_TAG)
        if page.labelled:  # a page that marks its article itself has no other, and nothing in that article divides it
            score = -LARGEST if not inside else -LEAST if feature.startswith("left:") else score
        scores.append(score * count)
    start, end = best_stretch(scores)
    if start == end:
        return ""
    # whole blocks: a stretch that starts or ends between inline tags takes the rest of their block
    first, last = page.blocks[start], page.blocks[end - 1]
    inside = [at for at, b in enumerate(page.blocks) if first <= b <= last and page.texts[at]
              and (page.inside[at] or not page.labelled)]
    joined: dict[int, list[str]] = {}
    for at in inside:
        joined.setdefault(page.blocks[at], []).append(page.texts[at])
    lines = (" ".join("".join(parts).split()) for parts in joined.values())
    return "\n".join(line for line in lines if line)


def learn_weights(pages: DataFrame, html_col: str = "html", labelled_pages: int = 2000) -> dict[str, float]:
    """Weight of each feature: log odds of lying in the article, from pages that mark one (article or main).

    At most ``labelled_pages`` different pages, those with the smallest hashes of their source, are read for it: one pass finds
    the hash that bounds them, and only pages within it take part in the second. A page that repeats counts once. Words weigh at
    least LEAST, tags and elements that are left out at most -LEAST. Without labelled pages all weights are the defaults.
    """
    marked = pages.where(F.col(html_col).rlike(r"(?i)<(article|main)[\s>]")).select(F.xxhash64(html_col).alias("_hash"), html_col)
    last = marked.select("_hash").distinct().orderBy("_hash").limit(labelled_pages).agg(F.max("_hash")).first()[0]
    sample = (
        marked.where(F.col("_hash") <= F.lit(last).cast("bigint")).groupBy("_hash").agg(F.min(html_col).alias(html_col)).select(html_col)
    )

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts: Counter[tuple[str, bool]] = Counter()
        for source in batch.column(html_col).to_pylist():
            page = parse(source or "")
            for feature, count, inside in zip(page.features, page.counts, page.inside, strict=True):
                if feature != LEFT and page.labelled:
                    counts[feature, inside] += count
        return pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in counts], pa.string()), pa.array([i for _, i in counts], pa.bool_()),
             pa.array(list(counts.values()), pa.int64())], names=["feature", "inside", "n"])

    counted = (
        map_texts(sample, html_col, [], "feature string, inside boolean, n bigint", step)
        .groupBy("feature").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("inner"),
                                F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("outer"))
        .orderBy(F.desc(F.col("inner") + F.col("outer")), "feature").limit(1000)  # far more than there are element names
    )
    weights = {}
    for feature, inner, outer in counted.collect():
        odds = max(-LARGEST, min(LARGEST, math.log((inner + 1) / (outer + 1))))
        weights[feature] = max(LEAST, odds) if feature.startswith("word:") else min(-LEAST, odds)
    return weights


def extract(
    pages: DataFrame, keep: list[str], html_col: str = "html", text_as: str = "text", weights: dict[str, float] | None = None,
) -> DataFrame:
    """The columns ``keep`` and the main text of every page (empty if none; a null page has none).

    Character references are decoded, white space in a block becomes one space, blocks are joined by \\n in page order.
    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments and markup go. Broken markup
    is read as far as it goes. Pages are independent, so repeated ones get equal texts.
    """
    weights = learn_weights(pages, html_col) if weights is None else weights
    shared = pages.sparkSession.sparkContext.broadcast(weights)  # at most 1000 features
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    schema = ", ".join([f"`{c}` {fields[c]}" for c in keep] + [f"`{text_as}` string"])

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(s, shared.value) if s else "" for s in batch.column(html_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], names=[*keep, text_as])

    return map_texts(pages, html_col, keep, schema, step)
