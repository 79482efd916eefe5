"""Operator 7: main text of web pages by tag-path ratios.

A page is cut into blocks of text, each at a path of block tags from the root (with the
words of their class and id).  Per path the lengths and the punctuation of its blocks are
summed; the ratio of a path grows with its text, its text per block and its marks per
block.  Ratios are smoothed over the tree of paths: with the paths that share the parent
(lists and tables do not count as parents), those that differ in class names only, and half
of those around the parent; a heading takes part in what it heads.  Tags are one more
feature, fused with the ratio: an article or main element multiplies it, a menu, footer,
advert or form divides it unless it holds most of the page's text, links and buttons take
their share of the text away.  Every block of a path whose fused ratio reaches THRESHOLD
of the page's mean, weighted by text, is content; nothing else selects or drops a block.

A null or empty page, and one with no text left, gives an empty string.  Unclosed and
crossing tags are read as browsers do: a block tag ends an open paragraph, an end tag
closes down to its start, the end of the page closes all.  Nothing is capped, and the time
is linear in the page however deep it nests.  Pages with ties or repeated rows are
extracted one by one; an empty table gives no rows; `page_id` and `url` may be null.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship_package
from .common import slices

# Elements read as plain characters up to their end tag, and dropped.  An end tag that is
# missing ends the page for those of the first list; the others are then not there.
SWALLOWS = frozenset("script style textarea title".split())
RAW = SWALLOWS | frozenset("noscript iframe template svg object select audio video canvas".split())
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark math mfrac mi "
    "mn mo mrow msqrt msub msup mtext q s samp semantics small span strike strong sub sup time tt u var wbr "
    "img".split()
)
CLICKED = frozenset(["a", "button"])
TRANSPARENT = frozenset("ul ol li dl dt dd table tbody thead tfoot tr blockquote".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ARTICLE = frozenset(["article", "main"])
# Tags, roles and names in a class or id of parts that are seldom article.
NEVER_TAGS = frozenset("head nav footer dialog menu".split())
ASIDE_TAGS = NEVER_TAGS | frozenset("aside form fieldset option".split())
ASIDE_ROLES = frozenset(
    "navigation banner contentinfo complementary search form alert dialog menu menubar".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply".split())
ASIDE_WORDS = COMMENT_WORDS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion "
    "breadcrumb breadcrumbs cookie cookies consent popup modal newsletter subscribe subscription signup login "
    "related recommended recommendations pagination pager copyright disclaimer hidden sitemap "
    "banner nav navbar navigation menu sidebar aside footer header masthead notice notices alert overlay "
    "share sharing social widget widgets legal toolbar skip".split()
)
NOT_MEANT = re.compile(r"\b(?:has|have|no|with|without|is|not)[-_][\w-]*")
# What these features multiply a ratio by.
IN_ARTICLE, SELDOM, DOUBTED, HEADED = 5.0, 0.001, 0.3, 0.5
THRESHOLD = 0.25

CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
SAME_LEVEL = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
SCOPES = {
    "li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",),
    "option": ("select",),
}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|([^<]+)|<[a-zA-Z/][^>]*\Z|<",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：]")
WORD = re.compile(r"[a-z0-9]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _attributes(attributes: str) -> dict[str, str]:
    """Names in lower case and values; the first of a repeated name counts."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), "".join(values).lower())
    return found


def _feature(tag: str, found: dict[str, str], in_article: bool) -> tuple[float, bool]:
    """What an element's tag and names make of the ratios inside, and whether it does so
    even if it holds most of the page's text."""
    if "hidden" in found or found.get("aria-hidden") == "true" or NOT_SHOWN.search(found.get("style", "")):
        return 0.0, True
    factor = SELDOM if tag in ASIDE_TAGS or found.get("role") in ASIDE_ROLES else 1.0
    if tag == "header" and not in_article:  # an article's own holds its title
        factor = SELDOM
    always = tag in NEVER_TAGS
    if tag not in ("html", "body", "main"):
        for name in NOT_MEANT.sub(" ", f"{found.get('class', '')} {found.get('id', '')}").split():
            words = {w for w in WORD.findall(name) if not w.isdigit()}
            if words and words <= ASIDE_WORDS:
                factor = min(factor, SELDOM)
                always = always or bool(words & COMMENT_WORDS)
            elif words & ASIDE_WORDS and tag not in ARTICLE:
                factor = min(factor, DOUBTED)
    return factor, always


class Page:
    """Blocks of a page in order, and the trees of its paths and elements, by number.

    A block is (path, element, text, characters in links and buttons).  A path is known by
    its parent's number and its last step; `bare` numbers paths without class names.
    """

    def __init__(self):
        self.blocks: list[tuple[int, int, str, int]] = []
        self.tags, self.parents, self.bare = [""], [0], [0]  # by path; 0 is the root
        self.around, self.factors, self.starts, self.ends = [0], [(1.0, False)], [0], [0]  # by element
        self.chars = 0
        self._paths: dict[tuple[int, str], int] = {}
        self._bare: dict[tuple[int, str], int] = {}

    def path(self, parent: int, tag: str, names: str) -> int:
        key = (parent, f"{tag} {names}")
        if key not in self._paths:
            self._paths[key] = len(self.tags)
            self.tags.append(tag)
            self.parents.append(parent)
            self.bare.append(self._bare.setdefault((self.bare[parent], tag), len(self._bare) + 1))
        return self._paths[key]

    def element(self, around: int, feature: tuple[float, bool]) -> int:
        self.around.append(around)
        self.factors.append(feature)
        self.starts.append(self.chars)
        self.ends.append(-1)
        return len(self.around) - 1

    def features(self) -> list[float]:
        """By element, the product of the features around it; those of an element that holds
        most of the page's text do not count, but for the ones that always do."""
        found = [1.0] * len(self.around)
        for k in range(1, len(found)):
            factor, always = self.factors[k]
            end = self.chars if self.ends[k] < 0 else self.ends[k]
            if factor < 1 and not always and 2 * (end - self.starts[k]) > self.chars:
                factor = 1.0
            found[k] = found[self.around[k]] * factor
        return found


def read_page(page: str) -> Page:
    read = Page()
    # path, element, tag, in an article; `open_at` has the places of every open tag.
    stack: list[tuple[int, int, str, bool]] = []
    open_at: dict[str, list[int]] = defaultdict(list)
    without_end: set[str] = set()
    text: list[str] = []
    links = linked = 0

    def flush() -> None:
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split())
        if joined:
            path, element = stack[-1][:2] if stack else (0, 0)
            read.blocks.append((path, element, joined, min(linked, len(joined))))
            read.chars += len(joined)
        text.clear()
        linked = 0

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            _, element, tag, _ = stack.pop()
            open_at[tag].pop()
            read.ends[element] = read.chars

    def nearest(tags: tuple[str, ...]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=-1)

    at, size = 0, len(page)
    while at < size:
        match = TOKEN.match(page, at)
        at = match.end()
        if match[7] is not None or match[0] == "<":
            text.append(match[0])
            if links:
                linked += len(match[0].strip())
            continue
        tag = match[2] or match[5]
        if tag is None:
            continue
        end, tag, attributes = match[1] or match[4], tag.lower(), match[3] or match[6] or ""
        if end:
            if tag in CLICKED:
                links = max(0, links - 1)
            if tag in INLINE:
                continue
            if open_at.get(tag):
                flush()
                close_to(open_at[tag][-1])
            elif tag in ("p", "br"):
                flush()
            continue
        if tag in RAW:
            if attributes.rstrip().endswith("/") and tag not in SWALLOWS:
                continue
            closing = None if tag in without_end else re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            if closing:
                at = closing.end()
            elif tag in SWALLOWS:
                at = size
            else:
                without_end.add(tag)
            continue
        if tag in CLICKED:
            links += 1
        if tag in VOID:
            if tag == "br":
                text.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in INLINE or (tag in ("html", "body") and open_at.get(tag)):
            continue
        flush()
        links = 0
        if tag in CLOSES_P and open_at.get("p"):
            close_to(open_at["p"][-1])
        if tag in SAME_LEVEL:
            alike = nearest(SAME_LEVEL[tag])
            if alike > nearest(SCOPES[tag]):
                close_to(alike)
        if tag == "body":
            close_to(open_at["html"][0] + 1 if open_at.get("html") else 0)
        path, element, _, inside = stack[-1] if stack else (0, 0, "", False)
        found = _attributes(attributes) if attributes else {}
        names = ""
        if found and tag not in ("html", "body", "p"):
            names = " ".join(sorted(w for w in WORD.findall(f"{found.get('class', '')} {found.get('id', '')}") if w.isalpha()))
        open_at[tag].append(len(stack))
        stack.append((
            read.path(path, tag, names), read.element(element, _feature(tag, found, inside)), tag, inside or tag in ARTICLE
        ))
    flush()
    close_to(0)
    return read


def path_ratios(page: Page) -> tuple[dict[int, float], dict[int, float], dict[int, float]]:
    """By path: its ratio, its text and the feature of its tags."""
    chars, marks, count = defaultdict(float), defaultdict(int), defaultdict(int)
    feature, features = defaultdict(float), page.features()
    size = defaultdict(int)
    for path, element, text, linked in page.blocks:
        shown = len(text) - linked
        chars[path] += shown
        marks[path] += len(PUNCTUATION.findall(text)) if shown else 0
        count[path] += 1
        size[path] += len(text)
        feature[path] += len(text) * features[element] * (shown / len(text)) ** 2
    in_article = [False] * len(page.tags)
    for path in range(1, len(page.tags)):
        in_article[path] = in_article[page.parents[path]] or page.tags[path] in ARTICLE
    ratio = {p: chars[p] / count[p] ** 0.5 * (1 + marks[p] / count[p]) for p in count}
    fused = {p: feature[p] / size[p] * (IN_ARTICLE if in_article[p] else 1) for p in count}
    return ratio, {p: float(size[p]) for p in count}, fused


def path_scores(page: Page) -> dict[int, float]:
    """Smoothed ratio of every path, fused with the feature of its tags."""
    ratio, size, feature = path_ratios(page)
    parents = list(page.parents)  # of the part a path belongs to
    for path in range(1, len(parents)):
        above = parents[path]
        if above and page.tags[above] in TRANSPARENT:
            parents[path] = parents[above]

    def mean(group) -> dict[int, float]:
        total, weight = defaultdict(float), defaultdict(float)
        for p, r in ratio.items():
            total[group(p)] += r * size[p]
            weight[group(p)] += size[p]
        return {g: total[g] / weight[g] for g in total}

    beside, alike = mean(lambda p: parents[p]), mean(lambda p: page.bare[p])
    smooth = {
        p: r + beside[parents[p]] + alike[page.bare[p]] + beside.get(parents[parents[p]], 0.0)
        for p, r in ratio.items()
    }
    score = {p: smooth[p] * feature[p] for p in ratio}
    headed, weight, following = defaultdict(float), defaultdict(float), None
    for path, _, text, _ in reversed(page.blocks):
        if page.tags[path] in HEADINGS:
            if following is not None:
                headed[path] += score[following] * len(text)
            weight[path] += len(text)
        else:
            following = path
    for path in headed:
        if feature[path] >= DOUBTED:
            score[path] = max(score[path], HEADED * headed[path] / weight[path])
    return score


def main_text(page: str | None) -> str:
    read = read_page(page or "")
    if not read.blocks:
        return ""
    score = path_scores(read)
    mean = sum(score[path] * len(text) for path, _, text, _ in read.blocks) / read.chars
    return " ".join(text for path, _, text, _ in read.blocks if score[path] > 0 and score[path] >= THRESHOLD * mean)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text and its length in code points."""
    ship_package(pages.sparkSession)

    def extract(parts):
        for batch in slices(parts, "html"):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                    pa.array([len(t) for t in texts], pa.int64()),
                ],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(
        extract, f"page_id {kind}, url string, text string, n_chars long"
    )
