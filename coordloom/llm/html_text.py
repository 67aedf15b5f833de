"""Main text of web pages by tag-path ratios, in Arrow batches without a shuffle.

The text of a page is summed over its root-to-leaf tag paths: characters and punctuation
for each node of a path. Both ratios are smoothed along the page and multiplied; nodes on
paths above a share of the mean are content. The element that holds the content is then
taken whole, but for menus, adverts and the like: what a tag says is one, and what a name
marks as one if the ratio of its paths is low too, most of it is links, or it is a line of its
own beside paragraphs. Parts of it that are mostly links go too, whatever their name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A node is content if its path's smoothed score is at least this share of the mean.
THRESHOLD = 0.5
#: The content element is the deepest that holds this share of the content characters.
SHARE = 0.8
_ROWS_AT_ONCE = 256

# Elements of HTML by their role.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style xmp iframe noembed noframes textarea title".split())
_BLOCK = set("""address article aside blockquote body caption center dd details dialog dir div dl
dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li
main menu nav ol option p pre search section select summary table tbody td tfoot th thead title
tr ul""".split())
_NO_TEXT = set("""aside button canvas dialog footer form head iframe input map menu nav noscript
object optgroup option script search select style svg template textarea title video audio""".split())
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup".split())
# Names in class, id or role that mark what may not be the main text.
_NAMES = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo
promoted promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs topbar header
masthead footer copyright contentinfo sidebar aside complementary rail widget widgets cookie
cookies consent gdpr notice notices notification alert popup modal overlay dialog toast
subscribe subscription newsletter signup login signin form search comment comments
commentlist reply replies respond disqus share sharing social related recommended
recommendations pagination pager toolbar skip paywall""".split())
_COMMENTS = set("comment comments commentlist reply replies respond disqus".split())
# What is written like the main text, so that no ratio tells it apart, if it is named so whole.
_ADS = set("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted
promotion cookie cookies consent gdpr""".split())
# Words that say whose comments are meant.
_WHOSE = set("""all article blog latest new page post reader readers recent thread user users visitor
visitors""".split())
# Elements that hold parts of a page; one inside the content whose text is mostly links goes.
_PARTS = set("aside div dl ol section table td ul".split())
# Words that add nothing to a name.
_AROUND = set("""area block body bottom box container content inner item left list main outer right
section slot top unit wrap wrapper""".split())
_ENDS = {  # a start tag of the key ends open elements of the values
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
    "body": {"head"},
}
_SCOPE = set("""html body article section main div aside nav header footer table td th ul ol dl
form fieldset blockquote""".split())

_MARKUP = re.compile(r"<(?:!--|([/]?)([a-zA-Z][^\s/>]*)|[!?])")
_COMMENT_END = re.compile(r"--!?>")
_STOP = re.compile(r"[>\"']")
# One attribute after the other, so that what stands in a value is no attribute.
_ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~¡-¿‐-‧、-〃！-／]")


def _attributes(written: str) -> dict[str, str]:
    """Values of the attributes that matter here; of a repeated one the first counts."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(written):
        if (name := name.lower()) in ("class", "id", "role", "hidden", "style"):
            found.setdefault(name, "".join(values))
    return found


@lru_cache(1 << 14)
def _words(name: str) -> frozenset[str]:
    """The words of a name in class, id or role; those written as one, as in adbox, apart."""
    found = set()
    for word in map(str.lower, _NAME.findall(name)):
        heads = [word[:k] for k in range(2, len(word)) if word[:k] in _NAMES and word[k:] in _AROUND]
        found |= {word} if word in _NAMES or not heads else {heads[0], word[len(heads[0]):]}
    return frozenset(found)


class _Page:
    """The elements of a page, parents first, and numbers of its tag paths."""

    def __init__(self) -> None:
        self.elements: list[_Element] = []
        self._paths: dict[tuple[int, str], int] = {}

    def path(self, above: int, tag: str) -> int:
        return self._paths.setdefault((above, tag), len(self._paths) + 1)

    def summed(self, values: dict[int, float]) -> list[float]:
        """For each element the sum of its own and its descendants' values."""
        sums = [values.get(k, 0.0) for k in range(len(self.elements))]
        for element in reversed(self.elements[1:]):
            sums[element.parent.number] += sums[element.number]
        return sums

    def within(self, wholes: set[_Element]) -> list[bool]:
        """Whether each element lies in one of others."""
        inside = [False] * len(self.elements)
        for element in self.elements:
            inside[element.number] = element in wholes or bool(
                element.parent and inside[element.parent.number])
        return inside


class _Element:
    __slots__ = ("tag", "parent", "page", "path", "number", "dropped", "mark", "sure", "article", "depth")

    def __init__(self, tag: str, parent: _Element | None, attributes: str) -> None:
        self.tag, self.parent = tag, parent
        self.page: _Page = parent.page if parent else _Page()
        self.number = len(self.page.elements)
        self.page.elements.append(self)
        self.depth = parent.depth + 1 if parent else 0
        names: list[frozenset[str]] = []
        hidden = False
        for key, value in _attributes(attributes).items() if attributes else ():
            if key == "hidden" or key == "style" and "display:none" in value.replace(" ", "").lower():
                hidden = True
            elif key != "style" and not (key == "id" and tag in _HEADINGS):
                names += map(_words, value.split())
        within = parent.article if parent else None
        own = tag in ("article", "main") and within is None and not any(n & _COMMENTS for n in names)
        self.article = self if own else within
        dropped = hidden or tag in _NO_TEXT or tag == "header" and within is None
        self.dropped = dropped or bool(parent and parent.dropped)
        #: The nearest element, this one included, that a name marks, and that marks it surely.
        self.mark, self.sure = (parent.mark, parent.sure) if parent else (None, None)
        words = marked = sure = None
        if tag == "header" and within is not None:
            marked = sure = True
        elif names and not own and tag not in ("html", "body"):
            whole = [n for n in names if n & _NAMES and n <= _NAMES | _AROUND
                     or n & _COMMENTS and n <= _COMMENTS | _WHOSE | _AROUND]
            sure = any(n & _ADS or n & _COMMENTS and tag in _BLOCK for n in whole)
            loose = tag in _SCOPE and any(n & _NAMES for n in names)
            marked = sure or tag not in _HEADINGS | {"article", "main"} and (bool(whole) or loose)
            words = sorted(set().union(*names) & _NAMES) if marked else None
        elif tag in _HEADINGS and parent is not None and parent.tag == "header" and parent.parent:
            self.mark, self.sure = parent.parent.mark, parent.parent.sure
        if marked:
            self.mark, self.sure = self, self if sure else self.sure
        # What a name marks has paths of its own.
        self.path = self.page.path(parent.path, " ".join([tag, *words]) if words else tag) if parent else 0


class _Block:
    __slots__ = ("element", "parts", "linked", "marks")

    def __init__(self, element: _Element) -> None:
        self.element, self.parts, self.linked = element, [], 0
        self.marks: set[_Element | None] = set()  # of the elements in the block with its text


def _tag_end(html: str, at: int, unclosed: set[str]) -> int:
    """Place of the ``>`` that ends a tag; quotes count after a ``=``."""
    while m := _STOP.search(html, at):
        found, at = m.group(), m.end()
        if found == ">":
            return m.start()
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        if html[before] == "=" and found not in unclosed:
            close = html.find(found, at)
            if close < 0:
                unclosed.add(found)
            else:
                at = close + 1
    return -1


def _blocks(html: str) -> list[tuple[_Element, str, int]]:
    """Blocks of text in page order, with the element they lie in and their link characters.

    One pass: a tag is looked for in the open elements only if one of its name is open.
    """
    root = _Element("#", None, "")
    top, links, at, out = root, 0, 0, []
    now = _Block(root)
    is_open: Counter[str] = Counter()
    unclosed: set[str] = set()
    raw_ends: dict[str, re.Pattern] = {}

    def text(raw: str) -> None:
        block = now.element.number
        if not raw or top.dropped or top.sure and top.sure.number > block:
            return
        if not raw.isspace():
            now.marks.add(top.mark if top.mark and top.mark.number > block else None)
        now.parts.append(unescape(raw) if "&" in raw else raw)
        if links:
            now.linked += len(raw.strip())

    def ended(element: _Element) -> None:
        nonlocal now
        if now.parts:
            words = " ".join("".join(now.parts).split())
            if words:
                # Marked words amid others stay; if they are the whole block it is marked.
                whole = now.marks.pop() if len(now.marks) == 1 else None
                heads = now.element.tag in _HEADINGS
                out.append((now.element if heads else whole or now.element, words, now.linked))
        now = _Block(element)

    def closed(place: _Element) -> None:
        """Close the open elements up to this one."""
        nonlocal top
        while top is not place:
            is_open[top.tag] -= 1
            top = top.parent
        is_open[place.tag] -= 1
        top = place.parent

    end, last = len(html), html.rfind(">")
    while at < end:
        m = _MARKUP.search(html, at)
        if not m or m.start() > last and not html.startswith("<!--", m.start()):
            text(html[at:])
            break
        text(html[at:m.start()])
        if html.startswith("<!--", m.start()):
            close = _COMMENT_END.search(html, m.end())
            at = close.end() if close else end
            continue
        tag = (m.group(2) or "").lower()
        stop = _tag_end(html, m.end(), unclosed) if tag else html.find(">", m.end())
        if stop < 0:
            text(html[m.start():m.end()])
            at = m.end()
            continue
        attributes, at = html[m.end():stop], stop + 1
        if not tag:
            continue
        if m.group(1):
            if is_open[tag]:
                place = top
                while place is not root and place.tag != tag:
                    if place.tag in _SCOPE and (tag not in _BLOCK or tag == "p"):
                        place = root
                        break
                    place = place.parent
                if place is not root:
                    closed(place)
            links -= tag == "a" and links > 0
            if tag in _BLOCK:
                links = links if tag not in _SCOPE else 0
                ended(top)
            continue
        if tag in _VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                ended(top)
            continue
        if tag in _BLOCK:
            closing = _ENDS.get(tag, set()) | {"p"}
            place, inner = top, None
            if any(is_open[t] for t in closing):
                while place is not root and (place.tag not in _SCOPE or place.tag in closing):
                    if place.tag in closing:
                        inner = place
                    place = place.parent
            if inner:
                closed(inner)
            links = 0
        else:
            links += tag == "a"
        top = _Element(tag, top, attributes)
        is_open[tag] += 1
        if tag in _BLOCK:
            ended(top)
        if tag in _RAW and not attributes.endswith("/"):
            ends = raw_ends.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I))
            close = ends.search(html, at)
            at = close.end() if close else end
            closed(top)
            if tag in _BLOCK:
                ended(top)
    ended(root)
    return out


def _smoothed(values: np.ndarray) -> np.ndarray:
    """A Gaussian average over two neighbours on either side."""
    weights = np.exp(-np.arange(-2, 3) ** 2 / 2.0)
    padded = np.pad(values, 2, mode="edge")
    return np.convolve(padded, weights / weights.sum(), mode="valid")


def _path_means(blocks: list[tuple[_Element, str, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Mean characters beside links and mean punctuation of each block's path."""
    paths: dict[int, list[float]] = {}
    for element, words, linked in blocks:
        sums = paths.setdefault(element.path, [0, 0, 0])
        sums[0] += max(len(words) - linked, 0)
        sums[1] += len(_PUNCTUATION.findall(words))
        sums[2] += 1
    length = np.array([paths[e.path][0] / paths[e.path][2] for e, _, _ in blocks])
    marks = np.array([paths[e.path][1] / paths[e.path][2] for e, _, _ in blocks])
    return length, marks


def content_scores(blocks: list[tuple[_Element, str, int]]) -> np.ndarray:
    """Fused and smoothed ratio of each block's path."""
    length, marks = _path_means(blocks)
    return _smoothed(length) * (1 + _smoothed(marks))


def _chosen(blocks: list[tuple[_Element, str, int]], threshold: float, share: float) -> list[_Element]:
    """The element that holds the content; of articles side by side all that do, the main one first."""
    scores = content_scores(blocks)
    sizes = np.array([len(words) - min(linked, len(words)) for _, words, linked in blocks], float)
    weights = np.where(scores >= threshold * scores.mean(), sizes, 0.0)
    if not weights.sum():
        weights = sizes
    page = blocks[0][0].page
    held: dict[int, float] = {}
    plain: dict[int, float] = {}  # blocks that are no headings
    articles: dict[_Element, float] = {}
    whole: dict[_Element, float] = {}
    for (element, _, _), weight, size in zip(blocks, weights, sizes):
        held[element.number] = held.get(element.number, 0.0) + weight
        plain[element.number] = plain.get(element.number, 0.0) + (element.tag not in _HEADINGS)
        if element.article:
            articles[element.article] = articles.get(element.article, 0.0) + weight + 1e-9
            whole[element.article] = whole.get(element.article, 0.0) + size
    if articles:
        first = max(articles, key=articles.get)
        others = [] if any(a.tag == "main" for a in articles) else [
            a for a in articles if a is not first and whole[a] and 2 * articles[a] >= whole[a]]
        return [first, *others]
    sums, others = page.summed(held), page.summed(plain)
    enough = share * weights.sum()
    chosen = max((e for e in page.elements if sums[e.number] >= enough), key=lambda e: e.depth)
    while chosen.parent and chosen.tag not in _SCOPE and chosen.tag != "#":
        chosen = chosen.parent
    # Headings beside the content belong to it.
    while chosen.parent and chosen.parent.tag not in ("html", "#") and (
            others[chosen.parent.number] == others[chosen.number]):
        chosen = chosen.parent
    return [chosen]


def _without_marked(blocks: list[tuple[_Element, str, int]], threshold: float,
                    share: float) -> list[tuple[_Element, str, int]]:
    """Blocks without those that a name marks and the method does not hold for content.

    Of the marked elements none goes that holds the content of the page scored as a whole.
    Of the others go adverts, comments and bylines, what is mostly links, and what has
    paths of a low ratio, each against the mean of the blocks without a mark.
    """
    free = [b for b in blocks if not b[0].sure]
    if not free or any(b[0].article for b in blocks) and not any(b[0].article for b in free):
        free = blocks
    kept, above = set(), _chosen(free, threshold, share)[0]
    while above:
        kept.add(above)
        above = above.parent
    length, marks = _path_means(blocks)
    ratios = length * (1 + marks)
    page = blocks[0][0].page

    def under(holds: Callable[[_Element], bool]) -> list[bool]:
        """Whether each element, or one that marks it, is such a marked element."""
        found = [False] * len(page.elements)
        for element in page.elements:
            above = element.parent if element.mark is element else element
            found[element.number] = bool(above.mark and found[above.mark.number]) or (
                element.mark is element and element not in kept and holds(element))
        return found

    marked = under(lambda element: True)
    by_ratio, sizes, links = {}, {}, {}
    usual = [0.0, 0.0]
    for (element, words, linked), ratio in zip(blocks, ratios):
        size = len(words) * (1e-9 if element.tag in _HEADINGS else 1.0)  # headings are short anyway
        for sums, value in ((by_ratio, ratio), (sizes, 1.0), (links, min(linked / len(words), 1.0))):
            sums[element.number] = sums.get(element.number, 0.0) + value * size
        if not marked[element.number]:
            usual = [usual[0] + ratio * size, usual[1] + size]
    low = threshold * usual[0] / usual[1] if usual[1] else 0.0
    by_ratio, sizes, links = map(page.summed, (by_ratio, sizes, links))
    # A path of its own: the text of a marked part with no paragraph, beside content in paragraphs.
    own_paths: Counter[int] = Counter(e.path for e, _, _ in blocks if e.mark is e and e.tag in _PARTS)
    parts = page.summed({e.number: 1.0 for e, _, _ in blocks})
    in_paragraphs = 2 * sum(len(w) for e, w, _ in blocks if e.tag == "p") > sum(len(w) for _, w, _ in blocks)
    gone = under(lambda element: element.sure is element or 2 * links[element.number] > sizes[
        element.number] or by_ratio[element.number] < low * sizes[element.number]
        or in_paragraphs and own_paths[element.path] > 0 and parts[element.number] == 1)
    return [b for b in blocks if not gone[b[0].number]]


def _without_linked(blocks: list[tuple[_Element, str, int]], chosen: list[_Element]) -> list[tuple[_Element, str, int]]:
    """Blocks without the parts inside the content that are mostly links, such as lists of other
    pages beside the text; none goes if less than half of the text would be left."""
    if not any(linked for _, _, linked in blocks):
        return blocks
    page = chosen[0].page
    sizes: dict[int, float] = {}
    links: dict[int, float] = {}
    for element, words, linked in blocks:
        sizes[element.number] = sizes.get(element.number, 0.0) + len(words)
        links[element.number] = links.get(element.number, 0.0) + min(linked, len(words))
    sizes, links = page.summed(sizes), page.summed(links)
    whole = {e for e in page.elements if e.tag in _PARTS and e not in chosen
             and 2 * links[e.number] > sizes[e.number] > 0}
    gone = page.within(whole)
    left = [b for b in blocks if not gone[b[0].number]]
    return left if 2 * sum(len(w) for _, w, _ in left) >= sum(len(w) for _, w, _ in blocks) else blocks


def main_text(html: str | None, threshold: float = THRESHOLD, share: float = SHARE) -> str:
    """The main text of a page; empty if there is none."""
    blocks = [b for b in _blocks(html or "") if not b[0].dropped]
    if any(b[0].mark for b in blocks):
        blocks = _without_marked(blocks, threshold, share)
    if not blocks:
        return ""
    chosen = _chosen(blocks, threshold, share)
    inside = chosen[0].page.within(set(chosen))
    kept = _without_linked([b for b in blocks if inside[b[0].number]], chosen)
    return "\n\n".join(words for _, words, _ in kept)


def extracted(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with the main text and ``n_chars``, its code points; ``html`` is dropped.

    Null and empty pages have an empty text. White space in a block becomes one blank,
    blocks are joined by an empty line. Pages are read whole; repeated rows stay; columns
    named ``text`` or ``n_chars`` are replaced.
    """
    kept = pages.drop(*[c for c in (text, "n_chars") if c in pages.columns and c != html])
    others = [c for c in kept.columns if c != html]
    schema = kept.select(*(F.col(f"`{c}`") for c in others)).withColumns(
        {text: F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS_AT_ONCE):
                part = batch.slice(at, _ROWS_AT_ONCE)
                texts = [main_text(h) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), pa.array(texts, pa.string()),
                     pa.array(map(len, texts), pa.int64())], [*others, text, "n_chars"])

    return kept.mapInArrow(read, schema)
