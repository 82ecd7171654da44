"""Main text of web pages by scoring the tree of containers."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from territoria.llm.common import batches_held

#: Fixed values of HTML: elements without content; with text that isn't markup, to their end tag or the page's end; that
#: break lines; whose end tag may be missing; and at which the search for such an element ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside body div footer header html main nav ol section table td th ul blockquote form dl".split())
STOPS = SCOPE | CLOSES.keys()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are parts of a container and never the article's own.
PARTS = HEADINGS | frozenset("p pre ul ol li dl dt dd blockquote figure figcaption caption summary address hgroup".split())
#: Inline elements that hold no text of an article; one without an end tag, or that ends in a slash, is empty.
SKIPPED = frozenset("svg template noscript iframe noembed noframes button select datalist canvas audio video map".split())
#: Block elements that are beside the article by themselves, and those that may be.
ASIDE_TAGS = frozenset("nav footer aside menu dialog head search".split())
SOFT_TAGS = frozenset("form header fieldset".split())
#: Names in class, id or role that say by themselves that a part isn't the article; names that say so only together with
#: another such name or with a plain one, as in social-links; and the plain ones.
ASIDE_NAMES = frozenset("ad ads advert adverts advertisement advertising advertorial adsense adsbygoogle adslot banner sponsor sponsored sponsors promo promos promotion nav navbar navigation navigational menu menubar breadcrumb breadcrumbs sidebar aside footer masthead topbar toolbar comment comments commentlist discussion discussions disqus replies respond responses cookie cookies consent gdpr notice notices notification notifications alert alerts popup modal overlay newsletter subscribe subscription signup signin login share sharing sharebar addthis related recommended recommendations widget widgets pagination pager paginator skiplink complementary contentinfo outbrain taboola".split())
ASIDE_HALVES = frozenset("social side header foot head search tags tag skip rail links".split())
PLAIN_NAMES = frozenset("area bar block body bottom box btn button buttons card center column container content desktop div element float form group holder home icon icons inner item items large left link list main media mobile module outer page panel placeholder posts primary reader readers right row secondary section site slot small space sticky the thread title top unit user users visitor visitors wide wrap wrapper zone".split())
HALVES_ALONE = frozenset("header search".split())
MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content|entry|hentry|main|page|post|text|blog|story)(?:$|[\s_-])", re.I)
#: What is left of the points of a part that may be, or that is, beside the article; the part of a page's points from which
#: a box isn't beside the article, and from which <main> or <article> is taken at its word; the characters of a paragraph
#: that no article is without; and the part of a box's characters in links from which it is a list of links.
SOFT, HARD, MOST, ENOUGH, PARAGRAPH, LINKED = 0.2, 0.02, 0.5, 0.4, 80, 0.5

#: A tag: quotes count where they follow an equals sign. No part of it is tried twice.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")


class _Box:
    """An element of the tree: its blocks of text, in page order; whether it is marked as beside the article (1: it may
    be, 2: it says so); and its points."""

    __slots__ = ("bad", "chars", "children", "factor", "inside", "items", "links", "main", "mark", "mass", "own", "parent", "plain", "score", "stop", "tag", "weight")

    def __init__(self, tag: str, parent: _Box | None, mark: int, weight: float, main: bool = False):
        self.main = main or tag == "main"
        self.inside = self.main or tag == "article" or parent is not None and parent.inside
        self.stop = self if tag in STOPS or parent is None else parent.stop  # the nearest, itself included, where a search for an open item may end
        self.tag, self.parent, self.mark, self.weight, self.children, self.items = tag, parent, mark, weight, [], []
        self.score, self.own, self.mass, self.chars, self.links, self.plain, self.factor, self.bad = 0.0, 0.0, 0.0, 0, 0, 0, 1.0, False


def _beside(names: str, inside: bool) -> int:
    """Whether a class, id or role names a part beside the article: 2 if some name of it, as a whole, is well known for
    that, or one of the words that hyphens join in it is and the others are plain; 1 if these only go with it. Names in an
    article that mark its own header don't count."""
    found = 0
    for name in re.sub(r"([a-z0-9])([A-Z])", r"\1-\2", names).lower().split():
        parts = [x for x in re.split(r"[-_]+", name) if x and not x.isdigit()]
        aside = sum(x in ASIDE_NAMES for x in parts)
        half = sum(x in ASIDE_HALVES for x in parts)
        plain = sum(x in PLAIN_NAMES for x in parts)
        if len(parts) != aside + half + plain or not parts:
            continue
        if aside:
            return 2
        if half > 1 or half and (plain or parts[0] in HALVES_ALONE) and not (inside and "header" in parts):
            found = 1
    return found


def _marks(attributes: str, inside: bool) -> tuple[int, float, bool]:
    """The mark that attributes give, what they add to a score, and whether they name the page's main part."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
        return 2, 0.0, False
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    if not names.strip():
        return 0, 0.0, False
    main = found.get("role") == "main"
    return 0 if main else _beside(names, inside), 25.0 * bool(MAIN_WORDS.search(names)), main


class _Tags:
    """The tags of a page, one after another, in time that is linear in the page."""

    def __init__(self, page: str):
        self.page, self.tag, self.last, self.absent = page, TAG, page.rfind(">"), set()

    def at(self, k: int) -> re.Match | None:
        """The tag that starts at k, if any does. Where a quote hides all that could end it, quotes no longer count."""
        if k > self.last:
            return None
        found = self.tag.match(self.page, k)
        if not found and self.tag is TAG and self.page[k + 1 : k + 3].lstrip("/")[:1].isalpha():
            self.tag = LOOSE_TAG
            found = self.tag.match(self.page, k)
        return found

    def after(self, name: str, k: int) -> int:
        """Where the element `name` that is open at k ends, nested ones of the name included; -1 where it doesn't."""
        if name in self.absent:
            return -1
        depth = 1
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*+>", re.I).finditer(self.page, k):
            depth += -1 if m[1] else not m[0].endswith("/>")
            if not depth or name in RAW and m[1]:
                return m.end()
        self.absent.add(name)  # what is searched for from here on isn't there either
        return -1


def _tree(page: str) -> _Box:
    """Boxes for block elements; runs of text between block boundaries are their items (text, characters in links)."""
    root = here = _Box("html", None, 0, 0.0)
    text: list[str] = []
    linked = link = 0
    tags, opened = _Tags(page), Counter()

    def ended() -> None:
        nonlocal linked
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            if block:
                here.items.append((block, min(linked, len(block))))
            text.clear()
        linked = 0

    def left(to: _Box) -> _Box:
        """Where one stands when box `to`, and all open in it, have ended."""
        box = here
        while box is not to.parent:
            opened[box.tag] -= 1
            box = box.parent
        return box

    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        piece = page[at : start if start >= 0 else size]
        if piece:
            text.append(piece)
            if link:
                linked += len(piece.strip())
        if start < 0:
            break
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else size
            continue
        m = tags.at(start)
        if not m:
            if start > tags.last and page[start + 1 : start + 3].lstrip("/")[:1].isalpha():
                break  # a tag that the page's end cuts off
            text.append("<")
            at = start + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            if name == "a":
                link = 0
            elif name == "p" or name in BLOCK:
                ended()
                link = 0
                if name == "p":
                    here = left(here) if here.tag == "p" else here
                elif opened[name]:
                    box = here
                    while box.tag != name:
                        box = box.parent
                    here = left(box)
            continue
        if name in RAW:
            end = tags.after(name, at)
            at = end if end >= 0 else size
            continue
        if name in SKIPPED:
            end = -1 if re.search(r"(?:^|[\s\"'])/$", m[3]) else tags.after(name, at)
            at = end if end >= 0 else at
            continue
        if name in VOID and name != "hr":
            text.append(" " if name == "br" else "")
            continue
        if name == "a":
            link = 1
        if name in BLOCK:
            ended()
            link = 0
            if name == "hr":
                continue
            while here.tag == "p" or here.tag in HEADINGS and name in HEADINGS:
                here = left(here)
            if name in CLOSES:
                box = here.stop
                while box.tag not in CLOSES[name] and box.tag not in SCOPE and box.parent is not None:
                    box = box.parent.stop
                if box.tag in CLOSES[name]:
                    here = left(box)
            mark, weight, main = _marks(m[3], here.inside) if m[3] else (0, 0.0, False)
            if name in ASIDE_TAGS:
                mark = 2
            elif name in SOFT_TAGS and not (name == "header" and here.inside):
                mark = max(mark, 1)
            box = _Box(name, here, 0 if name == "body" else mark, weight, main)
            opened[name] += 1
            here.children.append(box)
            here.items.append(box)
            here = box
    ended()
    return root


def _above(box: _Box | None) -> Iterator[_Box]:
    while box is not None:
        yield box
        box = box.parent


def _all(root: _Box) -> list[_Box]:
    """A box and all that it holds, in page order: a box comes before what it holds."""
    found, stack = [], [root]
    while stack:
        box = stack.pop()
        found.append(box)
        stack.extend(reversed(box.children))
    return found


def _weighed(boxes: list[_Box]) -> float:
    """The points of all paragraphs, of which marked boxes keep a part, added up for each box."""
    for box in boxes:
        if box.parent is not None:
            box.factor = box.parent.factor * (1.0, SOFT, HARD)[box.mark]
        box.mass = box.own * box.factor
    for box in reversed(boxes):
        if box.parent is not None:
            box.parent.mass += box.mass
    return boxes[0].mass


def _scored(root: _Box) -> list[_Box]:
    """All boxes, scored: paragraphs pass points for their length and commas to their parent, and half of them to its
    parent. Marks reduce points; where no article stands outside of marked boxes, a mark doesn't count on a box that holds
    most of the page's points. Boxes come before what they hold, so backwards all is added up in one pass at any depth."""
    boxes = _all(root)
    given = []
    for box in reversed(boxes):
        for block, links in (x for x in box.items if not isinstance(x, _Box)):
            box.chars += len(block)
            box.links += links
            if box.tag not in HEADINGS and len(block) >= 25:
                points = 1 + block.count(",") + min(len(block) // 100, 3)
                box.own += points * (1 - links / len(block))
                given.append((box, points))
        if box.parent is not None:
            box.parent.chars += box.chars
            box.parent.links += box.links
    total = _weighed(boxes)
    if not any(x.chars and x.factor == 1 and (x.main or x.tag == "article") for x in boxes):
        for box in boxes:
            if box.mark and box.mass >= MOST * total > 0 and box.tag not in ASIDE_TAGS:
                box.mark = 0
        _weighed(boxes)
    for box, points in given:
        holder = box.parent if box.tag in ("p", "pre", "li", "dd", "dt", "blockquote") and box.parent is not None else box
        for k, above in zip((1, 0.5, 0.25), _above(holder), strict=False):
            above.score += points * box.factor * k
    for box in boxes:
        if box.score > 0:
            box.score += {"article": 20, "main": 15, "section": 3, "div": 5, "td": 3}.get(box.tag, 0) * box.factor + box.weight * box.factor
    return boxes


def _value(box: _Box) -> float:
    return box.score * (1 - box.links / box.chars) if box.chars else 0.0


def _scope(boxes: list[_Box]) -> _Box:
    """The page's <main>, or else its <article> with the most points, if it has a fair part of the page's unmarked ones; or the page."""
    total = sum(x.own for x in boxes if x.factor == 1)
    for kind in ([x for x in boxes if x.main], [x for x in boxes if x.tag == "article"]):
        best = max(kind, key=lambda x: x.mass, default=None)
        if best is not None and best.chars and best.mass >= ENOUGH * total and (best.mass or len(kind) == 1):
            return best
    return boxes[0]


def _judged(boxes: list[_Box], path: set[int]) -> None:
    """Marked boxes are beside the article, with all they hold, but for those that hold the best container. Then each box
    knows how many long paragraphs it holds that aren't."""
    for box in boxes:
        box.bad = box.parent is not None and box.parent.bad or box.mark > 0 and id(box) not in path
        box.plain = 0
    for box in reversed(boxes):
        if not box.bad:
            box.plain += sum(len(x[0]) >= PARAGRAPH and x[1] < LINKED * len(x[0]) for x in box.items if not isinstance(x, _Box))
            if box.parent is not None:
                box.parent.plain += box.plain


def _texts(box: _Box, out: list[str], path: set[int], inner: _Box | None) -> None:
    """The blocks of a box and of what it holds, in page order, without parts beside the article. Next to boxes that hold
    the best container (inner), lists of links are left out too; in it they are the article's own."""
    stack = [(box, iter(box.items))]
    while stack:
        holder, items = stack[-1]
        outside = id(holder) in path and holder is not inner
        for item in items:
            if isinstance(item, _Box):
                if not item.bad and not (outside and id(item) not in path and item.tag not in HEADINGS and item.chars and item.links >= LINKED * item.chars):
                    stack.append((item, iter(item.items)))
                    break
            else:
                out.append(item[0])
        else:
            stack.pop()


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line feeds: those of the lowest box that holds all its paragraphs, without parts
    that are marked as beside it. <main> or <article> is that box where it has a fair part of the page's points; otherwise
    it is found by climbing from the best container, and headings next to it count too. Marks lower scores, and never cut
    off what holds the best container."""
    if not page:
        return ""
    root = _tree(page)
    boxes = _scored(root)
    scope = _scope(boxes)
    best = max((x for x in _all(scope) if x.tag not in PARTS), key=_value, default=scope)
    out: list[str] = []
    if _value(best) <= 0:  # nothing long enough for a score: all that isn't beside the article
        best = scope
    path = {id(x) for x in _above(best)}
    _judged(boxes, path)
    if scope is not root or best is root:
        _texts(scope, out, path, best)
        if not out and best is scope:  # marked as a whole: what its tags don't exclude
            for box in boxes:
                box.bad = box.parent is not None and box.parent.bad or box.tag in ASIDE_TAGS
            _texts(scope, out, path, best)
        return "\n".join(out)
    region = best
    while region.plain < root.plain:
        region = region.parent
    if region.parent is None:
        _texts(region, out, path, best)
        return "\n".join(out)
    for item in region.parent.items:
        if isinstance(item, _Box) and (item is region or item.tag in HEADINGS and not item.bad):
            _texts(item, out, path, best)
    return "\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html; other columns are ignored). One pass, no
    shuffle. The whole html is read. A null, empty or textless page gives an empty text; a page that breaks off gives
    what it has; a tag or character reference that breaks off at the end is dropped or kept as it is. Repeated rows
    give repeated rows, an empty table none."""
    batches_held(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html")).mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
