"""Main text of web pages by tree scoring."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplet.llm.encoding import portions

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = frozenset("script style noscript template textarea title iframe xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are part of the main text beside them unless they are links.
BESIDE = frozenset("p pre ul ol dl blockquote table figure section".split())
#: Elements that are never main text.
AWAY = frozenset("head nav footer aside form button select option label input menu dialog svg math canvas object audio video fieldset datalist map".split())
#: Names in class, id or role that mark what isn't main text; as a part of a name they only raise a doubt.
AWAY_NAMES = frozenset("ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promotion promotions banner banners cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations widget widgets login search searchbox pagination pager toolbar skip masthead contentinfo complementary".split())
#: Words of AWAY_NAMES that mark what readers wrote.
READERS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: What after a first word, or before a last one, takes its meaning away: a name of a layout, or that something isn't there.
LAYOUT = frozenset("free less wrap wrapper wrapped container layout grid".split())
WITHOUT = frozenset("has have with no without is content".split())
#: Words of AWAY_NAMES that also begin or end names of what belongs to a text (related-work).
OPEN_WORDS = frozenset("related recommended recommendations alert skip search".split())
#: Characters that have to be left beside readers' comments.
LEAST_REST = 140
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What an implied end doesn't reach over.
FENCE = frozenset("table ul ol dl div article section body blockquote td th main".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
#: The same, but a tag ends before the next one even if a quote is open.
_STRICT = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+)>", re.S)
#: So many tags without an end are read on to the end of the page; from then on they are read as _STRICT has it, so that the
#: time for a page of such tags grows with its length only.
OPEN = 20
_NAME = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_SENTENCE = re.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _next(page: str, at: int, open_tags: list[int]) -> re.Match[str] | None:
    """The next comment, declaration or tag from a place on; open_tags counts those without an end."""
    while (at := page.find("<", at)) >= 0:
        found = (_TOKEN if open_tags[0] < OPEN else _STRICT).match(page, at)
        if found:
            return found
        open_tags[0] += page[at + 1 : at + 2] in "/!?" or page[at + 1 : at + 2].isalpha()
        at += 1
    return None


class _Node:
    __slots__ = ("away", "byline", "holds", "lead", "link", "mark", "parent", "prose", "score", "size", "tag", "told", "whole")

    def __init__(self, tag: str, parent: _Node | None, away: bool, mark: int = 0) -> None:
        self.tag, self.parent, self.away, self.mark, self.holds = tag, parent, away, mark, False
        self.score, self.size, self.link, self.told, self.prose = 0.0, 0, 0, False, False
        self.lead, self.whole = 0, 0  # _lead() of its names; characters in it, whatever becomes of them
        self.byline = tag == "header" or parent is not None and parent.byline

    def plain(self) -> bool:
        return self.link < 0.25 * self.size


def _away(tag: str, attributes: str, inside: bool) -> bool:
    if tag in AWAY or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    return False


def _mark(tag: str, attributes: str, inside: bool) -> int:
    """2 if a class, id or role is one of AWAY_NAMES, 1 if a part of one is, else 0."""
    mark = 0
    if attributes and tag not in ("html", "body", "article", "main"):
        for found in _NAME.finditer(attributes):
            for name in (found[1] or found[2] or found[3] or "").split():
                low = name.lower()
                if low in AWAY_NAMES or low == "header" and not inside:
                    return 2
                for part in _PART.findall(name):
                    part = part.lower()
                    if part in AWAY_NAMES or part == "header" and not inside:
                        mark = 1
    return mark


def _lead(tag: str, attributes: str) -> int:
    """2 if the first or last word of a class, id or role marks readers' words, 1 if it is another of AWAY_NAMES, else 0."""
    lead = 0
    if attributes and tag not in ("html", "body", "article", "main"):
        for found in _NAME.finditer(attributes):
            for name in (found[1] or found[2] or found[3] or "").split():
                words = [x.lower() for x in _PART.findall(name)]
                if len(words) < 2:
                    continue
                ends = [words[0]] * (words[1] not in LAYOUT) + [words[-1]] * (words[0] not in WITHOUT)
                lead = max(lead, 2 if READERS.intersection(ends) else 1 if (AWAY_NAMES - OPEN_WORDS).intersection(ends) else 0)
    return lead


def _scope(node: _Node) -> _Node:
    """The article, main or body about an element, or the page."""
    up = node.parent
    while up and up.parent and up.tag not in ("article", "main", "body"):
        up = up.parent
    return up or node


def _judge(leads: list[_Node]) -> None:
    """Elements that the first or last word of a name marks are left out as if it were the whole name, if their article holds as
    much beside all such elements as an element has, or, beside readers' comments, a few sentences; however long these are."""
    dropped: dict[_Node, int] = {}
    for node in leads:
        up, outer = node.parent, True
        scope = _scope(node)
        while up and up is not scope:
            outer &= not up.lead or up.holds
            up = up.parent
        if outer:
            dropped[scope] = dropped.get(scope, 0) + node.whole
    for node in leads:
        scope = _scope(node)
        rest = scope.whole - dropped.get(scope, 0)
        if rest >= (LEAST_REST if node.lead == 2 else node.whole):
            node.mark = 2


def _in_heading(node: _Node | None) -> bool:
    while node and node.tag != "header":
        if node.tag in HEADINGS:
            return True
        node = node.parent
    return False


def main_text(page: str | None) -> str:
    """The main text of a page; "" for none.

    Each block of text gives its container points: one, one for each comma, one for each 100 characters up to three,
    times the share of its text that is no link; half as many go to the next ancestor, a third, a fourth ... to those
    above. The container with the most points wins, and article and main start with some; inside an article or main, all
    of that is kept, however long it is. Beside the winner lists, quotes, sections and paragraphs stay if under a quarter
    of them is links, other elements if they have a sentence as well or 10 points, and headings of what stays.

    Of a header inside an article only headings stay; other headers go.

    An element that is named as something else is left out unless it holds an article or main. So is one whose name begins or
    ends with such a word (comment-list, post-sidebar), if that leaves as much as the element has, or, of readers' comments, a
    few sentences. If only another part of a name says so, its points count half, and it stays if under a quarter of it is links and, beside the winner, with 10 points.
    """
    if not page:
        return ""
    root = now = _Node("html", None, False)
    blocks: list[tuple[_Node, str, int]] = []  # where, text, characters in links
    text: list[str] = []
    leads: list[_Node] = []
    links = depth_link = 0

    def flush() -> None:
        nonlocal links
        if text:
            said = " ".join(html.unescape("".join(text)).split())
            if said:
                node = now
                while node.tag not in BLOCK and node.parent:
                    node = node.parent
                if not node.byline or _in_heading(node):
                    blocks.append((node, said, min(links, len(said))))
            text.clear()
        links = 0

    at, n = 0, len(page)
    inside, open_tags = 0, [0]
    while at < n:
        found = _next(page, at, open_tags)
        stop = found.start() if found else n
        if stop > at and not now.away:
            text.append(page[at:stop])
            if depth_link:
                links += stop - at
        if not found:
            break
        at = found.end()
        tag = found[3]
        if tag is None:
            if found[1] and not now.away:
                text.append(html.escape(found[1]))
            continue
        tag = tag.lower()
        if found[2]:
            node = now
            while node and node.tag != tag:
                node = node.parent
            if tag in BLOCK:
                flush()
            if node and node is not root:
                while True:
                    done, now = now, now.parent
                    depth_link -= done.tag == "a"
                    inside -= done.tag in ("article", "main")
                    if done is node:
                        break
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in BLOCK:
            flush()
            node = now
            if tag in CLOSES:
                while node and node.tag not in CLOSES[tag] and node.tag not in FENCE:
                    node = node.parent
                ends = node and node.tag in CLOSES[tag]
            elif tag != "br":
                while node and node.tag != "p" and node.tag not in FENCE:
                    node = node.parent
                ends = node and node.tag == "p"
            else:
                ends = False
            while ends:
                done, now = now, now.parent
                depth_link -= done.tag == "a"
                ends = done is not node
        if tag in VOID or found[4].endswith("/") and tag not in BLOCK:
            if tag not in BLOCK and tag != "wbr":
                text.append(" ")
            continue
        away = now.away or _away(tag, found[4], inside > 0)
        now = _Node(tag, now, away, 0 if away else _mark(tag, found[4], inside > 0))
        if now.mark == 1 and (lead := _lead(tag, found[4])):
            now.lead = lead
            leads.append(now)
        if tag in ("article", "main") and not away:
            node = now.parent
            while node and not node.holds:
                node.holds = True
                node = node.parent
        depth_link += tag == "a"
        inside += tag in ("article", "main")
    flush()
    if leads:
        for node, said, _ in blocks:
            while node:
                node.whole += len(said)
                node = node.parent
        _judge([x for x in leads if not x.holds])

    def marked(node: _Node) -> int:
        """The greatest mark of node and the elements about it, but of those that hold an article or main."""
        up, mark = node, 0
        while up:
            if up.mark > mark and not up.holds:
                mark = up.mark
            up = up.parent
        return mark

    def named(node: _Node) -> bool:
        up = node
        while up:
            if up.mark == 2:
                return True
            up = up.parent
        return False

    marks = [marked(node) for node, _, _ in blocks]
    blocks = [x for x, mark in zip(blocks, marks, strict=True) if mark < 2]
    best = root
    for (node, said, link), mark in zip(blocks, [m for m in marks if m < 2], strict=True):
        plain = 1 - link / len(said)
        points = (1 + said.count(",") + min(3, len(said) // 100)) * plain * (1 - 0.5 * mark)
        over, sentence = node, bool(_SENTENCE.search(said))
        while over:
            over.size += len(said)
            over.link += link
            over.prose |= sentence
            over = over.parent
        share, up = 1, node if node.tag not in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote") else node.parent
        node.score += points * (up is not node)
        while up:
            if not up.told:
                up.told = True
                up.score += {"article": 25, "main": 20}.get(up.tag, 0) * (not named(up))
            up.score += points / share
            if up.score > best.score and up.tag not in ("body", "html"):
                best = up
            share, up = share + 1, up.parent
    if not blocks:
        return ""
    for node, _, _ in blocks:
        up = node
        while up:
            if up.score > best.score and up.tag not in ("body", "html"):
                best = up
            up = up.parent
    if best is root:
        return " ".join(x[1] for x in blocks)
    up = best
    while up and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best

    def place(node: _Node) -> _Node | None:
        """best, its sibling or its parent, whichever the block is in first."""
        up = node
        while up and up is not best and up is not best.parent and up.parent is not best.parent:
            up = up.parent
        return up

    def stays(unit: _Node, said: str, link: int) -> bool:
        if unit is best:
            return True
        if unit is best.parent:
            return link < 0.25 * len(said) and bool(_SENTENCE.search(said))
        if unit.mark and not unit.holds:
            return unit.score >= 10 and unit.plain()
        return unit.score >= 10 or unit.plain() and (unit.tag in BESIDE or unit.prose)

    def linky(node: _Node, end: _Node | None) -> bool:
        """Whether an element from node up to below end has a doubtful name and many links."""
        up = node
        while up and up is not end:
            if up.mark and not up.holds and not up.plain():
                return True
            up = up.parent
        return False

    places = [(place(node), said, link) for node, said, link in blocks]
    kept = [unit is not None and unit.tag not in HEADINGS and stays(unit, said, link) and not linky(node, unit) for (node, _, _), (unit, said, link) in zip(blocks, places, strict=True)]
    # A heading stays if something does before the next heading of its rank.
    live = {h: False for h in HEADINGS}
    for i in reversed(range(len(places))):
        unit = places[i][0]
        if unit is not None and unit is not best and unit.tag in HEADINGS:
            kept[i] = live[unit.tag] and unit.plain()
            live.update({h: False for h in HEADINGS if h >= unit.tag})
            if kept[i]:
                live.update({h: True for h in HEADINGS if h < unit.tag})
        elif kept[i]:
            live = {h: True for h in HEADINGS}
    return " ".join(said for (_, said, _), k in zip(places, kept, strict=True) if k)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = batch.column(2).to_pylist()
        for part in portions(pages):
            texts = [main_text(x) for x in pages[part]]
            yield pa.RecordBatch.from_arrays([batch.column(0)[part.start : part.stop], batch.column(1)[part.start : part.stop], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html); no shuffle.

    Null and empty html give an empty text. Null or repeated ids and urls each keep their row; other columns are ignored.
    Very long pages are read whole, in time that grows with their length, broken markup included. No pages give no rows.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
