"""Main text of web pages by consensus of their hosts.

Each page's containers are scored by the running text below them, and the page votes for the generalised tag-class path
of its best one. Spark counts the votes of each host, and every page is read again with its host's winning path; pages
without such a container keep their own best one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pennant.llm.common import id_in, id_out, small, written

# Elements by their part in a page.
RAW = "script style noscript template iframe svg canvas object audio video textarea title annotation annotation-xml".split()
DROPPED = "head nav footer aside form button select dialog menu".split()
VOID = "area base br col embed hr img input link meta param source track wbr".split()
INLINE = (
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math semantics maction merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover"
).split()
PARAGRAPH = "p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption option pre blockquote ul ol dl hr table tbody thead tfoot figure summary address".split()
ARTICLE = "article main".split()
# Words in class or id that mark what is no article text.
BOILERPLATE = (
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navigation navbar menu "
    "sidebar footer header masthead breadcrumb breadcrumbs cookie cookies consent notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login share sharing social related recommended comment comments disqus reply "
    "replies pagination pager toolbar widget copyright legal disclaimer"
).split()
# Those of them that mark readers' comments.
COMMENTS = "comment comments disqus reply replies".split()
# Elements whose class or id never makes them boilerplate, and those whose id is a heading's as a rule.
EXEMPT = "html body article main h1 h2 h3 h4 h5 h6 hgroup figure".split()
TITLED = "section p li dt dd td th tr table blockquote pre".split()
# First words of classes that say of what kind a page or article is, or what it has beside it, not what it is.
TELLING = "no has with without hide hidden show is not enable disable category categories cat tag tags topic keyword lang section theme type format status layout template".split()
# Words beside "header" that make it the article's own.
OWN_HEADER = "article entry post story content".split()
ROLES = "navigation banner contentinfo complementary search form dialog alert menu menubar".split()

_RAW, _DROPPED, _VOID, _INLINE, _PARAGRAPH, _ARTICLE, _BOILERPLATE, _OWN_HEADER, _ROLES, _COMMENTS, _EXEMPT, _TITLED, _TELLING = (
    frozenset(x) for x in (RAW, DROPPED, VOID, INLINE, PARAGRAPH, ARTICLE, BOILERPLATE, OWN_HEADER, ROLES, COMMENTS, EXEMPT, TITLED, TELLING)
)
#: An open paragraph ends where one of these begins.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Comments and declarations, tags (the second form without quotes that never close), text. A tag ends before the next <.
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</(?![a-zA-Z])[^<>]*>"""
    r"""|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|[^<]+|<""",
    re.S,
)
_END_OF = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I) for tag in RAW}
#: One attribute after the other, so that a name inside a quoted value is none.
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Block:
    """A run of text, its innermost container and marked element, whether it may be article text, its characters in links,
    whether in an h1."""

    __slots__ = ("text", "container", "mark", "good", "linked", "title")

    def __init__(self, text: str, container: int, mark: int, good: bool, linked: int, title: bool):
        self.text, self.container, self.mark, self.good, self.linked, self.title = text, container, mark, good, linked, title

    def worth(self) -> int:
        return max(0, len(self.text) - 2 * self.linked) * self.good


class Page:
    """Blocks in page order, containers by number, and the paths of containers, each a step below another path.

    Container 0 and path 0 are the page itself; a container or path comes after the one it lies in. So every sum over
    containers is one walk from the last to the first, however deep they lie.
    """

    def __init__(self):
        self.blocks: list[Block] = []
        self.outer, self.path_of = [0], [0]  # of each container
        self.above, self.step, self.in_article = [0], [""], [False]  # of each path
        self.below: dict[tuple[int, str], int] = {}
        #: Elements that their class or id marks as boilerplate: the one around each, and whether it marks comments; 0 is none.
        self.around, self.comments = [0], [False]
        self.heads: list[tuple[int, bool]] = []  # of article, main and h1 elements: the mark they lie in, whether h1

    def judge_marks(self) -> None:
        """Take what lies in marked elements for no article text, but for those that must be the article itself.

        A mark must not empty a page, as a theme may name the whole of it so. A marked element is spared if it has an
        article, main or h1 element and over half of the page's running text; if the page has no such element, one with
        nine tenths of the text; of those that mark comments, one with an h1 and nine tenths.
        """
        inside, heads, titles = ([0] * len(self.around) for _ in range(3))
        for block in self.blocks:
            inside[block.mark] += block.worth()
        for mark, is_title in self.heads:
            heads[mark] += 1
            titles[mark] += is_title
        for mark in range(len(inside) - 1, 0, -1):
            around = self.around[mark]
            inside[around] += inside[mark]
            titles[around] += titles[mark]
            heads[around] += titles[mark] if self.comments[mark] else heads[mark]  # comments may be article elements
        gone = [False] * len(inside)
        for mark in range(1, len(inside)):
            share = inside[mark] / max(1, inside[0])
            spared = titles[mark] and share > 0.9 if self.comments[mark] else share > 0.5 if heads[mark] else share > 0.9 and not heads[0]
            gone[mark] = gone[self.around[mark]] or not spared
        for block in self.blocks:
            block.good = block.good and not gone[block.mark]

    def add(self, container: int, step: str) -> int:
        """A container inside another; returns its number."""
        above = self.path_of[container]
        path = self.below.get((above, step))
        if path is None:
            path = self.below[above, step] = len(self.step)
            self.above.append(above)
            self.step.append(step)
            self.in_article.append(self.in_article[above] or _tag(self.step[above]) in _ARTICLE)
        self.outer.append(container)
        self.path_of.append(path)
        return len(self.outer) - 1

    def named(self, path: int) -> str:
        steps = []
        while path:
            steps.append(self.step[path])
            path = self.above[path]
        return ">".join(reversed(steps))

    def find(self, name: str) -> int | None:
        """The path with this name."""
        path = 0
        for step in name.split(">") if name else []:
            path = self.below.get((path, step))
            if path is None:
                return None
        return path

    def sums(self, values: list[int]) -> list[int]:
        """For each path, the sum of the blocks' values in containers with it."""
        total = [0] * len(self.outer)
        for block, value in zip(self.blocks, values, strict=True):
            total[block.container] += value
        of_path = [0] * len(self.step)
        for container in range(len(total) - 1, -1, -1):
            of_path[self.path_of[container]] += total[container]
            if container:
                total[self.outer[container]] += total[container]
        return of_path


def _tag(step: str) -> str:
    return step.split(".", 1)[0]


def _boilerplate_words(names: list[str], own: bool) -> set[str]:
    """The words of BOILERPLATE that classes or ids are by their whole, first or last word; `own`: a header is the article's.

    A first word of TELLING makes the rest a description, as in has-sidebar or tag-legal.
    """
    found: set[str] = set()
    for name in names:
        words = [w for w in re.split(r"[^a-z]+", name.lower()) if w]
        if words and (len(words) == 1 or words[0] not in _TELLING):
            found.update({words[0], words[-1]} & _BOILERPLATE)
    if own:
        found.discard("header")
    return found


def _marks(tag: str, attributes: str, in_article: bool) -> tuple[bool, set[str], str]:
    """Whether an element holds no article text for its tag, role or being hidden, the boilerplate words of its class and
    id, and its generalised tag and classes."""
    dropped = tag in _DROPPED or tag == "header" and not in_article
    if not attributes:
        return dropped, set(), tag
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), value.strip("\"'"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    dropped = dropped or hidden or found.get("role", "").lower() in _ROLES
    classes = found.get("class", "").split()
    words: set[str] = set()
    if tag not in _EXEMPT:
        parts = {w for name in [*classes, found.get("id", "")] for w in re.split(r"[^a-z]+", name.lower())}
        own = in_article or not _OWN_HEADER.isdisjoint(parts)
        words = _boilerplate_words(classes, own)
        by_id = _boilerplate_words([found.get("id", "")], own)
        words |= by_id & _COMMENTS if tag in _TITLED else by_id
    return dropped, words, ".".join([tag, *sorted({re.sub(r"[\d>]+", "#", c) for c in classes})])


def read_page(html: str) -> Page:
    """The page's blocks and containers, in time that grows with its length only."""
    page = Page()
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, whether a container, dropped, marked
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    text: list[str] = []
    here = links = linked = bad = articles = mark = 0

    def close_block() -> None:
        nonlocal linked
        whole = " ".join(unescape("".join(text)).split())
        if whole:
            page.blocks.append(Block(whole, here, mark, not bad, min(linked, len(whole)), open_tags["h1"] > 0))
        text.clear()
        linked = 0

    def pop() -> None:
        nonlocal here, bad, articles, mark
        tag, container, was_bad, marked = stack.pop()
        open_tags[tag] -= 1
        if container:
            here = page.outer[here]
        bad -= was_bad
        if marked:
            mark = page.around[mark]
        articles -= tag in _ARTICLE

    place = 0
    while place < len(html):
        token = _TOKEN.match(html, place)
        place = token.end()
        tag = token[2] or token[5]
        if tag is None:
            if token[0][0] != "<" or len(token[0]) == 1:
                text.append(token[0])
                linked += len(token[0]) * (links > 0)
            continue
        tag, ending, attributes = tag.lower(), (token[1] or token[4]) == "/", token[3] or token[6] or ""
        closed = attributes.endswith("/")
        if tag in _RAW:
            # what it holds is no markup, so its own end is looked for
            if not ending and not closed and tag not in unclosed:
                end = _END_OF[tag].search(html, place)
                if end:
                    place = end.end()
                else:
                    unclosed.add(tag)
                    if tag in ("script", "style"):
                        place = len(html)
            continue
        if tag in _INLINE:
            if tag == "a":
                links = 0 if ending else 1
            elif tag == "br":
                text.append(" ")
            continue
        close_block()
        links = 0
        if ending:
            if open_tags[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in _VOID or closed and tag not in _PARAGRAPH:
            continue
        while stack and (stack[-1][0] == "p" or stack[-1][0] in _ENDS.get(tag, ()) or stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit()):
            pop()
        is_bad, words, step = _marks(tag, attributes, articles > 0)
        container = tag not in _PARAGRAPH
        if container:
            here = page.add(here, step)
        bad += is_bad
        if words:
            page.around.append(mark)
            page.comments.append(not words.isdisjoint(_COMMENTS))
            mark = len(page.around) - 1
        if tag in _ARTICLE or tag == "h1":
            page.heads.append((mark, tag == "h1"))
        articles += tag in _ARTICLE
        stack.append((tag, container, is_bad, bool(words)))
        open_tags[tag] += 1
    close_block()
    page.judge_marks()
    return page


def best_path(page: Page, most: float = 0.95) -> tuple[int, int]:
    """(path, score): the path of the page's article, and the running text in containers with it.

    Every share is one of the whole page's running text, and containers with the same path count together. The article
    or main elements that are in no other are taken whole if they hold more than half. Without such, the path goes down
    while containers hold `most` and what they leave out has neither text of the outer container's own nor an h1.
    """
    worth = [b.worth() for b in page.blocks]
    score = page.sums(worth)
    for path, step in enumerate(page.step):
        if not page.in_article[path] and _tag(step) in _ARTICLE and 2 * score[path] > score[0]:
            return path, score[path]
    titles = page.sums([int(b.good and b.title) for b in page.blocks])
    own = [0] * len(page.step)
    for block, value in zip(page.blocks, worth, strict=True):
        own[page.path_of[block.container]] += value
    here = 0
    for path in range(1, len(page.step)):
        if page.above[path] == here and score[path] > 0 and score[path] >= most * score[0]:
            if own[here] or titles[here] > titles[path]:
                break
            here = path
    return here, score[here]


def text_of(page: Page, path: str | None) -> str:
    """The good blocks inside containers with the path, or with the page's own best path if they have none."""

    def inside(path: int | None) -> list[str]:
        if path is None:
            return []
        chosen = [of == path for of in page.path_of]
        for container in range(1, len(chosen)):
            chosen[container] |= chosen[page.outer[container]]
        return [b.text for b in page.blocks if b.good and chosen[b.container]]

    found = inside(page.find(path)) if path is not None else []
    return "\n\n".join(found or inside(best_path(page)[0]))


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for host, html in zip(batch["host"], batch["html"], strict=True):
            page = read_page(html)
            path, score = best_path(page)
            if score > 0:
                rows.append((host, page.named(path)))
        yield pd.DataFrame(rows, columns=["host", "path"])


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts = [text_of(read_page(html), path) for html, path in zip(batch["html"], batch["path"], strict=True)]
        yield batch[["page_id", "url", "path"]].assign(text=texts)


def extract(pages: DataFrame) -> DataFrame:
    """The main text of pages (page_id, url, html).

    Returns page_id, url, path (the host's winning path, or null if no page of the host has running text) and text:
    blocks in page order, white space within one as a blank, joined by two line ends. Null or empty html has an empty
    text; null urls and those without a host vote together, as one host; a null page_id stays null; repeated rows come out each and vote
    each; an empty table gives no rows; pages may be of any length and depth, read in time that grows with their length;
    other columns are ignored.
    """
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    read = pages.select(id_in("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    votes = read.select("host", "html").mapInPandas(_votes, "host string, path string").groupBy("host", "path").agg(F.count("*").alias("n"))
    most = votes.groupBy("host").agg(F.max("n").alias("n"))
    winners = written(votes.join(most, ["host", "n"]).groupBy("host").agg(F.min("path").alias("path")), "paths")
    with_path = read.join(small(winners), "host", "left").select("page_id", "url", "html", "path")
    return with_path.mapInPandas(_texts, "page_id long, url string, path string, text string").withColumn("page_id", id_out("page_id"))
