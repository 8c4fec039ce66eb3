"""Main text of web pages by two passes of block rules.

A page is read once from left to right as a run of tags and text and cut into blocks at block-level tags; end tags that HTML lets an
author leave out are supplied, and whatever is open ends with its parent. Subtrees that are boilerplate by their tag give none. Pass
one decides each block by link density, length and stop-word density; a block of an article element is judged a step more kindly, one
with a mark in its classes less kindly: not at all if a whole class names boilerplate, unless the element holds most of the page's text, a
step if a part does. Pass two lets undecided blocks take the label of their nearest decided neighbours; those of an article
look no further than its ends, which count as text. An article without text by the densities alone, on a page with such text outside
of it, is a teaser and has no such preference.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: Elements whose subtree is never article text (a header or figure of an article may be), and those whose content is not markup.
DROPPED = frozenset("nav footer aside form menu button select dialog noscript iframe object svg canvas template head".split())
OUTSIDE = frozenset("header figure".split())
RAW = ("script", "style", "title", "textarea", "xmp")
BLOCKS = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: What a start tag ends: elements open above the nearest of the second set.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())), "dt": (frozenset("dt dd".split()), frozenset(["dl"])), "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])), "td": (frozenset("td th".split()), frozenset("tr table".split())), "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])), "body": (frozenset(["head"]), frozenset()),
}
#: Names of boilerplate in a class, id or role; and words that may go with them in a name of several parts.
MARKS = (
    r"ads?|advert\w*|adsense|alert|banner|breadcrumbs?|captcha|comments?|commentlist|complementary|consent|contentinfo|cookies?|copyright|discussion|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar"
    r"|navigation|newsletter|notice|pager|pagination|popup|promo|promoted|rail|related|replies|respond|search|share|sharing|sidebar|signup|social|sponsor\w*|subscribe|subscription|teaser|toolbar|widget"
)
WITH = "area|article|bar|block|bottom|box|buttons?|container|form|global|inner|items?|left|links|list|main|page|panel|post|primary|reader|right|secondary|section|site|slot|thread|top|unit|user|wrap|wrapper"
NAMED = re.compile(rf"(?:^|\s)(?:(?:{MARKS}|{WITH}|\d+)[_-]+)*(?:{MARKS})(?:[_-]+(?:{MARKS}|{WITH}|\d+))*(?=$|\s)")
PART = re.compile(rf"(?:^|[\s_-])(?:{MARKS})(?=$|[\s_-])")
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|discussion|disqus|replies|respond)(?=$|[\s_-])")
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style|href)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?", re.I)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in RAW}
#: Frequent function words of English, German, French and Spanish.
STOP = frozenset(
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so "
    "der die das und ist in den von zu mit sich auf für nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen "
    "le la les de des et un une du est que qui dans pour pas sur au plus par ce il ne se sont avec "
    "el los las y del una por con su para al lo como más pero sus se".split()
)
MAX_LINKS, LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH = 0.5, 70, 200, 0.2, 0.3
#: Named elements that are told apart inside each other; deeper ones go with them.
DEPTH = 16
#: Share of the text by density beyond which a named element wraps the page.
WRAPS = 0.6
GOOD, BAD, SHORT, NEAR = 1, 0, 2, 3


@dataclass
class Open:
    """An open element: what ends with it."""

    tag: str
    skips: bool = False
    named: int = 0  # a number of its own for an element with a class that names boilerplate
    part: bool = False
    link: bool = False
    article: bool = False


@dataclass
class Block:
    text: str
    linked: int  # characters in links
    article: int  # number of the outermost article around it, 0: none
    named: tuple[int, ...]
    part: bool


class Page:
    """A page's blocks, read in one pass: every character is looked at a bounded number of times."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.comments: set[int] = set()  # of the elements that are named, those of readers' comments
        self.stack: list[Open] = []
        self.open = Counter()  # by tag
        self.skips = self.links = self.parts = self.inside = self.articles = self.names = 0
        self.named: list[int] = []
        self.buffer: list[str] = []
        self.linked = 0
        self.read(page)
        self.flush()

    def flush(self) -> None:
        if self.buffer:
            if text := " ".join(html.unescape("".join(self.buffer)).split()):
                self.blocks.append(Block(text, self.linked, self.articles if self.inside else 0, tuple(self.named), self.parts > 0))
            self.buffer.clear()
        self.linked = 0

    def push(self, e: Open) -> None:
        self.stack.append(e)
        self.open[e.tag] += 1
        self.skips += e.skips
        self.links += e.link
        self.parts += e.part
        if e.article:
            self.articles += not self.inside
            self.inside += 1
        if e.named:
            self.named.append(e.named)

    def pop(self) -> Open:
        e = self.stack.pop()
        if e.tag in BLOCKS or e.skips or e.named or e.part:
            self.flush()
        self.open[e.tag] -= 1
        self.skips -= e.skips
        self.links -= e.link
        self.parts -= e.part
        self.inside -= e.article
        if e.named:
            self.named.pop()
        return e

    def close(self, tags: frozenset[str], within: frozenset[str]) -> None:
        """End the outermost of the tags that is open above the nearest of `within`."""
        if not any(self.open[t] for t in tags):
            return
        at = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag in within:
                break
            if self.stack[i].tag in tags:
                at = i
            if len(self.stack) - i > 512:  # no author nests cells so deep: they stay open until their parent ends
                break
        while at is not None and len(self.stack) > at:
            self.pop()

    def start(self, tag: str, attributes: str, own_end: bool) -> None:
        if self.open["head"] and tag not in IN_HEAD and tag != "head":
            self.close(frozenset(["head"]), frozenset())
        if tag in ENDS:
            self.close(*ENDS[tag])
        elif tag in BLOCKS and self.stack and (self.stack[-1].tag == "p" or self.open["p"] and self.stack[-1].tag not in BLOCKS):
            self.close(frozenset(["p"]), BLOCKS - {"p"})
        if tag in BLOCKS or tag in DROPPED:
            self.flush()
        if tag == "br":
            if not self.skips:
                self.buffer.append(" ")
            return
        if tag in VOID or own_end and tag not in BLOCKS:
            return
        if tag == "a":
            if self.open["a"]:
                self.close(frozenset(["a"]), BLOCKS)
            self.push(Open("a", link=bool(re.search(r"(?:^|\s)href\s*=", attributes, re.I))))
            return
        e = Open(tag, skips=tag in DROPPED or tag in OUTSIDE and not self.inside, article=tag in ("article", "main"))
        if attributes and not e.skips:
            self.judge(e, attributes)
        if tag in BLOCKS or e.skips or e.named or e.part:
            if not e.tag in BLOCKS:
                self.flush()
            self.push(e)

    def judge(self, e: Open, attributes: str) -> None:
        named = part = comments = False
        for name, *values in ATTRIBUTE.findall(attributes):
            value, name = "".join(values).lower(), name.lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                e.skips = True
            elif name in ("class", "id", "role") and value and PART.search(value):
                named |= bool(NAMED.search(value))
                comments |= bool(COMMENTS.search(value))
                part = True
        if e.tag in ("html", "body"):
            return
        if (named or comments) and len(self.named) < DEPTH:
            self.names += 1
            e.named = self.names
            if comments:
                self.comments.add(self.names)
        e.part = part and not named and not e.article

    def end(self, tag: str) -> None:
        if not self.open[tag]:
            if tag in BLOCKS:
                self.flush()
            return
        while self.pop().tag != tag:
            pass

    def read(self, page: str) -> None:
        at, size, tag_at = 0, len(page), TAG
        while at < size:
            lt = page.find("<", at)
            if lt < 0:
                lt = size
            if lt > at:
                self.text(page[at:lt])
                at = lt
            if at >= size:
                return
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if page.startswith(("<!", "<?"), at):
                end = page.find(">", at)
                at = size if end < 0 else end + 1
                continue
            m = tag_at.match(page, at)
            if m is None and tag_at is TAG and PLAIN_TAG.match(page, at):
                tag_at, m = PLAIN_TAG, PLAIN_TAG.match(page, at)  # a quote is never closed: from here on tags end at the next >
            if m is None:
                if page.find(">", at) < 0:  # no more tags
                    self.text(page[at:])
                    return
                self.text("<")
                at += 1
                continue
            at, tag = m.end(), m[2].lower()
            if m[1]:
                self.end(tag)
                continue
            if tag in RAW_END:
                end = RAW_END[tag].search(page, at)
                at = end.end() if end else size
                continue
            self.start(tag, m[3], m[3].endswith("/"))

    def text(self, piece: str) -> None:
        if self.skips:
            return
        self.buffer.append(piece)
        if self.links:
            self.linked += len(piece)


def by_density(text: str, linked: int) -> int:
    n = len(text)
    if linked > MAX_LINKS * n:
        return BAD
    if n < LENGTH_LOW:
        return BAD if linked else SHORT
    w = text.lower().split()
    share = sum(x.strip(".,;:!?()\"'") in STOP for x in w) / len(w)
    return (GOOD if n > LENGTH_HIGH else NEAR) if share >= STOP_HIGH else NEAR if share >= STOP_LOW else BAD


def wrappers(page: Page, plain: list[int]) -> set[int]:
    """The named elements that hold most of the page's text by density: they wrap the page, whatever they are called. Comments never do."""
    held, total = Counter(), 0
    for b, x in zip(page.blocks, plain):
        if x == GOOD and not page.comments.intersection(b.named):
            total += len(b.text)
            held.update({k: len(b.text) for k in b.named})
    return {k for k, n in held.items() if n > WRAPS * total and k not in page.comments}


def labels(page: Page) -> list[int]:
    """Pass one, then pass two: short blocks go with the nearest decided neighbours, near ones need one good neighbour."""
    found = page.blocks
    plain = [by_density(b.text, b.linked) for b in found]
    wrap = wrappers(page, plain)
    low = [any(k not in wrap for k in b.named) for b in found]
    good = {b.article for b, x, no in zip(found, plain, low) if x == GOOD and not no}
    kind = [b.article if b.article in good or 0 not in good else 0 for b in found]  # 0 for teasers

    def first_pass(b: Block, k: int, x: int, no: bool) -> int:
        if no:
            return BAD
        if b.part and not k:
            return {GOOD: NEAR, NEAR: BAD}.get(x, x)
        if not k or b.linked > MAX_LINKS * len(b.text):
            return x
        return GOOD if x == GOOD or x == NEAR and len(b.text) >= LENGTH_LOW else NEAR

    first = [first_pass(*args) for args in zip(found, kind, plain, low)]

    def sides(step: int) -> list[int]:
        """The label of the nearest decided block before (1) or after (-1) each, within its article."""
        out, last = [BAD] * len(first), {0: BAD}
        for i in range(len(first))[::step]:
            out[i] = last.get(kind[i], GOOD)
            if first[i] in (GOOD, BAD) and not low[i]:
                last[0] = last[kind[i]] = first[i]
        return out

    return [int(a or b) if x == NEAR else int(a and b) if x == SHORT else x for x, a, b in zip(first, sides(1), sides(-1))]


def main_text(page: str) -> str:
    read = Page(page)
    return "\n".join(b.text for b, good in zip(read.blocks, labels(read)) if good)


def extracted(page: Column) -> Column:
    """The main text of a page's html; null and empty pages, and pages without any, give an empty string."""

    @F.arrow_udf("string")
    def of(batch: pa.Array) -> pa.Array:
        return pa.array([main_text(x.as_py() or "") for x in batch], pa.string())

    return of(page)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row of pages. Rows are independent, so repeats and ties do not matter; null and empty pages give
    an empty text; very long pages and tags are read whole, in linear time; other columns are not read; an empty table gives no rows."""
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), extracted(text_of(html_col)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


SQL: dict[str, str] = {}
QUERIES = {"op5_html_text": op5_html_text}
