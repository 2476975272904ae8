"""Main text of web pages, by rules for markup and by removing what a site repeats.

Every element outside the article is hashed with all it holds. Spark counts on how many pages
of its host each hash occurs; what recurs on many is the site's template and is deleted before
the text is read. Menus, forms, notices and the like are known by their tags and names as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

#: A subtree is template if so many pages of its host have it, and that share of them.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.1

#: Elements without content, with no text to read, and that hold no article text.
VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
UNREAD = frozenset(
    "head title script style noscript template iframe object svg math canvas audio video "
    "select option datalist button textarea label input fieldset dialog".split()
)
AROUND = frozenset("nav footer aside menu search".split())
BLOCKS = frozenset(
    "html body main article section header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd "
    "blockquote pre table caption thead tbody tfoot tr figure figcaption address details "
    "summary center hgroup hr".split()
)
#: An element of the first kind ends where one of the second begins.
ENDED_BY = {
    "p": BLOCKS - {"html", "body", "li", "tr", "caption", "thead", "tbody", "tfoot"},
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
#: Words in class, id or role that name what is not the article.
COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
ADVERTS = frozenset(
    "ad adbox ads adsense adslot adunit advert advertisement advertising adverts "
    "sponsor sponsored".split()
)
NAMES = (
    COMMENTS
    | ADVERTS
    | frozenset(
        "alert banner breadcrumb breadcrumbs consent cookie cookiebar cookies disclaimer footer "
        "gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager "
        "pagination popup promo promoted promotion related search share sharing sidebar signup "
        "skip social subscribe subscription tags toolbar widget widgets complementary "
        "contentinfo".split()
    )
)
#: Names of a page's header.
HEADERS = frozenset(["header", "site header", "global header", "top header", "page top"])
#: First and last words of names that tell how a page is laid out or set up.
FLAGS = frozenset(
    "has have with without no not is are show shows hide hides allow allows enable enables "
    "content main".split()
)
STATES = frozenset(
    "open opened closed enabled disabled on off yes no allowed active layout page template "
    "theme".split()
)
#: What a name or a form never removes, but for an article named as a comment.
KEPT = frozenset("html body main article".split())
#: What a form that is wrapped around a page holds.
LANDMARKS = frozenset("article main nav header footer h1".split())
#: Elements of an article that may be template; its paragraphs and headings never are.
CONTAINERS = frozenset("div section aside ul ol dl table header figure details".split())

CAMEL = re.compile(r"([a-z])([A-Z])")

#: What a name says: a reader's comment, an advert, something else that is not the article, a header.
COMMENT, ADVERT, OTHER, HEADER = 1, 2, 4, 8


@lru_cache(65_536)
def _said_by(token: str) -> int:
    """What a whole class, id or role says.

    Its first or last word names the element: 'comment-list', 'post-comments', 'adSlot', but
    neither 'has-sidebar' nor 'comments-open', which name a state.
    """
    token = CAMEL.sub(r"\1 \2", token).lower()
    words = "".join(c if c.isalpha() else " " for c in token).split()
    if not words:
        return 0
    said = HEADER if " ".join(words) in HEADERS else 0
    if len(words) > 1 and (words[0] in FLAGS or words[-1] in STATES):
        return said
    for word in (words[0], words[-1]):
        if word in NAMES:
            said |= COMMENT if word in COMMENTS else ADVERT if word in ADVERTS else OTHER
    return said


class Element:
    """An element with its children (elements and texts) and, when it is closed, its hash."""

    __slots__ = ("tag", "said", "children", "hash", "marks", "size", "holds", "main", "wraps")

    def __init__(self, tag: str, attributes: list[tuple[str, str | None]]):
        self.tag, self.children, self.hash = tag, [], 0
        self.size, self.holds, self.main, self.wraps = 0, False, False, False
        self.marks, self.said = "", 0
        for key, value in attributes:
            if key in ("class", "id", "role"):
                self.marks += f" {key}={value}"
                for token in (value or "").split():
                    self.said |= _said_by(token)
            elif key == "hidden" or (key == "aria-hidden" and value == "true"):
                self.said |= OTHER

    def close(self) -> None:
        import xxhash

        parts = [self.tag, self.marks]
        for child in self.children:
            if isinstance(child, str):
                parts.append(" ".join(child.split()))
                self.size += len(parts[-1])
                continue
            parts.append(str(child.hash))
            self.wraps |= child.wraps or child.tag in LANDMARKS
            if child.tag in UNREAD or child.tag in AROUND:
                continue
            self.size += child.size
            self.main |= child.main or child.tag == "main"
            if not child.said & COMMENT or child.main or child.tag == "main":
                self.holds |= child.holds or child.tag in ("article", "main")
        self.hash = xxhash.xxh64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass"))
        self.hash -= (self.hash >> 63) << 64

    def is_aside(self, page_size: int) -> bool:
        """Whether its tag or name says that it is no article text.

        Comments and adverts go whatever their size, and so do forms that are not wrapped around
        a page. Other names say nothing of what holds all text of the page: it is beside nothing.
        """
        if self.tag in UNREAD or self.tag in AROUND:
            return True
        if self.tag in KEPT:
            return self.tag == "article" and bool(self.said & COMMENT)
        if self.said & (COMMENT | ADVERT):
            return True
        if self.tag == "form":
            return not self.wraps and self.size < page_size
        return bool(self.said & OTHER) and self.size < page_size

    def is_around(self, in_article: bool, page_size: int) -> bool:
        """Whether the element is known not to be article text.

        Outside an article, what holds one stays; articles inside comments are comments.
        """
        if in_article or self.tag in UNREAD or self.tag in AROUND:
            return self.is_aside(page_size)
        if self.tag == "header":
            return True
        if self.said & COMMENT and self.tag not in KEPT:
            return not self.main
        header = self.said & HEADER and self.tag not in KEPT
        return bool(header or self.is_aside(page_size)) and not self.holds


class Tree(HTMLParser):
    """A page as elements. Whatever is left open, closed twice or cut off is put up with."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Element("#page", [])
        self.open = [self.root]
        self.feed(html)
        self.close()
        while self.open:
            self.open.pop().close()

    def _end(self) -> None:
        self.open.pop().close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            at = self.open[k].tag
            if tag in ENDED_BY.get(at, ()):
                while len(self.open) > k:
                    self._end()
                break
            if at in BLOCKS and at not in ENDED_BY or at in ("table", "ul", "ol", "dl"):
                break
        element = Element(tag, attrs)
        self.open[-1].children.append(element)
        if tag in VOID:
            element.close()
        else:
            self.open.append(element)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCKS and self.open[-1].tag == tag:
            self._end()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                while len(self.open) > k:
                    self._end()
                return
            # An inline end does not reach beyond the block it stands in.
            if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def _articles(root: Element) -> list[Element]:
    """Where the main text is: the outermost articles, else main, else the whole page.

    An article that is named as something else ('related') counts only where there is no other.
    """
    for tag in ("article", "main"):
        found, stack = [], [root]
        while stack:
            e = stack.pop()
            if e is not root and e.is_aside(root.size):
                continue
            if e.tag == tag:
                found.append(e)
            else:
                stack += [c for c in reversed(e.children) if not isinstance(c, str)]
        if found:
            plain = [e for e in found if not e.said & (ADVERT | OTHER)]
            return plain or found
    return [root]


def candidates(root: Element) -> set[int]:
    """Hashes of the subtrees that may be template."""
    roots = _articles(root)
    declared = {id(r) for r in roots if r is not root}
    out: set[int] = set()
    stack = [(root, False)]
    while stack:
        e, inside = stack.pop()
        for c in e.children:
            if isinstance(c, str) or c.tag in UNREAD or c.tag in VOID:
                continue
            article = inside or id(c) in declared
            if article:
                if inside and c.marks and c.tag in CONTAINERS:
                    out.add(c.hash)
            elif c.tag not in ("html", "body"):
                out.add(c.hash)
            stack.append((c, article))
    return out


def main_text(root: Element, template: frozenset[int] = frozenset()) -> str:
    """Blocks of the article, one to a line, without what is around and without template."""
    blocks: list[str] = []
    parts: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            blocks.append(text)

    for article in _articles(root):
        declared = article is not root
        stack: list = [article]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                parts.append(item)
            else:
                exempt = declared and not (item.marks and item.tag in CONTAINERS)
                around = item is not article and item.is_around(declared, root.size)
                if around or (item is not article and not exempt and item.hash in template):
                    if item.tag in BLOCKS or item.tag in AROUND:
                        flush()
                    continue
                if item.tag in BLOCKS:
                    flush()
                    stack.append(None)
                elif item.tag in ("br", "td", "th"):
                    parts.append(" ")
                stack += reversed(item.children)
        flush()
    return "\n".join(blocks)


def template_hashes(
    pages: DataFrame, least_pages: int = TEMPLATE_PAGES, least_share: float = TEMPLATE_SHARE
) -> DataFrame:
    """(host, template): the hashes of each host's template, at most subtrees / share of them.

    ``pages`` has host and html.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, hashes = [], []
            for host, html in zip(batch["host"].to_pylist(), batch["html"], strict=True):
                found = candidates(Tree(html.as_py()).root)
                hosts += [host] * len(found)
                hashes += found
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(hashes, pa.int64())], ["host", "hash"]
            )

    counts = (
        pages.mapInArrow(read, "host string, hash long")
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= least_pages)
    )
    sizes = pages.groupBy(F.col("host").alias("of_host")).agg(F.count(F.lit(1)).alias("pages"))
    return (
        counts.join(sizes, F.col("host") == F.col("of_host"))
        .where(F.col("n") >= least_share * F.col("pages"))
        .groupBy(F.col("host").alias("template_host"))
        .agg(F.sort_array(F.collect_list("hash")).alias("template"))
    )


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    least_pages: int = TEMPLATE_PAGES,
    least_share: float = TEMPLATE_SHARE,
) -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of ``pages``.

    A null page counts as empty and has empty text, a null or odd address belongs to the empty
    host. Repeated rows are returned each; they count as pages of their own. Other columns are
    ignored, whatever their names.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"),
        F.lower(
            F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z]+://([^/?#]*)", 1), F.lit(""))
        ).alias("host"),
    )
    templates = template_hashes(rows.select("host", "html"), least_pages, least_share)
    # Written first, so that Spark knows its size and broadcasts it only if it is small.
    templates = stage(templates, "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            known: dict[str, frozenset[int]] = {}
            columns = (batch["host"].to_pylist(), batch["html"], batch["template"])
            for host, html, template in zip(*columns, strict=True):
                if host not in known:
                    known[host] = frozenset(template.as_py() or ())
                texts.append(main_text(Tree(html.as_py()).root, known[host]))
            sizes = np.array([len(t) for t in texts], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(sizes)],
                ["page_id", "url", "text", "n_chars"],
            )

    kind = rows.schema["page_id"].dataType.simpleString()
    return (
        rows.join(templates, F.col("host") == F.col("template_host"), "left")
        .select("page_id", "url", "host", "html", "template")
        .mapInArrow(read, f"page_id {kind}, url string, text string, n_chars long")
    )
