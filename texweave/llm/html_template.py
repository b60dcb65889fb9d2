"""Main text of web pages by removal of site templates.

Every element subtree of a page is hashed (names, words, children), its hashes
are counted per host over distinct pages in Spark, and a subtree that recurs
across many pages of its host is template and goes. Pages of the same text count
once, so copies of an article make no template. Prose, and all that is inside a
marked article, is dearer than the rest: it must recur on most of the host's
pages (near copies of an article are fewer), and single cells and list items
never count inside an article.
What a page says about itself supports this: the article is read where one is
marked, elements and roles that are never the article (navigation, forms, ...)
go, and so do parts that whole class or id names label, or, where no article is
marked, words of such names.

Tags are read as the HTML standard has it, in linear time whatever the nesting:
a stray quote belongs to its tag, and a tag, comment or quoted value that the
page never ends takes the rest of the page with it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texweave.llm.common import cut

#: A subtree is template if it is on so many pages of its host with different articles ...
MIN_PAGES = 5
#: ... and on this share of the host's pages; with prose, or inside a marked article, on this one.
MIN_SHARE, PROSE_SHARE = 0.02, 0.5
#: Broadcast the templates only up to this many rows (about 100 bytes each).
BROADCAST_ROWS = 200_000
#: Copies of a host's templates, so that a hot host meets its pages in many tasks.
SALTS = 64

# Element names and roles, fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
DROPPED = frozenset("script style template noscript nav footer aside form button select textarea iframe object svg canvas dialog menu head title audio video map datalist input label fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
ARTICLE = frozenset(("article", "main"))
#: Parts of lists and tables: inside an article they are content of their own.
ITEMS = frozenset("li dt dd tr td th tbody thead tfoot caption option".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
#: Words of class and id that name a part as not the article.
LABELS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist respond disqus cookie cookies consent gdpr "
    "footer menu menus nav navbar navigation sidebar sidebars aside notice notices alert alerts popup modal overlay newsletter subscribe subscription signup "
    "share sharing social related recommended promo promotion sponsor sponsored widget widgets pagination pager toolbar toc login form search disclaimer legal copyright hidden skip".split()
)
#: An article element with one of these is a reader's.
REPLIES = frozenset(("comment", "comments"))
#: Labels of a page's head; an article may have a head of its own, with its title.
HEADS = frozenset(("header", "masthead"))
#: Beside one of these a label speaks of something else ("no-sidebar").
ABOUT = frozenset("has with no without".split())
#: An open element of the key is closed by a start tag of its set, as the HTML standard has it.
CLOSED_BY = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
}
CLOSES_P = BLOCKS - frozenset("body caption html legend li dd dt option optgroup tbody td tfoot th thead tr".split()) | frozenset(["li", "dd", "dt"])
SCOPES = frozenset("ul ol dl table td th div article section main body select button".split())

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: A name, and a value where one follows; a quoted value that does not end has no second quote.
ATTRIBUTE = re.compile(r"[\s/]*(?:([^\s/>=]=?[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*))?)?)?")
TELLING = frozenset("class id role hidden aria-hidden".split())
LABEL_WORD = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


@dataclass(slots=True)
class Node:
    name: str
    dropped: bool = False
    #: Whether words of its names label it as not the article, and as a head.
    labelled: bool = False
    head: bool = False
    parts: list = field(default_factory=list)  # text and nodes, in order
    digest: int = 0
    #: Whether it is or holds a paragraph or heading.
    prose: bool = False


@dataclass(slots=True)
class Open:
    """An open element: the innermost open paragraph in its scope, and the next one out that end tags may be left out for."""

    node: Node
    paragraph: int
    chain: int


def _tag(source: str, at: int) -> tuple[int, dict[str, str]]:
    """The end of a tag whose name ends at ``at`` and its telling attributes; -1 if the page ends before the tag."""
    found: dict[str, str] = {}
    while True:
        if source[at : at + 1] == ">":
            return at + 1, found
        m = ATTRIBUTE.match(source, at)
        if m.end() == at:
            if at >= len(source):
                return -1, found
            at += 1  # a character of no attribute, as "=" before a name
            continue
        if (m[2] is not None and not m[3]) or (m[4] is not None and not m[5]):
            return -1, found
        if m[1] is not None:
            key = m[1].lower()
            if key in TELLING:
                found.setdefault(key, (m[2] or m[4] or m[6] or "").lower())
        at = m.end()


def _judge(node: Node, attributes: dict[str, str]) -> None:
    """Sets whether the element is not the article, or a head, by its name and attributes."""
    name = node.name
    node.dropped, node.head = name in DROPPED, name == "header"
    if not attributes:
        return
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in ROLES:
        node.dropped = True
    if name in ("body", "html", "main"):
        return
    known = LABELS if name != "article" else REPLIES
    for key in ("class", "id"):
        value = attributes.get(key, "")
        node.dropped |= not known.isdisjoint(value.split())
        words = LABEL_WORD.findall(value)
        if ABOUT.isdisjoint(words):
            node.head |= not HEADS.isdisjoint(words)
            node.labelled |= not known.isdisjoint(words)


def parse(source: str) -> Node:
    """The tree of a page; unclosed and misnested tags are repaired as browsers mostly do."""
    root = Node("html")
    stack = [Open(root, -1, -1)]
    names = Counter(["html"])  # of open elements
    at = 0

    def close(depth: int) -> None:
        names.subtract(x.node.name for x in stack[depth:])
        del stack[depth:]

    while True:
        start = source.find("<", at)
        if start < 0:
            stack[-1].node.parts.append(source[at:])
            break
        sign = source[start + 1 : start + 2]
        closing = sign == "/"
        m = TAG_NAME.match(source, start + 1 + closing)
        if m is None and sign not in ("!", "?") and not closing:  # a bare "<" is text
            stack[-1].node.parts.append(source[at : start + 1])
            at = start + 1
            continue
        if start > at:
            stack[-1].node.parts.append(source[at:start])
        if m is None:
            comment = source.startswith("<!--", start)
            end = source.find("-->" if comment else ">", start + 2)
            if end < 0:
                break
            at = end + (3 if comment else 1)
            continue
        name = m[0].lower()
        at, attributes = _tag(source, m.end())
        if at < 0:
            break
        if closing:
            if names[name] and name != "html":
                depth = len(stack) - 1
                while stack[depth].node.name != name:
                    depth -= 1
                if depth:
                    close(depth)
            elif name == "br":
                stack[-1].node.parts.append(" ")
            continue
        if name == "br":
            stack[-1].node.parts.append(" ")
            continue
        if name in ("html", "body") and names[name]:
            continue
        if name in CLOSES_P and stack[-1].paragraph > 0:
            close(stack[-1].paragraph)
        depth = len(stack) - 1 if stack[-1].node.name in CLOSED_BY or stack[-1].node.name in SCOPES else stack[-1].chain
        while depth > 0:
            open_name = stack[depth].node.name
            if name in CLOSED_BY.get(open_name, ()):
                close(depth)
                break
            if open_name not in CLOSED_BY:
                break
            depth = stack[depth].chain
        node = Node(name)
        _judge(node, attributes)
        if name in VOID:
            if name == "hr":
                stack[-1].node.parts.append(node)
            continue
        stack[-1].node.parts.append(node)
        if source[at - 2] == "/" and name in ("svg", "path", "use"):
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
            stop = source.find(">", end.end()) if end else -1
            node.parts.append(source[at : end.start() if end else len(source)])
            if stop < 0:
                break
            at = stop + 1
            continue
        top, here = stack[-1], len(stack) - 1
        paragraph = len(stack) if name == "p" else -1 if name in SCOPES else top.paragraph
        stack.append(Open(node, paragraph, here if top.node.name in CLOSED_BY or top.node.name in SCOPES else top.chain))
        names[name] += 1
    return root


def _digest(root: Node) -> None:
    """Sets every node's digest, a hash of its name, its words and its children's digests, and whether it has prose."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.parts if isinstance(x, Node))
    for node in reversed(order):
        h = xxhash.xxh3_64(node.name)
        node.prose = node.name in PROSE
        for part in node.parts:
            if isinstance(part, Node):
                node.prose |= part.prose
                h.update(part.digest.to_bytes(8, "little"))
            else:
                h.update(" ".join(part.split()))
        node.digest = h.intdigest() & (2**63 - 1)


def _find(root: Node, names: frozenset[str], inside_dropped: bool = False) -> list[Node]:
    """The outermost elements of the names, in page order."""
    found, todo = [], [x for x in reversed(root.parts) if isinstance(x, Node)]
    while todo:
        node = todo.pop()
        if node.name in names and not node.dropped:
            found.append(node)
        elif inside_dropped or not node.dropped:
            todo.extend(x for x in reversed(node.parts) if isinstance(x, Node))
    return found


def _main(root: Node) -> list[Node]:
    """The page's articles, or else its main element, or else the whole page."""
    return _find(root, frozenset(["article"])) or _find(root, frozenset(["main"])) or _find(root, ARTICLE, True) or [root]


def subtrees(source: str) -> tuple[int, dict[int, bool]]:
    """A hash of the text, and the digests of all element subtrees with whether each is dear.

    Dear are subtrees inside a marked article, and those with prose anywhere.
    """
    root = parse(source)
    _digest(root)
    articles = _main(root)
    marked = articles[0] is not root
    inside = {id(x) for x in articles} if marked else set()
    found: dict[int, bool] = {}
    todo: list[tuple[Node, bool]] = [(x, False) for x in root.parts if isinstance(x, Node)]
    while todo:
        node, dear = todo.pop()
        if not (dear and node.name in ITEMS) and node.name not in ("body", "head"):
            is_dear = dear or node.prose
            found[node.digest] = found.get(node.digest, False) or is_dear
        below = dear or id(node) in inside
        todo.extend((x, below) for x in node.parts if isinstance(x, Node))
    return xxhash.xxh3_64_intdigest(main_text(source, tree=root)) >> 1, found


def main_text(source: str | None, templates: frozenset[int] = frozenset(), tree: Node | None = None) -> str:
    """The page's article: blocks in page order joined by one newline, white space in them by one space."""
    if not source:
        return ""
    root = tree or parse(source)
    if templates and tree is None:
        _digest(root)
    articles = _main(root)
    whole = articles[0] is root
    blocks: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        if text:
            blocks.append(text)
        line.clear()

    for article in articles:
        todo: list[Node | str | None] = [article]
        while todo:
            part = todo.pop()
            if part is None:
                end()
            elif isinstance(part, str):
                line.append(html.unescape(part))
            elif part.dropped or (whole and (part.head or part.labelled)) or (part is not article and part.digest in templates and (whole or part.name not in ITEMS)):
                if part.name in BLOCKS:
                    end()
            else:
                block = part.name in BLOCKS
                if block:
                    end()
                    todo.append(None)
                todo.extend(reversed(part.parts))
        end()
    return "\n".join(blocks)


def host(url: Column) -> Column:
    """The url's host in lower case; empty without one."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[\s\S]*?://([^/?#]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, prose_share: float = PROSE_SHARE) -> DataFrame:
    """``host, digest`` of the subtrees that recur on many pages of a host.

    Pages of the same text count once, so that copies of a page make no
    template. A host's templates are at most (subtrees per page) /
    ``min_share``. Counts are combined before each shuffle, so a hot host costs
    its distinct subtrees.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, articles, digests, dear = [], [], [], []
            for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                article, found = subtrees(source or "")
                hosts += [name] * (len(found) + 1)
                articles += [article] * (len(found) + 1)
                digests += [*found, -1]  # -1 counts the host's pages
                dear += [*found.values(), False]
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(articles, pa.int64()), pa.array(digests, pa.int64()), pa.array(dear, pa.bool_())], names=["host", "article", "digest", "dear"])

    seen = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string")).mapInArrow(scan, "host string, article long, digest long, dear boolean")
    once = seen.groupBy("host", "digest", "article").agg(F.max("dear").alias("dear"))
    counted = cut(once.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("dear").alias("dear")).filter((F.col("n") >= min_pages) | (F.col("digest") == -1)))
    totals = counted.filter("digest = -1").select("host", F.col("n").alias("pages"))
    share = F.when(F.col("dear"), prose_share).otherwise(min_share)
    return counted.filter("digest <> -1").filter(F.col("n") >= min_pages).join(totals, "host").filter(F.col("n") >= share * F.col("pages")).select("host", "digest")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages``.

    Null html gives an empty text; a null url or one without a host counts for
    the empty host. Repeated rows are extracted each; other columns are ignored;
    an empty table gives an empty result. Long and broken pages take time in
    proportion to their length (see above for what an unfinished tag does). The
    pages are parsed twice and never shuffled while the templates are few enough
    to broadcast; beyond that hosts are joined, hot ones in SALTS parts.
    """
    found = cut(templates(pages))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host(F.col("url")).alias("host"))
    n = found.count()
    per_host = found.groupBy("host").agg(F.collect_set("digest").alias("templates"))
    if n <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(per_host), "host", "left")
    else:
        copies = per_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(copies, ["host", "salt"], "left")

    @F.pandas_udf("string")
    def text(source: pd.Series, hosts: pd.Series, digests: pd.Series) -> pd.Series:
        sets: dict[str, frozenset[int]] = {}  # of the batch's hosts, each made once
        told = []
        for s, name, d in zip(source, hosts, digests):
            if d is not None and name not in sets:
                sets[name] = frozenset(map(int, d))
            told.append(main_text(s, sets[name] if d is not None else frozenset()))
        return pd.Series(told, dtype=object)

    told = joined.select("page_id", "url", text("html", "host", "templates").alias("text"))
    return told.withColumn("n_chars", F.char_length("text").cast("long"))
