"""Main text of web pages with site template removal.

Each page is parsed into blocks and element subtrees. Every block element has two hashes, one of its tags and text and one of its
structure: tags, names and the blocks and links in it, runs of like ones as one, without text and link targets. Both are counted per
host in Spark. A subtree whose text recurs on a good share of a host's different pages is template and is deleted there. One whose
structure recurs is template too, whatever it says, if it stands outside the pages' articles or is mostly links; running text is
protected by its length: a structure that carries most of the pages' text is content.

A paragraph amid running article text is content even so. Where counts can't decide, as a host has too few pages or an
element is too rare, elements whose tag or class says that they hold no main text go, and on hosts that weren't counted a page's article or
main element decides.
"""

from __future__ import annotations

import html
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import settle, small_batches

#: A tag, a comment, a declaration or an unclosed rest; attribute values may hold ">".
_MARKUP = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
#: HTML elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html legend li tbody td tfoot th thead tr dd dt".split())
#: Elements whose content isn't text of the page.
HIDDEN = RAW | frozenset("head button select option svg canvas object audio video map datalist".split())
#: Elements that hold no main text, where counts can't decide.
DROPPED = frozenset("nav footer aside form menu dialog search".split())
#: Words in a class, id or role that mark such an element.
DROPPED_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promos promotion menu menus nav navbar navigation navigationbar breadcrumb breadcrumbs sidebar sidebars "
    "footer footers masthead notice notices cookie cookies consent gdpr popup modal overlay comment comments commentlist disqus reply replies respond share sharing social related "
    "recommended newsletter subscribe signup login search pagination pager widget widgets contentinfo complementary alert toolbar".split()
)
ROOTS = ("article", "main")
#: Elements of running text: inside a root such a template goes only where no other text of the root is before or behind it.
PROSE = frozenset("blockquote dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre tbody td tfoot th thead tr".split())
#: Pages of one host, with different main texts, on which a subtree must stand to be template, and their share of all such pages.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.5
#: Shares from which a structure is content by its part of the pages' text, and template by the part of its text that is links.
MOST_TEXT, MOST_LINKS = 0.5, 0.5
#: Where an element stands: outside the roots of a page that has one, in a root, or on a page without any.
OUTSIDE, INSIDE, ROOTLESS = 0, 1, 2
#: Hashes of all hosts' templates together that are broadcast at most; beyond, pages and templates are joined by host.
BROADCAST_HASHES = 1 << 20
#: Stands among the hashes for the page itself: in a page's templates it says that its host was counted.
COUNTED = 0


_ODD = 0x9E3779B97F4A7C15
_ALL = 0xFFFFFFFFFFFFFFFF


class Node:
    __slots__ = ("tag", "hidden", "own_listed", "listed", "root", "link", "names", "parent", "hash", "shape", "last", "chars", "links")

    def __init__(self, tag: str, hidden: bool, listed: bool, names: str, parent: "Node | None"):
        self.tag, self.names, self.parent, self.own_listed = tag, names, parent, listed
        self.hidden = hidden or (parent is not None and parent.hidden)
        self.listed = listed or (parent is not None and parent.listed)
        self.root = tag in ROOTS or (parent is not None and parent.root)
        self.link = tag == "a" or (parent is not None and parent.link)
        self.hash = zlib.crc32(tag.encode())
        self.shape = zlib.crc32(f"{tag} {names}".encode()) * _ODD & _ALL
        self.last = self.chars = self.links = 0

    @property
    def telling(self) -> bool:
        """Whether its structure says something: a nameless div or list is like many others."""
        return bool(self.names) or self.tag in DROPPED or self.tag == "header"

    def place(self, rooted: bool) -> int:
        return INSIDE if self.root else OUTSIDE if rooted else ROOTLESS

    def key(self, rooted: bool) -> int:
        """The structure's hash together with its place."""
        return ((self.shape ^ (self.place(rooted) + 1)) * 0xD6E8FEB86659FD93 ^ 0x5851F42D4C957F2D) & _ALL


def _named(attributes: str, rooted: bool) -> bool:
    """Whether a class, id or role says that the element is no main text; "has-sidebar" and the like say nothing."""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).split():
            words = re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
            if words[0] not in ("has", "no", "with") and any(x in DROPPED_NAMES or (x == "header" and not rooted) for x in words):
                return True
    return False


def _names_of(attributes: str) -> str:
    """Class, id and role of an element; numbers in them are all alike."""
    return re.sub(r"[0-9]+", "#", " ".join(" ".join("".join(x).split()) for x in _NAMES.findall(attributes)).lower())


def parse(page: str) -> tuple[list[list[tuple[str, Node]]], list[Node]]:
    """Blocks (pieces of text with their element), in page order, and all elements with subtree hashes; ill-formed pages too.

    A subtree's hash covers tags and text in order (two CRCs, 64 bits), its shape the blocks and links in it. Unclosed elements end with their parent, a new
    block ends an open paragraph, end tags without a start are skipped, and an unclosed tag or comment ends the page.
    """
    top = Node("", False, False, "", None)
    stack, blocks, nodes, words = [top], [], [], []
    at, size = 0, len(page)

    def flush() -> None:
        if words:
            blocks.append(words[:])
            words.clear()

    def close(n: int) -> None:
        while len(stack) > n:
            node = stack.pop()
            if node.tag in BLOCK:
                flush()
            above = stack[-1]
            above.hash = ((above.hash * _ODD) ^ node.hash ^ (node.hash >> 29)) + 0x632BE59BD9B4E019 & _ALL
            above.chars, above.links = above.chars + node.chars, above.links + node.links
            if (node.tag in BLOCK or node.tag == "a") and not node.hidden and node.shape != above.last:
                above.last = node.shape
                above.shape = ((above.shape * _ODD) ^ node.shape ^ (node.shape >> 31)) & _ALL

    def text(raw: str) -> None:
        node = stack[-1]
        bits = raw.encode("utf-8", "replace")
        node.hash = ((node.hash * _ODD) ^ (zlib.crc32(bits) << 32 | zlib.adler32(bits))) & _ALL
        if not node.hidden:
            words.append((html.unescape(raw), node))
            size = len(raw.strip())
            node.chars += size
            node.links += size * node.link

    while at < size:
        m = _MARKUP.search(page, at)
        if m is None:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        ending, name, attributes, closed = (m[1], m[2], m[3], m[4]) if m[2] else (m[5], m[6], m[7], m[8])
        if not name:
            continue
        tag = name.lower()
        if not closed:  # the page ends inside a tag
            break
        if ending:
            if tag == "br":
                words.append((" ", stack[-1]))
                continue
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                close(k)
            continue
        if tag in CLOSES_P:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == "p"), 0)
            if k:
                close(k)
        elif tag in ("li", "dd", "dt", "tr", "td", "th", "option"):
            like = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            edge = {"li": ("ul", "ol", "menu"), "option": ("select",)}.get(tag, ("table", "dl"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in edge or (tag in ("td", "th") and stack[i].tag == "tr"):
                    break
                if stack[i].tag in like:
                    close(i)
                    break
        if tag in BLOCK:
            flush()
        if tag in VOID:
            if tag == "br":
                words.append((" ", stack[-1]))
            continue
        rooted = stack[-1].root
        open_ = tag not in ("html", "body", *ROOTS)
        listed = tag in DROPPED or (tag == "header" and not rooted) or (bool(attributes) and open_ and _named(attributes, rooted))
        node = Node(tag, tag in HIDDEN, listed, _names_of(attributes) if attributes and open_ else "", stack[-1])
        nodes.append(node)
        stack.append(node)
        if tag in RAW:  # its text is no markup
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
            at = end.start() if end else size
            close(len(stack) - 1)
    close(1)
    flush()
    return blocks, nodes


def _candidates(nodes: list[Node]) -> list[Node]:
    """Subtrees that may be template: block elements outside and inside an article or main element."""
    return [x for x in nodes if x.tag in BLOCK and not x.hidden and x.hash != COUNTED and x.tag not in ("html", "body", *ROOTS)]


def _has_root(nodes: list[Node]) -> bool:
    return any(x.tag in ROOTS and not x.hidden and not x.listed for x in nodes)


def _block_text(block: list[tuple[str, Node]]) -> str:
    return _SPACE.sub(" ", "".join(w for w, _ in block)).strip(" ")


def main_text(page: str, template: frozenset[int] = frozenset(), content: frozenset[int] = frozenset(), rules: bool = True) -> str:
    """Blocks without template elements, joined by an empty line; only those of the article if the host wasn't counted.

    ``template`` and ``content`` hold hashes of text and of structure. An element that neither has goes if the lists name it.
    """
    blocks, nodes = parse(page)
    has_root, fates = _has_root(nodes), {}
    rooted = rules and has_root and COUNTED not in template

    def own_fate(node: Node) -> str:
        if node.tag in BLOCK and node.tag not in ("html", "body", *ROOTS):
            key = node.key(has_root) if node.telling else None
            if key in template and not (node.root and node.tag in PROSE):
                return "goes"
            if node.hash in template:
                return "guarded" if node.root and node.tag in PROSE else "goes"
            if key in content:
                return "stays"
        return "goes" if node.own_listed and rules else "stays"

    for node in nodes:  # a parent stands before its children
        above = fates.get(id(node.parent), "stays")
        own = own_fate(node) if above != "goes" else "goes"
        fates[id(node)] = above if own == "stays" else own

    def fate(node: Node) -> str:
        return "goes" if rooted and not node.root else fates.get(id(node), "stays")

    kept: list[tuple[str, bool, bool]] = []  # text, in a root, whether anything in it is no template
    for block in blocks:
        judged = [(x, fate(x[1])) for x in block]
        text = _block_text([x for x, f in judged if f != "goes"])
        if text:
            kept.append((text, block[0][1].root, any(f == "stays" and x[0].strip() for x, f in judged)))
    running = [i for i, (_, root, own) in enumerate(kept) if root and own] or [0, len(kept)]
    return "\n\n".join(text for i, (text, root, own) in enumerate(kept) if own or running[0] <= i <= running[-1])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", template_pages: int = TEMPLATE_PAGES, template_share: float = TEMPLATE_SHARE, rules: bool = True) -> DataFrame:
    """key, url, text, n_chars (code points) of every page.

    A null, empty or text-free page has the empty text; a null url is a host of its own; ill-formed markup is read as far
    as it goes. Repeated rows and pages with equal main text count once towards a template, so copies of a page don't
    make its text template. Templates belong to the host, whatever a page's id is. A host with fewer different pages than
    template_pages isn't counted. ``rules=False`` leaves all to the counts: no lists of tags and words, and no article by itself. Long pages are read whole. Other columns are not
    read. An empty table gives an empty result.
    """
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    rows = small_batches(pages).select(F.xxhash64(host).alias("host"), F.col(page).alias("page"))
    names = ("host", "body", "hash", "place", "chars", "links", "all")
    schema = T.StructType([T.StructField(x, T.LongType()) for x in names])

    def subtrees(batches):
        """Each page's hashes of text (place -1) and of structure, the latter with the characters and link characters of all such elements and of the page."""
        for batch in batches:
            take, cells = [], []
            for i, value in enumerate(batch.column(1)):
                raw = value.as_py()
                if not raw:
                    continue
                blocks, nodes = parse(raw)
                found, rooted = _candidates(nodes), _has_root(nodes)
                text = "\n".join(_block_text([x for x in block if not x[1].listed and (x[1].root or not rooted)]) for block in blocks).encode("utf-8", "replace")
                whole = zlib.crc32(text) << 31 ^ zlib.adler32(text)
                every = sum(len(w.strip()) for block in blocks for w, _ in block)
                here = {x: (whole, _signed(x), -1, 0, 0, 0) for x in (COUNTED, *(x.hash for x in found))}
                for x in (x for x in found if x.telling):
                    k = x.key(rooted)
                    old = here.get(k, (0, 0, 0, 0, 0, 0))
                    here[k] = (whole, _signed(k), x.place(rooted), old[3] + x.chars, old[4] + x.links, every)
                take += [i] * len(here)
                cells += here.values()
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), *(pa.array([c[k] for c in cells], pa.int64()) for k in range(6))], names=names)

    seen = rows.mapInArrow(subtrees, schema)
    sizes = ("chars", "links", "all")
    once = seen.groupBy("host", "hash", "place", "body").agg(*(F.max(c).alias(c) for c in sizes))
    counts = settle(once.groupBy("host", "hash", "place").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in sizes)).where(F.col("n") >= template_pages))
    pages_of = counts.where(F.col("hash") == COUNTED).select("host", F.col("n").alias("pages"))
    often = counts.join(pages_of, "host").where(F.col("n") >= template_share * F.col("pages"))
    linked, most = F.col("links") >= MOST_LINKS * F.col("chars"), F.col("chars") >= MOST_TEXT * F.col("all")
    verdict = F.when((F.col("place") == -1) | linked | ((F.col("place") == OUTSIDE) & ~most), "template").when((F.col("place") == OUTSIDE) | most, "content")
    hashes = lambda kind: F.collect_set(F.when(F.col("verdict") == kind, F.col("hash"))).alias(kind)
    templates = settle(often.withColumn("verdict", verdict).groupBy("host").agg(hashes("template"), hashes("content")))  # as many as 1 / template_share pages have elements
    few = templates.agg(F.coalesce(F.sum(F.size("template") + F.size("content")), F.lit(0))).first()[0] <= BROADCAST_HASHES
    joined = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), F.col(page).alias("page"), F.xxhash64(host).alias("host"))
    joined = joined.join(F.broadcast(templates) if few else templates, "host", "left")

    def read(pages_: pa.Array, template: pa.Array, content: pa.Array) -> pa.Array:
        whole = lambda x: frozenset(v & _ALL for v in (x.as_py() or ()))
        return pa.array([main_text(p.as_py() or "", whole(t), whole(c), rules) for p, t, c in zip(pages_, template, content, strict=True)], pa.string())

    text = F.arrow_udf(read, "string")(F.col("page"), F.col("template"), F.col("content"))
    return joined.withColumn("text", text).select(F.col("id").alias(key), F.col("url").alias(url), "text", F.char_length("text").cast("long").alias("n_chars"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
