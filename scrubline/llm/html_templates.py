"""Main text of web pages, by removal of site templates.

Every container element of a page is hashed with all below it (names and text). Spark
counts on how many different pages of a host each subtree stands, merged within tasks
first, and a subtree that recurs on many of them is template: its blocks go. What a site
shows once, or differently on each page, is told by its markup: elements for menus,
page headers, footers, sidebars, forms, scripts and styles, and those whose class, id or
role names such a part, an advert, a notice or reader comments. Where a page marks its
article, only that is text; without one its main element, without that the rest.

How many pages are many does not grow with the host; only on small hosts a share of the
pages is less. What stands in an article is template only if it stands on more pages still
and at one place, counted from the begin or from the end of the article, so a sentence or
a table that articles share here and there stays; and where template would be more than
half of an article, it is the article itself, on other addresses of the site, and stays
whole. No page becomes empty by templates alone. Copies of a page count once; near copies
are different pages. Pages are parsed twice: for the hashes of their blocks, which alone
are counted, and for the texts, which meet by one join the numbers of the blocks that go.

A class or id names a part if one of its words does and the others only say where or how
it stands: ``site-footer`` is a footer, ``no-sidebar`` is not a sidebar.

Defined cases: null or empty html gives an empty text; a null or malformed address is
the host of the empty name. Unclosed and stray tags are closed as browsers do. Repeated
rows get the same text. Nothing is cut off, however long.
"""

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubline.llm.common import slices, stored, table


@dataclass(frozen=True)
class Settings:
    """A subtree is template if it stands on ``least`` different pages of its host and on ``share`` of them, or on
    ``enough`` of any host; what is in an article if it stands at one place of the articles of ``strong`` pages."""

    least: int = 4
    share: float = 0.1
    enough: int = 16
    strong: int = 32


# Names of elements and words of class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea title iframe object svg canvas "
                    "dialog menu xmp noembed noframes label fieldset datalist".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th "
                   "thead tr ul".split())
CONTAINERS = frozenset("aside details div dl fieldset figure footer form header menu nav ol section table ul dialog center".split())
#: What is tested by its place within an article, besides containers.
LEAVES = frozenset("p li address blockquote h1 h2 h3 h4 h5 h6".split())
#: Whole words of class and id, and values of role, that name a part which is not main text.
PARTS = frozenset("""nav navbar navigation menu submenu topbar breadcrumb breadcrumbs header masthead footer colophon sidebar side aside widget widgets
    cookie cookies consent gdpr notice notices alert banner popup modal overlay ad ads advert adverts advertisement advertising sponsor sponsored
    promo promotion comment comments commentlist disqus respond reply replies related recommended recommendations share sharing social
    newsletter subscribe subscription signup login search toolbar pagination pager skip complementary contentinfo dialog form""".split())
#: What may stand beside such a word in a class or id without changing what it says.
BESIDE = frozenset("""site page global main top bottom left right first last primary secondary sticky fixed mobile desktop small large list item items
    box bar block wrap wrapper wrapping container section area region zone inner outer slot unit link links icon button btn row col
    column panel card module js the my in on and by user reader customer""".split())
#: Those of them that an article is not told apart by: an article in such a part, or of such a class, is one all the same.
LAYOUT = frozenset("""nav navbar navigation menu submenu topbar header masthead footer sidebar side aside widget widgets banner popup modal overlay
    share sharing social subscribe subscription signup login search toolbar pagination pager skip form notice notices alert cookie cookies consent
    promo promotion newsletter complementary dialog""".split())
#: Elements that an opening tag ends if they are open, up to one of the second set.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
        "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^<>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^"'<>]|"[^"]*"|'[^']*')*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", re.I)


@dataclass
class Block:
    text: str
    dropped: bool
    article: bool
    main: bool
    marks: list[int] = field(default_factory=list)


@dataclass
class _Open:
    name: str
    dropped: int  # 1: for its layout, which an article within may override
    article: bool
    main: bool
    first: int
    leaves: list[tuple[int, int, int]]  # of the article around: hash, first block, end
    parts: list[str] = field(default_factory=list)


def _part(attributes: str) -> int:
    """0: names no part, 1: one of the layout, 2: another."""
    said: set[str] = set()
    for _, *values in _ATTRIBUTE.findall(attributes):
        for token in "".join(values).lower().split():
            own = set(_WORD.findall(token))
            if all(w in PARTS or w in BESIDE or w.isdigit() for w in own):
                said |= own & PARTS
    return 0 if not said else 1 if said <= LAYOUT else 2


def parse(page: str) -> tuple[list[Block], int]:
    """Blocks of text in page order with the hashes of the subtrees they stand in, and the hash of the page. The hashes
    are even; those of what stands in an article, with its place from the begin and from the end, are odd."""
    blocks: list[Block] = []
    stack = [_Open("", 0, False, False, 0, [])]
    run: list[str] = []

    def flush() -> None:
        if run:
            text = "".join(run)
            run.clear()
            if text := " ".join((entities.unescape(text) if "&" in text else text).split()):
                top = stack[-1]
                top.parts.append(text)
                blocks.append(Block(text, top.dropped > 0, top.article, top.main))

    def mark(own: int, first: int, last: int) -> None:
        for block in blocks[first:last]:
            if not block.dropped:
                block.marks.append(own)

    def close() -> None:
        top = stack.pop()
        own = xxhash.xxh64_intdigest("\x01".join([top.name, *top.parts, "\x02"])) - (1 << 63)
        stack[-1].parts.append(f"\x03{own}")
        if top.parts and not top.dropped:
            if not top.article and (top.name in CONTAINERS or top.name in ("p", "li", "address")):
                mark(own & ~1, top.first, len(blocks))
            elif top.article and (top.name in CONTAINERS or top.name in LEAVES):
                top.leaves.append((own, top.first, len(blocks)))
        if top.name == "article":
            for place, (leaf, first, last) in enumerate(top.leaves):
                for where in (place, place - len(top.leaves)):
                    mark((xxhash.xxh64_intdigest(f"{leaf} {where}") - (1 << 63)) | 1, first, last)

    def end(names: set[str], until: set[str] | frozenset = frozenset()) -> None:
        """Closes the nearest open element of ``names``, unless one of ``until`` is nearer."""
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].name in names:
                flush()
                while len(stack) > depth:
                    close()
                return
            if stack[depth].name in until:
                return

    at = 0
    while True:
        tag = _TAG.search(page, at)
        run.append(page[at:tag.start()] if tag else page[at:])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            continue
        name = tag[2].lower()
        if name in BLOCKS:
            flush()
        elif name == "br":
            run.append(" ")
        if tag[1]:
            if name not in VOID:
                end({name})
            continue
        if name in BLOCKS and name not in ("html", "body"):
            end({"p"}, {"table", "button", "td", "th"})
        if name in ENDS:
            end(*ENDS[name])
        if name in VOID:
            continue
        up, own = stack[-1], name in ("article", "main")
        part = 2 if name in DROPPED or name == "header" and not up.article else 0 if name in ("html", "body") else _part(tag[3])
        if own:  # an article is not dropped for the layout around it or named on it
            part = (part == 2) * 2
        if not (name in BLOCKS or part or up.dropped and up.name not in BLOCKS):
            continue  # text flows through other elements
        flush()
        before = 0 if own and up.dropped == 1 else up.dropped
        stack.append(_Open(name, max(before, part), up.article or name == "article" and not part, up.main or name == "main", len(blocks),
                           [] if name == "article" else up.leaves))
        if name in RAW:
            closing = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            stack.pop()
    flush()
    while len(stack) > 1:
        close()
    return blocks, xxhash.xxh64_intdigest("\x01".join(stack[0].parts)) - (1 << 63)


def main_blocks(blocks: list[Block]) -> list[Block]:
    """Of the blocks that are not dropped those of the article, if there are any; else of the main element; else all."""
    kept = [b for b in blocks if not b.dropped]
    return [b for b in kept if b.article] or [b for b in kept if b.main] or kept


def host(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower().removeprefix("www.") if found else ""


def _keyed(pages: DataFrame) -> DataFrame:
    """key, page_id, url, html; the key stands for the whole row."""
    return pages.select(F.struct(F.xxhash64("page_id", "url", "html").alias("a"), F.hash("html", "url", "page_id").alias("b")).alias("key"),
                        F.col("page_id").cast("long").alias("page_id"), "url", "html")


def marked(pages: DataFrame) -> DataFrame:
    """key, host, page (hash of its content), marks (of each block of the main text the hashes of its subtrees)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [parse(page or "") for page in batch["html"].to_pylist()]
            marks = [[b.marks for b in main_blocks(blocks)] for blocks, _ in found]
            yield pa.RecordBatch.from_arrays([batch["key"], pa.array([host(u) for u in batch["url"].to_pylist()], pa.string()),
                                              pa.array([f[1] for f in found], pa.int64()), pa.array(marks, pa.list_(pa.list_(pa.int64())))],
                                             ["key", "host", "page", "marks"])

    return _keyed(pages).mapInArrow(run, "key struct<a: long, b: int>, host string, page long, marks array<array<long>>")


def templates(marks: DataFrame, s: Settings) -> DataFrame:
    """host, subtree of what stands on many different pages of its host."""
    whole = marks.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    each = marks.select("host", "page", F.explode(F.array_distinct(F.flatten("marks"))).alias("subtree")).distinct()
    inside = F.col("subtree").bitwiseAND(1) == 1
    often = each.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= F.when(inside, s.strong).otherwise(s.least))
    bar = F.least(s.share * F.col("pages"), F.lit(float(s.enough)))
    return often.join(whole, "host").where(inside | (F.col("n") >= bar)).select("host", "subtree")


def extract(pages: DataFrame, s: Settings = Settings()) -> DataFrame:
    """page_id, url, text, n_chars of each page; blocks are joined by an empty line."""
    marks = stored(marked(pages))
    placed = marks.select("key", "host", F.posexplode("marks").alias("block", "own")).select("key", "host", "block", F.explode("own").alias("subtree"))
    gone = stored(placed.join(templates(marks, s), ["host", "subtree"]).groupBy("key").agg(F.collect_set("block").alias("gone")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kept = [main_blocks(parse(page or "")[0]) for page in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["key"], batch["page_id"], batch["url"], pa.array([bool(k) and k[0].article for k in kept]),
                                              pa.array([[b.text for b in k] for k in kept], pa.list_(pa.string()))],
                                             ["key", "page_id", "url", "article", "texts"])

    texts = _keyed(pages).mapInArrow(run, "key struct<a: long, b: int>, page_id long, url string, article boolean, texts array<string>")
    left = F.expr("transform(array_except(sequence(0, size(texts) - 1), gone), i -> texts[i])")
    chars = "aggregate({0}, 0L, (n, t) -> n + length(t))"
    most = F.expr(f"article AND 2 * {chars.format('rest')} < {chars.format('texts')}")
    whole = F.col("gone").isNull() | (F.size("rest") == 0) | most
    return (texts.join(gone, "key", "left").withColumn("rest", F.when(F.col("gone").isNotNull(), left))
            .select("page_id", "url", F.array_join(F.when(whole, F.col("texts")).otherwise(F.col("rest")), "\n\n").alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def op10_html_main_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
