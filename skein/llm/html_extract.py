"""Main text of HTML pages.

Every element's subtree is hashed by its tags and text; Spark counts, per host, on how many different pages each recurs.
One that recurs on most of a host's pages is part of the site's template and is deleted, unless a page would keep next to
nothing; one that recurs on many, though not most, is deleted unless a page would lose half its text: groups of near
copies share as much. Elements that are never article text (navigation, footers, forms, scripts, adverts, reader
comments and the like) also go by their tag, role or by what their class or id is called. Within an article, prose
elements stay even if they recur.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import saved, short_batches, sized

#: A subtree on so many different pages of a host at least, and on the square root of all of them, is template if a page
#: keeps LEFT of its text without it; one on the share MOST of them if a page keeps LEAST of it.
PAGES, MOST, LEFT, LEAST = 3, 0.5, 0.5, 0.1
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr table tbody thead ul ol dl figure figcaption".split()) | _INLINE
_ROOT = frozenset(("html", "body", "article", "main"))
_DROP = frozenset("head script style noscript template nav footer aside form button select option input textarea iframe object embed svg canvas audio video dialog menu title noembed noframes xmp".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words that tell: a class or id that begins or ends with one of these names an element that is no article text.
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adsense sponsor sponsored sponsors promo promotion promoted nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar rail footer masthead "
    "cookie cookies consent gdpr banner notice notices notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments commentlist commentform discussion reply replies disqus respond widget widgets pagination pager toolbar skip".split()
)
#: Before one of these words, as in no-sidebar, the name tells of something else.
_NOT = frozenset("no not non has have with without is hide show".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: An opening tag of these ends an open paragraph; of the second, an open element of the same kind.
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_ENDS_SELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset(("ul", "ol", "dl", "table", "body", "html", "article", "main", "div", "section"))


class Element:
    __slots__ = ("attrs", "children", "hash", "name")

    def __init__(self, name: str, attrs: str = "") -> None:
        self.name, self.attrs, self.children, self.hash = name, attrs, [], 0


def parse(page: str) -> Element:
    """A tree of a page; children are elements or runs of text with references undecoded. Never fails: what is not
    closed ends with the page, and closing tags without a partner are passed over."""
    root = Element("#")
    stack, at, size = [root], 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            stack[-1].children.append(text)
        if not m:
            break
        at = m.end() if m.end() > m.start() else m.start() + 1
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name == name:
                    del stack[i:]
                    break
                if stack[i].name in _ROOT and name in _INLINE | {"p", "li"}:
                    break
            continue
        if name in ("article", "main"):  # an article lies in no menu or paragraph that was left open
            for i in range(1, len(stack)):
                if stack[i].name in _DROP or stack[i].name == "p":
                    del stack[i:]
                    break
        if name in _ENDS_P or name in _ENDS_SELF:
            ends = ("p",) if name in _ENDS_P else _ENDS_SELF[name]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends:
                    del stack[i:]
                    break
                if stack[i].name in _SCOPE and stack[i].name not in ends:
                    break
        element = Element(name, m[3])
        stack[-1].children.append(element)
        if name in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            element.children.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif name not in _VOID and not m[3].endswith("/"):
            stack.append(element)
    return root


def _walk(root: Element):
    """Elements with their parent, children before parents; no recursion, so any depth will do."""
    order, todo = [], [(root, None)]
    while todo:
        e, parent = todo.pop()
        order.append((e, parent))
        todo += [(c, e) for c in e.children if isinstance(c, Element)]
    return reversed(order)


def _hash(root: Element) -> None:
    """The hash of each subtree: tags and text, white space shortened. Attributes don't count, as links and ids differ
    from page to page."""
    for e, _ in _walk(root):
        parts = [e.name]
        for c in e.children:
            parts += ["\x02", str(c.hash)] if isinstance(c, Element) else ["\x03", t] if (t := " ".join(c.split())) else []
        e.hash = xxhash.xxh64_intdigest("\x04".join(parts).encode("utf-8", "surrogatepass"), 1) - (1 << 63)


def _telling(name: str) -> bool:
    words = [w.lower() for w in _PARTS.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    return bool(words) and (words[0] in _NAMES or (words[-1] in _NAMES and words[0] not in _NOT) or name.lower() in _NAMES)


def _boilerplate(e: Element) -> bool:
    if e.name in _DROP:
        return True
    if not e.attrs.strip(" /"):
        return False
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(e.attrs)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or attrs.get("role", "").lower() in _ROLES or attrs.get("itemprop", "").lower() == "comment":
        return True
    names = f"{attrs.get('class', '')} {attrs.get('id', '')}".split()
    return e.name not in ("html", "body", "main") and any(map(_telling, names))


#: Elements that may hold the main text, as bits.
_BASES = {"main": 1, "article": 2}


def _blocks(root: Element, template: frozenset[int] = frozenset()) -> list[tuple[str, int]]:
    """(text, in which of _BASES it lies) of the blocks of a page in order, without boilerplate and the subtrees whose
    hash is in `template`."""
    blocks: list[tuple[str, int]] = []
    run: list[str] = []

    def flush(base: int) -> None:
        text = " ".join(html.unescape("".join(run)).split())
        if text:
            blocks.append((text, base))
        run.clear()

    todo: list = [(root, 0)]
    while todo:
        e, base = todo.pop()
        if e is None:
            flush(base)
        elif isinstance(e, str):
            run.append(e)
        elif e.name == "br":
            run.append(" ")
        elif _boilerplate(e) or (e.name == "header" and not base) or (e.hash in template and e.name not in _ROOT and not (base and e.name in _PROSE)):
            if e.name not in _INLINE:
                flush(base)
        else:
            if e.name not in _INLINE:
                flush(base)
            base |= _BASES.get(e.name, 0)
            if e.name not in _INLINE:
                todo.append((None, base))
            todo += [(c, base) for c in reversed(e.children)]
    flush(0)
    return blocks


def subtrees(page: str | None) -> list[int]:
    """Hashes of the elements of a page that may be template: those with text that are not dropped by their tag."""
    root = parse(page or "")
    _hash(root)
    found, inside, text = set(), {}, {}
    for e, _ in _walk(root):
        text[id(e)] = any(text[id(c)] if isinstance(c, Element) else c.strip() for c in e.children) and e.name not in _DROP
    for e, parent in reversed(list(_walk(root))):
        dropped, prose = inside[id(parent)] if parent is not None else (False, False)
        dropped = dropped or e.name in _DROP
        inside[id(e)] = dropped, prose or e.name in ("article", "main")
        if parent is not None and text[id(e)] and not dropped and e.name not in _ROOT and e.name not in _INLINE and not (prose and e.name in _PROSE):
            found.add(e.hash)
    return sorted(found)


def extract(page: str | None, template: Iterable[int] = (), partly: Iterable[int] = ()) -> str:
    """The main text: the blocks of the page's main element or of its articles, if most of its text lies there, else of
    all of it, in page order. Subtrees of `template` are deleted if LEAST of the text is left, those of `partly` if LEFT
    of what is left then."""
    root, template, partly = parse(page or ""), frozenset(template), frozenset(partly)
    if template or partly:
        _hash(root)
    size = lambda blocks: sum(len(t) for t, _ in blocks)

    def blocks(gone: frozenset[int]) -> list[tuple[str, int]]:
        found = _blocks(root, gone)
        for bit in _BASES.values():
            mine = [b for b in found if b[1] & bit]
            if mine and 2 * size(mine) >= size(found):
                return mine
        return found

    found, gone = blocks(frozenset()), frozenset()
    for more, share in ((template, LEAST), (partly, LEFT)):
        if more:
            less = blocks(gone | more)
            if size(less) >= share * size(found):
                found, gone = less, gone | more
    return "\n\n".join(t for t, _ in found)


def main_text(df: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", pages: int = PAGES, most: float = MOST) -> DataFrame:
    """Per row of `df`: page_id, url, text (empty if none).

    Null html counts as empty; a null or hostless url is a host of its own. Rows that repeat stay; equal pages of a
    host count once. A host of fewer than `pages` different pages has no template. Columns with other names are ignored; an empty table gives no rows. A page is one value, parsed in a task;
    its length and the depth of its elements are not limited.
    """
    short_batches(df.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), host.alias("_h"), F.col(page).alias("_p"))

    @F.arrow_udf("array<long>")
    def hashes(column: pa.Array) -> pa.Array:
        return pa.array([subtrees(x) for x in column.to_pylist()], pa.list_(pa.int64()))

    @F.arrow_udf("string")
    def text(column: pa.Array, drop: pa.Array) -> pa.Array:
        found = []
        for p, d in zip(column.to_pylist(), drop.to_pylist(), strict=True):
            found.append(extract(p, [x["hash"] for x in d or () if x["all"]], [x["hash"] for x in d or () if not x["all"]]))
        return pa.array(found, pa.string())

    key = F.xxhash64("_p")
    # Both are written down: pages are parsed once for the hashes, and the join below has a plain exchange on either
    # side, so a hot host's template can be split.
    subs = saved(rows.select("_h", key.alias("_k"), hashes(F.col("_p")).alias("s")).select("_h", "_k", F.explode_outer("s").alias("hash")))
    # Pages of a host that hold a subtree, equal pages once; counted in two steps, so a subtree of a hot host is counted
    # where it is read first.
    counted = subs.where("hash IS NOT NULL").distinct().groupBy("_h", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= pages)
    total = subs.select("_h", "_k").distinct().groupBy("_h").agg(F.count("*").alias("total"))
    shared = counted.join(sized(saved(total)), "_h").where((F.col("n") >= F.sqrt("total")) | (F.col("n") >= most * F.col("total")))
    shared = saved(shared.select("_h", "hash", (F.col("n") >= most * F.col("total")).alias("all")))
    # A page's own template subtrees: never more than it has elements.
    drop = subs.join(shared, ["_h", "hash"]).groupBy("_h", "_k").agg(F.collect_set(F.struct("hash", "all")).alias("_d"))
    return rows.withColumn("_k", key).join(drop, ["_h", "_k"], "left").select("page_id", "url", text(F.col("_p"), F.col("_d")).alias("text"))
