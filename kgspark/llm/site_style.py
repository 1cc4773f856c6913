"""Main text of web pages by site style trees.

The pages of a host are merged to one style tree: a node is a path of tags (with
class or id), its contents are what the host's distinct pages have there. A node's
importance is the entropy of its contents over the pages, divided by the greatest
possible one: 0 if all pages show the same, 1 if every page shows its own; the
entropy of the sequence of child tags (presentation) counts for inner nodes in
the same way, and the greater of a branch's importances is that of the branch.
Branches of low importance are removed from each page.

A tree says something only where a host has several pages that differ; so a node
is judged from ``MIN_PAGES`` distinct pages on, repeated pages count once, and two
things do not depend on it. Branches whose tag, role or class names a menu,
header, footer, sidebar, notice, advert, form, script, style or comment list are
removed on every page. Where a page marks its article, text outside of it
is not main text, and its plain paragraphs and headings are never removed for
being alike, since hosts repeat whole passages. Plain groups in it (div, section,
lists, tables) are nodes by their number among those of their parent, and are
removed if alike on at least ``NEARLY_ALL`` of the host's distinct pages.

Only the nodes that may be judged, and one row per page, are shuffled,
as two hashes and counts; contents are counted by partial aggregates, so a host
with a third of all pages is no hot task. The paths found unimportant go back to
the pages with their host, as a list of bounded length (paths are tags and classes
of a host, ``MAX_DEPTH`` levels deep).

Text: character references are decoded, white space within a block becomes one
space, blocks are trimmed and joined in page order by one line break.

Defined results: null or empty html gives the empty text; a null url is a host of
its own; unclosed tags end with the page or where HTML closes them; repeated
pages are returned each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame, functions as F

from kgspark.llm.common import map_rows
from kgspark.storage import Scratch

MIN_PAGES = 8
LOW = 0.1
NEARLY_ALL = 0.9  # of a host's pages
MAX_DEPTH = 64

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][\w:.-]*)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s\"'>]+))?", re.S)
SPACE = re.compile(r"\s+")

# HTML's elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul caption option".split()
)
NO_TEXT = frozenset(
    "head script style noscript template iframe object svg canvas nav footer aside form menu button select "
    "textarea input label title dialog audio video math search option xmp noembed noframes".split()
)
# An open p ends where these begin; list items and cells end at their next.
ENDS_P = BLOCK - frozenset("body html option caption tbody tfoot thead td th tr li dd dt summary".split())
ENDS_SAME = {
    "li": ("li", ("ul", "ol", "menu", "dir")), "dd": ("dd dt", ("dl",)), "dt": ("dd dt", ("dl",)),
    "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")),
    "option": ("option", ("select",)),
}
# Words of class, id and role that name what is not main text.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsor promo promoted promotion "
    "banner nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer bottombar "
    "sidebar aside complementary widget widgets related recommended recommendations share sharing social cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search "
    "comment comments respond reply replies disqus pagination pager toolbar skip contentinfo form".split()
)
MAIN_TAGS = frozenset(("article", "main"))
# Plain elements of an article that group blocks; the tree judges them by their place.
GROUPS = frozenset("div section ul ol dl table figure details blockquote center address menu".split())
# Of these, the ones that name lists whose entries may be articles of their own.
LISTS = frozenset(
    "comment comments respond reply replies disqus related recommended recommendations promo promoted sponsor sponsored "
    "ad ads advert adverts advertisement advertising widget widgets aside sidebar nav navigation menu footer".split()
)
# What follows these in a class name or id says what a block has or lacks, not what it is.
MODIFIER = re.compile(r"(?:(?<=[\s_-])|^)(?:has|with|without|no)[_-]\S*")


class Node:
    """An element; ``noise`` and ``main`` hold for all below, too. The root's ``main`` tells whether the page has one.

    ``wrapper``: noise by class words that may stand around an article; ``hard``: noise by anything
    else, here or above.
    """

    __slots__ = ("tag", "path", "named", "children", "noise", "main", "wrapper", "hard", "counts")

    def __init__(self, tag: str, path: str, named: bool, noise: bool, main: bool, wrapper: bool = False, hard: bool = False):
        self.tag, self.path, self.named, self.noise, self.main = tag, path, named, noise, main
        self.wrapper, self.hard = wrapper, hard
        self.counts: dict[str, int] = {}
        self.children: list[Node | str] = []


def _words(value: str) -> set[str]:
    spaced = re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower()
    return set(re.split(r"[^a-z]+", MODIFIER.sub(" ", spaced)))


def parse(html: str) -> Node:
    """The tree of a page; markup that is never text is left out.

    Class words of elements around an article do not hide it, if it has most of the page's text.
    """
    root, wrappers = _parse(html, frozenset())
    if not wrappers:
        return root
    other, _ = _parse(html, wrappers)
    size = lambda r: sum(map(len, blocks(r, r.main, frozenset())))
    return other if size(other) > 2 * size(root) else root


def _parse(html: str, lifted: frozenset[int]) -> tuple[Node, frozenset[int]]:
    """The tree, and the places of elements around a hidden article that hide it by class words alone.

    Elements at the places ``lifted`` hide nothing by their class words.
    """
    places: dict[int, int] = {}
    wrappers: set[int] = set()
    root, any_main = Node("", "", False, False, False), False
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK:
                    break  # an inline end tag does not close blocks
            continue
        if tag in ENDS_P:
            _close(stack, ("p",), ("table", "td", "th", "button", "object"))
        if tag in ENDS_SAME:
            same, within = ENDS_SAME[tag]
            _close(stack, same.split(), within)
        node = _open(tag, m[3] or "", stack[-1], m.start() in lifted)
        if node.wrapper:
            places[id(node)] = m.start()
        if node.noise and (tag in MAIN_TAGS or node.main and not stack[-1].main):
            if not node.hard:
                wrappers.update(places[id(x)] for x in stack if x.wrapper)
        stack[-1].children.append(node)
        any_main = any_main or node.main and not node.noise
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>]|\\Z)[^>]*(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] or "").endswith("/") or tag in BLOCK and tag not in VOID:
            stack.append(node)
    root.main = any_main
    return root, frozenset(wrappers)


def _open(tag: str, attributes: str, parent: Node, lifted: bool = False) -> Node:
    named, main, label = False, tag in MAIN_TAGS, ""
    # A header of an article holds its title; elsewhere it is the page's.
    hard, wrapper = tag in NO_TEXT or tag == "header" and not parent.main, False
    if attributes.strip("/ "):
        found = {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes)}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
        if names.strip():
            named, label = True, "." + found.get("class", found.get("id", ""))[:80]
            said = _words(names) & NOT_MAIN if tag not in ("html", "body") and not main else set()
            # A list's entries may be articles; they are not the page's.
            hard, wrapper = hard or bool(said & LISTS), bool(said - LISTS) and not lifted
        main = main or found.get("role") == "main"
        hard = hard or "hidden" in found or found.get("aria-hidden") == "true" or bool(
            re.search(r"display\s*:\s*none", found.get("style", ""))
        )
    if not named and tag in GROUPS and parent.main:
        k = parent.counts[tag] = parent.counts.get(tag, 0) + 1
        label = f"[{k}]"
    deep = parent.path.count("/") >= MAX_DEPTH
    path = parent.path if deep else f"{parent.path}/{tag}{label}"
    hard = hard or parent.hard
    return Node(tag, path, named, parent.noise or hard or wrapper, main or parent.main, wrapper, hard)


def _close(stack: list[Node], tags, within) -> None:
    """End the innermost of ``tags`` unless one of ``within`` stands between."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag in tags:
            del stack[k:]
            return
        if stack[k].tag in within:
            return


def judged_nodes(root: Node) -> Iterator[tuple[Node, str, str]]:
    """(node, own content, child tags): nodes the style tree may remove.

    Branches that are removed anyway, and plain blocks of the article that group nothing, are left out.
    """
    only_main = root.main
    waiting = [root]
    while waiting:
        node = waiting.pop()
        kids = [c for c in node.children if isinstance(c, Node) and not c.noise]
        waiting.extend(kids)
        if node is root or node.tag in ("html", "body") or node.tag in MAIN_TAGS or only_main and not node.main:
            continue
        if node.main and not node.named and node.tag not in GROUPS:
            continue
        if node.tag in BLOCK and node.path.count("/") < MAX_DEPTH:
            yield node, " ".join(blocks(node, False, frozenset())), " ".join(c.tag for c in kids)


def blocks(root: Node, only_main: bool, low: frozenset[int]) -> list[str]:
    """Texts of the blocks that stay, in page order."""
    out: list[str] = []
    now: list[str] = []

    def end() -> None:
        if now:
            text = SPACE.sub(" ", entities.unescape("".join(now))).strip()
            if text:
                out.append(text)
            now.clear()

    # An explicit stack: pages may nest deeper than Python calls.
    waiting: list[tuple[Node, Iterator]] = [(root, iter(root.children))]
    while waiting:
        node, rest = waiting[-1]
        child = next(rest, None)
        if child is None:
            waiting.pop()
            if node.tag in BLOCK:
                end()
        elif isinstance(child, str):
            if not only_main or node.main and node is not root:
                now.append(child)
        elif child.noise or low and path_key(child.path) in low:
            now.append(" ")
            if child.tag in BLOCK:
                end()
        elif child.tag == "br":
            now.append(" ")
        else:
            if child.tag in BLOCK:
                end()
            waiting.append((child, iter(child.children)))
    end()
    return out


def path_key(path: str) -> int:
    return xxhash.xxh3_64_intdigest(path.encode()) - (1 << 63)


ROOT = path_key("")


def main_text(html: str, low: frozenset[int] = frozenset()) -> str:
    """Main text of a page; ``low`` has the paths its host's tree found unimportant."""
    root = parse(html)
    return "\n".join(blocks(root, root.main, low))


def host(url: str = "url"):
    """Host of a url, in small letters; null if there is none."""
    return F.lower(F.regexp_extract(F.col(url), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def style_trees(pages: DataFrame) -> DataFrame:
    """(host, path, inside, pages, importance): a row per judged node of each host's tree.

    ``inside`` tells plain groups of an article. The root's path is empty; its pages are those of the host.
    """
    def nodes(rows):
        for name, html in rows:
            page = xxhash.xxh3_64_intdigest(html.encode()) - (1 << 63)
            yield name, ROOT, False, page, page, page
            for node, text, tags in judged_nodes(parse(html)):
                content, style = (xxhash.xxh3_64_intdigest(x.encode()) - (1 << 63) for x in (text, tags))
                yield name, path_key(node.path), node.main and not node.named, page, content, style

    seen = map_rows(
        pages.select("host", F.coalesce("html", F.lit("")).alias("html")), nodes,
        "host string, path bigint, inside boolean, page bigint, content bigint, style bigint",
    ).distinct()  # repeated pages, and repeated nodes of a page, count once
    both = seen.select("host", "path", "inside", "page", F.explode(F.array(
        F.struct(F.lit(0).alias("kind"), F.col("content").alias("value")),
        F.struct(F.lit(1).alias("kind"), F.col("style").alias("value")),
    )).alias("s")).select("host", "path", "inside", "s.*")
    counts = both.groupBy("host", "path", "inside", "kind", "value").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    # Entropy of shares n_i / n over the greatest one, log n.
    entropy = (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)
    return counts.groupBy("host", "path", "inside", "kind").agg(
        n.alias("pages"), F.when(n > 1, entropy).otherwise(F.lit(1.0)).alias("entropy")
    ).groupBy("host", "path", "inside").agg(F.max("pages").alias("pages"), F.max("entropy").alias("importance"))


def extract(pages: DataFrame, scratch: Scratch, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    named = pages.select("page_id", "url", "html", host().alias("host"))
    trees = scratch.save(style_trees(named.select("host", "html")), "trees")
    hosts = trees.where(F.col("path") == ROOT).select(F.col("host").alias("_host"), F.col("pages").alias("_all"))
    alike = trees.where((F.col("path") != ROOT) & (F.col("pages") >= min_pages) & (F.col("importance") < low))
    removed = alike.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(
        ~F.col("inside") | (F.col("pages") >= NEARLY_ALL * F.col("_all"))
    )
    paths = scratch.save(removed.groupBy("host").agg(F.collect_set("path").alias("low")), "low")
    # eqNullSafe: pages without a host share one tree.
    met = named.join(paths.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")), "left")

    def text_of(rows):
        for page_id, url, html, paths in rows:
            text = main_text(html or "", frozenset(paths or ()))
            yield page_id, url, text, len(text)

    kinds = {f.name: f.dataType.simpleString() for f in named.schema}
    return map_rows(
        met.select("page_id", "url", "html", "low"), text_of,
        f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint",
    )
