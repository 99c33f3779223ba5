"""Main text of web pages: templates of a site are found by counting equal subtrees over its pages, then the article is read.

1. Every page is parsed into a tree. Each block element is hashed with all it holds (tags and text; attributes are left out, because menus
   mark the page they are on).
2. Spark counts, per host, on how many different pages each subtree occurs. One on at least ``min_pages`` pages and on at least
   ``share`` of the host's pages is a template. Pages of equal html count once, so that copies of a page are no template.
3. The templates of a page are joined back to it and deleted from its tree, with what HTML itself marks as no content: menus, headers,
   footers, sidebars, forms, scripts, styles, hidden parts, and elements whose class, id or role names a notice, an advert,
   a side box or reader comments. What is left of the article is its main text.

The article is the outermost ``article`` elements, else ``main`` or an element named as the body of an article, else all of the body.
Inside a named article a template goes only if most of its text is links: a passage that several articles quote stays. In a page
without one, blocks that are mostly links go too. Nothing else is dropped, and no page or text is cut.

Character references are decoded, white space inside a block (a line break is white space) becomes one space, blocks are trimmed and joined by
one newline, empty ones left out. Elements nested deeper than ``DEEPEST`` are read as siblings.

Null and empty pages, and pages without text, have an empty text. A null url, or one without a host, counts as the host ''. Equal rows give equal results, one
row each. An empty table gives no rows. Columns of the input named as an added one are replaced. Texts of any length are read whole, a page at a time.
"""

from __future__ import annotations

import html as references
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

from pyspark.sql import DataFrame, functions as F

from cohortlab.llm.batches import extended
from cohortlab.llm.store import salted_join, written
from cohortlab.llm.urlfilter import host_of

MIN_PAGES = 3
SHARE = 0.1
DEEPEST = 512

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark picture q rb rp rt rtc ruby s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp noscript".split())
#: Elements that hold no text of an article.
NO_CONTENT = frozenset(
    "head title script style noscript noembed noframes template svg math iframe object embed canvas audio video map nav footer aside form button select textarea datalist dialog menu".split()
)
NO_CONTENT_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar".split())
#: Words of a class or an id that name something other than the article.
NO_CONTENT_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertising advertisement adsense adslot adbox banner sponsor sponsored promo promos promoted promotion "
        "nav navbar navigation menu submenu breadcrumb breadcrumbs pagination pager sidebar sidebars footer masthead "
        "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
        "share sharing social related recommended recommendations trending comment comments disqus respond replies widget widgets hidden"
    ).split()
)
#: A word after one of these tells what the element has or lacks, not what it is.
QUALIFIERS = frozenset("has with no without is not".split())
ARTICLE_NAMES = frozenset("article article-body article-content articlebody post-body post-content entry-content story-body main-content page-content content main".split())

LISTS = frozenset("ul ol dl li dd dt table tr td".split())

CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
#: An element that a new one of the same kind ends, and the elements beyond which that does not reach.
ENDED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}),
    "p": ({"p"}, {"table", "td", "th", "button", "caption", "object"}),
}
BOUNDS = frozenset({"table", "td", "th"})

#: A comment, or a tag with its quoted attributes (without a closing quote: up to the next >), or a declaration.
TAG = re.compile(r"""<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)((?>[^>"']*)(?>(?:"[^"]{0,65536}"|'[^']{0,65536}')[^>"']*)*|[^>]*)>|[!?/][^>]*>)""")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    """An element: its tag, attributes, and texts and elements inside it in order."""

    __slots__ = ("tag", "attributes", "inside", "key", "text", "links", "holds")

    def __init__(self, tag: str, attributes: str):
        self.tag = tag
        self.attributes = attributes
        self.inside: list[Node | str] = []
        self.key = 0
        self.text = self.links = 0
        self.holds = False


def parsed(page: str) -> list[Node]:
    """All elements of a page, each before those inside it. The first is the page itself."""
    root = Node("", "")
    nodes, open_, at, n = [root], [root], 0, len(page)
    last = page.rfind(">") + 1
    opened: Counter = Counter()

    def close(names, bounds=(), only=None):
        """End the innermost open element of ``names``, unless one of ``bounds``, or one outside ``only``, is inside it."""
        if not any(opened[x] for x in names):
            return
        for i in range(len(open_) - 1, 0, -1):
            tag = open_[i].tag
            if tag in names:
                opened.subtract(x.tag for x in open_[i:])
                del open_[i:]
                return
            if tag in bounds or (only is not None and tag not in only):
                return

    while at < n:
        found = TAG.search(page, at, last)
        stop = found.start() if found else n
        if stop > at:
            text = page[at:stop]
            if not found and (cut := re.search(r"<[a-zA-Z/!?][^>]*\Z", text)):
                text = text[: cut.start()]  # a tag that the end of the page cuts off
            if text := _spaced(references.unescape(text)):
                open_[-1].inside.append(text)
        if not found:
            break
        at = found.end()
        if found[1]:
            end = page.find("-->", found.start() + 2)
            at = n if end < 0 else end + 3
            continue
        if found[3] is None:
            continue
        name = found[3].lower()
        if found[2] or name == "a":  # a link ends the one before it
            close({name}, BOUNDS if name in ("p", "div", "section", "li") else (), INLINE if name in INLINE else None)
            if found[2]:
                continue
        if name in CLOSES_PARAGRAPH:
            close(*ENDED["p"])
        if name in ENDED and name != "p":
            close(*ENDED[name])
        node = Node(name, found[4])
        open_[-1].inside.append(node)
        nodes.append(node)
        if name in RAW:
            end = re.compile(f"</{re.escape(name)}", re.IGNORECASE).search(page, at)
            if not end:
                break
            over = page.find(">", end.end())
            at = n if over < 0 else over + 1
        elif name not in VOID and len(open_) < DEEPEST:
            open_.append(node)
            opened[name] += 1
    return nodes


def _spaced(text: str) -> str:
    """White space runs as one space, also in front and behind, where the text meets its neighbours."""
    inner = " ".join(text.split())
    if not inner:
        return " " if text else ""
    return (" " if text[0].isspace() else "") + inner + (" " if text[-1].isspace() else "")


def _attributes(node: Node) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(node.attributes)} if node.attributes.strip(" /") else {}


def _names(attributes: dict[str, str]) -> set[str]:
    return {x.lower() for c in ("class", "id") for x in attributes.get(c, "").split()}


def _words(attributes: dict[str, str]) -> Iterator[str]:
    for c in ("class", "id"):
        for name in attributes.get(c, "").split():
            words = [w.lower() for w in WORD.findall(name)]
            for before, word in zip(["", *words], words, strict=False):
                if before not in QUALIFIERS:
                    yield word


def no_content(node: Node, in_article: bool) -> bool:
    """Whether HTML names the element as something other than the text of an article."""
    tag = node.tag
    if tag in NO_CONTENT or (tag == "header" and not in_article):
        return not (node.holds and tag in ("form", "header"))
    if tag in ("", "html", "body") or not node.attributes.strip(" /"):
        return False
    attributes = _attributes(node)
    if "hidden" in attributes or attributes.get("role", "").lower() in NO_CONTENT_ROLES or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True
    if tag in ("article", "main"):
        return bool(_names(attributes) & NO_CONTENT_WORDS)
    if node.holds or not (attributes.get("class") or attributes.get("id")):
        return False
    return any(w in NO_CONTENT_WORDS for w in _words(attributes))


def measured_tree(nodes: list[Node], host: bytes) -> None:
    """Fill in the hash of every element with its host, and the length of its text and of that in links."""
    for node in reversed(nodes):
        digest = blake2b(f"{node.tag}\0".encode(), digest_size=8, key=host)
        skip = node.tag in RAW
        for x in node.inside:
            if isinstance(x, str):
                if not skip and (inner := x.strip()):
                    digest.update(b"t" + inner.encode("utf-8", "surrogatepass") + b"\0")
                    node.text += len(inner)
            else:
                digest.update(b"n" + x.key.to_bytes(8, "little", signed=True))
                node.text += x.text
                node.links += x.links
        if node.tag == "a":
            node.links = node.text
        node.key = int.from_bytes(digest.digest(), "little", signed=True)


def _host_key(host: str | None) -> bytes:
    return blake2b((host or "").encode("utf-8", "surrogatepass"), digest_size=32).digest()


def subtrees(page: str | None, host: str | None) -> list[int]:
    """Hashes, with the host, of all blocks of a page that hold text."""
    nodes = parsed(page or "")
    measured_tree(nodes, _host_key(host))
    return sorted({x.key for x in nodes if x.text and x.tag not in INLINE and x.tag not in ("", "html", "head", "title", "body")})


def _outermost(root: Node, rank: int) -> list[Node]:
    found: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if no_content(node, False):
            continue
        a = _attributes(node) if rank and node.attributes.strip(" /") else {}
        if rank == 0:
            hit = node.tag == "article"
        elif rank == 1:
            hit = node.tag == "main" or a.get("role", "").lower() == "main" or "articlebody" in a.get("itemprop", "").lower().split()
        else:
            hit = node.tag not in INLINE and bool(_names(a) & ARTICLE_NAMES)
        if hit:
            found.append(node)
        else:
            stack += [x for x in reversed(node.inside) if isinstance(x, Node)]
    return found


def _articles(nodes: list[Node]) -> list[Node]:
    """The outermost elements that hold the article, in page order; empty if the page names none.

    If all its articles lie in elements named as something else, those around one with most of the page's text count as part of the page.
    """
    for rank, tag in enumerate(("article", "main", None)):
        if found := _outermost(nodes[0], rank):
            return found
        longest = max((x for x in nodes if x.tag == tag and 2 * x.text > nodes[0].text and not _names(_attributes(x)) & NO_CONTENT_WORDS), key=lambda x: x.text, default=None)
        if longest:
            for node in reversed(nodes):
                node.holds = node.holds or any(x is longest or x.holds for x in node.inside if isinstance(x, Node))
            if found := _outermost(nodes[0], rank):
                return found
    return []


def main_text(page: str | None, host: str | None = None, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The text of the article of one page, without the subtrees whose hashes are in ``templates``."""
    nodes = parsed(page or "")
    measured_tree(nodes, _host_key(host))
    articles = _articles(nodes)
    named = bool(articles)
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if held:
            text = " ".join("".join(held).split())
            if text:
                blocks.append(text)
            held.clear()

    for top in articles or nodes[:1]:
        stack: list[Node | str | None] = [top]
        while stack:
            x = stack.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br" or x.tag == "wbr":
                held.append(" " if x.tag == "br" else "")
            else:
                if x is not top and no_content(x, named):
                    if x.tag not in INLINE:
                        flush()
                    continue
                block = x.tag not in INLINE
                if block:
                    flush()
                    linked = 2 * x.links > x.text
                    if x.key in templates and x is not top and (linked or not named):
                        continue
                    if not named and linked and x.tag in LISTS:
                        continue
                    stack.append(None)
                stack += reversed(x.inside)
        flush()
    return "\n".join(blocks)


def site_templates(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(__page, __templates): for each page, by the hash of its url and html, the hashes of its subtrees that are templates of its host. ``pages`` needs __host, __page, __copy, html."""

    def work():
        return lambda batch: {"keys": [subtrees(h, s) for h, s in zip(batch.column("html").to_pylist(), batch.column("__host").to_pylist(), strict=True)]}

    shapes = extended(pages.select("__page", "__host", "__copy", F.coalesce("html", F.lit("")).alias("html")), "html", "keys array<bigint>", work).drop("html")
    shapes, _ = written(shapes.withColumn("__site", F.xxhash64("__host")).drop("__host"), "subtrees")
    sizes = shapes.select("__site", "__copy").distinct().groupBy("__site").agg(F.count("*").alias("pages"))
    seen = shapes.select("__site", "__copy", F.explode("keys").alias("key")).distinct().groupBy("__site", "key").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    found, _ = written(salted_join(seen, sizes, ["__site"]).filter(F.col("n") >= share * F.col("pages")).select("key"), "templates")
    hits = salted_join(shapes.select("__page", F.explode("keys").alias("key")).distinct(), found, ["key"])
    return hits.groupBy("__page").agg(F.collect_list("key").alias("__templates"))


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """``pages`` (url, html) with text, the main text, and n_chars, its code points."""
    own = [c for c in pages.columns if c.lower() not in ("text", "n_chars")]
    rows = pages.select(*own).withColumn("__host", host_of(F.col("url"))).withColumn("__copy", F.xxhash64(F.coalesce("html", F.lit("")))).withColumn("__page", F.xxhash64("__host", F.lit("\n"), "__copy"))
    known, _ = written(site_templates(rows, min_pages, share), "marked")
    rows = salted_join(rows, known, ["__page"], 8 * F.size("__templates"), how="left")

    def work():
        def step(batch):
            texts = [
                main_text(h, s, frozenset(t or ()))
                for h, s, t in zip(batch.column("html").to_pylist(), batch.column("__host").to_pylist(), batch.column("__templates").to_pylist(), strict=True)
            ]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return step

    return extended(rows, "html", "text string, n_chars bigint", work).select(*own, "text", "n_chars")
