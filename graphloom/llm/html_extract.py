"""Main text of web pages by composite text density.

A page is parsed into a tree of elements (end tags that HTML implies are supplied; scripts, styles and comments are
never text). Names are a prior: elements whose tag, role, class or id says menu, header, footer, sidebar, notice,
advert, form or reader comments have no text. Inside an article or main element names only count where they are whole:
one word, or words that all name furniture or a piece of a page, and no heading or paragraph goes by its id. Every node
then has its characters, tags, link characters and link tags, and from them a link-adjusted density of characters per tag; its density sum adds up those of its children. The node of
the greatest sum is the heart of the article. The least density on its path up to the body is the threshold: beside
that path, subtrees at least as dense are content too, each by its own node of greatest sum if that sum reaches the
threshold as well; so links and bare text in boxes go by density, whatever their names. An ``article`` element
round the heart is taken whole in the heart's place; so are the articles inside it that hold most of its text, with
whatever else of it is dense enough.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from graphloom.llm.shared import map_arrow

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_RAW = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
_SPACED = frozenset("br td th wbr img".split()) - {"wbr"}
#: An open element of the second set ends where one of the first begins.
_ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split(), ("p",)),
    "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "option": ("option",), "optgroup": ("option", "optgroup"),
    "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tbody": ("tr", "td", "th", "tbody", "thead", "p"), "tfoot": ("tr", "td", "th", "tbody", "thead", "p"),
}
#: An implied end tag is looked for no further up than these.
_SCOPE = frozenset("html body table ul ol dl td th article section div main aside nav header footer form button blockquote figure select".split())

_FURNITURE_TAGS = frozenset("nav footer aside form script style noscript iframe template svg object embed button select textarea dialog head title menu canvas audio video annotation annotation-xml".split())
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
#: Words of class and id that name furniture.
_FURNITURE_WORDS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices "
    "notification notifications alert popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidebars aside widget widgets related "
    "recommended recommendations share sharing social nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager comment comments commentlist "
    "disqus replies respond footer header masthead skip topbar toolbar disclaimer".split()
)
#: Words that say what piece of a page a name is for, beside the word that says which.
_PIECES = frozenset("area article articles bar block body box btn button buttons container content form group header inline inner item items label link links list main module outer panel post posts section site slot stories text title top unit wrap wrapper zone".split())
_NAME = re.compile(r"[a-z0-9]+")
#: Tags of running text.
_PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")


class _Tree:
    """Elements by number, parents before children; events in page order are (element, text) or (element, None) where
    a block begins or ends."""

    def __init__(self) -> None:
        self.tag: list[str] = ["#root"]
        self.attributes: list[str] = [""]
        self.parent: list[int] = [-1]
        self.events: list[tuple[int, str | None]] = []
        self.first: list[int] = [0]
        self.last: list[int] = [0]

    def open(self, tag: str, attributes: str, parent: int) -> int:
        if tag in _BLOCK:
            self.events.append((parent, None))
        self.tag.append(tag)
        self.attributes.append(attributes)
        self.parent.append(parent)
        self.first.append(len(self.events))
        self.last.append(len(self.events))
        return len(self.tag) - 1

    def close(self, node: int) -> None:
        self.last[node] = len(self.events)
        if self.tag[node] in _BLOCK:
            self.events.append((self.parent[node], None))


def _parse(page: str) -> _Tree:
    tree = _Tree()
    stack = [0]
    at = 0

    def text(piece: str) -> None:
        if piece:
            tree.events.append((stack[-1], html.unescape(piece) if "&" in piece else piece))

    while True:
        m = _TOKEN.search(page, at)
        if not m:
            # a lone < that begins no tag is text; a tag that never ends is not
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[6] or "").lower()
        if not tag:
            continue
        if m[1] or m[5]:
            if tag == "p" and tag not in (tree.tag[n] for n in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tree.tag[stack[i]] == tag:
                    while len(stack) > i:
                        tree.close(stack.pop())
                    break
            continue
        attributes = m[3] if m[2] else m[7]
        ends = _ENDS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            name = tree.tag[stack[i]]
            if name in ends:
                while len(stack) > i:
                    tree.close(stack.pop())
                if name == "p" and len(ends) > 1:
                    continue
                break
            if name in _SCOPE and not (name in ("td", "th") and name in ends):
                break
        if tag in _VOID:
            if tag == "hr":
                tree.events.append((stack[-1], None))
            elif tag in _SPACED:
                tree.events.append((stack[-1], " "))
            continue
        if tag in ("td", "th"):
            tree.events.append((stack[-1], " "))
        node = tree.open(tag, attributes, stack[-1])
        if tag in _RAW and not attributes.rstrip().endswith("/"):
            end = _RAW[tag].search(page, at)
            stop = end.start() if end else len(page)
            at = page.find(">", stop) + 1 if end else len(page)
            at = at or len(page)
            tree.close(node)
            continue
        stack.append(node)
    while len(stack) > 1:
        tree.close(stack.pop())
    tree.last[0] = len(tree.events)
    return tree


def _furniture(tree: _Tree, by_name: bool) -> list[bool]:
    """Whether each element, or one round it, is furniture."""
    n = len(tree.tag)
    holds = [tag in ("article", "main", "h1") for tag in tree.tag]  # itself or below it
    wraps = [tag == "article" for tag in tree.tag]
    for i in range(n - 1, 0, -1):
        holds[tree.parent[i]] |= holds[i]
        wraps[tree.parent[i]] |= wraps[i]
    gone = [False] * n
    inside = [False] * n  # an article
    within = [False] * n  # an article or main
    for i in range(1, n):
        tag, up = tree.tag[i], tree.parent[i]
        inside[i] = inside[up] or tag == "article"
        within[i] = within[up] or tag in ("article", "main")
        if gone[up]:
            gone[i] = True
            continue
        if tag in ("html", "body", "main"):
            continue
        if tag in _FURNITURE_TAGS:
            gone[i] = not (tag == "form" and holds[i])
        elif tag == "header":
            gone[i] = not inside[i] and not wraps[i]
        if gone[i] or not by_name or not (own := tree.attributes[i]):
            continue
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(own)}
        names = f"{found.get('class', '')} {found.get('id', '')}".split()
        if within[i] and tag != "article":
            # ids are made from headings there
            if tag in _PLAIN:
                names = found.get("class", "").split()
            words = [set(_NAME.findall(_CAMEL.sub(" ", name).lower())) for name in names]
            named = {w for name in words if {w for w in name if not w.isdigit()} <= _FURNITURE_WORDS | _PIECES for w in name & _FURNITURE_WORDS} - ({"header"} if inside[i] else set())
        else:
            named = set(_NAME.findall(_CAMEL.sub(" ", " ".join(names)).lower())) & _FURNITURE_WORDS
        hidden = re.search(r"(^|\s)hidden(\s|$)", own) or found.get("aria-hidden") == "true" and not holds[i] or "display:none" in found.get("style", "").replace(" ", "").lower()
        if tag == "article":
            gone[i] = bool(named & {"comment", "comments", "ad", "ads", "advert", "advertisement", "sponsored", "promo", "related", "recommended"})
        elif named or found.get("role", "").lower() in _FURNITURE_ROLES:
            gone[i] = not holds[i]
        gone[i] = gone[i] or bool(hidden)
    return gone


def _densities(tree: _Tree, gone: list[bool]) -> tuple[list[float], list[float], list[int]]:
    """Composite density and density sum of each element, and its characters."""
    n = len(tree.tag)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, piece in tree.events:
        if piece and not gone[node]:
            chars[node] += len(piece.strip())
    for i in range(n - 1, 0, -1):
        if gone[i]:
            continue
        up = tree.parent[i]
        if tree.tag[i] == "a":
            link_chars[i], link_tags[i] = chars[i], tags[i]
        chars[up] += chars[i]
        tags[up] += tags[i] + 1
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i] + (tree.tag[i] == "a")
    body = next((i for i in range(n) if tree.tag[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])
    density = [0.0] * n
    for i in range(n):
        if chars[i] and not gone[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            plain = max(1, c - link_chars[i])
            base = math.log(c / plain * link_chars[i] + share * c + math.e)
            density[i] = c / t * max(0.0, math.log(max(1.0, c / lc * (t / lt)) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-6 else math.log(max(1.0, c / lc * (t / lt))))
    total = [0.0] * n
    for i in range(n - 1, 0, -1):
        total[tree.parent[i]] += density[i]
    return density, total, chars


def _selected(tree: _Tree, gone: list[bool]) -> list[int]:
    """The elements whose text is the article's, in page order, none inside another."""
    n = len(tree.tag)
    density, total, chars = _densities(tree, gone)
    if not chars[0]:
        return []
    # the smallest of the elements with the greatest sum: those round it add nothing
    heart = max((i for i in range(n) if chars[i] and not gone[i]), key=lambda i: (total[i] if total[i] else density[i], i))
    above = [heart]
    while above[-1] > 0 and tree.tag[above[-1]] != "body":
        above.append(tree.parent[above[-1]])
    end = list(range(n))  # the last element below each: those below i are i + 1 to end[i]
    for i in range(n - 1, 0, -1):
        end[tree.parent[i]] = max(end[tree.parent[i]], end[i])
    core = next((i for i in above if tree.tag[i] == "article"), heart)
    if core == heart and tree.tag[heart] != "article":
        within = [i for i in range(heart, end[heart] + 1) if tree.tag[i] == "article" and not gone[i]]
        if within and 2 * chars[best := max(within, key=lambda i: chars[i])] >= chars[heart]:
            core = best
    path = [core]
    while path[-1] > 0 and tree.tag[path[-1]] != "body":
        path.append(tree.parent[path[-1]])
    threshold = min(density[i] for i in path)
    chosen = [core]
    path = set(path)
    last = 0  # the end of what is chosen before or of the core
    for i in range(1, n):
        if i == core:
            last = max(last, end[i])
        if i <= last or i in path or gone[i] or not density[i] >= threshold > 0:
            continue
        beside = tree.parent[i] in path
        if tree.tag[core] != "article":
            best = max((j for j in range(i, end[i] + 1) if chars[j]), key=lambda j: (total[j], -j))
            # bare text in a box has no sum: a slogan, a line of rights; only paragraphs and headings count by themselves
            if beside and (total[best] >= threshold or tree.tag[best] in _PLAIN):
                chosen.append(best)
                last = end[i]
        elif tree.tag[i] == "article" or beside and heart < i <= end[heart]:
            chosen.append(i)
            last = end[i]
    return sorted(chosen)


def main_text(page: str | None) -> str:
    """The article's text: blocks in page order joined by one line break, in each white space as one space."""
    if not page or not page.strip():
        return ""
    tree = _parse(page)
    gone = _furniture(tree, True)
    chosen = _selected(tree, gone)
    if not chosen:  # names may have misled
        gone = _furniture(tree, False)
        chosen = _selected(tree, gone)
    blocks: list[str] = []
    for node in chosen:
        held: list[str] = []
        for at, piece in tree.events[tree.first[node] : tree.last[node]]:
            if piece is None:
                blocks.append("".join(held))
                held = []
            elif not gone[at]:
                held.append(piece)
        blocks.append("".join(held))
    return "\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = pa.array([main_text(x.as_py()) for x in batch.column(1)], pa.string())
        yield pa.record_batch([batch.column(0), texts], names=["_doc", "text"])


def extract_main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` without ``column`` and with text (in place of a column of that name) and n_chars, its code points.

    A null or empty page has an empty text; so has one without any text. Repeated rows each have their row; an empty
    table gives none; other columns stay as they are. Pages are taken whole, however long.
    """
    keep = [c for c in pages.columns if c not in (column, "text", "n_chars")]
    # a name may hold dots, spaces or backticks
    own = [F.col(f"`{c.replace('`', '``')}`") for c in keep]
    rows = pages.select(F.struct(*own).alias("_doc") if keep else F.lit(None).cast("int").alias("_doc"), F.col(column).cast("string").alias("html"))
    out = map_arrow(rows, _extract, StructType([rows.schema["_doc"], StructField("text", StringType())]))
    return out.select(*(F.col("_doc").getField(c).alias(c) for c in keep), "text", F.char_length("text").cast("long").alias("n_chars"))
