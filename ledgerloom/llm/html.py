"""HTML main text by tree scoring.

A tolerant tokenizer builds a tree of elements. Boilerplate elements go first: by tag (nav, footer, form, script ...) or by a word
of class, id or role (menu, sidebar, advert, cookie notice, comments ...). Inside an article a word that may as well name a section
of it (discussion, related ...) is not enough: see doubtful. Each block of text that is left is a paragraph: it
gives a point, one for each comma and up to three for its length to its container, half of that to the next and a third of
half to those above, up to LEVELS containers. A container's score is discounted by its link density. The best is kept, with siblings whose
score is near its own or that are plain paragraphs, lists or tables. A container inside an article or main stands for all of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import by_bytes, mapped

# Element names by their part in the HTML standard, and words that name boilerplate.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas")
OPEN = set("noscript template svg math object canvas".split())  # of these RAW ones, without an end tag, the page goes on after the start tag
GONE = set(RAW) | set("head nav footer aside form button select input label fieldset menu dialog audio video datalist".split())
BLOCK = set("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul aside".split())
CLOSES_P = BLOCK - set("dd dt li tbody td tfoot th thead tr html body".split()) | {"p"}
CONTAINER = set("article main section div body html td blockquote".split())
PLAIN = set("p pre blockquote h1 h2 h3 h4 h5 h6 ul ol dl table figure".split())
BAD_WORDS = set(
    "ad ads advert adverts advertisement advertising adslot banner sponsor sponsored promo promotion popup modal overlay cookie cookies consent gdpr notice notices alert menu menus nav navbar navigation breadcrumb breadcrumbs"
    " sidebar footer masthead topbar toolbar header comment comments disqus respond reply replies discussion share sharing social related recommended recommendations newsletter subscribe subscription signup login pagination pager skip widget copyright"
    " disclaimer outbrain taboola hidden commentlist commentform adsense adbox sidenav topnav subnav aside feedback reactions".split()
)
# First words of a class that only tells of a layout, and of one that names an article's own headline.
LAYOUT_WORDS = set("has no with without is not".split())
OWN_HEADER = set("article entry post story".split())
# Of BAD_WORDS those that also name sections of an article, and elements of forms.
SECTION_WORDS = set("alert notice notices discussion respond reply replies share sharing social related recommended recommendations feedback reactions disclaimer copyright header promotion cookie cookies consent".split())
CONTROLS = set("form button select input textarea".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
BAD_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar alertdialog".split())

LEVELS = 16

TAG = re.compile(r"""<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|$)|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|$)""", re.S)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "attrs", "parent", "kids", "score", "text_len", "link_len", "inside", "holds")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent, self.kids, self.score, self.text_len, self.link_len = tag, attrs, parent, [], 0.0, 0, 0
        self.inside, self.holds = tag in ("article", "main") or parent is not None and parent.inside, None


def tree(html: str) -> Node:
    """Elements and texts in page order, character references decoded in each text (not in CDATA). Open elements end with the page; an end tag without its start is ignored."""
    root = at = Node("html", "", None)
    place, n, endless = 0, len(html), set()
    while place < n:
        m = TAG.search(html, place)
        if m is None:
            at.kids.append(unescape(html[place:]))
            break
        if m.start() > place:
            at.kids.append(unescape(html[place : m.start()]))
        place = m.end()
        if m["cdata"] is not None:
            at.kids.append(m["cdata"])
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            continue
        if m["end"] or m["end2"]:
            up = at
            while up is not None and up.tag != name:
                # A formatting element's end does not close the block around it.
                up = None if up.tag in BLOCK and name not in BLOCK else up.parent
            if up is not None and up.parent is not None:
                at = up.parent
            elif name == "p":
                at.kids.append(Node("p", "", at))
            continue
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        if name in CLOSES_P or name in ("li", "dd", "dt", "tr", "td", "th"):
            at = close(at, name)
        node = Node(name, attrs or "", at)
        at.kids.append(node)
        if name in RAW:
            if name in ("svg", "math") and (attrs or "").rstrip().endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, place) if name not in endless else None
            endless |= {name} if end is None else set()  # no later one has an end either
            place = end.end() if end else place if name in OPEN else n
        elif name not in VOID and not (attrs or "").rstrip().endswith("/") or name in BLOCK:
            at = node if name != "hr" else at
    return root


def close(at: Node, name: str) -> Node:
    """Where a new element goes after those that it closes by itself: an open p, or an open item or cell of the same list or table."""
    same = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
    stop = {"li": ("ul", "ol", "menu"), "dd": ("dl",), "dt": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}.get(name, ())
    up, out = at, at
    while up is not None and up.parent is not None and up.tag not in stop:
        if up.tag in same or name in CLOSES_P and up.tag == "p":
            out = up.parent
        elif up.tag in BLOCK and not same:
            break
        up = up.parent
    return out


def named_after(value: str) -> Iterator[tuple[set[str], bool]]:
    """The words of boilerplate in each name of a class or id, and whether the name has no others: has-sidebar only tells of a layout, entry-header is the article's own."""
    for name in value.split():
        words = [w.lower() for w in WORD.findall(name)]
        if not words or len(words) > 1 and words[0] in LAYOUT_WORDS:
            continue
        bad = BAD_WORDS.intersection(words)
        if bad and not (bad == {"header"} and words[0] in OWN_HEADER):
            yield bad, bad.issuperset(words)


def doubtful(node: Node) -> bool:
    """Whether what an element holds does not look like boilerplate: mostly text outside links, and no form's elements."""
    if node.holds is None:  # worked out once for all that it holds
        for x in in_order(node)[::-1]:
            size = linked = 0
            control = x.tag in CONTROLS
            for k in x.kids:
                n, m, c = k.holds if isinstance(k, Node) else (len(k.strip()), 0, False)
                size, linked, control = size + n, linked + m, control or c
            x.holds = size, size if x.tag == "a" else linked, control
    size, linked, control = node.holds
    return not control and 2 * linked < size


def boilerplate(node: Node) -> bool:
    if node.tag in GONE:
        return True
    if node.tag == "header":  # a page's header goes; an article's own holds its headline
        return not node.inside
    if not node.attrs or node.tag in ("html", "body", "article", "main"):
        return False
    for key, a, b, c in ATTR.findall(node.attrs):
        key, named = key.lower(), a or b or c
        value = named.lower()
        if key == "class" or key == "id" and node.tag not in HEADINGS:
            for bad, whole in named_after(named):
                # Inside an article, words that sections have too count as a class of their own, by twos or by what the element holds.
                if node.inside and bad <= SECTION_WORDS and not (whole and (key == "class" or len(bad) > 1)) and doubtful(node):
                    continue
                if node.tag not in ("h1", "h2", "h3") or "title" not in value:
                    return True
        if key == "role" and value in BAD_ROLES or key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return False


def blocks(node: Node, link: bool = False) -> Iterator[tuple[Node, str, int]]:
    """(block element, text, characters in links) of each run of text that no block boundary divides, in page order."""
    run: list[str] = []
    linked = 0

    def flush(owner: Node):
        nonlocal run, linked
        text = " ".join("".join(run).split())
        size, run, linked = linked, [], 0
        if text:
            yield owner, text, min(size, len(text))

    # An explicit stack: pages may be nested deeper than Python's own.
    stack = [(node, iter(node.kids), node, link)]
    while stack:
        at, kids, owner, in_link = stack[-1]
        kid = next(kids, None)
        if kid is None:
            stack.pop()
            if at.tag in BLOCK:
                yield from flush(owner)
        elif isinstance(kid, str):
            run.append(kid)
            linked += len(kid.strip()) if in_link else 0
        elif boilerplate(kid):
            if kid.tag in BLOCK:
                yield from flush(owner)
        elif kid.tag == "br":
            run.append("\n")
        elif kid.tag in BLOCK:
            yield from flush(owner)
            stack.append((kid, iter(kid.kids), kid, in_link))
        else:
            stack.append((kid, iter(kid.kids), owner, in_link or kid.tag == "a"))


def in_order(root: Node) -> list[Node]:
    """All elements, each after the one that holds it."""
    out, at = [root], 0
    while at < len(out):
        out += [k for k in out[at].kids if isinstance(k, Node)]
        at += 1
    return out


def points(text: str) -> float:
    return 1 + sum(text.count(c) for c in ",，、،") + min(3.0, len(text) / 100)


def main_text(html: str) -> str:
    """The article's text: its blocks in page order, white space folded, joined by spaces; empty if the page has none."""
    root = tree(html)
    found = list(blocks(root))
    scored: dict[int, Node] = {}
    for owner, text, linked in found:
        owner.text_len += len(text)
        owner.link_len += linked
        up = owner
        share, level, p = 1.0, 0, points(text)
        heading = owner.tag in HEADINGS
        while up is not None and level < LEVELS:
            if up.tag in CONTAINER:
                scored[id(up)] = up
                if not heading:
                    up.score += p * share
                level += 1
                share = 0.5 if level == 1 else 0.5 / (3 * (level - 1))
            up = up.parent
    for node in in_order(root)[::-1]:  # what a part has counts for what holds it
        if node.parent is not None:
            node.parent.text_len += node.text_len
            node.parent.link_len += node.link_len
    if not found:
        return ""
    if not scored:
        return " ".join(t for _, t, _ in found)

    def final(x: Node) -> float:
        bonus = 25 if x.tag in ("article", "main") or "articleBody" in x.attrs or re.search(r"role\s*=\s*[\"']?main", x.attrs) else 0
        return (x.score + bonus) * (1 - x.link_len / max(1, x.text_len))

    best = max(scored.values(), key=final)
    up = best  # a part of an article stands for all of it
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    best = up or best
    top, edge = final(best), max(10.0, 0.2 * final(best))
    kept = {id(best): True}
    for x in best.parent.kids if best.parent is not None else ():
        if not isinstance(x, Node) or x is best:
            continue
        inside = [(t, k) for _, t, k in blocks(x)] if not boilerplate(x) else []
        size, linked = sum(len(t) for t, _ in inside), sum(k for _, k in inside)
        plain = x.tag in PLAIN and size and linked / size < (0.25 if size > 80 else 0.01)
        if inside and (plain or x.tag in CONTAINER and top > 0 and final(x) >= edge):
            kept[id(x)] = True
    for node in in_order(root):  # what a kept part holds is kept
        if id(node) not in kept:
            kept[id(node)] = node.parent is not None and kept[id(node.parent)]
    return " ".join(text for owner, text, _ in found if kept[id(owner)])


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages (with columns page_id, url and `html`) to page_id, url, text, n_chars (code points), a row for each row.

    A null, empty or text-free page gives an empty text. Text without any markup is all kept. Other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batch, "html"):
            texts = [main_text(h or "") for h in b.column("html").to_pylist()]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return mapped(pages.select("page_id", "url", F.col(html).cast("string").alias("html")), run, f"page_id {kind}, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
