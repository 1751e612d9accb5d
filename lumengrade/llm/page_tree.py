"""Element trees of web pages: tolerant parsing, subtree digests and the text blocks of what is kept.

A small helper for one page at a time; what recurs on a site is counted by Spark (page_text.py).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from functools import cache

import xxhash

# Element names of the HTML standard by role (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li "
    "main menu nav ol optgroup option p pre search section summary table caption colgroup thead tbody tfoot tr td th ul noscript template".split()
)
SCOPE = frozenset("table td th caption template object".split())
NOT_IN_P = BLOCK - frozenset("caption colgroup thead tbody tfoot tr td th option optgroup legend noscript template".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends the open elements named here that are nearer than the container.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)), "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}

#: Elements that are never part of a main text, and class, id or role words that say so.
CHROME = frozenset(
    "nav header footer aside form script style noscript template title textarea select button input object iframe embed svg canvas audio video dialog menu search "
    "xmp noembed noframes datalist map".split()
)
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification newsletter subscribe "
    "subscription signup popup modal overlay sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus respond "
    "share sharing social related recommended toolbar pagination pager login contentinfo complementary".split()
)
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table figure dl".split())
ITEMS = frozenset("li dt dd option optgroup thead tbody tfoot tr td th caption colgroup legend summary hr".split())

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Node:
    """An element: its tag, whether its attributes mark it as chrome or as main text, and its parts (text or elements)."""

    __slots__ = ("tag", "chrome", "main", "parts", "holds", "size", "linked", "prose", "titled", "digest")

    def __init__(self, tag: str, chrome: bool = False, main: bool = False):
        self.tag, self.chrome, self.main, self.parts = tag, chrome, main, []


def _marks(tag: str, raw: str) -> tuple[bool, bool]:
    """Whether attributes mark an element as chrome, and as main text."""
    chrome = main = False
    for name, *values in ATTRIBUTE.findall(raw):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            named = [x for x in f"{value} {CAMEL.sub('-', value)}".lower().split() if not x.startswith(("has-", "no-", "with-", "without-"))]
            chrome = chrome or not CHROME_WORDS.isdisjoint(named if tag == "article" else WORDS.findall(" ".join(named)))
            main = main or (name == "role" and value.strip().lower() in ("main", "article"))
        elif name == "itemprop":
            main = main or value.strip().lower() == "articlebody"
        elif name == "hidden" or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
            chrome = True
    return chrome and tag not in HEADING, main or tag in ("article", "main")


@cache
def _closing(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def parse(page: str) -> Node:
    """The element tree of a page. Missing end tags are supplied as browsers do; html, head and body themselves are left out."""
    root = Node("body")
    stack, open_at = [root], defaultdict(list)  # where each tag, "scope" and "block" are open on the stack

    def close_to(at: int) -> None:
        while len(stack) > at:
            gone = stack.pop()
            open_at[gone.tag].pop()
            if gone.tag in SCOPE:
                open_at["#scope"].pop()
            if gone.tag in BLOCK:
                open_at["#block"].pop()

    def last(*tags: str) -> int:
        return max((open_at[t][-1] for t in tags if open_at[t]), default=0)

    def text(piece: str) -> None:
        if piece:
            stack[-1].parts.append(piece)

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        text(page[at:start])
        after = page[start + 1 : start + 2]
        if after in ("!", "?"):
            stop = page.find("-->", start + 2) if page.startswith("<!--", start) else page.find(">", start)
            at = end if stop < 0 else stop + (3 if page.startswith("-->", stop) else 1)
            continue
        closing = after == "/"
        name = page[start + 2 : start + 3] if closing else after
        if not (name.isascii() and name.isalpha()):
            stop = page.find(">", start) if closing else -1  # </ without a name is dropped to its end, < alone is text
            if stop < 0:
                text("<")
            at = start + 1 if stop < 0 else stop + 1
            continue
        found = TAG.match(page, start)
        if not found:  # an open quote, or no end at all
            stop = page.find(">", start)
            if stop < 0:
                break
            found = re.match(r"</?([a-zA-Z][^\s/>]*)([^>]*)>", page[start : stop + 1])
            at = stop + 1
        else:
            at = found.end()
        tag = found[1].lower()
        if tag in ("html", "head", "body", "frameset"):
            continue
        if closing:
            if tag == "br":
                text(" ")
            elif open_at[tag] and open_at[tag][-1] > last("#scope" if tag in BLOCK and tag not in SCOPE else "#block" if tag not in BLOCK else "table"):
                close_to(open_at[tag][-1])
            elif tag in SCOPE and open_at[tag]:
                close_to(open_at[tag][-1])
            elif tag == "p":
                stack[-1].parts.append(Node("p"))
            continue
        if tag in NOT_IN_P and last("p") > last("#scope"):
            close_to(last("p"))
        if tag in ENDS:
            ended, within = ENDS[tag]
            beyond = [open_at[t][k] for t in ended if (k := bisect_right(open_at[t], last(*within))) < len(open_at[t])]
            if beyond:
                close_to(min(beyond))
        elif tag in HEADING and stack[-1].tag in HEADING:
            close_to(len(stack) - 1)
        if tag == "br":
            text(" ")
            continue
        node = Node(tag, *(_marks(tag, found[2]) if found[2] else (False, tag in ("article", "main"))))
        stack[-1].parts.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            closes = _closing(tag).search(page, at)
            stop = page.find(">", closes.start()) if closes else -1
            at = end if stop < 0 else stop + 1
            continue
        open_at[tag].append(len(stack))
        if tag in SCOPE:
            open_at["#scope"].append(len(stack))
        if tag in BLOCK:
            open_at["#block"].append(len(stack))
        stack.append(node)
    _measure(root)
    return root


def _measure(root: Node) -> None:
    """Bottom up: whether a main element, prose or a title lies inside (holds, prose, titled), code points of text and of linked text, digest."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [x for x in node.parts if type(x) is not str]
    for node in reversed(order):
        node.holds, node.prose, node.titled = node.main, node.tag in PROSE, node.tag == "h1"
        node.size, node.linked, seen = 0, 0, [node.tag.encode()]
        for x in node.parts:
            if type(x) is str:
                said = " ".join(x.split())
                node.size += len(said)
                seen.append(said.encode("utf-8", "surrogatepass"))
            else:
                node.holds, node.prose, node.titled = node.holds or x.holds, node.prose or x.prose, node.titled or x.titled
                node.size, node.linked = node.size + x.size, node.linked + x.linked
                seen.append(x.digest)
        if node.tag == "a":
            node.linked = node.size
        node.digest = xxhash.xxh3_64_digest(b"\0".join(seen))


def _is_chrome(node: Node) -> bool:
    """Never part of a main text, by its name, or by its marks unless a main element lies inside."""
    return node.tag in CHROME or (node.chrome and (not node.holds or (node.main and node.tag == "article")))


def mains(root: Node) -> list[Node]:
    """The elements that hold the main text: the outermost articles outside chrome, else main elements, else the whole page."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.main):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and _is_chrome(node):
                continue
            if wanted(node):
                found.append(node)
            else:
                todo += [x for x in reversed(node.parts) if type(x) is not str and x.holds]
        if any(n.size for n in found):
            return found
    return [root]


def number(node: Node) -> int:
    """A subtree's digest as a long."""
    return int.from_bytes(node.digest, "big", signed=True)


def subtrees(root: Node) -> set[int]:
    """Digests of the subtrees that may belong to a site's template.

    Outside the main elements these are all blocks with text that hold no main element. Inside, where texts may quote each other, only
    blocks without prose (paragraphs, headings, quotes, tables), or made of links for the greater part. A page without
    main elements has all its blocks looked at.
    """
    chosen = mains(root)
    inside = {id(n) for n in chosen} if chosen != [root] else set()
    found, todo = set(), [(x, False) for x in (root.parts if inside else chosen[0].parts) if type(x) is not str]
    while todo:
        node, within = todo.pop()
        within = within or id(node) in inside
        if node.size and node.tag in BLOCK and node.tag not in ITEMS and not node.holds and (not within or _plain(node)):
            found.add(number(node))
        if node.tag not in PROSE or not within:
            todo += [(x, within) for x in node.parts if type(x) is not str]
    return found


def _plain(node: Node) -> bool:
    """A block inside a main element that a template may have put there."""
    return 2 * node.linked >= node.size or (not node.prose and node.tag in ("div", "section", "aside"))


def _blocks(roots: list[Node], gone: frozenset[int], within: bool) -> tuple[list[str], int]:
    """Text blocks of the roots in page order without chrome and without subtrees of `gone`; how many subtrees of `gone` went."""
    out, current, cut = [], [], 0

    def flush() -> None:
        said = " ".join(html.unescape("".join(current)).split())
        current.clear()
        if said:
            out.append(said)

    for root in roots:
        # (part, inside a header of the main text, inside preformatted text); None ends a block
        todo: list = [(x, False, False) for x in reversed(root.parts)]
        while todo:
            entry = todo.pop()
            if entry is None:
                flush()
                continue
            part, header, code = entry
            if type(part) is str:
                if not header:
                    current.append(part)
                continue
            block = part.tag in BLOCK
            if gone and block and part.size and not part.holds and number(part) in gone and (not within or _plain(part)):
                flush()
                cut += 1
                continue
            if part.main and part.tag == "article" and within:
                flush()  # an article within an article is a reader's comment
                continue
            if _is_chrome(part) and not code:
                flush()
                if not (within and part.titled and part.tag in ("header", "div", "section")):
                    continue
                header = True  # of an article's header the title stays
            elif part.tag in HEADING:
                header = False
            if block:
                flush()
                todo.append(None)
            todo += [(x, header, code or part.tag == "pre") for x in reversed(part.parts)]
        flush()
    return out, cut


def main_text(root: Node, gone: frozenset[int], copied: float = 0.1, copied_main: float = 0.5) -> tuple[str, int]:
    """(text, template subtrees cut) of a page whose site's template holds the subtrees `gone`.

    Where next to nothing would be left (a share below `copied`, or `copied_main` of a marked main text), the page is a near copy of
    others of its site, not their template; then only chrome is cut.
    """
    chosen = mains(root)
    within = chosen != [root]
    left, cut = _blocks(chosen, gone, within)
    if cut:
        full, _ = _blocks(chosen, frozenset(), within)
        if sum(map(len, left)) < (copied_main if within else copied) * sum(map(len, full)):
            return "\n".join(full), 0
    if within:  # what lies outside goes whole; the template's part of it is counted
        todo = [x for x in root.parts if type(x) is not str]
        while todo:
            node = todo.pop()
            if node.size and node.tag in BLOCK and node.tag not in ITEMS and not node.holds and number(node) in gone:
                cut += 1
            elif not node.main:
                todo += [x for x in node.parts if type(x) is not str]
    return "\n".join(left), cut
