"""Main text of web pages by tag-path ratios.

A page is cut into blocks: runs of text between block-level tags, each with its
root-to-leaf path of block-level elements (with their class and id). Inline
tags belong to their block; text under links is counted apart. Per path, text
length and punctuation are summed over its blocks; ratios to the number of
blocks are smoothed over the other paths by how much of the path they share,
and the two are fused as a geometric mean. Paths whose fused ratio reaches a
share of the page's length-weighted mean are content, and show the container
that holds it. All its blocks come out in page order, linked ones too, without
those that are navigation, notes, forms, adverts or comments by their elements or
names, or are hidden; only where the page itself is the container do paths that
are mostly links go. A form, and a class or id that names boilerplate does not
count if it is a modifier (has-sidebar), the header of a piece (entry-header), or
that of an element around the page's articles or most of its text; if all that
is left is named so, names do not count.

A page is read once from front to back, and sums run over the tree of its
elements, so that time grows with its length, however it is nested or broken.

Nulls and edge cases: a null or empty page, and one without text, gives an
empty string. Character references are decoded, white space in a block becomes
one space, blocks are joined by one newline. Cut-off pages, unclosed tags and
stray end tags are read as far as they go. Repeated rows come out alike, other
columns are kept aside. No text of the content is shortened.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by their role, and names that mark boilerplate.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
NEVER = frozenset("head nav aside footer button select option object svg canvas audio video map dialog menu math".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody"), "body": ("head",),
}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|adsense|adbox|sponsor|sponsored|promo|promotion|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side|aside|"
    r"footer|foot|masthead|topbar|header|comment|comments|respond|reply|replies|discussion|disqus|cookie|cookies|consent|gdpr|notice|notices|alert|popup|modal|overlay|newsletter|subscribe|subscription|"
    r"signup|login|share|sharing|social|related|recommended|widget|pagination|pager|toolbar|skip|copyright|legal|tags|rating|search)(?:$|[\s_-])"
)
TALK = re.compile(r"(?:^|\s)(?:comment|comments|respond|reply|replies|discussion|disqus)(?:$|\s)")  #: may outweigh the article
MODIFIER = re.compile(r"^(?:has|with|without|no|not|hide|show)[\s_-]")
PIECE = re.compile(r"^(?:entry|post|article|content|story|page|section|chapter)[\s_-]+header$")
ROLES = re.compile(r"^(?:navigation|banner|contentinfo|complementary|search|form|alert|dialog|menu|menubar|toolbar)$")
CONTAINER = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Up to the quote that keeps a tag from ending.
UNCLOSED = re.compile(r"<(?:[^>\"']|\"[^\"]*\"|'[^']*')*+[\"']?")
#: Elements of a text; what holds them is a container.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption ul ol li dl dt dd table caption colgroup thead tbody tfoot tr address details summary hgroup".split())
CELLS = frozenset(("th", "td"))  #: parts of a table, or of the page's layout
PAGE = frozenset(("html", "body"))
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(>|$)", re.S)
MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
SHARE = 0.2  #: of the page's mean ratio that a path needs


class Paths:
    """Root-to-leaf paths as a tree of labels; the empty path is 0, and a path comes after the one above it."""

    def __init__(self) -> None:
        self.up, self.label, self.depth = [0], [""], [0]
        self._known: dict[tuple[int, str], int] = {}

    def add(self, up: int, label: str) -> int:
        found = self._known.get((up, label))
        if found is None:
            found = self._known[up, label] = len(self.up)
            self.up.append(up)
            self.label.append(label)
            self.depth.append(self.depth[up] + 1)
        return found

    def below(self, test: Callable[[str], bool]) -> list[bool]:
        """Of each path, whether a label on it passes."""
        out = [False] * len(self.up)
        for i in range(1, len(out)):
            out[i] = out[self.up[i]] or test(self.label[i])
        return out

    def summed(self, own: list[int]) -> list[int]:
        """Of each path, the sum over it and all that lie below."""
        out = own[:]
        for i in range(len(out) - 1, 0, -1):
            out[self.up[i]] += out[i]
        return out


@dataclass
class Block:
    path: int
    text: str
    link_chars: int  #: characters under links
    bad: bool  #: boilerplate by name


@dataclass
class Page:
    paths: Paths
    blocks: list[Block]


def blocks_of(page: str) -> Page:
    """The blocks of a page in order, each with its path. Every character is looked at a bounded number of times."""
    paths, out = Paths(), []
    stack: list[tuple[str, int, int]] = []  # element, its path, its number
    held: Counter[str] = Counter()  # open elements by name
    tree = Tree()
    nodes: list[int] = []  # of each block, its element
    parts: list[str] = []
    endless: set[str] = set()  # elements that no later end tag closes
    link_chars = links = 0

    def end_block() -> None:
        nonlocal link_chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1][1] if stack else 0, text, link_chars, False))
                nodes.append(stack[-1][2] if stack else 0)
            parts.clear()
        link_chars = 0

    def cut(i: int) -> None:
        for element, _, _ in stack[i:]:
            held[element] -= 1
        del stack[i:]

    def close(names: tuple[str, ...], until: frozenset[str]) -> None:
        """Close the innermost of these elements, if it is nearer than ``until``."""
        if not any(held[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                end_block()
                cut(i)
                return
            if stack[i][0] in until:
                return

    def end_of(name: str, start: int) -> int:
        """Behind the element's end tag, or -1 if there is none any more."""
        if name in endless:
            return -1
        end = re.compile(rf"</{name}\s*>", re.I).search(page, start)
        if end is None:
            endless.add(name)
        return end.end() if end else -1

    at, size = 0, len(page)
    scopes = frozenset("table ul ol dl div article section body html td th".split())
    while at < size:
        found = page.find("<", at)
        if found < 0:
            found = size
        if found > at:
            parts.append(page[at:found])
            if links:
                link_chars += found - at
        if found >= size:
            break
        tag = TOKEN.match(page, found)
        if tag is None:
            # No tag: a lone "<", or one whose quote is never closed; all up to that quote is text.
            end = max(found + 1, UNCLOSED.match(page, found).end())
            parts.append(html.escape(page[found:end], quote=False))
            at = end
            continue
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            if tag[0].startswith("<![CDATA["):
                parts.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name not in INLINE:
                end_block()
                if held[name]:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == name:
                            cut(i)
                            break
            continue
        if name in RAW:
            end = end_of(name, at)
            if name not in ("script", "style", "template", "noscript") or not parts:
                end_block()
            at = end if end >= 0 else size
            continue
        if name in INLINE:
            if name == "a":
                links = 1
            elif name == "br":
                parts.append(" ")
            if name not in VOID and tag[3] and _hidden(tag[3]):
                at = max(at, end_of(name, at))
            continue
        end_block()
        if name in ENDS_P:
            close(("p",), scopes - {"body", "html"})
            links = 0
        if name in CLOSES:
            close(CLOSES[name], frozenset(("table", "ul", "ol", "dl")) if name != "body" else frozenset())
        if name in VOID or tag[3].rstrip().endswith("/"):
            continue
        label, bad, named, piece = name, name in NEVER, "form" if name == "form" else "", False
        content = any(held[x] for x in CONTAINER)
        if tag[3]:
            names = []
            for m in MARK.finditer(tag[3]):
                key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
                if key in ("class", "id"):
                    names.append(value)
                    if name not in ("html", "body", "article", "main"):
                        piece |= any(PIECE.match(x) for x in value.split())
                        named += " " + " ".join(naming_words(value, content))
                elif key == "role":
                    # A form's role says no more than its element does.
                    bad |= ROLES.match(value) is not None and not (name == "form" and value == "form")
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    bad = True
            if names:
                label = f"{name}.{' '.join(names)}"
        if name == "header" and not content and not piece:
            bad = True
        up = stack[-1] if stack else (None, 0, 0)
        stack.append((name, paths.add(up[1], label), tree.add(up[2], name, bad, named)))
        held[name] += 1
    end_block()
    bad_nodes = tree.boilerplate(nodes, [len(b.text) for b in out])
    for block, node in zip(out, nodes, strict=True):
        block.bad = bad_nodes[node]
    return Page(paths, out)


def naming_words(value: str, content: bool) -> list[str]:
    """The parts of a class or id that name boilerplate; ``content``: it is inside an article."""
    out = []
    for part in value.split():
        words = re.sub(r"[^a-z0-9]+", " ", part).strip()
        if MODIFIER.match(words) or PIECE.match(words):
            continue
        if content:
            words = re.sub(r"(?:^|(?<= ))header(?:$|(?= ))", "", words)
        if NAMED.search(words):
            out.append(words)
    return out


class Tree:
    """Elements of a page in order, the page itself first, and what makes them boilerplate."""

    def __init__(self) -> None:
        self.up, self.name, self.never, self.named = [0], [""], [False], [""]

    def add(self, up: int, name: str, never: bool, named: str) -> int:
        """``never``: boilerplate whatever it holds; ``named``: the names that say so."""
        self.up.append(up)
        self.name.append(name)
        self.never.append(never or self.never[up])
        self.named.append(named.strip())
        return len(self.up) - 1

    def boilerplate(self, nodes: list[int], sizes: list[int]) -> list[bool]:
        """Of each element, given the blocks' elements and lengths."""
        n = len(self.up)
        every, sound = [0] * n, [0] * n  # characters inside; without those under names further in
        marked, sound_marked = [0] * n, [0] * n  # the same of article and main elements
        titles = [0] * n  # h1 blocks, without those under names further in
        for i, size in zip(nodes, sizes, strict=True):
            if not self.never[i]:
                every[i] += size
                sound[i] += size
                titles[i] += self.name[i] == "h1"
        for i in range(n - 1, -1, -1):
            if self.name[i] in CONTAINER:
                marked[i], sound_marked[i] = every[i], sound[i]
            if i:
                up = self.up[i]
                every[up] += every[i]
                marked[up] += marked[i]
                if not self.named[i]:
                    sound[up] += sound[i]
                    sound_marked[up] += sound_marked[i]
                    titles[up] += titles[i]
        inside, around = [False] * n, [0] * n  # in an article; the nearest named element around
        for i in range(1, n):
            up = self.up[i]
            inside[i] = inside[up] or self.name[up] in CONTAINER
            around[i] = up if self.named[up] else around[up]
        dropped = [False] * n
        articles, heads = sound_marked[0], titles[0]  # kept so far
        # The largest come first, and outer elements before inner ones.
        for i in sorted((i for i in range(1, n) if self.named[i]), key=lambda i: (-marked[i], -every[i], i)):
            talk = TALK.search(self.named[i]) is not None
            if marked[i]:
                keep = articles == 0 if talk else marked[i] >= articles
            else:
                keep = not talk and 2 * every[i] > every[0] and articles == 0 and heads == 0
            dropped[i] = not keep or dropped[around[i]]
            if not dropped[i]:
                articles += sound[i] if inside[i] else sound_marked[i]
                heads += titles[i]
        bad = self.never[:]
        for i in range(1, n):
            bad[i] = bad[i] or dropped[i] or bad[self.up[i]]
        return self.never if all(bad[i] for i in nodes) else bad


def _hidden(attributes: str) -> bool:
    """Whether an element's own attributes take it off the page."""
    for m in MARK.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key == "hidden" or key == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def path_ratios(paths: Paths, blocks: list[Block]) -> dict[int, float]:
    """Smoothed and fused text and punctuation ratio of each path."""
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0])
        s[0] += 1
        s[1] += max(0, len(b.text) - b.link_chars)
        s[2] += len(PUNCTUATION.findall(b.text)) * (1.0 if b.link_chars < len(b.text) else 0.0)
    # Paths are smoothed over those under the same parent, by their share of text.
    parents: dict[int, list[float]] = {}
    for p, own in sums.items():
        s = parents.setdefault(paths.up[p], [0.0, 0.0, 0.0])
        for k in range(3):
            s[k] += own[k]
    out = {}
    for p, (own, chars, punct) in sums.items():
        n, all_chars, marks = parents[paths.up[p]]
        out[p] = math.sqrt((0.75 * chars / own + 0.25 * all_chars / n) * (0.75 * punct / own + 0.25 * marks / n + 0.1))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    parsed = blocks_of(page)
    paths, sound = parsed.paths, [b for b in parsed.blocks if not b.bad]
    if not sound:
        return ""
    ratio = path_ratios(paths, sound)
    chars, linked = dict.fromkeys(ratio, 0), dict.fromkeys(ratio, 0)
    for b in sound:
        chars[b.path] += len(b.text)
        linked[b.path] += min(b.link_chars, len(b.text))
    mean = sum(ratio[p] * n for p, n in chars.items()) / sum(chars.values())
    chosen = {p for p, n in chars.items() if ratio[p] >= SHARE * mean and 2 * linked[p] <= n}
    if not chosen:
        chosen = {max(chars, key=lambda p: (ratio[p], -p))}
    # The container: an article or main element with most of the content, else the deepest element that holds it.
    weight = sum(chars[p] for p in chosen)
    held = paths.summed([chars[p] if p in chosen else 0 for p in range(len(paths.up))])
    marked = [p for p, n in enumerate(held) if p and n and element(paths.label[p]) in CONTAINER and 2 * n >= weight]
    deepest = lambda some: max(some, key=lambda p: (paths.depth[p], -p))
    container = deepest(marked) if marked else holder(deepest([p for p, n in enumerate(held) if 10 * n >= 9 * weight]), paths, chars)
    # The page itself is no container: of what it holds, the parts of a text count.
    whole = not container or element(paths.label[container]) in PAGE
    inside, as_text = [False] * len(held), [False] * len(held)
    inside[container] = as_text[container] = True
    for p in range(container + 1, len(held)):
        up = paths.up[p]
        inside[p] = inside[up]
        as_text[p] = as_text[up] and element(paths.label[p]) in PARTS | CELLS | PAGE
    lines = []
    for b in sound:
        p = b.path
        few_links = 2 * linked[p] <= chars[p]
        heading = element(paths.label[p]) in HEADINGS and b.link_chars < len(b.text)
        if inside[p]:
            # Within a container only roles tell what is no part of it; the page's own list of links is one.
            keep = not whole or as_text[p] and few_links or p in chosen or heading
        else:
            keep = not marked and p in chosen
        if keep:
            lines.append(b.text)
    return "\n".join(lines)


def element(label: str) -> str:
    return label.split(".", 1)[0]


def holder(path: int, paths: Paths, with_text: Iterable[int]) -> int:
    """The path, or the nearest one above it that is no part of a text; a cell with blocks in it is none."""
    own = [0] * len(paths.up)
    for p in with_text:
        own[p] = 1
    below = [n - o for n, o in zip(paths.summed(own), own, strict=True)]
    while path and (element(paths.label[path]) in PARTS or element(paths.label[path]) in CELLS and not below[path]):
        path = paths.up[path]
    return path


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page (page_id, url, html)."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.record_batch([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return chosen.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
