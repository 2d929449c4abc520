"""Operator 2, main text of web pages, with templates deduced from equivalence classes.

Pages of one host come from one template. A token is a tag with its path, or a word with the path of its block; tokens that
occur equally often in every page of a host form an equivalence class. A class that enough pages support and whose tokens
keep their order in every page is valid and part of the template. Tags that occur
once a page are the template's frame: each opens a slot, which holds what lies in that element and in no deeper tag of the
frame. Classes nest in the slots: each is a class of one slot. What of a slot's text belongs to no class is slot text; the
slot with most of it on the pages of the host is the article, and blocks made of template words are left out of it.

Elements and words of class and id decide what the template can't: navigation, forms, comments and the like hold no article
text wherever they lie, and pages of hosts with too few pages for a template are judged by their own elements.

Occurrence vectors are never gathered: the exclusive or of hashes of (page, count) stands for each, so tokens of a host with
very many pages are counted with partial aggregates like any other. Words are counted only where the first or the last word
of a block recurs on the host, so that the words of articles aren't shuffled.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

_RAW = "script|style|noscript|template|svg|iframe|textarea|select|object|canvas|math"
_RAW_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in _RAW.split("|")}
_NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*+")
#: The rest of a tag up to its end; quantifiers that never give back keep a failing match linear.
_REST = re.compile(r"[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+>")
_ATTRIBUTE = re.compile(r"(?<![a-zA-Z-])(?:([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|(hidden)\b)")
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag that ends open paragraphs, items, cells and so on, as browsers do: what it ends, up to what.
_ENDS = {"li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: Elements, roles and words of class and id that hold no article text.
DROP_TAGS = frozenset("nav footer aside form button dialog menu head title input label fieldset".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
DROP_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login sidebar aside widget widgets related recommended recommendations share sharing social comment comments commentlist disqus replies respond discussion nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar footer masthead skip".split())
MAIN_WORDS = frozenset("article articlebody post postbody content main story entry body text".split())


#: Words of regions that hold texts of their own, often in article elements: never taken for the article while there is another.
ASIDE_WORDS = frozenset("comment comments commentlist disqus replies respond related recommended recommendations sponsored sponsors promo promotion ad ads".split())
#: Words that ids of sections inside an article are still tested for.
REPLY_WORDS = frozenset("comment comments commentlist disqus replies respond".split())
_HEADING = re.compile(r"h[1-6]")
#: Share of a block's words that make it template, and of a slot's text that must be slot text (else its pages are copies).
BLOCK_SHARE, SLOT_SHARE = 0.75, 0.05


class Block:
    """A run of text inside one element, ``node`` (None outside all). ``linked``: characters of it inside links."""

    __slots__ = ("chars", "dropped", "heading", "linked", "node", "text")

    def __init__(self, text, node, heading, linked):
        self.text, self.node, self.heading, self.linked = text, node, heading, linked
        self.chars, self.dropped = len(text), False


class Node:
    """An element. ``path`` is a hash of what it is and what it is in; ``drop``: no article text may come from it (see :func:`settle`)."""

    __slots__ = ("class_words", "drop", "hard", "in_article", "in_header", "like", "main", "number", "parent", "path", "plain", "size", "suspect", "tag", "words")

    def __init__(self, tag, number, parent, attributes):
        self.tag, self.number, self.parent = tag, number, parent
        classes, name = attributes.get("class", ""), attributes.get("id", "")
        self.path = token("path", parent.path if parent else 0, f"{tag}.{classes}")
        # A path by which sections are equal whatever their class.
        self.like = token("path", parent.like if parent else 0, tag if tag == "section" else f"{tag}.{classes}")
        self.in_article = parent is not None and (parent.in_article or parent.main > 0)
        role = attributes.get("role", "").lower()
        self.main = 2 if (tag == "article" or role == "article") else 1 if tag == "main" or role == "main" else 0
        words, ids = (set(re.findall(r"[a-z]+|[0-9]+", x.lower())) for x in (classes, name))
        self.class_words = words
        if _HEADING.fullmatch(tag):
            ids = set()
        elif tag == "section" and self.in_article:
            ids &= REPLY_WORDS
        self.words = words = words | ids
        self.hard = (tag in DROP_TAGS and tag != "form") or (role in DROP_ROLES and role != "form") or "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*+:\s*+none", attributes.get("style", "")) is not None
        # Elements dropped unless they turn out to hold the page's article.
        self.suspect = tag == "form" or role == "form"
        if tag not in ("html", "body", "main"):
            self.suspect |= bool(words & DROP_WORDS) and not (tag == "article" and not words & {"comment", "comments", "ad", "related", "promo"})
            self.suspect |= not self.in_article and not self.main and (tag == "header" or "header" in words)
        self.in_header = self.drop = False
        self.size = self.plain = 0

    def within(self, numbers) -> bool:
        node = self
        while node is not None and node.number not in numbers:
            node = node.parent
        return node is not None


def token(kind: str, path: int, text: str = "") -> int:
    """A signed 64-bit hash of a token."""
    return xxhash.xxh64_intdigest(f"{kind}\n{path}\n{text}") - (1 << 63)


def settle(blocks: list[Block], nodes: list[Node]) -> None:
    """Sets ``drop`` of all elements and ``dropped`` of all blocks, in one pass down and one up the tree.

    A suspect element (by the words of class and id, a form or a header) is kept if it holds the page's main element, its
    article or, where there is neither, most of its text. Regions of ``ASIDE_WORDS`` are kept only if nothing else is left.
    """
    hard, clear = [False] * len(nodes), [True] * len(nodes)
    for n in nodes:  # parents come before what they hold
        up = n.parent
        hard[n.number] = n.hard or (up is not None and hard[up.number])
        clear[n.number] = not n.suspect and (up is None or clear[up.number])
    total = free = 0
    for b in blocks:
        n = b.node
        if n is not None and hard[n.number]:
            continue
        chars = b.chars - min(b.linked, b.chars)
        total += chars
        if n is None or clear[n.number]:
            free += chars
        if n is not None:
            n.size += chars  # text in no element that is dropped whatever it holds
            n.plain += chars if clear[n.number] else 0  # and in no suspect element
    for n in reversed(nodes):
        if n.parent is not None:
            n.parent.size += n.size
            n.parent.plain += n.plain
    outside = max((n.plain for n in nodes if n.main), default=0)
    # A candidate is a main or article element that is no suspect itself; each counts for the suspects that it lies in.
    holds, mains = [0] * len(nodes), [False] * len(nodes)
    for n in reversed(nodes):
        if n.parent is not None:
            up = n.parent.number
            candidate = n.main > 0 and not n.suspect and n.size > 0
            holds[up] = max(holds[up], holds[n.number], n.size if candidate else 0)
            mains[up] = mains[up] or mains[n.number] or (candidate and n.main == 1)
    any_main = outside > 0 or any(n.suspect and holds[n.number] for n in nodes)
    for n in nodes:
        kept = not n.suspect
        if n.suspect and any_main:
            kept = mains[n.number] or holds[n.number] > (0 if not outside else outside if not n.words & ASIDE_WORDS else total)
        elif n.suspect:
            kept = not free if n.words & ASIDE_WORDS else 2 * n.size > total
        up = n.parent
        n.in_header = not n.main and (up is not None and up.in_header or n.tag == "header" and not (n.suspect and kept))
        n.drop = n.hard or not kept or (up is not None and up.drop)
    for b in blocks:
        top = b.node
        b.dropped = top is not None and (top.drop or top.in_header and not b.heading)


def pieces(page: str, raw: dict[str, re.Pattern] = _RAW_ENDS):
    """(text, None, "") and (name, closing, attributes) in page order, in time linear in the page; ``raw`` elements are left out.

    Comments, declarations and elements without text are left out. A tag without end ends the page, as in browsers; a quote
    without end is read as if it were none. Any other "<" is text.
    """
    at = begin = 0
    quotes = True
    while (at := page.find("<", at)) >= 0:
        after = page[at + 1 : at + 2]
        name = _NAME.match(page, at + 1) if after == "/" or after.isascii() and after.isalpha() else None
        if name is None and after not in ("!", "?"):
            at += 1
            continue
        if at > begin:
            yield page[begin:at], None, ""
        if name is None:
            end = page.find("-->", at + 4) + 2 if page.startswith("<!--", at) else page.find(">", at)
            if end < 2:
                return
            begin = at = end + 1
            continue
        end = None
        if quotes:
            rest = _REST.match(page, name.end())
            quotes = rest is not None
            end = rest.end() if rest else None
        if end is None:
            end = page.find(">", name.end()) + 1
            if not end:
                return
        said = name[0].lower()
        closing = said[0] == "/"
        said = said.lstrip("/")
        attributes = page[name.end() : end - 1]
        begin = at = end
        if said in raw:
            if not closing and not attributes.endswith("/"):
                close = raw[said].search(page, end)
                if close is None:
                    return
                begin = at = close.end()
            continue
        yield said, closing, attributes
    if begin < len(page):
        yield page[begin:], None, ""


def parse(page: str) -> tuple[list[Block], list[Node]]:
    """Text blocks in page order, and all elements, each after the one that it is in."""
    stack: list[Node] = []
    opened: dict[str, int] = {}
    nodes: list[Node] = []
    blocks: list[Block] = []
    said: list[str] = []
    linked = 0
    links = 0

    def flush():
        nonlocal linked
        text = " ".join(entities.unescape("".join(said)).split()) if said else ""
        if text:
            heading = any(_HEADING.fullmatch(n.tag) for n in stack[-3:])
            blocks.append(Block(text, stack[-1] if stack else None, heading, linked))
        said.clear()
        linked = 0

    def close(upto: int):
        for n in stack[upto:]:
            opened[n.tag] -= 1
        del stack[upto:]

    for name, closing, attributes in pieces(page):
        if closing is None:
            said.append(name)
            if links:
                linked += len(name)
            continue
        if name == "br":
            said.append(" ")
        if name == "a":
            links = 0 if closing else 1
        if name not in _BLOCK:
            continue
        flush()
        links = 0
        if closing:
            if opened.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == name))
            continue
        if name in _ENDS:
            ended, limit = _ENDS[name]
            if any(opened.get(x) for x in ended):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag in limit:
                        break
                    if stack[i].tag in ended:
                        close(i)
                        break
        elif stack and stack[-1].tag == "p":
            close(len(stack) - 1)
        elif stack and stack[-1].tag == "head" and name != "title":
            close(len(stack) - 1)
        found = {k.lower() or hidden: a or b or c for k, a, b, c, hidden in _ATTRIBUTE.findall(attributes)} if attributes else {}
        node = Node(name, len(nodes), stack[-1] if stack else None, found)
        nodes.append(node)
        if name not in _VOID:
            stack.append(node)
            opened[name] = opened.get(name, 0) + 1
    flush()
    settle(blocks, nodes)
    return blocks, nodes


def _main_parts(live: list[Block], nodes: list[Node], size: dict[int, int]) -> frozenset[int]:
    """All article elements of the page's main element, or that element itself if they are less than half of its text.

    Without a main element: the largest article element and those beside it.
    """
    mains = [n for n in size if nodes[n].main == 1]
    articles = [n for n in size if nodes[n].main == 2]
    if mains:
        best = max(mains, key=lambda n: (size[n], -n))
        if not articles or 2 * size[best] >= max(size[n] for n in articles):
            inside = _marked(nodes, frozenset([best]))
            held = frozenset(n for n in articles if inside[n])
            among = _marked(nodes, held)
            inner = sum(b.chars for b in live if b.node is not None and among[b.node.number])
            return held if 2 * inner >= size[best] else frozenset([best])
    best = max(articles, key=lambda n: (size[n], -n))
    return frozenset(n for n in articles if nodes[n].parent is nodes[best].parent)


def _marked(nodes: list[Node], numbers: frozenset[int]) -> list[bool]:
    """For each element, whether it is one of ``numbers`` or inside one."""
    out = [False] * len(nodes)
    for n in nodes:
        out[n.number] = n.number in numbers or (n.parent is not None and out[n.parent.number])
    return out


def _body_parts(live: list[Block], nodes: list[Node], slot: int | None) -> tuple[frozenset[int], frozenset[int]]:
    """Of a page without main and article elements: the article's element and all like it, and the elements they lie in.

    The article's element is the one that opens ``slot``, the host's article slot, or else the one with most text.
    """
    inside = next((n.number for n in nodes if n.path == slot), None) if slot is not None else None
    if inside is not None and not any(b.node is not None and b.node.within((inside,)) for b in live):
        inside = None
    if inside is None:
        body: dict[int, int] = {}
        for b in live:
            if b.node is not None:
                # the element that holds the block's own element
                n = b.node
                holder = n.parent if n.parent is not None and n.tag not in ("div", "section", "td", "body") else n
                body[holder.number] = body.get(holder.number, 0) + b.chars
        if not body:
            return frozenset(), frozenset()
        named = {n: c for n, c in body.items() if nodes[n].class_words & MAIN_WORDS}
        inside = max(named or body, key=lambda n: (body[n], -n))
    above = nodes[inside].parent
    if above is not None and above.tag not in ("html", "body") and any(b.heading and b.node.within((above.number,)) for b in live if b.node is not None):
        inside = above.number
    alike = frozenset(n.number for n in nodes if n.like == nodes[inside].like)
    around: dict[int, int] = {}
    for n in alike:
        if nodes[n].parent is not None:
            around[nodes[n].parent.number] = around.get(nodes[n].parent.number, 0) + 1
    return alike, frozenset(n for n, k in around.items() if k > 1)


def word_tokens(block: Block) -> list[int]:
    path = block.node.path if block.node is not None else 0
    return [token("word", path, w) for w in block.text.split(" ")]


def end_tokens(block: Block) -> tuple[int, int]:
    """Tokens of a block's first and last word."""
    path = block.node.path if block.node is not None else 0
    return token("first", path, block.text[: block.text.find(" ")] if " " in block.text else block.text), token("last", path, block.text[block.text.rfind(" ") + 1 :])


def is_template(block: Block, ends: frozenset[int], template: frozenset[int]) -> bool:
    """Whether at least ``BLOCK_SHARE`` of a block's words are template."""
    if ends.isdisjoint(end_tokens(block)):
        return False
    words = word_tokens(block)
    return sum(t in template for t in words) >= BLOCK_SHARE * len(words)


def article(blocks: list[Block], nodes: list[Node], template: frozenset[int] = frozenset(), ends: frozenset[int] = frozenset(), slot: int | None = None) -> tuple[str, int]:
    """The article's blocks joined by newlines, and how many characters of it were left out as template.

    ``template``: word tokens of the host's template; ``ends``: its recurring first and last words; ``slot``: the path
    of the element that opens its article slot.
    """
    live = [b for b in blocks if not b.dropped]
    size: dict[int, int] = {}
    own = [0] * len(nodes)
    for b in live:
        if b.node is not None:
            own[b.node.number] += b.chars
    for n in reversed(nodes):
        if n.parent is not None:
            own[n.parent.number] += own[n.number]
        if n.main and own[n.number]:
            size[n.number] = own[n.number]
    if size:
        inside, headed = _main_parts(live, nodes, dict(sorted(size.items()))), frozenset()
    else:
        live = [b for b in live if b.heading or b.linked * 2 < b.chars]
        inside, headed = _body_parts(live, nodes, slot)
    if inside:
        among = _marked(nodes, inside)
        live = [b for b in live if b.node is not None and (among[b.node.number] or b.heading and b.node.parent is not None and b.node.parent.number in headed)]
    kept = [b for b in live if not is_template(b, ends, template)] if template else live
    return "\n".join(b.text for b in kept), sum(b.chars for b in live) - sum(b.chars for b in kept)


PAGE = token("page", 0)
TAG, END, WORD = range(3)


def _outline(batches):
    """(host, page, html) to (host, page, token, kind, n): the tags and the block ends of each page, once each."""
    for batch in batches:
        rows, ids, kinds, counts = [], [], [], []
        for i, source in enumerate(batch.column(2).to_pylist()):
            blocks, nodes = parse(source)
            seen: dict[tuple[int, int], int] = {(PAGE, TAG): 1}
            for n in nodes:
                seen[n.path, TAG] = seen.get((n.path, TAG), 0) + 1
            for b in blocks:
                for t in end_tokens(b):
                    seen[t, END] = seen.get((t, END), 0) + 1
            rows.extend([i] * len(seen))
            ids.extend(t for t, _ in seen)
            kinds.extend(k for _, k in seen)
            counts.extend(seen.values())
        rows = pa.array(rows, pa.int64())
        yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(counts, pa.int32())], ["host", "page", "token", "kind", "n"])


class Known:
    """Sets of the longs in a list column of a batch, made once for each host."""

    def __init__(self):
        self.sets: dict[int, frozenset[int]] = {}

    def of(self, hosts: list, column: pa.Array) -> list[frozenset[int]]:
        offsets = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        values = column.flatten().to_numpy(zero_copy_only=False)
        out = []
        for i, host in enumerate(hosts):
            if host not in self.sets:
                if len(self.sets) >= 64:
                    self.sets.clear()
                self.sets[host] = frozenset(values[offsets[i] : offsets[i + 1]].tolist())
            out.append(self.sets[host])
        return out


def _words(batches):
    """(host, page, html, frame, ends) to one row a page: its frame tags and the words of recurring blocks, in page order.

    Each token comes with its count, its characters and the slot that it lies in; ``slots`` and ``chars`` are the slots that
    hold text and how much.
    """
    frames, known = Known(), Known()
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        out: list[list] = [[], [], [], [], [], []]
        for source, frame, ends in zip(batch.column(2).to_pylist(), frames.of(hosts, batch.column(3)), known.of(hosts, batch.column(4)), strict=True):
            blocks, nodes = parse(source)
            slot = [0] * len(nodes)
            seen: dict[int, list[int]] = {}
            for n in nodes:
                above = slot[n.parent.number] if n.parent is not None else 0
                slot[n.number] = n.path if n.path in frame else above
                if n.path in frame:
                    seen[n.path] = [1, 0, above]
            held: dict[int, int] = {}
            for b in blocks:
                mine = slot[b.node.number] if b.node is not None else 0
                if not b.dropped:
                    solid = b.chars - b.text.count(" ")  # as the lengths of words are counted
                    held[mine] = held.get(mine, 0) + solid - min(b.linked, solid)
                if not ends.isdisjoint(end_tokens(b)):
                    # Words of dropped blocks are of no use: they are left out whether template or not.
                    for t, w in zip(word_tokens(b), b.text.split(" "), strict=True) if not b.dropped else ():
                        seen.setdefault(t, [0, len(w), mine])[0] += 1
            out[0].append(list(seen))
            for k in range(3):
                out[k + 1].append([x[k] for x in seen.values()])
            out[4].append(list(held))
            out[5].append(list(held.values()))
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        kinds = [longs, ints, ints, longs, longs, ints]
        yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]], ["host", "page", "tokens", "counts", "lengths", "inside", "slots", "chars"])


def _orders(batches):
    """(host, tokens, known tokens, their classes) to (host, class, order): in which order a page holds the tokens of a class."""
    for batch in batches:
        hosts = batch.column(0).to_pylist()
        maps: dict[int, dict[int, int]] = {}
        rows: list[tuple[int, int, int]] = []
        for host, tokens, known, classes in zip(hosts, *(batch.column(k) for k in range(1, 4)), strict=True):
            if host not in maps:
                maps[host] = dict(zip(known.values.to_numpy().tolist(), classes.values.to_numpy().tolist(), strict=True)) if known.is_valid else {}
            found: dict[int, list[int]] = {}
            for t in tokens.as_py():
                c = maps[host].get(t)
                if c is not None:
                    found.setdefault(c, []).append(t)
            rows.extend((host, c, xxhash.xxh64_intdigest(str(members)) - (1 << 63)) for c, members in found.items())
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["host", "class", "order"])


def once_each(pages: DataFrame) -> DataFrame:
    """Rows (host, page, html) without those that equal another byte for byte; only such rows are shuffled."""
    copied = cut(pages.groupBy("host", "page").agg(F.count("*").alias("n")).filter("n > 1").select("host", "page"))
    if copied.isEmpty():
        return pages
    one = pages.join(copied, ["host", "page"], "left_semi").dropDuplicates(["host", "page"])
    return pages.join(copied, ["host", "page"], "left_anti").unionByName(one.select(*pages.columns))


#: Template tokens (8 bytes each) up to which they are sent to every task; beyond it pages are shuffled by host.
BROADCAST_MOST = 200_000


def _for_hosts(pages: DataFrame, lists: DataFrame, tokens: DataFrame, most: int) -> DataFrame:
    """``pages`` with the lists of their host; ``tokens`` are the rows that the lists were made of."""
    small = tokens.limit(most + 1).count() <= most
    return pages.join(F.broadcast(lists) if small else lists, "host", "left")


def templates(pages: DataFrame, least_pages: int = 3, share: float = 0.5, broadcast_most: int = BROADCAST_MOST) -> tuple[DataFrame, DataFrame]:
    """The template of each host of ``pages`` (host, page, html): (host, words, ends, slot), and (host, token) for their number.

    A class is supported if its tokens occur in at least ``least_pages`` pages with different html and in ``share`` of the
    host's; it is valid if its tokens keep one order and lie in one slot in all of them. A host with fewer pages has no
    template. ``slot`` is the article slot: the one with most slot text, if that is at least half of the host's.
    """
    distinct = once_each(pages)
    vector = F.expr("bit_xor(xxhash64(page, n))").alias("class")
    outline = distinct.mapInArrow(_outline, "host long, page long, token long, kind int, n int")
    counted = cut(outline.groupBy("host", "token", "kind").agg(F.count("*").alias("pages"), vector, F.max("n").alias("most")).filter(F.col("pages") >= least_pages))
    whole = counted.filter((F.col("token") == PAGE) & (F.col("kind") == TAG)).select("host", F.col("pages").alias("all"))
    enough = F.col("pages") >= F.col("all") * share
    supported = cut(counted.filter(F.col("token") != PAGE).join(whole, "host").filter(enough))
    # The frame: tags that no page holds twice.
    frame = F.collect_set(F.when((F.col("kind") == TAG) & (F.col("most") == 1), F.col("token"))).alias("frame")
    outlines = supported.groupBy("host").agg(frame, F.collect_set(F.when(F.col("kind") == END, F.col("token"))).alias("ends"))
    placed = cut(_for_hosts(distinct, outlines, supported, broadcast_most).filter("ends IS NOT NULL").select("host", "page", "html", "frame", "ends").mapInArrow(_words, "host long, page long, tokens array<long>, counts array<int>, lengths array<int>, inside array<long>, slots array<long>, chars array<int>"))
    each = placed.select("host", "page", F.explode(F.arrays_zip("tokens", "counts", "inside")).alias("t")).select("host", "page", F.col("t.tokens").alias("token"), F.col("t.counts").alias("n"), F.col("t.inside").alias("slot"))
    vectors = each.groupBy("host", "token", "slot").agg(F.count("*").alias("pages"), vector).join(whole, "host").filter(enough & (F.col("pages") >= least_pages))
    classes = cut(vectors.select("host", "token", "slot", F.xxhash64("slot", "class").alias("class")))
    lists = classes.groupBy("host").agg(F.collect_list(F.struct("token", "class")).alias("c")).select("host", F.col("c.token").alias("known"), F.col("c.class").alias("classes"))
    orders = _for_hosts(placed.select("host", "tokens"), lists, classes, broadcast_most).select("host", "tokens", "known", "classes").mapInArrow(_orders, "host long, class long, order long")
    valid = orders.groupBy("host", "class").agg(F.min("order").alias("low"), F.max("order").alias("high")).filter("low = high").select("host", "class")
    made = cut(classes.join(valid, ["host", "class"]).select("host", "token", "slot"))
    # Slot text: the characters of a slot less those of its template words.
    held = placed.select("host", F.explode(F.arrays_zip("slots", "chars")).alias("s")).groupBy("host", F.col("s.slots").alias("slot")).agg(F.sum("s.chars").alias("chars"))
    words = placed.select("host", F.explode(F.arrays_zip("tokens", "counts", "lengths")).alias("t")).select("host", F.col("t.tokens").alias("token"), (F.col("t.counts") * F.col("t.lengths")).alias("known"))
    taken = words.groupBy("host", "token").agg(F.sum("known").alias("known")).join(made, ["host", "token"]).groupBy("host", "slot").agg(F.sum("known").alias("known"))
    slots = cut(held.join(taken, ["host", "slot"], "left").withColumn("data", F.greatest(F.col("chars") - F.coalesce("known", F.lit(0)), F.lit(0))))
    best = slots.groupBy("host").agg(F.max(F.struct("data", "slot")).alias("b"), F.sum("data").alias("sum")).filter("2 * b.data >= sum AND b.data > 0").select("host", F.col("b.slot").alias("slot"))
    # A slot with hardly any slot text holds copies of one article rather than a template.
    copies = slots.filter(F.col("data") < SLOT_SHARE * F.col("chars")).select("host", "slot")
    tokens = cut(made.join(copies, ["host", "slot"], "left_anti").select("host", "token"))
    out = outlines.select("host", "ends").join(tokens.groupBy("host").agg(F.collect_set("token").alias("words")), "host", "left").join(best, "host", "left")
    return cut(out.select("host", "words", "ends", "slot")), supported.select("host", "token").unionByName(tokens)


def _extract(batches):
    templates, known = Known(), Known()
    for batch in batches:
        hosts = batch.column(2).to_pylist()
        found = []
        for source, words, ends, slot in zip(batch.column(3).to_pylist(), templates.of(hosts, batch.column(4)), known.of(hosts, batch.column(5)), batch.column(6).to_pylist(), strict=True):
            found.append(article(*parse(source), words, ends, slot))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array([t for t, _ in found], pa.string()), pa.array(np.array([len(t) for t, _ in found], np.int64)), pa.array(np.array([n for _, n in found], np.int64))], ["page_id", "url", "text", "n_chars", "n_template"])


def main_text(pages: DataFrame, least_pages: int = 3, share: float = 0.5, broadcast_most: int = BROADCAST_MOST) -> DataFrame:
    """page_id, url, text, n_chars (code points) and n_template (characters left out as template) of every row of ``pages``.

    Character references are decoded, white space inside a block is one space, blocks are joined in page order by one
    newline. Null or empty html, or a page without an article: empty text. Null url: the pages without host form one. Repeated
    rows are repeated in the result. Extra columns are not read. An empty table gives no rows. Broken or cut markup is read
    as browsers do, whatever its depth and length, in linear time; a page has to fit in a task some 20 times.

    A host's pages are counted where they lie, so a host with a third of all pages is no task of its own.
    """
    name = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.xxhash64(name).alias("host"))
    made, tokens = templates(rows.select("host", F.xxhash64("html").alias("page"), "html"), least_pages, share, broadcast_most)
    kinds = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long, n_template long"
    return _for_hosts(rows, made, tokens, broadcast_most).select("page_id", "url", "host", "html", "words", "ends", "slot").mapInArrow(_extract, kinds)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
