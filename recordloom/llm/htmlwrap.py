"""Main text of web pages by wrappers inferred from the pages of a host.

A page is a token stream of tags and texts, nested by its tags. A wrapper is a union-free regular expression
over such tokens: sequences with optional groups, repeated groups and text slots. It is inferred by aligning
one page after another of a host with the wrapper so far: equal tokens stay, tokens of one side become optional,
equal groups that follow one another become a repeated group, and differing texts a slot. A wrapper tells
where the variable text of a host's pages lies; the page's own tokens of that place, without boilerplate groups and
without texts that are the same on all pages and lie before or after all that varies, are its main text.

Scale. Every page of every host is aligned. Pages of a host whose tokens nest alike (a skeleton) align item by item,
which has one result in any order, so they are folded in the tasks that read them. What differs is aligned in a tree
that depends on the wrappers alone, in groups of about FAN_IN: neither the order of the pages nor their partitions
change a wrapper, and a host with a third of all pages is no single task. Only a short rule for each host meets the
pages again.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm import textbatch as tb
from recordloom.llm.common import dealt, hot_keys, materialize

FAN_IN = 32  # wrappers merged in one group
WIDE = 64  # items of a level before it becomes one repeated group of optional items
MANY_KEYS = 256  # different keys of such a group before they are told apart by their tags alone
WRAPPERS_HELD = 500  # wrappers, or rules, a task holds before it hands them on, or forgets them
DEEP = 60  # levels of nesting that a wrapper tells apart; pages are read to any depth
BROADCAST_HOSTS = 20_000  # rules (under 1 KB each, on average) up to which they travel to the tasks; beyond, a join by host

# HTML element groups.
RAW = frozenset("script style noscript template iframe textarea title svg math object canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
SKIPPED = frozenset("nav footer aside form button select option input label menu dialog head".split()) | RAW
CLOSES_P = BLOCKS - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SAME_LEVEL = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl article section main div".split())
# Words of class, id and role that name what is not the article. The first are plain; the others may also stand
# for a topic, so they count only in names made of such words and of the third group's.
PLAIN = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr nav navbar navigation breadcrumb breadcrumbs "
    "sidebar footer masthead comment comments respond disqus newsletter pagination pager complementary contentinfo searchform".split()
)
AMBIGUOUS = frozenset(
    "promo promotion promoted banner notice notices notification alert menu widget widgets reply replies discussion related recommended recommendations share "
    "sharing social subscribe subscription signup login popup modal overlay copyright disclaimer toolbar search".split()
)
GENERIC = frozenset(
    "site page main global primary secondary top bottom left right section box block container wrapper wrap area list links link posts post articles article items "
    "item bar panel inner outer content module group form field button buttons icon icons stories story news reading row col column message text body the and in of a".split()
)
# Words that make a name tell a state or a layout, such as no-sidebar or comments-open.
STATES = frozenset("no not has with without is open closed show enabled disabled layout template theme".split())
HOLDERS = frozenset({"html", "body", "main", "article"})
CONTROLS = frozenset({"form", "textarea", "input", "button", "select"})
TITLES = frozenset({"h1", "h2", "h3"})
HEADINGS = TITLES | {"h4", "h5", "h6"}
ENDS = HEADINGS | {"p", "li", "pre", "blockquote", "td", "tr"}  # groups that a path does not enter

# A tag ends at its >, or unfinished at the next < outside quotes, so no part of a page is looked at for many tags.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)>?", re.S)
_UNFINISHED = re.compile(r"<!--.*|<[!?].*|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*+)()()()", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


class Node:
    """An element of a page: its key, its tag, what marks it as no part of the article (NONE to ALWAYS), whether that holds
    (``skip``), and its children (nodes and strings)."""

    __slots__ = ("key", "tag", "mark", "skip", "children")

    def __init__(self, key: str, tag: str, mark: int):
        self.key, self.tag, self.mark, self.skip, self.children = key, tag, mark, False, []


NONE, WEAK, STRONG, ALWAYS = 0, 1, 2, 3


def _marked(name: str, words: list[str]) -> int:
    """What one name of a class, id or role says: whether it marks its element as no part of the article."""
    found = set(words)
    if found & STATES or not found & (PLAIN | AMBIGUOUS):
        return NONE
    whole = found <= PLAIN | AMBIGUOUS | GENERIC
    if found & PLAIN:
        return STRONG if whole or name != "id" else NONE
    return WEAK if whole else NONE


def _open(tag: str, rest: str) -> Node:
    words: list[str] = []
    mark = ALWAYS if tag in SKIPPED and tag != "form" else STRONG if tag == "form" else NONE
    for name, a, b, c in _ATTRIBUTE.findall(rest) if "=" in rest or "hidden" in rest else ():
        value, name = a or b or c, name.lower()
        if name in ("class", "id", "role"):
            names = [[w for w in re.split(r"[^a-z]+", x.lower()) if w] for x in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).split()]
            found = [w for x in names for w in x]
            words += found if len(found) <= 4 else [*found[:4], f"{zlib.crc32('.'.join(found).encode()):x}"]
            mark = max([mark, *(_marked(name, x) for x in names)])
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            mark = ALWAYS
    return Node(".".join([tag, *words]), tag, NONE if tag in HOLDERS else mark)


class _Held:
    """What a subtree holds: characters of text, those of them in links, and whether an article or main, a title, and a control."""

    __slots__ = ("chars", "linked", "article", "title", "control")

    def __init__(self) -> None:
        self.chars, self.linked, self.article, self.title, self.control = 0, 0, False, False, False


def settle(root: Node) -> Node:
    """Decide which marked elements are skipped.

    Names alone never skip an element around an article, a main or the page's title, nor a form around more than half of the
    page's text. Within an article or main, a name that may be a topic skips only what holds links or controls for the most part.
    """
    held: dict[int, _Held] = {}
    left: list[tuple[Node, bool]] = [(root, False)]
    while left:
        node, done = left.pop()
        if not done:
            left.append((node, True))
            left += [(c, False) for c in node.children if isinstance(c, Node) and c.mark != ALWAYS]
            continue
        own = held[id(node)] = _Held()
        for c in node.children:
            if isinstance(c, str):
                own.chars += len(c) - c.count(" ") if not c.isspace() else 0
            elif c.mark == ALWAYS:
                own.control = own.control or c.tag in CONTROLS
            else:
                x = held[id(c)]
                own.chars, own.linked = own.chars + x.chars, own.linked + x.linked
                own.article, own.title, own.control = own.article or x.article, own.title or x.title, own.control or x.control
        if node.tag == "a":
            own.linked = own.chars
        own.article, own.title, own.control = own.article or node.tag in ("article", "main"), own.title or node.tag == "h1", own.control or node.tag in CONTROLS
    whole = held[id(root)]
    walk: list[tuple[Node, bool]] = [(root, False)]
    while walk:
        node, inside = walk.pop()
        if node.mark == ALWAYS:
            node.skip = True
        elif node.mark:
            x = held[id(node)]
            around = x.article or (x.title and not inside) or (node.tag == "form" and 2 * x.chars > whole.chars)
            node.skip = not around and (node.mark == STRONG or not inside or 2 * x.linked > x.chars or x.control)
        if not node.skip:
            inside = inside or node.tag in ("article", "main")
            walk += [(c, inside) for c in node.children if isinstance(c, Node)]
    return root


def parse(page: str) -> Node:
    """The page's tokens, nested by their tags; unclosed and stray tags are mended as browsers do."""
    root = Node("", "", NONE)
    stack = [root]
    opened: Counter[str] = Counter()  # elements of the stack by tag, so a tag that is not open costs no walk
    at, last = 0, page.rfind(">")
    while True:
        m = (_TOKEN if at <= last else _UNFINISHED).search(page, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    _pop(stack, k, opened)
                    break
                if stack[k].tag in ("table", "td") and tag not in ("table", "tr", "tbody", "thead", "body", "html"):
                    break
            continue
        if tag in CLOSES_P:
            _close(stack, {"p"}, opened)
            if tag in HEADINGS:
                _close(stack, HEADINGS, opened)
        if tag in SAME_LEVEL:
            _close(stack, SAME_LEVEL[tag], opened)
        node = _open(tag, m[3] or m[6] or "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^<>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if at < len(page):
        stack[-1].children.append(page[at:])
    return settle(root)


def _pop(stack: list[Node], first: int, opened: Counter[str]) -> None:
    for node in stack[first:]:
        opened[node.tag] -= 1
    del stack[first:]


def _close(stack: list[Node], tags: frozenset[str] | set[str], opened: Counter[str]) -> None:
    for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in tags) else ():
        if stack[k].tag in tags:
            _pop(stack, k, opened)
            return
        if stack[k].tag in SCOPES:
            return


# A wrapper item is a list [key, mode, pages, constant, chars, items]: mode 0 once, 1 optional, 2 repeated;
# constant is the checksum of a text that is the same on all pages so far, 0 for a slot; a text's key is '#'.
ONCE, OPTIONAL, REPEATED = 0, 1, 2


def items_of(node: Node, linked: bool = False, depth: int = 0) -> list[list]:
    """Wrapper items of one page's children; boilerplate groups stay as tokens without contents.

    What lies deeper than DEEP levels is one text of its group: a path ends above it, and it is read whole.
    """
    out: list[list] = []
    if depth >= DEEP:
        return _texts_as_one([_text_item(x, link) for x, link in _deep_texts(node, linked) if not x.isspace()])
    for child in node.children:
        if isinstance(child, str):
            if not child.isspace():
                out.append(_text_item(child, linked))
        elif not child.skip:
            own = items_of(child, linked or child.tag == "a", depth + 1)
            if child.tag in BLOCKS:
                out.append([child.key, ONCE, 1, 0, 0, own])
            else:  # inline markup is part of the text around it
                out += own
        else:
            out.append([child.key, ONCE, 1, 0, 0, []])
    return _narrow(fold_repeats(out))


def skeleton_of(items: list[list]) -> str:
    """A digest of how keys nest, whatever the texts."""
    left: list[list | None] = [*reversed(items)]
    told = hashlib.blake2b(digest_size=12)
    while left:
        item = left.pop()
        told.update(f"{item[0]}<".encode() if item else b">")
        if item:
            left += [None, *reversed(item[5])]
    return told.hexdigest()


def _narrow(items: list[list]) -> list[list]:
    """A level of more than WIDE items as one repeated group with an item for each key; of more than MANY_KEYS keys, for each
    tag (``tag.*`` stands for all keys of the tag), so a wrapper's size is bounded and no item is lost."""
    if len(items) <= WIDE:
        return items
    general = len({x[0] for x in items}) > MANY_KEYS
    by_key: dict[str, list] = {}
    for item in items:
        key = item[0]
        if general and key != "#":
            tag = key.split(".")[0]
            key = f"{tag}.*" if tag in BLOCKS else ".*"
        item[0], item[1] = key, REPEATED
        if key in by_key:
            merge_into(by_key[key], item)
        else:
            by_key[key] = item
    return list(by_key.values())


def _text_item(text: str, linked: bool) -> list:
    words = " ".join(text.split())
    return ["#", ONCE, 1, zlib.crc32(words.encode("utf-8", "replace")) or 1, 0 if linked else len(words), []]


def _deep_texts(node: Node, linked: bool) -> Iterator[tuple[str, bool]]:
    """The texts of a subtree outside boilerplate groups, and whether they are links."""
    left: list[tuple[Node | str, bool]] = [(c, linked) for c in reversed(node.children)]
    while left:
        child, link = left.pop()
        if isinstance(child, str):
            yield child, link
        elif not child.skip and child.tag != "header":
            left += [(c, link or child.tag == "a") for c in reversed(child.children)]


def _texts_as_one(items: list[list]) -> list[list]:
    out: list[list] = []
    for item in items:
        if item[0] == "#" and out and out[-1][0] == "#":
            last = out[-1]
            last[3] = zlib.crc32(f"{last[3]} {item[3]}".encode()) if last[3] and item[3] else 0
            last[4] += item[4]
        else:
            out.append(item)
    return out


def fold_repeats(items: list[list]) -> list[list]:
    """Items with every run of equal groups as one repeated group; groups of up to half of WIDE items are looked for."""
    items = _texts_as_one(items)
    for width in range(1, WIDE // 2 + 1):
        if 2 * width > len(items):
            break
        out: list[list] = []
        k = 0
        while k < len(items):
            if k + width >= len(items) or items[k][0] != items[k + width][0]:
                out.append(items[k])
                k += 1
                continue
            group = items[k : k + width]
            times = 1
            while len(group) == width and [x[0] for x in items[k + times * width : k + (times + 1) * width]] == [x[0] for x in group]:
                for mine, more in zip(group, items[k + times * width : k + (times + 1) * width], strict=True):
                    merge_into(mine, more)
                times += 1
            if times > 1:
                for item in group:
                    item[1] = REPEATED
                out += group
                k += times * width
            else:
                out.append(items[k])
                k += 1
        items = out
    return items


def merge_into(mine: list, other: list) -> None:
    """Make ``mine`` match what ``other`` matches too. Both have one key."""
    mine[1] = max(mine[1], other[1])
    mine[2] += other[2]
    mine[3] = mine[3] if mine[3] == other[3] else 0
    mine[4] += other[4]
    mine[5] = align(mine[5], other[5])


def align(a: list[list], b: list[list]) -> list[list]:
    """Align two item lists by their longest common subsequence; what only one has becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        for mine, other in zip(a, b, strict=True):
            merge_into(mine, other)
        return a
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out: list[list] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i][0] == b[j][0]:
            merge_into(a[i], b[j])
            out.append(a[i])
            i, j = i + 1, j + 1
        elif j == len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            a[i][1] = max(a[i][1], OPTIONAL)
            out.append(a[i])
            i += 1
        else:
            b[j][1] = max(b[j][1], OPTIONAL)
            out.append(b[j])
            j += 1
    return _narrow(fold_repeats(out))


def rule_of(wrapper: list[list]) -> dict:
    """Where the variable text lies: the smallest subtree with all of it, as the keys of each level of its path, and the
    checksums of the host's own texts there.

    A level's articles or mains stand for the level. Otherwise the path goes on only while a single group of the
    level holds variable text and no heading stands beside it.
    """
    path: list[list[str]] = []
    items, varying = wrapper, _varies(wrapper)
    while items:
        named = [x for x in items if x[0].split(".")[0] in ("article", "main") and _holds(x, varying)]
        live = named or [x for x in items if _holds(x, varying) or x[0].split(".")[0] in HEADINGS and _holds(x, False)]
        keys = list(dict.fromkeys(x[0] for x in live))
        tags = {k.split(".")[0] for k in keys}
        if not named and (len(keys) != 1 or keys == ["#"] or not tags <= BLOCKS - ENDS):
            break
        path.append(keys)
        items = [y for x in live for y in x[5]]
        if "article" in tags or len(live) > 1:
            break
    return {"path": path, "constant": _own_of_host(items) if _varies(items) else []}


def _varies(items: list[list]) -> bool:
    return any((x[0] == "#" and not x[3]) or _varies(x[5]) for x in items)


def _holds(item: list, varying: bool, linked: bool = False) -> bool:
    """Whether an item that may be read holds text outside links, variable text if ``varying``; a heading's links count."""
    tag = item[0].split(".")[0]
    if tag == "#":
        return bool((item[4] or linked) and not (varying and item[3]))
    return tag != "header" and any(_holds(x, varying, linked or tag in HEADINGS) for x in item[5])


def _own_of_host(items: list[list]) -> list[int]:
    """Checksums of the texts that stand once on every page before or after all variable texts and headings of a place."""
    live = [k for k, x in enumerate(items) if _holds(x, True) or x[0].split(".")[0] in HEADINGS]
    edge = [*items[: live[0]], *items[live[-1] + 1 :]] if live else []
    return [c for x in edge for c in _fixed_texts(x)]


def _fixed_texts(item: list) -> list[int]:
    if item[1] != ONCE or item[2] < 2:
        return []
    return [item[3]] if item[0] == "#" and item[3] else [c for x in item[5] for c in _fixed_texts(x)]


def _children(places: list[Node], keys: list[str]) -> list[Node]:
    return [c for p in places for c in p.children if isinstance(c, Node) and not c.skip and (c.key in keys or f"{c.tag}.*" in keys)]


def extract(page: str, rule: dict | None) -> str:
    """The page's main text by its host's rule, or by its own tokens if the rule's place is not there."""
    root = parse(page)
    places = [root]
    for keys in (rule or {}).get("path", []):
        places = _children(places, keys)
    if not places or (places == [root]):
        own = rule_of(items_of(root))["path"]
        places = [root]
        for keys in own:
            places = _children(places, keys)
    constant = set((rule or {}).get("constant", ()))
    blocks: list[str] = []
    for place in places:
        run: list[str] = []
        _read(place, run, blocks, constant)
        _flush(run, blocks, constant)
    return "\n\n".join(blocks)


def _flush(run: list[str], blocks: list[str], constant: set[int]) -> None:
    words = " ".join(html_lib.unescape("".join(run)).split())
    if words and (not constant or (zlib.crc32(" ".join("".join(run).split()).encode("utf-8", "replace")) or 1) not in constant):
        blocks.append(words)
    run.clear()


def _has_title(node: Node) -> bool:
    left = [node]
    while left:
        for c in left.pop().children:
            if isinstance(c, Node):
                if c.tag in TITLES:
                    return True
                left.append(c)
    return False


def _read(node: Node, run: list[str], blocks: list[str], constant: set[int]) -> None:
    left: list[tuple[Node, Iterator[Node | str]]] = [(node, iter(node.children))]
    while left:
        parent, children = left[-1]
        child = next(children, None)
        if child is None:
            left.pop()
            if left and parent.tag in BLOCKS:
                _flush(run, blocks, constant)
        elif isinstance(child, str):
            run.append(child)
        elif child.tag == "br":
            run.append(" ")
        elif child.skip or (child.tag == "header" and not (parent.tag == "article" and _has_title(child))):
            if child.tag in BLOCKS:
                _flush(run, blocks, constant)
        else:
            if child.tag in BLOCKS:
                _flush(run, blocks, constant)
            left.append((child, iter(child.children)))


def host_of(url):
    """Host of a URL column, lower case, without port; '' if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))


def wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper``: one wrapper for each host, aligned with all its pages, whatever their order and partitions."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def hand_on() -> pa.RecordBatch:
            rows = [(host, skeleton, json.dumps(w)) for (host, skeleton), w in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["host", "skeleton", "wrapper"])

        for whole in batches:
            for batch in tb.pieces(whole, "html"):
                for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                    items = items_of(parse(page or ""))
                    key = host, skeleton_of(items)
                    if key not in held and len(held) >= WRAPPERS_HELD:
                        yield hand_on()
                    held[key] = align(held[key], items) if key in held else items
        yield hand_on()

    found = materialize(pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(fold, "host string, skeleton string, wrapper string"))
    # Wrappers of one skeleton may be merged in any order, so equal ones are dealt by their rows.
    alike = _merged(found, "skeleton", F.xxhash64("wrapper", F.monotonically_increasing_id()))
    return _merged(alike.select("host", F.lit("").alias("skeleton"), "wrapper"), "skeleton", F.xxhash64("wrapper")).select("host", "wrapper")


def _merged(found: DataFrame, within: str, place: Column) -> DataFrame:
    """One wrapper for each host and value of ``within``, merged in rounds of groups of about FAN_IN, dealt by ``place``."""

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for text in sorted(pdf["wrapper"]):
            items = json.loads(text)
            whole = items if whole is None else align(whole, items)
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], within: [pdf[within].iloc[0]], "wrapper": [json.dumps(whole)]})

    while True:
        sizes = found.groupBy("host", within).agg(F.count("*").alias("size"))
        if sizes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0] <= 1:
            return found
        # Keys of a hot table are numbers, so its bound on rows is one on bytes; two groups of one number are only dealt alike.
        hot = hot_keys(sizes.groupBy(F.xxhash64("host", within).alias("_group")).agg(F.max("size").alias("size")), "_group", FAN_IN)
        told = found.withColumn("_group", F.xxhash64("host", within)).withColumn("_place", place)
        parts = dealt(told, "_group", "_place", hot).groupBy("host", within, "_chunk")
        found = materialize(parts.applyInPandas(combine, f"host string, {within} string, wrapper string"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``; ``text`` is empty if a page has none.

    Null html is an empty page; a null url belongs to the host ''. Repeated rows get equal results; an empty
    table gives no rows. White space of a block becomes one space, blocks are joined by an empty line.
    """
    def ruled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rules = [json.dumps(rule_of(json.loads(x))) for x in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_pydict({"host": batch.column("host"), "rule": pa.array(rules, pa.string())})

    rules = materialize(wrappers(pages).select("host", "wrapper").mapInArrow(ruled, "host string, rule string"))
    n, size = rules.agg(F.count("*"), F.coalesce(F.sum(F.length("rule")), F.lit(0))).first()
    small = n <= BROADCAST_HOSTS and size <= BROADCAST_HOSTS * 1000
    with_host = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host_of(F.col("url")).alias("host"))
    joined = with_host.join(F.broadcast(rules) if small else rules, "host", "left").select("page_id", "url", "html", "rule")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, dict | None] = {None: None}
        for whole in batches:
            for batch in tb.pieces(whole, "html"):
                out = []
                for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True):
                    if rule not in known:
                        if len(known) > WRAPPERS_HELD:
                            known = {None: None}
                        known[rule] = json.loads(rule)
                    out.append(extract(page or "", known[rule]))
                yield pa.RecordBatch.from_pydict(
                    {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string()), "n_chars": pa.array([len(x) for x in out], pa.int64())}
                )

    return joined.mapInArrow(read, "page_id long, url string, text string, n_chars long")
