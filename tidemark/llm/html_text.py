"""Main text of web pages by wrapper induction (operator 9).

Pages become DOM trees, less what is no article by its tag or class. Trees of one host are aligned by
simple tree matching into a wrapper that counts, per slot, the pages and the texts seen there. A slot
with one text on nearly all pages is template; slots whose text varies are content. A page's text is
that of its content slots. What a page marks as its article is content even where it is constant.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SLICE_ROWS, add_columns, lookup, stored

# A slot is template if at least this many pages have it and this share of them the same text.
TEMPLATE_PAGES = 5
TEMPLATE_SHARE = 0.8
# Texts held per slot, and per slot that repeats on a page; more where one page has more than half as
# many. They only name candidates: what their counts leave open is counted exactly.
SLOT_TEXTS, REPEAT_TEXTS = 4, 128
PARTS = 32
# Levels of a tree that a wrapper holds; what lies deeper is content as its outermost node is.
DEPTH = 100
# A block outside an article whose letters are links to this share is a menu.
LINK_SHARE = 0.8

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")

# Kinds of elements.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe noembed noframes xmp template".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
NO_CONTENT = set(
    "nav aside form button select input textarea fieldset script style noscript template head svg canvas iframe object "
    "embed audio video dialog menu option datalist noembed noframes".split()
)
ROOTS = {"article", "main"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
NO_CONTENT_NAMES = set(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices alert popup modal newsletter subscribe subscription signup login sidebar widget widgets menu "
    "nav navbar navigation breadcrumb breadcrumbs pagination pager toc share sharing social related recommended comment "
    "comments disqus respond reply replies footer masthead copyright skip search".split()
)
NO_CONTENT_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar".split())


class Node:
    """An element: its tag, a label of tag and classes, its parts in order, and whether it was dropped."""

    __slots__ = ("tag", "label", "parts", "names", "hidden", "role", "template")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.parts, self.hidden, self.role, self.template = tag, [], False, "", False
        names: list[str] = []
        if attributes.strip(" /"):
            for match in ATTRIBUTE.finditer(attributes):
                name, value = match[1].lower(), match[2] or match[3] or match[4] or ""
                if name in ("class", "id"):
                    names += re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())
                elif name == "role":
                    self.role = value.strip().lower()
                elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
                    self.hidden = True
                elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.IGNORECASE):
                    self.hidden = True
        self.names = [name for name in names if name]
        self.label = ".".join([tag, *sorted(set(self.names))[:4]])


def parse(source: str) -> Node:
    """The DOM tree of a page; whatever is malformed, every text ends up somewhere in it."""
    root = Node("#root")
    open_nodes, at = [root], 0
    open_tags: Counter[str] = Counter()

    def close(tags: set[str], limits: set[str]) -> None:
        if not any(open_tags[tag] for tag in tags):
            return
        for i in range(len(open_nodes) - 1, 0, -1):
            if open_nodes[i].tag in tags:
                open_tags.subtract(node.tag for node in open_nodes[i:])
                del open_nodes[i:]
                return
            if open_nodes[i].tag in limits or open_nodes[i].tag in ROOTS:
                return

    def text(value: str) -> None:
        if value:
            open_nodes[-1].parts.append(html.unescape(value) if "&" in value else value)

    match = TOKEN.search(source, at)
    while match:
        text(source[at : match.start()])
        at = match.end()
        if match[2]:
            tag = match[2].lower()
            if match[1]:
                if open_tags[tag] > 0:
                    while True:
                        closed = open_nodes.pop().tag
                        open_tags[closed] -= 1
                        if closed == tag:
                            break
            else:
                if tag in CLOSES:
                    close(*CLOSES[tag])
                elif tag not in INLINE and tag not in VOID:
                    close({"p"}, {"div", "section", "td", "li", "blockquote", "body"})
                node = Node(tag, match[3])
                open_nodes[-1].parts.append(node)
                if tag in RAW:
                    end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(source, at)
                    at = end.end() if end else len(source)
                elif tag not in VOID and not match[3].endswith("/"):
                    open_nodes.append(node)
                    open_tags[tag] += 1
        match = TOKEN.search(source, at)
    text(source[at:])
    return root


def has_root(node: Node) -> bool:
    stack = [node]
    while stack:
        at = stack.pop()
        if at.tag in ROOTS or at.role == "main":
            return True
        stack += [part for part in at.parts if isinstance(part, Node)]
    return False


def drop_other(root: Node) -> None:
    """Take out what is no article by tag, role, class or id, whole elements at a time."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ROOTS
        kept = []
        for part in node.parts:
            if isinstance(part, Node):
                named = part.role in NO_CONTENT_ROLES or not NO_CONTENT_NAMES.isdisjoint(part.names)
                outer = part.tag == "footer" or (part.tag == "header" and not inside)
                if part.tag in NO_CONTENT or part.hidden or outer:
                    continue
                # A class name on a frame around the article says nothing about the article.
                if named and part.tag not in ("html", "body") and (inside or part.tag in ROOTS or not has_root(part)):
                    continue
                stack.append((part, inside))
            kept.append(part)
        node.parts = kept


def article_roots(root: Node) -> list[Node]:
    """The outermost articles, or else main parts, of a page."""
    for wanted in ("article", "main"):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag == wanted or (wanted == "main" and node.role == "main"):
                found.append(node)
            else:
                stack += [part for part in reversed(node.parts) if isinstance(part, Node)]
        if found:
            return found
    return []


def blocks(root: Node, links_out: bool) -> list[str]:
    """Texts of the blocks below ``root`` in page order, white space made one space, template left out."""
    out: list[str] = []
    current: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        value = SPACE.sub(" ", "".join(current)).strip()
        if value and not (links_out and linked >= LINK_SHARE * len(value)):
            out.append(value)
        current.clear()
        linked = 0

    stack: list[tuple[object, bool, bool]] = [(root, False, False)]
    while stack:
        part, in_link, closing = stack.pop()
        if isinstance(part, str):
            current.append(part)
            linked += len(part.strip()) if in_link else 0
        elif closing:
            flush()
        elif not part.template:
            if part.tag == "br":
                current.append(" ")
            block = part.tag not in INLINE
            if block:
                flush()
                stack.append((part, in_link, True))
            stack += [(child, in_link or part.tag == "a", False) for child in reversed(part.parts)]
    flush()
    return out


def own_text(node: Node) -> str:
    """Text of a node and its inline parts, without its blocks."""
    found, stack = [], list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, str):
            found.append(part)
        elif part.tag in INLINE:
            stack += reversed(part.parts)
    return SPACE.sub(" ", "".join(found)).strip()


def text_key(value: str) -> str:
    return hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest() if value else ""


class Slot:
    """A node of a wrapper: pages that have it, on how many which text was seen, and its slots in order.

    Neighbours with one label are one slot that repeats, with the texts of all of them. In the slots of a
    page ``nodes`` holds its nodes, each with the key of its text ("" if it has blocks below). A text was
    seen on at least as many pages as its count in ``texts`` says, and on at most ``off`` more; ``most``
    is the most texts of one page.
    """

    __slots__ = ("label", "pages", "texts", "repeats", "slots", "nodes", "off", "most")

    def __init__(self, label: str, pages: int = 1) -> None:
        self.label, self.pages, self.texts, self.repeats, self.slots = label, pages, {}, False, []
        self.nodes: list[tuple[Node, str]] = []
        self.off, self.most = 0, 0

    def to_list(self) -> list:
        return [self.label, self.pages, self.texts, self.repeats, [slot.to_list() for slot in self.slots], self.off, self.most]

    @classmethod
    def from_list(cls, values: list) -> Slot:
        slot = cls(values[0], values[1])
        slot.texts, slot.repeats, slot.slots = values[2], values[3], [cls.from_list(value) for value in values[4]]
        slot.off, slot.most = values[5:]
        return slot

    def in_order(self) -> list[Slot]:
        """The slot and all below, outer ones first; a place in this list names a slot of a wrapper."""
        return [self, *(slot for below in self.slots for slot in below.in_order())]

    def is_open(self, key: str) -> bool:
        """Whether the counts do not tell if a text is template."""
        least = TEMPLATE_SHARE * self.pages
        count = self.texts.get(key, 0)
        return self.pages >= TEMPLATE_PAGES and count < least <= count + self.off


def skeleton(node: Node, depth: int = DEPTH) -> Slot:
    """The slots of one page; a marked article is one slot, as all of it is content."""
    slot = Slot(node.label)
    if node.tag in ROOTS or node.role == "main" or depth == 0:
        return slot
    blocks_below = []
    stack = list(reversed(node.parts))
    while stack:
        part = stack.pop()
        if isinstance(part, Node):
            if part.tag in INLINE:
                stack += reversed(part.parts)
            else:
                blocks_below.append(part)
    for part in blocks_below:
        made = skeleton(part, depth - 1)
        if slot.slots and slot.slots[-1].label == made.label:
            merge(slot.slots[-1], made, same_page=True)
        else:
            slot.slots.append(made)
    key = "" if blocks_below else text_key(own_text(node))
    slot.nodes = [(node, key)]
    slot.texts = {key: 1} if key else {}
    slot.most = len(slot.texts)
    return slot


def match_slots(left: list[Slot], right: list[Slot]) -> list[tuple[int, int]]:
    """Pairs of the best order-preserving matching, by the size of the matched trees (simple tree matching)."""
    if [slot.label for slot in left] == [slot.label for slot in right]:
        return [(i, i) for i in range(len(left))]
    m, n = len(left), len(right)
    best = [[0] * (n + 1) for _ in range(m + 1)]
    weight = [[matched(a, b) for b in right] for a in left]
    for i in range(m):
        for j in range(n):
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + weight[i][j])
    pairs, i, j = [], m, n
    while i and j:
        if weight[i - 1][j - 1] and best[i][j] == best[i - 1][j - 1] + weight[i - 1][j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return pairs[::-1]


def matched(a: Slot, b: Slot) -> int:
    """Slots in the best common tree of two slots; 0 if their labels differ."""
    if a.label != b.label:
        return 0
    return 1 + sum(matched(a.slots[i], b.slots[j]) for i, j in match_slots(a.slots, b.slots))


def count_texts(texts: dict[str, int], limit: int) -> tuple[dict[str, int], int]:
    """At most ``limit`` texts: a rarer one lowers the others' counts, so frequent ones always stay; and by how much."""
    if len(texts) <= limit:
        return texts, 0
    off = sorted(texts.values(), reverse=True)[limit]
    return {key: count - off for key, count in texts.items() if count > off}, off


def merge(into: Slot, other: Slot, same_page: bool = False) -> None:
    """Add the pages of ``other`` to a wrapper; with ``same_page`` they are repeats on one page.

    A page adds at most ``most`` texts and lowering counts by one takes out more than twice as many, so
    ``off`` stays below half of the pages and no text of four fifths of them is ever left out.
    """
    into.repeats = into.repeats or other.repeats or same_page
    if same_page:
        into.nodes += other.nodes
        into.texts.update(dict.fromkeys(other.texts, 1))
        into.most = len(into.texts)
    else:
        into.pages += other.pages
        for key, count in other.texts.items():
            into.texts[key] = into.texts.get(key, 0) + count
        into.most = max(into.most, other.most)
        limit = max(REPEAT_TEXTS if into.repeats else SLOT_TEXTS, 2 * into.most)
        off = 0
        if len(into.texts) > 2 * limit:
            into.texts, off = count_texts(into.texts, limit)
        into.off += other.off + off
    pairs = match_slots(into.slots, other.slots)
    new, done = [], 0
    at = 0
    for i, j in [*pairs, (len(into.slots), len(other.slots))]:
        new += into.slots[at:i] + other.slots[done:j]
        if i < len(into.slots) and j < len(other.slots):
            merge(into.slots[i], other.slots[j], same_page)
            new.append(into.slots[i])
        at, done = i + 1, j + 1
    into.slots = new


def page_tree(source: str) -> tuple[Node, list[Node]]:
    root = parse(source)
    drop_other(root)
    return root, article_roots(root)


def mark_template(page: Slot, wrapper: Slot) -> None:
    """Align a page with its host's wrapper and mark the nodes that show a template text."""
    if wrapper.pages >= TEMPLATE_PAGES:
        for node, key in page.nodes:
            node.template = wrapper.texts.get(key, 0) >= TEMPLATE_SHARE * wrapper.pages
    for i, j in match_slots(page.slots, wrapper.slots):
        mark_template(page.slots[i], wrapper.slots[j])


def open_texts(page: Slot, wrapper: Slot, places: dict[int, int]) -> Iterator[tuple[int, str, int]]:
    """(slot, text, pages of the slot) of the texts of a page that the wrapper's counts leave open, each once."""
    for key in sorted({key for _, key in page.nodes if key}):
        if wrapper.is_open(key):
            yield places[id(wrapper)], key, wrapper.pages
    for i, j in match_slots(page.slots, wrapper.slots):
        yield from open_texts(page.slots[i], wrapper.slots[j], places)


def load_wrapper(wrapper: str, template: str | None) -> Slot:
    """A stored wrapper, with the texts that the exact count found to be template."""
    root = Slot.from_list(json.loads(wrapper))
    if template:
        slots = root.in_order()
        for mark in json.loads(template):
            slots[mark["slot"]].texts[mark["text"]] = slots[mark["slot"]].pages
    return root


def page_text(source: str | None, wrapper: Slot | None) -> str:
    """The article's blocks, joined by line feeds; without a marked article all content slots of the page."""
    if not source:
        return ""
    root, roots = page_tree(source)
    if wrapper is not None:
        mark_template(skeleton(root), wrapper)
    return "\n".join(block for node in (roots or [root]) for block in blocks(node, links_out=not roots))


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, uses, open): the wrapper of every host with two pages or more, and its number of pages.

    It holds the texts that may be template; ``open`` says whether some of them must be counted exactly.

    Every page is merged in. Tasks merge the pages they read; a host's partial wrappers, whose size does
    not grow with the pages, are merged in two steps, so no task gathers the pages of a large host.
    """

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wrappers: dict[str, Slot] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                for row in batch.slice(start, SLICE_ROWS).to_pylist():
                    made = skeleton(page_tree(row["html"])[0])
                    if row["host"] in wrappers:
                        merge(wrappers[row["host"]], made)
                    else:
                        wrappers[row["host"]] = made
            if len(wrappers) > 1000:
                yield rows(wrappers)
                wrappers = {}
        if wrappers:
            yield rows(wrappers)

    def from_partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by host, so one wrapper is held at a time.
        host, wrapper = None, None
        for batch in batches:
            for row in batch.to_pylist():
                other = Slot.from_list(json.loads(row["wrapper"]))
                if wrapper is not None and row["host"] == host:
                    merge(wrapper, other)
                    continue
                if wrapper is not None:
                    yield rows({host: wrapper})
                host, wrapper = row["host"], other
        if wrapper is not None:
            yield rows({host: wrapper})

    def rows(wrappers: dict[str, Slot]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([
            {"host": host, "wrapper": json.dumps(slot.to_list()), "uses": slot.pages} for host, slot in wrappers.items()
        ])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in from_partial(batches):
            for row in batch.to_pylist():
                root = Slot.from_list(json.loads(row["wrapper"]))
                slots = root.in_order()
                for slot in slots:
                    least = max(TEMPLATE_PAGES, TEMPLATE_SHARE * slot.pages)
                    slot.texts = {key: count for key, count in slot.texts.items() if count + slot.off >= least}
                unclear = any(slot.is_open(key) for slot in slots for key in ["", *slot.texts])
                made = {"host": row["host"], "wrapper": json.dumps(root.to_list()), "uses": row["uses"], "open": unclear}
                yield pa.RecordBatch.from_pylist([made])

    schema = "host string, wrapper string, uses bigint"
    found = pages.where("html is not null and host <> ''").select("host", "html").mapInArrow(from_pages, schema)
    part = F.pmod(F.xxhash64("wrapper"), F.lit(PARTS))
    some = found.withColumn("part", part).repartition("host", "part").sortWithinPartitions("host", "wrapper")
    some = some.select("host", "wrapper", "uses").mapInArrow(from_partial, schema)
    one = some.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(finish, f"{schema}, open boolean")
    return one.where("uses > 1")


def count_open(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """(host, template): the texts that are template where the counts of the given wrappers leave it open.

    Every page of these hosts is aligned with its wrapper again, and the pages of each text that is open
    are counted.
    """

    def from_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                known: dict[str, tuple[Slot, dict[int, int]]] = {}
                found: Counter[tuple] = Counter()
                for row in batch.slice(start, SLICE_ROWS).to_pylist():
                    if row["wrapper"] not in known:
                        root = load_wrapper(row["wrapper"], None)
                        known[row["wrapper"]] = root, {id(slot): i for i, slot in enumerate(root.in_order())}
                    page = skeleton(page_tree(row["html"])[0])
                    found.update((row["host"], *values) for values in open_texts(page, *known[row["wrapper"]]))
                if found:
                    columns = zip(*((*key, n) for key, n in found.items()), strict=True)
                    types = (pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64())
                    arrays = [pa.array(column, kind) for column, kind in zip(columns, types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["host", "slot", "text", "pages", "n"])

    some = pages.where("html is not null and host <> ''").select("host", "html")
    some = lookup(some, wrappers.select("host", "wrapper", "uses"), ["host"], "uses").where("wrapper is not null")
    counts = some.mapInArrow(from_pages, "host string, slot int, text string, pages bigint, n bigint")
    counts = counts.groupBy("host", "slot", "text", "pages").agg(F.sum("n").alias("n"))
    template = counts.where(F.col("n") >= F.lit(TEMPLATE_SHARE) * F.col("pages"))
    marks = F.sort_array(F.collect_list(F.struct("slot", "text")))
    return template.groupBy("host").agg(F.to_json(marks).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    A null or empty html, or one without content, gives an empty text. A null url has no host and no
    wrapper: all that is no menu or the like is content. Repeated rows are pages of their own. Other
    columns are not read, so their names cannot clash. An empty table gives an empty result.
    """
    rows = pages.select("page_id", "url", "html", F.coalesce(host_of("url"), F.lit("")).alias("host"))
    wrappers = stored(induce(rows), "wrappers")
    unclear = wrappers.where("open")
    if unclear.isEmpty():
        found = wrappers.withColumn("template", F.lit(None).cast("string"))
    else:
        found = wrappers.join(count_open(rows, unclear), "host", "left")
    with_wrapper = lookup(rows, found.drop("open"), ["host"], "uses")
    paired = with_wrapper.select("page_id", "url", F.struct("html", "wrapper", "template").alias("page"))

    def texts(values: list[dict]) -> dict[str, list]:
        known: dict[tuple, Slot] = {}
        found = []
        for value in values:
            made = value["wrapper"], value["template"]
            if made[0] and made not in known:
                known[made] = load_wrapper(*made)
            found.append(page_text(value["html"], known.get(made)))
        return {"text": found, "n_chars": [len(text) for text in found]}

    return add_columns(paired, "page", texts, "text string, n_chars bigint", ["page_id", "url"])
