"""Main text of web pages by wrappers inferred for each host.

A wrapper is a union-free regular expression over the nested token streams of a host's pages: an element with its class is a
token, text is a slot, and an item may be optional, repeated or both. A page by itself is such an expression, with adjacent equal
items folded into a repeated one and repeating runs of items into a repeated group. Two expressions are aligned by their longest
common subsequence, level by level: what matches is merged, what does not becomes optional, and equal items that
come to lie side by side become a repeated one. So a host's wrapper is the merge of its pages in turn; tasks merge what they
read, and one row a task and host is left to merge after the shuffle, however many pages a host has.

The wrapper of a host says what is main text: a slot whose text never changes while others do is part of the template, and of the
rest the core is the innermost container that holds most of the text that changes, over all pages of the host. Elements and classes are
evidence beside it: a page's article (or main) element with text stands before the core, and menus, headers, footers, sidebars,
notices, adverts, forms and comment sections, by element or by class, are in neither. Reading a page walks it along the wrapper.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.llm.tables import SALTS, slices
from panelcast.llm.url_filters import host_and_path
from panelcast.session import cut_lineage

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select)\b(?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*(?<!/)>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>|</?[a-zA-Z][^<>]*>|<[!?/][^<>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
MAIN = ("article", "main")
SKIPPED = frozenset("nav aside form footer menu dialog button head canvas object".split())
CLOSED = frozenset(SKIPPED) - {"form"}  # skipped also where they hold all there is of main elements
OUTER = frozenset(["header"])  # skipped outside the main element, where it holds no title of the text
#: Words of a class, id or role that tell what is not main text.
HINTS = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie
    cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification
    pager pagination popup promo recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored
    subscribe subscription toolbar widget widgets""".split()
)
CLOSES = {  # an opening tag ends these open elements, up to the nearest of the second set
    **dict.fromkeys(("li",), (frozenset(["li"]), frozenset(["ul", "ol", "menu"]))),
    **dict.fromkeys(("dt", "dd"), (frozenset(["dt", "dd"]), frozenset(["dl"]))),
    **dict.fromkeys(("tr",), (frozenset(["tr", "td", "th"]), frozenset(["table", "thead", "tbody", "tfoot"]))),
    **dict.fromkeys(("td", "th"), (frozenset(["td", "th"]), frozenset(["tr", "table"]))),
}
#: Elements that hold other blocks and say nothing about them. One that holds a text and no element is a token of its own.
CONTAINERS = frozenset("html body div section center table tbody tr td".split())
SHARE = 0.6  # of the text above, in a container that is the core or holds it
DEEP = 60  # levels of a page that are told apart; deeper elements count as part of theirs
PERIOD = 4  # longest repeated group
TEXT = "#"
SEEN = 3  # pages on which a text must be the same to be part of a template
HELD = 2_000  # hosts a task holds
FAN = 64  # partial wrappers of a host that one task merges in a round
SENT = 16 << 20  # characters of all wrappers that are sent to every task

# A page is a tree [label, skip, children]; a child is a tree or a text. An expression is a list of items
# [label, optional, repeated, skip, children, text], where text is, for slots, [pages, name of what all of them have there or
# null if they differ, characters]. `judged` adds a mark: of slots how likely they are main text, of elements whether they are the core.


def _label(tag: str, attributes: str) -> tuple[str, int]:
    """An element's token, and whether it is skipped: 0 no, 1 outside the main element only, 2 everywhere."""
    words = []
    if "=" in attributes:
        for m in ATTRIBUTE.finditer(attributes):
            words += NAME.findall((m[2] or m[3] or m[4] or "").lower())
    skip = 2 if tag in SKIPPED else 1 if tag in OUTER else 0
    if not skip and tag not in MAIN and tag not in ("body", "html") and not HINTS.isdisjoint(words):
        skip = 2
    label = ".".join([tag, *sorted(set(words))[:6]])
    return (f"{label}!" if skip == 2 and tag not in SKIPPED else label), skip  # words that are cut may tell apart what is skipped


def tree(page: str) -> list:
    """The nested elements of a page. Inline elements are transparent, open paragraphs end where HTML ends them."""
    root: list = ["", 0, []]
    stack, tags = [root], [""]
    at = 0

    def text(piece: str) -> None:
        if piece and not piece.isspace():
            children = stack[-1][2]
            if children and isinstance(children[-1], str):
                children[-1] += piece
            else:
                children.append(piece)
        elif piece:
            space()

    def space() -> None:
        children = stack[-1][2]
        if children and isinstance(children[-1], str):
            children[-1] += " "

    def close(kinds: frozenset, until: frozenset) -> None:
        for i in range(len(tags) - 1, 0, -1):
            if tags[i] in kinds:
                del tags[i:], stack[i:]
                return
            if tags[i] in until:
                return

    labels: dict[tuple[str, str], tuple[str, int]] = {}
    for m in TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "br":
                space()
            continue
        if m[2]:
            if tag in tags:
                i = len(tags) - 1 - tags[::-1].index(tag)
                del tags[i:], stack[i:]
            continue
        if "p" in tags:
            close(frozenset(["p"]), frozenset(["table", "td", "th", "li", "div", "section", "article", "main", "aside", "nav", "form"]))
        if tag in CLOSES:
            close(*CLOSES[tag])
        key = (tag, m[4])
        found = labels.get(key) or labels.setdefault(key, _label(*key))
        if len(stack) > DEEP and not found[1]:
            node = stack[-1]
            node[2].append([TEXT, 0, []])  # a border between blocks
        else:
            node = [found[0], found[1], []]
            stack[-1][2].append(node)
        if tag not in VOID and not m[4].endswith("/"):
            stack.append(node)
            tags.append(tag)
    text(page[at:])
    _open(root)
    return root


def _length(node: list) -> int:
    """Characters of all texts below a node, skipped or not."""
    total, left = 0, [node]
    while left:
        for child in left.pop()[2]:
            if isinstance(child, str):
                total += len(child)
            else:
                left.append(child)
    return total


def _open(root: list) -> None:
    """If all main elements with text lie in skipped elements, those that hold the outermost ones are not skipped: a hint there tells of the
    page's layout. Menus and the like stay skipped, and so do lists of several articles that have less text than the rest of the page."""
    mains: list[tuple[int, list, tuple | None]] = []  # skipped elements above: how many; main element; these, from the inner to the outer
    beside = 0
    left: list[tuple[list, int, tuple | None]] = [(root, 0, None)]
    while left:
        node, many, above = left.pop()
        for child in node[2]:
            if isinstance(child, str):
                beside += 0 if above else len(child)
                continue
            tag = _tag(child[0])
            if tag in MAIN:
                if _length(child):
                    if not above:
                        return
                    mains.append((many, child, above))
            elif child[1] == 0:
                left.append((child, many, above))
            elif tag not in CLOSED:
                left.append((child, many + 1, (child, above)))
    if not mains:
        return
    least = min(m[0] for m in mains)
    outer = [m for m in mains if m[0] == least]
    if len(outer) > 1 and sum(_length(m[1]) for m in outer) < beside:
        return
    for _, _, above in outer:
        while above:
            above[0][1] = 0
            above = above[1]


def _name(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _merged_text(a: list | None, b: list | None, one_page: bool) -> list | None:
    if a is None or b is None:
        return a or b
    if one_page:
        return [1, _name(f"{a[1]} {b[1]}"), a[2] + b[2]]
    return [a[0] + b[0], a[1] if a[1] == b[1] else None, a[2] + b[2]]


def _merged_item(a: list, b: list, repeated: bool = False, one_page: bool = False) -> list:
    text = _merged_text(a[5], b[5], one_page)
    return [a[0], a[1] or b[1], a[2] or b[2] or repeated, max(a[3], b[3]), aligned(a[4], b[4], one_page), text]


def folded(items: list, one_page: bool) -> list:
    """Adjacent equal items as one repeated item, adjacent equal runs of items as one repeated group."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = _merged_item(out[-1], item, True, one_page)
        else:
            out.append(item)
    for size in range(2, PERIOD + 1):
        i = 0
        while i + 2 * size <= len(out):
            if [x[0] for x in out[i : i + size]] != [x[0] for x in out[i + size : i + 2 * size]]:
                i += 1
                continue
            run = out[i : i + size]
            end = i + size
            while [x[0] for x in run] == [x[0] for x in out[end : end + size]]:
                run = [_merged_item(a, b, False, one_page) for a, b in zip(run, out[end : end + size], strict=True)]
                end += size
            label = "(" + " ".join(x[0] for x in run) + ")"
            out[i:end] = [[label, False, True, 0, run, None]]
            i += 1
    return out


def aligned(a: list, b: list, one_page: bool = False) -> list:
    """Two expressions merged: their longest common subsequence of items stays, the rest becomes optional."""
    if [x[0] for x in a] == [x[0] for x in b]:
        return [_merged_item(x, y, False, one_page) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i][0] == b[j][0] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i][0] == b[j][0]:
            out.append(_merged_item(a[i], b[j], False, one_page))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            out.append([a[i][0], True, *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], True, *b[j][2:]])
            j += 1
    return folded(out, one_page)


def expression(node: list) -> list:
    """The union-free expression of one page's element: of its children."""
    items = []
    for child in node[2]:
        if isinstance(child, str):
            block = block_of(child)
            items.append([TEXT, False, False, 0, [], [1, _name(block), len(block)]])
        elif child[1] == 2:
            items.append([child[0], False, False, 2, [], None])
        elif child[0] != TEXT:
            items.append([_token(child), False, False, child[1], expression(child), None])
    return folded(items, True)


def _token(node: list) -> str:
    """The token of an element: its label, and for a container whether it holds a text and no element."""
    children = node[2]
    if _tag(node[0]) in CONTAINERS and children and all(isinstance(c, str) or c[0] == TEXT for c in children):
        return f"{node[0]}{TEXT}"
    return node[0]


def block_of(text: str) -> str:
    return " ".join(html.unescape(text).split())


def _tag(label: str) -> str:
    return label.split(".", 1)[0].rstrip(TEXT)


def _slots(items: list, inside: bool, skipped: bool, repeated: bool = False) -> Iterator[tuple[list, bool, bool, bool]]:
    """Every text slot with: inside the main element, skipped, repeated."""
    for item in items:
        main = inside or _tag(item[0]) in MAIN
        skip = skipped or item[3] == 2 or (item[3] == 1 and not main)
        if item[0] == TEXT:
            yield item, inside, skipped, repeated or item[2]
        yield from _slots(item[4], main, skip, repeated or item[2])


def _weight(item: list, known: dict[int, bool]) -> int:
    """Characters of the slots below an item that may be main text without an article: those in `known` with True."""
    if item[0] == TEXT:
        return item[5][2] if known.get(id(item)) else 0
    return sum(_weight(x, known) for x in item[4])


def _core(items: list, known: dict[int, bool]) -> list | None:
    """The innermost container that holds most of the host's text: from the top, the one with `SHARE` of what is left, as long as there is one."""
    core = None
    total = sum(_weight(x, known) for x in items)
    while total:
        inside = [x for item in items for x in (_members(item) if item[0].startswith("(") else [item])]
        sizes = [(_weight(x, known), x) for x in inside if x[3] == 0 and _tag(x[0]) in CONTAINERS]
        size, best = max(sizes, key=lambda x: x[0], default=(0, None))
        if best is None or size < SHARE * total:
            break
        core, items, total = best, best[4], size
    return core


def _members(group: list) -> Iterator[list]:
    """The items of a group, in groups of groups too."""
    for item in group[4]:
        if item[0].startswith("("):
            yield from _members(item)
        else:
            yield item


def judged(wrapper: list) -> list:
    """The wrapper with marks. A slot has 3 in an article, 2 in the core, 1 elsewhere, 0 in a skipped element or as a part of the template:
    where others change, a text that is the same on all of `SEEN` or more pages. An element has 1 if it is the core, else 0."""
    slots = list(_slots(wrapper, False, False))
    changes = any(not inside and not skipped and s[5][1] is None for s, inside, skipped, _ in slots)
    known = {
        id(s): not skipped and not (changes and not repeated and s[5][1] is not None and s[5][0] >= SEEN)
        for s, inside, skipped, repeated in slots
        if not inside
    }
    core = _core(wrapper, known)

    def mark(items: list, inside: bool, within: bool) -> None:
        for item in items:
            if item[0] == TEXT:
                item.append(3 if inside else 0 if not known[id(item)] else 2 if within else 1)
            else:
                item.append(int(item is core))
                mark(item[4], inside or _tag(item[0]) in MAIN, within or item is core)

    mark(wrapper, False, core is None)
    return wrapper


def _found(items: list, label: str) -> list | None:
    """The first item of this label, in groups of groups too."""
    for item in items:
        if item[0] == label:
            return item
        inner = _found(item[4], label) if item[0].startswith("(") else None
        if inner is not None:
            return inner
    return None


def main_text(page: str, wrapper: list) -> str:
    """The main text of a page, a line a block, read along its host's wrapper (`judged`): the texts with the highest mark that the page has.
    A text or an element that the wrapper does not know is read by the plain rules: in an article 3, in a skipped element 0, else 2."""
    out: list[tuple[int, str]] = []

    def read(node: list, items: list, inside: bool, within: bool) -> None:
        at = 0
        for child in node[2]:
            label = TEXT if isinstance(child, str) else _token(child)
            if label == TEXT and not isinstance(child, str):
                continue
            found = None
            for k in [*range(at, len(items)), *range(at)]:  # from the last match on, then from the front
                found = _found(items[k : k + 1], label)
                if found is not None:
                    at = k
                    break
            if label == TEXT:
                block = block_of(child)
                if block:
                    out.append((3 if inside else 2 if found is None else found[-1], block))
                continue
            main = inside or _tag(label) in MAIN
            core = within or (found is not None and found[-1] == 1)
            if child[1] != 2 and (child[1] != 1 or main or core):
                read(child, found[4] if found is not None else [], main, core)

    read(tree(page), wrapper, False, False)
    top = max((mark for mark, _ in out), default=0)
    return "\n".join(block for mark, block in out if mark == top > 0)


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper for each host of the task's pages."""
    held: dict[str, list] = {}
    task = TaskContext.get().partitionId()

    def rows() -> pa.RecordBatch:
        columns = [pa.array(list(held), pa.string()), pa.array([task] * len(held), pa.int64()), pa.array([json.dumps(w) for w in held.values()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["host", "part", "wrapper"])

    for batch in batches:
        for part in slices(batch, "html"):
            for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                own = expression(tree(page or ""))
                held[host] = aligned(held[host], own) if host in held else own
            if len(held) > HELD:
                yield rows()
                held = {}
    yield rows()


def _unite(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Rows (host, part, wrapper) sorted by host and part: one row a host and part. One wrapper is held at a time."""
    at, wrapper = None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([at[0]], pa.string()), pa.array([at[1]], pa.int64()), pa.array([json.dumps(judged(wrapper) if last else wrapper)])]
        return pa.RecordBatch.from_arrays(columns, ["host", "part", "wrapper"])

    for batch in batches:
        for h, k, w in zip(*(batch.column(c).to_pylist() for c in ("host", "part", "wrapper")), strict=True):
            if (h, k) != at:
                if wrapper is not None:
                    yield row()
                at, wrapper = (h, k), json.loads(w)
            else:
                wrapper = aligned(wrapper, json.loads(w))
    if wrapper is not None:
        yield row()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    for batch in batches:
        for part in slices(batch, "html"):
            out = []
            for page, text in zip(part.column("html").to_pylist(), part.column("wrapper").to_pylist(), strict=True):
                if text not in held:
                    if len(held) >= HELD:
                        held.clear()
                    held[text] = json.loads(text)
                out.append(main_text(page or "", held[text]))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(out, pa.string())], ["id", "url", "text"])


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, wrapper) of every host; pages without a host are those of the empty one."""
    rows = pages.select(host_and_path(F.col(url_col))[0].alias("host"), F.col(html_col).alias("html"))
    schema = "host string, part long, wrapper string"
    found = cut_lineage(rows.mapInArrow(_learn, schema))
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN)
        last = parts == 1
        united = found.withColumn("part", F.floor(F.col("part") / FAN)).repartition("host", "part").sortWithinPartitions("host", "part", "wrapper")
        found = cut_lineage(united.mapInArrow(partial(_unite, last=last), schema))
        if last:
            return found.select("host", "wrapper")


def extracted(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every row. Character references are decoded, white space inside a block
    is one space, blocks are lines. A page without main text, or a null one, has an empty text. Repeated rows are read each;
    ids and urls may be null; other columns are not read. All texts and all pages are whole."""
    found = wrappers(pages, url_col, html_col)
    size = found.agg(F.coalesce(F.sum(F.length("wrapper")), F.lit(0))).first()[0]
    rows = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_and_path(F.col(url_col))[0].alias("host")
    ).withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)))
    if size <= SENT:
        joined = rows.join(F.broadcast(found), "host")
    else:  # a host may have any share of the pages: its wrapper goes to each salt it has
        joined = rows.join(rows.select("host", "salt").distinct().join(found, "host"), ["host", "salt"])
    texts = joined.select("id", "url", "html", "wrapper").mapInArrow(_extract, "id long, url string, text string")
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
