"""Main text of pages by wrappers: union-free expressions inferred from the pages of a host.

A page becomes a tree of block elements and text slots. Neighbours of one kind are folded
into a repeated element, and neighbouring runs that recur into a repeated group, so that a
page is a union-free expression by itself. The expressions of a host are aligned one after
another: what matches is merged, what only one side has becomes optional, and text that differs
becomes a slot while text that is the same everywhere stays template. The result is the
host's wrapper. Its slots are classified once, by the elements around them and, where no
element is marked as the content, by the text they hold over all pages of the host. A page is
then aligned with its wrapper, and the texts in content slots are its main text; a page with
none of them is judged by its own expression.

A first pass folds, in each task, the pages of a host that have the same expression; only
expressions are shuffled, and they are merged in rounds of bounded groups, so that neither
a host with a third of all pages nor one with many layouts fills a task. The second pass
reads the pages where they are; wrappers come by a broadcast of checked size, or by
a salted join beyond it.

A null page is empty, and has an empty text, as has one without content. The host is taken
from the url as for the url filter; pages without one share the empty host. Repeated
rows are separate pages. Further columns are ignored.
"""

from __future__ import annotations

import html as references
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.operators.lookup import lookup_join
from tokenloom.session import materialise

#: Expressions merged by one task at once.
GROUP = 64
#: Pages folded by a task before it passes its expressions on.
FOLDED = 4096
#: Elements nested deeper than this put their text into the last one above, as browsers do.
DEEPEST = 512
#: Longest recurring run of neighbours that is folded into a group.
RUN = 4
#: A host with so many pages tells template text from slots.
TEMPLATE_PAGES = 3
#: Wrappers are broadcast up to this size, and joined by salted hosts beyond it.
BROADCAST_CHARS = 32 << 20
BROADCAST_CELLS = 400_000

# Elements of the page language, by their role.
SKIPPED = frozenset("script style noscript template iframe object svg math canvas head title".split())
RAW = frozenset("script style noscript template iframe svg math canvas textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button select input textarea".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
CONTENT = frozenset("article main".split())
HEAD = frozenset("base link meta noscript script style template title".split())
TEXT_BLOCKS = HEADINGS | frozenset(
    "p li ul ol dl dt dd blockquote pre table caption tbody thead tfoot tr td th figure figcaption "
    "address details summary center".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
    "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr main menu nav ol p pre section table ul".split()
)
SCOPES = frozenset("table td th ul ol dl body article section div main aside".split())
# Words of class and id attributes, by what the element holds.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising comment comments commentlist "
    "disqus recommended related replies respond".split()
)
AROUND_WORDS = frozenset(
    "banner breadcrumb breadcrumbs consent cookie cookies footer gdpr menu modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promotion "
    "share sharing sidebar social sponsor sponsored subscribe subscription toolbar".split()
)
HEADER_WORDS = frozenset("header masthead".split())
ROLES_AROUND = frozenset(
    "navigation banner contentinfo complementary search form dialog alert menu menubar".split()
)
INSIDE_NAMES = frozenset(
    "article-body articlebody article-content article-text content main-content maincontent entry-content "
    "post-body post-content story-body main".split()
)

TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:_-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*>|[^>]*(?:>|$))",
    re.DOTALL,
)
ATTRIBUTE = re.compile(
    r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE
)
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# Places of a node: sign, optional, repeated, children, texts. A leaf's sign is "#".
SIGN, OPTIONAL, REPEATED, CHILDREN, TEXTS = range(5)


def node(sign: str, children: list | None = None, texts: list | None = None) -> list:
    return [sign, False, False, children if children is not None else [], texts if texts is not None else []]


def sign_of(tag: str, attributes: str) -> str:
    """Element name with what its attributes say of its role.

    ``-``: never main text. ``~``: around the main text, unless that is inside. ``+``: main text.
    """
    if len(attributes) < 4:
        return tag
    words, roles, names = set(), set(), set()
    for name, *values in ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "")
        if name.lower() == "role":
            roles |= set(value.lower().split())
        else:
            names |= set(value.lower().split())
            words |= {w.lower() for w in NAME_WORD.findall(value)}
    if tag in ("html", "body"):
        return tag
    if tag in CONTENT:  # its classes often list what the page has besides
        words = names
    if words & ASIDE_WORDS:
        return f"{tag}-"
    if names & INSIDE_NAMES or roles & {"main", "article"}:
        return f"{tag}+"
    if words & HEADER_WORDS:
        return "header"
    if words & AROUND_WORDS or roles & ROLES_AROUND:
        return f"{tag}~"
    return tag


def page_tree(source: str) -> tuple[list, list[str]]:
    """The tree of a page and its block texts in page order; leaves hold numbers of texts."""
    root = node("")
    stack: list[tuple[str, list]] = [("", root)]
    texts: list[str] = []
    held: list[str] = []
    hidden = 0  # depth of the outermost skipped element, or 0

    def end_block() -> None:
        if held:
            words = " ".join(references.unescape("".join(held)).split())
            held.clear()
            if words:
                stack[-1][1][CHILDREN].append(node("#", texts=[len(texts)]))
                texts.append(words)

    def close(tags: frozenset | set, scopes: frozenset | set) -> None:
        nonlocal hidden
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                del stack[depth:]
                if depth <= hidden:
                    hidden = 0
                return
            if stack[depth][0] in scopes:
                return

    at, n = 0, len(source)
    while at < n:
        found = TOKEN.search(source, at)
        begin = found.start() if found else n
        if begin > at and not hidden:
            held.append(source[at:begin])
        if not found:
            break
        at = found.end()
        if found.group(2) is None:
            continue
        tag, attributes = found.group(2).lower(), found.group(3)[:-1]
        sign = tag
        if tag in INLINE:
            # Part of its block, unless it holds an advert or the like.
            opened = any(s[0] == tag for s in stack)
            sign = tag if found.group(1) else sign_of(tag, attributes)
            if tag == "br":
                held.append(" ")
            if tag in VOID or not opened and sign[-1] not in "-~":
                continue
        end_block()
        if found.group(1):
            close({tag}, frozenset())
            continue
        if stack[-1][0] == "head" and tag not in HEAD:
            close({"head"}, frozenset())
        if tag in PARAGRAPH_ENDS:
            close({"p"}, SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES - CLOSES[tag])
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(source, at)
            at = end.end() if end else n
            continue
        if tag in VOID or attributes.endswith("/"):
            continue
        if len(stack) > DEEPEST:
            child = stack[-1][1]
        else:
            child = node(sign if tag in INLINE else sign_of(tag, attributes))
            stack[-1][1][CHILDREN].append(child)
        stack.append((tag, child))
        if tag in SKIPPED and not hidden:
            hidden = len(stack) - 1
    end_block()
    fold(root)
    return root, texts


def fold(tree: list) -> None:
    """Fold neighbours of one kind, and recurring runs of neighbours, everywhere in a tree."""
    todo, order = [tree], []
    while todo:
        order.append(at := todo.pop())
        todo += at[CHILDREN]
    for at in reversed(order):
        at[CHILDREN] = folded(at[CHILDREN])


def kind(at: list) -> str:
    """What makes elements alike: the sign, and for a mere container also what it holds."""
    if at[SIGN] == "#" or at[SIGN] in TEXT_BLOCKS:
        return at[SIGN]
    return f"{at[SIGN]} {' '.join(sorted({c[SIGN] for c in at[CHILDREN]}))}"


def folded(children: list) -> list:
    """Equal neighbours become one repeated element; a run of up to ``RUN`` that recurs, a group."""
    out: list = []
    kinds: list[str] = []
    for child in children:
        own = kind(child)
        if kinds and kinds[-1] == own:
            merge(out[-1], child)
            if child[SIGN] != "#":
                out[-1][REPEATED] = True
        else:
            out.append(child)
            kinds.append(own)
    for length in range(2, RUN + 1):
        at, kept, kinds = 0, [], [kind(c) for c in out]
        while at < len(out):
            run, times = kinds[at : at + length], 1
            while len(run) == length and run == kinds[at + times * length : at + (times + 1) * length]:
                times += 1
            if times == 1:
                kept.append(out[at])
                at += 1
                continue
            group = node(f"({','.join(c[SIGN] for c in out[at : at + length])})", out[at : at + length])
            for i in range(1, times):
                for mine, other in zip(
                    group[CHILDREN], out[at + i * length : at + (i + 1) * length]
                ):
                    merge(mine, other)
            group[REPEATED] = True
            kept.append(group)
            at += times * length
        out = kept
    return out


def merge(mine: list, other: list) -> None:
    """Align ``other`` with ``mine`` and take it in; both have one sign.

    Children that are alike are aligned first, then those between them by their signs alone. A
    child that only one side has becomes optional. The walk keeps its own stack.
    """
    todo = [(mine, other)]
    while todo:
        a, b = todo.pop()
        a[OPTIONAL] |= b[OPTIONAL]
        a[REPEATED] |= b[REPEATED]
        a[TEXTS] = joined(a[TEXTS], b[TEXTS])
        left, right = a[CHILDREN], b[CHILDREN]
        if [c[SIGN] for c in left] == [c[SIGN] for c in right]:
            todo += zip(left, right)
            continue
        out: list = []
        for same, own, others in aligned(left, right, kind):
            if same:
                out += own
                todo += zip(own, others)
                continue
            for paired, mine_, other_ in aligned(own, others, lambda c: c[SIGN]):
                if paired:
                    out += mine_
                    todo += zip(mine_, other_)
                    continue
                for child in [*mine_, *other_]:
                    child[OPTIONAL] = True
                    out.append(child)
        a[CHILDREN] = out


def aligned(left: list, right: list, key) -> Iterator[tuple[bool, list, list]]:
    """Stretches of two lists that agree under ``key``, and those between them."""
    codes = SequenceMatcher(None, [key(c) for c in left], [key(c) for c in right], False)
    for name, i1, i2, j1, j2 in codes.get_opcodes():
        yield name == "equal", left[i1:i2], right[j1:j2]


def joined(a: list, b: list) -> list:
    """Texts of merged leaves: numbers of a page's texts, or a slot's figures."""
    if not a or not b:
        return a or b
    if isinstance(a[0], int) and isinstance(b[0], int):
        return a + b
    return [figures(a[0], b[0])]


def figures(a: dict, b: dict) -> dict:
    """Characters add up; a text that is not the same on both sides is a slot.

    ``of`` lists the places of a page that has taken no part in the inference.
    """
    if "of" in a or "of" in b:
        held = a if "of" not in a else b
        return held | {"of": a.get("of", []) + b.get("of", [])}
    return {"chars": a["chars"] + b["chars"], "same": a["same"] if a["same"] == b["same"] else None}


def leaves(tree: list) -> list:
    """Leaves in page order."""
    out, todo = [], [tree]
    while todo:
        at = todo.pop()
        if at[SIGN] == "#":
            out.append(at)
        todo += reversed(at[CHILDREN])
    return out


def expression(tree: list) -> str:
    """The tree without its texts, as text: equal for pages of one layout."""

    def bare(at: list) -> list:
        return [at[SIGN], int(at[OPTIONAL]), int(at[REPEATED]), []]

    root = bare(tree)
    todo = [(tree, root)]
    while todo:
        at, copy = todo.pop()
        for child in at[CHILDREN]:
            copy[3].append(bare(child))
            todo.append((child, copy[3][-1]))
    return dumped(root)


def dumped(tree: list) -> str:
    """Nested lists as flat text, whatever their depth."""
    out: list[str] = []
    todo: list = [tree]
    while todo:
        at = todo.pop()
        if at is None:
            out.append(")")
            continue
        out.append(f"{at[0]}\x1f{at[1]}{at[2]}")
        out.append("(")
        todo.append(None)
        todo += reversed(at[3])
    return "\x1e".join(out)


def loaded(text: str) -> list:
    """The tree of an expression."""
    top = node("")
    stack, last = [top], top
    for part in text.split("\x1e"):
        if part == "(":
            stack.append(last)
        elif part == ")":
            stack.pop()
        else:
            sign, flags = part.split("\x1f")
            last = node(sign)
            last[OPTIONAL], last[REPEATED] = flags[0] == "1", flags[1] == "1"
            stack[-1][CHILDREN].append(last)
    return top[CHILDREN][0]


def with_figures(text: str, slots: list[dict]) -> list:
    tree = loaded(text)
    for leaf, slot in zip(leaves(tree), slots):
        leaf[TEXTS] = [dict(slot)]
    return tree


def stored(tree: list) -> tuple[str, str]:
    """Expression and figures of its slots."""
    return expression(tree), json.dumps([leaf[TEXTS][0] for leaf in leaves(tree)])


def align(wrapper: tuple[str, str], others: list[tuple[str, str]]) -> tuple[str, str]:
    """One wrapper after another taken into the first."""
    tree = with_figures(wrapper[0], json.loads(wrapper[1]))
    for text, slots in others:
        merge(tree, with_figures(text, json.loads(slots)))
    return stored(tree)


def content_leaves(tree: list, pages: int) -> list[bool]:
    """Which leaves of a wrapper, in page order, hold main text."""
    holds = _holding_content(tree)
    every: list[tuple[list, bool, list]] = []  # leaf, around the main text, elements
    todo = [(tree, False, [])]
    while todo:
        at, around, path = todo.pop()
        tag, role = at[SIGN].rstrip("-~+"), at[SIGN][-1:]
        if at[SIGN] == "#":
            every.append((at, around or _in_header(path), path))
            continue
        around = around or tag in BOILERPLATE or role == "-" or role == "~" and id(at) not in holds
        for child in reversed(at[CHILDREN]):
            todo.append((child, around, [*path, at]))
    left = [(leaf, path) for leaf, around, path in every if not around]
    for marks in (("article",), ("main", "+")):
        inside = {id(leaf) for leaf, path in left if any(_marked(p[SIGN], marks) for p in path)}
        if inside:
            return [id(leaf) in inside for leaf, _, _ in every]
    # Without a mark: slots, not template text, of the element that holds most of the text.
    if pages >= TEMPLATE_PAGES:
        left = [(leaf, path) for leaf, path in left if leaf[TEXTS][0]["same"] is None]
    weight: dict[int, int] = {}
    depth: dict[int, int] = {}
    for leaf, path in left:
        end = len(path)
        while end > 1 and (path[end - 1][SIGN] in TEXT_BLOCKS or path[end - 1][SIGN][:1] == "("):
            end -= 1
        for at, step in enumerate(path[:end]):
            weight[id(step)] = weight.get(id(step), 0) + leaf[TEXTS][0]["chars"]
            depth[id(step)] = at
    heavy = [p for p in weight if 2 * weight[p] >= weight[id(tree)]]
    best = max(heavy, key=lambda p: (depth[p], weight[p]), default=None)
    chosen = {id(leaf) for leaf, path in left if any(id(p) == best for p in path)}
    return [id(leaf) in chosen for leaf, _, _ in every]


def _marked(sign: str, marks: tuple[str, ...]) -> bool:
    return sign[-1:] != "-" and (sign.rstrip("~+") in marks or sign[-1:] in marks)


def _holding_content(tree: list) -> set[int]:
    """Elements around one that is marked as the content."""
    found: set[int] = set()
    todo = [(tree, [])]
    while todo:
        at, path = todo.pop()
        if _marked(at[SIGN], ("article", "main", "+")):
            found |= {id(p) for p in path}
        todo += [(child, [*path, at]) for child in at[CHILDREN]]
    return found


def _in_header(path: list) -> bool:
    """Inside a header only an article's own headings are main text."""
    tags = [p[SIGN].rstrip("-~+") for p in path]
    if "header" not in tags:
        return False
    at = tags.index("header")
    own = any(_marked(p[SIGN], ("article", "main", "+")) for p in path[:at])
    return not (own and any(t in HEADINGS for t in tags[at:]))


def host_of(url: Column) -> Column:
    """Host of an url, ``A-Z`` lower-cased; empty without ``://`` or for a null."""
    after = F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(after, upper, lower)


def slot_figures(tree: list, texts: list[str]) -> list[dict]:
    """Figures of a page's slots: characters, and the text itself if it is one and short."""
    out = []
    for leaf in leaves(tree):
        own = [texts[i] for i in leaf[TEXTS]]
        same = own[0] if len(own) == 1 and len(own[0]) <= 200 else None
        out.append({"chars": sum(map(len, own)), "same": same})
    return out


def page_expressions(pages: DataFrame) -> DataFrame:
    """``(host, expression, slots, pages)``: layouts of every host, folded within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}

        def flush() -> pa.RecordBatch:
            rows = [(h, e, json.dumps(s), n) for (h, e), (s, n) in held.items()]
            held.clear()
            types = [pa.string(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)],
                ["host", "expression", "slots", "pages"],
            )

        for batch in batches:
            for host, source in zip(batch.column(0), batch.column(1)):
                tree, texts = page_tree(source.as_py() or "")
                slots, key = slot_figures(tree, texts), (host.as_py(), expression(tree))
                if key in held:
                    mine = held[key]
                    mine[0] = [figures(a, b) for a, b in zip(mine[0], slots)]
                    mine[1] += 1
                else:
                    held[key] = [slots, 1]
                if len(held) >= FOLDED:
                    yield flush()
        if held:
            yield flush()

    return pages.mapInArrow(run, "host string, expression string, slots string, pages long")


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper for each group of expressions, aligned by their order."""

    def run(table: pa.Table) -> pa.Table:
        order = sorted(table.to_pylist(), key=lambda r: (-r["pages"], r["expression"], r["slots"]))
        text, slots = align(
            (order[0]["expression"], order[0]["slots"]),
            [(r["expression"], r["slots"]) for r in order[1:]],
        )
        return pa.table(
            {
                "host": pa.array([order[0]["host"]], pa.string()),
                "expression": pa.array([text], pa.string()),
                "slots": pa.array([slots], pa.string()),
                "pages": pa.array([sum(r["pages"] for r in order)], pa.int64()),
            }
        )

    return rows.groupBy(*keys).applyInArrow(
        run, "host string, expression string, slots string, pages long"
    )


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, expression, slots, pages)``: one wrapper per host.

    Groups of bounded size are merged in rounds, until every host has one row.
    """
    rows = materialise(page_expressions(pages), "page-expressions")
    while True:
        parts = materialise(
            rows.groupBy("host").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("parts")),
            "page-parts",
        )
        last = not parts.where("parts > 1").limit(1).count()
        dealt = lookup_join(rows, parts, ["host"], spread_by=F.col("expression"))
        # Copies of one layout, from different tasks, have to meet at an even spread.
        part = F.pmod(F.xxhash64("expression", "slots", "pages"), F.col("parts"))
        rows = materialise(merged(dealt.withColumn("part", part), ["host", "part"]), "page-wrappers")
        if last:
            return rows


def main_texts(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """``(page_id, url, text)`` of every page, from ``(page_id, url, host, html)``."""
    known = wrappers.select("host", "expression", "slots", F.col("pages").alias("of"))
    size = wrappers.agg(F.sum(F.length("expression") + F.length("slots")).alias("n")).first()["n"] or 0
    cells = BROADCAST_CELLS if size <= BROADCAST_CHARS else 0
    wide = lookup_join(pages, known, ["host"], spread_by=F.col("page_id"), max_cells=cells)
    wide = wide.select("page_id", "url", "html", "host", "expression", "slots", "of")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels: dict[tuple[str, str], list[bool]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = []
                for source, host, wrapper, slots, of in zip(*[part.column(i) for i in range(2, 7)]):
                    tree, texts = page_tree(source.as_py() or "")
                    key = (host.as_py(), expression(tree))
                    if key not in labels:
                        if len(labels) >= FOLDED:
                            labels.clear()
                        labels[key] = page_labels(tree, (wrapper.as_py(), slots.as_py()), of.as_py())
                    kept = [
                        i for leaf, main in zip(leaves(tree), labels[key]) if main for i in leaf[TEXTS]
                    ]
                    found.append(" ".join([texts[i] for i in sorted(kept)]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(found, pa.string())],
                    ["page_id", "url", "text"],
                )

    return wide.mapInArrow(run, "page_id long, url string, text string")


def page_labels(tree: list, wrapper: tuple[str, str], pages: int) -> list[bool]:
    """Which leaves of a page hold main text, by aligning its expression with the wrapper."""
    whole = with_figures(wrapper[0], json.loads(wrapper[1]))
    page = loaded(expression(tree))
    own = leaves(page)
    for number, leaf in enumerate(own):
        leaf[TEXTS] = [{"chars": 0, "same": None, "of": [number]}]
    merge(whole, page)
    flags = [False] * len(own)
    for leaf, main in zip(leaves(whole), content_leaves(whole, pages)):
        for number in leaf[TEXTS][0].get("of", []):
            flags[number] = main
    if any(flags):
        return flags
    alone = with_figures(expression(tree), [{"chars": 1, "same": None}] * len(own))
    return content_leaves(alone, 1)


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page."""
    known = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        host_of(F.col("url")).alias("host"),
        F.col("html").cast("string").alias("html"),
    )
    wrappers = infer_wrappers(known.select("host", "html"))
    found = main_texts(known, wrappers)
    return found.withColumn("n_chars", F.length("text").cast("long"))
