"""Main text of web pages by wrapper induction.

Pages of a host are aligned: each page's tree, in which every element with text is a node, is merged into the
host's tree by simple tree matching, siblings of equal text first, and every node keeps how often which text stood
there. Nodes whose text hardly changes are the host's template, whatever their tag; what varies in slots is content. Kinds of nodes that never hold an
article (menus, footers, adverts, forms, comments, ...) are left out whatever they say.

Pages of a host with the same main blocks count once: trees are dealt by host and hash, so each task merges distinct
pages into one tree for each host, and the trees of a host are merged after another shuffle. A host with a third of
all pages puts one row a task into its group. The bounded summaries of texts in these trees only name one text for a
node; a second pass over the distinct pages counts it exactly before a node is judged.
"""

from __future__ import annotations

import html
import json
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Collection, Iterator
from itertools import batched, count, groupby, islice
from operator import itemgetter
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hapdiff.llm.common import cut
from hapdiff.llm.wordhash import slices

#: Elements that are dropped with all they hold, by tag or by a word of their class, id or role; fixed values.
RAW = "script|style|noscript|template|iframe|textarea|select|svg|title|head|object|canvas|audio|video"
NEVER = frozenset("nav footer aside form button dialog menu".split())
NEVER_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar side aside footer foot header masthead banner ad ads advert adverts "
    "advertisement sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe subscription signup login form search share sharing social related recommended recommendations comment comments "
    "commentlist respond replies discussion disqus widget widgets toolbar pagination pager tags copyright legal skip complementary "
    "contentinfo".split()
)
#: A name of several words says nothing with one of these in it ("has-sidebar", "no-ads"), or where it names a whole page ("menu-page").
MODIFIERS = frozenset("no not non has have with without by is hide show".split())
WHOLE = frozenset("page layout site".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr img label math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot semantics annotation".split()
)
MAIN = frozenset("article main".split())
#: A node is template where one text stands on this share of the pages that have it, on so many pages at least.
SAME, PAGES = 0.8, 4
#: Elements that are nested deeper than this are one node with the element at this depth.
DEEP = 100
#: Texts that a node remembers: any text on over a fifth of the pages is among them, its count too low by a fifth of the pages at most.
TEXTS = 4
#: Trees of all hosts together up to this size are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<(" + RAW + r")\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</\1\s*>|$)"
    r"|<[!?][^>]*>|<(/?)([a-zA-Z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|([^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
#: The same without tags: of the groups of _TOKEN only that of text matches.
_NO_TAGS = re.compile(r"<!--.*|(?:(?!)()()()())?([^<]+|<)", re.DOTALL)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-z]+")
#: Start tags that end an open element of these kinds.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def _named(name: str) -> bool:
    """Whether a class, id or role is of a kind that holds no article."""
    parts = [w for w in _SPLIT.split(name) if w]
    if NEVER_WORDS.isdisjoint(parts):
        return False
    return len(parts) == 1 or (MODIFIERS.isdisjoint(parts) and parts[-1] not in WHOLE)


def _kind(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """A node's label, whether it can't hold an article, and whether its names say so."""
    if not attributes or "=" not in attributes:
        return tag, tag in NEVER, False
    values = [(x or y or z).lower() for _, x, y, z in _ATTR.findall(attributes)]
    words = {w for value in values for w in _SPLIT.split(value) if w}
    named = tag not in MAIN and tag not in ("html", "body") and any(_named(x) for value in values for x in value.split())
    return ".".join([tag, *sorted(words)]), tag in NEVER, named


def _tokens(page: str) -> Iterator[re.Match]:
    """The tokens of a page. Behind a tag that nothing closes there are only text and comments, so no tag is looked for again."""
    pattern, at = _TOKEN, 0
    while at < len(page):
        m = pattern.match(page, at)
        if m[5] == "<" and pattern is _TOKEN and page.find(">", at) < 0:
            pattern = _NO_TAGS
        at = m.end()
        yield m


def blocks(page: str | None) -> list[tuple[tuple, str, int, tuple]]:
    """((key, label) of each element from the root, text, outermost article or main, named elements) of each block with text that may be content.

    In page order. Elements are given by their keys, which grow along the page; named ones have a name of NEVER_WORDS.
    """
    out: list[tuple[tuple, str, int, tuple]] = []
    stack: list[tuple[str, str, bool, int, int, tuple]] = []  # tag, label, never, outermost article or main, key, named
    outside = ("", "", False, 0, 0, ())
    text: list[str] = []

    def flush() -> None:
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            text.clear()
            above = stack[-1] if stack else outside
            if own and not above[2]:
                path = ((x[4], x[1]) for x in stack if x[0] not in INLINE or x[4] in x[5])
                out.append((tuple(islice(path, DEEP)), own, above[3], above[5]))

    for m in _tokens(page or ""):
        tag = m[3]
        if tag is None:
            if m[5] is not None:
                if not (stack and stack[-1][2]):
                    text.append(m[5])
            elif m[1] is not None:
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE and tag not in VOID:
            if not m[2]:
                label, never, named = _kind(tag, m[4])
                above = stack[-1] if stack else outside
                if (never and not above[2]) or named:
                    flush()
                if not m[4].endswith("/"):
                    stack.append((tag, label, above[2] or never, above[3], m.end(), (*above[5], m.end()) if named else above[5]))
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == tag:
                        if stack[k][2] and not (k and stack[k - 1][2]):
                            text.clear()
                        if stack[-1][5] != (stack[k - 1][5] if k else ()):
                            flush()
                        del stack[k]
                        break
                    if stack[k][0] not in INLINE:
                        break
            continue
        if tag in VOID:
            if tag == "br" or tag == "hr":
                text.append(" ")
            continue
        flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            continue
        ends = _CLOSES.get(tag, ())
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] == "p" or stack[k][0] in ends:
                del stack[k:]
                break
            if stack[k][0] not in INLINE and stack[k][0] not in ends:
                break
        while stack and stack[-1][0] in INLINE:
            stack.pop()
        label, never, named = _kind(tag, m[4])
        above = stack[-1] if stack else outside
        if not m[4].endswith("/"):
            main = above[3] or (m.end() if tag in MAIN else 0)
            stack.append((tag, label, above[2] or never, main, m.end(), (*above[5], m.end()) if named else above[5]))
    flush()
    return out


def without_named(own: list[tuple[tuple, str, int, tuple]], page: list[tuple[tuple, str, int, tuple]]) -> list[tuple[tuple, str, int, tuple]]:
    """The blocks outside of named elements; own are those of a page's blocks that vary.

    A name does not count on an element with the page's main or only articles, nor on one with over half of the text;
    articles in named elements beside the page's own article (teasers, comments) go with their element.
    """
    if not any(b[3] for b in own):
        return own
    article = any(b[2] and (not b[3] or b[2] < b[3][0]) for b in page)
    total, held, void = 0, defaultdict(int), set()
    for path, text, main, named in own:
        total += len(text)
        for key in named:
            if not article or main and main < key:
                held[key] += len(text)
            for k, label in path:
                tag = label.partition(".")[0]
                if k > key and (tag == "main" or (tag == "article" and not article)):
                    void.add(key)
    void.update(key for key, n in held.items() if 2 * n > total)
    return [b for b in own if void.issuperset(b[3])]


def placed(page_blocks: list[tuple[tuple, str, int, tuple]]) -> tuple[list, dict[int, list[int]]]:
    """The page's tree, and by the id of each node with text the numbers of its blocks.

    A node is [label, pages, {text hash: pages}, children]; every element is a node of its own, and its texts are one text.
    """
    root: list = ["", 1, {}, []]
    nodes: dict[int, list] = {}
    texts: dict[int, tuple[list, list[int]]] = {}
    for n, (path, *_) in enumerate(page_blocks):
        node = root
        for key, label in path:
            child = nodes.get(key)
            if child is None:
                child = nodes[key] = [label, 1, {}, []]
                node[3].append(child)
            node = child
        texts.setdefault(id(node), (node, []))[1].append(n)
    for node, own in texts.values():
        node[2][format(xxhash.xxh3_64_intdigest(" ".join(page_blocks[n][1] for n in own)), "x")] = 1
    return root, {k: own for k, (_, own) in texts.items()}


def tree(page_blocks: list[tuple[tuple, str, int, tuple]]) -> list:
    return placed(page_blocks)[0]


def match(a: list, b: list) -> list[tuple[int, int]]:
    """Simple tree matching of two lists of children: the pairs of equal labels, in order, with the most nodes below them.

    Children with a text in common are paired first, the others between them.
    """
    out, i0, j0 = [], 0, 0
    for i, j in [*_anchors(a, b), (len(a), len(b))]:
        out += [(i0 + x, j0 + y) for x, y in _by_label(a[i0:i], b[j0:j])]
        if i < len(a):
            out.append((i, j))
        i0, j0 = i + 1, j + 1
    return out


def _anchors(a: list, b: list) -> list[tuple[int, int]]:
    """The longest list of pairs, in order, of equal label and a text in common; a text counts where it stands most often."""
    at: tuple[dict, dict] = defaultdict(list), defaultdict(list)
    for k, x in enumerate(a):
        for text, n in x[2].items():
            at[0][x[0], text].append((-n, k))
    if not at[0]:
        return []
    for k, x in enumerate(b):
        for text, n in x[2].items():
            if (x[0], text) in at[0]:
                at[1][x[0], text].append((-n, k))
    pairs = set()
    for key, y in at[1].items():
        x, n = at[0][key], min(len(at[0][key]), len(y))
        pairs.update((i, j) for _, i in sorted(x)[:n] for _, j in sorted(y)[:n])
    ends: list[int] = []  # least j that ends an increasing list of each length
    last: list[tuple] = []
    for i, j in sorted(pairs, key=lambda p: (p[0], -p[1])):
        k = bisect_left(ends, j)
        ends[k:k + 1] = [j]
        last[k:k + 1] = [(i, j, last[k - 1] if k else None)]
    out, chain = [], last[-1] if last else None
    while chain:
        out.append(chain[:2])
        chain = chain[2]
    return out[::-1]


def _by_label(a: list, b: list) -> list[tuple[int, int]]:
    n = min(len(a), len(b))
    if not n:
        return []
    if len(a) == len(b) and all(x[0] == y[0] for x, y in zip(a, b, strict=True)):
        return [(k, k) for k in range(n)]
    # two leaves at an end weigh as much as any pair that either could be in
    head = next((k for k in range(n) if a[k][0] != b[k][0] or a[k][3] or b[k][3]), n)
    tail = next((k for k in range(n - head) if a[-1 - k][0] != b[-1 - k][0] or a[-1 - k][3] or b[-1 - k][3]), n - head)
    if head or tail:
        inner = _by_label(a[head : len(a) - tail], b[head : len(b) - tail])
        ends = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
        return [*((k, k) for k in range(head)), *((head + i, head + j) for i, j in inner), *ends]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            pair = best[i + 1][j + 1] + size_of_match(a[i], b[j]) if a[i][0] == b[j][0] else 0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], pair)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if best[i][j] == best[i + 1][j]:
            i += 1
        elif best[i][j] == best[i][j + 1]:
            j += 1
        else:
            out.append((i, j))
            i, j = i + 1, j + 1
    return out


def size_of_match(a: list, b: list) -> int:
    """How many nodes of two trees with equal roots can be paired; those with a text in common count twice."""
    own = 2 if a[2] and b[2] and not a[2].keys().isdisjoint(b[2]) else 1
    return own + sum(size_of_match(a[3][i], b[3][j]) for i, j in match(a[3], b[3])) if a[3] and b[3] else own


def merge(a: list, b: list) -> list:
    """The tree of the pages of both; a is changed."""
    a[1] += b[1]
    for text, n in b[2].items():
        a[2][text] = a[2].get(text, 0) + n
    if len(a[2]) > TEXTS:  # counts are lowered together, so that frequent texts stay
        least = sorted(a[2].values(), reverse=True)[TEXTS]
        a[2] = {t: n - least for t, n in a[2].items() if n > least}
    children, i0, j0 = [], 0, 0
    for i, j in [*match(a[3], b[3]), (len(a[3]), len(b[3]))]:
        children += [*a[3][i0:i], *b[3][j0:j]]
        if i < len(a[3]):
            children.append(merge(a[3][i], b[3][j]))
        i0, j0 = i + 1, j + 1
    a[3] = children
    return a


def host_of(url: str | None) -> str:
    """A page's host in small letters; empty where the url has none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def named_texts(tree: list, numbers: Iterator[int] | None = None) -> list:
    """The tree with a number for each node behind its children, and of its texts only the one that can stand on SAME of its pages."""
    numbers = numbers or count()
    number = next(numbers)
    least = max((SAME - 1 / (TEXTS + 1)) * tree[1] - 1e-9, 1)  # over half of the pages, so no two texts reach it
    texts = {t: n for t, n in tree[2].items() if n >= least and tree[1] >= PAGES}
    return [tree[0], tree[1], texts, [named_texts(c, numbers) for c in tree[3]], number]


def aligned(node: list, wrapper: list) -> Iterator[tuple[list, list]]:
    """Each node of a page's tree with its node of the wrapper."""
    for i, j in match(node[3], wrapper[3]):
        yield node[3][i], wrapper[3][j]
        yield from aligned(node[3][i], wrapper[3][j])


def main_text(page: str | None, wrapper: list | None, template: Collection[int] = ()) -> str:
    """The text outside template nodes of the wrapper: inside article or main where the page has such text, template or not, else everywhere."""
    own = full = blocks(page)
    article = any(b[2] for b in without_named(own, full))
    if wrapper is not None and template and own:
        root, texts = placed(own)
        constant = {n for a, b in aligned(root, wrapper) if b[4] in template and a[2] and a[2].keys() == b[2].keys() for n in texts[id(a)]}
        own = [b for n, b in enumerate(own) if n not in constant] if constant else own
    own = without_named(own, full)
    return " ".join(b[1] for b in own if b[2] or not article)


def page_hash(own: list[tuple[tuple, str, int, tuple]]) -> str:
    """Of labels and texts inside article or main where the page has such text, else of all; named elements are left out."""
    own = without_named(own, own)
    inside = [b for b in own if b[2]]
    return xxhash.xxh3_128_hexdigest(json.dumps([([label for _, label in b[0]], b[1]) for b in inside or own]))


def page_trees(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, page (a hash), tree (as JSON), sorted in partitions; all rows of one host and hash are in one partition."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[tuple] = set()
        for batch in batches:
            rows = []
            for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                own = blocks(page)
                row = (host_of(url), page_hash(own), json.dumps(tree(own)))
                key = (row[0], xxhash.xxh3_128_digest(row[2]))
                if key not in done:  # spares the shuffle most exact copies
                    done.add(key)
                    rows.append(row)
            if len(done) >= 100_000:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["host", "page", "tree"])

    own = pages.select(F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return own.mapInArrow(parse, "host string, page string, tree string").repartition("host", "page").sortWithinPartitions("host", "page", "tree")


def distinct_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str]]:
    """host and tree of the first row of each page of page_trees."""
    last = None
    for batch in batches:
        for host, page, raw in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "tree")), strict=True):
            if (host, page) != last:
                last = (host, page)
                yield host, raw


def wrappers(trees: DataFrame) -> DataFrame:
    """host, wrapper (a tree of named_texts as JSON) over all distinct pages of each host."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for host, own in groupby(distinct_pages(batches), key=itemgetter(0)):
            total = None
            for _, raw in own:
                total = json.loads(raw) if total is None else merge(total, json.loads(raw))
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (host, json.dumps(total))], names=["host", "wrapper"])

    def join(table: pa.Table) -> pa.Table:
        total = None
        for raw in sorted(table.column("wrapper").to_pylist()):
            own = json.loads(raw)
            total = own if total is None else merge(total, own)
        return pa.table({"host": table.column("host").slice(0, 1), "wrapper": pa.array([json.dumps(named_texts(total))])})

    return trees.mapInArrow(induce, "host string, wrapper string").groupBy("host").applyInArrow(join, "host string, wrapper string")


def templates(trees: DataFrame, found: DataFrame, small: bool) -> DataFrame:
    """host, template: the numbers of the nodes whose text stands on SAME of the distinct pages that have them, counted exactly."""

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list] = {}
        known: dict[str, list] = {}

        def full() -> pa.RecordBatch:
            rows = [(*k, *v) for k, v in seen.items()]
            seen.clear()
            types = pa.string(), pa.int64(), pa.int64(), pa.int64()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["host", "node", "n", "same"])

        for batch in batches:
            for host, tree, raw in zip(*(batch.column(c).to_pylist() for c in ("host", "tree", "wrapper")), strict=True):
                if host not in known:
                    if len(known) >= 1000:
                        known.clear()
                    known[host] = json.loads(raw)
                for a, b in aligned(json.loads(tree), known[host]):
                    if b[2]:
                        own = seen.setdefault((host, b[4]), [0, 0])
                        own[0] += 1
                        own[1] += a[2].keys() == b[2].keys()
            if len(seen) >= 100_000:
                yield full()
        yield full()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batched(distinct_pages(batches), 500):
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(2)], names=["host", "tree"])

    once = trees.mapInArrow(first, "host string, tree string").join(F.broadcast(found) if small else found, "host")
    counted = once.select("host", "tree", "wrapper").mapInArrow(recount, "host string, node long, n long, same long")
    total = counted.groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum("same").alias("same"))
    constant = total.filter((F.col("n") >= PAGES) & (F.col("same") >= SAME * F.col("n") - 1e-9))
    return constant.groupBy("host").agg(F.sort_array(F.collect_list("node")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for each page: the main text by its host's wrapper, empty for null or empty html.

    Pages without a host share one wrapper; repeated rows each come back.
    """
    trees = cut(page_trees(pages, url_col, html_col))
    found = cut(wrappers(trees))
    total = found.agg(F.coalesce(F.sum(F.octet_length("wrapper") + F.octet_length("host")), F.lit(0))).first()[0]
    small = total <= BROADCAST_BYTES
    found = cut(found.join(templates(trees, found, small), "host", "left"))
    own = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    id_type = own.schema["page_id"].dataType.simpleString()

    def with_host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("host", pa.array([host_of(u) for u in batch.column("url").to_pylist()], pa.string()))

    dealt = own.mapInArrow(with_host, f"page_id {id_type}, url string, html string, host string")
    joined = dealt.join(F.broadcast(found) if small else found, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            for part in slices(batch, "html"):
                texts = []
                for h, page, raw, template in zip(*(part.column(c).to_pylist() for c in ("host", "html", "wrapper", "template")), strict=True):
                    if h not in known:
                        if len(known) >= 1000:
                            known.clear()
                        known[h] = json.loads(raw) if raw else None, frozenset(template or ())
                    texts.append(main_text(page, *known[h]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    slim = joined.select("page_id", "url", "html", "host", "wrapper", "template")
    return slim.mapInArrow(run, f"page_id {id_type}, url string, text string, n_chars long")
