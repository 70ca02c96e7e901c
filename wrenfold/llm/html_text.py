"""Main text of web pages by a site style tree.

Pages of a host are merged into one tree whose nodes are paths of block elements (tag, class and id). A node's
importance is composed, as in the published style tree method, of its presentation (the entropy of its styles over
pages: child sequence, amount of text and share of links) and its content (one minus the mean entropy of its features
over pages: amounts, and the words; what every page has tells nothing). A menu of six links or an advert of
one sentence is predicted by its amounts even where no two pages have the same words; an article is not. A branch goes
if it and all that stands under it are of low importance.

Names of roles (nav, footer, class "ad", article, ...) are a prior, which can be switched off: a branch that they call
no article goes in any case, and one that they call an article is not judged as a whole.
"""

from __future__ import annotations

import html as _html
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, plus, table
from .urlfilter import host

#: Importance under which a branch goes, the weight's base, the logarithms' base at most, and the pages that all hosts
#: together count as.
LOW, GAMMA, BASE, PRIOR_PAGES = 0.5, 0.9, 32, 8
#: Features that a task counts before it hands them on, about; the bytes of pages for a slice of hashes, as a power of two.
FEATURES, SLICE = 1 << 20, 23
#: Rows of removed branches that are broadcast at most (a row: host and id); more are joined by shuffle.
BROADCAST_ROWS = 100_000
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead title tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that stand where running text stands.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption".split())
_DROP_TAGS = frozenset("head nav footer aside form script style noscript template iframe object svg canvas audio video button select textarea input menu dialog title fieldset datalist".split())
#: Elements whose text isn't shown as text.
_SILENT = frozenset("head script style noscript template iframe object svg canvas audio video title datalist".split())
_RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"))
_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I) for tag in _RAW}
_DROP_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars "
    "footer masthead cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login social share sharing related "
    "recommended recommendations comment comments commentlist discussion disqus respond reply replies widget widgets pagination pager toolbar skip copyright form search topbar header".split()
)
_MAIN_NAMES = frozenset("article content main post entry story".split())
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What an opening tag closes, and the elements it looks for them in.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPE = frozenset("ul ol dl table tbody thead tfoot div article section main body nav aside form blockquote footer header td th".split())
# an odd quote counts as a character, so a tag never fails to match, and no text is scanned twice
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


class Node:
    """An element. over: the block element that it stands in; inline elements are no nodes of the tree."""

    __slots__ = ("alive", "dropped", "gone", "id", "kids", "linked", "links", "main", "over", "tag", "texts", "words")

    def __init__(self, above: Node | None, tag: str, ident: int):
        self.tag, self.id, self.over = tag, ident, above if not above or above.tag in _BLOCK or not above.over else above.over
        self.main, self.dropped, self.linked = (above.main, above.dropped, above.linked) if above else (0, False, False)
        self.alive = self.gone = False
        self.kids: dict[str, int] = {}
        self.words = self.links = 0
        self.texts: list[str] = []


class Page:
    """The blocks of a page in order: (text, element, block element). Time and memory are linear in the source.

    prior: names of roles (nav, class "ad", article, ...) count. low: ids of branches of low importance.
    """

    def __init__(self, source: str, prior: bool = True, low: frozenset[int] | set[int] = frozenset()):
        self.prior = prior
        root = Node(None, "", 0)
        self.blocks: list[tuple[str, Node, Node]] = []
        self.nodes = [root]
        self._stack, self._text, self._links = [root], [], 0
        self._where: dict[str, list[int]] = {}  # of each tag its places in the stack
        self._scopes: list[int] = []
        at = 0
        while at < len(source):
            m = _TOKEN.search(source, at)
            if not m:
                self._say(source[at:])
                break
            if m.start() > at:
                self._say(source[at : m.start()])
            at = m.end()
            tag = m[2]
            if tag is None:
                if m[0].startswith("<![CDATA["):
                    self._say(_html.escape(m[0][9:].removesuffix("]]>")))
                continue
            tag = tag.lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in _RAW:
                end = _END[tag].search(source, at)
                at = end.start() if end else len(source)
        self._flush()
        for n in reversed(self.nodes):  # children come after their parents
            n.alive |= n.id not in low
            if n.over:
                n.over.words += n.words
                n.over.links += n.links
                n.over.alive |= n.alive
        for n in self.nodes[1:]:
            # running text is judged with the branch that it stands in; so is an article that the prior names
            n.gone = n.over.gone or not n.alive and n.tag not in _FLOW and not (prior and n.main > n.over.main)

    def _say(self, text: str) -> None:
        self._text.append(text)
        if self._stack[-1].linked:
            self._links += len(text.split())

    def _flush(self) -> None:
        if self._text:
            text = " ".join(_html.unescape("".join(self._text)).split())
            links, self._text, self._links = self._links, [], 0
            if text:
                node = self._stack[-1]
                block, n = node if node.tag in _BLOCK or not node.over else node.over, text.count(" ") + 1
                self.blocks.append((text, node, block))
                if not node.dropped:
                    block.words += n
                    block.links += min(n, links)
                    block.texts.append(text)

    def _pop_to(self, k: int) -> None:
        if any(n.tag in _BLOCK for n in self._stack[k:]):
            self._flush()
        for n in reversed(self._stack[k:]):
            self._where[n.tag].pop()
            if n.tag in _SCOPE:
                self._scopes.pop()
        del self._stack[k:]

    def _close(self, tag: str) -> None:
        if tag in _BLOCK:
            self._flush()
        elif tag in ("td", "th"):
            self._text.append(" ")
        places = self._where.get(tag)
        if places and (tag in _BLOCK or not self._scopes or self._scopes[-1] <= places[-1]):
            self._pop_to(places[-1])

    def _open(self, tag: str, rest: str) -> None:
        if tag in ("br", "td", "th", "hr"):
            self._text.append(" ")
        shut = _CLOSES.get(tag, ("p",) if tag in _BLOCK else ())
        k = max((self._where[t][-1] for t in shut if self._where.get(t)), default=0)
        if k and (not self._scopes or self._scopes[-1] <= k):
            self._pop_to(k)
        if tag in _BLOCK:
            self._flush()
        if tag in _VOID:
            return
        above, name, names, role, hidden = self._stack[-1], tag, set(), "", False
        if rest and not rest.isspace():
            attrs = {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(rest)}
            label = f"{attrs.get('class', '')} {attrs.get('id', '')}"
            names = {x.lower() for x in _NAME.findall(label)}
            role = attrs.get("role", "").lower()
            hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))
            shown = re.sub(r"\d+", "#", " ".join(label.split()))
            name = f"{tag}[{shown}]" if shown else tag
        node = Node(above, tag, above.id if tag not in _BLOCK else xxhash.xxh64_intdigest(name, above.id))
        dropped = hidden or tag in _SILENT
        if self.prior:
            main = 2 if tag in ("article", "main") or role in ("main", "article") else 1 if names & _MAIN_NAMES and tag in ("div", "section", "td") else 0
            named = names & _DROP_NAMES and not (tag in ("body", "html") or main == 2 and not names & {"comment", "comments", "related", "reply", "ad", "ads", "advert", "sponsored", "promo"})
            if tag == "header" or names and names & _DROP_NAMES == {"header"}:
                named = not above.main and main < 2  # a header inside the article belongs to it
            dropped |= tag in _DROP_TAGS or bool(named) or role in _DROP_ROLES
            node.main = max(main, above.main)
        node.dropped |= dropped
        node.linked |= tag == "a"
        if tag in _BLOCK:
            node.over.kids[name] = node.over.kids.get(name, 0) + 1
            self.nodes.append(node)
        self._where.setdefault(tag, []).append(len(self._stack))
        if tag in _SCOPE:
            self._scopes.append(len(self._stack))
        self._stack.append(node)


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def _hash(text: str) -> int:
    return _signed(xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")))


def _amount(words: int, links: int) -> str:
    """The class of a text's length (powers of two) and of the share of its words in links (none, some, most)."""
    return f"{words.bit_length()} {0 if not links else 1 if 2 * links < words else 2}"


def page_parts(source: str) -> dict[tuple[int, str], set]:
    """The features of a page by (id, kind): of each node its style (s: child sequence and amount of text) and of its own
    texts the amounts (a), as hashes, and the words (w), as they are."""
    out: dict[tuple[int, str], set] = defaultdict(set)
    for n in Page(source, prior=False).nodes[1:]:
        if n.dropped:
            continue
        kids = " ".join(f"{k}*{c.bit_length()}" for k, c in n.kids.items())
        out[n.id, "s"].add(_hash(f"{kids}|{_amount(n.words, n.links)}"))
        if n.words:
            out[n.id, "a"].add(_hash(_amount(n.words, n.links)))
        for text in n.texts:
            out[n.id, "w"].update(text.split())
    return out


def page_features(source: str) -> set[tuple[int, str, int]]:
    """(id, kind, f) of a page, see `page_parts`; f: a hash."""
    return {(_signed(i), kind, _hash(f) if kind == "w" else f) for (i, kind), found in page_parts(source).items() for f in found}


class _Hashes(dict):
    """The hash of each word, as an unsigned number."""

    def __missing__(self, word: str) -> int:
        if len(self) >= FEATURES >> 2:
            self.clear()  # memory stays bounded, however many words there are
        self[word] = h = _hash(word) & (1 << 64) - 1
        return h


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary for each row: the values up to its end."""
    offsets = np.concatenate(([0], ends)) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return np.flatnonzero(new)


#: Features of one node, kind and slice: of each host (key) the number of its features, and of each feature the hash and the pages.
_PACKED = "id long, kind string, slice int, keys binary, sizes binary, fs binary, cs binary"


def _pack(kinds: list[tuple[int, str]], runs: list[tuple[int, int, int]], fs: np.ndarray, bits: int) -> pa.RecordBatch:
    """Rows of _PACKED for runs (index in kinds, key, number of fs); equal features are counted."""
    which, key, size = np.array(runs, np.int64).reshape(-1, 3).T
    names, at = np.unique(key, return_inverse=True)
    narrow = lambda x: x.astype(np.uint16 if len(x) == 0 or x.max() < 1 << 16 else np.uint32)  # noqa: E731  sorted by counting
    which, at, part = np.repeat(narrow(which), size), np.repeat(narrow(at), size), narrow(fs >> np.uint64(64 - bits))
    order = np.lexsort((fs, at, part, which))
    which, at, part, fs = which[order], at[order], part[order], fs[order]
    once = _starts(which, at, part, fs)
    cs = np.diff(np.append(once, len(fs))).astype(np.uint32)
    which, at, part, fs = which[once], at[once], part[once], fs[once]
    run, row = _starts(which, part, at), _starts(which, part)
    ends = np.append(row[1:], len(fs))
    run_ends = np.searchsorted(run, ends)
    ids, kind = np.array([_signed(i) for i, _ in kinds], np.int64), pa.array([k for _, k in kinds], pa.string())
    columns = [
        pa.array(ids[which[row]]), kind.take(pa.array(which[row])), pa.array(part[row].astype(np.int32)),
        _packed(names[at[run]], run_ends), _packed(np.diff(np.append(run, len(fs))).astype(np.uint32), run_ends), _packed(fs, ends), _packed(cs, ends),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "kind", "slice", "keys", "sizes", "fs", "cs"])


def _features(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key of the host, html) to rows of _PACKED; a feature's slice is its first bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, kinds, runs, fs = _Hashes(), {}, [], array("Q")
        for b in batches:
            for key, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for what, found in page_parts(source).items():
                    runs.append((kinds.setdefault(what, len(kinds)), key, len(found)))
                    fs.extend(map(hashes.__getitem__, found) if what[1] == "w" else (f & (1 << 64) - 1 for f in found))
                if len(fs) >= FEATURES:
                    yield _pack(list(kinds), runs, np.array(fs, np.uint64), bits)
                    kinds, runs, fs = {}, [], array("Q")
        if runs:
            yield _pack(list(kinds), runs, np.array(fs, np.uint64), bits)

    return run


def _sums(b: pa.Table) -> pa.RecordBatch:
    """Rows of _PACKED, all of each (id, kind, slice), to (key, id, kind, n, styles, clogc): of a host, and of all (key null).

    n: the sum of the features' pages; styles: the number of features; clogc: the sum of c log c of their pages c.
    """
    b = b.combine_chunks()
    join = lambda name, kind: np.frombuffer(b"".join(b.column(name).to_pylist()), kind)
    keys, sizes, fs, cs = join("keys", np.int64), join("sizes", np.uint32), join("fs", np.uint64), join("cs", np.uint32).astype(np.int64)
    ids, kinds = b.column("id").to_numpy(), np.array(b.column("kind").to_pylist())
    node = np.zeros(len(ids), np.int64)  # of a row: which (id, kind); they are sorted
    node[1:] = np.cumsum((ids[1:] != ids[:-1]) | (kinds[1:] != kinds[:-1]))
    first = _starts(node)
    node = np.repeat(node, np.array([len(x) // 8 for x in b.column("fs").to_pylist()], np.int64))
    key = np.repeat(keys, sizes)
    order = np.lexsort((key, fs, node))
    node, key, fs, cs = node[order], key[order], fs[order], cs[order]
    out = []
    for columns in ((node, fs, key), (node, fs)):  # of each host, and of all
        at = _starts(*columns)
        c, group = np.add.reduceat(cs, at), [x[at] for x in (columns[0], *columns[2:])]
        if len(group) > 1:
            order = np.lexsort(group[::-1])
            c, group = c[order], [x[order] for x in group]
        at = _starts(*group)
        of = first[group[0][at]]
        hosts = pa.array(group[1][at]) if len(group) > 1 else pa.nulls(len(at), pa.int64())
        out.append([hosts, pa.array(ids[of]), pa.array(kinds[of].tolist(), pa.string()), pa.array(np.add.reduceat(c, at)), pa.array(np.diff(np.append(at, len(c)))), pa.array(np.add.reduceat(c * np.log(c), at))])
    return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(*out, strict=True)], ["key", "id", "kind", "n", "styles", "clogc"])


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_sums of sorted rows of _PACKED, in batches of any size."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        last = [b.column(k)[b.num_rows - 1].as_py() for k in range(3)]
        begin = b.num_rows - 1  # of the last (id, kind, slice), which may go on in the next batch
        while begin and [b.column(k)[begin - 1].as_py() for k in range(3)] == last:
            begin -= 1
        if begin or held and [held[-1].column(k)[held[-1].num_rows - 1].as_py() for k in range(3)] != last:
            yield _sums(pa.Table.from_batches([*held, b.slice(0, begin)]))
            held = []
        held.append(b.slice(begin))
    if held:
        yield _sums(pa.Table.from_batches(held))


def sums(pages: DataFrame) -> DataFrame:
    """(key, id, kind, n, styles, clogc) of the nodes of hosts, and of all hosts together (key null), for pages (host, html).

    key: the host's hash. Each feature goes through the shuffle once, as its hash in a binary of its node and slice of
    hashes, so that what a host's pages and what all pages tell is counted in one place; slices keep binaries small.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    bits = min(max((size >> SLICE).bit_length(), 8), 16)
    found = pages.select(F.xxhash64("host").alias("key"), "html").mapInArrow(_features(bits), _PACKED)
    found = found.repartition("id", "kind", "slice").sortWithinPartitions("id", "kind", "slice")
    found = found.mapInArrow(_tally, "key long, id long, kind string, n long, styles long, clogc double")
    return found.groupBy("key", "id", "kind").agg(*(F.sum(c).alias(c) for c in ("n", "styles", "clogc")))


def importance(each: DataFrame, *by: str) -> DataFrame:
    """(by, n_pages, importance) of nodes, from sums (by, kind, n, styles, clogc) over their features.

    Presentation: the entropy of a node's styles. Content: one minus the mean entropy of its features over pages, of
    amounts and of words alike. Logarithms are to the base of the node's pages, of at most BASE. A node with many styles
    is told by its presentation, one with few by its content.
    """
    node = each.groupBy(*by).agg(*(F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{c}") for k in "saw" for c in ("n", "styles", "clogc")))
    m = F.col("s_n").cast("double")
    base = F.log(F.least(F.greatest(m, F.lit(2.0)), F.lit(float(BASE))))
    shape = F.least(F.lit(1.0), (F.log(m) - F.col("s_clogc") / m) / base)
    spread = lambda k: F.when(F.col(f"{k}_n").isNotNull(), F.least(F.lit(1.0), F.col(f"{k}_clogc") / F.col(f"{k}_n") / F.log(F.greatest(m, F.lit(2.0)))))
    # a node without text of its own is told by the amount of text under it
    told = 1 - F.coalesce((spread("a") + spread("w")) / 2, spread("a"), F.lit(1.0))
    weight = F.pow(F.lit(GAMMA), F.col("s_styles").cast("double"))
    return node.select(*by, F.col("s_n").alias("n_pages"), F.when(m <= 1, 1.0).otherwise((1 - weight) * shape + weight * told).alias("importance"))


def style_tree(pages: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(host, id, n_pages, importance) of the nodes of each host's merged tree, for pages (host, html).

    What a host's pages tell is joined with what the same node of all hosts tells, which counts as PRIOR_PAGES pages:
    so a host with few pages borrows from the others, and one page alone tells nothing. The nodes are written to the
    scratch tables, if there are any, so that they are not found twice.
    """
    nodes = importance(sums(pages), "key", "id")
    nodes = scratch.put(nodes, "nodes") if scratch else nodes
    own = nodes.join(pages.select("host").distinct().withColumn("key", F.xxhash64("host")), "key")
    everywhere = nodes.where("key IS NULL").select("id", F.col("importance").alias("all"))
    seen = F.col("n_pages") - 1
    return own.join(everywhere, "id").select("host", "id", "n_pages", ((seen * F.col("importance") + PRIOR_PAGES * F.col("all")) / (seen + PRIOR_PAGES)).alias("importance"))


def main_text(source: str, low: set[int] | frozenset[int] = frozenset(), prior: bool = True) -> str:
    """The page's main text without the branches in `low` (ids as signed numbers)."""
    page = Page(source, prior, {x & ((1 << 64) - 1) for x in low})
    kept = [(text, node, block) for text, node, block in page.blocks if not node.dropped]
    most = max((node.main for _, node, _ in kept), default=0)
    return "\n\n".join(text for text, node, block in kept if node.main == most and not block.gone)


def extract(scratch: Scratch, pages: DataFrame, url_col: str = "url", html_col: str = "html", prior: bool = True) -> DataFrame:
    """pages with text: the main text ("" if none) of the whole html (null: empty).

    prior: element, class and role names tell a role, before any evidence; without, the style tree alone decides.
    Null urls share a host of no name. Rows are kept as often as they come; a column named text is replaced.
    """
    pages = pages.drop("text", "_host", "_low", "_key")
    with_host = pages.withColumn("_host", F.coalesce(host(F.col(url_col)), F.lit("")))
    source = F.coalesce(html_col, F.lit(""))
    tree = style_tree(with_host.select(F.col("_host").alias("host"), source.alias("html")), scratch)
    low = scratch.put(tree.where(F.col("importance") < LOW).select("host", "id"), "low")
    scratch.drop("nodes")
    if low.count() <= BROADCAST_ROWS:
        by_host = low.groupBy(F.col("host").alias("_host")).agg(F.collect_set("id").alias("_low"))
        with_low = with_host.join(F.broadcast(by_host), "_host", "left")
    else:
        # each page gets the branches that it has itself; its html is shuffled by page, so no host is a hot key
        keyed = with_host.withColumn("_key", F.xxhash64(url_col, html_col))
        has = keyed.select("_key", "_host", source.alias("html")).mapInArrow(_branches, "key long, host string, id long")
        by_page = has.join(low, ["host", "id"]).groupBy(F.col("key").alias("_key")).agg(F.collect_set("id").alias("_low"))
        with_low = keyed.join(by_page, "_key", "left")
    names = pages.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sources, lows = b.column(names.index(html_col)).to_pylist(), b.column(len(names)).to_pylist()
            text = [main_text(s or "", set(x or ()), prior) for s, x in zip(sources, lows, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(text, pa.string())], [*names, "text"])

    return with_low.select(*names, "_low").mapInArrow(run, plus(pages, text="string"))


def _branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, host, html) to (key, host, id) of each branch."""
    for b in batches:
        rows = [(k, h, i) for k, h, source in zip(*(c.to_pylist() for c in b.columns), strict=True) for i in {_signed(n.id) for n in Page(source, False).nodes[1:]}]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.int64()))], ["key", "host", "id"])


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    out = extract(Scratch(spark, "op2"), table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
