"""Main text of web pages: strings that a host's pages repeat are found with a suffix array and removed.

Markup gives blocks, and says of some what they are: menus, page headers and footers, asides, forms, adverts, notices and
comment sections by their elements, classes, ids and roles. All blocks of a page, those too, are one stream of tokens
with a mark between blocks. The streams of a host's pages are concatenated, and the suffix array of what stands there,
sorted by doubling to prefixes of `run` tokens, shows which strings of `run` tokens or more stand on several pages; a
longer repeated string is the union of such strings. What they cover is removed:

- Outside marked articles (article, main or that role) each block that is covered for four fifths, and in any block what
  half of the host's pages repeat.
- In a marked article only what starts or ends a block in the text of nearly all of the host's pages, of which there must
  be a few: a share line, 'read also', a licence notice. Passages that some articles share are main text, on hosts of few
  pages those that all share too, and so is what stands in other pages' adverts or menus.
- A block whose name may mean anything (related, share, social, toc, login ...) if half of it is covered.

A string counts if it is on `distinct_pages` pages or more, and on `share` of the host's. Then blocks that markup names
go, and of a page that marks its article what stands outside. Should a page lose most of its text to strings that fewer
than half of the pages repeat, it is a copy and keeps them; should it lose nearly all, it is kept whole.

Pages are distinct by the text beside their repeated strings: one of which less than `OWN` is left is no evidence of its
own, and such pages count as one where they are alike in their least frequent string.

A host with many pages is dealt into cells of about `cell` pages, each with a suffix array of its own. A string on `share`
of a host's pages is on `share` of some cell's, so each cell gives the strings that are so frequent in it, and these are
counted exactly on all pages. So no host is one task, and the result doesn't depend on how pages are dealt.

Markup is read once. The blocks of all pages are staged, as streams, and every later pass reads these.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, flat, joined, mixed, released, short_word_marks, sized, small, stage, whole_groups

#: Elements by what they do to the text.
HIDDEN = frozenset("nav footer aside form button select dialog menu datalist audio video canvas head".split())
BLOCK = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SPACED = frozenset("br td th option img input svg text mtr mtd".split())
RAW = frozenset("script style noscript template textarea title annotation-xml annotation metadata desc iframe noframes xmp".split())
#: Elements that end others which are still open, and where the search for these stops.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_P, _NOT_P = frozenset({"p"}), BLOCK - {"p"}
#: Names of what isn't main text, and names that may be.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|sponsor|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|sidebar|side-bar|footer|masthead"
    r"|cookie|cookies|consent|notice|notices|comment|comments|respond|reply|replies|disqus|skip-link)(?:$|[\s_-])", re.I)
OPEN_NAMED = re.compile(
    r"(?:^|[\s_-])(?:header|alert|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|recommendations|widget|pagination|pager|toolbar|toc)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_PLAIN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)>")
_STOP = re.compile(r"[>\"']")
_SAID = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
#: Characters of a tag's attributes that are read.
ATTRIBUTES = 4096

#: A page's own text is this share of its tokens at least.
OWN = 0.1
#: In marked articles strings are cut that stand in the text of this share of the host's pages, if it has so many.
FIRM, FIRM_PAGES = 0.9, 5
#: Bytes of pages whose tokens are made together.
AT_ONCE = 1 << 18
#: Between blocks, as a word of the token stream.
MARK = "\x1e"

Block = tuple[str, int, bool]  # text, kind, in a marked article
TEXT, MAYBE, CHROME = 0, 1, 2
WITHIN = 4


def main_text(pages: DataFrame, run: int = 8, distinct_pages: int = 3, share: float = 0.01, cell: int = 512, url: str = "url", markup: str = "html", with_markup: bool = True) -> DataFrame:
    """pages with `text` (blocks joined by an empty line, empty if none), `n_chars` (its code points, long) and `n_repeated` (strings of `run` tokens of the page, in its text or beside it, that the host repeats, long).

    Null html is empty; a null url's pages are one host. A page cut off anywhere, or with unclosed or stray tags, is
    read as far as it goes. Repeated rows count as one page where pages are counted. An empty table gives an empty
    table. Columns of pages that are named as a result column are replaced. Without with_markup the markup's column isn't
    given back. The columns given back are staged with the pages' blocks, so Parquet has to hold them.
    """
    own = [c for c in pages.columns if c.lower() not in ("text", "n_chars", "n_repeated") and (with_markup or c.lower() != markup.lower())]
    row = F.struct(*[F.col(f"`{c}`") for c in own])
    host = F.xxhash64(F.lower(F.coalesce(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1), F.lit(""))))
    rows = pages.select(row.alias("row"), host.alias("host"), F.col(markup).cast("string").alias("html"))
    rows = rows.select("row", "host", F.xxhash64(F.md5(F.coalesce("html", F.lit("")))).alias("page"), "html")
    kind = rows.schema["row"].dataType.simpleString()
    # Markup is read once; what follows works on the streams of blocks.
    rows = stage(rows.mapInArrow(_read, f"row {kind}, host long, page long, stream string, kinds binary"), "streams")
    read = rows.select("host", "page", "stream", "kinds")
    hosts = read.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    hosts = stage(hosts.withColumn("cells", F.ceil(F.col("pages") / cell).cast("int")), "hosts")

    dealt = read.join(small(hosts, 32), "host").withColumn("cell", F.pmod("page", "cells"))
    streams = dealt.select("host", "cell", "cells", "page", "stream").mapInArrow(_packed, "key long, host long, page long, cells int, stream binary")
    streams = streams.repartition("key").sortWithinPartitions("key", "page")
    strings = stage(streams.mapInArrow(partial(_repeated, run=run, distinct_pages=distinct_pages, share=share), "host long, gram long").distinct(), "strings")

    grams = read.mapInArrow(partial(_grams, run=run), "host long, page long, inner int, grams array<long>, within array<boolean>, touches array<tinyint>")
    grams = grams.select("host", "page", "inner", F.explode(F.arrays_zip("grams", "within", "touches")).alias("g")).select("host", "page", "inner", F.col("g.grams").alias("gram"), "g.within", "g.touches")
    hits = stage(grams.join(small(strings, 24), ["host", "gram"]).groupBy("host", "page", "gram").agg(F.max("inner").alias("inner"), F.count_if("within").alias("within"), F.max("touches").alias("touches")), "hits")
    found = stage(_found(hits, hosts, distinct_pages, share), "found")
    cuts = stage(hits.select("host", "page", "gram", "touches").join(small(found, 32), ["host", "gram"]), "cuts")
    # Only pages from whose text they may be cut need them.
    touched = stage(cuts.groupBy("host", "page").agg(F.count("*").alias("n_repeated"), F.bool_or((F.col("touches") > 1) | (F.col("touches") > 0) & (F.col("wide") > 1)).alias("touched")), "touched")
    lists = cuts.join(small(touched.filter("touched").select("host", "page"), 24), ["host", "page"]).groupBy("host", "page").agg(F.collect_list(F.struct("gram", "wide")).alias("grams"))
    cuts = touched.drop("touched").join(sized(stage(lists, "lists"), "grams", 12), ["host", "page"], "left")
    cuts = sized(stage(cuts, "page_cuts"), "grams", 12)
    out = rows.join(cuts, ["host", "page"], "left").select("row", "stream", "kinds", "grams", F.coalesce("n_repeated", F.lit(0)).alias("n_repeated"))
    out = out.mapInArrow(partial(_texts, run=run), f"row {kind}, text string, n_chars long, n_repeated long")
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], "text", "n_chars", "n_repeated")


def _found(hits: DataFrame, hosts: DataFrame, distinct_pages: int, share: float) -> DataFrame:
    """host, gram, wide (1 on half of the host's pages, 2 in the text of nearly all, of which there are a few) of the strings that are frequent, by distinct pages. hits: host, page, gram, inner, within (how many start in what may be text, in all and of this one)."""
    often = stage(hits.groupBy("host", "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= distinct_pages), "often")
    known = hits.join(small(often, 32), ["host", "gram"])
    inner = F.sum("within").alias("covered")
    least = F.min(F.struct((F.col("within") == 0).alias("beside"), "n", "gram")).alias("least")
    kinds = known.groupBy("host", "page").agg(F.max("inner").alias("inner"), inner, least)
    copied = F.col("inner") - F.col("covered") < F.greatest(F.lit(1.0), OWN * F.col("inner"))
    kinds = stage(kinds.select("host", "page", F.when(copied, F.col("least.gram")).otherwise(F.col("page")).alias("kind"), copied.alias("copied")), "kinds")
    # Pages without a repeated string are distinct too.
    less = kinds.groupBy("host").agg((F.count("*") - F.count_distinct("kind")).alias("less"))
    all_ = stage(hosts.join(less, "host", "left").select("host", (F.col("pages") - F.coalesce("less", F.lit(0))).alias("all")), "distinct_pages")
    each = known.select("host", "page", "gram", "within").join(small(kinds.select("host", "page", "kind"), 32), ["host", "page"])
    each = each.groupBy("host", "gram", "kind").agg(F.max("within").alias("within"))
    n = each.groupBy("host", "gram").agg(F.count("*").alias("n"), F.count_if(F.col("within") > 0).alias("inside"))
    n = n.join(small(all_, 24), "host").filter((F.col("n") >= distinct_pages) & (F.col("n") >= share * F.col("all")))
    firm = (F.col("all") >= FIRM_PAGES) & (F.col("inside") >= FIRM * F.col("all"))
    return n.select("host", "gram", F.when(firm, 2).when(2 * F.col("n") >= F.col("all"), 1).otherwise(0).alias("wide"))


def _tags(markup: str) -> Iterator[tuple[str, str, str, str]]:
    """Text, then what follows it: '' (no element), 'start', 'end' or 'raw' (an element without text), its name and its attributes.

    Each character is passed a fixed number of times: what isn't found once isn't looked for again.
    """
    at, n = 0, len(markup)
    missing: set[str] = set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        k = markup.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    text, open_at, plain_at = 0, markup.find, _PLAIN.match
    while True:
        at = open_at("<", at)
        if at < 0 or at + 1 >= n:
            yield markup[text : at if 0 <= at else n], "", "", ""
            return
        plain = plain_at(markup, at)
        if plain:
            slash, name = plain.groups()
            name = name.lower()
            if name not in RAW:
                yield markup[text:at], "end" if slash else "start", name, ""
                at = text = plain.end()
                continue
        c = markup[at + 1]
        if c in "!?":
            comment = markup.startswith("<!--", at)
            end = find("-->" if comment else ">", at + 2)
            yield markup[text:at], "", "", ""
            if end < 0:
                return
            at = text = end + (3 if comment else 1)
            continue
        m = _NAME.match(markup, at + 2 if c == "/" else at + 1)
        if not m:
            at += 1
            continue
        name, k = m[0].lower(), m.end()
        while True:  # to the end of the tag, over quoted values
            stop = _STOP.search(markup, k) if ">" not in missing else None
            if stop is None:
                yield markup[text:at], "", "", ""
                return
            k = stop.end()
            if stop[0] == ">":
                break
            before = k - 2
            while markup[before].isspace():
                before -= 1
            if markup[before] == "=":
                end = find(stop[0], k)
                if end >= 0:
                    k = end + 1
        said = markup[m.end() : min(k - 1, m.end() + ATTRIBUTES)]
        if c == "/":
            yield markup[text:at], "end", name, ""
        elif name in RAW or name == "svg" and "aria-hidden" in said:
            yield markup[text:at], "raw", name, said
            if not said.rstrip().endswith("/") or name != "svg":
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(markup, k) if f"</{name}" not in missing else None
                if close is None:
                    missing.add(f"</{name}")
                    return
                k = close.end()
        else:
            yield markup[text:at], "start", name, said
        at = text = k


def blocks_of(markup: str) -> list[Block]:
    """The blocks of a page in order: text, kind (TEXT, MAYBE or CHROME, by markup), in a marked article."""
    open_: list[tuple[str, int, bool]] = []  # name, kind, in an article
    count: dict[str, int] = {}
    out: list[Block] = []
    parts: list[str] = []
    kind, within = TEXT, False

    def end_block() -> None:
        if not parts:
            return
        text = "".join(parts)
        parts.clear()
        if not text or text.isspace():
            return
        if "&" in text:
            text = html.unescape(text)
        text = " ".join(text.replace(MARK, " ").split())
        if text:
            out.append((text, kind, within))

    def close(k: int) -> None:
        nonlocal kind, within
        above = open_[k - 1][1] if k else TEXT
        ends = False
        while len(open_) > k:
            name, own, _ = open_.pop()
            ends |= own != above or name in BLOCK
            count[name] -= 1
        if ends:
            end_block()
        _, kind, within = open_[-1] if open_ else ("", TEXT, False)

    def close_one(names: set[str] | frozenset[str], stops: set[str] | frozenset[str]) -> None:
        if not any(count.get(x) for x in names):
            return
        for k in range(len(open_) - 1, -1, -1):
            if open_[k][0] in names:
                close(k)
                return
            if open_[k][0] in stops:
                return

    for text, what, name, said in _tags(markup):
        if text:
            parts.append(text)
        if what == "raw":
            parts.append(" ")
        elif what == "end":
            if count.get(name):
                k = len(open_) - 1
                while open_[k][0] != name:
                    k -= 1
                close(k)
            elif name in BLOCK:
                parts.append(" ")
        elif what == "start":
            if name in BLOCK and count.get("p"):
                close_one(_P, _NOT_P)
            if name in ENDS:
                close_one(*ENDS[name])
            if name in BLOCK or name in HIDDEN:
                end_block()
            elif name in SPACED:
                parts.append(" ")
            if name in VOID or said.endswith("/") and (count.get("svg") or count.get("math")):
                continue
            told = _attributes(said) if said else {}
            own = CHROME if name in HIDDEN or name == "header" and not within else _kind(name, told)
            own = max(kind, own)
            here = within or own == TEXT and (name in ("article", "main") or told.get("role", "").lower() in ("main", "article"))
            if own != kind and name not in BLOCK:
                end_block()
            open_.append((name, own, here))
            count[name] = count.get(name, 0) + 1
            kind, within = own, here
    end_block()
    return out


@lru_cache(1 << 12)
def _attributes(said: str) -> dict[str, str]:
    """What a tag says of the names in _SAID."""
    return {k.lower(): a or b or c for k, a, b, c in _SAID.findall(said)}


def _kind(name: str, said: dict[str, str]) -> int:
    if not said:
        return TEXT
    if name in ("html", "body", "article", "main") and said.get("role", "").lower() not in ROLES and not _COMMENTS.search(said.get("class", "")):
        return TEXT
    names = [said.get(k, "") for k in ("class", "id")]
    style = said.get("style", "").replace(" ", "").lower()
    if "hidden" in said and not said["hidden"] or said.get("aria-hidden", "").lower() == "true" or "display:none" in style or said.get("role", "").lower() in ROLES or any(map(NAMED.search, names)):
        return CHROME
    return MAYBE if any(map(OPEN_NAMED.search, names)) else TEXT


def _stream(blocks: list[Block]) -> tuple[str, bytes]:
    """The blocks' words with a mark before each block and one behind the last, and each block's kind, plus WITHIN in a marked article."""
    return "".join([MARK, *(f" {b[0]} {MARK}" for b in blocks)]), bytes([b[1] | WITHIN * b[2] for b in blocks])


def _blocks(stream: str, kinds: bytes) -> list[Block]:
    """The blocks that _stream was given."""
    texts = stream[2:-2].split(f" {MARK} ") if kinds else []
    return [(x, k & ~WITHIN, k >= WITHIN) for x, k in zip(texts, kinds, strict=True)]


@released
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: row, host, page, html."""
    for batch in batches:
        streams, kinds = [], []
        for x in batch.column(3):
            stream, own = _stream(blocks_of(x.as_py() or ""))
            streams.append(stream)
            kinds.append(own)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(streams, pa.string()), pa.array(kinds, pa.binary())], ["row", "host", "page", "stream", "kinds"])


def _starts(blocks: list[Block]) -> np.ndarray:
    """Where each block's mark is in the tokens."""
    return np.cumsum([0, *(b[0].count(" ") + 2 for b in blocks)])


def _may(blocks: list[Block]) -> list[bool]:
    """Which blocks may be in the text."""
    marked = any(b[2] for b in blocks)
    return [b[1] != CHROME and (b[2] or not marked) for b in blocks]


def _run_marks(tokens: np.ndarray, run: int) -> np.ndarray:
    """The fingerprint of the `run` tokens that start at each place, each time that of half as many and that of those behind them; the last two may overlap."""
    out, n = tokens.astype(np.uint64), 1
    while n < run:
        step = min(n, run - n)
        out, n = joined(out[: max(0, len(out) - step)], out[step:]), n + step
    return mixed(out).view(np.int64)


@released
def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns: host, cell, cells, page, stream."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        host, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        key = mixed(host.view(np.uint64) ^ mixed(cell.astype(np.uint64) + np.uint64(1))).view(np.int64)
        data, offsets = flat(batch.column(4))
        packed = [packer.compress(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(key), batch.column(0), batch.column(3), batch.column(2), pa.array(packed, pa.binary())], ["key", "host", "page", "cells", "stream"])


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the streams' tokens, 32 bits of each, which are enough to compare runs of them, and where each stream's begin."""
    marks, at = short_word_marks(data, offsets)
    return marks.astype(np.uint32), at


def suffix_order(streams: list[np.ndarray], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of the concatenated streams (place, stream) in the order of their first `run` tokens or more, and each one's rank: equal if these are.

    By doubling: the rank of up to 2h tokens is that of the pair of ranks of h tokens, here and later. A stream's end is a
    token of its own, so no prefix of `run` tokens that two streams share goes over it.
    """
    size = np.array([len(x) + 1 for x in streams], np.int64)
    stream, ends = np.repeat(np.arange(len(streams)), size), np.cumsum(size) - 1
    names = np.concatenate([np.append(x.astype(np.int64), 0) for x in streams]) if streams else np.zeros(0, np.int64)
    names[ends] = (1 << 33) + np.arange(len(streams))
    rank, h = _ranks(names), 1
    while h < run:
        step = min(h, run - h)  # the last pairs overlap
        later = np.full(len(rank), -1, np.int64)
        later[: len(rank) - step] = rank[step:]
        rank = _ranks(rank * (len(rank) + 1) + later + 1)
        h += step
    order = np.sort((rank << 32) | np.arange(len(rank))) & ((1 << 32) - 1)  # equal prefixes by place
    return order, stream, rank


def _ranks(names: np.ndarray) -> np.ndarray:
    """Each name's place among the different ones, in order."""
    order = np.argsort(names)
    names = names[order]
    rank = np.empty(len(names), np.int64)
    rank[order] = np.cumsum(np.concatenate([[False], names[1:] != names[:-1]])[: len(names)])
    return rank


@released
def _repeated(batches: Iterator[pa.RecordBatch], run: int, distinct_pages: int, share: float) -> Iterator[pa.RecordBatch]:
    """host, gram: strings that are frequent in a cell. Columns: key, host, page, cells, stream, sorted by key and page."""
    unpacker = zstandard.ZstdDecompressor()
    for table in whole_groups(batches, 0, 1):
        hosts, grams = [], []
        key, page = table.column(0).to_numpy(), table.column(2).to_numpy()
        for _, own in groupby(range(len(key)), key=key.__getitem__):
            own = [i for i in own if not i or key[i] != key[i - 1] or page[i] != page[i - 1]]  # a repeated row is one page
            whole = table.column(3)[own[0]].as_py() == 1
            least = max(distinct_pages if whole else 2, int(np.ceil(share * len(own) - 1e-9)))
            if len(own) < least:
                continue
            streams = []
            for _, _, data, offsets in chunks(pa.array([unpacker.decompress(table.column(4)[i].as_py()) for i in own], pa.binary()), AT_ONCE):
                tokens, at = _tokens(data, offsets)
                streams += np.split(tokens, at[1:-1])
            order, stream, rank = suffix_order(streams, run)
            sorted_, of = rank[order], stream[order]
            starts = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
            first = np.concatenate([[True], of[1:] != of[:-1]])
            first[starts] = True
            pages = np.add.reduceat(first, starts, dtype=np.int64)  # distinct ones, of each prefix
            at = order[starts[pages >= least]]
            flat_tokens = np.concatenate([np.append(x, np.uint32(0)) for x in streams])
            at = at[at + run <= len(flat_tokens)]
            grams.append(_run_marks(flat_tokens[at[:, None] + np.arange(run)].ravel(), run)[::run])
            hosts.append(np.full(len(at), table.column(1)[own[0]].as_py(), np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*hosts, np.zeros(0, np.int64)])), pa.array(np.concatenate([*grams, np.zeros(0, np.int64)]))], ["host", "gram"])


def _may_tokens(kinds: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Whether each token is in what may be text: 1 if only the widest strings are cut there, else 2. marks: which tokens stand before a block or at a stream's end."""
    kind, ends = flat(kinds)
    n = np.diff(ends)
    page = np.repeat(np.arange(len(n)), n)
    within = kind >= WITHIN
    marked = np.bincount(page[within], minlength=len(n)) > 0
    kind = kind & ~np.uint8(WITHIN)
    may = np.where((kind != CHROME) & (within | ~marked[page]), np.where(within & (kind == TEXT), 1, 2), 0).astype(np.int8)
    may = np.insert(may, ends[1:], 0)  # a stream's last mark
    out = may[np.cumsum(marks) - 1]
    out[marks] = 0
    return out


@released
def _grams(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Each page's runs of tokens, whether each starts in what may be text, how many do, and what each touches: 1 what only the widest strings are cut from, 2 other text. Columns: host, page, stream, kinds."""
    mark = short_word_marks(np.frombuffer(MARK.encode(), np.uint8), np.array([0, 1]))[0].astype(np.uint32)[0]
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(2), AT_ONCE):
            tokens, at = _tokens(data, offsets)
            may = _may_tokens(batch.column(3).slice(first, end - first), tokens == mark)
            n = np.maximum(0, np.diff(at) - run + 1)
            start = np.repeat(at[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            runs = _run_marks(tokens, run)
            before, soft = (np.concatenate([[0], np.cumsum(x)]) for x in (may > 0, may > 1))
            within = may[start] > 0
            touches = ((before[start + run] > before[start]).astype(np.int8) + (soft[start + run] > soft[start])).astype(np.int8)
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            inner = np.diff(np.concatenate([[0], np.cumsum(within)])[ends])
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (runs[start], within, touches)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, len(n)) for k in (0, 1)), pa.array(inner, pa.int32()), *lists], ["host", "page", "inner", "grams", "within", "touches"])


def _covered(runs: np.ndarray, found: np.ndarray, block: np.ndarray, run: int) -> np.ndarray:
    """Which tokens the found runs cover: those in a block, and blocks that are covered from end to end by runs that go on beyond."""

    def cover(at: np.ndarray) -> np.ndarray:
        edge = np.zeros(len(block) + 1, np.int32)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + run, -1)
        return np.cumsum(edge[:-1]) > 0

    at = np.flatnonzero(np.isin(runs, found))
    whole = np.ones(block[-1] + 1, bool)
    whole[block[~cover(at)]] = False
    return cover(at[block[at] == block[at + run - 1]]) | whole[block]


def without_repeats(blocks: list[Block], found: dict[int, int], run: int) -> list[str]:
    """The page's text as blocks. found: the host's repeated runs, and how wide they are."""
    may = np.array(_may(blocks), bool)
    starts = _starts(blocks)
    n = int(starts[-1]) + 1
    data = np.frombuffer(_stream(blocks)[0].encode(), np.uint8)
    runs = _run_marks(_tokens(data, np.array([0, len(data)]))[0], run)
    block = np.searchsorted(starts, np.arange(n), "right") - 1
    apart = 2 * block
    apart[starts] += 1  # the marks
    some = _covered(runs, np.array(list(found), np.int64), apart, run)
    wide, firm = (_covered(runs, np.array([k for k, x in found.items() if x >= least], np.int64), apart, run) for least in (1, 2))
    gone, rough = np.zeros(n, bool), np.zeros(n, bool)  # by strings of half of the pages or more; by others too
    keep = may.copy()
    for i, (_, kind, within) in enumerate(blocks):
        lo, hi = int(starts[i]) + 1, int(starts[i + 1])
        w = (firm if within else wide)[lo:hi]
        if within:
            ahead, behind = int(np.argmin(w)) if not w.all() else len(w), int(np.argmin(w[::-1])) if not w.all() else len(w)
            gone[lo : lo + ahead] = gone[hi - behind : hi] = True
        else:
            gone[lo:hi] = w
            rough[lo:hi] = some[lo:hi].mean() >= 0.8
        if kind == MAYBE and may[i]:
            keep[i] = some[lo:hi].mean() < 0.5
    texts = np.append(keep, False)[np.minimum(block, len(blocks))]
    texts[starts] = False
    all_ = int(texts.sum())
    if 2 * int((texts & (gone | rough)).sum()) <= all_:
        gone = gone | rough
    else:  # a copy: what stands outside its text still goes
        gone = np.where(texts, gone, gone | rough)
    if all_ - int((texts & gone).sum()) < OWN * all_:
        gone &= ~texts
    out = []
    for i, (text, _, _) in enumerate(blocks):
        if keep[i]:
            lost = gone[int(starts[i]) + 1 : int(starts[i + 1])]
            left = " ".join(t for t, x in zip(text.split(" "), lost, strict=True) if not x) if lost.any() else text
            out += [left] if left else []
    return out


@released
def _texts(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Columns: row, stream, kinds, grams, n_repeated."""
    for batch in batches:
        texts = []
        for x, kinds, found in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            blocks = _blocks(x.as_py(), kinds.as_py())
            grams = found.as_py()
            own = without_repeats(blocks, {g["gram"]: g["wide"] for g in grams}, run) if grams else [b[0] for b, ok in zip(blocks, _may(blocks), strict=True) if ok]
            texts.append("\n\n".join(own))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64()), batch.column(4)], ["row", "text", "n_chars", "n_repeated"])
