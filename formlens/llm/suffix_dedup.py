"""Removal of long byte strings that occur more than once, by bucket-pointer refinement over a sparse suffix array.

Two equal windows of `length` bytes hold the same least 64-gram (by fingerprint, leftmost of equals) at the same
place. So the suffixes that start at these anchors, about one in 170 bytes, are sorted into initial 64-gram buckets
by Spark. A bucket of one suffix can't repeat. A bucket whose suffixes all have the same surroundings repeats as a
whole. The rest, at the edges of repeats, is refined: the bucket of a 2g-gram is named by the bucket of its g-gram and
that at the later offset g, and these names are used again for 4g-grams, up to `length`; then the buckets are sorted.

A bucket with more than `bucket_rows` different surroundings is split by Spark into runs of window starts: a run goes
on in the bucket of the bytes that all its windows share, equal runs are counted and one stays. At a run of one window
the count alone decides, so no bucket, however large, has to meet in one task.

Runs of words are found in the same way: a text's symbols are then its words, as fingerprints of 8 bytes each, in
place of its bytes, and the initial buckets are of 8 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SHORT, byte_marks, chunks, flat, joined, mixed, released, short_word_marks, sized, small, stage, whole_groups

GRAM = 64
#: Bytes of a word's fingerprint. The initial buckets are of GRAM bytes, or of as many words as take GRAM bytes.
MARK = 8
#: Runs of window starts that a crowded bucket is split into, each time.
PARTS = 8

_ANCHOR = "gram long, around long, fp binary, at int, low int, high int"
_PIECE = "bucket long, around long, fp binary, at int, low int, high int, near int, far int, many boolean, bytes binary"
_SPAN = "fp binary, low int, high int"
_SPANS = "fp binary, _spans array<struct<low: int, end: int, worded: boolean>>"
_RESULT = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")
_APART = "n_passage_bytes"


def remove_repeats(docs: DataFrame, column: str = "text", length: int = 400, bucket_rows: int = 4096, with_kept: bool = True, words: int | None = None, apart: bool = False) -> DataFrame:
    """docs with `n_bytes`, `n_removed`, `n_spans` (longs), `kept_sha256`, `kept` (binary, the bytes that stay) and `kept_text`
    (string, the characters of which all bytes stay). Without with_kept the last two are null.

    Each byte that a string of `length` bytes covers goes if that string also starts anywhere else, in the same row
    or another; overlaps count, and strings are judged on the input. Matches never cross rows. With `words`, each run
    of so many words (what stands between blanks) that occurs anywhere else goes too, however few bytes it has. With
    `apart`, these runs go from kept_text alone: the other columns tell of the strings of `length` bytes, and one more,
    `n_passage_bytes` (long), of the bytes that only runs of words cover.

    Null texts are empty. Texts under `length` bytes stay whole. A repeated row is another occurrence, so both lose
    all. An empty table gives an empty table. No other column is read, so nulls and repeats in them don't matter;
    columns named as a result column are replaced by it. Each text, whole, has to fit in a Python worker.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be {4 * GRAM} at least")
    if words is not None and words * MARK < 4 * GRAM:
        raise ValueError(f"words must be {4 * GRAM // MARK} at least")
    texts = docs.select(F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("text"))
    spans = _spans(texts, length, bucket_rows, False)
    if words is not None:
        spans = spans.unionByName(_spans(texts, words, bucket_rows, True))
    cover = F.collect_list(F.struct("low", "end", "worded"))
    spans = stage(spans.groupBy("fp").agg(cover.alias("_spans")).mapInArrow(_overlapped, _SPANS), "spans")
    result = (*_RESULT, _APART) if apart else _RESULT
    own = [c for c in docs.columns if c.lower() not in result]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    doc = docs.select(row.alias("_row"), F.coalesce(F.col(column).cast("binary"), F.lit(b"")).alias("_text"))
    doc = doc.withColumn("fp", F.unhex(F.md5("_text")))
    doc = doc.join(sized(spans, "_spans", 9), "fp", "left").select("_row", "_text", "_spans")
    kind = doc.schema["_row"].dataType.simpleString()
    out = doc.mapInArrow(partial(_cut, with_kept=with_kept, apart=apart), f"_row {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, {_APART} long")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in own], *result)


def _spans(texts: DataFrame, length: int, bucket_rows: int, worded: bool) -> DataFrame:
    """fp (a text's md5), low, end: the symbols from low to before end are in windows that occur elsewhere too."""
    found = repeat_starts(texts, length, bucket_rows, worded)
    return found.select("fp", "low", (F.col("high") + length).alias("end"), F.lit(worded).alias("worded"))


@released
def _overlapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each text, overlapping spans of a kind as one. Spans that only touch stay two, as between words a blank stays."""
    for batch in batches:
        spans = batch.column(1)
        at = np.asarray(spans.offsets)
        low, end = (np.asarray(spans.values.field(k))[at[0] : at[-1]].astype(np.int64) for k in (0, 1))
        worded = spans.values.field(2).to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(bool)
        # A row's kinds far from each other, with a place between any two symbols.
        base = (2 * np.repeat(np.arange(len(at) - 1), np.diff(at)) + worded) << 33
        runs = merged(np.stack([base + 2 * low, base + 2 * end - 1], 1))
        kind, runs = runs[:, 0] >> 33, runs & ((1 << 33) - 1)
        values = pa.StructArray.from_arrays([pa.array((runs[:, 0] >> 1).astype(np.int32)), pa.array(((runs[:, 1] + 1) >> 1).astype(np.int32)), pa.array(kind % 2 == 1)], ["low", "end", "worded"])
        ends = np.concatenate([[0], np.cumsum(np.bincount(kind >> 1, minlength=len(at) - 1))])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)], ["fp", "_spans"])


def _word_edges(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a text start and end, cut as word_marks cuts them."""
    inner = np.concatenate([[False], ~((text == 32) | ((text >= 9) & (text <= 13))), [False]])
    return np.flatnonzero(inner[1:] & ~inner[:-1]), np.flatnonzero(inner[:-1] & ~inner[1:])


@released
def _cut(batches: Iterator[pa.RecordBatch], with_kept: bool, apart: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text, offsets = flat(batch.column(1))
        spans = batch.column(2)  # a null has no items
        at = np.asarray(spans.offsets)
        covers = np.stack([np.asarray(spans.values.field(k)) for k in (0, 1)], 1).astype(np.int64)
        worded = spans.values.field(2).to_numpy(zero_copy_only=False).astype(bool)
        counts, digests, kept, texts, left, passages = [], [], [], [], [], []
        for k in range(batch.num_rows):
            own = text[offsets[k] : offsets[k + 1]]
            runs, by_word = covers[at[k] : at[k + 1]].copy(), worded[at[k] : at[k + 1]]
            if by_word.any():
                starts, ends = _word_edges(own)
                runs[by_word] = np.stack([starts[runs[by_word, 0]], ends[runs[by_word, 1] - 1]], 1)
            strings = merged(runs[~by_word] if apart else runs)
            parts = outside(own, strings)
            read = outside(own, merged(runs)) if apart and by_word.any() else parts
            stays = b"".join(parts)
            counts.append(len(strings))
            left.append(len(stays))
            passages.append(len(stays) - sum(map(len, read)))
            digests.append(hashlib.sha256(stays).hexdigest())
            kept.append(stays if with_kept else None)
            texts.append("".join(x.decode("utf-8", "ignore") for x in read) if with_kept else None)
        sizes = np.diff(offsets)
        longs = [pa.array(x, pa.int64()) for x in (sizes, sizes - np.array(left, np.int64), counts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *longs, pa.array(digests, pa.string()), pa.array(kept, pa.binary()), pa.array(texts, pa.string()), pa.array(passages, pa.int64())], ["_row", *_RESULT, _APART])


def outside(text: np.ndarray, runs: np.ndarray) -> list[bytes]:
    """What stands before, between and behind maximal runs."""
    return [text[a:b].tobytes() for a, b in np.concatenate([[0], runs.ravel(), [len(text)]]).reshape(-1, 2)]


def merged(runs: np.ndarray) -> np.ndarray:
    """Overlapping or touching [low, end) runs as maximal runs."""
    if not len(runs):
        return runs
    runs = runs[np.argsort(runs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(runs[:, 1])
    first = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > reach[:-1]]))
    return np.stack([runs[first, 0], reach[np.concatenate([first[1:] - 1, [len(runs) - 1]])]], 1)


def repeat_starts(texts: DataFrame, length: int, bucket_rows: int, worded: bool = False) -> DataFrame:
    """fp (a text's md5), low, high: the windows of `length` bytes, or words, that start from low to high in that text occur elsewhere too."""
    anchors = stage(texts.mapInArrow(partial(_anchors, length=length, worded=worded), _ANCHOR), "anchors")
    grams = anchors.groupBy("gram").agg(F.count("*").alias("n"), F.min("around").alias("a"), F.max("around").alias("b"))
    grams = stage(grams.filter("n > 1").select("gram", F.expr("a = b").alias("alike")), "grams")
    shared = stage(anchors.join(small(grams, 32), "gram"), "shared")
    # In buckets with different surroundings, those that occur again repeat whole, and one of each goes on.
    differ = shared.filter("not alike").groupBy("gram", "around")
    differ = differ.agg(F.count("*").alias("n"), F.min(F.struct("fp", "at", "low", "high")).alias("one"))
    differ = stage(differ.select("gram", "around", "one.*", F.expr("n > 1").alias("many")), "differ")
    again = stage(differ.filter("many").select("gram", "around"), "again")
    found = shared.filter("alike").unionByName(shared.filter("not alike").join(small(again, 32), ["gram", "around"], "left_semi"))
    found = found.select("fp", "low", "high")

    places = differ.groupBy("fp").agg(F.collect_list(F.struct("gram", "around", "at", "low", "high", "many")).alias("places"))
    places = stage(places, "places")
    # Texts without places stay where they are; the others meet by fp once, and their places come there.
    placed = texts.withColumn("fp", F.unhex(F.md5("text"))).join(small(places.select("fp"), 32), "fp", "left_semi")
    one = placed.groupBy("fp").agg(F.first("text").alias("text")).join(sized(places, "places", 40), "fp").select("fp", "text", "places")
    pieces = one.mapInArrow(partial(_pieces, length=length, worded=worded), _PIECE)
    while pieces is not None:
        pieces = stage(pieces, "pieces")
        crowded = stage(pieces.groupBy("bucket").count().filter(F.col("count") > bucket_rows).select("bucket"), "crowded")
        none = crowded.isEmpty()
        calm = pieces if none else pieces.join(small(crowded, 16), "bucket", "left_anti").select(pieces.columns)
        calm = calm.select("bucket", "fp", "at", "low", "high", "many", "bytes").repartition("bucket").sortWithinPartitions("bucket")
        found = found.unionByName(calm.mapInArrow(partial(_refine, length=length, worded=worded), _SPAN))
        if none:
            break
        parts = pieces.join(small(crowded, 16), "bucket").select(pieces.columns).mapInArrow(partial(_split, length=length, worded=worded), _PIECE)
        parts = stage(parts, "parts")
        key = ["bucket", "around"]
        sums = parts.groupBy(*key).agg(F.count("*").alias("n"), F.bool_or("many").alias("some"), F.min(F.struct("fp", "at", "low")).alias("one"))
        sums = stage(sums.filter("n > 1").select(*key, "one"), "sums")
        twice = parts.join(small(sums, 80), key)
        found = found.unionByName(twice.filter("not many").select("fp", "low", "high"))
        rest = parts.join(small(sums.drop("one"), 32), key, "left_anti").select(parts.columns)
        kept = twice.filter(F.struct("fp", "at", "low") == F.col("one")).withColumn("many", F.lit(True)).select(parts.columns)
        # A run of one window is settled by its count.
        pieces = rest.unionByName(kept.dropDuplicates(key)).filter("near < far")
    return stage(found, "found")


def _unit(worded: bool) -> tuple[int, int]:
    """Bytes of a symbol as pieces hold it, and symbols of an initial bucket's gram."""
    return (MARK, GRAM // MARK) if worded else (1, GRAM)


def _symbols(data: np.ndarray, offsets: np.ndarray, worded: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the bytes, or words, of all rows, and the rows' offsets in them."""
    return short_word_marks(data, offsets) if worded else (byte_marks(data), offsets)


def _gram_marks(h: np.ndarray, gram: int) -> np.ndarray:
    """The bucket of the gram at each symbol, each time that of half the length and that at the later offset."""
    g = 1
    while g < gram:
        h = joined(h[:-g], h[g:])
        g *= 2
    return h


def _span_marks(h: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, gram: int) -> np.ndarray:
    """A fingerprint of the symbols from low to high, gram to 2 * length - gram of them, by grams that cover them all."""
    out = mixed((high - low).astype(np.uint64))
    n = high - low - gram
    for k in range(0, 2 * (length - gram) + gram, gram):
        out = joined(out, h[low + np.minimum(k, n)])
    return out


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the least (leftmost of equals) of each w in a row."""
    n = len(h)
    bits = max(24, int(n).bit_length())  # the same for all chunks, so equal windows choose alike
    mask = np.uint64((1 << bits) - 1)
    key = (h & ~mask) | np.arange(n, dtype=np.uint64)
    rows = -(-n // w)
    block = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    block[:n] = key
    block = block.reshape(rows, w)
    ahead = np.minimum.accumulate(block, 1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], 1)[:, ::-1].ravel()
    return (np.minimum(back[: n - w + 1], ahead[w - 1 : n]) & mask).astype(np.int64)


@released
def _anchors(batches: Iterator[pa.RecordBatch], length: int, worded: bool) -> Iterator[pa.RecordBatch]:
    _, gram = _unit(worded)
    w = length - gram + 1
    for batch in batches:
        for _, _, data, ends in chunks(batch.column(0), SHORT if worded else 1 << 21):
            if len(data) < length:
                continue
            symbols, offsets = _symbols(data, ends, worded)
            if len(symbols) < length:
                continue
            h = _gram_marks(symbols, gram)
            least = _least(h, w)
            rows = np.flatnonzero(np.diff(offsets) >= length)
            ok = np.zeros(len(symbols) + 1, np.int8)
            ok[offsets[rows]] = 1
            ok[offsets[rows + 1] - length + 1] -= 1
            at = least[np.cumsum(ok[:-1])[: len(least)] > 0]
            if not len(at):
                continue
            at = at[np.concatenate([[True], at[1:] != at[:-1]])]
            row = np.searchsorted(offsets, at, "right") - 1
            start, end = offsets[row], offsets[row + 1]
            low, high = np.maximum(start, at - (w - 1)), np.minimum(at, end - length)
            around = joined(_span_marks(h, low, high + length, length, gram), mixed((at - low).astype(np.uint64)))
            used, back = np.unique(row, return_inverse=True)
            digests = pa.array([hashlib.md5(data[ends[r] : ends[r + 1]].tobytes()).digest() for r in used], pa.binary())
            ints = [pa.array(x.astype(np.int32)) for x in (at - start, low - start, high - start)]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(around.view(np.int64)), digests.take(pa.array(back)), *ints], ["gram", "around", "fp", "at", "low", "high"])


@released
def _pieces(batches: Iterator[pa.RecordBatch], length: int, worded: bool) -> Iterator[pa.RecordBatch]:
    """The symbols around each place of a text. Columns: fp, text, places."""
    unit, gram = _unit(worded)
    far = length - gram
    for batch in batches:
        for k in range(batch.num_rows):
            fp, text = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
            if worded:
                text = short_word_marks(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0].tobytes()
            out = [(x["gram"], x["around"], fp, x["at"], x["low"], x["high"], 0, far, x["many"], text[x["low"] * unit : (x["high"] + length) * unit]) for x in batch.column(2)[k].as_py()]
            yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.binary(), *[pa.int32()] * 5, pa.bool_(), pa.binary()]
    names = [x.split()[0] for x in _PIECE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _digest(*parts: object) -> int:
    return int(np.frombuffer(hashlib.md5(repr(parts[:-1]).encode() + parts[-1]).digest()[:8], np.int64)[0])


@released
def _split(batches: Iterator[pa.RecordBatch], length: int, worded: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of crowded buckets as runs of starts, by their distance to the anchor: near to far."""
    unit, _ = _unit(worded)
    for batch in batches:
        out = []
        for x in batch.to_pylist():
            step = max(1, -(-(x["far"] - x["near"] + 1) // PARTS))
            for near in range(x["near"], x["far"] + 1, step):
                far = min(near + step - 1, x["far"])
                low, high = max(x["low"], x["at"] - far), min(x["high"], x["at"] - near)
                if low > high:
                    continue
                own = x["bytes"][(low - x["low"]) * unit : (high + length - x["low"]) * unit]
                # The symbols that all windows of the run share lie in each of them, so also in what a text's ends leave.
                core = x["bytes"][max(0, x["at"] - near - x["low"]) * unit : (x["at"] - far + length - x["low"]) * unit]
                bucket = _digest(x["bucket"], near, core)
                out.append((bucket, _digest(x["at"] - low, own), x["fp"], x["at"], low, high, near, far, x["many"], own))
        yield _batch(out)


@released
def _refine(batches: Iterator[pa.RecordBatch], length: int, worded: bool) -> Iterator[pa.RecordBatch]:
    """Takes pieces sorted by bucket; gives the starts, from low to high, whose windows repeat in their bucket."""
    for table in whole_groups(batches, 0, 512):
        yield _repeats(table, length, worded)


def _repeats(pieces: pa.Table, length: int, worded: bool) -> pa.RecordBatch:
    bucket, at, low, high = (pieces.column(k).to_numpy().astype(np.int64) for k in (0, 2, 3, 4))
    many = pieces.column(5).to_numpy()
    data, offsets = flat(pieces.column(6))
    unit, gram = _unit(worded)
    symbols, offsets = data.view(np.uint64) if worded else byte_marks(data), offsets // unit
    # Window starts of all pieces, one piece after the other.
    n = high - low + 1
    piece = np.repeat(np.arange(len(n)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    p = offsets[piece] + start
    names = bucket_names(symbols, length, gram)[p]
    # Only windows at the same distance to the same anchor gram are compared.
    place = np.unique(bucket, return_inverse=True)[1][piece] * np.int64(length) + (at[piece] - low[piece] - start)
    names = joined(names, mixed(place.astype(np.uint64)))
    order = np.argsort(names)
    names, place = names[order], place[order]
    same = np.flatnonzero((names[1:] == names[:-1]) & (place[1:] == place[:-1]))
    twice = np.zeros(len(p) + 1, bool)
    twice[order[same]] = twice[order[same + 1]] = True
    twice[:-1] &= ~many[piece]
    edge = np.concatenate([[True], piece[1:] != piece[:-1], [True]])
    first = np.flatnonzero(twice[:-1] & (edge[:-1] | ~np.concatenate([[False], twice[:-2]])))
    last = np.flatnonzero(twice[:-1] & (edge[1:] | ~twice[1:]))
    k = piece[first]
    ints = [pa.array((low[k] + x).astype(np.int32)) for x in (start[first], start[last])]
    return pa.RecordBatch.from_arrays([pieces.column(1).combine_chunks().take(pa.array(k)), *ints], ["fp", "low", "high"])


def bucket_names(symbols: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The name of the bucket of the `length` symbols at each place.

    The bucket of a 2g-gram is named by those of its g-gram and of the g-gram g later, again and again; the last two
    overlap. A name is a fingerprint of the pair of names, so a round needs no sort of its own.
    """
    h, g = _gram_marks(symbols, gram), gram
    while 2 * g <= length:
        h, g = joined(h[:-g], h[g:]), 2 * g
    rest = length - g
    return joined(h[:-rest], h[rest:]) if rest else h
