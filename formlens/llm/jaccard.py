"""Near duplicates by the Jaccard similarity of word n-grams, found by a chosen-path join.

Each text is the set of its n-grams. In each of `runs` independent runs a set chooses tokens of its own by hash, one in
threshold * size, and goes to the bucket of each: 1 / threshold buckets on average, of which two sets at the threshold
share one or more on average. A bucket with more than `bucket_rows` sets is split again on tokens that are chosen with
its path. Within a bucket all sets meet by their bit sketches; a bucket still crowded after `levels` splits meets block
by block. Pairs that pass connect candidates to families, and only families' texts are read again.

A family of up to `block` sets is compared exactly, all pairs in one task. A larger one has a pivot, the grams that most
of a sample of its sets hold. Jaccard distance is a metric, so two sets whose distances to the pivot add up to no more
than 1 - threshold are linked for sure: these links are only counted, from a histogram of the distances. The other pairs
are compared exactly, block by block of sets in like distance, and only blocks that hold such pairs meet. Sets travel
there as their difference to the pivot, which keeps the difference of any two.

Of two sets at the threshold a run misses e^-1 at most where no bucket is split, e^-(1 - e^-1) with one split. So 20
runs reach a recall of 1 - 3e-9, or 1 - 4e-6 with one split, 1 - 9e-5 with two, and by the same recursion 1 - 6e-4 with
three. More than `levels` splits aren't made. The sketches lose four pairs in 10^6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, flat, fresh, joined, mixed, released, sized, small, stage, whole_groups, word_marks

BITS = 256
_BIT_SEEDS = np.random.default_rng(7).integers(0, 2**64, BITS, dtype=np.uint64) | np.uint64(1)
_RUN_SEEDS = np.random.default_rng(8).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_RESULT = ("class_id", "n_links", "n_copies")
_LINK = "fp binary, root binary, links long"
#: Distances to a pivot are rounded up to so many parts; sets of a block are within BAND parts.
PARTS, BAND = 1000, 25
#: Sets of a large family that its pivot is made of, about.
SAMPLE = 64


def near_groups(docs: DataFrame, column: str = "text", words: int = 5, threshold: float = 0.8, runs: int = 20, bucket_rows: int = 4096, levels: int = 3, block: int = 1024) -> DataFrame:
    """docs with `class_id` (the least doc_id of the row's group), `n_links` and `n_copies` (longs).

    Two rows are linked if the sets of their word n-grams have a Jaccard similarity of threshold or more; a group is
    what links connect. n_links counts the other rows that a row is linked to, n_copies those with the very same set.
    Words are runs without space, tab, LF, VT, FF, CR. A text of fewer words is one gram, the whole of it. A text
    without words, null included, has no link: class_id is its doc_id, both counts are 0. Repeated rows are copies of
    each other. A null doc_id is never the least, unless all of a group are null. An empty table gives an empty table.
    Columns of docs that are named as a result column are replaced.
    """
    own = [c for c in docs.columns if c.lower() not in _RESULT]
    key = fresh(docs, "_text")
    classes = _classes(docs, column, words, threshold, runs, bucket_rows, levels, block)
    told = classes.select(F.col("text").alias(key), *_RESULT)
    out = docs.select(*[F.col(f"`{c}`") for c in own]).withColumn(key, F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))).join(small(stage(told, "told"), 64), key, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _RESULT[1:]]
    return out.select(*[F.col(f"`{c}`") for c in own], F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *counts)


def one_of_each(docs: DataFrame, **how: object) -> DataFrame:
    """The rows of docs without all but one of each group: that of the least doc_id (nulls last), then text.

    Rows that don't differ in doc_id and text are one. See near_groups for groups and its parameters for `how`.
    """
    column = str(how.get("column", "text"))
    key, told = fresh(docs, "_text"), fresh(docs, "_told")
    classes = _classes(docs, **{"column": column, "words": 5, "threshold": 0.8, "runs": 20, "bucket_rows": 4096, "levels": 3, "block": 1024} | how)
    stays = stage(classes.select(F.col("text").alias(key), F.struct("first", "again").alias(told)), "stays")
    rows = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col(column), F.lit("")).cast("binary")))).join(small(stays, 64), key, "left")
    first = F.col(told)["first"]
    rows = rows.filter(F.col(told).isNull() | (first["text"] == F.col(key)) & first["id"].eqNullSafe(F.col("doc_id")))
    again = F.coalesce(F.col(told)["again"], F.lit(False))
    own = [F.col(f"`{c}`") for c in docs.columns]
    return rows.filter(~again).select(*own).unionByName(rows.filter(again).dropDuplicates([key]).select(*own))


def _classes(docs: DataFrame, column: str, words: int, threshold: float, runs: int, bucket_rows: int, levels: int, block: int) -> DataFrame:
    """text (md5), class_id, n_links, n_copies, first (the id and text that stay), again (that row is repeated) for each text whose group has several rows."""
    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col(column), F.lit("")).cast("binary").alias("text"))
    kind = dict(docs.dtypes)["id"]
    sets = stage(docs.mapInArrow(partial(_keys, words=words, threshold=threshold, runs=runs), f"id {kind}, text binary, fp binary, size int, sketch binary, keys array<long>"), "sets")
    one = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text"))
    sums = sets.groupBy("fp").agg(one.alias("one"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("size", "sketch", "keys")])
    sums = stage(sums, "sums")
    pairs = _candidates(docs, sums, words, threshold, bucket_rows, levels)
    links = _verified(docs, sums, components(pairs), words, threshold, block)
    groups = components(links.filter("fp != root").select("fp", "root"))
    links = links.groupBy("fp").agg(F.sum("links").alias("links"))
    told = sums.select("fp", "one", "copies").join(small(stage(links, "link_sums"), 40), "fp", "left").filter("copies > 1 or links > 0").join(small(groups, 48), "fp", "left")
    told = stage(told.withColumn("root", F.coalesce("root", "fp")), "linked")
    least = told.groupBy("root").agg(F.min("one").alias("first"))
    told = stage(told.join(least, "root").select("fp", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), (F.col("copies") - 1).alias("n_copies")), "groups")
    texts = sets.join(small(told.select("fp"), 32), "fp", "left_semi").groupBy("fp", "text", "id").agg(F.count("*").alias("n")).join(told, "fp")
    again = F.max((F.col("n") > 1) & (F.col("first.text") == F.col("text")) & F.col("first.id").eqNullSafe(F.col("id"))).alias("again")
    rest = [F.first(c).alias(c) for c in ("first", "n_links", "n_copies")]
    return texts.groupBy("text").agg(again, *rest).withColumn("class_id", F.col("first.id"))


def _candidates(docs: DataFrame, sums: DataFrame, words: int, threshold: float, bucket_rows: int, levels: int) -> DataFrame:
    """fp, root: pairs of sets that share a bucket and whose sketches are near."""
    rows, pairs = sums.select("fp", F.explode("keys").alias("key")), None
    sketches = sums.select("fp", "size", "sketch")
    for level in range(levels + 1):
        busy = stage(rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "busy")
        rows = stage(rows.join(small(busy, 32), "key").select("key", "fp", "n"), "rows")
        calm = rows.filter(F.col("n") <= bucket_rows).withColumn("side", F.lit(0))
        crowded = rows.filter(F.col("n") > bucket_rows)
        over = crowded.isEmpty()
        if level == levels and not over:  # block by block: each set of block i with those of block j
            at = crowded.withColumn("blocks", F.ceil(2 * F.col("n") / bucket_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
            at = at.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("side", F.expr("int(own > other)"))
            at = at.withColumn("key", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"), F.lit(level)))
            calm = calm.unionByName(at.select(calm.columns))
        met = calm.join(sketches, "fp").select("key", "fp", "size", "sketch")
        met = met.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_near, threshold=threshold), "fp binary, root binary")
        met = stage(met, "met")
        pairs = met if pairs is None else pairs.unionByName(met)
        if over or level == levels:
            break
        paths = crowded.groupBy("fp").agg(F.collect_list("key").alias("keys"))
        texts = _texts_of(docs, stage(paths.join(sums.select("fp", "one", "copies"), "fp"), "paths"), "keys", 8)
        rows = stage(texts.select("fp", "keys", "text").mapInArrow(partial(_deeper, words=words, threshold=threshold), "fp binary, key long").distinct(), "deeper")
    return pairs.distinct()


def _texts_of(docs: DataFrame, some: DataFrame, items: str | None = None, item_bytes: int = 0) -> DataFrame:
    """Staged `some` (fp, one, copies and more) with the text of each set's `one` row, once."""
    some = some.withColumn("md5", F.col("one.text")).withColumn("own", F.col("one.id")).drop("one")
    some = sized(some, items, item_bytes, 96) if items else small(some, 112)
    texts = docs.withColumn("md5", F.unhex(F.md5("text"))).join(some, "md5").filter(F.col("id").eqNullSafe(F.col("own"))).drop("md5", "own", "id")
    # A row can be repeated only where its set has copies.
    return texts.filter("copies = 1").unionByName(texts.filter("copies > 1").dropDuplicates(["fp"]))


def _verified(docs: DataFrame, sums: DataFrame, families: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """fp, root (a set of its links), links (rows linked to it), of which a set may have several rows."""
    families = families.unionByName(families.select(F.col("root").alias("fp"), "root").distinct())
    rows = stage(sums.select("fp", "one", "copies", "size").join(small(stage(families, "families"), 48), "fp"), "family_sets")
    sizes = stage(rows.groupBy("root").agg(F.count("*").alias("sets"), F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("size") / 2_000_000)).cast("int").alias("blocks")), "sizes")
    rows = stage(rows.join(small(sizes, 40), "root"), "sized_sets")
    few = _texts_of(docs, rows.filter("blocks = 1")).select(F.xxhash64("root").alias("key"), "fp", "copies", "text")
    few = few.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_verify, words=words, threshold=threshold), _LINK)
    if sizes.filter("blocks > 1").isEmpty():
        return stage(few, "links")
    return stage(few.unionByName(_large(docs, rows.filter("blocks > 1"), words, threshold, block)), "links")


def _large(docs: DataFrame, rows: DataFrame, words: int, threshold: float, block: int) -> DataFrame:
    """The links of families over a block. rows: fp, one, copies, root, sets."""
    sure = int((1 - threshold) * PARTS + 1e-6)
    texts = _texts_of(docs, rows.select("fp", "one", "copies", "root", "sets"))
    some = texts.filter(F.pmod(F.xxhash64("fp", F.lit("pivot")), F.greatest(F.lit(1), F.floor(F.col("sets") / SAMPLE))) == 0)
    some = some.select(F.xxhash64("root").alias("key"), "root", "text").repartition("key").sortWithinPartitions("key")
    pivots = stage(some.mapInArrow(partial(_pivots, words=words), "root binary, pivot array<long>"), "pivots")
    far = texts.select("fp", "root", "copies", "text").join(sized(pivots, "pivot", 8), "root", "left")
    far = far.select("fp", "root", "copies", "text", "pivot").mapInArrow(partial(_to_pivot, words=words), "fp binary, root binary, copies long, size int, part int, diff array<long>")
    far = stage(far, "to_pivot")

    counts = far.groupBy("root", "part").agg(F.sum("copies").alias("n"), F.count("*").alias("sets"), F.min("fp").alias("least"))
    counts = stage(counts, "parts")  # at most PARTS + 1 rows for each family
    told = counts.groupBy("root").agg(F.collect_list(F.struct("part", "n")).alias("parts"), F.min(F.struct("part", "least")).alias("first"))
    near = far.select("fp", "root", "copies", "part").join(sized(stage(told, "told"), "parts", 16), "root")
    within = F.aggregate(F.filter("parts", lambda x: x["part"] <= sure - F.col("part")), F.lit(0).cast("long"), lambda s, x: s + x["n"])
    within = within - F.when(2 * F.col("part") <= sure, F.col("copies")).otherwise(0)
    counted = near.select("fp", F.when(F.col("part") + F.col("first.part") <= sure, F.col("first.least")).otherwise(F.col("fp")).alias("root"), within.alias("links"))

    band = F.floor(F.col("part") / BAND).cast("int").alias("band")
    cells = counts.groupBy("root", band).agg(F.greatest(F.lit(1), F.ceil(F.sum("sets") / block)).cast("int").alias("subs"), F.min("part").alias("low"), F.max("part").alias("high"))
    cells = stage(cells, "bands")
    at = cells.withColumn("sub", F.explode(F.expr("sequence(0, subs - 1)"))).select("root", "band", "sub", "low", "high")
    a, b = (at.select("root", *[F.col(c).alias(f"{c}_{s}") for c in ("band", "sub", "low", "high")]) for s in "ab")
    meet = a.join(b, "root").filter(F.struct("band_a", "sub_a") <= F.struct("band_b", "sub_b")).filter((F.col("high_a") + F.col("high_b") > sure) & (F.col("low_b") - F.col("high_a") <= sure))
    meet = meet.withColumn("key", F.xxhash64("root", "band_a", "sub_a", "band_b", "sub_b"))
    alone = (F.col("band_a") == F.col("band_b")) & (F.col("sub_a") == F.col("sub_b"))
    ends = F.when(alone, F.array(F.struct(F.col("band_a").alias("band"), F.col("sub_a").alias("sub"), F.lit(0).alias("side")))).otherwise(
        F.array(*[F.struct(F.col(f"band_{s}").alias("band"), F.col(f"sub_{s}").alias("sub"), F.lit(k).alias("side")) for k, s in ((1, "a"), (2, "b"))]))
    meet = meet.select("root", "key", F.explode(ends).alias("e")).select("root", "key", "e.*")
    dealt = far.withColumn("band", F.floor(F.col("part") / BAND).cast("int")).join(small(cells.select("root", "band", "subs"), 48), ["root", "band"]).withColumn("sub", F.pmod(F.xxhash64("fp"), F.col("subs")).cast("int"))
    met = dealt.join(small(stage(meet, "meet"), 48), ["root", "band", "sub"]).select("key", "fp", "side", "copies", "size", "part", "diff")
    met = met.repartition("key").sortWithinPartitions("key").mapInArrow(partial(_verify_far, threshold=threshold, sure=sure), _LINK)
    return counted.unionByName(met)


def components(pairs: DataFrame) -> DataFrame:
    """fp, root: the least set of its component, for all but the least; by alternating large and small stars."""
    a, b = pairs.columns
    edges = pairs.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a != b").distinct()
    edges, before = stage(edges, "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a")
        star = star.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter("a != b").distinct()
        edges = stage(star, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("fp"), F.col("b").alias("root"))
        before = now


def gram_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """The sorted n-gram fingerprints of each row."""
    marks, at = word_marks(data, offsets)
    h = marks[: max(0, len(marks) - words + 1)].copy()
    for k in range(1, words):
        h = joined(h, marks[k : k + len(h)])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= words:
            yield np.unique(h[a : b - words + 1])
        elif b > a:
            one = np.full(1, b - a, np.uint64)
            for k in range(a, b):
                one = joined(one, marks[k : k + 1])
            yield one
        else:
            yield marks[:0]


def _limits(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Hashes under it choose a token: one in threshold * size."""
    return np.minimum(2.0**64 / (threshold * np.maximum(sizes, 1)), 2.0**64 - 4096).astype(np.uint64)


@released
def _keys(batches: Iterator[pa.RecordBatch], words: int, threshold: float, runs: int) -> Iterator[pa.RecordBatch]:
    """Columns: id, text. Sets without grams have no copies: their row is left out."""
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            sets = list(gram_sets(data, offsets, words))
            n = np.array([len(x) for x in sets])
            row, grams = np.repeat(np.arange(len(sets)), n), np.concatenate([*sets, np.zeros(0, np.uint64)])
            limit = _limits(n, threshold)[row]
            rows, keys = [], []
            for k in range(runs):
                chosen = np.flatnonzero(grams * _RUN_SEEDS[k] <= limit)
                rows.append(row[chosen])
                keys.append(mixed(grams[chosen] ^ _RUN_SEEDS[k]))
            rows, keys = np.concatenate(rows), np.concatenate(keys)
            keys = keys[np.argsort(rows, kind="stable")].view(np.int64)
            ends = np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(sets)))]).astype(np.int32)
            md5 = [hashlib.md5(data[a:b].tobytes()).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            digests = [hashlib.md5(x.tobytes()).digest() for x in sets]
            out = [batch.column(0).slice(first, end - first), pa.array(md5, pa.binary()), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), pa.array(_sketches(grams, n), pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys))]
            yield pa.RecordBatch.from_arrays(out, ["id", "text", "fp", "size", "sketch", "keys"]).filter(pa.array(n > 0))


def _sketches(grams: np.ndarray, n: np.ndarray) -> list[bytes]:
    """BITS bits of each set: one of the least hash of its grams, for each of as many hashes."""
    some, starts = np.flatnonzero(n), (np.cumsum(n) - n)
    bit = np.zeros((len(n), BITS), np.uint8)
    for k, seed in enumerate(_BIT_SEEDS if len(some) else ()):
        bit[some, k] = np.minimum.reduceat(grams * seed, starts[some]) >> np.uint64(40) & np.uint64(1)
    return [x.tobytes() for x in np.packbits(bit, axis=1)]


def _sets_of(column: pa.Array, words: int) -> list[np.ndarray]:
    return [x for _, _, data, offsets in chunks(column) for x in gram_sets(data, offsets, words)]


@released
def _deeper(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Columns: fp, keys, text. The next tokens of each path."""
    for batch in batches:
        rows, out = [], []
        for k, grams in enumerate(_sets_of(batch.column(2), words)):
            limit = _limits(np.array([len(grams)]), threshold)[0]
            for path in np.asarray(batch.column(1)[k].values).view(np.uint64):
                chosen = grams[mixed(grams ^ path) <= limit]
                out.append(joined(np.full(len(chosen), path), chosen))
                rows.append(np.full(len(chosen), k))
        rows, out = np.concatenate([*rows, np.zeros(0, int)]), np.concatenate([*out, np.zeros(0, np.uint64)])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(out.view(np.int64))], ["fp", "key"])


@released
def _pivots(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Columns: key, root, text, sorted by key. The grams that more than half of each family's sets hold."""
    for table in whole_groups(batches, 0, 512):
        roots = table.column(1).to_pylist()
        sets, out = _sets_of(table.column(2).combine_chunks(), words), {}
        for root in dict.fromkeys(roots):
            own = [x for r, x in zip(roots, sets, strict=True) if r == root]
            grams, n = np.unique(np.concatenate(own), return_counts=True)
            out[root] = grams[2 * n > len(own)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.binary()), pa.array(list(out.values()), pa.list_(pa.int64()))], ["root", "pivot"])


@released
def _to_pivot(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Columns: fp, root, copies, text, pivot. Each set's difference to the pivot, and its distance in parts, rounded up."""
    for batch in batches:
        size, part, diff = [], [], []
        for grams, pivot in zip(_sets_of(batch.column(3), words), batch.column(4), strict=True):
            pivot = np.asarray(pivot.values if pivot.is_valid else [], np.int64).view(np.uint64)
            own = np.setxor1d(grams, pivot, assume_unique=True)
            size.append(len(grams))
            part.append(-(-2 * PARTS * len(own) // (len(grams) + len(pivot) + len(own))))
            diff.append(own.view(np.int64))
        columns = [*(batch.column(k) for k in range(3)), pa.array(size, pa.int32()), pa.array(part, pa.int32()), pa.array(diff, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["fp", "root", "copies", "size", "part", "diff"])


def connect(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """root (the least of its component, for each node) after links from a to b."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (up := root[root]) is not root and (up != root).any():
            root = up


@released
def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Columns: key, fp, size, sketch, sorted by key. Links of each set to the least set it is connected to in a bucket."""
    differ = BITS * (1 - threshold) / 2
    most = differ + 5 * (differ * (1 + threshold) / 2) ** 0.5  # five standard deviations
    for table in whole_groups(batches, 0, 8192):
        key, size = table.column(0).to_numpy(), table.column(2).to_numpy().astype(np.float64)
        bits = flat(table.column(3))[0].view(np.uint64).reshape(len(key), -1)
        root = np.arange(len(key))
        left = np.arange(len(key))
        for lag in range(1, len(key)):
            left = left[left + lag < len(key)]
            left = left[key[left] == key[left + lag]]
            if not len(left):
                break
            a = left[root[left] != root[left + lag]]
            b = a + lag
            ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
            a, b = a[ok], b[ok]
            ok = np.bitwise_count(bits[a] ^ bits[b]).sum(1) <= most
            root = connect(root, a[ok], b[ok])
        linked = np.flatnonzero(root != np.arange(len(root)))
        fp = table.column(1).combine_chunks()
        yield pa.RecordBatch.from_arrays([fp.take(pa.array(linked)), fp.take(pa.array(root[linked]))], ["fp", "root"])


def _linked(key: np.ndarray, fp: pa.Array, side: np.ndarray, copies: np.ndarray, size: np.ndarray, lists: list[np.ndarray], threshold: float, part: np.ndarray | None = None, sure: int = -1) -> pa.RecordBatch:
    """The links of sets, dealt by key. lists: the sets, or their differences to the same one. Side 1 meets only side 2; pairs of parts up to `sure` don't count."""
    root, links = np.arange(len(key)), np.zeros(len(key), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        n, d = size[lo:hi].astype(np.float64), np.array([len(x) for x in lists[lo:hi]])
        apart = d[:, None] + d[None, :] - 2 * shared_counts(np.concatenate(lists[lo:hi]), d)
        both = (n[:, None] + n[None, :] - apart) / 2
        near = both / (n[:, None] + n[None, :] - both) >= threshold
        near &= (side[lo:hi, None] + side[None, lo:hi]) % 3 == 0
        near &= ~((side[lo:hi, None] == 0) & np.eye(hi - lo, dtype=bool))
        if part is not None:
            near &= part[lo:hi, None] + part[None, lo:hi] > sure
        links[lo:hi] = near @ copies[lo:hi]
        a, b = np.nonzero(np.triu(near))
        root = connect(root, a + lo, b + lo)
    return pa.RecordBatch.from_arrays([fp, fp.take(pa.array(root)), pa.array(links)], ["fp", "root", "links"])


@released
def _verify(batches: Iterator[pa.RecordBatch], words: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Columns: key, fp, copies, text, sorted by key."""
    for table in whole_groups(batches, 0, 512):
        sets = _sets_of(table.column(3).combine_chunks(), words)
        key, copies = table.column(0).to_numpy(), table.column(2).to_numpy()
        yield _linked(key, table.column(1).combine_chunks(), np.zeros(len(key), int), copies, np.array([len(x) for x in sets]), sets, threshold)


@released
def _verify_far(batches: Iterator[pa.RecordBatch], threshold: float, sure: int) -> Iterator[pa.RecordBatch]:
    """Columns: key, fp, side, copies, size, part, diff, sorted by key."""
    for table in whole_groups(batches, 0, 512):
        key, side, copies, size, part = (table.column(k).to_numpy() for k in (0, 2, 3, 4, 5))
        lists = [np.asarray(x.values) for x in table.column(6)]
        yield _linked(key, table.column(1).combine_chunks(), side, copies, size, lists, threshold, part, sure)


def shared_counts(grams: np.ndarray, size: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many grams each two sets share."""
    row = np.repeat(np.arange(len(size)), size)
    if not len(grams):
        return np.zeros((len(size), len(size)))
    _, back, count = np.unique(grams, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    ok = count[back] > 1
    row, col = row[ok], number[back[ok]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((len(size), len(size)), np.float64)
    n = int(col[-1]) + 1 if len(col) else 0
    for first in range(0, n, columns):
        a, b = np.searchsorted(col, [first, first + columns])
        has = np.zeros((len(size), min(columns, n - first)), np.float32)
        has[row[a:b], col[a:b] - first] = 1
        both += has @ has.T
    return both
