"""Best-fit packing of tokenised documents into sequences of a fixed capacity, by large-item matching.

Which sequence a piece goes to depends only on its length, so the plan is made for the histogram of lengths, at most
`capacity` numbers: pieces above a third of the capacity are matched greedily, at most two in a sequence, the largest
with the largest partner that still fits; smaller ones, largest first, go to the least gap that holds them. Spark then
ranks the pieces of each length and joins them to the plan's runs of ranks.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, numbered, released, stage

#: Bytes of the words, with their ids and places, that a worker remembers the ids of, about; and of the texts it encodes at once.
REMEMBERED, AT_ONCE = 48 << 20, 1 << 20


def pack(docs: DataFrame, tokenizer: str, column: str = "text", capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """One row per piece: the columns of docs but the text, `piece` int, `start` long, `length` long, `ids_crc32` long, `sequence_id` long, `offset` long and, with_ids, `ids` (array of int).

    A document is its ids by the tokenizer file, then end_id. Only documents over capacity are cut: their first piece
    takes the remainder, the others are full. Sequences have no gaps. A null or empty text has end_id alone. Repeated
    rows are packed each, null ids of documents too; ties go by hash, of the row as JSON if a column of it is or holds a
    map. An empty table gives none. Columns of docs that are named as a result column are replaced by it.
    """
    made = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * with_ids]
    own = [c for c in docs.columns if c != column and c.lower() not in [*made, "ids"]]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    rows = docs.select(row.alias("row"), F.col(column).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    pieces = rows.mapInArrow(partial(_pieces, path=tokenizer, capacity=capacity, end_id=end_id, with_ids=with_ids), schema)
    pieces = stage(pieces, "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(plan(counts, capacity), "length long, first long, n long, sequence long, offset long")

    tie = "row"
    if "map<" in kind:  # has no order
        tie = "_tie"
        pieces = pieces.withColumn(tie, F.md5(F.to_json("row")))
    ranked = numbered(pieces, "rank", "length", [tie, "piece", "start", "ids_crc32"])
    at = (ranked.length == runs.length) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["first"] + runs["n"])
    placed = ranked.join(F.broadcast(runs), at).select("row", "piece", "start", ranked.length, "ids_crc32", (runs["sequence"] + ranked["rank"] - runs["first"]).alias("sequence_id"), runs["offset"], *["ids"] * with_ids)
    return placed.select(*[F.col("row").getField(c).alias(c) for c in own], *made)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, how many, first sequence, offset): a run's pieces go to consecutive sequences."""
    runs: list[tuple[int, int, int, int, int]] = []
    used = dict.fromkeys(counts, 0)
    gaps: list[int] = []  # sorted, those of `open`
    open_: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)
    sequences = 0

    def put(length: int, n: int, sequence: int, offset: int) -> None:
        runs.append((length, used[length], n, sequence, offset))
        used[length] += n

    def leave(gap: int, sequence: int, n: int) -> None:
        if n and gap:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((sequence, n))

    left = {k: n for k, n in counts.items() if 3 * k > capacity}
    large = sorted(left)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        n = left[a] if b is None else max(1, left[a] // 2) if a == b else min(left[a], left[b])
        if a == b and left[a] == 1:  # no other of its length; the next smaller one
            b, n = (large[k - 1], 1) if k else (None, 1)
        put(a, n, sequences, 0)
        left[a] -= n
        if b is not None:
            put(b, n, sequences, a)
            left[b] -= n
        leave(capacity - a - (b or 0), sequences, n)
        sequences += n
        for x in {a, b} - {None}:
            if not left[x]:
                large.remove(x)
    for length in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        todo = counts[length]
        while todo:
            k = bisect_left(gaps, length)
            if k == len(gaps):  # new sequences
                each = capacity // length
                n = -(-todo // each)
                leave(capacity, sequences, n)
                sequences += n
                k = len(gaps) - 1
            gap = gaps[k]
            first, n = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(k)
            each = gap // length
            full = min(n, todo // each)
            for i in range(each if full else 0):
                put(length, full, first, capacity - gap + i * length)
            leave(gap - each * length, first, full)
            todo -= full * each
            first, n = first + full, n - full
            if n and todo < each and todo:
                for i in range(todo):
                    put(length, 1, first, capacity - gap + i * length)
                leave(gap - todo * length, first, 1)
                todo, first, n = 0, first + 1, n - 1
            leave(gap, first, n)
    return runs


class Ids:
    """The ids of texts by a tokenizer file, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before = told["model"], told["pre_tokenizer"] or {}
        self.own = None
        if model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not told["normalizer"] and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            if self._in_order(model):
                self._byte_level(told)
                return
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)

    @staticmethod
    def _in_order(model: dict) -> bool:
        """Whether the pieces' ids rise in the order of the merges that make them, as the ranks of _byte_level have to."""
        pairs = [x.split(" ", 1) if isinstance(x, str) else x for x in model["merges"]]
        ids = [model["vocab"].get(a + b, -1) for a, b in pairs]
        return all(x < y for x, y in zip([-1, *ids], ids, strict=False))

    def _byte_level(self, told: dict) -> None:
        import tiktoken

        # Printable bytes stand for themselves, the others for the characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        sign = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        self.special = {x["content"]: x["id"] for x in told["added_tokens"]}
        ranks = {bytes(sign[c] for c in piece): k for piece, k in told["model"]["vocab"].items() if piece not in self.special}
        words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # of ByteLevel
        self.bpe = tiktoken.Encoding("own", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, k in ranks.items():
            self.bytes[k] = len(piece)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        #: A space after white space isn't sure to begin a word with the letters behind it.
        self.odd = re.compile(r"\s ")
        self.known: dict[str, bytes] = {}
        self.held = 0

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.own is not None:
            return [array("I", x.ids).tobytes() for x in self.own.encode_batch(texts, add_special_tokens=False)]
        words = [None if self.odd.search(x) or self.cut and self.cut.search(x) else x.split(" ") for x in texts]
        self._learn(set().union(*(w[1:] for w in words if w)))
        known = self.known.__getitem__
        return [self._plain(x) if w is None else self._encoded(w[0]) + b"".join(map(known, w[1:])) for x, w in zip(texts, words, strict=True)]

    def _encoded(self, text: str) -> bytes:
        return self.bpe.encode_to_numpy(text).astype("<u4").tobytes()

    def _plain(self, text: str) -> bytes:
        parts = self.cut.split(text) if self.cut else [text]
        return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self._encoded(x) for x in parts)

    def forget(self) -> None:
        if self.own is None:
            self.known, self.held = {}, 0

    def _learn(self, words: set[str]) -> None:
        if self.held > REMEMBERED:
            self.forget()
        new = words.difference(self.known)
        self.held += sum(map(len, new)) + 250 * len(new)
        apart = [x for x in new if not x or x[-1].isspace()]
        self.known.update((x, self._encoded(" " + x)) for x in apart)
        rest = list(new.difference(apart))
        if rest:
            text = " " + " ".join(rest)
            ids = self.bpe.encode_to_numpy(text)
            size = np.array([len(x.encode()) for x in rest]) + 1
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum(size)) + 1
            raw, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
            self.known.update((x, raw[a:b]) for x, a, b in zip(rest, at, at[1:], strict=False))


_ids = lru_cache(1)(Ids)


@released
def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Columns: row, text."""
    ids, end = _ids(path), array("I", [end_id]).tobytes()
    try:
        for batch in batches:
            column = batch.column(1).fill_null("")
            for lo, hi, _, _ in chunks(column, AT_ONCE):
                row, piece, start, length, crc, each = [], [], [], [], [], []
                for r, raw in enumerate(ids(column.slice(lo, hi - lo).to_pylist()), lo):
                    raw += end
                    n = len(raw) // 4
                    first = (n - 1) % capacity + 1
                    for i, a in enumerate([0, *range(first, n, capacity)]):
                        b = a + capacity if i else first
                        own = raw[4 * a : 4 * b]
                        row.append(r)
                        piece.append(i)
                        start.append(a)
                        length.append(b - a)
                        crc.append(zlib.crc32(own))
                        if with_ids:
                            each.append(np.frombuffer(own, "<i4"))
                columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(each, pa.list_(pa.int32()))] * with_ids], ["row", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
    finally:
        ids.forget()
