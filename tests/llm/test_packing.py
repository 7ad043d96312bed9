import random
import zlib
from array import array
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from formlens.llm.packing import Ids, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "  a", "a  b   c ", "x\n y \n\n z\t \n \nq ", "don't<|endoftext|>stop", " é  ü  x", "日本 語 😀 a", "1234 56,78", "word " * 5000, "\n", "a\x85 b\x1c c", "re-​do it's  'll"]


def test_ids_as_the_tokenizer_gives_them():
    rng = random.Random(1)
    own = Tokenizer.from_file(PATH)
    more = ["".join(rng.choice(" \n\tab'.é1<|") for _ in range(60)) for _ in range(3000)]
    got = Ids(PATH)(TEXTS + more)
    for text, raw in zip(TEXTS + more, got, strict=True):
        assert raw == array("I", own.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


@pytest.mark.parametrize("seed", range(60))
def test_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 100, 2048])
    most = rng.choice([capacity, capacity, capacity // 2, max(1, capacity // 5)])
    counts = {rng.randint(1, most): rng.choice([1, 2, 3, 7, 100, 12345]) for _ in range(rng.randint(0, 60))}
    fill, seen = {}, Counter()
    ranks = {k: [] for k in counts}
    for length, first, n, sequence, offset in plan(counts, capacity):
        ranks[length].append((first, n))
        for s in range(sequence, sequence + n):
            fill.setdefault(s, []).append((offset, length))
        seen[length] += n
    assert seen == Counter(counts)
    for k, own in ranks.items():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    for own in fill.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
        assert own[-1][0] + own[-1][1] <= capacity
    total = sum(k * n for k, n in counts.items())
    large = sum(n for k, n in counts.items() if 2 * k > capacity)
    if most < capacity:
        assert len(fill) <= max(large, 1.25 * total / capacity + 3)


def test_round_trip(spark):
    own = Tokenizer.from_file(PATH)
    rows = [(i if i % 5 else None, t, "x") for i, t in enumerate([*TEXTS, None, "word " * 5000, "a b " * 2047, "b " * 2046])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string").repartition(3)
    out = pack(docs, PATH).collect()
    assert set(out[0].asDict()) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"}
    want = Counter()
    for i, text, _ in rows:
        ids = own.encode(text or "", add_special_tokens=False).ids + [0]
        want[i, tuple(ids)] += 1
    by = {}
    for r in out:
        assert len(r.ids) == r.length <= 2048 and zlib.crc32(array("I", r.ids).tobytes()) == r.ids_crc32
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
        if r.piece:
            assert r.length == 2048
    for own_rows in by.values():
        own_rows.sort()
        assert own_rows[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own_rows, own_rows[1:], strict=False))
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, ids in want:
        if i is not None:
            own_rows = sorted(pieces[i], key=lambda r: r.start)
            assert [r.piece for r in own_rows] == list(range(len(own_rows)))
            assert sum((list(r.ids) for r in own_rows), []) == list(ids)
    assert sum(r.length for r in out) == sum(len(k[1]) * n for k, n in want.items())


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH, with_ids=False).count() == 0


def fewest(lengths, capacity):
    """The least number of bins, by trying all places for the largest item left."""
    best = len(lengths)

    def go(left, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if not left:
            best = len(bins)
            return
        for k in {x: i for i, x in enumerate(bins)}.values():
            if bins[k] + left[0] <= capacity:
                go(left[1:], [*bins[:k], bins[k] + left[0], *bins[k + 1 :]])
        go(left[1:], [*bins, left[0]])

    go(sorted(lengths, reverse=True), [])
    return best


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_near_the_optimum(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 11))]
    got = len({s + i for _, _, n, s, _ in plan(Counter(lengths), 30) for i in range(n)})
    assert got <= fewest(lengths, 30) * 3 / 2


def test_columns_that_have_no_order(spark):
    docs = spark.createDataFrame([(1, "a b", {"k": 1}, None), (1, "a b", {"k": 2}, {"x": [1.0]}), (2, "a", None, None)], "doc_id long, text string, m map<string,int>, rank map<string,array<double>>")
    out = pack(docs, PATH, with_ids=False)
    assert out.columns[:3] == ["doc_id", "m", "rank"]
    assert sorted((r.offset, r.length) for r in out.collect()) == [(0, 3), (3, 3), (6, 2)]
