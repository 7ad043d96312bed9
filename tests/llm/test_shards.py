import itertools
import random
import zlib

import numpy as np

from formlens.llm.shards import differenced, shard


def test_differenced_places_every_part():
    rng = random.Random(2)
    for k in (1, 2, 5, 40):
        for n in (0, 1, 2, 30, 200):
            items = [[rng.randint(1, 1000) for _ in range(rng.randint(1, k))] for _ in range(n)]
            parts, sums = differenced(items, k)
            got = [0] * k
            for item, to in zip(items, parts, strict=True):
                assert len(set(to)) == len(to) == len(item)
                for x, p in zip(item, to, strict=True):
                    got[p] += x
            assert got == (sums or [0] * k)
            if n == 200:
                assert max(got) - min(got) <= 60


def test_differenced_is_near_the_best_partition():
    """Against all partitions of few items, and against dealing the largest first to the smallest sum."""
    rng = random.Random(3)
    found = dealt = 0
    for k, n in ((2, 9), (3, 7)) * 20:
        items = [rng.randint(1, 100) for _ in range(n)]
        spread = lambda to: (lambda t: max(t) - min(t))([sum(x for x, p in zip(items, to, strict=True) if p == i) for i in range(k)])  # noqa: B023, E731
        best = min(map(spread, itertools.product(range(k), repeat=n)))
        got = spread([p[0] for p in differenced([[x] for x in items], k)[0]])
        sums, to = [0] * k, {}
        for i in sorted(range(n), key=lambda i: -items[i]):
            to[i] = sums.index(min(sums))
            sums[to[i]] += items[i]
        assert got >= best
        found, dealt = found + got - best, dealt + spread([to[i] for i in range(n)]) - best
    assert found < dealt


def test_kinds_keep_parts_among_their_own():
    rng = random.Random(4)
    kinds = np.array([1, 0, 1, 2, 0, 1, 0, 0])
    items = [[rng.randint(0, 1000) for _ in range(8)] for _ in range(30)]
    parts, sums = differenced(items, 8, kinds)
    got = [0] * 8
    for item, to in zip(items, parts, strict=True):
        assert sorted(to) == list(range(8)) and all(kinds[i] == kinds[p] for i, p in enumerate(to))
        for x, p in zip(item, to, strict=True):
            got[p] += x
    assert got == sums and np.ptp(np.array(sums)[kinds == 0]) <= 60


def test_cells_beside_a_heavy_group(spark):
    """Small cells beside a group of a quarter of a shard: their surplus must not add up on the same shards."""
    rng = random.Random(7)
    texts = [f"{i:06d}" + "z" * rng.randint(0, 1800) for i in range(12_000)] + ["heavy" * 10] * 1050
    total = sum(len(t) + 16 for t in texts)
    assert 1 / 5 < 1050 * 66 / (total / 40) < 1 / 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for cell in (400, 100):
        got = [r.n for r in shard(docs, 40, cell=cell).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "n").collect()]
        assert len(got) == 40 and max(got) - min(got) <= 0.02 * total / 40, (min(got), max(got))


def test_shards(spark):
    rng = random.Random(5)
    texts = ["x" * rng.randint(0, 3000) + str(i) for i in range(3000)] + ["same é" * 50] * 400 + ["big" * 150_000, None, "", ""]
    rows = [(i if i % 11 else None, t, "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, shard string").repartition(7)
    for cell in (4096, 100):
        out = shard(docs, 10, cell=cell).collect()
        assert len(out) == len(rows) + 3
        total, slots, of = [0] * 10, {}, {}
        for r in out:
            assert r.size == len((r.text or "").encode()) + 16 and r.text_crc32 == zlib.crc32((r.text or "").encode())
            assert r.law == "bytes" and r.grown_shard is None
            total[r.shard] += r.size
            slots.setdefault(r.shard, []).append(r.slot)
            assert of.setdefault(r.text or "", r.shard) == r.shard
        assert all(sorted(x) == list(range(len(x))) for x in slots.values())
        total.sort()
        assert total[9] - total[0] <= (40 if cell == 4096 else 3000)


def test_group_that_fills_a_shard(spark):
    rng = random.Random(6)
    texts = [str(i) + "y" * rng.randint(0, 900) for i in range(2000)] + ["hot" * 40] * 3000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for cell in (4096, 90):
        total = sorted(r.total for r in shard(docs, 8, cell=cell).groupBy("shard").agg({"size": "sum"}).withColumnRenamed("sum(size)", "total").collect())
        assert total[7] == 3000 * 136 and total[6] - total[0] <= 500


def test_empty(spark):
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
