import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from formlens.llm._common import word_marks
from formlens.llm.jaccard import near_groups, one_of_each


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def brute(rows):
    """(class_id, n_links, n_copies) of each row; rows: (doc_id, text)."""
    sets = [grams(t) for _, t in rows]
    root = list(range(len(rows)))

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    links, copies = Counter(), Counter()
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and Fraction(len(a & b), len(a | b)) >= Fraction(8, 10):
                links[i] += 1
                links[j] += 1
                copies[i] += a == b
                copies[j] += a == b
                root[up(i)] = up(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[up(i)] = min(k, least.get(up(i), k))
    return [(least.get(up(i)), links[i], copies[i]) for i in range(len(rows))]


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3) + rng.choice("xyzß")
    prose = lambda n: [word() for _ in range(n)]
    texts = [None, "", " \n\t", "one two", "one two", "one  two\n", "two one", "a b c d e", "a b c d e"]
    for _ in range(12):
        base = prose(rng.randint(12, 120))
        for _ in range(rng.randint(1, 8)):
            x = list(base)
            for _ in range(rng.randint(0, 3)):
                x[rng.randrange(len(x))] = word()
            texts.append(" ".join(x))
        texts.append(" ".join(prose(60)) + " " + " ".join(base))
    base = prose(200)
    for k in range(40):
        x = list(base)
        x[k * 3] = "new" + str(k)
        texts.append(" ".join(x))
    texts.append(" ".join(base * 40))
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    return rows + rows[5:40:5]


@pytest.mark.parametrize("how", [{}, {"bucket_rows": 6, "levels": 1, "block": 7, "runs": 30}, {"bucket_rows": 20, "levels": 3, "block": 16, "runs": 40}])
def test_as_brute_force(spark, how):
    rows = made(3)
    docs = spark.createDataFrame([(k, t, n) for n, (k, t) in enumerate(rows)], "doc_id long, text string, size int").repartition(5)
    got = {r["size"]: r for r in near_groups(docs, **how).collect()}
    assert len(got) == len(rows)
    for n, want in enumerate(brute(rows)):
        r = got[n]
        assert (r.class_id, r.n_links, r.n_copies) == want, (n, rows[n])


def test_one_of_each(spark):
    rows = made(4)
    docs = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, first string").repartition(3)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    kept = Counter((r.doc_id, r.text) for r in kept.collect())
    told = brute(rows)
    want = Counter()
    seen = set()
    for (k, t), (group, links, _) in zip(rows, told, strict=True):
        if not links:
            want[k, t] += 1
        elif k == group and k is not None and (k, t) not in seen:
            seen.add((k, t))
            want[k, t] += 1
    assert kept == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, class_id int")
    assert near_groups(docs).count() == 0 and one_of_each(docs).count() == 0


def test_words_are_told_apart_by_all_their_bytes():
    texts = ["prefixprefix" + "x" * n + end for n in (0, 3, 900, 3000) for end in ("a", "b", "ab", "ba")]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    marks, at = word_marks(data, np.array([0, len(data)]))
    assert len(set(marks.tolist())) == len(texts) == at[1]


def test_a_family_beyond_many_blocks_links_by_its_pivot(spark):
    rng = random.Random(9)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(160):
        x = list(base)
        for _ in range(k % 4):  # the far ones are linked to some only
            x[rng.randrange(len(x))] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(x)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in near_groups(docs, block=12).collect()}
    want = brute(rows)
    assert got == dict(enumerate(want)) and len({x[1] for x in want}) > 3
