import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from formlens.llm.queries import QUERIES
from formlens.llm.suffix_dedup import remove_repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    out = []
    for x in raw:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if seen[x[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        left = bytes(b for b, g in zip(x, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(x), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def made(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(150)
    texts = [None, "", "short", "a" * 1500, shared, shared, shared[:420], prose(50) + shared[7:]]
    for _ in range(25):
        a = rng.randint(0, 200)
        texts.append(prose(rng.randint(0, 90)) + shared[a : a + rng.randint(380, 600)] + prose(rng.randint(0, 90)))
        x = prose(180)
        texts += [x, x[:500] + "!" + x[501:], prose(30)]
    texts += ["xy" * 600, prose(30) + "xy" * 300, texts[9], "é" * 700 + prose(80)]
    return texts


@pytest.mark.parametrize("bucket_rows", [4096, 5])
def test_as_brute_force(spark, bucket_rows):
    texts = made(bucket_rows)
    docs = spark.createDataFrame([(i if i % 7 else None, t, i) for i, t in enumerate(texts)], "doc_id long, text string, n int").repartition(5)
    got = {r.n: tuple(r)[3:7] for r in remove_repeats(docs, bucket_rows=bucket_rows).collect()}
    for i, want in enumerate(brute(texts, 400)):
        assert got[i] == want, (i, texts[i])


@pytest.mark.parametrize("length", [256, 577, 700, 2000])
def test_other_lengths(spark, length):
    rng = random.Random(length)
    prose = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    texts = [prose(length - 1), prose(length) * 2]
    for _ in range(14):
        x = prose(4 * length)
        at = rng.randrange(len(x))
        texts += [x, x[:at] + "#" + x[at + 1 :], prose(50) + x[length // 2 : length // 2 + rng.choice([length - 1, length, length + 90])]]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    got = {r.n: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, length=length).collect()}
    assert got == dict(enumerate(brute(texts, length)))


def test_empty_table_and_clashing_names(spark):
    none = spark.createDataFrame([], "doc_id long, text string, kept string, fp int, N_BYTES int")
    out = remove_repeats(none)
    assert out.columns == ["doc_id", "text", "fp", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
    assert out.count() == 0
    one = spark.createDataFrame([(1, "t", 5, "x" * 900)], "low int, at string, fp int, text string")
    assert remove_repeats(one).first().n_removed == 900


def test_cut_characters_are_left_out(spark):
    shared = "\u00a9" + "q" * 398  # 400 bytes; its first byte is also that of the other character
    out = remove_repeats(spark.createDataFrame([("ab" + shared,), ("\u00c3" + shared[1:] + "\u00a9" * 2,), ("w" * 3 + "\u00a9" + shared[1:] + "z",)], "text string")).collect()
    assert sorted(r.kept_text for r in out) == sorted(["ab", "\u00c3" + shared[1:] + "\u00a9" * 2, "wwwz"])


def brute_words(texts, words, length):
    """The characters that neither a repeated run of words nor a repeated string of bytes covers; texts are ASCII."""
    at = [[m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    runs = [[tuple(t[a:b] for a, b in x[i : i + words]) for i in range(len(x) - words + 1)] for t, x in zip(texts, at, strict=True)]
    seen = Counter(r for x in runs for r in x)
    strings = Counter(t[i : i + length] for t in texts if t for i in range(len(t) - length + 1))
    out = []
    for t, x, own in zip(texts, at, runs, strict=True):
        t = t or ""
        gone = [False] * len(t)
        for i, r in enumerate(own):
            if seen[r] > 1:
                low, end = x[i][0], x[i + words - 1][1]
                gone[low:end] = [True] * (end - low)
        for i in range(len(t) - length + 1):
            if strings[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        out.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("bucket_rows", [4096, 5])
@pytest.mark.parametrize("words", [32, 51])
def test_words_as_brute_force(spark, words, bucket_rows):
    rng = random.Random(words + bucket_rows)
    prose = lambda n: "".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", " ", "\n", "\t ", "  "]) for _ in range(n))
    shared = prose(130).split()
    texts = [None, "", "few words", "a " * 300, " b" * (words + 1), "c " * (words - 1), "x" * 900, " ".join(shared), "\n".join(shared)]
    for _ in range(25):
        a, n = rng.randint(0, 60), rng.choice([words - 1, words, words + 9])
        texts.append(prose(rng.randint(0, 60)) + rng.choice([" ", "\r\n"]).join(shared[a : a + n]) + " " + prose(rng.randint(0, 60)))
        x = prose(150)
        texts += [x, x[:300] + "!" + x[301:], prose(20)]
    texts += [texts[10], texts[10].replace(" ", "  ")]
    docs = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(5)
    got = {r.n: r for r in remove_repeats(docs, words=words, apart=True, bucket_rows=bucket_rows).collect()}
    for i, (want, text) in enumerate(zip(brute(texts, 400), brute_words(texts, words, 400), strict=True)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i])
        assert (r.kept_text, r.n_passage_bytes) == (text, want[0] - want[1] - len(text)), (i, texts[i])
    assert sum(r.n_passage_bytes > 0 for r in got.values()) > 10 and sum(r.n_removed > 0 for r in got.values()) > 10
    one = {r.n: r.kept_text for r in remove_repeats(docs, words=words, bucket_rows=bucket_rows).collect()}
    assert one == {k: r.kept_text for k, r in got.items()}


def test_query_leaves_out_passages_of_over_50_words(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 6))) for _ in range(n))
    short, long, few = prose(55), prose(90), prose(50)
    assert len(short) < 400 < len(long)
    texts = [f"{prose(90)}\n{p}\n{prose(90)}" for p in (short, short, long, long, few, few)] + [prose(200), None]
    pq.write_table(pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t in enumerate(texts)]), tmp_path / "documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect()}
    for i, want in enumerate(brute(texts, 400)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want
        text = texts[i] or ""
        for p in (short, long):
            text = text.replace(f"\n{p}\n", "" if p == long else "\n\n")
        assert (r.text, r.n_chars, r.n_passage_bytes) == (text, len(text), len(short) if i < 2 else 0)
