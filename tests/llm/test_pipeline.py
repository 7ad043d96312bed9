import hashlib
import math
import random

import duckdb
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from test_jaccard import brute as groups_of
from test_suffix_dedup import brute as repeats_of
from tokenizers import Tokenizer

import corpus_pipeline
from formlens.llm import mixing, quality


def made():
    rng = random.Random(12)
    words = ["the", "of", "and", *["".join(rng.choice("abcdefghié") for _ in range(rng.randint(2, 8))) for _ in range(500)]]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n - 4)) + " the of and the"
    shared = prose(120)
    texts = []
    for _ in range(25):
        x = prose(rng.randint(25, 200)).split(" ")
        texts += [" ".join(x), " ".join([*x[:-1], "end"]), prose(60) + " " + shared[rng.randint(0, 50) :], prose(30) + "\n" + prose(40)]
    texts += ["short", None, "", "# " * 80, "again and again the same " * 30, texts[0], texts[0]]
    rows = [(i, t, "en", "hot" if i % 3 else f"src{i % 5}", len(t or "")) for i, t in enumerate(texts)]
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]


def poisson(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total <= u:
        k += 1
        p *= mean / k
        total += p
    return k


def test_as_brute_force(spark, tmp_path):
    rows = made()
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    columns = docs.columns
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, str(tmp_path))
        assert docs.columns == columns
        seen[name] = [r.asDict() for r in docs.collect()]
        docs = spark.createDataFrame([tuple(r.values()) for r in seen[name]], "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    kept = {r[0] for r in con.execute(f"SELECT doc_id FROM ({quality.ORACLE_SQL}) WHERE kept").fetchall()}
    good = [r for r in rows if r["doc_id"] in kept]
    assert sorted(r["doc_id"] for r in seen["quality rules"]) == sorted(kept) and 60 < len(kept) < len(rows)

    told = groups_of([(r["doc_id"], r["text"]) for r in good])
    first = [r for r, (least, _, _) in zip(good, told, strict=True) if r["doc_id"] == least]
    assert sorted(r["doc_id"] for r in seen["n-gram Jaccard join"]) == sorted(r["doc_id"] for r in first) and len(first) < len(good)

    want = {r["doc_id"]: x[3] for r, x in zip(first, repeats_of([r["text"] for r in first], 400), strict=True)}
    got = {r["doc_id"]: r for r in seen["suffix-array dedup"]}
    assert got.keys() == want.keys() and any(len(r["text"]) < len(rows[k]["text"]) for k, r in got.items())
    for k, r in got.items():
        raw = r["text"].encode()
        assert r["n_chars"] == len(r["text"]) and (hashlib.sha256(raw).hexdigest() == want[k] or len(raw) < len(rows[k]["text"].encode()))

    bytes_of = {}
    for r in got.values():
        bytes_of[r["source"]] = bytes_of.get(r["source"], 0) + len(r["text"].encode())
    copies = {}
    for r in got.values():
        weight = {k: mixing.WEIGHTS.get(k, 1.0) for k in bytes_of}
        rate = weight[r["source"]] * sum(bytes_of.values()) / (sum(weight.values()) * bytes_of[r["source"]])
        u = int(hashlib.md5(f"0:{r['doc_id']}:1".encode()).hexdigest()[:13], 16) / 2**52
        copies[r["doc_id"]] = poisson(rate, u)
    drawn = [r["doc_id"] for r in seen["mixing sources"]]
    assert {k: drawn.count(k) for k in copies} == copies

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    size = {k: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for k, r in got.items()}
    pieces = [r.asDict() for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sum(r["length"] for r in pieces) == sum(size[k] for k in drawn)
    for k, n in copies.items():
        assert sum(r["doc_id"] == k and r["piece"] == 0 for r in pieces) == n
    held = {}
    for r in pieces:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for runs in held.values():
        at = 0
        for offset, length in sorted(runs):
            assert offset == at
            at += length
        assert at <= 2048


def test_passages_of_over_50_words_go(spark):
    rng = random.Random(4)
    prose = lambda n, least: " ".join("".join(rng.choice("abcdefghijklé") for _ in range(rng.randint(least, 5))) for _ in range(n))
    for n, gone in ((55, True), (51, True), (50, False)):
        passage = prose(n, 1)
        assert len(passage.encode()) < 256
        own = [(prose(150, 3), prose(150, 3)) for _ in range(2)]
        texts = [own[0][0] + " " + passage + "\n" + own[0][1], own[1][0] + "\n" + passage.replace(" ", "  ", 3) + " " + own[1][1], prose(70, 2)]
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
        got = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, docs, "").collect()}
        if gone:
            assert got == {0: own[0][0] + " \n" + own[0][1], 1: own[1][0] + "\n " + own[1][1], 2: texts[2]}
        else:
            assert got == dict(enumerate(texts))
