import hashlib
import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from formlens.llm import block_naming
from formlens.llm.queries import op11_block_naming


def brute(rows):
    """By lower-cased text: the largest id, the size of the group."""
    low = lambda t: (t or "").translate(str.maketrans(block_naming.UPPER, block_naming.LOWER))
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return [(i, keep[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for i, t in rows]


def texts():
    rng = random.Random(4)
    out = [None, "", "a", "A", "ab", "É", "é", "ÀB", "Àb", "x" * 4000, "X" * 4000, "x" * 3999, "x" * 3999 + "é", "\x00", "\x00\x00"]
    base = "".join(rng.choice("abC é\n") for _ in range(5000))
    out += [base, base.upper(), base.swapcase(), base[:-1], base[1:], base[:2500] + "!" + base[2501:], base + "a"]
    out += ["".join(rng.choice("aB") for _ in range(rng.randint(0, 6))) for _ in range(150)]
    return out


@pytest.mark.parametrize(("block", "bits"), [(1024, 64), (4, 64), (4, 3), (7, 0)])
def test_as_brute_force(spark, block, bits):
    """Few bits of hash make most blocks tie, so their bytes tell them apart; small blocks make many levels."""
    rows = [(i if i % 11 else None, t) for i, t in enumerate(texts())] + [(500, "Twice"), (500, "tWICE"), (499, "twice"), (500, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = block_naming.dedup(docs, block=block, bits=bits).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == sorted(brute(rows), key=str)
    kept = [r for r in got if r.kept]
    assert len({r.text_sha256 for r in kept}) == len(kept) == len({r.text_sha256 for r in got})
    assert all(r.doc_id == r.keep_id for r in kept)


def test_as_oracle(spark, tmp_path):
    rows = [{"doc_id": i // 2 if i < 8 else i, "text": t} for i, t in enumerate(texts())]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    want = con.execute(block_naming.ORACLE_SQL)
    columns = [c[0] for c in want.description]
    got = op11_block_naming(spark, str(tmp_path))
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_other_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(2, "A", 1, 7, "x"), (1, "a", 2, 8, None)], "doc_id int, text string, KEPT int, rid int, `a.b` string")
    out = block_naming.dedup(docs)
    assert out.columns == ["doc_id", "text", "rid", "a.b", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted((r.doc_id, r.text, r.rid, r["a.b"], r.keep_id, r.kept) for r in out.collect()) == [(1, "a", 8, None, 2, False), (2, "A", 7, "x", 2, True)]
    assert block_naming.dedup(docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, None), (None, "")], "doc_id long, text string")
    assert sorted((r.keep_id is None, r.group_size, r.kept) for r in block_naming.dedup(nulls).collect()) == [(True, 2, False), (True, 2, True)]


def test_a_hot_text_meets_as_few_rows(spark):
    """Two thirds of the rows are one text: each of its blocks is named once."""
    docs = spark.range(900).selectExpr("id AS doc_id", "if(id % 3 = 0, concat('row ', id), repeat('same text ', 300)) AS text")
    got = block_naming.dedup(docs, block=64).groupBy("group_size", "kept").count().collect()
    assert sorted(map(tuple, got)) == [(1, True, 300), (600, False, 599), (600, True, 1)]
