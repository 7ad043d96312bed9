import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from formlens.llm import mixing, quality
from formlens.llm.queries import op7_quality_rules, op8_poisson_mixing


def made(tmp_path):
    rng = random.Random(9)
    words = ["the", "of", "and", "#tag", "wow!!", "é", "x" * 30, *["".join(rng.choice("abcde") for _ in range(rng.randint(1, 9))) for _ in range(60)]]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \t\n", "a b c", "same words here again and over " * 12, line(3000)]
    for _ in range(60):
        lines = [line(rng.randint(1, 15)) for _ in range(rng.randint(1, 12))]
        texts.append("\n".join(lines + rng.choices(lines, k=rng.randint(0, 8))) + rng.choice(["", "\n", "\v\f\r", " | $ %"]))
    rows = [{"doc_id": i, "text": t, "source": None if i % 7 == 0 else f"src{i % 4 if i > 5 else 29}"} for i, t in enumerate(texts)]
    pq.write_table(pa.Table.from_pylist(rows), tmp_path / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet'")
    return con, rows


def same(df, con, sql):
    want = con.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = df.select(columns).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want.fetchall(), key=str)
    return got


def test_quality_as_oracle(spark, tmp_path):
    con, _ = made(tmp_path)
    got = same(op7_quality_rules(spark, str(tmp_path)), con, quality.ORACLE_SQL)
    assert {r.kept for r in got} == {True, False} and any(r.n_repeat_words for r in got)
    docs = spark.createDataFrame([(1, "a b", 5)], "N_Words long, text string, doc_id int")
    assert quality.judge(docs).columns[:2] == ["text", "doc_id"] and quality.judge(docs.limit(0)).count() == 0


def test_mixing_as_oracle(spark, tmp_path):
    con, rows = made(tmp_path)
    same(op8_poisson_mixing(spark, str(tmp_path)), con, mixing.ORACLE_SQL)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = mixing.mix(docs.unionByName(docs), {"src1": 3.0}, other=0.0, epochs=400.0)
    assert {r.source for r in out.select("source").distinct().collect()} == {"src1"}
    total = sum(len((r["text"] or "").encode()) for r in rows)
    got = sum(len(r.text.encode()) for r in out.collect())
    assert abs(got / (2 * 400 * total) - 1) < 0.1  # a rate over 256 is drawn in parts
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs.filter("doc_id < 2")).count() == 0


def test_mixing_of_odd_rows(spark):
    rows = [(None, "a b", "x", 1, "k"), (None, None, "x", 2, "k"), (1, "t" * 50, "x", 3, "k"), (1, "t" * 50, "x", 3, "k"), (2, "u" * 40, None, 4, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, COPY int, order_key string")
    got = mixing.mix(docs, {"x": 2.0}, epochs=4.0)
    assert got.columns == ["doc_id", "text", "source", "copy", "order_key"]
    rows = got.collect()
    assert len({(r.doc_id, r.text, r.order_key) for r in rows if r.doc_id != 1}) == sum(r.doc_id != 1 for r in rows)
    twice = [r.copy for r in rows if r.doc_id == 1]
    assert all(twice.count(k) == 2 for k in twice)  # repeated rows are drawn alike


def test_mixing_carries_whole_rows_through_its_shuffle(spark, tmp_path):
    made(tmp_path)
    plan = op8_poisson_mixing(spark, str(tmp_path))._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    exchange = next(x for x in plan.splitlines() if "hashpartitioning(order_key" in x)
    assert "text" in plan[plan.index(exchange) :].splitlines()[1]
