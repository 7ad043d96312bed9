import random
import re
from itertools import permutations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from formlens.llm import filter_audit
from formlens.llm.queries import op12_filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made():
    rng = random.Random(12)
    rows, texts = [], [None, "", " \n\t", "a b", "#", "É" * 40 + "A", "AB" * 5]
    for _ in range(120):
        pool = [rng.choice("abcdXYZé|") * rng.randint(1, 4) + str(rng.randint(0, 9)) for _ in range(rng.choice([3, 40, 300]))]
        texts.append(" ".join(rng.choice(pool) for _ in range(rng.choice([5, 199, 200, 260]))).replace("|", rng.choice(["x", "|"])))
    for i in range(240):
        rows.append((i // 2 if i < 10 else i, rng.choice(texts), rng.choice([None, "", "s1", "s1", "s1", "s2"])))
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    return rows, labels


def brute(rows, labels):
    """Each order applied to the documents one filter after the other."""
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    least = {}
    for d, t, _ in rows:
        least[t or ""] = min(d, least.get(t or "", d))
    docs = []
    for d, t, s in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d > least[t]}
        docs.append((d, s or "", {k for k, v in fails.items() if v}))
    out, sums = {}, {}
    for part in {p for _, p, _ in docs}:
        for order in permutations("ABCDE"):
            left = [x for x in docs if x[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[2]]
                again = [x for x in gone if f in x[2]]
                left = [x for x in left if f not in x[2]]
                gone += now
                alone = [x for x in docs if x[1] == part and x[2] == {f}]
                out[part, "".join(order), step] = [len(left), len(now), len(again), len(alone), sum(x[0] in good for x in now), sum(x[0] in toxic for x in now)]
                sums[part, f] = sums.get((part, f), 0) + len(now)
    return sorted((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_as_brute_force_and_oracle(spark, tmp_path):
    rows, labels = made()
    want = brute(rows, labels)
    assert {len({r[k] for r in want}) > 3 for k in range(3, 10)} == {True}  # no count is idle
    pq.write_table(pa.Table.from_pylist([dict(zip(("doc_id", "text", "source"), r, strict=True)) for r in rows]), tmp_path / "documents.parquet")
    pq.write_table(pa.Table.from_pylist([dict(zip(("doc_id", "quality", "toxic"), r, strict=True)) for r in labels]), tmp_path / "labels.parquet")
    got = op12_filter_audit(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == want
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    told = con.execute(filter_audit.ORACLE_SQL)
    assert [c[0] for c in told.description] == got.columns
    assert sorted(told.fetchall()) == want


def test_odd_tables(spark):
    docs, labels = frames(spark, [(None, "a", None), (None, "a", "x"), (1, "a", "x")], [])
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(docs, labels).collect()}
    assert len(got) == 2 * 600 and {r.good_lost + r.toxic_lost for r in got.values()} == {0}
    assert got["x", "EABCD", 1].removed == 0 and got["x", "ABCDE", 1].removed == 2 and got["x", "BACDE", 2].shapley == 240
    assert filter_audit.audit(docs.limit(0), labels).count() == 0
    clash = docs.selectExpr("*", "1 AS part", "'y' AS rid", "2 AS sha", "3 AS `first`")
    assert filter_audit.audit(clash, labels).count() == 1200


def test_other_filters(spark):
    docs, labels = frames(spark, [(1, "one two two", "s"), (2, "#", "s"), (3, "one two two", "s")], [(3, 1, 1)])
    got = filter_audit.audit(docs, labels, {"X": "marked", "Y": "copied"}).orderBy("filter_order", "step").collect()
    assert [tuple(r) for r in got] == [("s", "XY", 1, 2, 1, 0, 1, 0, 0, 2), ("s", "XY", 2, 1, 1, 0, 1, 1, 1, 2), ("s", "YX", 1, 2, 1, 0, 1, 1, 1, 2), ("s", "YX", 2, 1, 1, 0, 1, 0, 0, 2)]
