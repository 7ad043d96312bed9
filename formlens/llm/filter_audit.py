"""Audit of how filters interact: what each would remove at each place of each order, from counts of the sets they fail.

Words are exploded and counted by (document, word), then by document; other measures are joined to that. Each document
fails a set of filters; for each part of the corpus the documents of each of the 2^k sets are counted, as are those of them
with good and with toxic labels. All orders follow from these counts, so no document is looked at once for each order.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small, stage

BLANK = r"[\x20\x09-\x0D]"
#: Letter and condition of failure, over the measures n_words, n_distinct, n_chars, n_upper (longs), marked, copied (booleans).
FILTERS = {
    "A": "n_words < 200",
    "B": "100 * n_distinct < 50 * n_words",
    "C": "100 * n_upper > 2 * n_chars",
    "D": "marked",
    "E": "copied",
}


def word_counts(rows: DataFrame) -> DataFrame:
    """rid, n_words, n_distinct of rows (rid, text) that have a word. rows must be staged.

    Texts are dealt by rid before they are exploded, so neither aggregate moves a row for each word.
    """
    word = F.explode(F.split("text", f"{BLANK}+")).alias("word")
    words = rows.select("rid", "text").repartition("rid").select("rid", word).filter("word != ''")
    counted = words.groupBy("rid", "word").agg(F.count("*").alias("n"))
    return counted.groupBy("rid").agg(F.sum("n").alias("n_words"), F.count("*").alias("n_distinct"))


def measured_rows(docs: DataFrame, column: str = "text", key: str = "doc_id", by: str = "source") -> DataFrame:
    """key, part and the measures of each row of docs; a text is a copy if one with a smaller key is identical, by SHA-256."""
    text = F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))
    part = F.coalesce(F.col(f"`{by}`").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{key}`").alias("key"), part.alias("part"), text.alias("text"))
    length = F.length("text").cast("long")
    upper = length - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = stage(rows.select("*", length.alias("n_chars"), upper.alias("n_upper"), F.col("text").rlike(r"[#$%&*|]").alias("marked"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), "texts")
    first = rows.groupBy("sha").agg(F.min("key").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    out = rows.drop("text").join(word_counts(rows), "rid", "left").join(small(stage(first, "first"), 64), "sha", "left")
    none = F.lit(0).cast("long")
    copied = F.coalesce(F.col("key") > F.col("first"), F.lit(False))
    return out.select("key", "part", F.coalesce("n_words", none).alias("n_words"), F.coalesce("n_distinct", none).alias("n_distinct"), "n_chars", "n_upper", "marked", copied.alias("copied"))


def failure_counts(rows: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, key: str = "doc_id") -> DataFrame:
    """part, and the arrays n, good, toxic: how many of its rows fail just the filters whose bits m has, at place m."""
    told = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    labels = labels.groupBy(F.col(f"`{key}`").alias("key")).agg(told("quality"), told("toxic"))
    mask = sum((F.when(F.coalesce(F.expr(x), F.lit(False)), 1 << i).otherwise(0) for i, x in enumerate(filters.values())), F.lit(0))
    rows = rows.select("key", "part", mask.alias("mask")).join(small(stage(labels, "labels"), 24), "key", "left")
    of = {"n": F.lit(True), "good": F.coalesce("quality", F.lit(False)), "toxic": F.coalesce("toxic", F.lit(False))}
    sums = [F.count_if((F.col("mask") == m) & ok).alias(f"{c}{m}") for c, ok in of.items() for m in range(1 << len(filters))]
    arrays = [F.array(*[F.col(f"{c}{m}") for m in range(1 << len(filters))]).alias(c) for c in of]
    return stage(rows.groupBy("part").agg(*sums), "failures").select("part", *arrays)


def orders(counts: DataFrame, filters: dict[str, str] = FILTERS) -> DataFrame:
    """What each filter does at each step of each order, from failure_counts."""
    letters = "".join(filters)
    all_orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = counts.withColumn("filter_order", F.explode(all_orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    # The letter at place i of `letters` has bit i.
    bit = lambda at: f"shiftleft(1, instr('{letters}', substr(filter_order, {at}, 1)) - 1)"
    before = f"aggregate(sequence(1, step), 0, (a, i) -> a + IF(i < step, {bit('i')}, 0))"
    rows = rows.withColumn("own", F.expr(bit("step"))).withColumn("before", F.expr(before))

    def total(where: str, counted: str = "n", times: str = "1") -> Column:
        """The sum over the sets m for which `where` holds."""
        return F.expr(f"aggregate(sequence(0, {(1 << len(letters)) - 1}), 0L, (a, m) -> a + IF({where}, {counted}[m] * ({times}), 0L))")

    here, earlier = "(m & own) != 0", "(m & before) != 0"
    return rows.select(
        "part", "filter_order", "step",
        total(f"NOT {here} AND NOT {earlier}").alias("kept"),
        total(f"{here} AND NOT {earlier}").alias("removed"),
        total(f"{here} AND {earlier}").alias("redundant"),
        total("m = own").alias("unique_fails"),
        total(f"{here} AND NOT {earlier}", "good").alias("good_lost"),
        total(f"{here} AND NOT {earlier}", "toxic").alias("toxic_lost"),
        # A filter is the first of the m's in 1 of |m| orders.
        total(here, "n", f"{factorial(len(letters))} div bit_count(m)").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, column: str = "text", key: str = "doc_id", by: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley (longs).

    One row for each part, order of the filters and step, zeros included; a null part is the empty string, a null text
    empty. Rows are counted, so repeated rows count as often as they are there, while none of two rows with the same key is
    the other's copy, and one without a key is no copy. Several labels of a key are joined: good or toxic if one says so. No documents, no rows; no
    labels, none lost. Parts are counted in tasks before they meet, so one may hold any share of the rows; a long text is
    exploded in one task, where its different words are held. Columns beside the named ones aren't read.
    """
    return orders(failure_counts(measured_rows(docs, column, key, by), labels, filters, key), filters)


#: Of the query, for DuckDB: each document's first failing filter, by order.
ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM t),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, len(ws) < 200 AS a, 100 * len(list_distinct(ws)) < 50 * len(ws) AS b, 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) AS c,
  regexp_matches(t, '[#$%&*|]') AS d, coalesce(w.doc_id > first, false) AS e, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
g AS (SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS fails,
  good, toxic, count(*) AS n FROM f GROUP BY ALL),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.l, q.l, r.l, s.l, t.l])) = 5),
h AS (SELECT *, (SELECT min(instr(filter_order, u)) FROM (SELECT unnest(string_split(fails, '')) AS u) WHERE u <> '') AS first FROM g, o),
z AS (SELECT *, substr(filter_order, step::INT, 1) AS own FROM h, range(1, 6) k(step)),
s AS (SELECT part, filter_order, step::INT AS step, own,
  coalesce(sum(n) FILTER (first IS NULL OR first > step), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (first = step), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (contains(fails, own) AND first < step), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (fails = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (first = step AND good), 0)::BIGINT AS good_lost, coalesce(sum(n) FILTER (first = step AND toxic), 0)::BIGINT AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM s
"""
