"""Quality rules: a table of thresholds compiled into one projection of Spark's own functions."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words: runs without space, tab, LF, VT, FF, CR.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
WINDOW = 8

#: Common words of English, German, French and Spanish.
STOP_WORDS = """
the of and to a in is that for it as was with be by on not he his but at are this have from or had an they which you
der die das und ist von zu den mit des im auf ein eine nicht sich als auch es dem für
le la les de des et un une que est en du pour dans qui sur pas par au ce
el los las y del se por con para su no lo una como más
""".split()


class Rule(NamedTuple):
    """A row fails under `least` or over `most`; the measure is SQL over what measures() gives."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: A text is kept if it breaks no rule. No rule has an upper bound on length.
RULES = (
    Rule("word_length", "try_divide(word_chars, n_words)", 1.5, 16),
    Rule("symbols", "try_divide(n_symbols, n_words)", None, 0.1),
    Rule("stop_words", "try_divide(n_stop_words, n_words)", 0.04, None),
    Rule("shouting", "try_divide(n_loud_words, n_words)", None, 0.4),
    Rule("duplicate_lines", "try_divide(n_dup_lines, n_lines)", None, 0.5),
)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _windows(h: Column) -> Column:
    """Hashes of the windows of 8 words with hashes h."""
    return F.transform(F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(h, i, WINDOW)))


def _covered(s: Column) -> Column:
    """Words in the windows of s, sorted structs of hash h and place i, that have an equal neighbour."""
    same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
    again = F.transform(s, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    # Each repeated window covers its words up to the next repeated window.
    words = lambda q: F.transform(q, lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - i, F.lit(WINDOW))))
    return _let(F.sort_array(F.filter(again, lambda i: i.isNotNull())), lambda q: F.aggregate(words(q), F.lit(0), lambda a, x: a + x))


def _repeats(w: Column) -> Column:
    """Words in 8-word windows that are found twice or more; only a text with equal windows has them sorted."""
    placed = lambda p: F.sort_array(F.transform(p, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    found = lambda p: F.when(F.size(F.array_distinct(p)) < F.size(p), _let(placed(p), _covered)).otherwise(0)
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) >= WINDOW, _let(hashes, lambda h: _let(_windows(h), found))).otherwise(0)


def measures(text: Column) -> Column:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stop_words, n_loud_words (longs) of a text."""
    stops = [*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS]]
    struct = lambda told: F.struct(*[c.cast("bigint").alias(k) for k, c in told.items()])
    of_words = lambda w: struct({
        "n_words": F.size(w),
        "n_repeat_words": _repeats(w),
        "n_stop_words": F.size(F.filter(w, lambda x: F.rtrim(x, F.lit(".,;:")).isin(stops))),
        "n_loud_words": F.size(F.filter(w, lambda x: x.endswith("!!"))),
    })
    of_lines = lambda x: struct({"n_lines": F.size(x), "n_dup_lines": F.size(x) - F.size(F.array_distinct(x))})
    of_text = struct({
        "word_chars": F.length(F.regexp_replace(text, f"{BLANK}+", "")),
        "n_symbols": F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", "")),
    })
    words = _let(F.array_remove(F.split(text, f"{BLANK}+"), ""), of_words)
    lines = _let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), of_lines)
    return F.struct(words.alias("words"), lines.alias("lines"), of_text.alias("chars"))


def broken(rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether any rule is broken, over what measures() gives."""
    tests = [F.lit(False)]
    for r in rules:
        measure = F.expr(r.measure)
        tests += [measure < F.lit(float(r.least))] if r.least is not None else []
        tests += [measure > F.lit(float(r.most))] if r.most is not None else []
    out = tests[0]
    for t in tests[1:]:
        out = out | F.coalesce(t, F.lit(False))
    return out


def judge(docs: DataFrame, column: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (longs), base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words lie in 8-word windows found twice or more in the text.
    kept: not base_failed, and no rule broken. Null and empty texts have no words and fail. Each row, a repeated one
    too, is judged alone, so hot sources and ids don't matter; an empty table gives an empty table. Columns of docs
    that are named as a result column are replaced.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    own = [c for c in docs.columns if c.lower() not in (*names, "base_failed", "kept")]
    row = F.struct(*[F.col(f"`{c}`") for c in own]) if own else F.struct(F.lit(0).alias("none"))
    nested = docs.select(row.alias("row"), measures(F.coalesce(F.col(column).cast("string"), F.lit(""))).alias("m"))
    with_sums = nested.select("row", "m.words.*", "m.lines.*", "m.chars.*")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = with_sums.select("row", *names, base.alias("base_failed"), (~base & ~broken(rules)).alias("kept"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], *names, "base_failed", "kept")


#: The same for DuckDB, except the stop words, which follow.
ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(x) AS n FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS x FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
  len(list_filter(ws, lambda x: list_contains([STOPS], rtrim(x, '.,;:')))) AS n_stop_words,
  len(list_filter(ws, lambda x: ends_with(x, '!!'))) AS n_loud_words
  FROM d JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND word_chars / n_words BETWEEN 1.5e0 AND 16e0 AND n_symbols / n_words <= 0.1e0 AND n_stop_words / n_words >= 0.04e0
  AND n_loud_words / n_words <= 0.4e0 AND n_dup_lines / n_lines <= 0.5e0 AS kept FROM b
""".replace("STOPS", ", ".join(f"'{x}'" for x in [*STOP_WORDS, *[x.capitalize() for x in STOP_WORDS]]))
