"""URL filters by a tree of path templates, with DataFrame functions alone.

Rules judge the urls that they fit, and label them. The others are judged by a tree of path templates for each host.
What is counted is different urls (host and path), so copies have no weight. A tree's levels are a path's segments; all
behind the last level count as one. Digits are written 0. From the root down, a segment becomes a wildcard if its
template so far has more than `fan_out` different children and less than `least_share` of the template's urls have it,
so what follows a wildcard is generalised together.

For each template, and its beginnings, allowed and blocked urls are counted, and siblings are merged: those whose share
of blocked urls differs from their parent's to the same side (a z-test) are one branch, unless one differs from that
branch too. Then from the root down, for each depth first the branch of all hosts together and then the host's own, a
branch whose share doesn't differ from the purity so far (the z-test again) leaves it; another gets its own, smoothed
with `smoothing` urls of the purity so far. So a longer template has the last word, whatever its host's root counts. A
template with a purity of `purity` or more is blocked.

The urls are first counted by host and digit-free path, so a hot host is a few rows in all that follows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, measured, stage


class UrlRule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: The rules of the query.
RULES = (
    UrlRule("com", "/", "allow"),
    UrlRule("example.com", "/en/", "block"),
    UrlRule("www.example.com", "/en/", "allow"),
    UrlRule("net", "/es/", "block"),
    UrlRule("net", "/fr/", "block"),
)
#: The purity that other hosts' labels can give at most.
PRIOR = 0.5
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_RESULT = ("host", "path", "rule", "verdict")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, LETTERS, LETTERS.lower()), path


def rule_of(host: Column, path: Column, rules: tuple[UrlRule, ...]) -> Column:
    """The name of the longest rule that fits, the one with the longer host of two, else null."""
    names = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.name)) for r in sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name))]
    return F.coalesce(*names, F.lit(None).cast("string"))


def judge(pages: DataFrame, rules: tuple[UrlRule, ...] = RULES, column: str = "url", levels: int = 5, fan_out: int = 20, least_share: float = 0.05, smoothing: float = 10.0, z: float = 1.96, purity: float = 0.7) -> DataFrame:
    """pages with host, path, rule (of the longest rule that fits, else null) and verdict (allow or block).

    A null url, or one without ://, has an empty host and path. Repeated rows are judged alike and count once. With no
    labelled url all templates are allowed. An empty table gives an empty table. Columns of pages that are named as a
    result column are replaced, but for the url itself.
    """
    own = [c for c in pages.columns if c.lower() not in _RESULT]
    shape = fresh(pages, "_shape")
    host, path = host_and_path(F.col(f"`{column}`").cast("string"))
    rows = pages.select(*[F.col(f"`{c}`") for c in own], host.alias("host"), path.alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    parts = F.split(F.regexp_replace("path", "[0-9]+", "0"), "/")
    parts = F.slice(parts, 2, F.greatest(F.lit(0), F.size(parts) - 1))
    parts = F.when(F.size(parts) <= levels, parts).otherwise(F.concat(F.slice(parts, 1, levels - 1), F.array(F.array_join(F.slice(parts, levels, 2_000_000_000), "/"))))
    rows = rows.withColumn(shape, parts)
    blocked = [r.name for r in rules if r.verdict == "block"]
    verdict_of = F.when(F.col("rule").isNull(), None).otherwise(F.col("rule").isin(blocked))
    shapes = rows.select("host", "path", "rule", F.col(shape).alias("shape")).distinct().groupBy("host", "shape").agg(
        F.count("*").alias("n"), F.count_if(~verdict_of).alias("allowed"), F.count_if(verdict_of).alias("blocked"))
    told = verdicts(stage(shapes, "shapes"), levels, fan_out, least_share, smoothing, z, purity)
    told = stage(told.select(F.col("host").alias("host_"), F.col("shape").alias("shape_"), F.when(F.col("blocks"), "block").otherwise("allow").alias("told")), "told")
    out = rows.join(measured(told), (F.col("host") == F.col("host_")) & (F.col(shape) == F.col("shape_")))
    verdict = F.when(F.col("rule").isNull(), F.col("told")).when(F.col("rule").isin(blocked), "block").otherwise("allow")
    return out.select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", verdict.alias("verdict"))


def templates(shapes: DataFrame, levels: int, fan_out: int, least_share: float) -> DataFrame:
    """Staged shapes (host, shape, n, ...) with `template`: the shape with its variable segments as wildcards.

    A level is staged once. How its joins are made is left to Spark, which knows the sizes of what was staged or
    shuffled: it broadcasts small sides and splits hot keys.
    """
    rows = shapes.withColumn("template", F.array().cast("array<string>"))
    for i in range(1, levels + 1):
        rows = rows.withColumn("parent", F.array_join("template", "/")).withColumn("name", F.get("shape", F.lit(i - 1)))
        children = rows.filter("name is not null").groupBy("host", "parent", "name").agg(F.sum("n").alias("n"))
        wide = children.groupBy("host", "parent").agg(F.count("*").alias("children"), F.sum("n").alias("all")).filter(F.col("children") > fan_out)
        stars = children.join(wide, ["host", "parent"]).filter(F.col("n") < least_share * F.col("all")).select("host", "parent", "name", F.lit("*").alias("star"))
        rows = rows.join(stars, ["host", "parent", "name"], "left")
        rows = rows.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.array_append("template", F.coalesce("star", "name"))))
        rows = stage(rows.drop("parent", "name", "star"), "generalised")
    return rows


def _apart(blocked: Column, n: Column, share: Column, z: float) -> Column:
    return F.abs(F.try_divide(blocked, n) - share) >= z * F.sqrt(F.try_divide(F.greatest(share * (1 - share), F.lit(1e-4)), n))


def merged(tree: DataFrame, by: list[str], z: float) -> DataFrame:
    """The staged tree (by, depth, node, parent, allowed, blocked) with each merged branch's counts in place of a node's own."""
    up = tree.select(*by, (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("allowed").alias("up_allowed"), F.col("blocked").alias("up_blocked"))
    n, above = F.col("allowed") + F.col("blocked"), F.col("up_allowed") + F.col("up_blocked")
    share = F.try_divide("up_blocked", above)
    side = F.when((n > 0) & (above > 0) & _apart(F.col("blocked"), n, share, z), F.signum(F.try_divide("blocked", n) - share)).otherwise(0.0)
    rows = tree.join(up, [*by, "depth", "parent"], "left").withColumn("side", side.cast("int")).drop("up_allowed", "up_blocked")
    branch = rows.filter("side != 0").groupBy(*by, "depth", "parent", "side").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b"))
    rows = rows.join(branch, [*by, "depth", "parent", "side"], "left")
    alike = F.coalesce(~_apart(F.col("blocked"), n, F.try_divide("b", F.col("a") + F.col("b")), z), F.lit(False))
    counts = [F.when(alike, F.col(x)).otherwise(F.col(own)).alias(own) for x, own in (("a", "allowed"), ("b", "blocked"))]
    return rows.select(*[c for c in tree.columns if c not in ("parent", "allowed", "blocked")], *counts)


def verdicts(shapes: DataFrame, levels: int, fan_out: int, least_share: float, smoothing: float, z: float, purity: float) -> DataFrame:
    """host, shape, blocks for staged rows host, shape (array), n, allowed, blocked."""
    flat = templates(shapes, levels, fan_out, least_share)
    kinds = flat.groupBy("host", "template").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"), F.sum("n").alias("n"))
    nodes = kinds.select("*", F.explode(F.sequence(F.lit(0), F.size("template"))).alias("depth"))
    cut = lambda d: F.array_join(F.slice("template", 1, d), "/")
    nodes = stage(nodes.withColumn("node", cut(F.col("depth"))).withColumn("parent", F.when(F.col("depth") > 0, cut(F.col("depth") - 1))), "nodes")
    counts = [F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")]
    own = stage(nodes.groupBy("host", "depth", "node", "parent").agg(*counts, (F.sum("n") - F.sum("allowed") - F.sum("blocked")).alias("open")), "own_counts")
    of_all = stage(own.groupBy("depth", "node", "parent").agg(*counts), "all_counts")
    own, of_all = merged(own, ["host"], z), merged(of_all, [], z)
    keys = nodes.select("host", "template", "depth", "node")
    both = keys.join(of_all, ["depth", "node"]).withColumn("own", F.lit(0)).withColumn("open", F.lit(0).cast("long"))
    both = both.unionByName(keys.join(own, ["host", "depth", "node"]).withColumn("own", F.lit(1)))
    chain = F.sort_array(F.collect_list(F.struct("own", "depth", "allowed", "blocked", "open")))
    told = both.groupBy("host", "template").agg(chain.alias("chain"))

    def down(p: Column, x: Column) -> Column:
        n = (x["allowed"] + x["blocked"]).cast("double")
        held = x["open"] + F.lit(float(smoothing))
        return F.when((n > 0) & _apart(x["blocked"], n, p, z), (x["blocked"] + held * p) / (n + held)).otherwise(p)

    prior = F.least(F.lit(PRIOR), F.aggregate(F.filter("chain", lambda x: x["own"] == 0), F.lit(0.5), down))
    purity_of = F.aggregate(F.filter("chain", lambda x: x["own"] == 1), prior, down)
    told = told.select("host", "template", (purity_of >= purity).alias("blocks"))
    return flat.join(told, ["host", "template"]).select("host", "shape", "blocks")


def _oracle(levels: int = 5) -> str:
    """Of the query, for DuckDB."""
    steps = "".join(f"""
c{i} AS (SELECT host, array_to_string(t, '/') AS parent, shape[{i}] AS name, sum(n) AS n FROM g{i - 1} WHERE len(shape) >= {i} GROUP BY ALL),
w{i} AS (SELECT host, parent, name FROM (SELECT *, count(*) OVER w AS k, sum(n) OVER w AS s FROM c{i} WINDOW w AS (PARTITION BY host, parent)) WHERE k > 20 AND n < 0.05e0 * s),
g{i} AS (SELECT g.host, g.shape, g.n, g.a, g.b, CASE WHEN len(g.shape) < {i} THEN g.t ELSE list_append(g.t, CASE WHEN w.name IS NULL THEN g.shape[{i}] ELSE '*' END) END AS t
  FROM g{i - 1} g LEFT JOIN w{i} w ON g.host = w.host AND array_to_string(g.t, '/') = w.parent AND g.shape[{i}] = w.name),""" for i in range(1, levels + 1))
    apart = lambda b, n, p: f"abs({b} / {n} - {p}) >= 1.96e0 * sqrt(greatest({p} * (1 - {p}), 1e-4) / {n})"

    def down(chain: str, first: str) -> str:
        share = "(y.b + (10e0 + y.u) * x.p) / (y.a + y.b + 10e0 + y.u)"
        step = f"CASE WHEN y.a + y.b > 0 AND {apart('y.b', '(y.a + y.b)', 'x.p')} THEN {share} ELSE x.p END"
        return f"list_reduce({chain}, lambda x, y: {{'a': y.a, 'b': y.b, 'u': y.u, 'p': {step}}}, {{'a': 0e0, 'b': 0e0, 'u': 0e0, 'p': {first}}}).p"

    def branches(name: str, tree: str, host: str) -> str:
        on = lambda x, y: f"{x}.host = {y}.host AND " if host else ""
        own = f"{host}, " if host else ""
        q = "(u.b / nullif(u.a + u.b, 0))"
        return f"""
{name}s AS (SELECT c.*, CASE WHEN c.a + c.b > 0 AND u.a + u.b > 0 AND {apart("c.b", "(c.a + c.b)", q)} THEN sign(c.b / (c.a + c.b) - {q}) ELSE 0 END AS side
  FROM {tree} c LEFT JOIN {tree} u ON {on("c", "u")}u.d = c.d - 1 AND u.node = c.parent),
{name}b AS (SELECT {own}d, parent, side, sum(a) AS x, sum(b) AS y FROM {name}s WHERE side != 0 GROUP BY ALL),
{name} AS (SELECT c.* EXCLUDE (a, b), CASE WHEN alike THEN x ELSE a END AS a, CASE WHEN alike THEN y ELSE b END AS b FROM (
  SELECT c.*, x, y, coalesce(NOT ({apart("c.b", "(c.a + c.b)", "(y / (x + y))")}), false) AS alike
  FROM {name}s c LEFT JOIN {name}b p ON {on("c", "p")}p.d = c.d AND p.parent = c.parent AND p.side = c.side) c),"""

    return rf"""
WITH u AS (SELECT page_id, coalesce(CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
p AS (SELECT *, string_split(regexp_replace(path, '[0-9]+', '0', 'g'), '/')[2:] AS s, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM h),
r AS (SELECT page_id, host, path, rule, CASE WHEN len(s) <= {levels} THEN s ELSE list_append(s[:{levels - 1}], array_to_string(s[{levels}:], '/')) END AS shape,
  rule IN ('example.com/en/', 'net/es/', 'net/fr/') AS bad FROM p),
g0 AS (SELECT host, shape, count(*) AS n, count(*) FILTER (WHERE NOT bad) AS a, count(*) FILTER (WHERE bad) AS b, []::VARCHAR[] AS t
  FROM (SELECT DISTINCT host, path, shape, bad FROM r) GROUP BY host, shape),{steps}
k AS (SELECT host, t, sum(a)::DOUBLE AS a, sum(b)::DOUBLE AS b, sum(n)::DOUBLE AS n FROM g{levels} GROUP BY ALL),
nd AS (SELECT *, array_to_string(t[:d], '/') AS node, CASE WHEN d > 0 THEN array_to_string(t[:d - 1], '/') END AS parent FROM (SELECT *, unnest(range(0, len(t) + 1)) AS d FROM k)),
ow AS (SELECT host, d, node, parent, sum(a) AS a, sum(b) AS b, sum(n) - sum(a) - sum(b) AS open FROM nd GROUP BY ALL),
al AS (SELECT d, node, parent, sum(a) AS a, sum(b) AS b FROM ow GROUP BY ALL),{branches("o1", "ow", "host")}{branches("a1", "al", "")}
bo AS (SELECT nd.host, nd.t, 0 AS o, nd.d, x.a, x.b, 0e0 AS open FROM nd JOIN a1 x ON x.d = nd.d AND x.node = nd.node
  UNION ALL SELECT nd.host, nd.t, 1, nd.d, x.a, x.b, x.open FROM nd JOIN o1 x ON x.host = nd.host AND x.d = nd.d AND x.node = nd.node),
cn AS (SELECT host, t, list({{'a': a, 'b': b, 'u': open, 'p': 0.5e0}} ORDER BY d) FILTER (o = 0) AS others, list({{'a': a, 'b': b, 'u': open, 'p': 0.5e0}} ORDER BY d) FILTER (o = 1) AS own FROM bo GROUP BY host, t),
pr AS (SELECT host, t, own, least({PRIOR}e0, {down("others", "0.5e0")}) AS p FROM cn),
pu AS (SELECT host, t, {down("own", "pr.p")} AS p FROM pr)
SELECT r.page_id, r.host, r.path, r.rule, CASE WHEN r.rule IS NOT NULL THEN CASE WHEN r.bad THEN 'block' ELSE 'allow' END
  WHEN pu.p >= 0.7e0 THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN g{levels} g ON r.host = g.host AND r.shape = g.shape JOIN pu ON g.host = pu.host AND g.t = pu.t
"""


ORACLE_SQL = _oracle()
