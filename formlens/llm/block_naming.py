"""Exact dedup by deterministic block naming, with DataFrame functions alone.

Each text is cut into blocks of a fixed size. Different blocks are sorted into integer names; then adjacent pairs of names
are, again and again, until each text has one name. Equal names mean equal texts, as names are ranks, not fingerprints.
Blocks are sorted by a 64-bit hash first and by their bytes where hashes tie, so bytes travel only where a hash is met twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import fresh, small, stage

#: Bytes of a block; blocks or pairs that one task sorts, about.
BLOCK, TOGETHER = 1024, 50_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """text with A-Z, and nothing else, in lower case."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def ranked(rows: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows, of which there are `most`, with the long `name`, from 1: equal for equal keys, different for different ones.

    Different keys are dealt into buckets by hash and sorted there; a name is the bucket and the rank in it. So it hangs on
    the keys alone, and a lost task gives the same ones again. Keys are made single before they meet, however often they come.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(max(1, -(-most // TOGETHER))).cast("long"))
    single = rows.select(*keys).distinct().withColumn("bucket", bucket)
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys))
    names = single.select(*keys, F.shiftleft("bucket", 32).bitwiseOR(rank.cast("long")).alias("name"))
    return rows.join(names, keys)


def blocks_of(docs: DataFrame, column: str, carried: list[str], block: int, bits: int) -> DataFrame:
    """rid, n, idx, content, h for each block of each row; a row's first one holds its carried columns and sha256 too."""
    row = F.struct(*[F.col(f"`{c}`") for c in carried]) if carried else F.struct(F.lit(0).alias("none"))
    text = lowered(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), text.cast("binary").alias("bytes"))
    rows = rows.select("*", F.greatest(F.lit(1), F.ceil(F.octet_length("bytes") / block)).cast("int").alias("n"), F.unhex(F.sha2("bytes", 256)).alias("sha"))
    cut = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx"))
    first = lambda c: F.when(F.col("idx") == 0, F.col(c)).alias(c)
    cut = cut.select("rid", "n", "idx", first("row"), first("sha"), F.substring("bytes", F.col("idx") * block + 1, F.lit(block)).alias("content"))
    return cut.withColumn("h", F.xxhash64("content").bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)))


def tied(blocks: DataFrame) -> DataFrame:
    """The hashes that blocks of different content share, if there are any. Only blocks whose hash is met twice send their content."""
    twice = stage(blocks.groupBy("h").count().filter("count > 1").select("h"), "twice")
    contents = blocks.select("h", "content").join(small(twice, 16), "h", "left_semi").distinct()
    return stage(contents.groupBy("h").count().filter("count > 1").select("h"), "tied")


def identities(blocks: DataFrame) -> DataFrame:
    """rid, level, name: equal level and name for equal texts, different ones for different texts. blocks must be staged."""
    ties = tied(blocks)
    rows = blocks.select("rid", "n", "idx", "h", F.lit(b"").alias("tie"))
    if ties.count():
        ties = ties.withColumn("tie_", F.lit(True))
        rows = blocks.select("rid", "n", "idx", "h", "content").join(small(ties, 16), "h", "left")
        rows = rows.select("rid", "n", "idx", "h", F.when(F.col("tie_"), F.col("content")).otherwise(F.lit(b"")).alias("tie"))
    # A text of n blocks has ceil(n / 2^k) names at level k.
    levels = [F.sum(F.ceil(F.col("n") / float(2**k))) for k in range(32)]
    longest, *counts = blocks.filter("idx = 0").agg(F.max("n"), *levels).first()
    named = stage(ranked(rows, ["h", "tie"], counts[0] or 0).select("rid", "n", "idx", "name"), "names0")
    done, level = [named.filter("n = 1").select("rid", F.lit(0).alias("level"), "name")], 0
    while (longest or 0) > 1 << level:
        level += 1
        side = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = named.filter("n > 1").groupBy("rid", F.expr("(n + 1) div 2").cast("int").alias("n"), F.expr("idx div 2").cast("int").alias("idx"))
        pairs = pairs.agg(side(0).alias("a"), F.coalesce(side(1), F.lit(0).cast("long")).alias("b"))  # the last of an odd number stands beside 0
        named = stage(ranked(pairs, ["a", "b"], counts[level]).select("rid", "n", "idx", "name"), f"names{level}")
        done.append(named.filter("n = 1").select("rid", F.lit(level).alias("level"), "name"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dedup(docs: DataFrame, column: str = "text", key: str = "doc_id", carried: list[str] | None = None, block: int = BLOCK, bits: int = 64) -> DataFrame:
    """docs with keep_id, group_size (long), kept and text_sha256 (hex, of the lower-cased text): a row for each row.

    Texts are equal if they are once A-Z are lower-cased; null is empty. Of equal texts the row with the largest key stays; of
    several rows with it one, and a null key is below all. Empty texts are one group. An empty table gives an empty table.
    carried: the columns of docs to give back (all); those named as a result column are replaced. bits: of the blocks' hash;
    with fewer, more blocks are told apart by their bytes. A group of copies meets as counts and one name per task only, so
    it may hold any share of the rows; a long text is cut before anything moves.
    """
    names = ("keep_id", "group_size", "kept", "text_sha256")
    own = [c for c in (docs.columns if carried is None else carried) if c.lower() not in names]
    held = fresh(docs, "_key")
    blocks = stage(blocks_of(docs.withColumn(held, F.col(f"`{key}`")), column, [*own, held], block, bits), "blocks")
    rows = blocks.filter("idx = 0").select("rid", "row", "sha").join(identities(blocks), "rid")
    rows = stage(rows, "identities")
    best = F.max(F.struct(F.col(f"row.{held}").alias("key"), (-F.col("rid")).alias("turn"))).alias("best")
    groups = rows.groupBy("level", "name").agg(F.count("*").alias("size"), best).filter("size > 1")
    out = rows.join(small(stage(groups, "groups"), 64), ["level", "name"], "left")
    kept = F.coalesce(F.col("best.turn") == -F.col("rid"), F.lit(True))
    keep_id = F.when(F.col("size").isNull(), F.col(f"row.{held}")).otherwise(F.col("best.key"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in own], keep_id.alias("keep_id"), F.coalesce("size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


#: Of the query, for DuckDB.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256 FROM d
"""
