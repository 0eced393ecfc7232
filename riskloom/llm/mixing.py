"""Mixing sources to target weights by thresholds on a hash, without sorting documents.

A source's target is met by taking all its documents as often as they fit
whole, and once more those whose hash lies below a threshold. Words are summed
by (source, hash bucket); a prefix over a source's ``BUCKETS`` sums finds the
bucket in which the budget ends, and only that bucket's documents are summed
again, by the next bits of their hashes, until the bucket is one hash. The
thresholds are nested: a larger budget takes every document of a smaller one.

Defined results: null texts have no words; a null source is a source of its
own, the last. Documents at the threshold share the words still missing in
proportion to their sizes, rounded down, so a source's words meet its target
but for rounding; that is one document, unless rows repeat id and text. Sources
without words have target 0. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import kept, numbered, small

#: Bits of a hash that one histogram resolves, and all bits of it.
BITS = 12
HASH_BITS = 60
#: Times a source is taken at most.
REPEATS = 3
WEIGHTS = (1, 2, 3)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and a hash of id and text."""
    mark = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                       F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"))


def targets(sizes: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """source, source_size and target: all words shared by ``weight``, no source above ``repeats`` times its size."""
    total = sizes.agg(F.sum("source_size")).first()[0] or 0
    sizes = sizes.withColumns({"cap": F.col("source_size") * repeats, "open": F.lit(True)})
    n = None
    while True:
        found = sizes.agg(F.sum(F.when(F.col("open"), 0).otherwise(F.col("cap"))).alias("spent"), F.sum(F.col("open").cast("long")).alias("n"),
                          F.sum(F.when(F.col("open"), F.col("weight")).otherwise(0)).alias("weights")).first()
        spent, weights = found["spent"] or 0, found["weights"] or 0
        if found["n"] == n:
            break
        n = found["n"]
        sizes = kept(sizes.withColumn("open", F.col("open") & (F.col("cap") * F.lit(weights) >= F.lit(total - spent) * F.col("weight"))))
    shared = (F.lit(total - spent) * F.col("weight")).cast("double") / F.lit(max(1, weights)).cast("double")
    return sizes.select("source", "source_size", F.when(F.col("open"), shared).otherwise(F.col("cap").cast("double")).alias("target"))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, edge, below and at: the hash in which the budget of words ends, and the words below it and at it.

    ``budgets`` has source and budget; sources whose budget is 0 have no edge.
    """
    found = budgets.filter("budget > 0").select(F.col("source").alias("of"), "budget", F.lit(0).cast("long").alias("below"))
    inside = rows
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        bucket = F.shiftright("h", shift)
        sums = inside.groupBy("source", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("least"), F.max("h").alias("most"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        summed = sums.withColumn("upto", upto).join(small(kept(found)), F.col("source").eqNullSafe(F.col("of")))
        ends = summed.filter((F.col("below") + F.col("upto") >= F.col("budget")) & (F.col("below") + F.col("upto") - F.col("words") < F.col("budget")))
        ends = kept(ends.select("of", "budget", (F.col("below") + F.col("upto") - F.col("words")).alias("below"), "words", "bucket", "least", "most"))
        if shift == 0 or ends.filter("least < most").isEmpty():
            break
        inside = kept(inside.join(small(ends.select("of", "bucket")), F.col("source").eqNullSafe(F.col("of")) & (bucket == F.col("bucket"))).select(
            "source", "size", "h"))
        found = ends.select("of", "budget", "below")
    return ends.select(F.col("of").alias("source"), F.col("least").alias("edge"), "below", F.col("words").alias("at"))


def mix(docs: DataFrame, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """doc_id, size, source_size, target, taken (words), copies (whole ones) and part (words of one more), a row each document.

    Sources by code point weigh ``weights``, repeating.
    """
    rows = kept(sized(docs))
    sizes = numbered(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [], [F.asc_nulls_last("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")
    shares = targets(kept(sizes.select("source", "source_size", weight.alias("weight"))), repeats)
    goal = F.floor(F.col("target") + 0.5).cast("long")
    shares = kept(shares.withColumn("copies", F.coalesce(F.expr("floor(target + 0.5) div nullif(source_size, 0)"), F.lit(0))).withColumn(
        "budget", goal - F.col("copies") * F.col("source_size")))
    ends = thresholds(rows, shares.select("source", "budget")).withColumnRenamed("source", "of")
    plan = kept(shares.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").drop("of").withColumnRenamed("source", "of"))
    shared = F.expr("cast((cast(budget - below as decimal(19,0)) * size) div at as long)")
    part = F.when(F.col("h") < F.col("edge"), F.col("size")).when((F.col("h") == F.col("edge")) & (F.col("at") > 0), shared).otherwise(0)
    return rows.join(small(plan), F.col("source").eqNullSafe(F.col("of"))).withColumn("part", part).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"), "copies", "part")
