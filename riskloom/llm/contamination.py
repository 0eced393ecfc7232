"""Benchmark decontamination by size-partitioned MinHash containment search.

Items and documents are compared on runs of ``SHINGLE`` words (an item with
fewer words is one shingle). An item with q distinct shingles of which at least
``THRESHOLD`` must occur misses at most q - ceil(THRESHOLD * q) of them, so a
bottom sketch of one more than that, its smallest hash values, always shares a
shingle with a document that contains it. Items are therefore partitioned by
size: each size has its own sketch length and the least number of shingles a
document must have, however long the document is. Sketch values are joined with
the documents' shingle hashes, and each candidate is verified by the exact
share of its shingles. Columns and SQL functions only.

Defined results: null, empty and letterless texts contain nothing and items of
that kind are found nowhere; items with equal words are one item under their
smallest id, counted in ``n_items``; rows without an id are not reported; of
rows with equal ids the best containment counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import kept, small

SHINGLE = 5
THRESHOLD = 0.8


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    flat = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.filter(F.split(flat, " "), lambda w: w != "")


def _runs(of: Column, size: int, make) -> Column:
    """``make`` of every run of ``size`` elements; an empty array where there are fewer."""
    starts = F.when(F.size(of) >= size, F.sequence(F.lit(0), F.size(of) - size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, make)


def shingle_texts(of: Column, size: int) -> Column:
    return F.array_distinct(_runs(of, size, lambda k: F.array_join(F.slice(of, k + 1, size), " ")))


def _hash_run(of: Column, size: int):
    """Hash of a run of word hashes."""
    return lambda k: F.xxhash64(*[F.get(of, k + j) for j in range(size)])


def sketches(benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Distinct items with their shingles, and the rows (item_id, size, need, h) of their bottom sketches."""
    read = benchmark.select(F.col("item_id").cast("long"), words(F.col("text")).alias("w")).filter(
        F.col("item_id").isNotNull() & (F.size("w") > 0))
    items = read.groupBy("w").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items")).withColumn(
        "size", F.least(F.size("w"), F.lit(shingle)))
    texts, hashes = None, None
    word_hashes = F.transform("w", lambda x: F.xxhash64(x))
    for size in range(1, shingle + 1):
        here = F.col("size") == size
        of_texts, of_hashes = shingle_texts(F.col("w"), size), F.array_distinct(_runs(word_hashes, size, _hash_run(word_hashes, size)))
        texts = F.when(here, of_texts) if texts is None else texts.when(here, of_texts)
        hashes = F.when(here, of_hashes) if hashes is None else hashes.when(here, of_hashes)
    items = items.withColumn("shingles", texts).withColumn("hashes", hashes)
    items = items.withColumn("q", F.size("shingles")).withColumn(
        "need", F.ceil(F.col("q") * F.lit(threshold) - 1e-9).cast("int"))
    items = kept(items.select("item_id", "n_items", "size", "q", "need", "shingles", "hashes"))
    sketch = items.select("item_id", "size", "need", F.explode(
        F.slice(F.array_sort("hashes"), F.lit(1), F.col("q") - F.col("need") + 1)).alias("h"))
    return items, kept(sketch)


def candidates(docs: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, item_id) with a shared sketch value and enough shingles."""
    sizes = [r["size"] for r in sketch.select("size").distinct().collect()]  # at most SHINGLE values
    read = docs.filter(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("w"))
    found = None
    for size in sorted(sizes):
        runs = read.select("doc_id", (F.size("w") - size + 1).alias("n"), F.explode(
            _runs(F.col("w"), size, _hash_run(F.col("w"), size))).alias("_h"))
        hits = runs.join(small(sketch.filter(F.col("size") == size)), (F.col("_h") == F.col("h")) & (F.col("n") >= F.col("need")))
        hits = hits.select("doc_id", "item_id")
        found = hits if found is None else found.union(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")
    return found.distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_items, n_shingles, n_found and containment of items that documents contain."""
    items, sketch = sketches(benchmark, shingle, threshold)
    pairs = kept(candidates(docs, sketch))
    # Texts meet narrow rows first, so that words are cut once a document and items' shingles are not repeated a pair.
    hit = kept(pairs.select(F.col("doc_id").alias("_doc")).distinct())
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(
        small(hit), F.col("doc_id") == F.col("_doc"), "left_semi").select("doc_id", words(F.col("text")).alias("w"))
    near = read.join(small(pairs), "doc_id").join(small(items.drop("hashes")), "item_id")
    found = None
    for size in range(1, shingle + 1):
        here = F.col("size") == size
        own = F.size(F.array_intersect(F.col("shingles"), shingle_texts(F.col("w"), size)))
        found = F.when(here, own) if found is None else found.when(here, own)
    checked = near.select("doc_id", "item_id", "n_items", F.col("q").alias("n_shingles"), "need", found.alias("n_found"))
    return checked.filter(F.col("n_found") >= F.col("need")).groupBy("doc_id", "item_id").agg(
        F.max("n_items").alias("n_items"), F.max("n_shingles").alias("n_shingles"), F.max("n_found").alias("n_found")).withColumn(
        "containment", F.col("n_found") / F.col("n_shingles"))
