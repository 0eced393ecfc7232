"""Phrase collocations by counting longest windows once and summing out their last words.

Every word leads one window of up to ``WORDS`` words that ends with its piece.
Windows are counted, and a Spark ROLLUP over their columns sums the counts of
all shorter prefixes: each occurrence of a phrase is the prefix of exactly one
window, so the sums are the counts of all phrases.

A window is padded, too, from a pair or triple of neighbouring words on that
occurs less than ``least`` times, since no phrase around it can be a candidate;
its phrases still count in the windows led by their own words. Pairs, then
triples of frequent pairs, are counted by a hash and the frequent ones marked
in ``MARKS`` bits, whatever the corpus, so a collision can only leave a window
longer than need be.

Defined results: a null text has no words, a null language is ``und``. Rows
count as often as they repeat. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import MEMO_ENTRIES, kept, map_rows, small

WORDS = 5
LEAST = 100
TOP = 2000
#: Bits that mark frequent pairs or triples (8 MiB): a multiple of the 32,768 of one of Spark's bitmaps.
MARKS = 1 << 26
#: Words that a text is cut into at a time.
CHUNK = 400_000
# What ends a piece, and upper case.
ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
SPLIT = bytes.maketrans(ENDS, b"." * len(ENDS))
BREAK = b"."

#: floor(1000 a n / (l r)), exact to 38 digits.
SCORE = "(cast(1000 as decimal(4,0)) * cast(a as decimal(17,0)) * cast(n as decimal(17,0))) div (cast(l as decimal(17,0)) * cast(r as decimal(17,0)))"


class Lexicon:
    """Numbers words in the order met; starts anew between chunks once it is full (memory only)."""

    def __init__(self, entries: int = MEMO_ENTRIES):
        self.entries = entries
        self.forget()

    def forget(self) -> None:
        self.numbers, self.words, self.hashes = {BREAK: 0}, [""], np.zeros(1024, np.uint64)

    def read(self, said: list[bytes]) -> np.ndarray:
        """Numbers of the words; 0 ends a piece."""
        if len(self.words) > self.entries:
            self.forget()
        numbers = self.numbers
        for word in set(said) - numbers.keys():
            if len(self.words) == len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[len(self.words)] = xxhash.xxh64_intdigest(word, 42)
            numbers[word] = len(self.words)
            self.words.append(word.decode())
        return np.fromiter(map(numbers.__getitem__, said), np.int64, len(said))

    def runs(self, at: np.ndarray, size: int, tongue: int) -> np.ndarray:
        """32-bit hash of each run of ``size`` words."""
        with np.errstate(over="ignore"):
            h, n = self.hashes[at], max(0, len(at) - size + 1)
            mixed = np.full(n, tongue, np.uint64)
            for k in range(size):
                mixed = (mixed ^ h[k:k + n]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
        return (mixed >> np.uint64(32)).astype(np.int64)


def chunks(batch, overlap: int):
    """(language, words) of the texts in a batch; a cut text's next chunk starts with the last ``overlap`` words of this one.

    The third value is how many words at the end of the chunk the next one has again.
    """
    by: dict = {}
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        if text:
            by.setdefault(lang, []).append(text.encode().lower().translate(SPLIT))
    for lang, texts in by.items():
        said: list[bytes] = []
        for text in texts:
            said += text.replace(b".", b" . ").split()
            said.append(BREAK)
            while len(said) > CHUNK:
                yield lang, said[:CHUNK], overlap
                said = said[CHUNK - overlap:]
        if said:
            yield lang, said, 0


def _tongue(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang, 7)


def _frequent(lexicon: Lexicon, at: np.ndarray, lang: str, marks: list[np.ndarray]) -> np.ndarray:
    """Whether the run of words that starts here is without end of piece and marked at each size; ``marks`` for 2 words, 3 words and so on."""
    goes = at > 0
    for size, marked in enumerate(marks, 2):
        goes = goes[:-1] & goes[1:]
        mark = lexicon.runs(at, size, _tongue(lang)) % MARKS
        goes &= (marked[mark >> 3] >> (mark & 7).astype(np.uint8) & 1).astype(bool)
    return goes


def frequent(texts: DataFrame, least: int, marks: list) -> np.ndarray:
    """Marks of the runs, one word longer than the last of ``marks``, that occur ``least`` times or more; a few others share a mark."""
    size = len(marks) + 2

    def work(batches):
        lexicon, known = Lexicon(), [m.value for m in marks]
        for batch in batches:
            for lang, said, _ in chunks(batch, size - 1):
                at = lexicon.read(said)
                goes = _frequent(lexicon, at, lang, known)
                found = lexicon.runs(at, size, _tongue(lang))[goes[:-1] & goes[1:]]
                runs, counts = np.unique(found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(runs.astype(np.uint32).view(np.int32)), pa.array(counts.astype(np.int32))], ["run", "n"])

    counted = map_rows(texts, work, "run int, n int").groupBy("run").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    place = F.pmod(F.col("run").cast("long"), F.lit(MARKS)) + 1
    bits = counted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    marked = np.zeros(MARKS // 8, np.uint8)
    for row in bits.collect():  # MARKS bits at most
        first = (row["bucket"] - 1) * 4096
        marked[first:first + 4096] = np.frombuffer(row["bits"], np.uint8)
    return marked


def windows(texts: DataFrame, least: int) -> DataFrame:
    """lang, w1 to w5 ('' where padded) and n: the longest windows, combined within chunks only."""
    context = texts.sparkSession.sparkContext
    marks: list = []
    while len(marks) < 2:
        marks.append(context.broadcast(frequent(texts, least, marks)))

    def work(batches):
        lexicon, known = Lexicon(), [m.value for m in marks]
        for batch in batches:
            for lang, said, again in chunks(batch, WORDS - 1):
                at = lexicon.read(said)
                table = np.zeros((len(at), WORDS), np.int32)
                table[:, 0] = at
                pairs = _frequent(lexicon, at, lang, known[:1])
                table[:len(pairs), 1] = np.where(pairs, at[1:], 0)
                triples = goes = _frequent(lexicon, at, lang, known)
                for k in range(2, WORDS):
                    goes = triples if k == 2 else goes[:-1] & triples[k - 2:]
                    table[:len(goes), k] = np.where(goes, at[k:], 0)
                table = table[:len(table) - again]
                table = table[table[:, 0] > 0]
                if len(table):
                    yield from _folded(table, lexicon, lang)

    columns = ", ".join(f"w{k} string" for k in range(1, WORDS + 1))
    return map_rows(texts, work, f"lang string, {columns}, n long")


def _folded(table: np.ndarray, lexicon: Lexicon, lang: str):
    """Equal windows of a chunk as one row with their number."""
    rows = np.ascontiguousarray(table).view([("", table.dtype)] * table.shape[1]).ravel()
    order = np.lexsort(table.T[::-1])
    rows = rows[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.append(first, len(rows)))
    folded = table[order[first]]
    used, codes = np.unique(folded, return_inverse=True)
    said = pa.array([lexicon.words[k] for k in used], pa.string())
    codes = codes.reshape(folded.shape)
    for at in range(0, len(folded), 100_000):
        part = codes[at:at + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(part), pa.string()), *[said.take(pa.array(part[:, k])) for k in range(WORDS)],
             pa.array(counts[at:at + 100_000], pa.int64())], ["lang", *[f"w{k}" for k in range(1, WORDS + 1)], "n"])


def phrases(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """lang, size, phrase and n of every phrase of up to ``WORDS`` words with n >= ``least``; size 0 counts all words."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    names = [f"w{k}" for k in range(1, WORDS + 1)]
    longest = windows(texts, least).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    every = F.grouping_id().alias("summed")
    sums = longest.rollup("lang", *names).agg(F.sum("n").alias("n"), every)
    # The grouping id has a bit for each column that was summed out; all of them are set for all languages together.
    sums = sums.filter(F.col("lang").isNotNull()).withColumn("size", F.lit(WORDS) - F.bit_count("summed"))
    last = F.element_at(F.array(F.lit("all"), *names), F.greatest(F.col("size"), F.lit(0)) + 1)
    whole = sums.filter((last != "") & ((F.col("n") >= least) | (F.col("size") == 0)))
    return whole.select("lang", "size", F.concat_ws(" ", *[F.nullif(n, F.lit("")) for n in names]).alias("phrase"), "n")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The contract's lang, rank, phrase, a, l, r, n and score, the first ``top`` of each language."""
    counts = kept(phrases(docs, least))
    whole = counts.filter("size = 0").select(F.col("lang").alias("_lang"), F.col("n").alias("n"))
    found = counts.filter("size >= 2").select("lang", "size", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = found.select("lang", "size", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("head"),
                       F.expr("array_join(slice(words, k + 1, size - k), ' ')").alias("rest"))
    parts = small(kept(counts.filter("size >= 1").select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("n").alias("_n"))))

    def counted(rows: DataFrame, part: str, name: str) -> DataFrame:
        side = parts.select(F.col("_lang").alias(f"_lang_{name}"), F.col("_phrase").alias(f"_{name}"), F.col("_n").alias(name))
        return rows.join(side, (F.col("lang") == F.col(f"_lang_{name}")) & (F.col(part) == F.col(f"_{name}"))).drop(f"_lang_{name}", f"_{name}")

    cuts = counted(counted(cuts, "head", "l"), "rest", "r").join(small(kept(whole)), F.col("lang") == F.col("_lang")).drop("_lang")
    best = cuts.withColumn("score", F.expr(SCORE)).groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    inner = found.filter("size > 2").select("lang", "a", "size", "words", F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inner = inner.select("lang", "a", "words", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("at")).select(
        F.col("lang").alias("_lang"), F.expr("array_join(slice(words, at, m), ' ')").alias("_phrase"), "a")
    longer = inner.groupBy("_lang", "_phrase").agg(F.max("a").alias("_longer"))
    free = best.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left").filter(
        "_longer is null or 100 * _longer < 100 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = free.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
