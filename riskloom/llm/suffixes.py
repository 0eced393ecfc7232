"""Repeated passages by a sparse suffix array.

Only suffixes at content-selected positions are retained: the minimisers of
windows of ``WINDOW`` runs of ``GRAM`` words, so that texts which share a
passage retain the same positions inside it. Retained suffixes are brought
together by their leading words (a hash of ``LEAD`` of them stands in for the
sorted order) and those without a partner in another document are dropped. The
others are compared on contexts of ``CORE`` words around them.

Every run of ``PASSAGE`` words belongs to the minimiser of its first window and
to the context that starts ``0, STEP, 2 STEP ...`` words to the left of that
minimiser and leaves fewer than ``STEP`` words of the run before it; equal runs
belong to equal contexts in all documents. Each context is extended word by
word, left and right, by up to ``REACH`` words; occurrences that agree in all of
it are one kind and repeat the kind's first. Kinds of a context are compared
with its head, the one of smallest (doc_id, position): runs that agree with the
head repeat it, and those that do not are compared among themselves, each with
a head of its own. So the words reported are exactly those of all runs of ``PASSAGE`` words
that a document of smaller id holds too, and nothing shorter. Heads come from
an aggregate that combines before the shuffle; no pairs within a group arise.
Documents with equal texts enter once; the others of such a group repeat the
first as a whole.

Words are runs of characters other than ASCII white space. Defined results:
null, empty and short texts hold no passage; rows without an id take no part
(and are left as they are); of rows with equal ids the smallest text counts;
repeats within one document only are no repeats.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import Memo, alone, claim, fresh, kept, map_rows, one_row_per_id, quoted, ship, small

PASSAGE = 50
STEP = 8
GRAM = 8
WINDOW = 25
CORE = PASSAGE - STEP + 1
#: Words beside a context that a passage around it may hold.
REACH = PASSAGE - CORE
#: Leading words that all contexts of a retained suffix hold.
LEAD = CORE - (WINDOW - 1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
WORD = re.compile(r"[^ \t-\r]+")

_word_hash = Memo(lambda word: xxhash.xxh64_intdigest(word), 100_000)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _powers(n: int, made=[np.ones(1, np.uint64), np.ones(1, np.uint64)]) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; kept for the next text."""
    if len(made[0]) < n:
        for k, base in enumerate((BASE, INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            made[k] = np.multiply.accumulate(steps)
    return made[0][:n], made[1][:n]


class Hashed:
    """A text as word hashes, with the hash of any run of words from running sums modulo 2^64."""

    def __init__(self, text: str | None):
        words = (text or "").encode().split()
        self.n = len(words)
        self.words = np.fromiter(map(_word_hash.__getitem__, words), np.uint64, self.n)
        powers, self.back = _powers(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(self.words * powers, out=self.sums[1:])

    def runs(self, starts: np.ndarray, size: int) -> np.ndarray:
        return _mixed((self.sums[starts + size] - self.sums[starts]) * self.back[starts])

    def minimisers(self) -> np.ndarray:
        """The position of each window's minimiser."""
        grams = self.n - GRAM + 1
        if grams < WINDOW:
            return np.zeros(0, np.int64)
        views = np.lib.stride_tricks.sliding_window_view(self.runs(np.arange(grams), GRAM), WINDOW)
        return np.concatenate([views[k:k + 65536].argmin(axis=1) + np.arange(k, min(k + 65536, len(views))) for k in range(0, len(views), 65536)])

    def retained(self) -> np.ndarray:
        """Positions of the minimisers that have ``LEAD`` words from there on."""
        found = np.unique(self.minimisers())
        return found[found + LEAD <= self.n]


def _suffixes(batches):
    claim(_word_hash)
    for batch in batches:
        docs, places, leads = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            hashed = Hashed(text)
            at = hashed.retained()
            docs.append(np.full(len(at), doc, np.int64))
            places.append(at.astype(np.int32))
            leads.append(hashed.runs(at, LEAD).view(np.int64))
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (docs, places, leads)], ["doc", "at", "lead"])
    _word_hash.forget()  # cheap to make again; stages without Python follow while the worker idles


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    sizes = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(parts)))


def _contexts(batches):
    claim(_word_hash)
    for batch in (b.slice(k, 200) for b in batches for k in range(0, b.num_rows, 200)):
        contexts, docs, places, masks, before, after = [], [], [], [], [], []
        for doc, text, positions in zip(*(batch.column(k).to_pylist() for k in range(3))):
            hashed = Hashed(text)
            words = hashed.words.astype(np.uint32).view(np.int32)
            owner = hashed.minimisers()[:max(0, hashed.n - PASSAGE + 1)]
            runs = np.nonzero(np.isin(owner, np.array(positions, np.int64)))[0]
            left = (owner[runs] - runs) % STEP
            mask = np.zeros(hashed.n + 1, np.int32)
            np.add.at(mask, runs + left, np.int32(1) << left.astype(np.int32))
            starts = np.nonzero(mask)[0]
            contexts.append(hashed.runs(starts, CORE).view(np.int64))
            docs.append(np.full(len(starts), doc, np.int64))
            places.append(starts.astype(np.int32))
            masks.append(mask[starts])
            before.extend(words[max(0, s - REACH):s][::-1] for s in starts.tolist())
            after.extend(words[s + CORE:s + CORE + REACH] for s in starts.tolist())
        if before:
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate(c)) for c in (contexts, docs, places, masks)), _lists(before), _lists(after)],
                ["context", "doc", "at", "runs", "before", "after"])


def _agree(a: Column, b: Column) -> Column:
    """Leading elements in which two arrays agree."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def _merged(spans: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching spans [start, end) of the same keys become one, under the smallest first_doc_id."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("_new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1)))
    numbered = opened.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"),
                                               F.min("first_doc_id").alias("first_doc_id")).drop("_run")


def _heads(rows: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The smallest (doc, at) of each key that several documents have (the largest is ``last``), keys named with a leading line.

    Written, so that a join with it has exchanges of its own and Spark can split a common key.
    """
    heads = rows.groupBy(*keys).agg(F.min(F.struct("doc", "at", *more)).alias("head"), F.max("last").alias("last"))
    return kept(heads.filter(F.col("head.doc") < F.col("last")).select(*[F.col(k).alias(f"_{k}") for k in keys], "head"))


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end (words, end excluded), first_doc_id and kept.

    ``kept`` is true for the first occurrence of a passage (smallest doc_id,
    which is then first_doc_id) and false for those that repeat it.
    """
    texts = one_row_per_id(docs)
    classed = kept(texts.select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("same"), F.length("text").alias("chars")).filter(
        F.col("chars") >= 2 * PASSAGE - 1))
    groups = classed.groupBy("same", "chars").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies")).filter("copies > 1")
    n_words = F.size(F.filter(F.split("text", r"[ \t-\r]+"), lambda w: w != ""))
    groups = kept(texts.join(small(kept(groups)), F.col("doc_id") == F.col("first_doc_id")).select(
        "same", "chars", "first_doc_id", n_words.alias("n")).filter(F.col("n") >= PASSAGE))
    copies = kept(classed.join(small(groups), ["same", "chars"]).filter(F.col("doc_id") != F.col("first_doc_id")).select(
        "doc_id", F.lit(0).alias("start"), F.col("n").alias("end"), "first_doc_id"))
    firsts = groups.select(F.col("first_doc_id").alias("doc_id"), F.lit(0).alias("start"), F.col("n").alias("end"), "first_doc_id")
    alone = texts.join(small(copies.select(F.col("doc_id").alias("_copy"))), F.col("doc_id") == F.col("_copy"), "left_anti")

    suffixes = kept(map_rows(alone, _suffixes, "doc long, at int, lead long", lean=True))
    shared = kept(suffixes.groupBy("lead").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a <> b").select(
        F.col("lead").alias("_lead")))
    partnered = kept(suffixes.join(shared, F.col("lead") == F.col("_lead"), "left_semi").groupBy("doc").agg(
        F.collect_list("at").alias("at")))
    contexts = kept(map_rows(alone.join(small(partnered), F.col("doc_id") == F.col("doc")).select("doc", "text", "at"), _contexts,
                             "context long, doc long, at int, runs int, before array<int>, after array<int>", lean=True).withColumn(
        "kind", F.xxhash64(F.size("before"), "before", "after")))
    # ``runs`` has a bit for each run of the context: how many of its words lie before the context.
    kinds = kept(contexts.groupBy("context", "kind").agg(
        F.min(F.struct("doc", "at")).alias("own"), F.max("doc").alias("last"),
        *[F.first(c).alias(c) for c in ("runs", "before", "after")]).select(
        "context", "kind", "own.doc", "own.at", "last", "runs", "before", "after"))
    same = F.col("context") == F.col("_context")
    lefts = F.filter(F.array(*[F.lit(k) for k in range(STEP)]), lambda k: F.bit_get("runs", k) == 1)
    met = kinds.join(_heads(kinds, ["context"], "before", "after"), same).select(
        "context", "kind", "doc", "at", "last", "before", "after", lefts.alias("lefts"),
        F.col("head.doc").alias("first"), F.col("head.at").alias("first_at"),
        _agree(F.col("before"), F.col("head.before")).alias("left"), _agree(F.col("after"), F.col("head.after")).alias("right"))
    agrees = lambda k: (k <= F.col("left")) & (REACH - k <= F.col("right"))
    met = kept(met.withColumns({"as_head": F.filter("lefts", agrees), "other": F.filter("lefts", lambda k: ~agrees(k))}))

    beside = F.xxhash64(F.slice("before", 1, F.col("left")), F.slice("after", 1, REACH - F.col("left")))
    odd = met.select("context", "kind", "doc", "at", "last", "before", "after", F.explode("other").alias("left"))
    odd = kept(odd.select("context", "left", beside.alias("beside"), "kind", "doc", "at", "last"))
    own = _heads(odd, ["context", "left", "beside"])
    same = same & (F.col("left") == F.col("_left")) & (F.col("beside") == F.col("_beside"))
    more = kept(odd.join(own, same).filter(F.col("doc") > F.col("head.doc")).groupBy("context", "kind").agg(
        F.collect_set("left").alias("_more"), F.min("head.doc").alias("_first")).withColumnsRenamed({"context": "_context", "kind": "_kind"}))

    # All runs of a kind repeat its first occurrence; those in ``early`` repeat an earlier kind's, in the first one too.
    none = F.array().cast("array<int>")
    after_head = (F.col("doc") > F.col("first")) & (F.size("as_head") > 0)
    early = F.concat(F.when(after_head, F.col("as_head")).otherwise(none), F.coalesce("_more", none))
    told = met.join(more, (F.col("context") == F.col("_context")) & (F.col("kind") == F.col("_kind")), "left").select(
        F.col("context").alias("_context"), F.col("kind").alias("_kind"), F.col("doc").alias("own"), "lefts", early.alias("early"),
        F.least("doc", F.when(after_head, F.col("first")), "_first").alias("first"), "last")
    told = kept(told.filter((F.col("last") > F.col("own")) | (F.size("early") > 0)).drop("last"))
    repeated = F.when(F.col("doc") > F.col("own"), F.col("lefts")).otherwise(F.col("early"))
    # Runs of a context overlap, so the outermost ones bound the words of all.
    wide = contexts.select("context", "kind", "doc", "at").join(
        told, (F.col("context") == F.col("_context")) & (F.col("kind") == F.col("_kind"))).withColumn("lefts", repeated).filter(
        F.size("lefts") > 0).select(F.col("doc").alias("doc_id"), (F.col("at") - F.array_max("lefts")).alias("start"),
                                    (F.col("at") + PASSAGE - F.array_min("lefts")).alias("end"), F.col("first").alias("first_doc_id"))
    origins = met.filter((F.col("last") > F.col("first")) & (F.size("as_head") > 0)).groupBy("context", "first", "first_at").agg(
        F.max(F.array_max("as_head")).alias("most"), F.min(F.array_min("as_head")).alias("least")).select(
        F.col("first").alias("doc_id"), (F.col("first_at") - F.col("most")).alias("start"),
        (F.col("first_at") + PASSAGE - F.col("least")).alias("end"), F.col("first").alias("first_doc_id"))
    odd_origins = own.select(F.col("head.doc").alias("doc_id"), (F.col("head.at") - F.col("_left")).alias("start"),
                             (F.col("head.at") + PASSAGE - F.col("_left")).alias("end"), F.col("head.doc").alias("first_doc_id"))

    repeats = wide.union(copies)
    origins = origins.union(odd_origins).union(firsts)
    return _merged(repeats.withColumn("kept", F.lit(False)).union(origins.withColumn("kept", F.lit(True))), "doc_id", "kept").select(
        "doc_id", F.col("start").cast("int"), F.col("end").cast("int"), "first_doc_id", "kept")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and the white space after them."""
    bounds = [m.start() for m in WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in sorted(spans):
        end = min(end, len(bounds) - 1)
        if end > start:
            out.append(text[at:bounds[start]])
            at = bounds[end]
    return "".join(out) + text[at:]


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents, all columns, without passages that repeat an earlier document's.

    Rows of which nothing is left go; ``n_chars``, if there, follows the text.
    """
    ship(docs.sparkSession)
    doc, own = fresh(docs, "_doc"), fresh(docs, "_spans")
    repeats = alone(lambda: repeated_passages(docs).filter(~F.col("kept")).groupBy(F.col("doc_id").alias(doc)).agg(
        F.collect_list(F.struct("start", "end")).alias(own)))

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without(t, [(s["start"], s["end"]) for s in own]) if t else t for t, own in zip(texts, spans)], dtype=object)

    same = F.col("doc_id") == F.col(doc)
    # Else the filter below would be moved before the cut with a second cut, in a second worker a task.
    changed = docs.join(small(repeats), same).withColumn("text", cut.asNondeterministic()("text", own))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    changed = changed.filter(F.trim("text") != "").select(*quoted(docs))
    return docs.join(small(repeats.select(doc)), same, "left_anti").unionByName(changed)
