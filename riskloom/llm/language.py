"""Language identification by cross-parsing entropy.

A suffix automaton per language holds words of its labelled texts. A text is
parsed greedily: each phrase is the longest match in the automaton from there
on (one letter where nothing matches); the language that needs fewest phrases
per letter wins. Phrases end with their word, so a word's parse is computed
once per worker and remembered, and words never seen in training still match
by their parts.

Learning reads the text and non-null lang of rows outside the held-out fold,
from a bounded sample (``TRAIN_ROWS`` different texts a language, picked by a hash
of the text, however many copies each has, and of those the ``TRAIN_WORDS`` most frequent words).

Defined results: ``und`` with score 0 for null texts and texts without a
letter, and for all texts where nothing could be learned; ties go to the
language first in the alphabet; a single learned language scores 1.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import WordTable, claim, held_out, kept, map_rows, ship, small

#: Bounds of the training sample, per language.
TRAIN_ROWS = 40
TRAIN_WORDS = 4000
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")


class SuffixAutomaton:
    """Accepts every part of the given words (Blumer et al. 1985, one automaton for all words)."""

    def __init__(self, words: tuple[str, ...]):
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        for word in words:
            last = 0
            for letter in word:
                last = self._extend(last, letter)
        del self.link, self.length

    def _state(self, moves: dict[str, int], link: int, length: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _extend(self, last: int, letter: str) -> int:
        known = self.next[last].get(letter)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, letter, known)
        new = self._state({}, 0, self.length[last] + 1)
        at = last
        while at >= 0 and letter not in self.next[at]:
            self.next[at][letter] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][letter]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, letter, to)
        return new

    def _split(self, at: int, letter: str, to: int) -> int:
        copy = self._state(dict(self.next[to]), self.link[to], self.length[at] + 1)
        self.link[to] = copy
        while at >= 0 and self.next[at].get(letter) == to:
            self.next[at][letter] = copy
            at = self.link[at]
        return copy

    def phrases(self, word: str) -> int:
        """Greedy longest matches that a word is made of."""
        moves, count, state = self.next, 0, 0
        for letter in word:
            longer = moves[state].get(letter) if state else None
            if longer is None:
                count += 1
                longer = moves[0].get(letter, 0)
            state = longer
        return count


class CrossParser:
    def __init__(self, languages: tuple[str, ...], words: tuple[tuple[str, ...], ...]):
        self.languages = languages
        self.automata = [SuffixAutomaton(w) for w in words]
        self.table = WordTable(self._measure, len(languages) + 2)

    def _measure(self, word: str) -> list[int]:
        parts = LETTERS.findall(word)
        return [sum(a.phrases(p) for p in parts) for a in self.automata] + [len(parts), sum(map(len, parts))]

    def forget(self) -> None:
        """Called when another operator's work begins in the worker: the automata go too."""
        self.table.forget()
        parser.cache_clear()

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score, and how often a word had to be broken: phrases beyond one a word, per letter beyond it."""
        totals = self.table.totals(text.lower().split()) if text and self.languages else [0]
        if not totals[-1]:
            return UNKNOWN, 0.0, 1.0
        *phrases, words, letters = totals.tolist()
        best = int(np.argmin(phrases))
        rest = min(phrases[:best] + phrases[best + 1:], default=None)
        broken = (phrases[best] - words) / max(letters - words, 1)
        return self.languages[best], 1 - phrases[best] / rest if rest else 1.0, broken


@lru_cache(maxsize=1)
def parser(languages: tuple, words: tuple) -> CrossParser:
    """One per worker process and model."""
    return CrossParser(languages, words)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, words: int = TRAIN_WORDS) -> tuple[tuple, tuple]:
    """Languages and their sampled words; at most ``words`` per language reach the driver."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select(
        "lang", "text")
    hashed = kept(known.select(F.col("lang").alias("_lang"), F.xxhash64("text").alias("_hash")).distinct())
    # Counts by range of the hash say up to which range a language's lowest hashes go, so that few are ranked.
    spans = hashed.groupBy("_lang", F.shiftright("_hash", 52).alias("_span")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("_lang").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    edges = spans.withColumn("_before", F.coalesce(upto, F.lit(0))).filter(F.col("_before") < rows).groupBy(
        F.col("_lang").alias("_of")).agg(F.max("_span").alias("_edge"))
    few = hashed.join(small(kept(edges)), F.col("_lang") == F.col("_of")).filter(F.shiftright("_hash", 52) <= F.col("_edge"))
    first = Window.partitionBy("_lang").orderBy("_hash")
    lowest = kept(few.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= rows).select("_lang", "_hash"))
    texts = known.join(small(lowest), (F.col("lang") == F.col("_lang")) & (F.xxhash64("text") == F.col("_hash")), "left_semi").distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = texts.withColumn("_rank", F.row_number().over(by_hash)).filter(F.col("_rank") <= rows)
    counted = (sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
               .filter(F.length("word") <= 40).groupBy("lang", "word").count())
    common = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = counted.withColumn("_rank", F.row_number().over(common)).filter(F.col("_rank") <= words)
    lists = top.groupBy("lang").agg(F.sort_array(F.collect_list("word")).alias("words")).orderBy("lang").collect()
    return tuple(r["lang"] for r in lists), tuple(tuple(r["words"]) for r in lists)


def identify(docs: DataFrame, model: tuple[tuple, tuple]) -> DataFrame:
    """doc_id, lang_pred and score, one row per input row; only the text is looked at."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by TRAIN_WORDS per language

    def work(batches):
        claim(parser(*shared.value))
        guess = parser(*shared.value).predict
        for batch in batches:
            out = [guess(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())],
                ["doc_id", "lang_pred", "score"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work,
                    "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: tuple[tuple, tuple], most_broken: float) -> DataFrame:
    """The rows, with all columns, whose text has a learned language.

    Text of none of them breaks into phrases of hardly more than a letter: it
    goes if more than ``most_broken`` of the places inside its words are breaks.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def judge(texts: pd.Series) -> pd.Series:
        claim(parser(*shared.value))
        guess = parser(*shared.value).predict
        return pd.Series([lang != UNKNOWN and broken <= most_broken for lang, _, broken in map(guess, texts)], dtype=bool)

    return docs.filter(judge("text"))
