"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps words to the symbols insult, threat, target, negation, reported
speech, clause end and other. Five small transducers read the symbols: two
remember a hit, one an addressed person, one a negation that still reaches
(``REACH`` words), one reported speech until the clause ends. Their product is
compiled into one table; at each clause end it writes the kind of clause
matched. Kinds are weighted, so a word counts by the clause it stands in.

Fixed parts of the lexicon are short lists of function words; insults and
threats beyond the seeds are learned from labelled rows outside the held-out
fold by sequential covering, and the weights by logistic regression, both on a
bounded sample (``TRAIN_ROWS`` of each class, picked by a hash of the id).

Defined results: null and empty texts score as a text without a hit; repeated
rows give repeated results; with no labelled row of one class all scores are
the share of the other's smoothed count.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WordTable, claim, held_out, logistic_fit, map_rows, sigmoid

#: Bounds of the training sample (rows of each class) and of the learned lexicon.
TRAIN_ROWS = 3000
TRAIN_WORDS = 2000
#: A learned word covers at least this many labelled texts, nearly all of them toxic.
LEAST_SUPPORT = 4
LEAST_PRECISION = 0.8
#: Words that a negation reaches.
REACH = 3

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
SEEDS = {
    INSULT: "idiot moron loser scum stupid pathetic imbecile cretin dumm dumbass idiota imbécil imbécile connard",
    THREAT: "kill murder strangle stab töten umbringen matar matarte tuer égorger",
    TARGET: "you your yours yourself du dich dir euch vous toi tú usted ustedes",
    NEGATION: "not never nobody nicht niemals kein keine jamais nunca jamás",
    REPORT: "said says claimed alleged quoted sagte behauptete zitierte dit affirmait dijo afirmó",
}
WORD = regex.compile(r"\p{L}+")
STOPS = ".!?;:"


def words_of(text: str) -> list[str]:
    return text.lower().replace("\n", " ; ").split()


def _step(state: tuple, symbol: int) -> tuple[tuple, tuple | None]:
    """The composed machine: (insult, threat, target, negation reach, reported) and what it writes."""
    insult, threat, target, reach, reported = state
    if symbol == END:
        return (0, 0, 0, 0, 0), ((insult, threat, target, reported) if insult or threat else None)
    heard = 2 if reach else 1  # 1: asserted, 2: negated only
    if symbol == INSULT:
        insult = 1 if insult == 1 else heard
    elif symbol == THREAT:
        threat = 1 if threat == 1 else heard
    elif symbol == TARGET:
        target = 1
    elif symbol == REPORT:
        reported = 1
    reach = REACH if symbol == NEGATION else max(0, reach - 1)
    return (insult, threat, target, reach, reported), None


def compile_grammar() -> tuple[list[list[int]], list[int], list[tuple]]:
    """Transitions by state and symbol, kind written at a clause end (-1: none), and the kinds."""
    states, kinds, moves, ends = {(0, 0, 0, 0, 0): 0}, [], [], []
    for state in (todo := list(states)):
        row, wrote = [], -1
        for symbol in range(7):
            to, kind = _step(state, symbol)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append(states[to])
            if kind is not None:
                if kind not in kinds:
                    kinds.append(kind)
                wrote = kinds.index(kind)
        moves.append(row)
        ends.append(wrote)
    return moves, ends, kinds


MOVES, ENDS, KINDS = compile_grammar()


class Grammar:
    def __init__(self, insults: tuple[str, ...], threats: tuple[str, ...] = ()):
        self.symbol = {w: s for s, ws in SEEDS.items() for w in ws.split()}
        self.symbol.update(dict.fromkeys(threats, THREAT))
        self.symbol.update(dict.fromkeys(insults, INSULT))
        self.table = WordTable(self._measure, 2)

    def _measure(self, word: str) -> tuple[int, int]:
        found = [self.symbol.get(p, OTHER) for p in WORD.findall(word)]
        return next((s for s in found if s), OTHER), int(word[-1] in STOPS)

    def clauses(self, text: str | None) -> np.ndarray:
        """How many clauses of each kind the whole text has."""
        counts = np.zeros(len(KINDS))
        if not text or not (words := words_of(text)):
            return counts
        codes = self.table.gather(words)
        if not np.isin(codes[:, 0], (INSULT, THREAT)).any():
            return counts
        state, quiet = 0, 0
        for at in np.flatnonzero(codes.any(axis=1)):
            for _ in range(min(at - quiet, REACH)):  # more ordinary words change nothing further
                state = MOVES[state][OTHER]
            symbol, stop = codes[at]
            state, quiet = MOVES[state][symbol], at + 1
            if stop:
                if ENDS[state] >= 0:
                    counts[ENDS[state]] += 1
                state = 0
        if ENDS[state] >= 0:
            counts[ENDS[state]] += 1
        return counts


@lru_cache(maxsize=1)
def grammar(insults: tuple[str, ...]) -> Grammar:
    """One per worker process and lexicon."""
    return Grammar(insults)


def evidence(counts: np.ndarray) -> np.ndarray:
    return np.log1p(counts)


def _cover(rows: list, positives: int) -> list[str]:
    """Sequential covering: the word that best tells apart what earlier words left, until none is left."""
    texts = {r["word"]: (set(r["pos"]), r["neg"]) for r in rows}
    chosen: list[str] = []
    while texts:
        gain = {w: (len(p) - 3 * n, w) for w, (p, n) in texts.items()
                if len(p) >= LEAST_SUPPORT and len(p) >= LEAST_PRECISION * (len(p) + n)}
        if not gain:
            break
        best = max(gain, key=gain.get)
        chosen.append(best)
        covered = texts.pop(best)[0]
        texts = {w: (left, n) for w, (p, n) in texts.items() if len(left := p - covered) >= LEAST_SUPPORT}
    return chosen


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[tuple[str, ...], tuple[float, ...]]:
    """Learned insults and the weight of each kind of clause, the intercept last."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ids = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    totals = {r["_toxic"]: r["n"] for r in ids.groupBy("_toxic").agg(F.count("*").alias("n")).collect()}
    picked = [ids.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_id"), "_id").limit(rows) for k in (0, 1)]
    sample = spark.createDataFrame([tuple(r) for p in picked for r in p.collect()], "_id long, _toxic int")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("_id", "_toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    prior = (totals.get(1, 0) + 1) / (sum(totals.values()) + 2)
    flat = (*[0.0] * len(KINDS), float(np.log(prior / (1 - prior))))
    if len(totals) < 2:
        return (), flat
    words = texts.select("_id", "_toxic", F.explode(F.array_distinct(
        F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))).alias("word")).filter(F.length("word") <= 40)
    # At most one id per sampled toxic row and word; only words that are mostly toxic are gathered.
    ranked = words.groupBy("word").agg(F.sum("_toxic").alias("n_pos"), F.sum(1 - F.col("_toxic")).alias("neg")).filter(
        (F.col("n_pos") >= LEAST_SUPPORT) & (F.col("n_pos") >= LEAST_PRECISION * (F.col("n_pos") + F.col("neg")))
    ).orderBy(F.desc("n_pos"), "word").limit(TRAIN_WORDS)
    gathered = words.filter(F.col("_toxic") == 1).join(F.broadcast(ranked), "word").groupBy("word", "neg").agg(
        F.collect_list("_id").alias("pos")).collect()
    insults = tuple(sorted(_cover(gathered, totals[1])))
    sampled = texts.select("_toxic", "text")
    x, y = [], []
    for row in _sample_evidence(sampled, insults).collect():
        x.append(row["kinds"])
        y.append(row["_toxic"])
    y = np.array(y, float)
    if not 0 < y.sum() < len(y):  # the labelled documents of one class aren't there
        return insults, flat
    w = logistic_fit(np.array(x), y)
    share = y.mean()
    w[-1] += np.log(prior / (1 - prior)) - np.log(share / (1 - share))  # both classes were sampled alike
    return insults, tuple(float(v) for v in w)


def _sample_evidence(texts: DataFrame, insults: tuple[str, ...]) -> DataFrame:
    def work(batches):
        claim(grammar(insults).table)
        count = grammar(insults).clauses
        for batch in batches:
            kinds = [evidence(count(t)).tolist() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.list_(pa.float64()))], ["_toxic", "kinds"])

    return map_rows(texts, work, "_toxic int, kinds array<double>")


def score(docs: DataFrame, model: tuple[tuple[str, ...], tuple[float, ...]]) -> DataFrame:
    """doc_id, score, predicted and clauses matched, one row per input row; only the text is looked at."""
    insults, weights = model

    def work(batches):
        claim(grammar(insults).table)
        count, w = grammar(insults).clauses, np.array(weights)
        for batch in batches:
            found = [count(t) for t in batch.column(1).to_pylist()]
            p = sigmoid(evidence(np.array(found).reshape(-1, len(KINDS))) @ w[:-1] + w[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32), pa.int32()),
                 pa.array([int(f.sum()) for f in found], pa.int32())], ["doc_id", "score", "predicted", "n_clauses"])

    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), work,
                    "doc_id long, score double, predicted int, n_clauses int")
