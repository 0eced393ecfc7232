"""Exact token counts at every prefix of a text.

Byte-pair encodings of all prefixes follow from one pass of dynamic
programming: the last token of a prefix is the only vocabulary entry ending
there that stays intact beside the last token of what precedes it, so
``count[i] = count[j] + 1``. Pieces between the tokenizer's own cutting points
are independent; a piece's counts are remembered, and the counts of a text are
the running sum over its pieces. Truncation and budget questions then read the
stored counts and encode nothing again.

Defined results: null and empty texts have 0 tokens at their only prefix;
repeated rows give repeated results; other columns are never read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Memo, claim, map_rows

#: Fixed value: how the byte-level pre-tokenizer cuts a text.
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Chunks whose counts a worker remembers (memory only).
KNOWN_CHUNKS = 500_000
ADJACENT = re.compile(r"\s\s")


def chunks(text: str) -> list[str]:
    """Parts of a text that the pre-tokenizer never joins.

    Where no two white-space characters meet, it always cuts before a blank and
    on both sides of a line end; other texts are cut piece by piece.
    """
    if "\0" in text or ADJACENT.search(text):
        return PIECE.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixCounter:
    """Token counts of all prefixes under one byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbols = _byte_of_symbol()
        as_bytes = lambda word: bytes(symbols[c] for c in word)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(merges)}
        self.tokens = {as_bytes(word) for word in spec["model"]["vocab"]
                       if all(c in symbols for c in word)}
        self.longest = max(map(len, self.tokens))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        self.beside = Memo(self._stays_apart, KNOWN_CHUNKS)
        self.count_of_piece = Memo(lambda piece: self.piece_counts(piece.encode())[-1], KNOWN_CHUNKS // 2)
        self.count_of = Memo(self._whole, KNOWN_CHUNKS)

    def forget(self) -> None:
        for memo in (self.beside, self.count_of_piece, self.count_of):
            memo.clear()

    def _merged(self, data: bytes) -> list[bytes]:
        """Merge rules applied in order of rank."""
        parts = [data[k:k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda k: self.rank.get((parts[k], parts[k + 1]), 1 << 60))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best:best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _stays_apart(self, pair: tuple[bytes, bytes]) -> bool:
        before, token = pair
        return self._merged(before + token) == ([before, token] if before else [token])

    def piece_counts(self, piece: bytes) -> list[int]:
        """``out[i]``: tokens of the first ``i`` bytes."""
        tokens, beside, longest = self.tokens, self.beside, self.longest
        last, out = [b""] * (len(piece) + 1), [0] * (len(piece) + 1)
        for i in range(1, len(piece) + 1):
            for j in range(max(0, i - longest), i):
                token = piece[j:i]
                if token in tokens and beside[last[j], token]:
                    last[i], out[i] = token, out[j] + 1
                    break
        return out

    def _segments(self, text: str) -> Iterator[tuple[str, str]]:
        """(ordinary text, special string after it or '')."""
        at = 0
        for found in self.special.finditer(text):
            yield text[at:found.start()], found.group()
            at = found.end()
        yield text[at:], ""

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.special.search(text):
            return sum(map(self.count_of.__getitem__, chunks(text)))
        return sum(sum(map(self.count_of.__getitem__, chunks(part))) + bool(mark)
                   for part, mark in self._segments(text))

    def prefixes(self, text: str | None) -> list[int]:
        """``out[i]``: tokens of the first ``i`` characters, ``i`` from 0 to the length.

        Text that follows can change the cut of the last piece only, or of the
        last two where both are white space.
        """
        out, settled = [0], 0
        for part, mark in self._segments(text or ""):
            tail = ""
            for piece in PIECE.findall(part):
                lead = tail if tail.isspace() else ""
                base = settled - self._whole(lead)
                out.extend([base + self._whole(lead + piece[:size]) for size in range(1, len(piece) + 1)])
                settled, tail = settled + self._whole(piece), piece
            base = settled - self._whole(tail)
            out.extend([base + self._whole(tail + mark[:size]) for size in range(1, len(mark))])
            if mark:
                settled += 1
                out.append(settled)
        return out

    def _whole(self, text: str) -> int:
        return sum(self.count_of_piece[p] for p in PIECE.findall(text))

@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    """One per worker process and vocabulary."""
    return PrefixCounter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the limit is exceeded, one row per input row."""

    def work(batches):
        claim(counter(tokenizer))
        count = counter(tokenizer).count
        for batch in batches:
            numbers = pa.array([count(t) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), numbers], ["id", "n_bytes", "n"])

    read = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
                       F.col(text_col).alias("text"))
    return map_rows(read, work, "id long, n_bytes long, n long").select(
        F.col("id").alias("doc_id"), "n_bytes", F.col("n").alias("n_tokens"),
        (F.col("n") > limit).alias("over_limit"))


def prefix_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``counts``: element ``i`` (from 0) is the exact token count of the first ``i`` characters."""

    def work(batches):
        claim(counter(tokenizer))
        prefixes = counter(tokenizer).prefixes
        for batch in batches:
            arrays = pa.array([prefixes(t) for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), arrays], ["doc_id", "counts"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(read, work, "doc_id long, counts array<int>")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix within a budget, from stored counts (a longer prefix may cost less)."""
    fits = F.transform(F.reverse(counts), lambda n: n <= F.lit(budget))
    return F.size(counts) - F.array_position(fits, True).cast("int")
