"""Reply trees to training conversations.

Messages name their parent. Iterative self-joins double the reach of every
message's ancestor link until all reach their root, which gives depths and path
scores; leaves are ranked by the score of their path, and the chosen leaves
walk their links back, halving the reach each time, so a path of n messages
takes about 2 log2(n) joins. Each path becomes one conversation.

Template, one piece a message: ``<|im_start|>role`` + line end + text +
``<|im_end|>`` + line end. Inside roles and texts every ``<``, backslashes and
``|`` in a row get one backslash more, and in roles backslashes and line ends
are written as ``\\\\`` and ``\\n``, so no text can imitate a mark and reading
back is exact. The loss mask covers the texts of assistant messages.

Defined results: null roles and texts are empty; turns without a conversation id
are one conversation, whose id stays null; messages whose parent is
missing are roots; repeated ids keep the smallest row; messages that lead only
into a cycle of parents have no root and give no path.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.llm.common import kept, ship

START, STOP = "<|im_start|>", "<|im_end|>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escape_role(role: Column) -> Column:
    plain = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(plain)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def reply_chain(conversations: DataFrame) -> DataFrame:
    """Messages of tables that list turns: each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select(
        F.col("conv_id").cast("long").alias("tree"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.row_number().over(order).cast("long").alias("id"))
    return numbered.withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn(
        "score", F.length("text").cast("double"))


def paths(messages: DataFrame, per_tree: int = 1) -> DataFrame:
    """tree, leaf, rank, depth (0 at the root) and id of the messages on each tree's best paths.

    A path's score is the mean score of its messages; ties go to the smaller leaf.
    """
    nodes = messages.groupBy("tree", "id").agg(F.min("parent").alias("parent"), F.max("score").alias("score"))
    known = nodes.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"))
    linked = nodes.join(known, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("parent") == F.col("_id")), "left")
    reach = kept(linked.select("tree", "id", F.col("_id").alias("up"), F.lit(1).cast("long").alias("steps"), "score"))
    leaves = reach.select("tree", "id").join(
        reach.filter("up is not null").select(F.col("tree").alias("_tree"), F.col("up").alias("_id")).distinct(),
        F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id")), "left_anti")
    jumps = []
    total = reach.count()
    while (1 << len(jumps)) <= max(total, 1) and not reach.filter("up is not null").isEmpty():
        jumps.append(reach)
        above = reach.select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"),
                             F.col("steps").alias("_steps"), F.col("score").alias("_score"))
        longer = reach.filter("up is not null").join(above, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("up") == F.col("_id"))).select(
            "tree", "id", F.col("_up").alias("up"), (F.col("steps") + F.col("_steps")).alias("steps"),
            (F.col("score") + F.col("_score")).alias("score"))
        reach = kept(reach.filter("up is null").union(longer))  # what has reached its root rests
    rooted = reach.filter("up is null").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), "steps",
                                               (F.col("score") / F.col("steps")).alias("mean"))
    ranked = leaves.join(rooted, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id"))).select(
        "tree", F.col("id").alias("leaf"), "steps", F.row_number().over(
            Window.partitionBy("tree").orderBy(F.desc("mean"), "id")).alias("rank")).filter(F.col("rank") <= per_tree)
    walk = ranked.select("tree", "leaf", "rank", (F.col("steps") - 1).alias("depth"), F.col("leaf").alias("id"))
    for k, jump in reversed(list(enumerate(jumps))):
        up = jump.filter("up is not null").select(F.col("tree").alias("_tree"), F.col("id").alias("_id"), F.col("up").alias("_up"))
        further = walk.join(up, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id"))).select(
            "tree", "leaf", "rank", (F.col("depth") - (1 << k)).alias("depth"), F.col("_up").alias("id"))
        walk = kept(walk.union(further))
    return walk


def formatted(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row per message of each path: its piece of the conversation and the loss mask within the piece.

    A conversation is the pieces by depth, joined by nothing; ``loss_start`` and
    ``loss_end`` count characters of the piece and are null outside the mask.
    """
    texts = messages.groupBy(F.col("tree").alias("_tree"), F.col("id").alias("_id")).agg(
        F.min(F.struct("role", "text")).alias("m"))
    role, text = escape_role(F.col("m.role")), escape(F.col("m.text"))
    head = F.concat(F.lit(START), role, F.lit("\n"))
    masked = F.col("m.role") == LEARNED_ROLE
    return chosen.join(texts, F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("id") == F.col("_id"))).select(
        "tree", "leaf", "rank", "depth", F.concat(head, text, F.lit(STOP + "\n")).alias("piece"),
        F.when(masked, F.length(head)).alias("loss_start"),
        F.when(masked, F.length(head) + F.length(text)).alias("loss_end"))


def conversations_text(pieces: DataFrame) -> DataFrame:
    """tree, leaf and the whole text with its loss spans, for conversations that fit in a row."""
    ordered = pieces.groupBy("tree", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "piece"))).alias("all"))
    return ordered.select("tree", "leaf", F.array_join(F.col("all.piece"), "").alias("text"))


MESSAGE = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(STOP) + r"\n", re.S)


BACK = "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches):
    """Streams sorted pieces; holds one piece and the running digests."""
    names = [part.split()[0] for part in BACK.split(", ")]
    at, state = None, None

    def closed():
        n, turns, chars, loss, size = state
        return {**dict(zip(names, at)), "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": size}

    for batch in batches:
        done = []
        # Arrow, not pandas: a null id would turn the others of its batch into floating point.
        for tree, leaf, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("tree", "leaf", "piece", "s", "e"))):
            if (tree, leaf) != at:
                if at is not None:
                    done.append(closed())
                at, state = (tree, leaf), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for found in MESSAGE.finditer(piece):
                state[1].update(f"{unescape_role(found[1])}\n{unescape(found[2])}\n".encode())
                state[0] += 1
            if end >= 0:
                text = unescape(piece[start:end])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(piece)
        if done:
            yield _rows(names, done)
    if at is not None:
        yield _rows(names, [closed()])


def _rows(names: list[str], rows: list[dict]) -> pa.RecordBatch:
    kinds = [pa.string() if "sha256" in name else pa.int64() for name in names]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kind) for n, kind in zip(names, kinds)], names)


def read_back(pieces: DataFrame) -> DataFrame:
    """What the formatted conversations say: turns, learned characters and their digests."""
    ship(pieces.sparkSession)
    sorted_pieces = pieces.select("tree", "leaf", "depth", "piece", F.coalesce("loss_start", F.lit(-1)).alias("s"),
                                  F.coalesce("loss_end", F.lit(-1)).alias("e")).repartition("tree", "leaf").sortWithinPartitions(
        "tree", "leaf", "depth")
    return sorted_pieces.mapInArrow(_read_back, BACK)
