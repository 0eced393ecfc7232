"""Merkle manifest: a tree of hashes a language, proofs by regenerating what was not stored.

Nodes are stored at every ``STORED``-th level only: leaves, then one node for
each aligned subtree of ``FAN ** STORED`` stored nodes. A proof walks down from
the root: each subtree is regenerated in its task from the stored nodes below
it, the siblings on every path are handed down (or, at the leaves, hashed) and
the interior nodes are forgotten. A task holds one subtree, whatever the size
of a language.

Defined results: null fields count as such; rows with equal ids are leaves of
their own, in the order of their hashes; rows without an id come first in their
language and are not altered by ``verify``; rows without a language form the
first tree. An empty table has no root and no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import kept, numbered, ship

#: Children of a node, and levels from one stored level to the next.
FAN = 8
STORED = 3
SPAN = FAN**STORED
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Hash of the fields, each with its length in bytes in front, so that no two rows read the same."""
    parts = []
    for field in fields:
        said = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(said).cast("string"), F.lit(":"), said), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """lang, doc_id, digest and found: the digest of the row as ``altered`` reads its text, null where it is the same row."""
    found = F.lit(None).cast("string")
    if altered is not None:
        changed = leaf([altered if name == "text" else F.col(name) for name in FIELDS])
        found = F.when(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False)), changed)
    return docs.select("lang", F.col("doc_id").cast("long").alias("doc_id"), leaf([F.col(n) for n in FIELDS]).alias("digest"), found.alias("found"))


def _levels(nodes: list[str], members: int) -> list[list[str]]:
    """The nodes of a subtree level by level, from the stored nodes to its top."""
    levels = [nodes]
    while len(levels) <= STORED and (members > SPAN or len(levels[-1]) > 1):
        last = levels[-1]
        levels.append([digest("".join(last[at:at + FAN])) for at in range(0, len(last), FAN)])
    return levels


def _tops(nodes: DataFrame) -> DataFrame:
    """(tree, place, members, digest) of the next stored level."""

    def work(group):
        order = np.argsort(group.column("place").to_numpy())
        members = group.column("members")[0].as_py()
        top = _levels(group.column("digest").take(pa.array(order)).to_pylist(), members)[-1][0]
        return pa.table({"tree": group.column("tree").slice(0, 1), "place": pa.array([group.column("place")[0].as_py() // SPAN], pa.int64()),
                         "members": pa.array([-(-members // SPAN)], pa.int64()), "digest": [top]})

    ship(nodes.sparkSession)
    rows = nodes.select("tree", "place", "members", "digest", F.expr(f"place div {SPAN}").alias("subtree"))
    return kept(rows.groupBy("tree", "subtree").applyInArrow(work, "tree string, place long, members long, digest string"))


def _stored(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels of all trees of (tree, place, members, digest), the last with one node a tree."""
    levels = [nodes]
    while not levels[-1].filter("members > 1").isEmpty():
        levels.append(_tops(levels[-1]))
    return levels


def _handed_down(nodes: DataFrame, above: DataFrame, finish, schema: str) -> DataFrame:
    """Rows ``finish`` makes of every stored node's row, its own digests and the paths above its subtree.

    ``above`` has tree, place, and the digests to the left and right on each
    level of the path (lefts, rights), and what else goes down unchanged.
    """

    def work(group, paths):
        if not group.num_rows:
            return schema_of.empty_table()
        place = group.column("place").to_numpy()
        order = np.argsort(place)
        group, first = group.take(pa.array(order)), place[order[0]] // SPAN * SPAN
        assert paths.num_rows == 1 and place[order[-1]] - first == len(place) - 1
        levels = _levels(group.column("digest").to_pylist(), group.column("members")[0].as_py())
        lefts, rights = [], []
        for at in range(group.num_rows):
            left, right = [], []
            for nodes in levels[:-1]:
                run = at - at % FAN
                left.append("".join(nodes[run:at]))
                right.append("".join(nodes[at + 1:run + FAN]))
                at //= FAN
            lefts.append(left)
            rights.append(right)
        return finish(group, lefts, rights, {name: paths.column(name)[0].as_py() for name in paths.column_names})

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema_of = to_arrow_schema(StructType.fromDDL(schema))
    ship(nodes.sparkSession)
    below = nodes.withColumn("subtree", F.expr(f"place div {SPAN}")).groupBy("tree", "subtree")
    return below.cogroup(above.groupBy("tree", "place")).applyInArrow(work, schema)


PATH = "tree string, place long, lefts array<string>, rights array<string>, subroot string, root string"


def _paths(group, lefts, rights, above):
    return pa.table({
        "tree": group.column("tree"), "place": group.column("place"),
        "lefts": pa.array([x + above["lefts"] for x in lefts], pa.list_(pa.string())),
        "rights": pa.array([x + above["rights"] for x in rights], pa.list_(pa.string())),
        "subroot": pa.array([above["subroot"]] * group.num_rows, pa.string()),
        "root": pa.array([above["root"]] * group.num_rows, pa.string())})


def folded(own: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf's digest and the digests beside its path give."""
    for left, right in zip(lefts, rights):
        own = digest(left + own + right)
    return own


PROOF = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(group, lefts, rights, above):
    proofs, roots = [], []
    for own, found, left, right in zip(group.column("digest").to_pylist(), group.column("found").to_pylist(), lefts, rights):
        left, right = left + above["lefts"], right + above["rights"]
        proofs.append(digest("".join(a + b for a, b in zip(left, right))))
        roots.append(folded(own if found is None else found, left, right))
    root = above["root"]
    return pa.table({
        "doc_id": group.column("doc_id"), "leaf": group.column("digest"),
        "subroot": pa.array([above["subroot"]] * group.num_rows, pa.string()), "root": pa.array([root] * group.num_rows, pa.string()),
        "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots]})


def _down(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """Paths of the lowest but one stored level, from the path of each tree's top."""
    for nodes in reversed(levels[1:]):
        above = kept(_handed_down(nodes.select("tree", "place", "members", "digest"), above, _paths, PATH))
    return above


class Manifest:
    """Stored levels of the trees of all languages and of the tree over their tops."""

    def __init__(self, rows: DataFrame):
        # Written first: cutting ranges reads the rows twice, and texts are to be hashed once.
        placed = numbered(kept(rows).withColumnRenamed("lang", "tree"), ["tree"], [F.asc_nulls_first("doc_id"), F.asc("digest")])
        self.levels = _stored(kept(placed))
        tops = self.levels[-1].select(F.col("tree").alias("lang"), F.col("digest"))
        placed = numbered(tops.withColumn("tree", F.lit("")), ["tree"], [F.asc_nulls_first("lang")])
        self.over = _stored(kept(placed))

    def roots(self) -> DataFrame:
        """lang, subroot, root."""
        root = self.over[-1].select(F.col("digest").alias("root"))
        return self.levels[-1].select(F.col("tree").alias("lang"), F.col("digest").alias("subroot")).join(F.broadcast(root))

    def proofs(self) -> DataFrame:
        """Each leaf with the hash of its proof and the root that the row found folds to (``PROOF``)."""
        none = F.array().cast("array<string>")
        top = self.over[-1].select("tree", "place", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"),
                                   F.col("digest").alias("root"))
        if len(self.over) == 1:
            tops = self.over[0].select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), none.alias("lefts"), none.alias("rights"),
                                       F.col("digest").alias("subroot"), F.col("digest").alias("root"))
        else:
            def named(group, lefts, rights, above):
                rows = _paths(group, lefts, rights, above)
                return rows.set_column(0, "tree", group.column("lang")).set_column(1, "place", pa.array([0] * rows.num_rows, pa.int64())).set_column(
                    4, "subroot", group.column("digest"))

            tops = kept(_handed_down(self.over[0], _down(self.over, top), named, PATH))
        return _handed_down(self.levels[0], _down(self.levels, tops), _proofs, PROOF)


def verify(docs: DataFrame, altered: Column | None = None) -> DataFrame:
    """Proofs of all rows against the untouched tree; rows whose id's crc32 3 divides are read back as ``altered``."""
    return Manifest(leaves(docs, altered)).proofs()
