"""A Merkle manifest of a table: a root for each group of rows, one root over all, and a proof for every row.

A leaf is the digest of a row's fields. Leaves of a group stand in order of their key; every `fanout` nodes in a
row become one, the digest of their hexadecimal digests, until one is left, the subroot of the group. The
subroots, by group, become the root in the same way.

Rows are numbered within their groups on Spark (one range shuffle, local numbers, running sums of counts) and
met in aligned blocks of `fanout`^k leaves, so a node above a block depends on nothing but the tops of blocks.
Inside a task a block is a contiguous NumPy matrix of 64-byte digests: a level is the level below, reshaped to
`fanout` digests a row and hashed row by row, and the siblings of every leaf follow from its index. Tops of
blocks are leaves of the next pass, so a group of any size is never held by one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Leaves of a block at most; a block has the largest power of the fanout that fits.
BLOCK = 1024
#: Bytes of a digest, in hexadecimal.
WIDTH = 64

_PATH = "array<struct<left:string,right:string>>"


def encode_field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon, and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest_fields(values: Sequence[Column]) -> Column:
    """SHA-256 (lower-case hexadecimal) of the encoded fields of a row."""
    return F.sha2(F.concat(*[encode_field(v) for v in values]), 256)


def _height(fanout: int) -> int:
    if fanout < 2:
        raise ValueError("fanout: 2 or more")
    k = 1
    while fanout ** (k + 1) <= BLOCK:
        k += 1
    return k


def _hash_runs(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """Digests of every `fanout` rows of a matrix of digests; the last run may be shorter."""
    full = len(nodes) // fanout * fanout
    out = [sha256(run).hexdigest() for run in nodes[:full].reshape(-1, fanout * WIDTH)]
    if full < len(nodes):
        out.append(sha256(np.ascontiguousarray(nodes[full:])).hexdigest())
    return np.frombuffer("".join(out).encode(), np.uint8).reshape(-1, WIDTH)


def block_levels(leaves: np.ndarray, fanout: int, height: int | None = None) -> list[np.ndarray]:
    """The levels of a block from its leaves up: `height` of them above the leaves or, if none is given, until one node is left."""
    levels = [np.ascontiguousarray(leaves)]
    while len(levels) <= height if height is not None else len(levels[-1]) > 1:
        levels.append(_hash_runs(levels[-1], fanout))
    return levels


def _runs(nodes: np.ndarray, index: np.ndarray, fanout: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For nodes by index: the digests of their runs (fanout to a row), the place of each in its run, the run's length."""
    start = index // fanout * fanout
    members = np.minimum(start[:, None] + np.arange(fanout), len(nodes) - 1)
    return nodes[members], index - start, np.minimum(len(nodes) - start, fanout)


def _matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests as a matrix of bytes."""
    flat = digests.combine_chunks() if isinstance(digests, pa.ChunkedArray) else digests
    flat = flat.chunk(0) if isinstance(flat, pa.ChunkedArray) else flat
    _, offsets, data = flat.buffers()
    kind = np.int64 if pa.types.is_large_string(flat.type) else np.int32
    first = int(np.frombuffer(offsets, kind)[flat.offset])
    return np.frombuffer(data, np.uint8)[first : first + len(flat) * WIDTH].reshape(-1, WIDTH)


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, [("at", "ascending")])).combine_chunks()


def number_rows(df: DataFrame, tree: str, order: Sequence[str], scratch: Scratch) -> DataFrame:
    """Add `at` (0, 1, ... within each tree, by `order`) and `n` (rows of the tree); written once.

    Rows are dealt by ranges of (tree, order) and numbered in their partition; a running sum over partitions
    gives where each begins. Rows equal in all of these are dealt at random, by a seed, and get numbers of their own.
    """
    dealt = df.withColumn("__tie", F.rand(11)).repartitionByRange(tree, *order, "__tie")
    local = scratch.save(dealt.sortWithinPartitions(tree, *order, "__tie").drop("__tie").withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", 33)
    counts = local.groupBy(tree, part.alias("__part")).agg(F.min("__row").alias("__first"), F.count("*").alias("__n"))
    whole = Window.partitionBy(tree)
    before = whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select(tree, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(whole).alias("n"))
    begins = scratch.save(begins)  # a row for each partition and tree that meet
    return local.withColumn("__part", part).join(begins, [tree, "__part"]).withColumn("at", F.col("__row") + F.col("__shift")).drop("__row", "__part", "__shift")


def _block_of(fanout: int) -> Column:
    return F.floor(F.col("at") / F.lit(fanout ** _height(fanout))).cast("long").alias("block")


def _tops(nodes: DataFrame, fanout: int) -> DataFrame:
    """(tree, at, n, digest) of the tops of blocks: the nodes of the next pass."""
    height = _height(fanout)
    size = fanout**height

    def top(key: tuple, block: pa.Table) -> pa.Table:
        tree, at = (x.as_py() for x in key)
        n = block.column("n")[0].as_py()
        levels = block_levels(_matrix(_in_order(block).column("digest")), fanout, height if n > size else None)
        return pa.table({"tree": [tree], "at": pa.array([at], pa.int64()), "n": pa.array([-(-n // size)], pa.int64()), "digest": [levels[-1].tobytes().decode()]})

    return nodes.select("tree", "at", "n", "digest", _block_of(fanout)).groupBy("tree", "block").applyInArrow(top, "tree string, at long, n long, digest string")


def _siblings(levels: list[np.ndarray], count: int, fanout: int):
    """For each level but the last: runs, places and lengths of the ancestors of all leaves."""
    index = np.arange(count)
    for nodes in levels[:-1]:
        yield _runs(nodes, index, fanout)
        index = index // fanout


def _paths(block: pa.Table, above: pa.Table, fanout: int, height: int) -> tuple[pa.Table, list[np.ndarray], list[dict], str]:
    """A block in order, its levels, and the path and the tree's top that its own top has."""
    block = _in_order(block)
    n = block.column("n")[0].as_py()
    levels = block_levels(_matrix(block.column("digest")), fanout, height if n > fanout**height else None)
    return block, levels, above.column("path")[0].as_py(), above.column("top")[0].as_py()


def _own_path(levels: list[np.ndarray], count: int, fanout: int) -> list[list[dict]]:
    out: list[list[dict]] = [[] for _ in range(count)]
    for runs, place, length in _siblings(levels, count, fanout):
        for path, run, p, m in zip(out, runs, place.tolist(), length.tolist(), strict=True):
            raw = run.tobytes().decode()
            path.append({"left": raw[: p * WIDTH], "right": raw[(p + 1) * WIDTH : m * WIDTH]})
    return out


def _climb(nodes: DataFrame, fanout: int, scratch: Scratch) -> DataFrame:
    """(tree, at, path, top) of all nodes: siblings from their level to the top of the tree, and that top."""
    most = nodes.agg(F.max("n")).first()[0] or 0
    if most <= 1:
        return nodes.select("tree", "at", F.array().cast(_PATH).alias("path"), F.col("digest").alias("top"))
    above = _climb(scratch.save(_tops(nodes, fanout)), fanout, scratch)
    height, kind = _height(fanout), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

    def paths(block: pa.Table, upper: pa.Table) -> pa.Table:
        block, levels, rest, top = _paths(block, upper, fanout, height)
        own = [path + rest for path in _own_path(levels, len(block), fanout)]
        return pa.table({"tree": block.column("tree"), "at": block.column("at"), "path": pa.array(own, kind), "top": [top] * len(own)})

    left = nodes.select("tree", "at", "n", "digest", _block_of(fanout)).groupBy("tree", "block")
    return left.cogroup(above.groupBy("tree", "at")).applyInArrow(paths, f"tree string, at long, path {_PATH}, top string")


def _tree(group: Column) -> Column:
    """A group as a text that is never null and sorts as the groups do, null first."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


class Manifest:
    """The manifest of `df`: a tree for each value of `group`, leaves in order of `key`, and a tree over the subroots.

    `columns` are the fields of a leaf, in this order. Null keys stand first, null groups are a group, the first.
    Rows of one group and key stand in order of their leaves; fully equal ones are leaves each. Null and empty
    texts differ (`-` and `0:`). An empty table has no root and gives no rows. Texts are hashed row by row on
    the way from the scan; only keys and digests are shuffled. Other columns of `df` are not read.

    `claims`, if given, replaces columns by expressions for a second leaf, which `audit` holds against the proofs;
    where `claimed` is not true the leaf itself stands in for it.
    """

    def __init__(self, df: DataFrame, key: str = "doc_id", group: str = "lang", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), fanout: int = 2, claims: dict[str, Column] | None = None, claimed: Column | None = None):
        _height(fanout)
        self.fanout, self.scratch = fanout, Scratch(df.sparkSession, "merkle")
        claims = claims or {}
        other = digest_fields([claims.get(c, F.col(c)) for c in columns]) if claims else F.lit(None).cast("string")
        claim = F.when(F.lit(True) if claimed is None else claimed, other) if claims else other
        rows = df.select(_tree(F.col(group)).alias("tree"), F.col(key).alias("key"), digest_fields([F.col(c) for c in columns]).alias("digest"), claim.alias("claim"))
        self.leaves = number_rows(rows, "tree", ["key", "digest", "claim"], self.scratch)
        above = self.scratch.save(_climb(self.scratch.save(_tops(self.leaves, fanout)), fanout, self.scratch))
        # The path of a group's first block is not needed, its top is the subroot.
        subroots = above.filter("at = 0").select(F.lit("").alias("tree"), F.col("tree").alias("member"), F.col("top").alias("digest"))
        subroots = self.scratch.save(number_rows(subroots, "tree", ["member"], self.scratch))
        over = _climb(subroots.select("tree", "at", "n", "digest"), fanout, self.scratch).select("at", F.col("path").alias("rest"), F.col("top").alias("root"))
        self.groups = self.scratch.save(subroots.select("at", "member", F.col("digest").alias("subroot")).join(over, "at").drop("at"))
        joined = above.join(self.groups, F.col("tree") == F.col("member"))
        self.above = joined.select("tree", "at", F.concat("path", "rest").alias("path"), F.struct("subroot", "root").alias("top"))

    def subroots(self) -> DataFrame:
        """group (as text), n, subroot, root: a row for each group."""
        sizes = self.leaves.groupBy("tree").agg(F.max("n").alias("n"))
        group = F.when(F.col("tree") != "", F.expr("substring(tree, 2)"))
        return sizes.join(self.groups, F.col("tree") == F.col("member")).select(group.alias("group"), "n", "subroot", "root")

    def _meet(self, work, schema: str) -> DataFrame:
        rows = self.leaves.select("tree", "at", "n", "key", "digest", "claim", _block_of(self.fanout))
        return rows.groupBy("tree", "block").cogroup(self.above.groupBy("tree", "at")).applyInArrow(work, schema)

    def _key_type(self) -> str:
        return self.leaves.schema["key"].dataType.simpleString()

    def proofs(self) -> DataFrame:
        """key, leaf, path, subroot, root: for each row the siblings of its leaf and of all nodes above it, as texts
        of digests that stand to the left and to the right."""
        fanout, height, kind = self.fanout, _height(self.fanout), pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))

        def work(block: pa.Table, upper: pa.Table) -> pa.Table:
            block, levels, rest, top = _paths(block, upper, fanout, height)
            own = [path + rest for path in _own_path(levels, len(block), fanout)]
            return pa.table({"key": block.column("key"), "leaf": block.column("digest"), "path": pa.array(own, kind), "subroot": [top["subroot"]] * len(own), "root": [top["root"]] * len(own)})

        return self._meet(work, f"key {self._key_type()}, leaf string, path {_PATH}, subroot string, root string")

    def audit(self) -> DataFrame:
        """key, leaf, subroot, root, proof_sha256, folded_root, verified: what the proof of each row makes of its
        claimed leaf. proof_sha256 is the digest of all siblings, level by level, left to right."""
        fanout, height = self.fanout, _height(self.fanout)

        def work(block: pa.Table, upper: pa.Table) -> pa.Table:
            block, levels, rest, top = _paths(block, upper, fanout, height)
            count, rows = len(block), range(len(block))
            folded = _matrix(pc.coalesce(block.column("claim"), block.column("digest"))).copy()
            proofs = [sha256() for _ in rows]
            for runs, place, length in _siblings(levels, count, fanout):
                own = np.zeros((count, fanout), bool)
                own[rows, place] = True
                others = ~own & (np.arange(fanout) < length[:, None])
                runs[rows, place] = folded
                after = []
                for r, m in enumerate(length.tolist()):
                    proofs[r].update(runs[r][others[r]])
                    after.append(sha256(runs[r, :m]).hexdigest())
                folded = np.frombuffer("".join(after).encode(), np.uint8).reshape(-1, WIDTH)
            sides = [(x["left"].encode(), x["right"].encode()) for x in rest]
            tail = b"".join(left + right for left, right in sides)
            found = []
            for r in rows:
                proofs[r].update(tail)
                node = folded[r].tobytes()
                for left, right in sides:
                    node = sha256(left + node + right).hexdigest().encode()
                found.append(node.decode())
            root = top["root"]
            return pa.table({"key": block.column("key"), "leaf": block.column("digest"), "subroot": [top["subroot"]] * count, "root": [root] * count, "proof_sha256": [p.hexdigest() for p in proofs], "folded_root": found, "verified": [x == root for x in found]})

        return self._meet(work, f"key {self._key_type()}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def fold(leaf: str, path: Sequence) -> str:
    """The root that a leaf has with a proof from `Manifest.proofs`: what a holder of one row checks."""
    for step in path:
        leaf = sha256((step["left"] + leaf + step["right"]).encode()).hexdigest()
    return leaf
