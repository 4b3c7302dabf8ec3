"""Full hierarchies from parent-child links: root, depth and path of every node, and the nodes that hang on a loop.

Links form forests. Each partition unites its own links to a weighted disjoint-set forest: a link hangs the set of its node below
that of its parent at the link's weight (the number of steps it stands for), finding compresses, so that every node ends with
the topmost node reachable in the partition, its offset from it, or the knowledge that it hangs on a loop. Links that belong together are kept
together: a tree of at most ``LOCAL`` links is one partition and needs no more; a larger one is cut into ranges of its nodes.
Fragments are then merged hierarchically: only their tops, each with the offset to the top above, go on to the next level, where they
meet in one partition if they are few enough, or else double the distance they cover by equi-joins until none is open. Paths are
materialised by a traversal in order of depth, indexed by node, in the partitions, and handed down from a fragment's top to its nodes in one join.

No task holds more than ``LOCAL`` links of a tree; a top with a third of all nodes is a skewed left side that adaptive execution may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint

_SCHEMA = "tree bigint, node bigint, top bigint, path array<bigint>, loop boolean"
#: Links of a tree that one task unites (some 200 MB with their paths), and rows of a batch that goes out.
LOCAL, BATCH = 1_000_000, 20_000


def disjoint_sets(node: np.ndarray, parent: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(top, offset, loop) for each link, nodes being unique; tops of links that hang on a loop mean nothing."""
    ids = np.unique(np.concatenate([node, parent]))
    child = np.searchsorted(ids, node)
    up, offset, linked = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    up[child], offset[child], linked[child] = np.searchsorted(ids, parent), weight, True
    for _ in range(len(ids).bit_length()):
        above = up[up]
        if np.array_equal(above, up):
            break
        offset, up = offset + np.where(up == above, 0, offset[up]), above
    return ids[up[child]], offset[child], linked[up[child]]


def _paths(node: np.ndarray, parent: np.ndarray, steps: list, offset: np.ndarray, loop: np.ndarray) -> list:
    """Path of each node from below its top, by a traversal in order of depth over an index of the links."""
    at, out = {n: i for i, n in enumerate(node.tolist())}, [[] for _ in range(len(node))]
    above = parent.tolist()
    for i in np.argsort(offset, kind="stable").tolist():
        if not loop[i]:
            j = at.get(above[i])
            out[i] = steps[i] if j is None else out[j] + steps[i]
    return out


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of a partition's links (tree, node, parent, steps: the nodes from below the parent down to the node)."""
    links = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if links is None:
        return
    trees = links.column("tree").to_numpy()
    order = np.argsort(trees, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(trees[order])) + 1):
        part = links.take(pa.array(rows))
        node, parent, steps = part.column("node").to_numpy(), part.column("parent").to_numpy(), part.column("steps").to_pylist()
        top, offset, loop = disjoint_sets(node, parent, np.fromiter(map(len, steps), np.int64, len(steps)))
        paths = _paths(node, parent, steps, offset, loop)
        for i in range(0, len(node), BATCH):
            k = slice(i, i + BATCH)
            columns = [pa.array(np.full(len(node[k]), trees[rows[0]])), pa.array(node[k]), pa.array(top[k], mask=loop[k]), pa.array(paths[k], pa.list_(pa.int64())), pa.array(loop[k])]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "node", "top", "path", "loop"])


def local_forests(links: DataFrame, local: int = LOCAL) -> tuple[DataFrame, bool]:
    """``tree, node, top, path, loop`` of links (tree, node, parent, steps) by partition, and whether every tree was whole in one."""
    size = links.groupBy("tree").count().agg(F.max("count").alias("most"), F.sum("count").alias("all"), F.count(F.lit(1)).alias("trees")).first()
    whole = (size["most"] or 0) <= local
    parts = max(1, -(-(size["all"] or 0) // local))
    if whole:
        spread = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        near = links.repartition(max(parts, min(size["trees"], spread), 1), "tree")
    else:
        near = links.repartitionByRange(parts, "tree", "node")
    return near.select("tree", "node", "parent", "steps").mapInArrow(_forests, _SCHEMA), whole


def _doubled(state: DataFrame) -> DataFrame:
    """One round over fragments: each open one is hung below the fragment of its top, the paths add up."""
    b = state.select(*(F.col(c).alias(f"b_{c}") for c in ("tree", "node", "top", "path", "loop")))
    met = state.filter(~F.col("done")).join(b, (F.col("tree") == F.col("b_tree")) & (F.col("top") == F.col("b_node")), "left")
    more = F.col("b_node").isNotNull()
    loop = more & (F.col("b_loop") | (F.col("node") == F.col("top")) | F.array_contains("b_path", F.col("node")))
    path = F.when(loop, F.array().cast("array<bigint>")).when(more, F.concat("b_path", "path")).otherwise(F.col("path"))
    moved = met.select("tree", "node", F.when(loop, None).when(more, F.col("b_top")).otherwise(F.col("top")).alias("top"), path.alias("path"), loop.alias("loop"), (loop | ~more).alias("done"))
    return checkpoint(state.filter("done").unionByName(moved))


def merge_fragments(fragments: DataFrame, local: int = LOCAL, max_rounds: int = 64) -> DataFrame:
    """``fragments`` (the result of ``local_forests``, checkpointed) with tops, paths and loops as far as they go over all partitions."""
    tops = fragments.filter(~F.col("loop")).select(F.col("tree").alias("_t"), F.col("top").alias("_n")).distinct()
    above = checkpoint(fragments.join(tops, (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")), "left_semi"))
    most = above.groupBy("tree").count().agg(F.max("count").alias("most")).first()["most"]
    if most is None:
        return fragments
    if most <= local:  # a fragment on a loop stays one: it hangs below itself
        links = above.select("tree", "node", F.when(F.col("loop"), F.col("node")).otherwise(F.col("top")).alias("parent"), F.when(F.col("loop"), F.array("node")).otherwise(F.col("path")).alias("steps"))
        found = checkpoint(local_forests(links, local)[0])
    else:
        state = above.withColumn("done", F.col("loop"))
        for _ in range(max_rounds):
            state = _doubled(state)
            if state.filter(~F.col("done")).isEmpty():
                break
        else:
            raise RuntimeError(f"links are not resolved after {max_rounds} rounds")
        found = state.drop("done")
    b = found.select(*(F.col(c).alias(f"b_{c}") for c in ("tree", "node", "top", "path", "loop")))
    met = fragments.join(b, (F.col("tree") == F.col("b_tree")) & (F.col("top") == F.col("b_node")), "left")
    more = F.col("b_node").isNotNull()
    loop = F.col("loop") | F.coalesce("b_loop", F.lit(False))
    path = F.when(loop, F.array().cast("array<bigint>")).when(more, F.concat("b_path", "path")).otherwise(F.col("path"))
    return met.select("tree", "node", F.when(more, F.col("b_top")).otherwise(F.col("top")).alias("top"), path.alias("path"), loop.alias("loop"))


def hierarchy(links: DataFrame, tree: str, node: str, parent: str, local: int = LOCAL) -> DataFrame:
    """``tree``, ``node``, ``root``, ``depth``, ``path`` (array from root to node) for each node of each tree.

    ``node`` and ``parent`` are BIGINT codes. A root has depth 0 and the path of itself. A node on a loop, itself above itself
    included, or below one has a null root, a null path and depth -1. Repeated links count once; of several parents of a node
    the smallest counts; one that is in no other link is a root of its own. Links with a null in tree, node or parent take no part. An empty table gives no rows.
    """
    given = links.select(F.col(tree).cast("bigint").alias("tree"), F.col(node).alias("node"), F.col(parent).alias("parent")).dropna()
    pairs = checkpoint(given.distinct())
    edges = pairs.groupBy("tree", "node").agg(F.min("parent").alias("parent")).withColumn("steps", F.array("node"))
    fragments, whole = local_forests(edges, local)
    state = checkpoint(fragments)
    if not whole:
        state = checkpoint(merge_fragments(state, local))
    path = F.when(~F.col("loop"), F.concat(F.array("top"), F.col("path")))
    ended = state.select("tree", "node", F.when(~F.col("loop"), F.col("top")).alias("root"), F.when(F.col("loop"), -1).otherwise(F.size("path")).alias("depth"), path.alias("path"))
    above = pairs.select("tree", F.col("parent").alias("node")).distinct().join(state, ["tree", "node"], "left_anti")
    return ended.unionByName(above.select("tree", "node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.array("node").alias("path")))


def descendants(paths: DataFrame) -> DataFrame:
    """``tree``, ``node``, ``descendant``, ``distance`` for every pair on one path, from the result of ``hierarchy``.

    The result has one row for each node and ancestor, the sum of all depths. Nodes without a root have none.
    """
    up = paths.filter(F.col("depth") > 0).select("tree", F.col("node").alias("descendant"), "depth", F.posexplode("path").alias("_i", "node"))
    return up.filter(F.col("_i") < F.col("depth")).select("tree", "node", "descendant", (F.col("depth") - F.col("_i")).alias("distance"))
