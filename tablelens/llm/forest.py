"""Embedding near-dedup by a forest of random-projection trees.

Each node of a tree projects on a random direction and splits at the median of a
sample. Vectors near the split spill to both sides, so close pairs are rarely
parted, and several trees find what one parts. Vectors that share a leaf are
compared exactly; a pair that shares several leaves counts in the first.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.llm.blocks import gathered, groups, pairs_of_blocks
from tablelens.llm.common import components, parts, written

TREES, LEAF_ROWS, BLOCK_ROWS = 5, 512, 2_048
#: Vectors the trees are fitted on at most, and sample rows a node needs to be split.
SAMPLE_ROWS, NODE_ROWS = 65_536, 32
#: Half the width of the spill, in standard deviations that the difference of two vectors
#: at the threshold has on a random direction.
SPILL = 0.4


@dataclass
class Tree:
    """Nodes by their number in heap order: 1 is the root, 2n and 2n + 1 are below n. Only
    the inner nodes are held, ascending, so a tree is as large as its sample has made it."""

    nodes: np.ndarray
    direction: np.ndarray
    median: np.ndarray
    margin: float

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, leaf)`` for each leaf that each row reaches."""
        row, node, done = np.arange(len(x)), np.ones(len(x), np.int64), []
        if not len(self.nodes):
            return row, node
        while len(row):
            at = np.minimum(np.searchsorted(self.nodes, node), len(self.nodes) - 1)
            inner = self.nodes[at] == node
            done.append((row[~inner], node[~inner]))
            row, node, at = row[inner], node[inner], at[inner]
            side = np.einsum("ij,ij->i", x[row], self.direction[at]) - self.median[at]
            low, high = side <= self.margin, side > -self.margin
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([2 * node[low], 2 * node[high] + 1])
        return np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])


def grow(sample: np.ndarray, depth: int, margin: float, seed: int) -> Tree:
    """A tree over a sample. No node of fewer than NODE_ROWS of its rows is split, whatever the depth asked for."""
    random = np.random.default_rng(seed)
    nodes, directions, medians = [], [], []
    waiting = deque([(1, 0, np.arange(len(sample)))])
    while waiting:
        node, level, mine = waiting.popleft()
        if level >= depth or len(mine) < NODE_ROWS:
            continue
        direction = random.standard_normal(sample.shape[1])
        direction /= np.linalg.norm(direction)
        side = sample[mine] @ direction
        median = np.median(side)
        nodes.append(node)
        directions.append(direction)
        medians.append(median)
        # The sample is split without spill, so that a node's rows follow its depth.
        low = side <= median
        waiting += [(2 * node, level + 1, mine[low]), (2 * node + 1, level + 1, mine[~low])]
    return Tree(np.array(nodes, np.int64), np.array(directions), np.array(medians), margin)


def _unit(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def fit_forest(vectors: DataFrame, rows: int, threshold: float, trees: int, sample_rows: int) -> dict[int, list[Tree]]:
    """Trees by dimension, on a sample picked by a hash of the ids. Dimensions without
    vectors in the sample have no tree: all their vectors share a leaf."""
    sample = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("embedding").toArrow()
    column = sample.column("embedding").combine_chunks()
    lengths = column.value_lengths().to_numpy(zero_copy_only=False) if len(column) else np.empty(0)
    forest = {}
    for d in np.unique(lengths).tolist():
        x = _unit(column.filter(pa.array(lengths == d)))
        depth = max(0, int(np.ceil(np.log2(max(rows * len(x) / len(column) / LEAF_ROWS, 1)))))
        margin = SPILL * np.sqrt(2 * (1 - threshold) / d)
        forest[int(d)] = [grow(x, depth, margin, 101 * t + 1) for t in range(trees)]
    return forest


def _leaf_codes(x: np.ndarray, d: int, trees: list[Tree]) -> list[np.ndarray]:
    """All leaves of each row, ascending, over all trees."""
    if not trees:
        return [np.array([d << 40], np.int64)] * len(x)
    found = [t.leaves(x) for t in trees]
    row = np.concatenate([f[0] for f in found])
    code = np.concatenate([(d << 40) + (i << 32) + f[1] for i, f in enumerate(found)])
    order = np.lexsort((code, row))
    return np.split(code[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])


def _compare(group: pa.Table, threshold: float) -> pa.RecordBatch | None:
    """Links of one leaf (or two blocks of it): per vector the number of vectors linked and
    the smallest vector of its part of the leaf."""
    ids, copies, own = (group.column(c).to_numpy() for c in ("rep", "copies", "_own"))
    leaf, one, two = (group.column(c)[0].as_py() for c in ("leaf", "_i", "_j"))
    x = _unit(group.column("embedding"))
    lists = group.column("leaves").combine_chunks()
    sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy()
    earlier = np.full((len(ids), int(sizes.max())), -1, np.int64)
    where = np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    earlier[where] = flat
    earlier = np.where((earlier >= 0) & (earlier < leaf), earlier, -1)
    most = int((earlier >= 0).sum(axis=1).max())
    earlier = -np.sort(-earlier, axis=1)[:, :most]
    places, links, root = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.arange(len(ids))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for start in range(0, len(ids), 512):
        some = places[start : start + 512, None]
        near = x[start : start + 512] @ x.T >= threshold
        near &= places > some if one == two else (own[some] == one) & (own == two)
        i, j = np.nonzero(near)
        i += start
        for at in range(0, len(i), 50_000):
            a, b = i[at : at + 50_000], j[at : at + 50_000]
            if most:
                left, right = earlier[a][:, :, None], earlier[b][:, None, :]
                fresh = ~((left == right) & (left >= 0)).any(axis=(1, 2))
                a, b = a[fresh], b[fresh]
            np.add.at(links, a, copies[b])
            np.add.at(links, b, copies[a])
            # One link for each vector that is not joined yet is enough for the parts.
            for p, q in zip(a.tolist(), b.tolist(), strict=True):
                p, q = top(p), top(q)
                if p != q:
                    root[q if ids[p] < ids[q] else p] = p if ids[p] < ids[q] else q
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    tops = np.array([top(i) for i in linked.tolist()])
    return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(links[linked]), pa.array(ids[tops])], ["rep", "links", "top"])


def near_vectors(
    vectors: DataFrame, threshold: float = 0.9, trees: int = TREES, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row per row of ``vectors``.

    Vectors with a cosine of at least ``threshold``, in double precision, are linked if
    some tree brings them together; ``n_links`` counts those linked directly,
    ``component_id`` is the smallest id reachable. Equal vectors are compared once
    and all link with each other. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing, nor do vectors of different
    dimensions. A row with a NULL id stands alone: its component is NULL and it is
    kept. Ids should be unique: rows that share one are placed by their own vector.
    An empty table gives no rows; other columns are not read.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>" if _is_float(vectors) else "array<double>"))
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    good = F.coalesce(finite & F.exists("embedding", lambda v: v != 0), F.lit(False))
    usable = rows.where(good & F.col("vec_id").isNotNull())
    equal = written(
        usable.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    )
    forest = fit_forest(equal, equal.count(), threshold, trees, sample_rows)

    def assign(batches):
        for batch in batches:
            lengths = batch.column("embedding").value_lengths().to_numpy(zero_copy_only=False)
            for d in np.unique(lengths).tolist():
                some = batch.filter(pa.array(lengths == d))
                codes = _leaf_codes(_unit(some.column("embedding")), d, forest.get(d, []))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(codes, pa.list_(pa.int64()))], [*some.schema.names, "leaves"])

    kind = rows.schema["embedding"].dataType.simpleString()
    schema = f"embedding {kind}, rep long, copies long, leaves array<long>"
    leaves = equal.mapInArrow(assign, schema).withColumn("leaf", F.explode("leaves"))
    met = gathered(pairs_of_blocks(leaves, "leaf", "rep", BLOCK_ROWS), ["leaf", "_i", "_j"], parts(vectors.sparkSession))

    def compare(batches):
        for group in groups(batches, ["leaf", "_i", "_j"]):
            found = _compare(group, threshold)
            if found is not None:
                yield found

    found = written(met.mapInArrow(compare, "rep long, links long, top long"))
    reached = written(components(found.select("rep", "top"), "rep", "top")).withColumnRenamed("id", "rep")
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    classes = equal.join(counts, "rep", "left").join(reached, "rep", "left")
    placed = rows.join(
        classes.select(
            F.col("embedding").alias("_embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        ),
        (F.col("embedding") == F.col("_embedding")) & good & F.col("vec_id").isNotNull(),
        "left",
    )
    component = F.coalesce("component", "vec_id")
    return placed.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def _is_float(vectors: DataFrame) -> bool:
    return vectors.schema["embedding"].dataType.simpleString() == "array<float>"
