"""Gradient-boosted regression trees, grown level by level from histograms that Spark sums over blocks of rows.

The rules are those of Spark ML's GBTRegressor: at most 32 bins per feature, splits by the gain in variance, the first tree in full and
the others, fitted to twice the error, by the rate. The values of a block are binned once, to a byte each. A tree node without a gain sends
all its rows to the left, so that every tree is complete and a row's place in a level follows from comparisons alone.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import functions as F

BINS = 32
# Quantiles that are looked at: a value that this share of the rows has is told from its neighbours.
MARKS = 256
BLOCK_ROWS = 65_536
# To start a Python task takes as long as some million rows in it, so that a few blocks are one task and there are no more tasks than cores.
TASK_ROWS = 4 * BLOCK_ROWS
# Trees after which the errors that are left are stored; those of the trees since then are taken off at each reading, which is less work.
TREES_HELD = 4
# Trees between two checkpoints, which cut the chain of steps that a lost block is computed from; a multiple of TREES_HELD.
TREES_KEPT = 24
NO_GAIN = 1e-10
# Combinations of bins that are counted at once; with the nodes of a level, their sums stay in a core's cache.
CELLS = 4096
# Levels whose nodes are compared one after another, a byte per row, which is faster than to look up each row's own node.
BYTE_LEVELS = 5


@dataclass
class BoostedTrees:
    """`feature` and `cut` per tree and inner node, in levels; `value` per tree and place in the last level, with the tree's weight."""

    thresholds: list
    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    importances: np.ndarray

    def predict(self, columns):
        bins, depth = binned(columns, self.thresholds), self.value.shape[1].bit_length() - 1
        out = np.full(bins.shape[1], self.base)
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            out += value[places(bins, feature, cut, depth)]
        return out


def thresholds_of(marks):
    """Borders between the bins of a feature, from its quantiles; a value that equals a border is below it."""
    seen = np.unique(marks)
    borders = (seen[:-1] + seen[1:]) / 2 if len(seen) <= BINS else np.unique(marks[MARKS // BINS : MARKS : MARKS // BINS])
    return borders[~np.isnan(borders)]


def binned(columns, thresholds):
    """One row of bytes per feature."""
    return np.stack([np.searchsorted(t, c, side="left").astype(np.uint8) for t, c in zip(thresholds, columns)])


def places(bins, feature, cut, level):
    """Place of each row among the nodes of a level, from the left."""
    n = bins.shape[1]
    at = np.zeros(n, np.uint8 if level <= BYTE_LEVELS else np.intp)
    for k in range(level):
        first = 2**k - 1
        if k < BYTE_LEVELS:
            right = np.zeros(n, bool)
            for j, (f, c) in enumerate(zip(feature[first : first + 2**k].tolist(), cut[first : first + 2**k].tolist())):
                if c < BINS - 1:
                    right |= (bins[f] > c) & (at == j)
        else:
            nodes = slice(first, first + 2**k)
            right = bins.ravel().take((feature[nodes] * n).take(at) + np.arange(n)) > cut[nodes].take(at)
        at <<= 1
        at |= right
    return at


def counted_together(sizes):
    """Groups of features, by their number of bins, of which all combinations of bins are few: the largest first, each into the first group with room."""
    groups = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        room = [g for g in groups if math.prod(sizes[j] for j in g) * sizes[i] <= CELLS]
        if room:
            room[0].append(i)
        else:
            groups.append([i])
    return groups


def histogram(blocks, sizes, feature, cut, level):
    """Rows and sums of the errors per feature, node of the level and bin, over all blocks of a task. `sizes` has the number of bins per feature.

    A row is counted once per group of features, in the cell of its bins, and cells are summed by feature at the end."""
    nodes, groups = 2**level, counted_together(sizes)
    shapes = [(nodes, *(sizes[i] for i in group)) for group in groups]
    totals = [np.zeros((2, math.prod(shape))) for shape in shapes]
    for bins, errors in blocks:
        at = places(bins, feature, cut, level)
        for group, total in zip(groups, totals):
            cell = at.astype(np.uint16 if total.shape[1] <= 65_536 else np.intp)
            for i in group:
                cell *= sizes[i]
                cell += bins[i]
            cell = cell.astype(np.intp, copy=False)
            total[0] += np.bincount(cell, minlength=total.shape[1])
            total[1] += np.bincount(cell, errors, total.shape[1])
    sums = np.zeros((2, len(sizes), nodes, BINS))
    for group, shape, total in zip(groups, shapes, totals):
        cells = total.reshape(2, *shape)
        for axis, i in enumerate(group, 2):
            sums[:, i, :, : sizes[i]] = cells.sum(axis=tuple(a for a in range(2, cells.ndim) if a != axis))
    yield sums


def best_splits(sums):
    """Per node: feature, last bin that goes left, gain, and the mean errors left and right."""
    (n, s), (whole_n, whole_s) = upto = np.cumsum(sums, axis=-1), np.sum(sums, axis=-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = s**2 / n + (whole_s - s) ** 2 / (whole_n - n)
        gain = parts - whole_s**2 / whole_n
    gain = np.where((n > 0) & (n < whole_n) & (gain > NO_GAIN * parts), gain, 0)
    gain = gain.swapaxes(0, 1).reshape(gain.shape[1], -1)
    node, best = np.arange(len(gain)), gain.argmax(axis=1)
    top = gain[node, best]
    feature, cut = np.divmod(np.where(top > 0, best, BINS - 1), BINS)
    left = upto[0][:, feature, node, cut]
    right = upto[1][:, feature, node, 0] - left
    means = [part[1] / np.maximum(part[0], 1) for part in (left, right)]
    return feature, cut, top, np.stack(means, axis=1)


def grown(blocks, sizes, depth):
    """One tree for the errors of the blocks: feature, cut, mean error per place of the last level, gain per feature."""
    feature, cut, gains = np.zeros(2**depth - 1, np.intp), np.full(2**depth - 1, BINS - 1), np.zeros(len(sizes))
    for level in range(depth):
        sums = blocks.mapPartitions(lambda b, f=feature, c=cut, k=level: histogram(b, sizes, f, c, k)).reduce(np.add)
        nodes = slice(2**level - 1, 2 ** (level + 1) - 1)
        feature, cut = feature.copy(), cut.copy()
        feature[nodes], cut[nodes], top, means = best_splits(sums)
        np.add.at(gains, feature[nodes], top)
    return feature, cut, means.ravel(), gains


def fit_trees(df, features, target, max_depth, trees, rate):
    """Fit to rows of numbers without NULL or NaN. Of the rows, only quantiles and sums per bin reach the driver."""
    spark, k = df.sparkSession, len(features)
    rows = df.select(*[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("_y"))
    steps = F.array(*[F.lit(i / MARKS) for i in range(MARKS + 1)])
    marks = [F.percentile_approx(f"_{i}", steps, 2000) for i in range(k)]
    n, base, *marks = rows.agg(F.count(F.lit(1)), F.avg("_y"), *marks).first()
    if not n:
        raise ValueError("no rows to fit to")
    thresholds = [thresholds_of(np.array(m)) for m in marks]
    sizes = [len(t) + 1 for t in thresholds]

    def pack(batches):
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= BLOCK_ROWS:
                yield block(held)
                held, size = [], 0
        if size:
            yield block(held)

    def block(held):
        columns = [c.to_numpy() for c in pa.Table.from_batches(held).columns]
        return pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in (binned(columns[:k], thresholds), columns[k] - base)], names=["bins", "errors"])

    packed = rows.mapInArrow(pack, "bins binary, errors binary")
    packed = packed.repartition(min(spark.sparkContext.defaultParallelism, -(-n // TASK_ROWS)))
    blocks = packed.rdd.map(lambda r: (np.frombuffer(r.bins, np.uint8).reshape(k, -1), np.frombuffer(r.errors))).persist(StorageLevel.MEMORY_AND_DISK)
    found, importances, held = [], np.zeros(k), [blocks]
    for tree in range(trees):
        feature, cut, means, gains = grown(blocks, sizes, max_depth)
        value = means if tree == 0 else 2 * rate * means
        found.append((feature, cut, value))
        importances += gains if tree == 0 else 4 * gains  # gains in twice the error

        def left_over(b, feature=feature, cut=cut, value=value):
            return b[0], b[1] - value[places(b[0], feature, cut, max_depth)]

        blocks = blocks.map(left_over)
        if tree % TREES_HELD == TREES_HELD - 1:
            held.append(blocks.persist(StorageLevel.MEMORY_AND_DISK))
            if len(held) > 2:
                held.pop(0).unpersist()
        if tree % TREES_KEPT == TREES_KEPT - 1:
            blocks.checkpoint()
    for stored in held:
        stored.unpersist()
    feature, cut, value = (np.stack(x) for x in zip(*found))
    return BoostedTrees(thresholds, base, feature, cut, value, importances / (importances.sum() or 1))
