"""Hard negatives: for an anchor and each of its positives, the nearest rows of other labels within a window.

Method: a multiway tree of hyperplanes (``gnat``). Its upper part is grown on a bounded sample and parts all rows
into cells; one pass over all rows gives the ranges of distances at its nodes, so that they hold for every row. Small
cells share a block and large ones are dealt into several, and each block grows the lower part of the tree over its own rows. Queries go to the blocks of
the cells that no range rules out; a block's rows come first in their task, then its queries stream past
them. Every leaf is scored exactly: nothing is approximate, the recall is 1.

The two searches are one: positives are the best ``POSITIVES`` rows of the anchor's label in a window without
bounds; negatives the best ``NEGATIVES`` of other labels in the window that a positive's score gives. The sample, which
holds real rows, tells each query at the outset what it need not look for.

Tasks hold a block of rows and a batch of queries. On vectors without any structure no range rules a block out:
then every query visits every block, as comparing it with all rows does.

Defined cases: rows with a NULL id, label or vector, or a component that is NULL or not finite, take no part.
Shorter vectors end in zeros. Of rows that repeat an id the smallest counts, by label, then components. Anchors without
a positive, and positives without a negative in their window, give no row. Equal scores go by the smaller id.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reelstate.llm import gnat
from reelstate.llm.common import releasing, saved
from reelstate.llm.vectors import matrix, scaled, width

POSITIVES = 5
NEGATIVES = 10
#: A negative scores between these per cent of its positive's score.
LEAST, MOST = 30, 90
#: Every so many ids an anchor.
ANCHORS = 100
#: Rows that the upper part of the tree is grown on, those of the smallest hashes of their ids.
SAMPLE = 4096
#: Cells of the upper part, and blocks: at least so many, and rows of a cell where there are more.
CELLS, CELL = 16, 32_768
#: Rows of a block and of a leaf, at most.
BLOCK, LEAF = 65_536, 512
#: Queries that are searched together.
BATCH = 2048

ROW = "_block int, _query boolean, _id long, _label long, _vector array<long>, _low array<double>, _high array<double>"


def usable(table: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``_id, _label, _vector`` of the rows that take part, each id once."""
    rows = table.select(F.col(key).alias("_id"), F.col(label).cast("long").alias("_label"),
                        scaled(vector).alias("_vector")).dropna()
    one = rows.groupBy("_id").agg(F.min(F.struct("_label", "_vector")).alias("_row"))
    return saved(one.select("_id", "_row.*"), "vectors")


def _batch(vectors: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, labels = (np.asarray(vectors.column(name), dtype=np.int64) for name in ("_id", "_label"))
    return matrix(vectors.column("_vector"), dims), ids, labels


def packed_cells(counts: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """First block and number of blocks of each cell: neighbours share a block, large cells have several."""
    found, block, filled = {}, -1, most
    for cell, rows in sorted(counts.items()):
        if rows > most:
            found[cell] = (block + 1, -(-rows // most))
            block, filled = block + found[cell][1], most
            continue
        if filled + rows > most:
            block, filled = block + 1, 0
        found[cell], filled = (block, 1), filled + rows
    return found


class Index:
    """Rows in blocks, under the upper part of a tree."""

    def __init__(self, rows: DataFrame, sample: int = SAMPLE, cell: int = CELL, block: int = BLOCK,
                 leaf: int = LEAF):
        self.leaf, self.dims, many = leaf, max(width(rows, "_vector"), 1), rows.count()
        order = F.xxhash64("_id")
        some = rows if many <= 2 * sample else rows.where(
            F.shiftrightunsigned(order, 1) < int(2 * sample / many * (1 << 63)))
        drawn = some.orderBy(order, "_id").limit(sample).toArrow()
        self.sample = _batch(drawn.combine_chunks().to_batches()[0], self.dims) if len(drawn) else None
        cells = max(CELLS, many // cell)
        self.tree = gnat.grow(self.sample[0], -(-len(drawn) // cells)) if len(drawn) else gnat.Tree([], [])
        self.tree = self.tree.without_ranges()
        placed = saved(self._placed(rows), "cells")
        self._learn(placed)
        counts = dict(placed.groupBy("_cell").count().collect())
        self.blocks = packed_cells(counts, min(block, -(-many // CELLS) if many else 1))
        self.many = max((first + n for first, n in self.blocks.values()), default=0)
        # a table of cells, of which there are no more than rows in the sample
        of = rows.sparkSession.createDataFrame(
            [(cell, first, n) for cell, (first, n) in self.blocks.items()], "_of int, _first int, _blocks int")
        self.rows = placed.join(F.broadcast(of), placed["_cell"] == of["_of"]).select(
            (F.col("_first") + F.pmod(order, F.col("_blocks")).cast("int")).alias("_block"),
            "_id", "_label", "_vector")

    def _placed(self, rows: DataFrame) -> DataFrame:
        tree, dims = self.tree, self.dims

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = tree.route(matrix(batch.column("_vector"), dims))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))],
                                                 names=[*batch.schema.names, "_cell"])

        return rows.mapInArrow(run, "_id long, _label long, _vector array<long>, _cell int")

    def _learn(self, rows: DataFrame) -> None:
        """The ranges at the tree's nodes from all rows; each task sends one row for a pair of point and subtree."""
        tree, dims = self.tree, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = tree.without_ranges()
            for batch in batches:
                own.route(matrix(batch.column(0), dims), learn=True)
            for number, node in enumerate(own.nodes):
                point, child = np.nonzero(np.isfinite(node.low))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(point), number)), pa.array(point), pa.array(child),
                     pa.array(node.low[point, child]), pa.array(node.high[point, child]),
                     pa.array(node.norms[0, child]), pa.array(node.norms[1, child])],
                    names=["node", "point", "child", "low", "high", "short", "long"])

        kinds = "node long, point long, child long, low double, high double, short double, long double"
        seen = rows.select("_vector").mapInArrow(run, kinds).groupBy("node", "point", "child").agg(
            F.min("low"), F.max("high"), F.min("short"), F.max("long"))
        for number, point, child, low, high, short, long in seen.collect():
            node = self.tree.nodes[number]
            node.low[point, child], node.high[point, child] = low, high
            node.norms[:, child] = short, long

    def best(self, queries: DataFrame, most: int, same: bool) -> DataFrame:
        """The best rows of each query and window: ``_query, _window, _rank, _found, _score``.

        ``queries`` has ``_id, _label, _vector`` and the windows' bounds, ``_low`` and ``_high``.
        """
        data = self.rows.select("_block", F.lit(False).alias("_query"), "_id", "_label", "_vector",
                                *[F.lit(None).cast("array<double>").alias(n) for n in ("_low", "_high")])
        both = data.unionByName(queries.mapInArrow(self._routed(most, same), ROW))
        dealt = both.repartition(max(2 * self.many, 1), "_block").sortWithinPartitions("_block", "_query")
        found = dealt.mapInArrow(self._searched(most, same), "_query long, _window int, _found long, _score long")
        rank = F.row_number().over(W.partitionBy("_query", "_window").orderBy(F.desc("_score"), "_found"))
        return found.withColumn("_rank", rank).where(F.col("_rank") <= most)

    def _routed(self, most: int, same: bool):
        tree, dims, sample, blocks = self.tree, self.dims, self.sample, self.blocks

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for wanted, batch in _wanted(batches, dims, most, same):
                if sample:
                    wanted.offer(np.arange(len(batch)), *sample)
                floor, asked = wanted.floor(), defaultdict(list)
                for cell, own in wanted.leaves(tree):
                    first, many = blocks.get(cell, (0, 0))
                    for block in range(first, first + many):
                        asked[block].append(own)
                for block, parts in asked.items():
                    own = np.unique(np.concatenate(parts))
                    part = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), block, dtype=np.int32)), pa.array([True] * len(own)),
                         *[part.column(name) for name in ("_id", "_label", "_vector")],
                         _lists(floor[own]), part.column("_high")],
                        names=["_block", "_query", "_id", "_label", "_vector", "_low", "_high"])

        return run

    def _searched(self, most: int, same: bool):
        dims, leaf = self.dims, self.leaf

        @releasing
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, tree = None, [], None
            for batch in batches:
                for part in _runs(batch):
                    number, query = part.column("_block")[0].as_py(), part.column("_query")[0].as_py()
                    if number != block:
                        block, held, tree = number, [], None
                    if not query:
                        held.append(_batch(part, dims))
                        continue
                    if tree is None and held:
                        rows = [np.concatenate(x) for x in zip(*held)]
                        held, tree = [], gnat.grow(rows[0], leaf)
                    if tree is None:  # none of a large cell's rows were dealt to this block
                        continue
                    for wanted, _ in _wanted([part], dims, most, same):
                        wanted.search(tree, *rows)
                        asked, window, place = np.nonzero(wanted.found != gnat.NO_ID)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(wanted.ids[asked]), pa.array(window.astype(np.int32)),
                             pa.array(wanted.found[asked, window, place]),
                             pa.array(wanted.score[asked, window, place].astype(np.int64))],
                            names=["_query", "_window", "_found", "_score"])

        return run


def _runs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch cut where the block changes, or rows turn to queries."""
    block = np.asarray(batch.column("_block"))
    query = np.asarray(batch.column("_query").to_numpy(zero_copy_only=False))
    cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(query.astype(np.int8)) != 0)) + 1
    for start, end in zip([0, *cuts], [*cuts, len(batch)]):
        if end > start:
            yield batch.slice(start, end - start)


def _wanted(batches, dims: int, most: int, same: bool) -> Iterator[tuple[gnat.Wanted, pa.RecordBatch]]:
    for whole in batches:
        for start in range(0, len(whole), BATCH):
            batch = whole.slice(start, BATCH)
            bounds = []
            for name in ("_low", "_high"):
                flat = batch.column(name).flatten().to_numpy(zero_copy_only=False)
                bounds.append(np.asarray(flat, dtype=np.float64).reshape(len(batch), -1))
            vectors, ids, labels = _batch(batch, dims)
            yield gnat.Wanted(vectors, ids, labels, *bounds, most, same), batch


def _lists(values: np.ndarray) -> pa.ListArray:
    many, wide = values.shape
    return pa.ListArray.from_arrays(np.arange(many + 1, dtype=np.int32) * wide, values.ravel())


def mined(table: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
          every: int = ANCHORS, positives: int = POSITIVES, negatives: int = NEGATIVES,
          least: int = LEAST, most: int = MOST, **index) -> DataFrame:
    """A row for each anchor, positive and negative, ranked from 1 among a positive's negatives.

    ``least`` and ``most`` bound a negative's score in per cent of the positive's.
    """
    rows = usable(table, key, vector, label)
    tree = Index(rows, **index)
    anchors = rows.where(F.col("_id") % every == 0)
    endless = [F.array(F.lit(float(x))).alias(n) for n, x in (("_low", "-inf"), ("_high", "inf"))]
    near = saved(tree.best(anchors.select("*", *endless), positives, True), "positives")
    score = F.col("_score")
    # a positive that scores below 0 has an empty window
    low = F.when(score >= 0, F.expr(f"({least} * _score + 99) div 100")).otherwise(F.lit(1))
    high = F.when(score >= 0, F.expr(f"({most} * _score) div 100")).otherwise(F.lit(0))
    bounds = near.groupBy(F.col("_query").alias("_of")).agg(
        F.sort_array(F.collect_list(F.struct("_rank", low.cast("double").alias("low"),
                                             high.cast("double").alias("high")))).alias("_bounds"))
    # windows that an anchor lacks are empty
    windows = [F.array(*[F.coalesce(F.get("_bounds", F.lit(i))[name], F.lit(none)) for i in range(positives)])
               .alias(f"_{name}") for name, none in (("low", 1.0), ("high", 0.0))]
    asking = anchors.join(bounds, anchors["_id"] == bounds["_of"]).select("_id", "_label", "_vector", *windows)
    hard = tree.best(asking, negatives, False)
    hard = hard.select(F.col("_query").alias("_anchor"), (F.col("_window") + 1).alias("_positive"),
                       F.col("_rank").alias("rank"), F.col("_found").alias("negative_id"),
                       F.col("_score").alias("negative_score"))
    both = hard.join(near, (hard["_anchor"] == near["_query"]) & (hard["_positive"] == near["_rank"]))
    return both.select(
        F.col("_anchor").alias("anchor_id"), F.col("_found").alias("positive_id"), "rank", "negative_id",
        F.col("_score").alias("positive_score"), "negative_score",
    )
