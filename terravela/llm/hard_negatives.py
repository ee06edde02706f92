"""Hard negatives by blocked products of anchor and candidate matrices, in two passes over the candidates.

Components become floor(256 * x); scores are integer inner products, so that results don't depend on the order of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravela.plans.lineage import fresh_dir

SCALE = 256
#: Rows of a block of candidates and of anchors whose product is held at once, 2 MB.
ROWS = 512
NONE = np.iinfo(np.int64).min


def quantised(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, q array<double>): whole-numbered vectors of the rows that take part, one a vec_id.

    Rows with a null id or label, a null vector, or a component that is null or not finite are left out. Rows of one id count once; if they
    differ, the one with the smallest label, then the smallest vector, counts. A shorter vector counts as filled up with zeros.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("int").alias("label"), F.col(vector_col).alias("embedding"))
    kept = rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(good).select("vec_id", "label", F.transform(x, lambda v: F.floor(v * SCALE).cast("double")).alias("q"))
    return kept.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r")).select("vec_id", "r.label", "r.q")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of a matrix, filled up with zeros."""
    n = np.asarray(column.value_lengths(), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width))
    out[np.arange(width) < n[:, None]] = flat
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-numbered matrices, as int64: in float64 below 2^53, in int64 below 2^55."""
    most = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2**53:
        return (a @ b.T).astype(np.int64)
    if most < 2**55:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise ValueError("inner products of these vectors may pass 2^55")


class Best:
    """The first k (score descending, then id ascending) of each slot, merged as candidates come."""

    def __init__(self, slots: int, k: int):
        self.score, self.id = np.full((slots, k), NONE), np.full((slots, k), np.iinfo(np.int64).max)

    def could_enter(self, score: np.ndarray, ids: np.ndarray, slots: slice) -> np.ndarray:
        last, at = self.score[slots, -1][:, None], self.id[slots, -1][:, None]
        return (score > last) | (score == last) & (ids < at)

    def merge(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        k, touched = self.score.shape[1], np.unique(slot)
        slot = np.concatenate([slot, np.repeat(touched, k)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, ~score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        first = place < k
        self.score[slot[first], place[first]], self.id[slot[first], place[first]] = score[first], ids[first]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, place = np.nonzero(self.score != NONE)
        return slot, self.id[slot, place], self.score[slot, place]


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            part = batch.slice(i, ROWS)
            yield part.column(0).to_numpy(), part.column(1).to_numpy(), _matrix(part.column(2), width)


def _positives(shared, k: int):
    """Each task's first k rows of every anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, vectors = shared.value[:3]
        best = Best(len(own), k)
        for ids, label, q in _blocks(batches, vectors.shape[1]):
            for i in range(0, len(own), ROWS):
                at = slice(i, i + ROWS)
                score = _dot(vectors[at], q)
                a, c = np.nonzero((labels[at][:, None] == label) & (own[at][:, None] != ids) & best.could_enter(score, ids, at))
                best.merge(a + i, score[a, c], ids[c])
        slot, ids, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(own[slot]), pa.array(ids), pa.array(score)], ["anchor_id", "positive_id", "positive_score"])

    return run


def _negatives(shared, k: int, low: int, high: int):
    """Each task's first k rows of another label in the window of every anchor and positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, labels, vectors, anchor, positive, target = shared.value
        best, least, most = Best(len(anchor), k), -(-low * target // 100), high * target // 100
        for ids, label, q in _blocks(batches, vectors.shape[1]):
            for i in range(0, len(anchor), ROWS):
                at = slice(i, i + ROWS)
                rows, line = np.unique(anchor[at], return_inverse=True)
                score = _dot(vectors[rows], q)[line]
                inside = (score >= least[at][:, None]) & (score <= most[at][:, None])
                a, c = np.nonzero(inside & (labels[anchor[at]][:, None] != label) & best.could_enter(score, ids, at))
                best.merge(a + i, score[a, c], ids[c])
        slot, ids, score = best.found()
        yield pa.RecordBatch.from_arrays([pa.array(own[anchor[slot]]), pa.array(positive[slot]), pa.array(target[slot]), pa.array(ids), pa.array(score)], ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    return run


def _first(rows: DataFrame, keys: list[str], score: str, tie: str, k: int) -> DataFrame:
    """Merge the tasks' candidates: a key has k rows a task at most."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), tie))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def mine_hard_negatives(vectors: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, anchor_rows: int = 8192) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    vectors and anchors as quantised() gives them. An anchor's positives are the first n_positives rows of its label other than itself, by score
    descending, then vec_id; each has the first n_negatives rows of other labels with low * positive_score <= 100 * negative_score <=
    high * positive_score, ranked from 1. Anchors without positives and positives without negatives have no rows; empty tables give none.

    Candidates and anchors are written once. Anchors lie in files of anchor_rows rows at most, and one file at a time is
    broadcast (that many vectors), whose product with all candidates is taken in blocks of 512 x 512 where the candidates lie.
    A task keeps a bounded list for each anchor, lists are merged by anchor, and the second pass has the positives' scores beside
    the anchors. Scores are exact in float64 below 2^53 and in int64 below 2^55; vectors that could pass it raise an error.
    """
    spark = vectors.sparkSession
    held, asked, out = (fresh_dir(spark, f"negatives-{name}") for name in ("candidates", "anchors", "found"))
    vectors.write.parquet(held)
    candidates = spark.read.schema(vectors.schema).parquet(held)
    shape = "anchor_id long, positive_id long, positive_score long"
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    width, n_anchors = candidates.agg(F.max(F.size("q"))).first()[0] or 0, anchors.count()
    spark.createDataFrame([], result).write.parquet(out)
    anchors.repartition(max(1, math.ceil(n_anchors / anchor_rows))).write.option("maxRecordsPerFile", anchor_rows).parquet(asked)
    for path in sorted(spark.read.schema(anchors.schema).parquet(asked).inputFiles()) if n_anchors else []:
        block = spark.read.schema(anchors.schema).parquet(path).orderBy("vec_id").toArrow().combine_chunks()  # anchor_rows rows at most
        if not block.num_rows:
            continue
        own, labels = block.column("vec_id").to_numpy(), block.column("label").to_numpy()
        q = _matrix(block.column("q").combine_chunks(), width)
        shared = spark.sparkContext.broadcast((own, labels, q))
        positives = _first(candidates.select("vec_id", "label", "q").mapInArrow(_positives(shared, n_positives), shape), ["anchor_id"], "positive_score", "positive_id", n_positives)
        pairs = positives.select("anchor_id", "positive_id", "positive_score").toPandas().sort_values(["anchor_id", "positive_id"])  # n_positives for each of the block
        again = spark.sparkContext.broadcast((own, labels, q, np.searchsorted(own, pairs["anchor_id"].to_numpy(np.int64)), pairs["positive_id"].to_numpy(np.int64), pairs["positive_score"].to_numpy(np.int64)))
        negatives = candidates.select("vec_id", "label", "q").mapInArrow(_negatives(again, n_negatives, low, high), f"{shape}, negative_id long, negative_score long")
        ranked = _first(negatives, ["anchor_id", "positive_id"], "negative_score", "negative_id", n_negatives)
        ranked.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
        shared.unpersist()
        again.unpersist()
    return spark.read.schema(result).parquet(out)


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """Mine embeddings(vec_id, embedding, label): every 50th id is an anchor, and every seventh has its label moved by one of ten."""
    rows = quantised(embeddings)
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_hard_negatives(moved, moved.where("vec_id % 50 = 0"))
