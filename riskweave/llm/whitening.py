"""Whitening of embeddings: covariance by Chan's merge of centred parts, leading components, verified.

Entries become whole numbers (``SCALE`` steps to 1, shifted by ``SHIFT``). Each partition
has one state: the count, exact sums, the mean and the scatter centred on it; batches and
then partitions are merged in pairs by Chan's formula (treeReduce), so nothing large is
squared before it is centred. The driver gets one state, the square of the dimensions,
and finds the eigenvectors. A second pass whitens every row and merges the states of the
whitened rows the same way: their covariance must be the identity.

Defined results: a row whose vector is null, empty, holds a null, infinite or NaN entry,
one beyond ``LIMIT``, or has another length than most (the longer of two as common) isn't
returned; components without variance (``FLAT`` of the first or less) aren't either, so
one row, or only equal ones, give an empty result; repeated rows count and are returned
as often as they occur; null ids stay; ``deviation`` is null where the exact number
doesn't fit a long, ``deviation_exact`` has it; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
LIMIT, FLAT = float(2**30), 1e-12
#: Entries of a batch that are worked on at once.
BLOCK = 1 << 20

#: count, exact sums (Python integers), mean, centred scatter
State = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def state(x: np.ndarray) -> State:
    """The state of the rows of ``x``."""
    mean = x.mean(0)
    centred = x - mean
    return len(x), x.sum(0).astype(object) if x.dtype.kind == "i" else x.sum(0), mean, centred.T @ centred


def merged(a: State | None, b: State | None) -> State | None:
    """Chan's formula."""
    if a is None or b is None:
        return a or b
    n, apart = a[0] + b[0], b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * (b[0] / n))


def whole_numbers(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and entries, as whole numbers, of the rows that remain, a block at a time."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(batch.column("embedding")), dims), False)
    rows = batch.filter(fits)
    step = max(1, BLOCK // dims)
    for at in range(0, rows.num_rows, step):
        some = rows.slice(at, step)
        c = some.column("embedding").flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
        fine = (np.abs(c) <= LIMIT).all(1)  # a null is NaN here, and no comparison holds of it
        if fine.any():
            yield some.column("vec_id").filter(pa.array(fine)), np.floor(c[fine] * SCALE).astype(np.int64) + SHIFT


def _reduced(rows: DataFrame, run) -> State | None:
    """The merged state of what ``run`` yields as pickled states, one of each partition."""

    def held(batches):
        total = None
        for x in run(batches):
            total = merged(total, state(x))
        yield pa.RecordBatch.from_pydict({"state": pa.array([pickle.dumps(total)], pa.binary())})

    parts = rows.mapInArrow(held, "state binary").rdd.map(lambda r: pickle.loads(r.state))
    return parts.treeReduce(merged) if parts.getNumPartitions() else None


class Whitening:
    """What is learned of the fit list; picklable."""

    def __init__(self, dims: int, fitted: State, components: int) -> None:
        self.dims, self.n, self.sums = dims, fitted[0], fitted[1]
        self.mean = np.array([float(s) / self.n for s in self.sums])
        self.covariance = fitted[3] / self.n
        values, vectors = np.linalg.eigh(self.covariance)
        order = np.argsort(-values, kind="stable")[:components]
        order = order[values[order] > max(FLAT * values.max(initial=0), 0)]
        self.values, self.vectors = values[order], vectors[:, order]
        self.explained = self.values / max(np.trace(self.covariance), np.finfo(float).tiny)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, list[int]]:
        """x - S/n, and the exact sums over dimensions of (n*x - S)^2."""
        far = np.abs(x - self.mean)
        if self.n * (float(np.abs(x).max()) + 1) < 2.0**61 and float((far**2).sum(1).max()) * self.n * self.n < 2.0**61:
            y = self.n * x - self.sums.astype(np.int64)
            return y / self.n, (y * y).sum(1).tolist()
        y = self.n * x.astype(object) - self.sums
        return np.array(y / self.n, float), [int(v) for v in (y * y).sum(1)]

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """Fit on all vectors of ``rows`` (embedding) that remain."""
    length = F.size("embedding").alias("dims")
    most = rows.select(length).where("dims > 0").groupBy("dims").count().orderBy(F.desc("count"), F.desc("dims")).first()
    if most is None:
        return None
    dims = most.dims

    def run(batches):
        for batch in batches:
            for _, x in whole_numbers(batch, dims):
                yield x

    fitted = _reduced(rows.select("vec_id", "embedding"), run)
    return Whitening(dims, fitted, components) if fitted else None


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """How far the covariance of the whitened rows is from the identity, at most."""

    def run(batches):
        for batch in batches:
            for _, x in whole_numbers(batch, model.dims):
                yield model.whitened(model.centred(x)[0])

    n, _, _, scatter = _reduced(rows.select("vec_id", "embedding"), run)
    return float(np.abs(scatter / n - np.eye(len(scatter))).max())


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of ``rows`` (vec_id, embedding) and component."""
    kind = dict(rows.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    model = fit(rows, components)
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(rows, model)

    def run(batches):
        k = len(model.values)
        for batch in batches:
            for ids, x in whole_numbers(batch, model.dims):
                centred, deviation = model.centred(x)
                n = len(x)
                each = np.repeat(np.arange(n), k)
                longs = pa.array([d if d < 2**63 else None for d in deviation], pa.int64())
                exact = pa.array([str(d) for d in deviation]).cast(pa.decimal128(38, 0))
                columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n)), longs.take(pa.array(each)), pa.array(model.whitened(centred).reshape(-1)), pa.array(np.tile(model.explained, n)), pa.array(np.full(n * k, error)), exact.take(pa.array(each))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return rows.select("vec_id", "embedding").mapInArrow(run, schema)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, whitened onto their first components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))
