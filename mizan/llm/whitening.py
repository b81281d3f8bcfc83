"""Embedding whitening: compensated covariance, eigenvectors by divide and conquer, whitened projections (operator 11)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import read

#: Components of a result at most.
COMPONENTS = 32
#: Dimensions at most: their covariance is one matrix of the driver.
MAX_DIM = 4_096
#: An eigenvalue below this share of the largest is rounding: its direction has no variance to divide by.
RANK = 1e-13
#: Rows whose products are summed at once, and parts in which tasks' sums meet first.
ROWS, PARTS = 1_024, 32


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, and exactly what rounding took from it (Knuth)."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a as two numbers of 26 bits (Veltkamp)."""
    c = 134217729.0 * a
    high = c - (c - a)
    return high, a - high


def column_sums(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums down the first axis of double-doubles, pair by pair."""
    while len(hi) > 1:
        k = len(hi) // 2
        s, e = two_sum(hi[:k], hi[k : 2 * k])
        e += lo[:k] + lo[k : 2 * k]
        hi, lo = (np.concatenate([s, hi[2 * k :]]), np.concatenate([e, lo[2 * k :]])) if len(hi) % 2 else (s, e)
    return two_sum(hi[0], lo[0])


def add(sums: tuple[np.ndarray, np.ndarray], more: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(sums[0], more[0])
    return two_sum(s, e + sums[1] + more[1])


def products(hi: np.ndarray, lo: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each column i of double-double rows, the sums of its products with the columns from i on."""
    a, b = halves(hi)
    out = []
    for i in range(hi.shape[1]):
        p = hi[:, i : i + 1] * hi[:, i:]
        ai, bi = a[:, i : i + 1], b[:, i : i + 1]
        e = ((ai * a[:, i:] - p) + ai * b[:, i:] + bi * a[:, i:]) + bi * b[:, i:]
        e += hi[:, i : i + 1] * lo[:, i:] + lo[:, i : i + 1] * hi[:, i:]
        out.append(column_sums(p, e))
    return out


@dataclass
class Center:
    """Counts and exact sums of the fit list; whole and rest: each dimension's mean as an integer and a double-double."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        exact = [Fraction(s % self.n, self.n) for s in self.sums]
        high = [float(x) for x in exact]
        return np.array(high), np.array([float(x - Fraction(h)) for x, h in zip(exact, high, strict=True)])

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x - S/n as double-doubles."""
        mean, low = self.rest
        gap = x - self.whole
        high = gap.astype(np.float64)
        s, e = two_sum(high, -mean)
        return two_sum(s, e - low + (gap - high.astype(np.int64)))


def usable(rows: DataFrame, vector: str = "embedding", *keep: str) -> DataFrame:
    """The kept columns and x, the longs floor(64 * c) + 1000000, of rows whose vector is neither null nor empty and holds
    no null, no non-finite entry and none that leaves the range of longs."""
    c = lambda v: v.cast("double") * 64
    fits = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(c(v)) < float(1 << 61)))
    good = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(fits, F.lit(False)))
    return good.select(*keep, F.transform(vector, lambda v: F.floor(c(v)).cast("long") + 1_000_000).alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield matrix(batch.slice(lo, ROWS).column(batch.schema.get_field_index("x")))


def center(xs: DataFrame) -> Center:
    """Exact sums of xs(x): tasks add upper and lower bits apart as longs, Spark adds those as decimals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(x.shape[1])), pa.array(np.full(x.shape[1], len(x))), pa.array((x >> 31).sum(axis=0)), pa.array((x & 0x7FFFFFFF).sum(axis=0))], ["i", "n", "upper", "lower"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    got = xs.select("x").mapInArrow(run, "i long, n long, upper long, lower long").groupBy("i").agg(F.sum("n").alias("n"), wide("upper"), wide("lower")).orderBy("i").collect()
    return Center(got[0]["n"] if got else 0, [(int(r["upper"]) << 31) + int(r["lower"]) for r in got])


def gathered(xs: DataFrame, work: Callable[[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sums over all rows of work's double-doubles, a list of rows of any length.

    A task hands on one sum of each; those meet in PARTS parts and then in one, so no group is gathered and merging never
    holds more than what work gives once. High and low parts go on together all the way."""

    def emit(sums: dict[int, tuple[np.ndarray, np.ndarray]], part: int) -> Iterator[pa.RecordBatch]:
        for i, (hi, lo) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part]), pa.array([hi.tolist()], pa.list_(pa.float64())), pa.array([lo.tolist()], pa.list_(pa.float64()))], ["i", "part", "hi", "lo"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for x in _blocks(batches):
            for i, more in enumerate(work(x)):
                sums[i] = add(sums[i], more) if i in sums else more
        yield from emit(sums, TaskContext.get().partitionId() % PARTS)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for i, hi, lo in zip(*(batch.column(k) for k in (0, 2, 3)), strict=True):
                more = (hi.values.to_numpy(), lo.values.to_numpy())
                sums[i.as_py()] = add(sums[i.as_py()], more) if i.as_py() in sums else more
        yield from emit(sums, 0)

    schema = "i long, part long, hi array<double>, lo array<double>"
    parts = xs.select("x").mapInArrow(each, schema).repartition("i", "part").mapInArrow(merge, schema)
    whole = parts.repartition("i").mapInArrow(merge, schema).orderBy("i").collect()
    return [(np.array(r["hi"]), np.array(r["lo"])) for r in whole]


def symmetric(rows: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The matrix whose upper triangle is rows / n, in extended precision."""
    out = np.zeros((len(rows), len(rows)), np.longdouble)
    for i, (hi, lo) in enumerate(rows):
        out[i, i:] = (hi.astype(np.longdouble) + lo) / n
    return out + np.triu(out, 1).T


def eigen(v: np.ndarray, refine: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns.

    numpy's eigh is LAPACK's syevd: Householder steps to a tridiagonal matrix, and that one by divide and conquer. Its
    vectors are then refined in extended precision (Ogita and Aishima), which squares their error."""
    e, q = np.linalg.eigh(v.astype(np.float64))
    q = q.astype(np.longdouble)
    for _ in range(refine):
        r = np.eye(len(v), dtype=np.longdouble) - q.T @ q
        s = q.T @ v @ q
        e = np.diag(s) / (1 - np.diag(r))
        d = s - np.diag(e)
        near = 2 * (np.linalg.norm(d.astype(np.float64), 2) + np.linalg.norm(v.astype(np.float64), 2) * np.linalg.norm(r.astype(np.float64), 2))
        gap = e[None, :] - e[:, None]
        apart = np.abs(gap) > near
        q = q + q @ np.where(apart, (s + e[None, :] * r) / np.where(apart, gap, 1), r / 2)
    for _ in range(2):
        q = q + q @ (np.eye(len(v), dtype=np.longdouble) - q.T @ q) / 2
    e = np.einsum("ij,ik,kj->j", q, v, q, optimize=True)
    order = np.argsort(-e, kind="stable")
    return e[order].astype(np.float64), q[:, order].astype(np.float64)


@dataclass
class Whitener:
    """What was fitted: center, unit eigenvectors as columns (falling eigenvalues), the trace and the error measured."""

    center: Center
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        hi, lo = self.center.centred(x)
        return ((hi @ self.vectors) + (lo @ self.vectors)) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S) ** 2, exactly; null where a long can't hold it."""
        n, rest = self.center.n, [s % self.center.n for s in self.center.sums]
        gap = x - self.center.whole
        if x.shape[1] * (float(n) * (float(np.abs(gap).max(initial=0)) + 1)) ** 2 < float(1 << 62):
            d = n * gap - np.array(rest, np.int64)
            return (d * d).sum(axis=1).tolist()
        exact = [sum((n * int(g) - r) ** 2 for g, r in zip(row, rest, strict=True)) for row in gap]
        return [v if v < 1 << 63 else None for v in exact]

    def transform(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component."""
        k, dim = len(self.values), len(self.center.sums)
        share = self.values / self.trace if k else self.values

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    x = matrix(part.column(1))
                    row = np.repeat(np.arange(len(x)), k)
                    far = pa.array(self.deviations(x), pa.int64()).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), far, pa.array(self.project(x).ravel()), pa.array(np.tile(share, len(x)))], ["vec_id", "component", "deviation", "whitened", "explained"])

        good = usable(rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector), vector, "vec_id").filter(F.size("x") == dim).filter(F.lit(k > 0))
        out = good.mapInArrow(run, "vec_id long, component int, deviation long, whitened double, explained double")
        return out.withColumns({"n": F.lit(self.center.n).cast("long"), "identity_error": F.lit(self.identity_error)})


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """Fit to all usable rows(vector).

    Four passes over one column, each with one row a task and dimension to merge: lengths, exact sums, centred products,
    and the whitened rows' own covariance, which tells the error. The driver holds one matrix of MAX_DIM ** 2 at most.
    Null vectors and those with null or non-finite entries are left out, and so are vectors of another length than the
    commonest (of two equally common ones the longer). Repeated rows count as often as they stand; equal vectors and
    tables without usable rows have no variance, so no component. Directions whose eigenvalue is rounding alone are no
    components. Ties among eigenvalues: any orthogonal choice, one for all rows. Other columns are not looked at.
    """
    every = usable(rows.select(vector), vector)
    common = every.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if common is None:
        return Whitener(Center(0, []), np.zeros(0), np.zeros((0, 0)), 0.0)
    if common["dim"] > MAX_DIM:
        raise ValueError(f"vectors of {common['dim']} dimensions; {MAX_DIM} at most")
    xs = every.filter(F.size("x") == common["dim"])
    mid = center(xs)
    v = symmetric(gathered(xs, lambda x: products(*mid.centred(x))), mid.n)
    values, vectors = eigen(v)
    k = min(components, int((values > RANK * max(values[0], 0)).sum()))
    found = Whitener(mid, values[:k], vectors[:, :k], float(np.trace(v)))
    if k:
        totals = gathered(xs, lambda x: [column_sums(w := found.project(x), np.zeros_like(w))])[0]
        mean = (totals[0] + totals[1]) / mid.n
        again = symmetric(gathered(xs, lambda x: products(*two_sum(found.project(x), -mean))), mid.n)
        found.identity_error = float(np.abs(again - np.eye(k)).max())
    return found


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    return fit(rows).transform(rows)
