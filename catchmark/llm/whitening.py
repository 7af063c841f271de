"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The covariance V of the distinct vectors is never formed. A pass multiplies it with a narrow block Q as the sum of Cᵀ(CQ)/n over
blocks of centred rows C, made in Spark's tasks and summed by a tree, so the driver holds dimension x block numbers whatever the
number of rows. A cycle damps the unwanted part of the spectrum with a Chebyshev polynomial of V (three-term recurrence, one pass
a degree), then takes QR and Rayleigh-Ritz. The damped interval reaches from a lower bound of the spectrum, which a Lanczos vector
that rides along in the passes of the first cycle gives, to the block's smallest Ritz value. Each cycle swaps the last columns of the
block for fresh random ones, so a direction that was missed shows as a Ritz vector that is not settled. The components are certified
when every wanted Ritz pair has a residual of CERTAIN of the largest eigenvalue; without that the fit raises, it never guesses.

Entries become integers first, floor(64 * c); a constant added to all of them cancels wherever they are used. So counts and sums are exact. Centring subtracts a whole number near the mean
from the integers and then the remaining fraction, so the offset costs no digits.

Cases: null vectors and vectors with null or non-finite entries are dropped; an entry beyond 2^53 / 64 counts as that; vectors of each
length are a family of their own, with their own n, sums and components; empty vectors give no rows, as they have no component, and so do components
without variance (a single distinct vector, copies only, constant entries); there are then fewer than 16. Repeated vectors count once
in the fit, and each row gets its result; ids may repeat or be null. ``deviation`` is null where it exceeds a long. Extra columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catchmark.operators.lineage import cut

COMPONENTS, SCALE, LARGEST = 16, 64, 2**53
#: Columns beyond the wanted ones, and how many of them are fresh in each cycle; rows of a packed block; partial sums a task adds up.
GUARD, FRESH, BLOCK_ROWS, FAN = 32, 4, 4096, 64
#: Residual of a certified pair and least share of the largest eigenvalue that counts as variance; spread of a cycle's amplification; passes at most.
CERTAIN, NO_VARIANCE, SPREAD, DEGREE, MAX_PASSES = 1e-13, 1e-13, 1e7, 10, 2000

RESULT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def usable(embedding: str) -> Column:
    """Not null, and finite throughout."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & finite, F.lit(False))


def _whole(embedding: str) -> Column:
    """floor(64 * c) of each entry, as long."""
    steps = lambda c: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), c.cast("double") * SCALE)))
    return F.transform(embedding, steps)


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length of an array column without nulls."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    for wide in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == wide)
        yield at, flat[(starts[at][:, None] + np.arange(wide)).reshape(-1)].reshape(len(at), wide)


def pack(vectors: DataFrame, embedding: str) -> DataFrame:
    """The distinct integer vectors as blocks (wide, rows, bytes, data, high, low): little-endian integers of the least width and two limbs of their sums."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, x in _matrices(batch.column(0)):
                for part in (x[i : i + BLOCK_ROWS] for i in range(0, len(x), BLOCK_ROWS)):
                    kind = next(t for t in (np.int16, np.int32, np.int64) if part.size == 0 or np.abs(part).max() <= np.iinfo(t).max)
                    data = part.astype(np.dtype(kind).newbyteorder("<"))
                    limbs = [(part >> 32).sum(0), (part & 0xFFFFFFFF).sum(0)]
                    yield pa.RecordBatch.from_pydict(
                        {"wide": pa.array([part.shape[1]], pa.int32()), "rows": pa.array([len(part)], pa.int64()), "bytes": pa.array([data.itemsize], pa.int32()), "data": [data.tobytes()], "high": [limbs[0]], "low": [limbs[1]]}
                    )

    distinct = vectors.filter(usable(embedding) & (F.size(embedding) > 0)).select(_whole(embedding).alias("x")).distinct()
    return cut(distinct.mapInArrow(blocks, "wide int, rows bigint, bytes int, data binary, high array<bigint>, low array<bigint>"), "whitening")


@dataclass(frozen=True)
class Centre:
    """n distinct vectors with exact sums: centred rows are (x - near) - left / n."""

    n: int
    sums: tuple[int, ...]

    @property
    def near(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def left(self) -> np.ndarray:
        return np.array([s % self.n for s in self.sums], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near).astype(np.float64) - self.left / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - sum)^2, exact; the offset of x cancels. None beyond a long."""
        off = x - self.near
        most = (np.abs(off).max(initial=0) + 1) * float(self.n)
        if most * most * x.shape[1] < 2.0**62:
            apart = off * self.n - self.left
            return np.einsum("ij,ij->i", apart, apart).tolist()
        exact = [sum((self.n * a - b) ** 2 for a, b in zip(row, self.left.tolist())) for row in off.tolist()]
        return [v if v < 2**63 else None for v in exact]


def centres(blocks: DataFrame) -> dict[int, Centre]:
    """For each length: rows and exact sums, one number for each dimension on the driver."""
    counted = {r["wide"]: r["n"] for r in blocks.groupBy("wide").agg(F.sum("rows").alias("n")).collect()}
    limbs = blocks.select("wide", F.posexplode(F.arrays_zip("high", "low")).alias("at", "limb"))
    whole = lambda c: F.sum(F.col(f"limb.{c}").cast("decimal(38,0)")).alias(c)
    sums = {w: [0] * w for w in counted}
    for r in limbs.groupBy("wide", "at").agg(whole("high"), whole("low")).collect():
        sums[r["wide"]][r["at"]] = (int(r["high"]) << 32) + int(r["low"])
    return {w: Centre(n, tuple(sums[w])) for w, n in counted.items()}


def total(blocks: DataFrame, centre: Centre, add, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of add(centred rows) over all blocks of one length: each task adds up its own, and tasks add up FAN partial sums until FAN are left."""
    wide = len(centre.sums)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for rows, size, data in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = add(centre.centred(np.frombuffer(data, f"<i{size}").reshape(rows, wide).astype(np.int64)))
                out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_pydict({"sum": [out.astype("<f8").tobytes()]})

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for data in batch.column(0).to_pylist():
                own = np.frombuffer(data, "<f8")
                out = own if out is None else out + own
        if out is not None:
            yield pa.RecordBatch.from_pydict({"sum": [out.tobytes()]})

    parts = blocks.filter(F.col("wide") == wide).select("rows", "bytes", "data").mapInArrow(partial, "sum binary")
    tasks = blocks.rdd.getNumPartitions()
    while tasks > FAN:
        tasks = math.ceil(tasks / FAN)
        parts = parts.repartition(tasks).mapInArrow(merged, "sum binary")
    out = np.zeros(math.prod(shape))
    for r in parts.collect():  # at most FAN rows of a block's size
        out = out + np.frombuffer(bytes(r["sum"]), "<f8")
    return out.reshape(shape)


def multiply(blocks: DataFrame, centre: Centre, q: np.ndarray) -> np.ndarray:
    """V q in one pass."""
    return total(blocks, centre, lambda c: c.T @ (c @ q), q.shape) / centre.n


class Floor:
    """A lower bound of V's spectrum by Lanczos steps with one vector, whose products come along in other passes."""

    def __init__(self, wide: int, rng: np.random.Generator):
        v = rng.standard_normal(wide)
        self.basis, self.diagonal, self.beside = [v / np.linalg.norm(v)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1][:, None]

    def step(self, product: np.ndarray) -> None:
        self.diagonal.append(float(self.basis[-1] @ product))
        known = np.array(self.basis).T
        rest = product - known @ (known.T @ product)
        rest -= known @ (known.T @ rest)
        self.beside.append(float(np.linalg.norm(rest)))
        self.basis.append(rest / (self.beside[-1] or 1.0))

    def bound(self) -> float:
        """The smallest Ritz value less its residual; 0 (V has no negative eigenvalue) at least."""
        if not self.diagonal:
            return 0.0
        k = len(self.diagonal)
        matrix = np.diag(self.diagonal) + np.diag(self.beside[: k - 1], 1) + np.diag(self.beside[: k - 1], -1)
        values, vectors = np.linalg.eigh(matrix)
        return max(0.0, float(values[0]) - self.beside[-1] * abs(float(vectors[-1, 0])))


def rayleigh_ritz(q: np.ndarray, vq: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(Ritz values falling, Ritz vectors, V times them) of the orthonormal block q."""
    h = q.T @ vq
    values, turn = np.linalg.eigh((h + h.T) / 2)
    turn = turn[:, ::-1]
    return values[::-1], q @ turn, vq @ turn


def degree_for(values: np.ndarray, low: float, high: float, wanted: int) -> int:
    """Passes of the next cycle: as many as keep the largest amplification within SPREAD times that of the last wanted value."""
    grow = lambda x: math.acosh(max(1.0, (2 * x - low - high) / max(high - low, 1e-300)))
    apart = grow(values[0]) - grow(values[wanted - 1])
    return int(min(DEGREE, max(2, math.log(SPREAD) / apart))) if apart > 0 else DEGREE


def components_of(blocks: DataFrame, centre: Centre, wanted: int = COMPONENTS, seed: int = 11) -> tuple[np.ndarray, np.ndarray, float]:
    """(eigenvalues falling, unit eigenvectors as columns, trace) of the covariance; pairs without variance are left out."""
    wide = len(centre.sums)
    rng = np.random.Generator(np.random.PCG64([seed, wide]))
    trace = float(total(blocks, centre, lambda c: np.einsum("ij,ij->j", c, c), (wide,)).sum()) / centre.n
    wanted = min(wanted, wide)
    if trace <= 0:
        return np.empty(0), np.empty((wide, 0)), trace
    width, passes = min(wide, wanted + GUARD), 1
    floor = Floor(wide, rng)
    values, q, vq = rayleigh_ritz(q := np.linalg.qr(rng.standard_normal((wide, width)))[0], multiply(blocks, centre, q))
    last = math.inf
    while True:
        residual = np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        settled = residual <= CERTAIN or (residual <= 100 * CERTAIN and residual > last / 2)  # rounding's own level
        if settled and (passes > 1 or width == wide):
            break
        if passes >= MAX_PASSES:
            raise RuntimeError(f"components not certified after {passes} passes: residual {residual:.1e}")
        last = residual
        if width < wide:
            q = np.column_stack([q[:, : width - FRESH], rng.standard_normal((wide, FRESH)) / math.sqrt(wide)])
        low, high = min(floor.bound(), 0.999 * values[width - FRESH - 1]), max(float(values[width - 1]), 1e-14 * values[0])
        low = min(low, 0.999 * high)
        degree, first = degree_for(values, low, high, wanted), len(floor.diagonal) == 0
        middle, half = (high + low) / 2, (high - low) / 2
        before, now = np.zeros_like(q), q
        grown = 1.0 / ((values[0] - middle) / half)  # scaled so that the first column keeps its length
        scale = grown
        for k in range(degree):
            product = multiply(blocks, centre, np.column_stack([now, floor.vector]) if first else now)
            if first:
                floor.step(product[:, -1])
                product = product[:, :-1]
            passes += 1
            turned = (product - middle * now) / half
            if k == 0:
                before, now = now, turned * scale
            else:
                following = 1.0 / (2.0 / grown - scale)
                before, now = now, 2.0 * following * turned - scale * following * before
                scale = following
        q = np.linalg.qr(now)[0]
        values, q, vq = rayleigh_ritz(q, multiply(blocks, centre, q))
        passes += 1
    kept = int((values[:wanted] > NO_VARIANCE * values[0]).sum())
    return values[:kept], q[:, :kept], trace


def fit(vectors: DataFrame, embedding: str = "embedding", wanted: int = COMPONENTS) -> dict[int, dict]:
    """For each length of vectors: centre, projection (columns v / sqrt(e)), explained shares, identity_error; small, on the driver."""
    blocks, out = pack(vectors, embedding), {}
    for wide, centre in sorted(centres(blocks).items()):
        values, q, trace = components_of(blocks, centre, wanted)
        project, error = q / np.sqrt(values), 0.0
        if len(values):
            moment = lambda c: np.vstack([(w := c @ project).T @ w, w.sum(0)])
            sums = total(blocks, centre, moment, (len(values) + 1, len(values))) / centre.n
            error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(values))).max())
        out[wide] = {"centre": centre, "project": project, "explained": values / trace if trace > 0 else values, "error": error}
    return out


def transform(vectors: DataFrame, fitted: dict[int, dict], vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """One row for each usable vector and component of its length: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.filter(usable(embedding)).select(F.col(vec_id).alias("vec_id"), _whole(embedding).alias("x"))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _matrices(batch.column(1)):
                one = fitted.get(x.shape[1])
                if one is None or not len(one["explained"]):
                    continue
                k, m = len(one["explained"]), len(at)
                deviation = pa.array(one["centre"].deviation(x), pa.int64())
                each = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(at)).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, one["centre"].n)), deviation.take(each),
                        pa.array((one["centre"].centred(x) @ one["project"]).reshape(-1)), pa.array(np.tile(one["explained"], m)), pa.array(np.full(m * k, one["error"])),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(project, f"vec_id {dict(rows.dtypes)['vec_id']}, {RESULT}")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """Fit on the distinct vectors, apply to every usable row."""
    return transform(vectors, fit(vectors, embedding, wanted), vec_id, embedding)
