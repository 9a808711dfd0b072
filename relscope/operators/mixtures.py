"""k-means and Gaussian mixtures of several sizes, fitted side by side.

Every round is one pass over the distinct points with their counts, in which all models that still move
take a step: k-means assigns, a mixture weighs.  A pass returns sums of a size that follows the
models alone.  Mixtures start from the k-means of their size, with full and with diagonal covariances.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sums

#: Points, those of the smallest hash, among which first centres are drawn; every round is over all points.
SEEDS = 4096
#: Rounds at most; how far centres still move, in parts of the mean variance; how much the mean log-likelihood still gains.
ROUNDS, STILL, GAIN = 100, 1e-4, 1e-3
#: Added to each variance.
FLOOR = 1e-6
#: Points of a block in a task, and points that are worth a task.
BLOCK, TASK = 8192, 4096


def points_of(vectors: DataFrame, name: str = "v") -> DataFrame:
    """(v, n): the distinct points of an array column with their counts."""
    return vectors.groupBy(F.col(name).alias("v")).agg(F.count("*").alias("n"))


def arrays(batch: pa.RecordBatch, dim: int, origin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Points less the origin, and their counts, block by block."""
    x = batch["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) - origin
    w = batch["n"].to_numpy().astype(float)
    return [(x[a : a + BLOCK], w[a : a + BLOCK]) for a in range(0, len(x), BLOCK)]


def gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1))


@dataclass
class Centres:
    """k-means of k centres."""

    centres: np.ndarray
    moving: bool = True
    rounds: int = 0
    cost: float = math.inf
    silhouette: float = -1.0

    @property
    def k(self) -> int:
        return len(self.centres)

    @property
    def size(self) -> int:
        return self.k * (1 + self.centres.shape[1]) + 1

    def part(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        gap = gaps(x, self.centres)
        near = gap.argmin(axis=1)
        member = np.zeros((len(x), self.k))
        member[np.arange(len(x)), near] = w
        return np.concatenate([member.sum(axis=0), (member.T @ x).ravel(), [(gap.min(axis=1) * w).sum()]])

    def take(self, total: np.ndarray, variance: float) -> None:
        n, self.cost = total[: self.k], float(total[-1])
        new = total[self.k : -1].reshape(self.k, -1) / np.maximum(n, 1e-300)[:, None]
        new[n == 0] = self.centres[n == 0]
        self.rounds += 1
        self.moving = bool(np.square(new - self.centres).sum() > STILL * variance) and self.rounds < ROUNDS
        self.centres = new

    def predict(self, x: np.ndarray) -> np.ndarray:
        return gaps(x, self.centres).argmin(axis=1)


@dataclass
class Mixture:
    """A mixture of k Gaussians with ``full`` or ``diag`` covariances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    kind: str = "full"
    moving: bool = True
    rounds: int = 0
    likelihood: float = -math.inf

    #: Centres whose hard assignment is the first step.
    start: Centres | None = None

    @classmethod
    def around(cls, own: Centres, kind: str) -> Mixture:
        k, d = own.centres.shape
        return cls(np.full(k, 1 / k), own.centres, np.zeros((k, d, d) if kind == "full" else (k, d)), kind, start=own)

    @property
    def k(self) -> int:
        return len(self.weights)

    @property
    def size(self) -> int:
        return self.k * (1 + self.means.shape[1]) + self.covariances.size + 1

    @property
    def free(self) -> int:
        """Free parameters."""
        k, d = self.means.shape
        return k * d + k * (d * (d + 1) // 2 if self.kind == "full" else d) + k - 1

    def logs(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density, a column per component."""
        out = np.empty((len(x), self.k))
        for i in range(self.k):
            away = x - self.means[i]
            if self.kind == "full":
                root = np.linalg.cholesky(self.covariances[i])
                scaled, log_root = np.linalg.solve(root, away.T), np.log(np.diag(root)).sum()
                square = (scaled * scaled).sum(axis=0)
            else:
                square, log_root = (away * away / self.covariances[i]).sum(axis=1), np.log(self.covariances[i]).sum() / 2
            out[:, i] = math.log(max(self.weights[i], 1e-300)) - x.shape[1] / 2 * math.log(2 * math.pi) - log_root - square / 2
        return out

    def part(self, x: np.ndarray, w: np.ndarray) -> np.ndarray:
        if self.start is None:
            logs = self.logs(x)
            top = logs.max(axis=1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            share = np.exp(logs - total[:, None]) * w[:, None]
        else:
            total, share = np.zeros(len(x)), np.zeros((len(x), self.k))
            share[np.arange(len(x)), self.start.predict(x)] = w
        squares = np.stack([(x * s[:, None]).T @ x for s in share.T]) if self.kind == "full" else share.T @ (x * x)
        return np.concatenate([share.sum(axis=0), (share.T @ x).ravel(), squares.ravel(), [(total * w).sum()]])

    def take(self, total: np.ndarray, rows: float) -> None:
        k, d = self.means.shape
        n = np.maximum(total[:k], 1e-12)
        likelihood, means = float(total[-1]), total[k : k + k * d].reshape(k, d) / n[:, None]
        squares = total[k + k * d : -1].reshape(self.covariances.shape) / n.reshape(-1, *[1] * (self.covariances.ndim - 1))
        self.rounds += 1
        if self.start is None:
            self.moving = (likelihood - self.likelihood) / rows > GAIN and self.rounds < ROUNDS
            self.likelihood = likelihood
        self.start = None
        if self.moving:
            if self.kind == "full":
                spread = squares - means[:, :, None] * means[:, None, :]
                self.covariances = _positive((spread + spread.transpose(0, 2, 1)) / 2)
            else:
                self.covariances = np.maximum(squares - means * means, 0) + FLOOR
            self.weights, self.means = n / n.sum(), means

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.logs(x).argmax(axis=1)


def _positive(spread: np.ndarray) -> np.ndarray:
    """Symmetric matrices with no eigenvalue under the floor."""
    values, axes = np.linalg.eigh(spread)
    return (axes * (np.maximum(values, 0) + FLOOR)[:, None, :]) @ axes.transpose(0, 2, 1)


def first_centres(x: np.ndarray, w: np.ndarray, k: int, seed: int) -> np.ndarray:
    """``k`` points drawn by their squared distance to those drawn before; fewer if there are fewer."""
    draw = np.random.default_rng([seed, k])
    chosen = [int(draw.choice(len(x), p=w / w.sum()))]
    far = gaps(x, x[chosen])[:, 0]
    while len(chosen) < min(k, len(x)) and (far * w).sum() > 0:
        some = draw.choice(len(x), size=2 + int(math.log(k)), p=far * w / (far * w).sum())
        left = np.minimum(far, gaps(x, x[some]).T)
        best = int((left @ w).argmin())
        chosen.append(int(some[best]))
        far = left[best]
    return x[chosen]


@dataclass
class Fitted:
    """Models around an origin, by size, and by size and kind."""

    origin: np.ndarray
    rows: float
    kmeans: dict[int, Centres] = field(default_factory=dict)
    mixtures: dict[tuple[int, str], Mixture] = field(default_factory=dict)
    passes: int = 0

    def bic(self, m: Mixture) -> float:
        return m.free * math.log(self.rows) - 2 * m.likelihood

    def aic(self, m: Mixture) -> float:
        return 2 * m.free - 2 * m.likelihood


def fit(points: DataFrame, dim: int, ks, sizes, kinds=("full", "diag"), seed: int = 42) -> Fitted | None:
    """All models over (v, n) points, each an array of ``dim`` numbers; None without a point."""

    def spread(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.concatenate([[w.sum()], w @ x]) for x, w in arrays(batch, dim, np.zeros(dim)))

    tasks = max(1, min(points.rdd.getNumPartitions(), math.ceil(points.count() / TASK)))
    points = points.coalesce(tasks)
    total = sums.added(points, spread, 1 + dim, tasks)
    if not total[0]:
        return None
    rows, origin = total[0], total[1:] / total[0]

    def squares(batch: pa.RecordBatch) -> np.ndarray:
        return sum(np.array([w @ np.square(x).sum(axis=1)]) for x, w in arrays(batch, dim, origin))

    variance = float(sums.added(points, squares, 1, tasks)[0]) / rows / dim
    some = points.orderBy(F.xxhash64("v"), "v").limit(SEEDS).collect()
    x, w = np.array([r["v"] for r in some]) - origin, np.array([r["n"] for r in some], float)
    out = Fitted(origin, rows)
    needed = sorted({*ks, *sizes})
    centres = {k: Centres(first_centres(x, w, k, seed)) for k in needed}
    waiting = {(k, kind) for k in sizes for kind in kinds}
    while True:
        for k, kind in sorted(waiting):
            if not centres[k].moving:
                out.mixtures[k, kind] = Mixture.around(centres[k], kind)
                waiting.discard((k, kind))
        moving = [m for m in (*centres.values(), *out.mixtures.values()) if m.moving]
        if not moving:
            break

        def step(batch: pa.RecordBatch, moving=moving) -> np.ndarray:
            return sum(np.concatenate([m.part(x, w) for m in moving]) for x, w in arrays(batch, dim, origin))

        edges = np.cumsum([0, *(m.size for m in moving)])
        total = sums.added(points, step, int(edges[-1]), tasks)
        out.passes += 1
        for m, a, b in zip(moving, edges[:-1], edges[1:], strict=True):
            m.take(total[a:b], variance if isinstance(m, Centres) else rows)
    out.kmeans = {k: centres[k] for k in ks}
    _judge(points, dim, out, tasks)
    return out


def _judge(points: DataFrame, dim: int, out: Fitted, tasks: int) -> None:
    """Cost and silhouette, by squared distances, of each k-means: sums of the clusters, then each point's means."""
    models = list(out.kmeans.values())
    edges = np.cumsum([0, *(m.k * (2 + dim) for m in models)])

    def clusters(batch: pa.RecordBatch) -> np.ndarray:
        total = np.zeros(edges[-1])
        for x, w in arrays(batch, dim, out.origin):
            size = (x * x).sum(axis=1)
            for m, a, b in zip(models, edges[:-1], edges[1:], strict=True):
                member = np.zeros((len(x), m.k))
                member[np.arange(len(x)), m.predict(x)] = w
                total[a:b] += np.concatenate([member.sum(axis=0), member.T @ size, (member.T @ x).ravel()])
        return total

    total = sums.added(points, clusters, int(edges[-1]), tasks)
    known = [(t[: m.k], t[m.k : 2 * m.k], t[2 * m.k :].reshape(m.k, dim)) for m, t in ((m, total[a:b]) for m, a, b in zip(models, edges[:-1], edges[1:], strict=True))]

    def scores(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros((len(models), 2))
        for x, w in arrays(batch, dim, out.origin):
            for i, (m, (n, squares, middle)) in enumerate(zip(models, known, strict=True)):
                gap = gaps(x, m.centres)
                own = gap.argmin(axis=1)
                found[i, 1] += (gap.min(axis=1) * w).sum()
                all_ = (x * x).sum(axis=1)[:, None] * n - 2 * x @ middle.T + squares
                at = np.arange(len(x)), own
                inner = all_[at] / np.maximum(n[own] - 1, 1)
                mean = np.where(n > 0, all_ / np.maximum(n, 1), np.inf)
                mean[at] = np.inf
                outer = mean.min(axis=1)
                top = np.maximum(inner, outer)
                s = np.where((n[own] > 1) & (top > 0) & np.isfinite(outer), (outer - inner) / np.where(top > 0, top, 1), 0.0)
                found[i, 0] += (s * w).sum()
        return found.ravel()

    for m, (s, cost) in zip(models, sums.added(points, scores, 2 * len(models), tasks).reshape(-1, 2), strict=True):
        m.cost, m.silhouette = float(cost), float(s / out.rows) if m.k > 1 else -1.0
