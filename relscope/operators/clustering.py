"""Cluster labels as features: k-means and Gaussian mixtures fitted side by side, density clusters on a bounded sample."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import mixtures

#: Distinct rows that density clusters are fitted on, weighted with their counts; others take their nearest member's label.
SAMPLE = 1500


@dataclass
class Density:
    """Members of density clusters with their labels and core distances, and how near a row must come to join a cluster."""

    members: np.ndarray
    labels: np.ndarray
    core: np.ndarray
    #: The distance at which each cluster came into being.
    reach: np.ndarray
    min_cluster_size: int
    min_samples: int
    silhouette: float = -1.0

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The label of the nearest member by mutual reachability, -1 where that is wider than its cluster; a row has its nearest member's core distance."""
        gap = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (self.members**2).sum(1)[None] - 2 * x @ self.members.T))
        near = gap.argmin(1)
        apart = np.maximum(gap[np.arange(len(x)), near], self.core[near])
        own = self.labels[near]
        return np.where((own >= 0) & (apart <= np.append(self.reach, -1.0)[own]), own, -1)


def _distances(x: np.ndarray) -> np.ndarray:
    out = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T))
    np.fill_diagonal(out, 0.0)
    return out


def _spanning_tree(reach: np.ndarray) -> list[tuple[float, int, int]]:
    """Edges (distance, a, b) of a minimum spanning tree, nearest first."""
    n = len(reach)
    best, parent, left = reach[0].copy(), np.zeros(n, int), np.ones(n, bool)
    left[0] = False
    links = []
    for _ in range(n - 1):
        b = int(np.where(left, best, np.inf).argmin())
        links.append((float(best[b]), int(parent[b]), b))
        left[b] = False
        closer = left & (reach[b] < best)
        best[closer], parent[closer] = reach[b][closer], b
    return sorted(links)


def _hierarchy(links: list[tuple[float, int, int]], weight: np.ndarray) -> tuple[dict[int, tuple[float, int, int]], list[int]]:
    """Merges (distance, left, right) by node, those of rows being 0 to n - 1, and the weight under each node; the last node is the root."""
    top, size, merges = {i: i for i in range(len(weight))}, weight.tolist(), {}
    up = list(range(len(weight)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for w, a, b in links:
        a, b = root(a), root(b)
        merges[len(size)] = (w, top[a], top[b])
        up[b] = a
        size.append(size[top[a]] + size[top[b]])
        top[a] = len(size) - 1
    return merges, size


def density_clusters(x: np.ndarray, min_cluster_size: int, min_samples: int, weight: np.ndarray | None = None, d: np.ndarray | None = None) -> Density:
    """Clusters of most stability in the hierarchy of mutual reachability.

    The hierarchy is condensed: a split counts where both sides have ``min_cluster_size``
    rows, otherwise the smaller side leaves its cluster.  A cluster's stability adds up, over
    its rows, how much density (one over the distance) they stay for; a cluster is chosen over
    those it splits into unless theirs add up to more.  All rows together are no cluster.
    ``weight`` tells how many equal rows each stands for: they count as neighbours and
    towards sizes.  Equal rows have the highest density found at a distance above 0.
    """
    n = len(x)
    weight = np.ones(n, np.int64) if weight is None else weight
    d = _distances(x) if d is None else d
    order = np.argsort(d, axis=1, kind="stable")
    enough = np.minimum((np.cumsum(weight[order], axis=1) <= min_samples).sum(axis=1), n - 1)
    core = np.take_along_axis(d, np.take_along_axis(order, enough[:, None], axis=1), axis=1)[:, 0]
    links = _spanning_tree(np.maximum(np.maximum(core[:, None], core[None]), d))
    merges, size = _hierarchy(links, weight)
    least = min((w for w, *_ in links if w > 0), default=1.0)
    dense = lambda w: 1 / max(w, least)
    born, above, stable, place = [0.0], [-1], [0.0], np.zeros(n, int)
    ahead = [(len(size) - 1, 0)]
    while ahead:
        node, own = ahead.pop()
        if node < n:
            stable[own] += size[node] * (1 / least - born[own])
            place[node] = own
            continue
        w, *sides = merges[node]
        large = [s for s in sides if size[s] >= min_cluster_size]
        gone = sides if len(large) == 2 else [s for s in sides if s not in large]
        stable[own] += sum(size[s] for s in gone) * (dense(w) - born[own])
        if len(large) == 2:
            for s in sides:
                born.append(dense(w))
                above.append(own)
                stable.append(0.0)
                ahead.append((s, len(born) - 1))
            continue
        ahead += [(s, own) for s in large]
        while gone:
            s = gone.pop()
            if s < n:
                place[s] = own
            else:
                gone += merges[s][1:]
    below = [0.0] * len(born)
    chosen = [False] * len(born)
    for c in range(len(born) - 1, 0, -1):
        chosen[c] = stable[c] >= below[c]
        below[above[c]] += max(stable[c], below[c])
    # Parents come before their children, so the outermost choice wins.
    label, names = [-1] * len(born), []
    for c in range(1, len(born)):
        label[c] = label[above[c]]
        if label[c] < 0 and chosen[c]:
            label[c] = len(names)
            names.append(c)
    return Density(x, np.array(label)[place], core, np.array([1 / born[c] for c in names]), min_cluster_size, min_samples)


def silhouette(d: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> float:
    """Of the rows in clusters, by distances ``d``; -1 for fewer than two clusters or three rows."""
    own = labels >= 0
    if labels.max(initial=-1) < 1 or weight[own].sum() < 3:
        return -1.0
    d, labels, weight = d[np.ix_(own, own)], labels[own], weight[own]
    member = (labels[:, None] == np.arange(labels.max() + 1)) * weight[:, None]
    total, far = member.sum(axis=0), d @ member
    at = np.arange(len(d)), labels
    inner = far[at] / np.maximum(1, total[labels] - 1)
    far = far / total
    far[at] = np.inf
    outer = far.min(axis=1)
    s = np.where(total[labels] > 1, (outer - inner) / np.maximum(np.maximum(inner, outer), 1e-300), 0.0)
    return float((s * weight).sum() / weight.sum())


@dataclass
class ClusterFeatures:
    """Fits up to three clusterings on named columns and adds their labels; rows with a null, NaN or infinity there go."""

    seed: int = 42
    columns: list[str] = field(default_factory=list)
    origin: np.ndarray | None = None
    kmeans: mixtures.Centres | None = None
    mixture: mixtures.Mixture | None = None
    density: Density | None = None
    scores: dict[str, list[dict]] = field(default_factory=dict)

    def vectors(self, df: DataFrame) -> DataFrame:
        """Adds ``features`` from the fitted columns; other columns may be there, a missing one raises."""
        missing = [c for c in self.columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing columns: {missing}")
        out = df.withColumn("features", F.array(*(F.col(c).cast("double") for c in self.columns)))
        return out.where(F.forall("features", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))

    def choose_models(self, points: DataFrame, kmeans_ks, mixture_ks, kinds) -> None:
        """k-means of the highest silhouette, then the lowest cost; the mixture of the lowest BIC, then AIC."""
        found = mixtures.fit(points, len(self.columns), kmeans_ks, mixture_ks, kinds, self.seed)
        if found is None:
            raise ValueError("no row to fit")
        self.origin = found.origin
        by_score = sorted(found.kmeans.items(), key=lambda m: (-m[1].silhouette, m[1].cost, m[0]))
        self.scores["kmeans"] = [{"k": k, "silhouette": m.silhouette, "cost": m.cost} for k, m in by_score]
        by_fit = sorted(found.mixtures.items(), key=lambda m: (found.bic(m[1]), found.aic(m[1]), m[0]))
        self.scores["mixture"] = [{"k": k, "kind": kind, "bic": found.bic(m), "aic": found.aic(m)} for (k, kind), m in by_fit]
        self.kmeans, self.mixture = by_score[0][1], by_fit[0][1]

    def choose_density(self, points: DataFrame, sizes=(20, 40, 60), samples=(5, 10, 15)) -> Density | None:
        """The highest silhouette of rows in clusters, then the least noise, then the most clusters."""
        # Equal rows are one, with their count, so that none of them fills the sample.
        picked = points.orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()
        rows, weight = np.array([r["v"] for r in picked]), np.array([r["n"] for r in picked])
        if len(rows) < 3:
            return None
        d, found = _distances(rows), []
        for a in sizes:
            for b in samples:
                model = density_clusters(rows, a, b, weight, d)
                model.silhouette = silhouette(d, model.labels, weight)
                noise = float(weight[model.labels < 0].sum() / weight.sum())
                found.append((-model.silhouette, noise, -len(model.reach), a, b, model))
        found.sort(key=lambda f: f[:3])
        self.scores["density"] = [{"min_cluster_size": a, "min_samples": b, "silhouette": -s, "noise": o, "clusters": -k} for s, o, k, a, b, _ in found]
        return found[0][-1]

    def fit(self, df: DataFrame, columns: list[str], kmeans_ks=range(2, 13), mixture_ks=range(2, 13), density: bool = True, kinds=("full", "diag")) -> ClusterFeatures:
        self.columns = list(columns)
        points = mixtures.points_of(self.vectors(df), "features").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self.choose_models(points, kmeans_ks, mixture_ks, kinds)
            self.density = self.choose_density(points) if density else None
        finally:
            points.unpersist()
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds kmeans_cluster, gmm_cluster and density_cluster; rows in no density cluster share one number past the last, 1 where there is none."""
        if self.kmeans is None:
            raise RuntimeError("fit first")
        kmeans, mixture, density, origin = self.kmeans, self.mixture, self.density, self.origin
        names = self.feature_names()

        @F.pandas_udf(", ".join(f"{n} int" for n in names))
        def label(v: pd.Series) -> pd.DataFrame:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, len(origin)))
            out = [kmeans.predict(x - origin), mixture.predict(x - origin)]
            if density is not None:
                own = density.predict(x)
                out.append(np.where(own < 0, max(density.labels.max(), 0) + 1, own))
            return pd.DataFrame({n: c.astype("int32") for n, c in zip(names, out, strict=True)})

        out = self.vectors(df).withColumn("_labels", label("features"))
        return out.select(*df.columns, *(F.col(f"_labels.{n}").alias(n) for n in names))

    def feature_names(self) -> list[str]:
        return ["kmeans_cluster", "gmm_cluster", *(["density_cluster"] if self.density is not None else [])]

    def save(self, spark: SparkSession, path: str) -> None:
        """To a folder of any store that Spark writes."""
        d, m = self.density, self.mixture
        about = {
            "seed": self.seed,
            "columns": self.columns,
            "origin": self.origin.tolist(),
            "kmeans": self.kmeans.centres.tolist(),
            "mixture": {"weights": m.weights.tolist(), "means": m.means.tolist(), "covariances": m.covariances.tolist(), "kind": m.kind},
            "density": d and {"members": d.members.tolist(), "labels": d.labels.tolist(), "core": d.core.tolist(), "reach": d.reach.tolist(), "min_cluster_size": d.min_cluster_size, "min_samples": d.min_samples, "silhouette": d.silhouette},
        }
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterFeatures:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        d, m = about["density"], about["mixture"]
        density = d and Density(np.array(d["members"]), np.array(d["labels"], int), np.array(d["core"]), np.array(d["reach"]), d["min_cluster_size"], d["min_samples"], d["silhouette"])
        mixture = mixtures.Mixture(np.array(m["weights"]), np.array(m["means"]), np.array(m["covariances"]), m["kind"])
        return cls(about["seed"], about["columns"], np.array(about["origin"]), mixtures.Centres(np.array(about["kmeans"])), mixture, density)
