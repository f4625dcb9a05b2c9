"""How reliable features are: dependence, roles, residuals, cards."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators.sampling import shuffled
from trailmark.operators.stats import quantiles, running

FOLDS, LEAST_ROWS = 5, 50


class Tree:
    """A regression tree on several targets: best split by summed squared error, down to ``least`` rows."""

    def __init__(self, depth: int = 6, least: int = 5):
        self.depth, self.least = depth, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Tree:
        self.root = self._grow(x, y, self.depth)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        mean, best = y.mean(axis=0), None
        if depth and len(y) >= 2 * self.least:
            error = ((y - mean) ** 2).sum() - 1e-12
            for c in range(x.shape[1]):
                order = np.argsort(x[:, c], kind="stable")
                xs, ys = x[order, c], y[order]
                n = np.arange(1, len(ys))
                s, q = np.cumsum(ys, axis=0)[:-1], np.cumsum(ys**2, axis=0)[:-1]
                left = (q - s**2 / n[:, None]).sum(axis=1)
                rest = len(ys) - n
                right = ((ys**2).sum(axis=0) - q - (ys.sum(axis=0) - s) ** 2 / rest[:, None]).sum(axis=1)
                total = np.where((xs[1:] > xs[:-1]) & (n >= self.least) & (rest >= self.least), left + right, np.inf)
                at = int(total.argmin())
                if total[at] < error:
                    error, best = total[at], (c, (xs[at] + xs[at + 1]) / 2)
        if best is None:
            return mean
        c, cut = best
        go = x[:, c] <= cut
        return c, cut, self._grow(x[go], y[go], depth - 1), self._grow(x[~go], y[~go], depth - 1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        def at(node, rows: np.ndarray) -> np.ndarray:
            if isinstance(node, tuple):
                out = np.empty((len(rows), self.width))
                go = rows[:, node[0]] <= node[1]
                out[go], out[~go] = at(node[2], rows[go]), at(node[3], rows[~go])
                return out
            return np.repeat(node[None, :], len(rows), axis=0)

        node = self.root
        while isinstance(node, tuple):
            node = node[2]
        self.width = len(node)
        return at(self.root, x)


def folded_prediction(x: np.ndarray, y: np.ndarray, seed: int = 0) -> np.ndarray:
    """Each row predicted by a tree fitted on the other folds."""
    fold = np.random.default_rng(seed).permutation(len(x)) % FOLDS
    out = np.empty_like(y, dtype=float)
    for f in range(FOLDS):
        out[fold == f] = Tree().fit(x[fold != f], y[fold != f]).predict(x[fold == f])
    return out


def dependence(x: np.ndarray, y: np.ndarray, seed: int = 0) -> float:
    """The share of y's variance that x explains out of fold, columns weighed by variance, between 0 and 1."""
    total = y.var(axis=0).sum()
    if len(x) < LEAST_ROWS or total < 1e-12:
        return 0.0
    left = ((y - folded_prediction(x, y, seed)) ** 2).mean(axis=0).sum()
    return float(min(1.0, max(0.0, 1 - left / total)))


def dependences(reference: DataFrame, blocks: dict[str, list[str]]) -> DataFrame:
    """N15 for every ordered pair of features: x, y, r.  ``reference`` is the evaluation set (N13), bounded by its size.

    Pairs are dealt to tasks; the set goes with each, so trees are fitted in parallel.
    """
    rows = reference.select(*[F.col(c).cast("double") for b in blocks.values() for c in b]).toPandas().fillna(0.0)
    spark = reference.sparkSession
    names = list(blocks)
    pairs = spark.range(len(names) ** 2, numPartitions=min(64, len(names) ** 2)).filter(F.col("id") % len(names) != F.floor(F.col("id") / len(names)))

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf.id:
                x, y = names[i // len(names)], names[i % len(names)]
                out.append((x, y, dependence(rows[blocks[x]].to_numpy(), rows[blocks[y]].to_numpy())))
            yield pd.DataFrame(out, columns=["x", "y", "r"])

    return pairs.mapInPandas(run, "x string, y string, r double")


def evaluation_set(df: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """``n`` trajectories by keyed order (the size of the set is the parameter)."""
    return df.orderBy(shuffled(seed=seed), "key").limit(n)


def roles(figures: dict[str, dict[str, float]], r: dict[tuple[str, str], float], context: set[str] = frozenset(), noise_max: float = 0.1, dependence_max: float = 0.9) -> dict[str, str]:
    """Context, invariant, dependent or distinguishing, in order; a feature depends only on ones kept before it.

    ``figures``: feature -> {"varying": share, "noise": mean disagreement}.
    """
    out: dict[str, str] = {}
    kept: list[str] = []
    for name, f in figures.items():
        if name in context:
            out[name] = "context"
        elif f["varying"] == 0 or f["noise"] >= f["varying"]:
            out[name] = "invariant"
        elif any(r.get((k, name), 0.0) >= dependence_max for k in kept):
            out[name] = "dependent"
        else:
            out[name] = "distinguishing"
            kept.append(name)
    return out


def decisions(role: dict[str, str], noise: dict[str, float], labels: dict[str, int], noise_max: float = 0.1, label_limit: int = 100) -> dict[str, str]:
    """Keep, revise (too noisy or without information) or labels (too many free labels)."""
    return {n: "labels" if labels.get(n, 0) > label_limit else "revise" if noise.get(n, 0.0) > noise_max or r == "invariant" else "keep" for n, r in role.items()}


def tail_counts(df: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """Key, at_least: how many reference values are as high, by running counts over distinct values."""
    counts = reference.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    values = df.filter(F.col(column).isNotNull()).select(F.col(column).alias("v")).distinct().withColumn("n", F.lit(0).cast("long"))
    merged = counts.unionByName(values).groupBy("v").agg(F.sum("n").alias("n"))
    total = merged.agg(F.sum("n")).first()[0] or 0
    tails = running(merged, [], "v", ["n"]).select("v", (F.lit(total) - F.col("n_upto") + F.col("n")).cast("long").alias("at_least"))
    return df.join(tails, df[column] == tails["v"]).select("key", "at_least")


def median_labels(df: DataFrame, column: str, above: str = "failure", below: str = "other") -> DataFrame:
    """Rows above the median."""
    cut = quantiles(df, [], column, {"cut": 0.5}).first()["cut"]
    return df.withColumn("label", F.when(F.col(column) > cut, above).otherwise(below))


def top_share_lift(df: DataFrame, rank: str, label: str, share: float = 0.1) -> DataFrame:
    """How much more frequent a label is among the first share of the ranks."""
    n = df.count()
    first = F.col(rank) <= max(1, int(share * n))
    return df.agg((F.avg(F.when(first, F.col(label).cast("double"))) / F.avg(F.col(label).cast("double"))).alias("lift"), F.count_if(first).alias("rows"))
