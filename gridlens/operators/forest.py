"""Isolation forest: trees grow in grouped tasks on small samples, and score rows in batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, exp, lgamma, log, log1p, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridlens.config import DEFAULTS, Settings
from gridlens.operators.binning import flat
from gridlens.session import share

SAMPLE = 256
SPARE = 1.5  # rows drawn per tree for each row it keeps
NODES = "tree INT, node INT, feature INT, border DOUBLE, below INT, above INT, length DOUBLE"
BLOCK = 2_000  # rows scored at once


def typical_length(n):
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, seed: int, depth: int) -> list[tuple]:
    """Nodes of one tree as (node, feature, border, below, above, length); leaves have feature -1."""
    rng = np.random.default_rng(seed)
    nodes: list[tuple] = []
    pending = [(0, np.arange(len(x)), 0)]
    count = 1
    while pending:
        node, rows, level = pending.pop()
        part = x[rows]
        varied = np.flatnonzero(part.max(axis=0) > part.min(axis=0)) if len(rows) > 1 else []
        if level >= depth or len(varied) == 0:
            nodes.append((node, -1, 0.0, node, node, level + float(typical_length(len(rows)))))
            continue
        feature = int(rng.choice(varied))
        values = part[:, feature]
        border = float(rng.uniform(values.min(), values.max()))
        under = values <= border
        nodes.append((node, feature, border, count, count + 1, 0.0))
        pending += [(count, rows[under], level + 1), (count + 1, rows[~under], level + 1)]
        count += 2
    return nodes


@dataclass
class IsolationForest:
    """Grown trees as flat node arrays, and the score that separates anomalies."""

    names: list[str]
    sample: int
    roots: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    below: np.ndarray
    above: np.ndarray
    length: np.ndarray
    offset: float = -0.5

    @property
    def depth(self) -> int:
        return max(1, ceil(log2(max(self.sample, 2))))

    @classmethod
    def from_nodes(cls, nodes: pd.DataFrame, names: Sequence[str], sample: int) -> IsolationForest:
        """A forest from rows (tree, node, feature, border, below, above, length), whose leaves lead to themselves."""
        nodes, starts = flat(nodes.sort_values(["tree", "node"], ignore_index=True))
        columns = {c: nodes[c].to_numpy() for c in ("feature", "border", "below", "above", "length")}
        return cls(names=list(names), sample=sample, roots=starts, **columns)

    def raw_scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from -1 (isolated at once) to 0."""
        out = np.empty(len(x))
        for start in range(0, len(x), BLOCK):
            part = x[start : start + BLOCK]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.depth):
                under = part[row, self.feature[at]] <= self.border[at]
                at = np.where(under, self.below[at], self.above[at])
            out[start : start + BLOCK] = -np.exp2(-self.length[at].mean(axis=1) / max(float(typical_length(self.sample)), 1e-9))
        return out

    def decide(self, df: DataFrame) -> DataFrame:
        """Add ``decision``, which is negative for anomalies."""
        names, shared = self.names, share(df.sparkSession, self)  # trees and sample bound its size
        schema = T.StructType(df.schema.fields + [T.StructField("decision", T.DoubleType())])

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                forest = shared()
                yield batch.assign(decision=forest.raw_scores(batch[names].to_numpy(float)) - forest.offset)

        return df.mapInPandas(score, schema)

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {c: [getattr(self, c).tolist()] for c in ("roots", "feature", "border", "below", "above", "length")}
        row = pd.DataFrame({"names": [self.names], "sample": [self.sample], "offset": [self.offset], **arrays})
        schema = (
            "names array<string>, sample int, offset double, roots array<int>, feature array<int>, border array<double>,"
            "below array<int>, above array<int>, length array<double>"
        )
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> IsolationForest:
        row = spark.read.parquet(path).first().asDict()
        arrays = {c: np.array(row[c]) for c in ("roots", "feature", "border", "below", "above", "length")}
        return cls(names=list(row["names"]), sample=row["sample"], offset=row["offset"], **arrays)


def _share(*parts) -> Column:
    """A reproducible number from 0 to 1 for the given columns."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / F.lit(float(1 << 40))


def draws_at_least(trees: int, p: float) -> list[float]:
    """For 1, 2, ... the probability that at least so many of ``trees`` draw a row, each with probability ``p``; ends below a draw's precision."""
    if p >= 1:
        return [1.0] * trees
    k = range(trees + 1)
    exact = [exp(lgamma(trees + 1) - lgamma(n + 1) - lgamma(trees - n + 1) + n * log(p) + (trees - n) * log1p(-p)) for n in k]
    tails = np.cumsum(exact[:0:-1])[::-1]
    return [float(t) for t in tails if t > 2.0**-40]


def tree_samples(df: DataFrame, rows: int, trees: int, sample: int, seed: int, key: Sequence[str]) -> DataFrame:
    """Up to ``sample`` random rows for each tree, as ``tree`` next to the columns of ``df``.

    Every tree draws from all rows. One hash per row tells how many trees draw it, most often none; only for
    the others further hashes tell which trees.
    """
    tails = draws_at_least(trees, min(1.0, sample * SPARE / rows))
    times = F.size(F.filter(F.array(*[F.lit(t) for t in tails]), lambda t: F.col("_draw") < t))
    order = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64(*key, t, F.lit(seed + 1)), t.alias("tree")))
    drawn = df.withColumn("_draw", _share(*key, F.lit(seed))).filter(F.col("_draw") < tails[0]) if tails else df.withColumn("_draw", F.lit(1.0)).limit(0)
    drawn = drawn.withColumn("tree", F.explode(F.slice(F.array_sort(order), 1, times))).withColumn("tree", F.col("tree.tree"))
    drawn = drawn.withColumn("_draw", _share(*key, "tree", F.lit(seed)))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_draw", *key))
    return drawn.withColumn("_rank", rank).filter(F.col("_rank") <= sample).drop("_draw", "_rank")


def fit_isolation_forest(
    df: DataFrame,
    names: Sequence[str],
    trees: int | None = None,
    settings: Settings = DEFAULTS,
    seed: int = 42,
    key: Sequence[str] = ("device_id", "seq"),
) -> IsolationForest:
    """Grow the forest on ``names`` and place its border so that the contamination share is anomalous."""
    trees = trees or settings.trees
    names = list(names)
    rows = df.count()
    sample = min(SAMPLE, rows)
    depth = max(1, ceil(log2(max(sample, 2))))

    def grow_tree(group: pd.DataFrame) -> pd.DataFrame:
        tree = int(group["tree"].iloc[0])
        x = group.sort_values(list(key))[names].to_numpy(float)
        found = pd.DataFrame(grow(x, seed * 100_003 + tree, depth), columns=["node", "feature", "border", "below", "above", "length"])
        return found.assign(tree=tree)[["tree", "node", "feature", "border", "below", "above", "length"]]

    drawn = tree_samples(df.select(*key, *names), rows, trees, sample, seed, key)
    # At most trees * (2 * sample - 1) small rows, whatever the size of the table.
    nodes = drawn.groupBy("tree").applyInPandas(grow_tree, NODES).toPandas()
    forest = IsolationForest.from_nodes(nodes, names, sample)
    forest.offset = 0.0
    scored = forest.decide(df.select(*names))
    forest.offset = scored.agg(F.percentile_approx("decision", settings.contamination, 10_000)).first()[0]
    return forest


def detector_metrics(scored: DataFrame) -> DataFrame:
    """Size, anomalies and scores of a scored training table."""
    bad = F.count(F.when(F.col("decision") < 0, 1))
    return scored.agg(
        F.count(F.lit(1)).alias("total_samples"),
        bad.alias("anomalies_found"),
        (bad / F.count(F.lit(1))).alias("anomaly_rate"),
        F.avg("decision").alias("score_mean"),
        F.stddev_pop("decision").alias("score_std"),
    )
