"""Random forests: every tree grows in a grouped task on its own bootstrap sample of bin codes.

A hash of row, tree and seed says how often a tree draws a row, as in drawing with replacement: a tree holds about as many draws as there are training rows, and
``settings.tree_rows`` at most, so a task's memory is bounded whatever the table. Trees of all folds of a cross-validation grow in one pass; a row's fold is
a hash too, and since neither draw looks at the fold, a fold's forest is the one that a fit on the rows outside it would give. A row is shuffled once for each
tree that draws it; the task of a tree grows it for every fold. Grown trees are written, and the driver holds the forest of one fold at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from math import exp

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, FAULT_NAMES, Settings
from gridlens.operators.binning import BINS, Borders, coded_rows, flat, mixed
from gridlens.operators.forest import draws_at_least
from gridlens.session import discard, materialize, share

NODES_AT_ONCE = 256  # nodes whose histograms a task holds together
TREES_AT_ONCE = 20  # trees the driver fetches together
SCORED_ROWS = 2_000
#: A tree's nodes as packed arrays, in the order of their numbers.
ARRAYS = {"feature": "<i4", "bin": "<i4", "below": "<i8", "above": "<i8", "gain": "<f8", "shares": "<f4"}
SAVED = {"feature": np.int32, "border": float, "below": np.int32, "above": np.int32, "gain": float}
NODES_AT_A_TIME = 100_000  # nodes of a saved forest written or read together
TREES = f"fold int, tree int, {', '.join(f'{c} binary' for c in ARRAYS)}"


def split_nodes(codes: np.ndarray, true: np.ndarray, weight: np.ndarray, slot: np.ndarray, choice: np.ndarray, labels: int, bins: int, rows: np.ndarray | None = None) -> tuple:
    """Best split of each node over its chosen features: feature, bin, and the decrease of weighted impurity (-inf without one).

    ``codes`` has a row per feature, and a column per row or those named by ``rows``; ``slot`` is the node of each row and ``choice`` the features of each node.
    """
    nodes, tried = choice.shape
    row = np.arange(len(slot)) if rows is None else rows
    table, first = np.empty((nodes, tried, bins, labels)), slot * (bins * labels) + true
    for k in range(tried):
        place = first + codes[choice[:, k][slot], row] * np.int64(labels)
        table[:, k] = np.bincount(place, weight, nodes * bins * labels).reshape(nodes, bins, labels)
    upto = table.cumsum(axis=2)
    left, whole = upto[:, :, :-1], upto[:, :, -1:]
    right = whole - left
    n_left, n_right, n = left.sum(axis=3), right.sum(axis=3), whole.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = (left**2).sum(axis=3) / n_left + (right**2).sum(axis=3) / n_right - (whole**2).sum(axis=3) / n
    purity = np.where((n_left > 1e-9) & (n_right > 1e-9), purity, -np.inf).reshape(nodes, -1)
    best = purity.argmax(axis=1)
    feature, bin = np.divmod(best, bins - 1)
    return choice[np.arange(nodes), feature], bin, purity[np.arange(nodes), best]


def grow(codes: np.ndarray, true: np.ndarray, weight: np.ndarray, labels: int, depth: int, tried: int, seed: int, bins: int) -> list[tuple]:
    """Nodes of a tree as (node, feature, bin, below, above, gain, shares); a leaf leads to itself."""
    rng = np.random.default_rng(seed)
    features = len(codes)
    nodes: list[tuple] = []
    at, frontier, count = np.zeros(len(true), np.int64), [0], 1
    for level in range(depth + 1):
        if not frontier:
            break
        slots = np.full(count, -1)
        slots[frontier] = np.arange(len(frontier))
        held = np.flatnonzero(slots[at] >= 0)
        held = held[np.argsort(slots[at[held]], kind="stable")]
        slot = slots[at[held]]
        sums = np.bincount(slot * labels + true[held], weight[held], len(frontier) * labels).reshape(-1, labels)
        shares = sums / sums.sum(axis=1, keepdims=True)
        open_ = (shares.max(axis=1) < 1 - 1e-12) & (level < depth)
        found_feature, found_bin = np.zeros(len(frontier), int), np.full(len(frontier), 255)
        gain = np.full(len(frontier), -np.inf)
        draws = rng.random((len(frontier), features)).argpartition(tried - 1, axis=1)[:, :tried] if tried < features else np.tile(np.arange(features), (len(frontier), 1))
        starts = np.searchsorted(slot, np.arange(len(frontier) + 1))
        # Where none of a node's features divides its rows, all are tried.
        for choice in (draws, np.arange(features)[None, :].repeat(len(frontier), axis=0)):
            todo = np.flatnonzero(open_ & ~np.isfinite(gain))
            step = max(NODES_AT_ONCE * tried // choice.shape[1], 1)
            for start in range(0, len(todo), step):
                part = todo[start : start + step]
                local = np.full(len(frontier), -1)
                local[part] = np.arange(len(part))
                near = slice(starts[part[0]], starts[part[-1] + 1])  # rows lie in the order of their nodes
                own = local[slot[near]]
                rows, own = held[near][own >= 0], own[own >= 0]
                found_feature[part], found_bin[part], gain[part] = split_nodes(codes, true[rows], weight[rows], own, choice[part], labels, bins, rows)
        below = np.arange(count)
        above = below.copy()
        following = []
        for k, node in enumerate(frontier):
            if np.isfinite(gain[k]):
                below[node], above[node] = count, count + 1
                following += [count, count + 1]
                nodes.append((node, int(found_feature[k]), int(found_bin[k]), count, count + 1, float(max(gain[k], 0.0)), shares[k]))
                count += 2
            else:
                nodes.append((node, 0, 255, node, node, 0.0, shares[k]))
        under = codes[found_feature[slot], held] <= found_bin[slot]
        at[held] = np.where(under, below[at[held]], above[at[held]])
        frontier = following
    return nodes


@dataclass
class Bagged:
    """A forest as flat node arrays over plain feature values."""

    names: list[str]
    roots: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    below: np.ndarray
    above: np.ndarray
    gain: np.ndarray
    shares: np.ndarray  # of all labels, a row per node
    levels: int

    @classmethod
    def from_trees(cls, trees: DataFrame, borders: Borders, levels: int) -> Bagged:
        """A forest from a row of packed arrays (``TREES``) per tree."""
        numbers = sorted(r[0] for r in trees.select("tree").collect())  # a row per tree
        parts: dict[str, list[np.ndarray]] = {c: [] for c in ARRAYS}
        for at in range(0, len(numbers), TREES_AT_ONCE):
            # The model itself: at most 2 ** (levels + 1) small nodes a tree.
            some = trees.where(F.col("tree").isin(numbers[at : at + TREES_AT_ONCE])).toArrow()
            for k in np.argsort(some.column("tree").to_numpy()).tolist():
                for c, kind in ARRAYS.items():
                    parts[c].append(np.frombuffer(some.column(c)[k].as_py(), kind))
        sizes = np.array([len(x) for x in parts["feature"]], dtype=int)
        roots = np.cumsum(sizes) - sizes
        packed = {c: np.concatenate(parts.pop(c)) for c in ARRAYS}
        pa.default_memory_pool().release_unused()
        feature, bins, shift = packed["feature"], packed.pop("bin"), np.repeat(roots, sizes)
        border = np.where(bins < 255, borders.values[feature, np.minimum(bins, borders.values.shape[1] - 1)], np.inf)
        packed["below"] += shift
        packed["above"] += shift
        packed["shares"] = packed["shares"].reshape(len(feature), -1)
        return cls(names=list(borders.names), roots=roots, border=border, levels=levels, **packed)

    @classmethod
    def from_table(cls, nodes: pd.DataFrame, names: Sequence[str], levels: int) -> Bagged:
        """A forest from rows (tree, node, feature, border, below, above, gain, shares), whose leaves lead to themselves."""
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        nodes, starts = flat(nodes)
        columns = {c: nodes[c].to_numpy() for c in ("feature", "border", "below", "above", "gain")}
        return cls(names=list(names), roots=starts, shares=np.array(nodes["shares"].tolist()).reshape(len(nodes), -1), levels=levels, **columns)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row per row of ``x`` and a column per label id."""
        out = np.zeros((len(x), len(FAULT_NAMES)))
        for start in range(0, len(x), SCORED_ROWS):
            part = x[start : start + SCORED_ROWS]
            row = np.arange(len(part))
            for root in self.roots:
                at = np.full(len(part), root)
                for _ in range(self.levels):
                    at = np.where(part[row, self.feature[at]] <= self.border[at], self.below[at], self.above[at])
                out[start : start + SCORED_ROWS] += self.shares[at]
        return out / max(len(self.roots), 1)

    def importances(self) -> np.ndarray:
        """Share of the decrease of impurity by feature, each tree counting the same."""
        tree = np.searchsorted(self.roots, np.arange(len(self.feature)), side="right") - 1
        table = np.zeros((len(self.roots), len(self.names)))
        np.add.at(table, (tree, self.feature), self.gain)
        total = table.sum(axis=1, keepdims=True)
        found = np.divide(table, total, out=np.zeros_like(table), where=total > 0).mean(axis=0)
        return found / (found.sum() or 1.0)

    def save(self, spark: SparkSession, path: str) -> None:
        """Nodes are written a part at a time: a task cannot be sent all of them."""
        schema = "node int, feature int, border double, below int, above int, gain double, shares array<float>"
        for start in range(0, max(len(self.feature), 1), NODES_AT_A_TIME):
            part = slice(start, start + NODES_AT_A_TIME)
            shares = self.shares[part].astype(np.float32)
            size, labels = shares.shape
            columns = [pa.array(np.arange(start, start + size), pa.int32()), *(pa.array(getattr(self, c)[part].astype(kind)) for c, kind in SAVED.items())]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(size + 1) * labels, pa.int32()), pa.array(shares.ravel()))
            table = pa.Table.from_arrays([*columns, lists], ["node", *SAVED, "shares"])
            spark.createDataFrame(table, schema).coalesce(1).write.mode("append" if start else "overwrite").parquet(f"{path}/nodes")
        about = pd.DataFrame({"names": [self.names], "roots": [self.roots.tolist()], "levels": [self.levels]})
        spark.createDataFrame(about, "names array<string>, roots array<int>, levels int").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bagged:
        nodes, about = spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/about").first()
        parts: dict[str, list[np.ndarray]] = {c: [np.zeros(0, kind)] for c, kind in SAVED.items()} | {"shares": [np.zeros((0, len(FAULT_NAMES)), np.float32)]}
        for start in range(0, nodes.count(), NODES_AT_A_TIME):
            some = nodes.where(F.col("node").between(start, start + NODES_AT_A_TIME - 1)).toArrow()
            order = np.argsort(some.column("node").to_numpy())
            for c in SAVED:
                parts[c].append(some.column(c).to_numpy()[order])
            shares = pa.concat_arrays([chunk.flatten() for chunk in some.column("shares").chunks]).to_numpy()
            parts["shares"].append(shares.reshape(len(order), -1)[order])
        columns = {c: np.concatenate(parts.pop(c)) for c in [*SAVED, "shares"]}
        pa.default_memory_pool().release_unused()
        return cls(names=list(about["names"]), roots=np.array(about["roots"], dtype=int), levels=about["levels"], **columns)


def bags(rows: DataFrame, trees: int, rate: float, seed: int) -> DataFrame:
    """A row for each tree that draws a row at least once, as ``tree``; one hash per row tells how many do."""
    tails = draws_at_least(trees, 1 - exp(-rate))
    share = F.pmod(F.xxhash64("number", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    times = F.size(F.filter(F.array(*[F.lit(t) for t in tails]), lambda t: share < t))
    order = F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(F.xxhash64("number", t, F.lit(seed + 1)), t.alias("tree")))
    return rows.select("*", F.explode(F.slice(F.sort_array(order), 1, times)).alias("_drawn")).withColumn("tree", F.col("_drawn.tree")).drop("_drawn")


def times_drawn(numbers: np.ndarray, tree: int, rate: float, seed: int) -> np.ndarray:
    """How often a tree holds each row it has drawn: a Poisson number that is not zero."""
    share = mixed(numbers, seed + 7_919 * (tree + 1)) * (1 - exp(-rate))
    out, term, upto = np.ones(len(numbers)), rate * exp(-rate), rate * exp(-rate)
    for k in range(2, 30):
        out[share >= upto] = k
        term *= rate / k
        upto += term
    return out


def fold_of(folds: int, seed: int) -> Column:
    """A row's fold, by its number."""
    return F.pmod(F.xxhash64("number", F.lit(seed), F.lit("fold")), F.lit(folds)).cast("int")


class Forests(Mapping):
    """The forest of each fold, loaded when it is asked for."""

    def __init__(self, trees: DataFrame, borders: Borders, levels: int) -> None:
        self.trees, self.borders, self.levels = trees, borders, levels
        self.folds = sorted(r[0] for r in trees.select("fold").distinct().collect())  # a row per fold

    def __getitem__(self, fold: int) -> Bagged:
        if fold not in self.folds:
            raise KeyError(fold)
        return Bagged.from_trees(self.trees.where(F.col("fold") == fold), self.borders, self.levels)

    def __iter__(self) -> Iterator[int]:
        return iter(self.folds)

    def __len__(self) -> int:
        return len(self.folds)

    def discard(self) -> None:
        """Delete the trees; forests loaded before stay."""
        discard(self.trees)


def grow_forests(rows: DataFrame, borders: Borders, counts: dict[int, int], folds: int, trees: int, depth: int, settings: Settings, seed: int) -> Forests:
    """A forest for each fold over the rows outside it, or with ``folds`` 0 one over all rows.

    ``rows`` are coded; ``counts`` has the rows per label, which weigh the same in all.
    """
    total = sum(counts.values())
    kinds = len(FAULT_NAMES)
    weights = np.zeros(kinds)
    for k, n in counts.items():
        weights[k] = total / (len(counts) * n)
    rate = min(1.0, settings.tree_rows / max(total, 1))
    features, bins = len(borders.names), borders.values.shape[1] + 1
    tried = max(int(features**0.5), 1)

    def grow_tree(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        group = group.sort_values(["number", "label"], ignore_index=True)
        codes = np.frombuffer(b"".join(group["codes"]), np.uint8).reshape(len(group), features)
        true, numbers, own = (group[c].to_numpy() for c in ("label", "number", "own"))
        weight = times_drawn(numbers, tree, rate, seed) * weights[true]
        out = []
        for fold in range(folds) if folds else [0]:
            held = np.flatnonzero(own != fold)
            if len(held):
                found = grow(np.ascontiguousarray(codes[held].T), true[held], weight[held], kinds, depth, tried, seed * 100_003 + tree, bins)
                columns = dict(zip(["node", "feature", "bin", "below", "above", "gain", "shares"], zip(*found), strict=True))
                out.append({"fold": fold, "tree": tree, **{c: np.array(columns[c], dtype=kind).tobytes() for c, kind in ARRAYS.items()}})
        return pd.DataFrame(out, columns=["fold", "tree", *ARRAYS])

    drawn = bags(rows, trees, rate, seed).withColumn("own", fold_of(folds, seed) if folds else F.lit(-1))
    # As many partitions as trees, since a tree takes long and a few trees may meet in a partition.
    grown = drawn.repartition(trees, "tree").groupBy("tree").applyInPandas(grow_tree, TREES)
    return Forests(materialize(grown, "trees"), borders, depth)


def fit_random_forest(
    df: DataFrame,
    names: Sequence[str],
    label: str = "fault_label",
    trees: int | None = None,
    depth: int | None = None,
    settings: Settings = DEFAULTS,
    seed: int = 42,
    key: Sequence[str] = ("device_id", "seq"),
) -> Bagged:
    """Random forest with balanced labels over the labelled rows of ``df``, which ``key`` tells apart."""
    rows, borders, counts = prepared(df, names, label, key)
    forests = grow_forests(rows, borders, counts, 0, trees or settings.trees, depth or settings.tree_depth, settings, seed)
    empty = Bagged(list(names), *(np.zeros(0, int) for _ in range(5)), np.zeros(0), np.zeros((0, len(FAULT_NAMES))), 0)
    found = forests.get(0, empty)
    forests.discard()
    return found


def prepared(df: DataFrame, names: Sequence[str], label: str, key: Sequence[str]) -> tuple[DataFrame, Borders, dict[int, int]]:
    """Coded rows (written once), borders and rows per label."""
    borders = Borders.fit(df, names, BINS)
    rows = materialize(coded_rows(df, borders, label, key), "coded-rows")
    return rows, borders, {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # a row per label


def with_probabilities(df: DataFrame, models: dict[str, object]) -> DataFrame:
    """A column with the probabilities of all label ids for each named model, in one pass over the rows."""
    shared = share(df.sparkSession, models)  # trees and depth bound their size
    kinds = ", ".join(f"{name} array<double>" for name in models)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = {name: list(model.probabilities(batch[model.names].to_numpy(float))) for name, model in shared().items()}
            yield batch.assign(**found)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(score, f"{schema}, {kinds}")
