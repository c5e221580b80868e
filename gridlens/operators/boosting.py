"""Gradient boosting with softmax gradients, grown level by level from distributed histograms.

Training rows lie in blocks of bin codes. For each level of a round, every task walks its rows down the trees grown so far and adds up gradients and
curvatures by (label, node, feature, bin), for the trees of all labels together. The sums of all tasks, one table per label, are added and searched for the best
split of every node where they meet; only those splits, at most labels * 2^depth, reach the driver. Leaf values follow from the sums of their
parents' splits, so a round of depth d takes at most d passes. The scores of the rows are written with their blocks every ``KEPT_ROUNDS`` rounds, which
cuts the lineage; in between they are computed from the trees of the rounds since. Where the training rows are few enough for one task, its
sums are those of the table, and it goes on to the next level by itself: the trees are the same, with a pass for many rounds.

Between the two, up to ``SHARED_BYTES`` of codes, every Python worker holds all rows, and a round is one pass in which each label's tree grows in a task of
its own. Gradients and curvatures are rounded there to multiples of a power of two that add up without error. So the order of the rows does not
matter, and of two children only the smaller is summed up: the other has what is left of the parent.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.config import DEFAULTS, FAULT_NAMES, Settings
from gridlens.operators.binning import BINS, BLOCK_ROWS, Borders, coded_blocks, flat, mixed
from gridlens.operators.ordered import TASK_FLOOR
from gridlens.session import delete, scratch_path

RATE, SUBSAMPLE = 0.1, 0.8
PENALTY, LEAST_CURVATURE, LEAST_GAIN = 1.0, 1.0, 1e-6
KEPT_ROUNDS, LOCAL_ROUNDS = 5, 25
TRAINING_ROWS = 250_000  # rows per partition of training blocks
SHARED_BYTES = 128 << 20  # codes of a table that every worker may hold
SCORED_ROWS = 2_000  # rows scored at once
SPLIT = "label int, slot int, feature int, bin int, gain double, left_g double, left_h double, all_g double, all_h double"


@dataclass
class Tree:
    """A tree as node arrays; a leaf leads to itself."""

    feature: list[int] = field(default_factory=lambda: [0])
    bin: list[int] = field(default_factory=lambda: [255])
    below: list[int] = field(default_factory=lambda: [0])
    above: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    levels: int = 0

    def leaf(self, value: float) -> int:
        node = len(self.feature)
        for column, x in ((self.feature, 0), (self.bin, 255), (self.below, node), (self.above, node), (self.value, value)):
            column.append(x)
        return node

    def split(self, node: int, feature: int, bin: int, below: float, above: float) -> list[int]:
        made = [self.leaf(below), self.leaf(above)]
        self.feature[node], self.bin[node], self.below[node], self.above[node] = feature, bin, *made
        return made

    def walk(self, codes: np.ndarray) -> np.ndarray:
        """The node every row has come to; ``codes`` has a row per feature."""
        feature, border, below, above = (np.array(x) for x in (self.feature, self.bin, self.below, self.above))
        at, row = np.zeros(codes.shape[1], np.int64), np.arange(codes.shape[1])
        for _ in range(self.levels):
            at = np.where(codes[feature[at], row] <= border[at], below[at], above[at])
        return at


def scores(margins: np.ndarray, rounds: list[list[Tree]], codes: np.ndarray) -> np.ndarray:
    """Margins (a row per label) after further rounds."""
    margins = margins.copy()
    for trees in rounds:
        for k, tree in enumerate(trees):
            if tree.levels:
                margins[k] += np.array(tree.value)[tree.walk(codes)]
    return margins


def shares(margins: np.ndarray) -> np.ndarray:
    """Softmax over the labels, which are rows."""
    raised = np.exp(margins - margins.max(axis=0))
    return raised / raised.sum(axis=0)


def histograms(block: dict, rounds: list[list[Tree]], trees: list[Tree], active: list[list[int]], labels: list[int], seed: int, bins: int) -> dict[int, np.ndarray]:
    """Gradients and curvatures of a block's drawn rows for each label, by (node, feature, bin)."""
    numbers, true = np.frombuffer(block["numbers"], "<i8"), np.frombuffer(block["labels"], np.uint8)
    codes = np.frombuffer(block["codes"], np.uint8).reshape(-1, len(numbers))
    margins = np.frombuffer(block["margins"], "<f4").reshape(len(labels), -1).astype(float)
    p = shares(scores(margins, rounds, codes))
    drawn = mixed(numbers, seed) < SUBSAMPLE
    out = {}
    for k, (tree, nodes) in enumerate(zip(trees, active, strict=True)):
        if not nodes:
            continue
        slots = np.full(len(tree.feature), -1)
        slots[nodes] = np.arange(len(nodes))
        slot = slots[tree.walk(codes)]
        rows = np.flatnonzero(drawn & (slot >= 0))
        first = slot[rows] * bins
        g = (true[rows] == labels[k]) - p[k, rows]
        h = p[k, rows] * (1 - p[k, rows])
        out[k] = np.empty((2, len(nodes), len(codes), bins))
        for feature, code in enumerate(codes):
            place = first + code.take(rows)
            for x, weights in enumerate((g, h)):
                out[k][x, :, feature] = np.bincount(place, weights, len(nodes) * bins).reshape(-1, bins)
    return out


def best_splits(table: np.ndarray) -> list[tuple]:
    """For each node the split of highest gain as (slot, feature, bin, gain, left sums, all sums), where one is worth it."""
    upto = table.cumsum(axis=3)
    all_g, all_h = upto[0, :, :1, -1:], upto[1, :, :1, -1:]
    left_g, left_h = upto[0, :, :, :-1], upto[1, :, :, :-1]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - all_g**2 / (all_h + PENALTY)
    gain = np.where((left_h >= LEAST_CURVATURE) & (right_h >= LEAST_CURVATURE), gain, -np.inf).reshape(len(gain), -1)
    best = gain.argmax(axis=1)
    out = []
    for slot, at in enumerate(best):
        if gain[slot, at] > LEAST_GAIN:
            feature, bin = divmod(int(at), table.shape[3] - 1)
            sums = left_g[slot, feature, bin], left_h[slot, feature, bin], all_g[slot, 0, 0], all_h[slot, 0, 0]
            out.append((slot, feature, bin, float(gain[slot, at]), *map(float, sums)))
    return out


def extended(trees: list[Tree], active: list[list[int]], found: list[tuple]) -> list[list[int]]:
    """Split the active nodes of a level as found (label and split); the nodes of the next level."""
    shrink = RATE * (len(trees) - 1) / len(trees)
    following: list[list[int]] = [[] for _ in trees]
    for k, slot, feature, bin, _, left_g, left_h, all_g, all_h in sorted(found):
        values = [shrink * g / (h + PENALTY) for g, h in ((left_g, left_h), (all_g - left_g, all_h - left_h))]
        following[k] += trees[k].split(active[k][slot], feature, bin, *values)
    for k, nodes in enumerate(following):
        trees[k].levels += bool(nodes)
    return following


def local_rounds(blocks: list[dict], rounds: int, depth: int, labels: list[int], seeds: list[int], bins: int) -> list[list[Tree]]:
    """Further rounds over blocks that are the whole table."""
    done: list[list[Tree]] = []
    for n in range(rounds):
        trees, active = [Tree() for _ in labels], [[0] for _ in labels]
        for _ in range(depth):
            total: dict[int, np.ndarray] = {}
            for block in blocks:
                for k, found in histograms(block, [], trees, active, labels, seeds[n], bins).items():
                    total[k] = total[k] + found if k in total else found
            active = extended(trees, active, [(k, *s) for k, found in total.items() for s in best_splits(found)])
            if not any(active):
                break
        done.append(trees)
        for block in blocks:
            block["margins"] = raised(block, [trees]).tobytes()
    return done


def in_one_task(blocks: DataFrame, rounds: int, depth: int, labels: list[int], seeds: list[int], bins: int) -> list[list[Tree]]:
    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [block for batch in batches for block in batch.to_pylist()]
        for n, trees in enumerate(local_rounds(held, rounds, depth, labels, seeds, bins)):
            for k, t in enumerate(trees):
                row = {"round": n, "label": k, "feature": t.feature, "bin": t.bin, "below": t.below, "above": t.above, "value": t.value, "levels": t.levels}
                yield pa.RecordBatch.from_pylist([row], schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema({"round": pa.int32(), "label": pa.int32(), "feature": ints, "bin": ints, "below": ints, "above": ints, "value": pa.list_(pa.float64()), "levels": pa.int32()})
    kinds = "round int, label int, feature array<int>, bin array<int>, below array<int>, above array<int>, value array<double>, levels int"
    found = blocks.mapInArrow(grow, kinds).collect()  # a row per round and label
    out: list[list[Tree]] = [[Tree() for _ in labels] for _ in range(rounds)]
    for r in found:
        out[r["round"]][r["label"]] = Tree(*(list(r[c]) for c in ("feature", "bin", "below", "above", "value")), r["levels"])
    return out


def level(blocks: DataFrame, tasks: int, rounds: list, trees: list[Tree], active: list[list[int]], labels: list[int], seed: int, bins: int) -> list:
    """The best splits of all active nodes of a level; the sums are added up by label, one label at a time in a task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.to_pylist():
                for k, found in histograms(block, rounds, trees, active, labels, seed, bins).items():
                    total[k] = total[k] + found if k in total else found
        for k, found in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["label", "sums"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, sums in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.frombuffer(sums.as_buffer(), float)
                total[k] = total[k] + found if k in total else found
        rows = [(k, *s) for k, found in total.items() for s in best_splits(found.reshape(2, len(active[k]), -1, bins))]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema)

    names = [part.split()[0] for part in SPLIT.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[part.split()[1]]) for n, part in zip(names, SPLIT.split(", "), strict=True)])
    sums = blocks.mapInArrow(add, "label int, sums binary").repartition(min(tasks, len(labels)), "label")
    return sums.mapInArrow(best, SPLIT).collect()  # at most labels * 2^depth rows


def in_passes(blocks: DataFrame, tasks: int, rounds: int, depth: int, labels: list[int], seeds: list[int], bins: int) -> list[list[Tree]]:
    """Further rounds, with a pass over all blocks for every level."""
    done: list[list[Tree]] = []
    for n in range(rounds):
        trees, active = [Tree() for _ in labels], [[0] for _ in labels]
        for _ in range(depth):
            active = extended(trees, active, [tuple(r) for r in level(blocks, tasks, done, trees, active, labels, seeds[n], bins)])
            if not any(active):
                break
        done.append(trees)
    return done


def raised(block: dict, rounds: list[list[Tree]]) -> np.ndarray:
    """A block's scores after further rounds."""
    rows = len(block["labels"])
    before = np.frombuffer(block["margins"], "<f4").reshape(-1, rows).astype(float)
    return scores(before, rounds, np.frombuffer(block["codes"], np.uint8).reshape(-1, rows)).astype("<f4")


def paired(codes: np.ndarray, bins: int) -> np.ndarray:
    """Codes of two features each as one number, a row per pair; the last feature may have no other."""
    pairs = codes[::2].astype(np.uint16) * np.uint16(bins)
    pairs[: len(codes) // 2] += codes[1::2]
    return pairs


def under(pairs: np.ndarray, rows: np.ndarray, feature: int, bin: int, bins: int) -> np.ndarray:
    """Whether the rows' codes of a feature are ``bin`` at most."""
    pair = pairs[feature // 2].take(rows)
    return pair % bins <= bin if feature % 2 else pair < (bin + 1) * bins


def pair_sums(pairs: np.ndarray, parts: list[np.ndarray], g: np.ndarray, h: np.ndarray, features: int, bins: int) -> np.ndarray:
    """Gradients and curvatures by (part, feature, bin); a pass over the rows serves two features."""
    rows = np.concatenate(parts)
    first = np.repeat(np.arange(len(parts)) * bins * bins, [len(part) for part in parts])
    both = g.take(rows), h.take(rows)
    out = np.empty((2, len(parts), 2 * len(pairs), bins))
    for k, pair in enumerate(pairs):
        place = first + pair.take(rows)
        for x, weights in enumerate(both):
            table = np.bincount(place, weights, len(parts) * bins * bins).reshape(-1, bins, bins)
            out[x, :, 2 * k], out[x, :, 2 * k + 1] = table.sum(axis=2), table.sum(axis=1)
    return out[:, :, :features]


def grown(pairs: np.ndarray, rows: np.ndarray, g: np.ndarray, h: np.ndarray, features: int, bins: int, depth: int, label: int, labels: int) -> Tree:
    """A label's tree over the drawn ``rows``, whose ``g`` and ``h`` add up without error."""
    trees, active = [Tree() for _ in range(labels)], [[] for _ in range(labels)]
    active[label], parts = [0], [rows]
    table = pair_sums(pairs, parts, g, h, features, bins)
    for level in range(depth):
        found = best_splits(table)
        following = extended(trees, active, [(label, *s) for s in found])[label]
        if level + 1 == depth or not found:
            break
        kept, smaller, below, whole = [], [], [], []
        for n, (slot, feature, bin, _, _, left_h, _, all_h) in enumerate(found):
            least = 2 * LEAST_CURVATURE  # of a node that can be split
            if max(left_h, all_h - left_h) >= least:
                is_under = under(pairs, parts[slot], feature, bin, bins)
                sides = parts[slot].compress(is_under), parts[slot].compress(~is_under)
                kept.append([(following[2 * n + k], sides[k]) if x >= least else None for k, x in enumerate((left_h, all_h - left_h))])
                below.append(len(sides[0]) <= len(sides[1]))
                smaller.append(sides[0] if below[-1] else sides[1])
                whole.append(slot)
        if not kept:
            break
        sums = pair_sums(pairs, smaller, g, h, features, bins)
        rest = table[:, whole] - sums
        left = np.array(below)[None, :, None, None]
        both = np.where(left, sums, rest), np.where(left, rest, sums)
        places = [(n, k) for n, sides in enumerate(kept) for k in (0, 1) if sides[k]]
        active = [[] for _ in range(labels)]
        active[label], parts = [kept[n][k][0] for n, k in places], [kept[n][k][1] for n, k in places]
        table = np.stack([both[k][:, n] for n, k in places], axis=1)
    return trees[label]


def add_tree(margins: np.ndarray, tree: tuple, pairs: np.ndarray, bins: int) -> None:
    """A label's scores of all rows after a further tree (feature, bin, below, above, value)."""
    feature, border, below, above, value = tree
    pending = [(0, np.arange(len(margins)))]
    while pending:
        node, rows = pending.pop()
        if below[node] == node:
            margins[rows] += value[node]
        elif len(rows):
            is_under = under(pairs, rows, int(feature[node]), int(border[node]), bins)
            pending += [(int(below[node]), rows.compress(is_under)), (int(above[node]), rows.compress(~is_under))]


def by_label(blocks: DataFrame, rounds: int, depth: int, labels: list[int], counts: list[int], seeds: list[int], bins: int) -> list[list[Tree]]:
    """All rounds over a table that every worker holds, with a pass for a round and a task for a label's tree."""
    spark = blocks.sparkSession
    numbers, true, pairs = [], [], []
    for block in blocks.toArrow().to_pylist():  # up to SHARED_BYTES of codes
        numbers.append(np.frombuffer(block["numbers"], "<i8"))
        true.append(np.frombuffer(block["labels"], np.uint8))
        codes = np.frombuffer(block["codes"], np.uint8).reshape(-1, len(true[-1]))
        pairs.append(paired(codes, bins))
    features, prior = len(codes), np.log(np.array(counts) / sum(counts))
    held = spark.sparkContext.broadcast((np.concatenate(numbers), np.concatenate(true), np.concatenate(pairs, axis=1)))
    del numbers, true, pairs, block, codes
    passed: list = []  # the trees of each round, which a worker adds to the scores it keeps
    order = sorted(range(len(labels)), key=lambda k: -counts[k])
    names = ("feature", "bin", "below", "above", "value")

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, true, pairs = held.value
        if not hasattr(held, "margins"):
            held.margins, held.seen = np.repeat(prior.astype(np.float32)[:, None], len(true), axis=1), 0
        for trees in passed[held.seen :]:
            for margins, tree in zip(held.margins, trees.value, strict=True):
                add_tree(margins, tree, pairs, bins)
            held.seen += 1
        rows = np.flatnonzero(mixed(numbers, seeds[len(passed)]) < SUBSAMPLE)
        unit = 2.0 ** (len(true).bit_length() - 52)
        for k in [order[n] for batch in batches for n in batch.column(0).to_pylist()]:
            p = np.concatenate([shares(held.margins[:, at : at + BLOCK_ROWS].astype(float))[k] for at in range(0, len(true), BLOCK_ROWS)])
            g, h = (np.rint(x / unit) * unit for x in ((true == labels[k]) - p, p * (1 - p)))
            tree = grown(pairs, rows, g, h, features, bins, depth, k, len(labels))
            yield pa.RecordBatch.from_pylist([{"label": k, **{c: getattr(tree, c) for c in names}, "levels": tree.levels}], schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema({"label": pa.int32(), "feature": ints, "bin": ints, "below": ints, "above": ints, "value": pa.list_(pa.float64()), "levels": pa.int32()})
    kinds = "label int, feature array<int>, bin array<int>, below array<int>, above array<int>, value array<double>, levels int"
    done: list[list[Tree]] = []
    for _ in range(rounds):
        found = spark.range(0, len(labels), 1, len(labels)).mapInArrow(grow, kinds).collect()  # a row per label
        trees = {r["label"]: Tree(*(list(r[c]) for c in names), r["levels"]) for r in found}
        done.append([trees[k] for k in range(len(labels))])
        passed.append(spark.sparkContext.broadcast([tuple(np.array(getattr(t, c)) for c in names) for t in done[-1]]))
    for x in (held, *passed):
        x.destroy()
    return done


def with_margins(blocks: DataFrame, rounds: list[list[Tree]], prior: np.ndarray) -> DataFrame:
    """The blocks with their rows' scores after ``rounds`` more rounds; without scores so far, from the prior."""
    first = "margins" not in blocks.columns

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                if first:
                    b["margins"] = np.repeat(prior[:, None], len(b["labels"]), axis=1).astype("<f4").tobytes()
                yield pa.RecordBatch.from_pylist([{**b, "margins": raised(b, rounds).tobytes()}])

    return blocks.mapInArrow(add, "numbers binary, labels binary, codes binary, margins binary")


@dataclass
class Boosted:
    """Trees of all rounds and labels as flat node arrays over plain feature values."""

    names: list[str]
    labels: list[int]
    prior: np.ndarray
    roots: np.ndarray
    feature: np.ndarray
    border: np.ndarray
    below: np.ndarray
    above: np.ndarray
    value: np.ndarray
    levels: int

    @classmethod
    def from_trees(cls, rounds: list[list[Tree]], borders: Borders, labels: list[int], prior: np.ndarray) -> Boosted:
        trees = [t for trees in rounds for t in trees]
        sizes = np.array([len(t.feature) for t in trees], dtype=int)
        roots = np.cumsum(sizes) - sizes
        feature, bins, below, above, value = (np.array([x for t in trees for x in getattr(t, c)]) for c in ("feature", "bin", "below", "above", "value"))
        shift = np.repeat(roots, sizes)
        border = np.array([borders.values[f, b] if b < 255 else np.inf for f, b in zip(feature, bins, strict=True)])
        return cls(borders.names, labels, prior, roots, feature, border, below + shift, above + shift, value, max((t.levels for t in trees), default=0))

    @classmethod
    def from_table(cls, nodes: pd.DataFrame, names: Sequence[str], labels: Sequence[int], prior: Sequence[float], levels: int) -> Boosted:
        """Rounds from rows (tree, node, feature, border, below, above, value): a tree for each label in turn, whose leaves lead to themselves."""
        nodes, starts = flat(nodes.sort_values(["tree", "node"], ignore_index=True))
        columns = {c: nodes[c].to_numpy() for c in ("feature", "border", "below", "above", "value")}
        return cls(names=list(names), labels=list(labels), prior=np.array(prior, dtype=float), roots=starts, levels=levels, **columns)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """A row per row of ``x`` and a column per label id, all of them."""
        out = np.zeros((len(x), len(FAULT_NAMES)))
        for start in range(0, len(x), SCORED_ROWS):
            part = x[start : start + SCORED_ROWS]
            at = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            row = np.arange(len(part))[:, None]
            for _ in range(self.levels):
                at = np.where(part[row, self.feature[at]] <= self.border[at], self.below[at], self.above[at])
            sums = self.value[at].reshape(len(part), -1, len(self.labels)).sum(axis=1) if len(self.roots) else 0.0
            out[start : start + SCORED_ROWS, self.labels] = shares((sums + self.prior).T).T if len(self.labels) else 0.0
        return out

    def save(self, spark: SparkSession, path: str) -> None:
        arrays = {c: [getattr(self, c).tolist()] for c in ("prior", "roots", "feature", "border", "below", "above", "value")}
        row = pd.DataFrame({"names": [self.names], "labels": [self.labels], "levels": [self.levels], **arrays})
        schema = (
            "names array<string>, labels array<int>, levels int, prior array<double>, roots array<int>, feature array<int>,"
            "border array<double>, below array<int>, above array<int>, value array<double>"
        )
        spark.createDataFrame(row, schema).coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        row = spark.read.parquet(path).first().asDict()
        kinds = {"prior": float, "roots": int, "feature": int, "border": float, "below": int, "above": int, "value": float}
        return cls(names=list(row["names"]), labels=list(row["labels"]), levels=row["levels"], **{c: np.array(row[c], dtype=k) for c, k in kinds.items()})


def fit_boosted(
    df: DataFrame,
    names: Sequence[str],
    label: str = "fault_label",
    rounds: int | None = None,
    depth: int | None = None,
    settings: Settings = DEFAULTS,
    seed: int = 42,
    key: Sequence[str] = ("device_id", "seq"),
    bins: int = BINS,
) -> Boosted:
    """Boosted trees over the labels that occur in ``df``, whose rows ``key`` tells apart."""
    spark = df.sparkSession
    counts = {r[0]: r[1] for r in df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("int")).count().collect()}  # a row per label
    labels, total = sorted(counts), sum(counts.values())
    prior = np.log(np.array([counts[k] / total for k in labels]))
    borders = Borders.fit(df, names, bins)
    rounds, depth = rounds or min(settings.trees, 150), depth or min(settings.tree_depth, 8)
    default = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(-(-total // TRAINING_ROWS), min(default, -(-total // TASK_FLOOR)), 1)

    def written(blocks: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "boosting-blocks")
        blocks.write.parquet(path)
        return spark.read.schema(blocks.schema).parquet(path).coalesce(tasks), path

    if len(labels) < 2:
        return Boosted.from_trees([], borders, labels, prior)
    coded, seeds = coded_blocks(df, borders, label, key), [seed * 1_000_003 + n for n in range(rounds)]
    if tasks > 1 and total * len(names) <= SHARED_BYTES:
        return Boosted.from_trees(by_label(coded, rounds, depth, labels, [counts[k] for k in labels], seeds, bins), borders, labels, prior)
    blocks, path = written(with_margins(coded.coalesce(tasks), [], prior))
    step = LOCAL_ROUNDS if tasks == 1 else KEPT_ROUNDS
    done: list[list[Tree]] = []
    while len(done) < rounds:
        count = min(step, rounds - len(done))
        mine = seeds[len(done) : len(done) + count]
        since = in_one_task(blocks, count, depth, labels, mine, bins) if tasks == 1 else in_passes(blocks, tasks, count, depth, labels, mine, bins)
        done += since
        if len(done) < rounds:
            blocks, newer = written(with_margins(blocks, since, prior))
            delete(spark, path)
            path = newer
    delete(spark, path)
    return Boosted.from_trees(done, borders, labels, prior)
