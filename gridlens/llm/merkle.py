"""A Merkle manifest of a dataset, and proofs that rows belong to it.

Every row is a leaf: the SHA-256 (as lower-case hex, as all digests here) of its fields, each ``-`` if null, else its UTF-8
length, ``:`` and the value. The leaves of a group (``tree``) ascend by ``order``. While several nodes remain, every ``FAN`` consecutive ones
become the digest of their concatenation, the last run with fewer, even one. What remains is the group's subroot; the subroots, in the order of
their groups (null first, bytewise), give the root in the same way. A row's proof are the other nodes of its runs, level by level to the root.

Leaves are numbered by ranges, never by sorting a group in one task, and cut into superblocks of ``FAN ** BLOCK_LEVELS`` consecutive ones. On
the way up each superblock becomes one node of the next table, until every group has one; larger superblocks serve there. On the way down, the
nodes of a superblock and the outer nodes its rows need, those beside the way from the superblock to the root, are
cogrouped. Each such group finishes its local reduction, joins proofs and folds them. So no task holds more than a superblock and one way to the root.

Folding starts from a row's own digest or, where the caller states another one as evidence, from that; the result equals the root
just when the row is what the manifest was made of.

Cases: null fields are ``-``; a null group is a group of its own, the first; null ids come first, equal ids by their leaves; rows that are
equal in all fields are leaves of their own, next to each other and interchangeable; a group of one leaf has that leaf as subroot, and if it is the only group, as root,
with an empty proof; an empty table gives an empty result; columns that are not fields are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.llm.order import placed
from gridlens.session import materialize

FAN = 16
#: Levels that a superblock of leaves, and one of higher nodes, reduces at once.
BLOCK_LEVELS, UPPER_LEVELS = 2, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*fields: Column) -> Column:
    """Digest of the encoded fields of a row."""

    def encoded(field: Column) -> Column:
        value = field.cast("string")
        return F.when(field.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*[encoded(f) for f in fields]), 256)


def leaves(df: DataFrame, evidence: Column | None = None, fields: Sequence[str] = FIELDS, tree: str = "source", order: str = "doc_id") -> DataFrame:
    """Row id, group, leaf and ``evidence`` (a digest to fold in place of the leaf, or null) of every row, written once."""
    # Keeps the order of groups, null first, and is never null itself.
    group = F.when(F.col(tree).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(tree).cast("string")))
    evidence = F.lit(None).cast("string") if evidence is None else evidence
    rows = df.select(F.col(order).alias("id"), group.alias("tree"), leaf(*[F.col(f) for f in fields]).alias("node"), evidence.alias("evidence"))
    # Equal rows are told apart by a number, so that any number of them is dealt out by ranges.
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "leaves")


def digest(parts: bytes) -> bytes:
    return sha256(parts).hexdigest().encode()


def levels_of(n: int, most: int) -> int:
    """Levels that ``n`` nodes have above them, ``most`` at most."""
    found = 0
    while n > 1 and found < most:
        n, found = -(-n // FAN), found + 1
    return found


def runs_above(nodes: list[bytes], levels: int) -> tuple[list[list[bytes]], list[bytes]]:
    """For each level the concatenated runs, and the nodes that remain above."""
    runs = []
    for _ in range(levels):
        runs.append([b"".join(nodes[k : k + FAN]) for k in range(0, len(nodes), FAN)])
        nodes = [digest(run) for run in runs[-1]]
    return runs, nodes


def sides(run: bytes, place: int) -> tuple[bytes, bytes]:
    """What stands before and after the node at ``place`` of a run."""
    return run[: 64 * place], run[64 * place + 64 :]


def superblock(levels: int) -> Column:
    return F.floor(F.col("place") / F.lit(FAN**levels))


def _sorted(group: pd.DataFrame) -> tuple[pd.DataFrame, list[bytes]]:
    group = group.sort_values("place", ignore_index=True)
    return group, [x.encode() for x in group["node"]]


def ascend(nodes: DataFrame, levels: int) -> DataFrame:
    """The next table: a node for every superblock of ``nodes`` (tree, place, n, node)."""
    size = FAN**levels

    def reduced(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group, inner = _sorted(group)
        above = runs_above(inner, levels_of(int(group["n"][0]), levels))[1]
        return pd.DataFrame({"tree": [key[0]], "place": [key[1]], "node": [above[0].decode()], "n": [-(-int(group["n"][0]) // size)]})

    rows = nodes.select("tree", "place", "n", "node", superblock(levels).alias("block"))
    return materialize(rows.groupBy("tree", "block").applyInPandas(reduced, "tree string, place long, node string, n long"), "nodes")


def _cogrouped(nodes: DataFrame, outer: DataFrame, levels: int):
    return nodes.withColumn("block", superblock(levels)).groupBy("tree", "block").cogroup(outer.withColumnRenamed("place", "block").groupBy("tree", "block"))


def descend(nodes: DataFrame, outer: DataFrame, levels: int) -> DataFrame:
    """``before`` and ``after`` at every level up to the root for each of ``nodes``, from those of their superblocks."""

    def ways(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, inner = _sorted(group)
        runs = runs_above(inner, levels_of(int(group["n"][0]), levels))[0]
        outer_before, outer_after = list(above["before"][0]), list(above["after"][0])
        before, after = [], []
        for k in range(len(inner)):
            found = [sides(runs[level][k // FAN ** (level + 1)], k // FAN**level % FAN) for level in range(len(runs))]
            before.append([b.decode() for b, _ in found] + outer_before)
            after.append([a.decode() for _, a in found] + outer_after)
        return pd.DataFrame({"tree": group["tree"], "place": group["place"], "before": before, "after": after, "subroot": above["subroot"][0], "root": above["root"][0]})

    schema = "tree string, place long, before array<string>, after array<string>, subroot string, root string"
    return materialize(_cogrouped(nodes.select("tree", "place", "n", "node"), outer, levels).applyInPandas(ways, schema), "ways")


def fold(nodes: DataFrame, outer: DataFrame, levels: int, proofs: bool) -> DataFrame:
    """Proof and folded root of each leaf, from the outer nodes of its superblock."""

    def folded(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        group, inner = _sorted(group)
        runs = runs_above(inner, levels_of(int(group["n"][0]), levels))[0]
        outside = [(b.encode(), a.encode()) for b, a in zip(above["before"][0], above["after"][0], strict=True)]
        # Above the first level all leaves of a run go the same way.
        upper: list[list[tuple[bytes, bytes]]] = []
        for k in range(0, len(inner), FAN):
            upper.append([sides(runs[level][k // FAN ** (level + 1)], k // FAN**level % FAN) for level in range(1, len(runs))] + outside)
        joined = [b"".join(b + a for b, a in way) for way in upper]
        proof, root, whole = [], [], []
        for k, own in enumerate(inner):
            before, after = sides(runs[0][k // FAN], k % FAN) if runs else (b"", b"")
            proof.append(sha256(before + after + joined[k // FAN]).hexdigest())
            stated = group["evidence"][k]
            node = stated.encode() if isinstance(stated, str) else own
            for b, a in ([(before, after)] if runs else []) + upper[k // FAN]:
                node = digest(b + node + a)
            root.append(node.decode())
            whole.append((before + after + joined[k // FAN]).decode() if proofs else None)
        return pd.DataFrame({"id": group["id"], "leaf": group["node"], "subroot": above["subroot"][0], "root": above["root"][0], "proof": whole, "proof_sha256": proof, "folded_root": root})

    # As text, since numbers next to nulls would become floats.
    plain = nodes.select("tree", "place", "n", "node", F.col("id").cast("string").alias("id"), "evidence")
    schema = "id string, leaf string, subroot string, root string, proof string, proof_sha256 string, folded_root string"
    found = _cogrouped(plain, outer, levels).applyInPandas(folded, schema)
    return found.withColumn("id", F.col("id").cast(nodes.schema["id"].dataType))


def _tables(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """``nodes`` and every table above it, with the levels between; the last has one node a tree."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tables, levels = [], BLOCK_LEVELS
    while most > 1 or not tables:
        tables.append((nodes, levels))
        nodes, most, levels = ascend(nodes, levels), -(-most // FAN**levels), UPPER_LEVELS
    return [*tables, (nodes, 0)]


def manifest(rows: DataFrame, proofs: bool = False) -> DataFrame:
    """Leaf, subroot, root, ``proof_sha256`` and ``folded_root`` for every row of ``leaves``; with ``proofs`` the proof's nodes as well."""
    below = _tables(placed(rows, ["id", "node", "row"], "tree", "laid-leaves"))
    subroots = below[-1][0].select("tree", "node")
    above = _tables(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "node"), ["group"], "tree", "laid-subroots"))
    none = F.array().cast("array<string>")
    top = above[-1][0].select("tree", "place", none.alias("before"), none.alias("after"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    ways = reduce(lambda way, table: descend(table[0], way, table[1]), above[-2::-1], top)
    groups = above[0][0].select("group", "place", F.col("node").alias("subroot"))
    ways = ways.drop("tree", "subroot").join(groups, "place").select(F.col("group").alias("tree"), F.lit(0).cast("long").alias("place"), "before", "after", "subroot", "root")
    ways = reduce(lambda way, table: descend(table[0], way, table[1]), below[-2:0:-1], materialize(ways, "subroot-ways"))
    found = fold(*below[0][:1], ways, below[0][1], proofs)
    return found if proofs else found.drop("proof")
