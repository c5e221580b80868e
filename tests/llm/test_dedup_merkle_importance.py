"""Exact dedup, Merkle manifests and importance resampling against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
import zlib

import numpy as np
import oracle
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from gridlens.llm import exact_dedup, importance, merkle, queries, sql
from gridlens.session import materialize

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, tree string, digest string, score string, place string"
LONG = "Alpha beta\t gamma  " * 60_000


def made(rows):
    return [(i, t, l, s, n, "r", "t", "d", "s", "p") for i, t, l, s, n in rows]


@pytest.fixture(scope="module")
def rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and a group with a third of all rows."""
    texts = ["one two", "one  two", "one\ttwo", " one two", None, "", " ", "\n\t", LONG, LONG.lower(), "ÀB c", "\x00a", "A b c d e f g h i j k l m n o p q r s t u v"]
    rows = [(n, texts[n % len(texts)], ["en", None][n % 2], [None, "b", "a", "é", "", "a"][n % 6], None if n % 7 == 0 else n) for n in range(90)]
    rows += [(1000 - n, "copied " * 30, "en", "hot", 9) for n in range(50)]
    rows += [(None, "one two", None, None, None), (None, "null id", None, "a", 1), (3, rows[3][1], *rows[3][2:]), (3, rows[3][1], *rows[3][2:]), (2**53 + 1, "big", "en", "a", 2)]
    return made(rows)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return materialize(spark.createDataFrame(rows, SCHEMA).repartition(5), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return materialize(spark.createDataFrame([], SCHEMA), "none")


def last(x):
    return (x is None, 0 if x is None else x)


def first(x):
    return (x is not None, 0 if x is None else x)


@pytest.mark.parametrize("counters", [2, 5, 1024])
def test_exact_dedup(docs, none, rows, counters):
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    expected = []
    for t, ids in groups.items():
        ids.sort(key=last)
        expected += [(i, ids[0], len(ids), n == 0, hashlib.sha256(t.encode()).hexdigest()) for n, i in enumerate(ids)]
    found = exact_dedup.dedup(docs, counters=counters)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    order = lambda r: (r[4], last(r[0]), not r[3])
    assert sorted(map(tuple, found.collect()), key=order) == sorted(expected, key=order)
    assert not exact_dedup.dedup(none).count()
    kept = exact_dedup.first_rows(docs, counters=counters)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_summaries_miss_no_frequent_value(spark):
    draw = np.random.default_rng(3)
    values = [b"hot"] * 400 + [b"warm"] * 150 + [bytes([k % 256, k // 256]) for k in range(900)]
    values = [values[k] for k in draw.permutation(len(values))]
    summary = exact_dedup.Summary(9)
    for k in range(0, len(values), 37):
        found = pa.array(values[k : k + 37], pa.binary()).value_counts()
        summary.add(found.field(0).to_pylist(), found.field(1).to_pylist())
        assert len(summary.counts) <= 9
    assert 400 - len(values) / 10 <= summary.counts[b"hot"] <= 400 and summary.counts[b"warm"] <= 150
    df = materialize(spark.createDataFrame([(v,) for v in values], "v binary").repartition(7), "values")
    found = {bytes(r.v) for r in exact_dedup.frequent(df, "v", 9).collect()}
    assert b"hot" in found and len(found) <= 9  # at least 2 / 10 of the rows


def test_frequent_digests_are_decided_without_a_shuffle(docs):
    """Only the branch of the other digests deals out rows by digest."""
    plan = exact_dedup.dedup(docs, counters=5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and plan.count("hashpartitioning(digest") == 1


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(i, t, l, s, n):
    return H("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, l, n, t)))


def way(nodes, place):
    """Sides of a node at every level, and the node that remains."""
    sides = []
    while len(nodes) > 1:
        start = place // 16 * 16
        sides.append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 16])))
        nodes, place = [H("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], place // 16
    return sides, nodes[0]


def plain_manifest(rows):
    trees = {}
    for i, t, l, s, n, *_ in rows:
        lower = t and "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
        changed = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        trees.setdefault(s, []).append((first(i), plain_leaf(i, t, l, s, n), plain_leaf(i, lower, l, s, n) if changed else None, i))
    names = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        trees[s].sort(key=lambda x: x[:2])
    subroots = [way([x[1] for x in trees[s]], 0)[1] for s in names]
    out = []
    for k, s in enumerate(names):
        for place, (_, leaf, evidence, i) in enumerate(trees[s]):
            sides, root = way([x[1] for x in trees[s]], place)
            above, top = way(subroots, k)
            node = evidence or leaf
            for b, a in sides + above:
                node = H(b + node + a)
            out.append((i, leaf, root, top, H("".join(b + a for b, a in sides + above)), node, node == top))
    return out


@pytest.mark.parametrize("lower, upper", [(2, 3), (1, 1)])
def test_merkle_manifest(spark, docs, none, rows, monkeypatch, tmp_path, lower, upper):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", lower)
    monkeypatch.setattr(merkle, "UPPER_LEVELS", upper)
    many = made([(n * 7 % 1201, f"Text {n}", "en", f"s{n % 40}" if n % 3 else "hot", n) for n in range(1200)])
    for cases in (rows, many, many[:1], many[1:18]):
        folder = f"{tmp_path}/{len(cases)}"
        spark.createDataFrame(cases, SCHEMA).repartition(4).write.parquet(f"{folder}/documents.parquet")
        found = queries.op12_merkle(spark, folder)
        assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
        order = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, found.collect()), key=order) == sorted(plain_manifest(cases), key=order)
    assert not merkle.manifest(merkle.leaves(none)).count()


def test_merkle_proofs_fold_outside_the_engine(docs, rows):
    found = merkle.manifest(merkle.leaves(docs), proofs=True).collect()
    assert all(H(r.proof) == r.proof_sha256 and r.folded_root == r.root for r in found) and len({r.root for r in found}) == 1


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return [zlib.crc32(" ".join(words[k : k + n]).encode()) % 10_000 for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def plain_resample(rows, target, percent, longest, least):
    per = [plain_features(r[1], longest) for r in rows]
    s, t = np.zeros(10_000), np.zeros(10_000)
    for f in per:
        np.add.at(s, f, 1)
    for text in target:
        np.add.at(t, plain_features(text, longest), 1)
    gain = [math.floor(1000 * math.log((b + 1) * (s.sum() + 10_000) / ((a + 1) * (t.sum() + 10_000)))) for a, b in zip(s.tolist(), t.tolist(), strict=True)]
    out = []
    for r, f in zip(rows, per, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((o for o in out if o[1] >= least), key=lambda o: (-o[3], last(o[0]), o[1]))
    for n, o in enumerate(able[: percent * len(able) // 100]):
        o[4] = n + 1
    return out


@pytest.mark.parametrize("percent, longest, least, pivots", [(10, 1, 20, 32), (37, 2, 1, 2), (100, 1, 0, 3), (0, 1, 20, 32)])
def test_importance_resampling(spark, docs, none, rows, monkeypatch, percent, longest, least, pivots):
    monkeypatch.setattr(importance, "PIVOTS", pivots)
    target = [("copied from one",), ("alpha two", ), (None,), ("ÀB gamma",)]
    table = spark.createDataFrame(target, "text string")
    found = importance.resample(docs, table, percent, least=least, longest=longest)
    assert [(f.name, f.dataType.simpleString()) for f in found.schema.fields] == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    expected = plain_resample(rows, [t for t, in target], percent, longest, least)
    order = lambda r: tuple(map(last, r))
    assert sorted(map(tuple, found.collect()), key=order) == sorted(map(tuple, expected), key=order)
    assert not importance.resample(none, table, percent).count()
    assert importance.resample(docs, table.limit(0), percent).count() == len(rows)


@pytest.mark.parametrize("pivots", [1, 4])
def test_kth_key_of_ties(spark, monkeypatch, pivots):
    monkeypatch.setattr(importance, "PIVOTS", pivots)
    rows = [(-(n % 3), n % 5 == 0, None if n % 5 == 0 else n % 4, n % 2, n) for n in range(60)]
    df = materialize(spark.createDataFrame(rows, "down long, last boolean, id long, n_features long, row long"), "keys")
    ranked = sorted(rows, key=lambda r: (r[0], r[1], last(r[2]), r[3], r[4]))
    for k in (1, 2, 30, 60):
        assert df.where(importance._key() == importance.kth(df, k, 5)).first()["row"] == ranked[k - 1][4]
    assert importance.kth(df, 61, 5) is None


@pytest.mark.parametrize("name", ["op3_url_filter", "op9_warc", "op11_exact_dedup", "op12_merkle", "op13_importance"])
def test_registered_query_equals_sql(spark, name):
    found = queries.QUERIES[name](spark, SMALL).toArrow()
    assert oracle.difference(found, oracle.duck(SMALL).execute(sql.ORACLES[name]).to_arrow_table()) is None
