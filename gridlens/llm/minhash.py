"""Near-duplicates by MinHash with sequential Bayesian verification.

A document's set are the hashes of its distinct word shingles; documents with equal sets are one
class from the start. Classes that agree on a band of the signature are candidates. A pair's signatures
are compared batch by batch: after each batch, the probability that the similarity reaches the threshold is
taken from the posterior of the agreements so far (uniform prior), and the pair is dropped where it is below ``MISS``.
What survives is checked exactly on the full sets. Components of the links give the groups.

No bucket emits all its pairs. In each of ``ROUNDS`` rounds every bucket that holds several components names one
of its classes (first the smallest id, which is the original where copies came later, then one by hash), and every class is compared
with the one that most of its buckets name, outside its own component: at most one pair a class. Only then are classes of
different components that still share a bucket compared with each other, which completes the links. That is done inside the
tasks, over blocks of a bucket that meet two by two, each pair in the first bucket it shares, and on ``MORE`` further hashes, so that
only pairs close to the threshold are emitted. Pairs whose set sizes alone rule the similarity out are left out.

With ``BANDS`` bands of ``ROWS`` hashes a pair at 0.85 is missed by all bands with probability 4e-7, at 0.8 with 5e-5.

Cases: null, empty and wordless texts have an empty set and are linked with nothing; a text with fewer
words than a shingle is one shingle; rows that repeat an id are one node each by their text, and share the
component of that text; a null id is the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlens.llm.links import components, in_filter, members, node_filter, verified
from gridlens.llm.words import LOWER, mix, set_keys, shingle_sets
from gridlens.session import materialize

WORDS, SHARE, BANDS, ROWS = 5, (80, 100), 25, 5
#: Signature hashes compared before each look at the posterior, and the chance of dropping a true pair there.
BATCH, MISS = 25, 1e-6
#: Rounds in which a class is compared with one other class, before all that remain are.
ROUNDS = 3
_HASHES = BANDS * ROWS
#: Further hashes (of 8 bits) by which classes are compared across components, and after how many there is a look.
MORE, MORE_LOOKS = 875, (125, 375, 875)
#: Classes in a block of a bucket; rows a task reads before it compares them.
TILE, CHUNK = 1024, 8192
_SEED = np.random.default_rng(7)
_FLIPS = _SEED.integers(0, 2**63, _HASHES + MORE, dtype=np.uint64)
_FACTORS = _SEED.integers(1, 2**62, _HASHES + MORE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingles of which signatures are computed at once, to stay in the processor's cache.
_BLOCK = 1 << 15


def sets_of(columns: list, words: int) -> tuple[np.ndarray, np.ndarray, list]:
    """Shingle sets of texts, and the key of each."""
    values, starts = shingle_sets([(t or "").encode().translate(LOWER) for t in columns[0]], words)
    return values, starts, set_keys(values, starts)


def signatures(values: np.ndarray, starts: np.ndarray, hashes: range = range(_HASHES), bits: int = 16) -> np.ndarray:
    """A row of hashes of ``bits`` (8 or 16) for each run of values that is not empty."""
    filled = np.flatnonzero(np.diff(starts))
    out = np.empty((len(filled), len(hashes)), dtype=f"<u{bits // 8}")
    begin = 0
    while begin < len(filled):
        end = begin + 1
        while end < len(filled) and starts[filled[end] + 1] - starts[filled[begin]] <= _BLOCK:
            end += 1
        low = starts[filled[begin]]
        block, at = values[low : starts[filled[end - 1] + 1]], starts[filled[begin:end]] - low
        for place, k in enumerate(hashes):
            least = np.minimum.reduceat((block ^ _FLIPS[k]) * _FACTORS[k], at)
            out[begin:end, place] = mix(least) >> np.uint64(64 - bits)  # the upper bits of a least value alone are nearly always 0
        begin = end
    return out


def least_matches(share: float, compared: int, miss: float = MISS) -> int:
    """Fewest agreements out of ``compared`` at which the similarity still reaches ``share`` with probability ``miss``."""
    total, n = 0.0, compared + 1
    for matches in range(n):  # P(Beta(m + 1, n - m + 1) > share) = P(Binomial(n + 1, share) <= m)
        ways = lgamma(n + 1) - lgamma(matches + 1) - lgamma(n - matches + 1)
        total += exp(ways + matches * log(share) + (n - matches) * log(1 - share))
        if total >= miss:
            return matches
    return compared


def bayes_filter(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """Pairs (``a``, ``b``) whose signatures do not rule out a similarity of ``share``."""
    looks = [(n, least_matches(share, n)) for n in range(BATCH, _HASHES + 1, BATCH)]
    of = lambda c: classes.select(F.col("node").alias(c), F.col("signature").alias(f"of_{c}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (_unpacked(batch.column(c), "<u2").reshape(-1, _HASHES) for c in (2, 3))
            alive, matches, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, int), 0
            for n, least in looks:
                matches[alive] += (x[alive, done:n] == y[alive, done:n]).sum(axis=1)
                alive, done = alive[matches[alive] >= least], n
            yield batch.select([0, 1]).take(pa.array(alive))

    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b").mapInArrow(run, "a binary, b binary")


def _unpacked(packed: pa.Array, kind: str) -> np.ndarray:
    """Packed signatures, a row each."""
    return np.frombuffer(b"".join(packed.to_pylist()), kind).reshape(len(packed), -1)


def _keys(rows: np.ndarray) -> np.ndarray:
    """Keys of the bands of signatures."""
    rows = rows.reshape(-1, BANDS, ROWS).astype(np.uint64)
    keys = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for k in range(ROWS):
        keys = mix(keys * np.uint64(65537) + rows[:, :, k])
    return keys.view(np.int64)


def _bands(classes: DataFrame) -> DataFrame:
    """``bucket``, ``node``, ``id`` and ``n`` of every band of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = _keys(_unpacked(batch.column(1), "<u2"))
                each = pa.array(np.repeat(np.arange(len(keys)), BANDS))
                columns = [pa.array(keys.ravel()), *(batch.column(c).take(each) for c in (0, 2, 3))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "node", "id", "n"])

    return classes.select("node", "signature", "id", "n").mapInArrow(run, "bucket long, node binary, id long, n long")


def _likely(pairs: DataFrame, classes: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Pairs (``a``, ``b`` and their set sizes) that neither sizes nor signatures rule out, written."""
    near = f"{share[1]} * least(n_a, n_b) >= {share[0]} * greatest(n_a, n_b)"
    pairs = pairs.where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return materialize(bayes_filter(pairs, classes, share[0] / share[1]), "minhash-candidates")


def _with_one(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Each class with the class that most of its buckets name, outside its own component."""
    met = rows.join(named, "bucket").where("component <> named.component")
    key = F.concat_ws(" ", F.hex("named.node"), F.col("named.n"))
    found = met.groupBy("node").agg(F.first("n").alias("n_a"), F.mode(key, True).alias("key"))
    other = F.split("key", " ")
    return found.select(F.col("node").alias("a"), "n_a", F.unhex(other[0]).alias("b"), other[1].cast("long").alias("n_b"))


def _more_signatures(source: DataFrame, rows: DataFrame, words: int) -> DataFrame:
    """Further hashes (``node``, ``more``) of the classes in ``rows``."""
    shared = source.sparkSession.sparkContext.broadcast(node_filter(rows.select(F.col("node").alias("a"), F.col("node").alias("b"))))
    hashes = range(_HASHES, _HASHES + MORE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, nodes = sets_of([batch.column(0).to_pylist()], words)
            found = {n: k for k, n in enumerate(nodes) if n is not None and in_filter(shared.value, n)}
            runs = [values[starts[k] : starts[k + 1]] for k in found.values()]
            ends = np.cumsum([0, *map(len, runs)])
            packed = [row.tobytes() for row in signatures(np.concatenate([*runs, values[:0]]), ends, hashes, 8)]
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(packed, pa.binary())], names=["node", "more"])

    found = source.select("text").mapInArrow(run, "node binary, more binary")
    return found.groupBy("node").agg(F.first("more").alias("more"))


def _tile_pairs(rows: pa.Table, share: tuple[int, int], looks: list, more_looks: list) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs in whole tiles (rows sorted by tile and size) that nothing rules out."""
    tile, bucket, n, block, alone = (rows[c].to_numpy() for c in ("tile", "bucket", "n", "block", "alone"))
    component = rows["component"].to_pandas().factorize()[0]
    short, more = (_unpacked(rows[c].combine_chunks(), k) for c, k in (("signature", "<u2"), ("more", "u1")))
    keys = _keys(short)
    left, right = [], []
    alive, shift = np.arange(len(n)), 1
    while len(alive):
        alive = alive[alive + shift < len(n)]
        other = alive + shift
        near = (tile[alive] == tile[other]) & (share[1] * n[alive] >= share[0] * n[other])
        alive, other = alive[near], other[near]
        apart = (component[alive] != component[other]) & (bucket[alive] == bucket[other]) & (alone[alive] | (block[alive] != block[other]))
        a, b = alive[apart], other[apart]
        first = keys[a, (keys[a] == keys[b]).argmax(axis=1)] == bucket[a]  # each pair in one bucket
        a, b = a[first], b[first]
        matches, done = np.zeros(len(a), int), 0
        for values, ends in ((short, looks), (more, more_looks)):
            done = 0
            for end, least in ends:
                matches += (values[a, done:end] == values[b, done:end]).sum(axis=1)
                fits, done = matches >= least, end
                a, b, matches = a[fits], b[fits], matches[fits]
        left.append(a)
        right.append(b)
        shift += 1
    return np.concatenate([np.empty(0, int), *left]), np.concatenate([np.empty(0, int), *right])


def _across(rows: DataFrame, classes: DataFrame, source: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Likely pairs of classes of different components that share a bucket, written."""
    part = share[0] / share[1]
    looks = [(n, least_matches(part, n)) for n in range(BATCH, _HASHES + 1, BATCH)]
    more_looks = [(n, least_matches(part, _HASHES + n)) for n in MORE_LOOKS]
    columns = ["tile", "bucket", "n", "block", "alone", "component", "node", "signature", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(rows: pa.Table) -> pa.RecordBatch:
            a, b = _tile_pairs(rows, share, looks, more_looks)
            nodes = rows["node"].combine_chunks()
            return pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

        held: list[pa.Table] = []
        for batch in batches:
            if batch.num_rows:
                held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) >= CHUNK:
                whole = pa.concat_tables(held)
                tile = whole["tile"].to_numpy()
                cut = int(np.searchsorted(tile, tile[-1]))  # the last tile may go on
                if cut:
                    yield pairs(whole.slice(0, cut))
                held = [whole.slice(cut)]
        if held:
            yield pairs(pa.concat_tables(held))

    sizes = rows.groupBy("bucket").agg(F.ceil(F.count("*") / TILE).alias("blocks"))
    blocks = rows.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("node", "bucket"), "blocks"))
    met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tile = F.xxhash64("bucket", F.least("block", "other"), F.greatest("block", "other"))
    met = met.withColumns({"tile": tile, "alone": F.col("block") == F.col("other")})
    # in a tile of two blocks, rows of either carry the other one
    signed = classes.select("node", "signature").join(_more_signatures(source, rows, words), "node")
    full = met.join(signed, "node").select(columns).repartition("tile").sortWithinPartitions("tile", "n")
    found = full.mapInArrow(run, "a binary, b binary").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return materialize(found, "minhash-candidates")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` (smallest id reachable over links) and ``kept`` (it is the id's own) of every row.

    Of rows that repeat the smallest id all are kept; ``share`` is the least similarity, as a fraction.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, starts, nodes = sets_of([batch.column(1).to_pylist()], words)
            packed = iter(signatures(values, starts).astype("<u2"))
            sizes = np.diff(starts)
            rows = [next(packed).tobytes() if n else None for n in sizes]
            columns = [pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(rows, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", "n_shingles", "node", "signature"])

    source = df.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    docs = materialize(source.mapInArrow(signed, "id long, n_shingles long, node binary, signature binary"), "minhash-documents")
    first = F.min(F.struct("id")).alias("first")
    classes = docs.where("node IS NOT NULL").groupBy("node").agg(first, F.first("n_shingles").alias("n"), F.first("signature").alias("signature"))
    classes = materialize(classes.select("node", F.col("first.id").alias("id"), "n", "signature"), "minhash-classes")
    sets = lambda pairs: members(source, pairs, lambda c: sets_of(c, words), ["text"])

    rows = _bands(classes).withColumn("component", F.col("node"))
    links = grouped = None
    for turn in range(ROUNDS + 1):
        place = F.struct("id", "node", "n", "component") if turn == 0 else F.struct(F.xxhash64("node", F.lit(turn)), "node", "n", "component")
        named = rows.groupBy("bucket").agg(F.min(place).alias("named"), F.min("component").alias("least"), F.max("component").alias("most"))
        named = materialize(named.where("least <> most").select("bucket", "named"), "minhash-mixed")
        rows = materialize(rows.join(named, "bucket", "left_semi"), "minhash-bands")
        likely = _likely(_with_one(rows, named), classes, share) if turn < ROUNDS else _across(rows, classes, source, words, share)
        found = verified(likely, sets(likely), share)
        links = materialize(found if links is None else links.unionByName(found), "minhash-links")
        grouped = components(links)
        rows = rows.drop("component").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))

    named = classes.select("node", "id").join(grouped, "node", "left").select("node", "id", F.coalesce("component", "node").alias("component"))
    named = materialize(named, "minhash-named")
    smallest = materialize(named.groupBy("component").agg(F.min(F.struct("id")).alias("least")), "minhash-components")
    named = materialize(named.join(smallest, "component").select("node", F.col("least.id").alias("component_id")), "minhash-classes")
    found = docs.select("id", "n_shingles", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
