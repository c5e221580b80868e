"""Small cases for every operator: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

from __future__ import annotations

import hashlib
import re
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gridlens.llm import ann, bpe, langid, line_dedup, links, minhash, packing, queries, sharding, sketch, url_filter, warc
from gridlens.session import materialize, scratch_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, node string, shard string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu " * 300
TEXTS = [
    "one two three four five six seven\nshared line of words here now",
    "shared line of words here now\nother things are said in this one",
    None, "", "one two three four five six seven\nshared line of words here now",
    "   \n\n", LONG, "word", "12 34 !!", "aé中\U0001f389 b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(n, t, ["en", None][n % 2], None, len(t or ""), "x", "y", None, "z") for n, t in enumerate(TEXTS)]
    rows += [(None, "one two", None, None, 7, None, None, None, None), (0, TEXTS[0], "en", None, 60, "x", "y", None, "z")]
    return materialize(spark.createDataFrame(rows, SCHEMA).repartition(3), "docs")


@pytest.fixture(scope="module")
def none(spark):
    return materialize(spark.createDataFrame([], SCHEMA), "none")


def test_sharding_is_minimax(spark, docs, none):
    rows = sharding.shard_rows(docs, 4).collect()
    assert len(rows) == docs.count() and not sharding.shard_rows(none, 4).count()
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    sizes = [int(x) for x in np.random.default_rng(3).integers(1, 100, 300)]
    groups = spark.createDataFrame([(f"{n:04x}".ljust(32, "0"), s) for n, s in enumerate(sizes)], "key string, size long")
    cuts = sharding.minimax_cuts(groups, 7)

    def fits(capacity):
        runs, fill = 1, 0
        for s in sizes:
            runs, fill = (runs + 1, s) if fill + s > capacity else (runs, fill + s)
        return runs <= 7

    assert cuts.capacity == next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))


def test_url_rules(spark):
    urls = ["http://A.example.COM/en/x", "http://www.example.com/en/", "http://notexample.com/en/", "https://x.net/es/?q", "http://net", None, "none", "http://net/fr/a#b", "http://x.net/es"]
    pages = spark.createDataFrame([(n, u, "r") for n, u in enumerate(urls)] + [(0, urls[0], "r")], "page_id long, url string, rule string")
    rules = url_filter.rules_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/f", "block")])
    found = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(pages, rules).collect()}
    assert [found[n] for n in range(len(urls))] == [
        ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), ("net/f", "block"), (None, "allow"),
    ]
    assert url_filter.judge(pages, rules).count() == len(urls) + 1
    assert url_filter.judge(pages, url_filter.rules_table(spark, [])).where("verdict = 'allow'").count() == len(urls) + 1


def test_line_dedup(docs, none):
    found = line_dedup.dedup_lines(docs).collect()
    assert len(found) == docs.count() and not line_dedup.dedup_lines(none).count()
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    assert sorted(len(r.lines_removed) for r in by_id[0]) == [0, 2]
    assert by_id[1][0].text == "other things are said in this one" and by_id[4][0].lines_removed == [0, 1]
    assert by_id[2][0].text is None and by_id[3][0].text == "" and by_id[5][0].text == "   \n\n" and by_id[0][0].row == "x"


def _lines_with_earlier_match(texts):
    """Numbers of the lines of each text that match an earlier line, by all pairs."""
    seen, gone = [], []
    for text in texts:
        gone.append([])
        for n, line in enumerate(text.split("\n")):
            words = set(line.split())
            if any(100 * len(words & s) >= 80 * len(words | s) for s in seen):
                gone[-1].append(n)
            if words:
                seen.append(words)
    return gone


def test_line_without_earlier_match_stays_though_a_later_one_links_it(spark):
    base = [f"w{n}" for n in range(20)]
    one, two = " ".join([*base[:18], "x", "y"]), " ".join(["u", "v", *base[2:]])
    texts = [one, two, " ".join(base), " ".join([*base[:19], "z"])]
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "bridge")
    found = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()}
    assert found == {0: [], 1: [], 2: [0], 3: [0]} and list(found[n] for n in range(4)) == _lines_with_earlier_match(texts)


@pytest.mark.parametrize("tile, rounds", [(16_384, (1, 16, None)), (16, (1, 2, None))])
def test_line_dedup_is_that_of_all_pairs(spark, monkeypatch, tile, rounds):
    """Families of lines around the threshold, with bridges, over documents in any order of ids."""
    monkeypatch.setattr(line_dedup, "TILE", tile)
    monkeypatch.setattr(line_dedup, "ROUNDS", rounds)
    draw = np.random.default_rng(9)
    lines = []
    for family in range(6):
        size = (8, 14, 20, 30, 90, 200)[family]
        for n in range(50):
            words = [f"f{family}w{k}" for k in range(size)]
            for at in draw.choice(size, max(1, size * (n % 5) // 25), replace=False):
                words[at] = f"x{draw.integers(40)}"
            lines.append(" ".join(words))
    lines = [lines[k] for k in draw.permutation(len(lines))]
    texts = ["\n".join(["", *lines[k : k + 5]]) for k in range(0, len(lines), 5)]
    rows = list(enumerate(texts))
    df = materialize(spark.createDataFrame([rows[k] for k in draw.permutation(len(rows))], "doc_id long, text string").repartition(4), "families")
    found = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()}
    expected = _lines_with_earlier_match(texts)
    assert [found[n] for n in range(len(texts))] == expected and 100 < sum(map(len, expected)) < len(lines) - 6


def test_few_pairs_of_a_large_group_of_near_copies_are_checked(spark, monkeypatch):
    """A few pairs a line, and the same lines go as by all pairs."""
    draw, lines, checked = np.random.default_rng(4), [], []
    for _ in range(240):
        words = [f"w{k}" for k in range(20)]
        for at in draw.choice(20, 2, replace=False):
            words[at] = f"x{draw.integers(60)}"
        lines.append(" ".join(words))
    df = materialize(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "copies")
    verified = line_dedup.verified
    monkeypatch.setattr(line_dedup, "verified", lambda pairs, *rest: checked.append(pairs.count()) or verified(pairs, *rest))
    found = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()}
    assert [found[n] for n in range(len(lines))] == _lines_with_earlier_match(lines)
    assert sum(checked) < 4 * len(lines)  # 891 here; 1,151 when a pair a word was checked first


def test_line_numbers_are_those_of_the_whole_text(spark, tmp_path):
    rows = [(0, "a b c\nd e f\n"), (1, "d e f\na b c"), (2, ""), (3, None), (4, "a b c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.n_lines, r.lines_removed, r.text) for r in queries.op4_line_dedup(spark, str(tmp_path)).collect()}
    assert found == {0: (3, [], rows[0][1]), 1: (2, [0, 1], ""), 2: (1, [], ""), 3: (0, [], None), 4: (1, [0], "")}


def test_counters_are_added_up_in_steps(spark, monkeypatch):
    """Rows of a part fall with each step, whatever the number of tasks, and nothing is left out."""
    monkeypatch.setattr(line_dedup, "FAN_BITS", 2)
    rows = [(n, f"common first{n}\nonly{n} common") for n in range(60)]
    df = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), "counted")
    df = df.repartition(20)
    steps = [line_dedup.counted(df, "text")]
    steps += [line_dedup.added(steps[0])]
    steps += [line_dedup.added(steps[1])]
    counts = [{r.part: r.n for r in s.groupBy("part").agg(F.count("*").alias("n")).collect()} for s in steps]
    assert [set(c.values()) for c in counts] == [{20}, {5}, {2}]
    values = line_dedup.word_hashes([b"common only7"])[0]
    codes = line_dedup.rarity(df, "text")[line_dedup._counter(values)].tolist()
    lines = {w: sum(w in line.split() for _, t in rows for line in t.split("\n")) for w in ("common", "only7")}
    assert codes[:2] == [int(16 + 8 * np.log2(lines["common"] / 16)), 1] and lines == {"common": 120, "only7": 1}


def test_counters_of_many_small_tasks_are_small(spark):
    """A task's counters take a fraction of eight bytes each, so that those of 256 tasks fit in one worker."""
    df = spark.createDataFrame([(n, f"common first{n}\nonly{n} common") for n in range(60)], "doc_id long, text string").repartition(3)
    rows = line_dedup.counted(df, "text").collect()
    assert len(rows) == 3 * (line_dedup.COUNTERS // line_dedup.PART) and max(len(r.counts) for r in rows) < line_dedup.PART // 100


def test_blocks_hold_all_words_in_ranges_of_hashes(monkeypatch):
    """Packed and opened again: negative ids, large rows, streams of several lengths; one range of hashes to a bucket."""
    monkeypatch.setattr(line_dedup, "BLOCK_ROWS", 7)
    draw = np.random.default_rng(3)
    hashes = np.sort(draw.integers(0, 2**64 - 1, 500, dtype=np.uint64))
    fields = [hashes.view(np.int64), draw.integers(-(2**62), 2**62, 500), np.full(500, 5), draw.integers(0, 300, 500)]
    count = draw.integers(0, 4, 500)
    numbers = draw.integers(0, 2**63, count.sum()).astype(np.uint64)
    batch = line_dedup.blocks_of(hashes, 10, fields, [(numbers, count)])
    assert set(batch["bucket"].to_pylist()) == set(range(10)) and batch.num_rows >= 72
    held = list(zip(*(batch[c].to_pylist() for c in ("head", "records", "bits")), strict=True))
    found, (stream,) = line_dedup.opened(held, ("a", "b", "c", "d"))
    assert all((found[c] == f).all() for c, f in zip("abcd", fields, strict=True)) and (stream == numbers).all()
    one = line_dedup.blocks_of(hashes[:1], 10, [f[:1] for f in fields], [])
    found, _ = line_dedup.opened([(one["head"][0].as_py(), one["records"][0].as_py())], ("a", "b", "c", "d"))
    assert [f.tolist() for f in found.values()] == [[f[0]] for f in fields]


def test_words_are_those_between_white_space():
    """Against a pattern, with words of 1 to 200 bytes; equal words have equal hashes, others have not."""
    draw, known = np.random.default_rng(2), {}
    parts = [b"a", b"b", b" ", b"\t", b"\n", b"\x0b\x0c\r", b"\x1c", b"\x00", b"\x85\xa0", b"c" * 8, b"d" * 61, b"\x0e\x08"]
    texts = [b"".join(parts[k] for k in draw.integers(0, len(parts), draw.integers(0, 12))) for _ in range(500)] + [b"", b"e" * 64, b"e" * 65]
    hashes, starts = line_dedup.word_hashes(texts)
    for text, at, end in zip(texts, starts, starts[1:], strict=False):
        words = re.findall(rb"[^\x20\x09-\x0D]+", text)
        assert len(words) == end - at and all(known.setdefault(w, h) == h for w, h in zip(words, hashes[at:end].tolist(), strict=True))
    assert len(set(known.values())) == len(known) > 300


def test_few_open_lines_are_compared_with_all_at_once(spark, monkeypatch):
    """The same lines go, with one search less."""
    monkeypatch.setattr(line_dedup, "ROUNDS", (1, 2, None))
    draw, searches = np.random.default_rng(4), []
    lines = [" ".join(f"x{draw.integers(60)}" if k in at else f"w{k}" for k in range(20)) for at in (draw.choice(20, 2, replace=False) for _ in range(120))]
    df = materialize(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "open")
    candidates = line_dedup._candidates
    monkeypatch.setattr(line_dedup, "_candidates", lambda rows, share, most: searches.append(most) or candidates(rows, share, most))
    for few in (2048, 0):
        monkeypatch.setattr(line_dedup, "FEW", few)
        found = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()}
        assert [found[n] for n in range(len(lines))] == _lines_with_earlier_match(lines)
    assert searches == [1, None, 1, 2, None]


def test_lines_compared_again_are_written_before_they_are_packed(spark, monkeypatch):
    """What a search packs is read from a table: no task holds two Python workers, and no text is hashed twice."""
    monkeypatch.setattr(line_dedup, "ROUNDS", (1, 2, None))
    monkeypatch.setattr(line_dedup, "FEW", 0)
    draw, plans = np.random.default_rng(4), []
    lines = [" ".join(f"x{draw.integers(60)}" if k in at else f"w{k}" for k in range(20)) for at in (draw.choice(20, 2, replace=False) for _ in range(120))]
    df = materialize(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "again")
    candidates = line_dedup._candidates
    monkeypatch.setattr(line_dedup, "_candidates", lambda rows, share, most: plans.append(rows._jdf.queryExecution().optimizedPlan().toString()) or candidates(rows, share, most))
    found = {r.doc_id: r.lines_removed for r in line_dedup.dedup_lines(df).collect()}
    assert [found[n] for n in range(len(lines))] == _lines_with_earlier_match(lines)
    assert len(plans) == 3 and not any("MapInArrow" in p or "Join" in p for p in plans)


def test_lines_are_counted_where_they_are_cut_and_texts_not_sorted(spark, tmp_path):
    """Texts go through Python once for both, and meet the numbers of their lines without a sort; a column of the same name is replaced."""
    rows = [(0, "a b c\nd e f\n", 7), (1, "d e f\na b c", 7), (2, "", 7), (3, None, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, n_lines long").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op4_line_dedup(spark, str(tmp_path))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "split(" not in plan
    assert {r.doc_id: (r.n_lines, r.text) for r in found.collect()} == {0: (3, rows[0][1]), 1: (2, ""), 2: (1, ""), 3: (0, None)}
    counted = line_dedup.dedup_lines(spark.read.parquet(f"{tmp_path}/documents.parquet"), count="n_lines")
    assert counted.columns == ["doc_id", "text", "lines_removed", "n_lines"] and {r.doc_id: r.n_lines for r in counted.collect()} == {0: 3, 1: 2, 2: 1, 3: 0}


def test_measured_pairs_are_as_far_apart_as_all_their_bits():
    """Lines of all widths, with a word in common, in the order of size."""
    draw = np.random.default_rng(12)
    base = draw.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.concatenate([base[:n], draw.integers(0, 2**63, n // 12).astype(np.uint64)]) for n in (20, 20, 70, 74, 90, 95, 200, 210, 380, 500, 520)]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    n, zeros = np.diff(starts), np.zeros(len(sets), np.int64)
    bits = line_dedup.Parities(line_dedup.parities(np.concatenate(sets), starts), np.arange(len(sets)))
    pairs = [(a, b, d) for found in line_dedup._measured(zeros, n, zeros, bits, np.arange(len(sets))[::-1].copy(), (80, 100)) for a, b, d in zip(*found, strict=True)]
    assert {(b, a) for a, b, _ in pairs} >= {(x, y) for x in range(len(sets)) for y in range(x + 1, len(sets)) if 100 * len(np.intersect1d(sets[x], sets[y])) >= 80 * len(np.union1d(sets[x], sets[y]))}
    for a, b, d in pairs:
        true = len(np.setxor1d(sets[a], sets[b]))
        assert d <= true and (d - true) % 2 == 0 and d == bits.apart(np.array([b]), np.array([a]))[0]


def test_line_blocks_lose_no_pair():
    """Pairs that the task finds connect exactly the lines of a group that pass the filters."""
    share = (80, 100)
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 12, 9)).astype(np.uint64) for _ in range(60)]
    codes = np.full(line_dedup.COUNTERS, 2, np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    from gridlens.llm.words import mix

    owner, place, tokens, bits = line_dedup.prefixes(np.concatenate([np.sort(mix(s)) for s in sets]), starts, codes, share)
    n = np.diff(starts)
    order = np.lexsort((n[owner], tokens))
    args = (tokens[order], n[owner][order], place[order], line_dedup.Parities(bits, owner[order]))
    everything = {frozenset((owner[order[a]], owner[order[b]])) for x, y in line_dedup._meetings(*args, np.arange(len(order)), share) for a, b in zip(x, y, strict=True)}
    for i in range(60):
        for j in range(i):
            common = len(np.intersect1d(sets[i], sets[j]))
            if 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common):
                assert frozenset((i, j)) in everything


def test_line_parities_never_exceed_the_difference():
    """Lines of all widths against each other; unrelated long lines of similar length are known to be below 0.8."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 80, 81, 95, 180, 181, 200, 400, 401, 450, 2000)]
    sets += [np.concatenate([s[: len(s) * 9 // 10], s[:0]]) for s in sets] + sets
    sets.sort(key=len)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    bits = line_dedup.Parities(line_dedup.parities(np.concatenate(sets), starts), np.arange(len(sets)))
    a, b = np.triu_indices(len(sets), 1)
    true = np.array([len(np.setxor1d(sets[x], sets[y])) for x, y in zip(a, b, strict=True)])
    assert (bits.apart(a, b) <= true).all() and ((bits.apart(a, b) - true) % 2 == 0).all()
    unrelated = [(x, y) for x, y, d in zip(a, b, true, strict=True) if len(sets[x]) >= 81 and d == len(sets[x]) + len(sets[y]) and 80 * len(sets[y]) <= 100 * len(sets[x])]
    assert unrelated and all(bits.apart(np.array([x]), np.array([y]))[0] * 180 > 20 * (len(sets[x]) + len(sets[y])) for x, y in unrelated)


def test_components_of_long_paths(spark):
    """Paths, a star and a pair, in any order of names, against their smallest nodes."""
    rng = np.random.default_rng(8)
    names = [f"{k:05d}".encode() for k in rng.permutation(5000)[:700]]
    groups = [names[:300], names[300:500], names[500:502], names[502:]]
    pairs = [p for g in groups[:3] for p in zip(g, g[1:], strict=False)] + [(groups[3][0], x) for x in groups[3][1:]]
    found = links.components(spark.createDataFrame(pairs + pairs[:5], "a binary, b binary")).collect()
    expected = {bytes(x): min(g) for g in groups for x in g}
    assert {bytes(r.node): bytes(r.component) for r in found} == expected and len(found) == len(expected)
    assert not links.components(spark.createDataFrame([], "a binary, b binary")).count()


def test_bpe_round_trip(docs, none):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path)) if t}
    expected = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs, path, P.PATTERN)
    rows = bpe.decode(encoded, path).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        text = texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == expected.encode_ordinary(text) and bytes(r.decoded) == text.encode()
    assert len(rows) == docs.count() and not bpe.encode(none, path, P.PATTERN).count()
    encoder = bpe.Encoder(bpe.read_ranks(path), bpe.merge_rows(bpe.read_ranks(path)), P.PATTERN)
    for text in ("a" * 5000, "ab" * 2000, " \n  x", "<|endoftext|>"):
        assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == expected.encode_ordinary(text)


#: The former query, with a row for every token.
BY_WORD = """
SELECT word, list(token ORDER BY pos) AS tokens FROM (
WITH RECURSIVE step(word, pos, token, done) AS (
    SELECT word, pos, token, false FROM letters
  UNION ALL (
    WITH pairs AS (
      SELECT word, pos, token, lead(token) OVER w AS following, lead(pos) OVER w AS next_pos
      FROM step WHERE NOT done WINDOW w AS (PARTITION BY word ORDER BY pos)
    ), best AS (
      SELECT word, min(merged * 4294967296 + pos) AS least, arg_min(next_pos, merged * 4294967296 + pos) AS gone
      FROM pairs JOIN merges ON token * 4294967296 + following = pair GROUP BY word
    )
    SELECT p.word, p.pos, CASE WHEN p.pos = b.least % 4294967296 THEN b.least // 4294967296 ELSE p.token END, b.word IS NULL
    FROM pairs p LEFT JOIN best b ON p.word = b.word
    WHERE b.gone IS NULL OR p.pos <> b.gone
  )
)
SELECT word, pos, token FROM step WHERE done) GROUP BY word ORDER BY word
"""


def test_bpe_words_as_lists(monkeypatch):
    """Many words against the library, in well less time than by the former query."""
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.read_ranks(path)
    library = tiktoken.Encoding("test", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens) if t}, special_tokens={})
    encoder, draw = bpe.Encoder(tokens, bpe.merge_rows(tokens), P.PATTERN), np.random.default_rng(3)
    words = [bytes(draw.choice(list(b"abehnrst"), draw.integers(1, 14))) for _ in range(20_000)] + [b"t", b"h", b"e", b"a" * 300, "é中😀".encode(), b"t", b"h"]
    took, found = [], []
    for query in (bpe.CONTRACT, BY_WORD):
        monkeypatch.setattr(bpe, "CONTRACT", query)
        began = time.process_time()
        found.append(encoder._query(words[:20_000]))
        took.append(time.process_time() - began)
        found[-1] += encoder._query(words[20_000:])
    assert found[0] == found[1] and took[0] < 0.8 * took[1]
    assert [np.frombuffer(f, "<u4").tolist() for f in found[0]] == [library.encode_ordinary(w.decode()) if w.isalnum() else np.frombuffer(o, "<u4").tolist() for w, o in zip(words, found[1], strict=True)]


def test_near_duplicates(spark, docs, none):
    base = [f"w{n}" for n in range(200)]
    near = [" ".join([*base[:k], "x", *base[k + 1 :]]) for k in (20, 60, 100, 140)]
    rows = [(10, " ".join(base)), (11, " ".join(base)), *[(12 + n, t) for n, t in enumerate(near)], (30, " ".join(base[:100])), (31, None), (32, ""), (33, "hi"), (34, "HI"), (None, "hi")]
    found = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=3, share=(85, 100)).collect()}
    assert [found[n].component_id for n in range(10, 16)] == [10] * 6 and found[10].kept and not found[11].kept
    assert found[30].kept and found[31].component_id == 31 and found[32].n_shingles == 0 and found[10].n_shingles == 198
    assert found[33].component_id is None and found[34].component_id is None and found[None].kept
    assert minhash.near_duplicates(docs).count() == docs.count() and not minhash.near_duplicates(none).count()


def test_near_duplicates_lose_no_link_near_the_threshold(spark, monkeypatch):
    """A family of texts around the threshold, compared in blocks, against all pairs."""
    monkeypatch.setattr(minhash, "TILE", 16)
    draw = np.random.default_rng(5)
    base = [f"w{n}" for n in range(150)]
    texts = []
    for n in range(120):
        words = list(base)
        for at in draw.choice(150, 2 + n % 6, replace=False):
            words[at] = f"x{draw.integers(10**9)}"
        texts.append(" ".join(words))
    sets = [{tuple(w[k : k + 3]) for k in range(len(w) - 2)} for w in (t.split(" ") for t in texts)]
    label = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    df = materialize(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "family")
    found = {r.doc_id: r.component_id for r in minhash.near_duplicates(df, words=3, share=(85, 100)).collect()}
    assert found == dict(enumerate(label)) and len(set(label)) > 5


def test_signatures_tell_long_texts_apart():
    values = np.sort(np.random.default_rng(6).integers(0, 2**63, 400_000, dtype=np.uint64))
    one, two = minhash.signatures(np.concatenate([values[::2], values[1::2]]), np.array([0, 200_000, 400_000]))
    assert (one == two).sum() < 5


def test_least_matches_is_the_posterior():
    draws = np.random.default_rng(1).beta(20 + 1, 5 + 1, 200_000)
    assert minhash.least_matches(0.85, 25, float((draws > 0.85).mean()) * 0.5) <= 20 <= minhash.least_matches(0.85, 25, float((draws > 0.85).mean()) * 1.5)


def test_components(spark):
    pairs = [(a.to_bytes(4, "big"), b.to_bytes(4, "big")) for a, b in [(1, 2), (2, 3), (3, 4), (4, 5), (8, 9), (9, 7)]]
    found = {r.node[-1]: r.component[-1] for r in links.components(spark.createDataFrame(pairs, "a binary, b binary")).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_fingerprints(docs, none):
    rows = sketch.edited_fingerprints(docs).collect()
    assert len(rows) == docs.count() and not sketch.edited_fingerprints(none).count()
    same = {r.fingerprint for r in rows if r.doc_id in (0, 4)}
    assert len(same) == 1 and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    row = next(r for r in rows if r.doc_id == 8)
    half = len(text[8]) // 2
    assert row.edited_sha256 == hashlib.sha256((text[8][: len(text[8]) - half] + text[7][:half]).encode()).hexdigest()
    parts = sketch.fingerprints(docs.where("doc_id in (0, 6)")).withColumn("whole", F.lit(1))
    merged = sketch.merge(parts, "whole").first().sketch
    assert merged == sorted({h for r in parts.collect() for h in r.sketch})


def test_language(spark, docs, none):
    words = {"aa": ["kalo", "mira", "tesu", "vani"], "bb": ["schrog", "plutz", "krand", "gnell"]}
    rows = [(n, " ".join(words[l][(n * 7 + k * k) % 4] for k in range(12)), l) for n in range(60) for l in ("aa", "bb")]
    training = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([("kalo mira vani tesu mira", "aa"), ("plutz gnell krand schrog", "bb"), (None, "und"), ("12!", "und"), ("", "und")], "text string, score string")
    found = langid.predict(asked, training).collect()
    assert [r.lang_pred for r in found] == ["aa", "bb", "und", "und", "und"] and [r.accepted for r in found] == [True, True, False, False, False]
    assert langid.fit(none) == {} and langid.predict(docs, {}).where("lang_pred = 'und' AND score = 0").count() == docs.count()


def test_warc_round_trip(spark):
    trap = "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n" * 10
    rows = [(3, "http://a/", trap), (1, "http://b c/\r\nX: y", trap), (2, None, "short"), (4, "u", "short"), (5, "u", None), (None, "u", trap), (1, "u", trap)]
    path = scratch_path(spark, "warc")
    warc.write_archives(materialize(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages"), path)
    records = warc.read_archives(spark, path)
    found = warc.resolve(records, ["payload"]).collect()
    assert len(found) == len(rows)
    assert sorted((r.id or "", bytes(r.payload).decode()) for r in found) == sorted((str(i) if i is not None else "", t or "") for i, _, t in rows)
    repeated = [r for r in found if bytes(r.payload).decode() == trap]
    assert sorted(r.record_type for r in repeated) == ["response"] + ["revisit"] * 3 and {r.original_id for r in repeated if r.refers_to} == {"1"}
    assert all(r.digest == hashlib.sha256(bytes(r.payload)).hexdigest() for r in found)


def test_packing(docs, none):
    path = P.path("byte_bpe_50k.json")
    rows = packing.pack(docs, path).collect()
    tokenizer, texts = Tokenizer.from_file(path), {r.doc_id: r.text for r in docs.where("doc_id > 0").collect()}
    for doc, text in texts.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        pieces = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.start)
        assert [i for r in pieces for i in np.frombuffer(r.tokens, "<u4").tolist()] == ids and pieces[0].doc_tokens == len(ids)
        assert all(zlib.crc32(bytes(r.tokens)) == r.ids_crc32 for r in pieces)
    sizes = {}
    for r in sorted(rows, key=lambda r: r.offset):
        assert r.offset == sizes.get(r.sequence_id, 0)
        sizes[r.sequence_id] = r.offset + r.length
    assert all(s <= 2048 and s & (s - 1) == 0 for s in sizes.values()) and not packing.pack(none, path).count()


def test_packing_ids_are_those_of_the_library_in_few_calls(monkeypatch):
    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = [*"abAB.,'#0\0é中😀\n\t\r\x1c\x85\xa0\u3000", *[" "] * 12, "<|endoftext|>", "'s"]
    odd = ["".join(rng.choice(parts, rng.integers(0, 30))) for _ in range(600)] + ["", " ", "a ", " a", "a  b"]
    for kept in (packing.KEPT_UNITS, 40):  # the second forgets its units now and then
        monkeypatch.setattr(packing, "KEPT_UNITS", kept)
        texts = packing.Texts(library.to_str())
        for at in range(0, len(odd), 50):
            block = odd[at : at + 50]
            assert [np.asarray(ids).tolist() for ids in texts(block)] == [e.ids for e in library.encode_batch(block, add_special_tokens=False)]
    plain = [" ".join(f"{w}x{n}." for w in range(50)) for n in range(20)]
    texts, calls = packing.Texts(library.to_str()), []
    texts.tokenizer = SimpleNamespace(encode_batch_fast=lambda batch, **options: calls.extend(batch) or library.encode_batch_fast(batch, **options))
    assert [np.asarray(ids).tolist() for ids in texts(plain)] == [e.ids for e in library.encode_batch(plain, add_special_tokens=False)]
    assert len(calls) < 100  # of 1,000 units


def test_placement_minimises_squares():
    rng, packer = np.random.default_rng(2), packing.Packer(16, 0)
    for size in rng.integers(1, 16, 200).tolist():
        cost = {}
        for level in [0, *np.flatnonzero(packer.levels)]:
            if level + size <= 16:
                after = packer.levels.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 16
                cost[int(level)] = int((after[1:16] ** 2).sum())
        assert packer.place(size) == max(l for l, c in cost.items() if c == min(cost.values()))
        list(packer.add(0, np.zeros(size, np.uint32)))


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(400, 8))
    vectors[50:150] = vectors[7]
    rows = [(n, [float(x) for x in v], "s") for n, v in enumerate(vectors)]
    rows += [(500, None, "s"), (501, [0.0] * 8, "s"), (502, [float("nan")] * 8, "s"), (503, [1.0], "s"), (None, [1.0] * 8, "s"), (504, [None] * 8, "s")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    found = ann.search(table, F.col("vec_id") % 20 == 0, k=5).collect()
    hits = 0
    for query in range(0, 400, 20):
        scores = np.array([sum(a * b for a, b in zip(vectors[query], v, strict=True)) for v in vectors])
        scores[query] = -np.inf
        best = np.lexsort((np.arange(400), -scores))[:5].tolist()
        mine = [r.vec_id for r in sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)]
        hits += len(set(best) & set(mine))
    assert hits >= 0.9 * 100
    assert not ann.search(table.limit(0), F.col("vec_id") % 20 == 0).count()


def test_pipeline(spark, docs, none):
    for frame in (docs, none):
        left = frame
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, left, "")
            assert left.columns == frame.columns, name
            left = materialize(left, name)
        corpus_pipeline.STAGES[-1][1](spark, left, "").count()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "packing"]


def test_pipeline_stages_are_those_of_plain_python(spark):
    """A near copy with other line ends, repeated lines, a document of repeated lines only, and texts without letters."""
    draw = np.random.default_rng(12)
    vocabulary = {"en": ["".join(draw.choice(list("abcdefghi"), 6)) for _ in range(80)], "de": ["".join(draw.choice(list("mnopqrstu"), 6)) for _ in range(80)]}
    words = [[str(w) for w in draw.choice(vocabulary[["en", "de"][n % 2]], 45)] for n in range(60)]
    broken = lambda w, cuts: "\n".join(" ".join(w[a:b]) for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True))
    texts = [broken(w, (15, 30)) for w in words]
    first, third = texts[0].split("\n"), texts[2].split("\n")
    texts += [broken([*words[4][:44], words[6][0]], (7, 22, 37)), "\n".join([third[1], broken(words[8][::-1], (20,))]), "\n".join([first[0], third[0]]), None, "12 34 !!"]
    rows = [(n, t, ["en", "de"][n % 2 if n < 60 else 0], None, len(t or ""), "x", "y", "n", "s") for n, t in enumerate(texts)]
    left = materialize(spark.createDataFrame(rows, SCHEMA).repartition(3), "stages")
    expected = {n: t for n, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    stages = dict(corpus_pipeline.STAGES)

    left = materialize(stages["language"](spark, left, ""), "language")
    assert {r.doc_id: r.text for r in left.collect()} == expected and len(expected) == 63

    gone = _lines_with_earlier_match(list(expected.values()))
    cut = {n: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in g) for (n, t), g in zip(expected.items(), gone, strict=True)}
    expected = {n: t for n, t in cut.items() if t.split()}
    left = materialize(stages["lines"](spark, left, ""), "lines")
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {n: (t, len(t)) for n, t in expected.items()} and sum(map(len, gone)) == 3 and len(expected) == 62

    sets = {n: {tuple(t.split()[k : k + 3]) for k in range(len(t.split()) - 2)} for n, t in expected.items()}
    expected = {n: t for n, t in expected.items() if not any(m < n and 100 * len(sets[m] & sets[n]) >= 85 * len(sets[m] | sets[n]) for m in sets)}
    left = materialize(stages["near_duplicates"](spark, left, ""), "near")
    assert {r.doc_id: r.text for r in left.collect()} == expected and len(expected) == 61 and 60 not in expected

    tokenizer, pieces = Tokenizer.from_file(P.path("byte_bpe_50k.json")), {}
    for r in sorted(stages["packing"](spark, left, "").collect(), key=lambda r: (r.doc_id, r.start)):
        pieces.setdefault(r.doc_id, []).extend(np.frombuffer(r.tokens, "<u4").tolist())
    assert pieces == {n: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for n, t in expected.items()}
