"""Models find what was planted and survive saving."""

import hashlib

import numpy as np
import pytest
from conftest import SMALL, frame
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from gridlens.catalog import queries
from gridlens.config import Settings
from gridlens.operators import bagging, binning, boosting, faults, features, forecast, forecaster, forest, learn
from gridlens.plans import scoring
from gridlens.session import materialize
from gridlens.operators.faults import classification_metrics, confusion, stratified_split
from gridlens.operators.ordered import ordered
from gridlens.functions import scalar


@pytest.fixture(scope="module")
def labelled(spark):
    """Readings whose fault shows in the voltage: 0 near 230 V, 1 near 260 V, 2 near 185 V."""
    rng = np.random.default_rng(1)
    rows = []
    for device in range(6):
        fault = device % 3
        for n in range(120):
            v = (230, 260, 185)[fault] + rng.normal(0, 1)
            i = 3 + rng.normal(0, 0.1)
            rows.append((device, n, float(v), float(i), float(v * i * 0.92), fault))
    df = spark.createDataFrame(rows, "device_id long, seq long, voltage double, current double, power double, fault_label int")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000).cast("timestamp_ntz"))


def test_planted_outliers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (2000, 3))
    x[:40] += 8
    df = spark.createDataFrame([(0, n, *map(float, r)) for n, r in enumerate(x)], "device_id int, seq int, a double, b double, c double")
    model = forest.fit_isolation_forest(df, ["a", "b", "c"], trees=50, settings=Settings(contamination=0.02))
    found = {r["seq"] for r in model.decide(df).filter("decision < 0").collect()}
    assert len(found & set(range(40))) >= 38 and len(found) <= 44
    metrics = forest.detector_metrics(model.decide(df)).first()
    assert metrics["total_samples"] == 2000 and metrics["anomalies_found"] == len(found)


def test_each_tree_has_its_sample(spark):
    df = spark.range(40_000).select(F.lit(0).alias("device_id"), F.col("id").alias("seq"))
    few = forest.tree_samples(df, 40_000, 10, 256, 7, ("device_id", "seq"))  # one tree per row
    many = forest.tree_samples(df.limit(3000), 3000, 40, 256, 7, ("device_id", "seq"))  # rows serve several trees
    for drawn, trees in ((few, 10), (many, 40)):
        sizes = drawn.groupBy("tree").agg(F.count("*").alias("n"), F.countDistinct("seq").alias("d")).collect()
        assert len(sizes) == trees and all(r["n"] == r["d"] == 256 for r in sizes)


def test_trees_draw_from_all_rows_at_every_size(spark):
    """Rows that several trees hold are as many as independent draws give, below and far above trees * sample."""
    for rows, trees, sample in ((2_000, 10, 100), (40_000, 10, 256), (40_000, 100, 64)):
        df = spark.range(rows).select(F.lit(0).alias("device_id"), F.col("id").alias("seq"))
        drawn = forest.tree_samples(df, rows, trees, sample, 7, ("device_id", "seq"))
        held = drawn.groupBy("seq").agg(F.count("*").alias("n"), F.countDistinct("tree").alias("d")).toPandas()
        assert (held["n"] == held["d"]).all() and held["n"].sum() == trees * sample
        p = sample / rows
        several = rows * (1 - (1 - p) ** trees - trees * p * (1 - p) ** (trees - 1))
        assert several > 60 and abs((held["n"] > 1).sum() - several) < 4 * several**0.5


def test_split_is_exact_when_devices_number_their_own_rows(spark, monkeypatch):
    """The same rows as by ranking (digest, device, number), whatever the limit and the order of rows."""
    rows = [(d, n, [0, 1, None][(d + n) % 3]) for d in range(40) for n in range(25)]
    df = spark.createDataFrame(rows, "device_id long, seq long, fault_label int")
    expected = set()
    for label in (0, 1, None):
        of = sorted((int(hashlib.md5(f"{d},{n}".encode()).hexdigest()[:8], 16), d, n) for d, n, k in rows if k == label)
        expected |= {x[1:] for x in of[: int(len(of) * 0.2 + 0.5)]}
    for limit, many in ((None, 10_000), (20, 10_000), (None, 1)):
        monkeypatch.setattr(faults, "MOST_LABELS", many)
        found = stratified_split(df.repartition(5, "seq"), limit=limit).collect()
        assert len(found) == 1000 and {(r.device_id, r.seq) for r in found if r.is_test} == expected


@pytest.mark.parametrize("name", ["random_forest", "feature_importance", "cross_validate", "gradient_boosting", "vote_metrics", "score_readings", "fit_or_load", "stream_scores"])
def test_registered_queries_train_whole_models(spark, monkeypatch, name):
    """Sizes of the models that each registered query asks for; they are grown with fewer trees here."""
    asked, grow, boost, detect = {}, bagging.grow_forests, boosting.Boosted.from_trees, scoring.fit_isolation_forest

    def forests(rows, borders, counts, folds, trees, depth, *rest):
        asked["forest"] = (folds, trees, depth)
        return grow(rows, borders, counts, folds, 3, 3, *rest)

    def rounds_of(blocks, rounds, depth, labels, seeds, bins):
        asked["depth"] = depth
        return [[boosting.Tree() for _ in labels] for _ in range(rounds)]

    def boosted(rounds, *rest):
        asked["boosted"] = len(rounds)
        return boost(rounds, *rest)

    def detector(df, names, trees=None, settings=None):
        asked["detector"] = trees or settings.trees
        return detect(df, names, 3, settings)

    for module in (bagging, learn):
        monkeypatch.setattr(module, "grow_forests", forests)
    monkeypatch.setattr(boosting, "in_one_task", rounds_of)
    monkeypatch.setattr(boosting.Boosted, "from_trees", boosted)
    monkeypatch.setattr(scoring, "fit_isolation_forest", detector)
    assert queries.QUERIES[name](spark, SMALL).count()
    served = name in ("score_readings", "fit_or_load", "stream_scores")
    expected = {"forest": (5 if name == "cross_validate" else 0, 200, 15)} if name != "gradient_boosting" else {}
    expected |= {"boosted": 150, "depth": 8} if served or name in ("gradient_boosting", "vote_metrics") else {}
    assert asked == expected | ({"detector": 200} if served else {})


def test_whole_models_end(spark):
    """A registered query with everything it asks for: 200 trees of depth 15, 150 rounds of depth 8 and their vote."""
    row = queries.QUERIES["vote_metrics"](spark, SMALL).first()
    assert row["support"] > 80 and row["accuracy"] > 0.6


def test_few_rows(spark):
    df = spark.createDataFrame([(0, n, float(n % 5)) for n in range(20)], "device_id int, seq int, a double")
    model = forest.fit_isolation_forest(df, ["a"], trees=5)
    assert model.sample == 20 and model.decide(df).count() == 20


def test_classifiers_beat_the_majority(labelled):
    windows = features.sliding_features(labelled)
    split = stratified_split(learn.Scaler.fit(windows, features.FEATURE_NAMES).transform(windows)).persist()
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    rf = learn.fit_random_forest(train, features.FEATURE_NAMES, trees=5, depth=3)
    gb = learn.fit_boosted(train, features.FEATURE_NAMES, rounds=2, depth=2)
    voted = learn.vote(learn.probabilities(test, rf, gb))
    for found in (voted, learn.probabilities(test, forest=rf).withColumn("fault_id", scalar.predicted_class("rf"))):
        assert classification_metrics(confusion(found)).first()["accuracy"] > 0.95
    row = voted.first()
    assert len(row["top"]) == 3 and row["top"][0]["id"] == row["fault_id"]
    best = learn.feature_importance(labelled.sparkSession, rf).collect()
    assert len(best) == 10 and best[0]["importance"] >= best[-1]["importance"]


@pytest.fixture(scope="module")
def classes(spark):
    """Three classes by a rule with an interaction, some noise, a constant and a two-valued feature; no other label occurs."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(3000, 4)), 2)
    x[:, 2], x[:, 3] = 7.0, x[:, 3] > 0
    label = np.where(x[:, 0] * np.where(x[:, 3] > 0, 1, -1) > 0.3, 2, np.where(x[:, 1] > 0.5, 5, 0))
    label = np.where(rng.random(3000) < 0.05, 0, label)
    rows = [(n % 7, n, *map(float, r), int(k)) for n, (r, k) in enumerate(zip(x, label, strict=True))]
    rows += [(1, -1, 0.0, 0.0, 7.0, 0.0, None)]
    df = spark.createDataFrame(rows, "device_id int, seq int, a double, b double, c double, d double, fault_label int")
    return materialize(df.repartition(4), "classes").persist()


def test_codes_ask_the_same_as_values(spark, classes):
    borders = binning.Borders.fit(classes, ["a", "c", "d"], 8)
    x = classes.where("fault_label IS NOT NULL").select("seq", "a", "c", "d").toPandas()
    numbers = classes.select("seq", binning.row_number(("device_id", "seq")).alias("number"))
    rows = binning.coded_rows(classes, borders, "fault_label", ("device_id", "seq")).join(numbers, "number").toPandas().merge(x, on="seq")
    assert len(rows) == 3000
    codes = np.array([list(c) for c in rows["codes"]])
    for f, name in enumerate(["a", "c", "d"]):
        finite = np.flatnonzero(np.isfinite(borders.values[f]))
        assert (np.diff(borders.values[f][finite]) > 0).all()
        for b in finite:
            assert ((codes[:, f] <= b) == (rows[name].to_numpy() <= borders.values[f][b])).all()


def test_boosting_is_as_good_as_one_against_all(classes):
    """Softmax boosting against MLlib's binary boosting of each label, with equal rounds and depth."""
    names = ["a", "b", "c", "d"]
    split = stratified_split(classes.where("fault_label IS NOT NULL"))
    train, test = split.where("NOT is_test").persist(), split.where("is_test").persist()
    model = boosting.fit_boosted(train, names, rounds=15, depth=3)
    assert model.labels == [0, 2, 5] and len(model.roots) == 45
    found = learn.probabilities(test, boosted=model).toPandas()
    p = np.array(found["gb"].tolist())
    assert np.allclose(p.sum(axis=1), 1) and not p[:, [1, 3, 4, 6, 7, 8, 9]].any()
    mine = (p.argmax(axis=1) == found["fault_label"]).mean()
    vectors = VectorAssembler(inputCols=names, outputCol="features")
    votes = []
    for k in model.labels:
        rows = vectors.transform(train.withColumn("label", (F.col("fault_label") == k).cast("double")))
        fitted = GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.1, subsamplingRate=0.8, seed=1).fit(rows)
        votes.append(fitted.transform(vectors.transform(test)).orderBy("seq").select("probability").toPandas()["probability"].map(lambda v: v[1]))
    true = test.orderBy("seq").toPandas()["fault_label"]
    theirs = (np.array(model.labels)[np.argmax(votes, axis=0)] == true).mean()
    assert mine > 0.9 and mine >= theirs - 0.01


def test_boosting_sums_are_those_of_the_whole_table(spark, classes, monkeypatch):
    """Many blocks in many tasks find the splits that one block finds, and rewriting the scores changes nothing."""
    names = ["a", "b", "c", "d"]
    whole = boosting.fit_boosted(classes, names, rounds=4, depth=3)
    monkeypatch.setattr(binning, "BLOCK_ROWS", 100)
    monkeypatch.setattr(boosting, "TASK_FLOOR", 500)
    monkeypatch.setattr(boosting, "KEPT_ROUNDS", 1)
    parts = boosting.fit_boosted(classes, names, rounds=4, depth=3)
    assert whole.roots.tolist() == parts.roots.tolist() and whole.feature.tolist() == parts.feature.tolist()
    assert np.allclose(whole.value, parts.value, atol=1e-5) and whole.border.tolist() == parts.border.tolist()


def test_boosting_by_label_grows_the_trees_of_passes(spark, classes, monkeypatch):
    """A round is one pass where every worker may hold all rows; the trees are those of a pass for every level."""
    names = ["a", "b", "c", "d"]
    monkeypatch.setattr(boosting, "TASK_FLOOR", 500)

    def fitted(rounds):
        spark.sparkContext.setJobGroup(f"boosting-{rounds}", "")
        found = boosting.fit_boosted(classes, names, rounds=rounds, depth=4)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{rounds}"))

    (shared, jobs), (_, fewer) = fitted(6), fitted(2)
    assert jobs - fewer == 4
    monkeypatch.setattr(boosting, "SHARED_BYTES", 0)
    passes = boosting.fit_boosted(classes, names, rounds=6, depth=4)
    assert shared.roots.tolist() == passes.roots.tolist() and shared.levels == passes.levels
    x = np.array([[a, b, 7.0, d] for a in np.linspace(-2, 2, 21) for b in np.linspace(-2, 2, 21) for d in (0.0, 1.0)])
    assert np.allclose(shared.probabilities(x), passes.probabilities(x), atol=1e-5)


def test_trees_without_sums_of_larger_children_are_the_same():
    """With all nodes summed up on their own; one feature has no other to be paired with."""
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 8, (5, 4000)).astype(np.uint8)
    p = rng.integers(1, 64, 4000) / 64
    true = (codes[0] > 3) ^ (codes[2] > 5) ^ (rng.random(4000) < 0.1)
    g, h, rows = true - p, p * (1 - p), np.flatnonzero(rng.random(4000) < 0.8)
    tree = boosting.grown(boosting.paired(codes, 8), rows, g, h, 5, 8, 6, 1, 3)
    trees, active = [boosting.Tree() for _ in range(3)], [[], [0], []]
    for _ in range(6):
        at = trees[1].walk(codes)[rows]
        parts = [rows[at == node] for node in active[1]]
        table = np.array([[[np.bincount(c[part], x[part], 8) for c in codes] for part in parts] for x in (g, h)])
        active = boosting.extended(trees, active, [(1, *s) for s in boosting.best_splits(table)])
    assert tree == trees[1] and len(tree.feature) > 20
    margins = np.zeros(4000)
    boosting.add_tree(margins, tuple(np.array(getattr(tree, c)) for c in ("feature", "bin", "below", "above", "value")), boosting.paired(codes, 8), 8)
    assert np.array_equal(margins, np.array(tree.value)[tree.walk(codes)])


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(4)
    codes, true = rng.integers(0, 6, (3, 400)).astype(np.uint8), rng.integers(0, 2, 400)
    g, h = (true - 0.3), np.full(400, 0.21)
    table = np.stack([[[np.bincount(c, x, 6) for c in codes]] for x in (g, h)])
    (slot, feature, bin, gain, *_), = boosting.best_splits(table)
    value = lambda part: g[part].sum() ** 2 / (h[part].sum() + boosting.PENALTY)
    gains = {(f, b): value(codes[f] <= b) + value(codes[f] > b) - value(codes[f] < 9) for f in range(3) for b in range(5)}
    assert slot == 0 and np.isclose(gain, max(gains.values())) and np.isclose(gains[feature, bin], gain)


def test_forest_nodes_are_split_best():
    rng = np.random.default_rng(5)
    codes, true = rng.integers(0, 6, (3, 300)).astype(np.uint8), rng.integers(0, 3, 300)
    weight, slot = rng.random(300), rng.integers(0, 2, 300)
    choice = np.array([[0, 2], [1, 0]])
    feature, bin, gain = bagging.split_nodes(codes, true, weight, slot, choice, 3, 6)
    purity = lambda rows: (np.bincount(true[rows], weight[rows], 3) ** 2).sum() / weight[rows].sum()
    for node in range(2):
        own = slot == node
        gains = {(f, b): purity(own & (codes[f] <= b)) + purity(own & (codes[f] > b)) - purity(own) for f in choice[node] for b in range(5)}
        assert np.isclose(gain[node], max(gains.values())) and np.isclose(gains[feature[node], bin[node]], gain[node])


def test_trees_draw_with_replacement(spark):
    rows = spark.range(20_000).select(F.xxhash64("id").alias("number"))
    for rate in (1.0, 0.05):
        drawn = bagging.bags(rows, 20, rate, 3).toPandas()
        total = sum(bagging.times_drawn(part["number"].to_numpy(), int(t), rate, 3).sum() for t, part in drawn.groupby("tree"))
        assert abs(total - 20 * 20_000 * rate) < 5 * (20 * 20_000 * rate) ** 0.5 and drawn["tree"].nunique() == 20
        assert not drawn.duplicated().any()


def test_folds_are_those_of_separate_fits(spark, classes):
    """Trees of a fold, grown with all others in one pass, are those of a fit on the rows outside the fold."""
    names = ["a", "b", "c", "d"]
    rows, borders, counts = bagging.prepared(classes, names, "fault_label", ("device_id", "seq"))
    forests = bagging.grow_forests(rows, borders, counts, 3, 4, 4, Settings(), 42)
    for fold in range(3):
        alone = bagging.grow_forests(rows.where(bagging.fold_of(3, 42) != fold), borders, counts, 0, 4, 4, Settings(), 42)[0]
        assert all(np.array_equal(getattr(alone, c), getattr(forests[fold], c)) for c in ("feature", "border", "below", "above"))
    scores = learn.fold_scores(classes, names, folds=3, trees=10, depth=6).toPandas()
    assert len(scores) == 3 and (scores["f1"] > 0.85).all()
    found = learn.cross_validate(classes, names, folds=3, trees=10, depth=6).first()
    assert np.isclose(found["cv_mean"], scores["f1"].mean()) and np.isclose(found["cv_std"], scores["f1"].std(ddof=0))


def test_cross_validation_shares_one_forest_at_a_time(classes, monkeypatch):
    """The driver holds the trees of a fold, not those of all, and their scores are those of the folds' own forests."""
    names, shared, share = ["a", "b", "c", "d"], [], learn.share_for_now
    monkeypatch.setattr(learn, "share_for_now", lambda spark, forest: shared.append(forest) or share(spark, forest))
    found = {r["fold"]: r["f1"] for r in learn.fold_scores(classes, names, folds=3, trees=7, depth=5).collect()}
    assert [len(forest.roots) for forest in shared] == [7, 7, 7]
    rows = classes.where("fault_label IS NOT NULL").withColumn("number", binning.row_number(("device_id", "seq")))
    for fold, forest in enumerate(shared):
        part = rows.where(bagging.fold_of(3, 42) == fold).toPandas()
        said, true = forest.probabilities(part[names].to_numpy(float)).argmax(axis=1), part["fault_label"].to_numpy()
        f1 = sum(2 * ((said == k) & (true == k)).sum() / ((said == k).sum() + (true == k).sum()) * (true == k).sum() for k in (0, 2, 5)) / len(true)
        assert np.isclose(found[fold], f1)


def test_trees_are_fetched_in_parts(spark, classes, monkeypatch):
    names = ["a", "b", "c", "d"]
    whole = bagging.fit_random_forest(classes, names, trees=5, depth=5)
    monkeypatch.setattr(bagging, "TREES_AT_ONCE", 2)
    parts = bagging.fit_random_forest(classes, names, trees=5, depth=5)
    for column in ("roots", "feature", "border", "below", "above", "gain", "shares"):
        assert np.array_equal(getattr(whole, column), getattr(parts, column))
    assert whole.shares.shape == (len(whole.feature), 10) and np.allclose(whole.shares.sum(axis=1), 1)


def test_training_windows_are_computed_once(small):
    """Labels are counted without the features; the rows and their parts are those of counting and splitting the windows themselves."""

    def fails(batches):
        raise RuntimeError("computed")

    learn.bounded_rows(small.mapInPandas(fails, small.schema), counted=small)
    settings = Settings(labelled_rows=200)
    found = scoring.training_windows(small, settings)
    expected = stratified_split(learn.bounded_rows(features.sliding_features(small, settings=settings), settings=settings))
    assert frame(found.drop(*features.FEATURE_NAMES), "device_id", "seq").equals(frame(expected.drop(*features.FEATURE_NAMES), "device_id", "seq"))
    for split in ({}, {"limit": 50, "chunk": 40}):  # with copies of neighbouring rows too
        series = ordered(small, behind=29, **split)
        assert learn.label_counts(series.own(series.df).where("pos >= 30")) == learn.label_counts(features.sliding_features(small))


def test_f1_is_that_of_the_report(spark):
    rows = [(0, 0, 0, 5), (0, 0, 1, 2), (0, 1, 1, 4), (0, 2, 1, 3), (1, 1, 1, 1)]
    counted = spark.createDataFrame(rows, "fold int, label int, predicted int, n long")
    found = {r["fold"]: r["f1"] for r in learn.f1_by(counted, "fold").collect()}
    assert np.isclose(found[0], classification_metrics(counted.where("fold = 0").drop("fold")).first()["f1_weighted"]) and found[1] == 1


def test_labelled_rows_are_bounded(spark):
    df = spark.range(20_000).select(F.lit(1).alias("device_id"), F.col("id").alias("seq"), F.when(F.col("id") % 10 == 0, 3).otherwise(0).alias("fault_label"))
    found = learn.label_counts(learn.bounded_rows(df, settings=Settings(labelled_rows=6_000)))
    assert found[3] == 2_000 and abs(found[0] - 3_000) < 250
    assert learn.bounded_rows(df).count() == 20_000


def test_save_and_load(spark, labelled, tmp_path):
    path = f"{tmp_path}/models"
    assert scoring.load(spark, path) is None
    first = scoring.fit_or_load(spark, path, labelled, trees=5, depth=3, rounds=1)
    again = scoring.fit_or_load(spark, path, None)
    a, b = (scoring.score_readings(labelled, m).orderBy("device_id", "seq").toPandas() for m in (first, again))
    assert len(a) == 6 * 91 and {"score", "is_anomaly", "is_outlier", "fault_name", "confidence", "top"} <= set(a.columns)
    assert a["decision"].round(9).equals(b["decision"].round(9)) and a["fault_id"].equals(b["fault_id"])
    assert (a["fault_id"] == a["fault_label"]).mean() > 0.95


def repeating(spark, devices):
    """Loads with a period of six readings; ``devices`` has the rows of each."""
    rows = [(d, n, 230.0 + n % 4, 1.0 + n % 2, float(100 * (d + 1) + 50 * (n % 6))) for d, size in devices.items() for n in range(size)]
    df = spark.createDataFrame(rows, "device_id long, seq long, voltage double, current double, power double")
    return df.withColumn("ts", F.timestamp_seconds(F.col("seq") + 1_700_000_000).cast("timestamp_ntz"))


def test_large_forests_are_saved_in_parts(spark, classes, monkeypatch, tmp_path):
    """No task is sent all nodes; they are read in parts too, in their order."""
    model = bagging.fit_random_forest(classes, ["a", "b", "c", "d"], trees=4, depth=5)
    monkeypatch.setattr(bagging, "NODES_AT_A_TIME", 7)
    model.save(spark, f"{tmp_path}/f")
    assert len(list((tmp_path / "f/nodes").glob("*.parquet"))) == -(-len(model.feature) // 7) > 3
    again = bagging.Bagged.load(spark, f"{tmp_path}/f")
    for column in ("names", "roots", "feature", "border", "below", "above", "gain", "shares", "levels"):
        assert np.array_equal(getattr(model, column), getattr(again, column))
    assert again.shares.dtype == np.float32


def test_forecaster_learns_a_repeating_load(spark):
    settings = Settings(lookback=12, horizon=3)
    df = repeating(spark, {1: 300})
    found = forecaster.forecaster_metrics(df, forecaster.fit_forecaster(df, settings)).first()
    assert found["val_mae"] < 0.02 and found["n"] == 3 * (286 - 243)


@pytest.mark.parametrize("split", [{}, {"limit": 50, "chunk": 64}])
def test_forecaster_is_separate_least_squares(spark, split):
    settings = Settings(lookback=5, horizon=3)
    rng = np.random.default_rng(8)
    sizes = {1: 400, 2: 90, 3: 6}
    rows = [(d, n, *map(float, rng.normal(100, 9, 3))) for d, size in sizes.items() for n in range(size)]
    df = spark.createDataFrame(rows, "device_id long, seq long, power double, voltage double, current double")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("seq")).cast("timestamp_ntz"))
    model = forecaster.fit_forecaster(df, settings, **split)
    xs, ys = [], []
    for d in sizes:
        values = np.array([r[2:] for r in rows if r[0] == d])
        scaled = (values - values.min(axis=0)) / (values.max(axis=0) - values.min(axis=0))
        samples = max(len(values) - 7, 0)
        for n in range(int(np.floor(samples * 0.85))):
            xs.append([*scaled[n : n + 5].ravel(), 1.0])
            ys.append(scaled[n + 5 : n + 8, 0])
    x, y = np.array(xs), np.array(ys)
    held = np.sqrt(forecaster.PENALTY * len(x)) * np.eye(16)
    held[15, 15] = 0
    for step in range(3):
        alone = np.linalg.lstsq(np.vstack([x, held]), np.concatenate([y[:, step], np.zeros(16)]), rcond=None)[0]
        assert np.allclose(model.weights[:, step], alone, atol=1e-6)


def test_saved_forecaster_says_watts(spark, tmp_path):
    """Known devices by the model, beyond the horizon along the line, and devices it cannot serve by line and season."""
    settings = Settings(lookback=12, horizon=6)
    df = repeating(spark, {1: 300, 2: 299, 3: 8})
    forecaster.fit_forecaster(df.where("device_id < 3"), settings).save(spark, f"{tmp_path}/f")
    model = forecaster.Forecaster.load(spark, f"{tmp_path}/f")
    found = model.forecast(df, 8).toPandas().sort_values(["device_id", "step"])
    assert len(found) == 24 and (found["upper"] >= found["forecast"])[found["device_id"] < 3].all() and (found["lower"] >= 0).all()
    for device, size in ((1, 300), (2, 299)):
        mine = found[found["device_id"] == device]
        true = [100 * (device + 1) + 50 * ((size + k) % 6) for k in range(6)]
        assert mine["is_learned"].all() and np.allclose(mine["forecast"].to_numpy()[:6], true, atol=4)
        slope = model.fits.where(f"device_id = {device}").first()["slope"]
        assert np.allclose(np.diff(mine["forecast"].to_numpy()[5:]), slope)
    strange = found[found["device_id"] == 3]
    assert not strange["is_learned"].any() and np.allclose(strange["forecast"], df.where("device_id = 3").toPandas()["power"].mean(), atol=1)


def test_trend_of_a_busy_device_has_no_join(spark):
    """Lines and phases come from one aggregate each, split or not."""
    df = repeating(spark, {1: 400, 2: 150, 3: 90})
    for split in ({}, {"limit": 50, "chunk": 64}):
        fits, seasons = forecast.fit_trend(df, **split)
        got = {r["device_id"]: r["period"] for r in fits.collect()}
        assert got == {1: 60, 2: 50, 3: 0}
        plan = seasons._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan.replace("_slice", "") or split  # split rows meet their places by (device, slice)


