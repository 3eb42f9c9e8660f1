import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from tollguard.operators import forest, medians
from tollguard.operators.medians import exact_medians
from tollguard.operators.ranks import rank_values
from tollguard.plans import model


def numbers(spark, values, parts=4):
    return spark.createDataFrame([(v,) for v in values], "x double").repartition(parts)


VALUE_SETS = {
    "distinct": [i * 0.37 - 50 for i in random.Random(1).sample(range(900), 501)],
    "ties": [float(v % 3) for v in range(400)],
    "one heavy": [1.0] * 350 + [float(v) for v in range(150)],
    "boundary": [0.0] * 200 + [1.0] * 200,
    "boundary odd": [0.0] * 201 + [1.0] * 200,
    "single": [4.2],
}


@pytest.mark.parametrize("name", VALUE_SETS)
def test_exact_median_narrows_to_the_right_value(spark, name):
    values = VALUE_SETS[name]
    for fetch_rows in (10_000, 8):
        got = exact_medians(numbers(spark, values + [None]), ["x"], fetch_rows)
        assert got == {"x": pytest.approx(np.median(values), abs=0)}


@pytest.mark.parametrize("fetch_rows, most", [(20_000, 2), (400, 2), (30, 3)])
def test_medians_take_few_reads(spark, monkeypatch, fetch_rows, most):
    """Brackets of a bounded share are counted and fetched in one read."""
    df = spark.range(0, 200_001, 1, 7).selectExpr("cast(id * 7919 % 200001 as double) as x", "cast(id % 5 as double) as y",
                                                   "if(id % 2 = 0, -exp(id / 10000.0), null) as z")
    reads = []
    frame = type(df)
    plain = frame.agg
    monkeypatch.setattr(frame, "agg", lambda self, *a: reads.append(1) or plain(self, *a))
    got = exact_medians(df, ["x", "y", "z"], fetch_rows)
    assert (got["x"], got["y"]) == (100_000.0, 2.0) and len(reads) <= most
    assert got["z"] == pytest.approx(-np.exp(10.0), rel=1e-12)


def test_brackets_of_all_ranks_are_counted_in_one_read(spark):
    """Per rank: values below, at the lower end, below and at the upper end, and the one of the rank inside."""
    df = spark.range(0, 1000, 1, 5).selectExpr("if(id % 10 = 9, double('NaN'), double(id % 100)) as x", "double(id) as y")
    ranks = [medians._Rank("x", 450, 900, (40.0, 60.0)), medians._Rank("y", 500, 1000, (490.0, 510.0))]
    assert medians._answers(df, ranks, 1100) == [(360, 10, 540, 10, 50.0), (490, 1, 510, 1, 500.0)]
    many = medians._answers(df, ranks, 1)
    assert [a[:4] for a in many] == [(360, 10, 540, 10), (490, 1, 510, 1)] and len(many[0][4]) == medians.STEPS + 1


def test_median_of_several_columns_and_an_empty_one(spark):
    df = spark.createDataFrame(
        [(1.0, None, 5), (2.0, None, 6), (9.0, None, None)], "a double, b double, c int"
    )
    assert exact_medians(df, ["a", "b", "c"]) == {"a": 2.0, "b": None, "c": 5.5}


@pytest.mark.parametrize("name", VALUE_SETS)
@pytest.mark.parametrize("range_rows", [10_000, 30])
def test_ranking_equals_a_sort(spark, name, range_rows):
    values = VALUE_SETS[name]
    ranking = rank_values(numbers(spark, values + [None, None]), "x", range_rows)
    got = {r["value"]: (r["rows"], r["rows_below"]) for r in ranking.table.collect()}
    expected = {v: (values.count(v), 2 + sum(w < v for w in values)) for v in set(values)}
    assert got == expected | {None: (2, 0)}
    assert (ranking.total, ranking.nulls) == (len(values) + 2, 2)
    ordered = sorted(values)
    for percent in (0, 1, 25, 50, 100):
        place = max(-(-percent * len(values) // 100) - 1, 0)
        assert ranking.percentiles([percent]) == [ordered[place]]
    for q in (0.0, 0.01, 0.5, 1.0):
        assert ranking.interpolated(q) == pytest.approx(np.quantile(values, q), rel=1e-12)


def train_table(spark, n=400, parts=3):
    rnd = random.Random(5)
    data = [(f"{i:04d}", "T", rnd.gauss(10, 1), rnd.gauss(0, 2), None, i % 7, True, 3.0) for i in range(n)]
    data.append(("zzzz", "T", 90.0, -60.0, None, 500, False, 3.0))
    return spark.createDataFrame(
        data,
        "transaction_id string, tag_plate_number string, amount double, z double, "
        "distance_miles double, n long, flag_x boolean, same double",
    ).repartition(parts)


def test_features_are_numeric_and_no_ids_or_flags(spark):
    assert model.feature_names(train_table(spark)) == ["amount", "z", "distance_miles", "n", "same"]


def test_impute_drops_and_names_empty_columns(spark):
    matrix, dropped = model.impute_median(model.feature_matrix(train_table(spark)))
    assert dropped == ["distance_miles"]
    assert matrix.filter(F.col("amount").isNull()).count() == 0


def test_scaling_uses_population_std_and_keeps_constants(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.1), ("b", 3.0, 0.1), ("c", 5.0, 0.1)], "transaction_id string, x double, c double"
    )
    got = rows(model.standard_scale(df))
    deviation = np.std([1.0, 3.0, 5.0])
    assert [r[1] for r in got] == pytest.approx([-2 / deviation, 0.0, 2 / deviation])
    assert [r[2] for r in got] == pytest.approx([0.0, 0.0, 0.0], abs=1e-12)


def test_expected_path():
    assert [forest.expected_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert forest.expected_path(256) == pytest.approx(10.2448, abs=1e-4)


def test_tree_isolates_every_row_within_its_depth(spark):
    df = spark.createDataFrame([(t, x, 3.0) for t in (0, 1) for x in (0.0, 1.0, 2.0, 100.0)], "tree int, x double, same double")
    nodes = forest.grow_trees(df, ["same", "x"], 10).collect()
    for t in (0, 1):
        own = {n.node: n for n in nodes if n.tree == t}
        leaves = [n for n in own.values() if n.left == n.node]
        assert len(own) == 7 and len(leaves) == 4 and all(n.feature == 1 for n in own.values() if n not in leaves)
        assert all({n.left, n.right} <= set(own) for n in own.values())
        # one row each, as deep as its number in the heap says
        assert all(n.path == (n.node + 1).bit_length() - 1 for n in leaves)
    shallow = forest.grow_trees(df, ["same", "x"], 1).collect()
    assert len(shallow) == 6
    same = forest.grow_trees(df, ["same"], 8).collect()
    assert [tuple(n) for n in same if n.tree == 0] == [(0, 0, 0, np.inf, 0, 0, pytest.approx(forest.expected_path(4)))]


def test_scores_follow_a_hand_built_tree():
    grid = lambda *v: np.array([v])
    tree = forest.Forest(
        ["x"], 4, 2, grid(0, 0, 0), grid(5.0, np.inf, np.inf), grid(1, 1, 2), grid(2, 1, 2),
        grid(0.0, 1.0, 3.0),
    )
    got = forest.raw_scores(tree, np.array([[5.0], [6.0]]))
    usual = forest.expected_path(4)
    assert got == pytest.approx([-(2 ** (-1 / usual)), -(2 ** (-3 / usual))])


def test_forest_depends_on_seed_and_data_not_on_partitions(spark):
    features = ["amount", "z", "n"]
    first = forest.fit_forest(train_table(spark, parts=1), "transaction_id", features, trees=5)
    again = forest.fit_forest(train_table(spark, parts=9), "transaction_id", features, trees=5)
    other = forest.fit_forest(train_table(spark), "transaction_id", features, trees=5, seed=1)
    assert np.array_equal(first.threshold, again.threshold)
    assert not np.array_equal(first.threshold, other.threshold)


def test_non_finite_values_count_as_missing(spark):
    values = [1.0, 2.0, 9.0, *[float("nan")] * 40, float("inf"), -float("inf"), None]
    for fetch_rows in (10_000, 2):
        assert exact_medians(numbers(spark, values), ["x"], fetch_rows) == {"x": 2.0}
    df = numbers(spark, values).selectExpr("'a' as transaction_id", "x")
    filled, dropped = model.impute_median(df)
    assert dropped == [] and filled.filter("x = 2.0").count() == 44


def test_samples_are_drawn_by_one_rule(spark):
    df = spark.range(20_000).select(
        F.md5(F.col("id").cast("string")).alias("transaction_id"), F.col("id").cast("double").alias("x")
    )
    drawn, taken = forest.draw_samples(
        df, "transaction_id", ["x"], trees=4, sample_rows=64
    )
    trees = drawn.groupBy("tree").agg(F.count(F.lit(1)), F.countDistinct("_id"), F.avg("x")).collect()
    assert taken == 64 and [(r[1], r[2]) for r in trees] == [(64, 64)] * 4
    assert all(6000 < r[3] < 14000 for r in trees)
    few, taken = forest.draw_samples(df.limit(50), "transaction_id", ["x"], trees=4, sample_rows=64)
    assert taken == 50 and few.count() == 200


def test_planted_outlier_scores_lowest_and_one_percent_is_flagged(spark):
    table = train_table(spark)
    fitted = model.isolation_forest_fit(table)
    scores = model.isolation_forest_score(fitted)
    assert scores.orderBy("raw_score").first()["transaction_id"] == "zzzz"
    cut = model.contamination_cut(scores)
    flagged = cut.filter("is_anomaly = 1")
    assert flagged.count() == 4  # the 1% quantile of 401 rows is rank 4 itself, and the cut is strict
    assert flagged.filter("ml_anomaly_score >= 0").count() == 0
    metrics = model.training_metrics(cut, "m", "2024-01-01 00:00:00", 2.0, 4).first()
    assert (metrics["n_samples"], metrics["n_anomalies"]) == (401, 4)
    assert metrics["score_std"] == pytest.approx(
        np.std([r["ml_anomaly_score"] for r in cut.collect()])
    )
