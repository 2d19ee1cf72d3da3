"""Folds see nothing of their test year: encoding, validation rows and weights."""

import datetime as dt

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import functions as F

from formline.operators import boosted
from formline.operators import models as M
from formline.operators.boosted import BoostedTrees
from formline.session import cut_lineage


def rows(spark):
    day = lambda y, i: dt.date(y, 1, 1) + dt.timedelta(days=i)
    data = [(y, day(y, i), "a" if y < 2002 else "b", float(i % 2)) for y in (2000, 2001, 2002) for i in range(100)]
    return spark.createDataFrame(data, "year long, race_date date, sire string, y double")


def test_years_but_the_first(spark):
    assert M.test_years(rows(spark)) == [2001, 2002]


def test_fold_is_encoded_on_training_rows_and_split_by_date(spark):
    train, test = M.fold_of(rows(spark), 2002, {"sire": 1})
    assert {r["sire_code"] for r in test.collect()} == {1.0}
    assert {r["sire_code"] for r in train.collect()} == {0.0}
    days = {v: {r["race_date"] for r in train.filter(f"is_valid = {v}").collect()} for v in ("true", "false")}
    assert not days["true"] & days["false"] and max(days["false"]) < min(days["true"]) and 20 <= len(days["true"]) <= 40


def test_weights_come_from_earlier_folds(spark):
    scored = spark.createDataFrame([(1, 0.2, 0.6), (2, 0.2, 0.6)], "fold int, a double, b double")
    table = spark.createDataFrame([(1, "a", 0.9), (1, "b", 0.3), (2, "a", 0.1), (2, "b", 0.99)], "fold int, model string, auc double")
    got = {r["fold"]: r["average"] for r in M.weighted_average(scored, table, ["a", "b"]).collect()}
    assert abs(got[1] - 0.4) < 1e-9 and abs(got[2] - (0.2 * 0.9 + 0.6 * 0.3) / 1.2) < 1e-9


def test_prepared_rows_lie_in_year_folders(spark):
    ready = M.prepare(rows(spark).withColumnRenamed("y", "label"), [], "label")
    assert ready.columns == ["year", "race_date", "sire", "label"] and ready.count() == 300
    assert "PartitionFilters: [isnotnull(year" in ready.filter("year < 2002")._jdf.queryExecution().executedPlan().toString()


def test_every_fold_and_variant_has_its_own_model(spark):
    data = rows(spark).withColumns({"same": F.col("y"), "flat": F.lit(0.0)})
    parts = M.folds(data, [2001, 2002])
    scored = M.scored_folds(parts, {"good": (["same"], M.logistic(5)), "bad": (["flat"], M.logistic(5))}, "y")
    assert {(r["fold"], r["year"]) for r in scored.select("fold", "year").distinct().collect()} == {(2001, 2001), (2002, 2002)}
    found = {(r["fold"], r["model"]): r["auc"] for r in M.fold_auc(scored, ["good", "bad"], "y").collect()}
    assert found == {(y, m): a for y in (2001, 2002) for m, a in (("good", 1.0), ("bad", 0.5))}
    assert M.fitted({}) == {}


def test_folds_from_one_scan_equal_single_folds(spark):
    data = rows(spark)
    for year, (train, test) in M.folds(data, [2001, 2002], {"sire": 1}).items():
        one = M.fold_of(data, year, {"sire": 1})
        for a, b in zip((train, test), one, strict=True):
            assert a.select(*b.columns).exceptAll(b).count() == 0 == b.exceptAll(a.select(*b.columns)).count()


def test_stored_models_are_not_fitted_again(spark, tmp_path):
    data = rows(spark).withColumn("same", F.col("y"))
    parts, variants = M.folds(data, [2001, 2002]), {"v": (["same"], M.logistic(5))}
    run = lambda store, snapshot: sorted(map(tuple, M.scored_folds(parts, variants, "y", store, snapshot).select("race_date", "v").collect()))
    fits, got = [], []
    for snapshot in ("a", "a", "b"):
        store = M.ModelStore(spark, str(tmp_path / "models"))
        got.append(run(store, snapshot))
        fits.append(store.fits)
    assert fits == [2, 0, 2] and got[0] == got[1] == got[2]
    # A model whose manifest is missing, as after a crash, is fitted again.
    for manifest in (tmp_path / "models").glob("*/manifest.json"):
        manifest.unlink()
    store = M.ModelStore(spark, str(tmp_path / "models"))
    assert run(store, "a") == got[0] and store.fits == 2
    assert M.content_hash(data) == M.content_hash(data.repartition(3)) != M.content_hash(data.limit(10))


def test_rows_are_filtered_before_their_vectors_are_made(spark):
    """The rows that stop the boosting are a few days: no vector of the others is made for them."""
    made = M.FeatureVector(["y"]).transform(rows(spark).withColumn("is_valid", F.col("race_date") > "2002-03-01")).filter("is_valid")
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("features") < plan.index("Filter")


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_vectors_of_missing_values_are_an_error(spark, bad):
    df = spark.createDataFrame([(1.0, 2), (bad, 3)], "a double, b long")
    assert M.FeatureVector(["a", "b"]).transform(df.filter("b = 2")).first()["features"].toArray().tolist() == [1.0, 2.0]
    with pytest.raises(Exception, match="NULL or NaN"):
        M.FeatureVector(["a", "b"]).transform(df).collect()


def test_codes_of_all_folds_are_written_not_joined_in_every_fit(spark):
    train, test = M.folds(rows(spark), [2001, 2002], {"sire": 1})[2002]
    assert all("Join" not in x._jdf.queryExecution().optimizedPlan().toString() for x in (train, test))


def test_rates_and_starts_of_a_horse_share_one_exchange(spark, monkeypatch):
    """Rows of the features are dealt by the horse once, not for the starts and again for the rates."""
    from formline.plans import learning as L

    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    data = [(i, 1, day(i), 2000, i % 2, i % 3, 7, 1, 0, 1200, 0, 8, 55.0, 3.0, 1 + i % 5, int(i % 5 == 0), int(i % 5 < 3), "a", "b") for i in range(10)]
    names = ["race_id", "runner_no", "race_date", "year", "horse_id", "jockey_id", "trainer_id", "course", "surface", "distance", "going", "field", "carry", "odds", "finish", "is_win", "is_top3", "father", "bms"]
    monkeypatch.setattr(L, "entries", lambda *a, **k: spark.createDataFrame(data, names))
    monkeypatch.setattr(L.M, "prepare", lambda df, *a: df)
    monkeypatch.setattr(L.H, "parts_for", lambda rows: 4)
    made = L.features(spark, "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(horse_id") == 1
    # The horse of race 4 ran in races 2 and 0 before: places 3 and 1, both among the first three.
    got = made.filter("race_id = 4").first()
    assert got["avg_finish_3r"] == (3 + 1 + 5) / 3 and got["rest_days"] == 2 and got["horse_rate"] == (2 + 0.5 * 5) / (2 + 5)


def test_boosting_goes_on_while_it_helps(spark):
    """One tree cannot tell a chance of many steps; the boosting ended after it."""
    data = spark.range(4000).select((F.col("id") % 40).cast("double").alias("a"), (F.col("id") % 25).cast("double").alias("b"), (F.col("id") % 10 >= 8).alias("is_valid"), F.col("id"))
    data = data.withColumn("y", ((F.sin(F.col("a")) + F.sin(F.col("b")) + (F.xxhash64("id") % 100) / 100.0) > 0).cast("double"))
    model = M.boosting()(["a", "b"], "y").fit(data).stages[-1]
    assert model.getNumTrees > 5


@pytest.mark.parametrize("rounds", [1, 4])
def test_boosting_equals_sparks(spark, rounds):
    """Same chances and importances as GBTClassifier, whose bins are the same where a feature has few values."""
    data = spark.range(6000).select((F.col("id") * 7919 % 29).cast("double").alias("a"), (F.col("id") * 104729 % 23 / 7.0).alias("b"), (F.col("id") % 13).cast("double").alias("c"), "id", F.lit(False).alias("is_valid"))
    data = data.withColumn("y", ((F.sin("a") + F.cos("b") * F.col("c") / 6 + (F.xxhash64("id") % 100) / 60.0) > 0).cast("double"))
    mine = BoostedTrees(["a", "b", "c"], "y", maxIter=rounds, subsamplingRate=1.0).fit(data)
    vectors = M.FeatureVector(["a", "b", "c"]).transform(data)
    theirs = GBTClassifier(labelCol="y", maxIter=rounds, maxDepth=5, subsamplingRate=1.0, minInstancesPerNode=50).fit(vectors)
    both = M.score(theirs, vectors, "p").join(M.score(mine, data, "q").select("id", "q"), "id")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-5
    assert max(abs(mine.featureImportances.toArray() - theirs.featureImportances.toArray())) < 1e-5


def test_boosting_does_not_depend_on_the_parts(spark, monkeypatch):
    """Residuals are added up as whole numbers; blocks and parts cut the rows anywhere."""
    data = spark.range(5000).select((F.rand(1) * 9).alias("a"), (F.col("id") % 7).cast("double").alias("b"), (F.col("id") % 11 > 8).alias("is_valid")).withColumn("y", (F.sin("a") * 3 + F.col("b") > 3).cast("double"))
    data = cut_lineage(data.coalesce(1))
    fit = lambda rows: BoostedTrees(["a", "b"], "y", maxIter=5, subsamplingRate=1.0).fit(rows).getOrDefault("trees")
    monkeypatch.setattr(boosted, "KEEP", 10_000)
    whole = fit(data)
    monkeypatch.setattr(boosted, "BLOCK", 700)
    monkeypatch.setattr(boosted, "PART_ROWS", 1000)
    assert fit(data.repartition(6)) == whole


def test_variants_grown_together_are_those_grown_alone(spark):
    data = cut_lineage(spark.range(4000).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 23).cast("double").alias("b"), (F.col("id") % 10 > 7).alias("is_valid"), (F.sin("id") + F.col("id") % 17 > 8).cast("double").alias("y")).coalesce(1))
    make = M.boosting(4, 3)
    jobs = {"both": (make(["a", "b"], "y"), data), "b": (make(["b"], "y"), data)}
    for name, model in M.fitted(jobs).items():
        alone, f = jobs[name][0].fit(data), lambda m: M.score(m, data, "p").agg(F.sum("p")).first()[0]
        assert f(model) == f(alone) and len(model.stages[-1].featureImportances.toArray()) == len(jobs[name][0].getStages()[0].getInputCols())


@pytest.mark.parametrize("change", ["a = NULL", "a = nan", "y = 2"])
def test_boosting_names_rows_it_cannot_learn_from(spark, change):
    data = spark.range(100).select(F.col("id").cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("y"), F.lit(False).alias("is_valid"))
    column, value = change.split(" = ")
    bad = data.withColumn(column, F.when(F.col("a") != 7, F.col(column)).otherwise(F.lit({"NULL": None, "nan": float("nan"), "2": 2.0}[value])))
    with pytest.raises(Exception, match="NULL or NaN|0 or 1"):
        M.boosting()(["a"], "y").fit(bad)
    with pytest.raises(ValueError, match="no rows"):
        M.boosting()(["a"], "y").fit(data.limit(0))


def test_model_queries_boost_by_the_operators_own_rounds():
    from formline.plans import learning as L

    trees = L.BOOSTED(["a"], "y").getStages()[-1]
    assert (trees.getOrDefault("maxIter"), trees.getOrDefault("maxDepth")) == (20, 5)


def test_features_deal_all_rows_once_at_a_time(spark, monkeypatch):
    """The rates of jockeys are written before the horses are dealt: two exchanges of all rows never lie on disk together."""
    from formline.plans import learning as L

    day = lambda i: dt.date(2000, 1, 1) + dt.timedelta(days=i)
    data = [(i, 1, day(i), 2000, i % 2, i % 3, 7, 1, 0, 1200, 0, 8, 55.0, 3.0, 1 + i % 5, int(i % 5 == 0), int(i % 5 < 3), "a", "b") for i in range(10)]
    names = ["race_id", "runner_no", "race_date", "year", "horse_id", "jockey_id", "trainer_id", "course", "surface", "distance", "going", "field", "carry", "odds", "finish", "is_win", "is_top3", "father", "bms"]
    monkeypatch.setattr(L, "entries", lambda *a, **k: spark.createDataFrame(data, names))
    monkeypatch.setattr(L.M, "prepare", lambda df, *a: df)
    monkeypatch.setattr(L.H, "parts_for", lambda rows: 4)
    freed = []
    monkeypatch.setattr(L, "release", lambda s: freed.append(s))
    made = L.features(spark, "")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(horse_id" in plan and "hashpartitioning(jockey_id" not in plan
    assert len(freed) == 3
    # The jockey of race 6 rode races 3 and 0 before; race 0 was won.
    assert made.filter("race_id = 6").first()["jockey_rate"] == (1 + 0.25 * 30) / (2 + 30)
