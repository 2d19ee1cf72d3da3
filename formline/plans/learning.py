"""Model jobs (ML*). Scores depend on fitted models; what SQL can say about a job (folds, rows, labels) is compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formline.functions import columns as C
from formline.operators import history as H
from formline.operators import models as M
from formline.plans.registry import query
from formline.plans.views import E, entries
from formline.session import cut_lineage, release, scratch_path

FEATURES = ["jockey_rate", "jockey_course_rate", "trainer_rate", "horse_rate", "horse_surface_rate", "avg_finish_3r", "finish_trend", "rest_days", "distance", "going", "field", "carry", "odds"]
GROUPS = {"history": ["jockey_rate", "jockey_course_rate", "trainer_rate", "horse_rate", "horse_surface_rate"], "form": ["avg_finish_3r", "finish_trend", "rest_days"], "market": ["odds"], "pedigree": ["father_code", "bms_code"]}
#: Columns ranked anew on the training rows of every fold.
ENCODE = {"father": 20, "bms": 20}
CODED = [*FEATURES, *[f"{c}_code" for c in ENCODE]]
BOOSTED = M.boosting()
#: Cells of trainers and days that are sent to every task: some 20 MB.
FEW_CELLS = 500_000


def features(spark: SparkSession, sf: str) -> DataFrame:
    top3 = F.col("is_top3")
    # Written once: the starts, the cells of every rate and the rows they are joined to all read it, not the joins behind it.
    read = ["race_id", "runner_no", "race_date", "year", "horse_id", "jockey_id", "trainer_id", "course", "surface", "distance", "going", "field", "carry", "odds", "finish", "is_win", "is_top3"]
    rows = cut_lineage(entries(spark, sf, pedigree=True).select(*read, *ENCODE))
    release(spark)
    # Trainers are few, so their cells travel to the rows.
    e = H.expanding_rates(rows, "trainer_id", {"trainer_rate": ([], top3, 20.0)}, prior=0.5, few=FEW_CELLS)
    e = H.expanding_rates(e, "jockey_id", {"jockey_rate": ([], F.col("is_win"), 30.0), "jockey_course_rate": (["course"], F.col("is_win"), 10.0)}, prior=0.25, history=rows)
    # Written before the horses: one exchange of all rows lies on disk at a time.
    e = cut_lineage(e.select(*rows.columns, "trainer_rate", "jockey_rate", "jockey_course_rate"))
    release(spark)
    # One exchange by the horse, dealt by rows, serves its rates and its starts.
    e = H.expanding_rates(e, "horse_id", {"horse_rate": ([], top3, 5.0), "horse_surface_rate": (["surface"], top3, 5.0)}, prior=0.5, history=rows)
    e = H.form_features(H.starts(e, cols=["finish", "race_date"], depth=3)).withColumn("rest_days", H.rest_days(F.col("race_date"), H.previous_start(1, "race_date")))
    e = e.withColumn("segment", C.segment3(F.col("distance")))
    out = M.prepare(e.select("race_id", "runner_no", "race_date", "year", "segment", "is_top3", *ENCODE, *FEATURES), FEATURES, "is_top3")
    del e
    release(spark)
    return out


def walk(spark: SparkSession, sf: str, makers: dict[str, M.Maker]) -> DataFrame:
    """All years but the first, scored by models of the years before, written once."""
    rows = features(spark, sf)
    scored = M.walk_forward(rows, CODED, "is_top3", M.test_years(rows), makers, ENCODE)
    return M.cut_lineage(scored.select("race_id", "runner_no", "fold", "is_top3", *makers))


FOLDS = E + ", folds AS (SELECT race_id, runner_no, CAST(year AS INT) AS fold, is_top3 FROM entries WHERE year > (SELECT min(year) FROM entries))\n"


@query("ml1_walk_forward")
def ml1(spark: SparkSession, sf: str) -> DataFrame:
    return M.fold_auc(walk(spark, sf, {"gbt": BOOSTED}), ["gbt"], "is_top3")


@query("ml1_fold_counts", FOLDS + "SELECT fold, 'gbt' AS model, CAST(sum(is_top3) AS BIGINT) AS positives, CAST(sum(1 - is_top3) AS BIGINT) AS negatives, true AS beats_chance FROM folds GROUP BY fold")
def ml1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ml1(spark, sf).withColumn("beats_chance", F.col("auc") > 0.5).drop("auc")


@query("ml2_boosted_scores")
def ml2(spark: SparkSession, sf: str) -> DataFrame:
    return walk(spark, sf, {"gbt": BOOSTED}).select("race_id", "runner_no", "fold", "gbt")


@query("ml2_scored_rows", FOLDS + "SELECT race_id, runner_no, fold, true AS is_probability FROM folds")
def ml2_rows(spark: SparkSession, sf: str) -> DataFrame:
    return ml2(spark, sf).select("race_id", "runner_no", "fold", F.col("gbt").between(0, 1).alias("is_probability"))


@query("ml3_segment_models")
def ml3(spark: SparkSession, sf: str) -> DataFrame:
    rows = features(spark, sf)
    return M.segment_models(rows, CODED, "is_top3", M.test_years(rows), "segment", ["sprint", "middle", "long"], BOOSTED, ENCODE)


@query("ml4_ensemble")
def ml4(spark: SparkSession, sf: str) -> DataFrame:
    makers = {"gbt": BOOSTED, "logit": M.logistic(20), "mlp": M.perceptron((8,), 20)}
    names = list(makers)
    scored = walk(spark, sf, makers)
    table = M.cut_lineage(M.fold_auc(scored, names, "is_top3"))
    averaged = M.weighted_average(scored, table, names)
    # The first fold has no stack, so it is counted for the average alone.
    return table.unionByName(M.fold_auc(averaged, ["average"], "is_top3")).unionByName(M.fold_auc(M.stacked(averaged, names, "is_top3"), ["stack"], "is_top3"))


@query("ml5_importances")
def ml5(spark: SparkSession, sf: str) -> DataFrame:
    rows = features(spark, sf)
    train, _ = M.fold_of(rows, M.test_years(rows)[-1] + 1, ENCODE)
    return M.importances(spark, BOOSTED(CODED, "is_top3").fit(train), CODED, {f: g for g, fs in GROUPS.items() for f in fs})


@query("ml6_ablation")
def ml6(spark: SparkSession, sf: str) -> DataFrame:
    rows = features(spark, sf)
    return M.ablation(rows, CODED, "is_top3", M.test_years(rows), GROUPS, BOOSTED, ENCODE)


@query("ml6_forward_selection")
def ml6_forward(spark: SparkSession, sf: str) -> DataFrame:
    rows = features(spark, sf)
    return M.forward_selection(rows, ["jockey_rate", "carry"], ["odds", "avg_finish_3r", "father_code"], "is_top3", M.test_years(rows), BOOSTED, encode=ENCODE)


CODED_SQL = """
, p AS (SELECT e.year, p_brand AS father, p_type AS bms FROM entries e JOIN part ON p_partkey = horse_id),
y AS (SELECT DISTINCT CAST(year AS INT) AS fold FROM p WHERE year > (SELECT min(year) FROM p)),
c AS (SELECT fold, 'father' AS name, father AS value, count(*) AS n FROM p, y WHERE p.year < fold GROUP BY ALL UNION ALL SELECT fold, 'bms', bms, count(*) FROM p, y WHERE p.year < fold GROUP BY ALL)
"""


@query("ml1_fold_codes", E + CODED_SQL + "SELECT fold, name, value, code FROM (SELECT *, row_number() OVER (PARTITION BY fold, name ORDER BY n DESC, value) - 1 AS code FROM c) WHERE code < 20")
def ml1_codes(spark: SparkSession, sf: str) -> DataFrame:
    """Codes of all folds from one scan: no value is ranked by rows of its fold's year."""
    rows = entries(spark, sf, pedigree=True)
    return M.fold_codes(M.fold_counts(rows, ENCODE), M.test_years(rows), ENCODE)


@query("ml1_fold_cuts", E + """
, y AS (SELECT DISTINCT CAST(year AS INT) AS fold FROM entries WHERE year > (SELECT min(year) FROM entries))
SELECT fold, quantile_cont(CAST(strftime(race_date, '%Y%m%d') AS INT), 0.85) AS cut FROM entries, y WHERE year < fold GROUP BY fold
""")
def ml1_cuts(spark: SparkSession, sf: str) -> DataFrame:
    rows = entries(spark, sf)
    return M.fold_cuts(M.fold_counts(rows, {}), M.test_years(rows))


@query("snk1_model_store", FOLDS + "SELECT count(DISTINCT fold) AS first_fits, CAST(0 AS BIGINT) AS second_fits, count(*) AS rows, count(*) AS same_score FROM folds")
def snk1_models(spark: SparkSession, sf: str) -> DataFrame:
    """The walk-forward twice with one store: the second run fits nothing and scores alike."""
    rows, root = features(spark, sf), scratch_path(spark, "models")
    years, snapshot = M.test_years(rows), M.content_hash(rows)
    parts, runs, fits = M.folds(rows, years, ENCODE), [], []
    for name in ("first", "second"):
        store = M.ModelStore(spark, root)
        runs.append(scored_as(parts, name, store, snapshot))
        fits.append(store.fits)
    both = runs[0].join(runs[1], ["race_id", "runner_no"])
    return both.agg(F.count("*").alias("rows"), F.count_if(F.col("first") == F.col("second")).alias("same_score")).select(
        F.lit(fits[0]).cast("bigint").alias("first_fits"), F.lit(fits[1]).cast("bigint").alias("second_fits"), "rows", "same_score"
    )


def scored_as(parts, name: str, store: M.ModelStore, snapshot: str) -> DataFrame:
    scored = M.scored_folds(parts, {"gbt": (CODED, BOOSTED)}, "is_top3", store, snapshot)
    return M.cut_lineage(scored.select("race_id", "runner_no", F.col("gbt").alias(name)))
