"""Walk-forward model jobs with pyspark.ml. The driver loops over folds and models; rows stay on the cluster."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Hashable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCols, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from formline.functions.columns import to_double
from formline.operators.boosted import BoostedTrees
from formline.operators.history import top_n_codes
from formline.operators.statistics import auc, date_cut, split_by_date
from formline.session import cut_lineage

Maker = Callable[[Sequence[str], str], Estimator]


class FeatureVector(Transformer, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric columns as one vector; NULL or NaN is an error. Unlike VectorAssembler it is deterministic, so Spark filters
    rows (those that stop the boosting, those of a segment) before it makes their vectors, not after."""

    def __init__(self, inputCols: Sequence[str] = (), outputCol: str = "features") -> None:
        super().__init__()
        self._set(inputCols=list(inputCols), outputCol=outputCol)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        def value(c: str) -> Column:
            v = F.col(c).cast("double")
            return F.when(v.isNotNull() & ~F.isnan(v), v).otherwise(F.raise_error(F.lit(f"feature {c} is NULL or NaN")).cast("double"))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(F.array(*[value(c) for c in self.getInputCols()])))


def boosting(iterations: int = 20, depth: int = 5, seed: int = 42) -> Maker:
    """Gradient-boosted trees, of which rows with `is_valid` judge the rounds: the trees up to the best one are kept."""

    def make(features: Sequence[str], label: str) -> Estimator:
        return Pipeline(stages=[BoostedTrees(inputCols=list(features), labelCol=label, maxIter=iterations, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, minInstancesPerNode=50, seed=seed, validationIndicatorCol="is_valid")])

    return make


def logistic(max_iter: int = 50) -> Maker:
    def make(features: Sequence[str], label: str) -> Estimator:
        return Pipeline(stages=[
            FeatureVector(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter),
        ])

    return make


def perceptron(hidden: Sequence[int] = (16,), max_iter: int = 40, seed: int = 42) -> Maker:
    def make(features: Sequence[str], label: str) -> Estimator:
        return Pipeline(stages=[
            FeatureVector(inputCols=list(features), outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True),
            MultilayerPerceptronClassifier(featuresCol="features", labelCol=label, layers=[len(features), *hidden, 2], maxIter=max_iter, seed=seed),
        ])

    return make


def prepare(df: DataFrame, features: Sequence[str], label: str, year: str = "year") -> DataFrame:
    """Typed features without NULLs, written once to the shared folder by year: a fold reads its years, not history."""
    ready = df.withColumns({f: to_double(f, 0.0) for f in features}).withColumn(label, F.col(label).cast("double"))
    return cut_lineage(ready, by=[year])


def test_years(df: DataFrame, year: str = "year") -> list[int]:
    """All years but the first, which has nothing before it to learn from. One row per calendar year."""
    return sorted(r[0] for r in df.select(year).distinct().filter(F.col(year).isNotNull()).collect())[1:]


def fold_of(df: DataFrame, year: int, encode: Mapping[str, int] | None = None, date: str = "race_date", valid_from: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of a year. Training rows from the date quantile `valid_from` on are `is_valid` (they stop the
    boosting), so no race is on both sides. `encode`: column → n gives `<column>_code`, ranked on the training rows alone.
    Cut and codes are found once; every model fitted on the fold reads the columns it needs."""
    train, test = df.filter(F.col("year") < year), df.filter(F.col("year") == year)
    train = split_by_date(train, date, valid_from, date_cut(train, date, valid_from).first()[0]).withColumn("is_valid", F.col("role") == "valid").drop("role")
    for col, n in (encode or {}).items():
        # n rows at most, so the broadcast has a bound.
        codes, code = F.broadcast(cut_lineage(top_n_codes(train, col, n))), f"{col}_code"
        train, test = (x.join(codes, col, "left").withColumn(code, F.coalesce(code, F.lit(n)).cast("double")) for x in (train, test))
    return train, test


#: Name of the days among the counted values.
DAY = "__day"


def fold_counts(df: DataFrame, encode: Mapping[str, int], date: str = "race_date") -> DataFrame:
    """How often each value of the columns to encode, and each day, occurs in a year: year, name, value (text), n. One scan
    for all columns, added up on the map side and written; whatever a fold needs follows from running sums over years."""
    pairs = [F.struct(F.lit(DAY).alias("name"), F.date_format(date, "yyyyMMdd").alias("value"))]
    pairs += [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in encode]
    each = df.select("year", F.explode(F.array(*pairs)).alias("x")).select("year", "x.*").filter(F.col("value").isNotNull() & F.col("year").isNotNull())
    return cut_lineage(each.groupBy("year", "name", "value").agg(F.count("*").alias("n")))


def _by_fold(counts: DataFrame, years: Sequence[int]) -> DataFrame:
    """Counts over the years before each fold. Cells are few, so each one is added to the folds after it."""
    later = F.filter(F.array(*[F.lit(y) for y in years]), lambda y: y > F.col("year"))
    return counts.withColumn("fold", F.explode(later)).groupBy("fold", "name", "value").agg(F.sum("n").alias("n"))


def fold_codes(counts: DataFrame, years: Sequence[int], encode: Mapping[str, int]) -> DataFrame:
    """fold, name, value, code: the most frequent values before each fold, coded from 0; ties go by the value's text."""
    if not encode:
        return counts.sparkSession.createDataFrame([], "fold int, name string, value string, code bigint")
    most = F.create_map(*[F.lit(x) for c, n in encode.items() for x in (c, n)])
    ranked = _by_fold(counts.filter(F.col("name") != DAY), years).withColumn("code", F.row_number().over(Window.partitionBy("fold", "name").orderBy(F.desc("n"), "value")) - 1)
    top = ranked.filter(F.col("code") < max(encode.values())).filter(F.col("code") < most[F.col("name")])
    return top.select("fold", "name", "value", F.col("code").cast("bigint").alias("code"))


def fold_cuts(counts: DataFrame, years: Sequence[int], valid_from: float = 0.85) -> DataFrame:
    """fold, cut: the date quantile (yyyymmdd) of the rows before each fold."""
    days = _by_fold(counts.filter(F.col("name") == DAY), years)
    return days.groupBy("fold").agg(F.percentile(F.col("value").cast("int"), F.lit(valid_from), F.col("n")).alias("cut"))


def score(model, df: DataFrame, name: str) -> DataFrame:
    """Add the probability of the positive class; the model's own columns go."""
    out = model.transform(df).withColumn(name, vector_to_array("probability")[1])
    return out.select(*df.columns, name)


def folds(df: DataFrame, years: Sequence[int], encode: Mapping[str, int] | None = None, date: str = "race_date") -> dict[int, tuple[DataFrame, DataFrame]]:
    """`fold_of` for all folds, with cuts and codes from one scan of the data."""
    encode = encode or {}
    counts = fold_counts(df, encode, date)
    # One row a fold, and at most n rows a fold and column.
    cuts = {r["fold"]: r["cut"] for r in fold_cuts(counts, years).collect()}
    codes = cut_lineage(fold_codes(counts, years, encode))
    rows, own = df, lambda col, y: f"__{col}_{y}"
    for col, n in encode.items():
        # One row a value that any fold codes; the codes of all folds are joined and written once, not in every pass of every fit.
        wide = codes.filter(F.col("name") == col).groupBy(F.col("value").alias("__value")).agg(*[F.max(F.when(F.col("fold") == y, F.col("code"))).alias(own(col, y)) for y in years])
        rows = rows.join(F.broadcast(wide), F.col(col).cast("string") == F.col("__value"), "left").drop("__value")
        rows = rows.withColumns({own(col, y): F.coalesce(own(col, y), F.lit(n)).cast("double") for y in years})
    rows = cut_lineage(rows, by=["year"]) if encode else rows
    out = {}
    for y in years:
        fold = rows.select(*df.columns, *[F.col(own(col, y)).alias(f"{col}_code") for col in encode])
        train, test = fold.filter(F.col("year") < y), fold.filter(F.col("year") == y)
        train = split_by_date(train, date, 0.0, cuts.get(y, 0.0)).withColumn("is_valid", F.col("role") == "valid").drop("role")
        out[y] = (train, test)
    return out


def content_hash(df: DataFrame) -> str:
    """A text that changes with the rows of a frame, but not with their order: a snapshot's name."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return f"{r['n']}-{r['h']}"


class ModelStore:
    """Fitted models below one folder, by what they were fitted on. A model's folder counts once its manifest names it, and
    the manifest is put in place by one rename, so a lost driver leaves whole models or none."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.fits = spark, root.rstrip("/"), 0
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def key(self, name: Hashable, estimator: Estimator, snapshot: str) -> str:
        stages = estimator.getStages() if isinstance(estimator, Pipeline) else [estimator]
        params = [[type(s).__name__, sorted((p.name, str(v)) for p, v in s.extractParamMap().items() if not str(v).startswith(s.uid))] for s in stages]
        return hashlib.sha256(json.dumps([str(name), params, snapshot]).encode()).hexdigest()[:32]

    def load(self, key: str) -> Model | None:
        manifest = self._path(f"{self.root}/{key}/manifest.json")
        if not self._files.exists(manifest):
            return None
        stream = self._files.open(manifest)
        folder = json.loads(bytes(stream.readAllBytes()).decode())["model"]
        stream.close()
        return PipelineModel.load(f"{self.root}/{key}/{folder}")

    def save(self, key: str, model: Model) -> None:
        folder = f"model-{uuid.uuid4().hex[:12]}"
        (model if isinstance(model, PipelineModel) else PipelineModel([model])).write().save(f"{self.root}/{key}/{folder}")
        draft = self._path(f"{self.root}/{key}/_{folder}.json")
        out = self._files.create(draft, False)
        out.write(bytearray(json.dumps({"model": folder}).encode()))
        out.close()
        self._files.rename(draft, self._path(f"{self.root}/{key}/manifest.json"))

    def fit(self, name: Hashable, estimator: Estimator, rows: DataFrame, snapshot: str) -> Model:
        """The stored model, or a new one, which is stored."""
        key = self.key(name, estimator, snapshot)
        model = self.load(key)
        if model is None:
            model = estimator.fit(rows)
            self.save(key, model)
            self.fits += 1
        return model


def fitted(jobs: Mapping[Hashable, tuple[Estimator, DataFrame]], parallel: int = 4, store: ModelStore | None = None, snapshot: str = "") -> dict[Hashable, Model]:
    """The model of each job, `parallel` fits at a time: one small fit does not fill a cluster. With a `store`, models that
    were fitted under the same name and parameters on the same data `snapshot` are loaded."""
    if not jobs:
        return {}
    # Trees on the same rows that differ in their features alone are grown in the same passes over them.
    groups: dict[Hashable, list[Hashable]] = {}
    for name, (estimator, rows) in jobs.items():
        trees = _trees(estimator) if store is None else None
        groups.setdefault(("alone", name) if trees is None else (id(rows), trees.settings()), []).append(name)

    def one(names: Sequence[Hashable]) -> dict[Hashable, Model]:
        estimator, rows = jobs[names[0]]
        if store is not None:
            return {names[0]: store.fit(names[0], estimator, rows, snapshot)}
        if len(names) == 1:
            return {names[0]: estimator.fit(rows)}
        grown = _trees(estimator).fit_together(rows, {n: _trees(jobs[n][0]).getInputCols() for n in names})
        return {n: PipelineModel([m]) for n, m in grown.items()}

    session = next(iter(jobs.values()))[1].sparkSession
    with ThreadPoolExecutor(parallel) as pool:
        found = {n: m for models in pool.map(inheritable_thread_target(session)(one), groups.values()) for n, m in models.items()}
    return {n: found[n] for n in jobs}


def _trees(estimator: Estimator) -> BoostedTrees | None:
    stages = estimator.getStages() if isinstance(estimator, Pipeline) else []
    return stages[0] if len(stages) == 1 and isinstance(stages[0], BoostedTrees) else None


def scored_folds(parts: Mapping[int, tuple[DataFrame, DataFrame]], variants: Mapping[str, tuple[Sequence[str], Maker]], label: str, store: ModelStore | None = None, snapshot: str = "") -> DataFrame:
    """Test rows of all folds, with `fold` and a score for each variant (its features, its maker)."""
    models = fitted({(y, n): (make(cols, label), train) for y, (train, _) in parts.items() for n, (cols, make) in variants.items()}, store=store, snapshot=snapshot)
    out = None
    for year, (_, test) in parts.items():
        fold = test.withColumn("fold", F.lit(year))
        for name in variants:
            fold = score(models[year, name], fold, name)
        out = fold if out is None else out.unionByName(fold)
    return out


def walk_forward(df: DataFrame, features: Sequence[str], label: str, years: Sequence[int], makers: Mapping[str, Maker], encode: Mapping[str, int] | None = None) -> DataFrame:
    """Per test year: fit each model on the earlier years, score the year. Union of the scored years with `fold`."""
    return scored_folds(folds(df, years, encode), {n: (features, make) for n, make in makers.items()}, label)


def fold_auc(scored: DataFrame, models: Sequence[str], label: str) -> DataFrame:
    """AUC per fold and model, all models in one pass."""
    long = scored.select("fold", F.col(label).cast("bigint").alias("__y"), *models).unpivot(["fold", "__y"], list(models), "model", "__score")
    return auc(long, ["fold", "model"], "__score", "__y").select("fold", "model", "positives", "negatives", "auc")


def weighted_average(scored: DataFrame, table: DataFrame, models: Sequence[str], name: str = "average") -> DataFrame:
    """Mean of the model scores weighted by each model's mean AUC in the earlier folds, so no weight has seen the labels it
    is used on; the first fold weighs all alike. The weight table has one row per fold."""
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    weights = table.groupBy("fold").pivot("model", list(models)).agg(F.first("auc")).select("fold", *[F.coalesce(F.avg(m).over(before), F.lit(1.0)).alias(f"__w_{m}") for m in models])
    joined = scored.join(F.broadcast(weights), "fold")
    top = sum((F.col(m) * F.col(f"__w_{m}") for m in models[1:]), F.col(models[0]) * F.col(f"__w_{models[0]}"))
    low = sum((F.col(f"__w_{m}") for m in models[1:]), F.col(f"__w_{models[0]}"))
    return joined.withColumn(name, top / low).drop(*[f"__w_{m}" for m in models])


def stacked(scored: DataFrame, models: Sequence[str], label: str, name: str = "stack") -> DataFrame:
    """Logistic regression on the model scores: each fold is scored by a fit on the earlier folds; the first fold has none."""
    folds = [r["fold"] for r in scored.select("fold").distinct().orderBy("fold").collect()]  # one row per fold
    out = None
    for fold in folds[1:]:
        fit = logistic()(models, label).fit(scored.filter(F.col("fold") < fold))
        one = score(fit, scored.filter(F.col("fold") == fold), name)
        out = one if out is None else out.unionByName(one)
    return out


def segment_models(
    df: DataFrame, features: Sequence[str], label: str, years: Sequence[int], segment: str, segments: Sequence[str], make: Maker, encode: Mapping[str, int] | None = None
) -> DataFrame:
    """AUC of the general and of the segment's own model per fold and segment, and whether the own one is better."""
    parts = folds(df, years, encode)
    of_segment = lambda rows, s: rows if s is None else rows.filter(F.col(segment) == s)
    models = fitted({(y, s): (make(features, label), of_segment(train, s)) for y, (train, _) in parts.items() for s in (None, *segments)})
    out = None
    for year, (_, test) in parts.items():
        scored = score(models[year, None], test.withColumn("fold", F.lit(year)), "general")
        for s in segments:
            one = score(models[year, s], of_segment(scored, s), "special")
            out = one if out is None else out.unionByName(one)
    out = cut_lineage(out.select("fold", segment, "general", "special", F.col(label).cast("bigint").alias("__y")))
    of = lambda m: auc(out, ["fold", segment], m, "__y").select("fold", segment, F.col("auc").alias(m))
    return of("general").join(of("special"), ["fold", segment]).withColumn("adopted", F.col("special") > F.col("general"))


def importances(spark: SparkSession, model, features: Sequence[str], groups: Mapping[str, str]) -> DataFrame:
    """Share of each feature and of its group in the importance of a fitted tree pipeline."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(f, groups.get(f, "other"), float(v)) for f, v in zip(features, values)]
    df = spark.createDataFrame(rows, "feature string, grp string, importance double")
    by_group = df.groupBy("grp").agg(F.sum("importance").alias("group_share"))
    return df.join(by_group, "grp")


def ablation(df: DataFrame, features: Sequence[str], label: str, years: Sequence[int], groups: Mapping[str, Sequence[str]], make: Maker, encode: Mapping[str, int] | None = None) -> DataFrame:
    """Mean walk-forward AUC with all features and without each group, and the difference."""
    variants = {"all": list(features)} | {f"without_{g}": [f for f in features if f not in set(fs)] for g, fs in groups.items()}
    scored = cut_lineage(scored_folds(folds(df, years, encode), {v: (cols, make) for v, cols in variants.items()}, label).select("fold", label, *variants))
    sizes = F.create_map(*[F.lit(x) for v, cols in variants.items() for x in (v, len(cols))])
    out = cut_lineage(fold_auc(scored, list(variants), label).groupBy("model").agg(F.avg("auc").alias("auc")))
    out = out.select(F.col("model").alias("variant"), sizes[F.col("model")].alias("n_features"), "auc")
    base = out.filter(F.col("variant") == "all").select("auc").scalar()
    return out.withColumn("delta", F.col("auc") - base)


def forward_selection(
    df: DataFrame, start: Sequence[str], candidates: Sequence[str], label: str, years: Sequence[int], make: Maker, min_gain: float = 0.0, encode: Mapping[str, int] | None = None
) -> DataFrame:
    """Add candidates one by one in order; each stays when the mean walk-forward AUC grows by more than `min_gain`."""
    parts = folds(df, years, encode)

    def mean(cols: Sequence[str]) -> float:
        scored = cut_lineage(scored_folds(parts, {"m": (cols, make)}, label).select("fold", label, "m"))
        return fold_auc(scored, ["m"], label).agg(F.avg("auc")).first()[0]

    kept, best = list(start), mean(start)
    rows = [(0, "start", best, True)]
    for i, c in enumerate(candidates, 1):
        value = mean([*kept, c])
        keep = value - best > min_gain
        rows.append((i, c, value, keep))
        if keep:
            kept, best = [*kept, c], value
    return df.sparkSession.createDataFrame(rows, "step int, feature string, auc double, kept boolean")
