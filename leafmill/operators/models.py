"""Training sets and page classifiers on Spark ML."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.operators import sequence as S
from leafmill.sources.staged import written


def undersample(rows: DataFrame, positive: str, key: str) -> DataFrame:
    """All positives, and at most ``ceil(ln(1.73 + neg / pos) * pos)`` negatives, those with the smallest hashes of ``key``.

    A histogram over four hex digits of the hash (65,536 counts) shows where to cut; only the rows of
    the digit group that the cut goes through are sorted.
    """
    n = rows.agg(F.count_if(positive).alias("p"), F.count_if(~F.col(positive)).alias("q")).first()
    most = math.ceil(math.log(1.73 + n.q / n.p) * n.p) if n.p else n.q
    digest = F.md5(F.col(key).cast("string"))
    negatives = rows.where(~F.col(positive)).withColumn("_h", digest).withColumn("_g", F.substring("_h", 1, 4))
    left, cut = most, "~"  # a tilde sorts after all hex digits
    for r in sorted(negatives.groupBy("_g").count().collect(), key=lambda r: r["_g"]):
        if r["count"] > left:
            cut = r["_g"]
            break
        left -= r["count"]
    edge = negatives.where(F.col("_g") == cut).orderBy("_h", key).limit(left)
    return rows.where(positive).unionByName(negatives.where(F.col("_g") < cut).unionByName(edge).drop("_h", "_g"))


def folds(pages: DataFrame, n: int = 5) -> DataFrame:
    """``vol, fold``: whole volumes, dealt in the order of their names.

    Volumes are numbered inside the ranges of their sorted names; the counts of the ranges before, as many
    as there are ranges, are added.
    """
    ranges = pages.select("vol").distinct().repartitionByRange("vol").sortWithinPartitions("vol").select("vol", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at"))
    ranges = written(ranges, "fold-volumes")
    counts = {r.part: (r.size, r.first) for r in ranges.groupBy("part").agg(F.count("*").alias("size"), F.min("at").alias("first")).collect()}
    shifts, before = [F.lit(-1), F.lit(0).cast("long")], 0
    for part, (size, first) in sorted(counts.items()):
        shifts += [F.lit(part), F.lit(before - first).cast("long")]
        before += size
    return ranges.select("vol", ((F.col("at") + F.element_at(F.create_map(*shifts), F.col("part"))) % n).cast("int").alias("fold"))


def one_vs_all(train: DataFrame, categories: list[str], ridge: float = 0.002, iterations: int = 100) -> dict:
    """A ridge logistic model for each category over ``features`` and ``category``; their probabilities are not renormalised."""
    fit = LogisticRegression(regParam=ridge, elasticNetParam=0.0, maxIter=iterations, labelCol="is")
    return {g: fit.fit(train.withColumn("is", (F.col("category") == g).cast("double"))) for g in categories}


def score(models: dict, pages: DataFrame) -> DataFrame:
    """``pages`` with ``probs`` (array<double> in the order of the models) and ``raw``, the first most probable category."""
    out = pages
    for i, m in enumerate(models.values()):
        out = m.setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}").setRawPredictionCol(f"_r{i}").transform(out).withColumn(f"_p{i}", vector_to_array(f"_p{i}")[1]).drop(f"_r{i}", f"_y{i}")
    probs = [F.col(f"_p{i}") for i in range(len(models))]
    best = F.array_position(F.array(*probs), F.greatest(*probs)).cast("int") if len(probs) > 1 else F.lit(1)
    return out.withColumn("probs", F.array(*probs)).withColumn("raw", F.element_at(F.array(*[F.lit(g) for g in models]), best)).drop(*[f"_p{i}" for i in range(len(models))])


def smoothed(scored: DataFrame, train: DataFrame, categories: list[str]) -> DataFrame:
    """``scored(vol, page, words, probs, ..)`` with ``smooth``: the best category after smoothing by the transitions of ``train``."""
    soft = S.smooth(scored, *S.transition_arrays(train, categories)).select("vol", "page", "smoothed")
    best = F.element_at(F.array(*map(F.lit, categories)), F.array_position("smoothed", F.array_max("smoothed")).cast("int"))
    return scored.join(soft, ["vol", "page"]).withColumn("smooth", best).drop("smoothed")


def cross_validate(pages: DataFrame, categories: list[str], n: int = 5, extra: DataFrame | None = None) -> DataFrame:
    """Each fold scored by models, and smoothed by transitions, of the other folds and of the ``extra`` rows, which are never scored."""
    dealt, out = pages.join(folds(pages, n), "vol"), None
    for k in range(n):
        train = dealt.where(F.col("fold") != k).drop("fold")
        train = train.unionByName(extra) if extra is not None else train
        part = smoothed(score(one_vs_all(train, categories), dealt.where(F.col("fold") == k)), train, categories)
        out = part if out is None else out.unionByName(part)
    return out


def confusion_at_half(scored: DataFrame, names: list[str]) -> DataFrame:
    """``category, tp, fp, fn, tn`` of ``scored(category, probs)``: each of ``names`` is said at a probability over one half."""
    each = scored.select("category", F.posexplode(F.slice("probs", 1, len(names))).alias("i", "p")).withColumn("of", F.get(F.array(*map(F.lit, names)), F.col("i")))
    said, is_ = F.col("p") > 0.5, F.col("category") == F.col("of")
    return each.groupBy(F.col("of").alias("category_")).agg(F.count_if(said & is_).alias("tp"), F.count_if(said & ~is_).alias("fp"), F.count_if(~said & is_).alias("fn"), F.count_if(~said & ~is_).alias("tn")).withColumnRenamed("category_", "category")


def training_confusion(models: dict, train: DataFrame) -> DataFrame:
    """``confusion_at_half`` of one-vs-all models on the rows that they were fitted to."""
    return confusion_at_half(score(models, train), list(models))


def in_cells(train: DataFrame, cells: int) -> DataFrame:
    """``train`` with every component of ``features`` at the middle of its cell, of ``cells`` equal ones over the component's range."""
    r = train.select(Summarizer.metrics("min", "max").summary(F.col("features")).alias("s")).select("s.min", "s.max").first()
    low, width = (F.array(*[F.lit(float(x)) for x in a]) for a in (r[0], (r[1].toArray() - r[0].toArray()) / cells))
    middle = lambda x, i: F.get(low, i) + (F.least(F.floor((x - F.get(low, i)) / F.get(width, i)), F.lit(cells - 1)) + 0.5) * F.get(width, i)
    snapped = F.transform(vector_to_array("features"), lambda x, i: F.when(F.get(width, i) > 0, middle(x, i)).otherwise(x))
    return train.withColumn("features", array_to_vector(snapped))


def forest(train: DataFrame, trees: int = 500, per_split: int = 40, seed: int = 10, cells: int | None = None):
    """A random forest on ``features`` and ``label``.

    Spark splits a component at 31 places at most, by default its quantiles, so a gap between two
    quantiles is missed. With ``cells`` (32 at most) they are the bounds of equal cells of its range: a
    gap wider than a cell is always one of them. Pages are scored as they are.
    """
    return RandomForestClassifier(numTrees=trees, featureSubsetStrategy=str(per_split), seed=seed).fit(in_cells(train, cells) if cells else train)


def category_forests(train: DataFrame, categories: list[str], trees: int = 500, per_split: int = 22, seed: int = 10, cells: int | None = None) -> dict:
    """A random forest for each category against all others; ``score`` applies them."""
    return {g: forest(train.withColumn("label", (F.col("category") == g).cast("double")), trees, per_split, seed, cells) for g in categories}


def all_vs_all(train: DataFrame, categories: list[str], ridge: float = 0.002, iterations: int = 50) -> dict:
    """A ridge logistic model for each pair of categories, on their rows only."""
    fit = LogisticRegression(regParam=ridge, elasticNetParam=0.0, maxIter=iterations, labelCol="is")
    pairs = [(a, b) for i, a in enumerate(categories) for b in categories[i + 1 :]]
    return {(a, b): fit.fit(train.where(F.col("category").isin(a, b)).withColumn("is", (F.col("category") == a).cast("double"))) for a, b in pairs}


def score_pairs(models: dict, categories: list[str], pages: DataFrame) -> DataFrame:
    """``pages`` with ``probs``: each category's positive probabilities summed over its pairs and normalised; ``raw`` the best."""
    out = pages
    for i, m in enumerate(models.values()):
        out = m.setProbabilityCol(f"_p{i}").setPredictionCol(f"_y{i}").setRawPredictionCol(f"_r{i}").transform(out).withColumn(f"_p{i}", vector_to_array(f"_p{i}")[1]).drop(f"_r{i}", f"_y{i}")
    sums = [sum((F.col(f"_p{i}") if a == g else 1 - F.col(f"_p{i}")) for i, (a, b) in enumerate(models) if g in (a, b)) for g in categories]
    total = sum(sums)
    probs = F.array(*[s / total for s in sums])
    out = out.withColumn("probs", probs).drop(*[f"_p{i}" for i in range(len(models))])
    return out.withColumn("raw", F.element_at(F.array(*[F.lit(g) for g in categories]), F.array_position("probs", F.array_max("probs")).cast("int")))


def bagged(train: DataFrame, categories: list[str], ridges: tuple[float, ...] = (0.1, 10.0, 50.0), share: float = 0.66, seed: int = 10) -> list[dict]:
    """One-vs-all models on samples with replacement, one for each ridge; score each and average."""
    return [one_vs_all(train.sample(True, share, seed + i), categories, ridge=r, iterations=50) for i, r in enumerate(ridges)]


def score_bagged(bags: list[dict], categories: list[str], pages: DataFrame) -> DataFrame:
    out = pages
    for i, models in enumerate(bags):
        out = score(models, out).withColumnRenamed("probs", f"_b{i}").drop("raw")
    mean = F.array(*[sum(F.get(f"_b{i}", F.lit(k)) for i in range(len(bags))) / len(bags) for k in range(len(categories))])
    out = out.withColumn("probs", mean).drop(*[f"_b{i}" for i in range(len(bags))])
    return out.withColumn("raw", F.element_at(F.array(*[F.lit(g) for g in categories]), F.array_position("probs", F.array_max("probs")).cast("int")))


def ensemble(models: dict[str, dict], pages: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The pages once for each named model, with a ``model`` column; with ``truth`` also smoothed by its transitions, after each model."""
    out = None
    for name, m in models.items():
        part = score(m, pages)
        if truth is not None:
            part = smoothed(part, truth, list(m))
        part = part.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def by_date(scored: DataFrame, volumes: DataFrame, early: str, late: str, turn: int = 1900) -> DataFrame:
    """Of an ensemble's rows those of the model for the volume's year."""
    return scored.join(volumes.select("vol", "year"), "vol").where(F.col("model") == F.when(F.col("year") < turn, early).otherwise(late))


def batch(scorer, pages: DataFrame, words: str = "words") -> DataFrame:
    """Scores new volumes; those with at most one word give no rows."""
    some = pages.groupBy("vol").agg(F.sum(words).alias("_w")).where("_w > 1").select("vol")
    return scorer(pages.join(some, "vol", "left_semi"))


# How each type of bundle is fitted models, by name, and how it scores pages.
SCORERS: dict[str, Callable[[dict, list[str], DataFrame], DataFrame]] = {
    "one_vs_all": lambda m, categories, pages: score({g: m[g] for g in categories}, pages),
    "all_vs_all": lambda m, categories, pages: score_pairs({(a, b): m[f"{a}-{b}"] for i, a in enumerate(categories) for b in categories[i + 1 :]}, categories, pages),
    "bagged": lambda m, categories, pages: score_bagged([{g: m[f"{i}-{g}"] for g in categories} for i in range(len(m) // len(categories))], categories, pages),
    "forests": lambda m, categories, pages: score({g: m[g] for g in categories}, pages),
}


def parts_of(kind: str, models: dict | list) -> dict:
    """The models of a bundle by the names that they are saved under."""
    if kind == "bagged":
        return {f"{i}-{g}": m for i, bag in enumerate(models) for g, m in bag.items()}
    return {f"{k[0]}-{k[1]}" if isinstance(k, tuple) else k: m for k, m in models.items()}


def save_bundle(spark: SparkSession, kind: str, models: dict | list, categories: list[str], path: str, side_tables: dict[str, DataFrame] | None = None) -> None:
    """A model bundle of a type of ``SCORERS``: a folder for each model, what it holds as JSON, and Parquet side tables."""
    parts = parts_of(kind, models)
    for name, m in parts.items():
        m.write().overwrite().save(f"{path}/models/{name}")
    held = [(kind, name, type(m).__name__, i) for i, (name, m) in enumerate(parts.items())]
    rows = spark.createDataFrame([(*h, categories) for h in held], "kind string, name string, model string, at int, categories array<string>")
    rows.coalesce(1).write.mode("overwrite").json(f"{path}/bundle")
    for name, t in (side_tables or {}).items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load_bundle(spark: SparkSession, path: str) -> tuple[str, dict, list[str]]:
    """The type, models and categories of a saved bundle. Its few parts are listed on the driver."""
    from pyspark.ml import classification

    held = spark.read.schema("kind string, name string, model string, at int, categories array<string>").json(f"{path}/bundle").orderBy("at").collect()
    return held[0].kind, {r.name: getattr(classification, r.model).load(f"{path}/models/{r.name}") for r in held}, list(held[0].categories)


def instructed_ensemble(instructions: DataFrame, pages: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """The pages once for each row of ``instructions(name, type, path)``, with ``model``, ``probs`` and ``raw``; with ``truth`` also smoothed.

    A row names a saved bundle and its type, which must be the type it was saved as. All bundles score
    the pages in one pass: each adds its columns, and the rows are unfolded at the end.
    """
    wide, names, categories = pages, [], []
    for r in sorted(instructions.collect(), key=lambda r: r.name):  # one row for each model
        kind, models, categories = load_bundle(pages.sparkSession, r.path)
        if r.type != kind or kind not in SCORERS:
            raise ValueError(f"{r.name}: a bundle of type {kind}, called {r.type}")
        wide = SCORERS[kind](models, categories, wide).withColumnsRenamed({"probs": f"_probs{len(names)}", "raw": f"_raw{len(names)}"})
        names.append(r.name)
    rows = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_probs{i}").alias("probs"), F.col(f"_raw{i}").alias("raw")) for i, n in enumerate(names)])
    out = wide.select(*pages.columns, F.inline(rows))
    if truth is None:
        return out
    return reduce(DataFrame.unionByName, [smoothed(out.where(F.col("model") == n), truth, categories) for n in names])


def save(models: dict, side_tables: dict[str, DataFrame], path: str) -> None:
    """A model bundle: one folder for each category's model, and Parquet side tables."""
    for g, m in models.items():
        m.write().overwrite().save(f"{path}/models/{g}")
    for name, t in side_tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")


def load(path: str, categories: list[str]) -> dict:
    from pyspark.ml.classification import LogisticRegressionModel

    return {g: LogisticRegressionModel.load(f"{path}/models/{g}") for g in categories}
