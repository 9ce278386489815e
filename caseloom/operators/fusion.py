"""Text and structured model families and their late fusion, for one label or several per case.

A family is a way to turn a split frame into class probabilities: linear models over weighted words and character n-grams, or
boosted trees over structured columns. Families are fitted on the development split, blended by a weight chosen on the selection
split, calibrated there by a power of the probabilities (one label) or a decoding threshold (several labels), fitted again on
all that precedes the holdout, and scored there once. Vectors are built from the development split's vocabulary alone.

Defined results: a null or empty text has no words and gets the family's prior; a category never seen in training goes to a slot
of its own; classes seen in the later split only are never predicted and count as missed; ties of probability go to the class first
in order; a label without both kinds of rows in training has its share as probability.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, IDF, Normalizer, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators import evaluation, modeling, selection

ALPHAS = (1.0, 1.25, 1.5, 1.75, 2.0)
WEIGHTS = (0.25, 0.5, 0.75)
THRESHOLDS = tuple(round(0.1 + 0.05 * i, 2) for i in range(9))


def text_pipeline(words: str = "words", grams: str | None = None, least_df: int = 5, most_share: float = 0.995, vocabulary: int = 50_000, half: bool = True) -> Pipeline:
    """Counts over a bounded vocabulary, inverse document frequencies, unit length; words and n-grams side by side, in the JVM."""
    stages, parts = [], []
    for column in [words, *([grams] if grams else [])]:
        stages += [
            CountVectorizer(inputCol=column, outputCol=f"{column}__c", vocabSize=vocabulary, minDF=least_df, maxDF=most_share),
            IDF(inputCol=f"{column}__c", outputCol=f"{column}__w"),
            Normalizer(inputCol=f"{column}__w", outputCol=f"{column}__n"),
        ]
        parts.append(f"{column}__n")
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="text_features")])


def with_terms(df: DataFrame, text: str, stop: list[str] = (), characters: bool = True) -> DataFrame:
    """Adds ``words`` (words and bigrams) and, if asked for, ``grams`` (character n-grams); null texts have none."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn("words", modeling.word_grams(t, list(stop)))
    return out.withColumn("grams", modeling.char_grams(t)) if characters else out


def index_classes(train: DataFrame, label: str) -> StringIndexerModel:
    """Classes in alphabetical order; those of later rows only go to an extra index beyond the last."""
    return StringIndexer(inputCol=label, outputCol="class", stringOrderType="alphabetAsc", handleInvalid="keep").fit(train)


def fit_linear_classes(train: DataFrame, features: str, strength: float = 1e-4, rounds: int = 50):
    """A balanced multinomial model over the ``class`` column."""
    return LogisticRegression(featuresCol=features, labelCol="class", weightCol="weight", regParam=strength, maxIter=rounds, family="multinomial").fit(modeling.balanced_weights(train, "class"))


def boosted_class_probabilities(train: DataFrame, later: DataFrame, label: str, classes: list[str], features: str, out: str, rounds: int = 20) -> DataFrame:
    """Adds to ``later`` the probabilities of boosted trees, a class against the rest, normalised over the classes."""
    shares = dict.fromkeys(classes, 0.5)  # every class has rows, and none has all unless it is the only one
    rows = train.withColumn("_own", F.array(label))
    models = fit_labels(rows, "_own", shares, lambda df: modeling.fit_boosted(modeling.balanced_weights(df, "label"), features, "label", rounds)) if len(classes) > 1 else {}
    return label_probabilities(models, shares, later, out).withColumn(out, evaluation.normalize_rows(F.col(out)))


def linear_class_probabilities(train: DataFrame, later: DataFrame, n_classes: int, features: str, out: str) -> DataFrame:
    """Adds to ``later`` the probabilities of a balanced multinomial model, in class order."""
    scored = fit_linear_classes(train, features).transform(later)
    return scored.withColumn(out, F.slice(vector_to_array("probability"), 1, n_classes)).drop("rawPrediction", "probability", "prediction")


def class_metrics(df: DataFrame, probabilities: str, classes: list[str], truth: str, by: list[str] = ()) -> DataFrame:
    """Rows, top-1 and top-3 accuracy, macro F1 (classes predicted or true), ECE, Brier and log loss per slice."""
    names = F.array(*[F.lit(c) for c in classes])
    rows = df.withColumn("_top", evaluation.top_k_labels(F.col(probabilities), names, 3)).withColumn("_guess", F.col("_top")[0])
    hit = (F.col(truth) == F.col("_guess")).cast("int")
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(hit), 6).alias("top1_accuracy"), F.round(F.avg(F.array_contains("_top", F.col(truth)).cast("int")), 6).alias("top3_accuracy"))
    sides = rows.select(*by, F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), hit.alias("h")), F.struct(F.col("_guess").alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("h")))).alias("s")).select(*by, "s.*")
    f1 = sides.groupBy(*by, "c").agg((2 * F.sum("h") / (F.sum("t") + F.sum("p"))).alias("f1")).groupBy(*by).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return counts.join(f1, list(by)) if by else counts.crossJoin(f1)  # one row each without slices


def single_label_run(cases: DataFrame, label: str, text: str, categories: list[str], numbers: list[str], key: str = "odino", split: str = "split", seen: str | None = None, vocabulary: int = 50_000, least_df: int = 5, rounds: int = 20, characters: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(holdout probabilities, metric rows, choices) of the fused one-label model.

    ``split`` holds develop, select and holdout. ``seen`` names a flag of holdout texts that occurred before: metrics come for
    all rows and for both slices.
    """
    cases = with_terms(cases.filter(F.col(label).isNotNull()), text, characters=characters)

    def fit(train: DataFrame, later: DataFrame) -> tuple[DataFrame, list[str]]:
        indexer = index_classes(train, label)
        classes = list(indexer.labels)
        words: PipelineModel = text_pipeline("words", "grams" if characters else None, least_df, vocabulary=vocabulary).fit(train)
        table: PipelineModel = modeling.structured_pipeline(categories, numbers).fit(train)
        ready, ahead = (indexer.transform(table.transform(words.transform(df))) for df in (train, later))
        ready = modeling.materialize(ready.select(label, "class", "text_features", "features"), "classes-train")
        scored = linear_class_probabilities(ready, ahead, len(classes), "text_features", "p_text")
        scored = boosted_class_probabilities(ready, scored, label, classes, "features", "p_table", rounds)
        return scored.select(key, F.col(label).alias("truth"), "p_text", "p_table", *([seen] if seen else [])), classes

    development, chosen, holdout = (cases.filter(F.col(split) == s) for s in ("develop", "select", "holdout"))
    first, classes = fit(development, chosen)
    first = modeling.materialize(first, "fusion-select")
    weight = selection.best_weight(selection.fusion_grid(first, "p_text", "p_table", classes, "truth", WEIGHTS))
    blended = first.withColumn("p", evaluation.blend(F.col("p_text"), F.col("p_table"), weight))
    alpha = evaluation.best_alpha(evaluation.calibration_grid(blended, "p", classes, "truth", list(ALPHAS)))
    last, classes = fit(development.unionByName(chosen), holdout)
    final = modeling.materialize(last.withColumn("p", evaluation.power_calibration(evaluation.blend(F.col("p_text"), F.col("p_table"), weight), alpha)), "fusion-holdout")
    metrics = class_metrics(final, "p", classes, "truth").withColumn("slice", F.lit("all"))
    if seen:
        part = class_metrics(final, "p", classes, "truth", [seen])
        metrics = metrics.unionByName(part.withColumn("slice", F.when(F.col(seen), "seen").otherwise("unseen")).drop(seen))
    return final, metrics, {"weight": weight, "alpha": alpha, "classes": classes}


def label_shares(train: DataFrame, labels: str) -> dict[str, float]:
    """The share of rows with each label, over all rows; one aggregate."""
    total = train.agg(F.count(F.lit(1)).alias("_t"))
    counted = train.select(F.explode(F.array_distinct(labels)).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(total))  # one-row side
    return {r["label"]: r["n"] / r["_t"] for r in counted.orderBy("label").collect()}


def fit_labels(train: DataFrame, labels: str, shares: dict[str, float], make, threads: int = 4) -> dict[str, object]:
    """A model per label that some rows have and some have not, several fits at a time."""

    def one(name: str):
        return name, make(train.withColumn("label", F.array_contains(labels, name).cast("double")))

    with ThreadPoolExecutor(threads) as pool:
        return dict(pool.map(one, [n for n, s in shares.items() if 0 < s < 1]))


def label_probabilities(models: dict[str, object], shares: dict[str, float], df: DataFrame, out: str) -> DataFrame:
    """Adds an array with the probability of each label of ``shares`` in order."""
    columns: list[Column] = []
    for i, (name, share) in enumerate(shares.items()):
        if name not in models:
            columns.append(F.lit(float(share)))
            continue
        df = models[name].transform(df).withColumn(f"_p{i}", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")
        columns.append(F.col(f"_p{i}"))
    return df.withColumn(out, F.array(*columns)).drop(*[f"_p{i}" for i in range(len(shares))])


def multi_label_run(cases: DataFrame, labels: str, text: str, categories: list[str], numbers: list[str], key: str = "odino", split: str = "split", vocabulary: int = 50_000, least_df: int = 5, rounds: int = 20, characters: bool = True) -> tuple[DataFrame, DataFrame, dict]:
    """(holdout decodings, metric row, choices) of the fused many-label model: weight and threshold by macro F1 of the selection split."""
    cases = with_terms(cases.filter(F.size(labels) > 0), text, characters=characters)

    def fit(train: DataFrame, later: DataFrame) -> tuple[DataFrame, list[str]]:
        shares = label_shares(train, labels)
        words = text_pipeline("words", "grams" if characters else None, least_df, vocabulary=vocabulary).fit(train)
        table = modeling.structured_pipeline(categories, numbers).fit(train)
        ready = modeling.materialize(table.transform(words.transform(train)).select(labels, "text_features", "features"), "labels-train")
        linear = fit_labels(ready, labels, shares, lambda df: modeling.fit_logistic(df, "text_features"))
        boosted = fit_labels(ready, labels, shares, lambda df: modeling.fit_boosted(df, "features", "label", rounds))
        scored = label_probabilities(linear, shares, table.transform(words.transform(later)), "p_text")
        scored = label_probabilities(boosted, shares, scored, "p_table")
        return scored.select(key, F.array_distinct(labels).alias("truth"), "p_text", "p_table"), list(shares)

    development, chosen, holdout = (cases.filter(F.col(split) == s) for s in ("develop", "select", "holdout"))
    first, names = fit(development, chosen)
    first = modeling.materialize(first.withColumn("names", F.array(*[F.lit(n) for n in names])), "labels-select")
    best = None
    for weight in WEIGHTS:
        blended = first.withColumn("p", evaluation.blend(F.col("p_text"), F.col("p_table"), weight))
        for r in selection.threshold_grid(blended, "p", "names", "truth", list(THRESHOLDS), 1).collect():
            place = (-r["macro_f1"], -r["micro_f1"], r["threshold"], weight)
            best = min(best, place) if best else place
    threshold, weight = best[2], best[3]
    last, names = fit(development.unionByName(chosen), holdout)
    final = last.withColumn("p", evaluation.blend(F.col("p_text"), F.col("p_table"), weight))
    final = modeling.materialize(final.withColumn("guess", evaluation.threshold_labels(F.col("p"), F.array(*[F.lit(n) for n in names]), threshold, 1)), "labels-holdout")
    return final, evaluation.multilabel_metrics(final, "truth", "guess"), {"weight": weight, "threshold": threshold, "labels": names}


def prior_baseline(train: DataFrame, later: DataFrame, label: str, out: str = "score") -> DataFrame:
    """The share of positives in training as everybody's score."""
    share = train.agg(F.avg(F.col(label).cast("double")).alias(out))
    return later.crossJoin(F.broadcast(share))  # one-row side
