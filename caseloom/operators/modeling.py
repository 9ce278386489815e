"""Text and structured features, linear and tree models, calibration, topics: Spark ML where it has the estimator."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators import matrix
from caseloom.session import materialize

INFREQUENT = "__INFREQUENT__"
VOCABULARY_MOST = 1_000_000  # terms a vocabulary may hold on the driver and in a broadcast; cut it in ``tfidf`` beyond that
PACKED_MOST, PACKED_BYTES = 200_000, 8_000_000  # terms, and bytes of them, that travel to the documents; beyond that they are joined


def word_grams(text: Column, stop: list[str] = (), two: bool = True) -> Column:
    """Words of two characters or more without stop words, and their neighbours as bigrams."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), lambda w: ~w.isin(list(stop)) if stop else F.lit(True))
    if not two:
        return words
    n = F.greatest(F.size(words) - 1, F.lit(0))  # slices, as a lambda would split the text again for every word
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda x, y: F.concat_ws(" ", x, y))
    return F.when(F.size(words) > 1, F.concat(words, pairs)).otherwise(words)


def char_grams(text: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside words padded by a space."""
    words = F.transform(F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(w: Column, n: int) -> Column:
        return F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: F.substr(w, i, F.lit(n)))).otherwise(F.array(w))

    return F.flatten(F.transform(words, lambda w: F.flatten(F.array(*[grams(w, n) for n in range(least, most + 1)]))))


def term_documents(docs: DataFrame, key: str, terms: Column, fitted: Column | None = None) -> DataFrame:
    """(key, fitted, source_rows, terms), a row per key, written once; rows are grouped only where a key is there twice."""
    rows = docs.select(key, F.coalesce(fitted if fitted is not None else F.lit(True), F.lit(False)).alias("fitted"), F.lit(1).cast("long").alias("source_rows"), terms.alias("terms"))
    if not one_row_per_key(docs, key):
        if fitted is not None:
            raise ValueError(f"a {key} is there twice; with a fitted part each may have one row")
        rows = rows.groupBy(key).agg(F.lit(True).alias("fitted"), F.sum("source_rows").alias("source_rows"), F.flatten(F.collect_list("terms")).alias("terms"))
    return materialize(rows, "term-documents")


def one_row_per_key(df: DataFrame, key: str) -> bool:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").isEmpty()


def tfidf_matrix(docs: DataFrame, key: str, terms: Column, least_df: int = 1, most_share: float = 1.0, vocabulary: int | None = None, sublinear: bool = True, fitted: Column | None = None, pairs: bool = False) -> matrix.TermMatrix | DataFrame:
    """Smooth idf, sublinear tf, unit length per document; the vocabulary is cut by corpus count, ties by term.

    Vocabulary and document frequencies are those of the rows with ``fitted`` (all if not given); ``pairs`` makes neighbours of the
    array terms also. A vocabulary of up to PACKED_MOST terms and PACKED_BYTES (counted) travels to the documents and gives a packed
    matrix; beyond that the documents' terms are shuffled to theirs, which gives (key, term, weight) rows.
    """
    rows = term_documents(docs, key, terms, fitted)
    stats = materialize(matrix.term_counts(rows, pairs).filter((F.col("df") >= least_df) | F.col("term").isNull()), "term-counts")
    n_docs = stats.filter("term IS NULL").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
    kept = stats.filter(F.col("term").isNotNull() & (F.col("df") >= least_df) & (F.col("df") <= n_docs * most_share))
    if vocabulary:
        kept = kept.orderBy(F.col("cf").desc(), "term").limit(vocabulary)
    n, size = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("term")), F.lit(0))).first()
    if n <= PACKED_MOST and size <= PACKED_BYTES:
        known = kept.select("term", "df").orderBy("term").collect()
        idf = np.log((1 + n_docs) / (1 + np.array([r["df"] for r in known], float))) + 1
        return matrix.pack_counts(rows, key, [r["term"] for r in known], idf, sublinear, pairs)
    tf = F.log(F.col("tf").cast("double")) + 1 if sublinear else F.col("tf").cast("double")
    weighted = matrix.long_counts(rows, key, pairs).join(kept, "term").withColumn("w", tf * (F.log((1 + F.lit(n_docs)) / (1 + F.col("df"))) + 1))
    return weighted.select(key, "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))).alias("weight"))


def tfidf(docs: DataFrame, key: str, terms: Column, least_df: int = 1, most_share: float = 1.0, vocabulary: int | None = None, sublinear: bool = True) -> DataFrame:
    """(key, term, weight) by ``tfidf_matrix``; rows of a key are one document, also those without a key, and documents without a term have no row."""
    made = tfidf_matrix(docs, key, terms, least_df, most_share, vocabulary, sublinear)
    return made.weights() if isinstance(made, matrix.TermMatrix) else made


def tfidf_totals(docs: DataFrame, key: str, terms: Column, **options) -> DataFrame:
    """(term, docs, total): documents with the term and the sum of its ``tfidf`` weights."""
    made = tfidf_matrix(docs, key, terms, **options)
    return made.totals() if isinstance(made, matrix.TermMatrix) else made.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").alias("total"))


def bounded_vocabulary(weights: DataFrame) -> list[str]:
    """The sorted terms; an error beyond VOCABULARY_MOST, nothing is dropped in silence."""
    terms = [r["term"] for r in weights.select("term").distinct().orderBy("term").limit(VOCABULARY_MOST + 1).collect()]
    if len(terms) > VOCABULARY_MOST:
        raise ValueError(f"more than {VOCABULARY_MOST} terms; cut the vocabulary first")
    return terms


def term_vectors(weights: DataFrame, key: str, scale: float = 1.0) -> tuple[DataFrame, list[str]]:
    """Sparse vectors over the sorted vocabulary (its size is bounded by the cut in ``tfidf``)."""
    from pyspark.ml.linalg import SparseVector, VectorUDT

    vocabulary = bounded_vocabulary(weights)
    size = len(vocabulary)
    index = weights.sparkSession.createDataFrame(list(enumerate(vocabulary)), "i int, term string") if vocabulary else None
    if index is None:
        raise ValueError("no term passes the document frequency limits")
    to_vector = F.udf(lambda cells: SparseVector(size, sorted((c["i"], c["weight"] * scale) for c in cells)), VectorUDT())
    rows = weights.join(F.broadcast(index), "term").groupBy(key).agg(F.collect_list(F.struct("i", "weight")).alias("cells"))
    return rows.select(key, to_vector("cells").alias("text_features")), vocabulary


def pool_infrequent(df: DataFrame, column: str, least: int = 50) -> DataFrame:
    """Categories seen fewer times than ``least`` become one."""
    rare = df.groupBy(column).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") < least).select(F.col(column).alias("_v"))
    return df.join(rare.withColumn("_rare", F.lit(True)), F.col(column) == F.col("_v"), "left").withColumn(column, F.when(F.col("_rare"), INFREQUENT).otherwise(F.col(column))).drop("_v", "_rare")


def structured_pipeline(categories: list[str], numbers: list[str], log_numbers: list[str] = (), with_mean: bool = False) -> Pipeline:
    """Median imputation, scaling, one-hot with unknown categories kept; ``log_numbers`` must have passed ``log1p_clip``."""
    every = [*numbers, *log_numbers]
    stages = [StringIndexer(inputCols=categories, outputCols=[f"{c}__i" for c in categories], handleInvalid="keep", stringOrderType="frequencyDesc"), OneHotEncoder(inputCols=[f"{c}__i" for c in categories], outputCols=[f"{c}__o" for c in categories], handleInvalid="keep")] if categories else []
    stages += [Imputer(inputCols=every, outputCols=[f"{c}__n" for c in every], strategy="median"), VectorAssembler(inputCols=[f"{c}__n" for c in every], outputCol="__numbers", handleInvalid="keep"), StandardScaler(inputCol="__numbers", outputCol="__scaled", withMean=with_mean)] if every else []
    parts = [f"{c}__o" for c in categories] + (["__scaled"] if every else [])
    return Pipeline(stages=[*stages, VectorAssembler(inputCols=parts, outputCol="features", handleInvalid="keep")])


def log1p_clip(c: Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)))


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds ``weight`` = rows / (classes x rows of the class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    table = counts.crossJoin(F.broadcast(total)).select(F.col(label).alias("_l"), (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))
    return df.join(F.broadcast(table), F.col(label).eqNullSafe(F.col("_l"))).drop("_l")


def fit_logistic(train: DataFrame, features: str = "features", label: str = "label", strength: float = 1e-4, balanced: bool = True, iterations: int = 50):
    data = balanced_weights(train, label) if balanced else train.withColumn("weight", F.lit(1.0))
    return LogisticRegression(featuresCol=features, labelCol=label, weightCol="weight", regParam=strength, maxIter=iterations).fit(data)


def fit_one_vs_rest(train: DataFrame, labels: str, vocabulary: list[str], features: str = "features", strength: float = 1e-4, threads: int = 4) -> dict[str, object]:
    """One balanced binary model per label of an array column, several fits at a time; labels without both classes are left out."""
    counts = train.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.array_contains(labels, name)).alias(f"_{i}") for i, name in enumerate(vocabulary)]).first()
    both = [name for i, name in enumerate(vocabulary) if 0 < counts[f"_{i}"] < counts["_all"]]

    def one(name: str):
        return name, fit_logistic(train.withColumn("label", F.array_contains(labels, name).cast("double")), features, "label", strength)

    with ThreadPoolExecutor(threads) as pool:
        return dict(pool.map(one, both))


def score_one_vs_rest(df: DataFrame, models: dict[str, object], key: str, features: str = "features") -> DataFrame:
    """(key, labels, scores) in the order of the models."""
    out = df
    for i, model in enumerate(models.values()):
        scored = model.transform(out.drop("probability", "prediction", "rawPrediction"))
        out = scored.withColumn(f"_p{i}", vector_to_array("probability")[1])
    return out.select(key, F.array(*[F.lit(n) for n in models]).alias("labels"), F.array(*[F.col(f"_p{i}") for i in range(len(models))]).alias("scores"))


def fit_boosted(train: DataFrame, features: str = "features", label: str = "label", rounds: int = 20, depth: int = 5):
    weighted = {"weightCol": "weight"} if "weight" in train.columns else {}
    return GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=depth, seed=7, **weighted).fit(train)


def best_rounds(model, valid: DataFrame) -> int:
    """The number of boosting rounds with the least validation loss."""
    return int(np.argmin(model.evaluateEachIteration(valid, "logistic"))) + 1


def platt(train: DataFrame, score: str, label: str) -> tuple[float, float]:
    """Slope and intercept of a logistic fit on the score."""
    n = max(1, train.count())
    model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=1.0 / n, standardization=False).fit(VectorAssembler(inputCols=[score], outputCol="_x").transform(train))
    return float(model.coefficients[0]), float(model.intercept)


def isotonic(train: DataFrame, score: str, label: str):
    return IsotonicRegression(featuresCol=score, labelCol=label).fit(train)


def fit_pipeline(pipeline: Pipeline, train: DataFrame) -> PipelineModel:
    return pipeline.fit(train)


# --- topics: non-negative matrix factorisation ---


def nmf_topics(weights: DataFrame | matrix.TermMatrix, key: str, topics: int, iterations: int = 30, seed: int = 7, fit: DataFrame | None = None) -> tuple[DataFrame, np.ndarray, list[str]]:
    """Factors documents x terms into documents x topics and topics x terms (multiplicative updates).

    Documents stay partitioned, in packed blocks; only the topics x terms factor (bounded by the vocabulary cut) and the topics x topics and
    topics x terms sums of a round pass through the driver. The factor is fitted on the keys of ``fit`` (all if not given; a packed
    matrix knows its fitted documents) and applied to every document. Returns (key, weights array), the term factor and the vocabulary.
    """
    packed = weights if isinstance(weights, matrix.TermMatrix) else _packed(weights, key, fit)
    spark = packed.blocks.sparkSession
    factor = np.random.default_rng(seed).random((topics, len(packed.vocabulary))) + 1e-3
    for i in range(iterations):
        a, b = matrix.factor_sums(packed, factor)
        for _ in range(10):
            factor *= b / np.maximum(a @ factor, 1e-12)
        factor = np.maximum(factor, 1e-12)
        if i % 5 == 4:  # shuffle files of past rounds stay on disk until the driver collects its garbage
            spark.sparkContext._jvm.System.gc()
    return matrix.topic_weights(packed, factor), factor, packed.vocabulary


def _packed(weights: DataFrame, key: str, fit: DataFrame | None) -> matrix.TermMatrix:
    spark = weights.sparkSession
    vocabulary = bounded_vocabulary(weights if fit is None else weights.join(fit.select(key).distinct(), key, "left_semi"))
    index = spark.createDataFrame(list(enumerate(vocabulary)), "i int, term string")
    rows = weights.join(F.broadcast(index), "term").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("i", "weight"))).alias("cells")).select(key, F.col("cells.i").alias("idx"), F.col("cells.weight").alias("val"))
    known = rows.withColumn("fitted", F.lit(True)) if fit is None else rows.join(fit.select(key, F.lit(True).alias("fitted")).distinct(), key, "left").withColumn("fitted", F.coalesce("fitted", F.lit(False)))
    return matrix.pack_weights(known, key, vocabulary)


def topic_rows(weights: DataFrame, key: str, strong: float = 0.20) -> DataFrame:
    """Dominant topic, its share of the row's weights, and whether it is strong; a zero row has no topic."""
    total = F.aggregate("topic_weights", F.lit(0.0), lambda a, b: a + b)
    best = F.array_max("topic_weights")
    return weights.select(key, F.when(total > 0, F.array_position("topic_weights", best) - 1).cast("int").alias("topic_id"), F.when(total > 0, best / total).otherwise(0.0).alias("topic_strength")).withColumn("strong_topic_flag", F.col("topic_strength") >= strong)


def top_terms(factor: np.ndarray, vocabulary: list[str], n: int = 10) -> list[list[str]]:
    return [[vocabulary[i] for i in sorted(range(len(vocabulary)), key=lambda i: (-row[i], vocabulary[i]))[:n]] for row in factor]


def pairwise_jaccard(terms: list[list[str]]) -> float:
    """Mean overlap of topics' top terms."""
    pairs = [(set(a), set(b)) for i, a in enumerate(terms) for b in terms[i + 1 :]]
    return sum(len(a & b) / max(1, len(a | b)) for a, b in pairs) / max(1, len(pairs))


def scan_topic_counts(weights: DataFrame, key: str, candidates: tuple[int, ...] = (12, 16, 20, 24), iterations: int = 15) -> pd.DataFrame:
    """Per number of topics: strong share, mean strength, largest topic share, term overlap, and a combined score."""
    rows = []
    for k in candidates:
        doc_topics, factor, vocabulary = nmf_topics(weights, key, k, iterations)
        per = topic_rows(doc_topics, key).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"), F.avg("topic_strength").alias("s"), F.count_if("strong_topic_flag").alias("strong")).toPandas()
        total = per["n"].sum()
        overlap = pairwise_jaccard(top_terms(factor, vocabulary))
        share = per["n"].max() / total
        strong = per["strong"].sum() / total
        rows.append((k, strong, float((per["s"] * per["n"]).sum() / total), share, overlap, strong * (1 - overlap) * (1 - share)))
    return pd.DataFrame(rows, columns=["topics", "strong_share", "mean_strength", "largest_share", "mean_jaccard", "score"])


def rank_terms(weights: DataFrame, n: int, by: list[str]) -> DataFrame:
    """The n heaviest terms per group."""
    return weights.withColumn("term_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("weight").desc(), "term"))).filter(F.col("term_rank") <= n)
