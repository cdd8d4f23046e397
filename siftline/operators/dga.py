"""Generated-domain detection: n-gram scores, features, a random forest.

Domains shorter than seven characters are left out of training; names the popular n-grams and the
dictionary both score low, though labelled legitimate, become 'weird' and are not trained on.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import char_ngrams, entropy

FEATURES = ["length", "entropy", "alexa_grams", "word_grams"]


def ngram_counts(words: DataFrame, column: str, min_df: float = 0.0) -> DataFrame:
    """``gram, cf, df, weight``: occurrences, words that hold it, log10 of occurrences; grams in a share of words below ``min_df`` are dropped."""
    w = words.where(F.col(column).isNotNull()).select(F.col(column).alias("w"))
    total = w.count()
    numbered = w.withColumn("i", F.monotonically_increasing_id())
    per = numbered.select("i", F.explode(char_ngrams(F.col("w"))).alias("gram")).groupBy("i", "gram").agg(F.count("*").alias("tf"))
    out = per.groupBy("gram").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))
    return out.where(F.col("df") >= min_df * total).select("gram", "cf", "df", F.log10("cf").alias("weight"))


def ngram_score(words: DataFrame, key: str, column: str, grams: DataFrame, out: str) -> DataFrame:
    """Add ``out``: sum of the weights of a word's n-grams, with repeats; 0 without a known one."""
    hits = words.select(key, F.explode(char_ngrams(F.col(column))).alias("gram")).groupBy(key, "gram").agg(F.count("*").alias("tf")).join(grams.select("gram", "weight"), "gram")
    score = hits.groupBy(key).agg(F.sum(F.col("tf") * F.col("weight")).alias(out))
    return words.join(score, key, "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def features(domains: DataFrame, popular: DataFrame, dictionary: DataFrame, key: str = "id", column: str = "domain") -> DataFrame:
    x = domains.withColumn("length", F.length(column)).withColumn("entropy", entropy(F.col(column)))
    x = ngram_score(x, key, column, popular, "alexa_grams")
    x = ngram_score(x, key, column, dictionary, "word_grams")
    return x.withColumn("diff", F.col("alexa_grams") - F.col("word_grams"))


def mark_weird(x: DataFrame, low_popular: float = 3.0, low_words: float = 2.0) -> DataFrame:
    weird = (F.col("class") == "legit") & (F.col("word_grams") < low_words) & (F.col("alexa_grams") < low_popular)
    return x.withColumn("class", F.when(weird, "weird").otherwise(F.col("class")))


def train(x: DataFrame, trees: int = 20, seed: int = 1):
    """A fitted pipeline over legit and dga rows of more than six characters."""
    rows = x.where((F.col("class") != "weird") & (F.col("length") > 6))
    index = StringIndexer(inputCol="class", outputCol="label", stringOrderType="alphabetAsc")
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="features")
    return Pipeline(stages=[index, assemble, RandomForestClassifier(numTrees=trees, seed=seed)]).fit(rows)


def evaluate(model, x: DataFrame) -> DataFrame:
    """Add ``prediction`` as a class name."""
    labels = model.stages[0].labels
    scored = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(x)
    scored = model.stages[2].transform(scored)
    return scored.withColumn("prediction", F.get(F.array(*[F.lit(v) for v in labels]), F.col("prediction").cast("int"))).drop("features", "rawPrediction", "probability")


def save(model, grams: dict[str, DataFrame], path: str) -> None:
    model.write().overwrite().save(f"{path}/model")
    for name, df in grams.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark, path: str, names: tuple[str, ...] = ("popular", "dictionary")) -> tuple[PipelineModel, dict[str, DataFrame]]:
    """A saved model and its n-gram tables."""
    return PipelineModel.load(f"{path}/model"), {n: spark.read.parquet(f"{path}/{n}") for n in names}


def score(names: DataFrame, model: PipelineModel, popular: DataFrame, dictionary: DataFrame, grams_on: str = "domain") -> DataFrame:
    """Class of each ``id, domain`` (or whole ``uri``) row by a fitted model.

    ``grams_on`` is the column that n-grams, length and entropy are taken from: the domain label, or
    the whole URI for models that were fitted on URIs. Null texts are left out.
    """
    known = names.where(F.col(grams_on).isNotNull())
    return evaluate(model, features(known, popular, dictionary, "id", grams_on))
