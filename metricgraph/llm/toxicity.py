"""op8: toxicity by a classifier chain.

The labelled rows say only whether a text is toxic. Kinds of toxicity are clusters of the toxic training texts by the words
they hold, so no word list is given. The chain predicts one kind, then the other, then toxicity at all; each later linear model also gets the probabilities of the categories before it. In training those are out-of-fold
predictions: a row's probability comes from models that were fitted without the row's fold.

Features are the words and word beginnings that set labelled toxic texts apart from the others, found by counts over the
training rows. Beginnings matter where a language adds endings to the same insult.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import CountVectorizerModel, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import stored, whole_rows

#: The chain in its order: kinds of toxicity found in the training texts, and toxicity itself.
KINDS = ("kind_1", "kind_2")
CHAIN = (*KINDS, "toxic")
#: Of the clustering.
SEED = 7
#: Bounds of the fit: labelled rows that it sees, words that it keeps, documents in which a kept word occurs at least.
MAX_ROWS, MAX_WORDS, MIN_DOCS, FOLDS = 20_000, 1_000, 5, 3
#: Lengths of the word beginnings.
BEGINNINGS = (4, 5, 7)
#: The training table is bounded, so a few tasks hold it.
TASKS = 6


def _words(docs: DataFrame, column: str) -> DataFrame:
    """docs with the distinct words of text, runs of letters in lower case, and their beginnings as "4:abcd"."""
    docs = docs.withColumn("_body", F.coalesce("text", F.lit("")))
    tokenizer = RegexTokenizer(inputCol="_body", outputCol=column, pattern="[^\\p{L}]+", gaps=True, toLowercase=True)
    out = tokenizer.transform(docs).drop("_body").withColumn(column, F.array_distinct(column))

    def beginnings(k: int) -> Column:
        return F.transform(column, lambda w: F.concat(F.lit(f"{k}:"), F.substring(w, 1, k)))

    return out.withColumn(column, F.concat(column, *map(beginnings, BEGINNINGS)))


def _vocabulary(training: DataFrame) -> list[str]:
    """The words that tell toxic training texts from the others best, by the log-likelihood ratio of their counts.

    (Log odds in standard deviations would rank a word that only toxic texts hold below common words that lean their way.)
    """
    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    all1, all0 = sizes.get(1, 0), sizes.get(0, 0)
    words = training.select("toxic", F.explode(F.array_distinct("words")).alias("word"))
    words = words.groupBy("word").agg(F.sum(F.col("toxic").cast("long")).alias("n1"), F.count("*").alias("n")).filter(F.col("n") >= MIN_DOCS)

    def term(found: Column, total: Column) -> Column:
        """The part of one kind of text: those with the word and those without, against what their share would be."""
        out = F.lit(0.0)
        for own, both in ((found, F.col("n")), (total - found, all1 + all0 - F.col("n"))):
            out = out + F.when(own > 0, own * F.log(own * (all1 + all0) / (total * both))).otherwise(0.0)
        return out

    ratio = term(F.col("n1"), F.lit(all1)) + term(F.col("n") - F.col("n1"), F.lit(all0))
    return [r["word"] for r in words.orderBy(ratio.desc(), "word").limit(MAX_WORDS).collect()]


class ToxicityChain:
    """The fitted chain: a vocabulary and one logistic model for each category."""

    def __init__(self, words: list[str], models: list[LogisticRegressionModel]):
        self.words, self.models = words, models

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> ToxicityChain:
        """Fit on the rows of docs with a label, at most about max_rows of them, chosen by a hash of doc_id.

        Where labels do not tell toxic rows from others (none of the one or of the other), the chain has no models.
        """
        labels = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        share = min(1.0, max_rows / max(1, labels.count()))
        chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
        training = _words(docs.select("doc_id", "text").join(chosen, "doc_id"), "words")
        training = training.withColumn("fold", F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)))
        training = training.select("doc_id", "fold", "toxic", F.array_distinct("words").alias("words"))
        training = stored(training, "training")
        known = training.agg(F.count_distinct("toxic")).first()[0]
        words = _vocabulary(training) if known == 2 else []
        if not words:
            return cls([], [])
        shared = F.array(*map(F.lit, words))
        table = stored(training.select("doc_id", "fold", F.col("toxic").cast("int").alias("toxic"), F.array_intersect("words", shared).alias("words")), "training")
        frame = _kinds(_vectors(table.coalesce(TASKS), words))
        models = []
        for i, name in enumerate(CHAIN):
            features = [f"p_{c}" for c in CHAIN[:i]]
            ready = _assembled(frame, features)
            if i + 1 == len(CHAIN):
                models.append(_fit(ready, name))
                break
            # One fit after the other: beside each other they took more memory than the driver has.
            whole, *without = (_fit(t, name) for t in (ready, *(ready.filter(F.col("fold") != fold) for fold in range(FOLDS))))
            models.append(whole)
            parts = [_scored(model, ready.filter(F.col("fold") == fold), f"p_{name}") for fold, model in enumerate(without)]
            frame = stored(reduce(DataFrame.unionByName, parts).drop("features").coalesce(TASKS), "training")
        return cls(words, models)

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with the probabilities p_kind_1, p_kind_2 and p_toxic. A null or empty text has no words and is scored as such.

        Without models every probability is 0: nothing is called toxic that no label tells about. The columns of docs travel as one struct, so their names cannot meet those of the steps.
        """
        if not self.models:
            return docs.select("*", *(F.lit(0.0).alias(f"p_{c}") for c in CHAIN))
        frame = _vectors(_words(docs.select(whole_rows(docs).alias("_row"), "text"), "words"), self.words)
        for i, (name, model) in enumerate(zip(CHAIN, self.models, strict=True)):
            frame = _scored(model, _assembled(frame, [f"p_{c}" for c in CHAIN[:i]]), f"p_{name}").drop("features")
        return frame.select("_row.*", *(f"p_{c}" for c in CHAIN))


def _kinds(frame: DataFrame) -> DataFrame:
    """frame with a 0/1 column for each kind: to which cluster of toxic rows a toxic row belongs."""
    toxic = frame.filter("toxic = 1")
    if toxic.count() <= len(KINDS):
        return frame.withColumns({k: F.lit(0) if i else F.col("toxic") for i, k in enumerate(KINDS)})
    model = KMeans(k=len(KINDS), seed=SEED, featuresCol="counts", predictionCol="cluster").fit(toxic)
    told = model.transform(frame)
    return told.withColumns({k: ((F.col("toxic") == 1) & (F.col("cluster") == i)).cast("int") for i, k in enumerate(KINDS)}).drop("cluster")


def _vectors(frame: DataFrame, words: list[str]) -> DataFrame:
    model = CountVectorizerModel.from_vocabulary(words, inputCol="words", outputCol="counts", minTF=1.0)
    return model.setBinary(True).transform(frame).drop("words")


def _assembled(frame: DataFrame, chained: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=["counts", *chained], outputCol="features").transform(frame)


def _fit(frame: DataFrame, label: str) -> LogisticRegressionModel:
    return LogisticRegression(labelCol=label, featuresCol="features", regParam=2e-4, standardization=False, maxIter=40).fit(frame)


def _scored(model: LogisticRegressionModel, frame: DataFrame, column: str) -> DataFrame:
    model = model.setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    return model.transform(frame).withColumn(column, vector_to_array("_probability")[1]).drop("_probability")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, p_kind_1, p_kind_2, p_toxic, toxic (p_toxic >= threshold), one row for each row of docs(doc_id, text).

    labels has (doc_id, toxic); rows without either are left out of the fit. Unless there are labelled documents of both
    sorts, every probability is 0 and nothing is toxic. Null and repeated doc_ids pass through; other columns are not read.
    """
    scored = ToxicityChain.fit(docs, labels).score(docs.select("doc_id", "text"))
    return scored.select("doc_id", *(f"p_{c}" for c in CHAIN), (F.col("p_toxic") >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the chain does not call toxic, with all columns of docs."""
    scored = ToxicityChain.fit(docs, labels).score(docs.select(whole_rows(docs).alias("_docs"), "text"))
    return scored.filter(F.col("p_toxic") < threshold).select("_docs.*")
