"""op10: a sparse rule ensemble for text quality.

Trees of a small random forest are taken apart into rules, each the conjunction of the conditions on a path. A logistic
model with a lasso penalty weighs the rules and drops most of them. What is left is compiled into one Spark column
expression over text statistics, so scoring needs neither Python nor the models.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricgraph.llm.common import stored, whole_rows

#: Bound of the fit: labelled rows that it sees. Trees, their depth, the lasso weight, and the seed of the forest.
MAX_ROWS, TREES, DEPTH, LASSO, SEED = 20_000, 12, 3, 2e-3, 7
THRESHOLD = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, as columns; shares are of characters or of words, and 0 for an empty text."""
    text = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    words = F.split(text, "\\s+")
    n_words = F.size(words)

    def share(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)) / chars

    return {
        "log_chars": F.log1p(F.length(text).cast("double")),
        "symbol_share": share("[#$%&*]"),
        "shout_share": share("!"),
        "bar_share": share("\\|"),
        "upper_share": share("\\p{Lu}"),
        "digit_share": share("[0-9]"),
        "stop_share": share("[.,;:?]"),
        "line_share": share("\n"),
        "word_length": F.length(text) / n_words,
        "distinct_share": F.size(F.array_distinct(words)) / n_words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    value: float

    def column(self) -> Column:
        return F.col(self.feature) > self.value if self.above else F.col(self.feature) <= self.value


Rule = tuple[Condition, ...]


def tree_rules(text: str, features: list[str]) -> list[Rule]:
    """The rules of a printed forest: one for each node below a root, the conjunction of the conditions above it."""
    rules: dict[Rule, None] = {}
    path: list[tuple[int, Condition]] = []
    for line in text.splitlines():
        depth = len(line) - len(line.lstrip())
        if line.lstrip().startswith("Tree"):
            path = []
        elif m := re.match(r"\s*(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line):
            path = [p for p in path if p[0] < depth]
            path.append((depth, Condition(features[int(m[1])], m[2] == ">", float(m[3]))))
            rules[tuple(c for _, c in path)] = None
    return list(rules)


@dataclass
class RuleEnsemble:
    """Rules with their weights, and the intercept."""

    intercept: float
    rules: list[tuple[float, Rule]]

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> RuleEnsemble:
        """Fit on labelled rows of docs whose crc32 of doc_id, modulo 5, is not 0; at most about max_rows of them."""
        labels = labels.filter("quality is not null and doc_id is not null").filter(~_held_out("doc_id"))
        labels = labels.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
        part = min(1.0, max_rows / max(1, labels.count()))
        chosen = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(part * 1_000_000))
        stats = statistics(F.col("text"))
        names = list(stats)
        table = stored(docs.select("doc_id", "text").join(chosen, "doc_id").select("label", *(c.cast("double").alias(n) for n, c in stats.items())), "training")
        n, mean = table.agg(F.count("*"), F.avg("label")).first()
        if not n or mean in (0.0, 1.0):  # nothing to tell labels apart by
            mean = min(max(mean, 1e-3), 1 - 1e-3) if n else 0.5
            return cls(math.log(mean / (1 - mean)), [])
        frame = VectorAssembler(inputCols=names, outputCol="features").transform(table.coalesce(8))
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", minInstancesPerNode=10).fit(frame)
        rules = tree_rules(forest.toDebugString, names)
        if not rules:
            return cls(math.log(mean / (1 - mean)), [])
        held = table.select("label", *(_holds(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)))
        frame = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(held.coalesce(8))
        model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, standardization=False, maxIter=100).fit(frame)
        weighed = zip(model.coefficients.toArray().tolist(), rules, strict=True)
        return cls(float(model.intercept), [(w, r) for w, r in weighed if abs(w) > 1e-6])

    def score(self, docs: DataFrame) -> DataFrame:
        """docs with score, the probability of label 1, computed from the columns of statistics.

        The other columns of docs travel as one struct, so their names cannot meet those of the statistics; a column
        named score is replaced.
        """
        total = F.lit(self.intercept)
        for w, rule in self.rules:
            total = total + F.when(_holds(rule), w).otherwise(0.0)
        rows = docs.select(whole_rows(docs, "score").alias("row"), *(c.alias(n) for n, c in statistics(F.col("text")).items()))
        return rows.select("row.*", (1 / (1 + F.exp(-total))).alias("score"))


def _holds(rule: Rule) -> Column:
    out = rule[0].column()
    for c in rule[1:]:
        out = out & c.column()
    return out


def _held_out(column: str) -> Column:
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(5)) == 0


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, one row for each row of docs(doc_id, text); labels has (doc_id, quality).

    held_out says that crc32(doc_id as text) mod 5 is 0: labels of those rows are never learnt from. A null text counts
    as empty and is scored like one. A null doc_id is not held out. Without labels every score is 0.5, and with
    labels of one sort alone every score is 0.001 or 0.999. Only the text
    enters a score; other columns are not read.
    """
    out = RuleEnsemble.fit(docs, labels).score(docs.select("doc_id", "text"))
    return out.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
