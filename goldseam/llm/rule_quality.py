"""A quality classifier made of rules: tree paths, weighed by a lasso logistic fit.

Shallow random trees over statistics of the whole text propose conjunctions
("distinct_words <= 0.41 and log_words > 3.2"); a logistic regression with an L1
penalty keeps the few that matter. Trees and weights are fitted by Spark on all
labelled rows, and the rules become one column expression, so that scoring is a
projection without Python or a shuffle.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldseam.llm.common import cut, fresh, whole

TREES, DEPTH, PENALTY, SEED, ACCEPT = 24, 3, 0.001, 7, 0.3
STATISTICS = (
    "log_words", "word_length", "distinct_words", "distinct_lines", "line_words", "marks", "odd_marks", "capitals",
    "digits", "short_words", "repeats",
)
Rule = tuple[tuple[str, str, float], ...]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self, value: Callable[[str], Column]) -> Column:
        """Probability of label 1; ``value`` gives the column of a statistic."""
        total = F.lit(self.bias)
        for rule, weight in self.weights:
            total = total + F.when(holds(rule, value), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: Rule, value: Callable[[str], Column]) -> Column:
    tests = [value(name) <= F.lit(bound) if sign == "<=" else value(name) > F.lit(bound) for name, sign, bound in rule]
    return functools.reduce(operator.and_, tests)


def with_statistics(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Adds a struct of STATISTICS of the whole text. A null or empty text has zeros."""
    body, words, lines = fresh(frame, "_body", "_words", "_lines")
    split = frame.withColumn(body, whole(F.col(text)))
    split = split.withColumns(
        {words: F.filter(F.split(body, r"\s+"), lambda w: w != ""), lines: F.split(body, "\n")}
    )
    n, chars = F.size(words), F.length(body)

    def share(count: Column, total: Column) -> Column:
        return F.coalesce(F.try_divide(count.cast("double"), total.cast("double")), F.lit(0.0))

    def count(pattern: str) -> Column:
        return F.regexp_count(body, F.lit(pattern))

    columns = {
        "log_words": F.log1p(n.cast("double")),
        "word_length": share(chars, n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
        "marks": share(count(r"[^\p{L}\p{N}\s]"), chars),
        "odd_marks": share(count(r"[#$%&*|!~^<>{}=_\\]"), chars),
        "capitals": share(count(r"\p{Lu}"), chars),
        "digits": share(count("[0-9]"), chars),
        "short_words": share(count(r"(?<!\S)\S{1,3}(?!\S)"), n),
        "repeats": share(count(r"(?<!\S)(\S+)\s+\1(?!\S)"), n),
    }
    return split.withColumn(name, F.struct(*(columns[s].alias(s) for s in STATISTICS))).drop(body, words, lines)


def tree_rules(text: str) -> set[Rule]:
    """The paths to all nodes of a printed tree, as conjunctions with one bound for each side of a statistic."""
    found: set[Rule] = set()
    path: list[tuple[int, tuple[str, str, float]]] = []
    for line in text.splitlines():
        match = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([^)]+)\)", line)
        if not match:
            continue
        depth = len(match[1])
        path = [p for p in path if p[0] < depth]
        path.append((depth, (STATISTICS[int(match[2])], match[3], float(match[4]))))
        bounds: dict[tuple[str, str], float] = {}
        for _, (name, sign, bound) in path:
            held = bounds.get((name, sign), bound)
            bounds[name, sign] = min(held, bound) if sign == "<=" else max(held, bound)
        found.add(tuple(sorted((name, sign, bound) for (name, sign), bound in bounds.items())))
    return found


def fit_rules(
    labelled: DataFrame, label: str = "label", statistics: str = "statistics", trees: int = TREES, depth: int = DEPTH,
    penalty: float = PENALTY, seed: int = SEED,
) -> RuleModel:
    """Fit on all rows of (statistics struct, label 0 or 1). Without both labels the score is a constant, 0.5 without any."""
    vector = array_to_vector(F.array(*(F.col(f"{statistics}.{s}") for s in STATISTICS)))
    rows = cut(labelled.select(statistics, F.col(label).cast("double").alias("label"), vector.alias("vector")))
    ones, total = rows.agg(F.sum("label"), F.count("*")).first()
    if not total or ones in (0, total):
        return RuleModel(0.0 if not total else 4.0 if ones else -4.0, ())
    forest = RandomForestClassifier(
        featuresCol="vector", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird"
    ).fit(rows)
    rules = sorted(set().union(*(tree_rules(tree.toDebugString) for tree in forest.trees)))
    value = lambda name: F.col(f"{statistics}.{name}")
    tests = F.array(*(holds(rule, value).cast("double") for rule in rules))
    lasso = LogisticRegression(
        featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60
    ).fit(rows.select("label", array_to_vector(tests).alias("rules")))
    weights = tuple((r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    return RuleModel(float(lasso.intercept), weights)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality"):
    """The model and the statistics of all documents (key, statistics), computed once.

    Labels of held-out keys are never read; null labels and keys are passed over; of
    several labels of a key the largest counts.
    """
    stats = cut(with_statistics(docs.select(key, text), text, "statistics").select(key, "statistics"))
    known = (
        labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull() & ~is_held_out(F.col(key)))
        .groupBy(key).agg(F.max(label).alias("label"))
    )
    ordered = stats.join(known, key).repartition(key).sortWithinPartitions(key)
    return fit_rules(ordered), stats


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", accept: float = ACCEPT) -> DataFrame:
    """One row per document: key, held_out, score, predicted. Repeated rows score alike; no rows in, none out."""
    model, stats = train(docs, labels, key)
    score = model.score(lambda name: F.col(f"statistics.{name}"))
    return stats.select(key, is_held_out(F.col(key)).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= accept).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The documents with a score of at least ``accept``, all columns."""
    model, _ = train(docs, labels, key, text)
    name = fresh(docs, "_statistics")[0]
    scored = with_statistics(docs, text, name)
    return scored.filter(model.score(lambda s: F.col(f"{name}.{s}")) >= accept).drop(name)
