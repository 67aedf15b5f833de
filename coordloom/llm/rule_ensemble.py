"""A quality classifier: rules from trees, lasso weights, compiled into one expression."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coordloom.llm.text_stats import BASE, MORE, with_measures
from coordloom.session import cut

#: The most labelled rows a model is fitted on.
TRAINING_ROWS = 20_000
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.0005, 17
#: Scores from here on count as label 1.
KEEP_FROM = 0.3
_STEPS, _PIECES = 1_000_000, 8

#: Statistics of a text, over its measurements.
STATISTICS = {
    "words": "log1p(n_words)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "longest_word": "log1p(max_word)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "upper": "n_upper / greatest(n_upper + n_lower, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "ends": "n_ends / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "distinct_of_length": "n_distinct_words / pow(greatest(n_words, 1), 0.9)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "same_next": "n_same_next / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "log1p(n_words / greatest(n_lines, 1))",
}

Test = tuple[int, str, float]


@dataclass(frozen=True)
class Model:
    """A bias and weighted conjunctions of tests on the statistics."""

    bias: float
    rules: tuple[tuple[tuple[Test, ...], float], ...]

    def score(self) -> Column:
        """Probability of label 1 as an expression over the measurements."""
        total = F.lit(self.bias)
        for tests, weight in self.rules:
            total = total + F.when(_holds(tests), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _statistic(k: int) -> Column:
    return F.expr(list(STATISTICS.values())[k]).cast("double")


def _holds(tests: tuple[Test, ...]) -> Column:
    held = F.lit(True)
    for k, sign, border in tests:
        held = held & ((_statistic(k) <= border) if sign == "<=" else (_statistic(k) > border))
    return held


def tree_rules(described: str) -> list[tuple[Test, ...]]:
    """All paths from a root in Spark's description of an ensemble, inner ones too.

    Tests on one statistic in one direction are merged into the tightest.
    """
    found, path = {}, []
    for line in described.splitlines():
        depth = len(line) - len(line.lstrip())
        m = re.match(r"(?:If|Else) \(feature (\d+) (<=|>) ([-+.\w]+)\)", line.lstrip())
        if not m:
            continue
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (int(m[1]), m[2], float(m[3]))))
        tight: dict[tuple[int, str], float] = {}
        for _, (k, sign, border) in path:
            known = tight.get((k, sign), border)
            tight[k, sign] = min(known, border) if sign == "<=" else max(known, border)
        found[tuple(sorted((k, s, b) for (k, s), b in tight.items()))] = None
    return list(found)


def in_fold(key: Column, folds: int = 5) -> Column:
    """Whether a key's row is held out of training: crc32 of its text is 0 in the folds."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == 0, F.lit(False))


def training_rows(documents: DataFrame, labels: DataFrame, key: str = "doc_id",
                  label: str = "quality", text: str = "text",
                  at_most: int = TRAINING_ROWS) -> DataFrame:
    """``label`` and measurements of labelled texts outside the held-out fold.

    Where more than ``at_most`` keys are labelled, a share of them by hash is taken; of rows
    that repeat a key and its text one, and of more than ``at_most`` such rows a share again.
    A key with several labels counts with its smallest; null labels are left out. The
    keys taken are few by that bound and are therefore broadcast.
    """
    known = (labels.filter(~in_fold(F.col(key)) & F.col(key).isNotNull() & F.col(label).isNotNull())
             .groupBy(key).agg(F.min(label).cast("double").alias("label")))
    n = known.count()
    if n > at_most:
        share = int(_STEPS * at_most / n)
        known = known.filter(F.pmod(F.xxhash64(key), F.lit(_STEPS)) < share)
    texts = documents.select(F.col(key), F.col(text).alias("text"))
    drawn = F.pmod(F.xxhash64(key, "text"), F.lit(_STEPS)).alias("drawn")
    once = texts.join(F.broadcast(known), key).dropDuplicates([key, "text"]).select("label", "text", drawn)
    rows = cut(with_measures(once, "text", more=True).select("label", "drawn", *BASE, *MORE))
    n = rows.count()
    if n > at_most:
        rows = rows.filter(F.col("drawn") < int(_STEPS * at_most / n))
    # The trees draw rows by their place, so the order is made the same in every run.
    return rows.repartition(_PIECES, "drawn").sortWithinPartitions(
        "drawn", "label", *BASE, *MORE).drop("drawn")


def fit(rows: DataFrame) -> Model:
    """Trees on the statistics, their paths as rules, lasso logistic weights for these.

    Without rows, or with one class alone, the model is a constant (0.5 or near the class).
    """
    shares = rows.agg(F.count("*").alias("n"), F.avg("label").alias("one")).first()
    if not shares["n"] or shares["one"] in (0.0, 1.0):
        return Model({None: 0.0, 0.0: -4.0, 1.0: 4.0}[shares["one"]], ())
    vectors = cut(rows.select("label", *BASE, *MORE, F.array(
        *map(_statistic, range(len(STATISTICS)))).alias("values")))
    trees = RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED,
        minInstancesPerNode=3, featureSubsetStrategy="onethird",
    ).fit(vectors.select("label", array_to_vector("values").alias("features")))
    rules = tree_rules(trees.toDebugString)
    if not rules:
        return Model(0.0, ())
    held = vectors.select("label", array_to_vector(F.array(*(
        _holds(r).cast("double") for r in rules))).alias("features"))
    lasso = LogisticRegression(
        featuresCol="features", labelCol="label", elasticNetParam=1.0, regParam=PENALTY,
        maxIter=60, standardization=False,
    ).fit(held)
    weights = lasso.coefficients.toArray().tolist()
    return Model(lasso.intercept, tuple((r, w) for r, w in zip(rules, weights) if w))


def scored(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``documents`` with measurements and ``score``, in one pass without a shuffle.

    Null and empty texts are scored like any other, with measurements of zero. Columns
    with the names of measurements are replaced; repeated rows stay.
    """
    return with_measures(documents.drop("score"), text, more=True).withColumn("score", model.score())


def accepted(documents: DataFrame, model: Model, text: str = "text",
             keep_from: float = KEEP_FROM) -> DataFrame:
    """The documents that score ``keep_from`` or more, with their columns as they were."""
    packed = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("own"),
                              F.col(f"`{text}`").alias("text"))
    return scored(packed, model).filter(F.col("score") >= keep_from).select("own.*")
