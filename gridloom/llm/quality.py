"""Quality by a sparse ensemble of rules.

Statistics of the text are computed as Spark columns. A forest of shallow trees, grown on the labelled
rows, gives candidate rules: every path from the root to a node is a conjunction of comparisons. A
logistic regression with an L1 penalty weighs the rules and leaves most of them out. What remains is
compiled into one Spark column expression, so scoring needs no Python and no shuffle.

Fitting reads statistics and labels only, through Spark ML on the cluster; nothing is sampled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.cluster import quoted
from gridloom.llm.common import saved, whole_text

THRESHOLD = 0.3
FOLDS = 5
TREES = 24
DEPTH = 3
PENALTY = 0.0008
SEED = 11
LABEL_FILES, ROWS_OF_A_FILE = 32, 500_000
"""Files that the labelled statistics are written to, at least, and labels that one more file is made for; a row
has under a hundred bytes."""


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _per(amount: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(amount) / F.col(whole)).otherwise(F.lit(0.0))


# In three steps, each a projection of its own: Spark computes a column that the next step uses twice only once.
_CUT = {
    "text": lambda: whole_text("_text"),
    "words": lambda: F.split(F.trim(whole_text("_text")), "\\s+"),
    "lines": lambda: F.split(whole_text("_text"), "\n"),
}
_COUNTED = {
    "chars": lambda: F.length("_cut_text"),
    "uppers": lambda: _count(F.col("_cut_text"), "\\p{Lu}+"),
    "signs": lambda: _count(F.col("_cut_text"), "[^\\p{L}\\p{N}\\s.,;:?'-]+"),
    "digits": lambda: _count(F.col("_cut_text"), "[0-9]+"),
    "stops": lambda: _count(F.col("_cut_text"), "[.,;:?]+"),
    "words": lambda: F.when(F.length("_cut_text") > 0, F.size("_cut_words")).otherwise(F.lit(0)),
    "distinct_words": lambda: F.size(F.array_distinct("_cut_words")),
    "lines": lambda: F.size("_cut_lines"),
    "distinct_lines": lambda: F.size(F.array_distinct("_cut_lines")),
}
_STATISTICS = {
    "chars": lambda: F.log1p(F.col("_n_chars").cast("double")),
    "upper": lambda: _per("_n_uppers", "_n_chars"),
    "symbols": lambda: _per("_n_signs", "_n_chars"),
    "digits": lambda: _per("_n_digits", "_n_chars"),
    "stops": lambda: _per("_n_stops", "_n_words"),
    "word_length": lambda: F.when(F.col("_n_words") > 0, (F.col("_n_chars") - F.col("_n_words")) / F.col("_n_words")).otherwise(F.lit(0.0)),
    "distinct_words": lambda: _per("_n_distinct_words", "_n_words"),
    "distinct_lines": lambda: _per("_n_distinct_lines", "_n_lines"),
    "line_words": lambda: _per("_n_words", "_n_lines"),
}
STATISTICS = tuple(_STATISTICS)


def _measured(rows: DataFrame, keep: list[str], *more: Column) -> DataFrame:
    """``keep`` and the statistics, as ``stat_`` columns, of rows with a ``_text``. All are numbers, also for an empty text."""
    cut = rows.select(*keep, *(c().alias(f"_cut_{n}") for n, c in _CUT.items()))
    counted = cut.select(*keep, *(c().alias(f"_n_{n}") for n, c in _COUNTED.items()))
    return counted.select(*keep, *(c().cast("double").alias(f"stat_{n}") for n, c in _STATISTICS.items()), *more)


def with_statistics(docs: DataFrame, *keep: str, text_column: str = "text") -> DataFrame:
    return _measured(docs.select(*keep, F.col(text_column).alias("_text")), list(keep))


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether at most, bound), and its weight."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def holds(self, column: dict[str, Column]) -> Column:
        test = F.lit(True)
        for name, at_most, bound in self.terms:
            test = test & (column[name] <= bound if at_most else column[name] > bound)
        return test


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules over statistics; the score is the logistic function of their sum."""

    rules: tuple[Rule, ...]
    intercept: float

    def score(self, column: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule in self.rules:
            total = total + F.when(rule.holds(column), F.lit(rule.weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _paths(node, names: list[str], so_far: dict) -> list[tuple]:
    """The conjunctions that lead to the nodes below; a statistic has one bound in each direction."""
    if not node.subtreeDepth():
        return []
    split = node.split()
    name, bound = names[split.featureIndex()], float(split.threshold())
    found = []
    for child, at_most in ((node.leftChild(), True), (node.rightChild(), False)):
        terms = dict(so_far)
        tighter = min if at_most else max
        terms[name, at_most] = tighter(bound, terms.get((name, at_most), bound))
        found.append(tuple(sorted((n, side, b) for (n, side), b in terms.items())))
        found += _paths(child, names, terms)
    return found


def fit(labelled: DataFrame, label: str = "label", trees: int = TREES, depth: int = DEPTH,
        penalty: float = PENALTY) -> RuleEnsemble:
    """Learns from rows with ``stat_`` columns and a label 0 or 1.

    With labels of one kind only, or none, the ensemble has no rules and scores their share (0.5 if none).
    """
    names = [c[5:] for c in labelled.columns if c.startswith("stat_")]
    seen = labelled.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    if not seen["n"] or seen["ones"] in (0, seen["n"]):
        import math

        share = (seen["ones"] + 0.5) / (seen["n"] + 1) if seen["n"] else 0.5
        return RuleEnsemble((), math.log(share / (1 - share)))
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    vectors = VectorAssembler(inputCols=[f"stat_{n}" for n in names], outputCol="features")
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.6", minInstancesPerNode=5,
        bootstrap=False, labelCol=label, seed=SEED).fit(vectors.transform(labelled))
    conjunctions = sorted({p for tree in forest.trees for p in _paths(tree._call_java("rootNode"), names, {})})
    if not conjunctions:
        return fit(labelled.where(F.col(label) == 1).limit(0), label)
    column = {n: F.col(f"stat_{n}") for n in names}
    tested = labelled.select(label, *(
        Rule(terms).holds(column).cast("double").alias(f"rule_{i}") for i, terms in enumerate(conjunctions)))
    rules = VectorAssembler(inputCols=[f"rule_{i}" for i in range(len(conjunctions))], outputCol="features")
    lasso = LogisticRegression(labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True)
    model = lasso.fit(rules.transform(tested).select(label, "features"))
    return RuleEnsemble(
        tuple(Rule(terms, float(w)) for terms, w in zip(conjunctions, model.coefficients) if w), float(model.intercept))


def is_held_out(id_column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    known = labels.where(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("double").alias("label"))
    # the same rows in the same order whatever the input's files are, so that every fit finds the same rules
    files = max(LABEL_FILES, -(-labels.count() // ROWS_OF_A_FILE))
    placed = stats.where(~is_held_out()).join(known, "doc_id").repartition(files, "doc_id")
    return saved(placed.sortWithinPartitions(*placed.columns), "labelled")


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted.

    Labels are learnt from documents that are not held out; a document labelled twice counts as its
    higher label. Texts are scored whole; null counts as empty. Rows that repeat a doc_id each get
    their own score. Other columns of either table are ignored. No labels: every score is 0.5.
    """
    stats = saved(with_statistics(docs, "doc_id"), "statistics")
    ensemble = fit(_labelled(stats, labels))
    score = ensemble.score({n: F.col(f"stat_{n}") for n in STATISTICS})
    return stats.select("doc_id", is_held_out().alias("held_out"), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def drop_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns. Learns as above."""
    ensemble = fit(_labelled(with_statistics(docs, "doc_id"), labels))
    # the row in one column, so that its names cannot clash with those of the statistics
    rows = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row"), F.col("text").alias("_text"))
    # a filter is not moved below a column that is not deterministic, and this one uses it: else the statistics
    # would be computed anew for every comparison of the rules
    score = ensemble.score({n: F.col(f"stat_{n}") for n in STATISTICS})
    fence = F.spark_partition_id().alias("_fence")
    kept = _measured(rows, ["_row"], fence).where((score >= threshold) & (F.col("_fence") >= 0))
    return kept.select(*(F.col(f"_row.{quoted(c)}").alias(c) for c in docs.columns))
