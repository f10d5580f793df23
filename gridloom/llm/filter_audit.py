"""Which filter of a chain removes what: step counts for every order, and exact Shapley values.

Every document is reduced to the set of filters that it fails. A table of all coalitions (sets of
filters) says how many documents each would remove; with five filters that is 32 numbers for a part of
the corpus, however large it is. Everything else follows from that table: a step of an order removes the
difference of two coalitions, and the Shapley values of the filters are the solution of a least-squares
problem. Over all coalitions S but the empty and the full one, the sum of w(S) (v(S) - sum of phi in S)^2
is minimal, with the kernel weights w(S) = (n - 1) / (C(n, s) s (n - s)), under the constraint that all
phi sum to v(all). Its normal equations are solved in fractions, so that the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import saved, whole_text

SEPARATORS = r"[\x20\x09-\x0D]+"
MIN_WORDS, MIN_DISTINCT_SHARE, MAX_CAPITAL_SHARE = 200, 50, 3
"""Words at least; distinct words and capital letters as hundredths of words and code points."""
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "[#$%&*|]"

Failure = Callable[[Column], Column]


def words_of(text: Column) -> Column:
    """Runs of characters that are no white space of ASCII."""
    return F.filter(F.split(text, SEPARATORS), lambda w: w != "")


def too_short(text: Column) -> Column:
    return F.size(words_of(text)) < MIN_WORDS


def too_repetitive(text: Column) -> Column:
    words = words_of(text)
    return F.size(F.array_distinct(words)).cast("bigint") * 100 < F.size(words).cast("bigint") * MIN_DISTINCT_SHARE


def too_loud(text: Column) -> Column:
    chars = F.length(text).cast("bigint")
    return (chars - F.length(F.translate(text, CAPITALS, ""))) * 100 > chars * MAX_CAPITAL_SHARE


def has_marks(text: Column) -> Column:
    return text.rlike(MARKS)


FILTERS: dict[str, Failure] = {"A": too_short, "B": too_repetitive, "C": too_loud, "D": has_marks}
"""The filters that look at one text; whether it repeats is one more."""
REPEATED = "E"


def failures(docs: DataFrame, filters: dict[str, Failure] = FILTERS, repeated: str | None = REPEATED,
             part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per document: doc_id, part, and failed, the bits of the filters that it fails, in their order.

    ``repeated`` names one more filter, the last bit: the text is that of a row with a smaller id anywhere
    in the table. A null text is empty, a null part the empty string. A row without an id repeats nothing,
    and is not what another one repeats.
    """
    text = whole_text(text_column)
    bits = F.lit(0)
    for place, failed in enumerate(filters.values()):
        bits = bits.bitwiseOR(F.when(failed(text), F.lit(1 << place)).otherwise(F.lit(0)))
    rows = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        bits.alias("failed"), F.unhex(F.sha2(F.encode(text, "utf-8"), 256)).alias("sha"))
    if repeated is None:
        return rows.drop("sha")
    # texts stay where they are; digests are written down, so that Spark can split a large group of copies
    rows = saved(rows, "failures")
    firsts = saved(rows.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1"), "first-copies")
    later = F.when(F.col("doc_id") > F.col("first_id"), F.lit(1 << len(filters))).otherwise(F.lit(0))
    return rows.join(firsts, "sha", "left").select(
        "doc_id", "part", F.col("failed").bitwiseOR(F.coalesce(later, F.lit(0))).alias("failed"))


def coalitions(failed: DataFrame, filters: int, weights: list[str]) -> DataFrame:
    """part, coalition (bits of filters), removed, and for each weight the sum over what is removed.

    The coalition of no filters removes nothing; its row has the totals of the part in ``total``.
    """
    sums = [F.sum(w).cast("bigint").alias(w) for w in weights]
    kinds = failed.groupBy("part", "failed").agg(F.count("*").alias("removed"), *sums)
    every = kinds.select("*", F.explode(F.sequence(F.lit(0), F.lit((1 << filters) - 1))).alias("coalition"))
    hit = F.col("failed").bitwiseAND(F.col("coalition")) != 0
    return every.groupBy("part", "coalition").agg(
        F.sum("removed").cast("bigint").alias("total"),
        *(F.coalesce(F.sum(F.when(hit, F.col(c))), F.lit(0)).cast("bigint").alias(c) for c in ["removed", *weights]))


def _solved(matrix: list[list[Fraction]], right: list[Fraction]) -> list[Fraction]:
    """The solution of a regular system, by elimination in fractions."""
    rows = [[*row, value] for row, value in zip(matrix, right)]
    size = len(rows)
    for at in range(size):
        pivot = next(i for i in range(at, size) if rows[i][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for i in range(size):
            if i != at and rows[i][at]:
                rows[i] = [x - rows[i][at] * y for x, y in zip(rows[i], rows[at])]
    return [row[size] for row in rows]


def shapley_values(removed: list[int]) -> list[Fraction]:
    """The Shapley value of each filter, given what each coalition (by its bits) removes."""
    n = (len(removed) - 1).bit_length()
    if n == 1:
        return [Fraction(removed[1])]
    normal = [[Fraction(0)] * n for _ in range(n)]
    right = [Fraction(0)] * n
    for coalition in range(1, (1 << n) - 1):
        members = [i for i in range(n) if coalition >> i & 1]
        weight = Fraction(n - 1, comb(n, len(members)) * len(members) * (n - len(members)))
        for i in members:
            right[i] += weight * removed[coalition]
            for j in members:
                normal[i][j] += weight
    # the last unknown is the multiplier of the constraint that the values sum to what all filters remove
    system = [[*row, Fraction(1)] for row in normal] + [[Fraction(1)] * n + [Fraction(0)]]
    return _solved(system, [*right, Fraction(removed[-1])])[:n]


def _steps(names: list[str], weights: list[str]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    """What a part's coalitions say of every step of every order."""
    n, every = len(names), (1 << len(names)) - 1

    def of(part: tuple, table: pd.DataFrame) -> pd.DataFrame:
        by = table.sort_values("coalition")
        total, removed = int(by["total"].iloc[0]), by["removed"].tolist()
        lost = {w: by[w].tolist() for w in weights}
        shares = [value * factorial(n) for value in shapley_values(removed)]
        found = []
        for order in permutations(range(n)):
            before = 0
            for step, i in enumerate(order, 1):
                after = before | 1 << i
                here = removed[after] - removed[before]
                found.append((
                    part[0], "".join(names[j] for j in order), step, total - removed[after], here, removed[1 << i] - here,
                    removed[every] - removed[every & ~(1 << i)], *(v[after] - v[before] for v in lost.values()), int(shares[i])))
                before = after
        return pd.DataFrame(found, columns=[
            "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *(f"{w}_lost" for w in weights), "shapley"])

    return of


def filter_audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Failure] = FILTERS, repeated: str | None = REPEATED,
                 part: str = "lang", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    ``shapley`` is what the step's filter removes, summed over all orders (its Shapley value times their
    number). A document is good or toxic if any row of ``labels`` with its id says so by a 1. Rows that
    repeat each count; other columns are ignored; a table without rows has no parts and gives no rows.
    """
    names = [*filters, *([repeated] if repeated else [])]
    failed = failures(docs, filters, repeated, part, id_column, text_column)
    said = labels.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    weights = ["good", "toxic"]
    marked = failed.join(said, "doc_id", "left").fillna(0, weights)
    kinds = ", ".join(f"{c} bigint" for c in ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])
    return coalitions(marked, len(names), weights).groupBy("part").applyInPandas(
        _steps(names, weights), f"part string, filter_order string, step int, {kinds}")
