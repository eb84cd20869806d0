"""Functional dependencies X -> target of any size, exact or but for a share of the rows, by stripped partitions.

A set of columns partitions the rows by their values. Of its classes only those matter that hold several values of the
target: rows alone in their class, and classes of one target value, stay so under any larger set, so they are stripped.
The partitions of a level are one table (set, row, class); a set's partition is the product of that of the set without
its last column and that of the last column, a join on the row. Tables shrink from level to level, and a level is
one job for all its sets.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import cut, discard


def _classes(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, n, top, rep) of each class: rows, rows of its most frequent target value, smallest row. Counted per value first, so that no class meets in one task."""
    per = parts.groupBy(*by, "y").agg(F.count("*").alias("c"), F.min("row").alias("r"))
    return per.groupBy(*by).agg(F.sum("c").alias("n"), F.max("c").alias("top"), F.min("r").alias("rep"))


def _stripped(parts: DataFrame, classes: DataFrame, by: list[str]) -> DataFrame:
    """(set, row, y, class) of the rows whose class has several target values."""
    mixed = classes.where("n > top").select(*[F.col(c).alias(f"__{c}") for c in by], "rep")
    return parts.join(mixed, [F.col(c) == F.col(f"__{c}") for c in by]).select("set", "row", "y", F.col("rep").alias("class"))


def _errors(classes: DataFrame) -> dict[int, int]:
    """Rows outside the most frequent target value of their class, per set."""
    return {r["set"]: r.e for r in classes.where("n > top").groupBy("set").agg(F.sum(F.col("n") - F.col("top")).alias("e")).collect()}


def functional_dependencies(df: DataFrame, features: list[str], target: str, most: int | None = None, error: float = 0.0) -> DataFrame:
    """(lhs, size, error, holds): every set that has no smaller one that holds, by size; lhs is comma-joined in the order of ``features``.

    A set's error is the least share of rows without which it determines the target; it holds with at most ``error``. ``most``
    bounds the size of sets. If even all features together don't hold, no set can, and only single columns are returned.
    Nulls are values, equal to each other; an empty table holds with every column.
    """
    spark, k = df.sparkSession, len(features)
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null"))
    rows = cut(df.select(F.monotonically_increasing_id().alias("row"), text(target).alias("y"), *[text(c).alias(f"f{i}") for i, c in enumerate(features)]), "rows")
    total = rows.count()
    allowed = error * total + 1e-9
    # all features together are the bound of every set's error
    whole = rows.groupBy(*[f"f{i}" for i in range(k)], "y").agg(F.count("*").alias("c")).groupBy(*[f"f{i}" for i in range(k)]).agg((F.sum("c") - F.max("c")).alias("e")).agg(F.sum("e")).first()[0] or 0
    last = min(k, most or k) if whole <= allowed else 1
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("set"), F.col(f"f{i}").alias("v")) for i in range(k)]))
    parts = rows.select("row", "y", pairs.alias("p")).select("p.set", "p.v", "row", "y")
    classes = cut(_classes(parts, ["set", "v"]), "classes")
    errors = _errors(classes)
    one = level = cut(_stripped(parts, classes, ["set", "v"]), "partitions")
    discard(classes)
    sets: list[tuple[int, ...]] = [(i,) for i in range(k)]
    found: list[frozenset[int]] = []
    out = []
    for size in range(1, last + 1):
        lost = {s: errors.get(i, 0) for i, s in enumerate(sets)}
        out += [(",".join(features[i] for i in s), size, lost[s] / max(1, total), lost[s] <= allowed) for s in sets]
        found += [frozenset(s) for s in sets if lost[s] <= allowed]
        number = {s: i for i, s in enumerate(sets)}
        if size == last:
            break
        # a set of the next level: its first columns are one of this, none of its parts holds
        sets = [s for s in combinations(range(k), size + 1) if s[:-1] in number and not any(f <= set(s) for f in found)]
        if not sets:
            break
        steps = spark.createDataFrame([(number[s[:-1]], s[-1], i) for i, s in enumerate(sets)], "set int, last int, new int")
        a = level.join(F.broadcast(steps), "set").select(F.col("new").alias("set"), "last", "row", "y", F.col("class").alias("a"))  # at most the sets of a level
        b = one.select(F.col("set").alias("last"), "row", F.col("class").alias("b"))
        product = cut(a.join(b, ["last", "row"]).select("set", "row", "y", "a", "b"), "product")
        classes = cut(_classes(product, ["set", "a", "b"]), "classes")
        errors = _errors(classes)
        before, level = level, cut(_stripped(product, classes, ["set", "a", "b"]), "partitions")
        for table in (product, classes, *([before] if before is not one else [])):
            discard(table)
    for table in {id(t): t for t in (rows, one, level)}.values():
        discard(table)
    return spark.createDataFrame(out, "lhs string, size int, error double, holds boolean")


def best_dependencies(found: DataFrame, scores: DataFrame) -> DataFrame:
    """(goal, lhs): of the dependencies that hold the one of least summed complexity and the one of highest mean score.

    scores: feature, complexity, score. Of equal ones the first by text.
    """
    each = found.where("holds").select("lhs", F.explode(F.split("lhs", ",")).alias("feature")).join(scores, "feature")
    per = each.groupBy("lhs").agg(F.sum("complexity").alias("complexity"), F.avg("score").alias("score"))
    least = per.orderBy("complexity", "lhs").limit(1).select(F.lit("complexity").alias("goal"), "lhs")
    return least.unionByName(per.orderBy(F.desc("score"), "lhs").limit(1).select(F.lit("score").alias("goal"), "lhs"))
