"""The candidate catalog: features and constructed candidates as rows (cand_id, key, op, parents, expr, complexity).

A candidate's ``expr`` is a Spark SQL expression over raw columns, so candidates are materialised by a select. A layer of
any size is gone through in chunks of ``CHUNK``: a plan and the driver hold the expressions of one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.window import value_ranks
from ..scratch import cut, discard, shared_path

SCHEMA = "key string, op string, parents array<string>, expr string, complexity int, raw array<string>"
UNARY_OPS = {"minus": "(-{0})", "log": "ln({0})", "one_div": "try_divide(1D, {0})", "square": "({0} * {0})"}
BINARY_OPS = {"sum": "({0} + {1})", "prod": "({0} * {1})", "divide": "try_divide({0}, {1})", "subtract": "({0} - {1})"}
COMMUTATIVE = ("sum", "prod", "max", "min")
#: Candidates, or pairs of them, that one pass over the rows takes.
CHUNK = 128


def raw_catalog(spark: SparkSession, features: list[str]) -> DataFrame:
    return spark.createDataFrame([(f, "raw", [], f, 1, [f]) for f in features], SCHEMA)


def _ops(spark: SparkSession, ops: dict[str, str]) -> DataFrame:
    return F.broadcast(spark.createDataFrame(list(ops.items()), "op string, template string"))


def canonical(op: Column, a: Column, b: Column | None = None) -> Column:
    """The key of op(a[, b]): equal forms share it. Commutative arguments are sorted; minus and 1/x undo themselves; scaling and binning repeat to themselves."""
    if b is None:
        undo = reduce(lambda w, o: w.when((op == o) & a.startswith(f"{o}("), F.regexp_extract(a, rf"^{o}\((.*)\)$", 1)), ("minus", "one_div"), F.when(F.lit(False), a))
        repeat = reduce(lambda w, o: w.when((op == o) & a.startswith(f"{o}("), a), ("scale", "impute", "discretize"), undo)
        return repeat.otherwise(F.concat(op, F.lit("("), a, F.lit(")")))
    pair = F.when(op.isin(*COMMUTATIVE), F.array_join(F.array_sort(F.array(a, b)), ",")).otherwise(F.concat_ws(",", a, b))
    return F.concat(op, F.lit("("), pair, F.lit(")"))


def canonical_groups(key: Column) -> Column:
    """Rules for group-by forms agg(x;k): nested ones on one key collapse (std of them is 0), min(-x) is -max(x), and the key ignores scaling, minus, 1/x and log."""
    std = F.regexp_replace(key, r"^(?:std|var)\(\w+\([^;()]+;([^;()]+)\);\1\)$", "0")
    out = F.regexp_replace(std, r"^(?:mean|min|max|median)\((\w+)\(([^;()]+);([^;()]+)\);\3\)$", "$1($2;$3)")
    out = F.regexp_replace(out, r"^min\(minus\(([^()]+)\);([^;()]+)\)$", "minus(max($1;$2))")
    out = F.regexp_replace(out, r"^max\(minus\(([^()]+)\);([^;()]+)\)$", "minus(min($1;$2))")
    return F.regexp_replace(out, r";(?:minus|one_div|scale|impute|log)\(([^()]+)\)\)$", ";$1)")


def generate_unary(catalog: DataFrame, complexity: int, ops: dict[str, str] = UNARY_OPS, allowed: DataFrame | None = None) -> DataFrame:
    """Candidates of the complexity: every operator on every candidate one below; forms that are known are skipped.

    allowed: (col, op), limits operators on raw features to those applicable.
    """
    parents = catalog.where(F.col("complexity") == complexity - 1)
    made = parents.withColumnRenamed("op", "parent_op").join(_ops(catalog.sparkSession, ops))
    if allowed is not None:
        ok = allowed.select(F.col("col").alias("key"), "op", F.lit(True).alias("ok"))
        made = made.join(F.broadcast(ok), ["key", "op"], "left").where(F.col("ok") | (F.col("parent_op") != "raw"))
    out = made.select(canonical(F.col("op"), F.col("key")).alias("key"), "op", F.array("key").alias("parents"), F.regexp_replace("template", r"\{0\}", F.col("expr")).alias("expr"), F.lit(complexity).alias("complexity"), "raw")
    return new_forms(catalog, out)


def generate_binary(catalog: DataFrame, complexity: int, ops: dict[str, str] = BINARY_OPS) -> DataFrame:
    """Candidates of the complexity from pairs whose complexities add to one less: an equi-join on the missing share.

    There are few complexities, so the second parents are dealt to as many salts as there are shuffle partitions.
    """
    salts = max(1, int(catalog.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    a = catalog.select(F.col("key").alias("ka"), F.col("expr").alias("ea"), F.col("complexity").alias("ca"), F.col("raw").alias("ra"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("sa"))
    b = catalog.select(F.col("key").alias("kb"), F.col("expr").alias("eb"), F.col("complexity").alias("cb"), F.col("raw").alias("rb"), F.pmod(F.xxhash64("key"), F.lit(salts)).cast("int").alias("sb"))
    pairs = a.join(b, (F.lit(complexity - 1) - F.col("ca") == F.col("cb")) & (F.col("sa") == F.col("sb")) & (F.col("ka") != F.col("kb"))).join(_ops(catalog.sparkSession, ops))
    pairs = pairs.where(~F.col("op").isin(*COMMUTATIVE) | (F.col("ka") < F.col("kb")))
    expr = F.regexp_replace(F.regexp_replace("template", r"\{0\}", F.col("ea")), r"\{1\}", F.col("eb"))
    out = pairs.select(canonical(F.col("op"), F.col("ka"), F.col("kb")).alias("key"), "op", F.array("ka", "kb").alias("parents"), expr.alias("expr"), F.lit(complexity).alias("complexity"), F.array_sort(F.array_union("ra", "rb")).alias("raw"))
    return new_forms(catalog, out)


def new_forms(catalog: DataFrame, made: DataFrame) -> DataFrame:
    first = made.withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy("expr"))).where("rn = 1").drop("rn")
    return first.join(catalog.select("key"), "key", "left_anti")


def one_round(catalog: DataFrame, unary: dict[str, str] = UNARY_OPS, binary: dict[str, str] = BINARY_OPS) -> DataFrame:
    """Raw, unary of raw, binary of both, and unary of these: one round of construction."""
    fi = catalog
    fui = generate_unary(fi, 2, unary)
    both = fi.unionByName(fui)
    foi = reduce(DataFrame.unionByName, [generate_binary(both, c, binary) for c in (3, 4, 5)])
    top = both.unionByName(foi)
    foui = reduce(DataFrame.unionByName, [generate_unary(top.where(F.col("op").isin(*binary) | (F.col("complexity") == 0)), c, unary) for c in (4, 5, 6)])
    return top.unionByName(foui)


def search_space_size(attributes: int, unary: int, binary: int) -> dict[str, int]:
    """Numbers of candidates of one round without pruning."""
    fui = attributes * unary
    base = attributes + fui
    foi = base * (base - 1) * binary
    foui = foi * unary
    return {"unary": fui, "binary": foi, "unary_of_binary": foui, "total": attributes + fui + foi + foui}


def materialize(df: DataFrame, candidates: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """(table with a column c0, c1, .. per candidate, their keys by key): one select; the catalog's expressions are the plan."""
    rows = candidates.select("key", "expr").orderBy("key").collect()
    exprs = [F.expr(r.expr).cast("double").alias(f"c{i}") for i, r in enumerate(rows)]
    return df.select(*keep, *exprs), [r.key for r in rows]


def fingerprints(df: DataFrame, cols: list[str], names: list[str], row_id: str) -> DataFrame:
    """(key, lo, hi, print): a candidate's range, and a sum of hashes over (row, value), in one aggregate."""
    value = lambda c: F.round(F.col(c), 9) + F.lit(0.0)
    rows = [F.struct(F.lit(n).alias("key"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.sum(F.xxhash64(F.col(row_id), value(c)).cast("decimal(38,0)")).alias("print")) for c, n in zip(cols, names)]
    return df.agg(F.array(*rows).alias("x")).select(F.explode("x").alias("p")).select("p.*")


def drop_constant(prints: DataFrame) -> DataFrame:
    return prints.where("lo < hi")


def chunks(candidates: DataFrame, by: list[str], size: int = CHUNK) -> Iterator[list]:
    """The rows of a written table, ``size`` at a time in the order of ``by``; no two rows may agree in all of it."""
    last = None
    while True:
        rest = candidates
        if last is not None:
            same, later = F.lit(True), F.lit(False)
            for c in by:
                later, same = later | (same & (F.col(c) > F.lit(last[c]))), same & (F.col(c) == F.lit(last[c]))
            rest = rest.where(later)
        rows = rest.orderBy(*by).limit(size).collect()
        if rows:
            yield rows
        if len(rows) < size:
            return
        last = rows[-1]


def candidate_prints(df: DataFrame, candidates: DataFrame, row_id: str, size: int = CHUNK) -> DataFrame:
    """(key, lo, hi, print) of every candidate (key, expr): one pass over the rows a chunk, written chunk by chunk."""
    spark = df.sparkSession
    path = shared_path(spark, "prints")
    listed = cut(candidates.select("key", "expr"), "candidates")
    schema = None
    for rows in chunks(listed, ["key"], size):
        cols = [f"c{i}" for i in range(len(rows))]
        table = df.select(row_id, *[F.expr(r.expr).cast("double").alias(c) for c, r in zip(cols, rows)])
        part = fingerprints(table, cols, [r.key for r in rows], row_id)
        part.write.mode("append").parquet(path)
        schema = part.schema
    discard(listed)
    if schema is None:
        return spark.createDataFrame([], "key string, lo double, hi double, print decimal(38,0)")
    return spark.read.schema(schema).parquet(path)


def drop_equivalent(prints: DataFrame, complexity: DataFrame, df: DataFrame | None = None, size: int = CHUNK) -> DataFrame:
    """Of candidates with identical values, the least complex (then the first key) stays.

    complexity: (key, complexity), with ``df`` also expr. Equal prints are the candidates for that. With ``df`` each is
    compared with the first of its print, value by value, ``size`` pairs a pass; what differs from it in any row goes
    into the next round, where the first of those stands for its print.
    """
    w = W.partitionBy("print").orderBy("complexity", "key")
    ranked = prints.join(complexity, "key")
    if df is None:
        return ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")
    spark = df.sparkSession
    kept, left = None, cut(ranked.select("key", "print", "complexity", "expr"), "equivalent")
    value = lambda e: F.round(F.expr(e).cast("double"), 9) + F.lit(0.0)
    while True:
        first = left.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("print", F.col("key").alias("head"), F.col("expr").alias("head_expr"))
        pairs = cut(left.join(first, "print").where("key <> head"), "pairs")
        heads = cut(first.select(F.col("head").alias("key")), "heads")
        kept = heads if kept is None else kept.unionByName(heads)
        path = shared_path(spark, "differ")
        some = False
        for rows in chunks(pairs, ["key"], size):
            same = df.agg(*[F.bool_and(value(r.head_expr).eqNullSafe(value(r.expr))).alias(f"s{i}") for i, r in enumerate(rows)]).first()
            differ = [(r.key, r.print, r.complexity, r.expr) for i, r in enumerate(rows) if same[i] is False]
            if differ:
                some = True
                spark.createDataFrame(differ, left.schema).write.mode("append").parquet(path)
        schema = left.schema
        discard(left)
        discard(pairs)
        if not some:
            return ranked.join(kept, "key", "left_semi")
        left = spark.read.schema(schema).parquet(path)


def drop_equal_score(scored: DataFrame, places: int = 9) -> DataFrame:
    w = W.partitionBy(F.round("score", places)).orderBy("complexity", "key")
    return scored.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def parent_gain(scored: DataFrame) -> DataFrame:
    """scored (key, op, parents, score, ..) with best_parent and gain; raw candidates have none."""
    up = scored.select(F.col("key").alias("parent"), F.col("score").alias("parent_score"))
    best = scored.select("key", F.explode("parents").alias("parent")).join(up, "parent").groupBy("key").agg(F.max("parent_score").alias("best_parent"))
    return scored.join(best, "key", "left").withColumn("gain", F.col("score") - F.col("best_parent"))


def epsilon_prune(scored: DataFrame, epsilon: float) -> DataFrame:
    """Candidates that beat their best parent by more than epsilon; raw and one-hot ones always stay."""
    return parent_gain(scored).where(F.col("op").isin("raw", "one_hot") | (F.col("gain") > epsilon))


def predecessor_prune(scored: DataFrame) -> DataFrame:
    """Candidates that score above all their ancestors; the best ancestor's score is carried up level by level of the catalog."""
    links = scored.select("key", F.explode("parents").alias("parent")).join(scored.select(F.col("key").alias("parent"), F.col("score").alias("ps")), "parent")
    best = scored.select("key", F.lit(None).cast("double").alias("above"))
    for _ in range((scored.agg(F.max("complexity")).first()[0] or 1) - 1):
        up = links.join(best.select(F.col("key").alias("parent"), F.col("above").alias("pa")), "parent")
        best = scored.select("key").join(up.groupBy("key").agg(F.max(F.greatest("ps", "pa")).alias("above")), "key", "left")
    return scored.join(best, "key").where(F.col("above").isNull() | (F.col("score") > F.col("above"))).drop("above")


def complexity_prune(scored: DataFrame) -> DataFrame:
    """Of candidates over the same raw features, those that no less complex one equals or beats."""
    w = W.partitionBy("raw").orderBy("complexity").rangeBetween(W.unboundedPreceding, -1)
    return scored.withColumn("below", F.max("score").over(w)).where(F.col("below").isNull() | (F.col("score") > F.col("below"))).drop("below")


def harmonic_scores(scored: DataFrame) -> DataFrame:
    """Harmonic mean of the shares of candidates that are at least as complex and that score no better."""
    total = F.lit(scored.count())
    simple = value_ranks(scored, "complexity").select(F.col("value").alias("complexity"), ((total - F.col("before")) / total).alias("simplicity"))
    good = value_ranks(scored, "score").select(F.col("value").alias("score"), ((F.col("before") + F.col("n")) / total).alias("quality"))
    return scored.join(simple, "complexity").join(good, "score").withColumn("harmonic", 2 * F.col("simplicity") * F.col("quality") / (F.col("simplicity") + F.col("quality")))


def aicc(k: Column, n: Column, rss: Column) -> Column:
    """Corrected information criterion; infinite where there are too few rows for the correction (n <= k + 1)."""
    return F.when(n > k + 1, 2 * k + n * F.ln(rss / n) + F.try_divide(2 * k * (k + 1), n - k - 1)).otherwise(F.lit(float("inf")))


def aic_weights(models: DataFrame, score: str) -> DataFrame:
    """Akaike weights e^(-delta/2), normalised. The window runs over models only."""
    w = W.partitionBy()
    raw = models.withColumn("w", F.exp(-(F.col(score) - F.min(score).over(w)) / 2))
    return raw.withColumn("weight", F.col("w") / F.sum("w").over(w)).drop("w")
