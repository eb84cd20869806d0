"""Normal forms of constructed features: flattened sums and products, and a print that equal expressions share.

A form's print is its value at a few points modulo a prime: raw features are random numbers there, sums, differences, products
and quotients are computed exactly, and any other operator is a random function of its arguments' values. Two forms that are
equal as rational functions have the same print whatever their shape, and others differ but for a chance of about
(degree / 2^31)^4. Prints come from the parents' prints, so no expression is ever taken apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .catalog import COMMUTATIVE

#: The prime 2^31 - 1, so products of two numbers fit a long; and how many points a print has.
PRIME, POINTS = (1 << 31) - 1, 4
SCHEMA = "key string, op string, args array<string>, parents array<string>, expr string, complexity int, raw array<string>, print array<bigint>"
#: Operators that flatten: their arguments are a sorted list.
FLAT = ("sum", "prod")
#: Operators that change nothing when they are applied again.
IDEMPOTENT = ("scale", "impute", "discretize")


def _random(*what: Column) -> Column:
    """A number from 1 to PRIME - 1."""
    return F.pmod(F.xxhash64(*what), F.lit(PRIME - 1)) + 1


def _drawn(name: Column) -> Column:
    """A raw feature's value at each point."""
    return F.array(*[_random(name, F.lit(i)) for i in range(POINTS)])


def _each(a: Column, b: Column, f) -> Column:
    return F.zip_with(a, b, lambda x, y: F.pmod(f(x, y), F.lit(PRIME)))


def inverse(a: Column) -> Column:
    """1 / a at each point, as the power PRIME - 2; null where a is 0 at a point."""
    bits = F.array(*[F.lit(b == "1") for b in bin(PRIME - 2)[2:]])
    power = lambda x: F.aggregate(bits, F.lit(1).cast("long"), lambda r, bit: F.when(bit, r * r % PRIME * x % PRIME).otherwise(r * r % PRIME))
    return F.when(~F.exists(a, lambda x: x == 0), F.transform(a, power))


def print_of(op: Column, a: Column, b: Column | None = None, a_op: Column | None = None) -> Column:
    """The print of op(a) or op(a, b) from the arguments' prints; null where it divides by what is 0."""
    zero = F.array_repeat(F.lit(0).cast("long"), POINTS)
    if b is None:
        known = {"minus": _each(zero, a, lambda x, y: x - y), "one_div": inverse(a), "square": _each(a, a, lambda x, y: x * y)}
        other = F.transform(a, lambda x: _random(op, x))  # of the value, so what is constant stays so
        if a_op is not None:
            other = F.when((op == a_op) & op.isin(*IDEMPOTENT), a).otherwise(other)
    else:
        known = {"sum": _each(a, b, lambda x, y: x + y), "subtract": _each(a, b, lambda x, y: x - y), "prod": _each(a, b, lambda x, y: x * y), "divide": _each(a, inverse(b), lambda x, y: x * y)}
        other = F.zip_with(a, b, lambda x, y: F.when(op.isin(*COMMUTATIVE), _random(op, F.least(x, y), F.greatest(x, y))).otherwise(_random(op, x, y)))
    return reduce(lambda w, k: w.when(op == k, known[k]), known, F.when(F.lit(False), a)).otherwise(other)


def raw_forms(spark: SparkSession, features: list[str]) -> DataFrame:
    rows = spark.createDataFrame([(f, f"`{f}`") for f in features], "key string, expr string")
    return rows.select("key", F.lit("raw").alias("op"), F.array("key").alias("args"), F.array().cast("array<string>").alias("parents"), "expr", F.lit(1).alias("complexity"), F.array("key").alias("raw"), _drawn(F.col("key")).alias("print"))


def unary_forms(nodes: DataFrame, ops: dict[str, str]) -> DataFrame:
    """Every operator on every node."""
    if not ops:
        return nodes.where("false")
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(t).alias("template")) for o, t in ops.items()]))
    made = nodes.withColumn("o", each)
    key = F.concat("o.op", F.lit("("), "key", F.lit(")"))
    return made.select(key.alias("key"), F.col("o.op").alias("op"), F.array("key").alias("args"), F.array("key").alias("parents"), F.replace("o.template", F.lit("{0}"), F.col("expr")).alias("expr"), (F.col("complexity") + 1).alias("complexity"), "raw", print_of(F.col("o.op"), F.col("print"), a_op=F.col("op")).alias("print"))


def _pair(a: str, b: str) -> list[Column]:
    """The columns of o.op(a, b), a and b being structs of nodes."""
    op, flat = F.col("o.op"), F.col("o.op").isin(*FLAT)
    inner = lambda x: F.when(F.col(f"{x}.op") == op, F.col(f"{x}.args")).otherwise(F.array(f"{x}.key"))
    args = F.when(flat, F.array_sort(F.concat(inner(a), inner(b)))).when(op.isin(*COMMUTATIVE), F.array_sort(F.array(f"{a}.key", f"{b}.key"))).otherwise(F.array(f"{a}.key", f"{b}.key"))
    expr = F.replace(F.replace("o.template", F.lit("{0}"), F.col(f"{a}.expr")), F.lit("{1}"), F.col(f"{b}.expr"))
    return [
        F.concat(op, F.lit("("), F.array_join(args, ","), F.lit(")")).alias("key"), op.alias("op"), args.alias("args"), F.array(f"{a}.key", f"{b}.key").alias("parents"), expr.alias("expr"),
        (F.col(f"{a}.complexity") + F.col(f"{b}.complexity") + 1).alias("complexity"), F.array_sort(F.array_union(f"{a}.raw", f"{b}.raw")).alias("raw"), print_of(op, F.col(f"{a}.print"), F.col(f"{b}.print")).alias("print"),
    ]


def binary_forms(nodes: DataFrame, features: list[str], ops: dict[str, str]) -> DataFrame:
    """Every operator on every node and raw feature, in both orders where the order matters; none on a node and itself."""
    if not ops or not features:
        return nodes.where("false")
    # as many partners as the table has feature columns: a literal of the plan
    raw = [F.struct(F.lit(f).alias("key"), F.lit("raw").alias("op"), F.array(F.lit(f)).alias("args"), F.lit(f"`{f}`").alias("expr"), F.lit(1).alias("complexity"), F.array(F.lit(f)).alias("raw"), _drawn(F.lit(f)).alias("print")) for f in features]
    each = F.explode(F.array(*[F.struct(F.lit(o).alias("op"), F.lit(t).alias("template")) for o, t in ops.items()]))
    node = F.struct("key", "op", "args", "expr", "complexity", "raw", "print")
    pairs = nodes.select(node.alias("a"), F.explode(F.array(*raw)).alias("b")).where("a.key <> b.key").select("a", "b", each.alias("o"))
    return pairs.select(*_pair("a", "b")).unionByName(pairs.where(~F.col("o.op").isin(*COMMUTATIVE)).select(*_pair("b", "a")))


def new_forms(made: DataFrame, known: DataFrame) -> DataFrame:
    """Of forms with one print the least complex, then the first key; without those that are known, constant, or divide by 0."""
    whole = made.where("print IS NOT NULL AND size(array_distinct(print)) > 1")
    first = whole.withColumn("rn", F.row_number().over(W.partitionBy("print").orderBy("complexity", "key", "expr"))).where("rn = 1").drop("rn")
    return first.join(known.select("print"), "print", "left_anti").select(*[f.split()[0] for f in SCHEMA.split(", ")])
