"""Queries over joins, top-k, set operations and covers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rank as rk
from ..operators import select as sel
from ..registry import FEATURES, lines, query, r6, read
from .q_rank import _BW, _LONG, _STATS
from .scratch import cut

C = F.col
_CHI = _STATS + ", r AS (SELECT feature, sum(pow(s - sn * n / nn, 2) / (sn * n / nn)) AS score FROM t GROUP BY 1)"
_VAR = f"SELECT feature, var_pop(value) AS score FROM ({_LONG}) GROUP BY 1"


@query("select_k_best", _CHI + " SELECT feature, round(score, 4) AS score FROM r ORDER BY r.score DESC, feature LIMIT 2")
def select_k_best(s, d):
    return sel.select_k_best(rk.rank_chi2(lines(s, d), FEATURES, "label"), 2).select("feature", F.round("score", 4).alias("score"))


@query("select_k_best_by", _BW + " SELECT feature FROM x ORDER BY (b / (k - 1)) / (w / (n - k)) DESC, feature LIMIT 3")
def select_k_best_by(s, d):
    return sel.select_fraction(rk.rank_anova_f(lines(s, d), FEATURES, "label"), len(FEATURES), 0.75).select("feature")


@query("weighted_ranking", _CHI + f", v AS ({_VAR}), u AS (SELECT feature, 0.7 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS x, 1 AS g FROM r UNION ALL SELECT feature, 0.3 * (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 2 FROM v), y AS (SELECT feature, x / sum(x) OVER (PARTITION BY g) * CASE WHEN g = 1 THEN 0.7 ELSE 0.3 END AS x FROM u) SELECT feature, round(sum(x), 6) AS score FROM y GROUP BY 1")
def weighted_ranking(s, d):
    df = lines(s, d)
    return sel.weighted_ranking([rk.rank_chi2(df, FEATURES, "label"), rk.rank_variance(df, FEATURES)], [0.7, 0.3]).select("feature", r6(C("score"), "score"))


@query("select_from_model")
def select_from_model(s, d):
    return sel.select_k_best(rk.rank_model_importance(lines(s, d), FEATURES, "label"), 2)


@query("select_l1")
def select_l1(s, d):
    from pyspark.ml.classification import LogisticRegression

    df = lines(s, d)
    model = LogisticRegression(labelCol="__y", maxIter=30, regParam=0.0005, elasticNetParam=1.0, standardization=True).fit(rk.assembled(df, FEATURES, "label"))
    return s.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, model.coefficients.toArray()) if v], "feature string, coefficient double")


@query("select_boruta")
def select_boruta(s, d):
    """Features whose forest importance beats the best hash-shuffled shadow in most of three runs."""
    names = ["o_totalprice", "o_custkey", "day"]
    df = read(s, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey", F.dayofyear("o_orderdate").alias("day"), (C("o_totalprice") > 250000).cast("int").alias("label"))
    hits, places = dict.fromkeys(names, 0), cut(rk.hash_places(df, "o_orderkey"), "places")
    for run in range(3):
        shadow = cut(rk.permuted(places, names, "o_orderkey", 11 + run), "shadow")
        scores = {r.feature: r.score for r in rk.rank_model_importance(shadow, [*names, *[f"shadow_{f}" for f in names]], "label", seed=run).collect()}
        best = max(v for f, v in scores.items() if f.startswith("shadow_"))
        for f in names:
            hits[f] += scores[f] > best
    return s.createDataFrame([(f, h, h >= 2) for f, h in hits.items()], "feature string, hits int, selected boolean")


@query("select_agreement", _CHI + f", v AS ({_VAR}) (SELECT feature FROM r ORDER BY score DESC, feature LIMIT 2) INTERSECT (SELECT feature FROM v ORDER BY score DESC, feature LIMIT 2)")
def select_agreement(s, d):
    df = lines(s, d)
    return sel.agreement([sel.select_k_best(rk.rank_chi2(df, FEATURES, "label"), 2), sel.select_k_best(rk.rank_variance(df, FEATURES), 2)])


_PREDS = {"discount": "discount > 0.05", "quantity": "quantity > 25", "tax": "tax > 0.04", "price": "price > 30000"}
_COV = "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, row_id FROM {{lines}} WHERE ({p})::INT = label" for f, p in _PREDS.items()) + ")"


def _covers(s, d):
    df = lines(s, d)
    each = F.array(*[F.when(F.expr(p).cast("int") == C("label"), F.lit(f)) for f, p in _PREDS.items()])
    return df.select("row_id", F.explode(F.array_compact(each)).alias("feature"))


def _cover_sql(order, extra=""):
    step = lambda i, prev: f"c{i} AS (SELECT * FROM {prev}), g{i} AS (SELECT feature, count(*) AS newly FROM c{i} GROUP BY 1{extra} ORDER BY {order}, feature LIMIT 1)"
    nxt = lambda i: f"(SELECT * FROM c{i} WHERE row_id NOT IN (SELECT row_id FROM c{i} WHERE feature = (SELECT feature FROM g{i})))"
    return f"WITH {step(1, f'({_COV})')}, {step(2, nxt(1))}, {step(3, nxt(2))} " + " UNION ALL ".join(f"SELECT {i}::INT AS step, feature, newly FROM g{i}" for i in (1, 2, 3))


@query("set_cover_features", _cover_sql("count(*) DESC"))
def set_cover_features(s, d):
    return sel.set_cover(_covers(s, d), 3)


_W = "CASE feature WHEN 'discount' THEN 4.0 WHEN 'quantity' THEN 1.0 WHEN 'tax' THEN 2.0 ELSE 3.0 END"


@query("weighted_set_cover", _cover_sql(f"{_W} / count(*)"))
def weighted_set_cover(s, d):
    weights = s.createDataFrame([("discount", 4.0), ("quantity", 1.0), ("tax", 2.0), ("price", 3.0)], "feature string, weight double")
    return sel.set_cover(_covers(s, d), 3, weights)


@query("all_masks", "SELECT m AS mask, bit_count(m)::INT AS size, (SELECT count(*) FROM lineitem) AS n FROM (SELECT unnest(range(1, 16)) AS m) WHERE bit_count(m) <= 2")
def all_masks(s, d):
    df = lines(s, d)
    return sel.all_masks(df, len(FEATURES), 2).join(F.broadcast(df.agg(F.count("*").alias("n"))))


@query("union_of_picks", "(SELECT row_id FROM {lines} ORDER BY price DESC, row_id LIMIT 50) UNION (SELECT row_id FROM {lines} ORDER BY quantity DESC, row_id LIMIT 50)")
def union_of_picks(s, d):
    df = lines(s, d)
    pick = lambda c: df.orderBy(F.desc(c), "row_id").limit(50).select("row_id")
    return pick("price").union(pick("quantity")).distinct()


@query("clean_dirty_alignment", "SELECT c_custkey, c_acctbal AS clean, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS dirty, c_custkey % 4 = 0 AS differs FROM customer")
def clean_dirty_alignment(s, d):
    df = read(s, d, "customer")
    clean = df.select("c_custkey", C("c_acctbal").alias("clean"))
    dirty = df.select("c_custkey", F.when(C("c_custkey") % 4 != 0, C("c_acctbal")).alias("dirty"))
    return clean.join(dirty, "c_custkey").withColumn("differs", ~C("clean").eqNullSafe(C("dirty")))


_NEAR_SQL = """WITH t AS (SELECT row_id, quantity, discount FROM {lines}), p AS (SELECT DISTINCT quantity, discount FROM t),
    mx AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM t GROUP BY row_id)),
    few AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quantity, discount ORDER BY row_id) AS k FROM t) WHERE k <= 5 + (SELECT n FROM mx)),
    c AS (SELECT a.quantity, a.discount, f.row_id AS id, sqrt(pow(f.quantity - a.quantity, 2) + pow(f.discount - a.discount, 2)) AS dist FROM p a, few f),
    b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quantity, discount ORDER BY dist, id) AS k FROM c) WHERE k <= 5 + (SELECT n FROM mx))
    SELECT anchor, id, round(dist, 6) AS dist, rank FROM (SELECT t.row_id AS anchor, b.id, dist, row_number() OVER (PARTITION BY t.row_id ORDER BY dist, b.id)::INT AS rank FROM t JOIN b USING (quantity, discount) WHERE b.id <> t.row_id) WHERE rank <= 5"""


@query("nearest_neighbours", _NEAR_SQL)
def nearest_neighbours(s, d):
    """The five nearest other rows of every row. The SQL searches once per distinct point, which has the same neighbours."""
    return sel.nearest(lines(s, d), None, ["quantity", "discount"], "row_id", 5).select("anchor", "id", r6(C("dist"), "dist"), "rank")


query("nearest_neighbours_all", _NEAR_SQL)(nearest_neighbours)


_TOP = "SELECT c_mktsegment AS grp, 'n' || c_nationkey AS feature, round(avg(c_acctbal), 6) AS score FROM customer GROUP BY 1, 2"


@query("top_feature_per_group", f"SELECT grp, feature, score, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, feature) AS place FROM ({_TOP})) WHERE place <= 2")
def top_feature_per_group(s, d):
    scores = read(s, d, "customer").groupBy(C("c_mktsegment").alias("grp"), F.concat(F.lit("n"), C("c_nationkey").cast("string")).alias("feature")).agg(r6(F.avg("c_acctbal"), "score"))
    return sel.top_per_group(scores, "grp", 2).select("grp", "feature", "score", "place")


@query("pareto_front", "WITH p AS (SELECT p_partkey, p_size, p_retailprice FROM part) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.p_size >= p.p_size AND o.p_retailprice >= p.p_retailprice AND (o.p_size > p.p_size OR o.p_retailprice > p.p_retailprice))")
def pareto_front(s, d):
    return sel.pareto_front(read(s, d, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", ["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")


@query("skyline_three_axes", "WITH p AS (SELECT c_custkey, c_acctbal, c_nationkey, length(c_mktsegment) AS l FROM customer) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE o.c_acctbal >= p.c_acctbal AND o.c_nationkey >= p.c_nationkey AND o.l >= p.l AND (o.c_acctbal > p.c_acctbal OR o.c_nationkey > p.c_nationkey OR o.l > p.l))")
def skyline_three_axes(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey", F.length("c_mktsegment").cast("long").alias("l"))
    # one best balance per pair of the other axes leaves a small table for the anti-join
    best = df.groupBy("c_nationkey", "l").agg(F.max("c_acctbal").alias("c_acctbal"))
    return sel.pareto_front(df.join(best, ["c_nationkey", "l", "c_acctbal"]), "c_custkey", ["c_acctbal", "c_nationkey", "l"]).select("c_custkey", "c_acctbal", "c_nationkey", "l")


_FOUR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query("skyline_four_axes", f"WITH p AS (SELECT DISTINCT {', '.join(_FOUR)} FROM lineitem) SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p o WHERE {' AND '.join(f'o.{c} >= p.{c}' for c in _FOUR)} AND ({' OR '.join(f'o.{c} > p.{c}' for c in _FOUR)}))")
def skyline_four_axes(s, d):
    """Distinct lines that no other line beats in quantity, price, discount and tax."""
    return sel.pareto_front(read(s, d, "lineitem").select(*_FOUR).distinct(), "l_quantity", list(_FOUR))
