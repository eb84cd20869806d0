"""Queries over feature transformations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import categorical as cat
from ..functions import numeric as num
from ..functions import text as txt
from ..functions import window as win
from ..registry import FEATURES, lines, query, r6, read

C = F.col
PARTS = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part"


def _unary(names, col, shift=0.0):
    return [r6(num.UNARY[n](C(col) + F.lit(shift)).cast("double") if n != "to_int" else num.UNARY[n](C(col)).cast("double"), n) for n in names]


@query("identity_dummy_minus", "SELECT row_id, quantity AS identity, 1.0::DOUBLE AS dummy_one, -quantity AS minus, coalesce(quantity, -1) AS identity_fill FROM {lines}")
def identity_dummy_minus(s, d):
    return lines(s, d).select("row_id", C("quantity").alias("identity"), F.lit(1.0).alias("dummy_one"), num.UNARY["minus"](C("quantity")).alias("minus"), num.filled(C("quantity")).alias("identity_fill"))


@query("unary_powers", "SELECT row_id, round(quantity * quantity, 6) AS square, round(quantity * quantity * quantity, 6) AS pow3, round(sqrt(quantity), 6) AS sqrt, round(1 / quantity, 6) AS one_div, abs(quantity - 25) AS abs, round(round_even(price, 0), 6) AS rint FROM {lines}")
def unary_powers(s, d):
    df = lines(s, d)
    u = num.UNARY
    return df.select("row_id", *[r6(u[n](C("quantity")), n) for n in ("square", "pow3", "sqrt", "one_div")], u["abs"](C("quantity") - 25).alias("abs"), r6(u["rint"](C("price")), "rint"))


@query("unary_trigonometry", "SELECT row_id, " + ", ".join(f"round({f}(discount), 6) AS {f}" for f in ("cos", "sin", "tan", "cosh", "sinh", "tanh", "degrees", "radians")) + " FROM {lines}")
def unary_trigonometry(s, d):
    return lines(s, d).select("row_id", *_unary(("cos", "sin", "tan", "cosh", "sinh", "tanh", "degrees", "radians"), "discount"))


@query("unary_log_exp", "SELECT row_id, round(ln(price), 6) AS log, round(exp(discount), 6) AS exp, round(1 / (1 + exp(-tax)), 6) AS sigmoid FROM {lines}")
def unary_log_exp(s, d):
    u = num.UNARY
    return lines(s, d).select("row_id", r6(u["log"](C("price")), "log"), r6(u["exp"](C("discount")), "exp"), r6(u["sigmoid"](C("tax")), "sigmoid"))


@query("legacy_guards", "SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS binarize, round(ln(CASE WHEN s_acctbal <= 0 THEN 1e-6 ELSE s_acctbal END), 6) AS log_clamped, round(CASE WHEN s_acctbal < 0 THEN -1 ELSE sqrt(abs(s_acctbal)) END, 6) AS sqrt_filled, trunc(s_acctbal)::BIGINT AS to_int FROM supplier")
def legacy_guards(s, d):
    u = num.UNARY
    return read(s, d, "supplier").select("s_suppkey", u["binarize"](C("s_acctbal")).alias("binarize"), r6(u["log_clamped"](C("s_acctbal")), "log_clamped"), r6(u["sqrt_filled"](C("s_acctbal")), "sqrt_filled"), u["to_int"](C("s_acctbal")).alias("to_int"))


@query("minmax_scale", "WITH t AS (SELECT * FROM {lines}), s AS (SELECT min(quantity) a, max(quantity) b, min(price) c, max(price) e FROM t) SELECT row_id, round((quantity - a) / (b - a), 6) AS quantity, round((price - c) / (e - c), 6) AS price, 0.0::DOUBLE AS constant FROM t, s")
def minmax_scale(s, d):
    df = lines(s, d).withColumn("constant", F.lit(5.0))
    return df.select("row_id", *[r6(e, c) for c, e in num.fit_minmax(df, ["quantity", "price", "constant"]).items()])


@query("standard_scale", "WITH t AS (SELECT * FROM {lines}), s AS (SELECT avg(quantity) a, stddev_pop(quantity) b, avg(price) c, stddev_pop(price) e FROM t) SELECT row_id, round((quantity - a) / b, 6) AS quantity, round((price - c) / e, 6) AS price FROM t, s")
def standard_scale(s, d):
    df = lines(s, d)
    return df.select("row_id", *[r6(e, c) for c, e in num.fit_standard(df, ["quantity", "price"]).items()])


@query("robust_scale", "WITH t AS (SELECT * FROM {lines}), s AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) m, quantile_cont(price, 0.75) b FROM t) SELECT row_id, round((price - m) / (b - a), 6) AS price FROM t, s")
def robust_scale(s, d):
    df = lines(s, d)
    return df.select("row_id", r6(num.fit_robust(df, ["price"])["price"], "price"))


@query("normalizer", "SELECT row_id, round(quantity / n, 6) AS quantity, round(discount / n, 6) AS discount FROM (SELECT *, sqrt(quantity * quantity + discount * discount) AS n FROM {lines})")
def normalizer(s, d):
    return lines(s, d).select("row_id", *[r6(e, c) for c, e in num.row_norm(["quantity", "discount"]).items()])


_HOLES = "SELECT *, CASE WHEN row_id % 10 = 3 THEN NULL ELSE quantity END AS q FROM {lines}"


def _holes(s, d):
    return lines(s, d).withColumn("q", F.when(C("row_id") % 10 != 3, C("quantity")))


@query("impute_mean", f"WITH t AS ({_HOLES}) SELECT row_id, round(coalesce(q, (SELECT avg(q) FROM t)), 6) AS q FROM t")
def impute_mean(s, d):
    df = _holes(s, d)
    return df.select("row_id", r6(num.fit_impute(df, ["q"])["q"], "q"))


@query("impute_median", f"WITH t AS ({_HOLES}) SELECT row_id, round(coalesce(q, (SELECT quantile_cont(q, 0.5) FROM t)), 6) AS q FROM t")
def impute_median(s, d):
    df = _holes(s, d)
    return df.select("row_id", r6(num.fit_impute(df, ["q"], "median")["q"], "q"))


@query("impute_most_frequent", f"WITH t AS ({_HOLES}) SELECT row_id, coalesce(q, (SELECT q FROM t WHERE q IS NOT NULL GROUP BY q ORDER BY count(*) DESC, q LIMIT 1)) AS q FROM t")
def impute_most_frequent(s, d):
    df = _holes(s, d)
    return df.select("row_id", num.fit_impute(df, ["q"], "most_frequent")["q"].alias("q"))


@query("impute_inf_aware", "WITH t AS (SELECT row_id, CASE WHEN row_id % 7 IN (1, 2, 3) THEN NULL ELSE quantity END AS q FROM {lines}) SELECT row_id, round(coalesce(q, (SELECT avg(q) FROM t)), 6) AS q FROM t")
def impute_inf_aware(s, d):
    k = C("row_id") % 7
    df = lines(s, d).withColumn("q", F.when(k == 1, F.lit(float("inf"))).when(k == 2, F.lit(float("-inf"))).when(k == 3, F.lit(float("nan"))).otherwise(C("quantity")))
    return df.select("row_id", r6(num.fit_impute(df, ["q"])["q"], "q"))


@query("one_hot", "SELECT c_custkey, " + ", ".join(f"(c_mktsegment = '{v}')::INT AS \"c_mktsegment={v}\"" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def one_hot(s, d):
    df = read(s, d, "customer")
    return df.select("c_custkey", *[e.alias(n) for n, e in cat_columns(df).items()])


def cat_columns(df):
    return num.fit_one_hot(df, "c_mktsegment")


@query("equi_width_bins", "WITH t AS (SELECT * FROM {lines}), s AS (SELECT min(quantity) a, max(quantity) b FROM t) SELECT row_id, CASE WHEN quantity <= a THEN 0 ELSE least(9, " + " + ".join(f"(quantity > a + (b - a) * {i} / 10.0::DOUBLE)::INT" for i in range(1, 10)) + ") END::INT AS quantity FROM t, s")
def equi_width_bins(s, d):
    df = lines(s, d)
    return df.select("row_id", num.fit_equi_width(df, ["quantity"])["quantity"].cast("int").alias("quantity"))


@query("quantile_bins", "WITH t AS (SELECT * FROM {lines}), s AS (SELECT list_distinct(quantile_cont(price, [0.25, 0.5, 0.75])) q FROM t) SELECT row_id, len(list_filter(q, lambda e: price > e))::INT AS price FROM t, s")
def quantile_bins(s, d):
    df = lines(s, d)
    return df.select("row_id", num.fit_quantile_bins(df, ["price"], 4)["price"].cast("int").alias("price"))


@query("n_ary_columns", "SELECT row_id, round(q + discount + tax, 6) AS sum, round(q * discount, 6) AS prod, CASE WHEN q IS NULL THEN NULL ELSE greatest(q, discount) END AS max, CASE WHEN q IS NULL THEN NULL ELSE least(q, tax) END AS min, round(coalesce(q, 0) + discount, 6) AS nansum, round(coalesce(q, 1) * discount, 6) AS nanprod FROM (" + _HOLES + ")")
def n_ary_columns(s, d):
    q, disc, tax = C("q"), C("discount"), C("tax")
    n = num.n_ary
    return _holes(s, d).select("row_id", r6(n("sum", [q, disc, tax]), "sum"), r6(n("prod", [q, disc]), "prod"), n("max", [q, disc]).alias("max"), n("min", [q, tax]).alias("min"), r6(n("sum", [q, disc], True), "nansum"), r6(n("prod", [q, disc], True), "nanprod"))


@query("binary_operators", "SELECT row_id, round(price / quantity, 6) AS divide, CASE WHEN discount = 0 THEN NULL ELSE round(tax / discount, 6) END AS divide_guarded, round(price - quantity, 6) AS subtract, round(pow(quantity, discount), 6) AS power, round(price + quantity, 6) AS add FROM {lines}")
def binary_operators(s, d):
    b = num.BINARY
    return lines(s, d).select("row_id", r6(b["divide"](C("price"), C("quantity")), "divide"), r6(b["divide"](C("tax"), C("discount")), "divide_guarded"), r6(b["subtract"](C("price"), C("quantity")), "subtract"), r6(b["power"](C("quantity"), C("discount")), "power"), r6(b["add"](C("price"), C("quantity")), "add"))


@query("group_by_then", "WITH t AS (SELECT c_custkey, c_nationkey, c_acctbal FROM customer), tr AS (SELECT * FROM t WHERE c_custkey % 3 = 0), g AS (SELECT c_nationkey AS k, " + ", ".join(f"{f}(c_acctbal) AS {n}" for n, f in (("mean", "avg"), ("max", "max"), ("min", "min"), ("std", "stddev_pop"), ("sum", "sum"), ("len", "count"))) + " FROM tr GROUP BY 1) SELECT c_custkey, " + ", ".join(f"round(coalesce({n}, {u}), 4) AS {n}" for n, u in (("mean", "c_acctbal"), ("max", "c_acctbal"), ("min", "c_acctbal"), ("std", "0"), ("sum", "c_acctbal"))) + ", coalesce(len, 1) AS len FROM t LEFT JOIN g ON c_nationkey = k")
def group_by_then(s, d):
    df = read(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    train = df.where(C("c_custkey") % 3 == 0)
    for a in ("mean", "max", "min", "std", "sum", "len"):
        df = cat.group_by_then(train, df, "c_acctbal", "c_nationkey", a, a)
    return df.select("c_custkey", *[F.round(a, 4).alias(a) for a in ("mean", "max", "min", "std", "sum")], "len")


@query("group_by_then_over", "SELECT c_custkey, round(median(c_acctbal) OVER w, 4) AS median, round(var_pop(c_acctbal) OVER w, 2) AS var FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def group_by_then_over(s, d):
    df = read(s, d, "customer")
    for a in ("median", "var"):
        df = cat.group_by_then_over(df, "c_acctbal", "c_mktsegment", a, a)
    return df.select("c_custkey", F.round("median", 4).alias("median"), F.round("var", 2).alias("var"))


@query("frequency_encode", "WITH tr AS (SELECT p_brand, count(*) AS n FROM part WHERE p_partkey % 2 = 0 GROUP BY 1) SELECT p_partkey, round(coalesce(n / (SELECT sum(n) FROM tr), 0), 6) AS freq, coalesce(n, 0) AS cnt FROM part LEFT JOIN tr USING (p_brand)")
def frequency_encode(s, d):
    df = read(s, d, "part")
    train = df.where(C("p_partkey") % 2 == 0)
    out = cat.frequency_encode(train, cat.frequency_encode(train, df, "p_brand", "freq"), "p_brand", "cnt", False)
    return out.select("p_partkey", r6(C("freq"), "freq"), "cnt")


@query("ordinal_encode", "SELECT p_partkey, (dense_rank() OVER (ORDER BY p_type) - 1)::INT AS code FROM part")
def ordinal_encode(s, d):
    df = read(s, d, "part")
    return cat.ordinal_encode(df, df, "p_type", "code").select("p_partkey", C("code").cast("int").alias("code"))


_CODE = "SELECT c_custkey, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS c FROM customer"


@query("helmert_contrast", f"SELECT c_custkey, " + ", ".join(f"CASE WHEN c = {j} THEN {j} WHEN c < {j} THEN -1 ELSE 0 END::DOUBLE AS h{j}" for j in range(1, 5)) + f" FROM ({_CODE})")
def helmert_contrast(s, d):
    df = read(s, d, "customer")
    enc = cat.ordinal_encode(df, df, "c_mktsegment", "c")
    return enc.select("c_custkey", *[c.alias(f"h{j}") for j, c in enumerate(cat.contrast(C("c"), 5, "helmert"), 1)])


@query("backward_difference_contrast", f"SELECT c_custkey, " + ", ".join(f"CASE WHEN c < {j} THEN {-(5 - j) / 5} ELSE {j / 5} END::DOUBLE AS b{j}" for j in range(1, 5)) + f" FROM ({_CODE})")
def backward_difference_contrast(s, d):
    df = read(s, d, "customer")
    enc = cat.ordinal_encode(df, df, "c_mktsegment", "c")
    return enc.select("c_custkey", *[c.alias(f"b{j}") for j, c in enumerate(cat.contrast(C("c"), 5, "backward"), 1)])


@query("polynomial", "SELECT row_id, 1.0::DOUBLE AS one, discount AS x, round(discount * discount, 6) AS x2 FROM {lines}")
def polynomial(s, d):
    p = num.polynomial(["discount"], 2)
    return lines(s, d).select("row_id", p["1"].alias("one"), p["discount"].alias("x"), r6(p["discount*discount"], "x2"))


@query("polynomial_features", "SELECT row_id, round(quantity * discount, 6) AS qd, round(quantity * tax, 6) AS qt, round(discount * tax, 6) AS dt, round(quantity * discount * tax, 6) AS qdt FROM {lines}")
def polynomial_features(s, d):
    p = num.polynomial(["quantity", "discount", "tax"], 3, interaction_only=True, bias=False)
    return lines(s, d).select("row_id", *[r6(p[k], v) for k, v in {"quantity*discount": "qd", "quantity*tax": "qt", "discount*tax": "dt", "quantity*discount*tax": "qdt"}.items()])


@query("quantile_transform", "SELECT row_id, round(percent_rank() OVER (ORDER BY price), 6) AS price FROM {lines}")
def quantile_transform(s, d):
    return win.percent_ranks(lines(s, d), "price", "u").select("row_id", r6(C("u"), "price"))


@query("quantile_transform_normal")
def quantile_transform_normal(s, d):
    """Normal output; the inverse normal distribution has no SQL form."""
    return win.normal_scores(lines(s, d), "price", "z").select("row_id", r6(C("z"), "price"))


@query("str_length", "SELECT doc_id, length(text)::INT AS n, length(doc_id::VARCHAR)::INT AS id_n FROM documents")
def str_length(s, d):
    return read(s, d, "documents").select("doc_id", F.length("text").alias("n"), F.length(C("doc_id").cast("string")).alias("id_n"))


@query("parse_numbers", r"SELECT p_partkey, list_transform(list_concat(list_transform(regexp_extract_all(p_brand || ' ' || p_type || ' ' || p_size, '[0-9]+')[1:5], lambda x: x::BIGINT), [0, 0, 0, 0, 0])[1:5], lambda x: x::BIGINT) AS numbers FROM part")
def parse_numbers(s, d):
    return read(s, d, "part").select("p_partkey", txt.parse_numbers(F.concat_ws(" ", "p_brand", "p_type", C("p_size").cast("string"))).alias("numbers"))


_TOKENS = "SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ws FROM documents"


@query("ngram_tfidf", f"""WITH w AS ({_TOKENS}), g AS (SELECT doc_id, unnest(ws) AS term FROM w UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
    c AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM c GROUP BY 1 HAVING count(*) >= 5),
    x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM c JOIN f USING (term))
    SELECT doc_id, count(*) AS n, round(max(w / l), 6) AS top, round(sum(w / l), 4) AS total FROM (SELECT *, sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS l FROM x) GROUP BY 1""")
def ngram_tfidf(s, d):
    docs = read(s, d, "documents")
    weights = txt.tf_idf(txt.word_counts(docs, "doc_id", C("text"), 2), docs.count(), "doc_id", min_df=5, norm=False)
    # lengths, like the sums, are added up in the tasks that have the weights, which then needn't be dealt by document
    sums = weights.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("weight").alias("top"), F.sum("weight").alias("total"), F.sqrt(F.sum(C("weight") * C("weight"))).alias("length"))
    return sums.select("doc_id", "n", r6(C("top") / C("length"), "top"), F.round(C("total") / C("length"), 4).alias("total"))


@query("char_ngram_counts", "WITH g AS (SELECT unnest(list_transform(range(1, length(p_name) - 1), lambda i: substr(p_name, i::BIGINT, 3))) AS gram FROM part) SELECT gram, count(*) AS n FROM g GROUP BY 1")
def char_ngram_counts(s, d):
    return read(s, d, "part").select(F.explode(txt.char_ngrams(C("p_name"), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


@query("hash_vectorize")
def hash_vectorize(s, d):
    return txt.hash_vector(read(s, d, "documents"), "doc_id", txt.tokens(C("text"))).select("doc_id", "bucket", r6(C("weight"), "weight"))


@query("avg_word_vectors", f"""WITH w AS ({_TOKENS}), v AS (SELECT vec_id, embedding AS e FROM embeddings),
    t AS (SELECT doc_id, unnest(ws) AS word FROM w) SELECT doc_id, round(avg(e[1]), 4) AS v0, round(avg(e[2]), 4) AS v1 FROM t JOIN v ON 'w' || (length(word) * 7 % 500) = 'w' || vec_id GROUP BY 1""")
def avg_word_vectors(s, d):
    vectors = read(s, d, "embeddings").select(F.concat(F.lit("w"), C("vec_id").cast("string")).alias("word"), "embedding")
    words = F.transform(txt.tokens(C("text")), lambda w: F.concat(F.lit("w"), (F.length(w) * 7 % 500).cast("string")))
    out = txt.average_vectors(read(s, d, "documents"), "doc_id", words, vectors, "word", "embedding", 2)
    return out.select("doc_id", F.round("v0", 4).alias("v0"), F.round("v1", 4).alias("v1"))


@query("skip_column", "SELECT c_custkey, c_acctbal FROM customer")
def skip_column(s, d):
    return read(s, d, "customer").drop("c_name", "c_nationkey", "c_mktsegment")


@query("date_to_epoch", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE epoch(date_trunc('day', o_orderdate))::BIGINT END AS epoch FROM orders")
def date_to_epoch(s, d):
    day = F.when(C("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(C("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.lit("not a date"))
    return read(s, d, "orders").select("o_orderkey", txt.to_epoch(day).alias("epoch"))


@query("date_expand", "SELECT o_orderkey, second(o_orderdate)::INT AS second, minute(o_orderdate)::INT AS minute, day(o_orderdate)::INT AS day, (isodow(o_orderdate) - 1)::INT AS weekday, month(o_orderdate)::INT AS month, year(o_orderdate)::INT AS year FROM orders")
def date_expand(s, d):
    return read(s, d, "orders").select("o_orderkey", *[c.cast("int").alias(n) for n, c in txt.date_parts(C("o_orderdate")).items()])


@query("latlon_to_xyz", "WITH t AS (SELECT c_custkey, c_nationkey * 7.0 - 80 AS lat, c_acctbal / 100 AS lon FROM customer) SELECT c_custkey, round(6371.230 * cos(radians(lat)) * cos(radians(lon)), 4) AS x, round(6371.230 * cos(radians(lat)) * sin(radians(lon)), 4) AS y, round(6371.230 * sin(radians(lat)), 4) AS z FROM t")
def latlon_to_xyz(s, d):
    xyz = num.lat_lon_to_xyz(C("c_nationkey") * 7.0 - 80, C("c_acctbal") / 100)
    return read(s, d, "customer").select("c_custkey", *[F.round(e, 4).alias(n) for n, e in xyz.items()])


@query("rankdata", "SELECT row_id, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0::DOUBLE AS r FROM {lines}")
def rankdata(s, d):
    return win.rankdata(lines(s, d), "price", "r").select("row_id", "r")


@query("plotting_positions", "SELECT row_id, round((row_number() OVER (ORDER BY price, row_id) - 0.4) / ((SELECT count(*) FROM lineitem) + 0.2), 6) AS p FROM {lines}")
def plotting_positions(s, d):
    df = lines(s, d)
    return win.row_ranks(df, "price", "row_id", "r").select("row_id", r6(win.plotting_position(C("r"), df.count()), "p"))


@query("zscore", "WITH t AS (SELECT * FROM {lines}) SELECT row_id, round((tax - (SELECT avg(tax) FROM t)) / (SELECT stddev_pop(tax) FROM t), 6) AS tax FROM t")
def zscore(s, d):
    df = lines(s, d)
    return df.select("row_id", r6(num.fit_standard(df, ["tax"])["tax"], "tax"))


@query("trimtail", "SELECT row_id, CASE WHEN row_number() OVER (ORDER BY price, row_id) > floor(0.2 * (SELECT count(*) FROM lineitem)) THEN price END AS price FROM {lines}")
def trimtail(s, d):
    df = lines(s, d)
    return win.row_ranks(df, "price", "row_id", "r").select("row_id", win.trim_tail(C("r"), C("price"), df.count()).alias("price"))


@query("winsorize", "WITH t AS (SELECT * FROM {lines}), q AS (SELECT quantile_cont(price, 0.05) a, quantile_cont(price, 0.9) b FROM t) SELECT row_id, round(least(greatest(price, a), b), 6) AS clamped, price AS untouched FROM t, q")
def winsorize(s, d):
    df = lines(s, d)
    return df.select("row_id", r6(num.fit_winsorize(df, "price", 0.05, 0.1), "clamped"), num.fit_winsorize(df, "price").alias("untouched"))


@query("rsh", "WITH t AS (SELECT row_id, quantity AS x FROM {lines}), p AS (SELECT count(*) AS n, 1.2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / pow(count(*), 0.2) AS h FROM t), v AS (SELECT x, count(*) AS c FROM t GROUP BY 1), dens AS (SELECT a.x, sum(b.c) AS near FROM v a JOIN v b ON abs(a.x - b.x) <= (SELECT h FROM p) GROUP BY 1) SELECT row_id, round(near / (2 * n * h), 6) AS density FROM t JOIN dens USING (x), p")
def rsh(s, d):
    return win.histogram_density(lines(s, d), "quantity", "density").select("row_id", r6(C("density"), "density"))
