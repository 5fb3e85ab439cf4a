"""Queries of aggregations, folds, preparers, top-k and scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergeloom.functions import approximate
from mergeloom.operators import aggregators as A
from mergeloom.operators import fold, ordered, scan
from mergeloom.operators.preparer import prepare
from mergeloom.plans import spec
from mergeloom.plans.catalog import query
from mergeloom.sources.tables import seconds, table


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("""
    select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 4) as sum_qty, round(avg(l_discount), 6) as avg_disc,
        round(var_pop(l_extendedprice), 2) as var_price, max(l_quantity) as max_qty, min(l_quantity) as min_qty,
        count(*) filter (l_discount > 0.05) as n_discounted
    from lineitem group by all""")
def multi_agg_pricing(spark, sf):
    aggs = {
        "n": A.size(), "qty": A.numeric_sum("l_quantity"), "disc": A.averaged("l_discount"), "price": A.moments("l_extendedprice"),
        "max_qty": A.max_of("l_quantity"), "min_qty": A.min_of("l_quantity"), "n_discounted": A.count(F.col("l_discount") > 0.05),
    }
    out = spec.aggregate(table(spark, sf, "lineitem"), {"s": spec.struct_of(aggs)}, ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "s.n", r("s.qty", 4).alias("sum_qty"), r("s.disc.mean").alias("avg_disc"), r("s.price.variance", 2).alias("var_price"), "s.max_qty", "s.min_qty", "s.n_discounted")


@query("""select event_type, bool_or(value > 489) as any_high, bool_and(value > 0.01) as all_positive, count(*) filter (value > 100) as n_over,
        coalesce(bool_or(value > 480) filter (user_id % 7 = 0), false) as any_high_7 from events group by 1""")
def exists_forall(spark, sf):
    v = F.col("value")
    aggs = {"any_high": A.exists(v > 489), "all_positive": A.forall(v > 0.01), "n_over": A.count(v > 100), "any_high_7": A.exists(v > 480).filter_before(F.col("user_id") % 7 == 0)}
    return spec.aggregate(table(spark, sf, "events"), aggs, ["event_type"])


@query("""select user_id, arg_min(value, (ts, event_id)) as first_value, arg_max(value, (ts, event_id)) as last_value from events group by 1""")
def head_last(spark, sf):
    order = ["ts", "event_id"]
    return spec.aggregate(table(spark, sf, "events"), {"first_value": A.head("value", order), "last_value": A.last("value", order)}, ["user_id"])


@query("""select o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) as dearest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as cheapest from orders group by 1""")
def max_by_min_by(spark, sf):
    aggs = {"dearest": A.max_by("o_orderkey", "o_totalprice", ["o_orderkey"]), "cheapest": A.min_by("o_orderkey", "o_totalprice", ["o_orderkey"])}
    return spec.aggregate(table(spark, sf, "orders"), aggs, ["o_custkey"])


@query("""select l_returnflag, array_to_string(list(l_extendedprice order by l_extendedprice)[1:5], ';') as smallest from lineitem group by 1""")
def sorted_take(spark, sf):
    out = A.sorted_take(table(spark, sf, "lineitem"), 5, "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.array_join(F.transform("values", lambda v: v.cast("string")), ";").alias("smallest"))


@query("""select l_returnflag, array_to_string(list(l_extendedprice order by l_extendedprice desc)[1:5], ';') as largest from lineitem group by 1""")
def sorted_reverse_take(spark, sf):
    out = A.sorted_reverse_take(table(spark, sf, "lineitem"), 5, "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", F.array_join(F.transform("values", lambda v: v.cast("string")), ";").alias("largest"))


@query("""select o_orderkey, o_totalprice, (row_number() over (order by o_totalprice desc, o_orderkey))::int as rank from orders
    qualify rank <= 10""")
def sort_by_take(spark, sf):
    order = [F.col("o_totalprice").desc(), F.col("o_orderkey")]
    return A.sort_by_take(table(spark, sf, "orders"), 10, order).select("o_orderkey", "o_totalprice", "rank")


@query("""select o_orderpriority, o_orderkey, rank::int as rank from (select *, row_number() over (partition by o_orderpriority order by o_totalprice, o_orderkey) as rank from orders) where rank <= 3""")
def sort_by_take_grouped(spark, sf):
    order = [F.col("o_totalprice"), F.col("o_orderkey")]
    return A.sort_by_take(table(spark, sf, "orders"), 3, order, ["o_orderpriority"]).select("o_orderpriority", "o_orderkey", "rank")


@query("""select l_returnflag, array_to_string(list(p order by p)[1:4], ',') as top from (select l_returnflag, l_partkey * 100000000 + l_orderkey as p from lineitem) group by 1""")
def top_k_buffers_merged(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", (F.col("l_partkey") * 100000000 + F.col("l_orderkey")).alias("p"))
    out = A.merge_top_k(A.top_k(rows, 4, "p", ["l_returnflag", "l_linestatus"]), 4, ["l_returnflag"])
    return out.select("l_returnflag", F.array_join(F.transform("top", lambda v: v.cast("string")), ",").alias("top"))


@query("""select user_id, string_agg(event_type, '>' order by ts, event_id) as path, count(distinct event_type) as kinds,
        array_to_string(list_sort(list(distinct event_type)), ',') as kind_set from events group by 1""")
def to_list_to_set(spark, sf):
    aggs = {"path": A.concat_strings("event_type", ["ts", "event_id"], ">"), "kinds": A.unique_count_exact("event_type"), "kind_set": A.to_set("event_type")}
    out = spec.aggregate(table(spark, sf, "events"), aggs, ["user_id"])
    return out.withColumn("kind_set", F.array_join("kind_set", ","))


@query("""select l_partkey, count(distinct l_suppkey) as suppliers from lineitem group by 1""")
def unique_count(spark, sf):
    return spec.aggregate(table(spark, sf, "lineitem"), {"suppliers": A.unique_count_exact("l_suppkey")}, ["l_partkey"])


@query("""select n_regionkey, round(product(n_nationkey + 1), 3) as p, product(n_nationkey + 1)::bigint as exact, count(*) as n from nation group by 1""")
def ring_product(spark, sf):
    x = (F.col("n_nationkey") + 1)
    aggs = {"p": A.product_of(x.cast("double")), "exact": A.exact_product(x), "n": A.size()}
    return spec.aggregate(table(spark, sf, "nation"), aggs, ["n_regionkey"]).withColumn("p", r("p", 3))


@query("""select l_linestatus, round(sum(l_quantity) filter (l_returnflag = 'R'), 4) as returned, max(l_discount) filter (l_returnflag <> 'R') as kept_max from lineitem group by 1""")
def either_agg(spark, sf):
    agg = A.numeric_sum("l_quantity").lift().either(A.max_of("l_discount"), F.col("l_returnflag") == "R")
    out = spec.aggregate(table(spark, sf, "lineitem"), {"e": agg}, ["l_linestatus"])
    return out.select("l_linestatus", r("e.left", 4).alias("returned"), F.col("e.right").alias("kept_max"))


@query("""select user_id % 5 as g, case when count(*) filter (event_type = 'error') > 0 then round(sum(value) filter (event_type = 'error'), 4) end as lefts,
        case when count(*) filter (event_type = 'error') = 0 then round(sum(value) filter (event_type <> 'error'), 4) end as rights from events where user_id > 3 group by 1""")
def either_semigroup(spark, sf):
    err = F.col("event_type") == "error"
    agg = A.either_sum(F.when(err, F.col("value")), F.when(~err, F.col("value")))
    rows = table(spark, sf, "events").where("user_id > 3").withColumn("g", F.col("user_id") % 5)
    return spec.aggregate(rows, {"e": agg}, ["g"]).select("g", r("e.left", 4).alias("lefts"), r("e.right", 4).alias("rights"))


@query("""select l_returnflag, round(sum(l_quantity * 2) filter (l_linenumber < 3), 4) as twice from lineitem group by 1""")
def collect_before(spark, sf):
    agg = A.numeric_sum("l_quantity").collect_before(F.col("l_linenumber") < 3, lambda x: x * 2)
    return spec.aggregate(table(spark, sf, "lineitem"), {"twice": agg}, ["l_returnflag"]).withColumn("twice", r("twice", 4))


@query("""select label, round(sum(s), 4) as total from (select label, list_sum(list_transform(embedding, lambda x: x::double)) as s from embeddings) group by 1""")
def sum_before(spark, sf):
    return spec.aggregate(table(spark, sf, "embeddings"), {"total": A.sum_before("embedding")}, ["label"]).withColumn("total", r("total", 4))


@query("""select event_type, n as n_value, round(total, 4) as total_value from (select event_type, count(*) as n, sum(value) as total from events group by 1)""")
def map_aggregator(spark, sf):
    agg = spec.map_of({"n": A.size().and_then_present(lambda c: c.cast("double")), "total": A.numeric_sum("value")})
    out = spec.aggregate(table(spark, sf, "events"), {"m": agg}, ["event_type"])
    return out.select("event_type", F.col("m")["n"].cast("long").alias("n_value"), r(F.col("m")["total"], 4).alias("total_value"))


@query("""select event_type, round(min(value), 6) as low, round(max(value), 6) as high, round(avg(value), 6) as mean from events group by 1""")
def sequence_of_folds(spark, sf):
    agg = fold.sequence([A.min_of("value"), A.max_of("value"), A.average("value")])
    out = spec.aggregate(table(spark, sf, "events"), {"a": agg}, ["event_type"])
    return out.select("event_type", *[r(F.col("a")[i]).alias(n) for i, n in enumerate(("low", "high", "mean"))])


@query("""select o_orderpriority, max(o_totalprice) as top, 7 as seven, round(max(o_totalprice) - min(o_totalprice), 4) as spread from orders group by 1""")
def const_and_join_with(spark, sf):
    aggs = {"top": A.max_of("o_totalprice"), "seven": A.const(7), "spread": fold.join_with(A.max_of("o_totalprice"), A.min_of("o_totalprice"), lambda a, b: a - b)}
    return spec.aggregate(table(spark, sf, "orders"), aggs, ["o_orderpriority"]).withColumn("spread", r("spread", 4))


@query("""select user_id % 10 as g, max(value) as top, bit_xor(event_id) as bits from events group by 1""")
def from_reduce(spark, sf):
    rows = table(spark, sf, "events").withColumn("g", F.col("user_id") % 10)
    aggs = {"top": A.from_reduce("value", lambda a, b: F.greatest(a, b)), "bits": A.from_reduce("event_id", lambda a, b: a.bitwiseXOR(b))}
    return spec.aggregate(rows, aggs, ["g"])


@query("""select l_linestatus, count(*) as n, round(sum(l_quantity), 4) as s from lineitem where l_quantity > 25 group by 1""")
def preparer_chain(spark, sf):
    rows = prepare(table(spark, sf, "lineitem"), "l_quantity").filter(lambda x: x > 25).group_by("l_linestatus")
    return rows.split(lambda x: {"n": A.size(), "s": A.numeric_sum(x)}).withColumn("s", r("s", 4))


@query("""select count(*) as n, count(distinct w) as words, max(w) as last_word from (select unnest(string_split(p_name, ' ')) as w from part) where length(w) > 2""")
def preparer_flat_map(spark, sf):
    rows = prepare(table(spark, sf, "part"), "p_name").flat_map(lambda x: F.split(x, " ")).filter(lambda w: F.length(w) > 2)
    return rows.aggregate(n=A.size(), words=A.unique_count_exact("x"), last_word=A.max_of("x"))


@query("""select 0::bigint as n, null::double as top, true as every, false as some, 0.0::double as total""")
def empty_input(spark, sf):
    none = table(spark, sf, "events").limit(0)
    v = F.col("value")
    return spec.aggregate(none, {"n": A.size(), "top": A.max_of("value"), "every": A.forall(v > 0), "some": A.exists(v > 0), "total": A.numeric_sum("value")})


@query("""select count(*) as n from (select ('0x' || substr(md5('471312384:' || event_id), 1, 8))::bigint / 4294967296.0::double as u from events) where u < 0.1""")
def random_sample(spark, sf):
    return A.random_sample(table(spark, sf, "events"), 0.1, ["event_id"]).agg(F.count("*").alias("n"))


@query("""select event_id, value from (select *, ('0x' || substr(md5('471312384:' || event_id), 1, 8))::bigint as u from events) order by u, event_id limit 20""")
def reservoir_sample(spark, sf):
    return A.reservoir_sample(table(spark, sf, "events"), 20, ["event_id"]).select("event_id", "value")


@query("""select event_type, n, round(s, 4) as s from (select event_type, count(*) as n, sum(value) as s from events group by 1)""")
def buffers_stored_and_merged(spark, sf):
    rows = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    aggs = {"n": A.size(), "s": A.numeric_sum("value")}
    old = spec.buffers(rows.where("event_id % 2 = 0"), aggs, ["event_type", "day"])
    both = spec.append(old, rows.where("event_id % 2 = 1"), aggs, ["event_type", "day"])
    return spec.present_buffers(spec.merge(both, aggs, ["event_type"]), aggs, ["event_type"]).withColumn("s", r("s", 4))


# Statistics ------------------------------------------------------------

MOMENTS_SQL = """
    with m as (select {key}, count(*) as n, avg({x}) as mu from {t} group by 1),
    c as (select {key}, any_value(n) as n, any_value(mu) as mu, sum(power({x} - mu, 2)) as m2, sum(power({x} - mu, 3)) as m3, sum(power({x} - mu, 4)) as m4
          from {t} join m using ({key}) group by 1)
    select {key}, n, round(mu, 4) as mean, round(m2 / n, 3) as variance, round(m3 / (m2 * sqrt(m2 / n)), 6) as skewness, round(n * m4 / (m2 * m2) - 3, 6) as kurtosis from c"""


@query(MOMENTS_SQL.format(key="l_returnflag", x="l_extendedprice", t="lineitem"))
def moments(spark, sf):
    out = spec.aggregate(table(spark, sf, "lineitem"), {"m": A.moments("l_extendedprice")}, ["l_returnflag"])
    return out.select("l_returnflag", F.col("m.count").alias("n"), r("m.mean", 4).alias("mean"), r("m.variance", 3).alias("variance"), r("m.skewness").alias("skewness"), r("m.kurtosis").alias("kurtosis"))


@query(MOMENTS_SQL.format(key="l_returnflag", x="l_extendedprice", t="lineitem"))
def moments_merge(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("day", F.date_trunc("day", "l_shipdate"))
    merged = A.merge_moments(A.moment_buffers(rows, "l_extendedprice", ["l_returnflag", "day"]), ["l_returnflag"])
    s = A.present_moments([F.col(m) for m in A.MOMENTS])
    return merged.select("l_returnflag", F.col("m0").cast("long").alias("n"), r(s["mean"], 4).alias("mean"), r(s["variance"], 3).alias("variance"), r(s["skewness"]).alias("skewness"), r(s["kurtosis"]).alias("kurtosis"))


@query(MOMENTS_SQL.format(key="l_returnflag", x="l_extendedprice", t="lineitem"))
def moments_stored_merged(spark, sf):
    """Buffers by day and supplier, more rows appended, merged by the engine."""
    rows = table(spark, sf, "lineitem").withColumn("day", F.date_trunc("day", "l_shipdate"))
    aggs = {"m": A.moments("l_extendedprice"), "n": A.size()}
    stored = spec.buffers(rows.where("l_linenumber < 4"), aggs, ["l_returnflag", "day", "l_suppkey"])
    both = spec.append(stored, rows.where("l_linenumber >= 4"), aggs, ["l_returnflag", "day", "l_suppkey"])
    out = spec.present_buffers(spec.merge(spec.merge(both, aggs, ["l_returnflag", "day"]), aggs, ["l_returnflag"]), aggs, ["l_returnflag"])
    return out.select("l_returnflag", "n", r("m.mean", 4).alias("mean"), r("m.variance", 3).alias("variance"), r("m.skewness").alias("skewness"), r("m.kurtosis").alias("kurtosis"))


@query("""select event_id, count(*) over w as n, round(avg(value) over w, 6) as mean, round(stddev_pop(value) over w, 4) as stddev from events
    window w as (partition by user_id order by ts, event_id rows between 9 preceding and current row)""")
def moments_trailing(spark, sf):
    """Moments over a sliding window."""
    w = scan.ordered(["ts", "event_id"], ["user_id"]).rowsBetween(-9, 0)
    out = table(spark, sf, "events").select("event_id", A.moments("value").over(w).alias("m"))
    return out.select("event_id", F.col("m.count").alias("n"), r("m.mean", 6).alias("mean"), r("m.stddev", 4).alias("stddev"))


@query("""select l_returnflag, round(avg(l_quantity), 6) as mean, round(var_pop(l_quantity), 6) as variance, 2 * count(*)::double as n from lineitem group by 1""")
def moments_scaled(spark, sf):
    m = A.scale_moments(A.moment_buffers(table(spark, sf, "lineitem"), "l_quantity", ["l_returnflag"]), 2.0)
    s = A.present_moments([F.col(m) for m in A.MOMENTS])
    return m.select("l_returnflag", r(s["mean"]).alias("mean"), r(s["variance"]).alias("variance"), F.col("m0").cast("double").alias("n"))


@query("""select event_type, count(*) filter (user_id >= 10) as n, round(avg(value) filter (user_id >= 10), 6) as mean from events group by 1""")
def averaged_minus(spark, sf):
    rows = table(spark, sf, "events")
    both = rows.withColumn("w", F.lit(1)).unionByName(rows.where("user_id < 10").withColumn("w", F.lit(-1)))
    out = spec.aggregate(both, {"a": A.averaged("value", "w")}, ["event_type"])
    return out.select("event_type", F.col("a.count").alias("n"), r("a.mean").alias("mean"))


@query("""select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as correlation, round(covar_pop(l_quantity, l_extendedprice), 3) as covariance,
        round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
        round(sqrt(1 - corr(l_quantity, l_extendedprice)), 6) as distance from lineitem group by 1""")
def correlation(spark, sf):
    out = spec.aggregate(table(spark, sf, "lineitem"), {"c": A.correlation("l_quantity", "l_extendedprice")}, ["l_returnflag"])
    return out.select("l_returnflag", r("c.correlation").alias("correlation"), r("c.covariance", 3).alias("covariance"), r("c.slope", 4).alias("slope"), r("c.intercept", 3).alias("intercept"), r("c.distance").alias("distance"))


CORRELATION_SQL = """select l_returnflag, count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as correlation, round(covar_pop(l_quantity, l_extendedprice), 3) as covariance,
    round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept from lineitem group by 1"""


@query(CORRELATION_SQL)
def correlation_stored_merged(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("day", F.date_trunc("day", "l_shipdate"))
    aggs = {"c": A.correlation("l_quantity", "l_extendedprice")}
    stored = spec.append(spec.buffers(rows.where("l_linenumber < 4"), aggs, ["l_returnflag", "day"]), rows.where("l_linenumber >= 4"), aggs, ["l_returnflag", "day"])
    out = spec.present_buffers(spec.merge(stored, aggs, ["l_returnflag"]), aggs, ["l_returnflag"])
    return out.select("l_returnflag", F.col("c.count").alias("n"), r("c.correlation").alias("correlation"), r("c.covariance", 3).alias("covariance"), r("c.slope", 4).alias("slope"), r("c.intercept", 3).alias("intercept"))


WEIGHTED_SQL = """with w as (select l_returnflag, l_linenumber::double as w, l_quantity + {shift} as x, l_discount as y from lineitem),
        m as (select l_returnflag, sum(w) as sw, sum(w * x) / sum(w) as mx, sum(w * y) / sum(w) as my from w group by 1)
    select l_returnflag, any_value(sw) as weight, round(any_value(mx) - {shift}, 6) as mean_x, round(sum(w * (x - mx) * (y - my)) / any_value(sw), 6) as covariance,
        round(sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))), 6) as correlation from w join m using (l_returnflag) group by 1"""


def _weighted(out):
    return out.select("l_returnflag", "c.weight", r("c.mean_x").alias("mean_x"), r("c.covariance").alias("covariance"), r("c.correlation").alias("correlation"))


@query(WEIGHTED_SQL.format(shift=0))
def weighted_correlation(spark, sf):
    return _weighted(spec.aggregate(table(spark, sf, "lineitem"), {"c": A.weighted_correlation("l_quantity", "l_discount", "l_linenumber")}, ["l_returnflag"]))


@query(WEIGHTED_SQL.format(shift=0))
def weighted_correlation_shifted(spark, sf):
    """Values near a billion that vary by tens, by stored buffers."""
    rows = table(spark, sf, "lineitem").withColumn("x", F.col("l_quantity") + F.lit(1e9))
    aggs = {"c": A.weighted_correlation_of(rows, "x", "l_discount", "l_linenumber")}
    out = spec.present_buffers(spec.merge(spec.buffers(rows, aggs, ["l_returnflag", "l_suppkey"]), aggs, ["l_returnflag"]), aggs, ["l_returnflag"])
    return _weighted(out.withColumn("c", F.col("c").withField("mean_x", F.col("c.mean_x") - F.lit(1e9))))


@query("""select l_returnflag, round(sum(l_quantity), 4) as mean, round(sum(l_discount), 4) as variance from lineitem group by 1""")
def gaussian_sum(spark, sf):
    out = spec.aggregate(table(spark, sf, "lineitem"), {"g": A.gaussian_sum("l_quantity", "l_discount")}, ["l_returnflag"])
    return out.select("l_returnflag", r("g.mean", 4).alias("mean"), r("g.variance", 4).alias("variance"))


@query("""with e as (select user_id, value, epoch_us(ts) / 1e6 as t from events), m as (select user_id, max(t) as m from e group by 1)
    select user_id, round(sum(value * exp(-(m - t) * ln(2) / 86400.0)), 4) as value, round(sum(value * exp(-(m - t) * ln(2) / 86400.0)) / (86400.0 / ln(2)), 8) as average
    from e join m using (user_id) group by 1""")
def decayed_value(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "value", seconds("ts").alias("t"))
    out = A.decayed_value(rows, "value", "t", 86400.0, ["user_id"])
    return out.select("user_id", r("value", 4).alias("value"), r(A.decayed_average(F.col("value"), 86400.0), 8).alias("average"))


@query("""with e as (select event_type, value, epoch_us(ts) / 1e6 as t from events), m as (select max(t) as m, min(t) as s from e),
        d as (select event_type, sum(value * exp(-(m - t) * ln(2) / 86400.0)) as v, any_value(m) as m, any_value(s) as s from e, m group by 1)
    select event_type, round(v, 4) as value, round(v / (86400.0 * (1 - power(2.0, (s - m) / 86400.0)) / ln(2)), 8) as average_from,
        round(v * (1 - power(2.0, -1 / 86400.0)), 8) as discrete, round(v * exp(-3600.0 * ln(2) / 86400.0), 4) as later from d""")
def decayed_vector(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value", seconds("ts").alias("t"))
    start = rows.agg(F.min("t").alias("s"))
    out = A.decayed_vector(rows, "event_type", "value", "t", 86400.0).join(F.broadcast(start))
    v, t = F.col("value"), F.col("time")
    return out.select("event_type", r(v, 4).alias("value"), r(A.decayed_average_from(v, 86400.0, F.col("s"), t), 8).alias("average_from"), r(A.discrete_average(v, 86400.0), 8).alias("discrete"), r(A.value_as_of(v, t, 86400.0, t + 3600.0), 4).alias("later"))


@query("""select user_id % 4 as g, round(arg_max(s, ts), 6) as slope_log from (select user_id, ts, 0.0::double as s from events) group by 1""")
def affine_identity(spark, sf):
    rows = table(spark, sf, "events").withColumn("g", F.col("user_id") % 4)
    agg = fold.affine(F.lit(1.0), F.lit(0.0), ["ts", "event_id"])
    return spec.aggregate(rows, {"f": agg}, ["g"]).select("g", r(F.log(F.col("f.slope"))).alias("slope_log"))


@query("""select case when n <= 1000 then n else 1000 end as value from (select count(*) as n from events)""")
def eventually(spark, sf):
    agg = A.eventually(A.size(), A.const(1000).and_then_present(lambda c: c.cast("long")), lambda n: n > 1000)
    return spec.aggregate(table(spark, sf, "events"), {"value": agg})


# Approximate numbers -----------------------------------------------------


@query("""select event_type, round(lo + lo2, 4) as sum_min, round(hi + hi2, 4) as sum_max, round(0.9::double * 0.8::double, 6) as prob,
        round(least(lo * lo2, lo * hi2, hi * lo2, hi * hi2), 2) + 0.0 as prod_min, round(greatest(lo * lo2, lo * hi2, hi * lo2, hi * hi2), 2) + 0.0 as prod_max
    from (select event_type, min(value) as lo, max(value) as hi, -max(value) as lo2, -min(value) as hi2 from events group by 1)""")
def approximate_arithmetic(spark, sf):
    b = spec.aggregate(table(spark, sf, "events"), {"lo": A.min_of("value"), "hi": A.max_of("value")}, ["event_type"])
    x = approximate.approximate(F.col("lo"), F.col("lo"), F.col("hi"), F.lit(0.9))
    y = approximate.negate(approximate.approximate(F.col("lo"), F.col("lo"), F.col("hi"), F.lit(0.8)))
    out = b.select("event_type", approximate.plus(x, y).alias("s"), approximate.times(x, y).alias("p"))
    return out.select("event_type", r("s.min", 4).alias("sum_min"), r("s.max", 4).alias("sum_max"), r("s.prob").alias("prob"), r("p.min", 2).alias("prod_min"), r("p.max", 2).alias("prod_max"))


# Scans -------------------------------------------------------------------


def _w():
    return scan.ordered(["ts", "event_id"], ["user_id"])


@query("""select event_id, round(sum(value) over w, 4) as total, count(*) over w as n, round(avg(value) over w, 9) as mean, max(value) over w as top
    from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)""")
def cumulative_agg(spark, sf):
    w = _w()
    c = {"total": r(scan.cumulative(A.numeric_sum("value"), w), 4), "n": scan.cumulative(A.size(), w), "mean": r(scan.cumulative(A.averaged("value"), w)["mean"], 9), "top": scan.cumulative(A.max_of("value"), w)}
    return scan.scan(table(spark, sf, "events"), c).select("event_id", *c)


@query("""select event_id, (row_number() over w - 1)::int as index, round(coalesce(sum(value) over (w rows between unbounded preceding and 1 preceding), 0), 4) as before,
        round(sum(value) over (w rows unbounded preceding), 4) as after, round(100 + sum(value) over (w rows unbounded preceding), 4) as from_100
    from events window w as (partition by user_id order by ts, event_id)""")
def scan_prior_posterior_index(spark, sf):
    w, s = _w(), A.numeric_sum("value")
    c = {"index": scan.index(w), "before": r(scan.prior_state(s, w, 0.0), 4), "after": r(scan.posterior_state(s, w), 4), "from_100": r(scan.from_aggregator(s, w, F.lit(100.0)), 4)}
    return scan.scan(table(spark, sf, "events"), c).select("event_id", *c)


@query("""select event_id, max(running) over (partition by user_id order by ts, event_id rows unbounded preceding) as top_running
    from (select *, round(sum(value) over (partition by user_id order by ts, event_id rows unbounded preceding), 4) as running from events)""")
def scan_compose(spark, sf):
    first = scan.scan(table(spark, sf, "events"), {"running": r(scan.cumulative(A.numeric_sum("value"), _w()), 4)})
    return scan.scan(first, {"top_running": scan.cumulative(A.max_of("running"), _w())}).select("event_id", "top_running")


@query("""select event_id, round(sum(value) over w, 4) as total, count(*) over w as n, array_to_string(list(event_id) over w, ',') as items
    from events window w as (partition by user_id order by ts, event_id rows between 4 preceding and current row)""")
def window_trailing_n(spark, sf):
    w = _w()
    c = {"total": r(scan.trailing(A.numeric_sum("value"), 5, w), 4), "n": scan.trailing(A.size(), 5, w), "items": F.array_join(scan.trailing_items("event_id", 5, w), ",")}
    return scan.scan(table(spark, sf, "events"), c).select("event_id", *c)


@query("""select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between 99 preceding and current row)::bigint as total from events""")
def window_by_difference(spark, sf):
    return scan.scan(table(spark, sf, "events"), {"total": scan.trailing_sum_by_difference("event_id", 100, _w())}).select("event_id", "total")


@query("""select user_id, round(sum(value), 4) as total, count(*) as n from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as k from events) where k <= 7 group by 1""")
def window_last_n(spark, sf):
    out = scan.last_n(table(spark, sf, "events"), {"total": A.numeric_sum("value"), "n": A.size()}, 7, ["ts", "event_id"], ["user_id"])
    return out.withColumn("total", r("total", 4))


@query("""select a.user_id, a.event_id as left_id, b.event_id as right_id, (a.k - 1)::int as index
    from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'click') a
    join (select *, row_number() over (partition by user_id order by ts, event_id) as k from events where event_type = 'view') b on a.user_id = b.user_id and a.k = b.k""")
def scan_zip(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("left_id"))
    right = e.where("event_type = 'view'").select("user_id", F.col("ts").alias("ts2"), F.col("event_id").alias("right_id"))
    return scan.zip_scans(left, right, ["ts", "left_id"], ["ts2", "right_id"], ["user_id"]).select("user_id", "left_id", "right_id", "index")


@query("""select event_id, (sum(event_id) over w)::bigint as total, count(*) over w as n, max(value) over w as top, first_value(user_id) over w as first_user
    from events window w as (order by ts, event_id rows unbounded preceding)""")
def scan_global(spark, sf):
    """Running values over the whole table, in as many tasks as ranges."""
    rows = table(spark, sf, "events").select("event_id", "ts", "value", "user_id")
    aggs = {"total": A.sum_of("event_id"), "n": A.size(), "top": A.max_of("value"), "first_user": A.head("user_id", ["ts", "event_id"])}
    return scan.global_scan(rows, aggs, ["ts", "event_id"], seconds("ts"), 16).select("event_id", *aggs)


@query("""select user_id, 1 as one, count(*) filter (value > 100) as n, case when count(*) > 70 then round(max(value) * 2, 4) end as doubled from events group by 1""")
def custom_aggregators(spark, sf):
    """Aggregations from one's own parts, prepared and presented."""
    aggs = {
        "one": A.const(1), "n": A.prepared("value", lambda x: x > 100, A.count),
        "doubled": A.append_monoid("value", F.max, F.max, present=lambda v: r(v * 2, 4)),
    }
    out = spec.aggregate(table(spark, sf, "events"), {**aggs, "all": A.size()}, ["user_id"])
    return out.select("user_id", "one", "n", F.when(F.col("all") > 70, F.col("doubled")).alias("doubled"))


@query("""select event_id, 10::double + 0.5::double * (row_number() over w - 1) as steps from events window w as (partition by user_id order by ts, event_id)""")
def scan_iterate(spark, sf):
    return scan.scan(table(spark, sf, "events"), {"steps": r(scan.iterate_arithmetic(10.0, 0.5, _w()), 4)}).select("event_id", "steps")


@query("""select event_id, coalesce(sum(event_id) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from events""")
def prefix_sums(spark, sf):
    from mergeloom.streaming.summers import prefix_sums as sums

    return sums(table(spark, sf, "events"), "event_id", ["ts", "event_id"], ["user_id"]).select("event_id", "before")


@query("""select event_id, user_id, greatest(0, 1 + max(b) over (partition by user_id order by ts, event_id rows unbounded preceding)) as streak_start
    from (select *, case when event_type = 'error' then row_number() over (partition by user_id order by ts, event_id) - 1 else -1 end as b from events)""")
def general_scan(spark, sf):
    """A scan whose step is a Python function: where the current run without
    errors began."""

    def step(state, row):
        index, start = state
        start = index + 1 if row[0] == "error" else start
        return (index + 1, start), (int(row[1]), start)

    return ordered.scan_groups(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], ["event_type", "event_id"], "user_id long, event_id long, streak_start long", (0, 0), step)


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events),
        f as (select user_id, min(k) as k from e where event_type = 'purchase' group by 1)
    select e.user_id, round(any_value(e2.value) + coalesce(sum(e.value) filter (e.k < f.k), 0), 4) as value
    from e join f on e.user_id = f.user_id join e e2 on e2.user_id = f.user_id and e2.k = f.k group by 1""")
def right_folded(spark, sf):
    """Values before the first purchase, folded into it."""
    bought = F.col("event_type") == "purchase"
    rows = table(spark, sf, "events").withColumn("item", F.when(~bought, F.col("value"))).withColumn("start", F.when(bought, F.col("value")))
    out = ordered.right_folded(rows, ["user_id"], ["ts", "event_id"], "item", "start", "user_id long, value double", lambda x, acc: acc + x)
    return out.withColumn("value", r("value", 4))


@query("""with e as (select *, row_number() over (partition by user_id order by ts, event_id) as k from events),
        l as (select user_id, max(k) as k from e where event_type = 'purchase' group by 1)
    select e.user_id, round(sum(e.value), 4) as total from e join l on e.user_id = l.user_id and e.k <= l.k group by 1""")
def right_folded_sums(spark, sf):
    bought = F.col("event_type") == "purchase"
    rows = table(spark, sf, "events").withColumn("item", F.when(~bought, F.col("value"))).withColumn("start", F.when(bought, F.col("value")))
    out = ordered.right_folded_sums(rows, ["user_id"], ["ts", "event_id"], "item", "start", "user_id long, value double, total double", lambda x, acc: acc + x)
    return out.select("user_id", r("total", 4).alias("total"))


@query("""with r as (select l_returnflag, {'n': 0::bigint, 'a': 0::double, 'b': 0::double, 'c': 0::double, 'x': l_quantity / 50, 'z': l_discount * 10, 'y': l_extendedprice / 1e5} as r,
        l_orderkey, l_linenumber, l_partkey, l_extendedprice / 1e5 as y from lineitem),
    l as (select l_returnflag, list_prepend({'n': 0::bigint, 'a': 0::double, 'b': 0::double, 'c': 0::double, 'x': 0::double, 'z': 0::double, 'y': 0::double},
        list(r order by l_orderkey, l_linenumber, l_partkey, y)) as l from r group by 1),
    w as (select l_returnflag, list_reduce(l, lambda s, r: {'n': s.n + 1,
        'a': s.a - 0.1 * power(s.n + 1.0, -0.5) * ((s.a * r.x + s.b * r.z + s.c - r.y) * r.x),
        'b': s.b - 0.1 * power(s.n + 1.0, -0.5) * ((s.a * r.x + s.b * r.z + s.c - r.y) * r.z),
        'c': s.c - 0.1 * power(s.n + 1.0, -0.5) * (s.a * r.x + s.b * r.z + s.c - r.y), 'x': 0::double, 'z': 0::double, 'y': 0::double}) as w from l)
    select l_returnflag, w.n as steps, round(w.a, 6) as quantity, round(w.b, 6) as discount, round(w.c, 6) as intercept from w""")
def sgd_linear(spark, sf):
    """One model a return flag, price from quantity and discount (scaled)."""
    rows = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_quantity") / 50).alias("x1"), (F.col("l_discount") * 10).alias("x2"), (F.col("l_extendedprice") / 1e5).alias("y"))
    out = ordered.linear_sgd(rows, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "y"], ["x1", "x2"], "y", [0.0, 0.0, 0.0], ordered.count_adaptive_step(0.1, 0.5), key_schema="l_returnflag string")
    w = F.col("weights")
    return out.select("l_returnflag", F.col("count").alias("steps"), r(w[0]).alias("quantity"), r(w[1]).alias("discount"), r(w[2]).alias("intercept"))
