"""Queries of scalar instances: arrays, strings, intervals, vectors, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from mergeloom.functions import algebra, intervals, vectors
from mergeloom.operators import aggregators as A
from mergeloom.plans import spec
from mergeloom.plans.catalog import query
from mergeloom.sources.tables import table


def r(c, digits: int = 6):
    return F.round(c, digits)


@query("""select label, (i - 1)::int as i, round(sum(v), 3) as v from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as i from embeddings) group by 1, 2""")
def elementwise_array_sum(spark, sf):
    out = algebra.elementwise_sum(table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), "embedding", ["label"])
    return out.select("label", F.posexplode("embedding").alias("i", "v")).withColumn("v", r("v", 3))


@query("""select array_to_string([n_nationkey + n_regionkey, 10 + n_nationkey, 3], ',') as s, array_to_string([n_nationkey * n_regionkey, 10 * n_nationkey], ',') as p, n_nationkey from nation""")
def array_ring(spark, sf):
    n, g = F.col("n_nationkey"), F.col("n_regionkey")
    a, b = F.array(n, F.lit(10), F.lit(3)), F.array(g, n)
    text = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return table(spark, sf, "nation").select("n_nationkey", text(algebra.elementwise(a, b)).alias("s"), text(algebra.elementwise_times(a, b)).alias("p"))


@query("""select n_regionkey, string_agg(n_name, '' order by n_nationkey) as names from nation group by 1""")
def string_monoid(spark, sf):
    return spec.aggregate(table(spark, sf, "nation"), {"names": algebra.plus_agg("n_name", T.StringType(), ["n_nationkey"])}, ["n_regionkey"])


@query("""select n_regionkey, sum(n_nationkey)::bigint as total, bit_xor((n_nationkey % 2)::int) = 1 as odd, string_agg(n_name, '' order by n_nationkey) as names from nation group by 1""")
def struct_instances(spark, sf):
    """A struct column added up component by component, by its schema."""
    rows = table(spark, sf, "nation").withColumn("s", F.struct(F.col("n_nationkey").alias("total"), (F.col("n_nationkey") % 2 == 1).alias("odd"), F.col("n_name").alias("names")))
    out = spec.aggregate(rows, {"s": algebra.plus_agg("s", rows.schema["s"].dataType, ["n_nationkey"])}, ["n_regionkey"])
    return out.select("n_regionkey", "s.*")


@query("""select n_nationkey, n_nationkey * 2 as times2, repeat(n_name, 2) as twice, nullif(n_regionkey, 0) as nonzero, n_nationkey / nullif(n_regionkey, 0) as ratio, n_nationkey = 3 or n_regionkey = 1 as either from nation""")
def scalar_instances(spark, sf):
    n, g = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf, "nation").select(
        "n_nationkey", algebra.int_times(F.lit(2), n).alias("times2"), algebra.int_times(F.lit(2), F.col("n_name"), T.StringType()).alias("twice"),
        algebra.nonzero_option(g).alias("nonzero"), algebra.divide(n.cast("double"), g.cast("double")).alias("ratio"), ((n == 3) | (g == 1)).alias("either"),
    )


@query("""select n_nationkey, n_nationkey * n_regionkey as ones, n_nationkey * 2 + n_regionkey * 5 + 10 as v from nation""")
def adjoined_unit(spark, sf):
    n, g = F.col("n_nationkey"), F.col("n_regionkey")
    p = algebra.adjoined_times(algebra.adjoined(n, F.lit(5)), algebra.adjoined(g, F.lit(2)))
    return table(spark, sf, "nation").select("n_nationkey", p["ones"].alias("ones"), p["value"].alias("v"))


@query("""select l_returnflag, ((sum(l_orderkey::hugeint * 10000000000000) % 18446744073709551616 + 27670116110564327424) % 18446744073709551616 - 9223372036854775808)::bigint as wrapped from lineitem group by 1""")
def wrapping_sum(spark, sf):
    # A row's own product can be beyond 64 bits.
    agg = A.wrapping_sum(F.col("l_orderkey").cast("decimal(20,0)") * F.lit(10000000000000).cast("decimal(14,0)"))
    return spec.aggregate(table(spark, sf, "lineitem"), {"wrapped": agg}, ["l_returnflag"])


@query("""select event_id, round(value - (select avg(value) from events), 6) as centred from events""")
def combined_with_total(spark, sf):
    out = algebra.combined_with(table(spark, sf, "events"), {"mean": A.average("value")}, lambda m: r(F.col("value") - m), "centred")
    return out.select("event_id", "centred")


@query("""select count(*) as n, min(l_quantity) as low, max(l_quantity) as high from lineitem where l_quantity > 10 and l_quantity <= 20""")
def interval_filter(spark, sf):
    i = intervals.left_open_right_closed(10.0, 30.0).intersect(intervals.closed(5.0, 20.0))
    rows = table(spark, sf, "lineitem").where(i.contains(F.col("l_quantity")))
    return rows.agg(F.count("*").alias("n"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


@query("""select l_returnflag, max(l_quantity) as lower, min(l_quantity + 49.5) as upper, max(l_quantity) >= min(l_quantity + 49.5) as empty from lineitem group by 1""")
def interval_intersection(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", F.col("l_quantity").alias("lower"), (F.col("l_quantity") + 49.5).alias("upper"))
    return intervals.intersect_all(rows, "lower", "upper", ("l_returnflag",))


@query("""select l_orderkey, count(*) as n, sum(x)::bigint as total, min(x)::bigint as least, max(x)::bigint as most from (
    select l_orderkey, unnest(range(floor(l_quantity / 3)::bigint + 1, ceil(l_quantity)::bigint)) as x from lineitem) group by 1""")
def interval_enumeration(spark, sf):
    """The whole numbers of an open interval of each row."""
    inside = intervals.whole_numbers(F.col("l_quantity") / 3, F.col("l_quantity"), lower_closed=False)
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.explode(inside).alias("x"))
    return rows.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum("x").alias("total"), F.min("x").alias("least"), F.max("x").alias("most"))


PAIRS = """(select a.vec_id as a, b.vec_id as b, list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(p[1]::double - p[2]::double)) as d
    from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"""


@query(f"""select a, b, round(list_sum(d), 5) as l1, round(sqrt(list_sum(list_transform(d, lambda x: x * x))), 5) as l2, round(power(list_sum(list_transform(d, lambda x: x * x * x)), 1.0 / 3), 5) as l3 from {PAIRS}""")
def metric_l1_l2(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    both = e.select(F.col("vec_id").alias("a"), (F.col("vec_id") + 1).alias("b"), F.col("v").alias("va")).join(e.select(F.col("vec_id").alias("b"), F.col("v").alias("vb")), "b")
    a, b = F.col("va"), F.col("vb")
    return both.select("a", "b", r(vectors.l1(a, b), 5).alias("l1"), r(vectors.l2(a, b), 5).alias("l2"), r(vectors.minkowski(a, b, 3), 5).alias("l3"))


@query("""select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: (2 * x::double) * (2 * x::double)))), 5) as norm, len(embedding) as n from embeddings""")
def vector_space(spark, sf):
    v = vectors.scale(F.col("embedding").cast("array<double>"), 2.0)
    back = vectors.from_map(vectors.to_map(v), 64)
    return table(spark, sf, "embeddings").select("vec_id", r(vectors.norm(back), 5).alias("norm"), F.size(back).cast("long").alias("n"))


@query("""select l_linenumber as row, l_suppkey % 10 as col, round(sum(l_quantity), 4) as v from lineitem group by 1, 2""")
def sparse_matrix_sum(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("row"), (F.col("l_suppkey") % 10).alias("col"), F.col("l_quantity").alias("v"))
    return vectors.sparse_sum(rows, ["row", "col"], "v").withColumn("v", r("v", 4))


@query("""select n_nationkey, round(abs(n_nationkey - 3) + abs(0 - 2) + abs(n_regionkey::double), 6) as l1 from nation""")
def metric_map(spark, sf):
    n, g = F.col("n_nationkey"), F.col("n_regionkey")
    a = F.create_map(F.lit("x"), n.cast("double"), F.lit("z"), g.cast("double"))
    b = F.create_map(F.lit("x"), F.lit(3.0), F.lit("y"), F.lit(2.0))
    return table(spark, sf, "nation").select("n_nationkey", r(vectors.minkowski_map(a, b, 1)).alias("l1"))
