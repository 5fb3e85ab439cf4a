"""Queries of keyed algebra: map sums, joins, cubes, differences, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from mergeloom.functions import keyed_maps
from mergeloom.operators import aggregators as A
from mergeloom.operators import keyed as K
from mergeloom.plans.catalog import query
from mergeloom.sources import tables
from mergeloom.sources.tables import table
from mergeloom.streaming import summers, timed

SIGNED = "case when l_linenumber % 2 = 0 then 1 else -1 end"


def r(c, digits: int = 4):
    return F.round(c, digits)


def _signed(spark, sf):
    """Whole numbers of either sign whose sums are sometimes zero."""
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", F.expr(SIGNED).cast("long").alias("v"))


@query(f"""select l_suppkey, l_returnflag, l_linestatus, sum(v)::bigint as v from (select *, {SIGNED} as v from lineitem) group by 1, 2, 3 having sum(v) <> 0""")
def sum_by_key_dropzero(spark, sf):
    return K.sum_by_key(_signed(spark, sf), ["l_suppkey", "l_returnflag", "l_linestatus"], "v")


@query(f"""select l_suppkey, l_returnflag, l_linestatus, sum(v)::bigint as v from (select *, {SIGNED} as v from lineitem) group by 1, 2, 3""")
def sum_by_key_keepzero(spark, sf):
    return K.sum_by_key(_signed(spark, sf), ["l_suppkey", "l_returnflag", "l_linestatus"], "v", keep_zeros=True)


@query("""select o_custkey, array_to_string(list(o_orderkey order by o_orderdate, o_orderkey), ',') as vals from orders group by 1""")
def group_values(spark, sf):
    out = K.group(table(spark, sf, "orders"), ["o_custkey"], "o_orderkey", ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", F.array_join("values", ",").alias("vals"))


@query("""select l_suppkey, array_to_string(list_sort(list(distinct l_partkey)), ',') as parts from lineitem group by 1""")
def to_graph(spark, sf):
    return K.to_graph(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey").select("l_suppkey", F.array_join("targets", ",").alias("parts"))


@query("""select coalesce(a.k, b.k) as k, a.v, b.w from (select o_custkey as k, count(*) as v from orders where o_totalprice > 150000 group by 1) a
    full outer join (select c_custkey as k, c_acctbal as w from customer where c_acctbal > 0) b on a.k = b.k""")
def map_join_outer(spark, sf):
    left = table(spark, sf, "orders").where("o_totalprice > 150000").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    right = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("w"))
    return K.outer_join(left, right, ["k"]).select("k", "v", "w")


def _two_maps(spark, sf):
    e = table(spark, sf, "events")
    left = e.where("event_type = 'click'").groupBy("user_id").agg(F.count("*").alias("v"))
    right = e.where("event_type = 'purchase'").groupBy("user_id").agg((F.count("*") - 13).alias("v"))
    return left, right


TWO = """(select user_id, count(*) as v from events where event_type = 'click' group by 1) a
    join (select user_id, count(*) - 13 as v from events where event_type = 'purchase' group by 1) b using (user_id)"""


@query(f"select user_id, a.v * b.v as v from {TWO} where a.v * b.v <> 0")
def map_times(spark, sf):
    return K.times(*_two_maps(spark, sf), ["user_id"], "v")


@query(f"select sum(a.v * b.v)::bigint as dot from {TWO}")
def map_dot(spark, sf):
    return K.dot(*_two_maps(spark, sf), ["user_id"], "v")


@query(f"""select user_id, sum(v)::bigint as v from (select user_id, count(*) as v from events where event_type = 'click' group by 1
    union all select user_id, count(*) - 13 from events where event_type = 'purchase' group by 1) group by 1 having sum(v) <> 0""")
def map_plus(spark, sf):
    return K.plus(*_two_maps(spark, sf), key=["user_id"], value="v")


@query(f"""select user_id, sum(v)::bigint as v from (select user_id, count(*) as v from events where event_type = 'click' group by 1
    union all select user_id, 13 - count(*) from events where event_type = 'purchase' group by 1) group by 1 having sum(v) <> 0""")
def map_minus(spark, sf):
    return K.minus(*_two_maps(spark, sf), ["user_id"], "v")


@query("""select n_nationkey, round(sum(v), 2) as v from (select c_nationkey as n_nationkey, coalesce(c_acctbal, 0) as v from orders left join (select * from customer where c_acctbal > 1000) on o_custkey = c_custkey where c_nationkey is not null)
    group by 1 having sum(v) <> 0""")
def merge_lookup(spark, sf):
    customers = table(spark, sf, "customer")
    keys = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).join(customers.select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    rich = customers.where("c_acctbal > 1000").select("c_custkey", F.col("c_acctbal").alias("v"))
    return K.merge_lookup(keys, rich, "c_custkey", "v", {"n_nationkey": F.col("nation")}, 0.0).select("n_nationkey", r("v", 2).alias("v"))


CLICKS = "(select user_id, count(*) as v from events where event_type = 'click' group by 1)"
PURCHASES = "(select user_id, count(*) - 13 as v from events where event_type = 'purchase' group by 1)"


def _within(inner: str, outer: str) -> str:
    return f"not exists (select * from {inner} x where not exists (select * from {outer} y where y.user_id is not distinct from x.user_id and y.v = x.v))"


@query(f"""select {_within(CLICKS, CLICKS)} as self_contained, {_within(CLICKS, PURCHASES)} as other_contained,
    not exists (select user_id from (select * from {CLICKS} union all select user_id, -v from {CLICKS}) group by user_id having sum(v) <> 0) as equal""")
def map_containment(spark, sf):
    left, right = _two_maps(spark, sf)
    same = K.right_contains_left(left, left, ["user_id"], "v").withColumnRenamed("contained", "self_contained")
    other = K.right_contains_left(left, right, ["user_id"], "v").withColumnRenamed("contained", "other_contained")
    return same.join(F.broadcast(other)).join(F.broadcast(K.sparse_equiv(left, left, ["user_id"], "v")))


def _flags(where: str) -> str:
    return f"(select l_orderkey as k, coalesce(nullif(l_returnflag, 'R'), '') as flag, count(*) - 1 as v from lineitem where {where} group by 1, 2)"


@query(f"""select k as l_orderkey, bool_and(a.v is null or a.v is not distinct from b.v) as contained, bool_and(coalesce(a.v, 0) = coalesce(b.v, 0)) as equal
    from {_flags("l_quantity > 5")} a full join {_flags("l_discount > 0.01")} b using (k, flag) group by 1""")
def map_comparison(spark, sf):
    """For each order two maps from flags, one of them null, to numbers of lines, some of them 0."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("R")).alias("flag"), "l_quantity", "l_discount")
    lines = lines.repartition(K.parts(spark), "l_orderkey", "flag")
    left, right = (lines.where(w).groupBy("l_orderkey", "flag").agg((F.count("*") - 1).alias("v")) for w in ("l_quantity > 5", "l_discount > 0.01"))
    return K.compared_maps(left, right, ["l_orderkey"], ["flag"], "v")


@query("""select c_mktsegment, array_to_string(list_sort(list(distinct c_nationkey)), ',') as keys from customer group by 1""")
def invert(spark, sf):
    return K.invert(table(spark, sf, "customer"), "c_nationkey", "c_mktsegment").select("c_mktsegment", F.array_join("keys", ",").alias("keys"))


@query("""with s as (select n_nationkey, case when n_nationkey % 5 = 0 then []::int[] else [n_regionkey, n_nationkey % 3] end as vs from nation),
        e as (select n_nationkey, unnest(vs) as value from s union all select n_nationkey, null from s where len(vs) = 0)
    select value, array_to_string(list_sort(list(distinct n_nationkey)), ',') as keys from e group by 1""")
def invert_exact(spark, sf):
    vs = F.when(F.col("n_nationkey") % 5 == 0, F.array().cast("array<int>")).otherwise(F.array("n_regionkey", F.col("n_nationkey") % 3))
    out = K.invert_exact(table(spark, sf, "nation").withColumn("vs", vs), "n_nationkey", "vs")
    return out.select("value", F.array_join("keys", ",").alias("keys"))


KEYS = ["l_returnflag", "l_linestatus", "l_linenumber"]


@query("""select l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) as level, round(sum(l_quantity), 4) as qty
    from lineitem group by cube (l_returnflag, l_linestatus, l_linenumber) having sum(l_quantity) <> 0""")
def cube_sum(spark, sf):
    return K.cube_or_rollup_sum(table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "qty"), KEYS, "qty", "cube").withColumn("qty", r("qty"))


@query("""select l_returnflag, l_linestatus, l_linenumber, grouping(l_returnflag) * 4 + grouping(l_linestatus) * 2 + grouping(l_linenumber) as level, round(sum(l_quantity), 4) as qty
    from lineitem group by rollup (l_returnflag, l_linestatus, l_linenumber) having sum(l_quantity) <> 0""")
def rollup_sum(spark, sf):
    return K.cube_or_rollup_sum(table(spark, sf, "lineitem").withColumnRenamed("l_quantity", "qty"), KEYS, "qty", "rollup").withColumn("qty", r("qty"))


AGG = "count(*) filter (l_discount > 0.09 and l_quantity > 49) as n"


@query(f"""select l_returnflag, l_linenumber, grouping(l_returnflag) * 2 + grouping(l_linenumber) as level, {AGG}
    from lineitem group by cube (l_returnflag, l_linenumber) having count(*) filter (l_discount > 0.09 and l_quantity > 49) > 0""")
def cube_aggregate(spark, sf):
    aggs = {"n": A.count((F.col("l_discount") > 0.09) & (F.col("l_quantity") > 49))}
    return K.cube_or_rollup_aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"], aggs, "cube")


@query("""select l_returnflag, l_linestatus, grouping(l_returnflag) * 2 + grouping(l_linestatus) as level, count(*) as n, round(avg(l_discount), 9) as mean
    from lineitem group by rollup (l_returnflag, l_linestatus)""")
def rollup_aggregate(spark, sf):
    aggs = {"n": A.size(), "mean": A.average("l_discount")}
    return K.cube_or_rollup_aggregate(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], aggs, "rollup").withColumn("mean", r("mean", 9))


@query("""select n_regionkey, grouping(n_regionkey)::int as level, array_to_string(list(n_name order by n_nationkey), ',') as names from nation group by cube (n_regionkey)""")
def cube_values(spark, sf):
    out = K.cube_or_rollup_values(table(spark, sf, "nation"), ["n_regionkey"], "n_name", ["n_nationkey"], "cube")
    return out.select("n_regionkey", F.col("level").cast("int").alias("level"), F.array_join("values", ",").alias("names"))


@query("""select l_returnflag, bit_xor((l_quantity > 25)::int) = 1 as odd from lineitem group by 1""")
def bool_xor(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(A.bool_xor(F.col("l_quantity") > 25).column().alias("odd"))


@query("""select op, count(*) as n, min(doc_id) as low, max(doc_id) as high from (
    select doc_id, 'add' as op from labels where doc_id not in (select doc_id from documents where lang = 'en')
    union all select doc_id, 'remove' from documents where lang = 'en' and doc_id not in (select doc_id from labels)) group by 1""")
def set_diff(spark, sf):
    old, new = table(spark, sf, "documents").where("lang = 'en'"), table(spark, sf, "labels")
    diff = K.set_diff_of(old, new, ["doc_id"])
    applied = K.set_diff_strict(old, diff, ["doc_id"])
    return diff.join(applied.withColumn("_in", F.lit(True)), "doc_id", "left").groupBy("op").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))


@query("""select user_id, arg_max(event_type, (ts, event_id)) as op from events where event_type in ('signup', 'error') group by 1""")
def set_diff_merge(spark, sf):
    changes = table(spark, sf, "events").where("event_type in ('signup', 'error')").withColumnRenamed("event_type", "op")
    return K.set_diff_merge(changes, ["user_id"], ["ts", "event_id"])


@query("""with l as (select user_id, max((ts, event_id)) as r from events where event_type = 'error' group by 1)
    select e.user_id, round(sum(value), 4) as value from events e left join l using (user_id) where r is null or (ts, event_id) >= r group by 1""")
def reset_state(spark, sf):
    out = K.reset_sum(table(spark, sf, "events"), "value", F.col("event_type") == "error", ["ts", "event_id"], ["user_id"])
    return out.withColumn("value", r("value"))


EDGES = "select l_suppkey as source, l_partkey % 100 + 1 as target, min(l_extendedprice) as weight from lineitem group by 1, 2"


@query(f"""with e as ({EDGES}), d as (select 1 as node, 0.0::double as cost)
    select node, round(min(cost), 4) as cost from (select node, cost from d union all select target, cost + weight from d join e on node = source) group by 1""")
def min_plus_step(spark, sf):
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100 + 1).alias("target")).agg(F.min("l_extendedprice").alias("weight"))
    start = spark.sql("select 1L as node, 0D as cost")
    return K.min_plus_step(start, e).withColumn("cost", r("cost"))


def _closure_sql(rounds: int) -> str:
    steps = ["d0 as (select 1 as node, 0.0::double as cost)"]
    steps += [f"d{i + 1} as (select node, min(cost) as cost from (select * from d{i} union all select target, cost + weight from d{i} join e on node = source) group by 1)" for i in range(rounds)]
    return f"with e as (select source, min(target) as target, weight from (select source, target % 97 + 1 as target, weight from ({EDGES})) group by source, weight), {', '.join(steps)} select node, round(cost, 3) as cost from d{rounds}"


@query(_closure_sql(24))
def min_plus_closure(spark, sf):
    """Cheapest ways from supplier 1 over all suppliers' and parts' edges."""
    e = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("source"), (F.col("l_partkey") % 100 + 1).alias("target")).agg(F.min("l_extendedprice").alias("weight"))
    e = tables.cut(e.groupBy("source", "weight").agg(F.min(F.col("target") % 97 + 1).alias("target")))
    return K.min_plus_closure(spark.sql("select 1L as node, 0D as cost"), e, 64).withColumn("cost", r("cost", 3))


@query("""select user_id, sum(n)::bigint as total, max(n) filter (event_type = 'click') as clicks, count(*) as kinds from (select user_id, event_type, count(*) as n from events group by 1, 2) group by 1""")
def map_columns(spark, sf):
    """Counts as MAP columns, added up and looked into."""
    n = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    doubled = m.withColumn("m", keyed_maps.plus(keyed_maps.plus(F.col("m"), F.col("m")), keyed_maps.negate(F.col("m"))))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b)
    return doubled.select("user_id", total.alias("total"), F.try_element_at("m", F.lit("click")).alias("clicks"), F.size("m").cast("long").alias("kinds"))


@query("""select event_type, count(*) as n, round(sum(value), 4) as value from events group by 1""")
def streaming_sum_by_key(spark, sf):
    """The events table as a stream, flushed by micro-batch, buffers merged."""
    top = tables.shared_folder(spark, "stream")
    aggs = {"n": A.size(), "value": A.numeric_sum("value")}
    summers.buffered(tables.stream(spark, sf, "events"), aggs, ["event_type"], f"{top}/buffers", f"{top}/progress").awaitTermination()
    return summers.totals(spark, aggs, ["event_type"], f"{top}/buffers").withColumn("value", r("value"))


@query("""select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as value from events group by 1, 2""")
def streaming_windows(spark, sf):
    """Counts and sums by hour of event time from the stream, all hours kept."""
    top, events = tables.shared_folder(spark, "stream"), tables.stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    counted = summers.windowed(events, "ts", "2 hours", "1 hour", {"n": A.size(), "value": A.numeric_sum("value")}, ["event_type"])

    def keep(batch, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/windows/batch={number}")

    counted.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{top}/windows")
    last = found.agg(F.max("batch").alias("_last"))
    rows = found.join(F.broadcast(last), F.col("batch") == F.col("_last"))
    return rows.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", r("value", 4).alias("value"))


@query("""with e as (select user_id, ts, value, case when ts >= lag(ts) over w + interval 6 hour or lag(ts) over w is null then 1 else 0 end as first from events window w as (partition by user_id order by ts)),
        s as (select user_id, ts, value, sum(first) over (partition by user_id order by ts) as k from e)
    select user_id, min(ts) as start, count(*) as n, round(sum(value), 4) as value from s group by user_id, k having max(ts) + interval 6 hour <= (select max(ts) from events)""")
def streaming_sessions(spark, sf):
    """Sessions that end after six hours without an event, each written once
    when the watermark has passed it; those still open stay in the state."""
    top, events = tables.shared_folder(spark, "stream"), tables.stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    closed = summers.sessions(events, "ts", "0 seconds", "6 hours", {"n": A.size(), "value": A.numeric_sum("value")}, ["user_id"])
    out = closed.select("user_id", F.col("session_window.start").alias("start"), "n", "value").writeStream.outputMode("append").format("parquet")
    out.option("path", f"{top}/sessions").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema("user_id long, start timestamp, n long, value double").parquet(f"{top}/sessions")
    return rows.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", r("value", 4).alias("value"))


@query("""with e as (select *, time_bucket(interval 6 hour, ts) + interval 6 hour as stop from events), f as (select max(ts) - interval 1 day as mark from e where event_id % 2 = 0), l as (select max(ts) - interval 1 day as mark from e)
    select event_type, stop, count(*) as n, sum(event_id)::bigint as ids from e, f, l where stop <= l.mark and (event_id % 2 = 0 or stop > f.mark) group by 1, 2""")
def streaming_late_rows(spark, sf):
    """Even events come first, odd ones a micro-batch later: of these only those
    count whose window the watermark has not closed yet."""
    top = tables.shared_folder(spark, "stream")
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", "event_type")
    aggs = {"n": A.size(), "ids": A.sum_of("event_id")}
    for odd in (0, 1):  # the same query, started again when the rest has come
        rows.where(F.col("event_id") % 2 == odd).write.mode("append").parquet(f"{top}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{top}/in")
        counted = summers.windowed(stream, "ts", "1 day", "6 hours", aggs, ["event_type"])
        out = counted.select("event_type", F.col("window.end").alias("stop"), "n", "ids").writeStream.outputMode("append").format("parquet")
        out.option("path", f"{top}/windows").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.parquet(f"{top}/windows")
    return found.select("event_type", F.col("stop").cast("timestamp_ntz").alias("stop"), "n", "ids")


@query("""select user_id % 20 as k, sum(event_id)::bigint as event_id from events group by 1""")
def streaming_timed_sums(spark, sf):
    """The events as a stream through buffers that flush by size and time."""
    top = tables.shared_folder(spark, "stream")
    events = tables.stream(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), "event_id")
    sums = timed.timed_sums(events, "k", "event_id", 2000, 500, parts=8, share=0.05)
    timed.drain(timed.start(sums, f"{top}/sums", f"{top}/progress"))
    return spark.read.parquet(f"{top}/sums").groupBy("k").agg(F.sum("event_id").alias("event_id"))


@query("""select user_id, sum(event_id)::bigint as event_id from events group by 1""")
def summing_queue(spark, sf):
    partial = summers.summing_queue(table(spark, sf, "events"), ["user_id"], "event_id", 64, "user_id long, event_id long")
    return K.sum_by_key(partial, ["user_id"], "event_id", keep_zeros=True)


@query("""select event_type, sum(event_id)::bigint as event_id from events group by 1""")
def salted_sum_by_key(spark, sf):
    return summers.salted_sum_by_key(table(spark, sf, "events"), ["event_type"], "event_id")


@query("""select hot, count(*) as n, sum(event_id)::bigint as ids from (select event_id, count(*) over (partition by user_id) >= 0.0075 * (select count(*) from events) as hot from events) group by 1""")
def hot_key_routing(spark, sf):
    e = table(spark, sf, "events")
    routed = summers.route(e, "user_id", summers.hot_keys(e, "user_id", 0.0075, 4, 4000))
    return routed.groupBy("hot").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


@query("""select count(*) as n from (select event_id from events union all select o_orderkey from orders)""")
def union_all(spark, sf):
    both = tables.union_all(table(spark, sf, "events").select(F.col("event_id").alias("id")), table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")))
    return both.agg(F.count("*").alias("n"))
