"""Queries of sketches. SQL says the same with the same md5 hashes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from mergeloom.functions import hashing
from mergeloom.operators import aggregators as A
from mergeloom.operators import ordered
from mergeloom.operators.sketches import bloom, cms, exphist, hll, minhash, qtree, states
from mergeloom.plans.catalog import query
from mergeloom.sources import tables
from mergeloom.sources.tables import seconds, table


def r(c, digits: int = 6):
    return F.round(c, digits)


def h(seed: object, x: str, i: int = 0) -> str:
    return f"('0x' || substr(md5('{seed}:' || {x}), {8 * i + 1}, 8))::bigint"


def rho(seed: object, x: str) -> str:
    v = h(seed, x, 1)
    return f"case when {v} = 0 then 33 else 33 - length(bin({v})) end"


def registers_sql(x: str, t: str, bits: int, by: str = "", j: str = "", extra: str = "", where: str = "true") -> str:
    keys = f"{by}, " if by else ""
    return f"select {keys}{h(hll.SEED, x)} % {2**bits} as j, max({rho(hll.SEED, x)}) as rho from {t} where {where} group by {keys}j"


def estimate_sql(rel: str, bits: int, by: str = "") -> str:
    m = 2**bits
    keys, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    raw = f"{hll.alpha(bits) * m * m!r} / (z + {m} - n)"
    return f"""select {keys}case when {raw} <= {2.5 * m} and {m} > n then {m} * ln({m}::double / ({m} - n)) else {raw} end as estimate
        from (select {keys}coalesce(sum(power(2.0, -rho)), 0)::double as z, count(*)::double as n from ({rel}) {group})"""


B = 10


@query(f"select l_returnflag, round(estimate, 6) as estimate from ({estimate_sql(registers_sql('l_partkey', 'lineitem', B, 'l_returnflag'), B, 'l_returnflag')})")
def hll_count(spark, sf):
    s = hll.registers(table(spark, sf, "lineitem"), "l_partkey", B, ["l_returnflag"])
    return hll.estimate(s, B, ["l_returnflag"]).withColumn("estimate", r("estimate"))


@query(f"select round(estimate, 6) as estimate from ({estimate_sql(registers_sql('l_partkey', 'lineitem', B), B)})")
def hll_merge(spark, sf):
    s = hll.registers(table(spark, sf, "lineitem"), "l_partkey", B, ["l_returnflag", "l_linestatus"])
    return hll.estimate(hll.merge(s), B).withColumn("estimate", r("estimate"))


@query(f"select round(estimate, 6) as estimate from ({estimate_sql(registers_sql('l_partkey', 'lineitem', 7), 7)})")
def hll_downsize(spark, sf):
    s = hll.registers(table(spark, sf, "lineitem"), "l_partkey", B)
    return hll.estimate(hll.downsize(s, B, 7), 7).withColumn("estimate", r("estimate"))


@query(f"""select floor(greatest(0, estimate * (1 - {3 * hll.error(B)!r})))::bigint as low, floor(estimate)::bigint as est, ceil(estimate * (1 + {3 * hll.error(B)!r}))::bigint as high
    from ({estimate_sql(registers_sql('l_suppkey', 'lineitem', B), B)})""")
def hll_approximate_size(spark, sf):
    out = hll.approximate_size(hll.registers(table(spark, sf, "lineitem"), "l_suppkey", B), B)
    return out.select(F.col("size.min").alias("low"), F.col("size.estimate").alias("est"), F.col("size.max").alias("high"))


def _flag(f: str) -> str:
    return estimate_sql(registers_sql("l_partkey", "lineitem", B, where=f), B)


@query(f"""select round(greatest(0, (select estimate from ({_flag("l_returnflag = 'A'")})) + (select estimate from ({_flag("l_returnflag = 'R'")}))
    - (select estimate from ({_flag("l_returnflag in ('A', 'R')")}))), 5) as estimate""")
def hll_intersection(spark, sf):
    rows = table(spark, sf, "lineitem")
    a, b = (hll.registers(rows.where(F.col("l_returnflag") == f), "l_partkey", B) for f in "AR")
    return hll.intersection([a, b], B).withColumn("estimate", r("estimate", 5))


@query(f"""select o_custkey, case when any_value(n) <= 10 then any_value(n) else floor(any_value(estimate)) end::bigint as size from
    (select o_custkey, count(distinct o_orderkey) as n from orders group by 1) join ({estimate_sql(registers_sql('o_orderkey', 'orders', B, 'o_custkey'), B, 'o_custkey')}) using (o_custkey) group by 1""")
def set_size(spark, sf):
    return hll.set_size(table(spark, sf, "orders"), "o_orderkey", B, 10, ["o_custkey"])


@query(f"""select n, l_returnflag, size from (select l_returnflag, floor(estimate)::bigint as size, 'parts' as n from ({estimate_sql(registers_sql('l_partkey', 'lineitem', 13, 'l_returnflag'), 13, 'l_returnflag')})
    union all select l_returnflag, count(distinct l_linenumber), 'lines' from lineitem group by 1)""")
def approximate_unique_count(spark, sf):
    rows = table(spark, sf, "lineitem")
    big = hll.approximate_unique_count(rows, "l_partkey", ["l_returnflag"]).withColumn("n", F.lit("parts"))
    return big.unionByName(hll.approximate_unique_count(rows, "l_linenumber", ["l_returnflag"]).withColumn("n", F.lit("lines")))


@query(f"""select event_type, round(estimate, 6) as estimate from ({estimate_sql(registers_sql('user_id', 'events', B, 'event_type', where="ts >= timestamp '2024-01-15'"), B, 'event_type')})""")
def hll_series_since(spark, sf):
    s = hll.series(table(spark, sf, "events"), "user_id", "ts", B, ["event_type"])
    recent = hll.since(s, F.lit("2024-01-15").cast("timestamp_ntz"), ["event_type"])
    return hll.estimate(recent, B, ["event_type"]).withColumn("estimate", r("estimate"))


# Count-min ------------------------------------------------------------------

D, W = cms.depth_for(0.01), cms.width_for(0.02)


def cells_sql(x: str, t: str, n: str = "count(*)", d: int = D, w: int = W, key: str = "x::bigint") -> str:
    """The cells of the linear family; ``key`` is the item's 64-bit number."""
    return f"""select row, {hashing.linear_sql(key, "row", d, w, cms.SEED)} as col, sum(n) as n, x
        from (select {x} as x, {n} as n from {t} where {x} is not null group by 1), range({d}) t(row) group by row, col, x"""


TEXT_KEY = "('0x' || substr(md5(x), 1, 15))::bigint"


def frequency_sql(x: str, t: str, n: str = "count(*)", d: int = D, w: int = W, key: str = "x::bigint") -> str:
    return f"""select x, min(s) as estimate from (select x, sum(n) over (partition by row, col) as s from ({cells_sql(x, t, n, d, w, key)})) group by x"""


@query(f"select x as l_partkey, estimate::bigint as estimate from ({frequency_sql('l_partkey', 'lineitem')})")
def cms_frequency(spark, sf):
    rows = table(spark, sf, "lineitem")
    return cms.frequency(cms.sketch(rows, "l_partkey", D, W), rows.select("l_partkey"), "l_partkey", D, W)


@query(f"""select x as event_type, estimate::bigint as estimate, greatest(0, trunc(estimate - {math.e / W!r} * n))::bigint as low from ({frequency_sql('event_type', 'events', key=TEXT_KEY)}), (select count(*) as n from events)""")
def cms_bounds(spark, sf):
    rows = table(spark, sf, "events")
    cells = cms.sketch(rows, "event_type", D, W)
    out = cms.with_bounds(cms.frequency(cells, rows, "event_type", D, W), cms.total(cells), W, D)
    return out.select("event_type", "estimate", F.col("low").cast("long").alias("low"))


def _pairs(a: str, b: str) -> str:
    cells = lambda t: f"select row, col, sum(n) as n from ({cells_sql('l_partkey', t)}) group by 1, 2"
    return f"select min(p)::bigint as estimate from (select a.row, sum(a.n * b.n) as p from ({cells(a)}) a join ({cells(b)}) b on a.row = b.row and a.col = b.col group by 1)"


@query(_pairs("(select * from lineitem where l_returnflag = 'A')", "(select * from lineitem where l_returnflag = 'R')"))
def cms_inner_product(spark, sf):
    rows = table(spark, sf, "lineitem")
    a, b = (cms.sketch(rows.where(F.col("l_returnflag") == f), "l_partkey", D, W) for f in "AR")
    return cms.inner_product(a, b, D)


@query(f"select x as user_id, estimate::bigint as estimate from ({frequency_sql('user_id', 'events')}) where estimate >= 0.01 * (select count(*) from events)")
def top_pct_cms(spark, sf):
    return cms.top_pct(table(spark, sf, "events"), "user_id", D, W, 0.01)


@query(f"select x as user_id, estimate::bigint as estimate from ({frequency_sql('user_id', 'events')}) order by estimate desc, x limit 10")
def top_n_cms(spark, sf):
    return cms.top_n(table(spark, sf, "events"), "user_id", D, W, 10)


@query(f"""with c as (select event_type, user_id, row, n, {hashing.linear_sql("user_id::bigint", "row", D, W, cms.SEED)} as col
        from (select event_type, user_id, count(*) as n from events group by 1, 2), range({D}) t(row)),
    f as (select event_type, user_id, min(s)::bigint as estimate from (select *, sum(n) over (partition by event_type, row, col) as s from c) group by 1, 2)
    select event_type, user_id, estimate from f qualify row_number() over (partition by event_type order by estimate desc, user_id) <= 3""")
def scoped_top_n_cms(spark, sf):
    return cms.top_n(table(spark, sf, "events"), "user_id", D, W, 3, ["event_type"])


@query(f"select x as user_id, estimate::bigint as estimate from ({frequency_sql('user_id', 'events', 'sum(event_id)')}) order by estimate desc, x limit 10")
def sketch_map(spark, sf):
    return cms.heavy_hitters(table(spark, sf, "events"), "user_id", F.col("event_id"), D, W, 10)


@query(f"""with k as (select user_id as x, max(event_id) as v from events group by 1),
        c as (select x, v, row, {hashing.linear_sql("x::bigint", "row", D, W, cms.SEED)} as col from k, range({D}) t(row)),
        f as (select x, min(m)::bigint as estimate from (select x, max(v) over (partition by row, col) as m from c) group by x)
    select x as user_id, estimate from f order by estimate desc, x limit 10""")
def sketch_map_max(spark, sf):
    """The users of the largest event numbers, by cells that hold maxima."""
    return cms.map_hitters(table(spark, sf, "events"), "user_id", A.max_of("event_id"), F.col("event_id"), D, W, 10)


# Binary states ----------------------------------------------------------------


@query(f"select round(estimate, 6) as estimate from ({estimate_sql(registers_sql('l_partkey', 'lineitem', B), B)})")
def hll_binary_merge(spark, sf):
    """States of many groups stored as binary values, merged, and read again."""
    path = tables.shared_folder(spark, "states")
    states.sets(table(spark, sf, "lineitem"), "l_partkey", B, 20, ["l_returnflag", "l_linestatus", "l_linenumber"]).write.parquet(path)
    merged = states.merge_sets(spark.read.parquet(path))
    return hll.estimate(states.registers(merged), B).withColumn("estimate", r("estimate"))


@query(f"""select o_custkey, case when any_value(n) <= 10 then any_value(n)::double else any_value(estimate) end::bigint as size, any_value(n) <= 10 as exact from
    (select o_custkey, count(distinct o_orderkey) as n from orders group by 1) join ({estimate_sql(registers_sql('o_orderkey', 'orders', B, 'o_custkey'), B, 'o_custkey')}) using (o_custkey) group by 1""")
def hybrid_set_size(spark, sf):
    return states.set_sizes(states.sets(table(spark, sf, "orders"), "o_orderkey", B, 10, ["o_custkey"]), ["o_custkey"]).withColumn("size", F.round("size").cast("long"))


@query(f"""with g as (select *, case when event_type in ('click', 'error') then event_id % 5 else user_id end as x from events),
    c as (select event_type, x, row, n, {hashing.linear_sql("x::bigint", "row", D, W, cms.SEED)} as col from (select event_type, x, count(*) as n from g group by 1, 2), range({D}) t(row)),
    f as (select event_type, x, min(s)::bigint as estimate from (select *, sum(n) over (partition by event_type, row, col) as s from c) group by 1, 2),
    k as (select event_type, count(distinct x) <= 20 as exact from g group by 1), e as (select event_type, x, count(*) as n from g group by 1, 2)
    select f.event_type, f.x, case when exact then n else estimate end as estimate, exact from f join k using (event_type) join e on e.event_type = f.event_type and e.x = f.x""")
def hybrid_counts(spark, sf):
    """Exact counts where a type has few items, count-min estimates elsewhere."""
    few = F.col("event_type").isin("click", "error")
    rows = table(spark, sf, "events").withColumn("x", F.when(few, F.col("event_id") % 5).otherwise(F.col("user_id")).cast("long"))
    return states.frequency(states.counts(rows, "x", D, W, 20, ["event_type"]), rows, "x", D, W, ["event_type"])


DECAY = "sum(exp(-(m - epoch_us(ts) / 1e6) * ln(2) / 86400.0))"


@query(f"select x as user_id, round(estimate, 5) as estimate from ({frequency_sql('user_id', '(select *, max(epoch_us(ts) / 1e6) over () as m from events)', DECAY)})")
def decaying_cms(spark, sf):
    rows = table(spark, sf, "events").select("user_id", seconds("ts").alias("t"))
    cells, _ = cms.decaying(rows, "user_id", "t", 86400.0, D, W)
    return cms.frequency(cells, rows, "user_id", D, W).withColumn("estimate", r("estimate", 5))


# Bloom ------------------------------------------------------------------------

N, FPP = 400, 0.05
WIDTH = bloom.optimal_width(N, FPP)
HASHES = bloom.optimal_hashes(N, WIDTH)
BITS = ", ".join(h(k // 4, "x", k % 4) + f" % {WIDTH}" for k in range(HASHES))
RICH = "select distinct o_custkey as x from orders where o_totalprice > 250000"
FILTER = f"select distinct unnest([{BITS}]) as bit from ({RICH})"


def _rich(spark, sf):
    return bloom.create(table(spark, sf, "orders").where("o_totalprice > 250000"), "o_custkey", HASHES, WIDTH)


@query(f"""select x as c_custkey, bool_and(f.bit is not null) as maybe from (select x, unnest([{BITS}]) as bit from (select c_custkey as x from customer)) b left join ({FILTER}) f using (bit) group by 1""")
def bloom_membership(spark, sf):
    return bloom.maybe_contains(table(spark, sf, "customer"), "c_custkey", _rich(spark, sf), HASHES, WIDTH)


@query(f"""select round(ln(1 - t / {WIDTH}.0::double) / ({HASHES} * ln(1 - 1.0::double / {WIDTH})))::bigint as est, round(t / {WIDTH}.0::double, 6) as density from (select count(*)::double as t from ({FILTER}))""")
def bloom_size(spark, sf):
    bits = _rich(spark, sf)
    return bloom.size(bits, HASHES, WIDTH).select(F.col("size.estimate").alias("est")).join(F.broadcast(bloom.density(bits, WIDTH).withColumn("density", r("density"))))


RICHER = f"select distinct unnest([{BITS}]) as bit from (select distinct o_custkey as x from orders where o_totalprice > 350000)"


@query(f"select count(*) as distance from (select bit from (select bit from ({FILTER}) union all select bit from ({RICHER})) group by bit having count(*) = 1)")
def bloom_hamming(spark, sf):
    other = bloom.create(table(spark, sf, "orders").where("o_totalprice > 350000"), "o_custkey", HASHES, WIDTH)
    return bloom.hamming(_rich(spark, sf), other)


# Quantile trees ---------------------------------------------------------------


def quantile_sql(x: str, t: str, p: float, level: int, by: str) -> str:
    w = 2.0**level
    return f"""select {by}, leaf * {w!r} as lower, (leaf + 1) * {w!r} as upper from (
        select {by}, floor({x} / {w!r}) as leaf, row_number() over (partition by {by} order by {x}) - 1 as k, count(*) over (partition by {by}) as n from {t})
        where k = least(floor(n * {p!r}), n - 1)"""


@query("select event_type, round(lower, 6) as lower, round(upper, 6) as upper from (" + quantile_sql("value", "events", 0.5, -4, "event_type") + ")")
def qtree_quantile_bounds(spark, sf):
    t = qtree.leaves(table(spark, sf, "events"), "value", ["event_type"], -4)
    return qtree.quantile_bounds(t, 0.5, ["event_type"], -4).select("event_type", r("lower").alias("lower"), r("upper").alias("upper"))


@query("select l_returnflag, round(lower, 6) as percentile from (" + quantile_sql("l_quantity", "lineitem", 0.9, -16, "l_returnflag") + ")")
def approximate_percentile(spark, sf):
    return qtree.approximate_percentile(table(spark, sf, "lineitem"), "l_quantity", 0.9, ["l_returnflag"]).withColumn("percentile", r("percentile"))


@query("""select event_type, sum(n) filter (100 <= lo and 300.3 >= hi)::bigint as count_low, sum(n) filter (100 < hi and 300.3 >= lo)::bigint as count_high, round(sum(s) filter (100 <= lo and 300.3 >= hi), 4) as sum_low
    from (select event_type, floor(value) as lo, floor(value) + 1 as hi, count(*) as n, sum(value) as s from events group by 1, 2, 3) group by 1""")
def qtree_range_bounds(spark, sf):
    t = qtree.leaves(table(spark, sf, "events"), "value", ["event_type"], 0)
    return qtree.range_bounds(t, 100.0, 300.3, ["event_type"], 0).select("event_type", "count_low", "count_high", r("sum_low", 4).alias("sum_low"))


def _iqm_sql() -> str:
    q = lambda p: quantile_sql("value", "events", p, -2, "event_type")
    return f"""with q1 as ({q(0.25)}), q3 as ({q(0.75)}),
        b as (select event_type, floor(value * 4) / 4 as lo, floor(value * 4) / 4 + 0.25 as hi, count(*) as n, sum(value) as s from events group by 1, 2, 3)
    select b.event_type, round(sum(s) filter (q1.lower <= lo and q3.lower >= hi) / sum(n) filter (q1.lower < hi and q3.lower >= lo), 5) as lower,
        round(sum(s) filter (q1.upper < hi and q3.upper >= lo) / sum(n) filter (q1.upper <= lo and q3.upper >= hi), 5) as upper
    from b join q1 on b.event_type = q1.event_type join q3 on b.event_type = q3.event_type group by 1"""


@query(_iqm_sql())
def qtree_inter_quartile_mean(spark, sf):
    t = qtree.leaves(table(spark, sf, "events"), "value", ["event_type"], -2)
    return qtree.inter_quartile_mean(t, ["event_type"], -2).select("event_type", r("lower", 5).alias("lower"), r("upper", 5).alias("upper"))


@query("""select event_type, count(*) as n, round(sum(value), 3) as s from events group by 1""")
def qtree_compressed_total(spark, sf):
    t = qtree.compress(qtree.leaves(table(spark, sf, "events"), "value", ["event_type"], -4), 6, ["event_type"], -4)
    return t.groupBy("event_type").agg(F.sum("n").alias("n"), r(F.sum("s"), 3).alias("s"))


def _compressed_sql(t: str, x: str, level: int, k: int, levels: int) -> str:
    """The nodes level by level, as ``compress`` says: fewer than a 2^k-th of the
    group's values go up, as long as the group's top place has not become 0."""
    steps = [f"c0 as (select event_type, floor({x} / {2.0**level!r})::bigint as leaf, count(*) as n from {t} group by 1, 2)", f"g as (select event_type, sum(n)::bigint >> {k} as least, max(leaf) as top from c0 group by 1)"]
    for i in range(levels):
        small = f"n < least and (top >> {i}) > 0"
        steps += [f"d{i} as (select event_type, {level + i} as level, leaf, n from c{i} join g using (event_type) where not ({small}))", f"c{i + 1} as (select event_type, leaf >> 1 as leaf, sum(n)::bigint as n from c{i} join g using (event_type) where {small} group by 1, 2)"]
    return "with " + ", ".join(steps) + " " + " union all ".join(f"select event_type, level, leaf, n from d{i}" for i in range(levels))


@query(_compressed_sql("events", "value", -4, 6, 30))
def qtree_compress(spark, sf):
    t = qtree.compress(qtree.leaves(table(spark, sf, "events"), "value", ["event_type"], -4), 6, ["event_type"], -4)
    return t.select("event_type", "level", "leaf", "n")


@query("select event_type, count(*) as n, true as small, true as lower_holds, true as upper_holds from events group by 1")
def qtree_bounded(spark, sf):
    """A tree of 4 levels of branching: few nodes, and bounds that hold."""
    rows = table(spark, sf, "events").select("event_type", "value")
    nodes = qtree.bounded(rows, "value", 4, ["event_type"])
    sizes = nodes.groupBy("event_type").agg(F.sum("n").alias("n"), (F.count("*") <= qtree.most_nodes(4)).alias("small"))
    bounds = qtree.node_bounds(nodes, 0.75, ["event_type"])
    both = rows.join(F.broadcast(bounds), "event_type")  # a row an event type
    ranks = both.groupBy("event_type").agg(F.count_if(F.col("value") < F.col("lower")).alias("below"), F.count_if(F.col("value") < F.col("upper")).alias("upto"))
    rank = F.floor(F.col("n") * 0.75)
    return sizes.join(ranks, "event_type").select("event_type", "n", "small", (F.col("below") <= rank).alias("lower_holds"), (F.col("upto") > rank).alias("upper_holds"))


# MinHash ------------------------------------------------------------------------

HASHES_MH = 64


def signature_sql(where: str) -> str:
    cols = " union all ".join(f"select g, {i} as i, min({h(i // 4, 'x', i % 4)}) as h from s group by 1" for i in range(HASHES_MH))
    return f"with s as (select distinct {where}) {cols}"


@query(f"""with sig as ({signature_sql("o_orderpriority as g, o_custkey as x from orders")})
    select a.g as a, b.g as b, round(count(*) filter (a.h = b.h) / {HASHES_MH}.0::double, 6) as similarity from sig a join sig b on a.i = b.i and a.g < b.g group by 1, 2""")
def minhash_similarity(spark, sf):
    """Segments of customers by order priority, all pairs of five."""
    s = minhash.signatures(table(spark, sf, "orders"), "o_custkey", HASHES_MH, ["o_orderpriority"])
    both = s.select(F.col("o_orderpriority").alias("a"), "i", F.col("h").alias("ha")).join(s.select(F.col("o_orderpriority").alias("b"), "i", F.col("h").alias("hb")), "i").where("a < b")
    return both.groupBy("a", "b").agg(r(F.count_if(F.col("ha") == F.col("hb")) / float(HASHES_MH)).alias("similarity"))


@query(f"""with sig as ({signature_sql("user_id as g, strftime(ts, '%Y-%m-%d') as x from events")}),
    bands as (select g, i // 4 as band, string_agg(h::varchar, ',' order by i) as bucket from sig group by 1, 2),
    pairs as (select distinct x.g as a, y.g as b from bands x join bands y using (band, bucket) where x.g < y.g)
    select a, b, round(count(*) filter (x.h = y.h) / {HASHES_MH}.0::double, 6) as similarity from pairs join sig x on x.g = a join sig y on y.g = b and x.i = y.i
    group by 1, 2 having count(*) filter (x.h = y.h) >= {0.9 * HASHES_MH}""")
def minhash_lsh(spark, sf):
    """Users with similar sets of days, by banding."""
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"))
    members, links = minhash.similar_classes(minhash.signatures(rows, "day", HASHES_MH, ["user_id"]), HASHES_MH, 16, "user_id", 0.9)
    return minhash.expanded(members, links.withColumn("similarity", r("similarity")), "user_id")


@query(f"""with sig as ({signature_sql("user_id as g, strftime(ts, '%Y-%m-%d') as x from events")}),
    whole as (select g, string_agg(i || ':' || h, ',' order by i) as s from sig group by 1), members as (select g, min(g) over (partition by s) as class from whole),
    firsts as (select sig.* from sig join members using (g) where g = class),
    bands as (select g, i // 4 as band, string_agg(h::varchar, ',' order by i) as bucket from firsts group by 1, 2),
    pairs as (select distinct x.g as a, y.g as b from bands x join bands y using (band, bucket) where x.g < y.g),
    links as (select a, b from pairs join firsts x on x.g = a join firsts y on y.g = b and x.i = y.i group by 1, 2 having count(*) filter (x.h = y.h) >= {0.8 * HASHES_MH})
    select class, count(*) as members, (select count(*) from links where a = class or b = class) as links from members group by 1""")
def minhash_classes(spark, sf):
    """Users by the days that they came, in classes, with links between these."""
    rows = table(spark, sf, "events").select("user_id", F.to_date("ts").cast("string").alias("day"))
    members, ends = minhash.linked_classes(minhash.signatures(rows, "day", HASHES_MH, ["user_id"]), HASHES_MH, 16, "user_id", 0.8)
    sizes = members.groupBy("class").agg(F.count("*").alias("members"))
    return sizes.join(ends, "class", "left").select("class", "members", F.coalesce("links", F.lit(0)).alias("links"))


@query(f"""select event_type, count(*) as n, round(sum(abs(v)), 3) as mass from (select event_type, i, sum(v) as v from (
    select event_type, {h(123456, 'user_id')} % 64 as i, case when {h(123456, 'user_id', 1)} % 2 = 1 then v else -v end as v from (select event_type, user_id, sum(value) as v from events group by 1, 2)) group by 1, 2) where v <> 0 group by 1""")
def hashing_trick(spark, sf):
    t = minhash.hashing_trick(table(spark, sf, "events"), "user_id", "value", 6, ["event_type"])
    return t.groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum(F.abs("value")), 3).alias("mass"))


# Heavy hitters, sliding windows ---------------------------------------------------


@query("""select event_type as item, count(*) as n, true as guaranteed from events group by 1""")
def space_saver_exact(spark, sf):
    """Fewer kinds than counters: counts are exact."""
    return ordered.space_saver(table(spark, sf, "events"), "event_type", 16).select("item", "n", "guaranteed")


@query("""with n as (select user_id, count(*) as n from events group by 1)
    select least(60, (select count(*) from n)) as counters, 0::bigint as outside, (select count(*) from events) as counted""")
def space_saver_topk(spark, sf):
    """Fewer counters than users may need: what is certain and what is possible
    for each of those listed, against exact counts."""
    events = table(spark, sf, "events")
    saver = ordered.space_saver(events, "user_id", 60, "long")
    true = events.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("true"))
    top = ordered.saver_top_k(saver, 10).select("item", F.lit(True).alias("top"))
    both = saver.join(true, "item").join(top, "item", "left")
    wrong = ~F.col("true").between(F.col("low"), F.col("high")) | (F.col("top") & (F.col("high") < F.col("low")))
    return both.agg(F.count("*").alias("counters"), F.count_if(F.coalesce(wrong, F.lit(False))).alias("outside")).crossJoin(F.broadcast(events.agg(F.count("*").alias("counted"))))


@query("""with n as (select user_id, count(*) as n from events group by 1), t as (select sum(n) as t from n)
    select user_id as item from n, t where n > t / 40.0""")
def space_saver_frequent(spark, sf):
    """Every user with more than a fortieth of all events is among 60 counters."""
    events = table(spark, sf, "events")
    saver = ordered.most_frequent(ordered.space_saver(events, "user_id", 60, "long"), 0)
    counts = events.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
    frequent = counts.crossJoin(F.broadcast(events.agg(F.count("*").alias("t")))).where(F.col("n") > F.col("t") / 40)
    return saver.select("item").join(frequent.select("item"), "item")


@query("""select event_type, count(*) filter (ts > timestamp '2024-01-20' - interval 7 day and ts <= timestamp '2024-01-20') as total from events group by 1""")
def exp_hist_exact(spark, sf):
    rows = table(spark, sf, "events").select("event_type", seconds("ts").alias("t"), F.lit(1).alias("one"))
    now = 1705708800.0  # 2024-01-20
    return exphist.exact(rows, "one", "t", now, 7 * 86400.0, ["event_type"])


@query("""select event_id, count(*) over (partition by user_id order by s range between 86399 preceding and current row) as total from (select *, epoch_us(ts) // 1000000 as s from events)""")
def exp_hist_running(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "user_id", F.floor(seconds("ts")).alias("s"), F.lit(1).cast("long").alias("one"))
    return rows.select("event_id", exphist.running("one", "s", 86400, ["user_id"]).alias("total"))


@query("""with e as (select event_type, epoch_us(ts) // 1000000 as s from events), m as (select event_type, max(s) as time from e group by 1)
    select event_type, any_value(time)::bigint as time, count(*) filter (s > time - 3 * 86400) as true, true as held, true as near from e join m using (event_type) group by 1""")
def exp_hist_fold(spark, sf):
    """A bounded histogram of the last three days, by event type, its bounds and
    its error against the exact number."""
    rows = table(spark, sf, "events").select("event_type", F.floor(seconds("ts")).cast("long").alias("s"), F.lit(1).alias("one"))
    found = exphist.fold(rows, ["event_type"], "s", "one", 0.05, 3 * 86400, "event_type string")
    true = rows.join(found.select("event_type", "time"), "event_type").where(F.col("s") > F.col("time") - 3 * 86400).groupBy("event_type").agg(F.count("*").alias("true"))
    held = F.col("true").between(F.col("low"), F.col("high"))
    near = F.abs(F.col("guess") - F.col("true")) <= 0.05 * F.col("true")
    return found.join(true, "event_type").select("event_type", "time", "true", held.alias("held"), near.alias("near"))


@query("select 0::bigint as missed")
def bloom_truth_values(spark, sf):
    """No item that was put in is denied."""
    put = table(spark, sf, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("x"))
    found = bloom.contains(put, "x", _rich(spark, sf), HASHES, WIDTH)
    return found.agg(F.count_if(~F.col("found.is_true")).alias("missed"))
