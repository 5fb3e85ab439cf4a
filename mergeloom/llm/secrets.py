"""Secret scans with corpus-wide ownership frequency, on native expressions only.

Every text is scanned for credentials by fixed patterns (``assign``,
``access``, ``hex``, the base) and for further shapes (``token``: prefixed
tokens, signed web tokens, private key blocks). All candidates of the corpus
are then counted by value hash: in how many distinct repositories and owners
does this value stand? A value of more than ``MOST_OWNERS`` owners, or one that
is pasted into more than ``MOST_REPOS`` repositories even of few owners, is a
widely copied example; others look live. Base spans are reported whatever their
value; ``token`` spans are added only if they look live. Each row also says how
many owners and repositories its most copied value has.

Spans are code points, end exclusive. There is no native function for match
positions, so a text is split by the pattern: gaps and matches alternate, and
their running lengths are the spans. Running sums go by blocks of ``STEP``
matches, so a text of very many matches costs about its own length.

The scan is one pass without a shuffle; its rows, without the texts, are
written once. Counts pre-aggregate by (hash, owner, repository), then by
(hash, owner), then by hash, so a value that stands everywhere is no hot task;
the join back by hash carries candidates only and may be split by adaptive
execution.

Spans that begin alike come in the order of their kinds; a value of just the most
owners or repositories is still live. Null texts count as empty. Null owners are one owner, null repositories one of
its repositories. Very long texts are scanned whole. Repeated rows are scanned
alike and are one repository. Other columns, whatever their names, are not read,
and stay where rows are kept. An empty table gives no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mergeloom.llm.common import flattened, materialize, pick

MOST_OWNERS, MOST_REPOS = 2, 100
STEP = 128
KINDS = ("assign", "access", "hex", "token")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16


def either_case(words: str) -> str:
    """A pattern with each lower-case letter in either case."""
    return re.sub(r"[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


KEYS = either_case("password|passwd|secret|token|api_?key")
PATTERNS = {
    "assign": rf"({KEYS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    # A run's first LEAST_HEX characters are part of it: the same matches without short runs.
    "hex": rf"[0-9a-f]{{{LEAST_HEX},}}",
    "token": r"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}|-----BEGIN [A-Z ]*PRIVATE KEY-----",
}
#: What must stand in a text for a pattern to match, cheaper to look for.
HINTS = {"access": "AKIA"}


def _matches(text: Column, kind: str) -> tuple[Column, Column]:
    """All matches, and the gaps before, between and after them."""
    pattern = F.lit(PATTERNS[kind])
    there = text.contains(HINTS[kind]) if kind in HINTS else F.regexp_like(text, pattern)
    return F.when(there, F.regexp_extract_all(text, pattern, F.lit(0))), F.when(there, F.split(text, PATTERNS[kind], -1))


def _running(lengths: Column) -> Column:
    """For an array of numbers the sums of all before each, and the total."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / STEP).cast("int")), lambda b: F.slice(lengths, b * STEP + 1, F.lit(STEP)))

    def ahead(values: Column, base: Column) -> Column:
        start = F.struct(base.alias("sum"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(values, start, lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.array_append(acc["before"], acc["sum"]).alias("before")))["before"]

    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda acc, x: acc + x))
    bases = ahead(totals, F.lit(0).cast("long"))
    return F.flatten(F.zip_with(blocks, bases, ahead))


def _spans(kind: str) -> Column:
    """Structs (start, rank, end, hash) from ``_m`` and ``_g``."""
    m, g = F.col(f"_m_{kind}"), F.col(f"_g_{kind}")
    pairs = F.arrays_zip(m.alias("m"), F.slice(g, 1, F.size(m)).alias("g"))
    lengths = F.transform(pairs, lambda x: (F.char_length(x["m"]) + F.char_length(x["g"])).cast("long"))
    value = (lambda x: F.regexp_extract(x, PATTERNS["assign"], 2)) if kind == "assign" else (lambda x: x)

    def span(x: Column, before: Column) -> Column:
        start = before + F.char_length(x["g"])
        long_enough = {"assign": lambda: F.char_length(value(x["m"])) >= LEAST_VALUE, "access": lambda: F.char_length(x["m"]) >= LEAST_ACCESS}.get(kind, lambda: F.lit(True))()
        return F.when(long_enough, F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.char_length(x["m"])).alias("end"), F.sha2(value(x["m"]), 256).alias("hash")))

    found = F.filter(F.zip_with(pairs, F.col(f"_b_{kind}"), span), lambda x: x.isNotNull())
    return F.when(F.size(m) > 0, found).otherwise(F.array().cast("array<struct<start:bigint,rank:int,end:bigint,hash:string>>"))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (with a non-null string ``text``) and ``spans``: structs
    (start, rank, end, hash) in order of start, then kind."""
    out = docs
    for kind in KINDS:
        m, g = _matches(F.col("text"), kind)
        out = out.withColumn(f"_m_{kind}", m).withColumn(f"_g_{kind}", g)
    for kind in KINDS:
        pairs = F.arrays_zip(F.col(f"_m_{kind}").alias("m"), F.slice(F.col(f"_g_{kind}"), 1, F.size(f"_m_{kind}")).alias("g"))
        out = out.withColumn(f"_b_{kind}", F.when(F.size(f"_m_{kind}") > 0, _running(F.transform(pairs, lambda x: (F.char_length(x["m"]) + F.char_length(x["g"])).cast("long")))))
    out = out.withColumn("spans", F.sort_array(F.concat(*[_spans(k) for k in KINDS])))
    return out.drop(*[f"_{x}_{k}" for x in "mgb" for k in KINDS])


def ownership(found: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """(hash, n_repos, n_owners, live) of ``found`` (owner, repo, spans)."""
    each = found.where("size(spans) > 0").select("owner", "repo", F.explode("spans.hash").alias("hash"))
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    by_hash = by_owner.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))
    return by_hash.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repos") <= most_repos))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def judged(found: DataFrame, most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """``found`` (materialized, with ``row``, owner, repo, spans) and
    ``reported`` (base spans and live others), ``n_live``, ``n_example``, and
    ``most_owners`` and ``most_repos`` of a value in the row (none: 0)."""
    each = found.where("size(spans) > 0").select("row", F.explode("spans").alias("s"))
    values = ownership(found, most_owners, most_repos)
    marked = each.withColumn("hash", F.col("s.hash")).join(values, "hash")
    by_row = marked.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(F.col("live") | (F.col("s.rank") < 3), F.col("s")))).alias("reported"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_owners").alias("most_owners"),
        F.max("n_repos").alias("most_repos"),
    )
    out = found.where("size(spans) > 0").join(by_row, "row")
    none = [F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners", "most_repos")]
    rest = found.where("size(spans) = 0").select("*", F.col("spans").alias("reported"), *none)
    return out.unionByName(rest)


def secret_scan(docs: DataFrame, owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans, n_live, n_example,
    most_owners, most_repos), a row a document; span lists as kind:start:end, by start."""
    ready = pick(docs, **{owner: "string", repo: "string", "doc_id": "long", "text": "string"})
    ready = ready.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col(owner).alias("owner"), F.col(repo).cast("string").alias("repo"))
    found = scanned(ready.withColumn("row", F.monotonically_increasing_id())).drop("text")
    out = judged(materialize(found, "found"), most_owners, most_repos)
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < 3)
    return out.select("doc_id", count("assign"), count("access"), count("hex"), _text(base).alias("base_spans"), _text(F.col("reported")).alias("spans"), "n_live", "n_example", "most_owners", "most_repos")


PLACEHOLDER = {True: "<secret>", False: "<example-secret>"}


def redact(docs: DataFrame, owner: str = "source", repo: str = "doc_id", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS) -> DataFrame:
    """``docs`` with its own columns; in ``text`` each base secret and each live
    other one gives way to a placeholder, which says whether its value is
    widely copied. ``n_chars``, if there, is counted anew. Rows without a
    candidate pass as they are; only the others are joined with the verdicts."""
    flat, names, at = flattened(docs)
    own = F.col(at["text"]).cast("string")
    ready = flat.select("*", F.coalesce(own, F.lit("")).alias("text"), F.col(at[owner]).cast("string").alias("owner"), F.col(at[repo]).cast("string").alias("repo"))
    rows = materialize(scanned(ready.withColumn("row", F.monotonically_increasing_id())).drop("text"), "scanned")
    values = ownership(rows.select("owner", "repo", "spans"), most_owners, most_repos)
    each = rows.where("size(spans) > 0").select("row", F.explode("spans.hash").alias("hash")).join(values.where("not live").select("hash"), "hash")
    examples = each.groupBy("row").agg(F.collect_set("hash").alias("examples"))
    hit = rows.where("size(spans) > 0").join(examples, "row", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>")))
    text = at["text"]
    for kind in KINDS:
        m, g = _matches(F.col(text), kind)
        hit = hit.withColumn("_m", m).withColumn("_g", g)
        hit = hit.withColumn(text, F.when(F.size("_m") > 0, F.array_join(F.flatten(F.zip_with("_g", F.transform("_m", _replaced(kind)), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")).otherwise(F.col(text)))
    if count := at.get("n_chars"):
        hit = hit.withColumn(count, F.char_length(text).cast(hit.schema[count].dataType))
    return hit.select(*flat.columns).union(rows.where("size(spans) = 0").select(*flat.columns)).toDF(*names)


def _replaced(kind: str):
    def run(m: Column) -> Column:
        value = F.regexp_extract(m, PATTERNS["assign"], 2) if kind == "assign" else m
        least = {"assign": LEAST_VALUE, "access": LEAST_ACCESS}.get(kind, 0)
        known = F.array_contains("examples", F.sha2(value, 256))
        mark = F.when(known, PLACEHOLDER[False]).otherwise(PLACEHOLDER[True])
        if kind == "assign":
            mark = F.concat(F.substring(m, F.lit(1), F.char_length(m) - F.char_length(value)), mark)
        return F.when((F.char_length(value) < least) | (known if kind == "token" else F.lit(False)), m).otherwise(mark)

    return run


#: DuckDB's SQL for the registered query; the patterns are the same.
def oracle_sql() -> str:
    def spans(kind: str, rank: int) -> str:
        p = PATTERNS[kind].replace("'", "''")
        value = f"regexp_extract(m, '{p}', 2)" if kind == "assign" else "m"
        least = {"assign": LEAST_VALUE, "access": LEAST_ACCESS}.get(kind, 0)
        return f"""select r, start, {rank} as rank, '{kind}' as kind, start + length(m) as stop, sha256({value}) as hash
            from (select r, m, sum(length(m) + length(g)) over (partition by r order by i) - length(m) as start
                  from (select r, unnest(ms) as m, unnest(gs[1:len(ms)]) as g, generate_subscripts(ms, 1) as i
                        from (select r, regexp_extract_all(t, '{p}') as ms, string_split_regex(t, '{p}') as gs from d)))
            where length({value}) >= {least}"""

    union = " union all ".join(f"({spans(k, i)})" for i, k in enumerate(KINDS))
    return f"""
        with d as materialized (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
        s as materialized ({union}),
        owned as (select hash, count(distinct coalesce(source, chr(1))) as owners,
            count(distinct coalesce(source, chr(1)) || chr(2) || coalesce(doc_id::varchar, '')) as repos from s join d using (r) group by hash),
        marked as (select s.*, owners, repos, owners <= {MOST_OWNERS} and repos <= {MOST_REPOS} as live from s join owned using (hash)),
        lists as (select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
            count(*) filter (kind = 'hex') as n_hex,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3), '') as base,
            coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < 3 or live), '') as spans,
            count(*) filter (live) as n_live, count(*) filter (not live) as n_example, max(owners) as most_owners, max(repos) as most_repos
            from marked group by r)
        select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
            sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
            coalesce(n_live, 0) as n_live, coalesce(n_example, 0) as n_example,
            coalesce(most_owners, 0) as most_owners, coalesce(most_repos, 0) as most_repos
        from d left join lists using (r)"""
