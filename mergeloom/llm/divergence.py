"""Source divergence audit: how far apart the sources of a language are.

A document's terms are the runs of letters and non-ASCII characters of its text,
A-Z lower-cased. Each language keeps the terms of at least ``LEAST_DOCS`` of its
documents. A group (language, source) gives each kept term a smoothed share of
its own terms in billionths; two groups differ by the sum over all kept terms of
the squared differences of their shares over the shares' sum, a symmetric
chi-square distance. Terms that a group uses more than its language does are
listed beside it. All numbers are whole and exact.

**Counting.** A task adds up terms by group in a dictionary of bounded size
before anything shuffles: a hot source or word is a row a flush. The rows meet
by (language, term), where the documents of a language that have the term are
added up, and what is too rare falls at once.

**Pairs**: two-dimensional tiles of groups. The kept terms of a language are cut
into chunks of about ``CHUNK`` by hash, a group's counts of a chunk are one packed
row, and groups are numbered into blocks of ``BLOCK``. A packed row is replicated to
every tile of two blocks that its own block is part of. A tile's task holds one
chunk of its two blocks and the matrix of its pairs, and goes through ``RUN``
chunks one after the other; longer vocabularies are several such tasks, whose
matrices add up. Packed rows leave out terms that a group lacks: a tile adds, for
the terms of a chunk that some group of it has, the difference to what two groups
without the term would differ by; that constant counts for all kept terms once.
So no task's memory grows with the vocabulary, the number of groups or the texts.

Null texts, languages and sources count as ''. Texts without terms leave their
group with shares of its kept terms' smoothing alone; a language without kept
terms has pairs of distance 0. Long texts are read term by term. Repeated rows
are documents of their own. Equal values rank by the item's UTF-8 bytes. Other
columns, whatever their names, are not read. An empty table gives no rows.
Counts up to 9 * 10^15 terms of a group are exact.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, byte_texts, keyed_stream, materialize, pick, sized_join

#: Letters and what is not ASCII, in lower-cased UTF-8.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCS = 10
SMOOTHING, SCALE = 2, 1_000_000_000
TOP_TERMS = 10
#: Entries of a task's dictionary before they are given on; texts from
#: ``LONG_TEXT`` bytes on are read term by term.
HELD_TERMS, LONG_TEXT = 100_000, 1 << 20
#: Kept terms of a chunk, chunks of a run, groups of a block.
CHUNK, RUN, BLOCK = 4096, 32, 64


def found_terms(text: bytes) -> Counter:
    """The terms of a text and how often each occurs."""
    text = text.lower()  # of bytes: A-Z only
    if len(text) < LONG_TEXT:
        return Counter(TERM.findall(text))
    return Counter(m.group() for m in TERM.finditer(text))


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): partial counts by task; rows of a null
    term name the groups."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                terms = [None, *n]
                for i in range(0, len(terms), 10_000):
                    some = terms[i : i + 10_000]
                    # Malformed UTF-8 cannot come from a Spark string but through a cast of binary.
                    names = pa.array([t and t.decode("utf-8", "replace") for t in some], pa.string())
                    columns = [pa.array([x] * len(some), pa.string()) for x in (lang, source)]
                    counts = [pa.array([c.get(t, 0) for t in some], pa.int64()) for c in (n, docs)]
                    yield pa.RecordBatch.from_arrays([*columns, names, *counts], ["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in batches(rows):
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), byte_texts(b.column(2)), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), found_terms(text)
                n.update(own)
                docs.update(own.keys())
                size += len(n) - before + 1
                if size > HELD_TERMS:
                    yield from flushed()
                    size = 0
        yield from flushed()

    rows = pick(docs, lang="string", source="string", text="string").select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")], "text")
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_cells(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, term_no, first): a row for each group and
    kept term that it has, with the term's number and its count in the language;
    ``first`` marks one row a term. Rows of a null term name the groups."""
    rows = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    # All rows of a term are in one task, so that the least of their row numbers is the term's own.
    rows = rows.withColumn("_no", F.monotonically_increasing_id())
    same = Window.partitionBy("lang", "term")
    rows = rows.withColumns({"docs": F.sum("docs").over(same), "lang_n": F.sum("n").over(same), "term_no": F.min("_no").over(same)})
    rows = rows.where(F.col("term").isNull() | (F.col("docs") >= least_docs))
    return materialize(rows.select("lang", "source", "term", "n", "lang_n", "term_no", (F.col("_no") == F.col("term_no")).alias("first")), "cells")


def groups_of(cells: DataFrame) -> DataFrame:
    """(lang, source, total, lang_total, kept, number, n_groups): a row a group;
    totals are the smoothed numbers of kept terms."""
    term = F.col("term").isNotNull()
    groups = cells.groupBy("lang", "source").agg(F.coalesce(F.sum(F.when(term, F.col("n"))), F.lit(0)).alias("n"), F.count_if(term & F.col("first")).alias("firsts"))
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"kept": F.sum("firsts").over(lang), "lang_n": F.sum("n").over(lang), "n_groups": F.count("*").over(lang), "number": F.row_number().over(lang.orderBy("source")) - 1})
    smooth = SMOOTHING * F.col("kept")
    return materialize(groups.select("lang", "source", (F.col("n") + smooth).alias("total"), (F.col("lang_n") + smooth).alias("lang_total"), "kept", "number", "n_groups"), "groups")


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + SMOOTHING) / total), digit by digit of base 1000
    so that nothing overflows."""
    rest, out = n + SMOOTHING, F.lit(0).cast("long")
    for _ in range(3):
        scaled = rest * 1000
        part = F.call_function("div", scaled, total)
        out, rest = out * 1000 + part, scaled - part * total
    return out + 1


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays of 64-bit numbers."""
    rest, out = n + SMOOTHING, np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64)
    for _ in range(3):
        scaled = rest * 1000
        part = scaled // total
        out, rest = out * 1000 + part, scaled - part * total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def tiles(cells: DataFrame, groups: DataFrame, block: int = BLOCK, chunk: int = CHUNK, run_length: int = RUN) -> DataFrame:
    """(lang, bi, bj, run, chunk, number, source, total, kept, terms, counts):
    the packed rows of each tile's runs, after its groups (chunk -1)."""
    chunks = F.greatest(F.lit(1), F.ceil(F.col("kept") / chunk).cast("int"))
    own = groups.select("lang", "source", "total", "kept", "number", chunks.alias("_chunks"), F.floor(F.col("number") / block).cast("int").alias("_b"), F.ceil(F.col("n_groups") / block).cast("int").alias("_blocks"))
    packed = sized_join(cells.where("term is not null").select("lang", "source", "term_no", "n"), own, ["lang", "source"])
    packed = packed.withColumn("chunk", F.pmod(F.xxhash64("term_no"), F.col("_chunks")).cast("int"))
    packed = packed.groupBy("lang", "number", "chunk", "_b", "_blocks").agg(F.collect_list(F.struct(F.col("term_no").alias("t"), "n")).alias("p"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_o")
    tile = ["lang", F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj")]
    nothing = lambda kind: F.lit(None).cast(kind)
    data = packed.select("*", other).select(*tile, F.floor(F.col("chunk") / run_length).cast("int").alias("run"), "chunk", "number", nothing("string").alias("source"), nothing("long").alias("total"), nothing("long").alias("kept"), F.col("p.t").alias("terms"), F.col("p.n").alias("counts"))
    runs = F.ceil(F.col("_chunks") / run_length).cast("int")
    heads = own.select("*", other).select("*", F.explode(F.sequence(F.lit(0), runs - 1)).alias("run"))
    heads = heads.select(*tile, "run", F.lit(-1).alias("chunk"), "number", "source", "total", "kept", nothing("array<long>").alias("terms"), nothing("array<long>").alias("counts"))
    return data.unionByName(heads)


def tile_matrices(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) of ``tiles``: each run's part of the sum over all kept
    terms, for each pair of sources of the tile."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, chunk, heads, held = None, -1, {}, {}
        sums = numbers = totals = base = None

        def begin() -> None:
            """All groups of the tile are known."""
            nonlocal numbers, totals, base, sums
            numbers, totals, base, sums = _matrix(heads, tile[3])

        def spans() -> Iterator[tuple[int, slice]]:
            """Each group of the first block with those of the second after it."""
            low = tile[1] * block
            ends = np.searchsorted(numbers, [low + block, tile[2] * block])
            for i in range(ends[0]):
                if (start := max(i + 1, ends[1])) < len(numbers):
                    yield i, slice(start, len(numbers))

        def add() -> None:
            """The chunk's terms into the sums."""
            if not held:
                return
            terms, at = np.unique(np.concatenate([t for t, _ in held.values()]), return_inverse=True)
            counts, places, start = np.zeros((len(numbers), len(terms)), np.int64), {k: i for i, k in enumerate(numbers.tolist())}, 0
            for number, (t, n) in held.items():
                counts[places[number], at[start : start + len(t)]] = n
                start += len(t)
            p = shares(counts, totals[:, None])
            for i, j in spans():
                sums[i, j] += distance(p[i], p[j]).sum(1) - len(terms) * base[i, j]

        def done() -> Iterator[pa.RecordBatch]:
            if chunk < 0:
                begin()
            add()
            names = [heads[k][0] for k in numbers.tolist()]
            for i, j in spans():
                size = len(names[j])
                columns = [pa.array(x, pa.string()) for x in ([tile[0]] * size, [names[i]] * size, names[j])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sums[i, j])], ["lang", "a", "b", "value"])

        for b in batches(found):
            columns = [c.to_pylist() for c in b.columns[:9]]
            lists = [(c.flatten().to_numpy(zero_copy_only=False), np.asarray(c.value_lengths().fill_null(0)).cumsum()) for c in b.columns[9:]]
            for r, (lang, bi, bj, part, now, number, source, total, kept) in enumerate(zip(*columns, strict=True)):
                if (lang, bi, bj, part) != tile:
                    if tile is not None:
                        yield from done()
                    tile, chunk, heads, held = (lang, bi, bj, part), -1, {}, {}
                if now < 0:
                    heads[number] = (source, total, kept)
                    continue
                if now != chunk:
                    if chunk < 0:
                        begin()
                    add()
                    chunk, held = now, {}
                held[number] = tuple(np.asarray(x[(e[r - 1] if r else 0) : e[r]], np.int64) for x, e in lists)
        if tile is not None:
            yield from done()

    return keyed_stream(rows, ["lang", "bi", "bj", "run"], ["chunk", "number"], run, "lang string, a string, b string, value long")


def _matrix(heads: dict[int, tuple], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A tile's group numbers, totals, what two groups without a term differ by,
    and the sums to start from: that constant for all kept terms in run 0."""
    numbers = np.array(sorted(heads))
    totals = np.array([heads[k][1] for k in numbers.tolist()], np.int64)
    kept = heads[numbers[0]][2]
    if not kept:
        zero = np.zeros((len(numbers), len(numbers)), np.int64)
        return numbers, totals, zero, zero.copy()
    p = shares(np.zeros(len(numbers), np.int64), totals)
    base = distance(p[:, None], p[None])
    return numbers, totals, base, base * kept if run == 0 else np.zeros_like(base)


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP_TERMS, block: int = BLOCK, chunk: int = CHUNK, run_length: int = RUN) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other
    source of the language with its distance, part ``term`` the terms that the
    source uses more than the language, the ``top`` of them."""
    cells = kept_cells(docs, least_docs)
    groups = groups_of(cells)
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    own = sized_join(cells.where("term is not null and n > 0"), groups.select("lang", "source", "total", "lang_total"), ["lang", "source"])
    own = own.select("lang", "source", F.col("term").alias("item"), share(F.col("n"), F.col("total")).alias("p"), share(F.col("lang_n"), F.col("lang_total")).alias("q")).where("p > q")
    terms = own.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div (p + q)").alias("value")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    sums = tile_matrices(tiles(cells, groups, block, chunk, run_length), block).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e"), "value")
    pairs = both.select("lang", "e.source", "e.item", "value").withColumn("rank", F.row_number().over(order))
    out = [x.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, x in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])


def oracle_sql() -> str:
    return r"""
        with docs as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
            found as (select id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from docs),
            kept as (select lang, term, count(*) as lang_n from found group by lang, term having count(distinct id) >= 10),
            cells as (select lang, source, term, count(*) as n, any_value(lang_n) as lang_n from found join kept using (lang, term) group by lang, source, term),
            langs as (select lang, count(*) as v, sum(lang_n) as lang_total from kept group by lang),
            groups as (select lang, source, coalesce(any_value(v), 0)::hugeint as v, coalesce(any_value(lang_total), 0)::hugeint as lang_total, coalesce(sum(n), 0)::hugeint as total
                from (select distinct lang, source from docs) left join langs using (lang) left join cells using (lang, source) group by lang, source),
            every as (select lang, source, term, 1 + 1000000000 * (coalesce(n, 0)::hugeint + 2) // (total + 2 * v) as p from groups join kept using (lang) left join cells using (lang, source, term)),
            pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                from every a join every b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
            all_pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
                left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source),
            own as (select lang, source, term as item, 1 + 1000000000 * (n::hugeint + 2) // (total + 2 * v) as p, 1 + 1000000000 * (cells.lang_n::hugeint + 2) // (lang_total + 2 * v) as q
                from cells join groups using (lang, source)),
            terms as (select lang, source, item, (p - q) * (p - q) // (p + q) as value from own where p > q)
        select lang, source, 'pair' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from all_pairs
        union all
        select lang, source, 'term' as part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms
        qualify row_number() over (partition by lang, source order by value desc, item) <= 10
    """
