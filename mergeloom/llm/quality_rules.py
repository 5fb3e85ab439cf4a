"""Quality rules with adaptive thresholds.

Each text gets counts (words, symbols, repeats). Two fixed rules reject very
short texts and texts that mostly repeat themselves. All other cutoffs adapt:
for each language and source mergeable quantile sketches (KLL) of every ratio
and of the texts' lengths, among the texts that pass the fixed rules, give the
median, the quartiles and the typical length, and a text fails when a ratio
lies outside a fence around the median. Sketches pre-aggregate in every task,
so a source with a third of all rows sends a sketch a task like any other.
Thresholds are a row a group; they join back with a checked size (see
``sized_join``), the counts alone at first.

A fence reaches ``REACH`` times the ratio's spread in the group, which is the
distance from the median to the nearer quartile, or the ratio's grain if that
is more. Junk on one side, up to half of a group, doesn't widen its own fence.
The grain is what one symbol, one repeated line or one repeated window makes in
a text of the group's median length, and what a mean over so many words moves
by chance: in a group without spread a text may differ by a little. Median,
spread and grain of a group of n texts are shrunk towards those of all groups'
merged sketches, which count as ``PRIOR`` texts: a small group has its own say
in proportion, and no size is a switch.

A ratio at just a fence passes. Null texts count as empty and fail the fixed rules. Null languages and sources
are groups like others. Very long texts are counted whole. Repeated rows are
judged alike. Other columns, whatever their names, are not read, and stay where
rows are kept whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mergeloom.llm.common import batches, byte_texts, flattened, materialize, pick, sized_join

SYMBOLS = tuple(b"#*$%&|<>")
SPACES = b"\t\n\x0b\x0c\r "
FEW_WORDS = 50
MOST_REPEATED = 50  # percent of the words
REACH = 24.0
PRIOR = 40
K = 200  # the sketches' size parameter
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 3
#: Ratios, and whether low values fail as well.
RATIOS = {"mean_word": True, "symbol_share": False, "dup_line_share": False, "repeat_share": False}
LENGTHS = ("n_words", "word_chars")


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()  # bytes: ASCII white space only
    n = len(words)
    if not n:
        return 0, 0, text_symbols(text), 0, 0
    stripped = text.translate(None, SPACES)
    chars = len(stripped.decode("utf-8", "replace")) if not stripped.isascii() else len(stripped)
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    return n, chars, text_symbols(text), len(lines) - len(set(lines)), repeated(words)


def text_symbols(text: bytes) -> int:
    return sum(text.count(s) for s in SYMBOLS)


def repeated(words: list[bytes], width: int = WINDOW) -> int:
    """Words that lie in a window of ``width`` words found twice or more."""
    n = len(words)
    if n <= width:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    if len(known) == n:
        return 0
    windows = ids[: n - width + 1].copy()
    for k in range(1, width):  # number the windows anew after each word: no overflow
        windows = windows * len(known) + ids[k : n - width + 1 + k]
        if k < width - 1:
            windows = np.unique(windows, return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(windows), bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    covered = np.zeros(n, bool)
    for k in range(width):
        covered[starts + k] = True
    return int(covered.sum())


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts..., base_failed); one Arrow pass."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            found = np.array([counts(t) for t in byte_texts(b.column(3))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array(found[:, i]) for i in range(5))], ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    out = pick(docs, doc_id="long", lang="string", source="string", text="string").mapInArrow(run, schema)
    return out.withColumn("base_failed", failed_base())


def failed_base() -> Column:
    return (F.col("n_words") < FEW_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def ratios() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "mean_word": F.col("word_chars") / words,
        "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double"),
        "dup_line_share": F.col("n_dup_lines") / (words / 10),
        "repeat_share": F.col("n_repeat_words") / words,
    }


def grains(words: Column, chars: Column) -> dict[str, Column]:
    """The ratios' steps in a text of so many words and characters."""
    one = F.lit(1.0)
    return {"mean_word": one / F.sqrt(words), "symbol_share": one / chars, "dup_line_share": 10 * one / words, "repeat_share": 2 * WINDOW * one / words}


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, n, a sketch for each ratio and length) of the texts that
    pass the fixed rules. The table can be stored, and merged with others by
    ``merged``."""
    own = {**ratios(), **{k: F.col(k).cast("double") for k in LENGTHS}}
    passing = rows.where(~F.col("base_failed")).select("lang", "source", *[c.alias(k) for k, c in own.items()])
    return passing.groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(k, F.lit(K)).alias(k) for k in own])


def merged(stored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sketches merged by coarser keys, or all of them into one row."""
    keys = list(by) or [F.lit(1).alias("_all")]
    out = stored.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(k).alias(k) for k in (*RATIOS, *LENGTHS)])
    return out if by else out.drop("_all")


def centers(stored: DataFrame) -> DataFrame:
    """``mid_...`` and ``spread_...`` for each ratio and ``mid_...`` for each
    length in place of the sketches of a row; its other columns stay."""
    quantile = lambda k, q: F.kll_sketch_get_quantile_double(k, F.lit(q))
    found = [quantile(k, 0.5).alias(f"mid_{k}") for k in (*RATIOS, *LENGTHS)]
    found += [F.least(quantile(k, 0.75) - quantile(k, 0.5), quantile(k, 0.5) - quantile(k, 0.25)).alias(f"spread_{k}") for k in RATIOS]
    return stored.select(*[c for c in stored.columns if c not in (*RATIOS, *LENGTHS)], *found)


def thresholds(own: DataFrame, overall: Row) -> DataFrame:
    """(lang, source, low_..., high_...) of groups from their ``centers`` and
    those of all groups."""
    shrunk = lambda c: (F.col("n") * F.col(c) + PRIOR * F.lit(overall[c])) / (F.col("n") + PRIOR)
    grain = grains(*[shrunk(f"mid_{k}") for k in LENGTHS])
    fences = []
    for k, both in RATIOS.items():
        mid, reach = shrunk(f"mid_{k}"), REACH * F.greatest(shrunk(f"spread_{k}"), grain[k])
        fences += [(mid - reach if both else F.lit(float("-inf"))).alias(f"low_{k}"), (mid + reach).alias(f"high_{k}")]
    return own.select("lang", "source", *fences)


def judge(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` (lang, source, counts..., base_failed) with ``kept``: the fixed
    rules, then the fences from materialized ``sketches`` by lang and source."""
    columns = [f"{side}_{k}" for k in RATIOS for side in ("low", "high")]
    overall = centers(merged(stored)).first()
    if overall is None:  # no text passes the fixed rules
        return rows.withColumn("kept", F.lit(False))
    joined = sized_join(rows, thresholds(centers(stored), overall), ["lang", "source"], "left")
    kept = ~F.col("base_failed")
    for k, ratio in ratios().items():
        kept &= F.coalesce(ratio.between(F.col(f"low_{k}"), F.col(f"high_{k}")), F.lit(False))
    return joined.withColumn("kept", kept).drop(*columns)


def quality_rules(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, counts..., base_failed, kept), a row a document."""
    rows = materialize(measured(docs), "measured")
    return judge(rows, materialize(sketches(rows), "sketches"))


def passing(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns. Texts
    are measured twice rather than written or shuffled."""
    stored = materialize(sketches(measured(docs)), "sketches")
    flat, names, at = flattened(docs)
    ready = flat.withColumns({"lang": F.col(at["lang"]).cast("string"), "source": F.col(at["source"]).cast("string"), "_text": F.col(at["text"]).cast("string")})

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            found = np.array([counts(t) for t in byte_texts(b.column(b.num_columns - 1))], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(found[:, i]) for i in range(5))], [*b.schema.names[:-1], *COUNTS])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in ready.schema.fields[:-1]), *(f"{c} long" for c in COUNTS)])
    full = ready.mapInArrow(run, schema).withColumn("base_failed", failed_base())
    return judge(full, stored).where("kept").select(*flat.columns).toDF(*names)
