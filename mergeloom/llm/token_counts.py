"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. Each holds the signed changes of one
batch, added up by source, language and tokenizer version: inserts add a
document and its tokens, deletes take them away, revised counts move the tokens
alone. Totals are the sum of all batches, so any mix of changes stays exact.
Texts are read once, by ``counted``, which gives all versions' counts as
columns; deletes and revisions take the counts that are stored.

Commits are idempotent: a batch is written aside and then renamed to a folder
named after its id, which fails if that folder is there. Whoever repeats a
batch, after a lost driver or in a race, changes nothing. ``compact`` folds the
batches of one listing into a base with the list of their ids, so a folded
batch still counts as committed, and one that comes meanwhile counts as itself.
Batches are always listed before the base: a batch that compaction moves from
the one to the other in between is found there.

A commit is one scan with partial aggregation before its shuffle; groups with
a third of all rows send a row a task. Folders live where the caller says, on
any file system that Spark can rename on. Ids of folded batches stay in Spark.

Versions are patterns of one token, counted by native expressions, or names of
public tokenizer files: ``word_bpe_49k`` (the same ids as ``packing``) and
``byte_bpe_50k``, counted in Arrow batches.

Sums do not depend on the order of changes, so ties have no part in them. Null
sources, languages and versions are groups like others. Null texts have no
tokens, null changes count as 0. Very long texts are counted whole. Groups whose
documents and tokens are both 0 are left out of the totals. Repeated rows count
as often as they come. Other columns, whatever their names, are not read but for
those that a change names. An empty batch commits.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mergeloom.llm.common import WORD, batches, flattened, materialize, pick, texts

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
#: Tokenizer versions that need no vocabulary, as patterns of one token.
VERSIONS = {
    "words-1": WORD,
    "words-2": r"[^\x20\x09-\x0D]*[A-Za-z0-9][^\x20\x09-\x0D]*",
    "pieces-1": r"[A-Za-z0-9]+|[^A-Za-z0-9\x20\x09-\x0D]",
}


#: Versions by tokenizer files.
FILES = ("word_bpe_49k", "byte_bpe_50k")


def tokens(version: str) -> Column:
    """The number of tokens in ``text`` (null: 0)."""
    return F.coalesce(F.regexp_count("text", F.lit(VERSIONS[version])), F.lit(0)).cast("long")


@cache
def _counter(version: str) -> Callable[[str], int]:
    """Counts a text's tokens; loaded once a worker."""
    if version == "word_bpe_49k":
        from mergeloom.llm.packing import word_ids

        return lambda text: len(word_ids()(text)) // 4
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{version}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def counted(docs: DataFrame, versions: Sequence[str], text: str = "text") -> DataFrame:
    """``docs`` with its other columns and ``n_<version>`` in place of the text:
    one pass over the texts for all versions."""
    unknown = sorted(set(versions) - set(VERSIONS) - set(FILES))
    if unknown:
        raise ValueError(f"no tokenizer version {unknown}")
    flat, names, at = flattened(docs)
    kept = [c for c, n in zip(flat.columns, names, strict=True) if c != at[text]]
    own = flat.select(*kept, F.col(at[text]).cast("string").alias("text"))
    native = own.select("*", *[tokens(v).alias(f"n_{v}") for v in versions if v in VERSIONS])
    by_file = [v for v in versions if v in FILES]
    shown = [n for n in names if n != text] + [f"n_{v}" for v in [*(v for v in versions if v in VERSIONS), *by_file]]
    if not by_file:
        return native.drop("text").toDF(*shown)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from mergeloom.llm.packing import word_ids

        for b in batches(rows, keep=word_ids):
            i = b.schema.get_field_index("text")
            found = texts(b.column(i))
            counts = [pa.array([_counter(v)(t) for t in found], pa.int64()) for v in by_file]
            held = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in held), *counts], [*held, *(f"n_{v}" for v in by_file)])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in native.schema if f.name != "text"]
    return native.mapInArrow(run, ", ".join([*fields, *(f"`n_{v}` long" for v in by_file)])).toDF(*shown)


def _changes(docs: DataFrame, tokenizer: str, count: int, change: Callable[..., Column], *counts: str) -> DataFrame:
    """Changes from stored counts, the columns ``counts`` of ``docs``."""
    ready = pick(docs, source="string", lang="string", **dict.fromkeys(counts, "long"))
    return ready.select("source", "lang", F.lit(tokenizer).alias("tokenizer"), F.lit(count).cast("long").alias("docs"), change(*map(F.col, counts)).alias("tokens"))


def inserts(docs: DataFrame, tokenizer: str, count: str) -> DataFrame:
    """Documents (source, lang and their number of tokens ``count``) that come."""
    return _changes(docs, tokenizer, 1, lambda n: n, count)


def deletes(docs: DataFrame, tokenizer: str, count: str) -> DataFrame:
    """Documents that go, with the count that they came or were revised with."""
    return _changes(docs, tokenizer, -1, lambda n: -n, count)


def revisions(docs: DataFrame, tokenizer: str, old: str, new: str) -> DataFrame:
    """Documents whose count changes. A null counts as 0."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return _changes(docs, tokenizer, 0, lambda a, b: zero(b) - zero(a), old, new)


class Rollup:
    """Totals of documents and tokens in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(self.path).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _rename(self, source: str, target: str) -> bool:
        """Move a folder; False, and nothing changes, if the target is there."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.path).toUri(), self.conf)
        self.fs.mkdirs(self._path(target).getParent())
        try:
            context.rename(self._path(source), self._path(target), self.spark.sparkContext._gateway.new_array(kind, 0))
        except Exception as e:
            if self.fs.exists(self._path(target)):
                self.fs.delete(self._path(source), True)
                return False
            raise e
        return True

    def _folders(self, name: str) -> list[str]:
        top = self._path(f"{self.path}/{name}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(top)) if self.fs.exists(top) else []

    def _base(self) -> str | None:
        """The newest base; the others are left for readers at work."""
        found = self._folders("base")
        return f"{self.path}/base/{found[-1]}" if found else None

    def _ids(self, base: str | None) -> DataFrame:
        """(id) of the batches that a base holds."""
        return self.spark.read.schema("id string").parquet(f"{base}/ids") if base else self.spark.createDataFrame([], "id string")

    def _listed(self) -> tuple[list[str], str | None]:
        """Folders of the batches that count for themselves, and the base."""
        batches = self._folders("batch")  # before the base, see the module's text
        base = self._base()
        folded = {r[0] for r in self._ids(base).where(F.col("id").isin(batches)).collect()} if base and batches else set()
        return [x for x in batches if x not in folded], base

    def _sums(self, batches: list[str], base: str | None) -> DataFrame:
        parts = [f"{self.path}/batch/{x}" for x in batches] + ([f"{base}/totals"] if base else [])
        rows = self.spark.read.schema(SCHEMA).parquet(*parts) if parts else self.spark.createDataFrame([], SCHEMA)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs != 0 or tokens != 0")

    def committed(self, batch_id: str) -> bool:
        """Does this batch count already?"""
        name = _folder(batch_id)
        return self.fs.exists(self._path(f"{self.path}/batch/{name}")) or not self._ids(self._base()).where(F.col("id") == name).isEmpty()

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Add a batch of changes (source, lang, tokenizer, docs, tokens). True
        if it counts from now on, False if it did already."""
        if self.committed(batch_id):
            return False
        added = changes.groupBy(*KEYS).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("docs", "tokens")])
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        added.write.parquet(aside)
        return self._rename(aside, f"{self.path}/batch/{_folder(batch_id)}")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all batches."""
        return self._sums(*self._listed())

    def compact(self) -> None:
        """Fold the batches of one listing into a new base, then drop their
        folders. A reader that began before may have to start again."""
        number = len(self._folders("base"))
        batches, base = self._listed()
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        self._sums(batches, base).write.parquet(f"{aside}/totals")
        new = self.spark.createDataFrame([(x,) for x in batches], "id string")
        self._ids(base).union(new).coalesce(1).write.parquet(f"{aside}/ids")
        if self._rename(aside, f"{self.path}/base/{number:09d}"):
            for x in batches:
                self.fs.delete(self._path(f"{self.path}/batch/{x}"), True)


def _folder(batch_id: str) -> str:
    return quote(batch_id, safe="") or "%"


FEW_WORDS = 5
RUN = ("words-1", "words-2", "pieces-1")


def maintained(docs: DataFrame, path: str) -> Rollup:
    """The registered run: all documents under two tokenizers, the first one's
    counts revised to its next version, short documents taken down and put back,
    two batches repeated, one of them after compaction. Counts of every document
    are stored first; all changes come from them."""
    rollup = Rollup(docs.sparkSession, path)
    stored = materialize(counted(pick(docs, source="string", lang="string", text="string"), RUN), "counts")
    short = stored.where(F.col("n_words-1") < FEW_WORDS)
    change = lambda make, rows: make(rows, "words", "n_words-2").unionByName(make(rows, "pieces", "n_pieces-1"))
    rollup.commit("load", inserts(stored, "words", "n_words-1"))
    rollup.commit("pieces", inserts(stored, "pieces", "n_pieces-1"))
    rollup.commit("recount", revisions(stored, "words", "n_words-1", "n_words-2"))
    rollup.commit("takedown", change(deletes, short))
    rollup.commit("load", inserts(stored, "words", "n_words-1"))
    rollup.compact()
    rollup.commit("takedown", change(deletes, short))
    rollup.commit("restored", change(inserts, short))
    return rollup


def oracle_sql() -> str:
    n = lambda v: f"len(regexp_extract_all(coalesce(text, ''), '{VERSIONS[v]}'))"
    return f"""
        select source, lang, tokenizer, count(*)::bigint as docs, sum(n)::bigint as tokens
        from (select source, lang, unnest([{{'t': 'words', 'n': {n("words-2")}}}, {{'t': 'pieces', 'n': {n("pieces-1")}}}], recursive := true)
              from documents) x(source, lang, tokenizer, n)
        group by source, lang, tokenizer"""
