"""Packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: as many
of the sequence length as fit, then the binary digits of the rest, largest
first. Each piece is a sequence of its own, so no sequence crosses documents,
none needs padding. Sequences of equal length form a bucket, and within a task
they fill batches of one shape, ``BATCH_TOKENS`` ids each but for a task's last
one of a bucket: ``bucket``, ``batch_id`` and ``batch_row`` say where a piece
goes. ``write_buckets`` writes a folder for each bucket.

One Arrow pass, no shuffle: every document is cut where it is read. Sequence
and batch ids are the partition's number and a running count in it, so a lost
task gives the same ids when it runs again on the same partition.

A worker loads a tokenizer once and keeps the ids of at most two generations of
``KEPT_WORDS`` words of up to ``LONGEST_KEPT`` letters, until a task of another
operator begins in it.

Pieces of one length fill their batches in the order in which they are cut, so
there are no ties to decide. Null text counts as empty: its only id is the end mark, one piece of length 1.
Repeated rows and null doc_ids are packed like any other row. An empty table
gives no rows. Texts are cut whole whatever their length. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mergeloom.llm.common import batches, pick, texts, worker_cache

MOST = 4096
END = 2
#: Texts of nothing but these characters have one reading in any Unicode
#: version: composed, with plain lower case. Others go to the library whole.
PLAIN = re.compile(r"[\t\n\r\x20-\x7EÀ-ÖØ-öø-ÿ]*")
#: The pre-tokenizer's pattern over lower-cased plain texts.
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
#: Words of a generation whose ids a worker keeps; there are two generations.
KEPT_WORDS, LONGEST_KEPT = 150_000, 64
#: The pre-tokenizer and normalizer that PLAIN and WORDS stand for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Ids in a batch of sequences of one length.
BATCH_TOKENS = 1 << 16


def byte_letters() -> dict[int, str]:
    """For ``str.translate``: the letters that byte-level models use for the
    UTF-8 bytes of each Latin-1 character. Printable bytes stand for
    themselves, the others for the code points from 256 on, in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {b: chr(b) for b in shown}
    letter |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letter)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(128, 256)}


class WordIds:
    """Ids of whole texts by a tokenizer file.

    ``word_bpe_49k`` drops white space, lower-cases, cuts by a fixed pattern and
    encodes each piece by itself; so ids of a word may be kept and reused. Texts
    outside ``PLAIN``, or with a special token's spelling, go to the library, and
    so do all texts of a tokenizer that works otherwise. Words are kept in two
    generations, so frequent ones stay."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.by_word = self._cuts_words()
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _cuts_words(self) -> bool:
        """Does the file state the steps that ``PLAIN`` and ``WORDS`` stand for?"""
        state = lambda x: json.loads(x.__getstate__()) if x is not None else None
        steps = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        cuts = [
            {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ]
        t = self.tokenizer
        same = state(t.normalizer) == {"type": "Sequence", "normalizers": steps} and state(t.pre_tokenizer) == {"type": "Sequence", "pretokenizers": cuts}
        return same and type(self.model).__name__ == "BPE"

    def _word(self, word: str) -> bytes:
        tokens = self.model.tokenize(word if word.isascii() else word.translate(self.letters))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if not self.by_word or "<|" in text or not PLAIN.fullmatch(text):
            return self._whole(text)
        found = WORDS.findall(text.lower())
        words = self.words
        if missing := set(found).difference(words):
            if len(words) + len(missing) > KEPT_WORDS:
                self.before, self.words, missing = words, {}, set(found)
            before, word = self.before, self._word
            more = {x: before[x] if x in before else word(x) for x in missing}
            if len(more) <= KEPT_WORDS and max(map(len, more)) <= LONGEST_KEPT:
                self.words.update(more)
                words = self.words
            else:  # a text of very many or very long words: not worth keeping
                words = self.words | more
        return b"".join(map(words.__getitem__, found))


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@worker_cache
def word_ids(path: str | None = None) -> WordIds:
    """The tokenizer of a file, loaded once a worker."""
    return WordIds(path or word_bpe_path())


def lengths(n: int, most: int = MOST) -> list[int]:
    """The lengths of a document's pieces; they sum to ``n``."""
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if n % most >> b & 1]


def pack(docs: DataFrame, most: int = MOST, end: int = END, tokenizer_path: str | None = None) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id,
    offset, ``bucket`` (the binary logarithm of length), ``batch_id``,
    ``batch_row`` and ``ids`` (array of int), the piece's own ids."""
    if most & (most - 1) or most < 1:
        raise ValueError("the sequence length must be a power of two")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path)
        filled = np.zeros(64, np.int64)  # sequences of each bucket so far
        sequence = TaskContext.get().partitionId() << 40
        tail = np.array([end], "<u4").tobytes()
        for b in batches(rows, 4 << 20, word_ids):
            flat, doc, start, length, total = [], [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), texts(b.column(1)), strict=True):
                ids = encode(text) + tail
                n = len(ids) // 4
                pieces = lengths(n, most)
                flat.append(ids)
                doc += [doc_id] * len(pieces)
                total += [n] * len(pieces)
                length += pieces
                start += np.cumsum([0, *pieces[:-1]]).tolist()
            ends = np.cumsum([0, *length]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            n = len(doc)
            size = np.array(length, np.int64)
            bucket, row = np.bitwise_count(size - 1).astype(np.int64), np.zeros(n, np.int64)
            for k in np.unique(bucket).tolist():
                own = bucket == k
                row[own] = np.arange(filled[k], filled[k] + own.sum())
                filled[k] += own.sum()
            fits = np.maximum(1, BATCH_TOKENS >> bucket)
            batch = (sequence >> 40 << 40) + (bucket << 34) + row // fits
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(np.arange(sequence, sequence + n)), pa.array(np.zeros(n, np.int64)),
                 pa.array(bucket.astype(np.int32)), pa.array(batch), pa.array((row % fits).astype(np.int32)), ids],
                ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "bucket", "batch_id", "batch_row", "ids"],
            )
            sequence += n

    schema = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, bucket int, batch_id long, batch_row int, ids array<int>"
    return pick(docs, doc_id="long", text="string").mapInArrow(run, schema)


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` with ``ids_crc32`` (of the ids as little-endian unsigned
    32-bit numbers) in place of ``ids``."""
    from zlib import crc32

    kept = [c for c in packed.columns if c != "ids"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            ids = b.column(b.schema.get_field_index("ids"))
            flat, ends = ids.flatten().to_numpy().astype("<i4", copy=False), np.asarray(ids.offsets) - ids.offsets[0].as_py()
            sums = [crc32(flat[i:j].tobytes()) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(sums, pa.int64())], [*kept, "ids_crc32"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in packed.schema if f.name != "ids")
    return packed.mapInArrow(run, f"{schema}, ids_crc32 long")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write the sequences with a folder for each bucket."""
    packed.write.partitionBy("bucket").parquet(path)
