from __future__ import annotations

import zlib

import numpy as np
from conftest_llm import rows_of
from hypothesis import given, settings
from hypothesis import strategies as st

from mergeloom.llm import packing

IDS = packing.WordIds(packing.word_bpe_path())


def library(text: str) -> list[int]:
    return IDS.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=300)
@given(st.text() | st.text(alphabet="aZé'sßÀ×tre1 \n\t.,<|½ İſ") | st.sampled_from(["<|endoftext|>", "I'll 'store' ''s", "á", "İΣ Σ", "\x85\xa0"]))
def test_ids_are_the_librarys(text):
    assert np.frombuffer(IDS(text), "<u4").tolist() == library(text)


def test_words_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(packing, "KEPT_WORDS", 3)
    own = packing.WordIds(packing.word_bpe_path())
    for text in ("a bb ccc dddd eeeee", "a bb x y z w", "eeeee a", "a bb", "c " + "d" * 100, "a c", "bb f", "a"):
        assert np.frombuffer(own(text), "<u4").tolist() == library(text)
        assert len(own.words) <= 3 and len(own.before) <= 3


def test_other_tokenizers_go_to_the_library():
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = packing.WordIds(path)
    assert IDS.by_word and not own.by_word
    for text in ("Hello  world's\n end", "", "é 1234"):
        assert np.frombuffer(own(text), "<u4").tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids
    assert packing.word_ids() is packing.word_ids()


@given(st.integers(0, 50_000), st.sampled_from([1, 8, 4096]))
def test_lengths_are_powers_of_two(n, most):
    out = packing.lengths(n, most)
    assert sum(out) == n and all(x & (x - 1) == 0 and x <= most for x in out)
    assert out == sorted(out, reverse=True)


def test_pieces_make_up_the_documents(docs, odd):
    packed = packing.pack(docs).collect()
    want = sorted(repr((r.doc_id, [*library(r.text or ""), 2])) for r in docs.collect())
    runs, at = [], 0
    for p in packed:  # pieces of a document follow one another
        if p.start == 0:
            runs.append((p.doc_id, []))
            at = 0
        assert p.start == at and p.length == len(p.ids) and p.offset == 0
        at += p.length
        runs[-1][1].extend(p.ids)
        if at == p.doc_tokens:
            at = None
    assert sorted(map(repr, runs)) == want
    assert len({p.sequence_id for p in packed}) == len(packed)
    seats = {(p.batch_id, p.batch_row) for p in packed}
    assert len(seats) == len(packed) and all(p.length == 1 << p.bucket for p in packed)
    by_batch = {}
    for p in packed:
        by_batch.setdefault(p.batch_id, set()).add(p.length)
    assert all(len(x) == 1 for x in by_batch.values())
    assert all(p.batch_row < packing.BATCH_TOKENS // p.length for p in packed)
    digested = packing.digests(packing.pack(docs)).collect()
    assert sorted(d.ids_crc32 for d in digested) == sorted(zlib.crc32(np.array(p.ids, "<u4").tobytes()) for p in packed)
    assert packing.pack(odd).count() == len(packed)


def test_empty_table_and_buckets(none, docs, spark, tmp_path):
    assert rows_of(packing.pack(none)) == [] and rows_of(packing.digests(packing.pack(none))) == []
    packing.write_buckets(packing.pack(docs), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b/bucket=12").where("length != 4096").count() == 0


def test_workers_let_go_of_the_tokenizer():
    """It stays for packing's next task in a worker, not beside other operators' tasks."""
    from mergeloom.llm import common

    kept = packing.word_ids()
    list(common.batches([], keep=packing.word_ids))
    assert packing.word_ids() is kept
    list(common.batches([]))
    assert packing.word_ids() is not kept
