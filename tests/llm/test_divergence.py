from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from conftest_llm import SCHEMA, rows_of
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mergeloom.llm import divergence

LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(rows, least, top=10):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms_of(text))
        docs[lang].update(set(terms_of(text)))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        others = sorted(s for g, s in groups if g == lang)
        total = {s: sum(counts[lang, s][t] for t in kept) for s in others}
        share = lambda n, m: 1 + 1_000_000_000 * (n + 2) // (m + 2 * len(kept))  # noqa: B023, E731
        f = lambda p, q: (p - q) ** 2 // (p + q)
        own = {t: share(counts[lang, source][t], total[source]) for t in kept}
        pairs = [(sum(f(own[t], share(counts[lang, s][t], total[s])) for t in kept), s) for s in others if s != source]
        whole = sum(total.values())
        q = {t: share(sum(counts[lang, s][t] for s in others), whole) for t in kept}
        found = [(f(own[t], q[t]), t) for t in kept if counts[lang, source][t] and own[t] > q[t]]
        rank = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1].encode()))
        out += [(lang, source, "pair", s, v, i + 1) for i, (v, s) in enumerate(rank(pairs))]
        out += [(lang, source, "term", t, v, i + 1) for i, (v, t) in enumerate(rank(found)[:top])]
    return sorted(map(repr, out))


def test_same_as_brute_force(docs, odd):
    rows = [tuple(r) for r in docs.collect()]
    want = brute(rows, 3)
    assert rows_of(divergence.divergence(docs, 3)) == want
    assert rows_of(divergence.divergence(odd, 3)) == want
    # Tiles, chunks and runs of the least sizes: many blocks, many partial matrices.
    assert rows_of(divergence.divergence(docs, 3, block=1, chunk=5, run_length=2)) == want
    assert rows_of(divergence.divergence(docs, 3, block=2, chunk=7, run_length=1)) == want


def test_many_sources_ties_and_unkept_languages(spark):
    rng = random.Random(4)
    words = [a + b for a in "abcdé漢" for b in "xyz"]
    rows = [(i, " ".join(rng.choice(words[: 4 + i % 14]) for _ in range(i % 40)).upper(), rng.choice(["u", "v", None]), f"s{rng.randrange(23)}", 0) for i in range(400)]
    rows += [(900 + i, "only once" if i else None, "w", f"t{i}", 0) for i in range(3)]  # no kept term
    rows += [rows[0]] * 30 + [(990, "same word " * 20, "tie", s, 0) for s in ("a", "b", "c")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = divergence.divergence(df, 3, block=4, chunk=3, run_length=2)
    assert rows_of(got) == brute(rows, 3)
    assert {r.value for r in got.where("lang in ('tie', 'w') and part = 'pair'").collect()} == {0}


def test_empty_table(none):
    assert rows_of(divergence.divergence(none)) == []


def test_texts_of_megabytes(spark):
    rows = [(i, "Ab漢 cd-" * 400_000 + "x" * 1_500_000, "a", f"s{i % 2}", 0) for i in range(4)]
    assert rows_of(divergence.divergence(spark.createDataFrame(rows, SCHEMA), 2)) == brute(rows, 2)


@given(st.text(max_size=60))
def test_terms(text):
    assert divergence.found_terms(text.encode("utf-8", "ignore")) == Counter(t.encode() for t in terms_of(text.encode("utf-8", "ignore").decode()))


def test_a_small_dictionary_gives_the_same(spark, docs, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 20)
    counts = divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs"))
    monkeypatch.undo()
    assert rows_of(counts) == rows_of(divergence.term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("docs")))


@given(st.lists(st.integers(0, 10**13), min_size=1, max_size=5), st.integers(1, 10**6))
def test_shares_are_exact(counts, kept):
    total = sum(counts) + 2 * kept
    got = divergence.shares(np.array(counts, np.int64), np.array(total, np.int64))
    assert got.tolist() == [1 + 10**9 * (n + 2) // total for n in counts]
