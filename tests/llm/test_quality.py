from __future__ import annotations

import re
from collections import Counter

import numpy as np
from conftest_llm import rows_of
from hypothesis import given
from hypothesis import strategies as st

from mergeloom.llm import classifier, quality_rules


def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


@given(st.text(alphabet="ab \n\t\x0b#|é漢", max_size=60))
def test_counts(text):
    assert quality_rules.counts(text.encode()) == plain_counts(text)


def test_rules(docs, odd):
    want = sorted(repr((r.doc_id, *plain_counts(r.text))) for r in docs.collect())
    out = quality_rules.quality_rules(docs).select("doc_id", *quality_rules.COUNTS, "base_failed", "kept").collect()
    assert sorted(repr(tuple(r)[:6]) for r in out) == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out)
    assert not any(r.kept and r.base_failed for r in out)
    kept = quality_rules.passing(docs)
    assert kept.columns == docs.columns and sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r.doc_id) for r in out if r.kept)
    assert quality_rules.passing(odd).columns == odd.columns


def test_outliers_fall_and_plain_texts_stay(spark, docs):
    plain = [tuple(r) for r in docs.collect() if r.text and r.doc_id is not None and r.doc_id < 60] * 3
    symbols = " ".join(w + "***" for w in plain[0][1].split())
    table = spark.createDataFrame([*plain, (900, symbols, "a", "s1", 0)], docs.schema)
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(table).collect()}
    assert verdict.pop(900) is False and all(verdict.values())


def brute_kept(rows):
    """Verdicts row by row, with exact quantiles."""
    found = [(r, *plain_counts(r[1])) for r in rows]
    failed = [n < 50 or 100 * rep > 50 * n for _, n, _, _, _, rep in found]
    values = [(c / max(n, 1), s / max(c, 1), 10 * d / max(n, 1), rep / max(n, 1), n, c) for _, n, c, s, d, rep in found]
    groups = {}
    for r, v, f in zip(rows, values, failed, strict=True):
        if not f:
            groups.setdefault((r[2], r[3]), []).append(v)
    q = lambda own, p: np.quantile(np.array(own), p, axis=0, method="inverted_cdf")
    centre = lambda own: (q(own, 0.5), np.minimum(q(own, 0.75) - q(own, 0.5), q(own, 0.5) - q(own, 0.25)))
    every = centre([v for own in groups.values() for v in own])
    out = []
    for r, v, f in zip(rows, values, failed, strict=True):
        if f:
            out.append(False)
            continue
        own = groups[r[2], r[3]]
        mid, spread = ((len(own) * a + 40 * b) / (len(own) + 40) for a, b in zip(centre(own), every, strict=True))
        grain = np.array([1 / np.sqrt(mid[4]), 1 / mid[5], 10 / mid[4], 6 / mid[4]])
        reach = 24 * np.maximum(spread[:4], grain)
        away = np.array(v[:4]) - mid[:4]
        out.append(bool((away <= reach).all() and away[0] >= -reach[0]))
    return out


def test_verdicts_are_those_of_exact_quantiles(spark, docs):
    rng = np.random.default_rng(5)
    rows = [tuple(r) for r in docs.collect()]
    words = rows[0][1].split()
    for i in range(60):  # ever more symbols, long words, repeated lines and windows
        picked = [str(w) for w in rng.choice(words, 90)]
        text = [" ".join(w + "#" * (j < i // 4) for j, w in enumerate(picked)), " ".join(w + "x" * (i // 8) for w in picked), " ".join(picked) + "\nsame line" * (i // 4), " ".join(picked + picked[: i // 2 * 3])][i % 4]
        rows.append((2000 + i, text, "a", ["s1", "s2", "new"][i % 3], 0))
    got = quality_rules.quality_rules(spark.createDataFrame(rows, docs.schema).repartition(3))
    again = quality_rules.passing(spark.createDataFrame(rows, docs.schema).repartition(2))
    want = Counter(repr((r[0], k)) for r, k in zip(rows, brute_kept(rows), strict=True))
    assert Counter(repr((r.doc_id, r.kept)) for r in got.collect()) == want
    assert Counter(repr((r.doc_id, True)) for r in again.collect()) == Counter({k: n for k, n in want.items() if "True" in k})
    assert 5 < sum(not k for k in brute_kept(rows)) < len(rows) / 2


def test_junk_of_a_third_does_not_open_the_fences(spark, docs):
    rng = np.random.default_rng(3)
    prose = lambda size: " ".join("".join(rng.choice(list("abcdefgh"), size)) for _ in range(80))
    good = [(i, prose(5), "a", "hot", 0) for i in range(70)]
    for at, junk in enumerate((lambda: prose(5).replace("a", "#*"), lambda: prose(1) + prose(2), lambda: prose(14))):
        table = spark.createDataFrame(good + [(1000 + 100 * at + i, junk(), "a", "hot", 0) for i in range(30)], docs.schema)
        for kept in (quality_rules.quality_rules(table).where("kept"), quality_rules.passing(table)):
            assert sorted(r.doc_id for r in kept.collect()) == list(range(70))


def test_merged_sketches_are_those_of_all_rows(spark):
    schema = "lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"
    rows = spark.createDataFrame([("ab"[i % 2], None if i % 3 else "s", 100, 400 + i, i % 5, 0, 0, i % 11 == 0) for i in range(2000)], schema)
    stored = quality_rules.sketches(rows)
    both = quality_rules.merged(stored.where("lang = 'a'").unionByName(stored.where("lang = 'b'")))
    c = quality_rules.centers(both).first()
    passing = sorted(4 + i / 100 for i in range(2000) if i % 11)
    q = lambda p: passing[int(p * len(passing))]
    assert c.n == len(passing) and abs(c.mid_mean_word - q(0.5)) < 0.5 and abs(c.spread_mean_word - (q(0.75) - q(0.5))) < 0.5


def test_empty_tables(none, spark):
    assert rows_of(quality_rules.quality_rules(none)) == [] and rows_of(quality_rules.passing(none)) == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert rows_of(classifier.classify(none, labels)) == []


@given(st.text(max_size=80))
def test_statistics_are_finite(text):
    x = classifier.statistics(text.encode("utf-8", "ignore"))
    assert len(x) == classifier.D and np.isfinite(x).all()


def test_scores_are_the_textbooks(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(200, classifier.D)), rng.normal(1.0, 2.0, size=(100, classifier.D))
    c = classifier.CENTER
    sums = [np.array([f(a - c), f(b - c)]) for f in (lambda x: float(len(x)), lambda x: x.sum(0), lambda x: x.T @ x)]
    m = classifier.discriminant(*sums, shrink=0.0, ridge=0.0)

    def density(x, own, share):
        c = np.cov(own.T, bias=True)
        d = x - own.mean(0)
        return np.log(share) - 0.5 * (np.linalg.slogdet(c)[1] + np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d))

    x = rng.normal(0.5, 1.5, size=(50, classifier.D))
    want = 1 / (1 + np.exp(density(x, a, 2 / 3) - density(x, b, 1 / 3)))
    assert np.allclose(m.scores(x), want)


def test_statistics_and_sums_by_partition(spark, docs):
    """A text's statistics by their definitions, and the model from rows in any
    number of partitions, as from one array."""
    text = "Ab cd. Ab cd! x1\n\nAb cd. Ab cd! x1\nLast #line"
    words = text.split()
    x = classifier.statistics(text.encode())
    sizes, chars = [len(w) for w in words], sum(map(len, words))
    share = lambda part, whole: np.log(part / whole + 1e-3)
    letters = sum(c.isalpha() for c in text)
    want = [
        np.log1p(12), np.mean(sizes), np.log1p(np.std(sizes)), share(1, chars), share(4, chars), share(2, chars), share(5, chars), share(chars - letters, chars),
        6 / 12**0.85, np.sqrt(10 / 12), np.sqrt(1 / 3), np.log1p(12 / 3), share(4, 12),
    ]
    assert np.allclose(x, want)
    rng = np.random.default_rng(4)
    rows = [(int(i % 3 == 0), rng.normal(2.0 * (i % 3), 1.0, classifier.D).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "label int, x array<double>")
    a, b = (np.array([v for k, v in rows if k == c]) for c in (0, 1))
    sums = [np.array([f(a - classifier.CENTER), f(b - classifier.CENTER)]) for f in (lambda x: float(len(x)), lambda x: x.sum(0), lambda x: x.T @ x)]
    want, points = classifier.discriminant(*sums), rng.normal(2.0, 2.0, (40, classifier.D))
    for n in (1, 7):
        assert np.allclose(classifier.fit(table.repartition(n)).scores(points), want.scores(points), atol=1e-9)


def test_learns_and_scores(spark, docs, odd):
    junk = [(1000 + i, " ".join(w + "$$$" for w in r.text.split()), "a", "s1", 0) for i, r in enumerate(docs.collect()) if r.text]
    table = docs.unionByName(spark.createDataFrame(junk, docs.schema))
    ids = [r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id < 60]
    rows = [(i, 1) for i in set(ids)] + [(j[0], 0) for j in junk] + [(None, 1), (3, None), (4, 0), (99999, 1), (2, 7), (1, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int").selectExpr("*", "'x' as label", "1 as score")
    out = classifier.classify(table, labels).collect()
    assert len(out) == table.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    held = [r for r in out if r.held_out]
    good = [r for r in held if r.doc_id in ids]
    bad = [r for r in held if r.doc_id >= 1000]
    assert np.mean([r.predicted for r in good]) >= 0.9 and np.mean([r.predicted for r in bad]) <= 0.1
    assert classifier.classify(odd, labels.limit(0)).where("score != 0.5").count() == 0
