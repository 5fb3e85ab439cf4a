"""Secret scans, licence scans and token counts."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from conftest_llm import rows_of
from pyspark.sql import functions as F

from mergeloom.llm import licenses, secrets, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def secret_texts():
    rng = random.Random(4)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    key, copied, live = "AKIA" + "ABCDEFGH12345678", hexed(40), "ghp_" + "Zx9" * 13
    shared = "ghp_" + "Qq7" * 14
    texts = [
        f"x password={hexed(18)} y", f"é漢🙂 ToKeN = \"{hexed(40)}\" {key} end", "token: secret:abcdefghijklmnop", "token=secret=abcdefghijklmnop api_key='abcdefghijkl' apikey=short",
        "AKIA123 AKIAKIAKIAKIAKIAKIA AKIA", hexed(15) + " " + hexed(16), "passwd:" + "a" * 11 + " passwd:" + "b" * 12, f"secret {copied}", f"secret={copied}", f"secret={copied}",
        f"secret={copied}", f"my {live} there", f"this {shared} is", f"this {shared} is", f"this {shared} is", "", None, "  ", " ".join(f"password={hexed(20)}" for _ in range(700)),
        "-----BEGIN RSA PRIVATE KEY----- é xoxb-1234567890-ab", "ſecret=abcdefghijklmnop ſ token=abcdefghijklmn", "api-key=abcdefghijklmnop APIKEY\"   :   'ab+/_.=-cdefgh", "password\n=abcdefghijklmnopq password=\nabcdefghijklmn",
    ]
    sources = ["s1", "s2", "s3", None]
    return [(i if i != 7 else None, t, "a", sources[i % 4], 0) for i, t in enumerate(texts)] + [(2, texts[2], "a", "s3", 0)] * 2


def plain_spans(text):
    text, out = text or "", []
    for m in re.compile(ASSIGN.pattern, re.IGNORECASE | re.ASCII).finditer(text):
        if not set(m[1]) <= set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_"):
            continue
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end(), m[2]))
    out += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 3, m.end(), m[0]) for m in re.finditer(secrets.PATTERNS["token"], text)]
    return sorted(out)


def named(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans)


def brute_secrets(rows, most_repos=secrets.MOST_REPOS):
    owners, repos = defaultdict(set), defaultdict(set)
    for d, t, _, source, _ in rows:
        for *_, v in plain_spans(t):
            owners[v].add(source)
            repos[v].add((source, d))
    out = []
    for d, t, *_ in rows:
        spans = plain_spans(t)
        live = [s for s in spans if len(owners[s[3]]) <= secrets.MOST_OWNERS and len(repos[s[3]]) <= most_repos]
        base = [s for s in spans if s[1] < 3]
        n = Counter(s[1] for s in spans)
        most = [max((len(x[s[3]]) for s in spans), default=0) for x in (owners, repos)]
        out.append((d, n[0], n[1], n[2], named(base), named([s for s in spans if s[1] < 3 or s in live]), len(live), len(spans) - len(live), *most))
    return sorted(map(repr, out))


def test_secrets_as_brute_force(spark):
    rows = secret_texts()
    rows += [(900 + i, "this ghp_" + "Ww3" * 13, "a", "s1", 0) for i in range(4)]
    rows += [(950, "é filler " * 200_000 + "password=" + "Zz9" * 9, "a", "s1", 0)]  # a text of megabytes
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert rows_of(secrets.secret_scan(df)) == brute_secrets(rows)
    few = secrets.secret_scan(df, most_repos=3)
    assert rows_of(few) == brute_secrets(rows, 3) != brute_secrets(rows)
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("spans", "row", "owner", "repo", "TEXT", "hash", "_m_hex", "live", "n_repos")])
    assert rows_of(secrets.secret_scan(odd)) == brute_secrets(rows)


def test_running_sums_by_blocks(spark):
    xs = list(range(1, 1000))
    got = spark.range(1).select(secrets._running(F.array(*[F.lit(x).cast("long") for x in xs])).alias("s")).first().s
    assert got == [sum(xs[:i]) for i in range(len(xs))]


def test_redaction(spark):
    rows = secret_texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = secrets.redact(df)
    assert out.columns == df.columns and out.count() == len(rows)
    texts = [r.text for r in out.collect()]
    assert all(not [s for s in plain_spans(t) if s[1] < 3] for t in texts)
    joined = " ".join(t for t in texts if t)
    assert "<secret>" in joined and "<example-secret>" in joined and "my <secret> there" in joined and "this ghp_Qq7Qq7" in joined
    assert "token: secret:abcdefghijklmnop" in joined and "é漢🙂" in joined
    assert {r.n_chars for r in out.where("text = 'x password=<secret> y'").collect()} == {21}


def test_no_documents(spark, none):
    assert rows_of(secrets.secret_scan(none)) == [] and rows_of(secrets.redact(none)) == [] and rows_of(licenses.license_scan(none)) == []


# Licences ---------------------------------------------------------------


def plain_words(unit):
    return re.sub("[^a-z0-9]+", " ", "".join(c.lower() if c in licenses.UPPER else c for c in unit)).strip(" ").split(" ")


def pairs(words):
    return Counter(zip(words, words[1:], strict=False))


def brute_licenses(rows, templates=licenses.TEMPLATES, least=licenses.LEAST):
    out = []
    for d, text, *_ in rows:
        if text is None:
            continue
        found = [(0, i, u) for i, u in enumerate(text.split("\n"))]
        found += [(1, i, u) for i, u in enumerate(re.split(licenses.BLANK, text)) if "\n" in u.strip(" \t\r\n")]
        for kind, i, unit in found:
            a = pairs(plain_words(unit))
            best = []
            for name, wording in templates:
                b = pairs(plain_words(wording))
                if a and b:
                    best.append((-round(2 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), 6), name))
            if best and -min(best)[0] >= least:
                out.append((d, kind, i, min(best)[1], -min(best)[0]))
    return sorted(map(repr, out))


def license_texts():
    mit, gpl = licenses.TEMPLATES[-2][1], "This work is licensed under the GNU General Public License, version 3."
    wrapped = "\n".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    texts = [
        "prose\nReleased under the MIT License.\nmore prose", "LICENSED UNDER THE APACHE LICENSE -- VERSION 2.0!!", gpl + " Really.", gpl * 2, wrapped, "intro\n\n" + wrapped + "\n \t\nend",
        "Licensed under", "word", "", None, "\n\n\n", "Licensed under CC BY-NC 4.0", "licensed under the licensed under the licensed under the", "the " * 50_000 + "\n" + gpl, "RéviséK " + gpl, "This work is licensed under the GNU General Public License, version 2 or version 3.",
    ]
    return [(i, t, "a", None, 0) for i, t in enumerate(texts)] + [(0, texts[0], None, None, None)] * 2 + [(None, gpl, None, None, None)]


def test_licenses_as_brute_force(spark):
    rows = license_texts()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = brute_licenses(rows)
    assert len(want) == 12
    assert rows_of(licenses.license_scan(df)) == want
    odd = df.select("*", *[F.lit("x").alias(c) for c in ("n", "words", "unit", "wanted", "license", "Text")])
    assert rows_of(licenses.license_scan(odd)) == want


def brute_runs(text, templates=licenses.TEMPLATES, least=licenses.LEAST):
    """(position, end, license, dice) of runs of words: the best from each word
    on, then those that no better one overlaps."""
    words = [w for w in plain_words(text or "") if w]
    runs = []
    for name, wording in templates:
        b = pairs(plain_words(wording))
        m = sum(b.values())
        for i in range(len(words) - 1 if m else 0):
            if (words[i], words[i + 1]) in b:
                ends = range(i + 1, min(len(words), i + 1 + int(m * (2 - least) / least + 1e-9)))
                dice = lambda j: round(2 * sum((pairs(words[i : j + 1]) & b).values()) / (j - i + m), 6)  # noqa: B023, E731
                d, n = min((-dice(j), i - j) for j in ends)
                runs += [(d, n, i, name)] if d <= -least else []
    chosen = []
    for d, n, i, name in sorted(runs):
        if all(i - n < k or k - l < i for _, l, k, _ in chosen):
            chosen.append((d, n, i, name))
    return [(i, i - n, name, -d) for d, n, i, name in chosen]


def test_notices_among_other_words(spark):
    mit = licenses.TEMPLATES[-2][1]
    commented = "/*\n" + "\n".join(" * " + " ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9)) + "\n */\n" + "int main; " * 60
    gpl = "This work is licensed under the GNU General Public License, version 3."
    texts = [
        "Copyright 2020 Ada. Released under the MIT License.", "He said: " + mit + " and so on, and so on, for many more words than those of the notice itself " * 3, commented, gpl * 3,
        "a b c\n\nLicensed under the really Apache License, Version 2.0 x y", "no notice", "", None, "word", gpl, "x\n" + gpl + "\ny", "# Released under\n# the MIT License. # end of it\nand more",
    ]
    full = next(w for _, w in licenses.TEMPLATES if w.startswith("Permission is hereby") and "AS IS" in w).split()
    texts.append("/*\n" + "\n *\n".join("\n".join(" * " + " ".join(part[i : i + 9]) for i in range(0, len(part), 9)) for part in (full[:70], full[70:95], full[95:])) + "\n */\n\nint x;")
    rows = [(i, t, "a", None, 0) for i, t in enumerate(texts)] + [(0, texts[0], "a", None, 0)]
    units = brute_licenses(rows)
    want = sorted(units + [repr((d, 2, i, name, x)) for d, t, *_ in rows if d not in (9, 10, 12) for i, _, name, x in brute_runs(t)])
    got = rows_of(licenses.license_scan(spark.createDataFrame(rows, SCHEMA).repartition(3), anywhere=True))
    assert got == want and {eval(r)[0] for r in want} >= {0, 1, 2, 3, 4, 9, 10, 11, 12}
    rng = random.Random(6)
    own = [(f"L{i}", " ".join(rng.choice("abc") for _ in range(rng.randrange(1, 8)))) for i in range(6)]
    rows = [(i, " ".join(rng.choice("abcd") for _ in range(rng.randrange(1, 40))) + " d d d d d d d d d d d d d d d d d d", None, None, None) for i in range(60)]
    got = licenses.license_scan(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(own, "license string, wording string"), anywhere=True)
    assert rows_of(got) == sorted(repr((d, 2, i, name, x)) for d, t, *_ in rows for i, _, name, x in brute_runs(t, own))


def test_other_templates(spark):
    rng = random.Random(1)
    words = ["aa", "bb", "cc", "dd"]
    own = [(f"L{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9))), None, None, None) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    for least in (0.5, 0.8, 1.0):
        got = licenses.license_scan(df, spark.createDataFrame(own, "license string, wording string"), least)
        assert rows_of(got) == brute_licenses(rows, own, least)
    assert rows_of(licenses.license_scan(df, spark.createDataFrame([("x", "word")], "license string, wording string"))) == []


# Token counts ---------------------------------------------------------------


def one(docs):
    """The documents with a count of one token each."""
    return docs.withColumn("n1", F.lit(1))


def test_rollup_of_all_kinds_of_changes(spark, docs, odd, tmp_path):
    want = defaultdict(lambda: [0, 0])
    for r in docs.collect():
        for name, version in (("words", "words-2"), ("pieces", "pieces-1")):
            want[r.source, r.lang, name][0] += 1
            want[r.source, r.lang, name][1] += len(re.findall(token_counts.VERSIONS[version], r.text or ""))
    want = sorted(repr((*k, *v)) for k, v in want.items())
    for name, df in (("a", docs), ("b", odd)):
        rollup = token_counts.maintained(df, f"{tmp_path}/{name}")
        assert rows_of(rollup.totals()) == want
        assert all(map(rollup.committed, ("load", "pieces", "recount", "takedown", "restored"))) and not rollup.committed("other")
        assert rollup._folders("batch") == ["restored"]
    assert rollup.commit("load", token_counts.inserts(one(docs), "words", "n1")) is False
    rollup.compact()
    assert rows_of(rollup.totals()) == want and rollup._folders("batch") == []
    again = token_counts.Rollup(spark, rollup.path)
    assert again.commit("takedown", token_counts.inserts(one(docs), "words", "n1")) is False
    five = docs.withColumn("five", F.lit(5))
    assert again.commit("undo/é %", token_counts.deletes(five, "none", "five")) is True
    again.compact()
    assert again.commit("undo/é %", token_counts.deletes(five, "none", "five")) is False
    assert again.totals().where("tokenizer = 'none'").agg(F.sum("docs"), F.sum("tokens")).first() == (-docs.count(), -5 * docs.count())


def test_stored_counts_are_revised_and_deleted(spark, docs, tmp_path):
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    stored = spark.createDataFrame([("s", "a", 7, 9), ("s", "a", None, 4), ("t", None, 3, None)], "source string, lang string, old long, new long")
    rollup.commit("in", token_counts.inserts(stored, "x", "old"))
    rollup.commit("new", token_counts.revisions(stored, "x", "old", "new"))
    assert rows_of(rollup.totals()) == ["('s', 'a', 'x', 2, 13)", "('t', None, 'x', 1, 0)"]
    rollup.commit("out", token_counts.deletes(stored, "x", "new"))
    assert rows_of(rollup.totals()) == []


def test_counts_of_all_versions_in_one_pass(docs, odd, none):
    from tokenizers import Tokenizer

    import public_tokenizers

    versions = [*token_counts.VERSIONS, *token_counts.FILES]
    rows = {r.text or "" for r in docs.collect()}
    files = {v: Tokenizer.from_file(public_tokenizers.path(f"{v}.json")) for v in token_counts.FILES}
    plain = lambda t: tuple(len(re.findall(p, t)) for p in token_counts.VERSIONS.values()) + tuple(len(f.encode(t, add_special_tokens=False).ids) for f in files.values())
    want = sorted(repr((r.doc_id, *plain(r.text or ""))) for r in docs.collect())
    out = token_counts.counted(docs, versions)
    assert out.columns == [c for c in docs.columns if c != "text"] + [f"n_{v}" for v in versions] and rows
    assert rows_of(out.select("doc_id", *[F.col(f"n_{v}") for v in versions])) == want
    assert rows_of(token_counts.counted(odd, versions).toDF(*[f"c{i}" for i in range(len(odd.columns) - 1 + len(versions))]).select("c0", *[f"c{len(odd.columns) - 1 + i}" for i in range(len(versions))])) == want
    assert token_counts.counted(none, versions).count() == 0
    with pytest.raises(ValueError, match="no tokenizer"):
        token_counts.counted(docs, ["words-3"])


def test_race_for_a_batch(spark, docs, tmp_path, monkeypatch):
    a, b = (token_counts.Rollup(spark, f"{tmp_path}/r") for _ in range(2))
    changes = token_counts.inserts(one(docs), "t", "n1")
    monkeypatch.setattr(b, "committed", lambda _: False)  # b looked before a was done
    assert a.commit("x", changes) is True and b.commit("x", changes) is False
    assert a.totals().agg(F.sum("docs")).first()[0] == docs.count()


def test_a_batch_that_comes_while_others_are_folded_counts_once(spark, docs, tmp_path, monkeypatch):
    a, b = (token_counts.Rollup(spark, f"{tmp_path}/r") for _ in range(2))
    changes, n = token_counts.inserts(one(docs), "t", "n1"), docs.count()
    total = lambda: b.totals().agg(F.sum("docs")).first()[0]
    a.commit("first", changes)
    sums, late = a._sums, iter(["second", "third"])

    def with_a_late_commit(*parts):
        assert b.commit(next(late), changes)
        return sums(*parts)

    monkeypatch.setattr(a, "_sums", with_a_late_commit)
    a.compact()
    assert total() == 2 * n and b._folders("batch") == ["second"]
    a.compact()
    assert total() == 3 * n and b._folders("batch") == ["third"]
    assert not any(b.commit(x, changes) for x in ("first", "second", "third")) and total() == 3 * n


def test_rollup_without_rows(spark, none, tmp_path):
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    assert rows_of(rollup.totals()) == []
    assert rollup.commit("", token_counts.inserts(one(none), "t", "n1")) is True
    assert rollup.commit("", token_counts.inserts(one(none), "t", "n1")) is False
    assert rows_of(rollup.totals()) == []


def test_null_changes_count_as_zero(spark, tmp_path):
    rollup = token_counts.Rollup(spark, f"{tmp_path}/r")
    rollup.commit("a", spark.createDataFrame([(None, None, None, 1, None), (None, None, None, None, 3)], token_counts.SCHEMA))
    assert rows_of(rollup.totals()) == ["(None, None, None, 1, 3)"]
    with pytest.raises(KeyError):
        token_counts.tokens("unknown")
