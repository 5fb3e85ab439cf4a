"""Licence scans by Dice coefficient over word bigrams, native expressions only.

Texts are compared by line and by paragraph (lines up to an empty one, if there
are several). A unit is normalised: ASCII lower case, anything but letters and
digits becomes a space. Its word bigrams, repeats included, are compared with
each licence template's. A Dice coefficient of t or more needs t/(2-t) to (2-t)/t as many
bigrams as the template has, so each template's number is listed under every
size that it can match, and units meet templates by equality joins on their
size and the number: no unit meets a template that the size bounds exclude.
Units too short or with too few or many words for any template go before
bigrams are made.

Texts are first searched for a few bigrams of each template by one pattern. A
unit within t shares t/(2-t) of a template's bigrams or more, so it has at least
one of any larger number than the rest: a text without them matches nothing.

Notices that share their line with other words, or run over lines that begin
with comment signs, are found by ``windows``: runs of words anywhere in a text,
of any length within the size bounds. The places of a template's bigrams in a
text are counted from each of them on; the best run from each place competes
with those that it overlaps, the greatest coefficient first, then the longest.
Runs that touch a line or paragraph already given for the same licence are left
out. Only texts with a needed bigram are written and cut into words, and only
places of template bigrams shuffle.

Lines and paragraphs alone are one scan; only matches shuffle. Templates are a
parameter; numbers by size and bigrams by number are broadcast up to a checked
number of rows and bytes each, beyond which the joins are salted.

Null texts have no units. Texts of a single word or none have no bigrams and
match nothing. Very long texts are searched and cut whole. Ties go to the
licence first by name. Repeated rows give repeated results. Other columns,
whatever their names, are not read. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mergeloom.llm.common import materialize, pick, sized_join

LEAST = 0.8
#: Bigrams that texts are searched for; with more, all texts are cut into units.
MOST_PAIRS = 2000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = r"\n[\x20\t\r]*\n"
#: Public licence notices: fixed values, (licence, wording).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)


def words(unit: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.translate(unit, UPPER, LOWER), "[^a-z0-9]+", " ")), " ")


def bigrams(words: Column) -> Column:
    """All word bigrams of an array of words, repeats included."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>"))


def common(a: Column, b: Column) -> Column:
    """The size of the intersection, each bigram as often as in both."""
    times = lambda x, g: F.size(F.filter(x, lambda y: y == g))
    each = F.transform(F.array_intersect(a, b), lambda g: F.least(times(a, g), times(b, g)))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def needed(templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(bigram): for each template as many bigrams (the longest) as leave too few
    others for a Dice coefficient of ``least``."""
    sets = templates.select(bigrams(words(F.col("wording"))).alias("b")).where(F.size("b") > 0)
    by_length = F.sort_array(F.transform("b", lambda g: F.struct((-F.length(g)).alias("l"), g.alias("g"))))
    enough = F.size("b") - F.ceil(F.size("b") * least / (2 - least) - 1e-9).cast("int") + 1
    return sets.select(F.explode(F.slice(by_length, F.lit(1), enough)).alias("s")).select(F.col("s.g").alias("bigram")).distinct()


def pattern(pairs: list[str]) -> str:
    """A pattern for texts that hold one of the bigrams, by first letter."""
    groups: dict[str, list[str]] = {}
    for pair in sorted(pairs):
        groups.setdefault(pair[0], []).append(pair[1:].replace(" ", "[^a-z0-9]+"))
    return "(?i)(?<![a-z0-9])(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in groups.items()) + ")(?![a-z0-9])"


def bounded(templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(tid, license, bigrams, of, low, high) from (license, wording): a row for
    each template, and from how many to how many bigrams a unit can have that
    matches it with ``least`` or more."""
    sets = templates.select("license", bigrams(words(F.col("wording"))).alias("bigrams")).withColumn("of", F.size("bigrams")).where("of > 0").distinct()
    low, high = F.ceil(F.col("of") * least / (2 - least) - 1e-9), F.floor(F.col("of") * (2 - least) / least + 1e-9)
    return sets.select(F.xxhash64("license", "bigrams").alias("tid"), "license", "bigrams", "of", F.greatest(low.cast("int"), F.lit(1)).alias("low"), high.cast("int").alias("high")).where("low <= high")


def units(text: Column) -> Column:
    """Structs (paragraph: 0 or 1, position from 0, unit): all lines, and the
    paragraphs of several lines."""
    cut = lambda pattern, kind: F.transform(F.split(text, pattern, -1), lambda x, i: F.struct(F.lit(kind).alias("paragraph"), i.alias("position"), x.alias("unit")))
    return F.concat(cut("\n", 0), F.filter(cut(BLANK, 1), lambda s: F.trim(s["unit"], F.lit(" \t\r\n")).contains("\n")))


def _places(texts: DataFrame) -> DataFrame:
    """(rid, doc_id, k, bigram, line, par, line1, par1): all bigrams of the texts
    from place 0, with the lines and paragraphs of their two words."""
    own = lambda x: F.filter(words(x), lambda y: y != "")
    cut = lambda pattern: F.flatten(F.transform(F.split("text", pattern, -1), lambda x, i: F.transform(own(x), lambda y: F.struct(y.alias("w"), i.alias("i")))))
    rows = texts.select("rid", "doc_id", F.arrays_zip(cut("\n").alias("l"), cut(BLANK).alias("p")).alias("a"))
    rest = F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))
    pairs = rows.select("rid", "doc_id", F.posexplode(F.zip_with(F.slice("a", 1, F.size(rest)), rest, lambda x, y: F.struct(x.alias("x"), y.alias("y")))).alias("k", "b"))
    return pairs.select(
        "rid", "doc_id", "k", F.concat_ws(" ", "b.x.l.w", "b.y.l.w").alias("bigram"),
        F.col("b.x.l.i").alias("line"), F.col("b.x.p.i").alias("par"), F.col("b.y.l.i").alias("line1"), F.col("b.y.p.i").alias("par1"),
    )


def windows(texts: DataFrame, found: DataFrame, templates: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, paragraph: 2, position: number of the first word, license, dice)
    from texts (rid, doc_id, text) beyond the units ``found`` (rid, paragraph,
    position, license)."""
    sets = templates.select("license", bigrams(words(F.col("wording"))).alias("g")).where(F.size("g") > 0).distinct()
    sets = sets.select(F.xxhash64("license", "g").alias("t"), "license", F.size("g").alias("of"), F.explode("g").alias("bigram"))
    sets = materialize(sets.groupBy("t", "license", "of", "bigram").agg(F.count("*").cast("int").alias("times")), "bigrams")
    most = sets.agg(F.max("times")).first()[0]
    if most is None:
        return found.sparkSession.createDataFrame([], "doc_id long, paragraph int, position int, license string, dice double")
    high = F.floor(F.col("of") * (2 - least) / least + 1e-9).cast("int")
    low = F.ceil(F.col("of") * least / (2 - least) - 1e-9)
    hits = sized_join(_places(texts), materialize(sets.groupBy("bigram").agg(F.collect_list(F.struct("t", "license", "of", "times")).alias("ts")), "wanted"), ["bigram"])
    hits = hits.withColumn("t", F.explode("ts")).select("*", "t.license", "t.of", "t.times", F.col("t.t").alias("id")).drop("t", "ts")
    # A bigram counts in a run from s on if fewer than ``times`` of its kind are from s to it.
    same = Window.partitionBy("rid", "id", "bigram").orderBy("k")
    past = F.coalesce(*[F.when(F.col("times") == n, F.lag("k", n).over(same)) for n in range(1, most + 1)], F.lit(-1))
    places = F.sort_array(F.collect_list(F.struct("k", "past", "line", "par", "line1", "par1")))
    runs = hits.withColumn("past", past).groupBy("rid", "doc_id", "id", "license", "of").agg(places.alias("h")).where(F.size("h") >= low)

    def best(x: Column, i: Column) -> Column:
        """The best run from place ``x`` on."""

        def longer(s: Column, y: Column) -> Column:
            n, c = y["k"] - x["k"] + 1, s["c"] + F.when(y["past"] < x["k"], 1).otherwise(0)
            run = F.struct((-F.round(2.0 * c / (n + F.col("of")), 6)).alias("d"), (-n).alias("n"), y["line1"].alias("line1"), y["par1"].alias("par1"))
            return F.struct(c.alias("c"), F.when(n <= high, F.least(s["run"], run)).otherwise(s["run"]).alias("run"))

        none = F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("n"), F.lit(0).alias("line1"), F.lit(0).alias("par1"))
        r = F.aggregate(F.slice("h", i + 1, high), F.struct(F.lit(0).alias("c"), none.alias("run")), longer)["run"]
        return F.struct(r["d"].alias("d"), r["n"].alias("n"), x["k"].alias("k"), F.col("license").alias("license"), x["line"].alias("line"), x["par"].alias("par"), r["line1"].alias("line1"), r["par1"].alias("par1"))

    runs = runs.select("rid", "doc_id", F.explode(F.filter(F.transform("h", best), lambda r: r["d"] <= -least)).alias("r"))
    runs = runs.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    # A run of n bigrams from word k on ends with word k - (-n).
    apart = lambda a, b: (a["k"] - a["n"] < b["k"]) | (b["k"] - b["n"] < a["k"])
    add = lambda chosen, r: F.when(F.forall(chosen, lambda o: apart(o, r)), F.concat(chosen, F.array(r))).otherwise(chosen)
    runs = runs.withColumn("rs", F.aggregate("rs", F.slice("rs", 1, 0), add))
    known = found.groupBy("rid").agg(F.collect_list(F.struct("paragraph", "position", "license")).alias("us"))
    within = lambda u, r: F.when(u["paragraph"] == 0, u["position"].between(r["line"], r["line1"])).otherwise(u["position"].between(r["par"], r["par1"]))
    new = F.filter("rs", lambda r: ~F.exists("us", lambda u: (u["license"] == r["license"]) & within(u, r)))
    runs = runs.join(known, "rid", "left").select("doc_id", F.explode(F.when(F.col("us").isNull(), F.col("rs")).otherwise(new)).alias("r"))
    return runs.select("doc_id", F.lit(2).alias("paragraph"), F.col("r.k").alias("position"), "r.license", (-F.col("r.d")).alias("dice"))


def license_scan(docs: DataFrame, templates: DataFrame | None = None, least: float = LEAST, anywhere: bool = False) -> DataFrame:
    """(doc_id, paragraph, position, license, dice): a row for each line and
    each paragraph that comes within ``least`` of a template, with the best;
    with ``anywhere`` also for other runs of words, see ``windows``."""
    spark: SparkSession = docs.sparkSession
    if templates is None:
        templates = spark.createDataFrame(list(TEMPLATES), "license string, wording string").coalesce(1)
    sets = materialize(bounded(templates, least), "templates")
    shortest, longest = sets.agg(F.min("low"), F.max("high")).first()
    if shortest is None:
        return spark.createDataFrame([], "doc_id long, paragraph int, position int, license string, dice double")
    sized = sets.select(F.explode(F.sequence("low", "high")).alias("n"), "tid").groupBy("n").agg(F.collect_list("tid").alias("tids"))
    sized = materialize(sized, "sizes")
    ready = pick(docs, doc_id="long", text="string")
    pairs = [r.bigram for r in needed(templates, least).limit(MOST_PAIRS + 1).collect()]
    has = F.col("text").rlike(pattern(pairs)) if len(pairs) <= MOST_PAIRS else F.lit(True)
    ready = ready.where(has).withColumn("rid", F.monotonically_increasing_id() if anywhere else F.lit(0).cast("long"))
    if anywhere:
        ready = materialize(ready, "texts")
    # n bigrams have n + 1 words, each of a byte or more and a byte apart.
    found = ready.select("rid", "doc_id", F.monotonically_increasing_id().alias("row"), F.explode(F.filter(units(F.col("text")), lambda s: F.octet_length(s["unit"]) > 2 * shortest)).alias("u"))
    found = found.select("rid", "doc_id", "row", "u.paragraph", "u.position", words(F.col("u.unit")).alias("words")).withColumn("n", F.size("words") - 1)
    found = found.where(F.col("n").between(shortest, longest))
    # Numbers of templates by size, then the templates: bigrams are broadcast once each, up to a checked number of bytes.
    met = sized_join(found.withColumn("own", bigrams(F.col("words"))).drop("words"), sized, ["n"], weight=F.size("tids") * 8)
    met = met.withColumn("tid", F.explode("tids")).drop("tids")
    weight = F.aggregate("bigrams", F.lit(0), lambda a, g: a + F.octet_length(g) + 16)
    met = sized_join(met, sets.select("tid", "license", "bigrams"), ["tid"], weight=weight)
    dice = F.round(2.0 * common(F.col("own"), F.col("bigrams")) / (F.size("own") + F.size("bigrams")), 6)
    met = met.withColumn("dice", dice).where(F.col("dice") >= least)
    best = met.groupBy("rid", "doc_id", "paragraph", "position", "row").agg(F.min(F.struct((-F.col("dice")).alias("d"), "license")).alias("b"))
    out = best.select("rid", "doc_id", "paragraph", "position", "b.license", (-F.col("b.d")).alias("dice"))
    if not anywhere:
        return out.drop("rid")
    out = materialize(out, "found")
    return out.drop("rid").union(windows(ready, out, templates, least))


def oracle_sql() -> str:
    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in TEMPLATES)
    words = lambda x: f"string_split(trim(regexp_replace(translate({x}, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')), ' ')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    times = lambda x: f"len(list_filter({x}, lambda y: y = g))"
    return f"""
        with t as (select license, {pairs} as b from (select license, {words("wording")} as w from (values {rows}) v(license, wording))),
        u as (select doc_id, 0 as paragraph, unnest(ls) as unit, generate_subscripts(ls, 1) - 1 as position
                from (select doc_id, string_split(text, chr(10)) as ls from documents)
              union all select doc_id, 1, unnest(ps), generate_subscripts(ps, 1) - 1
                from (select doc_id, string_split_regex(text, '{BLANK}') as ps from documents)),
        n as (select doc_id, paragraph, position, {pairs} as a from (select *, {words("unit")} as w from u
                where paragraph = 0 or contains(trim(unit, ' ' || chr(9) || chr(13) || chr(10)), chr(10)))),
        d as (select doc_id, paragraph, position, license, round(2.0::double * coalesce(list_sum(list_transform(list_intersect(a, b),
                lambda g: least({times("a")}, {times("b")}))), 0) / (len(a) + len(b)), 6) as dice
              from n join t on len(a) between ceil(len(b) * {LEAST} / (2 - {LEAST}) - 1e-9) and floor(len(b) * (2 - {LEAST}) / {LEAST} + 1e-9))
        select doc_id, paragraph::int as paragraph, position::int as position, min_by(license, (-dice, license)) as license, max(dice) as dice
        from d where dice >= {LEAST} group by doc_id, paragraph, position"""
