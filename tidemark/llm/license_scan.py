"""Licence scans by a trained paragraph classifier, in DataFrame operations only.

A paragraph (a line of text, a window of one that is long, or the words of a notice that is
wrapped over any number of lines) is read as its distinct word uni- and bigrams, each hashed to a weight of a multinomial logistic
regression over licence families, one class for licences that are none of these, and one
for all else. The regression is trained on rule-made variants of the families' notices, on
notices with names of other licences, on plain sentences that use the same words, and on a
bounded sample of paragraphs of the table. A family is predicted where its probability
passes a bound, and confirmed where one of its notices is mostly contained. Where no family
does, but the classes of licences together pass a bound of their own, the licence is
``unknown``. Both bounds are calibrated on rows that training leaves out.

Anchor words order the work: each line that holds one is judged, whole or in windows if it
is long, and the words around it are searched for every notice, however its lines are
wrapped, up to an empty line. In every notice, more bigrams hold an anchor than one may
miss, so no notice is lost; of licences that are only named, those without an anchor are.
"""

from __future__ import annotations

import functools
import json
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER, UNKNOWN = "none", "unknown"
BUCKETS = 2048
#: Share of a notice's bigrams that a confirmed paragraph holds.
CONFIRM = 0.8
#: Words of a window, from one to the next, and on either side of it that a notice may also use. No notice is longer than STEP + 1.
WINDOW, STEP, AROUND = 48, 24, 24
#: Words between those of a notice that it may have, as a share of its length.
SLACK = 0.25
#: Paragraphs of the table that stand for the class of all else, at most.
SAMPLE_ROWS = 400

# Public licence notices by family.
NOTICES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Distributed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
                   "Released under the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This software is licensed under the GNU GPL.",
            "This program is free software: you can redistribute it under the terms of the GNU General Public License", "Released under the GPLv3 license.",
            "Licensed under the GPLv3 or later.", "GPLv3 or later", "GPLv2 or later", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL": ["Licensed under the GNU Lesser General Public License, version 2.1.", "Released under the LGPL license.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "Released under the AGPL license.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Released under the BSD License.", "Licensed under the 3-Clause BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted",
            "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright"],
    "ISC": ["Released under the ISC License.", "Licensed under the ISC license."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "Released under the Unlicense license."],
}
# Short forms that name a family and are too short or free to compare with.
SHORT = {
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "License: BSD-3-Clause", "BSD license"], "Apache-2.0": ["Apache-2.0", "License: Apache-2.0", "Apache License 2.0", "Apache 2.0 license"],
    "GPL": ["GPL version 3 or any later version", "GPL version 2 or any later version", "GPL-3.0-or-later", "GPL v3 or later", "GNU GPL version 3", "License: GPL-3.0-only"],
    "MPL-2.0": ["MPL-2.0", "License: MPL-2.0"], "CC-BY-SA": ["CC BY-SA 4.0", "Content is available under CC BY-SA 4.0.", "Text is under CC BY-SA 3.0"], "CC-BY": ["CC BY 4.0", "Content is available under CC BY 4.0.", "Text is under CC BY 3.0"], "CC-BY-NC": ["CC BY-NC 4.0", "Text is under CC BY-NC 3.0"],
}
# Names of other public licences, and frames that name a licence.
OTHER_NAMES = ["Zlib", "zlib/libpng", "EUPL", "European Union Public", "Artistic 2.0", "Eclipse Public", "Boost Software", "PostgreSQL", "SIL Open Font", "WTFPL", "Python Software Foundation", "Academic Free",
               "CeCILL", "Microsoft Public", "Open Software", "NCSA", "Ruby", "X11", "Vim", "Perl", "Sleepycat", "Beerware", "Community Data", "Open Database", "IBM Public", "PHP 3.01", "W3C", "OpenSSL", "Unicode", "Intel"]
FRAMES = ["Licensed under the {} License.", "Released under the {} license.", "This work is licensed under the {} Licence, version 1.2.", "SPDX-License-Identifier: {}", "Distributed under the terms of the {} license.",
          "This software is distributed under {} terms; see the license file."]
FAMILIES = [OTHER, *NOTICES, UNKNOWN]
#: Sentences that use licence words and name no licence.
PLAIN = [
    "A driver must hold a valid license at all times.", "The city renewed the license of the bar.", "She asked for permission to leave the room early.",
    "The public was granted free access to the park.", "Copyright law is a subject of this course.", "They released a new version of the song.",
    "The terms of the contract were general and open.", "Software of this source is used by many people.", "The mozilla browser was released under a new name.",
    "Apache helicopters were seen over the base.", "The university of Massachusetts is public.", "This work was licensed to a film studio for an unknown sum.",
    "He lost his license to sell alcohol.", "Version 2.0 of the report was released under pressure.", "You may not use this file except on the second floor.",
    "Fishing is permitted with a license from the office.", "Redistribution of wealth was the aim of the reform.", "The attribution of the painting is not certain.",
    "All rights to the novel were sold.", "A binary form of the data is stored with the source.",
]
#: In every notice more than 1 - CONFIRM of the bigrams hold one of these.
ANCHORS = ["licens", "licenc", "permission", "granted", "software", "redistribut", "modification", "mozilla", "waived", "copyright", "unencumbered", "cc0", "distributed under",
           "gpl", "gnu ", "spdx", "creative commons", "eupl", "public domain", "bsd", "apache", "cc by", "cc-by", "by-sa", "by-nc", "mpl-2", "zlib", "mit or ", "or mit"]
WORD = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def bigrams_of(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b)))


def _buckets(words: Column, bigrams: Column) -> Column:
    return F.array_distinct(F.transform(F.concat(F.array_distinct(words), bigrams), lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int")))


def _constant(values, kind: str) -> Column:
    """A constant array, written as one string that the optimizer folds."""
    return F.split(F.lit("\x1f".join(map(str, values))), "\x1f").cast(f"array<{kind}>")


def training_rows() -> list[dict]:
    """Notices, notices without one word, notices between other words; plain sentences likewise. part marks calibration rows."""
    frames = ("{}", "Copyright 2020 the authors. {}", "{} See the file for details.", "This project: {}", "{}", "note that {}")
    rows = []
    for label, family in enumerate(FAMILIES):
        for text in NOTICES.get(family, PLAIN):
            words = text.split()
            forms = [f.format(text) for f in frames] + [" ".join(words[:k] + words[k + 1 :]) for k in range(len(words)) if label == 0 or words[k].strip(".,;").lower() in _FILL]
            rows += [{"text": t, "label": float(label), "part": k % 5 == 4} for k, t in enumerate(forms)]
        for text in SHORT.get(family, []):
            rows += [{"text": f.format(text), "label": float(label), "part": k == 3} for k, f in enumerate(frames)]
    other = [frame.format(name) for name in OTHER_NAMES for frame in FRAMES]
    return rows + [{"text": t, "label": float(len(FAMILIES) - 1), "part": k // len(FRAMES) % 5 == 4} for k, t in enumerate(other)]


_FILL = set("this work is the a of under you can it to any".split())


class Scanner:
    """Trained weights, the calibrated bounds of a family and of any licence, and the notices to compare with."""

    def __init__(self, weights: list[list[float]], biases: list[float], bound: float, any_bound: float):
        self.weights, self.biases, self.bound, self.any_bound = weights, biases, bound, any_bound

    def _logit(self, buckets: Column, k: int) -> Column:
        weights = _constant(self.weights[k], "double")
        return F.aggregate(buckets, F.lit(float(self.biases[k])), lambda s, b: s + F.element_at(weights, b + 1))

    def with_probabilities(self, rows: DataFrame, buckets: Column) -> DataFrame:
        """Adds __p, the probability of each family."""
        rows = _once(rows, "__b", buckets)
        rows = _once(rows, "__z", F.array(*[self._logit(F.col("__b"), k) for k in range(len(self.weights))]))
        rows = _once(rows, "__m", F.array_max("__z"))
        rows = _once(rows, "__e", F.transform("__z", lambda z: F.exp(z - F.col("__m"))))
        rows = _once(rows, "__s", F.aggregate("__e", F.lit(0.0), lambda a, b: a + b))
        return _once(rows, "__p", F.transform("__e", lambda x: x / F.col("__s"))).drop("__b", "__z", "__m", "__e", "__s")

    def judge(self, rows: DataFrame, text_column: str) -> DataFrame:
        """Adds family, probability, containment and confirmed to rows of one paragraph each."""
        rows = _once(rows, "__words", words_of(F.col(text_column)))
        rows = _once(rows, "__bigrams", bigrams_of(F.col("__words")))
        rows = self.with_probabilities(rows, _buckets(F.col("__words"), F.col("__bigrams")))
        rows = _once(rows, "__any", 1 - F.element_at("__p", 1))
        rows = _once(rows, "__p", F.slice("__p", 2, len(NOTICES)), drop="__p")
        rows = _once(rows, "__top", F.array_max("__p"))
        place = F.array_position("__p", F.col("__top")).cast("int")
        rows = _once(rows, "__k", F.when(F.col("__top") >= self.bound, place).when(F.col("__any") >= self.any_bound, len(FAMILIES) - 1).otherwise(0))
        notices = F.array(*[F.struct(F.lit(k).alias("k"), bigrams_of(words_of(F.lit(t))).alias("own")) for k, f in enumerate(FAMILIES) for t in NOTICES.get(f, [])])
        held = F.transform(F.filter(notices, lambda n: n["k"] == F.col("__k")), lambda n: F.size(F.array_intersect(n["own"], F.col("__bigrams"))) / F.size(n["own"]))
        rows = _once(rows, "containment", F.round(F.coalesce(F.array_max(held), F.lit(0.0)), 6))
        family = F.element_at(F.array(*map(F.lit, FAMILIES)), F.col("__k") + 1)
        rows = rows.withColumn("family", family).withColumn("probability", F.round(F.when(F.col("__k") == len(FAMILIES) - 1, F.col("__any")).otherwise(F.col("__top")), 6))
        rows = rows.withColumn("confirmed", (F.col("__k") > 0) & (F.col("containment") >= CONFIRM))
        return rows.drop("__words", "__bigrams", "__p", "__top", "__any", "__k")


def _once(rows: DataFrame, name: str, value: Column, drop: str | None = None) -> DataFrame:
    """Adds a column behind a generator, so that the optimizer does not copy its expression into each use."""
    kept = [c for c in rows.columns if c != drop]
    return rows.select(*kept, F.explode(F.array(value)).alias(name))


def anchored(low: Column) -> Column:
    """Whether lower-case text holds an anchor."""
    return functools.reduce(Column.__or__, [F.contains(low, F.lit(a)) for a in ANCHORS])


#: Stands before a line that begins a new block; texts that hold it lose it, as it is no part of a word.
_START = "\x01"


def _placed(lines: Column, first: Column) -> Column:
    """The words of lines, each with the place of its line; first is that of the first line."""
    return F.flatten(F.transform(lines, lambda x, i: F.transform(words_of(x), lambda w: F.struct(w.alias("w"), (first + i).alias("at")))))


def _text(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["w"]), " ")


def _spans(tokens: Column) -> Column:
    """The notices among tokens: where each stands, as (paragraph, end, line), at the closest stretch that holds enough of its bigrams."""
    words = [re.findall(WORD, t.lower()) for own in NOTICES.values() for t in own]
    grams = [[f"{a} {b}" for a, b in zip(w, w[1:])] for w in words]
    notices = F.from_json(F.lit(json.dumps([{"own": sorted(set(g)), "least": CONFIRM * len(set(g)), "span": -int(-len(g) * (1 + SLACK) // 1)} for g in grams])), "array<struct<own:array<string>,least:double,span:int>>")
    pairs = F.transform(F.sequence(F.lit(1), F.size(tokens) - 1), lambda i: F.concat_ws(" ", F.element_at(tokens, i)["w"], F.element_at(tokens, i + 1)["w"]))
    pairs = F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>"))

    def held(notice: Column, some: Column) -> Column:
        return F.size(F.array_intersect(notice["own"], some))

    def closest(notice: Column, pairs: Column) -> Column:
        """The last place that the most bigrams of the notice follow, so that it begins with one of them."""
        at = F.transform(F.sequence(F.lit(1), F.size(pairs)), lambda i: F.struct(held(notice, F.slice(pairs, i, notice["span"])).alias("n"), i.alias("i")))
        return F.array_max(at)

    def placed(notice: Column, pairs: Column) -> Column:
        best = closest(notice, pairs)
        held_at = F.transform(F.slice(pairs, best["i"], notice["span"]), lambda g, k: F.when(F.array_contains(notice["own"], g), k))
        size = F.array_max(held_at) + 2  # words up to the last that it holds
        return F.when(best["n"] >= notice["least"], F.struct(
            F.element_at(tokens, best["i"])["at"].alias("paragraph"), F.element_at(tokens, best["i"] + size - 1)["at"].alias("end"),
            _text(F.slice(tokens, best["i"], size)).alias("line"), F.lit(False).alias("own")))

    def found(pairs: Column) -> Column:
        some = F.filter(notices, lambda n: held(n, pairs) >= n["least"])
        return F.filter(F.transform(some, lambda n: placed(n, pairs)), lambda x: x.isNotNull())

    return F.flatten(F.transform(F.array(pairs), found))


def candidates(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Rows (row, id, paragraph, end, line, own) to judge: lines with an anchor, in windows if they are long, and the notices that stand in or around them.

    Lines are numbered without empty ones. row numbers the rows of docs; own is false for notices.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    rows = _once(rows, "text", F.lower("text"), drop="text").where(anchored(F.col("text")))
    marked = F.regexp_replace(F.translate("text", _START, " "), "(?:\r\n|\r(?!\n)|\n){2,}", f"\n{_START}")
    rows = _once(rows.select("row", "id", marked.alias("text")), "lines", F.split("text", "[\r\n]+"), drop="text")
    begins = lambda x: F.startswith(x, F.lit(_START))
    blank = lambda x: F.trim(x, F.lit(f" \t\x0b\x0c{_START}")) == ""
    hits = F.filter(F.transform("lines", lambda x, i: F.when(anchored(x), i)), lambda i: i.isNotNull())
    rows = rows.select("row", "id", "lines", F.explode(hits).alias("hit"))
    near = rows.select(
        "row", "id", "hit", F.element_at("lines", F.col("hit") + 1).alias("line"),
        F.reverse(F.slice("lines", F.greatest(F.col("hit") - AROUND, F.lit(0)) + 1, F.least(F.col("hit"), F.lit(AROUND)))).alias("up"), F.slice("lines", F.col("hit") + 2, AROUND).alias("down"))
    first = F.array_position(F.transform("up", lambda x: begins(x) | blank(x)), True).cast("int")
    up = F.when(begins(F.col("line")), F.slice("up", 1, 0)).when(first == 0, F.col("up")).otherwise(F.slice("up", F.lit(1), first - F.when(blank(F.element_at("up", F.greatest(first, F.lit(1)))), 1).otherwise(0)))
    last = F.array_position(F.transform("down", lambda x: begins(x) | blank(x)), True).cast("int")
    down = F.when(last == 0, F.col("down")).otherwise(F.slice("down", F.lit(1), F.greatest(last - 1, F.lit(0))))
    near = near.select("row", "id", "hit", F.array("line").alias("line"), F.reverse(up).alias("up"), down.alias("down"))
    before, own, after = _placed(F.col("up"), F.col("hit") - F.size("up")), _placed(F.col("line"), F.col("hit")), _placed(F.col("down"), F.col("hit") + 1)
    near = near.select("row", "id", "hit", F.slice(before, F.greatest(F.size(before) - AROUND, F.lit(0)) + 1, AROUND).alias("before"), own.alias("words"), F.slice(after, 1, AROUND).alias("after"))
    near = near.where("size(words) > 0").select("row", "id", "hit", "words", F.concat("before", "words", "after").alias("joined"), F.size("before").alias("shift"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.size("words") - WINDOW) / STEP).cast("int"), F.lit(0)))
    near = near.withColumn("k", F.explode(starts)).select(
        "row", "id", "hit", (F.size("words") <= WINDOW).alias("whole"), F.slice("words", F.col("k") * STEP + 1, WINDOW).alias("words"),
        F.slice("joined", F.greatest(F.col("k") * STEP + F.col("shift") - AROUND, F.lit(0)) + 1, WINDOW + 2 * AROUND).alias("joined"))
    near = near.withColumn("line", _text(F.col("words"))).where(F.col("whole") | anchored(F.concat("line", F.lit(" "))))
    near = _once(near.select("row", "id", "hit", "line", "joined"), "spans", _spans(F.col("joined")), drop="joined")
    mine = F.struct(F.col("hit").alias("paragraph"), F.col("hit").alias("end"), F.col("line"), F.lit(True).alias("own"))
    return near.select("row", "id", F.explode(F.concat(F.array(mine), "spans")).alias("c")).select("row", "id", "c.*")


def fit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sample_rows: int = SAMPLE_ROWS) -> Scanner:
    """Trains on the rule-made rows and on at most sample_rows paragraphs without an anchor, by a hash of their text.

    Null and empty texts give no paragraphs, and without any the rule-made rows do.
    """
    spark: SparkSession = docs.sparkSession
    made = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(training_rows())), "array<struct<text:string,label:double,part:boolean>>")).alias("r")).select("r.*")
    total = docs.count()
    texts = docs.select(F.col(text_column).alias("text"), F.xxhash64(id_column).alias("at")).where(F.pmod("at", F.lit(1 << 20)) < min(1.0, (400.0 + 2 * sample_rows) / max(1, total)) * (1 << 20))
    lines = texts.select(F.explode(F.split("text", "[\r\n]+")).alias("text")).where((F.length("text") > 0) & ~anchored(F.lower("text")))
    lines = lines.withColumn("at", F.xxhash64("text")).orderBy("at", "text").limit(sample_rows)
    rows = made.unionByName(lines.select("text", F.lit(0.0).alias("label"), (F.pmod("at", F.lit(5)) == 4).alias("part")))
    words = words_of(F.col("text"))
    rows = rows.withColumn("buckets", _buckets(words, bigrams_of(words))).coalesce(1).persist()
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.array_contains("buckets", i).cast("double"))
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=0.002).fit(rows.where("not part").select("label", array_to_vector(dense).alias("features")))
    scanner = Scanner(model.coefficientMatrix.toArray().tolist(), model.interceptVector.toArray().tolist(), 0.5, 0.5)
    kept = scanner.with_probabilities(rows.where("part"), F.col("buckets"))
    family = F.when(F.col("label").isin(0.0, len(FAMILIES) - 1.0), F.array_max(F.slice("__p", 2, len(NOTICES))))
    highest = kept.agg(F.max(family).alias("family"), F.max(F.when(F.col("label") == 0, 1 - F.element_at("__p", 1))).alias("any")).first()
    scanner.bound, scanner.any_bound = (min(0.9, max(0.5, highest[name] or 0.0)) for name in ("family", "any"))
    rows.unpersist()
    return scanner


def scan(docs: DataFrame, scanner: Scanner, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (id, paragraph, family, probability, containment, confirmed): for each line where a notice begins, its families; else what the line itself reads as.

    The family is ``unknown``, with the probability of any licence, where it is none of those
    listed. A line has a row for each family of which a notice begins in it, however long it is
    and however the notice is wrapped, but for notices inside others of their family; a line without one, and not inside one, has its likeliest
    unconfirmed family, if any. Null and empty texts have no lines; null and repeated ids are
    carried and repeated rows each judged; ties of probability go to the first family listed;
    an empty table gives no rows; other columns are ignored. Only what was found is shuffled,
    by document.
    """
    found = scanner.judge(candidates(docs, id_column, text_column), "line").where((F.col("family") != OTHER) & (F.col("own") | F.col("confirmed")))
    best = F.max(F.struct("containment", "probability", "end"))
    found = found.groupBy("row", "id", "paragraph", "family", "confirmed").agg(best.alias("b"))
    rows = found.groupBy("row", "id").agg(F.collect_list(F.struct("paragraph", "family", "confirmed", "b.end", "b.probability", "b.containment")).alias("all"))
    sure = F.filter("all", lambda x: x["confirmed"] & ~F.exists(F.col("all"), lambda y: y["confirmed"] & (y["family"] == x["family"]) & (y["paragraph"] < x["paragraph"]) & (y["end"] >= x["end"])))
    outside = F.filter("all", lambda x: ~x["confirmed"] & ~F.exists(F.col("sure"), lambda y: (y["paragraph"] <= x["paragraph"]) & (x["paragraph"] <= y["end"])))
    rows = rows.withColumn("sure", sure).select("id", "sure", outside.alias("rest"))
    likeliest = F.filter("rest", lambda x: ~F.exists(F.col("rest"), lambda y: (y["paragraph"] == x["paragraph"]) & ((y["probability"] > x["probability"]) | (y["probability"] == x["probability"]) & (y["family"] < x["family"]))))
    rows = rows.select("id", F.explode(F.concat("sure", likeliest)).alias("x"))
    return rows.select(F.col("id").alias(id_column), "x.paragraph", "x.family", "x.probability", "x.containment", "x.confirmed")
