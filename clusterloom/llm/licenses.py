"""License scans: normalised texts against licence templates by Dice coefficient.

DataFrame and SQL functions only. Normalised: A-Z folded, everything but ASCII letters
and digits parts words. Compared are sets of word bigrams (a lone word is its own);
Dice(a, b) = 2 |a and b| / (|a| + |b|). Compared with the templates are

* passages: each line of a text, and the whole text if it has several lines;
* windows of a template's number of words anywhere in the text, over line breaks and inside
  longer lines: wherever an anchor bigram of the template stands, the window that puts it
  in its place in the template. A template that stands in a text word for word
  therefore always scores 1, however it is wrapped or embedded.

Pruning, exact: Dice of at least t needs the smaller set to have t / (2 - t) of the
larger one's size, which bounds the templates worth comparing by their size; and at
least that share of the template's bigrams must be in the passage. So of any
m - ceil(m t / (2 - t)) + 1 bigrams of a template of m, one is there. The longest so many
bigrams are anchors; a text without any anchor, by one regular expression, has no
licence and is never split.

Templates are a mapping of a checked size: at most ``MAX_TEMPLATE_BYTES`` of text, held
in the plan as literals. Several templates of a licence differ after a ``#`` in their
keys: short notices, standard headers, licence bodies. Nothing is shuffled.

Defined results: a null or empty text has no licence; of equal scores the template with
the most bigrams wins, then the smallest key; rows that repeat an id are scanned each; without templates nothing
is found.
"""

from __future__ import annotations

import math
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
MAX_TEMPLATE_BYTES = 1 << 20
_ROUNDING = 1e-12
SPAN = 1 << 40  # more than the words of any text

# Notices, standard headers and bodies by which a text states its licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are "
                    "permitted provided that the following conditions are met:",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0#header":
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause#conditions":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    "BSD-3-Clause#conditions":
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
        "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission.",
    "GPL-2.0#header":
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
        "option) any later version.",
    "GPL-3.0#header":
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    "ISC#body":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT#body":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software.",
    "MPL-2.0#header":
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense#body":
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
        "for any purpose, commercial or non-commercial, and by any means.",
}


def words(text: str) -> list[str]:
    return "".join(c.lower() if c.isascii() and c.isalnum() else " " for c in text).split()


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, sorted."""
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])} or set(w))


def least_common(size: int, threshold: float) -> int:
    """How many of a template's bigrams a passage must have."""
    return max(1, math.ceil(size * threshold / (2 - threshold) - _ROUNDING))


def anchors(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of which a passage near the template has one, the longest."""
    longest = sorted(grams, key=lambda g: (-len(g), g))
    return longest[:len(grams) - least_common(len(grams), threshold) + 1]


def anchor_places(templates: dict[str, str], threshold: float) -> list[tuple[str, str, int]]:
    """(template, anchor bigram, its place in the template, from 0) of templates of two words or more."""
    found = []
    for name, text in sorted(templates.items()):
        w, near = words(text), set(anchors(bigrams(text), threshold)) if words(text) else set()
        found += [(name, f"{a} {b}", k) for k, (a, b) in enumerate(zip(w, w[1:])) if f"{a} {b}" in near]
    return found


def anchor_pattern(found: list[str]) -> str:
    """One regular expression for any of the bigrams, sharing their beginnings, tried where words begin."""
    trie: dict = {}
    for gram in found:
        node = trie
        for c in gram:
            node = node.setdefault(c, {})
        node[""] = {}

    def written(node: dict) -> str:
        if "" in node:  # what is longer has this one in it
            return ""
        branches = [("[^a-zA-Z0-9]+" if c == " " else c) + written(n) for c, n in sorted(node.items())]
        return branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"

    return "(?i)(?<![a-zA-Z0-9])" + written(trie)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, ascii_uppercase, ascii_lowercase), "[^a-z0-9]+"), lambda x: x != "")


def bigram_at(ws: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.element_at(ws, i), F.element_at(ws, i + 1))


def word_bigrams(ws: Column) -> Column:
    """The distinct bigrams of an array of words."""
    return F.when(F.size(ws) >= 2, F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: bigram_at(ws, i)))).otherwise(F.array_distinct(ws))


def passage_bigrams(passage: Column) -> Column:
    """The distinct bigrams of a passage."""
    return bound(words_of(passage), word_bigrams)


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, license, score, n_passages, n_windows`` per row: the licence of the best template at or above
    ``threshold`` (else null), its Dice rounded to six places, how many passages reach the threshold with any
    template, and how many windows do with theirs."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    if sum(len(t.encode()) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError("templates are larger than the stated bound")
    sets = {name: grams for name, text in sorted(templates.items()) if (grams := bigrams(text))}
    rows = docs.select(F.col(id_col).alias("_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    if not sets:
        return rows.select(F.col("_id").alias(id_col), F.lit(None).cast("string").alias("license"),
                           F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("n_passages"),
                           F.lit(0).cast("long").alias("n_windows"))
    near_one = sorted({a for g in sets.values() for a in anchors(g, threshold)})
    pattern = anchor_pattern(near_one)

    def anchored(text: Column) -> Column:
        return F.rlike(text, F.lit(pattern))

    def best(grams: Column) -> Column:
        """The best template: struct(minus the score, name), or null."""
        n = F.size(grams)
        scored = [F.when((n >= least_common(len(g), threshold))
                         & (n * (threshold / (2 - threshold)) <= len(g) + _ROUNDING),
                         F.struct((-2.0 * F.size(F.array_intersect(grams, F.lit(g))) / (n + len(g))).alias("minus"),
                                  F.lit(-len(g)).alias("size"), F.lit(name).alias("name"))) for name, g in sets.items()]
        return F.array_min(F.filter(F.array(*scored), lambda s: s["minus"] <= _ROUNDING - threshold))

    names = list(sets)
    places: dict[str, list[int]] = {}  # template * SPAN + place, by anchor
    for name, gram, k in anchor_places(templates, threshold):
        places.setdefault(gram, []).append(names.index(name) * SPAN + k)
    lengths = F.lit([len(words(templates[name])) for name in names])
    grams_of = F.array(*[F.lit(g) for g in sets.values()])

    def window(ws: Column, code: Column) -> Column:
        """The template of a window, minus its score and name; a code is template * SPAN + SPAN / 2 + first word."""
        t = F.floor(code / SPAN).cast("int") + 1
        first = (code % SPAN - SPAN // 2).cast("int")
        begin = F.greatest(first, F.lit(1))
        part = F.slice(ws, begin, F.element_at(lengths, t) - (begin - first))
        whole = F.element_at(grams_of, t)
        return bound(bound(part, word_bigrams), lambda mine: F.struct(
            (-2.0 * F.size(F.array_intersect(mine, whole)) / (F.size(mine) + F.size(whole))).alias("minus"),
            (-F.size(whole)).alias("size"), F.element_at(F.lit(names), t).alias("name")))

    def windows(ws: Column) -> Column:
        if not places:
            return F.array().cast("array<struct<minus:double,size:int,name:string>>")
        table = F.create_map(*[F.lit(x) for gram, ks in sorted(places.items()) for x in (gram, ks)])
        at = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ws) - 1, F.lit(1))),
                      lambda i: F.when(i < F.size(ws), bigram_at(ws, i).isin(*places)).otherwise(False))
        codes = F.array_distinct(F.flatten(F.transform(at, lambda i: F.transform(
            F.element_at(table, bigram_at(ws, i)),
            lambda k: F.floor(k / SPAN).cast("long") * SPAN + SPAN // 2 + i - k % SPAN))))
        return F.filter(F.transform(codes, lambda c: window(ws, c)), lambda s: s["minus"] <= _ROUNDING - threshold)

    lines = F.split("_text", "\n")
    passages = F.when(F.size(lines) > 1, F.concat(lines, F.array("_text"))).otherwise(lines)
    near = F.transform(F.filter(passages, anchored), lambda p: bound(passage_bigrams(p), best))
    has = anchored(F.col("_text"))
    found = rows.select("_id", F.when(has, F.filter(near, lambda s: s.isNotNull())).alias("_found"),
                        F.when(has, bound(words_of(F.col("_text")), windows)).alias("_windows"))
    top = F.array_min(F.concat("_found", "_windows"))
    return found.select(F.col("_id").alias(id_col), F.split_part(top["name"], F.lit("#"), F.lit(1)).alias("license"),
                        F.round(-top["minus"], 6).alias("score"),
                        F.coalesce(F.size("_found"), F.lit(0)).cast("long").alias("n_passages"),
                        F.coalesce(F.size("_windows"), F.lit(0)).cast("long").alias("n_windows"))


def oracle(templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL over ``documents``, without pruning."""
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(templates.items()))
    places = ", ".join(f"('{name}', '{gram}', {k})" for name, gram, k in anchor_places(templates, threshold))
    grams = ("unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) "
             "ELSE w END)")
    split = ("list_filter(string_split(regexp_replace(translate({}, '" + ascii_uppercase + "', '" + ascii_lowercase
             + "'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')")
    return f"""
WITH t AS (SELECT name, {split.format("body")} AS w FROM (VALUES {rows}) AS t(name, body)),
     tg AS (SELECT DISTINCT name, {grams} AS gram FROM t),
     tn AS (SELECT name, count(*) AS n FROM tg GROUP BY name),
     place(name, gram, k) AS (VALUES {places}),
     d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
     p AS (SELECT rid, unnest(CASE WHEN contains(text, chr(10))
             THEN list_append(string_split(text, chr(10)), text) ELSE [text] END) AS passage
           FROM d WHERE text IS NOT NULL),
     pw AS (SELECT rid, row_number() OVER () AS pid, {split.format("passage")} AS w FROM p),
     pg AS (SELECT DISTINCT rid, pid, {grams} AS gram FROM pw),
     pn AS (SELECT pid, count(*) AS n FROM pg GROUP BY pid),
     hit AS (SELECT rid, pid, name, count(*) AS k FROM pg JOIN tg USING (gram) GROUP BY ALL),
     good AS (SELECT rid, pid, name, tn.n AS size, 2.0 * k / (pn.n + tn.n) AS dice FROM hit JOIN pn USING (pid)
              JOIN tn USING (name) WHERE 2.0 * k / (pn.n + tn.n) >= {threshold} - {_ROUNDING}),
     dw AS (SELECT rid, {split.format("text")} AS w FROM d WHERE text IS NOT NULL),
     spot AS (SELECT rid, unnest(range(1, len(w))) AS i,
                   unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM dw),
     win AS (SELECT DISTINCT rid, name, i - k AS first FROM spot JOIN place USING (gram)),
     ww AS (SELECT rid, name, first, dw.w[greatest(first, 1):first + len(t.w) - 1] AS w
            FROM win JOIN dw USING (rid) JOIN t USING (name)),
     wg AS (SELECT DISTINCT rid, name, first, {grams} AS gram FROM ww),
     wn AS (SELECT rid, name, first, count(*) AS n, count(tg.gram) AS k
            FROM wg LEFT JOIN tg USING (name, gram) GROUP BY rid, name, first),
     wgood AS (SELECT rid, name, 2.0 * k / (wn.n + tn.n) AS dice, tn.n AS size FROM wn JOIN tn USING (name)
               WHERE 2.0 * k / (wn.n + tn.n) >= {threshold} - {_ROUNDING}),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY dice DESC, size DESC, name) AS r
                FROM (SELECT rid, name, dice, size FROM good UNION ALL SELECT * FROM wgood)),
     counted AS (SELECT rid, count(DISTINCT pid) AS n FROM good GROUP BY rid),
     wcounted AS (SELECT rid, count(*) AS n FROM wgood GROUP BY rid)
SELECT d.doc_id, split_part(r.name, '#', 1) AS license, round(r.dice, 6) AS score,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n_passages, CAST(coalesce(v.n, 0) AS BIGINT) AS n_windows
FROM d LEFT JOIN (SELECT * FROM ranked WHERE r = 1) r USING (rid) LEFT JOIN counted c USING (rid)
LEFT JOIN wcounted v USING (rid)"""
