"""Licence scan by a positional index of the templates' words (operator 3); DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.cluster import saved, small

# Phrases with their labels; licence notices and texts with the phrases that each must hold. Key phrases
# are of indexed words only (no FILLERS). Texts are given without punctuation and names.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["binary forms", "redistribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nd", "licensed under cc by nd 4 0", ["cc by nd"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("gpl-2", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["hereby granted", "copy modify"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["hereby granted free", "person obtaining"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
]
TEXTS = [
    (
        "apache-2.0",
        """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by
        applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license for the specific language
        governing permissions and limitations under the license""",
        ["applicable law", "specific language governing permissions"],
    ),
    (
        "boost-1.0",
        """boost software license version 1 0 permission is hereby granted free of charge to any person or organization
        obtaining a copy of the software and accompanying documentation covered by this license the software to use
        reproduce display distribute execute and transmit the software and to prepare derivative works of the software
        and to permit third parties to whom the software is furnished to do so all subject to the following""",
        ["boost software license", "prepare derivative works"],
    ),
    (
        "bsd",
        """redistributions of source code must retain the above copyright notice this list of conditions and the
        following disclaimer redistributions in binary form must reproduce the above copyright notice this list of
        conditions and the following disclaimer in the documentation and or other materials provided with the
        distribution""",
        ["must retain", "must reproduce", "materials provided"],
    ),
    (
        "bsd",
        """this software is provided by the copyright holders and contributors as is and any express or implied warranties
        including but not limited to the implied warranties of merchantability and fitness for a particular purpose are
        disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental
        special exemplary or consequential damages""",
        ["copyright holders", "particular purpose", "consequential damages"],
    ),
    (
        "gpl-3",
        """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more
        details""",
        ["free software foundation", "hope", "useful"],
    ),
    (
        "isc",
        """the software is provided as is and the author disclaims all warranties with regard to this software including all
        implied warranties of merchantability and fitness in no event shall the author be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits""",
        ["author disclaims", "warranties", "damages whatsoever resulting"],
    ),
    (
        "mit",
        """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights
        to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to
        whom the software is furnished to do so subject to the following conditions the above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the software""",
        ["without restriction including without limitation", "substantial portions"],
    ),
    (
        "mit",
        """the software is provided as is without warranty of any kind express or implied including but not limited to the
        warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or
        copyright holders be liable for any claim damages or other liability whether in an action of contract tort or
        otherwise arising from out of or in connection with the software or the use or other dealings in the software""",
        ["noninfringement", "dealings"],
    ),
    (
        "mpl-2.0",
        """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
        ["mozilla public license", "mpl", "distributed"],
    ),
    (
        "unlicense",
        """anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as
        a compiled binary for any purpose commercial or non commercial and by any means""",
        ["compiled binary", "non commercial"],
    ),
    (
        "zlib",
        """this software is provided as is without any express or implied warranty in no event will the authors be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions the origin of this software must not be misrepresented""",
        ["held liable", "origin", "misrepresented"],
    ),
]
TEMPLATES = [(label, " ".join(text.split()), keys) for label, text, keys in NOTICES + TEXTS]
FILLERS = set("a all an and any anyone are as at be but can do for from if in into is it no not of on one or other out see so that the they this to use was what whether whom will with you your".split())

#: Of each template so many words, the rarest of its key phrases, are looked up.
LOOKUPS = 2

_SEPARATORS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _postings() -> list[tuple[str, int, int]]:
    """(word, template, place) of every indexed word of the templates."""
    return [(w, t, i) for t, (_, text, _) in enumerate(TEMPLATES) for i, w in enumerate(text.split()) if w not in FILLERS]


def _key_places(text: str, keys: list[str]) -> list[int]:
    words = text.split()
    found = []
    for key in keys:
        parts = key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(parts)] == parts)
        found += range(at, at + len(parts))
    return found


def lowered(text: Column) -> Column:
    """A-Z as a-z; lower() alone does so wherever no other capital turns into ASCII, as only U+0130 and U+212A do."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(text.contains("İ") | text.contains("K"), F.translate(text, upper, lower)).otherwise(F.lower(text))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Words are runs of 0-9, a-z and characters beyond ASCII. Base: the places of PHRASES. Templates: of each template
    the LOOKUPS words of its key phrases with the highest IDF (in the files of this table) are looked up, and postings
    with the same relative place are intersected. As a template needs all its key phrases, these are the words that a
    file which holds it has with the highest IDF of all its words of those phrases: choosing them file by file would
    choose the same, and none is lost, however many notices a file holds. Only then the template's other words are compared at that place: it is found where all
    words of its key phrases stand. score: the largest part of a found template's indexed words that stand in place, 0
    if none is found.

    Null or empty text: no words, no labels, score 0. Rows equal in id and text get equal results; a null id is an id.
    Empty table: no rows. Other columns are ignored. A very long text is an array of its words in one row.

    Only places of licence words leave the scan of the texts; the index is as small as the templates.
    """
    spark = docs.sparkSession
    vocabulary = sorted({w for w, _, _ in _postings()} | {w for p in PHRASES for w in p.split()})
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__hash"), F.array_remove(F.split(lowered(text), _SEPARATORS), "").alias("__words"))
    places = F.array_compact(F.transform("__words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("i"), w.alias("w")))))
    base = saved(rows.select("__id", "__hash", F.size("__words").cast("long").alias("n_words"), places.alias("__at")), "licence-words")

    indexed = sorted({w for w, _, _ in _postings()})
    spots = base.select("__id", "__hash", F.explode("__at").alias("o")).select("__id", "__hash", F.col("o.i").alias("i"), F.col("o.w").alias("w"))
    files = base.select(F.explode(F.array_distinct(F.transform("__at", lambda o: o.w))).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    files = {r["w"]: r["n"] for r in files.collect()}  # a row for each word of the templates at most
    anchors = []
    for t, (_, words, keys) in enumerate(TEMPLATES):
        split = words.split()
        rarest = sorted(_key_places(words, keys), key=lambda k: (files.get(split[k], 0), k))[:LOOKUPS]
        anchors += [(split[k], t, k, len(rarest)) for k in rarest]
    looked_up = F.broadcast(spark.createDataFrame(anchors, "pw string, template int, place int, needed int"))
    looks = spots.where(F.col("w").isin(sorted({a[0] for a in anchors}))).join(looked_up, F.col("w") == F.col("pw"))
    looks = looks.groupBy("__id", "__hash", "template", (F.col("i") - F.col("place")).alias("shift")).agg(F.size(F.collect_set("place")).alias("agreeing"), F.first("needed").alias("needed"))
    seen = saved(looks.where(F.col("agreeing") == F.col("needed")).select(*[F.col(c).alias(f"s{c}") for c in ("__id", "__hash", "template", "shift")]), "licence-candidates")
    postings = F.broadcast(spark.createDataFrame([(w, t, i) for w, t, i in _postings()], "pw string, template int, place int"))
    same_file = F.col("__id").eqNullSafe(F.col("s__id")) & (F.col("__hash") == F.col("s__hash"))
    votes = spots.where(F.col("w").isin(indexed)).join(small(seen.select("s__id", "s__hash").distinct(), "licence-files"), same_file, "left_semi")
    votes = votes.join(postings, F.col("w") == F.col("pw")).withColumn("shift", F.col("i") - F.col("place"))
    votes = votes.join(small(seen, "licence-places"), same_file & (F.col("template") == F.col("stemplate")) & (F.col("shift") == F.col("sshift")), "left_semi")
    grouped = votes.groupBy("__id", "__hash", "template", "shift").agg(F.collect_set("place").alias("places"))
    sizes = [sum(1 for _, t, _ in _postings() if t == k) for k in range(len(TEMPLATES))]
    checks = F.broadcast(spark.createDataFrame([(k, label, _key_places(words, keys), sizes[k]) for k, (label, words, keys) in enumerate(TEMPLATES)], "t int, label string, keys array<int>, of int"))
    found = grouped.join(checks, F.col("template") == F.col("t")).where(F.size(F.array_except("keys", "places")) == 0)
    found = found.groupBy(F.col("__id").alias("__fi"), F.col("__hash").alias("__fh")).agg(F.collect_set("label").alias("found"), F.max(F.size("places") / F.col("of")).alias("best"))

    out = base.join(small(found, "licence-found"), F.col("__id").eqNullSafe(F.col("__fi")) & (F.col("__hash") == F.col("__fh")), "left")
    starts = []
    for phrase in PHRASES:
        words = phrase.split()
        test = " AND ".join([f"o.w = '{words[0]}'"] + [f"get(__at, j + {k}).w = '{w}' AND get(__at, j + {k}).i = o.i + {k}" for k, w in enumerate(words[1:], 1)])
        starts.append(F.expr(f"array_compact(transform(__at, (o, j) -> CASE WHEN {test} THEN o.i END))"))
    out = out.withColumn("__starts", F.array(*starts)).withColumn("__all", F.flatten("__starts"))
    labels = F.array_compact(F.array(*[F.when(F.size(F.col("__starts")[k]) > 0, F.lit(label)) for k, label in enumerate(PHRASES.values())]))
    join = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    none = F.array().cast("array<string>")
    return out.select(
        F.col("__id").alias(id_col), "n_words", F.size("__all").cast("long").alias("n_base"), F.array_min("__all").cast("long").alias("first_word"), F.array_max("__all").cast("long").alias("last_word"),
        join(labels).alias("base_labels"), join(F.concat(labels, F.coalesce("found", none))).alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"),
    )
