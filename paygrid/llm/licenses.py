"""License texts in documents by diagonal voting.

Documents and license templates are cut into all runs of ``k`` words.  Hashes
of the runs are joined to the places that the templates have them at; a run
that starts at word ``i`` and equals the template's at ``j`` votes for the
diagonal ``i - j``.  Votes are summed per (row, template, diagonal),
neighbouring diagonals that follow each other in the text are merged (words
put in or left out move a copy to the next diagonal), and the merged spans are
verified: the votes compare the words themselves, not only their hashes, and
must cover enough of the template within a span that is not much longer.

Short phrases are templates too.  A phrase of ``m`` words stands where all its
``m - k + 1`` runs vote for one diagonal.

The scan drops runs whose bit a small bitmap of the template hashes does not
have, before they leave the task; what is joined is the rest.  Nothing but the
votes is shuffled.  Templates are a parameter; their runs are broadcast up to
``BROADCAST_RUNS`` of them and merged beyond.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paygrid.llm.resampling import collapse
from paygrid.llm.words import gram_hashes, split
from paygrid.session import write_out

SHORT, LONG = 2, 3               # words of a run, for phrases and for texts
DRIFT = 12                       # diagonals apart that may still be one copy
GAP = 60                         # words between two parts of one copy
SHARE = 0.5                      # of a text's runs that must vote
STRETCH = 1.5                    # longest span, in lengths of the text
BITS = 1 << 20
ROWS = 256                       # of a batch, looked at together
BROADCAST_RUNS = 200_000
_U = np.uint64


@dataclass(frozen=True)
class Template:
    """``phrase``: must stand word for word; other texts may be edited."""
    label: str
    text: str
    phrase: bool = False


# fixed values: the phrases and labels that are counted
PHRASES = (
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
)

# fixed values: wording of public licenses and of their notices
TEXTS = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
             "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
             "whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this "
             "permission notice shall be included in all copies or substantial portions of the Software."),
    Template("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
             "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
             "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
             "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
             "permissions and limitations under the License."),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
             "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
             "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
             "later version."),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
             "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
             "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
             "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
             "distribution."),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
             "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    Template("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
             "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
             "purpose, commercial or non-commercial, and by any means."),
    Template("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any "
             "purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
             "restrictions"),
    Template("cc-by", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this "
             "license, visit http://creativecommons.org/licenses/by/4.0/"),
    Template("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a "
             "copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/"),
    Template("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this "
             "software to the public domain worldwide. This software is distributed without any warranty."),
)


def _strings(texts: Sequence[bytes]) -> pa.Array:
    """Collapsed bytes as strings again: the words are split as elsewhere."""
    return pa.array(list(texts), pa.large_binary()).cast(pa.large_string())


def template_runs(templates: Sequence[Template]) -> list[tuple]:
    """``(template, k, h, j, words)`` of all runs; templates of fewer than two
    words have none and are never found."""
    out = []
    data = [collapse(t.text) for t in templates]
    for w in split(_strings(data)):
        for t, lo, hi in w.rows():
            k = SHORT if templates[t].phrase else LONG
            words = w.joined(lo, hi).split()
            if hi - lo >= k:
                out += [(t, k, h, j, b" ".join(words[j:j + k]).decode())
                        for j, h in enumerate(gram_hashes(w.hashes[lo:hi], k).view(np.int64).tolist())]
    return out


def scan(docs: DataFrame, runs: list[tuple]) -> DataFrame:
    """``(doc_id, n_words, runs)`` of ``(doc_id, text)``: the words of all runs
    that a template may hold, and their places."""
    bits = {}
    for k in sorted({r[1] for r in runs}):
        bits[k] = np.zeros(BITS, bool)
        bits[k][(np.array([r[2] for r in runs if r[1] == k], np.int64).view(np.uint64) & _U(BITS - 1)).astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast({k: np.packbits(b) for k, b in bits.items()})

    def run(batches):
        maps = {k: np.unpackbits(b).astype(bool) for k, b in shared.value.items()}
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, len(b), ROWS)):
            n, found = [], []
            for w in split(_strings([collapse(t.as_py() or "") for t in batch.column(1)])):
                here = [[] for _ in range(len(w.bounds) - 1)]
                row = np.repeat(np.arange(len(w.bounds) - 1), np.diff(w.bounds))
                for k, held in maps.items():
                    h = gram_hashes(w.hashes, k)
                    at = np.flatnonzero(held[(h & _U(BITS - 1)).astype(np.int64)])
                    at = at[at + k <= w.bounds[row[at] + 1]]
                    for r, i, x in zip(row[at].tolist(), at.tolist(), h[at].view(np.int64).tolist(), strict=True):
                        here[r].append({"k": k, "h": x, "i": i - int(w.bounds[r]), "words": w.joined(i, i + k).decode()})
                n += np.diff(w.bounds).tolist()
                found += here
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind)],
                                             names=["doc_id", "n_words", "runs"])

    kind = pa.list_(pa.struct([("k", pa.int32()), ("h", pa.int64()), ("i", pa.int64()), ("words", pa.string())]))
    return docs.mapInArrow(run, "doc_id long, n_words long, runs array<struct<k:int,h:long,i:long,words:string>>")


def vote(spark: SparkSession, scanned: DataFrame, runs: list[tuple]) -> DataFrame:
    """``(key, template, diagonal, votes, i0, i1, j0, j1)``: the runs that a row
    and a template share along a diagonal, and the first and last of them."""
    places = spark.createDataFrame(runs or [(0, 0, 0, 0, "")], "template int, k int, h long, j long, words string")
    places = F.broadcast(places) if len(runs) <= BROADCAST_RUNS else places.hint("merge")
    every = scanned.where(F.size("runs") > 0).select("key", F.explode("runs").alias("r")).select("key", "r.*")
    return every.join(places, ["k", "h", "words"]).groupBy(
        "key", "template", (F.col("i") - F.col("j")).alias("diagonal")).agg(
        F.count("*").alias("votes"), F.min("i").alias("i0"), F.max("i").alias("i1"), F.min("j").alias("j0"), F.max("j").alias("j1"))


def merged(votes: DataFrame) -> DataFrame:
    """``(key, template, votes, i0, i1)``: diagonals of one row and template
    that are at most ``DRIFT`` apart and go on in text and template within
    ``GAP`` words are one span; its votes are summed."""
    by = Window.partitionBy("key", "template").orderBy("i0", "j0", "diagonal")
    last = lambda c: F.lag(c).over(by)
    goes_on = (F.abs(F.col("diagonal") - last("diagonal")) <= DRIFT) & (F.col("i0") - last("i1") <= GAP) & (F.col("j0") > last("j0"))
    part = votes.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_part", F.sum("_new").over(by))
    return part.groupBy("key", "template", "_part").agg(F.sum("votes").alias("votes"), F.min("i0").alias("i0"), F.max("i1").alias("i1"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[Template] = PHRASES,
                 texts: Sequence[Template] = TEXTS, keep_spans: bool = False) -> DataFrame:
    """One row per input row: ``(doc_id, n_words, n_base, first_word,
    last_word, base_labels, labels, score)``, with ``keep_spans`` also
    ``spans``: (label, first word, word after the last, score) of each find.

    Words are runs of digits, letters a-z (A-Z folded) and characters beyond
    ASCII.  ``n_base`` counts places where a phrase's words follow each other,
    overlaps included; ``first_word`` and ``last_word`` are the least and the
    greatest start (null without one).  ``labels`` adds those of texts of which
    a span holds ``SHARE`` of the runs; ``score`` is the greatest share held (1
    for a phrase, 0 for no find).  Null and blank texts have no words and no
    labels (empty strings); repeated rows and null ids are passed through; an
    empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    templates = [*phrases, *texts]
    runs = template_runs(templates)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    # the key of a row is made once, in the written table
    base = write_out(scan(rows, runs).withColumn("key", F.monotonically_increasing_id()), "license-runs", compression="zstd")
    votes = vote(spark, base, runs)
    total = {t: sum(r[0] == t for r in runs) for t in range(len(templates))}
    known = spark.createDataFrame([(t, x.label, x.phrase, total[t], total[t] + (SHORT if x.phrase else LONG) - 1)
                                   for t, x in enumerate(templates)] or [(0, "", False, 1, 1)],
                                  "template int, label string, phrase boolean, runs long, words long")
    known = F.broadcast(known)                     # one row per template
    votes = write_out(votes.join(known, "template"), "license-votes")
    whole = votes.where("phrase and votes = runs").select(
        "key", "label", "phrase", F.col("diagonal").alias("lo"), (F.col("diagonal") + F.col("words")).alias("hi"), F.lit(1.0).alias("score"))
    spans = merged(votes.where("not phrase")).join(known, "template").where(
        (F.col("votes") >= SHARE * F.col("runs")) & (F.col("i1") + LONG - F.col("i0") <= STRETCH * F.col("words"))).select(
        "key", "label", "phrase", F.col("i0").alias("lo"), (F.col("i1") + LONG).alias("hi"),
        F.least(F.lit(1.0), F.round(F.col("votes") / F.col("runs"), 6)).alias("score"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    found = whole.union(spans).groupBy("key").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"), F.min(F.when(F.col("phrase"), F.col("lo"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("lo"))).alias("last_word"),
        joined(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base_labels"),
        joined(F.collect_set("label")).alias("labels"), F.max("score").alias("score"),
        *([F.array_sort(F.collect_list(F.struct("lo", "hi", "label", "score"))).alias("spans")] if keep_spans else []))
    none = F.lit("")
    return base.select("doc_id", "key", "n_words").join(found.hint("merge"), "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), *(["spans"] if keep_spans else []))
