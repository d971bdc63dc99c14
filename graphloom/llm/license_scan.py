"""Licence texts in documents, by diagonal voting.

Every run of k words of every document is hashed and joined to the places of the same run in licence templates. A
match at word i of a document and word j of a template votes for the diagonal i - j; a copy of the template, even
with words changed, lost or added here and there, piles its votes on one diagonal or a few neighbours. Votes are
counted by document, template and diagonal, neighbouring diagonals are merged, and the whole stretch that the template
would cover from there is verified word by word: its score is the share of the template's words found there in order.
A short template's diagonals must be nearer to each other, so that notices in a row are copies each.

Phrases that name a licence are found as well, wherever their words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.llm import kernels as K
from graphloom.llm.shared import map_arrow, materialize

#: The phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Characteristic passages of public licences and of the notices that refer to them.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-notice": "Released under the MIT License.",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-notice": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "boost": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-notice": "Licensed under CC BY-NC 4.0.",
}

#: Words of a run. A run that is shorter than this because its template is short is not possible: templates have more.
RUN = 3


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data, at = K.utf8(pa.array(texts, pa.string()))
    starts, ends, first = K.segment(data, at, K.ALNUM)
    return K.hash_words(data, starts, ends), first


def label_of(template: str) -> str:
    return template.removesuffix("-notice")


def template_places(templates: dict[str, str], k: int) -> list[tuple[int, int, int, int]]:
    """(run, template, place, words of the template) for each run of each template, templates by number."""
    out = []
    for number, text in enumerate(templates.values()):
        words, _ = _words([text])
        if len(words) < k:
            raise ValueError(f"a template needs {k} words: {text!r}")
        out += [(int(h), number, j, len(words)) for j, h in enumerate(K.runs(words, k).view(np.int64).tolist())]
    return out


def slack_of(size: int, slack: int) -> int:
    """How far apart neighbouring diagonals of one copy may be."""
    return max(1, min(slack, size // 8))


def reaches(templates: dict[str, str], k: int, slack: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every run of the templates, in order, and how many words before and behind its first one a copy may cover."""
    of: dict[int, tuple[int, int]] = {}
    for run, _, j, size in template_places(templates, k):
        more = slack_of(size, slack)
        left, right = of.get(run, (0, 0))
        of[run] = max(left, j + more), max(right, size - j + more)
    runs = np.array([*of], np.int64).view(np.uint64)
    order = np.argsort(runs)
    both = np.array([*of.values()], np.int64).reshape(-1, 2)[order]
    return runs[order], both[:, 0], both[:, 1]


_SCANNED = (
    "_row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, "
    "hits array<struct<i:long,run:long,part:int>>, parts array<struct<begin:long,words:array<long>>>"
)


def _scan_batches(batches: Iterator[pa.RecordBatch], phrases: dict[str, str], known: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    named = [(label, _words([phrase])[0]) for phrase, label in phrases.items()]
    runs, left, right = known
    schema = pa.schema([
        *((c, pa.int64()) for c in ("_row", "doc_id", "n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.list_(pa.string())),
        ("hits", pa.list_(pa.struct([("i", pa.int64()), ("run", pa.int64()), ("part", pa.int32())]))), ("parts", pa.list_(pa.struct([("begin", pa.int64()), ("words", pa.list_(pa.int64()))]))),
    ])
    for batch in batches:
        done = 0
        for texts in K.slices(batch.column(1)):
            data, at = K.utf8(texts)
            starts, ends, first = K.segment(data, at, K.ALNUM)
            words = K.hash_words(data, starts, ends)
            n = np.diff(first)
            count = np.zeros(len(texts), np.int64)
            low, high = np.full(len(texts), np.iinfo(np.int64).max), np.full(len(texts), -1)
            labels: dict[int, set[str]] = {}
            for label, phrase in named:
                found = np.flatnonzero(words[: len(words) - len(phrase) + 1] == phrase[0]) if len(words) >= len(phrase) else np.zeros(0, np.int64)
                for j in range(1, len(phrase)):
                    found = found[words[found + j] == phrase[j]]
                doc = np.searchsorted(first, found, side="right") - 1
                fits = found + len(phrase) <= first[doc + 1]
                found, doc = found[fits], doc[fits]
                np.add.at(count, doc, 1)
                np.minimum.at(low, doc, found - first[doc])
                np.maximum.at(high, doc, found - first[doc])
                for d in np.unique(doc).tolist():
                    labels.setdefault(d, set()).add(label)
            # the join's own filter, ahead of it: of all runs only those that some template has leave the worker
            grams = K.runs(words, k)
            found = np.flatnonzero(np.isin(grams, runs))
            doc = np.searchsorted(first, found, side="right") - 1
            fits = found + k <= first[doc + 1]
            found, doc = found[fits], doc[fits]
            hits: dict[int, list] = {}
            parts: dict[int, list] = {}
            if len(found):
                for own in np.split(found, np.flatnonzero(np.diff(doc)) + 1):
                    d = int(np.searchsorted(first, own[0], side="right") - 1)
                    # all words that a copy may cover: overlapping stretches are one part
                    at = np.searchsorted(runs, grams[own])
                    begin, end = np.maximum(own - left[at], first[d]), np.minimum(own + right[at], first[d + 1])
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    new = np.flatnonzero(begin[1:] > end[:-1]) + 1
                    spans = begin[[0, *new]], end[[*(new - 1), -1]]
                    parts[d] = [{"begin": a - int(first[d]), "words": words[a:b].view(np.int64)} for a, b in zip(*(x.tolist() for x in spans), strict=True)]
                    part = np.searchsorted(spans[0], own, side="right") - 1
                    hits[d] = [{"i": i, "run": r, "part": p} for i, r, p in zip((own - first[d]).tolist(), grams[own].view(np.int64).tolist(), part.tolist(), strict=True)]
            some = count > 0
            yield pa.record_batch([
                pa.array(np.arange(row, row + len(texts))), batch.column(0).slice(done, len(texts)), pa.array(n.astype(np.int64)), pa.array(count),
                pa.array(low, mask=~some), pa.array(high, mask=~some), pa.array([sorted(labels.get(d, ())) for d in range(len(texts))], schema.field("base_labels").type),
                pa.array([hits.get(d) for d in range(len(texts))], schema.field("hits").type), pa.array([parts.get(d) for d in range(len(texts))], schema.field("parts").type),
            ], schema=schema)
            done += len(texts)
            row += len(texts)


def _common(words: np.ndarray, template: np.ndarray) -> np.ndarray:
    """For each number of first words, the most template words that stand among them in the template's order."""
    best, out = np.zeros(len(template) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
    for i, w in enumerate(words):
        best[1:] = np.maximum.accumulate(np.where(template == w, best[:-1] + 1, best[1:]))
        out[i + 1] = best[-1]
    return out


def in_order(words: np.ndarray, template: np.ndarray) -> tuple[int, int, int]:
    """The most template words that stand in ``words`` in the template's order, and the stretch that ends first among
    those that have so many, from its last possible beginning."""
    upto = _common(words, template)
    most = int(upto[-1])
    end = int(np.searchsorted(upto, most))
    back = _common(words[:end][::-1], template[::-1])
    return most, end - int(np.searchsorted(back, most)), end


def _verify_batches(batches: Iterator[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    known = [_words([t])[0].view(np.int64) for t in templates.values()]
    for batch in batches:
        of = batch.column(1).to_pylist()
        found = [in_order(w.values.to_numpy(), known[t]) for t, w in zip(of, batch.column(3), strict=True)]
        begin = batch.column(2).to_pylist()
        columns = zip(*((n / len(known[t]), n, at + a, at + b) for (n, a, b), t, at in zip(found, of, begin, strict=True)), strict=True) if of else [[]] * 4
        yield pa.record_batch([batch.column(0), batch.column(1), *(pa.array(c, kind) for c, kind in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["_row", "template", "score", "matched", "begin", "end"])


def license_spans(scanned: DataFrame, templates: dict[str, str], k: int, slack: int, least: float) -> DataFrame:
    """(_row, label, score, begin, end): verified copies of templates, in words of the document; none overlaps a better one."""
    spark = scanned.sparkSession
    rows = [(*p, slack_of(p[3], slack)) for p in template_places(templates, k)]
    places = spark.createDataFrame(rows, "run long, template int, j long, size long, slack int")
    hits = scanned.filter("hits is not null").select("_row", F.explode("hits").alias("h")).select("_row", "h.i", "h.run", "h.part")
    # the templates are fixed values of this module or the caller's: a few thousand places
    votes = hits.join(F.broadcast(places), "run").groupBy("_row", "template", "size", "slack", (F.col("i") - F.col("j")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("part").alias("part"))
    order = Window.partitionBy("_row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack"), F.lit(False)).cast("int")
    votes = votes.withColumn("apart", apart).withColumn("band", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # a band that is wider than its template is cut into bands as wide
    lowest = F.min("diagonal").over(Window.partitionBy("_row", "template", "band"))
    votes = votes.withColumn("piece", F.floor((F.col("diagonal") - lowest) / F.col("size")))
    bands = votes.groupBy("_row", "template", "size", "slack", "band", "piece").agg(F.sum("votes").alias("votes"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"), F.min("part").alias("part"))
    # with a share of its words in place, in stretches of k at least, a copy has so many votes
    claims = bands.filter(F.col("votes") >= F.greatest(F.lit(1.0), least * F.col("size") / k - 1))
    # where the template lies from the first of its diagonals to the last: that is inside one part, as all its hits are
    claims = claims.select("_row", "part", "template", F.greatest(F.lit(0), F.col("low") - F.col("slack")).alias("from"), (F.col("high") + F.col("size") + F.col("slack")).alias("to"))
    parts = scanned.filter("hits is not null").select("_row", F.posexplode("parts").alias("part", "p"))
    span = claims.join(parts, ["_row", "part"])
    words = F.slice(F.col("p.words"), (F.col("from") - F.col("p.begin") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    checked = map_arrow(span.select("_row", "template", "from", words.alias("words")), lambda it: _verify_batches(it, templates), "_row long, template int, score double, matched long, begin long, end long")
    label = F.element_at(F.array(*(F.lit(label_of(t)) for t in templates)), F.col("template") + 1)
    # bands of one copy give it twice
    good = checked.filter(F.col("score") >= least).distinct()
    return _best(good, max(r[3] for r in rows) + 2 * slack).select("_row", label.alias("label"), "score", "begin", "end")


def _best(spans: DataFrame, wide: int) -> DataFrame:
    """Without the spans that overlap a better one: licences quote each other, and the one with most words in place is meant.

    Spans meet in cells of ``wide`` words, so that a text with very many copies isn't compared with itself."""
    cells = spans.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / wide), F.floor((F.col("end") - 1) / wide))))
    one = F.struct("begin", "end", F.struct(F.col("matched"), -F.col("template"), -F.col("begin"), -F.col("end")).alias("rank"))
    met = cells.withColumn("one", one).withColumn("every", F.collect_list("one").over(Window.partitionBy("_row", "cell")))
    beaten = F.exists("every", lambda t: (t["begin"] < F.col("end")) & (F.col("begin") < t["end"]) & (t["rank"] > F.col("one.rank")))
    return met.groupBy("_row", "template", "score", "begin", "end").agg(F.max(beaten).alias("beaten")).filter(~F.col("beaten"))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, k: int = RUN, slack: int = 8, least: float = 0.6) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of ``docs``.

    Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of the text with A-Z lower-cased. n_base counts the places where a
    phrase's words stand consecutively, first_word and last_word are the smallest and largest (null without any).
    spans: (label, score, begin, end) of verified template copies; of spans that overlap the one with most template words
    stays, of equal ones that of the first template, then the first. score: the best span's, at least 0.5 with a phrase,
    else 0. A null or empty text has no words; a null doc_id stays null; repeated rows each have their row; an empty
    table gives none; other columns are ignored. Texts are taken whole, however long; templates are the caller's, some
    hundred words each: their places are broadcast.
    """
    phrases, templates = phrases or BASE_PHRASES, templates or TEMPLATES
    known = reaches(templates, k, slack)
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scanned = materialize(map_arrow(thin, lambda it: _scan_batches(it, phrases, known, k), _SCANNED), "licence-runs")
    spans = license_spans(scanned, templates, k, slack, least).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("label", "score", "begin", "end"))).alias("spans"))
    out = scanned.drop("hits", "parts").join(spans, "_row", "left")
    empty = F.expr("cast(array() as array<struct<label:string,score:double,begin:long,end:long>>)")
    out = out.withColumn("spans", F.coalesce("spans", empty))
    labels = F.array_join(F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"])))), ",")
    score = F.greatest(F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), labels.alias("labels"), score.alias("score"), "spans")
