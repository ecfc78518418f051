"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a run of words; templates are dealt to classes by their length (powers of two), and a
class of size s cuts every whole text into blocks of 2 * s words, one beginning every s words, so
that a template's length of words always lies whole in a block. The words that occur in templates
are ordered by their frequency over all documents, rarest first; other words cannot be shared and
are left out. A block meets a template when their shared distinct words are at least
``CONTAINMENT`` percent of the template's. If so, the block's first words in that order and the
template's first words share one (prefix filter), the block has as many words as must be shared
(length filter), and the words after the first shared one suffice (positional filter); what is
left is verified by the whole intersection. Templates are a parameter and bounded, so their side
of the join is broadcast; blocks are rows of Spark, and a long text is many of them.

Defined cases: a null text is empty and has no words; null ids and repeated rows are carried, a
row each; other columns are ignored; an empty table gives an empty result; ``score`` is 1 where a
phrase stands, else the greatest containment of a template that is met, else 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW_BITS, whole_text, written

WORDS = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Percent of a template's distinct words that a block must hold.
CONTAINMENT = 80

# fixed values: phrases of the base rule and their labels
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

# fixed values: public license notices, by label
TEMPLATES = [
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See
        the License for the specific language governing permissions and limitations under the License."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright notice,
        this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above
        copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
        materials provided with the distribution."""),
    ("cc-by", """This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy
        of this license, visit http://creativecommons.org/licenses/by/4.0/"""),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc0", """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring
        rights to this software to the public domain worldwide. This software is distributed without any warranty."""),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
        WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software."""),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
        was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
]


def words_of(text: bytes) -> list[bytes]:
    """The words after lower-casing A to Z."""
    return re.findall(WORDS, text.lower())


class Template:
    """A template's words, its class, and how many distinct ones a block must share."""

    def __init__(self, label: str, text: str, containment: int):
        words = words_of(text.encode())
        if not words:
            raise ValueError(f"template {label!r} has no words")
        self.label, self.words = label, frozenset(words)
        self.step = 1 << (len(words) - 1).bit_length()
        self.least = -(-containment * len(self.words) // 100)


def _frequencies(docs: DataFrame, known: frozenset, text_col: str) -> dict[bytes, int]:
    """Occurrences of each template word over all documents: as many rows as there are such words."""
    def count(batches):
        import pyarrow as pa
        from collections import Counter
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(filter(known.__contains__, words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         ["word", "n"])

    parts = docs.select(whole_text(text_col).cast("binary")).mapInArrow(count, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in known}


def _scanned(docs: DataFrame, phrases, templates: list[Template], rank: dict[bytes, int], id_col: str,
             text_col: str) -> DataFrame:
    """One row per document: its place, words, base places and labels, and the blocks that pass the
    length filter, each as its template words in the global order."""
    base = [(words_of(p.encode()), label) for p, label in phrases]
    classes = {}
    for t in templates:
        own, least = classes.get(t.step, (frozenset(), 1 << 30))
        classes[t.step] = (own | t.words, min(least, t.least))
    of_class = {step: ({w: rank[w] for w in own}, least) for step, (own, least) in classes.items()}

    def places(words: list[bytes]) -> list[tuple[int, str]]:
        found = []
        for phrase, label in base:
            at = -1
            for _ in range(words.count(phrase[0])):
                at = words.index(phrase[0], at + 1)
                if words[at:at + len(phrase)] == phrase:
                    found.append((at, label))
        return found

    def blocks(words: list[bytes]) -> list[dict]:
        import numpy as np
        out = []
        for step, (ranks, least) in of_class.items():
            found = [*map(ranks.get, words)]
            at = [i for i, r in enumerate(found) if r is not None]
            if len(at) < least:
                continue
            place = np.array(at, np.int64)
            key = np.array([found[i] for i in at], np.int64)
            # a word lies in the block that begins at or before it and in the one before that
            both = np.concatenate([place // step, place // step - 1]) * len(rank) + np.concatenate([key, key])
            both = np.unique(both[both >= 0])
            block, key = np.divmod(both, len(rank))
            cuts = np.flatnonzero(np.diff(block, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - a >= least:
                    out.append({"step": step, "start": int(block[a]) * step, "least": least, "ranks": key[a:b].tolist()})
        return out

    fields = ("row long, n_words long, n_base long, first_word long, last_word long, base array<string>, "
              "blocks array<struct<step: int, start: long, least: int, ranks: array<int>>>")
    id_type = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << ROW_BITS
        kinds = [("row", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                 ("last_word", pa.int64()), ("base", pa.list_(pa.string())),
                 ("blocks", pa.list_(pa.struct([("step", pa.int32()), ("start", pa.int64()), ("least", pa.int32()),
                                                ("ranks", pa.list_(pa.int32()))])))]
        for batch in batches:
            made = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                found = places(words)
                at = [i for i, _ in found]
                made.append((row, len(words), len(at), min(at, default=None), max(at, default=None),
                             sorted({label for _, label in found}), blocks(words)))
                row += 1
            columns = list(zip(*made)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, k) for c, (_, k) in zip(columns, kinds)],
                                             ["doc_id"] + [n for n, _ in kinds])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, {fields}")


def _met(stored: DataFrame, templates: list[Template], rank: dict[bytes, int]) -> DataFrame:
    """(row, label, start, step, containment) of every block and template that meet; a row for each
    shared word of the prefixes that passes."""
    sides = []
    for t in templates:
        order = sorted(rank[w] for w in t.words)
        sides += [(t.step, token, at, t.label, len(order), t.least, order) for at, token in enumerate(order[:len(order) - t.least + 1])]
    side = stored.sparkSession.createDataFrame(
        sides, "step int, token int, t_at int, label string, t_size int, t_least int, t_ranks array<int>")
    blocks = stored.select("row", F.explode("blocks").alias("b")).select("row", "b.*")
    size = F.size("ranks")
    prefix = blocks.select("*", F.posexplode(F.slice("ranks", F.lit(1), size - F.col("least") + 1)).alias("at", "token"))
    pairs = prefix.join(F.broadcast(side), ["step", "token"])  # as many rows as template words
    pairs = pairs.filter((size >= F.col("t_least"))
                         & (F.least(F.col("t_size") - F.col("t_at"), size - F.col("at")) >= F.col("t_least")))
    shared = F.size(F.array_intersect("ranks", "t_ranks"))
    return pairs.withColumn("shared", shared).filter(F.col("shared") >= F.col("t_least")).select(
        "row", "label", "start", "step", (F.col("shared") / F.col("t_size")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
                 containment: int = CONTAINMENT) -> tuple[DataFrame, DataFrame]:
    """(documents, blocks). Documents: a row each with doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score. Blocks: doc_id, label, start (word), words, containment of each met template."""
    ready = [Template(label, text, containment) for label, text in templates]
    known = frozenset().union(*(t.words for t in ready))
    often = _frequencies(docs, known, text_col)
    rank = {w: i for i, w in enumerate(sorted(known, key=lambda w: (often[w], w)))}
    stored = written(_scanned(docs, phrases, ready, rank, id_col, text_col), "license-blocks")
    met = _met(stored, ready, rank)
    per_row = met.groupBy("row").agg(F.collect_set("label").alias("found"), F.max("containment").alias("most"))
    out = stored.drop("blocks").join(per_row, "row", "left")
    both = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    documents = out.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
        F.array_join(both, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("most", F.lit(0.0))).alias("score"))
    blocks = met.distinct().join(stored.select("row", "doc_id"), "row").select(
        "doc_id", "label", "start", (2 * F.col("step")).alias("words"), "containment")
    return documents, blocks


def oracle(phrases=PHRASES, templates=TEMPLATES, containment: int = CONTAINMENT) -> str:
    """The same documents by comparing every block with every template."""
    import string
    ready = [Template(label, text, containment) for label, text in templates]
    spots = ["unnest(list_transform(list_filter(range(1, len(w) + 1), lambda i: "
             + " AND ".join(f"w[i + {k}] = '{x.decode()}'" for k, x in enumerate(words_of(p.encode())))
             + f"), lambda i: {{'spot': i - 1, 'label': '{label}'}})) AS p" for p, label in phrases]
    base = " UNION ALL ".join(f"SELECT r, {s} FROM d" for s in spots)
    blocks = " UNION ALL ".join(
        f"SELECT r, {step} AS step, list_distinct(w[i + 1:i + {2 * step}]) AS b "
        f"FROM (SELECT r, w, unnest(range(0, len(w), {step})) AS i FROM d)" for step in sorted({t.step for t in ready}))
    rows = ", ".join("('{}', {}, {}, [{}])".format(t.label, t.step, t.least, ", ".join(f"'{w.decode()}'" for w in sorted(t.words)))
                     for t in ready)
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
             translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT r, p.spot AS spot, p.label AS label FROM ({base})),
base AS (SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY r),
t(label, step, least, words) AS (VALUES {rows}),
blocks AS ({blocks}),
met AS (SELECT r, label, len(list_intersect(b, words)) / len(words) AS c
        FROM blocks JOIN t USING (step) WHERE len(list_intersect(b, words)) >= least),
most AS (SELECT r, max(c) AS most FROM met GROUP BY r),
labels AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT r, label FROM places UNION SELECT r, label FROM met) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(most, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN labels USING (r) LEFT JOIN most USING (r)
"""
