"""License scans by diagonal voting.

Every three words in a row of a text are hashed and joined to the places where they
stand in license templates.  Place in the text minus place in the template is a
diagonal: an unchanged template votes for one diagonal with all its places, an edited
one for a few neighbours.  Votes are added up by text, template and diagonal,
neighbouring diagonals are merged to spans, and a span's votes are verified word by
word.  A span whose verified places make up ``least_share`` of its template's gives
the template's label and that share as score.

The three base phrases are templates of their own whose diagonals are never merged;
all their words must stand there.  Findings belong to a text's SHA-256, so copies are
judged once and a hot text is summed up before it is shuffled.

Defined results: NULL and blank texts have no words, no places and score 0; repeated
rows get equal results; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitlens.llm.common import settle, text_or_empty
from traitlens.llm.word_hash import text_hashes, windows
from traitlens.sources.store import join_small

GRAM = 3
#: Share of a template's places that a span must hold.
LEAST_SHARE = 0.6

# The phrases of the contract.
BASE_PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Sentences of public licenses, as published; each is a template of the label.
TEMPLATES = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "Licensed under the MIT License",
    ),
    "apache-2": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
        "under the terms of the GNU General Public License",
    ),
    "lgpl": ("it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "agpl": ("it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",),
    "mpl-2": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain",),
    "zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution ShareAlike License"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution NonCommercial License"),
    "all-rights-reserved": ("All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher",),
}

_CAPITALS, _SMALL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Small ASCII letters, digits and all bytes beyond ASCII stay; A-Z are lowered; the rest are spaces.
_PLAIN = bytes(c if c in _SMALL or 0x30 <= c <= 0x39 or c > 0x7F else _SMALL[c - 65] if c in _CAPITALS else 32 for c in range(256))


def plain(text: str) -> bytes:
    """The text's words with single signs between them turned to spaces."""
    return text.encode().translate(_PLAIN)


def template_list(templates: Mapping[str, tuple[str, ...]] = TEMPLATES, base: Mapping[str, str] = BASE_PHRASES) -> list[tuple[int, str, bool, list[bytes]]]:
    """(number, label, whether base, words) of all templates; base phrases come first."""
    rows = [(label, True, phrase) for label, phrase in base.items()] + [(label, False, text) for label, texts in templates.items() for text in texts]
    return [(i, label, own, plain(text).split()) for i, (label, own, text) in enumerate(rows)]


def _band(words: int) -> int:
    """Diagonals of one span lie at most this far from the next; short templates take one diagonal."""
    return min(8, words // 8)


def template_grams(df: DataFrame, templates: list[tuple[int, str, bool, list[bytes]]]) -> DataFrame:
    """gram, template, tpos: every place of every template, a table of the templates' own size."""
    rows = []
    for number, _, _, words in templates:
        hashes = windows(next(iter(text_hashes([b" ".join(words).decode()]))), GRAM)
        rows += [(int(h), number, i) for i, h in enumerate(hashes.view(np.int64))]
    return df.sparkSession.createDataFrame(rows, "gram long, template int, tpos int")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def rolling_grams(texts: Column) -> Column:
    """Hashes of all three words in a row of each text, in order."""

    @F.pandas_udf("array<long>")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            each = text_hashes(plain(t).decode() for t in batch)
            yield pd.Series([windows(w, GRAM).view(np.int64) for w in each])

    return hashed(texts)


def diagonal_votes(docs: DataFrame, grams: DataFrame, text_col: str = "text") -> DataFrame:
    """key, template, diagonal and the template places found on it."""
    text = text_or_empty(text_col)
    rolled = docs.select(text_key(text).alias("key"), rolling_grams(text).alias("grams"))
    placed = rolled.select("key", F.posexplode("grams").alias("pos", "gram"))
    hits = join_small(placed, grams, ["gram"])
    return hits.groupBy("key", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("votes"))


def merged_spans(votes: DataFrame, templates: list[tuple[int, str, bool, list[bytes]]], least_share: float = LEAST_SHARE) -> DataFrame:
    """key and its candidate spans: template and votes by diagonal of neighbouring diagonals with enough places."""
    sizes = votes.sparkSession.createDataFrame(
        [(i, max(1, len(w) - GRAM + 1), _band(len(w)) if not own else 0, 1.0 if own else least_share) for i, _, own, w in templates],
        "template int, places int, band int, least double",
    )
    known = votes.join(F.broadcast(sizes), "template")
    order = Window.partitionBy("key", "template").orderBy("diagonal")
    opens = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > F.col("band")).cast("int"), F.lit(1))
    numbered = known.withColumn("opens", opens).withColumn("span", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("key", "template", "span").agg(
        F.collect_list(F.struct("diagonal", "votes")).alias("diagonals"), F.first("places").alias("places"), F.first("least").alias("least")
    )
    distinct = F.size(F.array_distinct(F.flatten(F.col("diagonals.votes"))))
    enough = spans.where(distinct >= F.col("least") * F.col("places"))
    return enough.groupBy("key").agg(F.collect_list(F.struct("template", "diagonals")).alias("spans"))


def verified(text: Column, spans: Column, templates: list[tuple[int, str, bool, list[bytes]]], least_share: float = LEAST_SHARE) -> Column:
    """The contract's figures of a text from its candidate spans, each vote held against the words."""

    def judged(words: list[bytes], found) -> tuple:
        base_places, base, labels, best = set(), set(), set(), 0.0
        for span in found if found is not None else ():
            _, label, own, wanted = templates[span["template"]]
            places, seen = max(1, len(wanted) - GRAM + 1), set()
            for line in span["diagonals"]:
                start = line["diagonal"]
                seen.update(t for t in line["votes"] if words[start + t : start + t + GRAM] == wanted[t : t + GRAM])
            share = len(seen) / places
            if share < (1.0 if own else least_share):
                continue
            labels.add(label)
            best = max(best, share)
            if own:
                base.add(label)
                base_places.add((label, span["diagonals"][0]["diagonal"]))
        starts = [s for _, s in base_places]
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), best

    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    @F.pandas_udf("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
    def judge(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, founds in batches:
            frame = pd.DataFrame([judged(plain(t).split(), found) for t, found in zip(texts, founds)], columns=columns)
            yield frame.astype({c: "Int64" for c in columns[:4]})

    return judge(text, spans)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Mapping[str, tuple[str, ...]] = TEMPLATES, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: words, base places, labels and the best verified share."""
    known = template_list(templates)
    grams = template_grams(docs, known)
    spans = settle(merged_spans(diagonal_votes(docs, grams, text_col), known, least_share))
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), text_key(text).alias("key"))
    joined = join_small(rows, spans, ["key"], "left")
    return joined.select("doc_id", verified(F.col("text"), F.col("spans"), known, least_share).alias("f")).select("doc_id", "f.*")
