"""License scans: exact set-similarity join of text blocks with license templates.

Method: a block and a template are sets of words. A block is a line of the text, or a paragraph, a run of
several lines between blank ones, which finds notices wrapped over lines; ``paragraphs=False`` leaves those out. A
template is found in a block if the block holds at least ``CONTAINMENT`` of the template's words. The
join is exact and filtered in three ways. Words are ordered by the number of blocks that hold them, rarest
first. Prefix: a block with enough of a template's words holds one of the template's first
``size - needed + 1`` ones. Length: the block has as many words as are needed. Position: from the places
of the first shared word in both, enough shared words can still follow. What is left is verified on
the full sets. All of it is DataFrame functions.

The lists that are joined to blocks have a row for each word of the templates. Up to ``BROADCAST`` of them are
broadcast, longer ones are left to Spark's own choice. Blocks lose all other words before the first shuffle.
Licenses that are worded alike are found together where their notices share enough words, as the GPL in a notice of
the LGPL.

Beside the method, phrases are looked up word by word in the whole text.

Defined cases: null text is empty: no words, no labels, score 0. Repeated rows get the same result
each, and each counts as a block of its own. A null id is an id.
"""

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelstate.llm.common import NOT_WORD, ascii_lower, same, saved, whole

CONTAINMENT = 0.8
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Rows of the templates' words that are broadcast at most.
BROADCAST = 100_000
#: Notices as their licenses give them, and names; a label may have several. Of up to four words all have to be there,
#: which tells licenses apart whose notices differ in a word.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files, to deal in the Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under "
               "the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY "
               "KIND, either express or implied"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms "
            "of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("proprietary", "All rights reserved."),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or "
            "substantial portions of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except "
               "in compliance with the License"),
    ("lgpl", "GNU Lesser General Public"),
    ("agpl", "GNU Affero General Public"),
    ("mpl", "Mozilla Public License"),
    ("epl", "Eclipse Public License"),
    ("boost", "Boost Software License - Version"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions "
            "and the following disclaimer"),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions "
            "and the following disclaimer in the documentation and/or other materials provided with the "
            "distribution"),
    ("bsd-3", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse "
              "or promote products derived from this software without specific prior written permission"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee "
            "is hereby granted, provided that the above copyright notice and this permission notice appear in "
            "all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring "
            "rights to this work"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike"),
    ("cc-by-sa", "CC BY-SA"),
    *((label, f"SPDX-License-Identifier: {label}")
      for label in ("mit", "apache", "gpl", "lgpl", "agpl", "mpl", "epl", "bsd", "isc", "unlicense", "cc0")),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")


def templates(spark: SparkSession, given=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``template, label, _all, size, needed``: the templates as sets of words."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(given)],
                                 "template int, label string, text string")
    sets = rows.select("template", "label", F.array_distinct(words_of(F.col("text"))).alias("_all"))
    sets = sets.withColumn("size", F.size("_all"))
    needed = F.ceil(F.col("size") * containment - 1e-9).cast("int")
    return sets.where(F.col("size") > 0).withColumn("needed", F.greatest(needed, F.lit(1)))


def _vocabulary(given, containment) -> tuple[list[str], int]:
    """The templates' words, and how many of them the least demanding template needs."""
    import re

    found, least = set(), None
    for _, text in given:
        own = {w for w in re.split(NOT_WORD, text.lower()) if w}
        found |= own
        need = max(1, math.ceil(len(own) * containment - 1e-9))
        least = need if least is None else min(least, need)
    return sorted(found), least or 1


def _may_hold(held: Column, given, containment: float) -> Column:
    """Whether a set of words is enough for one of the templates."""
    found = F.lit(False)
    for _, text in given:
        own, needed = _vocabulary([("", text)], containment)
        if own:
            shared = F.array_intersect(held, F.array(*[F.lit(w) for w in own]))
            found = found | (F.size(shared) >= needed)
    return found


def _wrapped_blocks(docs: DataFrame, key: str, text: str, given, containment: float) -> DataFrame:
    """Lines and paragraphs as ``blocks`` gives them; a paragraph of one line is that line.

    A text that as a whole has too few words for every template has no block with enough. A
    paragraph's words are those of its lines, so that text is cut into words once more only.
    """
    vocabulary, least = _vocabulary(given, containment)
    known = F.array(*[F.lit(w) for w in vocabulary])

    def held(part: Column) -> Column:
        return F.array_intersect(words_of(part), known)

    # what goes through an explode is computed once: filters are not pushed below it
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(whole(text)).alias("_hash"),
                       whole(text).alias("_text"), F.explode(F.array(held(whole(text)))).alias("_all"))
    rows = rows.where(F.size("_all") >= least).where(_may_hold(F.col("_all"), given, containment))
    paragraph = F.split("_text", r"\n[\x20\x09-\x0D]*\n")
    rows = rows.select("_id", "_hash", F.posexplode(paragraph).alias("_no", "_part"))
    rows = rows.select("_id", "_hash", "_no", F.explode(F.array(
        F.transform(F.split("_part", "\n"), held))).alias("_lines"))
    several = F.when(F.size("_lines") > 1, F.array(F.array_distinct(F.flatten("_lines"))))
    rows = rows.select("_id", "_hash", "_no", F.posexplode(
        F.concat("_lines", F.coalesce(several, F.array().cast("array<array<string>>")))).alias("_at", "held"))
    return rows.where(F.size("held") >= least).select(
        "_id", "_hash", F.struct("_no", "_at").alias("_block"), "held")


def blocks(docs: DataFrame, key: str, text: str, given=TEMPLATES,
           containment: float = CONTAINMENT, paragraphs: bool = True) -> DataFrame:
    """``_id, _hash, _block, held``: blocks with enough words of the templates, and these words."""
    if paragraphs:
        return _wrapped_blocks(docs, key, text, given, containment)
    vocabulary, least = _vocabulary(given, containment)
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(whole(text)).alias("_hash"),
                       F.posexplode(F.split(whole(text), "\n")).alias("_block", "_part"))
    known = F.array(*[F.lit(w) for w in vocabulary])
    rows = rows.select("_id", "_hash", "_block",
                       F.array_intersect(words_of(F.col("_part")), known).alias("held"))
    return rows.where(F.size("held") >= least)


def found(docs: DataFrame, key: str = "doc_id", text: str = "text", given=TEMPLATES,
          containment: float = CONTAINMENT, paragraphs: bool = True) -> DataFrame:
    """``_id, _hash, _block, label, contained``: blocks with a template at the threshold."""
    spark = docs.sparkSession
    # read twice, to count the words and to join
    held = saved(blocks(docs, key, text, given, containment, paragraphs), "blocks")
    each = held.select("_id", "_hash", "_block", F.size("held").alias("n"), F.explode("held").alias("word"))
    counted = each.groupBy("word").agg(F.count("*").alias("count"))
    sets = templates(spark, given, containment)
    ranked = sets.select("template", "label", "size", "needed", F.explode("_all").alias("_word"))
    # the order of words: fewest blocks first; at most as many rows as the templates have words
    order = ranked.select("_word").distinct().join(counted, F.col("_word") == counted["word"], "left")
    order = order.select("_word", F.struct(F.coalesce("count", F.lit(0)).alias("count"),
                                           F.col("_word").alias("by")).alias("rank"))
    small = len(_vocabulary(given, containment)[0]) * len(given) <= BROADCAST
    order = F.broadcast(order) if small else order
    ranked = ranked.join(order, "_word")
    sets = ranked.groupBy("template", "label", "size", "needed").agg(
        F.sort_array(F.collect_list("rank")).alias("ordered"))
    prefix = sets.select(
        "template", "label", "size", "needed",
        F.transform("ordered", lambda r: r["by"]).alias("all"),
        F.posexplode(F.slice("ordered", 1, F.col("size") - F.col("needed") + 1)).alias("at", "_rank"))
    prefix = prefix.withColumn("_first", F.col("_rank.by"))
    prefix = F.broadcast(prefix) if small else prefix
    placed = each.join(order, each["word"] == order["_word"])
    places = placed.groupBy("_id", "_hash", "_block", "n").agg(
        F.sort_array(F.collect_set("rank")).alias("ranks"))
    places = places.select("_id", "_hash", "_block", "n",
                           F.transform("ranks", lambda r: r["by"]).alias("ordered"))
    first = places.select("*", F.posexplode("ordered").alias("spot", "_token"))
    pairs = first.join(prefix, first["_token"] == prefix["_first"])
    pairs = pairs.where(F.col("n") >= F.col("needed"))  # length
    left = F.least(F.col("size") - F.col("at"), F.col("n") - F.col("spot"))
    # position: the shared words before this one are few, as it is in the template's prefix
    before = F.least("at", "spot")
    pairs = pairs.where(left + before >= F.col("needed"))
    pairs = pairs.dropDuplicates(["_id", "_hash", "_block", "template"])
    shared = F.size(F.array_intersect("ordered", "all"))
    pairs = pairs.withColumn("shared", shared).where(F.col("shared") >= F.col("needed"))
    return pairs.select("_id", "_hash", "_block", "label",
                        (F.col("shared") / F.col("size")).alias("contained"))


def phrase_columns(df: DataFrame, carried: list[str], text: str, phrases=PHRASES) -> DataFrame:
    """``carried`` columns and ``_n_words, _n_base, _first, _last, _base`` of each row.

    Words stand between two blanks each, so that one place of a phrase takes no blank from the next.
    """
    plain = F.concat(F.lit("  "), F.array_join(words_of(whole(text)), "  "), F.lit("  "))
    step = df.select(*carried, plain.alias("_plain"))

    def count(part: Column) -> Column:
        return F.size(F.array_remove(F.split(part, " +"), "")).cast("long")

    step = step.withColumn("_n_words", count(F.col("_plain")))
    names = []
    for i, phrase in enumerate(phrases):
        held = f" {phrase.replace(' ', '  ')} "
        parts = F.when(F.contains("_plain", F.lit(held)), F.split("_plain", held))
        step = step.withColumn(f"_p{i}", parts)
        names.append((f"_p{i}", len(phrase.split())))
    places = sum((F.coalesce(F.size(p) - 1, F.lit(0)) for p, _ in names), F.lit(0))
    starts = [F.when(F.col(p).isNotNull(), count(F.get(p, F.lit(0)))) for p, _ in names]
    ends = [F.when(F.col(p).isNotNull(),
                   F.col("_n_words") - count(F.get(p, F.size(p) - 1)) - size) for p, size in names]
    labels = F.filter(F.array(*[F.when(F.col(p).isNotNull(), F.lit(label)) for (p, _), label in
                                zip(names, phrases.values(), strict=True)]), lambda x: x.isNotNull())
    return step.select(*carried, "_n_words", places.cast("long").alias("_n_base"),
                       F.least(*starts).alias("_first"), F.greatest(*ends).alias("_last"),
                       labels.alias("_base"))


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text", given=TEMPLATES,
            containment: float = CONTAINMENT, paragraphs: bool = True) -> DataFrame:
    """One row for each document: places of the phrases, labels, and the best containment found."""
    own = docs.select(F.col(key).alias("_id"), F.xxhash64(whole(text)).alias("_hash"),
                      F.col(text).alias("_text"))
    base = phrase_columns(own, ["_id", "_hash"], "_text")
    hits = found(docs, key, text, given, containment, paragraphs).groupBy(
        F.col("_id").alias("_rid"), F.col("_hash").alias("_rhash")).agg(
        F.collect_set("label").alias("_labels"), F.max("contained").alias("_score"))
    both = base.join(hits, same(base, hits, {"_id": "_rid", "_hash": "_rhash"}), "left")
    none = F.array().cast("array<string>")

    def listed(labels: Column) -> Column:
        return F.array_join(F.sort_array(F.array_distinct(labels)), ",")

    return both.select(
        F.col("_id").alias(key), F.col("_n_words").alias("n_words"), F.col("_n_base").alias("n_base"),
        F.col("_first").alias("first_word"), F.col("_last").alias("last_word"),
        listed(F.col("_base")).alias("base_labels"),
        listed(F.concat("_base", F.coalesce("_labels", none))).alias("labels"),
        F.coalesce("_score", F.lit(0.0)).alias("score"))
