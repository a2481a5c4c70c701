"""License scans by diagonal voting.

Every text is cut into words; the hashes of all its rolling word k-grams (k = 2)
are joined in Spark with the k-gram positions of the license templates.  A match
whose words really are equal votes for the diagonal *place in the text - place
in the template*.  Votes are counted by template and diagonal.  A diagonal with
a vote at each place of the template is an exact occurrence.  Diagonals at most
``GAP`` apart are merged into one span, which tolerates words put in or left
out.  A span is verified: of its votes only the longest sequence counts that
goes forward in the text and in the template, so a place repeated or out of
order adds nothing.  A span that covers at least ``COVER`` of its template's
k-grams so gives the template's label.

The templates are a fixed list, so their broadcast has a fixed size, and k-grams
that no template has are dropped where the text is read.  Only votes are
shuffled, by row.  Everything is DataFrame functions.

Defined cases: null counts as empty; a text without words has no places, empty
labels and score 0; overlapping places of different phrases all count; rows that
repeat an id, or have none, are judged by themselves and give a row each; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .exact_dedup import lower_ascii
from .rows import KEY, keyed

GAP = 3
COVER = 0.6
#: The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Notices by which the public licenses are commonly declared.
NOTICES = [
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nd", "licensed under cc by nd 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
]
#: ASCII bytes that separate words, as a class and as characters to trim.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TRIM = "".join(chr(c) for c in range(128) if not chr(c).isdigit() and not "a" <= chr(c) <= "z")


def words_of(text: Column) -> Column:
    """Words of the lower-cased text."""
    text = F.btrim(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), F.lit(_TRIM))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SEPARATORS))


def templates(spark: SparkSession, phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """k-gram positions: hash, template, label, base, size, tpos, two words."""
    rows = []
    for t, (label, text, base) in enumerate([(v, k, True) for k, v in phrases.items()] + [(v, k, False) for v, k in notices]):
        words = text.split()
        rows += [(t, label, base, len(words), i, words[i], words[i + 1]) for i in range(len(words) - 1)]
    frame = spark.createDataFrame(rows, "template int, label string, base boolean, size int, tpos int, one string, two string")
    return frame.withColumn("gram", F.xxhash64("one", "two"))


def votes(docs: DataFrame, grams: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Verified votes with each row's number of words; a row without votes
    comes with nulls."""
    known = [r[0] for r in grams.select("gram").distinct().collect()]  # of the fixed templates
    texts = keyed(docs).select(KEY, F.col(id_col).alias("doc_id"), words_of(F.col(text_col)).alias("words"))
    rolled = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("one"), F.get("words", i + 1).alias("two"), F.xxhash64(w, F.get("words", i + 1)).alias("gram")))
    places = texts.select(KEY, "doc_id", F.size("words").alias("n_words"), F.explode_outer(F.filter(rolled, lambda x: x["gram"].isin(known))).alias("x"))
    met = places.select(KEY, "doc_id", "n_words", "x.*").join(F.broadcast(grams), ["gram", "one", "two"], "left")
    return met.select(KEY, "doc_id", "n_words", "pos", "template", "label", "base", "size", "tpos")


def in_order(found: Column, size: Column) -> Column:
    """Length of the longest sequence of votes (pos, back) that ascends in
    both places; ``back`` is the template's place from its end, so that of the
    votes at one word at most one counts."""
    best = F.array_repeat(F.lit(0), size)  # by template place: the longest sequence that ends there

    def add(acc: Column, v: Column) -> Column:
        at = size - 1 - v["back"]
        longer = 1 + F.coalesce(F.array_max(F.slice(acc, 1, at)), F.lit(0))
        return F.transform(acc, lambda x, i: F.when(i == at, F.greatest(x, longer)).otherwise(x))

    return F.array_max(F.aggregate(F.array_sort(found), best, add))


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", phrases: dict[str, str] = PHRASES, notices=NOTICES) -> DataFrame:
    """Per row: doc_id, n_words, spans (template label, base, start, end, coverage)."""
    found = votes(docs, templates(docs.sparkSession, phrases, notices), text_col, id_col)
    about = [KEY, "doc_id", "n_words", "template", "label", "base", "size"]
    vote = F.when(F.col("template").isNotNull(), F.struct("pos", (F.col("size") - 1 - F.col("tpos")).alias("back")))
    diagonals = found.groupBy(*about, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_list(vote).alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    by = W.partitionBy(KEY, "template").orderBy("diagonal")
    near = (F.col("diagonal") - F.lag("diagonal").over(by) <= GAP) & ~F.col("base") & (F.col("lo") - F.lag("hi").over(by) <= GAP + 1)
    bands = diagonals.withColumn("new", F.when(near, 0).otherwise(1)).withColumn("band", F.sum("new").over(by))
    spans = bands.groupBy(*about, "band").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cover = in_order(F.col("votes"), F.col("size")) / (F.col("size") - 1)
    spans = spans.withColumn("cover", F.when(F.col("template").isNotNull(), cover))
    row = F.struct("template", "label", "base", F.col("lo").cast("long").alias("start"), (F.col("hi") + 2).cast("long").alias("end"), "cover")
    good = F.when(F.col("cover") >= F.when(F.col("base"), 1.0).otherwise(COVER), row)
    return spans.groupBy(KEY, "doc_id", "n_words").agg(F.array_sort(F.collect_list(good)).alias("spans")).select("doc_id", F.col("n_words").cast("long").alias("n_words"), "spans")


def digest(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    starts = F.transform(base, lambda s: s["start"])
    labels = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["cover"])), F.lit(0.0)).alias("score"),
    )
