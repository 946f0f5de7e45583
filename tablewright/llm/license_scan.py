"""License scan by diagonal voting, in DataFrame operations only.

Texts and templates are word sequences. A template has a k-gram at each word position; the
rolling k-gram hashes of all texts are joined to them, and the words compared. A joined pair
votes for its diagonal, the text position less the template position: a copy of a
template gives votes on one diagonal, and on neighbouring ones where words were put in or
left out. Votes are aggregated by text, template and diagonal before they are shuffled.

Templates that must occur whole (phrases) are found where a diagonal has the votes of all
their positions. For the others, notices of a sentence and more, diagonals that differ by
``SLACK`` at most are merged and the span is verified: the words that equal the
template's must be ``SHARE`` of the template and of the span.

Equal texts are one text, named by its SHA-256; only names with a find, and what was found,
meet the rows again. Template k-grams are broadcast when a count shows them within
``BROADCAST_GRAMS`` rows, finds within ``BROADCAST_TEXTS``; beyond, they are joined by shuffle.

Defined results: null and empty texts have no words and no finds; repeated rows get
equal results; a template without words is never found. Columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.decontaminate import WORD, words_of
from tablewright.llm.shared import keep
from tablewright.names import quote_ident

#: Words of a gram, by the least words of a template that uses it.
GRAMS = {1: 1, 2: 2, 8: 4}
#: Diagonals of one copy differ by no more from the next.
SLACK = 6
#: Part of a notice, and of the span, that must be equal words.
SHARE = 0.6
BROADCAST_GRAMS = 200_000
BROADCAST_TEXTS = 100_000

# The phrases of the base, found whole.
BASE = (
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
)
# Names of versions and variants, found whole.
VARIANTS = (
    ("agpl", "gnu affero general public license"),
    ("apache-2.0", "apache license version 2 0"),
    ("bsd", "bsd license"),
    ("cc-by-nc", "cc by nc"),
    ("cc-by-nd", "cc by nd"),
    ("cc-by-sa", "cc by sa"),
    ("cc0", "cc0 1 0 universal"),
    ("gpl-2.0", "gnu general public license version 2"),
    ("gpl-3.0", "gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license"),
    ("mpl", "mozilla public license"),
)
# Sentences of the notices that licenses ask to be put into works, found by most of their words.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
)


def templates(spark: SparkSession) -> DataFrame:
    """``label, text, base, whole`` of the templates above."""
    rows = [(a, t, base, whole) for group, base, whole in ((BASE, True, True), (VARIANTS, False, True), (NOTICES, False, False)) for a, t in group]
    return spark.createDataFrame(rows, "label string, text string, base boolean, whole boolean")


def _neighbours(words: Column, k: int) -> Column:
    """Structs ``w0`` to ``w(k-1)`` of each position's word and the next ones; null past the end."""
    return F.arrays_zip(*[(F.slice(words, i + 1, F.greatest(F.size(words), F.lit(1))) if i else words).alias(f"w{i}") for i in range(k)])


def _gram(k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.col(f"w{i}") for i in range(k)])


def template_grams(table: DataFrame) -> DataFrame:
    """``template, label, base, whole, size, k, tpos, gram, t0 ...`` of each gram of each template."""
    k = F.lit(0)
    for least, size in GRAMS.items():
        k = F.when(F.size("w") >= least, size).otherwise(k)
    most = max(GRAMS.values())
    named = table.select("label", "base", "whole", words_of(F.col("text")).alias("w"))
    named = named.filter(F.size("w") > 0).select(F.xxhash64("label", F.array_join("w", " "), "base", "whole").alias("template"), "label", "base", "whole", F.size("w").alias("size"), k.alias("k"), "w").distinct()
    spread = named.select("*", F.posexplode(_neighbours(F.col("w"), most)).alias("tpos", "at")).select("*", "at.*").filter("tpos + k <= size")
    gram = F.lit(None)
    for size in set(GRAMS.values()):
        gram = F.when(F.col("k") == size, _gram(size)).otherwise(gram)
    return spread.select("template", "label", "base", "whole", "size", "k", "tpos", gram.alias("gram"), *[F.col(f"w{i}").alias(f"t{i}") for i in range(most)])


def _votes(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """``digest, template..., diagonal, places``: the template positions that vote for each diagonal."""
    sizes = [r.k for r in grams.select("k").distinct().collect()]  # a row per gram size
    n_grams = grams.count()
    words = docs.select("digest", words_of(F.col("text")).alias("w"))
    most = max(sizes, default=1)
    spread = words.select("digest", F.posexplode(_neighbours(F.col("w"), most)).alias("pos", "at")).select("digest", "pos", "at.*")
    hashed = spread.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _gram(k).alias("gram")) for k in sizes])).alias("g")) if sizes else spread.select("*", F.struct(F.lit(0).alias("k"), F.lit(0).cast("long").alias("gram")).alias("g"))
    hashed = hashed.select("digest", "pos", F.col("g.k").alias("dk"), F.col("g.gram").alias("gram"), *[f"w{i}" for i in range(most)])
    equal = F.col("dk") == F.col("k")
    for i in range(most):
        equal = equal & ((F.col("k") <= i) | (F.col(f"w{i}") == F.col(f"t{i}")))
    hits = hashed.join(F.broadcast(grams) if n_grams <= BROADCAST_GRAMS else grams, "gram").filter(equal)
    own = ["template", "label", "base", "whole", "size", "k"]
    return hits.groupBy("digest", *own, (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.collect_set("tpos").alias("places"))


def _covered(places: Column, k: Column) -> Column:
    """The number of words in grams at these places."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(p, p + k - 1)))))


def _spans(votes: DataFrame) -> DataFrame:
    """``digest, label, base, first, last, share`` of what is found; words from ``first`` to ``last``."""
    own = ["digest", "template", "label", "base", "size", "k"]
    all_votes = F.size("places") == F.col("size") - F.col("k") + 1
    phrases = votes.filter(F.col("whole") & all_votes).select("digest", "label", "base", F.col("diagonal").alias("first"), (F.col("diagonal") + F.col("size") - 1).alias("last"), F.lit(1.0).alias("share"))
    order = Window.partitionBy("digest", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(False)).cast("int")
    merged = votes.filter(~F.col("whole")).withColumn("far", far).withColumn("copy", F.sum("far").over(order))
    in_text = F.transform("places", lambda p: p + F.col("diagonal"))
    merged = merged.withColumn("in_text", in_text).groupBy(*own, "copy").agg(F.flatten(F.collect_list("places")).alias("places"), F.flatten(F.collect_list("in_text")).alias("in_text"))
    merged = merged.withColumns({"first": F.array_min("in_text"), "last": F.array_max("in_text") + F.col("k") - 1})
    share = F.least(_covered(F.col("places"), F.col("k")) / F.col("size"), _covered(F.col("in_text"), F.col("k")) / (F.col("last") - F.col("first") + 1))
    notices = merged.withColumn("share", share).filter(F.col("share") >= SHARE).select("digest", "label", "base", "first", "last", "share")
    return phrases.unionByName(notices)


def scan(df: DataFrame, table: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``n_words, n_base, first_word, last_word, base_labels, labels, score, spans``.

    ``n_base`` counts the finds of base templates, the first and last word are the smallest and largest
    start among them (null without); labels are sorted arrays; ``score`` is the largest share of
    a template's words found, 0 without a find; ``spans`` are all finds.
    """
    added = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
    df = df.drop(*added)
    # inside, columns have neutral names, so that none can clash
    inner = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    body = F.col(f"c{df.columns.index(text)}")
    digest = F.unhex(F.sha2(F.coalesce(body, F.lit("")), 256))
    grams = keep(template_grams(table), "license_scan")
    votes = keep(_votes(inner.select(digest.alias("digest"), body.alias("text")), grams), "license_scan")
    spans = _spans(votes)
    base = F.col("base")
    found = spans.groupBy("digest").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "base", "share"))).alias("spans"),
    )
    found = keep(found, "license_scan")
    n_words = F.coalesce(F.regexp_count(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = inner.select("*", n_words.alias("n_words"), digest.alias("digest"))
    joined = rows.join(F.broadcast(found) if found.count() <= BROADCAST_TEXTS else found, "digest", "left")
    none = {"n_base": F.lit(0).cast("long"), "base_labels": F.array().cast("array<string>"), "labels": F.array().cast("array<string>"), "score": F.lit(0.0), "spans": F.array().cast(found.schema["spans"].dataType)}
    joined = joined.withColumns({c: F.coalesce(c, v) for c, v in none.items()})
    return joined.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], *[F.col(quote_ident(c)) for c in added])
