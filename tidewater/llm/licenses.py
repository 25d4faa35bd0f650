"""License scan by diagonal voting.

Every rolling word k-gram of every document is hashed and joined to the k-grams
of the license templates. A hit at document word p and template word t votes for
the diagonal p - t; a full run of votes on one diagonal is a whole occurrence of
the template, and neighbouring diagonals with enough votes together are an
occurrence with words added or left out; how far apart neighbours may be grows with
their votes. Spans are verified on the words themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import read_table

# Base phrases with their labels.
BASE_PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)

# Wording of well-known licenses, for labels beyond the base ones.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike license"),
    ("cc-by", "licensed under the creative commons attribution 4 0 international license"),
    ("all-rights-reserved", "all rights reserved"),
)

#: Words of a rolling gram; no template is shorter.
K = 3
#: Share of a template's grams that neighbouring diagonals must hit together.
COVER = 0.6
#: Diagonals at most this far apart are neighbours whatever their votes.
DRIFT = 4
#: Templates are broadcast to the join; this many grams at most.
MAX_GRAMS = 100_000
#: The gram value that every document has once, so that documents without hits stay in the result.
MARK = 0

#: Words; the input is lower-cased first, where U+212A is set aside since it would become an ASCII letter.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text as an array; null is the empty text."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u24da")))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def template_grams(spark: SparkSession, templates: list[tuple[str, str, bool]]) -> DataFrame:
    """(template, gram, t, grams, words, label, is_base, gram_words) for templates (label, wording, is_base)."""
    rows = []
    for n, (label, wording, is_base) in enumerate(templates):
        w = _words(wording)
        if len(w) < K:
            raise ValueError(f"a template needs {K} words: {wording!r}")
        rows += [(n, t, len(w) - K + 1, len(w), label, is_base, w[t : t + K]) for t in range(len(w) - K + 1)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"{len(rows)} template grams; {MAX_GRAMS} are the most that are broadcast")
    rows.append((-1, -1, 0, 0, "", False, []))
    table = spark.createDataFrame(rows, "template int, t int, grams int, length int, label string, is_base boolean, gram_words array<string>")
    gram = F.xxhash64(*[F.element_at("gram_words", i + 1) for i in range(K)])
    return table.withColumn("gram", F.when(F.col("template") < 0, F.lit(MARK).cast("long")).otherwise(gram))


def find_spans(docs: DataFrame, templates: list[tuple[str, str, bool]], cover: float = COVER, drift: int = DRIFT) -> DataFrame:
    """Spans of templates in documents, and one row with template -1 for each document.

    Returns (doc_id, k, n_words, copies, template, label, is_base, exact, first, last, votes, share): words first..last
    hold the template; exact says that they are its words one by one; share is the part of its grams found.
    k is a hash of the text; rows equal in doc_id and text count in `copies` of their template -1 row.
    """
    spark = docs.sparkSession
    words = docs.select("doc_id", F.xxhash64("text").alias("k"), words_of(F.col("text")).alias("w"))
    n = F.size("w")
    at = F.when(n >= K, F.sequence(F.lit(1), n - K + 1)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(at, lambda i: F.xxhash64(*[F.element_at("w", i + j) for j in range(K)]))
    table = template_grams(spark, templates)
    # at most MAX_GRAMS values; a generator makes each array once
    known = [r["gram"] for r in table.where(F.col("template") >= 0).select("gram").distinct().collect()]
    hashed = words.select("*", F.explode(F.array(grams)).alias("grams"))
    met = F.filter(F.transform("grams", lambda g, p: F.when(g.isin(known), p)), lambda p: p.isNotNull())
    some = hashed.select("doc_id", "k", n.alias("n_words"), F.explode(F.array(F.transform(met, lambda p: F.struct(p.alias("p"), F.get("grams", p).alias("gram"), F.array(*[F.get("w", p + j) for j in range(K)]).alias("own"))))).alias("hits"))
    mark = F.struct(F.lit(-1).alias("p"), F.lit(MARK).cast("long").alias("gram"), F.array().cast("array<string>").alias("own"))
    placed = some.select("doc_id", "k", "n_words", F.inline(F.array_append("hits", mark)))
    hits = placed.join(F.broadcast(table), "gram").where(F.col("own") == F.col("gram_words")).drop("own", "gram_words", "gram")
    by = ["doc_id", "k", "n_words", "template"]
    # a vote for each gram on each diagonal; documents that stand twice vote once
    votes = hits.withColumn("diagonal", F.when(F.col("template") >= 0, F.col("p") - F.col("t"))).groupBy(*by, "label", "is_base", "grams", "length", "diagonal").agg(
        F.collect_set(F.struct("t", "p")).alias("hits"), F.min("p").alias("first"), (F.max("p") + K - 1).alias("last"), F.count("*").alias("n")
    )
    whole = (F.size("hits") == F.col("grams")) | (F.col("template") < 0)
    # a diagonal reaches as far as it has different grams, or lacks them if these are fewer: a part of an occurrence has the grams that the
    # other part lacks, two occurrences have the same ones. Diagonals whose reaches overlap are neighbours; whole occurrences stand alone.
    own = F.size(F.array_distinct("hits.t"))
    reach = F.least(own, F.col("grams") - own) + F.lit(drift / 2)
    votes = votes.withColumn("whole", whole).withColumn("low", F.col("diagonal") - reach).withColumn("high", F.col("diagonal") + reach)
    w = Window.partitionBy(*by, "whole").orderBy("low", "diagonal")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.col("whole") | before.isNull() | (F.col("low") > before)
    runs = votes.withColumn("opens", opens.cast("int")).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy(*by, "label", "is_base", "grams", "length", "whole", "run").agg(
        F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.min("first").alias("first"), F.max("last").alias("last"), F.max("n").alias("copies")
    )
    # only whole occurrences of base phrases count; of the others those are verified that have enough different grams
    enough = ~F.col("is_base") & (F.size(F.array_distinct("hits.t")) >= cover * F.col("grams"))
    checked = spans.where(F.col("whole") | enough).withColumn("span", F.when(~F.col("whole"), ordered(F.col("hits"), F.col("length"))))
    votes = F.when(F.col("whole"), F.col("grams")).otherwise(F.col("span.n"))
    share = F.least(F.lit(1.0), F.try_divide(votes, F.col("grams")))
    first, last = F.coalesce("span.first", "first"), F.coalesce(F.col("span.last") + K - 1, F.col("last"))
    kept = checked.where(F.col("whole") | (share >= cover))
    return kept.select("doc_id", "k", F.col("n_words").cast("long").alias("n_words"), "copies", "template", "label", "is_base", F.col("whole").alias("exact"), first.alias("first"), last.alias("last"), votes.alias("votes"), share.alias("share"))


def ordered(hits: Column, length: Column) -> Column:
    """The longest stretch found of hits (t, p) whose grams stand in the document in the template's order and within
    twice its length: struct<n, t, first, last>.

    Places are taken in order; for every gram of the template the best stretch that ends there and has not grown too long is held.
    """
    stretch = "struct<n: int, t: int, first: int, last: int>"
    start = F.struct(F.array().cast(f"array<{stretch}>").alias("open"), F.struct(F.lit(0).alias("n"), F.lit(-1).alias("t"), F.lit(-1).alias("first"), F.lit(-1).alias("last")).cast(stretch).alias("best"))

    def more(a: Column, x: Column) -> Column:
        alive = F.filter(a["open"], lambda c: x["p"] - c["first"] < 2 * length)
        # the most grams first, then the latest beginning
        fit = F.transform(F.filter(alive, lambda c: (c["t"] < x["t"]) & (c["last"] < x["p"])), lambda c: F.struct(c["n"].alias("n"), c["first"].alias("first")))
        last = F.array_max(fit)
        new = F.struct((F.coalesce(last["n"], F.lit(0)) + 1).alias("n"), x["t"].alias("t"), F.coalesce(last["first"], x["p"]).alias("first"), x["p"].alias("last")).cast(stretch)
        better = F.exists(alive, lambda c: (c["t"] == x["t"]) & ((c["n"] > new["n"]) | ((c["n"] == new["n"]) & (c["first"] >= new["first"]))))
        kept = F.when(better, alive).otherwise(F.array_append(F.filter(alive, lambda c: c["t"] != x["t"]), new))
        return F.struct(kept.alias("open"), F.when(new["n"] > a["best"]["n"], new).otherwise(a["best"]).alias("best"))

    by_place = F.array_sort(F.transform(hits, lambda x: F.struct(x["p"].alias("p"), x["t"].alias("t"))))
    return F.aggregate(by_place, start, more)["best"]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: counts, places and labels of license wording.

    Null texts are empty. Rows that agree in doc_id and text give equal rows. Null doc_ids are kept.
    Base phrases count only where all their words stand one after the other; first_word and last_word are the
    starts of the first and last such place. `labels` also has those of longer templates found in part.
    score is 1.0 with a whole template, else the best share of one, 0.0 without any.
    Columns other than doc_id and text play no part; an empty table gives no rows.
    """
    templates = [(label, words, True) for label, words in BASE_PHRASES] + [(label, words, False) for label, words in TEMPLATES]
    spans = find_spans(docs, templates)
    base = F.col("is_base") & (F.col("template") >= 0)
    real = F.col("template") >= 0
    out = spans.groupBy("doc_id", "k", "n_words").agg(
        F.max(F.when(~real, F.col("copies"))).alias("copies"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set(F.when(real, F.col("label")))), ",").alias("labels"),
        F.coalesce(F.max(F.when(real, F.col("share"))), F.lit(0.0)).alias("score"),
        F.count_if(real).alias("n_spans"),
    )
    copied = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return copied.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "n_spans")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License wording in every whole text of documents."""
    return scan_licenses(read_table(spark, sf_dir, "documents"))
