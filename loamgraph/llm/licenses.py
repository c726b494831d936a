"""License notices by diagonal voting, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words in a rolling gram: no more than the shortest phrase has.
GRAM = 3
#: Diagonals at most this far apart belong to one copy with words added or lost.
NEAR = 4
#: The share of a template's grams that a copy must hold. Another label's template whose own words would cover so much is a rival: all
#: that it lacks must stand as well, such as a name or a version.
COVER = 0.5

# The phrases whose every exact place counts, and their labels.
PHRASES = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

# Wording of public licences and notices, for the method's own labels.
NOTICES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("licensed under the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("released under the bsd license", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl-2"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by nd 4 0", "cc-by-nd"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved no part of this publication may be reproduced", "all-rights-reserved"),
]

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of the text with A-Z lower-cased; null is empty.

    Only the first and the last piece of a split at runs of separators can be empty.
    """

    def without_edges(cut: Column) -> Column:
        n = F.size(cut)
        head = (F.get(cut, F.lit(0)) == "").cast("int")
        tail = ((n > 1) & (F.get(cut, n - 1) == "")).cast("int")
        return F.slice(cut, head + 1, n - head - tail)

    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), ascii_uppercase, ascii_lowercase)
    return bind(F.split(low, NOT_A_WORD), without_edges)


def rolling_grams(words: Column, k: int = GRAM) -> Column:
    """(hash, gram): XXH64 of the k words from each place on, and the words; the last k - 1 places have fewer words."""

    def gram(ws: Column) -> Callable[[Column, Column], Column]:
        def at(w: Column, i: Column) -> Column:
            own = [w, *(F.get(ws, i + j) for j in range(1, k))]
            return F.struct(F.xxhash64(*own).alias("hash"), F.concat_ws(" ", *own).alias("gram"))

        return at

    return bind(words, lambda ws: F.transform(ws, gram(ws)))


def _grams(text: str) -> list[str]:
    words = text.split()
    return [" ".join(words[i : i + GRAM]) for i in range(len(words) - GRAM + 1)]


def telling(templates: list[tuple[str, str]], cover: float = COVER) -> list[list[list[int]]]:
    """For each template, for each of its rivals, the places of the grams that the rival lacks. Two rivals that lack the same are one."""
    out = []
    for text, label in templates:
        own, apart = _grams(text), []
        for other, name in templates:
            theirs = set(_grams(other))
            if name != label and len(theirs.intersection(own)) >= cover * len(set(own)):
                missing = [i for i, g in enumerate(own) if g not in theirs]
                if missing not in apart:
                    apart.append(missing)
        out.append(apart)
    return out


def _families(templates: list[tuple[str, str]], cover: float) -> list[int]:
    """A number for each template that rivals share, directly or through others."""
    family = list(range(len(templates)))
    grams = [set(_grams(t)) for t, _ in templates]
    for _ in templates:
        for i, (_, a) in enumerate(templates):
            for j, (_, b) in enumerate(templates):
                if a != b and len(grams[i] & grams[j]) >= cover * min(len(grams[i]), len(grams[j])):
                    family[i] = family[j] = min(family[i], family[j])
    return family


def _templates(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], cover: float) -> tuple[DataFrame, DataFrame]:
    """(hash, gram, template, place: a row for each gram of each template, and one marker that all texts hold; template, label, base, need, tells, family)."""
    texts = [*phrases, *notices]
    for text, _ in texts:
        if len(text.split()) < GRAM:
            raise ValueError(f"a template needs {GRAM} words: {text}")
    tells, families = [[]] * len(phrases) + telling(notices, cover), [-1] * len(phrases) + _families(notices, cover)
    places = lambda rows: F.array(*(F.array(*map(F.lit, r)) for r in rows)).cast("array<array<int>>")
    each = [F.struct(F.lit(i).alias("template"), F.lit(text).alias("text"), F.lit(label).alias("label"), F.lit(i < len(phrases)).alias("base"), F.lit(families[i]).alias("family"), places(tells[i]).alias("tells")) for i, (text, label) in enumerate(texts)]
    table = spark.range(1).select(F.inline(F.array(*each))).withColumn("words", F.split("text", " ")).withColumn("need", F.size("words") - (GRAM - 1))
    grams = table.select("template", F.posexplode(F.slice(rolling_grams(F.col("words")), F.lit(1), F.col("need"))).alias("place", "own")).select("own.hash", "own.gram", "template", "place")
    marker = spark.range(1).select(_marker()["hash"].alias("hash"), _marker()["gram"].alias("gram"), F.lit(-1).alias("template"), F.lit(0).alias("place"))
    facts = table.select("template", "label", "base", "need", "tells", "family")
    blank = spark.range(1).select(F.lit(-1).alias("template"), F.lit("").alias("label"), F.lit(False).alias("base"), F.lit(0).alias("need"), F.array().cast("array<array<int>>").alias("tells"), F.lit(-1).alias("family"))
    return grams.unionByName(marker), facts.unionByName(blank)


def _marker() -> Column:
    return F.struct(F.xxhash64(F.lit("\x00every text")).alias("hash"), F.lit("\x00every text").alias("gram"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES, cover: float = COVER) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Every rolling gram of a text is joined to the templates' grams; a match votes for
    the diagonal (place in the text less place in the template). A phrase stands where its
    diagonal has all its votes. A notice's diagonals within NEAR of each other make one copy, of which the best window of a bounded drift
    is verified: words are compared, not hashes alone, `cover` of the template's grams must stand in it, a gram that
    stands there often counting once, and all that tells the template from each of its rivals (telling()). Of copies of rivals that share words, those
    stay that no other beats by its share of grams, then by its drift. The tables of grams and templates are constants of this
    module's size, so they're broadcast; texts are never shuffled, only votes.

    Null and empty texts have no words and no labels; null ids and repeated
    rows keep their rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.concat(F.array(_marker()), rolling_grams(words_of(F.col(text_col)))).alias("grams"))
    rows = rows.withColumn("n_words", (F.size("grams") - 1).cast("long"))
    grams = rows.select("doc_id", "row", "n_words", F.posexplode("grams").alias("at", "own")).select("doc_id", "row", "n_words", "at", "own.hash", "own.gram")
    told, facts = _templates(spark, phrases, notices, cover)
    votes = grams.join(F.broadcast(told), ["hash", "gram"]).groupBy("row", "doc_id", "n_words", "template", (F.col("at") - 1 - F.col("place")).alias("diagonal")).agg(F.collect_set("place").alias("places"))
    votes = votes.join(F.broadcast(facts), "template")

    along = Window.partitionBy("row", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > NEAR), F.lit(True))
    votes = votes.withColumn("copy", F.sum(fresh.cast("int")).over(along.rowsBetween(Window.unboundedPreceding, 0)))

    # From each diagonal of a copy on, those whose drift from it isn't more than the template is long.
    longest = max([NEAR, *(len(_grams(t)) for t, _ in notices)])
    ahead = Window.partitionBy("row", "template", "copy").orderBy("diagonal").rangeBetween(0, longest)
    near = F.filter(F.collect_list(F.struct("diagonal", "places")).over(ahead), lambda v: v["diagonal"] - F.col("diagonal") <= F.greatest(F.col("need"), F.lit(NEAR)))
    runs = votes.withColumn("near", near).withColumn("held", F.array_distinct(F.flatten("near.places"))).withColumn("drift", F.array_max("near.diagonal") - F.col("diagonal"))
    share = F.size("held") / F.greatest(F.col("need"), F.lit(1))
    exact = F.col("base") & (F.size("held") == F.col("need"))
    verified = ~F.col("base") & (F.col("template") >= 0) & (share >= cover) & F.forall("tells", lambda t: F.size(F.array_except(t, F.col("held"))) == 0)
    from_ = F.array_min(F.transform("near", lambda v: v["diagonal"] + F.array_min(v["places"])))
    to = F.array_max(F.transform("near", lambda v: v["diagonal"] + F.array_max(v["places"]))) + GRAM
    window = F.struct(F.when(exact, F.lit(1.0)).when(verified, share).alias("share"), (-F.col("drift")).alias("tight"), (-F.col("diagonal")).alias("first"), exact.alias("exact"), from_.alias("from"), to.alias("to"))
    key = ["row", "doc_id", "n_words", "template", "label", "family", "copy"]
    # Nulls are the smallest, so a window that is verified comes before all others.
    copies = runs.groupBy(*key).agg(F.max(window).alias("w")).select("row", "doc_id", "n_words", "label", "family", "w.*")

    # Copies that share a word begin within the longest template and its drift of each other.
    around = Window.partitionBy("row", "family").orderBy("from").rangeBetween(-(2 * longest + GRAM), 2 * longest + GRAM)
    rivals = F.collect_list(F.when((F.col("family") >= 0) & F.col("share").isNotNull(), F.struct("from", "to", "share", "tight", "label"))).over(around)
    beats = lambda r: (r["label"] != F.col("label")) & (r["from"] < F.col("to")) & (F.col("from") < r["to"]) & (F.struct(r["share"], r["tight"]) > F.struct(F.col("share"), F.col("tight")))
    copies = copies.withColumn("rivals", rivals)
    copies = copies.select("row", "doc_id", "n_words", "label", (-F.col("first")).alias("start"), "exact", F.when(~F.exists("rivals", beats), F.col("share")).alias("share"))
    listed = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    where = lambda c: F.when(F.col("exact"), F.col(c))
    return (
        copies.groupBy("row", "doc_id", "n_words")
        .agg(
            F.count_if("exact").alias("n_base"),
            F.min(where("start")).cast("long").alias("first_word"),
            F.max(where("start")).cast("long").alias("last_word"),
            listed(where("label")).alias("base_labels"),
            listed(F.when(F.col("share").isNotNull(), F.col("label"))).alias("labels"),
            F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
        )
        .drop("row")
    )
