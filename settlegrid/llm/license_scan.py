"""Licence notices by a positional index of rare words. DataFrame functions only."""
from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower

#: Fixed base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices in the normal form of words: (label, key phrase that must stand in its place, notice).
TEMPLATES = (
    ("mit", "free of charge to any person", "permission is hereby granted free of charge to any person obtaining a copy of this"
     " software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "mit license", "released under the mit license"),
    ("apache", "apache license", "licensed under the apache license version 2 0 the license you may not use this file except in"
     " compliance with the license you may obtain a copy of the license at"),
    ("mit", "shall be included in all copies", "the above copyright notice and this permission notice shall be included in all copies or"
     " substantial portions of the software"),
    ("apache", "as is basis without warranties or conditions", "unless required by applicable law or agreed to in writing software distributed"
     " under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "gnu general public license", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms"
     " of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under"
     " the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without"
     " modification are permitted provided that the following conditions are met"),
    ("bsd", "retain the above copyright notice", "redistributions of source code must retain the above copyright notice this list of"
     " conditions and the following disclaimer"),
    ("mpl", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("isc", "for any purpose with or without fee", "permission to use copy modify and or distribute this software for any purpose"
     " with or without fee is hereby granted"),
    ("unlicense", "free and unencumbered software", "this is free and unencumbered software released into the public domain"),
)
APART = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def normal_text(text: Column) -> Column:
    """Words between single spaces, with one space at each end; A-Z lower-cased; null or no word: one space."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), APART, " ")), F.lit(" "))


def words_in(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def _literal(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def document_frequency(docs: DataFrame, templates=TEMPLATES, text_col="text"):
    """({licence word: documents with it}, documents) over all documents; the answer is as large as the templates' vocabulary."""
    vocabulary = sorted({w for _, _, notice in templates for w in notice.split()})
    words = docs.select(F.array_intersect(words_in(normal_text(F.col(text_col))), _literal(vocabulary)).alias("w"))
    counts = words.select(F.explode(F.array_append("w", F.lit(""))).alias("w")).groupBy("w").count()
    found = {r[0]: r[1] for r in counts.collect()}
    return {w: found.get(w, 0) for w in vocabulary}, found.get("", 0)


def postings(templates, frequency: dict) -> Column:
    """The notices as one array of structs: label, words in order, distinct words with the highest IDF first, key phrase and its place.

    IDF falls as the document frequency grows, so the order is by frequency; ties go by the word.
    """
    out = []
    for label, key, notice in templates:
        words, key = notice.split(), key.split()
        key_at = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        rarest = sorted(set(words), key=lambda w: (frequency[w], w))
        out.append(F.struct(F.lit(label).alias("label"), _literal(words).alias("words"), _literal(rarest).alias("rarest"),
                            _literal(key).alias("key"), F.lit(key_at).alias("key_at")))
    return F.array(*out)


def _places(words: Column, phrase: str) -> Column:
    """Starts of every place where the phrase's words stand consecutively."""
    parts = phrase.split()
    starts = F.filter(F.transform(words, lambda w, i: F.when(w == parts[0], i)), lambda i: i.isNotNull())
    return F.filter(starts, lambda i: F.slice(words, i + 1, len(parts)) == _literal(parts))


def _around(words: Column, place: Column, drift: int) -> Column:
    """The words at most ``drift`` away from a place that may lie outside the text."""
    first = F.greatest(place - drift, F.lit(0))
    return F.slice(words, first + 1, F.greatest(place + drift + 1 - first, F.lit(0)))


def _notice_score(words: Column, notice: Column, agree: int, drift: int) -> Column:
    """Best share of the notice's words in place over the starts that pass both tests; 0 without one. See :func:`scan_licenses`."""
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(notice["chosen"], w), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda h: F.filter(
        F.transform(notice["words"], lambda w, p: F.when(w == h["w"], h["i"] - p)), lambda o: o.isNotNull()))))
    drifts = F.sequence(F.lit(-drift), F.lit(drift))

    def key_stands(o):
        at = o + notice["key_at"]
        return F.exists(drifts, lambda d: (at + d >= 0) & (F.slice(words, F.greatest(at + d, F.lit(0)) + 1, F.size(notice["key"])) == notice["key"]))

    def in_place(o):
        return F.filter(notice["words"], lambda w, p: F.array_contains(_around(words, o + p, drift), w))
    placed = F.transform(F.filter(starts, key_stands), in_place)
    agreed = F.filter(placed, lambda x: F.size(F.array_intersect(x, notice["chosen"])) >= F.least(F.lit(agree), F.size(notice["rarest"])))
    return F.coalesce(F.array_max(F.transform(agreed, lambda x: F.size(x))) / F.size(notice["words"]), F.lit(0.0))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, rare: int = 6, agree: int = 3, share: float = 0.6, drift: int = 3,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Document frequencies of the licence words over all documents order the postings by IDF. For each notice, the file's
    ``rare`` highest-IDF words among those of the notice are looked up; every place of one of them and every posting of
    it give a relative position, which is a start of the notice. A notice word is in place if it stands at most ``drift`` words
    from where the start puts it, so that a few inserted or lost words do no harm. A start counts if at least ``agree`` of
    the looked-up words (all the notice's, if it has fewer) are in place and the whole key phrase stands at most ``drift`` words
    from its place; the score is the best share of the notice's words in place, and from ``share`` on the label is given.
    Base phrases count wherever their words stand together, always keep their labels and score 1. Null or empty texts have
    no words, labels or score; rows are judged one by one, so repeated rows and repeated or null ids are judged alike; an empty table
    gives an empty result; other columns are not read. No shuffle but for the frequencies.
    """
    frequency, _ = document_frequency(docs, templates, text_col)
    vocabulary = _literal(sorted(frequency, key=lambda w: (frequency[w], w)))
    rows = docs.select(F.col(id_col).alias("doc_id"), normal_text(F.col(text_col)).alias("norm"))
    rows = rows.withColumn("words", words_in(F.col("norm")))
    words = F.col("words")
    rows = rows.withColumn("held", F.array_intersect(words, vocabulary))
    none = F.array().cast("array<int>")
    rows = rows.withColumns({f"base_{i}": F.when(F.contains("norm", F.lit(f" {phrase} ")), _places(words, phrase)).otherwise(none)
                             for i, (phrase, _) in enumerate(base)})
    open_ = F.filter(postings(templates, frequency), lambda n: F.size(F.array_except(n["key"], F.col("held"))) == 0)
    open_ = F.transform(open_, lambda n: n.withField("chosen", F.slice(F.array_intersect(n["rarest"], F.col("held")), 1, rare)))
    rows = rows.withColumn("open", F.filter(open_, lambda n: F.size(n["chosen"]) >= F.least(F.lit(agree), F.size(n["rarest"]))))
    rows = rows.withColumn("found", F.transform("open", lambda n: F.struct(
        n["label"].alias("label"), _notice_score(words, n, agree, drift).alias("score"))))
    starts = F.flatten(F.array(*[F.col(f"base_{i}") for i in range(len(base))]))
    plain = F.array_compact(F.array(*[F.when(F.size(f"base_{i}") > 0, label) for i, (_, label) in enumerate(base)]))
    more = F.transform(F.filter("found", lambda x: x["score"] >= share), lambda x: x["label"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    best = F.coalesce(F.array_max(F.transform("found", lambda x: x["score"])), F.lit(0.0))
    return rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.size(starts).cast("long").alias("n_base"),
                       F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
                       joined(plain).alias("base_labels"), joined(F.concat(plain, more)).alias("labels"),
                       F.when(F.size(starts) > 0, 1.0).otherwise(best).alias("score"))
