"""License scans by a positional index of rare words.

The templates are short phrases (``PHRASES``: every place counts) and notices
(``NOTICES``: wording may differ, but their mandatory key phrases must stand).
One pass over all texts counts in how many each licence word stands; its IDF
decides which words of a template are indexed: the ``ANCHORS`` highest.  The
index posts a word with its template and its position there.

A second pass looks up each text's indexed words.  A word at place p posted at
position q votes for a start at p - q; the postings intersect where votes agree
on the start: on all indexed words for a phrase, on half of them for a notice.
What is left is verified on the text's words: a phrase must stand there whole,
each key phrase of a notice within ``SLACK`` words of it.  A notice's score is
the share of its words, weighted by IDF, that stand at their place.

Both passes are DataFrame functions within a row: there is no shuffle but that
of the licence words' counts, and nothing that grows with the texts leaves
their task.  The driver gets one row per licence word.

Defined results: null and empty texts have no words, no labels and score 0; a
text of any length is whole; repeated notices give one label each, repeated
phrases a place each; rows that repeat and null ids are scanned like any
other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
ANCHORS = 4
SLACK = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Label, phrase.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Label, wording of the notice, mandatory key phrases.
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0", "in compliance with the license")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("cc-by-4", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-sa-4", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc0-1", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute", "with or without fee")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license", "version 3")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "any person obtaining a copy")),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("reserved", "all rights reserved", ("all rights reserved",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "public domain")),
)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where the body uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def idf(docs: DataFrame, licence_words: list[str]) -> dict[str, float]:
    """ln((1 + texts) / (1 + texts with the word)) of each licence word, over all texts."""
    found = F.array_union(F.array(F.lit("")), F.array_intersect(words_of(F.col("text")), _strings(licence_words)))  # "" stands for each text
    got = {r.word: r.n for r in docs.select(F.explode(found).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {w: math.log((1 + got.get("", 0)) / (1 + got.get(w, 0))) for w in licence_words}


class Index:
    """Templates and the postings of their rare words."""

    def __init__(self, weight: dict[str, float], phrases=PHRASES, notices=NOTICES, anchors: int = ANCHORS):
        self.weight = weight
        self.templates = [(label, text.split(), None) for label, text in phrases]
        self.templates += [(label, text.split(), [k.split() for k in must]) for label, text, must in notices]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.need = []
        for t, (_, words, must) in enumerate(self.templates):
            rare = sorted(range(len(words)), key=lambda i: (-weight[words[i]], i))[:anchors]
            for i in rare:
                self.postings.setdefault(words[i], []).append((t, i))
            self.need.append(len(rare) if must is None else -(-len(rare) // 2))


def licence_words(phrases=PHRASES, notices=NOTICES) -> list[str]:
    return sorted({w for _, text, *_ in [*phrases, *notices] for w in text.split()})


def _starts(words: Column, index: Index) -> Column:
    """Distinct (t, start) on which enough indexed words of template t agree."""
    keys = sorted(index.postings)
    posted = F.create_map(*[c for w in keys for c in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for t, i in index.postings[w]]))])
    need = F.array(*map(F.lit, index.need))

    def counted(places: Column) -> Column:
        # a run of equal votes, from its first to the first of the next run
        votes = F.flatten(F.transform(places, lambda p: F.transform(F.element_at(posted, F.get(words, p)), lambda x: F.struct(x["t"].alias("t"), (p - x["at"]).alias("start")))))
        return let(F.array_sort(votes), lambda v: let(
            F.filter(F.sequence(F.lit(0), F.size(v) - 1), lambda i: (i == 0) | (F.get(v, i) != F.get(v, i - 1))),
            lambda heads: F.transform(
                F.filter(
                    F.transform(heads, lambda h, k: F.struct(F.get(v, h).alias("vote"), (F.coalesce(F.get(heads, k + 1), F.size(v)) - h).alias("n"))),
                    lambda r: r["n"] >= F.get(need, r["vote"]["t"]),
                ),
                lambda r: r["vote"],
            ),
        ))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(keys))
    none = F.array().cast("array<struct<t:int,start:int>>")
    return F.when(F.arrays_overlap(words, _strings(keys)), let(places, counted)).otherwise(none)


def _verified(words: Column, index: Index, found: Column) -> Column:
    """Of votes (t, start): struct (label, base, start, end, score) of those whose phrases stand."""
    n = F.size(words)
    templates = F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(must is None).alias("base"), _strings(text).alias("text"),
            F.array(*[F.lit(index.weight[w]) for w in text]).alias("weight"), F.array(*[_strings(k) for k in must or [text]]).alias("must"),
        )
        for label, text, must in index.templates
    ])

    def stands(phrase: Column, low: Column, high: Column) -> Column:
        return F.exists(F.sequence(low, F.greatest(low, high)), lambda s: F.slice(words, s + 1, F.size(phrase)) == phrase)

    def checked(vote: Column) -> Column:
        return let(F.get(templates, vote["t"]), lambda x: let(vote["start"], lambda s: F.struct(
            F.when(x["base"], (s >= 0) & (F.slice(words, F.greatest(s, F.lit(0)) + 1, F.size(x["text"])) == x["text"]))
            .otherwise(F.forall(x["must"], lambda k: stands(k, F.greatest(s - SLACK, F.lit(0)), F.least(s + F.size(x["text"]) + SLACK, n) - F.size(k)))).alias("ok"),
            x["label"].alias("label"), x["base"].alias("base"), s.alias("start"), (s + F.size(x["text"])).alias("end"),
            F.aggregate(F.sequence(F.lit(0), F.size(x["text"]) - 1), F.lit(0.0), lambda a, i: a + F.when((s + i >= 0) & F.equal_null(F.get(words, F.greatest(s + i, F.lit(0))), F.get(x["text"], i)), F.get(x["weight"], i)).otherwise(0.0)).alias("got"),
            F.aggregate(x["weight"], F.lit(0.0), lambda a, w: a + w).alias("all"),
        )))

    kept = F.filter(F.transform(found, checked), lambda r: r["ok"])
    score = lambda r: F.when(r["base"], 1.0).when(r["all"] > 0, F.round(r["got"] / r["all"], 6)).otherwise(0.0)
    return F.transform(kept, lambda r: F.struct(*[r[c].alias(c) for c in ("label", "base", "start", "end")], score(r).alias("score")))


def _labels(spans: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda r: r["label"]))), ",")


def scan(docs: DataFrame, phrases=PHRASES, notices=NOTICES, anchors: int = ANCHORS) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans: one row per row of ``docs``.

    spans: (label, base, start, end, score) in words, of phrases (base) and notices; a notice may start before word 0
    or end after the last where the text has only part of it."""
    index = Index(idf(docs, licence_words(phrases, notices)), phrases, notices, anchors)

    def row(words: Column) -> Column:
        spans = let(_starts(words, index), lambda found: _verified(words, index, found))
        return let(spans, lambda s: let(F.filter(s, lambda r: r["base"]), lambda b: F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.size(b).cast("long").alias("n_base"),
            F.array_min(F.transform(b, lambda r: r["start"])).cast("long").alias("first_word"),
            F.array_max(F.transform(b, lambda r: r["start"])).cast("long").alias("last_word"),
            _labels(b).alias("base_labels"),
            _labels(s).alias("labels"),
            F.coalesce(F.array_max(F.transform(s, lambda r: r["score"])), F.lit(0.0)).alias("score"),
            s.alias("spans"),
        )))

    return docs.select("doc_id", let(words_of(F.col("text")), row).alias("found")).select("doc_id", "found.*")
