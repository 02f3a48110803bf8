"""Operator 3: licence scan by a positional rare-token index.

Templates are short licence notices. All documents are counted first: in how many does each
template word occur (one small row for each template word and task, summed by Spark). That
gives inverse document frequencies, and each template is posted under its highest-IDF sure word with its
position. A file looks up its own licence words among these, rarest first; where the template would start
(position in the file less position in the template) is intersected with the same of the template's further anchors in
order of rarity, until none is left or all agree, and a start counts once the template's mandatory key phrases stand word
for word where the template has them. The score is the share of template words in place.

The three base phrases are looked for at every place as well; their labels always stay.

Defined results: a null or empty text has no words, no place, null first and last word and
empty labels; repeated rows and null ids give a row each; an empty table gives none; columns
beyond the named two are ignored. Ties between templates don't matter: all labels are kept.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, map_rows, plain_words, _pieces

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label, template, mandatory key phrases (each a part of the template).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license", "2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use", "source and binary forms"]),
    ("bsd", "released under the bsd license", ["bsd license"]),
    ("gpl", "this work is licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", ["free software", "gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license", ["lesser general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "creative commons zero cc0 public domain dedication", ["cc0"]),
]


def document_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """How many documents hold each word of the (small, fixed) vocabulary, and how many there are."""
    import pyarrow as pa

    schema = "word binary, df long"

    def run(batches):
        out, found, total = arrow_schema(schema), Counter(), 0
        for whole in batches:
            for b in _pieces(whole):
                for text in b.column(0).to_pylist():
                    found.update(vocabulary.intersection(plain_words(text)))
                total += b.num_rows
        found[b""] = total
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], schema=out)

    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(run, schema).groupBy("word").agg(F.sum("df").alias("df"))
    got = {bytes(r.word): r.df for r in counts.collect()}  # one row a template word
    return got, got.pop(b"", 0)


class RareTokenIndex:
    """Each template is posted under its highest-IDF sure word; its other anchors follow, rarest first."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], df: dict[bytes, int], n: int, anchors: int = 3) -> None:
        self.labels = [label for label, _, _ in templates]
        self.words = [text.encode().split() for _, text, _ in templates]
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for words in self.words for w in words}
        self.keys: list[list[tuple[int, list[bytes]]]] = []
        #: word -> (template, its position there, the further anchors (word, position))
        self.postings: dict[bytes, list[tuple[int, int, list[tuple[bytes, int]]]]] = {}
        for t, (words, (_, _, phrases)) in enumerate(zip(self.words, templates, strict=True)):
            places = []
            for phrase in phrases:
                key = phrase.encode().split()
                places.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
            self.keys.append(places)
            # Anchors come from the mandatory phrases: every true occurrence holds those words in place.
            sure = sorted({i + k for i, key in places for k in range(len(key))}, key=lambda i: (-self.idf[words[i]], i))[:anchors]
            self.postings.setdefault(words[sure[0]], []).append((t, sure[0], [(words[i], i) for i in sure[1:]]))
        self.leads = frozenset(self.postings)
        self.anchors = self.leads.union(w for posts in self.postings.values() for _, _, rest in posts for w, _ in rest)

    def matches(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, score) of all verified places."""
        own = self.leads.intersection(words)
        if not own:
            return []
        at: dict[bytes, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.anchors:
                at.setdefault(w, []).append(i)
        found = []
        for lead in sorted(own, key=lambda w: (-self.idf[w], w)):
            for t, p, rest in self.postings[lead]:
                starts = {i - p for i in at[lead]}
                for w, q in rest:
                    starts.intersection_update([i - q for i in at.get(w, ())])
                    if not starts:
                        break
                for start in starts:
                    if any(start + i < 0 or words[start + i : start + i + len(key)] != key for i, key in self.keys[t]):
                        continue
                    template = self.words[t]
                    found.append((t, start, sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(template)) / len(template)))
        return sorted(found)


def places(words: list[bytes], phrases: list[bytes]) -> dict[bytes, list[int]]:
    """For each phrase the word positions where it starts; phrases don't overlap themselves."""
    line = b" " + b" ".join(words) + b" "
    found = {}
    for phrase in phrases:
        starts, at = [], line.find(b" " + phrase + b" ")
        last = count = 0
        while at >= 0:
            count += line.count(b" ", last, at)
            last = at
            starts.append(count)
            at = line.find(b" " + phrase + b" ", at + len(phrase))
        if starts:
            found[phrase] = starts
    return found


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches string"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list | None = None, min_score: float = 0.75, anchors: int = 3) -> DataFrame:
    """A row for each document; matches lists the templates' places as label@word:score, comma-joined."""
    templates = TEMPLATES if templates is None else templates
    vocabulary = {w for _, text, _ in templates for w in text.encode().split()}
    df, n = document_frequencies(docs, vocabulary, text_col)

    def make():
        index = RareTokenIndex(templates, df, n, anchors)
        base = {k.encode(): v for k, v in BASE.items()}

        def fn(keys, texts):
            out = ([], [], [], [], [], [], [], [], [])
            for key, text in zip(keys, texts, strict=True):
                words = plain_words(text)
                found = places(words, list(base))
                starts = [i for v in found.values() for i in v]
                base_labels = {base[p] for p in found}
                good = [m for m in index.matches(words) if m[2] >= min_score]
                score = max([float(bool(starts)), *(m[2] for m in good)])
                row = (key, len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(base_labels | {index.labels[t] for t, _, _ in good})), score, ",".join(f"{index.labels[t]}@{i}:{s:.3f}" for t, i, s in good))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return fn

    return map_rows(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), make, RESULT)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
