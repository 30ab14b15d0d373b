"""Operator 4: licence scan with a positional rare-token index.

The index lists, for each word of a set of licence templates, the templates and positions where it
stands, for the ``rare`` words of highest inverse document frequency (over all files) of each
template.  A file's licence words are found with their positions; all that the index lists are
looked up, however many templates the file holds, and postings that agree on the relative
position of file and template are counted together.  A template is a match if at least ``agree``
of its words stand at one relative position and all its key phrases are in the file.

All of it is DataFrame functions.  The text is read once: a narrow table keeps each file's word
count and licence words; document frequencies are one aggregation with at most as many rows as
the templates have words.  Work per file is linear in its words (a sort of its licence words
apart), and nothing is shuffled but those frequencies.

Defined cases: a null or empty text has no words and no labels, score 0; files are scanned row by
row, so ties, repeated rows and null ids need no rule; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, input_rows, materialize

#: What a word is, after A-Z are lower-cased.
LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base scan.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, wording, key phrases (which hold no stop words).
TEMPLATES = (
    ("gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "released under the gnu gpl version 2 or later", ("gnu gpl",)),
    ("lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    ("apache", "licensed under the apache license version 2 0", ("apache license",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free", "person obtaining")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("binary forms", "without modification")),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("copy modify", "hereby granted")),
    ("cc-by", "licensed under cc by 4 0", ("cc by",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("mpl", "subject to the terms of the mozilla public license version 2 0", ("mozilla public license",)),
    ("epl", "made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free", "unencumbered software")),
)
#: Template words too common to index.
STOP = ("a", "and", "any", "are", "available", "for", "in", "into", "is", "made", "of", "or", "this", "the", "to", "under", "use", "with")


def postings(templates=TEMPLATES) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, position) of the positional index."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, wording, _) in enumerate(templates):
        for p, w in enumerate(wording.split()):
            if w not in STOP:
                out.setdefault(w, []).append((t, p))
    return out


def licence_words(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_words, hits: licence words with positions, in order."""
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(f"({LICENCE_WORD})"), F.lit(1))
    split = input_rows(docs, id_col, text_col).select(F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    found = F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.cast("long").alias("p"), w.alias("w"))))
    return split.select("doc_id", F.size("words").cast("long").alias("n_words"), F.filter(found, lambda x: x.isNotNull()).alias("hits"))


def places(phrase: str) -> Column:
    """Positions where the words of ``phrase`` stand consecutively."""
    first, *rest = phrase.split()

    def start(x: Column, i: Column) -> Column:
        here = x["w"] == first
        for k, w in enumerate(rest, 1):
            y = F.get(F.col("hits"), i + k)
            here = here & (y["w"] == w) & (y["p"] == x["p"] + k)
        return F.when(here, x["p"])

    return F.filter(F.transform("hits", start), lambda p: p.isNotNull())


def aligned(index: dict[str, list[tuple[int, int]]], n_templates: int) -> Column:
    """For each template, the most looked-up words at one relative position."""
    post = F.create_map(*[x for w, at in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(p).cast("long").alias("p")) for t, p in at]))])
    looked = F.filter("hits", lambda x: F.map_contains_key(post, x["w"]))
    pairs = F.array_sort(F.flatten(F.transform(looked, lambda x: F.transform(F.element_at(post, x["w"]), lambda q: F.struct(q["t"].alias("t"), (x["p"] - q["p"]).alias("d"))))))
    start = F.struct(F.lit(-1).alias("t"), F.lit(0).cast("long").alias("d"), F.lit(0).alias("n"), F.array_repeat(F.lit(0), n_templates).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        n = F.when((acc["t"] == x["t"]) & (acc["d"] == x["d"]), acc["n"] + 1).otherwise(1)
        return F.struct(x["t"].alias("t"), x["d"].alias("d"), n.alias("n"), F.transform(acc["best"], lambda b, i: F.when(i == x["t"], F.greatest(b, n)).otherwise(b)).alias("best"))

    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def scan(docs: DataFrame, templates=TEMPLATES, rare: int = 8, agree: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and matches (an
    array of template number, label, words in place)."""
    index = postings(templates)
    vocabulary = sorted({*index, *(w for p, _ in PHRASES for w in p.split()), *(w for _, _, keys in templates for k in keys for w in k.split())})
    files = materialize(licence_words(docs, vocabulary, id_col, text_col), "licence_words")

    n = files.count()
    counts = files.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}  # one row per template word at most
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in index}
    keys_of = [sorted({w for w in wording.split() if w in index}, key=lambda w: (-idf[w], w))[:rare] for _, wording, _ in templates]
    listed = {w: kept for w, at in index.items() if (kept := [(t, p) for t, p in at if w in keys_of[t]])}

    base = {label: places(phrase) for phrase, label in PHRASES}
    keys = sorted({k for _, _, ks in templates for k in ks})
    rows = files.select("doc_id", "n_words", F.struct(*[v.alias(k) for k, v in base.items()]).alias("base"), F.struct(*[(F.size(places(k)) > 0).alias(f"k{i}") for i, k in enumerate(keys)]).alias("keys"), F.when(F.size("hits") > 0, aligned(listed, len(templates))).alias("best"))
    every = F.concat(*[F.col("base")[label] for label in base])
    matches = []
    for t, (label, wording, wanted) in enumerate(templates):
        size = sum(w not in STOP for w in wording.split())
        sure = (F.col("best")[t] >= min(agree, size)) & F.lit(True)
        for k in wanted:
            sure = sure & F.col("keys")[f"k{keys.index(k)}"]
        matches.append(F.when(sure, F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.col("best")[t].alias("words"), F.least(F.lit(1.0), F.col("best")[t] / float(min(rare, size))).alias("score"))))
    rows = rows.withColumn("matches", F.filter(F.array(*matches), lambda x: x.isNotNull()))
    base_labels = F.filter(F.array(*[F.when(F.size(F.col("base")[label]) > 0, label) for label in base]), lambda x: x.isNotNull())
    labels = F.array_sort(F.array_union(base_labels, F.transform("matches", lambda x: x["label"])))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).alias("first_word"),
        F.array_max(every).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda x: x["score"])), F.lit(0.0)).alias("score"),
        "matches",
    )
