"""Licence scan by a positional rare-token index, in DataFrame functions only.

The index holds templates: passages of licence texts with the phrases that must stand in them. The words of a
template's mandatory phrases of the highest inverse document frequencies in the corpus are posted with their positions. A
file looks up its rare licence words in a map; where a template's other posted words stand at their relative positions,
its mandatory phrases are verified word by word. A place has all words of the phrases, so it has those that
are posted: no place is lost, whatever other words of the passage are altered, cut off or found nowhere in the corpus.

Defined cases: a null or empty text has no word, no place, empty labels and score 0; places may overlap and
each counts; repeated rows each keep their result; an empty table gives an empty table; texts are
scanned whole, in time linear in their words.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: A word: digits, letters and every character that is not ASCII. Texts are lower-cased first.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Words of a template that the index holds, the rarest ones of its mandatory phrases.
POSTED = 3

#: The base phrases and their labels.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

#: Passages of public licences: label, passage, mandatory phrases.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("hereby granted free of charge",)),
    ("mit", "the software is provided as is without warranty of any kind express or implied", ("software is provided as is", "without warranty")),
    ("mit", "released under the mit licence", ("the mit licence",)),
    ("apache-2", "licensed under the apache license version 2 0", ("licensed under the apache license version 2 0",)),
    ("apache-2", "you may not use this file except in compliance with the license", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms", "with or without modification")),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors", ("nor the names of its contributors",)),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license", ("gnu affero general public license",)),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "4 0 international")),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-sa", "licensed under cc by sa", ("cc by sa",)),
    ("cc0", "to the extent possible under law the author has waived all copyright", ("waived all copyright",)),
    ("proprietary", "all rights reserved", ("all rights reserved",)),
)


def templates() -> list[dict]:
    out = [{"label": label, "base": True, "words": phrase.split(), "keys": [phrase.split()]} for label, phrase in BASE]
    return out + [{"label": label, "base": False, "words": text.split(), "keys": [k.split() for k in keys]} for label, text, keys in TEMPLATES]


def with_words(docs: DataFrame, text: str) -> DataFrame:
    lowered = lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit("")))
    return docs.withColumn("__words", F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)))


def word_rarity(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """Inverse document frequencies over all documents of the templates' words: as many numbers as the templates have words."""
    # The first pass reads words as pieces between ASCII non-word characters, the empty piece counting documents.
    pieces = F.split(lower_ascii(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    known = F.array_append(F.array_distinct(F.filter(pieces, lambda w: w.isin(vocabulary))), F.lit(""))
    counts = {r.word: r.n for r in docs.select(F.explode(known).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: math.log((counts.get("", 0) + 1) / (counts.get(w, 0) + 1)) + 1e-6 for w in vocabulary}


def posted(template: dict, idf: dict[str, float]) -> list[tuple[int, str]]:
    """The POSTED rarest places of the template's mandatory phrases, rarest first: (place in the template, word)."""
    places = {s + i: w for s, k in zip(starts(template), template["keys"]) for i, w in enumerate(k)}
    return sorted(places.items(), key=lambda x: (-idf[x[1]], x[0]))[:POSTED]


def starts(template: dict) -> list[int]:
    words = template["words"]
    return [next(i for i in range(len(words)) if words[i : i + len(k)] == k) for k in template["keys"]]


def index(idf: dict[str, float]) -> tuple[Column, list[str]]:
    """The postings, a map from a word to the templates that it is posted for, and its keys.

    A posting has the places of its template's other posted words relative to its own: where they don't stand, no place is verified.
    """
    found: dict[str, list[Column]] = {}
    for t in templates():
        own, (first, *others) = starts(t), posted(t, idf)
        keys = [F.struct(F.lit(s).alias("at"), F.array(*map(F.lit, k)).alias("words")) for s, k in zip(own, t["keys"])]
        others = [F.struct(F.lit(at - first[0]).alias("by"), F.lit(w).alias("word")) for at, w in others] or [F.struct(F.lit(0).alias("by"), F.lit(first[1]).alias("word"))]
        found.setdefault(first[1], []).append(F.struct(
            F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.array(*map(F.lit, t["words"])).alias("words"),
            F.array(*(F.lit(idf[w]) for w in t["words"])).alias("weights"), F.lit(sum(idf[w] for w in t["words"])).alias("total"),
            F.lit(first[0]).alias("posted_at"), F.lit(first[0] - min(own)).alias("least_at"), F.array(*others).alias("others"), F.array(*keys).alias("keys"),
        ))
    return F.create_map(*(x for w, rows in found.items() for x in (F.lit(w), F.array(*rows)))), sorted(found)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words and matches: array<struct<label, base, start, n_words, score>>, one for each place of a template.

    score is the share of the template's rarity that stands at its place. A place whose first words are cut off before the
    mandatory phrases starts below 0. Columns of docs with these two names give way, all others stay as they are.
    """
    idf = word_rarity(docs, sorted({w for t in templates() for w in t["words"]}), text)
    postings, anchors = index(idf)
    made = ("n_words", "matches")
    names = [c for c in docs.columns if c not in made]
    df = with_words(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("__row"), F.col(text).alias("__text")), "__text")
    words = F.col("__words")
    df = df.withColumn("__at", F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(anchors), i))))
    # All other posted words must stand at their distance from the one that was looked up.
    agrees = lambda t, p: (p >= t["least_at"]) & F.forall(t["others"], lambda o: F.coalesce(F.get(words, p + o["by"]) == o["word"], F.lit(False)))
    candidates = F.flatten(F.transform("__at", lambda p: F.transform(
        F.filter(F.element_at(postings, F.get(words, p)), lambda t: agrees(t, p)), lambda t: F.struct((p - t["posted_at"]).alias("start"), t.alias("t")))))
    df = df.withColumn("__candidates", F.when(F.size("__at") > 0, candidates))

    def stands(c: Column) -> Column:
        t, s = c["t"], c["start"]
        return F.forall(t["keys"], lambda k: F.slice(words, s + k["at"] + 1, F.size(k["words"])) == k["words"])

    def described(c: Column) -> Column:
        t, s = c["t"], c["start"]
        present = F.transform(t["words"], lambda w, j: F.when(F.get(words, s + j) == w, F.get(t["weights"], j)).otherwise(F.lit(0.0)))
        score = F.least(F.lit(1.0), F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / t["total"])
        return F.struct(t["label"].alias("label"), t["base"].alias("base"), s.cast("long").alias("start"), F.size(t["words"]).alias("n_words"), score.alias("score"))

    kind = "array<struct<label:string,base:boolean,start:bigint,n_words:int,score:double>>"
    found = F.coalesce(F.transform(F.filter("__candidates", stands), described), F.array().cast(kind))
    df = df.select("__row", F.size(words).cast("long").alias("n_words"), found.alias("matches"))
    return df.select(*(F.col("__row")[c].alias(c) for c in names), *made)


def summary(scanned: DataFrame) -> DataFrame:
    """The contract's columns from a scan's matches."""
    base = F.filter("matches", lambda m: m["base"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("matches", lambda m: m["score"])), F.lit(0.0)), 6).alias("score"),
    )


def oracle() -> str:
    """The summary in SQL, by looking for every template's phrases wherever their first word stands."""
    text = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    rows = ",\n  ".join(
        f"({i}, '{t['label']}', {str(t['base']).lower()}, {text(t['words'])}, [{', '.join(map(str, starts(t)))}], [{', '.join(text(k) for k in t['keys'])}], {min(starts(t))}, '{t['words'][min(starts(t))]}')"
        for i, t in enumerate(templates())
    )
    pattern = WORD.replace("'", "''")
    return f"""
WITH templates(id, label, base, words, spots, keys, first_at, first_word) AS (VALUES
  {rows}),
d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{pattern}') AS words FROM documents),
vocabulary AS (SELECT DISTINCT unnest(words) AS word FROM templates),
own AS (SELECT rid, unnest(list_distinct(words)) AS word FROM d),
df AS (SELECT word, count(*) AS n FROM own SEMI JOIN vocabulary USING (word) GROUP BY word),
idf AS (SELECT word, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1e-6 AS weight FROM vocabulary LEFT JOIN df USING (word)),
places AS (SELECT rid, unnest(words) AS word, unnest(range(len(words))) AS i FROM d),
tried AS (SELECT p.rid, t.id, p.i - t.first_at AS start FROM places p JOIN templates t ON p.word = t.first_word),
found AS (SELECT c.rid, c.id, c.start FROM tried c JOIN d USING (rid) JOIN templates t USING (id)
          WHERE len(list_filter(range(len(t.keys)), lambda k: d.words[c.start + t.spots[k + 1] + 1 : c.start + t.spots[k + 1] + len(t.keys[k + 1])] = t.keys[k + 1])) = len(t.keys)),
spelled AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS j FROM templates),
scored AS (SELECT f.rid, f.id, f.start, least(1.0, sum(CASE WHEN f.start + s.j >= 0 AND d.words[f.start + s.j + 1] = s.word THEN weight ELSE 0 END) / sum(weight)) AS score
           FROM found f JOIN d USING (rid) JOIN spelled s USING (id) JOIN idf USING (word) GROUP BY f.rid, f.id, f.start),
summed AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
                  list_sort(list(DISTINCT label) FILTER (WHERE base)) AS base_labels, list_sort(list(DISTINCT label)) AS labels, max(score) AS score
           FROM scored JOIN templates USING (id) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN summed USING (rid)
"""
