"""License scan by diagonal voting, in DataFrame functions only.

The hashes of all rolling word k-grams of a document are joined with the positions of the same
k-grams in the license templates. A hit votes for the diagonal ``place in document - place in
template``. Votes are gathered by document, template and diagonal; neighbouring diagonals (text
with a word put in or left out) merge to one span within a window of about twice the template's length, so
spans cannot chain along a document. A span is verified: the longest run of its k-grams in the template's
order must hold enough of the template, and the k-grams that tell a license from its like (a version, ``nc`` or
``sa``) must be among its votes. A *phrase* must stand word for word: all its k-grams on one diagonal.

Votes compare the words themselves beside the hash, so a span never rests on a hash collision.
The templates are a parameter; they are broadcast up to ``BROADCAST_ROWS`` words, and joined by shuffle beyond.

Defined cases: a null or empty text has no words and no labels; a text shorter than a template
can hold no phrase of it; texts of any length are searched whole; repeated rows give equal rows; documents
with one id and different texts stay apart; a null id stays null; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import require, words

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for texts whose capitals still stand.
MIXED_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 100_000
K = 2


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    #: Least part of the template's k-grams that a span must hold; 1.0 asks for the very words.
    least: float = 0.75
    #: Runs of words that a span must hold whatever else it lacks.
    must: tuple[str, ...] = ()


#: The base phrases and common licence lines.
TEMPLATES = (
    Template("cc-by", "cc by", True, 1.0),
    Template("gpl", "general public license", True, 1.0),
    Template("reserved", "all rights reserved", True, 1.0),
    Template("apache", "licensed under the apache license version 2 0", must=("apache license", "version 2")),
    Template("cc-by-nc", "licensed under cc by nc 4 0", must=("by nc",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", must=("by sa",)),
    Template("gpl-2", "this work is licensed under the gnu general public license version 2", must=("public license", "version 2")),
    Template("gpl-3", "this work is licensed under the gnu general public license version 3", must=("public license", "version 3")),
    Template("mit", "released under the mit license", must=("mit license",)),
    Template("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", must=("mozilla public",)),
    Template("cc", "licensed under a creative commons attribution", must=("creative commons",)),
)


def compulsory(template: Template, k: int = K) -> list[int]:
    """Places of the k-grams that ``must`` names."""
    words = template.text.split()
    grams = [words[i : i + k] for i in range(len(words) - k + 1)]
    asked = [m.split()[i : i + k] for m in template.must for i in range(len(m.split()) - k + 1)]
    return sorted({grams.index(g) for g in asked})


def tokens(text: Column) -> Column:
    """Words of a text. Only A-Z differ from a-z in templates, so letters beyond ASCII may be lower-cased as well."""
    return words(F.lower(text), SEPARATORS)


def kgrams(w: Column, k: int) -> Column:
    """Structs (w0, w1, ...) of all rolling k-grams; the last k - 1 hold a null."""
    return F.arrays_zip(*[F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))).alias(f"w{i}") for i in range(k)])


def template_positions(spark: SparkSession, templates: tuple[Template, ...], k: int) -> DataFrame:
    rows = [(t.label, t.text, t.base, float(t.least), compulsory(t, k)) for t in templates]
    df = spark.createDataFrame(rows, "label string, phrase string, base boolean, least double, must array<int>")
    df = df.select("label", "base", "least", "must", tokens(F.col("phrase")).alias("w")).withColumn("n_grams", F.size("w") - (k - 1))
    df = df.select("label", "base", "least", "must", "n_grams", F.posexplode(kgrams(F.col("w"), k)).alias("tpos", "g")).where(F.col("tpos") < F.col("n_grams"))
    return df.select("label", "base", "least", "must", "n_grams", "tpos", F.col("g").alias("template_gram"), _hash("g", k).alias("h"))


def _hash(gram: str, k: int) -> Column:
    return F.xxhash64(*[F.col(f"{gram}.w{i}") for i in range(k)])


def spans(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, shift: int = 3) -> DataFrame:
    """Verified spans: doc_id, text_key, label, base, first_word, last_word (starts), coverage."""
    require(docs, "doc_id", "text")
    positions = template_positions(docs.sparkSession, templates, k)
    if sum(len(t.text.split()) for t in templates) <= BROADCAST_ROWS:
        positions = F.broadcast(positions)
    # The words are a column of their own below the explode, so no exploded row carries the text.
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), tokens(F.col("text")).alias("w"))
    grams = base.select("doc_id", "text_key", F.posexplode(kgrams(F.col("w"), k)).alias("pos", "g"))
    same = [F.col(f"g.w{i}") == F.col(f"template_gram.w{i}") for i in range(k)]
    votes = grams.withColumn("h", _hash("g", k)).join(positions, "h").where(reduce(Column.__and__, same))
    key = ["doc_id", "text_key", "label", "base", "least", "must", "n_grams"]
    diagonal = (F.col("pos") - F.col("tpos")).alias("diagonal")
    exact = votes.where("least >= 1").groupBy(*key, diagonal).agg(F.collect_set("tpos").alias("held")).where(F.size("held") == F.col("n_grams"))
    exact = exact.withColumns({"first_word": F.col("diagonal"), "last_word": F.col("diagonal"), "coverage": F.lit(1.0)})
    # A span reaches over less than one length, so one of two neighbouring windows holds it whole.
    length = 2 * F.col("n_grams") + shift
    home = F.floor(F.col("pos") / length)
    loose = votes.where("least < 1").withColumn("window", F.explode(F.array(home, home - 1)))
    loose = loose.groupBy(*key, "window", diagonal).agg(F.collect_set(F.struct("pos", (-F.col("tpos")).alias("back"))).alias("votes"))
    by_text = Window.partitionBy("doc_id", "text_key", "label", "window").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_text) > shift, F.lit(True))
    loose = loose.withColumn("far", far.cast("int")).withColumn("span", F.sum("far").over(by_text))
    merged = loose.groupBy(*key, "window", "span").agg(F.flatten(F.collect_list("votes")).alias("votes"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"))
    held = F.transform("votes", lambda v: -v["back"])
    merged = merged.where(F.forall("must", lambda m: F.array_contains(held, m)))
    merged = merged.withColumn("coverage", longest_run(F.col("votes"), F.col("n_grams")) / F.col("n_grams")).where("coverage >= least")
    names = ["doc_id", "text_key", "label", "base", "first_word", "last_word", "coverage"]
    return exact.select(names).unionByName(merged.select(names).distinct())


def longest_run(votes: Column, n_grams: Column) -> Column:
    """Most votes (pos, -tpos) whose places rise in document and template alike."""

    def step(best: Column, v: Column) -> Column:
        at = -v["back"]
        value = F.coalesce(F.array_max(F.slice(best, F.lit(1), at)), F.lit(0)) + 1
        return F.transform(best, lambda b, i: F.when(i == at, F.greatest(b, value)).otherwise(b))

    return F.aggregate(F.sort_array(votes), F.transform(F.sequence(F.lit(1), n_grams), lambda _: F.lit(0)), step, lambda best: F.array_max(best))


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, k: int = K, shift: int = 3) -> DataFrame:
    """One row per input row with its words, base places, labels and score (best coverage)."""
    found = spans(docs, templates, k, shift).groupBy("doc_id", "text_key").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("first_word"))).alias("first_word"),
        F.max(F.when(F.col("base"), F.col("last_word"))).alias("last_word"),
        F.collect_set(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        F.collect_set("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    every = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.size(words(F.col("text"), MIXED_SEPARATORS)).cast("long").alias("n_words"))
    on = every["doc_id"].eqNullSafe(found["doc_id"]) & (every["text_key"] == found["text_key"])
    joined = every.join(found, on, "left")
    text = lambda c: F.coalesce(F.array_join(F.sort_array(c), ","), F.lit(""))
    return joined.select(
        every["doc_id"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        text("base_labels").alias("base_labels"),
        text("labels").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
