"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a rejecting condition on one row. Before the run, one pass over a sample reads the
clock around each rule in each row and counts the rejections; the cascade then tries the rules with the most
rejections for their cost first, and a row stops at the first rule that rejects it. The order changes the time
and the name of the rejecting rule, never the verdict, which is the union of all the rules.
The sample is drawn row by row, so no task gathers it. Each of its rows is judged ``REPEATS`` times and a rule's
least time in the row counts, so that pauses and code not yet compiled weigh little; reading the clock is taken off.

Defined cases: a null text counts as empty; a text without words fails the base check; repeated
rows are judged one by one; further columns are left alone; an empty table gives an empty result.
A column of the input named like an output column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, require, words

WINDOW = 5
REPEATS = 3
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """A named rejecting condition; ``cost`` and ``rejects`` (a rate) are estimates."""

    name: str
    reject: Column
    cost: float = 0.0
    rejects: float = 0.0


def default_rules(text: str = "text") -> list[Rule]:
    """Conservative limits, each far outside what prose shows."""
    raw, n = F.coalesce(F.col(text), F.lit("")), F.col("n_words")
    capitals = F.length(F.regexp_replace(raw, "[^A-Z]+", ""))
    letters = F.length(F.regexp_replace(raw, "[^A-Za-z]+", ""))
    return [
        Rule("word_length", (2 * F.col("word_chars") < 3 * n) | (F.col("word_chars") > 25 * n)),
        Rule("symbol_density", 10 * F.col("n_symbols") > 3 * n),
        Rule("duplicate_lines", (F.col("n_dup_lines") >= 3) & (F.col("n_dup_lines") > 0.3 * F.size(F.split(raw, "\n")))),
        Rule("shouting", (letters >= 40) & (capitals > 0.5 * letters)),
        Rule("stuttering", raw.rlike(r"(?:^|[\x20\x09-\x0D])([^\x20\x09-\x0D]+)(?:[\x20\x09-\x0D]+\1){7}(?:[\x20\x09-\x0D]|\z)")),
        Rule("few_letter_words", 2 * F.size(F.filter(words(F.col(text)), lambda w: w.rlike(r"\p{L}"))) < n),
    ]


def repeated_words(tokens: Column, n: int = WINDOW) -> Column:
    """Words inside ``n``-word windows that occur at least twice in the array, the first one included.

    Hashes of the windows tell the texts without any repeat; only the others compare the windows themselves.
    """
    starts = lambda w: F.when(F.size(w) > n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.expr("cast(array() as array<int>)"))
    hashes = lambda w: F.transform(starts(w), lambda i: F.xxhash64(F.slice(w, i, n)))
    grams = lambda w: F.transform(starts(w), lambda i: F.concat_ws(" ", F.slice(w, i, n)))

    def positions(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda s, i: F.struct(s.alias("s"), i.alias("i"))))
        same = lambda e, o: F.coalesce(e["s"] == o["s"], F.lit(False))
        twice = let(ordered, lambda o: F.filter(o, lambda e, k: ((k > 0) & same(e, F.get(o, k - 1))) | same(e, F.get(o, k + 1))))
        covered = F.flatten(F.transform(twice, lambda e: F.sequence(e["i"], e["i"] + (n - 1))))
        return F.size(F.array_distinct(covered))

    unlike = lambda w: let(hashes(w), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return let(tokens, lambda w: F.when(unlike(w), F.lit(0)).otherwise(positions(grams(w))))


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the five counts. No row leaves its partition."""
    require(df, text)
    raw = F.coalesce(F.col(text), F.lit(""))
    tokens, lines = words(F.col(text)), F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size(tokens),
        "word_chars": F.length(F.array_join(tokens, "")),
        "n_symbols": F.length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeated_words(tokens),
    }
    return df.withColumns({k: v.cast("long") for k, v in counts.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def estimated(df: DataFrame, rules: list[Rule], sample_rows: int, text: str = "text") -> list[Rule]:
    """The rules in cascade order, with seconds and rejection rate on about ``sample_rows`` rows."""
    share = min(1.0, sample_rows / max(1, df.count()))
    some = with_metrics(df.select(text).sample(share, seed=1), text)
    # Fields of a struct are worked out in order, and the clock is read anew at each place.
    clock = F.java_method(F.lit("java.lang.System"), F.lit("nanoTime")).cast("long")
    readings = [x for k, r in enumerate(rules) for x in (F.coalesce(r.reject, F.lit(False)).alias(f"r{k}"), clock.alias(f"t{k}"))]
    once = F.struct(clock.alias("from"), clock.alias("idle"), *readings)
    copies = some.select(text, *METRICS, F.monotonically_increasing_id().alias("_row")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    timed = copies.select("_row", once.alias("once"))
    names = ["from", "idle", *(f"t{k}" for k in range(len(rules)))]
    least = [F.min(F.col(f"once.{b}") - F.col(f"once.{a}")).alias(b) for a, b in zip(names, names[1:], strict=False)]
    by_row = timed.groupBy("_row").agg(*least, *(F.first(f"once.r{k}").alias(f"r{k}") for k in range(len(rules))))
    found = by_row.agg(F.count("*").alias("n"), *(F.sum(b).alias(b) for b in names[1:]), *(F.count_if(f"r{k}").alias(f"r{k}") for k in range(len(rules)))).first()
    cost = lambda k: max((found[f"t{k}"] or 0) - (found["idle"] or 0), 1) / 1e9
    out = [Rule(r.name, r.reject, cost(k), found[f"r{k}"] / max(1, found["n"])) for k, r in enumerate(rules)]
    return sorted(out, key=lambda r: (-r.rejects / r.cost, r.cost, r.name))


def apply_rules(df: DataFrame, rules: list[Rule] | None = None, text: str = "text", sample_rows: int = 512) -> DataFrame:
    """Add the metrics, ``base_failed``, ``rejected_by`` (the first rule that rejects, else null) and ``kept``."""
    ordered = estimated(df, rules or default_rules(text), sample_rows, text)
    first = reduce(lambda c, r: c.when(r.reject, F.lit(r.name)), ordered, F.when(base_failed(), F.lit("base")))
    out = with_metrics(df, text).withColumns({"base_failed": base_failed(), "rejected_by": first})
    return out.withColumn("kept", F.col("rejected_by").isNull())
