"""Quality rules as weak supervision, in DataFrame functions only.

Every rule looks at counts of the whole text and votes bad (-1), good (+1) or
abstains (0). No rule decides alone: expectation-maximisation over the counts of
vote patterns estimates how often each rule is right when it votes, and a
document is kept if its posterior probability of being good is at least one
half. Only the patterns' counts (three to the power of the number of rules at
most) take part in the iterations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.session import scratch_dir

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 8
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct", "n_capitals", "n_exclaim", "n_bars", "n_stops")


def _without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole_rows: bool = False) -> DataFrame:
    """Per row: id, the base counts and those that the rules need (all long). Null text has no words.
    With ``whole_rows`` the first column is not the id but ``_row``, a struct of all columns.

    Repeated words are those in windows of eight words that occur twice or more
    in the text. A text whose windows are all different (by their 64-bit
    hashes) is done with that; only others are sorted by window.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    first = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row") if whole_rows else F.col(id_col)
    id_col = "_row" if whole_rows else id_col
    split = docs.select(
        first, text.alias("text"),
        F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("words"),
        F.filter(F.split(text, "\n"), lambda line: F.translate(line, WHITE, "") != "").alias("lines"))
    n = F.size("words")
    counted = split.select(
        id_col, n.cast("long").alias("n_words"), _without(F.col("text"), WHITE).cast("long").alias("word_chars"),
        (F.length("text") - _without(F.col("text"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("text") - _without(F.col("text"), CAPITALS)).cast("long").alias("n_capitals"),
        (F.length("text") - _without(F.col("text"), "!")).cast("long").alias("n_exclaim"),
        (F.length("text") - _without(F.col("text"), "|")).cast("long").alias("n_bars"),
        (F.length("text") - _without(F.col("text"), ".")).cast("long").alias("n_stops"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    windows = counted.select(
        "*", F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.when(n_of("hashes") >= WINDOW,
               F.transform(F.sequence(F.lit(1), F.greatest(n_of("hashes") - (WINDOW - 1), F.lit(1))),
                           lambda i: F.xxhash64(F.slice("hashes", i, F.lit(WINDOW)))))
        .otherwise(F.array().cast("array<bigint>")).alias("windows")).drop("hashes")
    repeats = windows.select(
        "*", F.when(n_of(F.array_distinct("windows")) < n_of("windows"),
                    F.array_sort(F.transform("windows", lambda w, i: F.struct(w.alias("w"), i.alias("i")))))
        .alias("ordered")).drop("windows")
    same = repeats.select(
        "*", F.array_sort(F.transform(
            F.filter("ordered", lambda x, k: (x["w"].eqNullSafe(F.get("ordered", k - 1)["w"]))
                     | (x["w"].eqNullSafe(F.get("ordered", k + 1)["w"]))), lambda x: x["i"])).alias("places")).drop("ordered")
    covered = F.aggregate(
        "places", F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n")), lambda a: a["n"])
    return same.select(id_col, *BASE[:-1], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), *MORE)


def n_of(column) -> Column:
    return F.size(column)


def rules() -> dict[str, Column]:
    """Name -> vote: -1 bad, +1 good, 0 abstains. Thresholds are shares of words, lines or characters."""
    c = F.col
    bad = lambda condition: F.when(condition, -1).otherwise(0)
    good = lambda condition: F.when(condition, 1).otherwise(0)
    few_symbols = c("n_symbols") * 50 <= c("n_words")
    plain = few_symbols & (c("n_capitals") * 5 <= c("word_chars")) & (c("n_exclaim") * 50 <= c("n_words"))
    stops = (c("n_stops") * 60 >= c("n_words")) & (c("n_stops") * 3 <= c("n_words"))
    return {
        "symbols": bad(c("n_symbols") * 10 > c("n_words")),
        "capitals": bad(c("n_capitals") * 3 > c("word_chars")),
        "exclamations": bad(c("n_exclaim") * 5 > c("n_words")),
        "repeats": bad(c("n_repeat_words") * 10 > c("n_words") * 3),
        "repeated_lines": bad((c("n_lines") >= 3) & (c("n_dup_lines") * 2 > c("n_lines"))),
        "few_distinct": bad((c("n_words") >= 50) & (c("n_distinct") * 10 < F.sqrt("n_words") * 10)),
        "word_length": bad((c("word_chars") < c("n_words") * 2) | (c("word_chars") > c("n_words") * 15)),
        "bars": bad(c("n_bars") * 10 > c("n_words")),
        "plain_prose": good(plain & (c("n_repeat_words") * 10 <= c("n_words") * 3)),
        "sentences": good(stops & few_symbols),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)


def posterior(accuracy: dict[str, float]) -> Column:
    """Probability of being good, from the columns of votes (even odds before the votes)."""
    odds = F.lit(0.0)
    for name, a in accuracy.items():
        odds = odds + F.col(f"vote_{name}") * F.lit(math.log(a / (1 - a)))
    return 1 / (1 + F.exp(-odds))


def estimate(patterns: DataFrame, names: list[str], start: float = 0.85, rounds: int = 25, tolerance: float = 1e-4,
             strength: float = 0.1) -> dict[str, float]:
    """Accuracy of each rule by expectation-maximisation over (votes, n).

    Each round is one aggregation of the pattern table. A prior that weighs as
    much as ``strength`` of the rule's votes holds it to ``start``; accuracies
    stay within 0.55 and 0.99, so a vote never turns into its opposite. A rule
    that never votes keeps ``start``.
    """
    accuracy = dict.fromkeys(names, start)
    for _ in range(rounds):
        p = posterior(accuracy)
        votes = [F.col(f"vote_{k}") for k in names]
        found = patterns.agg(
            *[F.sum(F.when(v > 0, F.col("n") * p).when(v < 0, F.col("n") * (1 - p))).alias(f"right_{k}")
              for k, v in zip(names, votes)],
            *[F.sum(F.when(v != 0, F.col("n"))).alias(f"votes_{k}") for k, v in zip(names, votes)]).first()
        moved = 0.0
        for k in names:
            total = found[f"votes_{k}"]
            if total:
                new = (found[f"right_{k}"] + strength * total * start) / (total * (1 + strength))
                new = min(0.99, max(0.55, new))
                moved, accuracy[k] = max(moved, abs(new - accuracy[k])), new
        if moved < tolerance:
            break
    return accuracy


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id, the base counts, base_failed, quality (posterior) and kept.

    Kept are documents that do not fail the base rule (fewer than 20 words, or
    more than 30 % repeated words) and whose posterior reaches ``threshold``;
    where every rule abstains it is one half, which keeps the document. Null
    and empty texts have no words and fail. Repeated rows and null ids pass
    through row by row; other columns are not read. The counts are written
    once to the shared folder, and votes are read from there.
    """
    return _judged(statistics(docs, id_col, text_col)).select(
        id_col, *BASE, "base_failed", "quality", (~F.col("base_failed") & (F.col("quality") >= threshold)).alias("kept"))


def accepted(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that ``judge`` keeps, with all their columns. They are written once, with their
    counts, to the shared folder, so the counts are not taken twice."""
    judged = _judged(statistics(docs, text_col=text_col, whole_rows=True))
    return judged.where(~F.col("base_failed") & (F.col("quality") >= threshold)).select("_row.*")


def _judged(counted: DataFrame) -> DataFrame:
    spark = counted.sparkSession
    path = scratch_dir(spark, "rules")
    counted.write.parquet(f"{path}/counts")
    votes = {f"vote_{k}": v.cast("int") for k, v in rules().items()}
    judged = spark.read.parquet(f"{path}/counts").withColumns(votes)
    judged.groupBy(*votes).agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/patterns")
    accuracy = estimate(spark.read.parquet(f"{path}/patterns"), list(rules()))
    return judged.withColumn("base_failed", base_failed()).withColumn("quality", posterior(accuracy))
