"""Quality rules as a short-circuit cascade, in DataFrame functions only.

The base counts follow from the words (runs of characters other than space and tab to
carriage return) and the lines of a text. The rules of ``rules()`` each reject a text; a text
is kept when the base conditions hold and no rule rejects it. Rules are evaluated one after
the other and the first rejection ends the chain (a ``CASE`` evaluates a branch only when
the earlier ones did not apply). Their order comes from a sample of ``SAMPLE`` rows in
expectation: for each rule the share it rejects and the time it takes beyond reading the
sample; the rule with the most rejections for its cost comes first. The order changes the
cost only, never the verdict, as a text is kept exactly if no rule rejects it.

Repeated 5-word windows are found inside the row: windows are hashed to 64 bits (a hash
over the words of the slice), and only a text that has fewer distinct windows than windows
sorts its (hash, position) pairs, marks those with an equal neighbour and adds up the words
they cover. Nothing is exploded or shuffled.

Defined results: a null text counts as empty: all counts are 0 and the base conditions
fail. Very long texts are counted whole, in one row's arrays. Repeated rows each get their result; empty tables give no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 2000
WINDOW = 5
# White space of the word definition, and the symbols that are counted.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def rules() -> dict[str, Column]:
    """name -> rejection, on the columns of ``counted``."""
    text, words, chars = F.col("text"), F.col("n_words"), F.col("word_chars")
    return {
        "symbols": 100 * F.col("n_symbols") > 10 * words,
        "duplicate_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (chars < 2 * words) | (chars > 15 * words),
        "exclamations": 100 * _count(text, "!") > 20 * words,
        "capitals": 100 * _count(text, r"\p{Lu}") > 40 * chars,
        "letters": 100 * (F.length(text) - _count(text, r"\P{L}")) < 50 * chars,
        "distinct_words": 100 * F.size(F.array_distinct("words")) < 10 * F.least(words, F.lit(1000)),
    }


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text, words and the base counts of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(SPACE.replace("[", "[^")))
    read = (docs.select("doc_id", text.alias("text"))
            .select("*", F.filter(F.split("text", f"{SPACE}+"), lambda w: w != "").alias("words"), lines.alias("lines")))
    n = F.size("words")
    windows = F.when(n > WINDOW, F.transform(F.sequence(F.lit(1), n - WINDOW + 1),
                                             lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    made = read.select(
        "doc_id", "text", "words", n.cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda n, w: n + F.length(w)).alias("word_chars"),
        _count(F.col("text"), SYMBOLS).alias("n_symbols"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        windows.alias("windows"))
    repeats = F.coalesce(F.size(F.array_distinct("windows")) < F.size("windows"), F.lit(False))
    placed = made.withColumn("placed", F.when(repeats, F.array_sort(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    alike = lambda x, k: F.coalesce(F.get("placed", k)["h"] == x["h"], F.lit(False))
    at = F.array_sort(F.transform(
        F.filter("placed", lambda x, k: alike(x, k - 1) | alike(x, k + 1)), lambda x: x["i"]))
    covered = F.aggregate(
        at, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
        lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(WINDOW), i - s["last"])).alias("n")),
        lambda s: s["n"])
    return (placed.withColumn("n_repeat_words", F.coalesce(F.when(F.col("placed").isNotNull(), covered), F.lit(0)).cast("long"))
            .drop("windows", "placed"))


def work() -> dict[str, Column]:
    """name -> nanoseconds that the rule takes on a row, on the columns of ``counted``."""
    few, chars = F.lit(500.0), F.length("text")
    return {"symbols": few, "duplicate_lines": few, "word_length": few, "exclamations": 27.0 * chars, "capitals": 25.0 * chars,
            "letters": 76.0 * chars, "distinct_words": 275.0 * F.col("n_words")}


def _base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_order(docs: DataFrame, rows: int = SAMPLE, given: dict[str, Column] | None = None,
               costs: dict[str, Column] | None = None) -> list[str]:
    """The names of the rules in the order of the cascade; see the module. ``given`` and
    ``costs`` are ``rules()`` and ``work()`` unless others are given."""
    given, costs = given or rules(), costs or work()
    total = docs.count()
    sample = counted(docs.select("doc_id", "text").sample(fraction=min(1.0, rows / max(total, 1)), seed=7))
    # rows that the same rules reject are one row, of which there are no more than sampled; base
    # failures are told apart by the key, as a filter would be moved into the counts' expressions
    sample = sample.select(_base_failed().alias("failed"), F.array(*(F.coalesce(given[n], F.lit(False)) for n in given)).alias("rejects"),
                           F.array(*(costs[n].cast("double") for n in given)).alias("costs"))
    found = sample.groupBy("failed", "rejects").agg(F.count(F.lit(1)).alias("n"), F.array(
        *(F.sum(F.get("costs", F.lit(k))) for k in range(len(given)))).alias("costs")).collect()
    left, order, names = [(r.rejects, r.n, r.costs) for r in found if not r.failed], [], list(given)
    while names:
        worth = {n: sum(r[1] for r in left if r[0][k]) / max(sum(r[2][k] for r in left), 1e-9)
                 for k, n in enumerate(given) if n in names}
        best = max(names, key=lambda n: worth[n])  # the first of equals
        order.append(best)
        names.remove(best)
        left = [r for r in left if not r[0][list(given).index(best)]]
    return order


def quality(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The base counts, ``base_failed`` and ``kept`` for each row; see the module."""
    rejects = rules()
    order = rule_order(docs) if order is None else order
    verdict = F.when(F.col("base_failed"), False)
    for name in order:
        verdict = verdict.when(rejects[name], False)
    return counted(docs).withColumn("base_failed", _base_failed()).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        verdict.otherwise(True).alias("kept"))
