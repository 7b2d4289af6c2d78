import re

from pyspark.sql import functions as F

from broodline.llm import quality


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)} if len(windows) < 5000 else set()
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 10 or 100 * len(covered) > 20 * n)


EXTRA = {
    101: "a b c d e " * 4, 102: "one two three four five six one two three four five seven " + "x y z w " * 9,
    106: " ".join(f"w{i}" for i in range(150_000)),
    103: "line one\nline one\n \n \nother\nline one", 104: "😀 é # | <x> $5 100% *** & &", 105: "a b c d e f a b c d e",
}


def test_base_counts(spark, texts):
    rows = [*{**texts, **EXTRA}.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:7] for r in quality.quality(df).collect()}
    assert got == {i: base(t) for i, t in rows}


def test_order_does_not_change_the_verdict(spark, texts, empty, clashing):
    df = spark.createDataFrame([*{**texts, **EXTRA}.items()], "doc_id long, text string")
    names = quality.rule_order(df)
    assert sorted(names) == sorted(quality.rules())
    one = sorted(quality.quality(df, names).collect())
    assert one == sorted(quality.quality(df, names[::-1]).collect())
    assert not any(r.kept and r.base_failed for r in one) and any(r.kept for r in one)
    assert quality.quality(empty).count() == 0
    assert quality.quality(clashing, names).count() == clashing.count()


def test_the_order_is_the_same_on_every_call(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert len({tuple(quality.rule_order(docs)) for _ in range(3)}) == 1


def test_strict_cheap_rules_come_first(spark):
    """Rejections for the cost, on the rows that a rule is reached by, without base failures."""
    rows = [(i, " ".join(f"{'alpha' if i % 2 else 'beta'}{i}x{k}" for k in range(30)) + (" rare" if i % 10 == 0 else "")) for i in range(200)]
    rows += [(1000 + i, "same same") for i in range(500)]  # fail the base conditions: they reach no rule
    df = spark.createDataFrame(rows, "doc_id long, text string")
    has = lambda w: F.col("text").contains(w)
    given = {"only_base": has("same"), "dear_strict": has("alpha"), "cheap_strict": has("alpha") | has("rare"), "cheap_lax": has("rare"),
             "after": has("beta") & ~has("rare")}
    costs = {n: F.lit(100.0 if n.startswith("dear") else 1.0) for n in given}
    # 'cheap_strict' rejects 120 of 200 at 1 each; of the 80 left 'after' rejects all; then nothing is left
    order = quality.rule_order(df, 10_000, given, costs)
    assert order[:2] == ["cheap_strict", "after"] and order[2:] == ["only_base", "dear_strict", "cheap_lax"]
    dear_first = quality.rule_order(df, 10_000, given, costs | {"cheap_strict": F.lit(1000.0), "after": F.lit(1000.0)})
    assert dear_first[0] == "cheap_lax" and dear_first[1] == "dear_strict"


def test_plan_has_no_python(docs):
    plan = quality.quality(docs, list(quality.rules()))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange hashpartitioning" not in plan
