import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from broodline.llm import prefix_trie
from broodline.session import stage

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    convs = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            convs[c].append(((t is not None, t or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = tuple(own.get(c - c % 5, [])[:h]) + tuple(own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
        ends[made[c]].append(c)
    kids = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        cost = (len(m) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += cost
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()) for p, m in members.items())


def key(row):
    return [(x is not None, x) for x in row]


def same(spark, rows, parts=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(df).collect()), key=key)
    want = sorted(brute(rows), key=key)
    assert len(got) == len(want)
    assert got == want


def talks(seed, n, most, kinds):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(kinds)) for c in range(n) for t in range(r.randint(1, most))]


def test_equals_brute_force(spark):
    rows = talks(1, 60, 10, ["a", "b", "é", "", None])
    rows += [(100, None, "user", "no turn"), (100, 0, "user", "x"), (100, 0, "user", "w"), (100, 0, "user", "w"),
             (None, 1, "user", "no conversation"), (7_000_000_003, 3, "user", "base absent"), (101, 0, "user", "y" * 1_000_000)]
    same(spark, rows)


def test_long_conversations(spark):
    """Blocks, their scan, runs and rakes: 300 turns shared by some, and combs of other lengths."""
    spine = [(t, "user", f"turn {t % 7}") for t in range(300)]
    rows = []
    for c in (5, 10, 15, 20, 25):  # base conversations keep all their turns in place
        cut = {5: 300, 10: 300, 15: 200, 20: 150, 25: 64}[c]
        rows += [(c, *x) for x in spine[:cut]] + [(c, cut, "user", f"end {c}")] * (c != 10)
    rows += [(30 + 5 * k, *x) for k in range(40) for x in spine[: 3 * k + 1] + [(999, "user", f"tooth {k}")]]
    same(spark, rows)


def test_chain_across_paths(spark, monkeypatch):
    """Each node of the spine has another smallest member, so only odd rounds shorten it."""
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    spine = [(t, "user", "s") for t in range(20)]
    rows = [(5 * (k + 1), *x) for k in range(20) for x in spine[: k + 1] + [(999, "user", f"tooth {k}")]]
    same(spark, rows)


def test_copies_end_in_the_same_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    rows = [(c, t, "user", "same") for c in range(0, 100, 5) for t in range(4)]
    same(spark, rows, 6)


def test_empty_and_clashing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = talks(3, 20, 6, ["a", "b"])
    df = spark.createDataFrame(rows, SCHEMA)
    names = "id parent path depth x y n d h base first pid mid digest bytes pos taken spread block is_hot".split()
    more = df.select("*", *(F.lit("z").alias(n) for n in names))
    assert sorted(prefix_trie.prefix_trie(more).collect(), key=key) == sorted(prefix_trie.prefix_trie(df).collect(), key=key)


def test_hot_conversation_is_cut(spark, monkeypatch):
    staged = []
    monkeypatch.setattr(prefix_trie, "stage", lambda df: staged.append(stage(df)) or staged[-1])
    rows = spark.range(20_000).selectExpr(
        "if(id % 3 = 0, 5L, id) as conv_id", "id as turn", "'user' as role", "cast(id as string) as text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns, own = prefix_trie.numbered_turns(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert staged[0].where("conv_id = 5").select("pid").distinct().count() > 1
    assert own.where("conv_id = 5").first().n == 6667
    assert turns.agg(F.min("rn"), F.max("rn"), F.count_distinct("rn")).first() == (1, 20_000, 20_000)
