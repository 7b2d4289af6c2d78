"""A trie of conversation prefixes, with subtree totals by parallel tree contraction.

Every conversation c is rebuilt from the first h turns of conversation c - c % 5 and its own
turns after its first h, where h = crc32(c in decimal) % 9. Turns (role, text) are told apart by
SHA-256, and a prefix by a digest that depends on its turns only: digests are chained within
blocks of ``BLOCK`` turns, and the blocks of longer conversations are combined by a doubling
scan, so no task walks along a long conversation. A node is a distinct prefix.

Totals of subtrees come from contraction rounds, which are joins (``subtree_sums``):

* rake: all leaves leave the tree and add their totals to their parents;
* compress: of a chain of nodes with a single child each, members are spliced out; the child
  below takes over their sums as the weight of its new, longer edge. Even rounds splice all
  of a run but its top within (path, depth range), where a path is the nodes that have the same
  smallest member, one for each depth; odd rounds splice nodes that drew 1 below a node that
  drew 0, which also shortens chains that run across paths.

A tree of n nodes is one node after some log n rounds. Then the rounds are undone, last first:
a spliced node's total is that of the node that was below it plus what lay between.

Skew: rows are sorted by (conversation, turn) over all tasks and numbered by prefix sums of the
partitions, so a hot conversation is cut. Children are counted and summed by partial
aggregation. Parents of more than one node in 1,000 are looked up by broadcast
(``join_by_share``). The conversations that end in a node are written as pieces of
``PIECE`` ids from sorted ranges; only the hashing of the pieces of one node is sequential, as
SHA-256 is, and that is a stream.

Memory: a block has ``BLOCK`` turns' digests, a window ``RUN`` nodes, a piece ``PIECE`` ids.
A text is held as one row.

Defined results: a null role or text is empty. A null turn comes first; rows of the same turn
are ordered by role, then text; repeated rows are turns of their own. Rows without conv_id are
no conversation. A conversation without rebuilt turns is a member of the root alone. Very long
texts are hashed whole. An empty table has no root and gives no rows. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from broodline.functions.skew import join_by_share
from broodline.session import materialize, stage

BLOCK = 64  # turns whose digests are chained in one array
RUN = 4096  # depths of a path whose chain is spliced in one window
PIECE = 50_000  # ids of a piece of a node's list
SHARED = 5  # conversations that take their first turns from the same one
MOST = 9  # h is less than this


def _root() -> Column:
    return F.lit(b"")


def _sha(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def numbered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, rn, digest, bytes), the turns in order with consecutive numbers, and
    (conv_id, first, n), where each conversation starts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"))
    # a range sort over (conversation, turn): equal rows are interchangeable
    ordered = rows.orderBy("conv_id", F.col("turn").asc_nulls_first(), "role", "text").select(
        "conv_id", _sha(F.octet_length("role").cast("string").cast("binary"), F.lit(b":"), F.col("role").cast("binary"),
                        F.col("text").cast("binary")).alias("digest"),
        F.octet_length("text").cast("long").alias("bytes"),
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid"))
    tagged = stage(ordered)
    counts = tagged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    # one row for each partition, a bounded table
    offsets = counts.select("pid", F.coalesce(F.sum("n").over(
        Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("off"))
    turns = tagged.join(F.broadcast(offsets), "pid").select(
        "conv_id", (F.col("off") + F.col("mid") - F.shiftleft(F.col("pid").cast("long"), 33) + 1).alias("rn"),
        "digest", "bytes")
    return turns, turns.groupBy("conv_id").agg(F.min("rn").alias("first"), F.count(F.lit(1)).alias("n"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, d, digest, bytes), (conv_id, n_turns)) of the rebuilt conversations."""
    turns, own = numbered_turns(conversations)
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST
    convs = materialize(own.select("conv_id", "first", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % SHARED).alias("base")))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    convs = materialize(convs.join(lengths, "base", "left").select(
        "conv_id", "first", "n", "h", "base", taken.alias("taken"),
        (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns")))
    total = convs.agg(F.sum("n")).first()[0] or 0
    at = join_by_share(turns, convs.select("conv_id", "first", "h", "taken", "n"), "conv_id", "n", total).withColumn(
        "pos", F.col("rn") - F.col("first") + 1)
    later = at.where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("d"), "digest", "bytes")
    # at most MOST - 1 turns of a conversation, for at most 2 * SHARED conversations
    shared = at.where(f"conv_id % {SHARED} = 0 and pos < {MOST}").select(
        F.col("conv_id").alias("base"), "pos", "digest", "bytes")
    first = convs.where("taken > 0").select("conv_id", "base", "taken").join(shared, "base").where("pos <= taken").select(
        "conv_id", F.col("pos").alias("d"), "digest", "bytes")
    return later.unionByName(first), convs.select("conv_id", "n_turns")


def _carried(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, whole) of full blocks -> (conv_id, block, carry, above): for the block
    after each of them, the digest of all blocks before and the id of the prefix they form.

    The scan doubles: after k rounds a value stands for the last 2**k blocks. How values are
    combined depends on the block's number alone, so equal prefixes get equal digests.
    """
    now = materialize(blocks.select("conv_id", "block", "whole", F.col("whole").alias("scan")))
    step, last = 1, now.agg(F.max("block")).first()[0] or 0
    while step <= last:
        before = now.select("conv_id", (F.col("block") + step).alias("block"), F.col("scan").alias("earlier"))
        now = materialize(now.join(before, ["conv_id", "block"], "left").select("conv_id", "block", "whole", F.when(
            F.col("earlier").isNotNull(), _sha(F.lit(b"scan"), F.col("earlier"), F.col("scan"))).otherwise(F.col("scan")).alias("scan")))
        step *= 2
    before = now.select("conv_id", (F.col("block") + 1).alias("block"), F.col("scan").alias("earlier"))
    return now.join(before, ["conv_id", "block"], "left").select(
        "conv_id", (F.col("block") + 1).alias("block"), F.col("scan").alias("carry"),
        F.when(F.col("block") == 0, F.col("whole")).otherwise(_sha(F.lit(b"at"), F.col("earlier"), F.col("whole"))).alias("above"))


def prefixes(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, d, id, parent, bytes) of each rebuilt turn: the digest of the first d turns,
    that of the first d - 1 and the bytes of the text."""
    lists = turns.groupBy("conv_id", F.floor((F.col("d") - 1) / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("d", "digest", "bytes"))).alias("x"))
    chain = F.aggregate("x", F.array(_root()), lambda acc, t: F.concat(acc, F.array(
        _sha(F.lit(b"turn"), F.element_at(acc, -1), t["digest"]))))
    lists = lists.select("conv_id", "block", "x", chain.alias("chain"))
    if lengths.where(F.col("n_turns") > BLOCK).isEmpty():
        carried = lists.select("*", F.lit(None).cast("binary").alias("carry"), F.lit(None).cast("binary").alias("above"))
    else:
        lists = stage(lists)
        full = lists.where(F.size("x") == BLOCK).select("conv_id", "block", F.element_at("chain", -1).alias("whole"))
        carried = lists.join(_carried(full), ["conv_id", "block"], "left")
    at = F.transform(F.col("chain"), lambda c: F.when(F.col("carry").isNull(), c).otherwise(_sha(F.lit(b"at"), F.col("carry"), c)))
    rows = carried.select("conv_id", "x", "above", at.alias("ids")).select(
        "conv_id", "above", "ids", F.posexplode("x").alias("i", "t"))
    parent = F.when((F.col("i") == 0) & F.col("above").isNotNull(), F.col("above")).otherwise(F.get("ids", F.col("i")))
    return rows.select("conv_id", F.col("t.d").alias("d"), F.get("ids", F.col("i") + 1).alias("id"), parent.alias("parent"),
                       F.col("t.bytes").alias("bytes"))


def _children(tree: DataFrame) -> DataFrame:
    return tree.where("parent is not null").groupBy("parent").agg(F.count(F.lit(1)).alias("n"))


def _raked(live: DataFrame) -> DataFrame:
    """The inner nodes after their leaf children are gone, with ``n`` children left and, where
    one is left, that ``child`` and the weight of its edge (``cx``, ``cy``)."""
    leaf, inner = F.col("n") == 0, F.col("n") > 0
    zero = F.lit(0).cast("long")
    gone = live.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
        *(F.sum(F.when(leaf, F.col(v) + F.col(w)).otherwise(zero)).alias(f"r{v}") for v, w in (("x", "wx"), ("y", "wy"))),
        F.count_if(inner).alias("rest"), F.max(F.when(inner, F.col("id"))).alias("child"),
        *(F.sum(F.when(inner, F.col(w))).alias(f"c{v}") for v, w in (("x", "wx"), ("y", "wy"))))
    rest = F.coalesce("rest", zero)
    return live.where("n > 0").join(gone, "id", "left").select(
        "id", "parent", "path", "depth", *((F.col(v) + F.coalesce(f"r{v}", zero)).alias(v) for v in "xy"), "wx", "wy",
        rest.alias("n"), *(F.when(rest == 1, F.col(c)).alias(c) for c in ("child", "cx", "cy")))


def _runs(unary: DataFrame) -> DataFrame:
    """Marks what an even round does with the nodes that have one child: ``gone`` nodes
    leave, with ``below`` and what lies between (``ax``, ``ay``); the ``last`` node of a run
    hands ``below`` over to the run's ``top`` with the run's sums (``px``, ``py``)."""
    part = Window.partitionBy("path", F.floor(F.col("depth") / RUN)).orderBy("depth")
    linked = F.coalesce(F.col("parent") == F.lag("id").over(part), F.lit(False))
    runs = unary.withColumn("joined", linked).withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(part))
    run = Window.partitionBy("path", F.floor(F.col("depth") / RUN), "run").orderBy("depth")
    whole, after = (run.rowsBetween(a, Window.unboundedFollowing) for a in (Window.unboundedPreceding, 1))
    zero = F.lit(0).cast("long")
    return runs.select(
        *unary.columns, F.col("joined").alias("gone"), F.last("child").over(whole).alias("below"),
        *((F.last(f"c{v}").over(whole) + F.col(v) + F.coalesce(F.sum(F.col(v) + F.col(f"w{v}")).over(after), zero)).alias(f"a{v}") for v in "xy"),
        (F.col("joined") & F.lead("id").over(run).isNull()).alias("last"), F.first("id").over(whole).alias("top"),
        *(F.sum(F.when(F.col("joined"), F.col(v) + F.col(f"w{v}")).otherwise(zero)).over(whole).alias(f"p{v}") for v in "xy"))


def _mates(unary: DataFrame, turn: int) -> DataFrame:
    """The same marks for an odd round: a node that drew 1 leaves if its parent has one child
    too and drew 0."""
    drew = lambda c: F.xxhash64(c, F.lit(turn)).bitwiseAND(1)
    parents = unary.where(drew("id") == 0).select(F.col("child").alias("id"), F.col("id").alias("top"))
    gone = F.col("top").isNotNull() & (drew("id") == 1)
    return unary.join(parents, "id", "left").select(
        *unary.columns, gone.alias("gone"), F.col("child").alias("below"),
        *((F.col(f"c{v}") + F.col(v)).alias(f"a{v}") for v in "xy"), gone.alias("last"), "top",
        *((F.col(v) + F.col(f"w{v}")).alias(f"p{v}") for v in "xy"))


def subtree_sums(tree: DataFrame) -> DataFrame:
    """``tree``(id, parent, path, depth, x, y) -> (id, x, y): sums over each node's subtree.

    One root (parent null); (path, depth) is unique. An empty tree gives no rows.
    """
    zero = F.lit(0).cast("long")
    counts = _children(tree).withColumnRenamed("parent", "id")
    live = stage(tree.join(counts, "id", "left").select(
        "id", "parent", "path", "depth", "x", "y", zero.alias("wx"), zero.alias("wy"), F.coalesce("n", zero).alias("n")))
    done: list[tuple[DataFrame, DataFrame]] = []  # of each round: raked totals, spliced nodes
    for turn in itertools.count():
        if live.where("n > 0").isEmpty():
            break
        inner = stage(_raked(live))
        chain = F.col("parent").isNotNull() & (F.col("n") == 1)
        unary, others = inner.where(chain), inner.where(~F.coalesce(chain, F.lit(False)))
        marked = stage(_mates(unary, turn) if turn % 2 else _runs(unary))
        done.append((live.where("n = 0").select("id", "x", "y"), marked.where("gone").select("id", "below", "ax", "ay")))
        moves = marked.where("last").select(F.col("below").alias("id"), F.col("top").alias("up"), "px", "py")
        columns = ["id", "parent", "path", "depth", "x", "y", "wx", "wy", "n"]
        left = others.select(columns).unionByName(marked.where("not gone").select(columns)).join(moves, "id", "left")
        live = stage(left.select("id", F.coalesce("up", "parent").alias("parent"), "path", "depth", "x", "y",
                                 *((F.col(f"w{v}") + F.coalesce(f"p{v}", zero)).alias(f"w{v}") for v in "xy"), "n"))
    total = live.select("id", "x", "y")
    for raked, spliced in reversed(done):
        again = spliced.join(total.withColumnsRenamed({"id": "below"}), "below").select(
            "id", *((F.col(v) + F.col(f"a{v}")).alias(v) for v in "xy"))
        total = stage(total.unionByName(raked).unionByName(again))
    return total


def _id_lists(ends: DataFrame) -> DataFrame:
    """``ends``(id, conv_id) -> (id, ends_sha256) of the ascending, comma-joined ids."""
    ordered = ends.repartitionByRange("id", "conv_id").sortWithinPartitions("id", "conv_id")
    pieces_of = pa.schema([("id", pa.binary()), ("at", pa.int64()), ("piece", pa.string())])

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[bytes, object]]:
        for batch in batches:
            for a in range(0, batch.num_rows, PIECE):
                part = batch.slice(a, PIECE)
                yield from zip(part.column(0).to_pylist(), zip(*(c.to_pylist() for c in part.columns[1:])))

    def pieces(batches):
        for node, rows in itertools.groupby(runs(batches), key=lambda r: r[0]):
            ids = (c for _, (c,) in rows)
            while some := list(itertools.islice(ids, PIECE)):
                yield pa.RecordBatch.from_pylist([{"id": node, "at": some[0], "piece": ",".join(map(str, some))}], pieces_of)

    def hashes(batches):
        out = pa.schema([("id", pa.binary()), ("ends_sha256", pa.string())])
        for node, rows in itertools.groupby(runs(batches), key=lambda r: r[0]):
            sha = hashlib.sha256()
            for k, (_, (_, piece)) in enumerate(rows):
                sha.update(("," if k else "").encode() + piece.encode())
            yield pa.RecordBatch.from_pylist([{"id": node, "ends_sha256": sha.hexdigest()}], out)

    cut = ordered.mapInArrow(pieces, "id binary, at long, piece string")
    return cut.repartition("id").sortWithinPartitions("id", "at").mapInArrow(hashes, "id binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of each node of the trie of the rebuilt conversations."""
    turns, lengths = rebuilt(conversations)
    members = stage(prefixes(turns, lengths))
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    nodes = members.groupBy("id").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("d").alias("depth"),
                                      F.max("parent").alias("parent"), F.max("bytes").alias("bytes"))
    root = lengths.groupBy(_root().alias("id")).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).select(
        "*", zero.alias("depth"), F.lit(None).cast("binary").alias("parent"), zero.alias("bytes"))
    nodes = nodes.unionByName(root)
    counts = _children(nodes).withColumnsRenamed({"parent": "id", "n": "n_children"})
    nodes = stage(nodes.join(counts, "id", "left").withColumn("n_children", F.coalesce("n_children", zero)))
    sums = subtree_sums(nodes.select("id", "parent", F.col("conv_id").alias("path"), "depth", F.when(F.col("n_children") == 0, one).otherwise(zero).alias("x"),
                                     ((F.col("n_convs") - 1) * F.col("bytes")).alias("y")))
    last = members.join(lengths, "conv_id").where("d = n_turns").select("id", "conv_id")
    ends = _id_lists(last.unionByName(lengths.where("n_turns = 0").select(_root().alias("id"), "conv_id")))
    total = nodes.agg(F.sum("n_children")).first()[0] or 0
    parents = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    found = join_by_share(nodes, parents, "parent", "n_children", total).join(sums, "id").join(ends, "id", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("x").alias("n_leaves"),
                        F.col("y").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
