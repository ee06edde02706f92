"""The trie of conversations that share beginnings: a node for each distinct sequence of first turns, owned by its smallest member.

If a conversation is the smallest member of a node, it is so of all deeper nodes that it passes. Each conversation
therefore owns a chain from some depth on, and a trie of any size is a tree of chains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terravela.plans.lineage import broadcast_below, stored

#: Turns of a conversation that one window or one row's array holds; longer ones are cut, and the parts' sums carried.
PART = 1024
#: Rows of a broadcast table, some MB.
BROADCAST_ROWS = 100_000
WORDS = ("w0", "w1", "w2", "w3")


def _carried(rows: DataFrame, key: str, part: str, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """rows with each of sums replaced by its running sum within key, over (part, order): a window for each part, and what earlier parts add."""
    way = F.desc if descending else F.asc
    inner = Window.partitionBy(key, part).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumns({c: F.sum(c).over(inner) for c in sums})
    totals = rows.groupBy(key, part).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    outer = Window.partitionBy(key).orderBy(way(part)).rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    before = totals.withColumns({f"_{c}": F.sum(f"_{c}").over(outer) for c in sums}).where(F.col(f"_{sums[0]}").isNotNull())
    given = local.join(broadcast_below(stored(before), BROADCAST_ROWS), [key, part], "left")
    return given.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums}).drop(*[f"_{c}" for c in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, h0, h1, n_bytes): the turns of each conversation from 0, with hashes of role and text and the text's bytes.

    Turns are ordered by turn, null first, and those of equal turn by their hashes; null role or text counts as empty. Rows without a
    conv_id take no part. Rows are dealt by range, so that a long conversation is ranked in several tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    both = F.md5(F.concat_ws("\u0000", role, F.length(role).cast("string"), text).cast("binary"))
    half = lambda k: F.conv(F.substring(both, k, 15), 16, 10).cast("long")  # noqa: E731  60 bits
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", half(1).alias("h0"), half(17).alias("h1"), F.octet_length(text).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", F.asc_nulls_first("turn"), "h0", "h1", "salt"]
    dealt = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).drop("salt"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "h0", "h1"))
    counts = dealt.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = counts.withColumn("n", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).where("n IS NOT NULL")
    # A cut between two tasks adds one row at most.
    placed = dealt.withColumn("pos", rank.cast("long") - 1).join(broadcast_below(stored(before), BROADCAST_ROWS), ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("pos") + F.coalesce("n", F.lit(0))).alias("pos"), "h0", "h1", "n_bytes")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as another: (conv_id, pos, h0, h1, n_bytes), and (conv_id, n_turns) of all, turnless ones too.

    A conversation c begins with the first h turns of c - c % 5 (all if fewer, none if it is absent), h the CRC-32 of its
    decimal id modulo 9, and goes on with its own turns after its first h.
    """
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("long")
    base = F.col("conv_id") - F.col("conv_id") % 5
    plan = lengths.select("conv_id", "n", h.alias("h"), base.alias("base")).join(lengths.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    plan = stored(plan.withColumn("g", F.least("h", F.coalesce("n_base", F.lit(0)))))
    own = turns.join(plan.select("conv_id", "h", "g"), "conv_id").where("pos >= h").select("conv_id", (F.col("pos") - F.col("h") + F.col("g")).alias("pos"), "h0", "h1", "n_bytes")
    heads = turns.where("pos < 8").withColumnRenamed("conv_id", "base")  # eight turns of a base at most, for five conversations
    given = plan.where("g > 0").select("conv_id", "base", "g").join(heads, "base").where("pos < g").select("conv_id", "pos", "h0", "h1", "n_bytes")
    return own.unionByName(given), plan.select("conv_id", (F.col("g") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, w0..w3, n_bytes): a digest of the first depth turns, sums of hashes of turn and place in 32-bit words.

    Sums can be carried from part to part, so that no long conversation is read by one task. Two different prefixes
    have equal digests with a chance of about 2^-128.
    """
    one, two = F.xxhash64("h0", "h1", "pos"), F.xxhash64("pos", "h1", F.lit(7), "h0")
    low, high = lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)), lambda x: F.shiftrightunsigned(x, 32)
    words = turns.select("conv_id", "pos", F.floor(F.col("pos") / PART).alias("part"), low(one).alias("w0"), high(one).alias("w1"), low(two).alias("w2"), high(two).alias("w3"), "n_bytes")
    return _carried(words, "conv_id", "part", "pos", list(WORDS)).select("conv_id", (F.col("pos") + 1).alias("depth"), *WORDS, "n_bytes")


def owned_from(prefixes: DataFrame, lengths: DataFrame, minima: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first, above): the first depth whose node a conversation owns, n_turns + 1 if none, and who owns the node above it.

    A binary search of all conversations at once: each round looks their middle depths up in minima(depth, w0..w3, owner), which holds
    shared prefixes only, as others are their conversation's own. Long conversations find the part of PART depths
    first, by its last digest, then the depth in it; an array of a part's digests is all that moves with them.
    """
    digest = F.struct(*WORDS)
    parts = prefixes.withColumn("part", F.floor((F.col("depth") - 1) / PART)).groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("depth", digest.alias("d")))).alias("at"))
    parts = stored(parts.withColumns({"last": F.element_at("at", -1)["depth"], "d": F.element_at("at", -1)["d"]}))
    # lo: the deepest part known to end unowned, hi: the first known to end owned.
    state = stored(lengths.select("conv_id", "n_turns", F.lit(-1).cast("long").alias("lo"), F.ceil(F.col("n_turns") / PART).cast("long").alias("hi"), F.lit(None).cast("long").alias("above")))
    owner = F.coalesce("owner", F.col("conv_id"))

    def narrowed(probed: DataFrame, columns: list[str]) -> DataFrame:
        found = probed.join(minima, ["depth", *WORDS], "left")
        mine = owner == F.col("conv_id")
        step = {"lo": F.when(F.col("mid").isNull() | mine, F.col("lo")).otherwise(F.col("mid")), "hi": F.when(F.col("mid").isNotNull() & mine, F.col("mid")).otherwise(F.col("hi")), "above": F.when(F.col("mid").isNull() | mine, F.col("above")).otherwise(F.col("owner"))}
        return stored(found.withColumns(step).select(*columns))

    # Only parts that aren't the last are searched: the last one is looked into in any case.
    state = state.withColumn("hi", F.greatest(F.col("hi") - 1, F.lit(0)))
    while state.where("hi - lo > 1").limit(1).count():
        mid = F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi")) / 2))
        ends = parts.select("conv_id", F.col("part").alias("mid"), F.col("last").alias("depth"), *[F.col(f"d.{w}").alias(w) for w in WORDS])
        state = narrowed(state.withColumn("mid", mid).join(ends, ["conv_id", "mid"], "left"), ["conv_id", "n_turns", "lo", "hi", "above"])
    inside = state.withColumn("part", F.col("hi")).join(parts.select("conv_id", "part", "at"), ["conv_id", "part"], "left")
    state = stored(inside.select("conv_id", "n_turns", "at", "above", (F.col("part") * PART).alias("start"), F.when(F.col("part") == 0, -1).otherwise(F.col("part") * PART).cast("long").alias("lo"), F.least((F.col("part") + 1) * PART + 1, F.col("n_turns") + 1).alias("hi")))
    while state.where("hi - lo > 1").limit(1).count():
        mid = F.when(F.col("hi") - F.col("lo") > 1, F.floor((F.col("lo") + F.col("hi")) / 2))
        held = F.when(F.col("mid") > F.col("start"), F.get("at", (F.col("mid") - F.col("start") - 1).cast("int"))["d"])
        probed = state.withColumn("mid", mid).withColumn("held", held)
        # The root has no turn: its sums are 0.
        probed = probed.select("*", F.col("mid").alias("depth"), *[F.when(F.col("mid") == 0, F.lit(0)).otherwise(F.col(f"held.{w}")).cast("long").alias(w) for w in WORDS])
        state = narrowed(probed, ["conv_id", "n_turns", "at", "above", "start", "lo", "hi"])
    return state.select("conv_id", "n_turns", F.col("hi").alias("first"), "above")


def _subtotals(chains: DataFrame, sums: list[str]) -> DataFrame:
    """chains(conv_id, above, sums) -> (conv_id, sums) over each chain and all below it; rounds grow with the logarithm of the height."""
    state = stored(chains.select("conv_id", F.col("above").alias("up"), *sums))
    while state.where("up IS NOT NULL").limit(1).count():
        given = state.where("up IS NOT NULL").groupBy(F.col("up").alias("conv_id")).agg(*[F.sum(c).alias(f"_{c}") for c in sums])
        over = state.select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        state = stored(state.join(given, "conv_id", "left").join(over, "up", "left").select("conv_id", F.col("next").alias("up"), *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums]))
    return state.select("conv_id", *sums)


def joined_ids(members: DataFrame, piece_bytes: int = 1 << 16) -> DataFrame:
    """members(owner, depth, conv_id) -> (owner, depth, ends_sha256): the SHA-256 of a node's ascending ids, joined by commas.

    Ids are sorted over all tasks, which join them in pieces of some piece_bytes; a node's pieces then pass one digest
    in order, one at a time.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held, first, size, out = None, [], 0, 0, []
        for batch in batches:
            for owner, depth, conv in zip(*(c.to_pylist() for c in batch.columns)):
                if (owner, depth) != node or size >= piece_bytes:
                    if held:
                        out.append((*node, first, ",".join(held)))
                    node, held, first, size = (owner, depth), [], conv, 0
                held.append(str(conv))
                size += len(held[-1]) + 1
            yield packed(out)
            out = []
        if held:
            yield packed([(*node, first, ",".join(held))])

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["owner", "depth", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, None, []
        done = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.string())], ["owner", "depth", "ends_sha256"])
        for batch in batches:
            for owner, depth, ids in zip(*(batch.column(n).to_pylist() for n in ("owner", "depth", "ids"))):
                if (owner, depth) == node:
                    sha.update(b",")
                else:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (owner, depth), hashlib.sha256()
                sha.update(ids.encode())
            yield done()
            out = []
        if node:
            out = [(*node, sha.hexdigest())]
            yield done()

    order = ["owner", "depth", "conv_id"]
    joined = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pieces, "owner long, depth long, first long, ids string")
    return joined.repartition("owner", "depth").sortWithinPartitions("owner", "depth", "first").mapInArrow(digests, "owner long, depth long, ends_sha256 string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row for each node of the trie of rebuilt conversations.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); conv_id is the smallest member, n_leaves and
    saved_tokens cover the node and all below it, saved_tokens adds (n_convs - 1) times the bytes of a node's last text. Null ids
    take no part, equal turns are ordered by a hash of role and text, repeated rows are turns of their own, other columns are
    ignored, and without a conversation there is no node, the root included.
    """
    turns, lengths = rebuilt_turns(stored(numbered_turns(conversations)))
    lengths = stored(lengths)
    prefixes = stored(prefix_digests(turns))
    minima = stored(prefixes.groupBy("depth", *WORDS).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("n_bytes").alias("n_bytes")))
    root = lengths.agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(w) for w in WORDS], "owner", "n_convs", F.lit(0).cast("long").alias("n_bytes"))
    minima = minima.unionByName(root)
    shared = broadcast_below(stored(minima.where("n_convs > 1").select("depth", *WORDS, "owner")), BROADCAST_ROWS)
    chains = stored(owned_from(prefixes, lengths, shared))
    held = chains.where("first <= n_turns")
    members = chains.select(F.when(F.col("first") <= F.col("n_turns"), F.col("conv_id")).otherwise(F.col("above")).alias("owner"), F.col("n_turns").alias("depth"), "conv_id")
    none = {"n_convs": "long", "cost": "long", "parent": "long", "head": "int", "tail": "int", "attached": "long", "ends": "string"}
    row = lambda df, owner, depth, **given: df.select(F.col(owner).cast("long").alias("conv_id"), F.col(depth).cast("long").alias("depth"), *[F.expr(given.get(c, "null")).cast(t).alias(c) for c, t in none.items()])
    facts = [
        row(minima, "owner", "depth", n_convs="n_convs", cost="(n_convs - 1) * n_bytes"), row(held, "conv_id", "first", parent="above", head="1"), row(held, "conv_id", "n_turns", tail="1"),
        row(held.where("first > 0").select("above", (F.col("first") - 1).alias("at")), "above", "at", attached="1"), row(joined_ids(members), "owner", "depth", ends="ends_sha256"),
    ]
    every = facts[0].unionByName(facts[1]).unionByName(facts[2]).unionByName(facts[3]).unionByName(facts[4])
    nodes = stored(every.groupBy("conv_id", "depth").agg(F.max("n_convs").alias("n_convs"), F.max("cost").alias("cost"), F.max("parent").alias("parent"), F.max("head").alias("head"), F.coalesce(F.max("tail"), F.lit(0)).alias("tail"), F.coalesce(F.sum("attached"), F.lit(0)).alias("attached"), F.max("ends").alias("ends")))
    leaf = ((F.col("tail") == 1) & (F.col("attached") == 0)).cast("long")
    own = nodes.groupBy("conv_id").agg(F.sum(leaf).alias("leaves"), F.sum("cost").alias("cost"))
    totals = _subtotals(own.join(held.select("conv_id", "above"), "conv_id"), ["leaves", "cost"])
    below = totals.join(held.where("first > 0").select("conv_id", "above", (F.col("first") - 1).alias("depth")), "conv_id").groupBy(F.col("above").alias("conv_id"), "depth").agg(F.sum("leaves").alias("more_leaves"), F.sum("cost").alias("more_cost"))
    valued = nodes.join(below, ["conv_id", "depth"], "left").withColumns({"n_leaves": leaf + F.coalesce("more_leaves", F.lit(0)), "saved_tokens": F.col("cost") + F.coalesce("more_cost", F.lit(0)), "part": F.floor(F.col("depth") / PART)})
    summed = _carried(valued, "conv_id", "part", "depth", ["n_leaves", "saved_tokens"], descending=True)
    parent = F.when(F.col("head") == 1, F.col("parent")).otherwise(F.col("conv_id"))
    return summed.select(
        "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", (F.col("attached") + 1 - F.col("tail")).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")
    )
