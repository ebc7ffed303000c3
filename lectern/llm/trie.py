"""The trie of conversation prefixes, by partition refinement.

All conversations start in one class, the root. A class is split by its members' next turns; a class of one member is
retired and its remaining turns follow as a chain without branches. One Spark round splits the active classes by
several turns at once, and each round takes more turns than the one before, so a deep common prefix costs few rounds.
No class is ever collected: classes meet as chained digests, and counts are combined before they travel. The fold back
adds what lies below a node along the conversation that stands first in it.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns by which the first round splits, and the most that a later one takes.
FIRST_STRIDE, LAST_STRIDE = 8, 64
#: Bytes of a turn's digest and of a class's name.
NAME_BYTES = 16
NOTHING = hashlib.sha256(b"").hexdigest()


def _name(column):
    return F.substring(F.unhex(F.sha2(column, 256)), 1, NAME_BYTES)


def ordered(conversations: DataFrame) -> DataFrame:
    """conv_id, part, pos (a turn's place in its conversation, from 0), digest (of role and text) and tokens (code points).

    Turns stand by turn (null first), ties by role, then text. A null role or text is empty; rows without conv_id
    belong to no conversation and go. A conversation of any length may lie over many partitions (part).
    """
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    dealt = rows.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 24)).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    digest = _name(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"))
    placed = cut(dealt.select("conv_id", digest.alias("digest"), F.length("text").cast("long").alias("tokens"), F.monotonically_increasing_id().alias("place")))
    placed = placed.withColumn("part", F.shiftright("place", 33).cast("int"))
    runs = placed.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(runs, ["conv_id", "part"]).select("conv_id", "part", (F.col("place") + F.col("shift")).alias("pos"), "digest", "tokens")


def with_shared_heads(turns: DataFrame, period: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): each conversation's first h turns are those of the conversation at the start of its hundred.

    h is the unsigned crc32 of the decimal conv_id modulo most. Of a head with fewer turns all are taken, of an absent
    one none; the conversation's own turns after its first h follow.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    runs = turns.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    sizes = runs.groupBy("conv_id").agg(F.sum("n").alias("n"))
    heads = sizes.select(F.col("conv_id").alias("head"), F.col("n").alias("there"))
    convs = sizes.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % period).alias("head")).join(heads, "head", "left")
    convs = convs.withColumn("lead", F.least("h", F.coalesce("there", F.lit(0)))).drop("there")
    first = turns.where(F.col("pos") < most - 1).select(F.col("conv_id").alias("head"), "pos", "digest", "tokens")
    lead = convs.where("h > 0").join(first, "head").where("pos < h").select("conv_id", "pos", "digest", "tokens")
    known = runs.select("conv_id", "part").join(convs.select("conv_id", "h", "lead"), "conv_id")
    own = turns.where(F.col("pos") >= h).join(known, ["conv_id", "part"]).select("conv_id", (F.col("pos") - F.col("h") + F.col("lead")).alias("pos"), "digest", "tokens")
    return sizes.select("conv_id"), lead.unionByName(own)


def refine(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(steps, nodes): steps hold conv_id, depth, node, parent, tokens; nodes the same once a node, with its first conv_id and n.

    Steps below the node at which a conversation is alone may be missing. The root is a node of depth 0 without parent.
    """
    root = F.lit(bytes(NAME_BYTES))
    nowhere = F.lit(None).cast("binary")
    steps = [cut(convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), nowhere.alias("parent"), F.lit(0).cast("long").alias("tokens")))]
    nodes = [steps[0].groupBy("depth", "node", "parent", "tokens").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"))]
    active = steps[0].select("conv_id", "node") if len(convs.take(2)) > 1 else None
    depth, stride = 0, FIRST_STRIDE
    while active is not None:
        now = turns.where((F.col("pos") >= depth) & (F.col("pos") < depth + stride)).join(active, "conv_id")
        lists = now.groupBy("conv_id", "node").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "tokens"))).alias("next"))
        chain = F.aggregate("next", F.array("node"), lambda seen, x: F.concat(seen, F.array(_name(F.concat(F.element_at(seen, -1), x["digest"])))))
        chained = lists.select("conv_id", "next", chain.alias("chain")).select("conv_id", "chain", F.posexplode("next").alias("i", "x"))
        step = cut(chained.select("conv_id", (F.col("x.pos") + 1).alias("depth"), F.col("chain")[F.col("i") + 1].alias("node"), F.col("chain")[F.col("i")].alias("parent"), F.col("x.tokens").alias("tokens")))
        node = cut(step.groupBy("depth", "node", "parent", "tokens").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")))
        steps.append(step)
        nodes.append(node)
        depth, stride = depth + stride, min(2 * stride, LAST_STRIDE)
        retired = node.where("n = 1").select("conv_id").distinct()
        active = cut(step.where(F.col("depth") == depth).select("conv_id", "node").join(retired, "conv_id", "left_anti"))
        if active.isEmpty():
            active = None
    for more in steps[1:]:
        steps[0] = steps[0].unionByName(more)
    for more in nodes[1:]:
        nodes[0] = nodes[0].unionByName(more)
    return steps[0], nodes[0]


def _joined(batches):
    """Runs of one node in sorted rows as (node, first conv_id, decimal ids joined by commas)."""
    for batch in batches:
        names, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        begins = [i for i in range(len(ids)) if i == 0 or names[i] != names[i - 1]]
        texts = [",".join(map(str, ids[a:b])) for a, b in zip(begins, [*begins[1:], len(ids)])]
        yield pa.record_batch([pa.array([names[i] for i in begins], pa.binary()), pa.array([ids[i] for i in begins], pa.int64()), pa.array(texts, pa.string())], ["node", "conv_id", "ids"])


def _hashed(batches):
    """The SHA-256 of each node's runs in order, whatever number of batches they come in."""
    node, digest = None, None
    for batch in batches:
        done = []
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name == node:
                digest.update(b"," + ids.encode())
                continue
            if digest is not None:
                done.append((node, digest.hexdigest()))
            node, digest = name, hashlib.sha256(ids.encode())
        yield pa.record_batch([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"])
    if digest is not None:
        yield pa.record_batch([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """node and ends_sha256 of (node, conv_id): ids join into runs where they lie, and one task reads a node's runs as a stream."""
    runs = cut(ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_joined, "node binary, conv_id long, ids string"))
    return runs.repartition("node").sortWithinPartitions("node", "conv_id").mapInArrow(_hashed, "node binary, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row for each distinct sequence of first turns; a node's text is turn depth - 1 of conversation conv_id.

    convs: distinct conv_id; turns: conv_id, pos (gapless from 0), digest, tokens. Conversations without turns are
    members of the root alone. Without conversations there are no rows.
    """
    turns = cut(turns)
    steps, nodes = refine(convs, turns)
    nodes = cut(nodes)
    retired = nodes.where("n = 1").groupBy("conv_id").agg(F.min("depth").alias("retired"))
    lengths = convs.join(turns.groupBy("conv_id").agg(F.count("*").alias("length")), "conv_id", "left").select("conv_id", F.coalesce("length", F.lit(0)).alias("length"))
    convs = cut(lengths.join(retired, "conv_id", "left"))

    many = nodes.where("n > 1")
    # a child is a node below a class of several, or the first of a chain: the steps further down the chain hang on retired nodes
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    many = cut(many.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))

    shared = steps.select("conv_id", "depth", "node").join(convs, "conv_id").where("retired is null or depth < retired")
    led = many.select("conv_id", "depth", ((F.col("n") - 1) * F.col("tokens")).alias("spared"), (F.col("n_children") == 0).cast("long").alias("leaf"))
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth"))
    whole = Window.partitionBy("conv_id")
    folded = shared.join(led, ["conv_id", "depth"], "left").select(
        "node",
        F.sum(F.coalesce("spared", F.lit(0))).over(below).alias("spared"),
        F.when(F.col("retired").isNotNull(), F.lit(1)).otherwise(F.max(F.coalesce("leaf", F.lit(0))).over(whole)).alias("leaf"),
    )
    sums = folded.groupBy("node").agg(F.sum("spared").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    digests = ends_digests(shared.where("depth = length").select("node", "conv_id"))
    above = many.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    inner = many.join(above, "parent", "left").join(sums, "node").join(digests, "node", "left")
    inner = inner.select("conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))

    begins = nodes.where("n = 1").join(retired, "conv_id").where("depth = retired").join(above, "parent", "left").select("conv_id", "depth", "parent_conv_id")
    alone = convs.where("retired is not null")
    later = turns.join(alone, "conv_id").where(F.col("pos") + 1 > F.col("retired")).select("conv_id", (F.col("pos") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "length")
    chains = begins.join(alone.select("conv_id", "length"), "conv_id").unionByName(later)
    last = F.col("depth") == F.col("length")
    tails = chains.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )
    return inner.unionByName(tails)
