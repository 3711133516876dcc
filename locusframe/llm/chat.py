"""Chat conversations as a prefix tree: shared turns are emitted once, with positions and attention intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusframe.llm._common import hinted, written
from locusframe.session import importable

#: A turn is OPEN role MIDDLE text CLOSE. No text holds one of these, or another common control string, unescaped.
OPEN, MIDDLE, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
CONTROL = r"([<\[])(/?s>|/?ROLE\]|/?INST\]|/?SYS\]|</?SYS>>|\|)"
#: Doubled where a text has it; single after the first character of a control string, which so is one no more.
ESCAPE = "␛"
#: One row for each range of conversations is broadcast up to this many.
BROADCAST_RANGES = 100_000
#: A conversation with more than one in so many of all copies is dealt out in pieces; there are fewer of these than that.
SHARES = 500


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)), CONTROL, f"$1{ESCAPE}$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


@dataclass
class PrefixTree:
    """``nodes``: (leaf, depth, node, start, stop, position, role, formatted, loss_start, loss_stop, attends, users), one for
    each distinct prefix of turns: formatted text at [start, stop) of the emitted stream, depth first; the position id
    of its first character; the stretch of the stream that counts for the loss (the text of an assistant turn, else
    empty); the stretches of its ancestors that it attends to besides itself; the distinct conversation (leaf) that
    emits it, and how many go through it. ``conversations``: (conv_id, leaf, n_turns, shared, nodes: start of each turn's
    node; those beyond ``shared`` are emitted by the leaf itself). Characters (code points) stand for tokens.
    """

    nodes: DataFrame
    conversations: DataFrame


def _common_prefix(a: Column, b: Column) -> Column:
    """How many first elements two arrays have in common."""
    differ = F.transform(F.arrays_zip(a.alias("x"), b.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"]))
    first = F.array_position(differ, True).cast("int")
    return F.when(b.isNull(), 0).when(first > 0, first - 1).otherwise(F.least(F.size(a), F.size(b)))


def _merged(spans: Column) -> Column:
    """Ordered stretches; those that touch become one."""
    step = lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["stop"] == x["start"]),
        F.concat(
            F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), x["stop"].alias("stop"))),
        ),
    ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["stop"].alias("stop")))))
    return F.aggregate(spans, F.array().cast("array<struct<start:bigint,stop:bigint>>"), step)


def _digest(*parts: Column) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _chained(convs: DataFrame) -> DataFrame:
    """Adds path (the chained keys of an array of digests) and places (sums of sizes before each turn, and of all) to rows
    (conv_id, own, sizes), in one pass over each row's turns."""
    importable(convs.sparkSession)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            paths, places = [], []
            for own, sizes in zip(part["own"], part["sizes"], strict=True):
                key, path = b"", []
                for digest in own.as_py():
                    key = hashlib.md5(key + digest).digest()
                    path.append(key)
                paths.append(path)
                places.append(np.concatenate([[0], np.cumsum(sizes.values.to_numpy(), dtype=np.int64)]))
            added = [pa.array(paths, pa.list_(pa.binary())), pa.array(places, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part["conv_id"], part["own"], *added], ["conv_id", "own", "path", "places"])

    return convs.mapInArrow(run, f"conv_id {dict(convs.dtypes)['conv_id']}, own array<binary>, path array<binary>, places array<bigint>")


def to_copies(copies: DataFrame, leaves: DataFrame) -> DataFrame:
    """Copies (conv_id, leaf, ...) with the columns of their leaf, each leaf once in ``leaves``.

    Copies of a frequent conversation go to several tasks, and its leaf to each of them.
    """
    total = copies.count()
    counts = copies.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") * SHARES > total)
    frequent = F.broadcast(written(counts.select("leaf", F.least("n", F.ceil(F.col("n") * SHARES / F.lit(total))).alias("pieces"))))
    pieces = F.coalesce("pieces", F.lit(1).cast("long"))
    left = copies.join(frequent, "leaf", "left").withColumn("piece", F.pmod(F.xxhash64("conv_id"), pieces)).drop("pieces")
    right = leaves.join(frequent, "leaf", "left").withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))).drop("pieces")
    return left.join(right, ["leaf", "piece"]).drop("piece")


def build_tree(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: str = "assistant"
) -> PrefixTree:
    """Merges conversations that share their first turns.

    Turns are ordered by ``turn`` (then role and the text's md5, for equal numbers; nulls first); null roles and texts
    are empty; repeated rows are turns of their own; rows with a null id make one conversation. Other columns are
    ignored; no rows give an empty tree. A prefix's key is a chained md5 over its formatted turns. Distinct
    conversations, sorted by their chains of keys, stand next to those they share most with: each emits the nodes that
    its predecessor lacks, which is depth-first order. The sort is by Spark's sampled ranges, so a first turn that a
    third of the conversations share is no single task; running sums within the ranges, plus the sums of earlier
    ranges, give the places. Copies of a conversation add nothing to the stream.

    All that is done on digests and lengths, in time that grows with the turns of a conversation: it is one row of about 50
    bytes a turn, and must fit in a task. Texts are shuffled once, by digest, to the nodes that they belong to.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    before = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(MIDDLE))
    turns = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("t"), plain(role).alias("role"), plain(text).alias("text"))
    turns = turns.withColumns({"before": before, "inside": escape(F.col("text"))}).withColumn("formatted", F.concat("before", "inside", F.lit(CLOSE)))
    one = F.struct("t", "role", F.md5("text").alias("m"), _digest(F.col("formatted")).alias("h"), F.length("formatted").cast("long").alias("size"))
    convs = turns.select("conv_id", one.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    own = F.transform("x", lambda x: x["h"])
    convs = _chained(convs.select("conv_id", own.alias("own"), F.transform("x", lambda x: x["size"]).alias("sizes")))
    convs = written(convs.withColumn("leaf", F.element_at("path", -1)))

    # Copies go by the leaf's key, which stands for all turns.
    paths = convs.groupBy("leaf").agg(F.min(F.struct("path", "own", "places")).alias("x")).select("leaf", "x.*")
    ranged = written(paths.repartitionByRange("path").withColumn("range", F.spark_partition_id()))
    in_range = Window.partitionBy("range").orderBy("path")
    ends = ranged.groupBy("range").agg(F.max("path").alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("range"))).select("range", "before")
    emitted = ranged.join(hinted(written(ends), BROADCAST_RANGES), "range").withColumn(
        "shared", _common_prefix(F.col("path"), F.coalesce(F.lag("path").over(in_range), "before"))
    )
    emitted = emitted.withColumn("skipped", F.get("places", F.col("shared"))).withColumn("new", F.element_at("places", -1) - F.col("skipped"))
    upto = F.sum("new").over(in_range.rowsBetween(Window.unboundedPreceding, 0))
    emitted = written(emitted.withColumn("upto", upto))
    sums = emitted.groupBy("range").agg(F.sum("new").alias("sum"))
    offsets = sums.withColumn("offset", F.sum("sum").over(Window.orderBy("range")) - F.col("sum")).select("range", "offset")
    placed = emitted.join(hinted(written(offsets), BROADCAST_RANGES), "range").withColumn("base", F.col("offset") + F.col("upto") - F.col("new"))

    # A node's place in the stream, from the conversation that emits it.
    turn_at = F.arrays_zip("path", "own", F.slice("places", 1, F.size("path")).alias("position"), F.slice("places", 2, F.size("path")).alias("end"))
    each = placed.select("leaf", "base", "shared", "skipped", F.posexplode(turn_at).alias("i", "z")).where("i >= shared")
    start = F.col("base") + F.col("z.position") - F.col("skipped")
    slim = written(
        each.select(
            "leaf", (F.col("i") + 1).alias("depth"), F.col("z.path").alias("node"), F.col("z.own").alias("own"), start.alias("start"),
            (start + F.col("z.end") - F.col("z.position")).alias("stop"), F.col("z.position").alias("position"), "base", "shared",
        )
    )

    # The whole path of each distinct conversation, what its new nodes attend to, and how many go through a node.
    steps = placed.select("leaf", "shared", F.posexplode("path").alias("i", "node"))
    spans = steps.join(slim.select("node", "start", "stop"), "node")
    walked = written(spans.groupBy("leaf", "shared").agg(F.sort_array(F.collect_list(F.struct("i", "start", "stop"))).alias("spans")))
    above = walked.select("leaf", _merged(F.slice("spans", 1, F.col("shared"))).alias("above"))
    users = steps.groupBy("node").agg(F.count("*").alias("users"))
    ahead = F.when(F.col("start") > F.col("base"), F.array(F.struct(F.col("base").alias("start"), F.col("start").alias("stop")))).otherwise(
        F.array().cast("array<struct<start:bigint,stop:bigint>>")
    )
    slim = slim.join(above, "leaf").join(users, "node").withColumn("attends", _merged(F.concat("above", ahead)))

    # Their texts, each different one once; a turn that many nodes have is a hot key of a join that Spark may split.
    texts = turns.select(_digest(F.col("formatted")).alias("own"), "role", "before", "inside").groupBy("own").agg(
        F.first("role").alias("role"), F.first("before").alias("before"), F.first("inside").alias("inside")
    )
    nodes = slim.join(texts, "own")
    loss = F.when(F.col("role") == learned, F.length("inside")).otherwise(F.lit(0))
    loss_start = F.col("start") + F.length("before")
    nodes = nodes.select(
        "leaf", "depth", "node", "start", "stop", "position", "role", F.concat("before", "inside", F.lit(CLOSE)).alias("formatted"),
        loss_start.alias("loss_start"), (loss_start + loss).alias("loss_stop"), "attends", "users",
    )
    taken = to_copies(convs.select("conv_id", "leaf", F.size("path").cast("long").alias("n_turns")), walked)
    conversations = taken.select("conv_id", "leaf", "n_turns", "shared", F.transform("spans", lambda x: x["start"]).alias("nodes"))
    return PrefixTree(written(nodes), written(conversations))


def read_leaves(tree: PrefixTree) -> DataFrame:
    """(leaf, formatted, turns (role, text), learned): each distinct conversation as the emitted stream has it.

    A leaf's own nodes go to it at once; only those that several go through are joined to the others.
    """
    mask = [(F.col("loss_start") - F.col("start") + 1).cast("int").alias("at"), (F.col("loss_stop") - F.col("loss_start")).cast("int").alias("n")]
    own = tree.nodes.select("leaf", (F.col("depth") - 1).alias("i"), "formatted", *mask)
    leaves = tree.conversations.groupBy("leaf").agg(F.first(F.struct("shared", "nodes")).alias("x")).select("leaf", "x.*")
    steps = leaves.select("leaf", F.posexplode(F.slice("nodes", 1, F.col("shared"))).alias("i", "start"))
    other = steps.join(tree.nodes.where("users > 1").select("start", "formatted", *mask), "start").select("leaf", "i", "formatted", "at", "n")
    whole = own.union(other).groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("i", "formatted", "at", "n"))).alias("p"))
    formatted = F.array_join(F.transform("p", lambda x: x["formatted"]), "")
    learned = F.array_join(F.transform("p", lambda x: unescape(F.substring(x["formatted"], x["at"], x["n"]))), "")
    pieces = F.filter(F.split("formatted", r"<s>\[ROLE\]"), lambda x: x != "")

    def turn(piece: Column) -> Column:
        role, rest = F.substring_index(piece, MIDDLE, 1), F.substring_index(piece, MIDDLE, -1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring_index(rest, CLOSE, 1)).alias("text"))

    return whole.select("leaf", formatted.alias("formatted"), learned.alias("learned")).withColumn("turns", F.transform(pieces, turn))


def read_back(tree: PrefixTree) -> DataFrame:
    """(conv_id, formatted, learned, turns): every conversation, copies too, as the emitted stream has it."""
    return to_copies(tree.conversations.select("conv_id", "leaf"), read_leaves(tree)).drop("leaf")
