"""A z-fast trie of conversations, built in batches with equi-joins, and its nodes in full.

A conversation is a sequence of turns; its path has, per depth, a 128-bit digest of the turns up to there
(each digest made from the one before) and the words so far. The trie is compacted: an edge leads from the
extent of its parent, of length p, to its own extent, of length e, and is one row with the path in between.
Its handle is the prefix whose length is the 2-fattest number of (p, e]: the one with most trailing zeros.

Insertion goes in batches. A fat binary search finds the node where each waiting conversation leaves the
trie: it asks for the handle at the 2-fattest depth of what is left of its path; if there is one, it jumps
to that node's extent, else it goes on above. So all conversations take part in about log2(longest) joins
on digests, whatever the trie's depth. One join on the first turn of the edge below gives the edge on which
it leaves or ends, and the comparison of the two paths the depth. The batch is one conversation for each
way out (each next turn that the trie lacks there), drawn by hash; edges are split at all depths of the
batch and new edges hang from them. The others search again, from where they were. Copies find their whole
path then. Each batch settles a random path of every group, so the batches needed grow about with the
logarithm of a group.

What holds for a subtree is summed over the compacted nodes by doubling: round k adds, for each node, the
sums of those 2^k levels below, so a chain of n nested conversations takes log2(n) rounds. Edges are then
expanded to one row per depth. Groups are summed map-side; joins on a digest have one row per digest on
one side, read from a table, so Spark can split the other; the lists of ids that end at one node are sorted
by range and hashed in pieces.

One row holds one conversation's path (24 bytes a turn; 134 million turns at most); texts leave the plan
with the first step. Turns are ordered by number, null first, equal numbers by a digest of role and text;
repeated rows are turns of their own. Null roles and texts are empty. Rows without a conversation id are left
out. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetide.llm.text import word_count
from codetide.session import Stages

ROOT = hashlib.md5(b"").digest()
STEP = pa.struct([("h", pa.binary()), ("w", pa.int64())])
PIECE = 4096
SUMS = ("n", "leaves", "ended_words", "edge_words")


def root() -> Column:
    return F.unhex(F.lit(ROOT.hex()))


def fattest(a: str, b: str) -> Column:
    """The number in (a, b] with most trailing zero bits."""
    return F.expr(f"{b} & shiftleft(-1L, length(bin({a} ^ {b})) - 1)")


def at(path: str, depth: Column | str) -> Column:
    """Digest of a path at a depth; the root's at 0, null beyond the end."""
    place = (F.expr(depth) if isinstance(depth, str) else depth).cast("int")
    return F.when(place == 0, root()).otherwise(F.get(F.col(path), place - 1)["h"])


def words_at(path: str, depth: Column) -> Column:
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(F.get(F.col(path), depth.cast("int") - 1)["w"])


def sequences(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """conv, turns: array of (sym, words) in order. Texts end here."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    sym = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    slim = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.struct(F.col(turn).alias("turn"), sym.alias("sym"), word_count(text).alias("words")).alias("t"))
    ordered = F.sort_array(F.collect_list("t"))  # nulls first
    return slim.groupBy("conv").agg(ordered.alias("t")).select("conv", F.transform("t", lambda t: F.struct(t["sym"].alias("sym"), t["words"].alias("words"))).alias("turns"))


def rebuilt(sequences: DataFrame, *, group: int = 20, most: int = 4) -> DataFrame:
    """The sequence of conversation c: the first h turns of conversation c - c % group, then its own after its first h; h = crc32(c) % most."""
    heads = sequences.select(F.col("conv").alias("base"), F.slice("turns", 1, most).alias("head"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    own = sequences.withColumns({"base": F.col("conv") - F.col("conv") % group, "h": h})
    none = F.array().cast("array<struct<sym:binary,words:bigint>>")
    after = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(none)
    return own.join(heads, "base", "left").select("conv", F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), none), after).alias("turns"))


def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, turns -> conv, len, path."""
    for batch in batches:
        # As few rows at a time as the longest needs: paths are Python objects here.
        for start in range(0, batch.num_rows, 256):
            some, paths = batch.slice(start, 256), []
            for turns in some.column("turns").to_pylist():
                digest, words, path = ROOT, 0, []
                for turn in turns:
                    digest, words = hashlib.md5(digest + turn["sym"]).digest(), words + turn["words"]
                    path.append({"h": digest, "w": words})
                paths.append(path)
            yield pa.RecordBatch.from_arrays(
                [some.column("conv"), pa.array(map(len, paths), pa.int64()), pa.array(paths, pa.list_(STEP))], names=["conv", "len", "path"])


def traced(sequences: DataFrame) -> DataFrame:
    return sequences.select("conv", "turns").mapInArrow(trace, "conv long, len long, path array<struct<h:binary,w:bigint>>")


EDGE = ("head", "handle", "p", "e", "up", "up_words", "last", "label")


def edge(path: str, offset: Column | int, p: str, e: str, up: Column, up_words: Column) -> list[Column]:
    """The columns of an edge (p, e] whose turns are in array `path`, which begins after depth `offset`."""
    fat = fattest(p, e)
    place = lambda depth: F.get(F.col(path), (depth - offset).cast("int") - 1)
    first = (F.col(p) - offset + 1).cast("int")
    return [place(F.col(p) + 1)["h"].alias("head"), place(fat)["h"].alias("handle"), F.col(p).alias("p"), F.col(e).alias("e"), up.alias("up"), up_words.alias("up_words"),
            place(F.col(e))["h"].alias("last"), F.slice(F.col(path), first, (F.col(e) - F.col(p)).cast("int")).alias("label")]


def located(waiting: DataFrame, edges: DataFrame) -> DataFrame:
    """Where conversations (conv, len, path, a) leave the trie: adds l, the depth up to which it has them, and head, the edge to split there.

    `a` is the depth of some node on their way. `l` may be their whole length.
    """
    longest = waiting.agg(F.max(F.col("len") - F.col("a")).alias("n")).first()["n"] or 0
    handles = edges.select("handle", F.col("p").alias("np"), F.col("e").alias("ne"), "last")
    found = waiting.withColumn("b", F.col("len"))
    for _ in range(int(longest).bit_length()):
        asked = found.withColumn("f", F.when(F.col("a") < F.col("b"), fattest("a", "b"))).withColumn("key", at("path", "f"))
        met = asked.join(handles, asked["key"] == handles["handle"], "left")
        whole = (F.col("ne") <= F.col("len")) & (at("path", "ne") == F.col("last"))
        a = F.when(F.col("handle").isNull(), F.col("a")).when(whole, F.col("ne")).otherwise(F.col("np"))
        b = F.when(F.col("f").isNull(), F.col("b")).when(F.col("handle").isNull(), F.col("f") - 1).when(whole, F.col("b")).otherwise(F.col("np"))
        found = met.select("conv", "len", "path", a.alias("a"), b.alias("b"))
    ways = edges.select("head", F.col("e").alias("ne"), "label")
    below = found.withColumn("key", F.when(F.col("a") < F.col("len"), at("path", F.col("a") + 1)))
    exits = below.join(ways, below["key"] == ways["head"], "left")
    rest = F.slice(F.col("path"), (F.col("a") + 1).cast("int"), F.size("label"))
    common = F.size(F.filter(F.zip_with("label", rest, lambda x, y: x["h"] == y["h"]), lambda same: same))
    l = F.when(F.col("head").isNull(), F.col("a")).otherwise(F.col("a") + common)
    return exits.withColumn("l", l.cast("long")).select("conv", "len", "path", "l", F.when(F.col("l") < F.col("ne"), F.col("head")).alias("head"))


def split_edges(edges: DataFrame, exits: DataFrame) -> DataFrame:
    """Edges cut at the depths (head, l) of `exits`."""
    cuts = exits.where("head IS NOT NULL").select("head", "l").distinct().groupBy("head").agg(F.sort_array(F.collect_list("l")).alias("cuts"))
    marked = edges.join(cuts, "head", "left")
    whole = marked.where("cuts IS NULL").select(*EDGE)
    bounds = F.concat(F.array("p"), F.col("cuts"), F.array("e"))
    parts = marked.where("cuts IS NOT NULL").withColumn("bounds", bounds).select(
        "*", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("i")).select(
        "up", "up_words", "label", F.col("p").alias("from"), F.get("bounds", F.col("i")).alias("p"), F.get("bounds", F.col("i") + 1).alias("e"))
    above = F.get(F.col("label"), (F.col("p") - F.col("from")).cast("int") - 1)
    top = F.col("p") == F.col("from")
    return whole.union(parts.select(*edge("label", F.col("from"), "p", "e", F.when(top, F.col("up")).otherwise(above["h"]),
                                          F.when(top, F.col("up_words")).otherwise(above["w"]))))


def built(paths: DataFrame, keep) -> DataFrame:
    """The edges of the compacted trie of all paths (conv, len, path)."""
    waiting = paths.where("len > 0").withColumn("a", F.lit(0).cast("long"))
    edges, number = None, 0
    while True:
        if edges is None:
            exits = waiting.select("conv", "len", "path", F.col("a").alias("l"), F.lit(None).cast("binary").alias("head"))
        else:
            exits = keep(located(waiting, edges), f"exits-{number}")
        open_ = exits.where("l < len").withColumn("key", at("path", F.col("l") + 1))
        drawn = keep(open_.groupBy("key").agg(F.min(F.struct(F.xxhash64("conv").alias("order"), "conv")).alias("first")).select(F.col("first.conv").alias("conv")), f"batch-{number}")
        batch = open_.join(drawn, "conv", "left_semi")
        leaves = batch.withColumns({"p": F.col("l"), "e": F.col("len")}).select(
            *edge("path", 0, "p", "e", at("path", "p"), words_at("path", F.col("p"))))
        edges = keep(leaves if edges is None else split_edges(edges, exits).union(leaves), f"edges-{number}")
        waiting = keep(open_.join(drawn, "conv", "left_anti").select("conv", "len", "path", F.col("l").alias("a")), f"waiting-{number}")
        number += 1
        if waiting.isEmpty():
            return edges


def id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (part, node, conv) -> rows (node, part, piece, ids): runs of at most PIECE ids, comma-joined."""
    node, piece, ids = None, 0, []
    schema = pa.schema([("node", pa.binary()), ("part", pa.int32()), ("piece", pa.int64()), ("ids", pa.string())])
    part = 0
    for batch in batches:
        out = []
        for part_, node_, conv in zip(*(batch.column(name).to_pylist() for name in ("part", "node", "conv"))):
            part = part_
            if node_ != node or len(ids) == PIECE:
                if ids:
                    out.append({"node": node, "part": part, "piece": piece, "ids": ",".join(ids)})
                piece, ids, node = (piece + 1 if node_ == node else 0), [], node_
            ids.append(str(conv))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if ids:
        yield pa.RecordBatch.from_pylist([{"node": node, "part": part, "piece": piece, "ids": ",".join(ids)}], schema)


def id_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, ids) sorted by node, part and piece -> (node, ends_sha256)."""
    node, digest = None, None
    for batch in batches:
        nodes, digests = [], []
        for node_, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if node_ != node:
                if node is not None:
                    nodes.append(node)
                    digests.append(digest.hexdigest())
                node, digest = node_, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(digests, pa.string())], names=["node", "ends_sha256"])
    if node is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["node", "ends_sha256"])


def end_digests(ends: DataFrame, keep) -> DataFrame:
    """node, ends_sha256 of the ids, in ascending order, that end at each node; from rows (node, conv)."""
    ranged = ends.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv")
    pieces = keep(ranged.select(F.spark_partition_id().alias("part"), "node", "conv")
                  .mapInArrow(id_pieces, "node binary, part int, piece long, ids string"), "pieces")
    return pieces.repartition("node").sortWithinPartitions("node", "part", "piece").select("node", "ids") \
        .mapInArrow(id_digests, "node binary, ends_sha256 string")


def subtrees(nodes: DataFrame, keep) -> DataFrame:
    """Sums of SUMS and minima of `low` over the subtree of each node, from rows (node, above, low, *SUMS); `above` is null under the root."""
    number = 0
    while not (lower := nodes.where("above IS NOT NULL")).isEmpty():
        sums = lower.groupBy(F.col("above").alias("node")).agg(F.min("low").alias("low_"), *[F.sum(c).alias(f"{c}_") for c in SUMS])
        pointers = nodes.select(F.col("node").alias("above"), F.col("above").alias("above_"))
        nodes = keep(nodes.join(sums, "node", "left").join(pointers, "above", "left").select(
            "node", F.col("above_").alias("above"), F.least("low", "low_").alias("low"),
            *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"{c}_", F.lit(0))).alias(c) for c in SUMS]), f"subtrees-{number}")
        number += 1
    return nodes


def expanded(paths: DataFrame, edges: DataFrame, keep) -> DataFrame:
    """One row per distinct prefix of the paths: see `trie`."""
    ends = keep(paths.select(at("path", "len").alias("node"), "conv", words_at("path", F.col("len")).alias("words")), "ends")
    own = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.sum("words").alias("ended_words"))
    kids = edges.groupBy(F.col("up").alias("node")).agg(F.count("*").alias("kids"))
    words = F.element_at("label", -1)["w"] - F.col("up_words")
    start = edges.select(F.col("last").alias("node"), F.when(F.col("up") != root(), F.col("up")).alias("above"), words.alias("edge_words")) \
        .join(own, "node", "left").join(kids, "node", "left")
    start = keep(start.select("node", "above", "low", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("kids").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
                              F.coalesce("ended_words", F.lit(0)).alias("ended_words"), "edge_words", F.coalesce("kids", F.lit(0)).alias("kids")), "nodes")
    sums = subtrees(start.drop("kids"), keep)
    digests = keep(end_digests(ends, keep), "digests")

    total = ends.agg(F.count("*").alias("n"), F.min("conv").alias("low"), F.sum("words").alias("words")).first()
    whole = start.agg(F.sum("leaves").alias("leaves"), F.sum("edge_words").alias("words"), F.sum((F.col("above").isNull()).cast("long")).alias("kids")).first()
    none, here = hashlib.sha256(b"").hexdigest(), digests.where(F.col("node") == root()).first()
    top = ends.limit(1).select(
        F.lit(total["low"]).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.lit(total["n"]).alias("n_convs"),
        F.lit(whole["kids"] or 0).cast("long").alias("n_children"), F.lit(whole["leaves"] or 1).cast("long").alias("n_leaves"),
        F.lit((total["words"] or 0) - (whole["words"] or 0)).cast("long").alias("saved_tokens"),
        F.lit(here["ends_sha256"] if here else none).alias("ends_sha256"))

    upper = sums.select(F.col("node").alias("up"), F.col("low").alias("up_low"))
    full = edges.select("p", "e", "up", "up_words", F.col("last").alias("node"), F.transform("label", lambda s: s["w"]).alias("w")) \
        .join(sums.drop("above"), "node").join(start.select("node", "kids"), "node").join(digests, "node", "left").join(upper, "up", "left")
    each = full.select("*", F.explode(F.sequence(F.col("p") + 1, F.col("e"))).alias("depth"))
    first, last = F.col("depth") == F.col("p") + 1, F.col("depth") == F.col("e")
    before = F.when(first, 0).otherwise(F.get("w", (F.col("depth") - F.col("p") - 2).cast("int")) - F.col("up_words"))
    saved = F.col("ended_words") - F.col("n") * F.col("up_words") - F.col("edge_words") - (F.col("n") - 1) * before
    rows = each.select(
        F.col("low").alias("conv_id"), "depth", F.when(~first, F.col("low")).otherwise(F.coalesce("up_low", F.lit(total["low"]).cast("long"))).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), saved.alias("saved_tokens"),
        F.when(last, F.coalesce("ends_sha256", F.lit(none))).otherwise(F.lit(none)).alias("ends_sha256"))
    return top.unionByName(rows)


def trie(sequences: DataFrame, *, keep=None) -> DataFrame:
    """One row per distinct prefix of the sequences (conv, turns), the empty one included.

    conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (words that members need not repeat, over the subtree), ends_sha256
    (of the members that end here).
    """
    keep = keep or Stages(sequences.sparkSession).keep
    paths = keep(traced(sequences), "paths")
    return expanded(paths, built(paths, keep), keep)


def prefix_nodes(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", keep=None) -> DataFrame:
    """`trie` of the conversations as they stand after `rebuilt`."""
    keep = keep or Stages(conversations.sparkSession).keep
    return trie(rebuilt(keep(sequences(conversations, conv, turn, role, text), "sequences")), keep=keep)
