"""Chat formatting of reply trees: branches by iterative self-joins, ranked, one text per chosen branch.

Messages point at the message they answer. The path from a leaf to its root is found by doubling: the
pointers of round k lead 2^k messages up, so a round joins the paths found so far to the pointers and
the pointers to themselves, and as many rounds as the logarithm of the longest path enumerate all of them.
What is joined has ids and scores only. Branches are ranked inside their tree by the sum of their messages'
scores (ties: the smaller leaf first); Spark prunes each task to the wanted number before the shuffle,
so a tree with very many leaves is no group in one task. Texts are joined to the messages of chosen
branches at the end, and a branch is written turn by turn from sorted rows: a task holds one conversation
at a time, as its row must.

A conversation is written in one template of marked turns. A text may itself hold a control string; a
backslash after its first character (one more, if backslashes stand there) keeps it apart, and reading
takes that one away again, so every text comes back as it was. `loss` lists the assistant texts' places.

Null trees are one tree; messages without an id are left out, of rows that repeat an id the first by
parent, score, role and text digest counts. A parent that is not there makes its message a root. Messages
on a cycle, and those that answer into one, have no root and belong to no branch. Null roles and texts are
empty, null scores 0. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from codetide.session import Stages

# Fixed values of the template: (before, after) the text of a turn, by role; any other role is named in its turn.
TURNS = {
    "system": ("<s>[INST] <<SYS>>\n", "\n<</SYS>> [/INST]"),
    "user": ("<s>[INST] ", " [/INST]"),
    "assistant": (" ", "</s>"),
}
OTHER = ("<s>[INST] <<ROLE>>", "<</ROLE>> ", " [/INST]")
LEARNT = "assistant"
# A control string, with the backslashes that mark it as text between its first character and the rest.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>|</?ROLE>>)")
TURN = re.compile(
    r"<s>\[INST\] <<SYS>>\n(?P<system>.*?)\n<</SYS>> \[/INST\]"
    r"|<s>\[INST\] <<ROLE>>(?P<role>.*?)<</ROLE>> (?P<other>.*?) \[/INST\]"
    r"|<s>\[INST\] (?P<user>.*?) \[/INST\]"
    r"| (?P<assistant>.*?)</s>", re.S)

FORMATTED = "tree long, leaf long, rank int, score double, n_turns long, text string, loss array<struct<start:long,length:long>>"
READ = "tree long, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[1] + m[2][1:] + m[3], text)


def written(turns: list[tuple[str, str]]) -> tuple[str, list[dict]]:
    """The text of a conversation, and where in it the assistant's texts stand (in code points)."""
    parts, loss, at = [], [], 0
    for role, text in turns:
        text = escape(text)
        before, after = TURNS.get(role) or (OTHER[0] + escape(role) + OTHER[1], OTHER[2])
        if role == LEARNT:
            loss.append({"start": at + len(before), "length": len(text)})
        parts += (before, text, after)
        at += len(before) + len(text) + len(after)
    return "".join(parts), loss


def read(text: str) -> list[tuple[str, str]]:
    """The turns of a written conversation."""
    turns, at = [], 0
    while at < len(text):
        found = TURN.match(text, at)
        if found is None:
            raise ValueError(f"no turn at {at}")
        kind = found.lastgroup
        role, body = (unescape(found["role"]), found["other"]) if kind == "other" else (kind, found[kind])
        turns.append((role, unescape(body)))
        at = found.end()
    return turns


def messages_of(messages: DataFrame, tree: str, message: str, parent: str, score: Column, role: str, text: str) -> DataFrame:
    """tree, message, parent, score: one slim row per message."""
    slim = messages.where(F.col(message).isNotNull()).select(
        F.col(tree).cast("long").alias("tree"), F.col(message).cast("long").alias("message"),
        F.struct(F.col(parent).cast("long").alias("parent"), F.coalesce(score, F.lit(0)).cast("double").alias("score"),
                 F.coalesce(F.col(role), F.lit("")).alias("role"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest")).alias("m"))
    return slim.groupBy("tree", "message").agg(F.min("m").alias("m")).select("tree", "message", "m.*")


def same_tree(a: str, b: str) -> Column:
    """Trees are compared with nulls equal."""
    return F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree"))


def branches(messages: DataFrame, keep) -> DataFrame:
    """tree, leaf, message, up (0 at the leaf), score of the message: every root-to-leaf path, from rows (tree, message, parent, score)."""
    a, b = messages.alias("a"), messages.select("tree", "message").alias("b")
    upward = a.join(b, same_tree("a", "b") & (F.col("a.parent") == F.col("b.message")), "left") \
        .select("a.tree", "a.message", F.col("b.message").alias("above"), "a.score")
    known = keep(upward, "upward")
    answered = known.where("above IS NOT NULL").select("tree", F.col("above").alias("message")).distinct()
    a, b = known.alias("a"), answered.alias("b")
    leaves = a.join(b, same_tree("a", "b") & (F.col("a.message") == F.col("b.message")), "left_anti")
    jumps = [keep(known.where("above IS NOT NULL").select("tree", "message", "above"), "jumps-0")]
    size = jumps[0].count()
    while size:
        j, h = jumps[-1].alias("j"), jumps[-1].alias("h")
        further = j.join(h, same_tree("j", "h") & (F.col("j.above") == F.col("h.message"))).select("j.tree", "j.message", "h.above")
        before, further = size, keep(further, f"jumps-{len(jumps)}")
        size = further.count()
        if size == before:  # no message of this depth: what is left leads into a cycle
            l, j = leaves.alias("l"), further.alias("j")
            leaves = l.join(j, same_tree("l", "j") & (F.col("l.message") == F.col("j.message")), "left_anti")
            break
        if size:
            jumps.append(further)
    paths = keep(leaves.select("tree", F.col("message").alias("leaf"), "message", F.lit(0).cast("long").alias("up")), "paths-0")
    for k, jump in enumerate(jumps):
        p, j = paths.alias("p"), jump.alias("j")
        further = p.join(j, same_tree("p", "j") & (F.col("p.message") == F.col("j.message"))) \
            .select("p.tree", "p.leaf", F.col("j.above").alias("message"), (F.col("p.up") + (1 << k)).alias("up"))
        paths = keep(paths.union(further), f"paths-{k + 1}")
    p, m = paths.alias("p"), known.alias("m")
    return p.join(m, same_tree("p", "m") & (F.col("p.message") == F.col("m.message"))).select("p.tree", "p.leaf", "p.message", "p.up", "m.score")


def ranked(paths: DataFrame, best: int) -> DataFrame:
    """tree, leaf, score, rank (from 1): the `best` branches of each tree."""
    scored = paths.groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= best)


def write_branches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tree, leaf and turn become one row per branch."""
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("rank", pa.int32()), ("score", pa.float64()), ("n_turns", pa.int64()),
                        ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))])
    key, turns = None, []

    def row() -> pa.RecordBatch:
        text, loss = written(turns)
        return pa.RecordBatch.from_pylist([dict(zip(("tree", "leaf", "rank", "score"), key)) | {"n_turns": len(turns), "text": text, "loss": loss}], schema)

    for batch in batches:
        names = [batch.column(name).to_pylist() for name in ("tree", "leaf", "rank", "score", "role", "text")]
        for *own, role, text in zip(*names):
            if own != key:
                if turns:
                    yield row()
                key, turns = own, []
            turns.append((role, text))
    if turns:
        yield row()


def formatted(messages: DataFrame, *, tree: str = "tree", message: str = "message", parent: str = "parent", role: str = "role",
              text: str = "text", score: Column | None = None, best: int = 1, keep=None) -> DataFrame:
    """One row per chosen branch: tree, leaf, rank, score, n_turns, text, loss."""
    keep = keep or Stages(messages.sparkSession).keep
    score = F.lit(0.0) if score is None else score
    slim = keep(messages_of(messages, tree, message, parent, score, role, text), "messages")
    paths = keep(branches(slim, keep), "branches")
    chosen = keep(ranked(paths, best), "chosen")
    p, c = paths.alias("p"), chosen.alias("c")
    wanted = p.join(c, same_tree("p", "c") & (F.col("p.leaf") == F.col("c.leaf"))) \
        .select("p.tree", "p.leaf", "c.rank", "c.score", "p.message", F.col("p.up"))
    # Which of the rows that repeat an id counts is known by its role and digest; equal ones are one row.
    bodies = messages.where(F.col(message).isNotNull()).select(
        F.col(tree).cast("long").alias("tree"), F.col(message).cast("long").alias("message"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    w, s, b = wanted.alias("w"), slim.alias("s"), bodies.withColumn("digest", F.sha2("text", 256)).alias("b")
    named = w.join(s, same_tree("w", "s") & (F.col("w.message") == F.col("s.message"))).select("w.*", "s.role", "s.digest").alias("w")
    turns = named.join(b, same_tree("w", "b") & (F.col("w.message") == F.col("b.message")) & (F.col("w.role") == F.col("b.role"))
                       & (F.col("w.digest") == F.col("b.digest"))).select("w.tree", "w.leaf", "w.rank", "w.score", "w.up", "w.role", "b.text")
    rows = turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", F.col("up").desc())
    return rows.mapInArrow(write_branches, FORMATTED)


def read_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("tree", pa.int64()), ("leaf", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                        ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    for batch in batches:
        rows = []
        for row in batch.select(["tree", "leaf", "text", "loss"]).to_pylist():
            turns, learnt, whole = hashlib.sha256(), hashlib.sha256(), row["text"]
            back = read(whole)
            for role, text in back:
                turns.update(f"{role}\n{text}\n".encode())
            chars = 0
            for span in row["loss"]:
                text = unescape(whole[span["start"]:span["start"] + span["length"]])
                chars += len(text)
                learnt.update(text.encode())
            rows.append({"tree": row["tree"], "leaf": row["leaf"], "n_turns": len(back), "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                         "loss_sha256": learnt.hexdigest(), "formatted_chars": len(whole)})
        yield pa.RecordBatch.from_pylist(rows, schema)


def read_back(conversations: DataFrame) -> DataFrame:
    """Digests of what the texts of `formatted` say: turns by parsing them, learnt text by their loss places."""
    return conversations.select("tree", "leaf", "text", "loss").mapInArrow(read_rows, READ)


def chains(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages (tree, message, parent, role, text) of conversations whose turns each answer the one before.

    Turns are ordered by number, null first, equal ones by role and by the SHA-256 of the text; repeated
    rows are turns of their own.
    """
    rows = conversations.select(F.col(conv).cast("long").alias("tree"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                F.coalesce(F.col(text), F.lit("")).alias("text"))
    at = Window.partitionBy("tree").orderBy(F.col("turn").asc_nulls_first(), "role", F.sha2("text", 256))
    numbered = rows.withColumn("message", F.row_number().over(at).cast("long"))
    return numbered.select("tree", "message", F.when(F.col("message") > 1, F.col("message") - 1).alias("parent"), "role", "text")
