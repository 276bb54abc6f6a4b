"""The trie against a dictionary of all prefixes."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from codetide.llm import prefix_trie

TURNS = "conv_id long, turn long, role string, text string, conv string, path string, low string"


def sequences(rows):
    own = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest(), role, text))
    return {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def nodes(seqs):
    members = collections.defaultdict(list)
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    kids = collections.Counter(k[:-1] for k in members if k)
    leaves, saved = collections.Counter(), collections.Counter()
    for k, convs in members.items():
        cost = (len(convs) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            saved[k[:d]] += cost
            leaves[k[:d]] += not kids[k]
    return sorted((min(convs), len(k), min(members[k[:-1]]) if k else -1, len(convs), kids[k], leaves[k], saved[k],
                   hashlib.sha256(",".join(str(c) for c in sorted(convs) if len(seqs[c]) == len(k)).encode()).hexdigest()) for k, convs in members.items())


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def rows_of(frame):
    return sorted((tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in frame.collect()))


def test_nulls_ties_copies_and_long_conversations(shared):
    draw = random.Random(3)
    rows = [(None, 0, "user", "no conversation")]
    for c in range(0, 90):
        for t in range(draw.randrange(1, 7)):
            rows.append((c, t, draw.choice(["user", "assistant", None]), draw.choice([None, "", "a b", "a  c d", " ", "e"])))
    rows += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(3)]  # copies, among them whole bases
    rows += [(400, t, "user", f"long {t}") for t in range(700)] + [(420, t, "user", f"long {t}") for t in range(350)] + [(440, 0, "user", "x " * 100_000)]
    rows += [(501, 0, "user", "one turn")] + [(505, 3, "user", "tie 1"), (505, 3, "user", "tie 2"), (505, 3, "user", "tie 1"), (505, None, None, "first")]
    rows += [(next(c for c in range(801, 820) if zlib.crc32(str(c).encode()) % 4), 0, "user", "its only turn goes, and it has no base")]
    draw.shuffle(rows)
    frame = shared.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS)
    want = nodes(rebuilt(sequences(rows)))
    assert any(not turns for turns in rebuilt(sequences(rows)).values())  # turnless ones are members of the root
    assert rows_of(prefix_trie.prefix_nodes(frame)) == want
    assert prefix_trie.prefix_nodes(frame.where("false")).count() == 0


def test_nested_and_branching_sequences(shared):
    draw = random.Random(8)
    seqs = {i: [("user", f"t{d}") for d in range(i)] for i in range(0, 65)}  # a chain of nested conversations, each a node's end
    for i in range(100, 400):  # many random ways with few symbols
        seqs[i] = [("user", f"s{draw.randrange(3)}") for _ in range(draw.randrange(0, 9))]
    seqs |= {i: seqs[130] for i in range(400, 500)}
    frame = shared.createDataFrame([(c, [(hashlib.md5(t[1].encode()).digest(), 1) for t in turns]) for c, turns in seqs.items()],
                                   "conv long, turns array<struct<sym:binary,words:bigint>>")
    assert rows_of(prefix_trie.trie(frame)) == nodes(seqs)


def test_only_turnless(shared):
    frame = shared.createDataFrame([(3, []), (1, [])], "conv long, turns array<struct<sym:binary,words:bigint>>")
    ends = hashlib.sha256(b"1,3").hexdigest()
    assert rows_of(prefix_trie.trie(frame)) == [(1, 0, -1, 2, 0, 1, 0, ends)]


def test_two_fattest(shared):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 70)] + [(2**40 - 1, 2**40), (2**52 + 1, 2**52 + 6)]
    frame = shared.createDataFrame(pairs, "a long, b long").select("a", "b", prefix_trie.fattest("a", "b").alias("f"))
    for a, b, f in frame.collect():
        assert a < f <= b and (b - a > 70 or (f & -f) == max(n & -n for n in range(a + 1, b + 1)))


def test_pieces_of_hot_ends(shared):
    """Ids that end at one node are hashed in pieces from several partitions."""
    ends = shared.range(30_000).select(F.when(F.col("id") % 3 > 0, F.lit(b"n")).otherwise(F.lit(b"m")).alias("node"), (F.col("id") * 7919 % 30_000 - 500).alias("conv"))
    got = {bytes(r["node"]): r["ends_sha256"] for r in prefix_trie.end_digests(ends, lambda df, name: df).collect()}
    for node, rest in ((b"n", lambda i: i % 3 > 0), (b"m", lambda i: i % 3 == 0)):
        ids = sorted(i * 7919 % 30_000 - 500 for i in range(30_000) if rest(i))
        assert got[node] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
