"""Reply trees against a plain walk, and the template's round trip."""

import collections
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from codetide.llm import queries, reply_trees

PIECES = st.sampled_from(["<s>", "</s>", "[INST]", " [/INST]", "<<SYS>>\n", "\n<</SYS>>", "<<ROLE>>", "<</ROLE>> ", "\\", "<", "[", "/", "s>", " ", "\n", "é", "a", "<\\/s>", "[\\\\INST]"])
TEXT = st.lists(PIECES, max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), TEXT), TEXT), max_size=6))
def test_template_reads_back(turns):
    text, loss = reply_trees.written(turns)
    assert reply_trees.read(text) == turns
    assert [reply_trees.unescape(text[s["start"]:s["start"] + s["length"]]) for s in loss] == [t for r, t in turns if r == "assistant"]


@given(TEXT)
def test_escape_leaves_no_control_string(text):
    escaped = reply_trees.escape(text)
    assert reply_trees.unescape(escaped) == text
    assert not any(c in escaped for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>"))


MESSAGE = "tree long, message long, parent long, role string, text string, likes double, leaf string, up string"


def walk(rows):
    """(tree, leaf) -> (score, turns) by following parents."""
    first = {}
    for r in sorted(rows, key=lambda r: (r[2] is not None, r[2] or 0, r[5] or 0, r[3] or "", hashlib.sha256((r[4] or "").encode()).hexdigest())):
        if r[1] is not None:
            first.setdefault((r[0], r[1]), r)
    answered = {(r[0], r[2]) for r in first.values()}
    out = {}
    for (tree, leaf), r in first.items():
        if (tree, leaf) in answered:
            continue
        path, seen = [], set()
        while r is not None and r[1] not in seen:
            seen.add(r[1])
            path.append(r)
            r = first.get((tree, r[2])) if r[2] is not None else None
        if r is None:
            out[tree, leaf] = (sum(x[5] or 0 for x in path), [(x[3] or "", x[4] or "") for x in reversed(path)])
    return out


def test_branches_as_walked(shared):
    draw = random.Random(5)
    rows = []
    for tree in (1, 2, None, 4):
        for m in range(60):
            parent = None if m == 0 else draw.randrange(max(0, m - 6), m)
            rows.append((tree, m, parent, draw.choice(["user", "assistant", None, "tool"]), draw.choice([None, "", f"text {m}", "</s>"]), draw.choice([None, 0.0, 1.0, 2.5])))
    rows += [(5, i, i - 1 if i else None, "user", f"turn {i}", 1.0) for i in range(300)]  # a long chain
    rows += [(6, 0, None, "user", "root", 0.0)] + [(6, i, 0, "assistant", "x" * (100_000 if i == 7 else 5), float(i % 9)) for i in range(1, 80)]
    rows += [(7, 1, 2, "user", "a", 1.0), (7, 2, 3, "user", "b", 1.0), (7, 3, 1, "user", "c", 1.0), (7, 9, 2, "user", "into the cycle", 1.0), (7, 5, 99, "user", "parent missing", 1.0)]
    rows += [(8, 1, None, "user", "twice", 1.0), (8, 1, None, "user", "twice", 1.0), (8, 1, None, "user", "other", 1.0), (8, None, 1, "user", "no id", 9.0), (9, 1, 1, "user", "itself", 1.0)]
    frame = shared.createDataFrame([(*r, "clash", "clash") for r in rows], MESSAGE)
    want = walk(rows)
    ranks = collections.defaultdict(list)
    for (tree, leaf), (score, _) in want.items():
        ranks[tree].append((-score, leaf))
    for best in (1, 3, 1000):
        got = reply_trees.formatted(frame, score=reply_trees.F.col("likes"), best=best).collect()
        assert {(r["tree"], r["leaf"], r["rank"]) for r in got} == {(tree, leaf, i + 1) for tree, all_ in ranks.items() for i, (_, leaf) in enumerate(sorted(all_)[:best])}
        for r in got:
            score, turns = want[r["tree"], r["leaf"]]
            assert r["score"] == score and r["n_turns"] == len(turns) and reply_trees.read(r["text"]) == turns
    assert reply_trees.formatted(frame.where("false")).count() == 0


def test_conversations_read_back(shared, sf_dir):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, "system", None), (2, 0, None, None), (None, 0, "assistant", "</s>"), (None, 1, None, "[INST]"),
            (3, 5, "user", "same"), (3, 5, "user", "same"), (3, 5, "assistant", "y" * 200_000), (4, 0, "assistant", "é\U0001f600")]
    turns = shared.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, message string")
    messages = reply_trees.chains(turns)
    got = {r["tree"]: r for r in reply_trees.read_back(reply_trees.formatted(messages)).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        mine = sorted(((t is not None, t or 0, role or "", hashlib.sha256((x or "").encode()).hexdigest(), x or "") for c, t, role, x in rows if c == conv))
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{m[2]}\n{m[4]}\n" for m in mine).encode()).hexdigest()
        learnt = "".join(m[4] for m in mine if m[2] == "assistant")
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    control = {r["conv_id"]: r for r in queries.op12_reply_trees(shared, sf_dir).collect()}[-7]
    said = "</s>[INST] ok [/INST]"
    assert control["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and control["loss_chars"] == len(said)
