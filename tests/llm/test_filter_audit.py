"""Filter audit against a plain simulation of every order."""

import collections
import itertools
import re

import duckdb

from codetide.llm import filter_audit, oracle

LONG = " ".join(f"word{i}" for i in range(30_000))
PROSE = " ".join(f"w{i}" for i in range(220))
ROWS = [
    (5, PROSE, "en"), (3, PROSE, "en"), (9, PROSE, "de"), (3, PROSE, None), (3, PROSE, ""), (None, PROSE, "en"), (None, None, None), (1, None, "en"), (2, "", "en"),
    (4, "a " * 300, "en"), (6, PROSE.upper(), "de"), (7, PROSE + " #", "de"), (8, LONG, "fr"), (10, "A B É   c\u000bd|", "fr"), (-4, " \t\r\n", "fr"), (11, "Ä" * 300, "é'x"),
    (12, LONG, "fr"), (13, "X" * 100_000, "de"), (5, PROSE, "en"),
]
LABELS = [(5, 1, 0), (5, 0, 1), (3, 0, 1), (9, 1, 1), (1, None, 1), (2, 1, None), (None, 1, 1), (4, 0, 0), (8, 1, 0), (999, 1, 1), (13, 1, 1)]


def simulated(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    parts = collections.defaultdict(list)
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {name for name, hit in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
            "E": doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows)}.items() if hit}
        parts[lang or ""].append((doc, fails))
    out = []
    for part, docs in parts.items():
        gone_by = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = docs
            for step, name in enumerate(order, 1):
                removed = [d for d in left if name in d[1]]
                left = [d for d in left if name not in d[1]]
                gone_by[name] += len(removed)
                failing = sum(name in f for _, f in docs)
                out.append([part, order, step, len(left), len(removed), failing - len(removed), sum(f == {name} for _, f in docs),
                            sum(d in good for d, _ in removed), sum(d in toxic for d, _ in removed)])
        for row in out:
            if row[0] == part:
                row.append(gone_by[row[1][row[2] - 1]])
    return sorted(map(tuple, out))


def frames(spark, rows, labels):
    docs = spark.createDataFrame([(*r, "clash", 1, "x") for r in rows], "doc_id long, text string, lang string, part string, mask int, digest string")
    return docs, spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, n string")


def test_every_order_as_simulated(shared):
    docs, labels = frames(shared, ROWS, LABELS)
    got = sorted(map(tuple, filter_audit.audited(docs, labels).collect()))
    assert got == simulated(ROWS, LABELS)
    assert filter_audit.audited(docs.where("false"), labels).count() == 0
    assert sorted(map(tuple, filter_audit.audited(docs, labels.where("false")).collect())) == simulated(ROWS, [])


def test_sql_says_the_same(shared):
    docs, labels = frames(shared, ROWS, LABELS)
    documents, labels_ = docs.toPandas(), labels.toPandas()
    con = duckdb.connect()
    con.register("documents_", documents)
    con.register("labels_", labels_)
    con.execute("CREATE VIEW documents AS SELECT doc_id::BIGINT AS doc_id, text, lang FROM documents_")
    con.execute("CREATE VIEW labels AS SELECT doc_id::BIGINT AS doc_id, quality::INT AS quality, toxic::INT AS toxic FROM labels_")
    assert sorted(con.execute(oracle.OP11).fetchall()) == simulated(ROWS, LABELS)


def test_fields_do_not_carry():
    """Counts far above 32 bits stay in their fields."""
    amounts = {0: 3, 1: 2**40 + 1, 9: 2**62, 31: 2**50 - 7}
    sums = filter_audit.unpacked(sum(n * filter_audit.packed(mask) for mask, n in amounts.items()))
    assert (sums == sum(filter_audit.outcomes(mask).astype("int64") * n for mask, n in amounts.items())).all()
    assert len(sums) == 600


def test_copies_are_no_group(shared):
    """A text that most documents share, and an id that many rows repeat."""
    rows = shared.range(20_000).selectExpr("if(id % 3 = 0, 7, id) AS doc_id", "if(id % 2 = 0, 'same text', concat('t', id)) AS text", "'en' AS lang")
    got = {r["filter_order"]: r for r in filter_audit.audited(rows, shared.createDataFrame([], "doc_id long, quality int, toxic int")).where("step = 1 AND filter_order LIKE 'E%'").collect()}
    pairs = [(r["doc_id"], r["text"]) for r in rows.collect()]
    least = {}
    for doc, text in pairs:
        least[text] = min(doc, least.get(text, doc))
    assert {r["removed"] for r in got.values()} == {sum(doc > least[text] for doc, text in pairs)}
