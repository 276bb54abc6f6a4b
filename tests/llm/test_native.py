"""Mixing, url filter, decontamination and licences: parity with their SQL, edge cases, plain versions."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from codetide.llm import decontaminate, licences, mixing, oracle, queries, url_filter
from codetide.session import Stages

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NATIVE = ("op4_", "op7_", "op10_")
DOCS = "doc_id long, text string, source string, copies string, size string"


def normal(value):
    return repr(round(value, 9)) if isinstance(value, float) else repr(value)


@pytest.mark.parametrize("name", sorted(oracle.statements()))
def test_parity(shared, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = queries.queries()[name](shared, sf_dir)
    columns = sorted(df.columns)
    got = sorted("|".join(map(normal, row)) for row in df.select(*columns).collect())
    relation = con.execute(oracle.statements()[name])
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    assert got == sorted("|".join(normal(row[names.index(c)]) for c in columns) for row in relation.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not name.startswith(NATIVE) or not re.search("Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoop", plan)


def test_mixing_cases(shared):
    rows = [(i, "w " * (i % 7), f"s{i % 5}", "x", "y") for i in range(400)]
    rows += [(1000, None, "s1", "x", "y"), (1001, "a b", None, "x", "y"), (1002, "", "empty", "x", "y"), (None, "a", "s2", "x", "y"),
             (1003, "word " * 50_000, "s3", "x", "y"), (5, rows[5][1], rows[5][2], "x", "y")]
    docs = shared.createDataFrame(rows, DOCS)
    plan = mixing.planned(docs).collect()
    assert len(plan) == len(rows)
    sizes = collections.Counter()
    for _, text, source, _, _ in rows:
        sizes[source] += len((text or "").split())
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:  # share, cap, share again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            open_.remove(s)
    for r in plan:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["copies"] <= 2 and r["taken"] == r["copies"] * r["size"]
    again = {(r["doc_id"], r["text_hash"]): r["copies"] for r in mixing.planned(docs).collect()}
    assert again == {(r["doc_id"], r["text_hash"]): r["copies"] for r in plan}
    mixed = mixing.mixed(docs)
    assert mixed.columns == [*docs.columns, "copy"]
    assert mixed.count() == sum(r["copies"] for r in plan)
    assert mixing.planned(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0


def test_mixing_meets_targets(shared):
    docs = shared.range(6000).selectExpr("id AS doc_id", "repeat('w ', cast(id % 40 AS int)) AS text", "concat('s', id % 3) AS source")
    rows = mixing.planned(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 0.05 * r["target"] for r in rows)


URLS = [
    (1, "http://a.net/x"), (2, "https://b.example.net/en/1"), (3, "https://example.net/en"), (4, "https://example.com/de/2?x#y"), (5, "http://EXAMPLE.org/fr/é"),
    (6, None), (7, "no scheme"), (8, "http://"), (9, "http://x.net"), (10, "http://x.net?q=/"), (11, "http://bad.test/1"), (12, "http://good.test/1"),
    (None, "http://a.net/"), (1, "http://a.net/x"), (13, "ftp://notexample.net/en/"), (14, "http://example.co.uk/a://b/c"), (15, "http://h/" + "p" * 200_000),
]


def test_url_rules_and_reputation(shared):
    pages = shared.createDataFrame([(i, u, "clash", "clash") for i, u in URLS] + [(i, f"http://{'bad' if i % 2 else 'good'}.test/{i}", "", "") for i in range(100, 180)],
                                   "page_id long, url string, host string, verdict string")
    outcomes = shared.createDataFrame([(i, i % 2) for i in range(100, 180)] + [(100, 0), (None, 1), (101, None), (999, 1)], "page_id long, bad int")
    rules = shared.createDataFrame(list(queries.URL_RULES), "host string, path string, action string")
    got = url_filter.judge(pages, outcomes, rules).collect()
    assert len(got) == len(URLS) + 80
    by_id = collections.defaultdict(list)
    for r in got:
        by_id[r["page_id"]].append((r["host"], r["path"], r["rule"], r["verdict"]))
    assert by_id[1] == [("a.net", "/x", "net/", "block")] * 2
    assert by_id[2] == [("b.example.net", "/en/1", "example.net/en/", "allow")]
    assert by_id[3] == [("example.net", "/en", "net/", "block")]
    assert by_id[4] == [("example.com", "/de/2", "example.com/de/", "block")]
    assert by_id[5] == [("example.org", "/fr/é", "org/fr/", "allow")]
    for i in (6, 7, 8):
        assert by_id[i][0][:3] == ("", "", None)
    assert by_id[9][0][:3] == ("x.net", "", None) and by_id[10][0][:3] == ("x.net", "", None)
    assert by_id[13] == [("notexample.net", "/en/", "net/", "block")]
    assert by_id[14][0][:3] == ("example.co.uk", "/a://b/c", None)
    assert by_id[11][0][3] == "block" and by_id[12][0][3] == "allow"
    assert url_filter.judge(pages.where("false"), outcomes, rules).count() == 0
    nothing = url_filter.judge(pages, outcomes.where("false"), rules.where("false")).collect()
    assert {r["verdict"] for r in nothing} == {"allow"} and {r["rule"] for r in nothing} == {None}


def test_hot_hosts_are_salted(shared):
    """A host with a third of all pages is split; the result does not depend on how far."""
    urls = ["http://hot.test/a"] * 100 + [f"http://hot.test/{i}" for i in range(200)] + [f"http://h{i % 150}.test/{i}" for i in range(600)] + [None]
    pages = shared.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    outcomes = shared.createDataFrame([(i, int(i % 3 > 0)) for i in range(0, 900, 2)], "page_id long, bad int")
    rules = shared.createDataFrame(list(queries.URL_RULES), "host string, path string, action string")
    known = url_filter.reputation(url_filter.url_parts(pages), outcomes)
    assert {r["host"]: r["pages"] for r in known.where("pages > 4").collect()} == {"hot.test": 300}
    assert [r["salts"] for r in url_filter.salts(known, 100).collect()] == [34]
    assert url_filter.salts(known.where("false")).count() == 0
    results = [sorted(url_filter.judge(pages, outcomes, rules, hot_parts=n).collect()) for n in (1, 100, 4096)]
    assert len(results[0]) == 901 and results[0] == results[1] == results[2]


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_hits(rows, items):
    tokens = lambda t: WORD.findall((t or "").encode().lower())
    windows = collections.defaultdict(set)
    for i, t in items:
        w = tokens(t)
        for p in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[p:p + 13])].add(i)
    out = []
    for i, t in rows:
        w, hit, found = tokens(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                for item in windows.get(tuple(w[p:p + n]), ()):
                    hit.update(range(p, p + n))
                    found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_decontamination(shared, broadcast_rows):
    item = " ".join(f"Wört{i}" for i in range(30))
    items = [(1, item), (2, "short item, three"), (3, None), (4, "!!"), (10, " ".join(f"wört{i}" for i in range(5, 25))), (5, "a b c d e f g h i j k l m"), (6, "lone9")]
    rows = [(1, item), (2, "x " * 100 + item.upper().replace("Ö", "ö") + " y" * 9), (3, " ".join(item.split()[:12])), (4, None), (5, ""), (6, "..."),
            (7, "Short-ITEM\nthree"), (8, "short item"), (9, "z " * 20_000 + item), (10, "a b c d e f g h i j k l m n"), (1, item), (1, "other text"), (None, item),
            (11, "ſhort item three K"), (12, "x lone9 y"), (13, "WÖRT0 " + item[6:])]
    docs = shared.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS.replace("copies", "spans").replace("size", "items"))
    bench = shared.createDataFrame(items, "item_id long, text string")
    got = decontaminate.report(docs, bench, broadcast_rows=broadcast_rows).drop("text_hash")
    assert sorted(map(tuple, got.collect()), key=repr) == plain_hits(rows, items)
    clean = decontaminate.remove(docs, bench, broadcast_rows=broadcast_rows)
    assert clean.columns == docs.columns
    assert sorted((r["doc_id"] for r in clean.collect()), key=repr) == sorted((r[0] for r in plain_hits(rows, items) if not r[5]), key=repr)
    spans = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, broadcast_rows=broadcast_rows).collect()}
    assert spans[2] == " ".join(["x"] * 100 + ["y"] * 9) and spans[8] == "short item" and spans[4] is None
    assert decontaminate.report(docs.where("false"), bench).count() == 0
    assert decontaminate.report(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_licences(shared):
    lines = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "released UNDER the MIT license": "mit",
             "This work is licensed under the GNU General Public License, version 3.": "gpl", "Licensed under CC BY-NC 4.0.": "cc-by-nc",
             "SPDX-License-Identifier: BSD-3-Clause": "bsd", "He got his driving license at MIT, said the paper about the new version of the car.": "",
             "The Apache helicopter and the general public.": ""}
    filler = "thand erion of the inga lyre. Another one is here, and that was it"
    rows = [(i, f"{filler} {i}\n\n{line}\n{filler}") for i, line in enumerate(lines)]
    rows += [(100, None), (101, ""), (102, "\n \n"), (103, "\n".join(lines)), (0, rows[0][1]), (None, rows[1][1]), (104, (filler + " ") * 3000)]
    docs = shared.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in rows], DOCS.replace("copies", "family").replace("size", "paragraph"))
    got = licences.scanned(docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for i, family in enumerate(lines.values()):
        assert by_id[i]["families"] == family and by_id[i]["n_paragraphs"] == 3, (i, by_id[i])
    assert sum(r["doc_id"] == 0 and r["families"] == "apache-2.0" and r["n_licence"] == 1 for r in got) == 2
    assert by_id[None]["families"] == "mit"
    assert by_id[103]["families"] == "apache-2.0,bsd,cc-by-nc,gpl,mit" and by_id[103]["n_licence"] == 5
    assert [by_id[i]["n_paragraphs"] for i in (100, 101, 102, 104)] == [0, 0, 0, 1]
    assert licences.scanned(docs.where("false")).count() == 0


def test_licence_bodies_whole_and_wrapped(shared, sf_dir):
    """Every family by its body alone, on one line and wrapped, amid ordinary lines."""
    import textwrap

    ordinary = [r["text"] for r in shared.read.parquet(f"{sf_dir}/documents.parquet").where("text IS NOT NULL").collect()]
    ordinary = [x for t in ordinary for x in t.split("\n") if x.strip() and "icens" not in x][:5000]
    rows = []
    for i, (family, bodies) in enumerate(licences.TEXTS.items()):
        for j, body in enumerate(bodies):
            around = ordinary[(i * 10 + j) * 40:][:40]
            for wrapped, text in enumerate((body, "\n".join(textwrap.wrap(body, 50)))):
                rows.append((i * 100 + j * 10 + wrapped, "\n".join([*around[:20], text, *around[20:]]), family))
    rows.append((9999, "\n".join(ordinary), ""))
    docs = shared.createDataFrame(rows, "doc_id long, text string, family string")
    got = {r["doc_id"]: r for r in licences.scanned(docs.drop("family")).collect()}
    assert {(d, f) for d, _, f in rows if f not in got[d]["families"].split(",")} == set()
    assert sum(got[d]["families"] == f for d, _, f in rows) >= 0.9 * len(rows)
    assert got[9999]["n_licence"] == 0


def test_licence_scores_match_the_sums(shared):
    """Probabilities of paragraphs against the model's weights summed by hand."""
    import math

    docs = shared.createDataFrame([(1, "Licensed under the Apache License, Version 2.0."), (2, "Released under the MIT License.\nplain")], "doc_id long, text string")
    model = licences.trained(docs, Stages(shared).keep)
    for r in licences.found(docs, model).collect():
        text = {1: ["Licensed under the Apache License, Version 2.0."], 2: ["Released under the MIT License.", "plain"]}[r["doc"]][r["at"]]
        w = re.findall(r"[^\W_]+", text.lower())
        terms = set(w) | {" ".join(p) for p in zip(w, w[1:])}
        z = [b + sum(model.weights[t][i] for t in terms if t in model.weights) for i, b in enumerate(model.intercepts)]
        z[0] += model.raised
        best = max(range(len(z)), key=z.__getitem__)
        assert model.classes[best] == r["family"] and r["probability"] == pytest.approx(1 / sum(math.exp(x - z[best]) for x in z))
