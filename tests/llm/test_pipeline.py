"""The pipeline on a small corpus against plain versions of its five stages."""

import collections
import hashlib
import random

import pytest

import __spark_entry__
import corpus_pipeline

from . import test_native, test_simhash

SOURCES = ("a", "b", "c", None)


def corpus():
    rng = random.Random(11)
    common = ["and", "the", "Rain", "over", "hills,", "was", "long.", "we", "saw", "it"]
    prose = lambda n: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, bench = prose(60), prose(30)
    rows, junk = [], set()
    for i in range(240):
        text = prose(rng.randrange(40, 160))
        if i % 8 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
            junk.add(i)
        elif i % 8 == 2:
            text = f"{text}\n{passage}\n{prose(20)}"
        elif i % 40 == 3:
            text = f"{text} {bench}"
        elif i % 24 == 4 and rows:
            text = rows[-4][1] if (i - 4) not in junk else text
        rows.append((i, text))
    docs = [(i, t, "en", SOURCES[i % 4], len(t)) for i, t in rows]
    labels = [(i, 0 if i in junk else 1, 0) for i in range(240) if i % 2]
    return docs, labels, [(1, bench), (2, prose(40))], junk


def without_repeats(rows):
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 12):
            first[tuple(w[p:p + 13])] = min(first.get(tuple(w[p:p + 13]), i), i)
    out = []
    for i, t in rows:
        w, gone = t.split(), set()
        for p in range(len(w) - 12):
            if first[tuple(w[p:p + 13])] < i:
                gone.update(range(p, p + 13))
        out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else t))
    return out


def expected(docs, bench, junk):
    rows = [(i, t) for i, t, *_ in docs if i not in junk]
    groups = test_simhash.plain_groups([i for i, _ in rows], [test_simhash.plain_fingerprint(t) for _, t in rows])
    rows = [r for r, g in zip(rows, groups) if r[0] == g]
    rows = without_repeats(rows)
    bad = {r[0] for r in test_native.plain_hits(rows, bench) if r[5]}
    rows = [r for r in rows if r[0] not in bad]
    source = {i: s for i, _, _, s, _ in docs}
    size = collections.Counter()
    for i, t in rows:
        size[source[i]] += len(t.split())
    weight = {s: w for s, w in zip([s for s in SOURCES if s in size], (5, 2, 1, 5))}
    target, open_, left = {}, set(size), 1.5 * sum(size.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * size[s]]
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * size[s]
            left -= target[s]
            open_.remove(s)
    out = []
    for i, t in rows:
        rate = target[source[i]] / size[source[i]]
        u = int(hashlib.md5(f"mix|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) / 2 ** 52
        out += [(i, t, source[i], len(t), copy) for copy in range(int(rate) + (u < rate - int(rate)))]
    return sorted(out)


@pytest.fixture(scope="module")
def small(shared, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs, labels, bench, junk = corpus()
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
              "labels": (labels, "doc_id long, quality int, toxic int"), "benchmark": (bench, "item_id long, text string")}
    for name, (rows, schema) in tables.items():
        shared.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder, docs, bench, junk


def test_run(shared, small):
    folder, docs, bench, junk = small
    got = corpus_pipeline.run(shared, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "copy"]
    want = expected(docs, bench, junk)
    assert sorted((r["doc_id"], r["text"], r["source"], r["n_chars"], r["copy"]) for r in got.collect()) == want
    assert len({w[0] for w in want}) > 100


def test_stages_keep_the_columns(shared, small):
    folder = small[0]
    docs = shared.read.parquet(f"{folder}/documents.parquet").limit(30)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "SimHash near-dedup", "substring dedup", "benchmark decontamination", "mixing sources to target weights"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(shared, docs, folder).columns == docs.columns
        assert stage(shared, docs.where("false"), folder).count() == 0


def test_entry_points_are_registered():
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op")) == list(range(1, 14))
    assert set(__spark_entry__.oracle_sql()) <= names
