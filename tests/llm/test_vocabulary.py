"""Importance resampling where only the vocabulary tells good rows from bad ones."""

import random

import pytest

from codetide.llm import importance, queries

LETTERS = {"latin": "abcdefghij", "cyrillic": "абвгдежзик"}


@pytest.fixture(params=sorted(LETTERS))
def folder(request, shared, tmp_path):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices(LETTERS[request.param], k=6))
    prose, adverts = [word() for _ in range(400)], [word() for _ in range(400)]
    rows = []
    for i in range(600):
        own = adverts if i % 3 == 0 else prose
        # One word in four is in no other row.
        rows.append((i, " ".join(word() if rng.random() < 0.25 else rng.choice(own) for _ in range(rng.randrange(30, 90)))))
    labels = [(i, int(i % 3 > 0), 0) for i in range(0, 600, 2)]
    shared.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    shared.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_words_tell(shared, folder):
    got = queries.op8_importance_resampling(shared, folder).collect()
    assert len(got) == 600
    wrong = [r["doc_id"] for r in got if r["kept"] != (r["doc_id"] % 3 > 0)]
    assert len(wrong) <= 6
    # Rows without a label are judged like those with one.
    good = [(r["doc_id"] % 2, r["log_weight"]) for r in got if r["doc_id"] % 3]
    seen, new = ([w for odd, w in good if odd == x] for x in (0, 1))
    assert abs(sum(seen) / len(seen) - sum(new) / len(new)) < 0.2 * abs(sum(seen) / len(seen))


def test_forms_alone_cannot_tell(shared, folder):
    docs, labels = shared.read.parquet(f"{folder}/documents.parquet"), shared.read.parquet(f"{folder}/labels.parquet")
    got = importance.scored(docs, labels).collect()
    assert sum(r["kept"] != (r["doc_id"] % 3 > 0) for r in got) > 100
