"""The near-duplicate stage of the pipeline: edited copies against all pairs of fingerprints."""

import random

import corpus_pipeline

from .test_simhash import plain_fingerprint, plain_groups

SCHEMA = "doc_id long, text string, source string, tags map<string,int>"


def edited(rng, text, times):
    words = text.split()
    for _ in range(times):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10_000)}"
    return " ".join(words)


def near_copies():
    rng = random.Random(4)
    texts = ["", None, " ", "one", "One", "two words"]
    for _ in range(120):
        base = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(100, 900)))
        texts += [base, edited(rng, base, 1), edited(rng, base, rng.randrange(1, 5)), base.upper(), base + " a few words more"]
    return texts


def test_stage_keeps_one_of_each_group(shared):
    texts = near_copies()
    groups = plain_groups(list(range(len(texts))), [plain_fingerprint(t) for t in texts])
    assert len(set(groups)) < len(texts) - 240  # edited copies are linked, not only equal ones
    docs = shared.createDataFrame([(i, t, "s", {"a": i}) for i, t in enumerate(texts)], SCHEMA)
    kept = corpus_pipeline.simhash_near_dedup(shared, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["tags"]["a"]) for r in kept.collect()) == sorted((g, g) for g in set(groups))


def test_linked_texts_without_ids_are_one_group(shared):
    """Ids are null throughout: the group is known by its fingerprints."""
    texts = near_copies()
    groups = plain_groups(list(range(len(texts))), [plain_fingerprint(t) for t in texts])
    docs = shared.createDataFrame([(None, t, "s", None) for t in texts], SCHEMA)
    assert corpus_pipeline.simhash_near_dedup(shared, docs, "").count() == len(set(groups))


def test_repeated_rows_become_the_smallest_of_them(shared):
    rows = [(1, "a b c d", "z", {"k": 1}), (1, "a b c d", "m", {"k": 2}), (1, "a b c d", None, None), (2, "A b c d", "a", None),
            (None, "x y z w", "q", None), (None, "x y z w", "p", None), (7, "quite other words", "o", None)]
    got = corpus_pipeline.simhash_near_dedup(shared, shared.createDataFrame(rows, SCHEMA).repartition(4), "").collect()
    assert sorted((r["doc_id"] or -1, r["text"], r["source"]) for r in got) == [
        (-1, "x y z w", "p"), (1, "a b c d", None), (7, "quite other words", "o")]
