"""Greek capitals before joined punctuation: lower-casing by context must not hide an occurrence."""

from codetide.llm import decontaminate


def test_final_sigma_before_joined_punctuation(shared):
    words = [f"w{i}" for i in range(13)]
    words[6] = "ΛΟΓΟΣ"
    item, text = " ".join(words), " ".join(words).replace("ΛΟΓΟΣ w7", "ΛΟΓΟΣ.w7")
    docs = shared.createDataFrame([(1, text), (2, "nothing here")], "doc_id long, text string")
    benchmark = shared.createDataFrame([(5, item)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"]) for r in decontaminate.report(docs, benchmark).collect()}
    assert got == {1: (13, True), 2: (0, False)}
