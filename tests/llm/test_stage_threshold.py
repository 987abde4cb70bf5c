"""The pipeline's near dedup finds copies from 0.80 up."""

import corpus_pipeline

from .test_operators import shingles


def test_copies_at_80_to_85_go(spark):
    rows = []
    for k in range(40):
        words = [f"w{k}x{n}" for n in range(154)]
        at = 40 + k
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:at] + ["one"] + words[at + 1 : at + 12] + ["two"] + words[at + 13 : at + 25] + ["six"] + words[at + 26 :]))]
    sets = [shingles(t) for _, t in rows]
    assert all(0.80 <= len(a & b) / len(a | b) < 0.85 for a, b in zip(sets[::2], sets[1::2], strict=True))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()} == set(range(0, 80, 2))
