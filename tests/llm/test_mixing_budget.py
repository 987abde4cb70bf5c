"""The pipeline's mixture against a stray rare cell."""

import corpus_pipeline


def test_a_tiny_cell_hardly_changes_the_mixture(spark):
    rows = [(k, "w " * 50, "hot" if k % 3 == 0 else f"s{k % 19}", "en" if k % 10 < 7 else "fr" if k % 10 < 9 else "de") for k in range(3000)]
    stray = [(5000 + k, "w", "rare", "xx") for k in range(3)]
    schema = "doc_id bigint, text string, source string, lang string"

    def kept(rows):
        out = corpus_pipeline.sample_mixture(spark, spark.createDataFrame(rows, schema), "")
        return {r["doc_id"] for r in out.select("doc_id").collect()}

    before, after = kept(rows), kept(rows + stray)
    assert {r[0] for r in stray} <= after
    assert abs(len(before) - len(after - {r[0] for r in stray})) < 0.06 * len(rows) and len(after) > 0.65 * len(rows)
