"""Exact copies of short lines, in op8 and in the pipeline."""

import corpus_pipeline
from strataspark.llm import line_dedup

ROWS = [(0, "Home\nAbout us\n\nless", "en", "s", 1), (1, "home \n\nabout  us\nlest", "en", "s", 1), (2, "menu\nmenu\n \n", "en", "s", 1), (3, "menu", "en", "s", 1), (4, "", "en", "s", 1)]
WANT = {0: "Home\nAbout us\n\nless", 1: "\nlest", 2: "menu\n \n", 3: "", 4: ""}


def test_short_lines_go_as_exact_copies(spark, tmp_path):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    op8 = {r["doc_id"]: (r["n_exact"], r["n_near"], r["n_chars"]) for r in line_dedup.op8_line_dedup(spark, str(tmp_path)).collect()}
    assert op8 == {0: (0, 0, 19), 1: (2, 0, 5), 2: (1, 0, 7), 3: (1, 0, 0), 4: (0, 0, 0)}
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}
    assert staged == {k: t for k, t in WANT.items() if k != 3}
