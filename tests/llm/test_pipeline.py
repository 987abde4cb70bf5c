"""The pipeline's stages against brute force, one after the other, and run() against the stages."""

import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataspark.llm import line_dedup, mixing, registry
from strataspark.llm.common import stored

from .test_operators import components, corpus_of, distance, edited, prose, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(8)
    texts = []
    for k in range(130):
        base = "\n".join(prose(rnd.randrange(8, 20), rnd) for _ in range(rnd.randrange(1, 6)))
        texts.append(base + (" oafish grumpled" if k % 6 == 0 else ""))
        if k % 4 == 0:
            texts.append(" ".join(edited(line, 1, rnd) for line in base.split("\n")) + " " + prose(2, rnd))
        if k % 10 == 0:
            texts.append(base)
    texts += [None, "", " \n ", "short"]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 4}", None if t is None else len(t)) for k, t in enumerate(texts)]
    at = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, int("grumpled" in (t or ""))) for k, t in enumerate(texts)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stored(stage[name](spark, docs, folder))
        if name != "packing":
            assert out.columns == COLUMNS
        return out

    clean = step("toxicity", docs)
    assert {i for i, _ in corpus_of(clean)} == {i for i, t in corpus_of(docs) if "grumpled" not in (t or "")}

    lined = step("line_dedup", clean)
    seen: list[str] = []
    want = {}
    for i, t in sorted(corpus_of(clean)):
        kept = []
        for line in (t or "").split("\n"):
            f = line_dedup.normal(line)
            if len(f) < line_dedup.MIN_CHARS:
                kept.append(line)
                continue
            if not any(f == x or abs(len(f) - len(x)) <= 2 and distance(f, x) <= 2 for x in seen):
                kept.append(line)
            seen.append(f)
        if "".join(kept).strip() or not (t or "").strip():
            want[i] = None if t is None else "\n".join(kept)
    assert dict(corpus_of(lined)) == want
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lined.collect())

    single = step("minhash_near_dedup", lined)
    sets = {i: shingles(t) for i, t in want.items()}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert {i for i, _ in corpus_of(single)} == {i for i, c in components(sets, links).items() if i == c}

    sampled = step("mixing", single)
    c = duckdb.connect()
    documents = single.toPandas()  # noqa: F841 - the SQL reads it by name
    # what the scaling of the SQL keeps, and more up to the budget
    kept = {i for i, _ in corpus_of(sampled)}
    assert {r[0] for r in c.execute(f"select doc_id from ({mixing.OP2_SQL}) where sampled").fetchall()} <= kept
    tokens = {i: len((t or "").split()) for i, t in corpus_of(single)}
    assert sum(tokens[i] for i in kept) > (mixing.BUDGET - 0.1) * sum(tokens.values())

    packed = step("packing", sampled).collect()
    assert {r["doc_id"] for r in packed} == {i for i, _ in corpus_of(sampled)}
    sums: dict = {}
    for r in packed:
        sums[r["sequence_id"]] = sums.get(r["sequence_id"], 0) + r["length"]
    assert max(sums.values()) <= 2048
    whole = corpus_pipeline.run(spark, folder)
    key = lambda rows: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows)
    assert key(whole.collect()) == key(packed)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got, want = registry.QUERIES[name](spark, sf_dir).toPandas(), c.execute(registry.SQL[name]).df()
    got, want = (d[sorted(d.columns)].sort_values(sorted(d.columns), ignore_index=True) for d in (got, want))
    assert list(got.columns) == list(want.columns) and (got.astype(str) == want.astype(str)).all().all()


def test_every_operator_has_its_query():
    assert {int(n[2:].split("_")[0]) for n in registry.QUERIES if n.startswith("op")} == set(range(1, 14))


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{top}/strataspark", tmp_path / "strataspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{top}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 50)"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert said.stdout.split() == ["0", "True"], said.stderr


def test_shapes_of_the_sample(spark, folder):
    assert spark.read.parquet(f"{folder}/documents.parquet").where(F.col("text").isNull()).count() == 1
