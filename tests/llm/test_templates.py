"""Many texts of one template: pairs to confirm follow the links that there are, not the square of the texts."""

import random

import pytest

from strataspark.llm import minhash

from .test_operators import shingles


def template(n, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(120)]
    texts = {}
    while len(texts) < n:
        own = list(words)
        for slot in (15, 45, 75, 105):
            own[slot] = f"slot{slot}v{rng.randrange(8)}"
        texts[" ".join(own)] = None
    return list(texts)


def linked(texts, threshold):
    sets = [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])]
    component = list(range(len(sets)))

    def find(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, j in links:
        a, b = sorted((find(i), find(j)))
        component[b] = a
    return [find(i) for i in range(len(sets))], len(links)


@pytest.mark.parametrize(("threshold", "n"), [(80, 150), (85, 300)])
def test_pairs_follow_links(spark, monkeypatch, threshold, n):
    formed = []
    confirmed = minhash.confirmed

    def counted(pairs, *args):
        formed.append(pairs.count())
        return confirmed(pairs, *args)

    monkeypatch.setattr(minhash, "confirmed", counted)
    texts = template(n)
    # a second template, longer, whose texts have words of their own too
    texts += [" ".join(f"{w}b" if k % 40 else f"own{k}of{i // 2}" for k, w in enumerate(t.split() * 2)) for i, t in enumerate(texts[: n // 2])]
    component, links = linked(texts, threshold)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    out = {r["doc_id"]: r["component_id"] for r in minhash.minhash_components(docs, threshold=threshold).collect()}
    assert [out[k] for k in range(len(texts))] == component
    star, rest = formed[-2:]
    assert star <= len(texts) and rest <= 2 * links + len(texts)
