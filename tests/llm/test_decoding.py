"""Restoring of disguised words against every reading of their lattices, at any length and beyond the model's letters."""

import itertools
import random

import numpy as np
import pytest

from strataspark.llm import toxicity as t


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 3, (t._K, t._K, t._K))
    for word in ("grumpled", "idiot", "oaf", "moron") * 400:
        s = [0, 0, *(t._AT[c] for c in word), 0]
        for a, b, c in zip(s, s[1:], s[2:], strict=False):
            counts[a, b, c] += 1
    return t.char_model(counts)


def cost_of(letters, spent, model):
    s = [0, 0, *(t._AT.get(c, 0) for c in letters), 0]
    return spent + sum(float(model[a, b, c]) for a, b, c in zip(s, s[1:], s[2:], strict=False))


def readings(token):
    """Every (letters, cost) of a token: a run of a character stands for one or two of a letter it may mean, or for nothing."""
    per_run = []
    for c, run in itertools.groupby(token.lower()):
        n = len(list(run))
        meant = [(c, 0.0)] * c.isalpha() + [(x, 0.7) for x in t.DISGUISES.get(c, "")]
        options = [(x, k + 0.5 * (n == 2)) for x, k in meant] + [(2 * x, k + 0.5 * (n > 2)) for x, k in meant if n > 1]
        if c in ".-_*~·'#%^=/\\ " or c in t.DISGUISES and n > 1 or not options:
            options.append(("", 1.0))
        per_run.append(options)
    for way in itertools.product(*per_run):
        yield "".join(x for x, _ in way), sum(k for _, k in way)


def test_decoding_finds_the_cheapest_reading(model):
    rnd = random.Random(4)
    for _ in range(300):
        word = rnd.choice(("grumpled", "idiot", "oaf", "moron", "dust"))
        token = "".join({"i": "!", "o": "0", "e": "3"}.get(c, c) if rnd.random() < 0.4 else c * rnd.choice((1, 1, 1, 2, 3)) for c in word)
        token = token if rnd.random() < 0.7 else ".".join(token[:6])
        said = t.decode(token, model)
        every = [(cost_of(letters, spent, model), letters) for letters, spent in readings(token)]
        best = min(every)[0]
        assert any(x == said and c <= best + 1e-4 for c, x in every), (token, said)


def test_long_tokens_are_restored(model):
    r = t.Restored(model)
    assert r["gr" + "u" * 300 + "mpled"] == "grumpled" and r["1d" + "i" * 80 + "0t"] == "idiot"
    assert r["idi0t" * 60] == "idiot" * 60 and r["-".join("grumpled")] == "grumpled"
    assert " ".join(r.words("so " + " ".join("grumpled") + " now")).endswith("grumpled")
    assert all(len(k) <= t.REMEMBERED for k in r)


def test_letters_beyond_the_model_stay(model):
    r = t.Restored(model)
    assert r["дурак"] == "дурак" and r["дуууурак"] == "дурак" and r["д-у-р-а-к"] == "дурак" and r["ł0t"].startswith("ł")
