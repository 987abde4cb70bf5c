"""Operators 11 to 13 against plain Python: url templates, hard negatives, whitening; nulls, repeats, ties, empty tables and clashing columns."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspark.llm import negatives, registry, urls, whitening

CLASHING = "id string, cell int, dist double, v string, x int, grp int, shard int, label_ int, raw string, node string, n int, rule string, host string, verdict string, bands string"
EXTRA = ("i", 1, 0.5, "v", 2, 3, 4, 5, "r", "n", 6, "r", "h", "v", "b")


def addresses():
    rnd = random.Random(3)
    hosts = ["a.example.com", "www.spam-farm.example.com", "blog.example.org", "m.x.example.net", "CASINO.example.org", "shop.test"]
    out = []
    for _ in range(700):
        h = rnd.choice(hosts)
        lang = rnd.choice(["en", "en", "de", "fr", "es"])
        end = rnd.choice(["", "/", ".html", "?q=1", "#top", "/2024-05-01/some-title", "/deadbeef01", "/a/b/c/d/e/f/g/h"])
        out.append(f"http://{h}/{lang}/{rnd.randrange(1000)}{end}")
    out += [f"http://shop.test/item/{''.join(rnd.choices('abcdefgh', k=9))}" for _ in range(80)]
    out += [None, "", "no scheme", "http://", "http://h", "x://H.Example.NET?/en/", "x://example.net/en/", "x://org/fr/", "x://a.org/fr", "ftp://É.Org/fr/é", "http://h/" + "y" * 300_000, "http://h/" + "/".join(["z"] * 3000), "://net/", "a://b://c/d", "http://h/a\nb", "http://example.net/en/\n"]
    return out + out[:5]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group() if rest[len(host) :][:1] == "/" else ""


def ruled(host, path):
    fit = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    r = max(fit, key=lambda r: len(r.host + r.path), default=None)
    return (r.host + r.path, r.verdict) if r else (None, None)


def shape(s):
    return next((n for n, p in urls.SHAPES if re.search(p.replace("^(?s)", "(?s)^"), s)), "<other>")


def tree(pages):
    """template of each (host, path) of pages [(host, path, label)], by recursion over a host's pages."""
    out = {}

    def grow(rows, d, node):
        deep = [r for r in rows if len(r[1]) > d]
        out.update((r[0], node) for r in rows if len(r[1]) <= d)
        if not deep:
            return
        count = Counter(r[1][d] for r in deep)
        kept = {s for s, n in count.items() if shape(s) in urls.WORDS and n >= urls.MIN_SHARE * len(deep) and n >= urls.MIN_PAGES}
        by = defaultdict(list)
        for r in deep:
            by["=" + r[1][d] if r[1][d] in kept else shape(r[1][d])].append(r)
        after = lambda r: shape(r[1][d + 1]) if len(r[1]) > d + 1 else ""
        counts = [[*(sum(r[2] == x for r in rs) for x in (1, 0, None)), *(sum(after(r) == x for r in rs) for x in ("", *urls._NAMES))] for rs in by.values()]
        joined = defaultdict(list)
        for name, rs in zip(urls.merged_branches(list(by), counts), by.values(), strict=True):
            joined[name] += rs
        for name, rs in joined.items():
            grow(rs, d + 1, f"{node}/{name}")

    hosts = defaultdict(list)
    for host, path, label in pages:
        segments = path[1:].split("/", urls.DEPTH - 1) if path.startswith("/") else []
        hosts[host].append(((host, path), segments, label))
    for rows in hosts.values():
        grow(rows, 0, "")
    return out


def test_url_filter_equals_plain_python(spark, tmp_path):
    own = addresses()
    d = [(None if k == 7 else k, u, *EXTRA) for k, u in enumerate(own)]
    spark.createDataFrame(d, f"page_id bigint, url string, {CLASHING}").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = [r.asDict() for r in registry.QUERIES["op11_url_filter"](spark, str(tmp_path)).collect()]
    assert Counter(r["page_id"] for r in got) == Counter(r[0] for r in d)
    pages = []
    for u in own:
        host, path = parts(u)
        _, verdict = ruled(host, path)
        bad = set(re.split("[^a-z0-9]+", host)) & set(urls.BAD_WORDS)
        pages.append((host, path, {"block": 1, "allow": 0}.get(verdict, 1 if bad else None)))
    named = tree(pages)
    bad, known = Counter(), Counter()
    for host, path, label in pages:
        if label is not None:
            known[host, named[host, path]] += 1
            bad[host, named[host, path]] += label
    prior = min(urls.MAX_PRIOR, sum(bad.values()) / sum(known.values()))
    by_id = {r["page_id"]: r for r in got}
    blocked = 0
    for k, (host, path, _) in enumerate(pages):
        r = by_id[None if k == 7 else k]
        name, verdict = ruled(host, path)
        key = (host, named[host, path])
        purity = (bad[key] + urls.PRIOR_PAGES * prior) / (known[key] + urls.PRIOR_PAGES)
        assert (r["host"], r["path"], r["rule"], r["template"], r["n_labelled"]) == (host, path, name, key[1], known[key]), own[k]
        assert math.isclose(r["purity"], purity) and r["verdict"] == (verdict or ("block" if purity >= urls.REJECT else "allow"))
        blocked += name is None and r["verdict"] == "block"
    assert blocked > 50 and not any(r["verdict"] == "block" for r in got if r["rule"] is None and r["host"] in ("a.example.com", "blog.example.org", "shop.test"))


def test_branches_merge_when_alike():
    n = lambda bad, good, none, **kinds: [bad, good, none, *(kinds.get(x.strip("<>"), 0) for x in ("end_", *urls._NAMES))]
    names = ["=en", "=fr", "=img", "<word>"]
    assert urls.merged_branches(names, [n(0, 0, 90, num=90), n(0, 0, 40, num=40), n(0, 0, 50, hex=50), n(0, 0, 9, num=9)]) == ["=en|fr", "=en|fr", "=img", "<word>"]
    assert urls.merged_branches(names[:2], [n(50, 0, 0, num=50), n(0, 0, 50, num=50)]) == ["=en", "=fr"]
    assert urls.merged_branches(names[:2], [n(6, 0, 0, num=6), n(0, 0, 1, num=1)]) == ["=en", "=fr"]


def test_url_filter_with_given_labels(spark):
    d = spark.createDataFrame([(k, f"http://h/{'bad' if k % 2 else 'good'}/{k}", k % 2 if k < 40 else None) for k in range(60)], "page_id bigint, url string, y int")
    got = {r["page_id"]: r["verdict"] for r in urls.judged(d, rules=(), label=F.col("y")).collect()}
    assert got == {k: "block" if k % 2 else "allow" for k in range(60)}


def embeddings():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(6, 8))
    out = [(k, [float(x) for x in np.float32(centre[k % 6] * (1 + k % 3) + rng.normal(size=8) * 0.4)], int(rng.integers(0, 4)) if k % 6 else 1) for k in range(700)]
    out += [(1000 + k, out[3][1], out[3][2]) for k in range(40)] + [out[5], out[5], (600, [0.0] * 8, 2)]
    out += [(None, out[1][1], 1), (900, None, 1), (1100, out[8][1], None), (901, [None, *out[2][1][1:]], 1), (902, [float("nan")] * 8, 1), (903, [float("inf"), *out[2][1][1:]], 2), (1200, [], 1), (1300, [0.5, -0.25], 2)]
    return out


def units(vector, dims=8):
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return tuple(math.floor(256 * x) for x in vector) + (0,) * (dims - len(vector))


def mined(rows):
    by_id = {}
    for i, v, label in rows:
        if i is not None and label is not None and units(v) is not None:
            # the shorter of two vectors comes first where one is a prefix
            r = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v], units(v))
            by_id[i] = min(r, by_id.get(i, r))
    out = []
    for a in (i for i in by_id if i % 100 == 0):
        score = {i: sum(p * q for p, q in zip(by_id[a][2], r[2], strict=True)) for i, r in by_id.items() if i != a}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if by_id[i][0] == by_id[a][0]][:5]:
            fit = [i for i in order if by_id[i][0] != by_id[a][0] and 30 * score[p] <= 100 * score[i] <= 90 * score[p]][:10]
            out += [(a, p, k + 1, i, score[p], score[i]) for k, i in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("sizes", [{}, {"pivots": 9, "group": 2, "shard": 100}, {"pivots": 1, "group": 1, "shard": 64}])
def test_hard_negatives_equal_all_pairs(spark, sizes):
    own = embeddings()
    d = spark.createDataFrame([(*r, *EXTRA) for r in own], f"vec_id bigint, embedding array<float>, label int, {CLASHING}").repartition(3)
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert sorted(map(tuple, negatives.hard_negatives(d, F.col("id") % 100 == 0, label, **sizes).collect())) == mined(own)


def test_cells_out_of_reach_are_left_out(spark):
    rng = np.random.default_rng(5)
    centre = np.eye(16) * 40
    d = spark.createDataFrame([(k, [float(x) for x in centre[k % 16] + rng.normal(size=16) * 0.1], k % 2) for k in range(1600)], "id bigint, x array<double>, label bigint")
    space = negatives._Space(d.select("id", "label", F.transform("x", lambda c: F.floor(c * 256)).alias("x")), 32, 500)
    every = F.expr(f"array(named_struct('pid', -1L, 'p', 0L, 'lo', {-negatives._FAR}L, 'hi', {negatives._FAR}L, 'floor', {40 * 40 * 256 * 200}L))").cast(negatives._BANDS)
    own = space.groups(space.rows.where("id % 100 = 0"), 1).withColumn("bands", every)
    reach = space.reach(own)
    assert 0 < space.rows.join(reach, "cell").where("dist between lo and hi").count() < 0.3 * own.select("grp").distinct().count() * space.n


def test_whitening_equals_dense_algebra(spark):
    own = [r for r in embeddings() if r[1] is None or len(r[1]) == 8]
    d = spark.createDataFrame([(*r, *EXTRA) for r in own], f"vec_id bigint, embedding array<float>, label int, {CLASHING}").repartition(4)
    got = defaultdict(list)
    for r in whitening.whitened(d).collect():
        got[r["component"]].append(r)
    rows = [(i, units(v)) for i, v, _ in own if units(v) is not None]
    fit = np.array(sorted({x for _, x in rows}), dtype=np.int64)
    n, total = len(fit), fit.sum(axis=0)
    c = fit - total / n
    e, vec = np.linalg.eigh(c.T @ c / n)
    assert sorted(got) == [1, 2, 3, 4]
    for k, rs in got.items():
        want = sorted(((-1 if i is None else i), int(((n * np.array(x) - total) ** 2).sum()), float((np.array(x) - total / n) @ vec[:, -k] / math.sqrt(e[-k]))) for i, x in rows)
        have = sorted(((-1 if r["vec_id"] is None else r["vec_id"]), r["deviation"], r["whitened"]) for r in rs)
        sign = 1 if np.dot([w[2] for w in want], [h[2] for h in have]) > 0 else -1
        assert [w[:2] for w in want] == [h[:2] for h in have] and np.allclose([w[2] for w in want], [sign * h[2] for h in have], atol=1e-9)
        assert all(r["n"] == n and math.isclose(r["explained"], e[-k] / e.sum(), rel_tol=1e-9) and r["identity_error"] < 1e-9 for r in rs)


def test_lanczos_restarts_on_breakdown():
    rng = np.random.default_rng(6)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    for values in ([5.0] * 7 + [1.0] * 23, [9.0, 4.0] + [0.0] * 28, list(range(30, 0, -1))):
        v = q * np.array(values) @ q.T
        e, y = whitening.block_lanczos(lambda b, v=v: v @ b, 30, 4, block=2)
        assert np.allclose(e, sorted(values)[::-1][:4], atol=1e-10) and np.allclose(y.T @ y, np.eye(4), atol=1e-12) and np.allclose(v @ y, y * e, atol=1e-9)


def test_whitening_of_few_dimensions_and_of_large_numbers(spark):
    line = [(k, [float(k), 2.0 * k]) for k in range(9)]
    got = whitening.whitened(spark.createDataFrame(line, "vec_id bigint, embedding array<double>")).collect()
    assert {r["component"] for r in got} == {1} and all(math.isclose(r["explained"], 1) for r in got) and math.isclose(sum(r["whitened"] ** 2 for r in got), 9)
    assert whitening.whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id bigint, embedding array<double>")).count() == 0
    big = [(0, [0.0, 0.0]), (1, [4e12, 1.0]), (2, [1.0, 4e12]), (3, [])]
    assert {r["deviation"] for r in whitening.whitened(spark.createDataFrame(big, "vec_id bigint, embedding array<double>")).collect()} == {None}


@pytest.mark.parametrize("name,table,columns", [("op11_url_filter", "pages", "page_id bigint, url string"), ("op12_hard_negatives", "embeddings", "vec_id bigint, embedding array<float>, label int"), ("op13_embedding_whitening", "embeddings", "vec_id bigint, embedding array<float>, label int")])
def test_empty_tables(spark, tmp_path, name, table, columns):
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/{table}.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).count() == 0
