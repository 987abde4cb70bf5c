"""MinHash near-duplicate detection with tensored banding.

A document's set is its distinct word shingles. Two small collections of hash bundles are computed, each bundle
over `rows` minhashes; every pair of a bundle of the first collection with one of the second makes a table key. So
m * m tables of 2 * rows hashes each cost 2 * m * rows minhashes a document instead of 2 * m * m * rows. A pair at
similarity s meets in a table with probability (1 - (1 - s**rows)**m)**2; at 0.85 with rows 3, m 12 it is missed
2 times in 100,000, above that less. Candidates are confirmed on the full sets.

Only table keys of two bundles that both repeat can repeat, so only those are formed. Documents with equal sets are
one class from the start. In a first round every member is compared with one other, the most central
member of its tables, the one that meets most others in its own tables, which is mostly the text that a group was copied
from. Confirmed links are merged into components, and tables within one component are done with, so a large group of
copies costs about one comparison a member. Of the others that share a table with another component, pairs are formed by a
positional prefix of their rarest shingles and ruled out by the heads of these lists, so that texts of one template
aren't all compared with each other. Pairs within the largest component of a shingle aren't formed. No pair that shares
a table and could join two components is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .components import connected_components

#: Up to this many ids of documents to confirm are broadcast, so that only their texts are dealt out; they are counted first.
SMALL_IDS = 200_000
#: Of the minhashes of a pair, a share of threshold - SLACK at least must agree before full sets are compared. At 0.85
#: and 72 hashes a smaller share has a probability of about 1e-6.
SLACK = 0.2
_LOW7 = 0x007F7F7F7F7F7F7F


class _WordHashes(dict):
    """64-bit hashes of words; emptied when it is large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of size words; with fewer words, of the whole sequence; none for no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        total = _mixed(total + h[k : len(h) - width + k + 1] * _STEPS[k % len(_STEPS)])
    return np.unique(total)


def _signer(size: int, m: int, rows: int, seed: int):
    rng = np.random.default_rng(seed)
    flip, odd = (rng.integers(0, 1 << 32, (2 * m * rows, 1), dtype=np.uint32) for _ in range(2))
    odd |= np.uint32(1)
    scale = (rng.integers(0, 1 << 63, rows, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)

    pad = -2 * m * rows % 7

    def signed(text: str | None):
        s = shingle_hashes(text, size)
        if not len(s):
            return 0, None, None, None
        h = (s >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(flip), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(h), 4096):
            x = (h[None, at : at + 4096] ^ flip) * odd
            np.minimum(low, (x ^ (x >> np.uint32(15))).min(axis=1), out=low)
        bundles = _mixed((low.reshape(2 * m, rows).astype(np.uint64) * scale).sum(axis=1, dtype=np.uint64) + np.arange(2 * m, dtype=np.uint64))
        sketch = np.zeros((len(low) + pad, 1), np.uint8)
        sketch[: len(low), 0] = low & np.uint32(255)
        sketch = np.pad(sketch.reshape(-1, 7), ((0, 0), (0, 1)))
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), bundles.view(np.int64), sketch.view("<i8").ravel()

    return signed


_SIGNED = "id bigint, n_shingles bigint, class binary, bundles array<bigint>, sketch array<bigint>"


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, m: int = 12, rows: int = 3, seed: int = 7) -> DataFrame:
    """One row a document: id, n_shingles, class (digest of its set), its 2 * m bundles, and a byte of each minhash, seven to a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = _signer(size, m, rows, seed)
        for batch in small(batches):
            if batch.num_rows:
                n, classes, bundles, sketches = zip(*map(signed, batch.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(classes, pa.binary()), pa.array(bundles, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["id", "n_shingles", "class", "bundles", "sketch"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, _SIGNED)


def table_members(classes: DataFrame, m: int = 12) -> DataFrame:
    """(table, id) for the table keys that two classes or more share; classes has id and bundles."""
    b = classes.select("id", F.posexplode("bundles").alias("k", "bundle"))
    repeated = b.groupBy("bundle").agg(F.count("*").alias("n")).where("n > 1").select("bundle")
    own = b.join(repeated, "bundle").groupBy("id").agg(F.collect_set(F.when(F.col("k") < m, F.col("bundle"))).alias("first"), F.collect_set(F.when(F.col("k") >= m, F.col("bundle"))).alias("second"))
    keys = own.where("size(first) > 0 and size(second) > 0").select("id", "second", F.explode("first").alias("x")).select("id", "x", F.explode("second").alias("y"))
    keys = keys.select(F.xxhash64("x", "y").alias("table"), "id")
    shared = keys.groupBy("table").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("table")
    return keys.join(shared, "table")


def _tables_meet(m: int) -> str:
    """SQL: whether the structs x and y share a table key, a bundle of each of the two collections."""
    return " and ".join(f"arrays_overlap(slice(x.bundles, {k}, {m}), slice(y.bundles, {k}, {m}))" for k in (1, m + 1))


def ranked_shingles(docs: DataFrame, threshold: int, size: int = 5) -> DataFrame:
    """id, n, common, first, head: of each of docs(id, text) the shingles that another of them has as well, rarest first.

    They are numbers that order shingles by how many ids have them, then by hash. common is how many there are, n how many
    shingles in all. Two sets of similarity threshold have so many in common that one stands among the first
    n - ceil(threshold * n / 100) + 1 shingles of each; those that no other has stand before all others, so first is
    what they leave of that. head has twice as many, where there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            for i, t in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                s = shingle_hashes(t, size)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i.as_py())), pa.array(s.view(np.int64)), pa.array(np.full(len(s), len(s)))], names=["id", "shingle", "n"])

    own = stored(docs.select("id", "text").mapInArrow(run, "id bigint, shingle bigint, n bigint"))
    df = stored(own.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1"))
    code = "shiftleft(least(df, 1048575), 43) | shiftrightunsigned(shingle, 21)"
    lists = own.join(df, "shingle").groupBy("id", "n").agg(F.sort_array(F.collect_list(F.expr(code))).alias("s")).withColumn("common", F.size("s"))
    lists = lists.withColumn("first", F.expr(f"cast(greatest(0, common - ceil({threshold} * n / 100) + 1) as int)"))
    return lists.select("id", "n", "common", "first", F.slice("s", F.lit(1), F.col("first") * 2).alias("head"))


def _heads_allow(pairs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of pairs(a, b, x, y) whose heads leave room for the threshold; x and y have n, common and head.

    Up to where the shorter head ends, what both have in common is counted; beyond, it is at most what the smaller rest has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            able = []
            sizes = zip(*(batch.column(k).to_pylist() for k in range(2, 6)), strict=True)
            for (n, c, v, d), x, y in zip(sizes, batch.column(6), batch.column(7), strict=True):
                x, y = x.values.to_numpy(zero_copy_only=False), y.values.to_numpy(zero_copy_only=False)
                ends = [h[-1] for h, all_of in ((x, c), (y, d)) if len(h) < all_of]
                i, j = (int(np.searchsorted(h, min(ends), "right")) if ends else len(h) for h in (x, y))
                both = len(np.intersect1d(x[:i], y[:j], assume_unique=True)) + min(c - i, d - j)
                able.append((100 + threshold) * both >= threshold * (n + v))
            yield pa.RecordBatch.from_arrays([col.filter(pa.array(able, pa.bool_())) for col in batch.columns[:2]], names=["a", "b"])

    return pairs.select("a", "b", "x.n", "x.common", F.col("y.n").alias("v"), F.col("y.common").alias("d"), "x.head", F.col("y.head").alias("other")).mapInArrow(run, "a bigint, b bigint")


def _alike(x: str, y: str, m: int, rows: int, threshold: int) -> str:
    """SQL: whether the sizes and sketches of the structs x and y allow the threshold.

    Bytes that agree are zero in the exclusive or; each leaves one bit of the expression that is counted.
    """
    n = 2 * m * rows
    numbers = -(-n // 7)
    differ = [f"(get({x}.sketch, {k}) ^ get({y}.sketch, {k}))" for k in range(numbers)]
    equal = " + ".join(f"bit_count(~(((({d} & {_LOW7}) + {_LOW7}) | {d}) | {_LOW7}) & {0x0080808080808080})" for d in differ)
    least = int((threshold / 100 - SLACK) * n) + (7 * numbers - n)
    return f"100 * least({x}.n, {y}.n) >= {threshold} * greatest({x}.n, {y}.n) and {equal} >= {least}"


def confirmed(pairs: DataFrame, docs: DataFrame, threshold: int, size: int = 5) -> DataFrame:
    """The pairs (a, b) of ids of docs(id, text) with 100 * intersection >= threshold * union of their full shingle sets."""
    wanted = stored(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select("b").distinct()).distinct())
    if wanted.count() <= SMALL_IDS:
        wanted = F.broadcast(wanted)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_hashes(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    own = stored(docs.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(sets, "id bigint, set binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            same = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(100 * both >= threshold * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    p = pairs.join(own.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(own.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return p.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _labels(reps: DataFrame, links: DataFrame) -> DataFrame:
    """id and c, the smallest id reachable over links(a, b), of each id of reps."""
    comp = stored(connected_components(links).withColumnRenamed("node", "id"))
    return reps.select("id").distinct().join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("c"))


def remaining_pairs(reps: DataFrame, members: DataFrame, texts: DataFrame, label: DataFrame, threshold: int, size: int, m: int, rows: int) -> DataFrame:
    """The pairs (a, b) of ids of different components that share a table and may reach the threshold, but for one with the largest component's own.

    reps has id, n_shingles, bundles and sketch, members (table, id), label id and its component c. Pairs are formed by
    a shingle that both have near the front of their rarest ones: so far in front that what follows is enough. So texts of
    one template are paired by the rare parts that they share and not by the frequent ones, and what is left after the heads are compared
    is about as many as there are links.
    """
    tagged = members.join(label, "id")
    tables = tagged.groupBy("table").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("table")
    left = stored(tagged.join(tables, "table").select("id", "c").distinct())
    # an intersection is no larger than what a set has in common with any other
    ranked = stored(ranked_shingles(texts.join(left, "id", "left_semi"), threshold, size).join(left, "id").where(f"100 * common >= {threshold} * n"))
    keys = ranked.select("id", "c", "n", "common", F.posexplode(F.expr("slice(head, 1, first)")).alias("at", "code"))
    main = keys.groupBy("code", "c").agg(F.count("*").alias("k")).groupBy("code").agg(F.count("*").alias("cs"), F.max_by("c", F.struct("k", "c")).alias("main")).where("cs > 1").select("code", "main")
    keys = stored(keys.select("id", "c", "n", "code", F.expr("common - at").alias("rest")).join(main, "code"))
    p, q = (t.select("code", "main", F.struct("id", "c", "n", "rest").alias(k)) for k, t in (("p", keys.where("c <> main")), ("q", keys)))
    enough = f"{100 + threshold} * least(p.rest, q.rest) >= {threshold} * (p.n + q.n) and 100 * least(p.n, q.n) >= {threshold} * greatest(p.n, q.n)"
    pairs = p.join(q.drop("main"), "code").where(f"p.c <> q.c and (q.c = main or p.id < q.id) and {enough}")
    pairs = pairs.select(F.least("p.id", "q.id").alias("a"), F.greatest("p.id", "q.id").alias("b")).distinct()
    own = ranked.join(reps.select("id", "bundles", "sketch"), "id").select("id", F.struct("n", "common", "head", "bundles", "sketch").alias("x"))
    pairs = pairs.join(own.withColumnRenamed("id", "a"), "a").join(own.select(F.col("id").alias("b"), F.col("x").alias("y")), "b")
    return _heads_allow(pairs.where(f"{_tables_meet(m)} and {_alike('x', 'y', m, rows, threshold)}"), threshold)


def minhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 85, size: int = 5, m: int = 12, rows: int = 3, seed: int = 7) -> DataFrame:
    """Near-duplicate components: one row a document with doc_id, n_shingles, class_id, n_links, component_id, kept.

    Words are the runs of characters other than ASCII white space of the text, A-Z lower-cased; texts of any length count whole. Null, empty and blank
    texts have no shingles and are linked with nothing. A text of fewer than `size` words is one shingle, so it is
    linked with texts of the same words. class_id is the smallest id with the same set, n_links the number of links
    of that class with other classes that were confirmed, component_id the smallest id reachable over links,
    kept whether the document is that one. Rows with a null id count as copies of no one and stay (component_id null,
    kept true). Repeated rows stay repeated and get equal values. Of rows with one id and different texts each gets the
    values of its own text's class; an id that is the smallest of several classes joins them. Other columns of docs are
    ignored; an empty table gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stored(signatures(base, "id", "text", size, m, rows, seed))
    known = signed.where("id is not null and n_shingles > 0")
    heads = known.groupBy("class").agg(F.min("id").alias("id"))
    # a set of under threshold / (100 - threshold) shingles has no partner but its equals
    reps = stored(known.where(f"n_shingles * (100 - {threshold}) >= {threshold}").join(heads, ["class", "id"], "left_semi").dropDuplicates(["id", "class"]))
    members = stored(table_members(reps, m))
    texts = base.where("id is not null")

    alike = _alike("x", "y", m, rows, threshold)
    brief = reps.select("id", F.struct(F.col("id"), F.col("n_shingles").alias("n"), "sketch").alias("x"))

    def links_of(pairs: DataFrame) -> DataFrame:
        return stored(confirmed(stored(pairs.select("a", "b").distinct()), texts, threshold, size))

    sizes = members.groupBy("table").agg(F.count("*").alias("n"))
    degree = members.join(sizes, "table").groupBy("id").agg(F.sum("n").alias("degree"))
    tagged = stored(members.join(degree, "id"))
    # each member with the hub of most of its tables
    hub = tagged.groupBy("table").agg(F.max_by(F.struct("id", "degree"), F.struct("degree", -F.col("id"))).alias("hub"))
    met = tagged.join(hub, "table").where("id <> hub.id").groupBy("id", F.col("hub.id").alias("hub")).agg(F.count("*").alias("n"), F.max("hub.degree").alias("degree"))
    met = met.groupBy("id").agg(F.max_by("hub", F.struct("n", "degree", -F.col("hub"))).alias("hub"))
    pairs = met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    links = links_of(pairs.join(brief.withColumnRenamed("id", "a"), "a").join(brief.select(F.col("id").alias("b"), F.col("x").alias("y")), "b").where(alike))
    label = _labels(reps, links)
    left = stored(remaining_pairs(reps, members, texts, label, threshold, size, m, rows))
    found = links_of(left)
    if not found.isEmpty():
        links = links.union(found)
        label = _labels(reps, links)
    links = links.distinct()
    out = heads.withColumnRenamed("id", "class_id")
    ends = links.select(F.col("a").alias("class_id")).union(links.select("b")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    out = out.join(ends, "class_id", "left").join(label.select(F.col("id").alias("class_id"), F.col("c").alias("component")), "class_id", "left")
    rest = signed.where("id is null or n_shingles = 0").select("id", "n_shingles")
    out = known.select("id", "n_shingles", "class").join(out, "class").drop("class").unionByName(rest, allowMissingColumns=True)
    return out.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "class_id", "id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents, at 0.85 on five-word shingles."""
    return minhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
