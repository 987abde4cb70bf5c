"""Hard negatives by a distributed nearest-neighbour join over Voronoi cells.

The largest inner product becomes the smallest distance when each vector gets one more coordinate that makes all norms
equal (and anchors get 0 there): |q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors go to the cell of their nearest pivot and keep that
distance. Anchors of neighbouring cells form groups. A group first meets the vectors of its own cells; the scores found
there bound how far a better one can lie, and by the triangle inequality a vector of another cell can only serve an anchor
if its distance to its pivot is in a range. So a vector goes to the groups whose ranges hold it, and there, in shards
of bounded size, all products are taken exactly. Shards return their first rows, which are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .vectors import padded, usable, whole

#: Pivots, and the anchors of a group and vectors of a shard that one task takes products of, about.
PIVOTS, GROUP, SHARD = 64, 2048, 16384
#: Rows of products that a task holds at a time.
_AT_ONCE = 128
_FAR = np.iinfo(np.int64).max // 4
_BANDS = "array<struct<pid:bigint,p:bigint,lo:bigint,hi:bigint,floor:bigint>>"
_FOUND = "anchor bigint, pid bigint, p bigint, other bigint, score bigint"


def _matrix(column, dims: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dims).astype(np.float64 if kind in ("<i2", "<i4") else np.int64)


def _products(kind: str, dims: int, largest: int):
    """The function that takes exact products of two matrices."""
    if dims * largest**2 < 1 << 53:
        return lambda a, b: (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return lambda a, b: a.astype(np.int64) @ b.astype(np.int64).T


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest of those left."""
    left, order = set(range(1, len(pivots))), [0]
    while left:
        order.append(min(left, key=lambda k: (np.linalg.norm(pivots[k] - pivots[order[-1]]), k)))
        left.remove(order[-1])
    return order


def _raised(x: np.ndarray, norm: float) -> np.ndarray:
    """The vectors with the coordinate that makes their squared norms equal norm."""
    return np.hstack([x, np.sqrt(np.maximum(norm - (x**2).sum(axis=1, keepdims=True), 0))])


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * a @ b.T, 0))


class _Space:
    """Vectors in their cells, and what the driver knows of the cells: pivots and ranges of distances, no more than PIVOTS of each."""

    def __init__(self, base: DataFrame, pivots: int, shard: int):
        base, self.dims = padded(base)
        big, norm, self.n = base.agg(F.max(F.array_max(F.transform("x", F.abs))), F.max(F.aggregate("x", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), F.count("*")).first()
        self.largest, self.norm = int(big or 0), float(norm or 0.0)
        if self.dims * self.largest**2 >= 1 << 63:
            raise ArithmeticError("inner products don't fit 64 bits")
        self.kind = next(k for k, m in (("<i2", 1 << 15), ("<i4", 1 << 31), ("<i8", 1 << 63)) if self.largest < m)
        first = base.select("x", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(pivots).collect()
        self.pivots = _raised(np.array([r["x"] for r in first], float).reshape(len(first), self.dims), self.norm)
        self.shards = max(1, -(-self.n // shard))
        dims, kind, p, norm = self.dims, self.kind, self.pivots, self.norm

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches, 4096):
                if not batch.num_rows:
                    continue
                x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                d = _apart(_raised(x.astype(float), norm), p)
                cell = d.argmin(axis=1)
                v = [r.tobytes() for r in x.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell]), pa.array(v, pa.binary())], names=["id", "label", "cell", "dist", "v"])

        self.rows = stored(base.select("id", "label", "x").mapInArrow(run, "id bigint, label bigint, cell int, dist double, v binary"))
        near, far = np.full(len(p), np.inf), np.full(len(p), -np.inf)
        for r in self.rows.groupBy("cell").agg(F.min("dist"), F.max("dist")).collect():
            near[r[0]], far[r[0]] = r[1], r[2]
        self.near, self.far = near, far

    def groups(self, anchors: DataFrame, group: int) -> DataFrame:
        """anchors with the group of each: runs of neighbouring cells, and parts of cells with more anchors than a group takes."""
        count = {r[0]: r[1] for r in anchors.groupBy("cell").count().collect()}
        start, parts, at, held = {}, {}, 0, 0
        for c in _chain(self.pivots) if len(self.pivots) else []:
            if held and held + count.get(c, 0) > group:
                at, held = at + 1, 0
            start[c], parts[c] = at, max(1, -(-count.get(c, 0) // group))
            at, held = (at + parts[c], 0) if parts[c] > 1 else (at, held + count.get(c, 0))
        if not start:
            return anchors.withColumn("grp", F.lit(0))
        own = lambda m: F.create_map(*(F.lit(x) for kv in m.items() for x in kv))[F.col("cell")]
        return anchors.withColumn("grp", (own(start) + F.pmod(F.xxhash64("id"), own(parts))).cast("int"))

    def reach(self, anchors: DataFrame) -> DataFrame:
        """grp, cell, lo, hi: the distances to a cell's pivot at which a vector may serve an anchor of the group."""
        dims, kind, p, near, far, norm = self.dims, self.kind, self.pivots, self.near, self.far, self.norm
        slack = 1e-6 * (1 + 2 * norm**0.5)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in small(batches, 2048):
                best = {}
                q = _matrix(batch.column(1).to_pylist(), dims, kind).astype(float)
                to = _apart(np.hstack([q, np.zeros((len(q), 1))]), p)
                length = (q**2).sum(axis=1) + norm
                for g, b, d, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), to, length, strict=True):
                    least = min((max(x["lo"], x["floor"]) for x in b if max(x["lo"], x["floor"]) <= x["hi"]), default=None)
                    if least is None:
                        continue
                    reach = max(s - 2.0 * least, 0) ** 0.5 + slack
                    within = max(s - 2.0 * max(x["hi"] for x in b), 0) ** 0.5 - slack
                    lo, hi = np.maximum(np.maximum(d - reach, within - d), near), np.minimum(d + reach, far)
                    lo, hi = np.where(lo <= hi, lo, np.inf), np.where(lo <= hi, hi, -np.inf)
                    before = best.get(g)
                    best[g] = (lo, hi) if before is None else (np.minimum(lo, before[0]), np.maximum(hi, before[1]))
                for g, (lo, hi) in best.items():
                    c = np.flatnonzero(lo <= hi)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(c), g, np.int32)), pa.array(c.astype(np.int32)), pa.array(lo[c]), pa.array(hi[c])], names=["grp", "cell", "lo", "hi"])

        found = anchors.select("grp", "v", "bands").mapInArrow(run, "grp int, cell int, lo double, hi double")
        return found.groupBy("grp", "cell").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def meet(self, anchors: DataFrame, reach: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k rows of each anchor's bands, of its own label (same) or of others, a shard of the vectors that reach lets through."""
        dims, kind, times = self.dims, self.kind, _products(self.kind, self.dims, self.largest)
        shard = F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(self.shards)).cast("int")
        there = self.rows.join(reach, "cell").where("dist between lo and hi").select("grp", shard.alias("shard"), "id", "label", "v")
        here = anchors.select("grp", F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"), "id", "label", "v", "bands")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(a) and len(b):
                b = b.sort_values("id")
                ids, labels, y = b["id"].to_numpy(), b["label"].to_numpy(), _matrix(b["v"], dims, kind)
                for at in range(0, len(a), _AT_ONCE):
                    part = a.iloc[at : at + _AT_ONCE]
                    scores = times(_matrix(part["v"], dims, kind), y)
                    for own, label, bands, s in zip(part["id"], part["label"], part["bands"], scores, strict=True):
                        open_ = (labels == label) & (ids != own) if same else labels != label
                        for x in bands:
                            w = np.flatnonzero(open_ & (s >= max(x["lo"], x["floor"])) & (s <= x["hi"]))
                            if len(w) > k:
                                w = w[s[w] >= np.partition(s[w], len(w) - k)[len(w) - k]]
                            w = w[np.argsort(-s[w], kind="stable")][:k]  # ids ascend
                            out += [(own, x["pid"], x["p"], i, v) for i, v in zip(ids[w].tolist(), s[w].tolist(), strict=True)]
            return pd.DataFrame(out, columns=["anchor", "pid", "p", "other", "score"])

        return here.groupBy("grp", "shard").cogroup(there.groupBy("grp", "shard")).applyInPandas(run, _FOUND)

    def nearest(self, anchors: DataFrame, k: int, same: bool) -> DataFrame:
        """The first k rows of each band of each anchor, with their rank: own cells first, then all that their scores leave within reach."""
        home = anchors.select("grp", "cell").distinct()
        found = stored(first(self.meet(anchors, self.reach(anchors).join(home, ["grp", "cell"], "left_semi"), k, same), k))
        kth = found.where(f"rank = {k}").groupBy(F.col("anchor").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("pid", "score"))).alias("kth"))
        bands = F.transform("bands", lambda x: F.struct(x["pid"].alias("pid"), x["p"].alias("p"), x["lo"].alias("lo"), x["hi"].alias("hi"), F.coalesce(F.col("kth")[x["pid"]], x["floor"]).alias("floor")))
        bound = anchors.join(kth, "id", "left").withColumn("bands", bands).drop("kth")
        rest = stored(self.reach(bound).join(home, ["grp", "cell"], "left_anti"))
        if rest.isEmpty():
            return found
        return stored(first(found.drop("rank").unionByName(self.meet(bound, rest, k, same)), k))


def first(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each band, the highest scores first and then the smallest ids."""
    w = Window.partitionBy("anchor", "pid").orderBy(F.desc("score"), "other")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchor, label, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, pivots: int = PIVOTS, group: int = GROUP, shard: int = SHARD) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchor and label are columns over id and label: which rows are anchors, and the label that counts. Scores are inner products of
    the vectors as whole numbers. Positives are an anchor's first rows of its label; the negatives of each are the first rows of other
    labels whose score is low to high per cent of the positive's. Rows with a null id, label or vector and those with a null or
    non-finite component take no part. Of rows with one id the one with the smallest label, then vector, counts. Ties go to
    smaller ids. Shorter vectors count as if zeros followed; empty ones score 0. Positive scores below 0 leave no range and so no
    negatives. Other columns are ignored; an empty table gives an empty result. Scores beyond 64 bits are an error.
    """
    usable_ = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)))
    base = usable_.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), whole(F.col(vector_col)).alias("x"))
    base = stored(base.select("id", label.cast("bigint").alias("label"), "x"))
    twice = stored(base.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if not twice.isEmpty():
        one = base.join(twice, "id", "left_semi").groupBy("id").agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")
        base = stored(base.join(twice, "id", "left_anti").unionByName(one))
    space = _Space(base, pivots, shard)
    own = space.groups(space.rows.where(anchor).drop("dist"), group)
    every = F.array(F.struct(F.lit(-1).alias("pid"), F.lit(0).alias("p"), F.lit(-_FAR).alias("lo"), F.lit(_FAR).alias("hi"), F.lit(-_FAR).alias("floor"))).cast(_BANDS)
    own = stored(own.withColumn("bands", every))
    best = space.nearest(own, positives, True)
    # low p <= 100 n <= high p, in whole numbers
    lo, hi = F.expr(f"-((-{low} * score - pmod(-{low} * score, 100)) div 100)"), F.expr(f"({high} * score - pmod({high} * score, 100)) div 100")
    band = best.select(F.col("anchor").alias("id"), F.struct(F.col("other").alias("pid"), F.col("score").alias("p"), lo.alias("lo"), hi.alias("hi"), F.lit(-_FAR).alias("floor")).alias("b")).where("b.lo <= b.hi")
    bands = band.groupBy("id").agg(F.sort_array(F.collect_list("b")).cast(_BANDS).alias("bands"))
    found = space.nearest(stored(own.drop("bands").join(bands, "id")), negatives, False)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("pid").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of the embeddings whose id is divisible by 100."""
    label = F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0, label)


OP12_SQL = """with v as (select vec_id, cast(case when vec_id % 7 = 0 then (label + 1) % 10 else label end as bigint) as label, list_transform(embedding, lambda c: cast(floor(256 * cast(c as double)) as bigint)) as x from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
  s as materialized (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.x, b.x), lambda z: z[1] * z[2])) as bigint) as score from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
  p as (select anchor_id, other as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
  select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) as int) as rank, s.other as negative_id, p.positive_score, s.score as negative_score
  from p join s on p.anchor_id = s.anchor_id and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
  qualify row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.other) <= 10"""
