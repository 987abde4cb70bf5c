"""Line deduplication by a segment-partition edit join.

Lines are compared in a normal form (lower case, single spaces). A line goes when the same form stands earlier, or when
one within MAX_EDITS edits does. If two lines are within t edits, one of t + 1 segments of the shorter stands unchanged
in the longer, near its place. So each distinct line yields, for each partner length it can have, a key for every
segment place that such a partner could match; lines that share a key are candidates, and a banded bit-parallel edit
distance over many pairs at once confirms them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, small, stored

MAX_EDITS = 2
#: Shorter normal forms aren't compared by edits. Two edits make other words of them.
MIN_CHARS = 24
#: op8 and the pipeline find exact copies of all lines that have a word.
MIN_EXACT = 1
#: Up to this many places of candidate lines are broadcast; they are counted first.
SMALL_LINES = 500_000
_BASE = 0x9E3779B97F4A7C15 | 1


def normal(line: str) -> str:
    """Lower case, without white space at the ends, other white space as single spaces."""
    return " ".join(line.lower().split())


def _digest(form: str) -> tuple[int, int]:
    h = xxhash.xxh3_128_digest(form.encode("utf-8", "surrogatepass"))
    return tuple(np.frombuffer(h, "<i8").tolist())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, n + 1 of each at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, n + 1)
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def segment_keys(forms: list[str], max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of form, key, whether it is one of the form's own segments) for each key of each form of min_chars or more."""
    text = "".join(forms).encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(text, "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, forms), np.int64, len(forms))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    power, inverse = _power_tables(len(chars))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars + np.uint64(1)) * power[: len(chars)], out=sums[1:])
    owners, keys, segments = [], [], []
    parts = max_edits + 1
    for less in range(max_edits + 1):  # the partner is the segmented one and shorter by this
        short = lengths - less
        base, over = short // parts, short % parts
        for k in range(parts):
            place = k * base + np.maximum(0, k - (parts - over))
            width = base + (k >= parts - over)
            low = np.maximum(np.maximum(place - k, place + less - (max_edits - k)), 0)
            high = np.minimum(np.minimum(place + k, place + less + (max_edits - k)), lengths - width)
            for step in range(2 * max_edits + 1):
                own = np.nonzero((short >= min_chars) & (low + step <= high))[0]
                if len(own):
                    a = starts[own] + low[own] + step
                    h = (sums[a + width[own]] - sums[a]) * inverse[a]
                    owners.append(own)
                    segments.append((low[own] + step == place[own]) & (less == 0))
                    keys.append(_mixed(h + _mixed((short[own] * parts + k).astype(np.uint64))))
    return tuple(map(np.concatenate, (owners, keys, segments))) if owners else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, bool))


def parity(form: str) -> int:
    """64 bits, each the parity of the number of character pairs that fall to it; an edit changes 4 of them at most."""
    c = np.frombuffer(form.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    at = _mixed(c[:-1] * np.uint64(0x10001F) + c[1:]) & np.uint64(63)
    return int(np.bitwise_xor.reduce(np.uint64(1) << at, initial=np.uint64(0)).astype(np.int64))


def within(pairs: list[tuple[str, str]], max_edits: int = MAX_EDITS) -> np.ndarray:
    """Whether the edit distance of each pair is max_edits at most, by a banded bit-parallel column for all pairs at once.

    Bit b of the vectors stands for row j - max_edits + b of column j, so 2 * max_edits + 1 bits are enough.
    """
    out = np.zeros(len(pairs), bool)
    ordered = [(a, b, k) if len(a) >= len(b) else (b, a, k) for k, (a, b) in enumerate(pairs) if abs(len(a) - len(b)) <= max_edits]
    ordered.sort(key=lambda p: len(p[1]))
    width = 2 * max_edits + 1
    full = (1 << width) - 1
    for part in chunks(ordered, weight=lambda p: 8 * len(p[0]) + 64, limit=8_000_000):
        rows = ordered[part]
        n = np.array([len(b) for _, b, _ in rows])
        longest = int(n.max())
        s1 = np.full((longest + 2 * max_edits + 2, len(rows)), 0xFFFFFFFF, np.uint32)  # row i of the band is s1[i + max_edits]
        s2 = np.full((longest + 1, len(rows)), 0xFFFFFFFE, np.uint32)
        for k, (a, b, _) in enumerate(rows):
            a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), "<u4") for x in (a, b))
            s1[max_edits + 1 : max_edits + 1 + len(a), k], s2[1 : len(b) + 1, k] = a, b
        more = np.array([len(a) - len(b) for a, b, _ in rows])
        vp = np.full(len(rows), (full >> max_edits) << max_edits, np.uint32)
        vn, score = np.zeros(len(rows), np.uint32), np.zeros(len(rows), np.int64)
        final = np.where(n == 0, more, -1)
        first = int(np.searchsorted(n, 1))
        for j in range(1, longest + 1):
            x = np.zeros(len(rows), np.uint32)
            for b in range(width):
                x |= (s1[j + b] == s2[j]).astype(np.uint32) << np.uint32(b)
            d0 = ((((x & vp) + vp) ^ vp) | x | vn) & np.uint32(full)
            hp, hn = (vn | ~(d0 | vp)) & np.uint32(full), d0 & vp
            score += 1 - ((d0 >> np.uint32(max_edits)) & np.uint32(1))
            last = int(np.searchsorted(n, j, "right"))
            if last > first:  # these pairs end here: add the rows below the diagonal
                up = (hp << np.uint32(1)) | np.uint32(1)
                p, m = (hn << np.uint32(1)) | ~(d0 | up), d0 & up
                s = score.copy()
                for b in range(1, max_edits + 1):
                    bit = np.uint32(max_edits + b)
                    s += np.where(more >= b, ((p >> bit) & np.uint32(1)).astype(np.int64) - ((m >> bit) & np.uint32(1)).astype(np.int64), 0)
                final[first:last] = s[first:last]
                first = last
            vp = (hn | ~((d0 >> np.uint32(1)) | hp)) & np.uint32(full) | np.uint32(1 << (width - 1))
            vn = (d0 >> np.uint32(1)) & hp & np.uint32(full >> 1)
        out[[k for _, _, k in rows]] = final <= max_edits
    return out


def _occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, th, pos, h1, h2, first (in its document) of each line that is compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows: list[tuple] = []
            for doc, th, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "text")), strict=True):
                seen: set[str] = set()
                for k, line in enumerate((text or "").split("\n")):
                    form = normal(line)
                    if len(form) >= min_chars:
                        rows.append((doc, th, k, *_digest(form), form not in seen))
                        seen.add(form)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["doc_id", "th", "pos", "h1", "h2", "first"])

    return docs.mapInArrow(run, "doc_id bigint, th bigint, pos int, h1 bigint, h2 bigint, first boolean")


def _keys(docs: DataFrame, max_edits: int, min_chars: int) -> DataFrame:
    """key, h1, segment of each distinct line; lines that repeat within a batch count once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts = batch.column("text").to_pylist()
            for part in chunks(texts, limit=500_000):
                forms = list({f for t in texts[part] if t for f in map(normal, t.split("\n")) if len(f) >= min_chars})
                own, keys, segments = segment_keys(forms, max_edits, min_chars)
                h = np.array([_digest(f)[0] for f in forms], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(h[own] if len(forms) else np.empty(0, np.int64)), pa.array(segments)], names=["key", "h1", "segment"])

    return docs.mapInArrow(run, "key bigint, h1 bigint, segment boolean")


def _forms(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h1, h2, form, parity of the lines wanted(doc_id, th, pos, ...)."""
    places = wanted.groupBy("doc_id", "th").agg(F.collect_list("pos").alias("at"))
    if wanted.count() <= SMALL_LINES:
        places = F.broadcast(places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lines = (text or "").split("\n")
                for f in {normal(lines[k]) for k in at if k < len(lines)}:
                    rows.append((*_digest(f), f, parity(f)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 4, (pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["h1", "h2", "form", "parity"])

    return docs.join(places, ["doc_id", "th"]).select("text", "at").mapInArrow(run, "h1 bigint, h2 bigint, form string, parity bigint").dropDuplicates(["h1", "h2"])


def _linked(pairs: DataFrame, max_edits: int) -> DataFrame:
    """The h1, h2 of the later line of the pairs that are within max_edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            same = within(list(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)), max_edits)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in batch.columns[:2]], names=["h1", "h2"])

    return pairs.select(F.col("y.h1").alias("h1"), F.col("y.h2").alias("h2"), F.col("x.form").alias("a"), F.col("y.form").alias("b")).mapInArrow(run, "h1 bigint, h2 bigint").distinct()


def near_lines(docs: DataFrame, lines: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """h1, h2 of the distinct lines(h1, h2, doc_id, th, pos) that have an earlier line within max_edits.

    Earlier is the line whose first document has the smaller id, in one document the one above.
    """
    dealt = _keys(docs, max_edits, min_chars).repartition("key")
    shared = dealt.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi"), F.max("segment").alias("any")).where("lo < hi and any").select("key")
    members = stored(dealt.join(shared.hint("shuffle_hash"), "key").groupBy("key", "h1").agg(F.max("segment").alias("segment")))
    wanted = stored(lines.join(members.select("h1").distinct(), "h1", "left_semi"))
    forms = _forms(docs, wanted)
    known = stored(wanted.join(forms, ["h1", "h2"]).select("h1", F.struct("doc_id", "th", "pos", "h1", "h2").alias("at"), "h2", "form", "parity"))
    brief = known.select("h1", "h2", "at", "parity", F.length("form").alias("n"))
    m = members.join(brief, "h1")
    # the key must be a segment of the shorter line
    alike = f"abs(x.n - y.n) <= {max_edits} and (x.n <= y.n and x.segment or y.n <= x.n and y.segment) and bit_count(x.parity ^ y.parity) <= {4 * max_edits}"
    side = lambda t, n: t.select("key", F.struct("h1", "h2", "at", "parity", "n", "segment").alias(n))

    def confirmed(pairs: DataFrame) -> DataFrame:
        p = pairs.select(F.col("x.at").alias("xa"), F.col("y.at").alias("ya")).distinct()
        text = lambda n: known.select(F.col("at").alias(f"{n}a"), F.struct("h1", "h2", "form").alias(n))
        return _linked(p.join(text("x"), "xa").join(text("y"), "ya"), max_edits)

    # most lines of a large group are near its first one; only the others are compared with all earlier ones
    heads = m.groupBy("key").agg(F.min("at").alias("head"))
    first = m.join(heads, "key").where("at = head").select("key", F.struct("h1", "h2", "at", "parity", "n", "segment").alias("x"))
    star = stored(confirmed(first.join(side(m, "y"), "key").where(f"x.at < y.at and {alike}")))
    left = m.join(star, ["h1", "h2"], "left_anti")
    rest = confirmed(side(m, "x").join(side(left, "y"), "key").where(f"x.at < y.at and {alike}"))
    return stored(star.union(rest).distinct())


def removed_lines(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, min_exact: int | None = None) -> DataFrame:
    """doc_id, th, exact and near: the places (from 0) of the lines that go from each of docs(doc_id, th, text) that loses any."""
    seen = stored(_occurrences(docs, min_chars if min_exact is None else min(min_chars, min_exact)))
    own = F.struct("doc_id", "th")
    lines = stored(seen.where("first").groupBy("h1", "h2").agg(F.min_by("pos", own).alias("pos"), F.min(own).alias("owner")).select("h1", "h2", "pos", "owner.*"))
    near = near_lines(docs, lines, max_edits, min_chars).withColumn("near", F.lit(True))
    # stored, so that Spark can split the join on a line that very many documents have
    fate = stored(lines.select("h1", "h2", own.alias("owner")).join(near, ["h1", "h2"], "left"))
    fate = seen.join(fate, ["h1", "h2"]).select("doc_id", "th", "pos", (~F.col("first") | (F.col("owner") < own)).alias("exact"), F.coalesce("near", F.lit(False)).alias("near"))
    return fate.where("exact or near").groupBy("doc_id", "th").agg(F.collect_set(F.when(F.col("exact"), F.col("pos"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("pos"))).alias("near"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, min_exact: int | None = None) -> DataFrame:
    """row (a struct of the columns of docs), text (without the lines that go), n_lines, n_exact and n_near of each row.

    Lines are split at \\n; those of under min_chars characters in normal form go only as exact copies, and stay if they
    have under min_exact (none: min_chars), or no characters at all. The first line of each form stays
    unless an earlier form is within max_edits edits, whether or not that one stays itself. A null text stays null and
    has no lines; rows with a null id stay as they are and aren't compared; rows with equal ids and texts count as one
    document and lose the same lines, of rows with equal ids and different texts the one with the smaller hash is the
    earlier. Columns of docs, whatever their names, stay inside row. No rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = (F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("th"))
    gone = removed_lines(docs.where(F.col(id_col).isNotNull()).select(*key, text.alias("text")), max_edits, min_chars, min_exact)
    kept = docs.select(F.struct("*").alias("row"), *key, F.col(text_col).alias("text")).join(gone, ["doc_id", "th"], "left")
    lines = F.split("text", "\n")
    both = F.concat("exact", "near")
    text = F.when(both.isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, k: ~F.array_contains(both, k)), "\n"))
    count = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("bigint")
    return kept.select("row", "doc_id", text.alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("bigint").alias("n_lines"), count(F.when(both.isNotNull(), F.col("exact"))).alias("n_exact"), count(F.when(both.isNotNull(), F.col("near"))).alias("n_near"))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """What all documents lose to exact and near copies of lines, and the digest of what stays."""
    d = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_exact=MIN_EXACT)
    return d.select("doc_id", "n_lines", "n_exact", "n_near", F.length("text").cast("bigint").alias("n_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
