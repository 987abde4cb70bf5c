"""Interleaved document sequences: ordered text and media references of pages, and the payloads that digests resolve.

A page's HTML is parsed into structs of text or media reference, by position, with the caption of its figure. Media
are held once for each digest; references find them by a join on the digest, after the media were decoded, so a page
that many share costs one decoding. Payloads are stored as 8-bit greyscale PNG, one byte a sample.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small

WIDTH = 192
_MAGIC = b"\x89PNG\r\n\x1a\n"
_BLOCKS = {"p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "pre", "blockquote", "article", "section", "br", "tr", "table", "ul", "ol", "title", "figure", "figcaption", "body", "html", "head"}


def png_bytes(samples: bytes, width: int = WIDTH) -> bytes:
    """samples, a whole number of rows of width bytes, as 8-bit greyscale PNG."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    body = np.zeros((len(rows), width + 1), np.uint8)  # each row begins with its filter, 0: none
    body[:, 1:] = rows
    head = width.to_bytes(4) + len(rows).to_bytes(4) + b"\x08\0\0\0\0"
    parts = ((b"IHDR", head), (b"IDAT", zlib.compress(body.tobytes(), 1)), (b"IEND", b""))
    return _MAGIC + b"".join(len(d).to_bytes(4) + k + d + zlib.crc32(k + d).to_bytes(4) for k, d in parts)


def png_samples(data: bytes) -> np.ndarray:
    """The rows of samples of an 8-bit greyscale PNG that isn't interlaced; ValueError for anything else or damage."""
    if data[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, width, packed = 8, 0, []
    while at < len(data):
        n, kind = int.from_bytes(data[at : at + 4]), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != int.from_bytes(data[at + 8 + n : at + 12 + n]):
            raise ValueError(f"damaged {kind!r}")
        if kind == b"IHDR":
            width, height = int.from_bytes(body[:4]), int.from_bytes(body[4:8])
            if body[8:] != b"\x08\0\0\0\0":
                raise ValueError("not 8-bit greyscale")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width + 1)
    filters, rows = raw[:, 0], raw[:, 1:]
    if not filters.any():
        return rows
    if filters.max() > 2:
        raise ValueError("row filters 3 and 4 aren't read")
    out = np.zeros_like(rows)
    for y in range(height):  # 1: difference to the left, 2: to above
        out[y] = rows[y] if filters[y] == 0 else np.cumsum(rows[y], dtype=np.uint8) if filters[y] == 1 else rows[y] + (out[y - 1] if y else 0)
    return out


def feature(rows: np.ndarray) -> str:
    """Size, mean, spread and a hash of the brightness of 8 by 8 fields against their mean, in integers."""
    ys, xs = (np.linspace(0, n, 9).astype(int) for n in rows.shape)
    total = np.zeros((rows.shape[0] + 1, rows.shape[1] + 1), np.int64)
    total[1:, 1:] = rows.astype(np.int64).cumsum(0).cumsum(1)
    sums = total[ys[1:, None], xs[1:]] - total[ys[:-1, None], xs[1:]] - total[ys[1:, None], xs[:-1]] + total[ys[:-1, None], xs[:-1]]
    area = np.maximum(1, np.diff(ys)[:, None] * np.diff(xs))
    fields = sums * 1000 // area
    bits = (fields > fields.mean()).ravel()
    x = rows.astype(np.int64)
    mean = int(x.sum() * 1000 // x.size)
    spread = int(((x * x).sum() * 1000 // x.size) - mean * mean // 1000)
    return f"{rows.shape[1]}x{rows.shape[0]}:{mean}:{spread}:{int.from_bytes(np.packbits(bits).tobytes()):016x}"


#: A tag with its attributes; quotes count after an equals sign only. Nothing in it is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?+""")
_RAW = {name: re.compile(rf"(?i)</{name}(?=[\s/>])") for name in ("script", "style")}
_LONG_NUMBER = re.compile(r"&#(?:[0-9]{8,}|[xX][0-9a-fA-F]{7,});?")


def _plain(text: str) -> str:
    """text with its character references resolved; numbers beyond any character become U+FFFD."""
    return html.unescape(_LONG_NUMBER.sub("\ufffd", text)) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    """The attributes of a tag by lower-case name; of equal names the first counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), _plain(m[2] or m[3] or m[4] or ""))
    return out


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) of a page's parts; kinds are text, start and end. Time is linear in the page.

    Comments, declarations and the insides of scripts and styles are left out, the rest of the page where a script
    or style has no end. A comment without an end is over at the next >, as declarations are. From a tag whose quotes hide its end on,
    tags end at the next >; where none follows, what is left is text.
    """
    at, said, quoted, comments = 0, 0, True, True
    while (at := page.find("<", at)) >= 0:
        mark = page[at + 1 : at + 3]
        if not mark or not (mark[0] in "!?" or mark[0] == "/" or (mark[0].isascii() and mark[0].isalpha())):
            at += 1
            continue
        m = None
        if mark[0].isalpha() or mark[0] == "/" and mark[1:].isascii() and mark[1:].isalpha():
            m = _TAG.match(page, at) if quoted else None
            quoted = m is not None
        end = -1
        if m is None and comments and page.startswith("<!--", at):
            end = page.find("-->", at + 2)
            comments, end = end >= 0, end + 2 if end >= 0 else -1
        if m is None and end < 0:
            end = page.find(">", at)
            if end < 0:
                break
        if said < at:
            yield "text", page[said:at], ""
        closing, name, attributes = (m[1], m[2], m[3]) if m else ("", "", "")
        if m is None and (mark[0].isalpha() or mark[0] == "/"):
            closing = mark[0] if mark[0] == "/" else ""
            name, _, attributes = page[at + 1 + len(closing) : end].replace("/", " ").partition(" ")
        said = at = m.end() if m else end + 1
        name = name.lower()
        if name:
            yield "end" if closing else "start", name, attributes
        if name in _RAW and not closing:
            raw = _RAW[name].search(page, at)
            if raw is None:
                return
            said = at = raw.start()
    if said < len(page):
        yield "text", page[said:], ""


class _Page:
    """items: [kind, text, reference, caption], in order; kind is None for captions that media took."""

    def __init__(self):
        self.items: list[list[str | None]] = []
        self.words: list[str] = []
        self.figures: list[list] = []  # of each open one: where its media begin in waiting, and its captions as items
        self.waiting: list[list[str | None]] = []  # media in open figures without a figure's caption
        self.caption: list[str] | None = None

    def flush(self) -> None:
        if self.caption is not None:
            self.caption.append(" ")
            return
        text = " ".join(_plain("".join(self.words)).split())
        self.words = []
        if text:
            self.items.append(["text", text, None, None])

    def end_caption(self) -> None:
        if self.caption is not None:
            said, self.caption = " ".join(_plain("".join(self.caption)).split()), None
            if said:
                self.items.append(["text", said, None, None])
                if self.figures:
                    self.figures[-1][1].append(self.items[-1])

    def end_figure(self) -> None:
        begin, captions = self.figures.pop()
        if captions and begin < len(self.waiting):
            said = " ".join(c[1] for c in captions)
            for item in self.waiting[begin:]:
                item[3] = said
            for c in captions:
                c[0] = None
            del self.waiting[begin:]
        if not self.figures:
            self.waiting.clear()

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("img", "video", "audio", "source"):
            got = _attributes(attributes)
            source = got.get("src") or got.get("data-src") or (next(iter(got.get("srcset", "").split()), "").rstrip(",") if tag == "img" else "")
            if source:
                self.flush()
                self.items.append(["media", None, source, got.get("alt") or None])
                if self.figures:
                    self.waiting.append(self.items[-1])
        elif tag == "figure":
            self.end_caption()
            self.flush()
            self.figures.append([len(self.waiting), []])
        elif tag == "figcaption":
            self.end_caption()
            self.flush()
            self.caption = []
        elif tag in _BLOCKS:
            self.flush()

    def end(self, tag: str) -> None:
        if tag == "figcaption":
            self.end_caption()
        elif tag == "figure" and self.figures:
            self.end_caption()
            self.flush()
            self.end_figure()
        elif tag in _BLOCKS:
            self.flush()

    def close(self) -> None:
        self.end_caption()
        self.flush()
        while self.figures:
            self.end_figure()


def sequence(page: str | None) -> list[dict]:
    """The ordered texts and media references of a page: dicts of position, kind, text, reference, caption.

    A caption goes to the media of its figure and of figures within that have none of their own, before or after it;
    without any it is a text. A caption without an end is over with its figure, at the next caption or figure, or with the page.
    """
    p = _Page()
    for kind, name, attributes in _tokens(page or ""):
        if kind == "text":
            (p.words if p.caption is None else p.caption).append(name)
        elif kind == "start":
            p.start(name, attributes)
        else:
            p.end(name)
    p.close()
    items = [x for x in p.items if x[0] is not None]
    return [dict(zip(("position", "kind", "text", "reference", "caption"), (k, *x), strict=True)) for k, x in enumerate(items)]


_ITEM = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("reference", pa.string()), ("caption", pa.string())])
ITEMS = "items array<struct<position:int,kind:string,text:string,reference:string,caption:string>>"


def interleaved(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", n_bytes: Column | None = None) -> DataFrame:
    """id, n_bytes (a number that goes along, null unless given) and items, the ordered texts and media references of each page.

    Null and empty pages have no items. Repeated rows repeat, a null id stays null, other columns are ignored, no rows
    give no rows. Pages of any length and broken HTML take time linear in their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([sequence(t) for t in batch.column(2).to_pylist()], pa.list_(_ITEM))], names=["id", "n_bytes", "items"])

    n = F.lit(None).cast("bigint") if n_bytes is None else n_bytes
    return pages.select(F.col(id_col).cast("bigint").alias("id"), n.alias("n_bytes"), F.col(html_col).alias("html")).mapInArrow(run, f"id bigint, n_bytes bigint, {ITEMS}")


_READ = "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def media_store(payloads: DataFrame, width: int = WIDTH) -> DataFrame:
    """digest, media: each distinct digest of payloads(digest, payload) once, stored as PNG; payloads are whole rows of width bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            seen: dict[str, bytes] = {}
            for d, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if d not in seen:
                    seen[d] = png_bytes(p, width)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.binary())], names=["digest", "media"])

    return payloads.select("digest", "payload").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def read_back(store: DataFrame) -> DataFrame:
    """What the stored media of store(digest, media) hold: sizes and digests of payload and media, and the feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for d, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = png_samples(m)
                p = samples.tobytes()
                rows.append((d, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(samples)))
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return store.mapInArrow(run, _READ)


def resolved(items: DataFrame, media: DataFrame) -> DataFrame:
    """One row a media reference of items(id, n_bytes, items), with the columns of media(digest, ...) where its digest is known.

    References are of the form sha256:<digest>; position and caption are those of the item, before is the text of the
    item in front of it; media columns are null for references that no digest answers.
    """
    refs = items.select("id", "n_bytes", "items", F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("i"))
    before = F.get("items", F.col("i.position") - 1)["text"]
    refs = refs.select("id", "n_bytes", "i.position", "i.caption", before.alias("before"), F.regexp_extract("i.reference", "^sha256:([0-9a-f]{64})$", 1).alias("digest"))
    return refs.join(media, "digest", "left")


def with_payload(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, keep: tuple = ()) -> DataFrame:
    """doc_id, n_bytes, payload and digest: each text in UTF-8, filled up with spaces to whole rows of width bytes, one at least; keep are columns of docs that go along."""
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), raw.alias("raw"), *keep)
    d = d.withColumn("n_bytes", F.octet_length("raw").cast("bigint"))
    full = f"cast(greatest(1, ceil(n_bytes / {width})) * {width} as int)"
    d = d.withColumn("payload", F.expr(f"rpad(raw, {full}, X'20')")).drop("raw")
    return d.withColumn("digest", F.sha2("payload", 256))


def text_page(text: Column, digest: Column) -> Column:
    """HTML of a text: its lines as paragraphs, then a figure that refers to the digest, captioned by the number of characters."""
    t = F.coalesce(text, F.lit(""))
    escaped = F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    paragraphs = F.replace(escaped, F.lit("\n"), F.lit("</p><p>"))
    figure = F.concat(F.lit("<figure><img src='sha256:"), digest, F.lit("'><figcaption>"), F.char_length(t).cast("string"), F.lit(" characters</figcaption></figure>"))
    return F.concat(F.lit("<article><p>"), paragraphs, F.lit("</p>"), figure, F.lit("</article>"))


def op4_media_columns(spark, sf_dir: str) -> DataFrame:
    """Each document as a page of its own text and a figure of it: parsed to ordered items, resolved by digest and read back.

    position is that of the figure, the number of the text's lines that have a word. Texts of any length are stored whole, and equal
    texts share one stored form.
    """
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    payloads = with_payload(d)
    own = with_payload(d, keep=(F.col("text"),)).select("doc_id", "n_bytes", text_page(F.col("text"), F.col("digest")).alias("html"))
    found = resolved(interleaved(own, "doc_id", n_bytes=F.col("n_bytes")), read_back(media_store(payloads)))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "position", "caption", "digest")


def page_media_sequences(spark, sf_dir: str) -> DataFrame:
    """The ordered texts and media references of all raw web pages: how many of each, and a digest of the sequence."""
    s = interleaved(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    said = F.transform("items", lambda i: F.concat_ws("\x1f", i["kind"], F.coalesce(i["text"], F.lit("")), F.coalesce(i["reference"], F.lit("")), F.coalesce(i["caption"], F.lit(""))))
    count = lambda k: F.size(F.filter("items", lambda i: i["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return s.select(F.col("id").alias("page_id"), F.size("items").cast("bigint").alias("n_items"), count("text"), count("media"), F.sha2(F.array_join(said, "\n"), 256).alias("sequence_sha256"))


def page_html(parts: list[tuple[str, str, str]]) -> str:
    """A page of ('text', words, '') and ('media', reference, caption) parts, for tests and exports."""
    out = [f"<p>{html.escape(a)}</p>" if k == "text" else f"<figure><img src='{html.escape(a)}'><figcaption>{html.escape(b)}</figcaption></figure>" for k, a, b in parts]
    return f"<article>{''.join(out)}</article>"
