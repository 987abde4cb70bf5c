"""Secret scans: fixed patterns, and values in a credential context that would be costly to guess.

The cost of a value is the cheapest way to write it as known words, dates, repeats, keyboard walks or runs, and single
characters, as in public password meters: dynamic programming over end positions, in powers of ten of guesses. The time
is linear in the value's length. Words are ranked by how often all documents have them outside of credential values, a
short list of passwords' favourites first.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
#: Names of credentials in English, German, French and Spanish; those that prose has as well count before a colon or equals sign alone.
_NAMES = (
    r"pass(?:word|wd|phrase|code|wort)?|pwd|secret|token|api[ _-]?key|access[ _-]?key|private[ _-]?key|credentials?|auth(?:orization)?|bearer|login"
    r"|kennwort|zugangsdaten|zugangscode|mot[ _-]de[ _-]passe|mdp|identifiants?|contrase(?:n|ñ|Ñ)a|credenciales"
)
_KEYS = r"(?:api|geheim|zugangs|zugriffs)[ _-]?schl(?:ü|Ü|ue)ssel|geheimnis|jeton|cl(?:e|é|É)[ _-](?:api|priv(?:e|é|É)e|secr(?:e|è|È)te|d['’]acc(?:e|è|È)s)|clave(?:[ _-](?:api|secreta|privada|de[ _-]acceso))?|secreto"
#: A value follows its name, or Bearer where it has a digit; a scheme in between isn't part of it. Shorter values can't cost COSTLY.
_CONTEXT = re.compile(
    rf"""(?:(?:(?:{_NAMES})["']?\x20*(?:=>|:=|[:=]|\b(?:is|ist|lautet|est|es)\b|\bbearer\b)|(?:{_KEYS})["']?\x20*(?:=>|:=|[:=]))\x20*["']?(?:(?:bearer|basic|token)\x20+["']?)?|\bbearer\x20+(?=[^\s"'<>,;\d]*\d))([^\s"'<>,;]{{6,}})""",
    re.I | re.A,
)
_WORDS_OF_CONTEXT = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "login", "kennwort", "zugang", "mdp", "identifiant", "contrase", "credencial", "schl", "geheim", "jeton", "cle", "clé", "clave")
#: A value that takes this many guesses or more, as a power of ten, is a secret.
COSTLY = 10.0

#: Common words of passwords, most common first.
WORDS = tuple(
    "password admin welcome qwerty letmein login user test guest root master secret default change example sample "
    "monkey dragon football baseball hello sunshine princess shadow superman michael jordan hunter killer soccer "
    "summer winter spring autumn monday friday orange purple yellow green black white silver golden happy love money "
    "flower cookie pepper banana cheese coffee computer internet server database system access service account public "
    "private token value string null none true false placeholder changeme your here insert enter key name demo dev prod "
    "staging local host data file config build debug temp dummy fake foo bar baz the and for with this that from".split()
)
#: Words of the corpus that the dictionary holds beside these, the most frequent ones; a documented bound of what tasks carry.
MAX_WORDS = 50_000
#: A word of the corpus stands this often outside of credential values, and is no longer than this.
MIN_COUNT, LONGEST = 3, 20
_LETTERS = re.compile(r"[^\W\d_]{3,}")


def ranked(words=()) -> dict[str, float]:
    """The power of ten of each word's rank: WORDS, then words, in order."""
    out: dict[str, float] = {}
    for w in (*WORDS, *words):
        if w not in out:
            out[w] = math.log10(len(out) + 2)
    return out


_RANK = ranked()
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_DATE = re.compile(r"(?:(?:19|20)\d\d([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01])|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d)")
_YEAR = re.compile(r"(?:19|20)\d\d")
_REPEAT = re.compile(r"(.{1,4}?)\1{2,}", re.S)
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")


def _neighbours() -> set[str]:
    at = {c: (y, x) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}
    near = {a + b for a, (y, x) in at.items() for b, (v, u) in at.items() if a != b and abs(y - v) <= 1 and abs(u - x) <= 1}
    runs = {a + b for s in ("abcdefghijklmnopqrstuvwxyz", "0123456789") for a, b in [*zip(s, s[1:], strict=False), *zip(s[1:], s, strict=False)]}
    return near | runs


_NEAR = _neighbours()


def _single(c: str) -> float:
    """Powers of ten of guesses for one character."""
    return 1.0 if c.isdigit() else math.log10(26) if c.isalpha() else math.log10(33)


def _repeats(value: str) -> list[tuple[int, list[int]]]:
    """For each period from 1 to 4, at each place the number of characters that equal the one a period later without a gap."""
    out = []
    for p in range(1, 5):
        run = [0] * (len(value) + 1)
        for i in range(len(value) - p - 1, -1, -1):
            run[i] = run[i + 1] + 1 if value[i] == value[i + p] else 0
        out.append((p, run))
    return out


def guess_cost(value: str, rank: dict[str, float] = _RANK, enough: float = math.inf) -> float:
    """The power of ten of the guesses that the cheapest segmentation of value takes; 0 for an empty value.

    Segments are single characters, words of rank (also in capitals or with digits for letters), dates, years, units of one
    to four characters repeated three times or more (as often as they are repeated there), and walks of three or more
    neighbours on a keyboard, in the alphabet or among digits. A cost of enough or more may be given as enough.
    """
    low = value.lower()
    plain = low.translate(_PLAIN) if len(low) == len(value) else (low := "".join(c.lower() if len(c.lower()) == 1 else c for c in value)).translate(_PLAIN)
    n = len(value)
    best = [0.0] + [math.inf] * n
    repeats = _repeats(value)
    single = [_single(c) for c in value]
    far: dict[int, float] = {}  # ends of repeats that lie ahead
    # a walk over [i, j) costs 2.0 + 0.35 * (j - i), so of its beginnings the least best[i] - 0.35 * i counts
    walk, walked = 0, math.inf
    for i in range(n):
        # position i: best[i] is final once walks that end here are in
        if i and low[i - 1 : i + 1] not in _NEAR:
            ends_here, begins = walk, i
        else:
            ends_here, begins = walk, walk
        if i - ends_here >= 3:
            walked = min(walked, best[i - 3] - 0.35 * (i - 3))
            best[i] = min(best[i], walked + 2.0 + 0.35 * i)
        if begins != walk:
            walk, walked = i, math.inf
        here = best[i]
        far.pop(i, None)
        if i % 16 == 0:
            ahead = min(min(best[i : i + LONGEST + 1]), min(far.values(), default=math.inf), walked + 2.0 + 0.35 * i, min(best[max(0, i - 3) : i + 1]))
            if ahead >= min(enough, best[n]):
                return min(enough, best[n])
        if here >= best[n]:
            continue
        best[i + 1] = min(best[i + 1], here + single[i])
        for j in range(i + 3, min(n, i + LONGEST) + 1):
            if (r := rank.get(plain[i:j])) is not None:
                own = r + 0.3 * (value[i:j] != low[i:j]) + 0.3 * (plain[i:j] != low[i:j]) + 0.3
                best[j] = min(best[j], here + own)
        if value[i].isdigit():
            if m := _DATE.match(value, i):
                best[m.end()] = min(best[m.end()], here + 4.6)
            if m := _YEAR.match(value, i):
                best[m.end()] = min(best[m.end()], here + 2.1)
        for p, run in repeats:
            if run[i] >= 2 * p:
                times = 1 + run[i] // p
                j, own = i + times * p, here + sum(single[i : i + p]) + math.log10(times) + 0.3
                if own < best[j]:
                    best[j] = own
                    if j > i + LONGEST:
                        far[j] = own
    if n - walk >= 3:
        walked = min(walked, best[n - 3] - 0.35 * (n - 3))
        best[n] = min(best[n], walked + 2.0 + 0.35 * n)
    return best[n]


def _in_context(low: str) -> bool:
    return (":" in low or "=" in low or "bearer" in low or any(v in low for v in (" is ", " ist ", " lautet ", " est ", " es "))) and any(w in low for w in _WORDS_OF_CONTEXT)


def secret_spans(text: str | None, rank: dict[str, float] = _RANK) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each secret, by start and then in the order of KINDS; positions are code points."""
    text = text or ""
    found = [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if _in_context(text.lower()):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        known = sorted(found)
        starts, reach, furthest = [x for x, _, _ in known], [], 0
        for _, y, _ in known:
            reach.append(furthest := max(furthest, y))
        for m in _CONTEXT.finditer(text):
            a, b = m.span(1)
            k = bisect_right(starts, b - 1)
            if k and reach[k - 1] > a:
                continue
            v = m[1].rstrip(".)]}")
            if guess_cost(v, rank, COSTLY) >= COSTLY:
                found.append((a, a + len(v), "guess"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def corpus_words(docs: DataFrame, text_col: str = "text", max_words: int = MAX_WORDS) -> list[str]:
    """The most frequent words of three letters or more of all docs, most frequent first; values in a credential context don't count.

    Counted in tasks and in one aggregation by word; max_words rows at most reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in small(batches):
            for t in batch.column(0).to_pylist():
                low = (t or "").lower()
                if _in_context(low):
                    low = _CONTEXT.sub(" ", low)
                seen.update(w for w in _LETTERS.findall(low) if len(w) <= LONGEST)
            if len(seen) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.where(f"n >= {MIN_COUNT}").orderBy(F.desc("n"), "word").limit(max_words).collect()]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end), for each row of docs.

    words are the dictionary's words, most frequent first (none: corpus_words of docs, one more pass over the texts). A null text is empty and has no spans; rows are scanned one by one, so repeated rows repeat and a null id stays null;
    other columns are ignored; an empty table gives an empty result.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    rank = ranked(corpus_words(docs, text_col) if words is None else words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in secret_spans(t, rank)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the secrets of all documents."""
    s = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("bigint").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"] != "guess")
    return s.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("guess"))
