"""Sum-of-squares packing of tokenized documents into sequences.

Documents are tokenized, those longer than a sequence are cut, and each piece is placed in the open sequence, or a new
one, for which the sum over gaps of the squared number of open sequences with that gap becomes smallest (Csirik et
al.). The state is a count and a stack of open sequences by gap, so a piece costs the same however many are open.

Pieces are dealt by a hash into groups of about GROUP pieces, which are packed independently of each other: a group
ends with a few open sequences, so the loss against one run over all pieces is a few sequences in each group.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored

CAPACITY = 2048
GROUP = 30_000


#: The split of byte_bpe_50k.json's ByteLevel pre-tokenizer, as a pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class TokenBytes:
    """Token ids of texts as little-endian 32-bit bytes: those of a byte-level BPE file of the tokenizers library.

    The file's vocabulary, whose ids follow the order of its merges, is run by tiktoken, which needs a sixth of the time
    for the same ids; texts that hold a special token, or a run of white space that is too long for tiktoken's pattern
    (it fails somewhere beyond 400,000 characters), are left to tokenizers itself.
    """

    LONG_RUN = 100_000

    def __init__(self, path: str, pattern: str = PATTERN):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file writes as themselves
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte[c] for c in w): i for w, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if w not in self.special}
        self.long_space = re.compile(rf"\s{{{self.LONG_RUN}}}")
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) >= self.LONG_RUN and self.long_space.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, place: each document's ids and end_id, cut into pieces of capacity.

    What is over goes into the first piece. place is the document's row in its batch, so that rows that repeat can be dealt apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = TokenBytes(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in small(batches):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for place, (doc, text) in enumerate(zip(ids, texts, strict=True)):
                raw = tokens(text) + end
                n = len(raw) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]), place) for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "place"])

    return docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, place int")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each length (1 to capacity), placed in the given order."""
    counts = np.zeros(capacity + 1, np.int64)  # open sequences by gap
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    made = 0
    # adding a sequence with gap g changes the sum by 2 * counts[g] + 1, taking one away by 1 - 2 * counts[g]
    for k, n in enumerate(lengths.tolist()):
        best, gap = 2 * counts[capacity - n] + 1 if n < capacity else 0, capacity
        if n < capacity:
            now, after = counts[n:capacity], 2 * counts[: capacity - n] + 1
            after[0] = 0  # a full sequence is no longer open
            change = np.where(now > 0, after + 1 - 2 * now, np.iinfo(np.int64).max)
            if change[at := int(change.argmin())] <= best:
                gap = n + at
        if gap == capacity:
            s, made = made, made + 1
        else:
            s = open_by_gap[gap].pop()
            counts[gap] -= 1
        sequence[k], offset[k] = s, capacity - gap
        if gap > n:
            open_by_gap[gap - n].append(s)
            counts[gap - n] += 1
    return sequence, offset


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """pieces with sequence_id and offset; pieces is what token_pieces gives, stored, and is read twice."""
    groups = max(1, round(pieces.count() / group))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # pieces of half a sequence or more can't share one: they come first, longest first; the others in no order of length
        small = pdf["length"].to_numpy() < capacity // 2
        mixed = pd.util.hash_array((pdf["doc_id"].fillna(-1).to_numpy(np.int64) << 16) + pdf["piece"].to_numpy() + 7 * pdf["place"].to_numpy())
        pdf = pdf.iloc[np.lexsort((mixed, np.where(small, 0, -pdf["length"].to_numpy()), small))].reset_index(drop=True)
        s, at = sum_of_squares(pdf["length"].to_numpy(), capacity)
        return pdf.drop(columns=["grp", "place"]).assign(sequence_id=(pdf["grp"].to_numpy().astype(np.int64) << 40) + s, offset=at)

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "place"), F.lit(groups)).cast("int"))
    return dealt.groupBy("grp").applyInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, group: int = GROUP) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the end id alone. Texts of any length are packed whole; only documents of more than capacity ids are
    cut. Of bins that are as good a place the one with the smaller gap is taken, and pieces of one length may stand in any order. Repeated rows are packed
    each on its own; a null id stays null; other columns are ignored; an empty table gives an empty result.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    return packed(stored(token_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id)), capacity, group)


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
