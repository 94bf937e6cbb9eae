"""Encoding of whole tables with a public byte-level BPE tokenizer by prefix dynamic programming.

A piece's encoding is found left to right: for each byte prefix the one token is kept that ends its valid
encoding. A token may follow the last token of the prefix before it exactly if the merges of neither
would have been pre-empted across the border. So a prefix's encoding never depends on later bytes: appending
continues the table, and an edit only recomputes from the first changed byte.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagewright.session import spread, table

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the public vocabulary's pattern of pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A worker forgets its cached pieces beyond this number; results do not depend on it.
CACHED_PIECES = 300_000

_FAR = 1 << 40


class PrefixEncoder:
    """Exact byte-pair encoding from a table of token bytes and ranks (rank = id, single bytes lowest)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ids = ranks
        self.sizes = {i: len(t) for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.pattern = regex.compile(pattern)
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        # In order of rank, all smaller tokens are known, so a token's two halves are found by the table itself.
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                for k in range(1, len(token)):
                    left, right = ranks.get(token[:k], _FAR), ranks.get(token[k:], _FAR)
                    if left < rank and right < rank and self.follows(left, right):
                        self.parts[rank], self.joined[left, right] = (left, right), rank
                        break
        self.pieces: dict[str, list[int]] = {}

    def follows(self, left: int, right: int) -> bool:
        """Whether ``left`` then ``right`` is what encoding their bytes gives.

        Going back in time from the finished tokens, the token formed last is undone first (of equal ones the right one,
        as merges run from the left). A border merge that would have come before the merge that consumes either side
        makes the pair invalid.
        """
        parts, joined = self.parts, self.joined
        left_used, right_used = _FAR, _FAR
        while True:
            m = joined.get((left, right))
            if m is not None and m < left_used and m <= right_used:
                return False
            undo_left, undo_right = parts.get(left), parts.get(right)
            if undo_left and (not undo_right or left > right):
                left_used, left = left, undo_left[1]
            elif undo_right:
                right_used, right = right, undo_right[0]
            else:
                return True

    def extend(self, data: bytes, last: list[int], start: int = 0) -> list[int]:
        """Fill ``last`` (the last token of each prefix of ``data``; ``last[0]`` is -1) from prefix ``start + 1`` on."""
        ids, follows, longest = self.ids, self.follows, self.longest
        del last[start + 1:]
        if not last:
            last.append(-1)
        for i in range(start + 1, len(data) + 1):
            for j in range(max(0, i - longest), i):
                t = ids.get(data[j:i])
                if t is not None and (j == 0 or follows(last[j], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def unwind(self, last: list[int]) -> list[int]:
        out, i = [], len(last) - 1
        while i > 0:
            out.append(last[i])
            i -= self.sizes[last[i]]
        return out[::-1]

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode()
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        return self.unwind(self.extend(data, [-1]))

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text`` without special tokens; null and empty texts have no ids."""
        out: list[int] = []
        if not text:
            return out
        pieces = self.pieces
        if len(pieces) > CACHED_PIECES:
            pieces.clear()
        for piece in self.pattern.findall(text):
            ids = pieces.get(piece)
            if ids is None:
                ids = self.encode_piece(piece)
                if len(piece) < 64:
                    pieces[piece] = ids
            out += ids
        return out


class GrowingPiece:
    """One piece's table kept between changes: exact appends, and re-encoding from the first changed byte."""

    def __init__(self, encoder: PrefixEncoder, data: bytes = b""):
        self.encoder, self.data = encoder, data
        self.last = encoder.extend(data, [-1])

    def append(self, more: bytes) -> None:
        self.data, before = self.data + more, len(self.data)
        self.encoder.extend(self.data, self.last, before)

    def replace(self, at: int, until: int, new: bytes) -> None:
        """Bytes [at, until) become ``new``; prefixes up to ``at`` keep their entries."""
        self.data = self.data[:at] + new + self.data[until:]
        self.encoder.extend(self.data, self.last, at)

    @property
    def ids(self) -> list[int]:
        return self.encoder.unwind(self.last)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 token and id on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(name: str, ranks: dict[bytes, int]) -> PrefixEncoder:
    """One encoder a worker and vocabulary."""
    if name not in _ENCODERS:
        _ENCODERS[name] = PrefixEncoder(ranks)
    return _ENCODERS[name]


def encoded(df: DataFrame, text: str = "text", out: str = "ids", counts_only: bool = False, path: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """``df`` without ``text`` and with ``out``: its token ids, or with ``counts_only`` their number.

    Null and empty texts get an empty list (0). Texts are encoded whole. No shuffle; the vocabulary, of fixed size, is
    read once on the driver and broadcast.
    """
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(path))
    rest = [f for f in df.schema.fields if f.name not in (text, out)]
    kind = T.IntegerType() if counts_only else T.ArrayType(T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path, ranks.value)
        for b in batches:
            ids = [encoder.encode(s) for s in b.column(len(rest)).to_pylist()]
            made = pa.array([len(x) for x in ids], pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], made], names=[*[f.name for f in rest], out])

    return spread(df.select(*[f.name for f in rest], text)).mapInArrow(run, T.StructType([*rest, T.StructField(out, kind)]))


def p6_ids(spark, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p6_sizes(spark, sf_dir: str) -> DataFrame:
    """Documents, characters and tokens per source."""
    docs = encoded(table(spark, sf_dir, "documents").select("source", F.length("text").alias("n_chars"), "text"), out="n_tokens", counts_only=True)
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))
