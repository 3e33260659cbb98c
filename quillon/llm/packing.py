"""Concatenate-and-cut packing of tokenised documents into fixed windows."""

from __future__ import annotations

import re
import zlib
from itertools import accumulate

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import release, shared_checkpoints

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: outside these characters, or with a special token's string, a text goes through the tokenizer file itself
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-ɏ]")
_encoders: dict = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str | None = None, ranks: str | None = None):
    """A function from a list of texts to lists of ids: those of the tokenizer file, without added special tokens.

    Texts of Latin letters and ASCII go through the rank table of the same vocabulary, whose ids are
    the same and which is several times faster; all others through the tokenizer file.
    """
    path, ranks = path or vocabulary_path(VOCABULARY), ranks or vocabulary_path(RANKS)
    if (path, ranks) not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        slow = Tokenizer.from_file(path)

        def one(text: str) -> list[int]:
            if _PLAIN.search(text) or "<|" in text:
                return slow.encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _encoders[path, ranks] = one
    return _encoders[path, ranks]


def vocabulary_size(path: str | None = None) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path or vocabulary_path(VOCABULARY)).get_vocab_size()


def _tokenised(path, ranks, end_id, width):
    def run(batches):
        import pyarrow as pa

        encode = encoder(path, ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ids = [np.array([*encode(t or ""), end_id], width) for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["doc_id", "doc_tokens", "ids"])
        release()

    return run


def _cut(offsets: dict[int, int], window: int, width, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), None
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
        for batch in batches:
            out = [[] for _ in names]
            if at is None and batch.num_rows:
                at = offsets[part]  # a partition that was not totalled is an error, not offset 0
            for doc, total, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                ids, start = np.frombuffer(raw, width).astype("<u4"), 0
                while start < total:
                    length = min(total - start, window - at % window)
                    piece = ids[start : start + length]
                    row = (doc, start, length, zlib.crc32(piece.tobytes()), total, at // window, at % window, piece.tolist())
                    for column, x in zip(out, row, strict=False):
                        column.append(x)
                    start, at = start + length, at + length
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return run


def pack(docs: DataFrame, window: int = 2048, end_id: int = 1, path: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of documents in full windows: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    First pass: tokenise each partition once into the shared checkpoint folder and total its tokens.
    The totals, one number a partition, are summed in partition order. Second pass: each partition
    starts at its global offset and cuts at every multiple of the window; a document that crosses a
    boundary has a record on each side. Only the last window is short. Null texts are empty and have
    only the end id; repeated rows are packed as often as they occur; an empty table has no pieces.
    """
    shared_checkpoints(docs.sparkSession)
    width = "<u4" if max(end_id, vocabulary_size(path) - 1) >= 1 << 16 else "<u2"
    tokens = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenised(path, ranks, end_id, width), "doc_id long, doc_tokens long, ids binary").checkpoint()
    totals = sorted((r[0], r[1]) for r in tokens.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("doc_tokens")).collect())
    offsets = dict(zip((p for p, _ in totals), [0, *accumulate(n for _, n in totals)], strict=False))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<long>" * with_ids
    return tokens.mapInArrow(_cut(offsets, window, width, with_ids), schema)
