"""Document fingerprints: every shingle hash below a fixed fraction of the hash range, with a floor for short texts.

A text keeps all hashes up to 1 / ``scale`` of the range; where that is fewer than ``floor`` of them,
the limit is raised to its ``floor``-th smallest hash. The limit is part of the fingerprint. Two
fingerprints are compared, and merged, below the smaller of their limits, where both hold every
hash of their texts: the estimates stay unbiased however unequal the texts are.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import mix, shingles

#: one in so many shingle hashes is kept, and at least so many of a text
SCALE, FLOOR = 64, 128
#: bits of a hash that count
BITS = 40


class Sketch:
    """n shingles, the limit, and the sorted hashes up to it."""

    __slots__ = ("hashes", "limit", "n")

    def __init__(self, n: int, limit: int, hashes: np.ndarray):
        self.n, self.limit, self.hashes = n, limit, hashes

    def below(self, limit: int) -> np.ndarray:
        return self.hashes[: np.searchsorted(self.hashes, np.uint64(limit), side="right")]

    def encoded(self) -> str:
        """n and the limit in hex, and the hashes as base64 of five bytes each."""
        raw = self.hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - BITS // 8 :]
        return f"{self.n:x}:{self.limit:x}:{base64.b64encode(raw.tobytes()).decode()}"

    @staticmethod
    def decoded(text: str) -> Sketch:
        n, limit, code = text.split(":")
        raw = np.frombuffer(base64.b64decode(code), np.uint8).reshape(-1, BITS // 8)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, 8 - BITS // 8 :] = raw
        return Sketch(int(n, 16), int(limit, 16), wide.view(">u8").ravel().astype(np.uint64))


def sketch_of(shingle_hashes: np.ndarray, scale: int = SCALE, floor: int = FLOOR) -> Sketch:
    h = np.unique(mix(shingle_hashes) >> np.uint64(64 - BITS))
    limit = (1 << BITS) // scale - 1
    if np.searchsorted(h, np.uint64(limit), side="right") < floor:
        limit = int(h[floor - 1]) if len(h) > floor else (1 << BITS) - 1
    return Sketch(len(h), limit, h[: np.searchsorted(h, np.uint64(limit), side="right")])


def sketches(texts: list[bytes], size: int = 5, scale: int = SCALE, floor: int = FLOOR) -> list[Sketch]:
    return [sketch_of(s, scale, floor) for s in shingles(texts, size)]


def containment(a: Sketch, b: Sketch) -> float:
    """The estimated share of a's shingles that b has; unequal sizes do not matter."""
    limit = min(a.limit, b.limit)
    x, y = a.below(limit), b.below(limit)
    return float(np.isin(x, y, assume_unique=True).mean()) if len(x) else 0.0


def likeness(a: Sketch, b: Sketch) -> float:
    """The estimated Jaccard similarity, held to what the two sizes allow; two empty sets are alike."""
    if not a.n or not b.n:
        return float(a.n == b.n)
    limit = min(a.limit, b.limit)
    x, y = a.below(limit), b.below(limit)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return min(both / max(1, len(x) + len(y) - both), min(a.n, b.n) / max(a.n, b.n))


def merged(a: Sketch, b: Sketch) -> Sketch:
    """The sketch of both texts' shingles together; their number is estimated from the hashes below the limit."""
    limit = min(a.limit, b.limit)
    h = np.union1d(a.below(limit), b.below(limit))
    n = len(h) if limit == (1 << BITS) - 1 else round(len(h) * (1 << BITS) / (limit + 1))
    return Sketch(max(n, a.n, b.n), limit, h)


def _rows(size: int, scale: int, floor: int):
    def run(batches):
        import pyarrow as pa

        def fields(rows):
            """Rows are (doc_id, text, next document's text)."""
            texts, edited = [t for _, t, _ in rows], []
            for _, t, other in rows:
                k = len(t) // 4
                edited.append(t[: len(t) - k] + other[:k] if k else t)
            raw = [t.encode() for t in texts] + [t.encode() for t in edited] + [t.encode() for _, _, t in rows]
            n, kept = len(rows), sketches(raw, size, scale, floor)
            code = [k.encoded() for k in kept[: 2 * n]]
            pairs = [[(kept[i], kept[i + m], raw[i] == raw[i + m]) for i in range(n)] for m in (n, 2 * n)]
            like, held = ([[1.0 if same else f(a, b) for a, b, same in p] for p in pairs] for f in (likeness, containment))
            return pa.RecordBatch.from_arrays([
                pa.array([d for d, _, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in raw[n : 2 * n]]), pa.array(code[:n]), pa.array(code[n:]),
                *(pa.array(x, pa.float64()) for x in (*like, *held)),
            ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"])

        waiting, ready, have, bucket = None, [], 0, None
        for batch in batches:
            for b, doc, text, lead in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                text = text or ""
                if waiting is not None and b == bucket:
                    ready.append((*waiting, text))
                    have += 2 * len(text) + len(waiting[1])
                waiting, bucket = (None if lead else (doc, text)), b
                if have > 1 << 20:
                    yield fields(ready)
                    ready, have = [], 0
        if ready:
            yield fields(ready)

    return run


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, doc_id, text, lead), sorted: documents dealt by doc_id range, each range followed by the first
    document of the next one as a boundary record (lead). After the last document comes the first."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bounds = d.where("doc_id IS NOT NULL").approxQuantile("doc_id", [i / buckets for i in range(1, buckets)], 0.0005) if buckets > 1 else []
    bounds = sorted({int(x) for x in bounds})  # one number a partition
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    if bounds:  # a binary search for the number of bounds up to doc_id
        at = F.array(*(F.lit(x).cast("long") for x in bounds))
        place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, p: n + F.when((n + p <= len(bounds)) & (F.col("doc_id") >= F.try_element_at(at, n + p)), p).otherwise(0))
    else:
        place = F.lit(0)
    d = d.withColumn("bucket", place)
    order = F.struct(F.col("doc_id").isNotNull().alias("n"), "doc_id", F.xxhash64("text").alias("h"))
    heads = {r[0]: r[1] for r in d.groupBy("bucket").agg(F.min(order).alias("o")).select("bucket", "o").collect()}
    if not heads:
        return d.select("bucket", "doc_id", "text", F.lit(False).alias("lead")).where("false")
    used = sorted(heads)
    before = dict(zip(used, [used[-1], *used], strict=False))
    every = range(len(bounds) + 1)  # one entry a bucket, looked up by position
    of = lambda values, kind: F.try_element_at(F.array(*(F.lit(v).cast(kind) for v in values)), F.col("bucket") + 1)
    is_head = F.col("doc_id").eqNullSafe(of([heads[b]["doc_id"] if b in heads else None for b in every], "long")) & (F.xxhash64("text") == of([heads[b]["h"] if b in heads else None for b in every], "long"))
    own, lead = F.struct(F.col("bucket").alias("b"), F.lit(False).alias("lead")), F.struct(of([before.get(b, 0) for b in every], "int").alias("b"), F.lit(True).alias("lead"))
    copies = F.when(is_head, F.array(own, lead)).otherwise(F.array(own))
    rows = d.select("doc_id", "text", F.explode(copies).alias("x")).select(F.col("x.b").alias("bucket"), "doc_id", "text", "x.lead")
    # one bucket a partition, by number: hashing the numbers would leave some partitions empty and others with several
    return rows.repartitionById(max(buckets, len(bounds) + 1), "bucket").sortWithinPartitions("bucket", "lead", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))


def fingerprints(docs: DataFrame, size: int = 5, scale: int = SCALE, floor: int = FLOOR, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, in_edited, in_next of every document.

    Shingles are of ``size`` words, A-Z lower-cased; a shorter text has its whole sequence as one.
    near_ columns are estimates of Jaccard similarity, in_ columns of the share of the document's
    shingles that the other text has, all from the fingerprints as they are given. Whole texts
    are read, however long. Null texts are empty; texts without words have no hashes, and are alike. Rows
    follow each other by doc_id, nulls first, ties by text hash; a single document is its own next
    one; an empty table has no rows. Other columns are not read. doc_id is taken to be (nearly) unique.
    """
    n = buckets or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"
    return with_next(docs, n).mapInArrow(_rows(size, scale, floor), schema)
