"""Quality score from compression with two zstandard dictionaries, one of good and one of bad text."""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import slices, spare_name


@dataclass(frozen=True)
class CompressionClassifier:
    """Raw-content dictionaries and the calibration of the normalised size difference."""

    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    level: int = 6

    def sizes(self):
        import zstandard as z

        def compressor(d):
            kept = z.ZstdCompressionDict(d, dict_type=z.DICT_TYPE_RAWCONTENT)
            kept.precompute_compress(level=self.level)
            return z.ZstdCompressor(dict_data=kept, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)

        good, bad = compressor(self.good), compressor(self.bad)
        return lambda t: (len(good.compress(t)), len(bad.compress(t)))

    def score_all(self, texts: list[bytes]) -> np.ndarray:
        size = self.sizes()
        x = np.array([features(*size(t), len(t)) for t in texts]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -40, 40)))


def features(good: int, bad: int, raw: int) -> tuple[float, ...]:
    """1, the normalised compressed-size difference, the same where a text is short, and the two rates.

    The rates (compressed by raw size, and its square) calibrate the difference: text that shrinks to
    almost nothing with either dictionary, or that neither shrinks, is seldom good.
    """
    d, rate = (bad - good) / max(good, bad, 1), min(1.5, good / (raw + 20))
    return 1.0, d, d * 200.0 / (200.0 + raw), rate, rate * rate, d * d


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01, rounds: int = 60) -> np.ndarray:
    """Newton's method for regularised logistic regression; the constant is not penalised."""
    w = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], ridge)
    pen[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(pen)
        step = np.linalg.solve(h, x.T @ (y - p) - pen * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


#: bytes of one piece of a text in a dictionary
PIECE = 256


def spread_pieces(raw: bytes, share: int, piece: int = PIECE) -> bytes:
    """About ``share`` bytes in pieces at even distances over the whole text; a text of no more is taken whole."""
    if len(raw) <= share:
        return raw
    n = max(1, share // piece)
    last = len(raw) - piece
    return b" ".join(raw[at : at + piece] for at in (last * (2 * i + 1) // (2 * n) for i in range(n)))


def _pieces(share: tuple[int, int]):
    def run(batches):
        import pyarrow as pa

        for rows, texts in slices(batches):
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([spread_pieces(t, share[q]) for t, q in zip(texts, rows.column(1).to_pylist(), strict=True)], pa.binary())], ["k", "q", "part"])

    return run


def _sized(model: CompressionClassifier):
    def run(batches):
        import pyarrow as pa

        size = model.sizes()
        for rows, texts in slices(batches):
            x = [list(features(*size(t), len(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(x, pa.list_(pa.float64()))], ["k", "q", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, sample: int = 3000, dictionary: int = 400_000) -> CompressionClassifier:
    """Fit on labelled rows with crc32(doc_id as text) mod ``folds`` not 0; other labels are never read.

    At most ``sample`` rows of each label are used, those with the smallest hashes of doc_id. Half of
    them fill the dictionaries: each text gives an even share of the ``dictionary`` bytes (at least
    one piece), in pieces spread over the whole text. The other half calibrates on whole texts, which
    are compressed on the executors. The driver gathers the dictionaries' bytes and six numbers a row.
    Null texts are empty; repeated rows of a doc_id count once, with the larger label. With a label
    missing, or no labels at all, scores are constant at the smoothed share of good rows.
    """
    rows = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % folds != 0)
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("k")).agg(F.max("quality").alias("quality"))
    rows = rows.where("quality = 0").orderBy(F.xxhash64("k"), "k").limit(sample).unionByName(rows.where("quality = 1").orderBy(F.xxhash64("k"), "k").limit(sample))
    picked = sorted((zlib.crc32(b"half%d" % r[0]), r[0], int(r[1])) for r in rows.collect())
    turn, parts = {0: 0, 1: 0}, {(q, h): [] for q in (0, 1) for h in (0, 1)}
    for _, k, q in picked:
        parts[q, turn[q]].append(k)
        turn[q] ^= 1
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def texts_of(half: int) -> DataFrame:
        wanted = docs.sparkSession.createDataFrame([(k, q) for q in (0, 1) for k in parts[q, half]] or [(None, None)], "k long, q int")
        return base.join(F.broadcast(wanted), F.col("doc_id") == F.col("k")).select("k", "q", "text")  # at most 2 x sample rows of two numbers

    share = tuple(max(PIECE, dictionary // max(1, len(parts[q, 0]))) for q in (0, 1))
    found = {(q, k): part for k, q, part in sorted(tuple(r) for r in texts_of(0).mapInArrow(_pieces(share), "k long, q int, part binary").collect())}
    good, bad = (b"\n".join(bytes(found[q, k]) for k in parts[q, 0] if found.get((q, k))) or b" " for q in (1, 0))
    seen = sorted(set(parts[0, 1]) | set(parts[1, 1]))
    if seen and parts[0, 1] and parts[1, 1]:
        model = CompressionClassifier(good, bad, (0.0,))
        got = sorted({(r[0], r[1], tuple(r[2])) for r in texts_of(1).mapInArrow(_sized(model), "k long, q int, x array<double>").collect()})
        y = np.array([float(q) for _, q, _ in got])
        if 0 < y.sum() < len(y):
            return CompressionClassifier(good, bad, tuple(float(v) for v in fit_logistic(np.array([x for _, _, x in got]), y)))
    of = [q for _, _, q in picked]
    share = (sum(of) + 1) / (len(of) + 2)
    return CompressionClassifier(good, bad, (math.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0, 0.0))


def _scored(model: CompressionClassifier, name: str):
    def run(batches):
        import pyarrow as pa

        for rows, texts in slices(batches):
            s = model.score_all(texts)
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(s, pa.float64())], [*rows.schema.names, name])

    return run


def score(docs: DataFrame, model: CompressionClassifier, name: str = "_score") -> DataFrame:
    """The rows with their score (0 to 1) in a column ``name``, which must be new.

    Whole texts are compressed, one at a time; null texts count as empty, which have a score like any
    other; repeated rows score alike; an empty table stays empty.
    """
    from pyspark.sql import types as T

    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")
    return docs.mapInArrow(_scored(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def kept(docs: DataFrame, model: CompressionClassifier, threshold: float = 0.3) -> DataFrame:
    """The rows that score at least the threshold, with the columns of docs, whatever their names."""
    name = spare_name(docs, "_score")
    return score(docs, model, name).where(F.col(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(docs: DataFrame, model: CompressionClassifier, folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row, ties and repeated rows alike.

    Only doc_id and text are read, so other columns may have any name. A null text is empty; a null
    doc_id is not held out; texts of any length are scored whole; an empty table gives no rows.
    """
    s = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0
    return s.select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))
