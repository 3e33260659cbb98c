"""Byte-level helpers shared by the text operators.

Texts reach Python as Arrow batches and are worked on in slices of about a megabyte, so that
memory does not follow the batch size. Words are hashed for a whole slice at once: a polynomial
hash over the UTF-8 bytes, taken as a difference of prefix sums modulo 2**64.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import numpy as np

M64 = (1 << 64) - 1
_P = 0x9E3779B97F4A7C55
_PI = pow(_P, -1, 1 << 64)
_powers = {"n": 0, "p": None, "q": None}
WHITE = np.ones(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: word bytes of [0-9a-z] and everything outside ASCII, after lower-casing
ALNUM = np.array([0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])
#: A-Z to a-z, word bytes kept, all others to a space
SPACED = bytes((b + 32 if 0x41 <= b <= 0x5A else b) if ALNUM[b] else 0x20 for b in range(256))


def shared_checkpoints(spark) -> None:
    """Use the cluster's spark.checkpoint.dir; where none is set, a folder of our own in local mode, else an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not path and sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="quillon-checkpoints-"))


#: shuffle files go when the execution that wrote them ends; else they stay until the driver collects its garbage
DROPS = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark):
    """Executions of tables made inside delete their shuffle files when they end; for tables that are run once, to be stored."""
    before = spark.conf.get(DROPS, None)
    spark.conf.set(DROPS, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROPS) if before is None else spark.conf.set(DROPS, before)


#: bytes of a table, as estimated, up to which a join broadcasts it while a table is stored
BROADCAST = 256 << 10


@contextmanager
def small_broadcasts(spark):
    """Joins that run inside broadcast tables of at most BROADCAST bytes, or less where the session says so.

    With Spark's 10 MB, steps of many joins broadcast tables that grow with the documents: each passes
    through the driver, as a hash table several times the size of the file or rows that it was estimated by.
    """
    most = min(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold(), BROADCAST)
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    before = [spark.conf.get(name, None) for name in names]
    for name in names:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, value in zip(names, before, strict=True):
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def storing(spark):
    with shuffles_dropped(spark), small_broadcasts(spark):
        yield


def stored(df):
    """The rows written to the shared checkpoint folder and reread; ``unstored`` deletes them.

    Unlike a checkpoint, the table has its real size as its statistics and no constraints of the plan
    behind it: in loops of joins those of checkpoints multiply from round to round.
    """
    spark = df.sparkSession
    shared_checkpoints(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    with storing(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def unstored(*tables) -> None:
    """Deletes tables of ``stored`` that nothing still to be computed reads; others are left alone."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spare_name(df, name: str) -> str:
    """A column name like ``name`` that the table does not have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_codes(lower: bool) -> np.ndarray:
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    if lower:
        codes[0x41:0x5B] = codes[0x61:0x7B]
    return codes


LOWERED = byte_codes(True)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 1 << 20)
        for name, base in (("p", _P), ("q", _PI)):
            t = np.empty(size, np.uint64)
            t[0], have = 1, 1
            while have < size:
                more = min(have, size - have)
                t[have : have + more] = t[:more] * np.uint64(pow(base, have, 1 << 64))
                have += more
            _powers[name] = t
        _powers["n"] = size
    return _powers["p"], _powers["q"]


def segment_hashes(a: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray = LOWERED) -> np.ndarray:
    """A 64-bit hash of each byte range of ``a``; equal ranges have equal hashes."""
    p, q = _power_tables(len(a) + 1)
    s = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(codes[a] * p[: len(a)], out=s[1:])
    return mix((s[ends] - s[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def word_spans(a: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(a) + 2, np.int8)
    inside[1:-1] = is_word[a]
    d = np.diff(inside)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def release() -> None:
    """Gives memory that is free but still held by the allocators back to the system.

    Python workers are reused: without this, each keeps the most that any task before has needed.
    """
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def slices(batches, text: str = "text", limit: int = 1 << 20):
    """(rows of the batch, list of UTF-8 texts) with about ``limit`` bytes each; null texts are empty.

    Only the texts of one slice are Python objects at a time.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        raw = batch.column(batch.schema.get_field_index(text)).cast(pa.binary())
        size = np.cumsum(pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        first = 0
        while first < len(raw):
            end = min(int(np.searchsorted(size, (size[first - 1] if first else 0) + limit)) + 1, len(raw))
            yield batch.slice(first, end - first), [t or b"" for t in raw.slice(first, end - first).to_pylist()]
            first = end
    release()


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with a newline after each, as bytes, and where each begins (one more at the end)."""
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=at[1:])
    return np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), at


def shingles(texts: list[bytes], size: int, codes: np.ndarray = LOWERED) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``size``-word runs, A-Z lower-cased.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    a, at = joined(texts)
    starts, ends = word_spans(a, WHITE)
    h = segment_hashes(a, starts, ends, codes)
    first = np.searchsorted(starts, at)  # first word of each text
    g = np.zeros(len(h), np.uint64)
    for j in range(size):
        part = h[j:] * np.uint64(pow(0xA24BAED4963EE407, j + 1, 1 << 64))
        g[: len(part)] += part
    g = mix(g)
    out = []
    for i in range(len(texts)):
        b, e = first[i], first[i + 1]
        if e - b >= size:
            out.append(np.unique(g[b : e - size + 1]))
        elif e > b:
            w = h[b:e] * np.array([pow(0xA24BAED4963EE407, j + 1, 1 << 64) for j in range(e - b)], np.uint64)
            out.append(mix(np.array([(int(w.sum()) + int(e - b) * 0x5851F42D4C957F2D) & M64], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
