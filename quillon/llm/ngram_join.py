"""N-gram Jaccard self-join with PartEnum signatures (exact; no cap on partners).

Sets are put in size levels. For two linked sets the smaller one's level fixes how far apart they
may be (k, as symmetric difference). The feature domain is hashed into n1 first-level parts of n2
second-level parts; with n1 > k / (k2 + 1), one first-level part differs in at most k2 features, so
n2 - k2 of its second-level parts are equal. Each subset of n2 - k2 second-level parts of each
first-level part is one signature, and linked sets share at least one. Larger levels have a few
first-level parts to spare, so that subsets of empty parts, which unrelated sets share, can be left out.

Signatures never become rows: each map task packs them into byte blocks by signature range, and
each range is sorted once in numpy. Sets that share a signature in a small bucket are candidate
pairs, which sizes and parity sketches (exact bounds) thin out; those of a larger bucket are tied to
its smallest set key, not paired. Pairs and ties are closed to candidate clusters, and links inside
a cluster are verified exactly, in chunks of bounded size, so that no task holds an unbounded group.

A cluster of many chunks is first divided by sketches: its members are compared by sizes and sketches
alone, which are a few hundredths of the features, and what they do not rule out ties the new
clusters. Sets that only share common features in large buckets fall apart there, and their features
are never dealt out chunk against chunk.

A cluster that is still of many chunks is then thinned around pivots. All members are measured against a few
candidate pivots; those linked with the best one are its core, one component already, and are not
compared with each other. Jaccard distance is a metric, so a member further from the pivot than
twice the linking distance links with no one in the core; the ring between is compared with the
core, and ring and rest go on to the next round, with a new pivot. A group of near copies of any
size thus costs a few passes over its rows. What rounds no longer thin is verified chunk against
chunk. Tasks return a spanning forest of links.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm._text import M64, mix, shared_checkpoints, shingles, slices, spare_name, stored, storing, unstored
from quillon.llm.components import connected_components

LEVEL = 1.5
#: signatures in one range, shingles in one verification chunk
RANGE, CHUNK = 1_000_000, 1_000_000
#: members of a bucket whose pairs are looked at one by one
SMALL = 24
#: rounds of pivots at most, candidates by hash in each, and the share of rows below which a round is the last
ROUNDS, SAMPLED, WORTH = 12, 6, 0.1
#: sets in one verification chunk, however small; pairs held before they are verified
MEMBERS, PAIRS = 100_000, 1_000_000
#: pivots tried within a chunk, and candidates for each
CORES, TRIED = 8, 16
#: words that a set has in a chunk of sketches besides its sketch; members of a component of sketches from which it is probed first
BESIDES, PROBED = 8, 256


def level_of(n: int) -> int:
    return int(math.log(n) / math.log(LEVEL) + 1e-9)


@lru_cache(None)
def differences(level: int, percent: int) -> int:
    """The largest symmetric difference of a linked pair whose smaller set is of this level."""
    s = int(LEVEL ** (level + 1) + 1)
    while level_of(s) > level:
        s -= 1
    return (100 - percent) * (s + 100 * s // percent) // (100 + percent)


def set_key(g: np.ndarray) -> int:
    """A 64-bit key of a set, signed; equal sets have equal keys, the empty set has 0."""
    x = (int(mix(g).sum()) ^ int(mix(g + np.uint64(0x1234567)).sum()) * 0x9E3779B97F4A7C15) & M64
    return (x - (1 << 64) if x >> 63 else x) if len(g) else 0


def partition_shape(percent: int) -> tuple[int, int]:
    """(k2, n2): the differences allowed in one first-level part, and its second-level parts.

    The lower the similarity, the more parts a set has and the fewer features are in each; with more
    second-level parts a signature takes in more of them, so that common features alone seldom make one.
    """
    return (1, 3) if percent >= 75 else (2, 5)


@lru_cache(None)
def spare_parts(n1: int, n2: int, k2: int, level: int) -> int:
    """More first-level parts than needed: enough that nearly all sets of the level have no more with an empty subset."""
    expected = n1 * math.comb(n2, k2) * math.exp(-(LEVEL**level) * (n2 - k2) / (n2 * n1))
    return min(math.ceil(expected + 4 * math.sqrt(expected) + 0.5), max(n1 // 6, int(n1 >= 4)))


def signatures(g: np.ndarray, percent: int, shape: tuple[int, int] | None = None) -> np.ndarray:
    """All PartEnum signatures of one set of feature hashes."""
    n, out = len(g), []
    if not n:
        return np.zeros(0, np.uint64)
    k2, n2 = shape or partition_shape(percent)
    subsets = list(combinations(range(n2), n2 - k2))
    for level in range(level_of(-(-percent * n // 100)), level_of(n) + 1):
        k, salt = differences(level, percent), np.uint64(level * 0x9E3779B97F4A7C15 & M64)
        if k == 0:
            out.append(mix(np.array([(int(mix(g).sum()) + int(salt)) & M64], np.uint64)))
            continue
        n1 = k // (k2 + 1) + 1
        spare = spare_parts(n1, n2, k2, level)
        n1 += spare
        x = mix(g + salt)
        cell = ((x >> np.uint64(32)) % np.uint64(n1)).astype(np.int64) * n2 + ((x & np.uint64(0xFFFFFFFF)) % np.uint64(n2)).astype(np.int64)
        sums = np.zeros(n2 * n1, np.uint64)
        np.add.at(sums, cell, mix(x))
        c = sums.reshape(n1, n2)
        part = np.arange(n1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + salt
        empty = c == 0
        # with spare parts, spare + 1 of them agree; a set with at most spare parts that have an empty subset leaves those subsets out
        drop = bool(spare) and int((empty.sum(1) >= n2 - k2).sum()) <= spare
        scrambled = mix(c + np.arange(1, n2 + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        for i, t in enumerate(subsets):
            y = mix(scrambled[:, t].sum(1) + part + np.uint64(i * 7919 + 1))
            out.append(y[~empty[:, t].all(1)] if drop else y)
    return np.concatenate(out)


def _keys(size: int, percent: int):
    def run(batches):
        import pyarrow as pa

        for rows, texts in slices(batches):
            sets = shingles(texts, size)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([parity_sketch(s, percent) for s in sets], pa.binary())], ["doc_id", "row_key", "n_shingles", "set_key", "sketch"])

    return run


def _blocks(size: int, percent: int, ranges: int, limit: int = 2_000_000):
    def run(batches):
        import pyarrow as pa

        def flush(sigs, keys):
            s, k = np.concatenate(sigs), np.concatenate(keys)
            to = (s >> np.uint64(32)) % np.uint64(ranges)
            order = np.argsort(to, kind="stable")
            s, k, to = s[order].astype(np.uint32), k[order], to[order]
            cut = np.flatnonzero(np.diff(to)) + 1
            begin, end = np.r_[0, cut], np.r_[cut, len(to)]
            for i in range(0, len(begin), 16):
                part = range(i, min(i + 16, len(begin)))
                yield pa.RecordBatch.from_arrays([pa.array([int(to[begin[j]]) for j in part], pa.int32()), pa.array([s[begin[j] : end[j]].tobytes() + k[begin[j] : end[j]].tobytes() for j in part], pa.binary())], ["r", "block"])

        sigs, keys, have = [], [], 0
        for _, texts in slices(batches):
            for g in shingles(texts, size):
                if len(g):
                    sigs.append(x := signatures(g, percent))
                    keys.append(np.full(len(x), set_key(g), np.int64))
                    have += len(x)
            if have >= limit:
                yield from flush(sigs, keys)
                sigs, keys, have = [], [], 0
        if have:
            yield from flush(sigs, keys)

    return run


def _candidates(table):
    """The signature range's buckets of at least two set keys: all pairs of a small bucket, and for a
    larger one ties of its members to the smallest key."""
    import pyarrow as pa

    sig, key = [], []
    for b in table.column("block").to_pylist():
        n = len(b) // 12
        sig.append(np.frombuffer(b, np.uint32, n))
        key.append(np.frombuffer(b, np.int64, n, 4 * n))
    sig, key = np.concatenate(sig), np.concatenate(key)
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    new = np.r_[True, (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])]
    sig, key = sig[new], key[new]
    begin = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    size = np.diff(np.r_[begin, len(sig)])
    run, small = np.repeat(np.arange(len(begin)), size), np.repeat(size <= SMALL, size)
    pairs = [np.zeros((0, 2), np.int64)]
    for d in range(1, min(SMALL, int(size.max(initial=1)))):
        i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
        pairs.append(np.stack([key[i], key[i + d]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    low = np.repeat(key[begin], size)
    tied = ~small & (key != low)
    ties = np.unique(np.stack([low[tied], key[tied]], 1), axis=0)
    both = np.concatenate([pairs, ties])
    return pa.table({"a": pa.array(both[:, 0], pa.int64()), "b": pa.array(both[:, 1], pa.int64()), "tie": pa.array(np.arange(len(both)) >= len(pairs))})


def parity_sketch(g: np.ndarray, percent: int) -> bytes:
    """Parities of the features hashed to a power of two of bits, about four times the allowed differences.

    Differing bits of two sketches, the longer one folded, are never more than the differing features.
    """
    n = len(g)
    words = 1
    while 16 * words * (100 + percent) < (100 - percent) * (n + 100 * n // percent):
        words *= 2
    x, out = mix(g + np.uint64(77)), np.zeros(words, np.uint64)
    np.bitwise_xor.at(out, ((x >> np.uint64(40)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    return out.tobytes()


def _near(percent: int):
    """Keeps the pairs that sizes and sketches do not rule out."""

    def fold(s, words):
        s = np.frombuffer(s, np.uint64)
        return np.bitwise_xor.reduce(s.reshape(-1, words), 0)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            na, nb = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ok = percent * np.maximum(na, nb) <= 100 * np.minimum(na, nb)
            sa, sb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            for i in np.flatnonzero(ok):
                words = min(len(sa[i]), len(sb[i])) // 8
                d = int(np.bitwise_count(fold(sa[i], words) ^ fold(sb[i], words)).sum())
                ok[i] = d * (100 + percent) <= (100 - percent) * int(na[i] + nb[i])
            yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _sets(size: int):
    """Feature arrays of the rows whose text has the expected set key, once for adjacent repeated rows; other columns stay."""

    def run(batches):
        import pyarrow as pa

        last = None
        for rows, texts in slices(batches):
            names = rows.schema.names
            sets, keys, keep = shingles(texts, size), rows.column(names.index("set_key")).to_pylist(), []
            for i, s in enumerate(sets):
                if set_key(s) == keys[i] and keys[i] != last:
                    keep.append(i)
                    last = keys[i]
            rows = rows.take(pa.array(keep, pa.int64()))
            features = pa.array([sets[i].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([features if name == "text" else rows.column(i) for i, name in enumerate(names)], ["features" if name == "text" else name for name in names])

    return run


def shared(p: np.ndarray, q: np.ndarray) -> int:
    """The size of the intersection of two sorted sets."""
    small, large = (p, q) if len(p) <= len(q) else (q, p)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int((large[np.minimum(at, len(large) - 1)] == small).sum())


def _measured(percent: int):
    """Of each member of a chunk, against each candidate pivot of its cluster: 2 linked, 1 within twice the linking distance, else 0."""

    def run(table):
        import pyarrow as pa

        keys, own = table.column("set_key").to_pylist(), table.column("own").to_pylist()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("features").to_pylist()]
        pivots = [p["key"] for p in table.column("pivots")[0].as_py()]
        of = dict(zip(keys, sets, strict=True))
        out = []
        for s, mine in zip(sets, own, strict=True):
            if mine:
                row = []
                for p in pivots:
                    same = shared(s, of[p])
                    union = len(s) + len(of[p]) - same
                    row.append(2 if 100 * same >= percent * union else int(100 * (union - same) <= 2 * (100 - percent) * union))
                out.append(row)
        table = table.select(["set_key", "rep", "n", "degree", "cluster", "pivots"]).filter(pa.array(own))
        return table.append_column("near", pa.array(out, pa.list_(pa.int32())))

    return run


def linked_forest(ids: np.ndarray, sets: list[np.ndarray], sides: np.ndarray, percent: int, core: int | None = None) -> tuple[list, list]:
    """Edges of a spanning forest of all links between the sets; with two sides, links across them count.
    The members of the side ``core`` are joined already.

    Pairs are first bounded from below by parity sketches (differing parity bits never exceed the
    symmetric difference), then verified exactly unless already joined.
    """
    n = np.array([len(s) for s in sets])
    order = np.lexsort((ids, n))
    ids, n, sides, sets = ids[order], n[order], sides[order], [sets[i] for i in order]
    m = len(ids)
    parent = list(range(m))
    for i in np.flatnonzero(sides == core)[1:] if core is not None else ():
        parent[i] = int(np.argmax(sides == core))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    words = 1 << max(0, int(np.ceil(np.log2(max(1, 4 * (100 - percent) * 2 * int(n.max()) / (100 + percent) / 64)))))
    words = min(words, 256)
    sk = np.zeros((m, words), np.uint64)
    for i, s in enumerate(sets):
        x = mix(s + np.uint64(77))
        np.bitwise_xor.at(sk[i], ((x >> np.uint64(40)) % np.uint64(words)).astype(np.int64), np.uint64(1) << (x & np.uint64(63)))
    a, b = [], []
    reach = np.searchsorted(n, 100 * n // percent, side="right")  # partners are at most so large
    least = np.searchsorted(n, -(-percent * n // 100), side="left")
    one_side = bool((sides == sides[0]).all())

    def near(i, js):
        d = np.bitwise_count(sk[js] ^ sk[i]).sum(1).astype(np.int64)
        return d, d * (100 + percent) <= (100 - percent) * (n[js] + n[i])

    if one_side and core is None:
        # near copies of one text are joined around it first, so that pairs among them need not be looked at
        loose = np.arange(m)
        for turn in range(CORES):
            if len(loose) < 4 * TRIED:
                break
            tried = loose[np.linspace(0, len(loose) - 1, TRIED).astype(int)]
            sizes = [int(near(i, np.arange(least[i], reach[i]))[1].sum()) for i in tried]
            pivot = int(tried[int(np.argmax(sizes))])
            if max(sizes) < TRIED:
                break
            js = np.arange(least[pivot], reach[pivot])
            js = js[js != pivot]
            d, ok = near(pivot, js)
            _settle([(d[ok] / (n[js[ok]] + n[pivot]), np.full(ok.sum(), pivot), js[ok])], sets, n, parent, root, percent, a, b)
            r = root(pivot)
            loose = np.array([i for i in loose if root(i) != r], np.int64)
    label = np.array([root(i) for i in range(m)])
    found, held = [], 0
    for i in range(m):
        e = reach[i]
        if e <= i + 1:
            continue
        js = np.arange(i + 1, e)
        if not one_side:
            js = js[sides[js] != sides[i]]
        js = js[label[js] != label[i]]
        if not len(js):
            continue
        d, ok = near(i, js)
        if ok.any():
            found.append((d[ok] / (n[js[ok]] + n[i]), np.full(ok.sum(), i), js[ok]))
            held += int(ok.sum())
        if held > PAIRS:
            found, held = _settle(found, sets, n, parent, root, percent, a, b), 0
            label = np.array([root(i) for i in range(m)])
    _settle(found, sets, n, parent, root, percent, a, b)
    return [int(ids[i]) for i in a], [int(ids[j]) for j in b]


def alike_classes(n: np.ndarray, sketches: list[bytes], sides: np.ndarray, percent: int) -> np.ndarray:
    """A label of each set's class under chains of pairs that sizes and parity sketches do not rule out; with two sides, pairs across them count."""
    order = np.lexsort((sides, n))
    n, sides, sketches = n[order].astype(np.int64), sides[order], [np.frombuffer(sketches[i], np.uint64) for i in order]
    words = np.array([len(s) for s in sketches])
    label, members, largest = np.arange(len(n)), {}, -1
    reach = 100 * n // percent  # partners are at most so large
    names = np.unique(sides).tolist()
    folded = {}
    for w in np.unique(words).tolist():
        mine = np.flatnonzero(words == w)
        for side in names:
            # the larger sets that those of w words meet, with sketches folded to w words, one row a word
            at = np.flatnonzero((words >= w) & (n <= reach[mine].max()) & (sides == side))
            rows = np.array([np.bitwise_xor.reduce(sketches[j].reshape(-1, w), 0) for j in at], np.uint64).reshape(-1, w)
            folded[w, side] = at, np.ascontiguousarray(rows.T), np.searchsorted(at, np.arange(len(n)), side="right"), np.searchsorted(n[at], reach, side="right")

    def near(i, at, columns):
        """Those of ``at``, larger sets in ascending order, that i is near to."""
        if not len(at):
            return at
        x, half = sketches[i], (len(columns) + 1) // 2
        d = np.zeros(len(at), np.uint16)
        for c, v in zip(columns[:half], x[:half], strict=True):
            d += np.bitwise_count(c ^ v)
        few = np.flatnonzero(d <= (100 - percent) * int(n[i] + n[at[-1]]) // (100 + percent))
        if not len(few):
            return few
        d = d[few].astype(np.int64) + np.bitwise_count(columns[half:, few] ^ x[half:, None]).sum(0, dtype=np.int64)
        return at[few[d * (100 + percent) <= (100 - percent) * (n[i] + n[at[few]])]]

    def joined(i, js):
        nonlocal largest
        for j in js[np.unique(label[js], return_index=True)[1]].tolist():
            r, s = int(label[i]), int(label[j])
            if r != s:
                r, s = sorted((r, s), key=lambda k: len(members.get(k, ())))
                less, more = members.pop(r, [r]), members.setdefault(s, [s])
                label[less] = s
                more += less
                if largest < 0 or len(more) > len(members.get(largest, ())):
                    largest = s

    for i in range(len(n)):
        for side in names:
            if len(names) > 1 and side == sides[i]:
                continue
            at, columns, low, high = folded[int(words[i]), side]
            part = slice(low[i], high[i])
            at, columns = at[part], columns[:, part]
            if not len(at) or not members:
                joined(i, near(i, at, columns))
                continue
            of = label[at]
            if label[i] != largest and len(members[largest]) >= PROBED:
                some = np.flatnonzero(of == largest)
                some = some[:: max(1, len(some) // TRIED)]
                joined(i, near(i, at[some], columns[:, some]))
                of = label[at]
            other = np.flatnonzero(of != label[i])
            if 2 * len(other) < len(at):
                at, columns = at[other], columns[:, other]
            joined(i, near(i, at, columns))
    out = np.empty_like(label)
    out[order] = label
    return out


def _alike(percent: int):
    def run(table):
        import pyarrow as pa

        keys, chunk = table.column("set_key").to_numpy(), table.column("chunk").to_numpy()
        if table.column("i")[0].as_py() != table.column("j")[0].as_py() and (chunk == chunk[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "whole": pa.array([], pa.bool_())})  # one side of two is empty
        label = alike_classes(table.column("size").to_numpy(), table.column("sketch").to_pylist(), chunk, percent)
        # each class as a star around its smallest key, which takes the fewest rounds to close
        order = np.lexsort((keys, label))
        keys, label = keys[order], label[order]
        first = np.r_[True, label[1:] != label[:-1]]
        low = keys[first][np.cumsum(first) - 1]
        whole = np.full(int((~first).sum()), table.column("chunks")[0].as_py() == 1)
        return pa.table({"a": pa.array(low[~first], pa.int64()), "b": pa.array(keys[~first], pa.int64()), "whole": pa.array(whole)})

    return run


#: of members with a cluster, its chunks and a chunk: the tasks of a member, one for each pair of chunks with its own
CHUNK_PAIRS = "transform(sequence(0, chunks - 1), x -> struct(cluster AS t, least(x, chunk) AS i, greatest(x, chunk) AS j))"


def divided(members: DataFrame, chunk: int, percent: int) -> DataFrame:
    """(set_key, cluster) for members (set_key, cluster, size, sketch) of large clusters, with the clusters that sizes and sketches leave.

    All pairs of a cluster are looked at, chunk against chunk of sketches, so no link is lost; members that
    are near to no other are in no cluster.
    """
    words = F.length("sketch") / 8 + BESIDES
    sized = members.groupBy("cluster").agg(F.ceil(F.sum(words) / max(1, chunk // 2)).cast("int").alias("chunks")).withColumnRenamed("cluster", "c")
    dealt = members.join(sized, F.col("cluster") == F.col("c")).withColumn("chunk", F.expr("int(pmod(xxhash64(set_key), chunks))"))
    tasks = dealt.select("set_key", "size", "sketch", "chunks", "chunk", F.explode(F.expr(CHUNK_PAIRS)).alias("x")).select("set_key", "size", "sketch", "chunks", "chunk", "x.t", "x.i", "x.j")
    edges = stored(tasks.groupBy("t", "i", "j").applyInArrow(_alike(percent), "a long, b long, whole boolean"))
    # the stars of a cluster of one chunk are its classes already
    done = edges.where("whole").select(F.explode(F.array(F.struct(F.col("b").alias("k"), "a"), F.struct(F.col("a").alias("k"), "a"))).alias("x")).select("x.k", "x.a").distinct()
    closed = connected_components(edges.where("NOT whole").select("a", "b"))
    return closed.unionByName(done.toDF("node", "component")).select(F.col("node").alias("set_key"), F.col("component").alias("cluster"))


def _settle(found, sets, n, parent, root, percent, a, b) -> list:
    if found:
        d, i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        for x in np.argsort(d, kind="stable"):
            p, q = int(i[x]), int(j[x])
            r, s = root(p), root(q)
            if r == s:
                continue
            same = shared(sets[p], sets[q])
            if 100 * same >= percent * (n[p] + n[q] - same):
                parent[max(r, s)] = min(r, s)
                a.append(p)
                b.append(q)
    return []


def _verify(percent: int):
    def run(table):
        import pyarrow as pa

        cluster = table.column("cluster").to_numpy()
        ids, chunk = table.column("set_key").to_numpy(), table.column("chunk").to_numpy()
        i = table.column("i")[0].as_py()
        if i != table.column("j")[0].as_py() and (chunk == chunk[0]).all():
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})  # one side of two is empty
        raw = table.column("features").to_pylist()
        order = np.argsort(cluster, kind="stable")
        cut = np.flatnonzero(np.diff(cluster[order])) + 1
        a, b = [], []
        for part in np.split(order, cut):
            sets = [np.frombuffer(raw[i], np.uint64) for i in part]
            x, y = linked_forest(ids[part], sets, chunk[part], percent, 0 if i <= -2 else None)
            a += x
            b += y
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def around_pivots(members: DataFrame, sets: DataFrame, near: DataFrame, percent: int, chunk: int, alone) -> tuple[DataFrame, DataFrame]:
    """Verification tasks (set_key, rep, cluster, chunk, tasks) of the clusters of many chunks, and links found on the way.

    A round measures every member against the candidates of its cluster (the member of most near pairs
    and some chosen by hash) in chunks that each hold the candidates, takes the one with the largest core, and
    leaves ring and rest. Rounds end when no cluster has more than a chunk, or when they no longer pay.
    """
    degree = near.select(F.explode(F.array("a", "b")).alias("k")).groupBy("k").agg(F.count("*").alias("degree"))
    left = stored(members.join(degree, F.col("set_key") == F.col("k"), "left").select("set_key", "rep", "n", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), "cluster"))
    links, tasks, before = None, None, None
    this = F.struct(F.col("set_key").alias("key"), "rep").alias("p")
    for turn in range(ROUNDS):
        picks = [F.max(F.struct("degree", this)).alias("d"), *(F.min(F.struct(F.xxhash64("set_key", F.lit(turn * SAMPLED + i)), this)).alias(f"h{i}") for i in range(SAMPLED))]
        groups = left.groupBy("cluster").agg(F.sum("n").alias("s"), *picks).where(F.col("s") > chunk)
        groups = stored(groups.select(F.col("cluster").alias("c"), "s", F.array_distinct(F.array("d.p", *(f"h{i}.p" for i in range(SAMPLED)))).alias("pivots"), F.ceil(F.col("s") / chunk).cast("int").alias("chunks")))
        now = groups.agg(F.sum("s")).first()[0] or 0
        if not now or (before is not None and now > (1 - WORTH) * before):
            break
        before = now
        big = left.join(groups, F.col("cluster") == F.col("c")).select(F.col("set_key").alias("k"), "rep", "n", "degree", "cluster", "pivots", "chunks", F.expr("int(pmod(xxhash64(set_key), chunks))").alias("chunk"))
        rows = sets.join(big, F.col("set_key") == F.col("k"))
        rows = rows.select("*", F.explode(F.expr("if(exists(pivots, p -> p.key = set_key), sequence(0, chunks - 1), array(chunk))")).alias("at"))
        rows = rows.select("set_key", "rep", "n", "degree", "cluster", "pivots", "features", "at", (F.col("at") == F.col("chunk")).alias("own"))
        seen = rows.groupBy("cluster", "at").applyInArrow(_measured(percent), "set_key long, rep long, n long, degree long, cluster long, pivots array<struct<key:long,rep:long>>, near array<int>")
        seen = stored(seen.dropDuplicates(["set_key"]))
        cores = F.array(*(F.sum((F.coalesce(F.try_element_at("near", F.lit(i + 1)), F.lit(0)) == 2).cast("long")) for i in range(SAMPLED + 1)))
        best = seen.groupBy("cluster").agg(cores.alias("cores")).select(F.col("cluster").alias("c"), F.expr("int(array_position(cores, array_max(cores)))").alias("best"))
        at = stored(seen.join(best, F.col("cluster") == F.col("c")).select("set_key", "rep", "n", "degree", "cluster", F.element_at("pivots", F.col("best"))["key"].alias("pivot"), F.element_at("near", F.col("best")).alias("v")))
        found = at.where("v = 2").select(F.col("pivot").alias("a"), F.col("set_key").alias("b"))
        links = found if links is None else links.unionByName(found)
        sides = at.groupBy("cluster").agg(*(F.ceil(F.sum(F.expr(f"if(v = {v}, n, 0)")) / chunk).cast("int").alias(name) for v, name in ((1, "rings"), (2, "cores")))).where("rings > 0")
        ring = f"transform(sequence(0, cores - 1), x -> struct(cluster AS t, int({-2 - turn} - {ROUNDS} * pmod(xxhash64(set_key), rings)) AS i, x AS j))"
        core = f"transform(sequence(0, rings - 1), x -> struct(cluster AS t, int({-2 - turn} - {ROUNDS} * x) AS i, int(pmod(xxhash64(set_key), cores)) AS j))"
        crossed = at.where("v > 0").join(sides.withColumnRenamed("cluster", "c"), F.col("cluster") == F.col("c"))
        crossed = crossed.select("set_key", "rep", "cluster", F.expr("if(v = 1, 1, 0)").alias("chunk"), F.expr(f"if(v = 1, {ring}, {core})").alias("tasks"))
        tasks = crossed if tasks is None else tasks.unionByName(crossed)
        small = left.join(groups.select("c"), F.col("cluster") == F.col("c"), "left_anti")
        last = left
        left = stored(at.where("v < 2").select(left.columns).unionByName(small))
        unstored(seen, last)
    sized = left.groupBy("cluster").agg(F.ceil(F.sum("n") / chunk).cast("int").alias("chunks")).withColumnRenamed("cluster", "c")
    rest = left.join(sized, F.col("cluster") == F.col("c")).withColumn("chunk", F.expr("int(pmod(xxhash64(set_key), chunks))"))
    rest = rest.select("set_key", "rep", "cluster", "chunk", F.when(F.col("chunks") == 1, alone).otherwise(F.expr(CHUNK_PAIRS)).alias("tasks"))
    return rest if tasks is None else rest.unionByName(tasks), links


def _classes(docs: DataFrame, size: int, percent: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row_key, n_shingles, set_key), one for each of docs, and the class of every set: (k, rep, component).

    Nodes are set keys, so that documents of one doc_id with different texts are different nodes. The
    class is named by its smallest set key. docs are (doc_id, row_key, text).
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    base = docs.select("doc_id", "text")
    keyed = docs.mapInArrow(_keys(size, percent), "doc_id long, row_key string, n_shingles long, set_key long, sketch binary").checkpoint()
    total = keyed.agg(F.sum("n_shingles")).first()[0] or 0
    ranges = max(64, math.ceil(total * 0.5 / RANGE))
    blocks = base.mapInArrow(_blocks(size, percent, ranges), "r int, block binary")
    with storing(spark):
        found = blocks.groupBy("r").applyInArrow(_candidates, "a long, b long, tie boolean").checkpoint()
    reps = keyed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.min("sketch").alias("sketch"))
    pairs = found.where("NOT tie").select("a", "b").distinct()
    side = lambda x: reps.select(F.col("set_key").alias(f"k{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
    pairs = pairs.join(side("a"), F.col("a") == F.col("ka")).join(side("b"), F.col("b") == F.col("kb")).select("a", "b", "na", "nb", "sa", "sb")
    with storing(spark):
        near = pairs.mapInArrow(_near(percent), "a long, b long").checkpoint()
    clusters = connected_components(near.unionByName(found.where("tie").select("a", "b")))
    # the weight of a set is its shingles and a part of a chunk, so that chunks are bounded in sets as well
    weight = (F.col("n") + math.ceil(chunk / MEMBERS)).alias("n")
    with storing(spark):
        members = reps.join(clusters, F.col("set_key") == F.col("node")).select("rep", weight, "set_key", F.col("component").alias("cluster"), F.col("n").alias("size"), "sketch").checkpoint()
    sized = members.groupBy("cluster").agg(F.sum("n").alias("s"))
    if (sized.agg(F.max("s")).first()[0] or 0) > chunk:
        large = sized.where(F.col("s") > chunk).select(F.col("cluster").alias("c"))
        many = members.join(large, F.col("cluster") == F.col("c"), "left_semi")
        anew = divided(many, chunk, percent).select(F.col("set_key").alias("k"), F.col("cluster").alias("c"))
        few = members.join(large, F.col("cluster") == F.col("c"), "left_anti").select("rep", "n", "set_key", "cluster")
        with storing(spark):
            members = few.unionByName(many.join(anew, F.col("set_key") == F.col("k")).select("rep", "n", "set_key", F.col("c").alias("cluster"))).checkpoint()
        sized = members.groupBy("cluster").agg(F.sum("n").alias("s"))
    members = members.select("rep", "n", "set_key", "cluster")
    all_of, largest = sized.agg(F.sum("s"), F.max("s")).first()
    # clusters of one chunk share tasks
    alone = F.array(F.struct(F.expr(f"pmod(xxhash64(cluster), {max(64, math.ceil((all_of or 0) / chunk))})").alias("t"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))

    def with_features(rows: DataFrame) -> DataFrame:
        j = base.join(rows, F.col("doc_id") == F.col("rep")).select("text", *rows.columns)
        schema = T.StructType([T.StructField("features", T.BinaryType()), *rows.schema.fields])
        return j.mapInArrow(_sets(size), schema)

    few, links = members, None
    if (largest or 0) > chunk:
        large = sized.where(F.col("s") > chunk).select(F.col("cluster").alias("c"))
        few = members.join(large, F.col("cluster") == F.col("c"), "left_anti")
        many = members.join(large, F.col("cluster") == F.col("c"), "left_semi")
        with storing(spark):
            sets = with_features(many.select("set_key", "rep")).select("set_key", "features").checkpoint()
        parts, links = around_pivots(many, sets, near, percent, chunk, alone)
        parts = parts.select(F.col("set_key").alias("k"), "cluster", "chunk", F.explode("tasks").alias("x"))
        parts = sets.join(parts, F.col("set_key") == F.col("k")).select("set_key", "cluster", "chunk", "features", "x.t", "x.i", "x.j")
    tasks = with_features(few.select("set_key", "rep", "cluster")).select("set_key", "cluster", F.lit(0).alias("chunk"), "features", F.explode(alone).alias("x"))
    tasks = tasks.select("set_key", "cluster", "chunk", "features", "x.t", "x.i", "x.j")
    tasks = tasks if links is None else tasks.unionByName(parts)
    verified = tasks.groupBy("t", "i", "j").applyInArrow(_verify(percent), "a long, b long")
    links = verified if links is None else verified.unionByName(links)
    joined = connected_components(links)
    # what is returned runs under the caller's settings: its joins are by sorting, as all their sides grow with the documents
    known = reps.select("set_key", "rep").join(joined.hint("merge"), F.col("set_key") == F.col("node"), "left")
    return keyed.select("doc_id", "row_key", "n_shingles", "set_key"), known.select(F.col("set_key").alias("k"), "rep", F.coalesce("component", "set_key").alias("component"))


def _row_key():
    id_, text = F.col("doc_id").cast("long").cast("string"), F.concat(F.lit("="), "text")
    return F.md5(F.concat_ws("\0", F.coalesce(id_, F.lit("")), F.coalesce(text, F.lit("-"))))


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key, text): rows of one doc_id and one text have one row key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row_key().alias("row_key"), "text")


def ngram_join(docs: DataFrame, size: int = 4, percent: int = 85, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents joined by chains of links of at least ``percent`` Jaccard.

    Only doc_id and text are read; other columns, whatever their names, are ignored. Null or empty
    texts have an empty set and link with nothing. Texts of any length are read whole. Equal sets are
    one set from the start. Repeated rows give one result row each; rows of one doc_id with different texts are
    classed apart. A null doc_id keeps its row, with a null component unless its set is that of a document
    with an id. Set keys and features are 64-bit hashes.
    """
    keyed, known = _classes(_rows(docs).withColumn("row_key", F.lit("")), size, percent, chunk)
    low = known.groupBy("component").agg(F.min("rep").alias("low")).withColumnRenamed("component", "c")
    named = known.join(low.hint("merge"), F.col("component") == F.col("c")).select("k", "low")
    out = keyed.join(named.hint("merge"), (F.col("set_key") == F.col("k")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("low", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80, chunk: int = CHUNK) -> DataFrame:
    """The documents' columns, with one row of each class of linked documents.

    The row with the smallest doc_id stays, of several texts of that doc_id the one with the smallest
    row hash, and of identical rows one. Rows of one doc_id with unlinked texts both stay. Documents
    without words are linked with nothing, and only repeated rows of them go. Rows with a null
    doc_id go if their set is that of a document with an id; else, if repeated, one stays.
    """
    keyed, known = _classes(_rows(docs), size, percent, chunk)
    rows = keyed.where("n_shingles > 0").join(known, F.col("set_key") == F.col("k")).select("component", "doc_id", "row_key")
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key")
    heads = rows.groupBy("component").agg(F.min(first)["row_key"].alias("head"))
    gone = rows.join(heads.withColumnRenamed("component", "c"), F.col("component") == F.col("c")).where("row_key <> head")
    key, other = spare_name(docs, "_row"), spare_name(docs, "_gone")
    gone = gone.select(F.col("row_key").alias(other)).distinct()
    j = docs.withColumn(key, _row_key())
    j = j.join(gone, F.col(key) == F.col(other), "left_anti").dropDuplicates([key])
    return j.select(*(F.col(f"`{c}`") for c in docs.columns))
