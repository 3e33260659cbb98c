"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max pruning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import ALNUM, joined, segment_hashes, slices, spare_name, stored, unstored, word_spans

#: items of one index, in bytes of text; a larger benchmark is indexed and searched in several blocks
BLOCK_BYTES = 16 << 20


def words_of(text: str) -> list[str]:
    """Runs of ASCII letters and digits or characters above ASCII, case-folded."""
    raw = text.casefold().encode()
    s, e = word_spans(np.frombuffer(raw, np.uint8), ALNUM)
    return [raw[i:j].decode() for i, j in zip(s, e, strict=True)]


def question_answer(text: str) -> tuple[list[str], list[str]]:
    """The item's words up to its last sentence, and those of its last sentence (all words, if it has one)."""
    cut = max(text.rstrip().rstrip(".?!").rfind(x) for x in (". ", "\n", "? ", "! "))
    if cut < 0:
        return words_of(text), words_of(text)
    q, a = words_of(text[: cut + 1]), words_of(text[cut + 1 :])
    return (q, a) if q and a else (words_of(text), words_of(text))


class Collection:
    """What impacts are made of, over all items of the benchmark: their number, their total length, and how many hold each term.

    ``terms`` and ``df`` need only hold the terms of the items to be indexed.
    """

    def __init__(self, n: int, length: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.length, self.terms, self.df = n, length, terms, df

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Collection:
        parsed = [Index.parsed(t) for _, t in items]
        terms, df = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for _, w, _ in parsed)]), return_counts=True)
        return Collection(len(items), sum(len(bag) for _, _, bag in parsed), terms, df)

    def idf(self, terms: np.ndarray) -> np.ndarray:
        df = self.df[np.searchsorted(self.terms, terms)]
        return np.log(1 + (self.n - df + 0.5) / (df + 0.5))


class Index:
    """Postings with impacts scaled so that an item scores 1 against its own text.

    The commonest terms, whose impacts together stay below half the threshold in every item, are not
    essential: a passage without an essential term has no hit, and what they can add is a bound of
    each item (``rest``). The lists of the others are walked by block-max WAND. Lists are cut into
    blocks of neighbouring items, each with a maximum impact.
    """

    def __init__(self, items: list[tuple[int, str]], threshold: float = 0.6, block: int = 4, k1: float = 1.2, b: float = 0.75, collection: Collection | None = None):
        collection = collection or Collection.of(items)
        self.ids = [i for i, _ in items]
        self.threshold, self.block = threshold, block
        parsed = [self.parsed(t) for _, t in items]
        self.parts, self.words, bags = ([p[k] for p in parsed] for k in range(3))
        n, mean = len(items), max(1.0, collection.length / max(1, collection.n))
        self.terms = np.unique(np.concatenate(self.words)) if items else np.zeros(0, np.uint64)
        df = np.zeros(len(self.terms), np.int64)
        for w in self.words:
            df[np.searchsorted(self.terms, w)] += 1
        idf = collection.idf(self.terms)
        t, d, v = [], [], []
        for i, (w, bag) in enumerate(zip(self.words, bags, strict=True)):
            u, tf = np.unique(bag, return_counts=True)
            at = np.searchsorted(self.terms, u)
            x = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(bag) / mean))
            t.append(at)
            d.append(np.full(len(u), i))
            v.append(x / max(x.sum(), 1e-12))
        t, d, v = (np.concatenate(x) if x else np.zeros(0, k) for x, k in ((t, np.int64), (d, np.int64), (v, float)))
        order = np.lexsort((d, t))
        self.item, self.impact = d[order], v[order]
        self.begin = np.r_[0, np.cumsum(np.bincount(t, minlength=len(self.terms)))] if len(t) else np.zeros(1, np.int64)
        rest, self.essential = np.zeros(n), np.ones(len(self.terms), bool)
        for k in np.argsort(-df, kind="stable"):
            p = slice(self.begin[k], self.begin[k + 1])
            if (rest[self.item[p]] + self.impact[p]).max(initial=0) >= threshold / 2:
                break
            rest[self.item[p]] += self.impact[p]
            self.essential[k] = False
        self.rest = rest
        blocks = -(-n // block)
        self.block_rest = np.array([rest[i * block : (i + 1) * block].max() for i in range(blocks)])
        bt = t[order] * max(blocks, 1) + self.item // block
        self.bkey, first = np.unique(bt, return_index=True)
        self.bmax = np.maximum.reduceat(self.impact, first) if len(first) else np.zeros(0)
        self.blocks = max(blocks, 1)
        self.tbegin = np.searchsorted(self.bkey, np.arange(len(self.terms) + 1) * self.blocks)
        # the largest impact of each list, and the largest bound of any item
        self.tmax = np.maximum.reduceat(self.impact, self.begin[:-1]) if len(self.terms) else np.zeros(0)
        self.most_rest = float(rest.max(initial=0))
        self.hit = np.zeros(1 << 20, bool)
        self.hit[(self.terms & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    @classmethod
    def parsed(cls, text: str) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """Hashes of an item's words: (question, answer), distinct ones of both, all in order."""
        q, a = question_answer(text)
        parts = cls._hashes(q), cls._hashes(a)
        both = np.concatenate(parts)
        return parts, np.unique(both), both if q != a else parts[0]

    @staticmethod
    def _hashes(words: list[str]) -> np.ndarray:
        a, at = joined([w.encode() for w in words])
        return segment_hashes(a, at[:-1], at[1:] - 1) if words else np.zeros(0, np.uint64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words of no item."""
        out = np.full(len(h), -1, np.int64)
        maybe = np.flatnonzero(self.hit[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), len(self.terms) - 1)
        ok = self.terms[at] == h[maybe]
        out[maybe[ok]] = at[ok]
        return out

    def hopeful(self, window_of: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Which of the distinct (window, essential term) pairs are of a window with a block that may reach the threshold.

        Bounds of many windows are summed at once, first by the lists' maxima, then by those of the blocks.
        """
        goal = self.threshold - 1e-9
        windows, inverse = np.unique(window_of, return_inverse=True)
        hope = (np.bincount(inverse, self.tmax[term], len(windows)) + self.most_rest >= goal)[inverse]
        pair = np.flatnonzero(hope)
        lo, n = self.tbegin[term[pair]], (self.tbegin[1:] - self.tbegin[:-1])[term[pair]]
        row = np.repeat(np.arange(len(pair)), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
        keys, of = np.unique(inverse[pair[row]] * self.blocks + self.bkey[at] % self.blocks, return_inverse=True)
        bound = np.bincount(of, self.bmax[at], len(keys)) + self.block_rest[keys % self.blocks]
        good = np.zeros(len(windows), bool)
        good[keys[bound >= goal] // self.blocks] = True
        return good[inverse]

    def wand(self, terms: np.ndarray) -> list[int]:
        """The items that may reach the threshold for a passage of these distinct essential terms, by block-max WAND.

        Lists stand at their next item, in that order. The pivot is the first list at which the
        maxima of the lists so far reach the threshold: no smaller item can. If the block maxima at
        the pivot's item do not, all lists up to it skip to the nearest end of such a block.
        """
        goal, found = self.threshold - 1e-9, []
        # (item now, position, end, number of the term)
        lists = [[int(self.item[self.begin[k]]), int(self.begin[k]), int(self.begin[k + 1]), int(k)] for k in terms]

        def skip(x, to):
            x[1] += int(np.searchsorted(self.item[x[1] : x[2]], to))
            x[0] = int(self.item[x[1]]) if x[1] < x[2] else len(self.ids)

        while True:
            lists = sorted(x for x in lists if x[1] < x[2])
            total, at = self.most_rest, 0
            for at, x in enumerate(lists):  # noqa: B007
                total += self.tmax[x[3]]
                if total >= goal:
                    break
            if not lists or total < goal:
                return found
            pivot = lists[at][0]
            while at + 1 < len(lists) and lists[at + 1][0] == pivot:
                at += 1
            block = pivot // self.block
            if sum(self._block_max(x[3], block) for x in lists[: at + 1]) + self.block_rest[block] < goal:
                to = min((block + 1) * self.block, lists[at + 1][0] if at + 1 < len(lists) else len(self.ids))
                for x in lists[: at + 1]:
                    skip(x, to)
            elif lists[0][0] == pivot:
                if sum(self.impact[x[1]] for x in lists[: at + 1]) + self.rest[pivot] >= goal:
                    found.append(pivot)
                for x in lists[: at + 1]:
                    skip(x, pivot + 1)
            else:
                for x in lists[:at]:
                    if x[0] < pivot:
                        skip(x, pivot)

    def _block_max(self, term: int, block: int) -> float:
        lo, hi = self.tbegin[term], self.tbegin[term + 1]
        i = lo + np.searchsorted(self.bkey[lo:hi], term * self.blocks + block)
        return self.bmax[i] if i < hi and self.bkey[i] == term * self.blocks + block else 0.0

    def score(self, present: np.ndarray, item: int) -> float:
        """BM25 of the item for a set of term numbers."""
        at = np.searchsorted(self.terms, self.words[item])
        at = at[np.isin(at, present)]
        total = 0.0
        for k in at:
            p = slice(self.begin[k], self.begin[k + 1])
            total += self.impact[p][np.searchsorted(self.item[p], item)]
        return float(total)


def words_in(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the texts' words, the first word of each text (one more at the end), and the text of each word."""
    a, at = joined([t.decode().casefold().encode() for t in texts])
    s, e = word_spans(a, ALNUM)
    return segment_hashes(a, s, e), np.searchsorted(s, at), np.searchsorted(at, s, side="right") - 1


def matches(index: Index, texts: list[bytes], window: int, question: float, answer: float):
    """(text, item, score, question overlap, answer overlap) of verified hits, the best window of each."""
    return _matches(index, *words_in(texts), window, question, answer)


def _matches(index: Index, hashes: np.ndarray, first: np.ndarray, text_of: np.ndarray, window: int, question: float, answer: float):
    if not index.ids or not len(index.terms) or not len(hashes):
        return []
    term = index.lookup(hashes)
    step = window // 2
    # windows of each text start at every half window; word j of a text lies in windows j // step and the one before
    count = np.maximum(1, -(-np.diff(first) // step))
    base = np.r_[0, np.cumsum(count)]
    known = np.flatnonzero(term >= 0)
    known = known[index.essential[term[known]]]
    j = known - first[text_of[known]]
    w = base[text_of[known]] + j // step
    back = j // step > 0
    windows, terms = np.r_[w, w[back] - 1], np.r_[term[known], term[known][back]]
    key = np.unique(windows * len(index.terms) + terms)
    if not len(key):
        return []
    windows, terms = key // len(index.terms), key % len(index.terms)
    hopeful = index.hopeful(windows, terms)
    windows, terms = windows[hopeful], terms[hopeful]
    cut = np.flatnonzero(np.diff(windows)) + 1
    best: dict = {}
    for v, item in ((int(windows[p[0]]), i) for p in np.split(np.arange(len(windows)), cut) if len(p) for i in index.wand(terms[p])):
        t = int(np.searchsorted(base, v, side="right") - 1)
        b = first[t] + (v - base[t]) * step
        present = np.unique(term[b : min(b + window, first[t + 1])])
        present = present[present >= 0]
        x = index.score(present, int(item))
        if x < index.threshold - 1e-9:
            continue
        have = index.terms[present]
        over = [float(np.isin(np.unique(p), have).mean()) if len(p) else 0.0 for p in index.parts[item]]
        if over[0] >= question and over[1] >= answer:
            row = (x, over[0], over[1])
            best[t, int(item)] = max(best.get((t, int(item)), row), row)
    return [(t, i, *row) for (t, i), row in sorted(best.items())]


def _hits(indexes: list[tuple[Index, int]], question: float, answer: float):
    def run(batches):
        import pyarrow as pa

        names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
        for rows, texts in slices(batches):
            words = words_in(texts)
            found = [(f[0], index.ids[f[1]], *f[2:]) for index, window in indexes for f in _matches(index, *words, window, question, answer)]
            ids = rows.column(0).take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([f[1] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.float64()) for k in (2, 3, 4))], names)

    return run


def _parsed(batches):
    import pyarrow as pa

    for batch in batches:
        found = [Index.parsed(t) for t in batch.column(1).to_pylist()]
        terms = pa.array([w.view(np.int64) for _, w, _ in found], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(bag) for _, _, bag in found], pa.int64()), terms], ["item_id", "text", "length", "terms"])


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """(items, collection) in item order, each block of bounded size; repeated items count once, empty ones not.

    The number of items, their mean length and the items of each term are counted over the whole
    benchmark by Spark, and a block carries those of its own terms: scores do not depend on blocks.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND length(trim(text)) > 0").dropDuplicates()
    items = stored(items.mapInArrow(_parsed, "item_id long, text string, length long, terms array<long>"))
    n, length = items.agg(F.count("*"), F.sum("length")).first()
    flat = items.select("item_id", "text", F.explode_outer("terms").alias("term"))
    counts = flat.groupBy("term").agg(F.count("*").alias("df"))
    known = flat.join(counts.withColumnRenamed("term", "t"), F.col("term").eqNullSafe(F.col("t")))
    known = known.groupBy("item_id", "text").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "df"))).alias("terms"))

    def block_of(rows):
        pairs = sorted({(t, d) for _, _, ts in rows for t, d in ts})
        terms = np.array([t for t, _ in pairs], np.int64).view(np.uint64)
        order = np.argsort(terms)
        return [(i, t) for i, t, _ in rows], Collection(n, length or 0, terms[order], np.array([d for _, d in pairs], np.int64)[order])

    block, size = [], 0
    for r in known.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(r[1]) > block_bytes:
            yield block_of(block)
            block, size = [], 0
        block.append((r[0], r[1], r[2]))
        size += len(r[1])
    if block:
        yield block_of(block)
    unstored(items)


def by_length(items: list[tuple[int, str]], window: int) -> list[tuple[list[tuple[int, str]], int]]:
    """(items, window): items of at most half a window, and longer ones by powers of two of twice their words.

    An item's window depends on its own length alone. Verification does not look at the order or
    nearness of words, so a short item must not be searched in the windows of a long one.
    """
    groups: dict = {}
    for i, t in items:
        n = len(words_of(t))
        groups.setdefault(window if 2 * n <= window else 1 << (2 * n - 1).bit_length(), []).append((i, t))
    return [(g, w) for w, g in sorted(groups.items())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, window: int = 128, question: float = 0.6, answer: float = 0.5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak of a test item into a document.

    Every window of every document is a query; items with a score of at least ``threshold`` of their
    own score are verified by their question's and answer's words in the window. Case and punctuation
    do not count. Windows are twice as long as their step, and at least twice as long as the item
    searched in them: ``window`` words, or for long items a power of two. The benchmark is indexed in
    blocks of bounded size, which do not change the result. Texts of any length are read whole, in
    overlapping windows. Null and empty texts have no hits; repeated rows have theirs repeated; an
    empty benchmark or table gives no rows. Only doc_id and text are read, whatever other columns there are.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    base, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for block, collection in item_blocks(benchmark, block_bytes):
        indexes = [(Index(items, threshold, collection=collection), wide) for items, wide in by_length(block, window)]
        found = base.mapInArrow(_hits(indexes, question, answer), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents in which no test item is found, with their columns; rows with a null doc_id are kept."""
    leaked = spare_name(docs, "_leaked")
    bad = decontaminate(docs, benchmark, **options).select(F.col("doc_id").alias(leaked)).distinct()
    return docs.join(bad, docs["doc_id"].cast("long") == bad[leaked], "left_anti")
