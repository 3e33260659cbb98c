"""Deletion of later copies of repeated line runs, by a suffix array over line ids made by distributed prefix doubling.

Every line is an id (a 128-bit content hash). The suffixes that begin with a repeated line are ranked
in rounds: the rank of the 2k lines at i is the place of the pair (rank of k lines at i, rank of k lines at i + k)
in the sorted list of all pairs that stand more than once. A pair that stands once ends its
suffix: nothing longer that begins there is repeated. So the suffixes left in a round are those of the suffix array
whose longest common prefix with a neighbour is at least 2k lines, and equal ranks are its
intervals. Ranks keep the order of the ids, and the rank of a prefix of any length between k and 2k is made of two overlapping ones.

A repeated run counts from ``min_words`` words. The lines covered by repeated runs of at least that
many words are exactly those covered by the repeated runs that are minimal from their first line
(shortest from there to reach the length) or from their last line. So a suffix is looked up by the
prefixes of those lengths: the interval of the suffixes that share one is found in the round of its
length, its first member in document order is the copy that stays, and deletions that touch or overlap join
into the maximal runs.

Texts are read once for their lines; rounds work on what is left of the line table, written
to the shared checkpoint folder. A key that makes up more than a thousandth of the rows is joined by
broadcast: there are fewer than a thousand of them, however large the table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm._text import WHITE, byte_codes, joined, mix, release, segment_hashes, slices, spare_name, stored, unstored, word_spans

_EXACT = byte_codes(False)
_OTHER = mix(_EXACT + np.uint64(0xABCDEF))
#: keys with more than this share of the rows are joined by broadcast
HOT = 1 / 1000
DOCUMENT = ["doc_id", "row_key"]


def line_ids(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, line number, words, and two 64-bit hashes of each line; outer white space does not count."""
    a, at = joined(texts)
    starts, ends = word_spans(a, WHITE)
    breaks = np.flatnonzero(a == 0x0A)
    begin = np.r_[0, breaks[:-1] + 1]
    text_of = np.searchsorted(at, begin, side="right") - 1
    first = np.searchsorted(starts, begin)
    words = np.searchsorted(starts, breaks) - first
    has = words > 0
    lo, hi = begin.copy(), begin.copy()
    lo[has], hi[has] = starts[first[has]], ends[first[has] + words[has] - 1]
    line = np.arange(len(begin)) - np.searchsorted(begin, at)[text_of]
    return text_of, line, words, *(segment_hashes(a, lo, hi, codes).astype(np.int64) for codes in (_EXACT, _OTHER))


def _lines(min_words: int):
    def run(batches):
        import pyarrow as pa

        for rows, texts in slices(batches):
            t, line, words, h1, h2 = line_ids(texts)
            enough = np.bincount(t, words, len(texts)) >= min_words
            keep = enough[t]
            t, line, words, h1, h2 = (x[keep] for x in (t, line, words, h1, h2))
            of = rows.take(pa.array(t, pa.int64()))
            columns = [of.column(0), of.column(1), pa.array(line, pa.int32()), pa.array(words, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "line", "words", "a", "b"])

    return run


def _documents(batches):
    """Whole documents of batches that are sorted by document: one table of all but the last one, and so on."""
    import pyarrow as pa

    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        d, k = (t.column(c).to_numpy() for c in DOCUMENT)
        cut = np.flatnonzero((d[1:] != d[:-1]) | (k[1:] != k[:-1])) + 1
        if held:
            last = held[-1]
            if len(cut) or last.column("doc_id")[-1].as_py() != d[0] or last.column("row_key")[-1].as_py() != k[0]:
                same = last.column("doc_id")[-1].as_py() == d[0] and last.column("row_key")[-1].as_py() == k[0]
                to = int(cut[0]) if same else 0
                yield pa.concat_tables([*held, t.slice(0, to)]).combine_chunks()
                t, cut, held = t.slice(to), cut[cut > to] - to, []
        if len(cut) and not held:
            yield t.slice(0, int(cut[-1]))
            t = t.slice(int(cut[-1]))
        held.append(t)
    if held:
        yield pa.concat_tables(held).combine_chunks()
    del held
    release()


def minimal_runs(new: np.ndarray, words: np.ndarray, min_words: int) -> np.ndarray:
    """(first, end) rows of the runs of at least ``min_words`` words that are minimal from their first or last line.

    ``new`` marks the first line of each stretch of lines that follow each other.
    """
    n = len(words)
    cum = np.r_[0, np.cumsum(words)]
    first_of = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    begin = np.flatnonzero(new)
    end_of = np.r_[begin[1:], n][np.cumsum(new) - 1]
    e = np.searchsorted(cum, cum[:-1] + min_words, side="left")  # one past the shortest run from each line
    f = np.flatnonzero((e <= end_of) & (words > 0))
    s = np.searchsorted(cum, cum[1:] - min_words, side="right") - 1  # latest first line of a run that ends at each line
    g = np.flatnonzero((s >= first_of) & (words > 0))
    return np.unique(np.r_[np.stack([f, e[f]], 1), np.stack([s[g], g + 1], 1)], axis=0)


def _round(k: int, min_words: int):
    """Rows of a round, from lines sorted by document with the rank of their k lines (NULL if those stand once).

    kind 0: a run of k to 2k - 1 lines at ``line``, with the two ranks that make its rank.
    kind 1: a line of a longer run that may be repeated, with the pair of ranks that makes the rank of its 2k lines.
    """

    def run(batches):
        import pyarrow as pa

        for t in _documents(batches):
            d, key, line, words = (t.column(c).to_numpy() for c in ("doc_id", "row_key", "line", "words"))
            rank = t.column("rank").fill_null(-1).to_numpy()
            n = len(d)
            new = np.r_[True, (d[1:] != d[:-1]) | (key[1:] != key[:-1]) | (line[1:] != line[:-1] + 1)]
            first, end = minimal_runs(new, words, min_words).T
            length = end - first
            lost = np.r_[0, np.cumsum(rank < 0)]
            alive = length >= k
            alive[alive] = lost[end[alive] - k + 1] == lost[first[alive]]
            now, later = alive & (length < 2 * k), alive & (length >= 2 * k)
            # lines of runs that are still too long
            mark = np.zeros(n + 1, np.int64)
            np.add.at(mark, first[later], 1)
            np.add.at(mark, end[later], -1)
            at = np.flatnonzero(np.cumsum(mark[:n]) > 0)
            stretch = np.cumsum(new)
            nxt = np.minimum(at + k, n - 1)
            pair = (at + k < n) & (stretch[nxt] == stretch[at]) & (rank[at] >= 0) & (rank[nxt] >= 0)
            s, e = first[now], end[now]
            rows = np.r_[s, at]
            columns = [pa.array(d[rows], pa.int64()), pa.array(key[rows], pa.int64()), pa.array(line[rows], pa.int32()), pa.array(words[rows], pa.int32())]
            a, b = np.r_[rank[s], rank[at]], np.r_[rank[e - k], rank[nxt]]
            none = np.r_[np.zeros(len(s), bool), ~pair]
            kinds = np.r_[np.zeros(len(s), np.int32), np.ones(len(at), np.int32)]
            columns += [pa.array(a, pa.int64(), mask=none), pa.array(b, pa.int64(), mask=none), pa.array(np.r_[e - s, np.zeros(len(at))].astype(np.int32)), pa.array(kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row_key", "line", "words", "a", "b", "length", "kind"])

    return run


def joined_on_counted(rows: DataFrame, table: DataFrame, by: list[str], total: int, how: str = "inner") -> DataFrame:
    """rows joined with a table of distinct keys and their ``copies`` among the rows: the commonest keys by broadcast.

    Keys with more than HOT of all ``total`` rows number fewer than 1 / HOT; the rows of all others are shuffled.
    """
    hot = F.broadcast(table.where(F.col("copies") > int(total * HOT) + 1).withColumn("_hot", F.lit(True)))
    extra = [c for c in table.columns if c not in by and c != "copies"]
    tried = rows.join(hot, by, "left")
    done = tried.where("_hot").select(*rows.columns, *extra)
    rest = tried.where("_hot IS NULL").select(*rows.columns)
    return done.unionByName(rest.join(table.where(F.col("copies") <= int(total * HOT) + 1), by, how).select(*rows.columns, *extra))


def ranked(pairs: DataFrame) -> DataFrame:
    """(a, b, copies, rank) of the pairs that stand more than once; ranks have the order of the pairs.

    Ranges are sorted apart, and numbered by range and place: ranks need not be dense.
    """
    counted = pairs.groupBy("a", "b").agg(F.count("*").alias("copies")).where("copies > 1")
    spark = pairs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return stored(counted.repartitionByRange(n, "a", "b").sortWithinPartitions("a", "b").withColumn("rank", F.monotonically_increasing_id()))


def rounds(docs: DataFrame, min_words: int):
    """(k, ranked lines, rows of ``_round``) of each round; docs are (doc_id, row_key, text)."""
    lines = stored(docs.mapInArrow(_lines(min_words), "doc_id long, row_key long, line int, words int, a long, b long"))
    rows, k = lines, 1
    while total := rows.count():
        table = ranked(rows.where("a IS NOT NULL"))
        state = joined_on_counted(rows.where("a IS NOT NULL"), table, ["a", "b"], total, "inner" if k == 1 else "left")
        state = state.select(*DOCUMENT, "line", "words", "rank")
        if k > 1:
            state = state.unionByName(rows.where("a IS NULL").select(*DOCUMENT, "line", "words", F.lit(None).cast("long").alias("rank")))
        state = state.repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "line")
        schema = "doc_id long, row_key long, line int, words int, a long, b long, length int, kind int"
        passed = stored(state.mapInArrow(_round(k, min_words), schema))
        yield k, state, passed
        rows, k = passed.where("kind = 1").select(*DOCUMENT, "line", "words", "a", "b"), 2 * k
        unstored(table)
    unstored(lines)


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, row_key, first, end): line runs that repeat one that stands earlier, by (doc_id, row_key, line)."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    runs = None
    for _, _, passed in rounds(base, min_words):
        found = passed.where("kind = 0").select(*DOCUMENT, F.col("line").alias("first"), "length", "a", "b")
        runs = found if runs is None else runs.unionByName(found)
    if runs is None:
        return base.select(*DOCUMENT, F.lit(0).alias("first"), F.lit(0).alias("end")).where("false")
    place = F.struct(*DOCUMENT, "first")
    key = ["length", "a", "b"]  # the length tells the round, and with it what the ranks stand for
    heads = stored(runs.groupBy(*key).agg(F.min(place).alias("head"), F.count("*").alias("copies")).where("copies > 1"))
    found = joined_on_counted(runs, heads, key, runs.count())
    return found.where(~place.eqNullSafe(F.col("head"))).select(*DOCUMENT, "first", (F.col("first") + F.col("length")).cast("int").alias("end"))


def _merged(batches):
    """One row a document: the merged runs, from rows sorted by document and first line."""
    import pyarrow as pa

    for t in _documents(batches):
        d, key, first, end = (t.column(c).to_numpy() for c in ("doc_id", "row_key", "first", "end"))
        new_doc = np.r_[True, (d[1:] != d[:-1]) | (key[1:] != key[:-1])]
        # ends so far within the document: documents are kept apart by an offset that no end reaches
        apart = np.cumsum(new_doc).astype(np.int64) * (int(end.max()) + 2)
        reach = np.maximum.accumulate(end + apart)
        starts = np.flatnonzero(np.r_[True, new_doc[1:] | (first[1:] + apart[1:] > reach[:-1])])
        ends = reach[np.r_[starts[1:], len(d)] - 1] - apart[starts]
        of = np.flatnonzero(new_doc)
        offsets = np.r_[np.searchsorted(starts, of), len(starts)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x, pa.int32())) for x in (first[starts], ends)]
        yield pa.RecordBatch.from_arrays([pa.array(d[of], pa.int64()), pa.array(key[of], pa.int64()), *lists], ["doc_id", "row_key", "starts", "ends"])


def line_dedup(docs: DataFrame, min_words: int = 50, drop_emptied: bool = False, counted: str | None = "n_deleted") -> DataFrame:
    """The documents' columns, without later copies of runs of lines of at least ``min_words`` words, and the number of deleted lines.

    The first copy in the order of (doc_id, text hash, line) stays, null ids first; a run that overlaps its own
    earlier copy loses the later part. Lines are compared without outer white space. Whole texts are
    read, however long. Identical rows
    of one doc_id count as one and stay alike. Null texts stay null, empty ones empty; an empty table stays empty. With
    ``drop_emptied``, documents whose words are all deleted go. n_chars, where present, is renewed.
    A column of the name ``counted`` is replaced; with None, there is no such column. All others may have any name.
    """
    runs = later_copies(docs, min_words).distinct().repartition(*DOCUMENT).sortWithinPartitions(*DOCUMENT, "first")
    cut = runs.mapInArrow(_merged, "doc_id long, row_key long, starts array<int>, ends array<int>")
    names = [c for c in docs.columns if counted is None or c.lower() != counted.lower()]
    d, r, starts, ends, new, here, this = (spare_name(docs, x) for x in ("_cut_doc", "_cut_row", "_starts", "_ends", "_new", "_doc", "_row"))
    cut = cut.select(F.col("doc_id").alias(d), F.col("row_key").alias(r), F.col("starts").alias(starts), F.col("ends").alias(ends))
    j = docs.withColumn(this, F.xxhash64("text")).withColumn(here, F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)).cast("long")))
    j = j.join(cut, (F.col(here) == F.col(d)) & (F.col(this) == F.col(r)), "left")
    # the kept lines are slices between the deleted runs
    pieces = f"zip_with(concat(array(0), {ends}), concat({starts}, array(size(l))), (s, e) -> slice(l, s + 1, e - s))"
    kept = F.expr(f"array_join(flatten(transform(array(split(text, '\\n', -1)), l -> flatten({pieces}))), '\\n')")
    whole = F.col(starts).isNull()
    j = j.withColumn(new, F.when(whole, F.col("text")).otherwise(kept))
    if drop_emptied:
        j = j.where(whole | (F.trim(F.regexp_replace(new, r"\s+", " ")) != ""))

    def column(c):
        if c == "text":
            return F.col(new).alias(c)
        if c == "n_chars":
            return F.when(whole, F.col(f"`{c}`")).otherwise(F.length(new)).cast(docs.schema[c].dataType).alias(c)
        return F.col(f"`{c}`")

    gone = F.coalesce(F.expr(f"aggregate(zip_with({starts}, {ends}, (s, e) -> e - s), 0L, (n, x) -> n + x)"), F.lit(0).cast("long"))
    return j.select(*(column(c) for c in names), *([] if counted is None else [gone.alias(counted)]))
