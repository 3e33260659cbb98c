"""Files around panels: slices of stored panels, tables made if absent, content hashes, small reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_slice(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, ts: str = "ts", code: str = "code", v: str = "v") -> DataFrame:
    """A stored panel between two times (pushed down to the scan), without codes that have no value in it."""
    p = spark.read.parquet(path)
    if first is not None:
        p = p.where(F.col(ts) >= F.lit(first).cast(p.schema[ts].dataType))
    if last is not None:
        p = p.where(F.col(ts) <= F.lit(last).cast(p.schema[ts].dataType))
    alive = p.where(F.col(v).isNotNull() & ~F.isnan(v)).select(code).distinct()
    return p.join(alive, code, "left_semi")


def materialised(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``, built and written first if there is none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, hash): SHA-256 of every file under a path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def same_tree(a: DataFrame, b: DataFrame, root_a: str, root_b: str) -> bool:
    """Whether two trees of ``file_hashes`` have the same files with the same contents."""
    rel = lambda d, root: d.select(F.regexp_replace("path", rf"^.*?{root.strip('/')}/", "").alias("p"), "hash")
    x, y = rel(a, root_a), rel(b, root_b)
    return x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small summary as a Markdown table; more rows than ``most`` are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many rows for a report")
    show = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def html(df: DataFrame, most: int = 1000) -> str:
    """The same as an HTML table."""
    from html import escape

    head, _, *body = markdown(df, most).split("\n")
    cells = lambda line, tag: "<tr>" + "".join(f"<{tag}>{escape(c.strip())}</{tag}>" for c in line.strip("| ").split(" | ")) + "</tr>"
    return "<table>" + cells(head, "th") + "".join(cells(line, "td") for line in body) + "</table>"
