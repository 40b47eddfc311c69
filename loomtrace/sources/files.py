"""Source files from dumps, folders and tables, as ``path, content``; signatures for incremental runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.paths import EXCLUDE_PATHS, EXTENSIONS, accepted, normalized
from loomtrace.operators.ordered import last_known
from loomtrace.sources.text import read_lines

FILES = "path string, content string"
# fixed values: marks of the dump format, and folders that are never read
FILE_BEGIN, FILE_END = "===== FILE BEGIN =====", "===== FILE END ====="
CONTENT_BEGIN, CONTENT_END = "===== CONTENT BEGIN =====", "===== CONTENT END ====="
SKIPPED = (".git", ".svn", ".hg", ".venv", "venv", "node_modules", "__pycache__", ".lv_cache", ".vs", ".idea")


def empty(spark: SparkSession) -> DataFrame:
    """No files: for runs on logs alone."""
    return spark.createDataFrame([], FILES)


def from_dump(lines: DataFrame, prefixes: tuple[str, ...] = ("Input/",), only: list[str] | None = None, filtered: bool = False) -> DataFrame:
    """Files of a dump given as lines (``log_id, line_no, line``): ``path, content``.

    A content ends where its end mark is followed at once by the file's end mark; the same mark elsewhere is content. A last
    file without its end is given all the same. ``only``: these paths; ``filtered``: only accepted paths. Each line
    learns where the last content began and ended before it, so that a dump is read by many tasks.
    """
    c = F.col
    rows = lines.select("log_id", "line_no", F.regexp_replace(F.coalesce("line", F.lit("")), r"[\r\n]+$", "").alias("line"))
    # the next line, also over the border of a block
    nxt = rows.select(c("log_id").alias("n_log"), (c("line_no") - 1).alias("n_no"), c("line").alias("n_line")).where(c("n_line") == FILE_END)
    rows = rows.join(nxt, (c("log_id") == c("n_log")) & (c("line_no") == c("n_no")) & (c("line") == CONTENT_END), "left")
    ends = (c("line") == CONTENT_END) & c("n_line").isNotNull()
    rows = rows.withColumn("mark", F.when(ends, "end").when(c("line") == CONTENT_BEGIN, "begin"))
    # a begin mark within a content is content: only the first one behind an end counts
    rows = last_known(rows, ["log_id"], "line_no", F.when(c("mark") == "end", c("line_no")), "ended", include_self=False)
    begins = rows.where("mark = 'begin'").groupBy(c("log_id").alias("b_log"), F.coalesce("ended", F.lit(-1)).alias("b_ended")).agg(F.min("line_no").alias("begun"))
    rows = rows.join(begins, (c("log_id") == c("b_log")) & (F.coalesce("ended", F.lit(-1)) == c("b_ended")), "left").drop("b_log", "b_ended")
    inside = c("line_no") > c("begun")
    named = rows.where(~F.coalesce(inside, F.lit(False)) & c("line").startswith("Path:") & (c("begun").isNull() | (c("line_no") < c("begun"))))
    names = named.groupBy("log_id", "begun").agg(F.max_by("line", "line_no").alias("named"))
    path = normalized(F.regexp_replace(F.substring("named", 6, 1 << 30), r"(?U)^\s+|\s+$", ""), prefixes)
    names = names.select(c("log_id").alias("p_log"), c("begun").alias("p_begun"), path.alias("path"))
    if only is not None:
        names = names.where(c("path").isin(*only))
    if filtered:
        names = names.where(accepted(c("path")))
    body = rows.where(inside & (c("mark").isNull() | (c("mark") != "end"))).select("log_id", "begun", "line_no", "line")
    texts = body.groupBy("log_id", "begun").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: F.concat(x["line"], F.lit("\n"))), "").alias("content"))
    out = names.join(texts.withColumnsRenamed({"log_id": "t_log", "begun": "t_begun"}), (c("p_log") == c("t_log")) & (c("p_begun") == c("t_begun")), "left")
    return out.select("path", F.coalesce("content", F.lit("")).alias("content"))


def source_files(spark: SparkSession, place: str | None = None) -> DataFrame:
    """Files of wherever they are kept: no place, no files; a folder; or a dump in a file."""
    if place is None:
        return empty(spark)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return from_folder(spark, place)
    return from_dump(read_lines(spark, place))


def decoded(data: bytes, encoding: str = "auto") -> str:
    """Bytes of a source as text: by its mark, as UTF-8, as CP932, else as Latin-1; line ends as ``\\n``."""
    if encoding != "auto":
        text = data.decode(encoding, "replace")
    elif data[:3] == b"\xef\xbb\xbf":
        text = data[3:].decode("utf-8", "replace")
    else:
        for charset in ("utf-8", "cp932", "latin-1"):
            try:
                text = data.decode(charset)
                break
            except UnicodeDecodeError:
                continue
    return text.replace("\r\n", "\n").replace("\r", "\n")


def from_folder(spark: SparkSession, folder: str, encoding: str = "auto", extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDE_PATHS) -> DataFrame:
    """Files below a folder: ``path`` (relative), ``content``. Version control and environment folders are never read.

    UTF-8 files are decoded in the JVM; only the others pass through Python.
    """
    c = F.col
    root = folder.rstrip("/")
    data = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(c("path"), r"^(?:file:)?/*" + "\\Q" + root.lstrip("/") + "\\E/*", "")
    data = data.select(rel.alias("path"), "content").where(accepted(c("path"), extensions, exclude))
    for d in SKIPPED:
        data = data.where(~F.concat(F.lit("/"), c("path")).contains(f"/{d}/"))

    @F.pandas_udf("string")
    def slow(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else decoded(bytes(b), encoding))

    easy = (F.lit(encoding) == "auto") & F.is_valid_utf8(c("content").cast("string"))
    text = F.regexp_replace(F.regexp_replace(c("content").cast("string"), "^\\ufeff", ""), "\r\n?", "\n")
    fast = data.where(easy).select("path", text.alias("content"))
    rest = data.where(~easy).select("path", slow("content").alias("content"))
    return fast.unionByName(rest)


def signatures(files: DataFrame) -> DataFrame:
    """``path, signature``: SHA-1 of each file's content."""
    return files.where("path is not null").groupBy("path").agg(F.min(F.sha1(F.coalesce("content", F.lit("")))).alias("signature"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One row: a 24-character fingerprint of the whole set, whatever its order: per-file hashes summed up exactly."""
    h = F.conv(F.substring(F.sha2(F.concat_ws(":", "path", "signature"), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    total = signatures(files).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("s"))
    return total.select(F.substring(F.sha2(F.concat_ws(":", F.col("n").cast("string"), "s"), 256), 1, 24).alias("fingerprint"))


def incremental(files: DataFrame, cached_signatures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files to analyse anew, paths to drop): against the signatures of an earlier run."""
    c = F.col
    now = signatures(files).withColumnRenamed("signature", "now")
    old = cached_signatures.select(c("path").alias("o_path"), c("signature").alias("old"))
    stale = now.join(old, (c("path") == c("o_path")) & (c("now") == c("old")), "left_anti").select(c("path").alias("s_path"))
    gone = old.join(now, c("o_path") == c("path"), "left_anti").select(c("o_path").alias("path"))
    return files.join(stale, c("path") == c("s_path"), "left_semi"), gone
