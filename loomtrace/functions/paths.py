"""Paths, modules and ids as Column expressions; rules are configuration, compiled to expressions at plan time."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: directory rules, excluded paths and callees of the default configuration
DIRECTORY_RULES = (r"^src/[^/]+/pipelines/([^/]+)/", r"^src/[^/]+/([^/]+)/", r"^src/([^/]+)/[^/]+$", r"^libs/([^/]+)/")
EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx")
EXCLUDE_PATHS = (
    "*/CMakeFiles/*", "build/*", "*/test/*", "*/tests/*", "*/unittest/*", "*/unit_test/*", "*/ut/*", "*/mock/*", "*/mocks/*",
    "*/stub/*", "*/stubs/*", "*/test_*.c", "*/test_*.cpp", "*_test.c", "*_test.cpp",
)
EXCLUDE_CALLEES = ("ut_log_*", "UT_LOG_*")
RAW_LANE, UNKNOWN_LANE = "(other)", "(unknown)"


def glob(pattern: str) -> str:
    """A shell pattern as an anchored Java regex; ``*`` also crosses ``/``."""
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        end = pattern.find("]", i + 2) if ch == "[" else -1
        if ch == "*":
            out += ".*"
        elif ch == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end
        else:
            out += re.escape(ch)
        i += 1
    return f"(?s)^{out}$"


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def basename(path: Column) -> Column:
    return F.element_at(F.split(slashes(path), "/"), -1)


def normalized(path: Column, prefixes: tuple[str, ...] = ()) -> Column:
    """``/`` as separator, without leading ``./``, the first matching prefix (any case) and a leading ``/``."""
    p = F.regexp_replace(slashes(path), r"^(?:\./)+", "")
    out = F.regexp_replace(p, r"^/+", "")
    for prefix in reversed(prefixes):
        out = F.when(F.lower(p).startswith(prefix.lower()), F.regexp_replace(F.substring(p, len(prefix) + 1, 1 << 30), r"^/+", "")).otherwise(out)
    return out


def any_glob(text: Column, patterns: tuple[str, ...]) -> Column:
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(glob(p))
    return hit


def accepted(path: Column, extensions: tuple[str, ...] = EXTENSIONS, exclude: tuple[str, ...] = EXCLUDE_PATHS) -> Column:
    """Whether a path has one of the extensions and matches no excluded pattern, in any case."""
    low = F.lower(path)
    ends = F.lit(False)
    for e in extensions:
        ends = ends | low.endswith(e.lower())
    return ends & ~any_glob(low, tuple(p.lower() for p in exclude))


@dataclass(frozen=True)
class ModuleRules:
    """How modules are told from log fields, file names and directories."""

    separators: tuple[str, ...] = (":",)
    aliases: tuple[tuple[str, str], ...] = ()
    file_rules: tuple[tuple[str, str], ...] = ()
    directory_rules: tuple[str, ...] = DIRECTORY_RULES
    raw_lane: str = RAW_LANE
    unknown_lane: str = UNKNOWN_LANE
    extra: dict = field(default_factory=dict)

    def from_log(self, module: Column) -> Column:
        """An alias that matches, else the text before the first separator that leaves any, else the whole field."""
        head = module
        for sep in reversed(self.separators):
            before = F.trim(F.substring_index(module, sep, 1))
            head = F.when(module.contains(sep) & (before != ""), before).otherwise(head)
        out = F.trim(head)
        for pattern, name in reversed(self.aliases):
            out = F.when(module.rlike(pattern), F.lit(name)).otherwise(out)
        return F.when((module != "") & (out != ""), out)

    def from_file(self, file_name: Column) -> Column:
        base = F.lower(basename(file_name))
        out = F.lit(None).cast("string")
        for pattern, name in reversed(self.file_rules):
            out = F.when(base.rlike(glob(pattern.lower())), F.lit(name)).otherwise(out)
        return F.when(file_name != "", out)

    def from_path(self, path: Column) -> Column:
        """The first directory rule with a name, else the directory that holds the file; null without one."""
        p = slashes(path)
        hits = [F.nullif(F.regexp_extract(p, r, 1), F.lit("")) for r in self.directory_rules]
        parts = F.split(p, "/")
        return F.when(path != "", F.coalesce(*hits, F.when(F.size(parts) >= 2, F.element_at(parts, -2))))

    def for_path(self, path: Column) -> Column:
        return F.coalesce(self.from_file(path), self.from_path(path), F.lit(self.unknown_lane))


def unique_suffixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """``path, suffix``: the shortest ending of each path, in whole components, that no other path has; the whole path if all are shared."""
    p = paths.where(F.col(path).isNotNull()).select(F.col(path).alias("path")).distinct()
    parts = F.split("path", "/")
    all_ = p.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, -n, n), "/"))).alias("i", "suffix"))
    alone = all_.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("path"), F.min("i").alias("i")).where("n = 1")
    best = alone.groupBy("path").agg(F.min_by("suffix", "i").alias("suffix"))
    return p.join(best.withColumnRenamed("path", "_p"), F.col("path") == F.col("_p"), "left").select("path", F.coalesce("suffix", "path").alias("suffix"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading components two paths share, the file's name included."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_off = F.array_position(pairs, False)
    return F.when(first_off == 0, F.size(pairs)).otherwise((first_off - 1).cast("int"))


def prefixes(path: Column) -> Column:
    """ARRAY<STRING>: a path's leading components, none first, the whole path last; two paths share as many as their
    longest common one has."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.concat_ws("/", F.slice(parts, 1, n), F.lit("")))


def nearest(asked: DataFrame, candidates: DataFrame, order: list[str]) -> DataFrame:
    """``key, path, best``: for each distinct (key, path) the candidate of the key whose path shares most leading components,
    of those the first by ``order`` (STRUCT of the order columns). Candidates are reduced to one per key and common beginning
    before they meet what is asked, so that a name that stands in every file costs no more than others."""
    c = F.col
    known = candidates.select("key", F.explode(prefixes(c("path"))).alias("prefix"), F.struct(*order).alias("one")).groupBy("key", "prefix").agg(F.min("one").alias("best"))
    known = known.withColumnsRenamed({"key": "k_key", "prefix": "k_prefix"})
    wanted = asked.select("key", "path").distinct().select("key", "path", F.posexplode(prefixes(c("path"))).alias("shared", "prefix"))
    hit = wanted.join(known, (c("key") == c("k_key")) & (c("prefix") == c("k_prefix")))
    return hit.groupBy("key", "path").agg(F.max_by("best", "shared").alias("best"))


def short_name(name: Column) -> Column:
    """A name behind its last ``::``."""
    return F.element_at(F.split(name, "::"), -1)


def split_id(function_id: Column) -> Column:
    """STRUCT<suffix, name> of an id, cut at the first ``::`` behind the suffix's first dot."""
    at = r"^([^.]*\.(?:(?!::).)*)::(.*)$"
    plain = r"^((?:(?!::).)*)::(.*)$"
    return (
        F.when(function_id.rlike(at), F.struct(F.regexp_extract(function_id, at, 1).alias("suffix"), F.regexp_extract(function_id, at, 2).alias("name")))
        .when(function_id.rlike(plain), F.struct(F.regexp_extract(function_id, plain, 1).alias("suffix"), F.regexp_extract(function_id, plain, 2).alias("name")))
        .otherwise(F.struct(F.lit("").alias("suffix"), function_id.alias("name")))
    )


def earliest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")
