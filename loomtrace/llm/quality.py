"""Problem 8: text quality statistics, and how far each text is from the running prose of its language.

A text is cut into segments: stretches of lines of one make (marked, of cells, of signs, short or items in a row, other)
between blank lines. Each segment gets a vector of statistics. For every language, a robust mean and covariance of prose
come from all segments: medians and median deviations first, then the moments of the segments near them, taken again of
those that are near by these. A segment's squared Mahalanobis distance alone says whether it is prose; each statistic's
part of it (they sum to the distance) says why not, and the kind whose statistics contribute most names the segment. A text
is named after the largest share of its segments that are no prose when they make up more than half of it.

The language of a text follows from its script, for Latin script from which language's common words it uses; common
words are the words in most documents of a language, counted over all documents.

Statistics are taken of all texts of an Arrow batch at once: its characters are one array, and words, lines and segments are
ranges of it, so that no step runs text by text. (The same as columns with higher-order functions took three times as long.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.session import cut

STATS = (
    "log_words", "words_per_line", "words_per_piece", "mean_word_length", "line_end_share", "sentence_rate", "marker_share", "cell_rate", "even_cells", "digit_ratio",
    "symbol_ratio", "odd_token_share", "longest_token", "repeat_share", "repeated_words", "common_share", "known_share",
)
LANGS = ("en", "de", "fr", "es", "pt", "ru", "ja", "zh", "ko")
LATIN = 5  # the first languages share a script
COMMON = 64
KNOWN = 500
LIMIT = 13.0
NEAR = 5.0  # deviations from the median up to which a segment counts for the first moments
REFIT = 40.0  # squared distance up to which it counts for the next ones
REFITS = 2
VOTE = 60.0  # what one statistic may contribute at most when a kind is chosen
CHUNK = 1 << 19  # characters taken at once; a longer text is taken alone

# the least deviation of each statistic that is taken for one: prose of one corpus may hardly vary where other prose does
FLOOR = {
    "log_words": 0.7, "words_per_line": 5.0, "words_per_piece": 1.2, "mean_word_length": 0.5, "line_end_share": 0.4, "sentence_rate": 0.1, "marker_share": 0.1, "cell_rate": 0.08, "even_cells": 0.12,
    "digit_ratio": 0.06, "symbol_ratio": 0.06, "odd_token_share": 0.1, "longest_token": 0.4, "repeat_share": 0.16, "repeated_words": 0.16, "common_share": 0.07, "known_share": 0.1,
}
# the statistics that speak for each kind; both shares of words tell the same, of which the larger part counts
KINDS = {
    "list": ("marker_share", "words_per_line", "line_end_share", "words_per_piece", "sentence_rate"),
    "table": ("cell_rate", "even_cells"),
    "junk": ("symbol_ratio", "longest_token", "repeat_share", "repeated_words", "common_share", "known_share", "mean_word_length"),
}

# fixed values: line marks of lists; ends of lines and sentences; separators of items, cells and pieces; signs of ruled lines
_MARK = re.compile(r"(?m)^[ \t]*(?:[-*+•‣◦·–—▪●○■□»>][ \t]+|\[[ x]?\][ \t]*|\(?[0-9]{1,3}[.):]\)?[ \t]+|\(?[a-z][.)][ \t]+|\([0-9a-z]{1,3}\)[ \t]*|[ivx]{1,4}[.)][ \t]+|[①-⑳][ \t]*)(?=\S)")
_SETS = {
    "end": ".!?:…。！？\"”’»)]", "stop": ".!?…", "wide_stop": "。！？", "item": ",;、，·•|»«>", "cell": "|│┃\t", "piece": ",;、，·•|│┃»«>\t\n", "rule": "-=_*+|:.#~ \t", "bar": "|+", "under": "_",
}
_RANGES = {"kana": (0x3040, 0x3100), "han": (0x3400, 0xA000), "hangul": (0xAC00, 0xD7A4), "cyrillic": (0x400, 0x530), "latin": (0xC0, 0x250), "rule": (0x2500, 0x2580), "bar": (0x2500, 0x2580)}
_NAMES = ("letter", "digit", "blank", "kana", "han", "hangul", "cyrillic", "latin", *_SETS)
_BIT = {n: np.uint32(1 << i) for i, n in enumerate(_NAMES)}


@cache
def _table() -> np.ndarray:
    """What each character of the basic plane is, as bits."""
    t = np.zeros(0x10000, np.uint32)
    for o in range(0x10000):
        ch = chr(o)
        if ch.isalpha():
            t[o] |= _BIT["letter"]
        elif ch.isdigit():
            t[o] |= _BIT["digit"]
        elif ch.isspace():
            t[o] |= _BIT["blank"]
    for n, (a, b) in _RANGES.items():
        t[a:b] |= _BIT[n]
    t[np.arange(ord("a"), ord("z") + 1)] |= _BIT["latin"]
    for n, chars in _SETS.items():
        t[[ord(c) for c in chars]] |= _BIT[n]
    return t


def _ranges(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of a mask begin and end."""
    edge = np.flatnonzero(np.diff(mask.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


class Lexed:
    """Texts as one array of characters with its words, tokens, lines and segments."""

    R = np.uint64(0x9E3779B97F4A7C15)
    INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self, texts: list[str]):
        low = [t.lower() for t in texts]
        self.text = "\n".join([*low, ""])
        p = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.p, self.k = p, _table()[np.minimum(p, 0xFFFF)]
        self.doc_ends = np.cumsum([len(t) + 1 for t in low])
        self.docs = len(low)
        self.word_at, self.word_end = _ranges(self.has("letter"))
        self.word_doc = np.searchsorted(self.doc_ends, self.word_at, "right")

    def has(self, name: str) -> np.ndarray:
        return (self.k & _BIT[name]) != 0

    def upto(self, mask: np.ndarray) -> np.ndarray:
        """How many are marked before each place."""
        out = np.zeros(len(mask) + 1, np.int32)
        np.cumsum(mask, out=out[1:])
        return out

    def hashes(self, *ranges: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
        """A number for the characters of each range, the same for the same ones."""
        with np.errstate(over="ignore"):
            powers = np.full(len(self.p) + 1, self.R)
            powers[0] = 1
            powers = np.cumprod(powers)
            sums = np.zeros(len(self.p) + 1, np.uint64)
            np.cumsum(self.p.astype(np.uint64) * powers[1:], out=sums[1:])
            del powers
            back = np.full(len(self.p) + 1, self.INVERSE)
            back[0] = 1
            back = np.cumprod(back)
            return [((sums[b] - sums[a]) * back[a]).view(np.int64) for a, b in ranges]

    def scripts(self) -> np.ndarray:
        """Of each text the language of its script, or −1 for Latin script."""
        begins = np.concatenate([[0], self.doc_ends[:-1]])
        n = {s: np.add.reduceat(self.has(s), begins, dtype=np.int64) for s in ("kana", "han", "hangul", "cyrillic", "latin")}
        cj, ko = 2 * (n["kana"] + n["han"]), 2 * n["hangul"]
        most = np.maximum.reduce([cj, ko, n["cyrillic"], n["latin"]])
        out = np.where(n["cyrillic"] == most, LANGS.index("ru"), -1)
        out = np.where(ko == most, LANGS.index("ko"), out)
        out = np.where(cj == most, np.where(8 * n["kana"] > n["han"], LANGS.index("ja"), LANGS.index("zh")), out)
        return np.where(most == 0, -1, out)


_WIDE = (LANGS.index("ja"), LANGS.index("zh"))


def _chunks(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in pieces of bounded length."""
    size = pdf["text"].str.len().cumsum()
    for _, part in pdf.groupby((size // CHUNK).to_numpy()):
        yield part


def common_words(docs: DataFrame, top: int = KNOWN) -> list[np.ndarray]:
    """Of each language, the words (characters in scripts without spaces) that stand in most documents, ``top`` each, most
    common first, as their hashes (their code points). ``docs``: ``text, declared``."""

    def seen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for part in _chunks(pdf):
                x = Lexed(list(part["text"]))
                lang = x.scripts()
                lang = np.where(lang < 0, part["declared"].map({n: i for i, n in enumerate(LANGS[:LATIN])}).fillna(-1).to_numpy(int), lang)
                wide = np.isin(lang, _WIDE)
                at = np.flatnonzero(x.has("han") | x.has("kana"))
                doc = np.searchsorted(x.doc_ends, at, "right")
                chars = pd.DataFrame({"doc": doc, "unit": x.p[at].astype(np.int64)})[wide[doc]]
                words = pd.DataFrame({"doc": x.word_doc, "unit": x.hashes((x.word_at, x.word_end))[0]})[(lang >= 0)[x.word_doc] & ~wide[x.word_doc]]
                for units in (chars, words):
                    units = units.drop_duplicates()
                    found.append(pd.DataFrame({"lang": lang[units["doc"].to_numpy()], "unit": units["unit"].to_numpy()}))
            if found:
                yield pd.concat(found).groupby(["lang", "unit"]).size().rename("n").reset_index()

    rows = docs.mapInPandas(seen, "lang int, unit long, n long").groupBy("lang", "unit").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "unit"))
    best: list[list[int]] = [[] for _ in LANGS]
    for r in sorted(rows.withColumn("k", rank).where(F.col("k") <= top).collect(), key=lambda r: r["k"]):  # nine languages at ``top`` words each
        best[r["lang"]].append(r["unit"])
    return [np.array(x, np.int64) for x in best]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    some = np.sort(some)
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _languages(x: Lexed, words: np.ndarray, common: list[np.ndarray]) -> np.ndarray:
    """The language of each text: of its script, or the one of Latin script whose common words it uses most."""
    score = np.stack([np.bincount(x.word_doc[_among(words, c[:COMMON])], minlength=x.docs) for c in common[:LATIN]])
    lang = x.scripts()
    return np.where(lang < 0, score.argmax(axis=0), lang)


def _segments(common: list[np.ndarray]):
    """Texts to segments with their statistics."""
    latin = np.unique(np.concatenate(common[:LATIN]))
    known = [latin if i < LATIN else c for i, c in enumerate(common)]

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in _chunks(pdf):
                yield statistics(list(part["text"]), part["doc_id"].to_numpy(), common, known)

    return over


def statistics(texts: list[str], ids: np.ndarray, common: list[np.ndarray], known: list[np.ndarray]) -> pd.DataFrame:
    """``doc_id, lang, size`` and ``STATS`` of the segments of some texts."""
    x = Lexed(texts)
    p, k = x.p, x.k
    blank = x.has("blank")
    # lines, trimmed
    end = np.flatnonzero(p == 10)
    begin = np.concatenate([[0], end[:-1] + 1])
    solid = np.flatnonzero(~blank)
    first_i, last_i = np.searchsorted(solid, begin), np.searchsorted(solid, end)
    full = last_i > first_i
    begin, end, first_i, last_i = begin[full], end[full], first_i[full], last_i[full]
    if not len(begin):
        return pd.DataFrame(columns=["doc_id", "lang", "size", *STATS])
    gap = np.diff(np.flatnonzero(full), prepend=-1) > 1  # a blank line before
    first, last = solid[first_i], solid[last_i - 1] + 1
    size, doc = last_i - first_i, np.searchsorted(x.doc_ends, begin, "right")
    words, lines = x.hashes((x.word_at, x.word_end), (first, last))
    lang = _languages(x, words, common)
    within = lambda mask: (lambda c: c[last] - c[first])(x.upto(mask))
    tok_at, tok_end = _ranges(~blank)
    tok_line = np.searchsorted(begin, tok_at, "right") - 1
    n_tok = np.bincount(tok_line, minlength=len(begin))
    after, before = np.append(p[1:], 10), np.concatenate([[10], p[:-1]])
    # bars, tabs, wide blanks, commas and semicolons without a blank part cells; those with one part items, as slashes between blanks do
    wide_blank, slash = (p == 32) & (after == 32) & (before != 32), (p == 47) & (after == 32) & (before == 32)
    cells = within(x.has("cell") | (((p == 44) | (p == 59)) & (after != 32)) | wide_blank)
    items = within(x.has("item") | slash) + 1
    wide = within(x.has("kana") | x.has("han")) > 0
    ended = (k[last - 1] & _BIT["end"]) != 0
    rule = within(x.has("rule")) == last - first
    marked = np.zeros(len(begin), bool)
    marked[np.searchsorted(begin, [m.start() for m in _MARK.finditer(x.text)], "right") - 1] = True
    short = np.where(wide, last - first <= 14, (n_tok <= 6) & (last - first <= 34))
    row = (items >= 5) & np.where(wide, last - first <= 11 * items, n_tok <= 3.5 * items)
    make = np.select([marked, rule & (within(x.has("bar")) > 0), rule, (cells >= 2) & (4 * cells >= n_tok - 1), ~ended & (row | short)], [1, 2, 3, 2, 4], 0)
    # stretches of lines of one make
    new = gap | (np.diff(doc, prepend=-1) != 0) | (np.diff(make, prepend=-1) != 0)
    seg_of_line = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    total = lambda per_line: np.add.reduceat(per_line, heads)
    n_seg = len(heads)
    n_lines = np.diff(np.append(heads, len(begin)))
    seg_lang = lang[doc[heads]]
    seg_wide = np.isin(seg_lang, _WIDE)
    letters, digits, chars = total(within(x.has("letter"))), total(within(x.has("digit"))), total(size)
    signs = chars - letters - digits - total(within((x.has("cell") | x.has("bar") | x.has("piece")) & ~blank))
    row_at = np.flatnonzero(~rule)  # lines of signs between rows do not count
    even = np.bincount(seg_of_line[row_at[1:]][(np.diff(cells[row_at]) == 0) & (cells[row_at[1:]] > 0) & (np.diff(seg_of_line[row_at]) == 0)], minlength=n_seg)
    n_rows = np.bincount(seg_of_line[row_at], minlength=n_seg)
    word_seg = seg_of_line[np.searchsorted(begin, x.word_at, "right") - 1]
    n_run = np.bincount(word_seg, minlength=n_seg)
    n_words = np.where(seg_wide, letters / 3, n_run)
    n_toks = np.maximum(total(n_tok), 1)
    tok_seg = seg_of_line[tok_line]
    tok_len = tok_end - tok_at
    in_tok = lambda mask: (lambda c: c[tok_end] - c[tok_at])(x.upto(mask))
    plain = in_tok(x.has("letter")) > 0
    odd = (tok_len > 1) & ((in_tok(x.has("under")) > 0) | ~plain | ((in_tok(x.has("digit")) > 0) & ~seg_wide[tok_seg]))
    stops = np.bincount(tok_seg[(k[tok_end - 1] & _BIT["stop"]) != 0], minlength=n_seg) + total(within(x.has("wide_stop")))
    pieces = total(within(x.has("piece") | slash | wide_blank)) + n_lines
    longest = np.zeros(n_seg, np.int64)
    np.maximum.at(longest, tok_seg, tok_len)
    distinct = lambda seg, what: np.bincount(pd.DataFrame({"s": seg, "w": what}).drop_duplicates()["s"].to_numpy(), minlength=n_seg)
    again = pd.DataFrame({"d": doc, "l": lines}).duplicated().to_numpy()  # lines that stood in the text before
    at = np.flatnonzero(x.has("kana") | x.has("han"))
    char_seg = seg_of_line[np.searchsorted(begin, at, "right") - 1]

    n_chars = np.bincount(char_seg, minlength=n_seg)

    def share(of: list[np.ndarray]) -> np.ndarray:
        """Of words; of characters where there are no blanks between words, if a segment has any."""
        out = np.zeros(n_seg)
        for i in np.unique(seg_lang):
            by_char = (n_chars > 0) & (i in _WIDE)
            for seg, what, n, use, some in ((char_seg, p[at].astype(np.int64), n_chars, by_char, of[i]), (word_seg, words, n_run, ~by_char, of[0] if i in _WIDE else of[i])):
                mine = (seg_lang[seg] == i) & use[seg]
                out += np.bincount(seg[mine][_among(what[mine], some)], minlength=n_seg) / np.maximum(n, 1)
        return out

    values = (
        np.log1p(n_words), np.minimum(n_words / n_lines, 25.0), np.minimum(n_words / pieces, 12.0), np.where(seg_wide, 1.5, letters / np.maximum(n_run, 1)), total(ended) / n_lines,
        np.minimum(stops / (n_words + 1), 0.5), make[heads] == 1, np.minimum(total(cells) / np.where(seg_wide, n_words + 1, n_toks), 1.0), even / np.maximum(n_rows - 1, 1), digits / chars, signs / chars,
        np.bincount(tok_seg[odd], minlength=n_seg) / n_toks, np.where(seg_wide, 2.0, np.log1p(longest)), total(again) / n_lines,
        1 - np.log1p(distinct(word_seg, words)) / np.log1p(np.maximum(n_run, 1)), share([c[:COMMON] for c in common]), share(known),
    )
    return pd.DataFrame({"doc_id": ids[doc[heads]], "lang": np.array(LANGS)[seg_lang], "size": chars, **{n: np.asarray(v, float) for n, v in zip(STATS, values)}})


Model = dict[str, tuple[np.ndarray, np.ndarray]]


def _distance(model: Model, pdf: pd.DataFrame) -> np.ndarray:
    """Each statistic's part of each segment's squared distance from the prose of its language."""
    x = pdf[list(STATS)].to_numpy(float)
    parts = np.zeros_like(x)
    for lang, (mean, inverse) in model.items():
        at = (pdf["lang"] == lang).to_numpy()
        d = x[at] - mean
        parts[at] = d * (d @ inverse)
    return parts


def _moments(segs: DataFrame, near) -> Model:
    """Mean and inverse covariance by language of the segments that ``near`` keeps, weighted by the root of their size."""
    n = len(STATS)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for pdf in batches:
            pdf = pdf[near(pdf)]
            for lang, part in pdf.groupby("lang"):
                x = np.column_stack([np.ones(len(part)), part[list(STATS)].to_numpy(float)])
                total[lang] = total.get(lang, 0) + (x * np.sqrt(part["size"].to_numpy(float))[:, None]).T @ x
        for lang, t in total.items():
            yield pd.DataFrame({"lang": lang, "k": np.arange(t.size), "v": t.ravel()})

    got: dict[str, np.ndarray] = {}
    for r in segs.mapInPandas(sums, "lang string, k int, v double").groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():  # languages × statistics²
        got.setdefault(r["lang"], np.zeros((n + 1) ** 2))[r["k"]] = r["v"]
    out = {}
    for lang, flat in got.items():
        t = flat.reshape(n + 1, n + 1)
        mean = t[0, 1:] / t[0, 0]
        cov = t[1:, 1:] / t[0, 0] - np.outer(mean, mean)
        out[lang] = (mean, np.linalg.inv(cov + np.diag([FLOOR[s] ** 2 for s in STATS])))
    return out


def prose_model(segs: DataFrame) -> Model:
    """Robust mean and inverse covariance of prose, by language, from all segments."""
    by = [F.percentile_approx(s, 0.5, 2000).alias(s) for s in STATS]
    rows = lambda d: {r["lang"]: np.array([r[s] for s in STATS], float) for r in d.collect()}  # noqa: E731  # a row a language
    middle = segs.groupBy("lang").agg(*by)
    m = middle.select(F.col("lang").alias("l"), *(F.col(s).alias(f"m_{s}") for s in STATS))
    off = segs.join(F.broadcast(m), F.col("lang") == F.col("l")).select("lang", *(F.abs(F.col(s) - F.col(f"m_{s}")).alias(s) for s in STATS))  # a row a language
    median, spread = rows(middle), rows(off.groupBy("lang").agg(*by))
    scale = {k: np.maximum(1.4826 * v, [FLOOR[s] for s in STATS]) for k, v in spread.items()}
    free = np.isin(STATS, ("log_words", "words_per_line"))  # how much prose there is, and how it is wrapped

    def near_median(pdf: pd.DataFrame) -> np.ndarray:
        off = np.abs(pdf[list(STATS)].to_numpy(float) - np.array([median[x] for x in pdf["lang"]]).reshape(-1, len(STATS)))
        return (np.where(free, 0, off / np.array([scale[x] for x in pdf["lang"]]).reshape(-1, len(STATS))) <= NEAR).all(axis=1)

    model = _moments(segs, near_median)
    for _ in range(REFITS):
        model = _moments(segs, lambda pdf, m=model: _distance(m, pdf).sum(axis=1) <= REFIT)
    return model


def judged_segments(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """Every segment of every text with its statistics, squared distance from prose and the parts of it.

    Columns: ``doc_id, lang, size``, the statistics, ``distance``, ``parts`` (map), ``kind`` (prose, list, table or junk).
    Null and blank texts have no segments. ``doc_id`` need not be unique; equal ids are judged as one text.
    """
    declared = F.lower(F.substring(F.trim("lang"), 1, 2))
    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", declared.alias("declared"))
    schema = "doc_id long, lang string, size long, " + ", ".join(f"{s} double" for s in STATS)
    segs = cut(texts.select("doc_id", "text").mapInPandas(_segments(common_words(texts.select("text", "declared"))), schema))
    model = prose_model(segs)
    groups = [[STATS.index(s) for s in KINDS[k]] for k in KINDS]
    shares = [STATS.index("common_share"), STATS.index("known_share")]

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = _distance(model, pdf)
            distance = parts.sum(axis=1)
            capped = np.minimum(parts, VOTE)
            capped[:, shares] = np.where(np.arange(2) == capped[:, shares].argmax(axis=1)[:, None], capped[:, shares], 0)
            votes = np.stack([capped[:, g].sum(axis=1) for g in groups], axis=1)
            kind = np.where(distance > limit, np.array(list(KINDS))[votes.argmax(axis=1)], "prose")
            yield pdf.assign(distance=distance, parts=[dict(zip(STATS, map(float, p))) for p in parts], kind=kind)

    return segs.mapInPandas(measured, schema + ", distance double, parts map<string,double>, kind string")


def text_quality(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """One row per text: its language, size-weighted statistics and distance, the part of each statistic in that, the three
    that contribute most, the share of prose, and ``kind`` (prose if at least half of it is prose, else the largest other kind).

    Null and blank texts have no row. Texts of all lengths are read whole; an empty table gives an empty result.
    """
    segs = judged_segments(docs, limit)
    w = F.col("size")
    other = lambda k: F.sum(F.when(F.col("kind") == k, w).otherwise(0)).alias(k)
    mean = [(F.sum(F.col(s) * w) / F.sum(w)).alias(s) for s in STATS]
    parts = [(F.sum(F.col("parts")[s] * w) / F.sum(w)).alias(f"part_{s}") for s in STATS]
    out = segs.groupBy("doc_id").agg(
        F.max_by("lang", "size").alias("lang"), F.sum("size").alias("chars"), *mean, (F.sum(F.col("distance") * w) / F.sum(w)).alias("distance"),
        *parts, other("prose"), other("list"), other("table"), other("junk"),
    )
    ranked = F.reverse(F.array_sort(F.array(*(F.struct(F.col(f"part_{s}").alias("p"), F.lit(s).alias("s")) for s in STATS))))
    top = [F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in KINDS]
    kind = F.when(F.col("prose") * 2 >= F.col("chars"), "prose").otherwise(F.greatest(*top)["k"])
    return out.select(
        "doc_id", "lang", "chars", *STATS, "distance", F.map_from_arrays(F.array(*map(F.lit, STATS)), F.array(*(F.col(f"part_{s}") for s in STATS))).alias("parts"),
        F.transform(F.slice(ranked, 1, 3), lambda x: x["s"]).alias("outlying"), (F.col("prose") / F.col("chars")).alias("prose_share"), kind.alias("kind"),
    )


def non_prose(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``doc_id, kind`` of the texts that are not running prose by more than half."""
    segs = judged_segments(docs, limit)
    per = segs.groupBy("doc_id").agg(F.sum("size").alias("chars"), *(F.sum(F.when(F.col("kind") == k, F.col("size")).otherwise(0)).alias(k) for k in ("prose", *KINDS)))
    kind = F.greatest(*(F.struct(F.col(k).alias("n"), F.lit(k).alias("k")) for k in KINDS))["k"]
    return per.where(F.col("prose") * 2 < F.col("chars")).select("doc_id", kind.alias("kind"))
