"""Problem 2: text that was decoded with the wrong charset, found and restored by best-first search.

Nodes of the graph are texts; an edge encodes a text with the charset that may have been used by mistake and decodes the
bytes with another one, or resolves escapes. A text's cost says how implausible its characters are: every window of
three characters that holds a non-ASCII one costs the negative logarithm of its share among all such windows of the whole
corpus; windows never seen cost by the classes of their characters. The search expands the cheapest text first, keeps
the hashes of visited texts, and ends when the frontier can't get cheaper. A record is garbled if it holds characters
that only a failed decoding leaves (U+FFFD, C1 controls, private use) or if a clearly cheaper, well-known text can be reached.

The window counts are taken over all rows, and over distinct texts, in one pass (hashed into a table of fixed size, so that the model is bounded
whatever the corpus); the search runs in Arrow batches, remembers texts that differ only in plain words and numbers for
all tasks of a worker, and sees only rows with a non-ASCII character or an escape. Texts of any length are searched in pieces of up to 2000 characters,
cut at blanks.
"""

from __future__ import annotations

import codecs
import heapq
import html
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1 << 21
MARGIN = 3.0
USUAL = 4e-5
MAX_EXPANSIONS = 8
SLACK = 3.0
UTF8_BONUS = 6.0
_CACHE = 200_000
_CACHE_CHARS = 1 << 24

# fixed values: charsets a text may have been decoded with by mistake, and may really have been written in
WRONG = ("latin_1", "cp1252", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "mac_roman", "cp932", "gb18030", "cp949", "iso8859_5")
TRUE = ("utf_8", "cp1252", "mac_roman", "cp1251", "koi8_r", "cp866", "cp437", "cp850", "cp932", "euc_jp", "gb18030", "cp949", "iso8859_5", "mac_cyrillic", "iso8859_7")

_DIGITS = re.compile(r"[0-9]+")
_BROKEN = re.compile("[�\x80-\x9f-￰-￻\U000f0000-\U0010ffff]")
_BROKEN_WORD = re.compile(r"\w\ufffd|\ufffd\w")
_SURROGATE = re.compile("[\ud800-\udfff]")
_PARTS = re.compile(r"(?s).{1,2000}(?:\s|\Z)|.{1,2000}")
_MARKS = re.compile("\ufffd{2,}")
_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|&(?:#[0-9]{2,6}|#x[0-9a-fA-F]{2,5}|[A-Za-z]{4,8});")


def _classes() -> np.ndarray:
    """Class of every BMP code point: 0 ASCII sign, 1 ASCII letter, 2 Latin, 3 Cyrillic, 4 Greek, 5 kana and Han, 6 Hangul, 7 half-width kana, 8 sign, 9 broken."""
    c = np.full(0x10000, 8, np.uint8)
    c[:0x80] = 0
    for a, b in ((0x41, 0x5B), (0x61, 0x7B)):
        c[a:b] = 1
    for a, b, k in (
        (0xC0, 0x250, 2), (0x370, 0x400, 4), (0x400, 0x530, 3), (0x3000, 0x3100, 5), (0x3400, 0xA000, 5), (0xF900, 0xFB00, 5),
        (0xFF00, 0xFF61, 5), (0xAC00, 0xD7A4, 6), (0xFF61, 0xFFA0, 7), (0x80, 0xA0, 9), (0xD800, 0xF900, 9), (0xFFF0, 0x10000, 9),
    ):
        c[a:b] = k
    for x in (0xD7, 0xF7):
        c[x] = 8
    for x in (0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026):  # quotes, dashes and dots stand next to letters
        c[x] = 0
    return c


_CLASS = _classes()
_ODD = np.ones((10, 10), np.float32)
for _k in range(8):
    _ODD[_k, _k] = _ODD[_k, 0] = _ODD[0, _k] = 0
_ODD[1, 2] = _ODD[2, 1] = _ODD[0, 8] = _ODD[8, 0] = 0
_ODD[9, :] = _ODD[:, 9] = 2
_PAIRS = _ODD.ravel()


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _windows(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed windows of three code points with a non-ASCII one among them, and where they begin."""
    far = p > 127
    at = np.nonzero(far[:-2] | far[1:-1] | far[2:])[0]
    h = (p[:-2] * np.uint64(0x9E3779B1) + p[1:-1] * np.uint64(0x85EBCA77) + p[2:])[at] * np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(40)) & np.uint64(BUCKETS - 1), at


def folded(text: str) -> str:
    """Lower case, every number one 0, line ends as blanks, framed by line ends: what windows are taken of."""
    return "\n\n" + _DIGITS.sub("0", text.lower().replace("\n", " ")) + "\n\n"


def _count(column: str):
    """Partial window counts of a partition, as (bucket, count)."""

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            texts = [readable(t) for t in pdf[column] if t]
            if texts:
                total += np.bincount(_windows(_points("\n\n".join(["", *(folded(t)[2:-2] for t in texts), ""])))[0].astype(np.int64), minlength=BUCKETS)
        at = np.nonzero(total)[0]
        if len(at):
            yield pd.DataFrame({"bucket": at, "n": total[at]})

    return over


def window_counts(texts: DataFrame) -> np.ndarray:
    """Counts of all windows of the texts (first column) of the whole DataFrame; at most ``BUCKETS`` numbers reach the driver."""
    c = texts.columns[0]
    part = texts.mapInPandas(_count(c), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, np.int64)
    counts[part["bucket"].to_numpy(np.int64)] = part["n"].to_numpy(np.int64)
    return counts


def _count_both(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial window counts of distinct texts t that occur n times each: by rows, and by distinct texts."""
    rows, once = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for pdf in batches:
        pdf = pdf[pdf["t"].fillna("") != ""]
        if len(pdf):
            p = _points("\n\n".join(["", *(folded(readable(t))[2:-2] for t in pdf["t"]), ""]))
            h, at = _windows(p)
            of = (np.cumsum(p == 10) - 1) // 2
            first = np.minimum(np.where(p[at] == 10, of[np.minimum(at + 2, len(p) - 1)], of[at]), len(pdf) - 1)
            h = h.astype(np.int64)
            rows += np.bincount(h, weights=pdf["n"].to_numpy(float)[first], minlength=BUCKETS)
            once += np.bincount(h, minlength=BUCKETS)
    at = np.nonzero(rows)[0]
    if len(at):
        yield pd.DataFrame({"bucket": at, "n": rows[at].astype(np.int64), "m": once[at].astype(np.int64)})


def _read(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its hash, where it begins, what its pairs of classes cost if it is unseen, whether it is broken."""
    h, at = _windows(p)
    k = _CLASS[np.minimum(p, 0xFFFF).astype(np.int64)]
    pair = _PAIRS.take(k[:-1] * np.uint8(10) + k[1:])
    bad = k == 9
    return h.astype(np.int64), at, (pair[:-1] + pair[1:])[at], (bad[:-2] | bad[1:-1] | bad[2:])[at]


@lru_cache(256)
def _of(framed: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_read`` of one text, which is asked for by both tables of counts."""
    return _read(_points(framed))


@lru_cache(256)
def _odd(framed: str) -> bool:
    """Whether a text has characters side by side that don't go together."""
    p = _points(framed)
    _, at, _, _ = _of(framed)
    k = _CLASS[np.minimum(p, 0xFFFF).astype(np.int64)]
    return bool(_ODD[k[at], k[at + 1]].any() or (k[at] == 9).any())


def _of_many(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, pairs and broken ones of the windows of many folded texts at once, and the number of each window's text."""
    joint = "\n\n".join(["", *(t.replace("\n", " ") for t in texts), ""])
    p = _points(_DIGITS.sub("0", joint.lower()))
    h, at, odd, bad = _read(p)
    of = (np.cumsum(p == 10) - 1) // 2  # two line ends before each text; a window that starts on a frame belongs to what follows
    first = np.where(p[at] == 10, of[np.minimum(at + 2, len(p) - 1)], of[at])
    return h, odd, bad, np.minimum(first, len(texts) - 1)


class Plausibility:
    """Costs of texts by the window counts of a corpus; ``distinct``, if given, are those of its distinct texts, by which
    texts that seem all right are judged once more: repetition makes a text plausible by rows, but not by those."""

    def __init__(self, counts: np.ndarray, distinct: np.ndarray | None = None):
        self.distinct = None if distinct is None else Plausibility(distinct)
        self.name = uuid.uuid4().hex
        total = max(int(counts.sum()), 1)
        with np.errstate(divide="ignore"):
            self.costs = np.where(counts > 0, np.log(total / np.maximum(counts, 0.5)), -1).astype(np.float32)
        self.unseen = float(np.log(total / 0.4)) + 1
        self.usual = float(np.log(total / max(3.0, total * USUAL)))

    def suspicious(self, framed: str) -> bool:
        """Whether a text is worth a search: characters side by side that don't go together, or three windows on end that are rare.

        A rare pair of usual words makes two rare windows on end at most, a wrong character makes three.
        """
        h, at, _, _ = _of(framed)
        if not len(at):
            return False
        if _odd(framed):
            return True
        cost = self.costs[h]
        rare = (cost < 0) | (cost > self.usual)
        return bool(len(at) > 2 and (rare[:-2] & rare[1:-1] & rare[2:] & (at[2:] - at[:-2] == 2)).any())

    def vouched(self, old: str, new: str) -> bool:
        """Whether the corpus speaks for a change of a folded text: the old one has characters side by side that don't go
        together, or of the windows that came in a third is known. Rare texts may else be changed into unknown ones that are shorter."""
        if _odd(old):
            return True
        came = np.setdiff1d(_of(new)[0], _of(old)[0])
        return not len(came) or float(np.mean(self.costs[came] >= 0)) >= 1 / 3

    def windows(self, text: str) -> np.ndarray:
        """The cost of each window that holds a non-ASCII character."""
        h, _, odd, bad = _of(text)
        return self._priced(h, odd, bad)

    def _priced(self, h: np.ndarray, odd: np.ndarray, bad: np.ndarray) -> np.ndarray:
        cost = self.costs[h]
        cost = np.where(cost < 0, self.unseen + 1.5 * odd, cost)
        return np.where(bad, self.unseen + 4, cost)

    def cost(self, text: str) -> float:
        """What all windows of a folded text cost together."""
        return float(self.windows(text).sum())

    def all_costs(self, texts: list[str]) -> np.ndarray:
        """``cost(folded(t))`` of many texts at once."""
        return self.sums(_of_many(texts), len(texts))

    def sums(self, many: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], n: int) -> np.ndarray:
        """What the windows of each of n texts cost together."""
        h, odd, bad, first = many
        return np.bincount(first, weights=self._priced(h, odd, bad), minlength=n)


def _sloppy(charset: str) -> str:
    """A single-byte charset as a table; bytes that it leaves free are C1 controls, as browsers read them."""
    up = []
    for b in range(256):
        try:
            up.append(bytes([b]).decode(charset))
        except UnicodeDecodeError:
            up.append(chr(b))
    return "".join(up)


_UP = {x: _sloppy(x) for x in {*WRONG, *TRUE} if x not in ("utf_8", "cp932", "gb18030", "cp949", "euc_jp")}
_DOWN = {x: codecs.charmap_build(up) for x, up in _UP.items()}
_ENCODABLE = {x: re.compile("[" + re.escape(up) + "]+") for x, up in _UP.items()}
# bytes of each that are read as controls
_FREE = {x: bytes(b for b, ch in enumerate(up) if _BROKEN.match(ch)) for x, up in _UP.items()}
_SKIPPED: list[tuple[int, int]] = []


def _skipped(e: UnicodeError) -> tuple[bytes, int]:
    """Leaves out what a multi-byte charset can't write: 0xFF, which it never writes, stands there."""
    _SKIPPED.append((e.start, e.end))
    return b"\xff", e.end


codecs.register_error("loomtrace_skipped", _skipped)


def _encoded(text: str, charset: str) -> list[tuple[str, bytes | None]]:
    """The text in pieces: those the charset can write, with their bytes, and the others."""
    out: list[tuple[str, bytes | None]] = []
    if charset in _UP:
        down = _DOWN[charset]
        try:
            return [(text, codecs.charmap_encode(text, "strict", down)[0])] if text else out
        except UnicodeEncodeError:
            pass
        i = 0
        for m in _ENCODABLE[charset].finditer(text):
            if m.start() > i:
                out.append((text[i : m.start()], None))
            piece = m.group()
            out.append((piece, codecs.charmap_encode(piece, "strict", down)[0]))
            i = m.end()
        if i < len(text):
            out.append((text[i:], None))
        return out
    if "\uf8f3" not in text:  # the one character of which cp932 makes 0xFF
        _SKIPPED.clear()
        raw = text.encode(charset, "loomtrace_skipped")
        if not _SKIPPED:
            return [(text, raw)] if text else out
        i = 0
        for (start, end), low in zip(_SKIPPED, raws := raw.split(b"\xff")):
            if start > i:
                out.append((text[i:start], low))
            out.append((text[start:end], None))
            i = end
        if i < len(text):
            out.append((text[i:], raws[-1]))
        return out
    while text:
        try:
            out.append((text, text.encode(charset)))
            break
        except UnicodeEncodeError as e:
            if e.start:
                out.append((text[: e.start], text[: e.start].encode(charset)))
            out.append((text[e.start : e.end], None))
            text = text[e.end :]
    return out


def _decoded(raw: bytes, charset: str) -> str | None:
    return codecs.charmap_decode(raw, "strict", _UP[charset])[0] if charset in _UP else _decoded_wide(raw, charset)


@lru_cache(1 << 16)
def _decoded_wide(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset)
    except UnicodeDecodeError as e:
        if e.start and ("end of data" in e.reason or "incomplete" in e.reason):  # cut off within its last character
            whole = raw[: e.start].decode(charset)
            return whole if sum(ch > "\x7f" for ch in whole) >= 3 else None
        return None


def _traces() -> re.Pattern:
    """What the bytes of U+FFFD look like in other charsets: all that is left of a character that was lost before."""
    out = set()
    for x in WRONG:
        try:
            out.add((b"\xef\xbf\xbd" * (1 if x in _UP else 2)).decode(x))
        except UnicodeDecodeError:
            continue
    return re.compile("|".join(re.escape(x) for x in sorted(out)))


_TRACE = _traces()
# UTF-8 of which bytes were lost as "?", with the sequences that are whole, and losses between letters
_LOST = rb"[\xc2-\xdf]\?|[\xe0-\xef](?:\?[\x80-\xbf?]|[\x80-\xbf]\?)"
_WHOLE = rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}"
_SEQUENCES = re.compile(_WHOLE)
_LOSSY = re.compile(rb"(?s)(?:[\x00-\x7f]|" + _WHOLE + b"|" + _LOST + rb")*\Z")
_SEQUENCE = re.compile(b"(" + _WHOLE + b")|(?:" + _LOST + b")")
_BETWEEN = re.compile(rb"[A-Za-z](?:" + _LOST + rb")[a-z]")


def lossy_utf8(text: str) -> bool:
    """Whether a text is UTF-8 read with a single-byte charset throughout, some of its bytes having become question marks."""
    if "?" not in text:
        return False
    for wrong in WRONG:
        if wrong in _UP and len(pieces := _encoded(text, wrong)) == 1 and (raw := pieces[0][1]) is not None and _LOSSY.match(raw):
            found = [m.group(1) is not None for m in _SEQUENCE.finditer(raw)]
            if not all(found) and (len(found) > 1 and any(found) or _BETWEEN.search(raw)):
                return True
    return False


def _joined(pieces: list[tuple[str, bytes | None]]) -> list[tuple[str, bytes | None]]:
    """Neighbouring pieces that stay as they are, whatever they are read with, as one."""
    out: list[tuple[str, bytes | None]] = []
    same: list[str] = []
    for text, raw in pieces:
        if raw is None or text.isascii():
            same.append(text)
            continue
        if same:
            out.append(("".join(same), None))
            same = []
        out.append((text, raw))
    if same:
        out.append(("".join(same), None))
    return out


@lru_cache(1 << 16)
def _width(char: str, charset: str) -> int:
    return len(char.encode(charset))


def _ending(word: str, raw: bytes, charset: str) -> str:
    """A word whose beginning is clean: its longest ending that is UTF-8 read anew, else the word as it is."""
    if charset == "utf_8" and len(word) == len(raw):
        for i in range(1, len(word) - 1):
            if raw[i] >= 0xC2 and (end := _decoded(raw[i:], charset)) is not None:
                return word[:i] + end
    return word


def _step(pieces: list[tuple[str, bytes | None]], charset: str, wrong: str = "") -> str | None:
    """The pieces' bytes read with another charset: whole pieces, the words that allow it, or an ending; None if nothing changes."""
    suffixes = wrong if wrong not in _UP and charset not in _UP else ""
    out, changed = [], False
    for text, raw in pieces:
        if raw is None or text.isascii() or charset == "utf_8" and not _SEQUENCES.search(raw):
            out.append(text)
            continue
        # leading ASCII stays: multi-byte charsets would read on from any byte of it alike
        new = _decoded(raw, charset)
        if new is None and b" " in raw:
            words = raw.split(b" ")
            olds = text.split(" ")
            if len(words) == len(olds):
                news = [o if o.isascii() else (_decoded(w, charset) or _ending(o, w, charset)) for w, o in zip(words, olds)]
                new = " ".join(news)
        if new is None and suffixes:
            # a clean beginning that the charset can write as well: the longest ending that can be read
            at = 0
            for i in range(1, len(text)):
                at += _width(text[i - 1], suffixes)
                if text[i] > "\x7f" and (end := _decoded(raw[at:], charset)) is not None:
                    new = text[:i] + end
                    break
        if new is None:
            new = text
        changed |= new != text
        out.append(new)
    return _unmarked("".join(out)) if changed else None


def _unmarked(text: str) -> str:
    return _MARKS.sub("\ufffd", text) if "\ufffd" in text else text


# successors in the order in which they are made: bytes that are UTF-8 are no accident, then single-byte charsets, then the others
_STAGES = (("utf_8",), tuple(x for x in TRUE if x in _UP), tuple(x for x in TRUE if x not in _UP and x != "utf_8"))


def _raw(pieces: list[tuple[str, bytes | None]]) -> bytes:
    return b"".join(low for _, low in pieces if low is not None)


def _swapped(text: str, pieces: list[tuple[str, bytes | None]], raw: bytes, true: str) -> str | None:
    """``_step`` to a single-byte charset, which reads every byte by itself: those of all pieces at once."""
    new = codecs.charmap_decode(raw, "strict", _UP[true])[0]
    if len(pieces) != 1 or pieces[0][1] is None:
        out, i = [], 0
        for t, low in pieces:
            if low is None:
                out.append(t)
            else:
                out.append(new[i : i + len(low)])
                i += len(low)
        new = "".join(out)
    return None if new == text else _unmarked(new)


def unescaped(text: str) -> str:
    """HTML references and \\uXXXX resolved; halves of surrogate pairs stay as they are written."""
    out = _ESCAPE.sub(lambda m: chr(int(m.group()[2:], 16)) if m.group()[0] == "\\" else html.unescape(m.group()), text)
    if _SURROGATE.search(out):
        out = _SURROGATE.sub(lambda m: f"\\u{ord(m.group()):04x}", out.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "surrogatepass"))
    return out


def readable(text: str) -> str:
    """The text itself, or what it says if it is ASCII with escapes."""
    return unescaped(text) if text.isascii() and _ESCAPE.search(text) else text


class _Node:
    """A text of the graph: its pieces by charset, and its successors by stage, made once for both tables of counts."""

    __slots__ = ("text", "marred", "by_wrong", "stages", "read")

    def __init__(self, text: str):
        self.text = text
        self.marred = _BROKEN.search(text) is not None
        self.by_wrong: dict[tuple, tuple] = {}
        for wrong in WRONG:
            pieces = _encoded(text, wrong)
            if any(raw is not None and not t.isascii() for t, raw in pieces):
                self.by_wrong.setdefault(tuple(raw for _, raw in pieces), (wrong, _joined(pieces)))
        self.stages: dict[int, dict[str, tuple[tuple, bool]]] = {}
        self.read: dict[int, tuple[list[str], tuple]] = {}

    def successors(self, stage: int) -> dict[str, tuple[tuple, bool]]:
        """Every successor of a stage with its step, and whether whole bytes led to characters lost before."""
        if stage in self.stages:
            return self.stages[stage]
        nexts: dict[str, tuple[tuple, bool]] = {}
        text, marred = self.text, self.marred
        if stage == 0 and _ESCAPE.search(text):
            nexts[unescaped(text)] = (("unescape", ""), False)
        for wrong, pieces in self.by_wrong.values():
            raw = _raw(pieces)
            for true in _STAGES[stage]:
                if true == wrong:
                    continue
                if true in _UP:
                    if not marred and _FREE[true] and len(raw.translate(None, _FREE[true])) < len(raw):
                        continue  # a text that was whole would be broken
                    new = _swapped(text, pieces, raw, true)
                    lost = False
                else:
                    new = _step(pieces, true, wrong)
                    lost = new is not None and not marred and _BROKEN.search(new) is not None
                    if lost:
                        if true != "utf_8":
                            continue
                        # no accident: what had been lost, or C1 controls that another step may read
                        lost = "\ufffd" in new
                if new is not None and (lost or new not in nexts):
                    nexts[new] = (nexts[new][0] if new in nexts else (wrong, true), lost)
        self.stages[stage] = nexts
        return nexts

    def windows(self, stage: int, texts: list[str]) -> tuple:
        """``_of_many`` of those successors of a stage that are asked for."""
        if stage not in self.read or self.read[stage][0] != texts:
            self.read[stage] = texts, _of_many(texts)
        return self.read[stage][1]


_node = lru_cache(32)(_Node)


def search(text: str, model: Plausibility, max_expansions: int = MAX_EXPANSIONS) -> tuple[float, float, str, tuple, bool]:
    """Best-first search from a text: its own cost, the cheapest cost reached, that text, the steps to it, and whether
    whole bytes led to U+FFFD, so that characters were lost before.

    Every step costs 1, so that a text is changed only for a gain. Ties go to fewer steps. A text's successors are made in
    stages, and the search ends at the first that gives a text without rare windows for a gain of ``MARGIN``.
    """
    framed = folded(text)
    start = model.cost(framed)
    best = (start, 0, text, ())
    heap: list[tuple[float, float, int, str, tuple]] = [(start, *best)]
    visited = {text}
    n = 0
    lost = False
    damaged = _BROKEN.search(text) is not None
    while heap and n < max_expansions:
        _, cost, depth, now, path = heapq.heappop(heap)
        n += 1
        if depth >= 3:
            continue
        node = _node(now)
        for stage in range(len(_STAGES)):
            nexts = {}
            for new, (step, loses) in node.successors(stage).items():
                fresh = new not in visited
                lost |= loses and fresh
                if fresh or step[0] == "unescape":
                    nexts[new] = step
            visited.update(nexts)
            for (new, step), c in zip(nexts.items(), model.sums(node.windows(stage, list(nexts)), len(nexts)) + depth + 1 if nexts else ()):
                c = float(c)
                if c < best[0] and (damaged or not _BROKEN.search(new)):
                    best = (c, depth + 1, new, (*path, step))
                if c < start + SLACK:
                    # such texts are looked at first
                    sure = UTF8_BONUS * sum(map("\x7f".__lt__, new)) if step[1] == "utf_8" and "\ufffd" not in new else 0
                    heapq.heappush(heap, (c - sure, c, depth + 1, new, (*path, step)))
            # well-known text for a clear gain: no need to make the other successors
            if best[1] and start - best[0] >= MARGIN and not model.suspicious(folded(best[2])):
                return start, best[0], best[2], best[3], lost
    return start, best[0], best[2], best[3], lost


def nucleus(text: str) -> str:
    """A text without what can't matter: numbers become 0, and ASCII words that are no neighbours of other words go.

    The same steps restore the nucleus and the text, and many texts share one.
    """
    words = _DIGITS.sub("0", text).split(" ")
    if len(words) < 4:
        return " ".join(words)
    plain = [w.isascii() for w in words]
    keep = [not plain[i] or (i > 0 and not plain[i - 1]) or (i + 1 < len(words) and not plain[i + 1]) for i in range(len(words))]
    return " ".join(w for w, k in zip(words, keep) if k)


def mended_words(text: str, model: Plausibility) -> tuple[float, str, tuple]:
    """The text with some words read anew by one pair of single-byte charsets, where others are right as they are: the
    gain, the new text and the step. For texts of which a part was decoded rightly."""
    words = text.split(" ")
    odd = [i for i, w in enumerate(words) if not w.isascii()]
    best: tuple[float, str, tuple] = (0.0, text, ())
    if len(odd) < 2:
        return best
    old = model.all_costs([f" {words[i]} " for i in odd])
    total = model.cost(folded(text))
    for wrong in WRONG:
        if wrong not in _UP:
            continue
        pieces = [(p, _raw(p)) for i in odd for p in (_encoded(words[i], wrong),)]
        for true in TRUE:
            if true not in _UP or true == wrong:
                continue
            new = [_swapped(words[i], *p, true) or words[i] for i, p in zip(odd, pieces)]
            swap = {i: n for i, n, a, b in zip(odd, new, old, model.all_costs([f" {n} " for n in new])) if b < a - 1}
            if swap:
                out = " ".join(swap.get(i, w) for i, w in enumerate(words))
                gain = total - model.cost(folded(out)) - 1
                if gain > best[0]:
                    best = (gain, out, (("words", tuple((words[i], n) for i, n in swap.items())),))
    return best


def judged(text: str, model: Plausibility, escaped: bool = False) -> tuple[bool, str | None, tuple]:
    """Whether a text is garbled, its restored form (None: not garbled, or no better text can be reached), and the steps.

    ASCII texts are judged by what their escapes say; a U+FFFD escaped by itself, or an escaped control, is meant as such.
    """
    said = readable(text)
    escaped, text = escaped or said != text, said
    got = _judged(text, model, escaped, False)
    if model.distinct is not None and got[1] is None:
        again = _judged(text, model.distinct, escaped, True)
        got = again if again[1] is not None else (got[0] or again[0], None, ())
    return got


def _judged(text: str, model: Plausibility, escaped: bool, strict: bool) -> tuple[bool, str | None, tuple]:
    """``judged`` by one table of counts; ``strict`` asks for a corpus that speaks for the change, where texts count once."""
    framed = folded(text.replace("\ufeff", ""))
    broken = (_BROKEN_WORD if escaped else _BROKEN).search(text) is not None
    if escaped and not broken and _BROKEN.sub("", text).isascii():
        return False, None, ()
    traced = _TRACE.search(text) is not None
    if not broken and not traced and not model.suspicious(framed):
        return False, None, ()
    start, cost, new, path, lost = search(text.replace("\ufeff", ""), model)
    gain = start - cost
    if not broken and (gain < MARGIN or model.suspicious(folded(new))):
        gain, new, path = max((gain, new, path), mended_words(text.replace("\ufeff", ""), model), key=lambda x: x[0])
    nw = model.windows(folded(new))
    known = not len(nw) or float(np.mean(nw)) < 0.5 * (model.unseen + model.usual) + 0.5
    better = bool(path) and gain >= MARGIN and known and (broken or not strict or any(b == "utf_8" for _, b in path) or model.vouched(framed, folded(new)))
    found = broken or better or traced or lost or lossy_utf8(text)
    return found, (new if better else None), path if better else ()


class _Seen(dict):
    """Judgements by nucleus; it begins anew when its texts fill the memory meant for them."""

    chars = 0

    def keep(self, key: tuple[str, bool], found: tuple[bool, tuple]) -> None:
        if len(self) >= _CACHE or self.chars >= _CACHE_CHARS:
            self.clear()
            self.chars = 0
        self.chars += len(key[0])
        self[key] = found


_SEEN: dict[str, _Seen] = {}


def _seen(model: Plausibility) -> _Seen:
    """What this worker has judged by a model, in any of its tasks; one model's at a time."""
    if model.name not in _SEEN:
        _SEEN.clear()
        _SEEN[model.name] = _Seen()
    return _SEEN[model.name]


def _judge(model: Plausibility, column: str, key: str, lines: bool):

    def whole(text: str) -> tuple[bool, str | None]:
        parts = _PARTS.findall(text)
        if len(parts) == 1:
            return one(text)
        got = [one(x) for x in parts]
        fixed = any(new is not None for _, new in got)
        return any(g for g, _ in got), "".join(x if new is None else new for (_, new), x in zip(got, parts)) if fixed else None

    def one(text: str) -> tuple[bool, str | None]:
        seen = _seen(model)
        said = readable(text)
        escaped, text = said != text, said
        if text.isascii():
            return False, None
        k = text if escaped or _ESCAPE.search(text) else nucleus(text)
        if (k, escaped) not in seen:
            g, _, path = judged(k, model, escaped)
            seen.keep((k, escaped), (g, path))
        g, path = seen[k, escaped]
        if not path:
            return g, None
        for a, b in path:
            if a == "words":
                swap = dict(b)
                text = " ".join(swap.get(w, w) for w in text.split(" "))
                continue
            text = unescaped(text) if a == "unescape" else (_step(_encoded(text, a), b, a) or text)
        return g, text

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, text in zip(pdf[key], pdf[column]):
                if lines:
                    parts = [(whole(x) if not x.isascii() or _ESCAPE.search(x) else (False, None), x) for x in text.split("\n")]
                    if any(g for (g, _), _ in parts):
                        fixed = any(new is not None for (_, new), _ in parts)
                        out.append((k, "\n".join(x if new is None else new for (_, new), x in parts) if fixed else None))
                else:
                    g, new = whole(text)
                    if g:
                        out.append((k, new))
            yield pd.DataFrame(out, columns=["record_key", "restored"])

    return over


def _unusual(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).rlike(r"[^\x00-\x7f]|&#?[0-9A-Za-z]{2,8};|\\u[0-9a-fA-F]{4}"))


Table = tuple[str, DataFrame, str, str, bool]


def _texts(tables: list[Table]) -> list[tuple[str, DataFrame, bool]]:
    return [(n, df.select(F.col(k).cast("string").alias("k"), F.col(t).alias("t")).where("k is not null and t is not null"), lines) for n, df, k, t, lines in tables]


def source_model(tables: list[Table]) -> Plausibility:
    """The plausibility of characters by all texts of the tables, by rows and by distinct texts."""
    corpus = None
    for _, df, lines in _texts(tables):
        texts = _unusual(df.select(F.explode(F.split("t", "\n")).alias("t") if lines else "t"), "t")
        corpus = texts if corpus is None else corpus.unionByName(texts)
    # texts that differ in numbers, letter case and outer blanks only are one text; escapes keep their digits and case
    same = F.regexp_replace(F.lower(F.trim("t")), "[0-9]+", "0")
    texts = corpus.select(F.when(F.col("t").rlike(_ESCAPE.pattern), F.col("t")).otherwise(same).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    part = texts.mapInPandas(_count_both, "bucket long, n long, m long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).toPandas()
    counts = np.zeros((2, BUCKETS), np.int64)
    counts[:, part["bucket"].to_numpy(np.int64)] = part[["n", "m"]].to_numpy(np.int64).T
    return Plausibility(counts[0], counts[1])


def find_garbled(spark: SparkSession, tables: list[Table], model: Plausibility | None = None) -> DataFrame:
    """Garbled records of several tables: ``table_name, record_key, restored``, each record once.

    ``tables``: (name, DataFrame, key column, text column, whether to judge each line by itself). Null and empty texts and
    null keys are never garbled; texts of any length are read whole, in pieces; repeated rows count once if their texts agree (with
    different texts under one key, any garbled one counts, and the smallest restoration is given). ``restored`` is null
    where the characters do not allow a restoration. Without a model, the counts are taken over all the given texts.
    """
    model = model or source_model(tables)
    out = None
    for n, df, lines in _texts(tables):
        found = _unusual(df, "t").mapInPandas(_judge(model, "t", "k", lines), "record_key string, restored string")
        found = found.groupBy("record_key").agg(F.min("restored").alias("restored")).select(F.lit(n).alias("table_name"), "record_key", "restored")
        out = found if out is None else out.unionByName(found)
    return out
