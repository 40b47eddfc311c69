"""Problem 3: natural language in comments and string literals of source files, with its share of each file.

Pieces (comments, string literals) come from a lexer, one file at a time, inside Arrow batches. Each piece is cleaned of
marks, its escapes are read as characters, and it is cut into stretches of one script and sentence. A stretch is broken
into subwords of a public tokenizer vocabulary; the class with the largest posterior under per-class unigram counts is
its language, with code as a class of its own. The counts are taken over all labelled documents and over the code of all
source files by one distributed count; they are bounded by the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.tokens import TOKENIZERS, VOCABULARY, encoder, size

LANGS = ("en", "de", "fr", "es", "pt", "ru", "ja", "zh", "ko")
CLASSES = (*LANGS, "code")
CODE_PRIOR = 0.3
SMOOTHING = 0.1
SHARED = 0.1  # the share of the counts of all classes in each class's
MIN_WORDS = 4
MIN_CHARS = 8

_LEX = re.compile(
    r"""(?P<line>//(?:[^\\\n]|\\\r?\n|\\.)*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>\b(?:u8|[uUL])?R"(?P<d>[^()\\\s]{0,16})\(.*?\)(?P=d)")"""
    r"""|(?P<str>"(?:[^"\\\n]|\\\r?\n|\\.)*")|(?P<char>'(?:[^'\\\n]|\\.)+')""",
    re.S,
)
_ESCAPE = re.compile(r"((?:\\x[0-9a-fA-F]{1,2}|\\[0-7]{1,3})+)|\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})|\\(\r?\n)|\\(.)", re.S)
_BYTE = re.compile(r"\\x([0-9a-fA-F]{1,2})|\\([0-7]{1,3})")
_SIMPLE = {"n": "\n", "t": "\t", "r": " ", "v": " ", "f": " ", "a": " ", "b": " ", "0": " "}
_TAG = re.compile(r"[@\\](?:brief|param|return|returns|note|todo|file|see|author|date|warning|details|since|deprecated)\b(?:\s*\[[a-z,]*\])?", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_SCRIPT = re.compile("(?P<cjk>[぀-ヿ㐀-鿿豈-﫿々〆]+)|(?P<ko>[가-힣]+)|(?P<ru>[Ѐ-ӿ]+)|(?P<latin>[A-Za-zÀ-ɏ]+)")
_LATIN_WORD = re.compile(r"[A-Za-zÀ-ɏ]+(?:['’\-][A-Za-zÀ-ɏ]+)*[.,;:!?)\"”»…]*\Z")
_OTHER_WORD = re.compile("[Ѐ-ӿ가-힣]")
_HAN_KANA = re.compile("[぀-ヿ㐀-鿿々〆]")


def pieces(content: str) -> list[tuple[int, str, str, int, int]]:
    """(line, kind, inner text, from, to) of every comment and string literal, by position; lines end at ``\\n``."""
    out = []
    line, at = 1, 0
    for m in _LEX.finditer(content):
        kind = m.lastgroup if m.lastgroup != "d" else "raw"
        if m.group("raw") is not None:
            kind = "raw"
        line += content.count("\n", at, m.start())
        at = m.start()
        if kind == "char":
            continue
        text = m.group()
        if kind == "line":
            text = re.sub(r"\\\r?\n", " ", text[2:]).lstrip("/!<")
        elif kind == "block":
            body = text[2:-2] if text.endswith("*/") and len(text) >= 4 else text[2:]
            text = "\n".join(re.sub(r"^[ \t]*[*!<]+", "", x) for x in body.split("\n"))
        elif kind == "raw":
            text = text[text.index("(") + 1 : text.rindex(")")]
        else:
            text = unescaped(text[1:-1])
        out.append((line, kind, text, m.start(), m.end()))
    return out


def unescaped(text: str) -> str:
    """A literal's escapes as characters; runs of byte escapes are read as UTF-8."""

    def one(m: re.Match) -> str:
        if m.group(1):
            raw = bytes(int(h, 16) if h else int(o, 8) & 255 for h, o in _BYTE.findall(m.group(1)))
            return raw.decode("utf-8", "replace")
        if m.group(2) or m.group(3):
            n = int(m.group(2) or m.group(3), 16)
            return chr(n) if n < 0x110000 and not 0xD800 <= n < 0xE000 else " "
        if m.group(4):
            return ""
        return _SIMPLE.get(m.group(5), m.group(5))

    return _ESCAPE.sub(one, text)


def stretches(text: str) -> list[tuple[str, str]]:
    """(script, text) of what may be running text: one sentence or line and one script each, long enough to count.

    Sentences too short to count by themselves are taken together with those beside them in their script. Lines too short to count by themselves go on from the line before. Scripts: latin, ru, ko, cjk.
    """
    text = _TAG.sub("\n", text)
    lines: list[str] = []
    for x in text.replace("\r", "").split("\n"):
        x = x.strip()
        if not x:
            continue
        if lines and (not _counts(x) or not _counts(lines[-1])) and not re.search(r"[.!?。！？]\s*\Z", lines[-1]):
            lines[-1] += " " + x
        else:
            lines.append(x)
    out = []
    for x in lines:
        for sentence in _SENTENCE.split(x):
            if not sentence:
                continue
            begin, script, end = 0, None, 0
            runs: list[tuple[str, str]] = []
            for m in _SCRIPT.finditer(sentence):
                k = m.lastgroup or "latin"
                if k == "latin" and script in ("cjk", "ko", "ru") and m.end() - m.start() <= 12 and not re.match(r"\s+[A-Za-zÀ-ɏ]+\s+[A-Za-zÀ-ɏ]+", sentence[m.end() :]):
                    continue  # a name within another script's sentence
                if script is not None and k != script:
                    runs.append((script, sentence[begin : m.start()]))
                    begin = m.start()
                script, end = k, m.end()
            if script is not None:
                runs.append((script, sentence[begin:]))
            out.extend((k, t.strip()) for k, t in runs)
    return _joined(out)


def _joined(runs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Short stretches of a script on end as one; what is short still goes to the one of its script before it, else after it."""
    out: list[tuple[str, str]] = []
    for script in dict.fromkeys(k for k, _ in runs):
        grouped: list[list[str]] = []
        short = False
        for t in (t for k, t in runs if k == script):
            if (now := not _long(script, t)) and short:
                grouped[-1].append(t)
            else:
                grouped.append([t])
            short = now
        whole: list[str] = []
        first = ""
        for t in map(" ".join, grouped):
            if _long(script, t):
                whole.append(f"{first} {t}" if first else t)
                first = ""
            elif whole:
                whole[-1] += " " + t
            else:
                first = t
        out.extend((script, t) for t in whole if _long(script, t))
    return out


def _long(script: str, text: str) -> bool:
    if script == "cjk":
        return len(_HAN_KANA.findall(text)) >= MIN_CHARS
    if script == "latin":
        return sum(1 for w in text.split() if _LATIN_WORD.match(w.lstrip("(\"'“«¿¡"))) >= MIN_WORDS
    return sum(1 for w in text.split() if _OTHER_WORD.search(w)) >= MIN_WORDS


def _counts(line: str) -> bool:
    return any(_long(k, line) for k in ("latin", "cjk", "ru"))


class LanguageModel:
    """Log probabilities of subwords by class, and the class with the largest posterior for a text."""

    def __init__(self, counts: np.ndarray, folder: str, name: str):
        # mixed with the counts of all classes, so that a subword that a class lacks costs all classes the same, however much they hold
        every = counts.sum(axis=0) + SMOOTHING
        own = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
        self.logp = np.log((1 - SHARED) * own + SHARED * every / every.sum()).astype(np.float32)
        self.folder, self.name = folder, name
        prior = np.ones(len(CLASSES))
        prior[CLASSES.index("code")] = CODE_PRIOR
        self.prior = np.log(prior / prior.sum())

    def classes(self, items: list[tuple[str, str]]) -> list[str]:
        """The class of each (script, text): of all classes, whatever the script, the one with the largest posterior."""
        if not items:
            return []
        enc = encoder(self.folder, self.name)
        out = []
        for ids in enc.encode_ordinary_batch([" " + (t.lower() if t.isupper() else t) for _, t in items], num_threads=1):  # capitals are rare in all classes
            out.append(CLASSES[int((self.logp[:, ids].sum(axis=1) + self.prior).argmax())])
        return out


def _umlauts(text: str) -> str:
    """German as it is written without umlauts."""
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("Ä", "Ae"), ("Ö", "Oe"), ("Ü", "Ue"), ("ß", "ss")):
        text = text.replace(a, b)
    return text


def token_counts(docs: DataFrame, files: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> np.ndarray:
    """Subword counts by class over all labelled documents and the code of all files: classes × vocabulary.

    German counts once as written and once without umlauts. Each partition sums up before the shuffle.
    """
    v = size(folder, name)

    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(folder, name)
        total = np.zeros((len(CLASSES), v), np.int64)
        for pdf in batches:
            for cls, texts in pdf.groupby("cls")["text"]:
                k = CLASSES.index(cls)
                texts = list(texts)
                if cls == "code":
                    texts = [code_only(t) for t in texts]
                elif cls == "de":
                    texts += [_umlauts(t) for t in texts]
                for ids in enc.encode_ordinary_batch(texts, num_threads=1):
                    np.add.at(total[k], ids, 1)
        k, t = np.nonzero(total)
        if len(k):
            yield pd.DataFrame({"k": k.astype(np.int32), "t": t.astype(np.int32), "n": total[k, t]})

    low = F.lower(F.substring(F.trim("lang"), 1, 2))
    a = docs.where(F.col("text").isNotNull() & low.isin(*LANGS)).select(low.alias("cls"), "text")
    b = files.where(F.col("content").isNotNull()).select(F.lit("code").alias("cls"), F.col("content").alias("text"))
    part = a.unionByName(b).mapInPandas(over, "k int, t int, n long").groupBy("k", "t").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(CLASSES), v), np.int64)
    counts[part["k"].to_numpy(int), part["t"].to_numpy(int)] = part["n"].to_numpy(np.int64)
    return counts


def code_only(content: str) -> str:
    """A file's text without its comments and string literals."""
    return _LEX.sub(lambda m: m.group() if m.lastgroup == "char" else ' "" ' if m.group()[0] not in "/" else " ", content)


def _found(model: LanguageModel):
    def over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items: list[tuple[str, str]] = []
            where: list[tuple[str, int, str, int, int]] = []
            for path, content in zip(pdf["path"], pdf["content"]):
                for line, kind, text, a, b in pieces(content):
                    for script, t in stretches(text):
                        items.append((script, t))
                        where.append((path, line, kind, a, len(content)))
            rows = [(p, n, c, k, a, len(t), total) for (p, n, k, a, total), (_, t), c in zip(where, items, model.classes(items)) if c != "code"]
            yield pd.DataFrame(rows, columns=["path", "line_no", "lang", "kind", "at", "chars", "file_chars"])

    return over


def natural_language(files: DataFrame, docs: DataFrame, folder: str = TOKENIZERS, name: str = VOCABULARY) -> DataFrame:
    """Stretches of natural language: ``path, line_no, lang, kind, at, chars, file_chars``.

    One row per stretch: the line its piece opens on, the piece's kind (line, block, str, raw) and position, the stretch's
    and the file's length. Files without path or content have none; repeated rows of a path count once if their contents
    agree (every content counts otherwise). Whole files are read, of any length. Without documents of a language its class
    has the smoothing counts only.
    """
    texts = files.where(F.col("path").isNotNull() & F.col("content").isNotNull()).select("path", "content").dropDuplicates()
    model = LanguageModel(token_counts(docs, texts, folder, name), folder, name)
    return texts.mapInPandas(_found(model), "path string, line_no long, lang string, kind string, at long, chars long, file_chars long")


def language_shares(found: DataFrame) -> DataFrame:
    """``path, lang, pieces, chars, share``: each language's share of a file's characters."""
    return found.groupBy("path", "lang").agg(
        F.countDistinct("at").alias("pieces"), F.sum("chars").alias("chars"), (F.sum("chars") / F.max("file_chars")).alias("share")
    )
