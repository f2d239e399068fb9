"""Garbled text from wrong character encoding: found and, where nothing was lost, restored.

Adjacent character pairs are scored by mutual information over the whole corpus. Plain mutual information favours rare
pairs, and the two halves of a garbled letter only ever meet each other, so the pair's own frequency enters three times
(PMI cubed). Maximum-scoring segments of improbable pairs are cut out of each text; only inside them are inverse mappings
(encode with the wrong codec, decode with the true one) tried, and a mapping stands if the pairs it yields, with the
characters around, are much more probable than those it replaces. Garbling must not make itself probable: each distinct
text counts once, and passages that have the byte structure of UTF-8 throughout are no evidence of what is usual.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.tables import digest, small_side, spread

#: Pairs are counted in so many cells, code points in at most 0x110000: the model's size is bounded whatever the corpus.
CELLS = 1 << 20
#: A pair scores LINE - S: positive where it is less probable than the line (S in nats, see Model.score).
LINE = -14.0
#: What a character of plain ASCII between two odd pairs costs a segment.
GAP = 0.6
#: Least mean rise of S per pair for a mapping from UTF-8, whose byte structure is evidence already, and for any other.
RISE_UTF8, RISE_OTHER = 1.5, 5.0
#: The same where a mapping other than from UTF-8 explains only one kind of stretch in a text, and that has letters.
RISE_ALONE = 10.0
#: Times the same text may have been garbled.
DEPTH = 3
#: Codecs by which text is commonly misread, and those it was commonly written in.
WRONG = ["cp1252", "latin-1", "cp1251", "mac_roman", "cp437", "cp850", "cp1250", "iso8859-2", "koi8-r", "cp866", "iso8859-15"]
TRUE = ["utf-8", "cp1252", "cp1250", "cp1251", "iso8859-2", "koi8-r", "cp866", "cp850", "mac_roman"]

#: Of these, codecs whose bytes 80 to BF are hardly any letters.
PLAIN = {"cp1252", "latin-1", "iso8859-15"}

_WORD = re.compile(r"[^\x00-\x7f]+")
#: Latin letters and common marks; the same with the C1 range (misread twice) and other scripts in wide use.
_LATIN = re.compile("[\xa0-\u017f\u2010-\u203a\u20ac\u2122]")
_USUAL = re.compile("[\x80-\u017f\u2010-\u203a\u20ac\u2122\u0370-\u06ff\u3040-\u9fff\uac00-\ud7a3]+")


def _folding() -> np.ndarray:
    """Code point -> code point that stands for it: lower case, digits, blanks and ASCII marks taken together."""
    table = np.arange(0x110000, dtype=np.int64)
    for c in range(0x10000):
        low = chr(c).lower() if not 0xD800 <= c < 0xE000 else ""
        if len(low) == 1:
            table[c] = ord(low)
    for c in range(128):
        ch = chr(c)
        if ch.isdigit():
            table[c] = ord("0")
        elif ch.isspace():
            table[c] = 32
        elif not ch.isalpha():
            table[c] = ord(".")
    return table


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    return _folding()


def codes(text: str) -> np.ndarray:
    return folding()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def cell(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * 0x9E3779B1) ^ (b * 0x85EBCA77 >> 3) ^ (b << 7)) & (CELLS - 1)


@lru_cache(maxsize=200_000)
def structured(s: str) -> tuple[tuple[str, str], ...]:
    """(wrong codec, original) of every codec under which ``s`` has the byte structure of UTF-8 and is usual letters or marks."""
    out = []
    for wrong in WRONG:
        raw = _encode(s, wrong)
        if raw is None:
            continue
        try:
            was = raw.decode("utf-8")
        except UnicodeDecodeError:
            continue
        if _USUAL.fullmatch(was):
            out.append((wrong, was))
    return tuple(out)


def doubtful(text: str) -> list[tuple[int, int]]:
    """Stretches (start, end) that can be misread UTF-8 whatever their frequency, and so are no evidence of what is usual.

    A run of successive stretches beyond ASCII that all have its byte structure under one codec and give two or more
    characters, or all stretches of a text if they give one Latin letter or mark. Chance meetings such as ``’é`` stand
    beside stretches without that structure.
    """
    found = [(m.span(), dict(structured(m.group()))) for m in _WORD.finditer(text)]
    out: set[tuple[int, int]] = set()
    for wrong in {w for _, r in found for w in r}:
        run: list[tuple[int, int]] = []
        chars: set[str] = set()
        for span, r in [*found, ((0, 0), {})]:
            if wrong in r:
                run.append(span)
                chars.update(r[wrong])
                continue
            if len(chars) > 1 or (len(run) == len(found) and wrong in PLAIN and all(_LATIN.fullmatch(c) for c in chars)):
                out.update(run)
            run, chars = [], set()
    return sorted(out)


def count_pairs(texts: DataFrame, text: str = "text") -> DataFrame:
    """(kind, code, n) over all texts: kind 0 code points, kind 1 cells of pairs with a character beyond ASCII.

    Each distinct text counts once: a row weighs one by the number of its copies. Only digests are grouped for that.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        uni: dict[int, float] = {}
        pair = np.zeros(CELLS, dtype=np.float64)
        for b in batches:
            for t, weight in zip(b["text"], b["weight"]):
                # texts are counted with a blank on either side, so pairs never span two of them
                c = codes(f" {t} ")
                ok = np.ones(len(c), dtype=bool)
                for x, y in doubtful(t):
                    ok[x + 1 : y + 1] = False
                k, n = np.unique(c[ok], return_counts=True)
                for x, y in zip(k.tolist(), n.tolist()):
                    uni[x] = uni.get(x, 0.0) + y * weight
                odd = ((c[:-1] > 127) | (c[1:] > 127)) & ok[:-1] & ok[1:]
                if odd.any():
                    np.add.at(pair, cell(c[:-1][odd], c[1:][odd]), weight)
        if uni:
            at = np.nonzero(pair)[0]
            yield pd.DataFrame({"kind": 0, "code": list(uni), "n": list(uni.values())})
            yield pd.DataFrame({"kind": 1, "code": at, "n": pair[at]})

    d1, d2 = digest(F.col("text"))
    some = texts.select(F.col(text).alias("text")).filter("text <> ''").withColumns({"__d1": d1, "__d2": d2})
    copies = some.groupBy("__d1", "__d2").agg(F.count("*").alias("__n")).filter("__n > 1")
    weighed = some.join(small_side(copies), ["__d1", "__d2"], "left").select("text", (1.0 / F.coalesce("__n", F.lit(1))).alias("weight"))
    counts = weighed.mapInPandas(run, "kind int, code long, n double").groupBy("kind", "code")
    return counts.agg(F.round(F.sum("n"), 6).alias("n"))


@dataclass
class Model:
    unigrams: dict[int, float]
    cells: dict[int, float]

    def __post_init__(self):
        self.uni = np.zeros(0x110000, dtype=np.float32)
        self.uni[list(self.unigrams)] = list(self.unigrams.values())
        self.pair = np.zeros(CELLS, dtype=np.float32)
        self.pair[list(self.cells)] = list(self.cells.values())
        self.log_uni, self.log_pair = np.log(self.uni + 0.5), 3 * np.log(self.pair + 0.5)
        self.log_total = float(np.log(self.uni.sum() or 1.0))
        self.readings = lru_cache(maxsize=200_000)(self._readings)

    def score(self, c: np.ndarray) -> np.ndarray:
        """S of each adjacent pair: log of p(ab)^3 / p(a) p(b), half a count added; 0 for pairs of ASCII."""
        a, b = c[:-1], c[1:]
        s = self.log_pair[cell(a, b)] - self.log_uni[a] - self.log_uni[b] - self.log_total
        return np.where((a > 127) | (b > 127), s, 0.0)

    def mean(self, text: str) -> float:
        """Mean S of the pairs beyond ASCII; pairs of a text without any are as good as the best of them."""
        c = codes(text)
        odd = (c[:-1] > 127) | (c[1:] > 127)
        return float(self.score(c)[odd].mean()) if odd.any() else -8.0

    def _readings(self, left: str, s: str, right: str) -> tuple[tuple[tuple[str, str], str, float], ...]:
        """(mapping, original, rise) of every inverse mapping of ``s`` that makes the text much more probable."""
        old, out = self.mean(left + s + right), []
        for wrong, true, was in inverses(s):
            rise = self.mean(left + was + right) - old
            if rise >= (RISE_UTF8 if true == "utf-8" else RISE_OTHER):
                out.append(((wrong, true), was, rise))
        return tuple(out)


def fit(texts: DataFrame, text: str = "text") -> Model:
    rows = count_pairs(texts, text).toPandas()
    u, p = rows[rows["kind"] == 0], rows[rows["kind"] == 1]
    return Model(dict(zip(u["code"].tolist(), u["n"].tolist())), dict(zip(p["code"].tolist(), p["n"].tolist())))


def segments(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal scoring segments (start, end exclusive), in linear time."""
    kept: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum up to the end
    total = 0.0
    for i, s in enumerate(scores):
        before = total
        total += s
        if s <= 0:
            continue
        start, left = i, before
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= total:
                kept.append((start, i + 1, left, total))
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b) for a, b, _, _ in kept]


def suspicious(text: str, model: Model) -> list[tuple[int, int]]:
    """Stretches of characters beyond ASCII (start, end) that lie in an improbable segment."""
    c = codes(f" {text} ")
    odd = np.nonzero((c[:-1] > 127) | (c[1:] > 127))[0]
    if not len(odd):
        return []
    s = LINE - model.score(c)[odd]
    if not (s > 0).any():
        return []
    gaps = np.diff(odd, prepend=odd[0]) - 1
    gaps[0] = 0
    line: list[float] = []
    at: list[int] = []
    for g, v, o in zip(gaps.tolist(), s.tolist(), odd.tolist()):
        if g > 0:
            line.append(-GAP * g)
            at.append(-1)
        line.append(v)
        at.append(o)
    hit = np.zeros(len(c), dtype=bool)
    for a, b in segments(line):
        for k in range(a, b):
            if at[k] >= 0:
                hit[at[k] : at[k] + 2] = True
    return [(m.start(), m.end()) for m in _WORD.finditer(text) if hit[m.start() + 1 : m.end() + 1].any()]


def _encode(s: str, codec: str) -> bytes | None:
    """``s`` in ``codec``; code points of the C1 range stand for themselves where the codec leaves a byte open."""
    try:
        return s.encode(codec)
    except UnicodeEncodeError:
        if codec not in ("cp1252", "cp1250", "cp1251"):
            return None
    out = bytearray()
    for ch in s:
        try:
            out += ch.encode(codec)
        except UnicodeEncodeError:
            if not 0x80 <= ord(ch) < 0xA0:
                return None
            out.append(ord(ch))
    return bytes(out)


@lru_cache(maxsize=200_000)
def inverses(s: str) -> tuple[tuple[str, str, str], ...]:
    """(wrong, true, what ``s`` was) for every pair of codecs under which ``s`` can have come about; printable only."""
    found = {}
    for wrong in WRONG:
        raw = _encode(s, wrong)
        if raw is None:
            continue
        for true in TRUE:
            if true == wrong:
                continue
            try:
                was = raw.decode(true)
            except UnicodeDecodeError:
                continue
            if was == s:
                continue
            if true == "utf-8":
                # misread twice over: the step between is as improbable as the text itself, so both are taken at once
                for w2, t2, was2 in inverses(was):
                    if t2 == "utf-8" and w2 == wrong:
                        found.setdefault((was2, True), (f"{wrong} twice", true, was2))
            if all(ch == "\xa0" or ch.isprintable() or (true == "utf-8" and 0x80 <= ord(ch) < 0xA0) for ch in was):
                found.setdefault((was, true == "utf-8"), (wrong, true, was))
    return tuple(found.values())


@dataclass
class Finding:
    text: str
    mappings: list[str]
    rise: float
    lost: bool


def examine(text: str, model: Model) -> Finding | None:
    """What was garbled in ``text``; None if nothing. ``lost`` says that some of it cannot be had back."""
    used: list[str] = []
    best_rise, now = 0.0, text
    known: set[tuple[str, str]] = set()
    for _ in range(DEPTH):
        step = _restore(now, model, known)
        if step is None:
            break
        now, names, rise = step
        used += [n for n in names if n not in used]
        best_rise = max(best_rise, rise)
    lost = "�" in now or any(0x80 <= ord(ch) < 0xA0 and ch != "\x85" for ch in now)
    if not used and not lost:
        return None
    return Finding(now, used, best_rise, lost)


def _restore(text: str, model: Model, established: set[tuple[str, str]]) -> tuple[str, list[str], float] | None:
    spots = suspicious(text, model)
    if not spots and not established:
        return None
    options: list[dict[tuple[str, str], tuple[str, float]]] = []
    votes: dict[tuple[str, str], float] = {}
    seen: dict[tuple[str, str], dict[str, float]] = {}
    for a, b in spots:
        here = {m: (was, rise) for m, was, rise in model.readings(text[a - 1 : a] or " ", text[a:b], text[b : b + 1] or " ")}
        for m, (_, rise) in here.items():
            votes[m] = votes.get(m, 0.0) + rise * (b - a)
            seen.setdefault(m, {})[text[a:b]] = max(rise, seen.get(m, {}).get(text[a:b], 0.0))
        options.append(here)
    # one kind of stretch alone may be a rare but proper character
    sure = {m for m, kinds in seen.items() if m[1] == "utf-8" or len(kinds) > 1 or any(r >= RISE_ALONE and any(c.isalpha() or "\x80" <= c < "\xa0" for c in k) for k, r in kinds.items())}
    # only what is the best reading of some stretch stands for the text
    likely = [max(mine, key=lambda m: (votes[m], here[m][1], m)) for here in options if (mine := sure & here.keys())]
    established |= {m for m in likely if m[1] == "utf-8"}
    single = max((m for m in sure if m[1] != "utf-8"), key=lambda m: (votes[m], m), default=None)
    out, names, end, top = [], [], 0, 0.0
    known = dict(zip(spots, options))
    for w in _WORD.finditer(text):
        a, b = w.span()
        here = {m: v for m, v in known.get((a, b), {}).items() if m in sure}
        if not here:
            # where UTF-8 was misread once, whatever else has its byte structure under the same codec was misread too
            here = {(x, y): (was, 0.0) for x, y, was in inverses(w.group()) if (x, y) in established}
        if not here and single:
            # a mapping that stands for the text needs no more than some rise elsewhere in it
            left, right = text[a - 1 : a] or " ", text[b : b + 1] or " "
            for x, y, was in inverses(w.group()):
                if (x, y) == single and model.mean(left + was + right) > model.mean(left + w.group() + right):
                    here = {(x, y): (was, 0.0)}
        if not here:
            continue
        # the mapping that explains most of the text goes first, so that one passage is read in one way
        m = max(here, key=lambda k: (votes.get(k, 0.0), here[k][1], k))
        out += [text[end:a], here[m][0]]
        end, top = b, max(top, here[m][1])
        if (n := f"{m[1]} read as {m[0]}") not in names:
            names.append(n)
    return ("".join(out) + text[end:], names, top) if names else None


def garbled(texts: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, restored, mappings, rise, lost) of every text that is garbled wholly or in a part.

    restored is the text with all that could be had back. Null and empty texts and texts of plain ASCII have no row;
    whole texts are examined; a row delivered twice gives two equal rows. Other columns are ignored.
    """
    unigrams, cells = model.unigrams, model.cells

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = Model(unigrams, cells)
        for b in batches:
            found = [(i, f) for i, t in zip(b["doc_id"], b["text"]) if (f := examine(t, m)) is not None]
            if not found:  # an empty column of lists has no Arrow form
                continue
            yield pd.DataFrame({
                "doc_id": [i for i, _ in found], "restored": [f.text for _, f in found],
                "mappings": [f.mappings for _, f in found], "rise": [f.rise for _, f in found], "lost": [f.lost for _, f in found],
            })

    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return spread(rows, "doc_id").mapInPandas(run, f"doc_id {kind}, restored string, mappings array<string>, rise double, lost boolean")
