"""Evaluation texts leaking into training text: rare n-gram seeds, then Smith-Waterman alignment of words.

The corpus is read and taken apart into words once, however many items there are. That pass lets through only the
n-grams of the items (by a Bloom filter of measured size, or all n-grams where the items have more than it may hold),
with the words around the places where enough of them lie together. What it let through gives the number of documents
each n-gram of the items occurs in; of every few successive n-grams of an item the rarest becomes a seed, so any run of
intact words holds one, however common its phrases are. Seeds join places to items on the hash of the n-gram, and where
several seeds of an item lie together the words around are aligned with it; insertions, edits, case, punctuation, layout
and markup cost little or nothing. No text is shuffled but these places.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.session import cut
from airloom.tables import SMALL_BYTES, small_side, spread

N = 3
#: Of so many successive n-grams of an item, the one in the fewest documents is a seed.
STRIDE = 4
#: Seeds of an item that must lie together for an alignment; half an item of 100 words has a dozen. Shorter ones
#: need as many as such a run of theirs surely has; one with fewer n-grams than SEEDS x STRIDE has all of them as seeds.
#: Items of so few words that the share asked for may hold no n-gram have shorter ones.
SEEDS = 3
#: Share of the item's words that a document must hold.
SHARE = 0.5
#: More words than this between two aligned ones, and they are not in one place.
PLACE = 20
MATCH, MISMATCH, SKIP_DOC, SKIP_ITEM = 1.0, -0.4, -0.3, -0.4
#: Bloom filter: bits for each n-gram, positions of each, and the most bytes it may take; beyond, none is used.
BITS, PROBES, FILTER_BYTES = 12, 4, 64 << 20

_MARKUP = re.compile(r"<[^<>]{1,200}>|&(?:#\d{1,6}|[A-Za-z]{2,8});")
_HIDDEN = re.compile("[­​-‏⁠﻿]")
def _combining(most: int) -> str:
    """The combining marks up to ``most`` as ranges of a character class."""
    marks = [c for c in range(most + 1) if unicodedata.combining(chr(c))]
    starts = [c for c in marks if not unicodedata.combining(chr(c - 1))]
    return "".join(f"{chr(a)}-{chr(next(c for c in range(a, most + 2) if c > most or not unicodedata.combining(chr(c))) - 1)}" for a in starts)


# one bitmap up to U+FFFF; what lies beyond is rare and looked at only where a text has it
_MARKS = re.compile(f"[{_combining(0xFFFF)}]+")
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐]\s*\n\s*(?=[^\W\d_])")
_WORDS = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """The words of a text without case, accents, punctuation, layout and markup."""
    t = _MARKUP.sub(" ", text)
    if not t.isascii():
        t = _HIDDEN.sub("", t)
        t = _MARKS.sub("", unicodedata.normalize("NFKD", t))
        if max(t) > "\uffff":
            t = "".join(c for c in t if c <= "\uffff" or not unicodedata.combining(c))
    if "-\n" in t or "‐" in t:
        t = _BROKEN.sub("", t)
    return _WORDS.findall(t.casefold())


class _Hashes(dict):
    """Word -> 64 bits, remembered; emptied when it has grown large."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def coded(ws: list[str], hashes: _Hashes) -> np.ndarray:
    return np.fromiter(map(hashes.__getitem__, ws), dtype=np.uint64, count=len(ws))


def grams(c: np.ndarray, n: int) -> np.ndarray:
    """64 bits for each ``n`` successive words."""
    if len(c) < n:
        return np.empty(0, dtype=np.uint64)
    out = np.full(len(c) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = (out ^ c[k : len(c) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def gram_size(words_: int, share: float) -> int:
    """N, or as many words as the share of a short item is sure to have."""
    return max(1, min(N, int(np.ceil(share * words_))))


def need(words_: int, share: float) -> int:
    """The least number of seeds in an intact run of the share asked for, SEEDS at most."""
    n = gram_size(words_, share)
    return min(SEEDS, max(1, (int(np.ceil(share * words_)) - n + 1) // STRIDE))


def _probes(g: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    step = (g >> np.uint64(33)) | np.uint64(1)
    for k in range(PROBES):
        yield (g + np.uint64(k) * step) % np.uint64(bits)


def _passes(g: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Positions in ``g`` of the n-grams that may be among the items'."""
    at = np.arange(len(g))
    for k in range(PROBES):
        p = (g[at] + np.uint64(k) * ((g[at] >> np.uint64(33)) | np.uint64(1))) % np.uint64(len(bloom) * 8)
        at = at[(bloom[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        if not len(at):
            break
    return at


def prepared(items: DataFrame, item_id: str, text: str, share: float) -> DataFrame:
    """(item_key, item_id, words, size, need) of every different item; size is that of its n-grams."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [words(t) for t in b["text"]]
            got = [(i, " ".join(w), len(w), gram_size(len(w), share), need(len(w), share)) for i, w in zip(b["item_id"], ws) if w]
            yield pd.DataFrame(got, columns=["item_id", "words", "m", "size", "need"])

    rows = items.select(F.col(item_id).alias("item_id"), F.col(text).alias("text")).filter("item_id is not null and text <> ''")
    out = rows.mapInPandas(run, f"item_id {kind}, words string, m int, size int, need int").distinct()
    return cut(out.withColumn("item_key", F.monotonically_increasing_id()))


def item_grams(items: DataFrame) -> DataFrame:
    """(item_key, pos, gram) of all n-grams of the items."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            for key, ws, size in zip(b["item_key"], b["words"], b["size"]):
                g = grams(coded(ws.split(" "), hashes), size)
                yield pd.DataFrame({"item_key": key, "pos": np.arange(len(g), dtype=np.int32), "gram": g.view(np.int64)})

    return cut(items.select("item_key", "words", "size").mapInPandas(run, "item_key long, pos int, gram long"))


def bloom_filter(table: DataFrame, most: int = FILTER_BYTES) -> np.ndarray | None:
    """The bits of all n-grams of ``table``, or None where they would take more than ``most`` bytes."""
    size = max(64, -(-table.count() * BITS // 8))
    if size > most:
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bloom = np.zeros(size, dtype=np.uint8)
        for b in batches:
            for p in _probes(b["gram"].to_numpy().view(np.uint64), size * 8):
                np.bitwise_or.at(bloom, (p >> np.uint64(3)).astype(np.int64), np.uint8(1) << (p & np.uint64(7)).astype(np.uint8))
        yield pd.DataFrame({"bits": [bloom.tobytes()]})

    out = np.zeros(size, dtype=np.uint8)
    for r in table.select("gram").coalesce(8).mapInPandas(run, "bits binary").toLocalIterator():  # at most 8 rows of ``size`` bytes
        out |= np.frombuffer(r["bits"], dtype=np.uint8)
    return out


def _scan(rows: DataFrame, bloom: np.ndarray | None, sizes: list[int], margin: int, least: int) -> DataFrame:
    """(doc_id, seen, places): the one pass over the corpus.

    ``seen`` are the document's different n-grams that the filter lets through. A place is a run of at least ``least``
    of them no more than ``margin`` words apart, with ``margin`` words on either side: (first word's number, words,
    position and hash of each n-gram). Documents without any have no row.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    shared = None if bloom is None else rows.sparkSession.sparkContext.broadcast(bloom)  # FILTER_BYTES at most

    def places(ws: list[str], at: np.ndarray, g: np.ndarray) -> list[dict]:
        out = []
        for part in np.split(np.arange(len(at)), np.nonzero(np.diff(at) > margin)[0] + 1):
            if len(part) < least or len(np.unique(g[part])) < least:
                continue
            lo = max(0, int(at[part[0]]) - margin)
            out.append({"first": lo, "words": " ".join(ws[lo : int(at[part[-1]]) + margin + N]), "at": (at[part] - lo).astype(np.int32), "gram": g[part].view(np.int64)})
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _Hashes()
        for b in batches:
            ids, seen, found = [], [], []
            for doc, t in zip(b["doc_id"], b["text"]):
                ws = words(t)
                c = coded(ws, hashes)
                at, g = [], []
                for n in sizes:
                    all_ = grams(c, n)
                    k = np.arange(len(all_)) if shared is None else _passes(all_, shared.value)
                    at.append(k)
                    g.append(all_[k])
                at, g = np.concatenate(at), np.concatenate(g)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                at, g = at[order], g[order]
                ids.append(doc)
                seen.append(np.unique(g).view(np.int64))
                found.append(places(ws, at, g))
            if ids:
                yield pd.DataFrame({"doc_id": pd.Series(ids), "seen": seen, "places": found})

    return rows.mapInPandas(run, f"doc_id {kind}, seen array<long>, places array<struct<first: long, words: string, at: array<int>, gram: array<long>>>")


def seeds(table: DataFrame, frequency: DataFrame) -> DataFrame:
    """The n-grams of ``table`` that are seeds: the rarest of every STRIDE successive ones of an item, the first of equals; of short items all.

    Rare is what few documents hold, and of equals what few items hold.
    """
    rare = table.groupBy("gram").agg(F.count("*").alias("items")).join(frequency, "gram", "left")
    known = table.join(rare, "gram").select("item_key", "pos", "gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "items", "pos").alias("rare"))
    item = Window.partitionBy("item_key").orderBy("pos")
    last = F.max("pos").over(item.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    known = known.withColumn("last", last).withColumn("best", F.min("rare").over(item.rowsBetween(0, STRIDE - 1))["pos"])
    # the windows of STRIDE n-grams that hold this one begin with it or up to STRIDE - 1 before it
    whole = F.when(F.col("pos") <= F.greatest(F.lit(0), F.col("last") - STRIDE + 1), F.col("best"))
    picked = F.array_contains(F.collect_list("whole").over(item.rowsBetween(1 - STRIDE, 0)), F.col("pos"))
    known = known.withColumn("whole", whole).withColumn("picked", picked)
    return known.filter(F.col("picked") | (F.col("last") + 1 < SEEDS * STRIDE)).select("item_key", "pos", "gram")


def _alike(a: str, b: str) -> bool:
    """Equal up to small edits: one for words of four letters or more, two for eight or more."""
    if a == b:
        return True
    n = max(len(a), len(b))
    limit = 2 if n >= 8 else 1 if n >= 4 else 0
    if not limit or abs(len(a) - len(b)) > limit or a.isdigit() or b.isdigit():
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1] <= limit


def align(item: list[str], item_code: np.ndarray, doc: list[str], doc_code: np.ndarray) -> tuple[int, int, int]:
    """(item words held, first, last doc word) of the best local alignment that lies in one place."""
    m, n = len(item_code), len(doc_code)
    h = np.zeros((m + 1, n + 1), dtype=np.float64)
    ramp = SKIP_DOC * np.arange(n + 1)
    for i in range(1, m + 1):
        step = np.where(doc_code == item_code[i - 1], MATCH, MISMATCH)
        row = np.maximum(h[i - 1] + SKIP_ITEM, 0.0)
        row[1:] = np.maximum(row[1:], h[i - 1, :-1] + step)
        h[i] = np.maximum.accumulate(row - ramp) + ramp
    i, j = (int(x) for x in np.unravel_index(int(np.argmax(h)), h.shape))
    best, held, end, last = (0, 0, 0), 0, j - 1, j - 1
    while i > 0 and j > 0 and h[i, j] > 1e-9:
        if abs(h[i, j] - (h[i - 1, j - 1] + (MATCH if doc_code[j - 1] == item_code[i - 1] else MISMATCH))) < 1e-9:
            if doc_code[j - 1] == item_code[i - 1] or _alike(doc[j - 1], item[i - 1]):
                if held and last - (j - 1) > PLACE:
                    best, held, end = max(best, (held, last, end)), 0, j - 1
                held, last = held + 1, j - 1
            i, j = i - 1, j - 1
        elif abs(h[i, j] - (h[i - 1, j] + SKIP_ITEM)) < 1e-9:
            i -= 1
        else:
            j -= 1
    return max(best, (held, last, end))


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the seeds of an item in a place those runs that hold enough of them: (place, item_key, lo, hi) in words."""
    for b in batches:
        out = []
        for place, key, size, least, hits in zip(b["place"], b["item_key"], b["m"], b["need"], b["hits"]):
            dd = np.array([h["at"] for h in hits], dtype=np.int64)
            pp = np.array([h["pos"] for h in hits], dtype=np.int64)
            order = np.argsort(dd, kind="stable")
            dd, pp = dd[order], pp[order]
            for part in np.split(np.arange(len(dd)), np.nonzero(np.diff(dd) > size + PLACE)[0] + 1):
                if len(np.unique(pp[part])) >= least:
                    out.append((place, key, max(0, int(dd[part[0]]) - size - PLACE), int(dd[part[-1]]) + N + size + PLACE))
        yield pd.DataFrame(out, columns=["place", "item_key", "lo", "hi"])


def _aligned(share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc, item, first, text, passage in zip(b["doc_id"], b["item_id"], b["first"], b["words"], b["item_words"]):
                ws, iw = text.split(" "), passage.split(" ")
                number = {w: k for k, w in enumerate(dict.fromkeys(iw))}
                codes = [np.array([number.get(w, -1) for w in x], dtype=np.int64) for x in (iw, ws)]
                held, a, z = align(iw, codes[0], ws, codes[1])
                if held >= share * len(iw):
                    out.append((doc, item, held, held / len(iw), first + a, first + z))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "held", "share", "first_word", "last_word"])

    return run


def _passages(known: DataFrame, size: int) -> DataFrame:
    side = known.select("item_key", "item_id", F.col("words").alias("item_words"))
    return F.broadcast(side) if size <= SMALL_BYTES else side


def leaks(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    share: float = SHARE, filter_bytes: int = FILTER_BYTES,
) -> DataFrame:
    """(doc_id, item_id, held, share, first_word, last_word): documents that hold at least ``share`` of an item's words.

    One row per pair, for the place that holds most. Missing and empty texts hold nothing, items without any word are
    none; an item of one or two words is held by one of them. Repeated rows count once. Whole texts are searched, of any
    length. Extra columns are ignored. No documents or no items give an empty result.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text <> ''")
    kind, ikind = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {ikind}, held long, share double, first_word long, last_word long"
    known = prepared(items, item_id, item_text, share)
    facts = known.agg(F.max("m").alias("m"), F.min("need").alias("need"), F.collect_set("size").alias("sizes"), F.sum(F.octet_length("words")).alias("bytes")).first()
    if facts["m"] is None:
        return docs.sparkSession.createDataFrame([], schema)
    table = item_grams(known)
    scanned = cut(_scan(spread(rows, "doc_id"), bloom_filter(table, filter_bytes), sorted(facts["sizes"]), facts["m"] + PLACE, facts["need"]))
    frequency = scanned.select(F.explode("seen").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    chosen = cut(seeds(table, frequency))
    places = scanned.select("doc_id", F.explode("places").alias("p")).select("doc_id", "p.*").withColumn("place", F.monotonically_increasing_id())
    met = places.select("place", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("place", "h.at", "h.gram").join(small_side(chosen), "gram")
    enough = met.groupBy("place", "item_key").agg(F.count_distinct("pos").alias("k"), F.collect_list(F.struct("at", "pos")).alias("hits"))
    enough = enough.join(small_side(known.select("item_key", "m", "need")), "item_key").filter("k >= need")
    # only the words around a run of seeds go to the alignment
    runs = enough.mapInPandas(_runs, "place long, item_key long, lo int, hi int").join(_passages(known, facts["bytes"]), "item_key")
    around = F.array_join(F.slice(F.split("words", " "), F.col("lo") + 1, F.col("hi") - F.col("lo")), " ")
    pairs = runs.join(places.select("place", "doc_id", "first", "words"), "place").select("doc_id", "item_id", (F.col("first") + F.col("lo")).alias("first"), around.alias("words"), "item_words")
    best = F.max(F.struct("held", "share", "first_word", "last_word"))
    # few bytes but much work each: spread by number, which adaptive execution leaves as it is
    spark = docs.sparkSession
    pairs = pairs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "doc_id", "item_id")
    found = pairs.mapInPandas(_aligned(share), schema)
    return found.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.*")
