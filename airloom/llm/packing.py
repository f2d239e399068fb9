"""Filling containers of fixed capacity with texts measured in tokens.

Everything is planned on the global histogram of lengths, at most ``capacity`` numbers however many texts there are.
Dynamic programming puts bucket boundaries where padding up to the boundary is least. Token-budget batches form inside
each bucket, from the top one down: a batch is as many texts of its bucket as fit when every one is padded to the upper
end. What padding and rounding leave of the budget is topped up from the lower buckets, and from the batch's own bucket
where nothing lower fits. So the buckets decide which texts share a container. A plan row says which ranks of a length
go to which containers; texts get their rank in their length from salted counts, as many salts as the length has rows
for, so no length is ever gathered in one task.
"""

from __future__ import annotations

import base64
import bisect
import importlib
import importlib.util
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airloom.session import cut
from airloom.tables import spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
CAPACITY = 2_048
BUCKETS = 16
#: Texts of one length that one task ranks; a length with more of them is salted over as many tasks as that asks for.
RANKED = 500_000


@lru_cache(maxsize=2)
def _encoding(path: str):
    import sys

    import tiktoken

    folder = path.rsplit("/", 1)[0]
    spec = importlib.util.spec_from_file_location("tokenizer_files", f"{folder}/__init__.py")
    files = importlib.util.module_from_spec(spec)
    sys.modules["tokenizer_files"] = files
    spec.loader.exec_module(files)
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(texts: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every text that is neither missing nor empty; whole texts are measured."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoding(tokenizer)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "tokens": [len(enc.encode_ordinary(t)) for t in b["text"]]})

    rows = texts.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text <> ''")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return spread(rows, "doc_id").mapInPandas(count, f"doc_id {kind}, tokens long")


def pieces(counts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, n, token_start): a text over the capacity becomes full pieces and a rest, any other one piece."""
    full = F.floor((F.col("tokens") - 1) / capacity).cast("int")
    cut_up = counts.filter("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), full)).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return cut_up.select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - start).cast("int").alias("n"), start.alias("token_start"))


def boundaries(histogram: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper ends of at most ``buckets`` length buckets with the least padding; histogram[n] counts texts of n tokens."""
    lengths = np.nonzero(histogram)[0]
    if not len(lengths):
        return []
    c = histogram[lengths].astype(float)
    cum, weighted = np.concatenate([[0], np.cumsum(c)]), np.concatenate([[0], np.cumsum(c * lengths)])
    m, k = len(lengths), min(buckets, len(lengths))
    # cost[j] of covering the first j lengths; a bucket from i to j pads all its texts to lengths[j - 1]
    cost, choice = np.full(m + 1, np.inf), np.zeros((k + 1, m + 1), dtype=int)
    cost[0] = 0
    best, used = np.inf, k
    for b in range(1, k + 1):
        nxt = np.full(m + 1, np.inf)
        for j in range(1, m + 1):
            pad = cost[:j] + lengths[j - 1] * (cum[j] - cum[:j]) - (weighted[j] - weighted[:j])
            i = int(np.argmin(pad))
            nxt[j], choice[b, j] = pad[i], i
        cost = nxt
        if cost[m] < best:
            best, used = cost[m], b
    ends, j = [], m
    for b in range(used, 0, -1):
        ends.append(int(lengths[j - 1]))
        j = choice[b, j]
    return ends[::-1]


def plan(histogram: np.ndarray, ends: list[int], capacity: int = CAPACITY) -> tuple[pd.DataFrame, int]:
    """Containers for a histogram cut at ``ends``: rows (n, first_rank, ranks, per, container, home) and their number.

    Ranks first_rank .. first_rank + ranks - 1 of length n fill containers from ``container`` on, ``per`` in each;
    ``home`` is the bucket whose batch the container holds. One pattern is used as often as the counts allow, so two
    patterns at most use up a length, and the plan is bounded by the capacity and not by the number of texts.
    """
    left = histogram.astype(np.int64).copy()
    taken = np.zeros(len(left), dtype=np.int64)
    sizes = [int(x) for x in np.nonzero(left)[0]]
    rows: list[tuple[int, int, int, int, int, int]] = []
    containers = 0
    for bottom, top in list(zip([0, *ends], ends))[::-1]:
        batch = capacity // top
        while sizes and sizes[-1] > bottom:
            pattern: dict[int, int] = {}
            room, places = capacity, batch
            # the batch: the longest texts of the bucket, as many as fit at its padded length
            for s in reversed(sizes[bisect.bisect_right(sizes, bottom) :]):
                if n := min(places, int(left[s])):
                    pattern[s] = n
                    room, places = room - n * s, places - n
                if not places:
                    break
            # the rest of the budget: the longest that fit of the lower buckets, then of this one
            for low, high in ((0, bottom), (bottom, top)):
                at = bisect.bisect_right(sizes, min(room, high))
                while at and sizes[at - 1] > low:
                    at -= 1
                    s = sizes[at]
                    if n := min(room // s, int(left[s]) - pattern.get(s, 0)):
                        pattern[s] = pattern.get(s, 0) + n
                        room -= n * s
                    at = min(at, bisect.bisect_right(sizes, room))
            times = min(int(left[s]) // n for s, n in pattern.items())
            for s, n in pattern.items():
                rows.append((s, int(taken[s]), n * times, n, containers, top))
                taken[s] += n * times
                left[s] -= n * times
                if not left[s]:
                    sizes.pop(bisect.bisect_left(sizes, s))
            containers += times
    return pd.DataFrame(rows, columns=["n", "first_rank", "ranks", "per", "container", "home"]), containers


def pack(counts: DataFrame, capacity: int = CAPACITY, buckets: int = BUCKETS, ranked: int = RANKED) -> DataFrame:
    """(doc_id, piece, token_start, tokens, bucket, home_bucket, container_id) for (doc_id, tokens).

    ``bucket`` is the upper end of the text's own bucket, ``home_bucket`` that of the batch its container was made for.
    Each row is placed once, repeated rows too; rows without tokens take no part; no container holds more than
    ``capacity``. An empty table gives an empty result.
    """
    rows = cut(pieces(counts, capacity))
    sizes = rows.groupBy("n").agg(F.count("*").alias("c")).toPandas()  # at most capacity rows
    hist = np.zeros(capacity + 1, dtype=np.int64)
    hist[sizes["n"].to_numpy(dtype=int)] = sizes["c"].to_numpy(dtype=np.int64)
    ends = boundaries(hist, buckets)
    table, _ = plan(hist, ends, capacity)
    salts = np.maximum(1, -(-hist // ranked))
    split = F.get(F.lit([int(x) for x in salts]), F.col("n"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), split).cast("int"))
    # one number for each length and salt: at most capacity + rows / ranked of them
    parts = salted.filter(split > 1).groupBy("n", "salt").agg(F.count("*").alias("c")).toPandas() if (salts > 1).any() else None
    offsets = [np.zeros(int(k), dtype=np.int64) for k in salts]
    if parts is not None:
        for n, salt, c in zip(parts["n"].tolist(), parts["salt"].tolist(), parts["c"].tolist()):
            offsets[n][salt] = c
        offsets = [np.cumsum(o) - o for o in offsets]
    by_n = {
        int(n): tuple(g[c].to_numpy() for c in ("first_rank", "per", "container", "home")) for n, g in table.groupby("n", sort=False)
    }
    uppers = np.array(ends, dtype=np.int64)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n, salt, nth = b["n"].to_numpy(), b["salt"].to_numpy(), b["nth"].to_numpy()
            box, home = np.empty(len(b), dtype=np.int64), np.empty(len(b), dtype=np.int64)
            for size in np.unique(n):
                first, per, start, of = by_n[int(size)]
                mine = n == size
                rank = offsets[int(size)][salt[mine]] + nth[mine] - 1
                i = np.searchsorted(first, rank, side="right") - 1
                box[mine], home[mine] = start[i] + (rank - first[i]) // per[i], of[i]
            yield pd.DataFrame({
                "doc_id": b["doc_id"], "piece": b["piece"], "token_start": b["token_start"], "tokens": n,
                "bucket": uppers[np.searchsorted(uppers, n)], "home_bucket": home, "container_id": box,
            })

    w = Window.partitionBy("n", "salt").orderBy("doc_id", "piece")
    kind = counts.schema["doc_id"].dataType.simpleString()
    placed = salted.withColumn("nth", F.row_number().over(w))
    return placed.mapInPandas(place, f"doc_id {kind}, piece int, token_start long, tokens int, bucket int, home_bucket int, container_id long")
