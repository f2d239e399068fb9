"""Matching entities across sources without keys: sorted neighbourhood, weighted similarities, best assignment.

Both tables go into one stream under several composite sort keys (name, name backwards, ident, and twice the position,
in a form that swapped or sign-flipped coordinates do not change). The stream is range-partitioned and sorted; a window
slides over it, so each record meets the WINDOW entities before and after it under every key. Only ids of entities count
for the window, so a crowd of records or of revisions of one entity does not push others out, and partitions hand their
edges on, so no pair is lost between two of them. Rows of a name that more than WINDOW entities have are also sorted by
name and elevation, with and without country, and by name and position without country. Names, positions, elevations, countries, kinds and idents are compared with weights; records that share an
ident within their own source are judged together.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airloom.session import cut
from airloom.tables import small_side

WINDOW = 8
#: Rows of the sorted stream in a partition. There are at most MAX_PARTS, so the rows on their borders, which go to all
#: workers, are at most 2 x WINDOW x MAX_PARTS times the revisions of an entity; beyond that size partitions grow instead.
PART_ROWS, MAX_PARTS = 60_000, 5_000
#: Pairs filtered by distance at once in a sweep, for memory.
CHUNK = 500_000
#: Least confidence of a pair to be kept as evidence, and least mean of a group to be a match.
EVIDENCE, ACCEPT = 0.55, 0.72

#: Short forms in names.
SHORT = {
    "n": "north", "s": "south", "e": "east", "w": "west", "ft": "fort", "st": "saint", "ste": "saint", "mt": "mount", "lk": "lake",
}
#: Words that stand before many place names; they are compared first, whatever their order.
BEFORE = {"north", "south", "east", "west", "fort", "saint", "mount", "lake", "old", "new", "port", "upper", "lower"}
#: Words for any aerodrome, for heliports, and for aerodromes of a special use.
FACILITY = {
    "airport", "arpt", "apt", "ap", "aerodrome", "aerodrom", "ad", "airfield", "field", "fld", "airstrip", "strip", "as", "regional", "regl",
    "reg", "rgnl", "municipal", "muni", "mun", "international", "intl", "int", "internat", "aeroport",
}
HELI = {"heliport", "helipad", "hp", "hel"}
SPECIAL = {"quarry", "glider", "hospital", "seaplane", "base", "farm", "ranch", "military", "ultralight", "balloonport"}
_LONG = sorted(w for w in FACILITY | HELI | SPECIAL if len(w) >= 6)
#: Letters that do not come apart into a base letter and an accent.
LETTERS = str.maketrans({"ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ß": "ss", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D"})


def fold(s: str) -> str:
    if s.isascii():
        return s.lower()
    t = unicodedata.normalize("NFKD", s.translate(LETTERS))
    return "".join(c for c in t if not unicodedata.combining(c)).lower()


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, change, swap of neighbours) between two words, or most + 1 if there are more.

    One column of the table of edits is two bit vectors, of the cells that are one more and one less than those above
    them, so a letter of ``b`` costs a few operations on whole numbers however long ``a`` is.
    """
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not a or not b:
        return min(len(a) + len(b), most + 1)
    # an edit does away with one letter that the other word lacks
    x, y = set(a), set(b)
    if len(x - y) > most or len(y - x) > most:
        return most + 1
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    more, less, diagonal, met_before, edits = whole, 0, 0, 0, len(a)
    for y in b:
        met = at.get(y, 0)
        swapped = ((~diagonal & met) << 1) & met_before
        diagonal = (((met & more) + more) ^ more) | met | less | swapped
        up, down = less | ~(diagonal | more), diagonal & more
        edits += bool(up & last) - bool(down & last)
        up, down = up << 1 | 1, down << 1
        more, less = (down | ~(diagonal | up)) & whole, up & diagonal & whole
        diagonal &= whole
        met_before = met
    return min(edits, most + 1)


@lru_cache(maxsize=100_000)
def _word(w: str) -> str:
    """A word as its long form; a long facility word with one or two slips becomes that word."""
    if w in SHORT:
        return SHORT[w]
    if len(w) >= 6 and w not in FACILITY and w not in HELI:
        for f in _LONG:
            if distance(w, f, 2 if len(f) > 8 else 1) <= (2 if len(f) > 8 else 1):
                return f
    return w


def name_parts(name: str | None) -> tuple[tuple[str, ...], bool, tuple[str, ...]]:
    """(place names that the name gives, whether it is a heliport, special uses)."""
    t = fold(name or "").replace("a/p", "airport").replace("int'l", "international").replace("'", "")
    heli, special, places = False, set(), []
    for part in re.split(r"[/()]", t):
        core = []
        for w in map(_word, re.findall(r"[a-z0-9]+", part)):
            if w in HELI:
                heli = True
            elif w in SPECIAL:
                special.add(w)
            elif w not in FACILITY:
                core.append(w)
        if core:
            places.append("".join([*sorted(w for w in core if w in BEFORE), *(w for w in core if w not in BEFORE)]))
    return tuple(dict.fromkeys(places)), heli, tuple(sorted(special - {"base"}))


def place_similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Of the most similar pair of place names: 1 - edits / length."""
    best = 0.0
    for x in a:
        for y in b:
            n = max(len(x), len(y))
            best = max(best, 1 - distance(x, y, max(1, int(n * 0.45))) / n)
    return best


def _features(b: pd.DataFrame) -> pd.DataFrame:
    parts = [name_parts(n) for n in b["name"]]
    town = [name_parts(m)[0] for m in b["municipality"]]
    lat, lon = b["lat"].to_numpy(dtype=float), b["lon"].to_numpy(dtype=float)
    bad = ~(np.isfinite(lat) & np.isfinite(lon) & (np.abs(lat) <= 180) & (np.abs(lon) <= 180)) | ((lat == 0) & (lon == 0))
    lat, lon = np.where(bad, np.nan, lat), np.where(bad, np.nan, lon)
    ident = [re.sub(r"[^0-9a-z]", "", fold(i or "")) for i in b["ident"]]
    heli = [h or (not p and t == "heliport") for (p, h, _), t in zip(parts, b["kind"])]
    return pd.DataFrame({
        "entity": b["entity"], "id": b["id"], "ident": ident, "places": [list(p) for p, _, _ in parts], "town": [list(t) for t in town],
        "heli": heli, "typed_heli": (b["kind"] == "heliport").to_numpy(), "special": [list(s) for _, _, s in parts],
        "lat": lat, "lon": lon, "elevation": b["elevation"].to_numpy(dtype=float), "country": [fold(c).strip() if c else "" for c in b["country"]],
    })


_FEATURES = (
    "entity boolean, id long, ident string, places array<string>, town array<string>, heli boolean, typed_heli boolean, special array<string>, "
    "lat double, lon double, elevation double, country string"
)


def _stream(rows: DataFrame) -> DataFrame:
    """Each row once under every sort key that it has a value for; rows of a crowded name have finer keys too."""
    first = F.get("places", F.lit(0))
    crowd = rows.filter("entity").select(first.alias("__first"), "id").filter("__first is not null").groupBy("__first").agg(F.count_distinct("id").alias("n"))
    crowd = small_side(crowd.filter(F.col("n") > WINDOW).select("__first", F.lit(True).alias("__crowd")))
    rows = rows.withColumn("__first", first).join(crowd, "__first", "left").drop("__first")
    far, near = F.greatest(F.abs("lat"), F.abs("lon")), F.least(F.abs("lat"), F.abs("lon"))
    there = ~F.isnan("lat")
    pad = lambda c, digits=6: F.lpad(c.cast(f"decimal(20,{digits})").cast("string"), 12, "0")
    tie = F.when(there, F.concat_ws("|", "country", pad(far), pad(near))).otherwise(F.col("country"))

    def strip(shift: float):
        return F.when(there, F.concat_ws("|", F.lpad(F.floor((far + shift) / 0.2).cast("string"), 6, "0"), pad(near)))

    keys = [
        F.concat_ws("|", first, tie), F.concat_ws("|", F.reverse(first), tie), F.when(F.col("ident") != "", F.concat_ws("|", "ident", tie)), strip(0.0), strip(0.1),
    ]
    keys[0], keys[1] = F.when(first.isNotNull(), keys[0]), F.when(first.isNotNull(), keys[1])
    # what the record says may be feet or metres, so it stands at each height that it can mean
    for times in (1.0, 3.28084, 1 / 3.28084):
        mine = F.col("__crowd") & ~F.isnan("elevation") & F.col("elevation").between(-2000, 30_000) & (F.lit(times == 1.0) | ~F.col("entity"))
        feet = pad(F.col("elevation") * times + 10_000, 3)
        keys += [F.when(mine, F.concat_ws("|", first, feet, tie)), F.when(mine & (F.col("country") != ""), F.concat_ws("|", first, "country", feet, tie))]
    keys += [F.when(F.col("__crowd") & there, F.concat_ws("|", first, strip(shift))) for shift in (0.0, 0.1)]
    ways = [0, 1, 2, 3, 4, 5, 6, 5, 6, 5, 6, 7, 8]
    each = F.array_compact(F.array(*[F.when(k.isNotNull(), F.struct(F.lit(i).alias("way"), k.alias("key"))) for i, k in zip(ways, keys, strict=True)]))
    return rows.select("*", F.explode(each).alias("__k")).select("*", "__k.way", "__k.key").drop("__k", "__crowd")


EARTH_KM = 6371.0088


def _km(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    a, b, c, d = (np.radians(x) for x in (a, b, c, d))
    h = np.sin((a - c) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((b - d) / 2) ** 2
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.clip(h, 0, 1)))


def _coarse(x: float) -> float:
    """Kilometres that the last digit of a coordinate may hide: of tenths and minutes more than of finer ones."""
    for step, km in ((1.0, 80.0), (0.5, 40.0), (0.1, 9.0), (1 / 60, 2.0)):
        if abs(x / step - round(x / step)) < 2e-4 / step * 0.05:
            return km
    return 0.0


def _name_score(places_e: tuple, places_r: tuple, town_e: tuple, town_r: tuple) -> float:
    """How alike the names are, from 0 to 1, helped by the towns; -1 where they are too different for any pair."""
    s = max(place_similarity(places_e, places_r), 0.9 * place_similarity(places_e, town_r) if not places_r else 0.0)
    if s < 0.6:
        return -1.0
    name = min(1.0, max(0.0, (s - 0.5) / 0.4))
    if s < 0.8 and town_e and town_r:
        name = max(name, 0.8 * min(1.0, max(0.0, (place_similarity(town_e, town_r) - 0.5) / 0.4)))
    return name


def _coded(values: list) -> np.ndarray:
    """A number for each value, equal ones alike."""
    known: dict = {}
    return np.array([known.setdefault(v, len(known)) for v in values], dtype=np.int64)


class Things:
    """Entities and records as columns, and the confidence of any pairs of them."""

    def __init__(self, rows: pd.DataFrame):
        self.lat, self.lon = rows["lat"].to_numpy(dtype=float), rows["lon"].to_numpy(dtype=float)
        self.elevation = rows["elevation"].to_numpy(dtype=float)
        self.heli, self.typed = rows["heli"].to_numpy(dtype=bool), rows["typed_heli"].to_numpy(dtype=bool)
        self.places, self.towns = ([tuple(x) for x in rows[c]] for c in ("places", "town"))
        ident, country = rows["ident"].tolist(), rows["country"].tolist()
        self.ident, self.has_ident = _coded(ident), np.array([bool(x) for x in ident], dtype=bool)
        self.country, self.has_country = _coded(country), np.array([bool(x) for x in country], dtype=bool)
        self.special = _coded([tuple(x) for x in rows["special"]])
        self.place_code, self.town_code = _coded(self.places), _coded(self.towns)
        self.spread = np.array([max(_coarse(a), _coarse(b)) if abs(a) <= 90 else 0.0 for a, b in zip(self.lat.tolist(), self.lon.tolist())])

    def distances(self, e: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(km, least km with the record's coordinates swapped or a sign flipped).

        km is NaN where either has no position. The second is worked out where it can be under 5 km, which takes the
        entity's latitude to be within 0.05 degrees of one of the record's coordinates but for the sign; else infinite.
        """
        a, b, c, d = self.lat[e], self.lon[e], self.lat[r], self.lon[r]
        turned = np.full(len(e), np.inf)
        can = np.nonzero(np.minimum(np.abs(np.abs(a) - np.abs(c)), np.abs(np.abs(a) - np.abs(d))) <= 0.05)[0]
        p, q, x, y = a[can], b[can], c[can], d[can]
        turned[can] = np.fmin.reduce([_km(p, q, u, v) for u, v in ((y, x), (-x, y), (x, -y), (-x, -y), (y, -x), (-y, x))]) if len(can) else np.inf
        return _km(a, b, c, d), turned

    def confidence(self, e: np.ndarray, r: np.ndarray, km: np.ndarray, turned: np.ndarray, least: float = 0.0) -> np.ndarray:
        """How sure it is that entities ``e`` and records ``r`` are the same things, from 0 to 1; 0 for what is under ``least``.

        Weights: name 0.4, position 0.3, elevation 0.15, ident 0.15; a missing value counts half. Kinds or special uses
        that differ, or another country, each take away. All but the names is worked out for whole columns; names are
        compared only where the rest lets a pair reach ``least``, and once for every two different names.
        """
        beyond = np.clip(1.25 - (km - self.spread[r]) / 4.0, 0.0, 1.0)
        place = np.where(km > self.spread[r], beyond, 1.0)
        place = np.where((place < 0.7) & (turned <= 3.0), 0.75, place)
        place = np.where(np.isnan(km), 0.5, place)
        he, hr = self.elevation[e], self.elevation[r]
        gap = np.fmin.reduce([np.abs(he - hr), np.abs(he - hr * 3.28084) + 3, np.abs(he - hr / 3.28084) + 3])
        unknown = ~(np.isfinite(he) & np.isfinite(hr)) | ~((hr >= -2000) & (hr <= 30_000))
        high = np.where(unknown, 0.5, np.where(gap <= 20, 1.0, np.where(gap <= 40, 0.6, 0.0)))
        same = self.has_ident[e] & self.has_ident[r] & (self.ident[e] == self.ident[r])
        rest = 0.3 * place + 0.15 * high + 0.15 * np.where(same, 1.0, 0.5)
        differ = self.heli[e] != self.heli[r]
        firm = self.heli[r] | self.heli[e] | (self.typed[r] == self.typed[e])
        off = 0.35 * (self.special[e] != self.special[r]) + np.where(differ, np.where(firm, 0.35, 0.1), 0.0)
        off = off + 0.1 * (~self.heli[e] & ~self.heli[r] & (self.typed[e] != self.typed[r])) + 0.15 * (high == 0.0) + 0.3 * (place == 0.0)
        off = off + 0.2 * (self.has_country[e] & self.has_country[r] & (self.country[e] != self.country[r]))
        out = np.zeros(len(e))
        can = np.nonzero(np.minimum(1.0, (0.4 + rest) / 0.925) - off >= least)[0]
        if not len(can):
            return out
        kinds = np.stack([self.place_code[e[can]], self.place_code[r[can]], self.town_code[e[can]], self.town_code[r[can]]], axis=1)
        _, first, back = np.unique(kinds, axis=0, return_index=True, return_inverse=True)
        names = np.array([_name_score(self.places[i], self.places[j], self.towns[i], self.towns[j]) for i, j in zip(e[can][first].tolist(), r[can][first].tolist())])[back.reshape(-1)]
        total = np.minimum(1.0, (0.4 * names + rest[can]) / 0.925) - off[can]
        total = np.where(names < 0, 0.0, np.maximum(0.0, total))
        out[can] = np.where(total >= least, total, 0.0)
        return out


def _outermost(rows: pd.DataFrame, last: bool) -> pd.DataFrame:
    """The first (or last) rows that hold WINDOW different ids."""
    ids = rows["id"][::-1] if last else rows["id"]
    return rows[((~ids.duplicated()).cumsum() <= WINDOW).reindex(rows.index)]


def _spans(ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each gap of ``ids``: where WINDOW different ids before it start, and where WINDOW different ids after it end."""

    def starts(line: list[int]) -> list[int]:
        n: dict[int, int] = {}
        out, lo = [0], 0
        for k, x in enumerate(line, 1):
            n[x] = n.get(x, 0) + 1
            while len(n) > WINDOW:
                y = line[lo]
                n[y] -= 1
                if not n[y]:
                    del n[y]
                lo += 1
            out.append(lo)
        return out

    return np.array(starts(ids)), len(ids) - np.array(starts(ids[::-1]))[::-1]


def _sweep(edges: dict[int, list[pd.DataFrame]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [b for b in batches if len(b)]
        if not got:
            return
        rows = pd.concat(got, ignore_index=True)
        before, after = edges.get(int(rows["pid"].iloc[0]), (None, None))
        rows = pd.concat([x for x in (before, rows, after) if x is not None and len(x)], ignore_index=True)
        entity = rows["entity"].to_numpy(dtype=bool)
        at = np.nonzero(entity)[0]
        who = np.nonzero(~entity)[0]
        if not len(at) or not len(who):
            return
        way = rows["way"].to_numpy()
        things, ids = Things(rows), rows["id"].to_numpy()
        k = np.searchsorted(at, who)
        found: list[pd.DataFrame] = []
        lo, hi = _spans(ids[at].tolist())
        lo, count = lo[k], hi[k] - lo[k]
        ends = np.cumsum(count)
        a = 0
        while a < len(who):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, side="right")))
            n = count[a:z]
            r, e = np.repeat(who[a:z], n), at[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[a:z], n)]
            a = z
            same = way[r] == way[e]
            r, e = r[same], e[same]
            km, turned = things.distances(e, r)
            # what is far apart however the coordinates are turned is no pair, unless a position is missing
            keep = ~(km > 90) | (turned <= 5) | (things.ident[e] == things.ident[r])
            e, r = e[keep], r[keep]
            c = things.confidence(e, r, km[keep], turned[keep], EVIDENCE)
            hit = c > 0
            found.append(pd.DataFrame({"entity_id": ids[e[hit]], "record_id": ids[r[hit]], "confidence": c[hit]}))
        yield pd.concat(found).groupby(["entity_id", "record_id"], as_index=False).max()

    return run


def candidates(entities: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, record_id, confidence) of the pairs the window finds with at least EVIDENCE."""
    shape = ["id", "ident", "name", "kind", "lat", "lon", "elevation", "country", "municipality"]
    both = entities.select(F.lit(True).alias("entity"), *shape).unionByName(records.select(F.lit(False).alias("entity"), *shape))
    both = both.filter("id is not null").distinct()
    # names are taken apart once: crowded names, the sample of the sort keys and the stream read what this wrote
    features = cut(both.mapInPandas(lambda it: (_features(b) for b in it), _FEATURES))
    rows = _stream(features)
    parts = min(MAX_PARTS, max(4, -(-5 * features.count() // PART_ROWS)))
    # entities before records of the same key, and the id last, so that a key that many rows share is split as well
    order = ["way", "key", F.expr("not entity"), "id"]
    ranged = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("pid", F.spark_partition_id())
    stream = cut(ranged)

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head = tail = None
        for b in batches:
            mine = b[b["entity"].to_numpy(dtype=bool)]
            if not len(mine):
                continue
            head = _outermost(mine if head is None else pd.concat([head, mine], ignore_index=True), False)
            tail = _outermost(mine if tail is None else pd.concat([tail, mine], ignore_index=True), True)
        if head is not None:
            yield head.assign(side=0)
            yield tail.assign(side=1)

    # the rows of at most 2 x WINDOW entities of each partition come to the driver and go out again
    schema = _FEATURES + ", way int, key string, pid int"
    borders = stream.mapInPandas(ends, schema + ", side int").toPandas()
    edges: dict[int, tuple] = {}
    for pid in range(parts):
        prev = _outermost(borders[(borders["pid"] < pid) & (borders["side"] == 1)], True)
        nxt = _outermost(borders[(borders["pid"] > pid) & (borders["side"] == 0)], False)
        edges[pid] = (prev.drop(columns="side"), nxt.drop(columns="side"))
    pairs = stream.mapInPandas(_sweep(edges), "entity_id long, record_id long, confidence double")
    return pairs.groupBy("entity_id", "record_id").agg(F.max("confidence").alias("confidence"))


def assign(pairs: DataFrame, records: DataFrame, group: str = "group_ident") -> DataFrame:
    """(entity_id, record_id, confidence): every record gets at most one entity, so that total confidence is greatest.

    An entity may have several records, so the best assignment is each record's best entity. Records of one group
    (``group`` of ``records``, same source and same ident) are one thing: they go together to the entity with the
    greatest sum, if the mean over those that found any evidence reaches ACCEPT and at least half did. Records
    without a group stand alone. Ties go to the lowest entity. confidence is null for a record that goes with its group
    without having been compared with the entity, or with less than EVIDENCE; see ``rated``.
    """
    own = records.select(F.col("id").alias("record_id"), F.coalesce(group, F.concat(F.lit("#"), F.col("id").cast("string"))).alias("g")).filter("record_id is not null").distinct()
    size = own.groupBy("g").agg(F.count("*").alias("size"))
    sums = pairs.join(own, "record_id").groupBy("g", "entity_id").agg(F.sum("confidence").alias("total"), F.count("*").alias("n"), F.max("confidence").alias("top"))
    best = sums.groupBy("g").agg(F.max_by(F.struct("entity_id", "total", "n", "top"), F.struct("total", (-F.col("entity_id")).alias("i"))).alias("b")).select("g", "b.*")
    taken = best.join(size, "g").filter((F.col("total") / F.col("n") >= ACCEPT) & (F.col("n") * 2 >= F.col("size")))
    out = taken.join(own, "g").join(pairs.select("entity_id", "record_id", "confidence"), ["entity_id", "record_id"], "left")
    return out.select("entity_id", "record_id", "confidence")


def rated(assigned: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """``assigned`` with a confidence for every pair: those without one are compared now, each with all revisions."""
    open_ = assigned.filter("confidence is null").select("entity_id", "record_id")
    shape = ["id", "ident", "name", "kind", "lat", "lon", "elevation", "country", "municipality"]

    def features(df: DataFrame, entity: bool, ids: DataFrame) -> DataFrame:
        rows = df.select(F.lit(entity).alias("entity"), *shape).join(ids.distinct(), "id", "left_semi").distinct()
        return rows.mapInPandas(lambda it: (_features(b) for b in it), _FEATURES)

    e = features(entities, True, open_.select(F.col("entity_id").alias("id")))
    r = features(records, False, open_.select(F.col("record_id").alias("id")))
    names = e.columns
    both = open_.join(e.select(F.col("id").alias("entity_id"), F.struct(*names).alias("e")), "entity_id").join(r.select(F.col("id").alias("record_id"), F.struct(*names).alias("r")), "record_id")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = len(b)
            if not n:
                continue
            things = Things(pd.DataFrame([*b["e"], *b["r"]]))
            i, j = np.arange(n), np.arange(n) + n
            yield pd.DataFrame({"entity_id": b["entity_id"], "record_id": b["record_id"], "confidence": things.confidence(i, j, *things.distances(i, j))})

    now = both.mapInPandas(run, "entity_id long, record_id long, confidence double").groupBy("entity_id", "record_id").agg(F.max("confidence").alias("confidence"))
    return assigned.filter("confidence is not null").unionByName(now)


def match(entities: DataFrame, records: DataFrame) -> DataFrame:
    """(entity_id, record_id, confidence). Both tables have id, ident, name, kind, lat, lon, elevation, country,
    municipality, records also group_ident; any of them may be null, repeated rows count once, extra columns are
    ignored, empty tables give an empty result."""
    return rated(cut(assign(candidates(entities, records), records)), entities, records)
