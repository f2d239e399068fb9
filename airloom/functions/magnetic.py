"""The geomagnetic field by spherical harmonics, from a coefficient file in the usual COF format.

The coefficients are public data that come with each model epoch; the file is a parameter. Without one the low degrees
below stand in, good to a few degrees of declination and meant for tests and rough work only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: N, m, g, h, their change a year, for degrees 1 and 2 at 2025.
LOW = [
    (1, 0, -29351.8, 0.0, 12.0, 0.0), (1, 1, -1410.8, 4545.4, 9.7, -21.5),
    (2, 0, -2556.6, 0.0, -11.6, 0.0), (2, 1, 2951.1, -3133.6, -5.2, -27.7), (2, 2, 1649.3, -815.1, -8.0, -12.1),
]
EPOCH, LAST, RADIUS_KM = 2025.0, 2030.0, 6371.2
A_KM, F_WGS = 6378.137, 1 / 298.257223563


@dataclass
class Model:
    rows: list[tuple]
    epoch: float = EPOCH

    @staticmethod
    def read(path: str) -> Model:
        """A COF file: a header with the epoch, then n m g h dg dh until a line of nines."""
        with open(path) as f:
            lines = [x.split() for x in f if x.strip()]
        rows = [(int(p[0]), int(p[1]), *map(float, p[2:6])) for p in lines[1:] if len(p) >= 6 and not p[0].startswith("9999")]
        return Model(rows, float(lines[0][0]))


def _legendre(top: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Schmidt semi-normalised functions and their derivatives by colatitude."""
    c, s = np.cos(theta), np.sin(theta)
    p, d = np.zeros((top + 1, top + 1, len(theta))), np.zeros((top + 1, top + 1, len(theta)))
    p[0, 0] = 1
    for n in range(1, top + 1):
        for m in range(n + 1):
            if n == m:
                k = math.sqrt(1 - 1 / (2 * n)) if n > 1 else 1.0
                p[n, n], d[n, n] = k * s * p[n - 1, n - 1], k * (s * d[n - 1, n - 1] + c * p[n - 1, n - 1])
            else:
                a, b = (2 * n - 1) / math.sqrt(n * n - m * m), (math.sqrt((n - 1) ** 2 - m * m) / math.sqrt(n * n - m * m) if n > 1 else 0.0)
                q, e = (p[n - 2, m], d[n - 2, m]) if n > 1 else (0.0, 0.0)
                p[n, m], d[n, m] = a * c * p[n - 1, m] - b * q, a * (c * d[n - 1, m] - s * p[n - 1, m]) - b * e
    return p, d


def evaluate(model: Model, year: np.ndarray, alt_km: np.ndarray, lat: np.ndarray, lon: np.ndarray) -> dict[str, np.ndarray]:
    """Declination, inclination (degrees) and F, H, X, Y, Z (nT); NaN outside the model's years or the earth's range."""
    year, alt_km, lat, lon = np.broadcast_arrays(*(np.atleast_1d(np.asarray(x, float)) for x in (year, alt_km, lat, lon)))
    ok = (year >= model.epoch) & (year <= model.epoch + LAST - EPOCH) & (np.abs(lat) <= 90) & (np.abs(lon) <= 180) & (alt_km >= -1) & (alt_km <= 850)
    phi, lam = np.radians(np.where(ok, lat, 0)), np.radians(np.where(ok, lon, 0))
    e2 = F_WGS * (2 - F_WGS)
    rc = A_KM / np.sqrt(1 - e2 * np.sin(phi) ** 2)
    x, z = (rc + alt_km) * np.cos(phi), (rc * (1 - e2) + alt_km) * np.sin(phi)
    r = np.hypot(x, z)
    gc = np.arcsin(z / r)
    theta = np.clip(math.pi / 2 - gc, 1e-9, math.pi - 1e-9)
    top = max(n for n, *_ in model.rows)
    p, d = _legendre(top, theta)
    br, bt, bp = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    t = year - model.epoch
    for n, m, g, h, dg, dh in model.rows:
        gg, hh, f = g + dg * t, h + dh * t, (RADIUS_KM / r) ** (n + 2)
        cm, sm = np.cos(m * lam), np.sin(m * lam)
        br += (n + 1) * f * (gg * cm + hh * sm) * p[n, m]
        bt -= f * (gg * cm + hh * sm) * d[n, m]
        bp -= f * m * (-gg * sm + hh * cm) * p[n, m] / np.sin(theta)
    psi = gc - phi
    bx, by, bz = -bt, bp, -br
    bx, bz = bx * np.cos(psi) - bz * np.sin(psi), bx * np.sin(psi) + bz * np.cos(psi)
    hor = np.hypot(bx, by)
    out = {"declination": np.degrees(np.arctan2(by, bx)), "inclination": np.degrees(np.arctan2(bz, hor)), "f": np.hypot(hor, bz), "h": hor, "x": bx, "y": by, "z": bz}
    return {k: np.where(ok, v, np.nan) for k, v in out.items()}


def field(model: Model | None = None):
    """A vectorised UDF (year, altitude km, lat, lon) of the field as a struct."""
    rows = (model or Model(LOW)).rows
    epoch = (model or Model(LOW)).epoch
    names = ["declination", "inclination", "f", "h", "x", "y", "z"]

    @F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in names]))
    def run(year: pd.Series, alt: pd.Series, lat: pd.Series, lon: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(evaluate(Model(rows, epoch), year, alt, lat, lon))

    return run


def designator(magnetic: Column) -> Column:
    """Runway number of a magnetic heading: tens of degrees, 36 for north."""
    n = F.pmod(F.round(magnetic / 10).cast("int"), F.lit(36))
    return F.lpad(F.when(n == 0, 36).otherwise(n).cast("string"), 2, "0")


def redesignation(df: DataFrame, published: str, true_heading: str, declination: str) -> DataFrame:
    """Computed designator beside the published one, with how far the magnetic heading has drifted from its number."""
    mag = F.pmod(F.col(true_heading) - F.col(declination), F.lit(360.0))
    num = F.regexp_extract(published, r"^(\d{2})", 1).try_cast("int") * 10
    drift = F.abs(F.pmod(mag - num + 540, F.lit(360.0)) - 180)
    side = F.regexp_extract(published, r"([LRC])$", 1)
    return df.withColumn("magnetic_deg", mag).withColumn("computed_designator", F.concat(designator(mag), side)).withColumn("drift_deg", drift)
