"""Geodesic distances and the change from national grid to latitude/longitude.

All formulas are published closed forms, written as column arithmetic or, where that
is too much code for one method, as arithmetic on Arrow batches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the published formulas and ellipsoids.
EARTH_RADIUS = 6371008.8  # mean radius, metres
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
AIRY_A, AIRY_B = 6377563.396, 6356256.909
GRID_SCALE = 0.9996012717
GRID_LAT0, GRID_LON0 = math.radians(49.0), math.radians(-2.0)
GRID_E0, GRID_N0 = 400000.0, -100000.0
# OSGB36 to WGS84: shifts in metres, scale in parts per million, turns in arc seconds.
SHIFT = (446.448, -125.157, 542.060)
SCALE_PPM = -20.4894
TURNS = (0.1502, 0.2470, 0.8421)


def geodesic_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                      spheroid: bool = False) -> Column:
    """Metres between two points in degrees.

    ``spheroid=False``: great circle (haversine).  ``spheroid=True``:
    Andoyer-Lambert on WGS84, within a few metres per 1000 km of the geodesic.
    """
    a, o, b, p = (F.radians(v) for v in (lat1, lon1, lat2, lon2))
    if not spheroid:
        h = F.pow(F.sin((b - a) / 2), F.lit(2.0)) + F.cos(a) * F.cos(b) * F.pow(
            F.sin((p - o) / 2), F.lit(2.0)
        )
        # Rounding can lift h above 1 for antipodes.
        return 2 * EARTH_RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), h)))
    f, g, l = (a + b) / 2, (a - b) / 2, (o - p) / 2
    sq = lambda v: F.pow(v, F.lit(2.0))
    s = sq(F.sin(g)) * sq(F.cos(l)) + sq(F.cos(f)) * sq(F.sin(l))
    c = sq(F.cos(g)) * sq(F.cos(l)) + sq(F.sin(f)) * sq(F.sin(l))
    w = F.atan(F.sqrt(s / c))
    r = F.sqrt(s * c) / w
    h1, h2 = (3 * r - 1) / (2 * c), (3 * r + 1) / (2 * s)
    flat = 1 + WGS84_F * (
        h1 * sq(F.sin(f)) * sq(F.cos(g)) - h2 * sq(F.cos(f)) * sq(F.sin(g))
    )
    return F.when(s == 0, F.lit(0.0)).otherwise(2 * w * WGS84_A * flat)


def geodesic_inverse(lat1: Column, lon1: Column, lat2: Column, lon2: Column,
                     tolerance: float = 2e-15, rounds: int = 100) -> Column:
    """Metres of the geodesic on WGS84 between two points in degrees, to a fraction of a millimetre.

    Vincenty's inverse solution, iterated for a whole batch over the rows that
    aren't settled yet. It doesn't settle for nearly antipodal points: for these
    the direction of departure is halved down until the geodesic meets the
    longitude asked for, which grows with it. NULL gives NULL, NaN and
    infinities NaN.
    """
    a, f = WGS84_A, WGS84_F

    def opposite(u1, u2, dl):
        import numpy as np

        # By symmetry: the first point in the south, and no nearer to the equator than the second.
        swap = np.abs(u1) < np.abs(u2)
        b1, b2 = np.where(swap, u2, u1), np.where(swap, u1, u2)
        b1, b2 = np.where(b1 > 0, -b1, b1), np.where(b1 > 0, -b2, b2)
        b1 = np.minimum(b1, -1e-12)  # on the equator, the limit from the south
        low, high = np.zeros(len(b1)), np.full(len(b1), np.pi)
        for _ in range(60):
            out = (low + high) / 2
            sa, x1 = np.sin(out) * np.cos(b1), np.cos(out) * np.cos(b1)
            x2 = np.sqrt(np.maximum(x1 * x1 + np.cos(b2) ** 2 - np.cos(b1) ** 2, 0))
            s1, s2 = np.arctan2(np.sin(b1), x1), np.arctan2(np.sin(b2), x2)
            turn = np.arctan2(sa * np.sin(b2), x2) - np.arctan2(sa * np.sin(b1), x1)
            sigma, ca, cm = s2 - s1, 1 - sa * sa, np.cos(s1 + s2)
            k = f / 16 * ca * (4 + f * (4 - 3 * ca))
            reached = turn - (1 - k) * f * sa * (
                sigma + k * np.sin(sigma) * (cm + k * np.cos(sigma) * (2 * cm * cm - 1)))
            low, high = np.where(reached < np.abs(dl), out, low), np.where(reached < np.abs(dl), high, out)
        return length(ca, sigma, np.sin(sigma), np.cos(sigma), cm)

    def length(ca, sigma, ss, cs, cm):
        u = ca * (1 / (1 - f) ** 2 - 1)
        x = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        y = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        turn = y * ss * (cm + y / 4 * (cs * (2 * cm * cm - 1) - y / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))
        return a * (1 - f) * x * (sigma - turn)

    def inverse(lat1, lon1, lat2, lon2):
        import numpy as np
        import pyarrow as pa

        missing = np.zeros(len(lat1), bool)
        degrees = []
        for v in (lat1, lon1, lat2, lon2):
            missing |= v.is_null().to_numpy(zero_copy_only=False)
            degrees.append(np.radians(v.fill_null(np.nan).to_numpy(zero_copy_only=False).astype("f8")))
        p1, l1, p2, l2 = degrees
        out = np.full(len(p1), np.nan)
        good = np.isfinite(p1 + l1 + p2 + l2)
        same = good & (p1 == p2) & (l1 == l2)
        out[same] = 0.0
        left = np.flatnonzero(good & ~same)
        u1, u2 = np.arctan((1 - f) * np.tan(p1)), np.arctan((1 - f) * np.tan(p2))
        # The shorter way around.
        dl = np.remainder(l2 - l1 + np.pi, 2 * np.pi) - np.pi
        lam = dl.copy()
        with np.errstate(all="ignore"):
            for _ in range(rounds):
                if not len(left):
                    break
                su1, cu1, su2, cu2 = np.sin(u1[left]), np.cos(u1[left]), np.sin(u2[left]), np.cos(u2[left])
                sl, cl = np.sin(lam[left]), np.cos(lam[left])
                ss = np.hypot(cu2 * sl, cu1 * su2 - su1 * cu2 * cl)
                cs = su1 * su2 + cu1 * cu2 * cl
                sigma = np.arctan2(ss, cs)
                sa = np.where(ss > 0, cu1 * cu2 * sl / ss, 0.0)
                ca = 1 - sa * sa
                cm = np.where(ca > 1e-15, cs - 2 * su1 * su2 / ca, 0.0)
                k = f / 16 * ca * (4 + f * (4 - 3 * ca))
                new = dl[left] + (1 - k) * f * sa * (sigma + k * ss * (cm + k * cs * (2 * cm * cm - 1)))
                settled = np.abs(new - lam[left]) <= tolerance
                out[left[settled]] = length(ca, sigma, ss, cs, cm)[settled]
                lam[left] = new
                # A longitude beyond half a turn never comes back.
                left = left[~settled & (np.abs(new) <= np.pi)]
            left = np.flatnonzero(good & np.isnan(out))
            out[left] = opposite(u1[left], u2[left], dl[left])
        return pa.array(out, mask=missing)

    udf = F.arrow_udf(inverse, "double")
    return udf(*[c.cast("double") for c in (lat1, lon1, lat2, lon2)])


def reproject_points(df: DataFrame, lat: str = "lat", lon: str = "lon", x: str = "x",
                     y: str = "y") -> DataFrame:
    """Add WGS84 ``lat``/``lon`` (EPSG:4326) to British grid ``x``/``y`` (EPSG:27700).

    Inverse transverse Mercator on the Airy ellipsoid, then the seven-parameter
    datum shift; without a correction grid this is good to about five metres.
    NULL in either gives NULL in both, NaN and infinities NaN.

    Computed for whole batches: as column arithmetic the steps fill a method of more
    than 8000 bytes of code, which the JVM doesn't compile. Declared non-deterministic
    only to stop Catalyst from copying the call into filters on its result.
    """
    e2 = 1 - (AIRY_B / AIRY_A) ** 2
    n = (AIRY_A - AIRY_B) / (AIRY_A + AIRY_B)
    bf = AIRY_B * GRID_SCALE
    w2 = WGS84_F * (2 - WGS84_F)
    scale = 1 + SCALE_PPM * 1e-6
    rx, ry, rz = (math.radians(v / 3600) for v in TURNS)

    def degrees(east, north):
        import numpy as np
        import pyarrow as pa

        missing = east.is_null().to_numpy(zero_copy_only=False) | north.is_null().to_numpy(zero_copy_only=False)
        east, north = (v.fill_null(np.nan).to_numpy(zero_copy_only=False) for v in (east, north))
        with np.errstate(all="ignore"):
            p = (north - GRID_N0) / (AIRY_A * GRID_SCALE) + GRID_LAT0
            for _ in range(4):  # converges to well under a millimetre
                d, s = p - GRID_LAT0, p + GRID_LAT0
                arc = bf * (
                    (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
                    - (3 * n + 3 * n**2 + 2.625 * n**3) * np.sin(d) * np.cos(s)
                    + (1.875 * n**2 + 1.875 * n**3) * np.sin(2 * d) * np.cos(2 * s)
                    - (35 / 24 * n**3) * np.sin(3 * d) * np.cos(3 * s)
                )
                p = p + (north - GRID_N0 - arc) / (AIRY_A * GRID_SCALE)
            s2 = np.sin(p) * np.sin(p)
            nu = AIRY_A * GRID_SCALE / np.sqrt(1 - e2 * s2)
            rho = nu * (1 - e2) / (1 - e2 * s2)
            t, eta, d = np.tan(p), nu / rho - 1, east - GRID_E0
            t2, d2 = t * t, d * d
            t4, t6 = t2 * t2, t2 * t2 * t2
            vii = t / (2 * rho * nu)
            viii = t / (24 * rho * nu * nu * nu) * (5 + 3 * t2 + eta - 9 * t2 * eta)
            ix = t / (720 * rho * nu * nu * nu * nu * nu) * (61 + 90 * t2 + 45 * t4)
            sec = 1 / np.cos(p)
            x1 = sec / nu
            xi = sec / (6 * nu * nu * nu) * (nu / rho + 2 * t2)
            xii = sec / (120 * nu * nu * nu * nu * nu) * (5 + 28 * t2 + 24 * t4)
            xiia = sec / (5040 * nu * nu * nu * nu * nu * nu * nu) * (61 + 662 * t2 + 1320 * t4 + 720 * t6)
            phi = p - vii * d2 + viii * d2 * d2 - ix * d2 * d2 * d2
            lam = GRID_LON0 + x1 * d - xi * d2 * d + xii * d2 * d2 * d - xiia * d2 * d2 * d2 * d

            # Geographic to cartesian, shift, and back.
            v = AIRY_A / np.sqrt(1 - e2 * np.sin(phi) * np.sin(phi))
            px, py, pz = v * np.cos(phi) * np.cos(lam), v * np.cos(phi) * np.sin(lam), (1 - e2) * v * np.sin(phi)
            wx = SHIFT[0] + scale * px - rz * py + ry * pz
            wy = SHIFT[1] + rz * px + scale * py - rx * pz
            wz = SHIFT[2] - ry * px + rx * py + scale * pz
            h = np.sqrt(wx * wx + wy * wy)
            q = np.arctan2(wz, h * (1 - w2))
            for _ in range(4):
                s = np.sin(q)
                q = np.arctan2(wz + w2 * WGS84_A / np.sqrt(1 - w2 * s * s) * s, h)
            found = [pa.array(np.degrees(v), mask=missing) for v in (q, np.arctan2(wy, wx))]
        return pa.StructArray.from_arrays(found, names=["lat", "lon"])

    udf = F.arrow_udf(degrees, "struct<lat: double, lon: double>").asNondeterministic()
    work = df.withColumn("_globe", udf(F.col(x).cast("double"), F.col(y).cast("double")))
    return work.select(*df.columns, F.col("_globe.lat").alias(lat), F.col("_globe.lon").alias(lon))
