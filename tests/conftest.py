import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Build origin or destination tables from tuples."""

    def build(rows, kind):
        key = "origin long" if kind == "origin" else "destination string"
        return spark.createDataFrame(rows, f"{key}, x double, y double")

    return build


def brute(origins, destinations, k=1, cap=None, square=False):
    """All-pairs answer in plain Python: sorted (origin, destination, distance)."""
    out = []
    for o, ox, oy in origins:
        if ox is None or oy is None:
            continue
        seen = []
        for d, dx, dy in destinations:
            if dx is None or dy is None:
                continue
            ax, ay = ox - dx, oy - dy
            dist = math.sqrt(ax * ax + ay * ay)
            if cap is not None and (max(abs(ax), abs(ay)) if square else dist) > cap:
                continue
            seen.append((dist, d))
        out += [(o, d, dist) for dist, d in sorted(seen)[:k]]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.select("origin", "destination", "distance").collect())
