"""Images taken whole against the same by columns and rows, and tasks whose rows do not grow with the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from maskrisk.operators import agreement, components, geometry, pixels
from maskrisk.sources import views


def maps(spark, images: int = 12):
    """Images of several frames with holes, flat ones and one larger than the others."""
    rng = np.random.default_rng(5)
    rows = []
    for s in range(images):
        h, w = (40, 30) if s == 3 else (int(rng.integers(1, 9)), int(rng.integers(1, 9)))
        p = np.full((h, w), s / images) if s % 4 == 0 else np.round(rng.random((h, w)), 1)
        rows += [(s, y, x, float(p[y, x]), int(rng.random() < 0.5)) for y in range(h) for x in range(w) if rng.random() < 0.9 or (y, x) == (0, 0)]
    return spark.createDataFrame(rows, "sample_id long, y int, x int, p double, truth int")


def values(df, *order):
    return [tuple(None if v is None else round(v, 9) for v in r) for r in df.orderBy(*order).collect()]


def test_distances_whole_and_by_lines(spark):
    px = maps(spark)
    for whole in (100, 0):
        assert values(geometry.distance_ladder(px, ["sample_id"], [2, 5]), "sample_id") == values(geometry.distance_ladder(px, ["sample_id"], [2, 5], whole=whole), "sample_id")
    m = pixels.hard_action(px)
    assert values(geometry.mask_distances(m, ["sample_id"], "truth", "a"), "sample_id") == values(geometry.mask_distances(m, ["sample_id"], "truth", "a", whole=0), "sample_id")


def test_components_and_draws_whole_and_by_bands(spark):
    px = maps(spark).withColumn("m", (F.col("p") >= 0.5).cast("int"))
    names = ["sample_id", "y", "x", "p", "label"]
    one, two = (components.components(px, ["sample_id"], "m", band_rows=2, whole=whole).select(names) for whole in (1 << 14, 100))
    assert values(one, *names) == values(two, *names)
    draws = [values(components.partition_dice(one, ["sample_id"], "c", 8, 3, 7, whole=whole), "sample_id", "repeat") for whole in (1 << 14, 0)]
    assert draws[0] == draws[1] and len(draws[0]) == 36


def test_dice_ladder_counts(spark):
    got = {r.sample_id: (r.confidence_dice_m2, r.confidence_dice_m5) for r in pixels.dice_ladder(maps(spark), ["sample_id"], [2, 5]).collect()}
    by = {}
    for r in maps(spark).collect():
        by.setdefault(r.sample_id, []).append(r.p)
    for s, p in by.items():
        p = np.array(p)
        a = (p >= 0.5).sum()
        for m, v in zip((2, 5), got[s], strict=True):
            loss = [0.0 if (p >= t).sum() + a == 0 else 1 - 2 * ((p >= t) & (p >= 0.5)).sum() / ((p >= t).sum() + a) for t in pixels.nodes(m)]
            assert abs(v + np.mean(loss)) < 1e-12


def test_tasks_grow_with_the_lines(spark, sf, monkeypatch):
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    monkeypatch.setattr(views, "LINES", views.read(spark, sf, "lineitem").count() // parts, raising=False)
    assert views.large_pixels(spark, sf).rdd.getNumPartitions() >= parts


def test_agreement_sends_distinct_scores(spark, monkeypatch):
    """Copies of rows reach the rank counts as one row with its count."""
    rows = spark.createDataFrame([("d", i, float(i % 4), float(i % 3)) for i in range(240)], "dataset string, id long, a double, b double")
    seen, plain = [], agreement.kendall
    monkeypatch.setattr(agreement, "kendall", lambda df, *a, **k: seen.append(df.count()) or plain(df, *a, **k))
    got = agreement.score_agreement(rows, ["dataset"], "id", ["a", "b"], [0.5]).first()
    assert seen == [12] and abs(got["rho"]) < 1e-12 and abs(got["tau"]) < 1e-12 and abs(got["jaccard_50"] - 1 / 3) < 1e-12
