"""Shift analysis by hand, and the permutation null as a statistic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.operators import shapes, temporal
from citeloom.operators import windows as win


def rows(spark, data):
    return spark.createDataFrame(data, "work string, unit string, iid long, year int")


def test_split_and_shape(spark):
    df = rows(spark, [("w", "a", 1, 1990), ("w", "a", 2, 1991), ("w", "b", 3, 1992), ("w", "a", 3, 1993), ("w", "b", 4, 1993), ("w", "b", 4, 1993), ("s", "a", 1, 1990), ("s", "a", 2, 1999)])
    got = {(r.work, r.unit): (r.early, r.late) for r in temporal.early_late(df).collect()}
    assert got == {("w", "a"): (2, 1), ("w", "b"): (1, 1), ("s", "a"): (1, 1)}
    shape = {r.work: r for r in temporal.shape(temporal.early_late(df)).collect()}
    assert shape["s"].spearman is None and shape["s"].tvd == 0
    assert shape["w"].tvd == pytest.approx(abs(2 / 3 - 1 / 2))


def test_step_up(spark):
    df = spark.createDataFrame([("w", i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.5, 0.9])], "work string, unit int, p double")
    q = [r.q for r in win.q_values(df, ["work"], "p", "unit").orderBy("unit").collect()]
    assert q == pytest.approx([0.1 / 3, 0.1 / 3, 0.1 / 3, 0.625, 0.9]) and q == sorted(q)


def test_smoothing_keeps_gaps(spark):
    df = spark.createDataFrame([("w", 1990, 2), ("w", 1991, 4), ("w", 1995, 9)], "work string, year int, n int")
    one = lambda k: [r.smoothed for r in win.smooth(df, ["work"], "n", k).orderBy("year").collect()]
    assert one(3) == [3, 3, 9] and one(1) == [2, 4, 9] and one(2) == [3, 3, 9]


def some_rows(seed=5):
    rng = np.random.default_rng(seed)
    data = [("w", f"u{rng.integers(12)}", int(rng.integers(300)), int(1990 + rng.integers(10))) for i in range(600)]
    return data + [("x", "rise" if y >= 1995 else "fall", int(i), int(y)) for i, y in enumerate(rng.integers(1990, 2000, 200))]


def test_null_is_uniform_and_repeatable(spark):
    df = rows(spark, some_rows())
    a = {(r.work, r.unit): r.p for r in temporal.permutation_null(df, 100).collect()}
    assert a == {(r.work, r.unit): r.p for r in temporal.permutation_null(df.repartition(3), 100).collect()}
    w = [p for (k, _), p in a.items() if k == "w"]
    assert 0.2 < np.mean(w) < 0.8 and sum(p < 0.05 for p in w) <= 3
    assert a["x", "rise"] < 0.02 and a["x", "fall"] < 0.02


@pytest.mark.parametrize("chunk", [50_000, 40])
def test_shuffles_keep_labels_and_rows(spark, chunk, monkeypatch):
    """In one chunk and in many: the labels of a work keep their numbers, and the mean of the null is the one
    that whole shuffles have."""
    monkeypatch.setattr(temporal, "CHUNK_ROWS", chunk)
    data = some_rows()
    once = [(w, u, i, 0 if k % 3 else 1 + k % 2) for k, (w, u, i, _) in enumerate(dict.fromkeys((w, u, i, 0) for w, u, i, _ in data))]
    df = spark.createDataFrame(once, "work string, unit string, iid long, label int")
    sums = df.groupBy("work").agg(*(F.count_if(F.col("label") == k).alias(f"n{k}") for k in range(3)))
    got = temporal._shuffled(df, 3, 30, 7).groupBy("work", "perm").agg(*(F.sum(F.get("n", F.lit(k))).alias(f"n{k}") for k in range(3)))
    assert got.count() == 60 and got.join(sums, ["work", "n0", "n1", "n2"], "left_anti").count() == 0

    twice = spark.createDataFrame([(w, u, i, int(y >= 1995)) for w, u, i, y in data * 2], "work string, unit string, iid long, label int")
    mean = {(r.work, r.unit): (r.a, r.b) for r in temporal._shuffled(twice, 2, 200, 3).groupBy("work", "unit").agg(F.avg(F.get("n", F.lit(0))).alias("a"), F.avg(F.get("n", F.lit(1))).alias("b")).collect()}
    rng = np.random.default_rng(1)
    own = [(u, i, y >= 1995) for w, u, i, y in data * 2 if w == "w"]
    label, seen = np.array([x for *_, x in own]), []
    for _ in range(200):
        mixed = rng.permutation(label)
        seen.append(len({i for (u, i, _), x in zip(own, mixed, strict=True) if u == "u3" and x}))
    assert mean["w", "u3"][1] == pytest.approx(np.mean(seen), abs=4 * np.std(seen) / 200**0.5 + 0.3)


def test_whole_work_nulls_by_hand(spark):
    """rho, tvd and dispersion against their nulls, computed from the same shuffles in numpy."""
    df = rows(spark, some_rows())
    null = temporal.two_bin_null(df, 50).toPandas()
    got = {r.work: r for r in temporal.shape_null(df, 50).collect()}
    for work, frame in null.groupby("work"):
        wide = frame.sort_values(["perm", "unit"])
        tvd = wide.groupby("perm")["delta"].apply(lambda x: 0.5 * x.abs().sum())
        rho = wide.groupby("perm")[["share_early", "share_late"]].apply(lambda x: x.rank().corr().iloc[0, 1])
        r = got[work]
        assert (r.tvd_mean, r.tvd_sd) == pytest.approx((tvd.mean(), tvd.std(ddof=0))) and r.tvd_z == pytest.approx((r.tvd - tvd.mean()) / tvd.std(ddof=0))
        assert r.tvd_percentile == pytest.approx(100 * (tvd <= r.tvd + 1e-12).mean())
        if rho.std() > 0:
            assert r.rho_z == pytest.approx((r.spearman - rho.mean()) / rho.std(ddof=0))
    assert got["x"].tvd_z > 5 and abs(got["w"].tvd_z) < 3.5
    parts = temporal.dispersion_null(df, 3, 50).toPandas()
    assert parts[parts.work == "x"].z.iloc[0] > 5 and parts[parts.work == "x"].p.max() < 0.05
    assert abs(parts[parts.work == "w"].z.iloc[0]) < 3.5 and parts[parts.work == "w"].p.mean() > 0.2
    assert parts.groupby("work").dispersion.sum().to_dict() == pytest.approx(parts.groupby("work").whole.first().to_dict())


def test_period_cuts_by_hand(spark):
    df = rows(spark, some_rows() + [("few", "u", k, 1990 + k) for k in range(14)])
    got = {r.work: list(r.cuts) for r in temporal.work_cuts(df, 3).collect()}
    want = {}
    for work in ("w", "x"):
        ys = sorted(y for w, _, _, y in some_rows() if w == work)
        want[work] = [ys[min(len(ys) - 1, i * len(ys) // 3)] for i in (1, 2)]
    assert got == want


def test_q_values_of_gated_units_by_brute_force(spark):
    rng = np.random.default_rng(6)
    data = [("w", f"u{min(int(rng.integers(12)), 4)}", int(rng.integers(90)), int(1990 + rng.integers(10))) for _ in range(150)]
    data += [("w", f"few{k}", k, 1990 + 9 * (k % 2)) for k in range(14)] + [("x", "one", k, 1990 + k) for k in range(15)]
    df = rows(spark, data)
    p = {(r.work, r.unit): r.p for r in temporal.permutation_null(df).collect()}
    p = {k: v for k, v in p.items() if len({i for w, u, i, _ in data if (w, u) == k}) >= 15}
    want = {}
    for work, u in p:
        own = {v: x for (w, v), x in p.items() if w == work}
        want[work, u] = (own[u], min(1, *(own[v] * len(own) / sum(x <= own[v] for x in own.values()) for v in own if own[v] >= own[u]), 1))
    got = {(r.work, r.unit): (r.p, r.q) for r in temporal.permutation_q(df).collect()}
    assert set(got) == set(want) and ("x", "one") in got and not any(u.startswith("few") for _, u in got)
    assert all(got[k] == pytest.approx(want[k]) for k in want)


def test_permutation_queries_take_all_works(spark):
    from citeloom.queries import QUERIES
    from citeloom.queries.temporal import units

    sf = "/root/testdata/sf0.001"
    works = {r.work for r in units(spark, sf).select("work").distinct().collect()}
    p = QUERIES["x04_permutation_null"](spark, sf).collect()
    assert {r.work for r in p} == works and all(abs(r.p * 201 - round(r.p * 201)) < 1e-4 for r in p)
    gated = {(r.work, r.unit) for r in units(spark, sf).groupBy("work", "unit").agg(F.countDistinct("iid").alias("n")).where("n >= 15").collect()}
    assert {(r.work, r.unit) for r in QUERIES["x05_q_values"](spark, sf).collect()} == gated


def test_verdicts(spark):
    z = spark.createDataFrame([(3.0,), (1.5,), (1.4,), (float("nan"),), (None,)], "z double")
    assert [r.v for r in z.select(temporal.verdict(F.col("z")).alias("v")).collect()] == ["REAL", "marginal", "stable", "stable", "stable"]
    nan = float("nan")
    works = [("a", 3.5, 0.0, 10, 9), ("b", 1.6, 3.2, 10, 9), ("c", 0.1, 3.0, 200, 9), ("d", 0.1, nan, 100, 3), ("e", 0.1, 2.9, 99, 3), ("f", None, None, 500, 9)]
    flags = temporal.verdicts(spark.createDataFrame(works, "work string, tvd_z double, structure_z double, n_articles int, n_tested int"))
    got = {r.work: (r.verdict, r.two_bin_flat_only, r.two_bin_understates, r.stability_powered, r.near_threshold) for r in flags.collect()}
    assert got == {
        "a": ("REAL", False, False, False, True), "b": ("marginal", False, True, False, True), "c": ("stable", True, True, True, False),
        "d": ("stable", False, False, True, False), "e": ("stable", False, False, False, False), "f": ("stable", False, False, True, False),
    }
    cases = [  # verdict, flat only, understates, powered, solid, survivors
        ("stable", True, True, True, 0, 1, "rp", False), ("stable", True, True, True, 5, 0, "rw", False), ("stable", False, False, True, 5, 5, "s", False), ("stable", False, False, False, 5, 5, "t", False),
        ("REAL", False, False, False, 1, 0, "1p", False), ("REAL", False, True, False, 0, 9, "1w", False), ("marginal", False, True, False, 9, 1, "rp", True), ("marginal", False, True, False, 9, 0, "rw", True),
        ("marginal", False, False, False, 1, 1, "1p", True), ("marginal", False, False, False, 0, 1, "1w", True), (None, False, False, False, 9, 9, "t", False),
    ]
    codes = spark.createDataFrame(cases, "v string, f boolean, u boolean, p boolean, s int, m int, shape string, hedged boolean")
    assert codes.select("shape", "hedged", shapes.shape_code(*map(F.col, "vfupsm")).alias("c")).where("shape <> c.shape OR hedged <> c.hedged").count() == 0
    labels = spark.createDataFrame([(2, 0.5, 3, 50, "hero"), (0, 0.1, 8, 50, "diffuse"), (0, 0.1, 8, 60, "weak"), (1, 0.3, 9, 10, "both"), (0, 0.9, 1, 10, "weak")], "n int, t double, h int, k int, want string")
    assert labels.where(temporal.structure(*map(F.col, "nthk")) != F.col("want")).count() == 0
    spread = spark.createDataFrame([(3, 0.1, "B"), (5, 0.34, "A"), (4, 0.1, "mixed"), (9, 0.35, "mixed")], "n int, t double, want string")
    assert spread.where(temporal.collision_pattern(F.col("n"), F.col("t")) != F.col("want")).count() == 0


def test_dispersion_finds_a_rise_and_fall(spark):
    data = [("w", "mid" if 1996 <= y < 2000 else "rest", i, y) for i, y in enumerate([1990 + k % 14 for k in range(140)])]
    parts = {r.unit: r.dispersion for r in temporal.dispersion(rows(spark, data)).collect()}
    assert parts["mid"] > 0.15 and set(parts) == {"mid", "rest"}
    assert temporal.dispersion(rows(spark, data[:10])).count() == 0


def test_text_order(spark):
    labels = ["II", "I", "VI*", "Α", "Β", "α", "100b", "100a", "99e", "2.10", "2.9", "1.30"]
    df = spark.createDataFrame([(x, i // 3) for i, x in enumerate(labels)], "label string, g int")
    got = [r.label for r in df.orderBy("g", shapes.text_order(F.col("label"))).collect()]
    assert got == ["I", "II", "VI*", "Α", "α", "Β", "99e", "100a", "100b", "1.30", "2.9", "2.10"]
    pooled = spark.createDataFrame([("B:2",), ("A:10",), ("A:9",)], "label string")
    assert [r.label for r in pooled.orderBy(shapes.text_order(F.col("label"))).collect()] == ["A:9", "A:10", "B:2"]
