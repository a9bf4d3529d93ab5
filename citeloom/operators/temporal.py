"""Shift analysis: early/late shares, shape metrics, permutation nulls, dispersion, verdicts.

A unit row is (work, unit, iid, year) with a dated integer year. Shares use distinct articles for each
unit, over the sum of incidences. Grain, journal set and work are columns: everything runs for all
combinations at once.

The permutation nulls are exact and spread out: a work's (unit, article) pairs are dealt into chunks by
hash, the labels of a permutation are dealt to the chunks with their hypergeometric numbers, and each
chunk shuffles its own. Distinct articles of a unit add up over chunks, so no task holds a work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.operators.windows import average_rank, q_values

LEAST_ARTICLES = 15
PERMUTATIONS = 200
#: Citation rows that a task of a permutation null shuffles at once.
CHUNK_ROWS = 50_000


def period_cuts(years: DataFrame, periods: int) -> DataFrame:
    """Equal-count cuts of sorted years (column ``ys``): ys[min(n - 1, i * n div periods)]."""
    ys = F.sort_array("ys")
    n = F.size("ys")
    cut = lambda i: F.get(ys, F.least(n - 1, F.floor(i * n / periods)).cast("int"))
    return years.withColumn("cuts", F.array(*(cut(i) for i in range(1, periods))))


def work_cuts(rows: DataFrame, periods: int) -> DataFrame:
    """work, cuts: the same cuts of each work's rows, from year counts (never from a list of rows). Works
    need 5 rows a period."""
    counts = rows.groupBy("work", "year").agg(F.count("*").alias("n"))
    run = Window.partitionBy("work").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"run": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy("work"))}).where(F.col("total") >= 5 * periods)
    place = lambda i: F.least(F.col("total") - 1, F.call_function("div", i * F.col("total"), F.lit(periods)))
    cuts = [F.min(F.when(F.col("run") > place(i), F.col("year"))) for i in range(1, periods)]
    return placed.groupBy("work").agg(F.array(*cuts).alias("cuts"))


def units_to_half(units: DataFrame, value: str, tie: str) -> DataFrame:
    """For each work the least number of units, largest first, that hold half of the total."""
    order = Window.partitionBy("work").orderBy(F.desc(value), tie).rowsBetween(Window.unboundedPreceding, 0)
    marked = units.withColumns({"__run": F.sum(value).over(order), "__k": F.row_number().over(Window.partitionBy("work").orderBy(F.desc(value), tie)), "__half": F.sum(value).over(Window.partitionBy("work")) / 2.0})
    return marked.where("__run >= __half").groupBy("work").agg(F.min("__k").alias("units"))


def split_years(rows: DataFrame) -> DataFrame:
    """work, split_year: the upper median of a work's years, from year counts (never from a list of rows)."""
    counts = rows.groupBy("work", "year").agg(F.count("*").alias("n"))
    run = Window.partitionBy("work").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"run": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy("work"))})
    return placed.where(F.col("run") > F.floor(F.col("total") / 2)).groupBy("work").agg(F.min("year").alias("split_year"))


def early_late(rows: DataFrame) -> DataFrame:
    """work, unit, early, late, share_early, share_late, delta: distinct articles before and from the split year."""
    split = rows.join(split_years(rows), "work")
    late = F.col("year") >= F.col("split_year")
    units = split.groupBy("work", "unit").agg(F.countDistinct(F.when(~late, F.col("iid"))).alias("early"), F.countDistinct(F.when(late, F.col("iid"))).alias("late"))
    whole = Window.partitionBy("work")
    share = lambda v: F.col(v) / F.greatest(F.sum(v).over(whole), F.lit(1))
    return units.withColumns({"share_early": share("early"), "share_late": share("late")}).withColumn("delta", F.col("share_late") - F.col("share_early"))


def correlation(a: str, b: str) -> Column:
    """Pearson over a group; null below two rows or without variance (corr() itself raises there)."""
    return F.when(F.count("*") > 1, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def shape(shifts: DataFrame) -> DataFrame:
    """work, n_units, incidences, spearman (null below two units or without variance), tvd."""
    ranked = shifts.withColumns({"__a": average_rank("share_early", "work"), "__b": average_rank("share_late", "work")})
    return ranked.groupBy("work").agg(
        F.count("*").alias("n_units"),
        F.sum(F.col("early") + F.col("late")).alias("incidences"),
        correlation("__a", "__b").alias("spearman"),
        (0.5 * F.sum(F.abs("delta"))).alias("tvd"),
    )


def gated(shifts: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    return shifts.where(F.col("early") + F.col("late") >= least)


def _shuffled(labelled: DataFrame, labels: int, n_perm: int, seed: int) -> DataFrame:
    """work, unit, perm, n (articles under each label): rows (work, unit, iid, label) with their labels
    shuffled over the work's rows ``n_perm`` times."""
    pairs = labelled.groupBy("work", "unit", "iid").agg(F.count("*").alias("m"))
    totals = labelled.groupBy("work").agg(F.count("*").alias("rows"), F.array(*(F.count_if(F.col("label") == k) for k in range(labels))).alias("totals"))
    chunks = F.greatest(F.ceil(F.col("rows") / CHUNK_ROWS), F.lit(1))
    pairs = pairs.join(totals.select("work", chunks.alias("chunks")), "work").withColumn("chunk", F.pmod(F.xxhash64("unit", "iid"), F.col("chunks")))
    sizes = pairs.groupBy("work", "chunk").agg(F.sum("m").alias("size")).join(totals.select("work", "totals"), "work")

    def deal(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        """How many of each label a chunk gets in each permutation."""
        frame = frame.sort_values("chunk")
        rng = np.random.default_rng([seed, sum(key[0].encode())])
        left = np.tile(np.array(frame["totals"].iloc[0], np.int64), (n_perm, 1))
        given = np.zeros((len(frame), n_perm, labels), np.int64)
        for i, size in enumerate(frame["size"]):
            given[i] = left if i == len(frame) - 1 else [rng.multivariate_hypergeometric(x, size) for x in left]
            left = left - given[i]
        return pd.DataFrame({"work": key[0], "chunk": frame["chunk"], "given": [g.ravel() for g in given]})

    dealt = sizes.groupBy("work").applyInPandas(deal, "work string, chunk long, given array<long>")  # a row a chunk

    def shuffle(key: tuple, frame: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["unit", "iid"])
        unit, names = pd.factorize(frame["unit"])
        pair = np.repeat(np.arange(len(frame)), frame["m"])
        begin = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
        rng = np.random.default_rng([seed, int(key[1]), sum(key[0].encode())])
        out = np.zeros((len(names), n_perm, labels), np.int32)
        for k, given in enumerate(np.array(dealt["given"].iloc[0], np.int64).reshape(n_perm, labels)):
            seen = np.zeros(len(frame) * labels, bool)
            seen[pair * labels + rng.permutation(np.repeat(np.arange(labels), given))] = True
            out[:, k] = np.add.reduceat(seen.reshape(-1, labels), begin, axis=0, dtype=np.int32)
        return pd.DataFrame({"work": key[0], "unit": names, "n": [x.ravel() for x in out]})

    parts = pairs.select("work", "chunk", "unit", "iid", "m").groupBy("work", "chunk").cogroup(dealt.groupBy("work", "chunk")).applyInPandas(shuffle, "work string, unit string, n array<int>")
    one = F.transform(F.sequence(F.lit(0), F.lit(n_perm - 1)), lambda k: F.slice("n", k * labels + 1, F.lit(labels)))
    spread = parts.select("work", "unit", F.posexplode(one).alias("perm", "n"))
    return spread.groupBy("work", "unit", "perm").agg(F.array(*(F.sum(F.get("n", F.lit(k))) for k in range(labels))).alias("n"))


def _shares(counts: DataFrame, labels: int) -> DataFrame:
    """``counts`` with s0, s1 and so on: each unit's share of its work's incidences under each label."""
    whole = Window.partitionBy("work", "perm")
    n = [F.get("n", F.lit(k)) for k in range(labels)]
    return counts.withColumns({f"s{k}": x / F.greatest(F.sum(x).over(whole), F.lit(1)) for k, x in enumerate(n)})


def two_bin_null(rows: DataFrame, n_perm: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """work, unit, perm, share_early, share_late, delta with the late labels shuffled over citation rows."""
    late = rows.join(split_years(rows), "work").select("work", "unit", "iid", (F.col("year") >= F.col("split_year")).cast("int").alias("label"))
    shares = _shares(_shuffled(late, 2, n_perm, seed), 2)
    return shares.select("work", "unit", "perm", F.col("s0").alias("share_early"), F.col("s1").alias("share_late"), (F.col("s1") - F.col("s0")).alias("delta"))


def permutation_null(rows: DataFrame, n_perm: int = PERMUTATIONS, seed: int = 0, null: DataFrame | None = None) -> DataFrame:
    """work, unit, delta, p, n_perm: how often a shuffled share change is as large as the observed one."""
    seen = early_late(rows).select("work", "unit", F.col("delta").alias("seen"))
    null = two_bin_null(rows, n_perm, seed) if null is None else null
    hit = F.abs("delta") >= F.abs("seen") - 1e-12
    hits = null.join(seen, ["work", "unit"]).groupBy("work", "unit").agg(F.first("seen").alias("delta"), F.count_if(hit).alias("hits"), F.count("*").alias("n_perm"))
    return hits.select("work", "unit", "delta", ((F.col("hits") + 1) / (F.col("n_perm") + 1)).alias("p"), "n_perm")


def gated_units(rows: DataFrame, least: int = LEAST_ARTICLES) -> DataFrame:
    """work, unit of the units with ``least`` distinct articles: the ones that are tested."""
    return rows.groupBy("work", "unit").agg(F.countDistinct("iid").alias("__n")).where(F.col("__n") >= least).select("work", "unit")


def permutation_q(rows: DataFrame, n_perm: int = PERMUTATIONS, least: int = LEAST_ARTICLES) -> DataFrame:
    """permutation_null's columns with q, of the gated units; q is over these alone."""
    return q_values(permutation_null(rows, n_perm).join(gated_units(rows, least), ["work", "unit"], "left_semi"), ["work"], "p", "unit")


def shape_null(rows: DataFrame, n_perm: int = PERMUTATIONS, seed: int = 0) -> DataFrame:
    """work, spearman, tvd, and against their null: rho_mean, rho_sd, rho_z, tvd_mean, tvd_sd, tvd_z and
    tvd_percentile (the share of shuffles, in percent, whose tvd is not larger)."""
    null = two_bin_null(rows, n_perm, seed)
    ranked = null.withColumns({"__a": average_rank("share_early", "work", "perm"), "__b": average_rank("share_late", "work", "perm")})
    each = ranked.groupBy("work", "perm").agg(correlation("__a", "__b").alias("rho"), (0.5 * F.sum(F.abs("delta"))).alias("t"))
    seen = shape(early_late(rows)).select("work", "spearman", "tvd")
    moments = [F.avg("rho").alias("rho_mean"), F.stddev_pop("rho").alias("rho_sd"), F.avg("t").alias("tvd_mean"), F.stddev_pop("t").alias("tvd_sd")]
    below = (100.0 * F.count_if(F.col("t") <= F.col("tvd") + 1e-12) / F.count("*")).alias("tvd_percentile")
    out = each.join(seen, "work").groupBy("work", "spearman", "tvd").agg(*moments, below)
    return out.withColumns({"rho_z": z_score(F.col("spearman"), F.col("rho_mean"), F.col("rho_sd")), "tvd_z": z_score(F.col("tvd"), F.col("tvd_mean"), F.col("tvd_sd"))})


def _in_periods(rows: DataFrame, periods: int) -> DataFrame:
    """rows of works with enough of them, with ``label``: the equal-count period of the year."""
    period = F.aggregate("cuts", F.lit(0), lambda n, cut: n + F.when(F.col("year") >= cut, 1).otherwise(0))
    return rows.join(work_cuts(rows, periods), "work").withColumn("label", period)


def _spread_of(shares: DataFrame, periods: int) -> DataFrame:
    """``dispersion`` from s0, s1 and so on: the mean over pairs of periods of half the absolute difference."""
    pairs = [(a, b) for a in range(periods) for b in range(a + 1, periods)]
    mean = sum((F.abs(F.col(f"s{a}") - F.col(f"s{b}")) for a, b in pairs), F.lit(0.0)) * 0.5 / len(pairs)
    return shares.withColumn("dispersion", mean)


def dispersion(rows: DataFrame, periods: int = 3) -> DataFrame:
    """work, unit, dispersion: mean over pairs of periods of half the absolute share difference.

    A work's parts sum to its mean pairwise total variation distance. Works need 5 rows a period.
    """
    n = [F.countDistinct(F.when(F.col("label") == k, F.col("iid"))) for k in range(periods)]
    counts = _in_periods(rows, periods).groupBy("work", "unit").agg(F.array(*n).alias("n")).withColumn("perm", F.lit(0))
    return _spread_of(_shares(counts, periods), periods).select("work", "unit", "dispersion")


def dispersion_null(rows: DataFrame, periods: int = 3, n_perm: int = PERMUTATIONS, seed: int = 1) -> DataFrame:
    """work, unit, dispersion, p of every unit, and of its work whole, null_mean, null_sd, z: the periods'
    labels are shuffled over citation rows."""
    null = _spread_of(_shares(_shuffled(_in_periods(rows, periods).select("work", "unit", "iid", "label"), periods, n_perm, seed), periods), periods)
    null = null.select("work", "unit", "perm", F.col("dispersion").alias("shuffled"))
    seen = dispersion(rows, periods)
    hits = null.join(seen, ["work", "unit"]).groupBy("work", "unit", "dispersion").agg(((F.count_if(F.col("shuffled") >= F.col("dispersion") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    each = null.groupBy("work", "perm").agg(F.sum("shuffled").alias("w")).groupBy("work").agg(F.avg("w").alias("null_mean"), F.stddev_pop("w").alias("null_sd"))
    whole = seen.groupBy("work").agg(F.sum("dispersion").alias("whole")).join(each, "work")
    z = z_score(F.col("whole"), F.col("null_mean"), F.col("null_sd")).alias("z")
    return hits.join(whole.select("work", "whole", "null_mean", "null_sd", z), "work")


def concentration(parts: DataFrame, value: str = "dispersion") -> DataFrame:
    """Shares of a work's total in its largest 1, 3, 5 and 10 units, and units to half."""
    order = Window.partitionBy("work").orderBy(F.desc(value), "unit")
    total = F.sum(value).over(Window.partitionBy("work"))
    ranked = parts.withColumns({"__k": F.row_number().over(order), "__total": total})
    top = [(F.sum(F.when(F.col("__k") <= k, F.col(value)).otherwise(0.0)) / F.first("__total")).alias(f"top{k}") for k in (1, 3, 5, 10)]
    return ranked.where("__total > 0").groupBy("work").agg(*top).join(units_to_half(parts, value, "unit"), "work")


def verdict(z: Column) -> Column:
    """REAL from 3, marginal from 1.5, else stable; a z that doesn't exist is stable."""
    z = F.when(F.isnan(z), None).otherwise(z)
    return F.when(z >= 3, "REAL").when(z >= 1.5, "marginal").otherwise("stable")


def z_score(observed: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, (observed - mean) / deviation)


def movers(tests: DataFrame, least_early: int = 8) -> DataFrame:
    """Flags of tested units: raw p below .05, q below .10, too few early articles."""
    return tests.withColumns(
        {"raw": F.col("p") < 0.05, "strong": F.col("q") < 0.10, "floor_fail_early": F.col("early") < least_early}
    )


#: Articles and tested units that make a stable verdict a finding; the distance to a threshold.
POWERED_ARTICLES, POWERED_UNITS, NEAR = 100, 3, 1.0


def verdicts(works: DataFrame) -> DataFrame:
    """works (work, tvd_z, structure_z, n_articles, n_tested) with verdict, two_bin_flat_only,
    two_bin_understates, stability_powered and near_threshold."""
    real = lambda z: F.coalesce(F.when(F.isnan(z), None).otherwise(z) >= 3, F.lit(False))
    z = F.col("tvd_z")
    out = works.withColumn("verdict", verdict(z))
    near = lambda t: F.coalesce(F.abs(z - t) <= NEAR, F.lit(False))
    return out.withColumns(
        {
            "two_bin_flat_only": (F.col("verdict") == "stable") & real(F.col("structure_z")),
            "two_bin_understates": (F.col("verdict") != "REAL") & real(F.col("structure_z")),
            "stability_powered": (F.col("verdict") == "stable") & (F.col("n_articles") >= POWERED_ARTICLES) & (F.col("n_tested") >= POWERED_UNITS),
            "near_threshold": near(1.5) | near(3.0),
        }
    )


def structure(n_fdr: Column, top5: Column, units_to_half_: Column, n_tested: Column) -> Column:
    """Who carries a structure: hero (units survive and five hold 40 %), diffuse (none survives and many
    share half of it), both (units survive, the rest is spread), else weak."""
    many = F.greatest(F.lit(8.0), 0.15 * n_tested)
    return F.when((n_fdr >= 1) & (top5 >= 0.40), "hero").when((n_fdr == 0) & (units_to_half_ >= many), "diffuse").when(n_fdr >= 1, "both").otherwise("weak")


def collision_pattern(journals: Column, top_share: Column) -> Column:
    """How colliding ids are spread: B in three journals at most, A over five or more without a large one, else mixed."""
    return F.when(journals <= 3, "B").when((top_share < 0.35) & (journals >= 5), "A").otherwise("mixed")
