"""Hot keys: one merchant / one value / one group holding a third or more of the rows.
Results must stay exact (nothing dropped, capped or sampled); checked by brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cardsight.operators import distribution, evaluate, explore, ordered, threshold


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(42)
    rows = []
    for i in range(6000):
        hot = i % 3 == 0                                   # a third of all rows
        merchant = "m_hot" if hot else f"m{rng.randint(0, 500)}"
        amt = 10.0 if hot else round(rng.expovariate(1 / 80), 2)   # and one repeated value
        y = 1 if (amt > 200 or rng.random() < 0.02) else 0
        rows.append((i, merchant, amt, y))
    return rows, spark.createDataFrame(rows, "id long, merchant string, amt double, y int").repartition(6)


def test_value_counts_hot_key(skewed):
    rows, df = skewed
    got = {r.value: r["count"] for r in distribution.value_counts(df, ["merchant"]).collect()}
    assert got == dict(Counter(r[1] for r in rows))


def test_box_stats_hot_value(skewed):
    rows, df = skewed
    vals = sorted(r[2] for r in rows)
    r = explore.box_stats(df, ["amt"]).first()

    def pct(p):
        h = (len(vals) - 1) * p
        lo = math.floor(h)
        return vals[lo] + (h - lo) * (vals[min(lo + 1, len(vals) - 1)] - vals[lo])
    q1, med, q3 = pct(.25), pct(.5), pct(.75)
    assert (r.q1, r.median, r.q3) == pytest.approx((q1, med, q3), abs=1e-6)
    hi_fence = q3 + 1.5 * (q3 - q1)
    assert r.n_outliers == sum(1 for v in vals if v > hi_fence or v < q1 - 1.5 * (q3 - q1))
    assert r.n == len(vals)


def test_running_totals_skewed_groups(spark):
    rng = random.Random(5)
    rows = [("big", float(k), 1) for k in range(3000)] + [(f"g{i}", float(rng.random()), 2) for i in range(40)]
    df = spark.createDataFrame(rows, "g string, k double, v long")
    ours = ordered.running_totals(df, "k", ["v"], by=["g"], ranges=7)
    ref = df.withColumn("ref", F.sum("v").over(Window.partitionBy("g").orderBy("k")))
    assert ours.join(ref, ["g", "k"]).where(F.col("v_cum") != F.col("ref")).count() == 0
    assert ours.count() == len(rows)


def test_auc_with_hot_score(skewed):
    rows, df = skewed
    # brute force: P(score_pos > score_neg) + 0.5 P(tie) over all pairs
    pos = [r[2] for r in rows if r[3] == 1]
    neg = sorted(r[2] for r in rows if r[3] == 0)
    import bisect
    wins = sum(bisect.bisect_left(neg, p) + 0.5 * (bisect.bisect_right(neg, p) - bisect.bisect_left(neg, p))
               for p in pos)
    assert evaluate.roc_auc(df, "y", "amt").first().auc == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-9)


def test_kde_hot_value_brute_force(skewed):
    rows, df = skewed
    xs = [r[2] for r in rows]
    n = len(xs)
    mean = sum(xs) / n
    sd = math.sqrt(sum((x - mean) ** 2 for x in xs) / (n - 1))
    bw = sd * n ** -0.2
    lo, hi = min(xs) - 3 * bw, max(xs) + 3 * bw
    got = {r.grid_index: r.density for r in explore.kde(df, ["amt"], grid_size=50).collect()}
    for j in (0, 7, 25, 49):
        g = lo + j * (hi - lo) / 49
        ref = sum(math.exp(-0.5 * ((g - x) / bw) ** 2) for x in xs) / (n * bw * math.sqrt(2 * math.pi))
        assert got[j] == pytest.approx(ref, abs=1e-8)


def test_sweep_hot_value_on_cutoff(spark):
    # a third of the scores sit exactly on a cut-off: strict > keeps them negative there
    rows = [(i, 1 if i % 2 else 0, 0.5 if i % 3 == 0 else (i % 97) / 97.0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y int, s double")
    sweep = {r.threshold_index: r for r in threshold.threshold_sweep(df, "y", "s").collect()}
    for i in range(36):
        t = 0.1 + 0.025 * i
        tp = sum(1 for _, y, s in rows if s > t and y == 1)
        fp = sum(1 for _, y, s in rows if s > t and y == 0)
        assert (sweep[i].tp, sweep[i].fp) == (tp, fp)
