"""Interval operators, order statistics and copy-number pieces against brute force."""

import random
import statistics

from pyspark.sql import functions as F

from genoweave.operators import copynumber as cn
from genoweave.operators import intervals
from genoweave.operators.intervals import LEVEL_BITS, READ_BITS, Span
from genoweave.operators.quantiles import in_ranges, order_statistics


def spans(spark, n, p, seed):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        s = r.randrange(0, 3_000_000)
        rows.append((r.choice("ab"), s, s + r.choice([1, 2, 30, 5000, 20000, 200000, 50_000_000]), i))
    return rows, spark.createDataFrame(rows, f"{p}c string, {p}s long, {p}e long, {p}i long")


def test_overlap_join_equals_brute_force(spark):
    lr, left = spans(spark, 150, "l", 1)
    rr, right = spans(spark, 120, "r", 2)
    want = sorted((a[3], b[3]) for a in lr for b in rr if a[0] == b[0] and a[1] < b[2] and b[1] < a[2])
    for bits in (LEVEL_BITS, READ_BITS):
        got = intervals.overlap_join(left, right, Span("lc", "ls", "le"), Span("rc", "rs", "re"), bits).select("li", "ri").collect()
        assert sorted(map(tuple, got)) == want


def merge(rows, slack):
    out = []
    for s, e in sorted(rows):
        if out and s <= out[-1][1] + slack:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return sorted(map(tuple, out))


def test_merge_across_bins(spark):
    r = random.Random(3)
    rows = [(s := r.randrange(0, 5000), s + r.choice([1, 3, 40, 900])) for _ in range(120)]
    df = spark.createDataFrame([("k", *x) for x in rows], "k string, start long, end long")
    for slack in (0, 1):
        got = intervals.merge_intervals(df, ["k"], slack=slack, width=64).select("start", "end").collect()
        assert sorted(map(tuple, got)) == merge(rows, slack)
        got = intervals.merge_bounded(df, ["k"], slack=slack).select("start", "end").collect()
        assert sorted(map(tuple, got)) == merge(rows, slack)


def test_chain_clusters(spark):
    pos = [1, 4, 9, 15, 16, 70000, 70005, 140000]
    df = spark.createDataFrame([("c", p) for p in pos], "rname string, left long")
    got = {r["left"]: r["cluster"] for r in intervals.chain_clusters(df, ["rname"], "left", 5).collect()}
    assert got == {1: 1, 4: 1, 9: 1, 15: 15, 16: 15, 70000: 70000, 70005: 70000, 140000: 140000}


def test_order_statistics_of_a_hot_group(spark):
    r = random.Random(5)
    hot = [r.choice([0.0, 1.0, r.random() * 100]) for _ in range(3001)]
    rows = [("hot", x) for x in hot] + [("one", 4.0)]
    got = {r["k"]: r for r in order_statistics(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", {"lo": 0.005, "mid": 0.5, "top": 1.0}).collect()}
    assert abs(got["hot"]["mid"] - statistics.median(hot)) < 1e-12 and got["hot"]["top"] == max(hot)
    assert got["one"]["lo"] == 4.0


def test_ranges_of_a_hot_group_stay_bounded(spark):
    """A group of 400,000 distinct values is dealt to as many ranges as its size asks for."""
    df = spark.range(400_000).select(F.when(F.col("id") % 100 == 0, "cold").otherwise("hot").alias("k"), ((F.col("id") * 7919) % 400_009).cast("double").alias("v"))
    counted = df.groupBy("k", "v").agg(F.count("*").alias("_n"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for size, ranges in ((20_000, max(20, partitions)), (200_000, max(2, partitions))):
        sizes = [r["count"] for r in in_ranges(counted, ["k"], "v", size).groupBy("_bucket").count().collect()]
        assert sum(sizes) == 400_000 and len(sizes) >= ranges * 0.8 and max(sizes) < 2.5 * 400_000 / ranges
    got = {r["k"]: r for r in order_statistics(df, ["k"], "v", {"low": 0.001, "mid": 0.5, "top": 0.999}, rows_per_task=20_000).collect()}
    true = {"hot": [], "cold": []}
    for i in range(400_000):
        true["hot" if i % 100 else "cold"].append(float(i * 7919 % 400_009))
    for k, values in true.items():
        values.sort()
        for name, fraction in (("low", 0.001), ("mid", 0.5), ("top", 0.999)):
            place = (len(values) - 1) * fraction
            low = values[int(place)]
            high = values[min(int(place) + 1, len(values) - 1)]
            assert abs(got[k][name] - (low + (high - low) * (place - int(place)))) < 1e-6
    empty = spark.createDataFrame([("a", None)], "k string, v double")
    assert order_statistics(empty, ["k"], "v", {"mid": 0.5}).count() == 0


def test_nearest_gc_equals_full_sort(spark):
    r = random.Random(6)
    rows = [("s", f"c{r.randrange(4)}", i, r.randrange(12) / 20, float(r.randrange(50))) for i in range(90)]
    df = spark.createDataFrame(rows, "sample string, chrom string, ordinal long, gc double, depth double")
    got = {x["ordinal"]: x["expected_depth"] for x in cn.nearest_gc_depth(df, k=7, block=5).collect()}
    for _, chrom, o, gc, _ in rows:
        near = sorted((x for x in rows if x[1] != chrom), key=lambda x: (abs(x[3] - gc), x[2]))[:7]
        assert got[o] == statistics.median(x[4] for x in near)


def test_mixture_values(spark):
    def rows(name, parts):
        return [(name, s, f) for s, f in parts.items()]
    df = spark.createDataFrame(rows("m", {"AB": 0.6, "AAB": 0.1, "ABB": 0.1, "A": 0.1, "B": 0.1}), "scenario string, state string, fraction double")
    r = cn.mixture_expectations(df).first()
    assert [round(r[c], 9) for c in ("a_copies", "b_copies", "relative_rd", "baf_b")] == [1, 1, 1, 0.5]
    cells = spark.createDataFrame(rows("m", {"AB": 160, "AAB": 11, "ABB": 11, "A": 9, "B": 9}), "scenario string, state string, cells long")
    r = cn.cell_enumeration(cells).first()
    assert [round(r[c], 9) for c in ("a_copies", "b_copies", "relative_rd", "baf_b")] == [1.01, 1.01, 1.01, 0.5]


def test_masked_bins(spark):
    df = spark.createDataFrame([(0.9, 0.0, 0.0, 0.0), (0.5, 0.2, 0.02, 0.1)], "unique_fraction double, segdup_fraction double, gap_fraction double, centromere_fraction double")
    got = [r["mask_reasons"] for r in cn.mask_bins(df).orderBy(F.desc("unique_fraction")).collect()]
    assert got == [[], ["low_unique_mappability", "segmental_duplication", "assembly_gap", "centromere"]]
