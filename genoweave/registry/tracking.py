"""Molecular tracks, junctions and score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from genoweave.operators import tracks
from genoweave.registry.core import query


def side(v, n):
    return v("v_tracks").filter(F.col("side") == n).select("track", "coord", F.col("v").alias("value"))


OUTER = """(select coalesce(r.track,a.track) track, coalesce(r.coord,a.coord) coord, r.v rv, a.v av, r.v is not null in_ref, a.v is not null in_alt from (select * from v_tracks where side=0) r full outer join (select * from v_tracks where side=1) a on r.track=a.track and r.coord=a.coord)"""


def aligned(v):
    return tracks.align_junctions(side(v, 0), side(v, 1), ["track", "coord"])


@query("J17_junction_outer", f"select track, coord, rv ref_value, av alt_value, av-rv delta, in_ref returned_in_ref, in_alt returned_in_alt from {OUTER}")
def j17(v):
    return aligned(v)


@query("A37_junction_summary", f"select track, count(*) junction_rows, count(*) filter (where in_ref and in_alt) matched, count(*) filter (where not (in_ref and in_alt)) unmatched, max(abs(av-rv)) max_abs_delta, count(*) filter (where abs(av-rv)>1) abs_delta_above_1 from {OUTER} group by track")
def a37(v):
    return tracks.junction_summary(aligned(v), ["track"])


@query("M1_junction_coordinates", "select event_type track, case when event_id%2=0 then 'chr'||cast(user_id%5+1 as varchar) else 'chr9' end chrom, sum(event_id%1000+case when event_id%2=0 then 0 else 5000 end) start_sum, count(*) n from events group by 1,2")
def m1(v):
    e = v.table("events")
    even = F.col("event_id") % 2 == 0
    j = e.select(F.col("event_type").alias("track"), F.when(even, F.concat(F.lit("chr"), F.col("user_id") % 5 + 1)).alias("chrom"), (F.col("event_id") % 1000).alias("start"), (F.col("event_id") % 1000 + 10).alias("end"))
    meta = e.select(F.col("event_type").alias("track")).distinct().select("track", F.lit("chr9").alias("m_chrom"), F.lit(5000).alias("m_start"), F.lit(7000).alias("m_end"))
    return tracks.genomic_junctions(j, meta, ["track"]).groupBy("track", "chrom").agg(F.sum("start").alias("start_sum"), F.count("*").alias("n"))


def meta(v, n):
    t = v("v_tracks").groupBy("track").agg(F.min("coord").alias("start"), F.max("coord").alias("end"), F.count_distinct("coord").alias("positions"))
    return t.select(F.lit("s").alias("scenario"), "track", F.lit("chr1").alias("chrom"), "start", "end", F.lit(1).alias("resolution"), "positions")


@query("M2_track_comparability", "select track, min(coord) \"start\", max(coord) \"end\", count(distinct coord) positions from v_tracks group by track")
def m2(v):
    return tracks.comparable_tracks(meta(v, 0), meta(v, 1)).select("track", "start", "end", "positions")


LIMITS = {"click": ("unaligned_positions", "diagnostic_only"), "view": ("same_positions", "same_position_comparison"), "error": ("constructed", "conditional"), "purchase": ("same_positions", "same_position_comparison"), "signup": ("same_positions", "same_position_comparison")}


@query("M3_coordinate_labels", "select track scenario, case track when 'click' then 'unaligned_positions' when 'error' then 'constructed' else 'same_positions' end coordinate_system, count(*) n from v_tracks group by 1,2")
def m3(v):
    rows = v("v_tracks").withColumnRenamed("track", "scenario")
    return tracks.label_coordinates(rows, LIMITS).groupBy("scenario", "coordinate_system").agg(F.count("*").alias("n"))


@query("M4_track_inventory", "select track scenario, 'm'||cast(side as varchar) mode, 'u' track, count(*) filter (where coord%2=0) values_returned, case when count(*) filter (where coord%2=0)=0 then 'no returned values, not absence' else 'returned' end meaning from v_tracks group by 1,2")
def m4(v):
    rows = v("v_tracks").select(F.col("track").alias("scenario"), F.concat(F.lit("m"), "side").alias("mode"), F.lit("u").alias("track"), F.when(F.col("coord") % 2 == 0, F.col("v")).alias("value"))
    return tracks.track_inventory(rows)


FEATURE = "(select src_row, unnest([pl0+0.5,pl1*-1.0,pl2+0.25,ad0*1.0,ad1*-1.5]) s, unnest(['f0','f1','f2','f3','f4']) f from v_calls)"


@query("M5_feature_contributions", f"select src_row, f feature, cast(s as double) score, r \"rank\" from (select *, row_number() over (partition by src_row order by abs(s) desc, f) r from {FEATURE}) where r<=2")
def m5(v):
    c = v("v_calls").select("src_row", (F.col("pl0") + 0.5).alias("f0"), (-F.col("pl1")).alias("f1"), (F.col("pl2") + 0.25).alias("f2"), F.col("ad0").alias("f3"), (F.col("ad1") * -1.5).alias("f4"))
    out = tracks.feature_contributions(c, ["src_row"], ("f0", "f1", "f2", "f3", "f4"), k=2)
    return out.select("src_row", "feature", "score", F.col("rank").cast("long").alias("rank"))


@query("M6_array_audit", "select track, count(*) \"values\", count(*) filter (where coord%7=0) not_finite from v_tracks group by track")
def m6(v):
    rows = v("v_tracks").select("track", F.when(F.col("coord") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("v").cast("double")).alias("value"))
    return tracks.array_audit(rows, ["track"])


def long_values(v):
    return v("v_tracks").select("track", "coord", F.when(F.col("side") == 0, "ref").otherwise("alt").alias("side"), F.col("v").cast("double").alias("value"))


@query("A34_track_comparison", f"""select track, cast(sum(rv) as double) ref_sum, cast(sum(av) as double) alt_sum, cast(max(abs(av-rv)) as double) max_abs_delta, round(avg(abs(av-rv)),6) mean_abs_delta, count(*) positions, round(case when sum(rv)>0 then sum(av)*1.0e0/sum(rv) end,6) sum_ratio from {OUTER} where coord between 100 and 700 group by track""")
def a34(v):
    t = tracks.compare_tracks(long_values(v), ["track"], 100, 700)
    return t.select("track", "ref_sum", "alt_sum", "max_abs_delta", F.round("mean_abs_delta", 6).alias("mean_abs_delta"), "positions", F.round("sum_ratio", 6).alias("sum_ratio"))


EXON = "(coord+1 between 101 and 180 or coord+1 between 150 and 240 or coord+1 between 400 and 460)"


@query("A35_exon_masked_mean", f"""select track, count(distinct coord) exonic_bases, round(avg(v) filter (where side=0),6) ref_mean, round(avg(v) filter (where side=1),6) alt_mean, round(avg(v) filter (where side=1)/avg(v) filter (where side=0),6) alt_ref_ratio, round(ln(avg(v) filter (where side=1)+0.001)-ln(avg(v) filter (where side=0)+0.001),6) ln_ratio from v_tracks where {EXON} group by track""")
def a35(v):
    x = v.spark.createDataFrame([("chr1", 101, 180), ("chr1", 150, 240), ("chr1", 400, 460)], "e_contig string, e_start long, e_end long")
    m = tracks.exon_means(long_values(v).withColumn("contig", F.lit("chr1")), x, ["track"])
    return m.select("track", "exonic_bases", *[F.round(c, 6).alias(c) for c in ("ref_mean", "alt_mean", "alt_ref_ratio", "ln_ratio")])


@query("A35_ratio_range", f"select min(r) min_ratio, max(r) max_ratio, count(*) tracks from (select round(avg(v) filter (where side=1)/avg(v) filter (where side=0),6) r from v_tracks where {EXON} group by track)")
def a35b(v):
    m = a35(v).withColumn("scenario", F.lit("s"))
    return tracks.ratio_range(m, ["scenario"]).drop("scenario")


SCORES = "(select event_type mode, event_id, 'G'||cast(user_id%20 as varchar) gene, value-50 score, (event_id%1000)/1000.0e0 q from events)"


def scores(v):
    return v.table("events").select(F.col("event_type").alias("mode"), "event_id", F.concat(F.lit("G"), F.col("user_id") % 20).alias("gene"), (F.col("value") - 50).alias("score"), ((F.col("event_id") % 1000) / 1000.0).alias("quantile"))


@query("A36_score_summary", f"""select mode, count(*) all_rows, count(*) filter (where gene='G3') target_rows, round(max(abs(score)),6) max_abs_all, round(max(abs(score)) filter (where gene='G3'),6) max_abs_target, count(*) filter (where abs(q)>0.995) high_quantile_rows, count(*) filter (where abs(q)>0.995 and gene='G3') target_high_quantile_rows from {SCORES} group by mode""")
def a36(v):
    s = tracks.score_summary(scores(v), ["mode"], "G3")
    return s.select("mode", "all_rows", "target_rows", F.round("max_abs_all", 6).alias("max_abs_all"), F.round("max_abs_target", 6).alias("max_abs_target"), "high_quantile_rows", "target_high_quantile_rows")


@query("T3_top_scores", f"select mode, event_id, r \"rank\" from (select *, row_number() over (partition by mode order by abs(score) desc, event_id) r from {SCORES}) where r<=15")
def t3(v):
    return tracks.top_scores(scores(v), ["mode"], 15, ["event_id"]).select("mode", "event_id", F.col("rank").cast("long").alias("rank"))
