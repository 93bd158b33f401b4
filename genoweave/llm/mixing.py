"""Mixing sources to target weights by entropy balancing.

Rates of documents are the prior rates tilted exponentially, ``rate = min(cap, prior * exp(l))``,
with one multiplier ``l`` per constraint group; they are the least change, by relative entropy,
that meets every group's token target. Newton iterations solve the convex dual; each one is an
aggregate over the strata (group, prior) with their token sums, which all documents were summed
into first. Rates become copies by systematic rounding inside (group, size, hash bucket), so a
group's words miss its target by about one document at most, and a rerun gives the same copies.

Nothing is sent to one task but tables with one row per group. A hot group is ranked in buckets of
about ``BUCKET`` documents.

Defined results: a null group is a group of its own and last in order; size 0 (null or blank text)
takes 0 words; a group without words has target 0; an empty table gives an empty result; repeated
ids are ranked as separate rows in any order, which changes no sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from genoweave.llm.common import n_words
from genoweave.session import cut_lineage

BUCKET = 128
#: Rounds of rounding again, among ever shorter documents, what rounding put wrong.
REBALANCED = 3
#: Rates are compared and rounded in parts of this, so the last bits of a solver do not matter.
PARTS = 100_000_000


def water_fill(groups: DataFrame, total_share: float, cap: float) -> DataFrame:
    """(source, source_size, weight) to the same with ``target``: shares by weight, at most ``cap`` times the size.

    Groups stop in order of cap over weight; what they leave is shared by weight among the rest.
    One row per group: the window over all groups sees no documents.
    """
    w = Window.orderBy((F.col("source_size") / F.col("weight")), "position")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    x = groups.withColumn("_all", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("weight").over(everything))
    x = x.withColumn("_used", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumn("_gone", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    level = (F.col("_all") * F.lit(total_share) - F.col("_used") * F.lit(cap)) / (F.col("_weights") - F.col("_gone"))
    x = x.withColumn("_level", level).withColumn("_full", F.col("source_size") * F.lit(cap) <= F.col("weight") * F.col("_level"))
    # the first group that is not full sets the level for all after it
    open_level = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(Window.orderBy((F.col("source_size") / F.col("weight")), "position").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    x = x.withColumn("_open", open_level)
    target = F.when(F.col("_full"), F.col("source_size") * F.lit(cap)).otherwise(F.col("weight") * F.col("_open"))
    return x.withColumn("target", target.cast("double")).drop("_all", "_weights", "_used", "_gone", "_level", "_full", "_open")


def newton(strata: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-12, max_rounds: int = 60) -> DataFrame:
    """Multipliers (source, multiplier) that meet ``target`` of every group.

    ``strata`` is (source, prior, tokens). The dual's gradient of a group is the tokens that its
    rates give minus the target, its second derivative the tokens below the cap. A target at the
    cap's total has its multiplier at the least value where all rates are capped.
    """
    ready = strata.filter("tokens > 0 and prior > 0")
    start = ready.groupBy("source").agg(F.sum(F.col("tokens") * F.col("prior")).alias("base"), F.sum("tokens").alias("tokens"), F.min("prior").alias("least"))
    state = start.join(targets.select(F.col("source").alias("_t"), "target"), F.col("source").eqNullSafe(F.col("_t")))
    # without a cap the multiplier would be the lower bound; at the upper one every rate is capped
    low, high = F.log(F.col("target") / F.col("base")), F.log(F.lit(cap) / F.col("least"))
    none, full = F.col("target") <= 0, F.col("target") >= F.col("tokens") * F.lit(cap)
    first = F.when(none, F.lit(float("-inf"))).when(full, high).otherwise(F.least(F.greatest(F.lit(0.0), low), high))
    state = state.select("source", "target", first.alias("multiplier"), low.alias("low"), high.alias("high"), (none | full).alias("done"))
    state = cut_lineage(state)
    for _ in range(max_rounds):
        if state.filter("not done").limit(1).count() == 0:
            return state.select("source", "multiplier")
        open_state = state.filter("not done").withColumnRenamed("source", "_s")
        rate = F.col("prior") * F.exp("multiplier")
        step = (
            ready.join(open_state, F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("_s", "target", "multiplier", "low", "high")
            .agg(F.sum(F.col("tokens") * F.least(rate, F.lit(cap))).alias("given"), F.sum(F.when(rate < cap, F.col("tokens") * rate).otherwise(0.0)).alias("slope"))
        )
        short = F.col("given") < F.col("target")
        step = step.withColumn("low", F.when(short, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(short, F.col("high")).otherwise(F.col("multiplier")))
        newton_step = F.col("multiplier") + (F.col("target") - F.col("given")) / F.col("slope")
        # the cap bends the dual: a step that leaves the bracket is replaced by its middle
        inside = (F.col("slope") > 0) & (newton_step > F.col("low")) & (newton_step < F.col("high"))
        moved = F.when(inside, newton_step).otherwise((F.col("low") + F.col("high")) / 2)
        near = F.abs(F.col("given") - F.col("target")) <= F.lit(tolerance) * F.col("target")
        step = step.select("_s", F.when(near, F.col("multiplier")).otherwise(moved).alias("_moved"), F.col("low").alias("_low"), F.col("high").alias("_high"), near.alias("_near"))
        joined = state.join(step, F.col("source").eqNullSafe(F.col("_s")), "left")
        either = lambda a, b: F.coalesce(a, b).alias(b)
        state = cut_lineage(joined.select("source", "target", either("_moved", "multiplier"), either("_low", "low"), either("_high", "high"), (F.col("done") | F.coalesce("_near", F.lit(False))).alias("done")))
    raise RuntimeError("entropy balancing did not converge")


def mix(docs: DataFrame, weights: list[int], share: float = 1.5, cap: float = 2.0, prior: Column | None = None) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``rate`` and ``copies`` to documents (doc_id, text, source).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` times all
    words; none gets more than ``cap`` times its own. ``prior`` is a positive rate per document
    (1 if not given); ``copies`` is the rate rounded down or up.
    """
    prior = F.lit(1.0) if prior is None else prior
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), prior.cast("double").alias("prior"))
    rows = cut_lineage(rows)
    strata = cut_lineage(rows.groupBy("source", "prior").agg(F.sum("size").alias("tokens"), F.count("*").alias("n")))
    groups = strata.groupBy("source").agg(F.sum("tokens").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    groups = groups.withColumn("position", F.row_number().over(order) - 1)
    groups = groups.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("position") % len(weights) + 1).cast("int")))
    groups = cut_lineage(water_fill(groups, share, cap))
    solved = newton(strata, groups, cap)
    # one row per (source, prior): rate in parts
    known = strata.join(groups.select(F.col("source").alias("_g"), "source_size", "target"), strata["source"].eqNullSafe(F.col("_g"))).drop("_g")
    known = known.join(solved.select(F.col("source").alias("_m"), "multiplier"), F.col("source").eqNullSafe(F.col("_m")), "left").drop("_m", "tokens", "n")
    rate = F.coalesce(F.least(F.col("prior") * F.exp("multiplier"), F.lit(cap)), F.lit(0.0))
    known = known.withColumn("parts", F.round(rate * PARTS).cast("long"))
    # rank of a document inside its (source, prior): by size, then digest; counts of cells give each cell's first rank
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    sizes = rows.groupBy("source", "prior", "size").agg(F.count("*").alias("n"))
    by_size = Window.partitionBy("source", "prior").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("size_first", F.coalesce(F.sum("n").over(by_size), F.lit(0))).withColumn("buckets", F.ceil(F.col("n") / BUCKET).cast("long")).drop("n")
    facts = cut_lineage(
        sizes.join(known.withColumnsRenamed({"source": "_g", "prior": "_p"}), F.col("source").eqNullSafe(F.col("_g")) & (F.col("prior") == F.col("_p"))).drop("_g", "_p")
    ).withColumnsRenamed({"source": "_g", "prior": "_p", "size": "_z"})
    cells = rows.join(facts, F.col("source").eqNullSafe(F.col("_g")) & (F.col("prior") == F.col("_p")) & (F.col("size") == F.col("_z"))).drop("_g", "_p", "_z")
    head = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    cells = cells.withColumn("digest", digest).withColumn("bucket", F.floor(head * F.col("buckets") / F.lit(2**32)).cast("long"))
    per_bucket = cells.groupBy("source", "prior", "size", "bucket").agg(F.count("*").alias("n"))
    in_size = Window.partitionBy("source", "prior", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = per_bucket.withColumn("bucket_first", F.coalesce(F.sum("n").over(in_size), F.lit(0))).drop("n").withColumnsRenamed({"source": "_g", "prior": "_p", "size": "_z", "bucket": "_b"})
    ranked = cells.withColumn("place", F.row_number().over(Window.partitionBy("source", "prior", "size", "bucket").orderBy("digest", "doc_id")))
    ranked = ranked.join(firsts, F.col("source").eqNullSafe(F.col("_g")) & (F.col("prior") == F.col("_p")) & (F.col("size") == F.col("_z")) & (F.col("bucket") == F.col("_b")))
    k = F.col("size_first") + F.col("bucket_first") + F.col("place")
    ranked = cut_lineage(ranked.select("doc_id", "source", "size", "source_size", "target", "parts", k.alias("k")))
    ranked = ranked.withColumn("copies", systematic(F.col("parts"), F.col("k")))
    for _ in range(REBALANCED):
        ranked = cut_lineage(rebalance(ranked, cap))
    return ranked.select("doc_id", "source", "size", "source_size", "target", (F.col("parts") / PARTS).alias("rate"), "copies")


def systematic(parts: Column, k: Column) -> Column:
    """Copies of the document of rank ``k``: whole rates, and the fractions' running sum rounded down."""
    fraction = parts % PARTS
    divided = lambda x: F.call_function("div", x, F.lit(PARTS).cast("long"))
    return divided(parts) + divided(fraction * k) - divided(fraction * (k - 1))


def rebalance(ranked: DataFrame, cap: float) -> DataFrame:
    """Round anew, at a corrected rate, the documents of at most half the words that their source misses.

    They come first in rank, so their ranks stay; what a few very long documents put wrong is made
    good by many short ones.
    """
    miss = ranked.groupBy("source").agg((F.round(F.max("target")).cast("long") - F.sum(F.col("size") * F.col("copies"))).alias("miss"))
    miss = miss.filter("abs(miss) >= 2").select(F.col("source").alias("_m"), "miss")
    with_miss = ranked.join(miss, F.col("source").eqNullSafe(F.col("_m")), "left").drop("_m")
    small = F.col("size") <= F.abs(F.col("miss")) / 2
    words = with_miss.filter(small).groupBy("source").agg(F.sum("size").alias("_words")).filter("_words > 0")
    words = words.select(F.col("source").alias("_w"), "_words")
    both = with_miss.join(words, F.col("source").eqNullSafe(F.col("_w")), "left").drop("_w")
    change = F.floor(F.col("miss").cast("double") * PARTS / F.col("_words").cast("double")).cast("long")
    parts = F.least(F.greatest(F.col("parts") + change, F.lit(0)), F.lit(int(cap * PARTS)))
    renew = F.coalesce(small & F.col("_words").isNotNull(), F.lit(False))
    both = both.withColumn("parts", F.when(renew, parts).otherwise(F.col("parts")))
    both = both.withColumn("copies", F.when(renew, systematic(F.col("parts"), F.col("k"))).otherwise(F.col("copies")))
    return both.drop("miss", "_words")


SQL = r"""with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) size from documents),
 g as (select source, cast(sum(size) as bigint) source_size, row_number() over (order by source is null, source collate "C") - 1 pos from d group by source),
 w as (select *, [5, 2, 1][cast(pos % 3 + 1 as int)] weight from g),
 t as (select *, sum(source_size) over () s, sum(weight) over () ws, coalesce(sum(source_size) over o, 0) used, coalesce(sum(weight) over o, 0) gone from w window o as (order by source_size / weight, pos rows between unbounded preceding and 1 preceding)),
 l as (select *, (s * 1.5e0 - used * 2.0e0) / (ws - gone) lev from t),
 f as (select *, source_size * 2.0e0 <= weight * lev as is_full from l),
 x as (select *, first_value(case when not is_full then lev end ignore nulls) over (order by source_size / weight, pos rows between unbounded preceding and unbounded following) open_lev from f),
 y as (select source, source_size, case when is_full then source_size * 2.0e0 else weight * open_lev end target from x),
 r as (select d.doc_id, d.source, d.size, y.source_size, y.target, case when y.source_size > 0 then cast(round(least(y.target / y.source_size, 2) * 100000000) as bigint) else 0 end parts, row_number() over (partition by d.source order by d.size, md5(coalesce(cast(d.doc_id as varchar), '')), d.doc_id) k from d join y on d.source is not distinct from y.source),
 r0 as (select *, parts // 100000000 + (parts % 100000000) * k // 100000000 - (parts % 100000000) * (k - 1) // 100000000 copies from r),
 m1 as (select *, cast(round(target) as bigint) - sum(size * copies) over (partition by source) miss from r0),
 w1 as (select *, abs(miss) >= 2 and size <= abs(miss) / 2 small, sum(case when abs(miss) >= 2 and size <= abs(miss) / 2 then size end) over (partition by source) ws from m1),
 n1 as (select doc_id, source, size, source_size, target, k, copies, small and ws > 0 renew, case when small and ws > 0 then least(greatest(parts + cast(floor(cast(miss as double) * 100000000 / cast(ws as double)) as bigint), 0), 200000000) else parts end parts from w1),
 r1 as (select doc_id, source, size, source_size, target, parts, k, case when renew then parts // 100000000 + (parts % 100000000) * k // 100000000 - (parts % 100000000) * (k - 1) // 100000000 else copies end copies from n1),
 m2 as (select *, cast(round(target) as bigint) - sum(size * copies) over (partition by source) miss from r1),
 w2 as (select *, abs(miss) >= 2 and size <= abs(miss) / 2 small, sum(case when abs(miss) >= 2 and size <= abs(miss) / 2 then size end) over (partition by source) ws from m2),
 n2 as (select doc_id, source, size, source_size, target, k, copies, small and ws > 0 renew, case when small and ws > 0 then least(greatest(parts + cast(floor(cast(miss as double) * 100000000 / cast(ws as double)) as bigint), 0), 200000000) else parts end parts from w2),
 r2 as (select doc_id, source, size, source_size, target, parts, k, case when renew then parts // 100000000 + (parts % 100000000) * k // 100000000 - (parts % 100000000) * (k - 1) // 100000000 else copies end copies from n2),
 m3 as (select *, cast(round(target) as bigint) - sum(size * copies) over (partition by source) miss from r2),
 w3 as (select *, abs(miss) >= 2 and size <= abs(miss) / 2 small, sum(case when abs(miss) >= 2 and size <= abs(miss) / 2 then size end) over (partition by source) ws from m3),
 n3 as (select doc_id, source, size, source_size, target, k, copies, small and ws > 0 renew, case when small and ws > 0 then least(greatest(parts + cast(floor(cast(miss as double) * 100000000 / cast(ws as double)) as bigint), 0), 200000000) else parts end parts from w3),
 r3 as (select doc_id, source, size, source_size, target, parts, k, case when renew then parts // 100000000 + (parts % 100000000) * k // 100000000 - (parts % 100000000) * (k - 1) // 100000000 else copies end copies from n3)
 select doc_id, size, source_size, target, cast(size * copies as bigint) taken from r3"""
