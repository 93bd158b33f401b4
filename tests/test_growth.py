"""Plans and rows that only change when tables grow: shuffled overlap joins, repeated allele keys."""

import duckdb
import pytest
from pyspark.sql import functions as F

from genoweave.operators import intervals, reads, structural
from genoweave.operators.intervals import Span
from genoweave.registry import load


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlap_join_never_sends_its_copies_through_the_driver(spark, tmp_path):
    spark.range(100).selectExpr("'c' || id % 3 a_contig", "id * 50 a_start", "id * 50 + 20000 * (id % 5) + 1 a_end").write.parquet(f"{tmp_path}/a")
    spark.range(90).selectExpr("'c' || id % 3 b_contig", "id * 70 b_pos").write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    met = intervals.overlap_join(a, b, Span("a_contig", "a_start", "a_end"), Span("b_contig", "b_pos", "b_pos", closed=True))
    assert "BroadcastHashJoin" not in plan_of(met) and "SortMergeJoin" in plan_of(met)
    want = a.join(b, (a.a_contig == b.b_contig) & (a.a_start < b.b_pos) & (b.b_pos <= a.a_end))
    assert sorted(map(tuple, met.collect())) == sorted(map(tuple, want.collect()))


def test_overlap_join_leaves_out_levels_that_one_side_lacks(spark):
    point, gene = Span("contig", "pos", "pos", closed=True), Span("g_contig", "g_start", "g_end")
    points = spark.createDataFrame([("c", 5), ("c", 40000)], "contig string, pos long")
    genes = spark.createDataFrame([("c", 0, 30000), ("c", 100, 200)], "g_contig string, g_start long, g_end long")
    bits = intervals.LEVEL_BITS
    left = intervals._placed(intervals._with_home_levels(points, genes, gene, bits), point, "l", bits)
    right = intervals._placed(intervals._with_home_levels(genes, points, point, bits), gene, "r", bits)
    assert sorted(r["_level"] for r in left.collect()) == [0, 0, 1, 1]
    assert sorted((r["_level"], r["_role"]) for r in right.collect()) == [(0, 0), (1, 1)]
    nothing = genes.filter("g_start < 0")
    assert intervals.overlap_join(points, nothing, point, gene).count() == 0


# Orders whose numbers differ by 5,000,000 get equal positions and, by these customers, equal contigs:
# the calls, core calls and catalogue rows made from them then repeat their allele keys.
TWINS = (
    "A3_lineage_recovery",
    "A41_connected_targets",
    "P5_cis_trans",
    "U2_set_relation",
    "U6_set_equality",
    "J15_panel_evidence",
    "J4_lookup_by_id",
    "J5_reciprocal_check",
)


@pytest.fixture(scope="module")
def repeated_keys(tmp_path_factory):
    folder = tmp_path_factory.mktemp("repeated")
    duckdb.sql(
        f"""copy (select * replace (o_orderkey+k*5000000 as o_orderkey, o_custkey+k%2*22 as o_custkey)
        from '/root/testdata/sf0.001/orders.parquet', (select range k from range(3))) to '{folder}/orders.parquet' (format parquet)"""
    )
    return str(folder)


@pytest.mark.parametrize("name", TWINS)
def test_repeated_allele_keys_count_as_in_the_sql(spark, repeated_keys, name):
    found, twins = load()
    got = found[name](spark, repeated_keys)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{repeated_keys}/orders.parquet'")
    want = con.sql(twins[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(map(repr, map(tuple, got.select(*want.columns).collect())))
    assert rows == sorted(map(repr, want.fetchall())) and rows


def test_silent_bases_are_counted_and_not_generated(spark):
    depth = spark.createDataFrame([("c", 5, 3), ("c", 9, 0), ("c", 3000000000, 4), ("d", 5, 7)], "chrom string, pos long, depth long")
    wide = spark.createDataFrame([("a", "c", 1, 4000000000), ("b", "c", 6, 9), ("e", "x", 1, 2)], "label string, i_chrom string, i_start long, i_end long")
    got = {r["label"]: (r["bases"], r["total"], r["silent"]) for r in reads.dense_totals(depth, wide, ["label"]).collect()}
    assert got == {"a": (4000000000, 7, 3999999998), "b": (4, 0, 4), "e": (2, 0, 2)}


def test_depth_ratio_meets_only_the_intervals_it_names(spark):
    plan = load()[0]["A13_depth_ratio"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "IN (iv0,iv1,iv2)" in plan


LISTED = ("G13_base_at_site", "G14_pileup_decode", "S14_pileup_scan", "A15_template_site_counts", "A16_first_read_wins", "A32_mtdna_screen", "A32_depth_summary")


@pytest.fixture(scope="module")
def repeated_sites(tmp_path_factory):
    """Suppliers whose numbers differ by 15,000 are the same site, so a position is listed three times."""
    folder = tmp_path_factory.mktemp("sites")
    duckdb.sql(f"copy (select * replace (s_suppkey+k*15000 as s_suppkey) from '/root/testdata/sf0.001/supplier.parquet', (select range k from range(3))) to '{folder}/supplier.parquet' (format parquet)")
    duckdb.sql(f"copy (from '/root/testdata/sf0.001/lineitem.parquet') to '{folder}/lineitem.parquet' (format parquet)")
    return str(folder)


@pytest.mark.parametrize("name", LISTED)
def test_reads_meet_listed_positions_and_not_every_site(spark, repeated_sites, name):
    found, twins = load()
    got = found[name](spark, repeated_sites)
    assert "_slot_bin" not in plan_of(got)  # no ladder of bins, in which a read meets all sites near it
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.execute(f"create view {t} as select * from '{repeated_sites}/{t}.parquet'")
    want = con.sql(twins[name])
    plain = lambda rows: sorted(repr([float(x) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in r]) for r in rows)
    assert plain(map(tuple, got.select(*want.columns).collect())) == plain(want.fetchall())


def test_points_inside_spans_are_counted_without_their_pairs(spark):
    points = spark.createDataFrame([("c", p, [None, "a", "b"][p % 3]) for p in range(1, 200001, 331)] * 2 + [("c", None, "a"), (None, 5, "a"), ("d", 7, "b")], "contig string, pos long, kind string")
    spans = spark.createDataFrame([("c", s, s + 70000 * (s % 4), ["g", None, "h"][s % 3]) for s in range(0, 190000, 997)] + [("d", 7, 9, "g"), ("d", 6, 7, "h"), ("c", 9, 9, "g")], "g_contig string, s long, e long, gene string")
    point, span = Span("contig", "pos", "pos", closed=True), Span("g_contig", "s", "e")
    got = intervals.count_inside(points, spans, point, span, "kind", "gene")
    assert "_slot_bin" not in plan_of(got)
    want = points.join(spans, (points.contig == spans.g_contig) & (points.pos > spans.s) & (points.pos <= spans.e)).groupBy("gene", "kind").count()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, want.collect())))
    assert "_slot_bin" not in plan_of(load()[0]["A25_region_classifications"](spark, "/root/testdata/sf0.001"))


def test_a_point_meets_the_exons_of_its_own_gene_only(spark):
    found, _ = load()
    plan = plan_of(found["J18_point_context"](spark, "/root/testdata/sf0.001"))
    assert "_slot_bin" not in plan and "BroadcastHashJoin" not in plan
    points = spark.createDataFrame([(1, "g", "c", 5), (2, "h", "c", 5), (3, "h", "d", 25), (4, "g", "c", 15), (5, "g", "c", 99)], "id long, gene string, contig string, pos long")
    exons = spark.createDataFrame([("g", "c", 1, 10), ("g", "c", 4, 8), ("g", "c", 20, 30), ("h", "d", 1, 30)], "gene string, contig string, start long, end long")
    spans = exons.groupBy("gene").agg({"start": "min", "end": "max"}).withColumnsRenamed({"min(start)": "start", "max(end)": "end"})
    got = {r["id"]: (r["context"], r["distance"]) for r in structural.gene_context(points, spans, exons).collect()}
    assert got == {1: ("exon", None), 2: ("intron", None), 3: ("exon", None), 4: ("intron", None), 5: ("3prime_flank", 69)}


def test_only_eligible_calls_look_up_genes(spark):
    calls = spark.createDataFrame([(1, "PASS", "0/1"), (2, "LowQual", "0/1"), (3, "PASS", "0/0"), (4, "PASS", "1/1"), (4, "LowQual", "1/1"), (None, "PASS", "0/1")], "id long, filter string, gt string")
    got = sorted(map(tuple, structural.eligible_calls(calls).collect()))
    assert got == [(1, "PASS", "0/1"), (4, "LowQual", "1/1"), (4, "PASS", "1/1")]
    plan = plan_of(load()[0]["A23_feature_counts"](spark, "/root/testdata/sf0.001"))
    assert "LeftSemi" in plan


def test_pairs_of_rows_with_several_places_come_once_and_are_not_shuffled(spark, tmp_path):
    import random

    draw = random.Random(5)
    def places(most):
        made = []
        for _ in range(draw.randint(1, most)):
            at = draw.randint(0, 60000)
            made.append((draw.choice("xy"), at, at + draw.choice((1, 40, 900, 30000))))
        return made
    left = [(i, places(3)) for i in range(40)]
    right = [(100 + i, places(1 + 2 * (i % 2))) for i in range(40)]
    for name, rows in (("l", left), ("r", right)):
        spark.createDataFrame(rows, f"{name} long, {name}p array<struct<contig: string, start: long, end: long>>").write.parquet(f"{tmp_path}/{name}")
    met = intervals.overlap_pairs(spark.read.parquet(f"{tmp_path}/l"), spark.read.parquet(f"{tmp_path}/r"), "lp", "rp").select("l", "r")
    want = [(a, b) for a, p in left for b, q in right if any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for x in p for y in q)]
    assert sorted(map(tuple, met.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["J7_cds_overlap", "J8_sv_gene_overlap", "J9_sv_gene_hits", "J2_called_catalog_in_genes"])
def test_pairs_of_calls_and_genes_are_not_shuffled_again(spark, name):
    plan = plan_of(load()[0][name](spark, "/root/testdata/sf0.001"))
    top = plan[: plan.index("SortMergeJoin [_contig")]
    assert "Exchange" not in top, top


def test_gene_counters_shuffle_one_row_per_task_and_gene(spark):
    plan = plan_of(load()[0]["A23_gene_counters"](spark, "/root/testdata/sf0.001"))
    assert plan[: plan.index("SortMergeJoin [_contig")].count("Exchange") == 1


def test_gene_counters_count_as_the_relations_do(spark):
    svs = spark.createDataFrame(
        [("a", "c", 100, 900, "DEL", ".", None, "PASS", "0/1"), ("b", "c", 150, 150, "BND", "c", 180, "PASS", "1/1"), ("d", "c", 350, 2000, "INV", ".", None, "PASS", "0|1"),
         ("e", "c", 50, 1000, "INV", ".", None, "LowQual", "0/1"), ("a", "c", 120, 130, "DEL", ".", None, "PASS", "0/0")],
        "id string, chrom string, pos long, end long, svtype string, chr2 string, pos2 long, filter string, gt string")
    genes = spark.createDataFrame([("g", "c", 99, 400), ("g", "c", 380, 600), ("h", "c", 1500, 1600)], "gene string, g_chrom string, g_start long, g_end long")
    exons = spark.createDataFrame([("g", "t", "1", "c", 140, 200, 150, 390), ("g", "t", "2", "c", 340, 400, 150, 390)],
                                  "gene string, tx string, exon_number string, e_chrom string, e_start long, e_end long, cds_start long, cds_end long")
    got = {r["gene"]: tuple(r)[1:] for r in structural.gene_counters(svs, genes, exons).collect()}
    rel = structural.gene_relations(svs, genes, exons).join(svs.selectExpr("id", "filter = 'PASS' and gt in ('0/1','1/1','0|1') ok"), "id")
    want = rel.groupBy("gene").agg({"*": "count"}).collect()
    assert {r[0]: r[1] for r in want} == {k: v[0] for k, v in got.items()}
    for gene, counts in got.items():
        mine = rel.filter(f"gene = '{gene}' and ok")
        assert counts[1:] == (mine.count(), mine.filter("cds_bp > 0").count(), mine.filter("functional").count())


def test_kmers_of_a_long_text_are_cut_from_short_pieces(spark):
    import random

    from genoweave.functions import sequence as fs

    draw = random.Random(3)
    text = "".join(draw.choice("ACGT" * 40 + "N") for _ in range(4000)) + "ACGTA"
    rows = spark.createDataFrame([(text,), ("ACGTN",), ("",)], "s string").select(F.explode(fs.clean_runs(F.col("s"), 5, 16)).alias("r"))
    assert rows.agg(F.max(F.length("r"))).first()[0] == 20
    got = rows.select(F.explode(fs.run_kmers(F.col("r"), 5)).alias("k")).collect()
    flip = str.maketrans("ACGT", "TGCA")
    words = [text[i : i + 5] for i in range(len(text) - 4) if "N" not in text[i : i + 5]]
    assert sorted(r["k"] for r in got) == sorted(min(w, w.translate(flip)[::-1]) for w in words)


def test_long_coding_sequences_are_translated_in_one_pass(spark):
    from genoweave.functions import sequence as fs

    cds = ["ATGTTTTAGNNNacgT G#TTGGG", "ATG" * 3, "AT", "ATGA", None]
    out = spark.createDataFrame([(c,) for c in cds], "c string").select(fs.translate_cds(F.col("c")).alias("p")).collect()
    assert [r["p"] for r in out] == ["MF*XXXXG", "MMM", None, None, None]
    codons = [a + b + c for a in "TCAG" for b in "TCAG" for c in "TCAG"]
    table = spark.createDataFrame([("".join(codons),)], "c string").select(fs.translate_cds(F.col("c")).alias("p")).first()["p"]
    assert table == fs.STANDARD_CODE
    plan = plan_of(spark.createDataFrame([("ATG",)], "c string").select(fs.translate_cds(F.col("c"))))
    assert "regexp_extract_all" in plan and "sequence(" not in plan


def test_chunks_tile_texts_of_any_length(spark):
    from genoweave.sources import text

    rows = [("a", "acgta" * 7), ("b", ""), ("c", None), ("d", "acg")]
    out = text.chunk_sequences(spark.createDataFrame(rows, "contig string, seq string"), step=10).collect()
    want = [("a", i, i * 10, ("ACGTA" * 7)[i * 10 : i * 10 + 10]) for i in range(4)] + [("b", 0, 0, ""), ("c", 0, 0, None), ("d", 0, 0, "ACG")]
    assert sorted(map(tuple, out)) == sorted(want)


def test_kmer_counts_shuffle_reads_and_count_reads_without_a_template(spark):
    from genoweave.operators import kmers

    reads = spark.createDataFrame([("t", "ACGTAC", "IIIIII"), ("t", "ACGTAC", "IIIIII"), ("u", "ACGTAC", "II!III"), (None, "GTACC", "IIIII"), ("v", None, None)], "template string, seq string, qual string")
    out = kmers.kmer_counts(reads, 3)
    assert sorted(map(tuple, out.collect())) == [("ACC", 1, 0), ("ACG", 4, 1), ("GTA", 7, 2)]
    plan = plan_of(out)
    assert plan.index("Generate") < plan.index("collect_list"), plan


def test_reference_counts_read_the_hits_once(spark):
    plan = plan_of(load()[0]["K5_reference_counts"](spark, "/root/testdata/sf0.001"))
    assert plan.count("posexplode(transform(") == 1, plan.count("posexplode(transform(")


def test_exon_bases_of_a_pair_are_told_where_it_meets(spark, tmp_path):
    import random

    draw = random.Random(11)
    kinds = ("DEL", "DUP", "INV", "BND", "INS")
    svs = [(i % 70, draw.choice(kinds), draw.choice("xy"), p, p + draw.choice((0, 3, 40, 300)), draw.choice("xy"), draw.randint(1, 600)) for i in range(80) for p in [draw.randint(1, 600)]]
    genes = [(f"g{i}", draw.choice("xy"), s, s + draw.randint(1, 200)) for i in range(25) for s in [draw.randint(0, 500)]]
    exons = [(g, f"{g}t{t}", 1, str(n), c, a, b, s + 20, s + 90) for g, c, s, e in genes for t in range(2) for n in range(3) for a in [s + n * 30 + t * 7] for b in [a + draw.choice((0, 10, 25))]]
    for name, rows, shape in (
        ("s", svs, "id int, svtype string, chrom string, pos long, end long, chr2 string, pos2 long"),
        ("g", genes, "gene string, g_chrom string, g_start long, g_end long"),
        ("e", exons, "gene string, tx string, strand int, exon_number string, e_chrom string, e_start long, e_end long, cds_start long, cds_end long"),
    ):
        spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/{name}")
    s, g, e = (spark.read.parquet(f"{tmp_path}/{x}") for x in "sge")
    got = structural.gene_relations(s, g, e)
    assert plan_of(got).count("_slot_bin") and "merge_" not in plan_of(got)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("_slot_bin") < 40  # calls and genes meet once, not calls and exons too
    used = {}
    for r in structural.sv_parts(s).collect():
        if r["part"] == ("span" if r["svtype"] in ("DEL", "DUP") else "breakpoint"):
            used.setdefault(r["id"], []).append((r["p_chrom"], r["p_start"], r["p_end"]))
    seen = 0
    for r in got.collect():
        covered, coding, labels = set(), set(), set()
        for c, a, b in used.get(r["id"], []):
            for gene, tx, _, n, ec, es, ee, cs, ce in exons:
                if gene == r["gene"] and ec == c and max(a, es) < min(b, ee):
                    covered |= set(range(max(a, es), min(b, ee)))
                    coding |= set(range(max(a, es, cs), min(b, ee, ce)))
                    labels.add(f"{tx}:ex{n}")
        assert (r["exon_bp"], r["cds_bp"], r["exon_labels"], r["transcripts"]) == (len(covered), len(coding), "|".join(sorted(labels)), "|".join(sorted({x.split(":")[0] for x in labels})))
        seen += bool(covered)
    assert seen > 20


def test_the_panel_summary_makes_no_pairs(spark):
    assert "_slot_bin" not in plan_of(load()[0]["A25_panel_summary"](spark, "/root/testdata/sf0.001"))
