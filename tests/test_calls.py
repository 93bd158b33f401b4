"""Genotype rules, allele geometry, splitting, strata and left alignment on small fixtures."""

import pytest
from pyspark.sql import functions as F

from genoweave.functions import alleles as fa
from genoweave.functions import genotype as fg
from genoweave.operators import alleles, integrity, strata
from genoweave.plans.panels import classify_panel
from genoweave.sources import structured, text


def test_strata_keep_partial_called_alts_apart(spark):
    rows = [("0/1", "Pathogenic"), ("./1", "Pathogenic"), ("1/.", "Uncertain_significance"), ("0/.", "Pathogenic"), ("./.", "Pathogenic"), ("0/0", "Pathogenic")]
    df = spark.createDataFrame([(i, g, c) for i, (g, c) in enumerate(rows)], "allele_id long, gt string, sig string")
    df = df.select("allele_id", F.array(fg.parse_gt(F.col("gt"))).alias("gts"), F.lit(".").alias("flt"), F.array("sig").alias("clnsig"), F.array(F.lit(".")).alias("review"))
    r = strata.clinical_strata(df).first()
    assert r["matched_complete_nonreference_pathogenic_or_likely_pathogenic"] == 1
    assert r["matched_called_alt"] == 3
    assert r["matched_partial_called_alt"] == 2
    assert r["matched_partial_called_alt_vus_or_uncertain"] == 1
    assert r["matched_partial_called_alt_pathogenic_or_likely_pathogenic"] == 1
    assert r["matched_partial_without_called_alt"] == 2
    assert (r["filter_dot"], r["filter_pass"]) == (6, 0)


def test_split_keeps_own_depth_and_likelihoods(spark):
    line = "chr1\t100\t.\tA\tC,G\t50\t.\tX=1\tGT:AD:PL\t1/2:3,12,15:90,80,70,60,0,50"
    call = text.parse_vcf(spark.createDataFrame([(line,)], "value string")).withColumn("src_row", F.lit(7))
    split = alleles.split_multiallelic(call)
    got = {r["alt"]: r for r in split.select("alt", fg.gt_text(F.col("gt"), F.col("phased")).alias("gt"), "ad", "pl").collect()}
    assert got["C"]["gt"] == "1/." and got["G"]["gt"] == "./1"
    assert got["C"]["ad"] == [3, 12] and got["G"]["ad"] == [3, 15]
    assert got["C"]["pl"] == [90, 80, 70] and got["G"]["pl"] == [90, 60, 50]
    traced = alleles.trace_lineage(split, call).select("call_matches", "alt_was_called").collect()
    assert all(r["call_matches"] and r["alt_was_called"] for r in traced)


@pytest.mark.parametrize("gt,want", [("0/1", [1]), ("2/2", [2]), ("0/0", []), ("./.", [])])
def test_only_called_alts_count(spark, gt, want):
    df = spark.createDataFrame([(gt,)], "gt string")
    assert df.select(fa.called_indices(fg.parse_gt(F.col("gt")), F.lit(2)).alias("i")).first()["i"] == want


@pytest.mark.parametrize("pos,ref,alt,want", [(150, "AT", "A", (151, 151)), (197, "A", "AG", (197, 198)), (5, "ATG", "ACG", (6, 6)), (5, "A", "<DEL>", None), (5, "A", "*", None)])
def test_changed_span(spark, pos, ref, alt, want):
    got = spark.createDataFrame([(pos, ref, alt)], "pos long, ref string, alt string").select(fa.changed_span(F.col("pos"), F.col("ref"), F.col("alt")).alias("s")).first()["s"]
    assert (tuple(got) if got else None) == want


def test_missing_is_never_a_pass(spark):
    lines = [("chr1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1",), ("chr1\t2\t.\tA\tC\t.\tPASS\t.\tGT\t0/1",)]
    rows = text.parse_vcf(spark.createDataFrame(lines, "value string")).orderBy("pos").select("filters", "qual", "dp").collect()
    assert rows[0]["filters"] == [] and rows[1]["filters"] == ["PASS"]
    assert rows[0]["qual"] is None and rows[0]["dp"] is None


def test_two_samples_fail(spark):
    bad = spark.createDataFrame([("chr1\t1\t.\tA\tC\t.\t.\t.\tGT\t0/1\t0/1",)], "value string")
    with pytest.raises(Exception, match="single-sample"):
        text.parse_vcf(bad).collect()


@pytest.mark.parametrize("strand,alt_pos,ref,alt,want", [
    (1, 149, "AT", "A", "coding"), (1, 150, "AT", "A", "canonical_splice_intronic_donor"), (1, 197, "A", "AG", "canonical_splice_intronic_acceptor"),
    (-1, 150, "AT", "A", "canonical_splice_intronic_acceptor"), (-1, 197, "A", "AG", "canonical_splice_intronic_donor"), (1, 170, "A", "C", "other_locus"),
])
def test_region_precedence(spark, strand, alt_pos, ref, alt, want):
    exons = spark.createDataFrame([("t", "g", "chr1", strand, s, e, 110, 240) for s, e in ((100, 150), (200, 250))], "tx string, gene string, contig string, strand int, start long, end long, cds_start long, cds_end long")
    call = spark.createDataFrame([(1, "chr1", alt_pos, ref, alt, "0/1")], "src_row long, contig string, pos long, ref string, alt string, gt string")
    assert [r["region"] for r in classify_panel(call, exons).collect()] == [want]


def test_left_alignment_rolls_through_repeats_and_chunk_edges(spark):
    seq = "GC" + "CA" * 60 + "T"
    chunks = text.chunk_sequences(spark.createDataFrame([("c", seq)], "contig string, seq string"), step=16)
    last = len(seq) - 2
    rows = [(1, "c", last - 1, seq[last - 2 : last + 1], seq[last - 2]), (2, "c", 1, "G", "T"), (3, "c", last + 1, "A", "<DEL>")]
    calls = spark.createDataFrame(rows, "src_row long, contig string, pos long, ref string, alt string")
    got = {r["src_row"]: (r["pos"], r["ref"], r["alt"]) for r in alleles.left_align(calls, chunks, "src_row", step=16).collect()}

    def haplotype(pos, ref, alt):
        assert seq[pos - 1 : pos - 1 + len(ref)] == ref
        return seq[: pos - 1] + alt + seq[pos - 1 + len(ref) :]

    assert haplotype(*got[1]) == haplotype(*rows[0][2:])
    assert got[1][0] <= 3 and len(got[1][2]) == 1
    assert got[2] == (1, "G", "T") and got[3][2] == "<DEL>"


def test_sink_refuses_existing_output(spark, tmp_path):
    df = spark.range(3)
    structured.write_new(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)already exists"):
        structured.write_new(df, str(tmp_path / "out"))


def test_files_read_back(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\tPOS\n" + "chr1\t5\trs1\tA\tC\t3\tPASS\tA=1;B\tGT:DP\t0|1:9\n")
    r = text.read_vcf(spark, str(tmp_path / "a.vcf.gz")).first()
    assert (r["pos"], r["gt"], r["phased"], r["dp"], r["info"]["A"], r["info"]["B"]) == (5, [0, 1], True, 9, "1", "")
    (tmp_path / "h.obo").write_text("format-version: 1\n\n[Term]\nid: HP:1\nname: One thing\n\n[Term]\nid: HP:2\nname: Two\n")
    assert {tuple(r) for r in text.read_obo(spark, str(tmp_path / "h.obo")).collect()} == {("HP:1", "One thing"), ("HP:2", "Two")}
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_text('{"a": 1}')
    assert structured.read_json_documents(spark, str(tmp_path / "d")).first()["id"] == "x"


def test_record_without_alt_stays_one_row(spark):
    from genoweave.operators import alleles

    df = spark.createDataFrame([(1, "A", [], [0, 0], [7], None), (2, "A", ["C", "G"], [1, 2], [5, 3, 2], None)], "src_row long, ref string, alts array<string>, gt array<int>, ad array<int>, pl array<int>")
    got = sorted((r["src_row"], r["alt_index"], r["alt"], r["alts"], r["ad"]) for r in alleles.split_multiallelic(df).collect())
    assert got == [(1, 0, None, [], [7]), (2, 1, "C", ["C"], [5, 3]), (2, 2, "G", ["G"], [5, 2])]


def test_shared_folder_is_asked_for_on_a_cluster():
    import types

    import pytest

    from genoweave.session import shared_folder

    context = types.SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda k, d: d), sparkContext=context)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(cluster)


def test_left_alignment_query_covers_whole_and_short_texts(spark):
    from collections import Counter

    from genoweave.registry import sequences

    texts = {1: "AC", 2: "GGGGGGGGGGGG", 3: "ACGTTTTTTTGACACACACACACACACACAGGT" * 4, 4: "A", 5: "", 6: "C" * 130 + "ACGT" * 20}
    want = Counter()
    for d, t in texts.items():
        for p in range(max(len(t) - 10, 1), 0, -10) if len(t) > 1 else ():
            for ref, alt in ((t[p - 1 : p + 1], t[p - 1]), (t[p - 1], t[p - 1] * 2)):
                at = p
                while ref[-1] == alt[-1] and (at > 1 or min(len(ref), len(alt)) > 1):
                    if min(len(ref), len(alt)) == 1:
                        at -= 1
                        ref, alt = t[at - 1] + ref, t[at - 1] + alt
                    ref, alt = ref[:-1], alt[:-1]
                want[f"doc{d}", at, ref, alt] += 1
    reads = spark.createDataFrame(list(texts.items()), "doc_id long, seq string")
    assert Counter(tuple(r) for r in sequences.g4(lambda _: reads).collect()) == want


def test_inputs_that_change_during_the_work_fail_it(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for name in ("a", "b"):
        (src / f"{name}.txt").write_text("x\ny\n")
    lines = lambda: spark.read.text(str(src))
    assert integrity.on_stable_inputs(spark, str(src), lines).count() == 4

    def late():
        (src / "b.txt").write_text("x\n")
        return lines()

    with pytest.raises(RuntimeError, match="b.txt"):
        integrity.on_stable_inputs(spark, str(src), late)
    before = integrity.snapshot(spark, str(src))
    (src / "c.txt").write_text("z")
    (src / "a.txt").unlink()
    changed = integrity.changed_files(before, integrity.snapshot(spark, str(src)))
    assert {r["path"].rsplit("/", 1)[1]: r["bytes_before"] for r in changed.collect()} == {"a.txt": 4, "c.txt": None}


def test_left_alignment_moves_whole_rows_together(spark):
    import random

    import pyarrow as pa

    from genoweave.functions.perread import _shifted, shift_left

    draw = random.Random(3)
    rows = []
    for _ in range(3000):
        context = "".join(draw.choice("AC") for _ in range(draw.randint(0, 40)))
        start = draw.choice((0, 0, 100))
        n = draw.randint(0, len(context))
        first = draw.choice("AC")
        unit = "".join(draw.choice("AC") for _ in range(draw.randint(1, 5)))
        ref, alt = draw.choice(((first + unit, first), (first, first + unit), (unit + first, first), (first + unit, unit), (unit, unit[::-1] + "A")))
        rows.append((start + n + 1, ref, alt, context[:n] + draw.choice(("", context[n:])), start))
    batch = pa.RecordBatch.from_pydict(dict(zip(("pos", "ref", "alt", "_context", "_context_start"), map(list, zip(*rows)))) | {"kept": list(range(len(rows)))})
    (got,) = shift_left(iter([batch]))
    want = [_shifted(p, r, a, c, s) for p, r, a, c, s in rows]
    assert list(zip(*(got.column(n).to_pylist() for n in ("pos", "ref", "alt", "_edge")), strict=True)) == want
    assert got.column("kept").to_pylist() == list(range(len(rows))) and sum(w[3] for w in want) > 20
    chunks = text.chunk_sequences(spark.createDataFrame([("c", "GAAAATCGCGCGT")], "contig string, seq string"), step=4)
    calls = spark.createDataFrame([(1, "c", 4, "AA", "A", "x"), (1, "c", 11, "CGC", "C", "y"), (2, "c", 2, "A", "C", "z")], "src_row int, contig string, pos long, ref string, alt string, note string")
    aligned = alleles.left_align(calls, chunks, "src_row", step=4)
    # an id that comes twice is two calls, each with its own columns
    assert sorted(map(tuple, aligned.collect())) == [(1, "c", 1, "GA", "G", "x"), (1, "c", 6, "TCG", "T", "y"), (2, "c", 2, "A", "C", "z")]
