"""Reads, k-mers, unitigs, phase graphs, ledgers and streaming on small fixtures."""

import random

from pyspark.sql import functions as F

from genoweave.functions import sequence as fs
from genoweave.functions import reads as fr
from genoweave.functions.perread import SuffixAutomaton, observed_allele
from genoweave.operators import kmers, mtdna, phase, reads, scores
from genoweave.sources import text
from genoweave.streaming import ledger, resumable

SWAP = str.maketrans("ACGT", "TGCA")


def rc(s):
    return s.translate(SWAP)[::-1]


def sam(spark, rows):
    base = "q\t{flag}\tchr15\t{pos}\t60\t{cigar}\t=\t1\t0\t{seq}\t{qual}"
    lines = [(base.format(**r).replace("q\t", f"{r.get('name', 'q')}\t", 1),) for r in rows]
    return reads.prepare_reads(text.parse_sam(spark.createDataFrame(lines, "value string")))


def test_one_clip_is_one_fragment_and_no_control_is_no_ratio(spark):
    r = sam(spark, [{"flag": 1, "pos": 40196543, "cigar": "10S20M", "seq": "A" * 30, "qual": "I" * 30}])
    s = reads.support_summary(reads.clips(r), ["rname"]).first()
    assert (s["templates"], s["leading_clips"], s["poly_templates"]) == (1, 1, 1)
    stats = spark.createDataFrame([("t", 3.0), ("c", 0.0)], "label string, mean_depth double")
    assert reads.depth_ratio(stats, "t", ["c"]).first()["ratio"] is None


def test_indel_alleles_need_an_observed_flank(spark):
    q = "I" * 20
    rows = [
        ("AAAAACGTTTAAAAAAAAAA", q, "20M", 1, 6, "C", "T", "C"), ("AAAAACGTTTAAAAAAAAAA", q, "20M", 1, 2, "A", "T", None),
        ("AAAAAACCGGTTTTTTTTTT", q, "6M2I12M", 1, 6, "A", "ACC", "ACC"), ("AAAAAAGGTTTTTTTTTTTT", q, "6M2D14M", 1, 6, "ACC", "A", "A"),
        ("AAAAAAGGTTTTTTTTTTTT", "I" * 5 + "!" + "I" * 14, "20M", 1, 6, "A", "T", None),
    ]
    df = spark.createDataFrame(rows, "s string, q string, c string, p long, site long, ref string, alt string, want string")
    got = df.select(observed_allele("s", "q", "c", "p", "site", "ref", "alt").alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_kmers_dedupe_mates_and_drop_low_quality(spark):
    r = random.Random(1)
    seq = "".join(r.choice("ACGT") for _ in range(60))
    low = "I" * 30 + "+" + "I" * 29
    rows = [("a", seq, "I" * 60), ("a", rc(seq), "I" * 60), ("b", seq, low)]
    k = kmers.read_kmers(spark.createDataFrame(rows, "template string, seq string, qual string"), 31)
    n = {x["kmer"]: x["templates"] for x in kmers.template_counts(k, 1).collect()}
    assert len(n) == 30 and set(n.values()) == {1}


def brute_unitigs(counts, k, minimum):
    out, inc = {}, {}
    for m in counts:
        for s in (m, rc(m)):
            out.setdefault(s[:-1], set()).add(s[1:])
            inc.setdefault(s[1:], set()).add(s[:-1])
    done, found = set(), []
    for u in sorted(out):
        if len(inc.get(u, ())) == 1 and len(out[u]) == 1:
            continue
        for v in sorted(out[u]):
            if (u, v) in done:
                continue
            s, a, b = u + v[-1], u, v
            while True:
                done |= {(a, b), (rc(b), rc(a))}
                if len(out.get(b, ())) != 1 or len(inc.get(b, ())) != 1:
                    break
                c = next(iter(out[b]))
                if (b, c) in done:
                    break
                s, a, b = s + c[-1], b, c
            if len(s) >= minimum:
                found.append(s)
    return found


def test_unitigs_equal_a_walk(spark):
    r = random.Random(8)
    core = "".join(r.choice("ACGT") for _ in range(150))
    other = "".join(r.choice("ACGT") for _ in range(40))
    texts = [core, core[:60] + other, other + core[90:], "ACG" * 12]
    k = 11
    counts = {min(t[i : i + k], rc(t[i : i + k])) for t in texts for i in range(len(t) - k + 1)}
    df = spark.createDataFrame([(m, 3) for m in sorted(counts)], "kmer string, templates long")
    got = [x["sequence"] for x in kmers.unitigs(df, 20).collect()]
    want = brute_unitigs(counts, k, 20)
    canon = lambda xs: sorted(min(x, rc(x)) for x in xs)
    assert canon(got) == canon(want)


def test_components_of_long_chain_and_star(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)]
    links = spark.createDataFrame([("c", a, b) for a, b in pairs], "contig string, a long, b long")
    got = {r["node"]: r["component"] for r in phase.components(links).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(30))


def test_pileup_text(spark):
    df = spark.createDataFrame([("c", 1, "A", "^I.,+2acGg-10ACGTACGTACt$*")], "contig string, pos long, ref string, bases string")
    r = mtdna.pileup_counts(df).first()
    assert (r["total"], r["G_fwd"], r["G_rev"], r["T_rev"], r["A_fwd"], r["C_rev"]) == (5, 1, 1, 1, 0, 0)


def test_template_depth_counts_mates_once(spark):
    rows = [{"name": "a", "flag": 1, "pos": 10, "cigar": "10M", "seq": "A" * 10, "qual": "IIII!IIIII"}, {"name": "a", "flag": 1, "pos": 15, "cigar": "10M", "seq": "A" * 10, "qual": "I" * 10},
            {"name": "b", "flag": 1, "pos": 18, "cigar": "2M2D2M", "seq": "A" * 4, "qual": "IIII"}]
    got = {r["pos"]: r["depth"] for r in reads.template_depth(sam(spark, rows), width=8).collect()}
    want = {p: 1 for p in list(range(10, 14)) + list(range(15, 25))}
    for p in (18, 19, 22, 23):
        want[p] += 1
    assert got == want


def test_translation(spark):
    r = spark.createDataFrame([("ATGTTATAG",), ("ATGNNNTAA",)], "c string").select(fs.translate_cds(F.col("c")).alias("p")).collect()
    assert [x["p"] for x in r] == ["ML*", "MX*"]


def test_started_units_are_reviewed_not_rerun(spark):
    ev = spark.createDataFrame([("a", "started"), ("a", "complete"), ("b", "started")], "unit string, status string")
    units = spark.createDataFrame([("a",), ("b",), ("c",)], "unit string")
    assert {tuple(r)[:2] for r in ledger.unit_state(ev).collect()} == {("a", "complete"), ("b", "review")}
    assert [r["unit"] for r in ledger.submittable(units, ev).collect()] == ["c"]


def test_catalog_resumes_and_guards_identity(spark, tmp_path):
    import pytest

    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    head = "#HmPOS_build=GRCh38\n#weight_type=beta\nhm_chr\thm_pos\teffect_allele\teffect_weight\n"
    (src / "PGS000001.txt").write_text(head + "1\t10\tc\t0.5\n1\t10\tC\t0.5\n1\t11\tC\t1\n1\t11\tC\t2\n")
    geno = spark.createDataFrame([("1", 10, ["A", "C"], {"A": 1, "C": 1}), ("1", 11, ["A", "C"], {"A": 0, "C": 2})], "chrom string, pos long, alleles array<string>, counts map<string,int>")
    resumable.run_catalog(spark, str(src), str(out), "run-1", 1)
    (src / "PGS000002.txt").write_text(head.replace("GRCh38", "GRCh37") + "1\t10\tC\t1\n")
    resumable.run_catalog(spark, str(src), str(out), "run-1", 1)
    rows = resumable.catalog_sums(spark, str(out), geno).collect()
    assert [(r["model"], r["raw_sum"], r["matched"], r["ambiguous_positions"], r["duplicate_rows"]) for r in rows] == [("PGS000001", 0.5, 1, 1, 2)]
    assert [r["model"] for r in resumable.catalog_failures(spark, str(out), geno).collect()] == ["PGS000002"]
    with pytest.raises(ValueError, match="other inputs"):
        resumable.run_catalog(spark, str(src), str(out), "run-2")


def test_columns_go_by_the_header_of_their_file(spark):
    files = {
        "PGS000001.txt": ["#HmPOS_build=GRCh37", "#HmPOS_build=GRCh38", "hm_chr\thm_pos\teffect_allele\teffect_weight", "1\t10\tC\t0.5"],
        "PGS000002.txt": ["#HmPOS_build=GRCh38", "effect_weight\tx\teffect_allele\thm_pos\thm_chr\tis_diplotype\r", "0.25\t?\tc\t10\t1\tFalse\r", "2\t?"],
        "PGS000003.txt": ["#HmPOS_build=GRCh38", "1\t10\tC\t0.5"],
        "PGS000004.txt": ["#HmPOS_build=GRCh38", "hm_pos\teffect_allele\thm_chr\teffect_weight\tis_interaction", "10\tC\t1\t1\t0", "11\tC\t1\t1\tyes"],
        "PGS000005/part-0": ["#HmPOS_build=GRCh38", "effect_allele\thm_pos\thm_chr\teffect_weight"],
        "PGS000005/part-1": ["C\t10\t1\t4"],
    }
    lines = [(f, v, i) for f, vs in files.items() for i, v in enumerate(vs)]
    geno = spark.createDataFrame([("1", 10, ["A", "C"], {"A": 1, "C": 1})], "chrom string, pos long, alleles array<string>, counts map<string,int>")
    sums, failed = resumable.score_batch(spark.createDataFrame(lines, "file string, value string, at int").repartition(4), geno)
    assert {r["model"]: (r["source_rows"], r["malformed"], r["raw_sum"]) for r in sums.collect()} == {"PGS000001": (1, 0, 0.5), "PGS000002": (2, 1, 0.25), "PGS000005": (1, 0, 4.0)}
    assert {tuple(r) for r in failed.collect()} == {("PGS000003", "score_header_missing"), ("PGS000004", scores.COMPLEX_REASON)}
    hashed = spark.createDataFrame([("b", "#ID\tRANK"), ("b", "x\t2"), ("a", "1\ty"), ("a", "RANK\tID")], "file string, value string")
    assert {tuple(r) for r in text.parse_headed(hashed, ["RANK", "ID"], "file").collect()} == {("b", "2", "x"), ("a", "1", "y")}


def test_longest_shared_substring_is_that_of_brute_force(spark):
    r = random.Random(9)
    text_of = lambda n, symbols="ACG": "".join(r.choice(symbols) for _ in range(n))
    target = text_of(120)
    texts = ["", "T", target[10:90], text_of(400), "x" + target[5:20].lower() + "x", *[text_of(60, "ACGT") for _ in range(20)]]

    def brute(q, floor, ceiling):
        best = max((w for w in range(1, min(len(q), 120, ceiling) + 1) if any(q.upper()[i : i + w] in target for i in range(len(q) - w + 1))), default=0)
        return best if best >= floor else 0

    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, t string")
    got = {x["i"]: x["n"] for x in df.select("i", fr.longest_exact(F.col("t"), [target], 4, 40).alias("n")).collect()}
    assert got == {**{i: brute(t, 4, 40) for i, t in enumerate(texts)}, len(texts): None}


def test_longest_shared_substring_is_linear():
    import time

    r = random.Random(2)
    target = "".join(r.choice("ACGT") for _ in range(300))
    held = SuffixAutomaton(target * 3 + "A" * 300)

    def took(n):
        q = "A" * (n // 2) + target * (n // 600)
        start = time.perf_counter()
        held.longest(q)
        return time.perf_counter() - start

    took(1000)
    assert min(took(100_000) for _ in range(3)) < 400 * max(min(took(1000) for _ in range(5)), 1e-4)


def test_breakpoint_shifts_are_those_of_brute_force(spark):
    r = random.Random(6)
    rows = []
    for i in range(60):
        unit = "".join(r.choice("AC") for _ in range(r.randint(1, 4)))
        s = "".join(r.choice("ACGT") for _ in range(140)) + unit * r.randint(1, 40) + "".join(r.choice("ACGT") for _ in range(300))
        at, size = r.randint(110, 150), len(unit) * r.randint(1, 6)
        rows.append((i, s[at - 110 : at + 110], s[at + size - 110 : at + size + 110]))
    rows.append((60, "A" * 220, "A" * 220))

    def brute(a, b):
        return [d for d in range(-10, 11) if a[: 110 + d] + b[110 + d :] == a[:110] + b[110:]]

    got = {x["id"]: (x["min_shift"], x["max_shift"], x["shifts"]) for x in kmers.breakpoint_shifts(spark.createDataFrame(rows, "id int, left_text string, right_text string"), reach=10).collect()}
    assert got == {i: (min(d), max(d), len(d)) for i, a, b in rows for d in [brute(a, b)]}


def test_exact_hits_of_mixed_lengths(spark):
    r = random.Random(11)
    unit = "".join(r.choice("ACGT") for _ in range(90))
    genome = {"c1": "".join(r.choice("ACGT") for _ in range(700)) + unit + "ACAC" * 40 + rc(unit) + "N" * 20, "c2": unit[:50].lower() + "G" * 130}
    needles = ["ACAC" * 3, "ACAC" * 9, unit, unit[:31], unit[5:45], unit[20:32], genome["c1"][640:840], "G" * 100, rc(unit)[3:70], "T" * 12, genome["c1"][:12], rc(genome["c1"][:60])]

    def brute(needle):
        return {(c, i + 1, strand) for c, s in genome.items() for strand, n in (("+", needle), ("-", rc(needle))) for i in range(len(s) - len(n) + 1) if s.upper()[i : i + len(n)] == n}

    chunks = text.chunk_sequences(spark.createDataFrame(list(genome.items()), "contig string, seq string"), step=64)
    got = kmers.exact_hits(spark.createDataFrame(list(enumerate(needles)), "needle_id int, needle string"), chunks).collect()
    assert len(got) == len({tuple(x) for x in got})
    assert {tuple(x) for x in got} == {(i, *hit) for i, n in enumerate(needles) for hit in brute(n)}


def odd_reads(spark):
    """Reads with a deletion, an insertion, clips, lower case, short or missing texts, and templates that disagree."""
    rows = [
        ("t1", 0, "c", 1, 40, "20M", "ACGTACGTACGTACGTACGT", "I" * 20, 1),
        ("t1", 16, "c", 3, 40, "5S5M2D5M", "TTTTTGTACGacgta", "I" * 15, 2),
        ("t2", 16, "c", 1, 40, "6M4I10M", "ACGTACTTTTGTACGTACGA", "I" * 10 + "!" * 4 + "I" * 6, 3),
        ("t3", 0, "d", 250, 30, "20M", "CCCCCCCCCCCCCCCCCCCC", "5" * 20, None),
        ("t3", 0, "d", 252, 30, "20M", "CCCCCGGGGGCCCCCCCCCC", "5" * 20, 5),
        ("t4", 0, "c", 1, 40, "20M", "ACG", "I" * 20, 6),
        ("t5", 0, "c", 2, 40, "*", "ACGT", "IIII", 7),
        (None, 0, "c", 1, 40, "20M", "ACGTACGTACGTACGTACGT", "I" * 20, 8),
        (None, 16, "c", 1, 40, "20M", "AAAAAAAAAAAAAAAAAAAA", "I" * 20, 9),
        ("t6", 0, None, 1, 40, "20M", "ACGTACGTACGTACGTACGT", "I" * 20, 10),
        ("t7", 0, "c", None, 40, "20M", "ACGTACGTACGTACGTACGT", "I" * 20, 11),
        ("t8", 0, "c", 4, 40, "20M", None, "I" * 20, 12),
        ("t9", 0, "c", 4, 40, "20M", "ACGTACGTACGTACGTACGT", None, 13),
    ]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string, ordinal long")
    return reads.prepare_reads(df, walk=False), rows


def bases_by_hand(rows, quality):
    """(template, contig, site, base, reverse, ordinal, place, length, bq) of every aligned base."""
    import re

    for name, flag, contig, pos, _, cigar, seq, qual, ordinal in rows:
        if pos is None or qual is None:
            continue
        ref, query = pos, 0
        for n, op in re.findall(r"(\d+)([MIDS])", cigar):
            for i in range(int(n) if op == "M" else 0):
                base = None if seq is None else seq[query + i : query + i + 1].upper()
                bq = ord(qual[query + i]) - 33 if query + i < len(qual) else -33
                if bq >= quality:
                    yield name, contig, ref + i, base, flag == 16, ordinal, query + i, len(seq or ""), bq
            ref += int(n) if op in "MD" else 0
            query += int(n) if op in "MIS" else 0


def test_bases_at_listed_positions_are_counted_where_the_reads_are(spark):
    from collections import Counter

    from genoweave.functions import basewalk

    prepared, rows = odd_reads(spark)
    sites = spark.createDataFrame([("c", p, "A", "C") for p in (1, 4, 5, 9, 9, 20, 23)] + [("d", 255, "C", "G"), ("d", 256, "C", "G"), ("e", 1, "A", "C"), (None, 1, "A", "C")], "site_contig string, site long, site_ref string, site_alt string")
    listed = {("c", p) for p in (1, 4, 5, 9, 20, 23)} | {("d", 255), ("d", 256)}
    got = reads.position_counts(prepared, sites, 20, F.col("reverse").cast("int"))
    assert "Generate explode(sequence(low" not in got._jdf.queryExecution().optimizedPlan().toString() and "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = Counter((c, s, b, int(r)) for _, c, s, b, r, *_ in bases_by_hand(rows, 20) if (c, s) in listed)
    assert {(r["site_contig"], r["site"], r["base"], r["tag"]): r["n"] for r in got.collect()} == dict(want) and want
    # small pieces and many counts held give the same
    by_hand = Counter((c, s, b) for _, c, s, b, *_ in bases_by_hand(rows, -100) if (c, s) in listed)
    import pyarrow as pa

    met = reads.meet_marks(prepared, reads.listed_marks(sites.withColumn("mark", F.lit(1))), F.lit(0).alias("tag")).toArrow()
    held, piece = basewalk.HELD, basewalk.PIECE
    try:
        basewalk.HELD, basewalk.PIECE = 2, 8
        parts = pa.Table.from_batches(list(basewalk.tally_bases(-100)(iter(met.to_batches(max_chunksize=3))))).to_pylist()
    finally:
        basewalk.HELD, basewalk.PIECE = held, piece
    seen = Counter()
    for r in parts:
        seen[r["contig"], r["site"], None if r["base"] < 0 else chr(r["base"]) if r["base"] else ""] += r["n"]
    assert seen == by_hand


def test_reads_of_a_template_agree_or_the_first_decides(spark):
    from collections import defaultdict

    prepared, rows = odd_reads(spark)
    sites = spark.createDataFrame([("c", p, "A", "C") for p in range(1, 25)] + [("d", p, "C", "G") for p in range(250, 275)], "site_contig string, site long, site_ref string, site_alt string")
    shown = defaultdict(list)
    for name, c, s, b, _, ordinal, *_ in bases_by_hand(rows, 20):
        if c is not None:
            shown[name, c, s].append((ordinal, b))
    want = defaultdict(lambda: [0] * 5)
    first = defaultdict(int)
    for (_, c, s), seen in shown.items():
        letters = {b for _, b in seen if b is not None}
        ref, alt = ("A", "C") if c == "c" else ("C", "G")
        call = letters.pop() if len(letters) == 1 else "discordant"
        counts = want[c, s]
        counts[0] += 1
        counts[["ref", "alt", "other", "discordant"].index("discordant" if call == "discordant" else "ref" if call == ref else "alt" if call == alt else "other") + 1] += 1
        known = sorted((o, b) for o, b in seen if o is not None)
        first[c, s, known[0][1] if known else None] += 1
    got = reads.template_site_counts(prepared, sites)
    assert {(r["site_contig"], r["site"]): [r[f"{x}templates"] for x in ("", "ref_", "alt_", "other_", "discordant_")] for r in got.collect()} == dict(want)
    got = reads.first_read_counts(prepared, sites, "ordinal")
    assert {(r["site_contig"], r["site"], r["base"]): r["templates"] for r in got.collect()} == dict(first)


def test_molecules_send_their_bases_and_alleles_in_few_bytes(spark):
    from collections import defaultdict

    from genoweave.operators import phase

    prepared, rows = odd_reads(spark)
    prepared = prepared.withColumn("molecule", F.col("qname"))
    shown = defaultdict(set)
    sure = defaultdict(set)
    starts = defaultdict(set)
    for name, c, s, b, reverse, ordinal, place, length, bq in bases_by_hand(rows, 10):
        if b in tuple("ACGT"):
            shown[name, c, s].add(b)
            if bq >= 20 and min(place, length - place - 1) >= 5:
                sure[name, c, s].add(b)
                starts[c, s, b].add(([r[3] for r in rows if r[8] == ordinal][0], reverse))
    want = defaultdict(int)
    for tier, seen in (("exploratory", shown), ("strict", sure)):
        for (_, c, s), letters in seen.items():
            if len(letters) == 1:
                want[tier, c, s, *letters] += 1
    counts = phase.base_counts(phase.molecule_bases(phase.observations(prepared)))
    assert {(r["tier"], r["contig"], r["pos"], r["base"]): r["molecules"] for r in counts.collect()} == dict(want)
    got = phase.strict_starts(phase.observations(prepared)).collect()
    assert {(r["contig"], r["pos"], r["base"]): (r["alt_strands"], r["alt_starts"]) for r in got} == {k: (len({x[1] for x in v}), len(v)) for k, v in starts.items()}
    # substitutions go packed, an indel beside them is read one by one; both say the same of a substitution
    snvs = [("c", p, a, b) for p, a, b in zip(range(6, 16), "CGTACGTACG", "GTACGTACGT")]
    plain = phase.molecule_alleles(prepared, spark.createDataFrame(snvs, "contig string, pos long, ref string, alt string"))
    assert plain.columns == ["contig", "molecule", "seen"]
    mixed = phase.molecule_alleles(prepared, spark.createDataFrame([*snvs, ("c", 30, "AC", "A")], "contig string, pos long, ref string, alt string"))
    usable = prepared.filter("pos is not null and qual is not null and cigar <> '*' and length(seq) >= 15")
    slow = phase.read_alleles(usable, spark.createDataFrame(snvs, "contig string, pos long, ref string, alt string"))
    listed = lambda df: sorted(map(repr, map(tuple, df.select("contig", "molecule", "pos", "ref", "alt", "allele").collect())))
    assert listed(phase.each_allele(plain)) == listed(slow) and slow.count() > 5
    assert mixed.columns == ["contig", "molecule", "pos", "ref", "alt", "allele"] and listed(mixed) == listed(slow)
    # pairs are counted in the cell of their first marker
    per = defaultdict(list)
    for r in slow.collect():
        per[r["contig"], r["molecule"]].append((r["pos"], r["allele"]))
    pairs = defaultdict(int)
    for (c, _), seen in per.items():
        for i, a in enumerate(sorted(seen)):
            for b in sorted(seen)[i + 1 :]:
                pairs[c, a[0], b[0], a[1], b[1]] += 1
    for alleles in (plain, slow):
        got = phase.phase_edges(alleles)
        assert {(r["contig"], r["pos1"], r["pos2"], r["allele1"], r["allele2"]): r["molecules"] for r in got.collect()} == dict(pairs) and pairs
