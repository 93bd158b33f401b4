"""Line-based genomic formats as typed frames.

Each ``parse_*`` takes lines in a column ``value``; each ``read_*`` is that parser over files.
bgzip and gzip files are one task each: convert once to Parquet sorted by contig and position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.functions import genotype as fg
from genoweave.operators.alleles import CHUNK_STEP
from genoweave.session import guard

TAB = "\t"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))


def _cells(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return df.select(*(keep or []), F.split("value", TAB).alias("c"))


def _cell(i: int) -> Column:
    return F.get("c", F.lit(i))


def _dot_null(c: Column) -> Column:
    return F.when(~c.isin(".", ""), c)


def format_map(keys: Column, sample: Column) -> Column:
    """FORMAT keys to sample values; trailing values left out are NULL."""
    names, values = F.split(keys, ":"), F.split(sample, ":")
    padded = F.transform(F.sequence(F.lit(0), F.size(names) - 1), lambda i: F.get(values, i))
    return F.map_from_arrays(names, padded)


def info_map(info: Column) -> Column:
    """INFO text to a map; a flag has an empty value; '.' is an empty map."""
    entries = F.filter(F.split(F.when(info == ".", "").otherwise(info), ";"), lambda e: e != "")
    return F.map_from_entries(
        F.transform(entries, lambda e: F.struct(F.substring_index(e, "=", 1).alias("k"), F.when(F.instr(e, "=") > 0, F.substring(e, F.instr(e, "=") + 1, F.length(e))).otherwise("").alias("v")))
    )


def parse_vcf(text: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Single-sample VCF lines; any other number of columns fails the job.

    FILTER '.' is an empty array and PASS is ['PASS'].
    """
    cells = _cells(text.filter(~F.col("value").startswith("#")), keep)
    checked = guard(cells, F.size("c") == 10, "use a single-sample VCF")
    call = format_map(_cell(8), _cell(9))
    rows = checked.withColumn("_f", call)
    def field(name):
        return _dot_null(F.try_element_at("_f", F.lit(name)))
    gt = F.try_element_at("_f", F.lit("GT"))
    return rows.select(
        *(keep or []),
        _cell(0).alias("contig"), _cell(1).cast("long").alias("pos"), _dot_null(_cell(2)).alias("id"), _cell(3).alias("ref"),
        F.when(_cell(4) == ".", F.array().cast("array<string>")).otherwise(F.split(_cell(4), ",")).alias("alts"),
        _cell(5).alias("qual_text"), _cell(5).try_cast("double").alias("qual"),
        F.when(_cell(6) == ".", F.array().cast("array<string>")).otherwise(F.split(_cell(6), ";")).alias("filters"),
        info_map(_cell(7)).alias("info"), gt.alias("gt_text"), fg.parse_gt(gt).alias("gt"),
        F.coalesce(fg.is_phased(gt), F.lit(False)).alias("phased"), fg.parse_ints(field("AD")).alias("ad"),
        fg.parse_ints(field("PL")).alias("pl"), field("DP").try_cast("int").alias("dp"), field("GQ").try_cast("int").alias("gq"),
        field("PS").alias("ps"),
    )


def parse_sites_vcf(text: DataFrame) -> DataFrame:
    """VCF lines without samples; a FORMAT column fails the job."""
    cells = guard(_cells(text.filter(~F.col("value").startswith("#"))), F.size("c") == 8, "expected a sites-only VCF")
    return cells.select(
        _cell(0).alias("contig"), _cell(1).cast("long").alias("pos"), _dot_null(_cell(2)).alias("id"), _cell(3).alias("ref"),
        F.split(_cell(4), ",").alias("alts"), info_map(_cell(7)).alias("info"),
    )


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return parse_vcf(lines(spark, path), ["file"])


def parse_sam(text: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """SAM lines without header; shorter than 11 columns is no record."""
    cells = _cells(text.filter(~F.col("value").startswith("@")), keep).filter(F.size("c") >= 11)
    tags = F.map_from_entries(
        F.transform(
            F.filter(F.slice("c", F.lit(12), F.greatest(F.size("c") - 11, F.lit(0))), lambda t: t.rlike("^[A-Za-z][A-Za-z0-9]:[A-Za-z]:")),
            lambda t: F.struct(F.substring(t, 1, 2).alias("k"), F.substring(t, F.lit(6), F.length(t)).alias("v")),
        )
    )
    number = lambda i: _cell(i).try_cast("long")
    return cells.withColumn("tags", tags).select(
        *(keep or []),
        _cell(0).alias("qname"), _cell(1).cast("int").alias("flag"), _cell(2).alias("rname"), number(3).alias("pos"),
        _cell(4).cast("int").alias("mapq"), _cell(5).alias("cigar"), _cell(6).alias("mate_rname"),
        F.coalesce(number(7), F.lit(0)).alias("mate_pos"), F.coalesce(number(8), F.lit(0)).alias("tlen"),
        _cell(9).alias("seq"), _cell(10).alias("qual"), "tags",
        F.coalesce(F.try_element_at("tags", F.lit("SA")), F.lit("")).alias("sa"),
        F.try_element_at("tags", F.lit("s1")).try_cast("int").alias("s1"), F.try_element_at("tags", F.lit("s2")).try_cast("int").alias("s2"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return parse_sam(lines(spark, path), ["file"])


def parse_intervals(text: DataFrame, chrom: int, start: int, end: int, allowed: list[str] | None = None) -> DataFrame:
    """BED-like lines by column number; '#' lines, blank lines and empty intervals are left out."""
    body = text.filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    rows = _cells(body).select(_cell(chrom).alias("chrom"), _cell(start).cast("long").alias("start"), _cell(end).cast("long").alias("end"))
    if allowed is not None:
        rows = rows.filter(F.col("chrom").isin(*allowed))
    return rows.filter("end > start")


def parse_depth(text: DataFrame) -> DataFrame:
    return _cells(text).select(_cell(0).alias("chrom"), _cell(1).cast("long").alias("pos"), _cell(2).cast("long").alias("depth"))


def parse_regions(text: DataFrame) -> DataFrame:
    c = F.split(F.trim("value"), r"\s+")
    return text.select(c.alias("c")).select(
        _cell(0).alias("chrom"), _cell(1).cast("long").alias("start"), _cell(2).cast("long").alias("end"), _cell(3).cast("double").alias("depth")
    )


def parse_genepred(text: DataFrame, canonical: list[str] | None = None) -> DataFrame:
    """genePred rows: one per transcript with exon arrays; canonical contigs only when given."""
    def numbers(i):
        return F.transform(F.filter(F.split(_cell(i), ","), lambda v: v != ""), lambda v: v.cast("long"))
    rows = _cells(text).select(
        _cell(1).alias("tx"), _cell(2).alias("chrom"), _cell(3).alias("strand"), _cell(4).cast("long").alias("tx_start"),
        _cell(5).cast("long").alias("tx_end"), _cell(6).cast("long").alias("cds_start"), _cell(7).cast("long").alias("cds_end"),
        F.arrays_zip(numbers(9).alias("start"), numbers(10).alias("end")).alias("exons"), _cell(12).alias("gene"),
    )
    return rows.filter(F.col("chrom").isin(*canonical)) if canonical else rows


def gene_rollup(genepred: DataFrame) -> DataFrame:
    """Gene span and transcript count per (chrom, gene)."""
    return genepred.groupBy("chrom", "gene").agg(F.min("tx_start").alias("start"), F.max("tx_end").alias("end"), F.count("*").alias("transcripts"))


def genepred_exons(genepred: DataFrame) -> DataFrame:
    """Exon rows numbered in transcription order."""
    rows = genepred.select("gene", "tx", "chrom", "strand", "cds_start", "cds_end", F.size("exons").alias("_n"), F.posexplode("exons").alias("_i", "_e"))
    number = F.when(F.col("strand") == "+", F.col("_i") + 1).otherwise(F.col("_n") - F.col("_i"))
    return rows.select("gene", "tx", "chrom", "strand", number.alias("exon_number"), F.col("_e.start").alias("start"), F.col("_e.end").alias("end"), "cds_start", "cds_end")


def by_header(lines: DataFrame, columns: list[str], required: list[str] | None = None, key: str | None = None, whole: str | None = None) -> DataFrame:
    """Named columns of tab-separated lines, whatever the column order of each file.

    A file's header is its line that names every ``required`` column (all of ``columns`` unless
    given), wherever Spark reads it; '#' before the first name is left out. Values are taken by the
    place of their name in it, so a column that a file lacks is NULL. ``key`` names a file; lines of
    a file without a header follow the header of its ``whole`` (a set of files with one header),
    and without that have ``header`` NULL. Header lines and '#' lines are no rows.
    """
    needed = required or columns
    names = F.transform(F.split(F.regexp_replace("value", r"^#+|[\r\n]+$", ""), TAB), F.trim)
    marked = lines.withColumn("_names", names).withColumn("_head", F.size(F.array_except(F.array(*[F.lit(c) for c in needed]), "_names")) == 0)
    rows = marked.filter(~F.col("_head") & ~F.col("value").startswith("#"))
    heads = marked.filter("_head")
    keys = [k for k in (key, whole) if k]
    if not keys:
        rows, heads, keys = rows.withColumn("_k", F.lit(1)), heads.withColumn("_k", F.lit(1)), ["_k"]
    for i, k in enumerate(dict.fromkeys(keys)):
        one = heads.groupBy(k).agg(F.min("_names").alias(f"_h{i}"), F.count_distinct("_names").alias(f"_n{i}"))
        # of several headers in one set of files none can stand for the rest
        rows = rows.join(one.select(k, F.when((F.lit(i) == 0) | (F.col(f"_n{i}") == 1), F.col(f"_h{i}")).alias(f"_h{i}")), k, "left")
    found = rows.withColumn("header", F.coalesce(*[F.col(f"_h{i}") for i in range(len(dict.fromkeys(keys)))])).withColumn("c", F.split(F.regexp_replace("value", r"[\r\n]+$", ""), TAB))
    value = lambda name: F.when(F.array_position("header", name) > 0, F.get("c", (F.array_position("header", name) - 1).cast("int")))
    kept = [k for k in dict.fromkeys(keys) if k != "_k"]
    return found.select(*kept, *[value(c).alias(c) for c in columns], "header")


def parse_headed(text: DataFrame, columns: list[str], key: str | None = None) -> DataFrame:
    """TSV lines whose header may start with '#': the given columns by name, header lines dropped."""
    return by_header(text, columns, key=key).select(*([key] if key else []), *columns)


def read_headed(spark: SparkSession, path: str) -> DataFrame:
    """TSV files with a header that may start with '#'."""
    df = spark.read.option("header", True).option("sep", TAB).csv(path)
    return df.toDF(*[c.lstrip("#") for c in df.columns])


#: Columns that every score file has, and those that mark models which are not additive.
SCORE_COLUMNS = ["hm_chr", "hm_pos", "effect_allele", "effect_weight"]
COMPLEX_COLUMNS = ["is_haplotype", "is_diplotype", "is_interaction"]


def score_metadata(text: DataFrame, key: str = "file") -> DataFrame:
    """'#key=value' header lines of score files as one map per file; of a key's values the last in file order counts.

    Lines in order have a column ``at`` (place in the file), else the order of reading stands in.
    """
    order = F.struct("file", "at") if {"file", "at"} <= set(text.columns) else F.monotonically_increasing_id()
    head = text.withColumn("_n", order).filter(F.col("value").startswith("#") & (F.instr("value", "=") > 0)).withColumn("_t", F.regexp_replace("value", r"^[#\s]+|\s+$", ""))
    pair = F.struct(F.lower(F.trim(F.substring_index("_t", "=", 1))).alias("k"), F.trim(F.expr("substring(_t, instr(_t, '=') + 1)")).alias("v"))
    per = head.select(key, pair.alias("p"), "_n").groupBy(key, F.col("p.k").alias("k")).agg(F.max_by("p.v", "_n").alias("v"))
    return per.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metadata"))


def score_rows(text: DataFrame, columns: list[str] | None = None, key: str = "file") -> DataFrame:
    """Score rows by the header of their file, or of their model where the file has none; ``header`` is NULL without either."""
    wanted = columns or [*SCORE_COLUMNS, *COMPLEX_COLUMNS]
    return by_header(text, wanted, required=["effect_allele", "effect_weight"], key="file", whole=key)


def parse_pvar(text: DataFrame) -> DataFrame:
    """Variant table lines: chrom (plain), pos, id and upper-case alleles."""
    from genoweave.functions import coords

    body = text.filter(~F.col("value").startswith("#"))
    alleles = F.array_distinct(F.concat(F.array(F.upper(_cell(3))), F.filter(F.split(F.upper(_cell(4)), ","), lambda a: a != "")))
    return _cells(body).select(coords.chrom_key(_cell(0)).alias("chrom"), _cell(1).cast("long").alias("pos"), _cell(2).alias("variant_id"), alleles.alias("alleles"))


def parse_paf(text: DataFrame) -> DataFrame:
    """PAF lines: query, target, score (AS tag, else residue matches) and mapping quality."""
    cells = _cells(text).filter(F.size("c") >= 12)
    tag = F.get(F.filter("c", lambda t: t.startswith("AS:i:")), F.lit(0))
    return cells.select(
        _cell(0).alias("query"), _cell(5).alias("target"),
        F.coalesce(F.substring(tag, 6, 20).try_cast("int"), _cell(9).cast("int")).alias("score"), _cell(11).cast("int").alias("mapq"),
    )


def parse_pileup(text: DataFrame) -> DataFrame:
    """Pileup lines with at least six columns."""
    cells = _cells(text).filter(F.size("c") >= 6)
    return cells.select(_cell(0).alias("contig"), _cell(1).cast("long").alias("pos"), F.upper(_cell(2)).alias("ref"), _cell(3).cast("int").alias("reported_depth"), _cell(4).alias("bases"))


def chunk_sequences(records: DataFrame, step: int = CHUNK_STEP) -> DataFrame:
    """(contig, seq) rows to upper-case chunks of ``step`` bases that tile each contig."""
    # Cut in one pass: a substring would walk from the start of the contig for every chunk.
    upper = F.upper("seq")
    pieces = F.when(F.length(upper) > 0, F.regexp_extract_all(upper, F.lit(f"(?s).{{1,{step}}}"), 0)).otherwise(F.array(upper))
    rows = records.select("contig", F.posexplode(pieces).alias("_i", "seq"))
    number = F.col("_i").cast("long")
    return rows.select("contig", number.alias("chunk_id"), (number * step).alias("chunk_start"), "seq")


def parse_obo(records: DataFrame) -> DataFrame:
    """'[Term]'-separated OBO records to (hpo_id, label)."""
    term = F.regexp_extract("value", r"(?m)^id: (HP:\S+)", 1)
    name = F.trim(F.regexp_extract("value", r"(?m)^name: (.+)$", 1))
    return records.select(term.alias("hpo_id"), name.alias("label")).filter("hpo_id <> '' and label <> ''")


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return parse_obo(spark.read.option("lineSep", "[Term]").text(path))


def parse_kraken(text: DataFrame, selected: DataFrame) -> DataFrame:
    """Unclassified, classified and total pairs of a report; the total must equal ``selected.pairs``."""
    rows = _cells(text).select("c").select(_cell(1).try_cast("long").alias("pairs"), F.trim(_cell(4)).alias("taxid"))
    counts = rows.agg(
        F.coalesce(F.sum(F.when(F.col("taxid") == "0", F.col("pairs"))), F.lit(0)).alias("unclassified"),
        F.coalesce(F.sum(F.when(F.col("taxid") == "1", F.col("pairs"))), F.lit(0)).alias("classified"),
    ).withColumn("total", F.col("unclassified") + F.col("classified"))
    # Both sides are one-row aggregates.
    both = counts.withColumn("_k", F.lit(1)).join(selected.agg(F.sum("pairs").alias("selected")).withColumn("_k", F.lit(1)), "_k").drop("_k")
    return guard(both, F.col("total") == F.col("selected"), "report total differs from the selected pairs").drop("selected")
