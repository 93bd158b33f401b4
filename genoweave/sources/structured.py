"""JSON documents, graph ontologies, sinks and file manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.session import guard

TRANSCRIPT = (
    "struct<id: string, display_name: string, strand: int, start: long, end: long, biotype: string, is_canonical: int, "
    "version: int, MANE: array<struct<type: string, refseq_match: string>>, "
    "Translation: struct<start: long, end: long, length: int>, Exon: array<struct<start: long, end: long>>>"
)
GENE_SCHEMA = (
    "struct<id: string, display_name: string, assembly_name: string, seq_region_name: string, start: long, end: long, strand: int, "
    f"description: string, canonical_transcript: string, Transcript: array<{TRANSCRIPT}>>"
)
HASHED_LIMIT = 1 << 30


def parse_genes(docs: DataFrame, text: str = "json") -> DataFrame:
    """Expanded gene JSON to (gene, seq_region_name, start, end, strand, transcripts)."""
    g = docs.select(F.from_json(text, GENE_SCHEMA).alias("g"))
    return g.select(
        F.col("g.display_name").alias("gene"), F.col("g.id").alias("gene_id"), F.col("g.assembly_name").alias("assembly"),
        F.regexp_replace("g.seq_region_name", "^chr", "").alias("seq_region_name"), F.col("g.start").alias("start"), F.col("g.end").alias("end"),
        F.col("g.strand").alias("strand"), F.substring_index("g.canonical_transcript", ".", 1).alias("canonical_id"), F.col("g.Transcript").alias("transcripts"),
    )


def canonical_transcripts(genes: DataFrame) -> DataFrame:
    """The single translated canonical transcript per GRCh38 gene, else the job fails."""
    chosen = F.filter("transcripts", lambda t: (F.coalesce(t["is_canonical"], F.lit(0)) == 1) | (t["id"] == F.col("canonical_id")))
    picked = genes.withColumn("_t", chosen)
    ok = (F.col("assembly") == "GRCh38") & (F.size("_t") == 1) & F.get("_t", F.lit(0))["Translation"].isNotNull()
    checked = guard(picked, ok, "expected one translated canonical transcript of a GRCh38 gene")
    t = F.get("_t", F.lit(0))
    return checked.select(
        "gene", F.concat(F.lit("chr"), "seq_region_name").alias("contig"), "start", "end", t["id"].alias("tx"), t["strand"].alias("strand"),
        F.least(t["Translation"]["start"], t["Translation"]["end"]).alias("cds_start"),
        F.greatest(t["Translation"]["start"], t["Translation"]["end"]).alias("cds_end"), t["Exon"].alias("exons"),
    )


def transcript_exons(transcripts: DataFrame) -> DataFrame:
    """One row per exon: gene, tx, contig, strand, start, end, cds_start, cds_end."""
    return transcripts.select("gene", "tx", "contig", "strand", "cds_start", "cds_end", F.explode("exons").alias("_e")).select(
        "gene", "tx", "contig", "strand", F.col("_e.start").alias("start"), F.col("_e.end").alias("end"), "cds_start", "cds_end"
    )


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name without suffix as id, and the whole text as ``json``."""
    docs = spark.read.option("wholetext", True).text(path)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.json)?(\.gz)?$", 1)
    return docs.select(name.alias("id"), F.col("value").alias("json"))


def parse_responses(docs: DataFrame, schema: str, name: str, text: str = "json") -> DataFrame:
    """Saved responses parsed with a fixed schema; unreadable text fails the job."""
    parsed = docs.withColumn(name, F.from_json(text, schema, {"mode": "FAILFAST"}))
    return parsed.drop(text)


def graph_labels(docs: DataFrame, text: str = "json") -> DataFrame:
    """HPO id and label of graph-JSON nodes."""
    schema = "struct<graphs: array<struct<nodes: array<struct<id: string, lbl: string>>>>>"
    nodes = docs.select(F.explode(F.from_json(text, schema)["graphs"][0]["nodes"]).alias("n"))
    hpo = F.replace(F.substring_index("n.id", "/", -1), F.lit("HP_"), F.lit("HP:"))
    return nodes.filter(F.col("n.id").startswith("http://purl.obolibrary.org/obo/HP_")).select(hpo.alias("hpo_id"), F.coalesce("n.lbl", F.lit("")).alias("label"))


def write_new(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write to a path that must not exist. fmt: parquet, tsv, json or jsonl.gz."""
    writer = df.write.mode("errorifexists")
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "tsv":
        writer.option("sep", "\t").option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "jsonl.gz":
        writer.option("compression", "gzip").json(path)
    else:
        raise ValueError(f"unknown format: {fmt}")


def write_by_position(calls: DataFrame, path: str, partitions: int | None = None) -> None:
    """Calls as Parquet ranged by contig and position, so region filters prune files and row groups."""
    keys = ["contig", "pos"]
    ranged = calls.repartitionByRange(partitions, *keys) if partitions else calls.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def file_listing(spark: SparkSession, path: str) -> DataFrame:
    """Path, bytes and modification time of files; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def file_manifest(spark: SparkSession, path: str, limit: int = HASHED_LIMIT) -> DataFrame:
    """Listing plus SHA-256 of files up to ``limit`` bytes; larger files keep size and time only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    small = files.load(path).filter(F.col("length") <= limit)
    hashed = small.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    large = file_listing(spark, path).filter(F.col("bytes") > limit).withColumn("sha256", F.lit(None).cast("string"))
    return hashed.unionByName(large)
