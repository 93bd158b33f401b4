"""FASTA files as sequence chunks, read in as many tasks as the files have blocks.

A record may span any number of blocks. The tasks that read the lines join them to pieces of a few
thousand bases, numbered inside their block; one summary row per block carries the open record
and its length along the file, so every piece learns its contig and offset; pieces are then cut
at chunk borders and joined to chunks by one shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from genoweave.operators.alleles import CHUNK_STEP
from genoweave.session import cut_lineage, guard

#: Bases of a piece, about.
PIECE = 20_000
PIECES = "file string, block long, record int, name string, at long, bases string, size long"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the lines of a partition, which holds whole blocks in order.

    ``record`` 0 goes on from the block before; each header opens the next, with an empty piece.
    """
    here, record, name, at = None, 0, None, 0
    held: list[str] = []
    size = 0
    rows: list[tuple] = []

    def flush() -> None:
        nonlocal held, size, at
        text = "".join(held)
        for i in range(0, len(text), PIECE):
            part = text[i : i + PIECE]
            rows.append((*here, record, name, at, part, len(part)))
            at += len(part)
        held, size = [], 0

    def batch() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
        rows.clear()
        return out

    for b in batches:
        for file, block, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if (file, block) != here:
                if here is not None:
                    flush()
                here, record, name, at = (file, block), 0, None, 0
            if line.startswith(">"):
                flush()
                words = line[1:].split(None, 1) if line[1:2].strip() else []
                record, name, at = record + 1, words[0] if words else "", 0
                rows.append((*here, record, name, 0, "", 0))
            else:
                line = line.strip()
                held.append(line)
                size += len(line)
                if size >= PIECE:
                    flush()
        if rows:
            yield batch()
    if here is not None:
        flush()
        if rows:
            yield batch()


# executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(contig, at, bases): stretches of every record with their offset in it."""
    text = spark.read.text(path).select("_metadata.file_path", "_metadata.file_block_start", "value")
    cut = cut_lineage(text.mapInArrow(_pieces, PIECES))
    open_tail = F.max(F.struct("record", "name"))
    per = cut.groupBy("file", "block", "record").agg(F.max("name").alias("name"), F.sum("size").alias("size"))
    blocks = per.groupBy("file", "block").agg(open_tail.alias("last"), F.max_by("size", "record").alias("tail"))
    # one row per block of a file
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.when(F.col("last.record") > 0, F.struct(F.col("last.name").alias("name"), F.col("before").alias("before")))
    summed = blocks.withColumn("before", F.coalesce(F.sum("tail").over(earlier), F.lit(0)))
    opened = summed.withColumn("head", F.last(heads, ignorenulls=True).over(earlier))
    carried = opened.select("file", "block", F.col("head.name").alias("open"), (F.col("before") - F.col("head.before")).alias("base"))
    placed = cut.join(carried, ["file", "block"])
    goes_on = F.col("record") == 0
    named = placed.filter(~goes_on | (F.col("size") > 0)).select(
        F.when(goes_on, F.col("open")).otherwise(F.col("name")).alias("contig"), (F.col("at") + F.when(goes_on, F.col("base")).otherwise(F.lit(0))).alias("at"), "bases", "size"
    )
    return guard(named, F.col("contig").isNotNull(), "sequence before the first header").select("contig", "at", "bases", "size")


def read_fasta(spark: SparkSession, path: str, step: int = CHUNK_STEP) -> DataFrame:
    """FASTA files as upper-case chunks of ``step`` bases: (contig, chunk_id, chunk_start, seq).

    Soft-masked bases lose their case, a contig is the header's first word, blanks around a line and
    carriage returns go, an empty record is one empty chunk. Blocks of plain files are read by as
    many tasks; a gzip file is one block, and a line is one task's.
    """
    first, last = F.floor(F.col("at") / step), F.floor((F.col("at") + F.greatest(F.col("size"), F.lit(1)) - 1) / step)
    spread = pieces(spark, path).withColumn("chunk_id", F.explode(F.sequence(first, last)))
    start = F.col("chunk_id") * step
    offset = F.greatest(start - F.col("at"), F.lit(0))
    length = F.least(start + step - F.col("at"), F.col("size")) - offset
    parts = spread.select("contig", F.col("chunk_id").cast("long").alias("chunk_id"), (F.col("at") + offset).alias("from"), F.substring("bases", (offset + 1).cast("int"), length.cast("int")).alias("part"))
    # a chunk holds some pieces, and one empty one if a record starts in it
    whole = parts.groupBy("contig", "chunk_id").agg(F.array_sort(F.collect_list(F.struct("from", "part"))).alias("p"))
    return whole.select("contig", "chunk_id", (F.col("chunk_id") * step).alias("chunk_start"), F.upper(F.array_join(F.transform("p", lambda x: x["part"]), "")).alias("seq"))
