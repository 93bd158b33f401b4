import random

import pytest

from genoweave.sources import fasta


def write(path, records, width, end="\n"):
    with open(path, "w", newline="") as f:
        for name, seq in records:
            f.write(f">{name} some text{end}")
            for i in range(0, len(seq), width):
                f.write(seq[i : i + width] + end)


def chunks(records, step):
    return {(n, i // step): s[i : i + step].upper() for n, s in records for i in range(0, max(len(s), 1), step)}


@pytest.fixture
def blocks(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda n: [spark.conf.set(k, str(n)) for k in old]
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_records_across_blocks(spark, tmp_path, blocks, block):
    r = random.Random(3)
    base = lambda n: "".join(r.choice("ACGTacgtN") for _ in range(n))
    a = [("c1", base(4000)), ("empty", ""), ("c2", base(1)), ("c3", base(60)), ("c4", base(1777))]
    b = [("d1", base(900)), ("d2", "")]
    write(tmp_path / "a.fa", a, 60)
    write(tmp_path / "b.fa", b, 37, "\r\n")
    blocks(block)
    got = fasta.read_fasta(spark, str(tmp_path), step=128)
    assert {(x["contig"], x["chunk_id"]): x["seq"] for x in got.collect()} == chunks([*a, *b], 128)
    assert all(x["chunk_start"] == 128 * x["chunk_id"] for x in got.collect())


def test_one_record_is_many_tasks(spark, tmp_path, blocks):
    r = random.Random(4)
    records = [("long", "".join(r.choice("ACGT") for _ in range(300_000)))]
    write(tmp_path / "l.fa", records, 80)
    blocks(20_000)
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    assert {(x["contig"], x["chunk_id"]): x["seq"] for x in fasta.read_fasta(spark, str(tmp_path)).collect()} == chunks(records, 10_000)


def test_sequence_without_header_fails(spark, tmp_path):
    (tmp_path / "x.fa").write_text("ACGT\n>c\nAC\n")
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta(spark, str(tmp_path)).collect()


def test_empty_and_packed_files(spark, tmp_path):
    import gzip

    (tmp_path / "none.fa").write_text("")
    with gzip.open(tmp_path / "p.fa.gz", "wt") as f:
        f.write(">c1 text\nACGT\nacg\n\n>c2\nTT\n")
    assert {(x["contig"], x["chunk_id"]): x["seq"] for x in fasta.read_fasta(spark, str(tmp_path), step=4).collect()} == {("c1", 0): "ACGT", ("c1", 1): "ACG", ("c2", 0): "TT"}
