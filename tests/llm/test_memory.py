"""What the driver and a task hold: bounds on traced memory, with the same results."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from genoweave import session
from genoweave.llm import pu_quality, toivonen
from genoweave.llm.common import gives_back
from genoweave.session import cut_lineage


def peak(work):
    tracemalloc.start()
    work()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most


def test_training_keeps_no_second_copy_of_the_sample_in_the_driver():
    r = np.random.default_rng(3)
    p, u = r.random((2000, pu_quality.WIDTH), np.float32), r.random((20000, pu_quality.WIDTH), np.float32)
    net = pu_quality.Network(pu_quality.WIDTH)
    most = peak(lambda: net.fit(p, u, 0.5, epochs=1))
    assert most < u.nbytes
    both = np.vstack([p, u])
    assert np.allclose(net.mean, both.mean(0, dtype=float), atol=1e-5) and np.allclose(net.scale, both.std(0, dtype=float) + 1e-3, atol=1e-5)
    packed = pa.chunked_array([pa.array([x.tobytes() for x in u[a : a + 700]], pa.binary()) for a in range(0, 2100, 700)])
    chosen = r.random(2100) < 0.5
    assert (pu_quality.stacked(packed, chosen) == u[:2100][chosen]).all()


def test_a_chunk_of_phrases_needs_little_more_memory_than_its_words(monkeypatch):
    text = pa.array(["some words, of a text that goes on and on. " * 20] * 2400)
    langs = pa.array(["en"] * len(text))
    size = len(text[0].as_py()) * len(text)
    # with arrays of eight bytes for a byte of text it was 66 bytes a byte, now 33
    assert peak(lambda: [r.phrases(np.flatnonzero(r.valid(3)), 3) for r, _ in toivonen.runs_of(text, langs)]) < 45 * size
    monkeypatch.setattr(toivonen, "CHUNK", 50)
    raw, offsets = np.frombuffer(b"a b.c" + b"d" * 200 + b"e.f" + b"g" * 70 + b"h" * 130 + b"!", np.uint8), np.array([0, 4, 278, 278, 409])
    cuts = np.union1d(np.flatnonzero(toivonen.KIND[raw] == 2) + 1, offsets[1:])
    want, at = [], 0
    while at < len(raw):
        near = [c for c in cuts if at < c <= at + 50] or [min(c for c in cuts if c > at)]
        want.append(int(near[-1]))
        at = want[-1]
    assert list(toivonen.chunk_ends(raw, offsets)) == want


def test_a_written_table_leaves_no_shuffle_files(spark):
    files = lambda: {f for f in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(",") if "/shuffle_" in f}
    before = files()
    kept = cut_lineage(spark.range(10000).groupBy((F.col("id") % 97).alias("k")).count())
    assert not [f for f in files() - before if f.endswith(".data")]
    assert kept.count() == 97
    assert spark.conf.get(session.FREES_SHUFFLES) == "false"


def test_tasks_do_not_each_spell_out_every_frequent_run(spark, monkeypatch):
    lines = [f"the {w} of the {w} goes on. " * 3 for w in ("mill", "road", "river", "town")]
    docs = spark.createDataFrame([(i, "".join(lines), "en") for i in range(400)], "doc_id long, text string, lang string").repartition(8)
    passes = []
    expand = toivonen.expand

    def spied(of, *a):
        rows = cut_lineage(expand(of, *a))
        passes.append(rows.filter("m > 0").count())
        return rows

    monkeypatch.setattr(toivonen, "expand", spied)
    got = {(r["phrase"], r["n"]) for r in toivonen.frequent(docs).filter("m = 4").collect()}
    assert ("the mill of the", 1200) in got and ("of the mill goes", 1200) in got
    assert passes[-1] == 0


def test_a_worker_gives_back_the_memory_of_its_group(spark):
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096

    kept = []

    def group(table):
        held = [bytes(60000) for _ in range(4000)]  # below the size that is mapped apart
        kept.append(bytes(60000))  # lies behind them, so the heap can't just shrink
        kept.append(resident())
        del held
        return table

    gives_back(group)(None)
    assert resident() < kept[1] - 150e6
    list(gives_back(lambda batches: (yield from batches))(iter([])))
    keyed = lambda key, a, b: pa.table({"n": [a.num_rows + b.num_rows]})
    both = spark.range(3).groupBy("id").cogroup(spark.range(2).groupBy("id")).applyInArrow(gives_back(keyed), "n long")
    assert sorted(r["n"] for r in both.collect()) == [1, 2, 2]
