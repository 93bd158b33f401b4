"""Repeated spans of words by a compacted de Bruijn graph.

Edges are windows of ``WIDTH`` words. Neighbouring windows that share an anchor (their leftmost
least gram of ``GRAM`` words) always come together, so a task emits them as one path piece with the
hash of all its words and its place. Pieces seen twice or more are
repeated. Where a repeated piece has one successor and that one no other predecessor, the two are
linked, and pointer jumping in Spark joins compacts the links to paths without branches. Places of
a path in the documents give its spans, which must have the path's length at every place.

Pieces of one anchor that differ (the ends of repeats) are resolved edge by edge: one holder of
each differing piece emits its windows, and a window that two pieces share is repeated.

Counts combine before the shuffle; a piece in a third of all documents is one key that only a join
meets, which AQE splits. A document's own spans are the only lists.

Defined results: null, empty and blank texts have no words; a row is known by id and text, so
repeated rows repeat each other; null ids are kept; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoweave.llm.common import Segments, pieces, text_bytes, word_bounds, word_hashes
from genoweave.session import cut_lineage

WIDTH = 35
GRAM = 12


def batch_segments(column: pa.Array) -> Iterator[tuple[int, np.ndarray, Segments]]:
    """(first text, first word of each text, segments over words) per piece of a batch."""
    raw, offsets = text_bytes(column)
    for lo, hi in pieces(offsets):
        part, cuts = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        starts, ends, first = word_bounds(part, cuts)
        yield lo, first, Segments(word_hashes(part, starts, ends), first, WIDTH, GRAM)


def path_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (piece, anchor, row, start, count)."""
    for b in batches:
        for lo, first, s in batch_segments(b.column(1)):
            n = len(s.start)
            if n == 0:
                continue
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.whole.view(np.int64)), pa.array(s.gram.view(np.int64)), b.column(0).take(pa.array(s.text + lo)), pa.array((s.start - first[s.text]).astype(np.int32)), pa.array(s.count.astype(np.int32))],
                names=["piece", "anchor", "row", "start", "count"],
            )


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text, starts) to (edge, row, start) of every window of the pieces that start there."""
    for b in batches:
        wanted = b.column(2)
        for lo, first, s in batch_segments(b.column(1)):
            lists = wanted.slice(lo, len(first) - 1)
            size = np.diff(lists.offsets.to_numpy())
            place = lists.flatten().to_numpy() + np.repeat(first[:-1], size)
            which = np.searchsorted(s.start, np.sort(place))
            if len(which) == 0:
                continue
            at, source = s.windows(which)
            text = s.text[source]
            yield pa.RecordBatch.from_arrays(
                [pa.array(s.window_hashes(at).view(np.int64)), b.column(0).take(pa.array(text + lo)), pa.array((at - first[text]).astype(np.int32)), pa.array(s.whole[source].view(np.int64))],
                names=["edge", "row", "start", "piece"],
            )


def keep_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, spans) to (doc_id, n_words, removed spans, kept text): spans are [start, end) pairs of words."""
    for b in batches:
        out = []
        for text, spans in zip(b.column(1), b.column(2), strict=True):
            words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
            pairs = np.array(spans.as_py() or [], dtype=np.int64).reshape(-1, 2)
            if len(pairs) == 0:
                out.append((len(words), 0, b" ".join(words)))
                continue
            steps = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(steps, pairs[:, 0], 1)
            np.add.at(steps, pairs[:, 1], -1)
            gone = np.cumsum(steps[:-1]) > 0
            out.append((len(words), int(gone.sum()), b" ".join([words[i] for i in np.flatnonzero(~gone)])))
        n, removed, kept = zip(*out, strict=True) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def compact(repeated: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(piece, count, only_before, only_after) to (piece, path, offset, place): paths are named by their first piece.

    ``offset`` is in words from the path's start. Pieces of a circle without a way in stay alone.
    """
    # p goes before a piece if each is the other's only neighbour
    ahead = repeated.filter("only_after <> piece").select(F.col("piece").alias("only_before"), F.col("only_after").alias("piece"), F.col("count").alias("step"))
    link = repeated.join(ahead, ["piece", "only_before"], "left").select("piece", F.when(F.col("step").isNotNull(), F.col("only_before")).alias("to"), "step")
    state = cut_lineage(link.select("piece", F.coalesce("to", "piece").alias("path"), F.when(F.col("to").isNull(), 0).otherwise(F.col("step")).cast("long").alias("offset"), F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("place"), F.col("to").isNull().alias("done")))
    total = state.count()
    for k in range(max_rounds):
        if 2**k > 2 * total or state.filter("not done").limit(1).count() == 0:
            alone = lambda c, x: F.when(F.col("done"), F.col(c)).otherwise(x).alias(c)
            return state.select("piece", alone("path", F.col("piece")), alone("offset", F.lit(0)), alone("place", F.lit(0)))
        up = state.select(F.col("piece").alias("path"), F.col("path").alias("path2"), F.col("offset").alias("offset2"), F.col("place").alias("place2"), F.col("done").alias("done2"))
        state = cut_lineage(state.join(up, "path").select("piece", F.col("path2").alias("path"), (F.col("offset") + F.col("offset2")).alias("offset"), (F.col("place") + F.col("place2")).alias("place"), (F.col("done") | F.col("done2")).alias("done")))
    raise RuntimeError("paths did not settle")


def spans(rows: DataFrame) -> DataFrame:
    """(row, text) to repeated spans (row, start, end, path); path is null for single edges at a repeat's ends."""
    found = cut_lineage(rows.mapInArrow(path_pieces, "piece long, anchor long, row long, start int, count int"))
    distinct = found.groupBy("piece").agg(F.count("*").alias("times"), F.first("anchor").alias("anchor"), F.first("count").alias("count"), F.min(F.struct("row", "start")).alias("holder"))
    distinct = cut_lineage(distinct)
    repeated = distinct.filter("times > 1").select("piece")
    places = cut_lineage(found.select("piece", "row", "start", "count").join(repeated, "piece").distinct())
    # neighbours of a repeated piece: 0 at a text's end or beside a piece that is not repeated
    w = Window.partitionBy("row").orderBy("start")
    before = F.when(F.lag("start").over(w) + F.lag("count").over(w) == F.col("start"), F.lag("piece").over(w))
    after = F.when(F.col("start") + F.col("count") == F.lead("start").over(w), F.lead("piece").over(w))
    beside = places.select("piece", "count", F.coalesce(before, F.lit(0)).alias("b"), F.coalesce(after, F.lit(0)).alias("a"))
    only = lambda c: F.when((F.min(c) == F.max(c)) & (F.min(c) != 0), F.min(c))
    paths = compact(cut_lineage(beside.groupBy("piece").agg(F.first("count").alias("count"), only("b").alias("only_before"), only("a").alias("only_after"))))
    # whole paths: a place of a path is where its pieces' starts, less their offsets, agree
    placed = places.join(paths, "piece").groupBy("row", "path", (F.col("start") - F.col("offset")).alias("begin"))
    placed = placed.agg(F.min("start").cast("long").alias("start"), F.max(F.col("start") + F.col("count") + (WIDTH - 1)).cast("long").alias("end"))
    whole = placed.select("row", "start", "end", "path")
    # anchors of several pieces: edge by edge
    several = distinct.groupBy("anchor").agg(F.count("*").alias("pieces")).filter("pieces > 1").select("anchor")
    mixed = cut_lineage(distinct.join(several, "anchor").select("piece", (F.col("times") > 1).alias("known"), F.col("holder.row").alias("row"), F.col("holder.start").alias("start")))
    holders = mixed.groupBy("row").agg(F.collect_list("start").alias("starts"))
    seen = rows.join(holders, "row").select("row", "text", "starts").mapInArrow(window_rows, "edge long, row long, start int, piece long")
    # rows with equal id and text emit the same windows; one of them counts
    edges = cut_lineage(seen.join(mixed.select("piece", "known"), "piece").select("edge", "row", "start", "known").distinct())
    twice = edges.groupBy("edge").agg(F.count("*").alias("n")).filter("n > 1").select("edge")
    single = edges.filter("not known").join(twice, "edge").select("row", F.col("start").cast("long").alias("start"), (F.col("start") + WIDTH).cast("long").alias("end"), F.lit(None).cast("long").alias("path"))
    return whole.unionByName(single)


def remove(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    per_row = spans(rows.select("row", "text")).groupBy("row").agg(F.flatten(F.collect_set(F.array("start", "end"))).alias("spans"))
    return rows.join(cut_lineage(per_row), "row", "left").select("doc_id", "text", "spans").mapInArrow(keep_words, f"doc_id {kind}, n_words long, n_removed long, kept binary")


def digest(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
