"""N-gram Jaccard self-join by parity sketches.

A document's set is its distinct five-word shingles. XOR over the hashes of a part of the hash
space is a parity sketch of that part; two sets differ in no fewer elements than in parts of
unequal sketch, or in bits of unequal parity. At a Jaccard similarity of 3/4 sets of sizes a and b
differ in at most (a + b) / 7 elements, so, per band of sizes, the hash space is cut into more
parts than that and two similar sets agree in at least one part that is not empty (pigeonhole).
Parts are hash-joined, candidates pass a Hamming bound on bit sketches, and the shingles decide.

Whole sets that are equal are one class from the start, so copies cost nothing further. A part
shared by more than ``SMALL`` classes is hot: it gives a star, and a class whose hot parts are
fewer than the agreements it is sure of is complete through its other parts. Only classes with
more hot parts (large groups of near copies, short texts around a common passage) meet again at
their rarest shingles, of which similar sets share one: first a few neighbours of every shingle are
compared and their components joined, then members still apart, in cells of bounded size that give
out only pairs whose sizes, places and bit sketches allow the similarity.

Parts travel as packed arrays per receiving group. Nothing is dropped or capped.

Defined results: null, empty or blank texts have no shingle and no link; a text of fewer than five
words is one shingle; rows that share an id are one document; a row with a null id has a null
component and links nothing; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from genoweave.llm.common import LOWER, U64, Rolling, gives_back, mix, pieces, shard_count, text_bytes, word_bounds, word_hashes
from genoweave.llm.components import components
from genoweave.session import cut_lineage

SHINGLE = 5
SMALL = 12
REACH = 2
BLOCK = 2_000
WIDTH = 256
LARGEST = 1 << 34


def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower ends of the size bands, and per band the most differing elements and the number of parts.

    A set of a band and a similar larger one are in the same or in neighbouring bands.
    """
    lows = [1]
    while lows[-1] < LARGEST:
        lows.append(max(lows[-1] + 1, -(-lows[-1] * 4 // 3)))
    low = np.array(lows, dtype=np.int64)
    top = low[1:] - 1
    apart = (top + top * 4 // 3) // 7
    return low, apart, np.maximum(apart + 1, (top * 11 + 19) // 20)


LOW, APART, PARTS = bands()


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, in order of (text, hash), and the text of each."""
    raw = LOWER[raw]
    starts, ends, first = word_bounds(raw, offsets)
    words = word_hashes(raw, starts, ends)
    count = np.diff(first)
    rolling = Rolling(words)
    long = np.flatnonzero(count >= SHINGLE)
    per = count[long] - SHINGLE + 1
    text = np.repeat(long, per)
    at = first[text] + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    text = np.concatenate([text, short])
    hashes = np.concatenate([rolling.slices(at, at + SHINGLE), rolling.slices(first[short], first[short + 1])]) if len(text) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    fresh = np.ones(len(text), dtype=bool)
    fresh[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[fresh], text[fresh]


def classes(hashes: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and class hash of every text's set (0 for an empty one)."""
    size = np.bincount(text, minlength=n)
    out = np.zeros(n, dtype=np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        at = (np.cumsum(size) - size)[some]
        with np.errstate(over="ignore"):
            out[some] = mix(np.bitwise_xor.reduceat(hashes, at) ^ mix(np.add.reduceat(mix(hashes), at) + size[some].astype(np.uint64)))
    return size, out


def parts(hashes: np.ndarray, text: np.ndarray, size: np.ndarray, previous: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, text) of the parts to be joined, and per text the agreements it is sure of.

    As the smaller set of a pair a text uses its own band's parts, as the larger one also those of
    the band before.
    """
    band = np.searchsorted(LOW, np.maximum(size, 1), side="right") - 1 - previous
    ok = (size > 0) & (band >= 0)
    band = np.maximum(band, 0)
    use = ok[text]
    h, t = hashes[use], text[use]
    if len(h) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(len(size), np.int64)
    part = ((h >> U64(32)) * PARTS[band[t]].astype(np.uint64)) >> U64(32)
    start = np.ones(len(h), dtype=bool)
    start[1:] = (t[1:] != t[:-1]) | (part[1:] != part[:-1])
    at = np.flatnonzero(start)
    sketch = np.bitwise_xor.reduceat(h, at)
    t, part = t[at], part[at]
    filled = np.bincount(t, minlength=len(size))
    sure = filled - APART[band]
    salt = lambda band, part: mix((band.astype(np.uint64) << U64(40)) ^ part.astype(np.uint64))
    key = mix(sketch ^ salt(band[t], part))
    sparse = np.flatnonzero(ok & (sure < 1))
    more_key, more_text = [], []
    for x in sparse:  # too few filled parts to be sure of one: empty parts count as agreeing too
        empty = np.setdiff1d(np.arange(PARTS[band[x]]), part[t == x].astype(np.int64))
        more_key.append(mix(salt(np.full(len(empty), band[x]), empty)))
        more_text.append(np.full(len(empty), x))
    return np.concatenate([key, *more_key]), np.concatenate([t, *more_text]).astype(np.int64), np.maximum(sure, 0)


def bit_sketch(hashes: np.ndarray, text: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity of the counts of hashes per bit; at least two bits an element, a power of two."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1) * 2)).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(bits)])
    place = starts[text] + (mix(hashes) & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(place, minlength=starts[-1]) & 1).astype(np.uint8)
    packed = np.packbits(odd)
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]


def fold(sketch: np.ndarray, to: int) -> np.ndarray:
    """The sketch of half, a quarter, ... of the bits is the XOR of its pieces."""
    while len(sketch) > to:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


BITS_SET = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to (doc_id, n, class, sure0, sure1, sketch)."""
    for b in batches:
        raw, offsets = text_bytes(b.column(1))
        for lo, hi in pieces(offsets):
            h, t = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            size, cls = classes(h, t, hi - lo)
            sure = [parts(h, t, size, p)[2] for p in (False, True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(cls.view(np.int64)), pa.array(sure[0]), pa.array(sure[1]), pa.array(bit_sketch(h, t, size), pa.binary())],
                names=["doc_id", "n", "class", "sure0", "sure1", "sketch"],
            )


def deal(groups: int):
    """Arrow function over (text): packed parts per receiving group, each class of a batch once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(0))
            found: list[list] = [[], []]
            for lo, hi in pieces(offsets):
                h, t = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                size, cls = classes(h, t, hi - lo)
                _, first = np.unique(cls, return_index=True)
                once = np.zeros(hi - lo, dtype=bool)
                once[first] = True
                keep = once[t]
                for p in (0, 1):
                    key, text, _ = parts(h[keep], t[keep], np.where(once, size, 0), bool(p))
                    found[p].append((key >> U64(16), cls[text]))
            out = []
            for p in (0, 1):
                if not found[p]:
                    continue
                key, cls = (np.concatenate(x) for x in zip(*found[p], strict=True))
                group = (key * U64(groups)) >> U64(48)
                order = np.lexsort((cls, group))
                key, cls, group = key[order], cls[order], group[order]
                cut = np.searchsorted(group, np.arange(groups + 1).astype(np.uint64))
                for g in np.flatnonzero(np.diff(cut)):
                    k, c = key[cut[g] : cut[g + 1]], cls[cut[g] : cut[g + 1]]
                    at = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                    out.append((int(g), p, c[at].tobytes(), np.diff(np.append(at, len(c))).astype(np.uint32).tobytes(), k.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["g", "role", "class", "count", "keys"])

    return run


def meet(table: pa.Table) -> pa.Table:
    """Candidates of one group: pairs of classes (role null), and (key, class, role) of hot parts."""
    keys, cls, role = [], [], []
    for r, c, n, k in zip(table["role"].to_pylist(), table["class"], table["count"], table["keys"], strict=True):
        n = np.frombuffer(n.as_py(), np.uint32)
        packed = np.frombuffer(k.as_py(), np.uint8).reshape(-1, 6)
        wide = np.zeros((len(packed), 8), np.uint8)
        wide[:, :6] = packed
        keys.append(wide.view(np.uint64).ravel())
        cls.append(np.repeat(np.frombuffer(c.as_py(), np.uint64), n))
        role.append(np.full(len(packed), r, np.int8))
    key, cls, role = np.concatenate(keys), np.concatenate(cls), np.concatenate(role)
    order = np.lexsort((cls, key))
    key, cls, role = key[order], cls[order], role[order]
    fresh = np.ones(len(key), dtype=bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, role = key[fresh], cls[fresh], role[fresh]
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(edge, len(key)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    start, size = np.repeat(edge, count), np.repeat(count, count)
    inside = np.arange(len(key)) - start
    for step in range(1, SMALL):  # small parts: every pair; members are in order of class
        i = np.flatnonzero((size <= SMALL) & (inside + step < size))
        a.append(cls[i])
        b.append(cls[i + step])
    hot = size > SMALL
    i = np.flatnonzero(hot & (inside > 0))
    a.append(cls[start[i]])
    b.append(cls[i])
    pair = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    h = np.flatnonzero(hot)
    return pa.table({
        "a": pa.array(np.concatenate([pair[:, 0], key[h]]).view(np.int64)),
        "b": pa.array(np.concatenate([pair[:, 1], cls[h]]).view(np.int64)),
        "role": pa.array(np.concatenate([np.full(len(pair), -1), role[h]]).astype(np.int32)),
    })


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (a, b, na, nb, sa, sb) whose sizes and bit sketches allow the similarity."""
    for b in batches:
        na, nb = (b.column(i).to_numpy() for i in (2, 3))
        keep = 4 * np.minimum(na, nb) >= 3 * np.maximum(na, nb)
        for i in np.flatnonzero(keep):
            x, y = (np.frombuffer(b.column(c)[int(i)].as_py(), np.uint8) for c in (4, 5))
            to = min(len(x), len(y))
            keep[i] = 7 * int(BITS_SET[fold(x, to) ^ fold(y, to)].sum()) <= na[i] + nb[i]
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, text) to (class, sorted shingle hashes); texts of another class under the same id are left out."""
    for b in batches:
        raw, offsets = text_bytes(b.column(1))
        for lo, hi in pieces(offsets):
            h, t = shingles(raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            meant = classes(h, t, hi - lo)[1].view(np.int64) == b.column(0).slice(lo, hi - lo).to_numpy()
            cut = np.searchsorted(t, np.arange(hi - lo + 1))
            hashes = [h[x:y].tobytes() for x, y, ok in zip(cut[:-1], cut[1:], meant, strict=True) if ok]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo).filter(pa.array(meant)), pa.array(hashes, pa.binary())], names=["class", "hashes"])


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keep (a, b) whose shingle sets have 100 * intersection >= 75 * union."""
    for b in batches:
        keep = np.zeros(b.num_rows, dtype=bool)
        for i in range(b.num_rows):
            x, y = (np.frombuffer(b.column(c)[i].as_py(), np.uint64) for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep[i] = 100 * both >= 75 * (len(x) + len(y) - both)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], names=["a", "b"])


class Members:
    """Members of one shingle in one task: class, component, n, rest and sketch.

    Two members may be similar if their components differ, sizes and bit sketches allow it, and so
    do their places: what two sets share from their first common shingle on is no more than the
    shorter rest, so a pair whose rests are too short has met at an earlier shingle or is not
    similar.
    """

    def __init__(self, table: pa.Table):
        self.node, self.comp, self.n, rank = (table[c].to_numpy() for c in ("class", "component", "n", "rank"))
        self.rest = self.n - rank + 1
        sketches = table["sketch"].to_pylist()
        self.length = np.array([len(x) for x in sketches], dtype=np.int64)
        self.full = np.zeros((len(sketches), int(self.length.max(initial=0))), np.uint8)
        for row, x in zip(self.full, sketches, strict=True):
            row[: len(x)] = np.frombuffer(x, np.uint8)
        self.half = np.zeros_like(self.full)
        for size in np.unique(self.length):  # sizes allowed to meet are of one length or the next
            at = np.flatnonzero(self.length == size)
            self.half[at, : size // 2] = self.full[at, : size // 2] ^ self.full[at, size // 2 : size]

    def allowed(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the pairs of rows (i, j) that may be similar."""
        n, rest = self.n, self.rest
        keep = (self.comp[i] != self.comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (7 * np.minimum(rest[i], rest[j]) >= 3 * (n[i] + n[j]))
        i, j = i[keep], j[keep]
        x = np.where((self.length[i] > self.length[j])[:, None], self.half[i], self.full[i])
        y = np.where((self.length[j] > self.length[i])[:, None], self.half[j], self.full[j])
        keep = 7 * BITS_SET[x ^ y].sum(axis=1, dtype=np.int64) <= n[i] + n[j]
        return i[keep], j[keep]

    def table(self, found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip((np.zeros(0, np.int64),) * 2, *found, strict=True))
        a, b = self.node[a], self.node[b]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def beside(table: pa.Table) -> pa.Table:
    """Allowed pairs of members that stand within ``REACH`` places, in an order of each shingle's own."""
    m = Members(table)
    band = np.searchsorted(LOW, np.maximum(m.n, 1), side="right")
    order = np.lexsort((mix(m.node.view(np.uint64) ^ mix(table["shingle"].to_numpy().view(np.uint64))), band))
    return m.table([m.allowed(order[:-step], order[step:]) for step in range(1, min(REACH, len(order) - 1) + 1)])


def cell(table: pa.Table) -> pa.Table:
    """Allowed pairs of a searching member (outside the shingle's main component) and any other."""
    m = Members(table)
    searching, outside = (table[c].to_numpy(zero_copy_only=False) for c in ("searching", "outside"))
    ask = np.flatnonzero(searching)
    other = np.flatnonzero(~searching)
    other = other[np.argsort(m.n[other], kind="stable")]
    lo = np.searchsorted(m.n[other], -(-3 * m.n[ask] // 4), side="left")
    hi = np.searchsorted(m.n[other], m.n[ask] * 4 // 3, side="right")
    found = []
    for x, f, t in zip(ask, lo, hi, strict=True):
        j = other[f:t]
        j = j[~outside[j] | (m.node[j] > m.node[x])]  # two members outside meet once
        found.append(m.allowed(np.full(len(j), x), j))
    return m.table(found)


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text")
    described = cut_lineage(rows.mapInArrow(gives_back(describe), f"doc_id {kind}, n long, class long, sure0 long, sure1 long, sketch binary"))
    known = described.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sure0").alias("sure0"), F.first("sure1").alias("sure1"), F.first("sketch").alias("sketch"))
    known = cut_lineage(known)
    groups = shard_count(rows, "text", 20_000_000)
    dealt = rows.filter("doc_id is not null").select("text").mapInArrow(gives_back(deal(groups)), "g int, role int, class binary, count binary, keys binary")
    met = cut_lineage(dealt.groupBy("g").applyInArrow(gives_back(meet), "a long, b long, role int"))
    # classes that may depend on hot parts alone
    hot = met.filter("role >= 0").groupBy(F.col("b").alias("class"), "role").agg(F.count("*").alias("hot")).join(known.select("class", "sure0", "sure1"), "class")
    needy = cut_lineage(hot.filter(F.col("hot") >= F.when(F.col("role") == 0, F.col("sure0")).otherwise(F.col("sure1"))).select("class").distinct())
    likely = allowed(known, met.filter("role < 0").select("a", "b").distinct())
    # shingles of every class that is compared; a repeated id may have other texts, so the class decides which is meant
    wanted = likely.select(F.col("a").alias("class")).union(likely.select("b")).union(needy).distinct().join(known.select("class", "rep"), "class")
    texts = rows.join(wanted.select(F.col("rep").alias("doc_id"), "class"), "doc_id").select("class", "text")
    hashed = cut_lineage(texts.mapInArrow(gives_back(sets), "class long, hashes binary").dropDuplicates(["class"]))
    links = verified(known, hashed, likely)
    if needy.limit(1).count():
        links = completed(known, hashed, needy, links)
    found = components(links)
    names = known.select("class", F.col("rep").alias("node")).join(found, "node", "left").select("class", F.coalesce("component", "node").alias("component"))
    # rows that share an id are one document, so a class is known by any of its ids through its rep
    out = described.select("doc_id", "n", "class").join(names, "class", "left")
    linked = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), linked.alias("component_id"))


def completed(known: DataFrame, hashed: DataFrame, needy: DataFrame, links: DataFrame) -> DataFrame:
    """``links`` with those between ``needy`` classes that connect what is not yet in one component.

    First a few neighbours of every shingle are compared, which connects most of a large group of
    near copies by rows in proportion to its members. What is still apart after that is searched
    in full: members outside a shingle's main component against all, in cells of bounded size.
    """
    rare = rarest(known, hashed, needy)
    near_by = together(rare, links).withColumn("part", F.pmod(F.xxhash64("class", "shingle"), F.ceil(F.col("members") / BLOCK)))
    links = links.unionByName(verified(known, hashed, allowed(known, near_by.groupBy("shingle", "part").applyInArrow(beside, "a long, b long").distinct())))
    return links.unionByName(verified(known, hashed, allowed(known, cells(together(rare, links)).distinct())))


def rarest(known: DataFrame, hashed: DataFrame, needy: DataFrame) -> DataFrame:
    """(shingle, class, n, rank, rep, sketch): the rarest shingles of ``needy`` classes.

    Similar sets of n elements share one of their n - ceil(3n/4) + 1 rarest, by any one order. With
    the rarest first, what many texts hold is only met by sets that hold little else.
    """
    listed = cut_lineage(hashed.join(needy, "class").mapInArrow(gives_back(one_by_one), "class long, n long, shingle long"))
    often = listed.groupBy("shingle").agg(F.count("*").alias("often")).filter("often > 1")
    # a shingle of one set cannot be shared, so it only takes its place among the rarest
    ranked = listed.join(often, "shingle", "left").withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.coalesce("often", F.lit(1)), "shingle")))
    first = ranked.filter(F.col("often").isNotNull() & (F.col("rank") <= F.col("n") - F.ceil(3 * F.col("n") / 4) + 1)).select("shingle", "class", "n", F.col("rank").cast("long").alias("rank"))
    folded = known.join(needy, "class").select("class", "rep", "sketch").mapInArrow(gives_back(shorter), f"class long, rep {known.schema['rep'].dataType.simpleString()}, sketch binary")
    return cut_lineage(first.join(folded, "class"))


def together(rare: DataFrame, links: DataFrame) -> DataFrame:
    """Members of the shingles that more than one component holds.

    Adds component, outside (not of the component with most members), and per shingle the numbers
    of members and of members outside.
    """
    labels = components(links).withColumnRenamed("node", "rep")
    named = cut_lineage(rare.join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")).drop("rep"))
    per = named.groupBy("shingle", "component").agg(F.count("*").alias("k")).groupBy("shingle").agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("members"))
    per = per.filter("members > main.k").select("shingle", F.col("main.component").alias("main"), "members", (F.col("members") - F.col("main.k")).alias("strangers"))
    return named.join(per, "shingle").withColumn("outside", F.col("component") != F.col("main")).drop("main")


def cells(members: DataFrame) -> DataFrame:
    """Allowed pairs (a, b) across components of every shingle, in cells of about ``BLOCK`` by ``BLOCK`` members."""
    searched, searching = F.ceil(F.col("members") / BLOCK), F.ceil(F.col("strangers") / BLOCK)
    place = F.xxhash64("class", "shingle")
    copies = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), k - 1))
    ask = members.filter("outside").withColumn("i", F.pmod(place, searching)).withColumn("j", copies(searched)).withColumn("searching", F.lit(True))
    other = members.withColumn("j", F.pmod(place, searched)).withColumn("i", copies(searching)).withColumn("searching", F.lit(False))
    columns = ["shingle", "i", "j", "class", "component", "n", "rank", "sketch", "outside", "searching"]
    return ask.select(columns).union(other.select(columns)).groupBy("shingle", "i", "j").applyInArrow(cell, "a long, b long")


def shorter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, rep, sketch) with the sketch folded to ``WIDTH`` bytes at most."""
    for b in batches:
        folded = [fold(np.frombuffer(x, np.uint8), WIDTH).tobytes() for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(folded, pa.binary())], names=["class", "rep", "sketch"])


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, hashes) to a row per shingle."""
    for b in batches:
        size = np.array([len(h.as_py()) // 8 for h in b.column(1)], dtype=np.int64)
        shingle = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(np.repeat(size, size)), pa.array(shingle)], names=["class", "n", "shingle"])


def allowed(known: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of classes whose sizes and bit sketches allow the similarity."""
    left = known.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = known.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return cut_lineage(pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(gives_back(near), "a long, b long"))


def verified(known: DataFrame, hashed: DataFrame, likely: DataFrame) -> DataFrame:
    """Links (a, b) between representatives among pairs of classes, by their shingles."""
    x = likely.join(hashed.select(F.col("class").alias("a"), F.col("hashes").alias("ha")), "a").join(hashed.select(F.col("class").alias("b"), F.col("hashes").alias("hb")), "b")
    good = x.select("a", "b", "ha", "hb").mapInArrow(gives_back(verify), "a long, b long")
    names = known.select("class", "rep")
    good = good.join(names.select(F.col("class").alias("a"), F.col("rep").alias("ra")), "a").join(names.select(F.col("class").alias("b"), F.col("rep").alias("rb")), "b")
    return cut_lineage(good.select(F.col("ra").alias("a"), F.col("rb").alias("b")))
