"""Removal of byte strings that also start in an earlier document, by suffix arrays per shard.

Documents are dealt to shards of a few megabytes by a hash of their id. A shard cuts its windows of
``WIDTH`` bytes into segments that share an anchor (``common.Segments``), sends each distinct
segment's hashes once, and hears of equal segments in other shards, and of anchors that occur in
different segments. An equal segment of a smaller document settles all its windows; only first
holders of a segment whose anchor occurs in others remain. Their texts are sorted in the shard:
Larsson-Sadakane refinement to a suffix array, Kasai's scan for the common prefixes, windows with a
common prefix of the full width in one class. Sorted classes are cut at the borders of ranges by
binary search, merged across shards by binary search, and each shard hears of the classes that
start in a smaller document elsewhere.

A string in a third of all documents is sent once per shard, not once per document. Nothing is
sampled, capped or kept on the driver.

Defined results: a null or empty text has 0 bytes and nothing removed; rows that share an id never
remove each other's bytes; a row with a null id neither removes nor loses anything; columns beside
(doc_id, text) are carried only if named.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.common import BYTE_VALUE, U64, Rolling, Segments, gives_back, mix, pieces, shard_count, spread, text_bytes

WIDTH = 50
GRAM = 22
REMAIN = "shard int, g int, kind int, h binary, w binary, d binary, f binary"


# ---- suffix array of one shard's texts ----------------------------------------------------------


def suffix_array(text: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Order of all suffixes, compared to their ends; equal ones go by place.

    ``ends[i]`` is where the text of place i ends; a suffix that ends sorts before one that goes on.
    Groups of equal suffixes are refined by the rank of what follows, over twice the length each
    round; groups of one, and groups whose suffixes have all ended, are left alone.
    """
    n = len(text)
    key = np.zeros(n, dtype=np.uint64)
    h = 7
    left = ends - np.arange(n)
    for k in range(h):
        at = np.minimum(np.arange(n) + k, n - 1)
        key = (key << U64(9)) | np.where(left > k, text[at].astype(np.uint64) + U64(1), U64(0))
    sa = np.argsort(key, kind="stable")
    s = key[sa]
    fresh = np.concatenate([[True], s[1:] != s[:-1]]) if n else np.zeros(0, bool)
    run = np.cumsum(fresh) - 1
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = np.flatnonzero(fresh)[run]
    slots = np.flatnonzero((np.bincount(run)[run] > 1) & (left[sa] >= h)) if n else sa
    while len(slots):
        here = sa[slots]
        follow = here + h
        second = np.where(follow < ends[here], rank[np.minimum(follow, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[here]))
        here, second, first = here[order], second[order], rank[here][order]
        sa[slots] = here
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        run = np.cumsum(new) - 1
        rank[here] = slots[new][run]
        h *= 2
        slots = slots[(np.bincount(run)[run] > 1) & (left[here] >= h)]
    return sa


def common_prefixes(text: np.ndarray, ends: np.ndarray, sa: np.ndarray, most: int, lane: int = 512) -> np.ndarray:
    """Length, up to ``most``, that each suffix shares with the one before it in order.

    Kasai's scan in text order, where a suffix shares at least one byte less than the suffix one
    place earlier did, which holds as ``sa`` is sorted to the ends; many stretches of the text are scanned in step.
    """
    n = len(text)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, dtype=np.int64)
    at = np.arange(0, n, lane)
    h = np.zeros(len(at), dtype=np.int64)
    for step in range(lane):
        i = at + step
        ok = i < n
        if not ok.all():
            at, h, i = at[ok], h[ok], i[ok]
        j = before[i]
        h[j < 0] = 0
        going = np.flatnonzero(j >= 0)
        while len(going):
            a, b = i[going] + h[going], j[going] + h[going]
            same = (h[going] < most) & (a < ends[i[going]]) & (b < ends[j[going]])
            same[same] = text[a[same]] == text[b[same]]
            going = going[same]
            h[going] += 1
        out[i] = h
        h = np.maximum(h - 1, 0)
    return out[sa]


# ---- what shards and groups say to each other ---------------------------------------------------


def segment_key(gram: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """One name of 7 bytes of a segment, enough to tell those of one shard apart."""
    return mix(gram ^ mix(whole)) & U64(2**56 - 1)


class Shard:
    """Texts of a shard and their segments."""

    def __init__(self, table: pa.Table):
        self.table = table
        self.raw, self.offsets = text_bytes(table["text"])
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        self.known = ~ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).cast(pa.int64()).to_numpy()
        parts = []
        for lo, hi in pieces(self.offsets):
            base = self.offsets[lo]
            s = Segments(BYTE_VALUE[self.raw[base : self.offsets[hi]]], self.offsets[lo : hi + 1] - base, WIDTH, GRAM)
            # an anchor's hash is a least one, so it is mixed again before ranges of it are dealt out
            ok = self.known[s.text + lo] if len(s.text) else np.zeros(0, bool)
            parts.append((s.start[ok] + base, s.count[ok], mix(s.gram[ok]) >> U64(16), s.whole[ok] >> U64(24), s.text[ok] + lo))
        self.start, self.count, self.gram, self.whole, self.text = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, t) for t in (np.int64, np.int64, np.uint64, np.uint64, np.int64))
        self.doc = self.ids[self.text]
        self.key = segment_key(self.gram, self.whole)
        # distinct segments with their smallest document, and how many distinct ones an anchor has here
        order = np.lexsort((self.doc, self.key))
        k = self.key[order]
        fresh = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        self.distinct = order[fresh]
        self.of = np.empty(len(k), dtype=np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        _, inverse, number = np.unique(self.gram[self.distinct], return_inverse=True, return_counts=True)
        self.mixed = number[inverse] > 1
        self.least = self.doc[self.distinct].copy()

    def heard(self, replies: pa.Table) -> None:
        """Take in what other shards hold: smaller documents of a segment, anchors of several segments."""
        for r in range(replies.num_rows if len(self.key) else 0):
            if replies["kind"][r].as_py() != 1:
                continue
            key, _, d, f = unpack(replies, r)
            mine = self.key[self.distinct]
            at = np.minimum(np.searchsorted(mine, key), len(mine) - 1)
            ok = mine[at] == key
            at = at[ok]
            self.least[at] = np.minimum(self.least[at], d[ok])
            self.mixed[at] |= f[ok].astype(bool)

    def settled(self) -> np.ndarray:
        """Segments that a smaller document holds as a whole."""
        return self.doc > self.least[self.of]

    def open(self) -> np.ndarray:
        """Segments whose windows are still to be compared, in text order."""
        return np.flatnonzero(~self.settled() & self.mixed[self.of])

    def regions(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the chosen segments, neighbours joined: (places in the shard, end of each place's region, is a window's start)."""
        start, count = self.start[which], self.count[which]
        if len(start) == 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        new = np.concatenate([[True], start[1:] != start[:-1] + count[:-1]])
        first = start[new]
        last = np.concatenate([(start + count)[:-1][new[1:]], (start + count)[-1:]])
        size = last - first + WIDTH - 1
        ends = np.cumsum(size)
        region = np.repeat(np.arange(len(first)), size)
        inside = np.arange(ends[-1]) - np.repeat(ends - size, size)
        return first[region] + inside, ends[region], inside < (last - first)[region]


def narrow(x: np.ndarray | None, n: int) -> bytes:
    """The low ``n`` bytes of each 64-bit value."""
    return b"" if x is None else np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    x = np.frombuffer(raw, np.uint8).reshape(-1, n)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :n] = x
    return out.view(np.uint64).ravel()


def small(x: np.ndarray) -> bytes:
    """Unsigned values in as few bytes each as the largest needs, which the first byte tells."""
    size = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([size]) + narrow(x, size)


def pack(h=None, w=None, d=None, f=None) -> tuple:
    """Sorted names as the first one and steps, whole-segment hashes in 5 bytes, ids as differences to the least one, flags as bits."""
    low = int(d.min())
    names = h[:1].tobytes() + small(np.diff(h))
    ids = np.int64(low).tobytes() + small((d - low).astype(np.uint64))
    return names, narrow(w, 5), ids, b"" if f is None else np.packbits(f).tobytes()


def unpack(table: pa.Table, row: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    h, w, d, f = (table[c][row].as_py() for c in "hwdf")
    ids = np.frombuffer(d[:8], np.int64)[0] + wide(d[9:], d[8]).astype(np.int64)
    names = np.cumsum(np.concatenate([np.frombuffer(h[:8], U64), wide(h[9:], h[8])]), dtype=U64)
    return names, wide(w, 5), ids, np.unpackbits(np.frombuffer(f, np.uint8))[: len(ids)]


def message(rows: list[tuple]) -> pa.Table:
    """Rows of (shard, g, kind, h, w, d, f)."""
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "g", "kind", "h", "w", "d", "f"), columns, kinds, strict=True)})


def tell_segments(groups: int):
    """Every distinct segment of a shard to the group of its anchor."""

    def run(key, table):
        s = Shard(table)
        order = s.distinct[np.argsort(s.gram[s.distinct], kind="stable")]
        gram = s.gram[order]
        cut = np.searchsorted(gram, (np.arange(groups + 1, dtype=object) * 2**48 // groups).astype(np.uint64))
        cut[-1] = len(gram)
        return message([(key[0].as_py(), int(g), 0, *pack(gram[a:b], s.whole[order[a:b]], s.doc[order[a:b]])) for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    return run


def compare_segments(key, table):
    """To each shard: segments that a smaller document holds elsewhere, and anchors of several segments."""
    parts = [unpack(table, r) for r in range(table.num_rows)]
    gram, whole, doc, _ = (np.concatenate(x) for x in zip(*parts, strict=True))
    shard = np.repeat(np.arange(table.num_rows), [len(p[0]) for p in parts])
    order = np.lexsort((doc, whole, gram))
    g, w, d = gram[order], whole[order], doc[order]
    new_gram = np.concatenate([[True], g[1:] != g[:-1]])
    new = new_gram | np.concatenate([[True], w[1:] != w[:-1]])
    least = d[np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))]
    number = np.bincount(np.cumsum(new_gram) - 1, weights=new)[np.cumsum(new_gram) - 1]
    tell = (d > least) | (number > 1)
    at = order[tell]
    back = np.argsort(shard[at], kind="stable")
    rows, of = np.flatnonzero(tell)[back], shard[at][back]
    cut = np.searchsorted(of, np.arange(table.num_rows + 1))
    names = table["shard"].to_pylist()
    key_of = segment_key(g, w)
    out = []
    for k in range(table.num_rows):
        r = rows[cut[k] : cut[k + 1]]
        if len(r):
            r = r[np.argsort(key_of[r])]
            out.append((names[k], 0, 1, *pack(key_of[r], None, least[r], number[r] > 1)))
    return message(out)


def tell_classes(groups: int):
    """Sorted window classes of the open segments, with their smallest document, cut at the ranges' borders."""

    def run(key, table, replies):
        if table.num_rows == 0:
            return message([])
        s = Shard(table)
        s.heard(replies)
        which = s.open()
        # one holder of a segment is enough
        _, first = np.unique(s.of[which], return_index=True)
        place, ends, window = s.regions(which[np.sort(first)])
        if len(place) == 0:
            return message([])
        text = s.raw[place]
        sa = suffix_array(text, ends)
        prefix = common_prefixes(text, ends, sa, WIDTH)
        is_window = window[sa]
        new = (prefix < WIDTH)[is_window]
        at = sa[is_window]
        new[0] = True
        doc = s.ids[np.searchsorted(s.offsets, place[at], side="right") - 1]
        heads = np.flatnonzero(new)
        least = np.minimum.reduceat(doc, heads)
        name = Rolling(BYTE_VALUE[text]).slices(at[heads], at[heads] + WIDTH)
        order = np.argsort(name)
        name, least = name[order], least[order]
        cut = np.searchsorted(name, (np.arange(groups + 1, dtype=object) * (2**64 - 1) // groups).astype(np.uint64))
        cut[-1] = len(name)
        return message([(key[0].as_py(), int(g), 2, *pack(name[a:b], None, least[a:b])) for g, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if b > a])

    return run


def merged(a: tuple, b: tuple) -> tuple:
    """Union of two sorted runs of (names, least documents): each name's place in the other by binary search."""
    at = np.searchsorted(a[0], b[0])
    hit = a[0][np.minimum(at, len(a[0]) - 1)] == b[0]
    least = a[1].copy()
    least[at[hit]] = np.minimum(least[at[hit]], b[1][hit])
    new = np.flatnonzero(~hit)
    return np.insert(a[0], at[new], b[0][new]), np.insert(least, at[new], b[1][new])


def merge_classes(key, table):
    """To each shard: its classes that start in a smaller document elsewhere."""
    runs = [(h, d) for h, _, d, _ in (unpack(table, r) for r in range(table.num_rows))]
    level = runs
    while len(level) > 1:
        level = [merged(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    names, least = level[0]
    out = []
    for r, (h, d) in enumerate(runs):
        best = least[np.searchsorted(names, h)]
        less = best < d
        if less.any():
            out.append((table["shard"][r].as_py(), 0, 2, *pack(h[less], None, best[less])))
    return message(out)


def removal(carried: list[str], whole_chars: bool):
    """What is left of every text of a shard; with ``whole_chars`` a character goes with its first or last byte."""

    def run(key, table, replies):
        s = Shard(table)
        s.heard(replies)
        gone = np.zeros(len(s.raw) + 1, dtype=np.int64)
        done = np.flatnonzero(s.settled())
        np.add.at(gone, s.start[done], 1)
        np.add.at(gone, s.start[done] + s.count[done] + WIDTH - 1, -1)
        place, _, window = s.regions(s.open())
        if len(place):
            at = np.flatnonzero(window)
            name = Rolling(BYTE_VALUE[s.raw[place]]).slices(at, at + WIDTH)
            doc = s.ids[np.searchsorted(s.offsets, place[at], side="right") - 1]
            known = [(h, d) for r in range(replies.num_rows) if replies["kind"][r].as_py() == 2 for h, _, d, _ in [unpack(replies, r)]]
            names = np.concatenate([name, *[h for h, _ in known]])
            docs = np.concatenate([doc, *[d for _, d in known]])
            order = np.lexsort((docs, names))
            n = names[order]
            least = np.empty(len(names), dtype=np.int64)
            least[order] = docs[order][np.maximum.accumulate(np.where(np.concatenate([[True], n[1:] != n[:-1]]), np.arange(len(n)), 0))]
            hit = place[at[doc > least[: len(name)]]]
            np.add.at(gone, hit, 1)
            np.add.at(gone, hit + WIDTH, -1)
        away = np.cumsum(gone[:-1]) > 0
        if whole_chars and away.any():
            char = np.cumsum((s.raw & 0xC0) != 0x80)
            away = np.bincount(char, weights=away, minlength=char[-1] + 1)[char] > 0
        edge = away.copy()
        edge[1:] &= ~away[:-1]
        inner = s.offsets[:-1][np.diff(s.offsets) > 0]
        edge[inner] = away[inner]
        starts = np.flatnonzero(edge)
        last = away.copy()
        last[:-1] &= ~away[1:]
        tail = s.offsets[1:][np.diff(s.offsets) > 0] - 1
        last[tail] = away[tail]
        stops = np.flatnonzero(last) + 1
        text_of = np.searchsorted(s.offsets, starts, side="right") - 1
        spans = np.stack([starts, stops], axis=1) - s.offsets[text_of][:, None]
        number = np.bincount(text_of, minlength=table.num_rows)
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(number * 2)]).astype(np.int32), pa.array(spans.ravel()))
        upto = np.concatenate([[0], np.cumsum(~away)])
        kept = pa.Array.from_buffers(pa.binary(), table.num_rows, [None, pa.py_buffer(upto[s.offsets].astype(np.int32).tobytes()), pa.py_buffer(s.raw[~away].tobytes())])
        return pa.table({"doc_id": table["doc_id"], "n_bytes": pa.array(np.diff(s.offsets)), "spans": lists, "kept": kept, **{c: table[c] for c in carried}})

    return run


def dedup(docs: DataFrame, carried: tuple[str, ...] = (), whole_chars: bool = False) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, carried columns): removed [start, end) pairs in one array, and the remaining bytes.

    ``whole_chars`` widens a removal to whole characters, so what is kept is text.
    """
    kinds = dict(docs.select("doc_id", *carried).dtypes)
    shards = shard_count(docs, "text")
    groups = spread(docs.sparkSession, shards // 4)
    dealt = docs.select("doc_id", "text", *carried).withColumn("shard", F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).cast("int"))
    by_shard = lambda df: df.groupBy("shard")
    told = by_shard(dealt).applyInArrow(gives_back(tell_segments(groups)), REMAIN)
    replies = told.groupBy("g").applyInArrow(gives_back(compare_segments), REMAIN)
    classes = by_shard(dealt).cogroup(by_shard(replies)).applyInArrow(gives_back(tell_classes(groups)), REMAIN)
    answers = classes.groupBy("g").applyInArrow(gives_back(merge_classes), REMAIN)
    schema = f"doc_id {kinds['doc_id']}, n_bytes long, spans array<long>, kept binary" + "".join(f", `{c}` {kinds[c]}" for c in carried)
    return by_shard(dealt).cogroup(by_shard(replies.unionByName(answers))).applyInArrow(gives_back(removal(list(carried), whole_chars)), schema)


def digest(deduped: DataFrame) -> DataFrame:
    size = F.size("spans")
    return deduped.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.floor(size / 2).cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")
    )
