"""Phrase collocations per language by Toivonen's sampling.

A sample of the documents proposes phrases: runs of one to three words that it holds often. The
full pass counts every word, and every longer run whose first and whose last words (all but one)
are proposed: the proposals and their negative border, both exactly. A counted run that is
frequent but was not proposed is a border failure. The expansion pass counts the runs that hold a
failure and that the full pass left out. It closes the search: take a frequent run that the full
pass did not count, and in it the shortest part that was not proposed; all shorter parts of it
are proposed, so the full pass counted that part, and found it frequent, as part of a frequent
run. The run holds a failure and the expansion counts it.

What the full pass counted by hash is spelled out from the sample, which holds nearly all frequent
runs; the expansion pass spells out only those that the sample lacks, so not every task sends every
frequent run.

Proposals, failures and frequent runs reach the tasks as bitmaps of hashes of at most
``MOST_BITS`` bits each. A bit that two runs share only makes more runs be counted; which runs a
pass counts depends on nothing but their words, so no run is counted twice or in part. Runs with
one 64-bit hash are taken as one run.

Defined results: a null text is empty, a null language ``und``; pieces end at a text's end;
repeated rows count each; an empty table gives no rows. Columns other than ``text``, ``lang`` and
``doc_id`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from genoweave.llm.common import BYTE_VALUE, LOWER, Rolling, mix, pieces, text_bytes
from genoweave.session import cut_lineage

LONGEST = 4
LEAST = 30
SAMPLE_RATE = 0.2
#: Share of the expected sample count at which a phrase is proposed.
SLACK = 0.67
MOST_BITS = 1 << 28
LEAST_BITS = 1 << 16
CHUNK = 2_000_000
PAGE = 32768
#: Keys that a task remembers as spelled out.
REMEMBERED = 2_000_000

#: 0 inside a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?"] + [10, 11, 12, 13]] = 2


class Runs:
    """Word runs of consecutive pieces: hashes by length and start, and the words joined by one space."""

    def __init__(self, raw: np.ndarray, ends_text: np.ndarray, lang_of_byte, seeds: np.ndarray):
        # no array of more than one byte for a byte of text: a chunk has far fewer words than bytes
        inside = KIND[raw] == 0
        edge = np.zeros(len(raw) + 1, dtype=bool)
        edge[ends_text] = True
        before = np.ones(len(raw), dtype=bool)
        before[1:] = ~inside[:-1]
        after = np.ones(len(raw), dtype=bool)
        after[:-1] = ~inside[1:]
        starts = np.flatnonzero(inside & (before | edge[:-1]))
        ends = np.flatnonzero(inside & (after | edge[1:])) + 1
        self.n = len(starts)
        breaks = np.flatnonzero((KIND[raw] == 2) | edge[:-1])
        piece = np.searchsorted(breaks, starts, side="right")
        self.same = piece[1:] == piece[:-1]
        size = ends - starts
        self.end = np.cumsum(size + 1) - 1
        self.start = self.end - size
        self.joined = np.full(int(size.sum()) + self.n, 0x20, dtype=np.uint8)
        letter = np.ones(len(self.joined), dtype=bool)
        letter[self.end] = False
        self.joined[letter] = raw[inside]
        self.lang = lang_of_byte(starts)
        words = np.empty(self.n, dtype=np.uint64)
        for i, j in pieces(np.append(self.start, len(self.joined))):
            at = self.start[i]
            words[i:j] = Rolling(BYTE_VALUE[self.joined[at : self.end[j - 1]]]).slices(self.start[i:j] - at, self.end[i:j] - at)
        self.rolling = Rolling(words)
        self.seed = seeds[self.lang]

    def keys(self, m: int) -> np.ndarray:
        grams = self.rolling.grams(m)
        return mix(grams ^ self.seed[: len(grams)])

    def valid(self, m: int) -> np.ndarray:
        n = max(self.n - m + 1, 0)
        ok = np.ones(n, dtype=bool)
        for j in range(m - 1):
            ok &= self.same[j : j + n]
        return ok

    def phrases(self, first: np.ndarray, m: int) -> pa.Array:
        a, b = self.start[first], self.end[first + m - 1]
        offsets = np.zeros(len(first) + 1, dtype=np.int64)
        np.cumsum(b - a, out=offsets[1:])
        data = np.empty(offsets[-1], dtype=np.uint8)
        for i, j in pieces(offsets):
            data[offsets[i] : offsets[j]] = self.joined[np.repeat(a[i:j] - offsets[i:j], b[i:j] - a[i:j]) + np.arange(offsets[i], offsets[j])]
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def chunk_ends(raw: np.ndarray, offsets: np.ndarray) -> Iterator[int]:
    """Where chunks of about ``CHUNK`` bytes end: always at an end of a piece or text, so a longer piece is a chunk of its own."""
    at = 0
    while at < len(raw):
        to = at + CHUNK
        if to < len(raw):
            i = int(np.searchsorted(offsets, to, side="right"))
            inner = np.flatnonzero(KIND[raw[at:to]] == 2)
            last = max(int(offsets[i - 1]), at + int(inner[-1]) + 1 if len(inner) else 0)
            to = last if last > at else next_end(raw, to, int(offsets[i]))
        at = min(to, len(raw))
        yield at


def next_end(raw: np.ndarray, at: int, end: int) -> int:
    """First end of a piece after ``at``, in a text that ends at ``end``."""
    for a in range(at, end, CHUNK):
        found = np.flatnonzero(KIND[raw[a : min(a + CHUNK, end)]] == 2)
        if len(found):
            return a + int(found[0]) + 1
    return end


def runs_of(texts: pa.Array, langs: pa.Array) -> Iterator[tuple[Runs, list[str]]]:
    """Runs of a batch, chunk by chunk; chunks are cut where a piece or a text ends."""
    raw, offsets = text_bytes(texts)
    if not len(raw):
        return
    codes = langs.dictionary_encode()
    names = codes.dictionary.to_pylist()
    lang = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    seeds = np.array([int.from_bytes(blake2b(v.encode(), digest_size=8).digest(), "little") for v in names], dtype=np.uint64)
    at = 0
    for to in chunk_ends(raw, offsets):
        inner = offsets[(offsets >= at) & (offsets <= to)] - at
        runs = Runs(LOWER[raw[at:to]], inner, lambda starts, base=at: lang[np.searchsorted(offsets, starts + base, side="right") - 1], seeds)
        if runs.n:
            yield runs, names
        at = to


def held(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def grouped(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, one run that has each, and how many have it."""
    distinct, at, n = np.unique(keys, return_index=True, return_counts=True)
    return distinct, first[at], n


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))


def numbers(m: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), m, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))], names=["m", "key", "n"])


def summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("m", "key").agg(F.sum("n").alias("n"))


def bitmaps(often: DataFrame, lengths: range, bits_each: int) -> list[np.ndarray]:
    """One bitmap per length with the bits of (m, key) rows; Spark makes pages of them."""
    sizes = {r["m"]: r["n"] for r in often.groupBy("m").agg(F.count("*").alias("n")).collect()}
    bits = {m: min(MOST_BITS, max(LEAST_BITS, 1 << (bits_each * sizes.get(m, 1) - 1).bit_length())) for m in lengths}
    width = F.coalesce(*[F.when(F.col("m") == m, F.lit(n)) for m, n in bits.items()])
    slot = F.col("key").bitwiseAND(width - 1)
    pages = often.select("m", slot.alias("slot")).groupBy("m", F.floor(F.col("slot") / PAGE).alias("page")).agg(F.bitmap_construct_agg((F.col("slot") % PAGE).cast("long")).alias("bits"))
    out = {m: np.zeros(n // 8, dtype=np.uint8) for m, n in bits.items()}
    for r in pages.toLocalIterator():
        at = r["page"] * (PAGE // 8)
        out[r["m"]][at : at + PAGE // 8] = np.frombuffer(bytes(r["bits"]), dtype=np.uint8)
    return list(out.values())


def sampled(docs: DataFrame, rate: float) -> DataFrame:
    # rate as a bound on the whole range of the hash, so small rates keep their meaning
    bound = min(2**63 - 1, int(-(2**63) + rate * 2**64))
    return docs.filter(F.xxhash64(F.col("doc_id").cast("string"), "text") <= F.lit(bound))


def propose(docs: DataFrame, rate: float, least: int) -> list[np.ndarray]:
    """Bitmaps of the runs of one, two and three words that a sample of the documents holds often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for runs, _ in runs_of(b.column(0), b.column(1)):
                for m in range(1, LONGEST):
                    ok = np.flatnonzero(runs.valid(m))
                    key, _, n = grouped(runs.keys(m)[ok], ok)
                    yield numbers(m, key, n)

    counted = summed(_read(sampled(docs, rate)).mapInArrow(run, "m int, key long, n long"))
    return bitmaps(cut_lineage(counted.filter(F.col("n") >= least).select("m", "key")), range(1, LONGEST), 16)


def opened(runs: Runs, proposed: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: keys of all runs, which are inside a piece, and which the full pass counts."""
    parts = None
    for m in range(1, LONGEST + 1):
        keys, inside = runs.keys(m), runs.valid(m)
        yield m, keys, inside, inside if parts is None else inside & parts[:-1] & parts[1:]
        parts = held(proposed[m - 1], keys) if m < LONGEST else None


def count(docs: DataFrame, proposed: list[np.ndarray], least: int) -> DataFrame:
    """(m, key, n) of the frequent runs of the full pass; m = 0 holds the number of words of a language."""
    shared = docs.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for runs, _ in runs_of(b.column(0), b.column(1)):
                key, _, n = grouped(runs.seed, runs.lang)
                yield numbers(0, key, n)
                for m, keys, _, ok in opened(runs, shared.value):
                    first = np.flatnonzero(ok)
                    key, _, n = grouped(keys[first], first)
                    yield numbers(m, key, n)

    total = summed(_read(docs).mapInArrow(run, "m int, key long, n long"))
    return cut_lineage(total.filter((F.col("n") >= least) | (F.col("m") == 0)))


def failures(counted: DataFrame, proposed: list[np.ndarray]) -> DataFrame:
    """(m, key) of frequent runs, short enough to be part of a longer one, that were not proposed."""
    shared = counted.sparkSession.sparkContext.broadcast(proposed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, key = b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64)
            missed = np.zeros(len(b), bool)
            for length in range(1, LONGEST):
                missed |= (m == length) & ~held(shared.value[length - 1], key)
            yield b.filter(pa.array(missed))

    return cut_lineage(counted.filter(F.col("m").between(1, LONGEST - 1)).select("m", "key").mapInArrow(run, "m int, key long"))


def expand(docs: DataFrame, proposed: list[np.ndarray], failed: list[np.ndarray] | None, frequent_bits: list[np.ndarray]) -> DataFrame:
    """(lang, m, phrase, key, more): runs that hold a failure and were left out, with their number in ``more``, and runs of the full pass with a set bit and languages with ``more`` null; each task's own rows."""
    shared = docs.sparkSession.sparkContext.broadcast((proposed, failed, frequent_bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        proposed, failed, frequent_bits = shared.value
        known = np.zeros(0, np.uint64)
        for b in batches:
            for runs, names in runs_of(b.column(0), b.column(1)):
                langs = pa.array(names, pa.string())

                def rows(m: int, at: np.ndarray, key: np.ndarray, n: np.ndarray | None, runs=runs, langs=langs) -> pa.RecordBatch:
                    phrase = runs.phrases(at, m) if m else pa.array([""] * len(at), pa.string())
                    more = pa.nulls(len(at), pa.int64()) if n is None else pa.array(n.astype(np.int64))
                    return pa.RecordBatch.from_arrays([langs.take(pa.array(runs.lang[at])), pa.array(np.full(len(at), m, np.int32)), phrase, pa.array(key.view(np.int64)), more], names=["lang", "m", "phrase", "key", "more"])

                key, at, _ = grouped(runs.seed, np.arange(runs.n))
                yield rows(0, at, key, None)
                fresh = []
                bad = np.zeros(runs.n + 1, bool)  # whether a run of this length or a part of it failed
                for m, keys, inside, ok in opened(runs, proposed):
                    hit = np.flatnonzero(ok & held(frequent_bits[m - 1], keys))
                    key, at, _ = grouped(keys[hit], hit)
                    new = ~np.isin(key, known, assume_unique=True)
                    fresh.append(key[new])
                    yield rows(m, at[new], key[new], None)
                    if failed is not None:
                        bad = bad[: len(keys)] | bad[1 : len(keys) + 1]
                        left = np.flatnonzero(inside & ~ok & bad) if m > 1 else hit[:0]
                        if len(left):
                            key, at, n = grouped(keys[left], left)
                            yield rows(m, at, key, n)
                        if m < LONGEST:
                            bad = np.append(bad | held(failed[m - 1], keys), False)
                known = np.union1d(known, np.concatenate(fresh)) if len(known) < REMEMBERED else np.zeros(0, np.uint64)

    return _read(docs).mapInArrow(run, "lang string, m int, phrase string, key long, more long")


def together(rows: DataFrame) -> DataFrame:
    return rows.groupBy("lang", "m", "phrase", "key").agg(F.sum("more").alias("more"))


def frequent(docs: DataFrame, least: int = LEAST, rate: float = SAMPLE_RATE) -> DataFrame:
    """(lang, m, phrase, n): every run of up to four words that a language holds ``least`` times, and m = 0 for all its words."""
    proposed = propose(docs, rate, max(2, int(least * rate * SLACK)))
    counted = count(docs, proposed, least)
    failed = failures(counted, proposed)
    none = failed.isEmpty()
    wanted, lengths = counted.filter("m > 0").select("m", "key"), range(1, LONGEST + 1)
    early = cut_lineage(together(expand(sampled(docs, rate), proposed, None, bitmaps(wanted, lengths, 64))))
    rest = cut_lineage(wanted.join(early, ["m", "key"], "left_anti"))
    late = expand(docs, proposed, None if none else bitmaps(failed, range(1, LONGEST), 64), bitmaps(rest, lengths, 64))
    spelled = together(early.unionByName(late))
    # a bit shared with a frequent run also spells out others; those have no count and go
    both = spelled.join(counted, ["m", "key"], "left").withColumn("n", F.coalesce("n", "more"))
    return cut_lineage(both.filter((F.col("n") >= least) | (F.col("m") == 0)).select("lang", "m", "phrase", "n"))


def scored(grams: DataFrame) -> DataFrame:
    """Phrases of two words or more with the cut of least score: (lang, m, phrase, a, l, r, n, score)."""
    parts = grams.filter(f"m between 1 and {LONGEST - 1}")
    phrases = grams.filter("m > 1").select("lang", "m", "phrase", F.col("n").alias("a"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("m") - 1))).withColumn("left", F.expr("substring_index(phrase, ' ', k)"))
    cuts = cuts.withColumn("right", F.expr("substring(phrase, char_length(left) + 2)"))
    l = parts.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l"))
    r = parts.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r"))
    both = cuts.join(l, ["lang", "left"]).join(r, ["lang", "right"])
    # 128-bit decimals: no product or sum can overflow
    value = F.expr("cast(cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    best = both.withColumn("score", value).groupBy("lang", "m", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    words = grams.filter("m = 0").select("lang", F.col("n").alias("n"))
    return best.join(words, "lang").select("lang", "m", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def unabsorbed(phrases: DataFrame) -> DataFrame:
    """Phrases that no longer phrase, holding their words in a row, has 80 hundredths of the count of."""
    ws = F.split("phrase", " ")
    longer = phrases.filter("m > 2").select("lang", "a", "m", ws.alias("ws"))
    inner = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("m") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("m") - F.col("size") + 1)))
    inner = inner.select("lang", F.concat_ws(" ", F.slice("ws", F.col("at"), F.col("size"))).alias("phrase"), F.col("a").alias("over"))
    most = inner.groupBy("lang", "phrase").agg(F.max("over").alias("over"))
    ratio = F.expr("over is not null and 100 * cast(over as decimal(19,0)) >= 80 * cast(a as decimal(19,0))")
    return phrases.join(most, ["lang", "phrase"], "left").filter(~ratio).drop("over")


def top(phrases: DataFrame, size: int, salts: int = 8) -> DataFrame:
    """First ``size`` of each language; salted parts are cut first, so a language is no single task's work."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = phrases.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(salts)))
    short = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("rank") <= size)
    ranked = short.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= size)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, size: int = 2000, least: int = LEAST, rate: float = SAMPLE_RATE) -> DataFrame:
    """Each language's first ``size`` collocations: (lang, rank, phrase, a, l, r, n, score)."""
    return top(unabsorbed(scored(frequent(docs, least, rate))), size)


SQL = r"""with d as (select coalesce(lang, 'und') lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') t from documents),
p as (select lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) piece from d),
w as (select lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') ws from p),
s as (select lang, ws, len(ws) k from w where len(ws) > 0),
total as (select lang, sum(k) n from s group by lang),
f as (select lang, m, array_to_string(ws[i : i + m - 1], ' ') phrase, count(*) c from (select lang, ws, m, unnest(range(1, cast(k - m + 2 as bigint))) i from s, (values (1), (2), (3), (4)) q(m) where k >= m) group by all having count(*) >= 30),
c as (select lang, m, phrase, c a, string_split(phrase, ' ') ws from f where m > 1),
cut as (select lang, m, phrase, a, k, array_to_string(ws[1 : k], ' ') lp, array_to_string(ws[k + 1 :], ' ') rp from (select *, unnest(range(1, m)) k from c)),
v as (select cut.*, x.c l, y.c r, cast(2000000 as hugeint) * a // (x.c + y.c) score from cut join f x on x.lang = cut.lang and x.phrase = lp join f y on y.lang = cut.lang and y.phrase = rp),
b as (select lang, m, phrase, a, l, r, score from v qualify row_number() over (partition by lang, phrase order by score, k) = 1),
o as (select lang, array_to_string(ws[i : i + z - 1], ' ') phrase, max(a) most from (select lang, ws, a, m, z, unnest(range(1, m - z + 2)) i from c, (values (2), (3)) q(z) where z < m) group by all),
kept as (select b.* from b left join o on o.lang = b.lang and o.phrase = b.phrase where o.most is null or 100 * cast(o.most as hugeint) < 80 * cast(b.a as hugeint))
select kept.lang, row_number() over (partition by kept.lang order by score desc, a desc, phrase) "rank", phrase, a, l, r, cast(n as bigint) n, cast(score as bigint) score
from kept join total on total.lang = kept.lang qualify "rank" <= 2000"""
