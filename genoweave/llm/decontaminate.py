"""Benchmark decontamination by template canonicalisation.

Words lose their case and outer punctuation; numbers, units after a number and names (capitals
inside a sentence) become typed placeholders; numbers or names with only white space between them
(New York, twenty one) become one. Windows of eight such tokens of every document are
hash-joined with those of the benchmark. Windows that lie at one displacement of a document and an
item form a placement; its slots must be consistent: one value of the item's text stands for one
value in the document throughout, so a re-parameterised question is caught and a chance likeness
of templates is not.

A document task only emits windows whose hash is set in a bitmap of fixed size (2^22 bits) made from
the benchmark; the join decides. A window needs four tokens that are not placeholders (half of it
of an item's words if it is shorter than a window), and a placement needs ``MIN_WINDOWS`` windows or
all of a short item.

Beside it windows of plain words are joined, whatever they hold, so items of numbers or names and
copies in another case are found too: also by ``MIN_WINDOWS`` windows or all of a short item, but a
part of an item does not count where its template lies in the document with inconsistent slots.
A slot that changes by small words between capitals (Lloyds -> Bank of England) still shifts the rest.

Defined results: null and empty texts and items match nothing; a null doc_id is reported as null;
repeated documents are reported once with the same count; columns beside (doc_id, text) and
(item_id, text) are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.common import BYTE_VALUE, IS_SPACE, LOWER, U64, Rolling, gives_back, pieces, text_bytes, word_bounds
from genoweave.session import cut_lineage

WINDOW = 8
CONTENT = 4
MIN_WINDOWS = 6
BITS = 22
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound pounds ounce ounces "
    "ml cl l liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur gbp "
    "degree degrees celsius fahrenheit kelvin w kw mw watt watts j kj joule joules v volt volts a amp amps hz khz mhz ghz kmh mph kph kb mb gb tb byte bytes bit bits meilen stunden minuten jahre tage wochen monate heures jours ans horas dias años"
).split()
NUMBER_WORDS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()

CORE = np.zeros(256, dtype=bool)
CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
STOP = np.zeros(256, dtype=bool)
STOP[list(b".!?\n:")] = True
PLAIN = 0x5BD1E9955BD1E995
NUMBER, UNIT, NAME = (U64(x) for x in (0x6E756D62, 0x756E6974, 0x6E616D65))


def hash_of(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return Rolling(BYTE_VALUE[raw]).slices(np.array([0]), np.array([len(raw)]))[0]


UNIT_HASHES = np.sort(np.array([hash_of(w) for w in UNITS]))
NUMBER_HASHES = np.sort(np.array([hash_of(w) for w in NUMBER_WORDS]))


def among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def templates(raw: np.ndarray, offsets: np.ndarray, plain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template token hashes, slot value hashes (0 where there is no slot), words before each token and first token of each text; ``plain``: words as they are."""
    starts, ends, _ = word_bounds(raw, offsets)
    cores = np.flatnonzero(CORE[raw])
    at, to = np.searchsorted(cores, starts), np.searchsorted(cores, ends)
    some = to > at
    starts, ends = cores[at[some]], cores[to[some] - 1] + 1
    low = LOWER[raw]
    if len(raw):
        second = np.zeros(len(raw), dtype=bool)
        second[1:] = raw[:-1] == 0xC3
        accent = second & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        low = np.where(accent, raw + 32, low).astype(np.uint8)
    words = Rolling(BYTE_VALUE[low]).slices(starts, ends)
    first = np.searchsorted(starts, offsets)
    n = len(starts)
    if n == 0 or plain:
        return words, np.zeros(n, dtype=np.uint64), np.arange(n + 1), first
    begins = np.zeros(n + 1, dtype=bool)
    begins[first] = True
    begins = begins[:n]
    stops = np.concatenate([[0], np.cumsum(STOP[raw])])
    before = np.concatenate([[0], ends[:-1]])
    sentence = begins | (stops[starts] > stops[before])
    upper = low[starts] != raw[starts]
    upper |= (raw[starts] == 0xC3) & (low[np.minimum(starts + 1, len(raw) - 1)] != raw[np.minimum(starts + 1, len(raw) - 1)])
    number = DIGIT[raw[starts]] | among(words, NUMBER_HASHES)
    after_number = np.concatenate([[False], number[:-1]]) & ~begins
    unit = ~number & after_number & among(words, UNIT_HASHES)
    name = upper & ~sentence & ~number & ~unit
    slot = number | unit | name
    token = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words)))
    blank = np.concatenate([[0], np.cumsum(~IS_SPACE[raw])])
    run = np.zeros(n, dtype=bool)
    run[1:] = (token[1:] == token[:-1]) & (number | name)[1:] & (blank[starts[1:]] == blank[ends[:-1]]) & ~begins[1:]
    at = np.flatnonzero(~run)
    value = Rolling(words).slices(at, np.append(at[1:], n))
    return token[at], np.where(slot[at], value | U64(1), U64(0)), np.append(at, n), np.searchsorted(at, first)


def windows(raw: np.ndarray, offsets: np.ndarray, length: int, of_item: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in text, slots of the window) of windows with enough content tokens; of all windows of plain words if ``length`` is negative."""
    plain, length = length < 0, abs(length)
    token, value, words, first = templates(raw, offsets, plain)
    n = len(token) - length + 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return z.astype(np.uint64), z, z, np.zeros((0, length), dtype=np.uint64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    ok = text[:n] == text[length - 1 :]
    if not plain:
        content = np.concatenate([[0], np.cumsum(value == 0)])
        found = content[length:] - content[:n]
        ok &= found >= (CONTENT if length >= WINDOW else -(-length // 2))
        if of_item and length < WINDOW:
            ok &= 2 * found >= words[length:] - words[:n]
    at = np.flatnonzero(ok)
    return Rolling(token).grams(length)[at] ^ U64(PLAIN if plain else 0), text[at], at - first[text[at]], np.lib.stride_tricks.sliding_window_view(value, length)[at]


FIELDS = "length int, hash long, place int, slots array<long>"


def window_rows(lengths: list[int], bitmap: np.ndarray | None):
    """Arrow function over (id, text): a row per window, only those in the bitmap if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            for lo, hi in pieces(offsets):
                part, cuts = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                for length in lengths:
                    h, text, place, slots = windows(part, cuts, length, bitmap is None)
                    if bitmap is not None:
                        keep = bitmap[(h >> U64(64 - BITS)).astype(np.int64)]
                        h, text, place, slots = h[keep], text[keep], place[keep], slots[keep]
                    if len(h) == 0:
                        continue
                    lists = pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * abs(length), pa.array(np.ascontiguousarray(slots).view(np.int64).ravel()))
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(text + lo)), pa.array(np.full(len(h), length, np.int32)), pa.array(h.view(np.int64)), pa.array(place.astype(np.int32)), lists],
                        names=["id", "length", "hash", "place", "slots"],
                    )

    return run


def token_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        raw, offsets = text_bytes(b.column(1))
        for sign, plain in ((1, False), (-1, True)):
            tokens = np.diff(templates(raw, offsets, plain)[3])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((sign * np.minimum(tokens, WINDOW)).astype(np.int32))], names=["id", "length"])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, windows, of_windows, same_slots): items that a document holds, re-parameterised or not."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    items = benchmark.select(F.col("item_id").alias("id"), "text")
    lengths_of = items.mapInArrow(token_counts, f"id {item_kind}, length int").filter("length <> 0").distinct()
    lengths_of = cut_lineage(lengths_of)
    lengths = sorted(r["length"] for r in lengths_of.select("length").distinct().collect())  # sixteen values at most
    if not lengths:
        lengths = [-WINDOW, WINDOW]
    of_items = items.mapInArrow(window_rows(lengths, None), f"id {item_kind}, {FIELDS}").join(lengths_of, ["id", "length"]).distinct()
    of_items = cut_lineage(of_items.withColumnsRenamed({"id": "item_id", "place": "item_place", "slots": "item_slots"}))
    marks = of_items.select(F.shiftrightunsigned("hash", 64 - BITS).cast("int").alias("bit")).distinct().toPandas()["bit"].to_numpy()  # 2^22 values at most
    bitmap = np.zeros(1 << BITS, dtype=bool)
    bitmap[marks.astype(np.int64)] = True
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(bitmap))

    def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return window_rows(lengths, np.unpackbits(shared.value).view(bool))(batches)

    seen = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(gives_back(of_docs), f"id {kind}, {FIELDS}").withColumnRenamed("id", "doc_id")
    hits = seen.join(of_items, ["length", "hash"]).withColumns({"shift": F.col("place") - F.col("item_place"), "plain": F.col("length") < 0})
    hits = cut_lineage(hits.select("doc_id", "item_id", "plain", "shift", "item_place", "item_slots", "slots"))
    pairs = hits.filter("not plain").select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("item_slots", "slots")).alias("p"))
    pairs = pairs.filter("p.item_slots <> 0").groupBy("doc_id", "item_id", "shift", F.col("p.item_slots").alias("value")).agg(F.min("p.slots").alias("lo"), F.max("p.slots").alias("hi"))
    odd = pairs.groupBy("doc_id", "item_id", "shift").agg(F.max(F.col("lo") != F.col("hi")).alias("odd"), F.min((F.col("lo") == F.col("value")) & (F.col("hi") == F.col("value"))).alias("same"))
    odd = odd.withColumns({"_p": F.lit(False)}).withColumnsRenamed({"doc_id": "_d", "item_id": "_i", "shift": "_s"})
    placed = hits.groupBy("doc_id", "item_id", "plain", "shift").agg(F.countDistinct("item_place").alias("windows"))
    placed = placed.join(odd, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_i")) & (F.col("shift") == F.col("_s")) & (F.col("plain") == F.col("_p")), "left")
    total = of_items.groupBy("item_id", (F.col("length") < 0).alias("_q")).agg(F.countDistinct("item_place").alias("of_windows")).withColumnRenamed("item_id", "_t")
    good = placed.join(total, F.col("item_id").eqNullSafe(F.col("_t")) & (F.col("plain") == F.col("_q")))
    good = good.filter(F.col("windows") >= F.least(F.lit(MIN_WINDOWS), F.col("of_windows")))
    is_odd, whole = F.coalesce("odd", F.lit(False)), F.col("windows") == F.col("of_windows")
    # a template placement stands before one of plain words
    best = F.max(F.when(~is_odd, F.struct(~F.col("plain"), "windows", "of_windows"))).alias("best")
    good = good.groupBy("doc_id", "item_id").agg(
        best, F.max(is_odd).alias("odd"), F.max(~is_odd & (~F.col("plain") | whole)).alias("sure"), F.max(F.when(~is_odd, F.coalesce("same", F.lit(True)))).alias("same_slots")
    )
    return good.filter("best is not null and (sure or not odd)").select("doc_id", "item_id", "best.windows", "best.of_windows", "same_slots")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that hold no item; rows with a null id are judged by text and cannot be told apart, so they stay."""
    return docs.join(find(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti")
