"""Bases of reads as numpy arrays: whole Arrow batches are walked at once, one row per base never leaves a task.

Reads come as rname, pos, cigar, seq and qual with what is told of them; a piece of a batch is as
many reads as hold about ``PIECE`` aligned bases, so memory does not grow with the reads' lengths.
The module travels by value, so executors need no installed copy of the package.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Listed positions travel as one byte each of so many neighbours.
BIN_BITS = 8
PIECE = 500_000
# Rows of counts held before they are given out.
HELD = 1_000_000
# A base that a read has no letter for, and one whose text is missing.
BLANK, MISSING = 0, -1
_STEP = re.compile(r"([0-9]+)([MIDNSHP=X])")
_BLOCKS: dict[str, list[tuple[int, int, int]]] = {}


def _blocks(cigar: str) -> list[tuple[int, int, int]]:
    """(reference offset, query offset, length) of every aligned stretch."""
    if cigar not in _BLOCKS:
        if len(_BLOCKS) > 10_000:
            _BLOCKS.clear()
        ref = query = 0
        found = []
        for number, op in _STEP.findall(cigar):
            n = int(number)
            if op in "M=X" and n:
                found.append((ref, query, n))
            if op in "M=XDN":
                ref += n
            if op in "M=XIS":
                query += n
        _BLOCKS[cigar] = found
    return _BLOCKS[cigar]


def _plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _letters(column: pa.Array, upper: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters of all texts in a row as numbers, where each text starts and ends, and which are missing."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    text = pc.fill_null(column, "").cast(pa.large_string())
    size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(size)])
    _, ends, data = text.buffers()
    ends = np.frombuffer(ends, np.int64)[text.offset : text.offset + len(text) + 1]
    if ends[-1] - ends[0] == offsets[-1]:
        codes = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if offsets[-1] else np.zeros(0, np.uint8)
        if upper and codes.max(initial=0) >= 97:
            codes = np.where((codes >= 97) & (codes <= 122), codes - 32, codes).astype(np.uint8)
    else:
        raw = "".join(text.to_pylist())
        codes = np.frombuffer((("".join(c.upper() if len(c.upper()) == 1 else c for c in raw)) if upper else raw).encode("utf-32-le"), np.uint32)
    return codes, offsets, missing


def _at(codes: np.ndarray, offsets: np.ndarray, row: np.ndarray, place: np.ndarray) -> np.ndarray:
    """The character at a place of each row's text, BLANK beyond its end."""
    if len(codes) == 0:
        return np.full(len(row), BLANK, np.int64)
    at = offsets[row] + place
    inside = at < offsets[row + 1]
    return np.where(inside, codes[np.where(inside, at, 0)], BLANK).astype(np.int64)


def walked(table: pa.Table, upper: bool = True) -> Iterator[dict[str, np.ndarray]]:
    """Aligned bases of a table of reads, piece by piece: row, site, place in the read, length of the read, base, bq and, where sites are listed, mark.

    A table with ``_bin`` and ``_marks`` gives only the bases at listed positions of that bin. Reads
    without a place, a CIGAR or qualities have none.
    """
    table = table.filter(pc.and_(pc.and_(pc.is_valid(table["pos"]), pc.is_valid(table["cigar"])), pc.is_valid(table["qual"])))
    if not table.num_rows:
        return
    cigars = _plain(table["cigar"]).dictionary_encode()
    parsed = [_blocks(c) for c in cigars.dictionary.to_pylist()]
    count = np.array([len(p) for p in parsed], np.int64)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    flat = np.array([b for p in parsed for b in p], np.int64).reshape(-1, 3)
    of = cigars.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    load = np.cumsum(np.array([sum(b[2] for b in p) + 1 for p in parsed], np.int64)[of])
    cuts = [0, *(np.flatnonzero(np.diff(load // PIECE)) + 1).tolist(), table.num_rows]
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        if hi <= lo:
            continue
        part = table.slice(lo, hi - lo)
        pos = _plain(part["pos"]).to_numpy(zero_copy_only=False).astype(np.int64)
        kind = of[lo:hi]
        n = count[kind]
        row = np.repeat(np.arange(hi - lo), n)
        block = np.repeat(first[kind], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        start, query, size = pos[row] + flat[block, 0], flat[block, 1], flat[block, 2]
        marks = None
        if "_bin" in part.column_names:
            bins = _plain(part["_bin"]).to_numpy(zero_copy_only=False).astype(np.int64)
            low = np.maximum(start, bins[row] << BIN_BITS)
            high = np.minimum(start + size, (bins[row] + 1) << BIN_BITS)
            query, size, start = query + low - start, high - low, low
            ok = size > 0
            row, start, query, size = row[ok], start[ok], query[ok], size[ok]
            marks = np.frombuffer(b"".join(_plain(part["_marks"]).to_pylist()), np.uint8)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        site, place, row = np.repeat(start, size) + inside, np.repeat(query, size) + inside, np.repeat(row, size)
        mark = None
        if marks is not None:
            mark = marks[(row << BIN_BITS) + (site & ((1 << BIN_BITS) - 1))]
            ok = mark > 0
            row, site, place, mark = row[ok], site[ok], place[ok], mark[ok]
        quals, q_offsets, _ = _letters(_plain(part["qual"]), False)
        bases, offsets, missing = _letters(_plain(part["seq"]), upper)
        base = _at(bases, offsets, row, place)
        if missing.any():
            base[missing[row]] = MISSING
        yield {"row": row + lo, "reads": table, "site": site, "place": place, "long": (offsets[1:] - offsets[:-1])[row], "base": base, "bq": _at(quals, q_offsets, row, place) - 33, "mark": mark}


def packed(columns: list[np.ndarray]) -> np.ndarray:
    """One number per row that is equal, and in the same order, where all columns are."""
    lows = [int(c.min()) for c in columns]
    bits = [int(c.max() - low).bit_length() for c, low in zip(columns, lows, strict=True)]
    if sum(bits) > 62:
        out = columns[0]
        for c in columns[1:]:
            out = np.unique(out, return_inverse=True)[1].astype(np.int64)
            c = np.unique(c, return_inverse=True)[1].astype(np.int64)
            out = out * (int(c.max()) + 1) + c
        return out
    out = np.zeros(len(columns[0]), np.int64)
    for c, low, b in zip(columns, lows, bits, strict=True):
        out = (out << b) | (c - low)
    return out


def summed(columns: list[np.ndarray], values: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the columns with the sums of the values."""
    if len(columns[0]) == 0:
        return columns, values
    key = packed(columns)
    top = int(key.max()) + 1
    if 0 <= int(key.min()) and top <= 4 * len(key) + 1000:
        there = np.flatnonzero(np.bincount(key, minlength=top))
        some = np.empty(top, np.int64)
        some[key] = np.arange(len(key))
        return [c[some[there]] for c in columns], [_added(key, v, top)[there] for v in values]
    order = np.argsort(key, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    return [c[order[heads]] for c in columns], [np.add.reduceat(v[order], heads) for v in values]


def _added(key: np.ndarray, value: np.ndarray, top: int) -> np.ndarray:
    """Sums of whole numbers by key; the weights of a count are floating, which is exact below 2^53."""
    return np.rint(np.bincount(key, weights=value, minlength=top)).astype(np.int64)


class Names:
    """Numbers for texts that come again and again, such as contigs; a missing text is one of them."""

    def __init__(self):
        self.known: dict[str | None, int] = {}

    def of(self, column: pa.Array) -> np.ndarray:
        coded = column.dictionary_encode(null_encoding="encode")
        number = np.array([self.known.setdefault(x, len(self.known)) for x in coded.dictionary.to_pylist()], np.int64)
        return number[coded.indices.to_numpy(zero_copy_only=False)] if len(column) else np.zeros(0, np.int64)

    def text(self, numbers: np.ndarray) -> pa.Array:
        listed = pa.array(list(self.known), pa.string())
        return listed.take(pa.array(numbers))


class Tally:
    """Counts of rows of whole numbers, the first of which stands for a contig; given out when many rows are held."""

    def __init__(self, names: list[str], sums: list[str], contigs: Names):
        self.names, self.sums, self.contigs, self.held, self.parts = names, sums, contigs, 0, []

    def add(self, columns: list[np.ndarray], values: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if len(columns[0]):
            columns, values = summed(columns, values)
            self.parts.append((columns, values))
            self.held += len(columns[0])
            if self.held > HELD:
                self._join()
                if self.held > HELD // 2:
                    yield from self.rest()

    def _join(self) -> None:
        columns = [np.concatenate(x) for x in zip(*[p[0] for p in self.parts], strict=True)]
        values = [np.concatenate(x) for x in zip(*[p[1] for p in self.parts], strict=True)]
        self.parts = [summed(columns, values)]
        self.held = len(self.parts[0][0][0])

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self._join()
            (columns, values), self.parts, self.held = self.parts[0], [], 0
            for lo in range(0, len(columns[0]), 100_000):
                cut = slice(lo, lo + 100_000)
                arrays = [self.contigs.text(columns[0][cut]), *[pa.array(c[cut]) for c in columns[1:]], *[pa.array(v[cut]) for v in values]]
                yield pa.RecordBatch.from_arrays(arrays, names=[*self.names, *self.sums])


def _numbers(table: pa.Table, name: str, missing: int) -> np.ndarray:
    return pc.fill_null(_plain(table[name]), missing).to_numpy(zero_copy_only=False).astype(np.int64)


def tally_bases(quality: int):
    """Reads to counts: contig, site, base as a number, tag, n, bq_sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contigs = Names()
        tally = Tally(["contig", "site", "base", "tag"], ["n", "bq_sum"], contigs)
        for batch in batches:
            for p in walked(pa.Table.from_batches([batch])):
                contig, tag = contigs.of(_plain(p["reads"]["rname"])), _numbers(p["reads"], "tag", 0)
                ok = p["bq"] >= quality
                row = p["row"][ok]
                yield from tally.add([contig[row], p["site"][ok], p["base"][ok], tag[row]], [np.ones(len(row), np.int64), p["bq"][ok]])
        yield from tally.rest()

    return run


# ---- what a read shows, in few bytes, and reads of one name together ---------------------------------


def _lists(row: np.ndarray, reads: int, values: np.ndarray) -> pa.Array:
    """Values of each read as bytes; rows are in order."""
    cut = np.searchsorted(row, np.arange(reads + 1)) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), reads, [None, pa.py_buffer(cut.astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())


def pack_bases(code, quality: int, upper: bool = True, kind=np.uint8):
    """Each read's bases of at least that quality as (key, contig, at, steps, codes, ord): the first place, steps to the next ones, and a code each.

    ``code`` makes numbers below 65,536 of a piece of bases, below 256 if ``kind`` is one byte;
    those below 0 are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p in walked(pa.Table.from_batches([batch]), upper):
                codes = code(p)
                ok = (p["bq"] >= quality) & (codes >= 0)
                row, site, codes = p["row"][ok], p["site"][ok], codes[ok]
                if not len(row):
                    continue
                of, first = np.unique(row, return_index=True)
                steps = np.diff(site, prepend=site[:1])
                steps[first] = 0
                # an insertion puts places side by side and a deletion apart, so steps are short but for spliced reads
                inside = np.cumsum(np.concatenate([[0], np.diff(row) != 0]))
                reads = p["reads"].take(pa.array(of))
                yield pa.RecordBatch.from_arrays(
                    [_plain(reads["key"]), _plain(reads["rname"]), pa.array(site[first]), _lists(inside, len(of), steps.astype(np.uint32)), _lists(inside, len(of), codes.astype(kind)), _plain(reads["ord"])],
                    names=["key", "contig", "at", "steps", "codes", "ord"],
                )

    return run


PACKED = "key string, contig string, at long, steps binary, codes binary, ord long"


def _unpacked(table: pa.Table, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(read, site, code) of packed reads."""
    codes = np.frombuffer(b"".join(_plain(table["codes"]).to_pylist()), kind).astype(np.int64)
    steps = np.frombuffer(b"".join(_plain(table["steps"]).to_pylist()), np.uint32).astype(np.int64)
    size = pc.binary_length(_plain(table["steps"])).to_numpy(zero_copy_only=False).astype(np.int64) // 4
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(table.num_rows), size)
    along = np.cumsum(steps)
    site = _numbers(table, "at", 0)[row] + along - along[np.minimum(start, max(len(along) - 1, 0))][row] if len(along) else along
    return row, site, codes


def grouped(batches: Iterator[pa.RecordBatch], contigs: Names, first, fold, kind=np.uint8) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows of packed reads that are sorted by key, folded per (key, contig, site): (keys, [number of key, contig, site, values]).

    ``first`` makes the values of (reads, row, code), ``fold`` joins those of one place, given in
    the order of the places. The last key of a batch waits for the next batch.
    """
    kept, kept_key, any_kept = None, None, False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        coded = _plain(table["key"]).dictionary_encode(null_encoding="encode")
        number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        run = np.concatenate([[0], np.cumsum(number[1:] != number[:-1])])
        keys = coded.dictionary.take(pa.array(number[np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))])).to_pylist()
        row, site, code = _unpacked(table, kind)
        columns = [run[row], contigs.of(_plain(table["contig"]))[row], site, *first(table, row, code)]
        if any_kept:
            if kept_key != keys[0]:
                keys = [kept_key, *keys]
                columns[0] = columns[0] + 1
            columns = [np.concatenate([a, b]) for a, b in zip(kept, columns, strict=True)]
        columns = fold(columns)
        last = columns[0] == len(keys) - 1
        kept, kept_key, any_kept = [c[last] for c in columns], keys[-1], True
        kept[0] = np.zeros(len(kept[0]), np.int64)
        yield keys, [c[~last] for c in columns]
    if any_kept:
        yield [kept_key], kept


def _heads(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def extremes(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Least and largest values of each place: values come as pairs (least, largest)."""
    if not len(columns[0]):
        return columns
    key = packed(columns[:3])
    order = np.argsort(key, kind="stable")
    heads = _heads(key[order])
    out = [c[order[heads]] for c in columns[:3]]
    for i, c in enumerate(columns[3:]):
        out.append((np.maximum if i % 2 else np.minimum).reduceat(c[order], heads))
    return out


def earliest(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The value of the least order of each place: values are (order, value)."""
    if not len(columns[0]):
        return columns
    key = packed(columns[:3])
    order = np.lexsort((columns[3], key))
    return [c[order[_heads(key[order])]] for c in columns]


# A letter of any alphabet needs two bytes.
WIDE = np.uint16
# Beyond every letter: the least and largest of no letters at all.
NONE_LEAST, NONE_LARGEST = 1 << 16, -1


def tally_agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates per place and call: contig, site, base (-2 where the template's reads disagree), n."""
    contigs = Names()
    tally = Tally(["contig", "site", "base"], ["n"], contigs)

    def first(table, row, code):
        # a code is the letter and 1; 0 is a read without letters
        letter = code - 1
        return np.where(letter < 0, NONE_LEAST, letter), np.where(letter < 0, NONE_LARGEST, letter)

    for _, (_, contig, site, lo, hi) in grouped(batches, contigs, first, extremes, WIDE):
        yield from tally.add([contig, site, np.where(lo == hi, lo, -2)], [np.ones(len(site), np.int64)])
    yield from tally.rest()


def tally_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Templates per place and base of the read first in order: contig, site, base (-1 where that is missing), n."""
    contigs = Names()
    tally = Tally(["contig", "site", "base"], ["n"], contigs)
    never = np.iinfo(np.int64).max

    def first(table, row, code):
        order = pc.fill_null(_plain(table["ord"]), never).to_numpy(zero_copy_only=False).astype(np.int64)[row]
        return order, np.where(order == never, MISSING, code - 1)

    for _, (_, contig, site, _, base) in grouped(batches, contigs, first, earliest, WIDE):
        yield from tally.add([contig, site, base], [np.ones(len(site), np.int64)])
    yield from tally.rest()


def tally_tiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Molecules per place, base and tier (0 exploratory, 1 strict) whose reads agree: contig, site, base, tier, n."""
    contigs = Names()
    tally = Tally(["contig", "site", "base", "tier"], ["n"], contigs)

    def first(table, row, code):
        letter, sure = code >> 1, (code & 1) == 1
        return letter, letter, np.where(sure, letter, NONE_LEAST), np.where(sure, letter, NONE_LARGEST)

    for _, (_, contig, site, lo, hi, slo, shi) in grouped(batches, contigs, first, extremes):
        for tier, (a, b) in enumerate(((lo, hi), (slo, shi))):
            ok = a == b
            yield from tally.add([contig[ok], site[ok], a[ok], np.full(int(ok.sum()), tier)], [np.ones(int(ok.sum()), np.int64)])
    yield from tally.rest()


def distinct(columns: list[np.ndarray]) -> list[np.ndarray]:
    """Each place and value once."""
    if not len(columns[0]):
        return columns
    key = packed(columns)
    order = np.argsort(key, kind="stable")
    return [c[order[_heads(key[order])]] for c in columns]


def tally_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Starts per place, base and strand, reads of one start being together: contig, site, base, tag, n."""
    contigs = Names()
    tally = Tally(["contig", "site", "base", "tag"], ["n"], contigs)
    for _, (_, contig, site, code) in grouped(batches, contigs, lambda table, row, code: (code,), distinct):
        yield from tally.add([contig, site, code >> 1, code & 1], [np.ones(len(site), np.int64)])
    yield from tally.rest()


LETTERS = np.full(1 << 16, -1, np.int64)
LETTERS[[65, 67, 71, 84]] = [0, 1, 2, 3]


def letter_code(p: dict) -> np.ndarray:
    """The letter as it is, and 1; 0 without letters."""
    return np.minimum(p["base"], 65_533) + 1


def allele_code(p: dict) -> np.ndarray:
    """mark * 2 + (the base is ALT) of bases that are REF or ALT, five bases from either end."""
    letter = LETTERS[np.clip(p["base"], 0, 65_535)]
    mark = p["mark"].astype(np.int64) - 1
    alt = letter == (mark & 3)
    margin = np.minimum(p["place"], p["long"] - p["place"] - 1)
    return np.where((letter >= 0) & (alt | (letter == mark >> 2)) & (margin >= 5), mark * 2 + alt, -1)


def molecule_code(p: dict) -> np.ndarray:
    """letter * 2 + (strict) of called bases."""
    base = p["base"]
    letter = LETTERS[np.clip(base, 0, 65_535)]
    margin = np.minimum(p["place"], p["long"] - p["place"] - 1)
    strict = (_numbers(p["reads"], "mapq", 0)[p["row"]] >= 20) & (p["bq"] >= 20) & (margin >= 5)
    return np.where(letter >= 0, base * 2 + strict, -1)


def strict_code(p: dict) -> np.ndarray:
    """letter * 2 + tag of strict bases only."""
    code = molecule_code(p)
    return np.where((code >= 0) & (code & 1 == 1), code - 1 + _numbers(p["reads"], "tag", 0)[p["row"]], -1)


def molecule_markers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per molecule and contig: (contig, molecule, seen), sorted numbers site * 32 + code of the alleles its reads agree on."""
    contigs = Names()

    def first(table, row, code):
        return code, code

    for keys, (run, contig, site, lo, hi) in grouped(batches, contigs, first, extremes):
        ok = lo == hi
        run, contig, seen = run[ok], contig[ok], (site * 32 + lo)[ok]
        heads = np.flatnonzero(np.concatenate([[True], (run[1:] != run[:-1]) | (contig[1:] != contig[:-1])])) if len(run) else np.zeros(0, np.int64)
        for lo_ in range(0, len(heads), 10_000):
            at = heads[lo_ : lo_ + 10_000]
            end = heads[lo_ + 10_000] if lo_ + 10_000 < len(heads) else len(run)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [end]]) - at[0], pa.int32()), pa.array(seen[at[0] : end]))
            yield pa.RecordBatch.from_arrays([contigs.text(contig[at]), pa.array(keys, pa.string()).take(pa.array(run[at])), lists], names=["contig", "molecule", "seen"])


cloudpickle.register_pickle_by_value(sys.modules[__name__])
