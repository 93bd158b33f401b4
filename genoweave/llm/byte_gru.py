"""Language of a text by a bidirectional gated recurrent network over its bytes.

Every byte of every text is read forwards and backwards by one gated recurrent layer each and gets
a probability for every language; a text's probabilities are the means over its bytes. A text is
read in blocks of ``BLOCK`` bytes that start from the zero state, so long texts are many rows of
one matrix product and memory does not grow with a text. The network is trained in numpy by
backpropagation through time over whole blocks, with the text's language as label of each byte.

It learns from a bounded sample: about ``SAMPLE`` texts with a language, shared evenly between the
languages and chosen by a hash of the row, ``BLOCKS_EACH`` blocks spread over each. Prediction
covers all bytes of all texts in one pass without a shuffle. Only the text is an input.

Defined results: a null text and one without a letter is ``und`` with score 0, as is every text
where nothing was learned; ties go to the language that sorts first; repeated rows score alike;
rows with a null id are not learned from and not held out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.llm.common import pieces, text_bytes

BLOCK = 128
SAMPLE = 4_000
BLOCKS_EACH = 2
HIDDEN = 8
#: Blocks that are read side by side.
ROWS = 2_048


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Logistic function in place."""
    np.clip(x, -40, 40, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


class Network:
    """Two directions of one gated recurrent layer, and one linear layer on both states.

    Arrays run (direction, unit, row) in training. A step is z, r = sigmoid(W x + U h), c = tanh(W x + r * (U h)),
    h = z h + (1 - z) c, with the embedding of a byte folded into W.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 5):
        self.languages = languages
        r = np.random.default_rng(seed)
        k = len(languages)
        self.w = {
            "x": r.normal(0, 0.3, (2, 256, 3 * hidden)).astype(np.float32),
            "h": r.normal(0, 1 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
            "c": np.zeros((2, hidden, 1), np.float32),
            "o": r.normal(0, 0.3, (2, k, hidden)).astype(np.float32),
            "b": np.zeros((k, 1), np.float32),
        }
        self.hidden = hidden

    def inputs(self, both: np.ndarray, t: int) -> np.ndarray:
        """W x of step t: (direction, 3 hidden, row)."""
        return np.stack([self.w["x"][d].T[:, both[d, t]] for d in (0, 1)])

    def step(self, gates: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        n = self.hidden
        u = np.matmul(self.w["h"], h)
        g = gates[:, : 2 * n]
        g += u[:, : 2 * n]
        sigmoid(g)
        m = u[:, 2 * n :] + self.w["c"]
        c = gates[:, 2 * n :]
        c += g[:, n:] * m
        np.tanh(c, out=c)
        return g, m, c, c + g[:, :n] * (h - c)

    def label(self, both: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probability of each language at each byte, summed over a row's bytes: (row, language).

        ``both`` is aligned to the end backwards, so step t forwards and step S - 1 - t backwards
        are the same byte in every row. Arrays run (gate, row, unit) here: a byte's weights are
        one short run of memory, and all results go to arrays made once.
        """
        n, (steps, rows), k = self.hidden, both.shape[1:], len(self.languages)
        logits = np.empty((2, steps, k, rows), np.float32)
        gates, u = np.empty((3, rows, n), np.float32), np.empty((3, rows, n), np.float32)
        short = int(length.min(initial=steps)) < steps
        for d in (0, 1):
            x = np.ascontiguousarray(self.w["x"][d].reshape(256, 3, n).transpose(1, 0, 2))
            x[2] *= 2  # tanh a = 2 sigmoid(2 a) - 1
            w = np.ascontiguousarray(self.w["h"][d].reshape(3, n, n).transpose(0, 2, 1))
            w[2] *= 2
            bias = self.w["c"][d].T * 2
            h = np.zeros((rows, n), np.float32)
            for t in range(steps):
                for gate in (0, 1, 2):
                    np.take(x[gate], both[d, t], axis=0, out=gates[gate], mode="clip")
                np.matmul(h, w, out=u)
                gates[:2] += u[:2]
                sigmoid(gates[:2])
                z, r, c = gates
                u[2] += bias
                u[2] *= r
                c += u[2]
                sigmoid(c)
                c *= 2
                c -= 1
                h -= c
                h *= z
                h += c
                if d and short:
                    h[t < steps - length] = 0
                np.matmul(self.w["o"][d], h.T, out=logits[d, t])
        total = np.zeros((k, rows), np.float32)
        for t in range(steps):
            p = logits[0, t]
            p += logits[1, steps - 1 - t]
            p += self.w["b"]
            p -= p.max(axis=0)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            if short:
                p *= t < length
            total += p
        return total.T

    def gradients(self, both: np.ndarray, length: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over all bytes and its gradients, back through every step of both directions."""
        n, (steps, rows), w = self.hidden, both.shape[1:], self.w
        h = np.zeros((2, n, rows), np.float32)
        past = []
        states = np.empty((steps + 1, 2, n, rows), h.dtype)
        states[0] = 0
        column = np.arange(rows)
        at = np.arange(steps)[:, None]
        inside = at < length
        for t in range(steps):
            g, m, c, h = self.step(self.inputs(both, t), h)
            h[1] *= inside[steps - 1 - t]
            past.append((g, m, c))
            states[t + 1] = h
        forward, aligned = states[1:, 0], states[:0:-1, 1]
        p = np.einsum("kn,tnr->tkr", w["o"][0], forward) + np.einsum("kn,tnr->tkr", w["o"][1], aligned) + w["b"]
        p = np.exp(p - p.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        bytes_ = inside.sum()
        loss = -(np.log(p[:, target, column] + 1e-9) * inside).sum() / bytes_
        p[:, target, column] -= 1
        p *= inside[:, None, :] / np.float32(bytes_)
        grad = {name: np.zeros_like(v) for name, v in w.items()}
        grad["b"] = p.sum(axis=(0, 2))[:, None]
        grad["o"] = np.stack([np.einsum("tkr,tnr->kn", p, forward), np.einsum("tkr,tnr->kn", p, aligned)])
        given = np.empty_like(states[1:])
        given[:, 0] = np.einsum("kn,tkr->tnr", w["o"][0], p)
        given[:, 1] = np.einsum("kn,tkr->tnr", w["o"][1], p)[::-1]
        inner = np.empty((2, 3 * n, steps, rows), np.float32)
        carried = np.zeros((2, n, rows), np.float32)
        for t in range(steps - 1, -1, -1):
            g, m, c = past[t]
            before = states[t]
            z, r = g[:, :n], g[:, n:]
            d = carried + given[t]
            d[1] *= inside[steps - 1 - t]
            dc = d * (1 - z) * (1 - c * c)
            dm = dc * r
            dz, dr = d * (before - c) * z * (1 - z), dc * m * r * (1 - r)
            du = np.concatenate([dz, dr, dm], axis=1)
            dx = np.concatenate([dz, dr, dc], axis=1)
            grad["h"] += du @ before.transpose(0, 2, 1)
            grad["c"] += dm.sum(axis=2, keepdims=True)
            inner[:, :, t] = dx
            carried = d * z + w["h"].transpose(0, 2, 1) @ du
        for i in (0, 1):
            spots = both[i].ravel()
            for unit in range(3 * n):
                grad["x"][i, :, unit] = np.bincount(spots, inner[i, unit].ravel(), 256)
        return float(loss), grad

    def fit(self, both: np.ndarray, length: np.ndarray, target: np.ndarray, updates: int = 500, rows: int = 64, rate: float = 0.015, seed: int = 3) -> Network:
        """Adam with a falling rate; gradients are cut to length one. Few rows are gone through more often."""
        r = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.w.items()}
        second = {k: np.zeros_like(v) for k, v in self.w.items()}
        batches = max(1, len(target) // rows)
        rounds = max(1, round(updates / batches))
        step, last = 0, rounds * batches
        for _ in range(rounds):
            for chosen in np.array_split(r.permutation(len(target)), batches):
                _, grad = self.gradients(both[:, :, chosen], length[chosen], target[chosen])
                size = np.sqrt(sum(float((d * d).sum()) for d in grad.values()))
                now = rate * (1 - step / last) + rate / 50
                step += 1
                for name, d in grad.items():
                    d = d / max(1.0, size)
                    first[name] = 0.9 * first[name] + 0.1 * d
                    second[name] = 0.99 * second[name] + 0.01 * d * d
                    self.w[name] -= (now * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return self


def directions(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Bytes of blocks forwards and backwards: (direction, step, row).

    Forwards a shorter block ends early, backwards it starts late; steps outside repeat byte 0.
    """
    steps = np.arange(int(length.max(initial=0)))
    at = start + steps[:, None]
    ahead = np.where(steps[:, None] < length, raw[np.minimum(at, max(len(raw) - 1, 0))], 0).astype(np.intp)
    return np.stack([ahead, ahead[::-1]])


def blocks(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text of every block; blocks tile the texts."""
    size = np.diff(offsets)
    count = -(-size // BLOCK)
    text = np.repeat(np.arange(len(size)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + inside * BLOCK
    return start, np.minimum(BLOCK, offsets[text + 1] - start), text


def probabilities(network: Network, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Mean probability of each language over the bytes of each text; zero for an empty text."""
    start, length, text = blocks(offsets)
    out = np.zeros((len(offsets) - 1, len(network.languages)))
    # rows of like length side by side
    order = np.argsort(-length, kind="stable")
    for part in np.array_split(order, max(1, -(-len(order) // ROWS))):
        if len(part):
            np.add.at(out, text[part], network.label(directions(raw, start[part], length[part]), length[part]))
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def held_out(column: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(False))


def sample_blocks(raw: np.ndarray, offsets: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to ``each`` blocks of a text, evenly spread: start, length, text."""
    start, length, text = blocks(offsets)
    count = np.bincount(text, minlength=len(offsets) - 1)
    rank = np.arange(len(text)) - (np.cumsum(count) - count)[text]
    n = count[text]
    chosen = (rank * each // np.maximum(n, 1)) != ((rank - 1) * each // np.maximum(n, 1))
    chosen |= n <= each
    return start[chosen], length[chosen], text[chosen]


def train(docs: DataFrame, sample: int = SAMPLE, each: int = BLOCKS_EACH, updates: int = 500) -> Network | None:
    """Fit on about ``sample`` of the rows given, evenly over their languages; the driver holds ``each`` blocks of each."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), "text", F.col("doc_id").cast("string").alias("id"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    names = sorted(sizes, key=lambda v: v.encode())
    share = sample / len(names)
    # a bound on the whole range of the hash, so small rates keep their meaning
    bound = F.coalesce(*[F.when(F.col("lang") == v, F.lit(min(2**63 - 1, int(-(2**63) + share / sizes[v] * 2**64)))) for v in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            start, length, text = sample_blocks(raw, offsets, each)
            cut = [raw[s : s + n].tobytes() for s, n in zip(start, length, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), pa.array(cut, pa.binary())], names=["lang", "block"])

    chosen = known.filter(F.xxhash64("id", "text") <= bound).select("lang", "text")
    rows = sorted((r["lang"], bytes(r["block"])) for r in chosen.mapInArrow(run, "lang string, block binary").collect())
    if not rows:
        return None
    length = np.array([len(b) for _, b in rows])
    raw = np.frombuffer(b"".join(b for _, b in rows), np.uint8)
    place = {v: i for i, v in enumerate(names)}
    target = np.array([place[v] for v, _ in rows])
    return Network(names).fit(directions(raw, np.cumsum(length) - length, length), length, target, updates)


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = text_bytes(b.column(1))
            some = b.column(2).to_numpy(zero_copy_only=False)
            names, score = np.full(len(b), "und", dtype=object), np.zeros(len(b))
            for a, e in pieces(offsets) if network else ():
                p = probabilities(network, raw[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a])
                best = p.argmax(axis=1)
                names[a:e] = np.where(some[a:e], np.array(network.languages, dtype=object)[best], "und")
                score[a:e] = np.where(some[a:e], p[np.arange(e - a), best], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return docs.select("doc_id", "text", lettered.alias("lettered")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); languages of held-out rows are not read."""
    network = train(docs.filter(F.col("doc_id").isNotNull() & ~held_out()), sample)
    return predict(docs, network).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
