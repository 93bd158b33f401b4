"""Quality classifier by positive-unlabelled learning.

A small network minimises the non-negative unbiased risk (Kiryo et al. 2017): trusted positives
stand for the good class, unlabelled documents for the mix of both, and the negative part of the
risk, the unlabelled loss less the share that positives explain, may not go below zero. The class
prior is the share of 1 among labelled learning rows where both labels occur, else the least ratio
of unlabelled to positive rows above any score of a positives-against-unlabelled model.

Features are counts of the whole text (rates of ``textstats`` and the distribution of its bytes);
labels, language, source and id are never inputs. Learning sees two bounded samples, each chosen by
a hash: about ``SAMPLE`` of all documents stand for the unlabelled mix, and documents of up to
about ``LABELS`` labelled ids, however few those are among all, for the positives and the prior.
Scoring covers every document in one pass without a shuffle.

Defined results: null and empty texts have all-zero features and get a score like any other;
without a trusted positive the score is 0.5; repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.llm import textstats
from genoweave.llm.common import gives_back, text_bytes

SAMPLE = 30_000
LABELS = 10_000
RATES = (("word_chars", "n_words", 0.1), ("n_symbols", "n_chars", 4), ("n_dup_lines", "n_lines", 1), ("n_repeat_words", "n_words", 1), ("n_distinct_words", "n_words", 1), ("n_upper", "n_chars", 4), ("n_digits", "n_chars", 4), ("n_punct", "n_chars", 4))
LOGS = ("n_words", "n_lines", "longest_word")
WIDTH = len(RATES) + len(LOGS) + 256
#: Rows that a step over many rows takes at a time.
BLOCK = 4096


def features(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of floats per text."""
    s = textstats.per_text(raw, offsets)
    n = len(offsets) - 1
    columns = [np.where(s[b] > 0, s[a] / np.maximum(s[b], 1) * w, 0.0) for a, b, w in RATES] + [np.log1p(s[c]) for c in LOGS]
    text = np.repeat(np.arange(n), np.diff(offsets))
    bytes_ = np.bincount(text * 256 + raw, minlength=n * 256).reshape(n, 256)
    return np.hstack([np.stack(columns, axis=1), np.sqrt(bytes_ / np.maximum(np.diff(offsets), 1)[:, None])]).astype(np.float32)


def blocks(x: np.ndarray) -> Iterator[np.ndarray]:
    return (x[i : i + BLOCK] for i in range(0, len(x), BLOCK))


def stacked(column: pa.ChunkedArray, chosen: np.ndarray) -> np.ndarray:
    """The chosen entries, packed floats, as rows of one array; a batch of the column at a time."""
    out, at, done = np.empty((int(chosen.sum()), WIDTH), np.float32), 0, 0
    for chunk in column.chunks:
        rows = text_bytes(chunk)[0].view(np.float32).reshape(len(chunk), WIDTH)[chosen[at : at + len(chunk)]]
        out[done : done + len(rows)] = rows
        at, done = at + len(chunk), done + len(rows)
    return out


class Network:
    """One hidden layer; trained by minibatches with Adam from a fixed seed."""

    def __init__(self, width: int, hidden: int = 32, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.weights = [r.normal(0, 1 / np.sqrt(width), (width, hidden)).astype(np.float32), np.zeros(hidden, np.float32), r.normal(0, 1 / np.sqrt(hidden), hidden).astype(np.float32), np.zeros(1, np.float32)]

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[0] + self.weights[1])
        return h, h @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.concatenate([self.forward(rows)[1] for rows in blocks(x)]) if len(x) else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(f.astype(float), -30, 30)))

    def scale_to(self, *parts: np.ndarray) -> None:
        """Mean and spread of all rows of the parts, without a copy of them."""
        n = sum(map(len, parts))
        mean = sum(rows.sum(0, dtype=float) for x in parts for rows in blocks(x)) / n
        spread = sum(((rows - mean) ** 2).sum(0) for x in parts for rows in blocks(x)) / n
        self.mean, self.scale = mean.astype(np.float32), (np.sqrt(spread) + 1e-3).astype(np.float32)

    def fit(self, p: np.ndarray, u: np.ndarray, prior: float, epochs: int = 30, batch: int = 1000, rate: float = 3e-3, decay: float = 1e-4, seed: int = 11) -> Network:
        """Non-negative PU risk with the logistic loss."""
        self.scale_to(p, u)
        r = np.random.default_rng(seed)
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in self.weights]
        step = 0
        for _ in range(epochs):
            for rows in np.array_split(r.permutation(len(u)), max(1, len(u) // batch)):
                xu = u[rows]
                xp = p[r.integers(0, len(p), min(len(p), batch))]
                x = np.vstack([xp, xu])
                h, f = self.forward(x)
                k = len(xp)
                s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
                softplus = np.logaddexp(0, f)  # loss of calling a row negative
                negative = softplus[k:].mean() - prior * softplus[:k].mean()
                g = np.zeros_like(f)
                grad_negative = np.concatenate([-prior * s[:k] / k, s[k:] / len(xu)])
                if negative >= 0:
                    g[:k] = -prior * (1 - s[:k]) / k
                    g += grad_negative
                else:
                    g = -grad_negative
                z = np.clip((x - self.mean) / self.scale, -8, 8)
                back = np.outer(g, self.weights[2]) * (1 - h * h)
                grads = [z.T @ back, back.sum(0), h.T @ g, np.array([g.sum()], np.float32)]
                step += 1
                for w, d, m in zip(self.weights, grads, moments, strict=True):
                    d = d + decay * w
                    m[0] = 0.9 * m[0] + 0.1 * d
                    m[1] = 0.999 * m[1] + 0.001 * d * d
                    w -= (rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Without a labelled negative: least ratio of unlabelled to positive rows above a score."""
    a = np.sort(Network(p.shape[1]).fit(p, u, 0.5, epochs=10).score(np.vstack([p, u])))
    net = Network(p.shape[1]).fit(p, u, 0.5, epochs=10)
    sp, su = net.score(p), net.score(u)
    cuts = np.quantile(a, np.linspace(0.0, 0.9, 46))
    ratios = [(su >= c).mean() / (sp >= c).mean() for c in cuts if (sp >= c).mean() > 0.1]
    return float(np.clip(min(ratios, default=0.5), 0.02, 0.98))


def chosen_by(share: float, *columns) -> Column:
    """A share of all rows by a hash; the bound lies on the whole range, so small shares keep their meaning."""
    return F.xxhash64(*columns) <= F.lit(min(2**63 - 1, int(-(2**63) + share * 2**64)))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, prior: float | None = None, labelled: int = LABELS) -> Network | None:
    """Fit on about ``sample`` of the documents given and those of about ``labelled`` labelled ids; (doc_id, quality) rows name positives."""
    total = docs.count()
    if total == 0:
        return None
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = list(textstats.over_pieces(b.column(1), features))
            if parts:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in np.vstack(parts)], pa.binary()), b.column(2), b.column(3)], names=["doc_id", "x", "quality", "mixed"])

    marks = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    marks = marks.filter(chosen_by(labelled / max(1, marks.count()), "doc_id", F.lit("label")))
    mixed = chosen_by(sample / total, "doc_id", F.lit("sample"))
    # marks are about ``labelled`` rows whatever the input
    read = docs.filter("doc_id is not null").select("doc_id", "text").join(F.broadcast(marks), "doc_id", "left").select("doc_id", "text", "quality", mixed.alias("mixed"))
    found = read.filter("mixed or quality is not null").mapInArrow(gives_back(run), f"doc_id {kind}, x binary, quality int, mixed boolean")
    # repeated ids may add rows: the first by a hash then, alike in every run
    first = found.orderBy(F.xxhash64("doc_id", "x"), "doc_id", "x").limit(2 * (sample + labelled))
    # the driver keeps the floats once: sorted by Spark, received as Arrow, dropped when they are dealt
    rows = first.sortWithinPartitions("doc_id", "x").select("x", "quality", "mixed").toArrow()
    quality = rows["quality"].fill_null(-1).to_numpy()
    good, bad, mix = quality == 1, quality == 0, rows["mixed"].to_numpy()
    if not good.any():
        return None
    if not mix.any():
        mix = np.ones(len(mix), bool)
    p, u = stacked(rows["x"], good), stacked(rows["x"], mix)
    del rows
    if prior is None:
        prior = float(np.clip(good.sum() / (good.sum() + bad.sum()), 0.02, 0.98)) if bad.any() else estimate_prior(p, u)
    return Network(WIDTH).fit(p, u, prior)


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """(doc_id, score) of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [network.score(x) if network else np.full(len(x), 0.5) for x in textstats.over_pieces(b.column(1), features)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(parts) if parts else np.zeros(0))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(gives_back(run), f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, network: Network | None, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, whose ``text`` scores at least ``least``; all of them without a network."""
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [network.score(x) for x in textstats.over_pieces(b.column(place), features)]
            if parts:
                yield b.filter(pa.array(np.concatenate(parts) >= least))

    return docs.mapInArrow(gives_back(run), docs.schema) if network else docs


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted); labels of held-out rows are not read."""
    network = train(docs.filter(~held_out()), labels.filter(~held_out()), sample)
    out = score(docs, network).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
