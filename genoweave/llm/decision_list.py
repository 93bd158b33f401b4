"""Quality rules as a learned decision list.

Sequential covering on statistics of labelled documents: a rule is a conjunction of thresholds
that grows by information gain on two thirds of a bounded labelled sample and is pruned on the
rest; rows that it covers leave, and the next rule is grown. Rules that are not precise enough on
the pruning rows are not kept. The list is emitted as one conditional Spark expression, which
then judges every document.

Counts come from whole texts, a batch at a time in arrays; learning sees at most ``MAX_ROWS``
labelled rows, chosen by a hash of the id.

Defined results: null, empty or blank texts have zero counts and fail the base rules; without
both labels among the learning rows the list is empty and every document that passes the base is
kept; repeated rows are judged alike; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.llm import textstats
from genoweave.session import cut_lineage

MAX_ROWS = 20_000
RATIOS = {
    "mean_word": ("word_chars", "n_words"), "symbol_rate": ("n_symbols", "n_chars"), "dup_line_rate": ("n_dup_lines", "n_lines"), "repeat_rate": ("n_repeat_words", "n_words"),
    "distinct_rate": ("n_distinct_words", "n_words"), "upper_rate": ("n_upper", "n_chars"), "digit_rate": ("n_digits", "n_chars"), "punct_rate": ("n_punct", "n_chars"), "words_per_line": ("n_words", "n_lines"),
}
PLAIN = ("n_words", "longest_word")
STATISTICS = (*RATIOS, *PLAIN)


def counted(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, all counts of ``textstats.COUNTS``) per row, from the whole ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats = textstats.joined(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(stats[c]) for c in textstats.COUNTS]], names=["doc_id", *textstats.COUNTS])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in textstats.COUNTS))


def statistics() -> dict[str, Column]:
    """Statistics as expressions over the counts; a rate over nothing is 0."""
    out = {name: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0) for name, (a, b) in RATIOS.items()}
    return out | {name: F.col(name).cast("double") for name in PLAIN}


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        v = x[:, names.index(self.statistic)]
        return v > self.threshold if self.above else v <= self.threshold

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.threshold if self.above else c <= self.threshold


Conjunction = tuple[Condition, ...]


def covers(rule: Conjunction, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for c in rule:
        out &= c.holds(x, names)
    return out


def grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int) -> Conjunction:
    """Add the condition of most information gain until only bad rows are covered."""
    rule: list[Condition] = []
    while len(rule) < longest and len(x) and bad.any() and not bad.all():
        p0, n0 = bad.sum(), len(bad)
        base = np.log2(p0 / n0)
        best, gain = None, 1e-9
        for j, name in enumerate(names):
            cuts = np.unique(np.quantile(x[:, j], np.linspace(0.02, 0.98, 49)))
            order = np.argsort(x[:, j], kind="stable")
            upto = np.concatenate([[0], np.cumsum(bad[order])])
            at = np.searchsorted(x[order, j], cuts, side="right")
            for above, p, n in ((False, upto[at], at), (True, p0 - upto[at], n0 - at)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(n, 1)) - base), -1)
                k = int(np.argmax(g)) if len(g) else 0
                if len(g) and g[k] > gain:
                    best, gain = Condition(name, above, float(cuts[k])), float(g[k])
        if best is None:
            break
        keep = best.holds(x, names)
        x, bad = x[keep], bad[keep]
        rule.append(best)
    return tuple(rule)


def prune(rule: Conjunction, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Conjunction:
    """Drop conditions from the end where that does not worsen (bad - good) / covered."""

    def worth(r: Conjunction) -> float:
        c = covers(r, x, names)
        return (2 * bad[c].sum() - c.sum()) / max(c.sum(), 1)

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth) if rule else rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], max_rules: int = 16, longest: int = 4, precision: float = 0.9, least: int = 5) -> list[Conjunction]:
    """Ordered rules that reject; rows are split by position, two of three grow and one prunes."""
    rules: list[Conjunction] = []
    third = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), dtype=bool)
    for _ in range(max_rules):
        g, p = left & ~third, left & third
        if bad[g].sum() < least:
            break
        rule = prune(grow(x[g], bad[g], names, longest), x[p], bad[p], names)
        if not rule:
            break
        c = covers(rule, x, names) & left
        held = c & third
        if c.sum() < least or bad[c].mean() < precision or (held.any() and bad[held].mean() < precision):
            break
        rules.append(rule)
        left &= ~c
    return rules


def as_column(rules: list[Conjunction]) -> Column:
    """Position (from 1) of the first rule that rejects; 0 if none does."""
    out = F.lit(0)
    for i, rule in reversed(list(enumerate(rules, 1))):
        test = F.lit(True)
        for c in rule:
            test = test & c.column()
        out = F.when(test, i).otherwise(out)
    return out


def learn_rules(counts: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> list[Conjunction]:
    """Learn from (doc_id, quality) rows, where 0 is what to reject; at most ``max_rows`` reach the driver."""
    names = list(STATISTICS)
    chosen = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = counts.join(chosen, "doc_id").select("doc_id", "quality", *[c.alias(n) for n, c in statistics().items()]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).toPandas()
    if rows.empty or rows["quality"].nunique() < 2:
        return []
    return learn(rows[names].to_numpy(float), (rows["quality"] == 0).to_numpy(), names)


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """Counts, statistics, ``base_failed``, ``rule`` (0: none rejects) and ``kept`` per document."""
    counts = cut_lineage(counted(docs))
    rules = learn_rules(counts, labels, max_rows)
    out = counts.withColumns(statistics())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", base).withColumn("rule", as_column(rules)).withColumn("kept", ~base & (F.col("rule") == 0))
