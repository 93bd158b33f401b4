"""URL filter: host and path rules first, then a ratio of character language models.

Two variable-order Markov models, one of accepted and one of rejected URLs (those that rules
decide), are interpolated from order 0 up: an order's count is mixed with the order below by a
pseudo-count. A URL passes if its log-likelihood difference per character is at least the
calibrated threshold, the middle between the two classes' means. Everything is DataFrame work:
counts over all URLs, one join of distinct grams per order, one join for scoring that AQE may
split at a hot gram.

Defined results: null URL or no ``://``: host, path and rule text empty, difference 0; no accepted
or no rejected URL at all: everything undecided is allowed; repeated rows are scored alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START = "\u0002"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null without one."""
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: list[Rule], host: Column, path: Column, part: str) -> Column:
    """Text or verdict of the longest rule that fits; null if none does."""
    out = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.lit(r.text if part == "rule" else r.verdict)
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("string") if out is None else out


def model(grams: DataFrame, order: int, pseudo: float, alphabet: int) -> DataFrame:
    """Log ratio of every gram of context length 0 to ``order``: (gram, lr).

    ``grams`` has (gram, na, nb): occurrences in accepted and rejected URLs, 0 where unseen.
    """
    # longest context first character on the left; a context is all but the last character
    with_context = grams.withColumn("k", F.length("gram") - 1).withColumn("context", F.expr("substring(gram, 1, length(gram) - 1)"))
    context = with_context.groupBy("context").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"))
    level = with_context.join(context, "context").select("gram", "k", "na", "nb", "ca", "cb")
    flat = F.lit(1.0 / alphabet)
    mixed = lambda n, c, p: (F.col(n) + pseudo * p) / (F.col(c) + pseudo)
    below = level.filter("k = 0").select("gram", mixed("na", "ca", flat).alias("pa"), mixed("nb", "cb", flat).alias("pb"))
    out = below
    for k in range(1, order + 1):
        here = level.filter(F.col("k") == k).withColumn("suffix", F.expr("substring(gram, 2)"))
        below = here.join(below.select(F.col("gram").alias("suffix"), "pa", "pb"), "suffix").select(
            "gram", mixed("na", "ca", F.col("pa")).alias("pa"), mixed("nb", "cb", F.col("pb")).alias("pb")
        )
        out = out.unionByName(below)
    return out.select("gram", (F.log("pa") - F.log("pb")).alias("lr"))


def margins(urls: DataFrame, order: int = 3, pseudo: float = 2.0, alphabet: int = 256) -> DataFrame:
    """(s, label) of URL texts to (s, label, n, margin): difference per character, 0 for an empty text.

    ``s`` is distinct; ``label`` is allow, block or null, ``n`` counts the rows behind it.
    """
    text = F.concat(F.lit(START), F.col("s"))
    places = F.sequence(F.lit(2), F.length(text))
    all_grams = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(F.lit(0), F.least(i - 1, F.lit(order))), lambda k: text.substr(i - k, k + 1))))
    seen = urls.filter("s <> ''").select("label", "n", F.explode(all_grams).alias("gram"))
    counts = seen.groupBy("gram").agg(
        F.sum(F.when(F.col("label") == "allow", F.col("n")).otherwise(0)).alias("na"),
        F.sum(F.when(F.col("label") == "block", F.col("n")).otherwise(0)).alias("nb"),
    )
    ratios = model(cut_lineage(counts), order, pseudo, alphabet)
    longest = F.transform(places, lambda i: text.substr(i - F.least(i - 1, F.lit(order)), F.least(i - 1, F.lit(order)) + 1))
    used = urls.filter("s <> ''").select("s", F.explode(longest).alias("gram"))
    sums = used.join(ratios, "gram").groupBy("s").agg((F.sum("lr") / F.count("*")).alias("margin"))
    return urls.join(sums, "s", "left").select("s", "label", "n", F.coalesce("margin", F.lit(0.0)).alias("margin"))


def judge(pages: DataFrame, rules: list[Rule], order: int = 3, pseudo: float = 2.0) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` to rows with a ``url``."""
    host, path = F.col("_host"), F.col("_path")
    parts = pages.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url"))})
    parts = parts.withColumns({"_rule": first_rule(rules, host, path, "rule"), "_decided": first_rule(rules, host, path, "verdict")})
    parts = parts.withColumn("_s", F.coalesce(F.translate(after_scheme(F.col("url")), UPPER, LOWER), F.lit("")))
    urls = parts.groupBy(F.col("_s").alias("s")).agg(F.max("_decided").alias("label"), F.count("*").alias("n"))
    scored = cut_lineage(margins(urls, order, pseudo))
    means = scored.filter("label is not null").groupBy("label").agg((F.sum(F.col("margin") * F.col("n")) / F.sum("n")).alias("mean"))
    mean = {r["label"]: r["mean"] for r in means.collect()}  # two rows at most
    if {"allow", "block"} <= mean.keys():
        passes = F.col("margin") >= (mean["allow"] + mean["block"]) / 2
    else:
        passes = F.lit(True)
    # variants of one text that differ in case may be decided and undecided, so every text has a guess
    verdicts = scored.select(F.col("s").alias("_s"), F.when(passes, "allow").otherwise("block").alias("_guess"))
    out = parts.join(verdicts, "_s", "left")
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    return out.select(*keep, host.alias("host"), path.alias("path"), F.col("_rule").alias("rule"), F.coalesce("_decided", "_guess").alias("verdict"))


RULES = [
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
]


def sql(rules: list[Rule], order: int = 3, pseudo: float = 2.0, alphabet: int = 256) -> str:
    """DuckDB twin of ``judge`` over ``pages``."""
    ranked = sorted(rules, key=lambda r: (-len(r.text), r.text))
    case = lambda part: "case " + " ".join(f"when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}') then '{r.text if part == 'rule' else r.verdict}'" for r in ranked) + " end"
    levels = [f"p0 as (select gram, (na + {pseudo} * (1.0e0/{alphabet})) / (ca + {pseudo}) pa, (nb + {pseudo} * (1.0e0/{alphabet})) / (cb + {pseudo}) pb from c where k = 0)"]
    for k in range(1, order + 1):
        levels.append(f"p{k} as (select c.gram, (na + {pseudo} * pa) / (ca + {pseudo}) pa, (nb + {pseudo} * pb) / (cb + {pseudo}) pb from c join p{k - 1} b on b.gram = substr(c.gram, 2) where c.k = {k})")
    union = " union all ".join(f"select * from p{k}" for k in range(order + 1))
    return f"""with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end rest from pages),
 h as (select page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}'), '') host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') path, coalesce(translate(rest, '{UPPER}', '{LOWER}'), '') s from u),
 r as (select *, {case("rule")} rule, {case("verdict")} decided from h),
 d as (select s, max(decided) label, count(*) n from r group by s),
 t as (select s, label, n, chr(2) || s x, unnest(range(2, length(s) + 2)) i from d where s <> ''),
 g as (select label, n, i, k, substr(x, i - k, k + 1) gram from (select *, unnest(range(0, least(i - 1, {order}) + 1)) k from t)),
 a as (select gram, coalesce(sum(n) filter (where label = 'allow'), 0) na, coalesce(sum(n) filter (where label = 'block'), 0) nb from g group by gram),
 b as (select substr(gram, 1, length(gram) - 1) context, sum(na) ca, sum(nb) cb from a group by 1),
 c as (select gram, length(gram) - 1 k, na, nb, ca, cb from a join b on b.context = substr(gram, 1, length(gram) - 1)),
 {", ".join(levels)},
 q as (select gram, ln(pa) - ln(pb) lr from ({union})),
 m as (select s, sum(lr) / count(*) margin from (select s, substr(x, i - least(i - 1, {order}), least(i - 1, {order}) + 1) gram from t) join q using (gram) group by s),
 f as (select d.s, label, n, coalesce(margin, 0) margin from d left join m using (s)),
 z as (select sum(margin * n) filter (where label = 'allow') / sum(n) filter (where label = 'allow') a, sum(margin * n) filter (where label = 'block') / sum(n) filter (where label = 'block') b from f)
 select page_id, host, path, rule, coalesce(decided, case when coalesce(margin >= (a + b) / 2, true) then 'allow' else 'block' end) verdict from r join f using (s), z"""
