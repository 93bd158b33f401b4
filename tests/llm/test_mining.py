import re
import zlib
from collections import Counter

import numpy as np
import pytest

from genoweave.llm import byte_gru, hard_negatives, registry, toivonen

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, phrase string, m int, n long"


def texts():
    r = np.random.default_rng(8)
    words = ["the", "of", "Aß", "x", "y,", "a;b", "é", "two\tthree", "end.\n", "A"]
    some = [" ".join(r.choice(words, int(r.integers(1, 60)))) for _ in range(40)]
    rare = ["zz qq zz qq zz qq"] * 12  # 36 and 24 occurrences: a sample may miss both
    return [*some, *rare, "", None, " \t ", ".,;", "the of " * 4000, "no-break-" * 3000]


def docs_rows():
    out = [(i, t, [None, "en", "de", "und"][i % 4], "s", 1, "p", 7, 9) for i, t in enumerate(texts())]
    return [*out, out[3], (None, "the of the of", "en", None, None, None, None, None)]


def brute_collocations(rows, least, size):
    f, total = {}, Counter()
    for row in rows:
        lang = row[2] or "und"
        low = re.sub("[A-Z]", lambda c: c[0].lower(), row[1] or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for m in range(1, 5):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] = f.get((lang, tuple(w[i : i + m])), 0) + 1
    often = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = {}
    for (lang, p), a in often.items():
        over = any(100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (other, q), b in often.items() if other == lang and len(q) > len(p))
        if not over:
            score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, x[2].decode(), -x[1], x[3], x[4], total[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:size]))


@pytest.mark.parametrize("rate", [0.0001, 0.2, 1.0])
def test_collocations_are_those_of_brute_force(spark, rate):
    docs = spark.createDataFrame(docs_rows(), DOCS).repartition(3)
    got = sorted(tuple(r) for r in toivonen.mine(docs, 40, 20, rate).collect())
    assert got == brute_collocations(docs_rows(), 20, 40)
    assert toivonen.mine(docs.limit(0)).count() == 0


def test_collocations_do_not_depend_on_chunks(spark, monkeypatch):
    import pyarrow as pa

    rows = docs_rows()
    column, langs = pa.array([r[1] for r in rows]), pa.array([r[2] or "und" for r in rows])

    def counts():
        found = Counter()
        for runs, names in toivonen.runs_of(column, langs):
            for m in range(1, 5):
                at = np.flatnonzero(runs.valid(m))
                found.update(zip([names[x] for x in runs.lang[at]], runs.phrases(at, m).to_pylist(), strict=True))
        return found

    whole = counts()
    monkeypatch.setattr(toivonen, "CHUNK", 37)
    assert counts() == whole


def test_huge_counts_stay_exact(spark):
    big = 4_000_000_000_000_000_000
    grams = spark.createDataFrame([("en", 0, "", big), ("en", 1, "a", big), ("en", 1, "b", big - 3), ("en", 2, "a b", big - 5)], "lang string, m int, phrase string, n long")
    (row,) = toivonen.top(toivonen.unabsorbed(toivonen.scored(grams)), 5).collect()
    assert row["score"] == 2_000_000 * (big - 5) // (big + big - 3)


VECTORS = "vec_id long, embedding array<float>, label int, q string, shard long, own int"


def vector_rows():
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.normal(0, 0.2, 6)], int(r.integers(0, 3))) for i in range(400)]
    rows += [(400 + i, [0.25, 0.5, -0.125, 0.0, 0.0, 0.25], i % 2) for i in range(90)]  # copies, one anchor among them
    rows += [(500, None, 1), (501, [0.1] * 6, None), (502, [float("nan")] * 6, 1), (503, [0.1, None, 0.2, 0.1, 0.1, 0.1], 1), (504, [float("inf")] * 6, 1), (None, [0.1] * 6, 1), (550, [0.5, 0.5], 2), (600, [], 1), rows[0], rows[50]]
    return [(*row, "x", 1, 2) for row in rows]


def brute_negatives(rows):
    seen = {}
    for i, v, label, *_ in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        q = [int(np.floor(256 * np.float64(np.float32(x)))) for x in v] + [0] * (6 - len(v))
        seen[i] = ((label + 1) % 10 if i % 7 == 0 else label, q)
    out = []
    for a, (own, q) in seen.items():
        if a % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(q, other, strict=True)), i, label) for i, (label, other) in seen.items() if i != a)
            for s, p, _ in [x for x in scores if x[2] == own][:5]:
                inside = [x for x in scores if x[2] != own and 50 * -s <= 100 * -x[0] <= 95 * -s]
                out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize("sizes", [(128, 4096, 1024), (4, 32, 3)])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, sizes):
    for name, value in zip(("LEAF", "SHARD", "ANCHORS"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = spark.createDataFrame(vector_rows(), VECTORS).repartition(3)
    # shard size is a default argument
    monkeypatch.setattr(hard_negatives.sharded, "__defaults__", (sizes[1],))
    assert sorted(tuple(r) for r in hard_negatives.mine(rows).collect()) == brute_negatives(vector_rows())
    assert hard_negatives.mine(rows.limit(0)).count() == 0


def test_search_prunes_boxes_and_keeps_ties():
    r = np.random.default_rng(1)
    x = np.round(np.vstack([r.normal(c, 3, (300, 3)) for c in (-200, 0, 200)]))
    tree = hard_negatives.Tree(x)
    ids = tree.order
    q = np.array([[1.0, 2.0, -1.0], [0.0, 0.0, 0.0]])
    least, most = tree.bounds(q)
    for i in (0, 1):
        exact = sorted((-int(s), int(j)) for j, s in enumerate(x @ q[i]))
        found = hard_negatives.search(tree, (least[i], most[i]), q[i], ids, np.ones(len(x), bool), [(-np.inf, np.inf), (-50, 40)], 4)
        assert found[0] == exact[:4]
        assert found[1] == [e for e in exact if -50 <= -e[0] <= 40][:4]
    opened = []
    tree.blocks = [type("Block", (), {"__matmul__": lambda self, v, b=b: (opened.append(1), b @ v)[1]})() for b in tree.blocks]
    hard_negatives.search(tree, (least[0], most[0]), q[0], ids, np.ones(len(x), bool), [(-np.inf, np.inf)], 2)
    assert len(opened) < len(tree.leaves) / 2


def test_scores_beyond_doubles_are_exact():
    x, q = hard_negatives.comparable(np.array([[2.0**40, 1.0], [2.0**40, 0.0]]), np.array([[2.0**20, 1.0]]))
    tree = hard_negatives.Tree(x)
    least, most = tree.bounds(q)
    (best,) = hard_negatives.search(tree, (least[0], most[0]), q[0], tree.order, np.ones(2, bool), [(-np.inf, np.inf)], 2)
    assert best == [(-(2**60) - 1, 0), (-(2**60), 1)]


def test_gradients_match_differences():
    r = np.random.default_rng(2)
    raw = r.integers(97, 123, 60).astype(np.uint8)
    start, length, target = np.array([0, 20, 40, 52]), np.array([20, 13, 7, 1]), np.array([0, 1, 2, 1])
    net = byte_gru.Network(["a", "b", "c"], 3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    both = byte_gru.directions(raw, start, length)
    _, grad = net.gradients(both, length, target)
    for name, g in grad.items():
        for spot in [np.unravel_index(i, g.shape) for i in np.argsort(-np.abs(g).ravel())[:3]]:
            kept = net.w[name][spot]
            up, down = ((net.w[name].__setitem__(spot, kept + e), net.gradients(both, length, target)[0])[1] for e in (1e-4, -1e-4))
            net.w[name][spot] = kept
            assert abs((up - down) / 2e-4 - g[spot]) < 1e-4 * max(1, abs(g[spot]))


def test_labels_of_blocks_are_a_plain_recurrence():
    r = np.random.default_rng(6)
    net = byte_gru.Network(["a", "b"], 4)
    texts = [b"", b"q", r.integers(0, 256, 300).astype(np.uint8).tobytes(), b"abc" * 50]
    raw = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0] + [len(t) for t in texts])
    got = byte_gru.probabilities(net, raw, offsets)

    def sweep(block, d):
        h, out, n = np.zeros(4), [], 4
        for byte in block:
            x, u = net.w["x"][d, byte].astype(float), net.w["h"][d].astype(float) @ h
            z, g = (1 / (1 + np.exp(-(x[a : a + n] + u[a : a + n]))) for a in (0, n))
            c = np.tanh(x[2 * n :] + g * (u[2 * n :] + net.w["c"][d][:, 0]))
            h = z * h + (1 - z) * c
            out.append(net.w["o"][d] @ h)
        return out

    for t, p in zip(texts, got, strict=True):
        total = np.zeros(2)
        for at in range(0, len(t), byte_gru.BLOCK):
            block = t[at : at + byte_gru.BLOCK]
            for a, b in zip(sweep(block, 0), sweep(block[::-1], 1)[::-1], strict=True):
                e = np.exp(a + b + net.w["b"][:, 0])
                total += e / e.sum()
        assert np.allclose(p, total / max(len(t), 1), atol=1e-4)


def test_languages_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    got = registry.op13_byte_gru(spark, SMALL).collect()
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.9


def test_language_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, lettered boolean"
    rows = [(1, None, "en", "s", 0, True), (2, "", "en", None, 0, None), (3, "12 + 3 !", "fr", "s", 1, False), (4, "the and of " * 3000, "en", "s", 1, True), (5, "le et de la", "fr", "s", 1, True), (None, "the", None, None, None, None), (5, "le et de la", "fr", "s", 1, True), (6, "日本", "en", "s", 1, True)]
    got = byte_gru.identify(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all((by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0) for i in (1, 2, 3))
    assert all(by[i]["lang_pred"] in ("en", "fr") for i in (4, 5, 6, None)) and not by[None]["held_out"]
    nobody = byte_gru.identify(spark.createDataFrame([(9, "abc", None, None, None, None)], schema)).collect()
    assert (nobody[0]["lang_pred"], nobody[0]["score"]) == ("und", 0.0)
    assert byte_gru.identify(spark.createDataFrame([], schema)).count() == 0


def test_few_labels_among_many_documents_are_all_used(spark):
    from genoweave.llm import pu_quality

    r = np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    text_of = lambda good: " ".join(r.choice(words, 60)) + "." if good else "".join(r.choice(list("#*$|<>0123456789 "), 200))
    rows = [(i, text_of(i % 2 == 0)) for i in range(3000)]
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(40)], "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = pu_quality.score(docs, pu_quality.train(docs, labels, sample=300)).collect()
    assert np.mean([(x["score"] >= 0.5) == (x["doc_id"] % 2 == 0) for x in got]) > 0.95
    again = pu_quality.score(docs.repartition(5), pu_quality.train(docs.repartition(7), labels, sample=300)).collect()
    other = {x["doc_id"]: x["score"] for x in again}
    assert all(abs(x["score"] - other[x["doc_id"]]) < 1e-5 for x in got)
    only_good = labels.filter("quality = 1")
    network = pu_quality.train(docs, only_good, sample=300)
    assert np.mean([(x["score"] >= 0.5) == (x["doc_id"] % 2 == 0) for x in pu_quality.score(docs, network).collect()]) > 0.8
