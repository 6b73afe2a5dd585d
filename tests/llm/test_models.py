"""The two trained models against plain refits over all rows at once."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import quality, urlfilter


def plain_quality(docs, labels, folds):
    """Scores by least squares over stacked rows, and isotonic regression by its min-max formula."""
    stats = {i: np.array(quality.statistics((t or "").encode())) for i, t in docs}
    known = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2 and i in stats]
    x, y = np.array([stats[i] for i, _ in known]), np.array([float(q) for _, q in known])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    r = np.random.default_rng(quality.SEED)
    w = r.normal(0, math.sqrt(2 * quality.GAMMA), (x.shape[1], quality.FOURIER))
    shift = r.uniform(0, 2 * np.pi, quality.FOURIER)

    def wide(rows):
        z = np.clip((rows - mean) / scale, -6, 6)
        return np.hstack([np.ones((len(z), 1)), z, math.sqrt(2 / quality.FOURIER) * np.cos(z @ w + shift)])

    def fitted(rows, goal):
        m = wide(rows)
        keep = np.sqrt(np.full(m.shape[1], quality.RIDGE * len(m)))
        keep[0] = 0
        return np.linalg.lstsq(np.vstack([m, np.diag(keep)]), np.concatenate([goal, np.zeros(m.shape[1])]), rcond=None)[0]

    fold = np.array([folds[i] for i, _ in known])
    raw = np.zeros(len(y))
    for k in range(quality.FOLDS):
        if (fold == k).any():
            raw[fold == k] = wide(x[fold == k]) @ fitted(x[fold != k], y[fold != k])
    bins = np.floor(np.clip(raw, -1, 2) * quality.BINS)
    groups = [bins == b for b in np.unique(bins)]
    at, n, good = (np.array(v) for v in zip(*[(raw[g].mean(), g.sum(), y[g].sum()) for g in groups], strict=True))
    mean_of = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
    chance = [max(min(mean_of(a, b) for b in range(i, len(at))) for a in range(i + 1)) for i in range(len(at))]
    ids = list(stats)
    return dict(zip(ids, np.clip(np.interp(wide(np.array([stats[i] for i in ids])) @ fitted(x, y), at, chance), 0, 1), strict=True))


def test_scores_are_those_of_a_plain_refit(spark, table, words):
    r = random.Random(2)
    docs = [(i, None if i == 7 else "" if i == 8 else " ".join(w.upper() + "!" * r.randint(0, 2) if r.random() < (0.6 if i % 4 == 0 else 0.1) else w for w in words(i, 10 + i % 70).split())) for i in range(300)]
    labels = [(i, int(i % 4 != 0) if r.random() < 0.95 else 0) for i in range(240)]
    got = {x.doc_id: x.score for x in quality.op3_quality_classifier(table(docs), spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    folds = {x.id: x.f for x in spark.range(300).select("id", F.pmod(F.xxhash64("id"), F.lit(quality.FOLDS)).alias("f")).collect()}
    want = plain_quality(docs, labels, folds)
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-5
    assert len({round(v, 3) for v in want.values()}) > 5


def plain_trees(rows, cuts):
    """Margins of boosted trees grown row by row. rows: (features, blocked); cuts: bin edges by feature."""
    n, bad = len(rows), sum(b for _, b in rows)
    weight = [n / (2 * bad) if b else n / (2 * (n - bad)) for _, b in rows]
    margins, unit = [0.0] * n, urlfilter.UNIT
    bins = [[sum(e < v for e in cuts[f]) for f, v in enumerate(x)] for x, _ in rows]
    for _ in range(urlfilter.TREES):
        half = lambda v: math.copysign(math.floor(abs(v) + 0.5), v)
        p = [1 / (1 + math.exp(-m)) for m in margins]
        g = [half((p[i] - rows[i][1]) * weight[i] * unit) for i in range(n)]
        h = [half(p[i] * (1 - p[i]) * weight[i] * unit) for i in range(n)]
        score = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + urlfilter.RIDGE * unit)
        nodes = [list(range(n))]
        for level in range(urlfilter.DEPTH + 1):
            after = []
            for part in nodes:
                best = None
                if level < urlfilter.DEPTH:
                    for f in range(len(cuts)):
                        for b in sorted({bins[i][f] for i in part})[:-1]:
                            left, right = [i for i in part if bins[i][f] <= b], [i for i in part if bins[i][f] > b]
                            gain = score(left) + score(right) - score(part)
                            if gain > 1e-6 * unit and (best is None or gain > best[0] * (1 + 1e-12)):
                                best = (gain, left, right)
                if best:
                    after += best[1:]
                else:
                    leaf = round(-urlfilter.RATE * sum(g[i] for i in part) / (sum(h[i] for i in part) + urlfilter.RIDGE * unit), 6)
                    for i in part:
                        margins[i] += leaf
            nodes = after
    return margins


def test_trees_are_those_grown_row_by_row(spark):
    r = random.Random(5)
    urls = [f"http{'s' * r.randint(0, 1)}://{r.choice(['a', 'bb', 'ccc-d', 'x9'])}{r.randint(0, 30)}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'fr', 'es'])}/{'p' * r.randint(0, 9)}{r.choice(['', '?q=1', '?a=1&b=22', '.html'])}" for _ in range(220)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rules = (("block", "net", "/es/"), ("block", "net", "/fr/"), ("block", "com", "/es/"), ("allow", "com", "/"), ("allow", "net", "/en/"))
    seen = urlfilter.lexical(urlfilter.match_rules(urlfilter.parse(pages), rules))
    labelled = seen.where("action is not null").withColumn("blocked", (F.col("action") == "block").cast("int"))
    full = urlfilter.train(labelled).with_suffix(labelled)
    cuts = full.agg(*[F.percentile_approx(f, [i / urlfilter.BINS for i in range(1, urlfilter.BINS)], 10_000).alias(f) for f in urlfilter.FEATURES]).first()
    edges = [[(a + b) / 2 for a, b in zip(v, v[1:], strict=False)] for v in (sorted({float(x) for x in cuts[f]}) for f in urlfilter.FEATURES)]
    rows = full.select("page_id", "blocked", "suffix", *urlfilter.FEATURES).collect()
    counts = {}
    for x in rows:
        n, b = counts.get(x.suffix, (0, 0))
        counts[x.suffix] = n + 1, b + x.blocked
    total, bad = len(rows), sum(x.blocked for x in rows)
    heavy, light = total / (2 * bad), total / (2 * (total - bad))
    for x in rows:
        n, b = counts[x.suffix]
        assert x.suffix_blocked == pytest.approx((heavy * b + 10) / (heavy * b + light * (n - b) + 20), abs=1e-6) and x.suffix_log == pytest.approx(math.log1p(n), abs=1e-6)
    want = plain_trees([([x[f] for f in urlfilter.FEATURES], x.blocked) for x in rows], edges)
    got = {x.page_id: x.block_score for x in urlfilter.filter_urls(pages, rules).collect()}
    assert max(abs(got[x.page_id] - 1 / (1 + math.exp(-m))) for x, m in zip(rows, want, strict=True)) < 1e-9
    assert len({round(m, 4) for m in want}) > 4
