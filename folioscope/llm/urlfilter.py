"""URL filter: rule lists first, gradient-boosted trees on lexical features for the rest. DataFrame and SQL functions only.

Method. A url's host and path are cut out with string functions; the longest fitting rule decides. Urls that a rule
decides are the labelled ones; a hash-chosen sample of about TRAIN_ROWS of them (all, if fewer) trains the trees. Every
feature is cut into bins at sample quantiles. Level by level, one aggregate sums whole-number gradients and curvatures by
node, feature and bin; the driver sees only these sums, picks each node's split and writes the tree as a CASE expression,
which scores all urls in one projection. Sums are exact, so the trees don't depend on how rows are dealt.

Features: lengths of url, host, path and query, depth, host labels, longest label, hyphens, share of digits in url and
host, entropy of url and host, parameters, scheme, file suffix, and of the host's last label its share of blocked urls among
all labelled ones (smoothed towards one half) and its frequency there. These statistics are a table with a row a suffix,
joined to the urls. Blocked and allowed urls weigh the same in total, so that the rules' preference decides nothing where
the features say nothing.

Defined results. A null url, or one without `://`, has an empty host and path and no rule; the trees judge it as the
text it is. An empty path fits no rule, since rules' paths begin with a slash. Without any labelled url, or with labels
of one kind only, the method allows, or repeats that kind. Repeated rows get equal verdicts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, settle

#: (action, host, path): fixed by the contract of op7.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS, BINS, TREES, DEPTH, RATE, RIDGE, UNIT = 8192, 16, 8, 3, 0.4, 1.0, 1_000_000
#: Files of the sample's tables.
FILES = 4

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "labels", "longest_label", "hyphens", "digit_share", "host_digit_share", "entropy", "host_entropy",
    "parameters", "secure", "file_suffix", "suffix_blocked", "suffix_log",
)


def parse(pages: DataFrame) -> DataFrame:
    """pages with _rest, host and path."""
    url = F.coalesce("url", F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), locate('://', coalesce(url, '')) + 3)")).otherwise("")
    cut = lambda c, marks: c if not marks else F.substring_index(cut(c, marks[1:]), marks[0], 1)
    raw = cut(F.col("_rest"), "/?#")
    out = pages.withColumn("_rest", rest).withColumn("_host", raw)
    out = out.withColumn("path", cut(F.expr("substring(_rest, length(_host) + 1)"), "?#"))
    return out.withColumn("host", F.translate("_host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).drop("_host")


def match_rules(parsed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """parsed with rule (host and path of the longest fitting rule, else null) and action."""
    ranked = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in reversed(ranked):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, action = F.when(fits, host + path).otherwise(rule), F.when(fits, kind).otherwise(action)
    return parsed.withColumn("rule", rule).withColumn("action", action)


def _entropy(text: Column) -> Column:
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


def _digits(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, (n - F.length(F.translate(text, "0123456789", ""))) / n).otherwise(0.0)


def lexical(parsed: DataFrame) -> DataFrame:
    """parsed with the features that need no label, and suffix, the host's last label."""
    url, query = F.coalesce("url", F.lit("")), F.expr("substring(_rest, length(host) + length(path) + 1)")
    query = F.when(query.startswith("?"), F.substring_index(query, "#", 1)).otherwise("")
    labels = F.split("host", r"\.")
    values = {
        "url_length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "query_length": F.length(query),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")), "labels": F.size(labels), "longest_label": F.array_max(F.transform(labels, F.length)),
        "hyphens": F.length("host") - F.length(F.replace(F.col("host"), F.lit("-"), F.lit(""))), "digit_share": _digits(url), "host_digit_share": _digits(F.col("host")),
        "entropy": _entropy(url), "host_entropy": _entropy(F.col("host")), "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "secure": url.startswith("https://").cast("int"), "file_suffix": F.col("path").rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
    }
    return parsed.select("*", *[v.cast("double").alias(k) for k, v in values.items()], F.substring_index("host", ".", -1).alias("suffix"))


@dataclass
class Forest:
    base: float
    trees: list[str]
    suffixes: DataFrame  # suffix, suffix_blocked, suffix_log

    def with_suffix(self, df: DataFrame) -> DataFrame:
        """df with the statistics of its suffixes; one that no labelled url has is half blocked and never seen."""
        return df.join(self.suffixes, "suffix", "left").fillna({"suffix_blocked": 0.5, "suffix_log": 0.0})

    def margin(self) -> Column:
        return F.expr(" + ".join([f"{self.base!r}D", *self.trees]))


def _pick(sums: dict, node: int) -> tuple[float, int, int] | None:
    """The best (gain, feature, bin) of a node: rows with a bin up to it go left."""
    best = None
    for f in sorted({k[1] for k in sums if k[0] == node}):
        cells = sorted((b, v) for (n, g, b), v in sums.items() if n == node and g == f)
        total_g, total_h = sum(v[0] for _, v in cells), sum(v[1] for _, v in cells)
        score = lambda g, h: g * g / (h + RIDGE * UNIT)
        left_g = left_h = left_n = 0
        for b, (g, h, n) in cells[:-1]:
            left_g, left_h, left_n = left_g + g, left_h + h, left_n + n
            gain = score(left_g, left_h) + score(total_g - left_g, total_h - left_h) - score(total_g, total_h)
            if gain > 1e-6 * UNIT and (best is None or gain > best[0]):
                best = (gain, f, b)
    return best


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Forest:
    """Trees from labelled: the columns of lexical() and blocked (0 or 1)."""
    counts = settle(labelled.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b")), "suffixes")
    total, bad = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    both = 0 < bad < total
    heavy, light = (total / (2 * bad), total / (2 * (total - bad))) if both else (1.0, 1.0)  # both kinds count the same
    blocked = (heavy * F.col("b") + 10) / (heavy * F.col("b") + light * (F.col("n") - F.col("b")) + 20)
    suffixes = counts.select("suffix", F.round(blocked, 6).alias("suffix_blocked"), F.round(F.log1p("n"), 6).alias("suffix_log"))
    forest = Forest(0.0 if both else 4.0 if total and bad else -4.0, [], suffixes)
    if both:
        share = min(1.0, rows / total)
        some = labelled.where(F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
        full = settle(forest.with_suffix(some.select(*FEATURES[:-2], "suffix", "blocked")).select(*FEATURES, "blocked").coalesce(FILES), "urls")
        cuts = full.agg(*[F.percentile_approx(f, [i / BINS for i in range(1, BINS)], 10_000).alias(f) for f in FEATURES]).first()
        if cuts[FEATURES[0]] is None:  # a sample of a few rows can be empty
            return forest
        seen = [sorted({float(x) for x in cuts[f]}) for f in FEATURES]
        edges = [[(a + b) / 2 for a, b in pairwise(v)] for v in seen]  # half-way, so that values in between go to the nearer side
        below = lambda f, cuts: F.size(F.filter(F.array(*[F.lit(e) for e in cuts]), lambda e: e < F.col(f)))
        bins = F.array(*[below(f, edges[i]) for i, f in enumerate(FEATURES)])
        weight = F.when(F.col("blocked") == 1, heavy).otherwise(light)
        data = settle(full.select(*FEATURES, "blocked", weight.alias("weight"), bins.alias("bins")), "urls")
        for _ in range(TREES):
            forest.trees.append(_tree(data, forest, edges))
        discard(data)
        discard(full)
    return forest


def _tree(data: DataFrame, forest: Forest, edges: list[list[float]]) -> str:
    """One more tree, as SQL."""
    p = 1 / (1 + F.exp(-forest.margin()))
    splits: dict[int, tuple[int, int]] = {}  # node -> feature, bin; children of i are 2i and 2i + 1
    leaves: dict[int, float] = {}
    open_ = [1]
    for level in range(DEPTH + 1):
        node = _walk(1, splits, lambda i: str(i), edges)
        rows = data.select(F.expr(node).alias("node"), "bins", p.alias("p"), "blocked", "weight").where(F.col("node").isin(open_))
        g, h = F.round((F.col("p") - F.col("blocked")) * F.col("weight") * UNIT).cast("long"), F.round(F.col("p") * (1 - F.col("p")) * F.col("weight") * UNIT).cast("long")
        cells = rows.select("node", g.alias("g"), h.alias("h"), F.posexplode("bins").alias("f", "b")).groupBy("node", "f", "b").agg(F.sum("g"), F.sum("h"), F.count(F.lit(1)))
        sums = {(r[0], r[1], r[2]): (r[3], r[4], r[5]) for r in cells.collect()}
        after = []
        for i in open_:
            g0 = [v for k, v in sums.items() if k[0] == i and k[1] == 0]
            total_g, total_h = sum(v[0] for v in g0), sum(v[1] for v in g0)
            leaves[i] = round(-RATE * total_g / (total_h + RIDGE * UNIT), 6)
            best = _pick(sums, i) if level < DEPTH else None
            if best and best[2] < len(edges[best[1]]):
                splits[i] = best[1:]
                after += [2 * i, 2 * i + 1]
        open_ = after
        if not open_:
            break
    return _walk(1, splits, lambda i: f"{leaves.get(i, 0.0)!r}D", edges)


def _walk(i: int, splits: dict, leaf, edges: list[list[float]]) -> str:
    if i not in splits:
        return leaf(i)
    f, b = splits[i]
    return f"(CASE WHEN {FEATURES[f]} <= {edges[f][b]!r}D THEN {_walk(2 * i, splits, leaf, edges)} ELSE {_walk(2 * i + 1, splits, leaf, edges)} END)"


def filter_urls(pages: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, url, host, path, rule, verdict and block_score (the trees' probability) for every row of pages."""
    seen = lexical(match_rules(parse(pages.select("page_id", "url")), rules))
    labelled = seen.where("action is not null").withColumn("blocked", (F.col("action") == "block").cast("int"))
    forest = train(labelled, rows)
    scored = forest.with_suffix(seen).withColumn("block_score", 1 / (1 + F.exp(-forest.margin())))
    verdict = F.coalesce("action", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "url", "host", "path", "rule", verdict.alias("verdict"), "block_score")


def op7_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
