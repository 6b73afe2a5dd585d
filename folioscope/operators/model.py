"""Linear models over array columns: class scores, softmax, confusion, and the seal-state rules that read them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def centroids(vectors: DataFrame) -> list[tuple[int, list[float], float]]:
    """(class, weights, intercept) of a nearest-centroid classifier written as a linear one; a row a class reaches the driver."""
    v = vectors.where("embedding IS NOT NULL AND label IS NOT NULL").select("label", F.posexplode("embedding").alias("i", "x"))
    means = v.groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    rows = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("ms")).orderBy("label").collect()
    out = []
    for r in rows:
        w = [x["m"] for x in r["ms"]]
        out.append((r["label"], w, -sum(x * x for x in w) / 2))
    return out


def predicted(weights: list[tuple[int, list[float], float]], vectors: DataFrame) -> DataFrame:
    """vec_id, predicted, p: the class of the largest score (the smaller class at ties) and its softmax probability."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in w]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    scores = F.array(*[F.struct((dot(w) + F.lit(float(b))).alias("s"), F.lit(-k).alias("k")) for k, w, b in weights])
    best = vectors.where("embedding IS NOT NULL").select("vec_id", scores.alias("scores")).withColumn("best", F.array_max(F.transform("scores", lambda e: F.struct(F.round(e["s"], 9).alias("s"), e["k"].alias("k")))))
    total = F.aggregate("scores", F.lit(0.0), lambda a, e: a + F.exp(e["s"] - F.col("best.s")))
    return best.select("vec_id", (-F.col("best.k")).alias("predicted"), F.round(1 / total, 6).alias("p"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.col("label").alias("truth"), "predicted").agg(F.count(F.lit(1)).alias("n"))


def seal_findings(states: DataFrame, params: dict, page: str, number: str) -> DataFrame:
    """Seals in a state that a rule rejects, sure enough, at most max_per_page a page; place counts them."""
    bad = states.where(F.col("state").isin(*params["reject_labels"]) & (F.col("p") >= params["min_confidence"]))
    place = F.row_number().over(Window.partitionBy(page).orderBy(number))
    return bad.withColumn("place", place).where(F.col("place") <= params["max_per_page"])


SOFTMAX_SQL = """
WITH x AS (SELECT vec_id, label, unnest(range(1, len(embedding) + 1)) AS i, unnest(embedding) AS v FROM embeddings),
w AS (SELECT label AS k, i, round(avg(CAST(v AS DOUBLE)), 6) AS m FROM x WHERE label IS NOT NULL GROUP BY ALL),
b AS (SELECT k, -sum(m * m) / 2 AS b FROM w GROUP BY k),
s AS (SELECT x.vec_id, w.k, round(sum(CAST(x.v AS DOUBLE) * w.m) + any_value(b.b), 9) AS s FROM x JOIN w USING (i) JOIN b ON b.k = w.k GROUP BY x.vec_id, w.k),
t AS (SELECT vec_id, max(s) AS top, arg_max(k, (s, -k)) AS predicted FROM s GROUP BY vec_id)
SELECT t.vec_id, CAST(any_value(t.predicted) AS INT) AS predicted, round(1 / sum(exp(s.s - t.top)), 6) AS p FROM t JOIN s USING (vec_id) GROUP BY t.vec_id
"""


def folds_of(group: str, k: int = 5):
    """Fold of a row: rows of one group stay together."""
    return F.pmod(F.xxhash64(F.col(group)), F.lit(k)).cast("int")


def cross_validated(rows: DataFrame, group: str, k: int = 5, max_iter: int = 50) -> DataFrame:
    """fold, n, accuracy of logistic regressions on scaled features, each judged on the groups that it didn't see. rows: features (array), label, and the group."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector

    data = rows.select(array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("raw"), F.col("label").cast("double").alias("label"), folds_of(group, k).alias("fold"))
    steps = Pipeline(stages=[StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(maxIter=max_iter)])
    out = None
    for fold in range(k):
        model = steps.fit(data.where(F.col("fold") != fold))
        judged = model.transform(data.where(F.col("fold") == fold)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
        out = judged if out is None else out.union(judged)
    return out


def usable_folds(rows: DataFrame, group: str, most: int = 5) -> int:
    """As many folds as the rarest class has groups, at most `most`; 1 if that is no cross-validation."""
    fewest = rows.groupBy("label").agg(F.countDistinct(group).alias("g")).agg(F.min("g")).first()[0] or 0
    return max(1, min(most, int(fewest)))
