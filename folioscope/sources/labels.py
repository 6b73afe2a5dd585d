"""Seal crops and their labels as tables: crops with a manifest, label exports merged, training rows, sheets, models, predictions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import image

#: Crops on one sheet for people who label.
SHEET = 300
MANIFEST = "id string, file string, doc_id string, page_no int, bbox array<int>, angle double, fill_ratio double, rectangularity double"
SYNTHETIC = "file string, label string, source string, synthetic boolean"
PREDICTED = "findings array<struct<doc_id:string,page_no:int,rule_id:string,level:string,title:string,clause:string,message:string,bbox:array<int>,evidence:string,confidence:double>>"


def read_predictions(spark: SparkSession, *paths: str) -> DataFrame:
    """The findings of reports in JSON."""
    return spark.read.schema(PREDICTED).option("multiLine", True).json(list(paths)).select(F.explode("findings").alias("f")).select("f.*")


def seal_crops(images: DataFrame, measured: DataFrame, pad: float = 0.15, frames: bool = False) -> DataFrame:
    """id, doc_id, page_no, seal_no, bbox, angle, fill_ratio, rectangularity, height, width, data (BGR): the seals of image.measured() cut out with a margin; measured has origin, doc_id, page_no, seals. Frames only if asked for, and none under 12 pixels."""
    keep = F.expr(f"filter(seals, s -> {'true' if frames else f's.fill >= {image.FRAME_FILL}D'})")
    both = images.select("origin", "height", "width", "nChannels", "data").join(measured.select("origin", "doc_id", "page_no", keep.alias("seals")), "origin")

    def cut(batches):
        for batch in batches:
            for r in batch.to_pylist():
                img = image.pixels(r["height"], r["width"], r["nChannels"], r["data"])
                out = []
                for s in r["seals"] or () if img is not None else ():
                    window = image.crop_window((s["x"], s["y"], s["w"], s["h"]), r["height"], r["width"], pad)
                    if window:
                        x1, y1, x2, y2 = window
                        out.append({**{k: r[k] for k in ("doc_id", "page_no")}, "seal_no": s["seal_no"], "bbox": [s[k] for k in "xywh"], "angle": s["angle"], "fill_ratio": s["fill"], "rectangularity": s["rect"], "height": y2 - y1, "width": x2 - x1, "data": img[y1:y2, x1:x2].tobytes()})
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([("doc_id", pa.string()), ("page_no", pa.int32()), ("seal_no", pa.int32()), ("bbox", pa.list_(pa.int32())), *((c, pa.float64()) for c in ("angle", "fill_ratio", "rectangularity")), ("height", pa.int32()), ("width", pa.int32()), ("data", pa.binary())])
    crops = both.mapInArrow(cut, "doc_id string, page_no int, seal_no int, bbox array<int>, angle double, fill_ratio double, rectangularity double, height int, width int, data binary")
    return crops.select(F.format_string("%s_p%04d_%02d", F.regexp_replace("doc_id", "[^A-Za-z0-9_-]+", "_"), "page_no", "seal_no").alias("id"), "*")


def unwritten(manifest: DataFrame, written: DataFrame) -> DataFrame:
    """Manifest rows whose crop isn't among the written ones."""
    return manifest.join(written.select("id").distinct(), "id", "left_anti")


def sheets(crops: DataFrame, *order: str) -> DataFrame:
    """crops with sheet (from 0) within their document, SHEET crops each."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return crops.withColumn("sheet", ((place - 1) / SHEET).cast("int"))


def read_labels(spark: SparkSession, paths: list[str]) -> DataFrame:
    """id, label of label exports; later files win, in the order of their names. An export is a map, or has one as `labels`."""
    text = spark.read.option("wholetext", True).text(paths).select("value", F.col("_metadata.file_name").alias("file"))
    kind = "map<string,string>"
    labels = F.coalesce(F.from_json(F.get_json_object("value", "$.labels"), kind), F.from_json("value", kind))
    rows = text.select("file", F.explode(labels).alias("id", "label"))
    return rows.groupBy("id").agg(F.max_by("label", "file").alias("label"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).option("multiLine", True).json(path)


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SYNTHETIC).option("multiLine", True).json(path)


def training_rows(manifest: DataFrame, labels: DataFrame, synthetic: DataFrame | None = None, known: tuple[str, ...] = ("ok", "chipped", "blurred", "faint", "upside_down")) -> DataFrame:
    """file, label, group, synthetic, human: human labels first, so that a file and label that both have count once, as human."""
    human = manifest.join(labels, "id").where(F.col("label").isin(*known)).select("file", "label", F.col("id").alias("group"), F.lit(False).alias("synthetic"), F.lit(True).alias("human"))
    if synthetic is not None:
        human = human.unionByName(synthetic.select("file", "label", F.col("source").alias("group"), "synthetic", F.lit(False).alias("human")))
    first = human.groupBy("file", "label").agg(F.max_by(F.struct("group", "synthetic", "human"), F.struct("human", "group")).alias("r"))
    return first.select("file", "label", "r.*")


def write_linear(spark: SparkSession, path: str, *, mean: list[float], scale: list[float], coef: list[list[float]], intercept: list[float], classes: list[str]) -> None:
    """A linear model as one row of arrays."""
    numbers = lambda xs: [float(x) for x in xs]
    row = (numbers(mean), numbers(scale), [numbers(c) for c in coef], numbers(intercept), [str(x) for x in classes])
    spark.createDataFrame([row], "mean array<double>, scale array<double>, coef array<array<double>>, intercept array<double>, classes array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def linear_predictions(rows: DataFrame, model: DataFrame, features: Column) -> DataFrame:
    """rows with label and p of the likeliest class: softmax over scaled features. model: one row of write_linear()."""
    z = F.zip_with(F.zip_with(features, "mean", lambda x, m: x - m), "scale", lambda x, s: x / s)
    dot = lambda w: F.aggregate(F.zip_with(w, "z", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    wide = rows.join(F.broadcast(model)).withColumn("z", z)  # one row
    scores = wide.withColumn("s", F.zip_with(F.transform("coef", dot), "intercept", lambda a, b: a + b)).withColumn("top", F.array_max("s"))
    total = F.aggregate(F.transform("s", lambda x: F.exp(x - F.col("top"))), F.lit(0.0), lambda a, x: a + x)
    label = F.element_at("classes", F.array_position("s", F.col("top")).cast("int"))
    return scores.select(*rows.columns, label.alias("label"), (1 / total).alias("p"))


#: Labelers that are no people (synthetic, rough geometry).
AUTO_LABELERS = ("合成", "几何粗筛")


def human_labels(samples: DataFrame, labels: DataFrame, automatic: tuple[str, ...] = AUTO_LABELERS) -> DataFrame:
    """One row, n: labels of real samples by people. samples: sample_id, synthetic; labels: sample_id, labeler."""
    real = samples.where(~F.col("synthetic")).select("sample_id")
    people = labels.where(~F.coalesce(F.col("labeler"), F.lit("")).isin(*automatic))
    return people.join(real, "sample_id", "left_semi").agg(F.count(F.lit(1)).alias("n"))
