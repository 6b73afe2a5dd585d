"""Drawn forms: page images with a ruled table, lines of text, a stamp and faults put in on purpose, each page from a row.

A page depends on its doc_id, page_no and the seed alone, so any page can be drawn again on any executor. Text is drawn as
small blocks in place of letters; what it says stands in the manifest, as do the stamp and the faults:

    tilted      the stamp leans by 15 to 40 degrees                  B01
    unstamped   there is no red on the page                          B08
    struck      four or five lines of text are struck out            B06
    blue        a remark in blue ink                                 B10
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEIGHT, WIDTH = 700, 500
#: Fault -> the rule that must find it.
FAULTS = {"tilted": "B01", "unstamped": "B08", "struck": "B06", "blue": "B10"}
RED, BLUE = (40, 40, 210), (200, 70, 20)
LINE = "struct<line_no:int,text:string,x:int,y:int,w:int,h:int>"
OUT = f"doc_id string, page_no int, origin string, height int, width int, nChannels int, data binary, lines array<{LINE}>, stamp struct<x:int,y:int,angle:double>, faults array<string>"


def draw(doc_id: str, page_no: int, seed: int, share: float) -> tuple[np.ndarray, list[dict], dict | None, list[str]]:
    """(image as BGR, lines, stamp, faults); each fault comes with probability share."""
    r = np.random.default_rng([seed, zlib.crc32(f"{doc_id}|{page_no}".encode())])
    faults = [f for f in FAULTS if r.random() < share]
    if "unstamped" in faults and "tilted" in faults:
        faults.remove("tilted")
    img = np.full((HEIGHT, WIDTH, 3), 255, np.uint8)
    for y in range(380, 621, 60):
        img[y : y + 2, 40:462] = 0
    for x in range(40, 461, 140):
        img[380:622, x : x + 2] = 0
    lines = []
    for k in range(5):
        x, y, letters = int(r.integers(40, 80)), 60 + 50 * k, int(r.integers(10, 16))
        for i in range(letters):
            img[y + int(r.integers(0, 3)) : y + 12, x + 8 * i : x + 8 * i + 5] = 30
        lines.append({"line_no": k + 1, "text": f"项目 {k + 1}", "x": x, "y": y, "w": 8 * letters - 3, "h": 12})
    if "struck" in faults:
        for line in lines[: int(r.integers(4, 6))]:
            img[line["y"] + 5 : line["y"] + 7, line["x"] : line["x"] + line["w"]] = 0
    if "blue" in faults:
        img[330:336, 60:140] = BLUE
    stamp = None
    if "unstamped" not in faults:
        angle = float(r.uniform(15, 40) * r.choice([-1, 1])) if "tilted" in faults else float(r.uniform(-3, 3))
        stamp = {"x": int(r.integers(300, 400)), "y": int(r.integers(120, 280)), "angle": angle}
        yy, xx = np.mgrid[0:HEIGHT, 0:WIDTH]
        t, dx, dy = np.deg2rad(angle), xx - stamp["x"], yy - stamp["y"]
        img[(np.abs(dx * np.cos(t) + dy * np.sin(t)) <= 45) & (np.abs(dy * np.cos(t) - dx * np.sin(t)) <= 30)] = RED
    return img, lines, stamp, faults


def forms(rows: DataFrame, *, seed: int = 0, share: float = 0.2) -> DataFrame:
    """A drawn page for each row (doc_id, page_no): the image, its lines, its stamp's centre and angle, and its faults."""

    def render(batches):
        for batch in batches:
            for key in batch.to_pylist():  # a page at a time
                img, lines, stamp, faults = draw(key["doc_id"], key["page_no"], seed, share)
                page = {"doc_id": key["doc_id"], "page_no": key["page_no"], "origin": f"{key['doc_id']}/{key['page_no']}", "height": HEIGHT, "width": WIDTH, "nChannels": 3, "data": img.tobytes(), "lines": lines, "stamp": stamp, "faults": faults}
                yield pa.RecordBatch.from_pylist([page], schema=_SCHEMA)

    return rows.select(F.col("doc_id").cast("string"), F.col("page_no").cast("int")).mapInArrow(render, OUT)


_LINE = pa.struct([("line_no", pa.int32()), ("text", pa.string()), *((c, pa.int32()) for c in "xywh")])
_SCHEMA = pa.schema([
    ("doc_id", pa.string()), ("page_no", pa.int32()), ("origin", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("nChannels", pa.int32()), ("data", pa.binary()),
    ("lines", pa.list_(_LINE)), ("stamp", pa.struct([("x", pa.int32()), ("y", pa.int32()), ("angle", pa.float64())])), ("faults", pa.list_(pa.string())),
])


def manifest(drawn: DataFrame) -> DataFrame:
    """doc_id, page_no, fault, rule_id: what the rules must find."""
    rule = F.element_at(F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair]), F.col("fault"))
    return drawn.select("doc_id", "page_no", F.explode("faults").alias("fault")).withColumn("rule_id", rule)


def write_manifest(drawn: DataFrame, path: str) -> None:
    """The manifest as tab-separated values with a header."""
    manifest(drawn).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
