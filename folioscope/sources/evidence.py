"""Evidence: crops of pages with the finding's box drawn, as PNG, and a report for each archive as one HTML page.

A report shows an archive's worst findings with their crops, up to a number that the caller sets, and says how many more
there are; the full list is the ledger. Pages are decoded once each, on executors, and only crops leave their task. A
crop is the box with a margin of half its width (70 pixels at least) and its height (50 at least), MAX_WIDTH wide at most;
without a box, or where the whole page is asked for, it is the page.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import findings as f
from ..operators import image, ranges

#: Least margins of a crop, its width at most, and the widths of the drawn box in crops and pages.
MARGIN, MAX_WIDTH, FRAME, PAGE_FRAME = (70, 50), 900, 3, 4
#: Names of levels and verdicts for readers, by language.
LABELS = {
    "zh": {"CRITICAL": "严重", "HIGH": "较重", "MEDIUM": "一般", "LOW": "提示", "true": "判真", "false": "判假", "unsure": "存疑"},
    "en": {"CRITICAL": "critical", "HIGH": "high", "MEDIUM": "medium", "LOW": "low", "true": "confirmed", "false": "rejected", "unsure": "unsure"},
}


def label(value: str, language: str = "en") -> str:
    """SQL for the name of a level or a verdict; what has no name stays."""
    pairs = ", ".join(f"{t.quoted(k)}, {t.quoted(v)}" for k, v in LABELS[language].items())
    return f"coalesce(element_at(map({pairs}), {value}), {value})"


def png(img: np.ndarray) -> bytes:
    """An image (BGR) as PNG: eight bits a channel, rows without a filter."""
    h, w = img.shape[:2]
    rows = np.zeros((h, 1 + w * 3), dtype=np.uint8)
    rows[:, 1:] = img[:, :, ::-1].reshape(h, w * 3)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def framed(img: np.ndarray, x: int, y: int, w: int, h: int, thick: int) -> np.ndarray:
    """A copy with a red frame about a box, half of it outside."""
    out, half = img.copy(), thick // 2
    top, left, low, right = y - half, x - half, y + h + thick - half, x + w + thick - half
    for a, b, c, d in ((top, top + thick, left, right), (low - thick, low, left, right), (top, low, left, left + thick), (top, low, right - thick, right)):
        out[max(0, a) : max(0, b), max(0, c) : max(0, d)] = (0, 0, 255)
    return out


def crop(img: np.ndarray, box: tuple[int, int, int, int] | None, *, full: bool = False, max_width: int = MAX_WIDTH) -> np.ndarray:
    """What a finding's reader is shown."""
    h, w = img.shape[:2]
    if box is None:
        shown = img
    elif full:
        shown = framed(img, *box, PAGE_FRAME)
    else:
        x, y, bw, bh = box
        mx, my = max(MARGIN[0], bw // 2), max(MARGIN[1], bh)
        x1, y1, x2, y2 = max(0, x - mx), max(0, y - my), min(w, x + bw + mx), min(h, y + bh + my)
        if x2 <= x1 or y2 <= y1:  # a box outside the page
            return crop(img, None, max_width=max_width)
        shown = framed(img[y1:y2, x1:x2], x - x1, y - y1, bw, bh, FRAME)
    wide = shown.shape[1]
    return shown if wide <= max_width else np.round(image.resized(shown, max(1, round(shown.shape[0] * max_width / wide)), max_width)).clip(0, 255).astype(np.uint8)


def crops(findings: DataFrame, images: DataFrame, *, full: bool = False) -> DataFrame:
    """doc_id, page_no, at, png of findings (doc_id, page_no, at, box): images has doc_id, page_no, height, width, nChannels, data. Null where the page can't be read."""
    wanted = findings.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("at", "box")).alias("wanted"))
    pages = images.select("doc_id", "page_no", "height", "width", "nChannels", "data").join(wanted, ["doc_id", "page_no"])

    def draw(batches):
        for batch in batches:
            for k in range(batch.num_rows):  # a page at a time
                r = batch.slice(k, 1).to_pylist()[0]
                img = image.pixels(r["height"], r["width"], r["nChannels"], r["data"])
                boxes = [x["box"] and tuple(x["box"][c] for c in "xywh") for x in r["wanted"]]
                drawn = [None if img is None else png(crop(img, box, full=full)) for box in boxes]
                n = len(drawn)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([k] * n)), batch.column("page_no").take(pa.array([k] * n)), pa.array([x["at"] for x in r["wanted"]], pa.int32()), pa.array(drawn, pa.binary())], names=["doc_id", "page_no", "at", "png"])

    return pages.mapInArrow(draw, "doc_id string, page_no int, at int, png binary")


def _tag(name: str, inner: str, kind: str = "") -> str:
    """SQL for an element around SQL."""
    return f"concat('<{name}{f' class={chr(34)}{kind}{chr(34)}' if kind else ''}>', {inner}, '</{name}>')"


STYLE = "body{font-family:sans-serif;max-width:60em;margin:2em auto}article{border-left:.4em solid #888;padding:.2em 1em;margin:1em 0}.CRITICAL{border-color:#b00}.HIGH{border-color:#d60}.MEDIUM{border-color:#da0}img{max-width:100%}td{padding-right:1em}"


def reports(findings: DataFrame, pages: DataFrame, images: DataFrame | None = None, *, max_shown: int = 200, max_crops: int = 60, language: str = "en") -> DataFrame:
    """doc_id, value: an HTML page for every archive of pages (doc_id, page_no). findings has doc_id, page_no, rule_id, level, title, clause, message, confidence, box.

    Of an archive's findings, the worst max_shown are listed and the worst max_crops of these have their crop; counts are of all."""
    rank = f.level_rank(F.col("level"))
    order = (rank.asc(), F.asc("page_no"), F.asc("rule_id"), F.asc("message"), F.asc("box"))
    worst = ranges.top(findings, "doc_id", max_shown, *order, spread="page_no")
    if images is not None:
        drawn = crops(worst.where(F.col("at") <= max_crops), images).select("doc_id", "at", F.base64("png").alias("png"))
        worst = worst.join(drawn, ["doc_id", "at"], "left")
    else:
        worst = worst.withColumn("png", F.lit(None).cast("string"))
    e = t.escaped
    picture = "coalesce(concat('<p><img alt=\"evidence\" src=\"data:image/png;base64,', png, '\"></p>'), '')"
    head = f"concat(at, '. ', {e('title')}, ' — ', {e('rule_id')}, ', ', {e(label('level', language))}, ', ', page_no, ', ', round(confidence * 100), ' %')"
    card = f"concat('<article class=\"', {e('level')}, '\">', {_tag('h3', head)}, {_tag('p', e('message'))}, if(clause <> '', {_tag('p', e('clause'))}, ''), {picture}, '</article>')"
    cards = worst.select("doc_id", F.struct("at", F.expr(card).alias("html")).alias("card")).groupBy("doc_id").agg(F.array_sort(F.collect_list("card")).alias("cards"))

    levels = findings.groupBy("doc_id").agg(F.count(F.lit(1)).alias("findings"), *[F.count_if(F.col("level") == x).alias(x) for x in f.LEVELS])
    rules = findings.groupBy("doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "rule_id", "n"))).alias("rules"))
    sizes = pages.groupBy("doc_id").agg(F.countDistinct("page_no").alias("pages"))
    row = lambda a, b: f"concat('<tr><td>', {a}, '</td><td>', {b}, '</td></tr>')"
    of_levels = ", ".join(row(e(label(t.quoted(x), language)), f"coalesce({x}, 0)") for x in f.LEVELS)
    of_rules = f"array_join(transform(coalesce(rules, array()), r -> {row(e('r.rule_id'), 'r.n')}), '')"
    rest = f"if(findings > {max_shown}, {_tag('p', f'concat(findings - {max_shown}, {t.quoted(" more in the full list")})')}, '')"
    body = f"""concat('<!doctype html><meta charset="utf-8"><title>', {e('doc_id')}, '</title><style>{STYLE}</style>', {_tag('h1', e('doc_id'))},
      {_tag('p', "concat(pages, ' pages, ', coalesce(findings, 0), ' findings. For review by people; no verdict.')")}, '<table>', {of_levels}, '</table><table>', {of_rules}, '</table>',
      coalesce(array_join(transform(cards, c -> c.html), ''), ''), coalesce({rest}, ''))"""
    return sizes.join(levels, "doc_id", "left").join(rules, "doc_id", "left").join(cards, "doc_id", "left").select("doc_id", F.expr(body).alias("value"))


def write_reports(reports_: DataFrame, path: str) -> None:
    """One folder with one file for each archive, named after it, written where the report was put together."""
    named = reports_.select(F.expr(t.safe_name("doc_id")).alias("archive"), F.regexp_replace("value", "[\r\n]+", " ").alias("value"))
    named.repartition("archive").write.mode("overwrite").partitionBy("archive").text(path)
