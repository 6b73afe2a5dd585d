"""Pages that arrive over time (an extension: the batch engine has no clock).

Page rules are projections, so a stream of nested pages takes them as it stands. Archives are closed when none of their
pages has come for a while: state holds an archive's digests, a timer closes it, and its units are cut as in the batch.

`revisions` keeps an archive's pages by number, closes it by event time, and keeps them for a while longer: a page that
comes late opens the archive again, and its next closing is a new revision of all its units. A page that comes twice
counts as it came last. `write_closed` audits the archives that a batch closed with the batch's own unit rules. Both need the
RocksDB state store (`STORE`) and a checkpoint in a shared folder. `closing_units` is the plainer form on processing time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import page_rules, segment

UNITS = "doc_id string, unit_no int, pages string, page_count int"
#: An archive's pages, one line of JSON each.
_STATE = "pages string"


def page_findings(pages: DataFrame, *rules: str) -> DataFrame:
    return page_rules.findings(pages, *rules)


def finding_rates(findings: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by rule and time window; findings has ts."""
    return findings.withWatermark("ts", late).groupBy(F.window("ts", width), "rule_id").agg(F.count(F.lit(1)).alias("n"))


def _closed(key: tuple, pages: list[dict]) -> pd.DataFrame:
    """An archive's units, by the batch's rules."""
    rows = sorted(pages, key=lambda p: p["page_no"])
    for p in rows:
        p["marker"] = {"current": p["current"], "total": p["total"]} if p["current"] else None
    units: dict[int, list[int]] = {}
    for p, unit in zip(rows, segment.unit_numbers(rows), strict=True):
        units.setdefault(unit, []).append(p["page_no"])
    return pd.DataFrame([(key[0], unit, ",".join(map(str, at)), len(at)) for unit, at in units.items()], columns=["doc_id", "unit_no", "pages", "page_count"])


def _paged(digests: DataFrame) -> DataFrame:
    """doc_id and page (JSON of PAGE) of full digests or of short ones: doc_id, page_no, part (a key or null), form, current."""
    if "marker" in digests.columns:
        page = F.struct("page_no", "form_type", "keys", F.coalesce("marker.current", F.lit(0)).alias("current"), F.coalesce("marker.total", F.lit(0)).alias("total"), "has_title")
    else:
        keys = F.when(F.col("part").isNull(), F.create_map().cast("map<string,string>")).otherwise(F.create_map(F.lit("part"), F.col("part")))
        page = F.struct("page_no", F.col("form").alias("form_type"), keys.alias("keys"), F.coalesce("current", F.lit(0)).alias("current"), F.lit(0).alias("total"), F.lit(False).alias("has_title"))
    return digests.select("doc_id", F.to_json(page, {"ignoreNullFields": "false"}).alias("page"))


def closing_units(digests: DataFrame, quiet_ms: int = 600_000) -> DataFrame:
    """Units of archives that got no page for quiet_ms. digests: those of the batch, or doc_id, page_no, part, form, current (page number or null)."""
    def update(key, batches, state: GroupState):
        held = state.get[0] if state.exists else ""
        if state.hasTimedOut:
            state.remove()
            yield _closed(key, [json.loads(x) for x in held.splitlines()])
            return
        for b in batches:
            held += "".join(x + "\n" for x in b.page)
        state.update((held,))
        state.setTimeoutDuration(quiet_ms)

    return _paged(digests).groupBy("doc_id").applyInPandasWithState(update, UNITS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


#: The state store that revisions() needs, as settings of the session.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
_PAGE = "page_no int, form_type string, keys map<string,string>, marker struct<current:int,total:int>, has_title boolean, text_len int, fingerprint string"
REVISION = "doc_id string, revision int, page_no int, unit_no int, page string"


class _Archive(StatefulProcessor):
    """An archive's pages by number, how often it was closed, and what its timer is for."""

    def __init__(self, quiet_ms: int, keep_ms: int):
        self.quiet_ms, self.keep_ms = quiet_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page_no int", "page string")
        self.told = handle.getValueState("told", "revision int, open boolean, last bigint")

    def _alarm(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        revision, _, last = self.told.get() or (0, False, 0)
        for batch in rows:
            for no, page, ts in zip(batch["page_no"], batch["page"], batch["ms"], strict=True):
                self.pages.updateValue((int(no),), (page,))
                last = max(last, int(ts))
        self.told.update((revision, True, last))
        self._alarm(max(last + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame(columns=[c.split()[0] for c in REVISION.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        revision, is_open, last = self.told.get()
        if not is_open:  # kept long enough
            self.pages.clear()
            self.told.clear()
            return
        held = sorted((k[0], v[0]) for k, v in self.pages.iterator())
        units = segment.unit_numbers([json.loads(page) for _, page in held])
        self.told.update((revision + 1, False, last))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield pd.DataFrame([(key[0], revision + 1, no, unit, page) for (no, page), unit in zip(held, units, strict=True)], columns=[c.split()[0] for c in REVISION.split(", ")])

    def close(self) -> None:
        pass


def revisions(digests: DataFrame, *, late: str = "10 minutes", quiet_ms: int = 600_000, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """doc_id, revision, page_no, unit_no and the page's digest of archives when they close, all pages of an archive at a time. digests: those of the batch, with ts."""
    page = F.to_json(F.struct("page_no", "form_type", "keys", "marker", "has_title", "text_len", "fingerprint"), {"ignoreNullFields": "false"})
    timed = digests.withWatermark("ts", late).select("doc_id", "page_no", page.alias("page"), F.unix_millis("ts").alias("ms"), "ts")
    closed = timed.groupBy("doc_id").transformWithStateInPandas(statefulProcessor=_Archive(quiet_ms, keep_ms), outputStructType=REVISION, outputMode="Append", timeMode="EventTime")
    return closed.withColumn("page", F.from_json("page", _PAGE)).select("doc_id", "revision", "unit_no", "page.*")


def write_closed(closed: DataFrame, units: str, findings: str, checkpoint: str, book: dict | None = None, then: Callable[[DataFrame], None] | None = None) -> DataStreamWriter:
    """A writer of units and unit findings, with their revision, of the archives that revisions() closes. Rows of a batch that is run again carry its number, so that batch_id and doc_id tell them apart."""

    def audit(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        marked = batch.groupBy("doc_id").agg(F.max("revision").alias("revision")).withColumn("batch_id", F.lit(batch_id))
        cut = segment.units(batch.drop("revision"))
        # a batch that is run again replaces what it wrote
        for rows, path in ((cut, units), (segment.findings(cut, book), findings)):
            rows.join(marked, "doc_id").drop("batch_id").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        if then:
            then(batch)
        batch.unpersist()

    return closed.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint)


def latest(written: DataFrame, units: DataFrame) -> DataFrame:
    """Of units or findings that write_closed() wrote, those of each archive's last revision; its units tell which that is, as a revision can be without findings."""
    last = units.groupBy("doc_id").agg(F.max("revision").alias("revision"))
    return written.join(last, ["doc_id", "revision"], "left_semi")
