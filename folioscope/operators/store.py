"""Tables that change: upserts, deletions and appends as rewrites, since Parquet has no MERGE.

A rewrite is a union and one aggregate by key: the newest version of each key wins. Runs are partitions, so importing a run
again replaces that run alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of the largest order for each key."""
    rest = [x for x in rows.columns if x not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r")).select(*keys, "r.*").select(*rows.columns)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; of new rows of one key the last `seq` wins if there is such a column."""
    new = newest(new, keys, "seq") if "seq" in new.columns and "seq" not in keys else new.dropDuplicates(keys)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def deleted(old: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(gone.select(*keys).distinct(), keys, "left_anti")


def judged(verdicts: DataFrame, changes: DataFrame) -> DataFrame:
    """Verdicts after changes (finding_key, verdict, reviewer, decided_at, seq): '' takes a verdict back."""
    last = newest(changes, ["finding_key"], "seq")
    kept = verdicts.join(last.select("finding_key"), "finding_key", "left_anti")
    return kept.unionByName(last.where("verdict <> ''").select(*verdicts.columns))


def import_run(rows: DataFrame, path: str) -> None:
    """Writes rows, which have run_id, in place of the same runs under path; other runs stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Adds events to a log; nothing in it is ever rewritten."""
    rows.write.mode("append").parquet(path)


def overridden(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rules (rule_id, enabled, level) with stored overrides; null keeps a field."""
    o = overrides.select("rule_id", F.col("enabled").alias("_e"), F.col("level").alias("_l"))
    return rules.join(o, "rule_id", "left").select("rule_id", F.coalesce("_e", "enabled").alias("enabled"), F.coalesce("_l", "level").alias("level"))


def activated(models: DataFrame, model_id: str) -> DataFrame:
    """Model states after one is activated: the active one of the same kind retires; a model on fewer than 60 human labels can't be activated."""
    one = models.where(F.col("model_id") == model_id).select(F.col("kind").alias("_kind"), (F.col("human") >= 60).alias("_fit"))
    joined = models.join(F.broadcast(one), models.kind == F.col("_kind"), "left")  # one row
    status = F.when(~F.coalesce("_fit", F.lit(False)), F.col("status")).when(F.col("model_id") == model_id, "active").when(F.col("status") == "active", "retired").otherwise(F.col("status"))
    return joined.select(*[status.alias(x) if x == "status" else F.col(x) for x in models.columns])


def last_states(events: DataFrame, key: str, state: str) -> DataFrame:
    """The newest state of each key from an event log (ts, event_id break ties)."""
    return events.groupBy(key).agg(F.max_by(state, F.struct("ts", "event_id")).alias("state"), F.max("ts").alias("at"))


def locked_out(logins: DataFrame, strikes: int = 5, minutes: int = 15) -> DataFrame:
    """Failed logins that complete `strikes` failures in a row within `minutes`: user_id, ts."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    runs = logins.withColumn("since", F.sum(F.when(~F.col("failed"), 1).otherwise(0)).over(w))
    streak = Window.partitionBy("user_id", "since").orderBy("ts", "event_id")
    early = F.lag("ts", strikes - 1).over(streak)
    failed = runs.where("failed").withColumn("early", early)
    return failed.where(F.col("early").isNotNull() & (F.unix_micros("ts") - F.unix_micros("early") <= minutes * 60_000_000)).select("user_id", "event_id", "ts")
