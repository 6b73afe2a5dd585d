"""Findings, verdicts, runs, tasks and gold sets over tables derived from the star schema, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import findings as f
from ..operators import ranges, store
from ..sources import derived, labels
from ..sources.tables import table

_FIND, _KEYED, _VERD = derived.FINDING, derived.KEYED, derived.VERDICT
#: An archive's pages: every page number that a finding of any run names.
_PAGES = "SELECT DISTINCT CAST(l_suppkey AS STRING) AS doc_id, CAST(l_partkey % 40 AS INT) + 1 AS page_no FROM lineitem"
_GOLD = "SELECT DISTINCT CAST(l_suppkey AS STRING) AS doc_id, CAST(l_partkey % 40 AS INT) + 1 AS page_no, 'A' || lpad(CAST(l_linenumber AS STRING), 2, '0') AS rule_id, CASE WHEN (l_suppkey + l_partkey % 40 + l_linenumber) % 3 = 0 THEN 'positive' ELSE 'negative' END AS kind FROM lineitem WHERE (l_suppkey + l_partkey % 40 + l_linenumber) % 4 <> 0 AND l_linenumber < 6"
_JUDGED = f"SELECT k.*, v.verdict, v.reviewer, v.decided_at FROM ({_KEYED}) k LEFT JOIN ({_VERD}) v ON v.finding_key = k.finding_key"
_RANK9 = "CASE level WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END"
_RANK3 = _RANK9.replace("ELSE 9", "ELSE 3")
_RUNS = "SELECT 'run' || CAST(r_regionkey AS STRING) AS run_id, r_name AS target FROM region"

Q, S = {}, {}


def _add(name: str, sql: str):
    def keep(fn):
        Q[name], S[name] = fn, sql
        return fn

    return keep


def _find(spark, d):
    return derived.relation(spark, d, _FIND)


def _keyed(spark, d):
    return f.with_key(_find(spark, d))


def _verdicts(spark, d):
    return derived.relation(spark, d, _VERD)


def _reviewed(spark, d):
    return f.reviewed(_keyed(spark, d), _verdicts(spark, d))


@_add("wn_finding_key", f"SELECT finding_key, seq FROM ({_KEYED}) k")
def _(spark, d):
    return _keyed(spark, d).select("finding_key", "seq")


@_add("jn_findings_verdicts", f"SELECT finding_key, level, verdict FROM ({_JUDGED}) j")
def _(spark, d):
    return _reviewed(spark, d).select("finding_key", "level", "verdict")


@_add("so_page_of_findings", f"SELECT finding_key, level, verdict FROM ({_JUDGED}) j WHERE level = 'HIGH' AND verdict IS NULL ORDER BY {_RANK3}, doc_id, page_no, finding_key LIMIT 200 OFFSET 100")
def _(spark, d):
    return f.page_of(f.filtered(_reviewed(spark, d), level="HIGH", state="todo"), 200, 100).select("finding_key", "level", "verdict")


@_add("so_severity", f"SELECT doc_id, page_no, rule_id, seq, level, CAST({_RANK9} AS INT) AS rank FROM ({_FIND}) x")
def _(spark, d):
    return f.by_severity(_find(spark, d)).select("doc_id", "page_no", "rule_id", "seq", "level", f.level_rank(F.col("level")).alias("rank"))


for _c in ("level", "rule_id", "doc_id"):

    @_add(f"ag_summary_{_c}", f"SELECT {_c} AS value, count(*) AS n FROM ({_FIND}) x GROUP BY {_c}")
    def _(spark, d, _c=_c):
        return f.summary(_find(spark, d), _c)


@_add("ag_summary_verdict", f"SELECT verdict AS value, count(*) AS n FROM ({_VERD}) x GROUP BY verdict")
def _(spark, d):
    return f.summary(_verdicts(spark, d), "verdict")


@_add("ag_rule_hits", f"SELECT rule_id, count(*) AS n, count(DISTINCT run_id) AS runs FROM ({_FIND}) x GROUP BY rule_id")
def _(spark, d):
    return _find(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("run_id").alias("runs"))


@_add("ag_stats", f"SELECT (SELECT count(*) FROM ({_PAGES}) p) AS pages, (SELECT count(DISTINCT doc_id) FROM ({_PAGES}) p) AS documents, count(*) AS findings, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, count(*) FILTER (WHERE level = 'HIGH') AS high, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, count(*) FILTER (WHERE level = 'LOW') AS low FROM ({_FIND}) x")
def _(spark, d):
    return f.statistics(_find(spark, d), derived.relation(spark, d, _PAGES))


@_add("ag_level_matrix", f"SELECT doc_id, count(*) FILTER (WHERE level = 'CRITICAL') AS critical, count(*) FILTER (WHERE level = 'HIGH') AS high, count(*) FILTER (WHERE level = 'MEDIUM') AS medium, count(*) FILTER (WHERE level = 'LOW') AS low FROM ({_FIND}) x GROUP BY doc_id")
def _(spark, d):
    return f.level_matrix(_find(spark, d))


@_add("ag_page_counts", f"SELECT doc_id, count(*) AS pages FROM ({_PAGES}) p GROUP BY doc_id")
def _(spark, d):
    return derived.relation(spark, d, _PAGES).groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"))


_SINGLE = f"WITH f AS ({_FIND}), pg AS (SELECT doc_id, count(DISTINCT page_no) AS doc_pages FROM ({_PAGES}) p GROUP BY doc_id), per AS (SELECT doc_id, rule_id, count(*) AS findings, count(DISTINCT page_no) AS hit_pages, list_sort(list(DISTINCT page_no)) AS hit, arg_min(page_no, seq) AS page_no, arg_min(message, seq) AS message FROM f WHERE run_id = 'run0' GROUP BY doc_id, rule_id), wide AS (SELECT * FROM per JOIN pg USING (doc_id) WHERE findings >= 5 AND hit_pages >= 0.6 * doc_pages), single AS (SELECT * FROM f WHERE run_id = 'run0' AND (doc_id, rule_id) NOT IN (SELECT (doc_id, rule_id) FROM wide))"


def _run0(spark, d):
    return _find(spark, d).where("run_id = 'run0'")


@_add("ag_systemic", f"{_SINGLE} SELECT doc_id, rule_id, findings, hit_pages, doc_pages, page_no, message, array_to_string(list_slice(hit, 1, 8), ',') AS preview FROM wide")
def _(spark, d):
    return f.collapse(_run0(spark, d), derived.relation(spark, d, _PAGES))[0]


@_add("ag_batch", f"{_SINGLE}, docs AS (SELECT rule_id, doc_id, count(*) AS n FROM single GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, doc_id) AS pos FROM docs) SELECT rule_id, CAST(sum(n) AS BIGINT) AS findings, count(*) AS documents, string_agg(doc_id || ':' || n, ',' ORDER BY pos) FILTER (WHERE pos <= 5) AS top_docs FROM ranked GROUP BY rule_id HAVING sum(n) >= 30")
def _(spark, d):
    return f.collapse(_run0(spark, d), derived.relation(spark, d, _PAGES))[1]


#: Findings of a few rules of many findings and of many rules of a few: an order's later lines are a rule of their own.
_MIXED = _FIND.replace("'A' || lpad(CAST(l_linenumber AS STRING), 2, '0') AS rule_id", "CASE WHEN l_linenumber < 3 THEN 'A' || CAST(l_linenumber AS STRING) ELSE 'R' || CAST(l_orderkey AS STRING) END AS rule_id")
_MIXED_SINGLE = _SINGLE.replace(_FIND, _MIXED)


@_add("ag_left_single", f"{_MIXED_SINGLE} SELECT doc_id, page_no, rule_id, seq FROM single WHERE rule_id NOT IN (SELECT rule_id FROM single GROUP BY rule_id HAVING count(*) >= 30)")
def _(spark, d):
    mixed = derived.relation(spark, d, _MIXED).where("run_id = 'run0'")
    return f.collapse(mixed, derived.relation(spark, d, _PAGES))[2].select("doc_id", "page_no", "rule_id", "seq")


@_add("ag_dedupe", f"SELECT rule_id, doc_id, page_no, x, message, min(seq) AS seq FROM ({_FIND}) z GROUP BY ALL")
def _(spark, d):
    half = _find(spark, d)
    both = half.where("seq % 2 = 0").unionByName(half.where("seq % 2 = 1"))
    return f.deduplicated(both.select("rule_id", "doc_id", "page_no", "x", "message", "seq"), "rule_id", "doc_id", "page_no", "x", "message")


@_add("ag_dashboard", f"SELECT count(*) AS total, count(verdict) AS judged, count(*) FILTER (WHERE verdict IS NULL) AS todo, count(*) FILTER (WHERE level IN ('CRITICAL', 'HIGH')) AS grave, round(count(*) FILTER (WHERE verdict = 'true') / nullif(count(*) FILTER (WHERE verdict IN ('true', 'false')), 0), 4) AS true_rate FROM ({_JUDGED}) j")
def _(spark, d):
    return f.dashboard(_reviewed(spark, d))


@_add("ag_siblings", f"SELECT run_id, doc_id, rule_id, count(*) AS n, count(*) FILTER (WHERE verdict IS NULL) AS todo FROM ({_JUDGED}) j GROUP BY ALL")
def _(spark, d):
    return _reviewed(spark, d).groupBy("run_id", "doc_id", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict").isNull()).alias("todo"))


@_add("set_evaluate", f"WITH p AS (SELECT DISTINCT doc_id, page_no, rule_id FROM ({_FIND}) x WHERE level IN ('HIGH', 'MEDIUM')), g AS (SELECT doc_id, page_no, rule_id, bool_or(kind = 'positive') AS pos, bool_or(kind = 'negative') AS neg FROM ({_GOLD}) y GROUP BY ALL), j AS (SELECT p.doc_id IS NOT NULL AS said, coalesce(pos, false) AS pos, coalesce(neg, false) AS neg FROM p FULL JOIN g ON p.doc_id = g.doc_id AND p.page_no = g.page_no AND p.rule_id = g.rule_id), c AS (SELECT count(*) FILTER (WHERE said AND pos) AS tp, count(*) FILTER (WHERE said AND neg) AS fp, count(*) FILTER (WHERE NOT said AND pos) AS fn, count(*) FILTER (WHERE said AND NOT pos AND NOT neg) AS unjudged FROM j) SELECT *, round(tp / greatest(1, tp + fn), 4) AS recall, round(tp / greatest(1, tp + fp), 4) AS precision FROM c")
def _(spark, d):
    return f.evaluation(_find(spark, d).where("level IN ('HIGH', 'MEDIUM')"), derived.relation(spark, d, _GOLD))


_WITH_PARTS = f"SELECT v.*, split_part(finding_key, '|', 2) AS doc_id, CAST(split_part(finding_key, '|', 3) AS INT) AS page_no, split_part(finding_key, '|', 4) AS rule_id FROM ({_VERD}) v"


@_add("dml_gold_merge", f"WITH v AS ({_WITH_PARTS}), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, rule_id ORDER BY decided_at, finding_key) AS pos FROM v), k AS (SELECT doc_id, page_no, rule_id, arg_max(verdict, pos) FILTER (WHERE verdict <> 'unsure') AS last, coalesce(max(pos) FILTER (WHERE verdict = 'unsure'), 0) > coalesce(max(pos) FILTER (WHERE verdict <> 'unsure'), 0) AS unsure FROM o GROUP BY ALL) SELECT doc_id, page_no, rule_id, CASE last WHEN 'true' THEN 'positive' WHEN 'false' THEN 'negative' END AS kind, unsure FROM k")
def _(spark, d):
    return f.merged_gold(derived.relation(spark, d, _WITH_PARTS))


@_add("wn_ledger", f"SELECT CAST(row_number() OVER (ORDER BY {_RANK3}, doc_id, page_no, finding_key) AS INT) AS no, finding_key, level, message FROM ({_KEYED}) k WHERE run_id = 'run0'")
def _(spark, d):
    return f.ledger(_keyed(spark, d).where("run_id = 'run0'"))


Q["wn_run_ledger"], S["wn_run_ledger"] = Q["wn_ledger"], S["wn_ledger"]  # its former name


@_add("jn_run_totals", f"SELECT r.run_id, r.target, coalesce(x.n, 0) AS findings, coalesce(v.n, 0) AS judged FROM ({_RUNS}) r LEFT JOIN (SELECT run_id, count(*) AS n FROM ({_FIND}) z GROUP BY 1) x USING (run_id) LEFT JOIN (SELECT split_part(finding_key, '|', 1) AS run_id, count(*) AS n FROM ({_VERD}) z GROUP BY 1) v USING (run_id)")
def _(spark, d):
    return f.run_totals(derived.relation(spark, d, _RUNS, "region"), _find(spark, d), _verdicts(spark, d))


@_add("jn_run_history", f"SELECT r.run_id, r.target, count(*) AS n FROM ({_RUNS}) r JOIN ({_FIND}) x USING (run_id) WHERE x.doc_id = '5' GROUP BY ALL HAVING count(*) > 0")
def _(spark, d):
    return derived.relation(spark, d, _RUNS, "region").join(_find(spark, d).where("doc_id = '5'"), "run_id").groupBy("run_id", "target").agg(F.count(F.lit(1)).alias("n"))


_RULES = "SELECT 'A' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS rule_id, n_nationkey % 2 = 0 AS enabled, CASE n_regionkey WHEN 0 THEN 'HIGH' ELSE 'LOW' END AS level FROM nation"
_OVER = "SELECT 'A' || lpad(CAST(n_nationkey AS STRING), 2, '0') AS rule_id, CASE WHEN n_nationkey % 4 = 0 THEN false END AS enabled, CASE WHEN n_nationkey % 3 = 0 THEN 'CRITICAL' END AS level FROM nation WHERE n_nationkey % 6 < 4"


@_add("jn_rule_overview", f"SELECT r.rule_id, coalesce(o.enabled, r.enabled) AS enabled, coalesce(o.level, r.level) AS level, coalesce(h.n, 0) AS hits FROM ({_RULES}) r LEFT JOIN ({_OVER}) o USING (rule_id) LEFT JOIN (SELECT rule_id, count(*) AS n FROM ({_FIND}) z GROUP BY 1) h USING (rule_id)")
def _(spark, d):
    rules = store.overridden(derived.relation(spark, d, _RULES, "nation"), derived.relation(spark, d, _OVER, "nation"))
    hits = _find(spark, d).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return rules.join(hits, "rule_id", "left").fillna(0, ["hits"])


_OLD = "SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0"
_NEW = "SELECT o_orderkey % 5000 AS k, o_orderpriority AS v, o_orderkey AS seq FROM orders WHERE o_orderkey % 2 = 0"


@_add("dml_upsert", f"SELECT k, v FROM ({_OLD}) o WHERE k NOT IN (SELECT k FROM ({_NEW}) n) UNION ALL SELECT k, arg_max(v, seq) FROM ({_NEW}) n GROUP BY k")
def _(spark, d):
    new = store.newest(derived.relation(spark, d, _NEW, "orders"), ["k"], "seq").select("k", "v")
    return store.upserted(derived.relation(spark, d, _OLD, "orders"), new, ["k"])


@_add("dml_delete", f"SELECT k, v FROM ({_OLD}) o WHERE NOT EXISTS (SELECT 1 FROM ({_NEW}) n WHERE n.k = o.k)")
def _(spark, d):
    return store.deleted(derived.relation(spark, d, _OLD, "orders"), derived.relation(spark, d, _NEW, "orders"), ["k"])


_CHANGE = f"SELECT finding_key, CASE seq % 4 WHEN 0 THEN '' WHEN 1 THEN 'true' ELSE 'unsure' END AS verdict, 'boss' AS reviewer, '2026.01.01' AS decided_at, seq FROM ({_KEYED}) k WHERE seq % 3 = 0"


@_add("dml_judge", f"SELECT finding_key, verdict, reviewer FROM ({_VERD}) v WHERE finding_key NOT IN (SELECT finding_key FROM ({_CHANGE}) c) UNION ALL SELECT finding_key, verdict, reviewer FROM ({_CHANGE}) c WHERE verdict <> ''")
def _(spark, d):
    return store.judged(_verdicts(spark, d), derived.relation(spark, d, _CHANGE)).select("finding_key", "verdict", "reviewer")


_MODELS = "SELECT c_custkey AS id, 'm' || CAST(c_custkey AS STRING) AS model_id, c_mktsegment AS kind, CAST(c_nationkey AS INT) * 5 AS human, CASE c_custkey % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'retired' ELSE 'candidate' END AS status FROM customer"


@_add("dml_activate", f"WITH m AS ({_MODELS}), one AS (SELECT kind FROM m WHERE model_id = 'm26' AND human >= 60) SELECT model_id, kind, CASE WHEN kind NOT IN (SELECT kind FROM one) THEN status WHEN model_id = 'm26' THEN 'active' WHEN status = 'active' THEN 'retired' ELSE status END AS status FROM m")
def _(spark, d):
    return store.activated(derived.relation(spark, d, _MODELS, "customer"), "m26").select("model_id", "kind", "status")


@_add("dml_next_version", f"SELECT kind, count(*) + 1 AS next_version, max(model_id) FILTER (WHERE status = 'active') AS active FROM ({_MODELS}) m GROUP BY kind")
def _(spark, d):
    return derived.relation(spark, d, _MODELS, "customer").groupBy("kind").agg((F.count(F.lit(1)) + 1).alias("next_version"), F.max(F.when(F.col("status") == "active", F.col("model_id"))).alias("active"))


@_add("dml_task_states", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS events FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events")
    return store.last_states(e, "user_id", "event_type").join(e.groupBy("user_id").agg(F.count(F.lit(1)).alias("events")), "user_id").select("user_id", "state", "events")


@_add("so_newest", "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def _(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


@_add("cp_login_lock", "WITH e AS (SELECT user_id, event_id, ts, event_type IN ('error', 'click', 'view') AS failed FROM events), r AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS since FROM e), s AS (SELECT *, lag(ts, 4) OVER (PARTITION BY user_id, since ORDER BY ts, event_id) AS early FROM r WHERE failed) SELECT user_id, event_id, ts FROM s WHERE epoch_us(ts) - epoch_us(early) <= 36000000000")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").isin("error", "click", "view").alias("failed"))
    return store.locked_out(e, 5, 600).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@_add("jn_session_user", "SELECT e.event_id, c.c_name FROM events e JOIN customer c ON c.c_custkey = e.user_id WHERE e.event_type = 'click'")
def _(spark, d):
    e = table(spark, d, "events").where("event_type = 'click'")
    return e.join(table(spark, d, "customer"), e.user_id == F.col("c_custkey")).select("event_id", "c_name")


_SAMPLES = "SELECT doc_id AS sample_id, source AS doc, lang, n_chars % 5 = 0 AS synthetic FROM documents"


def _samples(spark, d):
    return derived.relation(spark, d, _SAMPLES, "documents"), table(spark, d, "labels")


@_add("jn_todo_samples", f"SELECT s.sample_id, s.doc FROM ({_SAMPLES}) s LEFT JOIN labels l ON l.doc_id = s.sample_id WHERE l.doc_id IS NULL")
def _(spark, d):
    s, l = _samples(spark, d)
    return s.join(l, s.sample_id == l.doc_id, "left_anti").select("sample_id", "doc")


@_add("jn_labeled_pairs", f"SELECT s.sample_id, l.quality, l.toxic FROM ({_SAMPLES}) s JOIN labels l ON l.doc_id = s.sample_id WHERE s.lang NOT IN ('en', 'fr')")
def _(spark, d):
    s, l = _samples(spark, d)
    return s.where(~F.col("lang").isin("en", "fr")).join(l, s.sample_id == l.doc_id).select("sample_id", "quality", "toxic")


@_add("ag_sample_stats", f"SELECT count(*) AS samples, CAST(sum(CASE WHEN synthetic THEN 1 ELSE 0 END) AS BIGINT) AS synthetic, count(DISTINCT doc) AS docs, count(l.doc_id) AS labeled, count(*) FILTER (WHERE l.quality = 1) AS good, count(*) FILTER (WHERE l.quality = 0) AS bad, count(*) FILTER (WHERE NOT s.synthetic AND l.toxic = 0) AS human FROM ({_SAMPLES}) s LEFT JOIN labels l ON l.doc_id = s.sample_id")
def _(spark, d):
    s, l = _samples(spark, d)
    j = s.join(l, s.sample_id == l.doc_id, "left")
    return j.agg(F.count(F.lit(1)).alias("samples"), F.count_if("synthetic").alias("synthetic"), F.countDistinct("doc").alias("docs"), F.count("doc_id").alias("labeled"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"), F.count_if(~F.col("synthetic") & (F.col("toxic") == 0)).alias("human"))


@_add("ag_labelers", f"SELECT reviewer, count(*) AS n, max(decided_at) AS last FROM ({_VERD}) v GROUP BY reviewer")
def _(spark, d):
    return _verdicts(spark, d).groupBy("reviewer").agg(F.count(F.lit(1)).alias("n"), F.max("decided_at").alias("last"))


_LABELER = "CASE WHEN doc_id % 5 = 0 THEN '合成' WHEN doc_id % 7 = 0 THEN '几何粗筛' ELSE 'u' || CAST(doc_id % 3 AS STRING) END"


@_add("ag_human_labels", f"SELECT count(*) AS n FROM (SELECT doc_id, {_LABELER} AS labeler FROM labels) l JOIN ({_SAMPLES}) s ON s.sample_id = l.doc_id WHERE NOT s.synthetic AND l.labeler NOT IN ('合成', '几何粗筛')")
def _(spark, d):
    s, l = _samples(spark, d)
    return labels.human_labels(s, l.select(F.col("doc_id").alias("sample_id"), F.expr(_LABELER).alias("labeler")))


@_add("ag_sample_docs", "SELECT DISTINCT source AS doc FROM documents WHERE source <> ''")
def _(spark, d):
    return table(spark, d, "documents").where("source <> ''").select(F.col("source").alias("doc")).distinct().orderBy("doc")


@_add("ag_form_share", "SELECT l_returnflag AS form, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 4) AS share FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    n = table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("form")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4))  # a row a form


@_add("wn_top_docs", f"SELECT rule_id, doc_id, n, CAST(pos AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY n DESC, doc_id) AS pos FROM (SELECT rule_id, doc_id, count(*) AS n FROM ({_FIND}) x GROUP BY ALL) y) z WHERE pos <= 10")
def _(spark, d):
    n = _find(spark, d).groupBy("rule_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    return ranges.top(n, "rule_id", 10, F.desc("n"), F.asc("doc_id"), spread="doc_id", name="place")


@_add("so_lookup", f"SELECT finding_key, level, verdict FROM ({_JUDGED}) j WHERE finding_key = 'run0|7|8|A03|1'")
def _(spark, d):
    return _reviewed(spark, d).where("finding_key = 'run0|7|8|A03|1'").select("finding_key", "level", "verdict").limit(1)


@_add("so_current_run", f"SELECT run_id FROM ({_RUNS}) r WHERE run_id = coalesce((SELECT max(run_id) FROM ({_RUNS}) a WHERE run_id = 'nope'), (SELECT max(run_id) FROM ({_RUNS}) a WHERE run_id = 'run1'), (SELECT max(run_id) FROM ({_RUNS}) a))")
def _(spark, d):
    runs = derived.relation(spark, d, _RUNS, "region")
    wanted = F.coalesce(F.max(F.when(F.col("run_id") == "nope", F.col("run_id"))), F.max(F.when(F.col("run_id") == "run1", F.col("run_id"))), F.max("run_id"))
    return runs.agg(wanted.alias("run_id"))


@_add("cp_stratified_split", "WITH r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, quality, pos > greatest(1, n - CAST(floor(n * 3 / 10) AS BIGINT)) AS held FROM r")
def _(spark, d):
    w = Window.partitionBy("quality")
    r = table(spark, d, "labels").withColumn("at", F.row_number().over(w.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return r.select("doc_id", "quality", (F.col("at") > F.greatest(F.lit(1), F.col("n") - F.floor(F.col("n") * 3 / 10))).alias("held"))


_BANNED = ("spam", "license", "idiot")


@_add("cp_banned_terms", "SELECT page_id, CAST(i AS INT) AS line_no, term FROM (SELECT page_id, string_split(html, chr(10)) AS ls FROM pages) p, unnest(range(1, len(ls) + 1)) t(i), (SELECT unnest(['spam', 'license', 'idiot']) AS term) b WHERE contains(lower(ls[i]), term)")
def _(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.posexplode(F.split("html", "\n")).alias("at", "line"))
    terms = F.explode(F.filter(F.array(*[F.lit(t) for t in _BANNED]), lambda t: F.contains(F.lower("line"), t)))
    return lines.select("page_id", (F.col("at") + 1).cast("int").alias("line_no"), terms.alias("term"))


QUERIES, SQL = Q, S
