"""Queries over the event log: folds, time travel, slices, rules, views, counters, corrections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronofold.operators import events as ev
from chronofold.operators import rules
from chronofold.plans import views
from chronofold.plans.book import EV, Book
from chronofold.sources.bindings import event_log, plain_log, table

BOOK = Book()
q = BOOK.query

_FOLD = EV + ", folded AS (SELECT entity, key, arg_max_null(value, seq) AS value, max(seq) AS source_event FROM cells GROUP BY 1, 2)\n"
HIDE = {"id": "hide-errors", "effect": "filter", "deps": ["error"], "expr": {"<=": [{"var": "error"}, 100]}}
VIEW = views.View(["click", "purchase"], ["click", "purchase", "k"], [HIDE], {"brief": ["purchase"]})
_WIDE = _FOLD + """, wide AS (SELECT entity, max(value) FILTER (key = 'click') AS click, max(value) FILTER (key = 'purchase') AS purchase, max(value) FILTER (key = 'k') AS k,
    max(value) FILTER (key = 'error') AS error FROM folded GROUP BY 1)"""


@q(_FOLD + "SELECT * FROM folded")
def fold_latest_wins(spark, d):
    return ev.fold(ev.cells(plain_log(spark, d)))


@q(EV + "SELECT entity, key, arg_max_null(value, seq) AS value, max(seq) AS source_event FROM cells WHERE seq <= 3000 GROUP BY 1, 2")
def fold_as_of(spark, d):
    return ev.fold(ev.cells(plain_log(spark, d)), 3000)


@q(EV + "SELECT entity, key, arg_max_null(CASE WHEN value < 20 THEN NULL ELSE value END, seq) AS value, max(seq) AS source_event FROM cells GROUP BY 1, 2")
def fold_keeps_nulls(spark, d):
    return ev.fold(ev.cells(plain_log(spark, d)).withColumn("value", F.when(F.col("value") >= 20, F.col("value"))))


@q(EV + "SELECT entity, max(seq) AS watermark FROM cells GROUP BY 1")
def fold_watermarks(spark, d):
    return ev.watermarks(ev.cells(plain_log(spark, d)))


@q(_FOLD + "SELECT entity, list(key ORDER BY key) AS keys FROM folded GROUP BY 1")
def fold_keys_of_entities(spark, d):
    return ev.fold(ev.cells(plain_log(spark, d))).groupBy("entity").agg(F.sort_array(F.collect_set("key")).alias("keys"))


@q(EV + """, decl AS (SELECT 9000 AS seq, 'line' || g AS owner, 'k' AS key, 'u' || g AS source FROM range(0, 5) t(g)),
    late AS (SELECT d.owner AS entity, c.key, c.value, c.seq, c.seq AS applied FROM cells c JOIN decl d ON c.entity = d.source AND c.key = d.key AND c.seq > d.seq),
    back AS (SELECT d.owner AS entity, c.key, arg_max(c.value, c.seq) AS value, max(c.seq) AS seq, max(d.seq) AS applied FROM cells c JOIN decl d ON c.entity = d.source AND c.key = d.key AND c.seq <= d.seq GROUP BY 1, 2),
    al AS (SELECT entity, key, value, seq, seq AS applied FROM cells UNION ALL SELECT * FROM late UNION ALL SELECT * FROM back)
    SELECT entity, key, arg_max(value, (applied, seq)) AS value, arg_max(seq, (applied, seq)) AS source_event FROM al GROUP BY 1, 2""")
def fold_owner_inherits(spark, d):
    g = spark.range(5)
    decl = g.select(F.lit(9000).cast("bigint").alias("seq"), F.concat(F.lit("line"), F.col("id").cast("string")).alias("owner"), F.lit("k").alias("key"), F.concat(F.lit("u"), F.col("id").cast("string")).alias("source"))
    return ev.fold_applied(ev.inherit(ev.cells(plain_log(spark, d)), decl))


@q(EV + "SELECT seq, entity, row_number() OVER (PARTITION BY entity ORDER BY seq) AS faults FROM ev WHERE type = 'error'")
def derived_counter(spark, d):
    return ev.running_count(plain_log(spark, d), "error", "faults").select("seq", "entity", "faults")


@q(EV + """SELECT entity, CASE WHEN count(*) FILTER (type = 'view') <> 0 THEN round(count(*) FILTER (type = 'purchase')::DOUBLE / count(*) FILTER (type = 'view'), 9) END AS rate FROM ev GROUP BY 1""")
def derived_ratio(spark, d):
    made = plain_log(spark, d).groupBy("entity").agg(F.count_if(F.col("type") == "purchase").alias("p"), F.count_if(F.col("type") == "view").alias("v"))
    return made.select("entity", F.round(ev.ratio(F.col("p"), F.col("v")), 9).alias("rate"))


@q(EV + "SELECT seq, entity, type FROM ev WHERE seq BETWEEN 100 AND 300")
def log_range(spark, d):
    return plain_log(spark, d).where(F.col("seq").between(100, 300)).select("seq", "entity", "type")


@q(EV + "SELECT seq, entity FROM ev WHERE type = 'signup'")
def log_of_type(spark, d):
    return plain_log(spark, d).where("type = 'signup'").select("seq", "entity")


@q(EV + "SELECT seq, type FROM ev WHERE entity = 'u7'")
def log_touching(spark, d):
    return plain_log(spark, d).where("entity = 'u7'").select("seq", "type")


@q(EV + "SELECT count(*)::BIGINT AS events, min(seq) AS first, max(seq) AS last, 0::BIGINT AS repeated, (max(seq) - min(seq) + 1 - count(*))::BIGINT AS gaps FROM ev")
def log_consistency(spark, d):
    return ev.consistency(plain_log(spark, d))


@q(EV + "SELECT e.seq, e.entity, c.seq AS corrected, c.entity AS corrected_entity FROM ev e JOIN ev c ON e.corrects = c.seq")
def log_corrections(spark, d):
    return ev.corrections(event_log(spark, d)).select("seq", "entity", "corrected", "corrected_entity")


@q(EV + "SELECT seq, entity, anchor FROM ev WHERE starts_with(anchor, 'plant/line2/st') AND seq BETWEEN 500 AND 4000")
def slice_region(spark, d):
    return ev.region(plain_log(spark, d), "plant/line2/st", 500, 4000).select("seq", "entity", "anchor")


@q(EV + "SELECT anchor, list(seq ORDER BY seq) AS events FROM ev WHERE seq <= 400 GROUP BY 1")
def slice_anchor_as_of(spark, d):
    return ev.anchor_as_of(plain_log(spark, d), 400)


@q(EV + "SELECT entity, (row_number() OVER (PARTITION BY entity ORDER BY seq))::INTEGER AS n, seq, anchor FROM ev")
def slice_trajectory(spark, d):
    return ev.trajectory(plain_log(spark, d))


@q(EV + "SELECT entity, arg_max(anchor, seq) AS anchor, max(seq) AS seq FROM ev GROUP BY 1")
def slice_current_anchor(spark, d):
    return ev.current_anchor(plain_log(spark, d))


@q(EV + ", keyed AS (SELECT seq, entity, entity || '/' || k AS key FROM ev WHERE NOT (type = 'error' AND value > 50)) SELECT min(seq) AS seq, entity, key FROM keyed GROUP BY entity, key")
def log_idempotent(spark, d):
    log = plain_log(spark, d).withColumn("key", F.concat("entity", F.lit("/"), F.col("k").cast("string")))
    return ev.idempotent(log, "key", (F.col("type") == "error") & (F.col("value") > 50)).select("seq", "entity", "key")


@q(_WIDE + " SELECT entity, click, purchase, k FROM wide WHERE entity IN (SELECT entity FROM ev WHERE type IN ('click', 'purchase')) AND NOT coalesce(error > 100, false)")
def view_terminal(spark, d):
    return views.terminal(plain_log(spark, d), VIEW)


@q(_WIDE + " SELECT entity, purchase FROM wide WHERE entity IN (SELECT entity FROM ev WHERE type IN ('click', 'purchase') AND starts_with(anchor, 'plant/line1')) AND NOT coalesce(error > 100, false)")
def view_terminal_variant_slice(spark, d):
    return views.terminal(plain_log(spark, d), VIEW, "brief", slice_="plant/line1")


@q(_WIDE.replace("FROM cells GROUP", "FROM cells WHERE seq <= 2000 GROUP") + " SELECT entity, click, purchase, k FROM wide WHERE entity IN (SELECT entity FROM ev WHERE type IN ('click', 'purchase') AND seq <= 2000) AND NOT coalesce(error > 100, false)")
def view_terminal_as_of(spark, d):
    return views.terminal(plain_log(spark, d), VIEW, upto=2000)


@q(EV + "SELECT seq, type, entity, anchor, value FROM ev WHERE type IN ('error', 'purchase') AND corrects IS NULL")
def view_flow_facts_only(spark, d):
    return views.flow(event_log(spark, d), views.View(["error", "purchase"], [], mode="flow", folds_corrections=False))


@q(EV + "SELECT seq, type, entity, anchor, value FROM ev WHERE type IN ('error', 'purchase') AND entity = 'u11'")
def view_flow_entity(spark, d):
    return views.flow(plain_log(spark, d), views.View(["error", "purchase"], [], mode="flow"), entity="u11")


@q(EV + "SELECT seq, entity, value FROM ev WHERE type = 'error' AND value > 80 ORDER BY seq DESC LIMIT 50")
def view_intercept_rejections(spark, d):
    rejected = plain_log(spark, d).where("type = 'error' and value > 80").select("seq", "entity", "value")
    return views.intercept(plain_log(spark, d), VIEW, rejected)[1]


def _variables(*names):
    return {n: rules.Value(F.col(n), {"value": "number", "k": "int", "type": "string", "entity": "string"}[n]) for n in names}


def _all():
    return _variables("value", "k", "type", "entity")


def _rule(spark, d, expr, name="out"):
    made = rules.Compiler(_all()).compile(expr)
    return plain_log(spark, d).select("seq", (made.column if made.error is None else F.when(~F.coalesce(made.error, F.lit(False)), made.column)).alias(name))


@q(EV + "SELECT seq, round(coalesce(value, 0) * 2 + k - 5, 6) AS out FROM ev")
def rule_arithmetic(spark, d):
    return _rule(spark, d, {"-": [{"+": [{"*": [{"var": "value"}, 2]}, {"var": "k"}]}, 5]}).withColumn("out", F.round("out", 6))


@q(EV + "SELECT seq, CASE WHEN k % 7 <> 0 THEN round(value / (k % 7), 6) END AS out FROM ev")
def rule_division_guard(spark, d):
    return _rule(spark, d, {"/": [{"var": "value"}, {"%": [{"var": "k"}, 7]}]}).withColumn("out", F.round("out", 6))


@q(EV + "SELECT seq, CASE WHEN k > 80 THEN 'high' WHEN k > 40 THEN 'mid' ELSE 'low' END AS out FROM ev")
def rule_if_chain(spark, d):
    return _rule(spark, d, {"if": [{">": [{"var": "k"}, 80]}, "high", {">": [{"var": "k"}, 40]}, "mid", "low"]})


@q(EV + "SELECT seq, (type IN ('click', 'view') AND (k >= 10 OR NOT (value < 50))) AS out FROM ev")
def rule_boolean_in(spark, d):
    return _rule(spark, d, {"and": [{"in": [{"var": "type"}, ["click", "view"]]}, {"or": [{">=": [{"var": "k"}, 10]}, {"!": {"<": [{"var": "value"}, 50]}}]}]})


@q(EV + "SELECT seq, type || ':' || entity || '#' || k AS out FROM ev")
def rule_concat(spark, d):
    return _rule(spark, d, {"cat": [{"var": "type"}, ":", {"var": "entity"}, "#", {"var": "k"}]})


@q(EV + "SELECT seq, CASE WHEN k <> 0 THEN k ELSE 7 END AS out FROM ev")
def rule_or_returns_operand(spark, d):
    return _rule(spark, d, {"or": [{"var": "k"}, 7]})


@q(EV + "SELECT seq, entity FROM ev WHERE (type = 'error' AND value > 60) OR k % 10 = 0")
def rule_write_rejections(spark, d):
    a = {"effect": "filter", "deps": ["type", "value"], "expr": {"if": [{"and": [{"==": [{"var": "type"}, "error"]}, {">": [{"var": "value"}, 60]}]}, {"reject": ["hot"]}, {"pass": []}]}}
    b = {"effect": "filter", "deps": ["k"], "expr": {"!=": [{"%": [{"var": "k"}, 10]}, 0]}}
    return plain_log(spark, d).where(rules.rejects(a, _all(), {}, "write") | rules.rejects(b, _all(), {}, "write")).select("seq", "entity")


@q(EV + "SELECT seq, list_filter(['low', 'mid', 'high'], lambda o: NOT (k > 50 AND o = 'low') AND NOT (value < 20 AND o = 'high')) AS options FROM ev")
def rule_probe_options(spark, d):
    rule = {"effect": "filter", "deps": ["k", "value", "grade"], "expr": {"and": [{"!": {"and": [{">": [{"var": "k"}, 50]}, {"==": [{"var": "grade"}, "low"]}]}}, {"!": {"and": [{"<": [{"var": "value"}, 20]}, {"==": [{"var": "grade"}, "high"]}]}}]}}
    return views.probe_options(plain_log(spark, d), "grade", ["low", "mid", "high"], [rule], _all()).select("seq", "options")


@q(EV + """, own AS (SELECT entity, list(DISTINCT type) AS keys FROM ev WHERE seq <= 1200 GROUP BY 1) SELECT entity, list_has_all(keys, ['click', 'error']) AS matches FROM own""")
def rule_match_by_keys(spark, d):
    owned = plain_log(spark, d).where("seq <= 1200").groupBy("entity").agg(F.collect_set("type").alias("keys"))
    return owned.select("entity", rules.applies({"deps": ["click", "error"]}, F.col("keys")).alias("matches"))


@q(EV + """, f AS (SELECT seq, entity, row_number() OVER (PARTITION BY entity ORDER BY seq) AS n FROM ev WHERE type = 'error') SELECT seq, entity, n, CASE WHEN n >= 10 THEN 'stop' ELSE 'warn' END AS emitted FROM f WHERE n >= 3""")
def trigger_escalation(spark, d):
    counted = ev.running_count(plain_log(spark, d), "error", "n")
    return counted.where("n >= 3").select("seq", "entity", "n", F.when(F.col("n") >= 10, "stop").otherwise("warn").alias("emitted"))


@q(EV + """, o AS (SELECT *, row_number() OVER (ORDER BY seq DESC) AS n FROM ev WHERE type = 'error') SELECT seq, entity FROM o WHERE n <= 256""")
def rejection_ring(spark, d):
    return plain_log(spark, d).where("type = 'error'").select("seq", "entity").orderBy(F.desc("seq")).limit(256)


@q(EV + "SELECT seq, type, lag(type) OVER (PARTITION BY entity ORDER BY seq) AS before FROM ev")
def log_previous_type(spark, d):
    return plain_log(spark, d).select("seq", "type", F.lag("type").over(W.partitionBy("entity").orderBy("seq")).alias("before"))


@q("SELECT event_id, (props->>'k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN NULL ELSE (props->>'missing') END AS missing FROM events")
def json_lenient(spark, d):
    parsed = F.from_json(F.when(F.col("event_id") % 2 == 0, F.concat("props", F.lit("x")).substr(F.lit(1), F.length("props"))).otherwise(F.col("props")), "k bigint, missing string")
    return table(spark, d, "events").select("event_id", parsed["k"].alias("k"), parsed["missing"].alias("missing"))
