"""Queries of what views offer (buttons, actions), of ordered settlement, digests and definition sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronofold.operators import events, settlement
from chronofold.operators.rules import Value
from chronofold.plans import buttons, views
from chronofold.plans.book import EV, Book
from chronofold.sources import journal, snapshots
from chronofold.sources.bindings import plain_log, table

BOOK = Book()
q = BOOK.query

GRADES = {"grade": [1, 2, 3]}
INSPECT = buttons.EventType("inspect", ["grade"], ["k"], {}, [{"id": "R-GRADE", "effect": "filter", "deps": ["click", "grade"], "expr": {"<=": [{"*": [{"var": "grade"}, 30]}, {"+": [{"var": "click"}, 0]}]}}])
RELEASE = buttons.EventType("release", [], ["k", "click", "flag"], {"flag": 1}, [
    {"id": "R-FLAG", "effect": "filter", "deps": ["flag"], "expr": {"==": [{"var": "flag"}, 2]}},
    {"id": "R-K", "effect": "filter", "deps": ["k"], "expr": {"<": [{"+": [{"var": "k"}, 0]}, 50]}},
])
VIEW_PRESETS = {"release": {"flag": 2}}

_LAST = EV + """, last AS (SELECT entity, arg_max(value, seq) FILTER (key = 'click') AS click, arg_max(value, seq) FILTER (key = 'k') AS k FROM cells GROUP BY 1),
    shown AS (SELECT last.* FROM last WHERE entity IN (SELECT entity FROM ev WHERE type IN ('click', 'view')))
"""


@q(_LAST + """, o AS (SELECT *, list_filter(['1', '2', '3'], lambda g: g::INTEGER * 30 <= coalesce(click, 0)) AS grades FROM shown)
    SELECT entity, 'inspect' AS type, len(grades) > 0 AS enabled, CASE WHEN len(grades) = 0 THEN ['no legal value: grade'] ELSE [] END AS reasons, grades, ['k'] AS context, NULL::VARCHAR AS flag FROM o
    UNION ALL SELECT entity, 'release', k < 50, CASE WHEN k < 50 THEN [] ELSE ['R-K'] END, NULL, CASE WHEN click IS NULL THEN ['k'] ELSE ['click', 'k'] END, '2' FROM shown""")
def view_buttons(spark, d):
    rows = views.terminal(plain_log(spark, d), views.View(["click", "view"], ["click", "k"]))
    variables = {"click": Value(F.col("click"), "number"), "k": Value(F.col("k"), "number")}
    each = buttons.with_buttons(rows, [INSPECT, RELEASE], variables, GRADES, VIEW_PRESETS).select("entity", F.explode("buttons").alias("b"))
    return each.select("entity", "b.type", "b.enabled", "b.reasons", F.col("b.options")["grade"].alias("grades"), F.sort_array(F.map_keys("b.context")).alias("context"), F.col("b.presets")["flag"].alias("flag"))


@q("SELECT 0 AS place, 'inspect' AS type, ['1', '2', '3'] AS grades, NULL::VARCHAR AS flag UNION ALL SELECT 1, 'release', NULL, '2'")
def view_actions(spark, d):
    made = buttons.actions(spark, [INSPECT, RELEASE], GRADES, VIEW_PRESETS)
    return made.select("place", "type", F.col("options")["grade"].alias("grades"), F.col("presets")["flag"].alias("flag"))


RULES = [
    {"id": "R-CLICK", "effect": "filter", "on_types": ["click"], "deps": ["click", "purchase"], "expr": {"<=": [{"var": "click"}, {"+": [{"var": "purchase"}, 60]}]}},
    {"id": "R-ERROR", "effect": "filter", "on_types": ["error"], "deps": ["error", "click"], "expr": {"<=": [{"var": "error"}, {"+": [{"var": "click"}, 20]}]}},
]


@q(EV + """, p AS (SELECT seq, entity, type, value, last_value(CASE WHEN type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq) AS bought FROM ev),
    c AS (SELECT *, CASE WHEN type = 'click' THEN value <= coalesce(bought, 0) + 60 END AS clicked FROM p),
    l AS (SELECT *, last_value(CASE WHEN clicked THEN value END IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq) AS click FROM c),
    j AS (SELECT seq AS id, entity, type, CASE WHEN type = 'click' THEN clicked WHEN type = 'error' THEN value <= coalesce(click, 0) + 20 ELSE true END AS accepted FROM l)
    SELECT id, entity, accepted, CASE WHEN NOT accepted THEN 3 END AS layer, CASE WHEN accepted THEN [] WHEN type = 'click' THEN ['R-CLICK'] ELSE ['R-ERROR'] END AS reasons FROM j""")
def settle_ordered(spark, d):
    writes = F.to_json(F.map_from_arrays(F.array("type"), F.array("value")))
    candidates = plain_log(spark, d).select(F.col("seq").alias("id"), "entity", "type", writes.alias("writes"), F.lit(None).cast("string").alias("idempotency_key"))
    return settlement.settle(candidates, RULES)


ALLOWED = {None: ["view", "click", "signup"], "signup": ["view"], "view": ["click", "view"], "click": ["purchase", "view"], "purchase": ["view", "error"], "error": ["view"]}


@q("""WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    a AS (SELECT unnest(['', '', '', 'signup', 'view', 'view', 'click', 'click', 'purchase', 'purchase', 'error']) AS was, unnest(['view', 'click', 'signup', 'view', 'click', 'view', 'purchase', 'view', 'view', 'error', 'view']) AS now),
    r AS (SELECT user_id, NULL::BIGINT AS event_id, NULL::VARCHAR AS type, 0::BIGINT AS n, '' AS held, NULL::BOOLEAN AS accepted FROM (SELECT DISTINCT user_id FROM events)
        UNION ALL SELECT e.user_id, e.event_id, e.type, e.n, CASE WHEN a.now IS NOT NULL THEN e.type ELSE r.held END, a.now IS NOT NULL FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1 LEFT JOIN a ON a.was = r.held AND a.now = e.type)
    SELECT user_id, event_id, type, accepted, nullif(held, '') AS held FROM r WHERE n > 0""")
def state_machine(spark, d):
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("type"))
    return settlement.transitions(rows, "user_id", "event_id", "type", ALLOWED)


@q(EV + """, f AS (SELECT entity, key, arg_max_null(value, seq) AS value, max(seq) AS source_event FROM cells GROUP BY 1, 2),
    t AS (SELECT string_agg(entity || chr(31) || key || chr(31) || floor(value * 100)::BIGINT || chr(31) || source_event || chr(30), '' ORDER BY entity, key) AS s, count(*) AS cells FROM f)
    SELECT cells, printf('%016x', list_reduce(list_transform(string_split(s, ''), lambda c: ascii(c)::UHUGEINT), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT, 14695981039346656037::UHUGEINT)::UBIGINT) AS digest FROM t""")
def projection_digest(spark, d):
    folded = events.fold(events.cells(plain_log(spark, d)))
    return snapshots.ordered_digest(folded, F.floor(F.col("value") * 100).cast("bigint").cast("string"))


_DEFINED = """WITH l AS (SELECT event_id + 1 AS seq, ['attribute', 'type', 'rule', 'view', 'anchor', 'other'][(event_id % 6 + 1)::INTEGER] AS "set", CASE WHEN event_id % 97 = 0 THEN '' ELSE 'd' || user_id END AS key, 'd' || (props->>'k') AS ref, value AS body FROM events),
    s AS (SELECT *, CASE WHEN "set" = 'other' THEN 'unknown set' WHEN key = '' THEN 'no key' END AS r0 FROM l),
    a AS (SELECT key, min(seq) AS since FROM s WHERE r0 IS NULL AND "set" = 'attribute' GROUP BY 1),
    m AS (SELECT s.*, CASE WHEN "set" IN ('type', 'rule') AND (a.since IS NULL OR a.since >= seq) THEN 'unknown ' || ref END AS r1 FROM s LEFT JOIN a ON a.key = s.ref),
    t AS (SELECT key, min(seq) AS since FROM m WHERE r0 IS NULL AND r1 IS NULL AND "set" = 'type' GROUP BY 1),
    v AS (SELECT m.*, coalesce(r0, r1, CASE WHEN "set" = 'view' AND (t.since IS NULL OR t.since >= seq) THEN 'unknown ' || ref END) AS reason FROM m LEFT JOIN t ON t.key = m.ref)
"""


def _definitions(spark, d):
    kind = F.get(F.array(*[F.lit(x) for x in (*journal.SETS, "other")]), (F.col("event_id") % 6).cast("int"))
    user = F.concat(F.lit("d"), F.col("user_id").cast("string"))
    ref = F.concat(F.lit("d"), F.get_json_object("props", "$.k"))
    log = table(spark, d, "events").select((F.col("event_id") + 1).alias("seq"), kind.alias("set"), F.when(F.col("event_id") % 97 == 0, "").otherwise(user).alias("key"), F.col("value").alias("body"), F.array(ref).alias("refs"))
    return journal.settle_definitions(log)


@q(_DEFINED + 'SELECT seq, "set", key, reason IS NULL AS accepted, reason FROM v')
def definitions_settled(spark, d):
    return _definitions(spark, d).select("seq", "set", "key", "accepted", "reason")


@q(_DEFINED + 'SELECT "set", key, arg_max(body, seq) AS body, count(*) AS version, max(seq) AS seq FROM v WHERE reason IS NULL GROUP BY 1, 2')
def definitions_in_force(spark, d):
    return journal.current_sets(_definitions(spark, d)).select("set", "key", "body", "version", "seq")


@q(EV + """SELECT entity, arg_max(value, seq) FILTER (key = 'click') AS click, 7.0::DOUBLE AS k FROM cells GROUP BY 1""")
def fold_preview(spark, d):
    attrs = events.attributes(events.fold(events.cells(plain_log(spark, d))))
    after = events.preview(F.col("attrs"), F.create_map(F.lit("k"), F.lit(7.0)))
    return attrs.select("entity", after["click"].alias("click"), after["k"].alias("k"))
