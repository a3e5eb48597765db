"""A register of queries, and the common tables of their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Book:
    def __init__(self):
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers a function under its name, with its SQL if it has one."""

        def add(f: Callable) -> Callable:
            assert f.__name__ not in self.queries
            self.queries[f.__name__] = f
            if sql is not None:
                self.oracles[f.__name__] = sql
            return f

        return add


EV = """WITH ev AS (SELECT event_id + 1 AS seq, ts, event_type AS type, 'u' || user_id AS entity, user_id, value, (props->>'k')::BIGINT AS k,
    'plant/line' || (user_id % 4) || '/st' || (event_id % 7) AS anchor,
    CASE WHEN event_type = 'error' THEN max(CASE WHEN event_type = 'purchase' THEN event_id + 1 END)
        OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS corrects FROM events),
cells AS (SELECT seq, entity, type AS key, value FROM ev UNION ALL SELECT seq, entity, 'k', k::DOUBLE FROM ev)
"""
BL = """WITH b0 AS (SELECT o_orderkey AS id, (o_custkey % 100)::DOUBLE AS x, (o_orderkey % 100)::DOUBLE AS y, 0::DOUBLE AS z, (1 + o_orderkey % 3)::DOUBLE AS half,
    date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t, o_orderpriority AS payload,
    CASE o_orderstatus WHEN 'F' THEN 'Stable' WHEN 'O' THEN 'Pending' ELSE 'Changing' END AS state, 0.5::DOUBLE + (o_orderkey % 50)::DOUBLE / 100 AS confidence FROM orders),
bl AS (SELECT id, x - half AS min_x, y - half AS min_y, z - half AS min_z, x + half AS max_x, y + half AS max_y, z + half AS max_z, t, payload, state, confidence FROM b0)
"""
VE = """WITH ve AS (SELECT o_custkey AS block_id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE)::BIGINT AS t, o_orderpriority AS payload, o_orderkey AS ord FROM orders),
ver AS (SELECT block_id, (row_number() OVER w)::INTEGER AS version, payload, t AS valid_from, lead(t) OVER w AS valid_to FROM ve WINDOW w AS (PARTITION BY block_id ORDER BY t, ord))
"""
OB = """WITH o0 AS (SELECT 's' || l_suppkey AS anchor, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::BIGINT AS ts, l_partkey % 5 AS source, 0.5::DOUBLE + l_discount AS confidence, l_returnflag, l_linestatus FROM lineitem),
ob AS (SELECT anchor, ts, source, confidence, ts // 30 AS bucket, 'returnflag' AS key, l_returnflag AS value FROM o0
    UNION ALL SELECT anchor, ts, source, confidence, ts // 30, 'linestatus', l_linestatus FROM o0)
"""
PT = """WITH pt AS (SELECT user_id AS id, event_id + 1 AS seq, epoch_us(ts) // 1000 AS t, value AS x, (props->>'k')::DOUBLE AS y FROM events)
"""
ISA = """isa AS (SELECT 'c' || c_custkey AS child, 'n' || c_nationkey AS parent FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)
"""
CS = """WITH cs AS (SELECT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, 'CO_OCCURS' AS type, count(*)::DOUBLE AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)
"""
