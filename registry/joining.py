"""Joins on keys with nulls and without partners on both sides."""

from __future__ import annotations

from millrace.operators.joins import merge
from millrace.operators.shape import preview
from millrace.plans.runs import join_report

from . import query
from .inputs import SQL_JOIN_LEFT, SQL_JOIN_RIGHT, join_left, join_right, table, with_

_WITH = with_(SQL_JOIN_LEFT, SQL_JOIN_RIGHT)
_KEYS = {"inner": "l.k", "left": "l.k", "right": "r.k", "outer": "coalesce(l.k, r.k)"}
_SIDES = {"inner": "JOIN", "left": "LEFT JOIN", "right": "RIGHT JOIN", "outer": "FULL JOIN"}

for _how, _key in _KEYS.items():
    query(f"join_{_how}", _WITH + f"""
        SELECT {_key} AS k, l.tag AS tag_left, l.c_acctbal, r.tag AS tag_right, r.o_orderkey
        FROM join_left l {_SIDES[_how]} join_right r ON l.k IS NOT DISTINCT FROM r.k""")(
        lambda s, d, h=_how: merge(join_left(s, d), join_right(s, d), "k", "k", h))

query("join_multi_key", """
    SELECT l.l_orderkey, l.l_linestatus, l.l_partkey, l.l_quantity, o.o_orderkey, o.o_orderstatus, o.o_totalprice
    FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND l.l_linestatus = o.o_orderstatus""")(
    lambda s, d: merge(
        table(s, d, "lineitem").select("l_orderkey", "l_linestatus", "l_partkey", "l_quantity"),
        table(s, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"),
        ["l_orderkey", "l_linestatus"], ["o_orderkey", "o_orderstatus"], "left"))

query("join_report", _WITH + """, j AS (
        SELECT 1 FROM join_left l LEFT JOIN join_right r ON l.k IS NOT DISTINCT FROM r.k)
    SELECT (SELECT count(*) FROM join_left) AS left_rows, (SELECT count(*) FROM join_right) AS right_rows,
           (SELECT count(*) FROM j) AS output_rows, CAST(5 AS BIGINT) AS output_cols,
           'k,tag_left,c_acctbal,tag_right,o_orderkey' AS new_columns""")(
    lambda s, d: join_report(join_left(s, d), join_right(s, d), merge(join_left(s, d), join_right(s, d), "k", "k", "left")))

query("join_preview_rows", _WITH + """
    SELECT coalesce(k::VARCHAR, '') AS k, coalesce(tag_left, '') AS tag_left, coalesce(tag_right, '') AS tag_right, o_orderkey::VARCHAR AS o_orderkey
    FROM (SELECT l.k, l.tag AS tag_left, r.tag AS tag_right, r.o_orderkey FROM join_left l JOIN join_right r ON l.k IS NOT DISTINCT FROM r.k
          ORDER BY r.o_orderkey LIMIT 50)""")(
    lambda s, d: preview(merge(join_left(s, d), join_right(s, d), "k", "k", "inner").drop("c_acctbal"), 50, order_by=["o_orderkey"]))
