"""For each registered query the same result as DuckDB SQL over the same tables."""

from __future__ import annotations

from ..schema import ORDER_COLUMNS, RECEIVED_AT_LOCAL
from .queries import LOGICAL, RENAMED_AT

_FLAT = """
WITH fl AS (
 SELECT *, n AS n_line_items FROM (
  SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey
   ORDER BY l_linenumber,l_partkey,l_suppkey,l_quantity,l_extendedprice,l_returnflag) AS rn FROM lineitem) WHERE rn=1),
d AS (SELECT n_nationkey k, n_name v FROM nation WHERE n_regionkey<3),
flat AS (
SELECT 'OE-'||o_orderkey AS id, o_orderstatus AS type, o_orderpriority AS "sourceOrderId", c_mktsegment AS "teamId",
 coalesce(CAST(l_partkey AS VARCHAR),'') AS "lineItem_id",
 coalesce(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR),'') AS "lineItem_quantity",
 coalesce(l_returnflag,'') AS "lineItem_quantityUnit",
 coalesce(CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR),'') AS "lineItem_price_amount",
 CASE WHEN l_orderkey IS NULL THEN '' ELSE 'USD' END AS "lineItem_price_currency",
 CASE WHEN o_orderkey%7=0 THEN '' ELSE CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END AS volume_value,
 CASE WHEN o_orderkey%7=0 THEN '' ELSE 'M3' END AS volume_unit,
 'SO'||o_orderkey AS "SO_REF", o_orderstatus AS "CLASS_CODE", '' AS "TRAN_TYPE",
 CASE WHEN o_orderkey%2=0 THEN NULL ELSE 'PO'||o_custkey END AS "CUSTOMER_PO",
 '' AS "TRUCKLOAD_NO", '' AS "LOAD_NO", '' AS "PAYMENT_TERMS", c_name AS "Homebase_Name_info",
 CAST(o_orderkey%10 AS VARCHAR) AS "Loading_Sequence",
 coalesce(h.v,'') AS "homebaseId", coalesce(l.v,'') AS "locationId",
 strftime(o_orderdate,'%Y-%m-%d') AS date, strftime(o_orderdate,'%Y-%m-%d') AS "orderDate", o_orderdate AS received_at
FROM orders JOIN customer ON c_custkey=o_custkey LEFT JOIN fl ON l_orderkey=o_orderkey
LEFT JOIN d h ON h.k=c_nationkey LEFT JOIN d l ON l.k=o_custkey%30)
"""

_LOCAL = "strftime(received_at + INTERVAL 8 HOUR,'%Y-%m-%d %I:%M:%S %p')"
_COLUMNS = ", ".join(f'"{c}"' for c in ORDER_COLUMNS)
_RENAMED = ", ".join(f'"{c}" AS "{LOGICAL.get(c, c)}"' for c in ORDER_COLUMNS)
_JSON = ", ".join(f"'{LOGICAL.get(c, c)}', \"{c}\"" for c in ORDER_COLUMNS)

_ACCEPTED = """
WITH RECURSIVE k AS (SELECT * FROM events WHERE user_id%10<>0), a AS (
 SELECT user_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) rn FROM k) WHERE rn=1
 UNION ALL
 SELECT user_id, event_id, ts FROM (SELECT k.user_id, k.event_id, k.ts,
  row_number() OVER (PARTITION BY k.user_id ORDER BY k.ts,k.event_id) rn
  FROM a JOIN k ON k.user_id=a.user_id AND k.ts>=a.ts+INTERVAL 1 DAY) WHERE rn=1)
"""

_DEDUP = _ACCEPTED + """
SELECT event_id, user_id, ts FROM a UNION ALL SELECT event_id, user_id, ts FROM events WHERE user_id%10=0"""

_INTAKE = _FLAT + f"""
SELECT {_COLUMNS}, {_LOCAL} AS {RECEIVED_AT_LOCAL} FROM flat
UNION ALL
SELECT {_COLUMNS}, strftime(received_at + INTERVAL 38 HOUR,'%Y-%m-%d %I:%M:%S %p') AS {RECEIVED_AT_LOCAL} FROM flat"""

_OK = "e.user_id%10=0 OR a.event_id IS NOT NULL"

_LIVE = """SELECT user_id AS k, event_id AS v FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,event_id DESC) rn FROM events WHERE ts<=TIMESTAMP '2024-01-15')
 WHERE rn=1 AND (event_type='signup' OR TIMESTAMP '2024-01-15'<ts+INTERVAL 1 DAY)"""

_BOARD = """SELECT user_id AS row_no, max_by(event_id,(ts,event_id)) FILTER (event_type='view') AS e,
 max_by(event_id,(ts,event_id)) FILTER (event_type='click') AS f,
 max_by(event_id,(ts,event_id)) FILTER (event_type='purchase') AS g
 FROM events WHERE event_type IN ('view','click','purchase') GROUP BY 1"""

_CELL_TEXT = """CASE p_partkey%7 WHEN 0 THEN '12' WHEN 3 THEN '5.' WHEN 4 THEN '-4' WHEN 6 THEN CAST(p_size AS VARCHAR) END"""

ORACLES: dict[str, str] = {
    "order_flatten": _FLAT + f"SELECT {_COLUMNS}, {_LOCAL} AS {RECEIVED_AT_LOCAL} FROM flat",
    "record_sink_rows": _FLAT + f"SELECT {_RENAMED} FROM flat",
    "record_sink_documents": _FLAT + f"SELECT CAST(json_object({_JSON}) AS VARCHAR) AS record FROM flat",
    "first_line_item": _FLAT + """SELECT l_orderkey AS o_orderkey, l_partkey,
 CAST(l_extendedprice AS DECIMAL(14,2)) AS amount, n_line_items FROM fl WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""",
    "quarantine_routing": """SELECT o_orderkey, CASE o_orderkey%8 WHEN 0 THEN 'accepted' WHEN 1 THEN 'malformed'
 WHEN 2 THEN 'malformed' WHEN 3 THEN 'empty_line_items' WHEN 6 THEN 'malformed' ELSE 'null_object' END AS route FROM orders""",
    "order_intake": _INTAKE,
    "stream_order_intake": _INTAKE,
    "stream_sink_failure": _FLAT + f"SELECT {_COLUMNS}, {_LOCAL} AS {RECEIVED_AT_LOCAL} FROM flat",
    "stream_side_refresh": _FLAT + f"""SELECT {_COLUMNS}, {_LOCAL} AS {RECEIVED_AT_LOCAL} FROM (SELECT * REPLACE (
 CASE WHEN "homebaseId"<>'' AND received_at>=TIMESTAMP '{RENAMED_AT}' THEN "homebaseId"||' (new)' ELSE "homebaseId" END AS "homebaseId",
 CASE WHEN "locationId"<>'' AND received_at>=TIMESTAMP '{RENAMED_AT}' THEN "locationId"||' (new)' ELSE "locationId" END AS "locationId") FROM flat)""",
    "ledger_bucketed": _DEDUP,
    "ragged_quarantine": """SELECT CASE s_suppkey%5 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN s_suppkey||','||s_name||',more'
 ELSE s_suppkey||','||s_name END AS raw, CASE WHEN s_suppkey%5<2 THEN 'ragged' ELSE 'loaded' END AS route FROM supplier""",
    "ttl_evict": """SELECT user_id AS k, event_id AS v, ts AS written_at FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,event_id DESC) rn FROM events WHERE ts<=TIMESTAMP '2024-01-15')
 WHERE rn=1 AND (event_type='signup' OR TIMESTAMP '2024-01-15'<ts+INTERVAL 1 DAY)
 UNION ALL SELECT user_id, event_id, ts FROM events WHERE ts>TIMESTAMP '2024-01-15'""",
    "expiry_offsets": """SELECT o_orderkey, strftime(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)+CASE o_orderkey%4
 WHEN 0 THEN INTERVAL 630 MINUTE WHEN 1 THEN INTERVAL 150 MINUTE WHEN 2 THEN INTERVAL 840 MINUTE END,'%Y-%m-%dT%H:%M:%S') AS expires_at
 FROM orders""",
    "ttl_dedup": _DEDUP,
    "stream_ttl_dedup": _DEDUP,
    "ttl_dedup_hot": """
WITH RECURSIVE a AS (
 SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts,event_id) rn FROM events) WHERE rn=1
 UNION ALL
 SELECT event_type, event_id, ts FROM (SELECT k.event_type, k.event_id, k.ts,
  row_number() OVER (PARTITION BY k.event_type ORDER BY k.ts,k.event_id) rn
  FROM a JOIN events k ON k.event_type=a.event_type AND k.ts>=a.ts+INTERVAL 5 DAY) WHERE rn=1)
SELECT event_type, event_id, event_id IN (SELECT event_id FROM a) AS accepted FROM events""",
    "outcome_rows": _ACCEPTED + f"""
SELECT e.event_id, strftime(e.ts + INTERVAL 8 HOUR,'%Y-%m-%d %I:%M:%S %p') AS date_received,
 CASE WHEN e.user_id%10=0 THEN '' ELSE CAST(e.user_id AS VARCHAR) END AS uploaded_oe,
 CASE WHEN {_OK} THEN 'success' ELSE 'failed' END AS status,
 CASE WHEN {_OK} THEN 'Upload successful' ELSE 'Duplicated OE received. Upload denied.' END AS message,
 CASE WHEN {_OK} THEN 200 ELSE 409 END AS code FROM events e LEFT JOIN a ON a.event_id=e.event_id""",
    "error_log": _ACCEPTED + f"""
SELECT 'intake' AS script_name, strftime(e.ts,'%Y-%m-%d %H:%M:%S') AS logged_at,
 'Duplicated OE '||e.user_id AS description, 'Duplicated OE received' AS message
 FROM events e LEFT JOIN a ON a.event_id=e.event_id WHERE NOT ({_OK})
UNION ALL
SELECT 'intake', strftime(ts,'%Y-%m-%d %H:%M:%S'), 'rejected event '||event_id, event_type FROM events WHERE event_type='error'""",
    "ledger_anti_join": """SELECT DISTINCT e.user_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM events l
 WHERE l.user_id=e.user_id AND l.event_type='purchase' AND l.ts<=TIMESTAMP '2024-01-15' AND TIMESTAMP '2024-01-15'<l.ts+INTERVAL 1 DAY)""",
    "masterdata_lookup": """WITH d AS (SELECT DISTINCT c_nationkey AS k, coalesce(n_name, 'old '||c_nationkey) AS v
 FROM customer LEFT JOIN nation ON n_nationkey=c_nationkey AND n_regionkey<3
 UNION SELECT n_nationkey, n_name FROM nation WHERE n_regionkey<3)
 SELECT c_custkey, coalesce(a.v,'') AS homebase, coalesce(b.v,'') AS location FROM customer
 LEFT JOIN d a ON a.k=c_nationkey LEFT JOIN d b ON b.k=c_custkey%30""",
    "dict_last_wins": "SELECT o_custkey AS k, max_by(o_orderstatus,o_orderkey) AS v FROM orders GROUP BY 1",
    "first_match_wins": "SELECT o_custkey AS k, min_by(o_orderstatus,o_orderkey) AS v FROM orders GROUP BY 1",
    "ttl_cache_lookup": _LIVE,
    "ttl_miss_keys": f"SELECT DISTINCT user_id AS k FROM events WHERE user_id NOT IN (SELECT k FROM ({_LIVE}))",
    "ttl_get_or_compute": f"""WITH live AS ({_LIVE}) SELECT k, v FROM live UNION ALL
 SELECT user_id AS k, count(*) AS v FROM events WHERE event_type='purchase' AND user_id NOT IN (SELECT k FROM live) GROUP BY 1""",
    "ttl_entry_store": """SELECT user_id AS k, event_id AS v FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC,event_id DESC) rn FROM events WHERE ts<=TIMESTAMP '2024-01-15' AND event_id%7<>0)
 WHERE rn=1 AND (event_type='signup' OR TIMESTAMP '2024-01-15'<ts+INTERVAL 1 DAY)""",
    "expiry_normalise": """SELECT o_orderkey, CASE
 WHEN o_orderkey%4=1 AND (month(o_orderdate)<10 OR day(o_orderdate)<10) THEN strftime(o_orderdate,'%Y-%m-%dT23:59:59')
 WHEN o_orderkey%4=2 THEN strftime(o_orderdate+INTERVAL 90 MINUTE,'%Y-%m-%dT%H:%M:%S')
 WHEN o_orderkey%4=3 THEN strftime(o_orderdate+INTERVAL 1 DAY,'%Y-%m-%dT%H:%M:%S')
 ELSE strftime(o_orderdate,'%Y-%m-%dT00:00:00') END AS expires_at FROM orders""",
    "status_board": _BOARD,
    "status_board_incremental": _BOARD,
    "default_fill": """SELECT event_id, CASE WHEN event_id%5=0 THEN NULL WHEN event_id%5=1 THEN ''
 ELSE json_extract_string(props,'$.k') END AS k FROM events""",
    "clean_cells": f"""SELECT p_partkey, {_CELL_TEXT} AS text_value,
 CASE p_partkey%7 WHEN 0 THEN 12 WHEN 6 THEN CAST(p_size AS BIGINT) END AS int_value,
 CASE WHEN p_partkey%7=3 THEN CAST(5.0 AS DOUBLE) END AS float_value FROM part""",
    "clean_payload": """SELECT '{"cr_no":'||p_partkey||',"cr_value":'||
 CASE p_partkey%7 WHEN 0 THEN '12' WHEN 3 THEN '5.0' WHEN 4 THEN '"-4"' WHEN 6 THEN CAST(p_size AS VARCHAR) ELSE 'null' END||
 ',"cr_DateLoaded":"2024-01-'||lpad(CAST(p_partkey%28+1 AS VARCHAR),2,'0')||'T00:00:00Z"}' AS record FROM part""",
    "format_date": "SELECT o_orderkey, strftime(o_orderdate,'%Y-%m-%dT%H:%M:%SZ') AS cr_date FROM orders",
    "received_at_local": """SELECT event_id, strftime(ts+INTERVAL 8 HOUR,'%Y-%m-%d %I:%M:%S %p') AS received_at_local FROM events""",
    "url_param": r"""SELECT page_id, nullif(regexp_extract(url,'[?&]utm_source=([^&#]*)',1),'') AS utm_source,
 nullif(regexp_extract(url,'[?&]ref=([^&#]*)',1),'') AS ref FROM pages""",
    "url_path_groups": r"""SELECT page_id, nullif(regexp_extract(url,'//[^/]+/([\w-]+)/([\w-]+)',1),'') AS g1,
 nullif(regexp_extract(url,'//[^/]+/([\w-]+)/([\w-]+)',2),'') AS g2 FROM pages""",
    "mask_middle": """SELECT c_custkey, CASE WHEN length(c_name)<=6 THEN '...' ELSE left(c_name,3)||'...'||right(c_name,3) END AS masked FROM customer""",
    "project_by_name": "SELECT p_type, p_partkey FROM part",
    "project_by_position": "SELECT c_custkey, c_mktsegment FROM customer",
    "rename_columns": "SELECT s_suppkey AS cr_supplier, s_name AS cr_name, s_nationkey FROM supplier",
    "rows_to_records": """SELECT c_custkey, '{"name":"'||c_name||'","parent":'||
 CASE WHEN c_nationkey=0 THEN 'null' ELSE '"'||c_nationkey||'"' END||'}' AS record FROM customer""",
    "limit_rows": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 9",
    "row_positions": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) + 1 AS _pos FROM orders",
    "range_slice": "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey OFFSET 10",
    "paged_scan": """SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(14,2)) AS price,
 CASE WHEN o_orderkey%5<>3 THEN o_orderkey%2=0 END AS flag FROM orders""",
    "linked_scan": """SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(14,2)) AS price,
 CASE WHEN o_orderkey%5<>3 THEN o_orderkey%2=0 END AS flag, o_orderstatus FROM orders""",
    "linked_scan_notes": """WITH p AS (SELECT row_number() OVER (ORDER BY n)-1 AS i, count(*) OVER () AS c FROM (SELECT DISTINCT o_orderkey//100 AS n FROM orders)),
 l AS (SELECT *, 'https://tables.example.com/api/orders?skip='||md5(CAST(i AS VARCHAR)) AS link FROM p)
 SELECT link||'&stale' AS link, 'unreachable' AS note FROM l UNION ALL SELECT link, 'cyclic' FROM l WHERE i=c-1""",
    "page_union": "SELECT o_orderkey, CASE WHEN o_orderkey%2=0 THEN o_orderstatus END AS o_orderstatus FROM orders",
    "metadata_dictionary": """SELECT c_mktsegment||' '||c_nationkey AS display, max_by(c_name,c_custkey) AS logical
 FROM customer WHERE c_custkey%5<>0 GROUP BY 1""",
    "column_dictionary": """SELECT p_type||' '||p_brand AS display, max_by(p_name||'_'||p_partkey,p_partkey) AS logical
 FROM part WHERE p_size%2=0 GROUP BY 1""",
    "csv_roundtrip": """SELECT CAST(p_partkey AS VARCHAR) AS p_partkey,
 CASE WHEN p_partkey%2=1 THEN p_name||' "x", y'||chr(10)||'z' ELSE p_name END AS p_name FROM part""",
    "csv_split": """SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, CAST(l_partkey AS VARCHAR) AS l_partkey,
 CASE WHEN l_orderkey%3=0 THEN 'said "so",'||chr(10)||l_returnflag||chr(10)||'"" ,'||chr(10)||repeat('x'||chr(10), (l_orderkey%50)::INTEGER)
 ELSE 'plain '||l_orderkey END AS note FROM lineitem""",
    "table_load": """SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name,
 CASE WHEN s_suppkey%3=2 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS s_nationkey FROM supplier""",
    "file_staging": "SELECT CAST(s_suppkey AS VARCHAR) AS s_suppkey, s_name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier",
    "batch_envelope": """SELECT CAST(o_orderkey//500 AS BIGINT) AS batch_id, count(*) AS n_records,
 md5(string_agg('Content-ID: '||(o_orderkey%500)||chr(13)||chr(10)||'{"id":"OE-'||o_orderkey||'"}', chr(13)||chr(10) ORDER BY o_orderkey)) AS body_md5
 FROM orders GROUP BY 1""",
    "batch_export": """SELECT b AS batch_id, count(*) AS n_records, md5(
 '--batch_'||b||crlf||'Content-Type: multipart/mixed; boundary=changeset_'||b||crlf||crlf||
 string_agg('--changeset_'||b||crlf||'Content-Type: application/http'||crlf||'Content-Transfer-Encoding: binary'||crlf||
  'Content-ID: '||(c_custkey%200)||crlf||crlf||'POST https://tables.example.com/api/customers HTTP/1.1'||crlf||
  'Content-Type: application/json'||crlf||crlf||'{"cr_name":"'||c_name||'","cr_nation":'||
  CASE WHEN c_nationkey=0 THEN 'null' ELSE CAST(c_nationkey AS VARCHAR) END||'}', chr(13)||chr(10) ORDER BY c_custkey)||crlf||
 '--changeset_'||b||'--'||crlf||'--batch_'||b||'--') AS body_md5
 FROM (SELECT *, CAST(c_custkey//200 AS BIGINT) AS b, chr(13)||chr(10) AS crlf FROM customer) GROUP BY b, crlf""",
}
