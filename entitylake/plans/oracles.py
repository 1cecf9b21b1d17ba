"""Independent SQL for the registered queries, over the driver tables."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_SECONDS = "CAST(floor(epoch({0})) AS BIGINT)"


def _seconds(column: str) -> str:
    return _SECONDS.format(column)


def _formula(column: str, time: bool) -> str:
    parts = f"'=DATE(' || year({column}) || ';' || month({column}) || ';' || day({column}) || ')'"
    if time:
        parts += f" || ' + TIME(' || hour({column}) || ';' || minute({column}) || ';' || second({column}) || ')'"
    return parts


# Number as JSON prints it once parsed: no trailing fraction of zero.
_PRICE_TEXT = "regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '')"

ORACLES["envelope_explode"] = f"""
SELECT o_orderkey // 50 + 1 AS page,
       row_number() OVER (PARTITION BY o_orderkey // 50 ORDER BY o_orderkey) - 1 AS pos,
       o_orderkey AS id, o_orderstatus AS status, {_seconds('o_orderdate')} AS updated_at
FROM orders"""

_PAGE_SIZES = f"""
SELECT entity, page, count(*) AS n_rows FROM (
  SELECT 'deals' AS entity, o_orderkey // 50 + 1 AS page FROM orders
  UNION ALL SELECT event_type, {_seconds('ts')} // 3600 FROM events) GROUP BY entity, page"""

ORACLES["page_audit"] = f"""
WITH sizes AS ({_PAGE_SIZES}),
followed AS (SELECT *, lead(page) OVER (PARTITION BY entity ORDER BY page) AS next_page FROM sizes)
SELECT entity, page, n_rows, n_rows = 50 AS has_more, next_page, coalesce(next_page > page + 1, false) AS gap_after
FROM followed"""

ORACLES["page_progress"] = f"""
WITH sizes AS ({_PAGE_SIZES})
SELECT entity, max(page) AS last_page, arg_max(n_rows, page) < 50 AS completed FROM sizes GROUP BY entity"""

ORACLES["union_batches"] = """
SELECT o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS priority FROM orders
UNION ALL SELECT o_orderkey, NULL, o_orderpriority FROM orders
UNION ALL SELECT c_custkey, c_mktsegment, NULL FROM customer"""

ORACLES["expand_relations"] = """
SELECT o_orderkey AS id, 0::BIGINT AS pos, o_custkey AS related_id FROM orders WHERE o_orderstatus IN ('O', 'F')
UNION ALL SELECT o_orderkey, 1, o_custkey + 1 FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, NULL, NULL FROM orders WHERE o_orderstatus NOT IN ('O', 'F')"""

ORACLES["updated_range"] = f"""
SELECT event_id AS id, {_seconds('ts')} AS updated_at, event_type FROM events
WHERE {_seconds('ts')} BETWEEN epoch(TIMESTAMP '2024-01-08') AND epoch(TIMESTAMP '2024-01-15')"""

ORACLES["updated_range_typed"] = f"""
SELECT event_id AS id, {_seconds('ts')} AS updated_at FROM events
WHERE {_seconds('ts')} BETWEEN epoch(TIMESTAMP '2024-01-08') AND epoch(TIMESTAMP '2024-01-15 12:00:00')
  AND event_type <> 'error'"""

ORACLES["point_lookup"] = "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey = 7"

ORACLES["latest_by_id"] = f"""
SELECT user_id AS id, {_seconds('ts')} AS updated_at, event_id, event_type, props FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {_seconds('ts')} DESC, event_id DESC) = 1"""

_LINE_ORDER = (
    "l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)
_LINE_DESC = _LINE_ORDER.replace(",", " DESC,") + " DESC"
_NOTE = "l_linenumber || '/' || l_partkey || '/' || l_suppkey"
_LAST_LINE = f"""
SELECT l_orderkey AS id, l_returnflag || l_linestatus AS status, {_NOTE} AS note FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_DESC}) = 1"""

ORACLES["upsert_by_id"] = f"""
WITH changes AS ({_LAST_LINE})
SELECT coalesce(c.id, o.o_orderkey) AS id,
       CASE WHEN c.id IS NULL THEN o.o_orderstatus ELSE c.status END AS status,
       CASE WHEN c.id IS NULL THEN o.o_orderpriority ELSE c.note END AS note
FROM orders o FULL JOIN changes c ON o.o_orderkey = c.id"""
ORACLES["replay_idempotent"] = ORACLES["upsert_by_id"]

ORACLES["upsert_outcome"] = """
SELECT DISTINCT l_orderkey AS id, CASE WHEN o_orderkey IS NULL THEN 'added' ELSE 'updated' END AS outcome
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus = 'F'"""

ORACLES["merge_fields"] = f"""
WITH carried AS (
  SELECT *, CASE WHEN l_returnflag = 'R' THEN 'returned-' || l_linenumber END AS status,
         CASE WHEN l_linestatus = 'F' THEN {_NOTE} END AS note FROM lineitem),
statuses AS (SELECT l_orderkey, status FROM carried WHERE status IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_DESC}) = 1),
notes AS (SELECT l_orderkey, note FROM carried WHERE note IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_DESC}) = 1),
ids AS (SELECT o_orderkey AS id FROM orders UNION SELECT l_orderkey FROM lineitem)
SELECT id, coalesce(s.status, o_orderstatus) AS status, coalesce(n.note, o_orderpriority) AS note
FROM ids LEFT JOIN orders ON o_orderkey = id LEFT JOIN statuses s ON s.l_orderkey = id
LEFT JOIN notes n ON n.l_orderkey = id"""

ORACLES["replace_all"] = """
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS note, 'open deals' AS delivery
FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, o_orderstatus, o_orderpriority, 'empty' FROM orders"""

ORACLES["replace_stored"] = """
SELECT o_orderkey AS id, o_orderstatus AS status, CASE WHEN o_orderstatus = 'P' THEN 'later' ELSE o_orderpriority END AS note
FROM orders WHERE o_orderstatus IN ('O', 'P')"""
ORACLES["merge_stored"] = ORACLES["merge_fields"]

ORACLES["delete_by_id"] = """
SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS note FROM orders
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')"""

ORACLES["delete_outcome"] = """
SELECT id, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = id AND o_orderstatus = 'P') AS hit
FROM (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R')"""

ORACLES["links_url"] = """
SELECT page_id AS id,
       CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN url ELSE '["' || url || '"]' END AS workbook_url,
       CASE WHEN page_id % 4 = 0 THEN url END AS sheet_url
FROM pages"""

# -- custom fields of deals ---------------------------------------------------------

_PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN '+' || o_orderpriority ELSE o_orderpriority END"
_GUARDED_PRIORITY = "CASE WHEN o_orderkey % 11 = 0 THEN '''+' || o_orderpriority ELSE o_orderpriority END"
_TAGS = "o_orderstatus || ', ' || o_orderpriority"
_TOTAL = f"CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_totalprice AS VARCHAR) ELSE {_PRICE_TEXT} END"
_ORDERED = f"CAST({_seconds('o_orderdate')} AS VARCHAR)"
_ORDERED_CELL = _formula("o_orderdate", False)
_LONG = f"""
SELECT o_orderkey AS id, 0 AS pos, '10' AS field_id, 'Status' AS field_name, 'select' AS field_type,
       o_orderstatus AS workbook_value, o_orderstatus AS sheet_value FROM orders
UNION ALL SELECT o_orderkey, 1, '11', 'Priority', 'text', {_PRIORITY}, {_GUARDED_PRIORITY} FROM orders
UNION ALL SELECT o_orderkey, 2, '12', 'Tags', 'multiselect', {_TAGS}, {_TAGS} FROM orders
UNION ALL SELECT o_orderkey, 3, '13', 'Total', 'numeric', {_TOTAL}, {_PRICE_TEXT} FROM orders
UNION ALL SELECT o_orderkey, 4, '14', 'Ordered', 'date', {_ORDERED}, {_ORDERED_CELL} FROM orders
UNION ALL SELECT o_orderkey, 5, '15', 'Status', 'select',
       CASE WHEN o_orderkey % 6 <> 0 THEN lower(o_orderstatus) END,
       CASE WHEN o_orderkey % 6 <> 0 THEN lower(o_orderstatus) ELSE '' END FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 6 ELSE 5 END, '16', 'price', 'text',
       'override', 'override' FROM orders WHERE o_orderkey % 9 = 0"""

ORACLES["custom_long"] = f"SELECT id, CAST(pos AS BIGINT) AS pos, field_id, field_name, field_type FROM ({_LONG})"
ORACLES["custom_values"] = f"SELECT id, field_id, field_name, workbook_value, sheet_value FROM ({_LONG})"
ORACLES["field_types"] = f"SELECT DISTINCT field_id, field_name, field_type FROM ({_LONG})"
ORACLES["field_profile"] = f"""
SELECT 'deals' AS entity, CAST(7 + count(DISTINCT (field_id, field_name)) AS BIGINT) AS columns,
       count(DISTINCT (field_id, field_name)) AS custom_columns, count(*) AS fields
FROM ({_LONG}) WHERE workbook_value IS NOT NULL
UNION ALL SELECT 'contacts', 6, 1, count(*) FROM customer
UNION ALL SELECT 'companies', 5, 0, 0
UNION ALL SELECT 'events', 6, 0, 0"""

_DEAL_TAGS = """CASE WHEN o_orderstatus = 'P' THEN '[]'
       ELSE '["' || o_orderstatus || '","' || o_orderpriority || '"]' END"""
ORACLES["wide_by_field_id"] = f"""
SELECT o_orderkey AS id, o_custkey AS contact_id, o_totalprice AS price, {_seconds('o_orderdate')} AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN {_seconds('o_orderdate')} ELSE 0 END AS closed_at,
       {_DEAL_TAGS} AS tags, 'https://crm.example/deals/' || o_orderkey AS link_url,
       o_orderstatus AS "custom_Status_10", {_PRIORITY} AS "custom_Priority_11", {_TAGS} AS "custom_Tags_12",
       {_TOTAL} AS "custom_Total_13", {_ORDERED} AS "custom_Ordered_14",
       CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 6 <> 0 THEN lower(o_orderstatus) END AS "custom_Status_15",
       CASE WHEN o_orderkey % 9 = 0 THEN 'override' END AS "custom_price_16"
FROM orders"""
ORACLES["wide_typed"] = f"""
SELECT * REPLACE (round(CAST("custom_Total_13" AS DOUBLE), 2) AS "custom_Total_13",
                  strftime(to_timestamp(CAST("custom_Ordered_14" AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%d') AS "custom_Ordered_14")
FROM ({ORACLES["wide_by_field_id"]})"""
ORACLES["wide_by_name"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 3 = 0 THEN lower(o_orderstatus)
            ELSE o_orderstatus END AS "Status",
       {_GUARDED_PRIORITY} AS "Priority", {_TAGS} AS "Tags", {_PRICE_TEXT} AS "Total", {_ORDERED_CELL} AS "Ordered",
       CASE WHEN o_orderkey % 9 = 0 THEN 'override' ELSE CAST(o_totalprice AS VARCHAR) END AS price,
       CAST(o_custkey AS VARCHAR) AS contact_id, 'https://crm.example/deals/' || o_orderkey AS link_url,
       {_formula("o_orderdate", True)} AS updated_at,
       CASE WHEN o_orderstatus = 'F' THEN {_formula("o_orderdate", True)} ELSE '0' END AS closed_at,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_DEAL_TAGS} END AS tags
FROM orders"""
ORACLES["sheet_rows"] = f"""
SELECT c_mktsegment AS "Segment", CAST(c_custkey AS VARCHAR) AS id,
       'https://crm.example/contacts/' || c_custkey AS link_url, c_name AS name,
       '''+' || c_nationkey || '-' || c_custkey AS phone,
       CASE WHEN c_custkey = 0 THEN '0' ELSE {_formula("to_timestamp(c_custkey * 3600) AT TIME ZONE 'UTC'", True)} END AS updated_at
FROM customer"""
ORACLES["header_union"] = """
SELECT row_number() OVER (ORDER BY key COLLATE "C") - 1 AS pos, key AS header FROM (
  SELECT unnest(['id', 'contact_id', 'price', 'updated_at', 'closed_at', 'tags', '_links']) AS key
  WHERE EXISTS (SELECT 1 FROM orders)
  UNION SELECT unnest(['id', 'name', 'phone', 'updated_at', '_links']) WHERE EXISTS (SELECT 1 FROM customer)
  UNION SELECT unnest(['id', 'name', 'balance', 'updated_at', '_links']) WHERE EXISTS (SELECT 1 FROM supplier)
  UNION SELECT unnest(['id', 'type', 'created_by', 'created_at', 'updated_at', 'props']) WHERE EXISTS (SELECT 1 FROM events)
  UNION SELECT unnest(['Status', 'Priority', 'Tags', 'Total', 'Ordered']) WHERE EXISTS (SELECT 1 FROM orders)
  UNION SELECT 'Segment' WHERE EXISTS (SELECT 1 FROM customer))"""

# -- cells ---------------------------------------------------------------------------

ORACLES["numeric_cells"] = """
SELECT c_custkey AS id, CASE c_custkey % 8
  WHEN 0 THEN regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')
  WHEN 1 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)
  WHEN 2 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR)
  WHEN 3 THEN 'abc' || CAST(floor(c_acctbal) AS BIGINT)
  WHEN 4 THEN CAST(CAST(floor(c_acctbal) AS BIGINT) * 100 AS VARCHAR)
  WHEN 6 THEN (c_custkey + 10000000) || '.25'
  WHEN 7 THEN '0.000' || (c_custkey % 9 + 1) || '5' END AS cell
FROM customer"""

_DAY = "year(ts) || '-' || month(ts) || '-' || day(ts)"
_MIDNIGHT = "date_trunc('day', ts)"
ORACLES["date_cells"] = f"""
SELECT event_id AS id,
  CASE event_id % 7 WHEN 0 THEN {_formula('ts', False)} WHEN 1 THEN {_formula('ts', False)}
    WHEN 2 THEN {_formula('ts', False)} WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN '=DATE(1970;1;1)' END AS date_cell,
  CASE event_id % 7 WHEN 0 THEN {_formula('ts', True)} WHEN 1 THEN {_formula('ts', True)}
    WHEN 2 THEN {_formula(_MIDNIGHT, True)} WHEN 3 THEN {_formula('ts', True)}
    WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN '=DATE(1970;1;1) + TIME(0;0;0)' END AS datetime_cell,
  CASE event_id % 7 WHEN 0 THEN {_formula('ts', True)} WHEN 1 THEN {_formula('ts', True)}
    WHEN 2 THEN {_DAY} WHEN 3 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
    WHEN 4 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 5 THEN '0' END AS top_level_cell
FROM events"""

ORACLES["plus_guard"] = """
SELECT c_custkey AS id, CASE WHEN c_nationkey < 12 THEN '''+' ELSE '' END || c_name AS cell,
       CASE WHEN c_nationkey < 12 THEN '''+' ELSE '' END || c_name AS cell_again
FROM customer"""

_LIST = """'["' || o_orderstatus || '","' || o_orderpriority || '"]'"""
ORACLES["nested_json"] = f"""
SELECT CAST(o_orderkey AS VARCHAR) AS id,
       CASE WHEN o_orderstatus = 'P' THEN '' ELSE {_LIST} END AS tags,
       CASE WHEN o_orderstatus = 'P' THEN '[]' ELSE {_LIST} END AS extra,
       '{{"contact":' || o_custkey || ',"p":"' || o_orderpriority || '"}}' AS main
FROM orders"""

ORACLES["cell_errors"] = f"""
SELECT CAST(event_id AS VARCHAR) AS id,
  CASE WHEN event_type = 'view' THEN 'ERROR: values is not a list' ELSE 'x' END AS "Broken",
  CASE WHEN event_type = 'error' THEN CAST({_seconds('ts')} * 100000000 AS VARCHAR) ELSE {_formula('ts', False)} END AS "Due",
  CASE WHEN event_type = 'error' THEN CAST({_seconds('ts')} * 100000000 AS VARCHAR) ELSE {_formula('ts', True)} END AS updated_at,
  CASE event_type WHEN 'error' THEN 'updated_at,Due' WHEN 'view' THEN 'Broken' ELSE '' END AS "_errors"
FROM events"""

ORACLES["sheet_chunks"] = """
SELECT id, status, rn, rn // 5000 AS chunk, 'Data!A' || (rn // 5000 * 5000 + 2) AS "range" FROM (
  SELECT o_orderkey AS id, o_orderstatus AS status, row_number() OVER (ORDER BY o_orderkey) - 1 AS rn FROM orders)"""

# -- delivery, log, progress ------------------------------------------------------------

ORACLES["empty_placeholder"] = """
SELECT entity, 'No ' || entity || ' data available' AS "Info" FROM (
  SELECT 'deals' AS entity, (SELECT count(*) FROM orders) AS n
  UNION ALL SELECT 'contacts', (SELECT count(*) FROM customer)
  UNION ALL SELECT 'companies', (SELECT count(*) FROM supplier WHERE s_acctbal > 1e9)
  UNION ALL SELECT 'events', (SELECT count(*) FROM events)) WHERE n = 0"""

ORACLES["target_lookup"] = """
SELECT 'deals' AS entity, o_orderkey AS id, 'sheet-deals' AS target FROM orders
UNION ALL SELECT 'contacts', c_custkey, 'sheet-contacts' FROM customer
UNION ALL SELECT 'companies', s_suppkey, 'sheet-companies' FROM supplier
UNION ALL SELECT 'events', event_id, NULL FROM events"""

ORACLES["export_report"] = """
SELECT 'deals' AS entity, 'written' AS status, (SELECT count(*) FROM orders) AS rows, NULL::VARCHAR AS error
UNION ALL SELECT 'contacts', 'written', (SELECT count(*) FROM customer), NULL
UNION ALL SELECT 'companies', 'empty', (SELECT count(*) FROM supplier WHERE s_acctbal > 1e9), NULL
UNION ALL SELECT 'events', 'failed', 0, 'no delivery target for events'"""

ORACLES["workbook_report"] = """
SELECT 'leads' AS entity, 'written' AS status,
       (SELECT count(*) FROM orders WHERE epoch(o_orderdate) >= 2678400) AS rows, NULL::VARCHAR AS error
UNION ALL SELECT 'contacts', CASE WHEN count(*) > 0 THEN 'written' ELSE 'empty' END, count(*), NULL
  FROM customer WHERE c_custkey * 3600 >= 2678400
UNION ALL SELECT 'companies', CASE WHEN count(*) > 0 THEN 'written' ELSE 'empty' END, count(*), NULL
  FROM supplier WHERE s_suppkey * 7200 >= 2678400 AND s_acctbal > 1e9
UNION ALL SELECT 'events', 'written', (SELECT count(*) FROM events WHERE epoch(ts) >= 2678400), NULL"""

ORACLES["logs_recent"] = f"""
SELECT event_id, {_seconds('ts')} AS at, event_type AS component, 'warning' AS level,
       'User ' || user_id || ' did ' || upper(event_type[1]) || event_type[2:] AS message
FROM events
WHERE event_type <> 'error' AND value > 50
  AND regexp_matches('User ' || user_id || ' did ' || event_type, 'user 1.* did', 'i')
ORDER BY ts DESC, event_id DESC LIMIT 30"""

ORACLES["logs_retention"] = f"""
SELECT event_id, {_seconds('ts')} AS at, event_type AS component FROM events WHERE ts >= TIMESTAMP '2024-01-24'"""

ORACLES["entity_stats"] = """
SELECT 'deals' AS entity, count(*) AS n FROM orders
UNION ALL SELECT 'contacts', count(*) FROM customer
UNION ALL SELECT 'companies', count(*) FROM supplier
UNION ALL SELECT 'events', count(*) FROM events
UNION ALL SELECT 'logs', count(*) FROM events"""

ORACLES["webhook_counts"] = """
SELECT event_type, count(*) AS n, false AS is_total FROM events GROUP BY event_type
UNION ALL SELECT NULL, count(*), true FROM events"""

_ROUTE = """CASE event_type WHEN 'click' THEN 'deals' WHEN 'view' THEN 'contacts' WHEN 'signup' THEN 'companies'
  WHEN 'purchase' THEN {purchase} ELSE {other} END"""
_PROGRESS = f"""
SELECT {_ROUTE.format(purchase="'deals'", other="'unknown'")} AS entity,
       CASE WHEN value > 400 THEN 'reset' WHEN user_id % 3 = 0 THEN 'progress'
            WHEN user_id % 3 = 1 OR event_type <> 'view' THEN 'started' ELSE 'stopped' END AS kind,
       event_id // 50 + 1 AS page, event_id % 50 = 49 AS completed, ts, event_id FROM events"""
_STATUS = f"""
WITH progress AS ({_PROGRESS}),
names AS (SELECT unnest(['deals', 'contacts', 'companies', 'events']) AS entity UNION SELECT entity FROM progress),
paged AS (SELECT * FROM progress WHERE kind IN ('progress', 'reset')
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) = 1),
runs AS (SELECT * FROM progress WHERE kind IN ('started', 'stopped')
  QUALIFY row_number() OVER (PARTITION BY entity ORDER BY ts DESC, event_id DESC) = 1)
SELECT n.entity, coalesce(r.kind = 'started', false) AS running,
       coalesce(p.kind = 'progress' AND p.completed, false) AS completed,
       CASE WHEN p.kind = 'progress' THEN p.page ELSE 0 END AS last_page,
       CASE WHEN p.kind = 'progress' THEN {_seconds('p.ts')} END AS last_update
FROM names n LEFT JOIN paged p ON p.entity = n.entity LEFT JOIN runs r ON r.entity = n.entity"""

ORACLES["progress_status"] = _STATUS
ORACLES["resume_point"] = f"SELECT entity, last_page + 1 AS next_page FROM ({_STATUS})"
ORACLES["running_valid"] = f"""
SELECT entity, entity IN (SELECT {_ROUTE.format(purchase="'events'", other="'none'")} FROM events
                          WHERE event_type <> 'error') AS valid
FROM ({_STATUS}) WHERE running"""

# -- change feed --------------------------------------------------------------------------

ORACLES["webhook_route"] = f"""
SELECT event_id AS id, event_type, {_ROUTE.format(purchase="'events'", other="NULL")} AS entity FROM events"""
ORACLES["webhook_stream"] = ORACLES["latest_by_id"]
ORACLES["page_load"] = """
SELECT o_orderkey AS id, o_orderstatus AS status, 'https://crm.example/deals/' || o_orderkey AS link_url,
       o_orderkey // 50 + 1 AS page FROM orders"""
ORACLES["page_load_range"] = f"""
SELECT o_orderkey AS id, {_seconds('o_orderdate')} AS updated_at FROM orders
WHERE {_seconds('o_orderdate')} BETWEEN epoch(TIMESTAMP '1994-01-01') AND epoch(TIMESTAMP '1995-12-31')"""
ORACLES["paged_range"] = f"""
SELECT o_orderkey AS id, o_orderstatus AS status, {_seconds('o_orderdate')} AS updated_at FROM orders
WHERE {_seconds('o_orderdate')} BETWEEN epoch(TIMESTAMP '1994-01-01') AND epoch(TIMESTAMP '1995-12-31')"""
ORACLES["paged_stream"] = f"""
SELECT o_orderkey AS id, o_orderstatus AS status, {_seconds('o_orderdate')} AS updated_at, count(*) AS loads FROM orders GROUP BY ALL"""
ORACLES["load_events"] = """
WITH sizes AS (SELECT o_orderkey // 50 + 1 AS page, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'deals' AS entity, max(page) AS page, arg_max(n < 50, page) AS completed, sum(n)::BIGINT AS documents FROM sizes
UNION ALL SELECT unnest(['contacts', 'companies', 'events']), 0, false, 0"""
ORACLES["snapshot_current"] = f"""
WITH d AS (SELECT o_orderkey AS id, o_orderstatus AS status, {_seconds('o_orderdate')} AS updated_at FROM orders),
before AS (SELECT id, status, updated_at FROM d UNION ALL SELECT id, 'changed', updated_at + 1 FROM d WHERE id % 7 = 0
  UNION ALL SELECT -id, 'new', updated_at + 1 FROM d WHERE id % 11 = 0),
stored AS (SELECT * FROM before WHERE id NOT IN (SELECT id FROM d WHERE id % 13 = 0)
  UNION ALL SELECT id, 'last', updated_at + 2 FROM d WHERE id % 17 = 0
  UNION ALL SELECT id, 'stale', updated_at - 1 FROM d WHERE id % 19 = 0)
SELECT id, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM stored GROUP BY id"""
ORACLES["highwater_resume"] = f"""
WITH d AS (SELECT o_orderkey AS id, o_orderstatus AS status, {_seconds('o_orderdate')} AS updated FROM orders),
newest AS (SELECT max(updated) AS mark FROM d)
SELECT id, CASE WHEN id % 7 = 0 THEN 'changed' ELSE status END AS status,
       CASE WHEN id % 7 = 0 THEN mark + 1 + id ELSE updated END AS updated_at,
       CASE WHEN id % 7 = 0 OR updated = mark THEN 2 ELSE 1 END::BIGINT AS loads FROM d, newest"""
ORACLES["highwater_marks"] = f"""
SELECT 'deals' AS entity, max({_seconds('o_orderdate')}) AS mark, 2::BIGINT AS loads FROM orders
UNION ALL SELECT 'events', max({_seconds('ts')}), 2 FROM events"""
ORACLES["logs_expired"] = f"""
SELECT event_id, {_seconds('ts')} AS at, event_type AS component,
       CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'info' END AS level
FROM events WHERE ts >= TIMESTAMP '2024-01-24 12:00:00'"""
ORACLES["stored_export"] = f"""
SELECT CAST(id AS VARCHAR) AS id, regexp_replace(CAST(price AS VARCHAR), '\\.0$', '') AS price,
       CASE WHEN id % 7 <> 0 THEN CAST(updated_at AS VARCHAR) END AS updated_at, link_url,
       "custom_Status_10", "custom_Priority_11", "custom_Tags_12", "custom_Total_13", "custom_Ordered_14",
       "custom_Status_15", "custom_price_16" FROM ({ORACLES["wide_by_field_id"]})"""
_KINDS = ", ".join(f"'{verb}_{noun}'" for verb in ("add", "delete", "update") for noun in ("company", "contact", "event", "lead"))
ORACLES["webhook_reload"] = f"""
WITH kinds AS (SELECT event_id, ([{_KINDS}, 'unknown_lead'])[event_id % 13 + 1] AS event_type FROM events),
routed AS (SELECT *, CASE split_part(event_type, '_', 2) WHEN 'lead' THEN 'deals' WHEN 'contact' THEN 'contacts'
  WHEN 'company' THEN 'companies' ELSE 'events' END AS entity FROM kinds WHERE event_type <> 'unknown_lead')
SELECT entity, event_type, count(*) AS n FROM routed GROUP BY ALL
UNION ALL SELECT NULL, 'unknown_lead', count(*) FROM kinds WHERE event_type = 'unknown_lead' HAVING count(*) > 0
UNION ALL SELECT 'deals', 'row', o_orderkey FROM orders
WHERE o_orderkey NOT IN (SELECT event_id FROM routed WHERE event_type = 'delete_lead')"""
ORACLES["load_traces"] = """
WITH sizes AS (SELECT o_orderkey // 50 + 1 AS page, count(*) AS n FROM orders GROUP BY ALL)
SELECT 'deals' AS entity, max(page) AS page, arg_max(n < 50, page) AS completed, NULL::VARCHAR AS message FROM sizes
UNION ALL SELECT unnest(['contacts', 'companies', 'events']), 0, false, NULL
UNION ALL SELECT 'load', NULL, NULL, 'Loaded ' || n || ' deals of page ' || page FROM sizes"""

ORACLES["webhook_replay"] = f"""
SELECT entity, event_type, CAST(id AS VARCHAR) AS object_id, count(*) AS n FROM ({ORACLES["webhook_route"]}) GROUP BY ALL"""
