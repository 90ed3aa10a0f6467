"""SQL that DuckDB answers like the queries, from the same Parquet tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}


def _all(table: str, where: str = "", columns: str = "*") -> str:
    return f"SELECT {columns} FROM {table}" + (f" WHERE {where}" if where else "")


_RANGE = "l_shipdate >= TIMESTAMP '1998-03-01' AND l_shipdate < TIMESTAMP '1999-02-01'"

ORACLE_SQL |= {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
  round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY ALL""",
    "scan_current": _all("orders"),
    "scan_time_travel": _all("orders", "o_orderstatus = 'F'"),
    "scan_as_of": _all("orders", "o_orderstatus IN ('F', 'O')"),
    "scan_unknown_snapshot_count": "SELECT 0::BIGINT AS n",
    "scan_filter_range": _all("lineitem", f"{_RANGE} AND l_quantity < 10"),
    "scan_filter_column": _all("lineitem", "year(l_shipdate) = 1997 AND l_discount > 0.08"),
    "scan_filter_eq": _all("orders", "o_orderpriority = '1-URGENT'"),
    "scan_filter_eq_none_count": "SELECT count(*) AS n FROM orders WHERE o_orderpriority = 'Xenon'",
    "scan_filter_in": _all("orders", "o_orderstatus IN ('F', 'P')"),
    "scan_filter_in_single": _all("orders", "o_orderstatus = 'O'"),
    "scan_filter_in_none_count": "SELECT count(*) AS n FROM orders WHERE o_orderstatus IN ('X', 'Y')",
    "scan_filter_in_empty_count": "SELECT 0::BIGINT AS n",
    "scan_filter_null": _all("events", "event_type = 'error' OR value IS NULL", "event_id, event_type"),
    "scan_projection": _all("orders", "", "o_orderkey, o_totalprice"),
    "scan_row_limit": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
    "scan_row_limit_count": "SELECT least(50, count(*))::BIGINT AS n FROM orders",
    "scan_pruned_file_count": f"""
WITH years AS (SELECT year(l_shipdate) AS y, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY y)
SELECT 'range' AS filter, count(*) AS files FROM years WHERE hi >= TIMESTAMP '1998-03-01' AND lo <= TIMESTAMP '1999-02-01'
UNION ALL SELECT 'or', count(*) FROM years WHERE lo <= TIMESTAMP '1996-01-01' OR hi >= TIMESTAMP '2001-01-01'
UNION ALL SELECT 'none', 0 UNION ALL SELECT 'null', 0 UNION ALL SELECT 'opaque', count(*) FROM years""",
    "scan_files_accessors": """
SELECT o_orderstatus AS status, 'parquet' AS file_format, count(*) AS record_count, 32 AS histogram_bins, 6 AS sketches, true AS sized, true AS named
FROM orders GROUP BY o_orderstatus""",
    "scan_filter_after_schema_change": """
SELECT o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority, o_orderkey
FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice > 100000 AND o_orderkey < 8000""",
    "scan_old_schema": _all("orders", "o_orderstatus = 'F' AND o_custkey < 500", "o_orderkey, o_custkey, o_totalprice, o_orderstatus"),
    "scan_all_versions_after_schema_change": """
SELECT o_totalprice, o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority END AS o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "scan_multi_snapshot_distinct": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "overwrite_scan": _all("orders", "o_orderstatus = 'P'"),
    "append_after_truncate_scan": _all("orders", "o_orderstatus = 'F'"),
    "add_files_scan": "SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderstatus = 'F'",
    "add_files_dedup": "SELECT 3 AS commits, 0::BIGINT AS added, 1::BIGINT AS files, count(*) AS records FROM customer",
    "truncate_and_add_scan": _all("customer"),
    "truncate_summary": """
SELECT 0::BIGINT AS added_files, 1::BIGINT AS deleted_files, 0::BIGINT AS total_files, count(*) AS deleted_records, 0::BIGINT AS total_records,
  0::BIGINT AS total_data_size FROM orders WHERE o_orderstatus = 'P'""",
    "truncate_scan_count": "SELECT 0::BIGINT AS n",
    "refresh_totals": """
SELECT 'statistics-refresh' AS operation, false AS user_created, true AS keeps_message, 'robot' AS agent, count(*) AS records, 1::BIGINT AS files
FROM orders WHERE o_orderstatus = 'P'""",
    "snapshot_log": """
WITH n AS (SELECT count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders)
SELECT 1 AS sequence_number, 'append' AS operation_type, 'ann' AS author, 'commit by ann' AS commit_message, f AS added_records, 0::BIGINT AS deleted_records,
  f AS total_records, 1::BIGINT AS total_files, true AS has_manifest FROM n
UNION ALL SELECT 2, 'append', 'ben', 'open orders', o, 0, f + o, 2, true FROM n
UNION ALL SELECT 3, 'overwrite', 'ann', 'overwrite by ann', p, f + o, p, 1, true FROM n
UNION ALL SELECT 4, 'statistics-refresh', 'robot', 'overwrite by ann', 0, 0, p, 1, true FROM n
UNION ALL SELECT 5, 'truncate', 'ann', 'truncate by ann', 0, p, 0, 0, false FROM n
UNION ALL SELECT 6, 'append', 'ann', 'commit by ann', f, 0, f, 1, true FROM n""",
    "stream_append_scan": _all("orders"),
    "manifest_record_counts": "SELECT o_orderstatus AS status, count(*) AS record_count FROM orders GROUP BY o_orderstatus",
    "manifest_null_counts": """
WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT event_type AS label, unnest(['event_id', 'ts', 'event_type', 'value', 'big']) AS "column",
  unnest([count(*) - count(event_id), count(*) - count(ts), 0, count(*) - count(value), count(*) - count(value > 50)])::BIGINT AS nulls
FROM e GROUP BY event_type""",
    "manifest_minmax": """
WITH o AS (
  SELECT o_orderstatus AS label, o_orderkey AS a, o_custkey AS b, ('0x' || rpad(hex(substr(o_orderstatus, 1, 7)), 14, '0'))::BIGINT AS c,
    floor(o_totalprice)::BIGINT AS d, epoch_us(o_orderdate) AS e, ('0x' || rpad(hex(substr(o_orderpriority, 1, 7)), 14, '0'))::BIGINT AS f FROM orders)
SELECT label, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  unnest([min(a), min(b), min(c), min(d), min(e), min(f)])::BIGINT AS lo, unnest([max(a), max(b), max(c), max(d), max(e), max(f)])::BIGINT AS hi
FROM o GROUP BY label""",
    "manifest_display": """
SELECT c_mktsegment AS label, 'c_custkey' AS "column", min(c_custkey)::VARCHAR AS lo, max(c_custkey)::VARCHAR AS hi FROM customer GROUP BY label
UNION ALL SELECT c_mktsegment, 'c_name', CASE WHEN length(min(c_name)) > 16 THEN substr(min(c_name), 1, 16) || '...' ELSE min(c_name) END,
  CASE WHEN length(max(c_name)) > 16 THEN substr(max(c_name), 1, 16) || '...' ELSE max(c_name) END FROM customer GROUP BY c_mktsegment""",
    "manifest_bytes": """
SELECT o_orderstatus AS label, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  unnest([8 * count(*), 8 * count(*), sum(strlen(o_orderstatus)) + 4 * (count(*) + 1), 8 * count(*), 8 * count(*),
    sum(strlen(o_orderpriority)) + 4 * (count(*) + 1)])::BIGINT AS bytes FROM orders GROUP BY o_orderstatus""",
    "kmv_sketch": """
SELECT h::VARCHAR AS hash FROM (SELECT DISTINCT ('0x' || substr(md5(c_custkey::VARCHAR), 1, 16))::UBIGINT AS h FROM customer) ORDER BY h LIMIT 32""",
    "kmv_merge": """
SELECT h::VARCHAR AS hash FROM (SELECT DISTINCT ('0x' || substr(md5(o_custkey::VARCHAR), 1, 16))::UBIGINT AS h FROM orders) ORDER BY h LIMIT 32""",
    "kmv_cardinality": """
WITH v AS (
  SELECT DISTINCT 'o_orderkey' AS col, o_orderkey::VARCHAR AS x FROM orders UNION ALL SELECT DISTINCT 'o_custkey', o_custkey::VARCHAR FROM orders
  UNION ALL SELECT DISTINCT 'o_orderstatus', o_orderstatus FROM orders UNION ALL SELECT DISTINCT 'o_orderpriority', o_orderpriority FROM orders
  UNION ALL SELECT DISTINCT 'o_totalprice', o_totalprice::DECIMAL(38,6)::VARCHAR FROM orders UNION ALL SELECT DISTINCT 'o_orderdate', epoch_us(o_orderdate)::VARCHAR FROM orders),
h AS (SELECT col, ('0x' || substr(md5(x), 1, 16))::UBIGINT AS h FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY h) AS k FROM h)
SELECT col AS "column", CASE WHEN count(*) < 32 THEN count(*) ELSE floor(31.0::DOUBLE * 18446744073709551616.0::DOUBLE / (max(h)::DOUBLE + 1.0::DOUBLE)) END::BIGINT AS cardinality,
  count(*) < 32 AS cardinality_is_exact FROM r WHERE k <= 32 GROUP BY col""",
    "column_histogram": """
WITH v AS (SELECT o_orderstatus AS label, 'o_orderkey' AS col, o_orderkey AS x FROM orders UNION ALL SELECT o_orderstatus, 'o_custkey', o_custkey FROM orders),
b AS (SELECT label, col, min(x) AS lo, max(x) AS hi FROM v GROUP BY label, col),
n AS (SELECT v.label, v.col, least(31, floor((x::DOUBLE - lo::DOUBLE) / (hi::DOUBLE - lo::DOUBLE) * 31))::INTEGER AS bin, count(*) AS n FROM v JOIN b USING (label, col) GROUP BY ALL)
SELECT b.label, b.col AS "column", g.i::INTEGER AS bin, coalesce(n.n, 0)::BIGINT AS n FROM b, range(32) g(i) LEFT JOIN n ON n.label = b.label AND n.col = b.col AND n.bin = g.i""",
    "bool_histogram": """
SELECT event_type AS label, count(*) FILTER (event_type <> 'error' AND value > 50) AS yes, count(*) FILTER (event_type <> 'error' AND NOT value > 50) AS no FROM events GROUP BY event_type""",
    "manifest_verify": "SELECT 'o_custkey' AS \"column\", 'nulls' AS field, '7' AS stored, '0' AS recomputed",
    "manifest_verify_clean_count": "SELECT 0::BIGINT AS n",
    "manifest_find_file": "SELECT count(*) AS record_count, 6 AS columns FROM orders WHERE o_orderstatus = 'F'",
    "manifest_entry_json": "SELECT o_orderstatus AS status, count(*) AS record_count FROM orders GROUP BY o_orderstatus",
    "column_byte_totals": """
SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  unnest([8 * count(*), 8 * count(*), sum(strlen(o_orderstatus)) + 4 * (count(*) + 3), 8 * count(*), 8 * count(*), sum(strlen(o_orderpriority)) + 4 * (count(*) + 3)])::BIGINT AS bytes
FROM orders""",
    "describe_orders": """
WITH o AS (
  SELECT o_orderkey AS a, o_custkey AS b, o_orderstatus AS s, ('0x' || rpad(hex(substr(o_orderstatus, 1, 7)), 14, '0'))::BIGINT AS c,
    floor(o_totalprice)::BIGINT AS d, epoch_us(o_orderdate) AS e, o_orderpriority AS p, ('0x' || rpad(hex(substr(o_orderpriority, 1, 7)), 14, '0'))::BIGINT AS f FROM orders)
SELECT 'sales.orders' AS dataset, unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS "column",
  count(*) AS row_count, unnest([min(a), min(b), min(c), min(d), min(e), min(f)])::BIGINT AS min, unnest([max(a), max(b), max(c), max(d), max(e), max(f)])::BIGINT AS max,
  0::BIGINT AS null_count,
  unnest([8 * count(*), 8 * count(*), sum(strlen(s)) + 4 * (count(*) + 3), 8 * count(*), 8 * count(*), sum(strlen(p)) + 4 * (count(*) + 3)])::BIGINT AS uncompressed_bytes
FROM o""",
    "describe_events": """
WITH e AS (
  SELECT event_id, epoch_us(ts) AS ts, ('0x' || rpad(hex(substr(event_type, 1, 7)), 14, '0'))::BIGINT AS kind, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)
SELECT unnest(['event_id', 'ts', 'event_type', 'value', 'big']) AS "column", count(*) AS row_count,
  unnest([min(event_id), min(ts), min(kind), min(floor(value)::BIGINT), min((value > 50)::BIGINT)])::BIGINT AS min,
  unnest([max(event_id), max(ts), max(kind), max(floor(value)::BIGINT), max((value > 50)::BIGINT)])::BIGINT AS max,
  unnest([0, 0, 0, count(*) - count(value), count(*) - count(value)])::BIGINT AS null_count FROM e""",
    "describe_after_schema_change": """
WITH o AS (
  SELECT o_orderkey AS k, floor(o_totalprice)::BIGINT AS t, ('0x' || rpad(hex(substr(o_orderstatus, 1, 7)), 14, '0'))::BIGINT AS s,
    CASE WHEN o_orderstatus = 'O' THEN ('0x' || rpad(hex(substr(o_orderpriority, 1, 7)), 14, '0'))::BIGINT END AS p FROM orders WHERE o_orderstatus IN ('F', 'O'))
SELECT unnest(['o_totalprice', 'o_orderstatus', 'o_orderpriority', 'o_orderkey']) AS "column", count(*) AS row_count,
  unnest([min(t), min(s), min(p), min(k)])::BIGINT AS min, unnest([max(t), max(s), max(p), max(k)])::BIGINT AS max,
  unnest([0, 0, count(*) - count(p), 0])::BIGINT AS null_count FROM o""",
    "describe_text_columns": """
SELECT 'c_custkey' AS "column", NULL::VARCHAR AS min_display, NULL::VARCHAR AS max_display UNION ALL SELECT 'c_nationkey', NULL, NULL UNION ALL SELECT 'c_acctbal', NULL, NULL
UNION ALL SELECT 'c_name', substr(min(c_name), 1, 16) || '...', substr(max(c_name), 1, 16) || '...' FROM customer
UNION ALL SELECT 'c_mktsegment', min(c_mktsegment), max(c_mktsegment) FROM customer""",
    "describe_distribution": """
WITH v AS (SELECT o_orderstatus AS label, 'o_orderkey' AS col, o_orderkey AS x FROM orders UNION ALL SELECT o_orderstatus, 'o_custkey', o_custkey FROM orders),
b AS (SELECT label, col, min(x)::DOUBLE AS lo, max(x)::DOUBLE AS hi FROM v GROUP BY label, col),
g AS (SELECT col, min(lo) AS glo, max(hi) AS ghi FROM b GROUP BY col),
n AS (SELECT v.label, v.col, least(31, floor((x::DOUBLE - lo) / (hi - lo) * 31)) AS bin, count(*) AS n FROM v JOIN b USING (label, col) GROUP BY ALL),
p AS (SELECT n.col, least(7, floor((least(lo + (bin::DOUBLE + 0.5::DOUBLE) * ((hi - lo) / 31), hi) - glo) / (ghi - glo) * 8))::INTEGER AS k, n FROM n JOIN b USING (label, col) JOIN g USING (col)),
s AS (SELECT col, k, sum(n) AS n FROM p GROUP BY col, k)
SELECT g.col AS "column", i.i::INTEGER AS bin, coalesce(s.n, 0)::BIGINT AS n FROM g, range(8) i(i) LEFT JOIN s ON s.col = g.col AND s.k = i.i""",
}

# --- sketches: exact while a column has no more distinct values than bins -------------

_BINS = """
raw AS (SELECT 'l_quantity' AS col, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem),
b AS (SELECT col, v, count(*)::DOUBLE AS f FROM raw GROUP BY col, v),
s AS (SELECT *, lead(v) OVER w AS v2, lead(f) OVER w AS f2, row_number() OVER w AS i, coalesce(sum(f) OVER (PARTITION BY col ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b WINDOW w AS (PARTITION BY col ORDER BY v)),
t AS (SELECT col, sum(f) AS total, min(v) AS lo, max(v) AS hi, arg_min(f, v) AS f0, arg_max(f, v) AS fl, count(*) AS k, sum(v * f) / sum(f) AS mean FROM b GROUP BY col)"""

# the estimate of values up to x; the centroids reach from the minimum to the maximum
_UP = """
CASE WHEN x < lo OR x > hi THEN NULL WHEN x = lo THEN 0 WHEN x = hi THEN total ELSE
  (SELECT (s.f + (s.f + (s.f2 - s.f) * ((x - s.v) / (s.v2 - s.v)))) / 2 * ((x - s.v) / (s.v2 - s.v)) + s.before + s.f / 2
   FROM s WHERE s.col = q.col AND s.v < x ORDER BY s.v DESC LIMIT 1) END"""


def _sketch(select: str) -> str:
    return f"WITH {_BINS} {select}"


ORACLE_SQL |= {
    "distogram_bins": _sketch("SELECT col, round(v, 6) AS v, f::BIGINT AS f FROM b"),
    "distogram_count": _sketch("SELECT col, total::BIGINT AS n, k::INTEGER AS bins FROM t"),
    "distogram_bounds": _sketch("SELECT col, round(lo, 9) AS lo, round(hi, 9) AS hi FROM t"),
    # means of a third of a unit of the ninth decimal at least away from a tie
    "distogram_mean": _sketch("SELECT col, round(mean, 9) AS mean FROM t"),
    "distogram_variance": _sketch("SELECT col, round(sum(f * (v - mean) * (v - mean)) / any_value(total), 9) AS variance FROM b JOIN t USING (col) GROUP BY col"),
    "distogram_stddev": _sketch("SELECT col, round(sqrt(sum(f * (v - mean) * (v - mean)) / any_value(total)), 9) AS stddev FROM b JOIN t USING (col) GROUP BY col"),
    "distogram_count_up_to": _sketch(
        f"SELECT col, x, round({_UP}, 6) AS n_up_to FROM (SELECT t.*, unnest([0.0, 0.025, 0.055, 0.1, 1.0, 17.5, 33.25, 50.0, 60.0]::DOUBLE[]) AS x FROM t) q"
    ),
    "distogram_bin_size": _sketch("SELECT col, round(arg_min(f, v), 9) AS size FROM b WHERE v > 0.035 GROUP BY col"),
    "distogram_quantile": _sketch(
        """, q AS (SELECT t.*, unnest([0.0, 0.005, 0.25, 0.5, 0.9, 0.999, 1.0, 1.5]::DOUBLE[]) AS q FROM t),
c AS (SELECT *, floor(total * q) AS c FROM q),
m AS (SELECT col, v, v2, (f + f2) / 2 AS mid, sum((f + f2) / 2) OVER (PARTITION BY col ORDER BY v) AS upto FROM s WHERE v2 IS NOT NULL)
SELECT col, q, round(CASE WHEN q < 0 OR q > 1 THEN NULL WHEN c <= f0 / 2 THEN lo WHEN c >= total - fl / 2 THEN hi ELSE
  (SELECT m.v + ((c - f0 / 2) - (m.upto - m.mid)) / m.mid * (m.v2 - m.v) FROM m WHERE m.col = c.col AND (c - f0 / 2) < m.upto ORDER BY m.v LIMIT 1) END, 6) AS value FROM c"""
    ).replace(" , q AS", ", q AS"),
    "distogram_histogram": _sketch(
        f""", q AS (SELECT t.*, i, CASE WHEN i = 5 THEN hi ELSE lo + (hi - lo) * i::DOUBLE / 5 END AS x FROM t, range(6) r(i)),
u AS (SELECT col, i, x, {_UP} AS up FROM q)
SELECT a.col, a.i::INTEGER AS bin, round(a.x, 6) AS lo, round(z.x, 6) AS hi, round(z.up - a.up, 4) AS n FROM u a JOIN u z ON a.col = z.col AND z.i = a.i + 1"""
    ),
    "distogram_density": _sketch(
        """, u AS (SELECT s.*, CASE WHEN s.i = 1 THEN 0 WHEN s.v = t.hi THEN total ELSE before + f / 2 END AS up FROM s JOIN t USING (col))
SELECT a.col, round(a.v, 6) AS lo, round((z.up - a.up) / (z.v - a.v), 4) AS density FROM u a JOIN u z ON a.col = z.col AND z.i = a.i + 1"""
    ),
    "distogram_grouped": "SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 9) AS mean FROM lineitem GROUP BY l_returnflag",
    "distogram_merge": "SELECT round(l_quantity, 6) AS v, count(*) AS f FROM lineitem GROUP BY l_quantity",
    "distogram_high_cardinality": """
SELECT count(*) AS n, round(min(l_extendedprice), 2) AS lo, round(max(l_extendedprice), 2) AS hi, round(avg(l_extendedprice), 7) AS mean, true AS bounded FROM lineitem""",
    "distogram_roundtrip": _sketch(
        """, m AS (SELECT col, v, v2, (f + f2) / 2 AS mid, sum((f + f2) / 2) OVER (PARTITION BY col ORDER BY v) AS upto FROM s WHERE v2 IS NOT NULL),
c AS (SELECT *, floor(total * 0.5) AS c FROM t)
SELECT col, total::BIGINT AS n, round((SELECT m.v + ((c - f0 / 2) - (m.upto - m.mid)) / m.mid * (m.v2 - m.v) FROM m
  WHERE m.col = c.col AND (c - f0 / 2) < m.upto ORDER BY m.v LIMIT 1), 6) AS median FROM c"""
    ),
}

# --- compaction, catalog, views -----------------------------------------------------

_PLAN = "SELECT {} AS kind, {} AS reason, {} AS files, {}::BIGINT AS mb, {}::VARCHAR AS sort_column"

ORACLE_SQL |= {
    "compaction_plan_brute": _PLAN.format("'combine'", "'small-files'", "'f2,f1'", 90, "NULL"),
    "compaction_plan_performance": _PLAN.format("'combine-split'", "'overlapping-ranges'", "'f1,f2'", 90, "'timestamp'"),
    "compaction_plan_performance_small": _PLAN.format("'combine-split'", "'small-files'", "'f1,f2'", 90, "'timestamp'"),
    "compaction_plan_split": _PLAN.format("'split'", "'file-too-large'", "'f1'", 200, "NULL"),
    "compaction_plan_none": _PLAN.format("'none'", "NULL::VARCHAR", "NULL::VARCHAR", "NULL", "NULL"),
    "compaction_stats": """
SELECT 4::BIGINT AS file_count, 440401920::BIGINT AS total_bytes, 2::BIGINT AS small_file_count, 1::BIGINT AS large_file_count,
  1::BIGINT AS acceptable_file_count, 3200::BIGINT AS rows_per_part""",
    "compaction_preserves_rows": _all("customer"),
    "compaction_disjoint_ranges": "SELECT 0::BIGINT AS overlaps, count(*) AS records FROM customer",
    "compaction_brute_run": "SELECT 'compact' AS operation, false AS user_created, 1::BIGINT AS files, count(*) AS records, count(*) AS scanned FROM customer",
    "scalar_functions": """
SELECT c_custkey, c_mktsegment AS segment, round(c_acctbal, 2) AS balance, NULL::DOUBLE AS no_number, c_mktsegment AS first_part, c_name AS second_part,
  0.0::DOUBLE + (c_custkey::DOUBLE - 0.0::DOUBLE) / 4 * 2 AS middle,
  '{"b":"' || lower(hex(substr(c_mktsegment, 1, 2))) || '","k":' || c_custkey || '}' AS doc FROM customer""",
    "catalog_listing": "SELECT * FROM (VALUES ('col_a', 'dataset', 'nation'), ('col_b', 'view', 'v')) t(collection, kind, name)",
    "dataset_exists_matrix": "SELECT * FROM (VALUES ('sales.orders', true), ('sales,orders', true), ('sales.none', false), ('none.none', false), ('orders', NULL)) t(name, found)",
    "catalog_errors": """
SELECT * FROM (VALUES ('collection again', 'CollectionAlreadyExists', true), ('dataset again', 'DatasetAlreadyExists', true), ('dataset missing', 'DatasetNotFound', true),
  ('dataset without author', 'ValueError', false), ('view again', 'ViewAlreadyExists', true), ('view missing', 'ViewNotFound', true)) t(attempt, error, is_key_error)""",
    "schema_columns": """
SELECT * FROM (VALUES (1, 'id', 'bigint', NULL, NULL::INTEGER, NULL::INTEGER), (2, 'tags', 'array', 'string', NULL, NULL), (3, 'price', 'decimal', NULL, 12, 2),
  (4, 'at', 'timestamp', NULL, NULL, NULL)) t(id, name, type, element_type, precision, scale)""",
    "schema_versions": "SELECT * FROM (VALUES (1, 1, 'ann'), (2, 2, 'ben')) t(version, columns, author)",
    "dataset_metadata": "SELECT 2 AS format_version, 'ids' AS description, 'ben' AS describer, 5 AS retained, 'raw' AS annotations, true AS is_empty, 1 AS next_sequence",
    "view_run": _all("orders", "o_orderpriority = '1-URGENT'", "o_orderkey, o_totalprice"),
    "view_nested": "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey",
    "view_versioned": """
SELECT * FROM (VALUES (1, 'SELECT 1 AS one', 'ann', false, 'first'), (2, 'SELECT 2 AS two', 'ben', true, 'first')) t(version, sql, author, is_current, description)""",
    "view_join_agg": """
SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""",
    "view_window": """
SELECT c_mktsegment, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer""",
    "view_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "view_setops": """
(SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')
EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""",
    "view_semi_anti": "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "view_exec_metadata": "SELECT count(DISTINCT n_regionkey)::INTEGER AS records, true AS timed, true AS dated, 'by region' AS description FROM nation",
    "event_payloads": """
SELECT * FROM (VALUES
  (0, 'create', 'ws', 'col', 'collection', 'col', 1700000000000, '{"properties": {}}'),
  (1, 'create', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{"properties": {}, "schema": {"fields": [{"name": "r_regionkey", "type": "int"}, {"name": "r_name", "type": "string"}]}}'),
  (2, 'create', 'ws', 'col', 'view', 'v', 1700000000000, '{"definition": "SELECT 1 AS one", "properties": {}}'),
  (3, 'execute', 'ws', 'col', 'view', 'v', 1700000000000, '{"execution_time_ms": 1500, "row_count": 100}'),
  (4, 'delete', 'ws', 'col', 'view', 'v', 1700000000000, '{}'),
  (5, 'update', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{"description": "d", "properties": {}}'),
  (6, 'update', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{"file_count": 2, "record_count": 1000, "sequence_number": 5, "snapshot_id": 123}'),
  (7, 'update', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{"description": "d", "properties": {}}'),
  (8, 'update', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{}'),
  (9, 'update', 'ws', 'col', 'dataset', 'nation', 1700000000000, '{"error": "e"}'))
  t(i, action, workspace, collection, resource_type, resource_name, timestamp, data)""",
    "workspace_bytes": """
SELECT 'sales.orders' AS dataset, (32 * count(*) + sum(strlen(o_orderstatus)) + sum(strlen(o_orderpriority)) + 8 * (count(*) + 3))::BIGINT AS total_data_size FROM orders""",
}
