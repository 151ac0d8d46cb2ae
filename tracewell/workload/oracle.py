"""The workload's queries as SQL over the raw tables, written on its own.

The derived log is spelled out as common table expressions.
"""

from __future__ import annotations


def _dataset(key: str) -> str:
    return f"""CASE {key} % 3
        WHEN 0 THEN 'gcs:bkt' || CAST({key} % 10 AS VARCHAR) || '.d' || CAST({key} AS VARCHAR)
        WHEN 1 THEN 'bigquery:demo.ds' || CAST({key} % 10 AS VARCHAR) || '.t' || CAST({key} AS VARCHAR)
        ELSE 'custom:demo.bkt' || CAST({key} % 10 AS VARCHAR) || '.d' || CAST({key} AS VARCHAR) END"""


LOG = f"""
lin_customer AS (
    SELECT *, CASE c_nationkey % 3 WHEN 0 THEN 'us-east1' WHEN 1 THEN 'us-central1' ELSE 'us' END AS location
    FROM customer
),
lin_process_all AS (
    SELECT 'projects/demo/locations/' || location || '/processes/p' || CAST(c_custkey AS VARCHAR) AS process,
           location, c_custkey, c_nationkey, c_acctbal,
           CASE WHEN c_acctbal >= 0 THEN c_name END AS display_name,
           'batch-' || CAST(c_custkey AS VARCHAR) AS origin_name,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'job_' || CAST(c_nationkey AS VARCHAR) END AS job_id,
           CASE WHEN c_mktsegment IN ('AUTOMOBILE', 'BUILDING')
                THEN 'ns_' || CAST(c_nationkey AS VARCHAR) END AS ol_namespace,
           CASE WHEN c_nationkey < 12 THEN c_mktsegment END AS ol_app_name,
           'app_' || CAST(c_nationkey AS VARCHAR) AS spark_app_name
    FROM lin_customer
),
lin_process AS (SELECT * FROM lin_process_all WHERE c_acctbal >= -900),
lin_order AS (
    SELECT p.process || '/runs/r' || CAST(o_orderkey AS VARCHAR) AS run, p.process, p.location, o_orderkey,
           p.c_custkey, p.c_nationkey, p.c_acctbal, o_orderdate AS start_time, o_orderdate AS end_time,
           CASE WHEN o_orderstatus = 'F' THEN 'COMPLETED' ELSE o_orderstatus END AS state
    FROM orders JOIN lin_process_all p ON o_custkey = p.c_custkey
),
lin_run AS (SELECT * FROM lin_order WHERE c_acctbal <= 9000),
lin_event AS (
    SELECT run || '/lineageEvents/e' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR)
               || '-' || CAST(l_suppkey AS VARCHAR) || '-' || CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS event,
           row_number() OVER () AS record, run, process, location, l_shipdate AS start_time,
           CASE WHEN l_discount = 0 AND l_tax = 0 THEN NULL ELSE {_dataset("l_partkey")} END AS part_fqn,
           {_dataset("l_suppkey")} AS supplier_fqn,
           'bigquery:demo.mart.t' || CAST(c_custkey AS VARCHAR) AS mart_fqn,
           'bigquery:demo.report.t' || CAST(c_nationkey AS VARCHAR) AS report_fqn,
           CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS finished,
           CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS reported,
           CASE WHEN l_returnflag = 'R' THEN l_shipdate + INTERVAL 1 DAY END AS end_time
    FROM lineitem JOIN lin_order ON l_orderkey = o_orderkey
),
lin_link AS (
    SELECT record, event, run, process, start_time, 0 AS link_pos,
           part_fqn AS source_fqn, supplier_fqn AS target_fqn, 'table' AS level FROM lin_event
    UNION ALL
    SELECT record, event, run, process, start_time, 1, supplier_fqn, mart_fqn, 'table'
    FROM lin_event WHERE finished = 1
    UNION ALL
    SELECT record, event, run, process, start_time, 1 + finished, mart_fqn, report_fqn, 'table'
    FROM lin_event WHERE reported = 1
    UNION ALL
    SELECT record, event, run, process, start_time, 2 + finished, mart_fqn || '.pipeline_id',
           report_fqn || '.processing_step', 'column' FROM lin_event WHERE reported = 1
),
lin_entry AS (
    SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS entry_id, {_dataset("p_partkey")} AS fqn
    FROM part WHERE p_size <= 45
    UNION ALL
    SELECT 'mart-' || CAST(c_custkey AS VARCHAR), 'bigquery:demo.mart.t' || CAST(c_custkey AS VARCHAR)
    FROM customer WHERE c_acctbal >= 0
),
batch AS (
    SELECT origin_name AS batch_id FROM lin_process_all
    UNION
    SELECT 'job_' || CAST(c_nationkey AS VARCHAR) FROM customer
),
lin_named AS (
    SELECT event, run, process, start_time, coalesce(source_fqn, 'Unknown_Source') AS source_fqn,
           coalesce(target_fqn, 'Unknown_Target') AS target_fqn, level
    FROM lin_link
),
lin_move AS (SELECT * FROM lin_named WHERE source_fqn <> target_fqn),
batch_process AS (
    SELECT batch_id, process, location FROM (
        SELECT b.batch_id, p.process, p.location, row_number() OVER (
            PARTITION BY b.batch_id
            ORDER BY CASE p.location WHEN 'us-east1' THEN 1 WHEN 'us-central1' THEN 2 ELSE 3 END, p.process
        ) AS n
        FROM batch b JOIN lin_process p
          ON contains(p.origin_name, b.batch_id) OR contains(coalesce(p.job_id, ''), b.batch_id)
    ) hits WHERE n = 1
),
lin_read AS (
    SELECT DISTINCT source_fqn, event, run, process FROM lin_link WHERE source_fqn IS NOT NULL
),
identity_of AS (
    SELECT p.process, p.spark_app_name, coalesce(ol_namespace, 'default') AS namespace,
           coalesce(ol_app_name, spark_app_name) AS app_name, coalesce(ol_namespace, 'demo') AS cluster_namespace
    FROM lin_process p
)"""

PATH = """CASE WHEN {0} LIKE 'gcs:%'
     THEN 'gs://' || regexp_replace(substr({0}, 5), '^([^.]*)\\.', '\\1/') ELSE {0} END"""

STAMP = """CAST('2026-01-{0:02d} 00:00:00' AS TIMESTAMP)"""


def _on_log(query: str) -> str:
    return f"WITH {LOG}\n{query}"


def _first_seen(keys: str, moves: str = "lin_move") -> str:
    return _on_log(f"""
SELECT process, run, event, source_fqn, target_fqn, {PATH.format("source_fqn")} AS source_path,
       {PATH.format("target_fqn")} AS target_path
FROM (
    SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY start_time, event) AS n FROM {moves}
) ranked WHERE n = 1""")


def _identity(namespace: str) -> str:
    return _on_log(f"""
SELECT i.{namespace} AS namespace, app_name, count(DISTINCT i.process) AS processes, count(r.run) AS runs
FROM identity_of i LEFT JOIN lin_run r ON r.process = i.process
GROUP BY i.{namespace}, app_name""")


def _stamped(table: str, pipeline_id: str, day: int = 1) -> str:
    return f"SELECT *, {STAMP.format(day)} AS processed_timestamp, '{pipeline_id}' AS pipeline_id FROM {table}"


def _steps(pairs: str) -> str:
    return f"""
SELECT c.*, CAST('2026-01-0' || CAST(i AS VARCHAR) || ' 00:00:00' AS TIMESTAMP) AS ingestion_timestamp,
       'chain_step_1' AS pipeline_id,
       CAST('2026-01-0' || CAST(j AS VARCHAR) || ' 00:00:00' AS TIMESTAMP) AS processing_timestamp,
       'chain_step_2' AS processing_step
FROM customer c CROSS JOIN (VALUES {pairs}) AS days(i, j)"""


PAGE = """
page AS (
    SELECT page_id, 'gs://' || regexp_replace(url, '^https?://', '') AS path FROM pages
),
page_job AS (
    SELECT *, 'page-' || CAST(page_id AS VARCHAR) AS job_id,
           'projects/demo/locations/us-east1/processes/'
               || md5('page-' || CAST(page_id AS VARCHAR) || '|2026-01-01 00:00:00') AS process,
           CASE WHEN path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END AS stripped
    FROM page
)"""


TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

_NAMES = """
SELECT location, 'process' AS kind, process AS name FROM lin_process
UNION ALL
SELECT location, 'run', run FROM lin_run
UNION ALL
SELECT location, 'event', event FROM lin_event
UNION ALL
SELECT e.location, 'link', e.event FROM lin_link l JOIN lin_event e ON l.record = e.record"""

_NOT_PURGED = """NOT EXISTS (
    SELECT 1 FROM lin_process p WHERE p.process = l.process AND p.location = 'us-east1')"""

_CHAIN = f"""WITH {PAGE}
SELECT process || '/runs/' || md5('Page run') || '/lineageEvents/'
       || md5(concat_ws(chr(10), level, source_fqn, target_fqn)) AS event,
       process || '/runs/' || md5('Page run') AS run, process, 'COMPLETED' AS state, 0 AS link_pos,
       source_fqn, target_fqn, level
FROM (
    SELECT process, 0 AS link_pos, 'gcs:' || replace(replace(stripped, 'gs://', ''), '/', '.') AS source_fqn,
           'bigquery:demo.pages.step1_' || CAST(page_id AS VARCHAR) AS target_fqn, 'table' AS level FROM page_job
    UNION ALL
    SELECT process, 1, 'bigquery:demo.pages.step1_' || CAST(page_id AS VARCHAR),
           'bigquery:demo.pages.step2_' || CAST(page_id AS VARCHAR), 'table' FROM page_job
    UNION ALL
    SELECT process, 2, 'bigquery:demo.pages.step1_' || CAST(page_id AS VARCHAR) || '.pipeline_id',
           'bigquery:demo.pages.step2_' || CAST(page_id AS VARCHAR) || '.processing_step', 'column' FROM page_job
) declared"""


def _paths(start: str, of: str, to: str) -> str:
    """Least depth and least predecessor of all nodes reached along edges from column `of` to column `to`."""
    return (
        _on_log(f"""
, edge AS (
    SELECT DISTINCT {of} AS a, {to} AS b FROM lin_link
    WHERE level = 'table' AND source_fqn IS NOT NULL AND source_fqn <> target_fqn
),
walk(node, depth) USING KEY (node) AS (
    SELECT DISTINCT node, 0 FROM ({start})
    UNION
    SELECT b, min(walk.depth + 1) FROM walk JOIN edge ON walk.node = a
    WHERE b NOT IN (SELECT node FROM recurring.walk)
    GROUP BY b
),
before AS (
    SELECT b, min(a) AS predecessor FROM edge JOIN walk AS x ON x.node = a JOIN walk AS y ON y.node = b
    WHERE x.depth + 1 = y.depth GROUP BY b
)
SELECT node, depth, predecessor FROM walk LEFT JOIN before ON b = node""")
        .replace("\n\n,", ",")
        .replace("WITH", "WITH RECURSIVE", 1)
    )


ORACLE: dict[str, str] = {
    "edges_per_batch": _first_seen("process, source_fqn, target_fqn"),
    "edges_first_seen": _first_seen("source_fqn, target_fqn"),
    "links_by_target": _on_log("""
SELECT target_fqn, source_fqn, count(*) AS links FROM lin_named GROUP BY target_fqn, source_fqn"""),
    "process_by_batch": _on_log("SELECT batch_id, process, location FROM batch_process"),
    "process_runs": _on_log("""
SELECT r.process, r.run, r.state, r.start_time FROM lin_run r JOIN lin_process p ON r.process = p.process"""),
    "batch_events": _on_log("""
SELECT e.run, e.event, 1 + e.finished + 2 * e.reported AS links, r.process, r.state
FROM lin_event e JOIN lin_run r ON e.run = r.run JOIN lin_process p ON r.process = p.process"""),
    "batch_status": _on_log("""
SELECT b.batch_id, f.process, f.location, coalesce(n.events, 0) AS events, coalesce(m.edges, 0) AS edges,
       CASE WHEN f.process IS NULL THEN 'NO_PROCESS' WHEN coalesce(n.events, 0) = 0 THEN 'NO_EVENTS'
            WHEN coalesce(m.edges, 0) = 0 THEN 'ONLY_SELF_READS' ELSE 'OK' END AS status
FROM batch b
LEFT JOIN batch_process f ON b.batch_id = f.batch_id
LEFT JOIN (SELECT process, count(*) AS events FROM lin_event GROUP BY process) n ON f.process = n.process
LEFT JOIN (
    SELECT process, count(*) AS edges FROM (SELECT DISTINCT process, source_fqn, target_fqn FROM lin_move) d
    GROUP BY process
) m ON f.process = m.process"""),
    "runs_by_source": _on_log("""
SELECT r.source_fqn, r.event, r.run, r.process, coalesce(p.display_name, 'N/A') AS display_name,
       coalesce(p.origin_name, 'N/A') AS origin_name
FROM lin_read r LEFT JOIN lin_process p ON r.process = p.process"""),
    "by_table_gated": _on_log("""
SELECT r.source_fqn, r.event, r.run, r.process, coalesce(p.display_name, 'N/A') AS display_name,
       coalesce(p.origin_name, 'N/A') AS origin_name
FROM lin_read r LEFT JOIN lin_process p ON r.process = p.process
WHERE r.source_fqn IN (SELECT target_fqn FROM lin_link WHERE target_fqn IS NOT NULL)"""),
    "run_details": _on_log("""
SELECT DISTINCT e.run, r.state, r.start_time, r.end_time FROM lin_event e LEFT JOIN lin_run r ON e.run = r.run"""),
    "process_identity": _identity("namespace"),
    "process_identity_cluster": _identity("cluster_namespace"),
    "uniqueness_verdict": _on_log("""
, labelled AS (
    SELECT i.*, r.run, first_value(namespace) OVER w AS base_namespace, first_value(app_name) OVER w AS base_app
    FROM identity_of i LEFT JOIN lin_run r ON r.process = i.process
    WINDOW w AS (PARTITION BY spark_app_name ORDER BY run IS NULL, start_time, run, namespace, app_name)
)
SELECT spark_app_name, namespace, app_name, count(run) AS runs,
       CASE WHEN namespace <> base_namespace THEN 'new_namespace'
            WHEN app_name <> base_app THEN 'new_app_name' ELSE 'consolidated' END AS verdict
FROM labelled GROUP BY spark_app_name, namespace, app_name, base_namespace, base_app""").replace("\n\n,", ","),
    "ghost_nodes": _on_log("""
SELECT fqn, count(*) AS links FROM (
    SELECT source_fqn AS fqn FROM lin_link WHERE level = 'table'
    UNION ALL
    SELECT target_fqn FROM lin_link WHERE level = 'table'
) ends
WHERE fqn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lin_entry e WHERE e.fqn = ends.fqn)
GROUP BY fqn"""),
    "edge_visibility": _on_log("""
SELECT visibility, level, count(*) AS edges FROM (
    SELECT level, CASE WHEN target_fqn LIKE 'bigquery:%' THEN 'visible' WHEN target_fqn LIKE 'gcs:%' THEN 'hidden'
                       WHEN level = 'column' THEN 'no_columns'
                       WHEN target_fqn IN (SELECT fqn FROM lin_entry) THEN 'visible' ELSE 'ghost' END AS visibility
    FROM (
        SELECT DISTINCT source_fqn, target_fqn, level FROM lin_link
        WHERE source_fqn IS NOT NULL AND source_fqn <> target_fqn
    ) edges
) classed GROUP BY visibility, level"""),
    "purge_survivors": _on_log("""
SELECT location, 'process' AS kind, process AS name FROM lin_process WHERE location <> 'us-east1'
UNION ALL
SELECT location, 'run', run FROM lin_run r
WHERE NOT EXISTS (SELECT 1 FROM lin_process p WHERE p.process = r.process AND p.location = 'us-east1')
UNION ALL
SELECT location, 'event', event FROM lin_event r
WHERE NOT EXISTS (SELECT 1 FROM lin_process p WHERE p.process = r.process AND p.location = 'us-east1')
UNION ALL
SELECT e.location, 'link', e.event FROM lin_link l JOIN lin_event e ON l.record = e.record
WHERE NOT EXISTS (SELECT 1 FROM lin_process p WHERE p.process = e.process AND p.location = 'us-east1')"""),
    "log_before_purge": _on_log(_NAMES),
    "compacted_log": _on_log(
        _NAMES
        + """
UNION ALL
SELECT e.location, 'link', e.event FROM lin_link l JOIN lin_event e ON l.record = e.record
WHERE e.location = 'us-east1'"""
    ),
    "standing_edges": _first_seen(
        "process, source_fqn, target_fqn", f"(SELECT * FROM lin_move l WHERE {_NOT_PURGED}) left_over"
    ),
    "standing_upstream": _on_log(f"""
SELECT target_fqn, source_fqn, count(*) AS links FROM lin_named l WHERE {_NOT_PURGED} GROUP BY target_fqn, source_fqn"""),
    "standing_ghosts": _on_log(f"""
SELECT fqn, count(*) AS links FROM (
    SELECT unnest([source_fqn, target_fqn]) AS fqn FROM lin_link l WHERE level = 'table' AND {_NOT_PURGED}
) ends
WHERE fqn IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lin_entry e WHERE e.fqn = ends.fqn)
GROUP BY fqn"""),
    "paged_log": _on_log("""
SELECT l.event, link_pos, source_fqn, target_fqn, level, e.end_time
FROM lin_link l JOIN lin_event e ON l.record = e.record"""),
    "lineage_cycles": _on_log("""
, edge AS (
    SELECT DISTINCT source_fqn AS a, target_fqn AS b FROM lin_link
    WHERE level = 'table' AND source_fqn IS NOT NULL AND source_fqn <> target_fqn
),
core AS (SELECT a, b FROM edge WHERE a IN (SELECT b FROM edge) AND b IN (SELECT a FROM edge)),
inside AS (SELECT a, b FROM core WHERE a IN (SELECT b FROM core) AND b IN (SELECT a FROM core)),
way(a, b) AS (SELECT a, b FROM inside UNION SELECT way.a, inside.b FROM way JOIN inside ON way.b = inside.a)
SELECT x.a AS node, min(x.b) AS component FROM way x JOIN way y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
    .replace("\n\n,", ",")
    .replace("WITH", "WITH RECURSIVE", 1),
    "concurrent_entries": """
SELECT 'part-' || CAST(p_partkey AS VARCHAR) AS entry_id, CAST(1 AS BIGINT) AS entries,
       'custom:demo.bkt.parts.' || CAST(p_partkey AS VARCHAR) AS fqn, p_name AS name
FROM part""",
    "registered_datasets": f"""
WITH c AS (
    SELECT table_name AS dataset, CAST(count(*) AS BIGINT) AS columns FROM information_schema.columns
    WHERE table_name IN ({", ".join(f"'{name}'" for name in TABLES)}) GROUP BY table_name
),
r AS ({" UNION ALL ".join(f"SELECT '{name}' AS dataset, count(*) AS rows FROM {name}" for name in TABLES)})
SELECT dataset, rows, columns, CAST(1 AS BIGINT) AS entries FROM r JOIN c USING (dataset)""",
    "purge_counts": _on_log("""
SELECT location, 'process' AS kind, count(*) AS records FROM lin_process GROUP BY location
UNION ALL
SELECT r.location, 'run', count(*) FROM lin_run r JOIN lin_process p ON r.process = p.process GROUP BY r.location
UNION ALL
SELECT e.location, 'event', count(*) FROM lin_event e JOIN lin_process p ON e.process = p.process
GROUP BY e.location"""),
    "graph_nodes": _on_log("""
, ends AS (
    SELECT level, source_fqn AS fqn FROM lin_link UNION ALL SELECT level, target_fqn FROM lin_link
)
SELECT DISTINCT fqn, CASE WHEN level = 'column' THEN 'column' WHEN fqn LIKE 'gcs:%' THEN 'storage'
                          ELSE 'table' END AS kind
FROM ends WHERE fqn IS NOT NULL
UNION
SELECT regexp_replace(fqn, '\\.[^.]*$', ''), 'table' FROM ends WHERE level = 'column'""").replace("\n\n,", ","),
    "graph_edges": _on_log("""
SELECT DISTINCT source_fqn, target_fqn, level AS kind FROM lin_link
WHERE source_fqn IS NOT NULL AND source_fqn <> target_fqn
UNION ALL
SELECT DISTINCT regexp_replace(fqn, '\\.[^.]*$', ''), fqn, 'contains' FROM (
    SELECT source_fqn AS fqn FROM lin_link WHERE level = 'column'
    UNION ALL
    SELECT target_fqn FROM lin_link WHERE level = 'column'
) columns"""),
    "reach": _on_log("""
, edge AS (
    SELECT DISTINCT source_fqn, target_fqn FROM lin_link
    WHERE level = 'table' AND source_fqn IS NOT NULL AND source_fqn <> target_fqn
),
walk(node, depth) USING KEY (node) AS (
    SELECT DISTINCT source_fqn, 0 FROM edge
    WHERE source_fqn LIKE 'gcs:%' AND source_fqn NOT IN (SELECT target_fqn FROM edge)
    UNION
    SELECT target_fqn, min(walk.depth + 1) FROM walk JOIN edge ON walk.node = source_fqn
    WHERE target_fqn NOT IN (SELECT node FROM recurring.walk)
    GROUP BY target_fqn
)
SELECT node, depth FROM walk""")
    .replace("\n\n,", ",")
    .replace("WITH", "WITH RECURSIVE", 1),
    "reach_paths": _paths(
        "SELECT a AS node FROM edge WHERE a LIKE 'gcs:%' AND a NOT IN (SELECT b FROM edge)", "source_fqn", "target_fqn"
    ),
    "reach_upstream": _paths(
        "SELECT a AS node FROM edge WHERE a LIKE 'bigquery:demo.report.%'", "target_fqn", "source_fqn"
    ),
    "emit_links": _on_log("""
SELECT DISTINCT l.event, link_pos, source_fqn, target_fqn, level, e.end_time
FROM lin_link l JOIN lin_event e ON l.record = e.record"""),
    "large_events": f"""
WITH l AS (
    SELECT DISTINCT l_suppkey, CAST(l_orderkey * 10 + l_linenumber AS INTEGER) AS pos, {_dataset("l_partkey")} AS source
    FROM lineitem
)
SELECT 'projects/demo/locations/us/processes/supply/runs/r' || CAST(l_suppkey AS VARCHAR) || '/lineageEvents/e' AS event,
       CAST(1 AS BIGINT) AS records, CAST('2026-01-02 00:00:00' AS TIMESTAMP) AS end_time, count(*) AS links,
       min(pos) AS first_pos, max(pos) AS last_pos, CAST(sum(pos) AS BIGINT) AS sum_pos,
       count(DISTINCT source) AS sources
FROM l GROUP BY l_suppkey""",
    "files_lineage": f"""
SELECT *, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS processed_timestamp, 'second' AS pipeline_id,
       CAST(2 AS BIGINT) AS processes, CAST(2 AS BIGINT) AS runs, CAST(2 AS BIGINT) AS events,
       CAST(2 AS BIGINT) AS entries, CAST(1 AS BIGINT) AS edges
FROM customer""",
    "table_lineage": """
SELECT s.*, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS processed_timestamp, 'suffixed' AS pipeline_id, app_name,
       'default' AS namespace, CAST(n AS BIGINT) AS processes, CAST(n AS BIGINT) AS runs
FROM supplier s CROSS JOIN (VALUES ('app', 2), ('other', 1)) AS apps(app_name, n)""",
    "failed_lineage": """
SELECT *, CAST('2026-01-01 00:00:00' AS TIMESTAMP) AS processed_timestamp, 'copy' AS pipeline_id, false AS recorded
FROM customer""",
    "declared_chain": _CHAIN,
    "delivered_in_parts": _CHAIN,
    "registered_copies": f"""WITH {PAGE},
copied AS (
    SELECT *, 'custom:pages.' || replace(replace(stripped, 'gs://', ''), '/', '.') AS source_fqn,
           'custom:pages.dest.pages.' || CAST(page_id AS VARCHAR) AS target_fqn
    FROM page_job
)
SELECT source_fqn, target_fqn, min(job_id || '-source') OVER (PARTITION BY source_fqn) AS source_entry,
       replace(stripped, 'gs://', '//storage.googleapis.com/') AS source_resource,
       job_id || '-dest' AS target_entry, 'gs://dest/pages/' || CAST(page_id AS VARCHAR) || '/' AS target_path
FROM copied""",
    "entry_upsert": _on_log("""
SELECT entry_id, 'dataset' AS entry_type, fqn FROM lin_entry
UNION ALL
SELECT 'part-' || CAST(p_partkey AS VARCHAR), 'part-entry', 'custom:demo.bkt.parts.' || CAST(p_partkey AS VARCHAR)
FROM part
WHERE NOT EXISTS (SELECT 1 FROM lin_entry e WHERE e.entry_id = 'part-' || CAST(p_partkey AS VARCHAR))"""),
    "record_names": _on_log("SELECT event, run, process FROM lin_event"),
    "fqn_forward": f"""WITH {PAGE},
slashed AS (
    SELECT page_id, path || ending AS path FROM page CROSS JOIN (VALUES (''), ('/'), ('//')) AS endings(ending)
),
clean AS (
    SELECT *, CASE WHEN path LIKE '%/' THEN left(path, length(path) - 1) ELSE path END AS stripped FROM slashed
),
dotted AS (SELECT *, replace(replace(stripped, 'gs://', ''), '/', '.') AS dots FROM clean)
SELECT page_id, path, stripped, 'gcs:' || dots AS gcs, 'custom:demo.' || dots AS custom,
       replace(stripped, 'gs://', '//storage.googleapis.com/') AS resource,
       'bigquery:demo.pages.' || CAST(page_id AS VARCHAR) AS table_name, 'gcs:' || dots || '.html' AS column_name,
       'bigquery:' || path AS plain_identifier, 'gcs:' || dots AS fqn_identifier
FROM dotted""",
    "fqn_to_path": _on_log(f"""
SELECT fqn, {PATH.format("fqn")} AS path FROM (
    SELECT source_fqn AS fqn FROM lin_named UNION SELECT target_fqn FROM lin_named
) names"""),
    "json_field": """
SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.name') AS name FROM events""",
    "stamp_orders": _stamped("orders", "stamp_orders"),
    "overwrite_roundtrip": _stamped("customer", "second"),
    "external_table_roundtrip": _stamped("supplier", "external", 2),
    "table_roundtrip": _stamped("part", "table"),
    "discovered_roundtrip": _stamped("conversations", "discovered"),
    "suffixed_destinations": f"""
SELECT s.*, {STAMP.format(1)} AS processed_timestamp, 'suffixed' AS pipeline_id, suffix
FROM supplier s CROSS JOIN (VALUES ('_baseline'), ('_v2'), ('_explicit')) AS runs(suffix)""",
    "discover_columns": """
SELECT table_name AS dataset, CAST(ordinal_position - 1 AS INTEGER) AS position, column_name,
       CASE WHEN data_type LIKE '%[]' THEN 'array<' || lower(replace(data_type, '[]', '')) || '>'
            WHEN data_type = 'INTEGER' THEN 'int' WHEN data_type = 'VARCHAR' THEN 'string'
            WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp_ntz' ELSE lower(data_type) END AS column_type
FROM information_schema.columns
WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events', 'documents',
                     'embeddings', 'pages', 'benchmark', 'labels', 'conversations')""",
    "two_step_append": _steps("(1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 3)"),
    "two_step_incremental": _steps("(1, 1), (2, 2), (3, 3)"),
    "two_step_by_run": f"""
SELECT *, CASE day(ingestion_timestamp) WHEN 1 THEN 'a' WHEN 2 THEN 'c' ELSE 'b' END AS run_id
FROM ({_steps("(1, 1), (2, 2), (3, 3)")})""",
}
