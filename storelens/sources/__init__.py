"""Sources and sinks: the five tables in, materialised reports out."""

from storelens.sources.changes import apply_changes, latest_changes, with_changes  # noqa: F401
from storelens.sources.rejects import ReadResult, coerce_with_rejects, read_with_rejects, reject_counts  # noqa: F401
from storelens.sources.sinks import json_rows, read_report, write_report  # noqa: F401
from storelens.sources.tables import (  # noqa: F401
    KEYS, MONTH, SCHEMA, TABLES, TEXT_TYPES, ShopTables, append_orders, compact_orders, jdbc_options, read_catalog_tables,
    read_jdbc, read_tables, write_bucketed_tables, write_monthly_tables, write_tables)
from storelens.sources.tpch import event_orders, mapping_cte, tables_from_tpch  # noqa: F401
