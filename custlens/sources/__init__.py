"""Sources and sinks: fixture adapter, Parquet/JDBC scans, persisted fact, exports."""

from custlens.sources.fixture import ADAPTER_SQL, fixture_sources
from custlens.sources.scans import (
    jdbc_sources,
    parquet_sources,
    scan_order_lines,
    scan_orders,
    scan_packs,
    scan_sources,
    source_row_counts,
)
from custlens.sources.store import (
    expire_snapshots,
    load_or_build,
    read_export,
    read_fact,
    refresh_fact,
    write_fact,
    write_table,
)

__all__ = [
    "ADAPTER_SQL",
    "expire_snapshots",
    "fixture_sources",
    "jdbc_sources",
    "load_or_build",
    "parquet_sources",
    "read_export",
    "read_fact",
    "refresh_fact",
    "scan_order_lines",
    "scan_orders",
    "scan_packs",
    "scan_sources",
    "source_row_counts",
    "write_fact",
    "write_table",
]
