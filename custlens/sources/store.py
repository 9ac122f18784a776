"""The persisted fact (S11-S13) in snapshots, and table sinks for exports.

A stored fact is a folder:

    data/<write>/lines/OrderMonth=2001-03-01/*.parquet    the order lines of the months written
    data/<write>/orders/OrderMonth=2001-03-01/*.parquet   their order-level rollup
    data/<write>/customers/*.parquet                      customer attribute rows of the snapshot
    data/<write>/staged/*.parquet                         narrow lines while the fact is written
    manifests/<n>/                                        the files of snapshot n, with rows and bytes
    commits/<n>/                                          one row, written last: snapshot n is complete;
                                                          what it holds and the folders of its months

Every write goes to a folder of its own name, so nothing that a reader uses is touched;
the commit row makes it visible.  A write that is killed leaves the last snapshot as it
was.  :func:`refresh_fact` writes only the months that new rows fall into and takes the
files of the other months over into the new manifest.
"""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from typing import TYPE_CHECKING

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType

from custlens.config import Params
from custlens.functions.dates import month_start
from custlens.functions.text import normalize_key
from custlens.operators.conform import conform_fact
from custlens.operators.rollup import ATTRIBUTES, ROLLUP_KEYS, attribute_rows, order_rollup
from custlens.schemas import FACT
from custlens.sources import files
from custlens.sources.scans import scan_order_lines, scan_orders

if TYPE_CHECKING:
    from custlens.plans.context import Analysis

log = logging.getLogger(__name__)

PARTITION_COLUMN = "OrderMonth"
_MONTH = StructField(PARTITION_COLUMN, DateType(), True)
ROLLUP = StructType(
    [StructField(c, DateType() if c == "Date" else StringType(), True) for c in ROLLUP_KEYS]
    + [StructField(c, DoubleType(), True) for c in ("Revenue", "Cost", "WeightLb")]
    + [StructField("ShipDate", TimestampNTZType(), True), StructField("Lines", LongType(), True)])
TABLES = {
    "lines": StructType([*FACT.fields, _MONTH]),
    "orders": StructType([*ROLLUP.fields, _MONTH]),
    "customers": StructType([StructField(c, StringType(), True) for c in ("CustomerId", *ATTRIBUTES)]),
}
MANIFEST_DDL = f"file string, folder string, {PARTITION_COLUMN} date, n_rows bigint, n_bytes bigint"
COMMIT_DDL = ("snapshot int, fetch_start date, fetch_end date, packed_status string, n_rows bigint, "
              "first_month date, last_month date, written_months int, "
              "folders array<struct<tbl:string,folder:string,month:date>>")
# Rows of a month lie sorted by customer, and the files carry Bloom filters of the ids, so
# a drilldown into one customer skips files, row groups and pages.
BLOOM_OPTIONS = {"parquet.bloom.filter.enabled#CustomerId": "true", "parquet.bloom.filter.expected.ndv#CustomerId": "20000"}

# Whether a join's shuffle must go by all of its keys, or may keep one by some of them.
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _write(df: DataFrame, folder: str, options: dict[str, str]) -> None:
    """The rows partitioned by order month; as they lie, if they have the month already
    (:func:`build_fact` with ``by_month``).

    The ``rebalance`` hint clusters rows by month and lets AQE cut the shuffle output
    into advisory-size partitions: a large month is split over several tasks (no skew),
    small months are coalesced, so each task writes few, well-sized files instead of one
    file per task and month.
    """
    clustered = PARTITION_COLUMN in df.columns
    df = df.withColumn(PARTITION_COLUMN, month_start(F.col("Date")))
    if not clustered:
        df = df.hint("rebalance", PARTITION_COLUMN)
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CO_PARTITION)
    try:
        if clustered:  # else the last join would spread each month over all tasks
            conf.set(CO_PARTITION, "false")
        df.sortWithinPartitions(PARTITION_COLUMN, "CustomerId").write.options(**options).partitionBy(
            PARTITION_COLUMN).parquet(folder)
    finally:
        conf.set(CO_PARTITION, before)


def _listed(spark: SparkSession, root: str, table: str, folders: list[str], manifest: bool) -> DataFrame:
    """Files of a table's folders; for a manifest with their rows (from their footers)."""
    name = F.regexp_extract("_metadata.file_path", f"/(data/[^/]+/{table}/.*)$", 1).alias("file")
    if not manifest:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
            [f"{root}/{f}" for f in folders])
        return found.select(name, F.col("_metadata.file_size").alias("n_bytes"))
    (folder,) = folders
    rows = spark.read.schema(TABLES[table]).parquet(f"{root}/{folder}")
    month = F.col(PARTITION_COLUMN) if _MONTH in TABLES[table].fields else F.lit(None).cast("date")
    return rows.groupBy(name, F.col("_metadata.file_size").alias("n_bytes"), month.alias(PARTITION_COLUMN)).agg(
        F.count(F.lit(1)).alias("n_rows")).select(
        "file", F.lit(folder).alias("folder"), PARTITION_COLUMN, "n_rows", "n_bytes")


def _commits(spark: SparkSession, path: str) -> list[int]:
    return [int(n) for n in files.names(spark, f"{path}/commits") if files.exists(spark, f"{path}/commits/{n}/_SUCCESS")]


def _manifest(spark: SparkSession, path: str, snapshot: int) -> DataFrame:
    return spark.read.schema(MANIFEST_DDL).parquet(f"{path}/manifests/{snapshot}")


def _commit(spark: SparkSession, path: str, manifest: DataFrame, folders: list[tuple], params: Params, written: int) -> int:
    """The next snapshot; fails if another writer took its number."""
    taken = files.names(spark, f"{path}/manifests") + files.names(spark, f"{path}/commits")
    snapshot = max((int(n) for n in taken), default=0) + 1
    manifest.coalesce(8).write.parquet(f"{path}/manifests/{snapshot}")
    lines = F.col("file").contains("/lines/")
    n_rows = _manifest(spark, path, snapshot).agg(F.coalesce(F.sum(F.when(lines, F.col("n_rows"))), F.lit(0))).first()[0]
    months = sorted(m for t, _, m in folders if t == "lines" and m is not None)
    span = (months[0], months[-1]) if months else (None, None)
    row = (snapshot, params.fetch_start, params.fetch_end, params.packed_status, n_rows, *span, written, sorted(folders, key=str))
    spark.createDataFrame([row], COMMIT_DDL).coalesce(1).write.json(f"{path}/commits/{snapshot}")
    log.info("snapshot %d of %s: %d rows, months %s to %s, %d months written", snapshot, path, n_rows, *span, written)
    return snapshot


def _written_folders(spark: SparkSession, path: str, write: str) -> list[tuple]:
    """(table, folder, month) of a write: one per table and month."""
    out = []
    for table in ("lines", "orders"):
        for name in files.names(spark, f"{path}/{write}/{table}"):
            if name.startswith(f"{PARTITION_COLUMN}="):
                value = name.split("=", 1)[1]
                month = None if value.startswith("__") else dt.date.fromisoformat(value)
                out.append((table, f"{write}/{table}/{name}", month))
    return out


def _stage(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _new_write(spark: SparkSession, path: str, fact: DataFrame | Analysis, options: dict[str, str]) -> tuple[str, DataFrame]:
    """Lines and their rollup in a new data folder; returns it with the files' rows.

    An analysis builds its fact here and stages lines in the folder until they are written.
    """
    write = f"data/{uuid.uuid4().hex}"
    staged = f"{path}/{write}/staged"
    if not isinstance(fact, DataFrame):
        fact = fact.staged_fact(lambda df: _stage(df, staged))
    months = [PARTITION_COLUMN] if PARTITION_COLUMN in fact.columns else []
    _write(fact.select(*FACT.fieldNames(), *months), f"{path}/{write}/lines", {**BLOOM_OPTIONS, **options})
    files.remove(spark, staged)
    # The rollup is made from the lines just written: the fact's joins run once.
    lines = spark.read.schema(TABLES["lines"]).parquet(f"{path}/{write}/lines").drop(PARTITION_COLUMN)
    _write(order_rollup(conform_fact(lines)), f"{path}/{write}/orders", options)
    new = _listed(spark, path, "lines", [f"{write}/lines"], True).unionByName(
        _listed(spark, path, "orders", [f"{write}/orders"], True))
    return write, new


def _finish(spark: SparkSession, path: str, write: str, manifest: DataFrame, folders: list[tuple], params: Params, written: int) -> int:
    """Adds the snapshot's customer attributes, from its rollup, and commits.

    ``folders`` are the (table, folder, month) of lines and rollup in the snapshot.
    """
    orders = _read(spark, path, "orders", [f for t, f, _ in folders if t == "orders"])
    attribute_rows(orders).write.parquet(f"{path}/{write}/customers")
    whole = manifest.unionByName(_listed(spark, path, "customers", [f"{write}/customers"], True))
    return _commit(spark, path, whole, [*folders, ("customers", f"{write}/customers", None)], params, written)


def write_fact(fact: DataFrame | Analysis, path: str, params: Params | None = None, options: dict[str, str] | None = None) -> int:
    """The whole fact, or that of an analysis, as the next snapshot; returns its number.

    ``params`` are recorded: what fetch range and order status the fact holds.  Without
    them the snapshot can be read but covers no request.
    """
    path = path.rstrip("/")
    spark = fact.sparkSession if isinstance(fact, DataFrame) else fact.spark
    write, new = _new_write(spark, path, fact, options or {})
    folders = _written_folders(spark, path, write)
    months = sum(t == "lines" for t, _, _ in folders)
    return _finish(spark, path, write, new, folders, params or Params(packed_status=None), months)


def _read(spark: SparkSession, path: str, table: str, folders: list[str]) -> DataFrame:
    """Month folders of a table, which may lie in the data folders of several writes."""
    if not folders:
        return spark.createDataFrame([], TABLES[table])
    by_write: dict[str, list[str]] = {}
    for f in folders:
        by_write.setdefault(f.split(f"/{table}")[0], []).append(f)
    parts = [spark.read.schema(TABLES[table]).option("basePath", f"{path}/{w}/{table}").parquet(*[f"{path}/{f}" for f in sorted(fs)])
             for w, fs in sorted(by_write.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _folders(info: dict, table: str, start: dt.date | None, end: dt.date | None) -> list[str]:
    """Folders of a table's months in the range."""
    out = []
    for f in info["folders"]:
        if f["tbl"] != table:
            continue
        if f["month"] is None:
            inside = table == "customers" or (start is None and end is None)
        else:
            inside = (start is None or f["month"] >= start.replace(day=1)) and (end is None or f["month"] <= end.replace(day=1))
        if inside:
            out.append(f["folder"])
    return sorted(out)


def _in_range(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(PARTITION_COLUMN) >= F.lit(start.replace(day=1)))
    if end is not None:
        df = df.where(F.col(PARTITION_COLUMN) <= F.lit(end.replace(day=1)))
    return df.drop(PARTITION_COLUMN)


def last_snapshot(spark: SparkSession, path: str) -> int:
    commits = _commits(spark, path.rstrip("/"))
    if not commits:
        raise FileNotFoundError(f"there is no stored fact at {path}")
    return max(commits)


def open_snapshot(spark: SparkSession, path: str, snapshot: int | None = None) -> dict:
    """The commit row of a snapshot (the last one by default); raises if there is none."""
    path = path.rstrip("/")
    snapshot = snapshot or last_snapshot(spark, path)
    return spark.read.schema(COMMIT_DDL).json(f"{path}/commits/{snapshot}").first().asDict()


def read_table(spark: SparkSession, path: str, table: str, start: dt.date | None = None, end: dt.date | None = None,
               snapshot: int | None = None, info: dict | None = None) -> DataFrame:
    """``lines``, ``orders`` or ``customers`` of a snapshot (the last one by default).

    A date range opens only the folders of its months.  ``info`` is the snapshot's row
    where the caller has it already.
    """
    path = path.rstrip("/")
    info = info or open_snapshot(spark, path, snapshot)
    df = _read(spark, path, table, _folders(info, table, start, end))
    return df if table == "customers" else _in_range(df, start, end)


def read_fact(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None,
              snapshot: int | None = None) -> DataFrame:
    """The lines of the persisted fact with their declared schema."""
    return read_table(spark, path, "lines", start, end, snapshot)


def fact_info(spark: SparkSession, path: str, snapshot: int | None = None) -> dict | None:
    """What the fact at ``path`` holds; None without a complete snapshot."""
    try:
        return open_snapshot(spark, path, snapshot)
    except (FileNotFoundError, PySparkException):
        return None


def fact_covers(spark: SparkSession, path: str, params: Params) -> bool:
    """True when the fact at ``path`` has all rows that ``params`` would fetch and the
    files of the report's months are there as the manifest says.

    Names and sizes are compared with a listing of those months; no file is opened.
    """
    path = path.rstrip("/")
    info = fact_info(spark, path)
    if info is None or info["packed_status"] != params.packed_status:
        return False
    if info["fetch_start"] > params.fetch_start or info["fetch_end"] < params.fetch_end:
        return False
    try:
        manifest = _manifest(spark, path, info["snapshot"])
        for table in TABLES:
            folders = _folders(info, table, params.start, params.end)
            if not folders:
                continue
            wanted = manifest.where(F.regexp_extract("file", "(.*)/", 1).isin(folders)).select("file", "n_bytes")
            if not wanted.join(_listed(spark, path, table, folders, False), ["file", "n_bytes"], "left_anti").isEmpty():
                log.warning("the stored fact at %s lacks files of its manifest", path)
                return False
    except Exception as e:  # whatever a broken folder raises in its reader
        log.warning("cannot read the stored fact at %s: %s", path, type(e).__name__)
        return False
    return True


def require_covered(spark: SparkSession, path: str, params: Params) -> None:
    """Raises unless the stored fact holds all rows of the request."""
    if not fact_covers(spark, path, params):
        info = fact_info(spark, path)
        have = "no complete snapshot" if info is None else (
            f"orders '{info['packed_status']}' fetched from {info['fetch_start']} to {info['fetch_end']}")
        raise ValueError(f"the fact at {path} holds {have}; the request needs '{params.packed_status}' from "
                         f"{params.fetch_start} to {params.fetch_end}; give a source to rebuild it")


def load_or_build(spark: SparkSession, path: str, build, params: Params, rebuild: bool = False) -> DataFrame:
    """Read the persisted fact if it covers ``params``, else build (a fact, or the
    analysis that has it), write, read back.

    A fact that was built for a narrower fetch range or another order status, or whose
    files are incomplete, is rebuilt; a wider one is read.  The months of the report range
    bound what is read.
    """
    ensure_fact(spark, path, build, params, rebuild)
    return read_fact(spark, path, params.start, params.end)


def ensure_fact(spark: SparkSession, path: str, build, params: Params, rebuild: bool = False) -> None:
    """Builds and writes the fact unless the stored one covers ``params``."""
    if rebuild or not fact_covers(spark, path, params):
        write_fact(build(), path, params)


def affected_months(raw: dict[str, DataFrame], info: dict, params: Params) -> list[dt.date]:
    """Months of orders that rows outside the stored fetch range belong to.

    A line fetched for the first time can belong to an order of a month stored long ago;
    orders and lines are both compared with the stored range.  One row per month comes back.
    """
    old = params.replace(fetch_start=info["fetch_start"], fetch_end=info["fetch_end"])

    def key(df):
        return normalize_key(F.col("OrderId"), df.schema["OrderId"].dataType).alias("k")

    def fresh(df, created):
        bounds = [F.lit(d.isoformat()).cast("timestamp_ntz") for d in (old.fetch_start, old.fetch_end)]
        return df.where(~F.col(created).between(*bounds))

    month = month_start(F.to_date("CreatedAt_order")).alias("m")
    orders = scan_orders(raw["orders"], params)
    lines = scan_order_lines(fresh(raw["order_lines"], "CreatedAt"), params)
    by_line = orders.select(key(orders), month).join(lines.select(key(lines)), "k", "left_semi").select("m")
    by_order = fresh(orders, "CreatedAt_order").select(month)
    return sorted(r["m"] for r in by_line.unionByName(by_order).distinct().collect())


def refresh_fact(spark: SparkSession, path: str, raw: dict[str, DataFrame], params: Params, build,
                 since: dt.date | None = None, options: dict[str, str] | None = None) -> list[dt.date]:
    """Extends the stored fact to the fetch range of ``params``; returns the months written.

    Only months with rows from outside the stored range are built (``build(raw)`` on
    sources whose orders are cut to these months) and written; the others' files are
    taken over.  Rows that changed inside the stored range are not noticed, neither a late
    change of an order's status nor of a lookup: ``since`` rewrites all months from that
    date on, a new :func:`write_fact` all.  Without a stored fact, with another status or
    with a range that does not hold the stored one, everything is built.
    """
    path = path.rstrip("/")
    info = fact_info(spark, path)
    whole = info is None or info["packed_status"] != params.packed_status or (
        info["fetch_start"] < params.fetch_start or info["fetch_end"] > params.fetch_end)
    if whole:
        snapshot = write_fact(build(raw), path, params, options)
        return sorted({f["month"] for f in open_snapshot(spark, path, snapshot)["folders"] if f["month"] is not None})
    months = affected_months(raw, info, params)
    if since is not None:
        later = month_start(F.to_date("CreatedAt_order"))
        orders = scan_orders(raw["orders"], params).select(later.alias("m")).where(F.col("m") >= F.lit(since.replace(day=1)))
        months = sorted({*months, *(r["m"] for r in orders.distinct().collect())})
    old = _manifest(spark, path, info["snapshot"])
    kept = old.where(F.col(PARTITION_COLUMN).isNull() | ~F.col(PARTITION_COLUMN).isin(months)) if months else old
    kept = kept.where(~F.col("file").contains("/customers/"))
    folders = [(f["tbl"], f["folder"], f["month"]) for f in info["folders"] if f["tbl"] != "customers" and f["month"] not in months]
    if not months:
        _finish(spark, path, f"data/{uuid.uuid4().hex}", kept, folders, params, 0)
        return []
    created = F.col("CreatedAt_order")
    first, last = min(months), (max(months).replace(day=28) + dt.timedelta(days=4)).replace(day=1)
    orders = raw["orders"].where(  # the bounds reach the scan
        (created >= F.lit(first.isoformat()).cast("timestamp_ntz")) & (created < F.lit(last.isoformat()).cast("timestamp_ntz"))
        & month_start(F.to_date(created)).isin(months))
    write, new = _new_write(spark, path, build({**raw, "orders": orders}), options or {})
    folders += _written_folders(spark, path, write)
    _finish(spark, path, write, kept.unionByName(new), folders, params, len(months))
    return months


def expire_snapshots(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Removes all but the last ``keep`` snapshots and the data that only they use,
    leftovers of killed writes included; returns the number of data folders removed.
    No write may run meanwhile, and no reader of an older snapshot."""
    path = path.rstrip("/")
    kept = _commits(spark, path)[-keep:] if keep > 0 else []
    if not kept:
        return 0
    used = set()
    for n in kept:
        rows = _manifest(spark, path, n).select(F.regexp_extract("file", "data/([^/]+)/", 1).alias("w")).distinct().collect()
        used |= {r["w"] for r in rows}
    gone = [w for w in files.names(spark, f"{path}/data") if w not in used]
    for kind in ("commits", "manifests"):
        for n in files.names(spark, f"{path}/{kind}"):
            if int(n) not in kept:
                files.remove(spark, f"{path}/{kind}/{n}")
    for w in gone:
        files.remove(spark, f"{path}/data/{w}")
    return len(gone)


# The CSV dialect of exports.  Null is \N and the empty text "", quotes are doubled, line
# breaks stay inside quotes, spaces are kept, times keep their microseconds.
CSV_DIALECT = {
    "header": "true", "nullValue": "\\N", "quote": '"', "escape": '"',
    "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "encoding": "UTF-8",
    "dateFormat": "yyyy-MM-dd", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def read_export(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """An exported table with the schema it was written from."""
    reader = spark.read.schema(schema)
    return reader.options(**CSV_DIALECT, multiLine="true").csv(path) if fmt == "csv" else reader.parquet(path)


def _fingerprint(df: DataFrame) -> tuple:
    """Rows and an order-independent checksum of all values."""
    hashed = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in df.columns])
    return tuple(df.agg(F.count(F.lit(1)), F.sum(hashed.cast("decimal(38,0)"))).first())


def write_table(df: DataFrame, path: str, fmt: str = "parquet", check: bool = False) -> None:
    """Export sink (CSV in the declared dialect, or Parquet); replaces the workbook export.

    ``check`` reads the export back and compares rows and values, so a text that the
    dialect cannot hold (one equal to the null mark) is reported, not changed silently.
    """
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.options(**CSV_DIALECT).csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unsupported export format: {fmt}")
    if check:
        wrote, back = _fingerprint(df), _fingerprint(read_export(df.sparkSession, path, df.schema, fmt))
        if wrote != back:
            raise ValueError(f"the export at {path} reads back as {back}, not {wrote}")
