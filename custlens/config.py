"""Run parameters and session helpers."""

from __future__ import annotations

import datetime as dt
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import SparkSession


def _as_date(value: str | dt.date) -> dt.date:
    if isinstance(value, dt.datetime):
        return value.date()
    if isinstance(value, dt.date):
        return value
    return dt.date.fromisoformat(value)


@dataclass(frozen=True)
class Params:
    """Everything a report depends on besides the data.

    ``as_of`` replaces the wall clock the original application reads, so results
    are reproducible.  ``fetch_start``/``fetch_end`` bound the source scans
    (inclusive, compared as midnight timestamps like a SQL ``BETWEEN`` on date
    strings); ``start``/``end`` bound the report date filter (inclusive days).
    """

    fetch_start: dt.date = dt.date(2020, 1, 1)
    fetch_end: dt.date = field(default_factory=dt.date.today)
    start: dt.date = dt.date(2023, 1, 1)
    end: dt.date = field(default_factory=dt.date.today)
    as_of: dt.date = field(default_factory=dt.date.today)
    packed_status: str = "packed"
    regions: tuple[str, ...] = ("All",)
    shipping_methods: tuple[str, ...] = ("All",)
    customers: tuple[str, ...] = ("All",)
    top_n: int = 50
    min_lineitem_revenue: float = 500.0
    # Days-since-last-order threshold of the churn-by-region report and the
    # churned-customer export (the original offers 90, 180 or 365).
    churn_threshold: int = 90

    def __post_init__(self) -> None:
        for name in ("fetch_start", "fetch_end", "start", "end", "as_of"):
            object.__setattr__(self, name, _as_date(getattr(self, name)))
        for name in ("regions", "shipping_methods", "customers"):
            object.__setattr__(self, name, tuple(getattr(self, name)))

    def replace(self, **changes) -> "Params":
        values = {k: getattr(self, k) for k in self.__dataclass_fields__}
        values.update(changes)
        return Params(**values)


# Parameters the driver uses against the supplied test tables.
DRIVER_PARAMS = Params(
    fetch_start=dt.date(1996, 1, 1),
    fetch_end=dt.date(2001, 6, 30),
    start=dt.date(1996, 1, 1),
    end=dt.date(2001, 6, 30),
    as_of=dt.date(2001, 8, 2),
    packed_status="F",
    top_n=50,
    min_lineitem_revenue=500.0,
    churn_threshold=90,
)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is;
    without it this raises, because a folder of one machine would lose data.  Only a
    local session (one machine, as in tests) gets a fresh local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="custlens-ckpt-", dir="/tmp")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Spark's run-time Bloom filters: from which scan on a join's large side is filtered by the
# keys of its filtered side, and their size.  Spark's own thresholds (10 GB, 10 MB, one
# million keys) leave out tables of a few GB, whose rows then all go through the shuffles.
# A filter of 16 MB lets pass about 2% of other rows with 15 million keys, 18% with 37.
_BLOOM = "spark.sql.optimizer.runtime.bloomFilter."
RUNTIME_FILTERS = {
    _BLOOM + "applicationSideScanSizeThreshold": "32m",
    _BLOOM + "creationSideThreshold": "100g",
    _BLOOM + "expectedNumItems": "32000000",
    _BLOOM + "maxNumItems": "32000000",
    _BLOOM + "numBits": "134217728",
    _BLOOM + "maxNumBits": "134217728",
}


def use_runtime_filters(spark: SparkSession) -> None:
    """Has Spark filter large scans by the keys of a join's filtered side; what the
    session sets itself stays.  Rows and values of results do not depend on it."""
    for key, value in RUNTIME_FILTERS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
