"""Wiring of sources -> fact -> report input -> customer aggregate."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from custlens.config import Params, ensure_checkpoint_dir
from custlens.operators.conform import conform_fact
from custlens.operators.customers import customer_aggregates, order_level
from custlens.operators.fact import attributes, build_fact
from custlens.operators.filters import apply_filters, filter_date_range, filter_in
from custlens.operators.rollup import ATTRIBUTES
from custlens.sources.fixture import fixture_sources
from custlens.sources.scans import scan_sources
from custlens.sources.store import open_snapshot, read_table


class Analysis:
    """Lazily built DataFrames shared by the reports of one parameter set.

    Give ``raw`` source tables (Parquet, JDBC or fixture), an already built ``fact``, or
    open a stored one (:meth:`from_store`), which brings its order-level rollup and
    customer attributes.  Building the fact looks for one order line; reports with a
    global order (RFM, Pareto, histograms) store their slim input when they are planned;
    all else is computed when a report is acted on.
    """

    def __init__(
        self,
        spark: SparkSession,
        params: Params,
        raw: dict[str, DataFrame] | None = None,
        fact: DataFrame | None = None,
        rollup: DataFrame | None = None,
        attribute_table: DataFrame | None = None,
    ) -> None:
        if raw is None and fact is None:
            raise ValueError("give raw source tables or a fact")
        self.spark = spark
        self.params = params
        self._raw = raw
        self._fact = fact
        self._rollup = rollup
        self._attribute_table = attribute_table
        self.customers_stored = False

    @classmethod
    def from_fixture(cls, spark: SparkSession, sf_dir: str, params: Params) -> "Analysis":
        return cls(spark, params, raw=fixture_sources(spark, sf_dir))

    @classmethod
    def from_store(cls, spark: SparkSession, path: str, params: Params) -> "Analysis":
        """The stored fact at ``path`` with the months of the report range."""
        info = open_snapshot(spark, path)
        tables = {t: read_table(spark, path, t, params.start, params.end, info=info) for t in ("lines", "orders", "customers")}
        return cls(spark, params, fact=tables["lines"], rollup=tables["orders"], attribute_table=tables["customers"])

    @cached_property
    def raw(self) -> dict[str, DataFrame]:
        if self._raw is None:
            raise ValueError("this analysis was given a fact, not source tables")
        return self._raw

    @cached_property
    def scanned(self) -> dict[str, DataFrame]:
        return scan_sources(self.spark, self.raw, self.params, reduce_packs=False)

    @cached_property
    def fact(self) -> DataFrame:
        if self._fact is not None:
            return self._fact
        return build_fact(self.scanned, self.params)

    @cached_property
    def fact_by_month(self) -> DataFrame:
        """The fact as it is stored, clustered by order month."""
        return self.fact if self._fact is not None else build_fact(self.scanned, self.params, by_month=True)

    def staged_fact(self, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """As ``fact_by_month``, by way of lines that ``stage`` stores: what
        :func:`~custlens.sources.store.write_fact` makes of an analysis."""
        return self.fact if self._fact is not None else build_fact(self.scanned, self.params, by_month=True, stage=stage)

    @cached_property
    def report_input(self) -> DataFrame:
        return conform_fact(self.fact)

    @cached_property
    def date_filtered(self) -> DataFrame:
        return filter_date_range(self.report_input, self.params.start, self.params.end)

    @cached_property
    def filtered(self) -> DataFrame:
        return apply_filters(self.report_input, self.params)

    @cached_property
    def order_rows(self) -> DataFrame:
        """Filtered rows for reports grained by order or coarser: the stored rollup, or the lines."""
        return self.filtered if self._rollup is None else apply_filters(self._rollup, self.params)

    @cached_property
    def option_rows(self) -> DataFrame:
        """As ``order_rows``, with the date filter alone."""
        if self._rollup is None:
            return self.date_filtered
        return filter_date_range(self._rollup, self.params.start, self.params.end)

    @cached_property
    def orders(self) -> DataFrame:
        """Report input reduced to one row per (CustomerId, OrderId)."""
        return order_level(self.order_rows)

    @cached_property
    def attribute_table(self) -> DataFrame | None:
        """Customer attribute rows from the store or the lookups; None with a bare fact.

        Region and customer filters select among the attribute rows of a customer as they
        do among its lines.
        """
        table = self._attribute_table
        if table is None:
            if self._raw is None:
                return None
            named = attributes(self.scanned, "customers").join(attributes(self.scanned, "regions"), "RegionId", "left")
            table = conform_fact(named).select("CustomerId", *ATTRIBUTES)
        table = filter_in(table, "RegionName", self.params.regions)
        return filter_in(table, "CustomerName", self.params.customers)

    @cached_property
    def customers(self) -> DataFrame:
        return customer_aggregates(self.order_rows, self.params.as_of, orders=self.orders, attributes=self.attribute_table)

    def store_customers(self) -> "Analysis":
        """Write the customer table once, to shared storage, for several reports.

        One row per customer; the fact itself is read by each report with the columns
        that report needs.
        """
        ensure_checkpoint_dir(self.spark)
        self.customers = self.customers.checkpoint(eager=True)
        self.customers_stored = True
        return self
