"""Fact build, conform, filters, customer aggregate and ordering operators."""

from custlens.operators.conform import conform_fact
from custlens.operators.customers import customer_aggregates
from custlens.operators.fact import add_measures, build_fact, packs_by_line
from custlens.operators.filters import (
    apply_filters,
    filter_date_range,
    filter_in,
    filter_options,
)
from custlens.operators.ordering import (
    fill_month_gaps,
    global_rank,
    histogram,
    month_spine,
    quartile_of_rank,
)

__all__ = [
    "add_measures",
    "apply_filters",
    "build_fact",
    "conform_fact",
    "customer_aggregates",
    "filter_date_range",
    "filter_in",
    "filter_options",
    "fill_month_gaps",
    "global_rank",
    "histogram",
    "month_spine",
    "packs_by_line",
    "quartile_of_rank",
]
