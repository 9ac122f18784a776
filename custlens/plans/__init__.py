"""Report plans: each function takes DataFrames and returns a lazy DataFrame."""

from custlens.plans.behaviour import new_vs_returning
from custlens.plans.calendar import order_frequency_histogram, tenure_histogram, weekday_revenue
from custlens.plans.churn import churn_by_region, churned_customer_details, monthly_churn_trend
from custlens.plans.clv import customer_clv, gross_margin, profit_vs_volume, top10_clv
from custlens.plans.cohort import cohort_retention
from custlens.plans.context import Analysis
from custlens.plans.drilldown import (
    customer_drilldown,
    customer_monthly_history,
    customer_monthly_history_long,
    customer_profile,
    product_category_mix,
)
from custlens.plans.exports import export_customer_details
from custlens.plans.kpis import customer_kpis, top10_revenue
from custlens.plans.pareto import pareto
from custlens.plans.recommend import (
    compute_recommendations,
    recommend_customers,
    top_customers_per_region,
)
from custlens.plans.rfm import rfm_scores, rfm_segments, top10_rfm
from custlens.plans.trend import monthly_trend, monthly_trend_long

__all__ = [
    "Analysis",
    "churn_by_region",
    "churned_customer_details",
    "cohort_retention",
    "compute_recommendations",
    "customer_clv",
    "customer_drilldown",
    "customer_kpis",
    "customer_monthly_history",
    "customer_monthly_history_long",
    "customer_profile",
    "export_customer_details",
    "gross_margin",
    "monthly_churn_trend",
    "monthly_trend",
    "monthly_trend_long",
    "new_vs_returning",
    "order_frequency_histogram",
    "pareto",
    "product_category_mix",
    "profit_vs_volume",
    "recommend_customers",
    "rfm_scores",
    "rfm_segments",
    "tenure_histogram",
    "top10_clv",
    "top10_revenue",
    "top10_rfm",
    "top_customers_per_region",
    "weekday_revenue",
]
