"""Independent SQL formulation of every catalog query, for the DuckDB oracle.

Written directly from the report definitions (not generated from the Spark
plans).  The supplied tables are registered as views under their own names;
the fixture adapter, the scans, the fact, the report input, the filtered input
and the customer aggregate are CTEs shared by every statement.
"""

from __future__ import annotations

from custlens.catalog import COMBINED_PARAMS, FILTER_CUSTOMERS, FILTER_METHODS, FILTER_REGIONS, RANGE_PARAMS
from custlens.config import DRIVER_PARAMS, Params
from custlens.sources.fixture import ADAPTER_SQL


def _in(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _list_filter(column: str, values) -> str:
    values = list(values)
    if not values or "All" in values:
        return ""
    return f" AND {column} IN {_in(values)}"


def _base_ctes(p: Params) -> list[str]:
    fs, fe = f"TIMESTAMP '{p.fetch_start} 00:00:00'", f"TIMESTAMP '{p.fetch_end} 00:00:00'"
    extra = (
        _list_filter("RegionName", p.regions)
        + _list_filter("ShippingMethodName", p.shipping_methods)
        + _list_filter("CustomerName", p.customers)
    )
    ctes = [f"{name} AS ({sql.strip()})" for name, sql in ADAPTER_SQL.items()]
    ctes += [
        f"""s_orders AS (
  SELECT OrderId, CustomerId, SalesRepId, CreatedAt_order, DateOrdered, DateExpected, ShipDate,
         ShippingMethodRequested
  FROM src_orders WHERE OrderStatus = '{p.packed_status}' AND CreatedAt_order BETWEEN {fs} AND {fe})""",
        f"""s_lines AS (
  SELECT OrderLineId, OrderId, ProductId, ShipperId, QuantityShipped, SalePrice, UnitCost, DateShipped
  FROM src_order_lines WHERE CreatedAt BETWEEN {fs} AND {fe})""",
        f"""s_packs AS (
  SELECT p.PickedForOrderLine, p.WeightLb, p.ItemCount, p.DeliveryDate FROM src_packs p
  WHERE p.PickedForOrderLine IN (SELECT OrderLineId FROM src_order_lines WHERE CreatedAt BETWEEN {fs} AND {fe}))""",
        """packs_by_line AS (
  SELECT trim(PickedForOrderLine) AS OrderLineId, coalesce(sum(WeightLb), 0.0) AS WeightLb,
         coalesce(sum(ItemCount), 0.0) AS ItemCount, max(DeliveryDate) AS DeliveryDate
  FROM s_packs GROUP BY trim(PickedForOrderLine))""",
        """lk_customers AS (
  SELECT CustomerId, CustomerName, RegionId, IsRetail, trim(Address1) AS Address1, trim(Address2) AS Address2,
         City, Province, PostalCode, Phone, Email FROM src_customers)""",
        """fact0 AS (
  SELECT l.OrderLineId, l.OrderId, l.ProductId, l.ShipperId, l.QuantityShipped, l.SalePrice, l.UnitCost,
         l.DateShipped, o.CustomerId, o.SalesRepId, o.CreatedAt_order, o.DateOrdered, o.DateExpected,
         o.ShipDate, o.ShippingMethodRequested, c.CustomerName, c.RegionId, c.IsRetail, c.Address1,
         c.Address2, c.City, c.Province, c.PostalCode, c.Phone, c.Email, p.SupplierId, p.UnitOfBillingId,
         p.ProductName, p.ProductListPrice, p.CostPrice, r.RegionName, sh.Carrier, sm.ShippingMethodName,
         su.SupplierName, coalesce(pk.WeightLb, 0.0) AS WeightLb, coalesce(pk.ItemCount, 0.0) AS ItemCount,
         pk.DeliveryDate
  FROM s_lines l
  JOIN s_orders o ON l.OrderId = o.OrderId
  LEFT JOIN packs_by_line pk ON l.OrderLineId = pk.OrderLineId
  LEFT JOIN lk_customers c ON o.CustomerId = c.CustomerId
  LEFT JOIN src_products p ON l.ProductId = p.ProductId
  LEFT JOIN src_regions r ON c.RegionId = r.RegionId
  LEFT JOIN src_shippers sh ON l.ShipperId = sh.ShipperId
  LEFT JOIN src_shipping_methods sm ON o.ShippingMethodRequested = sm.SMId
  LEFT JOIN src_suppliers su ON p.SupplierId = su.SupplierId)""",
        """fact AS (
  SELECT *,
    CASE WHEN UnitOfBillingId = '3' THEN WeightLb * SalePrice ELSE ItemCount * SalePrice END AS Revenue,
    CASE WHEN UnitOfBillingId = '3' THEN WeightLb * UnitCost ELSE ItemCount * UnitCost END AS Cost,
    (CASE WHEN UnitOfBillingId = '3' THEN WeightLb * SalePrice ELSE ItemCount * SalePrice END)
      - (CASE WHEN UnitOfBillingId = '3' THEN WeightLb * UnitCost ELSE ItemCount * UnitCost END) AS Profit,
    CAST(CreatedAt_order AS DATE) AS Date,
    CASE WHEN date_sub('day', ShipDate, DeliveryDate) < 0 THEN 0
         ELSE date_sub('day', ShipDate, DeliveryDate) END AS TransitDays,
    CASE WHEN DeliveryDate <= DateExpected THEN 'On Time' ELSE 'Late' END AS DeliveryStatus
  FROM fact0)""",
        """ri AS (
  SELECT * REPLACE (coalesce(Address1, '') AS Address1, coalesce(Address2, '') AS Address2),
         coalesce(Address1, '') AS Address
  FROM fact)""",
        f"""dated AS (SELECT * FROM ri WHERE Date BETWEEN DATE '{p.start}' AND DATE '{p.end}')""",
        f"""filtered AS (SELECT * FROM dated WHERE TRUE{extra})""",
        """cust0 AS (
  SELECT CustomerId, min(CustomerName) AS CustomerName, min(RegionName) AS RegionName,
         sum(Revenue) AS TotalRevenue, sum(Cost) AS TotalCost, count(DISTINCT OrderId) AS TotalOrders,
         sum(WeightLb) AS TotalWeight, min(Date) AS FirstOrder, max(Date) AS LastOrder,
         min(Address) AS Address, min(City) AS City, min(Province) AS Province, min(PostalCode) AS PostalCode,
         CASE WHEN CustomerId IS NULL THEN NULL ELSE max(ShipDate) END AS DeliveryTime
  FROM filtered GROUP BY CustomerId)""",
        f"""cust1 AS (
  SELECT *, date_diff('day', LastOrder, DATE '{p.as_of}') AS dsl,
         CAST(floor(date_diff('day', FirstOrder, DATE '{p.as_of}') / 30.0) AS BIGINT) AS ma
  FROM cust0)""",
        """cust AS (
  SELECT CustomerId, CustomerName, RegionName, TotalRevenue, TotalCost, TotalOrders, TotalWeight,
         FirstOrder, LastOrder, Address, City, Province, PostalCode,
         round_even(coalesce(TotalWeight / NULLIF(TotalOrders, 0), 0.0) * 100, 0) / 100 AS AvgOrderWt,
         CAST(CASE WHEN dsl < 0 THEN 0 ELSE dsl END AS BIGINT) AS DaysSinceLastOrder,
         CASE WHEN ma < 1 THEN 1 ELSE ma END AS MonthsActive,
         round_even(TotalOrders / (CASE WHEN ma < 1 THEN 1 ELSE ma END) * 100, 0) / 100 AS RepeatRate,
         DeliveryTime
  FROM cust1)""",
    ]
    return ctes


def _sql(body: str, extra_ctes: list[str] | None = None, params: Params = DRIVER_PARAMS) -> str:
    ctes = _base_ctes(params) + (extra_ctes or [])
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


_TREND = [
    """pm AS (SELECT CAST(date_trunc('month', Date) AS DATE) AS m, sum(Revenue) AS rev,
                 count(DISTINCT OrderId) AS n FROM filtered WHERE Date IS NOT NULL GROUP BY 1)""",
    """pb AS (SELECT CAST(min(m) AS TIMESTAMP) AS s, CAST(max(m) AS TIMESTAMP) AS e FROM pm)""",
    """sp AS (SELECT CAST(t AS DATE) AS m FROM (SELECT unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS t
             FROM pb WHERE s IS NOT NULL))""",
    """trend AS (SELECT sp.m AS month_ts, coalesce(pm.rev, 0.0) AS MonthRevenue,
                 coalesce(pm.n, 0) AS MonthOrders FROM sp LEFT JOIN pm ON sp.m = pm.m)""",
]

_RFM = [
    """rq AS (SELECT quantile_cont(DaysSinceLastOrder, 0.25) AS q1, quantile_cont(DaysSinceLastOrder, 0.5) AS q2,
                 quantile_cont(DaysSinceLastOrder, 0.75) AS q3 FROM cust)""",
    """rr AS (SELECT c.*,
       row_number() OVER (ORDER BY TotalOrders DESC NULLS LAST, TotalRevenue DESC NULLS LAST,
                          CustomerId ASC NULLS LAST) AS fr,
       row_number() OVER (ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST) AS mr,
       count(*) OVER () AS n FROM cust c)""",
    """rs AS (SELECT CustomerId, CustomerName, RegionName, DaysSinceLastOrder AS Recency,
       TotalOrders AS Frequency, TotalRevenue AS Monetary,
       CASE WHEN DaysSinceLastOrder <= q1 THEN 4 WHEN DaysSinceLastOrder <= q2 THEN 3
            WHEN DaysSinceLastOrder <= q3 THEN 2 ELSE 1 END AS RecencyScore,
       CASE WHEN fr <= 1 + (n - 1) * 0.25 THEN 1 WHEN fr <= 1 + (n - 1) * 0.5 THEN 2
            WHEN fr <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS FrequencyScore,
       CASE WHEN mr <= 1 + (n - 1) * 0.25 THEN 1 WHEN mr <= 1 + (n - 1) * 0.5 THEN 2
            WHEN mr <= 1 + (n - 1) * 0.75 THEN 3 ELSE 4 END AS MonetaryScore
       FROM rr, rq)""",
    """rfm AS (SELECT *, RecencyScore + FrequencyScore + MonetaryScore AS RFM_Score,
       CASE WHEN RecencyScore + FrequencyScore + MonetaryScore >= 10 THEN 'Champion'
            WHEN RecencyScore + FrequencyScore + MonetaryScore >= 8 THEN 'Loyal'
            WHEN RecencyScore + FrequencyScore + MonetaryScore >= 6 THEN 'At Risk'
            ELSE 'Dormant' END AS RFM_Segment FROM rs)""",
]

_CLV = [
    """clv0 AS (SELECT *, coalesce(TotalRevenue / NULLIF(TotalOrders, 0), 0.0) AS AvgOrderValue,
       coalesce(TotalOrders / (CASE WHEN MonthsActive = 0 THEN 1 ELSE MonthsActive END) * 12, 0.0) AS OrdersPerYear
       FROM cust)""",
    """clv AS (SELECT CustomerId, CustomerName, RegionName, TotalRevenue, TotalCost, TotalOrders, MonthsActive,
       AvgOrderValue, OrdersPerYear, round_even(AvgOrderValue * OrdersPerYear * 3 * 100, 0) / 100 AS CLV,
       coalesce(round_even((TotalRevenue - TotalCost) / NULLIF(TotalRevenue, 0) * 100 * 100, 0) / 100, 0.0)
         AS GrossMarginPct
       FROM clv0)""",
]

_TOP = [
    """rc AS (SELECT RegionName, CustomerName, sum(Revenue) AS TotalRevenue FROM filtered GROUP BY 1, 2)""",
    f"""top AS (SELECT RegionName, CustomerName, TotalRevenue FROM (
       SELECT *, row_number() OVER (PARTITION BY RegionName ORDER BY TotalRevenue DESC NULLS LAST,
                                    CustomerName ASC NULLS LAST) AS rn FROM rc)
       WHERE rn <= {DRIVER_PARAMS.top_n})""",
]

_HISTORY = [
    """cm AS (SELECT CustomerId, CAST(date_trunc('month', Date) AS DATE) AS m, sum(Revenue) AS rev,
       count(DISTINCT OrderId) AS n FROM filtered WHERE CustomerId IS NOT NULL AND Date IS NOT NULL GROUP BY 1, 2)""",
    """cb AS (SELECT CustomerId, CAST(min(m) AS TIMESTAMP) AS s, CAST(max(m) AS TIMESTAMP) AS e FROM cm GROUP BY 1)""",
    """cs AS (SELECT CustomerId, CAST(t AS DATE) AS m FROM (
       SELECT CustomerId, unnest(generate_series(s, e, INTERVAL 1 MONTH)) AS t FROM cb))""",
    """hist AS (SELECT cs.CustomerId, last_day(cs.m) AS month_ts, coalesce(cm.rev, 0.0) AS MonthlyRevenue,
       coalesce(cm.n, 0) AS MonthlyOrders FROM cs LEFT JOIN cm ON cs.CustomerId = cm.CustomerId AND cs.m = cm.m)""",
]


def _histogram(value_sql: str) -> tuple[list[str], str]:
    ctes = [
        f"hv AS (SELECT CAST({value_sql} AS DOUBLE) AS v FROM cust)",
        "hs AS (SELECT min(v) AS lo_v, max(v) AS hi_v FROM hv)",
        """steps AS (SELECT m * pow(10.0, k) AS step
           FROM (VALUES (1), (2), (5)) t(m), (SELECT range AS k FROM range(-15, 20)) r)""",
        """hp AS (SELECT lo_v, hi_v, CASE WHEN hi_v - lo_v <= 0 THEN 1.0 ELSE
             (SELECT min(step) FROM steps WHERE ceil((hi_v - lo_v) / step) <= 20) END AS step FROM hs)""",
        """hb AS (SELECT step, floor(lo_v / step) * step AS lo,
             greatest(1, ceil((hi_v - floor(lo_v / step) * step) / step)) AS nb FROM hp)""",
    ]
    body = """SELECT lo + least(floor((v - lo) / step), nb - 1) * step AS BinStart,
       lo + least(floor((v - lo) / step), nb - 1) * step + step AS BinEnd, count(*) AS Count
FROM hv, hb WHERE v IS NOT NULL GROUP BY 1, 2"""
    return ctes, body


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    q["scan_orders"] = _sql("SELECT * FROM s_orders")
    q["scan_order_lines"] = _sql("SELECT * FROM s_lines")
    q["scan_packs"] = _sql("SELECT * FROM s_packs")
    counts = [
        ("orders", "s_orders"), ("order_lines", "s_lines"), ("customers", "src_customers"),
        ("products", "src_products"), ("regions", "src_regions"), ("shippers", "src_shippers"),
        ("shipping_methods", "src_shipping_methods"), ("suppliers", "src_suppliers"), ("packs", "s_packs"),
    ]
    q["load_sources"] = _sql("\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"Table\", count(*) AS \"Rows\" FROM {cte}" for name, cte in counts
    ))
    q["normalize_keys"] = _sql("SELECT * FROM lk_customers")
    q["packs_by_line"] = _sql("SELECT * FROM packs_by_line")
    q["fact_lines"] = _sql("SELECT * FROM fact")
    for key in ("fact_roundtrip", "load_or_build_fact", "fact_from_parquet", "fact_refresh"):
        q[key] = _sql("SELECT * FROM fact")
    q["delivery_metrics"] = _sql(
        "SELECT OrderLineId, ShipDate, DeliveryDate, DateExpected, TransitDays, DeliveryStatus FROM fact"
    )
    q["conform_fact"] = _sql("SELECT * FROM ri")
    q["filter_date_range"] = _sql("SELECT * FROM dated", params=RANGE_PARAMS)
    q["filter_regions"] = _sql(f"SELECT * FROM ri WHERE RegionName IN {_in(FILTER_REGIONS)}")
    q["filter_shipping_methods"] = _sql(f"SELECT * FROM ri WHERE ShippingMethodName IN {_in(FILTER_METHODS)}")
    q["filter_customers"] = _sql(f"SELECT * FROM ri WHERE CustomerName IN {_in(FILTER_CUSTOMERS)}")
    q["filter_combined"] = _sql("SELECT * FROM filtered", params=COMBINED_PARAMS)
    q["filter_options"] = _sql("""
SELECT DISTINCT 'RegionName' AS Field, RegionName AS Value FROM dated WHERE RegionName IS NOT NULL
UNION
SELECT DISTINCT 'ShippingMethodName', ShippingMethodName FROM dated WHERE ShippingMethodName IS NOT NULL
UNION
SELECT DISTINCT 'CustomerName', CustomerName FROM dated WHERE CustomerName IS NOT NULL""")
    q["customer_aggregates"] = q["rollup_customers"] = _sql("SELECT * FROM cust")
    churn = DRIVER_PARAMS.churn_threshold
    q["customer_kpis"] = _sql(f"""
SELECT (SELECT count(CustomerId) FROM cust) AS TotalCustomers,
       (SELECT coalesce(sum(Revenue), 0.0) FROM filtered) AS TotalRevenue,
       (SELECT count(DISTINCT OrderId) FROM filtered) AS TotalOrders,
       (SELECT coalesce(avg(rev), 0.0) FROM (SELECT OrderId, sum(Revenue) AS rev FROM filtered
          WHERE OrderId IS NOT NULL GROUP BY OrderId)) AS AvgOrderValue,
       (SELECT CASE WHEN count(CustomerId) > 0
                    THEN count(*) FILTER (WHERE DaysSinceLastOrder > {churn}) * CAST(100 AS DOUBLE) / count(CustomerId)
                    ELSE 0.0 END FROM cust) AS ChurnRatePct""")
    q["top10_revenue"] = _sql("""
SELECT CustomerName, RegionName, TotalRevenue AS Revenue, TotalOrders AS Orders, RepeatRate AS RetentionRate
FROM cust ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST LIMIT 10""")
    q["monthly_trend"] = _sql("SELECT * FROM trend", _TREND)
    q["monthly_trend_long"] = _sql("""
SELECT month_ts, 'MonthRevenue' AS Metric, CAST(MonthRevenue AS DOUBLE) AS Value FROM trend
UNION ALL SELECT month_ts, 'MonthOrders', CAST(MonthOrders AS DOUBLE) FROM trend""", _TREND)
    q["rfm_scores"] = _sql("SELECT * FROM rfm", _RFM)
    q["rfm_segments"] = _sql("SELECT RFM_Segment, count(CustomerId) AS Count FROM rfm GROUP BY RFM_Segment", _RFM)
    q["top10_rfm"] = _sql("""
SELECT CustomerName, RegionName, RFM_Score AS RFM, Recency AS "Days Since Last", Frequency AS Orders,
       Monetary AS Revenue
FROM rfm ORDER BY RFM_Score DESC, Monetary DESC NULLS LAST, CustomerId ASC NULLS LAST LIMIT 10""", _RFM)
    q["cohort_retention"] = _sql(f"""
SELECT CAST(date_trunc('month', FirstOrder) AS DATE) AS CohortMonth, count(CustomerId) AS TotalCustomers,
       count(*) FILTER (WHERE DaysSinceLastOrder <= {churn}) AS StillActive90,
       round_even(CAST(count(*) FILTER (WHERE DaysSinceLastOrder <= {churn}) AS DOUBLE)
                  / NULLIF(count(CustomerId), 0) * 100, 0) / 100 AS RetentionRate
FROM cust GROUP BY 1""")
    for suffix, days in (("", churn), ("_180", 180), ("_365", 365)):
        q["churn_by_region" + suffix] = _sql(f"""
SELECT RegionName, count(DISTINCT CustomerId) AS ChurnCount FROM cust
WHERE DaysSinceLastOrder > {days} GROUP BY RegionName""")
    q["monthly_churn_trend"] = _sql(f"""
SELECT last_day(m) AS Month,
       (SELECT count(DISTINCT CustomerId) FROM cust
         WHERE LastOrder < last_day(sp.m) - INTERVAL {churn} DAY) AS ChurnedCustomers
FROM sp""", _TREND[:1] + [
        """pb AS (SELECT CAST(date_trunc('month', min(Date)) AS TIMESTAMP) AS s,
                 CAST(date_trunc('month', max(Date)) AS TIMESTAMP) AS e FROM filtered)""",
        _TREND[2],
    ])
    q["churned_customer_details"] = _sql(f"""
SELECT CustomerId, CustomerName, RegionName, LastOrder, DaysSinceLastOrder, TotalRevenue, TotalCost,
       coalesce(TotalRevenue, 0.0) - coalesce(TotalCost, 0.0) AS GrossProfit,
       Address, City, Province, PostalCode
FROM cust WHERE DaysSinceLastOrder > {churn}""")
    q["new_vs_returning"] = _sql("""
SELECT 'New Customer Revenue' AS Type,
       coalesce(sum(f.Revenue) FILTER (WHERE f.Date = fo.fd), 0.0) AS Revenue
FROM filtered f LEFT JOIN fo ON f.CustomerId IS NOT DISTINCT FROM fo.CustomerId
UNION ALL
SELECT 'Returning Customer Revenue',
       coalesce(sum(f.Revenue) FILTER (WHERE NOT coalesce(f.Date = fo.fd, FALSE)), 0.0)
FROM filtered f LEFT JOIN fo ON f.CustomerId IS NOT DISTINCT FROM fo.CustomerId""",
        ["fo AS (SELECT CustomerId, min(Date) AS fd FROM filtered GROUP BY CustomerId)"])
    q["customer_clv"] = _sql("SELECT * FROM clv", _CLV)
    q["top10_clv"] = _sql("""
SELECT CustomerName, RegionName, AvgOrderValue, OrdersPerYear, CLV FROM clv
ORDER BY CLV DESC NULLS LAST, CustomerId ASC NULLS LAST LIMIT 10""", _CLV)
    q["gross_margin"] = _sql(
        "SELECT CustomerId, CustomerName, TotalRevenue, TotalCost, GrossMarginPct, CLV FROM clv", _CLV)
    q["profit_vs_volume"] = _sql(
        "SELECT CustomerId, CustomerName, TotalRevenue, TotalOrders, GrossMarginPct, CLV FROM clv", _CLV)
    q["pareto"] = _sql("""
SELECT CustomerId, CustomerName, TotalRevenue,
       row_number() OVER (ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST) AS Rank,
       sum(TotalRevenue) OVER (ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS CumulativeRevenue,
       sum(TotalRevenue) OVER (ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         / NULLIF(sum(TotalRevenue) OVER (), 0) AS CumulativePct
FROM cust""")
    ctes, body = _histogram("MonthsActive")
    q["tenure_histogram"] = _sql(body, ctes)
    ctes, body = _histogram("TotalOrders")
    q["order_frequency_histogram"] = _sql(body, ctes)
    q["weekday_revenue"] = _sql("SELECT dayname(Date) AS Weekday, sum(Revenue) AS Revenue FROM filtered GROUP BY 1")
    q["top_customers_per_region"] = _sql("SELECT * FROM top", _TOP)
    q["recommend_customers"] = _sql(f"""
SELECT q.* FROM (
  SELECT RegionName, CustomerName, sum(Revenue) AS TotalRevenue, count(DISTINCT OrderId) AS OrderFrequency,
         sum(ItemCount) AS TotalQuantity
  FROM filtered WHERE RegionName IS NOT NULL AND Revenue > {DRIVER_PARAMS.min_lineitem_revenue}
  GROUP BY 1, 2) q
WHERE NOT EXISTS (SELECT 1 FROM top t WHERE t.RegionName = q.RegionName
                  AND t.CustomerName IS NOT DISTINCT FROM q.CustomerName)""", _TOP)
    q["customer_profile"] = _sql("""
SELECT CustomerName, CustomerId, RegionName, FirstOrder, LastOrder, DeliveryTime AS LastDelivery,
       TotalRevenue, TotalOrders, AvgOrderWt, RepeatRate
FROM (SELECT *, row_number() OVER (PARTITION BY CustomerName
                                   ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST) AS rn
      FROM cust WHERE CustomerName IS NOT NULL) WHERE rn = 1""")
    q["customer_monthly_history"] = _sql("SELECT * FROM hist", _HISTORY)
    q["customer_drilldown"] = _sql(f"""
SELECT * FROM hist WHERE CustomerId IN (
  SELECT CustomerId FROM (
    SELECT CustomerId, row_number() OVER (PARTITION BY CustomerName
             ORDER BY TotalRevenue DESC NULLS LAST, CustomerId ASC NULLS LAST) AS rn
    FROM cust WHERE CustomerName IN {_in(FILTER_CUSTOMERS)}) WHERE rn = 1)""", _HISTORY)
    q["customer_monthly_history_long"] = _sql("""
SELECT CustomerId, month_ts, 'MonthlyRevenue' AS Metric, CAST(MonthlyRevenue AS DOUBLE) AS Value FROM hist
UNION ALL SELECT CustomerId, month_ts, 'MonthlyOrders', CAST(MonthlyOrders AS DOUBLE) FROM hist""", _HISTORY)
    q["product_category_mix"] = _sql("""
SELECT CustomerId,
       CASE WHEN position(' – ' IN ProductName) > 0 THEN split_part(ProductName, ' – ', 1)
            ELSE ProductName END AS ProductCategory,
       sum(Revenue) AS Spend, sum(WeightLb) AS Weight
FROM filtered WHERE CustomerId IS NOT NULL GROUP BY 1, 2""")
    q["export_customer_details"] = q["export_roundtrip"] = _sql("""
SELECT CustomerId, CustomerName, RegionName, TotalRevenue, TotalCost, TotalRevenue - TotalCost AS GrossProfit,
       TotalOrders, AvgOrderWt, FirstOrder, LastOrder, DeliveryTime, Address, City, Province, PostalCode
FROM cust""")
    return q
