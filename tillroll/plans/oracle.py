"""DuckDB SQL for every registered query: an independent, set-based statement of the
same semantics, run by the driver on the same parquet tables (views ``lineitem``,
``orders``, ``customer``, ``nation``)."""

from __future__ import annotations

from ..functions.segments import TARGET_ACTIONS
from ..params import RULE_MIN_INVOICES, AnalysisParams, test_table_params


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _ts(d) -> str:
    return f"TIMESTAMP '{d.strftime('%Y-%m-%d %H:%M:%S')}'"


def _segment_case(r: str, f: str, m: str) -> str:
    s = f"({f} + {m})"
    return f"""CASE
      WHEN {r} >= 5 AND {s} >= 8 THEN 'Champions'
      WHEN {r} >= 4 AND {s} >= 6 THEN 'Loyal Customers'
      WHEN {r} >= 4 AND {s} <= 4 THEN 'Potential Loyalists'
      WHEN {r} = 5 AND {s} <= 4 THEN 'New Customers'
      WHEN {r} >= 3 AND {s} = 6 THEN 'Promising'
      WHEN {r} = 3 AND {s} <= 4 THEN 'Need Attention'
      WHEN {r} = 2 AND {s} = 6 THEN 'About to Sleep'
      WHEN {r} = 2 AND {s} >= 8 THEN 'At Risk'
      WHEN {r} = 1 AND {s} >= 8 THEN 'Cannot Lose Them'
      WHEN {r} <= 2 AND {s} <= 4 THEN 'Hibernating'
      ELSE 'Lost' END"""


class OracleSQL:
    def __init__(self, p: AnalysisParams):
        self.p = p

    # ------------------------------------------------------------------ CTEs
    def raw_cte(self) -> str:
        return """
raw AS (
  SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country
  FROM (
    SELECT
      CASE WHEN cx THEN 'C' ELSE '' END || CAST(o_orderkey AS VARCHAR) AS InvoiceNo,
      CASE WHEN l_partkey % 40 = 0 THEN 'POST' ELSE CAST(l_partkey AS VARCHAR) END AS StockCode,
      CASE WHEN l_partkey % 30 <> 0 THEN p_name END AS Description,
      CASE WHEN cx THEN -l_quantity ELSE l_quantity END AS Quantity,
      o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS InvoiceDate,
      CASE WHEN l_discount = CAST(0.10 AS DOUBLE) AND l_tax = CAST(0.0 AS DOUBLE) THEN CAST(0.0 AS DOUBLE)
           ELSE ((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT))) / 100.0 END AS UnitPrice,
      CASE WHEN o_orderpriority = '5-LOW' THEN CAST(NULL AS BIGINT) ELSE o_custkey END AS CustomerID,
      n_name AS Country,
      l_partkey
    FROM (
      SELECT l.*, o.*, n.n_name, p.p_name,
             (l.l_returnflag = 'R' AND l.l_tax = CAST(0.08 AS DOUBLE)) AS cx
      FROM lineitem l
      JOIN orders o ON l.l_orderkey = o.o_orderkey
      JOIN customer c ON o.o_custkey = c.c_custkey
      JOIN nation n ON c.c_nationkey = n.n_nationkey
      LEFT JOIN part p ON l.l_partkey = p.p_partkey
    ) j
  ) v
  CROSS JOIN LATERAL (SELECT 1 AS copy UNION ALL SELECT 2) k
  WHERE k.copy = 1 OR v.l_partkey % 50 = 1
)"""

    def rev(self, q="Quantity", u="UnitPrice") -> str:
        # the given tables have whole quantities and prices in cents, so three places are exact here
        return f"CAST(CAST({q} AS DECIMAL(12,3)) * CAST({u} AS DECIMAL(12,3)) AS DECIMAL(18,3))"

    def cx(self) -> str:
        return f"(starts_with(CAST(InvoiceNo AS VARCHAR), {_q(self.p.cancel_prefix)}) OR Quantity < 0)"

    def in_window(self) -> str:
        return f"InvoiceDate BETWEEN {_ts(self.p.start_ts)} AND {_ts(self.p.end_ts)}"

    def non_product(self) -> str:
        codes = ", ".join(_q(c) for c in self.p.non_product_codes)
        return f"(upper(CAST(StockCode AS VARCHAR)) IN ({codes}) OR starts_with(upper(CAST(StockCode AS VARCHAR)), {_q(self.p.non_product_prefix)}))"

    def clean_cte(self) -> str:
        return f"""{self.raw_cte()},
clean AS (
  SELECT *, {self.cx()} AS IsCancellation, {self.rev()} AS LineRevenue
  FROM (SELECT DISTINCT * FROM raw WHERE {self.in_window()} AND UnitPrice > 0) d
),
cust_rows AS (SELECT * FROM clean WHERE CustomerID IS NOT NULL)"""

    def features_cte(self) -> str:
        p = self.p
        snap = _ts(p.snapshot_ts)
        return f"""{self.clean_cte()},
country_mode AS (
  SELECT CustomerID, Country FROM (
    SELECT CustomerID, Country,
           row_number() OVER (PARTITION BY CustomerID ORDER BY count(*) DESC, Country) AS rn
    FROM cust_rows GROUP BY CustomerID, Country) t
  WHERE rn = 1
),
feat0 AS (
  SELECT CustomerID,
         min(InvoiceDate) AS first_invoice,
         max(InvoiceDate) AS last_invoice,
         count(DISTINCT CASE WHEN NOT IsCancellation THEN InvoiceNo END) AS Frequency,
         sum(LineRevenue) AS Monetary,
         coalesce(sum(CASE WHEN NOT IsCancellation THEN Quantity END), 0) AS TotalQuantity,
         count_if(NOT IsCancellation) AS TotalLines,
         count(DISTINCT CASE WHEN NOT IsCancellation THEN StockCode END) AS DistinctStockCodes,
         avg(CAST(IsCancellation AS DOUBLE)) AS CancellationRate
  FROM cust_rows GROUP BY CustomerID
),
feat AS (
  SELECT f.CustomerID, m.Country,
         CAST(m.Country = {_q(p.home_country)} AS INTEGER) AS UK_vs_International,
         f.first_invoice, f.last_invoice,
         CAST(date_diff('second', f.first_invoice, f.last_invoice) // 86400 AS BIGINT) AS Tenure_days,
         CAST(date_diff('second', f.last_invoice, {snap}) // 86400 AS BIGINT) AS Recency,
         CAST(f.Frequency AS BIGINT) AS Frequency,
         f.Monetary,
         f.TotalQuantity,
         CAST(f.TotalLines AS BIGINT) AS TotalLines,
         CAST(f.DistinctStockCodes AS BIGINT) AS DistinctStockCodes,
         round_even(CAST(f.TotalQuantity AS DOUBLE) / greatest(f.Frequency, 1), 2) AS AvgBasketSize,
         round_even(greatest(CAST(f.Monetary AS DOUBLE), 0.0) / greatest(CAST(f.TotalQuantity AS DOUBLE), 1.0), 3) AS AvgUnitPrice,
         f.CancellationRate
  FROM feat0 f JOIN country_mode m USING (CustomerID)
)"""

    def scored_cte(self) -> str:
        q = self.p.n_bins
        return f"""{self.features_cte()},
pos AS (SELECT * FROM feat WHERE Monetary > 0),
nn AS (SELECT count(*) AS n FROM pos),
rx AS (SELECT -Recency AS x, row_number() OVER (ORDER BY -Recency, CustomerID) - 1 AS p FROM pos),
ks AS (SELECT k, (k * (n - 1)) // {q} AS p, (k * (n - 1)) % {q} AS r FROM nn, range(1, {q}) t(k)),
edges AS (
  SELECT ks.k, ks.r, lo.x AS x_lo, coalesce(hi.x, lo.x) AS x_hi
  FROM ks JOIN rx lo ON lo.p = ks.p LEFT JOIN rx hi ON hi.p = ks.p + 1
),
rs AS (
  SELECT c.CustomerID,
         CAST(1 + sum(CASE WHEN {q} * (-c.Recency) > {q} * e.x_lo + e.r * (e.x_hi - e.x_lo) THEN 1 ELSE 0 END) AS INTEGER) AS R_score
  FROM pos c, edges e GROUP BY c.CustomerID
),
ranks AS (
  SELECT CustomerID,
         row_number() OVER (ORDER BY Frequency, CustomerID) AS rf,
         row_number() OVER (ORDER BY Monetary, CustomerID) AS rm
  FROM pos
),
bins AS (
  SELECT r.CustomerID,
         CAST(1 + {' + '.join(f'(CASE WHEN {q} * (rf - 1) > {k} * (n - 1) THEN 1 ELSE 0 END)' for k in range(1, q))} AS INTEGER) AS F_score,
         CAST(1 + {' + '.join(f'(CASE WHEN {q} * (rm - 1) > {k} * (n - 1) THEN 1 ELSE 0 END)' for k in range(1, q))} AS INTEGER) AS M_score
  FROM ranks r, nn
),
scored AS (
  SELECT pos.*, rs.R_score, bins.F_score, bins.M_score,
         {_segment_case('rs.R_score', 'bins.F_score', 'bins.M_score')} AS Segment
  FROM pos JOIN rs USING (CustomerID) JOIN bins USING (CustomerID)
),
seg AS (
  SELECT Segment, sum(Monetary) AS rev, count(*) AS Customers FROM scored GROUP BY Segment
),
seg_summary AS (
  SELECT Segment, CAST(rev AS DOUBLE) AS Revenue, Customers,
         CAST(rev AS DOUBLE) / CAST(sum(rev) OVER () AS DOUBLE) * 100.0 AS Revenue_share
  FROM seg
)"""

    def cohort_cte(self) -> str:
        p = self.p
        return f"""{self.clean_cte()},
act AS (
  SELECT CustomerID, date_trunc('month', InvoiceDate) AS InvMonth, count(*) AS orders
  FROM cust_rows WHERE NOT IsCancellation GROUP BY ALL
),
coh AS (
  SELECT a.*, f.CohortMonth,
         (year(InvMonth) * 12 + month(InvMonth)) - (year(f.CohortMonth) * 12 + month(f.CohortMonth)) AS PeriodN
  FROM act a JOIN (SELECT CustomerID, min(InvMonth) AS CohortMonth FROM act GROUP BY CustomerID) f USING (CustomerID)
),
sizes AS (SELECT CohortMonth, count(*) AS cohort_size FROM coh WHERE PeriodN = 0 GROUP BY CohortMonth),
ret AS (SELECT CohortMonth, PeriodN, count(DISTINCT CustomerID) AS retained FROM coh GROUP BY ALL),
cells AS (
  SELECT strftime(s.CohortMonth, '%Y-%m') AS cohort_month,
         CAST(g.k AS INTEGER) AS period_n,
         CAST(s.cohort_size AS BIGINT) AS cohort_size,
         CAST(coalesce(r.retained, 0) AS BIGINT) AS retained,
         ((year(s.CohortMonth) * 12 + month(s.CohortMonth) - 1) - {p.first_month_index} + g.k) <= {p.last_observed_offset} AS observed
  FROM sizes s CROSS JOIN range(0, {p.last_observed_offset + 1}) g(k)
  LEFT JOIN ret r ON r.CohortMonth = s.CohortMonth AND r.PeriodN = g.k
),
long AS (
  SELECT *, CASE WHEN observed THEN CAST(retained AS DOUBLE) / CAST(cohort_size AS DOUBLE) * 100.0 END AS retention_pct
  FROM cells
)"""

    # ---------------------------------------------------------------- queries
    def all(self) -> dict[str, str]:
        p = self.p
        def W(cte: str, body: str) -> str:
            # a body either is the final SELECT or first adds its own CTEs
            sep = "\n" if body.lstrip().upper().startswith("SELECT") else ",\n"
            return f"WITH {cte}{sep}{body}"

        raw, clean, feat, scored, coh = (
            self.raw_cte(),
            self.clean_cte(),
            self.features_cte(),
            self.scored_cte(),
            self.cohort_cte(),
        )
        rev = self.rev()
        mlabel = "strftime(InvoiceDate, '%Y-%m')"
        out: dict[str, str] = {}
        out["line_items"] = W(raw, "SELECT * FROM raw")
        out["clean_line_items"] = W(
            clean,
            "SELECT InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, Country, "
            "IsCancellation, CAST(LineRevenue AS DOUBLE) AS LineRevenue FROM clean",
        )
        out["line_features"] = W(
            clean,
            f"""SELECT InvoiceNo, StockCode, InvoiceDate, CustomerID,
       date_trunc('month', InvoiceDate) AS invoice_month,
       {mlabel} AS month_label, IsCancellation,
       CAST(LineRevenue AS DOUBLE) AS line_revenue,
       {self.non_product()} AS is_non_product,
       CAST(Country = {_q(p.home_country)} AS INTEGER) AS is_home,
       CAST((year(InvoiceDate) * 12 + month(InvoiceDate) - 1) - {p.first_month_index} AS INTEGER) AS month_offset
FROM clean""",
        )
        note = f"{p.start_ts.date()} → {p.end_ts.date()}"
        out["cleaning_log"] = W(
            feat,
            f"""cnt_raw AS (SELECT count(*) AS n_raw, count_if({self.in_window()}) AS n_window,
                         count_if({self.in_window()} AND UnitPrice > 0) AS n_priced FROM raw),
cnt_clean AS (SELECT count(*) AS n_clean, count_if(IsCancellation) AS n_cancel,
                     count_if(CustomerID IS NOT NULL) AS n_cust_rows, count_if({self.non_product()}) AS n_nonprod FROM clean),
cnt_cust AS (SELECT count(*) AS n_customers, count_if(Monetary > 0) AS n_net_positive FROM feat),
c AS (SELECT * FROM cnt_raw, cnt_clean, cnt_cust)
SELECT step, CAST(rows_before AS BIGINT) AS rows_before, CAST(rows_after AS BIGINT) AS rows_after, note FROM (
  SELECT '01_trim_period' AS step, n_raw AS rows_before, n_window AS rows_after, {_q(note)} AS note FROM c
  UNION ALL SELECT '02_drop_unitprice_le_0', n_window, n_priced, '' FROM c
  UNION ALL SELECT '03_drop_exact_duplicates', n_priced, n_clean, '' FROM c
  UNION ALL SELECT '04_flag_cancellations', n_clean, n_clean, format('{{:,}}', n_cancel) || ' kept and netted (per spec)' FROM c
  UNION ALL SELECT '05_drop_missing_customer', n_clean, n_cust_rows, 'for customer-level analyses' FROM c
  UNION ALL SELECT '06_non_product_codes', n_clean, n_clean, format('{{:,}}', n_nonprod) || ' fee/postage/gift rows kept (no product-level analysis in scope)' FROM c
  UNION ALL SELECT '07_drop_net_negative_customers', n_customers, n_net_positive, 'customers with net Monetary <= 0 after netting cancellations' FROM c
) t ORDER BY step""",
        )
        out["non_product_audit"] = W(
            clean, f"SELECT count(*) AS rows, CAST(count_if({self.non_product()}) AS BIGINT) AS non_product_rows FROM clean"
        )
        out["rows_per_month"] = W(raw, f"SELECT {mlabel} AS month, count(*) AS rows FROM raw GROUP BY 1 ORDER BY 1")
        out["top_countries_by_rows"] = W(
            raw,
            f"SELECT Country, count(*) AS rows FROM raw GROUP BY Country ORDER BY rows DESC, Country LIMIT {p.top_countries_by_rows}",
        )
        out["cardinalities"] = W(
            raw,
            """SELECT count(*) AS rows, count(DISTINCT InvoiceNo) AS distinct_invoices,
       count(DISTINCT StockCode) AS distinct_stock_codes, count(DISTINCT CustomerID) AS distinct_customers,
       count(DISTINCT Country) AS countries,
       CAST(date_diff('second', min(InvoiceDate), max(InvoiceDate)) // 86400 AS BIGINT) AS span_days
FROM raw""",
        )
        out["quality_flags"] = W(
            raw,
            f"""SELECT CAST(count(*) AS BIGINT) AS rows,
       CAST(count_if(starts_with(InvoiceNo, {_q(p.cancel_prefix)})) AS BIGINT) AS cancellations,
       CAST(count_if(Quantity <= 0) AS BIGINT) AS non_positive_quantity,
       CAST(count_if(UnitPrice <= 0) AS BIGINT) AS non_positive_price,
       CAST(count_if(CustomerID IS NULL) AS BIGINT) AS missing_customer,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM raw) d) AS BIGINT) AS exact_duplicates
FROM raw""",
        )
        cols = ["InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country"]
        parts = " UNION ALL ".join(
            f"SELECT {_q(c)} AS column_name, {i} AS column_order, count_if({c} IS NULL) AS null_count, count(*) AS n FROM raw"
            for i, c in enumerate(cols)
        )
        out["null_profile"] = W(
            raw,
            f"""SELECT column_name, CAST(column_order AS INTEGER) AS column_order, CAST(null_count AS BIGINT) AS null_count,
       CAST(null_count AS DOUBLE) / CAST(n AS DOUBLE) * 100.0 AS null_pct
FROM ({parts}) t ORDER BY null_count, column_order""",
        )
        out["date_range"] = W(raw, "SELECT min(InvoiceDate) AS first_invoice, max(InvoiceDate) AS last_invoice FROM raw")
        out["monthly_net_revenue"] = W(
            raw, f"SELECT {mlabel} AS month, CAST(sum({rev}) AS DOUBLE) AS revenue FROM raw GROUP BY 1 ORDER BY 1"
        )
        out["country_revenue"] = W(
            raw,
            f"""SELECT Country, CAST(sum({rev}) AS DOUBLE) AS revenue, count(*) AS rows FROM raw GROUP BY Country
ORDER BY revenue DESC, Country LIMIT {p.top_countries_by_revenue}""",
        )
        inv = f"SELECT InvoiceNo, count(*) AS Lines, CAST(sum({rev}) AS DOUBLE) AS Total FROM raw GROUP BY InvoiceNo"
        out["invoice_sizes"] = W(raw, f"SELECT * FROM ({inv}) i WHERE Total > 0")

        def hist(source_sql: str, col: str) -> str:
            b = p.histogram_bins
            return f"""src AS (SELECT CAST({col} AS DOUBLE) AS v FROM ({source_sql}) s WHERE {col} IS NOT NULL),
rng AS (SELECT min(v) AS lo, max(v) AS hi FROM src),
binned AS (
  SELECT least(CAST(floor((v - lo) * {float(b)} / (hi - lo)) AS INTEGER), {b - 1}) AS bin, count(*) AS c
  FROM src, rng GROUP BY 1
)
SELECT CAST(g.k AS INTEGER) AS bin, lo + g.k * ((hi - lo) / {b}) AS lower, lo + (g.k + 1) * ((hi - lo) / {b}) AS upper,
       CAST(coalesce(c, 0) AS BIGINT) AS count
FROM range(0, {b}) g(k) CROSS JOIN rng LEFT JOIN binned ON binned.bin = g.k ORDER BY 1"""

        out["quantity_histogram"] = W(raw, hist("SELECT * FROM raw WHERE Quantity > 0", "Quantity"))
        out["unit_price_histogram"] = W(raw, hist("SELECT * FROM raw WHERE UnitPrice > 0", "UnitPrice"))
        out["invoice_lines_histogram"] = W(raw, hist(f"SELECT * FROM ({inv}) i WHERE Total > 0", "Lines"))
        out["invoice_total_histogram"] = W(raw, hist(
            f"SELECT least(Total, {p.invoice_total_clip}) AS TotalClipped FROM ({inv}) i WHERE Total > 0", "TotalClipped"
        ))
        out["purchases_vs_returns"] = W(
            raw,
            f"""SELECT {mlabel} AS month,
       CAST(sum(CASE WHEN NOT {self.cx()} THEN {rev} END) AS DOUBLE) AS purchases,
       CAST(sum(CASE WHEN {self.cx()} THEN {rev} END) AS DOUBLE) AS returns
FROM raw GROUP BY 1 ORDER BY 1""",
        )
        out["customer_features"] = W(
            feat,
            """SELECT CustomerID, Country, UK_vs_International, first_invoice, last_invoice, Tenure_days, Recency, Frequency,
       CAST(Monetary AS DOUBLE) AS Monetary, TotalQuantity, TotalLines, DistinctStockCodes, AvgBasketSize, AvgUnitPrice,
       CancellationRate FROM feat""",
        )
        out["customer_frame"] = W(
            scored,
            """SELECT CustomerID, Country, UK_vs_International, first_invoice, last_invoice, Tenure_days, Recency, Frequency,
       CAST(Monetary AS DOUBLE) AS Monetary, TotalQuantity, TotalLines, DistinctStockCodes, AvgBasketSize, AvgUnitPrice,
       CancellationRate, R_score, F_score, M_score, Segment FROM scored""",
        )
        out["frequency_rank"] = W(
            feat,
            """SELECT CustomerID, Frequency, CAST(row_number() OVER (ORDER BY Frequency, CustomerID) AS BIGINT) AS rank
FROM feat WHERE Monetary > 0""",
        )
        out["rfm_triples"] = W(
            scored,
            f"""SELECT R_score, F_score, M_score, count(*) AS customers, CAST(sum(Monetary) AS DOUBLE) AS revenue,
       {_segment_case('R_score', 'F_score', 'M_score')} AS Segment
FROM scored GROUP BY R_score, F_score, M_score""",
        )
        out["high_value_threshold"] = W(
            scored,
            f"""th AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), {p.high_value_quantile}) AS threshold FROM scored)
SELECT threshold, CAST(count_if(CAST(Monetary AS DOUBLE) >= threshold) AS BIGINT) AS high_value_customers, count(*) AS customers
FROM scored, th GROUP BY threshold""",
        )
        feats = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in p.ltv_features)
        out["ltv_model_frame"] = W(
            scored,
            f"""th AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), {p.high_value_quantile}) AS q FROM scored)
SELECT CustomerID, {feats}, CAST(CAST(Monetary AS DOUBLE) >= q AS INTEGER) AS IsTopQuintileM FROM scored, th""",
        )
        out["segment_summary"] = W(scored, "SELECT * FROM seg_summary ORDER BY Revenue DESC, Segment")
        out["headline_kpis"] = W(
            scored,
            f"""a AS (
  SELECT sum(LineRevenue) AS rev_all,
         sum(CASE WHEN CustomerID IS NOT NULL THEN LineRevenue END) AS rev_cust,
         count(DISTINCT CustomerID) AS total_customers,
         count(DISTINCT CASE WHEN CustomerID IS NOT NULL AND NOT IsCancellation THEN InvoiceNo END) AS inv
  FROM clean),
b AS (SELECT CAST(count_if(Frequency >= {p.repeat_min_frequency}) AS BIGINT) AS rep, count(*) AS n FROM scored)
SELECT CAST(rev_all AS DOUBLE) AS total_revenue_gbp,
       CAST(rev_cust AS DOUBLE) AS total_revenue_customer_attributed_gbp,
       CAST(rev_cust AS DOUBLE) / inv AS aov_gbp,
       total_customers, inv AS total_invoices_customer_attributed,
       rep / n AS repeat_purchase_rate, rep AS repeat_customer_count
FROM a, b""",
        )
        out["top_segment"] = W(scored, "SELECT * FROM seg_summary ORDER BY Revenue DESC, Segment LIMIT 1")
        out["top_segments"] = W(
            scored,
            f"""t AS (SELECT * FROM seg_summary ORDER BY Revenue DESC, Segment LIMIT {p.top_segments_shown})
SELECT *, Revenue_share / max(Revenue_share) OVER () * 100.0 AS width_pct FROM t ORDER BY Revenue DESC, Segment""",
        )
        targets = ", ".join(_q(s) for s in p.target_segments)
        order_case = " ".join(f"WHEN {_q(s)} THEN {i + 1}" for i, s in enumerate(p.target_segments))
        action_case = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in TARGET_ACTIONS.items())
        tgt = f"""tgt AS (
  SELECT Segment, Revenue, Customers, Revenue_share,
         CASE Segment {action_case} END AS Action,
         CAST(CASE Segment {order_case} END AS INTEGER) AS target_order
  FROM seg_summary WHERE Segment IN ({targets}))"""
        out["retention_targets"] = W(scored, f"{tgt}\nSELECT * FROM tgt ORDER BY target_order")
        out["target_pool"] = W(
            scored,
            f"""{tgt}
SELECT CAST(sum(s.Customers) AS BIGINT) AS customers, CAST(sum(s.rev) AS DOUBLE) AS revenue,
       CAST(sum(s.rev) AS DOUBLE) / CAST((SELECT sum(rev) FROM seg) AS DOUBLE) * 100.0 AS revenue_share_pct,
       CAST(sum(s.rev) AS DOUBLE) / sum(s.Customers) AS revenue_per_customer
FROM seg s WHERE s.Segment IN (SELECT Segment FROM tgt)""",
        )
        out["concentration"] = W(
            scored,
            """r AS (SELECT *, sum(Customers) OVER () AS all_c, sum(rev) OVER () AS all_r,
                 row_number() OVER (ORDER BY rev DESC, Segment) AS pos FROM seg)
SELECT CAST(sum(Customers) AS BIGINT) AS top_customers,
       CAST(sum(Customers) AS DOUBLE) / CAST(first(all_c) AS DOUBLE) * 100.0 AS customer_share_pct,
       CAST(sum(rev) AS DOUBLE) / CAST(first(all_r) AS DOUBLE) * 100.0 AS revenue_share_pct FROM r WHERE pos <= 2""",
        )
        rlo, rhi = p.guard_revenue
        clo, chi = p.guard_customers
        plo, phi = p.guard_repeat_rate

        def chk(label, val, lo, hi):
            conds = ["TRUE"]
            if lo is not None:
                conds.append(f"{val} >= {lo}")
            if hi is not None:
                conds.append(f"{val} <= {hi}")
            lo_s = "NULL" if lo is None else str(float(lo))
            hi_s = "NULL" if hi is None else str(float(hi))
            return (
                f"SELECT {_q(label)} AS check_name, CAST({val} AS DOUBLE) AS value, CAST({lo_s} AS DOUBLE) AS lower, "
                f"CAST({hi_s} AS DOUBLE) AS upper, ({' AND '.join(conds)}) AS passed FROM k, t"
            )

        out["guard_rails"] = W(
            scored,
            f"""k AS (
  SELECT CAST(sum(LineRevenue) AS DOUBLE) AS rev, CAST(count(DISTINCT CustomerID) AS DOUBLE) AS cust FROM clean),
kr AS (SELECT CAST(count_if(Frequency >= {p.repeat_min_frequency}) AS DOUBLE) / count(*) AS rep FROM scored),
t AS (SELECT Revenue_share AS top FROM seg_summary ORDER BY Revenue DESC, Segment LIMIT 1),
c AS (
  {chk('total_revenue_gbp', 'rev', rlo, rhi)}
  UNION ALL {chk('total_customers', 'cust', clo, chi)}
  UNION ALL {chk('repeat_purchase_rate', '(SELECT rep FROM kr)', plo, phi)}
  UNION ALL SELECT 'top_segment_share_pct', top, {float(p.guard_top_share_min)}, CAST(NULL AS DOUBLE), top > {float(p.guard_top_share_min)} FROM t
)
SELECT check_name, value, lower, upper, CASE WHEN passed THEN 'PASS' ELSE 'REVIEW' END AS status,
       CASE WHEN bool_and(passed) OVER () THEN 'PASS' ELSE 'REVIEW' END AS verdict FROM c""",
        )
        out["active_months"] = W(coh, "SELECT * FROM act")
        out["cohort_periods"] = W(coh, "SELECT CustomerID, InvMonth, orders, CohortMonth, CAST(PeriodN AS INTEGER) AS PeriodN FROM coh")
        out["cohort_sizes"] = W(coh, "SELECT * FROM sizes")
        out["retention_cells"] = W(coh, "SELECT * FROM long")
        piv = ", ".join(
            f"max(CASE WHEN period_n = {k} THEN retention_pct END) AS m{k}" for k in range(p.n_periods)
        )
        out["retention_matrix"] = W(
            coh, f"SELECT cohort_month, cohort_size, {piv} FROM long GROUP BY cohort_month, cohort_size ORDER BY cohort_month"
        )
        cnt = ", ".join(f"max(CASE WHEN period_n = {k} THEN retained END) AS m{k}" for k in range(p.n_periods))
        out["retained_matrix"] = W(
            coh, f"SELECT cohort_month, cohort_size, {cnt} FROM long GROUP BY cohort_month, cohort_size ORDER BY cohort_month"
        )
        wins = ", ".join(str(w) for w in p.retention_windows)
        out["retention_lines"] = W(
            coh,
            f"SELECT cohort_month, period_n AS window, retention_pct FROM long WHERE period_n IN ({wins}) AND observed",
        )
        out["retention_best_worst"] = W(
            coh,
            """m1 AS (SELECT * FROM long WHERE period_n = 1 AND observed AND retention_pct IS NOT NULL),
b AS (SELECT cohort_month AS best_cohort_month, retention_pct AS best_m1_retention_pct FROM m1
      ORDER BY retention_pct DESC, cohort_month LIMIT 1),
w AS (SELECT cohort_month AS worst_cohort_month, retention_pct AS worst_m1_retention_pct FROM m1
      ORDER BY retention_pct ASC, cohort_month LIMIT 1),
n AS (SELECT count(DISTINCT cohort_month) AS n_cohorts FROM long)
SELECT best_cohort_month, best_m1_retention_pct, worst_cohort_month, worst_m1_retention_pct, n_cohorts
FROM n LEFT JOIN b ON TRUE LEFT JOIN w ON TRUE""",
        )
        out["stored_line_items"] = W(
            clean,
            f"""SELECT {mlabel} AS month, count(*) AS rows, CAST(sum(LineRevenue) AS DOUBLE) AS revenue
FROM clean GROUP BY 1""",
        )
        labelled = f"""th AS (SELECT quantile_cont(CAST(Monetary AS DOUBLE), {p.high_value_quantile}) AS q FROM scored),
lab AS (SELECT CustomerID, Frequency, CAST(CAST(Monetary AS DOUBLE) >= q AS INTEGER) AS y,
               CAST(CustomerID % {p.n_folds} AS INTEGER) AS fold, CAST(Frequency >= {RULE_MIN_INVOICES} AS INTEGER) AS p
        FROM scored, th)"""
        # round-robin folds: sizes follow from the label counts alone
        out["ltv_fold_sizes"] = W(
            scored,
            f"""{labelled},
c AS (SELECT y, count(*) AS n FROM lab GROUP BY y)
SELECT CAST(f.k AS INTEGER) AS fold, y AS IsTopQuintileM,
       CAST(n // {p.n_folds} + CASE WHEN f.k < n % {p.n_folds} THEN 1 ELSE 0 END AS BIGINT) AS customers
FROM c, range(0, {p.n_folds}) f(k) WHERE n // {p.n_folds} + CASE WHEN f.k < n % {p.n_folds} THEN 1 ELSE 0 END > 0""",
        )
        out["confusion_on_rule"] = W(
            scored,
            labelled
            + "\nSELECT "
            + ", ".join(f"CAST(count_if(y = {t} AND p = {q}) AS BIGINT) AS true{t}_pred{q}" for t in (0, 1) for q in (0, 1))
            + " FROM lab",
        )
        out["metrics_on_rule"] = W(
            scored,
            f"""{labelled},
c AS (SELECT CAST(count_if(y = 1 AND p = 1) AS DOUBLE) AS tp, count_if(p = 1) AS pp, count_if(y = 1) AS ap FROM lab),
m AS (SELECT coalesce(tp / nullif(pp, 0), 0.0) AS precision, coalesce(tp / nullif(ap, 0), 0.0) AS recall FROM c)
SELECT precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM m""",
        )
        out["auc_on_rule"] = W(
            scored,
            f"""{labelled},
g AS (SELECT fold, Frequency, count(*) AS n, sum(y) AS pos FROM lab GROUP BY fold, Frequency),
r AS (SELECT *, sum(n) OVER (PARTITION BY fold ORDER BY Frequency) - n + (n + 1) / 2.0 AS avg_rank FROM g),
t AS (SELECT fold, CAST(sum(pos * avg_rank) AS DOUBLE) AS s, CAST(sum(pos) AS DOUBLE) AS np,
             CAST(sum(n) - sum(pos) AS DOUBLE) AS nn FROM r GROUP BY fold)
SELECT fold, CASE WHEN np > 0 AND nn > 0 THEN (s - np * (np + 1) / 2.0) / (np * nn) END AS auc FROM t""",
        )
        # stored line items have whole quantities
        whole = "SELECT * REPLACE (CAST(TotalQuantity AS BIGINT) AS TotalQuantity) FROM ({}) f"
        out["customer_ledger"] = whole.format(out["customer_features"])
        out["stored_customers"] = whole.format(out["customer_frame"])
        out["published_customers"] = W(
            scored,
            """act AS (SELECT CustomerID, strftime(InvoiceDate, '%Y-%m') AS month, count(*) AS orders
        FROM cust_rows WHERE NOT IsCancellation GROUP BY ALL)
SELECT Segment, month, count(*) AS customers, CAST(sum(orders) AS BIGINT) AS lines
FROM scored JOIN act USING (CustomerID) GROUP BY Segment, month""",
        )
        counts = ("distinct_invoices", "distinct_stock_codes", "distinct_customers", "countries")
        within = ", ".join(f"TRUE AS {c}_within_bound" for c in counts)
        out["cardinality_rollup"] = f"SELECT *, {within} FROM ({out['cardinalities']}) c"
        out["ltv_holdout_sizes"] = W(
            scored,
            f"""{labelled},
c AS (SELECT y, count(*) AS n, CAST(floor({p.test_share} * count(*) + 0.5) AS BIGINT) AS h FROM lab GROUP BY y)
SELECT TRUE AS held, y AS IsTopQuintileM, h AS customers FROM c WHERE h > 0
UNION ALL SELECT FALSE, y, n - h FROM c WHERE n > h""",
        )
        out["ltv_gradient_sums"] = self.gradient_sums(out["ltv_model_frame"])
        out["top_features_on_rule"] = self.top_features(out["ltv_model_frame"])
        out["stored_summary"] = W(
            scored,
            f"""r AS (SELECT Segment, round(Revenue, 2) AS Revenue, Customers, round(Revenue_share, 2) AS Revenue_share FROM seg_summary),
t AS (SELECT * FROM r ORDER BY Revenue DESC, Segment LIMIT {p.top_segments_shown})
SELECT *, Revenue_share / max(Revenue_share) OVER () * 100.0 AS width_pct FROM t""",
        )
        out["summary_core"] = self.summary_core(out)
        return out

    def _by_feature(self, frame: str) -> str:
        rows = " UNION ALL ".join(
            f"SELECT CustomerID, IsTopQuintileM AS y, {_q(c)} AS feature, CAST({c} AS DOUBLE) AS v FROM lab"
            for c in self.p.ltv_features
        )
        return f"WITH lab AS ({frame}), u AS ({rows})"

    def gradient_sums(self, frame: str) -> str:
        """Bins at exact quantiles (every distinct value if there are few), then the sums of the
        first gradients and hessians, in whole multiples of 2^-30."""
        b = self.p.gbt_max_bins
        return f"""{self._by_feature(frame)},
k AS (SELECT feature, count(*) AS n, count(DISTINCT v) AS d, list(v ORDER BY v) AS vs FROM u WHERE v IS NOT NULL GROUP BY feature),
few AS (SELECT feature, (v + lead(v) OVER (PARTITION BY feature ORDER BY v)) / 2 AS t
        FROM (SELECT DISTINCT feature, v FROM u WHERE v IS NOT NULL) JOIN k USING (feature) WHERE d <= {b}),
many AS (SELECT DISTINCT feature, (vs[floor(j * (n - 1) / {b}.0)::BIGINT + 1] + vs[ceil(j * (n - 1) / {b}.0)::BIGINT + 1]) / 2 AS t
         FROM k, range(1, {b}) r(j) WHERE d > {b}),
cuts AS (SELECT * FROM few WHERE t IS NOT NULL UNION ALL SELECT * FROM many),
lists AS (SELECT feature, list(t) AS ts FROM cuts GROUP BY feature),
x AS (SELECT u.feature, y, CASE WHEN v IS NULL THEN 255 ELSE len(list_filter(coalesce(ts, []), lambda e: e < v)) END AS bin
      FROM u LEFT JOIN lists USING (feature)),
a AS (SELECT 1 / (1 + exp(-ln((sum(IsTopQuintileM) + 1e-9) / (count(*) - sum(IsTopQuintileM) + 1e-9)))) AS p FROM lab),
s AS (SELECT feature, bin, count(*) AS customers, sum(y) AS pos FROM x GROUP BY feature, bin)
SELECT feature, bin::INTEGER AS bin, customers,
       ((customers - pos) * round(p * 1073741824)::BIGINT + pos * round((p - 1) * 1073741824)::BIGINT)::DOUBLE / 1073741824 AS gradient,
       (customers * round(p * (1 - p) * 1073741824)::BIGINT)::DOUBLE / 1073741824 AS hessian
FROM s, a"""

    def top_features(self, frame: str) -> str:
        skip = ", ".join(map(_q, self.p.rfm_features))
        return f"""{self._by_feature(frame)},
g AS (SELECT feature, v, count(*) AS n, sum(y) AS pos FROM u GROUP BY feature, v),
r AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY v) - n + (n + 1) / 2.0 AS avg_rank FROM g),
t AS (SELECT feature, CAST(sum(pos * avg_rank) AS DOUBLE) AS s, CAST(sum(pos) AS DOUBLE) AS np,
             CAST(sum(n) - sum(pos) AS DOUBLE) AS nn FROM r GROUP BY feature),
i AS (SELECT feature, abs((s - np * (np + 1) / 2.0) / (np * nn) - 0.5) AS importance FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS place,
             row_number() OVER (PARTITION BY feature IN ({skip}) ORDER BY importance DESC, feature) AS among FROM i)
SELECT 'top 3' AS list, place::INTEGER AS place, feature, importance FROM o WHERE place <= 3
UNION ALL SELECT 'top 2 outside recency and frequency', among::INTEGER, feature, CAST(NULL AS DOUBLE)
FROM o WHERE feature NOT IN ({skip}) AND among <= 2"""

    def summary_core(self, out: dict[str, str]) -> str:
        """The summary's fields as rows, from the queries of its parts."""
        p = self.p
        ctes = ", ".join(
            f"{k} AS ({out[q]})"
            for k, q in (
                ("s_log", "cleaning_log"),
                ("s_kpis", "headline_kpis"),
                ("s_seg", "segment_summary"),
                ("s_top", "top_segment"),
                ("s_bw", "retention_best_worst"),
                ("s_tgt", "retention_targets"),
            )
        )

        def row(section: str, name: str, field: str, value: str, source: str, text: bool = False) -> str:
            number, words = ("CAST(NULL AS DOUBLE)", value) if text else (f"CAST({value} AS DOUBLE)", "CAST(NULL AS VARCHAR)")
            return f"SELECT {_q(section)} AS section, {name} AS name, {_q(field)} AS field, {number} AS number, {words} AS text FROM {source}"

        first, third = ("s_log WHERE step = '01_trim_period'", "s_log WHERE step = '03_drop_exact_duplicates'")
        none = "''"
        rows = [
            row("dataset", none, "raw_rows", "rows_before", first),
            row("dataset", none, "cleaned_rows", "rows_after", third),
            row("dataset", none, "customers", "total_customers", "s_kpis"),
            row("dataset", none, "analysis_window_start", _q(str(p.start_ts.date())), "s_kpis", True),
            row("dataset", none, "analysis_window_end", _q(str(p.end_ts.date())), "s_kpis", True),
            row("dataset", none, "currency", _q(p.currency), "s_kpis", True),
        ]
        for f in ("total_revenue_gbp", "total_revenue_customer_attributed_gbp", "aov_gbp"):
            rows.append(row("kpis", none, f, f"round({f}, 2)", "s_kpis"))
        for f in ("total_customers", "total_invoices_customer_attributed", "repeat_customer_count"):
            rows.append(row("kpis", none, f, f, "s_kpis"))
        rows.append(row("kpis", none, "repeat_purchase_rate", "round(repeat_purchase_rate, 4)", "s_kpis"))
        rows.append(row("top_segment", none, "name", "Segment", "s_top", True))
        for f, v in (("revenue_gbp", "round(Revenue, 2)"), ("revenue_share_pct", "round(Revenue_share, 2)")):
            rows.append(row("top_segment", none, f, v, "s_top"))
            rows.append(row("segments", "Segment", f, v, "s_seg"))
            rows.append(row("retention_targets", "Segment", f, v, "s_tgt"))
        rows.append(row("top_segment", none, "customer_count", "Customers", "s_top"))
        rows.append(row("segments", "Segment", "customers", "Customers", "s_seg"))
        rows.append(row("retention_targets", "Segment", "customers", "Customers", "s_tgt"))
        for f in ("best_cohort_month", "worst_cohort_month"):
            rows.append(row("cohort", none, f, f, "s_bw", True))
        for f in ("best_m1_retention_pct", "worst_m1_retention_pct"):
            rows.append(row("cohort", none, f, f"round({f}, 2)", "s_bw"))
        rows.append(row("cohort", none, "n_cohorts", "n_cohorts", "s_bw"))
        for f in ("rows_before", "rows_after"):
            rows.append(row("cleaning", "step", f, f, "s_log"))
        rows.append(row("cleaning", "step", "note", "note", "s_log", True))
        return f"WITH {ctes} " + " UNION ALL ".join(rows)


def oracle_queries(params: AnalysisParams | None = None) -> dict[str, str]:
    return OracleSQL(params or test_table_params()).all()
