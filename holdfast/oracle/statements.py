"""DuckDB statements that compute each registered query's result on their own.

They share the adapter expressions and nothing else with the Spark code. Money
is summed in decimals and rates are rounded as decimals, so that a value lying
exactly between two roundings goes the same way in both engines.
"""

from __future__ import annotations

from itertools import combinations
from math import factorial

from holdfast import constants as K

SERVICES = " + ".join(
    f"CAST({c} = 'Yes' AS INT)" for c in K.SERVICE_COLUMNS if c != "internet_service"
)

OTHER_SERVICE = "internet_service IS NULL OR internet_service NOT IN ('DSL', 'Fiber optic', 'No')"

ADAPTERS = """
ref AS (SELECT MAX(o_orderdate) AS ref_ts FROM orders),
ord AS (SELECT o_custkey, MIN(o_orderdate) AS f, MAX(o_orderdate) AS l, COUNT(*) AS n
        FROM orders GROUP BY o_custkey),
base AS (
  SELECT c_custkey AS k, c_nationkey AS nk, COALESCE(n, 0) AS n,
    CASE WHEN l IS NULL THEN 0 ELSE LEAST(72, (YEAR(l)-YEAR(f))*12 + MONTH(l)-MONTH(f)) END AS tenure,
    CAST(1825 + FLOOR(ABS(c_acctbal)*100) % 10050 AS BIGINT) AS cents,
    CASE WHEN l < ref_ts - INTERVAL '6' MONTH THEN 'Yes' ELSE 'No' END AS churn,
    CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'DSL' WHEN 'BUILDING' THEN 'DSL'
      WHEN 'FURNITURE' THEN 'No' ELSE 'Fiber optic' END AS internet
  FROM customer LEFT JOIN ord ON c_custkey = o_custkey CROSS JOIN ref),
subscribers AS (
  SELECT 'C' || CAST(k AS VARCHAR) AS customer_id,
   CASE WHEN k % 2 = 0 THEN 'Female' ELSE 'Male' END AS gender,
   CASE WHEN k % 6 = 0 THEN 1 ELSE 0 END AS senior_citizen,
   CASE WHEN nk % 2 = 0 THEN 'Yes' ELSE 'No' END AS partner,
   CASE WHEN nk % 3 = 0 THEN 'Yes' ELSE 'No' END AS dependents,
   CAST(tenure AS INT) AS tenure,
   CASE WHEN k % 10 = 0 THEN 'No' ELSE 'Yes' END AS phone_service,
   CASE WHEN k % 10 = 0 THEN 'No phone service' WHEN k % 10 < 5 THEN 'Yes' ELSE 'No' END AS multiple_lines,
   internet AS internet_service,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN k % 3 = 0 THEN 'Yes' ELSE 'No' END AS online_security,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN k % 4 < 2 THEN 'Yes' ELSE 'No' END AS online_backup,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN k % 5 < 2 THEN 'Yes' ELSE 'No' END AS device_protection,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN k % 7 < 2 THEN 'Yes' ELSE 'No' END AS tech_support,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN n % 2 = 0 THEN 'Yes' ELSE 'No' END AS streaming_tv,
   CASE WHEN internet = 'No' THEN 'No internet service' WHEN n % 3 = 0 THEN 'Yes' ELSE 'No' END AS streaming_movies,
   CASE WHEN n <= 8 THEN 'Month-to-month' WHEN n <= 11 THEN 'One year' ELSE 'Two year' END AS contract,
   CASE WHEN k % 5 < 3 THEN 'Yes' ELSE 'No' END AS paperless_billing,
   CASE k % 4 WHEN 0 THEN 'Electronic check' WHEN 1 THEN 'Mailed check'
     WHEN 2 THEN 'Bank transfer (automatic)' ELSE 'Credit card (automatic)' END AS payment_method,
   CAST(cents / 100 AS DECIMAL(10,2)) AS monthly_charges,
   CASE WHEN tenure = 0 THEN NULL
     ELSE CAST(FLOOR(cents * tenure * (90 + k % 21) / 100) / 100 AS DECIMAL(10,2)) END AS total_charges,
   churn
  FROM base),
scored AS (
  SELECT *, CAST(monthly_charges AS DOUBLE) AS m,
    1 / (1 + EXP(-(1.2 - 0.04 * CAST(tenure AS DOUBLE) + 0.02 * CAST(monthly_charges AS DOUBLE)
      + CASE contract WHEN 'Month-to-month' THEN 1.0 WHEN 'One year' THEN 0.0 ELSE -1.0 END))) AS raw_p
  FROM subscribers),
scores AS (
  SELECT customer_id, tenure, contract, monthly_charges,
    CAST(ROUND(raw_p, 4) AS DECIMAL(6,4)) AS churn_probability,
    CASE WHEN raw_p <= 0.30 THEN 'Low' WHEN raw_p <= 0.60 THEN 'Medium' ELSE 'High' END AS risk_level,
    CASE WHEN raw_p >= 0.5 THEN 1 ELSE 0 END AS is_high_risk,
    CAST(ROUND(raw_p * m, 2) AS DECIMAL(10,2)) AS revenue_at_risk,
    CAST(ROUND(26.58774208248756 * m, 2) AS DECIMAL(10,2)) AS clv_estimate,
    CAST(ROUND(raw_p * 26.58774208248756 * m, 2) AS DECIMAL(10,2)) AS clv_at_risk,
    TIMESTAMP '2024-01-01 00:00:00' AS scored_at
  FROM scored WHERE churn = 'No'),
evals AS (
  SELECT customer_id, tenure, contract, monthly_charges,
    CASE WHEN churn = 'Yes' THEN 1 ELSE 0 END AS y, ROUND(raw_p, 4) AS p
  FROM scored),
full_view AS (
  SELECT c.*, s.churn_probability, s.risk_level, s.is_high_risk, s.revenue_at_risk, s.clv_estimate,
    s.clv_at_risk, s.scored_at,
    CASE WHEN c.churn = 'Yes' THEN 1 ELSE 0 END AS churn_flag,
    CASE WHEN s.customer_id IS NULL THEN 0 ELSE 1 END AS has_model_score,
    CASE WHEN c.tenure > 48 THEN '49+ Months' WHEN c.tenure > 24 THEN '25-48 Months'
      WHEN c.tenure > 12 THEN '13-24 Months' ELSE '0-12 Months' END AS tenure_band,
    CASE WHEN c.tenure > 48 THEN 4 WHEN c.tenure > 24 THEN 3 WHEN c.tenure > 12 THEN 2 ELSE 1 END AS band_order
  FROM subscribers c LEFT JOIN scores s ON s.customer_id = c.customer_id),
cleaned AS (
  SELECT * REPLACE (CASE senior_citizen WHEN 1 THEN 'Yes' ELSE 'No' END AS senior_citizen,
    COALESCE(total_charges, CAST(monthly_charges * tenure AS DECIMAL(10,2))) AS total_charges)
  FROM subscribers),
featured AS (
  SELECT *, LEAST(1.0::DOUBLE, GREATEST(0.0::DOUBLE, tenure / 72.0::DOUBLE)) AS tenure_months_ratio,
    monthly_charges::DOUBLE / (tenure + 1.0::DOUBLE) AS charge_per_tenure,
    services AS total_services,
    monthly_charges::DOUBLE * tenure / (total_charges::DOUBLE + 1.0::DOUBLE) AS overpay_ratio,
    CAST(internet_service <> 'No' AND services >= 2 AS INT) AS has_internet_bundle
  FROM (SELECT *, CAST(SERVICE_SUM AS INT) AS services
    FROM cleaned) q)
""".replace("SERVICE_SUM", SERVICES)

# Monthly customers who stay pay a tenth more, one-year scores are a later run's, two-year customers are gone.
CHANGED = """
later_view AS (
  SELECT c.* REPLACE (CASE WHEN c.contract = 'Month-to-month' AND c.churn = 'No'
      THEN CAST(c.monthly_charges * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(10,2)) ELSE c.monthly_charges END AS monthly_charges),
    s.revenue_at_risk, s.clv_at_risk, CASE WHEN s.customer_id IS NULL THEN 0 ELSE 1 END AS has_model_score,
    CASE WHEN c.contract = 'One year' AND s.customer_id IS NOT NULL THEN 1 ELSE s.is_high_risk END AS is_high_risk,
    CASE WHEN c.contract = 'One year' AND s.customer_id IS NOT NULL
      THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.scored_at END AS scored_at
  FROM subscribers c LEFT JOIN scores s ON s.customer_id = c.customer_id WHERE c.contract <> 'Two year')"""

FACTOR = "26.58774208248756"
CHURNED = "churn = 'Yes'"


def stmt(body: str, extra: str = "") -> str:
    more = f",\n{extra}" if extra else ""
    return f"WITH {ADAPTERS.strip()}{more}\n{body.strip()}"


def rnd(x: str, places: int) -> str:
    """Half away from zero on a decimal that shows the double's short form."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,{max(12, places + 6)})), {places}) AS DOUBLE)"


def rate(flag: str = CHURNED, places: int = 2) -> str:
    return rnd(f"(100.0::DOUBLE * COUNT(*) FILTER (WHERE {flag})) / NULLIF(COUNT(*), 0)", places)


def share(flag: str, places: int = 6) -> str:
    return rnd(f"COUNT(*) FILTER (WHERE {flag})::DOUBLE / NULLIF(COUNT(*), 0)", places)


def money(x: str, where: str | None = None) -> str:
    cond = f" FILTER (WHERE {where})" if where else ""
    return rnd(f"CAST(SUM({x}){cond} AS DOUBLE)", 2)


def avg(x: str, places: int = 2) -> str:
    return rnd(f"CAST(SUM({x}) AS DOUBLE) / NULLIF(COUNT({x}), 0)", places)


def grouped(keys: str, cols: str, table: str = "subscribers", where: str = "", extra: str = "") -> str:
    cond = f"WHERE {where}" if where else ""
    return stmt(f"SELECT {keys}, {cols} FROM {table} {cond} GROUP BY {keys}", extra)


N = "COUNT(*) AS "
CHURNERS = f"COUNT(*) FILTER (WHERE {CHURNED}) AS "
RATE = f"{rate()} AS churn_rate_pct"
BILL = f"{avg('monthly_charges')} AS avg_monthly_bill"
TABLE_COLUMNS = [c for c in K.RAW_TO_TABLE.values()]
CUSTOMER_MONEY = ("monthly_charges", "total_charges")
SCORE_MONEY = ("monthly_charges", "churn_probability", "revenue_at_risk", "clv_estimate", "clv_at_risk")
SCORE_COLUMNS = ["customer_id", "tenure", "contract", "monthly_charges", "churn_probability", "risk_level",
                 "is_high_risk", "revenue_at_risk", "clv_estimate", "clv_at_risk", "scored_at"]
EXPOSURE = (f"{money('revenue_at_risk')} AS expected_monthly_revenue_at_risk, "
            f"{money('clv_at_risk')} AS estimated_clv_at_risk")

KPIS = (
    f"SELECT {N} total_customers, {CHURNERS} churned_customers, {rate()} AS observed_churn_rate_pct, "
    f"{money('monthly_charges', CHURNED)} AS historical_churned_monthly_charges, "
    "COUNT(*) FILTER (WHERE has_model_score = 1) AS scored_active_customers, "
    "COUNT(*) FILTER (WHERE is_high_risk = 1) AS high_risk_scored_customers, "
    f"{EXPOSURE}, MAX(scored_at) AS latest_score_timestamp FROM ")
PER_CONTRACT = (
    f"{N} total_customers, {CHURNERS} churned_customers, {rate()} AS observed_churn_rate_pct, "
    f"{avg('monthly_charges')} AS avg_monthly_charges, "
    f"COUNT(*) FILTER (WHERE has_model_score = 1) AS scored_active_customers, {EXPOSURE}")


def plain(columns, money_columns) -> str:
    return ", ".join(f"CAST({c} AS DOUBLE) AS {c}" if c in money_columns else c for c in columns)


CUSTOMER_LIST = plain(TABLE_COLUMNS, CUSTOMER_MONEY)
SCORE_LIST = plain(SCORE_COLUMNS, SCORE_MONEY)


# --- reports ---------------------------------------------------------------

def _reports() -> dict[str, str]:
    out = {
        "q01_overall": stmt(
            f"SELECT {N} total_customers, {CHURNERS} churned_customers, {RATE}, "
            f"CAST(SUM(CASE WHEN {CHURNED} THEN monthly_charges ELSE 0 END) AS DOUBLE) AS monthly_revenue_lost "
            "FROM subscribers"),
        "q02_contract": grouped("contract", f"{N} total_customers, {CHURNERS} churned_count, {RATE}, {BILL}"),
        "q03_risk_revenue": grouped(
            "risk_level", f"{N} customer_count, {money('monthly_charges')} AS total_monthly_revenue, "
            f"{money('revenue_at_risk')} AS monthly_revenue_at_risk, {money('clv_at_risk')} AS total_clv_at_risk",
            "scores"),
        "q04_internet_support": grouped(
            "internet_service, tech_support", f"{N} customer_count, {CHURNERS} churned_count, {RATE}"),
        "q05_churned_vs_retained": grouped(
            "churn", f"{N} customer_count, {avg('tenure', 1)} AS avg_tenure_months, "
            f"{avg('monthly_charges')} AS avg_monthly_charges, {avg('total_charges')} AS avg_total_charges"),
        "q06_missing_services": stmt(" UNION ALL ".join(
            f"SELECT '{name}' AS missing_service, COUNT(*) FILTER (WHERE {c} = 'No' AND {CHURNED}) AS churned_count "
            "FROM subscribers" for c, name in K.MISSING_SERVICE_LABELS)),
        "q07_tenure_cohort": stmt(
            f"SELECT tenure_cohort, {N} total_customers, {CHURNERS} churned_count, {RATE} FROM ("
            "SELECT *, CASE WHEN tenure > 48 THEN '49+ Months (Loyal)' WHEN tenure > 24 THEN '25-48 Months (Established)' "
            "WHEN tenure > 12 THEN '13-24 Months (Early)' ELSE '0-12 Months (New)' END AS tenure_cohort "
            "FROM subscribers) q GROUP BY tenure_cohort"),
        "q08_payment_paperless": grouped("payment_method, paperless_billing", f"{N} customer_count, {RATE}"),
        "q09_intervention_queue": stmt(
            "SELECT " + plain(["customer_id", "contract", "tenure", "monthly_charges", "churn_probability",
                               "revenue_at_risk", "clv_estimate"], SCORE_MONEY)
            + " FROM scores WHERE is_high_risk = 1 ORDER BY scores.churn_probability DESC, "
            "scores.monthly_charges DESC, customer_id LIMIT 10"),
        "q10_senior": grouped("senior_citizen", f"{N} total_customers, {RATE}, {BILL}"),
        "q11_bundle_depth": stmt(
            f"SELECT CAST(depth AS INT) AS total_services_count, {N} total_customers, {RATE} "
            f"FROM (SELECT *, {SERVICES} AS depth FROM subscribers) q GROUP BY depth"),
        "q12_high_bill": grouped("contract", f"{N} high_bill_customers, {RATE}", where="monthly_charges > 80"),
        "q13_fiber": grouped("online_security, tech_support", f"{N} total_fiber_customers, {RATE}",
                             where="internet_service = 'Fiber optic'"),
        "q14_clv_loss": grouped(
            "payment_method", f"{N} total_churned, {money('monthly_charges * tenure')} AS cumulative_historical_loss, "
            f"{avg('monthly_charges * tenure')} AS avg_clv_per_churned_customer", where=CHURNED),
        "q15_high_value": stmt(
            "SELECT " + plain(["customer_id", "contract", "tenure", "monthly_charges", "churn_probability",
                               "clv_estimate"], SCORE_MONEY)
            + " FROM scores WHERE monthly_charges > 90 AND churn_probability >= 0.5"),
        "v1_customer": stmt(
            f"SELECT {CUSTOMER_LIST}, tenure_band, churn_flag, has_model_score, "
            + plain(SCORE_COLUMNS[4:], SCORE_MONEY) + " FROM full_view"),
        "v2_kpis": stmt(KPIS + "full_view"),
        "v3_contract": grouped("contract", PER_CONTRACT, "full_view"),
        "rollup_kpis": stmt(KPIS + "later_view", CHANGED),
        "rollup_contract": grouped("contract", PER_CONTRACT, "later_view", extra=CHANGED),
        "v1_risk_breakdown": grouped("risk_level", f"{N} customers, {EXPOSURE}", "full_view"),
        "v1_tenure_band": grouped(
            "tenure_band, band_order", f"{N} customers, {share('churn_flag = 1')} AS churn_rate", "full_view"),
        "v1_queue": stmt(
            "SELECT " + plain(["customer_id", "contract", "tenure", "monthly_charges", "churn_probability",
                               "clv_at_risk"], SCORE_MONEY) + " FROM full_view WHERE is_high_risk = 1"),
        "measures": stmt(
            "SELECT COUNT(DISTINCT customer_id) AS total_customers, "
            + rnd("COALESCE(100.0::DOUBLE * (SUM(churn_flag) / NULLIF(COUNT(DISTINCT customer_id), 0)), 0)", 4)
            + f" AS churn_rate_pct, {money('revenue_at_risk')} AS monthly_revenue_at_risk, "
            f"{money('clv_at_risk')} AS clv_at_risk, "
            "COUNT(DISTINCT customer_id) FILTER (WHERE is_high_risk = 1) AS high_risk_customers FROM full_view"),
        "support_heatmap": grouped("tech_support", ", ".join(
            f"{rnd(f'AVG(churn_flag) FILTER (WHERE internet_service = {v!r})', 6)} AS {n}_rate, "
            f"COUNT(*) FILTER (WHERE internet_service = {v!r}) AS {n}_customers"
            for v, n in (("DSL", "dsl"), ("Fiber optic", "fiber"), ("No", "none")))
            + f", {rnd('AVG(churn_flag) FILTER (WHERE ' + OTHER_SERVICE + ')', 6)} AS other_rate, "
            f"COUNT(*) FILTER (WHERE {OTHER_SERVICE}) AS other_customers", "full_view"),
        "slicer_rollup": stmt(
            "SELECT senior_citizen, payment_method, tenure_band, "
            "CAST(GROUPING(senior_citizen, payment_method, tenure_band) AS INT) AS open_slicers, "
            f"{N} customers, {CHURNERS} churned_customers, {rate()} AS observed_churn_rate_pct, "
            f"COUNT(*) FILTER (WHERE is_high_risk = 1) AS high_risk_customers, {EXPOSURE} "
            "FROM full_view GROUP BY CUBE (senior_citizen, payment_method, tenure_band)"),
        "wb_contract": stmt(
            "SELECT CAST(position AS INT) AS position, d.contract, "
            "COALESCE(source_customers, 0) AS source_customers, COALESCE(observed_churners, 0) AS observed_churners, "
            "observed_churn_rate_pct, COALESCE(scored_customers, 0) AS scored_customers, "
            "CAST(COALESCE(high_risk_customers, 0) AS BIGINT) AS high_risk_customers, "
            "COALESCE(revenue_at_risk, 0) AS revenue_at_risk, COALESCE(clv_at_risk, 0) AS clv_at_risk "
            "FROM (VALUES (0, 'Month-to-month'), (1, 'One year'), (2, 'Two year')) d(position, contract) "
            f"LEFT JOIN (SELECT contract, {N} source_customers, {CHURNERS} observed_churners, "
            "CAST(ROUND_EVEN(CAST((100.0::DOUBLE * COUNT(*) FILTER (WHERE churn = 'Yes')) / COUNT(*) AS DECIMAL(38,12)), 1) AS DOUBLE) "
            "AS observed_churn_rate_pct FROM subscribers GROUP BY contract) a ON a.contract = d.contract "
            f"LEFT JOIN (SELECT contract, {N} scored_customers, SUM(is_high_risk) AS high_risk_customers, "
            "CAST(SUM(revenue_at_risk) AS DOUBLE) AS revenue_at_risk, CAST(SUM(clv_at_risk) AS DOUBLE) AS clv_at_risk "
            "FROM scores GROUP BY contract) b ON b.contract = d.contract"),
        "wb_risk": stmt(
            "SELECT CAST(position AS INT) AS position, d.risk_level, COUNT(s.customer_id) AS customers, "
            + rnd("COUNT(s.customer_id)::DOUBLE / GREATEST((SELECT COUNT(*) FROM scores), 1)", 6)
            + " AS share_of_scored, COALESCE(" + avg("churn_probability", 6) + ", 0) AS avg_churn_probability, "
            "COALESCE(CAST(SUM(revenue_at_risk) AS DOUBLE), 0) AS revenue_at_risk "
            "FROM (VALUES (0, 'Low'), (1, 'Medium'), (2, 'High')) d(position, risk_level) "
            "LEFT JOIN scores s ON s.risk_level = d.risk_level GROUP BY position, d.risk_level"),
        "kpi_cards": stmt(
            "SELECT (SELECT COUNT(*) FROM subscribers) AS source_customers, "
            f"(SELECT {share(CHURNED)} FROM subscribers) AS observed_churn_rate, "
            f"{N} scored_customers, CAST(SUM(revenue_at_risk) AS DOUBLE) AS revenue_exposure, "
            f"CAST(SUM(is_high_risk) AS BIGINT) AS contact_candidates, {avg('churn_probability', 6)} AS mean_probability "
            "FROM scores"),
        "score_summary": stmt(
            f"SELECT {N} scored_customers, CAST(SUM(is_high_risk) AS BIGINT) AS high_risk_customers, "
            f"{share('is_high_risk = 1')} AS high_risk_share, CAST(SUM(revenue_at_risk) AS DOUBLE) AS revenue_exposure "
            "FROM scores"),
        "rate_by_contract": grouped("contract", f"{N} customers, {share(CHURNED)} AS churn_rate"),
        "rate_by_month": grouped("tenure", f"{N} customers, {share(CHURNED)} AS churn_rate"),
        "charge_histogram": stmt(
            "SELECT CAST(bin AS INT) AS bin, "
            + rnd("CASE WHEN bin = 1 THEN lo - 0.001 * (hi - lo) ELSE lo + (bin - 1) * ((hi - lo) / 12) END", 6)
            + " AS lower_edge, " + rnd("CASE WHEN bin = 12 THEN hi ELSE lo + bin * ((hi - lo) / 12) END", 6)
            + " AS upper_edge, COUNT(*) FILTER (WHERE churn = 'No') AS n_no, "
            "COUNT(*) FILTER (WHERE churn = 'Yes') AS n_yes, "
            "COUNT(*) FILTER (WHERE churn IS NULL OR churn NOT IN ('No', 'Yes')) AS n_other FROM ("
            "SELECT churn, lo, hi, 1 + " + " + ".join(f"CAST(x > lo + {i} * ((hi - lo) / 12) AS INT)" for i in range(1, 12)) + " AS bin FROM ("
            "SELECT churn, CAST(monthly_charges AS DOUBLE) AS x, CAST(MIN(monthly_charges) OVER () AS DOUBLE) AS lo, "
            "CAST(MAX(monthly_charges) OVER () AS DOUBLE) AS hi FROM subscribers) a) b GROUP BY bin, lo, hi"),
        "charge_quartiles": stmt(
            "SELECT churn, low, " + ", ".join(f"{rnd(c, 6)} AS {c}" for c in ("q1", "median", "q3"))
            + ", high, " + rnd("q1 - 1.5 * (q3 - q1)", 6) + " AS lower_fence, "
            + rnd("q3 + 1.5 * (q3 - q1)", 6) + " AS upper_fence FROM (SELECT churn, MIN(x) AS low, MAX(x) AS high, "
            "QUANTILE_CONT(x, 0.25) AS q1, QUANTILE_CONT(x, 0.5) AS median, QUANTILE_CONT(x, 0.75) AS q3 "
            "FROM (SELECT churn, CAST(monthly_charges AS DOUBLE) AS x FROM subscribers) a GROUP BY churn) b"),
    }
    numeric = ("senior_citizen", "tenure", "monthly_charges", "total_charges")
    parts, gaps = [], []
    for i, c in enumerate(TABLE_COLUMNS):
        gaps.append(f"SELECT '{c}' AS column_name, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing FROM subscribers")
        head = (f"SELECT CAST({i} AS INT) AS position, '{c}' AS column_name, COUNT({c}) AS present, "
                f"COUNT(*) FILTER (WHERE {c} IS NULL) AS missing, COUNT(DISTINCT {c}) AS distinct_values, ")
        if c in numeric:
            x = f"CAST({c} AS DOUBLE)"
            q = ", ".join(f"{rnd(f'QUANTILE_CONT({x}, {p})', 6)} AS {n}"
                          for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))
            parts.append(head + "CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_count, "
                         f"{rnd(f'AVG({x})', 6)} AS avg_value, {rnd(f'STDDEV_SAMP({x})', 6)} AS std_value, "
                         f"MIN({x}) AS min_value, {q}, MAX({x}) AS max_value FROM subscribers")
        else:
            top = (f"(SELECT {c} FROM subscribers WHERE {c} IS NOT NULL GROUP BY {c} "
                   f"ORDER BY COUNT(*) DESC, {c} LIMIT 1)")
            most = (f"(SELECT COUNT(*) FROM subscribers WHERE {c} IS NOT NULL GROUP BY {c} "
                    "ORDER BY 1 DESC LIMIT 1)")
            nothing = ", ".join(f"CAST(NULL AS DOUBLE) AS {n}" for n in (
                "avg_value", "std_value", "min_value", "q1", "median", "q3", "max_value"))
            parts.append(head + f"{top} AS top_value, {most} AS top_count, {nothing} FROM subscribers")
    sketched = []
    for c in ("payment_method", "internet_service", "tenure", "monthly_charges", "total_charges"):
        lo, hi = (f"{f}(CAST({c} AS DOUBLE))" if c in numeric else "CAST(NULL AS DOUBLE)" for f in ("MIN", "MAX"))
        top = f"CAST({c} AS VARCHAR)" if not c.endswith("charges") else "CAST(NULL AS VARCHAR)"
        sketched.append(
            f"SELECT contract, '{c}' AS column_name, CAST(SUM(n) AS BIGINT) AS present, MAX(missing) AS missing, "
            f"{lo} AS min_value, {hi} AS max_value, FIRST({top} ORDER BY n DESC, {top}) AS top_value, "
            + ("MAX(n)" if not c.endswith("charges") else "CAST(NULL AS BIGINT)")
            + f" AS top_count, 1 AS distinct_within, {'1' if c in numeric else 'CAST(NULL AS INT)'} AS ranks_within "
            f"FROM (SELECT contract, {c}, COUNT({c}) AS n FROM subscribers GROUP BY contract, {c}) a "
            f"JOIN (SELECT contract, COUNT(*) FILTER (WHERE {c} IS NULL) AS missing FROM subscribers GROUP BY contract) b "
            f"USING (contract) GROUP BY contract")
    out["sketch_profile"] = stmt(" UNION ALL ".join(sketched))
    out["profile"] = stmt(" UNION ALL ".join(parts))
    out["most_missing"] = stmt(
        f"SELECT * FROM ({' UNION ALL '.join(gaps)}) q ORDER BY missing DESC, column_name LIMIT 5")
    return out


# --- cleaning, features, keyed merges --------------------------------------

def _scored_by_given(where: str = "") -> str:
    """The score table of the given logistic model."""
    return (
        "SELECT customer_id, tenure, contract, m AS monthly_charges, round_even(raw_p * 10000, 0) / 10000 AS churn_probability, "
        "CASE WHEN raw_p <= 0.3 THEN 'Low' WHEN raw_p <= 0.6 THEN 'Medium' ELSE 'High' END AS risk_level, "
        "CAST(raw_p >= 0.5 AS INT) AS is_high_risk, round_even(raw_p * m * 100, 0) / 100 AS revenue_at_risk, "
        f"round_even(m * {FACTOR}::DOUBLE * 100, 0) / 100 AS clv_estimate, "
        f"round_even(raw_p * (m * {FACTOR}::DOUBLE) * 100, 0) / 100 AS clv_at_risk, "
        f"TIMESTAMP '2024-01-01 00:00:00' AS scored_at FROM scored {where}")


def _rows() -> dict[str, str]:
    numeric = ("monthly_charges", "total_charges")
    predictors = [c for c in TABLE_COLUMNS if c not in ("customer_id", "churn")]
    out = {
        "load_clean": stmt("SELECT " + plain(TABLE_COLUMNS, numeric)
                           + " FROM (SELECT * REPLACE (CAST(senior_citizen = 'Yes' AS INT) AS senior_citizen) FROM cleaned) q"),
        "label_features": stmt("SELECT " + plain(predictors, numeric)
                               + ", CAST(lower(trim(churn)) = 'yes' AS INT) AS y FROM cleaned"),
        "features": stmt(
            "SELECT customer_id, " + ", ".join(
                f"{rnd(c, 9)} AS {c}" for c in ("tenure_months_ratio", "charge_per_tenure", "overpay_ratio"))
            + ", total_services, has_internet_bundle FROM featured"),
        "clv": stmt(f"SELECT customer_id, {rnd(f'{FACTOR}::DOUBLE * CAST(monthly_charges AS DOUBLE)', 2)} AS clv_estimate, "
                    "CAST(monthly_charges AS DOUBLE) AS monthly_charges FROM subscribers"),
        "contact_tier": stmt(
            "SELECT tier, COUNT(*) AS customers, MIN(p) AS lowest, MAX(p) AS highest FROM (SELECT p, CASE WHEN p < 0.5 "
            "THEN 'safe' WHEN p < 0.6 THEN 'elevated' ELSE 'critical' END AS tier FROM evals) q GROUP BY tier"),
        "preview": stmt(f"SELECT {CUSTOMER_LIST} FROM subscribers ORDER BY customer_id LIMIT 50"),
        "upsert_customers": stmt(
            "SELECT " + plain(TABLE_COLUMNS, numeric) + " FROM (SELECT * REPLACE (CASE WHEN churn = 'No' THEN "
            "CAST(monthly_charges * CAST(1.1 AS DECIMAL(3,1)) AS DECIMAL(10,2)) ELSE monthly_charges END AS monthly_charges) "
            "FROM subscribers) q"),
        "upsert_scores": stmt(
            "SELECT " + plain(SCORE_COLUMNS, SCORE_MONEY) + " FROM (SELECT * REPLACE ("
            "CASE WHEN contract = 'Month-to-month' THEN 'High' ELSE risk_level END AS risk_level, "
            "CASE WHEN contract = 'Month-to-month' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE scored_at END AS scored_at) "
            "FROM scores) q"),
        "delete_customers": stmt(
            "SELECT c.customer_id, c.contract, CASE WHEN c.contract = 'Two year' AND s.customer_id IS NOT NULL THEN 'High' "
            "ELSE s.risk_level END AS risk_level, CASE WHEN c.contract = 'Two year' AND s.customer_id IS NOT NULL "
            "THEN TIMESTAMP '2024-03-01 00:00:00' ELSE s.scored_at END AS scored_at FROM subscribers c "
            "LEFT JOIN scores s USING (customer_id) WHERE c.contract <> 'Two year' OR c.senior_citizen = 1"),
        "cascade_scores": stmt(f"SELECT {SCORE_LIST} FROM scores WHERE contract <> 'Two year'"),
        "score_columns": stmt(
            "SELECT customer_id, tenure, contract, CAST(monthly_charges AS DOUBLE) AS monthly_charges, "
            "p AS churn_probability, CASE WHEN p <= 0.3 THEN 'Low' WHEN p <= 0.6 THEN 'Medium' ELSE 'High' END AS risk_level, "
            "CAST(p >= 0.5 AS INT) AS is_high_risk, "
            "round_even(p * m * 100, 0) / 100 AS revenue_at_risk, "
            f"round_even(m * {FACTOR}::DOUBLE * 100, 0) / 100 AS clv_estimate, "
            f"round_even(p * (m * {FACTOR}::DOUBLE) * 100, 0) / 100 AS clv_at_risk, "
            "TIMESTAMP '2024-01-01 00:00:00' AS scored_at "
            "FROM (SELECT *, CAST(monthly_charges AS DOUBLE) AS m FROM evals) q"),
        "score_batch": stmt(_scored_by_given("WHERE churn = 'No'")),
        "score_stream": stmt(_scored_by_given()),
    }
    checks = []

    def add(table, check, column, bad, source):
        checks.append(f"SELECT '{table}' AS table_name, '{check}' AS check_name, '{column}' AS column_name, "
                      f"COUNT(*) FILTER (WHERE {bad}) AS violations FROM {source}")

    for table, source, widths, amounts in (
        ("customers", "kept", K.CUSTOMER_TEXT_WIDTHS, numeric),
        ("churn_scores", "scores", K.SCORE_TEXT_WIDTHS,
         ("monthly_charges", "revenue_at_risk", "clv_estimate", "clv_at_risk")),
    ):
        add(table, "not_null", "customer_id", "customer_id IS NULL", source)
        for c, width in widths.items():
            add(table, "width", c, f"length({c}) > {width}", source)
        for c in amounts:
            add(table, "precision", c, f"abs({c}) >= 100000000", source)
        checks.append(f"SELECT '{table}' AS table_name, 'unique' AS check_name, 'customer_id' AS column_name, "
                      f"COUNT(customer_id) - COUNT(DISTINCT customer_id) AS violations FROM {source}")
    add("churn_scores", "references", "customer_id",
        "customer_id NOT IN (SELECT customer_id FROM kept)", "scores")
    out["constraint_report"] = stmt(
        " UNION ALL ".join(checks), "kept AS (SELECT * FROM subscribers WHERE contract <> 'Month-to-month')")

    long = []
    for c in (*K.BINARY_COLUMNS, *K.MULTI_COLUMNS):
        long.append(f"SELECT customer_id, '{c}_' || lv AS feature, CAST({c} = lv AS INT)::DOUBLE AS value FROM featured "
                    f"CROSS JOIN (SELECT DISTINCT {c} AS lv FROM featured) l")
    numerics = (*K.RAW_NUMERIC_COLUMNS, *K.ENGINEERED_COLUMNS)
    for c in numerics:
        long.append(f"SELECT customer_id, '{c}' AS feature, {rnd(f'CAST({c} AS DOUBLE)', 9)} AS value FROM featured")
    out["design_matrix"] = stmt(" UNION ALL ".join(long))
    out["one_hot"] = stmt(" UNION ALL ".join(
        f"SELECT '{c}_' || {c} AS feature, COUNT(*) AS customers FROM cleaned GROUP BY {c}"
        for c in (*K.BINARY_COLUMNS, *K.MULTI_COLUMNS)))
    scaled = ", ".join(
        rnd(f"COALESCE((CAST({c} AS DOUBLE) - AVG(CAST({c} AS DOUBLE)) OVER ()) / "
            f"NULLIF(STDDEV_POP(CAST({c} AS DOUBLE)) OVER (), 0), 0)", 6) + f" AS {c}" for c in numerics)
    out["preprocess"] = stmt(f"SELECT customer_id, {scaled} FROM featured")
    out["dummies"] = stmt(
        "SELECT customer_id, CAST(contract = 'One year' AS INT) AS contract_one_year, "
        "CAST(contract = 'Two year' AS INT) AS contract_two_year, "
        "CAST(internet_service = 'Fiber optic' AS INT) AS internet_service_fiber_optic, "
        "CAST(internet_service = 'No' AS INT) AS internet_service_no FROM subscribers")
    keep = "n - CAST(CEIL(ROUND(n * 0.2, 9)) AS BIGINT)"
    allot = """
{name}_n AS (SELECT SUM(c) AS n FROM {src}),
{name}_k AS (SELECT y, c, ({keep}) AS keep, c * ({keep}) / n::DOUBLE AS exact FROM {src}, {name}_n),
{name} AS (
  SELECT y, c, CAST(FLOOR(exact) AS BIGINT)
    + CASE WHEN ROW_NUMBER() OVER (ORDER BY exact - FLOOR(exact) DESC, y)
        <= keep - SUM(CAST(FLOOR(exact) AS BIGINT)) OVER () THEN 1 ELSE 0 END AS kept
  FROM {name}_k)"""
    out["stratified_split"] = stmt(
        "SELECT CAST(part AS INT) AS part, y, CAST(customers AS BIGINT) AS customers FROM ("
        "SELECT 0 AS part, y, kept AS customers FROM inner_split UNION ALL "
        "SELECT 1, y, c - kept FROM inner_split UNION ALL SELECT 2, y, c - kept FROM outer_split) q WHERE customers > 0",
        "labels_n AS (SELECT y, COUNT(*) AS c FROM evals GROUP BY y),"
        + allot.format(name="outer_split", src="labels_n", keep=keep) + ",\n"
        + "train_n AS (SELECT y, kept AS c FROM outer_split),"
        + allot.format(name="inner_split", src="train_n", keep=keep))
    out["stratified_folds"] = stmt(
        "SELECT CAST(seat % 5 AS INT) AS fold, y, COUNT(*) AS customers FROM "
        "(SELECT y, ROW_NUMBER() OVER (ORDER BY y) - 1 AS seat FROM evals) q GROUP BY seat % 5, y")
    return out


# --- evaluation and policy -------------------------------------------------

def _policy_rows(thresholds: str, table: str = "evals") -> str:
    """Every threshold against every customer, the long way round."""
    return f"""
SELECT t AS threshold, COUNT(*) FILTER (WHERE p >= t AND y = 1) AS tp_count,
  COUNT(*) FILTER (WHERE p >= t AND y = 0) AS fp_count, COUNT(*) FILTER (WHERE p < t AND y = 1) AS fn_count,
  COUNT(*) FILTER (WHERE p < t AND y = 0) AS tn_count, COUNT(*) FILTER (WHERE p >= t) * 50.0::DOUBLE AS outreach_cost,
  COALESCE(CAST(SUM(monthly_charges) FILTER (WHERE p >= t AND y = 1) AS DOUBLE), 0) * {FACTOR}::DOUBLE AS caught,
  COALESCE(CAST(SUM(monthly_charges) FILTER (WHERE p < t AND y = 1) AS DOUBLE), 0) * {FACTOR}::DOUBLE AS missed
FROM {table} CROSS JOIN ({thresholds}) th GROUP BY t"""


OUTCOME = (
    "threshold, tp_count, fp_count, fn_count, tn_count, {cost} AS outreach_cost, {saved} AS saved_revenue, "
    "{lost} AS lost_revenue, {net} AS net_value"
).format(
    cost=rnd("outreach_cost", 4), saved=rnd("caught * 0.35::DOUBLE", 4),
    lost=rnd("missed + caught * 0.65::DOUBLE", 4), net=rnd("caught * 0.35::DOUBLE - outreach_cost", 4),
)
SWEEP = "SELECT i / 100.0::DOUBLE AS t FROM range(5, 96) r(i)"
NET = "caught * 0.35::DOUBLE - outreach_cost"


def _auc(table: str) -> str:
    return (f"(SELECT (SUM(r) FILTER (WHERE y = 1) - SUM(y) * (SUM(y) + 1) / 2.0::DOUBLE) / (SUM(y) * SUM(1 - y)) FROM ("
            "SELECT y, RANK() OVER (ORDER BY p) + (COUNT(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r "
            f"FROM {table}) z)")


def _ap(table: str) -> str:
    return ("(SELECT SUM(pos * (hits / seen::DOUBLE)) / SUM(pos) FROM (SELECT pos, SUM(pos) OVER w AS hits, "
            f"SUM(n) OVER w AS seen FROM (SELECT p, SUM(y) AS pos, COUNT(*) AS n FROM {table} GROUP BY p) a "
            "WINDOW w AS (ORDER BY p DESC)) b)")


def _matrix(table: str, pairs: str, names: str) -> str:
    """(names..., threshold, tn, fp, fn, tp) per threshold."""
    return (f"SELECT {names}, t AS threshold, COUNT(*) FILTER (WHERE p < t AND y = 0) AS tn, "
            "COUNT(*) FILTER (WHERE p >= t AND y = 0) AS fp, COUNT(*) FILTER (WHERE p < t AND y = 1) AS fn, "
            f"COUNT(*) FILTER (WHERE p >= t AND y = 1) AS tp FROM {table} CROSS JOIN ({pairs}) th GROUP BY {names}, t")


QUALITY = (rnd("(tp + tn)::DOUBLE / (tp + tn + fp + fn)", 6) + " AS accuracy, "
           + rnd("COALESCE(tp::DOUBLE / NULLIF(tp + fp, 0), 0)", 6) + ' AS "precision", '
           + rnd("COALESCE(tp::DOUBLE / NULLIF(tp + fn, 0), 0)", 6) + " AS recall")


def _evaluation() -> dict[str, str]:
    values = "SELECT UNNEST([0.0, 0.07, 0.3, 0.5, 0.6, 0.9, 1.0])::DOUBLE AS t"
    out = {
        "confusion": stmt(
            f"SELECT threshold, tn, fp, fn, tp, {QUALITY} FROM ({_matrix('evals', values, '1 AS one').replace('GROUP BY 1 AS one, t', 'GROUP BY t')}) q"),
        "roc_auc": stmt(f"SELECT {rnd(_auc('evals'), 9)} AS roc_auc"),
        "avg_precision": stmt(f"SELECT {rnd(_ap('evals'), 9)} AS avg_precision"),
        "brier": stmt(f"SELECT {rnd('AVG((p - y) * (p - y))', 9)} AS brier_score FROM evals"),
        "calibration_curve": stmt(
            f"SELECT CAST(bin AS INT) AS bin, COUNT(*) AS n, {rnd('AVG(y)', 6)} AS observed_rate, "
            f"{rnd('AVG(p)', 6)} AS mean_predicted FROM (SELECT y, p, " + " + ".join(f"CAST(p > edges[{i}] AS INT)" for i in range(1, 10)) + " AS bin "
            "FROM evals CROSS JOIN (SELECT QUANTILE_CONT(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges "
            "FROM evals) e) q GROUP BY bin"),
        "financial_outcome": stmt(f"SELECT {OUTCOME} FROM ({_policy_rows('SELECT 0.5::DOUBLE AS t')}) q"),
        "threshold_curve": stmt(f"SELECT {OUTCOME} FROM ({_policy_rows(SWEEP)}) q"),
        "threshold_best": stmt(
            f"SELECT {OUTCOME}, {rnd(f'{NET} - nobody', 4)} AS savings_vs_do_nothing, "
            f"{rnd(f'{NET} - everybody', 4)} AS savings_vs_contact_all FROM curve CROSS JOIN "
            f"(SELECT {NET} AS nobody FROM one) a CROSS JOIN (SELECT {NET} AS everybody FROM zero) b "
            f"ORDER BY ROUND({NET}, 6) DESC, threshold LIMIT 1",
            f"curve AS ({_policy_rows(SWEEP)}),\none AS ({_policy_rows('SELECT 1.0::DOUBLE AS t')}),\n"
            f"zero AS ({_policy_rows('SELECT 0.0::DOUBLE AS t')})"),
        "policy_value": stmt(
            f"SELECT {rnd('a.net', 4)} AS retention_policy_net_value, {rnd('a.net', 4)} AS savings_vs_do_nothing, "
            f"{rnd('a.net - b.net', 4)} AS savings_vs_contact_everyone FROM "
            f"(SELECT {NET} AS net FROM ({_policy_rows('SELECT 0.25::DOUBLE AS t')}) q) a CROSS JOIN "
            f"(SELECT {NET} AS net FROM ({_policy_rows('SELECT 0.0::DOUBLE AS t')}) q) b"),
        "fn_change": stmt(
            "SELECT " + rnd("COALESCE((base - tuned) / NULLIF(base, 0)::DOUBLE * 100.0::DOUBLE, 0)", 6)
            + " AS fn_reduction_pct FROM (SELECT COUNT(*) FILTER (WHERE p < 0.5 AND y = 1) AS base, "
            "COUNT(*) FILTER (WHERE p < 0.25 AND y = 1) AS tuned FROM evals) q"),
    }
    parts = []
    for model, table, cost in (("plain", "evals", 0.25), ("root", "rooted", 0.6)):
        pairs = f"SELECT 'default' AS policy, 0.5::DOUBLE AS t UNION ALL SELECT 'cost', {cost}::DOUBLE"
        parts.append(
            f"SELECT '{model}' AS model, policy, threshold, tn, fp, fn, tp, {QUALITY}, "
            f"{rnd(_auc(table), 6)} AS roc_auc, {rnd(_ap(table), 6)} AS avg_precision, "
            f"(SELECT {rnd('AVG((p - y) * (p - y))', 6)} FROM {table}) AS brier_score "
            f"FROM ({_matrix(table, pairs, 'policy')}) q")
    out["evaluation_table"] = stmt(
        " UNION ALL ".join(parts),
        "rooted AS (SELECT * REPLACE (ROUND(SQRT(p), 4) AS p) FROM evals)")
    # The rate of a score: over all starts not above it the greatest, of the least
    # average over all ends not below it.
    out["isotonic_steps"] = stmt(
        "SELECT MIN(p) AS low, MAX(p) AS high, CAST(SUM(n) AS BIGINT) AS n, CAST(SUM(pos) AS BIGINT) AS positives, rate "
        "FROM (SELECT i, MAX(least) AS rate FROM ends GROUP BY i) f JOIN points USING (i) GROUP BY rate",
        "points AS (SELECT p, COUNT(*) AS n, SUM(y) AS pos, ROW_NUMBER() OVER (ORDER BY p) AS i FROM evals GROUP BY p),\n"
        "totals AS (SELECT *, SUM(n) OVER (ORDER BY i) AS tn, SUM(pos) OVER (ORDER BY i) AS tp FROM points),\n"
        "ends AS (SELECT a.i AS start, b.i AS i, MIN((b.tp - a.tp + a.pos)::DOUBLE / (b.tn - a.tn + a.n)::DOUBLE) "
        "OVER (PARTITION BY a.i ORDER BY b.i DESC) AS least FROM totals a JOIN totals b ON a.i <= b.i)")
    out["prefix_sum"] = stmt(
        "SELECT CAST(monthly_charges AS DOUBLE) AS monthly_charges, customers, CAST(billed AS DOUBLE) AS billed, "
        "CAST(SUM(customers) OVER w AS BIGINT) AS run_customers, CAST(SUM(billed) OVER w AS DOUBLE) AS run_billed "
        "FROM (SELECT monthly_charges, COUNT(*) AS customers, SUM(monthly_charges) AS billed FROM subscribers "
        "GROUP BY monthly_charges) q WINDOW w AS (ORDER BY q.monthly_charges)")
    out["linear_attribution"] = stmt(" UNION ALL ".join(
        f"SELECT '{name}' AS feature, "
        + rnd(f"(SELECT AVG(ABS((({x})::DOUBLE - mu) * {w})) FROM subscribers, "
              f"(SELECT AVG(({x})::DOUBLE) AS mu FROM subscribers) m)", 6) + " AS mean_absolute_attribution"
        for name, x, w in (
            ("tenure", "tenure", "-0.04::DOUBLE"), ("monthly_charges", "monthly_charges", "0.02::DOUBLE"),
            ("contract_month_to_month", "CAST(contract = 'Month-to-month' AS INT)", "1.0::DOUBLE"),
            ("contract_two_year", "CAST(contract = 'Two year' AS INT)", "-1.0::DOUBLE"))))
    shares = " UNION ALL ".join(
        f"SELECT customer_id, '{name}' AS feature, ({x})::DOUBLE AS value, "
        f"{' + '.join(_shapley(tree, x) for tree in GIVEN_TREES)} AS phi FROM subscribers"
        for name, x in TREE_INPUTS.items())
    out["tree_attribution"] = stmt(f"SELECT customer_id, feature, value, {rnd('phi', 9)} AS phi FROM ({shares}) q")
    out["top_features"] = stmt(
        f"SELECT feature, {rnd('AVG(ABS(phi))', 6)} AS mean_absolute_attribution FROM ({shares}) q GROUP BY feature "
        "ORDER BY AVG(ABS(phi)) DESC, feature LIMIT 3")
    out["global_attribution"] = stmt(
        f"SELECT feature, {rnd('AVG(ABS(phi))', 6)} AS mean_absolute_attribution FROM ({shares}) q GROUP BY feature")
    return out


TREE_INPUTS = {
    "tenure": "tenure", "monthly_charges": "monthly_charges",
    "month_to_month": "CAST(contract = 'Month-to-month' AS INT)",
    "fiber": "CAST(internet_service = 'Fiber optic' AS INT)",
}
_T, _M, _C, _F = TREE_INPUTS.values()
# A leaf, or (input, cut, share that goes left, left, right).
GIVEN_TREES = (
    (_T, 12, 0.4, (_M, 70, 0.5, 0.3, 0.9), -0.4),
    (_C, 0.5, 0.4, -0.5, (_T, 24, 0.6, 0.8, (_F, 0.5, 0.7, 0.1, 0.5))),
    (_T, 30, 0.6, (_T, 6, 0.2, 0.6, (_M, 50, 0.3, 0.0, 0.2)), (_M, 90, 0.8, -0.6, -0.1)),
)


def _worth(tree, known) -> str:
    """What a tree gives on average if only some inputs are known."""
    if not isinstance(tree, tuple):
        return f"({tree}::DOUBLE)"
    x, cut, share, left, right = tree
    left, right = _worth(left, known), _worth(right, known)
    if x in known:
        return f"(CASE WHEN {x} <= {cut} THEN {left} ELSE {right} END)"
    return f"({share}::DOUBLE * {left} + (1 - {share}::DOUBLE) * {right})"


def _inputs(tree) -> set[str]:
    return {tree[0]} | _inputs(tree[3]) | _inputs(tree[4]) if isinstance(tree, tuple) else set()


def _shapley(tree, x: str) -> str:
    """The mean gain of knowing x, over all orders in which inputs become known."""
    others = sorted(_inputs(tree) - {x})
    if x not in _inputs(tree):
        return "0::DOUBLE"
    terms = []
    for size in range(len(others) + 1):
        weight = factorial(size) * factorial(len(others) - size) / factorial(len(others) + 1)
        for known in combinations(others, size):
            terms.append(f"{weight!r}::DOUBLE * ({_worth(tree, {*known, x})} - {_worth(tree, known)})")
    return "(" + " + ".join(terms) + ")"


# --- survival --------------------------------------------------------------

def _risk(source: str, stratum: str = "") -> str:
    """Per (stratum, time): events, and at risk by counting who leaves no earlier."""
    keys = f"{stratum}, " if stratum else ""
    part = f"PARTITION BY {stratum} " if stratum else ""
    return (f"SELECT {keys}time, CAST(events AS BIGINT) AS events, CAST(SUM(leaving) OVER ({part}ORDER BY time DESC) AS BIGINT) "
            f"AS at_risk FROM (SELECT {keys}time, SUM(event) AS events, COUNT(*) AS leaving FROM {source} GROUP BY {keys}time) r")


def _curve(risk: str, stratum: str = "", cols: str = "") -> str:
    keys = f"{stratum}, " if stratum else ""
    part = f"PARTITION BY {stratum} " if stratum else ""
    return (f"SELECT {keys}time, at_risk, events, PRODUCT(1.0::DOUBLE - events / at_risk::DOUBLE) OVER ({part}ORDER BY time) "
            f"AS survival{cols} FROM ({risk}) k")


SUBJECTS = "(SELECT tenure AS time, contract, CAST(churn = 'Yes' AS INT) AS event FROM subscribers) s"
GAPS = """(SELECT CAST(date_diff('day', d, COALESCE(nd, last_day)) AS INT) AS time,
  CASE WHEN nd IS NULL THEN 0 ELSE 1 END AS event FROM (
  SELECT d, LEAD(d) OVER (PARTITION BY o_custkey ORDER BY d) AS nd, MAX(d) OVER () AS last_day
  FROM (SELECT o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders) a) b) s"""


# Efron's ties one event at a time: the l-th of d tied events sees the risk set less
# the share l / d of the tie.
EFRON = """
rows AS (SELECT tenure AS t, churn = 'Yes' AS hit, monthly_charges::DOUBLE AS a, (contract = 'Two year')::INT::DOUBLE AS b,
  EXP(0.01::DOUBLE * monthly_charges::DOUBLE - 0.5::DOUBLE * (contract = 'Two year')::INT) AS e FROM subscribers),
tied AS (SELECT t, COUNT(*) AS d, SUM(LN(e)) AS m, SUM(a) AS ga, SUM(b) AS gb, SUM(e) AS e, SUM(e * a) AS ea, SUM(e * b) AS eb,
  SUM(e * a * a) AS eaa, SUM(e * a * b) AS eab, SUM(e * b * b) AS ebb FROM rows WHERE hit GROUP BY t),
risk AS (SELECT k.t, SUM(r.e) AS s, SUM(r.e * a) AS sa, SUM(r.e * b) AS sb, SUM(r.e * a * a) AS saa, SUM(r.e * a * b) AS sab,
  SUM(r.e * b * b) AS sbb FROM tied k JOIN rows r ON r.t >= k.t GROUP BY k.t),
each AS (SELECT *, l::DOUBLE / d AS f FROM (SELECT *, UNNEST(RANGE(d)) AS l FROM tied JOIN risk USING (t)) x),
seen AS (SELECT *, s - f * e AS z, (sa - f * ea) / (s - f * e) AS ma, (sb - f * eb) / (s - f * e) AS mb FROM each),
more AS (SELECT t, SUM(1 / z) AS h, SUM(ma / z) AS ha, SUM(mb / z) AS hb, SUM((1 - f) / z) AS o, SUM((1 - f) * ma / z) AS oa,
  SUM((1 - f) * mb / z) AS ob, AVG(ma) AS ma, AVG(mb) AS mb FROM seen GROUP BY t),
felt AS (SELECT rows.*, COALESCE(own.ma, 0) AS ma, COALESCE(own.mb, 0) AS mb,
  COALESCE((SELECT SUM(h) FROM more WHERE more.t < rows.t), 0) + COALESCE(CASE WHEN hit THEN own.o ELSE own.h END, 0) AS h,
  COALESCE((SELECT SUM(ha) FROM more WHERE more.t < rows.t), 0) + COALESCE(CASE WHEN hit THEN own.oa ELSE own.ha END, 0) AS ha,
  COALESCE((SELECT SUM(hb) FROM more WHERE more.t < rows.t), 0) + COALESCE(CASE WHEN hit THEN own.ob ELSE own.hb END, 0) AS hb
  FROM rows LEFT JOIN more own ON own.t = rows.t),
residuals AS (SELECT *, CASE WHEN hit THEN a - ma ELSE 0 END - e * (a * h - ha) AS ra,
  CASE WHEN hit THEN b - mb ELSE 0 END - e * (b * h - hb) AS rb FROM felt)"""


def _survival() -> dict[str, str]:
    def final(curve: str, keys: str = "") -> str:
        return f"SELECT {keys}time, at_risk, events, {rnd('survival', 9)} AS survival FROM ({curve}) c"

    band = _curve(_risk(SUBJECTS), cols=(
        ", SUM(CASE WHEN at_risk > events THEN events / (at_risk::DOUBLE * (at_risk - events)) ELSE 0 END) "
        "OVER (ORDER BY time) AS v"))
    reach = "1.959963984540054 * SQRT(v) / LN(survival)"
    limits = (f"CASE WHEN survival = 1 THEN 1 WHEN survival > 0 THEN {{pick}}(POW(survival, EXP(-({reach}))), "
              f"POW(survival, EXP({reach}))) END")
    once = "(SELECT {} FROM tied)"
    return {
        "cox_step": stmt(
            f"SELECT {rnd(once.format('SUM(m)') + ' - SUM(LN(z))', 4)} AS log_likelihood, "
            f"{rnd(once.format('SUM(ga)') + ' - SUM(ma)', 4)} AS u0, {rnd(once.format('SUM(gb)') + ' - SUM(mb)', 4)} AS u1, "
            f"{rnd('SUM((saa - f * eaa) / z - ma * ma)', 4)} AS h00, {rnd('SUM((sab - f * eab) / z - ma * mb)', 4)} AS h01, "
            f"{rnd('SUM((sbb - f * ebb) / z - mb * mb)', 4)} AS h11, "
            + ", ".join(f"(SELECT {rnd(f'SUM({x} * {y})', 4)} FROM residuals) AS {name}"
                        for x, y, name in (("ra", "ra", "v00"), ("ra", "rb", "v01"), ("rb", "rb", "v11")))
            + " FROM seen", EFRON.strip()),
        "cox_residuals": stmt(
            "SELECT CAST(t AS INT) AS time, CAST(hit AS INT) AS event, a AS monthly_charges, CAST(b AS INT) AS two_year, COUNT(*) AS customers, "
            f"{rnd('MIN(ra)', 6)} AS r0, {rnd('MIN(rb)', 6)} AS r1 FROM residuals GROUP BY t, hit, a, b", EFRON.strip()),
        "km_overall": stmt(final(_curve(_risk(SUBJECTS))).replace("SELECT time", "SELECT CAST(time AS INT) AS time")),
        "km_contract": stmt(final(_curve(_risk(SUBJECTS, "contract"), "contract"), "contract, ")),
        "km_reorder": stmt(final(_curve(_risk(GAPS)))),
        "km_band": stmt(
            f"SELECT time, at_risk, events, {rnd('survival', 9)} AS survival, "
            f"{rnd(limits.format(pick='LEAST'), 9)} AS lower, {rnd(limits.format(pick='GREATEST'), 9)} AS upper "
            f"FROM ({band}) c"),
        "km_median": stmt(
            "SELECT contract, COALESCE(MIN(time) FILTER (WHERE survival <= 0.5)::DOUBLE, 'Infinity'::DOUBLE) "
            f"AS median_survival FROM ({_curve(_risk(SUBJECTS, 'contract'), 'contract')}) c GROUP BY contract"),
    }


def statements() -> dict[str, str]:
    out = {**_reports(), **_rows(), **_evaluation(), **_survival()}
    # The same view, over tables laid out for the join.
    return {**out, "v1_bucketed": out["v1_customer"]}
