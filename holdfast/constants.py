"""Names, word lists and parameters that results depend on.

Everything here is data, not logic. Callers pass other values as arguments
where an operator allows it.
"""

# --- fixed values: column roles of the subscriber table --------------------
BINARY_COLUMNS = (
    "gender", "senior_citizen", "partner", "dependents",
    "phone_service", "paperless_billing",
)
MULTI_COLUMNS = (
    "multiple_lines", "internet_service", "online_security", "online_backup",
    "device_protection", "tech_support", "streaming_tv", "streaming_movies",
    "contract", "payment_method",
)
SERVICE_COLUMNS = (
    "phone_service", "multiple_lines", "internet_service", "online_security",
    "online_backup", "device_protection", "tech_support", "streaming_tv",
    "streaming_movies",
)
RAW_NUMERIC_COLUMNS = ("tenure", "monthly_charges", "total_charges")
ENGINEERED_COLUMNS = (
    "tenure_months_ratio", "charge_per_tenure", "total_services",
    "overpay_ratio", "has_internet_bundle",
)

# --- fixed values: names in the raw file -> names in the table -------------
RAW_TO_TABLE = {
    "customerID": "customer_id",
    "gender": "gender",
    "SeniorCitizen": "senior_citizen",
    "Partner": "partner",
    "Dependents": "dependents",
    "tenure": "tenure",
    "PhoneService": "phone_service",
    "MultipleLines": "multiple_lines",
    "InternetService": "internet_service",
    "OnlineSecurity": "online_security",
    "OnlineBackup": "online_backup",
    "DeviceProtection": "device_protection",
    "TechSupport": "tech_support",
    "StreamingTV": "streaming_tv",
    "StreamingMovies": "streaming_movies",
    "Contract": "contract",
    "PaperlessBilling": "paperless_billing",
    "PaymentMethod": "payment_method",
    "MonthlyCharges": "monthly_charges",
    "TotalCharges": "total_charges",
    "Churn": "churn",
}

# --- fixed values: category domains ----------------------------------------
CONTRACTS = ("Month-to-month", "One year", "Two year")
RISK_LEVELS = ("Low", "Medium", "High")
LABELS = ("No", "Yes")
ONLINE_SERVICES = ("DSL", "Fiber optic")
INTERNET_DOMAIN = ("DSL", "Fiber optic", "No")
ADD_ON_DOMAIN = ("No", "No internet service", "Yes")

# --- fixed values: tenure bands, (upper bound in months, label) ------------
TENURE_BANDS = (
    (12, "0-12 Months"), (24, "13-24 Months"), (48, "25-48 Months"),
    (None, "49+ Months"),
)
TENURE_COHORTS = (
    (12, "0-12 Months (New)"), (24, "13-24 Months (Early)"),
    (48, "25-48 Months (Established)"), (None, "49+ Months (Loyal)"),
)

# --- fixed values: services whose absence is reported, column -> label -----
MISSING_SERVICE_LABELS = (
    ("tech_support", "No Tech Support"),
    ("online_security", "No Online Security"),
    ("online_backup", "No Online Backup"),
    ("device_protection", "No Device Protection"),
)

# --- fixed values: scoring and economics -----------------------------------
TENURE_SPAN_MONTHS = 72.0
LOW_RISK_MAX = 0.30
MEDIUM_RISK_MAX = 0.60
DEFAULT_THRESHOLD = 0.5
OFFER_COST = 50.0
OFFER_SUCCESS = 0.35
LIFETIME_MONTHS = 30
ANNUAL_DISCOUNT = 0.10
THRESHOLD_FIRST = 0.05
THRESHOLD_LAST = 0.95
THRESHOLD_STEP = 0.01

# --- fixed values: splits and model parameters -----------------------------
TEST_FRACTION = 0.20
SEED = 42
CALIBRATION_FOLDS = 5
BOOSTING_DEFAULT = {
    "trees": 300, "depth": 5, "rate": 0.05, "row_sample": 0.8,
    "column_sample": 0.8, "min_rows": 3, "min_gain": 0.0,
}
BOOSTING_CANDIDATES = (
    {},
    {"trees": 500, "depth": 3, "rate": 0.03, "min_rows": 3},
    {"trees": 400, "depth": 4, "rate": 0.04, "min_rows": 1},
    {"trees": 300, "depth": 3, "rate": 0.05, "min_rows": 2,
     "row_sample": 0.9, "column_sample": 0.9},
)
LOGISTIC_C = 1.0
LOGISTIC_MAX_ITER = 1000

# --- fixed values: declared text widths of the two tables ------------------
CUSTOMER_TEXT_WIDTHS = {
    "customer_id": 50, "gender": 10, "partner": 5, "dependents": 5,
    "phone_service": 5, "multiple_lines": 30, "internet_service": 30,
    "online_security": 30, "online_backup": 30, "device_protection": 30,
    "tech_support": 30, "streaming_tv": 30, "streaming_movies": 30,
    "contract": 30, "paperless_billing": 5, "payment_method": 50, "churn": 5,
}
SCORE_TEXT_WIDTHS = {"customer_id": 50, "contract": 30, "risk_level": 20}
