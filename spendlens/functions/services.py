"""Service labels and lookup tables. Everything in this file is a fixed value."""

ANALYST = "Analyst"
SEARCH = "Search"
SEARCH_SERVING = "Search Serving"
FUNCTIONS = "Functions"
FUNCTIONS_QUERY = "Functions Query"
FUNCTION_MODELS = "Function Models"
DOCUMENT_LEGACY = "Document Legacy"
DOCUMENTS = "Document Processing"
FINE_TUNING = "Fine-tuning"

ROLLUP_SERVICES = [ANALYST, SEARCH, FUNCTIONS, DOCUMENTS, FINE_TUNING]
KNOWN_SERVICES = ROLLUP_SERVICES + [SEARCH_SERVING, DOCUMENT_LEGACY, FUNCTION_MODELS]

CREDIT_PRICE_USD = 3.00
ANALYST_CREDITS_PER_MESSAGE = 0.067
DOCUMENT_CREDITS_PER_1000_PAGES = 1.915

# scenario, user multiplier, usage multiplier
SCALE_SCENARIOS = [
    ("Light POC", 20.0, 1.5),
    ("Standard POC", 10.0, 1.2),
    ("Heavy POC", 4.0, 1.0),
]

# scenario, monthly growth
GROWTH_SCENARIOS = [
    ("Conservative", 0.10),
    ("Moderate", 0.25),
    ("Aggressive", 0.50),
    ("Rapid", 1.00),
]

# persona, users, requests per user and day
PERSONAS = [
    ("Power User", 10, 50),
    ("Regular User", 30, 20),
]

# service, low, typical, high (credits per user and month)
USAGE_BENCHMARKS = [
    (ANALYST, 1.0, 3.0, 8.0),
    (FUNCTIONS, 0.5, 2.0, 10.0),
    (SEARCH, 0.1, 0.5, 2.0),
    (DOCUMENT_LEGACY, 0.2, 1.0, 5.0),
]

# days of data needed for each maturity level
MATURITY_MINIMUM = 3
MATURITY_DEVELOPING = 7
MATURITY_RELIABLE = 14
MATURITY_CONFIDENT = 30

# model, credits per million input tokens, credits per million output tokens
MODEL_RATES = [
    ("claude-4-sonnet", 3.0, 15.0),
    ("claude-3-7-sonnet", 3.0, 15.0),
    ("claude-3-5-sonnet", 3.0, 15.0),
    ("claude-3-5-haiku", 1.0, 5.0),
    ("claude-3-opus", 15.0, 75.0),
    ("claude-3-sonnet", 3.0, 15.0),
    ("claude-3-haiku", 0.25, 1.25),
    ("llama3.1-405b", 3.0, 3.0),
    ("llama3.1-70b", 0.4, 0.4),
    ("llama3.1-8b", 0.1, 0.1),
    ("llama3-70b", 0.4, 0.4),
    ("llama3-8b", 0.1, 0.1),
    ("deepseek-r1", 0.55, 2.19),
    ("mistral-large2", 2.0, 6.0),
    ("mistral-large", 2.0, 6.0),
    ("mixtral-8x7b", 0.15, 0.15),
    ("mistral-7b", 0.1, 0.1),
]

# function, credits per million tokens (whatever the model is, but for those below)
FUNCTION_RATES = [
    ("SENTIMENT", 0.056),
    ("SUMMARIZE", 0.056),
    ("TRANSLATE", 0.056),
    ("EXTRACT_ANSWER", 0.056),
    ("AI_EXTRACT", 0.15),
    ("AI_SENTIMENT", 0.3),
    ("EMBED_TEXT_768", 0.014),
    ("EMBED_TEXT_1024", 0.014),
    ("EMBED_IMAGE_1024", 0.14),
]

# function, model, credits per million input tokens, credits per million output tokens
FUNCTION_MODEL_RATES = [
    ("AI_EXTRACT", "mistral-large", 2.0, 6.0),
    ("AI_EMBED", "e5-base-v2", 0.014, 0.014),
    ("AI_EMBED", "multilingual-e5-large", 0.014, 0.014),
]

# setting, value, description, type
DEFAULT_SETTINGS = [
    ("LOOKBACK_DAYS", "90", "Default lookback period in days", "INTEGER"),
    ("SNAPSHOT_RETENTION_DAYS", "365", "Days to keep snapshots", "INTEGER"),
    ("CREDIT_COST_USD", "3.00", "Credit cost in USD", "DECIMAL"),
    ("CREDIT_COST_EUR", "2.70", "Credit cost in EUR", "DECIMAL"),
    ("CREDIT_COST_GBP", "2.40", "Credit cost in GBP", "DECIMAL"),
    ("CREDIT_COST_JPY", "420.00", "Credit cost in JPY", "DECIMAL"),
    ("SNAPSHOT_SCHEDULE", "0 3 * * *", "Daily snapshot schedule", "STRING"),
    ("SNAPSHOT_TASK_WAREHOUSE", "COMPUTE_WH", "Compute used by the snapshot job", "STRING"),
    ("ANOMALY_THRESHOLD_HIGH", "0.50", "Week-over-week growth for HIGH alerts", "DECIMAL"),
    ("ANOMALY_THRESHOLD_MEDIUM", "0.25", "Week-over-week growth for MEDIUM alerts", "DECIMAL"),
    ("FORECAST_ENABLED", "TRUE", "Compute forecasts", "BOOLEAN"),
    ("FORECAST_HORIZON_DAYS", "365", "Forecast horizon in days", "INTEGER"),
    ("MIN_DATA_POINTS_FOR_FORECAST", "14", "Days of data needed for a forecast", "INTEGER"),
    ("MAX_CSV_UPLOAD_ROWS", "100000", "Row count above which an upload is flagged", "INTEGER"),
    ("ENABLE_USER_ATTRIBUTION", "TRUE", "Attribute spend to users", "BOOLEAN"),
    ("ENABLE_QUERY_COST_ANALYSIS", "TRUE", "Analyse cost per query", "BOOLEAN"),
    ("ENABLE_ML_FORECAST", "FALSE", "Use a trained forecast model", "BOOLEAN"),
    ("DEFAULT_CURRENCY", "USD", "Display currency", "STRING"),
    ("DECIMAL_PLACES", "2", "Decimal places of displayed money", "INTEGER"),
    ("CONFIG_VERSION", "1.0", "Settings schema version", "STRING"),
    ("DEPLOYMENT_DATE", None, "Date of the deployment", "TIMESTAMP"),  # the value is the time of the run
]

# alert level: message, action; {service} and {pct} are filled in
ALERT_TEXTS = {
    "HIGH": (
        "HIGH ALERT: {service} credits increased {pct}% vs last week",
        "INVESTIGATE: Review query patterns and user activity for {service}",
    ),
    "MEDIUM": (
        "MEDIUM ALERT: {service} credits increased {pct}% vs last week",
        "MONITOR: Track {service} usage closely over next few days",
    ),
    "DECLINING": (
        "DECLINING: {service} credits decreased {pct}% vs last week",
        "REVIEW: Check if decrease in {service} is expected",
    ),
    "NORMAL": ("NORMAL: No significant change detected", "Continue normal monitoring"),
}
ALERT_PRIORITY = {"HIGH": 3, "MEDIUM": 2, "DECLINING": 1}
ALERTS_NONE = "No active anomalies detected"
ALERTS_SOME = "{n} active anomalies detected"

# data-quality texts
ADVICE_MISSING_DATES = "Investigate missing dates - possible data pipeline issue"
ADVICE_CALCULATION = "Fix calculation errors in views"
ADVICE_NEGATIVE = "Investigate negative credit values"
ADVICE_NONE = "No critical issues detected"
SUMS_DIFFER = "FAIL - Views out of sync"
CHECKS_PASSED = "ALL TESTS PASSED - Deployment validated successfully"
CHECKS_FAILED = "{n} TEST(S) FAILED - Review failures above"
