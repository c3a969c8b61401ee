"""Constants of the risk model.

Everything in the block marked FIXED VALUES must equal the behaviour being
reproduced (limits, thresholds, weights, windows, message texts); the rest
are engine parameters of our own.
"""
from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the reproduced system; stated here as plain data)
# ---------------------------------------------------------------------------

LOCAL_TZ = "Asia/Tehran"

# Carrier-grade / private NAT ranges (CIDR).
NAT_RANGES = ["10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10"]
NAT_CONFIDENCE = 0.3
FULL_CONFIDENCE = 1.0

MAX_AMOUNT_RIAL = 500_000_000_000

# Fields that must be non-blank, in the order they are checked.
REQUIRED_NON_EMPTY = ["transaction_id", "card_pan", "account_number",
                      "national_code", "mobile", "ip_address", "device_fingerprint"]

# Accepted timestamp layouts, tried in this order (strptime notation):
#   %Y-%m-%dT%H:%M:%S   %Y-%m-%dT%H:%M:%SZ   %Y-%m-%dT%H:%M:%S%z
#   %Y/%m/%d %H:%M:%S   %Y-%m-%d %H:%M:%S    %d/%m/%Y %H:%M:%S
# then an ISO-8601 reader.

# Feature windows and the small-transaction cut used by the account features.
WINDOWS = ["1 hour", "6 hours", "24 hours", "7 days"]
WINDOW_SECONDS = {"1 hour": 3600, "6 hours": 21600, "24 hours": 86400, "7 days": 604800}
SMALL_TX_AMOUNT = 50_000_000
WATERMARK_DELAY = "1 hour"
TRIGGER_INTERVAL = "30 seconds"

# Account limits by account type.
#   type        single_tx        daily_total       structuring_threshold  structuring_count
LIMITS = [
    ("normal",     500_000_000,     2_000_000_000,    490_000_000,          3),
    ("commercial", 5_000_000_000,   20_000_000_000,   4_900_000_000,        5),
    ("vip",        50_000_000_000,  100_000_000_000,  49_000_000_000,       10),
]
DEFAULT_ACCOUNT_TYPE = "normal"  # our choice when the type is unknown

# Behaviour thresholds.
MULTI_CARD_IP_COUNT = 3
MULTI_CARD_DEVICE_COUNT = 3
NIGHT_HIGH_AMOUNT_RATIO = 0.5
FAIL_RATIO_THRESHOLD = 0.4
MULTI_ACCOUNT_CARD_COUNT = 3

# Severity weights added to the rule score (capped at 1.0 after each add).
SEVERITY_WEIGHT = {"low": 0.1, "medium": 0.25, "high": 0.4}
# Order used to rank alerts: high first, then medium, then low.
SEVERITY_RANK = {"high": 0, "medium": 1, "low": 2}
TOP_ALERTS = 5

# Final decision.
RULE_WEIGHT = 0.6
ML_WEIGHT = 0.4
BLOCK_THRESHOLD = 0.7
CRITICAL_THRESHOLD = 0.8
HIGH_THRESHOLD = 0.6
MEDIUM_THRESHOLD = 0.3
RISK_LEVELS = ["low", "medium", "high", "critical"]

# ML score weights (renormalised over the models that are present).
ML_WEIGHTS = {"lstm": 0.5, "autoencoder": 0.3, "behavioral": 0.2}
SEQ_LEN = 20
SEQUENCE_FEATURES = ["amount_rial_norm", "is_night", "ip_confidence", "is_carrier_nat",
                     "hour_sin", "hour_cos", "day_of_week_sin", "day_of_week_cos"]
BEHAVIORAL_FEATURES = ["avg_amount_30d", "std_amount_30d", "night_ratio_30d", "fail_ratio_30d",
                       "unique_ips_30d", "unique_devices_30d", "tx_count_30d",
                       "avg_tx_gap_hours_30d"]
N_CLUSTERS = 5
KMEANS_SEED = 42
KMEANS_STARTS = 10
AE_BOTTLENECK = 16
AE_PERCENTILE = 95.0
BEHAVIOR_MULTIPLIER = 2.5
PROFILE_NAMES = ["محافظه‌کار", "عادی", "پرتراکنش", "پرمبلغ", "مشکوک"]
UNKNOWN_PROFILE = "نامشخص"

# Identity graph.
ENTITY_LABELS = ["Card", "Account", "Mobile", "IP", "Device", "NationalCode"]
#   relation        target label     transaction column
RELATIONS = [
    ("OWNS_CARD",     "Card",          "card_pan"),
    ("OWNS_ACCOUNT",  "Account",       "account_number"),
    ("HAS_MOBILE",    "Mobile",        "mobile_normalized"),
    ("USES_IP",       "IP",            "ip_address"),
    ("USES_DEVICE",   "Device",        "device_fp_hash"),
    ("IDENTIFIED_BY", "NationalCode",  "national_code"),
]
PERSON_SUFFIX = "_person"
CLEANUP_DAYS = 30
SHARED_MIN_CONFIDENCE = 0.5
SHARED_LIMIT = 50
HIGH_RISK_MIN_CARDS = 3
HIGH_RISK_LIMIT = 100

# Monitoring table sizes.
RECENT_TX_LIMIT = 200
ALERT_FEED_LIMIT = 300
TIMELINE_LIMIT = 50

# Dead-letter source tag and topics.
DLQ_SOURCE = "bank_api"
TOPIC_CLEAN = "aml.transactions.clean"
TOPIC_FEATURES = "aml.features"

# Alert message texts (Persian), one template per rule; {name} marks a value.
MESSAGES = {
    "R001": "مبلغ تراکنش {amount} ریال از سقف {limit} ریال بیشتره",
    "R002": "مجموع روزانه {daily_total} ریال از سقف {limit} ریال بیشتره",
    "R003": "الگوی structuring: {small_count} تراکنش زیر سقف در ۲۴ ساعت",
    "R004": "IP {ip} در ۱ ساعت با {unique_cards} کارت مختلف استفاده شده",
    "R005": "دستگاه {device8}... با {unique_cards} کارت مختلف",
    "R006": "تراکنش {percent}٪ سقف روزانه در ساعت شب",
    "R007": "نسبت تراکنش ناموفق {percent}٪ در ۱ ساعت",
    "R008": "یه کارت با {unique_accounts} حساب مختلف در ۲۴ ساعت",
}

# ---------------------------------------------------------------------------
# Engine parameters (ours)
# ---------------------------------------------------------------------------

# Width of time chunks (seconds) used to split hot keys in ordered operators.
CHUNK_SECONDS = 60
