"""Name patterns and thresholds that decide how a column is treated."""

# --- Fixed values -------------------------------------------------------------------------------------------
# Name patterns, searched anywhere in the column name without regard to case. They read the same in Java regular
# expressions and in RE2. The first direct-identifier kind that matches wins.
DIRECT_IDENTIFIER_PATTERNS = (
    ("email", r"(^|[_\s-])e?mail($|[_\s-])"),
    ("phone", r"phone|mobile|telephone|cell"),
    ("name", r"(^|[_\s-])(full_?)?name($|[_\s-])|first.?name|last.?name"),
    ("address", r"address|street|postcode|zip.?code"),
)
SENSITIVE_PATTERN = (
    r"gender|sex|ethnic|race|religion|disab|health|diagnos|politic|sexual|pregnan|nationality"
)
ID_PATTERN = r"(^id$|_id$|^id_|customer.?id|account.?id|user.?id|uuid)"
ID_HINT_PATTERN = r"customer|client|account|user|member|respondent|contact|record|code|key"
DEMOGRAPHIC_PATTERN = (
    r"(^age$|birth|income|gender|sex|region|country|city|postal|postcode|zip|education|occupation|marital|household)"
)
BEHAVIOUR_PATTERN = (
    r"recen|frequen|purchase|order|spend|revenue|monetary|engage|visit|session|usage|use_|needs?|benefit|"
    r"preference|satisf|loyal|discount|coupon|return|refund|attitude|importance|rating|score|value|"
    r"sensitiv|comfort|interest"
)
PROFILE_PATTERN = (
    r"age|income|region|country|city|education|occupation|household|family|lifestage|tenure|membership|"
    r"device|language|segment|tier|category|industry|size|channel|source|acquisition|media"
)
RAW_DATE_PATTERN = r"date|timestamp|datetime|created_at|updated_at"
# Value pattern: one @, no blanks, a dot after the @.
EMAIL_VALUE_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"

ALWAYS_BLOCKED = "demo_truth"
FAMILIAR_BASES = (
    "recency_days", "purchase_frequency", "annual_spend", "engagement_score",
    "discount_share", "return_rate", "satisfaction_score",
)
EMAIL_SHARE = 0.7
NUMERIC_SHARE = 0.90
FEW_LEVELS = 30
FIRST_BASES = 12
FIRST_DESCRIPTORS = 8
HIGH_CORRELATION = 0.85
HEAVY_MISSING = 0.4
MIN_CUSTOMERS = 30
MAX_BASES = 30
MAX_MODEL_COLUMNS = 200
RFM_FEATURES = (
    "recency_days", "frequency", "monetary_value", "average_order_value", "customer_tenure_days",
)
RFM_DEFAULT_BASES = ("recency_days", "frequency", "monetary_value")
# --- End of fixed values ------------------------------------------------------------------------------------
