"""Fixed values. These decide results, so they are stated once, here, as plain text."""

# --- step names of a saved spec, with the title shown in metrics ---------------------------
STEP_TITLES = {
    "TRIM_WHITESPACE": "Trim Whitespace",
    "REMOVE_EMPTY_ROWS": "Remove Empty Rows",
    "REMOVE_EMPTY_COLUMNS": "Remove Empty Columns",
    "REMOVE_DUPLICATES": "Remove Duplicates",
    "REMOVE_COLUMNS": "Remove Columns",
    "RENAME_COLUMNS": "Rename Columns",
    "REORDER_COLUMNS": "Reorder Columns",
    "FILL_MISSING": "Fill Missing Values",
    "NORMALIZE_DATES": "Normalize Dates",
    "NORMALIZE_NUMBERS": "Normalize Numbers",
    "NORMALIZE_BOOLEANS": "Normalize Booleans",
    "FILTER_ROWS": "Filter Rows",
    "REPLACE_VALUES": "Replace Values",
    "MASK_COLUMN": "Mask",
    "REDACT_COLUMN": "Redact",
    "HASH_COLUMN": "Hash",
    "PSEUDONYMIZE_COLUMN": "Pseudonymize",
    "GENERALIZE_COLUMN": "Generalize",
    "REVENUE_BANDS": "Revenue Bands",
    "SUPPRESS_LOW_COUNTS": "Suppress Low Counts",
}
SPEC_VERSION = 1

# --- words of normalize_booleans ----------------------------------------------------------
TRUE_WORDS = ("yes", "y", "true", "t", "1", "1.0", "on", "active", "enabled")
FALSE_WORDS = ("no", "n", "false", "f", "0", "0.0", "off", "inactive", "disabled")

# --- signs and shapes of normalize_numbers ------------------------------------------------
CURRENCY_SIGNS = "£$€¥₹₽"
GROUPED_BY_DOTS = r"^\d{1,3}(\.\d{3})+(,\d+)?$"

# --- revenue_bands: upper edges (inclusive) and labels ------------------------------------
BAND_EDGES = (10_000, 50_000, 100_000, 500_000, 1_000_000)
BAND_LABELS = ("<10K", "10K–50K", "50K–100K", "100K–500K", "500K–1M", "1M+")

# --- defaults of the privacy steps --------------------------------------------------------
MASK_CHAR = "*"
MASK_SHOW_LAST = 4
REDACTED = "[REDACTED]"
SUPPRESSED = "[SUPPRESSED]"
PSEUDONYM_PREFIX = "ENTITY"
PSEUDONYM_SEED = 42

# --- detection by column name: (pattern, category, confidence, action) --------------------
NAME_RULES = (
    (r"(?i)\b(e[-_]?mail|email[-_]?addr)\b", "email", 0.85, "mask"),
    (r"(?i)\b(phone|tel|mobile|cell|fax|contact[-_]?num)\b", "phone", 0.80, "mask"),
    (r"(?i)\b(ssn|social[-_]?sec|national[-_]?id|sin|nino|tax[-_]?id)\b", "ssn", 0.95, "hash"),
    (r"(?i)\b(first[-_]?name|last[-_]?name|full[-_]?name|surname|given[-_]?name)\b", "name", 0.80, "pseudonymize"),
    (r"(?i)^name$", "name", 0.70, "pseudonymize"),
    (r"(?i)\b(address|street|city|state|zip[-_]?code|postal[-_]?code|country)\b", "address", 0.75, "redact"),
    (r"(?i)\b(dob|date[-_]?of[-_]?birth|birth[-_]?date|birthday)\b", "dob", 0.85, "generalize"),
    (r"(?i)\b(salary|income|revenue|wage|pay|compensation|credit[-_]?card|card[-_]?num|account[-_]?num|bank)\b", "financial", 0.80, "mask"),
    (r"(?i)\b(employee[-_]?id|customer[-_]?id|user[-_]?id|patient[-_]?id|member[-_]?id|passport)\b", "identifier", 0.70, "hash"),
    (r"(?i)\b(ip[-_]?addr|ip[-_]?address)\b", "ip_address", 0.80, "mask"),
    (r"(?i)\b(password|passwd|pwd|secret|token|api[-_]?key)\b", "credential", 0.95, "redact"),
)

# --- detection by value: (category, pattern, highest confidence, action) ------------------
VALUE_RULES = (
    ("email", r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$", 0.90, "mask"),
    ("phone", r"^[\+]?[\d\s\-\.\(\)]{7,18}$", 0.60, "mask"),
    ("ssn", r"^\d{3}[-\s]?\d{2}[-\s]?\d{4}$", 0.95, "hash"),
    ("credit_card", r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$", 0.95, "redact"),
    ("ip_address", r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$", 0.75, "mask"),
)
VALUE_RATE_NEEDED = 0.5
CONFIDENCE_CEILING = 0.99
CONFIDENCE_NEEDED = 0.3
HIGH_CONFIDENCE = 0.75
MEDIUM_CONFIDENCE = 0.5
CATEGORY_LABELS = {
    "email": "Email",
    "phone": "Phone Number",
    "ssn": "National ID / SSN",
    "name": "Name",
    "address": "Address",
    "dob": "Date of Birth",
    "financial": "Financial",
    "identifier": "Identifier",
    "ip_address": "IP Address",
    "credential": "Credential",
    "credit_card": "Credit Card",
}

# --- cells of a delimited file that stand for a missing value -----------------------------
MISSING_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# --- layout detection ---------------------------------------------------------------------
DELIMITERS = ("\t", ",", ";", "|")
HEADER_SCAN_ROWS = 40
HEADER_SCORE_NEEDED = 1.5

# --- sizes --------------------------------------------------------------------------------
PREVIEW_ROWS = 200
PAGE_SIZES = (25, 50, 100, 500)
OUTPUT_SUFFIX = "_sanitized"

# --- month and weekday codes of a strftime pattern, as Spark datetime patterns -------------
STRFTIME_TO_SPARK = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD",
    "F": "yyyy-MM-dd", "T": "HH:mm:ss", "R": "HH:mm", "D": "MM/dd/yy",
}

# Our own: columns that tell where a row stands in the files it comes from. They are no data.
ROW_ORDER = ["__file", "__block", "__row_id"]
