"""Fixed values.

Everything in this module is a constant that results depend on: code lists,
accepted formats, column names, lag sets and labels.  Every function that uses
one takes it as a default argument, so other data sets can bring their own.
"""

# Incident codes that count as a hit.
HIT_CODES = (
    "EDP", "ALTMEN", "ALTMFC", "ALTMFT", "JUMPDN", "JUMPUP", "JUMPDC",
    "OD", "ODC", "POISON", "DRUG",
)

# Flag spellings that mean "yes".
TRUTHY = ("Y", "YES", "TRUE", "1")

# Dispositions of incidents that never took place.
VOID_DISPOSITIONS = ("CANCEL", "NOTSNT", "DUP")
VOID_DISPOSITION_NUMBER = 87

# Columns of the raw log.
LOG_COLUMNS = (
    "incident_datetime", "communitydistrict", "final_call_type",
    "incident_disposition_code", "special_event_indicator",
    "standby_indicator", "transfer_indicator",
)

# Timestamp layouts in the order they are tried, each with the
# shape of text it can fit.  One-letter fields accept one or two digits.
TIMESTAMP_FORMATS = (
    ("yyyy-M-d H:m:s", r"^\d+-\d+-\d+ \d+:\d+:\d+$"),
    ("yyyy-M-d'T'H:m:s", r"^\d+-\d+-\d+T\d+:\d+:\d+$"),
    ("M/d/yyyy H:m:s", r"^\d+/\d+/\d+ \d+:\d+:\d+$"),
    ("M/d/yyyy h:m:s a", r"^\d+/\d+/\d+ \d+:\d+:\d+ [AaPp][Mm]$"),
)

# Day layouts beside the standard ones, each with the shape of text
# it can fit.  Month first goes before day first where both fit as many rows.
DAY_LAYOUTS = (
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M-d-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d-M-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("d.M.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("yyyyMMdd", r"^\d{8}$"),
    ("yyyy/M/d", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]{4,} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("d MMMM yyyy", r"^\d{1,2} [A-Za-z]{4,} \d{4}$"),
    ("d-MMM-yyyy", r"^\d{1,2}-[A-Za-z]{3}-\d{4}$"),
)

# Column names a signal file may use.
DATE_NAMES = ("date", "day", "created_at")
COUNT_NAMES = ("count", "tweet_count", "tweets", "n", "value", "total")

# Lag sets of the model families.
MODEL_LAGS = (0, 1, 2, 3, 7, 14, 21, 28)
FEATURE_LAGS = tuple(range(29))
THRESHOLD_LAGS = (0, 1, 2, 3, 7, 14)
INTERACTION_LAGS = (0, 1, 7, 14)
CUMULATIVE_LAGS = (0, 1, 2, 3, 4, 5, 6, 7)
COMPARISON_LAGS = (0, 1, 7, 14)
BACKWARD_LAGS = (0, 1, 2, 3, 7)
LEAD_STEPS = (1, 2, 3, 4, 5, 6, 7)

# Event definition.
THRESHOLDS = (1.0, 1.5, 2.0)
EVENT_THRESHOLD = 1.5
PROFILE_REACH = 20
EVENT_TIME_REACH = 14
REFERENCE_OFFSET = -1

# Sample rules.
MIN_TOTAL = 5
MIN_ROWS = 100

# Bucket labels.
QUINTILE_LABELS = ("0-20", "20-40", "40-60", "60-80", "80-100")
QUARTILE_LABELS = ("Q1", "Q2", "Q3", "Q4")

# Period codes (first day, last day, code); other days are 0.
PERIODS = (
    ("2020-03-01", "2020-06-30", 1),
    ("2020-07-01", None, 2),
)

# Area names and their codes; unit code = area * 100 + number.
AREA_CODES = (
    ("manhattan", 1),
    ("bronx", 2),
    ("brooklyn", 3),
    ("queens", 4),
    ("staten island", 5),
)

# Rows of the sectioned sheet (label, output column, cell index).
GRID_VARIABLES = (
    ("Total Population", "total_population", 7),
    ("White Nonhispanic", "pct_white", 8),
    ("Black Nonhispanic", "pct_black", 8),
    ("Hispanic Origin", "pct_hispanic", 8),
    ("Asian and Pacific Islander Nonhispanic", "pct_asian", 8),
    ("Total Households", "total_households", 7),
    ("Owner occupied", "pct_owner_occupied", 8),
    ("Renter occupied", "pct_renter_occupied", 8),
)

# Two-sided 95% normal quantile used for intervals and flags.
Z95 = 1.96

# Layout of a sheet's section and the words of its extra rows.
SECTION_SKIP_ROWS = 4
INCOME_WORD, LEGACY_INCOME_WORD = "income", "median"
COLLEGE_WORDS = ("bachelor", "college", "degree")
POVERTY_WORD = "poverty"
EXTRA_CELLS = (7, 8, 5, 6)
