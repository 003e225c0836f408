"""Fixed values.

They are codes and factors of the log format and of the published jobs; results
agree only if they stay as they are.
"""

# Money units
MICROS_PER_UNIT = 1_000_000
CENTS_PER_UNIT = 100

# Metrics
DEFAULT_GMV_BIAS = 1.0
NO_EXPERIMENT = 0
PLATFORM_PRODUCT_TYPE = 25
PLATFORM_ACTION_TYPE = 204
PLATFORM_TRADE_TYPES = (1, 2)

# Impressions
EXCLUDED_GOAL = 7
PLACEMENT_TRIGGER_KEY = 9
NO_PLACEMENT = -1
CATEGORY_BASE = 21474836480
CATEGORY_STEP = 100

# Video play
PLAY_MILLIS_ABOVE = 1000
MILLIS_PER_SECOND = 1000
CLICKED_FINISH_TYPE = 2

# Repeats
LOOKBACK_ROWS = 10
CHUNK_ROWS = 10
MIN_REPEATS = 3

# Score consistency
SITE_SET = 25
SKIPPED_AD_TYPE = 1

# Position value
MIN_RETURNS = 100
REQUESTS_PER_RATE = 1000
DAYS_READ = 3

# Dates
DAY_FORMAT = "yyyyMMdd"
DAY_LENGTH = 8
LOG_ZONE_SECONDS = 8 * 3600
