"""Number functions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..rules.insights import SEVERITY_RANK
from ..rules.steps import IMAGE_TOKENS
from .lookup import map_value

CURRENCY = r"(?i)[£$€¥₹]|USD|GBP|EUR|INR|JPY"
LEADING_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+))"


def half_up(x: Column) -> Column:
    """Nearest whole number; halves go up."""
    return F.floor(x + 0.5)


def parse_price(text: Column) -> Column:
    """Number at the start of a price text once symbols, commas and spaces are gone."""
    bare = F.regexp_replace(text, r"[£$€¥₹,\s]", "")
    return F.nullif(F.regexp_extract(bare, LEADING_NUMBER, 1), F.lit("")).try_cast("double")


def first_price(text: Column) -> Column:
    """First number of up to six digits and two decimals anywhere in the text."""
    bare = F.replace(text, F.lit(","), F.lit(""))
    return F.nullif(F.regexp_extract(bare, r"(\d{1,6}(?:\.\d{1,2})?)", 1), F.lit("")).try_cast("double")


def price_currency(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, f"({CURRENCY})", 1), F.lit(""))


def prices_match(a: Column, b: Column, tolerance_percent: float = 5.0) -> Column:
    apart = F.abs(a - b) / ((a + b) / 2) * 100
    return F.when((a == 0) & (b == 0), True).when((a == 0) | (b == 0), False).otherwise(apart <= tolerance_percent)


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def normalize_confidence(x: Column) -> Column:
    """Percent becomes a share, everything is held in [0, 1], missing counts 0.5."""
    return F.when(x.isNull(), 0.5).when((x > 1) & (x <= 100), x / 100).otherwise(clamp01(x))


def noisy_or(weights: Column) -> Column:
    """1 - prod(1 - w) over an array, folded from the smallest weight up so that order does not matter."""
    return F.aggregate(F.array_sort(weights), F.lit(0.0),
                       lambda acc, w: acc + clamp01(w) - acc * clamp01(w))


def image_tokens(width: Column, height: Column) -> Column:
    tiles = F.ceil(width / 512) * F.ceil(height / 512)
    return F.when((width <= 0) | (height <= 0), IMAGE_TOKENS).otherwise(tiles * IMAGE_TOKENS + IMAGE_TOKENS).cast("bigint")


def text_tokens(chars: Column) -> Column:
    """Whole quarter of a character count, rounded up, in integers."""
    return F.floor((chars + 3) / 4).cast("bigint")


def severity_rank(severity: Column) -> Column:
    return map_value(severity, SEVERITY_RANK, 0)
