"""Number parsing and comparison with Python's rules."""

from pyspark.sql import functions as F

from parleyframe.functions.text import strip

# Number texts Python's float() accepts.
DECIMAL_PATTERN = (
    r"^[+-]?(([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?$"
)
INFINITY_PATTERN = r"(?i)^[+-]?inf(inity)?$"
NAN_PATTERN = r"(?i)^[+-]?nan$"
# Texts whose sum a decimal of 38 digits holds.
SHORT_PATTERN = r"^[+-]?[0-9]{1,18}(\.[0-9]{0,18})?$"


def parse_float(c):
    """Text to double; NULL where Python would raise."""
    bare = strip(c)
    return (
        F.when(bare.rlike(DECIMAL_PATTERN),
               F.translate(bare, "_", "").try_cast("double"))
        .when(bare.rlike(INFINITY_PATTERN),
              F.when(bare.startswith("-"), float("-inf")).otherwise(float("inf")))
        .when(bare.rlike(NAN_PATTERN), float("nan")))


def sum_of_texts(a, b):
    """The double nearest to the sum of two numbers as they are written; NULL where
    one is long or has an exponent."""
    def exact(c):
        return F.when(c.rlike(SHORT_PATTERN), c.try_cast("decimal(37,18)"))
    return (exact(strip(a)) + exact(strip(b))).cast("double")


def at_least(x, bound):
    """``x >= bound``, false for NaN (Spark alone ranks NaN above every number)."""
    return F.coalesce((x >= bound) & ~F.isnan(x), F.lit(False))


def required(value, message):
    """``value``, or an error that fails the job where it is NULL."""
    return F.when(value.isNotNull(), value).otherwise(
        F.raise_error(message))
