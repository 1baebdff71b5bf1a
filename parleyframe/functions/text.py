"""String expressions with Python's whitespace and formatting rules.

Spark's own ``trim`` only knows the space character and its ``%.1f`` rounds
half up, so the few places where that matters are spelled out here.
"""

from pyspark.sql import functions as F

# Code points of the characters Python treats as whitespace.
SPACE_CODES = (
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680,
    0x2000, 0x2001, 0x2002, 0x2003, 0x2004, 0x2005, 0x2006, 0x2007, 0x2008, 0x2009, 0x200A,
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
SPACE_CHARS = "".join(map(chr, SPACE_CODES))
# The same set for Java patterns, several times faster than listing it.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"


def strip(c):
    """Remove leading and trailing whitespace of any kind."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def words(c):
    """Split on whitespace runs; blank text has no words."""
    bare = strip(c)
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, SPACE_RUN))


def limit_words(c, most):
    """Text with at most ``most`` words is returned untouched; longer text is
    cut to that many words, joined by single spaces."""
    # The split stops at the word that is one too many; a short text needs none,
    # as more than n words take at least 2n + 1 characters.  Going through an
    # array of one keeps Spark from splitting twice.
    parts = F.array(F.split(strip(c), SPACE_RUN, most + 1))
    cut = F.transform(parts, lambda p: F.when(
        F.size(p) > most, F.array_join(F.slice(p, 1, most), " ")))[0]
    return F.when(F.length(c) <= 2 * most, c).otherwise(F.coalesce(cut, c))


def show_title(name):
    """The part of an episode name before the first `` - ``."""
    return F.split_part(name, F.lit(" - "), F.lit(1))


def fixed(x, digits):
    """Decimal text rounded like Python's ``f"{x:.{digits}f}"``."""
    x = x.cast("double")
    shown = F.call_function(
        "format_number", x, F.lit("0." + "0" * digits if digits else "0"))
    return (
        F.when(F.isnan(x), "nan")
        .when(x == float("inf"), "inf")
        .when(x == float("-inf"), "-inf")
        .otherwise(shown))


def timed_line(start, end, text):
    """One printable transcript line."""
    return F.concat(
        F.lit("["), fixed(start, 2), F.lit("s -> "), fixed(end, 2), F.lit("s]: "), text)


def speaker_label(number):
    return F.format_string("SPEAKER_%02d", number)
