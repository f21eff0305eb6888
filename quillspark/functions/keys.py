"""Normal forms of the ledger's keys and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\n\x0b\x0c\r"


def norm_key(c: Column | str) -> Column:
    """Keys compare without regard to letter case and outer white space."""
    return F.lower(F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANKS)))


def instant_us(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of a timestamp or of any ISO spelling of one; null where it is none.

    A spelling without a zone is UTC, whatever the session's time zone is.
    """
    text = F.btrim((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(BLANKS))
    zoned = F.when(text.rlike(r"^[+-]?\d{4,6}-\d{1,2}-\d{1,2}([ T][\d:.]+)?$"), F.concat(text, F.when(text.rlike("[ T]"), "Z").otherwise("T00:00:00Z"))).otherwise(text)
    return F.unix_micros(zoned.try_cast("timestamp"))


def micros(c: Column | str) -> Column:
    """Microseconds of a timestamp column, without the detour over text."""
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def fingerprint(*cols: Column, seed: int = 0) -> Column:
    """A 64-bit hash of the columns; different seeds give independent values."""
    return F.xxhash64(F.lit(seed), *cols)
