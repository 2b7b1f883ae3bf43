"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a blank around an id.
BLANKS = " \t\n\r\x0b\x0c 　"


def clean_id(column: str | Column) -> Column:
    """An id in lower case without surrounding blanks; a blank one is null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.nullif(F.lower(F.btrim(c.cast("string"), F.lit(BLANKS))), F.lit(""))


def month_number(ts: Column) -> Column:
    """Months since year 0; safe for timestamps without zone in any session time zone."""
    d = ts.cast("date")
    return F.year(d) * 12 + F.month(d) - 1


def month_text(number: Column) -> Column:
    """``yyyy-MM`` of a month number."""
    return F.concat_ws("-", F.lpad(F.floor(number / 12).cast("string"), 4, "0"), F.lpad((number % 12 + 1).cast("string"), 2, "0"))
