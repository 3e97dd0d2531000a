"""Invoice dates, computed without reference to the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tillroll.schema import DATE_PATTERN


def month_start(timestamp: Column) -> Column:
    """First day of the month, as a DATE.

    ``date_trunc`` would take a zone-free timestamp through the session zone,
    where midnight may not exist; ``trunc`` on a date does not.
    """
    return F.trunc(timestamp.cast("date"), "month")


def parse_invoice_date(text: Column, strict: bool = True) -> Column:
    """Read ``month/day/year hour:minute`` text as a zone-free timestamp.

    Malformed text is an error in every session mode, or NULL with ``strict=False``.
    """
    form = r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$"

    def cut(value: Column, mark: str, index: int) -> Column:
        return F.split_part(value, F.lit(mark), F.lit(index))

    day, time = cut(text, " ", 1), cut(text, " ", 2)
    parts = [cut(day, "/", 3), cut(day, "/", 1), cut(day, "/", 2), cut(time, ":", 1), cut(time, ":", 2)]
    made = F.try_make_timestamp_ntz(*[p.try_cast("int") for p in parts], F.lit(0))
    # One match checks the whole text; after it the parts lie between fixed marks.
    parsed = F.when(text.rlike(form), made)
    if not strict:
        return parsed
    error = F.raise_error(F.concat(F.lit(f"cannot parse as {DATE_PATTERN}: "), text))
    return F.coalesce(parsed, F.when(text.isNotNull(), error))


def as_invoice_text(timestamp: Column) -> Column:
    """The text form ``parse_invoice_date`` reads; NULL stays NULL.

    The form has no seconds, so a time that has some is an error.
    """
    minute = F.lpad(F.minute(timestamp).cast("string"), 2, "0")
    text = F.concat(
        F.concat_ws("/", F.month(timestamp), F.dayofmonth(timestamp), F.year(timestamp)),
        F.lit(" "),
        F.concat_ws(":", F.hour(timestamp), minute),
    )
    seconds = F.date_part(F.lit("SECOND"), timestamp)
    error = F.raise_error(
        F.concat(F.lit("an invoice date has no seconds: "), timestamp.cast("string"))
    )
    return F.when(timestamp.isNull(), F.lit(None)).when(seconds != 0, error).otherwise(text)
