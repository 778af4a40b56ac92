"""Publication dates. Pages carry local time at +08:00; an instant is what we keep."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from galley.functions.bind import let

SITE_OFFSET = "+08:00"

_FIELDS = (
    r"^(\d{4}) (\d{1,2}) (\d{1,2})(?: (AM|PM))? (\d{1,2}):(\d{1,2})(?::(\d{1,2}))?(?: (AM|PM))?$"
)


def parse_pubdate(raw: Column) -> Column:
    """Instant of a written date, NULL when it is none. The day-half mark may stand on either side."""
    text = F.replace(F.replace(raw, F.lit("上午"), F.lit("AM")), F.lit("下午"), F.lit("PM"))
    text = F.translate(F.regexp_replace(text, "[^0-9:/APM ]", " "), "/", " ")
    text = F.btrim(F.regexp_replace(F.regexp_replace(text, "(AM|PM)", " $1 "), " +", " "))

    def field(t: Column, i: int) -> Column:
        return F.regexp_extract(t, _FIELDS, i)

    def two(c: Column) -> Column:
        return F.lpad(c, 2, "0")

    def stamp(t: Column) -> Column:
        hour = let(
            F.struct(field(t, 5).try_cast("int").alias("h"), F.concat(field(t, 4), field(t, 8)).alias("half")),
            lambda x: F.when(x["half"] == "", x["h"]).when(
                x["half"].isin("AM", "PM") & x["h"].between(1, 12),
                x["h"] % 12 + F.when(x["half"] == "PM", 12).otherwise(0)),
        )
        second = F.coalesce(F.nullif(field(t, 7), F.lit("")), F.lit("0"))
        # NULL in any part makes the whole NULL
        return F.concat(
            field(t, 1), F.lit("-"), two(field(t, 2)), F.lit("-"), two(field(t, 3)), F.lit(" "),
            two(hour.cast("string")), F.lit(":"), two(field(t, 6)), F.lit(":"), two(second),
            F.lit(" " + SITE_OFFSET),
        )

    return F.try_to_timestamp(
        let(text, lambda t: F.when(t.rlike(_FIELDS), stamp(t))), F.lit("yyyy-MM-dd HH:mm:ss XXX")
    )


def pubdate_or(parsed: Column, as_of: Column) -> Column:
    """Fallback instant for pages without a readable date, given so that reruns agree."""
    return F.coalesce(parsed, as_of)


def fmt_pubdate(instant: Column) -> Column:
    """ISO form in site-local time, whatever the session's zone."""
    local = F.convert_timezone(None, F.lit(SITE_OFFSET), instant)
    return F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss'+0800'")


def date_digits(written: Column) -> Column:
    return F.regexp_replace(written, r"\D", "")
