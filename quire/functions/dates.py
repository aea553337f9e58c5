"""Dates of documents: D:YYYYMMDDHHmmSS and an offset; parts from the right may be missing."""

from pyspark.sql import functions as F

PATTERN = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([Zz+\-])(?:(\d{2})'?(?:(\d{2})'?)?)?)?"
PRECISION = ("year", "month", "day", "hour", "minute", "second")


def to_pdf_date(ts):
    return F.concat(F.lit("D:"), F.date_format(ts, "yyyyMMddHHmmss"), F.lit("+00'00'"))


def parse_pdf_date(text):
    """struct(ts, precision, offset_min); null where the text is no date. Missing parts are the smallest, no offset is UTC."""
    # what matches is an element of an array, which the optimiser does not copy into each use of it
    matched = F.array(F.regexp_extract(text, PATTERN, 0))
    marked = lambda shape: F.translate(shape, "Zz+-D:'", "~~~~")
    sign = lambda shape: F.substring(F.translate(shape, "D:0123456789'", ""), 1, 1)
    parted = F.transform(matched, lambda shape: F.struct(sign(shape).alias("sign"), F.substring_index(marked(shape), "~", 1).alias("own"), F.when(sign(shape) == "", "").otherwise(F.substring_index(marked(shape), "~", -1)).alias("zone")))
    return F.transform(parted, _date)[0]


def _date(p):
    """The parts of a date from its digits, its sign and the digits of its offset, each at a fixed place."""
    part = lambda i: F.substring(p["own"], 2 * i + 1 if i > 1 else 1, 2 if i > 1 else 4)
    number = lambda digits, least: F.when(digits == "", F.lit(least)).otherwise(digits).cast("int")
    minutes = F.when(p["sign"] == "-", -1).otherwise(1) * (number(F.substring(p["zone"], 1, 2), 0) * 60 + number(F.substring(p["zone"], 3, 2), 0))
    ts = F.try_make_timestamp(number(part(1), 1), number(part(2), 1), number(part(3), 1), number(part(4), 0), number(part(5), 0), number(part(6), 0).cast("double"), F.lit("UTC")) - F.make_interval(mins=minutes)
    digits = F.length(p["own"])
    precision = F.when(digits < 4, None)
    for i, name in enumerate(PRECISION):
        precision = precision.when(digits < 6 + 2 * i, name)
    return F.when(digits >= 4, F.struct(ts.alias("ts"), precision.otherwise(PRECISION[-1]).alias("precision"), minutes.alias("offset_min")))
