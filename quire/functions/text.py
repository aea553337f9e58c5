"""Measuring and wrapping of texts as column expressions."""

from pyspark.sql import functions as F


def paragraphs(text, double: bool = False):
    """The paragraphs of a text: line ends are made one, then single or double ones part."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n\n" if double else "\n", -1)


def measured(text, widths: dict[str, int], other: int, size: float, spacing: float, word_spacing: float, scale: float, kerning: dict[str, int] | None = None, most: float | None = None):
    """struct(advance, fits) of a text on one line: each sign's width and what its pair with the sign before is kerned by, in thousandths, times the size, and the spacing,
    the word spacing with a blank; all times the scale. fits: how many signs from the first on end within `most`, all without one."""
    known = F.create_map(*(F.lit(x) for pair in widths.items() for x in pair))
    kerned = F.create_map(*(F.lit(x) for pair in (kerning or {"": 0}).items() for x in pair))

    def step(s, c):
        own = F.coalesce(F.element_at(known, c), F.lit(other)) + F.coalesce(F.element_at(kerned, F.concat(s["before"], c)), F.lit(0))
        total = s["advance"] + (own * (size / 1000) + spacing + F.when(c == " ", word_spacing).otherwise(0.0)) * scale
        fits = s["fits"] + (F.lit(1) if most is None else F.when(F.round(total, 6) <= most, 1).otherwise(0))
        return F.struct(total.alias("advance"), c.alias("before"), fits.cast("int").alias("fits"))

    start = F.struct(F.lit(0.0).alias("advance"), F.lit("").alias("before"), F.lit(0).alias("fits"))
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step)


def ascii_hex_decoded(text):
    """The bytes of hexadecimal digits up to the end mark; white space counts for nothing, and an odd last digit as followed by 0."""
    return F.transform(F.array(F.regexp_replace(F.substring_index(text, ">", 1), r"\s", "")), lambda d: F.unhex(F.when(F.length(d) % 2 == 1, F.concat(d, F.lit("0"))).otherwise(d)))[0]


def two_byte_codes(text):
    """Codes of two bytes each; a single last byte makes none."""
    byte = lambda i: F.conv(F.hex(F.substring(text.cast("binary"), i, 1)), 16, 10).cast("int")
    pairs = F.floor(F.octet_length(text) / 2).cast("int")
    return F.when(pairs < 1, F.lit([]).cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(1), pairs), lambda i: byte(2 * i - 1) * 256 + byte(2 * i)))


def wrapped(text, width: int):
    """struct(lines, longest, last): greedy lines of at most `width` signs. Blanks part words; a word goes on the line if it fits, else on a
    new one; a longer word than a line is split. Blanks at a line's end do not count."""
    words = F.filter(F.split(text, " "), lambda w: w != "")
    start = F.struct(F.lit(0).cast("long").alias("lines"), F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("last"))

    def add(s, w):
        n = F.length(w).cast("long")
        fits = (s["last"] > 0) & (s["last"] + 1 + n <= width)
        rest = F.when(n == 0, 0).otherwise((n - 1) % width + 1)  # what of a split word stands on its last line
        last = F.when(fits, s["last"] + 1 + n).otherwise(rest).cast("long")
        most = F.when(fits, last).otherwise(F.least(n, F.lit(width))).cast("long")
        more = F.when(fits, 0).otherwise(F.ceil(n / width)).cast("long")
        return F.struct((s["lines"] + more).alias("lines"), F.greatest(s["longest"], most).alias("longest"), last.alias("last"))

    return F.aggregate(words, start, add)
