"""Text expressions: Python-style white space, code points, tokens for language models, display helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.strip() and str.split() take as white space: the Unicode class and the four separators U+001C-U+001F.
SPACE = r"[\x1c-\x1f\x85\p{IsWhite_Space}]"
SPACE_TOKEN = "<SPACE>"


def strip(text: Column) -> Column:
    """Without leading and trailing white space."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def has_text(text: Column) -> Column:
    """Whether strip() leaves something, found at the first character that is no white space."""
    return F.rlike(text, F.lit("[^" + SPACE[1:]))


def words(text: Column) -> Column:
    """Split on runs of white space, no empty words; [] for null."""
    return F.coalesce(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""), F.array().cast("array<string>"))


def chars(text: Column) -> Column:
    """Code points; [] for null and empty."""
    return F.coalesce(F.filter(F.split(text, ""), lambda c: c != ""), F.array().cast("array<string>"))


def char_count(text: Column) -> Column:
    """Code points but line feeds; 0 for null."""
    return F.coalesce(F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(0))


def lm_tokens(text: Column) -> Column:
    """Characters separated by spaces, a space written as a token; null for blank lines."""
    line = strip(text)
    tokens = F.transform(chars(line), lambda c: F.when(c == " ", F.lit(SPACE_TOKEN)).otherwise(c))
    return F.when(line != "", F.array_join(tokens, " "))


def usable_text(text: Column) -> Column:
    """A single point in place of missing, blank and 'nan' texts, as a trainer needs some target."""
    bad = text.isNull() | (strip(text) == "") | (F.lower(strip(text)) == "nan")
    return F.when(bad, F.lit(".")).otherwise(text)


def error_type(message: Column) -> Column:
    """What stands before the first colon, else the first 50 characters."""
    return F.when(F.contains(message, F.lit(":")), F.substring_index(message, ":", 1)).otherwise(F.left(message, F.lit(50)))


def shortened_path(path: Column, most: int = 40) -> Column:
    """The end of paths of more than `most` characters, behind three points."""
    return F.when(F.length(path) > most, F.concat(F.lit("..."), F.right(path, F.lit(most - 3)))).otherwise(path)


def duration_text(seconds: Column) -> Column:
    """1h 2m 3s, 2m 3s or 3s."""
    s = seconds.cast("bigint")
    h, m, r = F.floor(s / 3600), F.floor(s / 60) % 60, s % 60
    return F.when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def eta_minutes(images: Column, per_minute: Column) -> Column:
    """Minutes to go; null where the speed is unknown or not positive."""
    return F.when(per_minute > 0, images / per_minute)


def padded_id(number: Column, width: int = 6) -> Column:
    """A zero-padded id, never cut."""
    s = number.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def flat_options(options: Column) -> Column:
    """Trimmed, non-empty entries of a list of comma lists."""
    parts = F.flatten(F.transform(options, lambda o: F.split(o, ",")))
    return F.filter(F.transform(parts, strip), lambda o: o != "")


def percent_text(share: Column, missing: str = "N/A") -> Column:
    """A share as 12.34%."""
    return F.coalesce(F.when(share.isNotNull(), F.format_string("%.2f%%", share.cast("double") * 100)), F.lit(missing))
