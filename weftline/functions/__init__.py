"""Scalar functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_size(text: Column) -> Column:
    """Bytes of a size such as ``12345``, ``1k`` or ``2Gb`` (powers of 1024), as decimal(38,0); -1 if it isn't one, null beyond 20 digits."""
    number = F.regexp_extract(F.lower(text), r"^([0-9]+)(?:([kmgtp])b?)?$", 1)
    unit = F.regexp_extract(F.lower(text), r"^([0-9]+)(?:([kmgtp])b?)?$", 2)
    factor = F.lit(1).cast("decimal(20,0)")
    for power, letter in enumerate("kmgtp", 1):
        factor = F.when(unit == letter, F.lit(1024**power).cast("decimal(20,0)")).otherwise(factor)
    # 20 digits times the largest factor, which has 16, stay within 38.
    whole = F.when(F.length(number) <= 20, number).cast("decimal(20,0)")
    return F.when(number == "", F.lit(-1).cast("decimal(38,0)")).otherwise((whole * factor.cast("decimal(17,0)")).cast("decimal(38,0)"))


def format_size(size: Column, unit: int, suffix: str) -> Column:
    """Whole units above one unit, else two decimals without trailing zeros."""
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", size.cast("double") / unit), "0+$", ""), r"\.$", "")
    return F.concat(F.when(size > unit, F.floor(size / unit).cast("long").cast("string")).otherwise(small), F.lit(suffix))


def pretty_size(size: Column) -> Column:
    """In g above a GiB, in m above a MiB, else in k."""
    return F.when(size > 1 << 30, format_size(size, 1 << 30, "g")).when(size > 1 << 20, format_size(size, 1 << 20, "m")).otherwise(format_size(size, 1 << 10, "k"))


#: Characters that a shell would take as its own (fixed values).
SPECIAL = " `\"\\#()!~&<>|;*?\t$"


def quote(text: Column) -> Column:
    """A shell argument: as it is; in single quotes if it has special characters; with single quotes escaped if it has those alone; with all escaped if it has both."""
    one_of = "[" + "".join("\\" + c for c in SPECIAL) + "]"
    special, single = text.rlike(one_of), text.contains("'")
    escaped = F.regexp_replace(text, "(" + one_of + "|')", r"\\$1")
    return F.when(special & ~single, F.concat(F.lit("'"), text, F.lit("'"))).when(special | single, escaped).otherwise(text)


def pad(number: Column, width: int, suffix: str) -> Column:
    """Zero-padded to ``width``; longer numbers keep all digits."""
    text = number.cast("string")
    return F.concat(F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0")), F.lit(suffix))


def words_in_line(line: Column) -> Column:
    """Pieces between single spaces, without trailing empty ones; 1 for an empty line, 0 for one of spaces alone."""
    return F.when(line == "", 1).when(F.rtrim(line) == "", 0).otherwise(F.size(F.split(F.rtrim(line), " ")))


def human_name(name: Column) -> Column:
    """Words of a joined name: one begins at a capital after anything else, at the last of several capitals before a small letter, and at what is no letter after a letter."""
    def at(i: Column, back: int) -> Column:
        return F.substring(name, i - back, F.lit(1))

    def is_(c: Column, kind: str) -> Column:
        return c.rlike(f"^{kind}$")

    def piece(i: Column) -> Column:
        before, here, after = at(i, 1), at(i, 0), at(i, -1)
        capital, letter = "[A-Z]", "[A-Za-z]"
        starts = is_(here, capital) & (~is_(before, capital) | is_(after, "[a-z]")) | is_(before, letter) & ~is_(here, letter)
        return F.when((i > 1) & starts, F.concat(F.lit(" "), here)).otherwise(here)

    return F.when(F.length(name) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(name)), piece), "")).otherwise(name)


def replace_extension(path: Column, extension: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def truncate(text: Column, width: int) -> Column:
    """At most ``width`` characters: longer texts end in three dots, which count."""
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, max(0, width - 3)), F.lit("..."[: min(3, width)]))).otherwise(text)


def or_na(value: Column) -> Column:
    """As text; NA if null."""
    return F.coalesce(value.cast("string"), F.lit("NA"))


def elapsed(start: Column, end: Column) -> Column:
    """Whole seconds between two times, as text; NA if one is missing."""
    return or_na(F.unix_timestamp(end) - F.unix_timestamp(start))


def timestamp_or_na(time: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return or_na(F.date_format(time, pattern))


def min_identical(given: Column, n: Column, least: int = 10_000_000) -> Column:
    """How many letters are to agree: as given up to ``least`` records or if their number is unknown, else by the log of the number."""
    return F.when(n.isNull() | (n < least), given).otherwise(F.ceil(F.ln(n) / F.ln(F.lit(4.0)) - 7)).cast("int")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def metrics_path(source: Column, kind: str, prefix: Column | None = None, extension: str = "") -> Column:
    """``prefix`` (the source without its extension, if none is given) with the extension and the kind of metrics."""
    return F.concat(F.coalesce(prefix if prefix is not None else F.lit(None).cast("string"), replace_extension(source, "")), F.lit(f"{extension}.{kind}"))


def rename_file(path: Column, old: str, new: str) -> Column:
    """The path with ``old`` replaced in its last part alone."""
    name = base_name(path)
    return F.concat(F.substring(path, F.lit(1), F.length(path) - F.length(name)), F.replace(name, F.lit(old), F.lit(new)))


def checked(value: Column, bad: Column, message: str) -> Column:
    """The value; a row where ``bad`` holds fails the query."""
    return F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{message}: "), value.cast("string")))).otherwise(value)


def without_separator(text: Column, separator: str) -> Column:
    return checked(text, text.contains(separator), f"holds the separator {separator}")


def plain_structure(structure: Column) -> Column:
    """A read structure without molecular and skipped segments."""
    return checked(structure, structure.rlike("[MS]"), "segments of kind M or S")


def segments(structure: Column, kind: str) -> Column:
    """(start, length) of the segments of one kind of a read structure such as 8M2S10T; a last length of + is null."""
    parts = F.regexp_extract_all(structure, F.lit(r"([0-9]+|\+)([A-Z])"), F.lit(0))
    sizes = F.transform(parts, lambda p: F.when(p.startswith("+"), None).otherwise(F.regexp_extract(p, "[0-9]+", 0).cast("int")))
    each = F.transform(parts, lambda p, i: F.struct(F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(1), lambda a, n: a + n).alias("start"), F.get(sizes, i).alias("length"), F.right(p, F.lit(1)).alias("kind")))
    return F.transform(F.filter(each, lambda s: s["kind"] == kind), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
