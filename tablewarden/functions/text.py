"""Column expressions for form text: trimming, quoting, flags, numbers and prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that a form's trim removes (more than the blanks that Spark's trim takes).
WHITESPACE = (
    " \t\n\x0b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)


def trim_all(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def blank_to_null(value: Column) -> Column:
    """Trimmed text, with the empty text as NULL."""
    return F.nullif(trim_all(value), F.lit(""))


def is_blank(value: Column) -> Column:
    return F.coalesce(value == "", F.lit(True))


def or_empty(value: Column) -> Column:
    """Text for concatenation, where NULL counts as the empty text."""
    return F.coalesce(value.cast("string"), F.lit(""))


def join_text(*parts: Column) -> Column:
    """Concatenation that a NULL part does not turn into NULL."""
    return F.concat(*[or_empty(p) for p in parts])


def sql_quote(value: Column) -> Column:
    """SQL literal of a text: quotes doubled, blank as ``NULL``."""
    quoted = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return F.when(is_blank(value), F.lit("NULL")).otherwise(quoted)


def yes_no(value: Column, default: str = "N") -> Column:
    """Flag letter of a boolean or of the text ``y``; blank takes the default, all else is ``N``."""
    text = F.upper(value.cast("string"))
    yes = F.when(F.typeof(value) == "boolean", text == "TRUE").otherwise(text == "Y")
    return F.when(is_blank(text), F.lit(default)).when(yes, F.lit("Y")).otherwise(F.lit("N"))


def flag_letter(value: Column) -> Column:
    """``Y`` only for ``Y``; everything else, NULL included, is ``N``."""
    return F.when(value == "Y", F.lit("Y")).otherwise(F.lit("N"))


def present_flag(value: Column) -> Column:
    return F.when(value.isNotNull(), F.lit("Y")).otherwise(F.lit("N"))


def number_or_null(value: Column, spark_type: str = "int") -> Column:
    """Number of a text; blank or unreadable text is NULL, fractions round half up."""
    exact = trim_all(value.cast("string")).try_cast("decimal(38,6)")
    return F.round(exact, 0).try_cast(spark_type)


def ensure_prefix(name: Column, prefix: str | Column) -> Column:
    """Upper-cased, trimmed name that starts with ``prefix`` and an underscore."""
    head = F.upper(prefix if isinstance(prefix, Column) else F.lit(prefix))
    lead = F.concat(head, F.lit("_"))
    upper = trim_all(F.upper(name))
    fixed = F.when(F.startswith(upper, lead), upper).otherwise(F.concat(lead, upper))
    return F.when(is_blank(name), name).otherwise(fixed)


def base_name(table: Column) -> Column:
    """Table name without its leading ``TB_``."""
    return F.regexp_replace(table, "^TB_", "")


def cut(value: Column, characters: int = 2000) -> Column:
    """First characters of a comment: the registry's description column holds 2000."""
    return F.substring(value, 1, characters)
