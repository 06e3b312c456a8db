"""Masking rules: the name of the masking function in DDL, and native masking expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_function_name(rule: Column) -> Column:
    """Every known rule maps to ``FN_MASK_`` and its code, and so does an unknown one."""
    return F.concat(F.lit("FN_MASK_"), rule)


def _full(c):
    return F.when(c.isNotNull(), F.lit("********"))


def _where(fits, shown, c):
    """The masked form of a value that fits its rule's pattern; any other value is masked whole."""
    return F.when(fits, shown).otherwise(_full(c))


def _stars(n):
    return F.repeat(F.lit("*"), n.cast("int"))


def _name(c):
    return _where(F.length(c) > 1, F.concat(F.substring(c, 1, 1), _stars(F.length(c) - 1)), c)


def _resident_number(c):
    return _where(F.length(c) > 6, F.concat(F.substring(c, 1, 6), _stars(F.length(c) - 6)), c)


_PHONE = r"\A(\d{2,4}-?)\d{3,4}(-?\d{4})\z"
_EMAIL = r"\A(.)[^@]*(@[^@]+)\z"


def _phone(c):
    return _where(F.rlike(c, F.lit(_PHONE)), F.regexp_replace(c, _PHONE, "$1****$2"), c)


def _card(c):
    return _where(F.length(c) > 4, F.concat(_stars(F.length(c) - 4), F.right(c, F.lit(4))), c)


def _email(c):
    return _where(F.rlike(c, F.lit(_EMAIL)), F.regexp_replace(c, _EMAIL, "$1****$2"), c)


def _address(c):
    return _where(F.instr(c, " ") > 1, F.concat(F.substring_index(c, " ", 1), F.lit(" ****")), c)


# The masking functions are known by name only; these bodies are our choice.
MASKS = {
    "NAME": _name,
    "RRN": _resident_number,
    "PHONE": _phone,
    "CARD": _card,
    "EMAIL": _email,
    "ADDR": _address,
    "FULL": _full,
}


def mask(value: Column, rule: str) -> Column:
    """Masked text of a value; a rule without an expression masks everything."""
    return MASKS.get(rule, _full)(value.cast("string"))
