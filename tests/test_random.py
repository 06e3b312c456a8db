"""Form expressions on random texts against small models in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewarden.functions import names, text, types

ALPHABET = ["a", "B", "_", "9", "-", " ", "\t", "\n", " ", "　", "'", "TB_", "SEQ_", ",", "desc", "Asc", "é"]
SPACE = " \t\n\x0b\f\r      　﻿" + "".join(map(chr, range(0x2000, 0x200B)))


@pytest.fixture(scope="module")
def given(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(12))) for _ in range(600)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return texts, frame


def check(given, expression, model):
    texts, frame = given
    found = dict(frame.select("i", expression).collect())
    for i, t in enumerate(texts):
        assert found[i] == model(t), repr(t)


def test_trim(given):
    check(given, text.trim_all(F.col("t")), lambda t: t.strip(SPACE))


def test_prefix(given):
    def model(t):
        upper = t.upper().strip(SPACE)
        return t if t == "" else upper if upper.startswith("TB_") else "TB_" + upper

    check(given, text.ensure_prefix(F.col("t"), "tb"), model)


def test_quote(given):
    check(given, text.sql_quote(F.col("t")), lambda t: "NULL" if t == "" else "'" + t.replace("'", "''") + "'")


def test_identifier(given):
    def model(t):
        if t == "":
            return "required"
        return None if re.fullmatch("[A-Z][A-Z0-9_]*", t.upper(), re.A) else "charset"

    check(given, names.check_name("f", F.col("t"))["rule"], model)


def test_index_items(given):
    def model(t):
        out = []
        for item in t.split(","):
            m = re.fullmatch(rf"([^{SPACE}]+)(?:[{SPACE}]+(asc|desc))?", item.strip(SPACE), re.I | re.A)
            if m:
                out.append(f"{m[1].upper()} {(m[2] or 'asc').upper()}")
        return out

    listed = F.transform(types.parse_index_columns(F.col("t")), lambda c: F.concat(c["name"], F.lit(" "), c["sort"]))
    check(given, listed, model)
