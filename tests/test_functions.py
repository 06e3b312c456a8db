from pyspark.sql import functions as F

from tablewarden.functions import masking, names, text, types


def one(spark, expression, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    df = spark.createDataFrame([tuple(values.values()) or (None,)], schema)
    return df.select(expression.alias("r")).first().r


def test_quote(spark):
    assert one(spark, text.sql_quote(F.col("v")), v="O'Brien") == "'O''Brien'"
    assert one(spark, text.sql_quote(F.col("v")), v="") == "NULL"
    assert one(spark, text.sql_quote(F.col("v")), v=None) == "NULL"


def test_trim_takes_all_whitespace(spark):
    assert one(spark, text.trim_all(F.col("v")), v="\t\n a b 　\r") == "a b"
    assert one(spark, text.blank_to_null(F.col("v")), v=" \t ") is None


def test_yes_no(spark):
    for value, want in [("y", "Y"), ("Y", "Y"), ("true", "N"), ("x", "N"), ("", "N"), (None, "N")]:
        assert one(spark, text.yes_no(F.col("v")), v=value) == want
    assert one(spark, text.yes_no(F.col("v"), "Y"), v=None) == "Y"
    assert [one(spark, text.yes_no(F.lit(v))) for v in (True, False)] == ["Y", "N"]


def test_number(spark):
    for value, want in [("12", 12), (" 7 ", 7), ("x", None), ("", None), ("2.5", 3), (None, None)]:
        assert one(spark, text.number_or_null(F.col("v")), v=value) == want


def test_prefix(spark):
    for value, want in [(" member ", "TB_MEMBER"), ("TB_A", "TB_A"), ("TBX", "TB_TBX"), (None, None)]:
        assert one(spark, text.ensure_prefix(F.col("v"), "TB"), v=value) == want


def test_join_text_keeps_null_parts_empty(spark):
    assert one(spark, text.join_text(F.lit("x: "), F.col("v")), v=None) == "x: "


def test_names(spark):
    def rule(value, required=True):
        found = one(spark, names.check_name("f", F.col("v"), required), v=value)
        return found and found.rule

    assert rule("1A") == "charset"
    assert rule("A-B") == "charset"
    assert rule("A\n") == "charset"
    assert rule("a_1") is None
    assert rule("A" * 128) is None
    assert rule("A" * 129) == "length"
    assert rule("") == "required"
    assert rule(None) == "required"
    assert rule("", required=False) is None


def test_types(spark):
    def render(kind, length=None, precision=None, scale=None, semantics=None):
        given = [F.lit(v).cast("string") for v in (kind, length, precision, scale, semantics)]
        return one(spark, types.render_type(*given))

    assert render("VARCHAR2") == "VARCHAR2(1)"
    assert render("CHAR", "3", semantics="char") == "CHAR(3 CHAR)"
    assert render("NUMBER", None, "10", "2") == "NUMBER(10,2)"
    assert render("NUMBER", None, "10", "0") == "NUMBER(10,0)"
    assert render("NUMBER", None, None, "2") == "NUMBER"
    assert render("NUMBER", None, "10", "") == "NUMBER(10)"
    assert render("RAW", "") == "RAW(1)"
    assert render("date") == "DATE"


def test_index_items(spark):
    found = one(spark, types.parse_index_columns(F.col("v")), v="a, b desc , c x")
    assert [(c.name, c.sort) for c in found] == [("A", "ASC"), ("B", "DESC")]
    assert one(spark, types.parse_index_columns(F.col("v")), v=",x y z") == []


def test_masks(spark):
    def m(rule, value):
        return one(spark, masking.mask(F.col("v"), rule), v=value)

    assert m("NAME", "Kim") == "K**"
    assert m("RRN", "9001011234567") == "900101*******"
    assert m("PHONE", "010-1234-5678") == "010-****-5678"
    assert m("CARD", "1234567812345678") == "************5678"
    assert m("EMAIL", "ab@x.org") == "a****@x.org"
    assert m("ADDR", "Seoul Gangnam 1") == "Seoul ****"
    assert m("FULL", "x") == "********"
    assert m("OTHER", "x") == "********"
    assert m("FULL", None) is None


def test_values_that_do_not_fit_their_mask_are_hidden_whole(spark):
    from tablewarden.functions.masking import mask

    whole = "********"
    for rule, value, want in [
        ("PHONE", "010-1234-5678", "010-****-5678"), ("PHONE", "+82 10 1234 5678", whole), ("EMAIL", "ann@x.org", "a****@x.org"),
        ("EMAIL", "no-at-sign", whole), ("CARD", "1234567890", "******7890"), ("CARD", "1234", whole), ("NAME", "Kim", "K**"),
        ("NAME", "K", whole), ("ADDR", "Seoul Mapo 1", "Seoul ****"), ("ADDR", "Seoul", whole), ("RRN", "900101-1234567", "900101********"),
        ("RRN", "900101", whole), ("FULL", "x", whole), ("NAME", "", whole), ("CARD", None, None), ("ODD", "x", whole),
    ]:
        assert one(spark, mask(F.col("v"), rule), v=value) == want, (rule, value)
