from pyspark.sql import functions as F

from threadlens.functions import text as T


def one(spark, expr, value, schema="v string"):
    return spark.createDataFrame([(value,)], schema).select(expr.alias("o")).first()["o"]


def test_strip_matches_python_whitespace(spark):
    raw = " \t  a b\n\x0b "
    assert one(spark, T.strip_ws("v"), raw) == raw.strip() == "a b"
    assert one(spark, T.strip_ws("v"), None) == ""
    assert one(spark, T.strip_ws("v"), "   ") == ""


def test_normalize_text(spark):
    raw = "  Line one\r\nline\t\t two   x\n\n\n\n\nend\n "
    assert one(spark, T.normalize_text("v"), raw) == "Line one\nline two x\n\nend"
    assert one(spark, T.normalize_text("v"), None) == ""


def test_binary_label_synonyms(spark):
    df = spark.createDataFrame([(v,) for v in ["Yes", " TRUE", "1", "positive", "no workaround", "0", "Negative", "maybe", None]], "v string")
    got = [r[0] for r in df.select(T.normalize_binary_label("v")).collect()]
    assert got == ["workaround"] * 4 + ["no_workaround"] * 3 + ["maybe", ""]


def test_primary_label_target(spark):
    df = spark.createDataFrame([(" Workaround ",), ("bug_report",), (None,)], "v string")
    assert [r[0] for r in df.select(T.primary_label_target("v")).collect()] == [1, 0, 0]


def test_try_number(spark):
    df = spark.createDataFrame([("3",), (" 4.5 ",), ("abc",), ("NaN",), (None,), ("",)], "v string")
    assert [r[0] for r in df.select(T.try_number("v")).collect()] == [3.0, 4.5, None, None, None, None]


def test_text_length_code_points(spark):
    assert one(spark, T.text_length("v"), "héllo😀") == 6


def test_strip_accents(spark):
    assert one(spark, T.strip_accents(F.lower("v")), "Crème Brûlée Ñandú") == "creme brulee nandu"


def test_accents_fold_like_the_unicode_database(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from threadlens.functions.text import strip_accents

    chars = [chr(c) for c in range(0x20, 0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    fold = lambda s: "".join(x for x in unicodedata.normalize("NFKD", s) if not unicodedata.combining(x))
    single = [c for c in chars if len(fold(c)) == 1]
    got = spark.createDataFrame([(c,) for c in single], "c string").select("c", strip_accents(F.col("c")).alias("f")).collect()
    wrong = [(r["c"], r["f"]) for r in got if r["f"] != fold(r["c"]) and unicodedata.category(r["c"]) != "Mn"]
    assert wrong == []
    assert [r["f"] for r in got if r["c"] in "ёй"] == ["е", "и"] or {"е", "и"} <= {r["f"] for r in got}
