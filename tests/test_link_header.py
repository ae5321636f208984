from threadlens.sources.ingest import parse_next_link


def parse(spark, value, first_only=False):
    df = spark.createDataFrame([(value,)], "link string")
    return df.select(parse_next_link("link", first_only).alias("u")).first()["u"]


def test_next_present(spark):
    h = '<https://api.example.test/r/issues?page=2>; rel="next", <https://api.example.test/r/issues?page=9>; rel="last"'
    assert parse(spark, h) == "https://api.example.test/r/issues?page=2"


def test_no_next(spark):
    h = '<https://api.example.test/r/issues?page=1>; rel="first", <https://api.example.test/r/issues?page=9>; rel="last"'
    assert parse(spark, h) is None
    assert parse(spark, '<https://api.example.test/r/issues?page=1>; rel="first"') is None


def test_null_and_empty(spark):
    assert parse(spark, None) is None
    assert parse(spark, "") is None


def test_rel_not_first_parameter(spark):
    h = '<https://api.example.test/r/issues?page=3>; type="x"; rel="next"'
    assert parse(spark, h) == "https://api.example.test/r/issues?page=3"
    assert parse(spark, h, first_only=True) is None
