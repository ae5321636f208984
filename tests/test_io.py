from threadlens.sources import io as IO
from threadlens.sources import schemas as SC


def test_csv_quotes_newlines_bom_headers(spark, tmp_dir):
    path = f"{tmp_dir}/labels.csv"
    with open(path, "w", encoding="utf-8-sig", newline="") as fh:
        fh.write(' annotation_id ,primary_label,evidence_quote\r\n')
        fh.write('NS-0001,workaround,"He said ""it works"", then\nleft"\r\n')
        fh.write('NS-0002,,\r\n')
    df = IO.read_csv(spark, path)
    assert df.columns == ["annotation_id", "primary_label", "evidence_quote"]
    rows = {r["annotation_id"]: r for r in df.collect()}
    assert rows["NS-0001"]["evidence_quote"] == 'He said "it works", then\nleft'
    assert rows["NS-0002"]["primary_label"] == ""
    nulls = IO.read_csv(spark, path, keep_blanks=False)
    assert {r["annotation_id"]: r for r in nulls.collect()}["NS-0002"]["primary_label"] is None
    out = f"{tmp_dir}/out"
    IO.write_csv(df, out)
    back = IO.read_csv(spark, out)
    assert sorted(r["evidence_quote"] for r in back.collect()) == sorted(r["evidence_quote"] for r in df.collect())


def test_schema_contracts(spark):
    import pytest

    df = spark.createDataFrame([("a", "workaround", 0.5)], "annotation_id string, actual_label string, workaround_probability double")
    with pytest.raises(ValueError, match="missing columns"):
        SC.require_columns(df, ["annotation_id", "thread_text"])
    aliased = SC.apply_aliases(df)
    assert aliased.columns == ["annotation_id", "actual", "probability"]
    assert SC.existing(aliased, ["probability", "nope", "annotation_id"]).columns == ["probability", "annotation_id"]
    assert SC.add_missing(aliased, {"predicted": ""}).columns[-1] == "predicted"


def test_balance_partitions(spark):
    df = spark.range(10).coalesce(1)
    assert IO.balance_partitions(df, 4).rdd.getNumPartitions() == 4
    many = spark.range(100).repartition(8)
    assert IO.balance_partitions(many, 4).rdd.getNumPartitions() == 8


def test_missing_value_tokens(spark, tmp_dir):
    path = f"{tmp_dir}/na.csv"
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("a,b\nNA,x\nnan,NaN \n#N/A,None\nnone,-\n")
    rows = [tuple(r) for r in IO.read_csv(spark, path, keep_blanks=False).collect()]
    assert rows == [(None, "x"), (None, "NaN "), (None, None), ("none", "-")]
    assert IO.read_csv(spark, path).first()["a"] == "NA"


def test_array_and_nested_sinks(spark, tmp_dir):
    import json

    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, ["a", "b"], [("u", 2)])], "id int, tags array<string>, comments array<struct<author:string,n:int>>")
    IO.write_csv(df, f"{tmp_dir}/csv")
    row = IO.read_csv(spark, f"{tmp_dir}/csv").first()
    assert json.loads(row["tags"]) == ["a", "b"] and json.loads(row["comments"]) == [{"author": "u", "n": 2}]
    IO.write_json(df, f"{tmp_dir}/json")
    back = spark.read.json(f"{tmp_dir}/json")
    assert back.select(F.col("comments")[0]["author"]).first()[0] == "u" and back.first()["tags"] == ["a", "b"]
