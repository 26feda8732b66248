import pytest
from pyspark.sql import functions as F

from spendspark import rules as R
from spendspark.functions import text as X
from spendspark.operators import parse
from spendspark.sources import rule_tables


def test_rules_as_a_table(spark):
    assert rule_tables.read(rule_tables.table(spark).repartition(3)) == R.DEFAULT
    none = rule_tables.read(rule_tables.table(spark).limit(0))
    rows = spark.createDataFrame([(1, "VM-HDFCBK", "Rs 5 debited from A/c XX1111 to SHOP", 0), (2, "NEWBNK", "Rs 5 swept from A/c XX1111 to SHOP. 123456 is your OTP", 0)], "id int, sender string, body string, received_at long")
    assert {r.id: r.reject_reason for r in parse.parsed(rows, "UTC", rules=none).collect()} == {1: "no direction keyword", 2: "no direction keyword"}
    more = spark.createDataFrame([("bank_codes", 0, None, "NewBnk"), ("debit_words", 0, None, "swept"), ("merchant_patterns", 0, None, r"to ([A-Z]+)")], "kind string, place int, name string, value string")
    own = rule_tables.read(more)
    got = {r.id: (r.reject_reason, r.direction, r.merchant_norm) for r in parse.parsed(rows, "UTC", rules=own).collect()}
    assert got == {1: ("no direction keyword", None, None), 2: (None, "DEBIT", "shop")}
    assert rows.select(X.sender_class(F.col("sender"), own).alias("k")).collect()[1].k == "BANK"
    with pytest.raises(ValueError):
        rule_tables.read(more.withColumn("kind", F.lit("other")))
