from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import images, text, times
from millrace.operators import columns, filters


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.select(*names).collect()]


@pytest.fixture(scope="module")
def emails(spark):
    values = ["a@b@c", "a@", "@x", "none", None, "  User@GMAIL.com "]
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, email string")


def test_domain_is_the_second_part(emails):
    df = columns.derive_domain(emails, "email", "domain")
    assert [r[0] for r in rows(df, "domain")] == ["b", "", "x", None, None, "GMAIL.com "]


def test_domain_default(emails):
    df = columns.derive_domain(emails, "email", "domain", default="unknown")
    assert [r[0] for r in rows(df, "domain")] == ["b", "", "x", "unknown", "unknown", "GMAIL.com "]


def test_strip_removes_what_python_strips(spark):
    samples = [f"{c}A b{c}{c}" for c in text.STRIP_CHARACTERS] + [" \t\r\n", "", "x"]
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    assert [r[0] for r in rows(columns.clean_strings(df, ["s"]), "s")] == [
        s.strip().lower() for s in samples
    ]
    every = [c for c in map(chr, range(0x3001)) if c.isspace()]
    assert sorted(text.STRIP_CHARACTERS) == sorted(every)


def test_select_adds_missing_as_null_and_orders(emails):
    df = columns.select_columns(emails, ["later", "id"])
    assert df.columns == ["later", "id"]
    assert df.schema["later"].dataType.simpleString() == "string"
    assert rows(df, "later")[0] == (None,)


def test_empty_column_lists_are_errors(emails):
    with pytest.raises(ValueError):
        columns.select_columns(emails, [])
    with pytest.raises(ValueError):
        columns.drop_columns(emails, [])


def test_rename_and_drop_ignore_absent(emails):
    assert columns.rename_columns(emails, {"id": "key", "gone": "x"}).columns == ["key", "email"]
    assert columns.drop_columns(emails, ["email", "gone"]).columns == ["id"]


def test_conditional_first_match_and_null(spark):
    df = spark.createDataFrame([("gmail.com",), ("yahoo.co.uk",), ("x.org",), (None,)], "d string")
    cases = [("d = 'gmail.com'", "Gmail"), ("contains(d, 'yahoo')", "Yahoo"), ("d LIKE 'g%'", "late")]
    df = columns.conditional_column(df, "p", cases, "Corporate")
    assert [r[0] for r in rows(df, "p")] == ["Gmail", "Yahoo", "Corporate", "Corporate"]


def test_buckets_are_closed_ranges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 3.0, 99.0, -1.0, None)], "n double")
    buckets = [(0, 0, "none"), (1, 1, "single"), (2, 3, "moderate"), (4, None, "high")]
    df = columns.bucket_column(df, "b", "n", buckets)
    assert [r[0] for r in rows(df, "b")] == ["none", None, "single", "moderate", "moderate", "high", None, None]


def test_parse_dates_coerce_and_raise(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05",), ("bad",), (None,)], "t string")
    fmt = "%Y-%m-%d %H:%M:%S"
    lenient = columns.parse_dates(df, {"t": {"format": fmt, "errors": "coerce"}, "gone": {"format": fmt}})
    micros = [r[0] for r in lenient.select(F.unix_micros("t")).collect()]
    assert micros == [1704164645000000, None, None]
    with pytest.raises(Exception, match="(?i)pars|malformed|cast"):
        columns.parse_dates(df, {"t": {"format": fmt, "errors": "raise"}}).collect()


def test_date_patterns():
    assert times.spark_pattern("%d/%m/%Y %H:%M:%S.%f") == "dd/MM/yyyy HH:mm:ss.SSSSSS"
    assert times.spark_pattern("%Y-%m-%dT%H:%M") == "yyyy-MM-dd'T'HH:mm"
    assert times.spark_pattern("yyyy-MM-dd") == "yyyy-MM-dd"
    with pytest.raises(ValueError):
        times.spark_pattern("%Q")


def test_cast_keeps_null_and_raises_on_bad(spark):
    df = spark.createDataFrame([("7",), (None,)], "n string")
    assert rows(columns.cast_types(df, {"n": "int"}), "n") == [(7,), (None,)]
    bad = spark.createDataFrame([("x",)], "n string")
    with pytest.raises(Exception, match="(?i)cast"):
        columns.cast_types(bad, {"n": "int"}).collect()
    assert rows(columns.cast_types(bad, {"n": "int"}, errors="coerce"), "n") == [(None,)]


def test_cast_template_rounds_half_up(spark):
    df = spark.createDataFrame([("0.125", "2024-01-02 03:00:00", "x")], "a string, d string, o string")
    got = columns.cast_template(df, {"a": "decimal(10,2)", "d": "datetime", "o": "text"}).first()
    assert (got.a, got.d, got.o) == (0.13, datetime.date(2024, 1, 2), "x")


def test_fill_nulls_casts_the_default_to_the_column(spark):
    df = spark.createDataFrame([(None, None, None)], "n long, s string, f double")
    got = columns.fill_nulls(df, {"n": 0, "s": "N/A", "f": -1, "gone": 1}).first()
    assert tuple(got) == (0, "N/A", -1.0)


def test_lag_and_flag(spark):
    df = spark.sql(
        "SELECT TIMESTAMP'2024-01-01 00:00:00' a, TIMESTAMP'2024-01-02 12:00:00' b, CAST(NULL AS INT) r, 2 n "
        "UNION ALL SELECT NULL, TIMESTAMP'2024-01-01', 0, CAST(NULL AS INT)"
    )
    df = columns.derive_lag_days(df, "lag", "a", "b")
    df = columns.derive_flag(df, "flag", ["r = 1", "n > 1"])
    assert rows(df, "lag", "flag") == [(1.5, True), (None, False)]


def test_exclude_keeps_null_and_keep_values_drops_it(spark):
    df = spark.createDataFrame([("failed",), ("ok",), (None,)], "status string")
    assert rows(filters.exclude_value(df, "status", "failed"), "status") == [("ok",), (None,)]
    assert rows(filters.keep_values(df, "status", ["ok"]), "status") == [("ok",)]
    assert rows(filters.filter_rows(df, "status <> 'failed'"), "status") == [("ok",)]


def test_packed_field_short_string(spark):
    df = spark.createDataFrame([("a:XTS:b",), ("p.q:XTS::XTS:2",), (None,)], "c string")
    got = columns.parse_packed(df, "c", ":XTS:", {"x": 0, "y": 2})
    assert rows(got, "x", "y") == [("a", None), ("p.q", "2"), (None, None)]


def test_image_with_missing_attributes(spark):
    lines = [
        '{"dynamodb":{"NewImage":{"eventName":{"S":"riskScan"},"adobeFonts":{"L":[{"S":"a"}]},'
        '"riskScanFonts":{"L":[{"S":"b"}]},"timestamp":{"S":"2024-01-01T00:00:00Z"}}}}',
        '{"dynamodb":{"NewImage":{"adobeFonts":{"L":[]},"timestamp":{"S":"yesterday"}}}}',
    ]
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    parsed = df.select(F.from_json("value", images.image_schema()).alias("r")).select("r.*")
    filled = [r[0] for r in parsed.select(images.any_list_filled(images.RECORD_PATH)).collect()]
    flat = columns.parse_image(parsed)
    assert filled == [True, False]
    assert rows(flat, "event_type", "fonts") == [("riskScan", ["a", "b"]), (None, [])]
    assert [r[0] is None for r in rows(flat, "timestamp")] == [False, True]
    assert rows(columns.explode_fonts(flat), "font_entry") == [("a",), ("b",)]


def test_uuid_text(spark):
    df = spark.sql("SELECT unhex('00112233445566778899AABBCCDDEEFF') AS id")
    assert df.select(text.uuid_text(F.col("id"))).first()[0] == "00112233-4455-6677-8899-aabbccddeeff"
