import pytest
from pyspark.sql import functions as F

from quillframe.functions import jsonrow
from quillframe.functions import scalars as s
from quillframe.operators import infer, predicates
from quillframe.operators.table import KEEP_FIRST, THROW, Table

CLASSES = [
    ("", 0), ("  ", 0), ("not-a-number", 1), ("510-123-4567", 1), ("127", 3), ("128", 5), ("-128", 3), ("-129", 5), ("32768", 7), ("2147483647", 7), ("2147483648", 9), ("-2147483648", 7), ("9223372036854775807", 9), ("9223372036854775808", 11),
    ("92233720368547758070", 11), ("0x10", 3), ("0xFFFFFFFFFFFFFFFF", 11), ("3.14", 12), ("1E-06", 12), ("-1.5E3", 12), ("+1.5e+003", 12), ("1E -06", 1), ("1.5e", 1), ("+3.14", 12), ("       -3.14            ", 12), ("true", 2), ("FALSE", 2), ("truthy", 1),
    ("2024-01-31T23:59:58Z", 14), ("1970-01-02T00:00:00.123Z", 14), ("2024-01-02", 14), ("2024-01-01 12:00:00", 14), ("2024-13-01", 1), ("NaN", 1), ("inf", 1), (".5", 12), ("5.", 12), ("1d", 1), ("t", 1), (None, 0),
]


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"x {kind}")


def test_classes(spark):
    got = column(spark, [v for v, _ in CLASSES]).select(s.classify(F.col("x"))).collect()
    assert [r[0] for r in got] == [k for _, k in CLASSES]


def test_conversions_and_error_order(spark):
    def one(text, kind):
        return tuple(column(spark, [text]).select(s.convert(F.col("x"), kind).alias("c")).first()[0])

    assert one("2147483648", "int32") == (None, s.OVERFLOW)
    assert one("1.5", "uint8") == (None, s.FLOAT_TO_INT)
    assert one("-1", "uint32") == (None, s.NEGATIVE)
    assert one("99999999999999999999", "int64") == (None, s.OVERFLOW)
    assert one("x", "double") == (None, s.NOT_A_NUMBER)
    assert one("300", "uint8") == (None, s.OVERFLOW)
    assert one(" true ", "bool") == (True, None)
    assert one("1", "bool") == (None, s.NOT_A_BOOL)
    assert one("0x10", "int8") == (16, None)
    assert one("x", "string") == ("x", None)
    with pytest.raises(Exception, match="Not a number"):
        column(spark, ["x"]).select(s.get(F.col("x"), "int32")).collect()


def test_hex_decimal_time_numbers(spark):
    got = column(spark, ["D3ADB33F", " 0x1f ", "xyz", "", "-0x10"]).select(s.parse_hex(F.col("x"))).collect()
    assert [r[0] for r in got] == [3551376191, 31, None, None, -16]
    assert column(spark, ["ff"]).select(s.parse_hex(F.col("x"), "int8")).first()[0] is None
    assert [r[0] for r in column(spark, ["3,14", "5", "1.5", "a"]).select(s.parse_decimal(F.col("x"))).collect()] == [3.14, 5.0, None, None]
    assert [r[0] for r in column(spark, ["1970-01-02T00:00:00.123Z", "42", "-1", "x"]).select(s.timestamp_millis(F.col("x"))).collect()] == [86400123, 42, None, None]
    texts = [r[0] for r in column(spark, [1.234, 10.0, -0.25, 1.96], "double").select(s.number_text(F.col("x"))).collect()]
    assert texts == ["1.23400", "10.0", "-0.25000", "1.96000"]
    assert column(spark, [1.96], "double").select(s.number_text(F.col("x"), 1)).first()[0] == "2.0"


def test_json(spark):
    df = spark.createDataFrame([("1234.3", "234", "ABCD", "AB1", "1337")], "A string, B string, C string, D string, E string")
    cols = [F.col(c) for c in "ABCDE"]
    assert df.select(jsonrow.row_json(list("ABCDE"), cols)).first()[0] == '{"A":1234.3,"B":234,"C":"ABCD","D":"AB1","E":1337}'
    assert df.select(jsonrow.row_json_array(cols)).first()[0] == '[1234.3,234,"ABCD","AB1",1337]'
    assert df.select(jsonrow.row_json(["C", "A"], [F.col("C"), F.col("A")])).first()[0] == '{"C":"ABCD","A":1234.3}'
    bad = column(spark, ['a"b\\c\n\x01', "true", "", "0x10"])
    assert [r[0] for r in bad.select(jsonrow.json_value(F.col("x"))).collect()] == ['"a\\"b\\\\c\\n\\u0001"', '"true"', '""', "0x10"]
    assert [r[0] for r in bad.select(jsonrow.json_value(F.col("x"), strict=True)).collect()][3] == '"0x10"'


def test_predicate_literals():
    with pytest.raises(TypeError):
        predicates.equal("a", True)
    with pytest.raises(TypeError):
        predicates.equal("a", None)
    with pytest.raises(RuntimeError):
        predicates.less("a", "x")
    with pytest.raises(TypeError):
        predicates.all_of()
    assert predicates.equal("a", 7.0).literal == "7.0"
    assert len(predicates.all_of(predicates.all_of(predicates.equal("a", 1), predicates.equal("b", 1)), predicates.less("c", 2)).parts) == 3


def test_ascii_fold_alone(spark):
    df = column(spark, ["À", "à", "ABC"])
    assert [r[0] for r in df.select(s.ascii_lower(F.col("x"))).collect()] == ["À", "à", "abc"]


PEOPLE = [(0, "1", "Alice", "10"), (1, "2", "Bob", "20"), (2, "1", "Carol", "30")]


@pytest.fixture
def people(spark):
    return Table.of(spark.createDataFrame(PEOPLE, "_pos long, id string, name string, value string"))


def test_keys(people):
    last = people.keyed("id", "int64")
    assert sorted((r["_key"], r["name"], r["_pos"]) for r in last.df.collect()) == [(1, "Carol", 0), (2, "Bob", 1)]
    first = people.keyed("id", "int64", KEEP_FIRST)
    assert first.lookup(1).collect()[0]["name"] == "Alice"
    assert first.contains(2) and not first.contains(9)
    with pytest.raises(Exception, match="Duplicate key"):
        people.keyed("id", policy=THROW).df.collect()
    with pytest.raises(RuntimeError):
        people.lookup(1)


def test_missing_keys(spark):
    t = Table.of(spark.createDataFrame([(0, "", "Blank"), (1, "1", "Alice")], "_pos long, id string, name string"))
    with pytest.raises(Exception, match="row key"):
        t.keyed("id", "int64").df.collect()
    assert sorted(r["_key"] for r in t.keyed("id", "int64", throw_on_missing=False).df.collect()) == [0, 1]


def test_edits(people):
    t = people.edit({(0, "name"): "X"}).insert_row(1, ("9", "New", "0")).append_column("tag", "t").erase_column("value").erase_row(0)
    assert sorted(tuple(r) for r in t.rows().collect()) == [(0, "9", "New", ""), (1, "2", "Bob", "t"), (2, "1", "Carol", "t")] or sorted(tuple(r) for r in t.rows().collect()) == [(0, "9", "New", "t"), (1, "2", "Bob", "t"), (2, "1", "Carol", "t")]
    assert {r["group"]: r["positions"] for r in people.edit({(1, "id"): "1"}).group_by("id").collect()} == {"1": [0, 1, 2]}
    picked = people.edit({(0, "name"): "X"}).selected_rows(F.col("id") == "1")
    assert [tuple(r) for r in picked.rows().orderBy("_pos").collect()] == [(0, "1", "X", "10"), (1, "1", "Carol", "30")]  # edits are kept
    many = people.overlay(people.df.select("_pos", F.lit("name").alias("_name"), F.lit("Z").alias("_value")))
    assert {r["name"] for r in many.rows().collect()} == {"Z"}
    for bad in (lambda: people.insert_column(0, ""), lambda: people.insert_column(0, "id"), lambda: people.insert_row(0, ("1",)), lambda: people.keyed("id").erase_column("id")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        people.group_by("nope")
    with pytest.raises(IndexError):
        people.at(-1)


def test_inference(spark):
    df = spark.createDataFrame([("1", "", "true", "x"), ("2.5", "", "", "1"), ("3", "", "false", "")], "a string, b string, c string, d string")
    assert {r["column"]: r["type"] for r in infer.data_types(df).collect()} == {"a": "double", "b": "null", "c": "bool", "d": "string"}
    assert {r["column"]: r["type"] for r in infer.data_types(df, compat=True).collect()} == {"a": "int8", "b": "null", "c": "bool", "d": "string"}
    assert infer.dtypes(df) == {"a": "float64", "b": "float64", "c": "float64", "d": "string"}
    text = infer.ddl(df, "t")
    assert text.startswith('CREATE TABLE "t"') and '"a" DOUBLE PRECISION NOT NULL' in text and '"d" TEXT' in text
    fixed = infer.cast_to(df.select("d"), {"d": "int64"}).collect()
    assert [r[0] for r in fixed] == [0, 1, 0]
    assert infer.count_coerced(df.select("d"), {"d": "int64"}).first()[0] == 2
    assert infer.dtypes(df.limit(0)) == {c: "float64" for c in "abcd"}


def test_rows_as_values(spark):
    import datetime

    from quillframe.functions import rows

    df = spark.createDataFrame([("1", "x", "2")], "a string, b string, c string")
    cols = [F.col(c) for c in "abc"]
    assert df.select(rows.row_map("abc", cols, ["c", "a"])).first()[0] == {"c": "2", "a": "1"}
    assert df.select(rows.row_slice(cols, -2)).first()[0] == ["x", "2"]
    assert df.select(rows.row_array(cols)).first()[0] == ["1", "x", "2"]
    with pytest.raises(KeyError):
        rows.row_map("abc", cols, ["z"])
    values = {"": None, " ": None, "true": True, "12": 12, "0x10": 16, "1.5": 1.5, "x": "x", "99999999999999999999": "99999999999999999999", "2024-01-02": datetime.datetime(2024, 1, 2), "2024-01-02T03:04:05Z": datetime.datetime(2024, 1, 2, 3, 4, 5), "2024-13-01": "2024-13-01"}
    assert {k: rows.python_value(k) for k in values} == values
    assert column(spark, ["1970-01-02T00:00:00.999Z"]).select(s.timestamp_seconds(F.col("x"))).first()[0] == 86400
