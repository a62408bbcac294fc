"""Named queries over the test tables, each with the SQL that it is compared with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import jsonrow
from quillframe.functions import scalars as s
from quillframe.operators import infer, predicates, stats
from quillframe.operators.table import KEEP_FIRST, Table, positioned
from quillframe.plans.reader import Reader
from quillframe.sources import delimited, sink
from quillframe.sources import dialect as d
from quillframe.sources.paths import scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table's columns as a reader of delimited text gives them: all strings, nulls empty."""
    df = _table(spark, sf_dir, name)
    return sink.as_text(df.select(*(columns or df.columns)))


def _rows(df: DataFrame) -> delimited.Rows:
    """Text columns as rows of a reader, without a file."""
    names = tuple(df.columns)
    return delimited.Rows(df.select(*[F.col(c).alias(f"_c{k}") for k, c in enumerate(names)]), names)


def _written(df: DataFrame, name: str, **options) -> str:
    path = scratch(df.sparkSession, name)
    sink.write(df, path, **options)
    return path


def _lines(df: DataFrame, name: str) -> str:
    """A frame of ready lines as text files."""
    path = scratch(df.sparkSession, name)
    df.write.text(path)
    return path


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as CSV, read back, typed, filtered, grouped."""
    path = _written(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag"), "lineitem")
    rows = Reader(delimited.scan(spark, path, d.Dialect(), multiline=False)).filter(predicates.less("l_quantity", 24)).frame()
    quantity = s.number(F.col("l_quantity")).cast("decimal(18,2)")
    return rows.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum(quantity).cast("decimal(28,2)").alias("quantity"))


@query("SELECT l_returnflag, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity FROM lineitem WHERE l_quantity < 24 GROUP BY 1")
def scan_filter_group(spark, sf_dir):
    return flagship(spark, sf_dir)


# --- sources and sinks ----------------------------------------------------------------------------------------------------------


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber, l_returnflag, l_linestatus FROM lineitem")
def scan_roundtrip_lineitem(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"), "lineitem")
    return delimited.scan(spark, path, multiline=False).named()


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(text, '') AS text, lang FROM documents")
def scan_roundtrip_documents(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), "documents")
    return delimited.scan(spark, path, d.Dialect()).named()


@query("SELECT CAST(page_id AS VARCHAR) AS page_id, html FROM pages")
def scan_roundtrip_pages_exact(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "pages").select("page_id", "html"), "pages")
    return delimited.scan(spark, path, d.Dialect(), exact=True).named()


@query("SELECT CAST(event_id AS VARCHAR) AS event_id, props FROM events")
def scan_roundtrip_events_json(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "events").select("event_id", "props"), "events")
    return delimited.scan(spark, path, d.Dialect(), multiline=False).named()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def scan_tsv_roundtrip_nation(spark, sf_dir):
    path = scratch(spark, "nation")
    sink.write_tsv(_table(spark, sf_dir, "nation"), path)
    return delimited.scan(spark, path, d.Dialect(delimiters=("\t",))).named()


@query("SELECT s_name, CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier")
def write_quote_all(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "supplier", minimal=False, single_file=True)
    return delimited.scan(spark, path, d.Dialect()).named("s_name", "s_suppkey")


@query("SELECT CASE WHEN contains(text, ',') OR contains(text, '\"') OR contains(text, chr(10)) OR contains(text, chr(13)) THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END || ',' || CAST(doc_id AS VARCHAR) AS value FROM documents WHERE text IS NOT NULL")
def write_minimal_quoting(spark, sf_dir):
    return sink.lines(_table(spark, sf_dir, "documents").filter("text is not null").select("text", "doc_id"))


@query("SELECT ';' AS delimiter, CAST(0 AS INTEGER) AS header_row, CAST(3 AS INTEGER) AS n_cols")
def guess_delimiter(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "nation"), "nation", delimiter=";", single_file=True)
    r = delimited.sniff(spark, path, d.guessed())[1]
    return spark.createDataFrame([(r.delimiter, r.header, r.width)], "delimiter string, header_row int, n_cols int")


@query("SELECT ',' AS delimiter, count(*) AS n_rows, CAST(3 AS BIGINT) AS n_cols FROM nation")
def file_info(spark, sf_dir):
    return delimited.file_info(spark, _written(_table(spark, sf_dir, "nation"), "nation", single_file=True)).drop("file")


@query("SELECT CAST(r_regionkey AS VARCHAR) AS r_regionkey, r_name FROM region")
def header_skip_rows(spark, sf_dir):
    rows = _table(spark, sf_dir, "region").orderBy("r_regionkey").coalesce(1)
    junk = spark.createDataFrame([("# made by hand",), ("# two lines",), ("r_regionkey,r_name",)], "value string").coalesce(1)
    path = _lines(junk.unionByName(sink.lines(rows)).coalesce(1), "region")
    return delimited.scan(spark, path, d.Dialect().header_row(2)).named()


@query("SELECT CAST(r_regionkey AS VARCHAR) AS id, r_name AS label FROM region")
def explicit_names(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "region"), "region", header=False)
    return delimited.scan(spark, path, d.Dialect().column_names(("id", "label"))).named()


def _ragged(spark, sf_dir, policy: str) -> delimited.Rows:
    """orders with a field too few on every fifth key, one too many on every seventh, and a blank line before every eleventh."""
    k, value = F.col("o_orderkey"), F.concat_ws(",", F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_custkey").cast("string"))
    line = F.when(k % 5 == 0, F.concat_ws(",", k.cast("string"), "o_orderstatus")).when(k % 7 == 0, F.concat(value, F.lit(",more"))).otherwise(value)
    orders = _table(spark, sf_dir, "orders")
    path = _lines(orders.select(F.concat(F.when(k % 11 == 0, "\n").otherwise(""), line).alias("value")), "ragged")
    return delimited.scan(spark, path, d.Dialect().column_names(("key", "status", "customer")).ragged_rows(policy))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS key, o_orderstatus AS status, CAST(o_custkey AS VARCHAR) AS customer FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0")
def ragged_ignore_row(spark, sf_dir):
    return _ragged(spark, sf_dir, d.IGNORE_ROW).named()


_WIDTHS = "SELECT CASE WHEN o_orderkey % 5 = 0 THEN 2 WHEN o_orderkey % 7 = 0 THEN 4 ELSE 3 END AS width FROM orders"


@query(f"SELECT width, count(*) AS n FROM ({_WIDTHS} UNION ALL SELECT 0 FROM orders WHERE o_orderkey % 11 = 0) GROUP BY 1")
def ragged_keep_width(spark, sf_dir):
    return _ragged(spark, sf_dir, d.KEEP).df.groupBy(F.size("fields").alias("width")).agg(F.count("*").alias("n"))


@query(f"SELECT width, count(*) AS n FROM ({_WIDTHS}) GROUP BY 1")
def ragged_keep_non_empty(spark, sf_dir):
    return _ragged(spark, sf_dir, d.KEEP_NON_EMPTY).df.groupBy(F.size("fields").alias("width")).agg(F.count("*").alias("n"))


@query("SELECT CAST(o_orderkey AS VARCHAR) || ',' || o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE ',' || CAST(o_custkey AS VARCHAR) END || CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 THEN ',more' ELSE '' END AS value FROM orders")
def ragged_roundtrip(spark, sf_dir):
    path = _lines(sink.record_lines(_ragged(spark, sf_dir, d.KEEP_NON_EMPTY).df), "ragged")
    return spark.read.text(path)


@query("SELECT count(*) AS n, CAST(sum(length(CAST(r_regionkey AS VARCHAR)) + 1 + length(r_name)) AS BIGINT) AS raw_bytes, CAST(sum(CASE WHEN r_regionkey = 0 THEN 0 ELSE 1 END) AS BIGINT) AS later FROM region")
def record_offsets(spark, sf_dir):
    path = _written(_table(spark, sf_dir, "region").orderBy("r_regionkey"), "region", header=False, single_file=True)
    df = delimited.scan(spark, path, d.Dialect().no_header()).df
    return df.agg(F.count("*").alias("n"), F.sum(F.octet_length("raw")).cast("bigint").alias("raw_bytes"), F.count_if(F.col("offset") > 0).alias("later"))


@query("SELECT trim(p_name) AS p_name, CAST(p_size AS VARCHAR) AS p_size FROM part")
def trim_fields(spark, sf_dir):
    padded = _table(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit(" ")).alias(" p_name "), F.concat(F.lit(" "), F.col("p_size").cast("string")).alias("p_size "))
    path = _written(padded, "part")
    return delimited.scan(spark, path, d.Dialect().trimmed(" ")).named()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_regionkey = 1")
def parse_in_memory(spark, sf_dir):
    text = _table(spark, sf_dir, "nation").agg(F.concat(F.lit("n_nationkey,n_name,n_regionkey\n"), F.listagg(F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), F.lit("\r\n"))).alias("text"))
    r = d.resolve(d.Dialect(), b"n_nationkey,n_name,n_regionkey\n")
    return Reader(delimited.shaped(delimited.parse_texts(text, r), r)).filter(predicates.equal("n_regionkey", 1)).frame(["n_nationkey", "n_name"])


# --- projection and predicates --------------------------------------------------------------------------------------------------


@query("SELECT CAST(o_custkey AS VARCHAR) AS o_custkey, CAST(o_orderkey AS VARCHAR) AS o_orderkey FROM orders")
def project_reorder_orders(spark, sf_dir):
    return Reader(_rows(_text(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus"))).frame(["o_custkey", "o_orderkey"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_equal_ci(spark, sf_dir):
    return Reader(_rows(_text(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))).filter(predicates.equal("c_mktsegment", "bUiLdInG", case_sensitive=False)).frame(["c_custkey"])


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def filter_equal(spark, sf_dir):
    return Reader(_rows(_text(spark, sf_dir, "customer", "c_custkey", "c_mktsegment"))).filter(predicates.equal("c_mktsegment", "BUILDING")).frame(["c_custkey"])


def _compared(name: str, op: str):
    def run(spark, sf_dir):
        rows = _rows(_text(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"))
        return Reader(rows).filter(getattr(predicates, name)("l_quantity", 24)).frame(["l_orderkey", "l_linenumber"])

    run.__name__ = f"filter_{name}"
    query(f"SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem WHERE l_quantity {op} 24")(run)


for _name, _op in (("less", "<"), ("less_equal", "<="), ("greater", ">"), ("greater_equal", ">=")):
    _compared(_name, _op)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 AND l_discount >= 0.05")
def filter_all_of(spark, sf_dir):
    rows = Reader(_rows(_text(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_quantity", "l_discount")))
    chosen = predicates.all_of(predicates.equal("l_returnflag", "R"), predicates.all_of(predicates.less("l_quantity", 10)))
    return rows.filter(predicates.less("l_quantity", 1)).filter(chosen, append=False).filter(predicates.greater_equal("l_discount", "0.05")).frame(["l_orderkey"])


@query("SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE TRY_CAST(props AS DOUBLE) < 1000")
def filter_non_numeric_false(spark, sf_dir):
    return Reader(_rows(_text(spark, sf_dir, "events", "event_id", "props"))).filter(predicates.less("props", 1000)).frame(["event_id"])


@query("SELECT s_suppkey, s_name FROM supplier WHERE abs(s_acctbal - round(s_acctbal)) < 0.000001 OR s_name = 'x'")
def field_equality(spark, sf_dir):
    df = _table(spark, sf_dir, "supplier")
    whole = s.fields_equal((F.col("s_acctbal") - F.round("s_acctbal")).cast("decimal(18,8)").cast("string"), 0)
    return df.filter(whole | s.fields_equal(F.col("s_name"), "x")).select("s_suppkey", "s_name")


# --- scalars and inference ------------------------------------------------------------------------------------------------------

_INT_CLASS = "CASE WHEN {0} BETWEEN -128 AND 127 THEN 3 WHEN {0} BETWEEN -32768 AND 32767 THEN 5 WHEN {0} BETWEEN -2147483648 AND 2147483647 THEN 7 ELSE 9 END"


@query(
    f"""SELECT "column", type_id, count(*) AS n FROM (
    SELECT 'l_orderkey' AS "column", {_INT_CLASS.format("l_orderkey")} AS type_id FROM lineitem UNION ALL
    SELECT 'l_linenumber', 3 FROM lineitem UNION ALL SELECT 'l_quantity', 12 FROM lineitem UNION ALL SELECT 'l_returnflag', 1 FROM lineitem UNION ALL
    SELECT 'l_shipdate', 14 FROM lineitem) GROUP BY ALL"""
)
def classify_type_counts(spark, sf_dir):
    return infer.type_counts(_text(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")).drop("position")


def _mixed(spark, sf_dir) -> DataFrame:
    """orders as text: ints and doubles in one column, doubles with blanks, and plain ones."""
    k = F.col("o_orderkey")
    return _table(spark, sf_dir, "orders").select(
        F.when(k % 2 == 0, F.lit("7")).otherwise("1.5").alias("mixed"), F.when(k % 3 == 0, "").otherwise("2.5").alias("gaps"), F.lit("true").alias("flag"),
        F.when(k % 5 == 0, "300").otherwise("12").alias("small"), F.col("o_orderstatus").alias("status"),
    )


@query("SELECT * FROM (VALUES ('mixed', 12, 'double'), ('gaps', 12, 'double'), ('flag', 2, 'bool'), ('small', 5, 'int16'), ('status', 1, 'string')) v(\"column\", type_id, type)")
def csv_data_types_sound(spark, sf_dir):
    return infer.data_types(_mixed(spark, sf_dir))


@query("SELECT * FROM (VALUES ('mixed', 3, 'int8'), ('gaps', 0, 'null'), ('flag', 2, 'bool'), ('small', 5, 'int16'), ('status', 1, 'string')) v(\"column\", type_id, type)")
def csv_data_types_compat(spark, sf_dir):
    return infer.data_types(_mixed(spark, sf_dir), compat=True)


@query("SELECT 'value' AS \"column\", CAST(count(*) AS BIGINT) AS \"rows\", CAST(count(*) - count(value) AS BIGINT) AS nulls, count(*) > count(value) AS nullable, 12 AS type_id, 'DOUBLE PRECISION' AS sql_type FROM events UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), count(*) > count(event_type), 1, 'TEXT' FROM events")
def schema_ddl_nullability(spark, sf_dir):
    return infer.schema_info(_text(spark, sf_dir, "events", "value", "event_type")).drop("position", "top1", "top2")


@query("SELECT * FROM (VALUES ('mixed', 'float64'), ('gaps', 'float64'), ('flag', 'bool'), ('small', 'int64'), ('status', 'string')) v(\"column\", dtype)")
def dtype_lattice_global(spark, sf_dir):
    return spark.createDataFrame(list(infer.dtypes(_mixed(spark, sf_dir)).items()), "column string, dtype string")


@query("SELECT count(*) AS n, CAST(sum(CASE WHEN o_orderkey % 2 = 0 THEN 7 ELSE 1.5 END) AS DOUBLE) AS mixed, count(*) FILTER (o_orderkey % 3 <> 0) AS gaps, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 300 ELSE 12 END) AS BIGINT) AS small FROM orders")
def typed_columns(spark, sf_dir):
    df = Reader(_rows(_mixed(spark, sf_dir))).columns()
    return df.agg(F.count("*").alias("n"), F.sum("mixed").alias("mixed"), F.count("gaps").alias("gaps"), F.sum("small").alias("small"))


@query("SELECT count(*) FILTER (o_orderkey % 2 <> 0) AS mixed, count(*) AS status FROM orders")
def fixed_schema_coercions(spark, sf_dir):
    return infer.count_coerced(_mixed(spark, sf_dir).select("mixed", "status"), {"mixed": "int64", "status": "bool"})


@query(
    """SELECT * FROM (VALUES ('12', CAST(12 AS TINYINT), NULL), ('300', NULL, 'Overflow error.'), ('1.5', NULL, 'Attempted to convert a floating point value to an integral type.'), ('x', NULL, 'Not a number.'),
    ('', NULL, 'Not a number.'), ('99999999999999999999', NULL, 'Overflow error.'), ('0x10', CAST(16 AS TINYINT), NULL), (' -7 ', CAST(-7 AS TINYINT), NULL)) v(field, value, error)"""
)
def try_get_int_errors(spark, sf_dir):
    rows = spark.createDataFrame([(x,) for x in ("12", "300", "1.5", "x", "", "99999999999999999999", "0x10", " -7 ")], "field string")
    c = s.convert(F.col("field"), "int8")
    return rows.select("field", c["value"].alias("value"), c["error"].alias("error"))


@query("SELECT count(*) FILTER (s_acctbal < 0) AS negative, count(*) FILTER (s_acctbal >= 0) AS fine FROM supplier")
def try_get_unsigned(spark, sf_dir):
    c = s.convert(F.floor("s_acctbal").cast("string"), "uint32")
    return _table(spark, sf_dir, "supplier").agg(F.count_if(c["error"] == s.NEGATIVE).alias("negative"), F.count_if(c["error"].isNull()).alias("fine"))


@query("SELECT p_partkey, CAST(p_partkey AS BIGINT) AS value FROM part")
def parse_hex(spark, sf_dir):
    text = F.concat(F.when(F.col("p_partkey") % 2 == 0, " 0x").otherwise(""), F.hex("p_partkey"), F.lit(" "))
    return _table(spark, sf_dir, "part").select("p_partkey", s.parse_hex(text).alias("value"))


@query("SELECT p_partkey, p_retailprice AS value FROM part")
def parse_decimal_comma(spark, sf_dir):
    text = F.translate(F.col("p_retailprice").cast("string"), ".", ",")
    return _table(spark, sf_dir, "part").select("p_partkey", s.parse_decimal(text).alias("value"))


@query("SELECT l_orderkey, l_linenumber, epoch_ms(l_shipdate) AS ms FROM lineitem")
def timestamp_to_millis(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.timestamp_millis(F.col("l_shipdate").cast("string")).alias("ms"))


@query("SELECT p_partkey, CASE WHEN p_retailprice = floor(p_retailprice) THEN printf('%.1f', p_retailprice) ELSE printf('%.5f', p_retailprice) END AS text FROM part")
def write_number_format(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", s.number_text(F.col("p_retailprice")).alias("text"))


@query("SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_custkey % 5 = 0) AS blanks FROM (SELECT *, CASE c_custkey % 5 WHEN 0 THEN 'N/A' ELSE c_name END AS x FROM customer) GROUP BY 1")
def null_coercion_etl(spark, sf_dir):
    k = F.col("c_custkey") % 20
    word = F.when(k == 0, "N/A").when(k == 5, " null ").when(k == 10, "None").when(k == 15, "").otherwise(F.col("c_name"))
    df = _table(spark, sf_dir, "customer").select("c_mktsegment", s.null_words_to_empty(word).alias("x"))
    return df.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("x") == "").alias("blanks"))


# --- aggregates -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderstatus AS \"group\", count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def group_by_column(spark, sf_dir):
    t = Table(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), "o_orderkey", "o_orderstatus"), ("o_orderkey", "o_orderstatus"))
    return t.group_stats("o_orderstatus", F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_orderkey % 10 AS \"group\", count(*) AS size, min(o_orderkey) AS first, max(o_orderkey) AS last FROM orders GROUP BY 1")
def group_by_function(spark, sf_dir):
    t = Table(_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), "o_orderkey"), ("o_orderkey",))
    groups = t.group_by(F.col("o_orderkey") % 10)
    return groups.select("group", F.size("positions").cast("long").alias("size"), F.element_at("positions", 1).alias("first"), F.element_at("positions", -1).alias("last"))


@query("SELECT l_shipmode_like AS \"group\", count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS amount, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS quantity, count(*) FILTER (l_returnflag = 'R') AS flagged FROM (SELECT *, l_linestatus AS l_shipmode_like FROM lineitem) GROUP BY 1")
def etl_multi_pass(spark, sf_dir):
    df = _text(spark, sf_dir, "lineitem", "l_linestatus", "l_extendedprice", "l_quantity", "l_returnflag")
    out = stats.etl_multi_pass(df, "l_linestatus", "l_extendedprice", "l_quantity", "l_returnflag", "R")
    return out.withColumns({c: F.col(c).cast("decimal(28,2)") for c in ("amount", "quantity")})


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS n, round(avg({c}), 4) AS mean, round(var_samp({c}) / 100, 2) AS variance, CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem" for c in ("l_quantity", "l_discount", "l_linenumber")
    )
)
def column_stats(spark, sf_dir):
    out = stats.column_stats(_text(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_linenumber"))
    return out.withColumns({"mean": F.round("mean", 4), "variance": F.round(F.col("variance") / 100, 2)})


@query("SELECT 'value' AS \"column\", count(*) AS n_rows, count(*) - count(value) AS n_nulls, count(value) AS n_numeric, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS stdev FROM events UNION ALL SELECT 'event_type', count(*), 0, 0, NULL, 0.0 FROM events")
def eda_summary(spark, sf_dir):
    out = stats.eda_summary(_text(spark, sf_dir, "events", "value", "event_type"))
    return out.withColumns({"mean": F.round("mean", 4), "stdev": F.round("stdev", 4)})


@query("SELECT event_type AS value, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values_exact(spark, sf_dir):
    return stats.top_values(_text(spark, sf_dir, "events", "event_type"), "event_type", 10)


@query()
def top_values_approx(spark, sf_dir):
    return stats.top_values_approx(_text(spark, sf_dir, "events", "user_id"), "user_id", 10)


@query("SELECT 'c_name' AS \"column\", count(*) FILTER (c_name <> '') AS n, max(length(c_name)) AS longest FROM customer UNION ALL SELECT 'c_mktsegment', count(*) FILTER (c_mktsegment <> ''), max(length(c_mktsegment)) FROM customer")
def non_empty_per_column(spark, sf_dir):
    return stats.column_apply(_text(spark, sf_dir, "customer"), ["c_name", "c_mktsegment"], n=F.count_if(F.col("field") != ""), longest=F.max(F.length("field")).cast("long"))


@query("SELECT count(*) AS n, CAST(sum(length(c_name)) AS BIGINT) AS chars FROM customer")
def chunk_apply(spark, sf_dir):
    import pandas as pd

    df = _text(spark, sf_dir, "customer", "c_name")
    return stats.chunk_apply(df, 500, lambda: (0, 0), lambda a, b: (a[0] + len(b), a[1] + int(b["c_name"].str.len().sum())), lambda a, b: (a[0] + b[0], a[1] + b[1]), lambda a: pd.DataFrame([a], columns=["n", "chars"]), "n long, chars long")


@query("SELECT max(l_extendedprice) AS max FROM lineitem")
def max_column(spark, sf_dir):
    return stats.max_column(_text(spark, sf_dir, "lineitem", "l_extendedprice"), "l_extendedprice")


# --- keyed and edited tables ----------------------------------------------------------------------------------------------------


def _orders(spark, sf_dir) -> Table:
    df = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_pos"), F.col("o_custkey").cast("string").alias("o_custkey"), F.col("o_orderkey").cast("string").alias("o_orderkey"), "o_orderstatus")
    return Table(df, ("o_custkey", "o_orderkey", "o_orderstatus"))


@query("SELECT o_custkey AS _key, CAST(max(o_orderkey) AS VARCHAR) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus, min(o_orderkey) AS _pos FROM orders GROUP BY 1")
def keyed_overwrite(spark, sf_dir):
    return _orders(spark, sf_dir).keyed("o_custkey", "int64").df.select("_key", "o_orderkey", "o_orderstatus", "_pos")


@query("SELECT o_custkey AS _key, CAST(min(o_orderkey) AS VARCHAR) AS o_orderkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, min(o_orderkey) AS _pos FROM orders GROUP BY 1")
def keyed_keep_first(spark, sf_dir):
    return _orders(spark, sf_dir).keyed("o_custkey", "int64", KEEP_FIRST).df.select("_key", "o_orderkey", "o_orderstatus", "_pos")


def _lines_by_composite(spark, sf_dir) -> Table:
    columns = ("l_orderkey", "l_linenumber", "l_returnflag")
    order = F.struct(*[F.col(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    df = _table(spark, sf_dir, "lineitem").select(order.alias("_pos"), *[F.col(c).cast("string").alias(c) for c in columns])
    return Table(df, columns).keyed(F.concat_ws("-", "l_orderkey", "l_linenumber"))


@query("SELECT l_orderkey || '-' || l_linenumber AS _key, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_returnflag DESC) = 1")
def keyed_composite(spark, sf_dir):
    return _lines_by_composite(spark, sf_dir).df.select("_key", "l_returnflag")


@query("SELECT o_custkey AS _key, CAST(max(o_orderkey) AS VARCHAR) AS o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def keyed_lookup(spark, sf_dir):
    keys = _table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    return _orders(spark, sf_dir).keyed("o_custkey", "int64").lookup_all(keys, "c_custkey").select("_key", "o_orderkey")


def _nation(spark, sf_dir) -> Table:
    return Table.of(_text(spark, sf_dir, "nation", "n_nationkey", "n_name").withColumn("_order", F.col("n_nationkey").cast("int")), "_order").erase_column("_order")


@query("SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS _pos, o_orderkey FROM orders")
def row_positions(spark, sf_dir):
    return positioned(_table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


@query("SELECT n_nationkey AS _pos, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE n_nationkey WHEN 3 THEN 'edited' WHEN 7 THEN 'again' ELSE n_name END AS n_name FROM nation")
def edit_cells(spark, sf_dir):
    return _nation(spark, sf_dir).edit({(3, "n_name"): "once", (7, "n_name"): "again"}).edit({(3, "n_name"): "edited"}).rows()


@query("SELECT n_nationkey AS _pos, CAST(n_nationkey AS VARCHAR) AS n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE n_name END AS n_name FROM nation")
def edit_overlay(spark, sf_dir):
    edits = _table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_nationkey").cast("long").alias("_pos"), F.lit("n_name").alias("_name"), F.lit("even").alias("_value"))
    return _nation(spark, sf_dir).overlay(edits).rows()


@query("SELECT CASE WHEN n_nationkey >= 5 THEN n_nationkey + 1 ELSE n_nationkey END AS _pos, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation UNION ALL SELECT 5, '99', 'NEW'")
def insert_row(spark, sf_dir):
    return _nation(spark, sf_dir).insert_row(5, ("99", "NEW")).rows()


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, 'x' AS tag, n_name, '' AS note FROM nation")
def insert_column(spark, sf_dir):
    return _nation(spark, sf_dir).insert_column(1, "tag", "x").append_column("note").rows().drop("_pos")


@query("SELECT n_nationkey AS _pos, n_name FROM nation")
def erase_column(spark, sf_dir):
    return _nation(spark, sf_dir).erase_column("n_nationkey").rows()


@query("SELECT CASE WHEN n_nationkey > 4 THEN n_nationkey - 1 ELSE n_nationkey END AS _pos, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation WHERE n_nationkey <> 4")
def erase_row(spark, sf_dir):
    return _nation(spark, sf_dir).erase_row(4).rows()


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS _pos, CAST(s_suppkey AS VARCHAR) AS s_suppkey FROM supplier WHERE s_suppkey % 2 = 0")
def selected_rows_mask(spark, sf_dir):
    t = Table.of(_text(spark, sf_dir, "supplier", "s_suppkey").withColumn("_k", F.col("s_suppkey").cast("long")), "_k").erase_column("_k")
    return t.selected_rows(F.col("s_suppkey").cast("long") % 2 == 0).rows()


# --- JSON -----------------------------------------------------------------------------------------------------------------------


@query("""SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""")
def row_to_json(spark, sf_dir):
    df = _text(spark, sf_dir, "nation")
    return df.select(jsonrow.row_json(df.columns, [F.col(c) for c in df.columns]).alias("json"))


@query("""SELECT '[' || n_nationkey || ',"' || n_name || '",' || n_regionkey || ']' AS json FROM nation""")
def row_to_json_array(spark, sf_dir):
    df = _text(spark, sf_dir, "nation")
    return df.select(jsonrow.row_json_array([F.col(c) for c in df.columns]).alias("json"))


@query("""SELECT '{"props":"' || replace(replace(props, chr(92), chr(92) || chr(92)), '"', chr(92) || '"') || '","event_id":' || event_id || '}' AS json FROM events WHERE props IS NOT NULL""")
def json_subset(spark, sf_dir):
    df = _text(spark, sf_dir, "events", "event_id", "event_type", "props").filter("props <> ''")
    return df.select(jsonrow.row_json(["props", "event_id"], [F.col("props"), F.col("event_id")]).alias("json"))


@query("SELECT lang, count(*) AS n, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY 1")
def json_reads_back(spark, sf_dir):
    df = _text(spark, sf_dir, "documents", "lang", "text")
    made = df.select(jsonrow.row_json(df.columns, [F.col(c) for c in df.columns]).alias("json"))
    back = made.select(F.from_json("json", "lang string, text string").alias("r")).select("r.*")
    return back.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
