import pytest

from quillframe.operators import predicates as p
from quillframe.plans.reader import Reader, reader
from quillframe.sources import delimited, sink
from quillframe.sources import dialect as d

RAGGED = "A,B,C\n1,2,3\n4,5,6\n7,8\n1,2,3,4\n7,8,9\n"


@pytest.fixture
def put(tmp_path):
    def write(text, name="f.csv"):
        path = tmp_path / name
        path.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(path)

    return write


def got(rows):
    return sorted(tuple(r) for r in rows.named().collect())


CASES = [
    "A,B,C\n1,2,3\n4,5,6\n", RAGGED, 'A,B\n"x,1","y\nz"\n"q""q",\n', 'A,B\n"1"2",3\nx"y,z\n', "A,B\n,\n\n1,2\n", 'A\n""\nv\n', "﻿A,B\n1,2\n", "A,B\n  1 ,\t2\n", 'A,B\n1,"open\n2,3\n',
]


@pytest.mark.parametrize("text", CASES)
def test_fast_and_exact_paths_agree(spark, put, text):
    path = put(text)
    assert got(delimited.scan(spark, path, d.Dialect(), exact=False)) == got(delimited.scan(spark, path, d.Dialect(), exact=True))


def test_pruned_reads_drop_ragged_rows_too(spark, put):
    rows = delimited.scan(spark, put(RAGGED), d.Dialect(), exact=False)
    assert rows.df.count() == 3
    assert rows.df.select("_c0").count() == 3
    assert sorted(r[0] for r in rows.df.select("_c0").collect()) == ["1", "4", "7"]


def test_ragged_policies(spark, put):
    path = put(RAGGED)
    assert delimited.scan(spark, path, d.Dialect().ragged_rows(d.KEEP)).df.count() == 5
    with pytest.raises(Exception, match="Line too short 7,8"):
        delimited.scan(spark, path, d.Dialect().ragged_rows(d.THROW)).named().collect()
    blank = put("A,B\n\n1,2\n\n\n3,4\n", "blank.csv")
    assert delimited.scan(spark, blank, d.Dialect().ragged_rows(d.KEEP)).df.count() == 5
    assert delimited.scan(spark, blank, d.Dialect().ragged_rows(d.KEEP_NON_EMPTY)).df.count() == 2


def test_line_ends_inside_quotes_stay(spark, put):
    rows = delimited.scan(spark, put('A,B\r\n"x\r\ny",1\r\n'), d.Dialect())
    assert got(rows) == [("x\r\ny", "1")]


def test_trim_inside_quotes_and_header(spark, put):
    rows = delimited.scan(spark, put(' A , B \n " 1 "," 2 "\n', "t.csv"), d.Dialect().trimmed(" "))
    assert rows.names == ("A", "B")
    assert got(delimited.scan(spark, put('A,B\n" 1 ", 2 \n'), d.Dialect().trimmed(" "))) == [("1", "2")]


def test_wide_rows(spark, put):
    n = 25_000
    text = ",".join(f"c{k}" for k in range(n)) + "\n" + ",".join("1" for _ in range(n)) + "\n"
    rows = delimited.scan(spark, put(text), d.Dialect(), exact=True)
    assert len(rows.names) == n and len(rows.df.select("fields").first()[0]) == n


def test_names_repeat_and_miss(spark, put):
    rows = delimited.scan(spark, put("a,,a\n1,2,3\n"), d.Dialect())
    assert rows.df.select(rows["a"]).first()[0] == "3"  # the last of equal names
    with pytest.raises(KeyError, match="Column not found: z"):
        rows["z"]
    with pytest.raises(IndexError):
        rows[3]
    assert rows.df.select(rows[-1]).first()[0] == "3"
    assert delimited.column_position(spark, put("a,b\n1,2\n"), "zz", d.Dialect()) == -1
    with pytest.raises(FileNotFoundError):
        delimited.scan(spark, "/nowhere/x.csv")


def test_write_read_round_trip(spark, tmp_path):
    data = [("a,b", 'q"q', "l\nm"), ("", " x ", "é"), (None, "1", "\t")]
    df = spark.createDataFrame(data, "a string, b string, c string")
    for k, options in enumerate(({}, {"delimiter": "\t"}, {"delimiter": ";", "single_file": True}, {"minimal": False, "single_file": True})):
        path = str(tmp_path / f"o{k}")
        sink.write(df, path, **options)
        back = delimited.scan(spark, path, d.Dialect(delimiters=(options.get("delimiter", ","),)))
        assert got(back) == sorted(tuple(x or "" for x in r) for r in data)


def test_quotes_and_numbers_of_the_writer(spark):
    df = spark.createDataFrame([("x", 1, 2.5)], "s string, n int, d double")
    assert sink.lines(df, minimal=False).first()[0] == '"x",1,2.50000'
    assert sink.lines(df).first()[0] == "x,1,2.50000"


def test_reader_facade(spark, put):
    path = put("region,id,price\nel paso,1,10\nEL PASO,2,20\nAustin,3,x\nAustin,4,40\n")
    r = reader(spark, path)
    assert r.fieldnames == ["region", "id", "price"]
    assert [t[1] for t in r.filter(p.equal("region", "EL PASO", case_sensitive=False)).tuples()] == ["1", "2"]
    assert [t for t in r.filter(p.greater("price", 15)).lists(["id"])] == [["2"], ["4"]]  # x is no number
    both = r.filter(p.equal("region", "Austin")).filter(p.less("price", 100))
    assert both.count() == 1
    assert both.filter(p.equal("id", 3), append=False).count() == 1
    assert next(r.dicts(["id", "region"])) == {"id": "1", "region": "el paso"}
    assert [len(c) for c in r.chunks(3)] == [3, 1]
    assert r.types(["id", "price", "region"]) == {"id": "int64", "price": "string", "region": "string"}
    with pytest.raises(ValueError):
        next(r.chunks(0))
    with pytest.raises(KeyError):
        r.filter(p.equal("nope", 1))
    with pytest.raises(TypeError):
        r.filter(None)
    assert list(reader(spark, ["a,b", "1,2"]).tuples()) == [("1", "2")]


def test_batches_by_schema_mode(spark, put):
    r = reader(spark, put("mixed\n1\n2.5\nplain\n"))
    by_batch = [str(t.schema.field(0).type) for t in r.column_batches(batch_size=1, schema="batch")]
    assert by_batch == ["int64", "double", "string"]
    assert [t.to_pydict()["mixed"] for t in r.column_batches(batch_size=2, schema="sample")] == [[1.0, 2.5], [None]]
    assert [t.num_rows for t in r.column_batches(batch_size=2, schema="global")] == [2, 1]
    empty = list(r.filter(p.equal("mixed", "none")).column_batches())
    assert len(empty) == 1 and empty[0].num_rows == 0


def test_parse_in_memory(spark):
    rows = delimited.parse(spark, "a;b\r\n1;2\r\n")
    assert rows.names == ("a", "b") and got(rows) == [("1", "2")]
    assert Reader(rows).count() == 1


def test_stream(spark, put, tmp_path):
    from quillframe.streaming.ingest import stream, typed_chunks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,v\n1,2.5\n2,3.5,extra\n3,x\n")
    seen = []
    rows = stream(spark, str(tmp_path / "in"), ["id", "v"])
    q = typed_chunks(rows.named(), lambda df, plan, k: seen.append((plan, sorted(tuple(r) for r in df.collect()))), str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert seen == [({"id": "int64", "v": "string"}, [(1, "2.5"), (3, "x")])]


def test_masks_and_cursor(spark, put):
    r = reader(spark, put("a,b\n1,x\n2,y\n3,x\n"))
    assert [tuple(t) for t in r.excluded(p.equal("b", "x")).collect()] == [("2", "y")]
    assert [t["marked"] for t in r.marked(p.equal("b", "x")).collect()] == [True, False, True]
    c = r.cursor()
    assert c.read_chunk(0) == [] and c.read_row() == ("1", "x") and len(c.read_chunk(9)) == 2 and c.read_row() is None


def test_write_rows(spark, tmp_path):
    from quillframe.sources.sink import write_rows

    cases = [([{"a": 1, "b": None}, {"b": "x,y"}], {}, 'a,b\n1,\n,"x,y"\n'), ([], {"fieldnames": ["a"]}, "a\n"), ([[1.5, True]], {}, "1.5,True\n"), ([["q"]], {"minimal": False}, '"q"\n')]
    for k, (rows, options, want) in enumerate(cases):
        write_rows(spark, str(tmp_path / f"w{k}"), rows, **options)
        assert "".join(f.read_text() for f in (tmp_path / f"w{k}").glob("part-*")) == want


def test_generated_rows_round_trip(spark, tmp_path):
    from quillframe.sources.generate import generate

    df = generate(spark, 1000, distinct=True)
    sink.write(df, str(tmp_path / "g"))
    back = delimited.scan(spark, str(tmp_path / "g"), d.Dialect(), multiline=False).named()
    assert sorted(int(r["col_C"]) for r in back.collect()) == [5 * k + 2 for k in range(1000)]


def test_record_ends_that_change_far_into_a_file(spark, tmp_path):
    """Beyond the bytes that the dialect is settled by, lone carriage returns and CRLF end records on every path."""
    (tmp_path / "late.csv").write_bytes(b"a,b\n" + b"".join(b"%d,some text here\n" % k for k in range(30_000)) + b"3,4\r5,6\r7,8")
    (tmp_path / "later.csv").write_bytes(b"a,b\n1,2\r\n3,4\r")
    for path, n in (("late.csv", 30_003), ("", 30_005)):
        for args in ({}, {"multiline": False}, {"exact": True}):
            rows = delimited.scan(spark, str(tmp_path / path), **args)
            assert rows.df.count() == n
            assert {r["_c1"] for r in rows.df.filter("_c0 in ('5', '7')").collect()} >= {"6", "8"}
