import pytest

from quillframe.sources import dialect as d


def rows(text, delimiter=",", quote='"'):
    return [f for _, f, _ in d.records(text.encode(), delimiter, quote)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("A,B\n1,2\n", [["A", "B"], ["1", "2"]]),
        ("A\r\n1\r2\n3", [["A"], ["1"], ["2"], ["3"]]),  # mixed ends
        ('"234""345",x\n', [['234"345', "x"]]),
        ('"234"345",x\n', [['234"345', "x"]]),  # a stray quote inside
        (' "x,y"\n', [[' "x', 'y"']]),  # a quote behind the first byte is plain
        ('"234\n,345",1\n', [["234\n,345", "1"]]),
        ('1,"abc\n2,3\n', [["1", "abc\n2,3\n"]]),  # runs to the end
        ("1,2,\n4,5,", [["1", "2", ""], ["4", "5", ""]]),
        ('A\n""\nvalue\n', [["A"], [""], ["value"]]),
        ("a\n\nb\n", [["a"], [], ["b"]]),  # a blank line has no fields
        ("a\r\r\nb", [["a"], [], ["b"]]),
        ("", []),
    ],
)
def test_records(text, want):
    assert rows(text) == want


def test_quoting_off():
    assert rows('"a,b"\n', quote=None) == [['"a', 'b"']]


def test_offsets_and_raw_bytes():
    data = 'é,1\r\n"x\ny",2\n'.encode()
    found = list(d.records(data, ",", '"'))
    assert [(at, raw) for at, _, raw in found] == [(0, "é,1".encode()), (6, b'"x\ny",2')]


def test_against_the_csv_module():
    import csv
    import io
    import random

    rng = random.Random(4)
    for _ in range(200):
        table = [["".join(rng.choice('ab ,"\n') for _ in range(rng.randint(1, 6))) for _ in range(3)] for _ in range(4)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows(table)
        assert rows(out.getvalue()) == table


@pytest.mark.parametrize("text,delimiter,header,width", [("a;b;c\n1;2;3\n", ";", 0, 3), ("# x\n# y\na,b,c\n1,2,3\n4,5,6\n", ",", 2, 3), ("a|b\n1|2\n", "|", 0, 2), ("a\tb\n1\t2\n", "\t", 0, 2), ("one\ntwo\n", ",", 0, 1), ("a;b;c;d\n1;2;3\n4;5;6\n", ";", 0, 3)])
def test_guess(text, delimiter, header, width):
    g = d.guess(text.encode())
    assert (g.delimiter, g.header, g.width) == (delimiter, header, width)


def test_overlap_and_sizes_are_refused():
    with pytest.raises(d.DialectError, match="overlap"):
        d.Dialect(delimiters=(",",), trim=(",",))
    with pytest.raises(d.DialectError, match="overlap"):
        d.Dialect(delimiters=('"',))
    with pytest.raises(d.DialectError):
        d.Dialect().chunk_size(10)
    with pytest.raises(d.DialectError):
        d.guessed().delimiter  # noqa: B018


def test_names_header_and_policies():
    assert d.Dialect().no_header().ragged == d.KEEP
    assert d.Dialect().column_names(["a"]).header == -1
    r = d.resolve(d.guessed().column_names(["x", "y"]), b"# junk\na;b\n1;2\n")
    assert r.delimiter == ";" and r.header == 1 and r.names == ("x", "y")  # a guessed header goes even under explicit names
    assert d.resolve(d.Dialect().no_header(), b"junk\n1,2,3\n4,5,6\n").width == 3
    assert d.python_dialect(skipinitialspace=True).trim == (" ",)
    assert d.python_dialect(fieldnames=["a"]).ragged == d.KEEP
    assert d.python_dialect(consume_header=False).ragged == d.KEEP
    with pytest.raises(d.DialectError):
        d.python_dialect(doublequote=False)


def test_byte_marks():
    assert d.check_encoding(b"\xef\xbb\xbfA,B") is True
    assert d.resolve(d.Dialect(), b"\xef\xbb\xbfA,B\n1,2").names == ("A", "B")
    for mark in (b"\xff\xfeA\0", b"\xfe\xff\0A", b"\0\0\xfe\xff"):
        with pytest.raises(d.DialectError):
            d.check_encoding(mark)


def test_position():
    assert d.position(["a", "b", "a"], "a") == 2
    assert d.position(["a"], "A") == -1
    assert d.position(["a"], "A", d.CASE_INSENSITIVE) == 0
