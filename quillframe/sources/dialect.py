"""Dialects of delimited text: what a file's records look like, and how to guess it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

#: Delimiters tried, in order; the chunk sizes allowed.
CANDIDATES = (",", "|", "\t", ";", "^")
LEAST_CHUNK, MOST_CHUNK = 500_000, 2**32 - 1

IGNORE_ROW, KEEP, KEEP_NON_EMPTY, THROW = "ignore_row", "keep", "keep_non_empty", "throw"
EXACT, CASE_INSENSITIVE = "exact", "case_insensitive"


class DialectError(ValueError):
    """A dialect that contradicts itself, or a file that none fits."""


@dataclass(frozen=True)
class Dialect:
    """How to read a file. Methods return changed copies, as a fluent builder.

    delimiters: one is fixed, several are guessed from. header: the record that holds the names, -1 for none, None to guess. names:
    explicit names, which stand for no header unless one is guessed. ragged: what becomes of records of another width.
    """

    delimiters: tuple[str, ...] = (",",)
    quote: str | None = '"'
    header: int | None = 0
    names: tuple[str, ...] = ()
    trim: tuple[str, ...] = ()
    ragged: str = IGNORE_ROW
    name_policy: str = EXACT
    chunk: int = 10_000_000
    guessing: bool = field(default=False)

    def __post_init__(self):
        for what, chars in (("delimiters", self.delimiters), ("trim characters", self.trim)):
            if any(len(c) != 1 for c in chars):
                raise DialectError(f"{what} are single characters")
        shared = [set(a) & set(b) for a, b in ((self.delimiters, self.trim), (self.delimiters, self.quote or ""), (self.trim, self.quote or ""))]
        both = sorted(set().union(*shared))
        if both:
            raise DialectError(f"There should be no overlap between the quote character, the set of possible delimiters and the set of whitespace characters. Offending characters: {', '.join(both)}")
        if not self.delimiters:
            raise DialectError("there is no delimiter")
        if not LEAST_CHUNK <= self.chunk <= MOST_CHUNK:
            raise DialectError(f"chunk size must be from {LEAST_CHUNK} to {MOST_CHUNK}")
        if self.ragged not in (IGNORE_ROW, KEEP, KEEP_NON_EMPTY, THROW):
            raise DialectError(f"no policy {self.ragged!r}")

    @property
    def delimiter(self) -> str:
        if len(self.delimiters) > 1:
            raise DialectError("There is more than one possible delimiter.")
        return self.delimiters[0]

    def delimited_by(self, *chars: str) -> "Dialect":
        return replace(self, delimiters=tuple(chars), guessing=self.guessing or len(chars) > 1)

    def quoted_by(self, char: str | None) -> "Dialect":
        return replace(self, quote=char or None)

    def header_row(self, row: int) -> "Dialect":
        """A negative row means that there is none, and that records of any width are kept."""
        return replace(self, header=max(row, -1), names=(), ragged=KEEP if row < 0 else self.ragged)

    def no_header(self) -> "Dialect":
        return self.header_row(-1)

    def column_names(self, names: Sequence[str]) -> "Dialect":
        return replace(self, names=tuple(names), header=None if self.guessing else -1)

    def trimmed(self, *chars: str) -> "Dialect":
        return replace(self, trim=tuple(chars))

    def ragged_rows(self, policy: str) -> "Dialect":
        return replace(self, ragged=policy)

    def names_policy(self, policy: str) -> "Dialect":
        return replace(self, name_policy=policy)

    def chunk_size(self, size: int) -> "Dialect":
        return replace(self, chunk=size)


def guessed() -> Dialect:
    """The dialect that guesses delimiter and header."""
    return Dialect(delimiters=CANDIDATES, header=None, guessing=True)


def python_dialect(delimiter: str = ",", quotechar: str | None = '"', doublequote: bool = True, skipinitialspace: bool = False, strict: bool = False, fieldnames: Sequence[str] | None = None, consume_header: bool = True) -> Dialect:
    """A dialect from the keywords of Python's csv module. skipinitialspace trims spaces at both ends, inside quotes too."""
    if not doublequote:
        raise DialectError("doublequote=False isn't supported")
    d = Dialect(delimiters=(delimiter,), quote=quotechar or None, trim=(" ",) if skipinitialspace else (), ragged=THROW if strict else IGNORE_ROW)
    if fieldnames is not None:
        return replace(d, names=tuple(fieldnames), header=-1, ragged=THROW if strict else KEEP)
    return d if consume_header else replace(d.no_header(), ragged=THROW if strict else KEEP)


# --- records -------------------------------------------------------------------------------------------------------------------


def _pattern(delimiter: str, quote: str | None) -> re.Pattern[bytes]:
    d = re.escape(delimiter.encode())
    ends = rb"(" + d + rb"|\r\n|\r|\n|\Z)"
    plain = rb"([^" + d + rb"\r\n]*+)"
    if not quote:
        return re.compile(rb"()" + plain + ends)
    q = re.escape(quote.encode())
    inside = rb"((?:[^" + q + rb"]++|" + q + q + rb"|" + q + rb"(?!" + d + rb"|[\r\n]|\Z))*+)"
    return re.compile(rb"(?:" + q + inside + rb"(?:" + q + rb"|\Z)|" + plain + rb")" + ends)


def records(data: bytes, delimiter: str, quote: str | None) -> Iterator[tuple[int, list[str], bytes]]:
    """Byte offset, fields and raw bytes of each record.

    Record ends may be mixed. A doubled quote is one quote; a stray quote inside a quoted field, or behind the first byte of a bare
    one, is itself; a quote that isn't closed runs to the end. A blank line is a record without fields; a line end at the end of the
    data begins no record.
    """
    pattern = _pattern(delimiter, quote)
    q = (quote or "").encode()
    at = start = 0
    fields: list[str] = []
    n = len(data)
    cut = delimiter.encode()
    while at < n or fields:
        m = pattern.match(data, at)
        inside, bare, end = m[1], m[2], m[3]
        quoted = bool(q) and inside is not None
        value = inside.replace(q + q, q) if quoted else bare
        if end == cut:
            fields.append(value.decode("utf-8", "replace"))
            at = m.end()
            if at >= n:  # a delimiter at the very end: one more empty field
                fields.append("")
                yield start, fields, data[start:at]
                return
            continue
        if fields or value or quoted:
            fields.append(value.decode("utf-8", "replace"))
        yield start, fields, data[start : m.end() - len(end)]
        fields, at = [], m.end()
        start = at
        if not end:
            return


@dataclass(frozen=True)
class Guess:
    delimiter: str
    header: int
    width: int


def guess(data: bytes, candidates: Sequence[str] = CANDIDATES) -> Guess:
    """The delimiter with the largest product of width and records of that width; the earlier wins ties. Quotes are always `"`.

    The header is the first record if it is at least as wide as most are, else the first record of that width.
    """
    best: tuple[int, Guess] | None = None
    for c in candidates:
        widths = [len(f) for _, f, _ in records(data, c, '"')]
        score, width, header = 0, 0, 0
        if widths:
            seen = Counter(widths)
            width, n = max(seen.items(), key=lambda x: (x[0] * x[1], -x[0]))
            score = width * n
            header = 0 if widths[0] >= width else widths.index(width)
        if best is None or score > best[0]:
            best = (score, Guess(c, header, width))
    return best[1]


def check_encoding(data: bytes) -> bool:
    """Whether a UTF-8 mark comes first. Raises for UTF-16 and UTF-32."""
    if data.startswith((b"\xff\xfe", b"\xfe\xff", b"\x00\x00\xfe\xff")):
        raise DialectError("UTF-16 and UTF-32 aren't supported")
    return data.startswith(b"\xef\xbb\xbf")


@dataclass(frozen=True)
class Resolved:
    """A dialect with its delimiter, header and names settled for one file. names: None where the file has none."""

    dialect: Dialect
    delimiter: str
    header: int
    names: tuple[str, ...] | None
    width: int
    bom: bool = False


def trimmed(text: str, chars: Sequence[str]) -> str:
    return text.strip("".join(chars)) if chars else text


def resolve(dialect: Dialect, data: bytes) -> Resolved:
    """Settles a dialect by a file's first bytes. A guessing dialect drops what comes before the header that it infers, even under explicit names."""
    bom = check_encoding(data)
    data = data[3:] if bom else data
    delimiter, header = (dialect.delimiters[0], dialect.header)
    if len(dialect.delimiters) > 1 or header is None:
        g = guess(data, dialect.delimiters)
        delimiter = g.delimiter
        header = g.header if header is None else header
    rows = [f for _, f, _ in records(data, delimiter, dialect.quote)]
    if dialect.names:
        return Resolved(dialect, delimiter, header, dialect.names, len(dialect.names), bom)
    if header is not None and header >= 0:
        names = tuple(trimmed(x, dialect.trim) for x in rows[header]) if header < len(rows) else ()
        return Resolved(dialect, delimiter, header, names, len(names), bom)
    widths = Counter(len(r) for r in rows if r)
    width = max(widths.items(), key=lambda x: (x[1], -x[0]))[0] if widths else 0
    return Resolved(dialect, delimiter, -1, None, width, bom)


def position(names: Sequence[str], name: str, policy: str = EXACT) -> int:
    """Place of a name, -1 where there is none; of equal names the last."""
    if policy == CASE_INSENSITIVE:
        names, name = [n.lower() for n in names], name.lower()
    return max((k for k, n in enumerate(names) if n == name), default=-1)
