"""FITS files as a data source: headers of every unit, and rows of their binary tables.

A file is a row of units, each a header of 80-byte cards in blocks of 2880 bytes and then data whose length the header
tells. The reader hops from header to header and never reads data that it was not asked for. Files are dealt by byte
ranges, known from their sizes alone: a task hops through the headers of its file and takes the table rows that begin
in its range, so neither a large file nor many small ones wait for the driver. Rows are decoded in numpy, the columns of
the asked schema alone.

    spark.read.format("fits").option("mode", "cards").load(path)           # path, hdu, at, key, value, comment
    spark.read.format("fits").schema("OBJECT string, TIME double").option("keys", "OBJECT").load(path)

Columns listed in `keys` are header keys of a table's unit, or of the first unit where that lacks them. The option `only`
(JSON: lists of values by key) hops over units that don't fit; so do filters on those columns where the session pushes
filters into Python sources (option `pushdown`, which `fits_rows` takes from spark.sql.python.filterPushdown.enabled).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shared import file_system, files_below

#: Bytes of a card and of a block; fixed values of the format.
CARD, BLOCK = 80, 2880
#: Bytes of a file that one task takes; bytes and rows of a table that it decodes at once; rows of a written unit.
RANGE, CHUNK, ROWS, UNIT_ROWS = 64 << 20, 8 << 20, 10_000, 1_000_000
CARDS = "path string, hdu int, at int, key string, value string, comment string"
#: Letters of column forms, and the numbers they stand for (big-endian); fixed values of the format.
FORMS = {"L": "S1", "B": "u1", "I": ">i2", "J": ">i4", "K": ">i8", "E": ">f4", "D": ">f8"}
#: Bytes of an element of any form, those of bit arrays and descriptors included; fixed values of the format.
WIDTHS = {"L": 1, "B": 1, "I": 2, "J": 4, "K": 8, "A": 1, "E": 4, "D": 8, "C": 8, "M": 16, "P": 8, "Q": 16}
_QUOTED = re.compile(r" *'((?:[^']|'')*)'")


@dataclass(frozen=True)
class Card:
    key: str
    value: str | None
    comment: str


@dataclass(frozen=True)
class Unit:
    """A header, where its data begins, and how many bytes it has without the padding."""

    hdu: int
    cards: list[Card]
    begin: int
    length: int

    def get(self, key: str) -> str | None:
        return next((c.value for c in self.cards if c.key == key), None)

    def number(self, key: str, default: int = 0) -> int:
        value = self.get(key)
        return default if value is None else int(value)

    @property
    def is_table(self) -> bool:
        return self.get("XTENSION") == "BINTABLE"


def card_of(line: str) -> Card:
    """Strings lose their quotes and the spaces at their end, doubled quotes within are one; comments and histories
    have no value."""
    key = line[:8].rstrip()
    if line[8:10] != "= ":
        return Card(key, None, line[8:].strip())
    if m := _QUOTED.match(line, 10):
        return Card(key, m[1].replace("''", "'").rstrip(), line[m.end() :].partition("/")[2].strip())
    value, _, comment = line[10:].partition("/")
    return Card(key, value.strip(), comment.strip())


def joined(cards: Iterator[Card], lines: list[str]) -> list[Card]:
    """Cards with long strings put together: one that ends in & goes on in the CONTINUE cards after it."""
    out: list[Card] = []
    for c, line in zip(cards, lines):
        if c.key == "CONTINUE" and out and (out[-1].value or "").endswith("&") and (m := _QUOTED.match(line, 8)):
            more = line[m.end() :].partition("/")[2].strip()
            out[-1] = Card(out[-1].key, out[-1].value[:-1] + m[1].replace("''", "'").rstrip(), f"{out[-1].comment} {more}".strip())
        else:
            out.append(c)
    return out


def units(f: BinaryIO, size: int) -> Iterator[Unit]:
    """The units of a file, by their headers alone. A file that begins otherwise is a ValueError; one that ends within
    a header or its data is an EOFError once that is come to."""
    at, hdu = 0, 0
    while at < size:
        lines: list[str] = []
        while True:
            f.seek(at)
            block = f.read(BLOCK)
            if not lines and not hdu and not block.startswith(b"SIMPLE  ="):
                raise ValueError("not a FITS file")
            if len(block) < BLOCK:
                raise EOFError("the file ends within a header")
            at += BLOCK
            some = [block[i : i + CARD].decode("latin-1") for i in range(0, BLOCK, CARD)]
            end = next((i for i, x in enumerate(some) if x.rstrip() == "END"), None)
            lines += some[:end]
            if end is not None:
                break
        unit = Unit(hdu, joined(map(card_of, lines), lines), at, 0)
        axes = [unit.number(f"NAXIS{k + 1}") for k in range(unit.number("NAXIS"))]
        axes = axes[1:] if axes and axes[0] == 0 and unit.get("GROUPS") == "T" else axes
        cells = int(np.prod([int(a) for a in axes], dtype=object)) if axes else 0
        length = abs(unit.number("BITPIX", 8)) // 8 * unit.number("GCOUNT", 1) * (unit.number("PCOUNT") + cells)
        yield Unit(hdu, unit.cards, at, length)
        at, hdu = at + -(-length // BLOCK) * BLOCK, hdu + 1


class Layout:
    """Columns of a binary table: name, letter, count, place in the row, and how stored numbers become values."""

    def __init__(self, unit: Unit):
        self.width, self.rows = unit.number("NAXIS1"), unit.number("NAXIS2")
        self.columns: dict[str, tuple[str, int, int, float, float, int | None]] = {}
        at = 0
        for k in range(1, unit.number("TFIELDS") + 1):
            form = re.match(r"(\d*)([A-Z])", unit.get(f"TFORM{k}") or "")
            if not form:
                raise ValueError(f"column {k} has no form")
            count, letter = int(form[1] or 1), form[2]
            null = unit.get(f"TNULL{k}")
            name = unit.get(f"TTYPE{k}") or f"column_{k}"
            self.columns.setdefault(name.upper(), (letter, count, at, float(unit.get(f"TSCAL{k}") or 1), float(unit.get(f"TZERO{k}") or 0), None if null is None else int(null)))
            at += -(-count // 8) if letter == "X" else count * WIDTHS.get(letter, 0)
        if at > self.width:
            raise ValueError(f"columns of {at} bytes in rows of {self.width}")

    def decode(self, rows: bytes, name: str, kind: pa.DataType) -> pa.Array:
        """One column of some rows. Whole numbers that TNULL names are null, and so is a column that the table lacks;
        a count above one makes an array of each row; other forms than numbers, truth values and strings are an error."""
        n = len(rows) // self.width
        if name.upper() not in self.columns:
            return pa.nulls(n, kind)
        letter, count, at, scale, zero, null = self.columns[name.upper()]
        if letter == "A":
            cells = np.ndarray((n,), f"S{count}", rows, at, (self.width,)) if count else np.full(n, b"")
            return pa.array([x.partition(b"\0")[0].decode("latin-1").rstrip() for x in cells.tolist()], pa.string()).cast(kind)
        if letter not in FORMS:
            raise ValueError(f"column {name} is of form {letter}, which this reader has no type for")
        cells = np.ndarray((n, count), FORMS[letter], rows, at, (self.width, WIDTHS[letter]))
        flat = np.ascontiguousarray(cells).reshape(-1)
        if letter == "L":
            values = pa.array(flat == b"T", mask=(flat != b"T") & (flat != b"F"))
        else:
            gone = flat == null if null is not None and letter in "BIJK" else None
            flat = flat.astype(flat.dtype.newbyteorder("="))
            if scale != 1 or zero != 0:
                whole = letter in "BIJK" and scale == 1 and zero == int(zero) and abs(zero) < 2**62
                flat = flat.astype("i8") + int(zero) if whole else flat * scale + zero
            values = pa.array(flat, mask=gone)
        if not pa.types.is_list(kind):
            if count != 1:
                raise ValueError(f"column {name} holds {count} values in a row")
            return values.cast(kind)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype="i4") * count), values.cast(kind.value_type))


@dataclass
class Part(InputPartition):
    path: str
    begin: int
    end: int
    size: int


class FitsReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.cards = options["path"], options.get("mode", "rows") == "cards"
        self.range = int(options.get("range", RANGE))
        self.schema = to_arrow_schema(schema)
        self.keys = [k for k in (x.strip() for x in options.get("keys", "").split(",")) if k]
        self.wanted: dict[str, set[str]] = {k: set(v) for k, v in json.loads(options.get("only", "{}")).items()}

    def partitions(self) -> Sequence[InputPartition]:
        found = files_below(self.path)
        if self.cards:
            return [Part(p, 0, n, n) for p, n in found]
        return [Part(p, at, min(at + self.range, n), n) for p, n in found for at in range(0, max(n, 1), self.range)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark's stand-in where there is no file
            return
        fs, path = file_system(partition.path)
        with fs.open_input_file(path) as f:
            yield from (self.headers if self.cards else self.rows)(f, partition)

    def headers(self, f: BinaryIO, part: Part) -> Iterator[pa.RecordBatch]:
        """All cards with a key; a file that can't be read to its end gives a row without hdu and key, the fault as comment."""
        found = []
        try:
            for u in units(f, part.size):
                found += [(part.path, u.hdu, i, c.key, c.value, c.comment) for i, c in enumerate(u.cards) if c.key]
            if not part.size:
                raise ValueError("not a FITS file")
        except (ValueError, OSError, EOFError) as fault:
            found.append((part.path, None, None, None, None, str(fault)))
        columns = dict(zip(("path", "hdu", "at", "key", "value", "comment"), zip(*found)))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in self.schema], schema=self.schema)

    def rows(self, f: BinaryIO, part: Part) -> Iterator[pa.RecordBatch]:
        """Rows that begin in the range; a file that is no FITS file is an error."""
        first: Unit | None = None
        for unit in units(f, part.size):
            first = first or unit
            if unit.begin >= part.end:
                return
            if not unit.is_table:
                continue
            known = {k: unit.get(k) if unit.get(k) is not None else first.get(k) for k in self.keys}
            if any(known[k] not in v for k, v in self.wanted.items()):
                continue
            layout = Layout(unit)
            if not layout.width:
                continue
            low, high = (min(max(0, -(-(x - unit.begin) // layout.width)), layout.rows) for x in (part.begin, part.end))
            step = max(1, min(ROWS, CHUNK // layout.width))
            for at in range(low, high, step):
                n = min(step, high - at)
                f.seek(unit.begin + at * layout.width)
                data = f.read(n * layout.width)
                if len(data) < n * layout.width:
                    raise EOFError(f"{part.path} ends within a table")
                own = {"path": lambda: pa.array([part.path] * n), "hdu": lambda: pa.array(np.full(n, unit.hdu, "i4")), "row": lambda: pa.array(np.arange(at, at + n))}
                columns = []
                for field in self.schema:
                    if field.name in self.keys:
                        columns.append(pa.array([known[field.name]] * n, pa.string()).cast(field.type))
                    else:
                        columns.append(own[field.name]().cast(field.type) if field.name in own else layout.decode(data, field.name, field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=self.schema)


class PushingFitsReader(FitsReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 and f.attribute[0] in self.keys and self.schema.field(f.attribute[0]).type == pa.string() and getattr(f, "value", 0) is not None:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                name = f.attribute[0]
                self.wanted[name] = self.wanted[name] & values if name in self.wanted else values
            else:
                yield f


def _card(key: str, value: object, comment: str = "") -> bytes:
    text = "T" if value is True else "F" if value is False else f"{str(value).replace(chr(39), chr(39) * 2):<8}" if isinstance(value, str) else str(value)
    text = f"'{text}'" if isinstance(value, str) else f"{text:>20}"
    line = f"{key:<8}= {text}" + (f" / {comment}" if comment else "")
    return line.encode("ascii", "replace")[:CARD].ljust(CARD)


def _block(cards: list[bytes]) -> bytes:
    data = b"".join([*cards, b"END".ljust(CARD)])
    return data + b" " * (-len(data) % BLOCK)


PRIMARY = _block([_card("SIMPLE", True), _card("BITPIX", 8), _card("NAXIS", 0), _card("EXTEND", True)])


def table_unit(keys: dict[str, object], batch: pa.Table) -> bytes:
    """A binary table of 64-bit numbers and strings, with header keys of its own. Missing floats are NaN; missing whole
    numbers are the least one, which TNULL names."""
    kinds, cards, columns = [], [], []
    for k, (name, column) in enumerate(zip(batch.column_names, batch.columns), 1):
        if pa.types.is_floating(column.type):
            form, cells = "D", column.cast(pa.float64()).to_numpy().astype(">f8")
        elif pa.types.is_integer(column.type):
            form, cells = "K", column.cast(pa.int64()).fill_null(-(2**63)).to_numpy().astype(">i8")
        else:
            texts = [(x or "").encode("latin-1", "replace") for x in column.to_pylist()]
            width = max([1, *map(len, texts)])
            form, cells = f"{width}A", np.array(texts, f"S{width}")
        kinds.append((f"f{k}", cells.dtype))
        columns.append(cells)
        cards += [_card(f"TTYPE{k}", name), _card(f"TFORM{k}", form), *([_card(f"TNULL{k}", -(2**63))] if form == "K" else [])]
    rows = np.empty(len(batch), kinds)
    for (name, _), cells in zip(kinds, columns):
        rows[name] = cells
    data = rows.tobytes()
    head = [_card("XTENSION", "BINTABLE"), _card("BITPIX", 8), _card("NAXIS", 2), _card("NAXIS1", rows.dtype.itemsize), _card("NAXIS2", len(rows)), _card("PCOUNT", 0), _card("GCOUNT", 1), _card("TFIELDS", len(kinds))]
    return _block([*head, *cards, *(_card(k, v) for k, v in keys.items())]) + data + b"\0" * (-len(data) % BLOCK)


@dataclass
class Wrote(WriterCommitMessage):
    name: str


class FitsWriter(DataSourceArrowWriter):
    """One file a task. Rows that follow each other with the same values in the columns `keys` become one unit, whose
    header holds those values; a unit has at most UNIT_ROWS rows."""

    def __init__(self, options: dict):
        self.path, self.keys = options["path"], [k.strip() for k in options["keys"].split(",")]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        fs, base = file_system(self.path)
        fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4().hex}.fits"
        held: list[pa.RecordBatch] = []
        now: tuple | None = None
        n = 0
        with fs.open_output_stream(f"{base}/{name}") as f:
            f.write(PRIMARY)

            def flush() -> None:
                nonlocal held, n
                if held:
                    whole = pa.Table.from_batches(held)
                    f.write(table_unit({k: v for k, v in zip(self.keys, now) if v is not None}, whole.drop_columns(self.keys)))
                held, n = [], 0

            for b in iterator:
                values = list(zip(*(b.column(k).to_pylist() for k in self.keys)))
                cuts = [0, *(i for i in range(1, len(b)) if values[i] != values[i - 1]), len(b)]
                for a, z in zip(cuts[:-1], cuts[1:]):
                    if a < z:
                        if held and (values[a] != now or n + z - a > UNIT_ROWS):
                            flush()
                        now = values[a]
                        held.append(b.slice(a, z - a))
                        n += z - a
            flush()
        return Wrote(name)

    def abort(self, messages: list[Wrote | None]) -> None:
        fs, base = file_system(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{base}/{m.name}")


class FitsDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fits"

    def schema(self) -> str:
        if self.options.get("mode") == "cards":
            return CARDS
        raise ValueError("state the columns of a table by .schema(...), or ask for the cards by .option('mode', 'cards')")

    def reader(self, schema: StructType) -> FitsReader:
        pushing = self.options.get("pushdown", "false").lower() == "true" and self.options.get("mode") != "cards"
        return (PushingFitsReader if pushing else FitsReader)(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> FitsWriter:
        return FitsWriter(self.options)


def _reader(spark: SparkSession):
    spark.dataSource.register(FitsDataSource)
    return spark.read.format("fits")


def fits_cards(spark: SparkSession, path: str) -> DataFrame:
    """(path, hdu, at, key, value, comment) of the cards of all units of each file at or below a path.

    Cards without a key and those after END are left out. A file that is no FITS file, or ends too early, gives the
    cards before that and a row without hdu and key whose comment says what is wrong.
    """
    return _reader(spark).option("mode", "cards").load(path)


#: What is told of a product, and the keys that tell it, the first one first; fixed values.
PRODUCT_KEYS = {"quarter": ("QUARTER",), "data_release": ("DATA_REL", "DATREL", "DRN"), "pipeline_version": ("PROCVER", "PIPEVER", "SOCVER")}


def first_values(cards: DataFrame, wanted: dict[str, tuple[str, ...]] = PRODUCT_KEYS) -> DataFrame:
    """(path, each name of wanted, header_read_error): the value of the first unit that has one of a name's keys, of its
    keys the one listed first; null where no unit has one. One aggregate by file."""
    columns = []
    for name, keys in wanted.items():
        rank = F.coalesce(*(F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(keys)))
        columns.append(F.min_by(F.when(rank.isNotNull(), F.col("value")), F.when(rank.isNotNull(), F.struct("hdu", rank.alias("rank"), "at"))).alias(name))
    return cards.groupBy("path").agg(*columns, F.bool_or(F.col("hdu").isNull()).alias("header_read_error"))


def fits_rows(spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = (), only: dict[str, list[str]] | None = None) -> DataFrame:
    """Rows of the binary tables of all files at or below a path, in the columns of a schema. Columns named in keys come
    from headers; path, hdu and row tell where a row stands; others are table columns, whatever the case of their names.
    only: values of keys; tables with others are not read."""
    pushing = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return _reader(spark).schema(schema).option("keys", ",".join(keys)).option("only", json.dumps(only or {})).option("pushdown", pushing).load(path)


def write_fits(rows: DataFrame, folder: str, keys: tuple[str, ...], order: tuple[str, ...], files: int | None = None) -> None:
    """Writes rows as FITS files: tables of the rows of equal keys, in an order, each with its keys in the header.
    Rows are dealt by range of keys and order, so a large table is spread over files."""
    rows.sparkSession.dataSource.register(FitsDataSource)
    by = [*keys, *order]
    dealt = rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
    dealt.sortWithinPartitions(*by).write.format("fits").option("keys", ",".join(keys)).mode("append").save(folder)
