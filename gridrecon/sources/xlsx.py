"""Workbooks as cells, read and written in tasks: doc, sheet, sheet_idx, row, col, value, border styles, error.

A file that is no workbook, or whose parts cannot be read, gives one row with its doc and error, whatever was read of it before.
"""

from __future__ import annotations

import io
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

SCHEMA = "doc string, sheet string, sheet_idx int, row int, col int, value string, b_top string, b_bottom string, b_left string, b_right string, error string"
_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), *[pa.string()] * 6]
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_NS = {"m": _MAIN, "r": f"{_PACKAGE}/relationships"}
_REL = f"{{{_OFFICE}}}id"
#: Cells of one batch.
ROWS = 10_000


# --- reading a workbook ------------------------------------------------------------------------------------------------


_T, _R, _V, _IS, _ROW, _C, _SI = (f"{{{_MAIN}}}{t}" for t in ("t", "r", "v", "is", "row", "c", "si"))
#: Parts up to this size are unpacked and parsed at once; larger ones as they are unpacked.
SMALL = 1 << 20


def _plain(e: ElementTree.Element) -> str:
    """Text of a string: its own and that of its runs, without what tells how it is pronounced."""
    own = "".join([x.text or "" for x in e if x.tag == _T])
    return own + "".join([t.text or "" for x in e if x.tag == _R for t in x if t.tag == _T])


@lru_cache(1 << 16)
def _at(ref: str | None) -> tuple[int, int] | None:
    m = re.fullmatch(r"([A-Z]+)(\d+)", ref or "")
    if not m:
        return None
    n = 0
    for a in m[1]:
        n = n * 26 + ord(a) - 64
    return int(m[2]), n


def _place(ref: str | None, row: int, col: int) -> tuple[int, int]:
    """Row and column of a cell; one without a reference follows the cell before it."""
    return _at(ref) or (row, col + 1)


def _value(c: ElementTree.Element, strings: list[str]) -> str | None:
    kind = c.get("t")
    if kind == "inlineStr":
        return next((_plain(x) for x in c if x.tag == _IS), None)
    v = next((x.text for x in c if x.tag == _V), None)
    if v is None:
        return None
    if kind == "s":
        return strings[int(v)]
    return ("False", "True")[v.strip() == "1"] if kind == "b" else v


class _Parts:
    """The parts of an archive. One whose directory is plain is read without zipfile, which takes most of the time of small workbooks."""

    def __init__(self, data: bytes):
        self.data, self.zip, self.at = data, None, self._plain_directory(data)
        if self.at is None:
            self.zip = zipfile.ZipFile(io.BytesIO(data))

    @staticmethod
    def _plain_directory(data: bytes) -> dict[str, tuple] | None:
        """name: (method, crc, packed, size, offset) of an archive of one file without a comment, or null where anything is unusual."""
        n = len(data) - 22
        if n < 0 or data[n : n + 4] != b"PK\5\6":
            return None
        _, disk, first, here, count, size, start, comment = _END.unpack_from(data, n)
        if disk or first or here != count or comment or start + size != n or count == 0xFFFF:
            return None
        out, p, free = {}, start, 0
        for _ in range(count):
            if p + 46 > n:
                return None
            sign, flags, method, crc, packed, whole, long, extra, note, where = _ENTRY.unpack_from(data, p)
            name = data[p + 46 : p + 46 + long]
            if sign != b"PK\1\2" or flags & ~0x806 or method not in (0, 8) or extra or note or not name.isascii() or b"\0" in name or data[p + 6] > 20 or where < free:
                return None
            free = where + 30 + long + packed
            out[name.decode()] = (method, crc, packed, whole, where)
            p += 46 + long
        return out if p == n and len(out) == count and free <= start else None

    def __contains__(self, name: str) -> bool:
        return name in (self.at if self.zip is None else self.zip.NameToInfo)

    def _zip(self) -> zipfile.ZipFile:
        self.zip = self.zip or zipfile.ZipFile(io.BytesIO(self.data))
        return self.zip

    def whole(self, name: str) -> bytes | None:
        """A small part, null if it is large or is to be read by open() for what is wrong with it."""
        if self.at is None or name not in self.at:
            return None
        method, crc, packed, size, p = self.at[name]
        if size > SMALL or packed > SMALL or self.data[p : p + 4] != b"PK\3\4" or len(self.data) < p + 30:
            return None
        long, extra = _LOCAL.unpack_from(self.data, p + 26)
        if self.data[p + 30 : p + 30 + long] != name.encode() or self.data[p + 6] & 0x20 or self.data[p + 6] & 1:
            return None
        part = self.data[p + 30 + long + extra : p + 30 + long + extra + packed]
        try:
            if method:
                d = zlib.decompressobj(-15)
                part = d.decompress(part, SMALL + 1)
                if not d.eof:
                    return None
        except zlib.error:
            return None
        return part if len(part) == size and zlib.crc32(part) == crc else None

    def read(self, name: str) -> bytes:
        part = self.whole(name)
        return self._zip().read(name) if part is None else part

    def open(self, name: str):
        return self._zip().open(name)


_END, _ENTRY, _LOCAL = struct.Struct("<4s4H2LH"), struct.Struct("<4s4x2H4x3L3H8xL"), struct.Struct("<2H")


def _strings(z: _Parts) -> list[str]:
    name, out = "xl/sharedStrings.xml", []
    if name in z:
        small = z.whole(name)
        with z.open(name) if small is None else io.BytesIO(small) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag == _SI:
                    out.append(_plain(e))
                    e.clear()
    return out


@lru_cache(256)
def _styles(part: bytes) -> tuple[list[tuple], list[int]]:
    """Borders, and for each cell format the number of its border."""
    styles, borders = ElementTree.fromstring(part), []
    for b in styles.iterfind("m:borders/m:border", _NS):
        sides = [b.find(f"m:{s}", _NS) for s in ("top", "bottom", "left", "right")]
        borders.append(tuple(None if e is None else e.get("style") for e in sides))
    return borders, [int(x.get("borderId", 0)) for x in styles.iterfind("m:cellXfs/m:xf", _NS)]


@lru_cache(256)
def _targets(rels: bytes) -> dict[str, str]:
    return {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in ElementTree.fromstring(rels).iterfind("r:Relationship", _NS)}


@lru_cache(256)
def _named(book: bytes) -> list[tuple[str, str]]:
    """Name and relationship of each sheet."""
    return [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(book).iterfind("m:sheets/m:sheet", _NS)]


def _elements(z: _Parts, name: str) -> Iterator[ElementTree.Element]:
    """Rows as they begin and cells as they end, in order; a row that has been read is dropped where the sheet is large."""
    small, root = z.whole(name), None
    if small is not None:
        try:
            root = ElementTree.fromstring(small)
        except ElementTree.ParseError:  # what stands before the error is read below
            pass
    if root is not None:
        yield from (e for e in root.iter() if e.tag == _C or e.tag == _ROW)
        return
    with z.open(name) if small is None else io.BytesIO(small) as f:
        for event, e in ElementTree.iterparse(f, ("start", "end")):
            if root is None:
                root = e
            if e.tag == _ROW:
                if event == "start":
                    yield e
                else:
                    root.clear()
            elif e.tag == _C and event == "end":
                yield e


_CELL = '<c r="{}" t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>'
_FOUND = re.compile(_CELL.format("([A-Z]+[0-9]+)", "([^<]*)"))
_FLAT = re.compile(
    '<\\?xml version="1.0" encoding="UTF-8"\\?>' + re.escape(f'<worksheet xmlns="{_MAIN}"><sheetData>')
    + '(?:<row r="[0-9]+">(?:' + _CELL.format("[A-Z]+[0-9]+", "[^<>&\x00-\x08\x0b-\x1f\ufffe\uffff]*") + ")*</row>)*</sheetData></worksheet>"
)


def _flat(part: bytes) -> list[tuple[str, str]] | None:
    """Places and texts of a sheet of texts without references to characters, as write() makes it; null for any other, which is parsed."""
    try:
        text = part.decode()
    except UnicodeDecodeError:
        return None
    return _FOUND.findall(text) if _FLAT.fullmatch(text) else None


def cells(data: bytes, sheets: set[str] | None = None, first_row: int = 1, last_row: int | None = None) -> Iterator[tuple]:
    """(sheet, sheet_idx, row, col, value, four border styles) of cells that have a value or a border, with cached values.

    sheets: only these; the others are not unpacked. Rows outside first_row to last_row are skipped. A large sheet is parsed as it is unpacked,
    a row at a time; shared strings and styles are held.
    """
    z = _Parts(data)
    strings = _strings(z)
    borders, formats = _styles(z.read("xl/styles.xml")) if "xl/styles.xml" in z else ([], [])
    targets, none = _targets(z.read("xl/_rels/workbook.xml.rels")), (None,) * 4
    for k, (sheet, rel) in enumerate(_named(z.read("xl/workbook.xml"))):
        if sheets is not None and sheet not in sheets:
            continue
        flat = _flat(small) if last_row is None and (small := z.whole(f"xl/{targets[rel]}")) is not None else None
        if flat is not None:
            edge = borders[formats[0]] if formats and formats[0] < len(borders) else none
            for ref, value in flat:
                row, col = _at(ref)
                if row >= first_row:
                    yield sheet, k, row, col, value, *edge
            continue
        row, col = 0, 0
        for e in _elements(z, f"xl/{targets[rel]}"):
            if e.tag == _ROW:
                row, col = int(e.get("r") or row + 1), 0
                if last_row is not None and row > last_row:
                    break
                continue
            row, col = _place(e.get("r"), row, col)
            style = int(e.get("s", 0))
            edge = borders[formats[style]] if style < len(formats) and formats[style] < len(borders) else none
            value = _value(e, strings)
            if row >= first_row and (value is not None or any(edge)):
                yield sheet, k, row, col, value, *edge


def _rows(doc: str, data: bytes, sheets: set[str] | None = None, first_row: int = 1, last_row: int | None = None) -> Iterator[tuple]:
    try:
        for c in cells(data, sheets, first_row, last_row):
            yield doc, *c, None
    except Exception as broken:  # whatever a damaged file makes the parsers raise
        yield doc, *[None] * 9, f"{type(broken).__name__}: {broken}"


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, ROWS)):
        yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def parse(files: DataFrame, sheet: str | None = None) -> DataFrame:
    """Cells of workbooks given as (doc string, content binary); a null content is a damaged file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = ((doc.as_py(), data.as_py()) for b in batches for doc, data in zip(b.column(0), b.column(1)))
        yield from _batches(r for doc, data in books for r in _rows(doc, data or b"", None if sheet is None else {sheet}))

    return files.select("doc", "content").mapInArrow(run, SCHEMA)


def read(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """Cells of all workbooks under path (any file system Spark reads); sheet: only that sheet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path)
    return parse(files.withColumnRenamed("path", "doc"), sheet)


# --- writing a workbook ------------------------------------------------------------------------------------------------


@lru_cache(1 << 14)
def letters(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


_ILLEGAL = re.compile("[^\\t\\n\\r\\x20-\\uD7FF\\uE000-\\uFFFD\\U00010000-\\U0010FFFF]")


def _legal(text: str) -> str:
    return text if text.isprintable() and text.isascii() else _ILLEGAL.sub("�", text)


_KINDS, _SHEETS = f"{_PACKAGE}/content-types", "application/vnd.openxmlformats-officedocument.spreadsheetml"


@lru_cache(256)
def _frame(names: tuple[str, ...]) -> list[tuple[str, bytes, int, int]]:
    """The packed parts of a workbook that only the names of its sheets decide."""
    numbers = range(1, len(names) + 1)
    files = {
        "[Content_Types].xml": f'<Types xmlns="{_KINDS}"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{_SHEETS}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_SHEETS}.worksheet+xml"/>' for k in numbers) + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{_NS["r"]}"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>'
        + "".join(f'<sheet name="{escape(_legal(n), {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(numbers, names)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_NS["r"]}">' + "".join(f'<Relationship Id="rId{k}" Type="{_OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in numbers) + "</Relationships>",
    }
    return [_packed(name, text) for name, text in files.items()]


def _packed(name: str, text: str) -> tuple[str, bytes, int, int]:
    """name, deflated text, its check sum and size; a short text needs no large window, which takes longer to set up than to fill."""
    data = ('<?xml version="1.0" encoding="UTF-8"?>' + text).encode()
    d = zlib.compressobj(6, zlib.DEFLATED, -10, 3) if len(data) <= 1024 else zlib.compressobj(6, zlib.DEFLATED, -12, 5) if len(data) <= 4096 else zlib.compressobj(6, zlib.DEFLATED, -15)
    return name, d.compress(data) + d.flush(), zlib.crc32(data), len(data)


def workbook(sheets: list[tuple[str, list[tuple[int, int, str]]]]) -> bytes:
    """A workbook of text cells: [(sheet name, [(row, col, value)])], rows and columns from 1; the same cells give the same bytes."""
    files = list(_frame(tuple(n for n, _ in sheets)))
    for k, (_, cells) in enumerate(sheets, 1):
        out, at = [], None
        for r, c, v in sorted(cells):
            if r != at:
                out.append(f'<row r="{r}">' if at is None else f'</row><row r="{r}">')
                at = r
            out.append(_CELL.format(f"{letters(c)}{r}", escape(_legal(v))))
        rows = "".join(out) + "</row>" * bool(out)
        files.append(_packed(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{_MAIN}"><sheetData>{rows}</sheetData></worksheet>'))
    if max(len(files), sum(len(p) + 200 for _, p, _, _ in files) >> 16, max(n for *_, n in files) >> 16) >= 0xFFFF:  # beyond the plain format
        return _large(files)
    body, listed, at = [], [], 0
    for name, part, crc, size in files:
        n = name.encode()
        body += (_HEAD.pack(b"PK\3\4", 20, 0, 8, 0, 33, crc, len(part), size, len(n), 0), n, part)
        listed += (_LISTED.pack(b"PK\1\2", 20, 3, 20, 0, 8, 0, 33, crc, len(part), size, len(n), 0, 0, 0, 0, 0o600 << 16, at), n)
        at += 30 + len(n) + len(part)
    directory = b"".join(listed)
    return b"".join(body) + directory + _END.pack(b"PK\5\6", 0, 0, len(files), len(files), len(directory), at, 0)


_HEAD, _LISTED = struct.Struct("<4s5H3L2H"), struct.Struct("<4s2B5H3L5H2L")


def _large(files: list[tuple[str, bytes, int, int]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, part, _, _ in files:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), zlib.decompress(part, -15), zipfile.ZIP_DEFLATED)
    return out.getvalue()


#: Bytes of workbooks of one batch.
BYTES = 4 << 20


def workbooks(rows: DataFrame) -> DataFrame:
    """(doc, content): a workbook of each doc's cells (doc, sheet_idx, sheet, row, col, value); null values are no cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, books, size = [], [], 0
        for doc, data in _each(batches):
            docs.append(doc)
            books.append(data)
            size += len(data)
            if size >= BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(books, pa.binary())], ["doc", "content"])
                docs, books, size = [], [], 0
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.string()), pa.array(books, pa.binary())], ["doc", "content"])

    return _ordered(rows).mapInArrow(run, "doc string, content binary")


_CELLS = ["doc", "sheet_idx", "sheet", "row", "col", "value"]


def _ordered(rows: DataFrame) -> DataFrame:
    r = rows.selectExpr("cast(doc as string) doc", "cast(sheet_idx as int) sheet_idx", "cast(sheet as string) sheet", "cast(row as int) row", "cast(col as int) col", "cast(value as string) value")
    return r.where("doc is not null").repartition("doc").sortWithinPartitions("doc", "sheet_idx", "sheet", "row", "col", "value")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(doc, workbook) of rows in _ordered()'s order, one workbook held at a time; of cells of one place the first stays."""
    flat = (r for b in batches for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in _CELLS)))
    for doc, rows in groupby(flat, lambda r: r[0]):
        sheets = []
        for (_, name), part in groupby(rows, lambda r: r[1:3]):
            held: dict[tuple[int, int], str] = {}
            for _, _, _, r, c, v in part:
                if v is not None:
                    held.setdefault((r, c), v)
            sheets.append((name or f"Sheet{len(sheets) + 1}", [(r, c, v) for (r, c), v in held.items()]))
        yield doc, workbook(sheets)


# --- the data source -----------------------------------------------------------------------------------------------------


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path; Spark's names of S3 are those of Arrow."""
    if "://" not in path and not path.startswith("file:"):
        path = os.path.abspath(path)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/(?=[^/])", "file:///", path)))


class Part(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class Reader(DataSourceReader):
    """A partition for some workbooks of about PART bytes together; filters on sheet and row decide what is unpacked."""

    PART = 32 << 20

    def __init__(self, path: str):
        self.path, self.sheets, self.first, self.last = path, None, 1, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name, v = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if isinstance(f, (EqualTo, In)) and name == "sheet":
                asked = set(v) if isinstance(f, In) else {v}
                self.sheets = asked if self.sheets is None else self.sheets & asked
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)) and name == "row":
                self.first = max(self.first, v + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)) and name == "row":
                v -= isinstance(f, LessThan)
                self.last = v if self.last is None else min(self.last, v)
            elif isinstance(f, EqualTo) and name == "row":
                self.first, self.last = max(self.first, v), v if self.last is None else min(self.last, v)
            yield f  # rows of damaged files are no cells, so Spark looks at every row again

    def partitions(self) -> list[Part]:
        store, root = file_system(self.path)
        info = store.get_file_info(root)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".xlsx") and "/_staging-" not in f.path)
        out, size = [], self.PART
        for p, n in files:
            if size + n > self.PART:
                out.append(Part([]))
                size = 0
            out[-1].files.append(p)
            size += n
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        for p in part.files if part else ():
            with store.open_input_file(p) as f:
                yield from _batches(_rows(unquote(os.path.basename(p).removesuffix(".xlsx")), f.read(), self.sheets, self.first, self.last))


class Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class Writer(DataSourceArrowWriter):
    """Files go to a staging folder and move to their names when all tasks are through, so a retried or failed job leaves no half file."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, f"_staging-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Staged:
        store, root = file_system(self.path)
        folder, done = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        store.create_dir(folder, recursive=True)
        for doc, data in _each(batches):
            name = quote(doc, safe="") + ".xlsx"
            with store.open_output_stream(f"{folder}/{name}") as f:
                f.write(data)
            done.append((f"{folder}/{name}", f"{root}/{name}"))
        return Staged(done)

    def commit(self, messages: list[Staged | None]) -> None:
        store, root = file_system(self.path)
        moves = [x for m in messages if m for x in m.files]
        try:
            if len({to for _, to in moves}) < len(moves):
                raise ValueError("cells of one workbook came from several tasks; write what write() prepares")
            if self.overwrite:
                for f in store.get_file_info(fs.FileSelector(root)):
                    if f.is_file and f.path.endswith(".xlsx"):
                        store.delete_file(f.path)
            for a, b in moves:
                store.move(a, b)
        finally:
            self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*file_system(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.job}")


class Workbooks(DataSource):
    """spark.read.format("workbooks").load(path), df.write.format("workbooks").save(path); doc is a file's name."""

    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """The source of workbooks, with its filters pushed down."""
    spark.dataSource.register(Workbooks)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(rows: DataFrame, path: str, mode: str = "append") -> None:
    """A workbook a doc under path: rows (doc, sheet_idx, sheet, row, col, value). append: files of other docs stay, those of the same are replaced."""
    register(rows.sparkSession)
    _ordered(rows).write.format("workbooks").mode(mode).save(path)
