"""PDF files as relations: a batch reader over binary files, and the data source "pdf".

One pass over a file yields rows of every relation; ``read`` keeps those asked for. A file that can't be read
gives one row of ``document`` with an error, and a page that can't be read in full gives what precedes the
fault, so that no file fails a job.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pagemill.sources import pdf_structure as S
from pagemill.sources.content import Page, read_page
from pagemill.sources.crypt import PasswordError
from pagemill.sources.objects import Document, box, rotation

#: The columns of each relation after ``path``.
RELATIONS = {
    "document": "n_pages int, encrypted boolean, error string, info map<string,string>, xmp binary",
    "page": "page_no int, media_box array<double>, crop_box array<double>, rotate int, null_slot boolean, text string, text_error string, n_images int",
    "glyph": "page_no int, seq long, s string, font string, font_size double, x double, y double, w double, h double, rotation double, enc_source string",
    "rect": "page_no int, seq long, min_x double, min_y double, max_x double, max_y double",
    "stroke": "page_no int, seq long, x0 double, y0 double, x1 double, y1 double",
    "image_draw": "page_no int, seq long, x double, y double, w double, h double, filter string, declared_w int, declared_h int",
    "show_string": "page_no int, seq long, s string, x double, y double",
    "object": "num int, gen int, kind string, value string, stream_length long",
    "font_use": "page_no int, seq long, name string, subtype string, embedded boolean",
    "annotation": "page_no int, ordinal int, type string, uri string, to_page int, contents string, rect array<double>",
    "outline_node": "node_id int, parent_id int, depth int, ordinal int, title string, page_no int",
    "label_range": "start int, ordinal int, prefix string, style string, st int",
    "form_field": "ordinal int, name string, ft string, ff int, v array<string>, page_no int, rect array<double>",
    "attachment": "ordinal int, key string, uf string, f string, mime string, data binary",
    "warning": "page_no int, code string, message string, detail string",
}

#: Rows of a batch on their way to the JVM.
BATCH = 10_000
#: A task of the data source reads files of about so many bytes, or so many files.
TASK_BYTES, TASK_FILES = 64 << 20, 1000


def rows(data: bytes, passwords: tuple[str, ...] = (), wanted: frozenset[str] = frozenset(RELATIONS)) -> Iterator[tuple]:
    """(relation, values...) of a file."""
    try:
        doc = Document(data, passwords)
    except PasswordError as e:
        yield "document", 0, True, f"invalid_password: {e}", {}, None
        return
    except Exception as e:  # noqa: BLE001  whatever a damaged file raises is its row's error
        yield "document", 0, None, str(e) or type(e).__name__, {}, None
        return
    n, warned = 0, set()
    names, numbers = S.named_destinations(doc), S.page_numbers(doc)
    deep = bool(wanted & {"page", "glyph", "rect", "stroke", "image_draw", "show_string", "font_use", "warning"})
    for n, page in doc.pages():
        if page is None:
            yield "page", n, None, None, 0, True, None, None, 0
            warned.add((n, "null_page", "a page slot is empty", ""))
            continue
        if deep:
            p = read_page(doc, page, geometry=bool(wanted & {"glyph", "show_string", "warning"}))
            yield "page", n, box(doc, page, "MediaBox"), box(doc, page, "CropBox"), rotation(doc, page), False, p.text, p.error, len(p.images)
            for kind, found in (("glyph", p.glyphs), ("rect", p.rects), ("stroke", p.strokes), ("image_draw", p.images), ("show_string", p.shown)):
                if kind in wanted:
                    for i, x in enumerate(found):
                        yield kind, n, i, *x
            for i, f in enumerate(p.fonts.values()):
                yield "font_use", n, n * 1000 + i, f.name, f.subtype, f.embedded
            warned |= {(n, *w) for w in p.warnings}
        if "annotation" in wanted:
            for i, a in enumerate(S.annotations(doc, page, names, numbers)):
                yield "annotation", n, i, *a
    for kind, found in (("outline_node", S.outline(doc, names, numbers)), ("label_range", S.label_ranges(doc))):
        if kind in wanted:
            for x in found:
                yield kind, *x
    for kind, found in (("form_field", lambda: S.fields(doc, numbers)), ("attachment", lambda: S.attachments(doc))):
        if kind in wanted:
            for i, x in enumerate(found()):
                yield kind, i, *x
    if "object" in wanted:
        yield from S.objects(doc)
    for w in sorted(warned | set(doc.warnings)):
        yield "warning", *w
    yield "document", n, doc.crypt is not None, None, S.info(doc), S.xmp(doc)


def _safe(data: bytes, passwords: tuple[str, ...], wanted: frozenset[str]) -> Iterator[tuple]:
    """``rows``, ended by a document row with an error if reading breaks off."""
    try:
        for r in rows(data, passwords, wanted):
            if r[0] in wanted:
                yield r
    except Exception as e:  # noqa: BLE001
        if "document" in wanted:
            yield "document", 0, None, str(e) or type(e).__name__, {}, None


def parse(files: DataFrame, relation: str, passwords: tuple[str, ...] = (), columns: tuple[str, ...] | None = None) -> DataFrame:
    """One relation of binary files (path, content), batch or streaming: path, and the columns that RELATIONS names, or only ``columns`` of them.

    Whatever isn't a PDF by its first bytes is told apart before any content reaches Python.
    """
    kind = StructType.fromDDL(f"path string, {RELATIONS[relation]}")
    if columns is not None:
        kind = StructType([kind["path"], *[kind[c] for c in columns]])
    schema = _arrow(kind)

    def run(batches):
        for batch in batches:
            paths, contents = batch.column("path").to_pylist(), batch.column("content")
            yield from _batches(((path, data.as_py() or b"") for path, data in zip(paths, contents, strict=True)), passwords, relation, schema)

    return files.select("path", "content").mapInArrow(run, kind)


def parse_drawn(files: DataFrame, relations: tuple[str, ...], passwords: tuple[str, ...] = ()) -> DataFrame:
    """Several relations that pages draw, each file read once: path, relation, and all their columns, null where a relation has none such."""
    fields = {f.name: f for r in relations for f in StructType.fromDDL(RELATIONS[r])}
    kind = StructType([*StructType.fromDDL("path string, relation string"), *fields.values()])
    schema, names = _arrow(kind), list(fields)
    own = {r: [names.index(f.name) for f in StructType.fromDDL(RELATIONS[r])] for r in relations}

    def run(batches):
        columns: list[list] = [[] for _ in schema]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for n, page in _pages(data.as_py() or b"", passwords, geometry=bool({"glyph", "show_string"} & set(relations))):
                    for r in relations:
                        found = getattr(page, DRAWN[r])
                        values = dict(zip(own[r], ([n] * len(found), range(len(found)), *zip(*found, strict=True)), strict=False))
                        for i, c in enumerate(columns):
                            c.extend([path] * len(found) if i == 0 else [r] * len(found) if i == 1 else values.get(i - 2) or [None] * len(found))
                    if len(columns[0]) >= BATCH:
                        yield _emptied(columns, schema)
        yield _emptied(columns, schema)

    return files.select("path", "content").mapInArrow(run, kind)


#: Relations whose rows are many a page, and which of a page's lists holds them.
DRAWN = {"glyph": "glyphs", "rect": "rects", "stroke": "strokes", "image_draw": "images", "show_string": "shown"}


def _emptied(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    """The columns' values as a batch; the columns are empty afterwards."""
    out = pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
    for c in columns:
        c.clear()
    return out


_BASELINE = "path string, page_no int, y double, n long, x double, last_x double, rotation double, s string, n_breaks long"


def baselines(files: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """A row for each height (to six places) at which a page of binary files (path, content) has glyphs.

    n glyphs and their text ``s`` in the order of the content, the first and last of their places, the largest turn, and how
    many separators stand there. It is what grouping the relation "glyph" gives, without a row for each glyph.
    """
    kind = StructType.fromDDL(_BASELINE)
    schema = _arrow(kind)

    def run(batches):
        columns: list[list] = [[] for _ in schema]
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                for n, page in _pages(data.as_py() or b"", passwords, geometry=True):
                    for line in _lines(page.glyphs):
                        for c, v in zip(columns, (path, n, *line), strict=True):
                            c.append(v)
                    if len(columns[0]) >= BATCH:
                        yield _emptied(columns, schema)
        yield _emptied(columns, schema)

    return files.select("path", "content").mapInArrow(run, kind)


def _lines(glyphs: list[tuple]) -> Iterator[tuple]:
    """(y, n, x, last_x, rotation, s, n_breaks) of each height; glyphs are (s, font, size, x, y, w, h, rotation, source)."""
    by_height: dict[float, list[tuple]] = {}
    for y, run in groupby(glyphs, itemgetter(4)):
        by_height.setdefault(round(y, 6) + 0.0, []).extend(run)
    for y, every in by_height.items():
        own = [g for g in every if g[8] != "separator"]
        xs = [g[3] for g in own]
        yield y, len(own), min(xs, default=None), max(xs, default=None), max([abs(g[7]) for g in every]), "".join([g[0] for g in own]), len(every) - len(own)


def _pages(data: bytes, passwords: tuple[str, ...], geometry: bool) -> Iterator[tuple[int, Page]]:
    """(page_no, what it draws) of a file's pages; a file that can't be read has none."""
    try:
        doc = Document(data, passwords)
        for n, page in doc.pages():
            if page is not None:
                yield n, read_page(doc, page, geometry)
    except Exception:  # noqa: BLE001  the document's row has the error
        return


def _batches(files_: Iterable[tuple[str, bytes]], passwords: tuple[str, ...], relation: str, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A relation of files (path, content) as record batches, filled column by column."""
    columns: list[list] = [[] for _ in schema]
    every = ["path", *[x.split()[0] for x in RELATIONS[relation].split(", ")]]
    kept = [every.index(f.name) for f in schema]
    for path, data in files_:
        if relation in DRAWN:
            for n, page in _pages(data, passwords, relation in ("glyph", "show_string")):
                if found := getattr(page, DRAWN[relation]):
                    values = ([path] * len(found), [n] * len(found), range(len(found)), *zip(*found, strict=True))
                    for c, i in zip(columns, kept, strict=True):
                        c.extend(values[i])
                if len(columns[0]) >= BATCH:
                    yield _emptied(columns, schema)
        else:
            for r in _safe(data, passwords, frozenset([relation])):
                row = (path, *r[1:])
                for c, i in zip(columns, kept, strict=True):
                    c.append(row[i])
                if len(columns[0]) >= BATCH:
                    yield _emptied(columns, schema)
    yield _emptied(columns, schema)


def _arrow(kind: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(kind)


def files(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """PDF files below a path, as binary rows; ones with another header are passed over."""
    reader = spark.readStream.schema("path string, modificationTime timestamp, length long, content binary") if stream else spark.read
    got = reader.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    head = F.decode(F.substring("content", 1, 9), "ISO-8859-1")
    return got.where(head.rlike(r"^%PDF-(1\.[0-7]|2\.0)[\x00\t\n\x0C\r ]"))


def read(spark: SparkSession, path: str, relation: str = "page", passwords: tuple[str, ...] = ()) -> DataFrame:
    """One relation of the PDF files below a path."""
    return parse(files(spark, path), relation, passwords)


class PdfDataSource(DataSource):
    """``spark.read.format("pdf").option("relation", "glyph").load(path)``; options: relation, passwords (a JSON list), path."""

    @classmethod
    def name(cls) -> str:
        return "pdf"

    def schema(self) -> str:
        return f"path string, {RELATIONS[self.options.get('relation', 'page')]}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.relation = options.get("relation", "page")
        self.passwords = tuple(json.loads(options.get("passwords", "[]")))
        self.path, self.schema = options["path"], schema

    def partitions(self):
        """Files packed into tasks by size. They are listed here; of very many, ``files`` leaves the listing to Spark."""
        from pyarrow import fs as pafs

        found, root = pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("/") else (pafs.LocalFileSystem(), self.path)
        it = found.get_file_info(root)
        listed = [it] if it.is_file else [f for f in found.get_file_info(pafs.FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".pdf")]
        out, size = [_Files([])], 0
        for f in sorted(listed, key=lambda f: f.path):
            if out[-1].paths and (size + f.size > TASK_BYTES or len(out[-1].paths) >= TASK_FILES):
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: _Files):
        from pyarrow import fs as pafs

        found = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("/") else pafs.LocalFileSystem()

        def opened():
            for path in partition.paths:
                with found.open_input_stream(path) as f:
                    yield path, f.read()

        yield from _batches(opened(), self.passwords, self.relation, _arrow(self.schema))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)
