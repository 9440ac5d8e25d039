"""``spark.read.format("pdf")``: tables of PDF files as a data source, and table functions over bytes.

Options: ``path`` (a file, folder or list separated by commas, in any store that pyarrow knows; ``plans.extract.read_files``
reads from stores that only Spark knows), ``table`` (docs, pages, lines, glyphs, shows, fonts or xref), ``strict``, ``mode``, ``pushdown``.  With ``pushdown`` filters on ``page_index`` reach the
reader, which runs only the pages asked for; Spark wants spark.sql.python.filterPushdown.enabled for that.
"""

from __future__ import annotations

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition
from pyspark.sql.functions import udtf

from . import kernel
from .syntax import tokenize

TABLES = {"docs": "doc", "pages": "page", "lines": "line", "glyphs": "glyph", "shows": "show", "fonts": "font", "xref": "xref"}


class PdfSource(DataSource):
    @classmethod
    def name(cls):
        return "pdf"

    def _kind(self):
        return TABLES[self.options.get("table", "pages")]

    def schema(self):
        fields, depth, name = [], 0, True
        for c in kernel.KINDS[self._kind()].removeprefix("struct<").removesuffix(">"):
            depth += (c == "<") - (c == ">")
            if c == ":" and depth == 0 and name:  # "a: int" of a struct is "a int" of a table
                name = False
                continue
            name = name or c == "," and depth == 0
            fields.append(c)
        return "doc_id string, " + "".join(fields)

    def reader(self, schema):
        wants = self.options.get("pushdown", "false").lower() == "true"
        return (FilteringPdfReader if wants else PdfReader)(dict(self.options), self._kind())


class OneFile(InputPartition):
    def __init__(self, uri):
        super().__init__(uri)
        self.uri = uri


class PdfReader(DataSourceReader):
    def __init__(self, options, kind):
        self.options, self.kind, self.pages = options, kind, None

    def partitions(self):
        from pyarrow import fs

        out = []
        for path in self.options["path"].split(","):
            store, where = fs.FileSystem.from_uri(path.strip()) if "://" in path else (fs.LocalFileSystem(), path.strip())
            scheme = path.partition("://")[0] + "://" if "://" in path else "file://"
            info = store.get_file_info(where)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(where, recursive=True))
            out += [OneFile(scheme + f.path) for f in found if f.type == fs.FileType.File]
        return out

    def read(self, partition):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.uri)
        with store.open_input_file(path) as f:
            data = f.read()
        try:
            for kind, values in kernel.rows(data, {self.kind, "run"} if self.kind == "page" else {self.kind}, self.pages, self.options.get("strict", "").lower() == "true"):
                if kind != self.kind:
                    continue
                if kind in kernel.COLUMNS:
                    for row in zip(*(v.tolist() if hasattr(v, "tolist") else v for v in values)):
                        yield (partition.uri, *row)
                else:
                    yield (partition.uri, *values)
        except Exception as e:
            if self.options.get("mode", "PERMISSIVE").upper() == "FAILFAST":
                raise
            if self.kind == "doc":  # nothing else of it has come, as its row is the last
                yield (partition.uri, *(None,) * 6, type(e).__name__, str(e))


class FilteringPdfReader(PdfReader):
    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("page_index",):
                asked = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.pages = asked if self.pages is None else self.pages & asked
            yield f  # Spark filters again, which does no harm


@udtf(returnType="kind string, value string")
class PdfTokens:
    """Tokens of a piece of PDF syntax."""

    def eval(self, content: bytes):
        for kind, value in tokenize(bytes(content or b"")):
            shown = value.decode("latin-1") if isinstance(value, bytes) else None if value is None else str(value)
            yield kind, shown


@udtf(returnType="page_index int, width double, height double, rotation int, n_shows bigint, error_msg string")
class PdfPages:
    """Pages of one document's bytes; none if it cannot be read."""

    def eval(self, content: bytes):
        shows, pages = {}, []
        try:
            for kind, v in kernel.rows(bytes(content or b""), {"page", "show"}):
                if kind == "show":
                    shows[v[0]] = shows.get(v[0], 0) + 1
                elif kind == "page":
                    pages.append(v)
        except Exception:
            return
        for index, x0, y0, x1, y1, rotate, error, *_ in pages:
            w, h, turn, _ = kernel.geometry(None if x0 is None else (x0, y0, x1, y1), rotate)
            yield index, w, h, turn, shows.get(index, 0), error


@udtf(returnType="page_index int, seq bigint, run_id bigint, text string, font_name string, font_size double, x double, y double")
class PdfShows:
    """Shown strings of one document's bytes, with where their run begins."""

    def eval(self, content: bytes):
        from .document import times

        shows, texts = [], {}
        try:
            for kind, v in kernel.rows(bytes(content or b""), {"show"}):
                if kind == "show" and v[4] is not None:
                    shows.append(v)
                elif kind == "code":
                    texts.setdefault(v[0], {})[v[1]] = v[3] if v[3] is not None else v[4]
        except Exception:
            return
        for v in shows:
            m = times(v[13], v[14])
            yield v[0], v[1], v[2], "".join(texts.get(v[6], {}).get(i) or "" for i in v[4]) or v[3].decode("latin-1"), v[7], v[8], m[4], m[5]


def register(spark):
    """Makes the data source and the table functions pdf_tokens, pdf_pages and pdf_shows known to a session."""
    spark.dataSource.register(PdfSource)
    for name, f in {"pdf_tokens": PdfTokens, "pdf_pages": PdfPages, "pdf_shows": PdfShows}.items():
        spark.udtf.register(name, f)
