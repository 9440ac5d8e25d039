"""PDF extraction as DataFrames: documents, pages, glyphs, lines and texts of a collection of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import page_geometry, page_spec
from ..operators import glyphs as _glyphs
from ..operators import layout as _layout
from ..sources import kernel
from .scratch import stored

#: what ``keep`` stores in one pass; the rest is asked of the kernel when it is wanted
KEPT = ("page", "run", "text", "line", "show", "font", "code")


def read_files(spark: SparkSession, paths, **options) -> DataFrame:
    """(doc_id, content) of PDF files: their paths and bytes."""
    files = spark.read.format("binaryFile").options(**options).load(paths)
    return files.select(F.col("path").alias("doc_id"), "content")


class Extraction:
    """Tables of a DataFrame of files (doc_id, content).

    Each table is one pass of the kernel over the files, and lines, texts and glyphs are made where the file is: no join
    and no shuffle but by document where pages are put together.

    pages: a page spec such as "1-3,5"; only its pages are run.  strict_spec follows the PDF specification where the
    default keeps to customary results.  mode: PERMISSIVE reports a bad file in ``docs``, FAILFAST raises.  keep: write
    the kernel's rows to the shared folder, so that several tables cost one pass over the files; glyphs are then joined
    and placed from the stored strings, fonts and codes.
    """

    def __init__(self, files: DataFrame, pages: str | None = None, strict_spec: bool = False, mode: str = "PERMISSIVE", keep: bool = False, max_decoded_bytes: int | None = None, line_tolerance_ratio: float = _layout.LINE_RATIO, line_tolerance_min: float = _layout.LINE_MIN, space_ratio: float = _layout.SPACE_RATIO, space_min: float = _layout.SPACE_MIN):
        self.files, self.spec, self.strict, self.mode, self.keep, self.limit = files, pages or None, strict_spec, mode, keep, max_decoded_bytes
        self.line = {"line_ratio": line_tolerance_ratio, "line_min": line_tolerance_min}
        self.space = {"space_ratio": space_ratio, "space_min": space_min}
        self._kept = None

    def _rows(self, *want) -> DataFrame:
        """The kernel's rows with what is wanted: the stored ones if they have it."""
        if self.keep and set(want) <= set(KEPT):
            if self._kept is None:
                self._kept = stored(self._run(KEPT), "pdf")
            return self._kept
        return self._run(want)

    def _run(self, want):
        return kernel.run(self.files, want=want, pages=self.spec, strict=self.strict, mode=self.mode, limit=self.limit, options=self.line | self.space)

    def _table(self, kind, *want) -> DataFrame:
        return self._rows(*want).where(F.col("kind") == kind).select("doc_id", f"{kind}.*")

    def _order(self, page: str = "") -> Column:
        """Place of a page among those that the spec picks."""
        index = F.col(f"{page}page_index")
        if self.spec is None:
            return index
        return (F.array_position(page_spec(F.lit(self.spec), F.col(f"{page}page_count")), index) - 1).cast("int")

    # ------------------------------------------------------------ tables

    def docs(self) -> DataFrame:
        """A row for each file: version, n_objects, page_count, declared_count, leaf_count, repaired, error_class, error_msg."""
        return self._table("doc")

    def xref(self) -> DataFrame:
        """Cross-references of each file: the newest of a number wins."""
        return merged_xref(self.xref_sections())

    def xref_sections(self) -> DataFrame:
        return self._table("xref", "xref")

    def page_nodes(self) -> DataFrame:
        return self._table("node", "node")

    def pages(self) -> DataFrame:
        """A row for each page: page_index, page_no, width, height, rotation, ctm, error_msg, order."""
        shape = page_geometry(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), F.col("rotate"))
        rows = self._table("page", "run").withColumn("shape", shape)
        return rows.select("doc_id", "page_index", (F.col("page_index") + 1).alias("page_no"), "shape.*", "error_msg", self._order().alias("order"))

    def contents(self) -> DataFrame:
        """(doc_id, page_index, content): decoded page content."""
        return self._table("page", "content").select("doc_id", "page_index", "content")

    def shows(self) -> DataFrame:
        return self._table("show", "show")

    def fonts(self) -> DataFrame:
        return self._table("font", "font")

    def font_codes(self) -> DataFrame:
        """(doc_id, font_key, idx, code, text, width) of the codes that are used."""
        return _glyphs.decoded_codes(self._table("code", "code"), self.fonts())

    def glyphs(self, numbered: bool = True) -> DataFrame:
        """A row for each positioned glyph; without ``numbered`` its ``seq`` need only have the order."""
        if not self.keep:
            return self._table("glyph", "glyph")
        return _glyphs.glyphs(self.shows(), self._table("code", "code"), self.fonts(), rise=self.strict, numbered=numbered)

    def lines(self) -> DataFrame:
        """A row for each line: (doc_id, page_index, line_no, y, x, end_x, size, fonts, n_chars, text), from the top down."""
        return self._table("line", "line")

    def page_texts(self) -> DataFrame:
        """(doc_id, page_index, order, text, n_lines, n_chars) for every page, those without text, too."""
        return self._table("page", "text").select("doc_id", "page_index", self._order().alias("order"), F.coalesce("text", F.lit("")).alias("text"), "n_lines", "n_chars")

    def page_layouts(self) -> DataFrame:
        """(doc_id, page_index, order, layout) for every page, made where the file is; null without glyphs."""
        return self._table("page", "layout").select("doc_id", "page_index", self._order().alias("order"), "layout")

    def layout_texts(self) -> DataFrame:
        return self.page_layouts().fillna({"layout": ""})

    # ------------------------------------------------------------ outputs

    def _documents(self, *of_pages, want=("text",)) -> DataFrame:
        """A row for each good file: ``doc`` and aggregates of its pages, in one pass and one shuffle."""
        rows = self._rows(*want).where("kind IN ('doc', 'page')")
        return rows.groupBy("doc_id").agg(F.max("doc").alias("doc"), *of_pages).where("doc.version IS NOT NULL AND doc.error_class IS NULL")

    def texts(self, separator: str = "\n\f") -> DataFrame:
        """(doc_id, text): pages joined; a file without pages has an empty text."""
        page = F.when(F.col("kind") == "page", F.struct(self._order("page.").alias("o"), F.coalesce("page.text", F.lit("")).alias("t")))
        text = F.array_join(F.transform(F.array_sort(F.collect_list(page)), lambda r: r["t"]), separator)
        return self._documents(text.alias("text")).select("doc_id", "text")

    def layouts(self, separator: str = "\n\f") -> DataFrame:
        text = self.layout_texts().groupBy("doc_id").agg(_layout.joined("order", "layout", separator).alias("text"))
        good = self.docs().where("error_class IS NULL").select("doc_id")
        return good.join(text, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def stats(self) -> DataFrame:
        """(doc_id, version, n_objects, page_count, processed, chars, pages_with_text, scanned) of each good file."""
        n = F.col("page.n_chars")
        out = self._documents(F.count("page").alias("processed"), F.coalesce(F.sum(n), F.lit(0)).alias("chars"), F.count_if(n > 0).alias("pages_with_text"))
        out = out.select("doc_id", "doc.version", "doc.n_objects", "doc.page_count", "processed", "chars", "pages_with_text")
        return out.withColumn("scanned", (F.col("pages_with_text") == 0) & (F.col("processed") > 0))

    def json(self) -> DataFrame:
        """(doc_id, json): file, version, repaired and pages with size, rotation, glyph count, lines and text."""
        short = lambda c, name: F.bround(c, 2).alias(name)
        rows = self._rows("line", "text").where("kind IN ('doc', 'page', 'line')").repartition("doc_id")  # both groupings need no more
        line = F.struct("line.line_no", short("line.y", "y"), short("line.x", "x"), short("line.size", "size"), "line.text")
        of_page = rows.groupBy("doc_id", F.coalesce("page.page_index", "line.page_index").alias("n")).agg(
            F.max("doc").alias("doc"),
            F.max(F.when(F.col("kind") == "page", F.struct("page.page_index", "page.x0", "page.y0", "page.x1", "page.y1", "page.rotate", "page.page_count", "page.text", "page.n_chars"))).alias("page"),
            F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "line", line))), lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x"), s["size"].alias("size"), s["text"].alias("text"))).alias("lines"),
        )
        shape = page_geometry(*(F.col(f"page.{c}") for c in ("x0", "y0", "x1", "y1", "rotate")))
        shaped = of_page.withColumn("shape", shape)
        page = F.struct(
            self._order("page.").alias("order"), (F.col("n") + 1).alias("page"), short("shape.width", "width"), short("shape.height", "height"), F.col("shape.rotation").alias("rotation"),
            F.col("page.n_chars").alias("chars"), "lines", F.coalesce("page.text", F.lit("")).alias("text"),
        )
        listed = shaped.groupBy("doc_id").agg(F.max("doc").alias("doc"), F.transform(F.array_sort(F.collect_list(F.when(F.col("page").isNotNull(), page))), lambda p: p.dropFields("order")).alias("pages"))
        good = listed.where("doc.version IS NOT NULL AND doc.error_class IS NULL")
        return good.select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("file"), "doc.version", "doc.repaired", "pages")).alias("json"))

    def create_views(self, prefix: str = "pdf_") -> None:
        """Temporary views of the main tables, for SQL."""
        for name in ("docs", "pages", "fonts", "glyphs", "lines", "page_texts"):
            getattr(self, name)().createOrReplaceTempView(prefix + name)


def merged_xref(sections: DataFrame, keys=("doc_id", "num")) -> DataFrame:
    """One entry a number: that of the newest section."""
    entry = [c for c in sections.columns if c not in (*keys, "section")]
    return sections.groupBy(*keys).agg(F.min_by(F.struct(*entry), "section").alias("e")).select(*keys, "e.*")


def extract(source, spark: SparkSession | None = None, **options) -> Extraction:
    """An extraction of paths (with ``spark``), bytes (with ``spark``) or a DataFrame (doc_id, content)."""
    if isinstance(source, DataFrame):
        return Extraction(source, **options)
    if isinstance(source, (bytes, bytearray)):
        return Extraction(spark.createDataFrame([("bytes", bytearray(source))], "doc_id string, content binary"), **options)
    return Extraction(read_files(spark, source), **options)


def extract_text(source, spark: SparkSession | None = None, separator: str = "\n\f", **options) -> DataFrame:
    return extract(source, spark, **options).texts(separator)


def extract_pages(source, spark: SparkSession | None = None, **options) -> DataFrame:
    return extract(source, spark, **options).page_texts()


def document_page(source, index: int, spark: SparkSession | None = None, **options) -> DataFrame:
    """One page's glyphs; asks for a page that is there."""
    found = extract(source, spark, pages=str(index + 1), **options)
    if index < 0 or found.docs().where((F.col("page_count") > index) & F.col("error_class").isNull()).limit(1).count() == 0:
        raise IndexError(f"page {index} is not there")
    return found.glyphs()


__all__ = ["Column", "Extraction", "document_page", "extract", "extract_pages", "extract_text", "merged_xref", "read_files"]
