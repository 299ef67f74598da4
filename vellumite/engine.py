"""The engine: options, page layouts, and four verbs from DataFrame to DataFrame.

    engine = Engine.plain().with_(lists=False)
    models = engine.read_html(pages)             # a row of vellumite.model.SCHEMA a document
    packages = engine.write_docx(models)         # doc_id, docx
    html = engine.write_html(engine.read_docx(packages))

Every verb is lazy, works document by document without a shuffle, and never fails for one document: that one has
an `error`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vellumite import model
from vellumite.kernels import images, stack, user_agent
from vellumite.kernels.styles import Style
from vellumite.kernels.units import colour
from vellumite.sources.docx import MOST_ENTRY, MOST_TOTAL

TWIPS_PER_INCH, TWIPS_PER_MM = 1440, 1440 / 25.4
# Paper sizes in millimetres and inches, editor profiles and their other names.
PAPER_MM = {"a4": (210.0, 297.0)}
PAPER_IN = {"letter": (8.5, 11.0)}
EDITORS = {"plain": ("plain", "none", "html"), "suneditor": ("suneditor", "sun"), "ckeditor": ("ckeditor", "ck", "ckeditor5"), "tinymce": ("tinymce", "tiny"), "tiptap": ("tiptap", "prosemirror")}


def _twips(value: float, per: float) -> int:
    return int(value * per + 0.5)


@dataclass(frozen=True)
class PageLayout:
    """Page size and margins in twips."""

    width: int
    height: int
    top: int = TWIPS_PER_INCH
    right: int = TWIPS_PER_INCH
    bottom: int = TWIPS_PER_INCH
    left: int = TWIPS_PER_INCH

    def __post_init__(self) -> None:
        if min(self.width, self.height) <= 0 or min(self.top, self.right, self.bottom, self.left) < 0 or self.content_width <= 0 or self.top + self.bottom >= self.height:
            raise ValueError("the margins leave no room on the page")

    @property
    def content_width(self) -> int:
        return self.width - self.left - self.right

    @property
    def landscape(self) -> bool:
        return self.width > self.height

    @classmethod
    def paper(cls, name: str, landscape: bool = False, **margins_mm: float) -> PageLayout:
        """A paper by name, upright or on its side; margins in millimetres."""
        key = name.lower()
        if key in PAPER_MM:
            size = [_twips(x, TWIPS_PER_MM) for x in PAPER_MM[key]]
        elif key in PAPER_IN:
            size = [_twips(x, TWIPS_PER_INCH) for x in PAPER_IN[key]]
        else:
            raise ValueError(f"unknown paper {name!r}")
        if landscape:
            size.reverse()
        return cls(*size, **{side: _twips(mm, TWIPS_PER_MM) for side, mm in margins_mm.items()})

    def sides(self) -> dict[str, int]:
        return {k: getattr(self, k) for k in ("width", "height", "top", "right", "bottom", "left")}


def editor_profile(name: str) -> str:
    """A profile by its name or one of its other names."""
    for profile, names in EDITORS.items():
        if name.strip().lower() in names:
            return profile
    raise ValueError(f"unknown editor {name!r}")


@dataclass(frozen=True)
class Options:
    """What a conversion keeps and how it is written."""

    editor: str = "plain"
    page: PageLayout = field(default_factory=lambda: PageLayout.paper("A4"))
    title: str | None = None
    author: str | None = None
    language: str | None = None
    created: str = "1980-01-01T00:00:00Z"
    base_font: str = "Calibri"
    base_size_pt: float = 11.0
    base_color: str = "#000000"
    default_stylesheet: str | None = None  # in place of the editor's
    base_stylesheet: str = ""  # between the default and the page's own
    full_page: bool = False
    id_prefix: str = ""
    images: bool = True
    tables: bool = True
    lists: bool = True
    links: bool = True
    formulas: bool = True
    notes: bool = True
    comments: bool = True
    furniture: bool = True
    hidden_text: bool = False
    bare_references: bool = True  # in HTML, also without their semicolon, as the standard has it
    any_depth: bool = False  # HTML is read and written as deep as it is nested, beyond Python's recursion limit
    most_entry_bytes: int = MOST_ENTRY
    most_total_bytes: int = MOST_TOTAL

    def __post_init__(self) -> None:
        object.__setattr__(self, "editor", editor_profile(self.editor))
        if self.base_size_pt <= 0:
            raise ValueError("the base size must be positive")
        if colour(self.base_color) is None:
            raise ValueError(f"no colour: {self.base_color!r}")
        if min(self.most_entry_bytes, self.most_total_bytes) <= 0:
            raise ValueError("limits must be positive")

    def switched_off(self) -> set[str]:
        """What the feature filter leaves out."""
        return {k for k in ("images", "tables", "lists", "links", "formulas", "notes", "comments", "furniture") if not getattr(self, k)}

    def sheet(self) -> str:
        return user_agent.sheet(self.editor) if self.default_stylesheet is None else self.default_stylesheet

    def base(self) -> Style:
        return Style(family=self.base_font, size=self.base_size_pt, root_size=self.base_size_pt, color=colour(self.base_color) or "000000")


#: A failure that belongs to one document.
_FAILURES = (ValueError, LookupError, TypeError, AttributeError, ArithmeticError, RecursionError, OSError)


def failure(e: BaseException) -> dict:
    """{kind, message}: malformed, too_large, too_deep or unreadable."""
    kind = "too_deep" if isinstance(e, RecursionError) else "unreadable" if isinstance(e, OSError) else getattr(e, "kind", "malformed")
    return {"kind": kind, "message": str(e)[:500] or type(e).__name__}


def _failed_before(given: DataFrame) -> Column:
    """The `error` that a verb gave, as a column; null where none did."""
    kind = given.schema["error"].dataType if "error" in given.columns else None
    own = isinstance(kind, StructType) and kind.names == ["kind", "message"]
    return (F.col("error") if own else F.lit(None).cast("struct<kind: string, message: string>")).alias("error")


@dataclass(frozen=True)
class Engine:
    """Immutable; every change gives a new engine."""

    options: Options = field(default_factory=Options)
    image_folder: str | None = None
    remote_images: Callable[[str], bytes | None] | None = None
    image_resolver: Callable[[str], bytes | None] | None = None
    image_handler: Callable[[dict, str], str | None] | None = None

    @classmethod
    def plain(cls) -> Engine:
        return cls()

    @classmethod
    def for_editor(cls, name: str) -> Engine:
        return cls(Options(editor=name))

    def with_(self, **changes) -> Engine:
        return replace(self, options=replace(self.options, **changes))

    def with_images(self, folder: str | None = None, remote: Callable | None = None, resolver: Callable | None = None, handler: Callable | None = None) -> Engine:
        """Where pictures come from (files below a folder, a fetcher for http, or a resolver for all) and where they go (a handler that gives a source, or null to drop it)."""
        return replace(self, image_folder=folder, remote_images=remote, image_resolver=resolver, image_handler=handler)

    def _builder(self) -> Callable[[str | None], dict]:
        """A page's nested model."""
        from vellumite.kernels.build import Builder

        o = self.options
        options = {"base": o.base(), "sheet": o.sheet(), "base_sheet": o.base_stylesheet, "page_width": o.page.content_width, "picture": self.image_resolver or images.resolver(self.image_folder, self.remote_images), "title": o.title, "author": o.author, "language": o.language, "created": o.created, "bare_references": o.bare_references}
        return lambda html: Builder(html, options).build()

    def _package_reader(self) -> Callable[[bytes | None], dict]:
        """A package's nested model."""
        from vellumite.kernels.word_read import read_package

        o = self.options
        options = {"hidden_text": o.hidden_text, "furniture": o.furniture, "comments": o.comments, "limits": {"most_entry": o.most_entry_bytes, "most_total": o.most_total_bytes}}
        return lambda data: read_package(data or b"", options)

    def read_html(self, pages: DataFrame, doc_id: str = "doc_id", column: str = "html") -> DataFrame:
        """Models of pages; a null page is an empty document, and what write_html failed at keeps its `error`."""
        o, schema, build, layout = self.options, model.arrow_schema(), self._builder(), self.options.page.sides()

        def one(key: int | None, html: str | None, failed: dict | None) -> dict:
            if failed is not None:
                return {"doc_id": key, "error": failed}
            try:
                # A tag begins an element or two, each of a few calls.
                frames = stack.FRAMES + 16 * (html or "").count("<") if o.any_depth else 0
                return stack.with_frames(lambda: model.to_row(key, {**build(html), "layout": layout}), frames)
            except _FAILURES as e:
                return {"doc_id": key, "error": failure(e)}

        def run(batches):
            for b in batches:
                yield from model.batches((one(*(x.as_py() for x in row)) for row in zip(*b.columns)), schema)

        found = pages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("html"), _failed_before(pages)).mapInArrow(run, model.SCHEMA)
        return model.filtered(found, o.switched_off())

    def read_docx(self, packages: DataFrame, doc_id: str = "doc_id", column: str = "docx") -> DataFrame:
        """Models of Word packages."""
        o, schema, read = self.options, model.arrow_schema(), self._package_reader()

        def one(key: int | None, data: bytes | None) -> dict:
            try:
                return model.to_row(key, read(data))
            except _FAILURES as e:
                return {"doc_id": key, "error": failure(e)}

        def run(batches):
            for b in batches:
                yield from model.batches((one(k.as_py(), v.as_py()) for k, v in zip(b.column(0), b.column(1))), schema)

        found = packages.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(column).alias("docx")).mapInArrow(run, model.SCHEMA)
        return model.filtered(found, o.switched_off())

    def read_model(self, models: DataFrame) -> DataFrame:
        """Models made by hand (rows of vellumite.model.SCHEMA), through the feature filter."""
        return model.filtered(models, self.options.switched_off())

    def write_html(self, models: DataFrame) -> DataFrame:
        """(doc_id, html, warnings, error) of models."""
        from vellumite.kernels.html_write import Writer, full_page

        o = self.options
        options = {"base": o.base(), "sheet": o.sheet(), "plain": o.editor == "plain", "editor": o.editor, "page_width": o.page.content_width, "picture": self.image_handler, "prefix": o.id_prefix}
        schema = pa.schema([("doc_id", pa.int64()), ("html", pa.string()), ("warnings", pa.list_(pa.string())), ("error", pa.struct([("kind", pa.string()), ("message", pa.string())]))])

        def one(row: dict) -> dict:
            if row["error"] is not None:
                return {"doc_id": row["doc_id"], "error": row["error"]}
            try:
                frames = stack.FRAMES + 16 * len(row["blocks"] or ()) if o.any_depth else 0
                made = stack.with_frames(lambda: model.from_row(row), frames)
                layout = made["layout"]
                width = layout["width"] - layout["left"] - layout["right"] if layout else options["page_width"]
                html, warnings = stack.with_frames(lambda: Writer(made, {**options, "page_width": width}).write(), frames)
                if o.full_page:
                    meta = {k: getattr(o, k, None) or made["meta"].get(k) for k in ("title", "author", "language")}
                    html = full_page(html, meta, "" if options["plain"] else o.sheet() + o.base_stylesheet)
                return {"doc_id": row["doc_id"], "html": html, "warnings": warnings}
            except _FAILURES as e:
                return {"doc_id": row["doc_id"], "error": failure(e)}

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    # One model at a time is Python objects: a long one is some hundred times its text.
                    rows = [one(b.slice(k, 1).to_pylist()[0]) for k in range(at, min(at + 64, b.num_rows))]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return models.mapInArrow(run, "doc_id long, html string, warnings array<string>, error struct<kind: string, message: string>")

    def write_docx(self, models: DataFrame) -> DataFrame:
        """(doc_id, docx, error) of models; equal models and options give equal bytes."""
        from vellumite.kernels.word_write import Writer

        options = {"layout": self.options.page.sides(), "created": self.options.created}
        schema = pa.schema([("doc_id", pa.int64()), ("docx", pa.binary()), ("error", pa.struct([("kind", pa.string()), ("message", pa.string())]))])

        def one(row: dict) -> dict:
            if row["error"] is not None:
                return {"doc_id": row["doc_id"], "error": row["error"]}
            try:
                return {"doc_id": row["doc_id"], "docx": Writer(model.from_row(row), options).write()}
            except _FAILURES as e:
                return {"doc_id": row["doc_id"], "error": failure(e)}

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    # One model at a time is Python objects: a long one is some hundred times its text.
                    rows = [one(b.slice(k, 1).to_pylist()[0]) for k in range(at, min(at + 64, b.num_rows))]
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

        return models.mapInArrow(run, "doc_id long, docx binary, error struct<kind: string, message: string>")

    def docx_texts(self, pages: DataFrame, doc_id: str = "doc_id", column: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
        """(doc_id, `keep`, after, error): the text of read_docx(write_docx(read_html(pages))), paragraphs joined by line feeds.

        A document goes through its model and its package in one kernel, so neither becomes rows, and the columns of `keep`
        go along, so nothing is joined. The feature filter is one of rows: with features switched off the three verbs are for it.
        """
        from vellumite.kernels.word_write import Writer

        if self.options.switched_off():
            raise ValueError("docx_texts has no feature filter")
        build, read, layout, whole = self._builder(), self._package_reader(), self.options.page.sides(), model.whole_rows(model.arrow_schema())
        options = {"layout": layout, "created": self.options.created}
        given = pages.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.col(column).alias("_html"))
        schema = StructType([*given.schema.fields[:-1], *StructType.fromDDL("after string, error struct<kind: string, message: string>")])
        failed = pa.struct([("kind", pa.string()), ("message", pa.string())])

        def one(html: str | None) -> tuple[str | None, dict | None]:
            try:
                made = whole(model.to_row(None, {**build(html), "layout": layout}))
                return model.plain_text(model.to_row(None, read(Writer(model.from_row(made), options).write()))), None
            except _FAILURES as e:
                return None, failure(e)

        def run(batches):
            for b in batches:
                for at in range(0, b.num_rows, 64):
                    part = b.slice(at, 64)
                    got = [one(x.as_py()) for x in part.column(part.num_columns - 1)]
                    yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], failed)], names=schema.names)

        return given.mapInArrow(run, schema)

    def save(self, made: DataFrame, path: str) -> DataFrame:
        """Writes each document's html or docx to a file of its own below `path` (a URI that all executors reach); (doc_id, file, bytes, error).

        A file is written beside its name and renamed when whole, so a repeated task leaves whole files.
        """
        column, end = ("docx", "docx") if "docx" in made.columns else ("html", "html")
        return made.select("doc_id", F.col(column).cast("binary").alias("content")).mapInArrow(_saver(path, end), "doc_id long, file string, bytes long, error string")


def _saver(path: str, end: str):
    def run(batches):
        import uuid

        from pyarrow import fs

        store, folder = fs.FileSystem.from_uri(path)
        store.create_dir(folder, recursive=True)
        for b in batches:
            rows = []
            for key, content in zip(b.column(0).to_pylist(), b.column(1)):
                if not content.is_valid:
                    rows.append({"doc_id": key, "error": "nothing to write"})
                    continue
                name, attempt = f"{key}.{end}", f"{folder}/.{uuid.uuid4().hex}"
                try:
                    with store.open_output_stream(attempt) as out:
                        out.write(content.as_buffer())
                    store.move(attempt, f"{folder}/{name}")
                    rows.append({"doc_id": key, "file": name, "bytes": len(content.as_buffer())})
                except OSError as e:
                    rows.append({"doc_id": key, "error": str(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("bytes", pa.int64()), ("error", pa.string())]))

    return run
