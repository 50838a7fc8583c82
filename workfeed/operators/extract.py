"""Text extraction: HTML, office and plain files to text, links, and chunks.

HTML and office files have no native reader, so they go through mapInPandas; cleaning,
limits and everything around it are native columns. Errors are values in a column.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import islice
from typing import BinaryIO
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_text, cut_bytes, text_format, without_invalid
from ..schema import struct

#: Elements without text, elements that break lines, and elements that an opening tag ends. Fixed values.
SKIPPED = set("script style head title noscript iframe object template svg".split())
BLOCKS = set(
    "p div li ul ol dl dt dd tr table thead tbody h1 h2 h3 h4 h5 h6 blockquote pre section article header footer nav aside form figure figcaption hr main address fieldset legend".split()
)
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FILE_IN_PATH = re.compile(r"/files/(\d+)")


def tidy(s: str) -> str:
    s = re.sub(r"[ \t\f\v]+\n", "\n", s.replace(" ", " "))
    s = re.sub(r"\n{3,}", "\n\n", s)
    return "\n".join(x.rstrip(" \t") for x in s.split("\n")).strip()


class _Reader(HTMLParser):
    """Writes text to the innermost of `out`; a link collects its own first."""

    def __init__(self, amp: str = ""):
        """amp: what stands for an & that is text, if anything does."""
        super().__init__(convert_charrefs=True)
        self.amp = amp
        self.out: list[list[str]] = [[]]
        self.open: list[str] = []
        self.lists: list[list] = []
        self.skip = self.pre = 0
        self.hrefs: list[tuple[str, str]] = []
        self.links: list[tuple[str, str, str]] = []

    @property
    def tail(self) -> str:
        return next((x for x in reversed(self.out[-1]) if x), "")

    def newline(self) -> None:
        if self.tail and not self.tail.rstrip(" \t").endswith("\n"):
            self.out[-1].append("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += tag not in VOID
            return
        if self.skip:
            return
        given = {k: self.plain(v or "") for k, v in attrs}
        if tag in BLOCKS and tag not in ("tr", "li", "dt", "dd") and "p" in self.open:
            self.end("p")
        for old in ENDS.get(tag, ()):
            self.close_within(old, {"li": ("ul", "ol"), "dt": ("dl",), "dd": ("dl",)}.get(tag, ("table",)))
        if tag == "br":
            self.out[-1].append("\n")
        elif tag == "img":
            if alt := given.get("alt", "").strip():
                self.out[-1].append(f"[image: {alt}]")
        elif tag not in VOID:
            self.open.append(tag)
        if tag == "a":
            self.hrefs.append((given.get("href", "").strip(), given.get("data-api-endpoint", "")))
            self.out.append([])
        elif tag in BLOCKS:
            self.newline()
        if tag in ("ul", "ol"):
            self.lists.append([tag == "ol", 0])
        elif tag == "li":
            numbered = bool(self.lists) and self.lists[-1][0]
            if numbered:
                self.lists[-1][1] += 1
            self.out[-1].append(f"{self.lists[-1][1]}. " if numbered else "- ")
        elif tag == "pre":
            self.pre += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif not self.skip and tag in self.open:
            self.end(tag)

    def close_within(self, tag: str, limits: tuple) -> None:
        for name in reversed(self.open):
            if name in limits:
                return
            if name == tag:
                self.end(tag)
                return

    def end(self, tag: str) -> None:
        while self.open:
            top = self.open.pop()
            if top == "a":
                self.link()
            elif top in ("td", "th"):
                self.out[-1].append("\t")
            elif top in BLOCKS:
                self.newline()
            if top in ("ul", "ol"):
                self.lists.pop()
            elif top == "pre":
                self.pre -= 1
            if top == tag:
                return

    def link(self) -> None:
        text = tidy("".join(self.out.pop()))
        href, data = self.hrefs.pop()
        absolute = href.lower().startswith(("http://", "https://"))
        shown = re.sub("^https?://", "", href.rstrip("/").lower())
        same = text.rstrip("/").lower() in (href.rstrip("/").lower(), shown)
        if href:
            found = FILE_IN_PATH.search(href) or FILE_IN_PATH.search(data)
            self.links.append((href, text, found[1] if found else ""))
        self.out[-1].append(f"{text} ({href})" if text and absolute and not same else text or (href if absolute else ""))

    def plain(self, text: str) -> str:
        return text.replace(self.amp, "&") if self.amp else text

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        data = self.plain(data)
        if not self.pre:
            data = re.sub("[ \t\f\v ]+", " ", re.sub("\r\n?|\n", " ", data))
            if not self.tail or self.tail.endswith("\n"):
                data = data.lstrip(" ")
        if data:
            self.out[-1].append(data)

    def finish(self) -> str:
        self.end("")
        return tidy("".join(self.out[0]))


#: Characters of private use, of which one stands for a < that is text, and one for an &.
MARKS = [chr(c) for c in range(0xE000, 0xF900)]
_SPECIAL = re.compile("[<>\"']")


def open_ends(html: str) -> list[int]:
    """The places of each < whose tag never ends, as no > follows it outside of quotes; in one pass from the end.

    A tokenizer looks for that > to the end of the text again and again, once for each.
    """
    last = html.rfind(">")
    found = []
    # Whether a tag that is open here ends; and whether it would behind the next quote of a kind.
    ends = False
    behind = {'"': False, "'": False}
    for m in reversed(list(_SPECIAL.finditer(html))):
        c, at = m[0], m.start()
        if c == ">":
            ends = True
        elif c != "<":
            ends, behind[c] = behind[c], ends
        elif html.startswith("<!--", at):
            continue
        elif html.startswith(("<!", "<?"), at):
            if at > last:
                found.append(at)
        elif not ends:
            found.append(at)
    return found[::-1]


def marked_open_ends(html: str, mark: str) -> str:
    """html with a mark in place of each < of open_ends()."""
    places = open_ends(html)
    if not places:
        return html
    parts = [html[a + 1 : b] for a, b in zip([-1, *places], [*places, len(html)], strict=True)]
    return mark.join(parts)


#: An & and the rest of a reference that ends with its semicolon, if it begins one.
_REFERENCE = re.compile("&(#[0-9]+;|#[xX][0-9a-fA-F]+;|[0-9A-Za-z]+;)?")


def marked_open_references(html: str, mark: str) -> str:
    """html with a mark in place of each & that begins no character reference with its semicolon."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else mark + (m[1] or ""), html)


def html_text(html: str | None, closed: bool = False) -> tuple[str, list[tuple[str, str, str]]]:
    """The text of an HTML document, and its links (href, text, file id), the first of each target.

    closed: only character references with their semicolon are decoded; what is left of one that was cut stays. Without it
    those of old are decoded without one as well, as browsers do.
    """
    mark, amp = islice((c for c in MARKS if c not in (html or "")), 2)
    reader = _Reader(amp if closed else "")
    held = marked_open_references(html, amp) if closed and html else html or ""
    reader.feed(marked_open_ends(held, mark))
    reader.close()
    text = reader.finish().replace(mark, "<")
    reader.links = [tuple(x.replace(mark, "<") for x in link) for link in reader.links]
    seen: dict[str, tuple[str, str, str]] = {}
    for link in reader.links:
        seen.setdefault(link[2] or link[0], link)
    return text, list(seen.values())


LINK = struct("href STRING, text STRING, file_id STRING")


def html_to_text(pages: DataFrame, html: str = "html", closed: bool = False) -> DataFrame:
    """pages with text and links (array of href, text, file_id); columns of those names are replaced. closed: see html_text()."""
    rows = pages.drop("text", "links")
    shape = T.StructType([*rows.schema.fields, T.StructField("text", T.StringType()), T.StructField("links", T.ArrayType(LINK))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done = [html_text(h, closed) for h in batch[html]]
            links = [[dict(zip(LINK.names, x, strict=True)) for x in found] for _, found in done]
            yield batch.assign(text=[t for t, _ in done], links=links)

    return rows.mapInPandas(run, shape)


def is_linkable(href: Column) -> Column:
    """http, https or relative, with a host or a path, and no mere fragment."""
    scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return (scheme.isin("", "http", "https")) & ~href.startswith("#") & (F.regexp_replace(href, r"(?i)^(https?:)?/{0,2}", "") != "")


def file_id(url: Column) -> Column:
    """The number behind /files/ in the path of a URL, or null."""
    found = F.regexp_extract(F.regexp_extract(url, r"^([^?#]*)", 1), r"/files/(\d+)(?:/|$)", 1)
    return F.when(found != "", found.cast("bigint"))


def with_files(links: DataFrame, files: DataFrame, most: int) -> DataFrame:
    """links (file_id, ...) ⟕ files (file_id, name, size), with error: a file that is not known, or too large to be read."""
    error = F.when(F.col("name").isNull(), "not found").when(F.col("size") > most, "too large")
    return links.join(files, "file_id", "left").withColumn("error", error)


#: What the elements of a text document and of a slide put out where they end, and those that do so where they begin. Fixed values.
DOCUMENT_ENDS, SLIDE_ENDS = {"p": "\n", "tr": "\n", "tc": "\t"}, {"p": "\n"}
DOCUMENT_STARTS, SLIDE_STARTS = {"tab": "\t", "br": "\n", "cr": "\n"}, {"br": "\n"}

#: Characters of one part of an office file at most; what is behind them is left unread, however far it would unpack.
PART_CHARS = 16 << 20


def _part_text(stream: BinaryIO, starts: dict[str, str], ends: dict[str, str]) -> str:
    """The text runs of an XML part, read piece by piece. What comes before an error, in the packing or in the XML, is kept."""
    out: list[str] = []
    inside = size = 0
    parser = expat.ParserCreate()

    def start(name: str, _: dict) -> None:
        nonlocal inside
        local = name.rpartition(":")[2]
        inside += local == "t"
        out.append(starts.get(local, ""))

    def end(name: str) -> None:
        nonlocal inside
        local = name.rpartition(":")[2]
        inside -= local == "t"
        out.append(ends.get(local, ""))

    def data(text: str) -> None:
        nonlocal size
        if inside:
            out.append(text)
            size += len(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    try:
        while size < PART_CHARS and (piece := stream.read(1 << 16)):
            parser.Parse(piece, False)
    except (expat.ExpatError, zlib.error, zipfile.BadZipFile, EOFError):
        pass
    return "".join(out)


def _docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z, z.open("word/document.xml") as f:
        text = _part_text(f, DOCUMENT_STARTS, DOCUMENT_ENDS)
    return tidy(re.sub("\n\t", "\t", text))


def _pptx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        slides = sorted((int(m[1]), m[0]) for n in z.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        if not slides:
            raise ValueError("no slides")
        texts = []
        for _, name in slides:
            with z.open(name) as f:
                texts.append(_part_text(f, SLIDE_STARTS, SLIDE_ENDS).strip("\n"))
    return tidy("\n\n".join(filter(None, texts)))


def read_files(spark: SparkSession, path: str, ceiling: int = 64 << 20) -> DataFrame:
    """(path, mime_type, content, length) of the files under path, as files_to_text() takes them.

    The length is looked at before a file is read: one over the ceiling has no content, and
    never is in memory. Empty files have no row, as Spark passes them over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    none = F.lit(None).cast("string").alias("mime_type")
    fits = files.where(F.col("length") <= ceiling).select("path", none, "content", "length")
    large = files.where(F.col("length") > ceiling).select("path", none, F.lit(None).cast("binary").alias("content"), "length")
    return fits.unionByName(large)


#: Files and bytes of a batch, about, of those that read_folders() hands on.
BATCH_FILES, BATCH_BYTES = 500, 8 << 20


def read_folders(folders: DataFrame, ceiling: int = 64 << 20) -> DataFrame:
    """(path, mime_type, content, length) of the files in folders (folder), as read_files() has them, for very many files.

    A folder is listed and read by the task that has its row, so the driver never holds the list of files. A
    folder that is missing has no files; folders in it are passed over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        rows, held = [], 0
        for batch in batches:
            for folder in batch["folder"]:
                store, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
                for file in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
                    if file.type != fs.FileType.File or not file.size or file.base_name[0] in "_.":
                        continue
                    content = None
                    if file.size <= ceiling:
                        with store.open_input_stream(file.path) as f:
                            content = f.read()
                    rows.append((f"{folder}/{file.base_name}", None, content, file.size))
                    held += len(content or b"")
                    if len(rows) >= BATCH_FILES or held >= BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "mime_type", "content", "length"])
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "mime_type", "content", "length"])

    return folders.select("folder").mapInPandas(run, "path string, mime_type string, content binary, length long")


EXTRACTED = struct("path STRING, format STRING, text STRING, truncated BOOLEAN, error STRING, cacheable BOOLEAN")


def files_to_text(files: DataFrame, limit: int = 64 * 1024, ceiling: int = 64 << 20) -> DataFrame:
    """(path, format, text, truncated, error, cacheable) of files (path, mime_type, content and, if known without it, length).

    Of an office file that is damaged what comes before the damage is its text. Files of other formats and those over the ceiling have an error and no text, as
    has a file that cannot be parsed; no row fails. Only what a new attempt cannot
    change is cacheable.
    """
    size = F.coalesce("length", F.length("content")) if "length" in files.columns else F.length("content")
    rows = files.select("path", text_format(F.col("mime_type"), F.col("path")).alias("format"), "content", size.cast("bigint").alias("size"))
    fits = F.coalesce((F.col("size") <= ceiling) & F.col("content").isNotNull(), F.lit(False))
    plain = rows.where((F.col("format") == "text") & fits)
    cleaned = clean_text(without_invalid(F.substring("content", 1, 4 * limit).cast("string")))
    native = plain.select(
        "path", "format", cut_bytes(cleaned, limit).alias("text"), ((F.octet_length(cleaned) > limit) | (F.col("size") > 4 * limit)).alias("truncated"),
        F.lit(None).cast("string").alias("error"), F.lit(True).alias("cacheable"),
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, kind, content in zip(batch["path"], batch["format"], batch["content"], strict=True):
                try:
                    raw = bytes(content)
                    text = html_text(raw[: 8 * limit].decode("utf-8", "ignore"))[0] if kind == "html" else _docx(raw) if kind == "docx" else _pptx(raw)
                    short = text.encode()[:limit].decode("utf-8", "ignore")
                    out.append((path, kind, short, short != text or (kind == "html" and len(raw) > 8 * limit), None, True))
                except Exception as e:  # a malformed file is a value
                    out.append((path, kind, None, False, f"cannot be read: {type(e).__name__}", True))
            yield pd.DataFrame(out, columns=EXTRACTED.names)

    parsed = rows.where(F.col("format").isin("html", "docx", "pptx") & fits).mapInPandas(run, EXTRACTED)
    other = F.coalesce(F.col("format"), F.lit("")).isin("text", "html", "docx", "pptx")
    error = F.when(~other, "unsupported type").when(F.col("size") > ceiling, "too large").otherwise("no content")
    rest = rows.where(~(other & fits)).select(
        "path", "format", F.lit(None).cast("string").alias("text"), F.lit(False).alias("truncated"), error.alias("error"), F.lit(True).alias("cacheable")
    )
    return native.unionByName(parsed).unionByName(rest)


def chunks(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """docs with part and chunk: whole lines packed greedily into at most limit bytes; a longer line is a chunk of its own."""
    kept = F.filter(F.split(text, "(?<=\n)"), lambda x: x != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    packed = F.aggregate(
        kept,
        start,
        lambda acc, line: F.when(
            (acc["now"] != "") & (F.octet_length(acc["now"]) + F.octet_length(line) > limit),
            F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), line.alias("now")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["now"], line).alias("now"))),
        lambda acc: F.when(acc["now"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"]))),
    )
    whole = F.when(F.octet_length(text) <= limit, F.array(F.col(text))).otherwise(packed)
    return docs.select("*", F.posexplode(whole).alias("part", "chunk"))
