"""Text helpers: normalisers, clips and extractors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about which piece of work a title names. Fixed values.
STOPWORDS = (
    "the a an and or of for to in on at by due your you is be assignment homework hw task work class period week day no"
).split()


def one_line(s: Column) -> Column:
    """White space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def blank_to_null(s: Column) -> Column:
    return F.when(F.trim(s) != "", F.trim(s))


def norm_title(title: Column) -> Column:
    """Lower case; runs of ASCII other than letters and digits as one space; the rest kept."""
    return F.trim(F.regexp_replace(F.lower(title), r"[^a-z0-9\x{80}-\x{10FFFF}]+", " "))


def title_words(title: Column) -> Column:
    """The distinct meaningful words: of 3 bytes or more, or with a digit, and no stopword."""
    kept = lambda w: (w != "") & ((F.octet_length(w) >= 3) | w.rlike("[0-9]")) & ~w.isin(STOPWORDS)
    return F.array_distinct(F.filter(F.split(norm_title(title), " "), kept))


def cut_bytes(s: Column, limit: int) -> Column:
    """The longest start of s with at most limit UTF-8 bytes that ends between characters."""
    raw = s.cast("binary")
    ends = [F.substring(raw, 1, n) for n in range(limit, max(limit - 4, -1), -1)]
    whole = [F.when(F.is_valid_utf8(e.cast("string")), e.cast("string")) for e in ends]
    return F.when(F.octet_length(s) > limit, F.coalesce(*whole, F.lit(""))).otherwise(s)


def clip_bytes(s: Column, limit: int, tail: str = "…", counted: bool = True, trimmed: bool = False) -> Column:
    """s if it has at most limit bytes; else its start and the tail, which counts within the limit or stands beyond it."""
    start = cut_bytes(s, limit - len(tail.encode()) if counted else limit)
    start = F.trim(start) if trimmed else start
    return F.when(F.octet_length(s) > limit, F.concat(start, F.lit(tail))).otherwise(s)


def clip_chars(s: Column, limit: int, counted: bool = True) -> Column:
    """s if it has at most limit characters; else its trimmed start and an ellipsis, counted within the limit or not."""
    start = F.trim(F.substring(s, 1, limit - 1)) if counted else F.substring(s, 1, limit)
    return F.when(F.char_length(s) > limit, F.concat(start, F.lit("…"))).otherwise(s)


def slug(title: Column) -> Column:
    """Letters and digits joined by "-", at most 40 bytes; "row" if nothing is left."""
    joined = F.regexp_replace(F.lower(title), r"[^\p{L}\p{Nd}]+", "-")
    short = F.regexp_replace(cut_bytes(F.regexp_replace(joined, "^-+|-+$", ""), 40), "^-+|-+$", "")
    return F.when(F.coalesce(short, F.lit("")) == "", F.lit("row")).otherwise(short)


def clean_text(s: Column) -> Column:
    """Without NUL and BOM; CR and CRLF as LF; lines right-trimmed; no line feeds around."""
    plain = F.regexp_replace(F.translate(s, "\0\ufeff", ""), "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(plain, "[ \t\\x0B\f]+(\n|$)", "$1"), "^\n+|\n+$", "")


def plain_text(s: Column) -> Column:
    """CR and CRLF as LF, trimmed."""
    return F.regexp_replace(F.regexp_replace(s, "\r\n?", "\n"), r"^\s+|\s+$", "")


def without_invalid(s: Column) -> Column:
    """Without the bytes that are no UTF-8; a replacement character that the text has itself stays."""
    mark, own, real = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2"
    held = F.replace(F.replace(s, F.lit(mark), F.lit(own)), F.lit("\ufffd"), F.lit(real))
    valid = F.replace(F.make_valid_utf8(held), F.lit("\ufffd"), F.lit(""))
    return F.replace(F.replace(valid, F.lit(real), F.lit("\ufffd")), F.lit(own), F.lit(mark))


def lenient_int(s: Column) -> Column:
    """A whole number as text; 0 for anything else."""
    return F.coalesce(F.when(s.rlike(r"^-?\d{1,19}$"), s.try_cast("bigint")), F.lit(0))


def _query_value(url: Column, name: str) -> Column:
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", _unescaped(found))


def _unescaped(s: Column) -> Column:
    """Percent escapes undone, a plus kept; as it is where they are malformed."""
    return F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s)


def document_id(ref: Column) -> Column:
    """A document's id, from itself or a URL: the parameter id, else what follows /d/ in the path; null if there is none."""
    path = F.regexp_extract(F.regexp_extract(ref, r"^([^?#]*)", 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$", 1)
    behind = F.regexp_extract(path, r"(?:^|/)d/([^/]+)", 1)
    found = F.coalesce(_query_value(ref, "id"), F.when(behind != "", behind))
    return F.when((ref == ""), F.lit(None).cast("string")).when(~ref.contains("/") & ~ref.contains("?"), ref).otherwise(found)


def calendar_id(ref: Column) -> Column:
    """A calendar's id, from itself or a URL: the parameter src, else what follows v2 or ical in the path, else a part with an @; null if there is none."""
    path = F.regexp_extract(F.regexp_extract(ref, r"^([^?#]*)", 1), r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)$", 1)
    behind = F.regexp_extract(path, r"(?:^|/)(?:v2|ical)/([^/]+)", 1)
    mail = F.regexp_extract(path, r"(?:^|/)([^/]*(?:%40|@)[^/]*)", 1)
    found = F.coalesce(_query_value(ref, "src"), F.when(behind != "", _unescaped(behind)), F.when(mail != "", _unescaped(mail)))
    return F.when((ref == ""), F.lit(None).cast("string")).when(~ref.contains("/") & ~ref.contains("?"), _unescaped(ref)).otherwise(found)


def is_feed_url(ref: Column) -> Column:
    """Whether a reference is an http(s) URL of an iCalendar file."""
    path = F.lower(F.regexp_extract(ref, r"^([^?#]*)", 1))
    return ref.rlike("^https?://") & path.rlike(r"^https?://[^/]*/.*\.ics$")


def absolute_url(url: Column, base: str) -> Column:
    """A path under base where a URL begins with "/"; anything else as it is."""
    return F.when(url.startswith("/"), F.concat(F.lit(base.rstrip("/")), url)).otherwise(F.coalesce(url, F.lit("")))


def tidy_text(s: Column) -> Column:
    """No-break spaces as spaces, lines right-trimmed, at most one empty line, trimmed."""
    plain = F.regexp_replace(F.regexp_replace(F.translate(s, "\u00a0", " "), "\r\n?", "\n"), "[ \t\\x0B\f]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(plain, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def strip_image_data(s: Column) -> Column:
    """Without definitions of embedded images; long inline base64 as "(image)"."""
    lines = F.regexp_replace(s, r"(?m)^\[[^\]\n]*\]: *<?data:image/[^\n]*\n?", "")
    inline = F.regexp_replace(lines, r"data:image/[a-z+.-]+;base64,[A-Za-z0-9+/=]{100,}", "(image)")
    return F.when(s.contains(";base64,"), inline).otherwise(s)


def first_line_title(s: Column, limit: int = 80, default: str = "Announcement") -> Column:
    """The first line, at most limit characters and an ellipsis; the default if empty."""
    line = F.trim(F.substring_index(F.trim(F.regexp_replace(s, r"^\s+", "")), "\n", 1))
    return F.when(F.coalesce(line, F.lit("")) == "", F.lit(default)).otherwise(clip_chars(line, limit))


SENTINEL = "x-id: "


def last_sentinel(notes: Column) -> Column:
    """The id in the last sentinel line of notes, or null."""
    found = F.regexp_extract_all(notes, F.lit(r"(?m)^x-id: *(\S[^\n]*?)[ \t]*$"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def unfence(answer: Column) -> Column:
    """What stands between the first and the last fence, else between the first { or [ and the last } or ]."""
    fenced = F.regexp_extract(answer, r"(?s)```[^\n]*\n(.*)```", 1)
    return F.when(fenced != "", F.regexp_replace(fenced, r"^\s+|\s+$", "")).otherwise(F.regexp_extract(answer, r"(?s)([\[{].*[\]}])", 1))


def short_number(x: Column) -> Column:
    """17 for 17.0, 12.5 for 12.5."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def minutes_text(m: Column) -> Column:
    """"45 min", "1 h", "2.5 h"."""
    hours = F.round(m / 60, 1)
    return F.when(m < 60, F.concat(m.cast("int").cast("string"), F.lit(" min"))).otherwise(F.concat(short_number(hours), F.lit(" h")))


def attachment_line(name: Column, url: Column) -> Column:
    """"name (url)", or what there is of the two."""
    n, u = F.coalesce(name, F.lit("")), F.coalesce(url, F.lit(""))
    return F.when((n == "") | (n == u), u).when(u == "", n).otherwise(F.concat(n, F.lit(" ("), u, F.lit(")")))


#: Format by MIME type and by extension. Fixed values.
MIME_FORMATS = {
    "application/pdf": "pdf", "application/x-pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "text/html": "html", "application/xhtml+xml": "html",
    "application/json": "text", "application/x-ndjson": "text", "application/javascript": "text", "application/x-javascript": "text",
    "application/typescript": "text", "application/x-sh": "text", "application/x-shellscript": "text", "application/x-latex": "text",
    "application/x-tex": "text", "application/rtf": "text", "application/x-yaml": "text", "application/yaml": "text", "application/xml": "text",
}
EXTENSION_FORMATS = {
    "pdf": "pdf", "docx": "docx", "pptx": "pptx", "html": "html", "htm": "html", "xhtml": "html",
} | dict.fromkeys(
    "txt md markdown csv tsv json log tex rtf xml yaml yml py java c h cpp hpp cs js ts tsx jsx go rs rb php sh sql css r m kt swift scala pl lua asm s".split(),
    "text",
)


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def text_format(mime: Column, name: Column) -> Column:
    """html, text, pdf, docx or pptx by MIME type, then by extension; null where unsupported."""
    m = F.lower(F.trim(F.substring_index(F.coalesce(mime, F.lit("")), ";", 1)))
    extension = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))
    general = F.when(m.startswith("text/") | m.endswith("+json") | m.endswith("+xml"), F.lit("text"))
    return F.coalesce(_looked_up(m, MIME_FORMATS), general, _looked_up(extension, EXTENSION_FORMATS))


def listed(answer: Column, element: str, field: str = "entries") -> Column:
    """A list answer as an array of element (a DDL type), whether it comes bare or under a field of an object; null for junk."""
    wrapped = F.from_json(answer, f"{field} ARRAY<{element}>")[field]
    return F.when(F.ltrim(answer).startswith("["), F.from_json(answer, f"ARRAY<{element}>")).otherwise(wrapped)
