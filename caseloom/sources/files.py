"""Original files: loading with hash and size, format detection, upload checks, decoding, e-mail and CSV."""

from __future__ import annotations

import codecs
import csv
import email
import email.policy
import io
import re
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import stable_id
from caseloom.operators.blocks import split_blocks

MOST_BYTES = 50 * 1024 * 1024
HEAD = 65_536


#: Bounds of zip archives.
MOST_ENTRIES, MOST_EXPANDED = 10_000, 250 * 1024 * 1024
#: Suffixes and declared media types that agree with each kind of upload.
SUFFIXES = {"pdf": ["pdf"], "docx": ["docx"], "xlsx": ["xlsx"], "xls": ["xls"], "png": ["png"], "jpeg": ["jpg", "jpeg"], "tiff": ["tif", "tiff"], "csv": ["csv"], "email": ["eml"], "rtf": ["rtf"], "text": ["txt", "md"]}
OFFICE = "application/vnd.openxmlformats-officedocument."
MEDIA_TYPES = {
    "pdf": ["application/pdf"], "docx": [OFFICE + "wordprocessingml.document"], "xlsx": [OFFICE + "spreadsheetml.sheet"], "xls": ["application/vnd.ms-excel"], "png": ["image/png"], "jpeg": ["image/jpeg", "image/jpg"],
    "tiff": ["image/tiff"], "csv": ["text/csv", "application/csv", "text/plain"], "email": ["message/rfc822", "text/plain"], "rtf": ["application/rtf", "text/rtf", "text/plain"], "text": ["text/plain", "text/markdown"],
}
GENERIC = ["", "application/octet-stream", "binary/octet-stream"]


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def _known(raw: DataFrame) -> list[str]:
    """The columns besides those of a file that rows of a container have."""
    return [c for c in raw.columns if c not in ("path", "modificationTime", "length", "content")]


def load_originals(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """loaded() of the files below a folder."""
    return loaded(_binary(spark, path), most)


def loaded(raw: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """path, size, sha256, content, accepted: files (path, length, content: loose ones or rows of a container) as they
    are. Larger ones are listed by name and size alone, as the bound is put to the scan before any content is read."""
    keys = _known(raw)
    own = raw.filter(F.col("length") <= most).select(*keys, "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content", F.lit(True).alias("accepted"))
    large = raw.filter(F.col("length") > most).select(*keys, "path", F.col("length").alias("size"), F.lit(None).cast("string").alias("sha256"), F.lit(None).cast("binary").alias("content"), F.lit(False).alias("accepted"))
    return own.unionByName(large)


def scanned_originals(spark: SparkSession, path: str, head: int = HEAD, most: int = MOST_BYTES) -> DataFrame:
    """scanned() of the files below a folder."""
    return scanned(_binary(spark, path), head, most)


def scanned(raw: DataFrame, head: int = HEAD, most: int = MOST_BYTES) -> DataFrame:
    """path, size, sha256, format, kind, head, accepted: what is known of files (path, length, content: loose ones or rows
    of a container) without their contents, which are hashed and looked at where they are read, and don't go on in the
    rows (zip archives' go to the check of their members)."""
    keys, name = _known(raw), F.element_at(F.split("path", "/"), -1)
    own = raw.filter(F.col("length") <= most).select(*keys, "path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), detected_format(F.col("content"), name).alias("format"), F.substring("content", 1, head).alias("head"))
    own = own.select(*keys, "path", "size", "sha256", "format", _text_kind("head", F.col("size") > head).alias("kind"), "head", F.lit(True).alias("accepted"))
    null = lambda t: F.lit(None).cast(t)
    large = raw.filter(F.col("length") > most).select(*keys, "path", F.col("length").alias("size"), null("string").alias("sha256"), null("string").alias("format"), null("string").alias("kind"), null("binary").alias("head"), F.lit(False).alias("accepted"))
    return own.unionByName(large)


def _starts(content: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | (F.hex(F.substring(content, 1, len(h) // 2)) == h)
    return out


@F.pandas_udf(T.StructType().add("names", T.ArrayType(T.StringType())).add("problem", "string"))
def _members(content: pd.Series) -> pd.DataFrame:
    """The member names of a zip archive, or what is wrong with it."""

    def one(b) -> tuple[list[str], str | None]:
        try:
            with zipfile.ZipFile(io.BytesIO(bytes(b or b""))) as z:
                found = z.infolist()
        except zipfile.BadZipFile:
            return [], "corrupted"
        if len(found) > MOST_ENTRIES:
            return [], "entries"
        return ([], "expansion") if sum(max(0, x.file_size) for x in found) > MOST_EXPANDED else ([x.filename for x in found], None)

    return pd.DataFrame([one(b) for b in content], columns=["names", "problem"])


def detected_format(content: Column, name: Column, declared: Column | None = None) -> Column:
    """By first bytes (zip archives by their members), then by suffix, then by declared type; a damaged or oversized
    archive is invalid, anything else unknown."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^./\\]*)$", 1))
    declared = F.lower(F.coalesce(declared, F.lit(""))) if declared is not None else F.lit("")
    zipped = _starts(content, "504B0304")
    members = _members(F.when(zipped, content))
    holds = lambda folder: F.exists(members["names"], lambda n: n.startswith(folder))
    office = F.when(members["problem"].isNotNull(), "invalid").when(holds("word/"), "docx").when(holds("xl/"), "spreadsheet").otherwise("unknown")
    return (
        F.when(_starts(content, "255044462D"), "pdf").when(zipped, office).when(_starts(content, "89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A"), "image")
        .when((suffix == ".csv") | (declared == "text/csv"), "csv").when(suffix.isin(".txt", ".md", ".rtf") | declared.startswith("text/plain"), "text")
        .when((suffix == ".eml") | (declared == "message/rfc822"), "email").when(suffix.isin(".xls", ".xlsx"), "spreadsheet")
        .when(suffix.isin(".jpg", ".jpeg", ".png", ".tif", ".tiff") | declared.startswith("image/"), "image").otherwise("unknown")
    )


def text_kind(sample: bytes, cut: bool = False) -> str | None:
    """rtf, email, csv or text, by what the first bytes of a file read like; None if they are no text. Of a sample that is
    cut from a longer file the last character may be there in part."""
    if not sample or (b"\0" in sample[:4096] and not sample.startswith((codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE))):
        return None
    text = ""
    for decode in (codecs.getincrementaldecoder("utf-8-sig")().decode, lambda b, final: codecs.utf_16_decode(b, "strict", final)[0], lambda b, final: b.decode("latin-1")):
        try:
            text = decode(sample, final=not cut)
            break
        except UnicodeError:
            continue
    if not text.strip() or sum(c.isprintable() or c in "\r\n\t" for c in text) < 0.95 * len(text):
        return None
    if text.lstrip().startswith("{\\rtf"):
        return "rtf"
    heads = {h.casefold() for h in re.findall(r"(?im)^(from|to|subject|date|message-id):\s*.+$", text[:4096])}
    if "message-id" in heads or len(heads) > 1:
        return "email"
    start = text[:8192]
    try:
        rows = list(csv.reader(io.StringIO(start), csv.Sniffer().sniff(start, delimiters=",;\t|")))[:5]
    except csv.Error:
        rows = []
    return "csv" if len(rows) > 1 and min(map(len, rows)) > 1 else "text"


@F.pandas_udf(T.StringType())
def _text_kind(sample: pd.Series, cut: pd.Series) -> pd.Series:
    return pd.Series([None if b is None else text_kind(bytes(b), bool(c)) for b, c in zip(sample, cut)], dtype=object)


def validated(content: Column, name: Column, declared: Column) -> Column:
    """struct<kind,reason> of an upload: its kind by first bytes and content, or why it is refused: empty, an executable
    or archive, no known type, or a suffix or declared type that disagrees."""
    zipped = _starts(content, "504B0304")
    binary = F.when(_starts(content, "255044462D"), "pdf").when(_starts(content, "89504E470D0A1A0A"), "png").when(_starts(content, "FFD8FF"), "jpeg").when(_starts(content, "49492A00", "4D4D002A"), "tiff").when(_starts(content, "D0CF11E0A1B11AE1"), "xls")
    refused = _starts(content, "4D5A", "7F454C46", "526172211A07", "377ABCAF271C", "1F8B")
    size = F.coalesce(F.octet_length(content), F.lit(0))
    plain = ~zipped & binary.isNull() & ~refused
    members, text = _members(F.when(zipped, content)), _text_kind(F.when(plain & (size > 0), F.substring(content, 1, HEAD)), size > HEAD)
    has = lambda n: F.array_contains(members["names"], n)
    office = F.when(members["problem"].isNull() & has("[Content_Types].xml"), F.when(has("word/document.xml"), "docx").when(has("xl/workbook.xml"), "xlsx"))
    kind = F.when(size > 0, F.when(zipped, office).otherwise(F.coalesce(binary, F.when(plain, text))))
    #: The reasons.
    problem = (
        F.when(size == 0, "The uploaded file is empty.")
        .when(zipped & (members["problem"] == "corrupted"), "Office document container is corrupted.")
        .when(zipped & (members["problem"] == "entries"), "Office archive contains too many entries.")
        .when(zipped & (members["problem"] == "expansion"), "Office archive exceeds expansion limits.")
        .when(zipped & ~has("[Content_Types].xml"), "ZIP upload is not a supported Office document.")
        .when(zipped & kind.isNull(), "ZIP upload is not a supported DOCX or XLSX file.")
        .when(refused, "Executable or archive uploads are not allowed.")
        .when(kind.isNull(), "File signature is not a supported document type.")
    )
    fits = lambda table, value: F.array_contains(F.element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), kind), value)
    suffix = F.lower(F.regexp_extract(name, r"[^./\\]\.([^./\\]+)$", 1))
    media = F.lower(F.trim(F.element_at(F.split(F.coalesce(declared, F.lit("")), ";"), 1)))
    problem = problem.when((suffix != "") & ~fits(SUFFIXES, suffix), F.concat(F.lit("File extension ."), suffix, F.lit(" does not match detected "), kind, F.lit(" content.")))
    problem = problem.when(~media.isin(*GENERIC) & ~fits(MEDIA_TYPES, media), "Declared MIME type does not match the uploaded file signature.")
    return F.struct(F.when(problem.isNull(), kind).alias("kind"), problem.alias("reason"))


def _decoded(content: bytes | None) -> str | None:
    if content is None:
        return None
    for name in ("utf-8-sig", "utf-16"):
        try:
            return bytes(content).decode(name)
        except UnicodeDecodeError:
            continue
    return bytes(content).decode("cp1252", "replace")


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Text by the first of UTF-8 (with or without mark), UTF-16 and Windows-1252 that fits."""
    return content.map(_decoded)


def _csv_rows(text: str | None) -> list[list[str]] | None:
    if text is None:
        return None
    csv.field_size_limit(MOST_BYTES)
    out = []
    try:
        for row in csv.reader(io.StringIO(text, newline="")):
            out.append([" ".join(c.split()) for c in row])
    except csv.Error:  # a text that isn't CSV from some row on: its lines as they are
        return out + [[" ".join(line.split())] for line in text.splitlines()[len(out):]]
    return out


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def csv_rows(text: pd.Series) -> pd.Series:
    """The rows of a CSV text, of any width, with white space in cells collapsed; cells may be as long as a file. Where
    the reader fails, the rows before stay, and each line from there on is one cell."""
    return text.map(_csv_rows)


def _email_parts(content: bytes | None) -> tuple[str, str, int]:
    m = email.message_from_bytes(bytes(content or b""), policy=email.policy.default)

    def header(name: str) -> str:
        try:
            return str(m.get(name, ""))
        except (LookupError, ValueError, IndexError, AttributeError, TypeError):  # a header that can't be parsed
            return ""

    body = m.get_body(preferencelist=("plain",)) if m.is_multipart() else m
    try:
        text = body.get_content() if body else ""
    except KeyError:  # no kind of content that can be read
        text = ""
    except (LookupError, ValueError):  # an unknown charset or encoding: read as other files are
        raw = body.get_payload(decode=True)
        text = _decoded(raw) if isinstance(raw, bytes) else str(body.get_payload())
    return "\n".join(f"{h}: {header(h)}" for h in ("From", "To", "Cc", "Date", "Subject")), text if isinstance(text, str) else "", len(list(m.iter_attachments())) if m.is_multipart() else 0


@F.pandas_udf(T.StructType().add("header", "string").add("body", "string").add("attachments", "integer"))
def email_parts(content: pd.Series) -> pd.DataFrame:
    """The main headers (empty where there are none or they can't be read), the plain text and the number of attachments
    of an e-mail. A text in an unknown charset is decoded as other files are."""
    return pd.DataFrame([_email_parts(b) for b in content], columns=["header", "body", "attachments"])


def email_blocks(mails: DataFrame) -> DataFrame:
    """version_id, sequence, kind, text, block_id, attachments of e-mails (version_id, content): the headers' block, then
    the body's, numbered on. An e-mail without any text has one row, without a block."""
    m = mails.select("version_id", email_parts("content").alias("m"))
    made = lambda text, kind: F.transform(split_blocks(text), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))
    b = m.select("version_id", "m.attachments", F.posexplode_outer(F.concat(made(F.col("m.header"), "metadata"), made(F.col("m.body"), "paragraph"))).alias("sequence", "b"))
    return b.select("version_id", F.col("sequence").cast("long").alias("sequence"), "b.kind", "b.text", stable_id("blk_", F.col("version_id").cast("string"), F.lit("1"), F.col("sequence").cast("string"), "b.text", size=20).alias("block_id"), "attachments")


def table_text(rows: Column) -> Column:
    """Cells joined by a bar and rows by line ends; rows without any text are left out."""
    return F.array_join(F.transform(F.filter(rows, lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(r, " | ")), "\n")
