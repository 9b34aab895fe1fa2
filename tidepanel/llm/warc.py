"""Derivative builder for WARC responses (operator 7).

Every response record yields two linked records, as web archives ship them: ``metadata``
(fields of the response: title, declared language, outgoing links) and ``conversion`` (the
page as plain text). Both carry ``WARC-Refers-To`` with the response's record id, its target
address, date and payload digest; the conversion also names the metadata record as
``WARC-Concurrent-To``. Digests are of the exact octets of each block. Everything is
column expressions: one pass over the responses, no shuffle.

Record ids are made from what a response is (page, address, date, payload digest), so different
payloads of one address keep apart. Blocks that still hold their HTTP head go through
:func:`parse_http` first; its headers then reach the metadata record. Links may be quoted either
way or not at all; numeric references and the 252 named ones of HTML 4 are decoded when a
semicolon ends them, others stay as they are.

Edge cases: a NULL or empty payload gives an empty conversion and metadata without fields; a
NULL address or date leaves out that header; responses without a record id refer to nothing
(no header) and get an id from their content; repeated responses give repeated records with
equal ids; other columns of the input are ignored; an empty table gives no records.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, functions as F

# Patterns of the text conversion, in order, understood alike by Java and RE2.
DROP = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>"
BREAK = r"(?i)</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|article|section|nav|footer|header|body|html|title|blockquote|pre)\b[^>]*>"
TAG = r"<[^>]*>"
#: Named references of HTML 4 (from the standard library); a no-break space is a space here.
ENTITIES = {name: " " if code == 160 else chr(code) for name, code in sorted(name2codepoint.items())}
DECIMAL, HEXADECIMAL = "^#[0-9]{1,7}$", "^#[xX][0-9A-Fa-f]{1,6}$"
TITLE = r"(?is)<title[^>]*>(.*?)</title"
LANGUAGE = r"""(?is)<html[^>]*\slang\s*=\s*["']?([A-Za-z-]+)"""
SPACES = r"[\t\x0b\f\r ]{2,}|[\t\x0b\f\r]"
LINK = r"""<[aA]\s(?:[^>]*?\s)?[hH][rR][eE][fF]\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
HEAD_END = r"\r?\n\r?\n"
DATE = "2024-01-01T00:00:00Z"


def _character(code: Column) -> Column:
    """The character of a code point; U+FFFD for what is none."""
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    wide = F.decode(F.unhex(F.lpad(F.hex(F.when(valid, code)), 8, "0")), "UTF-32")
    return F.when(code == 160, " ").otherwise(F.coalesce(wide, F.lit("\ufffd")))


def unescaped(text: Column) -> Column:
    """References that a semicolon ends as their characters, each once."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def read(part, i):  # what stands behind an ampersand, worked out once; numbers only behind a number sign
        ref = F.substring_index(part, ";", 1)
        hexadecimal = F.when(ref.rlike(HEXADECIMAL), F.conv(F.substring(ref, 3, 6), 16, 10).cast("long"))
        code = F.when(ref.startswith("#"), F.coalesce(F.when(ref.rlike(DECIMAL), F.substring(ref, 2, 7).cast("long")), hexadecimal))
        known = (i > 0) & F.contains(part, F.lit(";"))
        return F.struct(part.alias("part"), F.when(known, code).alias("code"), F.when(known, F.try_element_at(names, ref)).alias("named"),
                        F.length(ref).alias("n"), (i == 0).alias("first"))

    def written(p):
        char = F.when(p.code.isNotNull(), _character(p.code)).otherwise(p.named)
        whole = F.when(p.first, p.part).otherwise(F.concat(F.lit("&"), p.part))
        return F.when(p.code.isNull() & p.named.isNull(), whole).otherwise(F.concat(char, F.substr(p.part, p.n + 2)))

    return F.array_join(F.transform(F.transform(F.split(text, "&"), read), written), "")


def plain_text(html: Column) -> Column:
    """Visible text: scripts, styles, head and comments dropped, block tags as line breaks,
    a line per block without blank ones."""
    out = F.regexp_replace(html, F.lit(DROP), F.lit(" "))
    out = F.regexp_replace(out, F.lit(BREAK), F.lit("\n"))
    out = F.regexp_replace(out, F.lit(TAG), F.lit(""))
    out = unescaped(out)
    out = F.regexp_replace(out, F.lit(SPACES), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(out, F.lit(r" ?\n[ \n]*"), F.lit("\n")), F.lit(r"^[ \n]+|[ \n]+$"), F.lit(""))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made from the md5 of its parts: the same parts give the same id."""
    h = F.md5(F.concat_ws("|", *parts))
    at = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), at(1, 8), F.lit("-"), at(9, 4), F.lit("-"), at(13, 4), F.lit("-"), at(17, 4), F.lit("-"), at(21, 12), F.lit(">"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of crawled pages (``page_id, url, html``)."""
    block = F.coalesce(F.col("html"), F.lit(""))
    own = record_id(F.lit("response"), F.col("page_id").cast("string"), F.col("url"), F.lit(date), digest(block))
    return pages.select(
        "page_id", own.alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("date"), F.lit("text/html; charset=utf-8").alias("http_content_type"),
        block.alias("payload"), digest(block).alias("payload_digest"))


def parse_http(found: DataFrame, block: str = "block") -> DataFrame:
    """Responses as they were captured: the HTTP head in ``block`` becomes ``http_status``,
    ``http_headers`` (array of name, value; names in lower case, in order, repeats kept) and ``http_content_type``, the rest ``payload``
    with its digest. A block without a status line is all payload; a head without an end is all head."""
    text = F.coalesce(F.col(block), F.lit(""))
    has_head = text.rlike(r"^HTTP/[0-9.]+ +[0-9]{3}")
    cut = F.split(text, HEAD_END, 2)
    lines = F.filter(F.split(F.get(cut, F.lit(0)), r"\r?\n"), lambda x, i: (i > 0) & F.contains(x, F.lit(":")))
    named = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("name"),
                                                  F.trim(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    headers = F.when(has_head, named).otherwise(F.array().cast("array<struct<name: string, value: string>>"))
    payload = F.when(has_head, F.coalesce(F.get(cut, F.lit(1)), F.lit(""))).otherwise(text)
    out = found.withColumn("http_status", F.when(has_head, F.regexp_extract(text, r"^HTTP/[0-9.]+ +([0-9]{3})", 1).cast("int")))
    out = out.withColumns({"http_headers": headers, "payload": payload})
    kind = F.get(F.filter("http_headers", lambda h: h["name"] == "content-type"), F.lit(0)).getField("value")
    return out.withColumns({"http_content_type": kind, "payload_digest": digest(F.col("payload"))})


def _field(name: str, value: Column) -> Column:
    """``name: value`` and a line end, or nothing for a NULL or empty value."""
    return F.when(F.length(value) > 0, F.concat(F.lit(name + ": "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def derive(found: DataFrame) -> DataFrame:
    """Metadata and conversion records of response records (columns of ``responses``)."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    one_line = lambda c: F.trim(F.regexp_replace(c, F.lit(r"\s+"), F.lit(" ")))
    bare = lambda x: F.when(x.startswith('"') | x.startswith("'"), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x)
    links = F.transform(F.regexp_extract_all(payload, F.lit(LINK), F.lit(1)), bare)
    others = F.lit("")
    if "http_headers" in found.columns:  # the other headers of the source, as they came
        rest = F.filter("http_headers", lambda h: h["name"] != "content-type")
        others = F.array_join(F.transform(rest, lambda h: F.concat(F.lit("source-"), h["name"], F.lit(": "), one_line(h["value"]), F.lit("\r\n"))), "")
    base = found.select(
        "page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest",
        F.coalesce(F.col("record_id"), record_id(F.lit("none"), F.col("target_uri"), F.col("date"), F.col("payload_digest"))).alias("_of"),
        plain_text(payload).alias("_text"),
        F.concat(_field("source-content-type", F.col("http_content_type")), others, _field("title", one_line(F.regexp_extract(payload, TITLE, 1))),
                 _field("language", F.regexp_extract(payload, LANGUAGE, 1)), _field("outlinks", F.size(links).cast("string")),
                 F.array_join(F.transform(links, lambda x: F.concat(F.lit("outlink: "), x, F.lit("\r\n"))), "")).alias("_fields"))
    kinds = F.explode(F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.col("_fields").alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("_text").alias("block"))))
    out = base.select("page_id", "refers_to", "target_uri", "date", "payload_digest", "_of", kinds.alias("k")).select(
        "page_id", "k.record_type", record_id(F.col("k.record_type"), F.col("_of")).alias("record_id"), "refers_to",
        F.when(F.col("k.record_type") == "conversion", record_id(F.lit("metadata"), F.col("_of"))).alias("concurrent_to"),
        "target_uri", "date", "k.content_type", F.octet_length("k.block").cast("long").alias("content_length"),
        F.col("payload_digest").alias("source_digest"), digest(F.col("k.block")).alias("block_digest"), "k.block")
    return out


def serialised(records: DataFrame) -> DataFrame:
    """One WARC/1.1 record per row, headers and block, ready for a text sink whose line
    separator is a line feed (the last one is left to it)."""
    c = F.col
    head = F.concat(
        F.lit("WARC/1.1\r\n"), _field("WARC-Type", c("record_type")), _field("WARC-Record-ID", c("record_id")), _field("WARC-Date", c("date")),
        _field("WARC-Target-URI", c("target_uri")), _field("WARC-Refers-To", c("refers_to")), _field("WARC-Concurrent-To", c("concurrent_to")),
        _field("X-Source-Payload-Digest", c("source_digest")), _field("WARC-Block-Digest", c("block_digest")), _field("Content-Type", c("content_type")),
        _field("Content-Length", c("content_length").cast("string")))
    return records.select(F.concat(head, F.lit("\r\n"), c("block"), F.lit("\r\n\r")).alias("value"))


def write(records: DataFrame, path: str) -> None:
    """WARC files, one per partition."""
    serialised(records).write.option("lineSep", "\n").option("compression", "none").text(path)
