"""WARC derivatives: from each response record a metadata and a plain-text conversion record.

Both point to their source by WARC-Refers-To and carry its target, date, HTTP
head and payload digest on. Everything is column expressions: a row in, two rows
out, no shuffle. `write` gives WARC/1.1 files that any reader of the format takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: fixed values: elements whose content is no text, elements that break lines, and named characters
_HIDDEN = r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>|noscript\b.*?</noscript\s*>|template\b.*?</template\s*>)"
_BREAKS = (r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre"
           r"|section|table|td|th|title|tr|ul)\b[^>]*>")
_TAG = r"<[!/?a-zA-Z][^>]*>"
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&copy;", "©"), ("&reg;", "®"), ("&middot;", "·"),
            ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&euro;", "€"), ("&laquo;", "«"), ("&raquo;", "»"), ("&amp;", "&"))
_TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
_LINK = r'(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"'


def digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A UUID that the parts decide."""
    h = F.md5(F.concat_ws("\n", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])


def responses(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of (page_id, url, html): page_id, record_id, target_uri, date, http, payload.

    Null addresses and pages are empty. `date` is that of the crawl, which the
    table does not have. Further columns are left out.
    """
    url, html = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("url", "html"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"))
    return pages.select(F.col("page_id").cast("long").alias("page_id"),
                        record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"),
                        url.alias("target_uri"), F.lit(date).alias("date"), head.alias("http"), html.alias("payload"))


def _numbered(text: Column) -> Column:
    """Numeric character references; those of no valid character stay as they are."""
    def one(p: Column) -> Column:
        number = F.regexp_extract(p, r"^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        code = F.when(number.startswith("x"), F.conv(F.substring(number, 2, 6), 16, 10)).otherwise(number).cast("long")
        valid = (number != "") & code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.call_function("substring", p, F.length(number) + 2)
        return F.when(valid, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), p))

    parts = F.split(text, "&#")
    tail = F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), one), "")
    return F.when(text.contains("&#"), F.concat(parts[0], tail)).otherwise(text)


def plain_text(html: Column) -> Column:
    """Text of a page: hidden elements out, block elements break lines, references decoded, white space folded."""
    return _folded(_numbered(_bare(html)))


def _bare(html: Column) -> Column:
    text = F.regexp_replace(html, _HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(text, _BREAKS, "\n"), _TAG, "")


def _folded(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    # one blank, or one line end without blanks, stays as it is and is no match
    text = F.regexp_replace(text, r"[\t\r\f\x0b][ \t\r\f\x0b]*| [ \t\r\f\x0b]+", " ")
    return F.trim(F.regexp_replace(text, r" \n[ \n]*|\n[ \n]+", "\n"), F.lit(" \n"))


def _metadata() -> Column:
    http = F.col("http")
    return F.to_json(F.struct(F.struct(
        F.struct(F.lit("response").alias("WARC-Type"), F.col("record_id").alias("WARC-Record-ID"), F.col("target_uri").alias("WARC-Target-URI"),
                 F.col("date").alias("WARC-Date"), digest(F.col("payload")).alias("WARC-Payload-Digest")).alias("WARC-Header-Metadata"),
        F.struct(F.struct(http.alias("Headers"), F.octet_length("payload").alias("Entity-Length"),
                          F.struct(F.regexp_extract("payload", _TITLE, 1).alias("Title"),
                                   F.regexp_extract_all("payload", F.lit(_LINK), 1).alias("Links")).alias("HTML-Metadata"),
                          ).alias("HTTP-Response-Metadata")).alias("Payload-Metadata")).alias("Envelope")))


def derive(records: DataFrame) -> DataFrame:
    """Two records of each response, `metadata` and `conversion`, with what they keep of it.

    `records`: page_id, record_id, target_uri, date, http, payload. A record
    whose payload is empty gives a conversion of no text; repeated records give
    repeated derivatives with equal ids.
    """
    both = F.array(F.struct(F.lit("metadata").alias("type"), F.lit("application/json").alias("content_type"), _metadata().alias("content")),
                   F.struct(F.lit("conversion").alias("type"), F.lit("text/plain").alias("content_type"), F.col("_plain").alias("content")))
    # columns of their own: inside one expression the text would be worked out once for each of its uses
    plain = records.withColumn("_bare", _bare(F.col("payload"))).withColumn("_plain", _folded(_numbered(F.col("_bare")))).drop("_bare")
    return (plain.withColumn("source_digest", digest(F.col("payload"))).withColumn("d", F.explode(both))
            .select("page_id", F.col("d.type").alias("record_type"), record_id(F.col("d.type"), F.col("record_id")).alias("record_id"),
                    F.col("record_id").alias("refers_to"), "target_uri", F.col("date").alias("warc_date"), F.col("d.content_type").alias("content_type"),
                    F.col("http").alias("source_headers"), "source_digest", digest(F.col("d.content")).alias("block_digest"),
                    F.octet_length("d.content").cast("long").alias("content_length"), F.col("d.content").alias("content")))


def record_text(name: str = "record") -> Column:
    """A derived record as it stands in a file, without the two empty lines that end it."""
    lines = [("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"),
             ("WARC-Date", "warc_date"), ("WARC-Source-Payload-Digest", "source_digest"), ("WARC-Block-Digest", "block_digest"),
             ("Content-Type", "content_type"), ("Content-Length", "content_length")]
    head = [F.concat(F.lit(f"{k}: "), F.col(c).cast("string")) for k, c in lines]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *head), F.lit("\r\n\r\n"), F.col("content")).alias(name)


def write(derived: DataFrame, path: str) -> None:
    """One file for each partition, every record ended by two empty lines."""
    derived.select(record_text()).write.option("lineSep", "\r\n\r\n").text(path)
