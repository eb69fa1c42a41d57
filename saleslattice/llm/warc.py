"""WARC derivatives: response records to plain-text conversion and metadata records.

``derive(pages)`` gives two records a page. Both refer to the response: its record id (WARC-Refers-To), target URI and
date (WARC-Refers-To-Target-URI, WARC-Refers-To-Date) and digests; the metadata record keeps the source's headers and
the page's link count and title, as header fields: white space in values is folded, control characters go. The source's date is that of its Date header, else the parameter. Record ids are
name-based, so a repeated run writes the same records. All work is in built-in expressions, each linear in the page: an
element or comment that is never closed ends with the page.

Null html is an empty response; null or blank url gives a null target URI, others lose control characters and have blanks
percent-encoded; repeated rows give repeated records (ids
differ by page_id only). Pages with a null page_id get ids made of the other fields. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
DATE = "2020-01-01T00:00:00Z"


def uuid_of(*parts: Column) -> Column:
    """urn:uuid from the SHA-256 of the parts."""
    h = F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (14, 3), (18, 3), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), cut[0], F.lit("-"), cut[1], F.lit("-5"), cut[2], F.lit("-8"), cut[3], F.lit("-"), cut[4], F.lit(">"))


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def numbered(text: Column) -> Column:
    """text with numeric entities read; those that name no character stay."""
    def read(part: Column, i: Column) -> Column:
        code = F.regexp_extract(part, "^(x[0-9a-fA-F]{1,6}|[0-9]{1,7});", 1)
        n = F.when(code.startswith("x"), F.conv(F.substring(code, 2, 6), 16, 10)).otherwise(code).try_cast("int")
        ok = n.between(1, 0xD7FF) | n.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        rest = F.substring(part, F.length(code) + 2, F.length(part))
        return F.when(i == 0, part).when(ok, F.concat(char, rest)).otherwise(F.concat(F.lit("&#"), part))

    return F.array_join(F.transform(F.split(text, "&#"), read), "")


def entities(text: Column) -> Column:
    """text with numeric entities and the usual named ones read."""
    text = numbered(text)
    for name, to in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(to))
    return text


def one_line(text: Column) -> Column:
    """text as the value of a header: white space folded, control characters gone."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\s\x{85}\x{2028}\x{2029}]+", " "), r"[\x00-\x1f\x7f]", ""))


def clean_uri(url: Column) -> Column:
    """url as a header may hold it: control characters go, blanks inside are percent-encoded; null if nothing is left."""
    return F.nullif(F.replace(F.trim(F.regexp_replace(url, r"[\x00-\x1f\x7f]", "")), F.lit(" "), F.lit("%20")), F.lit(""))


def source_fields(head: Column) -> Column:
    """An HTTP head as header fields: source-status, source-NAME for each header (folded lines put together), and source-line for
    what is no header."""
    lines = F.filter(F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n|\r"), lambda x: F.trim(x) != "")

    def field(x: Column, i: Column) -> Column:
        x = one_line(x)
        return F.concat(F.when(i == 0, "source-status: ").when(x.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+:"), "source-").otherwise("source-line: "), x, F.lit(CRLF))

    return F.array_join(F.transform(lines, field), "")


def http_date(head: Column) -> Column:
    """The Date header of an HTTP head in the form of WARC dates; null where there is none that can be read."""
    found = F.regexp_extract(head, r"(?im)^Date:[ \t]*(?:[a-z]+,[ \t]*)?(\d{1,2} [a-z]{3} \d{4} \d{2}:\d{2}:\d{2}) GMT[ \t]*\r?$", 1)
    return F.date_format(F.try_to_timestamp(found, F.lit("d MMM yyyy HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def plain_text(html: Column) -> Column:
    """Text of a page: scripts, styles, comments, head and navigation go, block ends become line ends, entities are read."""
    t = F.regexp_replace(html, r"(?s)<!--.*?(?:-->|\z)", "")
    t = F.concat(t, F.lit("</head></script></style></nav></noscript>"))  # so that what is open ends with the page
    t = F.regexp_replace(t, r"(?si)<head\b[^<>]*>.*?(?=</head\s*>|<body\b)", "")
    t = F.regexp_replace(t, r"(?si)<(script|style|nav|noscript)\b[^<>]*>.*?</\1\s*>", "")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</?(p|div|li|ul|ol|h[1-6]|tr|table|article|section|footer|header)\b[^<>]*>", "\n")
    t = F.regexp_replace(t, r"<[^<>]*>", "")
    t = entities(t)
    t = F.regexp_replace(t, r"[ \t\r\x{A0}]+", " ")
    return F.regexp_replace(F.regexp_replace(t, r" ?\n[ \n]*", "\n"), r"^[\n ]+|[\n ]+$", "")


def responses(pages: DataFrame) -> DataFrame:
    """Response fields of pages (page_id, url, html): HTTP head, payload, digests and record id. A captured head is kept."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    captured = html.startswith("HTTP/") & (F.instr(html, CRLF * 2) > 0)
    cut = F.instr(html, CRLF * 2)
    head = F.when(captured, F.expr("substring(html, 1, instr(html, '\r\n\r\n') + 1)"))
    payload = F.when(captured, F.expr("substring(html, instr(html, '\r\n\r\n') + 4)")).otherwise(html)
    out = pages.select(F.col("page_id"), clean_uri(F.col("url").cast("string")).alias("target_uri"), html.alias("html"))
    out = out.withColumns({"payload": payload, "head": F.coalesce(head, F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF)))})
    out = out.withColumn("block", F.concat("head", F.lit(CRLF), "payload"))
    return out.select("page_id", "target_uri", "head", "payload", digest(F.col("payload")).alias("payload_digest"), digest(F.col("block")).alias("block_digest"), uuid_of(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("-")), F.coalesce(F.col("target_uri"), F.lit("-")), F.sha2(F.col("payload").cast("binary"), 256)).alias("record_id"))


def derive(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, record_type, record_id, refers_to, target_uri, date, headers, block, block_digest, source digests."""
    r = responses(pages).withColumn("text", plain_text(F.col("payload")))
    title = one_line(entities(F.regexp_extract("payload", r"(?si)<title\b[^<>]*>(.*?)(?:</title|\z)", 1)))
    links = F.size(F.regexp_extract_all("payload", F.lit(r"(?i)<a\b[^>]*\bhref\s*="), F.lit(0)))
    meta = F.concat(F.lit("title: "), title, F.lit(f"{CRLF}outlinks: "), links.cast("string"), F.lit(f"{CRLF}text-length: "), F.octet_length("text").cast("string"), F.lit(CRLF))
    both = r.withColumns({"meta": meta}).select("*", F.explode(F.array(F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain").alias("content_type"), F.col("text").alias("block")), F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), F.concat("meta", source_fields(F.col("head"))).alias("block")))).alias("x"))
    out = both.select("page_id", "x.record_type", "x.content_type", "target_uri", F.coalesce(http_date(F.col("head")), F.lit(date)).alias("date"), F.col("record_id").alias("refers_to"), "payload_digest", F.col("block_digest").alias("source_block_digest"), F.col("head").alias("source_headers"), "x.block")
    return out.withColumns({"record_id": uuid_of(F.col("record_type"), F.col("refers_to")), "block_digest": digest(F.col("block"))})


def as_records(derived: DataFrame) -> DataFrame:
    """derived with record, the bytes of a WARC 1.1 record."""
    def line(name: str, c: Column) -> Column:
        return F.when(c.isNull(), "").otherwise(F.concat(F.lit(f"{name}: "), c, F.lit(CRLF)))

    head = F.concat(F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")), line("WARC-Refers-To-Target-URI", F.col("target_uri")), line("WARC-Refers-To-Date", F.col("date")), line("WARC-Target-URI", F.col("target_uri")), line("WARC-Date", F.col("date")), line("WARC-Block-Digest", F.col("block_digest")), line("WARC-Source-Payload-Digest", F.col("payload_digest")), line("Content-Type", F.col("content_type")), line("Content-Length", F.octet_length("block").cast("string")))
    return derived.withColumn("record", F.concat(head, F.lit(CRLF), "block", F.lit(CRLF * 2)).cast("binary"))


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    d = as_records(derive(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    fields = ("page_id", "record_type", "record_id", "refers_to", "target_uri", "date", "payload_digest", "source_block_digest", "block_digest", "source_headers")
    return d.select(*fields, F.octet_length("block").alias("block_bytes"), F.octet_length("record").alias("record_bytes"), F.sha2("record", 256).alias("record_sha256"))
