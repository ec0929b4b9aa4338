r"""WARC derivatives: from each response a metadata record and a plain-text conversion record.

A response is a row with record_id, target_uri, warc_date and block (the HTTP message). Both
derivatives refer to it by WARC-Refers-To (and its URI and date), and the metadata record has
the source's header lines as they were and its payload digest. Everything is a projection: no
shuffle, no Python; record ids are name-based UUIDs, so a task that runs again writes the
same records.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.html import text_of, title_of
from textloom.llm.common import text_or_empty
from textloom.plans import duck

DATE = "1970-01-01T00:00:00Z"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HREF = r'(?i)<a\s[^>]*href="([^"]*)"'
CRLF = "\r\n"


def sha1_base32(data: Column) -> Column:
    """The labelled digest of WARC files. 40 bits, 10 hexadecimal digits, are 8 digits to base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(data), 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.concat(F.lit("sha1:"), F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32))


def urn(*names: Column) -> Column:
    """A name-based UUID (version 5 in form) of the names, as a record id."""
    h = F.sha1(F.concat_ws("\n", *names))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"),
        variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12), F.lit(">"),
    )


RESPONSE = ("record_id", "target_uri", "warc_date", "block")
DERIVED = ("warc_type", "record_id", "refers_to", "refers_to_uri", "refers_to_date", "content_type", "content_length", "block_digest", "block")


def _beside(columns: Iterable[str], own: tuple[str, ...]) -> list[str]:
    """The columns' names, with underscores before those that own or an earlier one has; case doesn't make a difference."""
    out, taken = [], set(own)
    for c in columns:
        while c.lower() in taken:
            c = "_" + c
        taken.add(c.lower())
        out.append(c)
    return out


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of stored pages (page_id, url, html). Null url and html count as empty.

    The other columns stay; one named as a record's column gets an underscore before its name.
    """
    html = text_or_empty("html")
    head = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(html).cast("string"), F.lit(CRLF + CRLF))
    uri = text_or_empty("url")
    others = [c for c in pages.columns if c != "html"]
    return pages.select(
        *[F.col(c).alias(n) for c, n in zip(others, _beside(others, RESPONSE), strict=True)],
        urn(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri).alias("record_id"),
        uri.alias("target_uri"), F.lit(date).alias("warc_date"), F.concat(head, html).alias("block"),
    )


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(name + ": "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit(CRLF))


def derive(source: DataFrame, *carry: str) -> DataFrame:
    """Two rows a response: carry, warc_type, record_id, refers_to, refers_to_uri, refers_to_date,
    content_type, content_length (bytes), block_digest, block.

    The header ends at the first empty line; a block without one is all header. A null block
    counts as empty; responses without text get an empty conversion record; repeated rows give
    repeated records with the same ids; an empty table gives none. A carried column named as one of
    these gets an underscore before its name.
    """
    kept = [f"carried_{i}" for i in range(len(carry))]
    block = text_or_empty("block")
    split = F.instr(block, CRLF + CRLF)
    s = source.select(
        *[F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)], "record_id", "target_uri", "warc_date",
        F.when(split > 0, F.substring(block, F.lit(1), split - 1)).otherwise(block).alias("_head"),
        F.when(split > 0, F.substring(block, split + 4, F.length(block))).otherwise("").alias("_body"),
    )
    s = s.withColumns({
        "_text": text_of(F.col("_body")), "_title": title_of(F.col("_body")), "_digest": sha1_base32(F.col("_body")),
        "_links": F.array_distinct(F.regexp_extract_all("_body", F.lit(HREF), F.lit(1))),
    })
    fields = F.concat(
        _line("title", F.col("_title")), _line("source-payload-digest", F.col("_digest")), _line("source-status", F.regexp_extract("_head", r"^([^\r\n]*)", 1)),
        F.regexp_replace(F.regexp_replace("_head", r"^[^\r\n]*(?:\r\n)?", ""), r"(?m)^([^\r\n:]+:)", "source-header-$1"),
        F.when(F.instr("_head", CRLF) > 0, CRLF).otherwise(""),
        F.array_join(F.transform("_links", lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", " "), F.lit(CRLF))), ""),
    )

    def record(kind: str, content_type: str, content: Column) -> Column:
        return F.struct(F.lit(kind).alias("warc_type"), urn(F.lit(kind), F.col("record_id")).alias("record_id"), F.lit(content_type).alias("content_type"), content.alias("block"))

    both = F.array(record("metadata", "application/warc-fields", fields), record("conversion", "text/plain; charset=utf-8", F.col("_text")))
    r = s.select(*kept, F.col("record_id").alias("refers_to"), F.col("target_uri").alias("refers_to_uri"), F.col("warc_date").alias("refers_to_date"), F.explode(both).alias("r"))
    b = F.col("r.block")
    return r.select(
        *[F.col(k).alias(n) for k, n in zip(kept, _beside(carry, DERIVED), strict=True)], "r.warc_type", "r.record_id", "refers_to", "refers_to_uri", "refers_to_date", "r.content_type",
        F.octet_length(b).cast("bigint").alias("content_length"), sha1_base32(b).alias("block_digest"), b.alias("block"),
    )


def serialize(records: DataFrame) -> Column:
    """A derived record as it stands in a WARC/1.1 file."""
    lines = [
        ("WARC-Type", F.col("warc_type")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Date", F.col("refers_to_date")), ("WARC-Target-URI", F.col("refers_to_uri")),
        ("WARC-Refers-To", F.col("refers_to")), ("WARC-Refers-To-Target-URI", F.col("refers_to_uri")), ("WARC-Refers-To-Date", F.col("refers_to_date")),
        ("WARC-Block-Digest", F.col("block_digest")), ("Content-Type", F.col("content_type")), ("Content-Length", F.col("content_length").cast("string")),
    ]
    return F.concat(F.lit("WARC/1.1" + CRLF), *[_line(k, v) for k, v in lines], F.lit(CRLF), F.col("block"), F.lit(CRLF + CRLF))


def parse(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The records of a WARC file's bytes: (headers, block)."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(x.split(": ", 1) for x in data[at:end].decode("utf-8").split("\r\n")[1:])
        n = int(headers["Content-Length"])
        out.append((headers, data[end + 4 : end + 4 + n]))
        at = end + 4 + n + 4
    return out


def op1_warc(spark, sf_dir: str) -> DataFrame:
    from textloom.llm.common import read

    return derive(responses(read(spark, sf_dir, "pages", "page_id", "url", "html")), "page_id")


def _sql_digest(c: str) -> str:
    digit = f"substr('{BASE32}', (((('0x' || substr(h, 1 + 10 * p, 10))::UBIGINT >> (35 - 5 * q)) & 31) + 1)::INTEGER, 1)"
    return f"(SELECT 'sha1:' || string_agg({digit}, '' ORDER BY p, q) FROM (SELECT sha1({c}) AS h), range(4) a(p), range(8) b(q))"


def _sql_urn(c: str) -> str:
    return (
        f"(SELECT '<urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab')"
        f" || substr(h, 18, 3) || '-' || substr(h, 21, 12) || '>' FROM (SELECT sha1({c}) AS h))"
    )


_LF, _NL = "chr(13) || chr(10)", r"'[\r\n]+', ' ', 'g'"
OP1_SQL = rf"""
WITH s AS (SELECT page_id, coalesce(url, '') AS uri, coalesce(html, '') AS body, {_sql_urn("'response' || chr(10) || coalesce(page_id::VARCHAR, '') || chr(10) || coalesce(url, '')")} AS refers_to FROM pages),
t AS (SELECT *, {duck.body('body')} AS text, {duck.title('body')} AS title, {_sql_digest('body')} AS digest,
  list_transform(regexp_extract_all(body, '{HREF}', 1), lambda x: 'outlink: ' || regexp_replace(x, {_NL}) || {_LF}) AS links FROM s),
l AS (SELECT *, list_filter(links, lambda x, i: list_position(links, x) = i) AS firsts FROM t),
r AS (SELECT page_id, uri, refers_to, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
  'title: ' || regexp_replace(title, {_NL}) || {_LF} || 'source-payload-digest: ' || digest || {_LF} || 'source-status: HTTP/1.1 200 OK' || {_LF}
  || 'source-header-Content-Type: text/html; charset=utf-8' || {_LF} || 'source-header-Content-Length: ' || octet_length(encode(body)) || {_LF} || array_to_string(firsts, '') AS block FROM l
  UNION ALL SELECT page_id, uri, refers_to, 'conversion', 'text/plain; charset=utf-8', text FROM l)
SELECT page_id, warc_type, {_sql_urn("warc_type || chr(10) || refers_to")} AS record_id, refers_to, uri AS refers_to_uri, '{DATE}' AS refers_to_date, content_type,
  octet_length(encode(block))::BIGINT AS content_length, {_sql_digest('block')} AS block_digest, block FROM r
"""
