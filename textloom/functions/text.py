r"""Text-repair expressions: every function maps Column to Column and stays in the JVM.

Null in gives "" out, as the repair steps stringify first. Lengths are counted in
UTF-16 units where a function says so; everything else counts code points.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_TEXT_LENGTH = 50_000

#: What ECMAScript counts as whitespace, since Java's \s differs; reads the same in RE2.
WS_ASCII = r"\t\n\x0B\f\r "
WS_OTHER = r"\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WS_CLASS = f"[{WS_ASCII}{WS_OTHER}]"

#: How the characters of WS_OTHER begin in UTF-8; a text without these bytes has none of them.
WS_OTHER_BYTES = [b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80", b"\xef\xbb\xbf"]

#: Entity and its replacement; the order decides double decoding.
NAMED_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&quot;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&#x27;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
]

#: Broken sequence and its repair, in order of application.
MOJIBAKE = [
    ("Ã‡", "Ç"),
    ("Ã§", "ç"),
    ("Äž", "Ğ"),
    ("ÄŸ", "ğ"),
    ("Ä°", "İ"),
    ("Ä±", "ı"),
    ("Ã–", "Ö"),
    ("Ã¶", "ö"),
    ("Åž", "Ş"),
    ("ÅŸ", "ş"),
    ("Ãœ", "Ü"),
    ("Ã¼", "ü"),
    ("â€™", "'"),
    ("â€˜", "'"),
    ("â€œ", '"'),
    ("â€\u009d", '"'),
    ("â€“", "-"),
    ("â€”", "—"),
    ("â€¦", "…"),
    ("Â©", "©"),
    ("Â®", "®"),
    ("Â", ""),
]

#: Characters whose frequency betrays a wrong decoding.
MOJIBAKE_MARKS = "ÃÄÅÂâ€"


def stringify(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def bind(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f refers to it.

    Without it each reference repeats the whole chain below: three references at each of five
    steps put a page's regular expressions into the plan more than a hundred times.
    """
    return F.get(F.transform(F.array(c), f), F.lit(0))


def decode_named_entities(c: Column) -> Column:
    """Entities in lower case by plain search; regular expressions only where a capital may be part of one."""

    def decoded(x: Column) -> Column:
        plain = spelled = x
        for entity, char in NAMED_ENTITIES:
            plain = F.replace(plain, F.lit(entity), F.lit(char))
            spelled = F.regexp_replace(spelled, F.lit(f"(?i){entity}"), F.lit(char))
        # after a semicolon too: decoding &amp; puts an ampersand there
        return F.when(~x.contains("&"), x).when(x.rlike("[&;][A-Za-z#0-9]*[A-Z]"), spelled).otherwise(plain)

    return bind(c, decoded)


def _code_point(n: Column, source: Column) -> Column:
    """n (long, null if out of range) as a character; out of range gives the source text back.

    Lone surrogates can't be stored in UTF-8 and become U+FFFD; U+FEFF is spelled out
    because a UTF-32 decoder takes it for a byte-order mark.
    """
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return (
        F.when(n.isNull(), source)
        .when(n.between(0xD800, 0xDFFF), F.lit("\ufffd"))
        .when(n == 0xFEFF, F.lit("\ufeff"))
        .otherwise(char)
    )


def _decode_numeric(c: Column, pattern: str, prefix: int, base: int, digits: int) -> Column:
    def char_of(entity: Column) -> Column:
        code = F.substring(entity, prefix + 1, 1_000_000_000)
        code = F.regexp_replace(F.rtrim(F.translate(code, ";", " ")), "^0+(?=.)", "")
        n = F.conv(F.when(F.length(code) <= digits, code), base, 10).cast("bigint")
        return _code_point(F.when(n <= 0x10FFFF, n), entity)

    def decoded(x: Column) -> Column:
        pieces = F.split(x, pattern, -1)
        found = F.regexp_extract_all(x, F.lit(pattern), F.lit(0))
        woven = F.zip_with(pieces, found, lambda a, b: F.concat(a, F.when(b.isNull(), "").otherwise(char_of(b))))
        return F.when(x.contains("&#") & x.rlike(pattern), F.array_join(woven, "")).otherwise(x)

    return bind(c, decoded)


def decode_decimal_entities(c: Column) -> Column:
    return _decode_numeric(c, "&#[0-9]+;", 2, 10, 7)


def decode_hex_entities(c: Column) -> Column:
    return _decode_numeric(c, "&#[xX][0-9a-fA-F]+;", 3, 16, 6)


def decode_entities(c: Column) -> Column:
    """Named, then decimal, then hexadecimal, so that &amp;lt; and &#38;#x41; decode twice."""
    return decode_hex_entities(decode_decimal_entities(decode_named_entities(stringify(c))))


def collapse_whitespace(c: Column) -> Column:
    """Runs of whitespace to one space, none at the ends. A lone space is no match: most are, and each match costs."""

    def plain(x: Column) -> Column:
        data = x.cast("binary")
        other = reduce(lambda a, b: a | b, [F.contains(data, F.lit(p)) for p in WS_OTHER_BYTES])
        return F.when(other, F.regexp_replace(x, f"[{WS_OTHER}]", " ")).otherwise(x)

    runs = f" [{WS_ASCII}]+|[{WS_ASCII[:-1]}][{WS_ASCII}]*"
    return F.trim(F.regexp_replace(bind(c, plain), runs, " "))


def repair_mojibake(c: Column) -> Column:
    """Two passes: deleting a stray mark in the first can complete a pair for the second."""
    leads = "[" + "".join(sorted({a[0] for a, _ in MOJIBAKE})) + "]"

    def repaired(x: Column) -> Column:
        y = x
        for broken, good in MOJIBAKE * 2:
            y = F.replace(y, F.lit(broken), F.lit(good))
        some = reduce(lambda a, b: a | b, [x.contains(broken) for broken, _ in MOJIBAKE])
        return F.when(x.rlike(leads) & some, y).otherwise(x)

    return bind(stringify(c), repaired)


def normalize_text(c: Column) -> Column:
    """Decode, collapse, trim, then repair: what repair deletes may leave spaces behind."""
    return repair_mojibake(collapse_whitespace(decode_entities(c)))


def mojibake_score(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, MOJIBAKE_MARKS, ""))


def decode_utf8(body: Column) -> Column:
    """Lossy decoding; one leading byte-order mark goes."""
    bom = F.substring(body, 1, 3) == F.unhex(F.lit("EFBBBF"))
    rest = F.when(bom, F.substring(body, 4, 2_147_483_647)).otherwise(body)
    return F.make_valid_utf8(rest.cast("string"))


def _cp1252_high() -> tuple[str, str]:
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((chr(b), bytes([b]).decode("cp1252")))
        except UnicodeDecodeError:  # the five bytes without a character stay C1 controls
            pass
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def decode_windows1252(body: Column) -> Column:
    return F.translate(F.decode(body, "ISO-8859-1"), *_cp1252_high())


def decode_body(body: Column) -> Column:
    """The decoding with fewer mojibake marks; UTF-8 wins ties, an empty one loses."""

    def chosen(both: Column) -> Column:
        utf8, western = both["u"], both["w"]
        return (
            F.when((utf8 != "") & (mojibake_score(utf8) <= mojibake_score(western)), utf8)
            .when(western != "", western)
            .otherwise(utf8)
        )

    return bind(F.struct(decode_utf8(body).alias("u"), decode_windows1252(body).alias("w")), chosen)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("bigint")


def truncate_text(c: Column, limit: int = MAX_TEXT_LENGTH) -> Column:
    """The first `limit` UTF-16 units; half of a character cut in two is dropped."""
    units = F.encode(c, "UTF-16BE")
    last = F.conv(F.hex(F.substring(units, 2 * limit - 1, 1)), 16, 10).cast("int")
    kept = F.when(last.between(0xD8, 0xDB), 2 * limit - 2).otherwise(2 * limit)
    return (
        F.when(F.length(c) == utf16_length(c), F.substring(c, 1, limit))
        .when(utf16_length(c) <= limit, c)
        .otherwise(F.decode(F.substring(units, F.lit(1), kept), "UTF-16BE"))
    )


def pad_number(n: Column, width: int) -> Column:
    """Zero padding that never cuts longer numbers."""
    text = n.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def retry_delay_seconds(attempts: Column) -> Column:
    return F.least(F.lit(30), F.greatest(F.lit(2), F.pow(F.lit(2.0), attempts))).cast("bigint")
