"""URL expressions: native predicates, and the WHATWG parser in columns.

Only hosts that columns can't judge (international names, numbers, IPv6) go to an Arrow UDF.
"""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import unquote_to_bytes

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions.text import bind

#: Observable messages.
INVALID_URL = "Geçersiz URL"
ONLY_HTTP = "Yalnızca HTTP ve HTTPS destekleniyor"
PRIVATE_HOST = "Yerel veya özel ağ adreslerine erişim yasak"
NOT_JSON = "Geçerli JSON gövdesi gerekli"
NOT_A_LIST = '"urls" bir dizi olmalı'
NO_URL = "En az bir URL gerekli"
TOO_MANY = "En fazla {} farklı URL gönderilebilir"

SPECIAL_PORTS = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}

#: Canonical already: lower-case DNS host that doesn't end in a number, no port, plain characters.
CLEAN = r"^https?://([a-z0-9-]+\.)*[a-z][a-z0-9]*/[A-Za-z0-9_.~!$&()*+,;=:@/-]*(\?[A-Za-z0-9_.~!$&()*+,;=:@/?-]*)?(#[A-Za-z0-9_.~!$&()*+,;=:@/?-]*)?$"
DOTTED = r"/\.{1,2}(/|\?|#|$)|xn--"


def is_private_host(host: Column) -> Column:
    """Literal prefix rules: DNS names that begin with fc or fd count, bracketed IPv6 doesn't."""
    h = F.lower(host)
    octet = F.regexp_extract(h, r"^172\.0*([0-9]{1,9})\.", 1)
    tests = [
        h == "localhost",
        h.endswith(".localhost"),
        h.endswith(".local"),
        *[h.startswith(p) for p in ("127.", "10.", "192.168.", "169.254.")],
        F.when(octet != "", octet.cast("int").between(16, 31)).otherwise(F.lit(False)),
        h.isin("0.0.0.0", "::1"),
        *[h.startswith(p) for p in ("fc", "fd", "fe80:")],
    ]
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def is_private_host_strict(host: Column) -> Column:
    """An extension: the same for bracketed IPv6 literals, and no DNS names that begin with fc or fd."""
    h = F.regexp_replace(F.lower(host), r"^\[|\]$", "")
    v6 = h.contains(":")
    named = ~v6 & (h.startswith("fc") | h.startswith("fd"))
    return is_private_host(h) & ~named


def host_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^[a-z]+://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1)


def path_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def is_special_site(canonical: Column) -> Column:
    """Match pages of one site that only a browser can open; unparsable gives false."""
    return F.coalesce(
        host_of(canonical).contains("flashscore.") & path_of(canonical).contains("/mac/"), F.lit(False)
    )


def decode_component(c: Column) -> Column:
    """Percent-decoding that leaves + alone; null where malformed."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def _number(part: str) -> int | None:
    if part == "":
        return None
    for prefix, base, digits in (("0x", 16, "0123456789abcdef"), ("0", 8, "01234567")):
        if part.lower().startswith(prefix) and len(part) > (0 if base == 16 else 1):
            rest = part[len(prefix):].lower()
            return (int(rest, base) if rest else 0) if all(c in digits for c in rest) else None
    return int(part) if part.isascii() and part.isdigit() else None


def _ipv4(host: str) -> str | None:
    """None if the host isn't an IPv4 address; raises ValueError if it's a broken one."""
    parts = host.split(".")
    if parts[-1] == "" and len(parts) > 1:
        parts.pop()
    last = parts[-1]
    if not (last.isascii() and last.isdigit()) and not re.fullmatch("0[xX][0-9a-fA-F]*", last):
        return None
    numbers = [_number(p) for p in parts]
    if len(parts) > 4 or None in numbers or any(n > 255 for n in numbers[:-1]) or numbers[-1] >= 256 ** (5 - len(numbers)):
        raise ValueError(host)
    value = numbers[-1] + sum(n * 256 ** (3 - i) for i, n in enumerate(numbers[:-1]))
    return ".".join(str(value >> s & 255) for s in (24, 16, 8, 0))


def _ipv6(text: str) -> str:
    import ipaddress

    if "%" in text:
        raise ValueError(text)
    words = [int(x, 16) for x in ipaddress.IPv6Address(text).exploded.split(":")]
    best, at = 1, -1
    i = 0
    while i < 8:
        j = i
        while j < 8 and words[j] == 0:
            j += 1
        if j - i > best:
            best, at = j - i, i
        i = max(j, i + 1)
    shown = [f"{w:x}" for w in words]
    if at < 0:
        return "[" + ":".join(shown) + "]"
    return "[" + ":".join(shown[:at]) + "::" + ":".join(shown[at + best:]) + "]"


def _host(text: str) -> str:
    if text.startswith("["):
        if not text.endswith("]"):
            raise ValueError(text)
        return _ipv6(text[1:-1])
    name = unquote_to_bytes(text).decode("utf-8", "replace")
    if name.isascii() and "xn--" not in name.lower():
        name = name.lower()
    else:
        import idna

        name = idna.encode(name.lower(), uts46=True, transitional=False).decode("ascii")
    if not name or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", name):
        raise ValueError(text)
    address = _ipv4(name)
    return address if address is not None else name


#: Scheme, login, host, port, path, query with its mark, fragment with its mark, of a text without line breaks.
SPLIT = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*):[/\\]*(?:([^/\\?#]*)@)?([^/\\?#@]*?)(?::([^:\]/\\?#@]*))?(?=[/\\?#]|\z)([^?#]*)(\?[^#]*)?(#.*)?\z"
SCHEME, LOGIN, HOST, PORT, PATH, QUERY, FRAGMENT = range(7)

#: Hosts that columns can't judge: percent-encoded, not ASCII, punycode, bracketed, or with a last label that may be a number.
UNUSUAL_HOST = r"(?i)%|[^\x00-\x7F]|xn--|^\[|(^|\.)([0-9]+|0x[0-9a-f]*)\.?\z"
#: Begins with a host that is certainly not unusual, so that most URLs aren't taken apart to see it.
USUAL = r"(?i)^(?:https?|ftp|wss?)://(?![^/?#]*xn--)(?:[a-z0-9_-]+\.)+[a-z][a-z_-]*(?:[/?#]|\z)"
DOTTED_QUAD = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!\z)|\z)){4}\z"
BAD_HOST = r"[\x00-\x20#%/:<>?@\[\\\]^|\x7F]"

#: What is percent-encoded in each part, beside control characters and what isn't ASCII.
IN_LOGIN, IN_PATH, IN_QUERY, IN_FRAGMENT = " \"#<>?^`{}/:;=@[\\]|", ' "#<>?^`{}', " \"#<>'", ' "<>`'

DOT, TWO_DOTS = r"(?i)^(?:\.|%2e)\z", r"(?i)^(?:\.|%2e){2}\z"
HAS_DOTS = r"(?i)[/\\](?:\.|%2e){1,2}(?:[/\\]|\z)"


def percent_encode(c: Column, also: str) -> Column:
    """c with the UTF-8 bytes of control characters, of what isn't ASCII and of `also` as %XX. Runs of such characters are encoded at once."""
    plain = "".join(f"\\x{b:02X}" for b in range(0x20, 0x7F) if chr(b) not in also)
    runs = F.regexp_extract_all(c, F.lit(f"[{plain}]+|[^{plain}]+"), F.lit(0))
    coded = F.transform(runs, lambda r: F.when(r.rlike(f"^[{plain}]"), r).otherwise(F.regexp_replace(F.hex(r), "(..)", "%$1")))
    return F.when(c.rlike(f"[^{plain}]"), F.array_join(coded, "")).otherwise(c)


def resolve_dots(path: Column) -> Column:
    """The segments of a path (empty, or one that begins with a slash or backslash), without dot segments."""

    def step(out: Column, x: Column) -> Column:
        return F.when(x.rlike(TWO_DOTS), F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).when(x.rlike(DOT), out).otherwise(F.concat(out, F.array(x)))

    def resolved(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        ends = F.when(last.rlike(DOT) | last.rlike(TWO_DOTS), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.aggregate(parts, F.array().cast("array<string>"), step), ends)

    parts = bind(F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]", -1), resolved)
    return F.when(path.rlike(HAS_DOTS), F.array_join(parts, "/")).otherwise(F.translate(F.regexp_replace(path, r"^[/\\]", ""), "\\", "/"))


def _parts(url: Column) -> Column:
    """The parts that SPLIT finds, as an array; one element where there's no scheme. Line breaks, which no URL keeps, are between them."""
    text = F.regexp_replace(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\n\r]+", "")
    return F.split(F.regexp_replace(text, SPLIT, "\n".join(f"${i + 1}" for i in range(7))), "\n", -1)


def _unusual_hosts(hosts: pd.Series) -> pd.Series:
    def one(host: str | None) -> str | None:
        try:
            return None if host is None else _host(host)
        except (ValueError, UnicodeError):
            return None

    return pd.Series([one(h) for h in hosts], dtype=object)


def unusual_host(url: Column) -> Column:
    """The host of a URL that only Python can judge (international names, numbers, IPv6); null for all others, which never reach it."""
    host = F.get(_parts(F.when(~url.rlike(USUAL), url)), F.lit(HOST))
    return F.when(host.rlike(UNUSUAL_HOST) & ~host.rlike(DOTTED_QUAD), host)


def _serialized(parts: Column, judged: Column) -> Column:
    """struct<canonical, error> of a URL's parts; judged: its host if that is unusual, null if such a host is broken."""
    at = lambda i: F.get(parts, F.lit(i))
    scheme = F.lower(at(SCHEME))
    host = at(HOST)
    odd = host.rlike(UNUSUAL_HOST) & ~host.rlike(DOTTED_QUAD)
    host = F.when(odd, judged).when((host != "") & ~host.rlike(BAD_HOST), F.lower(host))  # null: broken
    digits = F.regexp_replace(at(PORT), "^0+(?=.)", "")
    port = digits.try_cast("bigint")
    port_ok = (at(PORT) == "") | (digits.rlike(r"^[0-9]{1,5}\z") & (port <= 65535))
    ports = F.create_map(*[F.lit(x) for pair in SPECIAL_PORTS.items() for x in pair])
    web = scheme.isin("http", "https")
    error = (
        F.when(F.size(parts) == 1, INVALID_URL).when(~scheme.isin(*SPECIAL_PORTS), ONLY_HTTP)
        .when(host.isNull() | ~port_ok, INVALID_URL).when(~web, ONLY_HTTP)
    )
    user, word = F.substring_index(at(LOGIN), ":", 1), F.regexp_extract(at(LOGIN), r"(?s)^[^:]*:(.*)\z", 1)
    login = F.when(at(LOGIN).isin("", ":"), "").otherwise(F.concat(percent_encode(user, IN_LOGIN), F.when(word != "", F.concat(F.lit(":"), percent_encode(word, IN_LOGIN))).otherwise(""), F.lit("@")))
    shown = F.when((digits != "") & (port != F.get(F.map_values(F.map_filter(ports, lambda k, _: k == scheme)), F.lit(0))), F.concat(F.lit(":"), digits)).otherwise("")
    tail = F.concat(percent_encode(at(QUERY), IN_QUERY), percent_encode(at(FRAGMENT), IN_FRAGMENT))
    path = bind(resolve_dots(at(PATH)), lambda p: percent_encode(p, IN_PATH))
    canonical = F.concat(scheme, F.lit("://"), login, host, shown, F.lit("/"), path, tail)
    return F.struct(F.when(error.isNull(), canonical).alias("canonical"), error.alias("error"))


def parse_url(url: Column) -> Column:
    """struct<canonical, error>: parseable, then http or https, then not a private host.

    The public WHATWG algorithm in columns: parts by one expression, dot segments by a fold, percent-encoding by runs. Only
    hosts that columns can't judge (unusual_host) go to Python, without the rest of their URLs.
    """
    clean = F.coalesce(url.rlike(CLEAN) & ~url.rlike(DOTTED), F.lit(False))
    judged = F.pandas_udf(_unusual_hosts, T.StringType())(F.when(~clean, unusual_host(url)))
    given = F.struct(_parts(F.coalesce(url, F.lit(""))).alias("parts"), judged.alias("judged"))
    usual = F.struct(url.alias("canonical"), F.lit(None).cast("string").alias("error"))
    parsed = F.when(clean, usual).otherwise(bind(given, lambda g: _serialized(g["parts"], g["judged"])))

    def public(p: Column) -> Column:
        error = F.coalesce(p["error"], F.when(bind(host_of(p["canonical"]), is_private_host), PRIVATE_HOST))
        return F.struct(F.when(error.isNull(), p["canonical"]).alias("canonical"), error.alias("error"))

    return bind(parsed, public)
