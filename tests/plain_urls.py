"""The public WHATWG algorithm for http and https URLs, one URL at a time: what the columns are held against."""

import re

from textloom.functions.urls import INVALID_URL, ONLY_HTTP, SPECIAL_PORTS, _host


def _escape(text: str, also: str) -> str:
    out = []
    for b in text.encode("utf-8", "replace"):
        c = chr(b)
        out.append(f"%{b:02X}" if b <= 0x1F or b > 0x7E or c in also else c)
    return "".join(out)


def canonicalize(text: str) -> tuple[str | None, str | None]:
    """(canonical, None), or (None, message). The public WHATWG algorithm for http and https."""
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(0x21)))))
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", text)
    if not m:
        return None, INVALID_URL
    scheme, rest = m[1].lower(), text[m.end():]
    if scheme not in SPECIAL_PORTS:
        return None, ONLY_HTTP
    rest, hash_, fragment = rest.partition("#")
    rest, mark, query = rest.partition("?")
    rest = re.sub(r"^[/\\]*", "", rest)
    cut = re.search(r"[/\\]", rest)
    authority, path = (rest[:cut.start()], rest[cut.start():]) if cut else (rest, "")
    login, at, where = authority.rpartition("@")
    try:
        port = ""
        if (p := re.search(r":([^:\]]*)$", where)) and not where.endswith("]"):
            where, port = where[:p.start()], p[1]
        if port and not (port.isascii() and port.isdigit() and int(port) <= 65535):
            raise ValueError(port)
        host = _host(where)
    except (ValueError, UnicodeError):
        return None, INVALID_URL
    if scheme not in ("http", "https"):
        return None, ONLY_HTTP
    out, dots = [], re.compile(r"(?:\.|%2e)", re.I)
    parts = re.split(r"[/\\]", path)[1:] or [""]
    for i, part in enumerate(parts):
        plain = dots.sub(".", part)
        last = i == len(parts) - 1
        if plain == "..":
            out[-1:] = []
        if plain in (".", ".."):
            out += [""] * last
        else:
            out.append(_escape(part, ' "#<>?^`{}'))
    user, colon, word = login.partition(":")
    userinfo = " \"#<>?^`{}/:;=@[\\]|"
    credentials = (_escape(user, userinfo) + (":" + _escape(word, userinfo) if word else "") + "@") if at and (user or word) else ""
    shown_port = f":{int(port)}" if port and int(port) != SPECIAL_PORTS[scheme] else ""
    tail = ("?" + _escape(query, " \"#<>'") if mark else "") + ("#" + _escape(fragment, ' "<>`') if hash_ else "")
    return f"{scheme}://{credentials}{host}{shown_port}/{'/'.join(out)}{tail}", None
