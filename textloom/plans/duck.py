"""The same expressions as DuckDB SQL text, for the oracles: builders that take and return SQL."""

from __future__ import annotations

from textloom.functions import classify, html, text


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rx(c: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({c}, {lit(pattern)}, {lit(to)}, '{flags}')"


def named(c: str) -> str:
    for entity, plain in text.NAMED_ENTITIES:
        c = rx(c, entity, plain, "gi")
    return c


def numeric(c: str, pattern: str, value: str) -> str:
    """value: SQL of the code point in terms of m, the matched entity."""
    char = f"CASE WHEN {value} <= 1114111 THEN chr(({value})::INTEGER) ELSE m END"
    found = f"list_transform(regexp_extract_all({c}, {lit(pattern)}), lambda m: {char})"
    pieces = f"regexp_split_to_array({c}, {lit(pattern)})"
    return f"array_to_string(list_transform(list_zip({pieces}, {found}), lambda z: z[1] || coalesce(z[2], '')), '')"


def decimal_entities(c: str) -> str:
    return numeric(c, "&#[0-9]+;", "try_cast(substr(m, 3, length(m) - 3) AS BIGINT)")


def hex_entities(c: str) -> str:
    return numeric(c, "&#[xX][0-9a-fA-F]+;", "try_cast('0x' || substr(m, 4, length(m) - 4) AS BIGINT)")


def whitespace(c: str) -> str:
    return f"trim({rx(c, text.WS_CLASS + '+', ' ')}, ' ')"


def mojibake(c: str) -> str:
    for a, b in text.MOJIBAKE * 2:
        c = f"replace({c}, {lit(a)}, {lit(b)})"
    return c


def normalize(c: str) -> str:
    return mojibake(whitespace(named(c)))


def title(c: str) -> str:
    raw = f"regexp_extract({c}, {lit(html.TITLE)}, 1)"
    return normalize(rx(raw, html.TAG, " "))


def strip(c: str) -> str:
    for name in html.DROPPED_ELEMENTS:
        c = rx(c, rf"<{name}\b[^>]*>[\s\S]*?</{name}>", " ", "gi")
    c = rx(c, html.COMMENT, " ")
    c = rx(c, f"</({'|'.join(html.BLOCK_CLOSERS)})>", " ", "gi")
    return rx(c, html.TAG, " ")


def body(c: str) -> str:
    return normalize(strip(c))


def any_of(c: str, phrases: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, {lit(p)})" for p in phrases) + ")"


def needs_browser(status: str, page: str, shown: str) -> str:
    low = f"lower({page})"
    return (
        f"({status} >= 400 OR length({page}) < {classify.MIN_HTML} OR length({shown}) < {classify.MIN_TEXT} OR "
        f"{any_of(low, classify.BROWSER_PHRASES)} OR (contains({low}, {lit(classify.APP_MARKER)}) AND length({shown}) < {classify.MIN_APP_TEXT}))"
    )


def status_of(done: str, total: str, failed: str) -> str:
    return f"CASE WHEN {done} >= {total} AND {total} > 0 THEN CASE WHEN {failed} > 0 THEN 'completed_with_errors' ELSE 'completed' END WHEN {done} = 0 THEN 'queued' ELSE 'processing' END"
