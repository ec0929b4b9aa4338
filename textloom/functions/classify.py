"""Page-classification predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.text import utf16_length

MIN_HTML, MIN_TEXT, MIN_APP_TEXT = 500, 80, 800

#: Phrases of pages that only a browser can read.
BROWSER_PHRASES = [
    "enable javascript",
    "javascript is required",
    "checking your browser",
    "just a moment",
    "cf-chl-",
    "loading...",
    "verify you are human",
]
APP_MARKER = "__next_data__"

#: Phrases of pages that refuse the visitor.
BLOCKED_PHRASES = [
    "just a moment",
    "checking your browser",
    "verify you are human",
    "access denied",
    "unusual traffic",
    "cf-chl-",
]

#: Observable messages.
REASON_SPECIAL = "Flashscore maç sayfası browser ile açılmalı"
REASON_NOT_HTML = "HTML olmayan içerik: "
UNKNOWN_TYPE = "bilinmiyor"
REASON_SCRIPTED = "Sayfa JavaScript veya browser gerektiriyor"


def _any_of(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(p) for p in phrases])


def needs_browser(status: Column, html: Column, text: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    return (
        (status >= 400)
        | (utf16_length(F.coalesce(html, F.lit(""))) < MIN_HTML)
        | (utf16_length(F.coalesce(text, F.lit(""))) < MIN_TEXT)
        | _any_of(low, BROWSER_PHRASES)
        | (low.contains(APP_MARKER) & (utf16_length(text) < MIN_APP_TEXT))
    )


def is_html(content_type: Column) -> Column:
    return F.lower(F.coalesce(content_type, F.lit(""))).contains("text/html")


def is_blocked(title: Column, text: Column) -> Column:
    return _any_of(F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), BLOCKED_PHRASES)


def still_loading(text: Column) -> Column:
    return text.contains("Loading...") | (utf16_length(text) < MIN_TEXT)


def rendered_success(title: Column, text: Column) -> Column:
    """Strictly more than the floor: text of exactly 80 units neither loads nor succeeds."""
    return ~still_loading(text) & ~is_blocked(title, text) & (utf16_length(text) > MIN_TEXT)


def fetch_success(status: Column) -> Column:
    return status.between(200, 299)


def fallback_reason(
    special: Column, error: Column, content_type: Column, status: Column, html: Column, text: Column
) -> Column:
    """Why a page goes on to the browser; null if it doesn't. The first that applies."""
    shown = F.when(F.coalesce(content_type, F.lit("")) == "", UNKNOWN_TYPE).otherwise(content_type)
    return (
        F.when(special, REASON_SPECIAL)
        .when(error.isNotNull(), error)
        .when(~is_html(content_type), F.concat(F.lit(REASON_NOT_HTML), shown))
        .when(needs_browser(status, html, text), REASON_SCRIPTED)
    )
