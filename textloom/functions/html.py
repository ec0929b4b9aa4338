"""HTML to title and text as chains of native regular expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import bind, normalize_text, utf16_length

#: Elements that go with their content, then closing tags that part words.
DROPPED_ELEMENTS = ["script", "style", "noscript", "svg", "iframe"]
BLOCK_CLOSERS = ["p", "div", "article", "section", "main", "header", "footer", "li",
                 "h1", "h2", "h3", "h4", "h5", "h6", "br"]

TAG = "<[^>]+>"
TITLE = r"(?i)<title[^>]*>([\s\S]*?)</title>"
COMMENT = r"<!--[\s\S]*?-->"


def title_of(html: Column) -> Column:
    raw = F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)
    return normalize_text(F.regexp_replace(raw, TAG, " "))


_DROPPED = f"(?:{'|'.join(DROPPED_ELEMENTS)})(?![A-Za-z0-9_])"
#: Markup without a trap, in one pass: a dropped element without another in it, a comment and a tag without < or >.
PLAIN_MARKUP = (
    rf"(?i)<(?={_DROPPED})([a-z]+)[^<>]*>[^<]*+(?:<(?!/?{_DROPPED})[^<]*+)*+</\1>"
    rf"|<!--[^<>]*-->|<(?!!--|/?{_DROPPED})[^<>]+>"
)


def strip_step_by_step(c: Column) -> Column:
    """The rule: element by element, then comments, closing tags that part words, all other tags."""
    for name in DROPPED_ELEMENTS:
        # an ASCII word boundary: Java's own is Unicode-aware
        c = F.regexp_replace(c, rf"(?i)<{name}(?![A-Za-z0-9_])[^>]*>[\s\S]*?</{name}>", " ")
    c = F.regexp_replace(c, COMMENT, " ")
    c = F.regexp_replace(c, f"(?i)</({'|'.join(BLOCK_CLOSERS)})>", " ")
    return F.regexp_replace(c, TAG, " ")


def strip_markup(html: Column) -> Column:
    """strip_step_by_step, eight passes, where markup is nested or broken; else one pass with the same result.

    If that pass leaves no < at all, each one stood in a plain piece of markup, which the steps
    would have replaced by a space too, whatever their order.
    """

    def stripped(x: Column) -> Column:
        return bind(F.regexp_replace(x, PLAIN_MARKUP, " "), lambda y: F.when(y.contains("<"), strip_step_by_step(x)).otherwise(y))

    return bind(F.coalesce(html, F.lit("")), stripped)


def text_of(html: Column) -> Column:
    return normalize_text(strip_markup(html))


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Adds title, text and text_length (UTF-16 units). One narrow projection, no shuffle.

    text is computed in a projection of its own, so that columns derived from it later
    share it instead of repeating the chain.
    """
    out = df.withColumns({"title": title_of(F.col(html)), "text": text_of(F.col(html))})
    return out.withColumn("text_length", utf16_length(F.col("text")))
