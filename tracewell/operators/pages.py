"""Pages as text: headings, links, list items and paragraphs of raw HTML, and which lines of two texts differ in number, by built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pattern and replacement, in order; both Java's and RE2's regular expressions read them alike.
RULES = (
    (r"(?is)<!--.*?-->", ""),
    (r"(?is)<(script|style|noscript|template|head)\b[^>]*>.*?</(script|style|noscript|template|head)\s*>", ""),
    (r"\s+", " "),
    (r"(?i)<a\b[^>]*href=[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>", r"[$2]($1)"),
    (r"(?i)<h1\b[^>]*>", "\n# "),
    (r"(?i)<h2\b[^>]*>", "\n## "),
    (r"(?i)<h[3-6]\b[^>]*>", "\n### "),
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</?(p|div|section|article|header|footer|nav|main|aside|ul|ol|table|tr|h[1-6]|br|form|body|html|title)\b[^>]*>", "\n"),
    (r"<[^>]*>", ""),
    (r"&lt;", "<"),
    (r"&gt;", ">"),
    (r"&quot;", '"'),
    (r"&nbsp;", " "),
    (r"&amp;", "&"),
    (r" *\n *", "\n"),
    (r"  +", " "),
    (r"\n\n+", "\n"),
    (r"^\s+|\s+$", ""),
)


def markdown(html: Column | str) -> Column:
    out = F.col(html) if isinstance(html, str) else html
    for pattern, by in RULES:
        out = F.regexp_replace(out, pattern, by)
    return out


def rules_sql(column: str) -> str:
    for pattern, by in RULES:
        quoted = pattern.replace("'", "''")
        by = by.replace("$2", r"\2").replace("$1", r"\1").replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{by}', 'g')"
    return column


def line_changes(versions: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """Lines that left and lines that came, by their number in either text: a join on equal lines' hashes and occurrence instead of a table of all pairs."""

    def lines(column: str, side: str) -> DataFrame:
        out = versions.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n")).alias("at", "line"))
        return out.groupBy(key, "line").agg(F.count("*").alias(side))

    both = lines(old, "before").join(lines(new, "after"), [key, "line"], "full_outer")
    n = F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0))
    return both.select(key, "line", n.alias("change")).where("change <> 0")
