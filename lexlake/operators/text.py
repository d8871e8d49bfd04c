"""Text out of fetched bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lexlake.functions.strings import plain_text, sniffed, xml_text

#: Tags that end a line, and those whose content isn't text.
BLOCKS = "address|article|aside|blockquote|br|dd|div|dl|dt|fieldset|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
HIDDEN = "script|style|head|title"


@F.pandas_udf(StringType())
def entities_decoded(texts: pd.Series) -> pd.Series:
    from html import unescape

    return texts.map(unescape, na_action="ignore")


#: What follows a tag's name: quoted values hide the ends of tags. Nothing here is tried twice, however broken the page is.
ATTRIBUTES = r"""(?=[\s/>])(?:=\s*+(?:"[^"]*+"|'[^']*+')|[^>=]|=(?!\s*+(?:"[^"]*+"|'[^']*+')))*+>"""


def html_text(page: str) -> Column:
    """Text of a page: blocks end lines, scripts and the like are left out, entities are decoded. Only the last step needs Python.

    The patterns are the tokenizer's states: comments, raw-text elements up to their end tag, tags whose quoted values may
    hold anything, and other markup up to the next >. An element that isn't closed lasts to the page's end.
    """
    kept = F.regexp_replace(F.col(page), rf"(?is)<!--(?:>|->|.*?(?:--!?>|\z))|<({HIDDEN}){ATTRIBUTES}.*?(?:</\1(?=[\s/>])[^>]*+>|\z)", "")
    lines = F.regexp_replace(F.regexp_replace(kept, rf"(?i)</?(?:{BLOCKS}){ATTRIBUTES}", "\n"), rf"(?s)</?[a-zA-Z][^\s/>]*+{ATTRIBUTES}|<[/!?][^>]*+>", "")
    trimmed = F.transform(F.split(entities_decoded(lines), "\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(trimmed, lambda x: x != ""), "\n")


def extracted(body: str, kind: Column) -> Column:
    """Text by kind; null where it can't be had."""
    return F.when(kind == "html", html_text(body)).when(kind == "xml", xml_text(body)).when(kind == "plain", plain_text(body))


def fetched(pages: DataFrame, url: str, body: str, previous: str) -> DataFrame:
    """pages with kind, text, checksum and whether this is the first text of its record."""
    kind = sniffed(F.lit(None).cast("string"), url, body)
    out = pages.withColumn("kind", kind).withColumn("text", extracted(body, F.col("kind")))
    first = (F.coalesce(previous, F.lit("")) == "") & (F.coalesce("text", F.lit("")) != "")
    return out.withColumn("checksum", F.sha2("text", 256)).withColumn("first_text", first)
