"""Text of captured documents by their type, with a status."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.sources import html


def extract_text(content: Column, content_type: Column) -> Column:
    """Struct of text, status, warning and transformation.

    HTML gives its visible text, JSON and plain text their characters; a document without text is ``empty``. PDF and
    other formats are ``unsupported_format``: their bytes are kept, nothing reads them here.
    """
    kind = F.coalesce(content_type, F.lit(""))
    characters = F.regexp_replace(F.decode(content, "UTF-8"), r"(?U)^\s+|\s+$", "")
    is_html = kind.isin("text/html", "application/xhtml+xml")
    is_json = (kind == "application/json") | kind.endswith("+json")
    is_text = kind.startswith("text/")
    bare = F.length(content).isNull() | (F.length(content) == 0)
    visible = html.visible_text(F.when(is_html & ~bare, F.decode(content, "UTF-8")))
    text = F.when(is_html, visible).when(is_json | is_text, F.nullif(characters, F.lit("")))
    read = is_html | is_json | is_text
    status = F.when(bare, "empty").when(~read, "unsupported_format").when(text.isNull(), "empty").otherwise("complete")
    change = F.when(~bare, F.when(is_html, "html_text_extracted").when(is_json, "json_text_preserved").when(is_text, "text_decoded_utf8"))
    warning = F.when(~bare & ~read, F.concat(F.lit("unsupported format: "), kind))
    return F.struct(F.when(~bare, text).alias("text"), status.alias("status"), warning.alias("warning"), change.alias("transformation"))
