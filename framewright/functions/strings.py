"""Name, label and markup column expressions. A null gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.fixed import as_column


def layout_name(x) -> Column:
    """Lower case without ``+`` and blanks; after the first dot, each further ``.digit`` becomes ``_digit``."""
    x = F.translate(F.lower(as_column(x)), "+ ", "")
    head, tail = F.substring_index(x, ".", 1), F.regexp_extract(x, r"^[^.]*\.(.*)$", 1)
    return F.when(F.instr(x, ".") == 0, x).otherwise(F.concat(head, F.lit("."), F.regexp_replace(tail, r"\.(\d)", "_$1")))


def symbol_name(x) -> Column:
    """Lower case with ``+`` and ``-`` as ``_``."""
    return F.translate(F.lower(as_column(x)), "+-", "__")


def xml_escape(x) -> Column:
    """The five markup characters as entities."""
    x = as_column(x)
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        x = F.replace(x, F.lit(mark), F.lit(entity))
    return x


def extension(x) -> Column:
    """The part of a file name after its last dot, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(as_column(x), r"\.([^./\\\\]*)$", 1))


def layout_label(name, mask) -> Column:
    """A name, or ``custom``, with the mask in hexadecimal and its number of channels."""
    mask = as_column(mask)
    return F.format_string("%s (0x%s, %d ch)", F.coalesce(as_column(name), F.lit("custom")), F.lower(F.hex(mask)), F.bit_count(mask))
