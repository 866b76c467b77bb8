"""Removing listed rows from a table of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.scratch import write_table

#: Ids up to which a list is broadcast: some 20 MB of long ids as a hash table.
MAX_SENT = 500_000


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df does not have: name, with underscores behind it where needed."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs without the rows whose id is in ids (one column); null matches null. Any columns of docs are allowed.

    The list is written out and counted. A list of up to MAX_SENT ids is broadcast,
    so texts stay where they are; a longer one meets docs in a shuffle join.
    """
    own = free_name(docs, "_drop_id")
    ids, _ = write_table(ids.toDF(own).distinct(), "drop-ids")
    few = ids.count() <= MAX_SENT
    return docs.join(F.broadcast(ids) if few else ids, docs[id_col].eqNullSafe(ids[own]), "left_anti")
