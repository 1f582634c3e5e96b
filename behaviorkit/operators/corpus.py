"""Multi-task text corpus."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from behaviorkit.operators.assemble import union_all
from behaviorkit.operators.prep import as_label_text

PAIR_PREFIX = 200   # fixed value of the truncating form: code points of the first sentence that are kept


def pair_content(first, second, prefix: int | None = None):
    """The second sentence appended to the first; with ``prefix`` the first is cut to so many code points."""
    a = F.coalesce(F.col(first).cast("string"), F.lit("nan"))
    b = F.coalesce(F.col(second).cast("string"), F.lit("nan"))
    return F.concat(a if prefix is None else F.substring(a, 1, prefix), b)


def build_corpus(tasks: Mapping[str, DataFrame], labelled: bool = True, prefix: int | None = None) -> DataFrame:
    """union the task tables into ``(task, id, content[, label])``.

    A table with ``content1``/``content2`` is a sentence-pair task and gets
    :func:`pair_content`, whole sentences unless a ``prefix`` is given.  Every field is text; a missing value becomes the
    string ``'nan'`` (P10).  The task is a column, never a row position.
    """
    parts = []
    for name, df in tasks.items():
        content = pair_content("content1", "content2", prefix) if "content1" in df.columns else \
            as_label_text(F.col("content"))
        cols = [F.lit(name).alias("task"), as_label_text(F.col("id")).alias("id"), content.alias("content")]
        if labelled:
            cols.append(as_label_text(F.col("label")).alias("label"))
        parts.append(df.select(*cols))
    return union_all(parts)
