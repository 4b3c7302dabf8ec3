"""Label tables, label joins and label filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_clean_label
from ..schemas import PROPERTIES

_ALIASES = {"lang": ("lang", "len"), "description": ("description", "des")}


def build_labels(df: DataFrame, lang: str | None = "en") -> DataFrame:
    """id, label and, where the source has them under either name, lang and description; one language or (None) all.

    Raises ValueError if a language is asked for and the source has no language column.
    """
    found = {n: next((c for c in names if c in df.columns), None) for n, names in _ALIASES.items()}
    if lang is not None and not found["lang"]:
        raise ValueError("the label table has no language column")
    rows = df if lang is None else df.filter(F.col(found["lang"]) == lang)
    return rows.select("id", "label", *(F.col(c).alias(n) for n, c in found.items() if c))


def one_label(labels: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """One label for each id, the smallest; nulls are left out. Combines before the shuffle."""
    return labels.dropna(subset=[key, label]).groupBy(key).agg(F.min(label).alias(label))


def with_known_ids(claims: DataFrame, ids: DataFrame, key: str, subject: str = "subject_qid", value: str = "value_qid") -> DataFrame:
    """Rows whose subject and value both occur among ``ids``: two left semi joins."""
    known = ids.select(F.col(key).alias("_id")).dropna().distinct()
    return claims.join(known, F.col(subject) == F.col("_id"), "left_semi").join(known, F.col(value) == F.col("_id"), "left_semi")


def attach_labels(df: DataFrame, labels: DataFrame, key: str = "id", subject: str = "subject_qid", value: str = "value_qid", clean: bool = True) -> DataFrame:
    """Adds subject_label and value_label; rows without both drop out, with ``clean`` also those whose labels are not clean."""
    for column, name in ((subject, "subject_label"), (value, "value_label")):
        side = labels.select(F.col(key).alias(f"_{name}"), F.col("label").alias(name)).dropna()
        side = side.filter(is_clean_label(name)) if clean else side
        df = df.drop(name).join(side, F.col(column) == F.col(f"_{name}")).drop(f"_{name}")
    return df


def known_properties(df: DataFrame, pid: str = "pid") -> DataFrame:
    """Rows whose property is one of the 19 described."""
    return df.filter(F.col(pid).isin([p[0] for p in PROPERTIES]))
