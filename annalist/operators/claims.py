"""Entity documents to flat claims, with built-in functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import first_valid_day, parse_day
from ..schemas import ITEM_QUALIFIERS, MAIN_PROPERTIES, TEXT_QUALIFIERS, TIME_QUALIFIERS

#: ``value`` is read as text: objects come back as JSON, strings as they are, so one schema fits every shape of a snak.
_SNAK = "struct<snaktype:string,datavalue:struct<value:string>>"
DOCUMENT = f"struct<id:string,claims:map<string,array<struct<rank:string,mainsnak:{_SNAK},qualifiers:map<string,array<{_SNAK}>>>>>>"


def snak_item(snak: Column) -> Column:
    """``Q`` and number of an item snak: a value object of entity type item with an integer numeric id; else null."""
    v = snak["datavalue"]["value"]
    number = F.get_json_object(v, "$.numeric-id")
    return F.when((snak["snaktype"] == "value") & (F.get_json_object(v, "$.entity-type") == "item") & number.rlike("^[0-9]+$"), F.concat(F.lit("Q"), number))


def snak_day(snak: Column) -> Column:
    """Day text of a time snak, null if it is none or stands for no day."""
    return F.when(snak["snaktype"] == "value", parse_day(F.get_json_object(snak["datavalue"]["value"], "$.time")).cast("string"))


def snak_text(snak: Column) -> Column:
    """A plain string value."""
    v = snak["datavalue"]["value"]
    return F.when((snak["snaktype"] == "value") & ~v.startswith("{"), v)


def qualifier_list(claim: Column, pid: str, value) -> Column:
    """Values of a qualifier by ``value``, null instead of an empty list."""
    found = F.filter(F.transform(F.try_element_at(claim["qualifiers"], F.lit(pid)), value), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found)


def parse_documents(df: DataFrame, line: str) -> DataFrame:
    """``df`` with ``doc``, the parsed document; lines that are null, blank, brackets of a dump, bad JSON or no object drop out.

    Blanks, a byte order mark and one trailing comma around the document do not count.
    """
    text = F.regexp_replace(F.regexp_replace(F.col(line), r"^[\s\x{FEFF}]+|\s+$", ""), r"\s*,$", "")
    doc = F.from_json(text, DOCUMENT, {"mode": "PERMISSIVE"})
    return df.filter(F.col(line).isNotNull()).withColumn("_t", text).filter(F.col("_t").startswith("{") & F.col("_t").endswith("}")).withColumn("doc", doc).drop("_t").filter(F.col("doc").isNotNull())


def extract_claims(df: DataFrame, line: str, year: Column | int, pids: Sequence[str] | None = MAIN_PROPERTIES, keep: Sequence[str] = (), qualifier_mode: str = "list", drop_deprecated: bool = True) -> DataFrame:
    """Flat claims of item documents: keys and the 14 qualifier lists, or, with ``qualifier_mode="first"``, three day texts.

    Only documents whose id begins with Q, properties of ``pids`` (None: all), ranks other than deprecated (a missing rank is
    normal) and main values that are items. Documents with null, missing or empty claims give no rows.
    """
    docs = parse_documents(df, line).filter(F.col("doc.id").startswith("Q"))
    wanted = F.map_filter("doc.claims", lambda p, _: p.isin(*pids)) if pids is not None else F.col("doc.claims")
    lists = docs.select(*keep, (F.lit(year) if isinstance(year, int) else year).cast("int").alias("snapshot_year"), F.col("doc.id").alias("subject_qid"), F.explode(wanted).alias("pid", "_list"))
    claims = lists.select(*keep, "snapshot_year", "subject_qid", "pid", F.explode("_list").alias("_c"))
    claims = claims.withColumns({"rank": F.coalesce("_c.rank", F.lit("normal")), "value_qid": snak_item(F.col("_c.mainsnak"))}).filter(F.col("value_qid").isNotNull())
    if drop_deprecated:
        claims = claims.filter(F.col("rank") != "deprecated")
    c = F.col("_c")
    keys = [*keep, "snapshot_year", "subject_qid", "pid", "value_qid"]
    if qualifier_mode == "first":
        days = {"P580": "start_time", "P582": "end_time", "P585": "point_in_time"}
        first = {n: F.try_element_at(qualifier_list(c, p, snak_day), F.lit(1)).alias(n) for p, n in days.items()}
        return claims.select(*keys, *first.values(), "rank")
    shapes = ((TIME_QUALIFIERS, snak_day), (ITEM_QUALIFIERS, snak_item), (TEXT_QUALIFIERS, snak_text))
    return claims.select(*keys, "rank", *(qualifier_list(c, p, f).alias(n) for columns, f in shapes for p, n in columns.items()))


__all__ = ["DOCUMENT", "extract_claims", "first_valid_day", "parse_documents", "qualifier_list", "snak_day", "snak_item", "snak_text"]
