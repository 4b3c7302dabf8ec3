"""Schemas, property metadata and own question wordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# Qualifier properties and their columns, by the shape of their values.
TIME_QUALIFIERS = {"P580": "q_start_time", "P582": "q_end_time", "P585": "q_point_in_time"}
ITEM_QUALIFIERS = {
    "P155": "q_follows", "P156": "q_followed_by", "P1365": "q_replaces", "P1366": "q_replaced_by", "P642": "q_of_applies_to", "P361": "q_part_of",
    "P1535": "q_start_cause", "P1534": "q_end_cause", "P793": "q_significant_event", "P1344": "q_participant_in_qual",
}
TEXT_QUALIFIERS = {"P1545": "q_series_ordinal"}
QUALIFIERS = {**TIME_QUALIFIERS, **ITEM_QUALIFIERS, **TEXT_QUALIFIERS}
#: Main properties kept from entity documents.
MAIN_PROPERTIES = [
    "P6", "P35", "P39", "P108", "P463", "P102", "P169", "P488", "P127", "P54", "P286", "P131", "P17", "P276", "P69", "P551",
    "P27", "P31", "P279", "P361", "P355", "P749", "P155", "P156", "P106", "P101", "P50", "P161", "P175", "P1344", "P166",
]

CLAIM_KEYS = ["snapshot_year", "subject_qid", "pid", "value_qid", "rank"]
CLAIM_SCHEMA = T.StructType([T.StructField("snapshot_year", T.IntegerType()), *(T.StructField(c, T.StringType()) for c in CLAIM_KEYS[1:]), *(T.StructField(c, T.ArrayType(T.StringType())) for c in QUALIFIERS.values())])
TRUTH_KEYS = ["snapshot_year", "anchor_date", "subject_qid", "pid", "value_qid", "rank", "rank_score"]
TRUTH_QUALIFIERS = [*ITEM_QUALIFIERS.values(), *TEXT_QUALIFIERS.values()]

# What a property asks for, its meaning, its group, and the property that completes it.
PROPERTIES = [
    ("P35", "who", "head of state", "leadership", "P6"),
    ("P6", "who", "head of government", "leadership", "P35"),
    ("P169", "who", "chief executive", "leadership", "P127"),
    ("P488", "who", "chairperson", "leadership", "P169"),
    ("P286", "who", "head coach", "leadership", "P54"),
    ("P39", "what", "position held", "role", "P102"),
    ("P102", "which", "political party", "affiliation", "P39"),
    ("P108", "which", "employer", "affiliation", "P463"),
    ("P463", "which", "member of", "affiliation", "P108"),
    ("P54", "which", "sports team", "affiliation", "P286"),
    ("P69", "which", "educated at", "affiliation", None),
    ("P127", "which", "owned by", "ownership", "P169"),
    ("P17", "which", "country", "geography", "P131"),
    ("P131", "where", "administrative area", "geography", "P17"),
    ("P276", "where", "location", "geography", None),
    ("P31", "what", "instance of", "ontology", None),
    ("P279", "what", "subclass of", "ontology", None),
    ("P106", "what", "occupation", "attribute", None),
    ("P101", "what", "field of work", "attribute", None),
]
#: Pairs of properties for two hops, the chain of three, and properties whose values are counted.
TWO_HOPS = [("P108", "P17"), ("P108", "P127"), ("P54", "P17"), ("P131", "P17"), ("P127", "P169"), ("P127", "P749"), ("P31", "P279"), ("P31", "P361")]
THREE_HOPS = ("P108", "P127", "P169")
COUNTED = ["P108", "P54", "P39", "P463", "P69"]
#: Labels that say nothing.
BAD_LABELS = ["unknown", "unknown value", "none", "null", "n/a", "na", "unspecified", "not known", "not applicable"]
COMPLEMENTS = {p: c for p, _, _, _, c in PROPERTIES if c}
GROUPS = {p: g for p, _, _, g, _ in PROPERTIES}

#: Wordings of our own by form; {q} asks, {s} is the subject, {m} the meaning, {y} a year.
WORDINGS = {
    "explicit_temporal": ["In {y}, {q} stood as {m} for {s}?", "Going by {y}, {q} was on record as {m} for {s}?"],
    "explicit_timeless": ["Going by the record, {q} stands as {m} for {s}?", "For {s}, {q} is on record as {m}?"],
    "followup": ["And as {m}, {q} is on record?", "What about {m}: {q} is it?"],
    "followup_then": ["And as {m} at that time, {q} was it?", "And {q} was on record as {m} back then?"],
    "switch": ["And {q} was it in {y}?", "Moving to {y}, {q} was it?"],
    "by_year": ["And by {y}, {q} was it?", "Finally, in {y}, {q} was it?"],
}


def property_table(spark: SparkSession) -> DataFrame:
    """The property metadata as a table of 19 rows."""
    return spark.createDataFrame(PROPERTIES, "pid string, qtype string, meaning string, family string, complement string")
