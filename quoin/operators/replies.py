"""Replies of a language model as candidate corrections and facts, whatever shape they come in.

A reply is the text of a JSON message: an object with ``content``, an array of blocks, of which those
of type ``tool_use`` with the tool's name hold ``input``, an object with ``corrections`` and
``fact_check_items``. What does not parse, as a reply that was cut off, gives nothing; neither does
a part of another kind than it should be: blocks, inputs, lists and elements are passed over one
by one, so that a broken element costs no other. Numbers may come as strings, fractions are cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOOLS = {"1": "soumettre_corrections_pass1", "2": "soumettre_corrections_pass2", "H": "soumettre_anomalies_H"}
FIELDS = ["original", "corrected", "category", "description", "explanation", "source", "confidence"]
FACT_TYPES = ["date", "proper_noun", "title"]


def parts(value: Column, path: str = "$") -> Column:
    """The elements of a list within a variant; none where something else is there."""
    return F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.expr("cast(array() AS array<variant>)"))


def kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def text(value: Column, field: str) -> Column:
    """A field that is a string; null where it is missing or anything else."""
    found = F.try_variant_get(value, f"$.{field}", "variant")
    return F.when(kind(found) == "STRING", F.try_variant_get(value, f"$.{field}", "string"))


def whole(value: Column, field: str) -> Column:
    """A field as a whole number: a number cut to one, or a string of digits."""
    found = F.try_variant_get(value, f"$.{field}", "variant")
    number = F.try_variant_get(value, f"$.{field}", "double")
    digits = F.try_variant_get(value, f"$.{field}", "string")
    return F.when(kind(found).startswith("STRING"), F.when(digits.rlike(r"^\s*[+-]?[0-9]+\s*$"), F.trim(digits).cast("int"))).otherwise(F.when(number.between(-2147483648, 2147483647), number.cast("int")))


def elements(replies: DataFrame, reply: str, tool: str, field: str) -> DataFrame:
    """``replies`` with a row for each object in the list ``field`` of the tool's input: nth (its
    place, from 0, counting what is passed over) and element (a variant)."""
    blocks = F.filter(parts(F.try_parse_json(reply), "$.content"), lambda b: (text(b, "type") == "tool_use") & (text(b, "name") == tool))
    lists = F.flatten(F.transform(blocks, lambda b: parts(b, f"$.input.{field}")))
    rows = replies.select(*(c for c in replies.columns if c != reply), F.posexplode(lists).alias("nth", "element"))
    return rows.where(kind(F.col("element")).startswith("OBJECT"))


def raw_corrections(replies: DataFrame, reply: str = "reply", tool: str = TOOLS["1"]) -> DataFrame:
    """Candidate corrections of replies, as ``corrections.parsed`` takes them."""
    rows = elements(replies, reply, tool, "corrections")
    return rows.select("*", *(text(F.col("element"), f).alias(f) for f in FIELDS), whole(F.col("element"), "page_hint").alias("page_hint")).drop("element")


def facts(replies: DataFrame, default_page: str, reply: str = "reply", tool: str = TOOLS["1"]) -> DataFrame:
    """Facts to be checked that replies name: text of three characters or more, item_type, context
    of 300 at most (the text itself without one), page_hint from 1."""
    rows = elements(replies, reply, tool, "fact_check_items")
    e = F.col("element")
    said = F.trim(F.coalesce(text(e, "text"), F.lit("")))
    item = text(e, "item_type")
    context = F.coalesce(F.nullif(text(e, "context"), F.lit("")), said)
    found = rows.select("*", said.alias("text"), F.when(item.isin(FACT_TYPES), item).otherwise("proper_noun").alias("item_type"), F.substring(context, 1, 300).alias("context"), F.coalesce(whole(e, "page_hint"), F.col(default_page) + 1).alias("page_hint"))
    return found.where(F.length("text") >= 3).drop("element")


def metadata(reply: Column | str, field: str, own: Column) -> Column:
    """A field of a reply that is one JSON object, fenced or not, at most 400 characters; what the
    editor gave stays, and a reply that does not parse changes nothing."""
    bare = F.trim(F.regexp_replace(F.trim(reply), r"(?m)^```(?:json)?\s*|\s*```$", ""))
    value = F.try_parse_json(bare)
    found = F.try_variant_get(value, f"$.{field}", "string")
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(F.substring(found, 1, 400), F.lit("")))
