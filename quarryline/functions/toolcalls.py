"""Tool calls written into a message's text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = r"(?s)<tool_call>.*?</tool_call>"


def _name_arguments(block: Column) -> Column:
    """(name, arguments) of a block: of its XML parts, else of a JSON object without '<'; null where the JSON is bad."""
    name = F.regexp_extract(block, r"(?s)<name>(.*?)</name>", 1)
    given = F.regexp_extract(block, r"(?s)<arguments>(.*?)</arguments>", 1)
    xml = F.contains(block, F.lit("<name>")) & F.contains(block, F.lit("</arguments>"))
    body = F.regexp_extract(block, r"(?s)(\{[^<]*\})", 1)
    valid = lambda j: F.try_parse_json(j).isNotNull()
    as_json = F.when((body != "") & valid(body), F.struct(F.coalesce(F.get_json_object(body, "$.name"), F.lit("")).alias("name"), F.coalesce(F.get_json_object(body, "$.arguments"), F.lit("")).alias("arguments")))
    return F.when(xml, F.when(valid(F.trim(given)), F.struct(F.trim(name).alias("name"), F.trim(given).alias("arguments")))).otherwise(as_json)


def extracted(messages: DataFrame, text: str = "text") -> DataFrame:
    """messages with calls array<struct<name, arguments>> (arguments as JSON text); blocks that were read go
    from the text, those with bad JSON stay in it."""
    found = F.transform(F.regexp_extract_all(F.col(text), F.lit(_BLOCK), F.lit(0)), lambda b: F.struct(b.alias("block"), _name_arguments(b).alias("call")))
    good = F.filter(found, lambda x: x["call"].isNotNull())
    rest = F.aggregate(good, F.col(text), lambda t, x: F.replace(t, x["block"], F.lit("")))
    return messages.withColumns({"calls": F.transform(good, lambda x: x["call"]), text: rest})
