"""Operator screens from binary project files."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.functions.text import EVENT_SUFFIXES, NAVIGATION_PATTERN, TAG_PATTERNS

#: Beginnings of element names with their types; longest code of a function in bytes.
ELEMENT_TYPES = {
    "Button": "button", "Text box": "text_display", "Screen window": "screen_window", "IO field": "io_field", "Bar": "bar_graph", "Symbolic IO field": "symbolic_io_field",
    "Status display": "status_display", "Switch": "switch", "Slider": "slider", "Rectangle": "rectangle", "Line": "line", "Circle": "circle", "Image": "image", "Faceplate": "faceplate",
    "Clock": "unknown", "Date": "unknown", "Text list": "unknown",
}
LONGEST_FUNCTION, LOOK_AHEAD, SMALLEST_FILE = 10_000, 200, 10
EVENT_ENDINGS = (*EVENT_SUFFIXES, "_OnFocus", "_OnBlur", "_OnKeyPress", "_OnKeyDown", "_OnKeyUp", "_OnShow", "_OnHide")
_FUNCTION = re.compile(r"export\s+async\s+function\s+(\w+)\s*\([^)]*\)\s*\{")
_ELEMENT = re.compile("((?:" + "|".join(sorted(ELEMENT_TYPES, key=len, reverse=True)) + r")_\w+)", re.A)
_NEAR_TAG = re.compile(r"([A-Z][A-Z0-9_]*_[A-Z0-9_ .\-]{4,})")
_SCREEN = "path string, functions array<struct<name:string,body:string>>, elements array<struct<name:string,type:string,tags:array<string>>>, navigation array<string>, tags array<string>"


def functions(text: str) -> list[dict]:
    """Exported functions with their bodies, to the brace that closes the first; braces in strings count too."""
    out = []
    for m in _FUNCTION.finditer(text):
        depth, start = 0, m.end() - 1
        for b in re.finditer(r"[{}]", text[start : start + LONGEST_FUNCTION]):
            depth += 1 if b[0] == "{" else -1
            if not depth:
                out.append({"name": m[1], "body": text[m.start() : start + b.end()]})
                break
    return out


def elements(text: str) -> list[dict]:
    """Different elements in order, without event functions, with tags in the bytes that follow the name."""
    out: dict[str, dict] = {}
    for m in _ELEMENT.finditer(text):
        name = m[1]
        if name not in out and not name.endswith(EVENT_ENDINGS):
            kind = next(t for p, t in ELEMENT_TYPES.items() if name.startswith(p))
            out[name] = {"name": name, "type": kind, "tags": [t.strip() for t in _NEAR_TAG.findall(text[m.start() : m.start() + LOOK_AHEAD])]}
    return list(out.values())


def parse_screen(content: bytes) -> dict | None:
    """A screen as a row; None for files that are too small. Bytes are read one by one, as Latin-1."""
    if content is None or len(content) < SMALLEST_FILE:
        return None
    text = content.decode("latin-1")
    code = functions(text)
    bodies = "\n".join(f["body"] for f in code)
    tags = sorted({t.strip() for p in TAG_PATTERNS for t in re.findall(p, bodies)})
    return {"functions": code, "elements": elements(text), "navigation": re.findall(NAVIGATION_PATTERN, bodies), "tags": tags}


def resolved_sheet(explicit: Column, candidates: Column) -> Column:
    """The tag sheet to read: the one asked for, else the first that is there (candidates: an array with nulls for those that aren't)."""
    return F.coalesce(explicit, F.try_element_at(F.array_compact(candidates), F.lit(1)))


def find_screens(spark: SparkSession, folder: str) -> DataFrame:
    """(path, instance, created, content) of screen files below folders named Saved: those of the latest instance, by its
    creation time as text. The layout is <instance>/<created>/Saved/<file>.rdf."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.rdf").load(folder)
    part = lambda k: F.element_at(F.split("path", "/"), k)
    saved = files.where(part(-2) == "Saved").select("path", part(-4).alias("instance"), part(-3).alias("created"), "content")
    latest = saved.select("instance", "created").distinct().agg(F.max("created").alias("created"))
    return saved.join(F.broadcast(latest), "created", "left_semi")  # one row


def parse_screens(files: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = pa.struct([("name", pa.string()), ("body", pa.string())])
        element = pa.struct([("name", pa.string()), ("type", pa.string()), ("tags", pa.list_(pa.string()))])
        types = {"functions": pa.list_(function), "elements": pa.list_(element), "navigation": pa.list_(pa.string()), "tags": pa.list_(pa.string())}
        for b in batches:
            rows = [(p, r) for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := parse_screen(c))]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.string()), *(pa.array([r[k] for _, r in rows], t) for k, t in types.items())], ["path", *types])

    return files.select("path", "content").mapInArrow(run, _SCREEN)


def read_tag_sheet(spark: SparkSession, path: str) -> DataFrame:
    """(hmi_tag, plc_tag) of a tag sheet exported as CSV with a header row; of a name the last row wins."""
    rows = spark.read.option("header", "true").csv(path).select(F.col("Name").alias("hmi_tag"), F.col("PLC tag").alias("plc_tag"), F.monotonically_increasing_id().alias("_i"))
    return rows.groupBy("hmi_tag").agg(F.max_by("plc_tag", "_i").alias("plc_tag"))
