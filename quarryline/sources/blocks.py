"""Program blocks and tag tables from XML exports, as flat tables."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.sources.codetext import local, statement_list, structured_text

#: Element names of blocks with their kinds.
BLOCK_KINDS = {
    "SW.Blocks.OB": "OB", "SW.Blocks.FB": "FB", "SW.Blocks.FC": "FC", "SW.Blocks.GlobalDB": "DB", "SW.Blocks.InstanceDB": "IDB", "SW.Types.PlcStruct": "UDT",
}
_BLOCK = "path string, name string, number string, type string, language string, title string, code string, error string, members array<struct<section:string,path:string,type:string,depth:int>>, refs array<string>"


def find_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all XML files but those below a folder named PLC tags, whatever its case, sorted by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").load(folder)
    return block_files(files).select("path", "content").orderBy("path")


def block_files(files: DataFrame) -> DataFrame:
    return files.where(F.endswith(F.lower("path"), F.lit(".xml")) & ~F.rlike("path", F.lit(r"(?i)/PLC(%20| )tags/")))


def _first(node: ET.Element, name: str) -> ET.Element | None:
    return next((e for e in node.iter() if local(e.tag) == name), None)


def _text(node: ET.Element | None, name: str) -> str | None:
    found = None if node is None else next((e for e in node if local(e.tag) == name), None)
    return None if found is None else (found.text or "").strip()


def references(root: ET.Element) -> list[str]:
    """Sorted different global variables, and calls as CALL:name."""
    found = set()
    for e in root.iter():
        kind = local(e.tag)
        if kind == "Access" and e.get("Scope") == "GlobalVariable":
            symbol = _first(e, "Symbol")
            parts = [c.get("Name") or "" for c in symbol if local(c.tag) == "Component"] if symbol is not None else []
            if parts:
                found.add(".".join(parts))
        elif kind == "CallInfo" and e.get("Name"):
            found.add(f"CALL:{e.get('Name')}")
    return sorted(found)


def members(root: ET.Element) -> list[dict]:
    """All members of all sections, nested ones with their whole path; depth from 0."""
    out: list[dict] = []

    def walk(node: ET.Element, section: str, above: tuple[str, ...]) -> None:
        for e in node:
            if local(e.tag) == "Member":
                path = (*above, e.get("Name") or "")
                out.append({"section": section, "path": ".".join(path), "type": e.get("Datatype") or "", "depth": len(path) - 1})
                walk(e, section, path)
            elif local(e.tag) in ("Sections", "Section"):
                walk(e, e.get("Name") or section if local(e.tag) == "Section" and not above else section, above)

    interface = _first(root, "Interface")
    if interface is not None:
        walk(interface, "", ())
    return out


def parse_block(path: str, content: bytes) -> dict | None:
    """A block as a row; an error row where the XML is broken; None where it is no block. The file's name stands in for
    a name that is missing."""
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    empty = {"path": path, "name": stem, "number": None, "type": None, "language": None, "title": None, "code": None, "error": None, "members": [], "refs": []}
    try:
        root = ET.fromstring(content)
    except ET.ParseError as e:
        return empty | {"error": str(e)}
    block = next((e for e in root.iter() if local(e.tag) in BLOCK_KINDS), None)
    if block is None:
        return None
    attributes = next((e for e in block if local(e.tag) == "AttributeList"), None)
    writers = {"StructuredText": structured_text, "StatementList": statement_list}
    code = "\n".join(writers[local(e.tag)](e) for e in block.iter() if local(e.tag) in writers)
    title = _first(block, "Title") if attributes is None else _first(attributes, "Title")
    return empty | {
        "name": _text(attributes, "Name") or stem,
        "number": _text(attributes, "Number"),
        "type": BLOCK_KINDS[local(block.tag)],
        "language": _text(attributes, "ProgrammingLanguage"),
        "title": "".join(title.itertext()).strip() if title is not None else None,
        "code": code,
        "members": members(block),
        "refs": references(block),
    }


def parse_blocks(files: DataFrame) -> DataFrame:
    """files (path, content) as blocks; what isn't a block is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        member = pa.struct([("section", pa.string()), ("path", pa.string()), ("type", pa.string()), ("depth", pa.int32())])
        types = {"members": pa.list_(member), "refs": pa.list_(pa.string())}
        names = ["path", "name", "number", "type", "language", "title", "code", "error", "members", "refs"]
        for b in batches:
            rows = [r for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (r := parse_block(p, c))]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names)

    return files.select("path", "content").mapInArrow(run, _BLOCK)


def parse_tag_tables(files: DataFrame) -> DataFrame:
    """(name, type, address, table, path) of tag tables; broken files are passed over; of a name the last file wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    root = ET.fromstring(content)
                except ET.ParseError:
                    continue
                for t in (e for e in root.iter() if local(e.tag) == "SW.Tags.PlcTagTable"):
                    table = _text(next((e for e in t if local(e.tag) == "AttributeList"), None), "Name") or ""
                    for tag in (e for e in t.iter() if local(e.tag) == "SW.Tags.PlcTag"):
                        a = next((e for e in tag if local(e.tag) == "AttributeList"), None)
                        if name := _text(a, "Name"):
                            rows.append((name, _text(a, "DataTypeName") or "", _text(a, "LogicalAddress") or "", table, path))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(5)], ["name", "type", "address", "table", "path"])

    found = files.select("path", "content").mapInArrow(run, "name string, type string, address string, table string, path string")
    return found.groupBy("name").agg(F.max_by(F.struct("type", "address", "table", "path"), "path").alias("x")).select("name", "x.*")


def interface_counts(blocks: DataFrame) -> DataFrame:
    """(name, variables): all members of a block, nested ones too."""
    return blocks.select("name", F.size("members").alias("variables"))
