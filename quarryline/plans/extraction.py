"""Extraction queries: files are made of table rows, a file for each part."""

from pyspark.sql import functions as F

from quarryline.operators import xref as X
from quarryline.plans.registry import query
from quarryline.plans.tables import table
from quarryline.sources import blocks, documents, screens


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _key():
    return F.col("p_partkey").cast("string")


def block_files(spark, d):
    """A function block for each part: it calls block key + 1 and reads the tag of its brand; those of size 1 are broken, of size 2 no blocks."""
    xml = _text(
        '<Document><SW.Blocks.FC ID="0"><AttributeList><Interface><Sections><Section Name="Input"><Member Name="a" Datatype="Bool"/></Section><Section Name="Static"><Member Name="s" Datatype="Struct"><Member Name="t" Datatype="Int"/></Member></Section></Sections></Interface><Name>B',
        _key(), "</Name><Number>", _key(), '</Number><ProgrammingLanguage>SCL</ProgrammingLanguage></AttributeList><ObjectList><SW.Blocks.CompileUnit><AttributeList><NetworkSource><StructuredText><Access Scope="LocalVariable"><Symbol><Component Name="a"/></Symbol></Access><Token Text=" := "/><Access Scope="GlobalVariable"><Symbol><Component Name="',
        F.col("p_brand"), '"/></Symbol></Access><Token Text=";"/><NewLine/><Access Scope="Call"><CallInfo Name="B', (F.col("p_partkey") + 1).cast("string"), '"/></Access><Token Text="();"/></StructuredText></NetworkSource></AttributeList></SW.Blocks.CompileUnit></ObjectList></SW.Blocks.FC></Document>',
    )
    size = F.col("p_size")
    content = F.when(size == 1, "<a>").when(size == 2, "<a/>").otherwise(xml)
    folder = F.when(F.col("p_type") == "SMALL", "PLC tags").otherwise(F.col("p_type"))
    return table(spark, d, "part").select(_text("/x/", folder, "/f", _key(), F.when(size == 3, ".txt").otherwise(".xml")).alias("path"), content.cast("binary").alias("content"))


@query("a1_directory_scan", "SELECT doc_id FROM documents WHERE lang IN ('en', 'de')")
def a1(spark, d):
    """Files with a suffix that is read."""
    suffix = F.when(F.col("lang") == "en", ".TXT").when(F.col("lang") == "de", ".md").when(F.col("lang") == "fr", ".bin").otherwise("")
    files = table(spark, d, "documents").select("doc_id", F.concat(F.lit("/x.y/"), "source", suffix).alias("path"))
    return files.where(documents.suffix(F.col("path")).isin(*documents.SUFFIXES)).select("doc_id")


@query("a4_format_dispatch", "SELECT page_id, 1 AS page, length(html) AS n_chars FROM pages")
def a4(spark, d):
    files = table(spark, d, "pages").select(F.concat(F.lit("/p/"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("page_id").cast("string").alias("name"), F.col("html").cast("binary").alias("content"))
    return documents.pages(files).select(F.col("name").cast("long").alias("page_id"), "page", F.length("text").cast("long").alias("n_chars"))


@query("b1_block_files", "SELECT '/x/' || p_type || '/f' || p_partkey || '.xml' AS path FROM part WHERE p_type <> 'SMALL' AND p_size <> 3")
def b1(spark, d):
    return blocks.block_files(block_files(spark, d)).select("path")


@query(
    "b2_block_parser",
    """SELECT CASE WHEN p_size = 1 THEN 'f' ELSE 'B' END || p_partkey AS name, CASE WHEN p_size = 1 THEN '-' ELSE p_partkey::VARCHAR END AS number, p_size = 1 AS broken,
              CASE WHEN p_size = 1 THEN '' ELSE p_brand || '|CALL:B' || (p_partkey + 1) END AS refs, CASE WHEN p_size = 1 THEN '-' ELSE '#a := "' || p_brand || '";' || chr(10) || '"B' || (p_partkey + 1) || '"();' END AS code
       FROM part WHERE p_size <> 2""",
)
def b2(spark, d):
    p = blocks.parse_blocks(block_files(spark, d))
    refs = F.array_join(F.sort_array("refs"), "|")
    return p.select("name", F.coalesce("number", F.lit("-")).alias("number"), F.col("error").isNotNull().alias("broken"), refs.alias("refs"), F.coalesce("code", F.lit("-")).alias("code"))


@query("b40_code_text", "SELECT 'B' || p_partkey AS name, CASE WHEN p_size % 2 = 1 THEN 'x := ' || p_partkey || ';' || chr(10) || 'y();' ELSE '#a' || chr(10) || ' ' || p_brand || ';' END AS code FROM part")
def b40(spark, d):
    """Blocks as plain text (odd sizes) and as tokens, with blanks at their ends."""
    plain = _text("\n  x := ", _key(), ";\ny();  \n")
    tokens = _text('<NewLine/><Access Scope="LocalVariable"><Symbol><Component Name="a"/></Symbol></Access><NewLine/><Blank/><Token Text="', F.col("p_brand"), '"/><Token Text=";"/><Blank Num="3"/>')
    xml = _text(
        '<Document><SW.Blocks.FC ID="0"><AttributeList><Name>B', _key(), "</Name><Number>1</Number><ProgrammingLanguage>SCL</ProgrammingLanguage></AttributeList><ObjectList><SW.Blocks.CompileUnit><AttributeList><NetworkSource><StructuredText>",
        F.when(F.col("p_size") % 2 == 1, plain).otherwise(tokens), "</StructuredText></NetworkSource></AttributeList></SW.Blocks.CompileUnit></ObjectList></SW.Blocks.FC></Document>",
    )
    files = table(spark, d, "part").select(_text("/x/f", _key(), ".xml").alias("path"), xml.cast("binary").alias("content"))
    return blocks.parse_blocks(files).select("name", "code")


@query("a3_pdf_pages", "SELECT doc_id, page, text FROM (SELECT doc_id, 1 AS page, source AS text FROM documents UNION ALL SELECT doc_id, 3, lang FROM documents)")
def a3(spark, d):
    """Pages by a reader for a suffix (here one that parts at form feeds): blank pages are left out and keep their numbers."""
    content = F.concat("source", F.lit("\f \f"), "lang").cast("binary")
    files = table(spark, d, "documents").select(F.concat(F.lit("/p/"), F.col("doc_id").cast("string"), F.lit(".PDF")).alias("path"), F.col("doc_id").cast("string").alias("name"), content.alias("content"))
    return documents.pages(files, {".pdf": lambda b: b.decode().split("\f")}).select(F.col("name").cast("long").alias("doc_id"), "page", "text")


@query("b23_interface_counts", "SELECT 'B' || p_partkey AS name, 3 AS variables FROM part WHERE p_size > 2")
def b23(spark, d):
    return blocks.interface_counts(blocks.parse_blocks(block_files(spark, d)).where("error is null"))


@query("b3_tag_tables", "SELECT p_brand AS name, arg_max(p_type, 'f' || p_partkey) AS type, max('f' || p_partkey) AS path FROM part WHERE p_size > 1 GROUP BY 1")
def b3(spark, d):
    xml = _text(
        "<Document><SW.Tags.PlcTagTable><AttributeList><Name>T</Name></AttributeList><ObjectList><SW.Tags.PlcTag><AttributeList><DataTypeName>", F.col("p_type"),
        "</DataTypeName><LogicalAddress>%I0.0</LogicalAddress><Name>", F.col("p_brand"), "</Name></AttributeList></SW.Tags.PlcTag></ObjectList></SW.Tags.PlcTagTable></Document>",
    )
    files = table(spark, d, "part").select(_text("f", _key()).alias("path"), F.when(F.col("p_size") == 1, "<").otherwise(xml).cast("binary").alias("content"))
    return blocks.parse_tag_tables(files).select("name", "type", "path")


def screen_files(spark, d):
    """A screen for each part: a button with a function that writes a tag and changes the screen; those of size 1 are too small."""
    body = _text("..Button_", _key(), "\n\n\nIO field_1 export async function Button_", _key(), '_OnUp(x) { if (x) { SetTagValue("M_', _key(), '", 1); } ChangeScreen("', F.col("p_brand"), '"); } tail }')
    return table(spark, d, "part").select(_key().alias("path"), F.when(F.col("p_size") == 1, "abc").otherwise(body).cast("binary").alias("content"))


@query("b6_screen_parser", "SELECT p_partkey::VARCHAR AS path, p_brand AS navigation, 'M_' || p_partkey AS tags FROM part WHERE p_size > 1")
def b6(spark, d):
    s = screens.parse_screens(screen_files(spark, d))
    return s.select("path", F.array_join("navigation", "|").alias("navigation"), F.array_join("tags", "|").alias("tags"))


@query("b35_screen_functions", """SELECT p_partkey::VARCHAR AS path, 'Button_' || p_partkey || '_OnUp' AS name, 'export async function Button_' || p_partkey || '_OnUp(x) { if (x) { SetTagValue("M_' || p_partkey || '", 1); } ChangeScreen("' || p_brand || '"); }' AS body FROM part WHERE p_size > 1""")
def b35(spark, d):
    return screens.parse_screens(screen_files(spark, d)).select("path", F.inline("functions")).select("path", "name", "body")


@query("b36_screen_elements", "SELECT p_partkey::VARCHAR AS path, 'Button_' || p_partkey AS name, 'button' AS type FROM part WHERE p_size > 1 UNION ALL SELECT p_partkey::VARCHAR, 'IO field_1', 'io_field' FROM part WHERE p_size > 1")
def b36(spark, d):
    return screens.parse_screens(screen_files(spark, d)).select("path", F.inline("elements")).select("path", "name", "type")


@query("b5_latest_screens", "SELECT p_partkey FROM part WHERE p_brand = (SELECT max(p_brand) FROM part)")
def b5(spark, d):
    p = table(spark, d, "part")
    return p.join(F.broadcast(p.agg(F.max("p_brand").alias("p_brand"))), "p_brand", "left_semi").select("p_partkey")  # one row


@query("b7_screen_instances", "SELECT p_name AS name, CASE WHEN bool_or(p_size < 10) THEN 'Saved' ELSE 'Context' END AS folder, coalesce(max(p_brand) FILTER (p_size < 10), max(p_brand)) AS created FROM part GROUP BY 1")
def b7(spark, d):
    i = table(spark, d, "part").select(F.col("p_name").alias("name"), F.when(F.col("p_size") < 10, "Saved").otherwise("Context").alias("folder"), F.col("p_brand").alias("created"))
    return X.latest_instance(i)


@query("b8_tag_sheet_path", "SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name WHEN p_size < 20 THEN p_type ELSE p_brand END AS path FROM part")
def b8(spark, d):
    size = F.col("p_size")
    path = screens.resolved_sheet(F.when(size < 10, F.col("p_name")), F.array(F.when(size < 20, F.col("p_type")), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", path.alias("path"))
