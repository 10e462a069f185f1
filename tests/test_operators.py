"""Operators on small inputs written by hand."""

import random
import re
import sqlite3
import time
import xml.etree.ElementTree as ET

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryline.functions import chunker, commands, embedder
from quarryline.functions import text as T
from quarryline.operators import conversations as C
from quarryline.operators import fulltext, graphs, sequences, store
from quarryline.operators import vectors as V
from quarryline.sources import blocks, codetext, documents, logs, screens
from quarryline.streaming import index, logs as streams

# -- vectors, store ---------------------------------------------------------------------------------


def test_near_rows_of_others_do_not_crowd_out_a_filter(spark):
    rows = [(i, "other", [1.0, i * 0.001]) for i in range(10)] + [(100 + i, "mine", [0.0, 1.0 + i]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>")
    got = V.knn(df, [1.0, 0.0], 5, only=F.col("label") == "mine").collect()
    assert [r.vec_id for r in got] == [100, 101, 102, 103, 104]


def test_ceiling_keeps_rows_without_distance(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.4), (3, 0.6), (4, 0.95), (5, None)], "vec_id long, distance double")
    assert sorted(r.vec_id for r in V.within(df, 0.5).collect()) == [1, 2, 5]


def test_change_detection_and_upsert(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "name string, hash string")
    stored = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", None), ("gone", "7")], "name string, hash string")
    assert sorted(r.name for r in store.changed(found, stored).collect()) == ["b", "c", "d"]
    old = spark.createDataFrame([("s", 1), ("t", 2)], "source string, v int")
    new = spark.createDataFrame([("t", 3, 0), ("t", 4, 1), ("u", 5, 0)], "source string, v int, at int")
    got = {(r.source, r.v) for r in store.upsert_batch(old, new, "at").collect()}
    assert got == {("s", 1), ("t", 4), ("u", 5)}


def test_only_missing_texts_are_embedded_once(spark):
    texts = spark.createDataFrame([(0, "h1", "a b"), (1, "h2", "c"), (2, "h1", "a b")], "pos long, hash string, text string")
    cache = spark.createDataFrame([("h2", "m", [0.5] * 8), ("h1", "other", [1.0] * 8)], "text_hash string, model string, embedding array<float>")
    found, grown = embedder.embed_missing(texts, cache, embedder.hashing_model(8), "m")
    got = {r.pos: r.embedding for r in found.collect()}
    assert got[1] == [0.5] * 8 and got[0] == got[2] and abs(np.linalg.norm(got[0]) - 1) < 1e-6
    assert grown.count() == 3
    with pytest.raises(Exception, match="1 vectors for 2 texts|1 vectors for"):
        embedder.embed_texts(texts.limit(2).coalesce(1), lambda t: np.zeros((1, 8))).count()


# -- chunks -----------------------------------------------------------------------------------------

PROSE = "\n\n".join(f"Sentence {i} about pumps and drives." for i in range(40))


def test_chunks_overlap_by_whole_sentences():
    got = chunker.chunks(PROSE, 40, 20)
    assert len(got) > 2
    for a, b in zip(got, got[1:], strict=False):
        assert b.split("\n\n")[0].split(". ")[0].rstrip(".") in a


def test_chunks_without_overlap_are_disjoint_and_whole():
    got = chunker.chunks(PROSE, 40, 0)
    assert [p for c in got for p in c.split("\n\n")] == PROSE.split("\n\n")


def test_a_sentence_without_end_is_split_at_words():
    got = chunker.chunks(" ".join(f"word{i}" for i in range(200)), 30, 0)
    assert all(sum(map(chunker.quarter, c.split())) <= 30 for c in got) and " ".join(got).split() == [f"word{i}" for i in range(200)]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!?\n", max_size=600), st.integers(3, 40), st.integers(0, 20))
def test_chunks_lose_no_word_and_are_never_empty(text, size, overlap):
    got = chunker.chunks(text, size, overlap)
    assert all(c.strip() for c in got)
    assert set(" ".join(got).split()) == set(text.split())
    if overlap == 0:
        assert " ".join(got).split() == text.split()


# -- full-text search -------------------------------------------------------------------------------

ROWS = [(1, "Motor start", "the pump runs"), (2, "Pump", "Motor overheats badly"), (3, "其他标题内容", "这是一个关于电机的问题"), (4, "misc", "100% foo-bar done"), (5, "team", "me and you")]
QUERIES = ["motor pump", '"the pump"', "motor OR done", "motor NOT start", "title : motor", "(pump OR done) NOT title : pump", "te me", "pump AND motor", "关于电机", "motor AND (start OR badly)", "TEAM"]


def test_indexed_search_agrees_with_a_trigram_index(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table t using fts5(chat_id, title, content, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    con.executemany("insert into t(rowid, chat_id, title, content) values (?, 'chat', ?, ?)", ROWS)
    df = spark.createDataFrame(ROWS, "id int, title string, content string").withColumn("chat_id", F.lit("chat"))
    cols = {c: F.col(c) for c in ("chat_id", "title", "content")}
    for q in QUERIES:
        want = {r[0] for r in con.execute("select rowid from t where t match ?", (q,))}
        assert {r.id for r in df.where(fulltext.matches(q, cols)).collect()} == want, q


@pytest.mark.parametrize("q,ids", [("100%", {4}), ("foo-bar", {4}), ("me", {5}), ("m_", {1, 2, 4, 5}), ("m_s", set()), ("AND", {5}), ('"open', set())])
def test_search_falls_back_to_like(spark, q, ids):
    df = spark.createDataFrame(ROWS, "id int, title string, content string").withColumn("chat_id", F.lit("chat"))
    assert {r.id for r in df.where(fulltext.matches(q, {c: F.col(c) for c in ("chat_id", "title", "content")})).collect()} == ids


def test_snippets(spark):
    text = "x" * 100 + "Needle" + "y" * 100
    one = lambda t, q, n: spark.range(1).select(fulltext.snippet(F.lit(t), q, n).alias("s")).first().s
    got = one(text, "needle", 30)
    assert got.startswith("...") and got.endswith("...") and "<b>Needle</b>" in got and len(got) == 30 + 6 + 7
    assert one("short needle", "needle", 30) == "short <b>needle</b>"
    assert one("a.c abc", "a.c", 30) == "<b>a.c</b> abc"
    assert one("电机 a 电机", "电机", 30) == "<b>电机</b> a <b>电机</b>"


# -- sequences --------------------------------------------------------------------------------------


def conversation(spark, roles):
    return spark.createDataFrame([(1, i, {"U": "user", "A": "assistant", "T": "tool"}[r], "x") for i, r in enumerate(roles)], "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("roles,target,cut", [("UAUAT", 4, 2), ("UAUAT", 3, 2), ("ATA", 2, 2), ("UATTT", 4, 1), ("TTT", 2, 0), ("UAUAT", 99, 2), ("U", 1, 0)])
def test_safe_cut_points(spark, roles, target, cut):
    assert sequences.safe_cut(conversation(spark, roles), F.lit(target)).first().cut == cut


def test_oversize_last_message_is_kept(spark):
    df = spark.createDataFrame([(1, 0, "user", "a" * 40), (1, 1, "user", "b" * 4000)], "conv_id long, turn long, role string, text string")
    assert [r.kept for r in sequences.suffix_window(df, 100).orderBy("turn").collect()] == [False, True]


def test_tool_call_repair_passes(spark):
    rows = [(1, 0, "user", "q", [], None), (1, 1, "assistant", "", ["a", "b"], None), (1, 2, "user", "go", [], None), (1, 3, "assistant", "", ["c"], None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, calls array<string>, call_id string")
    made = [(r.turn, r.place, r.call_id) for r in sequences.gap_repair(df).where("place > 0").orderBy("turn", "place").collect()]
    assert made == [(1, 1, "a"), (1, 2, "b")]
    made = [(r.turn, r.place, r.call_id) for r in sequences.cancel_unanswered(df).where("place > 0").orderBy("turn", "place").collect()]
    assert made == [(1, 1, "a"), (1, 2, "b"), (3, 1, "c")]


def test_resend_keeps_the_resent_ones(spark):
    kept = sequences.resend(conversation(spark, "UAUAU"), F.col("turn").isin(2, 4)).orderBy("turn").collect()
    assert [r.turn for r in kept] == [0, 1, 2, 4]


@pytest.mark.parametrize("model,size", [("gpt-4", 8000), ("gpt-4-x", 128_000), ("o1-mini", 128_000), ("x[200k]", 200_000), ("y [2 M]z", 2_000_000), ("my-Claude-3-5", 200_000), ("?", 128_000)])
def test_context_windows(spark, model, size):
    if model == "y [2 M]z":
        model = "y[2 M]z"
    assert spark.range(1).select(sequences.context_window(F.lit(model)).alias("n")).first().n == size


def test_chat_operators(spark):
    chats = spark.createDataFrame([(1, "a", None), (2, "b", 7)], "id long, title string, user_id long")
    more = spark.createDataFrame([(2, "c", 1), (3, "d", 1), (3, "d", 1)], "id long, title string, user_id long")
    assert sorted((r.id, r.title) for r in C.insert_new(chats, more, "id").collect()) == [(1, "a"), (2, "b"), (3, "d")]
    assert chats.where(C.owned_by(F.lit(None).cast("long"))).first().id == 1


# -- graphs -----------------------------------------------------------------------------------------

GRAPHS = {
    "AB BA": {"A": "A", "B": "A"},
    "AB BC CA": {"A": "A", "B": "A", "C": "A"},
    "AA": {},
    "AB BC AC": {},
    "AB BA CD DC": {"A": "A", "B": "A", "C": "C", "D": "C"},
    "AB BC CB CD": {"B": "B", "C": "B"},
    "": {},
}


@pytest.mark.parametrize("bound", [10**6, 0])
@pytest.mark.parametrize("edges", list(GRAPHS))
def test_cycles(spark, edges, bound):
    df = spark.createDataFrame([tuple(e) for e in edges.split()], "src string, dst string")
    assert {r.name: r.component for r in graphs.cycles(df, one_task_edges=bound).collect()} == GRAPHS[edges]


def test_both_ways_to_find_cycles_agree(spark):
    rng = random.Random(9)
    edges = {(f"n{rng.randrange(40):02}", f"n{rng.randrange(40):02}") for _ in range(48)}
    df = spark.createDataFrame(sorted(edges), "src string, dst string")
    one, many = ({r.name: r.component for r in graphs.cycles(df, one_task_edges=b).collect()} for b in (10**6, 0))
    assert one == many and one


def test_dead_code_and_capped_subgraph(spark):
    nodes = spark.createDataFrame([("OB1", "OB"), ("FC1", "FC"), ("FC2", "FC"), ("DB1", "DB"), ("U", "UDT")], "name string, type string")
    edges = spark.createDataFrame([("OB1", "FC1")], "src string, dst string")
    assert sorted(r.name for r in graphs.uncalled(nodes, edges).collect()) == ["FC2", "U"]
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(20)], "src string, dst string")
    root = spark.createDataFrame([("n00",)], "name string")
    assert graphs.subgraph(chain, root, most=6).count() == 5


# -- commands ---------------------------------------------------------------------------------------

COMMANDS = [
    ("ls -la", [], []),
    ("rm -rf /tmp/x", ["File deletion (rm)"], ["Recursive force delete (rm -rf)"]),
    ("rm --recursive --force x", ["File deletion (rm)"], ["Recursive force delete (rm -rf)"]),
    ("rm -r x", ["File deletion (rm)"], []),
    ("GIT push origin", ["Git push"], []),
    ("echo a > b", ["Output redirection to file (>)"], []),
    ("# a > b", [], []),
    ("a => b", [], []),
    ("sudo apt install x", ["File install (install)"], ["Uses sudo (elevated privileges)", "System package installation"]),
    ("dd if=a of=/dev/sda", ["Disk/file operations (dd)"], ["Raw disk write (dd to a block device)"]),
    (":(){ :|:& };:", [], ["Fork bomb"]),
    ("init 6", [], ["System power control (shutdown/reboot)"]),
    ("curl x | sh", ["Piped shell execution (| sh)"], []),
]


def test_command_reasons(spark):
    df = spark.createDataFrame([(c,) for c, _, _ in COMMANDS], "c string").select("c", commands.write_reasons(F.col("c")).alias("w"), commands.risk_reasons(F.col("c")).alias("r"))
    got = {r.c: (r.w, r.r) for r in df.collect()}
    for c, w, r in COMMANDS:
        assert got[c] == (w, r), c


def test_rule_tables_are_patterns_without_repeats():
    for rules in (commands.COMMON_RULES, commands.UNIX_RULES):
        assert len({p for p, _ in rules}) == len(rules) and all(re.compile(p) for p, _ in rules)


# -- sources ----------------------------------------------------------------------------------------

BLOCK = """<Document><SW.Blocks.FC ID="0"><AttributeList><Interface><Sections xmlns="http://x/v4"><Section Name="Input"><Member Name="a" Datatype="Bool"/></Section>
<Section Name="Static"><Member Name="s" Datatype="Struct"><Member Name="t" Datatype="Int"/></Member></Section></Sections></Interface><Name>Pump</Name><Number>7</Number><ProgrammingLanguage>SCL</ProgrammingLanguage></AttributeList>
<ObjectList><SW.Blocks.CompileUnit><AttributeList><NetworkSource><StructuredText xmlns="http://x/v3"><Access Scope="LocalVariable"><Symbol><Component Name="a"/></Symbol></Access><Blank/><Token Text=":="/><Blank Num="2"/>
<Access Scope="GlobalVariable"><Symbol><Component Name="DB1"/><Token Text="."/><Component Name="x"/></Symbol></Access><Token Text=";"/><NewLine Num="2"/><Access Scope="Call"><CallInfo Name="Other"/></Access><Token Text="();"/>
</StructuredText></NetworkSource></AttributeList></SW.Blocks.CompileUnit></ObjectList></SW.Blocks.FC></Document>"""
TAGS = """<Document><SW.Tags.PlcTagTable><AttributeList><Name>{}</Name></AttributeList><ObjectList><SW.Tags.PlcTag><AttributeList><DataTypeName>Bool</DataTypeName><LogicalAddress>%I0.0</LogicalAddress><Name>Start</Name></AttributeList></SW.Tags.PlcTag></ObjectList></SW.Tags.PlcTagTable></Document>"""


def test_blocks_and_tag_tables(spark, tmp_path):
    (tmp_path / "PLC Tags").mkdir()
    (tmp_path / "a.xml").write_text(BLOCK)
    (tmp_path / "broken.xml").write_text("<a>")
    (tmp_path / "other.xml").write_text("<a/>")
    for n in "12":
        (tmp_path / "PLC Tags" / f"t{n}.xml").write_text(TAGS.format(f"T{n}"))
    (tmp_path / "PLC Tags" / "bad.xml").write_text("<")
    found = {r.name: r for r in blocks.parse_blocks(blocks.find_blocks(spark, str(tmp_path))).collect()}
    assert set(found) == {"Pump", "broken"} and found["broken"].error
    p = found["Pump"]
    assert (p.number, p.type, p.language) == ("7", "FC", "SCL")
    assert p.code == '#a :=  "DB1".x;\n\n"Other"();'
    assert [(m.section, m.path, m.depth) for m in p.members] == [("Input", "a", 0), ("Static", "s", 0), ("Static", "s.t", 1)]
    assert p.refs == ["CALL:Other", "DB1.x"]
    tags = blocks.parse_tag_tables(spark.read.format("binaryFile").load(str(tmp_path / "PLC Tags"))).collect()
    assert [(t.name, t.address, t.table) for t in tags] == [("Start", "%I0.0", "T2")]


STL = """<StatementList><StlStatement><StlToken Text="A_BRACK"/></StlStatement><StlStatement><StlToken Text="A"/><Access Scope="GlobalVariable"><Symbol><Component Name="DB1"/><Component Name="x"/></Symbol></Access><Comment><Text>note</Text></Comment></StlStatement>
<StlStatement><StlToken Text="BRACKET"/></StlStatement><StlStatement><StlToken Text="EMPTY_LINE"/></StlStatement><StlStatement><StlToken Text="COMMENT"/><LineComment><Text> free</Text></LineComment></StlStatement>
<StlStatement><StlToken Text="CALL"/><Access Scope="Call"><CallInfo Name="FB1"><Instance Scope="GlobalVariable"><Component Name="IDB1"/></Instance><Parameter Name="in" Section="Input" Type="Int"><Access Scope="LiteralConstant"><Constant><ConstantValue>5</ConstantValue></Constant></Access></Parameter></CallInfo></Access></StlStatement>
<StlStatement><StlToken Text="Assign"/><Access Scope="LocalVariable"><Symbol><Component Name="y"/></Symbol></Access></StlStatement></StatementList>"""


def test_statement_lists_and_addresses():
    assert codetext.statement_list(ET.fromstring(STL)).split("\n") == [
        "      A(     ", '      A     "DB1".x  //note', "      )", "", "      // free", '      CALL     "FB1", "IDB1"', "        in := 5  [Input/Int]", '      =     #"y"',
    ]
    at = lambda **a: codetext.address(ET.Element("Address", a))
    assert at(Area="DB", Type="Bool", BlockNumber="5", BitOffset="67") == "%DB5.DBX8.3" and at(Area="I", Type="Bool", BitOffset="0") == "%I0.0"
    assert at(Area="M", Type="Word", BitOffset="16") == "%MW2" and at(Area="DB", Type="DWord", BlockNumber="2", BitOffset="64") == "%DB2.DBD8"


def test_screens(spark, tmp_path):
    body = b'\x00Button_1\x00MOTOR_START x\x00IO field_2 export async function Button_1_OnUp(i) { if (a) { HMIRuntime.Tags.SysFct.SetTagValue("M_RUN", 1); } ChangeScreen("Main", "w"); }\xff'
    for instance, created in (("a", "2024-01-01"), ("b", "2024-02-01")):
        d = tmp_path / instance / created / "Saved"
        d.mkdir(parents=True)
        (d / "s.rdf").write_bytes(body)
        (d / "tiny.rdf").write_bytes(b"abc")
    files = screens.find_screens(spark, str(tmp_path))
    got = screens.parse_screens(files).collect()
    assert len(got) == 1 and "2024-02-01" in got[0].path
    s = got[0]
    assert [e.name for e in s.elements] == ["Button_1", "IO field_2"] and s.elements[0].type == "button" and s.elements[0].tags[0].startswith("MOTOR_START")
    assert s.navigation == ["Main"] and s.tags == ["M_RUN"] and s.functions[0].name == "Button_1_OnUp" and s.functions[0].body.endswith("}")


def test_documents_from_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.TXT").write_bytes("Ünï".encode())
    (tmp_path / "sub" / "b.md").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "c.bin").write_bytes(b"x")
    (tmp_path / "d.pdf").write_bytes(b"one|  |three")
    files = documents.scan(spark, str(tmp_path))
    got = documents.pages(files, {".pdf": lambda b: b.decode().split("|")}).collect()
    assert sorted((r.name, r.page, r.text) for r in got) == [("a.TXT", 1, "Ünï"), ("b.md", 1, "café"), ("d.pdf", 1, "one"), ("d.pdf", 3, "three")]
    assert documents.scan(spark, str(tmp_path), recursive=False).count() == 2
    with pytest.raises(Exception, match="no reader for .pdf"):
        documents.pages(files).count()


def test_titles_and_sentences(spark):
    df = spark.range(1).select(T.title_of(F.lit("/x/my_long-name.tar.gz")).alias("t"), T.sentences(F.lit("One. Two!  Three? four")).alias("s"))
    r = df.first()
    assert r.t == "My Long Name.tar" and r.s == ["One.", "Two!", "Three?", "four"]


# -- streams ----------------------------------------------------------------------------------------


def test_ring_stream_keeps_the_last_events(spark, tmp_path):
    source = tmp_path / "in"
    schema = "source string, id long, message string"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out: list = []
    for part, ids in enumerate((range(5), range(5, 7))):
        spark.createDataFrame([("s", i, f"m{i}") for i in ids], schema).coalesce(1).write.mode("append").parquet(str(source))
        if part == 0:
            time.sleep(0.1)
        q = (
            streams.ring_stream(spark.readStream.schema(schema).parquet(str(source)), 5)
            .writeStream.outputMode("update")
            .foreachBatch(lambda df, n: out.append(sorted(r.id for r in df.collect())))
            .option("checkpointLocation", str(tmp_path / "cp"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination(120)
    assert [x for x in out if x][-1] == [2, 3, 4, 5, 6]


def test_windows_of_a_stream_equal_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet("/root/testdata/sf0.001/events.parquet*")
    q = streams.tumbling(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, streams.tumbling(events).collect()))


def test_missing_source_is_an_error(spark):
    e = spark.createDataFrame([("a", 1)], "source string, id long")
    with pytest.raises(KeyError, match="b"):
        streams.subscribed(e, ["a", "b"], e)


def test_index_follows_changes_of_a_stream(spark, tmp_path):
    schema = "seq long, op string, id long, chat_id long, title string, content string"
    spark.createDataFrame([(1, "upsert", 1, 9, "t", "a"), (2, "upsert", 2, 9, "t", "b"), (3, "delete", 1, 9, None, None), (4, "title", None, 9, "new", None)], schema).write.parquet(str(tmp_path / "in"))
    held = {"df": spark.createDataFrame([(5, 9, "t", "z")], "id long, chat_id long, title string, content string")}
    q = index.maintain(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda: held["df"], lambda df: held.update(df=spark.createDataFrame(df.collect(), df.schema)), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(map(tuple, held["df"].collect())) == [(2, 9, "new", "b"), (5, 9, "new", "z")]
    assert index.progress(q)["rows"] >= 4


def test_logs_are_written_by_day_and_chat(spark, tmp_path):
    df = spark.sql("select timestamp '2024-01-02 03:04:05' as ts, 'x' as m")
    logs.write_json_log(df, str(tmp_path / "l"))
    logs.write_chat_log(spark.createDataFrame([("d", "c", "hello")], "date string, chat_id string, text string"), str(tmp_path / "c"))
    assert spark.read.json(str(tmp_path / "l" / "date=2024-01-02")).first().m == "x"
    assert spark.read.text(str(tmp_path / "c" / "date=d" / "chat_id=c")).first().value == "hello"
