"""Text, file and command queries over `documents`, `pages`, `conversations` and `part`."""

import re

from pyspark.sql import functions as F

from quarryline.functions import chunker, commands, embedder, toolcalls
from quarryline.functions import text as T
from quarryline.operators import files as D
from quarryline.operators import store as S
from quarryline.plans.registry import query
from quarryline.plans.tables import table


def docs(spark, d):
    return table(spark, d, "documents")


def _joined(array):
    return F.array_join(array, "|")


@query("a2_text_pages", "SELECT page_id, length(html) AS n_chars, sha256(html) AS hash FROM pages")
def a2(spark, d):
    """HTML is read as text; its markup stays."""
    return table(spark, d, "pages").select("page_id", F.length("html").cast("long").alias("n_chars"), S.content_hash("html").alias("hash"))


@query("a26_token_count", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def a26(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).alias("tokens"))


@query("a27_chunks")
def a27(spark, d):
    return chunker.chunked(docs(spark, d).select("doc_id", "text"), size=200, overlap=40)


@query("a28_sentences", r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(0), 'g'), chr(0))) AS n, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(0), 'g'), chr(0))[1] AS first FROM documents")
def a28(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n"), F.element_at(s, 1).alias("first"))


@query("a28_paragraphs", "SELECT page_id, len(list_filter(list_transform(string_split(html, '</p><p>'), lambda x: trim(x)), lambda x: x <> '')) AS n FROM pages")
def a28b(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(T.paragraphs(F.replace("html", F.lit("</p><p>"), F.lit("\n\n")))).cast("long").alias("n"))


@query("a29_title_from_name", "SELECT DISTINCT source, 'Report ' || upper(source[1]) || source[2:] || ' ' || upper(lang[1]) || lang[2:] AS title FROM documents")
def a29(spark, d):
    return docs(spark, d).select("source", T.title_of(F.concat(F.lit("/data/report_"), "source", F.lit("-"), "lang", F.lit(".txt"))).alias("title")).distinct()


@query("a31_embedded_texts")
def a31(spark, d):
    """Embeds the different texts by the hashing stand-in; a model goes in its place."""
    texts = docs(spark, d).select(F.col("doc_id").alias("pos"), S.content_hash("text").alias("hash"), "text")
    cache = spark.createDataFrame([], "text_hash string, model string, embedding array<float>")
    found, _ = embedder.embed_missing(texts, cache, embedder.hashing_model(16), "hashing-16")
    return found.select(F.col("pos").alias("doc_id"), "hash", F.size("embedding").alias("dims"))


_CODE = """'SetTagValue("' || upper(source) || '_X' || doc_id || '", 1); ChangeScreen("' || lang || '"); GetTagValue("b' || doc_id % 7 || '"); ChangeScreen("' || source || '")'"""


def _code(spark, d):
    cat = F.concat(
        F.lit('SetTagValue("'), F.upper("source"), F.lit("_X"), F.col("doc_id").cast("string"), F.lit('", 1); ChangeScreen("'), "lang",
        F.lit('"); GetTagValue("b'), (F.col("doc_id") % 7).cast("string"), F.lit('"); ChangeScreen("'), "source", F.lit('")'),
    )
    return docs(spark, d).select("doc_id", cat.alias("code"))


@query("b33_tag_references", "SELECT doc_id, upper(source) || '_X' || doc_id || '|b' || doc_id % 7 AS tags FROM documents")
def b33(spark, d):
    return _code(spark, d).select("doc_id", _joined(T.tag_references(F.col("code"))).alias("tags"))


@query("b34_navigation_targets", f"""SELECT doc_id, array_to_string(regexp_extract_all({_CODE}, 'ChangeScreen\\("([^"]+)"', 1), '|') AS targets FROM documents""")
def b34(spark, d):
    return _code(spark, d).select("doc_id", _joined(T.navigation_targets(F.col("code"))).alias("targets"))


@query("b37_screen_names", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'MAIN ' || doc_id ELSE 'main_' || lang END AS name FROM documents")
def b37(spark, d):
    strings = F.array(F.lit("Font"), F.lit("%x"), F.concat(F.lit("main_"), "lang"), F.when(F.col("lang") == "en", F.concat(F.lit("MAIN "), F.col("doc_id").cast("string"))).otherwise("-"))
    return docs(spark, d).select("doc_id", T.screen_name(strings).alias("name"))


@query("b39_event_types", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'OnUp (release)' WHEN lang = 'de' THEN 'OnMouseEnter' ELSE 'unknown' END AS type FROM documents")
def b39(spark, d):
    f = F.concat("source", F.when(F.col("lang") == "en", "_OnUp").when(F.col("lang") == "de", "_OnMouseEnter").otherwise("_On"))
    return docs(spark, d).select("doc_id", T.event_type(f).alias("type"))


@query("b41_addresses", "SELECT p_partkey, CASE WHEN p_size < 20 THEN '%DB' || p_size || '.DBX' ELSE '%I' END || p_partkey // 8 || '.' || p_partkey % 8 AS address FROM part")
def b41(spark, d):
    area = F.when(F.col("p_size") < 20, "DB").otherwise("I")
    return table(spark, d, "part").select("p_partkey", T.address(area, F.col("p_size"), F.col("p_partkey")).alias("address"))


@query(
    "b42_references",
    """SELECT l_orderkey, coalesce(string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) FILTER (l_returnflag = 'R'), '') AS calls,
              coalesce(string_agg(DISTINCT l_partkey::VARCHAR, '|' ORDER BY l_partkey::VARCHAR) FILTER (l_returnflag <> 'R'), '') AS tags FROM lineitem GROUP BY 1""",
)
def b42(spark, d):
    ref = F.concat(F.when(F.col("l_returnflag") == "R", "CALL:").otherwise(""), F.col("l_partkey").cast("string"))
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ref).alias("r"))
    return g.select("l_orderkey", _joined(T.calls(F.col("r"))).alias("calls"), _joined(T.tags(F.col("r"))).alias("tags"))


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1))::INT AS line_no FROM documents"


@query("b43_code_search", f"SELECT doc_id, line_no, line FROM ({_LINES}) WHERE contains(lower(line), 'idiot')")
def b43(spark, d):
    return D.code_search(docs(spark, d), "Idiot", "doc_id").select("doc_id", "line_no", "line")


@query("b44_best_code", "SELECT doc_id, CASE WHEN lang = 'en' THEN text ELSE '// Network 1' || chr(10) || source || chr(10) || chr(10) || '// Network 2' || chr(10) || lang END AS code FROM documents")
def b44(spark, d):
    return docs(spark, d).select("doc_id", T.best_code(F.when(F.col("lang") == "en", F.col("text")).otherwise(" "), F.array("source", "lang")).alias("code"))


@query("c25_original_names", "SELECT doc_id, lang || '-x.txt|/up/abc-' || source || '.png' AS names FROM documents")
def c25(spark, d):
    f = F.array(F.lit("https://h/a.txt"), F.concat(F.lit("/up/abc-"), "lang", F.lit("-x.txt")), F.concat(F.lit("/up/abc-"), "source", F.lit(".png")))
    return docs(spark, d).select("doc_id", _joined(T.original_names(f)).alias("names"))


@query("c26_file_types", "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'image' ELSE 'document' END AS type FROM documents")
def c26(spark, d):
    suffix = F.when(F.col("lang") == "fr", ".png").when(F.col("lang") == "de", ".PNG").otherwise(".txt")
    return docs(spark, d).select("doc_id", T.file_type(F.concat("source", suffix)).alias("type"))


@query("c27_json_files", "SELECT event_id, CASE WHEN event_type = 'view' THEN 0 ELSE 2 END AS n, CASE WHEN event_type = 'view' THEN '' ELSE user_id::VARCHAR END AS first FROM events")
def c27(spark, d):
    files = F.when(F.col("event_type") == "view", "").otherwise(F.to_json(F.array(F.col("user_id").cast("string"), F.lit("x"))))
    a = T.decode_files(files)
    return table(spark, d, "events").select("event_id", F.coalesce(F.when(a.isNotNull(), F.size(a)), F.lit(0)).alias("n"), F.coalesce(F.try_element_at(a, F.lit(1)), F.lit("")).alias("first"))


@query("c28_chat_errors", "SELECT conv_id, turn, CASE WHEN role = 'user' THEN coalesce(text, '') ELSE '-' END AS error FROM conversations")
def c28(spark, d):
    body = F.when(F.col("role") == "user", F.concat(F.lit("x <chat-error>"), "text", F.lit("</chat-error>"))).otherwise(F.concat(F.lit("<chat-error>"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.coalesce(T.chat_error(body), F.lit("-")).alias("error"))


@query("g3_without_tag", r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<style>.*?</style>', '', 'gs'), '\s+', ' ', 'g')) AS text FROM pages")
def g3(spark, d):
    return table(spark, d, "pages").select("page_id", T.without_tag(F.col("html"), "style").alias("text"))


@query("d1_line_slices", "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:3], chr(10)) AS text FROM documents")
def d1(spark, d):
    return docs(spark, d).select("doc_id", D.line_slice(F.col("text"), 2, 3).alias("text"))


@query(
    "d2_edit_files",
    """WITH n AS (SELECT *, (length(text) - length(replace(text, ' the ', ''))) // 5 AS n FROM documents)
       SELECT doc_id, CASE WHEN n = 0 THEN 'not found' WHEN n > 1 THEN 'not unique' ELSE '-' END AS error, sha256(CASE WHEN n = 1 THEN replace(text, ' the ', ' a ') ELSE text END) AS hash FROM n""",
)
def d2(spark, d):
    e = D.edited(docs(spark, d), " the ", " a ")
    return e.select("doc_id", F.coalesce("error", F.lit("-")).alias("error"), S.content_hash("text").alias("hash"))


@query("d3_text_cap", "SELECT page_id, CASE WHEN length(html) > 2000 THEN html[1:2000] || '...' ELSE html END AS text FROM pages")
def d3(spark, d):
    return table(spark, d, "pages").select("page_id", T.capped(F.col("html"), 2000, "...").alias("text"))


@query("d4_output_caps", "SELECT source, array_to_string(list_sort(list(DISTINCT lang))[1:2], '|') AS langs FROM documents GROUP BY source")
def d4(spark, d):
    """The first two languages of each source: lists are cut for presentation only."""
    return docs(spark, d).groupBy("source").agg(_joined(F.slice(F.sort_array(F.collect_set("lang")), 1, 2)).alias("langs"))


@query(
    "d5_grep_context",
    f"""WITH l AS ({_LINES}), m AS (SELECT *, contains(line, 'idiot') AS hit FROM l)
        SELECT doc_id, line_no, hit FROM (SELECT *, max(hit::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n FROM m) WHERE n = 1""",
)
def d5(spark, d):
    return D.grep_context(docs(spark, d), "idiot", 1, 2, "doc_id").select("doc_id", "line_no", "hit")


@query("d6_grep", f"SELECT doc_id, line_no, line[1:200] AS line FROM ({_LINES}) WHERE regexp_matches(line, '[A-Z]hat? (the|of)')")
def d6(spark, d):
    return D.grep(docs(spark, d), "[A-Z]hat? (the|of)", "doc_id")


_PATHS = "p AS (SELECT 'root/' || source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)"


def _paths(spark, d):
    return docs(spark, d).select(F.concat_ws("/", F.lit("root"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"))


@query("d7_glob", f"WITH {_PATHS} SELECT path FROM p WHERE regexp_matches(path, '^root/(.*/)?en/[^/]*7[.]txt$')")
def d7(spark, d):
    return D.find(_paths(spark, d), "root/**/en/*7.txt")


@query("d8_tree", f"WITH {_PATHS} SELECT DISTINCT array_to_string(string_split(path, '/')[1:k], '/') AS path, k::INT AS level FROM p, (VALUES (1), (2), (3)) v(k)")
def d8(spark, d):
    return D.tree(_paths(spark, d)).select("path", "level")


@query("g1_skill_search", "SELECT p_partkey, p_name AS name FROM part WHERE contains(lower(p_name || ' ' || p_type), 'ring eco')")
def g1(spark, d):
    return D.skill_search(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_type").alias("description")), " Ring ECO ").select("p_partkey", "name")




@query("g2_command_reasons", "SELECT doc_id, CASE lang WHEN 'en' THEN 'File deletion (rm)' WHEN 'de' THEN 'Output redirection to file (>)|File install (install)' WHEN 'fr' THEN 'Git push' ELSE '' END AS writes, CASE lang WHEN 'en' THEN 'Recursive force delete (rm -rf)|Modifies system directory (/usr/)' WHEN 'de' THEN 'Uses sudo (elevated privileges)|System package installation' ELSE '' END AS risks FROM documents")
def g2(spark, d):
    lang = F.col("lang")
    cmd = F.concat(F.when(lang == "en", "rm -r -f /usr/").when(lang == "de", "sudo apt install x > ").when(lang == "fr", "git push ").otherwise("ls "), "source")
    return docs(spark, d).select("doc_id", _joined(commands.write_reasons(cmd)).alias("writes"), _joined(commands.risk_reasons(cmd)).alias("risks"))


def _example(pattern: str) -> str:
    """A command that a rule's pattern matches."""
    spelt = {r"\b": "", r"\s+": " ", r"\s*": " ", r"\s": " ", ".*": "x ", r"\w+": "w", r"['\"]?": "", "[^`]+": "x", "^": "", "?": "", r"\.": ".", r"\$": "$", r"\|": "|"}
    out = re.sub(r"(?<!\\)\(([^|)]*)\|[^)]*\)", r"\1", pattern)
    for part, text in spelt.items():
        out = out.replace(part, text)
    return re.sub(r"\[(.)[^\]]*\]", r"\1", out).replace("\\(", "(") + " "


_RULES = [*commands.COMMON_RULES, *commands.UNIX_RULES, *commands.WINDOWS_RULES]
_EXAMPLES = [_example(p) for p, _ in _RULES] + ["ls -l > x", "# a > b", "ls"]


def _values(rows) -> str:
    text = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "(VALUES " + ", ".join(f"({', '.join(map(text, r))})" for r in rows) + ")"


@query(
    "g2_write_rules",
    f"""WITH c(k, cmd) AS {_values(enumerate(_EXAMPLES))}, d AS (SELECT doc_id, cmd FROM documents JOIN c ON doc_id % {len(_EXAMPLES)} = k),
         common(o, p, r) AS {_values((i, *x) for i, x in enumerate(commands.COMMON_RULES))}, unix(o, p, r) AS {_values((i, *x) for i, x in enumerate(commands.UNIX_RULES))},
         win(o, p, r) AS {_values((i, *x) for i, x in enumerate(commands.WINDOWS_RULES))},
         w AS (SELECT doc_id, CASE WHEN NOT starts_with(trim(cmd), '#') AND (regexp_matches(trim(cmd), '[^-=]>') OR starts_with(trim(cmd), '>')) THEN '{commands.REDIRECTION}' END AS a,
                      (SELECT arg_min(r, o) FROM common WHERE regexp_matches(cmd, p, 'i')) AS b, (SELECT arg_min(r, o) FROM unix WHERE regexp_matches(cmd, p)) AS u,
                      (SELECT arg_min(r, o) FROM win WHERE regexp_matches(cmd, p, 'i')) AS v FROM d)
         SELECT doc_id, concat_ws('|', a, b, CASE WHEN u IS DISTINCT FROM b THEN u END) AS on_unix, concat_ws('|', a, b, CASE WHEN v IS DISTINCT FROM b THEN v END) AS on_windows FROM w""",
)
def g2_rules(spark, d):
    """A command for each rule of each table, dealt over the documents."""
    cmd = F.element_at(F.array(*[F.lit(x) for x in _EXAMPLES]), (F.col("doc_id") % len(_EXAMPLES) + 1).cast("int"))
    given = docs(spark, d).select("doc_id", cmd.alias("cmd"))
    return given.select("doc_id", _joined(commands.write_reasons(F.col("cmd"))).alias("on_unix"), _joined(commands.write_reasons(F.col("cmd"), windows=True)).alias("on_windows"))


@query(
    "e10_tool_calls",
    """SELECT conv_id, turn, CASE role WHEN 'user' THEN 'n1:{"a": 1}' WHEN 'assistant' THEN 'n2:5' ELSE '' END AS calls,
              CASE role WHEN 'user' THEN 'x  y' WHEN 'assistant' THEN '' ELSE '<tool_call>{bad</tool_call>' END AS text FROM conversations""",
)
def e10(spark, d):
    text = (
        F.when(F.col("role") == "user", 'x <tool_call><name> n1 </name><arguments>{"a": 1}</arguments></tool_call> y')
        .when(F.col("role") == "assistant", '<tool_call>{"name": "n2", "arguments": 5}</tool_call>')
        .otherwise("<tool_call>{bad</tool_call>")
    )
    t = toolcalls.extracted(table(spark, d, "conversations").withColumn("text", text))
    return t.select("conv_id", "turn", _joined(F.transform("calls", lambda c: F.concat_ws(":", c["name"], c["arguments"]))).alias("calls"), "text")
