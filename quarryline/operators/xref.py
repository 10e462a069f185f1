"""Cross-references between program blocks, tag tables and screens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_IN_TABLE, UNKNOWN = "(not in tag table)", "?"


def find(named: DataFrame, name: str) -> DataFrame:
    """The row of a name: exact, else the first case-insensitive one in order of pos; one row at most."""
    return named.where(F.lower("name") == name.lower()).orderBy(F.desc(F.col("name") == name), "pos").limit(1)


def merged_tables(tables: DataFrame) -> DataFrame:
    """tables (priority, name, ...): of each name the row of the smallest priority."""
    cols = [c for c in tables.columns if c not in ("name", "priority")]
    return tables.groupBy("name").agg(F.min_by(F.struct(*cols), "priority").alias("_x"), F.min("priority").alias("priority")).select("name", "priority", "_x.*")


def resolved(references: DataFrame, tags: DataFrame) -> DataFrame:
    """references (ref, ...) with the type and table of tags (name, type, table): of the full reference, else of what
    stands before its first dot, else placeholders."""
    base = F.substring_index("ref", ".", 1)
    own = tags.select(F.col("name").alias("ref"), F.col("type").alias("_t"), F.col("table").alias("_b"))
    first = tags.select(F.col("name").alias("_base"), F.col("type").alias("_t2"), F.col("table").alias("_b2"))
    return (
        references.withColumn("_base", base)
        .join(own, "ref", "left")
        .join(first, "_base", "left")
        .withColumns({"type": F.coalesce("_t", "_t2", F.lit(UNKNOWN)), "table": F.coalesce("_b", "_b2", F.lit(NOT_IN_TABLE))})
        .drop("_base", "_t", "_b", "_t2", "_b2")
    )


def screen_tags(references: DataFrame, tags: DataFrame) -> DataFrame:
    """references (hmi_tag) with their plc_tag, or a note that there is none."""
    return references.join(tags.select("hmi_tag", "plc_tag"), "hmi_tag", "left").withColumn("plc_tag", F.coalesce("plc_tag", F.lit("(not found in HMITags.xlsx)")))


def events_of_elements(functions: DataFrame, elements: DataFrame) -> DataFrame:
    """(element, function): functions whose name begins with the element's and an underscore; not the longest one only."""
    # an equi join on every prefix of a function's name that ends before an underscore
    parts = F.split("function", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "_"))
    heads = functions.where(F.contains(F.col("function"), F.lit("_"))).select("function", F.explode(F.array_distinct(prefixes)).alias("element"))
    return elements.select("element").distinct().join(heads, "element")


def trace(plc: DataFrame, hmi: DataFrame) -> DataFrame:
    """Full outer join of plc (name, ...) and hmi (name, ...) by lower-cased name, with where it was found."""
    a = plc.withColumn("_k", F.lower("name")).withColumnRenamed("name", "plc_name")
    b = hmi.withColumn("_k", F.lower("name")).withColumnRenamed("name", "hmi_name")
    side = F.when(F.col("plc_name").isNull(), "hmi").when(F.col("hmi_name").isNull(), "plc").otherwise("both")
    return a.join(b, "_k", "full_outer").withColumn("found", side).withColumnRenamed("_k", "key")


def coverage(plc: DataFrame, hmi: DataFrame) -> DataFrame:
    """(name, state): bound, plc only, hmi only; names are compared as they are written."""
    a = plc.select("name").distinct().withColumn("_a", F.lit(True))
    b = hmi.select("name").distinct().withColumn("_b", F.lit(True))
    state = F.when(F.col("_a").isNull(), "hmi only").when(F.col("_b").isNull(), "plc only").otherwise("bound")
    return a.join(b, "name", "full_outer").select("name", state.alias("state"))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.join(there.select(key), key, "left_anti")


def inverted(uses: DataFrame, tag: str = "tag", pos: str = "pos", user: str = "user") -> DataFrame:
    """(tag, users): by tag the different users in order of position."""
    first = uses.groupBy(tag, user).agg(F.min(pos).alias("_p"))
    return first.groupBy(tag).agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", user))), lambda x: x[user]).alias("users"))


def summary_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def totals(blocks: DataFrame, uses: DataFrame) -> DataFrame:
    """One row: blocks, blocks by type, uses, different tags."""
    b = blocks.agg(F.count("*").alias("blocks"), *(F.count_if(F.col("type") == t).alias(f"n_{t.lower()}") for t in ("OB", "FC", "DB", "UDT")))
    return b.crossJoin(uses.agg(F.count("*").alias("uses"), F.countDistinct("tag").alias("tags")))  # one row each


def element_summary(elements: DataFrame) -> DataFrame:
    """elements (screen, type, n_events, n_tags, io_role): by screen counts of each type and of what elements have;
    of input, output or display, control or navigation the first that the role names counts."""
    role = F.col("io_role")
    kind = F.when(F.contains(role, F.lit("input")), "inputs").when(F.contains(role, F.lit("output")) | F.contains(role, F.lit("display")), "outputs")
    kind = kind.when(F.contains(role, F.lit("control")) | F.contains(role, F.lit("navigation")), "controls")
    marks = F.array_compact(F.array(F.col("type"), F.when(F.col("n_events") > 0, "with_events"), F.when(F.col("n_tags") > 0, "with_tag_bindings"), kind))
    return elements.select("screen", F.explode(marks).alias("what")).groupBy("screen", "what").agg(F.count("*").alias("n"))


def outer_catalog(live: DataFrame, cached: DataFrame, configured: DataFrame) -> DataFrame:
    """live, cached (server, tool), configured (server, excluded array): all servers with their tools. Live tools win;
    those of the cache only stand disabled; a tool is enabled where it is live and not excluded; a configured server without any is a stub."""
    seen = live.select("server").distinct().withColumn("_live", F.lit(True))
    old = cached.join(seen.select("server"), "server", "left_anti").select("server", "tool", F.lit(False).alias("_on"))
    tools = live.select("server", "tool", F.lit(True).alias("_on")).unionByName(old)
    joined = tools.join(configured, "server", "full_outer")
    on = F.coalesce("_on", F.lit(False)) & ~F.coalesce(F.array_contains("excluded", F.col("tool")), F.lit(False))
    return joined.select("server", "tool", on.alias("enabled"), F.col("tool").isNull().alias("stub"))


def io_role(kind: Column, navigates: Column, writes_tags: Column, code: Column) -> Column:
    """Role of a screen element, from its type, whether its events navigate or have tags, and the code of all of them."""
    button = F.when(navigates, "navigation_button").when(writes_tags, "control_button (writes to PLC)").otherwise("button")
    writes = F.contains(code, F.lit("Set")) | F.contains(code, F.lit("Write"))
    return (
        F.when(kind == "button", button)
        .when(kind == "io_field", F.when(writes, "input (writes to PLC)").otherwise("output (reads from PLC)"))
        .when(kind == "symbolic_io_field", "selection_input")
        .when(kind == "screen_window", "screen_container")
        .when(kind == "bar_graph", "output (visualizes PLC value)")
        .when(kind == "status_display", "output (PLC status)")
        .when(kind == "switch", "input (writes to PLC)")
        .otherwise("display/static")
    )


def latest_instance(instances: DataFrame) -> DataFrame:
    """instances (name, folder, created): of each name the saved one if there is one, else the latest by its time as text."""
    rank = F.struct((F.col("folder") == "Saved").cast("int"), F.col("created"))
    return instances.groupBy("name").agg(F.max_by(F.struct("folder", "created"), rank).alias("x")).select("name", "x.*")


def ordered_targets(moves: DataFrame) -> DataFrame:
    """moves (screen, pos, dst): by screen all targets in order, with repeats."""
    w = F.array_sort(F.collect_list(F.struct("pos", "dst")))
    return moves.groupBy("screen").agg(F.transform(w, lambda x: x["dst"]).alias("targets"))
