"""Scans of files as tables (path, text): search, slices, edits, listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Folders that searches pass over; size of a file, and characters of a line, that they take.
SKIPPED_FOLDERS = (".git", ".hg", ".svn", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".next", "target")
LARGEST_FILE, LINE_CAP, READ_CAP = 2_000_000, 200, 100_000


def lines(files: DataFrame, key: str = "path", text: str = "text") -> DataFrame:
    """(key, line_no from 1, line)."""
    return files.select(key, F.posexplode(F.split(text, "\n")).alias("_i", "line")).select(key, (F.col("_i") + 1).alias("line_no"), "line")


def searchable(path: Column, size: Column) -> Column:
    """Whether a search reads a file: not in a skipped folder, not hidden, not too large. Hidden folders are read."""
    folder = rf"(^|/)({'|'.join(re.escape(f) for f in SKIPPED_FOLDERS)})/"
    return ~F.rlike(path, F.lit(folder)) & ~F.rlike(path, F.lit(r"(^|/)\.[^/]*$")) & (size <= LARGEST_FILE)


def grep(files: DataFrame, pattern: str, key: str = "path", cap: int = LINE_CAP) -> DataFrame:
    """Lines that match, case and all, cut to ``cap`` characters."""
    return lines(files, key).where(F.rlike("line", F.lit(pattern))).withColumn("line", F.substring("line", 1, cap))


def grep_context(files: DataFrame, pattern: str, before: int, after: int, key: str = "path") -> DataFrame:
    """Matching lines and those around them, each once; ``hit`` marks the matching ones."""
    w = W.partitionBy(key).orderBy("line_no")
    marked = lines(files, key).withColumn("hit", F.rlike("line", F.lit(pattern)))
    # a line is shown if a hit stands at most ``after`` lines above or ``before`` lines below it
    near = F.max(F.col("hit").cast("int")).over(w.rowsBetween(-after, before))
    return marked.withColumn("_n", near).where("_n = 1").drop("_n")


def code_search(files: DataFrame, term: str, key: str = "path") -> DataFrame:
    """Lines that contain a term, whatever its case."""
    return lines(files, key).where(F.contains(F.lower("line"), F.lit(term.lower())))


def line_slice(text: Column, first: int, last: int, cap: int = READ_CAP) -> Column:
    """Lines first to last, from 1, both included; their ends stay but for the very last one's."""
    part = F.slice(F.split(text, "\n"), max(first, 1), max(last - max(first, 1) + 1, 0))
    return F.substring(F.array_join(part, "\n"), 1, cap)


def occurrences(text: Column, old: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(old), F.lit("")))) / len(old)).cast("int")


def edited(files: DataFrame, old: str, new: str, replace_all: bool = False) -> DataFrame:
    """files with text and error: an empty ``old``, none of it, or several without ``replace_all`` leave the text as it is."""
    if not old:
        return files.withColumn("error", F.lit("empty"))
    n = occurrences(F.col("text"), old)
    error = F.when(n == 0, "not found").when((n > 1) & F.lit(not replace_all), "not unique")
    return files.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.replace("text", F.lit(old), F.lit(new))).otherwise(F.col("text")))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob; ** crosses folders."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def find(files: DataFrame, glob: str, most: int | None = None) -> DataFrame:
    """Paths that match, sorted; a cap takes the first ones in that order."""
    found = files.where(F.rlike("path", F.lit(glob_pattern(glob)))).orderBy("path")
    return found if most is None else found.limit(most)


def tree(files: DataFrame, depth: int = 3, most: int = 500) -> DataFrame:
    """(path, name, level, folder): folders and files down to a depth; folders first, then by lower-cased name."""
    parts = F.split("path", "/")
    levels = F.sequence(F.lit(1), F.least(F.size(parts), F.lit(depth)))
    nodes = files.select(parts.alias("p"), F.explode(levels).alias("level")).select(
        F.array_join(F.slice("p", F.lit(1), F.col("level")), "/").alias("path"), F.element_at("p", F.col("level")).alias("name"), "level", (F.col("level") < F.size("p")).alias("folder")
    )
    return nodes.groupBy("path", "name", "level").agg(F.max("folder").alias("folder")).orderBy("level", F.desc("folder"), F.lower("name"), "path").limit(most)


def skill_search(skills: DataFrame, words: str) -> DataFrame:
    """Skills (name, description) whose name and description contain the words as one text, whatever their case."""
    term = words.strip().lower()
    if not term:
        raise ValueError("an empty search")
    return skills.where(F.contains(F.lower(F.concat_ws(" ", "name", "description")), F.lit(term)))
