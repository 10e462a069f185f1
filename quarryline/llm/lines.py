"""Line dedup by deletion neighbourhoods, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut, passes, sieve

#: Lines of fewer words go as exact copies only: one word of them is more than a fifth.
LEAST = 5
#: Words of a line whose running sums are made together.
BLOCK = 256


def normal(text: Column) -> Column:
    """Words lower-cased, with one blank between two, in the lines of a text; words are parted by ASCII white space. A line may still
    begin and end with a blank. The pattern runs only over texts that have white space other than single blanks in a line: a
    search for these strings costs far less."""
    odd = [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\r", "\v", "\f")]
    spaced = F.regexp_replace(text, r"[\x09\x0B-\x0D][\x20\x09\x0B-\x0D]*|\x20[\x20\x09\x0B-\x0D]+", " ")
    return F.lower(F.when(reduce(or_, odd), spaced).otherwise(text))


def _key(tag: str, *parts: Column) -> Column:
    """96 bits of hash, as a struct."""
    return F.struct(F.xxhash64(F.lit(tag), *parts).alias("a"), F.hash(F.lit(tag), *parts).alias("b"))


def _count(w: Column) -> Column:
    return F.octet_length(w) - F.octet_length(F.replace(w, F.lit(" "), F.lit(""))) + 1


def _raw(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, line): all lines; row names the text."""
    return docs.select("doc_id", F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row, pos, w, n): the lines with a word, their words and how many."""
    each = F.posexplode(F.split(normal(F.col("text")), "\n")).alias("pos", "w")
    lines = docs.select("doc_id", F.xxhash64("text").alias("row"), each).withColumn("w", F.trim("w")).where(F.col("w") != "")
    return lines.withColumn("n", _count(F.col("w")))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(hashes: Column, n: Column) -> Column:
    """Exclusive-or of the first hashes, for each number of them: (base, inside), sums up to each block and sums within it. Blocks
    keep the arrays that grow short, so that a line costs little more than its length."""
    grow = lambda xs, of: F.aggregate(xs, F.array(F.lit(0).cast("long")), lambda a, x: F.array_append(a, F.element_at(a, -1).bitwiseXOR(of(x))))
    blocks = lambda hs: F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: grow(F.slice(hs, b * BLOCK + 1, F.lit(BLOCK)), lambda h: h))
    return _let(_let(hashes, blocks), lambda inside: F.struct(grow(inside, lambda x: F.element_at(x, -1)).alias("base"), inside.alias("inside")))


def _first(sums: Column, i: Column) -> Column:
    """Of running sums that of the first ``i`` hashes."""
    block = F.floor(i / BLOCK).cast("int")
    return F.get(sums["base"], block).bitwiseXOR(F.coalesce(F.get(F.get(sums["inside"], block), i % BLOCK), F.lit(0).cast("long")))


def _deletions(word: Column, n: Column, first: Column, last: Column) -> Column:
    """(i, rest) for each place i from first to last: a hash of the words but the i-th. It is the sum without carry of
    hashes of all words with their places, those after i one place further up; the whole line has n as its i."""
    at = lambda shift: F.transform(word, lambda w, k: F.xxhash64(w, k - shift))
    sums = F.struct(_running(at(0), n).alias("here"), _running(at(1), n).alias("up"))
    each = lambda s, i: _first(s["here"], i).bitwiseXOR(s["all"]).bitwiseXOR(_first(s["up"], i + 1))
    places = lambda s: F.transform(F.sequence(first, last), lambda i: F.struct(i.alias("i"), each(s, i).alias("rest")))
    whole = lambda s: F.array(F.struct(n.alias("i"), _first(s["here"], n).alias("rest")))
    total = lambda s: F.struct(s["here"].alias("here"), s["up"].alias("up"), _first(s["up"], n).alias("all"))
    return _let(sums, lambda s: _let(total(s), lambda t: F.concat(places(t), whole(t))))


def edit_at_most_one(a: Column, b: Column) -> Column:
    """Whether two arrays of words are within one insertion, deletion or replacement: without their common
    beginning and their common end, at most one word of the longer one is left."""

    def common(x: Column, y: Column) -> Column:
        shared = F.least(F.size(x), F.size(y))
        same = F.slice(F.transform(F.arrays_zip(x.alias("x"), y.alias("y")), lambda z: z["x"].eqNullSafe(z["y"])), F.lit(1), shared)
        at = F.array_position(same, F.lit(False))
        return F.when(at > 0, at - 1).otherwise(shared)

    front, back = common(a, b), common(F.reverse(a), F.reverse(b))
    longer, shorter = F.greatest(F.size(a), F.size(b)), F.least(F.size(a), F.size(b))
    return (longer - shorter <= 1) & (longer - F.least(front + back, shorter) <= 1)


def near_lines(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """All lines with a word (doc_id, row, pos, k) of ``docs`` with a key by their words, and the keys (gone) of lines that an
    earlier different line is within one edit of, both of ``least`` words at least.

    Different lines that share no half with another one are left out first: of two lines within one
    edit, the first halves or the second halves are the same, up to a word at the border. The others emit the
    hash of each way to delete one word outside the half they share. Lines of n words that differ in one word share the
    deletion of that word at the same place; a line with one word more shares a deletion with the whole shorter line.
    So each bucket needs only its earliest lines, not its pairs. The words of the two are then compared.
    """
    source = _lines(docs)
    n = F.col("n")
    long, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    front = lambda k: F.xxhash64(F.lit("front"), k, F.call_function("substring_index", F.col("w"), F.lit(" "), k))
    back = lambda k: F.xxhash64(F.lit("back"), k, F.call_function("substring_index", F.col("w"), F.lit(" "), -k))
    whole = n >= least
    second = lambda f: F.when(whole & (long != short), f(short))
    place = F.struct("doc_id", "row", "pos")
    lines = cut(source.select("doc_id", "row", "pos", _key("line", F.col("w")).alias("k"), F.when(whole, front(long)).alias("f0"), second(front).alias("f1"), F.when(whole, back(long)).alias("b0"), second(back).alias("b1")))
    halves = lines.select("k", "doc_id", "row", "pos", F.explode(F.array(*(F.struct(F.col(c).alias("half"), F.lit(c[0]).alias("side")) for c in ("f0", "f1", "b0", "b1")))).alias("x"))
    halves = halves.select("k", "doc_id", "row", "pos", "x.*").where("half is not null")
    # a half of different lines: its smallest and its largest key differ
    shared = cut(halves.groupBy("half").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("half"))
    near = passes(halves, F.col("half"), sieve(shared, "half")).where("_in").join(shared, "half", "left_semi")
    maybe = cut(near.groupBy("k").agg(F.min(place).alias("at"), F.max(F.col("side") == "f").alias("front"), F.max(F.col("side") == "b").alias("back")))
    named = maybe.select("at.*", "at", "front", "back").withColumn("h", F.xxhash64("doc_id", "row", "pos"))
    raw = passes(_raw(docs), F.xxhash64("doc_id", "row", "pos"), sieve(named, "h")).where("_in")
    there = raw.select("doc_id", "row", "pos", F.explode(F.array(F.trim(normal(F.col("line"))))).alias("w"))
    same = [there[c].eqNullSafe(named[c]) for c in ("doc_id", "row", "pos")]
    found = there.join(named, (F.xxhash64(there["doc_id"], there["row"], there["pos"]) == named["h"]) & same[0] & same[1] & same[2])
    candidates = cut(found.select("at", "w", _count(F.col("w")).alias("n"), "front", "back").distinct())

    first, last = F.when(F.col("back"), 0).otherwise(short), F.when(F.col("front"), n - 1).otherwise(n - short - 1)
    spread = candidates.select("at", "n", F.inline(_deletions(F.split("w", " "), n, first, last)))
    # kind 0: one word of n replaced at place i; 1: a whole line of n words; 2: a line of n + 1 words without one
    rest = lambda tag, *more: F.xxhash64(F.lit(tag), *more, "rest")
    own = F.when(F.col("i") == n, F.array(F.struct(F.lit(1).alias("kind"), rest("whole", n).alias("key")))).otherwise(
        F.array(F.struct(F.lit(0).alias("kind"), rest("replaced", n, F.col("i")).alias("key")), F.struct(F.lit(2).alias("kind"), rest("whole", n - 1).alias("key")))
    )
    variants = cut(spread.select("at", F.inline(own)))
    earliest = variants.groupBy("key").agg(
        F.min(F.when(F.col("kind") < 2, F.col("at"))).alias("short"), F.min(F.when(F.col("kind") == 2, F.col("at"))).alias("long"), F.count("*").alias("n")
    )
    other = F.when(F.col("kind") == 1, F.col("long")).otherwise(F.col("short"))
    links = variants.join(earliest.where("n > 1"), "key").select("at", other.alias("other")).where("other < at").distinct()
    texts = candidates.select("at", F.split("w", " ").alias("w"))
    checked = (
        links.join(texts.withColumnRenamed("w", "wa"), "at")
        .join(texts.select(F.col("at").alias("other"), F.col("w").alias("wb")), "other")
        .where(edit_at_most_one(F.col("wa"), F.col("wb")))
        .select("at")
        .distinct()
    )
    return lines.select("doc_id", "row", "pos", "k"), maybe.join(checked, "at", "left_semi").select(F.col("k").alias("gone"))


def dedup(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with _ql_lines int, _ql_removed int, and text without the lines that stand earlier in the table already.

    Lines are parted by \\n. A line with a word goes if the same words stand earlier: in a smaller
    doc_id (null first), or further up in the same text. A line of ``least`` words or more also goes if a line of ``least`` words or more
    within one insertion, deletion or replacement of a word, whatever its length, stands earlier. Whether the earlier line itself
    stays doesn't matter. Lines without a word stay as they are. Repeated rows are one document and change alike; texts of one
    doc_id are ordered by their hash. A null text stays null with 0 lines. An empty table gives no rows. Texts and lines may be very
    long: the work grows with their length. Columns of ``docs`` named _ql_lines or _ql_removed are replaced, others begun by _ql_
    or _ stay.
    """
    docs = docs.drop("_ql_lines", "_ql_removed")
    names, own = docs.columns, [f"own{c}" if c.startswith("_") else c for c in docs.columns]
    docs = docs.toDF(*own)
    lines, near = near_lines(docs, least)
    place = F.struct("doc_id", "row", "pos")
    copied = lines.groupBy("k").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    drop_all = near.select(F.col("gone").alias("k"), F.lit(True).alias("gone"))
    kinds = cut(copied.join(drop_all, "k", "left").where("n > 1 or gone").select("k", "first", F.coalesce("gone", F.lit(False)).alias("gone"), F.xxhash64("k").alias("h")))
    again = passes(lines, F.xxhash64("k"), sieve(kinds, "h")).where("_in").join(kinds, "k")
    drop = again.where(F.col("gone") | (F.struct("doc_id", "row", "pos") != F.col("first")))
    by_doc = cut(drop.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("_ql_gone")).select(F.col("doc_id").alias("_ql_id"), F.col("row").alias("_ql_row"), "_ql_gone"))
    sieved = passes(docs, F.xxhash64("text"), sieve(by_doc, "_ql_row"))
    touched = sieved.where("_in").drop("_in")
    joined = touched.join(by_doc, touched["doc_id"].eqNullSafe(by_doc["_ql_id"]) & (F.xxhash64(touched["text"]) == by_doc["_ql_row"]), "left").drop("_ql_id", "_ql_row")
    found = sieved.where("not _in").drop("_in").withColumn("_ql_gone", F.lit(None).cast("array<int>")).unionByName(joined)
    split = F.split("text", "\n")
    # positions are taken from each other as sets, so many removed lines cost no more than many lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), "_ql_gone")
    kept = F.when(F.col("_ql_gone").isNull(), F.col("text")).otherwise(F.array_join(_let(split, lambda ls: F.transform(stay, lambda i: F.get(ls, i))), "\n"))
    return found.select(
        *(kept.alias(name) if c == "text" else F.col(c).alias(name) for c, name in zip(own, names, strict=True)),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).alias("_ql_lines"),
        F.coalesce(F.when(F.col("_ql_gone").isNotNull(), F.size("_ql_gone")), F.lit(0)).alias("_ql_removed"),
    )


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines, n_removed and text of every row of ``docs``; see dedup()."""
    return dedup(docs.select("doc_id", "text"), least).select("doc_id", F.col("_ql_lines").alias("n_lines"), F.col("_ql_removed").alias("n_removed"), "text")
