"""Sharding with a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.llm.common import cut

#: Bits of a hash draw (a double holds them exactly), and of the ranges that slots are counted in.
DRAW, RANGES = 52, 10


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards, each shard a (number, weight), and the shards added since.

    A document draws a region by the weights of the regions' first shards, then a rack of that region,
    then a shard of that rack. Each shard added later brings its own draw at the top, with its weight:
    a document that it wins goes down the added branch to the new shard and to no other one.
    So a change moves documents only into the subtree whose weight grew.
    """

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]
    added: tuple[tuple[int, float], ...] = ()

    def __post_init__(self) -> None:
        """A weight is above 0 and finite, and each number stands once; a shard that is to take nothing is left out of the tree."""
        shards = [s for region in self.regions for rack in region for s in rack] + list(self.added)
        if any(not 0 < w < float("inf") for _, w in shards):
            raise ValueError("the weight of a shard must be above 0")
        if not shards or len({n for n, _ in shards}) < len(shards) or not all(region and all(region) for region in self.regions):
            raise ValueError("a tree has shards with different numbers, and no empty region or rack")

    @classmethod
    def even(cls, regions: int = 2, racks: int = 2, shards: int = 2) -> Tree:
        return cls(
            tuple(
                tuple(tuple(((r * racks + k) * shards + s, 1.0) for s in range(shards)) for k in range(racks))
                for r in range(regions)
            )
        )

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard; it has the next number."""
        return replace(self, added=(*self.added, (self.count(), weight)))

    def count(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region) + len(self.added)

    def shard(self, key: Column) -> Column:
        """The shard of a document, from its key alone."""

        def draw(children: list[tuple[str, float, Column]]) -> Column:
            """The child of the smallest exponential draw; the first one on a tie."""
            if len(children) == 1:
                return children[0][2]
            straws = [F.struct(exponential(key, name, weight).alias("x"), F.lit(i).alias("i")) for i, (name, weight, _) in enumerate(children)]
            won = F.least(*straws).getField("i")
            out = children[-1][2]
            for i in range(len(children) - 2, -1, -1):
                out = F.when(won == i, children[i][2]).otherwise(out)
            return out

        def of_rack(rack, at: str) -> Column:
            return draw([(f"{at}/s{n}", w, F.lit(n)) for n, w in rack])

        def of_region(region, at: str) -> Column:
            return draw([(f"{at}/k{k}", sum(w for _, w in rack), of_rack(rack, f"{at}/k{k}")) for k, rack in enumerate(region)])

        tops = [(f"r{r}", sum(w for rack in region for _, w in rack), of_region(region, f"r{r}")) for r, region in enumerate(self.regions)]
        return draw([*tops, *((f"+{n}", w, F.lit(n)) for n, w in self.added)])


def exponential(key: Column, name: str, weight: float) -> Column:
    """An exponential draw with the given rate, a function of the key and the node's name."""
    h = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"|{name}"))), 1, DRAW // 4), 16, 10).cast("long")
    return -F.log((h + F.lit(0.5)) / F.lit(float(1 << DRAW))) / F.lit(weight)


def shard(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row of ``docs``.

    The law is `key`: doc_id and the tree decide alone, and one more shard takes rows only into itself.
    size: UTF-8 bytes of the text plus 1 (null: 1). text_crc32: of the UTF-8 bytes (null: of none).
    slot: gapless from 0 in each shard, by a hash of doc_id and text, then doc_id, size and crc;
    rows that are the same in all of these take following slots. They are counted before they are shuffled, and spread again
    at the end, so many copies of a row meet in no task. Null doc_ids are one key of their
    own. An empty table gives no rows; texts are read whole, however long; further columns are ignored. This is the digest;
    assign() keeps the documents.
    """
    placed = docs.select("doc_id", *_digest(tree))
    same = cut(placed.groupBy(*placed.columns).agg(F.count("*").alias("_n")))
    rows = _slots(same, "_n").withColumn("law", F.lit("key"))
    places = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    few = rows.where(F.col("_n") <= COPIES).withColumn("_i", places(F.col("_n")))
    many = rows.where(F.col("_n") > COPIES).withColumn("_c", places(F.ceil(F.col("_n") / COPIES))).repartition("_h", "_c")
    many = many.withColumn("_i", places(F.least(F.lit(COPIES).cast("long"), F.col("_n") - F.col("_c") * COPIES))).withColumn("_i", F.col("_c") * COPIES + F.col("_i"))
    return few.unionByName(many.drop("_c")).withColumn("slot", F.col("slot") + F.col("_i")).select(*DIGEST)


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """All columns of ``docs``, with the columns of shard() but doc_id, their names begun by _ql_ (columns of these names are
    replaced). Rows that are the same are ordered in one task, which spills."""
    docs = docs.drop(*(f"_ql_{c}" for c in DIGEST))
    placed = docs.select("doc_id", *_digest(tree), F.lit(1).cast("long").alias("_one"), F.struct(*docs.columns).alias("_row"))
    rows = _slots(placed, "_one").withColumn("law", F.lit("key"))
    return rows.select("_row.*", *(F.col(c).alias(f"_ql_{c}") for c in DIGEST[1:]))


#: Columns of shard().
DIGEST = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
#: Copies of a row that one task makes at a time.
COPIES = 1 << 16


def _digest(tree: Tree | None) -> list[Column]:
    tree = tree or Tree.even()
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    return [
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        tree.shard(key).cast("int").alias("shard"),
        tree.grown().shard(key).cast("int").alias("grown_shard"),
        F.xxhash64("doc_id", "text").alias("_h"),
    ]


def _slots(placed: DataFrame, n: str) -> DataFrame:
    """``placed`` with slot, its first place: a row takes ``n`` of them. Rows are ordered within ranges of the hash,
    and the counts of a shard's lower ranges (2 ** RANGES rows a shard) are added, so no shard is gathered."""
    placed = placed.withColumn("_r", F.shiftrightunsigned("_h", 64 - RANGES))
    counts = placed.groupBy("shard", "_r").agg(F.sum(n).alias("_all"))
    before = lambda of, w: F.coalesce(F.sum(of).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("shard", "_r", before("_all", W.partitionBy("shard").orderBy("_r")).alias("_below"))
    order = W.partitionBy("shard", "_r").orderBy("_h", "doc_id", "size", "text_crc32")
    return placed.withColumn("_at", before(n, order)).join(offsets, ["shard", "_r"]).withColumn("slot", (F.col("_below") + F.col("_at")).cast("long"))


def write(docs: DataFrame, path: str, tree: Tree | None = None) -> None:
    """The documents with all their columns and those of assign(), one folder for each shard."""
    assign(docs, tree).repartition("_ql_shard", F.pmod("_ql_slot", F.lit(64))).write.partitionBy("_ql_shard").parquet(path)
