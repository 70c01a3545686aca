"""Shards by a hierarchical weighted hash tree (operator 8).

Regions hold racks, racks hold shards, and a node weighs what its shards weigh.
A key descends the three levels; at each, every child draws an exponential
number from a hash of the key and the child's name, divided by the child's
weight, and the least draw wins. So keys spread by weight, and a change of one
weight moves keys only into or out of the subtrees that hold it. A new shard
opens a region of its own: no other weight changes, and it takes keys only
into itself.

Slots are numbered without a task for each shard: rows get a bucket within
their shard, buckets are counted, and a row's slot is its rank in the bucket
after the buckets before it.

Edge cases: a null text has size 16 and the CRC of the empty text; rows with a
null id share one key; rows with equal ids share a shard and have slots of
their own; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.common import stage


@dataclass(frozen=True)
class Node:
    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own_weight: float = field(default=1.0)

    @property
    def weight(self) -> float:
        return sum(c.weight for c in self.children) if self.children else self.own_weight


def tree(shards: int, per_rack: int = 5, racks_per_region: int = 2, weights: dict[int, float] | None = None) -> Node:
    """A tree of equal racks and regions over shards ``0 .. shards - 1``."""
    weights = weights or {}

    def leaf(s: int) -> Node:
        return Node(f"shard{s}", shard=s, own_weight=weights.get(s, 1.0))

    racks = [
        Node(f"rack{i // per_rack}", tuple(leaf(s) for s in range(i, min(shards, i + per_rack))))
        for i in range(0, shards, per_rack)
    ]
    regions = [
        Node(f"region{i // racks_per_region}", tuple(racks[i : i + racks_per_region]))
        for i in range(0, len(racks), racks_per_region)
    ]
    return Node("root", tuple(regions))


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a rack and region of its own."""
    leaf = Node(f"shard{shard}", shard=shard, own_weight=weight)
    region = Node(f"region+{shard}", (Node(f"rack+{shard}", (leaf,)),))
    return Node(root.name, (*root.children, region))


def draw(key: Column, node: Node) -> Column:
    """An exponential draw: the first 52 bits of MD5 as a uniform number."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f"/{node.name}")).cast("binary")), 1, 13), 16, 10)
    return -F.ln((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / F.lit(node.weight)


def _by_level(rows: DataFrame, root: Node, name: str) -> DataFrame:
    """``rows`` with the shard that column ``_key`` reaches, one level a step.

    Each level's winner is a column, so that a key draws only among the
    children of the node it has reached.
    """
    key, level, reached = F.col("_key"), [root], None
    for step in range(3):
        inner = [n for n in level if n.shard is None]
        if not inner:
            break
        following = [c for n in inner for c in n.children]
        at = {c.name: i for i, c in enumerate(following)}
        out = F.lit(None).cast("int")
        for i, n in reversed(list(enumerate(level))):
            if len(n.children) == 1:
                pick = F.lit(at[n.children[0].name])
            else:
                pick = F.array_min(
                    F.array(
                        *(
                            F.struct(draw(key, c).alias("d"), F.lit(at[c.name]).alias("i"))
                            for c in n.children
                        )
                    )
                )["i"]
            out = pick if reached is None else F.when(F.col(reached) == i, pick).otherwise(out)
        reached = f"_{name}{step}"
        rows = rows.withColumn(reached, out)
        level = following
    shards = F.array(*(F.lit(n.shard) for n in level))
    return rows.withColumn(name, shards[F.col(reached)])


def assign_shards(
    docs: DataFrame,
    root: Node,
    more: Node | None = None,
    rows_per_bucket: int = 20_000,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id, size, text_crc32, shard, slot[, grown_shard])`` of every document.

    ``more`` is a second tree, such as ``grown(root, n)``, whose shard is added
    as ``grown_shard``. The assignment is written to the checkpoint folder once,
    as slots need counts of it.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("_key"),
    )
    rows = _by_level(rows, root, "shard")
    if more is not None:
        rows = _by_level(rows, more, "grown_shard")
    names = ["id", "size", "text_crc32", "shard", *(["grown_shard"] if more is not None else [])]
    # Rows are dealt to buckets by their place in the table, which spreads a
    # repeated key too; the written table fixes them.
    rows = stage(
        rows.select(*names, F.monotonically_increasing_id().alias("place")), "shards"
    )
    counts = rows.count()
    buckets = 1 + counts // rows_per_bucket
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("place"), F.lit(buckets)))
    sizes = stage(rows.groupBy("shard", "bucket").agg(F.count("*").alias("n")), "buckets")
    before = sizes.select(
        F.col("shard").alias("s"),
        F.col("bucket").alias("b"),
        (F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).alias("before"),
    )
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("place"))
    ranked = rows.withColumn("rank", rank)
    return ranked.join(
        before, (F.col("shard") == F.col("s")) & (F.col("bucket") == F.col("b"))
    ).select(
        F.col("id").alias(id_col),
        *names[1:],
        (F.col("before") + F.col("rank") - 1).cast("long").alias("slot"),
    )
