"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted draws.

At every level each child draws ``-ln(u) / weight``, with ``u`` a hash of the row's key and the
child's name, and the least draw wins. A child therefore wins with a probability in proportion to
its weight, and a change of one weight moves rows only into or out of that child: movement stays
inside the subtrees whose weights change.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import gapless_rank

#: Hexadecimal digits of the hash that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` is a rack: a tuple of (shard, weight)."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    def __post_init__(self):
        shards = [s for region in self.regions for rack in region for s, _ in rack]
        if not shards or len(shards) != len(set(shards)):
            raise ValueError("a tree needs shards, each of them once")
        if any(not w > 0 for region in self.regions for rack in region for _, w in rack):
            raise ValueError("weights must be positive")
        if any(not rack for region in self.regions for rack in region) or any(not r for r in self.regions):
            raise ValueError("regions and racks must not be empty")

    def grow(self, shard: int, weight: float = 1.0) -> Tree:
        """One more shard, in a region of its own: no other subtree gains weight, so rows move
        only into the new shard."""
        return Tree((*self.regions, (((shard, weight),),)))


def balanced_tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 5) -> Tree:
    """Shards 0 to ``shards - 1`` of equal weight, dealt in order to racks and regions."""
    racks = [tuple((s, 1.0) for s in range(a, min(shards, a + shards_per_rack))) for a in range(0, shards, shards_per_rack)]
    return Tree(tuple(tuple(racks[a : a + racks_per_region]) for a in range(0, len(racks), racks_per_region)))


def levels(tree: Tree) -> tuple[list, list[list], list[list]]:
    """The children at each level as (name, weight, next): next leads to the list one level down,
    and at the last to the shard."""
    regions, racks, leaves = [], [], []
    for r, region in enumerate(tree.regions):
        mine = []
        for k, rack in enumerate(region):
            mine.append((f"r{r}/k{k}", sum(w for _, w in rack), len(leaves)))
            leaves.append([(f"r{r}/k{k}/s{s}", w, s) for s, w in rack])
        regions.append((f"r{r}", sum(w for _, w, _ in mine), len(racks)))
        racks.append(mine)
    return regions, racks, leaves


def _children(rows: list) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight"), F.lit(x).alias("next")) for n, w, x in rows])


def _draw(key: Column, children: Column) -> Column:
    def cost(c):
        u = (F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), c["name"])), 1, DRAW_DIGITS), 16, 10).cast("double") + 0.5) / float(16**DRAW_DIGITS)
        return F.struct((-F.ln(u) / c["weight"]).alias("cost"), c["name"].alias("name"), c["next"].alias("next"))

    return F.array_min(F.transform(children, cost))["next"]


def place(df: DataFrame, key: str, tree: Tree, name: str = "shard") -> DataFrame:
    """Add ``name``: the shard of each row, decided by ``key`` and the tree alone.

    A null key is a key like any other. Equal keys meet in one shard.
    """
    regions, racks, leaves = levels(tree)
    word = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    a, b = f"__{name}_region", f"__{name}_rack"
    return (
        df.withColumn(a, _draw(word, _children(regions)))
        .withColumn(b, _draw(word, F.array(*map(_children, racks))[F.col(a)]))
        .withColumn(name, _draw(word, F.array(*map(_children, leaves))[F.col(b)]).cast("int"))
        .drop(a, b)
    )


def shard_documents(df: DataFrame, tree: Tree, new_shard: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's shard, its place inside it, and its shard once ``new_shard`` is added.

    ``slot`` runs from 0 without gaps in each shard. A null text has no bytes and crc32 0; an
    empty table gives none; repeated rows keep a slot each. Other columns of ``df`` are dropped,
    so that no name can clash.
    """
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(16)).cast("long").alias("size"),
        F.crc32(F.coalesce(F.encode(F.col(text_col), "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = place(place(rows, "doc_id", tree), "doc_id", tree.grow(new_shard), "grown_shard")
    rows = gapless_rank(rows, ["shard"], ["doc_id", "size", "text_crc32"], "slot")
    return rows.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
