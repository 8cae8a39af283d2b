"""Problem 6: filling containers of fixed capacity with texts.

Method: space-filling-curve order. Hashed document vectors are projected to a few dimensions, their Hilbert key orders the
documents by range, and neighbours along the curve share containers. A task packs its stretch of the curve in blocks of
BLOCK_ITEMS pieces: a text longer than the capacity first fills whole containers by itself, and what is left of it, like
every other text, goes, largest first, to the fullest container of the block that still holds it. No text of at most the
capacity is split. Open containers never outlive their block, so memory is bounded; the room lost to that is a few
containers in each block.

Null and empty texts have size 0 and are placed too (they fill nothing). Containers are numbered by stretch (18 bits), block (18 bits) and place (27 bits).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import tokens
from weftline.session import cut

BLOCK_ITEMS = 4096
#: Rows of the table of capacities; it is a parameter and must stay small.
MOST_SIZES = 1000


def pack_block(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container of each piece (each at most capacity), numbered from 0: best fit, largest first, ties in order."""
    where = np.zeros(len(sizes), np.int64)
    free_of: list[int] = []
    by_free: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            f = s + (fits & -fits).bit_length() - 1
            c = by_free[f].pop()
            if not by_free[f]:
                mask &= ~(1 << f)
        else:
            c, f = len(free_of), capacity
            free_of.append(0)
        f -= s
        free_of[c] = f
        by_free.setdefault(f, []).append(c)
        mask |= 1 << f
        where[i] = c
    return where


def _pack(sizes: list[tuple[int, int]], block_items: int):
    def block(ids: np.ndarray, n: np.ndarray, base: int):
        for pack_id, cap in sizes:
            whole = n // cap
            rest = n - whole * cap
            has_rest = (rest > 0) | (n == 0)
            part = np.flatnonzero(has_rest)
            box = pack_block(rest[part], cap)
            used = int(box.max()) + 1 if len(box) else 0
            owner = np.repeat(np.arange(len(n)), whole)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(whole) - whole, whole)
            doc = np.r_[ids[part], ids[owner]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(doc), pack_id, np.int32)),
                    pa.array(base + np.r_[box, used + np.arange(len(owner))]),
                    pa.array(doc),
                    pa.array(np.r_[whole[part], piece]),
                    pa.array(np.r_[whole[part] * cap, piece * cap]),
                    pa.array(np.r_[rest[part], np.full(len(owner), cap)]),
                ],
                names=["pack_id", "container", "doc", "piece", "first_token", "n_tokens"],
            )

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, k = TaskContext.get().partitionId(), 0
        ids, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            ids = np.r_[ids, b.column(0).to_numpy(zero_copy_only=False)]
            n = np.r_[n, b.column(1).to_numpy(zero_copy_only=False)]
            while len(ids) >= block_items:
                yield from block(ids[:block_items], n[:block_items], (stretch << 45) + (k << 27))
                ids, n, k = ids[block_items:], n[block_items:], k + 1
        if len(ids):
            yield from block(ids, n, (stretch << 45) + (k << 27))

    return walk


def capacities(sizes: DataFrame) -> list[tuple[int, int]]:
    """The distinct (pack_id, capacity) of at least one token; a pack_id with two capacities is an error."""
    rows = sizes.filter("pack_id IS NOT NULL AND capacity_tokens >= 1").select(F.col("pack_id").cast("int"), F.col("capacity_tokens").cast("long")).distinct().limit(MOST_SIZES + 1).collect()
    if len(rows) > MOST_SIZES or len({r[0] for r in rows}) < len(rows):
        raise ValueError(f"at most {MOST_SIZES} capacities, one for each pack_id")
    return sorted((r[0], r[1]) for r in rows)


def pack(docs: DataFrame, sizes: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = tokens.VOCAB, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(pack_id, container, id, piece, first_token, n_tokens): every text in containers of each capacity.

    A text of at most the capacity is one piece; a longer one is cut into pieces of the capacity and a rest."""
    caps = capacities(sizes)
    spark = docs.sparkSession
    if not caps:
        return spark.createDataFrame([], f"pack_id int, container long, {id_col} long, piece long, first_token long, n_tokens long")
    sized = cut(tokens.measured(docs, id_col, text_col, vocab=vocab).select(F.col(id_col).alias("doc"), F.coalesce("n_tokens", F.lit(0)).alias("n"), "place"), "sizes")
    along = sized.repartitionByRange("place", "doc").sortWithinPartitions("place", "doc").select("doc", "n")
    out = along.mapInArrow(_pack(caps, block_items), "pack_id int, container long, doc long, piece long, first_token long, n_tokens long")
    return out.withColumnRenamed("doc", id_col)


def report(packed: DataFrame, sizes: DataFrame) -> DataFrame:
    """(pack_id, capacity_tokens, containers, pieces, tokens, fill): how full the containers of each capacity are."""
    per = packed.groupBy("pack_id", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("k"))
    one = per.groupBy("pack_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("k").alias("pieces"), F.sum("t").alias("tokens"))
    caps = sizes.select(F.col("pack_id").cast("int").alias("pack_id"), F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    return one.join(caps, "pack_id").select("pack_id", "capacity_tokens", "containers", "pieces", "tokens", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("fill"))
