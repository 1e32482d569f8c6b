"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (here: equal texts) are sorted by size and enter the bin with the tightest remaining capacity
that holds them. Groups of one size are interchangeable, so the packing runs over the table of
(size, number of groups): at most sqrt(2 x total bytes) rows, whatever the number of documents.
A run of equal groups goes into the tightest bin until it is full, then into the next, which is
what one group after the other would do. The balanced order of bins is a sorted list of (room, bin).

Who goes where inside a run is settled by a distributed numbering, so every group is placed by a
join on (size, position) and every document by a join on its group. No text is shuffled: rows carry
a 256-bit digest.

Defined results: a null text has size 1 and its own group; empty texts are a group; repeated rows
each take a slot; an empty table gives an empty result. If no bin can hold a group (one text may
have a third of all rows) it goes to the emptiest bin and that bin exceeds its capacity.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import numbered, stored, text_digest
from tabwright.llm.registry import register, table


def best_fit_decreasing(runs: list[tuple[int, int]], capacity: int, bins: int | None = None) -> list[tuple]:
    """[(size, first, end, bin)]: groups first..end-1 of that size enter the bin.

    `runs` holds (size, number of groups). With `bins` there are exactly so many; without, bins are
    opened as needed, and a group larger than the capacity gets a bin of its own.
    """
    room: list[tuple[int, int]] = sorted((capacity, -b) for b in range(bins or 0))
    opened, placed = bins or 0, []
    for size, count in sorted(runs, reverse=True):
        done = 0
        while done < count:
            at = bisect_left(room, (size, -(1 << 62)))
            if at < len(room):
                left, b = room.pop(at)
                take = min(count - done, left // size) if size else count - done
            elif bins:
                left, b = room.pop()  # the emptiest
                take = 1
            else:
                left, b = max(capacity, size), -opened
                opened += 1
                take = min(count - done, left // size) if size else count - done
            placed.append((size, done, done + take, -b))
            insort(room, (left - take * size, b))
            done += take
    return placed


def shard(
    documents: DataFrame, shards: int | None = 8, capacity: int | None = None, text: str = "text", id_: str = "doc_id"
) -> DataFrame:
    """doc_id, size, text_crc32, shard and gapless slot of every document.

    With `shards` the capacity is the fair share of all bytes; with `capacity` alone as few shards as
    best-fit-decreasing needs are opened.
    """
    spark = documents.sparkSession
    body = F.col(text)
    slim = stored(
        documents.select(
            F.col(id_).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)).cast("long") + 1).alias("size"),
            F.crc32(F.coalesce(body, F.lit("")).cast("binary")).alias("text_crc32"),
            text_digest(body).alias("_key"),
        ),
        "shard-sizes",
    )
    groups = slim.groupBy("_key").agg(F.sum("size").alias("_bytes"))
    ranked = numbered(groups, ["_bytes"], ["_key"], "_at", "shard-groups")
    runs = [(r["_bytes"], r["n"]) for r in ranked.groupBy("_bytes").agg(F.count(F.lit(1)).alias("n")).toLocalIterator()]
    if capacity is None:
        capacity = -(-sum(s * n for s, n in runs) // shards)
        plan = best_fit_decreasing(runs, capacity, shards)
    else:
        plan = best_fit_decreasing(runs, capacity)
    moves = spark.createDataFrame(plan, "_size long, _from long, _to long, shard int")
    placed = ranked.join(
        moves, (F.col("_bytes") == F.col("_size")) & (F.col("_at") >= F.col("_from")) & (F.col("_at") < F.col("_to"))
    ).select(F.col("_key").alias("_group"), "shard")
    placed = stored(placed, "shard-places")
    full = slim.join(placed, F.col("_key") == F.col("_group")).select("doc_id", "size", "text_crc32", "shard")
    return numbered(full, ["shard"], ["doc_id", "text_crc32"], "slot", "shard-slots")


@register("op5_sharding")
def op5_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents").select("doc_id", "text"), 8).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
