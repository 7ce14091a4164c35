"""Shards of near-equal bytes by histogram sort: splitters are refined until exact counts meet the tolerance."""
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import stored

LAW = "bytes"
RESULT = "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int"
TOP = 1 << 63
ROWS_PER_RANGE = 250_000


def sort_key(doc_id: Column, text: Column) -> Column:
    """Non-negative 63-bit key: 39 hash bits of the text, so copies stand together, then 24 of the id, so that even a
    third of all rows with one text can be cut."""
    group = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND((1 << 39) - 1)
    return F.shiftleft(group, 24).bitwiseOR(F.xxhash64(doc_id.cast("string")).bitwiseAND((1 << 24) - 1))


def _histogram(edges, weight):
    """Task: exact weight and rows of its rows in each interval between ``edges`` (sorted; an edge opens an interval)."""
    def run(frames):
        total, rows = np.zeros(len(edges) + 1, np.int64), np.zeros(len(edges) + 1, np.int64)
        for frame in frames:
            at = np.searchsorted(edges, frame["key"].to_numpy(), "right")
            np.add.at(total, at, frame[weight].to_numpy())
            rows += np.bincount(at, minlength=len(edges) + 1)
        held = np.flatnonzero(rows)
        yield pd.DataFrame({"at": held, "total": total[held], "n": rows[held]})
    return run


def count_between(rows: DataFrame, edges: list, weight: str = "size"):
    """Exact (weight, rows) per interval of ``edges`` over all partitions; the answer has as many entries as edges."""
    parts = rows.select("key", weight).mapInPandas(_histogram(np.array(edges, np.int64), weight), "at int, total long, n long")
    total, n = [0] * (len(edges) + 1), [0] * (len(edges) + 1)
    for at, t, k in parts.groupBy("at").agg(F.sum("total"), F.sum("n")).collect():
        total[at], n[at] = t, k
    return total, n


def splitters(rows: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 15, weight: str = "size") -> list:
    """``shards - 1`` keys so that the weight below each is its share of all, within ``tolerance`` of a shard.

    Every round puts ``probes`` keys into the interval that still holds each splitter, counts the exact weight below
    all of them in one pass and narrows the intervals. A splitter is done when it meets the tolerance or when its
    interval holds no key to cut at. Keys are hashes, so the first probes are guesses around the expected place.
    """
    total = sum(count_between(rows, [], weight)[0])
    goals = [total * k / shards for k in range(1, shards)]
    slack = tolerance * total / shards
    low, high = [0] * len(goals), [TOP - 1] * len(goals)
    under, over = [0] * len(goals), [total] * len(goals)
    best = [(abs(g), 0) if g <= total - g else (total - g, TOP - 1) for g in goals]
    while True:
        edges = set()
        for k, goal in enumerate(goals):
            if best[k][0] <= slack or high[k] - low[k] <= 1 or over[k] == under[k]:
                continue
            width = high[k] - low[k]
            guess = low[k] + int(width * min(max((goal - under[k]) / (over[k] - under[k]), 0), 1))
            for i in range(1, probes + 1):
                if i % 2:
                    edges.add(low[k] + width * i // (probes + 1))
                else:  # close to the guess, on both sides of it
                    edges.add(min(max(guess + (i - probes // 2 - 1) * max(width // 512, 1), low[k] + 1), high[k] - 1))
        edges = sorted(e for e in edges if 0 < e < TOP)
        if not edges:
            return [b[1] for b in best]
        below, sums = 0, []
        for part in count_between(rows, edges, weight)[0][:-1]:
            below += part
            sums.append(below)
        for k, goal in enumerate(goals):
            i = bisect_right(sums, goal)
            if i and edges[i - 1] > low[k]:
                low[k], under[k] = edges[i - 1], sums[i - 1]
            if i < len(edges) and edges[i] < high[k]:
                high[k], over[k] = edges[i], sums[i]
            best[k] = min([best[k]] + [(abs(sums[j] - goal), edges[j]) for j in (i - 1, i) if 0 <= j < len(edges)])


def _placed(edges):
    """Task: the interval of ``edges`` that each row falls into."""
    def run(frames):
        for frame in frames:
            yield frame.assign(at=np.searchsorted(edges, frame["key"].to_numpy(), "right").astype("int32"))
    return run


def _numbered(owner, first):
    """Task over rows in the order of their intervals, each interval whole: shard and gapless slot."""
    def run(frames):
        last, done = None, 0
        for frame in frames:
            at = frame["at"].to_numpy()
            start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
            run_no = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
            if len(at) and at[0] == last:
                run_no[:start[1] if len(start) > 1 else None] += done
            if len(at):
                last, done = at[-1], int(run_no[-1]) + 1
            yield frame[["doc_id", "size", "text_crc32"]].assign(
                law=LAW, shard=owner[at].astype("int32"), slot=first[at] + run_no, grown_shard=pd.array([None] * len(at), "Int32"))
    return run


def shard(docs: DataFrame, shards: int = 40, tolerance: float = 0.001, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the text's bytes (null: none) plus 16, and the law ``bytes``: shards get equal sizes. Rows are in the order
    of :func:`sort_key`, so copies of a text share a shard unless they have to be cut. For the numbering inside
    shards the key range is also cut by row counts, so a task sorts about ``ROWS_PER_RANGE`` rows even if a shard
    holds very many small ones; exact counts give each range its first slot. Rows equal in all that is read here get
    slots in any order. ``grown_shard`` is null under this law. Empty input gives an empty result.
    """
    doc, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = stored(docs.select(doc.alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
                              F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
                              sort_key(doc, text).alias("key"), F.lit(1).cast("long").alias("one")))
    spark = docs.sparkSession
    cuts = sorted(splitters(rows, shards, tolerance))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS_PER_RANGE))
    fine = splitters(rows, tasks, 0.1, weight="one")
    edges = sorted(set(cuts) | set(fine))
    counts = count_between(rows, edges)[1]
    owner = [bisect_right(cuts, edges[i - 1] if i else -1) for i in range(len(counts))]
    first, filled = [], {}
    for home, n in zip(owner, counts):
        first.append(filled.get(home, 0))
        filled[home] = first[-1] + n
    placed = rows.drop("one").mapInPandas(
        _placed(np.array(edges, np.int64)), "doc_id long, size long, text_crc32 long, key long, at int")
    ordered = placed.repartitionByRange(tasks, "at").sortWithinPartitions("at", "key", "doc_id", "size")
    return ordered.mapInPandas(_numbered(np.array(owner), np.array(first)), RESULT)
