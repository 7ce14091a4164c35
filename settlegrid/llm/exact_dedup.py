"""Exact duplicates by a cuckoo filter over live digests whose hits are verified against the bucket's content."""
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import partitions, stored

BLANKS = "[\\x20\\x09-\\x0D]+"
LIVE = 200_000
PARTIAL = "digest binary, keep_id long, keep_tag long, size long"


class CuckooIndex:
    """Set of live keys with values: fingerprints in two candidate buckets of four, each slot beside its stored key.

    A lookup reads two buckets of fingerprints; only on a fingerprint hit is the full key in that slot compared.
    When an insertion has kicked ``kicks`` entries around, the table doubles and every stored key is put in again.
    """
    SLOTS = 4

    def __init__(self, buckets: int = 1024, kicks: int = 200):
        self.buckets, self.kicks, self.live = buckets, kicks, 0
        self._empty()

    def _empty(self):
        self.prints = [0] * (self.buckets * self.SLOTS)
        self.content = [None] * (self.buckets * self.SLOTS)

    def _home(self, key: bytes):
        mark = int.from_bytes(key[8:10], "little") or 1
        return mark, int.from_bytes(key[:8], "little") & (self.buckets - 1)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * 0x5BD1E995) & (self.buckets - 1))

    def find(self, key: bytes):
        """Slot that holds exactly ``key``, or None."""
        mark, home = self._home(key)
        for bucket in (home, self._other(home, mark)):
            for slot in range(bucket * self.SLOTS, bucket * self.SLOTS + self.SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == key:
                    return slot
        return None

    def get(self, key: bytes):
        slot = self.find(key)
        return None if slot is None else self.content[slot][1]

    def insert(self, key: bytes, value) -> None:
        """Add a key that is not live."""
        self.live += 1
        left = self._place((key, value))
        while left is not None:
            entries = [left] + [e for e in self.content if e is not None]
            self.buckets *= 2
            self._empty()
            for entry in entries:
                left = self._place(entry)
                if left is not None:
                    break

    def _place(self, entry):
        """Put an entry in; the entry left without a place, or None."""
        mark, home = self._home(entry[0])
        other = self._other(home, mark)
        for turn in range(self.kicks):
            for bucket in (home, other):
                start = bucket * self.SLOTS
                for slot in range(start, start + self.SLOTS):
                    if not self.prints[slot]:
                        self.prints[slot], self.content[slot] = mark, entry
                        return None
            slot = other * self.SLOTS + turn % self.SLOTS
            entry, self.content[slot] = self.content[slot], entry
            mark, self.prints[slot] = self.prints[slot], mark
            home = other
            other = self._other(home, mark)
        if self.buckets.bit_length() > 24 and self.live < self.buckets:
            raise MemoryError("cuckoo index cannot grow further")
        return entry

    def delete(self, key: bytes) -> bool:
        """Take a live key out; its fingerprint leaves the filter at once."""
        slot = self.find(key)
        if slot is None:
            return False
        self.prints[slot], self.content[slot] = 0, None
        self.live -= 1
        return True

    def entries(self):
        return (e for e in self.content if e is not None)


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space made one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ").cast("binary"), 256))


def _order(pair):
    return (pair[0] is None, pair[0] or 0, pair[1])


def _batch(entries):
    keys, values = zip(*entries) if entries else ((), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.binary()), pa.array([v[0] for v in values], pa.int64()),
         pa.array([v[1] for v in values], pa.int64()), pa.array([v[2] for v in values], pa.int64())],
        ["digest", "keep_id", "keep_tag", "size"])


def _merge(whole: bool, live: int):
    """Task that streams (digest, id, tag, size) through a cuckoo index and returns one row per live digest.

    Where the rows are only one part of all (``whole`` false) the index is handed on and begun anew at ``live`` keys.
    """
    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for key, doc, tag, size in zip(*(c.to_pylist() for c in batch.columns)):
                slot = index.find(key)
                if slot is None:
                    if index.live >= live and not whole:
                        yield _batch(list(index.entries()))
                        index = CuckooIndex()
                    index.insert(key, (doc, tag, size))
                    continue
                old = index.content[slot][1]
                best = min(old[:2], (doc, tag), key=_order)
                index.content[slot] = (key, (*best, old[2] + size))
        found = list(index.entries())
        for start in range(0, len(found), 10_000):
            yield _batch(found[start:start + 10_000])
    return run


def index_digests(rows: DataFrame, live: int = LIVE) -> DataFrame:
    """One row per digest of ``rows`` (digest, doc_id, tag, size): the row that stays and the number of rows.

    First each scan task runs its own index, so a digest with a third of all rows shrinks to one row per task before
    the only shuffle; then tasks that own a share of the digests (about ``live`` each) merge these.
    """
    parts = rows.select("digest", F.col("doc_id").alias("keep_id"), F.col("tag").alias("keep_tag"), "size")
    parts = stored(parts.mapInArrow(_merge(False, live), PARTIAL))
    tasks = partitions(rows.sparkSession, parts.count(), live)
    return parts.repartition(tasks, "digest").mapInArrow(_merge(True, live), PARTIAL)


def _apply(live: int):
    """Task over (digest, change): insertions come before deletions; a digest leaves the index when its count is 0."""
    def run(batches):
        index = CuckooIndex()
        for batch in batches:
            for key, change in zip(*(c.to_pylist() for c in batch.columns)):
                slot = index.find(key)
                count = change + (0 if slot is None else index.content[slot][1])
                if slot is None:
                    index.insert(key, count)
                elif count == 0:
                    index.delete(key)
                else:
                    index.content[slot] = (key, count)
        found = list(index.entries())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()),
                                          pa.array([v for _, v in found], pa.int64())], ["digest", "size"])
    return run


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame, live: int = LIVE) -> DataFrame:
    """Live digests (digest, size) after texts came and went; counts that end at or below 0 are not live."""
    def change(df, sign):
        return df.groupBy("digest").agg((F.count("*") * sign).alias("size"))
    rows = index.select("digest", "size").unionByName(change(added, 1)).unionByName(change(removed, -1))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    merged = rows.repartition(tasks, "digest").sortWithinPartitions("digest", F.col("size").desc())
    return merged.mapInArrow(_apply(live), "digest binary, size long").where("size > 0")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the smallest id stays, null ids last; of repeated rows with that same id
    one stays. Empty input gives an empty result; other columns are not read.
    """
    rows = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col)).alias("digest"))
                  .withColumns({"tag": F.monotonically_increasing_id(), "size": F.lit(1).cast("long")}))
    groups = index_digests(rows)
    joined = rows.drop("size").join(groups, "digest")
    return joined.select("doc_id", "keep_id", F.col("size").alias("group_size"), (F.col("tag") == F.col("keep_tag")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns whatever their names; the rules of :func:`exact_groups`.

    Rows travel as one struct beside the keys, so no name of theirs can clash. Of repeated rows one stays; they meet after
    a combination on the map side.
    """
    given, key = F.col(id_col).cast("long"), digest_of(F.col(text_col))
    rows = docs.select(given.alias("doc_id"), key.alias("digest"), F.lit(0).cast("long").alias("tag"), F.lit(1).cast("long").alias("size"))
    kept = index_digests(rows).select("digest", F.coalesce("keep_id", F.lit(-1)).alias("id"), F.col("keep_id").isNull().alias("none"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    tagged = docs.select(whole, key.alias("digest"), F.coalesce(given, F.lit(-1)).alias("id"), F.col(id_col).isNull().alias("none"))
    on = ["digest", "id", "none"]
    return tagged.join(kept, on).dropDuplicates(on).select("row.*")
