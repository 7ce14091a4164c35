"""Repeated lines: range-partitioned line hashes streamed in order, answered by compressed keep bitmaps."""
import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, slices, stored

BLANK = " \t\n\x0b\x0c\r"
LINES = "hi long, lo long, doc_id long, version long, pos array<int>"
MARKS = "kind int, hi long, lo long, doc_id long, version long, pos array<int>, n long"
DROP, OPEN, TOTAL = 0, 1, 2
ROWS_PER_TASK = 400_000


def key_of(line: str) -> str:
    """The line without ASCII white space at its ends; A-Z are lower-cased when it is hashed."""
    return line.strip(BLANK)


def _hash_lines(shortest: int):
    def run(batches):
        for batch in slices(batches):
            out, where = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if doc is None or not text:
                    continue
                version = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)
                seen = {}
                for pos, line in enumerate(text.split("\n")):
                    if len(line) >= shortest and len(key := key_of(line)) >= shortest:
                        seen.setdefault(hashlib.blake2b(key.encode().lower(), digest_size=16).digest(), []).append(pos)
                out.extend(seen.items())
                where.extend([(doc, version)] * len(seen))
            halves = np.frombuffer(b"".join(k for k, _ in out), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([w[0] for w in where], pa.int64()),
                 pa.array([w[1] for w in where], pa.int64()), pa.array([p for _, p in out], pa.list_(pa.int32()))],
                ["hi", "lo", "doc_id", "version", "pos"])
    return run


def _stream(least: int):
    """Walk rows in the order (hash, document descending): the first document of a hash is the one that keeps it.

    A hash that begins in this task drops its later documents as soon as ``least`` documents are seen, since the first
    one seen is the largest of all. Only the first hash of a task may have begun in an earlier one, and only the last
    may go on in a later one: their rows stay open and a total per task is handed on. At most ``least - 1`` documents
    are held back for a hash, whatever its size.
    """
    def run(batches):
        out, key, docs, top, last, held, first = [], None, 0, None, None, [], True

        def close(end):
            nonlocal first
            if key is not None and (first or end):
                out.append((TOTAL, *key, top, None, None, docs))
                if not first:
                    out.extend((OPEN, *key, *row, None) for row in held)
            first = False

        def flush():
            kinds, hi, lo, doc, version, pos, n = zip(*out)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(kinds, pa.int32()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(doc, pa.int64()),
                 pa.array(version, pa.int64()), pa.array(pos, pa.list_(pa.int32())), pa.array(n, pa.int64())],
                ["kind", "hi", "lo", "doc_id", "version", "pos", "n"])
            out.clear()
            return batch

        for batch in batches:
            for hi, lo, doc, version, pos in zip(*(c.to_pylist() for c in batch.columns)):
                if (hi, lo) != key:
                    if key is not None:
                        close(False)
                    key, docs, top, last, held = (hi, lo), 0, doc, None, []
                if doc != last:
                    docs, last = docs + 1, doc
                row = (doc, version, pos)
                if first:
                    out.append((OPEN, *key, *row, None))
                elif docs < least:
                    held.append(row)
                else:
                    out.extend((DROP, *key, *r, None) for r in (*held, row) if r[0] != top)
                    held = []
            if len(out) > 20_000:
                yield flush()
        close(True)
        if out:
            yield flush()
    return run


def dropped_lines(docs: DataFrame, shortest: int = 40, least: int = 5, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, version, pos): the line numbers that each document loses. ``version`` tells texts under one id apart."""
    spark = docs.sparkSession
    lines = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
                   .mapInArrow(_hash_lines(shortest), LINES))
    tasks = partitions(spark, lines.count(), ROWS_PER_TASK)
    down = F.col("doc_id").desc()
    ordered = lines.repartitionByRange(tasks, "hi", "lo", down).sortWithinPartitions("hi", "lo", down, "version")
    marks = stored(ordered.mapInArrow(_stream(least), MARKS))
    # at most two totals per task bound what is broadcast; the range keys end at the id, so no document of a hash is shared by two tasks
    totals = marks.where(F.col("kind") == TOTAL).groupBy("hi", "lo").agg(F.sum("n").alias("docs"), F.max("doc_id").alias("top"))
    undecided = marks.where(F.col("kind") == OPEN).select("hi", "lo", "doc_id", "version", "pos")
    late = undecided.join(F.broadcast(totals), ["hi", "lo"]).where((F.col("docs") >= least) & (F.col("doc_id") < F.col("top")))
    return (marks.where(F.col("kind") == DROP).select("doc_id", "version", "pos")
            .unionByName(late.select("doc_id", "version", "pos")))


def _bitmaps(rows):
    """Per document, one bit for each line up to the last dropped one (1: keep), packed and compressed."""
    for batch in rows:
        got = []
        for lists in batch.column(2).to_pylist():
            pos = np.concatenate([np.asarray(p, np.int64) for p in lists])
            bits = np.ones(-(-(int(pos.max()) + 1) // 8) * 8, np.uint8)
            bits[pos] = 0
            got.append(zlib.compress(np.packbits(bits).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got, pa.binary())],
                                         ["doc_id", "version", "keep"])


def keep_bitmaps(docs: DataFrame, shortest: int = 40, least: int = 5, **columns) -> DataFrame:
    """(doc_id, version, keep): compressed bitmaps, one row for each document that loses lines; all others keep all."""
    lost = dropped_lines(docs, shortest, least, **columns)
    return lost.groupBy("doc_id", "version").agg(F.collect_list("pos").alias("pos")).mapInArrow(
        _bitmaps, "doc_id long, version long, keep binary")


def _cut(with_text: bool):
    def run(batches):
        for batch in slices(batches):
            lines, lost, sums, texts = [], [], [], []
            for text, bitmap in zip(batch.column("text").to_pylist(), batch.column("keep").to_pylist()):
                parts = (text or "").split("\n")
                lines.append(len(parts))
                if bitmap is not None:
                    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)).tolist()
                    parts = [p for p, k in zip(parts, bits) if k] + parts[len(bits):]
                lost.append(lines[-1] - len(parts))
                kept = "\n".join(parts)
                sums.append(hashlib.sha256(kept.encode()).hexdigest())
                texts.append(kept)
            cols = [batch.column("doc_id"), pa.array(lines, pa.int64()), pa.array(lost, pa.int64()), pa.array(sums)]
            names = ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(texts)] * with_text, names + ["kept_text"] * with_text)
    return run


def line_dedup(docs: DataFrame, shortest: int = 40, least: int = 5, with_text: bool = False, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_lines, n_dropped, kept_sha256 and, if asked for, kept_text.

    A line's key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least ``shortest`` code
    points in at least ``least`` documents stay in the largest id that holds them only. Null or empty text is one empty
    line. Rows without an id keep all lines and are not counted; repeated rows count as one document, and differing
    texts under one id are one document whose lines are judged text by text. Empty input gives an empty result.
    """
    maps = keep_bitmaps(docs, shortest, least, id_col=id_col, text_col=text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    maps = maps.groupBy("doc_id").agg(F.collect_list(F.struct("version", "keep")).alias("maps"))
    joined = rows.join(maps, "doc_id", "left")
    extra = ", kept_text string" if with_text else ""
    return joined.mapInArrow(_pick, "doc_id long, text string, keep binary").mapInArrow(
        _cut(with_text), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + extra)


def _pick(batches):
    """Choose the bitmap that belongs to the row's own text."""
    for batch in slices(batches):
        found = []
        for text, maps in zip(batch.column("text").to_pylist(), batch.column("maps").to_pylist()):
            one = None
            if maps:
                version = int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True) if text else None
                one = next((m["keep"] for m in maps if m["version"] == version), None)
            found.append(one)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(found, pa.binary())],
                                         ["doc_id", "text", "keep"])
