"""Benchmark passages in documents: one Aho-Corasick automaton over the items' word windows, each text scanned once."""
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import slices, stored

WINDOW = 10
BLOCK_BYTES = 4_000_000
#: Byte table of the word rule: A-Z lower-cased, other ASCII outside 0-9 and a-z made a space, all else kept.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOUND = "n_words long, n_hit long, items array<long>, spans array<struct<start:int,stop:int>>"


def words_of(text) -> list:
    """Words as UTF-8 bytes; null has none."""
    return (text or "").encode().translate(FOLD).split()


def windows_of(items, width: int) -> dict:
    """Pattern (words between single spaces, one character per byte) to the ids of the items that hold it."""
    found = {}
    for item, text in items:
        words = words_of(text)
        for at in range(max(len(words) - width, 0) + 1 if words else 0):
            pattern = (b" " + b" ".join(words[at:at + width]) + b" ").decode("latin-1")
            found.setdefault(pattern, set()).add(item)
    return found


def automaton(patterns: dict):
    """The automaton, or None without patterns. A match reports its length, its number of words and its items."""
    machine = ahocorasick.Automaton()
    for pattern, items in patterns.items():
        machine.add_word(pattern, (len(pattern), pattern.count(" ") - 1, tuple(items)))
    if len(machine):
        machine.make_automaton()
        return machine
    return None


def scan(machine, text):
    """(n_words, hit words as intervals, item ids) of one text."""
    words = words_of(text)
    if machine is None or not words:
        return len(words), [], set()
    hay = " " + b" ".join(words).decode("latin-1") + " "
    ends, items = {}, set()
    for end, (length, n, ids) in machine.iter(hay):
        start = end - length + 1
        ends[start] = max(ends.get(start, 0), n)
        items.update(ids)
    if not ends:
        return len(words), [], items
    spaces = np.flatnonzero(np.frombuffer(hay.encode("latin-1"), np.uint8) == 32)
    runs = []
    for first, n in sorted(zip(np.searchsorted(spaces, sorted(ends)).tolist(), (ends[s] for s in sorted(ends)))):
        if runs and first <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], first + n)
        else:
            runs.append([first, first + n])
    return len(words), runs, items


def spans_of(text: str, runs) -> list:
    """Code point spans of the runs of words in the text as it was."""
    places = [m.span() for m in WORD.finditer(text)]
    return [{"start": places[a][0], "stop": places[b - 1][1]} for a, b in runs]


def _scanner(patterns):
    def run(batches):
        machine = automaton(patterns)
        for batch in slices(batches):
            n, hit, ids, spans = [], [], [], []
            for text in batch.column("_text").to_pylist():
                count, runs, items = scan(machine, text)
                n.append(count)
                hit.append(sum(b - a for a, b in runs))
                ids.append(sorted(items))
                spans.append(spans_of(text, runs) if runs else [])
            yield pa.RecordBatch.from_arrays(
                [c for name, c in zip(batch.schema.names, batch.columns) if name != "_text"]
                + [pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array(ids, pa.list_(pa.int64())),
                   pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))],
                [name for name in batch.schema.names if name != "_text"] + ["n_words", "n_hit", "items", "spans"])
    return run


def item_blocks(bench: DataFrame, id_col="item_id", text_col="text", block_bytes: int = BLOCK_BYTES) -> list:
    """The items in blocks whose texts together stay near ``block_bytes``; the driver gets one block at a time."""
    size = bench.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    blocks = -(-size // block_bytes) or 1
    rows = bench.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    return [rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b) for b in range(blocks)]


def scan_documents(docs: DataFrame, bench: DataFrame, width: int = WINDOW, text_col: str = "text", keep=("doc_id",),
                   block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with n_words, n_hit, items and spans (code points of the whole text).

    A document word inside any occurrence of an item's window of ``width`` words is hit; an item with fewer words is
    one window. Null and empty texts have no words; items without words or id have no window; repeated items count
    under each id. A benchmark of more than ``block_bytes`` is searched block by block, each with one automaton and one
    scan, and the hits are put together by row. Clashing column names do not matter: only those named are read.
    """
    blocks = item_blocks(bench, block_bytes=block_bytes)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def one(rows, block, columns):
        patterns = windows_of([(r.i, r.t) for r in block.collect()], width)
        return rows.mapInArrow(_scanner(patterns), f"{columns}, {FOUND}" if columns else FOUND)

    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    if len(blocks) == 1:
        return one(rows, blocks[0], kinds)
    # Rows are stored once under a tag; a block's patterns are gone from the driver when its hits are stored.
    rows = stored(rows.withColumn("_tag", F.monotonically_increasing_id()))
    found = None
    for block in blocks:
        hits = stored(one(rows.select("_tag", "_text"), block, "_tag long"))
        found = hits if found is None else found.unionByName(hits)
    merged = found.groupBy("_tag").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return _joined(merged, rows, keep)


def _joined(merged, rows, keep):
    """Spans of several blocks over one text overlap: count the words under their union."""
    def count(batches):
        for batch in slices(batches):
            hit = []
            for text, spans in zip(batch.column("_text").to_pylist(), batch.column("spans").to_pylist()):
                marked = np.zeros(len(text or "") + 1, bool)
                for s in spans:
                    marked[s["start"]:s["stop"]] = True
                hit.append(sum(1 for m in WORD.finditer(text or "") if marked[m.start()]) if spans else 0)
            cols = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in cols] + [pa.array(hit, pa.int64())], cols + ["n_hit"])
    both = rows.join(merged, "_tag").select(*keep, "_text", "n_words", "items", "spans")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.drop("_text").schema)
    return both.mapInArrow(count, f"{kinds}, n_hit long")


def contamination(docs: DataFrame, bench: DataFrame, width: int = WINDOW, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scan_documents(docs, bench, width, **options)
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean_documents(docs: DataFrame, bench: DataFrame, width: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns."""
    names = [f"_c{i}" for i in range(len(docs.columns))]  # so that no column of docs clashes with those of the hits
    found = scan_documents(docs.toDF(*names), bench, width, names[docs.columns.index(text_col)], keep=tuple(names))
    return found.where("n_hit = 0").select(*[F.col(a).alias(b) for a, b in zip(names, docs.columns)])
