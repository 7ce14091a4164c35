"""Best-fit packing of tokenised documents, improved by moves and swaps between underfull bins."""
import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import partitions, slices, stored

LIMIT = 2048
END = 0
BLOCK = 16_000
SPECIAL = ("<|endoftext|>", 50256)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary() -> str:
    """Place of the public vocabulary's ranks on this machine; pass another path to use another vocabulary."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(path=None):
    """Function from a text to its ids, kept for the life of the worker.

    The rank file holds the vocabulary and merges of the JSON file of the same name and gives the same ids some four
    times as fast; the special token's string gets its own id, as there.
    """
    import public_tokenizers
    import tiktoken
    path = path or vocabulary()
    known = tiktoken.registry.ENCODINGS
    if path not in known:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        known[path] = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                        special_tokens=dict([SPECIAL]))
    made = known[path]
    return lambda text: made.encode(text, allowed_special="all") if SPECIAL[0] in text else made.encode_ordinary(text)


def cuts(total: int, limit: int = LIMIT):
    """(start, stop) of each piece: the first takes what does not fill a whole piece."""
    first = total % limit or min(limit, total)
    stops = range(first, total + 1, limit)
    return [(max(0, stop - limit) if stop > first else 0, stop) for stop in stops]


def _tokenise(path, limit, with_ids):
    def run(batches):
        encode = encoder(path)
        for batch in slices(batches):
            out, doc_ids = [], batch.column(0).to_pylist()
            for doc, text in zip(doc_ids, batch.column(1).to_pylist()):
                ids = np.array(encode(text or "") + [END], "<u4")
                for piece, (a, b) in enumerate(cuts(len(ids), limit)):
                    part = ids[a:b]
                    out.append((doc, piece, a, b - a, zlib.crc32(part.tobytes())) + ((part,) if with_ids else ()))
            cols = list(zip(*out)) or [()] * (6 if with_ids else 5)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(cols)])
    return run


def pieces(docs: DataFrame, path=None, limit: int = LIMIT, with_ids: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece of every document: ids of the whole text, then the end id, cut to ``limit``."""
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col))
    return rows.mapInArrow(_tokenise(path, limit, with_ids), PIECES + ", ids array<int>" * with_ids)


def best_fit(lengths, limit: int = LIMIT):
    """Bin of each length: longest first, each into the fullest bin that has room. One bit per free space finds it."""
    bins, spare, mask, made = [0] * len(lengths), {}, 0, 0
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        room = mask >> n
        if room:
            gap = n + (room & -room).bit_length() - 1
            home = spare[gap].pop()
            if not spare[gap]:
                mask ^= 1 << gap
        else:
            home, gap, made = made, limit, made + 1
        bins[i] = home
        if gap > n:
            spare.setdefault(gap - n, []).append(home)
            mask |= 1 << (gap - n)
    return bins, made


def improve(lengths, bins, limit: int = LIMIT):
    """Empty the least filled bins by moves, one-for-one and two-for-one exchanges into fuller underfull bins.

    The step taken is always the one that adds most to the sum of squared fills, so the search ends: at the bound (all
    lengths over ``limit``, rounded up), or when a pass over all underfull bins empties none. Partners are found in a
    table of the (length, free space) pairs that underfull bins offer, so equal lengths are looked at once.
    """
    home = np.array(bins, np.int64)
    if not len(home):
        return home
    size = np.asarray(lengths, np.int64)
    fill = np.bincount(home, size).astype(np.int64)
    left = int((fill > 0).sum()) - int(-(-size.sum() // limit))
    content = {int(b): {} for b in np.flatnonzero((fill > 0) & (fill < limit))}
    for i, b in enumerate(home.tolist()):
        if b in content:
            content[b].setdefault(int(size[i]), []).append(i)
    width, offers = limit + 1, {}  # length * width + free space: bins; length 0 stands for a plain move

    def place(b, add):
        free = limit - int(fill[b])
        for y in (0, *content[b]):
            if add:
                offers.setdefault(y * width + free, set()).add(b)
            else:
                at = offers[y * width + free]
                at.discard(b)
                if not at:
                    del offers[y * width + free]

    def hand_over(length, a, b):
        """One piece of this length goes from bin a to bin b."""
        i = content[a][length].pop()
        if not content[a][length]:
            del content[a][length]
        content[b].setdefault(length, []).append(i)
        home[i] = b
        fill[a] -= length
        fill[b] += length

    for b in content:
        place(b, True)
    gained = True
    while gained and left > 0:
        gained = False
        for source in sorted(content, key=lambda b: (fill[b], b)):
            if left <= 0:
                break
            if not 0 < fill[source] < limit:
                continue
            place(source, False)
            while fill[source]:
                own = sorted(content[source])
                out = [(x,) for x in own] + [(x, y) for k, x in enumerate(own) for y in own[k:] if x != y or len(content[source][x]) > 1]
                table = np.fromiter(offers, np.int64, len(offers))
                back, free = table // width, table % width
                near = free <= limit - fill[source]
                back, free = back[near], free[near]
                shift = np.array([sum(o) for o in out])[:, None] - back
                gain = np.where((shift > 0) & (shift <= free), shift * (limit - free - fill[source] + shift), 0)
                if not gain.size or not gain.max():
                    break
                k, j = np.unravel_index(int(gain.argmax()), gain.shape)
                target = min(offers[int(back[j]) * width + int(free[j])])
                place(target, False)
                for x in out[k]:
                    hand_over(x, source, target)
                if back[j]:
                    hand_over(int(back[j]), target, source)
                if fill[target] < limit:
                    place(target, True)
            if fill[source]:
                place(source, True)
            else:
                left, gained = left - 1, True
        content = {b: c for b, c in content.items() if 0 < fill[b] < limit}
    return home


def _pack(limit):
    def run(key, frame):
        size = frame["length"].to_numpy()
        part = np.flatnonzero(size < limit)
        lengths = size[part].tolist()
        first, _ = best_fit(lengths, limit)
        home = np.zeros(len(frame), np.int64)
        home[part] = improve(lengths, first, limit)
        home[size >= limit] = len(frame) + np.arange((size >= limit).sum())
        _, local = np.unique(home, return_inverse=True)
        order = np.lexsort((frame["piece"].to_numpy(), local))
        frame, local, size = frame.iloc[order], local[order], size[order]
        before = np.cumsum(size) - size
        start = np.r_[True, local[1:] != local[:-1]]
        offset = before - before[np.flatnonzero(start)][np.cumsum(start) - 1]
        return frame.drop(columns="block").assign(sequence_id=int(key[0]) * (1 << 32) + local, offset=offset)
    return run


def pack(rows: DataFrame, limit: int = LIMIT, block: int = BLOCK) -> DataFrame:
    """``rows`` of pieces plus sequence_id and offset. Blocks of about ``block`` pieces, dealt by a hash of the whole
    row, are packed one by one; a block can waste little more than one sequence, so blocks cost under 0.02 %."""
    spark = rows.sparkSession
    count = rows.count()
    blocks = max(1, -(-count // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64(*rows.columns, F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    dealt = dealt.repartition(partitions(spark, blocks, 4), "block")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("block").applyInPandas(_pack(limit), f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path=None, limit: int = LIMIT, block: int = BLOCK, **columns) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null text counts as empty: a document of the end id alone. Repeated rows and null ids are packed like any other.
    Texts of any length are cut whole. Empty input gives an empty result; other columns are not read.
    """
    return pack(stored(pieces(docs, path, limit, **columns)), limit, block)
