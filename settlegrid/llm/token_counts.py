"""Token counts by rank-synchronous merging: ragged numpy arrays of pre-tokens, all lowest-rank pairs at once."""
import itertools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..checks import ContractError
from .common import slices

NEVER = np.int32(2 ** 31 - 1)
COUNTS = "doc_id long, n_bytes long, n_tokens long"

# Bounds of a task's memory; none of them changes a result.
HELD_WORDS = 1 << 19  # pre-tokens of texts waiting for one merge, and counts remembered between merges
HELD_BYTES = 1 << 23  # bytes merged in one set of arrays, but for a single longer pre-token
LONG_WORD = 256       # longer pre-tokens are not remembered
LONG_TEXT = 1 << 20   # longer texts are split a few words at a time

#: The public splitting pattern of these vocabularies; its first two alternatives start differently and may change places.
WORDS = r""" ?\p{L}+|'(?:s|t|re|ve|m|ll|d)| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary() -> str:
    """Place of the public vocabulary on this machine; pass another path to use another byte-level one."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the
    others take the letters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = itertools.count(0x100)
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class Merger:
    """Vocabulary, merge ranks and splitting rule of one byte-level file, and the merging of batches of pre-tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        model, before = made["model"], made["pre_tokenizer"] or {}
        plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not made["normalizer"]
                 and not any(model.get(key) for key in ("dropout", "ignore_merges", "byte_fallback", "fuse_unk",
                                                        "continuing_subword_prefix", "end_of_word_suffix"))
                 and not any(t[key] for t in made["added_tokens"] for key in ("single_word", "lstrip", "rstrip", "normalized")))
        if not plain:
            raise ContractError(f"{path}: only plain byte-level pair merging is known here")
        ids = model["vocab"]
        self.letters = np.array([ids[c] for c in byte_letters()], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        self.words = regex.compile(WORDS)
        added = sorted((t["content"] for t in made["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None

    def rank(self, left, right):
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER)

    def symbols(self, words) -> np.ndarray:
        """Number of symbols left of each pre-token (bytes) after all merges.

        All pre-tokens lie end to end in one array. Each round takes every sequence's lowest rank among its own pairs
        and merges all places of that rank at once, from the left where they overlap ("aaa"). Sequences without a
        mergeable pair leave the arrays, and only ranks next to a merge are looked up again. A pair made by a merge
        ranks behind it, so a round never misses an earlier pair and the rounds equal merging one pair at a time.
        """
        length = np.array([len(w) for w in words], np.int64)
        result = length.copy()
        live = np.flatnonzero(length > 1)
        sym = self.letters[np.frombuffer(b"".join(words[i] for i in live), np.uint8)]
        size = length[live]
        rank = np.full(len(sym), NEVER)
        last = np.cumsum(size) - 1
        inner = np.ones(len(sym), bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(sym[at], sym[at + 1])
        while len(live):
            best = np.minimum.reduceat(rank, np.cumsum(size) - size)
            done = best == NEVER
            if done.any():
                result[live[done]] = size[done]
                stays = np.repeat(~done, size)
                sym, rank = sym[stays], rank[stays]
                live, size, best = live[~done], size[~done], best[~done]
                if not len(live):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            fresh = np.r_[True, np.diff(hit) != 1]
            run = hit[fresh][np.cumsum(fresh) - 1]
            hit = hit[(hit - run) % 2 == 0]
            stays = np.ones(len(sym), bool)
            stays[hit + 1] = False
            sym[hit] = self.merged[rank[hit]]
            rank[hit] = NEVER
            last = np.cumsum(size) - 1
            ends = np.zeros(len(sym), bool)
            ends[last] = True
            ends[hit] |= ends[hit + 1]
            owner = np.searchsorted(last, hit)
            size = size - np.bincount(owner, minlength=len(size))
            sym, rank, ends = sym[stays], rank[stays], ends[stays]
            at = hit - np.arange(len(hit))
            at = np.unique(np.r_[at, at[at > 0] - 1])
            rank[at] = NEVER
            at = at[~ends[at]]
            rank[at] = self.rank(sym[at], sym[at + 1])
        return result

    def parts(self, text: str):
        """Lists of pre-tokens of a text, and the number of added tokens as an int."""
        if self.added is not None and self.added.search(text):
            rest = self.added.split(text)
            yield len(rest) - 1
        else:
            rest = [text]
        for piece in rest:
            if len(piece) <= LONG_TEXT:
                yield self.words.findall(piece)
            else:
                found = (m.group() for m in self.words.finditer(piece))
                while some := list(itertools.islice(found, 1 << 16)):
                    yield some

    def counter(self):
        """A function from a list of texts to their token counts that remembers short pre-tokens."""
        known = {}

        def settle(waiting, totals):
            fresh = list(set().union(*(words for _, words in waiting)).difference(known))
            raw = [w.encode() for w in fresh]
            start, ends = 0, np.cumsum([len(w) for w in raw])
            while start < len(raw):
                held = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, held + HELD_BYTES, "right")))
                known.update(zip(fresh[start:stop], self.symbols(raw[start:stop]).tolist()))
                start = stop
            for place, words in waiting:
                totals[place] += sum(map(known.__getitem__, words))
            for word in fresh:
                if len(word) > LONG_WORD:
                    del known[word]
            if len(known) > HELD_WORDS:
                known.clear()

        def count(texts):
            totals, waiting, held = [0] * len(texts), [], 0
            for place, text in enumerate(texts):
                for words in self.parts(text):
                    if isinstance(words, int):
                        totals[place] += words
                        continue
                    try:
                        totals[place] += sum(map(known.__getitem__, words))
                    except KeyError:
                        waiting.append((place, words))
                        held += len(words)
                        if held > HELD_WORDS:
                            settle(waiting, totals)
                            waiting, held = [], 0
            settle(waiting, totals)
            return totals
        return count


def _count(path):
    def run(batches):
        count = Merger(path or vocabulary()).counter()
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(count(texts), pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])
    return run


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens).

    Counts equal those of the tokenizers library for the byte-level file at ``path``: no begin or end tokens, no
    truncation, and the string of an added token inside a text is that one token. One scan without a shuffle; texts of
    any length are counted whole, a few words at a time. Null or empty text: 0 bytes and 0 tokens. Null ids stay null,
    repeated rows are counted each, an empty table gives an empty result, and other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_count(path), COUNTS).withColumn("over_limit", F.col("n_tokens") > limit)
