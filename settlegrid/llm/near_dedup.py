"""Near duplicates by bottom-k sketches of one hash: inverted lists, union-sketch estimates, exact Jaccard."""
import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from .common import connected_components, partitions, slices, stored

WORDS = 5
SKETCH = 128
LISTED = 32
SHARE = 75
HUBS = 3
ORDERS = 3
LIST_BLOCK = 1_024
SIGMAS = 6
SETS = "doc_id long, n_shingles long, set_key binary, listed array<long>, sketch binary"
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; with fewer words the whole sequence is one shingle."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh3_64_intdigest(w) for w in parts], np.uint64)
    width = min(words, len(h))
    mixed = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        mixed = mixed * PRIME + h[i:len(h) - width + 1 + i]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def spare_values(size: int, exact: bool, share: float = SHARE / 100, risk: float = 1e-8) -> int:
    """How many of ``size`` listed values a document may leave unlisted and still meet every partner of the wanted
    similarity in a list: all but one of those that must be shared if the whole set is listed, else as many as sketches of
    one hash share with probability 1 - ``risk``."""
    if exact:
        return max(0, math.ceil(share * size) - 1)
    total, term = 0.0, (1 - share) ** size
    for k in range(size + 1):
        total += term
        if total > risk:
            return max(0, k - 1)
        term *= (size - k) / (k + 1) * share / (1 - share)
    return 0


def _sets(words, sketch):
    def run(batches):
        for batch in slices(batches):
            n, keys, listed, sketches = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, words)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                listed.append(s[:LISTED].view(np.int64))
                sketches.append(s[:sketch].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(listed, pa.list_(pa.int64())),
                 pa.array(sketches, pa.binary())], ["doc_id", "n_shingles", "set_key", "listed", "sketch"])
    return run


def shingle_table(docs: DataFrame, words: int = WORDS, sketch: int = SKETCH, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row its set size, a digest of the whole set and the ``sketch`` smallest shingle hashes."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_sets(words, sketch), SETS)


def inverted_lists(classes: DataFrame, share: int = SHARE) -> DataFrame:
    """(v, rep, n, weight): the listed values of each class that others have too, less those that it can spare.

    Values are ordered by how many classes list them. A class leaves out its most frequent ones (:func:`spare_values`), so
    a passage that many texts share makes no list unless it is a large part of a text. All others are kept: the last one
    in the order that two sets share is then a list of both, as soon as they share more listed values than either leaves
    out. Similar sets always do if one of them has at most ``LISTED`` shingles, larger ones with a probability of
    1 - 1e-8. ``weight`` adds up the counts: it is largest for the text that most others were made from.
    """
    exact = LISTED * share // 100
    spare = F.element_at(F.array(*[F.lit(spare_values(k, k <= exact, share / 100)) for k in range(1, LISTED + 1)]),
                         F.least(F.col("n"), F.lit(LISTED)).cast("int"))
    index = stored(classes.select("rep", "n", F.explode("listed").alias("v")))
    counts = index.groupBy("v").agg(F.count("*").alias("df")).where("df > 1")
    own = Window.partitionBy("rep")  # at most LISTED rows a class
    common = index.join(counts, "v").withColumn("rank", F.row_number().over(own.orderBy(F.col("df").desc(), "v")))
    common = common.where(F.col("rank") > spare).withColumn("weight", F.sum("df").over(own))
    return stored(common.select("v", "rep", "n", "weight"))


def hub_pairs(lists: DataFrame, share: int = SHARE, orders: int = ORDERS, hubs: int = HUBS) -> DataFrame:
    """(a, b): each class with the ``hubs`` classes it meets most often as hub of a list.

    The hubs of a list are its class of largest weight and its first ones in ``orders`` hash orders of all classes; they
    are found by aggregation, and a list yields a few rows per member. Lists of thousands of copies are joined by their hubs.
    """
    def head(order):
        return F.min(F.struct(order, F.col("rep").alias("hub"), F.col("n").alias("hub_n")))
    heads = lists.groupBy("v").agg(head(-F.col("weight")).alias("h"), *[head(F.xxhash64("rep", F.lit(o))).alias(f"h{o}") for o in range(orders)])
    each = [F.struct(F.col(f"{h}.hub").alias("hub"), F.col(f"{h}.hub_n").alias("hub_n")) for h in ["h"] + [f"h{o}" for o in range(orders)]]
    met = lists.join(heads.select("v", F.array_distinct(F.array(*each)).alias("heads")), "v").select("rep", "n", F.explode("heads").alias("h"))
    alike = (F.least("n", "h.hub_n") * 100 >= F.greatest("n", "h.hub_n") * share) & (F.col("h.hub") != F.col("rep"))
    met = met.where(alike).groupBy("rep", F.col("h.hub").alias("hub")).agg(F.count("*").alias("shared"))
    order = Window.partitionBy("rep").orderBy(F.col("shared").desc(), "hub")
    best = met.withColumn("k", F.row_number().over(order)).where((F.col("k") <= hubs) & (F.col("shared") > 1))
    return best.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()


def _verify(words, share):
    def run(batches):
        last, held = None, None
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                if x != last:
                    last, held = x, shingle_set(x, words)
                other = shingle_set(y, words)
                both = len(np.intersect1d(held, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= share * (len(held) + len(other) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def verified(pairs: DataFrame, texts: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity. ``texts`` is one text per class (rep, text)."""
    named = pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "rep")
    texts = stored(texts.join(named, "rep"))
    left = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"))
    return stored(pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify(words, share), "a long, b long"))


def _likeness(u, size, n, top, ids, bounds, mark, grid, sketches, sketch, share):
    """Union-sketch estimates of member ``u`` against all members of a group, and the least ones that do not rule out the
    similarity: ``SIGMAS`` deviations of a sample without return below it, none where both sketches hold the whole sets."""
    mine = ids[bounds[u]:bounds[u] + size[u]]
    mark[mine] = 1
    shared = np.add.reduceat(mark[ids], bounds)
    mark[mine] = 0
    union = np.searchsorted(sketches[u], top, "right") + np.minimum((grid <= top[u]).sum(1), size) - shared
    all_ = np.maximum((n[u] + n) / (1 + share / 100), union)
    spread = share / 100 * (1 - share / 100) / union * np.maximum(all_ - union, 0) / np.maximum(all_ - 1, 1)
    whole = (n <= sketch) & (n[u] <= sketch)
    return shared / union, share / 100 - np.where(whole, 1e-9, SIGMAS * np.sqrt(spread))


def _group_pairs(group, share, sketch, best):
    """Pairs of one block of a list, or of two blocks, in different components. ``best``: only each member's best one."""
    rep, n, comp, part = (group[c] for c in ("rep", "n", "component", "part"))
    kinds, of, held = np.unique(comp, return_inverse=True, return_counts=True)
    if len(kinds) == 1:
        return
    sketches = [np.frombuffer(s, np.uint64) for s in group["sketch"]]
    size = np.array([len(s) for s in sketches])
    bounds = np.cumsum(size) - size
    flat = np.concatenate(sketches)
    values, ids = np.unique(flat, return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    top = np.where(n > sketch, flat[bounds + size - 1], np.uint64(2 ** 64 - 1))
    grid = np.full((len(rep), size.max()), np.uint64(2 ** 64 - 1))
    grid[np.arange(size.max()) < size[:, None]] = flat
    done = np.zeros(len(rep), bool)
    for u in np.flatnonzero(of != held.argmax()):
        done[u] = True
        near = (of != of[u]) & (np.minimum(n, n[u]) * 100 >= np.maximum(n, n[u]) * share)
        if not best:
            near &= ~done
        if group["i"] != group["j"]:
            near &= part != part[u]
        if not near.any():
            continue
        like, least = _likeness(u, size, n, top, ids, bounds, mark, grid, sketches, sketch, share)
        near &= like >= least
        if not near.any():
            continue
        if best:
            w = int(np.where(near, like, -1).argmax())
            yield int(rep[u]), int(rep[w]), float(like[w])
        else:
            own = set(group["own"][u])
            for w in np.flatnonzero(near):
                if min(own.intersection(group["own"][w])) == group["v"]:
                    yield int(rep[u]), int(rep[w]), float(like[w])


def _compare(share, sketch, best):
    """Task over rows in the order of their groups; a group is a block of a list, so what it holds is bounded."""
    def flush(table):
        v, i, j = (table.column(c).to_numpy() for c in ("v", "i", "j"))
        starts = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])
        cols = {c: table.column(c).to_numpy() for c in ("rep", "n", "component", "part")}
        cols |= {c: table.column(c).to_pylist() for c in ("own", "sketch")}
        out = []
        for a, b in zip(starts, np.r_[starts[1:], len(v)]):
            out.extend(_group_pairs({c: x[a:b] for c, x in cols.items()} | {"v": v[a], "i": i[a], "j": j[a]}, share, sketch, best))
        a, b, like = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(like, pa.float64())], ["a", "b", "like"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            v, i, j = (table.column(c).to_numpy() for c in ("v", "i", "j"))
            last = np.flatnonzero((v != v[-1]) | (i != i[-1]) | (j != j[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut)
        if held is not None:
            yield flush(held)
    return run


def cross_pairs(lists: DataFrame, classes: DataFrame, parts: DataFrame, best: bool, share: int = SHARE, sketch: int = SKETCH,
                block: int = LIST_BLOCK) -> DataFrame:
    """(a, b): pairs in one list that are not in one component yet and may be similar.

    Lists whose classes are all joined up are left out. The others are compared in blocks of about ``block`` classes,
    each block with each, so a list of any length is done in full by tasks of bounded size; only members outside a
    group's largest component are held against the rest. With ``best``, each class comes with its best partner only, as
    most components are joined by these; else with all, each pair from the smallest value that both list.
    """
    spark = lists.sparkSession
    known = lists.join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
    known = known.withColumn("component", F.coalesce("component", "rep"))
    state = known.groupBy("v").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    open_ = stored(known.join(state.where("lo <> hi"), "v").select("v", "rep", "n", "component", F.ceil(F.col("members") / block).cast("int").alias("blocks")))
    own = open_.groupBy("rep").agg(F.collect_set("v").alias("own"))  # at most LISTED values
    rows = open_.join(own, "rep").join(classes.select("rep", "sketch"), "rep")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least("part", o).alias("i"), F.greatest("part", o).alias("j"))))
    rows = rows.withColumn("p", pair).select("v", "p.i", "p.j", "rep", "n", "component", "part", "own", "sketch")
    rows = rows.repartition(partitions(spark, open_.count(), 20_000), "v", "i", "j").sortWithinPartitions("v", "i", "j")
    found = rows.mapInArrow(_compare(share, sketch, best), "a long, b long, like double")
    if best:
        order = Window.partitionBy("a").orderBy(F.col("like").desc(), "b")
        found = stored(found).withColumn("k", F.row_number().over(order)).where("k = 1")
    return stored(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def near_components(docs: DataFrame, words: int = WORDS, share: int = SHARE, id_col="doc_id", text_col="text",
                    with_key: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Rows with equal shingle sets are one class from the start, however many. Classes are linked step by step: each with its
    best hubs, each with its best partner in another component, and at last all pairs of the inverted lists that are still in
    different components. Every link is confirmed on the full sets of whole texts. Two similar texts share a list always if
    one has at most ``LISTED`` shingles, else with a probability of 1 - 1e-8; sketches then rule out pairs ``SIGMAS``
    deviations below the similarity. Null and empty texts have no shingles and are linked with nothing, rows without an id neither: they are their own component
    (null id: null) and kept. Repeated rows share a component. Empty input gives an empty result. ``with_key`` adds set_key,
    the digest of the row's set.
    """
    table = stored(shingle_table(docs, words, id_col=id_col, text_col=text_col))
    full = table.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("set_key").agg(F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n"), F.first("listed").alias("listed"),
                                          F.first("sketch").alias("sketch"))
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()))
    lists = inverted_lists(classes, share=share)

    listed = stored(classes.select("rep", "least_id", "set_key", "sketch").join(lists.select("rep").distinct(), "rep"))
    texts = stored(class_texts(docs, listed, words, id_col, text_col))
    links = verified(stored(hub_pairs(lists, share)), texts, words, share)
    for best in (True, False):
        parts = connected_components(links)
        links = stored(links.unionByName(verified(cross_pairs(lists, listed, parts, best, share), texts, words, share)))
    parts = connected_components(links)
    placed = classes.select("set_key", "least_id", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    placed = placed.withColumn("component", F.coalesce("component", "rep"))
    smallest = placed.groupBy("component").agg(F.min("least_id").alias("component_id"))
    answer = stored(placed.join(smallest, "component").select("set_key", "component_id"))
    out = table.select("doc_id", "n_shingles", "set_key").join(answer, "set_key", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), *["set_key"] * with_key)


def class_texts(docs: DataFrame, classes: DataFrame, words: int = WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """(rep, text): one text for each class, found by the class's smallest id and its set."""
    named = classes.select("rep", F.col("least_id").alias("id"), F.col("set_key").alias("want"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    # repeated rows meet in the join's own partitions
    found = rows.join(named, "id").select("id", "rep", "want", "text").distinct()
    return found.mapInArrow(_same_set(words), "rep long, text string")


def _same_set(words):
    """Task: leaves out texts that merely stand under the same id."""
    def run(batches):
        for batch in slices(batches):
            keys = [hashlib.blake2b(shingle_set(t, words).tobytes(), digest_size=16).digest() for t in batch.column("text").to_pylist()]
            same = [k == w for k, w in zip(keys, batch.column("want").to_pylist())]
            yield batch.select(["rep", "text"]).filter(pa.array(same, pa.bool_()))
    return run


def _keys(words):
    """Task: the digest of the set of each text in the first column; the rest is handed on."""
    def run(batches):
        for batch in slices(batches):
            keys = [hashlib.blake2b(shingle_set(t, words).tobytes(), digest_size=16).digest() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(keys, pa.binary())], [*batch.schema.names[1:], "set_key"])
    return run


def drop_near_copies(docs: DataFrame, words: int = WORDS, share: int = SHARE, text_col="text", id_col="doc_id") -> DataFrame:
    """The rows of ``docs`` that are the smallest id of their component, with their columns.

    An id whose rows are all lost goes by an anti-join on the id. Where an id stands over several texts of which only
    some are lost, its rows are told apart by their sets, so the other texts stay.
    """
    found = near_components(docs, words, share, id_col, text_col, True)
    lost = stored(found.where("NOT kept").select("doc_id", "set_key").distinct())
    stays = found.where("kept").join(lost.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id").distinct()
    mixed = stored(stays)
    given = docs[id_col].cast("long")
    ids = lost.select(F.col("doc_id").alias("_gone")).distinct()
    others = docs.join(ids, given == ids["_gone"], "left_anti")
    some = mixed.select(F.col("doc_id").alias("_some"))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    held = docs.join(some, given == some["_some"], "left_semi").select(F.col(text_col).alias("text"), whole, F.col(id_col).cast("long").alias("doc_id"))
    kinds = f"row {held.schema['row'].dataType.simpleString()}, doc_id long, set_key binary"
    told = held.mapInArrow(_keys(words), kinds).join(lost, ["doc_id", "set_key"], "left_anti").select("row.*")
    return others.unionByName(told)
