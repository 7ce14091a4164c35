"""Pipeline stages lose and overwrite nothing: clashing names, several texts under one id, maps, short and few labels."""
import random

import numpy as np

from settlegrid.llm import decontaminate, exact_dedup, near_dedup, packing, quality, toxicity

NAMES = ["_id", "_key", "_none", "_text", "_x", "_p", "_feature", "_raw", "_probability", "_predicted", "_score", "_gone", "_some",
         "_tag", "row", "digest", "id", "none", "set_key", "_fold", "_hash", "n_words", "items", "spans"]


def clashing(spark, rows):
    """Documents with a map and with text columns of every name that the stages use inside."""
    kinds = "doc_id long, text string, m map<string,int>, " + ", ".join(f"`{n}` string" for n in NAMES)
    return spark.createDataFrame([(*r, {"a": 1}, *[f"{r[0]} {n}" for n in NAMES]) for r in rows], kinds)


def untouched(docs, kept):
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert all(r["m"] == {"a": 1} and all(r[n] == f"{r['doc_id']} {n}" for n in NAMES) for r in rows)
    return sorted((r["doc_id"], r["text"]) for r in rows)


def test_exact_dedup_keeps_foreign_columns(spark):
    docs = clashing(spark, [(1, "a b"), (2, "a  b"), (3, "c"), (3, "c"), (3, "d")])
    assert untouched(docs, exact_dedup.exact_dedup(docs)) == [(1, "a b"), (3, "c"), (3, "d")]


def test_near_copies_go_by_id_and_text(spark):
    base = [f"w{i}" for i in range(60)]
    near, clean = " ".join(base[:58] + ["x"]), " ".join(f"z{i}" for i in range(40))
    docs = clashing(spark, [(1, " ".join(base)), (5, near), (5, clean), (5, ""), (7, near), (8, "short one"), (9, clean + " z")])
    assert untouched(docs, near_dedup.drop_near_copies(docs)) == [(1, " ".join(base)), (5, ""), (5, clean), (8, "short one")]


def test_clean_documents_in_several_blocks(spark):
    r = random.Random(1)
    items = [(i, " ".join(f"b{r.randint(0, 500)}" for _ in range(14))) for i in range(30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "a clean text"), (2, "so " + items[3][1] + " it is"), (3, None), (4, items[9][1] + " . " + items[20][1]), (4, "also clean"), (4, "also clean")]
    docs = clashing(spark, rows)
    assert len(decontaminate.item_blocks(bench, block_bytes=600)) > 1
    whole = decontaminate.contamination(docs.select("doc_id", "text"), bench).collect()
    parts = decontaminate.contamination(docs.select("doc_id", "text"), bench, block_bytes=600).collect()
    assert sorted(whole) == sorted(parts) and sum(r.contaminated for r in parts) == 2
    kept = decontaminate.clean_documents(docs.where("text IS NOT NULL"), bench)
    assert untouched(docs, kept) == [(1, "a clean text"), (4, "also clean"), (4, "also clean")]
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = decontaminate.scan_documents(docs.toDF(*names), bench, text_col="c1", keep=tuple(names), block_bytes=600)
    assert found.where("n_hit = 0").count() == 4 and found.where("n_hit > 0 AND size(items) = 2").count() == 1


def labelled(spark, toxic, clean, repeats=1):
    r = random.Random(2)
    text = lambda bad: " ".join(r.choices(["you", "idiot", "stupid", "trash"] if bad else ["the", "river", "was", "calm", "today"], k=30))
    rows = [(i, text(i < toxic)) for i in range(toxic + clean)]
    rows += [(rows[0][0], rows[0][1])] * (repeats - 1)
    labels = spark.createDataFrame([(i, int(i < toxic), int(i >= toxic)) for i in range(toxic + clean)], "doc_id long, toxic int, quality int")
    return clashing(spark, rows), labels


def test_five_toxic_labels_still_teach(spark):
    docs, labels = labelled(spark, 5, 60)
    kept = untouched(docs, toxicity.drop_toxic(docs, labels))
    assert {i for i, _ in kept} == set(range(5, 65))


def test_repeated_rows_of_one_id_vote_once(spark):
    docs, labels = labelled(spark, 12, 40, repeats=1000)
    once, _ = labelled(spark, 12, 40)
    assert len(quality.fit_quality(docs, labels).marks) == len(quality.fit_quality(once, labels).marks) <= 52
    score = lambda d: {(r.doc_id, round(r.score, 9)) for r in toxicity.toxicity(d, labels).collect()}
    assert score(docs) == score(once)


def test_packing_goes_on_to_the_bound():
    r = np.random.default_rng(0)
    for name, lengths, most in (("halves", np.r_[r.integers(300, 501, 2000), r.integers(683, 1101, 2000)], 1280),
                                ("short", r.integers(2, 13, 16_000), None), ("four", r.choice([5, 5, 1021, 1023], 16_000), None)):
        lengths = [int(n) for n in lengths]
        bins, made = packing.best_fit(lengths)
        home = packing.improve(lengths, bins)
        fill = np.bincount(home, lengths)
        assert fill.max() <= packing.LIMIT and fill.sum() == sum(lengths)
        used = int((fill > 0).sum())
        assert used <= made and used <= (most or used), name
        if name == "short":
            assert used == -(-sum(lengths) // packing.LIMIT)
