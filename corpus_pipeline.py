"""The corpus pipeline: toxic documents go, then exact and near copies and benchmark passages; what stays is packed."""
from settlegrid.llm import decontaminate, exact_dedup, near_dedup, packing, toxicity
from settlegrid.llm.common import stored


def remove_toxic(spark, docs, sf_dir):
    """Documents that score 0.5 or more for toxicity go."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_copies(spark, docs, sf_dir):
    """Of equal texts, the row with the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def remove_near_copies(spark, docs, sf_dir):
    """Of each group of near copies, the smallest id stays."""
    return near_dedup.drop_near_copies(docs)


def remove_contaminated(spark, docs, sf_dir):
    """Documents that hold a passage of a benchmark item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark, docs, sf_dir):
    """Pieces of all documents left, placed in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", remove_toxic), ("exact dedup", remove_copies), ("near dedup", remove_near_copies),
          ("decontamination", remove_contaminated), ("packing", pack_sequences)]

#: Trees, shingle components and packing are not expressible in SQL; the stages are held against brute force in the tests.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
