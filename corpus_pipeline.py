"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and gives documents for the next one.

Each stage works on all that the one before has kept, which is written to the shared folder and read again. Nulls and the like:
a null text is judged as an empty one and goes on as null, with copies that count no words; a null doc_id is no copy of anything and nothing of
it is cut as a repeat; rows that repeat a doc_id and text share their fate; ties go to the smaller doc_id; extra columns of any name
come out as they went in, but `copy`, which the mix sets; an empty table gives an empty one (see `hopweave.llm.stages`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hopweave.llm import stages
from hopweave.llm.tables import kept, table

STAGES = [
    ("quality classifier", stages.good_quality),
    ("minhash near-dedup", stages.one_of_each_group),
    ("substring dedup", stages.without_repeats),
    ("benchmark decontamination", stages.without_benchmark),
    ("mixing sources", stages.mixed),
]

#: Classifiers and MinHash are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs, _ = kept(docs, name.replace(" ", "-"))
    return docs
