"""The corpus pipeline: each stage's result is written and reread as the next one's documents."""
import uuid

from ledgermill.llm import decontam, langid, mixing, pii, simhash
from ledgermill.llm.common import shared_folder, table

STAGES = [
    ("language", lambda spark, docs, sf_dir: langid.keep_identified(docs)),
    ("near_dedup", lambda spark, docs, sf_dir: simhash.deduplicate(docs)),
    ("decontaminate", lambda spark, docs, sf_dir: decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))),
    ("pii", lambda spark, docs, sf_dir: pii.redact(docs)),
    ("mix", lambda spark, docs, sf_dir: mixing.mixed(docs)),
]
# The language model and the field are fitted, which SQL cannot express; tests/llm/test_pipeline.py has a plain version.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    for name, stage in STAGES:
        path = f"{root}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
