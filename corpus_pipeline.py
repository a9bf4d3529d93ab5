"""From raw documents to token shards: five stages, each written before the next reads it.

quality rules -> near duplicates -> benchmark decontamination -> source mix -> token shards.
A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. The first three keep or drop documents, the fourth keeps them all and puts them in the
order of the mix, and the last writes shards and returns what it reads back from them.

Defined results of every stage but the last: an empty table stays empty; a null text is empty and fails
the quality rules; rows are kept or dropped one by one and never changed, further columns (of any name)
included. Rows that repeat an id or a whole row are judged one by one by stages 1 and 3; of each group of
near duplicates (equal rows are one) stage 2 keeps exactly one row, the smallest id first, then by all
other columns; stage 4 puts rows that tie in its hash in the order of all columns. Texts of any length
are read whole; one text must fit in a task's memory. The last stage writes the documents in the order of
the mix, which is that of the rows in the files of the stage before it (file by name, row by row), and
returns doc_id, start, n_tokens, ids_crc32, position, mix_start: ``position`` documents and ``mix_start`` ids
are before a document in the shards; ``start`` counts the ids before it by ascending doc_id, equal ids in the
order of the mix.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import decontaminate, jaccard, mixing, quality, sst
from citeloom.llm.common import shared_folder, stored, table
from citeloom.llm.queries import byte_encoder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    manifest = sst.write_shards(docs, shared_folder(spark, "sst"), byte_encoder, order=sst.order_of_rows(docs))
    return sst.by_ids(sst.read_shards(manifest))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_shards", token_shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Byte-level encoding, group links and the schedule can't be said in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None
