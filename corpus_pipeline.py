"""A training corpus from raw documents, stage by stage.

Toxic documents go; lines and passages that repeat across documents stay in one
of them; one document of each group of near duplicates stays; documents that
hold a passage of the benchmark go; what is left is packed into sequences.

Line dedup comes before near duplicates are looked for, so a document that is a
copy as a whole keeps the lines that make it one: the next stage judges it whole
and not by what is left of it.  A document of which line dedup leaves no word
goes there.

Defined results: a null text, and one without a word, passes every stage and is
packed as a piece of no tokens; a row without an id takes part in no line dedup
and is a near duplicate like others; rows that share an id are one document to
line dedup and rows of their own to all other stages, but texts of one id that
are copies become one; extra columns are carried, whatever their names, up to
packing, which returns its own; empty tables give empty tables, an empty
benchmark or labels table drops nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pagelattice.llm import decontaminate, toxicity
from pagelattice.llm.jaccard_join import keep_one
from pagelattice.llm.line_dedup import drop_repeats
from pagelattice.llm.packing import pack_documents
from pagelattice.session import delete_folder, read_table, shared_folder

#: Near duplicates share 80 of 100 shingles of five words.
WORDS, SHARE, PER = 5, 80, 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_repeats(docs, counted=False, emptied=False, copies=SHARE / PER)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs, WORDS, SHARE, PER)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: A trained classifier decides first, so SQL can't express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each is written to the shared folder and read again, and its input deleted there."""
    own = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        at = f"{own}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            delete_folder(spark, before)
        before = at
    return docs
