"""A training corpus from raw documents: five stages, each on all that the one before kept.

Toxic documents go, one document of each group of near-duplicates stays, passages
that stand elsewhere before are cut out, sources are mixed to target
weights, and the mix is tokenised and packed into sequences: each piece with its token ids and place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runloom.llm import mixing, packing, simhash, suffix_dedup, toxicity
from runloom.llm.common import table, written
from runloom.llm.queries import vocabulary


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model of ``labels`` doesn't reject, columns of any name as they are.

    Null and empty texts stay, long ones are scored whole, repeats and ties get one verdict, an empty table stays empty.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first by doc_id.

    A null text is an empty one, and of those one stays; rows without doc_id are compared with each other alone; of whole
    repeats one stays; texts are read whole; an empty table stays empty; columns of any name stay as they are.
    """
    return simhash.one_of_each(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the 100-byte strings that start earlier; n_chars follows the text.

    Null texts stay null, a text may become empty, rows without doc_id come last, a row's own repeats take nothing
    from it; an empty table stays empty; other columns stay as they are.
    """
    return suffix_dedup.without_repeats(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks, not at all to twice.

    A null source is one of its own, texts without words weigh nothing, rows of one doc_id share a draw and those without
    one draw by their text; an empty table stays empty; columns of any name stay as they are.
    """
    return mixing.emit(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids and places in sequences of 4096.

    A null or empty text is the end id alone; only longer ones are cut; each row is packed, repeats too; equal lengths are
    placed by doc_id; an empty table gives no rows; other columns aren't read.
    """
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_near_duplicates),
    ("suffix_array_dedup", without_repeated_passages),
    ("source_mixing", mixed),
    ("best_fit_packing", packed),
]

#: SQL can express neither the fitted model nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
