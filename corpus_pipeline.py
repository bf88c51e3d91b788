"""A corpus pipeline: toxic documents go, near duplicates fold, repeated passages and benchmark leaks go, text is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet and reads it back
as the docs of the next. All stages but the last return the columns of documents (doc_id, text, lang, source, n_chars)
and whatever other columns docs has; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import discard, held_out, materialize, table
from quillspark.llm.decontaminate import leaks
from quillspark.llm.minhash import BROADCAST_IDS, near_duplicates
from quillspark.llm.pieces import encode
from quillspark.llm.suffix import without_repeats
from quillspark.llm.toxicity import fit, reject


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the given doc_ids: a broadcast while they are few enough, else a shuffled anti join."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (7) doesn't call toxic; it learns from the labels that may be learned from.

    Null and empty texts have no toxic passage and stay, as do rows with a null or repeated doc_id whose text is clean.
    """
    return reject(docs, fit(docs, table(spark, sf_dir, "labels").where(~held_out())))


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (that of the smallest doc_id) of each group of near duplicates (3).

    Null and blank texts are no duplicates of each other and stay, and so do rows with a null doc_id. Rows go by their
    doc_id, so repeated rows stay or go together.
    """
    gone = materialize(near_duplicates(docs).where("not kept").select("doc_id"), "copies")
    return without(docs, gone)


def suffix_array(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 100-byte strings that start earlier (4); a character cut in two goes as a whole.

    Null texts stay null, and empty ones and those under 100 bytes stay as they are. Rows with equal or null doc_ids are
    texts of their own; n_chars is counted anew.
    """
    return without_repeats(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within its edit budget (1).

    Null and empty texts hold none. Rows go by their doc_id; one with a null doc_id can't be named, and stays.
    """
    hits = materialize(leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return without(docs, hits)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each text and the scores of its best segmentations (6); null counts as empty, rows are kept one by one."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("minhash", minhash), ("suffix_array", suffix_array), ("decontaminate", decontaminate), ("sentencepiece", sentencepiece)]

#: No SQL expresses a trained classifier or a search over piece lattices; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = before = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # what the stage read; the tables of the user stay
    return STAGES[-1][1](spark, docs, sf_dir)
