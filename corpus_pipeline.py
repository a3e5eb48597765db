"""A training-data pipeline over `documents`: language, quality, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last
return the columns of documents.  ``run`` writes every stage to the shared
folder and gives the next one what it reads back, so a lost executor costs no
more than the stage it worked on; what only a stage needed goes when it is written.

Rows may hold nulls in any column, repeat, or share a doc_id, texts may be empty
or very long, and tables empty or with more columns; the stages say what becomes
of them.
"""

from __future__ import annotations

from chronofold.llm import langid, minhash, packing, pii, quality
from chronofold.llm.common import save, saved, sweep, table


def language_id(spark, docs, sf_dir):
    """Documents whose language is rejected go.

    So do null, empty and letterless texts.  Repeated rows are judged alike, very
    long texts as a whole; an empty table, or one without any labelled row, gives
    no rows.
    """
    return langid.keep_identified(docs)


def quality_rules(spark, docs, sf_dir):
    """Documents that fail the current policy go.

    A null or empty text fails (too few words).  Repeated rows are judged alike,
    very long texts as a whole; an empty table gives no rows.
    """
    return quality.keep_good(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each near-duplicate group stays (five words, 0.8).

    It is that of the least doc_id, and of several texts of that id the one of
    the least hash.  Repeated rows stay once; every row without doc_id and every
    text without words stays; an empty table gives no rows.
    """
    return minhash.keep_one_of_each(docs, size=5, percent=80)


def personal_data(spark, docs, sf_dir):
    """Personal data in texts is replaced by its kind.

    Null texts stay null, empty ones empty, rows stay as many as they were; an
    empty table gives no rows.
    """
    return pii.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Every document's place in sequences of 4096 tokens, one row a piece.

    A null or empty text is the end mark alone, a long one several pieces;
    repeated rows are packed each; an empty table gives no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("pii", personal_data),
    ("packing", best_fit_packing),
]

#: Training, MinHash and packing are beyond SQL; the tests compare stages with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to documents, each written as Parquet and read again."""
    docs, before = table(spark, sf_dir, "documents"), saved()
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
        sweep(spark, before, docs)
    return docs
