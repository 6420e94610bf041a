"""A training corpus in five stages, each of one operator of ``sparkloom.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which the caller writes
and reads again as the next stage's docs; ``run`` writes them to the shared folder.  Each
stage works on all rows it gets, is fitted or searched on its own input, and all but the
last return the columns of ``documents``.

In every stage: a null text counts as an empty one and stays null; an empty table stays
empty; texts are judged whole, however long; further columns are kept as they are, whatever
their names.  What else each stage defines stands in its docstring.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import arrowmap, decontaminate, nearcopies, pieces, quality, queries, secretscan
from sparkloom.plans.shared import written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Repeated rows get equal scores, so all stay or all go; rows with a null id are judged as well.  Without
    enough labels of both kinds every document has the same score, that of the labels' share.
    """
    model = quality.fit(docs, queries.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-duplicate class the document with the smallest id stays.

    Rows with equal ids are one document, and stay or go together; rows with a null id, and texts without a
    word, are copies of none; of a class of equals (a tie) the smallest id stays too.
    """
    found = nearcopies.classes(docs)
    name = arrowmap.fresh(docs, "__gone")
    gone = written(found.where(~F.col("is_kept")).select(F.col("doc_id").alias(name)).distinct(), "copies")
    few = gone.count() <= nearcopies.MAX_BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, F.col("doc_id") == F.col(name), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Rows with equal ids are one document, and go together if one holds an item; rows with a null id stay;
    an empty benchmark leaves all.
    """
    return decontaminate.clean(docs, queries.table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are overwritten, character by character.

    Every row is masked by itself, so repeated rows and null ids make no difference; lengths stay, and so does n_chars.
    """
    return secretscan.redact(docs)


def add_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' SentencePiece ids beside them, as ``token_ids``; a null or empty text has none.

    A column of that name is replaced.
    """
    return pieces.with_ids(docs, pieces.read_model(queries.PIECE_MODEL))


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", mask_secrets),
    ("SentencePiece encoding", add_tokens),
]

#: The classifier, signatures and tokens can't be written in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage{k}")
    return docs
