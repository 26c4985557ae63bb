"""A training corpus from `documents`: each stage gets what the one before it kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.bagminhash import near_duplicates
from rillflow.llm.line_runs import dedup_lines
from rillflow.llm.packing import pack_documents
from rillflow.llm.queries import table, tokenizer_file
from rillflow.llm.storage import written
from rillflow.llm.tiling import decontaminate
from rillflow.llm.toxicity import drop_toxic, train, training_rows


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labelled rows that aren't held out.

    A null text counts as empty; rows without an id and repeated ones are judged like all others.
    """
    return drop_toxic(docs, train(training_rows(docs, table(spark, sf_dir, "labels"))))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least 10 documents go from all of them; the documents stay.

    A row is a document, also one without an id, an empty or a repeated one;
    a null text becomes an empty one. Other columns stay, whatever their names.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *others).alias("row"))
    cleaned = dedup_lines(packed, min_docs=10, carry=("row",))
    made = {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cleaned.select(*(made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays.

    Of several rows with that id the one with the smallest text stays; rows
    without an id all stay. Documents without words are no copies of each other.
    """
    copies = near_duplicates(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("copy"))
    kept = docs.join(copies, docs["doc_id"] == copies["copy"], "left_anti")
    repeated = written(docs.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("id"), "repeated", narrow=True)
    if not repeated.limit(1).count():
        return kept
    once = kept.join(repeated, kept["doc_id"] == repeated["id"], "left_anti")
    several = kept.join(repeated, kept["doc_id"] == repeated["id"], "left_semi")
    first = several.select(F.struct(*several.columns).alias("row")).groupBy(F.col("row.doc_id").alias("id")).agg(F.min_by("row", F.struct("row.text", F.xxhash64("row"))).alias("row"))
    return once.union(first.select(*(F.col("row").getField(c).alias(c) for c in docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; rows without an id stay, as no match can name them."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens; a null text is the end id alone."""
    pieces = pack_documents(docs, tokenizer_file(), length=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic_documents),
    ("line_dedup", drop_common_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: SQL can't express the classifier, the signatures and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`; stages meet in tables of the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
