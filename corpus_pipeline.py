"""From raw documents to token ids, in five stages that each apply one operator to all that the stage before kept.

Every stage works on any rows: null or repeated ids, null sources, null, empty and very long texts, more columns (also of equal
names, as long as doc_id, text, lang and source are there once), and an empty table, which gives an empty table. What
becomes of such rows stands at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relcast.llm import bpe, classifier, jaccard, mixing, secrets
from relcast.llm.common import WORD, beside, cut, table

#: Of the hashes that round a document's share (the mix has others), and parts of a source's documents of like size.
ROUNDING_SEED, ROUNDING_PARTS = 20240611, 64


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ordinal classifier, fitted on the labelled documents among ``docs``; what it rejects goes.

    Each row is judged by its text alone, so rows that repeat an id or a text all stay or all go; null and empty texts are
    judged like texts without words. Without labels (or without a labelled document) every row stays.
    """
    labels = table(spark, sf_dir, "labels")
    rated = labels.select(F.col("doc_id").alias("id"), classifier.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return classifier.select_documents(docs, classifier.fit_classifier(docs, rated))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that shingles of five words link at a similarity of 0.8 or more, the one of least id stays.

    Of equal rows (id and text) one stays; rows without an id, and null, empty and wordless texts, all stay.
    """
    return jaccard.keep_one(docs, jaccard.JaccardParams(shingle=5, over=80))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays, null texts as null."""
    return secrets.redact_secrets(docs)


def rounded(taken: DataFrame) -> DataFrame:
    """(row, times): t / s of each row of ``taken`` (row, a struct with a source; t, s), rounded down or up without bias.

    Over a source's documents by size, running sums of the rests of t / s are rounded from a start that is hashed, so a
    document has one copy more with the chance of its rest, and the words of a source stay near the sum of t. Sums are
    taken in parts: no source is summed in one task.
    """
    one, start = 1 << 32, F.col("start") + F.pmod(F.xxhash64(F.lit(ROUNDING_SEED), "skey"), F.lit(1 << 32))
    rest = F.floor(F.col("t") % F.col("s") / F.col("s") * one).cast("bigint")
    rows = taken.where("s > 0").withColumn("rest", rest).withColumn("skey", mixing.source_key(F.col("row.source"))).withColumn("h", F.xxhash64(F.lit(ROUNDING_SEED), "row"))
    rows = rows.withColumn("class", F.floor(F.log2("s") * 4)).withColumn("part", F.pmod("h", F.lit(ROUNDING_PARTS)))
    sums = rows.groupBy("skey", "class", "part").agg(F.sum("rest").alias("all"))
    starts = sums.select("skey", "class", "part", (F.sum("all").over(Window.partitionBy("skey").orderBy("class", "part")) - F.col("all")).alias("start"))
    order = Window.partitionBy("skey", "class", "part").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("upto", F.sum("rest").over(order)).join(starts, ["skey", "class", "part"]).withColumn("upto", start + F.col("upto"))
    more = F.shiftright("upto", 32) - F.shiftright(F.col("upto") - F.col("rest"), 32)
    return placed.select("row", (F.expr("t div s") + more).cast("int").alias("times")).where("times > 0")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes its words, rounded down or up so that a source's words meet its target.

    Rows without an id are told apart by their texts; rows that repeat an id in a source share what the mix takes of them
    and have as many copies each. Null sources are one source. Null, empty and wordless texts have no words, so the mix
    takes nothing of them and they go.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]  # by place, so that equal names do no harm
    source, doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("source", "doc_id", "text"))
    keyed = docs.toDF(*names).withColumn("row", F.struct(source.alias("source"), doc_id.alias("doc_id"), F.when(doc_id.isNull(), F.md5(F.encode(text, "utf-8"))).alias("digest")))
    sized = keyed.select("row", text.alias("text"), source.alias("source"))
    taken = cut(mixing.mix_documents(sized, id_col="row").groupBy("row").agg(F.sum("taken").alias("t"), F.sum("size").alias("s")))
    found = beside(keyed, cut(rounded(taken)), "row")
    copies = found.where(F.coalesce(text.rlike(WORD), F.lit(False))).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return copies.select(*names).toDF(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to; a row for each row, null texts have no tokens."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"), ids=True)


STAGES = [
    ("quality classifier", select_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("secret scans", redact),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]
#: A trained model and hashed draws have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between two stages the rows are written to the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = cut(docs)
    return docs
