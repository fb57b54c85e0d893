"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes every result as
Parquet and reads it again as the next stage's documents.  All but the last return the columns of
``docs``.

1. language ID drops texts without a letter, and documents whose language a learned network can't tell: its score of the
   likeliest language, the mean over all bytes of the text, is a half at most (``language_gru.least_score``), so
   texts in several languages, none of them in the majority, go too;
2. exact dedup keeps the fullest copy of each text;
3. near dedup keeps one document of each group of near copies;
4. mixing brings the sources to their target weights: a document appears once for every whole time
   it is taken, and once more if at least half of it is taken in the last, partial epoch;
5. packing cuts token ids into sequences.

Rows that repeat an id: stages 1 to 3 judge the id or the text, and stage 2 keeps one row of equal
text and id, so other texts of that id stay.  Rows without an id are judged by their text and stay
where it is their own.  Empty tables pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from valuegrain.llm import exact_dedup, language_gru, mixing, near_dedup, packing
from valuegrain.llm.common import shared_dir, shrink_heaps, written


#: Rows (an id and a number, or an id with a digest) that are broadcast at most, about 16 MB; beyond, joins shuffle.
MAX_BROADCAST_IDS, MAX_BROADCAST_DIGESTS = 1_000_000, 150_000


def _sized(df: DataFrame, most: int) -> DataFrame:
    """``df``, a written table, to be broadcast where it has at most ``most`` rows: then no text is moved."""
    return F.broadcast(df) if df.count() <= most else df


def _free(name: str, docs: DataFrame) -> str:
    """A column name that ``docs`` has not."""
    while name in docs.columns:
        name += "_"
    return name


def tell_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    net = language_gru.train(docs)
    docs = docs.filter(F.col("text").rlike(r"\p{L}"))
    if not net.langs:  # nothing to learn from: no language is told, and none is a reason to drop a text
        return docs
    told = language_gru.predict(docs, net, docs.columns).filter((F.col("lang_pred") != language_gru.UNDETERMINED) & (F.col("score") > language_gru.least_score(net)))
    return told.select(*(F.col(f"carried_{i}").alias(c) for i, c in enumerate(docs.columns)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, times = _free("id_text", docs), _free("times", docs)
    named = lambda digest: F.concat_ws(":", "doc_id", digest)  # noqa: E731  the digest alone where there is no id
    told = exact_dedup.exact_dedup(docs).select(named("text_sha256").alias(own), "kept")
    # what is not simply kept: copies (0 times), and texts that stay but repeat with their id
    judged = told.groupBy(own).agg(F.when(F.max("kept"), F.count("*")).otherwise(0).alias(times)).filter(F.col(times) != 1)
    judged = written(judged)
    rows = docs.withColumn(own, named(exact_dedup.sha256(exact_dedup.normalised(F.col("text")))))
    joined = rows.join(_sized(judged, MAX_BROADCAST_DIGESTS), own, "left")
    out = joined.filter(F.col(times).isNull())
    if not judged.filter(F.col(times) > 1).isEmpty():
        out = out.unionByName(joined.filter(F.col(times) > 1).dropDuplicates([own]))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    copy = _free("copy", docs)
    gone = written(near_dedup.near_duplicates(docs).filter("NOT kept").select(F.col("doc_id").alias(copy)).distinct())
    return docs.join(_sized(gone, MAX_BROADCAST_IDS), docs["doc_id"] == F.col(copy), "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(mixing.sized_documents(docs))
    own, epoch = _free("times", docs), _free("epoch", docs)
    times = F.when(F.col("size") > 0, F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))).otherwise(0).cast("int")
    taken = written(mixed.select("doc_id", "source", "size", times.alias(own)))
    often = taken.filter(F.col("doc_id").isNotNull() & (F.col(own) > 0)).select("doc_id", own).dropDuplicates(["doc_id"])
    joined = docs.join(_sized(written(often), MAX_BROADCAST_IDS), "doc_id").select(*docs.columns, own)
    # rows without an id: those of one source and size are alike to the mix, so they are matched by number
    size, at = _free("words", docs), _free("at", docs)
    number = lambda df: df.withColumn(at, F.row_number().over(W.partitionBy("source", size).orderBy(F.lit(0))))
    nameless = number(docs.filter(F.col("doc_id").isNull()).withColumn(size, mixing.n_words(F.col("text")))).alias("d")
    told = number(taken.filter(F.col("doc_id").isNull()).select("source", F.col("size").alias(size), own)).alias("t")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("source", size, at)]
    nameless = nameless.join(told, same).filter(F.col(own) > 0).select("d.*", own).select(*docs.columns, own)
    return joined.unionByName(nameless).select(*docs.columns, F.explode(F.sequence(F.lit(1), own)).alias(epoch)).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shrink_heaps(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", tell_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: Network and forest stages have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/{name}"
        stage(spark, out, sf_dir).write.parquet(path)
        out = spark.read.parquet(path)
    return out
