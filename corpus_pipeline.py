"""A corpus pipeline of five stages over the ``documents`` table.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages
but the last return the columns of ``docs``; whole rows go or stay.

1. quality classifier    rows with a score under 0.5 go
2. quality rules         rows that the divergence rules reject go
3. n-gram Jaccard join   of each group of near copies (five words, 0.8) the row
                         with the least doc_id stays; rows without words stay
4. decontamination       rows that hold a benchmark passage go
5. best-fit packing      the rows that are left, packed into sequences
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrove.llm import byte_cnn, divergence_rules, jaccard_tree, packing, spaced_seeds
from pagegrove.llm.common import key_marks, shared_path, stage, table, where_marked


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored like one chunk of padding; without labelled rows every score is 0.5 and all rows stay.

    Repeated rows have equal scores; other columns are never read and no rows give none.
    """
    score = free_name(docs, "score")
    return byte_cnn.quality_scores(docs, table(spark, sf_dir, "labels"), out=score).where(F.col(score) >= 0.5).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows are read twice, for the references and for the verdicts, so no texts are written.

    The row's number keeps the optimizer from moving the verdict below the
    features, where it would be written out again for each use of a feature.
    """
    references = stage(divergence_rules.references(divergence_rules.rule_features(docs, keep=["doc_id"])), "rules")
    features = divergence_rules.rule_features(docs)
    fenced = features.withColumn("row", F.struct(F.col("row").alias("doc"), F.monotonically_increasing_id().alias("place")))
    return divergence_rules.judge(fenced, references).where("kept").select("row.doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by a number of their own, given in one scan and staged with the row's id and its text's MD5.

    The number depends on the scan's layout, so it is never computed again:
    rows are found by ``(doc_id, MD5)`` at the end.  Rows that agree in both
    are in one group; where they are the ones to stay, one of them does.
    Texts move only where a bitmap of the copies' MD5s lets a copy be, which
    leaves nearly all rows that have none where they are read.
    """
    key = free_name(docs, "key")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["id"]) & (a[key] == b["text_key"])
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("text_key"))
    rows = docs.select("doc_id", "text", spaced_seeds.text_key().alias("key"), F.monotonically_increasing_id().alias("own"))
    found = jaccard_tree.jaccard_components(rows, width=5, num=80, den=100, id_col="own", keep=["doc_id", "key"])
    groups = found.where("n_shingles > 0")
    least = groups.groupBy("component").agg(F.min(place).alias("first")).select("first.id", "first.text_key", F.lit(True).alias("first"))
    texts = groups.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("times"))
    known = texts.withColumnRenamed("key", key)
    judged = known.join(least, same(known, least), "left").select(F.col("doc_id").alias("id"), F.col(key).alias("text_key"), F.coalesce("first", F.lit(False)).alias("first"), "times")
    listed = stage(judged.where("not first or times > 1").select("id", "text_key", "first"), "copies")
    keyed = docs.withColumn(key, spaced_seeds.text_key())
    marks = stage(key_marks(listed.select("text_key")), "marks")
    apart, maybe = (where_marked(keyed, key, marks, marked) for marked in (False, True))
    repeated = stage(listed.where("first"), "repeats")  # a table of its own size, mostly empty, so that texts need not move for it
    again = maybe.join(repeated, same(maybe, repeated), "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*others)) if others else F.lit(0))
    once = again.groupBy("doc_id", key).agg(one.alias("row")).select("row.*")
    left = maybe.join(listed, same(maybe, listed), "left_anti")
    return apart.union(left).drop(key).union(once)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go by their texts: null and empty ones hold no passage and stay, equal ones go or stay together, ids do not matter."""
    key = free_name(docs, "key")
    bad = stage(spaced_seeds.contaminations(docs, table(spark, sf_dir, "benchmark")).select(F.col("key").alias(key)).distinct(), "leaks")
    return docs.withColumn(key, spaced_seeds.text_key()).join(bad, key, "left_anti").drop(key)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document has its words and an end token as length, so null and empty texts have 1; longer ones than a bin are cut into pieces.

    Null ids and repeated rows are packed like others; no rows give no bins.
    """
    return packing.pack(docs, length=packing.word_length())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The first stage is a trained network, which SQL cannot express; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage_of in STAGES:
        out = shared_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage_of(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
