"""Mixing sources to target weights, by Pareto order sampling.

A source's share of the total fixes how many tokens are used of it. How often a document is used on
average goes with its size (or another weight), up to the cap. The whole part is certain copies; the
rest is drawn with these unequal probabilities: documents are ranked by the odds of a random number
over the odds of their inclusion, and the least are taken until the sample has its fixed size in
tokens. The rank to stop at is found from a histogram, so that no source is sorted in one task.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from frameledger.operators.common import cut

#: Fixed value: the pattern that splits text before the merges of byte-level rank files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_BINS = 2048


def token_counts(spark: SparkSession, documents: DataFrame, columns: list[Column], vocabulary: str = VOCABULARY) -> DataFrame:
    """`columns` and n_tokens of each text, in tokens of a byte-level rank file; null and empty texts have 0. The file (under 2 MB) is read on the driver."""
    sent = spark.sparkContext.broadcast(Path(vocabulary).read_bytes())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, sent.value.splitlines())}
        coder = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            n = [len(coder.encode_ordinary(x)) if x else 0 for x in b.column("text").to_pylist()]
            keep = [i for i, c in enumerate(b.schema.names) if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(n, pa.int64())], names=[*(b.schema.names[i] for i in keep), "n_tokens"])

    d = documents.select(*columns, "text")
    kinds = ", ".join(f"{n} {t}" for n, t in d.dtypes if n != "text")
    return d.mapInArrow(run, f"{kinds}, n_tokens bigint")


def _plan(sizes: DataFrame, targets: DataFrame, total_tokens: int | None) -> DataFrame:
    """source, level, mean (uses expected of a document of that weight): one row per source with documents and a target, and weight.

    With uses min(cap, c * weight) the greatest weights reach the cap first; c is the one for which
    the source's expected tokens are its goal, or the cap for all if that is not enough.
    """
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("double").alias("cap")).filter("source is not null and share > 0 and cap > 0")
    t = t.groupBy("source").agg(F.max("share").alias("share"), F.max("cap").alias("cap"))
    levels = sizes.groupBy("source", "level").agg(F.sum("n_tokens").cast("double").alias("tokens")).join(t, "source")
    own = Window.partitionBy("source")
    levels = levels.withColumn("all", F.sum("tokens").over(own)).filter("all > 0").withColumn("w", F.pow(F.lit(2.0), F.col("level") / 8))
    # a row per source with a target and weight
    most = F.min(F.col("cap") * F.col("all") / F.col("share")).over(Window.partitionBy()) if total_tokens is None else F.lit(float(total_tokens))
    levels = levels.withColumn("goal", F.least(most * F.col("share"), F.col("cap") * F.col("all")))
    down = own.orderBy(F.desc("w"))
    capped = F.coalesce(F.sum("tokens").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(F.col("tokens") * F.col("w")).over(down.rowsBetween(0, Window.unboundedFollowing))
    levels = levels.withColumn("c", F.try_divide(F.col("goal") - F.col("cap") * capped, rest)).withColumn("fits", F.col("c") * F.col("w") <= F.col("cap") * (1 + 1e-12))
    c = F.first(F.when(F.col("fits"), F.col("c")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean = F.least(F.col("cap"), F.greatest(F.lit(0.0), F.coalesce(c, F.lit(float("inf"))) * F.col("w")))
    # a source that is wanted whole is used whole, documents without tokens too
    whole = F.col("goal") >= F.col("cap") * F.col("all") * (1 - 1e-12)
    return levels.select("source", "level", F.when(whole, F.col("cap")).otherwise(mean).alias("mean"))


def sizes_of(documents: DataFrame, weight: Column | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, level, n_tokens, u: what the sampling needs of each document, written once. Without weight the level goes by the tokens."""
    given = F.lit(None).cast("double") if weight is None else F.coalesce(weight.cast("double"), F.lit(1.0))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("text"))), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.lower(F.trim("source")).alias("source"), given.alias("_w"), u.alias("u")]
    d = token_counts(documents.sparkSession, documents, columns, vocabulary)
    level = F.round(8 * F.log2(F.greatest(F.coalesce("_w", F.greatest("n_tokens", F.lit(1)).cast("double")), F.lit(1e-9)))).cast("int")
    return cut(d.select("doc_id", "source", level.alias("level"), "u", "n_tokens"))


def sample(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """doc_id, source, n_tokens, copies (1 or more) of the documents used; see mixed_documents."""
    d = sizes.join(_plan(sizes, targets, total_tokens), ["source", "level"])
    d = d.withColumn("certain", F.floor(F.col("mean") + 1e-9)).withColumn("p", F.greatest(F.col("mean") - F.col("certain"), F.lit(0.0)))
    chance = F.col("p") > 1e-9
    z = F.log(F.col("u") / (1 - F.col("u"))) - F.log(F.col("p") / (1 - F.col("p")))
    d = d.withColumn("z", F.when(chance, z)).withColumn("bin", F.when(chance, F.floor(F.col("z") * _BINS)))
    # the sample's size is its expected tokens; documents without any take part where the bin is taken
    bins = d.filter("z is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("p") * F.col("n_tokens")).alias("p"))
    own = Window.partitionBy("source")
    upto = F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    bins = bins.select("source", "bin", "n", upto.alias("upto"), F.round(F.sum("p").over(own)).alias("size"))
    edge = bins.filter("upto - n < size and size <= upto").groupBy("source").agg(F.min("bin").alias("edge"), F.min_by(F.col("size") - (F.col("upto") - F.col("n")), "bin").alias("left"))
    d = d.join(edge, "source", "left")
    # only the documents of the bin on the edge, some 1/_BINS of a source, are ranked; the last is taken if more than half of it is wanted
    before = F.coalesce(F.sum("n_tokens").over(own.orderBy("z", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = d.filter("bin = edge").withColumn("k", before).withColumn("extra", (F.col("k") + F.col("n_tokens") / 2 <= F.col("left")).cast("int")).drop("k")
    others = d.filter("bin is null or edge is null or bin <> edge").withColumn("extra", F.coalesce((F.col("bin") < F.col("edge")).cast("int"), F.lit(0)))
    out = ranked.unionByName(others).withColumn("copies", (F.col("certain") + F.col("extra")).cast("bigint"))
    return out.filter("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def mixed_documents(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, weight: Column | None = None, seed: int = 17, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source (plain spelling), n_tokens, copies: a selection whose tokens are shared among the sources as targeted.

    Without total_tokens the total is the largest for which no source with documents needs more than
    max_repeats uses of each; with it, sources that cannot reach their goal stop at max_repeats.
    Targets without documents or with a null or non-positive share or cap, and documents without a
    target, take no part. Of two targets for one source the greater share and cap hold. Within a
    source the expected uses of a document are in proportion to its tokens, or to `weight` (F.lit(1)
    for equal ones), rounded to an eighth of a power of two, up to max_repeats. The tokens used of a
    source are off its goal by no more than one of its documents. Rows with a null doc_id take part.
    The same input gives the same selection.
    """
    return sample(sizes_of(documents, weight, seed, vocabulary), targets, total_tokens)


def _goals(t: DataFrame) -> DataFrame:
    """goal: the tokens that each row's source should give, of the largest total that all can give; 0 without tokens."""
    most = F.min(F.when(F.col("tokens") > 0, F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).over(Window.partitionBy())
    return t.withColumn("goal", F.when(F.col("tokens") > 0, F.col("target_share") * most).otherwise(0.0))


def kept_promises(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, docs, over, twice, within: per target its documents, those used more often than max_repeats, those selected in two rows, and whether the tokens used are within a document of the goal."""
    s = sizes_of(documents, vocabulary=vocabulary)
    have = s.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("n_tokens").alias("largest"))
    picked = sample(s, targets)
    used = picked.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("used"), F.max("copies").alias("most"), (F.count(F.lit(1)) - F.countDistinct("doc_id")).alias("twice"))
    over = picked.join(targets.select(F.lower(F.trim("source")).alias("source"), "max_repeats"), "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("max_repeats")).alias("over"))
    t = targets.select(F.lower(F.trim("source")).alias("source"), F.col("target_share").cast("double").alias("target_share"), F.col("max_repeats").cast("double").alias("max_repeats"))
    t = t.join(have, "source", "left").join(used, "source", "left").join(over, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("docs", "tokens", "largest", "used", "over", "twice")}
    return _goals(t.withColumns(zero)).select("source", "docs", "over", "twice", (F.abs(F.col("used") - F.col("goal")) <= F.col("largest")).alias("within"))


def reached_shares(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """source, target_share, max_repeats, docs, tokens, used_docs, used_tokens, actual_share: one row per target."""
    s = sizes_of(documents, vocabulary=vocabulary)
    have = s.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    used = sample(s, targets, total_tokens).groupBy("source").agg(F.count(F.lit(1)).alias("used_docs"), F.sum(F.col("n_tokens") * F.col("copies")).alias("used_tokens"))
    t = targets.groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("docs", "tokens", "used_docs", "used_tokens")}
    out = t.join(have, "source", "left").join(used, "source", "left").withColumns(zero)
    return out.withColumn("actual_share", F.try_divide(F.col("used_tokens"), F.sum("used_tokens").over(Window.partitionBy())))
