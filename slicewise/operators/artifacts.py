"""Questions over artifacts: (image, artifact, offset) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .joins import salted_join
from .ordered import neighbours

#: offsets per row of the inverted index come from one range of this width
INDEX_BYTES = 1 << 20
#: offset range that one task orders when neighbours are looked for
ORDER_BYTES = 64 << 20


def artifact_histogram(a: DataFrame) -> DataFrame:
    return a.groupBy("artifact").agg(F.count("*").alias("n"))


def artifact_by_image(a: DataFrame) -> DataFrame:
    """Rows per artifact and image. Nearly all such pairs are distinct, so the rows go to their task before they are
    counted: a count in the reading task would hold all pairs of what it reads, however much that is.
    """
    # a number, as partitions without one are put together by their bytes, which are few for the pairs that they hold
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = a.select("artifact", "image").repartition(parts, "artifact", "image")
    return dealt.groupBy("artifact", "image").agg(F.count("*").alias("n"))


def inverted_index(a: DataFrame, width: int = INDEX_BYTES) -> DataFrame:
    """artifact → places, one row per (artifact, image, range of offsets).

    The range keeps a row of a frequent artifact from growing with the data: it holds the offsets
    of `width` bytes of one image at most.
    """
    part = F.call_function("div", F.col("offset").cast("long"), F.lit(width).cast("long"))
    return a.groupBy("artifact", "image", part.alias("part")).agg(
        F.array_sort(F.collect_set("offset")).alias("offsets")
    )


def tfidf(a: DataFrame) -> DataFrame:
    """(artifact, image, tf, df, tfidf) with tf·ln(images / images with the artifact)."""
    # Used several times below: computed once.
    tf = stored(artifact_by_image(a).withColumnRenamed("n", "tf"), "tf")
    df = stored(tf.groupBy("artifact").agg(F.count("*").alias("df")), "df")
    images = tf.agg(F.count_distinct("image")).scalar()
    joined = salted_join(tf, df, "artifact", ["image"], counts=df.withColumnRenamed("df", "n"))
    return joined.select(
        "artifact", "image", "tf", "df", (F.col("tf") * F.log(images / F.col("df"))).alias("tfidf")
    )


def top_images(a: DataFrame, artifact, k: int = 10) -> DataFrame:
    """The k images with most occurrences of an artifact."""
    hits = a.where(F.col("artifact") == artifact).groupBy("image").agg(F.count("*").alias("n"))
    return hits.orderBy(F.desc("n"), "image").limit(k)


def shared_artifacts(a: DataFrame, least: int = 2) -> DataFrame:
    """Artifacts found on at least `least` images, with the number of images and occurrences."""
    totals = artifact_by_image(a).groupBy("artifact").agg(
        F.count("*").alias("images"), F.sum("n").alias("occurrences")
    )
    return totals.where(F.col("images") >= least)


def near_artifacts(a: DataFrame, w: int = 1000) -> DataFrame:
    """Pairs of artifacts of one image with offsets at most `w` bytes apart, each pair once.

    Equi-join on (image, range of w bytes): the left row looks into its own range and the next
    one. A range holds at most w offsets, so neither a large image nor a frequent artifact makes a
    large group, and a row meets at most the artifacts of 2w bytes.
    """
    bin_of = F.call_function("div", F.col("offset").cast("long"), F.lit(w).cast("long"))
    left = a.select(
        "image",
        F.col("artifact").alias("artifact_a"),
        F.col("offset").alias("offset_a"),
        F.explode(F.array(bin_of, bin_of + 1)).alias("bin"),
    )
    right = a.select(
        "image", F.col("artifact").alias("artifact_b"), F.col("offset").alias("offset_b"), bin_of.alias("bin")
    )
    pairs = left.join(right, ["image", "bin"])
    gap = F.col("offset_b") - F.col("offset_a")
    ahead = (gap > 0) | ((gap == 0) & (F.col("artifact_a") < F.col("artifact_b")))
    return pairs.where(ahead & (gap <= w)).select(
        "image", "artifact_a", "offset_a", "artifact_b", "offset_b", gap.alias("distance")
    )


def adjacent_artifacts(a: DataFrame, width: int = ORDER_BYTES) -> DataFrame:
    """Each artifact with the one before and the one after it in its image."""
    part = F.call_function("div", F.col("offset").cast("long"), F.lit(width).cast("long"))
    placed = a.select("image", "artifact", "offset")
    rows = neighbours(placed, ["image"], ["offset", "artifact"], ["artifact", "offset"], part)
    return rows.select(
        "image",
        "artifact",
        "offset",
        F.col("prev.artifact").alias("prev_artifact"),
        F.col("prev.offset").alias("prev_offset"),
        F.col("next.artifact").alias("next_artifact"),
        F.col("next.offset").alias("next_offset"),
    )


def related_media(file_artifact: DataFrame, media_file: DataFrame, seed) -> DataFrame:
    """Media that hold a file sharing an artifact with file `seed`.

    file_artifact(file, artifact), media_file(media, file). Semi-joins, so a frequent artifact
    multiplies nothing.
    """
    edges = file_artifact.select("file", "artifact")
    artifacts = edges.where(F.col("file") == seed).select("artifact").distinct()
    files = edges.join(artifacts, "artifact", "left_semi").select("file").distinct()
    return media_file.join(files, "file", "left_semi").select("media").distinct()


def media_within(file_artifact: DataFrame, media_file: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, media, hops): the media each seed file reaches over files that share artifacts, with the least number of hops.

    A file is on media at 0 hops; each hop goes to the files that share an artifact with a file of the hop before. Only
    files that a seed reaches for the first time go on, and only artifacts that it has not passed, so nothing is walked
    twice and cycles end. Frequent artifacts are split by salts. Every hop is written, and it ends when no file is new.
    """
    edges = stored(file_artifact.select("file", "artifact").distinct(), "edges")
    counts = edges.groupBy("artifact").agg(F.count("*").alias("n"))
    files = stored(seeds.select(F.col("file").alias("seed"), "file", F.lit(0).alias("hops")).distinct(), "reached")
    frontier, reached, passed = files, files, None
    for hop in range(1, hops + 1):
        artifacts = frontier.join(edges, "file").select("seed", "artifact").distinct()
        if passed is not None:
            artifacts = artifacts.join(passed, ["seed", "artifact"], "left_anti")
        artifacts = stored(artifacts, "passed")
        passed = artifacts if passed is None else passed.unionByName(artifacts)
        met = salted_join(edges, artifacts, "artifact", ["file"], counts=counts).select("seed", "file").distinct()
        frontier = stored(met.join(reached, ["seed", "file"], "left_anti").withColumn("hops", F.lit(hop)), "reached")
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
    return media_file.join(reached, "file").groupBy("seed", "media").agg(F.min("hops").alias("hops"))


def slowest_slice(df: DataFrame, cost: str = "cost") -> DataFrame:
    """Offset and cost of the most expensive slice of each image."""
    worst = F.max_by(F.struct("offset", cost), F.struct(F.col(cost), -F.col("offset")))
    rows = df.groupBy("image").agg(worst.alias("worst"))
    return rows.select("image", F.col("worst.offset").alias("offset"), F.col(f"worst.{cost}").alias(cost))


def apply_counts(old: DataFrame, new: DataFrame, mode: str = "insert", key: str = "key") -> DataFrame:
    """Counts after new ones come in: "insert" adds to the old count, "merge" replaces it."""
    both = old.select(key, F.col("n").alias("old"), F.lit(None).cast("long").alias("new")).unionByName(
        new.select(key, F.lit(None).cast("long").alias("old"), F.col("n").alias("new"))
    )
    sums = both.groupBy(key).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    if mode == "insert":
        n = F.coalesce("old", F.lit(0)) + F.coalesce("new", F.lit(0))
    elif mode == "merge":
        n = F.coalesce("new", "old")
    else:
        raise ValueError("mode is insert or merge")
    return sums.select(key, n.alias("n"))
