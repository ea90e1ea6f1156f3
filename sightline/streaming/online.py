"""Incremental reconstruction on Structured Streaming.

Every stage is a ``foreachBatch`` body over tables partitioned by batch number. A batch writes only its
own partition, so a batch that is run again after a failure overwrites what it wrote before. Stored state
is ids, words and observations, never depth maps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sightline.operators.batch import timing_summary
from sightline.operators.retrieval import BUILD_ASSIGN, QUERY_ASSIGN, asmk_aggregate, asmk_scores
from sightline.operators.selection import topsim
from sightline.operators.tracks import attach_frames, cap_tracks, duplicated, remove_tracks, union_tracks
from sightline.operators.trajectory import nearest_asof
from sightline.scale import cut

GLOBAL_WARMUP = 8  # frames refined globally at the start of a scene


def refinement_mode(frame: Column, gba_step: int) -> Column:
    """'global' for the first frames and every ``gba_step``-th one (frames count from 0), else 'local'."""
    return F.when((frame < GLOBAL_WARMUP) | (frame % gba_step == 0), "global").otherwise("local")


def frame_stream(spark: SparkSession, path: str, schema: T.StructType | str, every: int = 1,
                 files_per_batch: int = 1, idx: str = "img_id") -> DataFrame:
    """Stream of frame rows in file order, every ``every``-th frame; ``idx`` counts from 0."""
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return s.where(F.col(idx) % every == 0) if every > 1 else s


class BatchTable:
    """Parquet table with one folder per batch, and merged folders that stand for all batches before one."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str) -> None:
        self.spark, self.path, self.merged = spark, path, f"{path}_merged"
        self.schema = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def write(self, df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def _folders(self, path: str, key: str) -> list[int]:
        """Numbers of the finished folders ``key=number`` under a path."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        done = [p.getName() for p in names if p.getName().startswith(key + "=") and fs.exists(p.suffix("/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in done)

    def _drop(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def read(self, before: int | None = None) -> DataFrame:
        """Rows of all batches, or of those before one: the last merged folder that fits and the batches after it."""
        base = max((u for u in self._folders(self.merged, "upto") if before is None or u <= before), default=None)
        later = [b for b in self._folders(self.path, "batch") if (base is None or b >= base) and (before is None or b < before)]
        folders = ([f"{self.merged}/upto={base}"] if base is not None else []) + [f"{self.path}/batch={b}" for b in later]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def merge(self, batch: int, rows: DataFrame | None = None) -> None:
        """Write what all batches before ``batch`` hold as one folder; ``rows`` may say the same in fewer rows.

        Run it at the start of ``batch``: earlier batches are finished then. A merge that fails leaves readers on the
        merged folder before it, one that is done isn't done again; that folder and the batches behind it are kept, all older ones deleted.
        """
        if batch in self._folders(self.merged, "upto"):
            return
        (self.read(before=batch) if rows is None else rows).write.mode("overwrite").parquet(f"{self.merged}/upto={batch}")
        kept = [u for u in self._folders(self.merged, "upto") if u <= batch][-2:]
        for u in self._folders(self.merged, "upto"):
            if u < kept[0]:
                self._drop(f"{self.merged}/upto={u}")
        if len(kept) == 2:
            for b in self._folders(self.path, "batch"):
                if b < kept[0]:
                    self._drop(f"{self.path}/batch={b}")


class OnlineRetrieval:
    """Query the inverted index with each new frame, then add it.

    New frames also see the earlier frames of their own batch, so the batch size does not change results. Every
    ``merge_every`` batches the index of earlier ones is merged into one folder, so that a batch opens a bounded number.
    """

    def __init__(self, spark: SparkSession, folder: str, codebook: DataFrame, dim: int, k: int, merge_every: int = 64) -> None:
        self.codebook, self.dim, self.k, self.merge_every = codebook, dim, k, merge_every
        self.index = BatchTable(spark, f"{folder}/index", "scene long, img_id long, word long, bits array<bigint>")
        self.pairs = BatchTable(spark, f"{folder}/pairs", "scene long, query long, img_id long")
        self.scores = BatchTable(spark, f"{folder}/scores", "scene long, i long, j long, s double")

    def __call__(self, desc: DataFrame, batch: int) -> None:
        if batch and batch % self.merge_every == 0:
            self.index.merge(batch)
        new = cut(asmk_aggregate(desc, self.codebook, BUILD_ASSIGN))
        query = cut(asmk_aggregate(desc, self.codebook, QUERY_ASSIGN))
        history = self.index.read(before=batch)
        sim = cut(asmk_scores(query, history.unionByName(new.select(history.columns)), self.dim, past_only=True))
        self.scores.write(sim, batch)
        self.pairs.write(topsim(sim, self.k), batch)
        self.index.write(new, batch)


class OnlineTracks:
    """Growing track store: drop old tracks that new ones cover, append, cap, and attach every new frame.

    Each frame is attached to the past frame, of its own batch or before, that shares most tracks with it, and gets one
    event, in the batch that brings it first. The store is a log: a batch writes the observations it adds and the places of
    those it takes away, however many its scenes hold already; every ``merge_every`` batches the log is merged.

    What a batch must hold depends on ``ids``. With ``batch`` (the form of a matcher that is run per batch) track ids mean
    something inside the batch only, so its tracks bring their observations in past frames again; stored tracks they
    cover are dropped, capped ones once per batch. A batch of new frames alone shares no track with the past then. With
    ``global`` a track keeps its id in the whole scene, and a batch may hold its new observations alone: they join the
    stored track, no track is dropped for being covered, and an observation that came before is kept as it was. Without
    the cap, events then don't depend on how the feed is cut, if frames come in order.
    """

    def __init__(self, spark: SparkSession, folder: str, num_keep: int, thr: float = 5.0, gba_step: int = 10,
                 on_frame: Callable[[DataFrame, int], None] | None = None, ids: str = "batch", merge_every: int = 64) -> None:
        if ids not in ("batch", "global"):
            raise ValueError(f"ids must be 'batch' or 'global', not {ids!r}")
        self.num_keep, self.thr, self.gba_step, self.on_frame, self.ids, self.merge_every = num_keep, thr, gba_step, on_frame, ids, merge_every
        self.schema = "scene long, img_id long, track_id long, u double, v double"
        self.store = BatchTable(spark, f"{folder}/tracks", self.schema + ", version long, gone boolean")
        self.events = BatchTable(spark, f"{folder}/events", "scene long, img_id long, attached_to long, n_matches long, mode string, n_tracks long")

    def _live(self, before: int | None) -> DataFrame:
        rows = self.store.read(before)
        place = ["scene", "img_id", "track_id"]
        taken = rows.where("gone").groupBy(*place).agg(F.max("version").alias("_taken"))
        return rows.where("NOT gone").join(taken, place, "left").where("_taken IS NULL OR version >= _taken").drop("_taken")

    def current(self, before: int | None = None) -> DataFrame:
        """Latest observations of every scene: those that no later batch took away."""
        return self._live(before).drop("version", "gone")

    def finish(self, batch: int) -> DataFrame:
        """One event of mode 'final' per scene, at its last frame, for a last refinement of all of it."""
        last = self.current().groupBy("scene").agg(F.max("img_id").alias("img_id"), F.countDistinct("track_id").alias("n_tracks"))
        feed = cut(last.select("scene", "img_id", F.lit(None).cast("long").alias("attached_to"), F.lit(None).cast("long").alias("n_matches"),
                               F.lit("final").alias("mode"), "n_tracks"))
        self.events.write(feed, batch)
        if self.on_frame is not None:
            self.on_frame(feed, batch)
        return feed

    def __call__(self, new: DataFrame, batch: int) -> None:
        new = cut(new.select("scene", "img_id", "track_id", "u", "v"))
        if new.isEmpty():
            return
        if batch and batch % self.merge_every == 0:
            self.store.merge(batch, self._live(batch))
            self.events.merge(batch)
        touched = new.select("scene").distinct()
        old = cut(self.current(before=batch).join(touched, "scene", "left_semi"))
        if self.ids == "global":
            place = ["scene", "img_id", "track_id"]
            joined = old.unionByName(new.dropDuplicates(place).join(old, place, "left_anti"))
        else:
            joined = union_tracks(remove_tracks(old, cut(duplicated(old, new, self.thr))), new)
        merged = cut(cap_tracks(joined, self.num_keep))
        added, taken = merged.exceptAll(old.select(merged.columns)), old.select(merged.columns).exceptAll(merged)
        change = added.withColumn("gone", F.lit(False)).unionByName(taken.withColumn("gone", F.lit(True)))
        self.store.write(change.select("*", F.lit(batch).cast("long").alias("version")), batch)
        frames = cut(new.select("scene", "img_id").distinct().join(self.events.read(before=batch), ["scene", "img_id"], "left_anti"))
        at = attach_frames(merged, frames.withColumnRenamed("img_id", "j")).select("scene", F.col("j").alias("img_id"), F.col("i").alias("attached_to"), "n_matches")
        born = merged.groupBy("scene", "track_id").agg(F.min("img_id").alias("first")).groupBy("scene", "first").agg(F.count("*").alias("n"))
        counts = frames.join(born, "scene").where("first <= img_id").groupBy("scene", "img_id").agg(F.sum("n").alias("n_tracks"))
        feed = frames.join(at, ["scene", "img_id"], "left").withColumn("mode", refinement_mode(F.col("img_id"), self.gba_step))
        feed = feed.join(counts, ["scene", "img_id"], "left").withColumn("n_tracks", F.coalesce("n_tracks", F.lit(0).cast("long")))
        feed = cut(feed.select("scene", "img_id", "attached_to", "n_matches", "mode", "n_tracks"))
        self.events.write(feed, batch)
        if self.on_frame is not None:
            self.on_frame(feed, batch)


def running_size(frames: DataFrame, by: str = "scene") -> DataFrame:
    """Largest height and width and the frame count so far per scene; state is three numbers per scene."""
    return frames.groupBy(by).agg(F.max("height").alias("max_height"), F.max("width").alias("max_width"), F.count("*").alias("n_frames"))


def timing_stream(events: DataFrame) -> DataFrame:
    """Stage timings summed over the stream."""
    return timing_summary(events)


class OnlineAssociation:
    """New frames with the nearest pose of a static table, strictly closer than ``max_dt``.

    Only poses in the time buckets around a batch enter its association, which is the ordered one of batch
    jobs, so a crowded bucket is never collected.
    """

    def __init__(self, spark: SparkSession, folder: str, poses: DataFrame, max_dt: float, pose_id: str, schema: str) -> None:
        self.poses, self.max_dt, self.pose_id = poses, max_dt, pose_id
        self.matched = BatchTable(spark, f"{folder}/matched", schema)

    def __call__(self, frames: DataFrame, batch: int) -> None:
        bucket = F.floor(F.col("ts") / self.max_dt)
        frames = cut(frames)
        near = frames.select("scene", F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("_b")).distinct()
        poses = self.poses.withColumn("_b", bucket).join(near, ["scene", "_b"], "left_semi").drop("_b")
        out = nearest_asof(frames, poses, "ts", ["scene"], self.max_dt, self.pose_id)
        self.matched.write(out.select([f.name for f in self.matched.schema.fields]), batch)


def run(stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True):
    """Start a stream that hands each batch to ``body``."""
    writer = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
