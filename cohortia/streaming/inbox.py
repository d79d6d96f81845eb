"""An inbox of notices as a stream: delivered at least once, kept once, with the latest state of each message.

Notices are JSON texts. A notice is known by the hash of its body, within a watermark that bounds the state; bodies that aren't JSON
objects are kept apart as failed. Statuses, one row per message and status, are upserted batch by batch into a table divided by hash of the message, of which a batch
rewrites the parts it touches; a repeated batch changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cohortia.operators.participation import ranked

NOTICE = "cuerpo string, recibido_en timestamp"
PARTS = 64  # of the table of statuses
STATUS = "mensaje string, estado string, en timestamp"
BODY = "mensaje string, estado string, en string, texto string"


def notices(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """Stream of the notices in a folder of JSON files."""
    return spark.readStream.schema(NOTICE).option("maxFilesPerTrigger", files).json(folder)


def once(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream with huella, each body once within the watermark."""
    known = stream.withColumn("huella", F.sha2("cuerpo", 256)).withWatermark("recibido_en", late)
    return known.dropDuplicatesWithinWatermark(["huella"])


def parsed(df: DataFrame) -> DataFrame:
    """df with the fields of the body; estado_aviso: procesado, or fallido for bodies that are no JSON object with a message."""
    body = F.from_json("cuerpo", BODY)
    out = df.withColumn("x", body)
    ok = F.col("x.mensaje").isNotNull()
    moment = F.expr("try_cast(x.en as timestamp)")
    return out.select(*df.columns, F.when(ok, "procesado").otherwise("fallido").alias("estado_aviso"), "x.mensaje", "x.estado", F.coalesce(moment, "recibido_en").alias("en"), "x.texto")


def latest(statuses: DataFrame) -> DataFrame:
    """One row per message: its last status, of equal times the greater."""
    return statuses.groupBy("mensaje").agg(F.max_by("estado", F.struct("en", "estado")).alias("estado"), F.max("en").alias("en"))


def by_status(statuses: DataFrame) -> DataFrame:
    """One row per message and status, with the last time it was told."""
    return statuses.groupBy("mensaje", "estado").agg(F.max("en").alias("en"))


def upsert_statuses(folder: str, parts: int = PARTS):
    """A function for foreachBatch: merges a batch's statuses, one row per message and status, into the table in the folder.

    The table is divided by hash of the message; a batch rewrites only the parts it touches, each as a new version beside the old one, and then deletes
    versions older than the one before. A repeated batch finds its own version and replaces it. Failed notices are stored under failed/.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()  # read once for both
        try:
            spark = batch.sparkSession
            batch.filter("estado_aviso = 'fallido'").select("huella", "cuerpo", "recibido_en").write.mode("overwrite").parquet(f"{folder}/failed/batch={number}")
            new = batch.filter("estado_aviso = 'procesado' and estado is not null").select("mensaje", "estado", "en").withColumn("parte", _part(parts))
            touched = [r[0] for r in new.select("parte").distinct().collect()]  # at most `parts` numbers
            if not touched:
                return
            old = _read(spark, {p: v for p, v in _versions(spark, folder, before=number).items() if p in touched})
            merged = by_status(old.unionByName(new.select("mensaje", "estado", "en"))).withColumn("parte", _part(parts))
            target = f"{folder}/version={number}"
            merged.repartition(len(touched), "parte").write.mode("overwrite").partitionBy("parte").parquet(target)
            _drop_stale(spark, folder)
        finally:
            batch.unpersist()

    return write


def _part(parts: int):
    return F.pmod(F.xxhash64("mensaje"), F.lit(parts)).cast("int")


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, ([s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else [])


def _written(spark: SparkSession, folder: str) -> dict[int, dict[int, str]]:
    """The folders of each part of each whole version."""
    out: dict[int, dict[int, str]] = {}
    for version in _files(spark, folder)[1]:
        if version.getName().startswith("version="):
            inside = [p.getName() for p in _files(spark, version.toString())[1]]
            if "_SUCCESS" in inside:
                out[int(version.getName().split("=")[1])] = {int(n.split("=")[1]): f"{version}/{n}" for n in inside if n.startswith("parte=")}
    return out


def _versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, str]:
    """The newest folder of each part, or the newest below a version."""
    out: dict[int, str] = {}
    for number, parts in sorted(_written(spark, folder).items()):
        if before is None or number < before:
            out.update(parts)
    return out


def _drop_stale(spark: SparkSession, folder: str) -> None:
    """Delete the folders of parts that two newer versions have replaced."""
    seen: dict[int, int] = {}
    for _, parts in sorted(_written(spark, folder).items(), reverse=True):
        for p, path in parts.items():
            seen[p] = seen.get(p, 0) + 1
            if seen[p] > 2:
                fs, _ = _files(spark, path)
                fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)


def _read(spark: SparkSession, folders: dict[int, str]) -> DataFrame:
    return spark.read.schema(STATUS).parquet(*folders.values()) if folders else spark.createDataFrame([], STATUS)


def current_statuses(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The table: one row per message and status, as of the newest version or the newest below a number."""
    return _read(spark, _versions(spark, folder, before))


def failed_notices(spark: SparkSession, folder: str) -> DataFrame:
    """Stored notices that couldn't be read, for `reprocessed` once they can be."""
    batches = [p.toString() for p in _files(spark, f"{folder}/failed")[1] if p.getName().startswith("batch=")]
    shape = "huella string, " + NOTICE
    return (spark.read.schema(shape).parquet(*batches) if batches else spark.createDataFrame([], shape)).withColumn("estado_aviso", F.lit("fallido"))


def run_inbox(spark: SparkSession, folder: str, table: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Starts the inbox over what is in the folder now; ends when it is read."""
    return parsed(once(notices(spark, folder), late)).writeStream.foreachBatch(upsert_statuses(table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def reprocessed(notices_table: DataFrame, states: tuple[str, ...] = ("fallido", "pendiente")) -> DataFrame:
    """Stored notices in the given states, parsed anew; safe to repeat."""
    chosen = notices_table.filter(F.col("estado_aviso").isin(*states)).select("cuerpo", "recibido_en")
    return parsed(chosen.withColumn("huella", F.sha2("cuerpo", 256)).dropDuplicates(["huella"]))


def calls_by_day(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Calls per person and day: persona, dia, llamados; one row of state a day, whatever the length of the windows asked for. stream: persona, en."""
    days = stream.withWatermark("en", late).groupBy(F.window("en", "1 day"), "persona").agg(F.count(F.lit(1)).alias("llamados"))
    return days.select("persona", F.col("window.start").cast("date").alias("dia"), "llamados")


def calls_in_window(days: DataFrame, length: int = 90) -> DataFrame:
    """Calls per person in the `length` days up to each day with a call: persona, hasta, llamados. days: the table that calls_by_day makes."""
    span = Window.partitionBy("persona").orderBy(F.unix_date("dia")).rangeBetween(1 - length, 0)
    return days.select("persona", F.col("dia").alias("hasta"), F.sum("llamados").over(span).alias("llamados"))


def unexpired(df: DataFrame, at: str, now, days: int) -> DataFrame:
    """Rows whose time to live hasn't ended."""
    return df.filter(F.col(at) >= now - F.make_interval(days=F.lit(days)))


def late_changes(existing: DataFrame, arriving: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Arriving changes that begin before the current validity of their key, which are rejected before an append."""
    begun = existing.groupBy(*keys).agg(F.max(at).alias("__actual"))
    return arriving.join(begun, keys).filter(F.col(at) < F.col("__actual")).drop("__actual")


def numbered(df: DataFrame, size: int, order: list[str]) -> DataFrame:
    """df with `lote`: batches of `size` rows in the given order within ranges, so no task numbers all rows."""
    placed, _ = ranked(df, [F.col(c) for c in order])
    return placed.withColumn("lote", F.floor((F.col("puesto") - 1) / size)).drop("puesto")
