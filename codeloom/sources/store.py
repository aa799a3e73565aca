"""The stored tables: Parquet partitioned by repository, JSON for interchange, an append-only audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from codeloom import schema
from codeloom.operators.graph import last_wins
from codeloom.session import cut

REQUIRED = {"nodes": ("uuid", "repo_id", "file_path", "type", "name", "created_by"), "edges": ("uuid", "from_uuid", "to_uuid", "type", "created_by")}
SCHEMAS = {"nodes": schema.NODES, "edges": schema.EDGES, "audit": schema.AUDIT, "files": schema.FILES}


class Store:
    """Tables under one folder. A table that was never written is empty."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.folder}/{table}"

    def exists(self, table: str) -> bool:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(table))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, table: str, valid: bool = True) -> DataFrame:
        """valid: without the rows that lack a required value."""
        if not self.exists(table):
            return self.spark.createDataFrame([], SCHEMAS[table])
        df = self.spark.read.schema(SCHEMAS[table]).parquet(self.path(table))
        for c in REQUIRED.get(table, ()) if valid else ():
            df = df.where(F.col(c).isNotNull())
        return df

    def write(self, table: str, df: DataFrame) -> None:
        """Replace the repositories (or, without repo_id, the table) that df holds; the others stay."""
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]])
        writer = df.write.mode("overwrite")
        if "repo_id" in df.columns:
            writer = writer.partitionBy("repo_id").option("partitionOverwriteMode", "dynamic")
        writer.parquet(self.path(table))

    def append(self, table: str, df: DataFrame) -> None:
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in SCHEMAS[table]])
        writer = df.write.mode("append")
        if "repo_id" in df.columns:
            writer = writer.partitionBy("repo_id")
        writer.parquet(self.path(table))

    def repos(self) -> DataFrame:
        return self.read("nodes").select("repo_id").distinct()

    def has_repo(self, repo_id: str) -> bool:
        return not self.read("nodes").where(F.col("repo_id") == repo_id).isEmpty()

    def delete_repo(self, repo_id: str) -> None:
        """Drop a repository: its partitions, the links at either end of its entities, and the audit rows of both."""
        nodes = self.read("nodes", valid=False).where(F.col("repo_id") == repo_id).select("uuid").distinct()
        edges, audit = self.read("edges", valid=False), self.read("audit")
        near = lambda df, c: df.join(nodes.withColumnRenamed("uuid", c), c, "left_semi")
        gone = cut(near(edges, "from_uuid").select("uuid").unionByName(near(edges, "to_uuid").select("uuid")).distinct())
        things = cut(nodes.unionByName(gone).withColumnRenamed("uuid", "entity_uuid"))
        if self.exists("edges"):
            self._replace("edges", edges.join(gone, "uuid", "left_anti").select(*edges.columns))
        if self.exists("audit"):
            kept = audit.join(things, "entity_uuid", "left_anti").where(F.coalesce((F.col("entity_type") != "repo") | (F.col("entity_uuid") != repo_id), F.lit(True)))
            self._replace("audit", kept.select(*audit.columns))
        for table in ("nodes", "files"):
            path, files = self._file(f"{self.path(table)}/repo_id={repo_id}")
            files.delete(path, True)

    def _file(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _replace(self, table: str, df: DataFrame) -> None:
        """Write df, which may read the table, beside it and put it in its place."""
        new, files = self._file(f"{self.path(table)}.new")
        df.write.mode("overwrite").parquet(str(new))
        old, _ = self._file(self.path(table))
        files.delete(old, True)
        files.rename(new, old)


def ingest_audit(rows: DataFrame, action: str, entity_type: str) -> DataFrame:
    """The audit rows of a bulk write: one for each row (uuid, created_at), made by the system."""
    return rows.select(
        F.sha2(F.concat_ws("|", F.lit(action), "uuid"), 256).alias("uuid"), F.col("created_at").alias("timestamp"), F.lit("system").alias("user"), F.lit(action).alias("action"),
        F.lit(entity_type).alias("entity_type"), F.col("uuid").alias("entity_uuid"), F.lit(None).cast("string").alias("details"),
    )


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new over it, the last of each key by created_at; rows of new win ties."""
    both = old.withColumn("w_", F.lit(0)).unionByName(new.withColumn("w_", F.lit(1)))
    return last_wins(both, keys, [F.desc("w_"), F.desc("created_at")]).drop("w_")


def write_index(index: DataFrame, path: str) -> None:
    """The entity index as JSON lines."""
    index.write.mode("overwrite").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    kind = T.StructType([T.StructField(n, T.StringType()) for n in ("uuid", "repo_id", "name", "type", "file_path")] + [T.StructField("start_line", T.IntegerType()), T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("short_doc", T.StringType())])
    return spark.read.schema(kind).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Audit rows as JSON lines, after what is there."""
    rows.write.mode("append").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def read_log(spark: SparkSession, path: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A slice of a log: offset counts lines, also malformed ones, limit counts parsed rows.

    Lines are numbered by file and split: only the number of lines of each split is brought together, and no task sees
    more than its own lines. A log that was never written is empty.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], T.StructType([T.StructField("n", T.LongType()), *schema.AUDIT.fields]))
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("size"))
    # One row per split of the log's files.
    before = F.coalesce(F.sum("size").over(W.orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = splits.withColumn("before", before).select("file", "block", "first", "before")
    numbered = lines.join(F.broadcast(starts), ["file", "block"]).withColumn("n", F.col("before") + F.col("at") - F.col("first")).where(F.col("n") >= offset)
    parsed = numbered.withColumn("v", F.try_parse_json("value")).where("v is not null").orderBy("n").limit(limit)
    get = lambda f: F.try_variant_get("v", f"$.{f.name}", "string").cast(f.dataType).alias(f.name)
    return parsed.select("n", *[get(f) for f in schema.AUDIT.fields])


def audit_page(audit: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the audit table, by time, then id."""
    return audit.orderBy("timestamp", "uuid").offset(offset).limit(limit)


def audit_of(audit: DataFrame, entities: DataFrame, most: int | None = None) -> DataFrame:
    """The audit rows of entities (entity, as plain ids; a bounded list), among all rows or the first `most` by time."""
    rows = audit if most is None else audit_page(audit, most)
    return rows.join(F.broadcast(entities.select("entity")), F.lower(F.trim("entity_uuid")) == F.col("entity"), "left_semi")
