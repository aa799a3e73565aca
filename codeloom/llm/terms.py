"""How often every distinct term occurs, kept by signed deltas.

A batch of changes is a table of record images: what a record was before (absent for an added record) and what it is
after (absent for a deleted one). Only changed records contribute: their terms' occurrences and record counts are
subtracted for the old image and added for the new one, pre-aggregated where the rows are, and merged into the counts.
The number of records is one of the counts, kept by the same deltas. Counts are one row per field and term, stored in
versions partitioned by field and a hash of the term, so a merge is one shuffle of the deltas and the counts on the same
key, a reader never sees a half-written version, and a later run goes on from the version it finds.

Terms are lower-cased, trimmed and NFC-composed; null and empty terms don't count. A record's term counts as one record
however often it occurs in it. Rows without key are no records; of the rows of a record the last one counts, one without
a sequence is older than any other, and of rows with the same sequence the largest content counts. Hot terms don't
matter: both counts are sums.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.versions import Versions

#: The field under which the number of records is counted.
RECORDS = "#records"
#: Into how many folders each field's counts are divided.
BUCKETS = 16
COUNTS = "term string, occurrences bigint, records bigint, field string, bucket int"
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"


def normal(term: str | None) -> str | None:
    if term is None:
        return None
    term = unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).lower().strip())
    return term or None


def normals(terms: pa.Array) -> pa.Array:
    """The normal forms of an array of strings, null for what doesn't count: plain ASCII in one go, the rest one by one."""
    plain = pc.if_else(pc.equal(trimmed := pc.utf8_trim(pc.ascii_lower(terms), _BLANKS), ""), None, trimmed)
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(terms)), False)
    if not pc.any(odd).as_py():
        return plain
    return pc.replace_with_mask(plain, odd, pa.array([normal(t) for t in pc.filter(terms, odd).to_pylist()], pa.string()))


def _compose(rows: DataFrame, column: str) -> DataFrame:
    """Normal forms of array<string>, in Arrow batches."""
    i = rows.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(i)
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            new = pa.ListArray.from_arrays(offsets, normals(lists.flatten()), mask=lists.is_null() if lists.null_count else None)
            yield pa.RecordBatch.from_arrays([new if k == i else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _image(fields: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(f) for f, c in fields.items()])


def records(rows: DataFrame, key: str, seq: str, fields: dict[str, Column]) -> DataFrame:
    """(record, fields as arrays of terms): the last row of each record."""
    last = F.max(F.struct(F.col(seq).alias("s"), _image(fields).alias("i")))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record")).agg(last.alias("l")).select("record", "l.i.*")


def images(rows: DataFrame, key: str, seq: str, fields: dict[str, Column], late: Column) -> DataFrame:
    """(sign, record, fields): for an increment, whose rows are those for which `late` holds, the old image (sign -1) of
    each record that had one and the new image (sign 1) of each record, unless they are alike. One reading of the rows
    gives both."""
    row = F.struct(F.col(seq).alias("s"), _image(fields).alias("i"))
    pair = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("record")).agg(F.max(F.when(~late, row)).alias("old"), F.max(row).alias("new"), F.max(late).alias("late"))
    both = F.array_compact(F.array(F.when(F.col("old").isNotNull(), F.struct(F.lit(-1).alias("sign"), F.col("old.i").alias("i"))), F.struct(F.lit(1).alias("sign"), F.col("new.i").alias("i"))))
    return pair.where("late and (old is null or old.i <> new.i)").select("record", F.explode(both).alias("x")).select("x.sign", "record", "x.i.*")


def deltas(changes: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, term, occurrences, records): what images (sign, record, one array per field) change, with the number of
    records under the field RECORDS."""
    own = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("terms")) for f in fields], F.struct(F.lit(RECORDS).alias("field"), F.array(F.lit(".")).alias("terms")))
    pairs = changes.select("sign", F.explode(own).alias("p")).select("sign", "p.field", "p.terms").where(F.size("terms") > 0)
    placed = _compose(pairs, "terms").select("field", "sign", "terms", F.posexplode("terms").alias("pos", "term")).where("term is not null")
    first = F.array_position("terms", F.col("term")) == F.col("pos") + 1
    rows = placed.select("field", "term", F.col("sign").cast("bigint").alias("o"), F.when(first, F.col("sign")).otherwise(F.lit(0)).cast("bigint").alias("r"))
    return rows.groupBy("field", "term").agg(F.sum("o").alias("occurrences"), F.sum("r").alias("records"))


def signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """Images (sign, record, fields) of a batch given as old and new images (record, fields)."""
    parts = [df.withColumn("sign", F.lit(s)) for df, s in ((before, -1), (after, 1)) if df is not None]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def merge(counts: DataFrame | None, changes: DataFrame) -> DataFrame:
    """The counts after the changes; terms that no record has any more are dropped."""
    if counts is None:
        return changes.where("occurrences > 0")
    both = counts.select(*changes.columns).unionByName(changes).groupBy("field", "term")
    return both.agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences > 0")


class Counts:
    """The counts kept in a folder that all executors share; a new one goes on from what is there.

    As many tasks write them as a shuffle has, whatever the number of buckets; where there is little, fewer.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.kept = Versions(spark, folder)
        self.buckets = buckets
        self.parts = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // buckets)

    @property
    def version(self) -> int:
        return self.kept.current()

    def read(self) -> DataFrame | None:
        return self.kept.read("counts", COUNTS)

    def apply(self, changes: DataFrame) -> DataFrame:
        """Merge the changes into the next version, written whole before it becomes current."""
        merged = merge(self.read(), changes).withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets)))
        part = F.pmod(F.xxhash64("term"), F.lit(self.parts))
        self.kept.write({"counts": merged.repartition("field", "bucket", part)}, {"counts": ["field", "bucket"]})
        return self.read()


def marked(counts: DataFrame, fewest: int = 3, largest_share: float = 0.01) -> DataFrame:
    """The counts of terms with mark: rare (in fewer than `fewest` records), common (in more than `largest_share` of all),
    else null."""
    records = F.col("field") == RECORDS
    total = counts.where(records).agg(F.max("records").alias("n"))
    joined = counts.where(~records).join(F.broadcast(total))
    mark = F.when(F.col("records") < fewest, F.lit("rare")).when(F.col("records") > F.col("n") * largest_share, F.lit("common"))
    return joined.select("field", "term", "occurrences", "records", mark.alias("mark"))


def node_terms(nodes: DataFrame, cuts: Sequence[str], folder: str) -> DataFrame:
    """Counts of entity names and tags, built in increments bounded by the times of `cuts`: the rows created before the
    first, then, for each that follows, the entities that have rows in it. An increment reads the rows up to its end once."""
    fields = {"name": F.array(F.col("name")), "tags": F.col("tags")}
    names = list(fields)
    store = Counts(nodes.sparkSession, folder)
    rows = nodes.select("uuid", "created_at", "name", "tags")
    at = F.col("created_at")
    times = [F.lit(c).cast("timestamp_ntz") for c in cuts]
    # A row without a time is older than any other. Plain comparisons, so they reach the Parquet reader.
    base = rows.where((at < times[0]) | at.isNull()) if times else rows
    store.apply(deltas(signed(None, records(base, "uuid", "created_at", fields)), names))
    for low, high in zip(times, [*times[1:], None]):
        up_to = rows if high is None else rows.where((at < high) | at.isNull())
        store.apply(deltas(images(up_to, "uuid", "created_at", fields, F.coalesce(at >= low, F.lit(False))), names))
    return store.read()
