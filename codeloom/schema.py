"""Schemas of the stored tables. Timestamps are without time zone, JSON bags are strings."""

from __future__ import annotations

from pyspark.sql import types as T

HISTORY = T.ArrayType(
    T.StructType(
        [
            T.StructField("timestamp", T.TimestampNTZType()),
            T.StructField("action", T.StringType()),
            T.StructField("changes", T.StringType()),
        ]
    )
)

NODES = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("repo_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("start_line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("docstring", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("metadata", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("manual", T.BooleanType()),
        T.StructField("history", HISTORY),
    ]
)

EDGES = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("from_uuid", T.StringType()),
        T.StructField("to_uuid", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("properties", T.StringType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("manual", T.BooleanType()),
        T.StructField("history", HISTORY),
    ]
)

AUDIT = T.StructType(
    [
        T.StructField("uuid", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
        T.StructField("user", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("entity_uuid", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)

FILES = T.StructType(
    [
        T.StructField("repo_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("fetched_at", T.TimestampNTZType()),
    ]
)
