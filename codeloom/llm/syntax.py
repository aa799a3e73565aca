"""Source files that don't parse, per file and as rates per repository and language.

The lexers with a pushdown stack (codeloom.llm.lexing) judge a file by the language its ending, in any case, promises.
Null contents count as empty files; files with other endings are never flagged; a file that came twice counts once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import lexing
from codeloom.session import spread

_ENDING = r"(?i)\.(?:" + "|".join(e[1:] for e in lexing.ENDINGS) + ")$"


def verdict(path: str | None, text: str | None) -> str | None:
    """What is wrong with the file at path, or None."""
    language = lexing.ENDINGS.get("." + (path or "").rpartition(".")[2].lower())
    return lexing.problem(language, text) if language else None


def checked(files: DataFrame) -> DataFrame:
    """(repo_id, file_path, language, problem) of the files that promise one of the languages; problem null: valid."""
    rows = files.select("repo_id", "file_path", "content").where(F.col("file_path").rlike(_ENDING))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("file_path").to_pylist()
            found = [verdict(p, t) for p, t in zip(paths, batch.column("content").to_pylist())]
            languages = [lexing.ENDINGS["." + p.rpartition(".")[2].lower()] for p in paths]
            yield pa.RecordBatch.from_arrays(
                [batch.column("repo_id"), batch.column("file_path"), pa.array(languages, pa.string()), pa.array(found, pa.string())],
                names=["repo_id", "file_path", "language", "problem"],
            )

    return spread(rows).mapInArrow(run, "repo_id string, file_path string, language string, problem string")


def unparsable(files: DataFrame) -> DataFrame:
    return checked(files).where("problem is not null")


def syntax_rates(files: DataFrame) -> DataFrame:
    """(repo_id, language, files, unparsable, rate), each file once."""
    once = checked(files).groupBy("repo_id", "file_path", "language").agg(F.max("problem").alias("problem"))
    rates = once.groupBy("repo_id", "language").agg(F.count(F.lit(1)).alias("files"), F.count("problem").alias("unparsable"))
    return rates.withColumn("rate", F.col("unparsable") / F.col("files"))
