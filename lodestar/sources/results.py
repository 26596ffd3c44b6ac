"""Configurations, saved results, the artifact layout and the vector cache."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_config(path: str) -> dict:
    return json.loads(Path(path).read_text(encoding="utf-8"))


def read_results(spark: SparkSession, *paths: str) -> DataFrame:
    """JSON documents that hold a list of rows or one row."""
    return spark.read.option("multiLine", True).json(list(paths))


def read_list(path: str) -> list[dict]:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, list):
        raise TypeError(f"{path} holds no list")
    return value


def read_object(path: str) -> dict:
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise TypeError(f"{path} holds no object")
    return value


def prediction_files(folder: str) -> list[str]:
    return sorted(str(p) for p in Path(folder).glob("*_predictions.json"))


def write_json(path: Path, value: object) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")


def _rows(df: DataFrame) -> list[dict]:
    return [{k: v for k, v in r.asDict(True).items() if v is not None} for r in df.toLocalIterator()]


def write_table(predictions: DataFrame, folder: str) -> None:
    """The system of record: Parquet, by seed, dataset and system."""
    predictions.write.mode("overwrite").partitionBy("seed", "dataset", "system").parquet(folder)


def export(predictions: DataFrame, summaries: DataFrame, aggregates: DataFrame, config: dict, folder: str) -> None:
    """The JSON layout: [seed_<s>/]<dataset>/<system>_{predictions,summary}.json, all_summaries.json and the top-level files.

    A seed folder is made only with more than one seed; null fields are left out."""
    out, rows = Path(folder), _rows(summaries)
    seeds = {r.get("seed") for r in rows}
    by: dict[tuple, list[dict]] = {}
    for r in rows:
        by.setdefault((r.get("seed"), r["dataset"]), []).append(r)
    for (seed, dataset), own in by.items():
        place = (out / f"seed_{seed}" if len(seeds) > 1 else out) / dataset
        write_json(place / "all_summaries.json", own)
        for r in own:
            write_json(place / f"{r['system']}_summary.json", r)
            some = predictions.where((F.col("dataset") == dataset) & (F.col("system") == r["system"]) & F.col("seed").eqNullSafe(F.lit(seed)))
            write_json(place / f"{r['system']}_predictions.json", _rows(some.orderBy("example_id")))
    write_json(out / "experiment_config.json", config)
    write_json(out / "all_results.json", rows)
    write_json(out / "aggregate_results.json", _rows(aggregates))


def digest_row(chunks: DataFrame, encoder: str) -> DataFrame:
    """One row with the digest of encoder and chunks; independent of the order of rows."""
    each = F.sha2(F.concat_ws("\x00", "chunk_id", "doc_id", "text"), 256)
    # sums of four 60-bit pieces: associative, so it is one partial aggregate
    pieces = [F.sum(F.conv(F.substring(each, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    return chunks.agg(F.sha2(F.concat_ws("|", F.lit(encoder), F.count("*").cast("string"), *pieces), 256).alias("digest"))


def chunk_digest(chunks: DataFrame, encoder: str) -> str:
    return digest_row(chunks, encoder).first()["digest"]


def cached_vectors(chunks: DataFrame, encoder: str, encode: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """(chunk_id, vector), read back if the same chunks were encoded by the same encoder before; a damaged entry counts as none."""
    spark = chunks.sparkSession
    place = f"{folder}/{re.sub('[^A-Za-z0-9._-]+', '_', encoder)}/{chunk_digest(chunks, encoder)}"
    try:
        return spark.read.parquet(place)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    encode(chunks).select("chunk_id", "vector").write.mode("overwrite").parquet(place)
    return spark.read.parquet(place)
