"""Files at the edges of a job: settings, checks of inputs and outputs, SRT sinks, options."""

from __future__ import annotations

import argparse
import os
import re
import uuid
from collections.abc import MutableMapping, Sequence
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelattice.plans.config import CHOICES, InvalidConfig
from cuelattice.sources.storage import allow_checkpoints


def load_yaml(text: str | None) -> dict[str, Any]:
    """A YAML mapping; an empty text is an empty one, anything else an error."""
    if text is None:
        raise InvalidConfig("no such file")
    try:
        data = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise InvalidConfig(f"invalid YAML: {e}") from e
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise InvalidConfig("the file must hold a mapping")
    return data


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file from any store that Spark reads; null if it is not there."""
    path_ = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not path_.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path_):
        return None
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


def load_dotenv(text: str, into: MutableMapping[str, str]) -> None:
    """KEY=VALUE lines into a mapping; what it already has stays."""
    for line in map(str.strip, text.splitlines()):
        key, found, value = line.removeprefix("export ").partition("=")
        key, value = key.strip(), value.strip()
        if line.startswith("#") or not found or not key or key in into:
            continue
        quoted = re.fullmatch(r"(['\"])(.*)\1", value, re.DOTALL)
        into[key] = quoted[2] if quoted else value


def file_gate(files: DataFrame, most: int) -> DataFrame:
    """Rows of Spark's binaryFile source, without content, with what speaks against each."""
    problem = F.when(F.col("length") <= 0, "empty").when(F.col("length") > most, "too large")
    return files.select("path", "length", "modificationTime", problem.alias("problem"))


def metadata_gate(videos: DataFrame, max_seconds: float | None = None) -> DataFrame:
    """videos(…, width, height, fps, n_frames) with seconds and what speaks against each."""
    bad = (F.col("width") <= 0) | (F.col("height") <= 0) | (F.col("fps") <= 0) | (F.col("n_frames") <= 0)
    out = videos.withColumn("seconds", F.try_divide(F.col("n_frames").cast("double"), F.col("fps")))
    problem = F.when(F.coalesce(bad, F.lit(True)), "no valid size, rate or length")
    if max_seconds is not None:
        problem = problem.when(F.col("seconds") > max_seconds, "too long")
    return out.withColumn("problem", problem)


def require(gated: DataFrame) -> DataFrame:
    """The rows of a gate, where the first with a problem is an error."""
    return gated.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem")).cast("string")))


def write_srt(srt: DataFrame, path: str, key: str) -> None:
    """One folder for each stream with its SRT text as UTF-8, what was there before overwritten."""
    srt.select(key, F.expr("substring(srt, 1, length(srt) - 1)").alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)


def write_ordered(rows: DataFrame, path: str, keys: list[str], order: str) -> None:
    """Parquet files whose rows, read file by file, are in order of keys and place, however they came."""
    rows.repartitionByRange(*keys, order).sortWithinPartitions(*keys, order).write.mode("overwrite").parquet(path)


def verify_output(spark: SparkSession, path: str) -> int:
    """Files with content under a path that was written; none is an error."""
    n = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0").count()
    if n == 0:
        raise FileNotFoundError(f"nothing was written to {path}")
    return n


def unique_output(name: str, taken: Sequence[str], suffix: str = "_translated") -> str:
    """The name with a suffix before its extension, and a number if that is taken."""
    stem, extension = os.path.splitext(name)
    out, n = f"{stem}{suffix}{extension}", 1
    while out in taken:
        out, n = f"{stem}{suffix}({n}){extension}", n + 1
    return out


def or_copy(result: DataFrame, source: DataFrame) -> DataFrame:
    """The result, or the source if the result has no rows; result is worked out once.

    The rows of the source are joined to the one row that counts those of the result, so
    that nothing is run before the whole is.
    """
    spark = result.sparkSession
    allow_checkpoints(spark)
    kept = result.checkpoint(eager=False)
    empty = kept.limit(1).groupBy().agg(F.count("*").alias("_n")).where("_n = 0")
    return kept.unionByName(source.join(F.broadcast(empty), how="left_semi"))


# The options of a job, where their values go in the settings, and what they may be.
OPTIONS: dict[str, tuple[str, type | tuple[str, ...]]] = {
    "input": ("input_path", str),
    "output": ("output_path", str),
    "compute-mode": ("compute_mode", ("cpu", "gpu")),
    "ocr-stride": ("performance.ocr_stride", int),
    "ocr-downscale": ("performance.ocr_downscale", float),
    "encoder": ("performance.encoder", ("auto", "cpu", "nvenc", "qsv", "amf")),
    "encoder-preset": ("performance.encoder_preset", ("ultrafast", "fast", "medium")),
    "pass2-mode": ("performance.pass2_mode", ("auto", "sequential", "parallel")),
    "parallel-workers": ("performance.parallel_workers", int),
    "confidence": ("detector.confidence_threshold", float),
    "batch-size": ("detector.batch_size", int),
    "model-variant": ("detector.model_variant", ("mobile", "server")),
    "cpu-threads": ("detector.cpu_threads", int),
    "translator": ("translator.backend", ("google", "llm")),
    "llm-model": ("translator.llm.model", str),
    "inpaint-algo": ("inpainter.algorithm", ("telea", "ns")),
    "inpaint-radius": ("inpainter.radius", int),
    "inpaint-padding": ("inpainter.padding", int),
    "font": ("renderer.font_path", str),
    "font-size-max": ("renderer.font_size_max", int),
    "font-size-min": ("renderer.font_size_min", int),
    "max-chars": ("translator.max_chars", int),
    "translate-timeout": ("translator.timeout_seconds", float),
    "n-inactive": ("tracker.n_inactive", int),
}


def parser() -> argparse.ArgumentParser:
    """Options of a job; an option that is not given stays None, so that it overrides nothing."""
    p = argparse.ArgumentParser(prog="cuelattice", description="Detections to subtitles, and parameter schedules, on Spark.")
    p.add_argument("-c", "--config", dest="config_path", default="configs/default.yaml")
    for name, (path, kind) in OPTIONS.items():
        flags = [f"-{name[0]}", f"--{name}"] if name in ("input", "output") else [f"--{name}"]
        p.add_argument(*flags, dest=path, **({"choices": kind, "type": str.lower} if isinstance(kind, tuple) else {"type": kind}))
    for flags in (["-v", "--verbose"], ["--quiet"], ["--perturb"]):
        p.add_argument(*flags, action="store_true")
    p.add_argument("--perturb-preset", choices=CHOICES["preset"])
    p.add_argument("--perturb-config")
    return p


def sparse_overrides(args: argparse.Namespace) -> dict[str, Any]:
    """The options that were given, nested as settings are; a model name also selects its backend."""
    out: dict[str, Any] = {}
    given = {path: getattr(args, path) for path, _ in OPTIONS.values() if getattr(args, path) is not None}
    if "translator.llm.model" in given:
        given |= {"translator.llm.enabled": True, "translator.backend": "llm"}
    for path, value in given.items():
        *sections, key = path.split(".")
        at = out
        for section in sections:
            at = at.setdefault(section, {})
        at[key] = value
    return out


def path_gate(spark: SparkSession, input_path: str, output_path: str) -> list[str]:
    """What speaks against a job's paths, in any store that Spark reads: none if the list is empty.

    The input must be there and readable; the folder of the output must be there, be a
    folder and take a file.
    """
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    problems = []
    source, folder = hadoop.Path(input_path), hadoop.Path(output_path).getParent()
    store = source.getFileSystem(conf)
    if not store.exists(source):
        problems.append("input is missing")
    else:
        try:
            store.open(source).close() if store.getFileStatus(source).isFile() else store.listStatus(source)
        except Exception:  # noqa: BLE001  whatever the store raises, it cannot be read
            problems.append("input is not readable")
    store = folder.getFileSystem(conf)
    if not store.exists(folder) or not store.getFileStatus(folder).isDirectory():
        return [*problems, "output folder is missing"]
    probe = hadoop.Path(folder, f".probe-{uuid.uuid4().hex}")
    try:
        store.create(probe).close()
        store.delete(probe, False)
    except Exception:  # noqa: BLE001
        problems.append("output folder is not writable")
    return problems
