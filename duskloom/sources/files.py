"""Files in and out: transcripts, layered settings, ledgers, small state with backups."""

from __future__ import annotations

import json
import os
import tempfile
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.policy import merged

TRANSCRIPT = "struct<uuid:string,parentUuid:string,type:string,message:string>"
LEDGER = "ts string, project string, action string, entity_class string, channel string"


def read_transcript(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with their place in the file's partition order; blank lines are skipped, a wrong line is an error."""
    lines = spark.read.text(path).withColumn("idx", F.monotonically_increasing_id())
    return parsed_transcript(lines)


def parsed_transcript(lines: DataFrame) -> DataFrame:
    """(idx, value) -> idx, uuid, parent, type, message, raw."""
    rows = lines.filter(F.trim("value") != "").select("idx", F.from_json("value", TRANSCRIPT, {"mode": "FAILFAST"}).alias("r"), F.col("value").alias("raw"))
    return rows.select("idx", "r.uuid", F.col("r.parentUuid").alias("parent"), "r.type", "r.message", "raw")


def read_settings(*paths: str) -> dict:
    """TOML layers, later ones over earlier; a file that is absent is an empty layer."""
    return merged(*[tomllib.loads(Path(p).read_text(encoding="utf-8")) for p in paths if Path(p).exists()])


def append_ledger(events: DataFrame, path: str) -> None:
    """Append policy events as JSON lines. Only the ledger's five columns are written, never a value."""
    events.select(*[c.split(" ")[0] for c in LEDGER.split(", ")]).write.mode("append").json(path)


def ledger_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LEDGER).json(path)


def write_state(path: str, state: dict, backup: bool = False) -> None:
    """Small driver-side state, replaced in one step and readable by its owner alone; an old file may be kept as .bak, .bak.1, ..."""
    target = Path(path)
    if backup and target.exists():
        kept = [target.with_name(f"{target.name}.bak{f'.{i}' if i else ''}") for i in range(1000)]
        os.replace(target, next(k for k in kept if not k.exists()))
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as file:
        json.dump(state, file)
    os.chmod(file.name, 0o600)
    os.replace(file.name, target)


def read_state(path: str) -> tuple[str, dict]:
    """('absent', {}), ('loaded', state) or ('corrupt', {})."""
    try:
        return "loaded", json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        return "absent", {}
    except ValueError:
        return "corrupt", {}
