"""Experiment records: canonical JSON, fingerprints, staleness, freezes, comparison of plan and analysis, and typed content digests."""

from __future__ import annotations

import hashlib
import json
import math
import secrets
from copy import deepcopy
from dataclasses import dataclass, field, replace
from datetime import UTC, date, datetime
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.columns import row_digest

STAGES = ("match", "validation", "power", "delivery", "effect", "recommendation")
SCHEMA_VERSION = "2.0"
MAX_RECORD_BYTES = 5 << 20


def plain(v):
    """Values of a canonical document: sorted keys, ISO dates, names for numbers that JSON lacks."""
    if isinstance(v, Enum):
        return plain(v.value)
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in sorted(v.items(), key=lambda kv: str(kv[0]))}
    if isinstance(v, set | frozenset):
        return sorted((plain(x) for x in v), key=str)
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    if isinstance(v, datetime):
        return v.date().isoformat() if v.time() == datetime.min.time() and v.tzinfo is None else v.isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, float) and not math.isfinite(v):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    return v if v is None or isinstance(v, bool | int | float | str) else str(v)


def canonical_json(v) -> str:
    return json.dumps(plain(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def fingerprint(v) -> str:
    return hashlib.sha256(canonical_json(v).encode()).hexdigest()


def new_experiment_id(now: datetime | None = None) -> str:
    return f"EXP-{(now or datetime.now(UTC)):%Y%m%d}-{secrets.token_hex(2).upper()}"


@dataclass(frozen=True)
class Record:
    """What is known of one experiment; every change gives a new record."""

    experiment_id: str
    created: str
    schema_version: str = SCHEMA_VERSION
    stages: dict = field(default_factory=dict)
    stale: tuple[str, ...] = ()
    frozen: dict | None = None
    notes: tuple[str, ...] = ()

    def with_stage(self, stage: str, inputs: dict, result: dict) -> Record:
        """Record a stage's result; later stages that were done become stale."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        later = [s for s in STAGES[STAGES.index(stage) + 1 :] if s in self.stages]
        done = self.stages | {stage: {"input_fingerprint": fingerprint(inputs), "result": deepcopy(result)}}
        return replace(self, stages=done, stale=tuple(s for s in STAGES if s in {*self.stale, *later} - {stage}))

    def is_stale(self, stage: str, inputs: dict) -> bool:
        own = self.stages.get(stage)
        return own is not None and (stage in self.stale or own["input_fingerprint"] != fingerprint(inputs))

    def freeze(self, now: datetime | None = None) -> Record:
        """Keep the design as it is; a frozen design is never replaced."""
        if self.frozen:
            raise ValueError("the design is frozen already")
        if self.stale:
            raise ValueError(f"stale stages: {', '.join(self.stale)}")
        return replace(self, frozen={"at": (now or datetime.now(UTC)).isoformat(), "stages": deepcopy(self.stages), "fingerprint": fingerprint(self.stages)})

    def to_json(self) -> str:
        return canonical_json(self.__dict__)


def load_record(text: str) -> Record:
    if len(text.encode()) > MAX_RECORD_BYTES:
        raise ValueError("the record is too large")
    d = json.loads(text)
    if not str(d.get("schema_version", "")).startswith(("1.", "2.")):
        raise ValueError("unknown schema of an experiment record")
    return Record(d["experiment_id"], d.get("created", ""), d["schema_version"], d.get("stages") or {}, tuple(d.get("stale") or ()), d.get("frozen"), tuple(d.get("notes") or ()))


def planned_and_analysed(planned: dict, analysed: dict) -> list[tuple[str, object, object, str]]:
    """Field by field: same, changed, only planned or only analysed."""
    out = []
    for k in sorted({*planned, *analysed}):
        a, b = planned.get(k), analysed.get(k)
        state = "only_analysed" if k not in planned else "only_planned" if k not in analysed else "same" if canonical_json(a) == canonical_json(b) else "changed"
        out.append((k, a, b, state))
    return out


def content_digest(df: DataFrame) -> DataFrame:
    """One row: rows, and a digest of typed cells that no order of rows changes."""
    parts = [F.sum(F.conv(F.substring(row_digest(*df.columns), 1 + 12 * k, 12), 16, 10).cast("decimal(20,0)")).cast("string") for k in range(5)]
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("|", F.lit(",".join(f"{c}:{t}" for c, t in df.dtypes)), *parts), 256).alias("digest"))


def source_availability(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """By source: matched, changed, missing or new, from two tables of source and digest."""
    a, b = recorded.select("source", F.col("digest").alias("recorded")), current.select("source", F.col("digest").alias("current"))
    state = F.when(F.col("current").isNull(), "missing").when(F.col("recorded").isNull(), "new").when(F.col("recorded") == F.col("current"), "matched").otherwise("changed")
    return a.join(b, "source", "full").select("source", state.alias("state"))
