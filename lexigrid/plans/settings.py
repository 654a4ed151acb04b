"""Layered settings with provenance, and job files."""

from __future__ import annotations

import json
import os
import re
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.files import DEFAULT_EXCLUDES

# Strings that switch a boolean off, and keys of older job files.
FALSE_STRINGS = ("0", "false", "no", "off", "")
RETIRED_KEYS = ("url", "api_key", "embed_model", "ca_bundle", "verify_ssl", "timeout", "embed_batch", "workspace")
#: Folder and file of settings in a working directory.
FOLDER, FILE = ".lexigrid", "config.json"
#: Order of layers, nearest first; folders' files come between, by distance.
LAYERS = {"flag": 0, "env": 1, "default": 1 << 20}


@dataclass(frozen=True)
class Setting:
    """A value with its environment variable, kind and default."""

    name: str
    env: str
    kind: str = "str"
    default: str | bool | int = ""
    secret: bool = False

    def holds(self, value: object) -> bool:
        """Whether a file's value is one: of the kind, and no empty text."""
        return {"bool": isinstance(value, bool), "int": isinstance(value, int) and not isinstance(value, bool)}.get(self.kind, isinstance(value, str) and value != "")

    def read(self, raw: str) -> str | bool | int:
        """The value of an environment variable's text."""
        if self.kind == "bool":
            return raw.strip().lower() not in FALSE_STRINGS
        if self.kind == "int":
            if not re.fullmatch(r"\s*[+-]?[0-9]+\s*", raw):
                raise ValueError(f"${self.env} must be a whole number, not {raw!r}")
            return int(raw)
        return raw


# The settings, their variables and defaults.
SETTINGS = (
    Setting("url", "LLM_API_URL"), Setting("api_key", "LLM_API_KEY", secret=True), Setting("model", "LLM_MODEL", default="gpt-4o-mini"),
    Setting("embed_model", "LLM_EMBED_MODEL", default="text-embedding-3-small"), Setting("ca_bundle", "LLM_CA_BUNDLE"),
    Setting("verify_ssl", "LLM_VERIFY_SSL", "bool", True), Setting("timeout", "LLM_TIMEOUT", "int", 300),
    Setting("embed_batch", "LLM_EMBED_BATCH", "int", 64), Setting("dupcheck_max_memory_mb", "LLM_DUPCHECK_MAX_MEMORY_MB", "int", 2048),
    Setting("system_prompt", "LLM_SYSTEM_PROMPT"),
)


def folders_above(start: str, inherit: bool = True) -> list[Path]:
    """Settings files at or above a folder, nearest first; the nearest only without
    ``inherit``."""
    here = Path(start).resolve()
    found = [f for d in (here, *here.parents) if (f := d / FOLDER / FILE).is_file()]
    return found if inherit else found[:1]


def layers(start: str, flags: dict | None = None, inherit: bool = True) -> list[tuple[str, int, object, str]]:
    """``(key, rank, value, source)`` of every layer that gives a setting a value."""
    rows: list[tuple[str, int, object, str]] = []
    for s in SETTINGS:
        if (flags or {}).get(s.name) is not None:
            rows.append((s.name, LAYERS["flag"], flags[s.name], "--flag"))
        if os.environ.get(s.env):
            rows.append((s.name, LAYERS["env"], s.read(os.environ[s.env]), f"${s.env}"))
        rows.append((s.name, LAYERS["default"], s.default, "default"))
    for k, file in enumerate(folders_above(start, inherit)):
        held = json.loads(file.read_text())
        rows += [(s.name, LAYERS["env"] + 1 + k, held[s.name], str(file)) for s in SETTINGS if s.name in held and s.holds(held[s.name])]
    return rows


def effective(start: str, flags: dict | None = None, inherit: bool = True) -> dict[str, tuple[object, str]]:
    """Value and source of each setting: :func:`resolve` for one folder."""
    best: dict[str, tuple[int, object, str]] = {}
    for key, rank, value, source in layers(start, flags, inherit):
        if key not in best or rank < best[key][0]:
            best[key] = (rank, value, source)
    return {k: v[1:] for k, v in best.items()}


def described(values: dict[str, tuple[object, str]], here: str) -> list[str]:
    """A line for each setting: value, or whether it is set, and its origin."""
    lines = []
    own = str(Path(here).resolve() / FOLDER / FILE)
    for s in SETTINGS:
        value, source = values[s.name]
        text = ("set" if value else "(unset)") if s.secret else str(value).lower() if s.kind == "bool" else str(value) if value != "" else "(unset)"
        where = {"default": "(default)", "--flag": "(this command)", own: "(here)"}.get(source)
        where = where or (f"({source})" if source.startswith("$") else f"(inherited from {Path(source).parent.parent})")
        lines.append(f"{s.name:24}{text}  {where}")
    return lines


def resolve(layers: DataFrame) -> DataFrame:
    """``key, value, source`` of ``layers(key, rank, value, source)``.

    The value of the least rank wins; empty values are no values.
    """
    real = layers.where(F.col("value").isNotNull() & (F.col("value") != ""))
    return real.groupBy("key").agg(F.min_by("value", "rank").alias("value"), F.min_by("source", "rank").alias("source"))


def config_chain(folders: DataFrame, start: str, inherit: bool = True) -> DataFrame:
    """``folder, distance`` of the folders at or above ``start`` that have a file."""
    depth = F.size(F.split("folder", "/"))
    above = folders.where((F.lit(start) == F.col("folder")) | F.lit(start).startswith(F.concat("folder", F.lit("/"))) | (F.col("folder") == "/"))
    chain = above.select("folder", (F.lit(len(start.split("/"))) - depth).alias("distance")).orderBy("distance")
    return chain if inherit else chain.limit(1)


def parse_bool(raw: Column) -> Column:
    return ~F.lower(F.trim(raw)).isin(*FALSE_STRINGS)


def parse_int(raw: Column) -> Column:
    """Null where the text is no whole number."""
    return F.when(F.trim(raw).rlike("^[+-]?[0-9]+$"), F.trim(raw).try_cast("int"))


def shown(value: Column, kind: Column, secret: Column) -> Column:
    """A setting as it is displayed; secrets never are."""
    empty = value.isNull() | (value == "")
    return (
        F.when(secret, F.when(empty, "(unset)").otherwise("set"))
        .when((kind == "str") & empty, "(unset)")
        .when(kind == "bool", F.when(parse_bool(value), "true").otherwise("false"))
        .otherwise(value)
    )


def origin(source: Column, here: str) -> Column:
    """Label of where a value comes from."""
    folder = F.regexp_replace(source, "/[^/]*$", "")
    return (
        F.when(source.isNull(), "").when(source == "default", "(default)").when(source == "--flag", "(this command)")
        .when(source.startswith("$"), F.concat(F.lit("("), source, F.lit(")"))).when(folder == here, "(here)")
        .otherwise(F.concat(F.lit("(inherited from "), F.regexp_replace(folder, "/[^/]*$", ""), F.lit(")")))
    )


def require(values: dict[str, str | None], *names: str) -> None:
    """Stop with a message if a setting that a command needs has no value."""
    missing = [n for n in names if not values.get(n)]
    if missing:
        raise ValueError("not set: " + ", ".join(missing))


def key_diff(jobs: DataFrame, known: list[str]) -> DataFrame:
    """``job_id, unknown, retired`` keys of ``jobs(job_id, json)``."""
    keys = F.json_object_keys("json")
    return jobs.select(
        "job_id",
        F.array_sort(F.array_except(keys, F.array(*map(F.lit, (*known, *RETIRED_KEYS))))).alias("unknown"),
        F.array_sort(F.array_intersect(keys, F.array(*map(F.lit, RETIRED_KEYS)))).alias("retired"),
    )


def merge_write(path: str, values: dict) -> dict:
    """Write settings that are not empty into a file that keeps its others."""
    file = Path(path)
    held = json.loads(file.read_text()) if file.exists() else {}
    held.update({k: v for k, v in values.items() if v not in (None, "")})
    file.parent.mkdir(parents=True, exist_ok=True)
    file.write_text(json.dumps(held, indent=2))
    return held


@dataclass
class Job:
    """A duplicate check's parameters."""

    include: list[str] = field(default_factory=list)
    extensions: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=lambda: list(DEFAULT_EXCLUDES))
    min_lines: int = 4
    window_lines: int = 40
    window_overlap: int = 8
    threshold: float = 0.9
    min_structure: float = 0.5
    filter_callers: bool = True
    idf_weighting: bool = True
    min_distinct: float = 0.10
    report: str = "pairwise"
    top_n: int | None = None
    cache: bool = True
    cache_file: str | None = None
    output: str = "text"
    output_file: str | None = None

    @classmethod
    def load(cls, path: str) -> tuple[Job, list[str]]:
        """The job of a file, and what to say about keys that it drops."""
        given = json.loads(Path(path).read_text())
        known = {f.name for f in fields(cls)}
        notes = [f"{k} is no longer a job field" for k in given if k in RETIRED_KEYS]
        notes += [f"unknown job field {k}" for k in given if k not in known and k not in RETIRED_KEYS]
        job = cls(**{k: v for k, v in given.items() if k in known})
        job.check_kinds()
        return job, notes

    @classmethod
    def update(cls, path: str) -> Job:
        """Rewrite a file with missing fields added and retired ones dropped."""
        job, _ = cls.load(path)
        Path(path).write_text(json.dumps(asdict(job), indent=2))
        return job

    @classmethod
    def scaffold(cls, path: str, include: list[str] | None = None, extensions: list[str] | None = None, force: bool = False) -> Job:
        """Write a new job file with every field; an existing one stays unless forced."""
        if Path(path).exists() and not force:
            raise FileExistsError(path)
        job = cls(include=include or [], extensions=extensions or [])
        Path(path).write_text(json.dumps(asdict(job), indent=2))
        return job

    def overridden(self, **flags) -> Job:
        """With flags that are set; ``no_...`` flags only switch off."""
        values = asdict(self)
        for k, v in flags.items():
            if k.startswith("no_"):
                values[k[3:]] = values[k[3:]] and not v
            elif v is not None:
                values[k] = v
        return Job(**values)

    def check_kinds(self) -> None:
        """Stop at a value of another kind than the field's."""
        number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
        for f in fields(self):
            value, kind = getattr(self, f.name), str(f.type)
            fits = {
                "list[str]": isinstance(value, list) and all(isinstance(x, str) for x in value), "bool": isinstance(value, bool),
                "int": number(value) and isinstance(value, int), "float": number(value), "str": isinstance(value, str),
                "int | None": value is None or number(value) and isinstance(value, int), "str | None": value is None or isinstance(value, str),
            }
            if not fits[kind]:
                raise ValueError(f"job field {f.name} is no {kind}: {value!r}")

    def check(self) -> None:
        if not self.include or not self.extensions:
            raise ValueError("a job names what to include and the extensions")
        if self.report not in ("pairwise", "clusters") or self.output not in ("text", "json", "markdown"):
            raise ValueError("unknown report or output")
