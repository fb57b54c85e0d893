"""Options of a profiling run: defaults, YAML files, command-line values, checks."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    """An option, a path or a file that a run can't use."""


@dataclass
class Sampling:
    object_json_limit_bytes: int = 16 * 1024
    canonical_priority_limit: int = 1
    site_priority_limit: int = 1
    field_set_priority_limit: int = 2
    type_set_priority_limit: int = 4
    value_json_limit_bytes: int = 1024
    parent_object_json_limit_bytes: int = 1024
    value_priority_limit_per_field_profile: int = 4
    heavy_hitter_context_sample_limit: int = 0


@dataclass
class ValueProfile:
    value_text_limit_bytes: int = 512
    exact_distinct_threshold: int = 4096
    exact_value_bytes_per_field_profile: int = 1024 * 1024
    global_exact_value_bytes_budget: int = 256 * 1024 * 1024  # checked, otherwise without effect
    hll_precision: int = 14
    heavy_hitter_limit: int = 128


@dataclass
class Flush:
    """Accepted and checked; Spark plans its own memory, so these change nothing."""

    chunk_object_sample_rows: int = 10_000
    chunk_value_sample_rows: int = 10_000
    chunk_shape_rows: int = 10_000
    chunk_field_rows: int = 25_000


@dataclass
class ProfileConfig:
    input_file: str = ""
    refs: str = "refs/schemas.sqlite"
    out: str = "profile.sqlite"
    input_format: str = "auto"
    quiet: bool = False
    perf_log: bool = False
    perf_log_file: str | None = None
    perf_log_dbstat: bool = False
    sampling: Sampling = field(default_factory=Sampling)
    value_profile: ValueProfile = field(default_factory=ValueProfile)
    flush: Flush = field(default_factory=Flush)
    #: ``native``: VARIANT, in the JVM; ``strict``: exact number texts and errors, in Arrow batches.
    scanner: str = "strict"
    #: ``exact``: the true most frequent values; ``sequential``: Space-Saving in document order.
    heavy_hitters: str = "sequential"

    def validate(self) -> None:
        """Raise ConfigError for the first option that can't be used."""
        v, s, f = self.value_profile, self.sampling, self.flush
        if not 4 <= v.hll_precision <= 18:
            raise ConfigError("invalid config: hll_precision must be between 4 and 18")
        if v.heavy_hitter_limit <= 0:
            raise ConfigError("invalid config: heavy_hitter_limit must be > 0")
        if v.exact_distinct_threshold <= v.heavy_hitter_limit:
            raise ConfigError("invalid config: exact_distinct_threshold should be greater than heavy_hitter_limit")
        for value, label in (
            (s.type_set_priority_limit, "sampling.object.type_set.priority_sample_limit"),
            (s.value_priority_limit_per_field_profile, "sampling.value.priority_sample_limit_per_field_profile"),
            (s.object_json_limit_bytes, "object sample JSON limit"),
            (s.value_json_limit_bytes, "value sample JSON limit"),
            (s.parent_object_json_limit_bytes, "parent object sample JSON limit"),
            (v.value_text_limit_bytes, "value_profile.value_text_limit_bytes"),
            (v.exact_value_bytes_per_field_profile, "value_profile.exact_value_bytes_per_field_profile"),
            (v.global_exact_value_bytes_budget, "value_profile.global_exact_value_bytes_budget"),
            (f.chunk_object_sample_rows, "flush.chunk_object_sample_rows"),
            (f.chunk_value_sample_rows, "flush.chunk_value_sample_rows"),
            (f.chunk_shape_rows, "flush.chunk_shape_rows"),
            (f.chunk_field_rows, "flush.chunk_field_rows"),
        ):
            if value <= 0:
                raise ConfigError(f"invalid config: {label} must be > 0")
        if self.scanner not in ("native", "strict") or self.heavy_hitters not in ("exact", "sequential"):
            raise ConfigError("invalid config: unknown scanner or heavy_hitters mode")

    def validate_paths(self) -> None:
        """For a run over local files: the input and the references must exist."""
        if self.input_file == "-":
            raise ConfigError("stdin is not supported; pass a JSON or JSONL file path")
        if "://" not in self.input_file and not Path(self.input_file).is_file():
            raise ConfigError(f"input path is not a file: {self.input_file}")
        if not Path(self.refs).is_file():
            raise ConfigError(f"refs sqlite path is not a file: {self.refs}")


#: YAML section and key to the option it sets; a dict is a nested section, None a key without effect.
YAML_KEYS: dict[str, Any] = {
    "input": {"file": None, "format": ("input_format",)},
    "refs": {"sqlite": ("refs",)},
    "output": {"sqlite": ("out",)},
    "stdout": {"quiet": ("quiet",)},
    "perf": {"log": ("perf_log",), "file": ("perf_log_file",), "dbstat": ("perf_log_dbstat",)},
    "sampling": {
        "object": {
            "sample_json_limit_bytes": ("sampling", "object_json_limit_bytes"),
            "chunk_flush_rows": ("flush", "chunk_object_sample_rows"),
            **{
                scope: {"first_seen": None, "first_non_empty": None, "priority_sample_limit": ("sampling", option)}
                for scope, option in (
                    ("canonical_path", "canonical_priority_limit"),
                    ("site_path", "site_priority_limit"),
                    ("field_set", "field_set_priority_limit"),
                    ("type_set", "type_set_priority_limit"),
                )
            },
        },
        "value": {
            "value_json_limit_bytes": ("sampling", "value_json_limit_bytes"),
            "parent_object_json_limit_bytes": ("sampling", "parent_object_json_limit_bytes"),
            "chunk_flush_rows": ("flush", "chunk_value_sample_rows"),
            "first_seen": None,
            "first_non_empty": None,
            "priority_sample_limit_per_field_profile": ("sampling", "value_priority_limit_per_field_profile"),
            "heavy_hitter_context_sample_limit": ("sampling", "heavy_hitter_context_sample_limit"),
        },
    },
    "value_profile": {f.name: ("value_profile", f.name) for f in fields(ValueProfile)},
    "flush": {f.name: ("flush", f.name) for f in fields(Flush)},
    "engine": {"scanner": ("scanner",), "heavy_hitters": ("heavy_hitters",)},
}


def _set(config: ProfileConfig, path: tuple[str, ...], value: Any) -> None:
    *owners, name = path
    owner: Any = config
    for o in owners:
        owner = getattr(owner, o)
    old = getattr(owner, name)
    want = bool if isinstance(old, bool) else int if isinstance(old, int) else str
    if not isinstance(value, want) or want is int and (isinstance(value, bool) or value < 0):
        raise ConfigError(f"invalid config: {'.'.join(path)} can't be {value!r}")
    setattr(owner, name, value)


def _apply(config: ProfileConfig, found: Any, known: dict[str, Any], at: str) -> None:
    if found is None:
        return
    if not isinstance(found, dict):
        raise ConfigError(f"failed to parse config: {at or 'file'} is not a mapping")
    for key, value in found.items():
        if key not in known:
            raise ConfigError(f"failed to parse config: unknown field {at}{key}")
        what = known[key]
        if isinstance(what, dict):
            _apply(config, value, what, f"{at}{key}.")
        elif what is not None and value is not None:
            _set(config, what, value)


def load_yaml(config: ProfileConfig, path: str) -> ProfileConfig:
    """``config`` with what a YAML file sets; unknown keys fail."""
    import yaml

    config = copy(config)
    try:
        text = Path(path).read_text()
    except OSError as e:
        raise ConfigError(f"failed to read config {path}: {e}") from e
    try:
        found = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"failed to parse config {path}: {e}") from e
    _apply(config, found, YAML_KEYS, "")
    if config.perf_log_file:
        config.perf_log = True
    config.input_format = config.input_format.lower()
    if config.input_format not in ("auto", "json", "jsonl"):
        raise ConfigError(f"invalid config: unsupported input.format: {config.input_format}")
    return config


def copy(config: ProfileConfig) -> ProfileConfig:
    return replace(config, **{f.name: replace(v) for f in fields(config) if is_dataclass(v := getattr(config, f.name))})
