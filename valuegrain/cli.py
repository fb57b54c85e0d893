"""Command line: profile a file, or diagnose a profile.

    python -m valuegrain.cli data.jsonl --refs refs/schemas.sqlite -o profile.sqlite
    python -m valuegrain.cli --diagnose profile.sqlite
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import SparkSession

from .config import ConfigError, ProfileConfig, load_yaml
from .perf import PerfLog
from .plans.diagnose import Limits, diagnose
from .plans.profile import profile
from .sources.sinks import ORDER, folder_catalog, folder_sizes, read_parquet, read_sqlite, sqlite_catalog, sqlite_sizes, write_parquet, write_sqlite

TOTALS = ("document", "object", "array", "scalar", "canonical_path", "site_path", "shape", "field_profile", "stored_value")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="valuegrain", description="Profile the values of a JSON or JSONL file.")
    p.add_argument("input_file", help="JSON or JSONL file, or with --diagnose a profile")
    p.add_argument("--refs", help="structural references (SQLite file)")
    p.add_argument("-o", "--out", help="profile to write: *.sqlite, or a folder for Parquet")
    p.add_argument("--jsonl", action="store_true", help="read as JSONL whatever the name")
    p.add_argument("--config", help="YAML file")
    for name in ("shape-sample-limit", "value-sample-limit", "heavy-hitter-limit", "hll-precision", "value-text-limit"):
        p.add_argument(f"--{name}", type=int)
    p.add_argument("--quiet", action="store_true")
    p.add_argument("--perf-log", action="store_true")
    p.add_argument("--perf-log-file")
    p.add_argument("--perf-log-dbstat", action="store_true")
    p.add_argument("--scanner", choices=("strict", "native"))
    p.add_argument("--heavy-hitters", choices=("sequential", "exact"))
    p.add_argument("--diagnose", action="store_true")
    p.add_argument("--fail-on-risk", action="store_true")
    for name in ("top", "hh-context-limit", "canonical-limit", "site-limit", "field-set-limit", "type-set-limit"):
        p.add_argument(f"--{name}", type=int, help="with --diagnose")
    return p


def config_of(args: argparse.Namespace) -> ProfileConfig:
    """Command line over YAML over defaults."""
    config = load_yaml(ProfileConfig(), args.config) if args.config else ProfileConfig()
    config.input_file = args.input_file
    for name in ("refs", "out", "perf_log_file", "scanner", "heavy_hitters"):
        if getattr(args, name):
            setattr(config, name, getattr(args, name))
    config.input_format = "jsonl" if args.jsonl else config.input_format
    for option, owner, name in (
        ("shape_sample_limit", config.sampling, "type_set_priority_limit"),
        ("value_sample_limit", config.sampling, "value_priority_limit_per_field_profile"),
        ("heavy_hitter_limit", config.value_profile, "heavy_hitter_limit"),
        ("hll_precision", config.value_profile, "hll_precision"),
        ("value_text_limit", config.value_profile, "value_text_limit_bytes"),
    ):
        if getattr(args, option) is not None:
            setattr(owner, name, getattr(args, option))
    config.quiet |= args.quiet
    config.perf_log |= args.perf_log or bool(config.perf_log_file)
    config.perf_log_dbstat |= args.perf_log_dbstat
    return config


def limits_of(args: argparse.Namespace) -> Limits:
    """What a profile may hold at most, and how many rows reports show."""
    given = lambda value, default: default if value is None else value
    limits = Limits()
    scopes = {"canonical_path": args.canonical_limit, "site_path": args.site_limit, "field_set": args.field_set_limit, "type_set": args.type_set_limit}
    return Limits(
        given(args.heavy_hitter_limit, limits.heavy_hitter),
        given(args.hh_context_limit, limits.context),
        given(args.value_sample_limit, limits.value),
        {k: given(v, limits.scopes[k]) for k, v in scopes.items()},
        given(args.top, limits.top),
    )


def run_diagnosis(args: argparse.Namespace, spark: SparkSession) -> int:
    path = args.input_file
    if path.endswith((".sqlite", ".db", ".sqlite3")):
        tables, catalog, sizes = read_sqlite(spark, path), sqlite_catalog(path), sqlite_sizes(path)
    else:
        catalog = folder_catalog(spark, path)
        tables, sizes = read_parquet(spark, path, [t for t in ORDER if ("table", t) in catalog]), folder_sizes(spark, path)
    found = diagnose(tables, limits_of(args), catalog)
    print("== sizes")
    for name, size in sizes:
        print(f"{name} {size}")
    for name, report in found.reports.items():
        print(f"== {name}")
        report.show(50, truncate=80)
    for risk in found.risks:
        print(f"RISK {risk}")
    print(f"risk_count={len(found.risks)}\nstatus={found.status}")
    return 2 if args.fail_on_risk and found.risks else 0


def summary_text(out: str, totals: dict[str, int], elapsed: float) -> str:
    lines = [f"valuegrain: wrote {out}", ""] + [f"{n}s: {totals[f'total_{n}_count']}" for n in TOTALS] + [f"elapsed: {elapsed:.3f}s"]
    return "\n".join(lines) + "\n"


def run(config: ProfileConfig, spark: SparkSession) -> tuple[str, list[tuple[str, str]]]:
    """Profile, write, and return the summary text and the warnings."""
    began = time.time()
    config.validate_paths()
    config.validate()
    perf = PerfLog(config.perf_log, config.perf_log_file)
    result = profile(spark, config.input_file, config, config.refs, perf)
    elapsed = time.time() - began
    with perf.phase("sqlite.flush"):
        (write_sqlite if config.out.endswith((".sqlite", ".db", ".sqlite3")) else write_parquet)(result.tables, config.out)
    if config.perf_log_dbstat and config.out.endswith(".sqlite"):
        for name, size in sqlite_sizes(config.out):
            perf.event("sqlite.dbstat", name=name, bytes=size)
    totals = result["prof_source_summary"].first().asDict()
    perf.record("total", time.time() - began)
    perf.write_buckets()
    return summary_text(config.out, totals, elapsed), result.warnings


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        spark = spark or SparkSession.builder.appName("valuegrain").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        if args.diagnose:
            return run_diagnosis(args, spark)
        config = config_of(args)
        text, warnings = run(config, spark)
        for code, message in warnings:
            print(f"WARNING {code} {message}", file=sys.stderr)
        if not config.quiet:
            sys.stdout.write(text)
        return 0
    except (ConfigError, ValueError, OSError) as e:
        print(f"ERROR {e}", file=sys.stderr)
        return 1
    except Exception as e:  # Spark wraps what its tasks raise
        text = str(e)
        at = text.find("json parse error")
        print(f"ERROR {text[at:].splitlines()[0] if at >= 0 else text}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
