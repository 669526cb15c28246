"""Command line: ``python -m strandline.cli --tar-dir ... --neg-dir ...``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import fields

from pyspark.sql import SparkSession

from strandline import __version__
from strandline.config import Config

# Options that switch something off, and the setting each one switches.
_OFF = {"no-mash": "run_mash", "no-blast": "run_blast", "no-gzip": "gzip"}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("strandline", description="Find sequences that targets share and others lack.")
    p.add_argument("--version", action="version", version=__version__)
    for f in fields(Config):
        if f.name in ("run_mash", "run_blast", "gzip"):
            continue
        kind, name = str(f.type), "--" + f.name.replace("_", "-")
        if kind == "bool":
            p.add_argument(name, action="store_true", default=None)
        elif "list" in kind:
            p.add_argument(name, action="append", default=None)
        else:
            p.add_argument(name, type=float if "float" in kind else int if "int" in kind else str, default=None)
    for option, name in _OFF.items():
        p.add_argument("--" + option, dest=name, action="store_false", default=None)
    return p


def config_of(argv: list[str]) -> Config:
    given = vars(parser().parse_args(argv))
    return Config(**{k: v for k, v in given.items() if v is not None})


def main(argv: list[str] | None = None) -> int:
    from strandline.api import run

    config = config_of(sys.argv[1:] if argv is None else argv)
    build = SparkSession.builder
    if SparkSession.getActiveSession() is None and not any(v in os.environ for v in ("MASTER", "SPARK_REMOTE", "PYSPARK_SUBMIT_ARGS", "PYSPARK_GATEWAY_PORT")):
        build = build.master(f"local[{config.n_cpu}]")  # not started by spark-submit: threads of this machine
    run(build.getOrCreate(), config)
    return 0


if __name__ == "__main__":
    sys.exit(main())
