"""Command line: python -m demandloom COMMAND."""

from __future__ import annotations

import argparse
import json

from .artifacts import read_json
from .config import Protocol, Settings, load_settings
from .session import session
from .sources import files


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="demandloom")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *names: [sub.choices.get(name) or sub.add_parser(name), *[(sub.choices[name].add_argument(n, required=n != "--config")) for n in names]]
    add("validate-config", "--config")
    add("prepare", "--config", "--input", "--output")
    add("validate-data", "--path")
    for name in ("validate-evaluation", "freeze-evaluation", "run-baselines"):
        add(name, "--dataset", "--protocol", "--output")
    add("verify-baselines", "--dataset", "--protocol", "--reference", "--output")
    add("run-challengers", "--dataset", "--protocol", "--baselines", "--output")
    sub.choices["run-challengers"].add_argument("--rounds", type=int, default=200)
    sub.choices["run-challengers"].add_argument("--series-limit", type=int)
    add("serve", "--metadata", "--port")
    return top


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    settings = load_settings(a.config) if getattr(a, "config", None) else Settings()
    if a.command == "validate-config":
        print(json.dumps(settings.model_dump(mode="json"), indent=2))
        return 0
    if a.command == "serve":
        from .serve import server

        server(a.metadata, int(a.port)).serve_forever()
        return 0
    from .operators import suite, validate

    spark = session()
    if a.command == "prepare":
        told = suite.prepare(spark, a.input, a.output, settings)
    elif a.command == "validate-data":
        told = validate.validate_canonical(spark.read.parquet(a.path))
    else:
        demand, made = spark.read.parquet(f"{a.dataset}/demand"), spark.read.parquet(f"{a.dataset}/manifest")
        protocol = Protocol(**read_json(a.protocol))
        metadata = read_json(f"{a.dataset}/metadata.json")
        version = metadata["dataset_version"]
        if a.command == "validate-evaluation":
            pins = f"{a.output}/freeze.json" if a.output else None
            told = validate.protocol_checks(demand, made, protocol, version, metadata, read_json(pins) if pins and files.exists(pins) else None)
        elif a.command == "freeze-evaluation":
            told = suite.freeze(demand, made, protocol, version, a.output, metadata)
        elif a.command == "run-baselines":
            told = suite.run_baselines(demand, made, protocol, a.output)
        elif a.command == "verify-baselines":
            told = suite.verify_baselines(demand, made, protocol, a.reference, a.output)
        else:
            told = suite.run_challengers(demand, made, protocol, a.baselines, a.output, a.series_limit, rounds=a.rounds)
    print(json.dumps(told, indent=2, default=str))
    return int(told.get("status") == "failed")
