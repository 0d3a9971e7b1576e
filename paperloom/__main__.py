"""The command line: python -m paperloom COMMAND. Each command is a method of Review; sources are services, or local tables."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators.screening import STAGES
from paperloom.plans import fetch
from paperloom.plans.review import Review
from paperloom.sources import records, services
from paperloom.sources.http import Client

ROOT, ACCOUNT = "reviews", "PAPERLOOM_SHEET_ACCOUNT"

#: What options may say; a name alone is a position.
OPTIONS: dict[str, dict] = {
    "topic": {}, "items": {"nargs": "+"}, "id": {}, "assignments": {"nargs": "+", "metavar": "field=value"},
    "--root": {"default": ROOT, "help": "where reviews lie"}, "--name": {"help": "the folder's name in place of one from the topic"}, "--review": {"help": "the review's folder; the one that changed last if not given"},
    "--query": {"action": "append", "help": "instead of the configured ones; may be repeated"}, "--limit": {"type": int, "help": "papers of a query, or rows"}, "--sources": {"help": "names, comma-separated"},
    "--corpus": {"action": "append", "metavar": "name=path", "help": "a local table of records (Parquet or JSON lines) in place of services; may be repeated"}, "--edges": {"metavar": "path", "help": "a local table parent_id, child_id, pos"},
    "--round": {"type": int}, "--from": {"dest": "start", "choices": ["all", "included"]}, "--direction": {"choices": ["backward", "forward", "both"]}, "--backend": {"choices": ["auto", "openalex", "semantic_scholar"]}, "--max-references": {"type": int}, "--max-citations": {"type": int}, "--max-frontier": {"type": int, "default": 300},
    "--force": {"action": "store_true"}, "--all": {"action": "store_true", "help": "what was done before as well"}, "--stage": {"choices": STAGES, "required": True}, "--size": {"type": int},
    "--where": {"action": "append", "metavar": "field=value"}, "--fields": {"help": "comma-separated"}, "--sort": {}, "--out": {}, "--spreadsheet-id": {"required": True}, "--sheet-id": {"type": int, "default": 0}, "--account": {"default": os.environ.get(ACCOUNT)},
    "--cache": {"help": "a folder for answers of services; below the review if not given"}, "--no-cache": {"action": "store_true"},
}
_FETCH = ("--corpus", "--cache", "--no-cache")
#: Each command's options and what it does.
COMMANDS: dict[str, tuple[tuple[str, ...], str]] = {
    "init": (("topic", "--root", "--name"), "make a review's folder with a configuration to edit"),
    "doctor": ((), "check modules, services and keys"),
    "seed": (("--query", "--limit", *_FETCH), "first queries, and papers known before"),
    "search": (("--query", "--sources", "--limit", *_FETCH), "boolean queries in databases"),
    "snowball": (("--round", "--from", "--direction", "--backend", "--max-references", "--max-citations", "--max-frontier", "--force", "--edges", *_FETCH), "one round along citations"),
    "complete": (("--all", *_FETCH), "fill missing abstracts and citation counts"),
    "filter": ((), "apply the filters of the configuration"),
    "batches": (("--stage", "--size", "--force"), "write batches for judges"),
    "apply": (("--stage", "--all"), "take over judges' results"),
    "show": (("--where", "--fields", "--sort", "--limit"), "list papers"),
    "add": (("items", *_FETCH), "add papers by DOI, arXiv id or title"),
    "set": (("id", "assignments"), "set fields of a paper by hand"),
    "status": ((), "counts, and what to do next"),
    "export": (("--out",), "write the workbook"),
    "sheet-plan": (("--spreadsheet-id", "--sheet-id", "--account"), "write the tool calls that build a spreadsheet"),
    "run": (("--edges", *_FETCH), "seed, search, snowball, filter and batches in one go"),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="paperloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, (options, help_text) in COMMANDS.items():
        p = commands.add_parser(name, help=help_text, description=help_text)
        for o in (*options, *(("--review", "--root") if name not in ("init", "doctor") else ())):
            p.add_argument(o, **OPTIONS[o])
    return out


class Commands:
    """What each command does, for parsed arguments; returns what is printed."""

    def __init__(self, spark: SparkSession, args: argparse.Namespace, connectors: dict | None = None):
        self.spark, self.args, self._connectors = spark, args, connectors
        self._review: Review | None = None

    @property
    def review(self) -> Review:
        if self._review is None:
            self._review = Review(self.spark, self.args.review) if self.args.review else Review.latest(self.spark, self.args.root)
        return self._review

    @property
    def connectors(self) -> dict:
        if self._connectors is None:
            folder = None if self.args.no_cache else self.args.cache or str(self.review.folder / "cache")
            self._connectors = {name: make(Client(folder)) for name, make in (("semantic_scholar", services.SemanticScholar), ("openalex", services.OpenAlex), ("arxiv", services.Arxiv))}
        return self._connectors

    def table(self, path: str) -> DataFrame:
        return records.read_papers(self.spark, path) if path.endswith((".jsonl", ".json")) else self.spark.read.parquet(path)

    def corpora(self) -> dict[str, DataFrame]:
        return {name: self.table(path) for name, _, path in (c.partition("=") for c in self.args.corpus or [])}

    def _fetched(self, step: str, found: tuple[DataFrame, list[str], dict]) -> dict:
        records, errors, totals = found
        return {"added": self.review.take(step, records, fetch.metadata(self.spark, self.connectors, records), totals=totals, errors=errors), "errors": errors} | ({"totals": totals} if any(t["total"] is not None for t in totals.values()) else {})

    def _queries(self, section: str) -> dict[str, str]:
        own, prefix = (self.args.query, "x") if self.args.query else (self.review.config[section]["queries"], "q")
        return {f"{prefix}{i}": q for i, q in enumerate(own, 1)}

    def _limit(self, section: str) -> int:
        return self.args.limit or int(self.review.config[section]["per_query"])

    def init(self):
        return {"folder": str(Review.create(self.spark, self.args.topic, self.args.root, name=self.args.name).folder)}

    def doctor(self):
        probes = self._connectors or {"semantic_scholar": services.SemanticScholar(Client(retries=1, timeout=10)), "openalex": services.OpenAlex(Client(retries=1, timeout=10)), "arxiv": services.Arxiv(Client(retries=1, timeout=10))}
        return Review.capabilities(self.spark, probes)

    def seed(self):
        if local := self.corpora():
            return {"added": self.review.seed(local, self.args.query, limit=self.args.limit)}
        out = self._fetched("seed", fetch.seeded(self.spark, self.connectors, self._queries("seed"), self._limit("seed"), **self.review.years()))
        known = [] if self.args.query else self.review.config["seed"]["papers"]
        if known:
            added, errors = self.review.add(known, fetch.looked_up(self.spark, self.connectors, known), tag="seed:known")
            out = {"added": out["added"] + added, "errors": out["errors"] + errors}
        return out

    def search(self):
        chosen = self.args.sources.split(",") if self.args.sources else self.review.config["search"]["sources"]
        if local := self.corpora():
            return {"added": self.review.search({k: v for k, v in local.items() if k in chosen}, self.args.query, limit=self.args.limit)}
        own = {k: c for k, c in self.connectors.items() if k in chosen}
        return self._fetched("search", fetch.searched(self.spark, own, self._queries("search"), self._limit("search"), **self.review.years()))

    def snowball(self):
        a, s = self.args, self.review.config["snowball"]
        for key, value in (("from", a.start), ("direction", a.direction), ("max_references", a.max_references), ("max_citations", a.max_citations)):
            s[key] = s[key] if value is None else value
        if a.edges:
            corpus = next(iter(self.corpora().values()))
            return self.review.snowball(self.table(a.edges), corpus, round_no=a.round, force=a.force, most=a.max_frontier)
        frontier = self.review.frontier(a.round, a.force, a.max_frontier)
        edges, corpus, report = fetch.neighbours(self.spark, self.connectors, frontier, direction=s["direction"], most_citing=2000 if s["max_citations"] is None else int(s["max_citations"]), backend=a.backend or s.get("backend") or "auto")
        return self.review.snowball(edges, corpus, round_no=a.round, force=a.force, most=a.max_frontier) | {k: report[k] for k in ("errors", "failed", "unresolved", "backend")}

    def complete(self):
        self.review.complete(self.corpora() or fetch.metadata(self.spark, self.connectors, self.review.papers()), force=self.args.all)

    def filter(self):
        return self.review.filter()

    def batches(self):
        return {"files": self.review.batches(self.args.stage, self.args.size, self.args.force)}

    def apply(self):
        return self.review.apply(self.args.stage, self.args.all)

    def show(self):
        fields = self.args.fields.split(",") if self.args.fields else None
        return "\n".join("\t".join(row) for row in self.review.show(self.args.where, fields, self.args.sort, self.args.limit or 50))

    def add(self):
        added, errors = self.review.add(self.args.items, self.corpora() or fetch.looked_up(self.spark, self.connectors, self.args.items))
        return {"added": added, "errors": errors}

    def set(self):
        changes = {k: v if v != "" else None for k, eq, v in (x.partition("=") for x in self.args.assignments) if eq}
        if len(changes) < len(self.args.assignments):
            raise ValueError("changes are written field=value")
        return {"papers": self.review.set(self.args.id, **changes)}

    def status(self):
        return self.review.status()

    def export(self):
        return {"file": self.review.export(self.args.out)}

    def sheet_plan(self):
        return {"files": self.review.sheet_plan(self.args.spreadsheet_id, self.args.account, self.args.sheet_id)}

    def run(self):
        if not (local := self.corpora()) or not self.args.edges:
            raise ValueError("run takes --corpus and --edges; with services, call its steps one by one")
        return self.review.run_all(local, self.table(self.args.edges), next(iter(local.values())))


def main(argv: list[str] | None = None, spark: SparkSession | None = None, connectors: dict | None = None) -> int:
    args = parser().parse_args(argv)
    own = spark or SparkSession.builder.appName("paperloom").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        out = getattr(Commands(own, args, connectors), args.command.replace("-", "_"))()
    except (ValueError, OSError) as e:
        print(f"paperloom {args.command}: {e}", file=sys.stderr)
        return 2
    finally:
        if spark is None:
            own.stop()
    print(out if isinstance(out, str) else json.dumps(out if out is not None else {}, ensure_ascii=False, indent=1, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
