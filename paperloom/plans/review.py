"""A review: a folder with a configuration, tables of papers and raw records, and the commands that work on them."""

from __future__ import annotations

import datetime
import json
import os
import re
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import paper, text
from paperloom.operators import filters, graph, identity, layout, lookup, report, screening, search
from paperloom.plans.schema import EDITABLE, PAPER, PRIORITIES, STATUSES, conform
from paperloom.sources import config as configs
from paperloom.sources import records, sheets
from paperloom.sources.commits import Commits, Conflict


#: Unknown ids, problems and missing results that a command tells of; where there are more, the whole list is a table in the review's folder.
TOLD = 1000


class Review:
    """The folder, on the driver, holds config.yaml, batches, results, and logs.

    Papers and raw records are tables below `tables`, a place in any file system that Spark reaches: the folder itself, or
    what create() was told (a cluster needs one that its executors share). Papers are versioned: a new version is written
    whole and counts once it is committed; of two who save after reading the same version the second one gets a Conflict.
    corpora maps a source's name to a DataFrame of records; commands that search take them instead of remote services.
    """

    def __init__(self, spark: SparkSession, folder: str, *, today: str | None = None):
        self.spark, self.folder = spark, Path(folder)
        self.config = configs.load(str(self.folder / "config.yaml"))
        self.today = today or datetime.date.today().isoformat()
        named = self.folder / "TABLES"
        self.apart = named.exists()
        self.tables = named.read_text(encoding="utf-8").strip().rstrip("/") if self.apart else "file://" + str(self.folder.resolve())
        if not self.apart and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("on a cluster a review needs tables= in create(): a place that driver and executors share")
        self.versions, self.seen = Commits(spark, f"{self.tables}/papers"), None

    # -------------------------------------------------------------- state

    @classmethod
    def create(cls, spark: SparkSession, topic: str, root: str = "reviews", *, today: str | None = None, name: str | None = None, tables: str | None = None) -> Review:
        """A new review with a default configuration, its tables below `tables` if told; an existing folder is not touched."""
        today = today or datetime.date.today().isoformat()
        folder = Path(root) / f"{today}-{text.slug(name or topic)}"
        if (folder / "config.yaml").exists():
            raise FileExistsError(f"{folder} holds a review already")
        folder.mkdir(parents=True, exist_ok=True)
        (folder / "config.yaml").write_text(configs.render(topic, today), encoding="utf-8")
        if tables:
            (folder / "TABLES").write_text(f"{tables.rstrip('/')}/{folder.name}", encoding="utf-8")
        return cls(spark, str(folder), today=today)

    @classmethod
    def latest(cls, spark: SparkSession, root: str = "reviews") -> Review:
        """The review whose folder changed last."""
        found = [p.parent for p in Path(root).glob("*/config.yaml")]
        if not found:
            raise FileNotFoundError(f"no review below {root}")
        return cls(spark, str(max(found, key=lambda p: p.stat().st_mtime)))

    def _uri(self, *parts: str) -> str:
        return "/".join((self.tables, *parts))

    def papers(self) -> DataFrame:
        """The papers of the last version."""
        self.seen, document = self.versions.latest()
        return self.spark.read.schema(PAPER).parquet(self._uri("papers", document["papers"])) if document else self.spark.createDataFrame([], PAPER)

    def save(self, papers: DataFrame, keep: int = 2) -> DataFrame:
        """A new version of the papers after the one that was read last; the last `keep` versions stay."""
        version = (self.versions.latest()[0] if self.seen is None else self.seen) + 1
        name = f"v{version:06d}-{uuid.uuid4().hex[:8]}"
        conform(papers).write.parquet(self._uri("papers", name))
        try:
            self.versions.commit(version, {"papers": name})
        except Conflict:
            self.versions.remove(name)
            raise
        for old in self.versions.versions()[:-keep]:
            self.versions.remove(self.versions.read(old)["papers"])
        return self.papers()

    def raw(self) -> DataFrame:
        whole = Commits(self.spark, self._uri("raw")).whole_folders()
        return self.spark.read.schema(PAPER).parquet(*(self._uri("raw", name) for name in whole)) if whole else self.spark.createDataFrame([], PAPER)

    def save_raw(self, prefix: str, found: DataFrame) -> DataFrame:
        """One folder for each fetch, numbered within its prefix."""
        n = sum(name.startswith(f"{prefix}-") for name in Commits(self.spark, self._uri("raw")).whole_folders()) + 1
        path = self._uri("raw", f"{prefix}-{n:02d}")
        conform(found).write.parquet(path)
        return self.spark.read.schema(PAPER).parquet(path)

    def log(self, stage: str, summary: str, **data) -> None:
        entry = {"date": self.today, "stage": stage, "summary": summary, **data}
        with open(self.folder / "runlog.jsonl", "a", encoding="utf-8") as f:
            f.write(json.dumps(entry, ensure_ascii=False, default=str) + "\n")
        with open(self.folder / "log.md", "a", encoding="utf-8") as f:
            f.write(f"- {self.today} **{stage}**: {summary}\n")

    def _merge(self, stage: str, prefix: str, found: DataFrame, metadata: dict[str, DataFrame] | None, **more) -> int:
        fetched = self.save_raw(prefix, layout.numbered(conform(found), [F.col("seq")], "_n").withColumn("seq", F.col("_n")).drop("_n"))
        merged, new = identity.merge_into(self.papers(), fetched)
        added = new.count()
        self.save(self._completed(merged, metadata) if metadata else merged)
        self.log(stage, f"{added} new papers", added=added, **more)
        return added

    def take(self, step: str, found: DataFrame, metadata: dict[str, DataFrame] | None = None, **more) -> int:
        """Merges records that a step found elsewhere; returns how many papers are new. The log tells more about the step, such as its totals."""
        return self._merge(step, step, found, metadata, **more)

    def years(self) -> dict:
        f = self.config["filters"]
        return {"year_min": f.get("year_min"), "year_max": f.get("year_max")}

    # -------------------------------------------------------------- commands

    @staticmethod
    def capabilities(spark: SparkSession, services: dict | None = None) -> dict:
        """What is at hand: versions, modules, which services answer, which keys are set; and the verdict: ready, degraded or not ready.

        A service that does not answer degrades a review, as others can be asked; a missing module stops it.
        """
        import importlib.util
        import platform

        reached = {}
        for name, service in (services or {}).items():
            try:
                reached[name] = next(iter(service.search("systematic review", 1)), None) is not None
            except Exception as e:  # whatever a service fails with is told
                reached[name] = f"{type(e).__name__}: {e}"[:160]
        modules = {m: importlib.util.find_spec(m) is not None for m in ("yaml", "pyarrow", "pandas")}
        keys = {k: k in os.environ for k in ("OPENALEX_API_KEY", "S2_API_KEY", "OPENALEX_EMAIL", "PAPERLOOM_SHEET_ACCOUNT")}
        verdict = "not ready" if not all(modules.values()) else "degraded" if any(r is not True for r in reached.values()) else "ready"
        return {"verdict": verdict, "python": platform.python_version(), "spark": spark.version, "modules": modules, "services": reached, "keys": keys}

    def doctor(self, services: dict | None = None) -> dict:
        """capabilities(), and how many papers the review holds; services are probed if given."""
        return self.capabilities(self.spark, services) | {"papers": self.papers().count()}

    def seed(self, corpora: dict[str, DataFrame], queries: list[str] | None = None, metadata: dict[str, DataFrame] | None = None, limit: int | None = None) -> int:
        """Searches natural-language queries, first source with an answer wins, and adds papers known before; returns how many are new."""
        own, prefix = queries or self.config["seed"]["queries"], "x" if queries else "q"
        parts = []
        if own:
            parts.append(search.seed(list(corpora.values()), {f"{prefix}{i}": q for i, q in enumerate(own, 1)}, int(limit or self.config["seed"]["per_query"]), **self.years()))
        if not queries and self.config["seed"]["papers"]:
            parts.append(self._resolved(self.config["seed"]["papers"], corpora, "seed:known")[0])
        return sum(self._merge("seed", "seed", p, metadata) for p in parts)

    def search(self, corpora: dict[str, DataFrame], queries: list[str] | None = None, metadata: dict[str, DataFrame] | None = None, limit: int | None = None) -> int:
        """Boolean queries over each configured source; returns how many papers are new."""
        own, prefix = queries or self.config["search"]["queries"], "x" if queries else "q"
        chosen = {k: c for k, c in corpora.items() if k in self.config["search"]["sources"]}
        if not own or not chosen:
            return 0
        found = search.fan_out(chosen, {f"{prefix}{i}": q for i, q in enumerate(own, 1)}, int(limit or self.config["search"]["per_query"]), **self.years())
        return self._merge("search", "search", found, metadata)

    def frontier(self, round_no: int | None = None, force: bool = False, most: int = graph.FRONTIER_LIMIT) -> DataFrame:
        """The papers that a round starts from, with their ids; refused if they are too many."""
        papers = self.papers()
        out = graph.eligible(papers, round_no or graph.next_round(papers), self.config["snowball"].get("from") == "included").withColumn("id", paper.paper_id())
        graph.guard(out, force, most)
        return out

    def snowball(self, edges: DataFrame, corpus: DataFrame, *, round_no: int | None = None, direction: str | None = None, force: bool = False, most: int = graph.FRONTIER_LIMIT, metadata: dict[str, DataFrame] | None = None) -> dict:
        """One round of expansion; edges and corpus as in graph.snowball_round."""
        s = self.config["snowball"]
        n = round_no or graph.next_round(self.papers())
        frontier = self.frontier(n, force, most)
        found = graph.snowball_round(frontier, edges, corpus, n, direction=direction or s["direction"], max_references=s["max_references"], max_citations=s["max_citations"])
        stats = graph.round_stats(frontier, found).first().asDict()
        numbered = layout.numbered(found, [F.col("start_id"), F.col("direction"), F.coalesce("citation_count", F.lit(0)).desc(), F.col("pos")], "_n").withColumn("seq", F.col("_n"))
        stats["added"] = self._merge("snowball", f"snowball-r{n}", numbered, metadata)
        return stats

    def _resolved(self, items: list, corpora: dict[str, DataFrame], tag: str) -> tuple[DataFrame, DataFrame]:
        if bad := [i for i in items if not isinstance(i, str)]:
            raise ValueError(f"not text: {bad}; put DOIs and arXiv ids in quotes")
        asked = self.spark.createDataFrame(list(enumerate(items)), "seq long, item string")
        first, second = (list(corpora.values()) * 2)[:2]
        found, errors = lookup.resolve(asked, first, second, tag, *list(corpora.values())[2:])
        return found.withColumn("seq", F.col("request_seq")), errors

    def add(self, items: list[str], corpora: dict[str, DataFrame], metadata: dict[str, DataFrame] | None = None, tag: str = "manual") -> tuple[int, list[str]]:
        """Adds papers by DOI, arXiv id or title; they are protected from filters. Returns how many are new, and an error for each item not found."""
        found, errors = self._resolved(items, corpora, tag)
        added = self._merge("add", "manual", found, metadata)
        return added, [f"{r['item']}: {r['why']}" for r in errors.collect()]

    def _completed(self, papers: DataFrame, metadata: dict[str, DataFrame], force: bool = False) -> DataFrame:
        for source, table in metadata.items():
            key = {"s2": paper.lookup_key}.get(source, paper.lookup_doi)
            out = lookup.complete(papers.withColumn("_key", key()), table.withColumn("_key", key()), "_key", source, force=force)
            papers = out.drop("_key")
        return papers

    def complete(self, metadata: dict[str, DataFrame], force: bool = False) -> None:
        """Fills blanks from metadata tables by source, in order; with force also where a source was asked before."""
        self.save(self._completed(self.papers(), metadata, force))
        self.log("complete", "metadata completed")

    def filter(self, year_now: int | None = None) -> dict[str, int]:
        """Merges duplicates again, then recomputes exclusions; returns counts by reason."""
        merged = identity.dedup(self.papers())
        papers = self.save(filters.apply_filters(merged, self.config["filters"], year_now or int(self.today[:4])))
        counts = {r["reason"]: r["n"] for r in filters.reason_counts(papers).collect()}
        self.log("filter", f"{sum(counts.values())} filtered out", reasons=counts)
        return counts

    def _batch_names(self, stage: str) -> list[Path]:
        found = [p for p in (self.folder / stage).glob("batch_*.jsonl") if not p.name.endswith(".result.jsonl")]
        return sorted(found, key=lambda p: int(re.search(r"\d+", p.stem)[0]))

    def batches(self, stage: str, size: int | None = None, force: bool = False) -> list[str]:
        """Writes batch files for judges; each starts with the criteria and where its results are expected."""
        todo = screening.pending(self.papers(), stage, force)
        names = self._batch_names(stage)
        start = 1 + max((int(re.search(r"\d+", p.stem)[0]) for p in names), default=0)
        rows = screening.batch_numbers(todo, size or int(self.config["screening"]["batch_size"]), start).select("batch", "line", screening.compact(stage).alias("value"))
        keys = ("topic", "research_questions", "inclusion_criteria", "exclusion_criteria", *(("taxonomy",) if stage == "enrich" else ()))
        meta, out, held, at = {"stage": stage} | {k: self.config.get(k) or ([] if k != "topic" else "") for k in keys}, [], [], None

        def send() -> None:
            if held:
                name = f"batch_{at:03d}"
                path = self.folder / stage / f"{name}.jsonl"
                records.write_lines(str(path), held, meta | {"batch": name, "output": str(path.with_name(f"{name}.result.jsonl")), "count": len(held)})
                out.append(str(path))

        for r in rows.orderBy("batch", "line").toLocalIterator():
            if r["batch"] != at:
                send()
                at, held = r["batch"], []
            held.append(r["value"])
        send()
        self.log("batches", f"{len(out)} {stage} batches")
        return out

    def apply(self, stage: str, replay: bool = False) -> dict:
        """Applies result files that are new or changed; papers are saved before the files are noted as applied."""
        batches, state_path = self._batch_names(stage), self.folder / stage / "applied.json"
        state = {} if replay or not state_path.exists() else json.loads(state_path.read_text())
        now = {}
        for b in batches:
            result = b.with_name(b.stem + ".result.jsonl")
            if result.exists():
                now[result.name] = [result.stat().st_size, result.stat().st_mtime_ns]
        fresh = [name for name in now if state.get(name) != now[name]]
        papers = self.papers()
        lines = self._lines(stage, fresh)
        rows, bad = screening.results(lines)
        rows = rows.persist()
        try:
            names = list(configs.taxonomy(self.config))
            saved = self.save(screening.apply_results(papers, rows, stage))
            wanted = self._lines(stage, [b.name for b in batches]).select(F.col("file").alias("batch"), F.from_json("value", "id string")["id"].alias("id")).where("id is not null")
            out = {
                "files": len(fresh),
                "applied": rows.where(screening.usable(stage)).join(screening.aliases(papers), rows["id"] == F.col("key"), "left_semi").count(),
                "unknown_ids": self._told(stage, "unknown_ids", screening.unknown_ids(papers, rows).select("id"), lambda r: r["id"]),
                "problems": self._told(stage, "problems", screening.problems(papers, rows, stage, names), lambda r: f"{r['id']}: {r['problem']}"),
                "bad_lines": self._told(stage, "bad_lines", bad, lambda r: f"{r['file']}:{r['line']}"),
                "missing": {},
            }
            for batch, ident in self._told(stage, "missing", screening.missing_results(saved, wanted, rows, stage).orderBy("batch", "id"), tuple):
                out["missing"].setdefault(batch, []).append(ident)
        finally:
            rows.unpersist()
        if fresh:
            part = state_path.with_suffix(".part")
            part.write_text(json.dumps(state | now, indent=1))
            os.replace(part, state_path)
        self.log("apply", f"{out['applied']} {stage} results", **{k: out[k] for k in ("files", "applied")})
        return out

    def _told(self, stage: str, what: str, rows: DataFrame, say) -> list:
        """The first TOLD rows in words; all of them where they are more, as a table in the stage's folder."""
        first = rows.limit(TOLD + 1).collect()
        if len(first) > TOLD:
            rows.write.mode("overwrite").json(self._uri(stage, "reports", what))
        return [say(r) for r in first[:TOLD]]

    def _lines(self, stage: str, names: list[str]) -> DataFrame:
        """(file, file_no, line, value) of the given files of a stage, in their order."""
        empty = self.spark.createDataFrame([], "file string, file_no int, line int, value string")
        if not names:
            return empty
        if self.apart:  # judges write beside the configuration, executors read from where the tables are
            for n in names:
                self.versions.upload(str(self.folder.resolve() / stage / n), self._uri(stage, n))
        whole = self.spark.read.text([self._uri(stage, n) for n in names], wholetext=True)
        order = self.spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, file_no int")
        lines = whole.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "value"))
        return lines.join(F.broadcast(order), "file").select("file", "file_no", (F.col("at") + 1).alias("line"), "value")

    def run_all(self, corpora: dict[str, DataFrame], edges: DataFrame, corpus: DataFrame, metadata: dict[str, DataFrame] | None = None) -> dict:
        """Seed, search, each configured round of snowballing, filter, and batches for screening; returns the status."""
        self.seed(corpora, metadata=metadata)
        self.search(corpora, metadata=metadata)
        for _ in range(int(self.config["snowball"]["rounds"])):
            self.filter()
            self.snowball(edges, corpus, metadata=metadata)
        self.filter()
        self.batches("screen")
        return self.status()

    def show(self, where: list[str] | None = None, fields: list[str] | None = None, sort: str | None = None, limit: int = 50) -> list[tuple]:
        """Papers that meet all conditions, as shortened texts; citations, found and reason are short names of fields."""
        return [tuple(r) for r in layout.shown(self.papers(), where, fields, sort, limit).collect()]

    def set(self, ident: str, **changes) -> int:
        """Sets fields of a paper by hand; they are kept from results and merges. Returns how many papers it was."""
        for name, value in changes.items():
            if name not in EDITABLE:
                raise ValueError(f"{name} can't be set; fields are {', '.join(EDITABLE)}")
            allowed = {"status": STATUSES, "priority": PRIORITIES}.get(name)
            if allowed and value is not None and value not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if changes.get("status") and "status_reason" not in changes:
            changes["status_reason"] = "set manually"
        papers = self.papers()
        keys = screening.aliases(papers).where(F.col("key") == ident).select("seq", F.lit(True).alias("_hit"))
        hit = F.coalesce("_hit", F.lit(False))
        noted = F.array_sort(F.array_union(F.coalesce("extra.manual", F.array().cast("array<string>")), F.array(*(F.lit(n) for n in changes))))
        out = papers.join(keys, "seq", "left").withColumns({n: F.when(hit, F.lit(v)).otherwise(F.col(n)) for n, v in changes.items()} | {"extra": F.when(hit, F.struct(noted.alias("manual"), F.col("extra.meta_checked").alias("meta_checked"), F.col("extra.rest").alias("rest"))).otherwise(F.col("extra"))})
        n = keys.count()
        if n:
            self.save(out.drop("_hit"))
            self.log("set", f"{ident}: {', '.join(changes)}")
        return n

    def status(self) -> dict:
        s = report.stats(self.papers(), self.raw())
        return s | {"next": report.next_step(s, self.config)}

    def tabs(self, phases: bool = True) -> list[layout.Tab]:
        papers = self.papers()
        s = report.stats(papers, self.raw())
        return layout.build(papers, self.config, s, self.today) + (layout.phase_tabs(papers, self.config, s) if phases else [])

    def export(self, path: str | None = None) -> str:
        """Writes the workbook."""
        path = path or str(self.folder / "review.xlsx")
        sheets.write_xlsx(self.tabs(), path)
        self.log("export", path)
        return path

    def sheet_plan(self, spreadsheet: str, account: str | None = None, papers_id: int = 0) -> list[str]:
        """Writes the plan of tool calls that builds the spreadsheet."""
        return sheets.write_plan(sheets.sheet_plan(self.tabs(False), spreadsheet, account=account, papers_id=papers_id), str(self.folder / "sheet_plan"))
