"""The command line, over local tables and over scripted services."""

import json

import pytest

from paperloom.__main__ import COMMANDS, main, parser
from tests.test_review import LONG, corpora
from tests.test_sources_sheets import S2, WORK, Fake


@pytest.fixture
def run(spark, capsys, tmp_path):
    def call(*argv, connectors=None, fails=False):
        more = () if argv[0] in ("init", "doctor") else ("--root", str(tmp_path / "reviews"))
        code = main([*argv, *more], spark, connectors)
        out = capsys.readouterr()
        assert bool(code) == fails, out.err
        return out.err if fails else json.loads(out.out) if argv[0] != "show" else out.out.strip()

    return call


def test_every_command_has_help():
    for name in COMMANDS:
        with pytest.raises(SystemExit) as e:
            parser().parse_args([name, "--help"])
        assert e.value.code == 0


def test_commands_over_local_tables(spark, run, tmp_path):
    folder = run("init", "Citation networks", "--root", str(tmp_path / "reviews"), "--name", "nets")["folder"]
    assert folder.endswith("-nets") and "no review" not in str(run("status")["next"])
    assert "holds a review already" in run("init", "x", "--root", str(tmp_path / "reviews"), "--name", "nets", fails=True)
    sources = []
    for name, df in corpora(spark).items():
        df.write.parquet(f"{tmp_path}/{name}")
        sources += ["--corpus", f"{name}={tmp_path}/{name}"]
    spark.createDataFrame([("doi:10.1234/a", "w1", 0)], "parent_id string, child_id string, pos int").write.parquet(f"{tmp_path}/edges")
    spark.createDataFrame([("w1", LONG.format("Reference one"), "W1", 1)], "id string, title string, openalex_id string, citation_count long").write.parquet(f"{tmp_path}/near")
    assert run("seed", "--query", "what is a study of citation networks", *sources)["added"] == 1
    assert run("search", "--query", "citation OR graph*", "--limit", "5", *sources)["added"] == 2
    assert run("search", "--query", "citation", "--sources", "arxiv", *sources)["added"] == 0
    assert run("snowball", "--direction", "backward", "--edges", f"{tmp_path}/edges", "--corpus", f"near={tmp_path}/near")["added"] == 1
    assert "frontier" in run("snowball", "--round", "1", "--max-frontier", "1", "--edges", f"{tmp_path}/edges", "--corpus", f"near={tmp_path}/near", fails=True)
    assert run("add", LONG.format("Other work"), "10.1234/nothing", *sources)["errors"] == ["10.1234/nothing: not found: DOI:10.1234/nothing"]
    assert run("complete", "--all", *sources) == {}
    assert run("filter") == {"language": 1}
    shown = run("show", "--where", "included=no", "--fields", "id,title", "--sort", "citations", "--limit", "1")
    assert shown.split("\t") == ["doi:10.1234/a", LONG.format("A study")]
    assert run("set", "doi:10.1234/a", "status=core", "short_summary=one=two")["papers"] == 1
    assert "field=value" in run("set", "doi:10.1234/a", "status", fails=True) and "must be one of" in run("set", "doi:10.1234/a", "status=odd", fails=True)
    assert len(run("batches", "--stage", "screen", "--size", "1")["files"]) == 2
    assert run("apply", "--stage", "screen", "--all")["files"] == 0
    assert run("status")["core"] == 1 and run("export", "--out", f"{tmp_path}/out.xlsx")["file"].endswith("out.xlsx")
    assert len(run("sheet-plan", "--spreadsheet-id", "sid", "--sheet-id", "3")["files"]) >= 4


def test_commands_over_services(spark, run, tmp_path):
    run("init", "Services", "--root", str(tmp_path / "reviews"))
    entry = "<entry><id>http://arxiv.org/abs/2401.09999v1</id><published>2024-01-02T00:00:00Z</published><title>Held by the feed</title><summary>Text</summary><author><name>Ann</name></author></entry>"
    work = WORK | {"title": "A work on graphs"}
    up = {
        "semantic_scholar": Fake(search=[S2], lookup=[S2 | {"abstract": "found later"}], match_title=None, neighbours=[S2 | {"title": "A citing paper of some length", "externalIds": {"DOI": "10.1/citing"}, "paperId": "c"}]),
        "openalex": Fake(search=[work], by_doi=[], by_id=[WORK | {"id": "https://openalex.org/W2", "doi": None, "title": "A reference of some length", "locations": []}], resolve=work, cited_by=[]),
        "arxiv": Fake(search=[entry]),
    }
    assert run("seed", "--query", "what is two", connectors=up) == {"added": 1, "errors": []}
    assert "found later" in run("show", "--fields", "abstract", connectors=up)
    assert run("search", "--query", "work", connectors=up) == {"added": 2, "errors": []}
    assert run("snowball", "--force", connectors=up)["added"] == 2
    assert run("add", "arXiv:2401.00002", "no such title at all", connectors=up)["errors"] == ["no such title at all: no confirmed match for this title"]
    kinds = run("show", "--fields", "found", "--limit", "9").splitlines()
    assert {k for line in kinds for k in line.split(",")} >= {"seed", "openalex", "arxiv", "backward", "forward", "manual"}


def test_doctor_gives_a_verdict(run, monkeypatch):
    from paperloom.sources.http import HttpError

    monkeypatch.setenv("OPENALEX_EMAIL", "x@y.z")
    one = run("doctor", connectors={"a": Fake(search=[{"id": 1}])})
    assert one["verdict"] == "ready" and one["services"] == {"a": True} and one["keys"]["OPENALEX_EMAIL"] and not one["keys"]["PAPERLOOM_SHEET_ACCOUNT"]
    two = run("doctor", connectors={"a": Fake(search=[{"id": 1}]), "b": Fake(search=HttpError(500, "down"))})
    assert two["verdict"] == "degraded" and "down" in two["services"]["b"]
    monkeypatch.setattr("importlib.util.find_spec", lambda name, find=__import__("importlib.util").util.find_spec: None if name == "yaml" else find(name))
    assert run("doctor", connectors={"a": Fake(search=[{"id": 1}])})["verdict"] == "not ready"
