"""Whole reports against the plain Python model, and the ways of extending and feeding the analysis."""

import io
import json
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from hunkwise import cli
from hunkwise.config import Config, Weights, config_from, default_config, default_text
from hunkwise.operators.metrics import INTEGER, FileMetric, HunkMetric, MoveMetric, OverallMetric, default_registry, metric
from hunkwise.operators.rules import ERROR, Rule, hunk_rules, overall_rules
from hunkwise.operators.scoring import WeightedScorer
from hunkwise.plans.analysis import analyse, gate, recommendations, report, violations
from hunkwise.plans.render import report_json
from hunkwise.sources.patches import from_git, parse_diffs, read_patches, split_parsed
from hunkwise.streaming.patches import stream_reports

from .model import File, expected, rendered, scenarios

TIGHT = Config(
    hunk_score_threshold=0.6, file_score_threshold=0.7, max_diff_lines=20, max_hunk_lines=6, max_move_lines=9, move_similarity_penalty=2.0, min_overall_score=0.5,
    max_problematic_hunks=1, max_problematic_moves=0, max_problematic_files=0, max_files_changed=3, max_added_lines=6, weights=Weights(0.5),
)
LOOSE = Config(hunk_score_threshold=0.5, file_score_threshold=0.5, max_diff_lines=1000, max_hunk_lines=100, max_move_lines=90, move_similarity_penalty=1.0)


def analysis(spark, patches, config, **more):
    rows = spark.createDataFrame([(k, v) for k, v in patches.items()], "diff_id string, diff_text string")
    diffs, files, lines, errors = split_parsed(parse_diffs(rows))
    assert errors.isEmpty()
    return analyse(lines, files, config, diffs, **more)


@pytest.mark.parametrize("config", [default_config(), TIGHT, LOOSE], ids=["default", "tight", "loose"])
def test_reports_match_the_model(spark, config):
    cases = scenarios(seed=5)
    a = analysis(spark, {k: rendered(v) for k, v in cases.items()}, config)
    got = {r["diff_id"]: json.loads(r["json"]) for r in report_json(report(a, detailed=True), detailed=True).collect()}
    short = {r["diff_id"]: json.loads(r["json"]) for r in report_json(report(a)).collect()}
    a.release()
    assert got.keys() == cases.keys()
    texts = {m.name: m.remediation for r in [default_registry(config)] for m in (*r.hunk_metrics(), *r.move_metrics(), *r.overall_metrics())}
    for name, files in cases.items():
        for r in got[name]["recommendations"]:
            assert r.pop("remediation") == texts[r["metric"]]
        for r in short[name]["recommendations"]:
            r.pop("remediation")
        want = expected(files, config)
        assert got[name] == want, name
        assert list(got[name]) == list(want)
        assert short[name] == {k: want[k] for k in ("score", "passed", "violations", "recommendations")}


def test_gate_and_recommendations_agree_with_the_report(spark):
    cases = scenarios(seed=6, random_ones=15)
    a = analysis(spark, {k: rendered(v) for k, v in cases.items()}, TIGHT)
    gated = {r.diff_id: r for r in gate(a).collect()}
    listed: dict = {}
    for r in recommendations(a).orderBy("diff_id", "section", "subject", "ord").collect():
        listed.setdefault(r.diff_id, []).append({"location": r.location, "metric": r.metric, "value": r.value})
    a.release()
    for name, files in cases.items():
        want = expected(files, TIGHT)
        assert (gated[name].passed, gated[name].violations, listed.get(name, [])) == (want["passed"], want["violations"], want["recommendations"])


def test_own_scorer_rules_and_metrics(spark):
    class Flat(WeightedScorer):
        def hunk(self, names):
            return F.lit(0.25)

        def overall(self, names):
            return F.when(metric("overall.largest_file") > 1, F.lit(0.5)).otherwise(F.lit(1.0))

    registry = default_registry(LOOSE)
    registry.add(FileMetric("file.hunks", INTEGER, lambda _: F.count("*")))
    registry.add(MoveMetric("move.lines", INTEGER, lambda _: F.col("length").cast("long"), "Move less.", lambda v: v > 2))
    registry.add(HunkMetric("hunk.lines_changed", INTEGER, lambda _: F.lit(7).cast("long")))  # replaces a known one in its place
    registry.add(OverallMetric("overall.largest_file", INTEGER, lambda _: F.max(metric("file.hunks")), over="files"))
    with pytest.raises(TypeError):
        registry.add("no metric")
    cases = scenarios(seed=7, random_ones=0)
    a = analysis(spark, {k: rendered(cases[k]) for k in ("pure move", "move within a file", "scattered")}, LOOSE, registry=registry, scorer=Flat(LOOSE))
    assert {r.diff_id: r.score for r in a.overall.collect()} == {"pure move": 1.0, "move within a file": 0.5, "scattered": 1.0}
    assert {r["score"] for r in a.hunk_analysis.select("score").collect()} == {0.25}
    assert {r[0] for r in a.hunk_analysis.select(metric("hunk.lines_changed")).collect()} == {7}
    assert [m.name for m in registry.hunk_metrics()][0] == "hunk.lines_changed"
    assert {r[0] for r in a.move_analysis.select(metric("move.lines")).collect()} == {8, 4}
    rule = Rule(ERROR, F.when(metric("file.hunks") > 0, "never read"))
    own = Rule(ERROR, F.when(metric("overall.largest_file") > 2, F.concat(F.lit("A file has "), metric("overall.largest_file").cast("string"), F.lit(" hunks"))))
    found = violations(a, hunk_rules(LOOSE), [*overall_rules(LOOSE), own]).collect()
    a.release()
    assert rule.severity == ERROR and [(r.diff_id, r.text) for r in found] == [("move within a file", "[ERROR] A file has 3 hunks")]


def test_git(spark, tmp_path):
    def git(*args):
        subprocess.run(["git", "-c", "user.email=a@b", "-c", "user.name=n", *args], cwd=tmp_path, check=True, capture_output=True)

    git("init", "-q")
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    git("add", "."), git("commit", "-qm", "first")  # noqa: B018
    (tmp_path / "a.txt").write_text("one\nthree lines\n")
    source = from_git(spark, "HEAD", cwd=tmp_path)
    _, files, lines, _ = split_parsed(parse_diffs(source))
    assert [r.path for r in files.collect()] == ["a.txt"]
    assert [(r.kind, r.raw) for r in lines.orderBy("seq").collect()] == [("context", "one\n"), ("removed", "two\n"), ("added", "three lines\n")]
    with pytest.raises(subprocess.CalledProcessError):
        from_git(spark, "no-such-revision", cwd=tmp_path)


def test_streaming(spark, tmp_path):
    cases = scenarios(seed=8, random_ones=2)
    inbox, out = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for k, files in enumerate(cases.values()):
        (inbox / f"{k}.patch").write_text(rendered(files))
    (inbox / "broken.patch").write_text("@@ -1 +1 @@\n-a\n+b\n")
    stream = lambda: stream_reports(spark, str(inbox), str(out), str(tmp_path / "state"), TIGHT, detailed=True).awaitTermination(240)
    stream()
    later = [File("late.txt", hunks=[[("added", "a late line")]])]
    (inbox / "late.patch").write_text(rendered(later))
    stream()
    got = {r.diff_id.rsplit("/", 1)[1]: json.loads(r.json) for r in spark.read.parquet(str(out)).collect()}
    assert "parse_error" in got.pop("broken.patch")
    want = {f"{k}.patch": expected(files, TIGHT) for k, files in enumerate([*cases.values()])} | {"late.patch": expected(later, TIGHT)}
    assert {k: (v["score"], v["passed"], v["moves"]) for k, v in got.items()} == {k: (v["score"], v["passed"], v["moves"]) for k, v in want.items()}


def test_patch_files(spark, tmp_path):
    (tmp_path / "p.patch").write_text(rendered(scenarios(1, 0)["rename with change"]))
    _, files, lines, _ = split_parsed(parse_diffs(read_patches(spark, str(tmp_path))))
    assert [(r.path, r.old_path) for r in files.collect()] == [("n.py", "o.py")] and lines.count() == 4


def test_default_configuration_can_be_copied(spark, tmp_path, capsys):
    assert cli.main(["--print-default-config"], spark) == 0
    path = tmp_path / "own.toml"
    path.write_text(capsys.readouterr().out)
    assert path.read_text() == default_text()
    code = cli.main(["-c", str(path), "--from-stdin"], spark, io.StringIO(rendered([File("a.py", hunks=[[("added", "x = 1")]])])))
    assert code == 0 and json.loads(capsys.readouterr().out) == {"score": 1.0, "passed": True, "violations": [], "recommendations": []}
    shutil.rmtree(tmp_path)


@pytest.mark.parametrize("wrong", [{"max_diff_lines": "many"}, {"max_diff_lines": True}, {"weights": 3}, {"excluded_prefixes": ["x"]}])
def test_values_of_the_wrong_kind(wrong):
    limits = dict(hunk_score_threshold=0.5, file_score_threshold=0.5, max_diff_lines=10, max_hunk_lines=5, max_move_lines=5, move_similarity_penalty=2.0)
    with pytest.raises(TypeError):
        config_from(limits | wrong)
