"""Parser, similarity, rounding, configuration and the whole analysis on small diffs."""

import io
import json

import pytest
from pyspark.sql import functions as F

from hunkwise import cli
from hunkwise.config import config_from, default_config, load_config
from hunkwise.functions.numeric import exact_round
from hunkwise.functions.similarity import line_ratio
from hunkwise.functions.text import extension, normalise
from hunkwise.sources.patches import PatchError, parse

PATCH = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,4 +1,5 @@
 keep
-old one
--- looks like a header
+new one
+import os
+
 keep too
diff --git a/old.txt b/new.txt
similarity index 100%
rename from old.txt
rename to new.txt
diff --git a/b.py b/b.py
new file mode 100644
--- /dev/null
+++ b/b.py
@@ -0,0 +1 @@
+x
\\ No newline at end of file
"""


def test_parse():
    a, renamed, b = parse(PATCH)
    assert [k for k, _ in a["hunks"][0]] == ["context", "removed", "removed", "added", "added", "added", "context"]
    assert a["hunks"][0][2][1] == "-- looks like a header\n" and a["hunks"][0][0][1] == "keep\n"
    assert (renamed["path"], renamed["old_path"], renamed["hunks"]) == ("new.txt", "old.txt", [])
    assert b["is_new"] and not b["is_deleted"] and b["hunks"] == [[("added", "x\n"), ("removed", " No newline at end of file\n")]]
    assert parse("") == []


@pytest.mark.parametrize("bad", ["@@ -1 +1 @@\n-a\n+b\n", "--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n-a\n", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n-b\n"])
def test_parse_errors(bad):
    with pytest.raises(PatchError):
        parse(bad)


def test_line_ratio():
    assert line_ratio("abc", "abc") == 1.0 and line_ratio("abc", "xyz") == 0.0 and line_ratio("abcd", "abxd") == 0.75


def test_rounding(spark):
    values = [0.125, 0.045, 0.005, 2.675, 1 / 3, 0.995, 0.0, 1.0, 0.015, *[k / 37 for k in range(60)], *[k / 800 for k in range(60)]]
    for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", exact_round(F.col("x")).alias("r")).collect():
        assert r.r == round(r.x, 2)


def test_text(spark):
    rows = spark.createDataFrame([("a.tar.GZ", " a\t b  "), (".gitignore", "\x1cx"), ("d.x/file", "")], "p string, t string")
    assert [tuple(r) for r in rows.select(extension(F.col("p")), normalise(F.col("t"))).collect()] == [(".gz", "a b"), ("", "x"), ("", "")]


def test_config(tmp_path):
    assert load_config(tmp_path / "none.toml") == load_config(None) == default_config()
    with pytest.raises(TypeError):
        config_from({"max_diff_lines": 1})
    limits = dict(hunk_score_threshold=0.5, file_score_threshold=0.5, max_diff_lines=10, max_hunk_lines=5, max_move_lines=5, move_similarity_penalty=2.0)
    assert config_from(limits | {"unknown": 1}).min_overall_score is None
    with pytest.raises(TypeError):
        config_from(limits | {"weights": {"unknown": 1}})


def test_cli(spark, tmp_path, capsys):
    config = tmp_path / "c.toml"
    config.write_text("hunk_score_threshold=0.5\nfile_score_threshold=0.5\nmax_diff_lines=2\nmax_hunk_lines=50\nmax_move_lines=50\nmove_similarity_penalty=2.0\nmax_files_changed=2\n")
    code = cli.main(["-c", str(config), "--from-stdin", "--detailed"], spark, io.StringIO(PATCH))
    out = json.loads(capsys.readouterr().out)
    assert out["violations"] == ["[ERROR] Diff touches 3 files, exceeds limit of 2"]
    assert code == 1 and not out["passed"] and out["files_changed"] == 3 and out["hunks_changed"] + 2 * len(out["moves"]) == 2
    assert [m["name"] for m in out["overall"]][:2] == ["overall.files_changed", "overall.lines_changed"] and out["overall"][0]["value"] == 3
