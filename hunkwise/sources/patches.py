"""Unified diffs: from text columns, files, or git, to files and lines.

Parsing is a scan with state, local to each diff's text, so it runs batch by batch where the text is read and shuffles
nothing. A body line is told from a header by counting against the hunk's ``@@`` numbers, so removed text that looks like
``--- x`` stays a removed line. A diff that can't be parsed gives one row with ``parse_error`` and nothing else.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "diff_id string, row string, file_idx int, file_path string, old_path string, is_new boolean, is_deleted boolean, hunk_idx int, seq int, kind string, raw string, parse_error string"
_ARROW = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[t]) for n, t in (x.split() for x in SCHEMA.split(", "))])
_NONE = "/dev/null"
_GIT = re.compile(r"^diff --git (?:\"?(a/.*?)\"?) (?:\"?(b/.*?)\"?)$")
_RANGE = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")
_KINDS = {"+": "added", "-": "removed", " ": "context", "\n": "context", "": "context", "\\": "removed"}


class PatchError(ValueError):
    """The text is no well-formed unified diff."""


def _name(line: str) -> str:
    return line[4:].rstrip("\r\n").split("\t")[0].strip('"')


def parse(text: str, marker_is_removed: bool = True) -> list[dict]:
    """A diff's files, each with ``path, old_path, is_new, is_deleted`` and ``hunks``, lists of (kind, raw text).

    The marker of a missing last newline counts as a removed line by default.
    """
    files: list[dict] = []
    now: dict | None = None

    def begin(source: str | None, target: str | None, git: bool) -> dict:
        files.append({"source": source, "target": target, "git": git, "hunks": [], "ranges": []})
        return files[-1]

    lines = text.splitlines(keepends=True) if "\r" not in text and "\x0c" not in text else re.findall(r"[^\n]*\n|[^\n]+$", text)
    at = 0
    while at < len(lines):
        line = lines[at]
        at += 1
        if m := _GIT.match(line.rstrip("\r\n")):
            now = begin(m[1], m[2], True)
        elif line.startswith("--- ") and at < len(lines) and lines[at].startswith("+++ "):
            if now is None or not now["git"] or now["hunks"]:
                now = begin(None, None, False)
            now["source"], now["target"], now["git"] = _name(line), _name(lines[at]), False
            at += 1
        elif line.startswith("rename from ") and now:
            now["source"] = "a/" + line[12:].rstrip("\r\n")
        elif line.startswith("rename to ") and now:
            now["target"] = "b/" + line[10:].rstrip("\r\n")
        elif line.startswith("new file mode") and now:
            now["source"] = _NONE
        elif line.startswith("deleted file mode") and now:
            now["target"] = _NONE
        elif m := _RANGE.match(line):
            if now is None:
                raise PatchError(f"line {at}: a hunk before any file")
            old, new = (int(m[2]) if m[2] is not None else 1), (int(m[4]) if m[4] is not None else 1)
            now["ranges"].append((int(m[1]), old, int(m[3]), new))
            body: list[tuple[str, str]] = []
            while old > 0 or new > 0:
                if at >= len(lines):
                    raise PatchError(f"line {at}: the hunk is shorter than its header says")
                sign = lines[at][:1]
                if sign not in _KINDS:
                    raise PatchError(f"line {at + 1}: unexpected line in a hunk")
                old -= sign in ("-", " ", "\n", "")
                new -= sign in ("+", " ", "\n", "")
                if old < 0 or new < 0:
                    raise PatchError(f"line {at + 1}: the hunk is longer than its header says")
                if sign != "\\" or marker_is_removed:
                    body.append((_KINDS[sign], lines[at][1:] if sign != "\n" else "\n"))
                at += 1
            now["hunks"].append(body)
        elif line.startswith("\\ ") and now and now["hunks"]:
            if marker_is_removed:
                now["hunks"][-1].append(("removed", line[1:]))
    return [_described(f) for f in files]


def _described(f: dict) -> dict:
    source, target = f["source"], f["target"]
    renamed = source != _NONE and target != _NONE and source[2:] != target[2:]
    one = f["ranges"][0] if len(f["ranges"]) == 1 else None
    path = target if source == _NONE or renamed else source
    return {
        "path": path[2:] if path.startswith(("a/", "b/")) else path,
        "old_path": source.removeprefix("a/") if renamed else None,
        "is_new": source == _NONE or bool(one and one[0] == 0 and one[1] == 0),
        "is_deleted": target == _NONE or bool(one and one[2] == 0 and one[3] == 0),
        "hunks": f["hunks"],
    }


def _rows(diff_id: str | None, text: str | None) -> Iterator[dict]:
    try:
        files = parse(text or "")
    except PatchError as e:
        yield {"diff_id": diff_id, "row": "error", "parse_error": str(e)}
        return
    yield {"diff_id": diff_id, "row": "diff"}
    hunk = 0
    for k, f in enumerate(files):
        base = {"diff_id": diff_id, "file_idx": k, "file_path": f["path"], "old_path": f["old_path"], "is_new": f["is_new"], "is_deleted": f["is_deleted"]}
        yield base | {"row": "file"}
        for body in f["hunks"]:
            if not body:
                yield base | {"row": "line", "hunk_idx": hunk, "seq": 0, "kind": "empty", "raw": ""}
            for seq, (kind, raw) in enumerate(body):
                yield base | {"row": "line", "hunk_idx": hunk, "seq": seq, "kind": kind, "raw": raw}
            hunk += 1


def parse_diffs(diffs: DataFrame, id_col: str = "diff_id", text_col: str = "diff_text") -> DataFrame:
    """Rows of ``SCHEMA``: one of kind diff for every diff, then its files and lines; or one of kind error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[dict] = []
            for d, t in zip(b.column(0), b.column(1), strict=True):
                for r in _rows(d.as_py(), t.as_py()):
                    out.append(r)
                    if len(out) >= 20_000:
                        yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return diffs.select(F.col(id_col).cast("string").alias("diff_id"), F.col(text_col).alias("t")).mapInArrow(run, SCHEMA)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Diffs, files, lines and errors of ``parse_diffs``."""
    lines = parsed.where("row = 'line'").select("diff_id", "file_idx", "file_path", "old_path", "is_new", "is_deleted", "hunk_idx", "seq", "kind", "raw")
    files = parsed.where("row = 'file'").select("diff_id", "file_idx", F.col("file_path").alias("path"), "old_path", "is_new", "is_deleted")
    return parsed.where("row = 'diff'").select("diff_id"), files, lines, parsed.where("row = 'error'").select("diff_id", "parse_error")


def read_patches(spark: SparkSession, path: str) -> DataFrame:
    """``diff_id, diff_text`` of every file under a path, the id being the file's path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("diff_text"))


def from_text(spark: SparkSession, text: str, diff_id: str = "diff") -> DataFrame:
    """One diff, as read from standard input."""
    return spark.createDataFrame([(diff_id, text)], "diff_id string, diff_text string")


def from_git(spark: SparkSession, *args: str, cwd: str | Path | None = None) -> DataFrame:
    """The output of ``git diff`` with ``args``; a failing git raises."""
    done = subprocess.run(["git", "diff", *args], capture_output=True, text=True, check=True, cwd=cwd)
    return from_text(spark, done.stdout, " ".join(args) or "diff")
