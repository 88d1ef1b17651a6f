"""The analysis in plain Python, one diff at a time, as a measure for the Spark plans; and patches to try it on."""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from pathlib import PurePosixPath

from hunkwise.config import Config, prefix_table

Line = tuple[str, str]  # kind and text


@dataclass
class File:
    path: str
    old: str | None = None
    hunks: list[list[Line]] = field(default_factory=list)


def rendered(files: list[File]) -> str:
    """Unified diff text."""
    out = []
    for f in files:
        old = f.old or f.path
        out.append(f"diff --git a/{old} b/{f.path}")
        if f.old:
            out += ["similarity index 90%", f"rename from {old}", f"rename to {f.path}"]
        if f.hunks:
            out += [f"--- a/{old}", f"+++ b/{f.path}"]
        at = 1
        for h in f.hunks:
            n, m = sum(k != "added" for k, _ in h), sum(k != "removed" for k, _ in h)
            out.append(f"@@ -{at},{n} +{at},{m} @@")
            out += [{"added": "+", "removed": "-", "context": " "}[k] + t for k, t in h]
            at += 100
    return "\n".join(out) + "\n"


def _subsequence(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] + 1 if x == y else max(row[j], new[-1]))
        row = new
    return row[-1]


def _alike(a: str, b: str) -> float:
    n = len(a) + len(b)
    return (1.0 - (n - 2 * _subsequence(a, b)) / n) * 100.0 / 100.0


def _one_way(gone: list[str], come: list[str]) -> float:
    if not gone or not come:
        return 0.0
    left, exact = list(come), 0
    rest = []
    for g in gone:
        if g in left:
            left.remove(g)
            exact += 1
        else:
            rest.append(g)
    # of equal lines the first ones match, so the last ones are left
    left = []
    spare = {t: gone.count(t) for t in set(gone)}
    for c in come:
        if spare.get(c, 0) > 0:
            spare[c] -= 1
        else:
            left.append(c)
    scores = sorted((-s, i, j) for i, a in enumerate(rest) for j, b in enumerate(left) if (s := _alike(a, b)) >= 0.3)
    total, seen = 0.0, set()
    for s, i, j in scores:
        if ("g", i) not in seen and ("c", j) not in seen:
            seen |= {("g", i), ("c", j)}
            total -= s
    return (exact + total) / max(len(gone), len(come))


def expected(files: list[File], config: Config) -> dict:
    """The detailed report."""
    table = prefix_table(config)
    hunks = []
    for k, f in enumerate(files):
        prefixes = tuple(table.get(PurePosixPath(f.path).suffix.lower()) or table.get("*") or ())
        for h in f.hunks:
            lines = [(kind, " ".join(t.split())) for kind, t in h if kind != "context"]
            lines = [(kind, t) for kind, t in lines if t and not t.startswith(prefixes)]
            hunks.append({"file": k, "path": f.path, "lines": lines, "context": sum(kind == "context" for kind, _ in h)})
    side = lambda h, kind: [t for k, t in h["lines"] if k == kind]
    pairs = []
    for i, x in enumerate(hunks):
        for j in range(i + 1, len(hunks)):
            y = hunks[j]
            best = max(_one_way(side(x, "removed"), side(y, "added")), _one_way(side(y, "removed"), side(x, "added")))
            if best >= 0.3:
                pairs.append((-best, i, j))
    picked, used = [], set()
    for s, i, j in sorted(pairs):
        if i not in used and j not in used:
            used |= {i, j}
            picked.append((i, j, -s))
    picked.sort()

    def metric(name: str, value: float) -> dict:
        return {"name": name, "value": value}

    moves = []
    for i, j, s in picked:
        length = max(len(hunks[i]["lines"]), len(hunks[j]["lines"]))
        v = round(max(0.0, 1.0 - length * ((1.0 + config.move_similarity_penalty * (1.0 - s)) / config.max_move_lines)), 2)
        moves.append({"move_id": i - sum(q[1] < i for q in picked), "hunk_count": 2, "score": v, "metrics": [metric("move.edit_complexity", v)]})
    advice, shown, warnings = [], [], []
    inter_sum = weight_sum = 0.0
    changed = added = bad_hunks = 0
    remedies: list[tuple] = []
    for k, h in enumerate(hunks):
        if k in used:
            continue
        n, a, order = len(h["lines"]), len(side(h, "added")), [kind for kind, _ in h["lines"]]
        raw = sum(x != y for x, y in zip(order, order[1:], strict=False)) / (n - 1) if n >= 4 else 0.0
        inter, balance = round(raw, 2), round(a / n if n else 0.0, 2)
        score = max(0.0, 1.0 - (n / config.max_hunk_lines) * (1.0 + config.weights.interleaving_weight * inter))
        shown.append({"file": h["path"], "score": round(score, 2), "metrics": [metric("hunk.lines_changed", n), metric("hunk.added_lines", a), metric("hunk.removed_lines", n - a), metric("hunk.context_lines", h["context"]), metric("hunk.change_balance", balance), metric("hunk.interleaving", inter)]})
        if score < config.hunk_score_threshold:
            bad_hunks += 1
            remedies.append((h["path"], "hunk.change_balance", balance))
            if raw > 0:
                remedies.append((h["path"], "hunk.interleaving", inter))
        if n > config.max_hunk_lines:
            warnings.append(f"[WARNING] Hunk has {n} lines, exceeds limit of {config.max_hunk_lines}")
        changed, added = changed + n, added + a
        inter_sum += inter * max(n, 1)
        weight_sum += max(n, 1)
    remedies += [(f"move:{m['move_id']}", "move.edit_complexity", m["score"]) for m in moves if m["score"] < config.hunk_score_threshold]
    by_file, bad_files, counts = [], 0, []
    for k, f in enumerate(files):
        own = [len(h["lines"]) for h in hunks if h["file"] == k]
        score = max(0.0, 1.0 - sum(own) / config.max_diff_lines)
        bad_files += score < config.file_score_threshold and len(own) > 1
        counts.append(sum(own))
        by_file.append({"file": f.path, "score": round(score, 2), "metrics": [metric("file.lines_changed", sum(own))]})
    busy = [c for c in counts if c]
    scatter = 0.0
    if len(files) > 1 and len(busy) > 1:
        scatter = -sum(c / sum(busy) * math.log2(c / sum(busy)) for c in busy) / math.log2(len(busy))
    mean = inter_sum / weight_sum if weight_sum else 0.0
    mean_shown = round(round(mean, 4), 2)
    score = max(0.0, 1.0 - min(changed / config.max_diff_lines, 1.0) * (1.0 + config.weights.interleaving_weight * mean_shown))
    bad_moves = sum(m["score"] < config.hunk_score_threshold for m in moves)
    counted = {"files_changed": len(files), "lines_changed": changed, "added_lines": added, "problematic_hunk_count": bad_hunks, "problematic_move_count": bad_moves, "problematic_file_count": bad_files}
    remedies += [("overall", f"overall.{k}", v) for k, v in counted.items()]
    if mean > 0.1:
        remedies.append(("overall", "overall.mean_interleaving", mean_shown))
    if changed > config.max_diff_lines:
        warnings.append(f"[ERROR] Diff has {changed} lines changed, exceeds limit of {config.max_diff_lines}")
    if config.min_overall_score is not None and score < config.min_overall_score:
        warnings.append(f"[ERROR] Overall score {round(score, 2):.2f} is below the minimum of {config.min_overall_score}")
    for limit, level, value, text in (
        (config.max_problematic_hunks, "WARNING", bad_hunks, "Diff has {} problematic hunks"), (config.max_problematic_moves, "WARNING", bad_moves, "Diff has {} problematic moves"),
        (config.max_problematic_files, "WARNING", bad_files, "Diff has {} problematic files"), (config.max_files_changed, "ERROR", len(files), "Diff touches {} files"),
        (config.max_added_lines, "ERROR", added, "Diff has {} added lines"),
    ):
        if limit is not None and value > limit:
            warnings.append(f"[{level}] {text.format(value)}, exceeds limit of {limit}")
    passed = not any(w.startswith("[ERROR]") for w in warnings)
    if not passed:
        advice = [{"location": where, "metric": name, "value": v} for where, name, v in remedies]
    overall = [metric(f"overall.{k}", v) for k, v in counted.items()] + [metric("overall.scatter_factor", round(scatter, 2)), metric("overall.mean_interleaving", mean_shown)]
    return {
        "score": round(score, 2), "passed": passed, "violations": warnings, "recommendations": advice, "files_changed": len(files), "hunks_changed": len(shown),
        "overall": overall, "files": by_file, "moves": moves, "hunks": shown,
    }


def _words(rng: random.Random) -> str:
    return " ".join(rng.choice("alpha beta gamma delta omega value = return ( ) call 1 2 3".split()) for _ in range(rng.randint(1, 7)))


def _edited(rng: random.Random, line: str) -> str:
    parts = line.split()
    parts[rng.randrange(len(parts))] = rng.choice("other thing 42".split())
    return " ".join(parts)


def scenarios(seed: int, random_ones: int = 40) -> dict[str, list[File]]:
    """Named patches of the kinds that matter, and random mixtures."""
    rng = random.Random(seed)
    block = [f"step {i} = compute ( alpha , {i * 7} )" for i in range(8)]
    rewritten = [_edited(rng, _edited(rng, x)) for x in block]
    minus, plus = (lambda ls: [("removed", x) for x in ls]), (lambda ls: [("added", x) for x in ls])
    around = [("context", "before"), ("context", "")]
    found = {
        "rename only": [File("new/name.txt", "old/name.txt")],
        "rename with change": [File("n.py", "o.py", [around + minus(["a b"]) + plus(["a c"])])],
        "pure move": [File("a.py", hunks=[around + minus(block)]), File("b.py", hunks=[plus(block)])],
        "rewritten move": [File("a.py", hunks=[minus(block)]), File("b.py", hunks=[around + plus(rewritten)])],
        "move within a file": [File("a.go", hunks=[minus(block[:4]), around + minus(["x"]) + plus(["y z"]), plus(block[:4])])],
        "interleaved": [File("a.c", hunks=[[x for i in range(6) for x in (("removed", f"old {i} {i}"), ("added", f"entirely new thing {i}"))]])],
        "scattered": [File(f"d{i}/f{i}.rs", hunks=[plus([f"unique line number {i} {i * i}"])]) for i in range(9)],
        "large": [File("big.txt", hunks=[plus([f"row {i} of many" for i in range(70)])])],
        "only imports and blanks": [File("i.py", hunks=[plus(["import os", "from x import y", "", "   "]) + minus(["import  sys"])])],
        "white space only": [File("w.js", hunks=[minus(["a  b\t c"]) + plus(["a b c"])]), File("v.js", hunks=[plus(["a   b   c"])])],
        "equal lines many times": [File("e.txt", hunks=[minus(["same"] * 5 + ["other one"])]), File("g.txt", hunks=[plus(["same"] * 3 + ["another one", "same thing"])])],
        "several moves at once": [File(f"m{i}.kt", hunks=[minus([f"{w} {i}" for w in block[:5]]), plus([f"{w} {(i + 1) % 3}" for w in block[:5]])]) for i in range(3)],
    }
    for n in range(random_ones):
        pool = [_words(rng) for _ in range(12)]
        files = []
        for k in range(rng.randint(1, 4)):
            hunks = []
            for _ in range(rng.randint(1, 4)):
                lines = [(rng.choice(["added", "removed", "added", "removed", "context"]), rng.choice([rng.choice(pool), _edited(rng, rng.choice(pool)), "", "import alpha", " // note"])) for _ in range(rng.randint(1, 9))]
                hunks.append([*lines, ("added", rng.choice(pool))])
            files.append(File(f"r{n}/f{k}{rng.choice(['.py', '.js', '', '.tar.gz', '.PY'])}", None, hunks))
        found[f"random {n}"] = files
    return found
