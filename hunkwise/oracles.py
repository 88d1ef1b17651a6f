"""The queries of ``queries`` as SQL for DuckDB: a chain of common table expressions, cut to what a query needs."""

from __future__ import annotations

import re

from hunkwise.operators.metrics import default_registry
from hunkwise.sources.workloads import LINEITEM_CONFIG as C


def _round(x: str, digits: int) -> str:
    """Rounding on the exact binary value, as a scalar subquery over ``x``."""
    n = f"{10**digits}e0"
    return (
        f"(SELECT (f + CASE WHEN p - f > 0.5e0 OR (p - f = 0.5e0 AND (e > 0e0 OR (e = 0e0 AND f % 2 = 1))) THEN 1e0 ELSE 0e0 END) / {n} FROM ("
        f"SELECT p, floor(p) AS f, (hi * {n} - p) + (x - hi) * {n} AS e FROM (SELECT x, x * {n} AS p, (x * 134217729e0) - ((x * 134217729e0) - x) AS hi FROM (SELECT CAST({x} AS DOUBLE) AS x))))"
    )


def _ppm(x: str) -> str:
    return f"CAST(floor({x} * 1e6 + 0.5e0) AS BIGINT)"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_PATH = "'src/p' || substr(o_orderpriority, 1, 1) || CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN '.py' WHEN '2' THEN '.JS' WHEN '3' THEN '.md' WHEN '4' THEN '.tar.py' ELSE '' END"
_EXT = r"regexp_extract(lower({path}), '[^/](\.[^/.]+)$', 1)"
_TABLE = {k: v for k, v in C.excluded_prefixes.items() if v}
_PREFIXES = "CASE " + " ".join(f"WHEN {{ext}} = {_lit(k)} THEN [{', '.join(map(_lit, v))}]" for k, v in _TABLE.items() if k != "*") + f" ELSE [{', '.join(map(_lit, _TABLE['*']))}] END"

_M = {m.name: m for r in [default_registry(C)] for m in (*r.hunk_metrics(), *r.move_metrics(), *r.overall_metrics())}

CTES: dict[str, str] = {
    "named": f"""SELECT o.o_custkey AS diff_id, {_PATH} AS file_path, l.l_orderkey, p.p_name AS raw,
        row_number() OVER (PARTITION BY l.l_orderkey ORDER BY l_linenumber, l.l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq,
        CASE l_returnflag WHEN 'A' THEN 'added' WHEN 'R' THEN 'removed' ELSE 'context' END AS kind
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN part p ON p.p_partkey = l.l_partkey""",
    "change_lines": """SELECT *, dense_rank() OVER (PARTITION BY diff_id ORDER BY file_path) - 1 AS file_idx,
        dense_rank() OVER (PARTITION BY diff_id ORDER BY file_path, l_orderkey) - 1 AS hunk_idx FROM named""",
    "filtered": rf"""SELECT *, kind <> 'context' AND norm <> '' AND len(list_filter({_PREFIXES.format(ext=_EXT.format(path='file_path'))}, lambda x: starts_with(norm, x))) = 0 AS kept
        FROM (SELECT *, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS norm FROM change_lines)""",
    "switched": """SELECT diff_id, hunk_idx, CAST(kind <> lag(kind) OVER (PARTITION BY diff_id, hunk_idx ORDER BY seq) AS INT) AS s FROM filtered WHERE kept""",
    "switches": "SELECT diff_id, hunk_idx, coalesce(sum(s), 0) AS switches FROM switched GROUP BY ALL",
    "counted": """SELECT diff_id, file_idx, hunk_idx, any_value(file_path) AS file_path, count(CASE WHEN kept AND kind = 'added' THEN 1 END) AS a, count(CASE WHEN kept AND kind = 'removed' THEN 1 END) AS r, count(CASE WHEN kind = 'context' THEN 1 END) AS c
        FROM filtered GROUP BY ALL""",
    "hunks": f"""SELECT h.*, a + r AS n, CASE WHEN a + r = 0 THEN 0e0 ELSE a / CAST(a + r AS DOUBLE) END AS balance_raw,
        CASE WHEN a + r < 4 THEN 0e0 ELSE switches / CAST(a + r - 1 AS DOUBLE) END AS inter_raw,
        {_round("CASE WHEN a + r < 4 THEN 0e0 ELSE switches / CAST(a + r - 1 AS DOUBLE) END", 2)} AS inter,
        {_round("CASE WHEN a + r = 0 THEN 0e0 ELSE a / CAST(a + r AS DOUBLE) END", 2)} AS balance
        FROM counted h LEFT JOIN switches USING (diff_id, hunk_idx)""",
    "sided": """SELECT diff_id, hunk_idx, kind, norm, row_number() OVER (PARTITION BY diff_id, hunk_idx, kind ORDER BY seq) AS pos,
        row_number() OVER (PARTITION BY diff_id, hunk_idx, kind, norm ORDER BY seq) AS occ FROM filtered WHERE kept""",
    "text_counts": "SELECT diff_id, hunk_idx, kind, norm, count(*) AS k FROM sided GROUP BY ALL",
    "ways": """SELECT x.diff_id, x.hunk_idx AS x, y.hunk_idx AS y, least(x.hunk_idx, y.hunk_idx) AS i, greatest(x.hunk_idx, y.hunk_idx) AS j, CAST(x.hunk_idx > y.hunk_idx AS BIGINT) AS dir, greatest(x.r, y.a) AS longest
        FROM counted x JOIN counted y ON x.diff_id = y.diff_id AND x.hunk_idx <> y.hunk_idx WHERE least(x.r, y.a) > 0 AND least(x.r, y.a) >= 0.3e0 * greatest(x.r, y.a)""",
    "exact": """SELECT w.diff_id, w.x, w.y, i, j, dir, any_value(longest) AS longest, CAST(coalesce(sum(CASE WHEN c.k IS NOT NULL THEN least(g.k, c.k) END), 0) AS BIGINT) AS exact
        FROM ways w LEFT JOIN text_counts g ON g.diff_id = w.diff_id AND g.hunk_idx = w.x AND g.kind = 'removed'
        LEFT JOIN text_counts c ON c.diff_id = w.diff_id AND c.hunk_idx = w.y AND c.kind = 'added' AND c.norm = g.norm GROUP BY ALL""",
    "gone": """SELECT w.diff_id, w.x, w.y, s.pos, s.norm FROM ways w JOIN sided s ON s.diff_id = w.diff_id AND s.hunk_idx = w.x AND s.kind = 'removed'
        LEFT JOIN text_counts c ON c.diff_id = w.diff_id AND c.hunk_idx = w.y AND c.kind = 'added' AND c.norm = s.norm WHERE s.occ > coalesce(c.k, 0)""",
    "come": """SELECT w.diff_id, w.x, w.y, s.pos, s.norm FROM ways w JOIN sided s ON s.diff_id = w.diff_id AND s.hunk_idx = w.y AND s.kind = 'added'
        LEFT JOIN text_counts c ON c.diff_id = w.diff_id AND c.hunk_idx = w.x AND c.kind = 'removed' AND c.norm = s.norm WHERE s.occ > coalesce(c.k, 0)""",
    "texts": "SELECT DISTINCT p_name AS t FROM part",
    "programme": """SELECT x.t AS a, y.t AS b, 0 AS k, list_transform(range(0, length(y.t) + 1), lambda z: 0) AS cells FROM texts x, texts y
        UNION ALL SELECT a, b, k + 1, list_transform(range(0, length(b) + 1), lambda z: CASE WHEN z = 0 THEN 0 ELSE list_max(list_transform(range(1, z + 1),
          lambda q: CASE WHEN substr(b, q, 1) = substr(a, k + 1, 1) THEN cells[q] + 1 ELSE cells[q + 1] END)) END) FROM programme WHERE k < length(a)""",
    "ratios": """SELECT a, b, (1e0 - (length(a) + length(b) - 2 * cells[-1]) / CAST(length(a) + length(b) AS DOUBLE)) * 100e0 / 100e0 AS ratio FROM programme WHERE k = length(a)""",
    "scored": """SELECT g.diff_id, g.x, g.y, g.pos AS gi, c.pos AS ci, ratio, row_number() OVER (PARTITION BY g.diff_id, g.x, g.y ORDER BY ratio DESC, g.pos, c.pos) AS rk
        FROM gone g JOIN come c ON c.diff_id = g.diff_id AND c.x = g.x AND c.y = g.y JOIN ratios ON a = g.norm AND b = c.norm WHERE ratio >= 0.3e0""",
    "line_rounds": """SELECT diff_id, x, y, gi, ci, ratio, rk, 0 AS round, false AS taken FROM scored
        UNION ALL SELECT diff_id, x, y, gi, ci, ratio, rk, round + 1, first FROM (
          SELECT *, bool_or(first) OVER (PARTITION BY diff_id, x, y, gi) AS gt, bool_or(first) OVER (PARTITION BY diff_id, x, y, ci) AS ct FROM (
            SELECT *, rk = min(rk) OVER (PARTITION BY diff_id, x, y, gi) AND rk = min(rk) OVER (PARTITION BY diff_id, x, y, ci) AS first FROM line_rounds WHERE NOT taken))
        WHERE first OR NOT (gt OR ct)""",
    "line_totals": "SELECT diff_id, x, y, count(*) AS matches, sum(ratio ORDER BY rk) AS total FROM line_rounds WHERE taken GROUP BY ALL",
    "pairs": """SELECT diff_id, i, j, max((exact + coalesce(total, 0e0)) / longest) AS similarity FROM exact LEFT JOIN line_totals USING (diff_id, x, y) GROUP BY ALL HAVING similarity >= 0.3e0""",
    "ranked_pairs": "SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY similarity DESC, i, j) AS rk FROM pairs",
    "ends": """SELECT diff_id, rk, i, j, similarity, unnest([i, j]) AS node FROM ranked_pairs""",
    "hunk_rounds": """SELECT diff_id, rk, i, j, similarity, node, 0 AS round, false AS taken FROM ends
        UNION ALL SELECT diff_id, rk, i, j, similarity, node, round + 1, won FROM (
          SELECT *, bool_or(hit) OVER (PARTITION BY diff_id, rk) AS gone FROM (
            SELECT *, bool_or(won) OVER (PARTITION BY diff_id, node) AS hit FROM (
              SELECT *, bool_and(best) OVER (PARTITION BY diff_id, rk) AS won FROM (
                SELECT *, rk = min(rk) OVER (PARTITION BY diff_id, node) AS best FROM hunk_rounds WHERE NOT taken))))
        WHERE won OR NOT gone""",
    "picked": "SELECT DISTINCT diff_id, i, j, similarity FROM hunk_rounds WHERE taken",
    "moved": f"""SELECT *, {_round("complexity_raw", 2)} AS complexity FROM (SELECT p.diff_id, p.i - (SELECT count(*) FROM picked q WHERE q.diff_id = p.diff_id AND q.j < p.i) AS move_id, p.i, p.j, similarity,
        CASE WHEN similarity >= 0.9e0 THEN 'pure' ELSE 'modified' END AS move_type, greatest(x.n, y.n) AS length,
        greatest(0e0, 1e0 - greatest(x.n, y.n) * ((1e0 + {float(C.move_similarity_penalty)}e0 * (1e0 - similarity)) / {C.max_move_lines})) AS complexity_raw
        FROM picked p JOIN hunks x ON x.diff_id = p.diff_id AND x.hunk_idx = p.i JOIN hunks y ON y.diff_id = p.diff_id AND y.hunk_idx = p.j)""",
    "in_moves": "SELECT diff_id, unnest([i, j]) AS hunk_idx, move_id, move_type FROM moved",
    "alone": f"""SELECT *, greatest(0e0, 1e0 - (CAST(n AS DOUBLE) / {C.max_hunk_lines}) * (1e0 + {C.weights.interleaving_weight}e0 * inter)) AS score FROM hunks h ANTI JOIN in_moves m USING (diff_id, hunk_idx)""",
    "files": f"""SELECT diff_id, file_idx, any_value(file_path) AS path, count(*) AS hunk_count, CAST(sum(n) AS BIGINT) AS lines_changed, greatest(0e0, 1e0 - CAST(sum(n) AS DOUBLE) / {C.max_diff_lines}) AS score FROM hunks GROUP BY ALL""",
    "file_sums": f"""SELECT diff_id, count(*) AS files_changed, sum(lines_changed) AS total, count(CASE WHEN lines_changed > 0 THEN 1 END) AS busy, count(CASE WHEN score < {C.file_score_threshold} AND hunk_count > 1 THEN 1 END) AS bad_files FROM files GROUP BY ALL""",
    "entropy": """SELECT f.diff_id, -sum((lines_changed / CAST(total AS DOUBLE)) * log2(lines_changed / CAST(total AS DOUBLE)) ORDER BY file_idx) AS h FROM files f JOIN file_sums USING (diff_id) WHERE lines_changed > 0 GROUP BY ALL""",
    "hunk_sums": f"""SELECT diff_id, sum(n) AS lines_changed, sum(a) AS added_lines, count(CASE WHEN score < {C.hunk_score_threshold} THEN 1 END) AS bad_hunks,
        sum(inter * greatest(n, 1) ORDER BY hunk_idx) / sum(CAST(greatest(n, 1) AS DOUBLE)) AS mean_raw FROM alone GROUP BY ALL""",
    "move_sums": f"SELECT diff_id, count(CASE WHEN complexity < {C.hunk_score_threshold} THEN 1 END) AS bad_moves FROM moved GROUP BY ALL",
    "summed": f"""SELECT diff_id, files_changed, CAST(coalesce(lines_changed, 0) AS BIGINT) AS lines_changed, CAST(coalesce(added_lines, 0) AS BIGINT) AS added_lines, coalesce(bad_hunks, 0) AS bad_hunks, coalesce(bad_moves, 0) AS bad_moves, bad_files,
        coalesce(mean_raw, 0e0) AS mean_raw, CASE WHEN files_changed <= 1 OR total = 0 OR busy < 2 THEN 0e0 ELSE h / log2(CAST(busy AS DOUBLE)) END AS scatter_raw
        FROM file_sums LEFT JOIN hunk_sums USING (diff_id) LEFT JOIN move_sums USING (diff_id) LEFT JOIN entropy USING (diff_id)""",
    "rounded": f"""SELECT *, {_round("scatter_raw", 2)} AS scatter, {_round(_round("mean_raw", 4), 2)} AS mean_inter FROM summed""",
    "overall": f"""SELECT *, greatest(0e0, 1e0 - least(CAST(lines_changed AS DOUBLE) / {C.max_diff_lines}, 1e0) * (1e0 + {C.weights.interleaving_weight}e0 * mean_inter)) AS score FROM rounded""",
    "violated": f"""SELECT diff_id, 0 AS section, hunk_idx AS subject, 0 AS ord, '[WARNING] Hunk has ' || n || ' lines, exceeds limit of {C.max_hunk_lines}' AS text FROM alone WHERE n > {C.max_hunk_lines}
        UNION ALL SELECT diff_id, 1, 0, 0, '[ERROR] Diff has ' || lines_changed || ' lines changed, exceeds limit of {C.max_diff_lines}' FROM overall WHERE lines_changed > {C.max_diff_lines}
        UNION ALL SELECT diff_id, 1, 0, 1, '[ERROR] Overall score ' || printf('%.2f', {_round("score", 2)}) || ' is below the minimum of {C.min_overall_score}' FROM overall WHERE score < {C.min_overall_score}
        UNION ALL SELECT diff_id, 1, 0, 2, '[WARNING] Diff has ' || bad_hunks || ' problematic hunks, exceeds limit of {C.max_problematic_hunks}' FROM overall WHERE bad_hunks > {C.max_problematic_hunks}
        UNION ALL SELECT diff_id, 1, 0, 3, '[WARNING] Diff has ' || bad_moves || ' problematic moves, exceeds limit of {C.max_problematic_moves}' FROM overall WHERE bad_moves > {C.max_problematic_moves}
        UNION ALL SELECT diff_id, 1, 0, 4, '[WARNING] Diff has ' || bad_files || ' problematic files, exceeds limit of {C.max_problematic_files}' FROM overall WHERE bad_files > {C.max_problematic_files}
        UNION ALL SELECT diff_id, 1, 0, 5, '[ERROR] Diff touches ' || files_changed || ' files, exceeds limit of {C.max_files_changed}' FROM overall WHERE files_changed > {C.max_files_changed}
        UNION ALL SELECT diff_id, 1, 0, 6, '[ERROR] Diff has ' || added_lines || ' added lines, exceeds limit of {C.max_added_lines}' FROM overall WHERE added_lines > {C.max_added_lines}""",
    "gated": f"""SELECT diff_id, {_round("raw_score", 2)} AS score, passed, violations FROM (SELECT o.diff_id, any_value(o.score) AS raw_score, coalesce(bool_and(NOT starts_with(text, '[ERROR]')), true) AS passed, coalesce(string_agg(text, '|' ORDER BY section, subject, ord), '') AS violations
        FROM overall o LEFT JOIN violated v USING (diff_id) GROUP BY o.diff_id)""",
    "advised": f"""SELECT diff_id, 0 AS section, hunk_idx AS subject, 4 AS ord, file_path AS location, 'hunk.change_balance' AS metric, balance AS value FROM alone WHERE score < {C.hunk_score_threshold}
        UNION ALL SELECT diff_id, 0, hunk_idx, 5, file_path, 'hunk.interleaving', inter FROM alone WHERE score < {C.hunk_score_threshold} AND inter_raw > 0
        UNION ALL SELECT diff_id, 1, i, 0, 'move:' || move_id, 'move.edit_complexity', complexity FROM moved WHERE complexity < {C.hunk_score_threshold}
        """
    + "".join(f" UNION ALL SELECT diff_id, 2, 0, {k}, 'overall', 'overall.{m}', CAST({c} AS DOUBLE) FROM overall" for k, (m, c) in enumerate([("files_changed", "files_changed"), ("lines_changed", "lines_changed"), ("added_lines", "added_lines"), ("problematic_hunk_count", "bad_hunks"), ("problematic_move_count", "bad_moves"), ("problematic_file_count", "bad_files")]))
    + " UNION ALL SELECT diff_id, 2, 0, 7, 'overall', 'overall.mean_interleaving', mean_inter FROM overall WHERE mean_raw > 0.1e0",
    "recommended": "SELECT *, CASE metric " + " ".join(f"WHEN {_lit(n)} THEN {_lit(m.remediation)}" for n, m in _M.items() if m.remediation) + " END AS remediation FROM advised SEMI JOIN (SELECT diff_id FROM gated WHERE NOT passed) USING (diff_id)",
}



def _quoted(x: str) -> str:
    return f"""'"' || {x} || '"'"""


def _metrics(**values: str) -> str:
    return " || ',' || ".join(f"""'{{"name":"{name.replace('__', '.')}","value":' || CAST({value} AS VARCHAR) || '}}'""" for name, value in values.items())


def _listed(entry: str, order: str) -> str:
    return f"'[' || coalesce(string_agg({entry}, ',' ORDER BY {order}), '') || ']'"


_WHOLE = ", ".join(_lit(n) for n, m in _M.items() if m.value_type == "integer")
CTES |= {
    "json_hunks": f"""SELECT diff_id, count(*) AS h, {_listed(f"""'{{"file":' || {_quoted("file_path")} || ',"score":' || CAST({_round("score", 2)} AS VARCHAR) || ',"metrics":[' || {_metrics(hunk__lines_changed="n", hunk__added_lines="a", hunk__removed_lines="r", hunk__context_lines="c", hunk__change_balance="balance", hunk__interleaving="inter")} || ']}}'""", "hunk_idx")} AS hunks FROM alone GROUP BY ALL""",
    "json_moves": f"""SELECT diff_id, {_listed(f"""'{{"move_id":' || move_id || ',"hunk_count":2,"score":' || CAST({_round("complexity", 2)} AS VARCHAR) || ',"metrics":[' || {_metrics(move__edit_complexity="complexity")} || ']}}'""", "i")} AS moves FROM moved GROUP BY ALL""",
    "json_files": f"""SELECT diff_id, {_listed(f"""'{{"file":' || {_quoted("path")} || ',"score":' || CAST({_round("score", 2)} AS VARCHAR) || ',"metrics":[' || {_metrics(file__lines_changed="lines_changed")} || ']}}'""", "file_idx")} AS files FROM files GROUP BY ALL""",
    "json_rules": f"""SELECT diff_id, {_listed(_quoted("text"), "section, subject, ord")} AS violations FROM violated GROUP BY ALL""",
    "json_advice": f"""SELECT diff_id, {_listed(f"""'{{"location":' || {_quoted("location")} || ',"metric":' || {_quoted("metric")} || ',"value":' || CASE WHEN metric IN ({_WHOLE}) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ',"remediation":' || {_quoted("remediation")} || '}}'""", "section, subject, ord")} AS advice FROM recommended GROUP BY ALL""",
}

_DOC_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_COMPARED = f"SELECT DISTINCT a, b, {_ppm('ratio')} AS ratio_ppm FROM gone g JOIN come c ON c.diff_id = g.diff_id AND c.x = g.x AND c.y = g.y JOIN ratios ON a = g.norm AND b = c.norm"

FINAL: dict[str, str] = {
    "line_kinds": "SELECT diff_id, kind, count(*) AS n FROM change_lines GROUP BY ALL",
    "line_normalise": rf"SELECT doc_id, CAST(pos AS BIGINT) AS pos, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS norm FROM {_DOC_LINES} WHERE trim(regexp_replace(raw, '\s+', ' ', 'g')) <> ''",
    "file_extension": f"SELECT path, {_EXT.format(path='path')} AS ext FROM (SELECT DISTINCT file_path AS path FROM change_lines UNION ALL SELECT url FROM pages)",
    "prefix_lookup": f"SELECT file_path, array_to_string({_PREFIXES.format(ext=_EXT.format(path='file_path'))}, '|') AS prefixes FROM (SELECT DISTINCT file_path FROM change_lines)",
    "prefix_filter": "SELECT diff_id, file_path, count(CASE WHEN kept THEN 1 END) AS kept, count(CASE WHEN NOT kept THEN 1 END) AS left_out FROM filtered GROUP BY ALL",
    "hunk_build": """SELECT diff_id, hunk_idx, any_value(file_path) AS file_path, coalesce(string_agg(norm, '|' ORDER BY seq) FILTER (kept AND kind = 'added'), '') AS added,
        coalesce(string_agg(norm, '|' ORDER BY seq) FILTER (kept AND kind = 'removed'), '') AS removed, coalesce(string_agg(raw, '|' ORDER BY seq) FILTER (kind = 'context'), '') AS context,
        coalesce(string_agg(kind, '|' ORDER BY seq) FILTER (kept), '') AS change_order FROM filtered GROUP BY diff_id, hunk_idx""",
    "hunk_counts": "SELECT diff_id, hunk_idx, n AS lines_changed, a AS added_lines, r AS removed_lines, c AS context_lines FROM hunks",
    "hunk_change_balance": "SELECT diff_id, hunk_idx, balance AS change_balance FROM hunks",
    "hunk_interleaving": "SELECT diff_id, hunk_idx, inter AS interleaving FROM hunks",
    "event_interleaving": f"""SELECT user_id, day, changes, {_round("v", 2)} AS interleaving FROM (SELECT user_id, day, count(*) AS changes, CASE WHEN count(*) < 4 THEN 0e0 ELSE coalesce(sum(s), 0) / CAST(count(*) - 1 AS DOUBLE) END AS v FROM (
        SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, CAST(k <> lag(k) OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) AS INT) AS s
        FROM (SELECT *, event_type IN ('click', 'view') AS k FROM events WHERE event_type <> 'signup')) GROUP BY user_id, day)""",
    "hunk_score": f"SELECT diff_id, hunk_idx, {_round('score', 4)} AS score FROM alone",
    "file_score": f"SELECT diff_id, path, hunk_count, lines_changed, {_round('score', 4)} AS score FROM files",
    "pair_candidates": "SELECT diff_id, i, j, dir FROM ways",
    "exact_line_match": "SELECT diff_id, i, j, dir, exact, longest FROM exact",
    "line_similarity": _COMPARED,
    "line_similarity_builtin": _COMPARED,
    "line_greedy_match": f"SELECT t.diff_id, i, j, dir, matches, {_ppm('total')} AS total_ppm FROM line_totals t JOIN ways USING (diff_id, x, y)",
    "pair_similarity": f"SELECT diff_id, i, j, {_ppm('similarity')} AS similarity_ppm FROM pairs",
    "moves": f"SELECT diff_id, move_id, i, j, {_ppm('similarity')} AS similarity_ppm, move_type, length FROM moved",
    "move_edit_complexity": "SELECT diff_id, move_id, complexity AS edit_complexity, complexity AS score FROM moved",
    "hunk_type": """SELECT h.diff_id, h.hunk_idx, CASE WHEN move_type = 'pure' THEN 'move' WHEN move_type IS NOT NULL THEN 'mixed' WHEN a > 0 AND r = 0 THEN 'pure_addition' WHEN r > 0 AND a = 0 THEN 'pure_deletion' ELSE 'mixed' END AS hunk_type
        FROM hunks h LEFT JOIN in_moves m USING (diff_id, hunk_idx)""",
    "singleton_hunks": "SELECT diff_id, hunk_idx FROM alone",
    "move_members": "SELECT diff_id, hunk_idx, move_id FROM in_moves",
    "overall_sizes": "SELECT diff_id, files_changed, lines_changed, added_lines FROM overall",
    "problematic_counts": "SELECT diff_id, bad_hunks AS hunks, bad_moves AS moves, bad_files AS files FROM overall",
    "scatter_factor": "SELECT diff_id, scatter AS scatter_factor FROM overall",
    "mean_interleaving": "SELECT diff_id, mean_inter AS mean_interleaving FROM overall",
    "overall_score": f"SELECT diff_id, {_round('score', 4)} AS score FROM overall",
    "rule_violations": "SELECT diff_id, CAST(section AS BIGINT) AS section, CAST(subject AS BIGINT) AS subject, text FROM violated",
    "gate": "SELECT diff_id, score, passed, violations FROM gated",
    "recommendations": "SELECT diff_id, CAST(section AS BIGINT) AS section, CAST(subject AS BIGINT) AS subject, CAST(ord AS BIGINT) AS ord, location, metric, value, remediation FROM recommended",
    "report_counts": """SELECT g.diff_id, score, passed, files_changed, coalesce(h, 0) AS hunks_changed, coalesce(k, 0) AS advice FROM gated g JOIN (SELECT diff_id, files_changed FROM overall) USING (diff_id)
        LEFT JOIN (SELECT diff_id, count(*) AS h FROM alone GROUP BY ALL) USING (diff_id) LEFT JOIN (SELECT diff_id, count(*) AS k FROM recommended GROUP BY ALL) USING (diff_id)""",
    "report_json_text": f"""SELECT diff_id, '{{"score":' || CAST(g.score AS VARCHAR) || ',"passed":' || CASE WHEN passed THEN 'true' ELSE 'false' END || ',"violations":' || coalesce(r.violations, '[]') || ',"recommendations":' || coalesce(advice, '[]')
        || ',"files_changed":' || files_changed || ',"hunks_changed":' || coalesce(h, 0) || ',"overall":['
        || {_metrics(overall__files_changed="files_changed", overall__lines_changed="lines_changed", overall__added_lines="added_lines", overall__problematic_hunk_count="bad_hunks", overall__problematic_move_count="bad_moves", overall__problematic_file_count="bad_files", overall__scatter_factor="scatter", overall__mean_interleaving="mean_inter")}
        || '],"files":' || files || ',"moves":' || coalesce(moves, '[]') || ',"hunks":' || coalesce(hunks, '[]') || '}}' AS json
        FROM gated g JOIN overall o USING (diff_id) JOIN json_files USING (diff_id) LEFT JOIN json_rules r USING (diff_id) LEFT JOIN json_advice USING (diff_id) LEFT JOIN json_moves USING (diff_id) LEFT JOIN json_hunks USING (diff_id)""",
    "parse_patches": "SELECT diff_id, file_path, hunk_idx, seq, kind, raw FROM change_lines",
    "custom_metric": """SELECT f.diff_id, coalesce(m, 0) AS longest_line FROM (SELECT DISTINCT diff_id FROM files) f LEFT JOIN (
        SELECT a.diff_id, max(coalesce(w, 0)) AS m FROM alone a LEFT JOIN (SELECT diff_id, hunk_idx, max(length(norm)) AS w FROM filtered WHERE kept GROUP BY ALL) USING (diff_id, hunk_idx) GROUP BY ALL) USING (diff_id)""",
}


def sql(final: str) -> str:
    """``final`` behind the expressions that it refers to, directly or not."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in CTES:
            if name not in wanted and re.search(rf"\b{name}\b", text):
                wanted.add(name)
                need(CTES[name])

    need(final)
    chain = ",\n".join(f"{n} AS ({t})" for n, t in CTES.items() if n in wanted)
    return f"WITH RECURSIVE {chain}\n{final}" if chain else final


ORACLE_SQL = {name: sql(final) for name, final in FINAL.items()}
