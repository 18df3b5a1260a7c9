"""The same tables as common table expressions for DuckDB, and a builder that adds those a statement needs."""

from __future__ import annotations

import re

_ACCENTS, _BASES = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def tok(x: str) -> str:
    return f"regexp_extract_all(translate(regexp_replace(lower(coalesce({x}, '')), '([{_ACCENTS}])', '\\1 ', 'g'), '{_ACCENTS}', '{_BASES}'), '[a-z0-9]+(?:\\.[0-9]+)?')"


def norm(x: str) -> str:
    return f"array_to_string({tok(x)}, ' ')"


def _bm25(units: str, questions: str, allowed: str, b: float, p: str) -> dict[str, str]:
    """CTEs with prefix ``p``; the result is ``{p}_top(query_id, rank, unit_id, doc_id, score)``."""
    return {
        f"{p}_st": f"SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM {units}",
        f"{p}_po": f"SELECT unit_id, doc_id, n_t, token, count(*) AS tf FROM (SELECT unit_id, doc_id, len(t) AS n_t, unnest(t) AS token FROM {units}) GROUP BY ALL",
        f"{p}_df": f"SELECT token, count(*) AS df FROM {p}_po GROUP BY token",
        f"{p}_hit": f"SELECT a.query_id, p.unit_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (1 - {b} + {b} * n_t / avgdl))) AS score FROM {questions} JOIN {p}_po p USING (token) JOIN {p}_df USING (token) JOIN {allowed} a ON a.query_id = {questions}.query_id AND a.doc_id = p.doc_id CROSS JOIN {p}_st GROUP BY ALL",
        f"{p}_can": f"SELECT a.query_id, u.unit_id, u.doc_id, coalesce(h.score, 0) AS score FROM {allowed} a JOIN {units} u ON u.doc_id = a.doc_id LEFT JOIN {p}_hit h ON h.query_id = a.query_id AND h.unit_id = u.unit_id",
        f"{p}_top": f"SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, unit_id) AS rank, unit_id, doc_id, score FROM {p}_can) WHERE rank <= 4",
    }


CTES = {
    "d": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) AS unit_id, text, source, {tok('text')} AS t FROM documents",
    "q": f"SELECT printf('bench-%06d', item_id) AS query_id, CASE WHEN item_id % 10 < 7 THEN 'dev' ELSE 'test' END AS split, item_id AS source_row, text AS question, text AS golden_answer, {tok('text')} AS qt, {norm('text')} AS g FROM benchmark",
    "qtok": "SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(qt) AS token FROM q)",
    "al": "SELECT q.query_id, d.doc_id FROM q JOIN d ON d.source = 'src' || (source_row % 20) UNION SELECT q.query_id, d.doc_id FROM q JOIN d ON len(qt) >= 4 AND contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || g || ' ')",
    **_bm25("d", "qtok", "al", 0.75, "ba"),
    **_bm25("d", "qtok", "al", 0.0, "bb"),
    "ranked2": "SELECT 'bm25' AS arm, * FROM ba_top UNION ALL SELECT 'bm25_flat' AS arm, * FROM bb_top",
    "armq": "SELECT * FROM q CROSS JOIN (VALUES ('bm25'), ('bm25_flat')) a(arm)",
    "txt": "SELECT arm, query_id, " + ", ".join(f"{norm(f'''string_agg(text, ' ' ORDER BY rank) FILTER (rank <= {k})''')} AS c{k}" for k in range(1, 5)) + " FROM ranked2 JOIN d USING (unit_id) GROUP BY ALL",
    "fl": "SELECT armq.arm, armq.query_id, source_row, split, g, qt, c1, c2, c3, c4, " + ", ".join(f"coalesce(g <> '' AND contains(c{k}, g), false) AS exact_{k}" for k in range(1, 5)) + " FROM armq LEFT JOIN txt ON txt.arm = armq.arm AND txt.query_id = armq.query_id",
    "fulld": "SELECT query_id, coalesce(g <> '' AND contains(j, g), false) AS exact_full FROM q LEFT JOIN (SELECT query_id, string_agg(array_to_string(t, ' '), ' ' ORDER BY doc_id) AS j FROM al JOIN d USING (doc_id) GROUP BY query_id) USING (query_id)",
    "ju": "SELECT query_id, arm, source_row, CASE WHEN source_row % 19 = 0 THEN '' WHEN exact_4 THEN 'CORRECT' ELSE 'INCORRECT' END AS verdict, CASE WHEN source_row % 19 <> 0 AND source_row % 17 <> 0 THEN 1 + exact_1::INT + exact_2::INT + exact_3::INT + exact_4::INT END AS score, CASE WHEN source_row % 19 = 0 THEN 'failed' ELSE '' END AS judge_error, CASE WHEN source_row % 17 = 0 AND source_row % 19 <> 0 THEN 'content_filter' ELSE '' END AS judge_fallback, source_row + 100 AS judge_total_tokens FROM fl",
    "para": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, i - 1 AS paragraph_idx, CAST(doc_id AS VARCHAR) || '|' || (i - 1) AS unit_id, line AS text, {tok('line')} AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> ''",
    "al1": "SELECT query_id, doc_id FROM ba_top WHERE rank = 1",
    **_bm25("para", "qtok", "al", 0.75, "bp"),
    **_bm25("para", "qtok", "al1", 0.75, "b1"),
    "anc": "SELECT t.query_id, t.rank, t.doc_id, p.paragraph_idx FROM b1_top t JOIN para p USING (unit_id)",
    "pos": "SELECT doc_id, paragraph_idx, text, row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_idx) AS position FROM para",
    "win": "SELECT a.query_id, a.rank, a.doc_id, n.position, n.text, row_number() OVER (PARTITION BY a.query_id, a.doc_id, n.position ORDER BY a.rank) = 1 AS is_first FROM anc a JOIN pos p ON p.doc_id = a.doc_id AND p.paragraph_idx = a.paragraph_idx JOIN pos n ON n.doc_id = a.doc_id AND n.position BETWEEN p.position - 2 AND p.position + 2",
    "pairs": "SELECT query_id, bool_or(exact_1) FILTER (arm = 'bm25') AS a, bool_or(exact_1) FILTER (arm = 'bm25_flat') AS b FROM fl GROUP BY query_id",
    "pscore": "SELECT query_id, max(score) FILTER (arm = 'bm25') AS a, max(score) FILTER (arm = 'bm25_flat') AS b FROM ju GROUP BY query_id",
}


def with_tables(statement: str) -> str:
    """``statement`` behind the common table expressions that it uses, directly or not."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", sql):
                needed.add(name)
                visit(CTES[name])

    visit(statement)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {head}\n{statement}" if head else statement
