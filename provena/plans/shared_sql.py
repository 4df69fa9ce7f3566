"""Named table expressions the SQL statements share (DuckDB dialect).

They restate ``provena.sources.tables`` and are put in front of a statement by
``stating(names, body)`` together with whatever they build on.
"""

from __future__ import annotations

EXPRESSIONS: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, sql: str, *needs: str) -> None:
    EXPRESSIONS[name] = (needs, sql)


def stating(names: str, body: str) -> str:
    """``body`` preceded by the named expressions and their own needs."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for need in EXPRESSIONS[name][0]:
            visit(need)
        order.append(name)

    for name in names.split():
        visit(name)
    parts = ",\n".join(f"{name} AS ({EXPRESSIONS[name][1]})" for name in order)
    return f"WITH RECURSIVE {parts}\n{body}"


define(
    "materials",
    """
SELECT doc_id // 20 AS task_no,
       'task_' || lpad((doc_id // 20)::VARCHAR, 32, '0') AS task_id,
       'art_' || lpad(doc_id::VARCHAR, 32, '0') AS artifact_id,
       doc_id, 'canonical_text' AS kind,
       'tasks/' || (doc_id // 20)::VARCHAR || '/inbox/' || source || '_' || doc_id::VARCHAR || '.txt' AS relative_path,
       doc_id AS created_at, text
FROM documents""",
)
define(
    "tasks",
    """
SELECT task_no, 'task_' || lpad(task_no::VARCHAR, 32, '0') AS task_id,
       ['created','running','awaiting_user','parked','completed','failed','cancelled'][(task_no % 7 + 1)::INT] AS status,
       CASE WHEN task_no % 2 = 0 THEN 'local_only' ELSE 'llm_allowed' END AS data_policy,
       1 + task_no % 2 AS epoch,
       'tver_' || lpad((task_no % 3)::VARCHAR, 32, '0') AS template_version_id,
       material_count
FROM (SELECT doc_id // 20 AS task_no, count(*) AS material_count FROM documents GROUP BY 1)""",
)
define(
    "contract_slots",
    """
SELECT 'tver_' || lpad(v::VARCHAR, 32, '0') AS template_version_id, slot_id, slot_pos,
       '{{ ' || slot_id || ' }}' AS placeholder, 'text_block' AS kind, TRUE AS required,
       slot_id = 'risks' AS allow_user_omit,
       CASE WHEN v = 2 AND slot_id = 'next_plan' THEN 'next steps' ELSE semantic END AS semantic_requirement,
       CASE WHEN v = 2 AND slot_id = 'next_plan' THEN 'note' ELSE 'body' END AS style_key,
       CASE WHEN v = 2 AND slot_id = 'next_plan' THEN NULL ELSE marker END AS marker
FROM (VALUES (0), (1), (2)) versions(v),
     (VALUES ('sales_summary', 0, 'weekly sales summary', 'sales'),
             ('risks', 1, 'open risk and dependency list', 'risk'),
             ('next_plan', 2, 'plan for the coming week', 'plan')) s(slot_id, slot_pos, semantic, marker)""",
)
define(
    "headed",
    """
SELECT * REPLACE (array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
         CASE WHEN (i - 1) % 3 = 0 THEN '## ' ||
              CASE (doc_id + i - 1) % 4 WHEN 0 THEN 'sales'
                   WHEN 1 THEN CASE WHEN task_no % 5 = 3 THEN 'notes' ELSE 'risk' END
                   WHEN 2 THEN 'plan' ELSE 'notes' END || ' ' || line
              ELSE line END), chr(10)) AS text)
FROM materials""",
    "materials",
)
define(
    "controlled",
    """
SELECT * REPLACE (array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
         CASE WHEN (doc_id + i - 1) % 13 = 0 THEN chr(7) || line ELSE line END), chr(10)) AS text)
FROM materials""",
    "materials",
)
define(
    "raw",
    """
SELECT * EXCLUDE (text, mixed), doc_id % 17 = 5 AS broken,
       CASE WHEN doc_id % 3 = 0 THEN replace(mixed, 'é', 'e' || chr(769)) ELSE mixed END AS raw_text
FROM (SELECT *, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
         line || CASE WHEN i = len(string_split(text, chr(10))) THEN ''
                      WHEN (i - 1) % 7 = 6 THEN chr(13) || chr(10)
                      WHEN (i - 1) % 11 = 10 THEN chr(13) ELSE chr(10) END), '') AS mixed
      FROM materials)""",
    "materials",
)
define(
    "log",
    """
SELECT event_id AS seq, 'task_' || lpad(user_id::VARCHAR, 32, '0') AS task_id, user_id,
       event_type AS event_code, ts AS created_at, value, props
FROM events""",
)
