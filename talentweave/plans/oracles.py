"""DuckDB SQL with the result of each query; every statement carries the views it needs."""

from __future__ import annotations

import re

INITCAP = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ')"


def initcap(x: str) -> str:
    return INITCAP.format(x)


def letters(x: str) -> str:
    return f"translate({x}, '_0123456789', ' abcdefghij')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

VIEWS = {
    "sel_lines": """
        SELECT o.o_custkey AS num, o.o_orderkey, l.l_linenumber, l.l_quantity, p.p_name, p.p_brand, s.s_name,
               year(o.o_orderdate) AS y
        FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN part p ON p.p_partkey = l.l_partkey
        JOIN supplier s ON s.s_suppkey = l.l_suppkey""",
    "profile": """
        SELECT c.c_custkey AS num, concat('A', CAST(c.c_custkey AS VARCHAR)) AS id,
               translate(c.c_name, '#0123456789', ' abcdefghij') AS name,
               concat('user', CAST(c.c_custkey AS VARCHAR), '@example.com') AS email,
               concat(n.n_name, ', ', r.r_name) AS location, r.r_name, x.total_experience
        FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
        JOIN (SELECT o_custkey, max(year(o_orderdate)) - min(year(o_orderdate)) AS total_experience
              FROM orders GROUP BY o_custkey) x ON x.o_custkey = c.c_custkey""",
    "profile_skill": "SELECT DISTINCT num, p_brand AS skill FROM sel_lines",
    "profile_title": "SELECT DISTINCT num, p_name AS title FROM sel_lines",
    "first_line": """
        SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY o_orderkey
            ORDER BY l_linenumber, p_name, p_brand, s_name, l_quantity) AS rn FROM sel_lines q) z WHERE rn = 1""",
    "profile_job": """
        SELECT num, o_orderkey, row_number() OVER (PARTITION BY num ORDER BY y DESC, o_orderkey) AS pos,
               p_name AS title, s_name AS company, y,
               concat(CAST(y AS VARCHAR), ' - ', CAST(y + 1 AS VARCHAR)) AS period FROM first_line""",
    "posting": """
        SELECT o.o_orderkey AS num, concat('B', CAST(o.o_orderkey AS VARCHAR)) AS id, 'job' AS category,
               f.p_name AS title, f.s_name AS company, concat(n.n_name, ', ', r.r_name) AS location,
               CASE substring(o.o_orderpriority, 1, 1) WHEN '1' THEN 'senior level' WHEN '2' THEN 'mid-level'
                    WHEN '3' THEN 'junior level' WHEN '4' THEN 'internship level' END AS level_phrase
        FROM orders o JOIN first_line f ON f.o_orderkey = o.o_orderkey JOIN customer c ON c.c_custkey = o.o_custkey
        JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey""",
    "posting_skill": "SELECT DISTINCT o_orderkey AS num, p_brand AS skill FROM sel_lines",
    "posting_skills": "SELECT num, list(skill ORDER BY skill) AS skills FROM posting_skill GROUP BY num",
    "posting_record": "SELECT p.*, s.skills FROM posting p JOIN posting_skills s ON s.num = p.num",
    "occupation": """
        SELECT DISTINCT split_part(p_name, ' ', 1) AS group_id, p_name AS term FROM part
        UNION SELECT DISTINCT split_part(p_name, ' ', 2), p_name FROM part""",
    "profile_vec": "SELECT CAST(vec_id // 2 AS BIGINT) AS num, embedding FROM embeddings WHERE vec_id % 2 = 0",
    "posting_vec": "SELECT CAST((vec_id - 1) // 2 AS BIGINT) AS num, embedding FROM embeddings WHERE vec_id % 2 = 1",
    # Résumé pages of 20 jobs; the first page has the skills.
    "page_job": """
        SELECT concat(CAST(num AS VARCHAR), '-', CAST((pos - 1) // 20 AS VARCHAR)) AS doc_id, num, (pos - 1) // 20 AS page,
               pos, (pos - 1) % 20 AS i, title, company, period, y FROM profile_job""",
    "page": """
        SELECT j.doc_id, j.num, j.page, j.n_jobs, j.edu_year, j.max_y, j.first_title, p.name, p.email, p.location, p.r_name
        FROM (SELECT doc_id, num, page, count(*) AS n_jobs, min(y) AS edu_year, max(y) AS max_y, min_by(title, pos) AS first_title
              FROM page_job GROUP BY doc_id, num, page) j
        JOIN profile p ON p.num = j.num""",
    "page_skill": """
        SELECT p.doc_id, s.skill, row_number() OVER (PARTITION BY p.doc_id ORDER BY s.skill) - 1 AS i
        FROM page p JOIN profile_skill s ON s.num = p.num WHERE p.page = 0""",
    "page_skills": """
        SELECT p.doc_id, coalesce(s.skills, []) AS skills FROM page p
        LEFT JOIN (SELECT doc_id, list(skill ORDER BY skill) AS skills FROM page_skill GROUP BY doc_id) s ON s.doc_id = p.doc_id""",
    "envelope": """
        SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'B' ELSE 'A' END, CAST(doc_id AS VARCHAR)) AS id, text AS raw_data,
               CASE doc_id % 9 WHEN 1 THEN 'new_texts' WHEN 2 THEN 'linkedin_pdf' WHEN 4 THEN 'string_dataset'
                    WHEN 5 THEN 'json_dataset' WHEN 0 THEN 'jobs_dataset' ELSE 'other' END AS source,
               CASE doc_id % 9 WHEN 7 THEN 'txt' WHEN 8 THEN 'pdf' WHEN 4 THEN 'csv' ELSE 'jsonl' END AS type,
               CASE WHEN doc_id % 3 = 0 THEN 'job' ELSE 'cv' END AS category FROM documents""",
    "posting_row": """
        SELECT num, id, title AS job_title_short, company AS company_name, split_part(location, ', ', 1) AS job_location,
               nullif(split_part(location, ', ', 2), 'ASIA') AS job_country,
               '[' || array_to_string(list_transform(skills, lambda s: '''' || s || ''''), ', ') || ']' AS job_skills, skills
        FROM posting_record""",
    "dict_row": "SELECT num, CASE WHEN len(skills) > 1 THEN '{''parts'': ' || job_skills || ', ''extra'': [''teamwork'']}' END AS job_type_skills FROM posting_row",
    "word": f"""
        SELECT doc_id, i, w, coalesce(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY i
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
        FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT doc_id, {words('text')} AS ws FROM documents))""",
    "cand": """
        SELECT job_num, cv_num, sim, rank FROM (
            SELECT q.num AS job_num, d.num AS cv_num, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS sim,
                   row_number() OVER (PARTITION BY q.num ORDER BY list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) DESC, d.num) AS rank
            FROM (SELECT v.* FROM posting_vec v JOIN posting p ON p.num = v.num) q
            CROSS JOIN (SELECT v.* FROM profile_vec v JOIN profile p ON p.num = v.num) d) WHERE rank <= 50""",
    "cand_cv": """
        SELECT job_num, cv_num, sim, rank FROM (
            SELECT d.num AS job_num, q.num AS cv_num, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS sim,
                   row_number() OVER (PARTITION BY q.num ORDER BY list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) DESC, d.num) AS rank
            FROM (SELECT v.* FROM profile_vec v JOIN profile p ON p.num = v.num) q
            CROSS JOIN (SELECT v.* FROM posting_vec v JOIN posting p ON p.num = v.num) d) WHERE rank <= 50""",
    "synonym_hit": """
        SELECT a.term AS cv_title, b.term AS job_title, count(*) AS groups FROM occupation a JOIN occupation b ON a.group_id = b.group_id
        GROUP BY a.term, b.term""",
    "cv_level": """
        SELECT num, CASE WHEN total_experience = 0 THEN 1 WHEN total_experience < 3 THEN 2 WHEN total_experience < 6 THEN 3
                         WHEN total_experience < 8 THEN 4 END AS level FROM profile""",
    "job_level": """
        SELECT num, CASE level_phrase WHEN 'internship level' THEN 1 WHEN 'junior level' THEN 2 WHEN 'mid-level' THEN 3
                         WHEN 'senior level' THEN 4 END AS level FROM posting""",
}
_SCORED = """
    SELECT c.job_num, c.cv_num, c.sim, c.rank,
           CASE WHEN ja.n_cv + ja.n_job - ja.n_both = 0 THEN 0.0::DOUBLE ELSE round_even(ja.n_both::DOUBLE / (ja.n_cv + ja.n_job - ja.n_both), 4) END AS jaccard,
           coalesce(CASE WHEN t.exact = 1 THEN 1 ELSE t.groups END, 0)::BIGINT AS category,
           CASE WHEN cl.level - jl.level >= 0 THEN 0.05::DOUBLE * (cl.level - jl.level) / 3
                ELSE 0.15::DOUBLE * (cl.level - jl.level) / 3 END AS gap
    FROM {cand} c
    JOIN (SELECT c.job_num, c.cv_num,
                 (SELECT count(*) FROM profile_skill a JOIN posting_skill b ON a.skill = b.skill WHERE a.num = c.cv_num AND b.num = c.job_num) AS n_both,
                 (SELECT count(*) FROM profile_skill a WHERE a.num = c.cv_num) AS n_cv,
                 (SELECT count(*) FROM posting_skill b WHERE b.num = c.job_num) AS n_job FROM {cand} c) ja
      ON ja.job_num = c.job_num AND ja.cv_num = c.cv_num
    LEFT JOIN (SELECT c.job_num, c.cv_num, max(CASE WHEN a.title = p.title THEN 1 ELSE 0 END) AS exact, sum(coalesce(h.groups, 0)) AS groups
               FROM {cand} c JOIN posting p ON p.num = c.job_num JOIN profile_title a ON a.num = c.cv_num
               LEFT JOIN synonym_hit h ON h.cv_title = a.title AND h.job_title = p.title GROUP BY c.job_num, c.cv_num) t
      ON t.job_num = c.job_num AND t.cv_num = c.cv_num
    LEFT JOIN cv_level cl ON cl.num = c.cv_num LEFT JOIN job_level jl ON jl.num = c.job_num"""
VIEWS["pair"] = _SCORED.format(cand="cand")
VIEWS["pair_cv"] = _SCORED.format(cand="cand_cv")
VIEWS["scored"] = """
    SELECT *, 1.0::DOUBLE * sim + 0.5::DOUBLE * jaccard + 0.1::DOUBLE * category + 0.1::DOUBLE * 0.0
           - CASE WHEN coalesce(gap, 0) < 0 THEN -0.05::DOUBLE ELSE 0.15::DOUBLE END * coalesce(gap, 0) AS score FROM pair"""
VIEWS["scored_cv"] = "SELECT *, 1.0::DOUBLE * sim + 0.5::DOUBLE * jaccard + 0.1::DOUBLE * category + 0.1::DOUBLE * 0.0 - 0.0 AS score FROM pair_cv"
VIEWS["freq"] = """
    SELECT 'title' AS attribute, title AS value, count(*) AS n FROM posting GROUP BY title
    UNION ALL SELECT 'location', location, count(*) FROM posting GROUP BY location
    UNION ALL SELECT 'company', company, count(*) FROM posting GROUP BY company
    UNION ALL SELECT 'category', category, count(*) FROM posting GROUP BY category
    UNION ALL SELECT 'skill', skill, count(*) FROM posting_skill GROUP BY skill"""
VIEWS["freq_rank"] = "SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value) AS rank FROM freq"


def _tables(sql: str) -> list[str]:
    """Views named after FROM or JOIN."""
    return [n for n in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", sql) if n in VIEWS]


def with_views(sql: str) -> str:
    """Prefix a statement with the views it uses, each after the ones it builds on."""
    order: list[str] = []

    def place(text: str) -> None:
        for name in _tables(text):
            if name not in order:
                place(VIEWS[name])
                order.append(name)

    place(sql)
    return ("WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in order) + " " if order else "") + sql


def _knn(query: str, other: str, q_name: str, d_name: str, k: int) -> str:
    return f"""
        SELECT {q_name}, {d_name}, round(sim, 6) AS sim, rank FROM (
            SELECT q.num AS {q_name}, d.num AS {d_name}, list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) AS sim,
                   row_number() OVER (PARTITION BY q.num
                       ORDER BY list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) DESC, d.num) AS rank
            FROM {query} q CROSS JOIN {other} d) WHERE rank <= {k}"""


_JOB_JSON = "to_json(list({'title': title, 'company': company, 'period': period, 'location': 'Unknown', 'description': ''} ORDER BY pos))"
_PAGE_TEXT_SKILLS = "array_to_string(s.skills, ', ')"
_EXPERIENCE_TEXT = "string_agg(title || ' | ' || company || chr(10) || period, chr(10) ORDER BY pos)"
_CAP = initcap("title")
_JSON_JOB = """
    SELECT doc_id, i AS pos, title, CASE WHEN pos % 5 = 0 THEN '' ELSE company END AS company, pos AS n,
           concat(CAST(y AS VARCHAR), ' ', CAST(CASE WHEN pos = 1 THEN 2026 ELSE y + 1 END AS VARCHAR)) AS period,
           CASE WHEN pos = 1 THEN 2026 ELSE y + 1 END AS last_y, y, concat('made ', title) AS description FROM page_job"""
_JSON_SKILL = """
    SELECT DISTINCT doc_id, title AS skill FROM page_job UNION SELECT doc_id, skill FROM page_skill
    UNION SELECT doc_id, unnest(['welding', 'teamwork', 'Italian', 'native']) FROM page"""
_LINES = """
    SELECT unnest([concat(CAST(l_linenumber AS VARCHAR), ' years 3 months'), concat(CAST(l_linenumber AS VARCHAR), ' yards'), s_name,
                   concat(p_name, ', ', p_brand), concat('School of ', p_name, ', Milan'), concat(p_name, ' near Trento')]) AS line FROM sel_lines"""
_LABELS = {
    "Experience": ["company", "managed", "team", "project", "responsible", "worked", "developed", "led"],
    "Education": ["university", "bachelor", "master", "degree", "school", "thesis", "college", "phd"],
    "Skills": ["python", "java", "sql", "software", "tools", "programming", "excel", "skills"],
    "Contact": ["email", "phone", "address", "linkedin", "@", "http"],
    "Certifications": ["certified", "certificate", "certification", "license", "credential"],
    "Languages": ["english", "italian", "french", "german", "spanish", "fluent", "native"],
}
_HITS = ", ".join(
    "(" + " + ".join(f"(contains(lower(text), '{w}'))::INT" for w in ws) + f") AS n{i}" for i, ws in enumerate(_LABELS.values())
)
_TOP = "greatest(" + ", ".join(f"n{i}" for i in range(len(_LABELS))) + ")"
_LABEL = "CASE " + " ".join(f"WHEN n{i} = {_TOP} THEN '{name}'" for i, name in enumerate(_LABELS)) + " END"
_TOTAL = " + ".join(f"n{i}" for i in range(len(_LABELS)))
_ROUTED = """
    SELECT concat('A', letter, doc_id) AS id, CASE WHEN named THEN name ELSE '' END AS name, n_jobs
    FROM page CROSS JOIN (VALUES ('', TRUE), ('t', TRUE), ('d', FALSE), ('p', TRUE)) r(letter, named)"""
_TERMS = f"""
    SELECT DISTINCT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
    FROM (SELECT {words('text')} AS ws FROM benchmark)"""
_ISLANDS = """
    SELECT doc_id, kind, count(*) AS n, sum(lo)::BIGINT AS starts, sum(hi)::BIGINT AS ends, sum(length(trim(said)))::BIGINT AS chars FROM (
        SELECT doc_id, kind, island, min(start) AS lo, max(start + length(w)) AS hi,
               string_agg(CASE WHEN w LIKE '##%' THEN '' ELSE ' ' END || replace(w, '##', ''), '' ORDER BY i) AS said FROM (
            SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM (
                SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM (
                    SELECT *, CASE WHEN length(w) > 4 THEN 'LONG' ELSE 'SHORT' END AS kind FROM word)))
        GROUP BY doc_id, kind, island) GROUP BY doc_id, kind"""
_MESSY = "' - | * ' || replace(text, ' the ', ' - the | ') || ' ;: '"
_DASHES = "'e' || chr(769) || ' ' || chr(8211) || ' ' || chr(8212) || chr(160)"

RAW: dict[str, str] = {
    # sources
    "read_jsonl": "SELECT doc_id, lang, length(text)::INT AS n, md5(text) AS digest FROM documents",
    "read_json_doc": "SELECT doc_id, source, n_chars FROM documents",
    "read_csv_column": "SELECT md5(text) AS digest, length(text)::INT AS n FROM documents",
    "read_posting_csv": """
        SELECT r.job_title_short, r.company_name, r.job_location, r.job_country, r.job_skills, d.job_type_skills
        FROM posting_row r JOIN dict_row d ON d.num = r.num""",
    "read_text_files": "SELECT md5(html || chr(10)) AS digest, length(html || chr(10))::INT AS n FROM pages",
    "read_binary_base64": """
        SELECT md5(to_base64(encode(html || chr(10)))) AS digest, length(to_base64(encode(html || chr(10))))::INT AS n FROM pages""",
    "ingest_union": """
        SELECT 'json_dataset' AS source, 'jsonl' AS type, 'cv' AS category, CAST(doc_id AS VARCHAR) AS record FROM documents
        UNION ALL SELECT 'jobs_dataset', 'json', 'job', CAST(doc_id AS VARCHAR) FROM documents
        UNION ALL SELECT 'string_dataset', 'csv', 'cv', md5(text) FROM documents
        UNION ALL SELECT 'new_texts', 'txt', 'cv', md5(html || chr(10)) FROM pages""",
    "stream_source": "SELECT CASE category WHEN 'job' THEN 'raw_jobs' ELSE 'raw_resumes' END AS topic, id AS key, md5(raw_data) AS digest FROM envelope",
    "decode_envelope": "SELECT id, source, type, category, md5(raw_data) AS digest FROM envelope",
    "read_table_partitions": """
        SELECT id, source, md5(raw_data) AS digest, length(raw_data)::INT AS text_length FROM envelope WHERE id LIKE 'A%'""",
    # identity
    "assign_doc_ids": """
        SELECT doc_id, kind, num, concat(kind, CAST(num AS VARCHAR)) AS id FROM (
            SELECT doc_id, CASE category WHEN 'job' THEN 'B' ELSE 'A' END AS kind,
                   row_number() OVER (PARTITION BY category ORDER BY doc_id) + CASE category WHEN 'job' THEN 0 ELSE 7303 END AS num FROM envelope)""",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "dedup_content": "SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash FROM documents GROUP BY text",
    "dedup_content_stream": "SELECT DISTINCT sha256(text) AS content_hash FROM documents",
    "latest_document": """
        SELECT 'A' AS kind, max(num) AS num, concat('A', CAST(max(num) AS VARCHAR)) AS id FROM profile
        UNION ALL SELECT 'B', max(num), concat('B', CAST(max(num) AS VARCHAR)) FROM posting""",
    "upsert_documents": "SELECT CAST(doc_id AS VARCHAR) AS id, md5(text) AS digest, CASE WHEN lang = 'en' THEN 'base' ELSE 'new' END AS origin FROM documents",
    "distinct_in_order": """
        SELECT doc_id, count(*)::INT AS n, md5(string_agg(w, ' ' ORDER BY i)) AS digest FROM (
            SELECT doc_id, w, min(i) AS i FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents)
            GROUP BY doc_id, w) GROUP BY doc_id""",
    "dedup_education": """
        SELECT num AS doc_id, min(pos) AS pos, min_by(institution, pos) AS institution, degree FROM (
            SELECT num, o_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS institution,
                   split_part(p_name, ' ', 1) AS degree FROM sel_lines) GROUP BY num, lower(institution), degree""",
    "dedup_mentions": """
        SELECT doc_id, count(*) AS n, sum(start)::BIGINT AS starts, sum(start + length(w))::BIGINT AS ends FROM word GROUP BY doc_id""",
    # projections, filters, routing
    "blank_placeholders": """
        SELECT event_id, CASE WHEN event_type IN ('error', 'view', 'signup') THEN '' ELSE event_type END AS kind FROM events""",
    "join_nonempty": """
        SELECT c_custkey, concat_ws(', ', CASE WHEN c_mktsegment <> 'MACHINERY' THEN n_name END, CASE WHEN c_acctbal >= 0 THEN c_mktsegment END) AS location
        FROM customer JOIN nation ON n_nationkey = c_nationkey""",
    "route_parser": """
        SELECT id, CASE WHEN category = 'job' THEN 'posting' WHEN source = 'new_texts' OR contains(type, 'txt') THEN 'text'
                        WHEN source = 'linkedin_pdf' OR contains(type, 'pdf') THEN 'profile' WHEN source = 'string_dataset' THEN 'dataset'
                        WHEN source = 'json_dataset' THEN 'json' ELSE 'none' END AS route FROM envelope""",
    "split_errors": """
        SELECT concat('E', CAST(event_id AS VARCHAR)) AS id, 'good' AS side, CAST(json_extract(props, '$.k') AS INT) AS k FROM events
        UNION ALL SELECT concat('D', CAST(doc_id AS VARCHAR)), 'bad', NULL FROM documents""",
    "split_kind": "SELECT id, CASE WHEN id LIKE 'A%' THEN 'cv' ELSE 'job' END AS side FROM envelope",
    "project_schema_cv": f"""
        SELECT concat('A', p.doc_id) AS id, 'json_dataset' AS source,
               to_json([{{'period': CAST(p.edu_year AS VARCHAR), 'institution': 'Institution Not Found', 'degree': 'Bachelor', 'details': ''}}])::VARCHAR AS education,
               j.experience::VARCHAR AS experience, to_json(s.skills)::VARCHAR AS skills
        FROM page p JOIN (SELECT doc_id, {_JOB_JSON} AS experience FROM page_job GROUP BY doc_id) j ON j.doc_id = p.doc_id
        JOIN page_skills s ON s.doc_id = p.doc_id""",
    "project_schema_job": """
        SELECT id, 'jobs_dataset' AS source, title, company, NULL::VARCHAR AS description, to_json(skills)::VARCHAR AS skills FROM posting_record""",
    "project_text": "SELECT id, source, md5(raw_data) AS digest, length(raw_data)::INT AS text_length FROM envelope",
    "project_personal_info": "SELECT id, 'json_dataset' AS source, name, email, '' AS linkedin FROM profile",
    # nested JSON
    "resume_json_personal": "SELECT doc_id, name, '' AS linkedin, email, location FROM page",
    "resume_json_experience": f"""
        SELECT j.doc_id, p.first_title AS headline, x.total_experience::INT AS total_experience, j.pos::INT AS pos, j.title, j.company, j.period, j.description
        FROM ({_JSON_JOB}) j JOIN page p ON p.doc_id = j.doc_id
        JOIN (SELECT doc_id, greatest(max(last_y), max(y)) - least(min(last_y), min(y)) AS total_experience FROM ({_JSON_JOB}) GROUP BY doc_id) x ON x.doc_id = j.doc_id""",
    "resume_json_education": """
        SELECT doc_id, CAST(edu_year AS VARCHAR) AS period, concat('University of ', r_name) AS institution, 'Bachelor Science' AS degree,
               'with honours, a, b' AS details FROM page""",
    "resume_json_skills": _JSON_SKILL,
    "resume_json_to_schema": f"""
        SELECT p.doc_id, p.first_title AS title, p.location, p.n_jobs::INT AS n_jobs, k.n::INT AS n_skills, 1 AS n_schools, x.total_experience::INT AS total_experience
        FROM page p JOIN (SELECT doc_id, count(*) AS n FROM ({_JSON_SKILL}) GROUP BY doc_id) k ON k.doc_id = p.doc_id
        JOIN (SELECT doc_id, greatest(max(last_y), max(y)) - least(min(last_y), min(y)) AS total_experience FROM ({_JSON_JOB}) GROUP BY doc_id) x ON x.doc_id = p.doc_id""",
    "schematize_posting": """
        SELECT num, job_title_short AS title, 'job' AS category, company_name AS company, concat_ws(', ', job_location, job_country) AS location,
               array_to_string(CASE WHEN len(skills) > 1 THEN list_concat(skills, ['teamwork']) ELSE skills END, ',') AS skills FROM posting_row""",
    "parse_list_literal": """
        SELECT num, 'list' AS form, unnest(skills) AS skill FROM posting_row
        UNION ALL SELECT num, 'dict', unnest(list_concat(skills, ['teamwork'])) FROM posting_row WHERE len(skills) > 1""",
    "merge_skill_sets": "SELECT num AS o_orderkey, len(skills)::INT AS n, array_to_string(skills, ',') AS skills FROM posting_skills",
    "explode_skills": "SELECT num, skill FROM posting_skill",
    # rendering
    "render_posting_text": """
        SELECT num, company || ' in ' || location || ' is looking for a ' || title || ' whose experienced in ' || array_to_string(skills, ' ') AS text FROM posting_record""",
    "experience_level": """
        SELECT num, total_experience::INT AS total_experience, CASE WHEN total_experience = 0 THEN 'internship level' WHEN total_experience < 3 THEN 'junior level'
               WHEN total_experience < 6 THEN 'mid-level' WHEN total_experience < 8 THEN 'senior level' ELSE 'principal level' END AS level FROM profile""",
    "render_resume_text": """
        SELECT concat('A', p.doc_id) AS id, concat_ws(' ', 'I am a', p.first_title,
               'with ' || p.n_jobs || ' years of experience (' || CASE WHEN p.n_jobs = 0 THEN 'internship level' WHEN p.n_jobs < 3 THEN 'junior level'
                   WHEN p.n_jobs < 6 THEN 'mid-level' WHEN p.n_jobs < 8 THEN 'senior level' ELSE 'principal level' END || ').',
               CASE WHEN len(s.skills) > 0 THEN 'My skills include: ' || array_to_string(s.skills, ', ') || '.' END, j.said,
               'I completed my Bachelor around ' || p.edu_year || '.') AS text
        FROM page p JOIN page_skills s ON s.doc_id = p.doc_id
        JOIN (SELECT doc_id, string_agg('I worked as ' || title || ' at ' || company || ' from ' || period || '.', ' ' ORDER BY pos) AS said
              FROM page_job GROUP BY doc_id) j ON j.doc_id = p.doc_id""",
    "squeeze_whitespace": f"SELECT doc_id, md5(trim(regexp_replace(text, '\\s+', ' ', 'g'), {WS})) AS digest FROM documents",
    "role_prefix": """
        SELECT doc_id, 'query' AS role, md5('Query: ' || text) AS digest FROM documents
        UNION ALL SELECT doc_id, 'passage', md5('Passage: ' || text) FROM documents""",
    # text extraction
    "normalize_chars": f"""
        SELECT doc_id, md5(replace(replace(replace(nfc_normalize({_DASHES} || text), chr(160), ' '), '–', '-'), '—', '-')) AS digest FROM documents""",
    "clean_lines": f"""
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INT AS pos, md5(line) AS digest FROM (
            SELECT doc_id, i, trim(line, {WS}) AS line FROM (
                SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM (
                    SELECT doc_id, list_concat(['English, German'], string_split(replace(replace(replace(replace(replace(replace(replace(replace(
                        replace(nfc_normalize(text), chr(160), ' '), '–', '-'), '—', '-'), 'Lingua inglese', 'English'), 'inglese', 'English'),
                        'Inglese', 'English'), 'Tedesco', 'German'), 'Francese', 'French'), 'Italiano', 'Italian'), chr(10))) AS ls FROM documents))
        ) WHERE line <> ''""",
    "assemble_columns": f"""
        SELECT p.doc_id, 'left' AS side, md5(concat_ws(chr(10), 'Contact', p.email, 'www.linkedin.com/in/', 'user-' || p.num || ' (LinkedIn)',
               'Top Skills' || chr(10) || array_to_string(s.skills, chr(10)))) AS digest FROM page p JOIN page_skills s ON s.doc_id = p.doc_id
        UNION ALL
        SELECT p.doc_id, 'right', md5(concat_ws(chr(10), p.name, {initcap('p.first_title')}, {letters(initcap('p.location'))}, 'Experience', j.said,
               'Education' || chr(10) || 'University of ' || {letters(initcap('p.r_name'))}, 'Bachelor of Science · (' || p.edu_year || ')', 'Page 3 of 3'))
        FROM page p JOIN (SELECT doc_id, string_agg(concat_ws(chr(10), company, title, 'January ' || y || ' - March ' || (y + 1) || ' (1 year 3 months)',
                          'Italy' || chr(160) || '– Trento'), chr(10) ORDER BY pos) AS said FROM page_job GROUP BY doc_id) j ON j.doc_id = p.doc_id""",
    "slice_sections_dataset": f"""
        SELECT doc_id, 'Experience' AS section, md5(string_agg(company || '  ' || {_CAP} || '  ' || period, '   ' ORDER BY pos)) AS digest FROM page_job GROUP BY doc_id
        UNION ALL SELECT doc_id, 'Education', md5('University of ' || {letters(initcap('r_name'))} || '  Bachelor  ' || edu_year) FROM page
        UNION ALL SELECT doc_id, 'Skills', md5(array_to_string(skills, ', ')) FROM page_skills""",
    "slice_sections_text": f"""
        SELECT doc_id, 'Experience' AS section, 'WORK EXPERIENCE' AS heading, md5({_EXPERIENCE_TEXT}) AS digest FROM page_job GROUP BY doc_id
        UNION ALL SELECT doc_id, 'Education', 'EDUCATION', md5('Bachelor of Science | University of ' || {letters('r_name')} || chr(10) || edu_year) FROM page
        UNION ALL SELECT doc_id, 'Skills', 'SKILLS', md5(array_to_string(skills, ', ')) FROM page_skills WHERE len(skills) > 0
        UNION ALL SELECT doc_id, 'Header', NULL, md5('Name: ' || name || chr(10) || {letters(initcap('location'))} || chr(10) || 'Email: ' || email) FROM page""",
    "classify_section_fallback": f"""
        SELECT doc_id, CASE WHEN {_TOP} > 0.3 * ({_TOTAL}) THEN {_LABEL} END AS section FROM (SELECT doc_id, {_HITS} FROM documents)""",
    "profile_left_column": """
        SELECT p.doc_id, p.email, 'www.linkedin.com/in/user-' || p.num AS linkedin, array_to_string(s.skills, ',') AS skills
        FROM page p JOIN page_skills s ON s.doc_id = p.doc_id""",
    "profile_right_column": f"""
        SELECT doc_id, name, {initcap('first_title')} AS title, {letters(initcap('location'))} AS location, '' AS summary,
               4 * n_jobs AS n_experience, 2::BIGINT AS n_education FROM page""",
    "extract_date_ranges": """
        SELECT doc_id, i::INT AS pos, period, TRUE AS in_place FROM page_job
        UNION ALL SELECT doc_id, n_jobs::INT, CAST(edu_year AS VARCHAR), TRUE FROM page""",
    "filter_date_mentions": """
        SELECT doc_id, i::INT AS pos, period FROM page_job
        UNION ALL SELECT doc_id, n_jobs::INT, CAST(edu_year AS VARCHAR) FROM page
        UNION ALL SELECT doc_id, (n_jobs + 1)::INT, '2004' FROM page""",
    "total_experience_years": """
        SELECT doc_id, 'text' AS variant, (max(y) + 1 - min(y))::INT AS total_experience FROM page_job GROUP BY doc_id
        UNION ALL SELECT doc_id, 'text_bare', 0 FROM page
        UNION ALL SELECT doc_id, 'dataset', (2026 - min(y))::INT FROM page_job GROUP BY doc_id
        UNION ALL SELECT doc_id, 'dataset_bare', NULL FROM page
        UNION ALL SELECT doc_id, 'profile', (2026 - min(y))::INT FROM page_job GROUP BY doc_id
        UNION ALL SELECT doc_id, 'profile_closed', (max(y) + 1 - min(y))::INT FROM page_job GROUP BY doc_id""",
    "professional_title": """
        SELECT doc_id, 'text' AS variant, 'Professional' AS title FROM page UNION ALL SELECT doc_id, 'dataset', upper(first_title) FROM page""",
    "link_title_company": f"SELECT doc_id, i::INT AS pos, {_CAP} AS title, company, period FROM page_job",
    "link_title_company_text": "SELECT doc_id, i::INT AS pos, title, company, period FROM page_job",
    "experience_descriptions": """
        SELECT doc_id, i::INT AS pos, title, company, period,
               coalesce(lead(title || ' | ' || company) OVER (PARTITION BY doc_id ORDER BY pos), '') AS description FROM page_job""",
    "clean_description": f"""
        SELECT doc_id, CASE WHEN length(t) > 250 THEN substr(t, 1, 250) || '...' ELSE t END AS description FROM (
            SELECT doc_id, regexp_replace(regexp_replace(trim(replace(replace(' - Company Name － City , State ' || text, split_part(text, ' ', 1), ''),
                   'Company Name － City , State', ''), {WS}), '^[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', ''), '\\s+', ' ', 'g') AS t FROM documents)""",
    "profile_experience": """
        SELECT doc_id, i::INT AS pos, title, company, 'January ' || y || ' - March ' || (y + 1) || ' (1 year 3 months)' AS period,
               'Italy - Trento' AS location, '' AS description FROM page_job""",
    "is_location_line": f"""
        SELECT line, count(*) AS n, NOT regexp_matches(lower(line), 'university|università|studiorum|school|academy|srl|spa|inc|gmbh|ltd|limited')
               AND (regexp_matches(lower(line), 'italy|italia|france|germany|bologna|trento|rimini|forlì|milan|roma') OR (contains(line, ',') AND length(line) < 50)) AS is_place
        FROM ({_LINES}) GROUP BY line""",
    "is_duration_line": f"SELECT line, count(*) AS n, regexp_matches(line, '^[0-9]+ years 3 months$') AS is_span FROM ({_LINES}) GROUP BY line",
    "extract_education": f"""
        SELECT doc_id, CAST(edu_year AS VARCHAR) AS period, 'University of ' || {letters(initcap('r_name'))} AS institution, 'Bachelor' AS degree FROM page""",
    "extract_education_text": f"""
        SELECT doc_id, 0 AS pos, CAST(edu_year AS VARCHAR) AS period, 'University of ' || {letters('r_name')} AS institution, 'Bachelor of Science' AS degree FROM page""",
    "profile_education": f"""
        SELECT doc_id, 0 AS pos, 'University of ' || {letters(initcap('r_name'))} AS institution, 'Bachelor of Science' AS degree, CAST(edu_year AS VARCHAR) AS period FROM page""",
    "extract_certifications": "SELECT doc_id, i::INT AS pos, CAST(y AS VARCHAR) AS period, title AS degree FROM page_job",
    "tokenize_skills": "SELECT doc_id, i::INT AS pos, lower(skill) AS skill FROM page_skill",
    "tokenize_skills_text": "SELECT doc_id, i::INT AS pos, lower(skill) AS skill FROM page_skill",
    "clean_field": f"""
        SELECT doc_id, md5(trim(regexp_replace(trim(regexp_replace(replace({_MESSY}, '|', ' '), '\\s+-\\s+', ' ', 'g'),
               ' .,;|-•*:' || chr(10) || chr(9)), '\\s+', ' ', 'g'), {WS})) AS digest FROM documents""",
    "extract_contacts": """
        SELECT doc_id, regexp_extract(text, '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b') AS email,
               'https://www.LinkedIn.com/in/user_' || doc_id || '/' AS linkedin FROM documents""",
    "extract_header_location": f"SELECT doc_id, {letters(initcap('location'))} AS location FROM page",
    "extract_name": "SELECT doc_id, name FROM page",
    "extract_job_location": f"""
        SELECT num AS doc_id, split_part(place, ', ', 1) AS city, split_part(split_part(place, ', ', 2), ' ', 1) AS state,
               split_part(place, ', ', 1) || ', ' || split_part(split_part(place, ', ', 2), ' ', 1) AS raw_location
        FROM (SELECT num, {letters(initcap('location'))} AS place FROM profile)""",
    "chunk_words": f"""
        SELECT doc_id, (p // 150)::INT AS chunk, (length(array_to_string(ws[1:p], ' ')) + CASE WHEN p > 0 THEN 1 ELSE 0 END)::INT AS "offset",
               len(ws[p + 1:p + 200])::INT AS n_words, md5(array_to_string(ws[p + 1:p + 200], ' ')) AS digest
        FROM (SELECT doc_id, ws, unnest(range(0, len(ws), 150)) AS p FROM (SELECT doc_id, {words('text')} AS ws FROM documents))""",
    "extract_mentions": f"""
        SELECT g.doc_id, g.start::INT AS start, (g.start + length(g.value))::INT AS "end", 'TERM' AS kind, g.value FROM (
            SELECT doc_id, start, w AS value FROM word
            UNION ALL SELECT * FROM (SELECT doc_id, start, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) FROM word)
            UNION ALL SELECT * FROM (SELECT doc_id, start, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) || ' ' || lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) FROM word)
        ) g JOIN ({_TERMS}) t ON t.term = g.value""",
    "extract_mentions_batch": "SELECT DISTINCT doc_id::VARCHAR AS doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+')) AS value FROM documents",
    "merge_mentions": _ISLANDS,
    "parse_resume_text": f"""
        SELECT p.doc_id, name, email, first_title AS title, {letters(initcap('location'))} AS location, n_jobs::INT AS n_jobs, 1 AS n_schools,
               len(s.skills)::INT AS n_skills, (max_y + 1 - edu_year)::INT AS total_experience FROM page p JOIN page_skills s ON s.doc_id = p.doc_id""",
    "parse_resume_dataset": """
        SELECT p.doc_id, '' AS name, '' AS email, upper(first_title) AS title, 'Any' AS location, n_jobs::INT AS n_jobs, 1 AS n_schools,
               len(s.skills)::INT AS n_skills, (max_y + 1 - edu_year)::INT AS total_experience FROM page p JOIN page_skills s ON s.doc_id = p.doc_id""",
    "parse_resume_profile": f"""
        SELECT p.doc_id, name, email, {initcap('first_title')} AS title, {letters(initcap('location'))} AS location, n_jobs::INT AS n_jobs, 1 AS n_schools,
               len(s.skills)::INT AS n_skills, (max_y + 1 - edu_year)::INT AS total_experience FROM page p JOIN page_skills s ON s.doc_id = p.doc_id""",
    "parse_resume_text_contents": f"""
        SELECT doc_id, 'job' AS part, i::INT AS pos, title AS what, company AS where_, period AS when_ FROM page_job
        UNION ALL SELECT doc_id, 'school', 0, 'Bachelor of Science', 'University of ' || {letters('r_name')}, CAST(edu_year AS VARCHAR) FROM page
        UNION ALL SELECT doc_id, 'skill', i::INT, lower(skill), '', '' FROM page_skill""",
    "parse_resume_dataset_contents": f"""
        SELECT doc_id, 'job' AS part, i::INT AS pos, {_CAP} AS what, company AS where_, period AS when_ FROM page_job
        UNION ALL SELECT doc_id, 'school', 0, 'Bachelor', '', CAST(edu_year AS VARCHAR) FROM page
        UNION ALL SELECT doc_id, 'skill', i::INT, lower(skill), '', '' FROM page_skill""",
    "parse_resume_profile_contents": f"""
        SELECT doc_id, 'job' AS part, i::INT AS pos, title AS what, company AS where_, 'January ' || y || ' - March ' || (y + 1) || ' (1 year 3 months)' AS when_ FROM page_job
        UNION ALL SELECT doc_id, 'school', 0, 'Bachelor of Science', 'University of ' || {letters(initcap('r_name'))}, CAST(edu_year AS VARCHAR) FROM page
        UNION ALL SELECT doc_id, 'skill', i::INT, skill, '', '' FROM page_skill""",
    # embedding and matching
    "embed_texts": f"""
        SELECT concat('A', CAST(doc_id AS VARCHAR)) AS id, 'cv' AS kind, 'query' AS role, md5('Query: ' || text) AS digest, 64 AS dim, 1.0::DOUBLE AS norm FROM documents""",
    "knn_jobs_for_cv": _knn("profile_vec", "posting_vec", "cv_num", "job_num", 10),
    "knn_cvs_for_job": _knn("posting_vec", "profile_vec", "job_num", "cv_num", 10),
    "knn_blocked": _knn("profile_vec", "posting_vec", "query_num", "match_num", 10),
    "lookup_text_embedding": "SELECT vec_id AS num, embedding[1]::DOUBLE AS first, len(embedding)::INT AS dim FROM embeddings",
    "id_number_map": """
        SELECT id, num, concat('B', CAST(num AS VARCHAR)) AS as_posting FROM profile UNION ALL SELECT id, num, id FROM posting""",
    "rank_matches": _knn("posting_vec", "profile_vec", "query_num", "match_num", 20),
    "attach_personal_info": f"""
        SELECT k.job_num, concat('A', CAST(k.cv_num AS VARCHAR)) AS id, k.rank::INT AS rank, p.name, p.email
        FROM ({_knn("posting_vec", "profile_vec", "job_num", "cv_num", 10)}) k LEFT JOIN profile p ON p.num = k.cv_num""",
    "top_matches": """
        SELECT q.num AS query_num, d.num AS match_num, round(list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS sim
        FROM posting_vec q CROSS JOIN profile_vec d
        ORDER BY list_inner_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) DESC, q.num, d.num LIMIT 5""",
    # scoring
    "skill_jaccard": "SELECT job_num, cv_num, jaccard FROM pair",
    "skill_join_lookup": """
        SELECT p.job_num, p.cv_num, c.skills AS cv_skills, j.skills AS job_skills, p.jaccard FROM pair p
        LEFT JOIN (SELECT num, string_agg(skill, ',' ORDER BY skill) AS skills FROM profile_skill GROUP BY num) c ON c.num = p.cv_num
        LEFT JOIN (SELECT num, string_agg(skill, ',' ORDER BY skill) AS skills FROM posting_skill GROUP BY num) j ON j.num = p.job_num""",
    "occupation_synonyms": """
        SELECT DISTINCT p_name AS group_id, p_name AS term FROM part
        UNION SELECT p_name, unnest(string_split(p_name, ' ')) FROM part WHERE p_size > 5""",
    "title_category": "SELECT job_num, cv_num, category FROM pair",
    "experience_gap": "SELECT job_num, cv_num, gap FROM pair",
    "dynamic_penalty": """
        SELECT job_num, cv_num, CASE WHEN gap < 0 THEN -0.05::DOUBLE ELSE 0.15::DOUBLE END AS posting_query, 0.0::DOUBLE AS resume_query FROM pair""",
    "final_score_without_title_text": "SELECT job_num, cv_num, round(score, 6) AS score FROM scored",
    "funnel_best_cv_without_title_text": """
        SELECT p.num AS job_num, b.cv_num, coalesce(round(b.score, 6), 0.0) AS score FROM posting p
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY job_num ORDER BY score DESC, rank) AS place FROM scored) b ON b.job_num = p.num AND b.place = 1""",
    "funnel_best_job_without_title_text": """
        SELECT p.num AS cv_num, b.job_num, coalesce(round(b.score, 6), 0.0) AS score FROM profile p
        LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY cv_num ORDER BY score DESC, rank) AS place FROM scored_cv) b ON b.cv_num = p.num AND b.place = 1""",
    "funnel_cvs_ranked_without_title_text": """
        SELECT job_num, cv_num, round(score, 6) AS score, (row_number() OVER (PARTITION BY job_num ORDER BY score DESC, rank))::INT AS place FROM scored""",
    "funnel_jobs_ranked_without_title_text": """
        SELECT cv_num, job_num, round(score, 6) AS score, (row_number() OVER (PARTITION BY cv_num ORDER BY score DESC, rank))::INT AS place FROM scored_cv""",
    # analytics
    "freq_titles": "SELECT value, n FROM freq WHERE attribute = 'title'",
    "freq_locations": "SELECT value, n FROM freq WHERE attribute = 'location'",
    "freq_companies": "SELECT value, n FROM freq WHERE attribute = 'company'",
    "freq_categories": "SELECT value, n FROM freq WHERE attribute = 'category'",
    "freq_skills": "SELECT value, n FROM freq WHERE attribute = 'skill'",
    "freq_all": "SELECT attribute, value, n FROM freq",
    "top_n_report": """
        SELECT r.attribute, r.rank::INT AS rank, r.value, r.n, round(r.n::DOUBLE / t.total * 100, 6) AS pct, greatest(t.n_values - 10, 0) AS more
        FROM freq_rank r JOIN (SELECT attribute, sum(n) AS total, count(*) AS n_values FROM freq GROUP BY attribute) t ON t.attribute = r.attribute
        WHERE r.rank <= 10""",
    "summary_stats": """
        SELECT (SELECT count(*) FROM posting) AS total_jobs, (SELECT count(*) FROM posting WHERE level_phrase IS NOT NULL) AS jobs_with_skills,
               (SELECT count(*) FROM posting WHERE level_phrase IS NULL) AS jobs_without_skills,
               (SELECT count(DISTINCT title) FROM posting) AS unique_job_titles,
               (SELECT count(DISTINCT s.skill) FROM posting_skill s JOIN posting p ON p.num = s.num WHERE p.level_phrase IS NOT NULL) AS unique_skills,
               (SELECT count(DISTINCT location) FROM posting) AS unique_locations, (SELECT count(DISTINCT company) FROM posting) AS unique_companies""",
    "report_document": """
        SELECT CASE attribute WHEN 'title' THEN 'top_job_titles' WHEN 'skill' THEN 'top_skills' WHEN 'location' THEN 'top_locations'
               WHEN 'company' THEN 'top_companies' ELSE 'categories' END AS part, value, n FROM freq_rank WHERE rank <= 10 OR attribute = 'category'
        UNION ALL SELECT 'statistics', CASE attribute WHEN 'title' THEN 'unique_job_titles' WHEN 'skill' THEN 'unique_skills'
               WHEN 'location' THEN 'unique_locations' ELSE 'unique_companies' END, count(*) FROM freq WHERE attribute <> 'category' GROUP BY attribute
        UNION ALL SELECT 'total', 'total_jobs', count(*) FROM posting""",
    # sinks and streams
    "to_key_value": """
        SELECT id AS key, to_json({'id': id, 'text': company || ' in ' || location || ' is looking for a ' || title || ' whose experienced in '
               || array_to_string(skills, ' '), 'source': 'jobs_dataset'})::VARCHAR AS value FROM posting_record""",
    "fanout_sinks": f"""
        SELECT 'schema_cv' AS "table", id, CAST(n_jobs AS VARCHAR) AS value FROM ({_ROUTED})
        UNION ALL SELECT 'text_cv', id, 'said' FROM ({_ROUTED}) UNION ALL SELECT 'info_cv', id, name FROM ({_ROUTED})
        UNION ALL SELECT 'schema_job', id, title FROM posting UNION ALL SELECT 'text_job', id, 'said' FROM posting
        UNION ALL SELECT 'quarantine', concat(letter, CAST(doc_id AS VARCHAR)), NULL FROM documents CROSS JOIN (VALUES ('Ax'), ('An')) q(letter)""",
    "stream_trigger_checkpoint": "SELECT DISTINCT sha256(text) AS content_hash FROM documents",
    "append_partitioned": "SELECT id[1] AS kind, count(*) AS n, sum(length(raw_data))::BIGINT AS chars FROM envelope GROUP BY id[1]",
    "compact_tables": "SELECT id, id[1] AS kind, md5(raw_data) AS digest, length(raw_data)::INT AS text_length FROM envelope",
    "write_matches": f"""
        SELECT concat('B', CAST(query_num AS VARCHAR)) AS query_id, concat('A', CAST(match_num AS VARCHAR)) AS id, rank::INT AS rank
        FROM ({_knn("posting_vec", "profile_vec", "query_num", "match_num", 10)})""",
}
RAW["producer_to_topic"] = RAW["stream_source"]
RAW["topics_to_tables"] = f"""
    SELECT 'text_job' AS "table", id, company || ' in ' || location || ' is looking for a ' || title || ' whose experienced in '
           || array_to_string(CASE WHEN len(skills) > 1 THEN list_concat(skills, ['teamwork']) ELSE skills END, ' ') AS value
    FROM (SELECT id, company, title, skills, CASE WHEN location LIKE '%, ASIA' THEN split_part(location, ', ', 1) ELSE location END AS location FROM posting_record)
    UNION ALL SELECT 'schema_job', id, title FROM posting
    UNION ALL SELECT 'info_cv', concat('A', doc_id), email FROM page
    UNION ALL SELECT unnest(['text_cv', 'schema_cv']), concat('A', doc_id), 'json_dataset' FROM page"""

ORACLES: dict[str, str] = {name: with_views(sql) for name, sql in RAW.items()}
