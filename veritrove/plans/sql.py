"""SQL for DuckDB that gives the rows of the core's queries."""

from __future__ import annotations

from veritrove.functions.text import ENGLISH_STOP_WORDS, GROUNDING_STOP_WORDS, SPACE
from veritrove.operators.prompts import MODES, PART, head
from veritrove.plans import demo

# Fixed values, written out here again so that a slip in the operators shows: signals (first part, largest gap, second part), those
# that are severe, ranks of modal words in the order that resolves ties, negating words, and refusals.
SIGNALS = {
    "instruction_override": ("ignore|disregard|forget", 40, "instructions?|prompts?|rules?"),
    "system_prompt_request": ("system prompts?|developer messages?|hidden instructions?", None, None),
    "credential_request": ("api keys?|passwords?|secrets?|access tokens?|credentials?", None, None),
    "tool_execution_request": ("run|execute|call|invoke", 30, "tool|command|shell|terminal|function"),
    "role_reassignment": ("you are now|act as|new role|switch role", None, None),
}
SEVERE = ("instruction_override", "system_prompt_request", "credential_request")
MODALITIES = {"shall": 3, "must": 3, "required": 3, "should": 2, "recommended": 2, "may": 1, "optional": 1}
NEGATIONS = ("not", "never", "prohibited", "forbidden", "without")
NOTHING_FOUND = "The indexed documents do not provide sufficient evidence for this question."
ALL_QUARANTINED = "Potentially relevant retrieved evidence was quarantined by the untrusted-evidence policy, so the system will not use it to generate a factual answer."


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return ", ".join(map(_text, values))


def _words(column: str) -> str:
    return f"[x for x in string_split_regex({column}, '{SPACE}+') if x <> '']"


def _strip(column: str) -> str:
    return f"regexp_replace({column}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _lower(column: str) -> str:
    """Lower case as Unicode has it: U+0130 becomes an i and a combining dot."""
    return f"lower(replace({column}, chr(304), 'i' || chr(775)))"


_NO_WORD, _NO_WORD_OR_BREAK = r"[^\p{L}\p{N}_]", r"[^\p{L}\p{N}_\n]"


def _signal(name: str) -> str:
    first, gap, second = SIGNALS[name]
    pattern = f"(^|{_NO_WORD})(?:{first})"
    if gap is not None:
        pattern += f"(?:{_NO_WORD_OR_BREAK}|{_NO_WORD_OR_BREAK}.{{0,{gap - 2}}}{_NO_WORD_OR_BREAK})(?:{second})"
    return f"regexp_matches(text, '(?i){pattern}($|{_NO_WORD})')"


_FIRSTS = """firsts AS (
    SELECT sha256(text) AS content_sha256, 'doc-' || substr(sha256(text), 1, 16) AS doc_key, doc_id, text, source
    FROM documents WHERE text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY ingested_at NULLS FIRST, doc_id) = 1
)"""

_LISTED = """listed AS (
    SELECT sha256(text) AS content_sha256, 'doc-' || substr(sha256(text), 1, 16) AS doc_key, text, source, media_type FROM documents WHERE text IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY source NULLS FIRST, media_type NULLS FIRST) = 1
)"""


def _windows(source: str, key: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""made AS (
    SELECT {key}, {key} || ':' || (start // {step}) AS chunk_id, start // {step} AS ordinal, array_to_string(words[start + 1 : start + {size}], ' ') AS text
    FROM (SELECT {key}, words, unnest(range(0, len(words), {step})) AS start FROM (SELECT {key}, {_words('text')} AS words FROM {source} WHERE text IS NOT NULL))
)"""


_MADE = _FIRSTS + ",\n" + _windows("firsts", "doc_key", 110, 25)
_CHUNKS = """once AS (
    SELECT chunk_id, doc_id, ordinal, source, coalesce(text, '') AS text FROM chunks WHERE chunk_id IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY loaded_at NULLS FIRST, coalesce(text, ''), doc_id NULLS FIRST, ordinal NULLS FIRST, source NULLS FIRST) = 1
)"""


def _word_terms(name: str, source: str, key: str, text: str) -> str:
    """Counts of words and word pairs."""
    return f"""{name}_words AS (
    SELECT k, w, row_number() OVER (PARTITION BY k ORDER BY pos) AS pos
    FROM (SELECT k, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT {key} AS k, regexp_extract_all({_lower(text)}, '[\\p{{L}}\\p{{N}}_]{{2,}}') AS l FROM {source}))
    WHERE w NOT IN ({_list(sorted(ENGLISH_STOP_WORDS))})
), {name} AS (
    SELECT k, term, count(*) AS tf FROM (
        SELECT k, w AS term FROM {name}_words
        UNION ALL SELECT a.k, a.w || ' ' || b.w FROM {name}_words a JOIN {name}_words b ON a.k = b.k AND b.pos = a.pos + 1
    ) GROUP BY ALL
)"""


def _character_terms(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_padded AS (
    SELECT k, ' ' || w || ' ' AS w, count(*) AS c FROM (SELECT {key} AS k, unnest({_words(_lower(text))}) AS w FROM {source}) GROUP BY ALL
), {name} AS (
    SELECT k, substr(w, pos, n) AS term, sum(c)::BIGINT AS tf
    FROM (SELECT k, w, c, n, unnest(range(1, length(w) - n + 2)) AS pos FROM {name}_padded, (VALUES (3), (4), (5)) sizes(n) WHERE n <= length(w))
    GROUP BY ALL
)"""


def _idf(name: str, terms: str) -> str:
    return f"""{name} AS (SELECT term, df, ln((1.0 + (SELECT count(*) FROM once)) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM {terms} GROUP BY term))"""


def _scores(name: str, terms: str, asked: str, idf: str) -> str:
    """Cosines of all pairs that share a term."""
    return f"""{name}_length AS (SELECT k, sqrt(sum((tf * idf) ** 2)) AS length FROM {terms} JOIN {idf} USING (term) GROUP BY k),
{name}_asked AS (SELECT k AS q, term, tf * idf AS w, sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY k)) AS length FROM {asked} JOIN {idf} USING (term)),
{name} AS (
    SELECT a.q, t.k, sum(a.w / a.length * t.tf * i.idf / l.length) AS s
    FROM {name}_asked a JOIN {terms} t USING (term) JOIN {idf} i USING (term) JOIN {name}_length l ON l.k = t.k GROUP BY a.q, t.k
)"""


_TIES = "score DESC, doc_id DESC NULLS LAST, ordinal DESC NULLS LAST, chunk_id DESC"
_QUESTIONS = "questions AS (SELECT case_id AS q, coalesce(question, '') AS question FROM eval_cases)"
_HYBRID = f"""{_word_terms('terms', 'once', 'chunk_id', 'text')}, {_word_terms('asked', 'questions', 'q', 'question')}, {_idf('idfs', 'terms')}, {_scores('words', 'terms', 'asked', 'idfs')},
    {_character_terms('grams', 'once', 'chunk_id', 'text')}, {_character_terms('asked_grams', 'questions', 'q', 'question')}, {_idf('gram_idfs', 'grams')}, {_scores('characters', 'grams', 'asked_grams', 'gram_idfs')},
    scored AS (SELECT q.q AS query_id, o.chunk_id, doc_id, ordinal, source, coalesce(w.s, 0) AS word_score, coalesce(c.s, 0) AS character_score, round(0.65 * coalesce(w.s, 0) + 0.35 * coalesce(c.s, 0), 9) AS score
        FROM questions q CROSS JOIN once o LEFT JOIN words w ON w.q = q.q AND w.k = o.chunk_id LEFT JOIN characters c ON c.q = q.q AND c.k = o.chunk_id),
    worth AS (SELECT *, round(score - 0.08 * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {_TIES}) - 1), 9) AS worth FROM scored),
    hybrid AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, {_TIES}) AS rank FROM worth) WHERE rank <= least(5, (SELECT ceil(count(*) / 2) FROM once)))"""
#: What a store of all documents retrieves; its documents are numbered by their keys.
_SERVED = f"""{_LISTED}, {_windows('(SELECT doc_key, text FROM listed)', 'doc_key', 110, 25)}, once AS (
    SELECT chunk_id, ('0x' || substr(doc_key, 5, 15))::BIGINT AS doc_id, ordinal, source, made.text AS text FROM made JOIN listed USING (doc_key)
), {_QUESTIONS}, {_HYBRID}"""
_OF_SERVICE = "retrieval AS MATERIALIZED (SELECT query_id, rank, score, chunk_id, h.doc_id, h.source, o.text FROM hybrid h JOIN once o USING (chunk_id))"
_RETRIEVAL = f"""{_CHUNKS}, retrieval AS (
    SELECT case_id AS query_id, rank_no AS rank, score, r.chunk_id, r.doc_id, o.source, o.text
    FROM (SELECT * FROM retrieval_rows QUALIFY row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY rank_no NULLS FIRST, score NULLS FIRST, doc_id NULLS FIRST) = 1) r JOIN once o USING (chunk_id)
)"""
_SEVERE = " OR ".join(_signal(n) for n in SEVERE)
_ANY = " OR ".join(_signal(n) for n in SIGNALS)
_EVIDENCE = f"""{_RETRIEVAL}, evidence AS (
    SELECT * REPLACE (coalesce(text, '') AS text), coalesce(({_SEVERE}), false) AS quarantined FROM retrieval WHERE score > 0
)"""


def _tokens(text: str) -> str:
    return f"list_distinct([lower(t) for t in regexp_extract_all(coalesce({text}, ''), '[A-Za-z0-9_%-]{{3,}}') if lower(t) NOT IN ({_list(GROUNDING_STOP_WORDS)})])"


_AUDIT = f"""{_RETRIEVAL}, asked AS (
    SELECT answer_id, case_id, prompt_mode, {_tokens('answer')} AS tokens, [c for c in coalesce(citations, []) if c IS NOT NULL] AS given FROM answers
), cited AS (
    SELECT answer_id, case_id, c AS chunk_id, min(pos) AS pos FROM (SELECT answer_id, case_id, unnest(given) AS c, generate_subscripts(given, 1) AS pos FROM asked) GROUP BY ALL
), checked AS (
    SELECT c.*, r.chunk_id IS NOT NULL AS valid, CASE WHEN r.chunk_id IS NOT NULL THEN {_tokens('r.text')} ELSE [] END AS evidence
    FROM cited c LEFT JOIN retrieval r ON r.query_id = c.case_id AND r.chunk_id = c.chunk_id
), by_answer AS (
    SELECT answer_id, string_agg(chunk_id, '|' ORDER BY pos) AS citations, string_agg(chunk_id, '|' ORDER BY pos) FILTER (valid) AS valid_citations, string_agg(chunk_id, '|' ORDER BY pos) FILTER (NOT valid) AS invalid_citations,
        count(*) AS n, count(*) FILTER (valid) AS good, list_distinct(flatten(list(evidence))) AS evidence
    FROM checked GROUP BY answer_id
), audit AS (
    SELECT a.answer_id, a.prompt_mode, coalesce(citations, '') AS citations, coalesce(valid_citations, '') AS valid_citations, coalesce(invalid_citations, '') AS invalid_citations,
        CASE WHEN n > 0 THEN good / n ELSE 0.0 END AS citation_validity_rate,
        CASE WHEN len(tokens) > 0 THEN len(list_intersect(tokens, coalesce(evidence, []))) / len(tokens) ELSE 1.0 END AS lexical_grounding_rate,
        len(tokens) AS answer_content_tokens, len(list_intersect(tokens, coalesce(evidence, []))) AS supported_content_tokens, len(tokens) > 0 AND coalesce(good, 0) = 0 AS insufficient_citation_support
    FROM asked a LEFT JOIN by_answer USING (answer_id)
)"""


def _claims(source: str) -> str:
    cut = f"string_split(regexp_replace({_strip('''coalesce(answer, '')''')}, '([.!?]){SPACE}+', '\\1' || chr(1), 'g'), chr(1))"
    return f"""split AS (SELECT answer_id, case_id, [x for x in [{_strip('s')} for s in {cut}] if x <> ''] AS l FROM {source}),
claims AS (SELECT answer_id, case_id, unnest(l) AS claim, generate_subscripts(l, 1) - 1 AS claim_no FROM split)"""


_MODAL = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '(^|{_NO_WORD}){w}($|{_NO_WORD})') THEN {{value}}".replace("{value}", _text(w)) for w in MODALITIES) + " END"
_RANK = "CASE word " + " ".join(f"WHEN {_text(w)} THEN {r}" for w, r in MODALITIES.items()) + " ELSE 0 END"
_NUMBER = r"(?i)(\d+(?:\.\d+)?)\s*(ms|s|sec|seconds?|minutes?|hours?|days?|%|percent|mb|gb|kb)?"
_REQUIREMENTS = f"""reqs AS (
    SELECT *, {_RANK} AS rank FROM (
        SELECT requirement_id, text, list_sort(list_distinct([t for t in regexp_extract_all(lower(text), '[a-zA-Z0-9_]{{3,}}') if t NOT IN ({_list([*MODALITIES, *NEGATIONS])})])) AS tokens,
            regexp_extract_all(text, '{_NUMBER}', 1) AS vals, regexp_extract_all(text, '{_NUMBER}', 2) AS units, {_MODAL} AS word,
            regexp_matches(lower(text), '(^|{_NO_WORD})(?:{'|'.join(NEGATIONS)})($|{_NO_WORD})') AS negated
        FROM (SELECT DISTINCT requirement_id, text FROM requirements WHERE requirement_id IS NOT NULL AND text IS NOT NULL)
    )
), facts AS (
    SELECT requirement_id, text, generate_subscripts(vals, 1) - 1 AS fact_no, unnest(vals)::DOUBLE AS value, CASE WHEN coalesce(unnest(units), '') = '' THEN 'number' ELSE lower(unnest(units)) END AS unit FROM reqs
), numbered AS MATERIALIZED (
    SELECT *, row_number() OVER (ORDER BY requirement_id, text) AS n FROM reqs
), postings AS (
    SELECT n, unnest(tokens) AS token FROM numbered
), met AS (
    SELECT a.n AS l, b.n AS r, count(*) AS shared FROM postings a JOIN postings b ON a.token = b.token AND a.n < b.n GROUP BY ALL
), pairs AS (
    SELECT l.requirement_id AS left_id, r.requirement_id AS right_id, l.text AS l_text, r.text AS r_text, l.word AS l_word, r.word AS r_word, l.rank AS l_rank, r.rank AS r_rank, l.negated AS l_negated, r.negated AS r_negated,
        m.l, m.r, shared / (len(l.tokens) + len(r.tokens) - shared) AS overlap
    FROM met m JOIN numbered l ON l.n = m.l JOIN numbered r ON r.n = m.r
)"""
_CONFLICTS = f"""{_REQUIREMENTS}, near AS MATERIALIZED (SELECT * FROM pairs WHERE overlap >= 0.18), counted AS MATERIALIZED (SELECT n, fact_no, value, unit FROM facts JOIN numbered USING (requirement_id, text)), numbers AS (
    SELECT l, r, a.value AS a, b.value AS b, a.unit
    FROM near JOIN counted a ON a.n = l JOIN counted b ON b.n = r AND a.unit = b.unit AND a.value <> b.value
    QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY a.fact_no, b.fact_no) = 1
), conflicts AS (
    SELECT left_id, right_id, kind, least(1.0, CASE kind WHEN 'negation' THEN 0.72 + 0.28 * overlap WHEN 'numeric' THEN 0.60 + 0.30 * overlap + 0.10 * abs(a - b) / greatest(abs(a), abs(b), 1.0) ELSE 0.55 + 0.35 * overlap END) AS score,
        CASE kind WHEN 'negation' THEN 'Requirements have overlapping subject matter but opposite negation polarity.'
            WHEN 'numeric' THEN 'Requirements specify different values for the same unit: ' || printf('%g', a) || ' ' || unit || ' vs ' || printf('%g', b) || ' ' || unit || '.'
            ELSE 'Normative strength differs materially: ''' || l_word || ''' versus ''' || r_word || '''.' END AS explanation
    FROM (SELECT near.*, a, b, unit, CASE WHEN l_negated <> r_negated THEN 'negation' WHEN unit IS NOT NULL THEN 'numeric' WHEN l_rank > 0 AND r_rank > 0 AND abs(l_rank - r_rank) >= 2 THEN 'modality' END AS kind
        FROM near LEFT JOIN numbers USING (l, r)) WHERE kind IS NOT NULL
)"""
_HEADS = ", ".join(f"({_text(m)}, {_text(head(m))})" for m in MODES)
_PROMPTS = f"""{_EVIDENCE}, blocks AS (
    SELECT query_id, string_agg('<evidence chunk_id=' || to_json(chunk_id)::VARCHAR || ' source=' || coalesce(to_json(source)::VARCHAR, 'null') || '>' || chr(10) || text || chr(10) || '</evidence>', chr(10) || chr(10) ORDER BY rank, chunk_id) AS block
    FROM evidence WHERE NOT quarantined GROUP BY query_id
), prompts AS (
    SELECT case_id AS query_id, mode, head || {_text(PART + 'Untrusted evidence follows:')} || chr(10) || coalesce(block, '') || {_text(PART + 'Question:')} || chr(10) || coalesce(question, '') AS prompt
    FROM eval_cases LEFT JOIN blocks ON query_id = case_id, (VALUES {_HEADS}) modes(mode, head)
)"""
_ANSWERED = f"""{_EVIDENCE}, best AS (
    SELECT query_id, chunk_id, text, score FROM evidence WHERE NOT quarantined QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank NULLS FIRST, chunk_id) = 1
), held AS (
    SELECT query_id, string_agg(chunk_id, '|' ORDER BY rank, chunk_id) AS ids FROM evidence WHERE quarantined GROUP BY query_id
), answered AS (
    SELECT q.query_id, CASE WHEN b.chunk_id IS NOT NULL THEN CASE WHEN length({_strip('b.text')}) > 700 THEN regexp_replace(substr({_strip('b.text')}, 1, 697), '{SPACE}+$', '') || '...' ELSE {_strip('b.text')} END
            WHEN ids IS NOT NULL THEN {_text(ALL_QUARANTINED)} ELSE {_text(NOTHING_FOUND)} END AS answer,
        coalesce(b.chunk_id, '') AS citations, coalesce(greatest(0.0, least(1.0, b.score)), 0.0) AS confidence, b.chunk_id IS NULL AS insufficient_evidence, coalesce(ids, '') AS quarantined_chunk_ids
    FROM (SELECT case_id AS query_id FROM eval_cases) q LEFT JOIN best b USING (query_id) LEFT JOIN held USING (query_id)
)"""
_FOUND = """found AS (
    SELECT w.query_id, count(r.rank) AS n, min(r.rank) AS first, sum(1 / log2(r.rank + 1)) AS dcg FROM wanted w LEFT JOIN retrieval r ON r.query_id = w.query_id AND r.doc_id = w.doc_id AND r.rank BETWEEN 1 AND 5 GROUP BY w.query_id
), metrics AS (
    SELECT query_id, (n > 0)::INT::DOUBLE AS hit, n::DOUBLE AS recall, n / 5 AS precision, coalesce(1.0 / first, 0.0) AS reciprocal_rank, coalesce(dcg, 0.0) AS ndcg FROM found
)"""
_METRICS = f"""{_RETRIEVAL}, wanted AS (SELECT case_id AS query_id, relevant_doc_id AS doc_id, expected_phrase FROM eval_cases WHERE relevant_doc_id IS NOT NULL), {_FOUND}"""
_RANKED = "coalesce(round(avg(hit), 6), 0) AS hit_rate_at_k, coalesce(round(avg(recall), 6), 0) AS recall_at_k, coalesce(round(avg(precision), 6), 0) AS precision_at_k, coalesce(round(avg(reciprocal_rank), 6), 0) AS mean_reciprocal_rank, coalesce(round(avg(ndcg), 6), 0) AS ndcg_at_k"
_JUDGED = f"""judged AS (
        SELECT m.*, coalesce((r.doc_id = w.doc_id)::INT, 0) AS matched, CASE WHEN a.citations <> '' THEN 1.0 ELSE 0.0 END AS validity,
            CASE WHEN len({_tokens('a.answer')}) = 0 THEN 1.0 WHEN r.chunk_id IS NULL THEN 0.0 ELSE len(list_intersect({_tokens('a.answer')}, {_tokens('r.text')})) / len({_tokens('a.answer')}) END AS support,
            CASE WHEN coalesce(expected_phrase, '') = '' THEN 1.0 ELSE contains(lower(a.answer), lower(expected_phrase))::INT END AS phrase
        FROM metrics m JOIN wanted w USING (query_id) JOIN answered a USING (query_id) LEFT JOIN retrieval r ON r.query_id = a.query_id AND r.chunk_id = a.citations
    ) SELECT count(*) AS cases, {_RANKED}, round(avg(matched), 6) AS citation_doc_accuracy, round(avg(validity), 6) AS citation_validity_rate, round(avg(support), 6) AS lexical_grounding_rate, round(avg(phrase), 6) AS answer_phrase_accuracy FROM judged"""
_VALID = "answer IS NOT NULL AND citations IS NOT NULL AND insufficient_evidence IS NOT NULL AND coalesce(confidence BETWEEN 0 AND 1, false)"

SQL = {
    "doc_fingerprint": "SELECT doc_id, sha256(text) AS content_sha256, 'doc-' || substr(sha256(text), 1, 16) AS doc_key FROM documents",
    "dedup_documents": f"WITH {_FIRSTS} SELECT doc_id, doc_key, content_sha256, source FROM firsts",
    "ingest_report": f"""WITH {_MADE}, counts AS (SELECT doc_key, count(*) AS chunks FROM made GROUP BY doc_key)
        SELECT d.doc_id, f.doc_key, d.doc_id = f.doc_id AS inserted, coalesce(chunks, 0) AS chunks, f.content_sha256
        FROM documents d JOIN firsts f ON f.content_sha256 = sha256(d.text) LEFT JOIN counts c ON c.doc_key = f.doc_key""",
    "incremental_ingest": f"""WITH late AS (SELECT * FROM documents WHERE ingested_at >= TIMESTAMPTZ '2025-07-01 00:00:00+00' AND text IS NOT NULL
            AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE ingested_at < TIMESTAMPTZ '2025-07-01 00:00:00+00' AND text IS NOT NULL)),
        {_FIRSTS.replace('FROM documents', 'FROM late')},
        {_windows('firsts', 'doc_key', 110, 25)}
        SELECT doc_id, f.doc_key, count(m.chunk_id) AS chunks FROM firsts f LEFT JOIN made m ON m.doc_key = f.doc_key GROUP BY ALL""",
    "chunk_documents": f"WITH {_MADE} SELECT chunk_id, doc_key, ordinal, text FROM made",
    "chunk_counts": f"WITH {_MADE} SELECT doc_key, count(*) AS chunks FROM made GROUP BY doc_key",
    "chunk_short_overlap": f"WITH {_windows('documents', 'doc_id', 90, 20)} SELECT chunk_id, doc_id, ordinal, length(text) AS size, sha256(text) AS digest FROM made",
    "store_health": f"WITH {_MADE} SELECT (SELECT count(*) FROM firsts) AS documents, (SELECT count(*) FROM made) AS chunks",
    "store_again": f"""WITH {_LISTED}, {_windows('listed', 'doc_key', 110, 25)}, counts AS (SELECT doc_key, count(*) AS chunks FROM made GROUP BY doc_key)
        SELECT d.source, l.doc_key AS doc_id, false AS inserted, coalesce(chunks, 0) AS chunks, l.content_sha256
        FROM documents d JOIN listed l ON l.content_sha256 = sha256(d.text) LEFT JOIN counts c ON c.doc_key = l.doc_key""",
    "list_documents": f"WITH {_LISTED} SELECT doc_key AS doc_id, source, media_type, content_sha256, 0 AS entries FROM listed",
    "document_metadata": """SELECT doc_id, CASE WHEN json_valid(metadata_json) AND json_type(metadata_json) = 'OBJECT'
            THEN array_to_string(list_sort([k || '=' || coalesce(json_extract_string(metadata_json, '$."' || k || '"'), 'null') for k in json_keys(metadata_json)]), '|') END AS metadata FROM documents""",
    "list_chunks": f"WITH {_LISTED}, {_windows('(SELECT doc_key, text FROM listed)', 'doc_key', 110, 25)} SELECT chunk_id, doc_key AS doc_id, source, ordinal, sha256(made.text) AS digest FROM made JOIN listed USING (doc_key)",
    "csv_row_text": "SELECT source, 'source: ' || source || ' | owner_team: ' || coalesce(owner_team, 'None') AS line, '1' AS rows FROM sources",
    "json_file_text": """SELECT source, 'application/json' AS media_type, 'dict' AS root_type,
            '{' || chr(10) || '  "owner_team": ' || coalesce(to_json(owner_team)::VARCHAR, 'null') || ',' || chr(10) || '  "source": ' || to_json(source)::VARCHAR || chr(10) || '}' AS text FROM sources""",
    "text_file_text": """SELECT source, media_type, '# ' || source || chr(10) || coalesce(owner_team, '') || chr(10) || 'end' || chr(10) AS text, format
        FROM sources, (VALUES ('text/plain', ''), ('text/markdown', 'markdown')) kinds(media_type, format)""",
    "json_line_rows": """SELECT '{"source":' || to_json(source)::VARCHAR || ',"owner_team":' || to_json(coalesce(owner_team, 'none'))::VARCHAR || '}' AS value FROM sources""",
    "case_file": "SELECT row_number() OVER (ORDER BY case_id) AS query_id, question, relevant_doc_id::VARCHAR AS relevant_doc_id, expected_phrase FROM eval_cases",
    "prompt_case_file": "SELECT row_number() OVER (ORDER BY case_id) AS query_id, question, coalesce(expected_insufficient_evidence, false) AS expected_insufficient_evidence FROM eval_cases",
    "word_terms": f"WITH {_CHUNKS}, {_word_terms('terms', 'once', 'chunk_id', 'text')} SELECT k AS chunk_id, term, tf FROM terms",
    "word_idf": f"WITH {_CHUNKS}, {_word_terms('terms', 'once', 'chunk_id', 'text')}, {_idf('idfs', 'terms')} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "word_norms": f"WITH {_CHUNKS}, {_word_terms('terms', 'once', 'chunk_id', 'text')}, {_idf('idfs', 'terms')} SELECT k AS chunk_id, round(sqrt(sum((tf * idf) ** 2)), 6) AS norm FROM terms JOIN idfs USING (term) GROUP BY k",
    "char_idf": f"WITH {_CHUNKS}, {_character_terms('terms', 'once', 'chunk_id', 'text')}, {_idf('idfs', 'terms')} SELECT term, df, round(idf, 6) AS idf FROM idfs",
    "char_norms": f"WITH {_CHUNKS}, {_character_terms('terms', 'once', 'chunk_id', 'text')}, {_idf('idfs', 'terms')} SELECT k AS chunk_id, round(sqrt(sum((tf * idf) ** 2)), 6) AS norm FROM terms JOIN idfs USING (term) GROUP BY k",
    "baseline_search": f"""WITH {_CHUNKS}, {_QUESTIONS}, {_word_terms('terms', 'once', 'chunk_id', 'text')}, {_word_terms('asked', 'questions', 'q', 'question')}, {_idf('idfs', 'terms')}, {_scores('words', 'terms', 'asked', 'idfs')},
        scored AS (SELECT q.q AS query_id, o.chunk_id, doc_id, ordinal, source, round(coalesce(s, 0), 9) AS score FROM questions q CROSS JOIN once o LEFT JOIN words w ON w.q = q.q AND w.k = o.chunk_id)
        SELECT query_id, rank, round(score, 6) AS score, chunk_id, doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_TIES}) AS rank FROM scored) WHERE rank <= 5""",
    "hybrid_search": f"WITH {_CHUNKS}, {_QUESTIONS}, {_HYBRID} SELECT query_id, rank, round(score, 6) AS score, round(word_score, 6) AS word_score, round(character_score, 6) AS character_score, chunk_id, doc_id, source FROM hybrid",
    "weighted_search": f"WITH {_CHUNKS}, {_QUESTIONS}, {_HYBRID.replace('0.65 *', '0.25 *').replace('0.35 *', '0.75 *').replace('0.08 *', '0.2 *')} SELECT query_id, rank, round(score, 6) AS score, chunk_id, doc_id, source FROM hybrid WHERE rank <= 3",
    "service_retrieve": f"WITH {_SERVED} SELECT query_id, rank, round(score, 6) AS score, chunk_id, source FROM hybrid",
    "service_answer": f"""WITH {_SERVED}, {_OF_SERVICE}, {_ANSWERED.partition(_RETRIEVAL + ', ')[2]}
        SELECT a.query_id, answer, citations, round(confidence, 6) AS confidence, insufficient_evidence, quarantined_chunk_ids, (SELECT count(*) FROM retrieval r WHERE r.query_id = a.query_id) AS retrieved,
            CASE WHEN citations <> '' THEN 1.0 ELSE 0.0 END AS citation_validity_rate,
            round(CASE WHEN len({_tokens('answer')}) = 0 THEN 1.0 WHEN r.chunk_id IS NULL THEN 0.0 ELSE len(list_intersect({_tokens('answer')}, {_tokens('r.text')})) / len({_tokens('answer')}) END, 6) AS lexical_grounding_rate
        FROM answered a LEFT JOIN retrieval r ON r.query_id = a.query_id AND r.chunk_id = a.citations""",
    "service_evaluate": f"""WITH {_SERVED}, {_OF_SERVICE}, wanted AS (
            SELECT case_id AS query_id, ('0x' || substr(sha256(text), 1, 15))::BIGINT AS doc_id, expected_phrase FROM eval_cases JOIN documents d ON d.doc_id = relevant_doc_id WHERE text IS NOT NULL
        ), {_FOUND}, {_ANSWERED.partition(_RETRIEVAL + ', ')[2]}, {_JUDGED}""",
    "service_benchmark": f"""WITH {_SERVED}, {_OF_SERVICE}, {_PROMPTS.partition(_RETRIEVAL + ', ')[2]}
        SELECT mode, count(*) AS cases, 1.0 AS schema_validity_rate, 1.0 AS citation_validity_rate, round(avg(coalesce(expected_insufficient_evidence, false)::INT), 6) AS insufficiency_accuracy, 0.5 AS average_confidence,
            round(avg(length(prompt)), 6) AS average_prompt_characters, (SELECT count(*) FROM evidence WHERE quarantined) AS quarantined
        FROM prompts JOIN eval_cases ON case_id = query_id GROUP BY mode""",
    "diversity_rerank": f"""WITH candidates AS (SELECT case_id AS query_id, chunk_id, doc_id, try_cast(string_split(chunk_id, ':')[2] AS INT) AS ordinal, round(score, 9) AS score
            FROM retrieval_rows QUALIFY row_number() OVER (PARTITION BY case_id, chunk_id ORDER BY score NULLS FIRST, doc_id NULLS FIRST) = 1),
        worth AS (SELECT *, round(score - 0.3 * (row_number() OVER (PARTITION BY query_id, doc_id ORDER BY {_TIES}) - 1), 9) AS worth, count(*) OVER (PARTITION BY query_id) AS n FROM candidates)
        SELECT query_id, rank, chunk_id, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY worth DESC, {_TIES}) AS rank FROM worth) WHERE rank <= least(5, ceil(n / 2))""",
    "retrieve_evidence": f"WITH {_RETRIEVAL} SELECT query_id, rank, chunk_id, source, length(text) AS size FROM retrieval WHERE score > 0",
    "signal_flags": f"WITH {_CHUNKS} SELECT chunk_id, {', '.join(f'{_signal(n)} AS {n}' for n in SIGNALS)} FROM once",
    "assess_evidence": f"""WITH {_CHUNKS} SELECT chunk_id, concat_ws('|', {', '.join(f"CASE WHEN {_signal(n)} THEN '{n}' END" for n in SIGNALS)}) AS signals,
            CASE WHEN {_SEVERE} THEN 'high' ELSE 'medium' END AS severity, ({_SEVERE}) AS quarantined FROM once WHERE {_ANY}""",
    "apply_policy": f"WITH {_EVIDENCE} SELECT query_id, rank, chunk_id FROM evidence WHERE NOT quarantined",
    "quarantine_summary": f"WITH {_EVIDENCE} SELECT query_id, count(*) AS quarantined, string_agg(chunk_id, '|' ORDER BY rank, chunk_id) AS chunk_ids FROM evidence WHERE quarantined GROUP BY query_id",
    "content_tokens": f"SELECT answer_id, array_to_string(list_sort({_tokens('answer')}), '|') AS tokens FROM answers",
    "citation_audit": f"""WITH {_AUDIT} SELECT answer_id, citations, valid_citations, invalid_citations, round(citation_validity_rate, 6) AS citation_validity_rate, round(lexical_grounding_rate, 6) AS lexical_grounding_rate,
        answer_content_tokens, supported_content_tokens, insufficient_citation_support FROM audit""",
    "grounding_by_mode": f"WITH {_AUDIT} SELECT prompt_mode, count(*) AS answers, round(avg(citation_validity_rate), 6) AS citation_validity_rate, round(avg(lexical_grounding_rate), 6) AS lexical_grounding_rate FROM audit GROUP BY prompt_mode",
    "sentence_claims": f"WITH {_claims('answers')} SELECT answer_id, claim_no, claim FROM claims",
    "claim_support": f"""WITH {_AUDIT}, {_claims('answers')}, supported AS (
            SELECT c.answer_id, c.claim_no, k.chunk_id, k.pos, {_tokens('c.claim')} AS tokens, k.evidence FROM claims c JOIN checked k ON k.answer_id = c.answer_id WHERE k.valid
        ), best AS (
            SELECT answer_id, claim_no, chunk_id, list_intersect(tokens, evidence) AS both_have, CASE WHEN len(tokens) > 0 THEN len(list_intersect(tokens, evidence)) / len(tokens) ELSE 1.0 END AS score FROM supported
            QUALIFY row_number() OVER (PARTITION BY answer_id, claim_no ORDER BY CASE WHEN len(tokens) > 0 THEN len(list_intersect(tokens, evidence)) / len(tokens) ELSE 1.0 END DESC, pos) = 1
        )
        SELECT c.answer_id, c.claim_no, c.claim, b.chunk_id AS best_chunk_id, round(coalesce(score, 0.0), 6) AS lexical_support, coalesce(array_to_string(list_sort(both_have), '|'), '') AS supported_tokens
        FROM claims c LEFT JOIN best b USING (answer_id, claim_no)""",
    "requirement_tokens": f"WITH {_REQUIREMENTS} SELECT requirement_id, text, array_to_string(tokens, '|') AS tokens FROM reqs",
    "numeric_facts": f"WITH {_REQUIREMENTS} SELECT requirement_id, text, fact_no, value, unit FROM facts",
    "requirement_polarity": f"WITH {_REQUIREMENTS} SELECT requirement_id, text, word, rank, negated FROM reqs",
    "overlap_pairs": f"WITH {_REQUIREMENTS} SELECT left_id, right_id, round(overlap, 6) AS overlap FROM pairs WHERE overlap >= 0.6",
    "find_conflicts": f"WITH {_CONFLICTS} SELECT left_id, right_id, kind, round(score, 6) AS score, explanation FROM conflicts",
    "conflict_summary": f"WITH {_CONFLICTS} SELECT kind, count(*) AS conflicts, round(avg(score), 6) AS score FROM conflicts GROUP BY kind",
    "build_prompts": f"WITH {_PROMPTS} SELECT query_id, mode, length(prompt) AS size, sha256(prompt) AS digest FROM prompts",
    "prompt_sizes": f"WITH {_PROMPTS} SELECT mode, count(*) AS prompts, round(avg(length(prompt)), 6) AS average_size, max(length(prompt)) AS largest FROM prompts GROUP BY mode",
    "extractive_answer": f"WITH {_ANSWERED} SELECT query_id, answer, citations, round(confidence, 6) AS confidence, insufficient_evidence, quarantined_chunk_ids FROM answered",
    "generated_answer": f"""WITH {_EVIDENCE}, allowed AS (SELECT query_id, list(chunk_id) AS ids FROM evidence WHERE NOT quarantined GROUP BY query_id)
        SELECT answer_id, case_id AS query_id, coalesce(answer, '') AS answer, array_to_string([c for c in coalesce(citations, []) if c IS NOT NULL AND list_contains(coalesce(ids, []), c)], '|') AS citations,
            array_to_string([c for c in coalesce(citations, []) if c IS NOT NULL AND NOT list_contains(coalesce(ids, []), c)], '|') AS rejected_citations,
            round(greatest(0.0, least(1.0, coalesce(confidence, 0.0))), 6) AS confidence, coalesce(insufficient_evidence, false) AS insufficient_evidence
        FROM answers LEFT JOIN allowed ON query_id = case_id""",
    "case_metrics": f"WITH {_METRICS} SELECT query_id, hit, recall, precision, round(reciprocal_rank, 6) AS reciprocal_rank, round(ndcg, 6) AS ndcg FROM metrics",
    "ranked_metrics": f"WITH {_METRICS} SELECT count(*) AS cases, {_RANKED} FROM metrics",
    "evaluate_end_to_end": f"WITH {_METRICS}, {_ANSWERED.partition(_RETRIEVAL + ', ')[2]}, {_JUDGED}",
    "schema_valid": f"SELECT answer_id, {_VALID} AS valid FROM answers",
    "prompt_mode_benchmark": f"""WITH {_PROMPTS}, allowed AS (SELECT query_id, list(chunk_id) AS ids FROM evidence WHERE NOT quarantined GROUP BY query_id), judged AS (
            SELECT a.prompt_mode AS mode, {_VALID} AS valid, length(prompt) AS size, a.confidence,
                CASE WHEN len(citations) > 0 THEN len([c for c in citations if list_contains(coalesce(ids, []), c)]) / len(citations) ELSE insufficient_evidence::INT END AS right_citations,
                (insufficient_evidence = coalesce(expected_insufficient_evidence, false))::INT AS right_refusal
            FROM answers a JOIN eval_cases e USING (case_id) JOIN prompts p ON p.query_id = a.case_id AND p.mode = a.prompt_mode LEFT JOIN allowed l ON l.query_id = a.case_id
        ) SELECT mode, count(*) AS cases, round(avg(valid::INT), 6) AS schema_validity_rate, round(avg(CASE WHEN valid THEN right_citations ELSE 0 END), 6) AS citation_validity_rate,
            round(avg(CASE WHEN valid THEN right_refusal ELSE 0 END), 6) AS insufficiency_accuracy, round(avg(CASE WHEN valid THEN confidence ELSE 0 END), 6) AS average_confidence, round(avg(size), 6) AS average_prompt_characters
        FROM judged GROUP BY mode""",
    "demo_mrr": f"""WITH once(chunk_id, doc_id, ordinal, text) AS (VALUES {', '.join(f"('{d}:0', {d}, 0, {_text(t)})" for d, _, t in demo.DOCUMENTS)}),
        questions(q, question, wanted) AS (VALUES {', '.join(f"({q}, {_text(t)}, {d})" for q, t, d in demo.QUESTIONS)}),
        {_word_terms('terms', 'once', 'chunk_id', 'text')}, {_word_terms('asked', 'questions', 'q', 'question')}, {_idf('idfs', 'terms')}, {_scores('words', 'terms', 'asked', 'idfs')},
        scored AS (SELECT q.q AS query_id, wanted, chunk_id, doc_id, ordinal, round(coalesce(s, 0), 9) AS score FROM questions q CROSS JOIN once o LEFT JOIN words w ON w.q = q.q AND w.k = o.chunk_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {_TIES}) AS rank FROM scored)
        SELECT count(*) AS cases, round(avg(reciprocal), 6) AS mrr FROM (SELECT query_id, coalesce(1.0 / min(rank) FILTER (doc_id = wanted AND rank <= 3), 0) AS reciprocal FROM ranked GROUP BY query_id)""",
}
