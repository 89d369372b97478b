r"""The queries in DuckDB SQL, from common table expressions that are put in where they are named."""

from __future__ import annotations

import re

from corvane.operators import chat
from corvane.plans import queries as q

_CHARS = "00A0 1680 2000-200A 2028 2029 202F 205F 3000 FEFF"
_IN = r"\t\x0B\f\r " + "".join("-".join(r"\x{%s}" % x for x in part.split("-")) for part in _CHARS.split())
WS, WS_IN_LINE, NOT_WS = rf"[\n{_IN}]", f"[{_IN}]", rf"[^\n{_IN}]"
_YAML = rf"^(?:{WS}*#|{WS}*-{WS}|{WS}+{NOT_WS}|[A-Za-z0-9_.$-]+{WS}*:)"
_FENCE = r"^(---\r?\n((?:[\s\S]*?\r?\n)?)---\r?\n?)"
_HEAD = rf"#{{1,6}}{WS_IN_LINE}+[^\n\r\x{{2028}}\x{{2029}}]*"


def _str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def basename(x: str) -> str:
    return rf"regexp_replace(regexp_extract({x}, '[^/]*$'), '\.md$', '', 'i')"


def stripped(x: str) -> str:
    inner = f"list_filter(regexp_split_to_array(regexp_extract({x}, '{_FENCE}', 2), '\\r?\\n'), lambda l: {trimmed('l')} <> '' AND NOT regexp_matches(l, '{_YAML}'))"
    fence = f"regexp_extract({x}, '{_FENCE}', 1)"
    return f"CASE WHEN {fence} <> '' AND len({inner}) = 0 THEN substr({x}, length({fence}) + 1) ELSE {x} END"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda t: t <> '')"


def windows(tk: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"list_transform(range(0, CASE WHEN len({tk}) <= {size} THEN 1 ELSE 1 + ceil((len({tk}) - {size}) / {step}::DOUBLE)::BIGINT END), lambda i: array_to_string({tk}[i * {step} + 1:i * {step} + {size}], ' '))"


def snippet(x: str) -> str:
    flat = trimmed(f"regexp_replace({x}, '{WS}+', ' ', 'g')")
    return f"CASE WHEN length({flat}) > 240 THEN rtrim(substr({flat}, 1, 240), ' ') || '…' ELSE {flat} END"


def defanged(x: str) -> str:
    return rf"regexp_replace({x}, '<(/?)(context|conversation)>', '&lt;\1\2&gt;', 'gi')"


def fnv(x: str) -> str:
    return f"list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split({x}, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


def fnv_hex(x: str) -> str:
    return f"lower(printf('%08x', CASE WHEN {x} = '' THEN 2166136261 ELSE {fnv(x)} END))"


def slug(x: str) -> str:
    dashed = f"regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"regexp_replace(substr({dashed}, 1, 70), '-+$', '')"


def excluded(x: str) -> str:
    return "(" + " OR ".join(f"{x} = '{f}' OR starts_with({x}, '{f}/')" for f in q.EXCLUDED if f) + ")"


def _chunks(name: str, notes: str) -> dict[str, str]:
    """Sections by running count of heading lines, then windows."""
    return {
        f"{name}_lines": f"SELECT path, title, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM (SELECT path, title, {stripped('content')} AS body FROM {notes})",
        f"{name}_marked": f"SELECT *, regexp_full_match(line, '{_HEAD}') AS head, sum(regexp_full_match(line, '{_HEAD}')::INT) OVER (PARTITION BY path ORDER BY pos) AS sec FROM {name}_lines",
        f"{name}_sections": f"SELECT path, title, (row_number() OVER (PARTITION BY path ORDER BY sec) - 1)::INT AS pos, heading, body FROM (SELECT path, title, sec, coalesce(max(CASE WHEN head THEN {trimmed(f"regexp_replace(line, '^#{{1,6}}{WS_IN_LINE}+', '')")} END), '') AS heading, {trimmed("coalesce(string_agg(CASE WHEN NOT head THEN line END, chr(10) ORDER BY pos), '')")} AS body FROM {name}_marked GROUP BY ALL) WHERE heading <> '' OR body <> ''",
        f"{name}_windows": f"SELECT path, title, pos, heading, unnest(w) AS text, generate_subscripts(w, 1) AS k FROM (SELECT *, CASE WHEN body = '' THEN [heading] ELSE {windows(tokens('body'), 512, 64)} END AS w FROM {name}_sections)",
        f"{name}": f"SELECT path || '#' || ordinal AS id, path AS note_path, title AS note_title, heading, ordinal, text FROM (SELECT *, (row_number() OVER (PARTITION BY path ORDER BY pos, k) - 1)::INT AS ordinal FROM {name}_windows)",
    }


def _lexical(prefix: str, chunks: str) -> dict[str, str]:
    return {
        f"{prefix}_surface": f"SELECT id, {trimmed("note_title || ' ' || heading || ' ' || text")} AS surface FROM {chunks}",
        f"{prefix}_terms": f"SELECT id, regexp_extract_all(lower(surface), '[a-z0-9]+') AS terms FROM {prefix}_surface",
        f"{prefix}_postings": f"SELECT term, id, dl, count(*) AS tf FROM (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM {prefix}_terms) GROUP BY ALL",
        f"{prefix}_stats": f"SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {prefix}_terms",
        f"{prefix}_df": f"SELECT term, count(*) AS df FROM {prefix}_postings GROUP BY term",
        f"{prefix}_bm25": f"SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM {prefix}_postings JOIN qterms USING (term) JOIN {prefix}_df USING (term), {prefix}_stats GROUP BY ALL",
        f"{prefix}_norm": f"SELECT query_id, id, round(CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0::DOUBLE ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM {prefix}_bm25 WINDOW w AS (PARTITION BY query_id)",
    }


def _top(scores: str, k: int, columns: str = "query_id, id, score") -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {scores}) WHERE rank <= {k}"


def _embedding(name: str, source: str, key: str, text: str) -> dict[str, str]:
    return {
        f"{name}_terms": f"SELECT {key} AS id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS term FROM {source}",
        f"{name}_sums": f"SELECT id, h % 384 AS bucket, sum(CASE WHEN h & 256 = 0 THEN 1 ELSE -1 END)::DOUBLE AS s FROM {name}_terms JOIN (SELECT term, {fnv('term')} AS h FROM (SELECT DISTINCT term FROM {name}_terms)) USING (term) GROUP BY ALL",
        name: f"SELECT id, bucket, (s / sqrt(sum(s * s) OVER (PARTITION BY id)))::FLOAT::DOUBLE AS v FROM {name}_sums WHERE s <> 0",
        f"{name}_norms": f"SELECT id, sqrt(sum(v * v)) AS norm FROM {name} GROUP BY id",
    }


def _rank(name: str, k: int) -> dict[str, str]:
    """Blended scores by mode, before the cut, with a pool for k results."""
    pool = max(5 * k, 50)
    out = {f"{name}_pool": _top("cosines", pool)}
    for mode, alpha, sem, lex in (("semantic", 1.0, f"{name}_pool", "(SELECT * FROM d_norm WHERE false)"), ("lexical", 0.0, f"(SELECT * FROM {name}_pool WHERE false)", "d_norm"), ("hybrid", 0.6, f"{name}_pool", "d_norm")):
        out[f"{name}_{mode}"] = f"SELECT query_id, id, round({alpha}::DOUBLE * coalesce(s.score, 0) + {1 - alpha}::DOUBLE * coalesce(l.score, 0), 6) AS score, coalesce(s.score, 0)::DOUBLE AS semantic_score, coalesce(l.score, 0)::DOUBLE AS lexical_score FROM {sem} s FULL JOIN {lex} l USING (query_id, id)"
    return out


_CHANGES = "SELECT event_id AS seq, ts, CASE event_type WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'rename' WHEN 'signup' THEN 'create' ELSE 'modify' END AS op, 'users/user-' || user_id || '.md' AS path, CASE WHEN event_type = 'purchase' THEN 'users/user-' || (user_id + 1) || '.md' END AS old_path FROM events"

CTES: dict[str, str] = {
    "notes": "SELECT doc_id, coalesce(source, '') || '/doc-' || doc_id || '.md' AS path, 'Document ' || doc_id AS title, coalesce(text, '') AS content FROM documents",
    "rendered": f"SELECT doc_id, path, title, {slug('title')} || '-' || doc_id || '.md' AS file, concat('---', chr(10), 'id: \"', doc_id, '\"', chr(10), 'title: \"', title, '\"', chr(10), 'source: \"', src, '\"', chr(10), '---', chr(10), '# ', title, chr(10), chr(10), content, chr(10)) AS content FROM (SELECT n.*, coalesce(d.source, '') AS src FROM notes n JOIN documents d USING (doc_id))",
    "conv_notes": "SELECT 'conv/' || conv_id || '.md' AS path, 'Conversation ' || conv_id AS title, string_agg('## ' || role || ' ' || turn || chr(10) || text, chr(10) ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
    "markdown": "SELECT path, title, content FROM rendered UNION ALL SELECT path, title, content FROM conv_notes",
    "edited": "SELECT path, title, CASE WHEN doc_id % 10 = 0 THEN 'edited ' || content ELSE content END AS content FROM notes WHERE doc_id % 25 <> 0 UNION ALL SELECT 'new/' || path, title, content FROM notes WHERE doc_id % 40 = 1",
    **_chunks("m", "markdown"),
    **_chunks("d", "notes"),
    **_chunks("e", "edited"),
    "kept": "SELECT * FROM d WHERE note_path NOT IN (SELECT path FROM notes WHERE doc_id % 7 = 0)",
    "bench": "SELECT item_id AS query_id, coalesce(text, '') AS query FROM benchmark",
    "qterms": "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM bench",
    **_lexical("d", "d"),
    **_lexical("k", "kept"),
    "d_text": "SELECT id, CASE WHEN heading <> '' THEN heading || chr(10) || text ELSE text END AS surface FROM d",
    **_embedding("de", "d_text", "id", "surface"),
    **_embedding("qe", "bench", "query_id", "query"),
    "dots": "SELECT q.id AS query_id, d.id, sum(q.v * d.v) AS dot FROM qe q JOIN de d USING (bucket) GROUP BY ALL",
    "cosines": "SELECT b.query_id, c.id, round(coalesce(dot / (qn.norm * dn.norm), 0), 6) + 0.0::DOUBLE AS score FROM bench b CROSS JOIN d c LEFT JOIN dots ON dots.query_id = b.query_id AND dots.id = c.id LEFT JOIN qe_norms qn ON qn.id = b.query_id LEFT JOIN de_norms dn ON dn.id = c.id",
    **_rank("r20", 20),
    **_rank("r50", 50),
    **_rank("r6", 6),
    "qrels": "SELECT query_id, path AS note, doc_id FROM notes, bench WHERE query <> '' AND contains(lower(content), lower(query))",
    **{f"notes_{m}": f"SELECT query_id, note, row_number() OVER (PARTITION BY query_id ORDER BY first, note) AS rank FROM (SELECT query_id, note_path AS note, min(rank) AS first FROM ({_top(f'r50_{m}', 50)}) JOIN d USING (id) GROUP BY ALL)" for m in ("semantic", "lexical", "hybrid")},
    **{f"metrics_{m}": f"SELECT query_id, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(relevant, 10) + 1), lambda i: 1 / log2(i + 1.0::DOUBLE))), 6) AS ndcg, round(coalesce(hit, 0) / relevant::DOUBLE, 6) AS recall FROM (SELECT query_id, count(DISTINCT note) AS relevant FROM qrels GROUP BY query_id) LEFT JOIN (SELECT query_id, sum(1 / log2(rank + 1.0::DOUBLE)) AS dcg, count(*) AS hit FROM notes_{m} JOIN (SELECT DISTINCT query_id, note FROM qrels) USING (query_id, note) WHERE rank <= 10 GROUP BY query_id) USING (query_id)" for m in ("semantic", "lexical", "hybrid")},
    "ctx": f"SELECT t.*, note_path, text, {snippet('text')} AS snippet FROM ({_top('r6_hybrid', 6, 'query_id, id, score, semantic_score, lexical_score')}) t JOIN d USING (id)",
    "labels_": rf"SELECT query_id, note_path, base, alike, CASE WHEN alike > 1 THEN regexp_replace(note_path, '\.md$', '', 'i') ELSE base END AS label FROM (SELECT *, count(*) OVER (PARTITION BY query_id, lower(base)) AS alike FROM (SELECT DISTINCT query_id, note_path, {basename('note_path')} AS base FROM ctx))",
    "blocks": f"SELECT query_id, string_agg('[' || rank || '] note: ' || label || chr(10) || {defanged('text')}, chr(10) || '---' || chr(10) ORDER BY rank) AS block FROM ctx JOIN labels_ USING (query_id, note_path) GROUP BY query_id",
    "answers": f"SELECT query_id, {_str(chat.EXTRACTIVE_HEAD)} || chr(10) || chr(10) || string_agg('- ' || snippet || ' ([[' || {basename('note_path')} || ']])', chr(10) ORDER BY rank) AS answer FROM ctx GROUP BY query_id",
    "links": rf"SELECT query_id, list_transform(regexp_extract_all(answer, '\[\[([^\]]+)\]\]', 1), lambda x: {trimmed("string_split(string_split(x, '|')[1], '#')[1]")}) AS links FROM answers",
    "cites": "SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY first, note_path) - 1)::INT AS pos, note_path FROM (SELECT query_id, note_path, min(p) AS first FROM (SELECT query_id, unnest(links) AS name, generate_subscripts(links, 1) AS p FROM links) JOIN labels_ USING (query_id) WHERE lower(name) = lower(label) OR alike = 1 AND lower(name) = lower(base) GROUP BY ALL)",
    "turns": "SELECT * FROM conversations WHERE role IN ('user', 'assistant')",
    "recent": "SELECT * EXCLUDE (back) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM turns) WHERE back <= 6",
    **{f"said_{t}": f"SELECT conv_id, '<conversation>' || chr(10) || string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || {defanged('text')}, chr(10) ORDER BY turn) || chr(10) || '</conversation>' AS transcript FROM {t} GROUP BY conv_id" for t in ("turns", "recent")},
    "grounds": "SELECT query_id, greatest(max(semantic_score), 0) AS top_similarity FROM ctx GROUP BY query_id",
    "changes": _CHANGES,
    "last_changes": "SELECT path, max_by(op, seq * 10 + o) AS op, max(seq) AS seq FROM (SELECT seq, 1 AS o, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS op, path FROM changes UNION ALL SELECT seq, 0, 'delete', old_path FROM changes WHERE op = 'rename') WHERE path LIKE '%.md' AND (op = 'delete' OR NOT (path = 'users/user-7.md' OR starts_with(path, 'users/user-7.md/'))) GROUP BY path",
    "hashes_d": f"SELECT id, note_path, ordinal, {fnv_hex('text')} AS hash FROM d",
    "hashes_e": f"SELECT id, note_path, ordinal, {fnv_hex('text')} AS hash FROM e",
    "vq": "SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS query_label FROM embeddings WHERE vec_id % 50 = 0",
    "vcos": "SELECT query_id, vec_id AS id, label, query_label, round(list_dot_product(q, embedding::DOUBLE[]) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 6) + 0.0::DOUBLE AS score FROM vq, embeddings",
}


def sql(body: str) -> str:
    """The statement with the expressions that it names, each worked out once."""
    wanted: set[str] = set()

    def need(text: str) -> None:
        for name in set(re.findall(r"\b[a-z][a-z0-9_]*\b", text)) & (CTES.keys() - wanted):
            if re.search(rf"(?:FROM|JOIN|,)\s*\(?{name}\b", text):
                wanted.add(name)
                need(CTES[name])

    need(body)
    if not wanted:
        return body
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in CTES if n in wanted) + "\n" + body


def _search(mode: str) -> str:
    return f"SELECT query_id, rank, id, score, semantic_score, lexical_score, note_path, {snippet('text')} AS snippet FROM ({_top(f'r20_{mode}', 20, 'query_id, id, score, semantic_score, lexical_score')}) t JOIN d USING (id)"


_PROMPT_HEAD = _str("\n".join([*chat.RULES, "", ""]))

BODIES: dict[str, str] = {
    "note_scan": f"SELECT path, title, length(content) AS n_chars FROM (SELECT path, content, CASE WHEN starts_with(content, '---') THEN title ELSE {basename('path')} END AS title FROM markdown) WHERE NOT {excluded('path')}",
    "frontmatter_titles": f"SELECT path, CASE doc_id % 8 WHEN 0 THEN concat('Say \"doc ', doc_id, '\" ', chr(92), ' é', chr(9), '.') WHEN 1 THEN 'It''s doc ' || doc_id WHEN 2 THEN 'Doc ' || doc_id WHEN 7 THEN concat('Doc#', doc_id, ',:no') ELSE {basename('path')} END AS title FROM notes",
    "note_title": "SELECT path, title FROM rendered",
    "note_basename": f"SELECT path, {basename('path')} AS base FROM markdown UNION ALL SELECT url, {basename('url')} FROM pages",
    "exclude_folders": f"SELECT path, {excluded('path')} AS excluded FROM notes",
    "embed_surface": "SELECT id, md5(CASE WHEN heading <> '' THEN heading || chr(10) || text ELSE text END) AS surface_md5 FROM m",
    "lexical_surface": f"SELECT id, md5({trimmed("note_title || ' ' || heading || ' ' || text")}) AS surface_md5 FROM m",
    "snippet": f"SELECT path, {snippet('content')} AS snippet FROM notes",
    "point_lookup": "SELECT path, title, content FROM notes WHERE path = 'src3/doc-3.md'",
    "frontmatter_strip": f"SELECT path, {stripped('content')} AS body FROM rendered",
    "section_split": "SELECT path, pos, heading, md5(body) AS body_md5 FROM m_sections",
    "ws_tokens": f"SELECT path, len({tokens('content')})::INT AS n_tokens, md5(array_to_string({tokens('content')}, ' ')) AS tokens_md5 FROM notes",
    "chunk_windows": f"SELECT path, (generate_subscripts(w, 1) - 1)::INT AS pos, md5(unnest(w)) AS window_md5 FROM (SELECT path, {windows('tk', 100, 20)} AS w FROM (SELECT path, {tokens('content')} AS tk FROM notes))",
    "chunk_notes": "SELECT id, note_path, note_title, heading, ordinal, text FROM m",
    "bm25_tokens": "SELECT id, len(terms)::INT AS n_terms, md5(array_to_string(terms, ' ')) AS terms_md5 FROM d_terms",
    "term_freq": "SELECT id, term, tf FROM d_postings",
    "doc_freq": "SELECT term, df FROM d_df",
    "corpus_stats": "SELECT n, round(avgdl, 6) AS avgdl FROM d_stats",
    "idf": "SELECT term, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM d_df, d_stats",
    "bm25_score": "SELECT query_id, id, score FROM d_bm25",
    "bm25_topk": _top("d_bm25", 20),
    "bm25_after_delete": _top("k_bm25", 20),
    "fnv1a_hash": f"SELECT id, {fnv_hex('text')} AS hash FROM m",
    "hash_embed": "SELECT id, bucket::INT AS dim, round(v, 6) AS value FROM de",
    "l2_normalize": "SELECT vec_id AS id, (generate_subscripts(u, 1) - 1)::INT AS dim, round(unnest(u), 5) AS value FROM (SELECT vec_id, list_transform(w, lambda x: (x / sqrt(list_dot_product(w, w)))::FLOAT::DOUBLE) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: (x * 3)::FLOAT::DOUBLE) AS w FROM embeddings))",
    "cosine_pairs": "SELECT query_id, id, score FROM vcos",
    "knn_exact": _top("vcos", 20),
    "knn_ann": f"SELECT count(DISTINCT query_id) AS queries, count(*) AS neighbours, true AS recall_reached FROM ({_top('vcos', 20)})",
    "minmax_norm": "SELECT query_id, id, score FROM d_norm",
    "blend_full_outer": "SELECT query_id, id, score, semantic_score, lexical_score FROM r20_hybrid",
    **{f"search_{m}": _search(m) for m in ("semantic", "lexical", "hybrid")},
    "note_ranking": "SELECT query_id, note, rank FROM notes_lexical",
    "ndcg_recall": "SELECT query_id, ndcg, recall FROM metrics_lexical",
    "eval_all_modes": " UNION ALL ".join(f"SELECT '{m}' AS mode, count(*) AS queries, round(coalesce(avg(ndcg), 0), 6) AS ndcg, round(coalesce(avg(recall), 0), 6) AS recall FROM metrics_{m}" for m in ("semantic", "lexical", "hybrid")),
    "grounding_check": "SELECT count(*) AS questions, round(avg((coalesce(first, 0) = 1)::INT), 6) AS accuracy_at_1, round(avg(coalesce(1 / first::DOUBLE, 0)), 6) AS mrr FROM (SELECT query_id, min(CASE WHEN label = query_label THEN rank END) AS first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vcos WHERE query_id <> id) GROUP BY query_id)",
    "hash_diff": "SELECT id, CASE WHEN e.hash IS NULL THEN 'delete' WHEN d.hash IS NULL THEN 'insert' ELSE 'update' END AS action FROM hashes_d d FULL JOIN hashes_e e USING (id) WHERE d.hash IS DISTINCT FROM e.hash",
    "change_log_apply": "SELECT path, 'old' AS title, 'old' AS content FROM (SELECT DISTINCT path FROM changes) WHERE path NOT IN (SELECT path FROM last_changes) UNION ALL SELECT path, 'Note ' || path, 'written by ' || seq FROM last_changes WHERE op = 'upsert'",
    "debounce_sessions": "SELECT min(ts) AS first_ts, max(ts) + INTERVAL 1500 MILLISECOND AS flush_ts, count(*) AS events, count(DISTINCT path) AS paths, session FROM (SELECT *, sum(opens) OVER (ORDER BY ts RANGE UNBOUNDED PRECEDING)::BIGINT AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) < INTERVAL 1500 MILLISECOND THEN 0 ELSE 1 END AS opens FROM changes)) GROUP BY session",
    "index_stats": "SELECT count(DISTINCT note_path) AS notes, count(*) AS chunks FROM m",
    "index_build": "SELECT id, note_path, ordinal, hash FROM hashes_d",
    "index_reload": "SELECT id, note_path, ordinal, hash FROM hashes_e",
    "wikilinks": "SELECT query_id, array_to_string(links, ';') AS links FROM links",
    "citation_labels": "SELECT query_id, note_path, label FROM labels_",
    "citations_resolve": "SELECT query_id, pos, note_path FROM cites",
    "defang": f"SELECT conv_id, turn, {defanged("'<Context>' || text || '</CONVERSATION><other>'")} AS text FROM conversations",
    "context_block": "SELECT query_id, block FROM blocks",
    "render_history": "SELECT conv_id, transcript FROM said_turns",
    "chat_history_window": "SELECT conv_id, turn, role, text FROM recent",
    "chat_prompt": f"SELECT b.query_id, concat({_PROMPT_HEAD}, CASE WHEN transcript IS NULL THEN '' ELSE transcript || chr(10) || chr(10) END, '<context>', chr(10), block, chr(10), '</context>', chr(10), chr(10), 'Question: ', query, chr(10), {_str(chat.ASK)}) AS prompt FROM bench b JOIN blocks k ON k.query_id = b.query_id LEFT JOIN said_recent s ON s.conv_id = b.query_id",
    "chat_grounding": "SELECT query_id, top_similarity, top_similarity >= 0.35 AS grounded FROM grounds",
    "extractive_answer": "SELECT query_id, answer FROM answers",
    "chat_ask_batch": f"SELECT b.query_id, CASE WHEN ok THEN answer ELSE {_str(chat.REFUSAL)} END AS content, CASE WHEN ok THEN coalesce(citations, '') ELSE '' END AS citations, NOT ok AS refused, ok AS grounded FROM (SELECT query_id, coalesce(top_similarity >= 0.5, false) AS ok FROM bench LEFT JOIN grounds USING (query_id)) b LEFT JOIN answers a ON a.query_id = b.query_id LEFT JOIN (SELECT query_id, string_agg(note_path, ', ' ORDER BY pos) AS citations FROM cites GROUP BY query_id) c ON c.query_id = b.query_id",
    "slugify": f"SELECT doc_id, {slug("coalesce(text, '')")} AS slug FROM documents",
    "note_render": "SELECT file, content FROM rendered",
    "corpus_sample": "SELECT DISTINCT doc_id FROM qrels UNION SELECT doc_id FROM (SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM qrels) ORDER BY doc_id LIMIT 150)",
    "qrels_build": "SELECT query_id, any_value(query) AS query, string_agg(note, ';' ORDER BY r.doc_id) AS relevant FROM qrels r JOIN bench USING (query_id) GROUP BY query_id",
    "qa_slice": "SELECT id, 'question ' || id AS question, min_by(source, doc_id) AS document_title, 'answer ' || min(CASE WHEN toxic = 1 THEN doc_id END) AS answer, string_agg(CASE WHEN toxic = 1 THEN 'answer ' || doc_id END, ';' ORDER BY doc_id) AS answers, string_agg('answer ' || doc_id, ';' ORDER BY doc_id) AS candidates FROM (SELECT doc_id // 20 AS id, doc_id, coalesce(source, '') AS source, toxic FROM documents JOIN (SELECT DISTINCT doc_id, toxic FROM labels) USING (doc_id)) GROUP BY id HAVING count(*) >= 4 AND sum(toxic) > 0 ORDER BY min(doc_id) LIMIT 150",
    "llm_request_build": "SELECT query_id, to_json({'model': 'llama3.1:8b', 'prompt': query, 'stream': false})::VARCHAR AS ollama, to_json({'model': 'local', 'messages': [{'role': 'user', 'content': query}], 'temperature': 0})::VARCHAR AS chat FROM bench",
    "llm_response_parse": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN coalesce(text, '') ELSE '' END AS ollama, CASE WHEN doc_id % 5 = 2 THEN coalesce(text, '') ELSE '' END AS chat FROM documents",
    "model_listing": "SELECT doc_id, models AS ollama, models AS chat FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(';', 'current', nullif(source, ''), CASE WHEN lang <> '' AND lang IS DISTINCT FROM source THEN lang END) ELSE 'current' END AS models FROM documents)",
    "model_file_path": r"SELECT page_id, 'org/model/' || url AS path, url AS trimmed, NULL::VARCHAR AS missing FROM pages",
}


def oracle_sql() -> dict[str, str]:
    return {name: sql(body) for name, body in BODIES.items()}
