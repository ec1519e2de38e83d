"""SQL that states the core queries over the same tables, for the driver's comparison."""

from __future__ import annotations

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_WS = WS[0] + "^" + WS[1:]
BLANK = WS.replace(r"\t-\r", r"\t\x0b-\r")  # without the line feed

D = "d AS (SELECT DISTINCT ON (pk) pk, crate, title, text_content AS text, parsed_content AS blocks, source_path, item_path, url FROM document_record)"
C = "c AS (SELECT DISTINCT ON (pk) * FROM chunk_record)"
CD = f"{D}, {C}, cd AS (SELECT c.*, d.source_path, d.crate FROM c JOIN d ON c.document_pk = d.pk)"


def strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS}+', ''), '{WS}+$', '')"


def collapsed(x: str) -> str:
    return f"regexp_replace({strip(f'lower({x})')}, '{WS}+', ' ', 'g')"


def text_hash(x: str) -> str:
    return f"sha256({collapsed(x)})"


def tidy(x: str) -> str:
    lf = f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return rf"regexp_replace(regexp_replace({lf}, '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"


def points(x: str) -> str:
    return rf"regexp_replace({x}, ' +([,.;:!?])', '\1', 'g')"


def marks(x: str) -> str:
    return f"replace(regexp_replace({x}, '(?m)^{NOT_WS}{{0,8}}§{BLANK}+', '', 'g'), '§ ', '')"


def clean(x: str, crate: str) -> str:
    t = marks(tidy(x))
    t = rf"CASE WHEN {crate} = 'reference' THEN regexp_replace({t}, '(?m)^\[[a-z0-9_.-]+\]{WS}*$\n?', '', 'g') ELSE {t} END"
    t = rf"regexp_replace({t}, '\b([A-Za-z0-9]+)_{WS}+([A-Za-z0-9]+)\b', '\1_\2', 'g')"
    t = rf"regexp_replace({t}, '`([^`\n]+)`{WS}+s\b', '`\1`s', 'g')"
    return strip(points(t))


def clean_code(x: str) -> str:
    lf = marks(f"replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10))")
    return rf"regexp_replace(regexp_replace({lf}, '^\n+', ''), '\n+$', '')"


def block(b: str) -> str:
    return (
        f"CASE {b}.block_type WHEN 'list_item' THEN repeat('  ', coalesce({b}.list_depth, 0)) || '- ' || {b}.text"
        f" WHEN 'code_block' THEN '```' || coalesce(nullif({b}.code_language, ''), 'text') || chr(10) || {b}.text || chr(10) || '```'"
        f" WHEN 'definition_term' THEN '- ' || {b}.text WHEN 'definition_desc' THEN '  - ' || {b}.text ELSE {b}.text END"
    )


def render(blocks: str) -> str:
    return strip(points(tidy(f"coalesce(array_to_string(list_transform({blocks}, lambda b: {block('b')}), chr(10) || chr(10)), '')")))


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    variant = f"lpad(lower(to_hex((('0x' || substr({h}, 17, 2))::INT & 63) | 128)), 2, '0')"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || {variant} || substr({h}, 19, 2) || '-' || substr({h}, 21, 12)"


def doc_id(path: str) -> str:
    return uuid5("3d73b6b9-a8cb-4da8-b4b0-5ecdb09b3836", path)


def path_order(path: str) -> str:
    return f"length({path}) - length(replace({path}, '/', '')), length({path})"


_CLEAN_BLOCKS = f"list_filter(list_transform(coalesce(blocks, []), lambda b: {{'block_type': b.block_type, 'list_depth': b.list_depth, 'code_language': b.code_language, 'text': CASE WHEN b.block_type = 'code_block' THEN {clean_code('b.text')} ELSE {clean('b.text', 'crate')} END}}), lambda b: b.text <> '')"
CLEAN_DOCS = f"k AS (SELECT pk, crate, source_path, item_path, text, {_CLEAN_BLOCKS} AS blocks FROM d), cl AS (SELECT pk, crate, source_path, item_path, blocks, CASE WHEN len(blocks) > 0 THEN {render('blocks')} ELSE {clean('text', 'crate')} END AS text FROM k)"

_URLS = "CASE WHEN crate IN ('book', 'reference', 'cargo', 'std', 'core', 'alloc', 'proc_macro', 'test') AND contains(source_path, '/') THEN 'https://doc.rust-lang.org/' || crate || '/' || regexp_replace(source_path, '^[^/]*/', '') END"
_WORDS = (("fn", "fn|function"), ("struct", "struct"), ("trait", "trait"), ("method", "method"), ("impl", "impl|implementation"), ("module", "mod|module"), ("macro", "macro"), ("enum", "enum"), ("constant", "const|constant"), ("type", "type"))


def _ladder() -> str:
    stem = r"regexp_replace(regexp_extract(source_path, '[^/]*$'), '(.)\.[^.]*$', '\1')"
    rules = [f"WHEN starts_with({stem}, '{p}.') THEN '{t}'" for p, t in (("fn", "fn"), ("struct", "struct"), ("trait", "trait"), ("macro", "macro"), ("enum", "enum"), ("constant", "constant"), ("type", "type"), ("mod", "module"))]
    rules += ["WHEN regexp_extract(source_path, '[^/]*$') = 'index.html' THEN 'module'", "WHEN lower(title) = 'std' THEN 'module'", "WHEN ends_with(title, '!') THEN 'macro'", "WHEN contains(lower(title), '::keyword::') THEN 'keyword'", "WHEN contains(lower(title), '::primitive::') THEN 'primitive'"]
    for field in ("lower(title)", "lower(substr(text, 1, 700))"):
        rules += [rf"WHEN regexp_matches({field}, '\b({p})\b') THEN '{t}'" for t, p in _WORDS]
    return f"CASE WHEN crate IN ('book', 'cargo', 'reference') THEN 'page' WHEN crate <> 'std' THEN NULL {' '.join(rules)} ELSE 'unknown' END"


_ITEM_PATH = r"""
CASE WHEN crate IN ('std', 'core', 'alloc', 'proc_macro', 'test') THEN nullif(title, '')
WHEN starts_with(source_path, crate || '/') THEN array_to_string(list_concat([crate], list_filter(
  list_concat(string_split(regexp_replace(source_path, '^[^/]*/', ''), '/')[:-2], [regexp_replace(string_split(source_path, '/')[-1], '(.)\.[^.]*$', '\1')]),
  lambda p: p NOT IN ('index', '.'))), '::') END"""

_EXCLUDED = "'theme', 'css', 'fonts', 'FontAwesome', 'images', 'img', '.git', '.venv', '__pycache__', 'first-edition', 'second-edition', '2018-edition'"
_SELECTED = rf"""
{D}, n AS (SELECT pk, crate, source_path, regexp_extract(source_path, '[^/]*$') AS name FROM d)
SELECT pk FROM n WHERE NOT list_has_any(string_split(source_path, '/'), [{_EXCLUDED}])
AND NOT regexp_matches(source_path, '\.(js|css|png|jpg|jpeg|svg|gif|ico|woff|woff2|ttf|eot|json|txt|md)$')
AND name NOT IN ('.nojekyll', 'print.html', 'toc.html') AND source_path NOT IN ('.nojekyll', 'print.html', 'toc.html')
AND NOT (crate = 'book' AND name IN ('README.html', 'SUMMARY.html', 'title-page.html')) AND NOT (crate = 'cargo' AND name = 'CHANGELOG.html')
AND NOT (crate = 'std' AND name = 'all.html') AND NOT (crate = 'reference' AND ends_with(name, '-redirect.html'))"""

_SIGNATURE = r"\b(fn|impl|trait|struct|enum|type|const|pub|unsafe)\b"
_LINES = r"regexp_split_to_array(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]')"

UNIQUE_CHUNKS = f"""
WITH {CD}, h AS (SELECT *, {text_hash("coalesce(text, '')")} AS text_hash FROM cd),
f AS (SELECT *, row_number() OVER (PARTITION BY crate, text_hash ORDER BY {path_order('source_path')}, length(coalesce(array_to_string(section_path, '::'), '')), source_path || ':' || chunk_index, start_offset) = 1 AS kept FROM h),
a AS (SELECT *, bool_or(kept) OVER (PARTITION BY source_path) AS any_kept, row_number() OVER (PARTITION BY source_path ORDER BY chunk_index, length(text), start_offset) = 1 AS best FROM f),
r AS (SELECT * FROM a WHERE kept OR (NOT any_kept AND best)),
n AS (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY start_offset NULLS FIRST, end_offset NULLS FIRST, chunk_index) - 1 AS i FROM r)
SELECT pk, i AS chunk_index, {uuid5('82f00626-72d1-4ee7-90a5-c281a4f3f4ec', f"({doc_id('source_path')}) || ':' || i")} AS id, text_hash FROM n"""

HITS = "h AS (SELECT DISTINCT query_id || '/' || mode AS query_id, chunk_id, rank, score, searched_at, received_at FROM search_hit)"
HYDRATED = f"{D}, {C}, {HITS}, hd AS (SELECT h.query_id, h.rank, h.chunk_id, c.text, c.token_count, d.source_path, d.title, d.crate, d.item_path FROM h JOIN c ON c.id = h.chunk_id JOIN d ON d.pk = c.document_pk)"

LEXICAL = f"""{D}, {C},
qw AS (SELECT id AS query_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]{{3,}}')) AS w FROM eval_case),
cw AS (SELECT id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]{{3,}}'))) AS word FROM c),
ls AS (SELECT query_id, id, count(*) / any_value(len(w)) AS score FROM (SELECT query_id, w, unnest(w) AS word FROM qw) JOIN cw USING (word) GROUP BY query_id, id),
lx AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ls QUALIFY rank <= 20)"""
RERANKED = rf"""{LEXICAL},
rw AS (SELECT lx.query_id, lx.id, lx.rank, list_distinct(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS q, list_distinct(regexp_extract_all(lower(c.text), '[a-z0-9_]+')) AS t FROM lx JOIN c USING (id) JOIN eval_case e ON e.id = lx.query_id),
rs AS (SELECT query_id, id, rank AS old, len(list_intersect(q, t)) / len(q) AS score FROM rw),
rr AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, old) AS rank FROM rs QUALIFY rank <= 10)"""


def _first_ranks(hits: str, name: str) -> str:
    value = "CASE k WHEN 'title' THEN coalesce(title, 'none') WHEN 'source_path' THEN coalesce(source_path, 'none') WHEN 'item_path' THEN coalesce(item_path, 'none') WHEN 'text' THEN coalesce(text, 'none') WHEN 'url' THEN coalesce(url, 'none') WHEN 'crate' THEN coalesce(crate, 'none') ELSE '' END"
    exact = "CASE key WHEN 'title' THEN title WHEN 'source_path' THEN source_path WHEN 'item_path' THEN item_path WHEN 'text' THEN text WHEN 'url' THEN url WHEN 'crate' THEN crate END"
    return f"""
{name}h AS (SELECT x.query_id, x.rank, c.text, d.title, d.source_path, d.item_path, d.url, d.crate FROM {hits} x JOIN c USING (id) JOIN d ON d.pk = c.document_pk),
{name}e AS (SELECT id AS query_id, unnest(expected) AS m, unnest(range(len(expected))) AS crit FROM eval_case),
{name}x AS (SELECT query_id, crit, unnest(map_entries(m)) AS kv FROM {name}e),
{name}k AS (SELECT query_id, crit, kv.key AS key, kv.value AS val, regexp_replace(kv.key, '_contains$', '') AS k FROM {name}x),
{name}m AS (SELECT query_id, crit, rank FROM {name}k JOIN {name}h USING (query_id) GROUP BY query_id, crit, rank
  HAVING bool_and(CASE WHEN ends_with(key, '_contains') THEN contains(lower({value}), lower(val)) ELSE coalesce({exact} = val, false) END)),
{name} AS (SELECT e.id AS case_id, (SELECT min(rank) FROM {name}m WHERE query_id = e.id) AS rank, (SELECT arg_min(source_path, rank) FROM {name}h WHERE query_id = e.id) AS top_source_path FROM eval_case e)"""


LEXICAL_RANKS = f"WITH {LEXICAL}, {_first_ranks('lx', 'fl')}"


def _vectors(score: str, order: str, where: str = "true", k: int = 10, columns: str = "query_id, id, round(score, 5) AS score, rank") -> str:
    return f"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, {score} AS score FROM v q CROSS JOIN v WHERE q.vec_id % 100 = 0 AND {where}),
r AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, id) AS rank FROM s)
SELECT {columns} FROM r WHERE rank <= {k}"""


ORACLE: dict[str, str] = {
    "text_hashes": f"SELECT doc_id, {text_hash('text')} AS hash FROM documents",
    "clean_texts": f"SELECT doc_id, md5({clean('text', 'crate')}) AS clean_md5 FROM documents",
    "normal_texts": f"SELECT doc_id, md5({strip(points(tidy('text')))}) AS normal_md5 FROM documents",
    "clean_code": f"WITH {D}, b AS (SELECT pk, unnest(blocks) AS b, unnest(range(len(blocks))) AS block_no FROM d) SELECT pk, block_no, md5({clean_code('b.text')}) AS code_md5 FROM b WHERE b.block_type = 'code_block'",
    "rendered_blocks": f"WITH {D} SELECT pk, md5({render('blocks')}) AS text_md5 FROM d",
    "clean_document_sizes": f"WITH {D}, {CLEAN_DOCS} SELECT pk, len(blocks) AS blocks, length(text) AS chars FROM cl WHERE length(text) >= 30",
    "short_documents": f"SELECT doc_id, length({clean('text', 'crate')}) < 30 AS short FROM documents",
    "token_counts": rf"WITH {C} SELECT pk, len(regexp_extract_all(text, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) AS tokens FROM c",
    "document_ids": f"WITH {D} SELECT pk, {doc_id('source_path')} AS document_id FROM d",
    "chunk_ids": f"WITH {CD}, i AS (SELECT pk, chunk_index, {doc_id('source_path')} AS did FROM cd) SELECT pk, {uuid5('82f00626-72d1-4ee7-90a5-c281a4f3f4ec', chr(34) + 'did' + chr(34) + " || ':' || chunk_index")} AS chunk_id FROM i",
    "document_urls": f"WITH {D} SELECT pk, {_URLS} AS url FROM d",
    "detected_crates": f"WITH {D} SELECT pk, CASE WHEN split_part(source_path, '/', 1) IN ('book', 'cargo', 'reference', 'std') THEN split_part(source_path, '/', 1) ELSE 'unknown' END AS crate FROM d",
    "item_paths": f"WITH {D} SELECT pk, {_ITEM_PATH} AS item_path FROM d",
    "item_types": f"WITH {D} SELECT pk, {_ladder()} AS item_type FROM d",
    "section_titles": f"WITH {C} SELECT pk, section_path[-1] AS section_title FROM c",
    "selected_paths": f"WITH {_SELECTED}",
    "page_flags": """SELECT doc_id, contains(lower(substr(text, 1, 2048)), 'http-equiv="refresh"') AND contains(lower(substr(text, 1, 2048)), 'url=') AND (contains(lower(substr(text, 1, 2048)), '<title>redirection</title>') OR contains(lower(substr(text, 1, 2048)), '<title>redirecting...</title>') OR contains(lower(substr(text, 1, 2048)), 'redirecting to...') OR contains(lower(substr(text, 1, 2048)), 'window.location.replace(')) AS redirect, contains(lower(substr(text, 1, 4096)), 'there is a new edition of the book and this is an old link.') AS legacy FROM documents""",
    "block_codec": f"WITH {D} SELECT pk, coalesce(len(blocks), -1) AS blocks, true AS same FROM d",
    "parsed_pages": rf"WITH {D}, b AS (SELECT pk, unnest(blocks) AS b FROM d) SELECT pk, b.block_type AS block_type, count(*) AS blocks FROM b WHERE regexp_matches(b.text, '\S') GROUP BY ALL",
    "unique_documents": f"WITH {D} SELECT pk FROM d QUALIFY row_number() OVER (PARTITION BY crate, {text_hash('text')} ORDER BY {path_order('source_path')}, length(coalesce(item_path, '')), source_path) = 1",
    "duplicate_groups": f"SELECT crate, {text_hash('text')} AS hash, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
    "unique_chunks": UNIQUE_CHUNKS,
    "renumbered_chunks": f"WITH {CD} SELECT pk, row_number() OVER (PARTITION BY source_path ORDER BY start_offset NULLS FIRST, end_offset NULLS FIRST, chunk_index) - 1 AS chunk_index FROM cd",
    "low_value_chunks": f"WITH {C} SELECT pk, length(text) < 80 AND {collapsed('text')} IN ('added', 'changed', 'fixed', 'removed', 'nightly only', 'documentation', 'internal') AND NOT contains(text, '```') AND NOT regexp_matches(text, '{_SIGNATURE}') AS low_value FROM c",
    "changelog_stubs": rf"WITH {CD} SELECT pk, coalesce(crate = 'cargo' AND source_path = 'cargo/CHANGELOG.html' AND len(section_path) = 2 AND length(text) < 180 AND len(list_filter({_LINES}, lambda x: regexp_matches(x, '\S'))) <= 2, false) AS stub FROM cd",
    "lone_headings": f"WITH {C}, n AS (SELECT pk, text, section_path, coalesce(lag(section_path) OVER w = section_path, false) OR coalesce(lead(section_path) OVER w = section_path, false) AS near FROM c WINDOW w AS (PARTITION BY document_pk ORDER BY chunk_index, pk)) SELECT pk, coalesce({strip('text')} <> '' AND NOT contains(text, '```') AND {strip('text')} = {strip('section_path[-1]')}, false) AS lone, near FROM n",
    "block_sections": f"WITH {D}, b AS (SELECT pk, unnest(blocks) AS b, unnest(range(len(blocks))) AS block_no FROM d) SELECT pk, block_no, sum((b.block_type = 'heading')::INT) OVER (PARTITION BY pk ORDER BY block_no)::BIGINT AS section FROM b",
    "numbered_batches": f"WITH {CD} SELECT pk, (row_number() OVER (PARTITION BY document_pk ORDER BY pk) - 1) // 32 AS batch_no FROM cd",
    "vector_top_cosine": _vectors("list_cosine_similarity(q.x, v.x)", "DESC"),
    "vector_top_dot": _vectors("list_inner_product(q.x, v.x)", "DESC"),
    "vector_top_euclid": _vectors("list_distance(q.x, v.x)", "ASC"),
    "vector_top_manhattan": _vectors("list_sum(list_transform(list_zip(q.x, v.x), lambda p: abs(p[1] - p[2])))", "ASC"),
    "vector_threshold": _vectors("list_cosine_similarity(q.x, v.x)", "DESC", "list_cosine_similarity(q.x, v.x) >= 0.2", 50, "query_id, id, rank"),
    "vector_filtered": _vectors("list_cosine_similarity(q.x, v.x)", "DESC", "v.label < 5", 10, "query_id, id, rank"),
    "point_payloads": """
WITH p AS (SELECT DISTINCT chunk_id, crate, document_id, item_path, item_type, rust_version, section_title, source_path, text_hash FROM vector_point),
l AS (SELECT chunk_id, [{'k': 'crate', 'v': crate}, {'k': 'document_id', 'v': document_id}, {'k': 'item_path', 'v': item_path}, {'k': 'item_type', 'v': item_type}, {'k': 'rust_version', 'v': rust_version}, {'k': 'section_title', 'v': section_title}, {'k': 'source_path', 'v': source_path}, {'k': 'text_hash', 'v': text_hash}] AS all FROM p),
f AS (SELECT chunk_id, list_filter("all", lambda e: e.v IS NOT NULL) AS e FROM l)
SELECT chunk_id, array_to_string(list_transform(e, lambda x: x.k), ',') AS keys, array_to_string(list_transform(e, lambda x: x.v), '|') AS payload FROM f""".replace(" AS all ", ' AS "all" '),
    "message_coverage": "SELECT doc_id, true AS short, true AS whole FROM documents",
    "batch_coverage": f"WITH {C} SELECT count(*) AS items, 0 AS broken FROM c",
    "decoded_payloads": "SELECT DISTINCT chunk_id, document_id, crate, item_path, section_title, chunk_index FROM vector_point",
    "hydrated_hits": f"WITH {HYDRATED} SELECT query_id, rank::BIGINT AS rank, chunk_id, source_path, title, crate FROM hd",
    "first_hits": f"WITH {HYDRATED} SELECT query_id, count(*) AS kept, max(rank)::BIGINT AS last_rank FROM hd WHERE rank <= 10 GROUP BY query_id",
    "lexical_hits": f"WITH {LEXICAL} SELECT query_id, id, round(score, 6) AS score, rank FROM lx",
    "reranked_hits": f"WITH {RERANKED} SELECT query_id, id, round(score, 6) AS score, rank FROM rr",
    "context_prefix": f"WITH {HYDRATED}, o AS (SELECT DISTINCT ON (query_id, rank) query_id, rank, token_count FROM hd), s AS (SELECT query_id, rank, sum(coalesce(token_count, 0)) OVER (PARTITION BY query_id ORDER BY rank) AS t FROM o) SELECT query_id, rank::BIGINT AS rank, t::BIGINT AS context_tokens FROM s WHERE t <= 2500",
    "prompt_texts": f"""WITH {LEXICAL}, hd AS (SELECT lx.query_id, lx.rank, c.text, coalesce(c.token_count, 0) AS n, d.title, d.item_path, d.crate FROM lx JOIN c USING (id) JOIN d ON d.pk = c.document_pk),
s AS (SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY rank) AS t, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM hd),
b AS (SELECT query_id, count(*) AS blocks, string_agg('[' || i || '] ' || coalesce(nullif(item_path, ''), title, '') || ' | ' || coalesce(nullif(crate, ''), 'unknown') || ' | token_count=' || n || chr(10) || text, chr(10) || chr(10) ORDER BY i) AS ctx FROM s WHERE t <= 2500 GROUP BY query_id)
SELECT e.id AS query_id, md5('Question:' || chr(10) || question || chr(10) || chr(10) || 'Context:' || chr(10) || ctx) AS prompt_md5, coalesce(blocks, 0) AS blocks, ctx IS NULL AS unanswered FROM eval_case e LEFT JOIN b ON b.query_id = e.id""",
    "eval_ranks": f"{LEXICAL_RANKS} SELECT case_id, rank, top_source_path FROM fl",
    "eval_summary": f"{LEXICAL_RANKS} SELECT count(*) AS total, count(rank) AS matched, round(count(rank) / count(*), 6) AS hit_rate, round(sum(coalesce(1 / rank, 0)) / count(*), 6) AS mrr, count(rank) / count(*) >= 0.8 AS passed FROM fl",
    "eval_weak_cases": f"{LEXICAL_RANKS} SELECT case_id, rank FROM fl WHERE rank IS NULL OR rank <> 1",
    "eval_comparison": f"WITH {RERANKED}, {_first_ranks('lx', 'fl')}, {_first_ranks('rr', 'fr')} SELECT fl.case_id, fl.rank AS rank_a, fr.rank AS rank_b, CASE WHEN coalesce(fr.rank, 999) < coalesce(fl.rank, 999) THEN 'improved' WHEN coalesce(fr.rank, 999) > coalesce(fl.rank, 999) THEN 'regressed' ELSE 'same' END AS change FROM fl JOIN fr USING (case_id)",
    "eval_deltas": f"WITH {RERANKED}, {_first_ranks('lx', 'fl')}, {_first_ranks('rr', 'fr')}, x AS (SELECT fl.rank AS a, fr.rank AS b FROM fl JOIN fr USING (case_id)) SELECT round(count(b) / count(*) - count(a) / count(*), 6) AS hit_rate_delta, round(coalesce(sum(1 / b), 0) / count(*) - coalesce(sum(1 / a), 0) / count(*), 6) AS mrr_delta, count(*) FILTER (WHERE coalesce(b, 999) < coalesce(a, 999)) AS improved, count(*) FILTER (WHERE coalesce(b, 999) > coalesce(a, 999)) AS regressed, count(*) FILTER (WHERE coalesce(b, 999) = coalesce(a, 999)) AS same FROM x",
    "rejected_questions": rf"WITH q AS (SELECT doc_id AS query_id, coalesce(regexp_replace(text, '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g'), '') AS q FROM documents) SELECT query_id, length(q)::INT AS chars, CASE WHEN length(q) = 0 THEN 'blank' WHEN length(q) > 1000 THEN 'too_long' WHEN len(regexp_extract_all(q, '[A-Za-z0-9_]+|[^\sA-Za-z0-9_]')) > 200 THEN 'too_many_tokens' END AS rejected FROM q",
    "hit_latency": "SELECT mode, round(avg((epoch_us(received_at) - epoch_us(searched_at)) / 1000), 2) AS average_latency_ms, count(*) AS hits FROM (SELECT DISTINCT * FROM search_hit) GROUP BY mode",
    "hit_arrivals": "SELECT date_trunc('day', searched_at) AS start, mode, count(*) AS hits, round(avg(score), 6) AS mean_score FROM (SELECT DISTINCT * FROM search_hit) WHERE searched_at IS NOT NULL GROUP BY ALL",
    "documents_without_chunks": "SELECT DISTINCT pk FROM document_record WHERE pk NOT IN (SELECT document_pk FROM chunk_record WHERE chunk_index > 3)",
    "chunks_without_documents": "SELECT DISTINCT document_pk AS pk FROM chunk_record WHERE document_pk NOT IN (SELECT pk FROM document_record)",
    "path_difference": f"WITH {HYDRATED} SELECT source_path FROM document_record EXCEPT SELECT source_path FROM hd",
    "vectors_of_lost_chunks": "SELECT DISTINCT chunk_id FROM vector_point WHERE chunk_id NOT IN (SELECT id FROM chunk_record)",
    "stage_counts": f"WITH {D}, {CLEAN_DOCS}, k2 AS (SELECT * FROM cl WHERE length(text) >= 30), u AS (SELECT DISTINCT crate, {text_hash('text')} AS h FROM k2) SELECT 'clean' AS stage, count(*) AS n FROM k2 UNION ALL SELECT 'dedup', count(*) FROM u",
}
