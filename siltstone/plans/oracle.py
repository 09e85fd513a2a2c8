"""DuckDB SQL for the library's queries, written independently of their Spark plans."""

from __future__ import annotations

import numpy as np

from ..operators import chat, planner, quality

_WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_WS}+|{_WS}+\z', '', 'g')"


def _normalised(x: str) -> str:
    out = rf"regexp_replace(nfc_normalize({x}), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
    out = f"replace(replace({out}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    blank = _WS.replace(r"\t-\r", r"\t\x0b-\r")
    out = rf"regexp_replace({out}, '{blank}+\n', chr(10), 'g')"
    return _strip(rf"regexp_replace({out}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _clean(x: str) -> str:
    lf = f"replace(replace(coalesce({x}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    return _strip(rf"regexp_replace({lf}, '\n{{3,}}', chr(10) || chr(10), 'g')")


def _features(docs: str) -> str:
    """CTEs word_f and line_f with the features of ``docs`` (doc_id, text)."""
    stops = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
    return rf"""
base AS ({docs}),
token AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+') AS w FROM base),
word AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM token)),
gram AS (SELECT doc_id, max(c) AS top FROM (SELECT doc_id, g, count(*) AS c FROM (SELECT doc_id, w || ' ' || lead(w) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM word) WHERE g IS NOT NULL GROUP BY doc_id, g) GROUP BY doc_id),
word_f AS (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS different, sum(length(w)) AS chars, count(*) FILTER (regexp_matches(w, '\p{{L}}')) AS alpha, count(DISTINCT lower(w)) FILTER (lower(w) IN ({stops})) AS stops FROM word GROUP BY doc_id),
line AS (SELECT doc_id, i, l, {_strip("l")} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM base)),
line_f AS (SELECT doc_id, count(*) AS lines, max(length(l)) AS longest, count(*) FILTER (s <> '') AS filled, count(DISTINCT s) FILTER (s <> '') AS fresh,
  count(*) FILTER (regexp_matches(s, '^[*•-]')) AS bullets, count(*) FILTER (regexp_matches(s, '(\.\.\.|…)$')) AS cut FROM line GROUP BY doc_id),
symbol AS (SELECT doc_id, length(text) AS len, (length(text) - length(replace(text, '#', ''))) + (length(text) - length(replace(text, '...', ''))) / 3 + (length(text) - length(replace(text, '…', ''))) AS symbols,
  length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum, length(text) - length(replace(text, ' ', '')) AS spaces FROM base),
f AS (SELECT *, coalesce(n, 0) AS words, CASE WHEN lines < 2 THEN 0 ELSE (filled - fresh) / lines END AS repeated FROM base LEFT JOIN word_f USING (doc_id) LEFT JOIN gram USING (doc_id) JOIN line_f USING (doc_id) JOIN symbol USING (doc_id))"""


_PROSE = """CASE WHEN words < 50 THEN 'too_short' WHEN words > 100000 THEN 'too_long' WHEN chars / words < 3.0 OR chars / words > 10.0 THEN 'mean_word_length'
 WHEN alpha / words < 0.8 THEN 'not_alphabetic' WHEN stops < 2 THEN 'no_stop_words' WHEN symbols / words > 0.1 THEN 'symbol_ratio' WHEN bullets / lines > 0.9 THEN 'all_bullets'
 WHEN cut / lines > 0.3 THEN 'truncated_lines' WHEN repeated > 0.3 THEN 'duplicate_lines' WHEN top * 2 / words > 0.2 THEN 'repeated_bigram' END"""
_CODE = """CASE WHEN len < 200 THEN 'too_short' WHEN len > 200000 THEN 'too_long' WHEN len / lines > 200 THEN 'likely_minified' WHEN longest > 2000 THEN 'very_long_line'
 WHEN alnum / len < 0.25 THEN 'low_alphanumeric' WHEN spaces / len < 0.02 THEN 'no_whitespace' WHEN repeated > 0.5 THEN 'duplicate_lines' END"""
_RAW = "SELECT doc_id, text, source FROM documents"
_JUDGED = f"""WITH {_features(f"SELECT doc_id, {_normalised('text')} AS text, source FROM documents")},
judged AS (SELECT doc_id, text, source, len, CASE WHEN text = '' THEN 'empty' WHEN doc_id % 4 = 0 THEN {_CODE} ELSE {_PROSE} END AS reason FROM f)"""


def _shingles(docs: str) -> str:
    return rf"""
sdoc AS ({docs}),
sword AS (SELECT ord, win, regexp_extract_all(lower(text), '{_WS.replace("[", "[^")}+') AS w FROM sdoc),
sgram AS (SELECT ord, win, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT ord, win, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM sword WHERE len(w) > 0)),
shingle AS (SELECT DISTINCT ord, win, ('0x' || substr(md5(g), 1, 8))::UBIGINT::BIGINT AS h FROM sgram)"""


_CLUSTERS = """edge AS (SELECT a AS u, b AS v FROM alike WHERE jaccard >= 0.8 UNION SELECT b, a FROM alike WHERE jaccard >= 0.8),
reach(u, v) AS (SELECT u, v FROM edge UNION SELECT reach.u, edge.v FROM reach JOIN edge ON reach.v = edge.u),
cluster AS (SELECT u AS ord, least(u, min(v)) AS root FROM reach GROUP BY u),
gone AS (SELECT ord, root FROM cluster WHERE ord > root)"""


def _near(docs: str) -> str:
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 1 << 32, 128, dtype=np.uint64), rng.integers(0, 1 << 32, 128, dtype=np.uint64)
    values = ", ".join(f"({k}, {int(x)}::HUGEINT, {int(y)}::HUGEINT)" for k, (x, y) in enumerate(zip(a, b, strict=True)))
    return rf"""{_shingles(docs)},
perm(k, a, b) AS (VALUES {values}),
least AS (SELECT ord, win, k, min((a * h + b) % 2305843009213693951) AS m FROM shingle, perm GROUP BY ord, win, k
  UNION ALL SELECT ord, win, k, 2305843009213693951::HUGEINT FROM sdoc, perm WHERE ord NOT IN (SELECT ord FROM shingle)),
band AS (SELECT ord, win, k // 8 AS band, string_agg(m::VARCHAR, ',' ORDER BY k) AS key FROM least GROUP BY ord, win, k // 8),
pair AS (SELECT DISTINCT a, ord AS b FROM (SELECT ord, min(ord) OVER (PARTITION BY win, band, key) AS a FROM band) WHERE ord > a),
size AS (SELECT ord, count(*) AS n FROM shingle GROUP BY ord),
shared AS (SELECT a, b, count(*) AS n FROM pair JOIN shingle x ON x.ord = a JOIN shingle y ON y.ord = b AND y.h = x.h GROUP BY a, b),
alike AS (SELECT p.a, p.b, CASE WHEN x.n IS NULL AND y.n IS NULL THEN 1.0 ELSE coalesce(s.n, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(s.n, 0)) END AS jaccard
  FROM pair p LEFT JOIN shared s USING (a, b) LEFT JOIN size x ON x.ord = p.a LEFT JOIN size y ON y.ord = p.b),
{_CLUSTERS}"""


def _near_all(docs: str) -> str:
    """As ``_near``, with every pair that shares a shingle; documents without any are alike."""
    return rf"""{_shingles(docs)},
size AS (SELECT ord, count(*) AS n FROM shingle GROUP BY ord),
shared AS (SELECT x.ord AS a, y.ord AS b, count(*) AS n FROM shingle x JOIN shingle y ON y.h = x.h AND y.ord > x.ord GROUP BY x.ord, y.ord),
alike AS (SELECT s.a, s.b, s.n / (x.n + y.n - s.n) AS jaccard FROM shared s JOIN size x ON x.ord = s.a JOIN size y ON y.ord = s.b
  UNION ALL SELECT min(ord) OVER (), ord, 1.0 FROM sdoc WHERE ord NOT IN (SELECT ord FROM shingle)),
{_CLUSTERS}"""


def _near_with(docs: str, tail: str) -> str:
    return f"WITH RECURSIVE {_near(docs)} {tail}"


_ALL = "SELECT doc_id AS ord, 0 AS win, text FROM documents"


def _built(near) -> str:
    return f"""{_JUDGED.replace("WITH", "WITH RECURSIVE", 1)},
ranked AS (SELECT *, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY text, reason IS NULL ORDER BY doc_id) END AS copy FROM judged),
{near("SELECT doc_id AS ord, 0 AS win, text FROM ranked WHERE copy = 1")},
built AS (SELECT r.*, reason IS NULL AND copy > 1 AS exact, gone.ord IS NOT NULL AS near FROM ranked r LEFT JOIN gone ON gone.ord = r.doc_id)"""


_BUILT = _built(_near)
_ROLES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in chat.ROLE_ALIASES.items()) + "}"
_TURNS = f"""
turn0 AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, {_ROLES}[lower(coalesce(role, ''))] AS role, {_clean("text")} AS content FROM conversations),
bad AS (SELECT DISTINCT conv_id FROM turn0 WHERE role IS NULL OR content = ''),
turn AS (SELECT * FROM turn0 WHERE conv_id NOT IN (SELECT conv_id FROM bad))"""
_REFUSAL = "(" + " OR ".join(f"starts_with(lower(substr({{0}}, 1, 40)), '{p.replace(chr(39), chr(39) * 2)}')" for p in chat.BAD_PREFIXES) + ")"
_REASON = f"""
body AS (SELECT conv_id, i, role, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS last FROM turn WHERE role <> 'system'),
fault AS (SELECT conv_id, arg_min(fault, i) AS fault FROM (SELECT conv_id, i, CASE WHEN length(content) < 20 THEN 'answer_too_short' WHEN {_REFUSAL.format("content")} THEN 'refusal_or_meta' END AS fault FROM turn WHERE role = 'assistant') WHERE fault IS NOT NULL GROUP BY conv_id),
conv AS (SELECT conv_id, arg_max(role, i) AS last, count(*) FILTER (role = 'user') AS users, count(*) FILTER (role = 'system') AS systems, count(*) FILTER (role = 'system' AND i > 1) AS late, sum(length(content)) AS chars, arg_min(content, i) FILTER (role = 'user') AS prompt FROM turn GROUP BY conv_id),
judged AS (SELECT conv_id, prompt, CASE WHEN last <> 'assistant' THEN 'does_not_end_with_assistant' WHEN users = 0 THEN 'no_user_turn' WHEN systems > 1 THEN 'multiple_system_turns' WHEN late > 0 THEN 'system_turn_out_of_place'
  WHEN conv_id IN (SELECT conv_id FROM body WHERE role = last) THEN 'roles_do_not_alternate' WHEN chars > 24000 THEN 'too_long' ELSE fault END AS reason FROM conv LEFT JOIN fault USING (conv_id)
  UNION ALL SELECT conv_id, NULL, 'unadaptable' FROM bad)"""
_KEY = rf"sha256({_strip(f'regexp_replace(lower(coalesce(prompt, {chr(39)}{chr(39)})), {chr(39)}{_WS}+{chr(39)}, {chr(39)} {chr(39)}, {chr(39)}g{chr(39)})')})"


def _mix() -> str:
    parts, seen = [], []
    for k, (name, share) in enumerate(chat.SFT_SHARES):
        want = int(50_000 * share)
        before = " AND ".join(f"key NOT IN (SELECT key FROM got{j})" for j in seen) or "true"
        parts.append(f"""read{k} AS (SELECT * FROM keyed WHERE conv_id % 3 = {k} ORDER BY conv_id LIMIT {int(want * 2.5)}),
got{k} AS (SELECT '{name}' AS source, min(conv_id) AS conv_id, key FROM read{k} WHERE reason IS NULL AND {before} GROUP BY key ORDER BY 2 LIMIT {want})""")
        seen.append(k)
    union = " UNION ALL ".join(f"SELECT source, conv_id FROM got{k}" for k in seen)
    return f"WITH {_TURNS}, {_REASON}, keyed AS (SELECT conv_id, reason, {_KEY} AS key FROM judged), {', '.join(parts)} {union}"


_BYTES = "list_append(list_transform(regexp_extract_all(hex(encode(text)), '[0-9A-F]{2}'), lambda h: ('0x' || h)::INT + 7), 2)"
_BYTE_ROWS = f"""src AS (SELECT doc_id, {_BYTES} AS ids FROM documents), size AS (SELECT doc_id, ids, len(ids) AS n FROM src),
place AS (SELECT doc_id, ids, CAST(coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM size)"""
_EXAMPLE = f"""{_TURNS},
part AS (SELECT conv_id, i, CASE role WHEN 'system' THEN 3 WHEN 'user' THEN 4 ELSE 5 END AS tok, role = 'assistant' AS own, list_transform(regexp_extract_all(hex(encode(content)), '[0-9A-F]{{2}}'), lambda h: ('0x' || h)::INT + 7) AS b FROM turn),
seg AS (SELECT conv_id, i, list_prepend(tok, list_append(b, 6)) AS ids, CASE WHEN own THEN list_prepend(-100, list_append(b, 6)) ELSE list_transform(list_prepend(tok, list_append(b, 6)), lambda x: -100) END AS labels FROM part),
example AS (SELECT conv_id, list_append(list_prepend(1, flatten(list(ids ORDER BY i))), 2) AS ids, list_append(list_prepend(-100, flatten(list(labels ORDER BY i))), -100) AS labels FROM seg GROUP BY conv_id)"""


_ENCODED = "list_transform(regexp_extract_all(hex(encode({0})), '[0-9A-F]{{2}}'), lambda h: ('0x' || h)::INT + 7)"
_PAIRS = f"""WITH {_TURNS}, pair AS (SELECT conv_id, arg_min(content, i) FILTER (role = 'user') AS prompt, arg_min(content, i) FILTER (role = 'assistant') AS chosen, arg_max(content, i) FILTER (role = 'assistant') AS rejected FROM turn GROUP BY conv_id),
byte AS (SELECT conv_id, {_ENCODED.format("prompt")} AS p, {_ENCODED.format("chosen")} AS c, {_ENCODED.format("rejected")} AS r FROM pair WHERE prompt IS NOT NULL AND chosen IS NOT NULL),
sided AS (SELECT conv_id, {", ".join(f"[1, 4] || p || [6, 5] || {b} || [6, 2] AS {s}_ids, list_transform([1, 4] || p || [6, 5], lambda x: -100) || {b} || [6, -100] AS {s}_labels" for s, b in (("chosen", "c"), ("rejected", "r")))} FROM byte),
fit AS (SELECT * FROM sided WHERE len(chosen_ids) <= 1800 AND len(rejected_ids) <= 1800)"""
_PAIR_DIGESTS = ", ".join(f"md5(array_to_string({s}_{c}, ',')) AS {s}_{c}" for s in ("chosen", "rejected") for c in ("ids", "labels"))


def _case(pairs, test: str, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(k)} THEN {v!r}::DOUBLE" for k, v in pairs) + f" ELSE {otherwise} END"


_DEVICE_NAMES = ", ".join(f"'{k}'" for k in [k for k, _ in planner.PEAK_BF16] + ["plain", "laptop"])
_DEVICES = f"""device AS (SELECT CAST(s_suppkey AS BIGINT) AS device_id, 'dev ' || [{_DEVICE_NAMES}][s_suppkey % {len(planner.PEAK_BF16) + 2} + 1] AS name, ['cuda', 'mps', 'cpu'][s_suppkey % 3 + 1] AS kind, (s_suppkey % 97 + 3)::DOUBLE AS memory_gb, s_suppkey % 2 = 0 AS bf16 FROM supplier),
peaked AS (SELECT *, {_case([(k.lower(), v) for k, v in planner.PEAK_BF16], "contains(lower(name), '{}')", "NULL")} AS peak, {_case(planner.FALLBACK_PEAK, "kind = '{}'", "1.0")} AS assumed FROM device)"""
_LADDER = f"""rung(preset, l, d, h, kv, ffn, ctx, place) AS (VALUES {", ".join(f"('{r[0]}', {', '.join(f'{x}::BIGINT' for x in r[1:])}, {i})" for i, r in enumerate(planner.LADDER))}),
sized AS (SELECT *, 32768 * d + l * (d * d * 2 + d * kv * (d // h) * 2 + d * ffn * 3 + d * 2) + d AS params FROM rung)"""
_RECOMMEND = f"""WITH {_DEVICES}, {_LADDER}, mb(mb) AS (VALUES {", ".join(f"({m}::BIGINT)" for m in planner.MICRO_BATCHES)}),
need AS (SELECT device_id, place, max(mb) FILTER ((params * 16 + mb * ctx * 32768 * (CASE WHEN bf16 THEN 6 ELSE 8 END) + mb * ctx * d * l * (CASE WHEN bf16 THEN 2 ELSE 4 END) * 2.5::DOUBLE) / 1073741824.0::DOUBLE <= memory_gb * 0.8::DOUBLE) AS fits FROM peaked, sized, mb GROUP BY device_id, place),
option AS (SELECT p.device_id, s.*, coalesce(n.fits, 0) AS fits, coalesce(n.fits, 0) > 0 AND params::DOUBLE * 6 * (params * 21) / (coalesce(peak, assumed) * 1e12 * 0.35::DOUBLE) / 3600 <= 72 AS good FROM peaked p, sized s JOIN need n USING (place) WHERE n.device_id = p.device_id),
best AS (SELECT *, greatest(fits, 1) AS mb FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY good DESC, CASE WHEN good THEN -place ELSE place END) AS r FROM option) WHERE r = 1),
step AS (SELECT *, greatest(1, CAST(round_even(524288 / (mb * ctx), 0) AS BIGINT)) AS accum FROM best),
done AS (SELECT *, mb * ctx * accum AS per_step, greatest(100, CAST(floor(params * 21 / (mb * ctx * accum)) AS BIGINT)) AS steps FROM step)
SELECT device_id, preset, params, mb AS micro_batch, accum AS grad_accum, per_step AS tokens_per_step, steps AS total_steps, greatest(10, least(500, CAST(floor(steps / 25) AS BIGINT))) AS warmup_steps, CASE WHEN NOT good THEN CASE WHEN fits = 0 THEN 'out_of_memory' ELSE 'too_slow' END END AS warning FROM done"""
_LOGITS = "logit AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings)"

_SUFFIX = {"prose": (".txt", ".md", ".markdown", ".rst", ".org", ".tex", ".csv", ".tsv", ".log"), "jsonl": (".jsonl", ".ndjson"), "pdf": (".pdf",)}


def _classify() -> str:
    from ..sources.folder import CODE_SUFFIXES

    cases = " ".join(f"WHEN s IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for k, v in {**_SUFFIX, "code": CODE_SUFFIXES}.items())
    name = r"regexp_extract(regexp_replace(url, '[?#].*$', ''), '[^/]*$')"
    return rf"SELECT page_id, CASE {cases} END AS kind FROM (SELECT page_id, lower(regexp_extract({name}, '[^.](\.[^.]+)$', 1)) AS s FROM pages)"


ORACLE_SQL: dict[str, str] = {
    "normalise": f"SELECT doc_id, length(t) AS chars, md5(t) AS digest FROM (SELECT doc_id, {_normalised('text')} AS t FROM documents)",
    "word_stats": f"WITH {_features(_RAW)} SELECT doc_id, words, coalesce(different, 0) AS distinct_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars FROM f",
    "line_stats": f"WITH {_features(_RAW)} SELECT doc_id, lines, longest, round(repeated, 6) AS repetition FROM f",
    "prose_reject": f"WITH {_features(_RAW)} SELECT doc_id, {_PROSE} AS reason FROM f",
    "code_reject": f"WITH {_features(_RAW)} SELECT doc_id, {_CODE} AS reason FROM f",
    "filter_report": f"{_JUDGED} SELECT coalesce(reason, 'kept') AS reason, count(*) AS documents FROM judged GROUP BY 1",
    "exact_dedupe": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "shingles": f"WITH {_shingles(_ALL)} SELECT ord AS doc_id, count(h) AS n, min(h) AS least, max(h) AS most, CAST(coalesce(sum(h), 0) AS BIGINT) AS total FROM sdoc LEFT JOIN shingle USING (ord) GROUP BY ord",
    "minhash_signatures": _near_with(_ALL, "SELECT ord AS doc_id, md5(string_agg(m::VARCHAR, ',' ORDER BY k)) AS digest FROM least GROUP BY ord"),
    "lsh_candidates": _near_with(_ALL, "SELECT a, b FROM pair"),
    "near_dup_verified": _near_with(_ALL, "SELECT a, b, round(jaccard, 6) AS jaccard FROM alike WHERE jaccard >= 0.8"),
    "near_dup_clusters": _near_with(_ALL, "SELECT ord AS doc_id, root AS cluster FROM gone"),
    "windowed_near_dedupe": _near_with("SELECT doc_id AS ord, (row_number() OVER (ORDER BY doc_id) - 1) // 50000 AS win, text FROM documents", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT ord FROM gone)"),
    "dedupe_stream": _near_with(_ALL, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT b FROM pair)"),
    "corpus_survivors": f"{_BUILT} SELECT doc_id, source, len AS chars FROM built WHERE reason IS NULL AND NOT exact AND NOT near",
    "corpus_manifest": f"""{_built(_near_all)} SELECT count(*) AS documents_in, count(*) FILTER (reason IS NULL) AS passed_filters, count(*) FILTER (reason IS NOT NULL) AS dropped, count(*) FILTER (exact) AS removed_exact_duplicates, count(*) FILTER (near) AS removed_near_duplicates,
 count(*) FILTER (reason IS NULL AND NOT exact AND NOT near) AS documents_out, CAST(coalesce(sum(len) FILTER (reason IS NULL AND NOT exact AND NOT near), 0) AS BIGINT) AS characters_out, CAST(coalesce(sum(len) FILTER (reason IS NULL AND NOT exact AND NOT near), 0) // 4 AS BIGINT) AS estimated_tokens,
 CAST(ceil(count(*) FILTER (reason IS NULL AND NOT exact AND NOT near) / 100) AS BIGINT) AS shards FROM built""",
    "corpus_per_source": f"{_BUILT} SELECT source, count(*) AS documents FROM built WHERE reason IS NULL AND NOT exact AND NOT near GROUP BY source",
    "shuffle_order": "SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id::VARCHAR || ':7'), doc_id) - 1 AS place FROM documents",
    "limit_per_source": "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 20 AND text <> ''",
    "chat_messages": f"WITH {_TURNS} SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || content, chr(10) ORDER BY i)) AS digest FROM turn GROUP BY conv_id",
    "conversation_reject": f"WITH {_TURNS}, {_REASON} SELECT conv_id, reason FROM judged",
    "chat_render": f"WITH {_TURNS}, r AS (SELECT conv_id, '<|bos|>' || string_agg('<|' || role || '|>' || content || '<|end|>', '' ORDER BY i) AS r FROM turn GROUP BY conv_id) SELECT conv_id, length(r) AS chars, md5(r) AS digest FROM r",
    "prompt_keys": f"WITH {_TURNS}, p AS (SELECT conv_id, arg_min(content, i) FILTER (role = 'user') AS prompt FROM turn GROUP BY conv_id) SELECT conv_id, {_KEY} AS key FROM p",
    "preference_reject": f"""WITH {_TURNS}, p AS (SELECT conv_id, coalesce(arg_min(content, i) FILTER (role = 'user'), '') AS prompt, arg_min(content, i) FILTER (role = 'assistant') AS c, arg_max(content, i) FILTER (role = 'assistant') AS r FROM turn GROUP BY conv_id)
SELECT conv_id, CASE WHEN prompt = '' OR c IS NULL THEN 'empty' WHEN {_strip("c")} = {_strip("r")} THEN 'identical_responses' WHEN length(prompt) < 10 THEN 'prompt_too_short' WHEN length(c) < 20 THEN 'chosen_too_short' WHEN length(r) < 20 THEN 'rejected_too_short'
 WHEN length(prompt) + greatest(length(c), length(r)) > 12000 THEN 'too_long' WHEN {_REFUSAL.format("c")} THEN 'chosen_is_a_refusal' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN p USING (conv_id)""",
    "mix_collect": _mix(),
    "train_val_split": "WITH c AS (SELECT DISTINCT conv_id FROM conversations) SELECT conv_id, row_number() OVER (ORDER BY conv_id) <= greatest(1, floor((SELECT count(*) FROM c) * 0.05::DOUBLE)) AS is_val FROM c",
    "val_budget_split": f"WITH {_BYTE_ROWS} SELECT doc_id, start, start < 100000 OR start = 0 AS is_val FROM place",
    "pack_windows": f"""WITH {_BYTE_ROWS}, token AS (SELECT start + j AS pos, id FROM (SELECT start, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS j FROM place)), total AS (SELECT count(*) AS n FROM token)
SELECT CAST(win AS BIGINT) AS win, md5(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos < (win + 1) * 1024)) AS x, md5(string_agg(id::VARCHAR, ',' ORDER BY pos) FILTER (pos > win * 1024)) AS y
FROM (SELECT pos, id, pos // 1024 AS win FROM token UNION ALL SELECT pos, id, pos // 1024 - 1 FROM token WHERE pos % 1024 = 0 AND pos > 0) WHERE win < (SELECT (n - 1) // 1024 FROM total) GROUP BY win""",
    "loss_mask": f"WITH {_EXAMPLE} SELECT conv_id, len(ids) AS n, len(list_filter(labels, lambda x: x <> -100)) AS supervised, md5(array_to_string(labels, ',')) AS labels FROM example",
    "pad_collate": f"""WITH {_EXAMPLE}, ok AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM example WHERE len(ids) <= 20000 AND len(list_filter(labels, lambda x: x <> -100)) > 0),
wide AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS w FROM ok)
SELECT conv_id, batch, w - 1 AS width, md5(array_to_string(list_resize(ids, w, 0)[1:w - 1], ',')) AS x, md5(array_to_string(list_resize(labels, w, -100)[2:w], ',')) AS y FROM wide""",
    "preference_encode": f"{_PAIRS} SELECT conv_id, {_PAIR_DIGESTS} FROM fit",
    "pair_collate": f"""{_PAIRS}, batched AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 8 AS batch FROM fit),
wide AS (SELECT *, max(len(chosen_ids)) OVER (PARTITION BY batch) AS chosen_w, max(len(rejected_ids)) OVER (PARTITION BY batch) AS rejected_w FROM batched)
SELECT conv_id, batch, {", ".join(f"md5(array_to_string(list_resize({s}_ids, {s}_w, 0)[1:{s}_w - 1], ',')) AS {s}_x, md5(array_to_string(list_resize({s}_labels, {s}_w, -100)[2:{s}_w], ',')) AS {s}_y" for s in ("chosen", "rejected"))} FROM wide""",
    "adapt_sharegpt": f"WITH {_TURNS} SELECT conv_id, count(*) AS turns, md5(string_agg(role || ':' || content, chr(10) ORDER BY i)) AS digest FROM turn GROUP BY conv_id",
    "compression_ratio": "SELECT round(sum(length(text)) / sum(octet_length(encode(text))), 6) AS chars_per_token FROM documents",
    "post_statuses": f"""WITH {_TURNS}, {_REASON}, said AS (SELECT conv_id, {_clean("arg_min(text, turn) FILTER (role = 'user')")} AS q, {_clean("arg_max(text, turn) FILTER (role = 'assistant')")} AS a FROM conversations GROUP BY conv_id)
SELECT conv_id, ['sharegpt', 'messages', 'instruct_pair'][conv_id % 3 + 1] AS adapter, CASE WHEN conv_id % 11 = 0 THEN 'adapter_error' WHEN conv_id % 13 = 0 THEN 'unadaptable' WHEN conv_id % 3 < 2 THEN coalesce(reason, 'kept')
  WHEN coalesce(q, '') = '' OR coalesce(a, '') = '' THEN 'unadaptable' WHEN length(q) + length(a) > 24000 THEN 'too_long' WHEN length(a) < 20 THEN 'answer_too_short' WHEN {_REFUSAL.format("a")} THEN 'refusal_or_meta' ELSE 'kept' END AS status
FROM said JOIN judged USING (conv_id)""",
    "shard_round_trip": """SELECT format('corpus-{:05d}.jsonl.zst', rn // 2000) AS file, rn % 2000 AS line, md5(text) AS digest, source, CASE WHEN doc_id % 4 = 0 THEN 'code' ELSE 'prose' END AS kind
FROM (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents)""",
    "mix_targets": f"SELECT source, share, CAST(floor(share * 7000000000) AS BIGINT) AS target_tokens FROM (VALUES {', '.join(f'({n!r}, {s!r}::DOUBLE)' for n, s, _ in planner.MIX)}) AS t(source, share)",
    "assess": """WITH c AS (SELECT source, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY source), t AS (SELECT *, CAST(floor(characters / 3.8::DOUBLE) AS BIGINT) AS estimated_tokens, 12815616::BIGINT * 21 AS tokens_wanted FROM c)
SELECT *, round(estimated_tokens / tokens_wanted, 4) AS share_of_budget, CASE WHEN estimated_tokens / tokens_wanted >= 1.0 THEN 'enough' WHEN estimated_tokens / tokens_wanted >= 0.1 THEN 'blend' WHEN estimated_tokens >= 100000 THEN 'fine_tune' ELSE 'too_small' END AS verdict FROM t""",
    "model_ladder": f"WITH {_LADDER} SELECT preset, params, ctx AS context_len FROM sized",
    "peak_for": f"WITH {_DEVICES} SELECT device_id, name, peak, coalesce(peak, assumed) AS effective_peak FROM peaked",
    "plan_recommend": _RECOMMEND,
    "plan_with_context": f"SELECT device_id, preset, CAST(4096 AS BIGINT) AS context_len, micro_batch, accum AS grad_accum, micro_batch * 4096 * accum AS tokens_per_step, total_steps FROM (SELECT *, greatest(1, CAST(round_even(tokens_per_step / (micro_batch * 4096), 0) AS BIGINT)) AS accum FROM ({_RECOMMEND}))",
    "lr_schedule": "SELECT step, round((CASE WHEN step < 100 THEN (step + 1) * 6e-4 / 100 WHEN step >= 1000 THEN 6e-5 ELSE 6e-5 + (6e-4 - 6e-5) * 0.5 * (1.0 + cos((step - 100) / 900 * pi())) END) * 1e6, 6) AS lr_e6 FROM (SELECT unnest(generate_series(0, 1000)) AS step)",
    "loss_watchdog": """WITH c AS (SELECT o_custkey AS run, o_orderkey AS step, round(o_totalprice::DOUBLE * 100) AS loss FROM orders), o AS (SELECT *, avg(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS baseline FROM c)
SELECT run, step, CASE WHEN loss > baseline * 3.0 THEN 'spike' ELSE 'ok' END AS status, baseline FROM o""",
    "perplexity": "SELECT round(m, 4) AS loss, round(exp(m), 2) AS perplexity, n AS tokens_scored, round(m / ln(2), 4) AS bits_per_token FROM (SELECT avg(value::DOUBLE / 100) AS m, count(value) AS n FROM events)",
    "top_k": f"WITH {_LOGITS}, kth AS (SELECT vec_id, min(x) AS least FROM (SELECT vec_id, x, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC) AS r FROM logit) WHERE r <= 8 GROUP BY vec_id) SELECT vec_id, string_agg(token::VARCHAR, ',' ORDER BY token) AS kept FROM logit JOIN kth USING (vec_id) WHERE x >= least GROUP BY vec_id",
    "top_p": f"""WITH {_LOGITS}, e AS (SELECT vec_id, token, x, exp(x - max(x) OVER (PARTITION BY vec_id)) AS e FROM logit), p AS (SELECT *, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM e),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY x DESC, token ROWS UNBOUNDED PRECEDING) - p AS b, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, token) AS r FROM p) SELECT vec_id, count(*) AS n, max(token) AS last FROM c WHERE b < 0.5 OR r = 1 GROUP BY vec_id""",
    "repetition_penalty": f"WITH {_LOGITS} SELECT vec_id, token, round(CASE WHEN (vec_id + token) % 7 = 0 THEN CASE WHEN x > 0 THEN x / 1.1::DOUBLE ELSE x * 1.1::DOUBLE END ELSE x END, 6) AS logit FROM logit",
    "greedy_choice": f"WITH {_LOGITS} SELECT vec_id, token FROM (SELECT vec_id, token, row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, token) AS r FROM logit) WHERE r = 1",
    "sequence_logprob": f"WITH {_LOGITS} SELECT vec_id AS seq, round(sum(CASE WHEN token % 3 = 0 THEN 0 ELSE -abs(x) END), 6) AS logprob FROM logit GROUP BY vec_id",
    "dpo_metrics": """WITH v AS (SELECT list_transform(embedding, lambda x: x::DOUBLE * 10) AS e FROM embeddings), z AS (SELECT e, (e[1] - e[2]) - (e[3] - e[4]) AS z FROM v)
SELECT round(avg(greatest(-z * 0.1::DOUBLE, 0) + ln(1 + exp(-abs(z * 0.1::DOUBLE)))), 6) AS loss, round(avg((z > 0)::INT), 6) AS accuracy, round(avg(z), 6) AS margin, round(avg((e[1] - e[3]) * 0.1::DOUBLE), 6) AS chosen_reward, round(avg((e[2] - e[4]) * 0.1::DOUBLE), 6) AS rejected_reward FROM z""",
    "classify_paths": _classify(),
}
