"""SQL that gives the rows of the registered queries, for a second engine over the same tables."""

from __future__ import annotations

from tessera.operators import evaluation as E
from tessera.operators import perturb as B
from tessera.operators import workflow as W
from tessera.plans.fixtures import CHUNKS, QUERY, REC, VISIBLE, stem_sql, terms_sql, tokens_sql

REC_Q, CHUNK_Q = f"WITH {REC}", f"WITH {REC}, {CHUNKS}"
T = tokens_sql


def vector(terms: str, by: str) -> str:
    """(by, bucket, weight) of the integer vectors of a list column terms in (by, terms)."""
    h = "sha256(t)"
    n = lambda a, b: f"CAST('0x' || substr({h}, {a}, {b}) AS BIGINT)"
    return f"SELECT {by}, {n(1, 8)} % 384 AS bucket, sum((CASE WHEN {n(9, 2)} % 2 = 0 THEN 1 ELSE -1 END) * (50 + {n(11, 2)} % 11)) AS weight FROM (SELECT {by}, unnest(terms) AS t FROM {terms}) GROUP BY {by}, bucket"


DECAY = """CASE WHEN age_days <= horizon * 0.5 THEN CAST(0.05 AS DOUBLE) WHEN age_days >= horizon THEN -0.25
  ELSE CAST(0.05 AS DOUBLE) - CAST(0.3 AS DOUBLE) * (age_days - horizon * 0.5) / greatest(CAST(0.001 AS DOUBLE), horizon - horizon * 0.5) END"""
BONUSES = "CASE WHEN kind IN ('research_report', 'research_finding') THEN 0.15 WHEN kind IN ('decision_outcome', 'topic_pattern', 'user_profile_note') THEN 0.08 ELSE 0 END + CASE scope WHEN 'session' THEN 0.12 WHEN 'user' THEN 0.08 ELSE 0.03 END"
REASON = """scope || '_scope_' || CASE WHEN semantic_score >= lexical_score AND semantic_score > 0 THEN 'semantic' WHEN lexical_score > 0 THEN CASE WHEN keyword_bonus > 0 THEN 'lexical_keyword' ELSE 'lexical' END ELSE 'keyword' END || '_match'"""


def keyword(q: str, first: str) -> str:
    return f"""(CASE WHEN len(list_intersect({q}, {T('title')})) > 0 THEN 0.04 ELSE 0 END + CASE WHEN len(list_intersect({q}, [lower(lang), lower(source)])) > 0 THEN 0.03 ELSE 0 END
  + CASE WHEN len(list_filter({q}, lambda t: contains(lower(source_key), t))) > 0 THEN 0.02 ELSE 0 END + CASE WHEN {first} = 0 THEN 0.01 ELSE 0 END)"""


def hybrid(queries: str, limit: int, pool: int) -> str:
    """CTEs ending in ranked (query_id, rank, ...) for queries (query_id, query_text)."""
    return f"""WITH {REC}, {CHUNKS}, {VISIBLE},
q AS (SELECT query_id, {T('query_text')} AS qt FROM ({queries})), qterms AS (SELECT query_id, {terms_sql('qt')} AS terms FROM q),
qv AS ({vector('qterms', 'query_id')}), qn AS (SELECT query_id, sum(weight * weight) AS n FROM qv GROUP BY query_id),
c AS (SELECT chk.chunk_id, chk.chunk_index, chk.record_id, chk.text AS chunk_text, chk.token_count_estimate AS chunk_tokens, {T('chk.text')} AS ct, vis.* EXCLUDE (text, token_count_estimate) FROM chk JOIN vis ON chk.record_id = vis.id),
cterms AS (SELECT chunk_id, {terms_sql('ct')} AS terms FROM c), cv AS ({vector('cterms', 'chunk_id')}), cn AS (SELECT chunk_id, sum(weight * weight) AS n FROM cv GROUP BY chunk_id),
dot AS (SELECT query_id, chunk_id, sum(qv.weight * cv.weight) AS dot FROM qv JOIN cv USING (bucket) GROUP BY ALL),
s AS (SELECT q.query_id, c.*, round(CASE WHEN cn.n > 0 AND qn.n > 0 THEN greatest(0, coalesce(dot, 0) / sqrt(CAST(cn.n AS DOUBLE) * CAST(qn.n AS DOUBLE))) ELSE 0 END, 9) AS semantic_score,
  round(CASE WHEN len(list_intersect(qt, ct)) > 0 THEN len(list_intersect(qt, ct)) / sqrt(CAST(len(qt) AS DOUBLE) * len(ct)) ELSE 0 END, 9) AS lexical_score,
  round(CAST({keyword('qt', 'chunk_index')} AS DOUBLE), 9) AS keyword_bonus
  FROM q CROSS JOIN c LEFT JOIN cn USING (chunk_id) LEFT JOIN qn ON q.query_id = qn.query_id LEFT JOIN dot ON dot.query_id = q.query_id AND dot.chunk_id = c.chunk_id WHERE len(qt) > 0),
e AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, keyword_bonus DESC, created_at DESC, record_id, chunk_index) AS semantic_rank,
  row_number() OVER (PARTITION BY query_id ORDER BY lexical_score DESC, keyword_bonus DESC, created_at DESC, record_id, chunk_index) AS lexical_rank FROM s WHERE semantic_score > 0 OR lexical_score > 0 OR keyword_bonus > 0),
f AS (SELECT *, round(semantic_score * 0.6 + lexical_score * 0.25 + keyword_bonus * 0.08 + {BONUSES} + {DECAY}, 9) AS score FROM e WHERE semantic_rank <= {pool} OR lexical_rank <= {pool}),
items AS (SELECT *, {REASON} AS selection_reason, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, created_at DESC, semantic_rank, lexical_rank) AS rank FROM f WHERE score > 0 QUALIFY rank <= {limit})
"""


ONE = f"SELECT 1 AS query_id, '{QUERY}' AS query_text"
MANY = "SELECT item_id AS query_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS query_text FROM benchmark"
HYBRID_ONE, HYBRID_MANY = hybrid(ONE, 6, 24), hybrid(MANY, 5, 20)
ITEM = "rank, chunk_id, record_id, kind, scope, selection_reason, round(score, 6) AS score, round(semantic_score, 6) AS semantic_score, round(lexical_score, 6) AS lexical_score"

VERSIONS = f"""WITH {REC},
a AS (SELECT *, 'k' || CAST(doc_id % 60 AS VARCHAR) AS version_key, CASE scope WHEN 'session' THEN session_id WHEN 'user' THEN user_id END AS owner FROM rec),
b AS (SELECT *, lag(content_checksum) OVER (PARTITION BY version_key, scope, owner ORDER BY doc_id) AS prev FROM a),
v AS (SELECT *, row_number() OVER w AS source_version, lag(id) OVER w AS previous_id, CASE WHEN lead(doc_id) OVER w IS NULL THEN 'active' ELSE 'superseded' END AS st
  FROM b WHERE prev IS NULL OR prev <> content_checksum WINDOW w AS (PARTITION BY version_key, scope, owner ORDER BY doc_id)),
l AS (SELECT *, row_number() OVER (PARTITION BY version_key, scope, owner ORDER BY source_version DESC) AS n FROM v)
"""


def any_of(text: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


def rules(pick, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_of('q', r[1])} THEN '{pick(r)}'" for r in W.RULES) + f" ELSE '{default}' END"


def sections() -> str:
    kinds = lambda *k: "kind IN (" + ", ".join(f"'{x}'" for x in k) + ")"
    own = "scope IN ('session', 'user')"
    cases = {
        "planner": (own, kinds("decision_trace", "routing_decision", "decision_outcome"), "objective_context", "active_constraints", "reference_memory"),
        "research": (kinds("research_report", "research_finding", "evidence_summary"), "scope = 'session'", "key_evidence", "supporting_context", "background_memory"),
        "drafting": (kinds("user_profile_note", "decision_outcome"), "scope = 'session'", "drafting_instructions", "matter_context", "reference_material"),
        "assistant": (own, kinds("research_report", "research_finding"), "priority_context", "supporting_context", "background_memory"),
    }
    part = [f"SELECT '{m}' AS mode, CASE WHEN {a} THEN '{x}' WHEN {b} THEN '{y}' ELSE '{z}' END AS section, token_count_estimate AS k FROM rec" for m, (a, b, x, y, z) in cases.items()]
    return f"{REC_Q} SELECT mode, section, count(*) AS n, CAST(sum(greatest(1, k)) AS BIGINT) AS tokens FROM ({' UNION ALL '.join(part)}) GROUP BY ALL"


FIRST_REASON = """CASE WHEN source_status <> 'active' THEN 'inactive_source' WHEN age_days > horizon THEN 'stale'
  WHEN NOT CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u1' ELSE true END THEN 'scope_visibility'
  WHEN NOT allow_local THEN 'policy_local_egress_denied'
  WHEN confidentiality = 'private' AND scope = 'global' AND NOT restricted_users THEN 'policy_private_global_denied' ELSE 'visible' END"""
HITS = {f"{n}_hits": f"count(*) FILTER (WHERE {any_of('lower(text)', w)})" for n, w in W.SIGNALS.items()}
PREFS = {f: f"CASE WHEN {' OR '.join(f'{s}_hits > 0' for s in names)} THEN '{high}' ELSE '{plain}' END" for f, (plain, names, high) in W.PREFERENCES.items()}
MEASURES = ", ".join(f"round({f}({c}), 6) AS {n}_{c}" for c in ("retrieval_rate", "assembly_rate", "seconds") for n, f in (("mean", "avg"), ("median", "median"), ("min", "min"), ("max", "max")))
PAYLOAD = "SELECT o_orderkey, c_name, c_mktsegment, o_orderpriority, o_orderstatus, o_custkey FROM orders JOIN customer ON o_custkey = c_custkey"
ENTITIES = "replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"
PAGE = r"regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?>.*?</script>', ' ', 'g'), '(?is)<style.*?>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
RUN = "SELECT 'case_' || CAST(item_id AS VARCHAR) AS name, (item_id * {a}) % 4 <> 0 AS r, (item_id * {b}) % 3 <> 0 AS a FROM benchmark"
RUNS = f"x AS ({RUN.format(a=3, b=5)}), y AS ({RUN.format(a=4, b=6)})"
COMPARED = f"{RUNS}, c AS (SELECT name, coalesce(x.r, false) AS br, coalesce(x.a, false) AS ba, coalesce(y.r, false) AS cr, coalesce(y.a, false) AS ca FROM x FULL JOIN y USING (name))"

# Folds over ranked items, as recursions: near repeats go, then what fits the budget stays.
JACCARD = "len(list_intersect(a, {b})) / CAST(len(list_distinct(list_concat(a, {b}))) AS DOUBLE)"
BUDGET = 600
ASSEMBLED = f"""{hybrid(ONE, 20, 80).replace('WITH', 'WITH RECURSIVE', 1)},
it AS (SELECT *, {T('chunk_text')} AS tk, greatest(1, chunk_tokens) AS size FROM items),
fold AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[][]) AS kept, CAST([] AS VARCHAR[]) AS ids
  UNION ALL SELECT n + 1, CASE WHEN dup THEN kept ELSE list_append(kept, tk) END, CASE WHEN dup THEN ids ELSE list_append(ids, chunk_id) END
  FROM (SELECT fold.*, it.tk, it.chunk_id, len(list_filter(kept, lambda a: len(a) > 0 AND len(it.tk) > 0 AND {JACCARD.format(b='it.tk')} >= 0.82)) > 0 AS dup FROM fold JOIN it ON it.rank = fold.n + 1)),
compressed AS (SELECT ids FROM fold ORDER BY n DESC LIMIT 1),
fits AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS chosen
  UNION ALL SELECT n + 1, CASE WHEN len(chosen) = 0 OR used + size <= {BUDGET} THEN used + size ELSE used END, CASE WHEN len(chosen) = 0 OR used + size <= {BUDGET} THEN list_append(chosen, chunk_id) ELSE chosen END
  FROM (SELECT fits.*, it.size, it.chunk_id FROM fits, compressed, it WHERE n < len(ids) AND it.chunk_id = ids[n + 1])),
packed AS (SELECT used, chosen, (SELECT count(*) FROM it) - len(chosen) AS omitted FROM fits ORDER BY n DESC LIMIT 1),
selected AS (SELECT it.*, CASE WHEN kind IN ('research_report', 'research_finding', 'evidence_summary') THEN 1 WHEN scope = 'session' THEN 2 ELSE 3 END AS s FROM it, packed WHERE list_contains(chosen, chunk_id)),
numbered AS (SELECT *, (['key_evidence', 'supporting_context', 'background_memory'])[s] AS section, row_number() OVER (ORDER BY s, rank) AS i FROM selected)"""
ITEM_TEXT = """'[' || CAST(i AS VARCHAR) || '] ' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE kind END || ' (' || scope || ', ' || source_type || ', score=' || printf('%.3f', score) || ', reason=' || selection_reason || ')'
  || chr(10) || chunk_text || CASE WHEN coalesce(source_key, '') <> '' THEN chr(10) || 'source_key=' || source_key ELSE '' END || chr(10)"""
RENDERED = f"""{ASSEMBLED},
part AS (SELECT s, chr(10) || '## ' || section || chr(10) || string_agg({ITEM_TEXT}, chr(10) ORDER BY i) AS t FROM numbered GROUP BY s, section),
body AS (SELECT CASE WHEN count(*) > 0 THEN regexp_replace('Request: {QUERY}' || chr(10) || 'Mode: research' || chr(10) || chr(10) || 'Use the following context sections when answering:' || chr(10) || string_agg(t, chr(10) ORDER BY s), '^\\s+|\\s+$', '', 'g')
  ELSE 'Request: {QUERY}' || chr(10) || 'Mode: research' || chr(10) || chr(10) || 'No stored context matched the request.' END AS t FROM part)"""
BLOCKS = f"""{ASSEMBLED},
block AS (SELECT s, section AS name, CAST(sum(size) AS BIGINT) AS tokens, coalesce(string_agg(chunk_text, chr(10) || chr(10) ORDER BY i) FILTER (WHERE trim(chunk_text) <> ''), '') AS text FROM numbered GROUP BY s, section),
told AS (SELECT trim(coalesce(string_agg(name || ': ' || trim(substr(trim(text), 1, 180)), ' ' ORDER BY s) FILTER (WHERE trim(text) <> ''), '')) AS summary FROM block)"""


def envelope() -> str:
    """The task envelope of QUERY: its intent beside the selected context, and what the visible notes prefer."""
    low = QUERY.lower().strip()
    rule = next((r for r in W.RULES if any(w in low for w in r[1])), None)
    workflow, action, output, goal = (rule[0], rule[2], rule[3], rule[4]) if rule else ("analyze", "respond", "text", "produce_helpful_result")
    has = lambda words: any(w in low for w in words)
    wants = ["use user workflow preferences", *(["keep output concise"] if has(W.SIGNALS["brevity"]) else []), *(["ground response in evidence"] if has(("source", "citation", "cite", "evidence")) else []), *(["produce a sendable response"] if workflow == "reply" else [])]
    said = action.replace("_", " ").capitalize()
    target = f"""CASE WHEN '{workflow}' = 'code' THEN 'codebase' WHEN {has(('email',))} THEN 'email' WHEN {has(W.NOTE_WORDS)} THEN 'note' WHEN files > 0 OR {has(W.DOCUMENT_WORDS)} THEN 'document'
      WHEN '{workflow}' = 'research' AND evidence > 0 THEN 'research_material' ELSE 'context' END"""
    return f"""{ASSEMBLED},
known AS (SELECT count(*) AS n, count(*) FILTER (WHERE source_type = 'imported_document') AS files, count(*) FILTER (WHERE kind IN {W.EVIDENCE_KINDS}) AS evidence,
  (SELECT string_agg(source_key, '; ' ORDER BY r) FROM (SELECT source_key, min(rank) AS r FROM selected WHERE source_key <> '' GROUP BY source_key ORDER BY r LIMIT 6)) AS source_refs FROM selected),
t AS (SELECT *, {target} AS target_type FROM known),
h AS (SELECT {', '.join(f'{v} AS {k}' for k, v in HITS.items())} FROM vis WHERE kind IN {W.NOTE_KINDS})
SELECT '{workflow}' AS workflow_type, '{action}' AS action, target_type, '{goal}' AS goal, CASE WHEN target_type = 'email' AND '{workflow}' = 'reply' THEN 'email_reply' ELSE '{output}' END AS output_type,
  CAST(CASE WHEN target_type = 'email' THEN 0.88 WHEN target_type <> 'context' THEN 0.84 ELSE {0.82 if rule else 0.55} END AS DOUBLE) AS confidence, '{"; ".join(wants)}' AS constraints, source_refs,
  concat_ws('; ', 'match user workflow preferences', CASE WHEN clarify_low_hits > 0 THEN 'make a best-effort attempt before asking questions' END, CASE WHEN initiative_hits > 0 THEN 'include a clear next step when appropriate' END) AS must_include,
  concat_ws('; ', 'irrelevant context', CASE WHEN brevity_hits > 0 THEN 'unnecessary verbosity' END) AS must_avoid,
  CASE WHEN '{workflow}' = 'reply' AND target_type = 'email' THEN 'Draft a reply to the active email using the user''s workflow preferences.' WHEN target_type IN ('note', 'document') THEN '{said} for the active ' || target_type || ' using the retrieved context.'
    WHEN target_type = 'research_material' THEN '{said} using the active research material.' WHEN n > 0 THEN '{said} for the active ' || target_type || ' using the retrieved context.' ELSE 'Produce a useful result for the current user request.' END AS objective
FROM t, h"""


# The fold over arrivals: what is accepted depends on the last ten accepted of the group.
NEAR_DUPLICATES = f"""{REC_Q.replace('WITH', 'WITH RECURSIVE', 1)},
x AS (SELECT id, kind, scope, CASE scope WHEN 'session' THEN session_id WHEN 'user' THEN user_id END AS owner, {T('text')} AS t, doc_id FROM rec),
y AS (SELECT *, row_number() OVER (PARTITION BY kind, scope, owner ORDER BY doc_id) AS n FROM x),
f AS (SELECT id, kind, scope, owner, n, [t] AS recent, false AS rejected FROM y WHERE n = 1
  UNION ALL SELECT id, kind, scope, owner, n, CASE WHEN dup THEN recent ELSE list_append(recent, t)[-10:] END, dup FROM (
    SELECT y.*, f.recent, y.kind NOT IN ('training_example', 'decision_outcome') AND len(list_filter(f.recent, lambda a: len(a) > 0 AND len(y.t) > 0 AND {JACCARD.format(b='y.t')} >= 0.85)) > 0 AS dup
    FROM f JOIN y ON y.kind = f.kind AND y.scope = f.scope AND y.owner IS NOT DISTINCT FROM f.owner AND y.n = f.n + 1))
SELECT id, rejected FROM f"""

def perturbed_sql() -> str:
    draw = lambda salt: f"CAST('0x' || substr(md5('{salt} ' || id), 1, 7) AS BIGINT)"
    names = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in B.TAGS.items()) + "}"
    words = "[" + ", ".join(f"'{w}'" for w in B.WORDS) + "]"
    turned = f"{draw('scope')} % 100 < {B.SCOPES}"
    number = f"CAST({draw('owner')} % 15 + 1 AS VARCHAR)"
    return f"""{REC_Q}, b AS (SELECT *, {draw('bucket')} % 4 AS b FROM rec), f AS (SELECT b, row_number() OVER (PARTITION BY b ORDER BY {draw('from')}, id) AS p, text AS new_text FROM b),
        t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY {draw('to')}, id) AS p, {turned} AS turned FROM b), j AS (SELECT * FROM t JOIN f USING (b, p)),
        n AS (SELECT *, string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ') AS w FROM rec ORDER BY {draw('near')}, id LIMIT {B.NEAR}),
        m AS (SELECT *, {draw('word')} % len(w) AS pos, ({words})[{draw('new')} % {len(B.WORDS)} + 1] AS new FROM n)
        SELECT id, CASE WHEN turned THEN CASE scope WHEN 'session' THEN 'user' WHEN 'user' THEN 'global' ELSE 'session' END ELSE scope END AS scope,
          CASE WHEN turned AND scope = 'session' THEN 'u_perturbed_' || lpad({number}, 2, '0') WHEN NOT turned OR scope <> 'user' THEN user_id END AS user_id,
          CASE WHEN turned AND scope = 'global' THEN 's_perturbed_' || {number} WHEN NOT turned OR scope <> 'session' THEN session_id END AS session_id,
          CASE WHEN {draw('tags')} % 100 < {B.TAGGED} THEN coalesce(({names})[lang], lang) || ',' || coalesce(({names})[source], source) ELSE lang || ',' || source END AS tags, source_key, md5(new_text) AS text_md5, true AS perturbed, false AS near_duplicate FROM j
        UNION ALL SELECT id, scope, user_id, session_id, lang || ',' || source, 'near_dup:' || id, md5(CASE WHEN len(w) > 5 THEN array_to_string(list_transform(w, lambda x, i: CASE WHEN i = pos + 1 THEN new || right(w[pos + 1], 2) ELSE x END), ' ') ELSE array_to_string(w, ' ') END), false, true FROM m"""


def cases_sql() -> str:
    draw = lambda key: f"CAST('0x' || substr(md5({key}), 1, 7) AS BIGINT)"
    rows = ", ".join(f"({n}, '{t}', {E.TIERS[t][0]}, {E.TIERS[t][1]}, {b}, {lo}, {hi}, {w})" for n, (t, (b, lo, hi, w)) in enumerate(E.DIFFICULTY.items()))
    return f"""WITH t(place, tier, lo, hi, token_budget, least, most, wide) AS (VALUES {rows}), q AS (SELECT item_id AS query_id, item_id % 10 AS rank FROM benchmark),
        p AS (SELECT run, t.*, least + {draw("'cases ' || CAST(run AS VARCHAR)")} % (most - least + 1) AS wanted FROM (SELECT unnest(range(1, 51)) AS run) JOIN t ON run BETWEEN lo AND hi),
        x AS (SELECT p.*, query_id, row_number() OVER (PARTITION BY run ORDER BY {draw("CAST(run AS VARCHAR) || ' ' || CAST(query_id AS VARCHAR)")}, query_id) AS n FROM p JOIN q ON rank <= place)
        SELECT CAST(run AS INTEGER) AS run, tier, CAST(n AS INTEGER) AS "case", 'run' || lpad(CAST(run AS VARCHAR), 2, '0') || '_case' || lpad(CAST(n AS VARCHAR), 2, '0') || '_' || tier AS name, query_id, token_budget, wide,
          CASE WHEN wide THEN 'assembled_context' ELSE 'retrieved_records' END AS terms_scope FROM x WHERE n <= wanted"""


SQL = {
    "record_projection": f"{REC_Q} SELECT id, kind, scope, source_type, content_class, nullif(trim(title), '') AS title, user_id, session_id, source_key, source_status, content_checksum, token_count_estimate FROM rec",
    "chunk_documents": f"{CHUNK_Q} SELECT chunk_id, record_id, chunk_index, token_count_estimate, md5(text) AS text_md5 FROM chk",
    "lexical_tokens": f"{REC_Q} SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM (SELECT id, {T('text')} AS t FROM rec)",
    "stem_tokens": f"{REC_Q}, t AS (SELECT DISTINCT unnest({T('text')}) AS token FROM rec) SELECT token, {stem_sql('token')} AS stem FROM t",
    "char_ngrams": f"{REC_Q}, t AS (SELECT DISTINCT unnest({T('text')}) AS token FROM rec) SELECT token, array_to_string(list_transform(range(1, greatest(1, length(token) - 1) + 1), lambda p: substr('^' || token || '$', p, 4)), ' ') AS grams FROM t",
    "semantic_terms": f"{REC_Q}, t AS (SELECT id, {T(chr(40) + 'text || ' + repr(' status draft edit') + chr(41))} AS k FROM rec), u AS (SELECT id, {terms_sql('k')} AS t FROM t) SELECT id, CAST(len(t) AS INTEGER) AS n_terms, array_to_string(t, ' ') AS terms FROM u",
    "hash_embedding": f"""{REC_Q}, k AS (SELECT id, {T('text')} AS k FROM rec), tt AS (SELECT id, {terms_sql('k')} AS terms FROM k), v AS (SELECT * FROM ({vector('tt', 'id')}) WHERE weight <> 0)
        SELECT rec.id, CAST(count(bucket) AS INTEGER) AS nonzero, CAST(coalesce(sum(weight * weight), 0) AS BIGINT) AS norm_sq, md5(coalesce(string_agg(CAST(bucket AS VARCHAR) || ':' || CAST(weight AS VARCHAR), ',' ORDER BY bucket), '')) AS vector_md5 FROM rec LEFT JOIN v USING (id) GROUP BY rec.id""",
    "cosine_topk": """WITH x AS (SELECT q.vec_id AS query_id, e.vec_id, round(greatest(0, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings e JOIN embeddings q ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id)
        SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM x QUALIFY rank <= 10""",
    "lexical_overlap": f"{CHUNK_Q}, t AS (SELECT chunk_id, {T('text')} AS c, {T(repr(QUERY))} AS q FROM chk) SELECT chunk_id, round(len(list_intersect(c, q)) / sqrt(CAST(len(c) AS DOUBLE) * len(q)), 6) AS lexical_score FROM t WHERE len(list_intersect(c, q)) > 0",
    "token_jaccard_pairs": f"""{REC_Q}, x AS (SELECT id, {T('text')} AS t, kind, scope, CASE scope WHEN 'session' THEN session_id WHEN 'user' THEN user_id END AS owner, created_at FROM rec),
        y AS (SELECT *, row_number() OVER (PARTITION BY kind, scope, owner ORDER BY created_at DESC, id) AS n FROM x)
        SELECT a.id, b.id AS other_id, round(CASE WHEN len(a.t) > 0 AND len(b.t) > 0 THEN len(list_intersect(a.t, b.t)) / CAST(len(list_distinct(list_concat(a.t, b.t))) AS DOUBLE) ELSE 0 END, 6) AS jaccard
        FROM y a JOIN y b ON a.kind = b.kind AND a.scope = b.scope AND a.owner IS NOT DISTINCT FROM b.owner AND b.n BETWEEN a.n - 10 AND a.n - 1""",
    "scope_visibility": f"{REC_Q} SELECT id, scope, session_id, user_id FROM rec WHERE CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u1' ELSE true END",
    "policy_filter": f"""{REC_Q}, x AS (SELECT id, CASE WHEN restricted_users THEN 'policy_user_not_allowed' WHEN NOT allow_remote THEN 'policy_remote_egress_denied'
        WHEN confidentiality = 'private' AND scope = 'global' THEN 'policy_private_global_denied' END AS excluded FROM rec WHERE CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u3' ELSE true END) SELECT * FROM x WHERE excluded IS NOT NULL""",
    "exclusion_counts": f"{REC_Q} SELECT {FIRST_REASON} AS reason, count(*) AS n FROM hor GROUP BY 1",
    "staleness_filter": f"{REC_Q} SELECT id, horizon AS horizon_days, age_days > horizon AS stale FROM hor",
    "metadata_filters": f"""{REC_Q} SELECT id, CASE WHEN kind NOT IN ('research_report', 'research_finding', 'user_profile_note', 'topic_pattern') THEN 'kind_filter' WHEN source_type <> 'direct_text' THEN 'source_type_filter'
        WHEN content_class <> 'normalized_memory' THEN 'content_class_filter' WHEN confidentiality NOT IN ('shareable', 'private') THEN 'confidentiality_filter' WHEN source_status NOT IN ('active', 'superseded') THEN 'source_status_filter'
        WHEN lang NOT IN ('en', 'fr') THEN 'tag_filter' WHEN age_days > 100 THEN 'stale' WHEN NOT CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u1' ELSE true END THEN 'scope_visibility' ELSE 'visible' END AS reason FROM rec""",
    "age_decay": f"{REC_Q} SELECT id, round({DECAY}, 6) AS decay FROM hor",
    "keyword_bonus": f"{REC_Q} SELECT id, round(CAST({keyword(chr(91) + repr('the') + ',' + repr('is') + ',' + repr('src1') + ',' + repr('en') + ',' + repr('and') + chr(93), 'doc_id % 2')} AS DOUBLE), 6) AS bonus FROM rec",
    "metadata_bonus": f"{REC_Q} SELECT id, CAST(CASE WHEN source_key IN ('src1:0001', 'src2:0002') THEN 0.07 ELSE 0 END + CASE WHEN lang = 'en' THEN 0.035 ELSE 0 END AS DOUBLE) AS bonus FROM rec",
    "rerank_scores": f"{REC_Q} SELECT id, round((doc_id % 8) / 8.0 * 0.6 + (doc_id % 5) / 4.0 * 0.25 + (doc_id % 3) / 32.0 * 0.08 + 0.07 + {BONUSES} + {DECAY}, 6) AS score FROM hor",
    "selection_reason": f"{REC_Q}, x AS (SELECT id, scope, (doc_id % 4) / 4.0 AS semantic_score, (doc_id % 5) / 4.0 AS lexical_score, doc_id % 2 AS keyword_bonus FROM rec) SELECT id, {REASON} AS reason FROM x",
    "hybrid_retrieve": f"{HYBRID_ONE} SELECT {ITEM} FROM items",
    "batch_retrieve": f"{HYBRID_MANY} SELECT query_id, {ITEM} FROM items",
    "candidate_counts": f"{HYBRID_ONE} SELECT (SELECT count(*) FROM vis) AS visible_records, (SELECT count(*) FROM e) AS eligible_chunks, least(24, (SELECT count(*) FROM e)) AS semantic_candidates, least(24, (SELECT count(*) FROM e)) AS lexical_candidates, (SELECT count(*) FROM f WHERE score > 0) AS reranked_candidates",
    "query_results": f"{HYBRID_ONE} SELECT rank, record_id, chunk_id, kind, scope, source_type, content_class, title, CAST(NULL AS VARCHAR) AS summary, source_key, md5(chunk_text) AS text_md5, round(score, 6) AS score, chunk_tokens AS token_count_estimate FROM items",
    "upsert_versions": f"{VERSIONS} SELECT id, version_key, scope, owner, source_version, st AS source_status, previous_id FROM v",
    "latest_source": f"{VERSIONS} SELECT id, version_key, scope, owner, source_version FROM l WHERE n = 1",
    "soft_delete": f"{VERSIONS} SELECT id, version_key, source_version, CASE WHEN n = 1 AND version_key LIKE '%7' THEN 'deleted' ELSE st END AS source_status, n = 1 AND version_key LIKE '%7' AS has_deleted_at FROM l",
    "prune_fifo": f"{REC_Q} SELECT id, CASE WHEN age_days > coalesce(retention_days, 45) THEN 'expired' WHEN row_number() OVER (PARTITION BY scope, kind ORDER BY created_at DESC, id DESC) > 24 THEN 'overflow' END AS prune_reason FROM rec",
    "retention_expiry": f"{REC_Q} SELECT id FROM rec WHERE age_days > coalesce(retention_days, 45)",
    "stats_grouping_sets": f"{REC_Q} " + " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM rec GROUP BY {c}" for c in ("kind", "scope", "source_type", "content_class", "source_status")) + " UNION ALL SELECT 'total', 'all', count(*) FROM rec",
    "list_records": f"{REC_Q} SELECT id, kind, (SELECT count(*) FROM rec WHERE scope = 'user') AS total FROM rec WHERE scope = 'user' ORDER BY created_at DESC, id LIMIT 50",
    "assembly_sections": sections(),
    "html_text": f"WITH p AS (SELECT page_id, trim(regexp_replace({ENTITIES.format(PAGE)}, '\\s+', ' ', 'g')) AS t FROM pages) SELECT page_id, CAST(length(t) AS INTEGER) AS n_chars, md5(t) AS text_md5 FROM p",
    "structured_fields": "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value_text, 'integer' AS value_type FROM events WHERE json_extract(props, '$.k') IS NOT NULL",
    "structured_text": f"SELECT o_orderkey, 'customer.name: ' || c_name || ' customer.segment: ' || c_mktsegment || ' priority: ' || o_orderpriority || ' codes[0]: ' || o_orderstatus || ' codes[1]: ' || CAST(o_custkey AS VARCHAR) AS text FROM ({PAYLOAD})",
    "relational_records": f"SELECT o_orderkey, unnest(['customer.name', 'customer.segment', 'priority', 'codes[0]', 'codes[1]']) AS path, unnest([c_name, c_mktsegment, o_orderpriority, o_orderstatus, CAST(o_custkey AS VARCHAR)]) AS value_text FROM ({PAYLOAD})",
    "workflow_intent": f"""WITH a AS (SELECT conv_id, turn, lower(trim(text)) AS q FROM conversations WHERE role = 'user'),
        b AS (SELECT *, {rules(lambda r: r[0], 'analyze')} AS workflow_type, {rules(lambda r: r[2], 'respond')} AS action, {rules(lambda r: r[3], 'text')} AS o, {rules(lambda r: '1', '')} = '1' AS matched FROM a),
        c AS (SELECT *, CASE WHEN workflow_type = 'code' THEN 'codebase' WHEN contains(q, 'email') THEN 'email' WHEN contains(q, 'note') THEN 'note' WHEN {any_of('q', W.DOCUMENT_WORDS)} THEN 'document' ELSE 'context' END AS target_type FROM b)
        SELECT conv_id, turn, workflow_type, action, target_type, CASE workflow_type {' '.join(f"WHEN '{r[0]}' THEN '{r[4]}'" for r in W.RULES)} END AS goal, CASE WHEN target_type = 'email' AND workflow_type = 'reply' THEN 'email_reply' ELSE o END AS output_type,
        CAST(CASE WHEN target_type = 'email' THEN 0.88 WHEN target_type <> 'context' THEN 0.84 WHEN matched THEN 0.82 ELSE 0.55 END AS DOUBLE) AS confidence,
        concat_ws('; ', 'use user workflow preferences', CASE WHEN {any_of('q', W.SIGNALS['brevity'])} THEN 'keep output concise' END, CASE WHEN {any_of('q', ('source', 'citation', 'cite', 'evidence'))} THEN 'ground response in evidence' END, CASE WHEN workflow_type = 'reply' THEN 'produce a sendable response' END) AS constraints FROM c""",
    "preference_signals": f"""{REC_Q}, h AS (SELECT scope, count(*) AS n, {', '.join(f'{v} AS {k}' for k, v in HITS.items())} FROM rec WHERE kind IN ('user_profile_note', 'decision_outcome', 'training_example') GROUP BY scope)
        SELECT *, {', '.join(f'{v} AS {k}' for k, v in PREFS.items())}, concat_ws('; ', {', '.join(f"CASE WHEN {n}_hits > 0 THEN '{t}' END" for n, t in W.NOTES.items())}) AS style_notes FROM h""",
    "eval_hits": f"""{HYBRID_MANY}, g AS (SELECT query_id, count(*) AS n, list_sort(list(source_key) FILTER (WHERE string_split(source_key, ':')[1] IN ('src' || CAST(query_id % 20 AS VARCHAR), 'src3'))) AS m, string_agg(chunk_text, chr(10) ORDER BY rank) AS t FROM items GROUP BY query_id),
        k AS (SELECT query_id, string_split(query_text, ' ')[1] AS w FROM ({MANY}))
        SELECT k.query_id, CAST(coalesce(n, 0) AS INTEGER) AS retrieval_count, coalesce(array_to_string(m, ','), '') AS matched_keys, CAST(contains(lower(coalesce(t, '')), lower(w)) AS INTEGER) AS n_terms, coalesce(len(m), 0) > 0 AS retrieval_hit, contains(lower(coalesce(t, '')), lower(w)) AS assembly_hit FROM k LEFT JOIN g USING (query_id)""",
    "eval_compare": f"WITH {COMPARED} SELECT name, br AS baseline_retrieval_hit, ba AS baseline_assembly_hit, cr AS candidate_retrieval_hit, ca AS candidate_assembly_hit, br <> cr AS retrieval_changed, ba <> ca AS assembly_changed FROM c",
    "eval_gate": f"""WITH {COMPARED}, t AS (SELECT count(*) AS n, count(*) FILTER (WHERE r) AS r, count(*) FILTER (WHERE a) AS a FROM y), g AS (SELECT count(*) FILTER (WHERE br AND NOT cr) AS gr, count(*) FILTER (WHERE ba AND NOT ca) AS ga FROM c),
        z AS (SELECT n, r / CAST(n AS DOUBLE) AS rr, a / CAST(n AS DOUBLE) AS ar, gr, ga FROM t, g), w AS (SELECT *, CAST(rr < 0.8 AS INTEGER) + CAST(ar < 0.8 AS INTEGER) + CAST(gr > 0 AS INTEGER) + CAST(ga > 0 AS INTEGER) AS f FROM z)
        SELECT n AS total_cases, round(rr, 6) AS retrieval_hit_rate, round(ar, 6) AS assembly_hit_rate, gr AS retrieval_regressions, ga AS assembly_regressions, f = 0 AS passed, f AS n_failures FROM w""",
    "tier_report": f"""WITH r AS (SELECT (['series_a', 'series_b', 'series_c'])[s_suppkey % 3 + 1] AS series, s_suppkey % 50 + 1 AS run, (s_suppkey % 7) / CAST(8 AS DOUBLE) AS retrieval_rate, (s_suppkey % 5) / CAST(4 AS DOUBLE) AS assembly_rate, (s_suppkey % 11) / CAST(2 AS DOUBLE) AS seconds FROM supplier),
        t AS (SELECT *, (['trivial', 'easy', 'moderate_easy', 'moderate', 'moderate_hard', 'hard', 'harder', 'very_hard', 'extreme', 'maximum'])[(run - 1) // 5 + 1] AS tier FROM r)
        SELECT coalesce(series, 'all') AS series, coalesce(tier, 'all') AS tier, count(*) AS runs, {MEASURES} FROM t GROUP BY GROUPING SETS ((series, tier), (series), (tier), ())""",
    "dataset_profile": f"""{REC_Q} SELECT kind, scope, count(*) AS n, count(DISTINCT string_split(source_key, ':')[1]) AS prefixes, 0 AS structured, round(avg(length(text)), 6) AS avg_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, median(length(text)) AS median_chars,
        concat_ws(',', 'content_checksum', 'content_class', 'created_at', 'doc_id', 'id', 'kind', 'policy', 'schema_field_paths', 'scope', CASE WHEN count(session_id) > 0 THEN 'session_id' END, 'source_key', 'source_status', 'source_type', 'tags', 'text', 'title', 'token_count_estimate', CASE WHEN count(user_id) > 0 THEN 'user_id' END) AS fields FROM rec GROUP BY kind, scope""",
    "variant_split": f"{REC_Q} SELECT id, 'structured' AS variant, '{{\"n\":' || CAST(doc_id AS VARCHAR) || '}}' AS structured_json FROM rec WHERE doc_id % 4 = 0 UNION ALL SELECT id, 'unstructured', NULL FROM rec",
    "training_export": f"""{REC_Q}, k AS (SELECT id, {T('text')} AS k FROM rec), tt AS (SELECT id, {terms_sql('k')} AS terms FROM k), v AS (SELECT id, count(*) AS n FROM ({vector('tt', 'id')}) WHERE weight <> 0 GROUP BY id)
        SELECT rec.id, concat_ws('|', {', '.join(f"""coalesce(CAST({c} AS VARCHAR), 'null')""" for c in ('rec.id', 'kind', 'scope', 'source_type', 'content_class', 'user_id', 'session_id', 'source_key', 'source_status', 'content_checksum', 'title', 'token_count_estimate'))}) AS fields,
        strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created_at, CAST(len({T('text')}) AS INTEGER) AS n_tokens, 384 AS dims, CAST(coalesce(n, 0) AS INTEGER) AS nonzero, CAST(CASE WHEN n > 0 THEN 1 ELSE 0 END AS DOUBLE) AS length_sq FROM rec LEFT JOIN v USING (id)""",
    "audit_rows": f"""{HYBRID_ONE}, chosen AS (SELECT string_agg(chunk_id, ',' ORDER BY rank) AS chunks, string_agg(record_id, ',' ORDER BY rank) AS records FROM items), why AS (SELECT {FIRST_REASON} AS reason, count(*) AS n FROM hor GROUP BY 1)
        SELECT 'audit_' || substr(sha256('{QUERY}' || '|2024-03-01 00:00:00|' || chunks), 1, 32) AS audit_id, '{QUERY}' AS query_text, 'u1' AS user_id, 's3' AS session_id, 'local' AS model_target, true AS enforce_policy, 'enforce_policy=true; model_target=local' AS applied_filters,
        (SELECT string_agg(reason || '=' || CAST(n AS VARCHAR), '; ' ORDER BY reason) FROM why WHERE reason <> 'visible') AS excluded_counts, (SELECT count(*) FROM vis) AS n_visible, (SELECT md5(string_agg(id, ',' ORDER BY id)) FROM vis) AS visible_md5, records AS selected_record_ids, chunks AS selected_chunk_ids,
        (SELECT count(*) FROM vis) AS visible_records, (SELECT count(*) FROM e) AS eligible_chunks, (SELECT count(*) FROM f WHERE score > 0) AS reranked_candidates, 'embedding_lexical_rerank' AS retrieval_strategy FROM chosen""",
    "provenance_items": f"{HYBRID_ONE} SELECT rank, record_id, source_key, source_status, content_checksum, source_type, content_class, user_id, session_id, lang || ',' || source AS tags, confidentiality, CAST(NULL AS VARCHAR) AS source_version FROM items",
    "import_files": f"""WITH d AS (SELECT doc_id AS i, text, (['.txt', '.md', '.csv', '.xml', '.bin', '.ndjson'])[doc_id % 6 + 1] AS suffix FROM documents),
        x AS (SELECT '/in/d' || CAST(i AS VARCHAR) || suffix AS path, CASE WHEN i % 6 = 4 THEN 'path_not_found_or_unsupported' WHEN i % 30 = 0 THEN 'unsupported_or_unreadable' END AS reason,
          CASE WHEN i % 6 = 4 OR i % 30 = 0 THEN NULL WHEN i % 6 = 5 THEN 'id: ' || CAST(i AS VARCHAR) || ' not json' WHEN i % 6 = 3 THEN trim(regexp_replace(text || ' end', '\\s+', ' ', 'g')) ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS text, i % 6 = 5 AS has_data FROM d
          UNION ALL SELECT '/in/p' || CAST(page_id AS VARCHAR) || '.html', NULL, trim(regexp_replace({ENTITIES.format(PAGE)}, '\\s+', ' ', 'g')), false FROM pages
          UNION ALL SELECT '/in/o' || CAST(o_orderkey AS VARCHAR) || '.json', NULL, trim(regexp_replace('customer: name: ' || c_name || ' segment: ' || c_mktsegment || ' priority: ' || o_orderpriority || ' codes: ' || o_orderstatus || ' ' || CAST(o_custkey AS VARCHAR), '\\s+', ' ', 'g')), true FROM ({PAYLOAD}))
        SELECT path, CASE WHEN reason IS NULL THEN 'imported' ELSE 'skipped' END AS status, reason, 'file:' || path AS source_key, md5(text) AS text_md5, has_data FROM x""",
    "rare_filters": f"""{REC_Q}, x AS (SELECT *, doc_id % 5 = 1 AS sessions FROM hor)
        SELECT 'keys' AS request, id, CASE WHEN doc_id % 2 = 1 THEN 'source_key_filter' WHEN source_status <> 'active' THEN 'inactive_source' WHEN NOT CASE scope WHEN 'session' THEN session_id = 's3' WHEN 'user' THEN user_id = 'u1' ELSE true END THEN 'scope_visibility'
          WHEN sessions THEN 'policy_session_not_allowed' WHEN NOT allow_local THEN 'policy_local_egress_denied' WHEN confidentiality = 'private' AND scope = 'global' AND NOT restricted_users THEN 'policy_private_global_denied' ELSE 'visible' END AS reason FROM x
        UNION ALL SELECT 'nobody', id, CASE WHEN source_status <> 'active' THEN 'inactive_source' WHEN scope <> 'global' THEN 'scope_visibility' WHEN restricted_users THEN 'policy_user_not_allowed' WHEN sessions THEN 'policy_session_not_allowed'
          WHEN NOT allow_local THEN 'policy_local_egress_denied' WHEN confidentiality = 'restricted' THEN 'policy_restricted_context_required' WHEN confidentiality = 'private' THEN 'policy_private_global_denied' ELSE 'visible' END FROM x
        UNION ALL SELECT 'session', id, CASE WHEN source_status <> 'active' THEN 'inactive_source' WHEN NOT CASE scope WHEN 'session' THEN session_id = 's2' ELSE scope = 'global' END THEN 'scope_visibility' WHEN restricted_users THEN 'policy_user_not_allowed'
          WHEN NOT allow_local THEN 'policy_local_egress_denied' WHEN confidentiality = 'private' AND scope = 'global' AND NOT sessions THEN 'policy_private_global_denied' ELSE 'visible' END FROM x""",
    "run_table": """WITH r AS (SELECT DISTINCT (['series_a', 'series_b', 'series_c'])[s_suppkey % 3 + 1] AS series, CAST(s_suppkey % 50 + 1 AS INTEGER) AS run FROM supplier),
        e AS (SELECT (['series_a', 'series_b', 'series_c'])[doc_id % 3 + 1] AS series, doc_id % 40 + 1 AS run, count(*) AS total_cases, count(*) FILTER (WHERE doc_id % 4 <> 0) AS retrieval_hits, count(*) FILTER (WHERE doc_id % 3 <> 0) AS assembly_hits, round(avg(doc_id % 7), 1) AS mean_retrieval_count,
          CAST(min(doc_id % 7) AS INTEGER) AS min_retrieval_count, CAST(max(doc_id % 7) AS INTEGER) AS max_retrieval_count, round(avg(doc_id % 500), 0) AS mean_assembly_tokens, CAST(sum(doc_id % 500) AS BIGINT) AS total_assembly_tokens FROM documents GROUP BY 1, 2),
        c AS (SELECT (['series_a', 'series_b', 'series_c'])[item_id % 3 + 1] AS series, item_id % 50 + 1 AS run, count(*) AS case_definitions FROM benchmark GROUP BY 1, 2)
        SELECT r.series, r.run, coalesce(total_cases, 0) AS total_cases, coalesce(retrieval_hits, 0) AS retrieval_hits, coalesce(assembly_hits, 0) AS assembly_hits, coalesce(mean_retrieval_count, 0) AS mean_retrieval_count, coalesce(min_retrieval_count, 0) AS min_retrieval_count,
          coalesce(max_retrieval_count, 0) AS max_retrieval_count, coalesce(mean_assembly_tokens, 0) AS mean_assembly_tokens, coalesce(total_assembly_tokens, 0) AS total_assembly_tokens, coalesce(case_definitions, 0) AS case_definitions,
          (['trivial', 'easy', 'moderate_easy', 'moderate', 'moderate_hard', 'hard', 'harder', 'very_hard', 'extreme', 'maximum'])[(r.run - 1) // 5 + 1] AS tier FROM r LEFT JOIN e USING (series, run) LEFT JOIN c USING (series, run)""",
    "pruning_report": """WITH x AS (SELECT (['structured', 'unstructured'])[s_suppkey % 2 + 1] AS variant, (['base', 'perturbed', 'medical'])[s_suppkey % 3 + 1] AS dataset, avg(s_suppkey % 433) AS a, avg(s_suppkey % 17) AS p, avg(s_suppkey % 433 + s_suppkey % 17) AS i FROM supplier GROUP BY 1, 2)
        SELECT variant, dataset, round(a, 6) AS avg_active, round(p, 6) AS avg_pruned, round(i, 6) AS avg_imported, round(CASE WHEN i > 0 THEN 100 * p / i ELSE 0 END, 6) AS pruned_percent FROM x""",
    "valid_terms": f"""{REC_Q}, c AS (SELECT CAST(query_id AS VARCHAR) AS name, string_split(query_text, ' ') AS w FROM ({MANY})), u AS (SELECT name, w, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS i FROM c), f AS (SELECT name, t, min(i) AS i FROM u GROUP BY name, t),
        k AS (SELECT DISTINCT t FROM (SELECT DISTINCT t FROM f) JOIN rec ON contains(text, t)) SELECT name, CAST(count(*) AS INTEGER) AS n_terms, coalesce(string_agg(f.t, ' ' ORDER BY i) FILTER (WHERE k.t IS NOT NULL), '') AS valid_terms FROM f LEFT JOIN k ON f.t = k.t GROUP BY name""",
    "perturbed_dataset": perturbed_sql(),
    "cases_for_runs": cases_sql(),
    "record_summaries": f"""{VERSIONS} SELECT id, kind, scope, source_type, content_class, title, CAST(NULL AS VARCHAR) AS summary, user_id, session_id, CAST(NULL AS VARCHAR) AS source_id, version_key AS source_key, CAST(source_version AS INTEGER) AS source_version, st AS source_status, CAST(NULL AS VARCHAR) AS external_id,
        content_checksum, CAST(NULL AS VARCHAR) AS structured_json, CAST(NULL AS VARCHAR) AS source_updated_at, CASE WHEN st = 'superseded' THEN '2024-03-01 00:00:00' END AS source_last_synced_at, CAST(NULL AS VARCHAR) AS deleted_at, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at, CAST(NULL AS INTEGER) AS n_urls, lang || ',' || source AS tags,
        CASE WHEN previous_id IS NULL THEN '' ELSE 'previous_record_id' END AS metadata_keys, true AS no_schema, CAST(NULL AS INTEGER) AS n_fields, 0 AS n_paths, confidentiality, CAST(freshness_days AS VARCHAR) AS freshness_days, CAST(retention_days AS VARCHAR) AS retention_days, md5(array_to_string({T('text')}, ' ')) AS tokens_md5 FROM v""",
    "near_duplicates": NEAR_DUPLICATES,
    "compress_items": f"{ASSEMBLED} SELECT CAST((SELECT count(*) FROM it) AS INTEGER) AS n_items, CAST(len(ids) AS INTEGER) AS n_compressed, array_to_string(ids, ',') AS chunk_ids FROM compressed",
    "pack_budget": f"{ASSEMBLED} SELECT used, CAST(omitted AS INTEGER) AS omitted_items, CASE WHEN omitted > 0 THEN 'token_budget_reached' END AS truncation_reason, array_to_string(chosen, ',') AS chunk_ids FROM packed",
    "render_context": f"{RENDERED} SELECT t AS context_text, CAST(greatest(1, ceil(length(t) / 4.0)) AS INTEGER) AS token_count_estimate, CAST(omitted AS INTEGER) AS omitted_items FROM body, packed",
    "prepare_context": f"{BLOCKS} SELECT name, tokens, text, summary FROM block, told",
    "task_envelope": envelope(),
}
