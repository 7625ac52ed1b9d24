"""The queries of ``reference`` in DuckDB's SQL."""

from __future__ import annotations

from linkloom.config import BANDS, LEXICAL_V3, LEXICAL_V4, LEXICAL_V5, STOPWORDS, LexicalConfig
from linkloom.queries.general import SQL as GENERAL
from linkloom.queries.general import RANKED_LISTS, _canonical, _requirement, _symbol
from linkloom.sources.exclusions import DIRECTORIES, MINIFIED

_STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def _tokens(x: str) -> str:
    for pattern, by in ((r"[\\/]+", " "), (r"[_-]+", " "), (r"([a-z0-9])([A-Z])", r"\1 \2"), (r"([A-Z]+)([A-Z][a-z])", r"\1 \2"), (r"[^\p{L}\p{N}\s]+", " ")):
        x = f"regexp_replace({x}, '{pattern}', '{by}', 'g')"
    return f"list_filter(string_split_regex(lower({x}), '\\s+'), lambda t: t <> '')"


def _fold(t: str, revision: int) -> str:
    double = "(ches|shes|xes|zes|ses)$" if revision == 1 else "(ches|shes|xes|zes|sses)$"
    return (
        f"CASE WHEN length({t}) <= {3 if revision == 1 else 2} THEN {t} WHEN {t} LIKE '%ies' AND length({t}) > 4 THEN {t}[:-4] || 'y' "
        f"WHEN regexp_matches({t}, '(ss|us|is)$') THEN {t} WHEN regexp_matches({t}, '{double}') THEN {t}[:-3] WHEN {t} LIKE '%s' THEN {t}[:-2] ELSE {t} END"
    )


_COLS = ["kind", "name", "qualifiedName", "relativePath", "startLine", "endLine", "signature", "documentation", "normalizedSource"]
_CORPUS = f"""corpus AS (
  SELECT * EXCLUDE (n, s, raw), s AS symbolId, s || '@' || repositoryCommit AS doc FROM (
    SELECT * EXCLUDE (symbolId), symbolId AS raw, {_symbol("symbolId")} AS s, row_number() OVER (PARTITION BY repositoryCommit, {_symbol("symbolId")}
      ORDER BY loadedAt DESC NULLS LAST, {", ".join(c + " DESC NULLS LAST" for c in _COLS)}) AS n FROM symbol_index)
  WHERE n = 1 AND s IS NOT NULL AND repositoryCommit IS NOT NULL)"""
_REQS = f"""reqs AS (
  SELECT requirementId, title, difficulty, text FROM (
    SELECT *, row_number() OVER (PARTITION BY requirementId ORDER BY title DESC NULLS LAST, difficulty DESC NULLS LAST, text DESC) AS n FROM (
      SELECT {_requirement("id")} AS requirementId, title, difficulty, coalesce(title, '') || ' ' || coalesce(statement, '')
        || CASE WHEN coalesce(array_to_string(acceptance_criteria, ' '), '') <> '' THEN ' ' || array_to_string(acceptance_criteria, ' ') ELSE '' END AS text
      FROM requirements) WHERE requirementId IS NOT NULL) WHERE n = 1)"""
_FIELDS = """fields AS (
  SELECT doc, unnest([{'field': 'name', 'weight': 4.0, 'content': coalesce(name, '') || ' ' || coalesce(qualifiedName, '')}, {'field': 'signature', 'weight': 3.0, 'content': coalesce(signature, '')},
    {'field': 'documentation', 'weight': 2.0, 'content': coalesce(documentation, '')}, {'field': 'path', 'weight': 2.0, 'content': coalesce(relativePath, '')},
    {'field': 'source', 'weight': 1.0, 'content': coalesce(normalizedSource, '')}], recursive := true) FROM corpus)"""
_PLACES = f"places AS ({RANKED_LISTS})"
_LISTS10 = f"lists AS (SELECT * FROM ({RANKED_LISTS}) WHERE place <= 10)"
_LISTS5 = f"lists AS (SELECT * FROM ({RANKED_LISTS}) WHERE place <= 5)"
#: the label slices in which a label of a pass counts
_SLICES = "CASE replace(lower(trim(labelPass)), '_', '-') WHEN 'independent' THEN ['independent', 'both'] WHEN 'candidate-review' THEN ['both'] ELSE [] END"
_LABELS = f"labels AS (SELECT {_requirement('requirementId')} AS requirementId, {_symbol('symbolId')} AS symbolId, relationship, labelPass, repositoryCommit FROM labeled_links WHERE {_requirement('requirementId')} IS NOT NULL AND {_symbol('symbolId')} IS NOT NULL)"
_LOG = f"""log AS (SELECT DISTINCT seq, {_requirement("requirementId")} AS requirementId, {_symbol("proposedSymbolId")} AS proposedSymbolId, {_symbol("symbolId")} AS symbolId, lower(trim(kind)) AS kind,
    relationship, modelClassification, modelConfidence, band, reviewer, repositoryCommit, max(timestamp) OVER (PARTITION BY seq) AS timestamp FROM decisions
  WHERE {_requirement("requirementId")} IS NOT NULL AND {_symbol("proposedSymbolId")} IS NOT NULL AND seq IS NOT NULL AND lower(trim(kind)) IN ('accept', 'reject', 'redirect')),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY requirementId, proposedSymbolId ORDER BY seq DESC) AS n FROM log) WHERE n = 1)"""
_INDEX = f"""idx AS (SELECT requirementId, symbolId, reviewer, timestamp, "commit" FROM (
    SELECT *, row_number() OVER (PARTITION BY requirementId, symbolId ORDER BY timestamp NULLS LAST, "commit" NULLS LAST, reviewer NULLS LAST) AS n FROM (
      SELECT {_requirement("requirementId")} AS requirementId, {_symbol("symbolId")} AS symbolId, reviewer, timestamp, "commit" FROM stored_links)
    WHERE requirementId IS NOT NULL AND symbolId IS NOT NULL) WHERE n = 1)"""
_NEWEST = """newest AS (SELECT repositoryCommit FROM (SELECT repositoryCommit, row_number() OVER (PARTITION BY repository ORDER BY snapshotNo DESC) AS n FROM commits) WHERE n = 1)"""
_KNOWN = _NEWEST + f", known AS (SELECT DISTINCT {_symbol('symbolId')} AS symbolId FROM symbol_index SEMI JOIN newest USING (repositoryCommit) WHERE {_symbol('symbolId')} IS NOT NULL)"


def _band(confidence: str, kind: str) -> str:
    return f"CASE WHEN {kind} = 'unrelated' THEN 'discard' WHEN {confidence} >= 0.75 THEN 'suggest' WHEN {confidence} >= 0.5 THEN 'review' ELSE 'discard' END"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _stop_table(config: LexicalConfig) -> str:
    if not config.protect_identifiers:
        return f"stop AS (SELECT unnest({_STOP}) AS word)"
    used = f"SELECT unnest({_tokens('name || chr(32) || qualifiedName')}) AS t FROM corpus WHERE name IS NOT NULL AND qualifiedName IS NOT NULL"
    return f"used AS ({used}), stop AS (SELECT word FROM (SELECT unnest({_STOP}) AS word) WHERE word NOT IN (SELECT t FROM used UNION SELECT {_fold('t', config.plural_revision)} FROM used))"


#: the requirements that a search asks for, where it does not ask for all
_TWENTIETH = "WHERE try_cast(regexp_extract(requirementId, '(\\d+)$', 1) AS INTEGER) % 20 = 0"


def _bm25f(config: LexicalConfig, asked: str) -> str:
    r = config.plural_revision
    filtered = f"list_transform(list_filter({_tokens('content')}, lambda t: NOT list_contains(stops, t)), lambda t: {_fold('t', r)})"
    prior = "CASE WHEN kind IN ('file', 'module') THEN 0.5 ELSE 1.0 END"
    inner = "0"
    contained = ""
    if config.containment is not None:
        contained = """, inside AS (SELECT o.doc, count(i.doc) AS n FROM corpus o LEFT JOIN corpus i ON o.repositoryCommit = i.repositoryCommit AND o.relativePath = i.relativePath
          AND o.startLine <= i.startLine AND o.endLine >= i.endLine AND i.endLine - i.startLine < o.endLine - o.startLine GROUP BY o.doc)"""
        inner = f"{config.containment} * inside.n"
    return (
        _with(_CORPUS, _REQS, _FIELDS, _stop_table(config))
        + f""", stoplist AS (SELECT coalesce(list(word), []) AS stops FROM stop), words AS (SELECT doc, field, weight, {filtered} AS terms FROM fields, stoplist),
    avgs AS (SELECT field, avg(len(terms)) AS a FROM words WHERE len(terms) > 0 GROUP BY field),
    hits AS (SELECT doc, unnest(terms) AS term, weight / (1 - {config.b} + {config.b} * len(terms) / a) AS share FROM words JOIN avgs USING (field)),
    pseudo AS (SELECT doc, term, sum(share) AS p FROM hits GROUP BY ALL),
    dfs AS (SELECT term, count(*) AS df FROM pseudo GROUP BY term),
    q AS (SELECT requirementId, term, count(*) AS qtf FROM (SELECT requirementId, unnest({filtered.replace("content", "text")}) AS term FROM reqs, stoplist {asked}) GROUP BY ALL){contained},
    raw AS (SELECT requirementId, doc, sum(qtf * ln(1 + ((SELECT count(*) FROM corpus) - df + 0.5) / (df + 0.5)) * p * {config.k1 + 1} / ({config.k1} + p)) AS s FROM q JOIN pseudo USING (term) JOIN dfs USING (term) GROUP BY ALL),
    scored AS (SELECT requirementId, doc, round(s * {prior} / (1 + {inner}), 9) AS score FROM raw JOIN corpus USING (doc) {"JOIN inside USING (doc)" if contained else ""}),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY requirementId ORDER BY score DESC, doc) AS rank FROM scored WHERE score > 0)
    SELECT requirementId, CAST(rank AS INTEGER) AS rank, doc, round(score, 6) AS score FROM ranked WHERE rank <= 10"""
    )


_STRATA = "CASE WHEN labels = 'both' THEN ['independent-plus-candidate-review'] WHEN difficulty <> '' THEN ['overall', 'independent-only', difficulty] ELSE ['overall', 'independent-only'] END"
_METRICS = (
    _with(_PLACES, _LABELS, _REQS)
    + f""", runs AS (SELECT DISTINCT configurationId, repositoryCommit FROM retrieval WHERE configurationId IS NOT NULL AND repositoryCommit IS NOT NULL),
  rel AS (SELECT DISTINCT configurationId, requirementId, repositoryCommit, symbolId, difficulty, labels
    FROM (SELECT requirementId, repositoryCommit, symbolId, unnest({_SLICES}) AS labels FROM labels WHERE relationship = 'implements') JOIN reqs USING (requirementId) JOIN runs USING (repositoryCommit)),
  items AS (SELECT configurationId, requirementId, repositoryCommit, labels, any_value(difficulty) AS difficulty, count(*) AS relevant, coalesce(1 / min(place), 0) AS rr, """
    + ", ".join(f"count(*) FILTER (place <= {k}) / count(*) AS r{k}, CASE WHEN count(*) FILTER (place <= {k}) > 0 THEN 1.0 ELSE 0.0 END AS h{k}" for k in (1, 3, 5, 10))
    + f""" FROM rel LEFT JOIN places USING (configurationId, requirementId, repositoryCommit, symbolId) GROUP BY configurationId, requirementId, repositoryCommit, labels),
  found AS (SELECT configurationId, stratum, count(*) AS scored, """
    + ", ".join(f"round(avg(r{k}), 9) AS recall_{k}, round(avg(h{k}) * 100, 7) AS hit_{k}" for k in (1, 3, 5, 10))
    + f""", round(avg(rr), 9) AS mrr FROM (SELECT *, unnest({_STRATA}) AS stratum FROM items) GROUP BY ALL),
  sizes AS (SELECT stratum, count(*) AS n FROM (SELECT unnest({_STRATA}) AS stratum FROM reqs, (VALUES ('independent'), ('both')) v(labels)) GROUP BY stratum),
  metrics AS (SELECT c.configurationId, sizes.stratum, coalesce(scored, 0) AS scored, n * c.runs - coalesce(scored, 0) AS unscored, """
    + ", ".join(f"coalesce(recall_{k}, 0.0) AS recall_{k}, coalesce(hit_{k}, 0.0) AS hit_{k}" for k in (1, 3, 5, 10))
    + """, coalesce(mrr, 0.0) AS mrr FROM (SELECT configurationId, count(*) AS runs FROM runs GROUP BY ALL) c CROSS JOIN sizes LEFT JOIN found f ON f.configurationId = c.configurationId AND f.stratum = sizes.stratum)
"""
)

_FUSION = (
    _with(_LISTS10)
    + """, parts AS ({parts}),
  merged AS (SELECT requirementId, repositoryCommit, symbolId, round(sum(part), 12) AS score FROM parts GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY requirementId, repositoryCommit ORDER BY score DESC, symbolId) AS rank FROM merged)
SELECT requirementId, repositoryCommit, CAST(rank AS INTEGER) AS rank, symbolId, round(score, 9) AS score FROM ranked WHERE rank <= 5"""
)
_COVERAGE = (
    _with(_REQS, _INDEX, _KNOWN)
    + """, cur AS (SELECT * FROM idx WHERE "commit" IN (SELECT repositoryCommit FROM newest)),
  counts AS (SELECT requirementId, count(*) AS links, count(*) FILTER (symbolId NOT IN (SELECT symbolId FROM known)) AS broken_links FROM cur GROUP BY ALL),
  states AS (SELECT requirementId, CASE WHEN links IS NULL THEN 'unlinked' WHEN links = broken_links THEN 'stale' ELSE 'linked' END AS state, coalesce(links, 0) AS links, coalesce(broken_links, 0) AS broken_links
    FROM (SELECT DISTINCT requirementId FROM reqs) LEFT JOIN counts USING (requirementId))
"""
)
_PAYLOAD = (
    _with(_LISTS5, _CORPUS)
    + """, items AS (SELECT requirementId, configurationId, l.repositoryCommit, place AS rank, l.symbolId,
    least(length(coalesce(signature, '')), 501) AS signature, least(length(coalesce(documentation, '')), 1001) AS documentation, least(length(coalesce(normalizedSource, '')), 2001) AS source
    FROM lists l JOIN corpus c ON l.symbolId = c.symbolId AND l.repositoryCommit = c.repositoryCommit WHERE place <= 3)
"""
)
_CHANGES = "changes AS (" + GENERAL["p4_found"] + ")"
_LINKS = r"list_filter(list_transform(regexp_extract_all(text, '(!?)\[\[([^\]\n|]+)(?:\|[^\]\n]*)?\]\]', 0), lambda m: CASE WHEN m[1] = '!' THEN '' ELSE trim(regexp_extract(m, '\[\[([^\]\n|]+)', 1)) END), lambda t: t <> '')"
_EXCLUDED = f"(len(list_filter(string_split(path, '/')[:-2], lambda d: d IN {DIRECTORIES})) > 0 OR regexp_matches(path, '{MINIFIED}') OR regexp_matches(path, '(^|/)(views|report)/'))"
_TEXT = (
    "coalesce(kind, '') || ' ' || coalesce(qualifiedName, '') || chr(10) || 'path: ' || coalesce(relativePath, '')"
    + "".join(f" || CASE WHEN coalesce({c}, '') <> '' THEN chr(10) || '{label}: ' || {c} ELSE '' END" for label, c in (("signature", "signature"), ("documentation", "documentation"), ("source", "normalizedSource")))
)

SQL: dict[str, str] = {
    "token_counts": f"SELECT source, CAST(sum(len(t)) AS BIGINT) AS tokens, CAST(sum(len(list_distinct(t))) AS BIGINT) AS distinct_tokens FROM (SELECT source, {_tokens('text')} AS t FROM documents WHERE text IS NOT NULL) GROUP BY source",
    "folded_terms": _with(_REQS) + f"SELECT term, {_fold('term', 1)} AS folded_1, {_fold('term', 2)} AS folded_2, count(*) AS n FROM (SELECT unnest(list_filter({_tokens('text')}, lambda t: NOT list_contains({_STOP}, t))) AS term FROM reqs) GROUP BY term",
    "protected_stopwords": _with(_CORPUS, _stop_table(LEXICAL_V5)) + f"SELECT w AS word, w IN (SELECT word FROM stop) AS kept FROM (SELECT unnest({_STOP}) AS w)",
    "term_stats": _with(_CORPUS, _FIELDS) + f""", pairs AS (SELECT DISTINCT doc, unnest(list_transform(list_filter({_tokens('content')}, lambda t: NOT list_contains({_STOP}, t)), lambda t: {_fold('t', 2)})) AS term FROM fields)
        SELECT term, count(*) AS df, round(ln(1 + ((SELECT count(*) FROM corpus) - count(*) + 0.5) / (count(*) + 0.5)), 6) AS idf FROM pairs GROUP BY term""",
    "field_lengths": _with(_CORPUS, _FIELDS) + f"SELECT field, round(avg(nullif(len(list_filter({_tokens('content')}, lambda t: NOT list_contains({_STOP}, t))), 0)), 6) AS average_length FROM fields GROUP BY field",
    "bm25f_topk": _bm25f(LEXICAL_V5, _TWENTIETH), "bm25f_v4_topk": _bm25f(LEXICAL_V4, ""), "bm25f_v3_topk": _bm25f(LEXICAL_V3, ""),
    "span_containment": _with(_CORPUS) + """SELECT o.doc, count(i.doc) AS "inner" FROM corpus o LEFT JOIN corpus i ON o.repositoryCommit = i.repositoryCommit AND o.relativePath = i.relativePath
        AND o.startLine <= i.startLine AND o.endLine >= i.endLine AND i.endLine - i.startLine < o.endLine - o.startLine GROUP BY o.doc""",
    "cosine_topk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, i.vec_id AS item, round(list_cosine_similarity(q.e, i.e), 9) AS score FROM v q, v i WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item) AS rank FROM s) SELECT query, CAST(rank AS INTEGER) AS rank, item, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "embedding_texts": _with(_CORPUS, _REQS, _NEWEST) + f"""SELECT DISTINCT substr(sha256(text), 1, 32) AS key, CAST(length(text) AS INTEGER) AS chars FROM (SELECT {_TEXT} AS text FROM corpus SEMI JOIN newest USING (repositoryCommit) UNION ALL SELECT text FROM reqs)
        WHERE text NOT IN (SELECT {_TEXT} FROM corpus ANTI JOIN newest USING (repositoryCommit))""",
    "rrf_fusion": _FUSION.replace("{parts}", "SELECT requirementId, repositoryCommit, symbolId, 1.0 / (60 + place) AS part FROM lists WHERE configurationId IN ('bm25f-v5', 'semantic-v2')"),
    "weighted_fusion": _FUSION.replace("{parts}", """SELECT requirementId, repositoryCommit, symbolId, 0.5 * CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS part
        FROM lists WHERE configurationId IN ('bm25f-v5', 'semantic-v2') WINDOW w AS (PARTITION BY requirementId, repositoryCommit, configurationId)"""),
    "retrieval_metrics": _METRICS + "SELECT * FROM metrics",
    "config_comparison": _METRICS + """, best AS (SELECT stratum, max(recall_10) AS best, count(*) AS reported FROM metrics GROUP BY stratum)
        SELECT stratum, reported, best, (SELECT string_agg(configurationId, ',' ORDER BY configurationId) FROM metrics m WHERE m.stratum = best.stratum AND m.recall_10 = best.best) AS best_by FROM best""",
    "config_pivot": _METRICS + "SELECT stratum, max(mrr) FILTER (configurationId = 'bm25f-v5') AS bm25f_v5, max(mrr) FILTER (configurationId = 'hybrid-rrf-v1') AS hybrid_rrf_v1, max(mrr) FILTER (configurationId = 'semantic-v2') AS semantic_v2 FROM metrics GROUP BY stratum",
    "unscored_requirements": _with(_LABELS, _REQS) + f""", runs AS (SELECT DISTINCT repositoryCommit FROM retrieval WHERE configurationId IS NOT NULL AND repositoryCommit IS NOT NULL),
        scored AS (SELECT DISTINCT requirementId, unnest({_SLICES}) AS labels FROM labels SEMI JOIN runs USING (repositoryCommit) WHERE relationship = 'implements')
        SELECT requirementId, unnest({_STRATA}) AS stratum FROM (SELECT requirementId, difficulty, labels FROM reqs, (VALUES ('independent'), ('both')) v(labels)) ANTI JOIN scored USING (requirementId, labels)""",
    "proposal_metrics": _with(_LOG, _LABELS, _REQS) + f""", strata AS (SELECT requirementId, unnest(CASE WHEN difficulty <> '' THEN ['overall', 'suggest-only', 'independent-plus-candidate-review', difficulty] ELSE ['overall', 'suggest-only', 'independent-plus-candidate-review'] END) AS stratum FROM reqs),
        p AS (SELECT DISTINCT stratum, requirementId, proposedSymbolId AS symbolId FROM latest JOIN strata USING (requirementId) WHERE modelClassification = 'implements' AND {_band('modelConfidence', 'modelClassification')} IN ('suggest', 'review')
          AND (stratum <> 'suggest-only' OR {_band('modelConfidence', 'modelClassification')} = 'suggest')),
        r AS (SELECT DISTINCT stratum, requirementId, symbolId FROM (SELECT *, {_SLICES} AS slices FROM labels) JOIN strata USING (requirementId) WHERE relationship = 'implements'
          AND list_contains(slices, CASE WHEN stratum = 'independent-plus-candidate-review' THEN 'both' ELSE 'independent' END)),
        c AS (SELECT stratum, count(p.x) AS predicted, count(r.y) AS relevant, count(*) FILTER (p.x = 1 AND r.y = 1) AS tp FROM (SELECT *, 1 AS x FROM p) p FULL JOIN (SELECT *, 1 AS y FROM r) r USING (stratum, requirementId, symbolId) GROUP BY stratum),
        s AS (SELECT stratum, count(*) AS requirements, count(*) FILTER (NOT EXISTS (SELECT 1 FROM r WHERE r.stratum = strata.stratum AND r.requirementId = strata.requirementId)) AS without_labels FROM strata GROUP BY stratum),
        m AS (SELECT stratum, requirements, without_labels, coalesce(predicted, 0) AS predicted, coalesce(relevant, 0) AS relevant, coalesce(tp, 0) AS true_positives FROM s LEFT JOIN c USING (stratum))
        SELECT *, round(coalesce(true_positives / nullif(predicted, 0), 0), 9) AS precision, round(coalesce(true_positives / nullif(relevant, 0), 0), 9) AS recall,
          round(coalesce(2 * true_positives / nullif(predicted + relevant, 0), 0), 9) AS f1 FROM m""",
    "band_counts": _with(_LOG) + f"SELECT modelClassification, {_band('modelConfidence', 'modelClassification')} AS band, count(*) AS n FROM log GROUP BY ALL",
    "link_state": _with(_LOG) + "SELECT requirementId, proposedSymbolId, symbolId, relationship FROM latest WHERE kind <> 'reject'",
    "recorded_bands": _with(_LOG) + "SELECT requirementId, proposedSymbolId, band FROM latest",
    "review_statistics": _with(_LOG) + f""", x AS (SELECT *, unnest(CASE WHEN band IN {BANDS} THEN ['all', band] ELSE ['all'] END) AS slice, coalesce(kind = 'redirect' OR (kind = 'reject' AND band = 'suggest') OR (kind = 'accept' AND band = 'discard'), false) AS o FROM latest)
        SELECT slice AS band, count(*) AS decided, count(*) FILTER (kind = 'accept') AS accepted, count(*) FILTER (kind = 'reject') AS rejected, count(*) FILTER (kind = 'redirect') AS redirected, count(*) FILTER (o) AS overrides, round(count(*) FILTER (o) / count(*), 9) AS override_rate FROM x GROUP BY slice""",
    "review_queue": _with(_LOG, _KNOWN) + f""", p AS (SELECT {_requirement("requirementId")} AS requirementId, {_symbol("proposedSymbolId")} AS symbolId, max(modelConfidence) AS c, max(modelClassification) AS k FROM decisions GROUP BY ALL)
        SELECT requirementId, symbolId, band, stale FROM (SELECT p.requirementId, p.symbolId, coalesce(latest.band, {_band('c', 'k')}) AS band, latest.band IS NOT NULL AS decided, p.symbolId NOT IN (SELECT symbolId FROM known) AS stale
          FROM p LEFT JOIN latest ON latest.requirementId = p.requirementId AND latest.proposedSymbolId = p.symbolId WHERE p.requirementId IS NOT NULL AND p.symbolId IS NOT NULL) WHERE NOT decided AND band <> 'discard'""",
    "link_index": _with(_INDEX) + 'SELECT requirementId, symbolId, reviewer, timestamp, "commit" FROM idx',
    "link_adjacency": _with(_INDEX) + """SELECT 'requirement' AS side, requirementId AS key, symbolId AS item FROM idx UNION ALL SELECT 'symbol', symbolId, requirementId FROM idx""",
    "unlinked_requirements": _COVERAGE + "SELECT requirementId FROM states WHERE links = 0",
    "coverage_states": _COVERAGE + "SELECT * FROM states",
    "coverage_summary": _COVERAGE + "SELECT state, count(*) AS requirements, CAST(sum(links) AS BIGINT) AS links, CAST(sum(broken_links) AS BIGINT) AS broken_links FROM states GROUP BY state",
    "reconcile_links": _with(_LOG, _INDEX) + """, e AS (SELECT requirementId, symbolId, reviewer, timestamp, repositoryCommit AS c FROM (SELECT *, row_number() OVER (PARTITION BY requirementId, symbolId ORDER BY timestamp NULLS LAST, repositoryCommit NULLS LAST, reviewer NULLS LAST) AS m
          FROM latest WHERE kind <> 'reject' AND symbolId IS NOT NULL) WHERE m = 1)
        SELECT coalesce(e.requirementId, idx.requirementId) AS requirementId, coalesce(e.symbolId, idx.symbolId) AS symbolId, CASE WHEN idx.symbolId IS NULL THEN 'missing-from-index' WHEN e.symbolId IS NULL THEN 'absent-from-frontmatter' ELSE 'field-mismatch' END AS rule
        FROM e FULL JOIN idx ON e.requirementId = idx.requirementId AND e.symbolId = idx.symbolId WHERE e.symbolId IS NULL OR idx.symbolId IS NULL OR e.reviewer IS DISTINCT FROM idx.reviewer OR e.timestamp IS DISTINCT FROM idx.timestamp OR e.c IS DISTINCT FROM idx."commit\"""",
    "resolved_links": _with(_INDEX, _KNOWN) + f""", prior AS (SELECT repositoryCommit FROM (SELECT repositoryCommit, row_number() OVER (PARTITION BY repository ORDER BY snapshotNo DESC) AS n FROM commits) WHERE n = 2),
        seen AS (SELECT {_symbol("symbolId")} AS symbolId, max(repositoryCommit) AS last FROM symbol_index SEMI JOIN prior USING (repositoryCommit) GROUP BY ALL)
        SELECT requirementId, symbolId, symbolId IN (SELECT symbolId FROM known) AS resolved, CASE WHEN symbolId IN (SELECT symbolId FROM known) THEN 'now' ELSE coalesce(last, "commit") END AS last_resolved FROM idx LEFT JOIN seen USING (symbolId)""",
    "stale_proposals": _with(_LOG, _KNOWN) + rf""", p AS (SELECT DISTINCT requirementId, proposedSymbolId AS symbolId, nullif(regexp_extract(proposedSymbolId, '^[^:]+:([^#]*)#', 1), '') AS path FROM log)
        SELECT requirementId, symbolId, symbolId NOT IN (SELECT symbolId FROM known) AS stale, CASE WHEN symbolId NOT IN (SELECT symbolId FROM known) THEN CASE WHEN {_EXCLUDED} THEN 'excluded' ELSE 'missing' END END AS reason, path FROM p""",
    "drifted_links": _with(_INDEX, _CHANGES) + "SELECT requirementId, symbolId, c.repositoryCommit, change FROM idx JOIN changes c USING (symbolId)",
    "suspected_renames": _with(_CHANGES) + f""", pairs AS (SELECT repositoryCommit, lead(repositoryCommit) OVER (PARTITION BY repository ORDER BY snapshotNo) AS later FROM commits),
        b AS (SELECT repositoryCommit, {_symbol("symbolId")} AS symbolId, max(nullif(replace({_canonical("normalizedSource")}, name, '_'), '')) AS raw FROM symbol_index WHERE {_symbol("symbolId")} IS NOT NULL GROUP BY ALL),
        gone AS (SELECT c.repositoryCommit, c.symbolId, raw FROM changes c JOIN pairs p ON p.later = c.repositoryCommit JOIN b ON b.repositoryCommit = p.repositoryCommit AND b.symbolId = c.symbolId WHERE change = 'removed' AND raw IS NOT NULL),
        new AS (SELECT c.repositoryCommit, raw, min(c.symbolId) AS renamed_to, count(*) AS candidates FROM changes c JOIN b USING (repositoryCommit, symbolId) WHERE change = 'added' AND raw IS NOT NULL GROUP BY ALL)
        SELECT gone.repositoryCommit, symbolId, renamed_to, candidates FROM gone JOIN new USING (repositoryCommit, raw)""",
    "result_differences": _with(_LISTS5) + """, a AS (SELECT * FROM lists WHERE configurationId = 'bm25f-v5'), b AS (SELECT * FROM lists WHERE configurationId = 'hybrid-rrf-v1')
        SELECT requirementId, repositoryCommit, symbolId AS item, a.place AS first_rank, b.place AS second_rank FROM a FULL JOIN b USING (requirementId, repositoryCommit, symbolId) WHERE a.place IS DISTINCT FROM b.place""",
    "payload_items": _PAYLOAD + "SELECT requirementId, configurationId, repositoryCommit, rank, symbolId, CAST(signature AS INTEGER) AS signature, CAST(documentation AS INTEGER) AS documentation, CAST(source AS INTEGER) AS source FROM items",
    "payload_audit": _with(_LISTS5, _CORPUS) + f""", sent AS (SELECT * FROM lists WHERE configurationId = 'bm25f-v5'), judged AS (SELECT * FROM lists WHERE configurationId = 'semantic-v2'),
        items AS (SELECT l.requirementId, l.repositoryCommit, l.symbolId, length(signature) AS a, length(documentation) AS b, length(normalizedSource) AS c FROM sent l JOIN corpus c ON l.symbolId = c.symbolId AND l.repositoryCommit = c.repositoryCommit WHERE place <= 3),
        texts AS (SELECT {_requirement("id")} AS requirementId, coalesce(title, '') || ' ' || coalesce(statement, '') || CASE WHEN coalesce(array_to_string(acceptance_criteria, ' '), '') <> '' THEN ' ' || array_to_string(acceptance_criteria, ' ') ELSE '' END AS text FROM requirements),
        units AS (SELECT * FROM (SELECT DISTINCT requirementId, repositoryCommit FROM sent) JOIN texts USING (requirementId)),
        u AS (SELECT DISTINCT requirementId, repositoryCommit FROM units), j AS (SELECT DISTINCT requirementId, repositoryCommit FROM judged),
        v AS (SELECT 'unknown-list' AS rule, 1 AS n FROM u ANTI JOIN j USING (requirementId, repositoryCommit) UNION ALL SELECT 'missing-list', 1 FROM j ANTI JOIN u USING (requirementId, repositoryCommit)
          UNION ALL SELECT 'duplicate-requirement', count(*) - 1 FROM units GROUP BY requirementId, repositoryCommit HAVING count(*) > 1
          UNION ALL SELECT 'excess-items', 1 FROM items GROUP BY requirementId, repositoryCommit HAVING count(*) > 2
          UNION ALL SELECT 'duplicate-item', count(*) - 1 FROM items GROUP BY requirementId, repositoryCommit, symbolId HAVING count(*) > 1
          UNION ALL SELECT 'unretrieved-item', 1 FROM (SELECT * FROM items SEMI JOIN j USING (requirementId, repositoryCommit)) ANTI JOIN judged USING (requirementId, repositoryCommit, symbolId)
          UNION ALL SELECT 'oversized-field', n FROM (SELECT coalesce(CAST(a > 61 AS INTEGER), 0) + coalesce(CAST(b > 121 AS INTEGER), 0) + coalesce(CAST(c > 301 AS INTEGER), 0) AS n FROM items) WHERE n > 0
          UNION ALL SELECT 'oversized-field', 1 FROM units WHERE length(text) > 201)
        SELECT rule, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY rule""",
    "disclosure_audit": _with(_CORPUS) + """SELECT configurationId, repositoryCommit, CASE WHEN configurationId LIKE 'bm25f%' THEN 'unexpected-embedding' ELSE 'undisclosed-embedding' END AS rule
        FROM (SELECT DISTINCT configurationId, repositoryCommit FROM retrieval WHERE configurationId IS NOT NULL AND repositoryCommit IS NOT NULL) r
        WHERE (configurationId LIKE 'bm25f%') = EXISTS (SELECT 1 FROM corpus c WHERE c.repositoryCommit = r.repositoryCommit)""",
    "usage_totals": f"""WITH u AS (SELECT {_requirement("requirement_id")} AS requirementId, coalesce(CAST(ceil(length(text) / 4) AS BIGINT), 0) AS i FROM documents)
        SELECT NULL AS requirementId, true AS whole, count(*) AS calls, CAST(sum(i) AS BIGINT) AS input_tokens, CAST(count(*) * 60 AS BIGINT) AS output_tokens FROM u
        UNION ALL SELECT requirementId, false, count(*), CAST(sum(i) AS BIGINT), CAST(count(*) * 60 AS BIGINT) FROM u WHERE requirementId IS NOT NULL GROUP BY requirementId""",
    "duplicate_ids": f"SELECT DISTINCT requirementId, path, n FROM (SELECT {_requirement('id')} AS requirementId, path, count(*) OVER (PARTITION BY {_requirement('id')}) AS n FROM requirements) WHERE requirementId IS NOT NULL AND n > 1",
    "overload_ids": _with(_CORPUS) + f""", b AS (SELECT *, 'ts:' || replace(relativePath, chr(92), '/') || '#' || qualifiedName || ':' || kind AS base FROM corpus WHERE relativePath IS NOT NULL AND qualifiedName IS NOT NULL AND kind IS NOT NULL),
        g AS (SELECT *, count(*) OVER (PARTITION BY repositoryCommit, base) > 1 AS shared FROM b)
        SELECT repositoryCommit, symbolId, CASE WHEN shared THEN base || ':' || substr(sha256({_canonical("signature")}), 1, 8) ELSE base END AS made, shared AS overloaded FROM g""",
    "wiki_backlinks": f"SELECT target, count(*) AS mentions, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, unnest({_LINKS}) AS target FROM documents WHERE text IS NOT NULL) GROUP BY target",
    "wiki_resolution": f"""WITH l AS (SELECT DISTINCT doc_id AS doc, unnest({_LINKS}) AS target FROM documents WHERE text IS NOT NULL),
        d AS (SELECT DISTINCT path, {_requirement("id")} AS r, regexp_replace(path, '\\.md$', '') AS stem FROM requirements WHERE path IS NOT NULL),
        k AS (SELECT 1 AS tier, path AS target, path FROM d UNION ALL SELECT 1, stem, path FROM d UNION ALL SELECT 2, string_split(stem, '/')[-1], path FROM d UNION ALL SELECT 3, r, path FROM d),
        f AS (SELECT target, path FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, path) AS n FROM k WHERE target IS NOT NULL) WHERE n = 1)
        SELECT doc, l.target, f.path FROM l LEFT JOIN f ON l.target = f.target""",
    "symbol_counts": _with(_CORPUS) + "SELECT repositoryCommit, kind, count(*) AS symbols, count(DISTINCT relativePath) AS files FROM corpus GROUP BY ALL",
    "symbol_paths": _with(_CORPUS) + rf""", p AS (SELECT nullif(regexp_extract(symbolId, '^[^:]+:([^#]*)#', 1), '') AS path FROM corpus)
        SELECT path, coalesce({_EXCLUDED}, false) AS excluded, count(*) AS symbols FROM p GROUP BY path""",
}
