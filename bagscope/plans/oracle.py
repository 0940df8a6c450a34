"""SQL equivalents of the registered queries, for any ANSI engine over the same tables."""

from __future__ import annotations

from bagscope.functions.text import NULL_TOKENS
from bagscope.plans.registry import FORCED, MIN_COUNT, TOP_VARIANCE

SEQUENCES = r"""
tokens AS (
  SELECT doc_id AS repertoire_id, lang AS v_call,
         unnest(string_split_regex(text, '[ \t\r\n]+')) AS junction_aa
  FROM documents),
seqs AS (
  SELECT repertoire_id, junction_aa, v_call, right(junction_aa, 1) AS j_call
  FROM tokens WHERE junction_aa <> '')"""


def _kmers(*ks: int) -> str:
    """CTEs down to ``counts(repertoire_id, k, kmer, cnt)``."""
    per_k = " UNION ALL ".join(
        f"SELECT repertoire_id, {k} AS k, junction_aa, unnest(range(1, length(junction_aa) - {k} + 2)) AS pos "
        f"FROM seqs WHERE length(junction_aa) >= {k}"
        for k in ks
    )
    return f"""{SEQUENCES},
placed AS ({per_k}),
counts AS (
  SELECT repertoire_id, k, substring(junction_aa, pos, k) AS kmer, count(*) AS cnt
  FROM placed GROUP BY ALL)"""


_TOTALS = "totals AS (SELECT k, kmer, sum(cnt)::BIGINT AS total FROM counts GROUP BY ALL)"
_TRAIN_TEST = """train AS (SELECT * FROM counts WHERE repertoire_id IN (SELECT doc_id FROM labels)),
test AS (SELECT * FROM counts WHERE repertoire_id NOT IN (SELECT doc_id FROM labels)),
train_totals AS (SELECT k, kmer, sum(cnt) AS total FROM train GROUP BY ALL)"""
_FREQ = f"""{_TRAIN_TEST},
kept AS (SELECT * FROM train WHERE kmer IN (SELECT kmer FROM train_totals WHERE total >= 2)),
freqs AS (SELECT repertoire_id, kmer, cnt / sum(cnt) OVER (PARTITION BY repertoire_id) AS freq FROM kept)"""

_forced = ", ".join(f"'{x}'" for x in FORCED)

SQL: dict[str, str] = {
    "kmer_counts_k3": f"WITH {_kmers(3)} SELECT repertoire_id, kmer, cnt FROM counts",
    "kmer_counts_k34": f"WITH {_kmers(3, 4)} SELECT repertoire_id, k, kmer, cnt FROM counts",
    "kmer_only_k4": f"WITH {_kmers(4)} SELECT repertoire_id, k, kmer, cnt FROM counts",
    "kmer_vocab_min20": f"WITH {_kmers(3, 4)}, {_TOTALS} SELECT k, kmer, total FROM totals WHERE total >= {MIN_COUNT}",
    "top_kmers": f"WITH {_kmers(3, 4)}, {_TOTALS} SELECT k, kmer, total FROM totals WHERE total >= {MIN_COUNT} "
    "ORDER BY total DESC, k, kmer LIMIT 20",
    "kmer_vocab_forced": f"WITH {_kmers(3, 4, 5)}, {_TOTALS} SELECT k, kmer, total FROM totals "
    f"WHERE total >= {MIN_COUNT} OR kmer IN ({_forced})",
    "kmer_vocab_index": f"WITH {_kmers(3, 4)}, {_TOTALS} SELECT k, kmer, total, "
    f"row_number() OVER (ORDER BY k, kmer) - 1 AS idx FROM totals WHERE total >= {MIN_COUNT}",
    "kmer_vocab_summary": f"WITH {_kmers(3, 4)}, {_TOTALS} SELECT count(*) AS n_total, "
    f"count(*) FILTER (total >= {MIN_COUNT}) AS n_frequent, "
    f"round((1 - count(*) FILTER (total >= {MIN_COUNT}) / count(*)) * 100, 6) AS reduction_pct FROM totals",
    "kmer_feature_names": f"WITH {_kmers(3, 4)}, {_TOTALS} SELECT 'k' || k || '__' || kmer AS feature, "
    f"k AS parsed_k, kmer AS parsed_kmer FROM totals WHERE total >= {MIN_COUNT}",
    "kmer_align_test": f"WITH {_kmers(3, 4)}, {_TRAIN_TEST} SELECT repertoire_id, k, kmer, cnt FROM test "
    f"WHERE kmer IN (SELECT kmer FROM train_totals WHERE total >= {MIN_COUNT})",
    "kmer_zero_filled": f"WITH {_kmers(12)} SELECT doc_id AS repertoire_id, kmer, coalesce(cnt, 0) AS cnt "
    "FROM documents LEFT JOIN counts ON doc_id = repertoire_id",
    "kmer_feature_drift": f"""WITH {_kmers(3, 4)}, {_TRAIN_TEST},
vocab AS (SELECT k, kmer FROM train_totals WHERE total >= {MIN_COUNT}),
seen AS (SELECT DISTINCT k, kmer FROM test)
SELECT k, kmer, 'missing' AS drift FROM (SELECT * FROM vocab EXCEPT SELECT * FROM seen)
UNION ALL SELECT k, kmer, 'extra' AS drift FROM (SELECT * FROM seen EXCEPT SELECT * FROM vocab)""",
    "kmer_freq_norm": f"WITH {_kmers(4)}, {_FREQ} SELECT repertoire_id, kmer, round(freq, 9) AS freq FROM freqs",
    "kmer_top_variance": f"""WITH {_kmers(4)}, {_FREQ}, n AS (SELECT count(*) AS n FROM labels),
var AS (SELECT kmer, round(sum(freq * freq) / any_value(n) - power(sum(freq) / any_value(n), 2), 12) AS variance
        FROM freqs, n GROUP BY kmer)
SELECT kmer, variance FROM var ORDER BY variance DESC, kmer LIMIT {TOP_VARIANCE}""",
    "kmer_blocks": f"WITH {_kmers(3, 4)} SELECT repertoire_id, 'k' || k AS block, count(*) AS n_features, "
    "sum(cnt)::BIGINT AS n_kmers FROM counts GROUP BY ALL",
}

# --- clones -------------------------------------------------------------------------------------

_CLONE = "junction_aa, v_call, j_call"
_PRESENCE = f"presence AS (SELECT DISTINCT repertoire_id, {_CLONE} FROM seqs)"
_LABELS = "labelled AS (SELECT doc_id AS repertoire_id, quality AS label FROM labels)"


def _clone_stats(rows: str, labelled: str, min_pos: int = 3, max_neg: int | None = 0, p_cut: float = 0.05) -> str:
    """CTEs down to ``stats(clone, pos, neg, p_value, reason)`` from ``presence``."""
    common = "FALSE" if max_neg is None else f"neg > {max_neg}"
    term = """exp(lgamma(n_pos + 1) - lgamma(x + 1) - lgamma(n_pos - x + 1)
      + lgamma(n_neg + 1) - lgamma(pos + neg - x + 1) - lgamma(n_neg - pos - neg + x + 1)
      - lgamma(n_pos + n_neg + 1) + lgamma(pos + neg + 1) + lgamma(n_pos + n_neg - pos - neg + 1))"""
    return f"""{rows}, {labelled},
sizes AS (SELECT count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg FROM labelled),
clone_counts AS (
  SELECT {_CLONE}, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM presence JOIN labelled USING (repertoire_id) GROUP BY ALL HAVING pos > 0),
tested AS (
  SELECT {_CLONE}, pos, neg, CASE WHEN pos < {min_pos} OR {common} THEN NULL ELSE
    least(1.0, list_sum([{term} FOR x IN range(pos, least(n_pos, pos + neg) + 1)])) END AS p_value
  FROM clone_counts CROSS JOIN sizes),
stats AS (
  SELECT *, CASE WHEN pos < {min_pos} THEN 'too_rare' WHEN {common} THEN 'too_common'
    WHEN p_value >= {p_cut} THEN 'not_significant' ELSE 'kept' END AS reason FROM tested)"""


_STRICT = _clone_stats(f"{SEQUENCES}, {_PRESENCE}", _LABELS)
_RELAXED = _clone_stats(f"{SEQUENCES}, {_PRESENCE}", _LABELS, max_neg=None)
_CUSTOMERS = _clone_stats(
    """presence AS (
  SELECT DISTINCT o_custkey AS repertoire_id, p_brand AS junction_aa, p_type AS v_call,
         p_size::VARCHAR AS j_call
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "labelled AS (SELECT c_custkey AS repertoire_id, (c_mktsegment = 'BUILDING')::INT AS label FROM customer)",
    max_neg=None,
)
_INDEXED = f"""indexed AS (
  SELECT *, row_number() OVER (ORDER BY {_CLONE}) - 1 AS idx FROM stats WHERE reason = 'kept')"""

SQL |= {
    "clone_presence": f"WITH {SEQUENCES}, {_PRESENCE} SELECT * FROM presence",
    "clone_distinct": f"WITH {SEQUENCES} SELECT DISTINCT {_CLONE} FROM seqs",
    "clone_counts": f"WITH {_STRICT} SELECT {_CLONE}, pos, neg FROM clone_counts",
    "clone_fisher": f"WITH {_RELAXED} SELECT {_CLONE}, pos, neg, round(p_value, 9) AS p_value FROM stats "
    "WHERE p_value IS NOT NULL",
    "clone_selected": f"WITH {_STRICT}, {_INDEXED} SELECT {_CLONE}, pos, neg, round(p_value, 9) AS p_value, idx "
    "FROM indexed",
    "clone_selected_customers": f"WITH {_CUSTOMERS} SELECT {_CLONE}, pos, neg, round(p_value, 9) AS p_value "
    "FROM stats WHERE reason = 'kept'",
    "clone_funnel": f"WITH {_STRICT} SELECT count(*) AS checked, "
    + ", ".join(
        f"count(*) FILTER (reason = '{r}') AS {r}" for r in ("too_rare", "too_common", "not_significant", "kept")
    )
    + " FROM stats",
    "clone_strongest": f"WITH {_RELAXED} SELECT {_CLONE}, pos, neg, round(p_value, 9) AS p_value FROM stats "
    f"WHERE reason = 'kept' ORDER BY round(p_value, 9), {_CLONE} LIMIT 5",
    "clone_matrix": f"WITH {_STRICT}, {_INDEXED} SELECT repertoire_id, idx FROM presence "
    f"JOIN indexed USING ({_CLONE})",
    "clone_first_100": f"WITH {_STRICT}, {_INDEXED} SELECT {_CLONE}, idx FROM indexed WHERE idx < 100",
    "clone_freq_positive": f"WITH {SEQUENCES} SELECT {_CLONE}, count(*) AS n FROM seqs "
    "WHERE repertoire_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL",
    "clone_set_freq_positive": f"WITH {SEQUENCES} SELECT {_CLONE}, count(DISTINCT repertoire_id) AS n FROM seqs "
    "WHERE repertoire_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL",
}

# --- vectors ------------------------------------------------------------------------------------

_VALUES = """vals AS (
  SELECT label AS repertoire_id, unnest(range(0, 64))::INT AS dim, unnest(embedding)::DOUBLE AS value
  FROM embeddings)"""
_POOL = {"mean": "avg", "max": "max", "min": "min", "sum": "sum", "std": "stddev_pop"}
SQL |= {
    f"pool_{name}": f"WITH {_VALUES} SELECT repertoire_id, dim, round({fn}(value), 6) AS value FROM vals GROUP BY ALL"
    for name, fn in _POOL.items()
}
SQL["pool_mean_std"] = (
    f"WITH {_VALUES} SELECT repertoire_id, dim, round(avg(value), 6) AS value FROM vals GROUP BY ALL UNION ALL "
    "SELECT repertoire_id, dim + 64 AS dim, round(stddev_pop(value), 6) AS value FROM vals GROUP BY repertoire_id, dim"
)
_TOKENS = """toks AS (
  SELECT vec_id AS seq_no, unnest(range(0, 64)) // 8 AS token, (unnest(range(0, 64)) % 8)::INT AS dim,
         unnest(embedding)::DOUBLE AS value
  FROM embeddings)"""
SQL |= {
    "pool_tokens_cls": f"WITH {_TOKENS} SELECT seq_no, dim, round(value, 6) AS value FROM toks WHERE token = 0",
    "pool_tokens_mean": f"WITH {_TOKENS} SELECT seq_no, dim, round(avg(value), 6) AS value FROM toks "
    "WHERE token BETWEEN 1 AND 6 GROUP BY ALL",
    "pool_tokens_max": f"WITH {_TOKENS} SELECT seq_no, dim, round(max(value), 6) AS value FROM toks "
    "WHERE token BETWEEN 1 AND 6 GROUP BY ALL",
}

# --- datasets, metadata, folds ------------------------------------------------------------------

_RANKED = f"""{_LABELS},
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('42|' || repertoire_id), repertoire_id) - 1 AS rank,
         count(*) OVER (PARTITION BY label) AS n_label
  FROM labelled)"""

SQL |= {
    "dataset_type_cv": f"""WITH {SEQUENCES},
sizes AS (SELECT v_call AS dataset, repertoire_id, count(*) AS n FROM seqs GROUP BY ALL),
stats AS (SELECT dataset, count(*) AS n_repertoires, avg(n) AS m, stddev_pop(n) AS s FROM sizes GROUP BY ALL)
SELECT dataset, n_repertoires, round(m, 6) AS mean_seq, round(s, 6) AS std_seq, round(s / m, 6) AS cv,
       CASE WHEN s / m < 0.05 THEN 'synthetic' ELSE 'experimental' END AS dataset_type FROM stats""",
    "dataset_pairs": """SELECT 'train_dataset_' || lang AS dataset,
       string_agg(DISTINCT 'test_dataset_' || lang || '_' || source, ',' ORDER BY 'test_dataset_' || lang || '_' || source)
         AS tests FROM documents GROUP BY lang""",
    "fingerprint_shares": """SELECT lang AS dataset, count(*) AS matched,
       round(count(*) / (SELECT count(*) FROM labels), 6) AS share
FROM documents JOIN labels USING (doc_id) GROUP BY lang""",
    "fingerprint_match": """SELECT min(dataset) AS dataset FROM (
  SELECT lang AS dataset, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang)
WHERE n > 0.5 * (SELECT count(*) FROM labels)""",
    "label_column_discovery": " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", bool_and({c} IN (0, 1)) AS is_label, count(*) FILTER ({c} = 0) AS n_zero, "
        f"count(*) FILTER ({c} = 1) AS n_one FROM labels"
        for c in ("doc_id", "quality", "toxic")
    ),
    "validate_metadata": """SELECT doc_id AS repertoire_id, 'missing_file' AS problem FROM labels
  WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT doc_id, 'not_in_metadata' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "stratified_folds": f"WITH {_RANKED} SELECT repertoire_id, label, (rank % 5)::INT AS fold FROM ranked",
    "holdout_split": f"WITH {_RANKED} SELECT repertoire_id, label, "
    "CASE WHEN rank < round(n_label * 0.2) THEN 'test' ELSE 'train' END AS part FROM ranked",
    "class_weights": """SELECT quality AS label, count(*) AS n,
  round((SELECT count(*) / count(DISTINCT quality) FROM labels) / count(*), 6) AS weight FROM labels GROUP BY quality""",
    "sample_by_label": f"WITH {_RANKED} SELECT repertoire_id, label FROM ranked WHERE rank < round(n_label * 0.1)",
    "sample_ids": "SELECT doc_id AS repertoire_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 50",
    "sample_sequences": """SELECT label AS repertoire_id, vec_id AS seq_no FROM embeddings
QUALIFY row_number() OVER (PARTITION BY label ORDER BY md5('42|' || label || '|' || vec_id), vec_id) <= 10""",
}

# --- scores and metrics -------------------------------------------------------------------------

_BASE = """base AS (
  SELECT doc_id AS repertoire_id, lang, quality AS label, n_chars,
         len(string_split(text, ' ')) AS words, len(string_split(text, chr(10))) AS lines
  FROM documents JOIN labels USING (doc_id)),
scores AS (
  SELECT repertoire_id, lang, label, 'size' AS model, 0 AS model_order,
         round(n_chars / (n_chars + 1000), 6) AS score FROM base
  UNION ALL SELECT repertoire_id, lang, label, 'words', 1, round(words * 4 / greatest(n_chars, 1), 6) FROM base
  UNION ALL SELECT repertoire_id, lang, label, 'lines', 2, round(1.0 / lines, 6) FROM base)"""


def _auc(keys: str, source: str = "scores") -> str:
    """Mann-Whitney with half ties, by brute force over (positive, negative) pairs."""
    on = " AND ".join(f"p.{k.strip()} = n.{k.strip()}" for k in keys.split(","))
    selected = ", ".join(f"p.{k.strip()}" for k in keys.split(","))
    return f"""aucs AS (
  SELECT {selected}, avg(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0.0 END) AS auc
  FROM (SELECT * FROM {source} WHERE label = 1) p JOIN (SELECT * FROM {source} WHERE label = 0) n ON {on} GROUP BY ALL)"""


_FOLDS = f"""{_RANKED}, {_BASE},
folded AS (SELECT scores.*, (rank % 5)::INT AS fold FROM scores JOIN ranked USING (repertoire_id)),
{_auc("model, model_order, fold", "folded")}"""
_WEIGHTS = f"""{_BASE}, {_auc("model, model_order")},
weights AS (
  SELECT model, model_order, auc, auc - 0.5 AS weight, (auc - 0.5) / sum(abs(auc - 0.5)) OVER () AS norm_weight
  FROM aucs),
ranks AS (
  SELECT *, row_number() OVER (ORDER BY abs(norm_weight) DESC, model_order) AS wr,
         row_number() OVER (ORDER BY auc DESC, model_order) AS ar,
         row_number() OVER (ORDER BY greatest(weight, 0) DESC, model_order) AS pr,
         max(abs(norm_weight)) OVER () AS largest
  FROM weights)"""


def _weights(final: str) -> str:
    return (
        f"WITH {_WEIGHTS} SELECT model, round(weight, 6) AS weight, round(auc, 6) AS auc, "
        f"round(norm_weight, 6) AS norm_weight, round({final}, 6) AS final_weight FROM ranks"
    )


SQL |= {
    "roc_auc": f"WITH {_BASE}, {_auc('model')} SELECT model, round(auc, 6) AS auc FROM aucs",
    "roc_auc_by_language": f"WITH {_BASE}, {_auc('lang, model')} SELECT lang, model, round(auc, 6) AS auc FROM aucs",
    "classification_report": f"""WITH {_BASE},
r AS (SELECT *, ((score > 0.5)::INT = label)::INT AS ok FROM scores)
SELECT model, count(*) AS n, round(avg(ok), 6) AS accuracy,
  round(avg(ok) FILTER (label = 1), 6) AS sensitivity, round(avg(ok) FILTER (label = 0), 6) AS specificity,
  round(avg(score) FILTER (label = 1), 6) AS mean_score_positive,
  round(avg(score) FILTER (label = 0), 6) AS mean_score_negative,
  round((avg(ok) FILTER (label = 1) + avg(ok) FILTER (label = 0)) / 2, 6) AS balanced_accuracy
FROM r GROUP BY model""",
    "hard_predictions": f"WITH {_BASE} SELECT repertoire_id, model, (score > 0.5)::INT AS prediction FROM scores",
    "fold_summary": f"WITH {_FOLDS} SELECT model, round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc "
    "FROM aucs GROUP BY model",
    "grid_winner": f"WITH {_FOLDS} SELECT model, round(avg(auc), 6) AS mean_auc FROM aucs GROUP BY model, model_order "
    "ORDER BY avg(auc) DESC, model_order LIMIT 1",
    "compare_predictions": f"""WITH {_BASE},
pairs AS (
  SELECT x.score AS sx, y.score AS sy FROM (SELECT * FROM scores WHERE model = 'size') x
  JOIN (SELECT * FROM scores WHERE model = 'words') y USING (repertoire_id))
SELECT count(*) AS n, round(corr(sx, sy), 6) AS correlation, round(max(abs(sx - sy)), 6) AS max_gap,
  round(avg(abs(sx - sy)), 6) AS mean_gap FROM pairs""",
    "ensemble_synthetic_weights": _weights("(wr = 1)::INT::DOUBLE"),
    "ensemble_synthetic_cv": _weights("(ar = 1)::INT::DOUBLE"),
    "ensemble_synthetic_hybrid": _weights("CASE WHEN largest > 0.5 THEN wr = 1 ELSE ar = 1 END::INT::DOUBLE"),
    "ensemble_experimental": _weights(
        "CASE WHEN max(weight) OVER () <= 0 THEN (wr = 1)::INT::DOUBLE ELSE "
        "CASE WHEN pr <= 2 THEN greatest(weight, 0) ELSE 0 END "
        "/ sum(CASE WHEN pr <= 2 THEN greatest(weight, 0) ELSE 0 END) OVER () END"
    ),
    "blend": f"WITH {_BASE} SELECT repertoire_id, round(0.8 * max(score) FILTER (model = 'size') "
    "+ 0.2 * max(score) FILTER (model = 'words'), 6) AS score FROM scores GROUP BY repertoire_id",
}

# --- sequence importance and results ------------------------------------------------------------

_COEFS = f"""{_kmers(3, 4)}, {_TOTALS},
coefs AS (
  SELECT k, kmer, (total % 3 - 1) * (total % 5 + 1) / 8.0::DOUBLE AS coef, (total % 2 + 1)::DOUBLE AS scale
  FROM totals WHERE total >= {MIN_COUNT})"""
_UNIQUE = f"""{_COEFS},
uniq AS (SELECT DISTINCT {_CLONE} FROM seqs),
occ AS (
  SELECT {_CLONE}, substring(junction_aa, pos, k) AS kmer FROM (
    SELECT {_CLONE}, 3 AS k, unnest(range(1, length(junction_aa) - 1)) AS pos FROM uniq
    UNION ALL SELECT {_CLONE}, 4 AS k, unnest(range(1, length(junction_aa) - 2)) AS pos FROM uniq))"""
_DISTINCT = f"""{_UNIQUE},
sums AS (
  SELECT {_CLONE}, sum(coef / scale) AS s FROM (SELECT DISTINCT * FROM occ) JOIN coefs USING (kmer) GROUP BY ALL),
scored AS (
  SELECT {_CLONE}, round(coalesce(s, 0), 6) AS importance_score FROM uniq LEFT JOIN sums USING ({_CLONE}))"""

SQL |= {
    "importance_distinct": f"WITH {_DISTINCT} SELECT * FROM scored",
    "importance_baseline": f"""WITH {_UNIQUE},
sums AS (SELECT {_CLONE}, sum(abs(coef)) AS s FROM occ JOIN coefs USING (kmer) GROUP BY ALL)
SELECT {_CLONE}, round(coalesce(s, 0), 6) AS importance_score FROM uniq LEFT JOIN sums USING ({_CLONE})""",
    "feature_importance": f"WITH {_COEFS} SELECT kmer, coef, abs(coef) AS importance_score FROM coefs",
    "active_features": f"WITH {_COEFS} SELECT count(*) AS n_features, count(*) FILTER (coef <> 0) AS n_active FROM coefs",
    "top_sequences": f"""WITH {_DISTINCT},
best AS (SELECT *, row_number() OVER (ORDER BY importance_score DESC, {_CLONE}) AS rank FROM scored)
SELECT 'train_dataset_1_seq_top_' || rank AS "ID", 'train_dataset_1' AS dataset,
  -999.0::DOUBLE AS label_positive_probability, {_CLONE} FROM best WHERE rank <= 1000""",
    "union_submission": f"""WITH {_STRICT}, {_INDEXED}, {_BASE}
SELECT repertoire_id::VARCHAR AS "ID", 'test_dataset_' || model AS dataset, score AS label_positive_probability,
  '-999.0' AS junction_aa, '-999.0' AS v_call, '-999.0' AS j_call FROM scores WHERE model IN ('size', 'words')
UNION ALL SELECT 'train_dataset_1_seq_top_' || (idx + 1), 'train_dataset_1', -999.0, {_CLONE} FROM indexed""",
    "encoder_ids": r"""SELECT doc_id, coalesce(nullif(regexp_extract(
  CASE WHEN doc_id % 2 = 0 THEN 'hub/esm2_t' || doc_id || '_8M_' || lang ELSE source END,
  'esm2_([^_/]+_[^_/]+)', 1), ''), 't6_8M') AS model_id FROM documents""",
    "encoder_inputs": f"WITH {SEQUENCES} SELECT DISTINCT substring(junction_aa, 1, 38) AS input FROM seqs",
    "null_tokens": f"WITH {SEQUENCES} SELECT v_call, count(*) AS n, count(*) FILTER (junction_aa IN ("
    + ", ".join(f"'{t}'" for t in NULL_TOKENS)
    + ")) AS n_null FROM seqs GROUP BY v_call",
}

# --- sources and sinks --------------------------------------------------------------------------

SQL |= {
    "tsv_roundtrip": """SELECT 'train_dataset_' || (c_nationkey % 2) AS dataset, p_brand AS junction_aa,
  CASE WHEN length(p_type) % 5 <> 0 THEN p_type END AS v_call, p_size::VARCHAR AS j_call, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "metadata_labels": """SELECT c_custkey::VARCHAR AS repertoire_id, c_mktsegment = 'BUILDING' AS label_positive,
  (c_mktsegment = 'BUILDING')::INT AS label, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey::INT ELSE -1 END AS age FROM customer""",
    "full_dataset": """SELECT c_custkey::VARCHAR AS ID, c_mktsegment = 'BUILDING' AS label_positive, count(*) AS n_rows,
  count(DISTINCT p_type) AS n_v_calls
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
    "labelled_features": f"WITH {_kmers(3)} SELECT repertoire_id, kmer, cnt, quality AS label FROM counts "
    "JOIN labels ON doc_id = repertoire_id",
    "feature_store_roundtrip": f"WITH {_kmers(3)} SELECT lang AS dataset, count(*) AS n_rows, "
    "sum(cnt)::BIGINT AS n_kmers FROM counts JOIN documents ON doc_id = repertoire_id GROUP BY lang",
    "submission_roundtrip": SQL["union_submission"],
    "clone_model_nothing_kept": "SELECT c_custkey AS repertoire_id, 0.5::DOUBLE AS score FROM customer",
}

SQL |= {
    "most_shared_clones": f"""WITH {SEQUENCES}, {_PRESENCE},
shared AS (
  SELECT {_CLONE}, count(*) AS n FROM presence
  WHERE repertoire_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL)
SELECT {_CLONE}, n, row_number() OVER (ORDER BY n DESC, {_CLONE}) AS rank FROM shared
QUALIFY row_number() OVER (ORDER BY n DESC, {_CLONE}) <= 500""",
    "requested_vectors": """SELECT label::VARCHAR AS dataset, vec_id AS repertoire_id FROM embeddings
WHERE vec_id IN (SELECT doc_id FROM labels WHERE doc_id % 10 = label)""",
}

# --- models, the part that SQL can express -------------------------------------------------------

_RANKED_APART = _RANKED.replace("labelled AS (", "every_label AS (").replace("FROM labelled", "FROM every_label")

SQL |= {
    "kmer_scales": f"""WITH {_kmers(3, 4)}, {_TRAIN_TEST},
sizes AS (SELECT count(*) AS n FROM labels),
sums AS (
  SELECT k, kmer, sum(cnt)::DOUBLE AS s, sum(cnt * cnt)::DOUBLE AS q FROM train
  WHERE kmer IN (SELECT kmer FROM train_totals WHERE total >= {MIN_COUNT}) GROUP BY ALL)
SELECT k, kmer, round(s / n, 6) AS mean,
  round(CASE WHEN q / n - (s / n) * (s / n) > 1e-12 * greatest((s / n) * (s / n), 1)
    THEN sqrt(q / n - (s / n) * (s / n)) ELSE 1 END, 6) AS scale FROM sums CROSS JOIN sizes""",
    "clone_fold_selection": " UNION ALL ".join(
        f"""SELECT * FROM (WITH {_RANKED_APART}, {_clone_stats(f"{SEQUENCES}, {_PRESENCE}", f"labelled AS (SELECT repertoire_id, label FROM ranked WHERE rank % 5 <> {fold})")}
SELECT {fold} AS fold, {_CLONE}, pos, neg, round(p_value, 9) AS p_value FROM stats WHERE reason = 'kept')"""
        for fold in range(5)
    ),
    "embedding_store_roundtrip": """SELECT 'part_' || (vec_id % 3) AS dataset, label AS repertoire_id, count(*) AS n,
  round(sum(list_sum(embedding::DOUBLE[])), 4) AS mean_sum, round(-sum(list_sum(embedding::DOUBLE[])), 4) AS max_sum
FROM embeddings WHERE vec_id % 3 < 2 GROUP BY ALL""",
}

# --- lists, artefacts and whole pipelines, whose probabilities are left out ------------------------

_NULL_CLONE = ", ".join(f"NULL::VARCHAR AS {c}" for c in ("junction_aa", "v_call", "j_call"))


def _clone_pipeline(name: str) -> str:
    return f"""WITH {_STRICT}, {_INDEXED}
SELECT doc_id::VARCHAR AS "ID", 'test_dataset_{name}' AS dataset, TRUE AS scored, {_NULL_CLONE}
FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'train_dataset_{name}_seq_top_' || (idx + 1), 'train_dataset_{name}', FALSE, {_CLONE} FROM indexed WHERE idx < 50000"""


SQL |= {
    "repertoire_id_list": "SELECT DISTINCT c_custkey::VARCHAR AS repertoire_id FROM customer",
    "clone_artefact": f"WITH {_RELAXED} SELECT {_CLONE}, pos, neg, round(p_value, 9) AS p_value, reason FROM stats",
    "submission_order": f"""WITH {_STRICT}, {_INDEXED}, {_BASE},
lines AS (
  SELECT 0 AS section, repertoire_id::VARCHAR AS "ID", 'test_dataset_' || model AS dataset, NULL AS rank FROM scores WHERE model IN ('size', 'words')
  UNION ALL SELECT 1, 'train_dataset_1_seq_top_' || (idx + 1), 'train_dataset_1', idx FROM indexed)
SELECT "ID", dataset, row_number() OVER (ORDER BY section, dataset, rank, "ID") - 1 AS place FROM lines""",
    "labelled_vector_folds": f"""WITH {_RANKED}
SELECT vec_id AS repertoire_id, label, rank % 5 AS fold, round(list_sum(embedding::DOUBLE[]), 4) AS total
FROM (SELECT vec_id, embedding FROM embeddings) JOIN ranked ON vec_id = repertoire_id""",
    "pipeline_blended": _clone_pipeline("8"),
}

# Stated as tables, so that an engine keeps what several parts read.
for _name in ("kmer_align_test", "clone_matrix", "importance_distinct", "importance_baseline"):
    SQL[_name] = SQL[_name].replace(" AS (", " AS MATERIALIZED (")
