"""DuckDB SQL for every catalogue query that SQL can express.

The views ``part``, ``embeddings``, ``documents``, ``labels`` ... are the
driver's parquet tables.  Derived frames are written here the same way as in
``plans.fixtures``.  MMR is unrolled step by step (one CTE per pick).
"""

from __future__ import annotations

from taxomatch.functions.text import stop_words

ORACLE: dict[str, str] = {}

_MODELS = "(VALUES ('m1', 1, 32), ('m2', 33, 64), ('principal', 1, 64)) AS ms(model, lo, hi)"


def _in(models) -> str:
    return "(" + ", ".join(f"'{m}'" for m in models) + ")"


def vec_ctes(models=("principal",)) -> str:
    return f"""
items AS (
  SELECT ms.model, e.vec_id AS doc_ord,
         'cat/' || lpad(CAST(e.vec_id // 8 AS VARCHAR), 19, '0') AS path,
         CASE WHEN e.vec_id // 4 % 2 = 0 THEN 'ALL' ELSE 'LAST' END AS cat_type,
         CAST(list_slice(e.embedding, ms.lo, ms.hi) AS DOUBLE[]) AS vec
  FROM embeddings e, {_MODELS}
  WHERE e.vec_id % 4 = 0 AND ms.model IN {_in(models)}),
queries AS (
  SELECT ms.model, CAST(e.vec_id AS VARCHAR) AS uid,
         CAST(list_slice(e.embedding, ms.lo, ms.hi) AS DOUBLE[]) AS vec
  FROM embeddings e, {_MODELS}
  WHERE e.vec_id % 4 <> 0 AND ms.model IN {_in(models)})"""


def _dist(metric: str) -> str:
    if metric == "l2":
        return ("list_sum(list_transform(range(1, len(q.vec) + 1), "
                "lambda i: (q.vec[i] - i2.vec[i]) * (q.vec[i] - i2.vec[i])))")
    return ("CASE WHEN list_dot_product(q.vec, q.vec) > 0 AND list_dot_product(i2.vec, i2.vec) > 0 "
            "THEN 1.0 - list_dot_product(q.vec, i2.vec) / "
            "(sqrt(list_dot_product(q.vec, q.vec)) * sqrt(list_dot_product(i2.vec, i2.vec))) END")


def ranked_cte(by_type: bool = True, metric: str = "l2", name: str = "ranked") -> str:
    ctype = "i2.cat_type" if by_type else "'ANY'"
    return f"""
pairs AS (
  SELECT q.model, q.uid, q.vec AS qv, i2.doc_ord, i2.path, {ctype} AS cat_type, i2.vec AS iv,
         {_dist(metric)} AS distance
  FROM queries q JOIN items i2 ON q.model = i2.model),
{name} AS (
  SELECT *, row_number() OVER (PARTITION BY uid, model, cat_type
                               ORDER BY distance ASC NULLS LAST, doc_ord) AS rank
  FROM pairs)"""


def mmr_ctes(k: int, fetch_k: int = 20, lam: float = 0.5, src: str = "ranked",
             name: str = "mmr") -> str:
    """Greedy MMR, unrolled: one CTE per pick; the result ``name`` has
    uid, model, cat_type, rank (distance order among the picks), mmr_step,
    doc_ord, path, distance."""
    g = "uid, model, cat_type"
    parts = [f"""
cand AS (
  SELECT uid, model, cat_type, rank, doc_ord, path, distance, iv,
         CASE WHEN list_dot_product(qv, qv) > 0 AND list_dot_product(iv, iv) > 0
              THEN list_dot_product(qv, iv) / (sqrt(list_dot_product(qv, qv)) * sqrt(list_dot_product(iv, iv)))
              ELSE 0.0 END AS cos_q
  FROM {src} WHERE rank <= {fetch_k}),
cc AS (
  SELECT a.uid, a.model, a.cat_type, a.rank AS ra, b.rank AS rb,
         CASE WHEN list_dot_product(a.iv, a.iv) > 0 AND list_dot_product(b.iv, b.iv) > 0
              THEN list_dot_product(a.iv, b.iv) / (sqrt(list_dot_product(a.iv, a.iv)) * sqrt(list_dot_product(b.iv, b.iv)))
              ELSE 0.0 END AS s
  FROM cand a JOIN cand b USING ({g})),
sel_1 AS (
  SELECT {g}, rank AS pick, 1 AS step FROM (
    SELECT *, row_number() OVER (PARTITION BY {g} ORDER BY cos_q DESC, rank) AS rn FROM cand)
  WHERE rn = 1)"""]
    for j in range(2, k + 1):
        parts.append(f"""
sc_{j} AS (
  SELECT c.uid, c.model, c.cat_type, c.rank, c.cos_q, max(cc.s) AS red
  FROM cand c
  JOIN sel_{j - 1} s ON s.uid = c.uid AND s.model = c.model AND s.cat_type = c.cat_type
  JOIN cc ON cc.uid = c.uid AND cc.model = c.model AND cc.cat_type = c.cat_type
         AND cc.ra = c.rank AND cc.rb = s.pick
  WHERE NOT EXISTS (SELECT 1 FROM sel_{j - 1} s2 WHERE s2.uid = c.uid AND s2.model = c.model
                    AND s2.cat_type = c.cat_type AND s2.pick = c.rank)
  GROUP BY c.uid, c.model, c.cat_type, c.rank, c.cos_q),
sel_{j} AS (
  SELECT * FROM sel_{j - 1}
  UNION ALL
  SELECT {g}, rank AS pick, {j} AS step FROM (
    SELECT *, row_number() OVER (PARTITION BY {g}
                                 ORDER BY {lam} * cos_q - {1.0 - lam} * red DESC, rank) AS rn
    FROM sc_{j})
  WHERE rn = 1)""")
    parts.append(f"""
{name} AS (
  SELECT c.uid, c.model, c.cat_type,
         row_number() OVER (PARTITION BY c.uid, c.model, c.cat_type ORDER BY c.rank) AS rank,
         s.step AS mmr_step, c.doc_ord, c.path, c.distance
  FROM sel_{k} s JOIN cand c ON s.uid = c.uid AND s.model = c.model AND s.cat_type = c.cat_type
                           AND s.pick = c.rank)""")
    return ",".join(parts)


def voted_cte(k: int, with_mmr: bool, fetch_k: int = 20) -> str:
    """All voting lists with centivotes, as CTE ``voted`` (needs ``ranked``)."""
    sim = f"SELECT uid, model, cat_type, rank, path FROM ranked WHERE rank <= {k}"
    body = sim
    pre = ""
    if with_mmr:
        pre = mmr_ctes(k, fetch_k) + ","
        body = sim + "\n  UNION ALL\n  SELECT uid, model, cat_type, rank, path FROM mmr"
    return f"""{pre}
voted AS (
  SELECT uid, model, cat_type, rank, path, CAST({100 * k} - 45 * (rank - 1) AS BIGINT) AS centivotes
  FROM ({body}))"""


_BOX = """
box AS (
  SELECT uid, path, CAST(sum(centivotes) AS BIGINT) AS centivotes, count(*) AS n_hits
  FROM voted GROUP BY uid, path)"""

_WINNER = """
winner AS (
  SELECT uid, arg_min(path, struct_pack(nv := -centivotes, p := path)) AS category,
         max(centivotes) AS centivotes, count(*) AS n_candidates
  FROM box GROUP BY uid)"""


def _q(name: str, sql: str) -> None:
    ORACLE[name] = sql.strip()


_q("knn_top1", f"WITH {vec_ctes()}, {ranked_cte(by_type=False)} "
   "SELECT uid, doc_ord, path, round(distance, 6) AS distance FROM ranked WHERE rank = 1")
_q("knn_topk", f"WITH {vec_ctes()}, {ranked_cte(by_type=False)} "
   "SELECT uid, rank, doc_ord, path, round(distance, 6) AS distance FROM ranked WHERE rank <= 10")
_q("knn_topk_by_type", f"WITH {vec_ctes()}, {ranked_cte()} "
   "SELECT uid, cat_type, rank, doc_ord, path, round(distance, 6) AS distance FROM ranked WHERE rank <= 10")
_q("knn_cosine", f"WITH {vec_ctes(('m1',))}, {ranked_cte(metric='cosine')} "
   "SELECT uid, cat_type, rank, doc_ord, path, round(distance, 6) AS distance FROM ranked WHERE rank <= 5")
_q("knn_ensemble_lists", f"WITH {vec_ctes(('m1', 'm2', 'principal'))}, {ranked_cte()} "
   "SELECT uid, model, cat_type, rank, doc_ord, path, round(distance, 6) AS distance "
   "FROM ranked WHERE rank <= 5")
_q("mmr_top3", f"WITH {vec_ctes(('m1',))}, {ranked_cte()}, {mmr_ctes(3)} "
   "SELECT uid, model, cat_type, rank, CAST(mmr_step AS BIGINT) AS mmr_step, doc_ord, path, "
   "round(distance, 6) AS distance FROM mmr")
_q("mmr_top10", f"WITH {vec_ctes()}, {ranked_cte()}, {mmr_ctes(10)} "
   "SELECT uid, model, cat_type, rank, CAST(mmr_step AS BIGINT) AS mmr_step, doc_ord, path, "
   "round(distance, 6) AS distance FROM mmr")
_q("rank_votes", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, False)} "
   "SELECT uid, cat_type, rank, path, centivotes FROM voted")
_q("vote_box", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, True)}, {_BOX} "
   "SELECT * FROM box")
_q("vote_winner", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, True)}, {_BOX}, {_WINNER} "
   "SELECT * FROM winner")
_q("vote_map", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, True)}, {_BOX} "
   "SELECT uid, string_agg(path || '=' || CAST(centivotes AS VARCHAR), ',' ORDER BY path) AS box "
   "FROM box GROUP BY uid")
_q("classify_direct", f"WITH {vec_ctes()}, {ranked_cte(by_type=False)} "
   "SELECT uid AS _id, path AS category FROM ranked WHERE rank = 1")
_q("classify_vote", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, True)}, {_BOX}, {_WINNER} "
   "SELECT uid AS _id, category FROM winner")
_q("classify_vote_sim", f"WITH {vec_ctes()}, {ranked_cte()}, {voted_cte(10, False)}, {_BOX}, {_WINNER} "
   "SELECT uid AS _id, category FROM winner")
_q("classify_ensemble", f"WITH {vec_ctes(('m1', 'm2', 'principal'))}, {ranked_cte()}, "
   f"{voted_cte(5, True)}, {_BOX}, {_WINNER} SELECT uid AS _id, category FROM winner")
ORACLE["classify_slices"] = ORACLE["classify_ensemble"]
_q("search_report", f"WITH {vec_ctes()}, {ranked_cte()}, {mmr_ctes(5)} "
   "SELECT uid, 'sim' AS method, cat_type, rank, CAST(NULL AS BIGINT) AS mmr_step, doc_ord, path, "
   "round(distance, 6) AS distance FROM ranked WHERE rank <= 5 "
   "UNION ALL SELECT uid, 'mmr' AS method, cat_type, rank, CAST(mmr_step AS BIGINT), doc_ord, path, "
   "round(distance, 6) FROM mmr")


# --------------------------------------------------------------------------- text and documents


_CAT = """
cat AS (
  SELECT path, row_number() OVER (ORDER BY path) - 1 AS cat_idx FROM (
    SELECT DISTINCT lower(p_type) || '--range/' || replace(p_name, ' ', '-') AS path FROM part))"""

_PROD = """
prod AS (
  SELECT CAST(p_partkey AS VARCHAR) AS uid,
         CASE WHEN p_partkey % 7 = 0 THEN 'XL, ' ELSE '' END
           || p_name || ', ' || p_brand || ', size ' || CAST(p_size AS VARCHAR) AS title,
         p_type || ' ' || p_name AS description,
         CASE p_partkey % 4 WHEN 1 THEN '[''' || p_type || ''',''' || p_brand || ''']'
                            WHEN 2 THEN p_type WHEN 3 THEN '[]' END AS vendor_category
  FROM part)"""


def _path_text(col: str, dd: str = " to ") -> str:
    return f"replace(replace(replace({col}, '--', '{dd}'), '-', ' '), '/', ' for ')"


_WS = " \\t\\n\\x0B\\f\\r"


def _norm_letters(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({col}), '[^a-zA-Z{_WS}]', ' ', 'g'), "
            f"'[{_WS}]+', ' ', 'g'))")


def _stop_list() -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop_words()) + "]"


def _clean_words(col: str) -> str:
    n = _norm_letters(col)
    return (f"list_filter(CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END, "
            f"lambda w: NOT list_contains({_stop_list()}, w))")


def _labels(col: str) -> str:
    inner = f"trim({col}, '[]')"
    return (f"CASE WHEN {col} IS NULL OR {col} IN ('nan', 'None') THEN []::VARCHAR[] "
            f"WHEN {col} LIKE '[%]' THEN CASE WHEN trim({inner}) = '' THEN []::VARCHAR[] ELSE "
            f"list_transform(string_split({inner}, ','), lambda x: trim(trim(x), '''')) END "
            f"ELSE [{col}] END")


def _head(col: str) -> str:
    parts = f"string_split(coalesce({col}, ''), ',')"
    return (f"CASE WHEN length({parts}[1]) <= 2 THEN array_to_string({parts}[1:2], ' ') "
            f"ELSE {parts}[1] END")


def _suffix(labels: str, joiner: str) -> str:
    return (f"CASE WHEN len({labels}) > 0 AND {labels}[1] IS NOT NULL "
            f"THEN '{joiner}' || array_to_string({labels}, ' or ') ELSE '' END")


_q("category_text", f"WITH {_CAT} SELECT cat_idx, path, {_path_text('path')} AS text FROM cat")
_q("category_docs", f"""WITH {_CAT},
d AS (
  SELECT cat_idx, path, CAST(len(string_split(path, '/')) AS BIGINT) AS level,
         {_path_text('path')} AS all_text FROM cat)
SELECT 'categories.csv:' || cat_idx || ':' || level || ':0' AS id, cat_idx, path, level,
       'ALL' AS cat_type, all_text AS text, cat_idx * 2 AS doc_ord FROM d
UNION ALL
SELECT 'categories.csv:' || cat_idx || ':' || level || ':1', cat_idx, path, level,
       'LAST', string_split(all_text, ' for ')[-1], cat_idx * 2 + 1 FROM d""")
_q("category_levels", f"""WITH {_CAT}
SELECT cat_idx, CAST(len(string_split(path, '/')) AS BIGINT) AS level,
       string_split(path, '/')[1] AS root, string_split(path, '/')[-1] AS leaf FROM cat""")
_q("doc_ids_runs", """
WITH o AS (SELECT doc_id, lang, lag(lang) OVER (ORDER BY doc_id) AS prev,
                  row_number() OVER (ORDER BY doc_id) AS pos FROM documents),
s AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM lang AND pos > 1 THEN 0 ELSE 1 END)
                  OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM o)
SELECT doc_id, lang, row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1 AS n,
       lang || ':' || CAST(row_number() OVER (PARTITION BY run ORDER BY doc_id) - 1 AS VARCHAR) AS id
FROM s""")
_q("chunk_ids", f"""WITH {_CAT},
d AS (SELECT cat_idx, CAST(len(string_split(path, '/')) AS BIGINT) AS level FROM cat)
SELECT cat_idx * 2 AS idx, 'ALL' AS cat_type, 'categories.csv:' || cat_idx || ':' || level || ':0' AS id FROM d
UNION ALL
SELECT cat_idx * 2 + 1, 'LAST', 'categories.csv:' || cat_idx || ':' || level || ':1' FROM d""")
_TT = _path_text("path", " type: ")
_q("type_extract", f"""WITH {_CAT}, t AS (SELECT cat_idx, {_TT} AS text FROM cat)
SELECT cat_idx, text,
       array_to_string(regexp_extract_all(text, ' type: (.*?) for ', 1), '  ') AS types_all,
       CASE WHEN regexp_matches(text, 'type: (.*?) for ') THEN regexp_extract(text, 'type: (.*?) for ', 1) END
         AS type_first,
       CASE WHEN regexp_matches(text, ' for (.*?) type: ') THEN regexp_extract(text, ' for (.*?) type: ', 1) END
         AS for_first
FROM t""")
_q("vendor_labels", f"""WITH {_PROD}, l AS (SELECT uid, vendor_category, {_labels('vendor_category')} AS l FROM prod)
SELECT uid, vendor_category, CAST(len(l) AS BIGINT) AS n_labels,
       array_to_string(list_transform(l, lambda x: coalesce(x, '<null>')), '|') AS labels FROM l""")
_q("product_text", f"""WITH {_PROD}
SELECT uid, {_head('title')} AS head,
       {_head('title')} || {_suffix(_labels('vendor_category'), ' categorize as ')} AS text FROM prod""")
_q("product_text_plain", f"""WITH {_PROD}
SELECT uid, {_head('title')} || {_suffix(_labels('vendor_category'), ' ')} AS text FROM prod""")
_q("product_text_words", f"""WITH {_PROD}
SELECT uid, coalesce(title, 'nan') || ' ' ||
       replace(replace(lower(coalesce(vendor_category, 'nan')), 'none', ''), 'nan', '') AS text FROM prod""")
_q("corpus_text", f"""WITH {_PROD}
SELECT uid, coalesce(title, 'nan') || ' ' || coalesce(description, 'nan') || ' ' ||
       coalesce(vendor_category, 'nan') AS text FROM prod""")
_q("clean_text", f"""
SELECT doc_id, clean FROM (SELECT doc_id, array_to_string({_clean_words('text')}, ' ') AS clean FROM documents)
WHERE length(clean) > 0""")
_q("clean_category_text", f"""WITH {_CAT}
SELECT cat_idx, array_to_string({_clean_words(_path_text('path'))}, ' ') AS clean FROM cat""")
_q("chunk_words", f"""
WITH w AS (SELECT doc_id, {_clean_words('text')} AS w FROM documents),
c AS (SELECT doc_id, unnest(range(0, len(w), 2000)) AS start, w FROM w WHERE len(w) > 0)
SELECT doc_id, CAST(start // 2000 AS BIGINT) AS chunk_no,
       CAST(len(w[start + 1 : start + 2000]) AS BIGINT) AS n_words,
       array_to_string(w[start + 1 : start + 2000], ' ') AS chunk FROM c""")
_q("tokens", f"""
WITH w AS (SELECT doc_id, {_clean_words('text')} AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, w[1] AS first_token, w[-1] AS last_token FROM w""")
_POS = "pos AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents)"
_q("batch_report", f"""WITH {_POS}
SELECT idx // 128 AS batch, count(*) AS n_rows, min(idx) AS first_idx, max(idx) AS last_idx
FROM pos GROUP BY 1""")
_q("sample_rows", f"WITH {_POS} SELECT idx, doc_id FROM pos WHERE idx % 20 = 0")
_q("slice_rows", f"WITH {_POS} SELECT idx, doc_id FROM pos WHERE idx >= 3 AND idx < 11")
_q("contains_docs", "SELECT doc_id, n_chars FROM documents WHERE contains(text, 'tion ')")


# --------------------------------------------------------------------------- collections

_q("contains_vectors", "SELECT doc_id, " + ", ".join(
    f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in "aeinorst") + " FROM documents WHERE contains(text, 'tion ')")
ORACLE["contains_indexed"] = ORACLE["contains_vectors"]
_q("store_new_counts", """
WITH kept AS (SELECT DISTINCT doc_id, text, length(text) % 2 = 0 AS even FROM documents)
SELECT CAST(0 AS BIGINT) AS run, 'nomic-embed-text_latest' AS model, count(*) FILTER (even) AS n_new FROM kept
UNION ALL SELECT 1, 'nomic-embed-text_latest', count(*) FILTER (even IS NOT TRUE) FROM kept
UNION ALL SELECT 1, 'mxbai-embed-large_v1', count(*) FROM kept""")
_q("store_batch", "SELECT DISTINCT doc_id FROM documents WHERE doc_id % 100 = 0")
_q("missing_docs", "SELECT d.doc_id, d.lang FROM documents d ANTI JOIN labels l USING (doc_id)")
_q("collection_counts", """
SELECT 'products' AS side, m.model, count(*) AS n
FROM (SELECT DISTINCT doc_id, text FROM documents), (VALUES ('nomic-embed-text_latest'), ('mxbai-embed-large_v1')) AS m(model)
GROUP BY 1, 2""")
_q("collection_names", "SELECT page_id, translate(url, ':/', '_-') AS name FROM pages")


# --------------------------------------------------------------------------- words

def _doc_words() -> str:
    return f"dw AS (SELECT doc_id, {_clean_words('text')} AS w FROM documents)"


_WORD_VECS = f"""{_doc_words()},
dvocab AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM dw) GROUP BY word
           HAVING count(*) >= 2),
dranked AS (SELECT word, row_number() OVER (ORDER BY count DESC, word) - 1 AS rank FROM dvocab),
word_vecs AS (SELECT r.word, CAST(e.embedding AS DOUBLE[]) AS vec
              FROM dranked r JOIN embeddings e ON e.vec_id = r.rank)"""

_CORPUS = f"""{_CAT}, {_PROD},
corpus_w AS (
  SELECT {_clean_words(_path_text('path'))} AS w FROM cat
  UNION ALL
  SELECT {_clean_words("coalesce(title, 'nan') || ' ' || coalesce(description, 'nan') || ' ' || coalesce(vendor_category, 'nan')")}
  FROM prod)"""

_q("vocab_counts", f"""WITH {_doc_words()}
SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM dw) GROUP BY word HAVING count(*) >= 2""")
_q("corpus_size", f"""WITH {_CORPUS}
SELECT CAST(sum((len(w) + 1999) // 2000) AS BIGINT) AS n_sentences, CAST(sum(len(w)) AS BIGINT) AS n_tokens
FROM corpus_w WHERE len(w) > 0""")
_q("vocab_overlay", f"""WITH {_CORPUS}, {_WORD_VECS},
cv AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM corpus_w) GROUP BY word)
SELECT cv.word, cv.count, wv.vec IS NOT NULL AS pretrained, round(wv.vec[1], 6) AS v1
FROM cv LEFT JOIN word_vecs wv USING (word)""")

_MEANS = f"""{_WORD_VECS},
dt AS (SELECT doc_id, unnest(w) AS word FROM dw),
known AS (SELECT dt.doc_id, wv.vec FROM dt JOIN word_vecs wv USING (word)),
kcount AS (SELECT doc_id, count(*) AS known_words FROM known GROUP BY doc_id),
kv AS (SELECT doc_id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM known),
kmean AS (SELECT doc_id, i, avg(x) AS m FROM kv GROUP BY doc_id, i),
means AS (SELECT d.doc_id, CAST(coalesce(k.known_words, 0) AS BIGINT) AS known_words,
                 coalesce((SELECT list(m ORDER BY i) FROM kmean WHERE kmean.doc_id = d.doc_id),
                          list_transform(range(64), lambda j: 0.0::DOUBLE)) AS vec
          FROM documents d LEFT JOIN kcount k USING (doc_id))"""

_q("mean_word_vectors", f"""WITH {_MEANS}
SELECT doc_id, known_words, round(vec[1], 6) AS v1, round(vec[-1], 6) AS vlast,
       round(list_sum(vec), 6) AS vsum FROM means""")
ORACLE["mean_word_vectors_dealt"] = ORACLE["mean_word_vectors"]
_q("known_words", f"""WITH {_WORD_VECS},
dp AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM dw)
SELECT doc_id, count(*) AS n_known, arg_min(word, pos) AS first_known, arg_max(word, pos) AS last_known
FROM dp SEMI JOIN word_vecs USING (word) GROUP BY doc_id""")
_q("words_direct", f"""WITH {_MEANS}, {vec_ctes()},
dq AS (SELECT CAST(doc_id AS VARCHAR) AS uid, vec FROM means),
pd AS (SELECT dq.uid, i2.path, i2.doc_ord,
              list_sum(list_transform(range(1, len(dq.vec) + 1),
                       lambda i: (dq.vec[i] - i2.vec[i]) * (dq.vec[i] - i2.vec[i]))) AS distance
       FROM dq, items i2),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY distance, doc_ord) AS rank FROM pd)
SELECT uid AS _id, path AS category FROM r WHERE rank = 1""")

_q("tfidf_direct", f"""WITH {_CAT}, {_PROD},
cd AS (SELECT cat_idx, path, {_path_text('path')} AS all_text FROM cat),
cdocs AS (
  SELECT 'c:' || CAST(cat_idx * 2 AS VARCHAR) AS id, all_text AS text, cat_idx * 2 AS doc_ord, path FROM cd
  UNION ALL
  SELECT 'c:' || CAST(cat_idx * 2 + 1 AS VARCHAR), string_split(all_text, ' for ')[-1], cat_idx * 2 + 1, path
  FROM cd),
pdocs AS (SELECT 'p:' || uid AS id,
                 {_head('title')} || {_suffix(_labels('vendor_category'), ' categorize as ')} AS text FROM prod),
alld AS (SELECT id, text FROM cdocs UNION ALL SELECT id, text FROM pdocs),
toks AS (SELECT id, unnest({_clean_words('text')}) AS term FROM alld),
tf AS (SELECT id, term, count(*) AS tf FROM toks GROUP BY id, term),
nd AS (SELECT count(*) AS n FROM alld),
dfr AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.id, tf.term, tf.tf * ln((nd.n + 1.0) / (dfr.df + 1.0)) AS w FROM tf JOIN dfr USING (term), nd),
nrm AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY id),
wn AS (SELECT w.id, w.term, w.w / nrm.norm AS w FROM w JOIN nrm USING (id) WHERE nrm.norm > 0),
score AS (SELECT p.id AS pid, c.id AS cid, sum(p.w * c.w) AS s
          FROM wn p JOIN wn c USING (term)
          WHERE p.id LIKE 'p:%' AND c.id LIKE 'c:%' GROUP BY 1, 2),
pairs AS (SELECT substr(p.id, 3) AS uid, c.doc_ord, c.path, round(1 - coalesce(s.s, 0), 10) AS distance
          FROM pdocs p CROSS JOIN cdocs c LEFT JOIN score s ON s.pid = p.id AND s.cid = c.id),
r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY distance, doc_ord) AS rank FROM pairs)
SELECT uid AS _id, path AS category FROM r WHERE rank = 1""")

ORACLE["stream_incremental"] = ORACLE["words_direct"]
ORACLE["stream_newest"] = ORACLE["words_direct"]

_PRODUCT_MEANS = f"""{_WORD_VECS}, {_CAT}, {_PROD},
cd AS (SELECT cat_idx, path, {_path_text('path')} AS all_text FROM cat),
sides AS (
  SELECT 'c' AS side, CAST(cat_idx * 2 AS VARCHAR) AS id, cat_idx * 2 AS doc_ord, path,
         {_clean_words('all_text')} AS w FROM cd
  UNION ALL
  SELECT 'c', CAST(cat_idx * 2 + 1 AS VARCHAR), cat_idx * 2 + 1, path,
         {_clean_words("string_split(all_text, ' for ')[-1]")} FROM cd
  UNION ALL
  SELECT 'p', uid, NULL, NULL, {_clean_words("coalesce(title, 'nan') || ' ' || replace(replace(lower(coalesce(vendor_category, 'nan')), 'none', ''), 'nan', '')")}
  FROM prod),
st AS (SELECT side, id, unnest(w) AS word FROM sides),
sk AS (SELECT side, id, vec FROM st JOIN word_vecs USING (word)),
su AS (SELECT side, id, unnest(range(1, len(vec) + 1)) AS i, unnest(vec) AS x FROM sk),
sm AS (SELECT side, id, i, avg(x) AS m FROM su GROUP BY side, id, i),
sl AS (SELECT side, id, list(m ORDER BY i) AS vec FROM sm GROUP BY side, id),
sv AS (SELECT s.side, s.id, s.doc_ord, s.path,
              coalesce(sl.vec, list_transform(range(64), lambda j: 0.0::DOUBLE)) AS vec
       FROM sides s LEFT JOIN sl USING (side, id))"""

_q("words_products_direct", f"""WITH {_PRODUCT_MEANS},
r AS (SELECT p.id AS uid, c.path, row_number() OVER (PARTITION BY p.id ORDER BY
        round(list_sum(list_transform(range(1, 65), lambda i: (p.vec[i] - c.vec[i]) * (p.vec[i] - c.vec[i]))), 9),
        c.doc_ord) AS rank
      FROM sv p JOIN sv c ON p.side = 'p' AND c.side = 'c')
SELECT uid AS _id, path AS category FROM r WHERE rank = 1""")
_q("overlay_trained", f"""WITH {_CORPUS}, {_WORD_VECS},
cv AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM corpus_w) GROUP BY word
       HAVING count(*) >= 2)
SELECT word, cv.count, wv.vec IS NOT NULL AS pretrained,
       CAST(CASE WHEN wv.vec IS NOT NULL THEN len(wv.vec) ELSE 1 END AS BIGINT) AS dim,
       round(CASE WHEN wv.vec IS NOT NULL THEN wv.vec[1] ELSE length(word) END, 6) AS v1
FROM cv FULL JOIN word_vecs wv USING (word)""")
_q("word2vec_train", f"""WITH {_CORPUS}
SELECT word, CAST(32 AS BIGINT) AS dim FROM (SELECT unnest(w) AS word FROM corpus_w) GROUP BY word
HAVING count(*) >= 2""")


def _pairs(w: int) -> str:
    """(center, context) of the corpus at most ``w`` tokens apart, both frequent."""
    return f"""{_CORPUS},
tk AS (SELECT row_number() OVER () AS s, w FROM corpus_w WHERE len(w) > 0),
tp AS (SELECT s, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tk),
cv AS (SELECT word, count(*) AS count FROM tp GROUP BY word HAVING count(*) >= 2),
tf AS (SELECT tp.* FROM tp JOIN cv USING (word)),
pairs AS (SELECT a.word AS center, b.word AS context FROM tf a JOIN tf b
          ON a.s = b.s AND b.i BETWEEN a.i - {w} AND a.i + {w} AND a.i <> b.i)"""


_q("word2vec_start", f"""WITH {_WORD_VECS}, dwords AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM
    (SELECT {_clean_words('text')} AS w FROM documents)) GROUP BY word HAVING count(*) >= 2)
SELECT word, count, wv.vec IS NOT NULL AS started, CAST(64 AS BIGINT) AS dim, round(CAST(wv.vec[1] AS FLOAT)::DOUBLE, 5) AS v1,
       round(CAST(wv.vec[-1] AS FLOAT)::DOUBLE, 5) AS vlast
FROM dwords LEFT JOIN word_vecs wv USING (word)""")
_q("word2vec_continue", f"""WITH {_CORPUS}, {_WORD_VECS},
cv AS (SELECT word, count(*) AS count FROM (SELECT unnest(w) AS word FROM corpus_w) GROUP BY word HAVING count(*) >= 2),
n AS (SELECT count(*) AS n FROM word_vecs)
SELECT word, count, row_number() OVER (ORDER BY word) <= n AS started, CAST(64 AS BIGINT) AS dim,
       CASE WHEN row_number() OVER (ORDER BY word) <= n THEN true END AS moved FROM cv, n""")
_q("word2vec_losses", f"""WITH {_pairs(5)}, n AS (SELECT count(*) AS n_pairs FROM pairs)
SELECT unnest([1, 2, 3])::BIGINT AS epoch, n_pairs, true AS lower FROM n""")


# --------------------------------------------------------------------------- physical forms, column functions, files

ORACLE["knn_blocks"] = ORACLE["knn_waves"] = ORACLE["knn_pruned"] = ORACLE["knn_topk_by_type"]
ORACLE["knn_pruned_cosine"] = ORACLE["knn_cosine"]
ORACLE["mmr_blocks"] = ORACLE["mmr_pruned"] = ORACLE["mmr_top3"]
_q("knn_nulls", f"WITH {vec_ctes()}, {ranked_cte()}, "
   "nn AS (SELECT *, row_number() OVER (PARTITION BY uid, cat_type ORDER BY distance, doc_ord) AS own FROM ranked "
   "WHERE CAST(uid AS BIGINT) % 7 <> 0 AND doc_ord % 12 <> 0) "
   "SELECT uid, cat_type, own AS rank, doc_ord, CASE WHEN doc_ord % 5 <> 0 THEN path END AS path, "
   "round(distance, 6) AS distance FROM nn WHERE own <= 5")
_q("vector_distances", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.vec_id, a.v AS a, b.v AS b FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum(list_transform(range(1, len(a) + 1), lambda i: (a[i] - b[i]) * (a[i] - b[i]))), 6) AS l2,
       round(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))), 6) AS cos
FROM p""")
_q("vector_shapes", "SELECT count(*) AS n, min(len(embedding)) AS min_dim, max(len(embedding)) AS max_dim FROM embeddings")
_q("category_file", f"WITH {_CAT} SELECT cat_idx, path FROM cat")
_q("product_file", f"WITH {_PROD} SELECT uid, title, description, vendor_category, p_brand AS vendor "
   "FROM prod JOIN part ON uid = CAST(p_partkey AS VARCHAR)")
_q("product_file_split", "SELECT CAST(doc_id AS VARCHAR) AS uid, source AS title, length(nullif(text, '')) AS n_chars, "
   "md5(nullif(text, '')) AS digest FROM documents")
_q("product_docs", f"""WITH {_PROD}
SELECT uid, row_number() OVER (ORDER BY uid) - 1 AS prod_idx, 'products.csv' AS source,
       {_head('title')} || {_suffix(_labels('vendor_category'), ' categorize as ')} AS text FROM prod""")
ORACLE["answers_file"] = ORACLE["classify_direct"]
_q("answers_parts", f"""WITH a AS ({ORACLE['classify_direct']}),
n AS (SELECT *, row_number() OVER (ORDER BY _id) - 1 AS idx, count(*) OVER () AS total FROM a)
SELECT idx // 100 AS part, CASE WHEN idx // 100 = 0 THEN '[' ELSE ',' END
       || string_agg('{{"_id":"' || _id || '","category":"' || category || '"}}', ',' ORDER BY idx)
       || CASE WHEN max(idx) = max(total) - 1 THEN ']' ELSE '' END AS json
FROM n GROUP BY idx // 100""")
_q("word_vectors_file", f"""WITH {_WORD_VECS}
SELECT word, len(vec) AS dim, round(vec[1], 6) AS v1, round(vec[-1], 6) AS vlast FROM word_vecs""")
_q("word_vectors_counts", f"""WITH {_WORD_VECS}
SELECT count(*) AS n_lines, count(*) FILTER (length(word) % 5 <> 0) AS n_words, CAST(0 AS BIGINT) AS n_headers,
       count(*) FILTER (length(word) % 5 = 0) AS n_bad FROM word_vecs""")
_q("store_drops", """
WITH kept AS (SELECT DISTINCT doc_id, text FROM documents)
SELECT 'products' AS side, 'mxbai-embed-large_v1' AS model, count(*) AS n FROM kept
UNION ALL SELECT 'categories', 'mxbai-embed-large_v1', count(*) FROM kept WHERE length(text) % 3 = 0""")


def _letters(col: str) -> str:
    return "[" + ", ".join(f"CAST(length({col}) - length(replace({col}, '{c}', '')) AS DOUBLE)" for c in "aeinorst") + "]"


_LETTER_ITEMS = f"""{_CAT}, {_PROD},
cd AS (SELECT cat_idx, path, {_path_text('path')} AS all_text FROM cat),
li AS (SELECT cat_idx * 2 AS doc_ord, path, 'ALL' AS cat_type, {_letters('all_text')} AS vec FROM cd
       UNION ALL
       SELECT cat_idx * 2 + 1, path, 'LAST', {_letters("string_split(all_text, ' for ')[-1]")} FROM cd)"""


def _letter_hits(text: str, by_type: bool) -> str:
    part = "p.uid, i.cat_type" if by_type else "p.uid"
    return f"""WITH {_LETTER_ITEMS},
lq AS (SELECT uid, {text} AS text FROM prod), lp AS (SELECT uid, {_letters('text')} AS vec FROM lq),
lh AS (SELECT p.uid, i.cat_type, i.doc_ord, i.path,
         list_sum(list_transform(range(1, 9), lambda k: (p.vec[k] - i.vec[k]) * (p.vec[k] - i.vec[k]))) AS distance
       FROM lp p CROSS JOIN li i),
lr AS (SELECT *, row_number() OVER (PARTITION BY {part.replace('p.', '').replace('i.', '')}
                                    ORDER BY distance, doc_ord) AS rank FROM lh)"""


_q("texts_search", _letter_hits("title", True) + """
SELECT uid, cat_type, rank, doc_ord, path, round(distance, 6) AS distance FROM lr WHERE rank <= 3""")
_q("model_search", _letter_hits("coalesce(vendor_category, '')", True) + """
SELECT uid, cat_type, rank, doc_ord, path, round(distance, 6) AS distance FROM lr WHERE rank <= 3""")
_q("classify_files", _letter_hits(f"{_head('title')} || {_suffix(_labels('vendor_category'), ' categorize as ')}", False)
   + """
SELECT uid AS _id, path AS category FROM lr WHERE rank = 1""")
