"""The views of ``views`` as SQL text, for the independent check in another engine."""

from __future__ import annotations

SPLIT_DRAW = "CAST(CAST('0x' || substr(md5('42:' || {key}), 1, 15) AS BIGINT) AS DOUBLE) / CAST(1152921504606846976 AS DOUBLE)"

VIEWS = {
    "samples_fx": """
        SELECT o_orderkey AS row_id,
          CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS TINYINT) AS y1,
          CAST(CASE WHEN o_orderpriority = '1-URGENT' AND (o_orderstatus = 'F' OR o_orderkey % 97 = 0) THEN 1 ELSE 0 END AS TINYINT) AS y2,
          lpad(CAST(o_custkey AS VARCHAR), 16, '0') AS entity_id,
          CAST(o_custkey % 7 AS INTEGER) AS c4, o_orderkey + 100000 AS c0
        FROM orders""",
    "tokens_fx": """
        SELECT l_orderkey AS row_id, CAST(0 AS TINYINT) AS src, '205' AS field, CAST(l_partkey AS VARCHAR) AS fid, CAST(1 AS FLOAT) AS val FROM lineitem
        UNION ALL SELECT l_orderkey, CAST(0 AS TINYINT), '853', CAST(l_suppkey AS VARCHAR), CAST(l_quantity / 10 AS FLOAT) FROM lineitem
        UNION ALL SELECT l_orderkey, CAST(0 AS TINYINT), '508', l_returnflag || l_linestatus, CAST(l_discount AS FLOAT) FROM lineitem
        UNION ALL SELECT o_orderkey, CAST(0 AS TINYINT), '301', o_orderpriority, CAST(1 AS FLOAT) FROM orders
        UNION ALL SELECT o_orderkey, CAST(1 AS TINYINT), '121', c_mktsegment, CAST(1 AS FLOAT) FROM orders JOIN customer ON o_custkey = c_custkey
        UNION ALL SELECT o_orderkey, CAST(1 AS TINYINT), '129', CAST(c_nationkey AS VARCHAR), CAST(c_acctbal / 1000 AS FLOAT) FROM orders JOIN customer ON o_custkey = c_custkey""",
    "split_fx": f"""
        SELECT *, CASE WHEN {SPLIT_DRAW.format(key='entity_id')} < CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM samples_fx""",
    "split_tokens_fx": """
        SELECT t.*, s.split FROM tokens_fx t JOIN split_fx s ON t.row_id = s.row_id""",
    "words_fx": """
        SELECT doc_id AS row_id, CAST(0 AS TINYINT) AS src, lang AS field, fid, CAST(count(*) AS FLOAT) AS val
        FROM (SELECT doc_id, lang, unnest(string_split(text, ' ')) AS fid FROM documents)
        WHERE fid <> '' GROUP BY doc_id, lang, fid""",
    "split_words_fx": f"""
        SELECT w.*, CASE WHEN {SPLIT_DRAW.format(key='CAST(row_id AS VARCHAR)')} < CAST(0.8 AS DOUBLE) THEN 'train' ELSE 'valid' END AS split FROM words_fx w""",
    "scored_fx": """
        SELECT s.row_id, s.entity_id, s.y1 AS y_ctr, s.y2 AS y_cvr, CAST(s.y1 * s.y2 AS TINYINT) AS y_ctcvr, s.y1 AS click_mask,
          (o_totalprice - 150000) / 100000 AS ctr_logit, (c_acctbal - 4500) / 4000 AS cvr_logit
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN samples_fx s ON s.row_id = o_orderkey""",
    "evals_fx": """
        SELECT user_id AS run_id, event_id AS step,
          CAST(0.60 AS DOUBLE) + value / 2000 AS auc_ctcvr,
          CAST(0.65 AS DOUBLE) + (event_id % 50) / CAST(1000 AS DOUBLE) AS auc_ctr,
          CAST(0.60 AS DOUBLE) + (event_id % 30) / CAST(1000 AS DOUBLE) AS auc_cvr,
          value / 100 - 0.5 AS cos_all,
          CASE WHEN event_id % 5 <> 0 THEN (event_id % 21 - 10) / CAST(10 AS DOUBLE) END AS cos_dense,
          CASE WHEN event_id % 3 <> 0 THEN value / 200 - 0.2 END AS cos_sparse,
          CAST(1.0 AS DOUBLE) + event_id % 7 AS norm_1,
          CASE WHEN event_type <> 'error' THEN CAST(0.5 AS DOUBLE) + event_id % 11 END AS norm_2,
          event_type
        FROM events""",
    "gates_fx": """
        SELECT row_id, task, list_transform(w_raw, lambda x: x / list_sum(w_raw)) AS w FROM (
          SELECT vec_id AS row_id, CASE WHEN label % 2 = 0 THEN 'ctr' ELSE 'cvr' END AS task,
            list_transform([0, 1, 2, 3], lambda e: list_sum(list_transform(list_filter(embedding, lambda x, j: (j - 1) % 4 = e), lambda x: exp(CAST(x AS DOUBLE) * 8)))) AS w_raw
          FROM embeddings)""",
    "spec_fx": """
        SELECT CAST(src AS TINYINT) AS src, field, name, encoding, multi_hot, use_value, vocab_tokens, hash_bucket, head_rows, total_rows, k
        FROM (VALUES
          (0, '205', 'f0_205', 'hash', false, false, NULL, 8388608, 0, 8388610, 1),
          (0, '853', 'f0_853', 'hybrid', true, true, 40, 64, 43, 107, 3),
          (0, '508', 'f0_508', 'vocab', false, true, 4, NULL, 7, 7, 1),
          (0, '301', 'f0_301', 'vocab', true, false, 5, NULL, 8, 8, 2),
          (1, '121', 'f1_121', 'vocab', false, false, 3, NULL, 6, 6, 1),
          (1, '129', 'f1_129', 'hybrid', false, true, 10, 16, 13, 29, 1)
        ) v(src, field, name, encoding, multi_hot, use_value, vocab_tokens, hash_bucket, head_rows, total_rows, k)""",
    "ranks_fx": """
        SELECT src, field, fid, rnk - 1 AS rank FROM (
          SELECT src, field, fid, row_number() OVER (PARTITION BY src, field ORDER BY count(*) DESC, fid) AS rnk
          FROM split_tokens_fx WHERE split = 'train' GROUP BY src, field, fid)""",
    "bags_fx": """
        SELECT t.row_id, t.src, t.field, t.fid, max(CAST(t.val AS DOUBLE)) AS val, any_value(r.rank) AS rank, count(*) AS copies
        FROM tokens_fx t LEFT JOIN ranks_fx r ON t.src = r.src AND t.field = r.field AND t.fid = r.fid
        GROUP BY t.row_id, t.src, t.field, t.fid""",
    "informed_fx": """
        SELECT *, CASE WHEN NOT multi_hot THEN 'single'
            WHEN use_value AND (non_one >= 0.05 OR std >= 0.001) THEN 'auto_mix' ELSE 'topk_by_freq' END AS rule,
          row_number() OVER (PARTITION BY row_id, src, field ORDER BY val DESC, fid) AS pv,
          row_number() OVER (PARTITION BY row_id, src, field ORDER BY coalesce(rank, 1000000000), fid) AS pf,
          row_number() OVER (PARTITION BY row_id, src, field ORDER BY val DESC, coalesce(rank, 1000000000), fid) AS ps
        FROM (SELECT b.*, s.name, s.encoding, s.multi_hot, s.use_value, s.vocab_tokens, s.hash_bucket, s.head_rows, s.total_rows, s.k,
            count(*) OVER w AS distinct_tokens, sum(copies) OVER w AS raw_tokens,
            avg(CASE WHEN val <> 1 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER w AS non_one, stddev_pop(val) OVER w AS std
          FROM bags_fx b JOIN spec_fx s ON b.src = s.src AND b.field = s.field
          WINDOW w AS (PARTITION BY b.row_id, b.src, b.field))""",
    "selected_fx": """
        SELECT * FROM (
          SELECT *, CASE rule WHEN 'single' THEN ps WHEN 'topk_by_freq' THEN pf
              ELSE CASE WHEN pv <= 2 THEN pv ELSE 2 + row_number() OVER (PARTITION BY row_id, src, field, pv <= 2 ORDER BY coalesce(rank, 1000000000), fid) END END AS pos
          FROM informed_fx) WHERE pos <= k""",
    "encoded_fx": """
        SELECT *, CASE encoding WHEN 'hash' THEN 2 + h % hash_bucket
            WHEN 'vocab' THEN CASE WHEN rank < vocab_tokens THEN 3 + rank ELSE 2 END
            ELSE CASE WHEN rank < vocab_tokens THEN 3 + rank ELSE head_rows + h % hash_bucket END END AS idx,
          encoding = 'vocab' AND NOT coalesce(rank < vocab_tokens, false) AS is_oov,
          encoding = 'hybrid' AND NOT coalesce(rank < vocab_tokens, false) AS is_tail
        FROM (SELECT *, CAST('0x' || substr(md5('17:' || src || ':' || field || ':' || fid), 1, 15) AS BIGINT) AS h FROM selected_fx)""",
}

NEEDS = {
    "split_fx": ["samples_fx"],
    "split_tokens_fx": ["tokens_fx", "split_fx"],
    "split_words_fx": ["words_fx"],
    "scored_fx": ["samples_fx"],
    "ranks_fx": ["split_tokens_fx"],
    "bags_fx": ["tokens_fx", "ranks_fx"],
    "informed_fx": ["bags_fx", "spec_fx"],
    "selected_fx": ["informed_fx"],
    "encoded_fx": ["selected_fx"],
}


def _closure(names: list[str], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _closure(NEEDS.get(name, []), seen)
            seen.append(name)
    return seen


def with_views(body: str) -> str:
    """``body`` preceded by the definitions of every view it mentions."""
    used = [name for name in VIEWS if name in body]
    parts = [f"{name} AS ({VIEWS[name].strip()})" for name in _closure(used, [])]
    text = body.strip()
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join([*parts, text[5:]]) if parts else text
    return ("WITH " + ", ".join(parts) + " " + text) if parts else text
