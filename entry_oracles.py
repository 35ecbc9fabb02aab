"""DuckDB statements that state, in plain SQL, what each registered query returns."""

from __future__ import annotations

WINDOW = 3
VOCAB = 1000
DIM = 500
SMALL = 64
CUT_RANK = 24

# Lines, and plain tokens (empty ones dropped).
LINES = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS line_no
  FROM documents)"""

RAW = (
    LINES
    + """,
raw AS (
  SELECT doc_id, line_no, unnest(string_split(lower(line), ' ')) AS token,
         (generate_subscripts(string_split(lower(line), ' '), 1) - 1)::INT AS pos
  FROM lines)"""
)

PLAIN = (
    RAW
    + """,
words AS (SELECT doc_id, line_no, pos, token AS term FROM raw WHERE token <> ''),
vocab AS (
  SELECT term, cnt, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS idx
  FROM (SELECT term, count(*)::BIGINT AS cnt FROM words GROUP BY term HAVING count(*) >= 10))"""
)

PLAIN_PAIRS = (
    PLAIN
    + f""",
kept AS (
  SELECT doc_id, line_no, idx,
         row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS r
  FROM words JOIN vocab USING (term)),
pairs AS (
  SELECT least(x.idx, y.idx) AS a, greatest(x.idx, y.idx) AS b, count(*)::BIGINT AS n
  FROM kept x JOIN kept y
    ON x.doc_id = y.doc_id AND x.line_no = y.line_no AND y.r - x.r BETWEEN 1 AND {WINDOW}
  GROUP BY 1, 2)"""
)

PLAIN_PPMI = (
    PLAIN_PAIRS
    + """,
wt AS (SELECT count(*)::DOUBLE AS t FROM words),
pt AS (SELECT sum(n)::DOUBLE AS t FROM pairs),
ppmi AS (
  SELECT a AS min_idx, b AS max_idx,
         ln((n / pt.t) / ((va.cnt / wt.t) * (vb.cnt / wt.t))) AS val
  FROM pairs JOIN vocab va ON va.idx = a JOIN vocab vb ON vb.idx = b, wt, pt
  WHERE (n / pt.t) / ((va.cnt / wt.t) * (vb.cnt / wt.t)) > 1)"""
)

# Stand-in tagged tokens.
TOKENS = (
    RAW
    + """,
lemmas AS (
  SELECT doc_id, line_no, pos, regexp_replace(token, '[^a-z]', '', 'g') AS w FROM raw),
tagged AS (
  SELECT doc_id, line_no, pos, w,
         CASE WHEN w <> '' THEN
           ['nn','vb','jj','rb','in','dt'][1 + (ascii(w) + length(w)) % 6] END AS t
  FROM lemmas),
tokens AS (
  SELECT doc_id, line_no, pos,
         CASE WHEN t <> 'dt' THEN w END AS lemma, CASE WHEN t <> 'dt' THEN t END AS tag,
         CASE WHEN t <> 'dt' THEN w || '-' || t END AS term
  FROM tagged),
valid AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY pos) AS r
  FROM tokens WHERE term IS NOT NULL)"""
)

TAGGED_VOCAB = (
    TOKENS
    + f""",
counts AS (SELECT term, count(*)::BIGINT AS cnt FROM valid GROUP BY term),
vocab AS (
  SELECT term, cnt, (row_number() OVER (ORDER BY cnt DESC, term DESC) - 1)::BIGINT AS idx
  FROM counts QUALIFY idx < {VOCAB}),
wt AS (SELECT count(*)::DOUBLE AS t FROM valid)"""
)

TAGGED_PAIRS = (
    TAGGED_VOCAB
    + f""",
pairs AS (
  SELECT least(x.term, y.term) AS a, greatest(x.term, y.term) AS b, count(*)::BIGINT AS n
  FROM valid x JOIN valid y
    ON x.doc_id = y.doc_id AND x.line_no = y.line_no AND y.r - x.r BETWEEN 1 AND {WINDOW}
  GROUP BY 1, 2),
pt AS (SELECT sum(n)::DOUBLE AS t FROM pairs)"""
)


def word_matrix(dim: int) -> str:
    """Coordinate entries of the word PPMI matrix; a self pair appears twice."""
    return (
        TAGGED_PAIRS
        + f""",
positive AS (
  SELECT va.idx AS i, vb.idx AS j,
         ln((n / pt.t) / ((va.cnt / wt.t) * (vb.cnt / wt.t))) AS val
  FROM pairs JOIN vocab va ON va.term = a JOIN vocab vb ON vb.term = b, wt, pt
  WHERE (n / pt.t) / ((va.cnt / wt.t) * (vb.cnt / wt.t)) > 1),
coo AS (
  SELECT i AS col, j AS "row", val FROM positive WHERE j < {dim}
  UNION ALL
  SELECT j AS col, i AS "row", val FROM positive WHERE i < {dim}),
mat AS (SELECT "row", col, count(*)::DOUBLE AS val FROM coo GROUP BY 1, 2)"""
    )


EDGES = (
    TAGGED_VOCAB
    + """,
near AS (
  SELECT x.doc_id, x.line_no, x.pos AS i, y.pos AS j, x.t || y.t AS tt
  FROM tagged x JOIN tagged y
    ON x.doc_id = y.doc_id AND x.line_no = y.line_no AND y.pos - x.pos BETWEEN 1 AND 4),
edges AS (
  SELECT doc_id, line_no,
         CASE tt WHEN 'jjnn' THEN 'amod' WHEN 'nnvb' THEN 'nsubj' WHEN 'vbnn' THEN 'dobj'
                 WHEN 'innn' THEN 'pobj' WHEN 'vbjj' THEN 'acomp' END AS label,
         CASE WHEN tt IN ('jjnn', 'nnvb') THEN j ELSE i END AS gov,
         CASE WHEN tt IN ('jjnn', 'nnvb') THEN i ELSE j END AS dep
  FROM near WHERE tt IN ('jjnn', 'nnvb', 'vbnn', 'innn', 'vbjj')),
instances AS (
  SELECT e.*, g.r AS gr, d.r AS dr,
         CASE WHEN label IN ('amod', 'nsubj') THEN d.term ELSE g.term END AS w1,
         CASE WHEN label IN ('amod', 'nsubj') THEN g.term ELSE d.term END AS w2
  FROM edges e
  JOIN valid g ON g.doc_id = e.doc_id AND g.line_no = e.line_no AND g.pos = e.gov
  JOIN valid d ON d.doc_id = e.doc_id AND d.line_no = e.line_no AND d.pos = e.dep)"""
)


def phrase_vocab(threshold: int) -> str:
    return (
        EDGES
        + f""",
pcounts AS (
  SELECT label, w1, w2, count(*)::BIGINT AS cnt FROM instances
  WHERE w1 IN (SELECT term FROM vocab) AND w2 IN (SELECT term FROM vocab)
  GROUP BY 1, 2, 3 HAVING count(*) >= {threshold}),
pvocab AS (
  SELECT label, w1, w2, w1 || '+' || w2 AS phrase, cnt,
         (row_number() OVER (PARTITION BY label ORDER BY w1 || '+' || w2) - 1)::BIGINT AS idx
  FROM pcounts)"""
    )


def contexts(threshold: int) -> str:
    """Context words by places in the sequence of valid terms: lo < hi are the phrase's ends."""
    return (
        phrase_vocab(threshold)
        + f""",
ends AS (SELECT *, least(gr, dr) AS lo, greatest(gr, dr) AS hi FROM instances),
ctx AS (
  SELECT e.label, e.w1, e.w2, v.term AS ctx, count(*)::BIGINT AS n
  FROM ends e JOIN valid v ON v.doc_id = e.doc_id AND v.line_no = e.line_no
   AND v.r BETWEEN lo - {WINDOW} AND hi + {WINDOW} AND v.r <> lo AND v.r <> hi
   AND (v.r < lo OR v.r > hi OR v.r - lo <= {WINDOW} OR hi - v.r <= {WINDOW})
  GROUP BY 1, 2, 3, 4)"""
    )


def phrase_matrix(threshold: int, dim: int) -> str:
    return (
        contexts(threshold)
        + f""",
ptot AS (SELECT label, count(*)::DOUBLE AS t FROM instances GROUP BY 1),
ctot AS (SELECT label, sum(n)::DOUBLE AS t FROM ctx GROUP BY 1),
pcoo AS (
  SELECT c.label, p.idx AS col, v.idx AS "row",
         ln((n / ctot.t) / ((p.cnt / ptot.t) * (v.cnt / wt.t))) AS val
  FROM ctx c JOIN pvocab p USING (label, w1, w2) JOIN vocab v ON v.term = c.ctx
  JOIN ptot USING (label) JOIN ctot USING (label), wt
  WHERE v.idx < {dim} AND (n / ctot.t) / ((p.cnt / ptot.t) * (v.cnt / wt.t)) > 1)"""
    )


def with_(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{select}"


# The four tokens after each one on its line; of a phrase's two words the earlier comes first.
PHRASES_AHEAD = """
SELECT doc_id, line_no, label, term AS w1, other AS w2
FROM (
  SELECT doc_id, line_no, term, other,
         CASE t || u WHEN 'jjnn' THEN 'amod' WHEN 'nnvb' THEN 'nsubj' WHEN 'vbnn' THEN 'dobj'
                     WHEN 'innn' THEN 'pobj' WHEN 'vbjj' THEN 'acomp' END AS label
  FROM (
    SELECT doc_id, line_no, tag AS t, term,
           unnest([lead(tag, 1) OVER w, lead(tag, 2) OVER w, lead(tag, 3) OVER w, lead(tag, 4) OVER w]) AS u,
           unnest([lead(term, 1) OVER w, lead(term, 2) OVER w, lead(term, 3) OVER w, lead(term, 4) OVER w]) AS other
    FROM tokens WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)))
WHERE label IS NOT NULL
"""

ORACLES: dict[str, str] = {
    "tokens_plain": with_(PLAIN, "SELECT doc_id, line_no, pos, term FROM words"),
    "tokens_tagged": with_(
        TOKENS, "SELECT doc_id, line_no, pos, lemma, tag, term FROM tokens"
    ),
    "deps_decoded": with_(EDGES, "SELECT doc_id, line_no, label, gov, dep FROM edges"),
    "word_counts": with_(TAGGED_VOCAB, "SELECT term, cnt FROM counts"),
    "corpus_totals": with_(
        contexts(20)
        + f""",
plain AS (SELECT doc_id, line_no, token AS term, pos FROM raw WHERE token <> ''),
pv AS (SELECT term FROM plain GROUP BY term HAVING count(*) >= 10),
pk AS (
  SELECT doc_id, line_no, count(*) AS m FROM plain JOIN pv USING (term) GROUP BY 1, 2),
tk AS (SELECT doc_id, line_no, count(*) AS m FROM valid GROUP BY 1, 2)""",
        """
SELECT 'plain_words' AS kind, count(*)::BIGINT AS total FROM plain
UNION ALL SELECT 'tagged_words', count(*)::BIGINT FROM valid
UNION ALL SELECT 'plain_pairs',
  sum(greatest(m-1,0) + greatest(m-2,0) + greatest(m-3,0))::BIGINT FROM pk
UNION ALL SELECT 'tagged_pairs',
  sum(greatest(m-1,0) + greatest(m-2,0) + greatest(m-3,0))::BIGINT FROM tk
UNION ALL SELECT 'phrases_' || label, count(*)::BIGINT FROM instances GROUP BY label
UNION ALL SELECT 'contexts_' || label, sum(n)::BIGINT FROM ctx GROUP BY label""",
    ),
    "vocab_lex_index": with_(PLAIN, "SELECT term, cnt, idx FROM vocab"),
    "vocab_freq_topk": with_(TAGGED_VOCAB, "SELECT term, cnt, idx FROM vocab"),
    "pairs_plain": with_(
        PLAIN_PAIRS,
        """SELECT va.term AS a, vb.term AS b, n
FROM pairs JOIN vocab va ON va.idx = a JOIN vocab vb ON vb.idx = b""",
    ),
    "pairs_tagged": with_(TAGGED_PAIRS, "SELECT a, b, n FROM pairs"),
    "ppmi_plain": with_(
        PLAIN_PPMI, "SELECT min_idx, max_idx, round(val, 6) AS val FROM ppmi"
    ),
    "ppmi_words": with_(
        word_matrix(DIM), 'SELECT col, "row", round(val, 6) AS val FROM coo'
    ),
    "phrase_instances": with_(TOKENS, PHRASES_AHEAD),
    "phrase_counts": with_(phrase_vocab(20), "SELECT label, w1, w2, cnt FROM pcounts"),
    "phrase_vocab_index": with_(
        phrase_vocab(5), "SELECT label, w1, w2, phrase, cnt, idx FROM pvocab"
    ),
    "phrase_contexts": with_(contexts(20), "SELECT label, w1, w2, ctx, n FROM ctx"),
    "ppmi_phrases": with_(
        phrase_matrix(5, DIM), 'SELECT label, col, "row", round(val, 6) AS val FROM pcoo'
    ),
}


COSINE = """
norms AS (SELECT col, sqrt(sum(val * val)) AS norm FROM mat GROUP BY col)"""

# Columns of the small matrix with phrases, and the cosine of phrase and word columns. At full
# rank the dense vectors keep all inner products of the sparse columns.
PHRASE_SPACE = (
    phrase_matrix(5, SMALL)
    + word_matrix(SMALL)[len(TAGGED_VOCAB) :]
    + """,
pmat AS (SELECT label, col, "row", count(*)::DOUBLE AS val FROM pcoo GROUP BY 1, 2, 3),
pnorm AS (SELECT label, col, sum(val * val) AS norm2 FROM pmat GROUP BY 1, 2),
wnorm AS (SELECT col, sqrt(sum(val * val)) AS norm FROM mat GROUP BY 1),
oriented AS (
  SELECT label, idx AS col, w1, w2,
         CASE WHEN label = 'nsubj' THEN w2 ELSE w1 END AS word,
         CASE WHEN label = 'nsubj' THEN w1 ELSE w2 END AS arg
  FROM pvocab),
pw AS (
  SELECT p.label, p.col AS col, m.col AS word_idx, sum(p.val * m.val) AS dot
  FROM pmat p JOIN mat m ON m."row" = p."row" GROUP BY 1, 2, 3)"""
)

ORACLES.update(
    {
        "sparse_vectors": with_(
            PLAIN_PPMI
            + """,
cells AS (
  SELECT min_idx AS idx, max_idx AS ctx, val FROM ppmi
  UNION ALL SELECT max_idx, min_idx, val FROM ppmi WHERE min_idx <> max_idx)""",
            """SELECT idx, ctx // 1024 AS segment,
       (row_number() OVER (PARTITION BY idx, ctx // 1024 ORDER BY ctx) - 1)::BIGINT AS place,
       ctx, round(val, 6) AS val FROM cells""",
        ),
        "coo_binary": with_(word_matrix(DIM), 'SELECT "row", col, val FROM mat'),
        "coo_symmetric": with_(
            PLAIN_PPMI,
            """SELECT "row", col, count(*)::DOUBLE AS val FROM (
  SELECT min_idx AS "row", max_idx AS col FROM ppmi
  UNION ALL SELECT max_idx, min_idx FROM ppmi WHERE min_idx <> max_idx) GROUP BY 1, 2""",
        ),
        "matrix_stats": with_(
            word_matrix(DIM),
            """SELECT (max("row") + 1)::BIGINT AS n_rows, (max(col) + 1)::BIGINT AS n_cols,
       count(*)::BIGINT AS nnz FROM mat""",
        ),
        "word_cosine": with_(
            EDGES
            + """,
asked AS (
  SELECT DISTINCT w1, w2 FROM (
    SELECT label, w1, w2 FROM instances GROUP BY 1, 2, 3 HAVING count(*) >= 5))"""
            + word_matrix(DIM)[len(TAGGED_VOCAB) :]
            + ","
            + COSINE
            + """,
coded AS (
  SELECT w1, w2, x.idx AS i, y.idx AS j
  FROM asked LEFT JOIN vocab x ON x.term = w1 LEFT JOIN vocab y ON y.term = w2),
dots AS (
  SELECT i, j, sum(a.val * b.val) AS dot
  FROM (SELECT DISTINCT i, j FROM coded)
  JOIN mat a ON a.col = i JOIN mat b ON b.col = j AND b."row" = a."row" GROUP BY 1, 2)""",
            """SELECT w1, w2, CASE WHEN i IS NULL OR j IS NULL THEN -1.0
       ELSE round(coalesce(dot, 0) / x.norm / y.norm, 6) END AS cosine
FROM coded LEFT JOIN dots USING (i, j)
LEFT JOIN norms x ON x.col = i LEFT JOIN norms y ON y.col = j""",
        ),
        "dense_cosine": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)
SELECT a.vec_id, round(list_cosine_similarity(a.e, b.e), 6) AS cosine,
       round(abs(list_cosine_similarity(a.e, b.e)), 6) AS absolute
FROM v a JOIN v b ON b.vec_id = a.vec_id + 1""",
        "normalise_vectors": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm FROM v)
SELECT vec_id, (generate_subscripts(e, 1) - 1)::BIGINT AS place,
       round(unnest(e) / norm, 6) AS val FROM n WHERE norm > 0""",
        "randomized_svd": with_(word_matrix(SMALL), 'SELECT "row", col, val FROM mat'),
        "randomized_eigen": with_(
            word_matrix(SMALL), f'SELECT "row", col, val FROM mat WHERE col < {SMALL}'
        ),
        "randomized_pca": with_(word_matrix(SMALL), 'SELECT "row", col, val FROM mat'),
        "word_vectors": with_(
            word_matrix(SMALL) + "," + COSINE,
            """SELECT x.col AS idx, round(coalesce(dot, 0) / x.norm / y.norm, 6) AS next_cosine
FROM norms x JOIN norms y ON y.col = x.col + 1
LEFT JOIN (
  SELECT a.col, sum(a.val * b.val) AS dot
  FROM mat a JOIN mat b ON b.col = a.col + 1 AND b."row" = a."row" GROUP BY 1) d
  ON d.col = x.col""",
        ),
        "phrase_vectors": with_(
            PHRASE_SPACE,
            """SELECT o.label, o.col AS idx, round(n.norm2, 6) AS norm2,
       round(coalesce(d.dot, 0) / w.norm, 6) AS along_modifier
FROM oriented o JOIN pnorm n ON n.label = o.label AND n.col = o.col
JOIN vocab v ON v.term = o.word JOIN wnorm w ON w.col = v.idx
LEFT JOIN pw d ON d.label = o.label AND d.col = o.col AND d.word_idx = v.idx""",
        ),
        "train_samples": with_(
            PHRASE_SPACE
            + """,
trained AS (SELECT label, word FROM oriented GROUP BY 1, 2 HAVING count(*) >= 3),
ww AS (
  SELECT a.col AS i, b.col AS j, sum(a.val * b.val) AS dot
  FROM (SELECT DISTINCT x.idx AS i, y.idx AS j FROM oriented o
        JOIN vocab x ON x.term = o.word JOIN vocab y ON y.term = o.arg) q
  JOIN mat a ON a.col = q.i JOIN mat b ON b.col = q.j AND b."row" = a."row" GROUP BY 1, 2)""",
            """SELECT o.label, o.word, o.arg,
  round(2 - 2 * coalesce(dm.dot, 0) / sqrt(n.norm2) / wm.norm, 5) AS p_norm2,
  round(coalesce(da.dot, 0) / sqrt(n.norm2) / wa.norm
        - coalesce(ww.dot, 0) / wm.norm / wa.norm, 5) AS p_along_a
FROM oriented o JOIN trained USING (label, word)
JOIN pnorm n ON n.label = o.label AND n.col = o.col
JOIN vocab m ON m.term = o.word JOIN vocab a ON a.term = o.arg
JOIN wnorm wm ON wm.col = m.idx JOIN wnorm wa ON wa.col = a.idx
LEFT JOIN pw dm ON dm.label = o.label AND dm.col = o.col AND dm.word_idx = m.idx
LEFT JOIN pw da ON da.label = o.label AND da.col = o.col AND da.word_idx = a.idx
LEFT JOIN ww ON ww.i = m.idx AND ww.j = a.idx""",
        ),
    }
)

# Closed-form ridge regression in two dimensions, one per label of the embeddings.
RIDGE = """
s AS (
  SELECT label, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS a2,
         embedding[3]::DOUBLE AS p1, embedding[4]::DOUBLE AS p2 FROM embeddings),
t AS (
  SELECT label, count(*)::BIGINT AS n, sum(a1*a1) AS g11, sum(a1*a2) AS g12, sum(a2*a2) AS g22,
         sum(p1*a1) AS h11, sum(p1*a2) AS h12, sum(p2*a1) AS h21, sum(p2*a2) AS h22,
         sum(p1*p1 + p2*p2) AS q
  FROM s GROUP BY label),
l AS (SELECT unnest([0.1, 1, 10])::DOUBLE AS lam),
d AS (SELECT *, (g11 + lam) * (g22 + lam) - g12 * g12 AS det FROM t, l),
i AS (SELECT *, (g22 + lam) / det AS i11, -g12 / det AS i12, (g11 + lam) / det AS i22 FROM d),
m AS (
  SELECT *, h11*i11 + h12*i12 AS m11, h11*i12 + h12*i22 AS m12,
         h21*i11 + h22*i12 AS m21, h21*i12 + h22*i22 AS m22,
         i11*g11 + 2*i12*g12 + i22*g22 AS s_trace FROM i),
r AS (
  SELECT *, sqrt(greatest(m11*(m11*g11 + m12*g12) + m12*(m11*g12 + m12*g22)
         + m21*(m21*g11 + m22*g12) + m22*(m21*g12 + m22*g22)
         - 2*(m11*h11 + m12*h12 + m21*h21 + m22*h22) + q, 0)) AS residual FROM m),
e AS (SELECT *, residual * residual / (n * (1 - s_trace / n) * (1 - s_trace / n)) AS err FROM r)"""

ORACLES.update(
    {
        "ridge_modifiers": with_(
            RIDGE,
            """SELECT label, lam, n AS n_samples, round(m11, 6) AS m11, round(m12, 6) AS m12,
  round(m21, 6) AS m21, round(m22, 6) AS m22, round(residual, 6) AS residual,
  round(s_trace, 6) AS s_trace FROM r""",
        ),
        "gcv_lambda": with_(
            RIDGE,
            """SELECT label, lam, round(err, 6) AS err FROM e
QUALIFY row_number() OVER (PARTITION BY label ORDER BY err, lam) = 1""",
        ),
    }
)


def _heads() -> str:
    """Nearest-neighbour governors: (own tag, governor tags, offsets, relation), first hit wins."""
    choices = [
        ("jj", "('nn')", (1, 2, 3), "amod"),
        ("jj", "('vb')", (-1, -2, -3), "acomp"),
        ("nn", "('in')", (-1, -2, -3), "pobj"),
        ("nn", "('vb')", (-1, -2, -3, -4), "dobj"),
        ("nn", "('vb')", (1, 2, 3, 4), "nsubj"),
        ("in", "('nn', 'vb')", (-1, -2, -3), "prep"),
    ]
    gov, rel = [], []
    for own, governors, offsets, name in choices:
        for o in offsets:
            near = f"f{o}" if o > 0 else f"p{-o}"
            hit = f"WHEN t = '{own}' AND {near} IN {governors} THEN"
            gov.append(f"{hit} pos + 1 + ({o})")
            rel.append(f"{hit} '{name}'")
    return (
        "CASE " + " ".join(gov) + " ELSE 0 END AS gov, "
        "CASE " + " ".join(rel) + " ELSE 'root' END AS rel"
    )


SENTENCES = (
    TOKENS
    + f""",
around AS (
  SELECT *, lead(t, 1) OVER w AS f1, lead(t, 2) OVER w AS f2, lead(t, 3) OVER w AS f3,
         lead(t, 4) OVER w AS f4, lag(t, 1) OVER w AS p1, lag(t, 2) OVER w AS p2,
         lag(t, 3) OVER w AS p3, lag(t, 4) OVER w AS p4
  FROM tagged WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY pos)),
stok AS (
  SELECT (doc_id * 536870912 + line_no // 4)::BIGINT AS rule_id,
         CASE WHEN line_no % 4 < 2 THEN 'L' ELSE 'R' END AS side, (line_no % 2)::INT AS sent_no,
         (pos + 1)::INT AS idx, count(*) OVER (PARTITION BY doc_id, line_no) AS n,
         w || '-' || t AS term, t, {_heads()}
  FROM around),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, side, (t IS NULL OR t = 'dt')
                               ORDER BY sent_no, idx) - 1 AS o,
         row_number() OVER (PARTITION BY rule_id, side, sent_no, gov, rel ORDER BY idx) AS nth
  FROM stok),
sent AS (
  SELECT rule_id, side, sent_no, idx, term, t, gov, rel,
         CASE WHEN t <> 'dt' AND idx < n THEN o::INT END AS ord,
         rel = 'pobj' AND nth = 1 AS first_obj,
         CASE t WHEN 'vb' THEN 'V' WHEN 'in' THEN 'P' WHEN 'nn' THEN 'N' ELSE 'B' END AS own
  FROM ranked)"""
)

# Walk from the roots down: depth, role, and the root of the fragment each phrase word is in.
WALK = (
    SENTENCES
    + """,
walk AS (
  SELECT rule_id, side, sent_no, idx, ord, term, gov, rel, 1 AS depth,
         CASE WHEN ord IS NULL THEN 'X' ELSE own END AS role, false AS attached,
         NULL::VARCHAR AS up_role, NULL::VARCHAR AS up_term, 1 AS root_depth, ord AS root_ord,
         NULL::INT AS up_root_depth, NULL::INT AS up_root_ord
  FROM sent WHERE gov = 0
  UNION ALL
  SELECT c.rule_id, c.side, c.sent_no, c.idx, c.ord, c.term, c.gov, c.rel, p.depth + 1,
         CASE WHEN c.ord IS NULL THEN 'X'
              WHEN p.role = 'V' AND c.rel IN ('nsubj', 'dobj') THEN 'N'
              WHEN p.role = 'V' AND c.rel = 'prep' THEN 'P'
              WHEN p.role = 'N' AND c.rel = 'amod' THEN 'A'
              WHEN p.role = 'N' AND c.rel = 'prep' THEN 'P'
              WHEN p.role = 'P' AND c.first_obj THEN 'N' ELSE c.own END,
         c.ord IS NOT NULL AND takes(p.role, c.rel, c.first_obj), p.role, p.term,
         CASE WHEN c.ord IS NOT NULL AND takes(p.role, c.rel, c.first_obj)
              THEN p.root_depth ELSE p.depth + 1 END,
         CASE WHEN c.ord IS NOT NULL AND takes(p.role, c.rel, c.first_obj)
              THEN p.root_ord ELSE c.ord END,
         p.root_depth, p.root_ord
  FROM walk p JOIN sent c ON c.rule_id = p.rule_id AND c.side = p.side
   AND c.sent_no = p.sent_no AND c.gov = p.idx)""".replace(
        "takes(p.role, c.rel, c.first_obj)",
        "((p.role = 'V' AND c.rel IN ('nsubj', 'dobj', 'prep')) OR (p.role = 'N' AND "
        "c.rel IN ('amod', 'prep')) OR (p.role = 'P' AND c.first_obj))",
    )
)

NODES = (
    WALK
    + """,
stops AS (
  SELECT rule_id, side, sent_no, min(depth * 10000000::BIGINT + ord) AS stop
  FROM walk WHERE ord IS NOT NULL AND NOT attached AND role = 'B' GROUP BY 1, 2, 3),
words AS (
  SELECT w.*, coalesce(root_depth * 10000000::BIGINT + root_ord >= stop, false) AS broken,
         coalesce(up_root_depth * 10000000::BIGINT + up_root_ord >= stop, false) AS up_broken
  FROM walk w LEFT JOIN stops USING (rule_id, side, sent_no) WHERE ord IS NOT NULL),
plain AS (
  SELECT rule_id, side, sent_no, idx, term, gov, rel, up_role, up_term,
         attached AND NOT broken AS linked, attached AND NOT broken AND role = 'A' AS adj,
         CASE WHEN broken THEN sent_no * 100000000000000::BIGINT + 50000000000000 + ord
              ELSE sent_no * 100000000000000::BIGINT + root_depth * 10000000 + root_ord END AS fk
  FROM words),
adjs AS (
  SELECT *, gov AS noun, row_number() OVER w AS k, lag(idx) OVER w AS prev,
         lag(term) OVER w AS prev_term, count(*) OVER p AS m, max(idx) OVER p AS last_idx,
         arg_max(term, idx) OVER p AS last_term, arg_min(term, idx) OVER p AS first_term
  FROM plain WHERE adj
  WINDOW w AS (PARTITION BY rule_id, side, sent_no, gov ORDER BY idx),
         p AS (PARTITION BY rule_id, side, sent_no, gov)),
nouns AS (SELECT DISTINCT rule_id, side, sent_no, noun, first_term FROM adjs),
nodes AS (
  SELECT p.rule_id, p.side, p.sent_no, fk, idx AS node,
         CASE WHEN linked THEN gov END AS parent,
         CASE WHEN NOT linked THEN NULL WHEN up_role = 'V' AND rel = 'prep' THEN 'dobj'
              WHEN up_role = 'N' AND rel = 'prep' THEN 'pmod' ELSE rel END AS label,
         coalesce(n.first_term, term) AS word, CASE WHEN linked AND NOT (up_role = 'N' AND rel = 'prep') THEN up_term END AS head,
         idx AS s
  FROM plain p LEFT JOIN nouns n
    ON n.rule_id = p.rule_id AND n.side = p.side AND n.sent_no = p.sent_no AND n.noun = p.idx
  WHERE NOT adj
  UNION ALL
  SELECT a.rule_id, a.side, a.sent_no, a.fk, a.idx,
         CASE WHEN k = 1 AND m > 1 THEN last_idx WHEN k > 2 THEN prev ELSE noun END, 'amod',
         CASE WHEN k = 1 THEN q.term ELSE a.term END,
         CASE WHEN k = 1 THEN last_term ELSE prev_term END, 0
  FROM adjs a JOIN plain q
    ON q.rule_id = a.rule_id AND q.side = a.side AND q.sent_no = a.sent_no AND q.idx = a.noun
  UNION ALL
  SELECT rule_id, side, sent_no,
         sent_no * 100000000000000::BIGINT + up_root_depth * 10000000 + up_root_ord, -idx, gov,
         'acomp', term, up_term, idx
  FROM words WHERE rel = 'acomp' AND up_role = 'V' AND NOT up_broken),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY rule_id, side ORDER BY fk)::INT AS frag FROM nodes)"""
)

PATHS = (
    NODES
    + """,
tree AS (
  SELECT rule_id, side, frag, node, label, word, head, '' AS path, 0 AS level
  FROM numbered WHERE parent IS NULL
  UNION ALL
  SELECT c.rule_id, c.side, c.frag, c.node, c.label, c.word, c.head,
         p.path || '.' || lpad(c.s::VARCHAR, 10, '0'), p.level + 1
  FROM tree p JOIN numbered c ON c.rule_id = p.rule_id AND c.side = p.side AND c.frag = p.frag
   AND c.parent = p.node)"""
)

ORACLES.update(
    {
        "rule_tokens": with_(
            SENTENCES,
            "SELECT rule_id, side, sent_no, idx, ord, term FROM sent WHERE ord IS NOT NULL",
        ),
        "dep_depth": with_(
            WALK, "SELECT rule_id, side, sent_no, idx, depth FROM walk", recursive=True
        ),
        "phrase_highest_node": with_(
            WALK,
            """SELECT rule_id, side, sent_no, idx FROM walk WHERE ord IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY rule_id, side, sent_no ORDER BY depth, ord) = 1""",
            recursive=True,
        ),
        "phrase_nodes": with_(
            PATHS,
            "SELECT rule_id, side, frag, node, level, path, label, word, head FROM tree",
            recursive=True,
        ),
        "phrase_expressions": with_(
            PATHS
            + """,
opened AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, side, frag ORDER BY path) - 1 AS num
  FROM tree),
marks AS (
  SELECT rule_id, side, frag, path AS spot,
         CASE WHEN path = '' THEN word ELSE label || '-#' || num || '# ' || word END AS mark
  FROM opened
  UNION ALL
  SELECT rule_id, side, frag, path || '~', '#' || num || '#' FROM opened WHERE path <> ''),
exprs AS (
  SELECT rule_id, side, frag, string_agg(mark, ' ' ORDER BY spot) AS expr
  FROM marks GROUP BY 1, 2, 3),
sides AS (
  SELECT DISTINCT (doc_id * 536870912 + line_no // 4)::BIGINT AS rule_id, side
  FROM lines, (VALUES ('L'), ('R')) s(side))""",
            """SELECT rule_id, side, coalesce(string_agg(frag || ' = ' || expr, chr(9) ORDER BY frag),
  '#FAIL#') AS text FROM sides LEFT JOIN exprs USING (rule_id, side) GROUP BY 1, 2""",
            recursive=True,
        ),
        "expressions_read": with_(
            PATHS,
            """SELECT rule_id, side, frag, level, label, word, head,
  row_number() OVER (PARTITION BY rule_id, side, frag ORDER BY path)::BIGINT AS place
FROM tree""",
            recursive=True,
        ),
        "mean_similarity": """
WITH cells AS (
  SELECT vec_id // 8 AS rule_id, vec_id % 2 AS side, generate_subscripts(embedding, 1) AS i,
         unnest(embedding)::DOUBLE AS x FROM embeddings),
sums AS (SELECT rule_id, side, i, sum(x) AS x FROM cells GROUP BY 1, 2, 3)
SELECT l.rule_id, round(abs(sum(l.x * r.x) / sqrt(sum(l.x * l.x)) / sqrt(sum(r.x * r.x))), 6)
  AS mean_sim
FROM sums l JOIN sums r ON r.rule_id = l.rule_id AND r.i = l.i AND l.side = 0 AND r.side = 1
GROUP BY 1""",
        "greedy_match": """
WITH RECURSIVE v AS (
  SELECT vec_id // 8 AS rule_id, vec_id % 2 AS side, (vec_id % 8 // 2)::INT AS frag,
         embedding::DOUBLE[] AS e FROM embeddings),
sims AS (
  SELECT l.rule_id, l.frag AS i, r.frag AS j, abs(list_cosine_similarity(l.e, r.e)) AS sim
  FROM v l JOIN v r ON r.rule_id = l.rule_id AND l.side = 0 AND r.side = 1),
start AS (
  SELECT rule_id, list({'sim': sim, 'i': i, 'j': j} ORDER BY sim DESC, i, j) AS left_over
  FROM sims GROUP BY 1),
steps AS (
  SELECT rule_id, 0 AS place, left_over FROM start
  UNION ALL
  SELECT rule_id, place + 1, list_filter(left_over, lambda p:
    p.i <> left_over[1].i AND p.j <> left_over[1].j)
  FROM steps WHERE len(left_over) > 0)
SELECT rule_id, place, round(left_over[1].sim, 6) AS sim, left_over[1].i AS l_frag,
       left_over[1].j AS r_frag
FROM steps WHERE len(left_over) > 0""",
        "match_rounds": """
WITH RECURSIVE v AS (
  SELECT vec_id % 2 AS side, (vec_id // 2)::INT AS frag, embedding::DOUBLE[] AS e FROM embeddings),
start AS (
  SELECT list({'sim': sim, 'i': i, 'j': j} ORDER BY sim DESC, i, j) AS left_over FROM (
    SELECT l.frag AS i, r.frag AS j, round(abs(list_cosine_similarity(l.e, r.e)), 12) AS sim
    FROM v l JOIN v r ON l.side = 0 AND r.side = 1)),
steps AS (
  SELECT 0 AS place, left_over FROM start
  UNION ALL
  SELECT place + 1, list_filter(left_over, lambda p:
    p.i <> left_over[1].i AND p.j <> left_over[1].j)
  FROM steps WHERE len(left_over) > 0)
SELECT 0::BIGINT AS rule_id, place::BIGINT AS place, round(left_over[1].sim, 6) AS sim,
       left_over[1].i AS l_frag, left_over[1].j AS r_frag
FROM steps WHERE len(left_over) > 0""",
    }
)

# Words with a vector, modifiers with a matrix, and which fragments lack a vector: those with a
# bad node that the root reaches without passing a pmod edge.
COMPOSED = (
    PHRASE_SPACE
    + PATHS[len(TOKENS) :].replace("tree AS (", "tree AS MATERIALIZED (")
    + """,
known AS (SELECT term FROM vocab JOIN wnorm ON wnorm.col = vocab.idx),
matrices AS (
  SELECT label, word FROM oriented GROUP BY 1, 2 HAVING count(*) >= 3),
owned AS (SELECT label, word FROM matrices WHERE word IN (SELECT term FROM known)),
marked AS (
  SELECT t.*, n.parent, k.term IS NULL AS unknown,
         t.label IS NOT NULL AND t.label <> 'pmod' AND o.word IS NULL AS matrixless
  FROM tree t JOIN numbered n USING (rule_id, side, frag, node)
  LEFT JOIN known k ON k.term = t.word
  LEFT JOIN owned o ON o.label = t.label AND o.word = t.head),
reach AS (
  SELECT rule_id, side, frag, node, unknown AS bad FROM marked WHERE parent IS NULL
  UNION ALL
  SELECT m.rule_id, m.side, m.frag, m.node, m.unknown OR m.matrixless
  FROM reach r JOIN marked m ON m.rule_id = r.rule_id AND m.side = r.side AND m.frag = r.frag
   AND m.parent = r.node WHERE m.label <> 'pmod'),
frags AS (
  SELECT rule_id, side, frag, bool_or(bad) AS bad FROM reach GROUP BY 1, 2, 3)"""
)

ORACLES.update(
    {
        "compose_vectors": with_(
            COMPOSED,
            """SELECT rule_id, side, frag, CASE WHEN bad THEN 'zero' ELSE 'ok' END AS status,
       CASE WHEN NOT bad THEN 1.0::DOUBLE END AS length FROM frags""",
            recursive=True,
        ),
        "rule_status": with_(
            COMPOSED
            + """,
rule_ids AS (
  SELECT DISTINCT (doc_id * 536870912 + line_no // 4)::BIGINT AS rule_id FROM lines),
sides AS (
  SELECT rule_id, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r,
         count(*) FILTER (side = 'L' AND NOT bad) AS lu,
         count(*) FILTER (side = 'R' AND NOT bad) AS ru
  FROM frags GROUP BY 1)""",
            """SELECT rule_id,
  CASE WHEN coalesce(least(l, r), 0) = 0 THEN 'failed' WHEN least(lu, ru) = 0 THEN 'no_vector'
       ELSE 'scored' END AS status,
  coalesce(CASE WHEN least(l, r) > 0 THEN least(lu, ru) END, 0)::BIGINT AS n_matches
FROM rule_ids LEFT JOIN sides USING (rule_id)""",
            recursive=True,
        ),
    }
)

ORACLES.update(
    {
        "counts_reloaded": with_(TAGGED_VOCAB, "SELECT term, cnt, idx FROM vocab"),
        "counts_merged": with_(TAGGED_VOCAB, "SELECT term, cnt FROM counts"),
        "pairs_merged": with_(TAGGED_PAIRS, "SELECT a, b, n FROM pairs"),
        "matrix_columns": with_(
            word_matrix(DIM)
            + """,
cols AS (SELECT col, count(*) AS nnz, sqrt(sum(val * val)) AS norm FROM mat GROUP BY 1),
prod AS (SELECT "row", sum(val * norm) AS t FROM mat JOIN cols USING (col) GROUP BY 1)""",
            """SELECT cols.col AS col, nnz, round(norm, 6) AS norm, round(t, 6) AS times
FROM cols LEFT JOIN prod ON prod."row" = cols.col""",
        ),
        "triplets_reloaded": with_(word_matrix(DIM), 'SELECT "row", col, val FROM mat'),
        "matrix_ppmi": with_(
            word_matrix(DIM),
            'SELECT "row", col, round(sum(val), 6) AS val FROM coo GROUP BY 1, 2',
        ),
        "training_list": with_(
            PHRASE_SPACE,
            "SELECT label, word FROM oriented GROUP BY 1, 2 HAVING count(*) >= 3",
        ),
        "rule_table": with_(
            SENTENCES
            + """,
places AS (
  SELECT *, row_number() OVER (PARTITION BY rule_id, side ORDER BY sent_no, idx) AS place
  FROM ranked)""",
            """SELECT rule_id, side, rule_id::VARCHAR AS rule, o::INT AS ord, place::INT AS place
FROM places WHERE t <> 'dt'""",
        ),
    }
)

ORACLES["pairs_plain_filtered"] = ORACLES["pairs_plain"]
ORACLES["rule_tokens_by_range"] = ORACLES["rule_tokens"]
ORACLES["parsed_dropped"] = with_(
    EDGES,
    """SELECT 'tokens' AS kind, count(*)::BIGINT AS total FROM tokens
UNION ALL SELECT 'tokens_kept', count(*)::BIGINT FROM tokens WHERE term IS NOT NULL
UNION ALL SELECT 'edges', count(*)::BIGINT FROM edges
UNION ALL SELECT 'edges_kept', count(*)::BIGINT FROM instances""",
)

# A fragment has this many rows of the embeddings; node 0 is its root.
PLANAR_SIZE = 7
PLANAR_PARENTS = (None, 0, 0, 2, 2, 1, 0)


def _planar_step(at: int, child: int, parent: int, plain: str) -> str:
    """A statement's part that adds node ``child`` to ``parent``, as it is where ``plain``, else by a matrix."""

    def sum_(axis: str, row: int) -> str:
        turned = f"m{row}1_{parent} * x{child} + m{row}2_{parent} * y{child}"
        return f"{axis}{parent} + CASE WHEN {plain} THEN {axis}{child} ELSE {turned} END"

    sums, unit = f"SELECT *, {sum_('x', 1)} AS sx, {sum_('y', 2)} AS sy FROM step{at}", "sqrt(sx * sx + sy * sy)"
    cells = ", ".join(
        f"CASE WHEN x{child} IS NULL THEN {axis}{parent} ELSE s{axis} / {unit} END AS {axis}{parent}" for axis in "xy"
    )
    return f"step{at + 1} AS (SELECT * EXCLUDE (sx, sy) REPLACE ({cells}) FROM ({sums}))"


_CELLS = "x y m11 m12 m21 m22".split()
# Children before parents, children of a node in order.
_PLANAR_ADDED = [(3, 2, "false"), (4, 2, "true"), (5, 1, "false"), (1, 0, "g % 3 = 0"), (2, 0, "false"), (6, 0, "true")]
PLANAR = (
    RIDGE
    + f""",
best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY label ORDER BY err, lam) = 1),
v AS (
  SELECT vec_id // {PLANAR_SIZE} AS g, vec_id % {PLANAR_SIZE} AS spot, label, embedding[1]::DOUBLE AS x,
         embedding[2]::DOUBLE AS y, m11, m12, m21, m22 FROM embeddings JOIN best USING (label)),
step0 AS (
  SELECT g, max(label) FILTER (spot = 0) AS label, max(spot) AS top, """
    + ", ".join(f"max({c}) FILTER (spot = {i}) AS {c}{'_' if c[0] == 'm' else ''}{i}" for i in range(PLANAR_SIZE) for c in _CELLS)
    + """ FROM v GROUP BY g),
"""
    + ",\n".join(_planar_step(at, *step) for at, step in enumerate(_PLANAR_ADDED))
    + f""",
added AS (
  SELECT g, (g % 11 = 5 AND g % 3 <> 0) OR (label % 5 = 0 AND top >= 2) AS bad, x0 AS x, y0 AS y
  FROM step{len(_PLANAR_ADDED)}),
planar AS (
  SELECT g // 4 AS rule_id, CASE WHEN g % 2 = 0 THEN 'L' ELSE 'R' END AS side,
         (g % 4 // 2 + 1)::INT AS frag, CASE WHEN bad THEN 'zero' ELSE 'ok' END AS status,
         CASE WHEN NOT bad THEN x END AS x, CASE WHEN NOT bad THEN y END AS y FROM added)"""
)

PLANAR_STEPS = (
    PLANAR
    + """,
sides AS (
  SELECT rule_id, count(*) FILTER (side = 'L') AS l, count(*) FILTER (side = 'R') AS r,
         count(*) FILTER (side = 'L' AND status = 'ok') AS lu, count(*) FILTER (side = 'R' AND status = 'ok') AS ru,
         sum(x) FILTER (side = 'L') AS lx, sum(y) FILTER (side = 'L') AS ly,
         sum(x) FILTER (side = 'R') AS rx, sum(y) FILTER (side = 'R') AS ry FROM planar GROUP BY 1),
scored AS (
  SELECT rule_id, CASE WHEN least(l, r) = 0 THEN 'failed' WHEN least(lu, ru) = 0 THEN 'no_vector' ELSE 'scored' END AS status,
         abs(lx * rx + ly * ry) / sqrt(lx * lx + ly * ly) / sqrt(rx * rx + ry * ry) AS mean FROM sides),
start AS (
  SELECT a.rule_id, list({'sim': abs(a.x * b.x + a.y * b.y), 'i': a.frag, 'j': b.frag}
    ORDER BY abs(a.x * b.x + a.y * b.y) DESC, a.frag, b.frag) AS rest
  FROM planar a JOIN planar b ON b.rule_id = a.rule_id AND a.side = 'L' AND b.side = 'R'
  AND a.status = 'ok' AND b.status = 'ok' GROUP BY 1),
steps AS (
  SELECT rule_id, 0 AS place, rest FROM start
  UNION ALL
  SELECT rule_id, place + 1, list_filter(rest, lambda p: p.i <> rest[1].i AND p.j <> rest[1].j)
  FROM steps WHERE len(rest) > 0)"""
)

ORACLES.update(
    {
        "matched_planar": with_(
            PLANAR_STEPS,
            f"""SELECT p.rule_id, t.place, p.side,
  'w' || ((p.rule_id * 4 + (p.frag - 1) * 2 + CASE WHEN p.side = 'R' THEN 1 ELSE 0 END) * {PLANAR_SIZE}) AS expr,
  round(p.x, 6) AS x, round(p.y, 6) AS y
FROM steps t JOIN planar p ON p.rule_id = t.rule_id
 AND ((p.side = 'L' AND p.frag = t.rest[1].i) OR (p.side = 'R' AND p.frag = t.rest[1].j))
WHERE len(t.rest) > 0""",
            recursive=True,
        ),
        "svd_rank_cut": with_(
            word_matrix(DIM),
            f"""SELECT {CUT_RANK}::INT AS rank, 0.0::DOUBLE AS left_off, 0.0::DOUBLE AS right_off, 0.0::DOUBLE AS middle_off,
  true AS within, true AS leading, round(sum(val * val), 6) AS total,
  round((SELECT sum(own) FROM (SELECT sum(val * val) AS own FROM mat GROUP BY col ORDER BY 1 DESC LIMIT {CUT_RANK})), 6) AS largest
FROM mat""",
        ),
        "ridge_full": """
WITH s AS (SELECT label, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS p FROM embeddings)
SELECT 'full' AS label, label::VARCHAR AS word, count(*)::BIGINT AS n_samples,
  round(sum(list_dot_product(a, a)), 4) AS a_norm2, round(sum(list_dot_product(p, a)), 4) AS p_along_a,
  0.0::DOUBLE AS off_normal, true AS gcv_least FROM s GROUP BY label""",
        "compose_planar": with_(
            PLANAR, "SELECT rule_id, side, frag, status, round(x, 6) AS x, round(y, 6) AS y FROM planar"
        ),
        "score_planar": with_(
            PLANAR_STEPS,
            """SELECT s.rule_id, s.status, CASE s.status WHEN 'failed' THEN -2.0 WHEN 'no_vector' THEN -1.0
  ELSE round(mean, 6) END AS mean_sim, t.place, round(t.rest[1].sim, 6) AS sim,
  t.rest[1].i AS l_frag, t.rest[1].j AS r_frag
FROM scored s LEFT JOIN (SELECT * FROM steps WHERE len(rest) > 0) t USING (rule_id)""",
            recursive=True,
        ),
        "train_modifiers": with_(
            PHRASE_SPACE
            + """,
trained AS (SELECT label, word FROM oriented GROUP BY 1, 2 HAVING count(*) >= 3),
ww AS (
  SELECT a.col AS i, b.col AS j, sum(a.val * b.val) AS dot
  FROM (SELECT DISTINCT x.idx AS i, y.idx AS j FROM oriented o
        JOIN vocab x ON x.term = o.word JOIN vocab y ON y.term = o.arg) q
  JOIN mat a ON a.col = q.i JOIN mat b ON b.col = q.j AND b."row" = a."row" GROUP BY 1, 2),
sampled AS (
  SELECT o.label, o.word, coalesce(da.dot, 0) / sqrt(n.norm2) / wa.norm
         - coalesce(ww.dot, 0) / wm.norm / wa.norm AS along
  FROM oriented o JOIN trained USING (label, word)
  JOIN pnorm n ON n.label = o.label AND n.col = o.col
  JOIN vocab m ON m.term = o.word JOIN vocab a ON a.term = o.arg
  JOIN wnorm wm ON wm.col = m.idx JOIN wnorm wa ON wa.col = a.idx
  LEFT JOIN pw da ON da.label = o.label AND da.col = o.col AND da.word_idx = a.idx
  LEFT JOIN ww ON ww.i = m.idx AND ww.j = a.idx),
known AS (
  SELECT t.label, t.word FROM trained t JOIN vocab m ON m.term = t.word JOIN wnorm w ON w.col = m.idx)""",
            """SELECT k.label, k.word, count(s.along)::BIGINT AS n_samples,
  count(s.along)::DOUBLE AS a_norm2, round(coalesce(sum(s.along), 0), 4) AS p_along_a,
  0.0::DOUBLE AS off_normal, true AS gcv_least
FROM known k LEFT JOIN sampled s USING (label, word) GROUP BY 1, 2""",
        ),
    }
)


def _no_negative_zero(statement: str, columns: tuple[str, ...]) -> str:
    fixed = ", ".join(f"CASE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE {c} END AS {c}" for c in columns)
    return f"SELECT * REPLACE ({fixed}) FROM ({statement})"


# Signed values may round to negative zero, which hashes differently from zero.
SIGNED = {
    "dense_cosine": ("cosine",),
    "normalise_vectors": ("val",),
    "word_cosine": ("cosine",),
    "train_samples": ("p_norm2", "p_along_a"),
    "ridge_modifiers": ("m11", "m12", "m21", "m22"),
    "compose_planar": ("x", "y"),
    "matched_planar": ("x", "y"),
    "train_modifiers": ("p_along_a",),
}
for _name, _columns in SIGNED.items():
    ORACLES[_name] = _no_negative_zero(ORACLES[_name], _columns)
