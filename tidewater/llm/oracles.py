"""DuckDB SQL of the training-data operators that SQL can express, over whole tables."""

from __future__ import annotations

from . import centroids, decontamination, hard_negatives, jaccard_join, mixing

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"


def mix() -> str:
    """Sizes, water-filled targets and systematic copies. Sources fill up in the order of capacity by weight."""
    weight = "CASE (r - 1) % 3 " + " ".join(f"WHEN {i} THEN {w}::DOUBLE" for i, w in enumerate(mixing.WEIGHTS)) + " END"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, {_WORD})), 0) AS BIGINT) size FROM documents),
 s AS (SELECT source, CAST(sum(size) AS BIGINT) source_size, row_number() OVER (ORDER BY source NULLS LAST) r FROM d GROUP BY source),
 w AS (SELECT source, source_size, {mixing.MOST}::DOUBLE * source_size cap, {weight} weight FROM s),
 o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source) k FROM w),
 l AS (SELECT *, ({mixing.TOTAL}::DOUBLE * (SELECT sum(source_size) FROM w) - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) level FROM o),
 stop AS (SELECT arg_min(level, k) level, coalesce(min(k), (SELECT count(*) + 1 FROM l)) k FROM l WHERE level * weight <= cap),
 t AS (SELECT source, source_size, CASE WHEN l.k < stop.k THEN cap ELSE stop.level * weight END target FROM l, stop),
 n AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) i, count(*) OVER (PARTITION BY d.source) docs,
   CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END rate,
   CAST('0x' || substr(md5(coalesce(d.source, '') || CASE WHEN d.source IS NULL THEN '|null|' ELSE '|' END || '{mixing.SEED}'), 1, 5) AS BIGINT) / {1 << 20}.0::DOUBLE z
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
 f AS MATERIALIZED (SELECT *, i > docs - {mixing.LARGE} AND size > target * {mixing.COARSE}::DOUBLE AND target > 0 AS big, row_number() OVER (PARTITION BY source ORDER BY i DESC) k FROM n),
 b AS MATERIALIZED (SELECT * FROM f WHERE big),
 y AS (SELECT DISTINCT source, CAST(0 AS BIGINT) k, 0.0::DOUBLE share, CAST(0 AS BIGINT) words, CAST(0 AS BIGINT) copies FROM b
   UNION ALL SELECT source, k, share, words + c * size, c FROM (SELECT b.source, b.k, y.share + b.rate * b.size share, y.words, b.size,
     CAST(greatest(floor(b.rate), least(ceil(b.rate), {mixing.MOST}::DOUBLE, floor((y.share + b.rate * b.size - y.words) / b.size + 0.5))) AS BIGINT) c
     FROM y JOIN b ON b.source IS NOT DISTINCT FROM y.source AND b.k = y.k + 1)),
 e AS (SELECT b.source, any_value(target) - max(y.words) goal, any_value(source_size) - CAST(sum(size) AS BIGINT) words FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source AND b.k = y.k GROUP BY b.source),
 g AS (SELECT f.*, CASE WHEN coalesce(e.words, source_size) > 0 THEN least({mixing.MOST}::DOUBLE, greatest(0.0::DOUBLE, coalesce(goal, target) / coalesce(e.words, source_size))) ELSE 0.0::DOUBLE END left_rate
   FROM f LEFT JOIN e ON f.source IS NOT DISTINCT FROM e.source WHERE NOT big),
 c AS (SELECT doc_id, size, source_size, target, source, CAST(least(floor(i * left_rate + z) - floor((i - 1) * left_rate + z), {int(mixing.MOST)}) AS BIGINT) copies FROM g
   UNION ALL SELECT b.doc_id, b.size, source_size, target, b.source, y.copies FROM b JOIN y ON b.source IS NOT DISTINCT FROM y.source AND b.k = y.k)
 SELECT doc_id, size, source_size, target, copies * size taken, source, copies FROM c"""


def jaccard() -> str:
    """Shingle sets, links between distinct sets, and the smallest document that links reach."""
    width, num, den = jaccard_join.WIDTH, jaccard_join.NUM, jaccard_join.DEN
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) w FROM documents),
 s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct([array_to_string(w[i : i + {width - 1}], ' ') for i in range(1, greatest(len(w) - {width - 2}, least(len(w), 1) + 1))])) g FROM d),
 k AS MATERIALIZED (SELECT doc_id, CAST(len(g) AS BIGINT) n, CASE WHEN len(g) > 0 THEN md5(array_to_string(g, chr(10))) END h, g FROM s),
 c AS MATERIALIZED (SELECT h, any_value(n) n, any_value(g) g, min(doc_id) least FROM k WHERE h IS NOT NULL GROUP BY h),
 u AS MATERIALIZED (SELECT h, n, unnest(g) x FROM c),
 p AS MATERIALIZED (SELECT a.h ha, b.h hb FROM u a JOIN u b ON a.x = b.x AND a.h <> b.h GROUP BY a.h, b.h, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
 r(h, o) AS (SELECT h, h FROM c UNION SELECT r.h, p.hb FROM r JOIN p ON r.o = p.ha),
 m AS (SELECT r.h, min(c.least) component FROM r JOIN c ON r.o = c.h GROUP BY r.h)
 SELECT doc_id, n n_shingles, coalesce(m.component, doc_id) component_id FROM k LEFT JOIN m ON k.h = m.h"""


def overlaps() -> str:
    """Windows joined on the words that a mask reads, then every diagonal checked along the item."""
    words = lambda t: f"string_split(trim(regexp_replace(lower(coalesce({t}, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', ' ', 'g'), ' '), ' ')"

    def windows(table: str, key: str) -> str:
        one = [
            f"SELECT {key}, {k} mask, p, concat_ws(' ', {', '.join(f'w[p + {m + 1}]' for m in mask)}) seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {mask[-1]})) p FROM {table})"
            for k, mask in enumerate(decontamination.MASKS)
        ]
        return " UNION ALL ".join(one)

    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () rid, doc_id, {words("text")} w FROM documents),
 b AS MATERIALIZED (SELECT row_number() OVER () iid, item_id, w FROM (SELECT DISTINCT item_id, {words("text")} w FROM benchmark)),
 dw AS ({windows("d", "rid")}), bw AS ({windows("b", "iid")}),
 met AS (SELECT DISTINCT rid, iid, dw.p - bw.p dg FROM dw JOIN bw ON dw.mask = bw.mask AND dw.seed = bw.seed),
 a AS (SELECT doc_id, item_id, CAST(len(b.w) AS INTEGER) n, dg, least({decontamination.SPAN}, len(b.w)) span,
   [CASE WHEN dg + i >= 0 AND d.w[dg + i + 1] = b.w[i + 1] THEN 1 ELSE 0 END for i in range(0, len(b.w))] ok
   FROM met JOIN d USING (rid) JOIN b USING (iid)),
 v AS (SELECT *, list_max([list_sum(ok[i + 1 : i + span]) for i in range(0, n - span + 1)]) best FROM a)
 SELECT doc_id, item_id, max(n) item_words, CAST(max(list_sum(ok)) AS INTEGER) agreed_words, CAST(min(dg) AS INTEGER) first_place, count(DISTINCT dg) diagonals
 FROM v WHERE best >= ceil({decontamination.AGREE} * span) GROUP BY doc_id, item_id"""


def _whole(dim: str = "") -> str:
    """Quantised vectors of finite components."""
    finite = "len([1 for x in embedding if x IS NOT NULL AND isfinite(x)]) = len(embedding)"
    return f"[CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] q FROM embeddings WHERE embedding IS NOT NULL AND {finite}{dim}"


def clusters() -> str:
    """Lloyd's rounds over all rows, one common table expression each."""
    dim, k = centroids.DIM, centroids.CLUSTERS
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, {_whole(f' AND len(embedding) = {dim}')})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{centroids.SEED}:' || vec_id), q) - 1 k, q FROM v ORDER BY sha256('{centroids.SEED}:' || vec_id), q LIMIT {k})",
    ]
    for r in range(centroids.ROUNDS + 1):
        far = f"CAST(list_sum([(v.q[i] - c.q[i]) * (v.q[i] - c.q[i]) for i in range(1, {dim + 1})]) AS BIGINT)"
        parts.append(f"a{r} AS MATERIALIZED (SELECT rid, min({{'d': {far}, 'k': c.k}}) m FROM v, c{r} c GROUP BY rid)")
        if r < centroids.ROUNDS:
            parts.append(f"s{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) q FROM (SELECT m.k k, i, sum(q[i]) s, count(*) n FROM a{r} JOIN v USING (rid), range(1, {dim + 1}) t(i) GROUP BY m.k, i) GROUP BY k)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, CAST(coalesce(s.q, c.q) AS BIGINT[]) q FROM c{r} c LEFT JOIN s{r} s ON c.k = s.k)")
    last = centroids.ROUNDS
    return f"""WITH {", ".join(parts)}
 SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) inertia,
 sha256(array_to_string(c.q, ',')) centroid_sha256, count(*) OVER (PARTITION BY v.q) multiplicity FROM v JOIN a{last} a USING (rid) JOIN c{last} c ON c.k = a.m.k"""


def negatives() -> str:
    """All scores of the anchors, ranked among equal and among other labels."""
    h = hard_negatives
    score = "CAST(list_sum([a.q[i] * b.q[i] for i in range(1, len(a.q) + 1)]) AS BIGINT)"
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END label, {_whole(" AND label IS NOT NULL AND vec_id IS NOT NULL")}),
 s AS MATERIALIZED (SELECT a.rid, a.vec_id anchor_id, b.vec_id, a.label = b.label same, {score} score FROM v a JOIN v b ON a.rid <> b.rid WHERE a.vec_id % {h.EVERY} = 0),
 p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) pn FROM s WHERE same) WHERE pn <= {h.POSITIVES}),
 n AS (SELECT p.anchor_id, p.vec_id positive_id, s.vec_id negative_id, p.score positive_score, s.score negative_score, row_number() OVER (PARTITION BY p.rid, pn ORDER BY s.score DESC, s.vec_id) rank
   FROM p JOIN s ON s.rid = p.rid AND NOT s.same AND {h.LEAST} * p.score <= 100 * s.score AND 100 * s.score <= {h.MOST} * p.score)
 SELECT anchor_id, positive_id, CAST(rank AS INTEGER) rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {h.NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": clusters(), "op12_hard_negatives": negatives(), "op2_source_mixing": mix(), "op7_ngram_jaccard_join": jaccard(), "op8_decontamination": overlaps()}
