"""Equivalent DuckDB SQL per registered query."""

from __future__ import annotations

from graphloom.functions.text import TYPE_NOUNS
from graphloom.plans.oracle_views import (dot, f1, fold, norm_entity, norm_open, norm_relation, ratio,
                                          trigram_vectors, with_views)

ORACLE: dict[str, str] = {}
V = with_views

ORACLE["mention_pairs"] = V("SELECT case_id, pred, gold, count(*) AS n_mentions FROM mentions GROUP BY ALL", "mentions")
_P, _R = ratio("both_", "same_pred"), ratio("both_", "same_gold")
ORACLE["cluster_pairwise"] = V(f"""
    SELECT case_id, CAST(n AS BIGINT) AS n_mentions, n_pred AS n_pred_clusters, n_gold AS n_gold_clusters,
           round({_P}, 6) AS pairwise_p, round({_R}, 6) AS pairwise_r, round({f1(_P, _R)}, 6) AS pairwise_f1
    FROM pair_sums""", "pair_sums")
_BC = "SELECT case_id, sum(CAST(o * o AS DOUBLE) / np) / max(n) AS p, sum(CAST(o * o AS DOUBLE) / ng) / max(n) AS r FROM cells GROUP BY 1"
ORACLE["cluster_bcubed"] = V(f"SELECT case_id, round(p, 6) AS bcubed_p, round(r, 6) AS bcubed_r, "
                             f"round({f1('p', 'r')}, 6) AS bcubed_f1 FROM b", "cells", b=_BC)
_MM = dict(
    sp="SELECT case_id, avg(CAST(b AS DOUBLE) / s) AS macro_p, CAST(sum(b) AS DOUBLE) / max(n) AS micro_p FROM "
       "(SELECT case_id, pred, max(o) AS b, max(np) AS s, max(n) AS n FROM cells GROUP BY 1, 2) GROUP BY 1",
    sg="SELECT case_id, avg(CAST(b AS DOUBLE) / s) AS macro_r, CAST(sum(b) AS DOUBLE) / max(n) AS micro_r FROM "
       "(SELECT case_id, gold, max(o) AS b, max(ng) AS s, max(n) AS n FROM cells GROUP BY 1, 2) GROUP BY 1")
ORACLE["cluster_macro_micro"] = V(f"""
    SELECT case_id, round(macro_p, 6) AS macro_p, round(macro_r, 6) AS macro_r,
           round({f1('macro_p', 'macro_r')}, 6) AS macro_f1, round(micro_p, 6) AS micro_p,
           round(micro_r, 6) AS micro_r, round({f1('micro_p', 'micro_r')}, 6) AS micro_f1
    FROM sp JOIN sg USING (case_id)""", "cells", **_MM)
_INFO = dict(
    mi="SELECT case_id, sum(o::DOUBLE / n * ln(n::DOUBLE * o / (np::DOUBLE * ng))) AS mi FROM cells GROUP BY 1",
    hp="SELECT case_id, -sum(np::DOUBLE / n * ln(np::DOUBLE / n)) AS hp FROM "
       "(SELECT DISTINCT case_id, pred, np, n FROM cells) GROUP BY 1",
    hg="SELECT case_id, -sum(ng::DOUBLE / n * ln(ng::DOUBLE / n)) AS hg FROM "
       "(SELECT DISTINCT case_id, gold, ng, n FROM cells) GROUP BY 1",
    info="SELECT *, n::DOUBLE * (n - 1) / 2 AS allp, same_pred * same_gold / (n::DOUBLE * (n - 1) / 2) AS ex, "
         "(same_pred + same_gold) / 2 AS ce, mi / hg AS hom, mi / hp AS com "
         "FROM pair_sums JOIN mi USING (case_id) JOIN hp USING (case_id) JOIN hg USING (case_id)")
ORACLE["cluster_ari_nmi_v"] = V("""
    SELECT case_id, round((both_ - ex) / (ce - ex), 6) AS ari, round(2 * hom * com / (hom + com), 6) AS nmi,
           round(2 * hom * com / (hom + com), 6) AS v_measure, round(hom, 6) AS homogeneity,
           round(com, 6) AS completeness, round(both_ / sqrt(same_pred * same_gold), 6) AS fmi
    FROM info""", "pair_sums", **_INFO)
_LG = "lgamma(x + 1) + lgamma(y + 1) + lgamma(n - x + 1) + lgamma(n - y + 1) - lgamma(n + 1) - lgamma(c + 1) - lgamma(x - c + 1) - lgamma(y - c + 1) - lgamma(n - x - y + c + 1)"
ORACLE["cluster_ami"] = V("SELECT case_id, round((mi - emi) / ((hp + hg) / 2 - emi), 6) AS ami FROM mi JOIN hp USING (case_id) JOIN hg USING (case_id) JOIN emi USING (case_id)",
    "pair_sums", **_INFO,
    sizes="SELECT p.case_id, n::BIGINT AS n, x::BIGINT AS x, y::BIGINT AS y FROM (SELECT DISTINCT case_id, pred, np AS x, n FROM cells) p "
          "JOIN (SELECT DISTINCT case_id, gold, ng AS y FROM cells) g USING (case_id)",
    emi=f"SELECT case_id, sum(c::DOUBLE / n * ln(n::DOUBLE * c / (x::DOUBLE * y)) * exp({_LG})) AS emi FROM "
        "(SELECT *, unnest(range(greatest(1, x + y - n), least(x, y) + 1)) AS c FROM sizes) GROUP BY 1")
ORACLE["cluster_all_scores"] = V(f"""
    SELECT case_id, CAST(pair_sums.n AS BIGINT) AS n_mentions, round({f1(_P, _R)}, 6) AS pairwise_f1,
           round({f1('b.p', 'b.r')}, 6) AS bcubed_f1, round({f1('macro_p', 'macro_r')}, 6) AS macro_f1,
           round({f1('micro_p', 'micro_r')}, 6) AS micro_f1, round((both_ - ex) / (ce - ex), 6) AS ari,
           round(2 * hom * com / (hom + com), 6) AS v_measure, round(both_ / sqrt(same_pred * same_gold), 6) AS fmi
    FROM pair_sums JOIN b USING (case_id) JOIN sp USING (case_id) JOIN sg USING (case_id)
    JOIN (SELECT case_id, ex, ce, hom, com FROM info) i USING (case_id)""", "pair_sums", b=_BC, **_MM, **_INFO)

# ---------------------------------------------------------------- scalar functions
SURF = """SELECT DISTINCT surface FROM (SELECT h AS surface FROM kg_gold UNION ALL SELECT t FROM kg_gold
          UNION ALL SELECT h FROM kg_pred UNION ALL SELECT t FROM kg_pred)"""
RELS = "SELECT DISTINCT r FROM (SELECT r FROM kg_gold UNION ALL SELECT r FROM kg_pred)"


def surf_query(select, **extra):
    return V(f"{select} FROM surf", "kg_pred", surf=SURF, **extra)


ORACLE["norm_entity"] = surf_query(f"SELECT surface, {norm_entity('surface')} AS norm")
ORACLE["norm_rel_words"] = V(f"""SELECT r, {norm_relation('r')} AS norm, replace(replace(lower(r), '_', ''), ' ', '')
    AS schema_norm, lower(r) AS intrinsic_norm FROM rels""", "kg_pred", rels=RELS)
ORACLE["oie_norm"] = surf_query(f"SELECT surface, {norm_open('surface')} AS norm")
_TOK = "trim(regexp_replace(regexp_replace(regexp_replace(replace(surface, '.', ''), ',_?', '_', 'g'), '\\s+', '_', 'g'), '[^a-zA-Z0-9_]', '', 'g'), '_')"
ORACLE["span_words"] = surf_query(f"""SELECT surface, lower(trim(regexp_replace(replace(regexp_replace({_TOK},
    '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' '), '\\s+', ' ', 'g'))) AS norm,
    regexp_replace(replace(lower(trim(surface)), '_', ' '), '\\s+', ' ', 'g') AS definition_key""")
_F = fold("surface")
ORACLE["fold_tokens"] = surf_query(f"""SELECT surface, {_F} AS folded,
    regexp_matches({_F}, '\\b[0-9]{{3,4}}s?\\b') OR list_has_any(string_split({_F}, ' '), ['january','february','march',
      'april','may','june','july','august','september','october','november','december','century']) AS temporal,
    array_to_string(list_sort(list_distinct(string_split({_F}, ' '))), ' ') AS tokens""")
ORACLE["value_literals"] = surf_query("SELECT surface, regexp_matches(surface, '^[-+]?[0-9.,]+(\\s*\\(.*\\))?$') AS literal")
ORACLE["text_forms"] = """SELECT doc_id, md5(nfc_normalize(text)) AS nfc, md5(strip_accents(text)) AS deaccent,
    md5(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS corpus FROM documents"""
_NUM = "regexp_full_match(surface, '[+-]?[0-9]{1,3}(,[0-9]{3})+(\\.[0-9]+)?|[+-]?[0-9]+(\\.[0-9]+)?')"
_ISO = "regexp_full_match(surface, '[0-9]{4}-[0-9]{1,2}(-[0-9]{1,2})?')"
ORACLE["literal_number"] = surf_query(f"SELECT surface, round(CAST(replace(surface, ',', '') AS DOUBLE), 6) AS number") + f" WHERE {_NUM}"
ORACLE["literal_date"] = surf_query("""SELECT surface, CAST(string_split(surface, '-')[1] AS BIGINT) AS y,
    CAST(string_split(surface, '-')[2] AS BIGINT) AS m, CAST(string_split(surface, '-')[3] AS BIGINT) AS d""") + f" WHERE {_ISO}"
ORACLE["literal_class"] = surf_query(f"""SELECT surface, CASE WHEN {_ISO} THEN 'date' WHEN {_NUM} THEN 'number'
    ELSE 'other' END AS kind, CASE WHEN {_ISO} THEN surface WHEN {_NUM} THEN
      CASE WHEN CAST(replace(surface, ',', '') AS DOUBLE) = floor(CAST(replace(surface, ',', '') AS DOUBLE))
           THEN CAST(CAST(replace(surface, ',', '') AS BIGINT) AS VARCHAR)
           ELSE regexp_replace(regexp_replace(surface, '0+$', ''), '\\.$', '') END
    ELSE trim(regexp_replace(replace(replace(lower(surface), '_', ' '), '-', ' '), '\\s+', ' ', 'g')) END AS norm""")
ORACLE["literal_in_text"] = V("""
    SELECT r, count(*) AS n, count(*) FILTER (WHERE
        (r = 'orderedOn' AND contains(text, strftime(CAST(t AS DATE), '%B %-d, %Y')))
        OR (r = 'totalPrice' AND contains(text, format('{:,.2f}', TRY_CAST(t AS DOUBLE))))) AS n_realized
    FROM (SELECT g.r, CASE WHEN r = 'orderedOn' THEN t ELSE NULL END AS d, g.t, k.text FROM kg_gold g JOIN kg_text k USING (item_id))
    GROUP BY r""".replace("CAST(t AS DATE)", "CAST(d AS DATE)"), "kg_gold", "kg_text")
_WORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))"
PRON = ("['he','she','it','they','him','her','them','his','hers','its','their','theirs','we','us','our','ours','i','you',"
        "'your','yours','this','that','these','those','who','which']")
STOP = ("['in','of','is','by','the','a','an','to','at','for','on','with','as','and','or','s','was','were','be','been',"
        "'has','have','had']")


def etok(x):
    return f"list_filter(list_distinct(string_split({x}, '_')), lambda z: z <> '')"


def in_text(x, tok="tok"):
    e = etok(x)
    return f"(len({e}) = 0 OR len(list_intersect({e}, {tok})) / CAST(len({e}) AS DOUBLE) >= 0.5)"


_RT = (f"list_filter(list_distinct(regexp_extract_all(lower(regexp_replace(r, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), "
       f"'[a-z0-9]+')), lambda z: len(z) > 1 AND NOT list_contains({STOP}, z))")
GROUNDED = f"(len({_RT}) = 0 OR list_has_any({_RT}, tok))"
ORACLE["text_presence"] = V(f"""
    SELECT r, count(*) FILTER (WHERE {in_text('nh')}) AS heads, count(*) FILTER (WHERE {in_text('nt')}) AS tails,
           count(*) FILTER (WHERE {GROUNDED}) AS grounded, count(*) FILTER (WHERE list_has_any(tok, {PRON})) AS pronouns
    FROM (SELECT r, {norm_entity('h')} AS nh, {norm_entity('t')} AS nt, {_WORDS} AS tok
          FROM kg_gold JOIN kg_text USING (item_id)) GROUP BY r""", "kg_gold", "kg_text")

# ---------------------------------------------------------------- set metrics
ORACLE["gold_relation_set"] = V("SELECT DISTINCT r FROM kg_gold", "kg_gold")
_ALIGN = dict(
    names=f"SELECT DISTINCT r, {norm_relation('r')} AS text FROM kg_pred",
    refs=f"SELECT DISTINCT r AS g, {norm_relation('r')} AS text FROM kg_gold",
    nv=trigram_vectors("names", "text"), rv=trigram_vectors("refs", "text"),
    align=f"""SELECT r, g AS target, score FROM (SELECT names.r, refs.g, {dot('nv.vec', 'rv.vec')} AS score,
        row_number() OVER (PARTITION BY names.r ORDER BY {dot('nv.vec', 'rv.vec')} DESC, refs.g) AS k
        FROM names JOIN nv USING (text), refs JOIN rv USING (text)) WHERE k = 1""")
ORACLE["nearest_alignment"] = V("SELECT r, target, round(score, 6) AS score FROM align", "kg_pred", **_ALIGN)
_NORM3 = f"{norm_entity('h')} AS nh, {norm_entity('t')} AS nt"
_TAUS = "(VALUES (CAST(0.3 AS DOUBLE)), (0.4), (0.5), (0.6), (0.7)) x(tau)"
_SETS = dict(
    _ALIGN,
    ps=f"SELECT DISTINCT case_id, tau, item_id, target AS r, {_NORM3} FROM kg_pred JOIN align USING (r), {_TAUS} WHERE score >= tau",
    gs=f"SELECT DISTINCT item_id, r, {_NORM3} FROM kg_gold",
    tpfp="""SELECT case_id, tau, count(gs.item_id) AS tp, count(*) - count(gs.item_id) AS fp,
        (SELECT count(*) FROM gs) - count(gs.item_id) AS fn
        FROM ps LEFT JOIN gs USING (item_id, r, nh, nt) GROUP BY 1, 2""",
    cov=f"""SELECT case_id, tau, count(*) AS n_pred_relations, count(*) FILTER (WHERE score >= tau) AS na
        FROM (SELECT DISTINCT case_id, r FROM kg_pred) JOIN align USING (r), {_TAUS} GROUP BY 1, 2""",
    f1s=f"""SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS rc, {ratio('na', 'n_pred_relations')} AS coverage
        FROM tpfp JOIN cov USING (case_id, tau)""")
ORACLE["aligned_triple_f1"] = V(f"""SELECT case_id, tp, fp, fn, n_pred_relations, round(p, 6) AS precision,
    round(rc, 6) AS recall, round({f1('p', 'rc')}, 6) AS f1, round(coverage, 6) AS coverage FROM f1s WHERE tau = 0.5""",
    "kg_pred", **_SETS)
ORACLE["threshold_sweep"] = V(f"""SELECT case_id, tau, tp, fp, fn, round({f1('p', 'rc')}, 6) AS f1,
    round(coverage, 6) AS coverage FROM f1s""", "kg_pred", **_SETS)
ORACLE["kendall_tau"] = V(f"""
    SELECT x.tau, round(sum(sign((x.k - y.k) * (x.rk - y.rk))) / CAST(sum(abs(sign((x.k - y.k) * (x.rk - y.rk)))) AS DOUBLE), 6)
      AS kendall_tau FROM j x JOIN j y ON x.tau = y.tau AND x.case_id < y.case_id GROUP BY 1""", "kg_pred", **_SETS,
    rk=f"SELECT tau, case_id, row_number() OVER (PARTITION BY tau ORDER BY round({f1('p', 'rc')}, 6) DESC, CAST(case_id AS VARCHAR)) AS k FROM f1s",
    j="SELECT a.tau, a.case_id, CAST(a.k AS BIGINT) AS k, CAST(b.k AS BIGINT) AS rk FROM rk a JOIN rk b ON a.case_id = b.case_id AND b.tau = 0.5")
ORACLE["count_parity"] = V("""
    SELECT case_id, round(avg(np / CAST(ng AS DOUBLE)), 6) AS count_ratio,
           round(avg(least(np, ng) / CAST(greatest(np, ng) AS DOUBLE)), 6) AS count_coverage
    FROM (SELECT c.case_id, g.item_id, ng, coalesce(np, 0) AS np FROM
      (SELECT item_id, count(*) AS ng FROM kg_gold GROUP BY 1) g CROSS JOIN (SELECT DISTINCT case_id FROM kg_pred) c
      LEFT JOIN (SELECT case_id, item_id, count(*) AS np FROM kg_pred GROUP BY 1, 2) p USING (case_id, item_id))
    GROUP BY 1""", "kg_pred")
ORACLE["exact_triple_macro"] = V(f"""
    SELECT case_id, count(*) AS n_classes, round(avg({ratio('tp', 'np')}), 6) AS precision,
           round(avg({ratio('tp', 'ng')}), 6) AS recall,
           round(avg({f1(ratio('tp', 'np'), ratio('tp', 'ng'))}), 6) AS f1
    FROM (SELECT case_id, triple, sum(CASE WHEN g AND p THEN 1 ELSE 0 END) AS tp,
                 sum(CASE WHEN p THEN 1 ELSE 0 END) AS np, sum(CASE WHEN g THEN 1 ELSE 0 END) AS ng FROM
      (SELECT case_id, triple, item_id, bool_or(g) AS g, bool_or(NOT g) AS p FROM (
         SELECT case_id, item_id, lower(h || ' | ' || r || ' | ' || t) AS triple, false AS g FROM kg_pred
         UNION ALL SELECT c.case_id, item_id, lower(h || ' | ' || r || ' | ' || t), true FROM kg_gold,
           (SELECT DISTINCT case_id FROM kg_pred) c) GROUP BY 1, 2, 3) GROUP BY 1, 2) GROUP BY 1""", "kg_pred")

def _greedy(entities, least):
    """Views of the greedy matching of open texts: ``(case_id, item_id, ss)``, the similarities of its pairs per record."""
    if entities:
        side = "SELECT DISTINCT {keys}, text, text AS i FROM (SELECT {keys}, %s AS text FROM {src} UNION ALL SELECT {keys}, %s FROM {src})" % (
            norm_open('h'), norm_open('t'))
    else:
        side = "SELECT {keys}, %s || ' ' || %s || ' ' || %s AS text, pos AS i FROM {src}" % tuple(map(norm_open, "hrt"))
    return dict(
        ptext=side.format(keys="case_id, item_id", src="kg_pred"), gtext=side.format(keys="item_id", src="kg_gold"),
        gcase="SELECT case_id, g.* FROM gtext g, (SELECT DISTINCT case_id FROM kg_pred)",
        alltext="SELECT text FROM ptext UNION SELECT text FROM gtext", kv=trigram_vectors("alltext", "text"),
        close=f"""SELECT case_id, item_id, p.i AS i, g.i AS j, CASE WHEN a.vec = b.vec THEN 1.0::DOUBLE ELSE round({dot('a.vec', 'b.vec')}, 12) END AS s
            FROM ptext p JOIN gtext g USING (item_id) JOIN kv a ON a.text = p.text JOIN kv b ON b.text = g.text""",
        taken=f"""SELECT case_id, item_id, list_reduce(list(struct_pack(ui := [i], uj := [j], ss := [s]) ORDER BY s DESC, i DESC, j DESC), lambda x, y:
            CASE WHEN list_has_any(x.ui, y.ui) OR list_has_any(x.uj, y.uj) THEN x
                 ELSE struct_pack(ui := list_concat(x.ui, y.ui), uj := list_concat(x.uj, y.uj), ss := list_concat(x.ss, y.ss)) END).ss AS ss
            FROM close WHERE s >= CAST({least} AS DOUBLE) GROUP BY 1, 2""")


_OPEN = dict(
    per="""SELECT case_id, item_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(len(ss), 0) AS m
        FROM (SELECT case_id, item_id, count(*) AS ng FROM gcase GROUP BY 1, 2)
        FULL JOIN (SELECT case_id, item_id, count(*) AS np FROM ptext GROUP BY 1, 2) USING (case_id, item_id) LEFT JOIN taken USING (case_id, item_id)""",
    micro=f"""SELECT *, {ratio('tp', 'tp + fp')} AS p, {ratio('tp', 'tp + fn')} AS rc FROM (
        SELECT case_id, sum(m)::BIGINT AS tp, sum(np - m)::BIGINT AS fp, sum(ng - m)::BIGINT AS fn, median(m / ng::DOUBLE) FILTER (ng > 0) AS md,
               avg(CAST(m / ng::DOUBLE < 0.5 AS INT)) FILTER (ng > 0) AS low, avg(CAST(m / ng::DOUBLE >= 0.999 AS INT)) FILTER (ng > 0) AS full_
        FROM per GROUP BY 1)""")
_MICRO = f"SELECT case_id, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round({f1('p', 'rc')}, 6) AS f1"
ORACLE["greedy_match"] = V(f"""{_MICRO}, round(md, 6) AS recall_median, round(low, 6) AS frac_below_half, round(full_, 6) AS frac_full
    FROM micro""", "kg_pred", **_greedy(True, 0.7), **_OPEN)
ORACLE["greedy_match_triples"] = V(f"{_MICRO} FROM micro", "kg_pred", **_greedy(False, 0.6), **_OPEN)


def _open_sweep(entities, low, high):
    """Thresholds in hundredths, five apart."""
    return V(f"""SELECT case_id, tau, tp, n_pred, n_gold, round(p, 6) AS precision, round(rc, 6) AS recall, round({f1('p', 'rc')}, 6) AS f1 FROM (
        SELECT *, {ratio('tp', 'n_pred')} AS p, {ratio('tp', 'n_gold')} AS rc FROM (
          SELECT case_id, tau, np AS n_pred, ng AS n_gold, (SELECT count(*) FROM found f WHERE f.case_id = z.case_id AND f.s >= tau) AS tp
          FROM (SELECT case_id, count(*) AS np FROM ptext GROUP BY 1) z JOIN (SELECT case_id, count(*) AS ng FROM gcase GROUP BY 1) USING (case_id),
               (SELECT unnest(range({low}, {high} + 1, 5)) / 100.0::DOUBLE AS tau)))""", "kg_pred", **_greedy(entities, low / 100),
        found="SELECT case_id, unnest(ss) AS s FROM taken")


ORACLE["entity_sweep"] = _open_sweep(True, 50, 95)
ORACLE["triple_sweep"] = _open_sweep(False, 40, 90)

# ---------------------------------------------------------------- error attribution
_IDX = dict(
    tk=f"""SELECT case_id, item_id, {_NORM3}, {norm_relation('pred')} AS fin,
        list_transform(top_k, lambda z: {norm_relation('z')}) AS cands FROM kg_trace""",
    idx="""SELECT case_id, item_id, nh, nt, list_distinct(flatten(list(cands))) AS cands, list_distinct(list(fin)) AS finals
        FROM tk GROUP BY 1, 2, 3, 4""",
    gk=f"SELECT item_id, pos, {_NORM3}, {norm_relation('r')} AS gr FROM kg_gold")
_OUT = dict(
    _IDX,
    outc="""SELECT c.case_id, gk.*, CASE WHEN cands IS NULL THEN 'OIE_MISS' WHEN NOT list_contains(cands, gr) THEN 'RETRIEVAL_MISS'
        WHEN list_contains(finals, gr) THEN 'CORRECT' ELSE 'CANON_MISS' END AS outcome
        FROM gk CROSS JOIN (SELECT DISTINCT case_id FROM tk) c LEFT JOIN idx USING (case_id, item_id, nh, nt)""")


def jac(a, b):
    return f"len(list_intersect({a}, {b})) / CAST(len(list_distinct(list_concat({a}, {b}))) AS DOUBLE)"


_NEAR = f"""SELECT DISTINCT m.case_id, m.item_id, m.nh, m.nt FROM (SELECT DISTINCT case_id, item_id, nh, nt,
      {etok('nh')} AS ht, {etok('nt')} AS tt FROM outc WHERE outcome = 'OIE_MISS') m
    JOIN (SELECT case_id, item_id, {etok('nh')} AS oh, {etok('nt')} AS ot FROM idx) o USING (case_id, item_id)
    WHERE {jac('ht', 'oh')} >= 0.5 AND {jac('tt', 'ot')} >= 0.5"""
_cnt = lambda o: f"count(*) FILTER (WHERE outcome = '{o}')"
ORACLE["error_funnel"] = V(f"""
    SELECT f.*, coalesce(x, 0) AS OIE_MISS_relaxed,
           round(100.0 * (n_gold - OIE_MISS) / n_gold, 6) AS recovered_pct,
           round(100.0 * (n_gold - OIE_MISS - RETRIEVAL_MISS) / (n_gold - OIE_MISS), 6) AS retr_given_recovered_pct,
           round(100.0 * CORRECT / (n_gold - OIE_MISS - RETRIEVAL_MISS), 6) AS canon_given_retrieved_pct
    FROM (SELECT case_id, count(*) AS n_gold, {_cnt('OIE_MISS')} AS OIE_MISS, {_cnt('RETRIEVAL_MISS')} AS RETRIEVAL_MISS,
                 {_cnt('CANON_MISS')} AS CANON_MISS, {_cnt('CORRECT')} AS CORRECT FROM outc GROUP BY 1) f
    LEFT JOIN (SELECT case_id, count(*) AS x FROM outc o WHERE outcome = 'OIE_MISS' AND NOT EXISTS
      (SELECT 1 FROM near n WHERE n.case_id = o.case_id AND n.item_id = o.item_id AND n.nh = o.nh AND n.nt = o.nt)
      GROUP BY 1) USING (case_id)""".replace("100.0", "CAST(100 AS DOUBLE)"), "kg_trace", **_OUT, near=_NEAR)
ORACLE["retrieval_recall_at_k"] = V(f"""
    SELECT case_id, count(*) AS n_triplets, count(g) AS n_matched, CAST(max(len(cands)) AS BIGINT) AS max_candidates,
           round(count(g) / CAST(count(*) AS DOUBLE), 6) AS coverage, round(count(rank) / CAST(count(g) AS DOUBLE), 6) AS gold_in_pool,
           round(avg(rank), 6) AS mean_rank,
           {', '.join(f"round(count(*) FILTER (WHERE rank <= {k}) / CAST(count(g) AS DOUBLE), 6) AS recall_{k}" for k in (1, 2, 3, 5))}
    FROM (SELECT tk.*, g, list_min(list_filter(list_transform(g, lambda z: list_position(cands, z)), lambda p: p > 0)) AS rank
          FROM tk LEFT JOIN (SELECT item_id, nh, nt, list(DISTINCT gr) AS g FROM gk GROUP BY 1, 2, 3) USING (item_id, nh, nt))
    GROUP BY 1""", "kg_trace", **_IDX)
_FLIP = dict(
    _IDX,
    fl="""SELECT gr, w.finals AS wf, l.finals AS lf, l.cands AS lc, list_contains(w.finals, gr) AS wok, list_contains(l.finals, gr) AS lok
        FROM gk JOIN (SELECT * FROM idx WHERE case_id = 1) w USING (item_id, nh, nt)
        JOIN (SELECT * FROM idx WHERE case_id = 2) l USING (item_id, nh, nt)""")
ORACLE["flip_pairs"] = V("""
    SELECT *, round(CAST(100 AS DOUBLE) * decision_errors / paired_losses, 6) AS decision_error_pct FROM (
      SELECT count(*) FILTER (WHERE wok AND lok) AS both_correct, count(*) FILTER (WHERE wok AND NOT lok) AS paired_losses,
             count(*) FILTER (WHERE wok AND NOT lok AND list_contains(lc, gr)) AS decision_errors,
             count(*) FILTER (WHERE wok AND NOT lok AND NOT list_contains(lc, gr)) AS retrieval_errors,
             count(*) FILTER (WHERE lok AND NOT wok) AS loser_wins FROM fl)""", "kg_trace", **_FLIP)
ORACLE["flip_confusions"] = V("""
    SELECT gr AS gold, chosen, count(*) AS n FROM (SELECT gr, unnest(lf) AS chosen FROM fl
      WHERE wok AND NOT lok AND list_contains(lc, gr)) WHERE chosen <> gr GROUP BY ALL""", "kg_trace", **_FLIP)


def misses(case):
    return {
        f"g{case}": f"SELECT item_id, pos, h, r, t, {_NORM3}, {_WORDS} AS tok, text FROM kg_gold JOIN kg_text USING (item_id)",
        f"o{case}": f"SELECT DISTINCT item_id, {_NORM3} FROM kg_pred WHERE case_id = {case}",
        f"e{case}": f"SELECT item_id, nh AS e FROM o{case} UNION SELECT item_id, nt FROM o{case}",
        f"q{case}": f"SELECT item_id, e, count(*) AS n FROM (SELECT item_id, nh AS e FROM g{case} UNION ALL SELECT item_id, nt FROM g{case}) GROUP BY 1, 2",
        f"n{case}": f"""SELECT DISTINCT g.item_id, g.nh, g.nt FROM g{case} g JOIN o{case} o USING (item_id)
            WHERE {jac(etok('g.nh'), etok('o.nh'))} >= 0.5 AND {jac(etok('g.nt'), etok('o.nt'))} >= 0.5""",
        f"c{case}": f"""
            SELECT g.*, NOT {GROUNDED} AS implicit, rev.item_id IS NOT NULL AND hit.item_id IS NULL AS swapped,
              CASE WHEN hit.item_id IS NOT NULL THEN 'CORRECT' WHEN near.item_id IS NOT NULL THEN 'B_surface'
                WHEN {in_text('g.nh')} AND {in_text('g.nt')} THEN
                  CASE WHEN eh.e IS NOT NULL AND et.e IS NOT NULL THEN 'D_pairing_miss' ELSE 'C_entity_miss' END
                WHEN NOT {in_text('g.nt')} AND ((r = 'orderedOn' AND contains(text, strftime(TRY_CAST(g.t AS DATE), '%B %-d, %Y')))
                  OR (r = 'totalPrice' AND contains(text, format('{{:,.2f}}', TRY_CAST(g.t AS DOUBLE))))) THEN 'F_literal_format'
                WHEN list_has_any(tok, {PRON}) AND ((NOT {in_text('g.nh')} AND qh.n >= 2) OR (NOT {in_text('g.nt')} AND qt.n >= 2))
                  THEN 'E_coref' ELSE 'A_unrealized' END AS category
            FROM g{case} g LEFT JOIN o{case} hit USING (item_id, nh, nt)
            LEFT JOIN o{case} rev ON rev.item_id = g.item_id AND rev.nh = g.nt AND rev.nt = g.nh
            LEFT JOIN n{case} near ON near.item_id = g.item_id AND near.nh = g.nh AND near.nt = g.nt
            LEFT JOIN e{case} eh ON eh.item_id = g.item_id AND eh.e = g.nh LEFT JOIN e{case} et ON et.item_id = g.item_id AND et.e = g.nt
            LEFT JOIN q{case} qh ON qh.item_id = g.item_id AND qh.e = g.nh LEFT JOIN q{case} qt ON qt.item_id = g.item_id AND qt.e = g.nt""",
    }


BUCKETS = ("A_unrealized", "B_surface", "F_literal_format", "C_entity_miss", "D_pairing_miss", "E_coref")
_b = lambda *n: "count(*) FILTER (WHERE category IN (" + ", ".join(f"'{x}'" for x in n) + "))"
_pct = lambda x, n="count(*)": f"round(CAST(100 AS DOUBLE) * {x} / {n}, 6)"
ORACLE["oie_miss_buckets"] = V(f"""
    SELECT count(*) AS n_gold, {_b('CORRECT')} AS correct, {', '.join(f"{_b(x)} AS {x}" for x in BUCKETS)},
      count(*) FILTER (WHERE swapped) AS direction_swapped, count(*) FILTER (WHERE implicit) AS implicit_total,
      count(*) FILTER (WHERE implicit AND category <> 'CORRECT') AS implicit_missed,
      {_pct(_b('B_surface', 'F_literal_format'))} AS surface_or_format_pct,
      {_pct(_b('C_entity_miss', 'D_pairing_miss'))} AS genuine_extraction_pct,
      {_pct(_b('A_unrealized', 'E_coref'))} AS ceiling_or_linking_pct FROM c1""", "kg_pred", "kg_text", **misses(1))
_REC = dict(rec=f"""SELECT item_id, length(text) AS len_char, coalesce(n_gold, 0) AS n_gold, coalesce(n_miss, 0) AS n_miss,
      {', '.join(f"coalesce({x}, 0) AS {x}" for x in BUCKETS)} FROM kg_text LEFT JOIN (SELECT item_id, count(*) AS n_gold,
      count(*) FILTER (WHERE category <> 'CORRECT') AS n_miss, {', '.join(f"{_b(x)} AS {x}" for x in BUCKETS)} FROM c1 GROUP BY 1)
      USING (item_id)""")
_BIN = f"""SELECT bin, count(*) AS n_records, round(avg(len_char), 6) AS mean_len_char, CAST(sum(n_gold) AS BIGINT) AS n_gold,
    {_pct('sum(n_miss)', 'greatest(sum(n_gold), 1)')} AS miss_pct,
    {', '.join(f"{_pct(f'sum({x})', 'greatest(sum(n_gold), 1)')} AS {x}_pct" for x in BUCKETS)} FROM"""
ORACLE["oie_miss_by_length"] = V(f"""{_BIN} (SELECT *, CASE {' '.join(f"WHEN len_char <= e{i} THEN 'Q{i}'" for i in (1, 2, 3))}
    ELSE 'Q4' END AS bin FROM rec, edges) GROUP BY bin""", "kg_pred", "kg_text", **misses(1), **_REC,
    edges=f"""SELECT {', '.join(f"max(len_char) FILTER (WHERE k = CAST(ceil({q} * n) AS BIGINT)) AS e{i}" for i, q in ((1, 0.25), (2, 0.5), (3, 0.75)))}
      FROM (SELECT len_char, row_number() OVER (ORDER BY len_char) AS k, count(*) OVER () AS n FROM rec WHERE n_gold > 0)""")
ORACLE["oie_miss_by_triples"] = V(f"""{_BIN} (SELECT *, CASE WHEN n_gold <= 1 THEN '1' WHEN n_gold = 2 THEN '2'
    WHEN n_gold = 3 THEN '3' WHEN n_gold <= 6 THEN '4-6' ELSE '7+' END AS bin FROM rec) GROUP BY bin""",
    "kg_pred", "kg_text", **misses(1), **_REC)


def _shares(case, name):
    rows = {"CORRECT": _b("CORRECT"), "MISS": f"count(*) - {_b('CORRECT')}", "genuine_extraction": _b("C_entity_miss", "D_pairing_miss"),
            "surface_or_format": _b("B_surface", "F_literal_format"), "ceiling_or_linking": _b("A_unrealized", "E_coref"),
            "implicit": "count(*) FILTER (WHERE implicit)", "direction_swapped": "count(*) FILTER (WHERE swapped)",
            **{x: _b(x) for x in BUCKETS}}
    return " UNION ALL ".join(f"SELECT '{k}' AS measure, CAST(100 AS DOUBLE) * ({v}) / count(*) AS {name} FROM c{case}" for k, v in rows.items())


ORACLE["oie_miss_compare"] = V("""
    SELECT measure, round(a_pct, 6) AS a_pct, round(b_pct, 6) AS b_pct, round(a_pct - b_pct, 6) AS delta,
      CASE WHEN abs(a_pct - b_pct) < 0.01 THEN 'same' WHEN (a_pct > b_pct) = (measure = 'CORRECT') THEN 'better' ELSE 'worse' END AS reading
    FROM sa JOIN sb USING (measure)""", "kg_pred", "kg_text", **misses(1), **misses(2), sa=_shares(1, "a_pct"), sb=_shares(2, "b_pct"))

# ---------------------------------------------------------------- graphs
_ETYPE = """SELECT entity, arg_max(pred, (item_id, ord)) AS type FROM ec WHERE ec_case = {c} GROUP BY 1"""
_ENDS = """SELECT case_id, id, arg_min(st, (item_id, pos, s)) AS slot FROM (
      SELECT case_id, h AS id, item_id, pos, 0 AS s, coalesce(head_type, '~') AS st FROM kg_pred LEFT JOIN slots ON r = relation
      UNION ALL SELECT case_id, t, item_id, pos, 1, coalesce(tail_type, '~') FROM kg_pred LEFT JOIN slots ON r = relation) GROUP BY 1, 2"""
_NODES = dict(ends=_ENDS, nodes="SELECT case_id, id, nullif(slot, '~') AS type FROM ends")


def mapped_nodes(case):
    return dict(ends=_ENDS, etype=_ETYPE.format(c=case),
                nodes="SELECT case_id, id, coalesce(etype.type, nullif(slot, '~')) AS type FROM ends LEFT JOIN etype ON entity = id")


_NQ = "SELECT case_id, type, count(*) AS n, CAST(sum(length(id)) AS BIGINT) AS chars FROM nodes GROUP BY ALL"
ORACLE["kg_nodes_first_type"] = V(_NQ, "kg_pred", "slots", **_NODES)
ORACLE["kg_nodes_mapped_type"] = V(_NQ, "kg_pred", "slots", "ec", **mapped_nodes(2))
ORACLE["type_share"] = V("""SELECT case_id, count(*) FILTER (WHERE type = 'Event') AS n_value, count(*) AS n_nodes,
    count(DISTINCT type) AS n_types FROM nodes GROUP BY 1""", "kg_pred", "slots", "ec", **mapped_nodes(3))
ORACLE["kg_statistics"] = V("""SELECT case_id, count(*) AS n_triples, count(DISTINCT r) AS n_relations, any_value(ne) AS n_entities
    FROM kg_pred JOIN (SELECT case_id, count(DISTINCT e) AS ne FROM (SELECT case_id, h AS e FROM kg_pred UNION ALL
      SELECT case_id, t FROM kg_pred) GROUP BY 1) USING (case_id) GROUP BY 1""", "kg_pred")
ORACLE["type_consistency"] = V("""
    SELECT case_id, count(*) FILTER (WHERE ok) AS n_checked,
      count(*) FILTER (WHERE ok AND (head_type = 'Entity' OR head_type = ht) AND (tail_type = 'Entity' OR tail_type = tt)) AS n_conform,
      count(*) FILTER (WHERE head_type IS NULL) AS n_uncovered,
      round(count(*) FILTER (WHERE ok AND (head_type = 'Entity' OR head_type = ht) AND (tail_type = 'Entity' OR tail_type = tt))
        / CAST(count(*) FILTER (WHERE ok) AS DOUBLE), 6) AS conformance
    FROM (SELECT p.case_id, head_type, tail_type, a.type AS ht, b.type AS tt,
            head_type IS NOT NULL AND a.type IS NOT NULL AND b.type IS NOT NULL AS ok
          FROM kg_pred p LEFT JOIN slots ON r = relation JOIN nodes a ON a.case_id = p.case_id AND a.id = p.h
          JOIN nodes b ON b.case_id = p.case_id AND b.id = p.t) GROUP BY 1""", "kg_pred", "slots", "ec", **mapped_nodes(2))
ORACLE["shannon_diversity"] = V("""SELECT case_id, count(*) AS n_distinct, round(-sum(s * log2(s)), 6) AS entropy, round(max(s), 6) AS top_share
    FROM (SELECT case_id, r, count(*) / CAST(sum(count(*)) OVER (PARTITION BY case_id) AS DOUBLE) AS s FROM kg_pred GROUP BY 1, 2) GROUP BY 1""", "kg_pred")
ORACLE["conciseness"] = V("""SELECT (SELECT count(DISTINCT r) FROM kg_pred WHERE case_id = 1) AS n_relations,
    (SELECT count(DISTINCT e) FROM (SELECT h AS e FROM kg_pred WHERE case_id = 1 UNION ALL SELECT t FROM kg_pred WHERE case_id = 1)) AS n_entities,
    (SELECT count(DISTINCT lower(r)) FROM kg_pred WHERE case_id = 2) AS n_raw_relations,
    round(1 - (SELECT count(DISTINCT r) FROM kg_pred WHERE case_id = 1) / CAST((SELECT count(DISTINCT lower(r)) FROM kg_pred WHERE case_id = 2) AS DOUBLE), 6) AS reduction""", "kg_pred")
ORACLE["singleton_orphan"] = V(f"""
    SELECT case_id, CAST(sum(n) AS BIGINT) AS n_triples, count(*) AS n_relations, round(avg(n), 6) AS avg_triples,
      round(avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 6) AS singleton_rate, (SELECT count(*) FROM slots) AS schema_size,
      count(relation) AS grounded, round(1 - count(relation) / CAST((SELECT count(*) FROM slots) AS DOUBLE), 6) AS orphan_rate,
      round(count(relation) / CAST(count(*) AS DOUBLE), 6) AS consistency,
      round(count(relation) / CAST((SELECT count(*) FROM slots) AS DOUBLE), 6) AS coverage
    FROM (SELECT case_id, r, count(*) AS n FROM kg_pred GROUP BY 1, 2) LEFT JOIN slots ON r = relation GROUP BY 1""", "kg_pred", "slots")
ORACLE["relation_utilization"] = V("""SELECT relation AS r, count(p.r) AS n FROM slots LEFT JOIN
    (SELECT r FROM kg_pred WHERE case_id = 1) p ON p.r = relation GROUP BY 1""", "kg_pred", "slots")
_TS = dict(
    ts=f"SELECT ec_case, item_id, {norm_entity('entity')} AS surface, arg_max(pred, ord) AS pred FROM ec GROUP BY ALL",
    em="""SELECT ec_case AS case_id, pred, gold FROM (SELECT item_id, nh AS surface, head_type AS gold FROM gold_k JOIN slots ON r = relation
        UNION ALL SELECT item_id, nt, tail_type FROM gold_k JOIN slots ON r = relation) JOIN ts USING (item_id, surface)""")
_ECELLS = """SELECT *, sum(o) OVER (PARTITION BY case_id, pred) AS np, sum(o) OVER (PARTITION BY case_id, gold) AS ng,
    sum(o) OVER (PARTITION BY case_id) AS n FROM (SELECT case_id, pred, gold, count(*) AS o FROM em GROUP BY ALL)"""
ORACLE["entity_cluster_slots"] = V(f"""
    SELECT case_id AS ec_case, CAST(n AS BIGINT) AS n_mentions, round({f1('pp', 'pr')}, 6) AS pairwise_f1, round(p, 6) AS bcubed_p,
      round(r, 6) AS bcubed_r, round({f1('p', 'r')}, 6) AS bcubed_f1
    FROM (SELECT case_id, max(n) AS n, sum(CAST(o * o AS DOUBLE) / np) / max(n) AS p, sum(CAST(o * o AS DOUBLE) / ng) / max(n) AS r,
            sum(o * (o - 1) / 2) AS both_ FROM ecells GROUP BY 1)
    JOIN (SELECT case_id, any_value(b) / sum(np * (np - 1) / 2) AS pp FROM (SELECT DISTINCT case_id, pred, np FROM ecells)
          JOIN (SELECT case_id, CAST(sum(o * (o - 1) / 2) AS DOUBLE) AS b FROM ecells GROUP BY 1) USING (case_id) GROUP BY 1) USING (case_id)
    JOIN (SELECT case_id, any_value(b) / sum(ng * (ng - 1) / 2) AS pr FROM (SELECT DISTINCT case_id, gold, ng FROM ecells)
          JOIN (SELECT case_id, CAST(sum(o * (o - 1) / 2) AS DOUBLE) AS b FROM ecells GROUP BY 1) USING (case_id) GROUP BY 1) USING (case_id)""",
    "gold_k", "slots", "ec", **_TS, ecells=_ECELLS)
ORACLE["entity_cluster_kb"] = V(f"""
    SELECT case_id AS ec_case, round(p, 6) AS bcubed_p, round(r, 6) AS bcubed_r, round({f1('p', 'r')}, 6) AS bcubed_f1
    FROM (SELECT case_id, sum(CAST(o * o AS DOUBLE) / np) / max(n) AS p, sum(CAST(o * o AS DOUBLE) / ng) / max(n) AS r FROM ecells GROUP BY 1)""",
    "gold_k", "ec", ts=_TS["ts"],
    kb=f"SELECT DISTINCT {norm_entity('entity')} AS surface, coarse AS gold FROM sd_entities WHERE fine IN ('Customer', 'Nation')",
    em="""SELECT ec_case AS case_id, pred, gold FROM (SELECT item_id, nh AS surface FROM gold_k UNION ALL SELECT item_id, nt FROM gold_k)
        JOIN kb USING (surface) JOIN ts USING (item_id, surface)""", ecells=_ECELLS)
_CC = """SELECT DISTINCT h AS a, t AS b FROM kg_pred WHERE case_id = 1"""

# ---------------------------------------------------------------- similarity retrieval
_D = dot("q.vec", "s.vec")


def topk(expr, k=5, name="tk_", source="schema_v", extra=""):
    return (f"SELECT qid, name, ord, score, rank FROM (SELECT q.qid, s.name, s.ord, {expr} AS score, row_number() OVER "
            f"(PARTITION BY q.qid ORDER BY {expr} DESC, s.ord) AS rank FROM query_v q, {source} s {extra}) WHERE rank <= {k}")


_TK = "SELECT qid, name, round(score, 6) AS score, rank FROM tk_"
_TYPED = f"({_D} - CASE WHEN q.head_type <> s.head_type OR q.tail_type <> s.tail_type THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END)"
_PARENT = f"({_D} - CASE WHEN q.parent <> '' AND s.parent <> '' AND q.parent <> s.parent THEN CAST(0.2 AS DOUBLE) ELSE 0.0 END)"
ORACLE["topk_cosine"] = V(_TK, "query_v", tk_=topk(_D))
ORACLE["topk_grid"] = ORACLE["topk_cosine"]
ORACLE["topk_type_penalty"] = V(_TK, "query_v", tk_=topk(_TYPED))
ORACLE["topk_parent_penalty"] = V(_TK, "query_v", tk_=topk(_PARENT))


def leaders(points, op, thr):
    """Greedy leader pass in ``ord`` order as a recursive query over the sorted points."""
    return dict(
        pts=f"SELECT ord, name, vec, row_number() OVER (ORDER BY ord) AS i FROM {points}",
        adj=f"""SELECT a.i, list(b.i ORDER BY b.i) AS near FROM pts a JOIN pts b ON b.i < a.i
            AND round({dot('a.vec', 'b.vec')}, 12) {op} CAST({thr} AS DOUBLE) GROUP BY a.i""",
        walk="""SELECT CAST(1 AS BIGINT) AS i, CAST([1] AS BIGINT[]) AS lead UNION ALL
            SELECT w.i + 1, CASE WHEN list_has_any(coalesce(a.near, CAST([] AS BIGINT[])), w.lead) THEN w.lead
                            ELSE list_append(w.lead, w.i + 1) END
            FROM walk w LEFT JOIN adj a ON a.i = w.i + 1 WHERE w.i < (SELECT max(i) FROM pts)""",
        leads="SELECT unnest(lead) AS i FROM (SELECT lead FROM walk ORDER BY i DESC LIMIT 1)",
        owner=f"""SELECT p.i, min(l.i) AS l FROM pts p JOIN leads l ON l.i = p.i OR l.i < p.i
            JOIN pts lp ON lp.i = l.i WHERE l.i = p.i OR round({dot('p.vec', 'lp.vec')}, 12) {op} CAST({thr} AS DOUBLE) GROUP BY p.i""")


_LEAD = leaders("pool", ">", 0.85)
ORACLE["leader_clusters"] = V("SELECT p.ord, q.ord AS leader FROM owner JOIN pts p ON p.i = owner.i JOIN pts q ON q.i = owner.l",
                              "pool", recursive=True, **_LEAD)
_CL = dict(
    _LEAD,
    mem="SELECT q.ord AS cl, p.name, p.ord, p.vec FROM owner JOIN pts p ON p.i = owner.i JOIN pts q ON q.i = owner.l",
    mean="SELECT cl, list(x ORDER BY d) AS v FROM (SELECT cl, d, avg(vec[d]) AS x FROM mem, (SELECT unnest(range(1, 65)) AS d) GROUP BY 1, 2) GROUP BY 1",
    cen=f"SELECT cl, list_transform(v, lambda x: x / sqrt({dot('v', 'v')})) AS vec FROM mean",
    items=topk(_D, 3, source="pool"),
    near=f"""SELECT qid, cl FROM (SELECT q.qid, c.cl, row_number() OVER (PARTITION BY q.qid ORDER BY {dot('q.vec', 'c.vec')} DESC, c.cl) AS k
        FROM query_v q, cen c) WHERE k <= 2""",
    extra=f"""SELECT qid, name, score, k + 3 AS rank FROM (SELECT n.qid, m.name, {dot('q.vec', 'm.vec')} AS score,
        row_number() OVER (PARTITION BY n.qid ORDER BY {dot('q.vec', 'm.vec')} DESC, m.ord) AS k
        FROM near n JOIN mem m USING (cl) JOIN query_v q ON q.qid = n.qid
        WHERE NOT EXISTS (SELECT 1 FROM items i WHERE i.qid = n.qid AND i.name = m.name)) WHERE k <= 3""")
ORACLE["topk_item_cluster"] = V("""SELECT qid, name, round(score, 6) AS score, rank, 'item' AS source FROM items
    UNION ALL SELECT qid, name, round(score, 6), rank, 'cluster' FROM extra""", "pool", "query_v", recursive=True, **_CL)
_PARTS = """SELECT s.ord, s.vec AS a, q.vec AS b, coalesce(n.vec, s.vec) AS c FROM schema_v s JOIN query_v q ON q.qid = s.ord
    LEFT JOIN schema_v n ON n.ord = xor(s.ord, 1)"""
_FUSED = f"SELECT ord, len(f) AS dim, round(f[1] / sqrt({dot('f', 'f')}), 6) AS first, round(list_sum(f) / sqrt({dot('f', 'f')}), 6) AS total FROM fused"
ORACLE["fuse_concat"] = V(_FUSED, "query_v", parts=_PARTS, fused="SELECT ord, list_concat(list_concat(a, b), list_concat(c, a)) AS f FROM parts")
ORACLE["fuse_weighted"] = V(_FUSED, "query_v", parts=_PARTS, fused="""SELECT ord, list_transform(range(1, len(a) + 1), lambda i:
    CAST(0.4 AS DOUBLE) * a[i] + CAST(0.3 AS DOUBLE) * b[i] + CAST(0.15 AS DOUBLE) * c[i] + CAST(0.15 AS DOUBLE) * a[i]) AS f FROM parts""")
ORACLE["redundancy_nn"] = V(f"""SELECT count(*) AS n_relations, round(avg(m), 6) AS redundancy FROM
    (SELECT a.ord, max({dot('a.vec', 'b.vec')}) AS m FROM pool a JOIN pool b ON a.ord <> b.ord GROUP BY 1)""", "pool")
ORACLE["redundancy_pairs"] = V(f"""SELECT a.name AS a, b.name AS b, round({dot('a.vec', 'b.vec')}, 6) AS score FROM pool a JOIN pool b
    ON a.ord < b.ord WHERE {dot('a.vec', 'b.vec')} > 0.85""", "pool")


def linkage(rounds: int) -> dict:
    """Average linkage by rounds of mutually nearest clusters, each a row of mean vector and size; unrolled."""
    out = {"st_0": "SELECT min(ord) AS id, CAST(count(*) AS DOUBLE) AS n, vec FROM pool GROUP BY vec"}
    for k in range(rounds):
        s = f"round({dot('a.vec', 'b.vec')}, 12)"
        out[f"nn_{k}"] = f"""SELECT a.id, arg_max(b.id, ({s}, -b.id)) AS other FROM st_{k} a JOIN st_{k} b ON a.id <> b.id AND {s} > 0.8 GROUP BY a.id"""
        out[f"mg_{k}"] = f"SELECT a.id, b.id AS gone FROM nn_{k} a JOIN nn_{k} b ON a.other = b.id AND b.other = a.id AND a.id < b.id"
        out[f"st_{k + 1}"] = f"""SELECT coalesce(m.id, s.id) AS id, sum(s.n) AS n, list_transform(range(1, 65), lambda d: list_sum(list_transform(
            list(struct_pack(n := s.n, vec := s.vec)), lambda p: p.n * p.vec[d])) / sum(s.n)) AS vec
            FROM st_{k} s JOIN nn_{k} USING (id) LEFT JOIN mg_{k} m ON m.gone = s.id GROUP BY 1"""
    return out


_ROUNDS = 14
ORACLE["redundancy_clusters"] = V(f"""SELECT n AS n_relations, n - dup - merged AS n_clusters, round(1 - (n - dup - merged) / n, 6) AS redundancy FROM
    (SELECT count(*) AS n, count(*) - count(DISTINCT vec) AS dup FROM pool),
    (SELECT {' + '.join(f'(SELECT count(*) FROM mg_{k})' for k in range(_ROUNDS))} AS merged)""", "pool", **linkage(_ROUNDS))
_NR = "replace(replace(lower(relation), '_', ''), ' ', '')"
ORACLE["redundancy_lexical"] = V(f"""
    SELECT count(*) AS n_relations, (SELECT count(*) FROM n a JOIN n b ON a.relation < b.relation
        WHERE contains(a.x, b.x) OR contains(b.x, a.x)) AS n_redundant,
      round((SELECT count(*) FROM n a JOIN n b ON a.relation < b.relation WHERE contains(a.x, b.x) OR contains(b.x, a.x))
        / (count(*) * CAST(count(*) - 1 AS DOUBLE) / 2), 6) AS redundancy FROM n""", "open_rel",
    n=f"SELECT relation, {_NR} AS x FROM (SELECT DISTINCT relation FROM open_rel)")

# ---------------------------------------------------------------- canonicalization
_ANS = """SELECT qid, answered, raw, CASE WHEN regexp_extract(raw, '\\b([0-9]+)\\b', 1) <> '' THEN
      CASE WHEN CAST(regexp_extract(raw, '\\b([0-9]+)\\b', 1) AS BIGINT) < 6 THEN CAST(regexp_extract(raw, '\\b([0-9]+)\\b', 1) AS BIGINT) END
    WHEN regexp_extract(raw, '\\b([A-Z])\\b', 1) <> '' THEN CASE WHEN ascii(regexp_extract(raw, '\\b([A-Z])\\b', 1)) - 65 < 6
      THEN ascii(regexp_extract(raw, '\\b([A-Z])\\b', 1)) - 65 END END AS choice
    FROM (SELECT qid, qid % 17 <> 0 AS answered, (['Answer: 3', 'B', 'none of these', '12', '', '0', 'A', ' 5. because', '1'])[qid % 9 + 1] AS raw
          FROM query_v)"""
ORACLE["mcq_parse"] = V("SELECT qid, CAST(choice AS BIGINT) AS choice FROM ans", "query_v", ans=_ANS)
_LISTS = "SELECT qid, list(name ORDER BY rank) AS names, list(score ORDER BY rank) AS scores FROM tk_ GROUP BY 1"


def frozen(new_label):
    return f"""SELECT qid, CASE WHEN NOT answered THEN names[1] WHEN choice > 0 THEN names[choice] ELSE names[1] END AS pred,
      CASE WHEN NOT answered THEN 'fallback_top1' WHEN choice IS NULL THEN 'fallback_parse_fail|frozen_top1'
        WHEN choice = 0 THEN '{new_label}|frozen_top1' ELSE 'llm_reuse' END AS decision,
      array_to_string(names, ',') AS candidates FROM ans JOIN lists USING (qid)"""


ORACLE["sc_frozen"] = V(frozen("llm_new_relation"), "query_v", tk_=topk(_TYPED), lists=_LISTS, ans=_ANS)
ORACLE["ec_frozen"] = V(frozen("llm_new_entity"), "query_v", tk_=topk(_PARENT), lists=_LISTS, ans=_ANS)
ORACLE["sc_frozen_threshold"] = V("""SELECT qid, names[1] AS pred, CASE WHEN scores[1] >= 0.85 THEN 'embed_reuse'
    ELSE 'embed_new|frozen_top1' END AS decision, array_to_string(names, ',') AS candidates FROM lists""", "query_v",
    tk_=topk(_D), lists=_LISTS)
ORACLE["prompt_choices"] = V("""SELECT qid, '0. NONE' || chr(10) || string_agg(rank || '. ' || tk_.name || ' | def of ' || tk_.name || ' | ' || s.head_type
    || ' -> ' || s.tail_type, chr(10) ORDER BY rank) AS choices FROM tk_ JOIN schema_v s ON s.ord = tk_.ord GROUP BY qid""", "query_v", tk_=topk(_D))


def growth(seeded):
    pts = "SELECT ord, name, vec FROM (SELECT min(position) AS ord, relation AS name FROM open_rel GROUP BY 2) JOIN kv ON kv.text = name"
    if seeded:
        pts = f"""SELECT CASE WHEN ends_with(name, 'brand 1') THEN row_number() OVER (ORDER BY NOT ends_with(name, 'brand 1'), name) - 1000000
            ELSE ord END AS ord, name, vec FROM ({pts})"""
    return dict(kv=trigram_vectors("open_rel", "relation"), src=pts)


def growth_views(seeded):
    base = growth(seeded)
    lead = leaders("src", ">=", 0.8)
    if seeded:
        # seeds never absorb one another: they all lead
        lead["adj"] = f"""SELECT a.i, list(b.i ORDER BY b.i) AS near FROM pts a JOIN pts b ON b.i < a.i AND a.ord >= 0
            AND round({dot('a.vec', 'b.vec')}, 12) >= CAST(0.8 AS DOUBLE) GROUP BY a.i"""
    return dict(
        base, **{k: lead[k] for k in ("pts", "adj", "walk", "leads")},
        minted="SELECT p.ord, p.name, p.vec FROM leads JOIN pts p USING (i)",
        sims=f"""SELECT kv.text AS relation, m.ord, m.name, round({dot('kv.vec', 'm.vec')}, 12) AS s FROM kv, minted m
            WHERE round({dot('kv.vec', 'm.vec')}, 12) >= 0.8""",
        best="""SELECT o.position, o.relation, arg_max(s.name, (s.s, -s.ord)) AS top FROM open_rel o LEFT JOIN sims s
            ON s.relation = o.relation AND s.ord < o.position GROUP BY 1, 2""",
        dec="SELECT position, relation, coalesce(top, relation) AS pred, CASE WHEN top IS NULL THEN 'embed_new' ELSE 'embed_reuse' END AS decision FROM best")


_GQ = "SELECT pred, decision, count(*) AS n, count(DISTINCT relation) AS n_open FROM dec GROUP BY ALL"
ORACLE["sc_embed_threshold_fold"] = V(_GQ, "open_rel", recursive=True, **growth_views(False))
ORACLE["sc_incremental"] = ORACLE["sc_embed_threshold_fold"]
ORACLE["sc_seeded_fold"] = V(_GQ, "open_rel", recursive=True, **growth_views(True))
ORACLE["alias_accumulate"] = V("""SELECT pred, string_agg(relation, ',' ORDER BY a) AS aliases FROM (SELECT pred, relation, min(position) AS a
    FROM dec WHERE decision = 'embed_reuse' AND relation <> pred GROUP BY 1, 2) GROUP BY 1""", "open_rel", recursive=True, **growth_views(False))
ORACLE["ec_type_groups"] = V("""SELECT item_id, coarse AS fine, min(pos) AS ord, arg_min(description, pos) AS definition, arg_min(coarse, pos) AS parent,
    string_agg(entity, ',' ORDER BY pos) AS members FROM sd_entities GROUP BY item_id, coarse""", "sd_entities")
ORACLE["ec_type_map"] = V(_ETYPE.format(c=2), "ec")

EC_SIGNALS = (("ec1_name_only", "fine", "NULL::VARCHAR"), ("ec2_name_definition", "fine || '. ' || definition", "NULL::VARCHAR"),
              ("ec3_definition_parent", "fine || '. ' || definition", "parent"))


def type_growth(i: int, seeded: bool = False) -> dict:
    """Growing entity types of one signal: ordered leaders with a parent penalty, a name leading once; then decisions as of each group."""
    _, text, kind = EC_SIGNALS[i]
    seed = f"""SELECT row_number() OVER (ORDER BY fine) - 1000000 AS ord, fine, fine AS text, {kind.replace('parent', "'Tool'")} AS kind, '' AS definition,
        'Tool' AS parent FROM (SELECT DISTINCT fine FROM type_groups WHERE ends_with(fine, 'ring'))"""
    pen = "CASE WHEN a.kind <> '' AND b.kind <> '' AND a.kind <> b.kind THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"
    reach = f"round({dot('a.vec', 'b.vec')} - {pen}, 12) >= CAST(0.7 AS DOUBLE)"
    lock = "AND a.ord >= 0" if seeded else ""
    return {
        f"key_{i}": f"""SELECT min(position) AS ord, fine, text, kind, arg_min(definition, position) AS definition, arg_min(parent, position) AS parent
            FROM (SELECT *, {text} AS text, {kind} AS kind FROM type_groups) GROUP BY fine, text, kind""",
        f"all_{i}": f"SELECT * FROM key_{i}" + (f" UNION ALL {seed}" if seeded else ""),
        f"kv_{i}": trigram_vectors(f"all_{i}", "text"),
        f"pts_{i}": f"SELECT k.*, kv.vec, row_number() OVER (ORDER BY ord) AS i FROM all_{i} k JOIN kv_{i} kv USING (text)",
        f"adj_{i}": f"SELECT a.i, list(b.i ORDER BY b.i) AS near FROM pts_{i} a JOIN pts_{i} b ON b.i < a.i {lock} AND ({reach} OR a.fine = b.fine) GROUP BY a.i",
        f"walk_{i}": f"""SELECT CAST(1 AS BIGINT) AS i, CAST([1] AS BIGINT[]) AS lead UNION ALL
            SELECT w.i + 1, CASE WHEN list_has_any(coalesce(a.near, CAST([] AS BIGINT[])), w.lead) THEN w.lead ELSE list_append(w.lead, w.i + 1) END
            FROM walk_{i} w LEFT JOIN adj_{i} a ON a.i = w.i + 1 WHERE w.i < (SELECT max(i) FROM pts_{i})""",
        f"born_{i}": f"SELECT p.* FROM pts_{i} p WHERE p.i IN (SELECT unnest(lead) FROM (SELECT lead FROM walk_{i} ORDER BY i DESC LIMIT 1))",
        f"near_{i}": f"SELECT a.fine, a.text, a.kind, b.ord, b.fine AS name, round({dot('a.vec', 'b.vec')} - {pen}, 12) AS s FROM pts_{i} a JOIN born_{i} b ON {reach}",
        f"dec_{i}": f"""SELECT g.position, g.item_id, g.ord, g.fine, g.members, arg_max(n.name, (n.s, -n.ord)) AS top
            FROM (SELECT *, {text} AS text, {kind} AS kind FROM type_groups) g LEFT JOIN near_{i} n
            ON n.fine = g.fine AND n.text = g.text AND n.kind IS NOT DISTINCT FROM g.kind AND n.ord < g.position GROUP BY ALL"""}


_EC3 = {k: v for i in range(3) for k, v in type_growth(i).items()}
ORACLE["ec_growing"] = V(" UNION ALL ".join(f"""SELECT '{c[0]}' AS ec_case, coalesce(top, fine) AS pred,
    CASE WHEN top IS NULL THEN 'embed_new' ELSE 'embed_reuse' END AS decision, top IS NULL AS is_new, count(*) AS n, count(DISTINCT fine) AS n_fine
    FROM dec_{i} GROUP BY ALL""" for i, c in enumerate(EC_SIGNALS)), "type_groups", recursive=True, **_EC3)
ORACLE["ec_rerun"] = V(" UNION ALL ".join(f"""SELECT '{c[0]}' AS ec_case, entity, arg_max(coalesce(top, fine), (item_id, ord)) AS type
    FROM (SELECT *, unnest(members) AS entity FROM dec_{i}) GROUP BY 2""" for i, c in enumerate(EC_SIGNALS)), "type_groups", recursive=True, **_EC3)
ORACLE["ec_schema"] = V(" UNION ALL ".join(f"SELECT '{c[0]}' AS ec_case, fine AS name, definition, parent FROM born_{i}" for i, c in enumerate(EC_SIGNALS)),
                        "type_groups", recursive=True, **{k: v for i in range(3) for k, v in type_growth(i, True).items()})

# ---------------------------------------------------------------- instances
ORACLE["surface_freq"] = V("SELECT surface, count(*) AS freq FROM (SELECT h AS surface FROM kg_pred UNION ALL SELECT t FROM kg_pred) GROUP BY 1", "kg_pred")
NOUN_SQL = "[" + ", ".join(f"'{n}'" for n in TYPE_NOUNS) + "]"
_S = dict(
    raw="""SELECT surface, count(*) AS freq FROM (SELECT h AS surface FROM kg_pred WHERE r IN ('containsPart','containsPartOf','partOf','locatedIn','situatedIn')
        UNION ALL SELECT t FROM kg_pred WHERE r IN ('containsPart','containsPartOf','partOf','locatedIn','situatedIn'))
        WHERE NOT regexp_matches(lower(surface), '^(order|customer)') GROUP BY 1""",
    low="SELECT DISTINCT lower(surface) AS text FROM raw", lv=trigram_vectors("low", "text"),
    lastw="SELECT DISTINCT string_split(surface, ' ')[-1] AS text FROM raw", dv=trigram_vectors("lastw", "text"),
    sf=f"""SELECT surface, freq, lv.vec, dv.vec AS dvec, CASE WHEN length(surface) % 4 = 0 THEN NULL ELSE 'T' || (length(surface) % 2) END AS type,
        list_filter(list_distinct(string_split({fold('surface')}, ' ')), lambda z: z <> '') AS tok, {fold('surface')} AS f,
        regexp_matches({fold('surface')}, '\\b[0-9]{{3,4}}s?\\b') AS temporal
        FROM raw JOIN lv ON lv.text = lower(surface) JOIN dv ON dv.text = string_split(surface, ' ')[-1]""",
    pairs=f"""SELECT a.surface AS x, b.surface AS y, {dot('a.vec', 'b.vec')} AS s, {dot('a.dvec', 'b.dvec')} AS ds, a.type = b.type AS typed,
        a.tok AS ta, b.tok AS tb, len(list_intersect(a.tok, b.tok)) AS both_ FROM sf a JOIN sf b ON a.surface < b.surface
        WHERE NOT a.temporal AND NOT b.temporal AND {dot('a.vec', 'b.vec')} >= 0.6""",
    rules=f"""SELECT *, both_ = len(ta) OR both_ = len(tb) AS sub, list_has_any(list_filter(list_concat(ta, tb), lambda z: NOT
          (list_contains(ta, z) AND list_contains(tb, z))), {NOUN_SQL}) AS noun_diff,
        NOT (both_ = len(ta) AND both_ = len(tb)) AND list_has_all({NOUN_SQL}, ta) AND list_has_all({NOUN_SQL}, tb) AS blocked FROM pairs""",
    hits="""SELECT c.ic AS ic_case, x, y, CASE WHEN sub THEN CASE WHEN NOT noun_diff THEN 'token_subset' END
          WHEN blocked THEN NULL WHEN s >= 0.8 THEN 'semantic_alias' WHEN c.ic = 'ic1_name' OR typed IS NOT TRUE THEN NULL
          WHEN c.ic = 'ic3_name_type_desc' AND s >= 0.6 AND ds >= 0.9 THEN 'typed_desc_alias' WHEN s >= 0.7 THEN 'typed_alias' END AS kind
        FROM rules, (VALUES ('ic1_name'), ('ic2_name_type'), ('ic3_name_type_desc')) c(ic)""")
ORACLE["ic_signal_counts"] = V("SELECT ic_case, kind, count(*) AS n FROM hits WHERE kind IS NOT NULL GROUP BY ALL", "kg_pred", **_S)
_COMP = dict(
    _S,
    raw="SELECT surface, count(*) AS freq FROM (SELECT h AS surface FROM kg_pred UNION ALL SELECT t FROM kg_pred) GROUP BY 1",
    edges="""SELECT ic_case || '|' || x AS a, ic_case || '|' || y AS b FROM hits WHERE kind IS NOT NULL
        UNION SELECT c.ic || '|' || p.surface, c.ic || '|' || q.surface FROM sf p JOIN sf q ON p.f = q.f AND p.surface < q.surface,
          (VALUES ('ic1_name'), ('ic2_name_type'), ('ic3_name_type_desc')) c(ic)""",
    sym="SELECT a, b FROM edges UNION SELECT b, a FROM edges",
    nodes="SELECT c.ic || '|' || surface AS id, c.ic AS ic_case, surface, freq, type FROM sf, (VALUES ('ic1_name'), ('ic2_name_type'), ('ic3_name_type_desc')) c(ic)",
    reach="SELECT id, id AS r FROM nodes UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r",
    comp="SELECT id, min(r) AS c FROM reach GROUP BY 1",
    cm="""SELECT ic_case, surface, type, c, first_value(surface) OVER (PARTITION BY c ORDER BY freq DESC, length(surface) DESC, surface) AS canonical
        FROM nodes JOIN comp USING (id)""")
ORACLE["ic_canon_map"] = V("SELECT ic_case, surface, canonical FROM cm", "kg_pred", recursive=True, **_COMP)
ORACLE["ic_statistics"] = V("""
    SELECT ic_case, CAST(sum(n) AS BIGINT) AS n_surfaces, count(*) FILTER (WHERE n > 1) AS n_clusters_merged,
      CAST(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) AS BIGINT) AS n_surfaces_rewritten, max(n) AS largest_cluster,
      count(*) FILTER (WHERE n > 1 AND k >= 1) AS n_clusters_with_types, count(*) FILTER (WHERE n > 1 AND k = 1) AS n_type_consistent,
      round(coalesce(sum(n - 1) FILTER (WHERE n > 1), 0) / CAST(sum(n) AS DOUBLE), 6) AS merge_rate
    FROM (SELECT ic_case, c, count(*) AS n, count(DISTINCT type) AS k FROM cm GROUP BY 1, 2) GROUP BY 1""", "kg_pred", recursive=True, **_COMP)
ORACLE["kg_rewrite"] = V(f"""
    SELECT item_id, min(pos) AS pos, h, r, t FROM (SELECT p.item_id, p.pos, a.canonical AS h, p.r, b.canonical AS t FROM kg_pred p
      JOIN cf a ON a.surface = p.h JOIN cf b ON b.surface = p.t WHERE p.case_id = 1) WHERE h <> t GROUP BY item_id, h, r, t""", "kg_pred",
    sfq="SELECT surface, count(*) AS freq FROM (SELECT h AS surface FROM kg_pred UNION ALL SELECT t FROM kg_pred) GROUP BY 1",
    cf=f"SELECT surface, first_value(surface) OVER (PARTITION BY {fold('surface')} ORDER BY freq DESC, length(surface) DESC, surface) AS canonical FROM sfq")

# ---------------------------------------------------------------- parsers on recorded answers
ORACLE["oie_parse"] = V("""SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY pos) - 1 AS pos,
    CASE WHEN item_id % 4 = 2 THEN 'O''' || h ELSE h END AS h, r, t FROM kg_gold WHERE item_id % 4 <> 3""", "kg_gold")
ORACLE["oie_clean_generated"] = V("""SELECT item_id, md5(CASE WHEN item_id % 4 = 3 THEN 'I found no triples. and so on'
      WHEN item_id % 4 = 1 THEN 'Here is the list:' || chr(10) || body ELSE body END) AS clean
    FROM (SELECT item_id, '[' || string_agg('[''' || CASE WHEN item_id % 4 = 2 THEN 'O''' || h ELSE h END || ''', ''' || r || ''', ''' || t || ''']',
      ', ' ORDER BY pos) || ']' AS body FROM kg_gold GROUP BY 1)""", "kg_gold")
ORACLE["kg_text_roundtrip"] = V("SELECT r, count(*) AS n, CAST(sum(length(h) + length(t)) AS BIGINT) AS chars FROM kg_gold GROUP BY 1", "kg_gold")
ORACLE["relation_refine"] = V("""SELECT r2 AS r, count(*) AS n FROM (SELECT CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 4 = 1 THEN 'hasOrderOf'
    ELSE r END AS r2 FROM kg_pred WHERE case_id = 1) WHERE r2 IS NOT NULL GROUP BY 1""", "kg_pred")
ORACLE["reject_reasons"] = V("""SELECT CASE pos WHEN 3 THEN 'empty_component' WHEN 4 THEN 'non_string_element' ELSE 'kept' END AS reason, count(*) AS n
    FROM kg_pred WHERE case_id = 1 GROUP BY 1""", "kg_pred")
ORACLE["verdict_rule"] = """SELECT CASE WHEN doc_id % 11 = 0 THEN 'UNPARSED' WHEN doc_id % 5 = 0 THEN 'NOT_VERBALIZED' WHEN doc_id % 3 = 2 THEN 'UNSUPPORTED'
    WHEN doc_id % 3 = 1 THEN 'IMPLICIT_OK' ELSE 'SUPPORTED' END AS verdict, count(*) AS n FROM documents GROUP BY 1"""
ORACLE["verdict_distribution"] = """SELECT v.verdict, count(l.x) AS n, round(CAST(100 AS DOUBLE) * count(l.x) / (SELECT count(*) FROM labels), 6) AS pct
    FROM (VALUES ('SUPPORTED'), ('IMPLICIT_OK'), ('UNSUPPORTED'), ('NOT_VERBALIZED')) v(verdict) LEFT JOIN
    (SELECT CASE WHEN quality <> 1 THEN 'NOT_VERBALIZED' WHEN toxic = 1 THEN 'UNSUPPORTED' WHEN doc_id % 2 = 0 THEN 'IMPLICIT_OK' ELSE 'SUPPORTED' END AS x
     FROM labels) l ON l.x = v.verdict GROUP BY 1"""
ORACLE["expression_rule"] = V("""SELECT label, category, count(*) AS n FROM (SELECT DISTINCT item_id, h, r, t, CASE WHEN item_id % 3 = 0 THEN 'implicit'
      WHEN item_id % 2 = 0 THEN 'coref' ELSE 'explicit' END AS label FROM kg_gold) JOIN
    (SELECT item_id, h, r, t, arg_max(category, pos) AS category FROM c1 GROUP BY 1, 2, 3, 4) USING (item_id, h, r, t) GROUP BY ALL""",
    "kg_pred", "kg_text", **misses(1))

# ---------------------------------------------------------------- definitions
_TT = dict(tt="""SELECT g.item_id, g.pos, g.h, g.r, g.t, coalesce(a.fine, 'Thing') AS head_type, CASE WHEN g.r = 'isA' THEN 'Thing' ELSE coalesce(b.fine, 'Thing') END
    AS tail_type FROM kg_gold g LEFT JOIN sd_entities a ON a.item_id = g.item_id AND a.entity = g.h LEFT JOIN sd_entities b ON b.item_id = g.item_id AND b.entity = g.t""")
ORACLE["sd_typed_triples"] = V("SELECT r, head_type, tail_type, count(*) AS n FROM tt GROUP BY ALL", "kg_gold", "sd_entities", **_TT)
ORACLE["sd_missing_fallback"] = V("""SELECT fine, inferred, count(*) AS n, CAST(sum(length(d)) AS BIGINT) AS chars FROM (
    SELECT fine, false AS inferred, description AS d FROM sd_entities UNION ALL
    SELECT 'Thing', true, e || ' is an entity inferred from the text.' FROM (SELECT item_id, h AS e FROM kg_gold UNION SELECT item_id, t FROM kg_gold) x
      WHERE NOT EXISTS (SELECT 1 FROM sd_entities s WHERE s.item_id = x.item_id AND s.entity = x.e)) GROUP BY ALL""", "kg_gold", "sd_entities")
ORACLE["sd_relation_match"] = V("""SELECT r, relation_type, count(*) AS n FROM (
    SELECT item_id, r, 'event' AS relation_type FROM tt WHERE pos % 3 <> 1 UNION ALL
    SELECT item_id, r, 'unknown' FROM (SELECT DISTINCT item_id, head_type, r, tail_type FROM tt) x WHERE NOT EXISTS
      (SELECT 1 FROM tt y WHERE y.item_id = x.item_id AND y.r = x.r AND y.head_type = x.head_type AND y.tail_type = x.tail_type AND y.pos % 3 <> 1)) GROUP BY ALL""",
    "kg_gold", "sd_entities", **_TT)
ORACLE["ontology_split"] = V("""SELECT CASE WHEN contains(lower(r2), 'isa') OR contains(lower(r2), 'is_a') THEN 'ontology' ELSE 'kept' END AS part, r2 AS r, count(*) AS n
    FROM (SELECT CASE pos WHEN 2 THEN 'isA' WHEN 3 THEN 'hasDisability' ELSE r END AS r2 FROM kg_pred WHERE case_id = 1) GROUP BY ALL""", "kg_pred")
_COV = dict(cv="""SELECT p.item_id, p.r, d.r IS NOT NULL AS ok FROM kg_pred p LEFT JOIN (SELECT DISTINCT item_id, r FROM kg_gold WHERE pos % 2 = 0) d
    ON d.item_id = p.item_id AND d.r = p.r WHERE case_id = 1""")
ORACLE["sd_coverage"] = V("""SELECT round(avg(x), 6) AS mean, round(median(x), 6) AS median FROM (SELECT item_id, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS x
    FROM cv GROUP BY 1)""", "kg_pred", **_COV)
ORACLE["sd_relation_coverage"] = V("SELECT r, count(*) AS n, round(count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM cv GROUP BY 1", "kg_pred", **_COV)

# ---------------------------------------------------------------- schema over time
_DV = dict(dv_="""SELECT case_id, item_id, pos, r, pos % 2 = 0 AS defined, CASE WHEN (item_id + pos) % 19 = 0 THEN NULL WHEN r = 'partOf' THEN 'partOf'
    WHEN r = 'situatedIn' THEN 'locatedIn' ELSE regexp_replace(r, '([a-z])Of$', '\\1') END AS pred FROM kg_pred""")
ORACLE["identity_rate"] = V(f"""SELECT case_id, count(*) AS n_triples, round(count(*) FILTER (WHERE pred = r) / CAST(count(*) AS DOUBLE), 6) AS identity_all,
    round(count(*) FILTER (WHERE pred = r AND NOT defined) / CAST(count(*) FILTER (WHERE NOT defined) AS DOUBLE), 6) AS identity_missing_definition
    FROM dv_ GROUP BY 1""", "kg_pred", **_DV)
ORACLE["name_entropy"] = V("""SELECT case_id, pred, CAST(sum(c) AS BIGINT) AS n, round(-sum(c / CAST(n AS DOUBLE) * ln(c / CAST(n AS DOUBLE))), 6) + 0.0 AS entropy FROM
    (SELECT case_id, pred, r, count(*) AS c, sum(count(*)) OVER (PARTITION BY case_id, pred) AS n FROM dv_ WHERE pred IS NOT NULL GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "kg_pred", **_DV)
_GR = dict(st="SELECT item_id AS since, count(*) AS added FROM (SELECT relation, min(item_id) AS item_id FROM open_rel GROUP BY 1) GROUP BY 1")
ORACLE["schema_growth"] = V("SELECT since, added, CAST(sum(added) OVER (ORDER BY since) AS BIGINT) AS size FROM st", "open_rel", **_GR)
ORACLE["schema_stability"] = V("SELECT count(*) - 1 AS n_steps, CAST(1.0 AS DOUBLE) AS lowest FROM st", "open_rel", **_GR)
ORACLE["schema_prefix_as_of_n"] = V("""SELECT relation AS r, row_number() OVER (ORDER BY position) - 1 AS ord FROM (SELECT relation, min(position) AS position
    FROM open_rel WHERE item_id < (SELECT count(*) // 2 FROM orders) GROUP BY 1)""", "open_rel")
ORACLE["schema_merge"] = V("""SELECT relation AS name,
    CASE WHEN ord % 3 <> 0 AND ord % 2 = 0 THEN 'old ' || relation WHEN ord % 3 <> 1 THEN 'new ' || relation END AS definition, 'Order' AS head_type,
    CASE WHEN ord % 3 <> 0 THEN 'Part' WHEN ord % 5 = 0 THEN 'Item' ELSE 'Part' END AS tail_type, ord % 3 = 2 AND ord % 5 = 0 AS conflict,
    CASE ord % 3 WHEN 0 THEN 'b ' || relation || ',shared' WHEN 1 THEN 'a ' || relation || ',shared' ELSE 'a ' || relation || ',shared,b ' || relation END AS aliases,
    CASE ord % 3 WHEN 0 THEN 'y ' || relation || ',shared' WHEN 1 THEN 'x ' || relation || ',shared' ELSE 'x ' || relation || ',shared,y ' || relation END AS examples
    FROM (SELECT relation, row_number() OVER (ORDER BY relation) AS ord FROM (SELECT DISTINCT relation FROM open_rel))""", "open_rel")
ORACLE["schema_precision"] = V("""SELECT count(*) AS n_pred, count(g) AS n_hit, round(count(g) / CAST(count(*) AS DOUBLE), 6) AS precision FROM
    (SELECT DISTINCT lower(r) AS p FROM rels) LEFT JOIN (SELECT lower(relation) AS g FROM slots) ON g = p""", "kg_pred", "slots", rels=RELS)
ORACLE["schema_gold_coverage"] = V("""SELECT count(*) AS n_gold, count(relation) AS n_covered, string_agg(r, ',' ORDER BY r) FILTER (WHERE relation IS NULL) AS missing,
    round(count(relation) / CAST(count(*) AS DOUBLE), 6) AS coverage FROM (SELECT DISTINCT r FROM kg_gold) LEFT JOIN (SELECT relation FROM slots WHERE ord < 5) ON relation = r""",
    "kg_gold", "slots")
ORACLE["schema_retype"] = V("""SELECT relation, CASE WHEN relation IN ('locatedIn', 'partOf') THEN 'Place' ELSE head_type END AS head_type,
    CASE WHEN relation IN ('locatedIn', 'partOf') THEN 'Place' ELSE tail_type END AS tail_type FROM slots""", "slots")

# ---------------------------------------------------------------- agreement
_KAPPA = """SELECT n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa, CASE WHEN (po - pe) / (1 - pe) >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS gate
    FROM (SELECT count(*) AS n, avg(CASE WHEN quality = toxic THEN 1.0 ELSE 0.0 END) AS po,
            avg(quality) * avg(toxic) + (1 - avg(quality)) * (1 - avg(toxic)) AS pe FROM labels)"""
ORACLE["cohen_kappa"] = _KAPPA
_RATE = dict(rt="""SELECT doc_id AS id, a AS annotator, (['Person', 'Place', 'person_name'])[v + 1] AS label FROM (
    SELECT doc_id, 'a1' AS a, quality AS v FROM labels UNION ALL SELECT doc_id, 'a2', toxic FROM labels UNION ALL SELECT doc_id, 'a3', CAST(doc_id % 3 AS INTEGER) FROM labels)""")
ORACLE["fleiss_kappa"] = V("""SELECT n, round(pbar, 6) AS agreement, round((pbar - pe) / (1 - pe), 6) AS kappa FROM
    (SELECT count(*) AS n, avg((sq - 3) / CAST(6 AS DOUBLE)) AS pbar FROM (SELECT id, sum(v * v) AS sq FROM (SELECT id, label, count(*) AS v FROM rt GROUP BY 1, 2) GROUP BY 1)),
    (SELECT sum(p * p) AS pe FROM (SELECT count(*) / CAST((SELECT count(*) FROM rt) AS DOUBLE) AS p FROM rt GROUP BY label))""", **_RATE)
_VOTES = dict(_RATE, vt="SELECT id, label, count(*) AS v FROM rt GROUP BY 1, 2")
ORACLE["majority_vote"] = V("""SELECT id, CASE WHEN max(v) > 1 THEN arg_max(label, v) END AS label, CAST(sum(v) AS BIGINT) AS n_votes,
    CASE WHEN count(*) = 1 THEN 'unanimous' WHEN max(v) > 1 THEN 'majority' ELSE 'tied' END AS status FROM vt GROUP BY 1""", **_VOTES)
ORACLE["jury_verdict"] = V("SELECT id, arg_min(label, (-v, label)) AS verdict FROM vt GROUP BY 1", **_VOTES)
_COLL = dict(_VOTES, fq="SELECT label, count(*) AS n FROM rt GROUP BY 1",
             cl="""SELECT a.label AS label_1, b.label AS label_2, CAST(sum(a.v * b.v) AS BIGINT) AS collisions FROM vt a JOIN vt b ON a.id = b.id AND a.label < b.label GROUP BY 1, 2""")
ORACLE["label_collisions"] = V("""SELECT label_1, label_2, collisions, x.n AS n_1, y.n AS n_2, CASE WHEN x.n >= y.n THEN label_1 ELSE label_2 END AS suggested
    FROM cl JOIN fq x ON x.label = label_1 JOIN fq y ON y.label = label_2""", **_COLL)
ORACLE["synonym_tier"] = V("""SELECT label_1, label_2, CASE WHEN levenshtein(regexp_replace(lower(label_1), '[^a-z0-9]', '', 'g'), regexp_replace(lower(label_2), '[^a-z0-9]', '', 'g')) <= 2
    THEN 'T1_typo' WHEN label_1 = 'Person' AND label_2 = 'person_name' THEN 'T2_morph' WHEN collisions >= 2 THEN 'T3_semantic' ELSE 'T4_weak' END AS tier FROM cl""", **_COLL)
ORACLE["reconcile_labels"] = V("""SELECT annotator, CASE WHEN hit AND label = 'person_name' THEN 'Person' ELSE label END AS label, count(*) AS n,
    count(*) FILTER (WHERE hit AND label = 'person_name') AS rewrites FROM (SELECT *, bool_or(label = 'Person') OVER (PARTITION BY id) AND
      bool_or(label = 'person_name') OVER (PARTITION BY id) AS hit FROM rt) GROUP BY ALL""", **_RATE)
ORACLE["signal_disagreement"] = V("""SELECT k > 1 AS disagree, k AS n_types, count(*) AS n FROM (SELECT item_id, entity, count(DISTINCT pred) AS k FROM ec GROUP BY 1, 2
    HAVING count(DISTINCT ec_case) = 3) GROUP BY ALL""", "ec")
_SB = dict(
    sb="SELECT CAST(item_id % 2 AS VARCHAR) AS s, pred, fine AS gold FROM ec WHERE ec_case = 3",
    em="SELECT s AS case_id, pred, gold FROM sb UNION ALL SELECT 'ALL', pred, gold FROM sb", ecells=_ECELLS)
ORACLE["stratified_bcubed"] = V(f"""SELECT case_id AS stratum, round(p, 6) AS bcubed_p, round(r, 6) AS bcubed_r, round({f1('p', 'r')}, 6) AS bcubed_f1 FROM (
    SELECT case_id, sum(CAST(o * o AS DOUBLE) / np) / max(n) AS p, sum(CAST(o * o AS DOUBLE) / ng) / max(n) AS r FROM ecells GROUP BY 1)""", "ec", **_SB)
_RUNS = dict(
    ru="""SELECT event_id % 2 * 2 + 1 AS mode, 'f1' AS metric, CASE WHEN event_type = 'click' THEN 'case1_embed' ELSE 'case_' || event_type END AS "case",
        user_id % 5 AS seed, avg(value) AS value FROM events GROUP BY ALL""",
    su='SELECT mode, metric, "case", count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std FROM ru GROUP BY ALL')
ORACLE["seed_mean_std"] = V('SELECT mode, metric, "case", n, round(mean, 6) AS mean, round(std, 6) AS std FROM su', **_RUNS)
_RK = dict(_RUNS, rk="""SELECT *, row_number() OVER (PARTITION BY mode, metric ORDER BY mean DESC, "case") AS k FROM su WHERE "case" <> 'case1_embed'""")
ORACLE["winner_verdict"] = V("""SELECT a.mode, a.metric, a."case" AS winner, b."case" AS runner_up, round(a.mean - a.std - b.mean - b.std, 6) AS margin,
    CASE WHEN a.mean - a.std - b.mean - b.std > 0 THEN 'CONFIRMED' ELSE 'NOT_SEPARATED' END AS verdict FROM rk a JOIN rk b ON a.mode = b.mode AND a.metric = b.metric
    AND a.k = 1 AND b.k = 2""", **_RK)
ORACLE["mode_gap"] = V("""SELECT a.metric, a."case" AS case_low, b."case" AS case_high, round(b.mean - a.mean, 6) AS gap, round(sqrt(a.std * a.std + b.std * b.std), 6) AS std,
    b.mean - a.mean - sqrt(a.std * a.std + b.std * b.std) > 0 AS real FROM rk a JOIN rk b ON a.metric = b.metric AND a.mode = 1 AND b.mode = 3 AND a.k = 1 AND b.k = 1""", **_RK)
ORACLE["best_case"] = V("""SELECT run, arg_max("case", value) FILTER (WHERE "case" <> 'case1_embed') AS best, round(max(value) FILTER (WHERE "case" <> 'case1_embed'), 6) AS best_value,
    round(max(value) FILTER (WHERE "case" = 'case1_embed'), 6) AS baseline, round(max(value) FILTER (WHERE "case" <> 'case1_embed') - max(value) FILTER (WHERE "case" = 'case1_embed'), 6) AS delta
    FROM (SELECT mode * 10 + seed AS run, "case", value FROM ru) GROUP BY 1""", **_RUNS)
ORACLE["column_winners"] = V('SELECT mode, metric, "case", round(mean, 6) = max(round(mean, 6)) OVER (PARTITION BY mode, metric) AS winner FROM su', **_RUNS)
ORACLE["run_difference"] = V("""SELECT CASE WHEN a.item_id IS NULL THEN 'only_b' WHEN b.item_id IS NULL THEN 'only_a' WHEN a.r = b.r THEN 'same' ELSE 'changed' END AS status,
    count(*) AS n FROM (SELECT * FROM kg_pred WHERE case_id = 1) a FULL JOIN (SELECT * FROM kg_pred WHERE case_id = 2) b ON a.item_id = b.item_id AND a.pos = b.pos GROUP BY 1""", "kg_pred")
ORACLE["stage_tokens"] = """SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS seconds, round(sum(value) / (SELECT count(*) FROM orders), 6) AS per_item,
    round(sum(value) * 1000 / (SELECT count(*) FROM orders), 4) AS per_1k FROM events GROUP BY 1"""
ORACLE["stage_windows"] = """SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type AS stage, count(*) AS n, round(sum(value), 4) AS seconds
    FROM events GROUP BY ALL"""

# ---------------------------------------------------------------- grounding
_TREE = dict(
    pb="SELECT p_brand, min(p_type) AS p_type FROM part GROUP BY 1",
    tree="""SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'Place' FROM region
        UNION SELECT p_brand, p_type FROM pb UNION SELECT p_type, 'Product' FROM pb""",
    clo="""SELECT child AS node, child AS anc FROM tree UNION SELECT parent, parent FROM tree UNION SELECT clo.node, tree.parent FROM clo JOIN tree ON tree.child = clo.anc""")
ORACLE["ancestor_closure"] = V("SELECT node, anc AS ancestor FROM clo", recursive=True, **_TREE)
ORACLE["kb_slot_status"] = V("""SELECT 'tail' AS slot, status, count(*) AS n FROM (SELECT s.c_name, CASE WHEN a.al IS NULL THEN 'unverified' WHEN a.al = s.cls THEN 'confirmed'
      WHEN EXISTS (SELECT 1 FROM clo WHERE node = s.cls AND anc = a.al) THEN 'narrower' WHEN EXISTS (SELECT 1 FROM clo WHERE node = a.al AND anc = s.cls) THEN 'broader'
      ELSE 'mismatch' END AS status
    FROM (SELECT c_name, CASE WHEN c_custkey % 9 = 0 THEN 'Place' ELSE n_name END AS cls FROM customer JOIN nation ON c_nationkey = n_nationkey) s
    JOIN (SELECT c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN n_name WHEN c_mktsegment <> 'MACHINERY' THEN r_name END AS al
          FROM customer JOIN nation ON n_nationkey = c_custkey % 25 JOIN region ON n_regionkey = r_regionkey) a USING (c_name)) GROUP BY 2""", recursive=True, **_TREE)
ORACLE["most_specific_type"] = """SELECT c_name AS entity, CASE WHEN n_regionkey < 3 THEN 'T_' || n_name ELSE 'T_' || r_name END AS type
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""
ORACLE["property_resolution"] = """SELECT relation, prop, coalesce(via, 'none') AS via FROM (SELECT DISTINCT p_name AS relation FROM part) LEFT JOIN (
    SELECT name AS relation, via, arg_min(prop, (NOT con, ord)) AS prop FROM (SELECT p_name AS name, 'P' || p_partkey AS prop, p_partkey AS ord, p_size > 40 AS con,
        CASE WHEN p_name LIKE '%ring%' THEN 'label' ELSE 'alias' END AS via FROM part WHERE p_name LIKE '%ring%' OR p_name LIKE '%widget%')
      WHERE via = 'label' OR name NOT IN (SELECT p_name FROM part WHERE p_name LIKE '%ring%') GROUP BY 1, 2) USING (relation)"""
_ROLES = dict(ro="""SELECT surface, bool_or(h) AS h, bool_or(NOT h) AS t FROM (SELECT trim(h) AS surface, true AS h FROM kg_gold UNION ALL SELECT trim(t), false FROM kg_gold) GROUP BY 1""")
ORACLE["surface_roles"] = V("SELECT CASE WHEN h AND t THEN 'head,tail' WHEN h THEN 'head' ELSE 'tail' END AS roles, count(*) AS n FROM ro GROUP BY 1", "kg_gold", **_ROLES)
_LINK = dict(
    _ROLES,
    ca="""SELECT c_name AS surface, 'Q' || c_custkey AS kb_id, c_custkey AS ord, 'label' AS via FROM customer WHERE c_mktsegment < 'H'
        UNION ALL SELECT p_name, 'Q' || p_partkey, p_partkey, 'alias' FROM part UNION ALL SELECT n_name, 'Q' || n_nationkey, n_nationkey, 'search' FROM nation""",
    ty="SELECT 'Q' || p_partkey AS kb_id, CASE WHEN p_size > 45 THEN p_type END AS type, true AS classed FROM part",
    bst="""SELECT surface, count(*) AS n, any_value(via) AS via, arg_min(kb_id, (type IS NULL, classed IS NULL, ord)) AS kb_id,
        arg_min(coalesce(type, '~'), (type IS NULL, classed IS NULL, ord)) AS type, bool_or(classed) AS classed FROM ca LEFT JOIN ty USING (kb_id) GROUP BY 1""",
    lk="""SELECT surface, CASE WHEN NOT lit THEN kb_id END AS kb_id, CASE WHEN NOT lit THEN nullif(type, '~') END AS schema_type,
        CASE WHEN lit THEN 'literal' WHEN kb_id IS NULL THEN 'unlinked' WHEN type <> '~' THEN 'linked' WHEN classed IS NULL THEN 'no_p31' WHEN n > 1 THEN 'ambiguous'
          ELSE 'no_type_match' END AS status, CASE WHEN NOT lit THEN via END AS link_via, CASE WHEN lit THEN 0 ELSE coalesce(n, 0) END AS n_candidates
        FROM (SELECT surface, regexp_matches(surface, '^[-+]?[0-9.,]+(\\s*\\(.*\\))?$') AS lit FROM ro) LEFT JOIN bst USING (surface)""")
ORACLE["entity_link_cascade"] = V("SELECT * FROM lk", "kg_gold", **_LINK)
ORACLE["link_report"] = V("""SELECT status, count(*) AS n, round((SELECT count(*) FROM lk WHERE status = 'linked') / CAST((SELECT count(*) FROM lk WHERE status <> 'literal') AS DOUBLE), 6)
    AS entity_coverage FROM lk GROUP BY 1""", "kg_gold", **_LINK)
ORACLE["redirect_types"] = V("""SELECT surface, CASE WHEN nm IS NOT NULL THEN 'T_' || r_name END AS schema_type, CASE WHEN m.c_name IS NOT NULL THEN nm END AS via_redirect,
    CASE WHEN regexp_matches(surface, '^[-+]?[0-9.,]+(\\s*\\(.*\\))?$') THEN 'literal' WHEN nm IS NULL THEN 'unlinked' ELSE 'linked' END AS status
    FROM ro LEFT JOIN (SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'HOUSEHOLD') m ON m.c_name = surface
    LEFT JOIN (SELECT n_name AS nm, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) ON nm = coalesce(m.n_name, surface)""", "kg_gold", **_ROLES)

# ---------------------------------------------------------------- corpora and samples
_NT = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
ORACLE["pool_guards"] = f"""SELECT doc_id AS ord, md5(text) AS digest FROM (SELECT *, row_number() OVER (PARTITION BY {_NT} ORDER BY doc_id) AS k FROM documents
    WHERE {_NT} <> '' AND {_NT} NOT IN (SELECT {_NT} FROM benchmark UNION ALL SELECT {_NT} FROM documents WHERE source = 'src3')) WHERE k = 1"""
ORACLE["uniform_sample"] = "SELECT least(count(*), 100) AS n, least(count(*), 100) AS n_distinct FROM documents"
ORACLE["nested_fractions"] = """SELECT fraction, count(*) AS n FROM (SELECT CASE WHEN k <= 20 THEN 'small' WHEN k <= 60 THEN 'medium' WHEN k <= 120 THEN 'large' ELSE 'rest' END AS fraction
    FROM (SELECT row_number() OVER () AS k FROM documents)) GROUP BY 1"""
ORACLE["length_diff_filter"] = V("""SELECT n_a, n_b, count(*) AS n FROM (SELECT item_id, count(*) AS n_a FROM kg_gold GROUP BY 1) JOIN
    (SELECT item_id, count(*) AS n_b FROM kg_pred WHERE case_id = 1 GROUP BY 1) USING (item_id) WHERE abs(n_a - n_b) <= 1 GROUP BY ALL""", "kg_pred")
ORACLE["chunk_sequence"] = """SELECT CAST(conv_id AS VARCHAR) AS title, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq,
    md5(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS digest FROM conversations"""
ORACLE["coref_rewrite"] = V("""SELECT item_id, CASE WHEN item_id % 6 = 0 THEN replace(text, 'It was', replace(c_name, '#', '') || ' was') ELSE text END AS text
    FROM kg_text JOIN order_facts USING (item_id)""", "kg_text")
