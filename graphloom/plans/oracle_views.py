"""The derived views once more as DuckDB common table expressions, for the independent SQL check."""

from __future__ import annotations

from graphloom.plans.derived import CASE_IDS, RELATIONS, SLOT_TYPES

CASES_SQL = ", ".join(f"({c})" for c in CASE_IDS)


def norm_entity(x):
    x = f"regexp_replace(trim({x}), '^\"+|\"+$', '', 'g')"
    x = f"regexp_replace({x}, '^''+|''+$', '', 'g')"
    x = f"regexp_replace(regexp_replace({x}, ',_?', '_', 'g'), '\\s+', '_', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9_]', '', 'g'), '_+', '_', 'g')"
    return f"lower(trim({x}, '_'))"


def camel(x):
    return f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def norm_relation(x):
    return f"lower(trim(regexp_replace(regexp_replace({camel(x)}, '[_/-]', ' ', 'g'), '\\s+', ' ', 'g')))"


def strip_quotes(x):
    return (f"regexp_replace(regexp_replace(trim({x}), '^\"+|\"+$', '', 'g'), '^''+|''+$', '', 'g')")


def norm_open(x):
    return (f"lower(trim(regexp_replace(regexp_replace({camel(strip_quotes(x))}, '[_-]', ' ', 'g'), "
            f"'\\s+', ' ', 'g')))")


def fold(x):
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def ratio(a, b, empty="0.0"):
    return f"(CASE WHEN ({b}) = 0 THEN CAST({empty} AS DOUBLE) ELSE CAST({a} AS DOUBLE) / ({b}) END)"


def f1(p, r):
    return f"(CASE WHEN ({p}) + ({r}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE 2 * ({p}) * ({r}) / (({p}) + ({r})) END)"


def dot(a, b):
    return f"list_dot_product({a}, {b})"


def unit(v):
    return f"list_transform({v}, lambda x: x / sqrt({dot(v, v)}))"


def hash_vec(x):
    """Hashed character trigrams as a unit vector (same rule as the hashing provider)."""
    s = f"(' ' || {x} || ' ')"
    slots = (f"list_transform(range(1, length({s}) - 1), lambda i: (unicode(substr({s}, i, 1)) * 961 + "
             f"unicode(substr({s}, i + 1, 1)) * 31 + unicode(substr({s}, i + 2, 1))) % 64)")
    return slots


SLOTS_SQL = ", ".join(f"({i}, '{r}', '{h}', '{t}', 'the {h} has the {t} by {r}')"
                      for i, (r, (h, t)) in enumerate(SLOT_TYPES.items()))
RELS_SQL = "[" + ", ".join(f"'{r}'" for r in RELATIONS) + "]"
N_REL = len(RELATIONS)

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "order_facts": ((), """
        SELECT o_orderkey AS item_id, c_name, n_name, r_name, o_orderpriority,
               strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderdate, printf('%.2f', o_totalprice) AS price,
               o_totalprice, 'Order_' || o_orderkey AS order_name
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey"""),
    "kg_text": (("order_facts",), """
        SELECT item_id, replace(c_name, '#', '') || ' from ' || n_name
               || CASE WHEN item_id % 4 = 0 THEN '' ELSE ' in ' || r_name END
               || ' placed ' || order_name || ' on ' || strftime(o_orderdate, '%B %-d, %Y')
               || ' for ' || format('{:,.2f}', o_totalprice) || '.'
               || CASE WHEN item_id % 6 = 0 THEN ' It was shipped.' ELSE '' END AS text
        FROM order_facts"""),
    "kg_gold": (("order_facts",), """
        SELECT item_id, 0 AS pos, c_name AS h, 'placedOrder' AS r, order_name AS t FROM order_facts
        UNION ALL SELECT item_id, 1, c_name, 'locatedIn', n_name FROM order_facts
        UNION ALL SELECT item_id, 2, n_name, 'partOf', r_name FROM order_facts
        UNION ALL SELECT item_id, 3, order_name, 'hasPriority', o_orderpriority FROM order_facts
        UNION ALL SELECT item_id, 4, order_name, 'orderedOn', day FROM order_facts
        UNION ALL SELECT item_id, 5, order_name, 'totalPrice', price FROM order_facts
        UNION ALL SELECT l_orderkey, 5 + row_number() OVER (PARTITION BY l_orderkey
                ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate),
               'Order_' || l_orderkey, 'containsPart', p_name FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "kg_pred": (("kg_gold",), f"""
        SELECT case_id, item_id, pos,
               CASE k WHEN 5 THEN replace(upper(h), ' ', '_') WHEN 8 THEN t ELSE h END AS h,
               CASE WHEN k = 6 THEN CASE r WHEN 'locatedIn' THEN 'situatedIn' WHEN 'partOf' THEN 'locatedIn'
                    ELSE r || 'Of' END ELSE r END AS r,
               CASE k WHEN 8 THEN h WHEN 9 THEN t || ' unit' ELSE t END AS t
        FROM (SELECT *, (item_id * 7 + pos * 3 + case_id) % 10 AS k
              FROM kg_gold, (VALUES {CASES_SQL}) c(case_id)) WHERE k <> 7"""),
    "kg_trace": (("kg_pred",), f"""
        SELECT case_id, item_id, pos, h, r, t, r AS pred,
               CASE WHEN item_id % 2 = 1 THEN list_slice(rot, 1, 4) ELSE rot END AS top_k
        FROM (SELECT *, list_concat(list_slice({RELS_SQL}, s + 1, {N_REL}), list_slice({RELS_SQL}, 1, s)) AS rot
              FROM (SELECT *, CAST((item_id + pos + case_id) % {N_REL} AS INTEGER) AS s FROM kg_pred))"""),
    "slots": ((), f"""
        SELECT * FROM (VALUES {SLOTS_SQL}) s(ord, relation, head_type, tail_type, definition)"""),
    "gold_k": (("kg_gold",), f"""
        SELECT item_id, r, {norm_entity('h')} AS nh, {norm_entity('t')} AS nt, pos,
               row_number() OVER (PARTITION BY item_id, {norm_entity('h')}, {norm_entity('t')} ORDER BY pos) AS k
        FROM kg_gold"""),
    "pred_k": (("kg_pred",), f"""
        SELECT case_id, item_id, r, {norm_entity('h')} AS nh, {norm_entity('t')} AS nt, pos,
               row_number() OVER (PARTITION BY case_id, item_id, {norm_entity('h')}, {norm_entity('t')}
                                  ORDER BY pos) AS k
        FROM kg_pred"""),
    "mentions": (("gold_k", "pred_k"), """
        SELECT p.case_id, p.item_id, p.r AS pred, g.r AS gold FROM pred_k p JOIN gold_k g
        USING (item_id, nh, nt, k)"""),
    "cells": (("mentions",), """
        SELECT *, sum(o) OVER (PARTITION BY case_id, pred) AS np, sum(o) OVER (PARTITION BY case_id, gold) AS ng,
               sum(o) OVER (PARTITION BY case_id) AS n
        FROM (SELECT case_id, pred, gold, count(*) AS o FROM mentions GROUP BY ALL)"""),
    "pair_sums": (("cells",), """
        SELECT a.case_id, both_, same_pred, same_gold, n, n_pred, n_gold FROM
          (SELECT case_id, CAST(sum(o * (o - 1) / 2) AS DOUBLE) AS both_, max(n) AS n, count(DISTINCT pred) AS n_pred,
                  count(DISTINCT gold) AS n_gold FROM cells GROUP BY 1) a
          JOIN (SELECT case_id, CAST(sum(np * (np - 1) / 2) AS DOUBLE) AS same_pred FROM
                (SELECT DISTINCT case_id, pred, np FROM cells) GROUP BY 1) b USING (case_id)
          JOIN (SELECT case_id, CAST(sum(ng * (ng - 1) / 2) AS DOUBLE) AS same_gold FROM
                (SELECT DISTINCT case_id, gold, ng FROM cells) GROUP BY 1) c USING (case_id)"""),
    "sd_entities": (("order_facts",), """
        SELECT item_id, 0 AS pos, c_name AS entity, 'Agent' AS coarse, 'Customer' AS fine,
               c_name || ' is a customer' AS description FROM order_facts
        UNION ALL SELECT item_id, 1, order_name, 'Event', 'Order', order_name || ' is an order' FROM order_facts
        UNION ALL SELECT item_id, 2, n_name, 'Place', 'Nation', n_name || ' is a nation' FROM order_facts
        UNION ALL SELECT item_id, 3, r_name, 'Place', 'Region', r_name || ' is a region' FROM order_facts"""),
    "part_ents": ((), """
        SELECT l_orderkey AS item_id, row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, p_name || ' ' || p_partkey AS entity,
               CASE p_size % 3 WHEN 0 THEN 'Good' WHEN 1 THEN 'Tool' ELSE '' END AS coarse, p_name AS fine,
               'made for ' || lower(p_type) || ' use' AS description
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "type_groups": (("part_ents",), """
        SELECT *, row_number() OVER (ORDER BY item_id, ord) AS position FROM (
          SELECT item_id, fine, min(pos) AS ord, arg_min(description, pos) AS definition, arg_min(coarse, pos) AS parent, list(entity) AS members
          FROM part_ents GROUP BY 1, 2)"""),
    "ec": (("sd_entities",), f"""
        SELECT ec_case, item_id, pos AS ord, fine, coarse, entity,
               CASE WHEN ec_case > 1 AND item_id % 3 = 0 AND fine = 'Nation' THEN 'Region'
                    WHEN ec_case = 3 AND item_id % 5 = 0 AND fine = 'Order' THEN 'Event' ELSE fine END AS pred
        FROM sd_entities, (VALUES {CASES_SQL}) c(ec_case)"""),
    "schema_v": ((), """
        SELECT vec_id AS ord, 'rel_' || vec_id AS name, CAST(embedding AS DOUBLE[]) AS vec,
               'T' || (label % 3) AS head_type, 'T' || (label % 2) AS tail_type,
               CASE WHEN label % 5 = 0 THEN '' ELSE 'P' || (label % 2) END AS parent FROM embeddings"""),
    "query_v": (("schema_v",), f"""
        SELECT qid, {unit('raw')} AS vec, tail_type, CASE WHEN qid % 7 = 0 THEN 'TX' ELSE head_type END AS head_type,
               CASE WHEN qid % 4 = 0 THEN 'P0' ELSE parent END AS parent
        FROM (SELECT a.ord AS qid, a.head_type, a.tail_type, a.parent,
                     list_transform(list_zip(a.vec, coalesce(b.vec, a.vec)), lambda p: p[1] + CAST(
                       ([0.1, 0.3, 0.35, 0.5, 0.9])[a.ord % 5 + 1] AS DOUBLE) * p[2]) AS raw
              FROM schema_v a LEFT JOIN schema_v b ON b.ord = xor(a.ord, 1))"""),
    "pool": (("schema_v", "query_v"), """
        SELECT *, 'rel_' || ord AS name FROM
          (SELECT ord * 2 AS ord, vec FROM schema_v UNION ALL SELECT qid * 2 + 1, vec FROM query_v)"""),
    "open_rel": ((), """
        SELECT (l_orderkey << 20) + row_number() OVER (PARTITION BY l_orderkey
                 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS position,
               l_orderkey AS item_id,
               lower(p_name || ' ' || replace(p_brand, 'Brand#', 'brand ')) AS relation
        FROM lineitem JOIN part ON l_partkey = p_partkey"""),
}


# Views a recursive step looks up again and again.
MATERIAL = ("pts", "adj", "sym", "pairs", "kv", "lv", "dv", "sf", *(f"{v}_{i}" for v in ("pts", "adj", "kv") for i in range(3)),
            *(f"{v}_{i}" for v in ("st", "nn", "mg") for i in range(40)))


def with_views(select: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """``WITH`` clause of the named views and everything they need, extra expressions, then the select."""
    order: list[str] = []

    def visit(name):
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [
        f"{n} AS {'MATERIALIZED ' if n in MATERIAL else ''}({sql})" for n, sql in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {select}"


def trigram_vectors(source: str, column: str) -> str:
    """``(text, vec)`` for the distinct texts of a view, by hashed trigrams."""
    return f"""
        SELECT text, list_transform(cnt, lambda x: x / sqrt(list_dot_product(cnt, cnt))) AS vec FROM (
          SELECT text, list_transform(range(0, 64), lambda b: CAST(len(list_filter(slots, lambda s: s = b))
                 AS DOUBLE)) AS cnt
          FROM (SELECT text, {hash_vec('text')} AS slots FROM (SELECT DISTINCT {column} AS text FROM {source})))"""
