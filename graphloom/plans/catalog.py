"""Every registered query: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.functions import literals as L, text as T, vectors as VF
from graphloom.functions.vectors import hashing_vector
from graphloom.operators import (agreement as A, canonical as C_, clustering as C, coref as CO, definitions as SD,
                                 errors as E, graphs as G, grounding as KB, growth as GR, instances as IC,
                                 pairing as P, parsing as PA, retrieval as R, sampling as SA, schemas as S,
                                 setmetrics as SM, spans as SP)
from graphloom.operators.components import connected_components
from graphloom.config import BuildConfig
from graphloom.plans import derived as D
from graphloom.plans.construct import Build
from graphloom.session import cut_lineage, ensure_checkpoint_dir
from graphloom.streaming.growth import process_batch
from graphloom.sources import corpora as CH

QUERIES: dict = {}


def run_folder(spark: SparkSession) -> str:
    """A fresh folder for a run's stage tables, in the one that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/run-{uuid.uuid4().hex}"


def query(fn):
    """Register a plan under its function name; it receives the tables of one folder."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(D.Tables(spark, folder))

    QUERIES[fn.__name__] = run
    return fn


def r6(c, name=None):
    col = F.round(F.col(c) if isinstance(c, str) else c, 6)
    return col.alias(name or c)


def longest_record(t) -> int:
    """Upper bound of a triple's list position, from one pre-aggregated pass over the line items."""
    n = t["lineitem"].groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    return (n or 0) + 6


def mentions(t):
    return P.relation_mentions(D.kg_pred(t), D.kg_gold(t), longest=longest_record(t))


@query
def mention_pairs(t):
    return mentions(t).groupBy("case_id", "pred", "gold").agg(F.count(F.lit(1)).alias("n_mentions"))


@query
def cluster_pairwise(t):
    return C.pairwise(C.contingency(mentions(t))).select(
        "case_id", "n_mentions", "n_pred_clusters", "n_gold_clusters", r6("pairwise_p"), r6("pairwise_r"),
        r6("pairwise_f1"))


@query
def cluster_bcubed(t):
    return C.bcubed(C.contingency(mentions(t))).select("case_id", r6("bcubed_p"), r6("bcubed_r"), r6("bcubed_f1"))


@query
def cluster_macro_micro(t):
    cols = ["macro_p", "macro_r", "macro_f1", "micro_p", "micro_r", "micro_f1"]
    return C.purity(C.contingency(mentions(t))).select("case_id", *[r6(c) for c in cols])


@query
def cluster_ari_nmi_v(t):
    cols = ["ari", "nmi", "v_measure", "homogeneity", "completeness", "fmi"]
    return C.information(C.contingency(mentions(t))).select("case_id", *[r6(c) for c in cols])


@query
def cluster_ami(t):
    return C.adjusted_mutual_information(C.contingency(mentions(t))).select("case_id", r6("ami"))


@query
def cluster_all_scores(t):
    return C.all_scores(mentions(t)).select("case_id", "n_mentions", r6("pairwise_f1"), r6("bcubed_f1"),
                                            r6("macro_f1"), r6("micro_f1"), r6("ari"), r6("v_measure"), r6("fmi"))


# ---------------------------------------------------------------- scalar functions

def surfaces(t):
    """Distinct entity surfaces of the reference and of all predictions."""
    both = D.kg_gold(t).select("h", "t").unionByName(D.kg_pred(t).select("h", "t"))
    return both.select(F.explode(F.array("h", "t")).alias("surface")).distinct()


def relation_names(t):
    return D.kg_gold(t).select("r").union(D.kg_pred(t).select("r")).distinct()


@query
def norm_entity(t):
    return surfaces(t).select("surface", T.norm_entity(F.col("surface")).alias("norm"))


@query
def norm_rel_words(t):
    return relation_names(t).select("r", T.norm_relation(F.col("r")).alias("norm"),
                                    T.norm_schema_relation(F.col("r")).alias("schema_norm"),
                                    T.norm_intrinsic(F.col("r")).alias("intrinsic_norm"))


@query
def oie_norm(t):
    return surfaces(t).select("surface", T.norm_open(F.col("surface")).alias("norm"))


@query
def span_words(t):
    return surfaces(t).select("surface", T.token_words(F.col("surface")).alias("norm"),
                              T.norm_definition_key(F.col("surface")).alias("definition_key"))


@query
def fold_tokens(t):
    s = F.col("surface")
    return surfaces(t).select("surface", T.fold(s).alias("folded"), T.is_temporal(s).alias("temporal"),
                              F.array_join(F.array_sort(T.fold_tokens(s)), " ").alias("tokens"))


@query
def value_literals(t):
    return surfaces(t).select("surface", T.is_value_literal(F.col("surface")).alias("literal"))


@query
def text_forms(t):
    """Unicode and white-space forms of whole document texts."""
    x = F.col("text")
    return t["documents"].select("doc_id", F.md5(T.nfc(x)).alias("nfc"), F.md5(T.deaccent(x)).alias("deaccent"),
                                 F.md5(T.norm_corpus(x)).alias("corpus"))


@query
def literal_number(t):
    # a generator's output: a filter on it stays above it, so each different surface is parsed once, not each mention
    n = F.round(L.parse_number(F.col("surface")), 6)
    return surfaces(t).select("surface", F.explode(F.array(n)).alias("number")).filter("number is not null")


@query
def literal_date(t):
    d = surfaces(t).select("surface", F.explode(F.array(L.parse_date(F.col("surface")))).alias("p")).filter("p.y is not null")
    return d.select("surface", *[F.col(f"p.{c}").cast("bigint").alias(c) for c in ("y", "m", "d")])


@query
def literal_class(t):
    s = F.col("surface")
    return surfaces(t).select("surface", L.literal_kind(s).alias("kind"), L.normalize_literal(s).alias("norm"))


@query
def literal_in_text(t):
    """Reference literals found in their record's text in another format."""
    g = D.kg_gold(t).join(D.kg_text(t), "item_id")
    return g.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(
        L.literal_realized(F.col("t"), F.col("text")), 1)).alias("n_realized"))


@query
def text_presence(t):
    """Entity and relation presence in the record text, and pronouns."""
    tok = T.text_tokens(F.col("text"))
    g = D.kg_gold(t).join(D.kg_text(t).withColumn("tok", tok), "item_id")
    return g.groupBy("r").agg(
        F.count(F.when(T.entity_in_text(T.norm_entity(F.col("h")), F.col("tok"), 0.5), 1)).alias("heads"),
        F.count(F.when(T.entity_in_text(T.norm_entity(F.col("t")), F.col("tok"), 0.5), 1)).alias("tails"),
        F.count(F.when(T.relation_grounded(F.col("r"), F.col("tok")), 1)).alias("grounded"),
        F.count(F.when(T.has_pronoun(F.col("tok")), 1)).alias("pronouns"))


# ---------------------------------------------------------------- set metrics

TAUS = (0.3, 0.4, 0.5, 0.6, 0.7)


@query
def gold_relation_set(t):
    return SM.relation_set(D.kg_gold(t))


@query
def nearest_alignment(t):
    a = SM.align_relations(D.kg_pred(t), D.kg_gold(t), hashing_vector)
    return a.select("r", "target", r6("score"))


@query
def aligned_triple_f1(t):
    s = SM.aligned_f1(D.kg_pred(t), D.kg_gold(t), hashing_vector, (0.5,))
    return s.select("case_id", "tp", "fp", "fn", "n_pred_relations", r6("precision"), r6("recall"), r6("f1"),
                    r6("coverage"))


@query
def threshold_sweep(t):
    s = SM.aligned_f1(D.kg_pred(t), D.kg_gold(t), hashing_vector, TAUS)
    return s.select("case_id", "tau", "tp", "fp", "fn", r6("f1"), r6("coverage"))


@query
def kendall_tau(t):
    s = SM.aligned_f1(D.kg_pred(t), D.kg_gold(t), hashing_vector, TAUS)
    ranked = s.select("tau", F.col("case_id").cast("string").alias("case"), F.round("f1", 6).alias("value"))
    return A.kendall_tau(ranked, 0.5).select("tau", r6("kendall_tau"))


@query
def count_parity(t):
    return SM.count_parity(D.kg_pred(t), D.kg_gold(t), ["case_id"]).select(
        "case_id", r6("count_ratio"), r6("count_coverage"))


@query
def exact_triple_macro(t):
    return SM.exact_triple_macro(D.kg_pred(t), D.kg_gold(t), D.CASE_IDS).select(
        "case_id", "n_classes", r6("precision"), r6("recall"), r6("f1"))


def one_case(t, case=1):
    return D.kg_pred(t, (case,))


def longest_texts(t) -> int:
    """Upper bound of the texts of a record's triples, heads and tails, over all cases."""
    return 2 * len(D.CASE_IDS) * longest_record(t)


@query
def greedy_match(t):
    """Open-triple entity scores per case: greedy one-to-one matches per record."""
    per = SM.open_scores(D.kg_pred(t), D.kg_gold(t), SM.entity_texts, hashing_vector, 0.7, D.CASE_IDS, longest_texts(t))
    s = SM.micro_summary(per, ["case_id"])
    return s.select("case_id", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"), r6("recall_median"),
                    r6("frac_below_half"), r6("frac_full"))


@query
def greedy_match_triples(t):
    per = SM.open_scores(D.kg_pred(t), D.kg_gold(t), SM.triple_texts, hashing_vector, 0.6, D.CASE_IDS, longest_texts(t))
    s = SM.micro_summary(per, ["case_id"])
    return s.select("case_id", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query
def entity_sweep(t):
    """Open-triple entity scores for all thresholds from 0.5 to 0.95, by one matching."""
    s = SM.open_sweep(D.kg_pred(t), D.kg_gold(t), SM.entity_texts, hashing_vector, 0.5, 0.95, 0.05, D.CASE_IDS, longest_texts(t))
    return s.select("case_id", "tau", "tp", "n_pred", "n_gold", r6("precision"), r6("recall"), r6("f1"))


@query
def triple_sweep(t):
    s = SM.open_sweep(D.kg_pred(t), D.kg_gold(t), SM.triple_texts, hashing_vector, 0.4, 0.9, 0.05, D.CASE_IDS, longest_texts(t))
    return s.select("case_id", "tau", "tp", "n_pred", "n_gold", r6("precision"), r6("recall"), r6("f1"))


# ---------------------------------------------------------------- error attribution

@query
def error_funnel(t):
    s = E.error_funnel(D.kg_gold(t), D.kg_trace(t), D.CASE_IDS, longest=len(D.CASE_IDS) * longest_record(t))
    return s.select("case_id", "n_gold", "OIE_MISS", "RETRIEVAL_MISS", "CANON_MISS", "CORRECT", "OIE_MISS_relaxed",
                    r6("recovered_pct"), r6("retr_given_recovered_pct"), r6("canon_given_retrieved_pct"))


@query
def retrieval_recall_at_k(t):
    s = E.retrieval_recall(D.kg_gold(t), D.kg_trace(t))
    return s.select("case_id", "n_triplets", "n_matched", "max_candidates", r6("coverage"), r6("gold_in_pool"),
                    r6("mean_rank"), *[r6(f"recall_{k}") for k in (1, 2, 3, 5)])


@query
def flip_pairs(t):
    return E.flip_summary(D.kg_gold(t), D.kg_trace(t), 1, 2).select(
        "both_correct", "paired_losses", "decision_errors", "retrieval_errors", "loser_wins", r6("decision_error_pct"))


@query
def flip_confusions(t):
    return E.flip_confusions(D.kg_gold(t), D.kg_trace(t), 1, 2)


def misses(t, case=1):
    return E.classify_misses(D.kg_gold(t), one_case(t, case), D.kg_text(t), longest=longest_record(t))


@query
def oie_miss_buckets(t):
    return E.miss_summary(misses(t)).select(
        "n_gold", "correct", *E.MISS_BUCKETS, "direction_swapped", "implicit_total", "implicit_missed",
        r6("surface_or_format_pct"), r6("genuine_extraction_pct"), r6("ceiling_or_linking_pct"))


@query
def oie_miss_by_length(t):
    return E.by_length(E.record_misses(misses(t), D.kg_text(t))).select(
        "bin", "n_records", r6("mean_len_char"), "n_gold", r6("miss_pct"), *[r6(f"{b}_pct") for b in E.MISS_BUCKETS])


@query
def oie_miss_by_triples(t):
    return E.by_reference_size(E.record_misses(misses(t), D.kg_text(t))).select(
        "bin", "n_records", r6("mean_len_char"), "n_gold", r6("miss_pct"), *[r6(f"{b}_pct") for b in E.MISS_BUCKETS])


@query
def oie_miss_compare(t):
    c = E.compare_misses(E.miss_summary(misses(t, 1)), E.miss_summary(misses(t, 2)))
    return c.select("measure", r6("a_pct"), r6("b_pct"), r6("delta"), "reading")


# ---------------------------------------------------------------- graphs

@query
def kg_nodes_first_type(t):
    return G.kg_nodes(D.kg_pred(t), D.slot_types(t.spark), by=["case_id"]).groupBy("case_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("id")).alias("chars"))


@query
def kg_nodes_mapped_type(t):
    types = C_.entity_type_map(D.ec_decisions(t).filter("ec_case = 2"))
    return G.kg_nodes(D.kg_pred(t), D.slot_types(t.spark), types, by=["case_id"]).groupBy("case_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("id")).alias("chars"))


@query
def kg_statistics(t):
    return G.kg_statistics(D.kg_pred(t), ["case_id"])


@query
def type_consistency(t):
    p, s = D.kg_pred(t), D.slot_types(t.spark)
    types = C_.entity_type_map(D.ec_decisions(t).filter("ec_case = 2"))
    nodes = G.kg_nodes(p, s, types, by=["case_id"])
    return G.type_consistency(p, nodes, s, ["case_id"]).select(
        "case_id", "n_checked", "n_conform", "n_uncovered", r6("conformance"))


@query
def shannon_diversity(t):
    return G.shannon(D.kg_pred(t), "r", ["case_id"]).select("case_id", "n_distinct", r6("entropy"), r6("top_share"))


@query
def conciseness(t):
    p = D.kg_pred(t)
    return G.conciseness(p.filter("case_id = 1"), p.filter("case_id = 2")).select(
        "n_relations", "n_entities", "n_raw_relations", r6("reduction"))


def one_graph(t):
    return D.kg_pred(t, (1,))


@query
def connectivity(t):
    p = one_graph(t)
    nodes = G.kg_nodes(p, D.slot_types(t.spark))
    return G.connectivity(nodes, p).select("n_nodes", "n_edges", "n_components", "n_isolated", r6("avg_degree"),
                                           r6(F.col("density") * 1000, "density_x1000"), r6("largest_fraction"))


@query
def components(t):
    """Components of the order graph alone (an order and its parts), by smallest member."""
    p = one_graph(t).filter(F.col("r").isin("placedOrder", "orderedOn", "totalPrice"))
    ids = p.select(F.col("h").alias("id")).union(p.select("t")).distinct()
    return connected_components(ids, p.select(F.col("h").alias("a"), F.col("t").alias("b")))


@query
def singleton_orphan(t):
    p = D.kg_pred(t)
    u = G.relation_usage(p, ["case_id"])
    s = G.schema_usage(p, D.slot_types(t.spark), ["case_id"])
    return u.join(s, "case_id").select("case_id", "n_triples", "n_relations", r6("avg_triples"), r6("singleton_rate"),
                                       "schema_size", "grounded", r6("orphan_rate"), r6("consistency"), r6("coverage"))


@query
def relation_utilization(t):
    return G.utilization(one_graph(t), D.slot_types(t.spark))


@query
def type_share(t):
    types = C_.entity_type_map(D.ec_decisions(t).filter("ec_case = 3"))
    nodes = G.kg_nodes(D.kg_pred(t), D.slot_types(t.spark), types, by=["case_id"])
    return G.type_share(nodes, "Event", ["case_id"])


@query
def entity_cluster_slots(t):
    m = P.entity_type_mentions(D.kg_gold(t), D.ec_decisions(t), D.slot_types(t.spark))
    cells = C.contingency(m, ["ec_case"])
    return C.pairwise(cells, ["ec_case"]).join(C.bcubed(cells, ["ec_case"]), "ec_case").select(
        "ec_case", "n_mentions", r6("pairwise_f1"), r6("bcubed_p"), r6("bcubed_r"), r6("bcubed_f1"))


@query
def entity_cluster_kb(t):
    """Entity types against types looked up per surface (customers and nations are linked)."""
    kb = D.sd_entities(t).filter("fine in ('Customer', 'Nation')").select(
        T.norm_entity(F.col("entity")).alias("surface"), F.col("coarse").alias("schema_type"),
        F.lit("linked").alias("status")).distinct()
    m = P.entity_kb_mentions(D.kg_gold(t), D.ec_decisions(t), kb)
    cells = C.contingency(m, ["ec_case"])
    return C.bcubed(cells, ["ec_case"]).select("ec_case", r6("bcubed_p"), r6("bcubed_r"), r6("bcubed_f1"))


# ---------------------------------------------------------------- similarity retrieval

def r4(c, name=None):
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name or c)


@query
def topk_cosine(t):
    return R.top_k(D.mixed_vectors(t), D.vectors(t), 5).select("qid", "name", r6("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def topk_grid(t):
    """The same retrieval on the block grid used when the schema is too large to broadcast."""
    return R.top_k(D.mixed_vectors(t), D.vectors(t), 5, broadcast_bytes=0, block_rows=256).select(
        "qid", "name", r6("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def topk_type_penalty(t):
    return R.top_k(D.mixed_vectors(t), D.vectors(t), 5, types=("head_type", "tail_type"), penalty=0.2).select(
        "qid", "name", r6("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def topk_parent_penalty(t):
    return R.top_k(D.mixed_vectors(t), D.vectors(t), 5, types=("parent",), penalty=0.2, blanks_match=True).select(
        "qid", "name", r6("score"), F.col("rank").cast("bigint").alias("rank"))


@query
def leader_clusters(t):
    lead = GR.leader_clusters(D.vector_pool(t), 0.85, strict=True)
    return lead.select(F.col("ord"), F.col("leader"))


@query
def topk_item_cluster(t):
    """Blends retrieved against the interleaved pool with cluster extras."""
    pool = D.vector_pool(t)
    clusters = GR.cluster_table(pool, GR.leader_clusters(pool, 0.85, strict=True))
    hits = R.item_and_cluster(D.mixed_vectors(t), pool, clusters, 3)
    return hits.select("qid", "name", r6("score"), F.col("rank").cast("bigint").alias("rank"), "source")


def fused_parts(t):
    v = D.vectors(t).select("ord", "vec")
    q = D.mixed_vectors(t).select(F.col("qid").alias("ord"), F.col("vec").alias("q_vec"))
    near = v.select((F.col("ord").bitwiseXOR(F.lit(1).cast("bigint"))).alias("ord"), F.col("vec").alias("n_vec"))
    return v.join(q, "ord").join(near, "ord", "left").withColumn("n_vec", F.coalesce("n_vec", "vec"))


@query
def fuse_concat(t):
    f = VF.fuse_concat(F.col("vec"), F.col("q_vec"), F.col("n_vec"), F.col("vec"))
    return fused_parts(t).withColumn("f", f).select("ord", F.size("f").cast("bigint").alias("dim"), r6(F.col("f")[0], "first"),
                                                    r6(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), "total"))


@query
def fuse_weighted(t):
    f = VF.fuse_weighted(F.col("vec"), F.col("q_vec"), F.col("n_vec"), F.col("vec"))
    return fused_parts(t).withColumn("f", f).select("ord", F.size("f").cast("bigint").alias("dim"), r6(F.col("f")[0], "first"),
                                                    r6(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), "total"))


@query
def redundancy_nn(t):
    return S.semantic_redundancy(D.vector_pool(t)).select("n_relations", r6("redundancy"))


@query
def redundancy_pairs(t):
    return S.redundant_pairs(D.vector_pool(t), 0.85).select("a", "b", r6("score"))


@query
def redundancy_clusters(t):
    c = S.average_linkage_clusters(D.vector_pool(t), 0.8)
    return c.agg(F.count(F.lit(1)).alias("n_relations"), F.count_distinct("cluster").alias("n_clusters")).withColumn(
        "redundancy", F.round(1 - F.col("n_clusters") / F.col("n_relations"), 6))


def part_schema(t):
    """Every distinct part phrase as a schema element in name order."""
    w = F.row_number().over(Window.orderBy("relation")).cast("bigint")
    return D.open_relations(t).select("relation").distinct().withColumn("ord", w)


@query
def redundancy_lexical(t):
    return S.lexical_redundancy(part_schema(t)).select("n_relations", "n_redundant", r6("redundancy"))


# ---------------------------------------------------------------- canonicalization

def frozen_inputs(t):
    occ = D.mixed_vectors(t).select(F.col("qid"), F.concat(F.lit("q_"), F.col("qid").cast("string")).alias("relation"), "vec",
                                    "head_type", "tail_type", "parent")
    n = F.col("qid") % 9
    raw = (F.when(n == 0, "Answer: 3").when(n == 1, "B").when(n == 2, "none of these").when(n == 3, "12")
           .when(n == 4, "").when(n == 5, "0").when(n == 6, "A").when(n == 7, " 5. because").otherwise("1"))
    return occ, occ.select("qid", "relation", raw.alias("raw_output"), (F.col("qid") % 17 != 0).alias("answered"))


def decided(df, *cols):
    return df.select(*cols, "pred", "decision", F.array_join("names", ",").alias("candidates"))


@query
def sc_frozen(t):
    """Frozen relation policy decided by recorded answers, with the typed signal's penalty."""
    occ, asked = frozen_inputs(t)
    d = C_.canonicalize_frozen(asked, occ.drop("qid"), D.vectors(t), responses=True, types=("head_type", "tail_type"),
                               penalty=C_.TYPE_PENALTY)
    return decided(d, "qid")


@query
def sc_frozen_threshold(t):
    occ, asked = frozen_inputs(t)
    return decided(C_.canonicalize_frozen(asked, occ.drop("qid"), D.vectors(t)), "qid")


@query
def ec_frozen(t):
    occ, asked = frozen_inputs(t)
    d = C_.canonicalize_frozen(asked, occ.drop("qid"), D.vectors(t), responses=True, types=("parent",),
                               penalty=C_.TYPE_PENALTY, blanks_match=True, new_label="llm_new_entity")
    return decided(d, "qid")


def growth_inputs(t):
    occ = D.open_relations(t)
    return occ, occ.select("relation").distinct().withColumn("vec", hashing_vector(F.col("relation")))


@query
def sc_embed_threshold_fold(t):
    """Growing policy without a model: minted relation per open phrase, decided over all line items."""
    occ, keys = growth_inputs(t)
    d, _ = C_.canonicalize_growing(occ, keys, threshold=0.8)
    return d.groupBy("pred", "decision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("n_open"))


@query
def sc_seeded_fold(t):
    """Seed-and-enrich policy: the phrases of the first brand exist before the run."""
    occ, keys = growth_inputs(t)
    seed = keys.filter(F.col("relation").endswith("brand 1")).select(
        (F.row_number().over(Window.orderBy("relation")) - 1_000_000).cast("bigint").alias("ord"),
        F.col("relation").alias("name"), "vec")
    d, _ = C_.canonicalize_growing(occ, keys, seed=seed, threshold=0.8)
    return d.groupBy("pred", "decision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("n_open"))


@query
def sc_incremental(t):
    """The growing policy over micro-batches of records, one of them delivered twice, with the schema kept as a table."""
    occ, folder = cut_lineage(D.open_relations(t)), run_folder(t.spark)
    last = occ.agg(F.max("item_id")).first()[0] or 0
    for turn in (0, 1, 1, 2):
        part = occ.filter(F.least(F.floor(F.col("item_id") * 3 / (last + 1)), F.lit(2)) == turn)
        process_batch(part, turn, folder, hashing_vector, 0.8)
    d = t.spark.read.parquet(f"{folder}/decisions")
    return d.groupBy("pred", "decision").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("n_open"))


def replay_inputs(t):
    occ, keys = growth_inputs(t)
    n = (F.col("position") * 7 + F.length("relation")) % 11
    raw = F.when(n == 0, "0").when(n == 1, "no idea").otherwise(F.concat(F.lit("Answer: "), (n % 6 + 1).cast("string")))
    return occ.withColumn("raw_output", raw).withColumn("answered", F.col("position") % 13 != 0), keys


@query
def sc_replayed_fold(t):
    occ, keys = replay_inputs(t)
    d, _ = C_.canonicalize_replayed(occ, keys)
    return d.groupBy("pred", "decision", "is_new").agg(F.count(F.lit(1)).alias("n"))


def signal_inputs(t):
    """Line items as occurrences of their part's name, with the definitions and slot types of their record, and recorded answers."""
    rows = D.numbered_lines(t, "p_name", "p_type", "p_size", extra=("l_returnflag",))
    occ = GR.order_number(rows.select(
        F.col("l_orderkey").alias("item_id"), F.col("k").alias("pos"), F.col("p_name").alias("relation"),
        F.concat(F.lit("made for "), F.lower("p_type"), F.lit(" use")).alias("definition"),
        F.concat(F.lit("what "), F.lower("p_type"), F.lit(" buyers want")).alias("general_definition_edc"),
        F.concat(F.lit("a thing of size class "), (F.col("p_size") % 3).cast("string")).alias("general_definition_abstract"),
        F.concat(F.lit("H"), (F.col("p_size") % 2).cast("string")).alias("head_type"), F.lower("l_returnflag").alias("tail_type")), ["item_id", "pos"])
    n = (F.col("item_id") * 7 + F.col("pos") * 3 + F.length("relation")) % 11
    raw = F.when(n == 0, "0").when(n == 1, "no idea").otherwise(F.concat(F.lit("Answer: "), (n % 6 + 1).cast("string")))
    return occ.withColumn("raw_output", raw).withColumn("answered", F.col("item_id") % 13 != 0)


@query
def sc_signals(t):
    """The nine relation signals over one input, each growing its own schema: what each line item's relation became, and how."""
    occ, out = signal_inputs(t), None  # numbered, so written already
    for case in C_.RELATION_CASES:
        d, _ = C_.canonicalize_signal(occ, case, hashing_vector, threshold=0.8)
        rows = d.groupBy("pred", "decision", "is_new").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("n_open")).withColumn(
            "signal", F.lit(case))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def alias_accumulate(t):
    occ, keys = growth_inputs(t)
    d, _ = C_.canonicalize_growing(occ, keys, threshold=0.8)
    return C_.aliases(d).select("pred", F.array_join("aliases", ",").alias("aliases"))


@query
def mcq_parse(t):
    _, asked = frozen_inputs(t)
    return asked.select("qid", C_.parse_choice(F.col("raw_output"), F.lit(6)).cast("bigint").alias("choice"))


@query
def prompt_choices(t):
    """Numbered choice lists for every query, with the typed line format."""
    top = R.top_k(D.mixed_vectors(t), D.vectors(t), 5).join(
        D.vectors(t).select("ord", "head_type", "tail_type"), "ord")
    line = C_.choice_line("typed", F.col("rank"), F.col("name"), F.concat(F.lit("def of "), "name"), F.col("head_type"),
                          F.col("tail_type"))
    return C_.prompt_choices(top, "qid", line)


@query
def ec_type_groups(t):
    g = C_.entity_type_groups(D.sd_entities(t).withColumn("fine", F.col("coarse")))
    return g.select("item_id", "fine", "ord", "definition", "parent", F.array_join("members", ",").alias("members"))


@query
def ec_type_map(t):
    return C_.entity_type_map(D.ec_decisions(t).filter("ec_case = 2"))


TYPE_THRESHOLD = 0.7


@query
def ec_growing(t):
    """Entity types that grow over all records, for the three signals: how often each was given, and how."""
    groups = GR.order_number(C_.entity_type_groups(D.part_entities(t)), ["item_id", "ord"])
    out = []
    for case in C_.ENTITY_CASES:
        d, _ = C_.canonicalize_types(groups, case, hashing_vector, threshold=TYPE_THRESHOLD)
        out.append(d.groupBy("pred", "decision", "is_new").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fine").alias("n_fine")).withColumn(
            "ec_case", F.lit(case)))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def ec_schema(t):
    """The types that growth over a seed mints, with the definition and parent of their first use."""
    groups = GR.order_number(C_.entity_type_groups(D.part_entities(t)), ["item_id", "ord"])
    seed = groups.groupBy(F.col("fine").alias("name")).agg(F.lit("").alias("definition"), F.lit("Tool").alias("parent")).filter(
        F.endswith("name", F.lit("ring")))
    seed = GR.order_number(seed, ["name"], "ord").withColumn("ord", F.col("ord") - (1 << 60))
    out = []
    for case in C_.ENTITY_CASES:
        _, schema = C_.canonicalize_types(groups, case, hashing_vector, seed=seed, threshold=TYPE_THRESHOLD)
        out.append(schema.select(F.lit(case).alias("ec_case"), "name", "definition", "parent"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def ec_rerun(t):
    """Entity types of a finished run from its stored tables: the last type of every entity, under each signal."""
    run = Build(t.spark, run_folder(t.spark), BuildConfig(relation_threshold=TYPE_THRESHOLD), hashing_vector)
    run.stage("entities_0", lambda: D.part_entities(t))
    run.stage("decided_case1_embed_threshold_0", lambda: D.kg_gold(t).withColumn("pred", F.col("r")))
    done = run.entity_types_only(D.slot_types(t.spark))
    out = [done[f"entity_map_{case}"].withColumn("ec_case", F.lit(case)) for case in C_.ENTITY_CASES]
    return out[0].unionByName(out[1]).unionByName(out[2])


# ---------------------------------------------------------------- instances

def instance_inputs(t):
    """All surfaces of all predictions; vectors from hashed trigrams, types by length of the surface."""
    return _instance_vectors(IC.surface_frequency(D.kg_pred(t)))


def place_inputs(t):
    """Part and place surfaces of all predictions, as :func:`instance_inputs` has them."""
    p = D.kg_pred(t).filter(F.col("r").isin("containsPart", "containsPartOf", "partOf", "locatedIn", "situatedIn"))
    return _instance_vectors(IC.surface_frequency(p).filter(~F.col("surface").rlike("(?i)^(order|customer)")))


def _instance_vectors(counted):
    # joins, blocks and components read the surfaces again and again, so they are counted once
    s = cut_lineage(counted)
    typed = F.when(F.length("surface") % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("T"), (F.length("surface") % 2).cast("string")))
    s = s.withColumn("vec", hashing_vector(F.lower("surface"))).withColumn("type", typed)
    return s.withColumn("desc_vec", hashing_vector(F.substring_index("surface", " ", -1)))


IC_CONFIG = dict(cos_sub=0.6, cos_alias=0.8, cos_alias_typed=0.7, cos_alias_desc=0.6, desc_sim_min=0.9)


@query
def surface_freq(t):
    return IC.surface_frequency(D.kg_pred(t))


@query
def ic_signal_counts(t):
    e = IC.instance_evidence(place_inputs(t), config=IC_CONFIG).filter("kind <> 'link'")
    return e.groupBy("ic_case", "kind").agg(F.sum("n").alias("n"))


@query
def ic_canon_map(t):
    s = instance_inputs(t)
    e = IC.instance_evidence(s, config=IC_CONFIG)
    return IC.canonical_surfaces(s, e).select("ic_case", "surface", "canonical")


@query
def ic_statistics(t):
    s = instance_inputs(t)
    c = IC.canonical_surfaces(s, IC.instance_evidence(s, config=IC_CONFIG))
    return IC.instance_statistics(s, c).select("ic_case", "n_surfaces", "n_clusters_merged", "n_surfaces_rewritten",
                                               "largest_cluster", "n_clusters_with_types", "n_type_consistent", r6("merge_rate"))


def fold_canon(t):
    s = IC.surface_frequency(D.kg_pred(t)).withColumn("f", T.fold(F.col("surface")))
    order = Window.partitionBy("f").orderBy(-F.col("freq"), -F.length("surface"), "surface")
    return s.filter("f is not null").select("surface", F.first("surface").over(order).alias("canonical"))


@query
def kg_rewrite(t):
    """Fold-equal surfaces rewritten to their canonical form; copies and self-loops removed."""
    return IC.rewrite_triples(D.kg_pred(t, (1,)), fold_canon(t))


# ---------------------------------------------------------------- parsers on recorded answers

def model_answers(t):
    """One extraction answer per record, rendered from its reference triples in four styles."""
    rows = D.kg_gold(t).withColumn("h", F.when(F.col("item_id") % 4 == 2, F.concat(F.lit("O'"), "h")).otherwise(F.col("h")))
    listed = F.array_sort(F.collect_list(F.struct("pos", F.concat(
        F.lit("['"), "h", F.lit("', '"), "r", F.lit("', '"), "t", F.lit("']")).alias("x"))))
    body = F.concat(F.lit("["), F.array_join(F.transform(listed, lambda s: s["x"]), ", "), F.lit("]"))
    a = rows.groupBy("item_id").agg(body.alias("body"))
    k = F.col("item_id") % 4
    return a.select("item_id", F.when(k == 1, F.concat(F.lit("Here is the list:\n"), "body", F.lit("\nDone.")))
                    .when(k == 3, F.lit("I found no triples.")).otherwise(F.col("body")).alias("raw_output"))


@query
def oie_parse(t):
    a = model_answers(t).withColumn("triples", PA.parse_triples(F.col("raw_output"))).drop("raw_output")
    return PA.explode_triples(a)


@query
def oie_clean_generated(t):
    raw = F.concat(F.lit("<think>plan [[x]]</think> "), "raw_output", F.lit(" and so on"))
    return model_answers(t).select("item_id", F.md5(PA.clean_generated(raw)).alias("clean"))


@query
def kg_text_roundtrip(t):
    """Records written in the graph text format and read back: counts per relation."""
    g = D.kg_gold(t)
    rows = F.array_sort(F.collect_list(F.struct("pos", "h", "r", "t")))
    text = g.groupBy("item_id").agg(PA.python_list_text(F.transform(rows, lambda s: F.array(s["h"], s["r"], s["t"]))).alias("line"))
    back = PA.explode_triples(text.select("item_id", PA.read_list(F.col("line")).alias("triples")))
    return back.groupBy("r").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("h") + F.length("t")).alias("chars"))


@query
def relation_refine(t):
    p = D.kg_pred(t, (1,)).withColumn("r", F.when(F.col("pos") % 4 == 0, F.lit("is")).when(
        F.col("pos") % 4 == 1, F.lit("Has_Order_Of")).otherwise(F.col("r")))
    return PA.refine_triples(p).groupBy("r").agg(F.count(F.lit(1)).alias("n"))


@query
def reject_reasons(t):
    p = D.kg_pred(t, (1,)).withColumn("t", F.when(F.col("pos") == 3, F.lit(" ")).when(F.col("pos") == 4, F.lit(None))
                                      .otherwise(F.col("t")))
    reason = F.coalesce(PA.reject_reason(F.col("h"), F.col("r"), F.col("t")), F.lit("kept"))
    return p.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query
def verdict_rule(t):
    k = F.col("doc_id")
    q1 = F.when(k % 5 == 0, "no").otherwise("yes")
    q3 = F.element_at(F.array(F.lit("stated"), F.lit("inferable"), F.lit("no")), (k % 3 + 1).cast("int"))
    raw = F.concat(F.lit("Q1: "), q1, F.lit("\nQ2: yes\nQ3: "), q3, F.lit("\nReason: because"))
    raw = F.when(k % 11 == 0, F.lit("unclear")).otherwise(raw)
    v = t["documents"].select("doc_id", F.coalesce(A.parse_audit(raw)[3], F.lit("UNPARSED")).alias("verdict"))
    return v.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def verdict_distribution(t):
    v = t["labels"].select(A.verdict_rule(
        F.when(F.col("quality") == 1, "yes").otherwise("no"), F.lit("yes"),
        F.when(F.col("toxic") == 1, "no").when(F.col("doc_id") % 2 == 0, "inferable").otherwise("stated")).alias("verdict"))
    return A.verdict_distribution(v).select("verdict", "n", r6("pct"))


@query
def expression_rule(t):
    k = F.col("item_id")
    raw = F.concat(F.lit("q1: "), F.when(k % 3 == 0, "no").otherwise("yes"), F.when(k % 2 == 0, "\nq2: yes").otherwise(""))
    j = D.kg_gold(t).select("item_id", "h", "r", "t", A.parse_expression_label(raw).alias("label"))
    return E.label_crosstab(j.dropDuplicates(["item_id", "h", "r", "t"]), misses(t))


# ---------------------------------------------------------------- definitions

@query
def sd_typed_triples(t):
    d = SD.typed_triples(D.kg_gold(t), D.sd_entities(t))
    return d.groupBy("r", "head_type", "tail_type").agg(F.count(F.lit(1)).alias("n"))


@query
def sd_missing_fallback(t):
    e = SD.complete_entities(D.sd_entities(t), D.kg_gold(t))
    return e.groupBy("fine", "inferred").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("description")).alias("chars"))


def most_orders(t) -> int:
    """The most orders of one key; each brings a record the same few entities."""
    return t["orders"].groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


@query
def sd_relation_match(t):
    """Definition rows with drifting spelling matched back to the expected type triples."""
    typed = SD.typed_triples(D.kg_gold(t), D.sd_entities(t), 4 * most_orders(t))
    drift = F.when(F.col("pos") % 3 == 0, F.upper("r")).when(F.col("pos") % 3 == 1, F.concat("r", F.lit("x"))).otherwise(F.col("r"))
    rows = typed.select("item_id", "pos", F.col("head_type").alias("s"), drift.alias("r"), F.col("tail_type").alias("o"),
                        F.concat(F.lit("def "), "r").alias("definition"), F.lit("event").alias("relation_type"))
    ok, _ = SD.match_relations(rows, typed)
    full = SD.complete_relations(ok, typed)
    return full.groupBy("r", "relation_type").agg(F.count(F.lit(1)).alias("n"))


@query
def ontology_split(t):
    p = D.kg_pred(t, (1,)).withColumn("r", F.when(F.col("pos") == 2, F.lit("isA")).when(
        F.col("pos") == 3, F.lit("hasDisability")).otherwise(F.col("r")))
    keep, drop = SD.split_ontology(p)
    return keep.withColumn("part", F.lit("kept")).unionByName(drop.withColumn("part", F.lit("ontology"))).groupBy(
        "part", "r").agg(F.count(F.lit(1)).alias("n"))


@query
def sd_coverage(t):
    d = D.kg_gold(t).filter("pos % 2 = 0").select("item_id", F.col("r").alias("relation"))
    per = S.definition_coverage(one_case(t), d)
    return per.agg(r6(F.avg(F.col("n_defined") / F.col("n")), "mean"), r6(F.percentile(F.col("n_defined") / F.col("n"), 0.5), "median"))


@query
def sd_relation_coverage(t):
    d = D.kg_gold(t).filter("pos % 2 = 0").select("item_id", F.col("r").alias("relation"))
    return S.relation_definition_coverage(one_case(t), d).select("r", "n", r6("coverage"))


# ---------------------------------------------------------------- schema over time

def decisions_view(t):
    """Open relation and canonical relation per predicted triple."""
    pred = F.when(F.col("r") == "situatedIn", "locatedIn").otherwise(F.regexp_replace("r", "(?<=[a-z])Of$", ""))
    pred = F.when((F.col("item_id") + F.col("pos")) % 19 == 0, F.lit(None)).otherwise(
        F.when(F.col("r") == "partOf", "partOf").otherwise(pred))
    return D.kg_pred(t).withColumn("pred", pred).withColumn("defined", F.col("pos") % 2 == 0)


@query
def identity_rate(t):
    return S.identity_rate(decisions_view(t), ["case_id"]).select("case_id", "n_triples", r6("identity_all"),
                                                                  r6("identity_missing_definition"))


@query
def name_entropy(t):
    return S.name_entropy(decisions_view(t), ["case_id"]).select("case_id", "pred", "n", r6("entropy"))


@query
def schema_growth(t):
    u = D.open_relations(t).select("item_id", F.col("relation").alias("r"))
    return S.schema_growth(u).select("since", "added", "size")


@query
def schema_stability(t):
    u = D.open_relations(t).select("item_id", F.col("relation").alias("r"))
    g = S.stability(S.schema_growth(u))
    return g.agg(F.count("kept").alias("n_steps"), F.min("kept").alias("lowest"))


@query
def schema_prefix_as_of_n(t):
    n = t["orders"].agg(F.expr("count(1) div 2")).first()[0]
    u = D.open_relations(t).select("item_id", F.col("position").alias("pos"), F.col("relation").alias("r"))
    return S.schema_as_of(u, n).select("r", F.col("ord").cast("bigint").alias("ord"))


@query
def schema_merge(t):
    x = part_schema(t).select(F.col("relation").alias("name"), "ord")
    lists = lambda a: F.array(F.concat(F.lit(a), F.col("name")), F.lit("shared"))
    old = x.filter("ord % 3 <> 0").select("name", F.when(F.col("ord") % 2 == 0, F.concat(F.lit("old "), "name")).alias("definition"),
                                          F.lit("Order").alias("head_type"), F.lit("Part").alias("tail_type"),
                                          lists("a ").alias("aliases"), lists("x ").alias("examples"))
    new = x.filter("ord % 3 <> 1").select("name", F.concat(F.lit("new "), "name").alias("definition"), F.lit("Order").alias("head_type"),
                                          F.when(F.col("ord") % 5 == 0, "Item").otherwise("Part").alias("tail_type"),
                                          lists("b ").alias("aliases"), lists("y ").alias("examples"))
    return S.merge_schemas(old, new).select("name", "definition", "head_type", "tail_type", "conflict",
                                            F.array_join("aliases", ",").alias("aliases"), F.array_join("examples", ",").alias("examples"))


@query
def schema_precision(t):
    p = relation_names(t).select(F.col("r").alias("relation"))
    s = S.schema_precision(p, D.slot_types(t.spark), normalised=True)
    return s.select("n_pred", "n_hit", r6("precision"))


@query
def schema_gold_coverage(t):
    return S.gold_coverage(D.kg_gold(t), D.slot_types(t.spark).filter("ord < 5")).select("n_gold", "n_covered", "missing", r6("coverage"))


@query
def schema_retype(t):
    m = D.kg_gold(t).filter("r in ('locatedIn', 'partOf')").select(F.col("r").alias("relation")).distinct().select(
        "relation", F.lit("Place").alias("head_type"), F.lit("Place").alias("tail_type"))
    return S.retype(D.slot_types(t.spark), m).select("relation", "head_type", "tail_type")


# ---------------------------------------------------------------- agreement

def ratings(t):
    lab = t["labels"]
    votes = F.array(F.struct(F.lit("a1").alias("annotator"), F.col("quality").alias("v")),
                    F.struct(F.lit("a2").alias("annotator"), F.col("toxic").alias("v")),
                    F.struct(F.lit("a3").alias("annotator"), (F.col("doc_id") % 3).cast("int").alias("v")))
    names = F.array(F.lit("Person"), F.lit("Place"), F.lit("person_name"))
    return lab.select(F.col("doc_id").alias("id"), F.explode(votes).alias("x")).select(
        "id", "x.annotator", F.element_at(names, F.col("x.v") + 1).alias("label"))


@query
def cohen_kappa(t):
    k = A.cohen_kappa(t["labels"].select(F.col("quality").alias("a"), F.col("toxic").alias("b")))
    return A.agreement_gate(k).select("n", r6("agreement"), r6("kappa"), "gate")


@query
def fleiss_kappa(t):
    return A.fleiss_kappa(ratings(t), 3).select("n", r6("agreement"), r6("kappa"))


@query
def majority_vote(t):
    return A.adjudicate(ratings(t))


@query
def jury_verdict(t):
    return A.jury_verdict(ratings(t), 3)


@query
def label_collisions(t):
    return A.label_collisions(ratings(t))


@query
def synonym_tier(t):
    c = A.label_collisions(ratings(t))
    return c.select("label_1", "label_2", A.synonym_tier(F.col("label_1"), F.col("label_2"), F.col("collisions")).alias("tier"))


@query
def reconcile_labels(t):
    """Approved label merges applied inside each rated item."""
    merges = ratings(t).select(F.lit("Person").alias("lo"), F.lit("person_name").alias("hi"), F.lit("Person").alias("canonical")).distinct()
    r = A.reconcile_labels(ratings(t), merges)
    return r.groupBy("annotator", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("rewritten").cast("bigint").alias("rewrites"))


@query
def signal_disagreement(t):
    d = D.ec_decisions(t).select("ec_case", "item_id", F.col("members")[0].alias("entity"), F.col("pred").alias("type"))
    p = A.disagreement_partition(d, D.CASE_IDS)
    return p.groupBy("disagree", "n_types").agg(F.count(F.lit(1)).alias("n"))


@query
def stratified_bcubed(t):
    d = D.ec_decisions(t).filter("ec_case = 3").select((F.col("item_id") % 2).cast("string").alias("stratum"),
                                                       "pred", F.col("fine").alias("gold"))
    return A.stratified_bcubed(d).select("stratum", r6("bcubed_p"), r6("bcubed_r"), r6("bcubed_f1"))


def runs(t):
    """Seeded run scores: one row per policy, metric, signal and seed, from the event log."""
    e = t["events"]
    case = F.when(F.col("event_type") == "click", "case1_embed").otherwise(F.concat(F.lit("case_"), "event_type"))
    return e.groupBy((F.col("event_id") % 2 * 2 + 1).alias("mode"), F.lit("f1").alias("metric"), case.alias("case"),
                     (F.col("user_id") % 5).alias("seed")).agg(F.avg("value").alias("value"))


@query
def seed_mean_std(t):
    return A.seed_summary(runs(t)).select("mode", "metric", "case", "n", r6("mean"), r6("std"))


@query
def winner_verdict(t):
    return A.winner_verdict(A.seed_summary(runs(t))).select("mode", "metric", "winner", "runner_up", r6("margin"), "verdict")


@query
def mode_gap(t):
    return A.mode_gap(A.seed_summary(runs(t)), 1, 3).select("metric", "case_low", "case_high", r6("gap"), r6("std"), "real")


@query
def best_case(t):
    b = A.best_case(runs(t).withColumn("run", F.col("mode") * 10 + F.col("seed")))
    return b.select("run", "best", r6("best_value"), r6("baseline"), r6("delta"))


@query
def column_winners(t):
    s = A.seed_summary(runs(t)).withColumn("mean", F.round("mean", 6))
    return A.column_winners(s, ["mode", "metric"], "mean").select("mode", "metric", "case", "winner")


@query
def run_difference(t):
    a = D.kg_pred(t, (1,)).select("item_id", "pos", F.col("r").alias("pred"))
    b = D.kg_pred(t, (2,)).select("item_id", "pos", F.col("r").alias("pred"))
    return A.run_difference(a, b, ["item_id", "pos"]).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query
def stage_tokens(t):
    n = t["orders"].count()
    e = t["events"].select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    return A.stage_costs(e, n).select("stage", "calls", r4("seconds"), r6("per_item"), r4("per_1k"))


@query
def stage_windows(t):
    e = t["events"].select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"), F.col("ts").cast("timestamp").alias("ts"))
    w = e.groupBy(F.window("ts", "1 hour").alias("w"), "stage").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
    return w.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "stage", "n", r4("seconds"))


# ---------------------------------------------------------------- grounding

def class_tree(t):
    """Class hierarchy of the data: nations under regions under Place, brands under types under Product."""
    geo = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    part = t["part"].select("p_brand", "p_type").groupBy("p_brand").agg(F.min("p_type").alias("p_type"))
    up = lambda df, c, p: df.select(F.col(c).alias("child"), (p if not isinstance(p, str) else F.col(p)).alias("parent"))
    return (up(geo, "n_name", "r_name").union(up(t["region"], "r_name", F.lit("Place"))).union(up(part, "p_brand", "p_type"))
            .union(up(part.select("p_type").distinct(), "p_type", F.lit("Product")))).distinct()


@query
def ancestor_closure(t):
    return KB.ancestor_closure(class_tree(t))


@query
def kb_slot_status(t):
    """Every customer's home nation against the classes a rule table allows for its segment."""
    slots = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("relation"), F.lit("tail").alias("slot"), F.when(
            F.col("c_custkey") % 9 == 0, F.lit("Place")).otherwise(F.col("n_name")).alias("cls"))
    allowed = t["customer"].join(t["nation"], F.col("n_nationkey") == F.col("c_custkey") % 25).join(
        t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("c_name").alias("relation"), F.lit("tail").alias("slot"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.col("n_name")).when(F.col("c_mktsegment") != "MACHINERY", F.col("r_name"))
        .alias("allowed")).filter("allowed is not null")
    s = KB.slot_status(slots, allowed, KB.ancestor_closure(class_tree(t)))
    return KB.status_histogram(s)


@query
def most_specific_type(t):
    ents = t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("entity"), F.col("n_name").alias("cls"))
    types = t["region"].select(F.concat(F.lit("T_"), "r_name").alias("type"), F.col("r_name").alias("cls")).union(
        t["region"].select(F.lit("T_Place"), F.lit("Place")).distinct()).union(
        t["nation"].filter("n_regionkey < 3").select(F.concat(F.lit("T_"), "n_name"), "n_name"))
    return KB.most_specific_type(ents, types, KB.ancestor_closure(class_tree(t)))


@query
def property_resolution(t):
    rel = t["part"].select(F.col("p_name").alias("relation")).distinct()
    labels = t["part"].filter("p_name like '%ring%'").select(F.col("p_name").alias("name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
                                                         .alias("prop"), F.col("p_partkey").alias("ord"))
    alias = t["part"].filter("p_name like '%widget%'").select(F.col("p_name").alias("name"), F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
                                                        .alias("prop"), F.col("p_partkey").alias("ord"))
    con = t["part"].filter("p_size > 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("prop"))
    return KB.resolve_properties(rel, labels, alias, con)


@query
def surface_roles(t):
    return KB.surface_roles(D.kg_gold(t)).groupBy("roles").agg(F.count(F.lit(1)).alias("n"))


def kb_tables(t):
    s = KB.surface_roles(D.kg_gold(t)).select("surface")
    c = lambda df, name, kid, order: df.select(F.col(name).alias("name"), F.concat(F.lit("Q"), F.col(kid).cast("string")).alias("kb_id"),
                                               F.col(order).cast("bigint").alias("ord"))
    labels = c(t["customer"].filter("c_mktsegment < 'H'"), "c_name", "c_custkey", "c_custkey")
    alias = c(t["part"], "p_name", "p_partkey", "p_partkey")
    search = c(t["nation"], "n_name", "n_nationkey", "n_nationkey")
    types = t["part"].select(F.concat(F.lit("Q"), F.col("p_partkey").cast("string")).alias("entity"),
                             F.when(F.col("p_size") > 45, F.col("p_type")).alias("type"))
    return s, labels, alias, search, types


@query
def entity_link_cascade(t):
    return KB.link_entities(*kb_tables(t)).select("surface", "kb_id", "schema_type", "status", "link_via", "n_candidates")


@query
def link_report(t):
    return KB.link_report(KB.link_entities(*kb_tables(t))).select("status", "n", r6("entity_coverage"))


@query
def redirect_types(t):
    s = KB.surface_roles(D.kg_gold(t)).select("surface")
    classes = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("name"), F.col("n_name").alias("cls"))
    moved = t["customer"].filter("c_mktsegment = 'HOUSEHOLD'").join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("name"), F.col("n_name").alias("target"))
    types = t["region"].select(F.concat(F.lit("T_"), "r_name").alias("type"), F.col("r_name").alias("cls"))
    r = KB.redirect_types(s, classes, moved, types, KB.ancestor_closure(class_tree(t)))
    return r.select("surface", "schema_type", "via_redirect", "status")


# ---------------------------------------------------------------- corpora, sampling, spans

@query
def pool_guards(t):
    """Demonstration pool from all documents without held-out texts and repeats."""
    pool = t["documents"].select(F.col("doc_id").alias("ord"), "text")
    held = t["benchmark"].select("text").union(t["documents"].filter("source = 'src3'").select("text"))
    return SA.pool_guards(pool, held).select("ord", F.md5("text").alias("digest"))


@query
def stratified_sample(t):
    """Sample report: quota per loss category."""
    rows = cut_lineage(misses(t).select("item_id", "pos", "category"))
    s = SA.stratified_sample(rows, 1000, "category", ["item_id", "pos"])
    return s.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query
def uniform_sample(t):
    s = SA.uniform_sample(t["documents"].select("doc_id", "lang"), 100, ["doc_id"])
    return s.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query
def nested_fractions(t):
    n = SA.nested_fractions(t["documents"].select("doc_id"), {"small": 20, "medium": 60, "large": 120}, ["doc_id"])
    return n.groupBy(F.coalesce("fraction", F.lit("rest")).alias("fraction")).agg(F.count(F.lit(1)).alias("n"))


@query
def length_diff_filter(t):
    a = D.kg_gold(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_a"))
    b = one_case(t).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_b"))
    return SA.length_filter(a, b, "item_id", 1).groupBy("n_a", "n_b").agg(F.count(F.lit(1)).alias("n"))


@query
def chunk_sequence(t):
    """Conversation turns as chunks with a sequence number per title."""
    return CH.chunk_notes(t["conversations"].select(
        F.col("conv_id").cast("string").alias("title"), "text", F.struct("conv_id", "turn").alias("order"))).select(
        "title", "seq", F.md5("text").alias("digest"))


@query
def coref_rewrite(t):
    """Pronouns and definite descriptions of each record replaced by the customer's name."""
    texts = D.kg_text(t)
    found = F.array(F.struct(F.lit(0).alias("start"), (F.instr("text", " from") - 2).alias("end")),
                    F.struct((F.instr("text", "It was") - 1).alias("start"), F.instr("text", "It was").alias("end")))
    m = texts.select("item_id", "text", F.explode(found).alias("s")).filter("s.start >= 0").select(
        "item_id", F.lit(1).alias("cluster"), "s.start", "s.end",
        F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start") + 1).alias("mention"))
    return CO.rewrite(texts, m).select("item_id", "text")


def record_lists(t):
    """Predicted and reference triple lists of each record as two array columns, a row per case; a case may have found nothing."""
    x = F.array("h", "r", "t").alias("x")
    strip_pos = lambda c: F.transform(F.array_sort(c), lambda s: s["x"])
    g = D.kg_gold(t).groupBy("item_id").agg(strip_pos(F.collect_list(F.struct("pos", x))).alias("gold"))
    p = D.kg_pred(t).groupBy("item_id").agg(F.collect_list(F.struct("case_id", "pos", x)).alias("found"))
    rows = SP.with_words(g.join(p, "item_id", "left"), F.col("gold"), F.transform("found", lambda s: s["x"]))  # once for all cases
    rows = rows.withColumn("case_id", F.explode(F.array(*[F.lit(c) for c in D.CASE_IDS])))
    mine = F.filter("found", lambda s: s["case_id"] == F.col("case_id"))
    pred = F.coalesce(strip_pos(F.transform(mine, lambda s: F.struct(s["pos"], s["x"].alias("x")))), F.array().cast("array<array<string>>"))
    return rows.select("item_id", "gold", pred.alias("pred"), "case_id", "names", "words")


@query
def span_f1(t):
    s = SP.span_scores(record_lists(t))
    return s.groupBy("case_id").agg(*[r6(F.avg(m), m) for m in ("exact", "strict", "partial")])
