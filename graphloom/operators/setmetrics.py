"""Set-based triple metrics: aligned F1, threshold sweeps, open-triple parity, exact-triple macro scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import norm_entity, norm_open, norm_relation
from graphloom.functions.vectors import DIGITS, matrix
from graphloom.operators.retrieval import nearest
from graphloom.session import broadcast_if_small, cut_lineage, f1, ratio

# Records of at most this many texts are matched as one row of arrays; if one is longer, all go through joins on their pairs.
RECORD_ROWS = 2000
_PAIRS = 1 << 18

def prf(tp="tp", fp="fp", fn="fn"):
    """Zero-safe precision, recall and F1 columns from count columns."""
    p, r = ratio(F.col(tp), F.col(tp) + F.col(fp)), ratio(F.col(tp), F.col(tp) + F.col(fn))
    return p, r, f1(p, r)


def relation_set(triples: DataFrame) -> DataFrame:
    """Distinct relation names in order."""
    return triples.select("r").distinct().orderBy("r")


def align_relations(pred: DataFrame, gold: DataFrame, embed) -> DataFrame:
    """Nearest reference relation per predicted relation name: ``(r, target, score)``.

    Names are embedded as words; the comparison runs over the two vocabularies, never over triples.
    """
    names = pred.select("r").distinct().withColumn("vec", embed(norm_relation(F.col("r"))))
    w = W.orderBy("r")
    refs = gold.select("r").distinct().withColumn("ord", F.row_number().over(w).cast("bigint"))
    refs = refs.select("ord", F.col("r").alias("name"), embed(norm_relation(F.col("r"))).alias("vec"))
    return nearest(names, refs, query_id="r").select("r", F.col("name").alias("target"), "score")


def _reference_set(gold: DataFrame) -> DataFrame:
    return gold.select("item_id", norm_entity(F.col("h")).alias("nh"), F.col("r").alias("r"),
                       norm_entity(F.col("t")).alias("nt"))


def aligned_counts(pred: DataFrame, gold: DataFrame, alignment: DataFrame, thresholds) -> DataFrame:
    """TP/FP/FN of aligned triple sets per case for every threshold, in one pass over the triples.

    A predicted relation that reaches no reference relation is left out, so it is neither right nor wrong.
    A triple counts at a threshold when the best score among the names that map to it reaches it, so all
    thresholds share one (record, triple) aggregation and only its score histogram is expanded.
    """
    keys = ["item_id", "nh", "r", "nt"]
    p = pred.join(alignment, "r").select(
        "case_id", "item_id", norm_entity(F.col("h")).alias("nh"), F.col("target").alias("r"),
        norm_entity(F.col("t")).alias("nt"), "score")
    g = _reference_set(gold).withColumn("case_id", F.lit(None).cast(dict(pred.dtypes)["case_id"])).withColumn(
        "score", F.lit(None).cast("double"))
    both = p.unionByName(g.select(p.columns)).repartition(*keys)
    once = both.groupBy(*keys, "case_id").agg(F.max("score").alias("score"))
    ref = F.max(F.when(F.col("case_id").isNull(), 1).otherwise(0)).over(W.partitionBy(*keys))
    hist = once.withColumn("ref", ref).groupBy("case_id", "score", "ref").agg(F.count(F.lit(1)).alias("n"))
    taus = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("tau")
    hist = hist.select("*", taus)
    n_gold = F.sum(F.when(F.col("case_id").isNull(), F.col("n"))).over(W.partitionBy("tau"))
    hist = hist.withColumn("n_gold", n_gold).filter("case_id is not null")
    hit = F.col("score") >= F.col("tau")
    return hist.groupBy("case_id", "tau").agg(
        F.coalesce(F.sum(F.when(hit & (F.col("ref") == 1), F.col("n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit & (F.col("ref") == 0), F.col("n"))), F.lit(0)).alias("fp"),
        F.max("n_gold").alias("n_gold")).withColumn("fn", F.col("n_gold") - F.col("tp"))


def aligned_f1(pred: DataFrame, gold: DataFrame, embed, thresholds=(0.7,)) -> DataFrame:
    """Aligned triple precision, recall, F1 and alignment coverage per case and threshold."""
    alignment = broadcast_if_small(cut_lineage(align_relations(pred, gold, embed)))  # a row per predicted name
    counts = aligned_counts(pred, gold, alignment, thresholds)
    names = pred.select("case_id", "r").distinct().join(alignment, "r", "left").select(
        "case_id", "r", "score", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("tau"))
    cover = names.groupBy("case_id", "tau").agg(
        F.count(F.lit(1)).alias("n_pred_relations"),
        F.count(F.when(F.col("score") >= F.col("tau"), 1)).alias("n_aligned"))
    p, r, f = prf()
    return cover.join(counts, ["case_id", "tau"], "left").fillna(0, ["tp", "fp", "fn"]).select(
        "case_id", "tau", "tp", "fp", "fn", "n_pred_relations", p.alias("precision"), r.alias("recall"),
        f.alias("f1"), ratio("n_aligned", "n_pred_relations").alias("coverage"))


def sample_entities(triples: DataFrame, by=("item_id",)) -> DataFrame:
    """Distinct normalised head and tail texts per record."""
    return triples.select(*by, F.explode(F.array(norm_open(F.col("h")), norm_open(F.col("t")))).alias("text")).distinct()


def triple_text(h="h", r="r", t="t"):
    return F.concat_ws(" ", norm_open(F.col(h)), norm_open(F.col(r)), norm_open(F.col(t)))


def greedy_matches(left: DataFrame, right: DataFrame, keys, threshold: float, score) -> DataFrame:
    """Greedy one-to-one matching inside each record, best similarity first, then larger indices.

    ``left(keys…, i, lv)`` and ``right(keys…, j, rv)`` carry vectors; ``score(lv, rv)`` is an expression.
    Taking the globally best remaining pair is the same as repeatedly taking every pair that is the best of
    both of its ends (the order is strict), so the matching runs in parallel rounds over the pairs that pass
    the threshold; pairs below it never leave the join.
    """
    keys = list(keys)
    pairs = left.join(right, keys).withColumn("s", score("lv", "rv")).filter(F.col("s") >= threshold)
    pairs = cut_lineage(pairs.select(*keys, "i", "j", "s"))
    done = None
    while True:
        rank = F.struct("s", "i", "j")
        top = pairs.withColumn("bi", F.max(rank).over(W.partitionBy(*keys, "i"))).withColumn(
            "bj", F.max(rank).over(W.partitionBy(*keys, "j")))
        chosen = cut_lineage(top.filter((F.col("bi") == rank) & (F.col("bj") == rank)).select(*keys, "i", "j", "s"))
        if chosen.isEmpty():
            return pairs.limit(0) if done is None else done
        done = chosen if done is None else done.unionByName(chosen)
        pairs = cut_lineage(pairs.join(chosen.select(*keys, "i"), [*keys, "i"], "left_anti")
                            .join(chosen.select(*keys, "j"), [*keys, "j"], "left_anti"))


def one_to_one(left: DataFrame, right: DataFrame, keys, embed, least: float) -> DataFrame:
    """Similarity ``(keys…, s)`` of every pair of the greedy one-to-one matching down to ``least``.

    ``left`` and ``right`` are ``(keys…, i, text)``; pairs are taken by similarity, then by the later ``i`` of the left and of
    the right side. The order does not depend on where the matching ends, so the pairs of any higher threshold are those of
    this matching that reach it: one matching serves a whole sweep. Equal vectors have similarity one; of each group of
    them the latest of both sides are paired by number, and only what is left forms pairs.
    """
    from graphloom.functions.vectors import dot

    keys = list(keys)
    both = left.select(*keys, "i", "text", F.lit(0).alias("side")).unionByName(right.select(*keys, "i", "text", F.lit(1).alias("side")))
    vec = both.select("text").distinct().withColumn("vec", embed(F.col("text")))
    same = W.partitionBy(*keys, "vec")
    both = both.join(vec, "text").withColumn("k", F.row_number().over(W.partitionBy(*keys, "vec", "side").orderBy(F.desc("i"))))
    sizes = [F.count(F.when(F.col("side") == x, 1)).over(same) for x in (0, 1)]
    both = cut_lineage(both.withColumn("paired", F.col("k") <= F.least(*sizes)))
    equal = both.filter("paired and side = 0").select(*keys, F.lit(1.0).alias("s"))
    rest = both.filter("not paired")
    lv = rest.filter("side = 0").select(*keys, "i", F.col("vec").alias("lv"))
    rv = rest.filter("side = 1").select(*keys, F.col("i").alias("j"), F.col("vec").alias("rv"))
    near = greedy_matches(lv, rv, keys, least, lambda a, b: F.round(dot(a, b), 12))
    return equal.unionByName(near.select(*keys, "s"))


def entity_texts(triples: DataFrame, by) -> DataFrame:
    """Distinct entities of each record; a set has no order, so the text itself decides ties."""
    return sample_entities(triples, by).withColumn("i", F.col("text"))


def triple_texts(triples: DataFrame, by) -> DataFrame:
    """Triples of each record as one text each, in list order."""
    return triples.select(*by, F.col("pos").alias("i"), triple_text().alias("text"))


def reference_of_cases(gold: DataFrame, cases) -> DataFrame:
    """The reference once per case."""
    return gold.withColumn("case_id", F.explode(F.array(*[F.lit(c).cast("bigint") for c in cases])))


def _longest(pred: DataFrame, gold: DataFrame) -> int:
    """The most texts that a record has on one side: two for each triple, over all cases."""
    sizes = [df.groupBy("item_id").agg((F.count(F.lit(1)) * 2).alias("n")).select("n") for df in (pred, gold)]
    return sizes[0].unionByName(sizes[1]).agg(F.max("n")).first()[0] or 0


def open_matches(pred: DataFrame, gold: DataFrame, texts, embed, least: float, cases, longest: int | None = None) -> DataFrame:
    """``(case_id, item_id, n_pred, n_gold, n_equal, near)`` per case and record: the sizes of both sides and the greedy matching
    down to ``least``, as the number of pairs of equal vectors and the similarities of the others.

    ``longest`` bounds the texts that a record has on either side, over all cases; it is measured when not given. Short records are
    matched in one shuffle by record that holds the reference once for all cases, long ones by joins on pairs (:func:`one_to_one`).
    """
    keys = ["case_id", "item_id"]
    if (_longest(pred, gold) if longest is None else longest) <= RECORD_ROWS and texts in (entity_texts, triple_texts) and hasattr(embed, "func"):
        return _matches_by_record(pred, gold, texts is entity_texts, embed.func, least, list(cases))
    p, g = texts(pred, keys), texts(reference_of_cases(gold, cases), keys)
    count = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    pairs = one_to_one(p, g, keys, embed, least).groupBy(*keys).agg(F.collect_list("s").alias("near"))
    return count(g, "n_gold").join(count(p, "n_pred"), keys, "full").join(pairs, keys, "left").select(
        *keys, F.coalesce("n_pred", F.lit(0)).alias("n_pred"), F.coalesce("n_gold", F.lit(0)).alias("n_gold"), F.lit(0).cast("long").alias("n_equal"),
        F.coalesce("near", F.array().cast("array<double>")).alias("near"))


def _matches_by_record(pred, gold, entities, embed, least, cases):
    """Texts are normalised behind the shuffle, each different one of a record once."""
    kind = dict(pred.dtypes)
    p = pred.select("item_id", F.struct("case_id", "pos", "h", "r", "t").alias("pred"))
    g = gold.select("item_id", F.struct("pos", "h", "r", "t").alias("gold"))
    rows = p.withColumn("gold", F.lit(None).cast(g.schema["gold"].dataType)).unionByName(
        g.withColumn("pred", F.lit(None).cast(p.schema["pred"].dataType))).repartition("item_id")
    records = rows.groupBy("item_id").agg(F.collect_list("pred").alias("pred"), F.collect_list("gold").alias("gold"))
    parts = "ht" if entities else "hrt"
    raw = F.array_distinct(F.concat(*[F.col(c)[x] for c in ("pred", "gold") for x in parts]))
    records = records.withColumn("raw", F.filter(raw, lambda x: x.isNotNull())).withColumn("norm", F.transform("raw", norm_open))

    def match(batches):
        for b in batches:
            sizes = [b.column(c).value_lengths().to_numpy().astype(np.int64) for c in ("pred", "gold")]
            runs = np.cumsum(sizes[0] * sizes[1]) // _PAIRS
            cuts = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), b.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    yield _match_records(b.slice(start, end - start), cases, parts, embed, least)

    return records.mapInArrow(match, f"case_id {kind['case_id']}, item_id {kind['item_id']}, n_pred long, n_gold long, n_equal long, near array<double>")


def _texts(b: pa.RecordBatch, lists: list, parts: str):
    """Different texts of a batch, in ascending order, and for each list the number of each entry's text (-1: none): of heads, then
    of tails, for ``parts`` "ht", of whole triples for "hrt"."""
    raw = pa.concat_arrays([x.field(c) for x in lists for c in parts]).dictionary_encode()
    norms = b.column("norm").flatten().take(pc.index_in(raw.dictionary, value_set=b.column("raw").flatten())).to_pylist() + [None]
    code = raw.indices.fill_null(-1).to_numpy().astype(np.int64)
    columns = np.split(code, np.cumsum([len(x) for x in lists for _ in parts])[:-1])
    columns = columns[:len(parts)], columns[len(parts):]
    if parts == "hrt":
        triples, at = np.unique(np.concatenate([np.stack(c, axis=1) for c in columns]), axis=0, return_inverse=True)
        norms = [" ".join(x for x in (norms[i] for i in t) if x is not None) for t in triples.tolist()] + [None]
        code = np.split(at.ravel(), [len(lists[0])])
    else:
        code = [np.concatenate(c) for c in columns]
    texts = sorted(set(norms) - {None})
    number = {t: k for k, t in enumerate(texts)} | {None: -1}
    of = np.array([number[t] for t in norms], dtype=np.int64)
    return texts, [of[c] for c in code]


def _match_records(b: pa.RecordBatch, listed: list, parts: str, embed, least: float) -> pa.RecordBatch:
    """The matchings of all cases of a batch of records."""
    at = [np.repeat(np.arange(b.num_rows), b.column(c).value_lengths().to_numpy()) for c in ("pred", "gold")]
    p, g = b.column("pred").flatten(), b.column("gold").flatten()
    names = p.field("case_id").dictionary_encode()
    cases = listed + [c for c in names.dictionary.to_pylist() if c not in listed]
    place = np.array([cases.index(c) for c in names.dictionary.to_pylist()], dtype=np.int64)
    n = len(cases)
    groups = [at[0] * n + place[names.indices.to_numpy()], at[1] * n]  # a group: one case of one record
    texts, codes = _texts(b, [p, g], parts)
    for k, x in enumerate((p, g)):  # by group, the latest first
        if parts == "ht":  # a set, whose order is that of the texts
            both = np.unique(np.concatenate([groups[k]] * 2) * (len(texts) + 1) + codes[k] + 1)[::-1]
            groups[k], codes[k] = both // (len(texts) + 1), both % (len(texts) + 1) - 1
        order = np.argsort(groups[k], kind="stable") if parts == "ht" else np.lexsort((-x.field("pos").to_numpy(), groups[k]))
        groups[k], codes[k] = groups[k][order], codes[k][order]
    groups[1] = (groups[1][None, :] + np.arange(len(listed))[:, None]).ravel()
    codes[1] = np.tile(codes[1], len(listed))
    sizes = [np.bincount(x, minlength=b.num_rows * n) for x in groups]

    vec = matrix(embed(pa.array(texts, pa.string()))) + 0.0
    known: dict = {}
    same = np.array([known.setdefault(v.tobytes(), k) for k, v in enumerate(vec)] + [-1], dtype=np.int64)  # equal vectors; -1: no text
    some = [np.flatnonzero(c >= 0) for c in codes]
    key = [x[k] * (len(vec) + 1) + same[c[k]] for x, c, k in zip(groups, codes, some)]
    kinds, kind = np.unique(np.concatenate(key), return_inverse=True)
    kind = np.split(kind, [len(key[0])])
    fewer = np.minimum(*[np.bincount(k, minlength=len(kinds)) for k in kind])
    paired = [_occurrence(k) < fewer[k] for k in kind]
    equal = np.bincount(groups[0][some[0][paired[0]]], minlength=b.num_rows * n)

    left, right = (k[~done] for k, done in zip(some, paired))
    right = right[np.argsort(groups[1][right], kind="stable")]
    there = np.bincount(groups[1][right], minlength=b.num_rows * n)
    of = groups[0][left]
    a = np.repeat(np.arange(len(left)), there[of])
    first = np.cumsum(there[of]) - there[of]
    c = np.arange(len(a)) - first[a] + (np.cumsum(there) - there)[of[a]]
    s = np.empty(len(a))
    for k in range(0, len(a), 1 << 16):
        s[k:k + (1 << 16)] = np.einsum("ij,ij->i", vec[codes[0][left[a[k:k + (1 << 16)]]]], vec[codes[1][right[c[k:k + (1 << 16)]]]])
    s = np.round(s, DIGITS)
    near = np.flatnonzero(s >= least)
    near = near[np.lexsort((c[near], a[near], -s[near], of[a[near]]))]
    free_l, free_r, taken = np.ones(len(left), bool), np.ones(len(right), bool), []
    for k, i, j in zip(near.tolist(), a[near].tolist(), c[near].tolist()):
        if free_l[i] and free_r[j]:
            free_l[i] = free_r[j] = False
            taken.append(k)
    taken = np.array(taken, dtype=np.int64)
    ends = np.cumsum(np.bincount(of[a[taken]], minlength=b.num_rows * n))
    rows = np.flatnonzero(sizes[0] + sizes[1])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(s[taken]))
    return pa.RecordBatch.from_arrays(
        [pa.array(cases, p.field("case_id").type).take(pa.array(rows % n)), b.column("item_id").take(pa.array(rows // n)), pa.array(sizes[0][rows]),
         pa.array(sizes[1][rows]), pa.array(equal[rows]), lists.take(pa.array(rows))], names=["case_id", "item_id", "n_pred", "n_gold", "n_equal", "near"])


def _occurrence(keys: np.ndarray) -> np.ndarray:
    """How many earlier entries are equal, for each entry."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.arange(len(keys)) - np.searchsorted(ranked, ranked, side="left")
    return out


def open_scores(pred: DataFrame, gold: DataFrame, texts, embed, threshold: float, cases, longest: int | None = None) -> DataFrame:
    """Per case and record: matched texts and the sizes of both sides."""
    m = open_matches(pred, gold, texts, embed, threshold, cases, longest)
    return m.select("case_id", "item_id", "n_gold", "n_pred", (F.col("n_equal") + F.size("near")).alias("matched"))


def inclusive_range(start: float, stop: float, step: float):
    """Array of ``start``, ``start + step``, … up to and with ``stop``, to four digits; empty if ``stop`` comes before ``start``."""
    last = int((stop - start + 1e-9) // step)
    if last < 0:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda k: F.round(F.lit(float(start)) + k * F.lit(float(step)), 4))


def open_sweep(pred: DataFrame, gold: DataFrame, texts, embed, start: float, stop: float, step: float, cases, longest: int | None = None) -> DataFrame:
    """Counts and micro scores per case for every threshold from ``start`` to ``stop``, from one matching down to ``start``."""
    taus = inclusive_range(start, stop, step)
    none = F.lit(0).cast("long")

    def part(s, n, n_pred=none, n_gold=none):  # thresholds are counted before they are spread
        reached = F.size(F.filter(taus, lambda x: x <= s))
        return F.struct(reached.alias("reached"), n.alias("n"), n_pred.alias("n_pred"), n_gold.alias("n_gold"))

    m = open_matches(pred, gold, texts, embed, start, cases, longest)
    parts = F.concat(F.array(part(F.lit(1.0), F.col("n_equal"), F.col("n_pred"), F.col("n_gold"))), F.transform("near", lambda s: part(s, F.lit(1).cast("long"))))
    found = m.select("case_id", F.inline(parts)).groupBy("case_id", "reached").agg(*[F.sum(c).alias(c) for c in ("n", "n_pred", "n_gold")])
    rows = found.select("*", F.posexplode(taus).alias("place", "tau")).groupBy("case_id", "tau").agg(
        F.sum(F.when(F.col("place") < F.col("reached"), F.col("n")).otherwise(0)).alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("n_gold").alias("n_gold"))
    rows = rows.withColumn("fp", F.col("n_pred") - F.col("tp")).withColumn("fn", F.col("n_gold") - F.col("tp"))
    pr, rc, f = prf()
    return rows.select("case_id", "tau", "tp", "n_pred", "n_gold", pr.alias("precision"), rc.alias("recall"), f.alias("f1"))


def micro_summary(per_item: DataFrame, by=()) -> DataFrame:
    """Micro P/R/F1 with counts, and the spread of per-record recall."""
    by = list(by)
    recall = F.when(F.col("n_gold") > 0, F.col("matched") / F.col("n_gold"))
    s = per_item.groupBy(*by).agg(
        F.sum("matched").alias("tp"), F.sum(F.col("n_pred") - F.col("matched")).alias("fp"),
        F.sum(F.col("n_gold") - F.col("matched")).alias("fn"),
        F.percentile(recall, 0.5).alias("recall_median"),
        F.avg(F.when(recall < 0.5, 1.0).when(recall.isNotNull(), 0.0)).alias("frac_below_half"),
        F.avg(F.when(recall >= 0.999, 1.0).when(recall.isNotNull(), 0.0)).alias("frac_full"))
    p, r, f = prf()
    return s.select(*by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f.alias("f1"), "recall_median",
                    "frac_below_half", "frac_full")


def count_parity(pred: DataFrame, gold: DataFrame, by=()) -> DataFrame:
    """Mean predicted/reference count ratio and mean min/max coverage over records with a reference."""
    by = list(by)
    g = gold.groupBy("item_id").agg(F.count(F.lit(1)).alias("ng"))
    p = pred.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("np"))
    if by:
        g = g.select("*", F.explode(F.array(*[F.lit(r[0]) for r in pred.select(*by).distinct().orderBy(*by).collect()])
                                    ).alias(by[0]))
    rows = g.join(p, [*by, "item_id"], "left").fillna(0, ["np"])
    return rows.groupBy(*by).agg(
        F.avg(F.col("np") / F.col("ng")).alias("count_ratio"),
        F.avg(F.least("np", "ng") / F.greatest("np", "ng")).alias("count_coverage"))


def exact_triple_macro(pred: DataFrame, gold: DataFrame, cases=None) -> DataFrame:
    """Macro precision, recall and F1 over distinct lower-cased triples, each one class over the records.

    A record's copies of a triple are one row of bits, the reference and each case one; triples then meet by digest, in one
    shuffle for all cases. ``cases`` lists the cases that may occur; they are read from ``pred`` when not given.
    """
    if cases is None:
        cases = [r[0] for r in pred.select("case_id").distinct().orderBy("case_id").collect()]
    keys = [F.unhex(F.md5(F.lower(F.concat_ws(" | ", "h", "r", "t")))).alias("triple"), "item_id"]
    kind = dict(pred.dtypes)["case_id"]
    bit = F.lit(0).cast("bigint")
    for i, c in enumerate(cases, start=1):
        bit = F.when(F.col("case_id") == F.lit(c).cast(kind), F.lit(1 << i).cast("bigint")).otherwise(bit)
    rows = gold.select(*keys, F.lit(1).cast("bigint").alias("bits")).unionByName(pred.select(*keys, bit.alias("bits")))
    rows = rows.groupBy("item_id", "triple").agg(F.bit_or("bits").alias("bits"))
    has = lambda i: F.shiftrightunsigned("bits", i).bitwiseAND(F.lit(1).cast("bigint"))
    sums = [F.sum(has(0)).alias("ng")]
    for i in range(1, len(cases) + 1):
        met = F.when(F.col("item_id").isNotNull(), has(0) * has(i)).otherwise(F.lit(0))  # rows without a record meet nothing
        sums += [F.sum(has(i)).alias(f"np{i}"), F.sum(met).alias(f"tp{i}")]
    cls = rows.groupBy("triple").agg(*sums).select("ng", F.inline(F.array(*[F.struct(
        F.lit(c).cast(kind).alias("case_id"), F.col(f"np{i}").alias("np"), F.col(f"tp{i}").alias("tp")) for i, c in enumerate(cases, start=1)])))
    p_, r_ = ratio("tp", "np"), ratio("tp", "ng")
    s = cls.filter("ng > 0 or np > 0").groupBy("case_id").agg(F.avg(p_).alias("precision"), F.avg(r_).alias("recall"),
                                                             F.avg(f1(p_, r_)).alias("f1"), F.count(F.lit(1)).alias("n_classes"), F.sum("np").alias("np"))
    return s.filter("np > 0").drop("np")
