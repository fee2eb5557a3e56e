"""Word-span triple scoring: exact, strict, partial and type F1 under the best one-to-one assignment.

Span semantics follow the published SemEval-2013 task 9.1 scheme
(an overlap is tested on half-open ranges, so a one-word span only matches exactly). A record's predicted and
reference lists are two array columns of one row, so a task holds one record at a time.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from graphloom.functions.literals import normalize_literal
from graphloom.functions.text import strip, token_words

TAGS = ("SUB", "PRED", "OBJ")
SCHEMES = ("ent_type", "partial", "strict", "exact")
# Words the Treebank tokeniser splits in two.
SPLIT_WORDS = {"cannot": ("can", "not"), "gimme": ("gim", "me"), "gonna": ("gon", "na"), "gotta": ("got", "ta"),
               "lemme": ("lem", "me"), "wanna": ("wan", "na")}
_CACHE = 1 << 16
_EXHAUSTIVE = 8


@lru_cache(maxsize=_CACHE)
def _words(text):
    out = []
    for w in text.split():
        out.extend(SPLIT_WORDS.get(w, (w,)))
    return tuple(out)


def _shared_runs(ref, cand):
    """Disjoint common runs ``(c, r, n)`` in candidate order, longer ones taken first, then earlier ones."""
    same = np.equal.outer(np.array(cand, dtype=object), np.array(ref, dtype=object)).astype(bool)
    length = np.zeros((len(cand) + 1, len(ref) + 1), dtype=int)  # of the longest run from each pair of words
    for c in range(len(cand) - 1, -1, -1):
        length[c, :-1] = np.where(same[c], length[c + 1, 1:] + 1, 0)
    runs = sorted((-n, c, r) for c, r in zip(*np.nonzero(same), strict=True) for n in range(1, length[c, r] + 1))
    free_c, free_r, taken = np.ones(len(cand), bool), np.ones(len(ref), bool), []
    for n, c, r in runs:
        if free_c[c:c - n].all() and free_r[r:r - n].all():
            free_c[c:c - n] = free_r[r:r - n] = False
            taken.append((int(c), int(r), -n))
    return sorted(taken)


@lru_cache(maxsize=_CACHE)
def _attribute(ref_text, cand_text):
    """The spans of two texts; only which of their words are equal matters, so texts of one pattern share the work."""
    number: dict = {}
    ref, cand = (tuple([number.setdefault(w, len(number)) for w in _words(x)]) for x in (ref_text, cand_text))
    return _spans(ref, cand)


@lru_cache(maxsize=_CACHE)
def _spans(ref, cand):
    """(found, length, reference spans, candidate spans) of one attribute, positions counted from zero.

    The reference is one span. Each shared run covers its place there; what the candidate has before a run at the reference's first
    word, or after one at its last word, widens that run. Other gaps between runs follow behind, a span each. A run is also
    counted with each number of the reference words that it leaves uncovered up to the next span.
    """
    runs = _shared_runs(ref, cand)
    if not runs:
        refs = ((0, len(ref) - 1),) if ref else ()
        cands = ((len(ref), len(ref) + len(cand) - 1),) if cand or not ref else ()
        return False, len(ref) + len(cand), refs, cands
    starts = [0] + [c + n for c, _, n in runs]
    gaps = [end - start for start, end in zip(starts, [c for c, _, _ in runs] + [len(cand)], strict=True)]
    before = gaps[0] if runs[0][1] == 0 else 0
    after = gaps[-1] if runs[-1][1] + runs[-1][2] == len(ref) else 0
    covers = sorted((before + r - (before if k == 0 else 0), before + r + n - 1 + (after if k == len(runs) - 1 else 0))
                    for k, (_, r, n) in enumerate(runs))
    at, loose = before + len(ref) + after, []
    for k, gap in enumerate(gaps):
        if gap and not (k == 0 and before) and not (k == len(gaps) - 1 and after):
            loose.append((at, at + gap - 1))
            at += gap
    ends = [first for first, _ in covers[1:]] + [before + len(ref) + after]
    spans = list(loose)
    for k, ((first, last), end) in enumerate(zip(covers, ends, strict=True)):
        open_end = k == len(covers) - 1 and not loose
        spans += [(first, x) for x in range(last, max(last + 1, end - open_end))]
    return True, at, ((before, before + len(ref) - 1),), tuple(sorted(spans))


def _parts(ref, cand):
    """The spans of a triple pair by attribute, and where each came from; ends that match nothing may be compared crosswise."""
    plain = [_attribute(r, c) for r, c in zip(ref, cand)]
    source = [0, 1, 2]
    for a, b in ((0, 2), (0, 1), (1, 2)):
        if not plain[a][0] and not plain[b][0]:
            x, y = _attribute(ref[a], cand[b]), _attribute(ref[b], cand[a])
            if x[0] or y[0]:
                plain[a], plain[b] = x, y
                source[a], source[b] = b, a
                break
    return tuple(plain), tuple(source)


def _layout(plain, source):
    """Labelled spans of a triple pair."""
    true, pred, base = [], [], 0
    for i, (_, length, refs, cands) in enumerate(plain):
        true += [(i, base + s, base + e) for s, e in refs]
        pred += [(source[i], base + s, base + e) for s, e in cands]
        base += length
    return true, pred


def _f1(correct, part, actual, possible):
    p = (correct + 0.5 * part) / actual if actual else 0.0
    r = (correct + 0.5 * part) / possible if possible else 0.0
    return 2 * p * r / (p + r) if p + r else 0.0


def pair_scores(ref, cand):
    """F1 of a reference and a candidate triple (tuples of words) under the four schemes."""
    if ref == cand and all(ref):
        return 1.0, 1.0, 1.0, 1.0
    return _span_scores(*_parts(ref, cand))


@lru_cache(maxsize=_CACHE)
def _span_scores(plain, source):
    true, pred = _layout(plain, source)
    counts = dict(typ=[0, 0], part=[0, 0, 0], strict=[0, 0], exact=[0, 0])
    met, spurious = set(), 0
    for p in pred:
        if p in true:
            met.add(p)
            for c in counts.values():
                c[0] += 1
            continue
        for t in true:
            if p[1:] == t[1:]:
                counts["strict"][1] += 1
                counts["typ"][1] += 1
                counts["part"][0] += 1
                counts["exact"][0] += 1
                met.add(t)
                break
            if max(p[1], t[1]) < min(p[2], t[2]):
                counts["strict"][1] += 1
                counts["exact"][1] += 1
                counts["part"][2] += 1
                counts["typ"][0 if p[0] == t[0] else 1] += 1
                met.add(t)
                break
        else:
            spurious += 1
    missed = sum(1 for t in true if t not in met)

    def f(c, part=0):
        seen = c[0] + c[1] + part
        return _f1(c[0], part, seen + spurious, seen + missed)

    return f(counts["typ"]), f(counts["part"], counts["part"][2]), f(counts["strict"]), f(counts["exact"])


def _best_exhaustive(gain):
    """First optimal assignment in row-major order, by dynamic programming over used columns."""
    n = len(gain)
    best = {(1 << n) - 1: 0.0}
    layers = [best]
    for row in range(n - 1, -1, -1):
        nxt = {}
        for used, value in layers[-1].items():
            for col in range(n):
                if used >> col & 1:
                    key = used ^ (1 << col)
                    v = value + gain[row][col]
                    if v > nxt.get(key, -1.0):
                        nxt[key] = v
        layers.append(nxt)
    layers.reverse()
    used, pick = 0, []
    for row in range(n):
        target = layers[row][used]
        for col in range(n):
            if not used >> col & 1:
                rest = layers[row + 1].get(used | 1 << col)
                if rest is not None and gain[row][col] + rest >= target - 1e-12:
                    pick.append(col)
                    used |= 1 << col
                    break
    return pick


def assign(cost):
    """Minimum-cost one-to-one assignment of a square matrix (shortest augmenting paths with potentials)."""
    cost = np.asarray(cost, dtype=float)
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, dtype=int)  # row (1-based) that holds each column
    for row in range(1, n + 1):
        owner[0] = row
        col = 0
        slack = np.full(n + 1, np.inf)
        back = np.zeros(n + 1, dtype=int)
        done = np.zeros(n + 1, dtype=bool)
        while owner[col]:
            done[col] = True
            r = owner[col]
            free = ~done[1:]
            reduced = cost[r - 1] - u[r] - v[1:]
            better = free & (reduced < slack[1:])
            slack[1:][better] = reduced[better]
            back[1:][better] = col
            nxt = int(np.argmin(np.where(free, slack[1:], np.inf))) + 1
            delta = slack[nxt]
            u[owner[done]] += delta
            v[done] -= delta
            slack[~done] -= delta
            col = nxt
        while col:
            owner[col] = owner[back[col]]
            col = back[col]
    pick = np.zeros(n, dtype=int)
    pick[owner[1:] - 1] = np.arange(n)
    return pick.tolist()


def record_scores(pred, gold):
    """(exact, strict, partial) F1 of one record's word triples."""
    if not pred or not gold:
        return 0.0, 0.0, 0.0
    n = max(len(pred), len(gold))
    pad = ("", "", "")
    cands = [tuple(x) for x in pred] + [pad] * (n - len(pred))
    refs = [tuple(x) for x in gold] + [pad] * (n - len(gold))
    table = [[pair_scores(r, c) for r in refs] for c in cands]
    gain = [[sum(s) / 4 for s in row] for row in table]
    pick = _best_exhaustive(gain) if n <= _EXHAUSTIVE else assign(-np.asarray(gain))
    chosen = [table[i][j] for i, j in enumerate(pick)]
    return tuple(sum(s[k] for s in chosen) / n for k in (3, 2, 1))


# ---------------------------------------------------------------- many records at once

_WIDTH = 8  # texts of at most this many words have their shared words packed into one number
_CLASSES: dict = {}  # kind of a text pair -> its number
_SPANS_OF: list = []  # its spans, as _spans has them


def _class_of(ref, cand):
    """The number of the spans of two word lists."""
    number: dict = {}
    spans = _spans(*(tuple([number.setdefault(w, len(number)) for w in x]) for x in (ref, cand)))
    if spans not in _CLASSES:
        _CLASSES[spans] = len(_SPANS_OF)
        _SPANS_OF.append(spans)
    return _CLASSES[spans]


class _Texts:
    """Numbered texts with their words, and the spans of pairs of them."""

    def __init__(self, texts):
        self.words = [_words(x) for x in texts]
        number: dict = {}
        self.size = np.array([len(w) for w in self.words], dtype=np.int64)
        self.table = np.full((len(texts), _WIDTH), -1, dtype=np.int64)
        for i, ws in enumerate(self.words):
            if len(ws) <= _WIDTH:
                for k, w in enumerate(ws):
                    self.table[i, k] = number.setdefault(w, len(number))

    def classes(self, ref, cand):
        """Class numbers of the text pairs; only which words they share and how many they have decides, so that is worked out once each."""
        pairs, back = np.unique(ref * len(self.words) + cand, return_inverse=True)
        ref, cand = pairs // len(self.words), pairs % len(self.words)
        out = np.full(len(pairs), -1, dtype=np.int64)
        short = (self.size[ref] <= _WIDTH) & (self.size[cand] <= _WIDTH)
        shared = np.zeros(len(pairs), dtype=np.uint64)
        at = np.flatnonzero(short)
        for i in range(int(self.size[cand[at]].max(initial=0))):
            word = self.table[cand[at], i]
            for j in range(int(self.size[ref[at]].max(initial=0))):
                shared[at] |= ((word == self.table[ref[at], j]) & (word >= 0)).astype(np.uint64) << np.uint64(i * _WIDTH + j)
        order = np.lexsort((shared[at], self.size[cand[at]], self.size[ref[at]]))
        at = at[order]
        new = np.ones(len(at), dtype=bool)
        if len(at):
            new[1:] = (np.diff(shared[at].view(np.int64)) != 0) | (np.diff(self.size[ref[at]]) != 0) | (np.diff(self.size[cand[at]]) != 0)
            first = at[new]
            found = np.array([_class_of(self.words[r], self.words[c]) for r, c in zip(ref[first], cand[first])], dtype=np.int64)
            out[at] = found[np.cumsum(new) - 1]
        for i in np.flatnonzero(~short):
            out[i] = _class_of(self.words[ref[i]], self.words[cand[i]])
        return out[back.reshape(-1)]


def _pair_tables(texts, refs, cands):
    """Scores under the four schemes of all reference and candidate triples (rows of three text numbers) that stand side by side."""
    kinds = [texts.classes(refs[:, i], cands[:, i]) for i in range(3)]
    known = lambda k: np.array([s[0] for s in _SPANS_OF], dtype=bool)[k]
    found = [known(k) for k in kinds]
    source, crossed = np.zeros(len(refs), dtype=np.int64), np.zeros(len(refs), dtype=bool)
    swaps = ((0, 2), (0, 1), (1, 2))
    for code, (a, b) in enumerate(swaps, start=1):
        at = np.flatnonzero(~crossed & ~found[a] & ~found[b])
        x, y = texts.classes(refs[at, a], cands[at, b]), texts.classes(refs[at, b], cands[at, a])
        hit = known(x) | known(y)
        kinds[a][at[hit]], kinds[b][at[hit]] = x[hit], y[hit]
        source[at[hit]], crossed[at[hit]] = code, True
    n = len(_SPANS_OF)
    keys, back = np.unique(((kinds[0] * n + kinds[1]) * n + kinds[2]) * 4 + source, return_inverse=True)
    origins = [(0, 1, 2)]
    for a, b in swaps:
        o = [0, 1, 2]
        o[a], o[b] = b, a
        origins.append(tuple(o))
    scores = np.array([_span_scores(tuple(_SPANS_OF[int(k)] for k in (q // 4 // n // n, q // 4 // n % n, q // 4 % n)), origins[int(q % 4)])
                       for q in keys], dtype=float).reshape(-1, 4)
    out = scores[back.reshape(-1)]
    out[(refs == cands).all(axis=1) & (texts.size[refs] > 0).all(axis=1)] = 1.0
    return out


def _best_exhaustive_many(gain):
    """:func:`_best_exhaustive` of a stack of matrices."""
    many, n, _ = gain.shape
    masks = np.arange(1 << n)
    taken = np.array([bin(m).count("1") for m in masks])
    value = np.full((many, 1 << n), -1.0)
    value[:, -1] = 0.0
    for row in range(n - 1, -1, -1):
        for col in range(n):
            at = masks[(taken == row) & (masks >> col & 1 == 0)]
            value[:, at] = np.maximum(value[:, at], gain[:, row, col][:, None] + value[:, at | 1 << col])
    rows, used, pick = np.arange(many), np.zeros(many, dtype=np.int64), np.full((many, n), -1)
    for row in range(n):
        target, before = value[rows, used], used.copy()
        for col in range(n):
            fits = (pick[:, row] < 0) & (before >> col & 1 == 0) & (gain[:, row, col] + value[rows, before | 1 << col] >= target - 1e-12)
            pick[fits, row] = col
            used[fits] |= 1 << col
    return pick


def _assign_many(cost):
    """:func:`assign` of a stack of matrices, step by step at once."""
    many, n, _ = cost.shape
    u, v = np.zeros((many, n + 1)), np.zeros((many, n + 1))
    owner = np.zeros((many, n + 1), dtype=np.int64)
    everyone = np.arange(many)
    for row in range(1, n + 1):
        owner[:, 0] = row
        col = np.zeros(many, dtype=np.int64)
        slack = np.full((many, n + 1), np.inf)
        back = np.zeros((many, n + 1), dtype=np.int64)
        done = np.zeros((many, n + 1), dtype=bool)
        a = everyone
        while len(a):
            done[a, col[a]] = True
            r, d = owner[a, col[a]], done[a]
            reduced = cost[a, r - 1] - u[a, r][:, None] - v[a, 1:]
            free, s = ~d[:, 1:], slack[a]
            better = free & (reduced < s[:, 1:])
            s[:, 1:][better] = reduced[better]
            p = back[a]
            p[:, 1:][better] = np.broadcast_to(col[a][:, None], better.shape)[better]
            back[a] = p
            nxt = np.argmin(np.where(free, s[:, 1:], np.inf), axis=1) + 1
            delta = s[np.arange(len(a)), nxt]
            i, j = np.nonzero(d)
            u[a[i], owner[a[i], j]] += delta[i]
            v[a] -= np.where(d, delta[:, None], 0.0)
            slack[a] = s - np.where(d, 0.0, delta[:, None])
            col[a] = nxt
            a = a[owner[a, nxt] != 0]
        a = everyone
        while len(a):
            before = back[a, col[a]]
            owner[a, col[a]] = owner[a, before]
            col[a] = before
            a = a[before != 0]
    pick = np.zeros((many, n), dtype=np.int64)
    pick[everyone[:, None], owner[:, 1:] - 1] = np.arange(n)
    return pick


def many_scores(preds, golds, names=None, words=None):
    """(exact, strict, partial) of each record as :func:`record_scores` has them, from Arrow arrays of lists of triples.

    ``names`` and ``words`` list each text of a record with its word form, NULL for one that leaves its triple out; without
    them the triples hold words.
    """
    if len(_SPANS_OF) > _CACHE:  # numbers only mean something inside one call
        _CLASSES.clear()
        _SPANS_OF.clear()
    flat = [x.flatten() for x in (preds, golds)]
    said = [x.flatten().cast(pa.string()) for x in flat]
    given = [pa.array([], pa.string()) if x is None else x.flatten().cast(pa.string()) for x in (names, words)]
    coded = pa.concat_arrays([pa.array([""], pa.string()), *said, *given]).dictionary_encode()
    ids = np.asarray(pc.fill_null(coded.indices, -1), dtype=np.int64)
    cuts = np.cumsum([1, *(len(x) for x in (*said, *given))])
    parts = [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    form = np.arange(len(coded.dictionary) + 1)  # the last stands for NULL
    if names is not None:
        form[parts[2]] = parts[3]
    form[-1] = -1
    used = np.unique(np.concatenate([[0], *(form[x] for x in parts[:2])]))
    used = used[used >= 0]
    texts = _Texts(coded.dictionary.take(pa.array(used)).to_pylist())
    number = np.full(len(form) + 1, -1, dtype=np.int64)
    number[used] = np.arange(len(used))
    lists, sizes = [], []
    for x, rows, part in zip((preds, golds), flat, parts):
        part, width = number[form[part]], np.asarray(pc.fill_null(pc.list_value_length(rows), 0), dtype=np.int64)
        whole = np.flatnonzero(width == 3)
        triples = part[(np.cumsum(width) - width)[whole][:, None] + np.arange(3)]
        full = (triples >= 0).all(axis=1)
        length = np.asarray(pc.fill_null(pc.list_value_length(x), 0), dtype=np.int64)
        owner = np.repeat(np.arange(len(x)), length)[whole][full]
        lists.append(triples[full])
        sizes.append(np.bincount(owner, minlength=len(x)))
    first = [np.cumsum(s) - s for s in sizes]
    out = np.zeros((len(preds), 3))
    longest = np.where((sizes[0] > 0) & (sizes[1] > 0), np.maximum(*sizes), 0)
    for n in np.unique(longest[longest > 0]):
        rows = np.flatnonzero(longest == n)
        step = max(1, _PAIRS // int(n * n))
        for k in range(0, len(rows), step):
            out[rows[k:k + step]] = _same_length(texts, lists, first, sizes, rows[k:k + step], int(n))
    return out


def _same_length(texts, lists, first, sizes, rows, n):
    cands, refs = (np.zeros((len(rows), n, 3), dtype=np.int64) for _ in range(2))  # text 0 is the empty one
    for out, ids, start, size in zip((cands, refs), lists, first, sizes):
        inside = np.arange(n)[None, :] < size[rows][:, None]
        out[inside] = ids[(start[rows][:, None] + np.arange(n))[inside]]
    wide = (len(rows), n, n, 3)
    table = _pair_tables(texts, np.broadcast_to(refs[:, None], wide).reshape(-1, 3), np.broadcast_to(cands[:, :, None], wide).reshape(-1, 3))
    gain = ((((table[:, 0] + table[:, 1]) + table[:, 2]) + table[:, 3]) / 4).reshape(len(rows), n, n)
    pick = _best_exhaustive_many(gain) if n <= _EXHAUSTIVE else _assign_many(-gain)
    chosen = table.reshape(len(rows), n, n, 4)[np.arange(len(rows))[:, None], np.arange(n)[None, :], pick]
    total = np.zeros((len(rows), 4))
    for i in range(n):  # in row order, as the sums of one record
        total += chosen[:, i]
    return total[:, [3, 2, 1]] / n


_PAIRS = 1 << 19  # pairs of triples worked on at once
_ROWS = 4096  # records scored at once


@F.arrow_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("exact", "strict", "partial")]))
def _score(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    held, n = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            n += len(batch[0])
        if held and (batch is None or n >= _ROWS):
            out = many_scores(*(pa.concat_arrays([h[i] for h in held]) for i in range(4)))
            struct = pa.StructArray.from_arrays([pa.array(out[:, i]) for i in range(3)], ["exact", "strict", "partial"])
            at = 0
            for h in held:
                yield struct.slice(at, len(h[0]))
                at += len(h[0])
            held, n = [], 0


def with_words(records: DataFrame, *lists) -> DataFrame:
    """Add ``names``, the different texts of the triple lists, and ``words``, their word form; NULL for a text that is blank."""
    names = F.array_distinct(F.concat(*[F.flatten(F.coalesce(x, F.array().cast("array<array<string>>"))) for x in lists]))
    word = lambda x: F.when(strip(x) != "", token_words(strip(x)))
    return records.withColumn("names", names).withColumn("words", F.transform("names", word))


def literal_triples(rows):
    """Literal-normalised heads and tails; the relation stays as it is."""
    return F.transform(rows, lambda t: F.array(normalize_literal(t[0]), t[1], normalize_literal(t[2])))


def span_scores(records: DataFrame) -> DataFrame:
    """Add ``exact``, ``strict`` and ``partial`` to ``records(…, pred, gold)`` (arrays of string triples).

    Triples that have a NULL or empty part do not count. Rows may bring the word forms of their texts (:func:`with_words`).
    """
    keep = [c for c in records.columns if c not in ("names", "words")]
    if "words" not in records.columns:
        records = with_words(records, F.col("pred"), F.col("gold"))
    s = records.withColumn("_s", _score("pred", "gold", "names", "words"))
    return s.select(*keep, "_s.exact", "_s.strict", "_s.partial")


def table_scores(records: DataFrame, by=("case_id",)) -> DataFrame:
    """Mean scores per case, raw and literal-normalised, and their gap."""
    by = list(by)
    raw = span_scores(records).groupBy(*by).agg(*[F.avg(m).alias(m) for m in ("exact", "strict", "partial")])
    norm = records.withColumn("pred", literal_triples(F.col("pred"))).withColumn("gold", literal_triples(F.col("gold")))
    norm = span_scores(norm).groupBy(*by).agg(*[F.avg(m).alias(f"{m}_norm") for m in ("exact", "strict", "partial")])
    rows = raw.join(norm, by)
    for m in ("exact", "strict", "partial"):
        rows = rows.withColumn(f"{m}_gap", F.col(f"{m}_norm") - F.col(m))
    return rows
