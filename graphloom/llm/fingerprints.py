"""Document fingerprints as invertible Bloom lookup sketches of sentence digests, with DataFrame functions only.

A piece is one or more whole sentences of a line, 48 characters at least, or 200 characters of a longer one. It ends where a sentence
does, so that an edit leaves most pieces after it as they were. A text with ``n`` distinct pieces has ``2 ** level`` sketches, for at most ``PER_PART`` pieces each on
average, and the low bits of a piece's 64-bit digest choose one. A sketch has three tables of ``CELLS`` cells; a digest goes into
one cell of each, and a cell holds a count, the xor of its digests and the xor of their check values. ``fingerprint`` is the text of
these sketches: ``n-level`` and ``part.cell.count.digests.checks`` of each cell in use.

Two versions are compared at the higher of their levels: where both have it, by the sketches that are returned. One version's cells are
subtracted from the other's, so that what both have cancels. Peeling reads a digest off each cell of a table that holds just
one, takes it out of its other two cells, and goes on with the next table. What does not peel down to nothing is sketched
again with twice the cells. The recovered digests are the differing pieces; likeness is the Jaccard similarity of the two
sets, from their sizes and the number of recovered digests.

A part of a document is a row with a bounded number of digests on average, so sketching and peeling are expressions of one row, and
nothing but the texts is shuffled: parts go back to their document on the partitioning by which texts met.

The next document in descending order of id is found inside blocks of consecutive ids (one shuffle of the texts); only
a block's last document looks up the first of the next block that has any. Documents that repeat an id follow each
other by the hash of their text; a null id or text: the text is empty if null, and documents without id follow all
others by that hash, in blocks of its high bits. Two texts without pieces have likeness 1.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut, sha_hex, text_key

PIECE = "[^\\n]{48,200}?[.!?]+|[^\\n]{1,200}"
BLOCK_BITS, FEW = 8, 4096
TABLES, CELLS, PER_PART, FAN_BITS = 3, 8, 8, 6
SIZES = tuple(CELLS * 2 ** i for i in range(1, 15))
ROUNDS = 9
ALONE, EDIT, NEXT = range(3)


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of the pieces."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def level(n: Column) -> Column:
    """The least number of bits that leaves ``PER_PART`` digests a part on average."""
    return F.when(n <= PER_PART, 0).otherwise(F.length(F.bin(F.floor((n - 1) / PER_PART))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _check(k: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(k, F.lit(77)), 32)


def _spots(k: Column, size: Column) -> Column:
    return F.array(*[(F.pmod(F.xxhash64(k, F.lit(t), size), size) + size * t).cast("int") for t in range(TABLES)])


def _cell(n: Column, k: Column, c: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.cast("long").alias("k"), c.cast("long").alias("c"))


def _entry(n: Column, k: Column, c: Column, size: Column) -> Column:
    return F.struct(n.cast("int").alias("n"), k.alias("k"), c.alias("c"), _spots(k, size).alias("spots"))


def _minus(x: Column, y: Column) -> Column:
    return _cell(x["n"] - y["n"], x["k"].bitwiseXOR(y["k"]), x["c"].bitwiseXOR(y["c"]))


def _without(cell: Column, entries: Column, at: Column) -> Column:
    """``cell`` number ``at`` after those of the entries that stand in it are taken out."""
    return F.aggregate(F.filter(entries, lambda e: F.array_contains(e["spots"], at)), cell, _minus)


def sketch(keys: Column, size: Column) -> Column:
    """The ``TABLES * size`` cells of an array of digests: each starts at nothing, and a digest enters it as one taken out of minus one."""
    nothing = _cell(F.lit(0), F.lit(0), F.lit(0))
    return _let(F.transform(keys, lambda k: _entry(F.lit(-1), k, _check(k), size)), lambda entries: F.transform(
        F.sequence(F.lit(0), size * TABLES - 1), lambda at: _without(nothing, entries, at)))


def subtract(one: Column, other: Column) -> Column:
    """Cell by cell; what both sketches hold cancels."""
    return F.zip_with(one, other, _minus)


def peel(cells: Column, size: Column) -> Column:
    """``(cells, found)``: what is left, and the digests read off with 1 if the first version holds them, -1 if the second.

    A table at a time, as a digest stands in one cell of each and is thus found once.
    """
    def turn(state: Column, table: Column) -> Column:
        pure = F.transform(F.filter(F.slice(state["cells"], table * size + 1, size), lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["k"]))),
                           lambda c: _entry(c["n"], c["k"], c["c"], size))
        after = _let(pure, lambda p: F.when(F.size(p) == 0, state).otherwise(F.struct(
            F.transform(state["cells"], lambda c, at: _without(c, p, at)).alias("cells"),
            F.concat(state["found"], F.transform(p, lambda e: F.struct(e["k"].alias("k"), e["n"].alias("n")))).alias("found"))))
        return F.when(settled(state["cells"]), state).otherwise(after)

    start = F.struct(cells.alias("cells"), F.array().cast("array<struct<k:bigint,n:int>>").alias("found"))
    return F.aggregate(F.array(*[F.lit(r % TABLES) for r in range(ROUNDS)]), start, turn)


def settled(cells: Column) -> Column:
    return ~F.exists(cells, lambda c: (c["n"] != 0) | (c["k"] != 0) | (c["c"] != 0))


def _recovered(one: Column, other: Column, size: Column) -> Column:
    """The digests that the difference of two sketches peels down to, or null."""
    return _let(peel(subtract(one, other), size), lambda s: F.when(settled(s["cells"]), s["found"]))


def differing(a: Column, b: Column, one: Column, other: Column) -> Column:
    """``array<(k, n)>``: the digests that only ``a`` (n = 1) or only ``b`` (n = -1) holds, from their sketches ``one`` and ``other``.

    Null if no size of ``SIZES`` peels either.
    """
    def larger(found: Column, size: Column) -> Column:
        return F.when(found.isNotNull(), found).otherwise(_recovered(sketch(a, size), sketch(b, size), size))

    return F.aggregate(F.array(*[F.lit(s) for s in SIZES]), _recovered(one, other, F.lit(CELLS)), larger)


def as_text(cells: Column, part: Column) -> Column:
    """The cells in use of one part."""
    told = F.transform(cells, lambda c, at: F.when(c["n"] != 0, F.concat_ws(
        ".", part.cast("string"), at.cast("string"), c["n"].cast("string"), F.lower(F.hex(c["k"])), F.lower(F.hex(c["c"])))))
    return F.array_join(told, "-")


def split(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``(*kept, level, a, b)`` -> ``(*kept, part, a, b)``, a row per part: by ``FAN_BITS`` bits of the digests first, then by the others.

    Each step reads a row's digests once per part of that step only, so long documents cost little more than short ones.
    """
    def fan(df: DataFrame, first: str, bits: str, into: str) -> DataFrame:
        rest = [c for c in df.columns if c not in ("a", "b")]
        masked = df.withColumn("mask", F.call_function("shiftleft", F.lit(1).cast("long"), F.col(bits)) - 1)
        here = lambda keys, h: F.filter(keys, lambda k: F.call_function("shiftrightunsigned", k, F.col(first)).bitwiseAND(F.col("mask")) == h)
        return masked.select(*rest, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("mask")), lambda h: F.struct(
            h.alias(into), here(F.col("a"), h).alias("a"), here(F.col("b"), h).alias("b")))).alias("f")).select(*rest, "f.*")

    bits = rows.withColumns({"none": F.lit(0), "few": F.least(F.col("level"), F.lit(FAN_BITS))}).withColumn("others", F.col("level") - F.col("few"))
    fanned = fan(fan(bits, "none", "few", "low"), "few", "others", "high")
    return fanned.select(*kept, (F.col("low") + F.call_function("shiftleft", F.col("high"), F.col("few"))).alias("part"), "a", "b")


def compare(rows: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """``(*keys, *kept, own, changed, after)`` with digest sets -> ``(*keys, *kept, fingerprint, edited_fingerprint, only_own, only_edited,
    near_edited, near_next)``. Needs no shuffle where rows are dealt by some of ``keys``.
    """
    n_own, n_changed, n_after = F.size("own"), F.size("changed"), F.size("after")
    none, alike = F.array().cast("array<bigint>"), level(n_own) == level(n_changed)
    job = lambda what, tell, bits, a, b: F.struct(
        F.lit(what).alias("what"), tell.alias("tell"), bits.alias("level"), a.alias("a"), b.alias("b"))
    own, changed, after = F.col("own"), F.col("changed"), F.col("after")
    # a job that tells writes its sketches into the fingerprints: the edit's, unless the two texts have sketches of unlike levels
    pairs = [job(EDIT, alike, F.greatest(level(n_own), level(n_changed)), own, changed),
             job(NEXT, F.lit(False), F.greatest(level(n_own), level(n_after)), own, after)]
    alone = [job(ALONE, F.lit(True), level(n_own), own, none), job(ALONE, F.lit(True), level(n_changed), none, changed)]
    jobs = F.when(alike, F.array(*pairs)).otherwise(F.array(*pairs, *alone))
    sizes = {"n_own": n_own, "n_changed": n_changed, "n_after": n_after}
    carried = [*keys, *kept, *sizes]
    parts = split(rows.select(*keys, *kept, *[c.alias(k) for k, c in sizes.items()], F.explode(jobs).alias("j")).select(*carried, "j.*"),
                  [*carried, "what", "tell"])
    cells = parts.withColumns({"one": sketch(F.col("a"), F.lit(CELLS)), "other": sketch(F.col("b"), F.lit(CELLS))})
    told = cells.select(*carried, "what", "part", *[F.when(F.col("tell"), as_text(F.col(c), F.col("part"))).alias(c) for c in ("one", "other")], F.when(
        F.col("what") != ALONE, F.coalesce(differing(*map(F.col, ("a", "b", "one", "other"))), F.raise_error(F.lit("no sketch size peels")))).alias("found"))
    prints = lambda c: F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct("part", F.col(c).alias("print")))))
    of = lambda what: F.when(F.col("what") == what, F.col("found"))
    differ = lambda what: F.sum(F.coalesce(F.size(of(what)), F.lit(0)))
    whole = told.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in (*kept, *sizes)], prints("one").alias("p0"), prints("other").alias("p1"),
        F.flatten(F.collect_list(of(EDIT))).alias("edits"), differ(EDIT).alias("d2"), differ(NEXT).alias("d3"))
    text = lambda n, p: F.concat_ws("-", F.col(n).cast("string"), level(F.col(n)).cast("string"), F.transform(p, lambda x: x["print"]))
    near = lambda n, d: F.when(F.col("n_own") + F.col(n) == 0, 1.0).otherwise((F.col("n_own") + F.col(n) - F.col(d)) / (F.col("n_own") + F.col(n) + F.col(d)))
    only = lambda n: F.array_sort(F.transform(F.filter("edits", lambda e: e["n"] == n), lambda e: e["k"]))
    return whole.select(*keys, *kept, text("n_own", "p0").alias("fingerprint"), text("n_changed", "p1").alias("edited_fingerprint"),
                        only(1).alias("only_own"), only(-1).alias("only_edited"), near("n_changed", "d2").alias("near_edited"), near("n_after", "d3").alias("near_next"))


def next_lower(ids: DataFrame) -> DataFrame:
    """``(id)`` distinct -> ``(id, next)``, the next lower id; of the lowest the highest. Blocks of ids, level by level."""
    if ids.count() <= FEW:
        top = F.max("id").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        return ids.select("id", F.coalesce(F.lead("id").over(Window.orderBy(F.desc("id"))), top).alias("next"))
    rows = ids.withColumn("block", F.shiftright("id", 12))
    tops = cut(rows.groupBy("block").agg(F.max("id").alias("top")))
    order = next_lower(tops.select(F.col("block").alias("id"))).select(F.col("id").alias("block"), F.col("next").alias("b"))
    following = cut(order.join(tops.select(F.col("block").alias("b"), "top"), "b").select("block", "top"))
    inner = rows.withColumn("in", F.lead("id").over(Window.partitionBy("block").orderBy(F.desc("id"))))
    return inner.join(following, "block").select("id", F.coalesce("in", "top").alias("next"))


def fingerprint(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, only_own, only_edited, near_edited, near_next)``.

    ``only_own`` and ``only_edited`` are the recovered digests of pieces that one of the two versions lacks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = text_key(F.col("text"))
    block = F.coalesce(F.shiftright(F.col("doc_id").cast("long"), BLOCK_BITS), F.lit(-(1 << 62)) - F.shiftright(key, 16))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), key.alias("key"), block.alias("block"))
    order = Window.partitionBy("block").orderBy(F.desc_nulls_last("doc_id"), "key")
    placed = rows.select("*", F.row_number().over(order).alias("place"), F.lead("text").over(order).alias("next_text"))
    blocks = cut(rows.select("block").distinct())
    order_of = cut(next_lower(blocks.select(F.col("block").alias("id"))).select(F.col("id").alias("block"), F.col("next").alias("after")))
    first = placed.filter("place = 1").select(F.col("block").alias("after"), F.col("text").alias("next_text"))
    last = placed.filter("next_text is null").drop("next_text").join(order_of, "block").join(first, "after")

    def told(both: DataFrame) -> DataFrame:
        n = F.length("text")
        half = F.floor(n / 2).cast("int")
        edited = both.select("block", "place", "doc_id", "text", "next_text", n.cast("long").alias("n_chars"), F.concat(
            F.substr("text", F.lit(1), n - half), F.substr("next_text", F.lit(1), half)).alias("edited"))
        sets = edited.select("block", "place", "doc_id", "n_chars", sha_hex(F.col("edited")).alias("edited_sha256"), digests(F.col("text")).alias("own"),
                             digests(F.col("edited")).alias("changed"), digests(F.col("next_text")).alias("after"))
        return compare(sets, ["block", "place"], ["doc_id", "n_chars", "edited_sha256"]).drop("block", "place")

    return told(placed.filter("next_text is not null")).unionByName(told(last))
