"""URL filtering: rules by longest fit, and for the rest a path-template tree per host, with DataFrame functions only.

* Segments with digits are variable at once: ``/en/825.html`` has the template ``/en/*.html``.
* Every prefix of a template is a branch under its parent. Counts of URLs and of labels per branch come from one
  explode and sums; pages are pre-aggregated by template first, so a host with a third of all pages adds one row per
  template it uses. Labels are the verdicts of the rules on the URLs that they fit.
* A parent with many thin branches has a variable segment there: all its branches become a wildcard. Branches whose
  share of blocked labels does not differ from their parent's by ``Z`` standard errors are merged into one; branches
  without labels are merged with each other, never with labelled ones.
* A merged template is rejected if its smoothed purity ``(blocked + 1) / (labelled + 2)`` reaches ``REJECT``. One without
  labels is judged by the same template on other hosts, each labelled host counting once, however many pages it has; where
  no host labels it, by its nearest labelled ancestor among the merged branches of its own host. Such borrowed purity is the lower
  end of an interval of ``Z`` standard errors. A whole host whose labels all block does not speak for its other branches.

Defined results: a null url, or one without ``://``, has an empty host and path and is allowed; the host keeps port and
user; a url with no path fits no rule, as every rule's path starts with a slash; rows repeating a page are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import cut

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
BRANCHES, THIN, Z, REJECT = 16, 4.0, 2.0, 0.8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none fits."""
    ranked = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    if not ranked:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    name = verdict = None
    for v, h, p in ranked:
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        name = F.when(fits, h + p) if name is None else name.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return name, verdict


def template(path: Column) -> Column:
    """Segments of a path, those with a digit reduced to a wildcard and their extension."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(segments, lambda s: F.regexp_replace(s, "[^.]*[0-9][^.]*", "*"))


def _branches(segments: Column) -> Column:
    """For each segment the hash of what stands above it."""
    step = lambda acc, s: F.struct(F.concat(acc["up"], F.array(acc["last"])).alias("up"), F.xxhash64(acc["last"], s).alias("last"))
    start = F.struct(F.array().cast("array<bigint>").alias("up"), F.lit(0).cast("bigint").alias("last"))
    return F.aggregate(segments, start, step)["up"]


def generalise(counts: DataFrame) -> DataFrame:
    """``(host, segments, n, blocked, labelled)`` -> the same with ``merged``, the template after merging branches."""
    rows = counts.select("host", "segments", "n", "blocked", "labelled", _branches(F.col("segments")).alias("up"))
    nodes = rows.select("host", "n", "blocked", "labelled", F.explode(F.arrays_zip("up", "segments")).alias("z")).groupBy(
        "host", F.col("z.up").alias("up"), F.col("z.segments").alias("segment")).agg(
        *[F.sum(c).alias(c) for c in ("n", "blocked", "labelled")])
    nodes = cut(nodes)
    parents = nodes.groupBy("host", "up").agg(F.count(F.lit(1)).alias("children"), *[F.sum(c).alias(f"all_{c}") for c in ("n", "blocked", "labelled")])
    share = lambda b, n: (F.col(b) + 1) / (F.col(n) + 2)
    p = share("all_blocked", "all_labelled")
    error = F.sqrt(p * (1 - p) / F.greatest(F.col("labelled"), F.lit(1)))
    thin = (F.col("children") > BRANCHES) & (F.col("all_n") / F.col("children") < THIN)
    alike = F.abs(share("blocked", "labelled") - p) <= Z * error
    name = F.when(thin, "**").when(F.col("labelled") == 0, "*-").when(alike, "*+").otherwise(F.col("segment"))
    told = cut(nodes.join(cut(parents), ["host", "up"]).select("host", "up", "segment", name.alias("name")))
    parts = rows.select("host", "segments", F.posexplode(F.arrays_zip("up", "segments")).alias("at", "z")).select(
        "host", "segments", "at", F.col("z.up").alias("up"), F.col("z.segments").alias("segment"))
    merged = parts.join(told, ["host", "up", "segment"]).groupBy("host", "segments").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("merged"))
    return counts.join(cut(merged), ["host", "segments"], "left").withColumn("merged", F.coalesce("merged", F.array().cast("array<string>")))


def _lower(blocked: str, labelled: str) -> Column:
    """The lower end of the interval of a smoothed purity."""
    n = F.col(labelled) + 2
    p = (F.col(blocked) + 1) / n
    return F.greatest(p - Z * F.sqrt(p * (1 - p) / n), F.lit(0.0))


def purities(trees: DataFrame) -> DataFrame:
    """``(host, segments, purity)`` of each template; 0.5 where neither other hosts nor an ancestor have labels for it."""
    known = cut(trees.groupBy("host", "merged").agg(F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")))
    told = known.filter("labelled > 0").select("host", "merged", ((F.col("blocked") + 1) / (F.col("labelled") + 2)).alias("own"))
    placed = cut(trees.select("host", "segments", "merged").join(told, ["host", "merged"], "left"))
    bare = placed.filter("own is null").select("host", "segments", "merged")
    hosts = trees.filter("labelled > 0").groupBy("segments").agg(F.sum(F.col("blocked") / F.col("labelled")).alias("blocked"), F.count(F.lit(1)).alias("labelled"))
    elsewhere = bare.join(hosts.select("segments", _lower("blocked", "labelled").alias("elsewhere")), "segments").select("host", "segments", "elsewhere")
    depth = F.explode(F.sequence(F.lit(0), F.size("merged"))).alias("depth")
    above = F.slice("merged", F.lit(1), F.col("depth")).alias("branch")
    branches = known.filter("labelled > 0").select("*", depth).select("host", above, "blocked", "labelled").groupBy("host", "branch").agg(
        F.sum("blocked").alias("blocked"), F.sum("labelled").alias("labelled")).filter("size(branch) > 0 or blocked < labelled").select(
        "host", "branch", _lower("blocked", "labelled").alias("share"))
    steps = bare.select("host", "segments", "merged", depth).select("host", "segments", "depth", above)
    nearest = steps.join(cut(branches), ["host", "branch"]).groupBy("host", "segments").agg(F.max_by("share", "depth").alias("nearest"))
    rows = placed.join(cut(elsewhere), ["host", "segments"], "left").join(cut(nearest), ["host", "segments"], "left")
    return rows.select("host", "segments", F.coalesce("own", "elsewhere", "nearest", F.lit(0.5)).alias("purity"))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """``pages(page_id, url)`` -> ``(page_id, host, path, rule, verdict, purity)``, one row per row."""
    host, path = host_and_path(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("told"), template(F.col("path")).alias("segments"))
    counts = cut(rows.groupBy("host", "segments").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("told") == "block").alias("blocked"), F.count("told").alias("labelled")))
    trees = cut(generalise(counts))
    out = rows.join(cut(purities(trees)), ["host", "segments"], "left")
    own = F.when(F.col("purity") >= REJECT, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("told", own).alias("verdict"), "purity")
