"""URL filter: rules first, then the ratio of two character language models.

The rules' own verdicts label the URLs they decide. From those, two variable-order Markov models
are counted, one of accepted and one of rejected URLs: followers of every context of up to
``ORDER`` characters, over all labelled URLs. Every count is kept, so the models grow with the
corpus and stay a table: URLs are dealt into chunks of about ``CHUNK``, the strings that a chunk's
URLs look up are joined with the table, and each chunk is scored from what it was sent.
Probabilities are smoothed by Witten-Bell interpolation from the longest context seen down to a
uniform one. A URL's score is the difference of its two
log-likelihoods by character; the threshold is calibrated on labelled URLs that the models did not
see (a fifth, by a hash of the URL), as the best difference of true and false acceptances.

Defined results: a null URL or one without ``://`` has an empty host and path, no rule and a score
of 0; without labelled URLs of both kinds every other URL is allowed. Repeated rows are judged one
by one.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: (verdict, host and all below it, start of the path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
ORDER = 6
ALPHABET = 256
#: URLs scored at once, so many that they share most of the strings that they look up.
CHUNK = 4096
#: Distinct entries that a task counts before it sends them on.
FLUSH = 300_000
#: Bins of the calibration histogram over scores from -SPAN to SPAN.
BINS, SPAN = 2000, 10.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    u = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.substring(u, F.instr(u, "://") + F.lit(3), F.length(u))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(df: DataFrame, rules: tuple = RULES) -> DataFrame:
    """Adds rule (the longest that fits, else null) and by_rule (its verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return df.withColumns({"rule": rule, "by_rule": verdict})


def grams(text: str, order: int) -> Iterator[str]:
    """Every follower with each of its contexts: the strings of 1 to order + 1 characters that end
    at each place, the text's start being marked by two characters no URL holds."""
    t = "\x02" + text + "\x03"
    for i in range(1, len(t)):
        for k in range(min(order, i) + 1):
            yield t[i - k : i + 1]


def _count(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def rows() -> pa.RecordBatch:
            k = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in k]), pa.array([x[1] for x in k]), pa.array([seen[x] for x in k], pa.int64())], names=["label", "gram", "n"])

        for b in batches:
            for label, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((label, g) for g in grams(url, order))
                if len(seen) > FLUSH:
                    yield rows()
                    seen.clear()
        if seen:
            yield rows()

    return run


def _lookups(order: int):
    """chunk, s: the strings that the URLs' scores depend on, once a chunk and flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = defaultdict(set)

        def rows() -> pa.RecordBatch:
            c = [c for c, x in seen.items() for _ in x]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array([g for x in seen.values() for g in x], pa.string())], names=["chunk", "s"])

        for b in batches:
            for chunk, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if url:
                    seen[chunk].update(("", "\x02"), grams(url, order))  # contexts are grams, too, but for these two
            if sum(map(len, seen.values())) > FLUSH:
                yield rows()
                seen.clear()
        if seen:
            yield rows()

    return run


class Model:
    """P(character | longest context seen), Witten-Bell smoothed. n: counts of n-grams; after and
    kinds: followers of contexts, all and distinct."""

    def __init__(self, n: dict[str, int], after: dict[str, int], kinds: dict[str, int], order: int) -> None:
        self.n, self.after, self.kinds, self.order = n, after, kinds, order

    def log_likelihood(self, text: str) -> float:
        t, total = "\x02" + text + "\x03", 0.0
        n, after, kinds = self.n, self.after, self.kinds
        for i in range(1, len(t)):
            p = 1.0 / ALPHABET
            for k in range(min(self.order, i) + 1):
                if not (a := after.get(t[i - k : i])):
                    break
                w = kinds[t[i - k : i]]
                p = (n.get(t[i - k : i + 1], 0) + w * p) / (a + w)
            total += math.log(p)
        return total


FACTS = ("n", "after", "kinds")
BASE = ("page_id", "host", "path", "address", "rule", "by_rule", "held_out")


def facts(counts: DataFrame) -> DataFrame:
    """counts: label, gram, n. One row per string that is an n-gram or a context: for each label its
    count, the count of its followers and the number of distinct ones."""
    context = F.expr("substring(gram, 1, length(gram) - 1)")
    after = counts.groupBy("label", context.alias("s")).agg(F.sum("n").alias("after"), F.count("*").alias("kinds"))
    each = counts.select("label", F.col("gram").alias("s"), "n", F.lit(None).cast("long").alias("after"), F.lit(None).cast("long").alias("kinds"))
    each = each.unionByName(after.withColumn("n", F.lit(None).cast("long")))
    return each.groupBy("s").agg(*[F.sum(F.when(F.col("label") == v, F.col(f))).alias(f"{v}_{f}") for v in ("allow", "block") for f in FACTS])


def _score(order: int):
    def run(urls: pa.Table, known: pa.Table) -> pa.Table:
        names = known.column("s").to_pylist()

        def column(name: str) -> dict[str, int]:
            return {s: x for s, x in zip(names, known.column(name).to_pylist(), strict=True) if x}

        a, r = (Model(*[column(f"{v}_{f}") for f in FACTS], order) for v in ("allow", "block"))
        s = [(a.log_likelihood(u) - r.log_likelihood(u)) / (len(u) + 1) if u else 0.0 for u in urls.column("address").to_pylist()]
        return urls.select(list(BASE)).append_column("score", pa.array(s, pa.float64()))

    return run


def filter_urls(pages: DataFrame, rules: tuple = RULES, order: int = ORDER, chunk: int = CHUNK) -> DataFrame:
    """page_id, host, path, rule, verdict, score."""
    small_batches(pages.sparkSession)
    host, path = host_path(F.col("url"))
    address = F.when(F.instr(F.coalesce("url", F.lit("")), "://") > 0, F.substring("url", F.instr("url", "://") + F.lit(3), F.length("url"))).otherwise("")
    p = judge(pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"), address.alias("address")), rules)
    p = p.withColumn("held_out", F.col("by_rule").isNotNull() & (F.pmod(F.crc32("address"), F.lit(5)) == 0))
    p = materialize(p.select(*BASE, F.monotonically_increasing_id().alias("row")), "url_rows")
    p = p.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(-(-p.count() // chunk) or 1)))
    seen = p.filter(F.col("by_rule").isNotNull() & ~F.col("held_out")).select(F.col("by_rule").alias("label"), "address")
    counts = materialize(seen.mapInArrow(_count(order), "label string, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n")), "url_counts")
    need = p.select("chunk", "address").mapInArrow(_lookups(order), "chunk long, s string")
    known = need.join(facts(counts), "s")
    base = "page_id long, host string, path string, address string, rule string, by_rule string, held_out boolean"
    scored = materialize(p.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_score(order), f"{base}, score double"), "url_scores")
    least = threshold(scored) if counts.select("label").distinct().count() == 2 else -math.inf
    own = F.when(F.col("score") >= F.lit(least), "allow").otherwise("block") if least > -math.inf else F.lit("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("by_rule", own).alias("verdict"), "score")


def threshold(scored: DataFrame) -> float:
    """The score that best separates held-out accepted from rejected URLs; 0 when there are none."""
    b = F.least(F.greatest(F.floor((F.col("score") + SPAN) / (2 * SPAN) * BINS), F.lit(0)), F.lit(BINS - 1))
    rows = scored.filter("held_out").groupBy(b.alias("bin")).agg(F.sum(F.when(F.col("by_rule") == "allow", 1).otherwise(0)), F.count("*")).collect()  # at most BINS rows
    good, bad = Counter(), Counter()
    for k, a, n in rows:
        good[k], bad[k] = a, n - a
    total_g, total_b = sum(good.values()), sum(bad.values())
    if not total_g or not total_b:
        return 0.0
    at, most, g, b_ = [BINS // 2], -2.0, total_g, total_b
    for k in range(BINS + 1):
        j = g / total_g - b_ / total_b
        if j > most + 1e-12:
            most, at = j, [k]
        elif j > most - 1e-12:
            at.append(k)
        g, b_ = g - good[k], b_ - bad[k]
    mid = (at[0] + at[-1]) / 2  # the middle of the best thresholds
    return mid / BINS * 2 * SPAN - SPAN
