"""Mixing sources to target weights by the cube method.

Each source gets a target number of words (water-filling under a cap of ``MAX_REPEAT`` times its
size). A document's inclusion rate is target / source size: its whole part is taken outright, its
fraction is an inclusion probability. The flight phase of the cube method moves the fractions
through the null space of two constraints per source, words and documents, so both totals keep
their expected value until at most two documents are undecided; these are landed by choosing the
combination nearest the word target.

A source is flown in chunks of bounded size, spread by a hash of the document (id, size, text) and
of its number among rows equal in these: a source with a third of all rows is many tasks, and so are
rows without an id or with one id. Equal rows are counted before they are numbered. Each chunk leaves at most two undecided documents, which are flown
together at the next level, so the levels grow with the logarithm of the rows. Only (id, source,
size) rows are shuffled, never texts. All choices are seeded by the data, so reruns agree.

Defined results: null and blank texts have size 0 and are taken as 0 words; a null source is a
source of its own, ranked last; repeated rows are separate units; with no words at all, targets are
0. Rows whose id is null are units as well. Long texts count whole; an empty table gives an empty one.
Only doc_id, source and text are read, so other columns may have any name. Rows equal in id, source
and text are alike to the mix; which of them is taken more often is left open.
"""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, n_words, with_rank

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2.0
#: Documents flown together in one group.
CHUNK = 4096
SEED = "mix-1"
_EPS = 1e-9

UNIT = "uid long, source string, size long, body long, rate double, copies long, pi double, doc_key long"
#: Equal rows are numbered in runs of this many.
RUN = 65_536


def targets(units: DataFrame, share: float = SHARE, weights: tuple = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """source, source_size, n_docs, target. Sources are ranked by code point (null last) by a range
    sort; the water level is found from sums over the sources table, a few scalars a round."""
    s = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    s = with_rank(s, [F.col("source").asc_nulls_last()], "mix_sources")
    wt = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    s = s.withColumn("w", wt).withColumn("cap", max_repeat * F.col("source_size")).drop("rank")
    total = s.agg(F.sum("source_size")).first()[0] or 0
    budget, level = share * total, -1.0
    while True:
        above = F.lit(level) * F.col("w") >= F.col("cap")
        row = s.agg(F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("w")))).first()
        new = (budget - (row[0] or 0.0)) / row[1] if row[1] else level
        if new <= level or not row[1]:
            break
        level = new
    return s.withColumn("target", F.least(F.lit(max(level, 0.0)) * F.col("w"), F.col("cap"))).drop("w", "cap")


def _fly(rows: list[list], rng: random.Random) -> None:
    """Flight phase on rows of [size, pi], in place: at most two fractions are left."""
    live: list[list] = []
    for row in rows:
        if not _EPS < row[1] < 1 - _EPS:
            row[1] = float(row[1] >= 0.5)
            continue
        live.append(row)
        while len(live) == 3:
            a, b, c = (x[0] for x in live)
            u = (b - c, c - a, a - b)
            if not any(u):
                u = (1, -1, 0)
            up = down = float("inf")
            for x, v in zip(live, u, strict=True):
                if v > 0:
                    up, down = min(up, (1 - x[1]) / v), min(down, x[1] / v)
                elif v < 0:
                    up, down = min(up, x[1] / -v), min(down, (1 - x[1]) / -v)
            step = up if rng.random() * (up + down) < down else -down
            for x, v in zip(live, u, strict=True):
                x[1] += step * v
                if not _EPS < x[1] < 1 - _EPS:
                    x[1] = float(x[1] >= 0.5)
            live = [x for x in live if 0 < x[1] < 1]


def _land(rows: list[list]) -> None:
    """Decide the last fractions: the combination whose words come nearest to what is expected."""
    live = [x for x in rows if _EPS < x[1] < 1 - _EPS]
    want, n = sum(x[0] * x[1] for x in live), sum(x[1] for x in live)
    best = min(range(1 << len(live)), key=lambda m: (abs(want - sum(x[0] for i, x in enumerate(live) if m >> i & 1)), abs(n - m.bit_count()), m))
    for i, x in enumerate(live):
        x[1] = float(best >> i & 1)


def _flight(last: bool):
    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_key", "uid", "size"], kind="stable", na_position="last").reset_index(drop=True)
        rows = [[int(s), float(p)] for s, p in zip(g["size"], g["pi"], strict=True)]
        _fly(rows, random.Random(f"{SEED}|{key[0]}|{key[1]}|{key[2]}"))
        if last:
            _land(rows)
        g["pi"] = [x[1] for x in rows]
        return g[["uid", "source", "size", "body", "rate", "copies", "pi", "doc_key"]]

    return run


def decide(units: DataFrame, t: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """units: uid, source, size, body (a hash of the text) and number among equal ones. Returns uid,
    source, size, body and copies (how often the mix takes each)."""
    u = units.alias("u").join(t.alias("t"), F.col("u.source").eqNullSafe(F.col("t.source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = u.select("uid", F.col("u.source").alias("source"), "size", "body", "number", rate.alias("rate"), "n_docs")
    whole = F.floor(F.col("rate") + 1e-12)
    u = u.withColumn("copies", whole.cast("long")).withColumn("pi", F.greatest(F.lit(0.0), F.col("rate") - whole))
    u = u.withColumn("doc_key", F.xxhash64(F.lit(SEED), "uid", "size", "body", "number")).drop("number")
    live, done, level, most = u, [], 0, t.agg(F.max("n_docs")).first()[0] or 0
    while True:
        last = most <= chunk
        n = F.ceil(F.col("n_docs") / chunk).cast("long")
        keyed = live.withColumn("chunk", F.pmod(F.xxhash64("doc_key", F.lit(level)), n)).withColumn("level", F.lit(level))
        flown = keyed.drop("n_docs").groupBy("source", "chunk", "level").applyInPandas(_flight(last), UNIT)
        flown = materialize(flown, f"mix_level{level}")
        done.append(flown.filter((F.col("pi") == 0) | (F.col("pi") == 1)))
        if last:
            break
        rest = flown.filter((F.col("pi") > 0) & (F.col("pi") < 1))
        counts = rest.groupBy("source").agg(F.count("*").alias("n_docs"))
        live = rest.alias("r").join(counts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source"))).select("r.*", "n_docs")
        most, level = counts.agg(F.max("n_docs")).first()[0] or 0, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select("uid", "source", "size", "body", (F.col("copies") + F.col("pi").cast("long")).alias("copies"))


def measure(docs: DataFrame) -> DataFrame:
    """uid, source, size, body and number, one row per document. Equal documents are counted first and
    numbered by run, so the numbers don't depend on where rows lie and no task gathers a group."""
    u = docs.select(F.col("doc_id").cast("long").alias("uid"), "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("body"))
    u = u.groupBy("uid", "source", "size", "body").agg(F.count("*").alias("equal"))
    u = u.withColumn("run", F.explode(F.expr(f"sequence(0L, (equal - 1) div {RUN})")))
    u = u.withColumn("number", F.explode(F.expr(f"sequence(run * {RUN}, least(equal, (run + 1) * {RUN}) - 1)")))
    return materialize(u.select("uid", "source", "size", "body", "number"), "mix_units")


def mixing_query(docs: DataFrame) -> DataFrame:
    u = measure(docs)
    t = targets(u)
    d = decide(u, t).alias("d").join(t.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    return d.select(F.col("uid").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.col("d.source").alias("source"), "copies")


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with all their columns. Of rows equal
    in id, source and text, as many get each number of copies as were decided for them: only such
    rows are numbered, and what is kept of a group is a count for each number of copies."""
    u = measure(docs)
    key = ["uid", "source", "body"]
    by = decide(u, targets(u)).groupBy(*key, "copies").agg(F.count("*").alias("times"))
    d = by.groupBy(*key).agg(F.sum("times").alias("_times"), F.sort_array(F.collect_list(F.struct("copies", "times")), asc=False).alias("_copies"))
    d = d.select("_times", "_copies", *[F.col(k).alias(f"_{k}") for k in key])
    j = docs.withColumn("_hash", F.xxhash64("text"))
    j = j.join(d, F.col("doc_id").cast("long").eqNullSafe(F.col("_uid")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_hash") == F.col("_body")))
    one = j.filter("_times = 1").withColumn("_k", F.expr("_copies[0].copies"))
    many = j.filter("_times > 1").withColumn("_rn", F.row_number().over(Window.partitionBy("_uid", "_source", "_body").orderBy("_body")))
    # copies in descending order: a row takes those of the first entry whose running count reaches its number
    upto = "aggregate(_copies, struct(0L as n, cast(null as bigint) as k), (a, x) -> struct(a.n + x.times as n, coalesce(a.k, if(a.n + x.times >= _rn, x.copies, null)) as k), a -> a.k)"
    many = many.withColumn("_k", F.expr(upto)).drop("_rn")
    out = one.unionByName(many).filter("_k > 0")
    return out.withColumn("_i", F.explode(F.expr("sequence(1L, _k)"))).select(*[F.col(f"`{c}`") for c in docs.columns])
