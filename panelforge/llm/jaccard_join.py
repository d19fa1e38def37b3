"""Jaccard self-join of documents on word n-grams by vertical partitioning.

The global order of n-grams is that of their 64-bit hashes, cut into fragments. Overlaps are counted
fragment by fragment and summed per document or pair.

1. Documents with the same word sequence form a class; only its smallest id goes on.
2. Each class sends the beginning of its set in the global order to the fragments: the part that no
   partner can miss (n - ceil(percent * n) + 1 n-grams) and ``EXTRA`` % more. Two linked sets share
   at least 1 + EXTRA % of the smaller one's size there, so a fragment counts per class how many of
   its n-grams another class holds, and classes whose counts sum to less have no link and go. An
   n-gram frequent within a map task is passed on under a salted key and leaves one mark in its
   fragment, so no group grows with a hot n-gram.
3. The whole sets of the classes that are left are gathered. N-grams of one class go, then classes
   with fewer shared n-grams than any link needs, twice, for n-grams cease to be shared. A passage
   common to many otherwise different documents ends here.
4. Candidates share an n-gram of their prefixes (rarest first). All pairs of a bucket are never
   listed: first each member is compared with one pivot, the member with the largest share of n-grams
   that others hold (copies descend from it); then with random pivots, across components only; at
   last every pair of a bucket that lies in different components still, where one side is outside
   of the bucket's largest component. A link missed before is found there: the components are exact.
5. A candidate's sets are cut into ``PARTS`` segments, one a fragment, joined by fragment; a partial
   overlap is counted in each, and their sum decides.

Defined results: null, empty and blank texts have an empty set, link with nothing and are their own
component; an empty table gives an empty one. Whole texts count, however long. Repeated rows are
copies. Rows that share an id but not their text count as one node whose links are those of any of
them. Rows with a null id link with nothing and have a null component unless a copy has an id. Of
equal pivots the one of the smaller key is taken, which changes the work only. Only doc_id and text
are read, so other columns may have any name. Equality of n-grams is that of their 64-bit hashes: two
sets of sizes a and b count a different n-gram as common with a probability below a * b / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, small_batches
from .components import components

SHINGLE = 5
PERCENT = 80
#: Percent of a set that is sent to the fragments beyond what a prefix filter needs.
EXTRA = 10
#: n-grams that a fragment's task holds, about, and the least number of fragments (as a power of 2).
FRAGMENT_TOKENS = 2_000_000
LEAST_BITS = 6
#: n-grams that a map task gathers before it sends them on.
FLUSH_TOKENS = 3_000_000
SALTS = 64
#: A candidate's n-grams lie in this many segments when pairs are compared.
PARTS_BITS = 2
#: Rounds with random pivots; only the work of the last, exact step depends on them.
ROUNDS = 1

_M1, _M2, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def word_list(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at the six separators: what bytes' own methods do."""
    return text.lower().split() if text else []


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams; a shorter sequence is one n-gram."""
    import xxhash

    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=n)
    k = min(size, n)
    with np.errstate(over="ignore"):
        acc = np.full(n - k + 1, k, dtype=np.uint64)
        for j in range(k):
            acc = _mix(acc * _P + h[j : n - k + 1 + j])
    return np.unique(acc)


def _planes(x: np.ndarray) -> bytes:
    """Bytes by place: the high ones are mostly zero and the shuffle's compression removes them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _deltas(x: np.ndarray, kind: str) -> bytes:
    d = x.copy()
    d[1:] = x[1:] - x[:-1]
    return _planes(d.astype(kind))


def _undeltas(b: bytes, kind: str) -> np.ndarray:
    return np.cumsum(_unplanes(b, kind), dtype=kind)


def need(n: int, percent: int) -> int:
    """The least intersection of a link of a set of n."""
    return -(-n * percent // 100)


def sent(n: int, percent: int, extra: int = EXTRA) -> int:
    """How many of a set's first n-grams go to the fragments."""
    return min(n, n - need(n, percent) + 1 + n * extra // 100)


def _sql_need(n: str, percent: int) -> str:
    return f"(({n} * {percent} + 99) div 100)"


PROFILE = "doc_id long, fp binary, node long, n long, k long, first binary"


def _profiles(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            rows: list[tuple] = []
            for t in b.column(1):
                w = word_list(t.as_py())
                if not w:
                    rows.append((None, None, 0, 0, None))
                    continue
                fp, s = xxhash.xxh3_128_digest(b" ".join(w)), shingle_hashes(w, size)
                k = sent(len(s), percent)
                rows.append((fp, int.from_bytes(fp[:8], "little", signed=True), len(s), k, s[:k].tobytes()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], names=["doc_id", "fp", "node", "n", "k", "first"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def profiles(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id; fp and node, 128 and 64 bits of the word sequence; n, the set's size; the first k of it."""
    small_batches(docs.sparkSession)
    return materialize(_texts(docs).mapInArrow(_profiles(shingle, percent), PROFILE), "jac_profiles")


BLOBS = "frag int, salt int, nodes binary, toks binary, at binary"


def _send(bits: int, most: int):
    """The n-grams of (node, first) rows, packed by fragment. A node counts once a flush."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS + 1
        held: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            nodes = np.asarray(sorted(held), dtype=np.int64)
            sets = [held[i] for i in nodes.tolist()]
            tok = np.concatenate(sets)
            at = np.repeat(np.arange(len(nodes), dtype=np.int64), [len(x) for x in sets])
            held, size = {}, 0
            o = np.argsort(tok, kind="stable")
            tok, at = tok[o], at[o]
            first = np.ones(len(tok), dtype=bool)
            first[1:] = tok[1:] != tok[:-1]
            single = first.copy()
            single[:-1] &= first[1:]
            rows: list[tuple] = []
            # alone in this flush: to its fragment; else passed on, with one mark (-1)
            for salted, mask, where in ((0, first, np.where(single, at, -1)), (salt, ~single, at)):
                t, a = tok[mask], where[mask]
                cut = np.searchsorted(t, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                cut = [0, *cut.tolist(), len(t)]
                for f, (x, y) in enumerate(zip(cut, cut[1:], strict=False)):
                    if x < y:
                        # only the nodes that the fragment sees; a mark is one past the last
                        who, mine = np.unique(a[x:y], return_inverse=True)
                        marks = int(who[0] < 0)
                        mine = np.where(mine < marks, len(who) - marks, mine - marks)
                        rows.append((f, salted, _deltas(nodes[who[marks:]], "<i8"), _deltas(t[x:y], "<u8"), _planes(mine.astype("<u4"))))
            for i in range(0, len(rows), 16):
                some = list(zip(*rows[i : i + 16], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int32()), pa.array(some[1], pa.int32()), *[pa.array(c, pa.binary()) for c in some[2:]]], names=["frag", "salt", "nodes", "toks", "at"])

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if d not in held:
                    held[d] = np.frombuffer(t.as_py(), dtype="<u8")
                    size += len(held[d])
                if size >= most:
                    yield from flush()
        if size:
            yield from flush()

    return run


def _shared(t: pa.Table) -> pa.Table:
    """One fragment: how many of each node's n-grams another node holds."""
    tok, node, mark = [], [], []
    for d, k, a in zip(t.column("nodes"), t.column("toks"), t.column("at"), strict=True):
        ids, at = _undeltas(d.as_py(), "<i8"), _unplanes(a.as_py(), "<u4")
        tok.append(_undeltas(k.as_py(), "<u8"))
        mark.append(at == len(ids))
        node.append(np.append(ids, 0)[at])
    tok, node, mark = map(np.concatenate, (tok, node, mark))
    o = np.lexsort((node, mark, tok))
    tok, node, mark = tok[o], node[o], mark[o]
    new = np.ones(len(tok), dtype=bool)
    new[1:] = tok[1:] != tok[:-1]
    group = np.cumsum(new) - 1
    one = new | np.r_[True, node[1:] != node[:-1]]  # copies met in other flushes count once
    one &= ~mark
    many = (np.bincount(group, one) > 1) | (np.bincount(group, mark) > 0)
    if t.column("salt")[0].as_py():
        many[:] = True
    who, n = np.unique(node[one & many[group]], return_counts=True)
    return pa.table([pa.array(who, pa.int64()), pa.array(n, pa.int64())], names=["node", "m"])


def _alive(prof: DataFrame, reps: DataFrame, percent: int, flush: int = FLUSH_TOKENS) -> DataFrame:
    """r, fp, d, n of the classes that share enough of their first n-grams."""
    total = prof.agg(F.sum("k")).first()[0] or 0
    bits = max(LEAST_BITS, (total // FRAGMENT_TOKENS).bit_length())
    parts = prof.filter("fp is not null").select("node", "first").mapInArrow(_send(bits, flush), BLOBS)
    m = parts.groupBy("frag", "salt").applyInArrow(_shared, "node long, m long").groupBy("node").agg(F.sum("m").alias("m"))
    enough = f"m >= 1 + {_sql_need('n', percent)} * {EXTRA} div 100"
    return materialize(reps.filter("d is not null").join(m, "node").filter(enough).select("r", "fp", "d", "n"), "jac_alive")


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            fp, toks = [], []
            for t in b.column(1):
                w = word_list(t.as_py())
                if w:
                    fp.append(xxhash.xxh3_128_digest(b" ".join(w)))
                    toks.append(shingle_hashes(w, size).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(fp, pa.binary()), pa.array(toks, pa.list_(pa.int64()))], names=["fp", "toks"])

    return run


def _rows(docs: DataFrame, alive: DataFrame, shingle: int) -> DataFrame:
    """r, n, tok: the whole sets of the classes left. A class's texts are those of its smallest id."""
    texts = _texts(docs).join(alive.select(F.col("d").alias("doc_id")), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(shingle), "fp binary, toks array<long>").groupBy("fp").agg(F.first("toks").alias("toks"))
    return alive.join(sets, "fp").select("r", "n", F.explode("toks").alias("tok"))


def _prune(rows: DataFrame, percent: int) -> DataFrame:
    """rows: r, n, tok. Keep n-grams of two or more classes, then classes with enough of them; adds
    df and m, the class's n-grams left."""
    df = rows.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1")
    x = rows.join(df, "tok")
    m = x.groupBy("r").agg(F.count("*").alias("m"), F.first("n").alias("n")).filter(f"m >= {_sql_need('n', percent)}").drop("n")
    return x.join(m, "r")


def _pair(df: DataFrame) -> DataFrame:
    """df: r, n and s, ns. a < b, na, nb: distinct pairs."""
    first = F.col("r") < F.col("s")
    cols = [F.least("r", "s").alias("a"), F.greatest("r", "s").alias("b")]
    cols += [F.when(first, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("n", "ns", "na"), ("ns", "n", "nb"))]
    return df.select(*cols).distinct()


def _with_pivot(prefix: DataFrame, order: F.Column, percent: int, apart: bool = False) -> DataFrame:
    """Each member of a bucket with the bucket's pivot, the one that is largest by order, where sizes
    fit. apart: only across components (c)."""
    best = prefix.groupBy("tok").agg(F.max(F.struct(order.alias("o"), (-F.col("r")).alias("k"), "r", "n", *(["c"] if apart else []))).alias("p"), F.count("*").alias("size")).filter("size > 1")
    p = prefix.join(best, "tok").filter(f"r <> p.r and 100 * least(n, p.n) >= {percent} * greatest(n, p.n)")
    if apart:
        p = p.filter("c <> p.c")
    return _pair(p.select("r", "n", F.col("p.r").alias("s"), F.col("p.n").alias("ns")))


def _across(prefix: DataFrame, percent: int) -> DataFrame:
    """Every pair of a bucket in different components (c) that its sizes and places in the prefixes
    don't rule out. The members of the bucket's largest component are met by the others only."""
    by = prefix.groupBy("tok", "c").agg(F.count("*").alias("size"))
    hub = by.groupBy("tok").agg(F.max(F.struct("size", "c")).alias("h"), F.count("*").alias("kinds")).filter("kinds > 1").select("tok", F.col("h.c").alias("hub"))
    p = materialize(prefix.join(hub, "tok"), "jac_open")
    x, y = (p.select("tok", "hub", *[F.col(c).alias(c + s) for c in ("r", "n", "m", "pos", "c")]) for s in "xy")
    least = f"((nx + ny) * {percent} + {99 + percent}) div {100 + percent}"
    j = x.filter("cx <> hub").drop("hub").join(y, "tok").filter("cx <> cy and (cy = hub or rx < ry)")
    j = j.filter(f"100 * least(nx, ny) >= {percent} * greatest(nx, ny) and 1 + least(mx - posx, my - posy) >= {least}")
    return _pair(j.select(F.col("rx").alias("r"), F.col("nx").alias("n"), F.col("ry").alias("s"), F.col("ny").alias("ns")))


def _linked(pairs: DataFrame, segs: DataFrame, percent: int) -> DataFrame:
    """pairs: a, b, na, nb. Those whose partial overlaps, counted fragment by fragment, sum to a link."""
    sa = segs.select(F.col("r").alias("a"), "frag", F.col("toks").alias("ta"))
    sb = segs.select(F.col("r").alias("b"), "frag", F.col("toks").alias("tb"))
    part = pairs.join(sa, "a").join(sb, ["b", "frag"]).withColumn("part", F.size(F.array_intersect("ta", "tb")))
    both = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("both"))
    return both.filter(f"100 * both >= {percent} * (na + nb - both)").select("a", "b")


def _merge(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Components joined by links between their members: r, c."""
    la, lb = label.select(F.col("r").alias("a"), F.col("c").alias("ca")), label.select(F.col("r").alias("b"), F.col("c").alias("cb"))
    e = links.join(la, "a").join(lb, "b").filter("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    new = components(e, name)
    out = label.join(new, label.c == new.node, "left").select("r", F.coalesce("component", "c").alias("c"))
    done = materialize(out, f"{name}_labels")
    forget(new)
    forget(label)
    return done


def _one_node(out: DataFrame) -> DataFrame:
    """Components joined where rows share an id but not their component."""
    shared = out.filter("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("lo"), F.max("component_id").alias("hi")).filter("lo < hi").select("doc_id")
    if not shared.head(1):
        return out
    links = out.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    new = components(links, "jac_ids")
    return out.join(new, out.component_id == new.node, "left").select("doc_id", "n_shingles", F.coalesce("component", "component_id").alias("component_id"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, flush: int = FLUSH_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links. flush: n-grams that a
    map task gathers at a time."""
    prof = profiles(docs, shingle, percent)
    reps = prof.filter("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("d"), F.max("n").alias("n"), F.first("node").alias("node"))
    reps = materialize(reps.withColumn("r", F.monotonically_increasing_id()), "jac_reps")
    alive = _alive(prof, reps, percent, flush)
    r1 = materialize(_prune(_rows(docs, alive, shingle), percent), "jac_prune")
    sets = _prune(r1.select("r", "n", "tok"), percent)
    sets = sets.groupBy("r", "n", "m", F.shiftrightunsigned("tok", 64 - PARTS_BITS).alias("frag")).agg(F.collect_list(F.struct("df", "tok")).alias("toks"))
    sets = materialize(sets, "jac_sets")
    forget(r1)
    forget(alive)
    segs = sets.select("r", "frag", F.col("toks.tok").alias("toks"))
    rows = sets.select("r", "n", "m", F.explode("toks").alias("t")).select("r", "n", "m", "t.df", "t.tok")
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("r").orderBy("df", "tok")))  # a document's own n-grams
    prefix = materialize(rows.filter(f"pos <= m - {_sql_need('n', percent)} + 1").select("tok", "r", "n", "m", "pos"), "jac_prefix")

    label = materialize(sets.select("r", F.col("r").alias("c")).distinct(), "jac_labels")
    near = _with_pivot(prefix, F.col("m") / F.col("n"), percent)
    label = _merge(label, _linked(near, segs, percent), "jac_pivot")
    for i in range(ROUNDS):
        near = _with_pivot(prefix.join(label, "r"), F.xxhash64("r", "tok", F.lit(i)), percent, apart=True)
        label = _merge(label, _linked(near, segs, percent), f"jac_round{i}")
    label = _merge(label, _linked(_across(prefix.join(label, "r"), percent), segs, percent), "jac_last")
    for spent in (sets, prefix):
        forget(spent)

    low = label.join(reps.select("r", "d"), "r").groupBy("c").agg(F.min("d").alias("low"))
    named = reps.join(label, "r", "left").join(low, "c", "left").select(F.col("fp").alias("_fp"), F.coalesce("low", "d").alias("component_id"))
    out = prof.drop("first").join(named, F.col("fp") == F.col("_fp"), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = materialize(out, "jac_out")
    for spent in (prof, reps, label):
        forget(spent)
    return _one_node(out)


ORACLE = f"""
with recursive d as (
  select row_number() over () as rid, doc_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
sh as (
  select distinct rid, doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as s
  from (select rid, doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) as i from d where len(w) > 0)),
n as (select rid, doc_id, count(*) as n from sh group by all),
df as (select s from sh group by s having count(*) > 1),
sh2 as (select sh.* from sh join df using (s)),
ov as (select a.doc_id as x, b.doc_id as y, count(*) as o from sh2 a join sh2 b on a.s = b.s and a.doc_id < b.doc_id group by all),
lk as (
  select x, y from ov join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  where 100 * o >= {PERCENT} * (nx.n + ny.n - o)),
e as (select x, y from lk union all select y, x from lk),
reach(x, y) as (select distinct x, x from e union select r.x, e.y from reach r join e on e.x = r.y),
c as (select x, min(y) as c from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.c, d.doc_id) as component_id
from d left join n on n.rid = d.rid left join c on c.x = d.doc_id
"""
