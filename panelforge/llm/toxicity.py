"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

Lexicon and pattern voters look at every text once and leave a bit each. Beside the fixed lexicons
stands a mined one: stems and words that at most ``MAX_MINED`` labelled documents (remainders 1 to
3; copies count once: texts whose sets of 5-word shingles have a Jaccard similarity of ``COPY`` or
more, looked for by min-hashes) show far more often in toxic texts than in others. Over all documents the
patterns of votes are counted (at most 2**voters rows). On the counts a two-class generative model
is fitted by expectation maximisation, begun at the rates seen on labelled rows: each voter's rate of firing on toxic and on clean documents,
that is its accuracy, and the correlations of the voters within the classes, which take weight from
voters that repeat each other. The posteriors label a bounded sample (``MAX_SAMPLE`` documents by
the smallest hash of their id), on which a logistic regression over words of the lexicons, voters
and densities is trained. Its log-odds are calibrated by two numbers on at most ``MAX_TRAIN``
labelled rows (remainder 4) that the mining did not see. Held-out labels enter nowhere.

Defined results: null and empty texts get no votes for toxic and are scored like any other.
Repeated rows are scored one by one. Without labels the classifier's own probability is returned.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches
from .quality_rff import held_out, labelled

MAX_SAMPLE = 20_000
MAX_TRAIN = 50_000
CUT = 0.5
MAX_MINED = 10_000
#: A mined stem is this many times as frequent in toxic documents as in others, and so unlikely by
#: chance (a Chernoff bound's negative logarithm); at most MAX_STEMS are kept, the most frequent.
MIN_RATIO, MIN_EVIDENCE, MAX_STEMS = 4.0, 16.0, 600
STEM_LENGTHS = (4, 5, 6, 7)
#: Copies among the labelled texts: words in a shingle, least similarity, min-hashes that look for them.
SHINGLE, COPY, MIN_HASHES = 5, 0.8, 8

#: Lexicon voters: words of one kind each.
LEXICONS: dict[str, str] = {
    "stupidity": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile cretin dimwit halfwit simpleton brainless dunce nitwit",
    "worth": "worthless pathetic loser losers useless nobody failure coward cowardly wretch miserable",
    "filth": "trash garbage scum filth filthy vermin vile disgusting disgrace repulsive revolting rotten maggot parasite swine",
    "ridicule": "clown clowns buffoon joker laughable ridiculous freak weirdo jackass donkey",
    "profanity": "shit shitty fuck fucking fucker bastard bitch asshole damn crap piss slut whore",
    "french": "idiote imbécile crétin connard connasse salaud salope ordure débile abruti minable pourriture dégoûtant stupide",
    "german": "idiot idioten dummkopf trottel arschloch schwachkopf abschaum widerlich dumm blöd versager mistkerl drecksau wertlos erbärmlich",
    "spanish": "idiota imbécil estúpido estúpida tonto cretino basura asqueroso asquerosa inútil patético patética perdedor escoria payaso cabrón",
}
WORDS = sorted({w for x in LEXICONS.values() for w in x.split()})
INDEX = {w: i for i, w in enumerate(WORDS)}
OF = {w: [k for k, x in enumerate(LEXICONS.values()) if w in x.split()] for w in WORDS}
#: Words that also have everyday uses: alone they are weak evidence.
MILD = frozenset("joker donkey nobody failure damn miserable freak dumm basura ordure tonto rotten useless".split())
PATTERNS = ("strong_word", "two_words", "three_words", "dense", "aimed", "shouted", "disguised")
VOTERS = [*LEXICONS, "mined", *PATTERNS]
_WORD = re.compile(r"[^\W\d_]+")
_AIMED = re.compile(r"\b(?:you|your|you're|he|she|they|this|that|these|tu|vous|du|ihr|sie|eres|usted)\s+(?:\w+\s+){0,2}?(" + "|".join(w for w in WORDS if w not in MILD) + r")\b")
_DISGUISED = re.compile(r"\b(?:[i1!]d[i1!][o0]t|m[o0]r[o0]n|st[u*]p[i1!*]d|l[o0*]s[e3]r|sh[i1!*]t|f[u*][c*]k|b[i1!*]tch|tr[a4@]sh|[a@]ssh[o0]le|scu[m*])\b")
_PLAIN = frozenset("idiot moron stupid loser shit fuck bitch trash asshole scum".split())
N_FEATURES = len(WORDS) + len(VOTERS) + 2


def stems(words: set[str]) -> set[str]:
    """Whole words (=), their beginnings (1), and beginnings that two of the words share (2)."""
    n = Counter(w[:k] for w in words if len(w) > 3 for k in STEM_LENGTHS if len(w) >= k)
    return {f"={w}" for w in words} | {f"1{p}" for p in n} | {f"2{p}" for p, k in n.items() if k > 1}


def matched(words: set[str], extra: frozenset[str], starts: frozenset[str]) -> set[str]:
    """The words that mined stems point to. starts: the first four letters of each stem's word."""
    some = [w for w in words if w[:4] in starts]
    if not some:
        return set()
    n = Counter(w[:k] for w in some if len(w) > 3 for k in STEM_LENGTHS if len(w) >= k)
    return {w for w in some if "=" + w in extra or any("1" + w[:k] in extra or (n[w[:k]] > 1 and "2" + w[:k] in extra) for k in STEM_LENGTHS)}


def shingles(words: list[str]) -> np.ndarray:
    """Distinct 64-bit hashes of a text's 5-word shingles; a shorter text is one shingle."""
    h = np.array([zlib.crc32(w) << 32 | zlib.crc32(w, 77) for w in map(str.encode, words)], dtype=np.uint64)
    k = min(SHINGLE, len(h))
    out = np.full(len(h) - k + 1 if k else 0, k, dtype=np.uint64)
    for i in range(k):
        out = _scramble(out ^ h[i : len(h) - k + 1 + i])
    return np.unique(out)


def _scramble(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that mixes their bits (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        least, parts, found = [], [], []
        for t in b.column(2):
            words = _WORD.findall((t.as_py() or "").lower())
            x = shingles(words)
            parts.append(x.view(np.int64))
            least.append([int(_scramble(x ^ np.uint64(i)).min().view(np.int64)) for i in range(MIN_HASHES)] if len(x) else [])
            found.append(sorted(stems(set(words))))
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(least, longs), pa.array(parts, longs), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "y", "least", "parts", "stems"])


def originals(t: DataFrame) -> DataFrame:
    """t: row, doc_id, y, least, parts. Without the rows that are copies of one before them: each
    row is compared with the first row of its label that shares a min-hash, for every min-hash."""
    each = t.select("row", "doc_id", "y", F.posexplode("least").alias("i", "h"))
    first = each.groupBy("y", "i", "h").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    pairs = each.join(first, ["y", "i", "h"]).filter("row <> first.row").select("row", F.col("first.row").alias("of")).distinct()
    both = pairs.join(t.select("row", "parts"), "row").join(t.select(F.col("row").alias("of"), F.col("parts").alias("others")), "of")
    shared = F.size(F.array_intersect("parts", "others"))
    copies = both.filter(shared >= F.lit(COPY) * (F.size("parts") + F.size("others") - shared)).select("row").distinct()
    return t.join(copies, "row", "left_anti")


def mined(docs: DataFrame, known: DataFrame) -> list[str]:
    """docs: doc_id, text; known: at most MAX_MINED rows of doc_id, y."""
    t = docs.join(F.broadcast(known), "doc_id").select("doc_id", "y", "text")
    t = t.mapInArrow(_mine, "doc_id long, y int, least array<long>, parts array<long>, stems array<string>").filter("size(parts) > 0")
    t = materialize(t.withColumn("row", F.monotonically_increasing_id()), "tox_labelled")
    t = materialize(originals(t).select("y", "stems"), "tox_mined")
    sizes = {r[0]: r[1] for r in t.groupBy("y").count().collect()}  # two rows
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return []
    n = t.select("y", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    return [r[0] for r in n.filter(telling(toxic, clean)).orderBy(F.col("a").desc(), "stem").limit(MAX_STEMS).collect()]


def telling(toxic: int, clean: int) -> str:
    """SQL over a and b, the toxic and other documents with a stem."""
    p = toxic / (toxic + clean)
    q = "((a + 0.0) / (a + b))"
    chance = f"(a * ln({q} / {p!r}) + case when b > 0 then b * ln((1 - {q}) / {1 - p!r}) else 0 end)"
    return f"a > 3 and {q} > {p!r} and (a / {float(toxic)!r}) >= {MIN_RATIO} * ((b + 0.5) / {float(clean)!r}) and {chance} >= {MIN_EVIDENCE}"


def votes(text: str | None, extra: frozenset[str] = frozenset(), starts: frozenset[str] = frozenset()) -> tuple[int, list[int], float, float]:
    """The voters' bits, the lexicon words found, their density and their number's logarithm.
    extra: mined stems; starts: their first four letters."""
    low = (text or "").lower()
    words = _WORD.findall(low)
    kinds_of = set(words)
    fixed = kinds_of & INDEX.keys()
    more = matched(kinds_of, extra, starts) - fixed if extra else set()
    bits = 0
    for w in fixed:
        for k in OF[w]:
            bits |= 1 << k
    bits |= int(bool(more)) << len(LEXICONS)
    strong = {w for w in fixed if w not in MILD} | more
    dense = sum(map(words.count, strong)) / max(20, len(words))
    plain = strong - more
    flags = [bool(strong), len(strong) >= 2, len(strong) >= 3, bool(strong) and dense >= 0.01, bool(plain) and bool(_AIMED.search(low)), False, False]
    if plain:
        flags[5] = any(w.upper() in text for w in plain)
    if found := _DISGUISED.findall(low):
        flags[6] = any(x not in _PLAIN for x in found)
    for i, f in enumerate(flags):
        bits |= int(f) << (len(LEXICONS) + 1 + i)
    return bits, sorted(INDEX[w] for w in fixed), dense, float(np.log1p(len(strong)))


def _vote(extra: frozenset[str]):
    starts = frozenset(x[1:5] for x in extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = [votes(t.as_py(), extra, starts) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in v], pa.int32()), pa.array([x[1] for x in v], pa.list_(pa.int32())), pa.array([x[2] for x in v], pa.float32()), pa.array([x[3] for x in v], pa.float32())],
                names=["doc_id", "bits", "hits", "dense", "many"],
            )

    return run


def unpack(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(VOTERS)) & 1).astype(float)


class LabelModel:
    """Two classes, a rate of firing of each voter in each class, weights against repetition. The
    share of the classes is given; start: rates to begin with."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float = 0.1, start: np.ndarray | None = None, rounds: int = 200) -> None:
        v, n = unpack(patterns), counts.astype(float)
        m = v.shape[1]
        self.weight = np.ones(m)
        self.prior = float(np.clip(prior, 0.01, 0.5))
        self.rate = np.vstack([np.full(m, 0.02), np.full(m, 0.4)]) if start is None else start  # voters fire on toxic texts
        for i in range(rounds):
            q = self._posterior(v)
            on, off = (n * q), (n * (1 - q))
            rate = np.vstack([(off @ v + 0.02) / (off.sum() + 1), (on @ v + 0.4) / (on.sum() + 1)])
            if i and np.abs(rate - self.rate).max() < 1e-7:
                break
            self.rate = rate
            if i % 10 == 9 or i == 4:
                self.correlation = self._correlations(v, n, self._posterior(v))
                self.weight = np.maximum(0.25, 1 / (1 + (np.abs(self.correlation) * (np.abs(self.correlation) > 0.2)).sum(1)))

    def _correlations(self, v: np.ndarray, n: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Within the classes: what the voters share beyond the label."""
        total, out = n.sum(), np.zeros((v.shape[1],) * 2)
        for w, rate in ((n * (1 - q), self.rate[0]), (n * q, self.rate[1])):
            x = v - rate
            out += (x * w[:, None]).T @ x
        out /= total
        s = np.sqrt(np.maximum(np.diag(out), 1e-9))
        out = out / s[:, None] / s[None, :]
        np.fill_diagonal(out, 0)
        return np.clip(out, -1, 1)

    def _posterior(self, v: np.ndarray) -> np.ndarray:
        r = np.clip(self.rate, 1e-6, 1 - 1e-6)
        on = v @ (self.weight * np.log(r[1] / r[0])) + (1 - v) @ (self.weight * np.log((1 - r[1]) / (1 - r[0])))
        return 1 / (1 + np.exp(-np.clip(on + np.log(self.prior / (1 - self.prior)), -30, 30)))

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        return self._posterior(unpack(patterns))


def first_rates(known: DataFrame) -> tuple[float, np.ndarray | None]:
    """Share of toxic documents and the voters' rates in both classes, from labelled rows."""
    rows = known.groupBy("y", "bits").agg(F.count("*")).collect()  # at most 2 * 2**voters rows
    total = [sum(r[2] for r in rows if r[0] == y) for y in (0, 1)]
    if not all(total):
        return 0.1, None
    out = np.zeros((2, len(VOTERS)))
    for y, b, n in rows:
        out[y] += n * unpack(np.asarray([b]))[0]
    return total[1] / sum(total), np.vstack([(out[0] + 0.02) / (total[0] + 1), (out[1] + 0.4) / (total[1] + 1)])


def design(bits: np.ndarray, hits: list, dense: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = np.zeros((len(bits), N_FEATURES))
    for i, h in enumerate(hits):
        x[i, list(h)] = 1
    x[:, len(WORDS) : len(WORDS) + len(VOTERS)] = unpack(bits)
    x[:, -2], x[:, -1] = np.minimum(dense * 50, 2), many
    return x


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Newton's method for soft labels; the last weight is the constant."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, ridge), 1e-6]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def toxicity_scores(docs: DataFrame, labels: DataFrame, column: str = "toxic", cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, bits int, hits array<int>, dense float, many float"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = materialize(labelled(labels, column, MAX_TRAIN), "tox_labels")
    mine = known.filter("part <= 3").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_MINED).select("doc_id", "y")
    v = materialize(d.mapInArrow(_vote(frozenset(mined(d, mine))), schema), "tox_votes")
    counts = v.groupBy("bits").agg(F.count("*").alias("n")).orderBy("bits").collect()  # at most 2**voters rows
    bits, n = (np.asarray(c, dtype=np.int64) for c in zip(*counts, strict=True)) if counts else (np.zeros(1, np.int64), np.ones(1, np.int64))
    share, start = first_rates(v.join(F.broadcast(known.filter("part <= 3")), "doc_id"))
    model = LabelModel(bits, n, share, start)
    sample = v.orderBy(F.xxhash64("doc_id", F.lit("tox")), "doc_id").limit(MAX_SAMPLE).toPandas()  # the documented bound
    if len(sample):
        b = sample["bits"].to_numpy(np.int64)
        w = logistic(design(b, list(sample["hits"]), sample["dense"].to_numpy(), sample["many"].to_numpy()), model.posterior(b))
    else:
        w = np.zeros(N_FEATURES + 1)

    def odds(bits, hits, dense, many):
        return np.clip(design(bits, hits, dense, many) @ w[:-1] + w[-1], -30, 30)

    known = v.join(F.broadcast(known.filter("part = 4")), "doc_id").dropDuplicates(["doc_id"]).toPandas()  # at most MAX_TRAIN rows
    a = np.asarray([1.0, 0.0])
    if len(known) and 0 < known["y"].sum() < len(known):
        z = odds(known["bits"].to_numpy(np.int64), list(known["hits"]), known["dense"].to_numpy(), known["many"].to_numpy())
        fit = logistic(z[:, None] / 4, known["y"].to_numpy(float), ridge=1e-2)
        if fit[0] > 0:
            a = np.asarray([fit[0] / 4, fit[1]])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                z = odds(x.column(1).to_numpy().astype(np.int64), x.column(2).to_pylist(), x.column(3).to_numpy(), x.column(4).to_numpy())
                s = 1 / (1 + np.exp(-np.clip(a[0] * z + a[1], -30, 30)))
                yield pa.RecordBatch.from_arrays([x.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])

    out = v.mapInArrow(apply, "doc_id long, score double")
    return out.select("doc_id", (held_out() == 0).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
