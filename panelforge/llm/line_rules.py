"""Line-first document cleaning, native expressions only.

Every line is judged alone by punctuation, navigation and boilerplate rules; failing lines are
removed; a document that loses too much of its text is rejected. Document-level counts (repeats,
symbols, length) are computed beside it. No Python, Arrow or RDD code, and no shuffle: one scan.

Defined results: a null, empty or blank text has no words, zero counts, fails the base rule and is
not kept; texts count whole, however long, and an empty table gives an empty one. Repeated rows are
judged one by one. Extra columns are carried untouched by ``clean_lines``, unless one has the name of
an output, which then takes its place: give ``prefix`` where inputs may have such names. Helper
columns start with ``_q`` and are dropped again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WS, WS, words

#: A document is rejected when its failing lines hold more than this percentage of its word characters.
MAX_LOST_PERCENT = 50
#: A line fails when at least one in SYMBOL_SHARE of its words ends in a run of two symbols.
SYMBOL_SHARE = 4
#: A line of this many words without one sentence mark fails.
UNPUNCTUATED_WORDS = 8
#: A line fails as navigation when it has two separators and they are one in NAV_SHARE words.
NAV_SHARE = 6
#: Boilerplate phrases count only in lines of at most this many words.
BOILERPLATE_WORDS = 40

SYMBOL_ENDS = rf"{NON_WS}[#*$%&|<>!?=~_^]{{2,}}({WS}|$)"
SENTENCE_MARKS = "[.,;:!?…、。！？؟।]"
NAV_SEPARATORS = f"(^|{WS})([|>»›·•]|::|->)"
NAV_LINE = rf"(?i)^{WS}*(home|menu|next|previous|prev|back|log ?in|sign ?in|sign ?up|register|search|skip to (main )?content|site ?map|contact( us)?|about( us)?|share|tweet|print|top){WS}*$"
BOILERPLATE = (
    r"(?i)(cookie policy|we use cookies|accept (all )?cookies|all rights reserved|privacy policy|"
    r"terms of (use|service)|(enable|disabled) javascript|javascript (is|must be) (enabled|disabled|required)|"
    r"lorem ipsum|click here|subscribe to our|sign up for our|share (this|on)|follow us on|powered by|"
    r"skip to (main )?content|read more|back to top|page not found)"
)

#: Bits of a packed window that hold its position; longer texts take the exact path.
POS_BITS = 22


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def line_verdicts() -> str:
    """SQL over a lambda variable ``l`` (one line): true when the line stays."""
    w = f"size(array_remove(split(l, {_sql(WS + '+')}), ''))"
    return (
        f"(not (regexp_count(l, {_sql(SYMBOL_ENDS)}) * {SYMBOL_SHARE} >= {w} and {w} > 0)"
        f" and not ({w} >= {UNPUNCTUATED_WORDS} and not rlike(l, {_sql(SENTENCE_MARKS)}))"
        f" and not (regexp_count(l, {_sql(NAV_SEPARATORS)}) >= 2 and regexp_count(l, {_sql(NAV_SEPARATORS)}) * {NAV_SHARE} >= {w})"
        f" and not rlike(l, {_sql(NAV_LINE)})"
        f" and not ({w} <= {BOILERPLATE_WORDS} and rlike(l, {_sql(BOILERPLATE)})))"
    )


def _repeat_words(w: str) -> list[dict[str, str]]:
    """Steps that end in ``_qrep``: words lying in a 3-word window that occurs twice or more.

    Windows are packed as (hash, position) longs and sorted, so equal windows are neighbours. The
    neighbours' words are compared; where two different windows share the hash bits, the document
    takes the path that sorts the windows themselves. Both give the exact count.
    """
    b = POS_BITS
    tri = lambda p: f"concat_ws(' ', get({w}, {p}), get({w}, {p} + 1), get({w}, {p} + 2))"
    low = (1 << b) - 1
    return [
        {"_qh": f"case when size({w}) between 4 and {low} then sort_array(transform(slice({w}, 1, size({w}) - 2), (x, i) -> shiftleft(xxhash64(x, get({w}, i + 1), get({w}, i + 2)), {b}) | cast(i as bigint))) else cast(array() as array<bigint>) end"},
        {"_qp": f"filter(_qh, (x, i) -> shiftright(x, {b}) = shiftright(get(_qh, i - 1), {b}) or shiftright(x, {b}) = shiftright(get(_qh, i + 1), {b}))"},
        {"_qbad": f"size({w}) > {low} or exists(transform(_qp, (x, i) -> struct(x as a, get(_qp, i - 1) as b)), s -> shiftright(s.a, {b}) = shiftright(s.b, {b}) and {tri(f'cast(s.a & {low} as int)')} <> {tri(f'cast(s.b & {low} as int)')})"},
        {"_qs": f"case when _qbad then sort_array(transform(slice({w}, 1, size({w}) - 2), (x, i) -> struct({tri('i')} as t, i as p))) else cast(array() as array<struct<t:string,p:int>>) end"},
        {"_qpos": f"case when _qbad then transform(filter(_qs, (x, i) -> x.t = get(_qs, i - 1).t or x.t = get(_qs, i + 1).t), x -> x.p) else transform(_qp, x -> cast(x & {low} as int)) end"},
        {"_qrep": "cast(size(array_distinct(flatten(transform(_qpos, p -> array(p, p + 1, p + 2))))) as bigint)"},
    ]


def clean_lines(docs: DataFrame, text: str = "text", max_lost_percent: int = MAX_LOST_PERCENT, prefix: str = "") -> DataFrame:
    """Adds ``clean_text`` (the lines that passed) and the counts and verdicts:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, base_failed, kept, their
    names begun with prefix."""
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.withColumn("_qw", words(F.col(text))).withColumn("_ql", F.split(t, "\n", -1))
    df = df.withColumn("_qok", F.expr(f"filter(_ql, l -> {line_verdicts()})"))
    for step in _repeat_words("_qw"):
        df = df.withColumns({k: F.expr(v) for k, v in step.items()})
    df = df.withColumns({
        p + "n_words": F.size("_qw").cast("long"),
        p + "word_chars": F.length(F.array_join("_qw", "")).cast("long"),
        p + "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "_qbody": F.filter("_ql", lambda x: F.rlike(x, F.lit(NON_WS))),
        p + "n_repeat_words": F.col("_qrep"),
        p + "clean_text": F.array_join("_qok", "\n"),
    })
    df = df.withColumns({
        p + "n_dup_lines": (F.size("_qbody") - F.size(F.array_distinct("_qbody"))).cast("long"),
        p + "lost_chars": F.col(p + "word_chars") - F.length(F.regexp_replace(p + "clean_text", WS + "+", "")),
        p + "base_failed": (F.col(p + "n_words") < 50) | (100 * F.col(p + "n_repeat_words") > 50 * F.col(p + "n_words")),
    })
    # The row number, never negative, keeps the optimizer from moving a later filter below these
    # steps, which would write each step's expression out in every use of it.
    fence = F.monotonically_increasing_id() >= 0
    df = df.withColumn(p + "kept", ~F.col(p + "base_failed") & (100 * F.col(p + "lost_chars") <= max_lost_percent * F.col(p + "word_chars")) & fence)
    return df.drop("_qw", "_ql", "_qok", "_qh", "_qp", "_qbad", "_qs", "_qpos", "_qrep", "_qbody")


RESULT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def quality_query(docs: DataFrame) -> DataFrame:
    return clean_lines(docs.select("doc_id", "text")).select(*RESULT)


def _duck(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_DW = f"list_filter(string_split_regex(coalesce(text, ''), {_duck(WS + '+')}), lambda x: x <> '')"
_LW = f"len(list_filter(string_split_regex(l, {_duck(WS + '+')}), lambda x: x <> ''))"


def _dcount(p: str) -> str:
    return f"len(regexp_extract_all(l, {_duck(p)}))"


ORACLE = f"""
with d as (select row_number() over () as rid, doc_id, text, {_DW} as w, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select rid, unnest(ls) as l, unnest(range(len(ls))) as i from d),
bad as (
  select rid, sum(length(regexp_replace(l, {_duck(WS + '+')}, '', 'g'))) as lost from lines
  where ({_dcount(SYMBOL_ENDS)} * {SYMBOL_SHARE} >= {_LW} and {_LW} > 0)
     or ({_LW} >= {UNPUNCTUATED_WORDS} and not regexp_matches(l, {_duck(SENTENCE_MARKS)}))
     or ({_dcount(NAV_SEPARATORS)} >= 2 and {_dcount(NAV_SEPARATORS)} * {NAV_SHARE} >= {_LW})
     or regexp_matches(l, {_duck(NAV_LINE)})
     or ({_LW} <= {BOILERPLATE_WORDS} and regexp_matches(l, {_duck(BOILERPLATE)}))
  group by rid),
dup as (select rid, count(*) - count(distinct l) as n from lines where regexp_matches(l, {_duck(NON_WS)}) group by rid),
tri as (select rid, i, w[i] as a, w[i + 1] as b, w[i + 2] as c from (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 4)),
rep as (select rid, i, count(*) over (partition by rid, a, b, c) as n from tri),
cover as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep where n > 1) group by rid),
q as (
  select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::bigint as n_symbols,
    coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cover.n, 0)::bigint as n_repeat_words, coalesce(bad.lost, 0) as lost
  from d left join bad using (rid) left join dup using (rid) left join cover using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  (not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * lost <= {MAX_LOST_PERCENT} * word_chars) as kept
from q
"""
