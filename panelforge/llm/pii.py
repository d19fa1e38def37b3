"""Personal data: surrogates that are keyed, consistent with their type, and distinct.

One pass finds entities (``detect``). A surrogate is a keyed function of an entity's kind and
canonical form, so one entity has one surrogate in the whole corpus, whatever its spelling. Numbers
and hex secrets go through a keyed Feistel permutation of all strings of their length, which cannot
collide; card numbers walk on until their check digit is right if the original's was (wrong if it
was wrong). E-mail addresses, names and other secrets are drawn with a keyed generator: same script,
gender, capitals, separators and number of digits. Names and letters redrawn are longer by two syllables
or letters each time, so a few rounds are enough whatever the corpus.

Distinctness is checked over all entities of the corpus: a surrogate equal to another's, or to any
original, is drawn again until none is left. Redrawn ones are exceptions, looked up by a join;
everything else needs no lookup, so texts are not shuffled where there are none.

Defined results: null texts stay null, texts without entities stay as they are, byte for byte.
Texts count whole, however long; an empty table gives an empty one. Other columns may have any name
but ``_pii_n``. Repeated rows get the same surrogates. Rows with a null id, and rows that share an id, are rewritten
like any others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from ipaddress import IPv6Address

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches

#: Set your own; the same key gives the same surrogates.
KEY = b"panelforge surrogates"
#: Exceptions up to this many rows are broadcast; more are joined by a shuffle.
MAX_BROADCAST = 50_000

# Given names by gender and script, and titles by gender.
NAMES = {
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Laura Anna Maria Claire Sophie Camille Ingrid Heike Sabine Lucia Carmen Elena Julia Nina Helen".split(),
    ("latin", "m"): "James Robert John Michael David William Richard Joseph Thomas Daniel Matthew Andrew Peter Paul Pierre Jacques Antoine Hans Klaus Jürgen Carlos Diego Pablo Miguel Stefan George".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("cyrillic", "m"): "Иван Алексей Сергей Дмитрий Андрей Михаил Николай Павел Владимир Олег".split(),
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Σοφία Άννα Βασιλική".split(),
    ("greek", "m"): "Γιώργος Νίκος Δημήτρης Κώστας Γιάννης Παύλος".split(),
}
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "госпожа", "Госпожа", "г-жа", "Κυρία"],
    "m": ["Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "господин", "Господин", "г-н", "Κύριος"],
    "": ["Dr", "Prof", "Professor"],
}
SYLLABLES = {
    "latin": "ba be bo da de do fa ga go ha ka ke ko la le li lo ma me mi mo na ne no pa pe ra re ri ro sa se so ta te to va ve vi zo".split(),
    "cyrillic": "ба бе бо да де до ка ко ла ле ло ма ме мо на не но ра ре ро са се со та те то ва ве во за".split(),
    "greek": "βα βε βο δα δε δο κα κο λα λε λο μα με μο να νε νο ρα ρε ρο σα σε σο τα τε το ζα ζο".split(),
}
SURNAME_END = {"latin": "ner son ard ez ini er man ley".split(), "cyrillic": "ов ев ин ский ко ман".split(), "greek": "ης ος ίδης άκης".split()}
GENDER_OF = {n: (s, g) for (s, g), x in NAMES.items() for n in x}
#: More given names that are found without a title; surrogates are drawn from NAMES alone.
MORE_NAMES = {
    ("latin", "f"): "Margaret Dorothy Nancy Lisa Betty Helena Sandra Ashley Kimberly Donna Michelle Amanda Melissa Deborah Stephanie Rebecca Sharon Cynthia Kathleen Amy Angela Shirley Brenda Pamela Nicole Samantha Katherine Christine Debra Rachel Carolyn Janet Catherine Heather Diane Olivia Julie Joyce Kelly Lauren Christina Joan Evelyn Judith Megan Andrea Cheryl Hannah Jacqueline Martha Teresa Sara Janice Kathryn Abigail Alice Emma Amélie Chloé Léa Manon Isabelle Nathalie Valérie Sylvie Brigitte Hélène Françoise Monique Céline Élodie Aurélie Petra Ursula Monika Birgit Anja Katrin Kerstin Claudia Gisela Renate Greta Lena Ana Isabel Pilar Teresa Cristina Marta Rocío Lucía María Sofía Beatriz Silvia Raquel Giulia Francesca Chiara Priya Fatima Aisha Agnieszka Katarzyna Małgorzata".split(),
    ("latin", "m"): "Charles Christopher Anthony Donald Steven Joshua Kenneth Kevin Brian Timothy Ronald Edward Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Alexander Patrick Raymond Jerry Dennis Tyler Aaron Jose Adam Nathan Henry Zachary Douglas Kyle Noah Ethan Jeremy Walter Keith Roger Terry Sean Gerald Carl Harold Arthur Lawrence Albert Bryan Philippe Nicolas François Olivier Laurent Thierry Julien Sébastien Guillaume Étienne Luc Wolfgang Jörg Uwe Dieter Günther Heinz Matthias Andreas Markus Tobias Sebastian Florian Lukas Felix Javier José Juan Luis Manuel Fernando Alejandro Sergio Rafael Ramón Andrés Álvaro Giovanni Marco Luca Mohammed Ahmed Omar Rajesh Piotr Krzysztof Tomasz Wojciech".split(),
    ("cyrillic", "f"): "Людмила Галина Валентина Надежда Людмила Оксана Марина Виктория Ксения Дарья Полина Алина Анастасия".split(),
    ("cyrillic", "m"): "Александр Максим Евгений Юрий Виктор Игорь Константин Антон Денис Роман Артём Никита Борис Григорий Пётр".split(),
    ("greek", "f"): "Αικατερίνη Γεωργία Δήμητρα Ιωάννα Χριστίνα Ειρήνη".split(),
    ("greek", "m"): "Γεώργιος Νικόλαος Κωνσταντίνος Ιωάννης Χρήστος Παναγιώτης".split(),
}
GIVEN = {n: (s, g) for (s, g), x in MORE_NAMES.items() for n in x} | GENDER_OF

_CAP = r"[A-ZÀ-ÖØ-ÞА-ЯЁΆ-ΏΑ-Ω][a-zß-öø-ÿа-яёά-ώ'’]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁΆ-ΏΑ-Ω][a-zß-öø-ÿа-яёά-ώ]+)?"
_TITLE_OF = {t: g for g, x in TITLES.items() for t in x}
_TITLED = re.compile(rf"(?<!\w)({'|'.join(sorted(_TITLE_OF, key=len, reverse=True))})\.?[ \t]+({_CAP}(?:[ \t]+{_CAP})?)(?!\w)")
_FULL = re.compile(rf"(?<![\w@.])({_CAP})(?=[ \t]+({_CAP})(?![\w@]))")  # a word may end one pair and begin the next
_LOCAL = re.compile(r"[\w.%+\-]+$")
_DOMAIN = re.compile(r"[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}")
_ASSIGNED = re.compile(r"(?i)\b(?:token|secret|password|passwd|pwd|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key|auth[_\- ]?key|bearer)\b[\"']?\s*(?:[=:]|\bis\b)\s*[\"']?([A-Za-z0-9_\-/+.]{8,}[A-Za-z0-9_/+=])")
_KNOWN = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|AIza[0-9A-Za-z_\-]{30,}|eyJ[\w\-]{8,}\.[\w\-]{8,}\.[\w\-]{8,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,128}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
_DIGITS = re.compile(r"(?<![\w.])\d{13,19}(?![\w]|\.\d)")
_GROUPED = re.compile(r"(?<![\w.\-])\d{4}([ \-])\d{4}\1\d{4}\1\d{1,7}(?![\w]|-\d)")
_SSN = re.compile(r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)")
_PHONE = re.compile(r"(?<!\w)\+\d{1,3}[ .\-]?(?:\(\d{1,5}\)[ .\-]?)?\d{1,5}(?:[ .\-]?\d{2,5}){1,4}(?!\d)|(?<![\w.\-(])(?:\(\d{3}\) ?|\d{3}[\-.])\d{3}[\-.]\d{4}(?![\w]|[\-.]\d)")
_IP4 = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\w|\.\d)")
_GROUPS = r"[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4})"
_IP6 = re.compile(rf"(?<![\w:])(?:{_GROUPS}{{7}}|(?:{_GROUPS}{{0,6}})?::(?:{_GROUPS}{{0,6}})?)(?!\w|:[\w:])")
_DIGIT = re.compile(r"\d")
_WORD = re.compile(r"\w+")


def luhn(d: str) -> bool:
    s = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (1 + i % 2)
        s += v - 9 * (v > 9)
    return s % 10 == 0


def _iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _ip6(s: str) -> str | None:
    """All eight groups in full; None for what is no address, and for :: and ::1, which are no one's."""
    try:
        a = IPv6Address(s)
    except ValueError:
        return None
    return None if a.is_unspecified or a.is_loopback else a.exploded


def script_of(s: str) -> str:
    return "cyrillic" if any("А" <= c <= "ё" for c in s) else "greek" if any("Ά" <= c <= "ώ" for c in s) else "latin"


def detect(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, in order, none overlapping."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []

    def add(a: int, b: int, kind: str, canon: str) -> None:
        if a < b and all(b <= x or a >= y for x, y in taken):
            taken.append((a, b))
            found.append((a, b, kind, canon))

    if "@" in text:
        i = text.find("@")
        while i >= 0:
            m, n = _LOCAL.search(text, max(0, i - 64), i), _DOMAIN.match(text, i + 1)
            if m and n:
                a, b = m.start(), n.end()
                while a < i and text[a] in ".-%+":
                    a += 1
                add(a, b, "email", text[a:b].lower())
            i = text.find("@", i + 1)
    for m in _ASSIGNED.finditer(text):
        v = m[1]
        if any(c.isdigit() for c in v) and any(c.isalpha() for c in v):
            hexa = _HEX.fullmatch(v)
            add(m.start(1), m.end(1), "hex" if hexa else "secret", v.lower() if hexa else v)
    for m in _HEX.finditer(text):
        if not m[0].isdigit():
            add(*m.span(), "hex", m[0].lower())
    for m in _KNOWN.finditer(text):
        add(*m.span(), "secret", m[0])
    digit = _DIGIT.search(text)  # the patterns under it all demand a digit
    if digit:
        for m in _IBAN.finditer(text):
            if _iban_ok(m[0]):
                add(*m.span(), "iban", m[0].replace(" ", ""))
        for m in _DIGITS.finditer(text):
            if len(m[0]) == 16 or luhn(m[0]):
                add(*m.span(), "card", m[0])
        for m in _GROUPED.finditer(text):
            if luhn(d := re.sub(r"\D", "", m[0])):
                add(*m.span(), "card", d)
        for m in _IP4.finditer(text):
            add(*m.span(), "ip4", m[0])
    if ":" in text:
        for m in _IP6.finditer(text):
            if full := _ip6(m[0]):
                add(*m.span(), "ip6", full)
    if digit:
        for m in _SSN.finditer(text):
            add(*m.span(), "ssn", m[0].replace("-", ""))
        for m in _PHONE.finditer(text):
            d = re.sub(r"\D", "", m[0])
            if 7 <= len(d) <= 15:
                add(*m.span(), "phone", ("+" if m[0][0] == "+" else "") + d)
    for m in _TITLED.finditer(text):
        _name(m.start(2), m[2], _TITLE_OF[m[1]], add)
    if not GIVEN.keys().isdisjoint(_WORD.findall(text)):
        for m in _FULL.finditer(text):
            if m[1] in GIVEN and m[2] not in GENDER_OF:
                _name(m.start(), text[m.start() : m.end(2)], GIVEN[m[1]][1], add)
    for kind, canon, word in {(k, c, text[a:b]) for a, b, k, c in found if k[0] in "gs" and "/" in k}:
        for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text):  # the same name elsewhere in the text
            add(*m.span(), kind, canon)
    found.sort()
    return found


def _name(at: int, s: str, gender: str, add) -> None:
    """Given name and surname are entities of their own, so a later surname alone still corefers."""
    parts = [(m.start(), m[0]) for m in re.finditer(r"\S+", s)]
    for i, (a, w) in enumerate(parts):
        script = script_of(w)
        if i == 0 and (len(parts) > 1 or w in GIVEN):
            add(at + a, at + a + len(w), f"given/{script}/{gender or GIVEN.get(w, ('', ''))[1] or 'm'}", w.casefold())
        else:
            add(at + a, at + a + len(w), f"surname/{script}", w.casefold())


def _number(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=key, digest_size=16).digest(), "big")


def permute(key: bytes, tweak: str, digits: str, radix: int) -> str:
    """A keyed permutation of all strings of this length over the radix: a Feistel network."""
    n = len(digits)
    if n < 2:
        return "0123456789abcdef"[(int(digits, radix) + _number(key, tweak)) % radix] if n else ""
    u = n // 2
    a, b, ma, mb = int(digits[:u], radix), int(digits[u:], radix), radix**u, radix ** (n - u)
    for r in range(8):
        if r % 2 == 0:
            a = (a + _number(key, tweak, n, r, b)) % ma
        else:
            b = (b + _number(key, tweak, n, r, a)) % mb

    def put(x: int, k: int) -> str:
        return "".join("0123456789abcdef"[x // radix**i % radix] for i in reversed(range(k)))

    return put(a, u) + put(b, n - u)


def _draw(key: bytes, template: str, *parts: object) -> str:
    """Letters for letters and digits for digits, by a keyed stream."""
    out, pool, k = [], 0, 0
    for c in template:
        if pool < 1 << 16:
            pool, k = _number(key, k, *parts), k + 1
        if c.isdigit():
            pool, v = divmod(pool, 10)
            out.append(str(v))
        elif c.isalpha():
            pool, v = divmod(pool, 26)
            out.append(chr((65 if c.isupper() else 97) + v))
        else:
            out.append(c)
    return "".join(out)


def _syllables(n: int, script: str, count: int) -> str:
    syl, out = SYLLABLES[script], ""
    for _ in range(count):
        n, v = divmod(n, len(syl))
        out += syl[v]
    return out


@lru_cache(100_000)
def surrogate(kind: str, canon: str, attempt: int = 0, key: bytes = KEY) -> str:
    """The canonical surrogate of an entity."""
    if kind in ("card", "ssn", "phone", "hex", "ip6"):
        keep = ""
        body = canon
        if kind == "phone" and canon[0] == "+":
            keep, body = canon[:2], canon[2:]
        if kind == "ip6":
            body = canon.replace(":", "")
        radix, valid = (16 if kind in ("hex", "ip6") else 10), kind == "card" and luhn(canon)
        for _ in range(attempt + 1):
            body = permute(key, kind, body, radix)
            while kind == "card" and luhn(body) != valid:
                body = permute(key, kind, body, radix)
        if kind == "ip6":
            return ":".join(body[i : i + 4] for i in range(0, 32, 4))
        return keep + body
    if kind == "ip4":
        h = "".join(f"{int(x):02x}" for x in canon.split("."))
        for _ in range(attempt + 1):
            h = permute(key, kind, h, 16)
            while h[:2] in ("00", "ff"):
                h = permute(key, kind, h, 16)
        return ".".join(str(int(h[i : i + 2], 16)) for i in range(0, 8, 2))
    if kind == "email":
        local, _, domain = canon.rpartition("@")
        tail = re.search(r"\d*$", local)[0]
        letters = _draw(key, "x" * (8 + 2 * attempt), "email", canon, attempt)
        place = _draw(key, "x" * 12, "domain", domain)  # one for all addresses of a domain
        return f"{letters}{'.' if '.' in local or tail else ''}{_draw(key, tail, 'tail', canon, attempt)}@{place}.example.{('com', 'net', 'org')[_number(key, 'top', domain) % 3]}"
    if kind == "iban":
        body = _draw(key, canon[4:], "iban", canon, attempt)
        check = 98 - int("".join(str(int(c, 36)) for c in body + canon[:2] + "00")) % 97
        return f"{canon[:2]}{check:02d}{body}"
    if kind.startswith("given/"):
        _, script, gender = kind.split("/")
        pool = NAMES[script, gender or "m"]
        n = _number(key, kind, canon, attempt)
        second = _syllables(n // len(pool), script, 2 + 2 * attempt) if attempt else ""
        return (pool[n % len(pool)] + ("-" if second else "") + second).casefold()
    if kind.startswith("surname/"):
        script = kind.split("/")[1]
        end, n = SURNAME_END[script], _number(key, kind, canon, attempt)
        return _syllables(n // len(end), script, 3 + 2 * attempt) + end[n % len(end)]
    prefix = re.match(r"AKIA|gh[pousr]_|sk-|xox[abprs]-|AIza|eyJ|", canon)[0]
    return prefix + _draw(key, canon[len(prefix) :], "secret", canon, attempt)


def render(kind: str, original: str, new: str) -> str:
    """The surrogate in the original's format: separators, capitals."""
    if kind in ("card", "ssn", "phone", "iban"):
        chars = iter(new.lstrip("+"))
        return "".join(next(chars) if c.isalnum() else c for c in original)
    if kind.startswith(("given", "surname")):
        return new.upper() if original.isupper() and len(original) > 1 else "-".join(x[:1].upper() + x[1:] for x in new.split("-"))
    if kind in ("hex", "email", "ip6"):
        return new.upper() if any(c.isalpha() for c in original) and original == original.upper() else new
    return new


def rewrite(text: str, overrides: dict[tuple[str, str], str] | None = None, key: bytes = KEY) -> tuple[str, int]:
    found = detect(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, canon in found:
        new = (overrides or {}).get((kind, canon)) or surrogate(kind, canon, 0, key)
        out += [text[at:a], render(kind, text[a:b], new)]
        at = b
    return "".join([*out, text[at:]]), len(found)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = set()
        for d, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if t.is_valid:
                rows.update((d, k, c) for _, _, k, c in detect(t.as_py()))
        rows = list(rows)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["doc_id", "kind", "canon"])


def _assign(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [surrogate(k, c, n, key) for k, c, n in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(s, pa.string())], names=["kind", "canon", "attempt", "new"])

    return run


def exceptions(mentions: DataFrame, key: bytes = KEY) -> DataFrame:
    """kind, canon, new of every entity whose first surrogate was another's or an original's.
    The given names of the pool go to one name each; further names get one of the pool with a second
    name of syllables, longer with every attempt."""
    schema = "kind string, canon string, attempt int, new string"
    everyone = materialize(mentions.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).mapInArrow(_assign(key), schema), "pii_entities")
    now, i = everyone, 0
    while True:
        group = F.when(F.col("kind").startswith("given/"), F.lit("given")).otherwise(F.col("kind"))
        taken = now.withColumn("g", group).groupBy("g", "new").agg(F.min("canon").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
        twice = now.withColumn("g", group).join(taken, ["g", "new"]).filter("canon <> first").select("kind", "canon", "attempt")
        own = now.alias("s").join(everyone.select("kind", F.col("canon").alias("orig")).alias("o"), (F.col("s.kind") == F.col("o.kind")) & (F.col("s.new") == F.col("o.orig"))).select("s.kind", "s.canon", "s.attempt")
        again = materialize(twice.unionByName(own).distinct(), f"pii_again{i}")
        if not again.head(1):
            return now.filter("attempt > 0").select("kind", "canon", "new")
        redrawn = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(_assign(key), schema)
        now = materialize(now.join(again.select("kind", "canon"), ["kind", "canon"], "left_anti").unionByName(redrawn), f"pii_round{i}")
        i += 1


def _rewrite(at: int, names: list[str], key: bytes, overrides: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            over = b.column(len(names)).to_pylist() if overrides else [None] * b.num_rows
            for t, o in zip(b.column(at), over, strict=True):
                new, n = rewrite(t.as_py(), {(x["kind"], x["canon"]): x["new"] for x in o} if o else None, key) if t.is_valid else (None, 0)
                texts.append(new)
                counts.append(n)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64())], names=[*names, "_pii_n"])

    return run


def surrogates(docs: DataFrame, text: str = "text", key: bytes = KEY) -> DataFrame:
    """The documents, all columns, with entities replaced, and ``_pii_n``, their number."""
    small_batches(docs.sparkSession)
    names = docs.columns
    docs = docs.withColumn(text, F.col(text).cast("string"))
    m = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInArrow(_mentions, "doc_id long, kind string, canon string"), "pii_mentions")
    exc = materialize(exceptions(m, key), "pii_exceptions")
    schema = T.StructType([*docs.schema.fields, T.StructField("_pii_n", T.LongType())])
    n = exc.count()
    if not n:
        return docs.mapInArrow(_rewrite(names.index(text), names, key, False), schema)
    over = m.join(exc, ["kind", "canon"]).groupBy(F.col("doc_id").alias("_pii_doc")).agg(F.collect_list(F.struct("kind", "canon", "new")).alias("_pii_o"))
    over = materialize(over, "pii_overrides")
    over = F.broadcast(over) if over.count() <= MAX_BROADCAST else over
    j = docs.join(over, F.col("doc_id").cast("long").eqNullSafe(F.col("_pii_doc")), "left").select(*[F.col(f"`{c}`") for c in names], "_pii_o")
    return j.mapInArrow(_rewrite(names.index(text), names, key, True), schema)


def pii_query(docs: DataFrame) -> DataFrame:
    return surrogates(docs.select("doc_id", "text")).withColumnRenamed("_pii_n", "n_entities")
