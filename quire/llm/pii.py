"""PII surrogates: keyed, type-consistent replacements that keep format, gender, script, distinctness and coreference."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import among, sliced, stage

_FEMALE = r"Mrs|Ms|Miss|Madam|Frau|Mme|Mlle|Sra|Señora|Госпожа"
_MALE = r"Mr|Sir|Herr|Sr|Señor|Monsieur|Господин"
_NAME = r"[^\W\d_a-zа-яß-ÿ][^\W\d_]+"
_FIND = re.compile(
    rf"""
    (?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)
  | (?P<secret>\bAKIA[A-Z0-9]{{16}}\b|\b(?:sk|pk|rk)[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{{16,}}\b|\bgh[pousr]_[A-Za-z0-9]{{20,}}\b)
  | (?P<named>\b(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)["']?\s{{0,3}}[:=]\s{{0,3}}["']?)(?P<value>[^\s"',;]{{6,}})
  | (?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d))
  | (?P<ssn>(?<![\d-])\d{{3}}-\d{{2}}-\d{{4}}(?![\d-]))
  | (?P<card>(?<![\d-])\d(?:[ -]?\d){{12,18}}(?![\d-]))
  | (?P<phone>(?<![\w+])(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{3}}[.-])\d{{3,4}}[ .-]\d{{3,4}}(?!\w)|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,5}}(?!\w))
  | (?P<iban>\b[A-Z]{{2}}\d{{2}}(?:\ ?[A-Z0-9]{{4}}){{2,7}}(?:\ ?[A-Z0-9]{{1,4}})?\b)
  | (?P<person>\b(?:{_FEMALE}|{_MALE}|Dr|Prof)\.?\ (?:{_NAME})(?:\ {_NAME})?)
    """,
    re.VERBOSE,
)
#: Given names that make a following capitalised word a last name, without a title; of many languages, by gender.
GIVEN = {
    "f": "Alice Amelia Amy Ana Andrea Angela Anna Anne Barbara Betty Carmen Carol Catherine Charlotte Clara Claire Deborah Elena Elisabeth Elizabeth Emily Emma Eva Fatima Grace Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Lisa Lucia Margaret Maria Marie Mary Natalia Nicole Olga Olivia Patricia Paula Rachel Rebecca Rosa Ruth Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    "m": "Adam Ahmed Albert Alexander Andrew Anthony Antonio Benjamin Brian Carlos Charles Christopher Daniel David Diego Dmitri Edward Eric Felix Francisco Frank Franz George Hans Henry Ivan Jack Jacob James Jan Javier Jean Joe John Jorge Joseph Juan Karl Kevin Klaus Luis Manuel Marco Mark Martin Matthew Michael Miguel Mohamed Nicholas Oliver Pablo Patrick Paul Pedro Peter Philip Pierre Richard Robert Sergei Simon Stefan Steven Thomas Walter William".split(),
}
_GENDER = {n: g for g, names in GIVEN.items() for n in names}
_UNTITLED = re.compile(rf"\b({'|'.join(sorted(_GENDER))}) ({_NAME})")
#: What before four numbers with dots makes them a version, not an address.
_VERSION = re.compile(r"(?i)(?:\bv|\bver|version|release|build|revision|section|§)[.:#]?\s?$")
_TITLES = frozenset(f"{_FEMALE}|{_MALE}|Dr|Prof".split("|"))
_CAPITAL = re.compile(r"[A-ZГ][^\W\d_]*(?=\.? )")
_DIGIT = re.compile(r"\d")
_KEYED = re.compile(r"[spr]k[-_]|gh[pousr]_")
_CALLED = re.compile(r"(?i:passw|pwd|secret|token|key)")


def may_hold(text: str) -> bool:
    """False only for a text without any entity, by what each kind can't do without; most texts need no other pattern."""
    if "@" in text or "AKIA" in text or _DIGIT.search(text):
        return True
    if ("-" in text or "_" in text) and _KEYED.search(text):
        return True
    if (":" in text or "=" in text) and _CALLED.search(text):
        return True
    return any(w in _TITLES or w in _GENDER for w in _CAPITAL.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _hash(key: bytes, *parts: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), key=key, digest_size=16).digest(), "big")


def permute_digits(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the digit strings of this length (an alternating Feistel network), so distinct stay distinct."""
    if len(digits) < 2:
        return str((int(digits) + _hash(key, tweak) % 10) % 10) if digits else ""
    u = len(digits) // 2
    a, b = digits[:u], digits[u:]
    for i in range(8):
        if i % 2:
            b = str((int(b) + _hash(key, tweak, i, a)) % 10 ** len(b)).zfill(len(b))
        else:
            a = str((int(a) + _hash(key, tweak, i, b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def _digits(text: str) -> str:
    """The decimal digits of a text, of whatever script, as ASCII."""
    return "".join(str(unicodedata.decimal(c)) for c in text if c.isdecimal())


def _as(digit: str | int, like: str) -> str:
    """A digit in the script of another."""
    return chr(ord(like) - unicodedata.decimal(like) + int(digit))


def _into(template: str, digits: str) -> str:
    it = iter(digits)
    return "".join(_as(next(it), c) if c.isdecimal() else c for c in template)


#: (first, last) code points of scripts that have no case here; a letter is replaced by one of the same range.
SCRIPTS = ((0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0xE01, 0xE30), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3), (0x10D0, 0x10F0), (0x561, 0x586))


def _letter(c: str, x: int) -> str:
    """A letter of the script and case of ``c``: Latin, Cyrillic, Greek or one of SCRIPTS; others stay."""
    code = ord(c.lower()) if len(c.lower()) == 1 else ord(c)
    for a, b in SCRIPTS:
        if a <= code <= b:
            return next(y for k in range(b - a + 1) if (y := chr(a + (x + k) % (b - a + 1))).isalpha())
    if 0x430 <= code <= 0x45F:
        made = chr(0x430 + x % 32)
    elif 0x3AC <= code <= 0x3CE:
        made = "αβγδεζηθικλμνξοπρστυφχψω"[x % 24]
    elif code < 0x250:
        made = chr(97 + x % 26)
    else:
        return c
    return made.upper() if c.isupper() else made


def _same_shape(text: str, key: bytes, tweak: str, hexed: bool = False) -> str:
    """A letter for a letter of the same case, a digit for a digit, the rest as it is."""
    out, h = [], 0
    for k, c in enumerate(text):
        if k % 16 == 0:
            h = _hash(key, tweak, k, text)
        h, x = h // 256, h % 256
        if hexed and c in "0123456789abcdef":
            out.append("0123456789abcdef"[x % 16])
        elif c.isdecimal():
            out.append(_as(x % 10, c))
        elif c.isalpha():
            out.append(_letter(c, x if ord(c) < 0x600 else _hash(key, tweak, k, c, text)))
        else:
            out.append(c)
    return "".join(out)


_SYLLABLES = {
    "latin": ("b d f g k l m n p r s t v".split(), "a e i o u".split(), {"f": "a", "m": "n", "": "s"}),
    "cyrillic": ("б в г д к л м н п р с т".split(), "а е и о у".split(), {"f": "а", "m": "н", "": "с"}),
    "greek": ("β γ δ κ λ μ ν π ρ τ".split(), "α ε ι ο υ".split(), {"f": "α", "m": "ς", "": "ς"}),
}


def _name(word: str, gender: str, key: bytes, tweak: str) -> str:
    """A made-up name of the word's script, ending as the gender does, capitalised as the word is.

    Scripts other than Latin, Cyrillic and Greek get letters of their own, without regard to gender.
    """
    first = ord(word[0].lower()[0])
    script = "cyrillic" if 0x400 <= first < 0x530 else "greek" if 0x370 <= first < 0x400 else "latin" if first < 0x250 else ""
    if not script:
        return _same_shape(word, key, tweak)
    consonants, vowels, ends = _SYLLABLES[script]
    h, out = _hash(key, tweak, word.lower()), ""
    for _ in range(4):
        h, x = divmod(h, len(consonants))
        h, y = divmod(h, len(vowels))
        out += consonants[x] + vowels[y]
    out = out[:-1] + ends[gender] if ends[gender] in vowels else out + ends[gender]
    return out.upper() if word.isupper() else out.capitalize()


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of one value.  ``kind``: of an entity, or name:f, name:m or name: for one word of a name (the gender only ends it)."""
    tweak = f"{kind.split(':')[0]}/{attempt}"
    if kind.startswith("name:"):
        return _name(value, kind[5:], key, tweak)
    if kind == "email":
        local, domain = value.lower().split("@", 1)
        return f"{_same_shape(local, key, tweak)}@{_same_shape(domain.rsplit('.', 1)[0].split('.')[0], key, 'domain')}.example.org"
    if kind == "ip":
        number = 0
        for x in value.split("."):
            number = number << 8 | int(x)
        a, b = number >> 16, number & 0xFFFF
        for i in range(6):
            a, b = b, a ^ (_hash(key, tweak, i, b) & 0xFFFF)
        return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"
    if kind == "card":
        digits = _digits(value)
        body = digits[0] + permute_digits(digits[1:-1], key, tweak)
        shift = next(k for k in range(10) if luhn(digits[:-1] + str((int(digits[-1]) + k) % 10)))
        check = next(k for k in range(10) if luhn(f"{body}{k}"))
        return _into(value, f"{body}{(check - shift) % 10}")  # as far from valid as the original
    if kind == "phone":
        digits = _digits(value)
        head = len(re.match(r"\+(\d{1,3})(?=[ .(-])|", value)[1] or "") if value[0] == "+" else 0
        return _into(value, digits[:head] + permute_digits(digits[head:], key, tweak))
    if kind == "ssn":
        return _into(value, permute_digits(_digits(value), key, tweak))
    if kind == "iban":
        made = value[:4] + _same_shape(value[4:], key, tweak)
        check = int(_digits(value[2:4])) + _mod97(value) - _mod97(made)  # as far from valid as the original
        return value[:2] + _into(value[2:4], f"{check % 97:02d}") + made[4:]
    prefix = re.match(r"AKIA|(?:sk|pk|rk)[-_](?:(?:live|test|proj)[-_])?|gh[pousr]_|", value)[0]
    rest = value[len(prefix) :]
    return prefix + _same_shape(rest, key, tweak, hexed=re.fullmatch(r"[0-9a-f]+", rest) is not None)


def _mod97(iban: str) -> int:
    """The remainder that is 1 for a valid account number."""
    plain = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of what is to be replaced, ascending; a person gives one entry per word of the name.

    Words of a name that recur alone in the same text are found too.
    """
    if not text or not may_hold(text):
        return []
    out: list[tuple[int, int, str, str]] = []
    names: dict[str, str] = {}

    def person(at: int, words: list[str], gender: str) -> None:
        for k, w in enumerate(words):
            kind = "name:" + (gender if len(words) > 1 and k == 0 else "")  # a last name has no gender
            out.append((at, at + len(w), kind, w))
            if names.get(w, "name:") == "name:":
                names[w] = kind
            at += len(w) + 1

    for m in _FIND.finditer(text):
        kind, value = m.lastgroup, m[0]
        if kind == "value":  # of a named secret
            out.append((m.start(kind), m.end(kind), "secret", m[kind]))
        elif kind == "person":
            title, *words = value.split(" ")
            gender = "f" if re.fullmatch(_FEMALE, title.rstrip(".")) else "m" if re.fullmatch(_MALE, title.rstrip(".")) else ""
            person(m.start() + len(title) + 1, words, gender or _GENDER.get(words[0], ""))
        elif kind != "ip" or not _VERSION.search(text, max(0, m.start() - 12), m.start()):
            out.append((m.start(), m.end(), kind, value))
    taken = _Taken(out)
    for m in _UNTITLED.finditer(text):
        if taken.free(m.start(), m.end()):
            person(m.start(), [m[1], m[2]], _GENDER[m[1]])
    if names:
        taken = _Taken(out)
        for m in _WORD.finditer(text):
            if m[0] in names and taken.free(m.start(), m.end()):
                out.append((m.start(), m.end(), names[m[0]], m[0]))
    # in one text a word has one gender
    return sorted((a, b, names[v] if k.startswith("name:") else k, v) for a, b, k, v in out)


_WORD = re.compile(r"\w+")


class _Taken:
    """Disjoint spans, searched by bisection."""

    def __init__(self, spans: list[tuple[int, int, str, str]]) -> None:
        self.spans = sorted((a, b) for a, b, _, _ in spans)

    def free(self, a: int, b: int) -> bool:
        k = bisect_left(self.spans, (b, 0))
        return k == 0 or self.spans[k - 1][1] <= a


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, kind, value, gender): name words are of one kind."""
    for batch in sliced(batches):
        found = sorted({(row, k.split(":")[0], _norm(k, v), k[5:] if k.startswith("name:") else "") for row, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for _, _, k, v in entities(x.as_py())})
        if found:
            c = list(zip(*found, strict=True))
            yield pa.record_batch([pa.array(c[0], pa.int64()), *[pa.array(x, pa.string()) for x in c[1:]]], names=["row", "kind", "value", "gender"])


def _norm(kind: str, value: str) -> str:
    """Mentions of one entity that differ in case only corefer."""
    return value.lower() if kind == "email" or kind.startswith("name:") else value


def _made(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                r["made"] = surrogate(f"name:{r['gender']}" if r["kind"] == "name" else r["kind"], r["value"], key, r["attempt"])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("kind", pa.string()), ("value", pa.string()), ("gender", pa.string()), ("attempt", pa.int32()), ("made", pa.string())]))

    return run


_MADE = "kind string, value string, gender string, attempt int, made string"


def settled(values: DataFrame, key: bytes, rounds: int = 100) -> DataFrame:
    """(kind, value, gender, attempt): for each distinct value the attempt whose surrogate nobody else has, of any kind, and is no real value.

    Of values with the same surrogate the one of the earliest attempt, then the smallest, keeps it; the others try again,
    against all surrogates in use.  Surrogates are compared without case.  Values that still collide after ``rounds``
    rounds are an error.
    """
    now = stage(values.withColumn("attempt", F.lit(0)).mapInArrow(_made(key), _MADE), "surrogates")
    real = stage(values.select(F.lower("value").alias("v")).distinct(), "values")
    for _ in range(rounds):
        mine, low = F.struct("attempt", "kind", "value"), F.lower("made")
        first = now.groupBy(low.alias("m")).agg(F.min(mine).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1").select("m", "f")
        bad = now.join(first, low == F.col("m")).where(mine != F.col("f")).select(*now.columns)
        bad = stage(bad.unionByName(now.join(real, low == F.col("v"), "left_semi")).distinct(), "collide")
        if bad.isEmpty():
            return now.drop("made")
        tried = bad.drop("made").withColumn("attempt", F.col("attempt") + 1).mapInArrow(_made(key), _MADE)
        now = stage(now.join(bad.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(tried), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} rounds")


def replace(text: str | None, key: bytes, other: dict[tuple[str, str], tuple[str, int]]) -> tuple[str | None, int]:
    """The text with its entities replaced, and their number.  ``other``: (gender, attempt) of (kind, value) where they aren't the text's own and 0."""
    found = entities(text)
    if not found:
        return text, 0
    out, at = [], 0
    for a, b, kind, value in found:
        base, name = _norm(kind, value), kind.startswith("name:")
        gender, attempt = other.get((kind.split(":")[0], base), (kind[5:], 0))
        made = surrogate(f"name:{gender}" if name else kind, base, key, attempt)
        if name:
            made = made.upper() if value.isupper() and len(value) > 1 else made.capitalize()
        out += [text[at:a], made]
        at = b
    return "".join(out) + text[at:], len(found)


def _replace(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            own = [{(e["kind"], e["value"]): (e["gender"], e["attempt"]) for e in o or ()} for o in batch.column(2).to_pylist()]
            made = [replace(x.as_py(), key, o) for x, o in zip(batch.column(1), own, strict=True)]
            yield pa.record_batch([batch.column(0), pa.array([n for _, n in made], pa.int64()), pa.array([t for t, _ in made], pa.string())], names=["doc_id", "n_entities", "text"])

    return run


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_entities, text): whole texts with every found entity replaced.

    Finds e-mail and IPv4 addresses (not versions), phone, card, social security and account numbers, secrets, names after
    a title, given names of GIVEN before a capitalised word, and words of such names where they recur in the same text.
    Names are found in Latin, Cyrillic and Greek script only.  An entity's surrogate depends on the key, its value and
    what the whole corpus says of it, so it is the same in all documents: a name word is one entity whatever it stands
    for, of the gender that most documents give it.  Digits keep format and script (card and account numbers stay as valid as
    they were), names their script, gender and case.  Distinct entities have distinct surrogates, checked over the whole corpus
    and all kinds (settled()).  Rows are known by id and text, so null and repeated ids are served; null text stays null.

    Most texts need nothing but themselves; texts with an entity that has another gender elsewhere, or a second attempt,
    are told by a Bloom filter where they are read, and only they shuffle.
    """
    id_, text = F.col(id_col).cast("long"), F.col(text_col)
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), F.xxhash64(id_, text).alias("row"))
    seen = stage(rows.select("row", "text").mapInArrow(_found, "row long, kind string, value string, gender string"), "entities")
    votes = F.count(F.when(F.col("gender") == "f", 1)), F.count(F.when(F.col("gender") == "m", 1))
    gender = F.when((votes[0] == 0) & (votes[1] == 0), "").when(votes[0] >= votes[1], "f").otherwise("m")
    values = stage(seen.groupBy("kind", "value").agg(gender.alias("gender")), "values")
    known = settled(values, key).select("kind", "value", F.col("gender").alias("g"), "attempt")
    # the names that are odd somewhere are few; a name that all documents know alike meets nothing
    mixed = seen.groupBy("kind", "value").agg(F.min("gender").alias("lo"), F.max("gender").alias("hi")).join(known, ["kind", "value"]).where("attempt > 0 OR lo <> hi").select("kind", "value", "g", "attempt")
    odd = stage(mixed, "odd")
    own = seen.join(odd, ["kind", "value"]).where("attempt > 0 OR gender <> g").groupBy("row").agg(F.collect_set(F.struct("kind", "value", F.col("g").alias("gender"), "attempt")).alias("own"))
    own = stage(own, "own")
    tested = among(rows, "row", own.select("row"), own.count())
    passed = tested.where("NOT __q_in").select("doc_id", "text", F.lit(None).cast(own.schema["own"].dataType).alias("own"))
    hit = tested.where("__q_in").join(own, "row", "left").select("doc_id", "text", "own")
    return passed.unionByName(hit).mapInArrow(_replace(key), "doc_id long, n_entities long, text string")
