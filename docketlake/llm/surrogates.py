"""Surrogates for personal data: keyed, type-consistent, one-to-one.

An entity's free symbols (digits, letters by script, case and vowel class, hexadecimal digits) are
read as one mixed-radix number; a keyed shift inside a keyed Feistel permutation of that number
range gives another value of the same form. The map is one-to-one for each form and never the
identity where a form has two values or more, so distinct entities stay distinct and the same
entity has the same surrogate everywhere. A name keeps its script, its capitals, its shape of
vowels and consonants and its last letter, which carries gender in many names (in the alphabets
listed; letters of other scripts, the last one too, become letters of the same script nearby); a
card number or IBAN keeps its check-digit state, so valid ones stay valid; an IP address stays in its range (private, loopback,
link-local, multicast, public and so on); separators, country codes and top-level domains stay.

A name is found after a title. Every other mention of it in the same document, whole or by one of
its words, is replaced too, and each word has one surrogate. Names without any title in their
document are not found.

The distinct entities of the corpus are checked for collisions before any text is rewritten; a
collision changes the tweak and is checked again. Whoever has the key can undo the map, so it is a
required parameter and belongs in a secret store; ``op8_surrogates`` uses a test key unless
``docketlake.surrogates.key`` is set in the session.

Defined cases: null text stays null, empty stays empty, both have no entities; repeated rows get
equal results; overlapping candidates go to the earlier kind in ``KINDS``; an entity without a symbol
that can change is left and not counted; very long texts are read whole, in time that grows with
their length; an empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table, written
from .wordblocks import slices

QUERY_KEY = b"a test key, known to everyone"
_TITLES = r"(?:Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Madam|Herr|Frau|Monsieur|Madame|Mme|Mlle|Señor|Señora|Sr|Sra|Don|Doña|Г-н|Г-жа)"
KINDS = {
    "email": r"(?<![^\W_])[^\W_][\w.+%-]{0,63}@(?:[^\W_][\w-]{0,62}\.)+[^\W\d_]{2,63}",
    "secret": r"(?<![0-9A-Fa-f])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Fa-f])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])",
    "name": rf"\b{_TITLES}\.? (?P<who>[^\W\d_a-zà-ÿа-я][^\W\d_]+(?:[ -][^\W\d_a-zà-ÿа-я][^\W\d_]+)?)",
}
FINDER = re.compile("|".join(f"(?P<{k}>{p})" for k, p in KINDS.items()))
#: without a word boundary: rows stand side by side in a block, and bytes have none before Cyrillic
_TITLE_BYTES = re.compile(rf"{_TITLES}\.? ".encode())
REACH = 80

# alphabets of the free symbols, in natural order
_LATIN_VOWELS = "aeiou"
_LATIN_OTHERS = "bcdfghjklmnpqrstvwxyz"
_ACCENTED_VOWELS = "àáâäèéêëìíîïòóôöùúûü"
_ACCENTED_OTHERS = "çñß"
_CYRILLIC_VOWELS = "аеиоуыэюя"
_CYRILLIC_OTHERS = "бвгджзклмнпрстфхцчшщ"
_GREEK_VOWELS = "αεηιουω"
_GREEK_OTHERS = "βγδζθκλμνξπρστφχψ"
_CLASSES = [_LATIN_VOWELS, _LATIN_OTHERS, _ACCENTED_VOWELS, _ACCENTED_OTHERS, _CYRILLIC_VOWELS, _CYRILLIC_OTHERS, _GREEK_VOWELS, _GREEK_OTHERS]
_ALPHABET = {c: a for a in _CLASSES for c in a} | {c.upper(): a.upper() for a in _CLASSES for c in a if len(c.upper()) == 1}
_DIGITS, _HEX, _HEX_UP = "0123456789", "0123456789abcdef", "0123456789ABCDEF"


@lru_cache(maxsize=65_536)
def _alphabet(c: str) -> str | None:
    """The letters that ``c`` may become: its class, or else its script's letters in the same 64 codes."""
    if c in _ALPHABET or not c.isalpha():
        return _ALPHABET.get(c)

    def kind(x: str) -> tuple[str, str]:
        return unicodedata.category(x), unicodedata.name(x, "").split(" ")[0].split("-")[0]

    first = ord(c) & ~63
    return "".join(x for x in map(chr, range(first, first + 64)) if kind(x) == kind(c) and x not in _ALPHABET)


def _round(key: bytes, tweak: bytes, i: int, value: int, modulus: int) -> int:
    size = (modulus.bit_length() + 7) // 8 + 8
    seed = tweak + bytes([i]) + value.to_bytes((value.bit_length() + 7) // 8 or 1, "big")
    return int.from_bytes(hashlib.shake_256(hmac.digest(key, seed, "sha256")).digest(size), "big") % modulus


def _permute(x: int, n: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(n): Feistel rounds over a product a*b >= n, walked into range."""
    a = 1
    while a * a < n:
        a <<= 1
    if a > 4096:
        a = 1 << ((n - 1).bit_length() + 1) // 2
    while True:
        left, right = divmod(x, a)
        for i in range(7, -1, -1) if back else range(8):
            if back:
                left, right = (right - _round(key, tweak, i, left, a)) % a, left
            else:
                left, right = right, (left + _round(key, tweak, i, right, a)) % a
        x = left * a + right
        if x < n:
            return x


def _shift(x: int, n: int, key: bytes, tweak: bytes) -> int:
    """One-to-one on range(n) and without fixed points for n > 1."""
    if n < 2:
        return x
    step = 1 + _round(key, tweak, 255, n, n - 1)
    return _permute((_permute(x, n, key, tweak) + step) % n, n, key, tweak, back=True)


def _recode(text: str, alphabets: list[str | None], key: bytes, tweak: bytes) -> str:
    free = [(i, a) for i, a in enumerate(alphabets) if a and len(a) > 1]
    number, n = 0, 1
    for i, a in free:
        number = number * len(a) + a.index(text[i])
        n *= len(a)
    form = "".join(a[0] if a else "." for a in alphabets).encode()
    number = _shift(number, n, key, tweak + hashlib.sha256(form).digest()[:8])
    out = list(text)
    for i, a in reversed(free):
        number, k = divmod(number, len(a))
        out[i] = a[k]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit that makes ``digits`` + it valid."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def _mod97(iban: str) -> int:
    """Remainder of an IBAN, its first four signs moved to the end; 1 for a valid one."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _checked(bare: str) -> int:
    """The check number that makes an IBAN (without blanks) valid."""
    return 98 - _mod97(bare[:2] + "00" + bare[4:])


#: address ranges of a purpose of their own (first address, bits of the network), in order
IP_CLASSES = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4)]


def _address(text: str) -> int:
    number = 0
    for part in text.split("."):
        number = number << 8 | int(part)
    return number


_RANGES = [(_address(a), 1 << (32 - bits)) for a, bits in IP_CLASSES]


def _moved(number: int, key: bytes, tweak: bytes) -> int:
    """Another address of the same range, or of the public ones."""
    for start, size in _RANGES:
        if start <= number < start + size:
            return start + _shift(number - start, size, key, tweak + start.to_bytes(4, "big"))
    below = sum(size for start, size in _RANGES if start < number)
    number = _shift(number - below, (1 << 32) - sum(size for _, size in _RANGES), key, tweak)
    for start, size in _RANGES:
        if number >= start:
            number += size
    return number


def surrogate(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The replacement of an entity; the same for the same kind, value, key and attempt."""
    tweak = f"{kind}/{attempt}/".encode()
    if kind in ("secret",):
        return _recode(value, [_HEX if value == value.lower() else _HEX_UP] * len(value), key, tweak)
    if kind == "ip":
        number = _moved(_address(value), key, tweak)
        return ".".join(str(number >> s & 255) for s in (24, 16, 8, 0))
    if kind in ("card", "ssn", "phone"):
        prefix = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        head = len(prefix[0]) if prefix else 0
        body = "".join(c for c in value[head:] if c.isdigit())
        if kind == "card":
            off = (int(body[-1]) - _luhn(body[:-1])) % 10
            new = _recode(body[:-1], [_DIGITS] * (len(body) - 1), key, tweak)
            new += str((_luhn(new) + off) % 10)
        else:
            new = _recode(body, [_DIGITS] * len(body), key, tweak)
        digits = iter(new)
        return value[:head] + "".join(next(digits) if c.isdigit() else c for c in value[head:])
    if kind == "email":
        local, _, domain = value.rpartition("@")
        site, dot, top = domain.rpartition(".")
        return "@".join(_word(x, key, tweak + p, False) for x, p in ((local, b"l"), (site, b"d"))) + dot + top
    if kind == "iban":
        keep = 4
        marks = [None] * keep + [_DIGITS if c.isdigit() else _alphabet(c) for c in value[keep:]]
        new = _recode(value, marks, key, tweak)
        # as far from its right check number as before: valid ones stay valid
        off = int(value[2:4]) - _checked(value.replace(" ", ""))
        return f"{new[:2]}{(_checked(new.replace(' ', '')) + off) % 100:02d}{new[4:]}"
    return " ".join(_word(part, key, tweak, True) for part in value.split(" "))


def _word(text: str, key: bytes, tweak: bytes, keep_last: bool) -> str:
    """Letters by class and digits; case is put back, so spellings that differ in case agree."""
    low = text.lower() if len(text.lower()) == len(text) else text
    marks: list[str | None] = [_DIGITS if c in _DIGITS else _alphabet(c) for c in low]
    if keep_last and len(marks) > 2 and low[-1] in _ALPHABET:
        marks[-1] = None
    new = _recode(low, marks, key, tweak)
    return "".join(n.upper() if o != lo and len(n.upper()) == 1 else n for o, lo, n in zip(text, low, new))


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value) without overlaps, in order."""
    for m in FINDER.finditer(text):
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m.group(k) is not None)
        group = "who" if kind == "name" else kind
        yield m.start(group), m.end(group), kind, m.group(group)


def mentions(text: str, people: set[str], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(start, end, value) in bytes of the names given, or words of them, outside the stretches ``taken``."""
    spellings = {x for name in people for x in (name, *name.split(" "))}
    spellings |= {x.upper() for x in spellings if len(x.upper()) == len(x)}
    begins = {_FIRST.match(x)[0] for x in spellings}
    starts, ends = [a for a, _ in taken], [b for _, b in taken]
    seen = at = 0
    for m in _FIRST.finditer(text):
        if m.start() < seen or m[0] not in begins:
            continue
        more = _SECOND.match(text, m.end())  # a name has two words at most
        value = text[m.start() : more.end()] if more and text[m.start() : more.end()] in spellings else m[0]
        if value not in spellings:
            continue
        left = at + len(text[seen : m.start()].encode())
        seen, at = m.start() + len(value), left + len(value.encode())
        if bisect.bisect_right(ends, left) == bisect.bisect_left(starts, at):
            yield left, at, value


_FIRST, _SECOND = re.compile(r"\w+"), re.compile(r"[ -]\w+")


def canonical(kind: str, value: str) -> str:
    """Spellings of one entity."""
    if kind in ("card", "ssn", "phone"):
        head = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        return (head[0] if head else "") + "/" + "".join(c for c in value[len(head[0]) if head else 0 :] if c.isdigit())
    return value.lower() if kind in ("email", "name") else value


def _windows(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, from, to) of the stretches that can have an entity: those around a digit, an at sign or
    a title, widened to blanks by ``REACH`` bytes at least and joined where they touch."""
    body = data.tobytes()
    marks = np.flatnonzero(((data >= 48) & (data <= 57)) | (data == 64))
    titles = np.array([m.start() for m in _TITLE_BYTES.finditer(body)], np.int64)
    marks = np.sort(np.concatenate([marks, titles]))
    if not len(marks):
        return []
    blanks = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.concatenate([[-1], blanks, [len(data)]])
    row = np.searchsorted(offsets, marks, "right") - 1
    lo = edge[np.searchsorted(edge, marks - REACH, "right") - 1] if len(edge) else marks
    lo = np.where(marks - REACH < 0, 0, np.maximum(lo + 1, 0))
    hi = edge[np.minimum(np.searchsorted(edge, marks + REACH, "left"), len(edge) - 1)]
    lo, hi = np.maximum(lo, offsets[row]), np.minimum(hi, offsets[row + 1])
    out: list[tuple[int, int, int]] = []
    for r, a, b in zip(row.tolist(), lo.tolist(), hi.tolist()):
        if out and out[-1][0] == r and a <= out[-1][2]:
            out[-1] = (r, out[-1][1], max(b, out[-1][2]))
        else:
            out.append((r, a, b))
    return out


def _stretches(column: pa.Array) -> Iterator[tuple[int, int, int, str]]:
    """(row, from, to, text) of the windows of a column; positions are bytes in the row's text."""
    for first, data, offsets in slices(column):
        for row, a, b in _windows(data, offsets):
            at = int(offsets[row])
            yield first + row, a - at, b - at, data[a:b].tobytes().decode("utf-8", "replace")


def found_entities(docs: DataFrame) -> DataFrame:
    """Distinct (kind, value) of each Arrow batch; a value may come from several batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = {(k, canonical(k, v)) for *_, t in _stretches(batch.column("text")) for _, _, k, v in entities(t)}
            got = sorted(got | {(k, word) for k, v in got if k == "name" for word in v.split(" ")})
            yield pa.RecordBatch.from_arrays([pa.array([g[j] for g in got], pa.string()) for j in range(2)], ["kind", "value"])

    made = docs.select("text").mapInArrow(run, "kind string, value string")
    return made.repartition(partitions(docs.sparkSession), "kind", "value").distinct()


def collisions(found: DataFrame, key: bytes, attempt: int = 0) -> DataFrame:
    """Surrogates that stand for two entities or more: (kind, surrogate, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = batch.column("kind").to_pylist(), batch.column("value").to_pylist()
            new = []
            for k, v in zip(kinds, values):
                head, _, digits = v.rpartition("/")
                new.append(canonical(k, head + " " * bool(head) + surrogate(k, digits, key, attempt)) if k in ("card", "ssn", "phone") else canonical(k, surrogate(k, v, key, attempt)))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(new, pa.string())], ["kind", "surrogate"])

    made = found.repartition(partitions(found.sparkSession)).mapInArrow(run, "kind string, surrogate string")
    return made.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def replace_entities(docs: DataFrame, key: bytes, attempts: int = 4) -> DataFrame:
    """(doc_id, text, n_entities, kinds) with every entity replaced."""
    found = written(found_entities(docs), "entities")
    for attempt in range(attempts):
        if not collisions(found, key, attempt).take(1):
            break
    else:
        raise RuntimeError("surrogates collide under every tweak")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[tuple[int, int, str, str]]] = {}
            people: dict[int, set[str]] = {}
            for row, start, _, text in _stretches(batch.column("text")):
                for a, b, kind, value in entities(text):
                    left, right = start + len(text[:a].encode()), start + len(text[:b].encode())
                    parts.setdefault(row, []).append((left, right, kind, value))
                    if kind == "name":
                        people.setdefault(row, set()).add(value)
            changed: dict[int, tuple[str, list[str]]] = {}
            for row, cuts in parts.items():
                body, at, out = batch.column("text")[row].as_buffer().to_pybytes(), 0, []
                if row in people:
                    taken = [(a, b) for a, b, *_ in cuts]
                    cuts = sorted([*cuts, *((a, b, "name", v) for a, b, v in mentions(body.decode(), people[row], taken))])
                kinds = []
                for a, b, kind, value in cuts:
                    new = surrogate(kind, value, key, attempt)
                    if new != value:
                        kinds.append(kind)
                    out += [body[at:a], new.encode()]
                    at = b
                changed[row] = (b"".join([*out, body[at:]]).decode("utf-8", "replace"), kinds)
            n = range(batch.num_rows)
            mask = pa.array([i in changed for i in n], pa.bool_())
            new = pa.array([changed[i][0] for i in sorted(changed)], pa.string())
            text = pa.compute.replace_with_mask(batch.column("text").cast(pa.string()), mask, new)
            kinds = [changed[i][1] if i in changed else [] for i in n]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), text, pa.array([len(k) for k in kinds], pa.int64()), pa.array([sorted({*k}) for k in kinds], pa.list_(pa.string()))],
                ["doc_id", "text", "n_entities", "kinds"],
            )

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, text string, n_entities long, kinds array<string>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("docketlake.surrogates.key", None)
    return replace_entities(table(spark, sf_dir, "documents"), key.encode() if key else QUERY_KEY)
