"""Surrogates for personal data.

Entities found by pattern get keyed replacements of the same type and format.  Numbers,
addresses and tokens are permuted among all values of their shape: digits for digits,
letters of the same script and case for letters, with the country, the kind of card, the
prefix of a token and the validity of a check digit kept.  A permutation maps different
values to different ones and, as it is a step seen through another permutation, no value
to itself, so distinctness holds by construction.  What is permuted is the canonical value,
without case and separators where those mean nothing, so all ways to write an entity agree.

Invented names are drawn by gender and script.  Those draws can collide, so the distinct
names are checked: two that got the same surrogate, or one whose surrogate is a real name,
are drawn again, from more names each time.  Only those exceptions are looked up when the
texts are rewritten.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from emberline.llm.arrow import free, widened
from emberline.scratch import drop, stage

#: exceptions that are handed to every task; more of them are joined to the documents instead
MAX_EXCEPTIONS = 20_000
#: characters that are permuted together
SEGMENT = 48

# Titles by gender, name particles, country calling codes, and syllables and endings of invented names by script.
TITLES = {
    "m": ("Mr", "Mister", "Sir", "Herr", "Monsieur", "Sr", "Señor", "Don", "Signor", "Господин", "господин", "г-н", "Κύριος", "κύριος"),
    "f": ("Mrs", "Ms", "Miss", "Lady", "Frau", "Madame", "Mme", "Mlle", "Sra", "Señora", "Doña", "Signora", "Госпожа", "госпожа", "г-жа", "Κυρία", "κυρία"),
    "n": ("Dr", "Prof", "Professor", "Doctor"),
}
PARTICLES = ("von", "van", "der", "den", "de", "del", "della", "di", "da", "dos", "la", "le", "bin", "al", "zu")
CALLING_1 = ("1", "7")
CALLING_2 = ("20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98")
SYLLABLES = {
    "LATIN": ("ba", "be", "bri", "ca", "co", "da", "del", "do", "el", "fa", "fe", "ga", "gre", "ha", "hol", "is", "ja", "ka", "ko", "la", "len", "lo", "ma", "mi", "mo", "na", "ne", "no", "pa", "pe", "ra", "ro", "sa", "si", "so", "ta", "te", "to", "va", "wi"),
    "CYRILLIC": ("ба", "ве", "га", "да", "де", "жа", "за", "ка", "ко", "ла", "ле", "ма", "ми", "на", "не", "ни", "па", "по", "ра", "ро", "са", "со", "та", "те", "фе", "ша"),
    "GREEK": ("βα", "γα", "δη", "ζα", "θε", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νι", "πα", "πε", "ρα", "ρο", "σα", "στε", "τα", "φι", "χα"),
}
ENDINGS = {
    "LATIN": {"m": ("rd", "n", "s", "k"), "f": ("lia", "na", "ra", "tta"), "n": ("r", "l", "n", "m"), "surname": ("mann", "son", "ley", "ner", "ton", "ski", "rez", "ont")},
    "CYRILLIC": {"m": ("н", "р", "слав"), "f": ("на", "рия", "ла"), "n": ("н", "р", "й"), "surname": ("нов", "рин", "ский", "енко")},
    "GREEK": {"m": ("ρος", "νης", "λος"), "f": ("νη", "ρια", "λα"), "n": ("ρ", "ν", "ξ"), "surname": ("κης", "πουλος", "ίδης", "άκος")},
}

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_TOKEN = r"(?:sk|pk|ghp|gho|xox[bp]|AKIA)[_-]?"
_PATTERN = re.compile(
    rf"(?P<secret>\b(?=[0-9A-Za-z]*[A-Fa-f])(?=[0-9A-Za-z]*\d)(?:[0-9a-f]{{32,}}|[0-9A-F]{{32,}})\b|\b{_TOKEN}[A-Za-z0-9]{{16,}}\b)"
    r"|(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<ip>(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\d.]*\d))"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<phone>(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4})(?![\w-]))"
    r"|(?P<card>(?<![\d.-])\d{4}(?:[ -]\d{4}){3}(?![\d.-]*\d)|(?<![\d.-])\d{13,19}(?![\d-]|\.\d))"
)
_DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
_IP6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}|:)(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
_PASSPORT = re.compile(r"(?i:passport|reisepass|passeport|pasaporte)(?:[ \t]+(?i:no|nr|num|number|nummer|numéro|número))?[.:#]*[ \t]*(?P<passport>[A-Z]{0,2}\d{6,9})(?!\w)")
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TITLED = re.compile(rf"\b(?P<title>{_TITLE}|M(?=\.))(?!\w)\.?[ \t]+(?:[^\W\d_a-z]\.[ \t]*)*(?=[^\W\d_a-z])")
_NEXT = re.compile(rf"[ \t]*(?:(?:{'|'.join(PARTICLES)})[ \t]+)*({_WORD.pattern})")
_JOINT = re.compile(r"(['’-])")
_TRIGGER = re.compile(r"[0-9]")
_COLONS = re.compile(r":[0-9A-Fa-f]{0,4}:")


def _emails(text: str):
    """(start, end) of addresses; a character is looked at once from the next @ on its right, and once from its left."""
    at, floor = text.find("@"), 0
    while at >= 0:
        a, m = at, _DOMAIN.match(text, at + 1)
        if m:
            while a > floor and (text[a - 1].isalnum() or text[a - 1] in "_.+'-"):
                a -= 1
            while a < at and not (text[a].isalnum() or text[a] == "_"):
                a += 1
            if a < at:
                floor = m.end()
                yield a, floor
        floor = max(floor, at + 1)
        at = text.find("@", at + 1)


def _bare(word: str) -> str:
    """A word without a possessive ending."""
    return word[:-2] if word[-2:] in ("'s", "’s") and len(word) > 3 else word


def find_names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, word) of the names that follow a title, and of all other mentions of them in the text.

    A word that the text has in small letters more often than with a capital within a
    sentence is no name but where a title stands.
    """
    known: dict[str, str] = {}
    titles, titled, at = set(), set(), 0
    while m := _TITLED.search(text, at):
        words, at = [], m.end()
        while (n := _NEXT.match(text, at)) and n[1][0].isupper() and n[1] not in _GENDER:
            words.append(_bare(n[1]))
            titled.add(n.start(1))
            at = n.end()
        words = [w for w in words if len(w) > 1]
        titles.add(m["title"])
        for w, kind in zip(words, [f"given_{_GENDER.get(m['title'], 'm')}"] * (len(words) - 1) + ["surname"], strict=False):
            known.setdefault(w.casefold(), kind)
    for t in titles:
        known.pop(t.casefold(), None)
    if not known:
        return []
    out, spoken = [], [(m.start(), _bare(m[0])) for m in _WORD.finditer(text)]
    plain: dict[str, int] = {}
    for start, word in spoken:
        if word in known:
            plain[word] = plain.get(word, 0) + 1
        elif word[0].isupper() and word.casefold() in known and start not in titled and text[max(0, start - 20) : start].rstrip()[-1:] not in ("", ".", "!", "?", ":"):
            plain[word.casefold()] = plain.get(word.casefold(), 0) - 1
    for start, word in spoken:
        kind = known.get(word.casefold()) if word[0].isupper() else None
        if kind and (start in titled or plain.get(word.casefold(), 0) <= 0):
            out.append((start, start + len(word), kind, word))
    return out


def find(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a whole text, in order, without overlaps."""
    text, out = text or "", []
    if "@" in text:
        out += [(a, z, "email", text[a:z]) for a, z in _emails(text)]
    if _TRIGGER.search(text):
        out += [(m.start(), m.end(), m.lastgroup, m.group()) for m in _PATTERN.finditer(text) if m.lastgroup != "card" or _luhn([int(c) for c in m.group() if c.isdigit()]) == 0]
        out += [(*m.span("passport"), "passport", m["passport"]) for m in _PASSPORT.finditer(text)]
        if _COLONS.search(text):
            out += [(m.start(), m.end(), "ip6", m.group()) for m in _IP6.finditer(text) if _address(m.group())]
    out += find_names(text)
    out.sort(key=lambda e: (e[0], -e[1]))
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


def _address(value: str):
    """The IPv6 address that is written, if it has three groups or more."""
    try:
        return ipaddress.IPv6Address(value) if len([g for g in value.split(":") if g]) >= 3 else None
    except ValueError:
        return None


class _Stream:
    """Keyed numbers below a bound, as many as needed."""

    def __init__(self, key: bytes, label: str):
        self.key, self.label, self.at, self.pool = key, label.encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.label + self.at.to_bytes(4, "big"), hashlib.sha256).digest()
            self.at += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % n

    def pick(self, things):
        return things[self.below(len(things))]


def _keyed(key: bytes, label: bytes, turn: int, number: int, below: int) -> int:
    size = (below.bit_length() + 71) // 8
    data = b"%d:%b:%d:%b:%d:%d" % (len(key), key, len(label), label, turn, number)
    return int.from_bytes(hashlib.shake_256(data).digest(size), "big") % below


def _joined(digits: list[int], radices: list[int]) -> tuple[int, int]:
    number, size = 0, 1
    for d, r in zip(digits, radices, strict=True):
        number, size = number * r + d, size * r
    return number, size


def _parted(number: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        number, d = divmod(number, r)
        out.append(d)
    return out[::-1]


def permuted(digits: list[int], radices: list[int], key: bytes, label: str) -> list[int]:
    """A keyed permutation, without fixed points, of all sequences over these radices (2 or more each).

    Four turns of a Feistel network, a keyed step that is never none, and the turns back.  A longer sequence
    goes on segment by segment, the later ones keyed by what stands before them.
    """
    out: list[int] = []
    told = label.encode()
    for at in range(0, len(digits), SEGMENT):
        now, sizes = digits[at : at + SEGMENT], radices[at : at + SEGMENT]
        half = (len(now) + 1) // 2
        (a, u), (b, v) = _joined(now[:half], sizes[:half]), _joined(now[half:], sizes[half:])
        for turn in range(4):
            a = (a + _keyed(key, told, 2 * turn, b, u)) % u
            b = (b + _keyed(key, told, 2 * turn + 1, a, v)) % v
        a = (a + 1 + _keyed(key, told, 8, 0, u - 1)) % u
        for turn in reversed(range(4)):
            b = (b - _keyed(key, told, 2 * turn + 1, a, v)) % v
            a = (a - _keyed(key, told, 2 * turn, b, u)) % u
        out += _parted(a, sizes[:half]) + _parted(b, sizes[half:])
        told = hashlib.sha256(told + repr(now).encode()).digest()
    return out


#: what _alphabet found; a plain dictionary, since functions travel by value and a cache's wrapper does not
_ALPHABETS: dict[str, str] = {}


def _alphabet(c: str) -> str:
    """The characters of the class, case and script of c; empty if it stays."""
    if c not in _ALPHABETS:
        _ALPHABETS[c] = _alphabet_of(c)
    return _ALPHABETS[c]


def _alphabet_of(c: str) -> str:
    if c.isascii():
        return next((x for x in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in x), "")
    if not c.isalpha():
        return ""
    block = ord(c) & ~0x1F
    script = unicodedata.name(c, "").split(" ")[0]
    same = [x for x in map(chr, range(block, block + 32)) if x.isalpha() and not x.isascii() and x.isupper() == c.isupper() and x.islower() == c.islower() and unicodedata.name(x, "").split(" ")[0] == script]
    return "".join(same) if len(same) > 1 else ""


def _shaped(text: str, key: bytes, label: str, alphabet=_alphabet) -> str:
    """Another text of the same shape: each character gives way to one of its alphabet."""
    alphabets = [alphabet(c) for c in text]
    at = [i for i, x in enumerate(alphabets) if x]
    new = permuted([alphabets[i].index(text[i]) for i in at], [len(alphabets[i]) for i in at], key, label)
    out = list(text)
    for i, d in zip(at, new, strict=True):
        out[i] = alphabets[i][d]
    return "".join(out)


def _lower(text: str) -> str:
    return "".join(x if len(x := c.lower()) == 1 else c for c in text)


def _cased(new: str, like: str) -> str:
    """new, in small letters, with capitals where `like` has them."""
    return "".join(u if c.isupper() and len(u := x.upper()) == 1 else x for x, c in zip(new, like, strict=True))


def _filled(value: str, digits) -> str:
    """value with other digits or letters in the places of its own."""
    left = iter(digits)
    return "".join(str(next(left)) if c.isalnum() else c for c in value)


def _luhn(digits: list[int]) -> int:
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10


def _card(value: str, key: bytes) -> str:
    """The first digit stays, and so does how far the last one is from the check digit."""
    digits = [int(c) for c in value if c.isdigit()]
    middle = permuted(digits[1:-1], [10] * (len(digits) - 2), key, f"card {digits[0]} {_luhn(digits)}")
    new = [digits[0], *middle, 0]
    new[-1] = (_luhn(digits) - _luhn(new)) % 10
    return _filled(value, new)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(value: str, key: bytes) -> str:
    plain = value.replace(" ", "")
    country, check, account = plain[:2], int(plain[2:4]), plain[4:]
    off = (check - _iban_check(country, account)) % 100
    new = _shaped(account, key, f"iban {country} {off}")
    return _filled(value, f"{country}{(_iban_check(country, new) + off) % 100:02d}{new}")


def _phone(value: str, key: bytes) -> str:
    """The country code or the leading zeros stay, and what follows is the same number either way."""
    digits = "".join(c for c in value if c.isdigit())
    lead = "0" * (len(digits) - len(digits.lstrip("0")))
    if value.startswith("+") or lead == "00":
        after = digits[len(lead) :]
        lead += after[: 1 if after[:1] in CALLING_1 else 2 if after[:2] in CALLING_2 else 3]
    rest = digits[len(lead) :]
    if len(rest) < 2:
        lead, rest = "", digits
    new = permuted([int(c) for c in rest], [10] * len(rest), key, "phone")
    return _filled(value, [*lead, *new])


def _ip6(value: str, key: bytes) -> str:
    old = f"{int(ipaddress.IPv6Address(value)):032x}"
    new = ipaddress.IPv6Address(int("".join(f"{d:x}" for d in permuted([int(c, 16) for c in old], [16] * 32, key, "ip6")), 16))
    text = str(new) if "::" in value else ":".join(f"{int(g, 16):x}" for g in new.exploded.split(":"))
    return text.upper() if value.upper() == value and value.lower() != value else text


def _script(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "").split(" ")[0]
        if name in SYLLABLES:
            return name
    return "OTHER"


def name_parts(word: str) -> list[str]:
    """The parts of a name that get surrogates of their own: Mary-Jane, O'Neil."""
    return [p for p in _JOINT.split(word) if len(p) > 1]


def _name(part: str, kind: str, key: bytes, attempt: int) -> str:
    role = kind[-1] if kind.startswith("given_") else "surname"
    script = _script(part)
    if script == "OTHER":
        return _shaped(part, key, kind)
    s = _Stream(key, f"{kind}\x00{part.casefold()}\x00{attempt}\x00")
    new = "".join(s.pick(SYLLABLES[script]) for _ in range(3 + s.below(2) + attempt)) + s.pick(ENDINGS[script][role])
    return new.upper() if part.isupper() else new.capitalize()


def surrogate(kind: str, value: str, key: bytes, attempts: dict[tuple[str, str], int] | None = None) -> str:
    """The replacement of one entity.  attempts: the draws that count, by kind and part, of names whose first did not stand."""
    if kind == "surname" or kind.startswith("given_"):
        again = attempts or {}
        return "".join(_name(p, kind, key, again.get((kind, p.casefold()), 0)) if len(p) > 1 else p for p in _JOINT.split(value))
    if kind == "email":
        local, _, domain = _lower(value).rpartition("@")
        host, _, top = domain.rpartition(".")
        return _cased(f"{_shaped(local, key, f'email {domain}')}@{_shaped(host, key, f'domain {top}')}.{top}", value)
    if kind == "ip":
        return ".".join(map(str, permuted([int(x) for x in value.split(".")], [256] * 4, key, "ip")))
    if kind == "secret":
        prefix = re.match(rf"{_TOKEN}(?=[A-Za-z0-9]{{16}})", value)
        if prefix:
            return prefix[0] + _shaped(value[prefix.end() :], key, f"secret {prefix[0]}")
        return _cased(_shaped(value.lower(), key, "secret", lambda c: "0123456789abcdef"), value) if value.upper() != value else _shaped(value.lower(), key, "secret", lambda c: "0123456789abcdef").upper()
    if kind in ("card", "iban", "phone", "ip6"):
        return {"card": _card, "iban": _iban, "phone": _phone, "ip6": _ip6}[kind](value, key)
    return _shaped(value, key, kind)


def rewrite(text: str | None, key: bytes, attempts: dict[tuple[str, str], int]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and (kind, value, surrogate, start) of what was replaced."""
    found, out, at = find(text), [], 0
    if not found:
        return text, []
    told = []
    for a, b, kind, value in found:
        new = surrogate(kind, value, key, attempts)
        out += [text[at:a], new]
        told.append({"kind": kind, "value": value, "surrogate": new, "start": a})
        at = b
    return "".join([*out, text[at:]]), told


def _names(texts) -> set[tuple[str, str]]:
    """(kind, part) of the names of some texts that are drawn."""
    return {(kind, p.casefold()) for t in texts for _, _, kind, word in find_names(t or "") for p in name_parts(word) if _script(p) != "OTHER"}


def _entities(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for b in batches:
            found = _names(t.as_py() for t in b.column(0))
            kinds, values = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(values, pa.string())], ["kind", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, value string").distinct()


def _drawn(entities: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            new = [_name(v, k, key, n).casefold() for k, v, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield b.append_column("surrogate", pa.array(new, pa.string()))

    return entities.mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def exceptions(docs: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """(kind, value, attempt) of the names, part by part, whose first draw did not stand.

    A name loses a draw if its surrogate is a real name, or if a smaller one has the same
    surrogate.  Each attempt draws a syllable more, so there is room for any number of
    names and the draws come to an end.
    """
    entities = stage(_entities(docs, text_col), "entities")
    real = stage(entities.select(F.col("value").alias("real")).distinct(), "real")
    now = stage(_drawn(entities.withColumn("attempt", F.lit(0)), key), "drawn")
    while True:
        owned = now.withColumn("owner", F.concat_ws("\x00", "kind", "value"))
        first = owned.groupBy(F.col("surrogate").alias("s")).agg(F.min("owner").alias("first"), F.max("owner").alias("last")).where("first <> last").select("s", "first")
        clash = owned.join(first, F.col("surrogate") == F.col("s")).where("owner <> first").select("kind", "value")
        taken = now.join(real, now.surrogate == real.real, "left_semi").select("kind", "value")
        losers = stage(clash.unionByName(taken).distinct().withColumn("lost", F.lit(1)), "losers")
        if losers.isEmpty():
            return now.where("attempt > 0").select("kind", "value", "attempt")
        moved = now.join(losers, ["kind", "value"], "left")
        again = moved.where("lost IS NOT NULL").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        kept = moved.where("lost IS NULL").select("kind", "value", "attempt", "surrogate")
        new = stage(kept.unionByName(_drawn(again, key)), "drawn")
        drop(now), drop(losers)
        now = new


FOUND = "array<struct<kind:string,value:string,surrogate:string,start:int>>"


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with surrogates in the text and a column found (kind, value, surrogate, start).

    Whole texts are searched and rewritten, in time in proportion to their length.  Null
    and empty texts stay as they are; found is then empty.  A column of docs named found
    is replaced; repeated rows give equal rows, and other columns pass through.  A
    surrogate of a number, address or token may be a real value of somebody else, which
    is then replaced as well; an invented name is never a name that docs has.
    """
    secret = key.encode()
    few = stage(exceptions(docs, secret, text_col), "exceptions")
    docs = docs.drop("found")
    out = widened(docs, f"found {FOUND}")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string()), ("start", pa.int32())]))

    again, text_key, k = free(docs, "_again", "_text_key", "_k")

    def run(batches, known):
        for b in batches:
            at = b.schema.get_field_index(text_col)
            extra = b.column(b.schema.get_field_index(again)).to_pylist() if again in b.schema.names else None
            done = [rewrite(t.as_py(), secret, known if extra is None else {(e["kind"], e["value"]): e["attempt"] for e in extra[i] or ()}) for i, t in enumerate(b.column(at))]
            b = b.set_column(at, text_col, pa.array([t for t, _ in done], pa.string()))
            if extra is not None:
                b = b.remove_column(b.schema.get_field_index(again))
            yield b.append_column("found", pa.array([f for _, f in done], kind))

    if few.count() <= MAX_EXCEPTIONS:
        known = {(r["kind"], r["value"]): r["attempt"] for r in few.collect()}
        return docs.mapInArrow(lambda batches: run(batches, known), out)
    # too many to hand out: each text gets the exceptions among its own names
    keyed = docs.withColumn(text_key, F.sha2(F.col(text_col), 256))

    def mentions(batches):
        for b in batches:
            rows = [{"_k": k, "kind": kd, "value": v} for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for kd, v in _names([t])]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("_k", pa.string()), ("kind", pa.string()), ("value", pa.string())]))

    said = keyed.select(text_key, text_col).mapInArrow(mentions, "_k string, kind string, value string").distinct()
    own = said.join(few, ["kind", "value"]).groupBy("_k").agg(F.collect_list(F.struct("kind", "value", "attempt")).alias(again)).withColumnRenamed("_k", k)
    joined = keyed.join(own, F.col(text_key) == F.col(k), "left").drop(text_key, k)
    return joined.mapInArrow(lambda batches: run(batches, {}), out)
