"""Personal data: detection and keyed surrogates.

Detected: e-mail addresses, phone numbers, payment cards, IPv4 addresses, social security numbers, IBANs,
access keys, long hexadecimal secrets, and person names. A name is found after a title ("Dr Kim Lee"), after
words that announce one ("my name is", "signed by", "Name:"), before an address in angle brackets, where its
words are the parts of an e-mail address in the same document, or where one of the given names of the surrogate
pool stands before a capitalised word. A name without any of these stays: nothing here knows all names. A name
counts as its parts, so that "Anna Lee" and "Ms Lee" keep their common part; a part found in a document is
replaced wherever the document has it.

An entity is a kind and a normal form; titles are not part of it, so "Dr Kim Lee" and "Ms Kim Lee" are one person.
A surrogate keeps type and format. All but name parts run through a keyed permutation of the strings of
their shape (a Feistel network over mixed radices: a digit stays a digit, a capital a capital, signs stay
where they are, letters keep script and case), with check digits made anew; so different originals of a
shape have different surrogates. What that leaves as it is gets a keyed draw instead. The domain of an e-mail
address can name an employer: it gets a surrogate too, the same in all its addresses, unless it is a public mail
provider's or reserved for examples; the top level stays. Latin and Cyrillic name parts are drawn by a keyed hash
from lists by script and gender, and from composed names after that; those in other scripts are permuted letter
by letter in their script. The gender is that of the given name or of the titles it has anywhere in the corpus; a Cyrillic
family name that ends in a vowel of the feminine gets one that does. The text as found is spelled like the
mention: case and separators are the mention's.

Collision checks run over all entities of the corpus: an entity whose surrogate is a real entity, is another
entity's surrogate too, or is of the wrong gender takes its next surrogate, until no clash is left; after some
attempts the next is longer than the entity, as short shapes may have no free string. A round handles what is
still open, against all that is settled. The entities with other than their first surrogate are joined to
the texts that have them, by a 128-bit hash of the text; everything else needs no join.

Defined cases: null text stays null; empty text has no entities; null and repeated ids do not matter, as nothing is
joined by id; columns other than the text are kept as they are, except an ``n_entities``, which is replaced. The key
must not be empty.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.llm.common import appended, forget, id_columns, let_go, scratch, written

#: fixed values: given names by script and gender, family names by script
GIVEN = {
    ("latin", "f"): "Anna Clara Elena Greta Irene Julia Laura Maria Nora Paula Rosa Sofia".split(),
    ("latin", "m"): "Adam Bruno David Erik Felix Hugo Jonas Lukas Martin Oscar Paul Simon".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Иван Максим Олег Павел".split(),
}
FAMILY = {
    "latin": "Abel Brandt Carter Duval Ferrer Graham Hansen Keller Lorenz Moreno Novak Olsen Porter Romero Sander Thomas Vidal Weber".split(),
    "cyrillic": "Белов Волков Громов Зайцев Козлов Лебедев Морозов Орлов Соколов Титов".split(),
}
#: fixed values: words that announce a name
ANNOUNCED = ("my name is", "name is", "name:", "signed by", "signed,", "sincerely,", "regards,", "author:", "from:", "contact:", "attn:", "mi nombre es", "me llamo", "je m'appelle", "nom :", "nom:", "nombre:", "ich heiße", "mein name ist", "gezeichnet:", "меня зовут", "имя:")
#: fixed values: domains that tell nothing of an employer
PROVIDERS = frozenset("gmail.com googlemail.com yahoo.com outlook.com hotmail.com live.com icloud.com aol.com gmx.de gmx.net web.de mail.ru yandex.ru proton.me protonmail.com orange.fr free.fr".split())
RESERVED = ("example", "test", "invalid", "localhost")
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Señor": "m", "Monsieur": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Señora": "f", "Madame": "f", "Mme": "f", "Dr": "u", "Prof": "u", "Господин": "m", "Госпожа": "f"}
SYLLABLES = {"latin": "ba den far gol hem kir lan mor nel por ras sen tul var wen zim".split(), "cyrillic": "ба вен гор дар зим кол лан мор нел пор рас тул".split()}

EMAIL = re.compile(r"[^\W_](?:[\w.+%-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}")
#: all that may be in an address, number or card, however long: numbers side by side are one run
DIGITS = re.compile(r"[+(]?\d[\d +().\-]{5,}\d")
IP = re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<!\w)(?:\d[ -]?){12,18}\d(?!\w)")
PHONE = re.compile(r"(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})|\(\d{2,4}\)|\d{3}(?=[.-]))(?:[ .-]?\d{2,4}){2,4}(?!\w)")
HEX = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])")
KEY = re.compile(r"(?<![0-9A-Za-z])(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?!\w)")
NAME = re.compile(r"\b(?:(" + "|".join(TITLES) + r")\.? )?((?:[^\W\d_]|[-'])+)(?: ((?:[^\W\d_]|[-'])+))?")
GENDER = {n: g for (_, g), names in GIVEN.items() for n in names}
TOLD = {n.casefold(): g for n, g in GENDER.items()}
LONGEST = 37  # characters of a card or phone at most
_WORD = re.compile(r"\w")
_ANNOUNCED = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, ANNOUNCED)) + r")\s+", re.IGNORECASE)
_LETTERS = re.compile(r"[^\W\d_]+")
#: one or two capitalised words before an address in angle brackets
_SHOWN = re.compile(r"(?<!\w)([^\W\d_][\w'-]*(?: [^\W\d_][\w'-]*)?) <(?=[^\s<>]+@)")
_TITLE = re.compile(r"\b(?:" + "|".join(TITLES) + r")\b")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    text: str
    norm: str


def _luhn(digits: str) -> int:
    """The digit that completes ``digits`` to a valid number."""
    total = sum(sum(divmod(int(c) * (2 - k % 2), 10)) for k, c in enumerate(reversed(digits)))
    return -total % 10


def _iban_check(country: str, rest: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


@lru_cache(maxsize=4096)
def _script(word: str) -> str:
    """``latin``, ``cyrillic``, or the script's name as the character names have it."""
    for c in word:
        if c.isalpha():
            return unicodedata.name(c, "other").split(" ")[0].lower()
    return "other"


def _starts(text: str) -> set[int]:
    """Where a name may begin."""
    spots = {m.start() for m in _TITLE.finditer(text)} if any(t in text for t in TITLES) else set()
    if any(c in text.casefold() for c in ANNOUNCED):
        spots |= {m.end() for m in _ANNOUNCED.finditer(text)}
    if "@" in text:
        if " <" in text:
            spots |= {m.start(1) for m in _SHOWN.finditer(text)}
        # the words of first.last@domain, where they stand side by side
        for m in EMAIL.finditer(text):
            parts = _LETTERS.findall(m[0].rpartition("@")[0])
            if len(parts) == 2 and min(map(len, parts)) > 1:
                spots |= {x.start() for x in re.finditer(rf"(?<![\w@.]){parts[0]} {parts[1]}(?![\w@])", text, re.IGNORECASE)}
    return spots


def _name_parts(text: str) -> Iterator[tuple[Mention, str]]:
    """Name parts, each with the gender that its given name or title tells."""
    sure = _starts(text)
    spots = set(sure)
    for given in GENDER.keys() & set(_LETTERS.findall(text)):
        spots |= {m.start() for m in re.finditer(rf"\b{given}\b", text)}
    done = -1
    for at in sorted(spots):
        if at <= done or not (m := NAME.match(text, at)):
            continue
        title, one, two = m.groups()
        first_up, second_up = _capital(one), bool(two) and _capital(two) and two not in TITLES
        if not first_up or one in TITLES or at not in sure and not second_up:
            continue
        gender = GENDER.get(one) or TITLES.get(title or "", "u")
        if second_up:
            yield Mention(m.start(2), m.end(2), f"given-{_script(one)}", one, one.casefold()), gender
            yield Mention(m.start(3), m.end(3), f"family-{_script(two)}", two, two.casefold()), gender
            done = m.end(3)
        else:
            kind = "given" if one in GENDER else "family"
            yield Mention(m.start(2), m.end(2), f"{kind}-{_script(one)}", one, one.casefold()), gender
            done = m.end(2)


def _capital(word: str) -> bool:
    """A capital first, or a letter of a script without capitals."""
    return word[:1].isupper() or word[:1].lower() == word[:1].upper()


def _apart(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Of spans (start, end, digits) those apart from each other that have most digits in all; of equals the fewest."""
    spans = sorted(spans, key=lambda x: (x[1], x[0]))
    ends = [b for _, b, _ in spans]
    best: list[tuple] = [(0, 0, None)]  # digits, spans (negative), the last span and what is before it
    for i, (a, b, n) in enumerate(spans):
        digits, count, before = best[bisect_right(ends, a, 0, i)]
        best.append(max(best[i], (digits + n, count - 1, ((a, b), before)), key=lambda x: x[:2]))
    chosen, chain = [], best[-1][2]
    while chain:
        at, chain = chain
        chosen.append(at)
    return chosen[::-1]


def _valid(kind: str, digits: str) -> bool:
    if kind == "card":
        return digits[0] in "3456" and (_luhn(digits[:-1]) == int(digits[-1]) or len(digits) == 16)
    return 8 <= len(digits) <= 15


def _candidates(kind: str, pattern: re.Pattern, part: str) -> Iterator[tuple[int, int, int]]:
    """Every start and end at which ``part`` has a valid number, so that no neighbour can spoil one."""
    at = 0
    while m := pattern.search(part, at):
        a = m.start()
        for b in range(a + 8, min(a + LONGEST, len(part)) + 1):
            if part[b - 1].isdigit() and not _WORD.match(part, b) and pattern.fullmatch(part, a, b):
                digits = re.sub(r"\D", "", part[a:b])
                if _valid(kind, digits):
                    yield a, b, len(digits)
        at = a + 1


def _numbers(text: str, taken: list[tuple[int, int]]) -> Iterator[Mention]:
    """IPv4 addresses, social security numbers, cards and phones, each in what the kinds before it leave."""
    for run in DIGITS.finditer(text):
        first = max(run.start() - 1, 0)
        part = text[first : run.end() + 1]  # with the characters around it, which the patterns look at
        for a, b in taken:
            if a < run.end() and b > first:
                a, b = max(a - first, 0), min(b - first, len(part))
                part = part[:a] + "_" * (b - a) + part[b:]
        for kind, pattern in (("ip", IP), ("ssn", SSN), ("card", CARD), ("phone", PHONE)):
            spans = [m.span() for m in pattern.finditer(part)] if kind in ("ip", "ssn") else _apart(list(_candidates(kind, pattern, part)))
            for a, b in spans:
                yield Mention(first + a, first + b, kind, part[a:b], part[a:b] if kind == "ip" else re.sub(r"\D", "", part[a:b]))
                part = part[:a] + "_" * (b - a) + part[b:]


def detect(text: str | None) -> list[Mention]:
    """The mentions of a text, in order and apart from each other."""
    return detect_with_gender(text)[0]


def detect_with_gender(text: str | None) -> tuple[list[Mention], dict[tuple[str, str], str]]:
    """The mentions, and the gender told of name parts by (kind, normal form): f, m or u."""
    if not text:
        return [], {}
    found: list[Mention] = []
    if "@" in text:
        found += [Mention(m.start(), m.end(), "email", m[0], m[0].lower()) for m in EMAIL.finditer(text)]
    found += [Mention(m.start(), m.end(), "secret", m[0], m[0]) for m in HEX.finditer(text)]
    if "AKIA" in text or "ASIA" in text:
        found += [Mention(m.start(), m.end(), "key", m[0], m[0]) for m in KEY.finditer(text)]
    for m in IBAN.finditer(text):
        bare = m[0].replace(" ", "")
        if _iban_check(bare[:2], bare[4:]) == bare[2:4]:
            found.append(Mention(m.start(), m.end(), "iban", m[0], bare))
    found += _numbers(text, [(m.start, m.end) for m in found])
    told = list(_name_parts(text))
    names = [m for m, _ in told]
    genders: dict[tuple[str, str], str] = {}
    for m, g in told:  # f before m before u
        genders[m.kind, m.norm] = min(g, genders.get((m.kind, m.norm), "u"))
    found += names
    # a part stands for the same person wherever it is in the document, without a title too
    if bare := {m.text: m.kind for m in reversed(names) if len(m.text) > 1}:
        parts = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(bare, key=len, reverse=True))) + r")(?!\w)")
        found += [Mention(m.start(), m.end(), bare[m[0]], m[0], m[0].casefold()) for m in parts.finditer(text)]
    order = {k: i for i, k in enumerate(("email", "key", "iban", "secret", "ip", "ssn", "card", "phone"))}
    found.sort(key=lambda x: (order.get(x.kind, 9), x.start))
    taken: list[Mention] = []
    used: list[tuple[int, int]] = []
    for m in found:
        if all(m.end <= a or m.start >= b for a, b in used):
            taken.append(m)
            used.append((m.start, m.end))
    return sorted(taken, key=lambda x: x.start), genders


#: attempts within an entity's own shape; later ones are from wider and wider shapes, which no corpus fills
WALKS = 8
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ")


@lru_cache(maxsize=65536)
def _alphabet(c: str) -> str:
    """The letters or digits that may stand for ``c``: its class, or what is of its script, case and 256 code points; maybe none."""
    for a in CLASSES:
        if c in a:
            return a
    if not c.isalnum():
        return ""
    trait = lambda x: (unicodedata.category(x), unicodedata.name(x, "").split(" ")[0])
    steady = lambda x: x.isalnum() and len(x.lower()) == 1 and len(x.upper()) == 1 and x in (x.lower(), x.lower().upper()) and x.lower() == x.upper().lower()
    near = map(chr, range(ord(c) & ~0xFF, (ord(c) | 0xFF) + 1))
    a = "".join(x for x in near if trait(x) == trait(c) and steady(x) and not any(x in k for k in CLASSES))
    return a if c in a and len(a) > 1 else ""


class Surrogates:
    def __init__(self, key: bytes) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _draw(self, *parts: object) -> int:
        return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, parts)).encode(), key=self.key, digest_size=16).digest())

    def permute(self, kind: str, symbols: str, alphabets: list[str]) -> str:
        """A keyed permutation of the strings whose i-th character is from ``alphabets[i]``."""
        if not symbols:
            return symbols
        middle = (len(symbols) + 1) // 2
        sizes = [1, 1]
        values = [0, 0]
        for i, (c, a) in enumerate(zip(symbols, alphabets, strict=True)):
            k = i >= middle
            values[k], sizes[k] = values[k] * len(a) + a.index(c), sizes[k] * len(a)
        shape = (kind, *alphabets)
        for r in range(10):
            k = r % 2
            values[k] = (values[k] + self._draw("round", r, *shape, values[1 - k])) % sizes[k]
        out = []
        for i in reversed(range(len(symbols))):
            k, a = i >= middle, alphabets[i]
            values[k], at = divmod(values[k], len(a))
            out.append(a[at])
        return "".join(reversed(out))

    def _shape(self, kind: str, text: str, free: str | None = None) -> str:
        """Permute letters and digits where they stand; ``free``: one alphabet for all of them."""
        at = [(i, a) for i, c in enumerate(text) if (a := (free if c in free else "") if free else _alphabet(c))]
        got = iter(self.permute(kind, "".join(text[i] for i, _ in at), [a for _, a in at]))
        chosen = {i for i, _ in at}
        return "".join(next(got) if i in chosen else c for i, c in enumerate(text))

    def _once(self, kind: str, norm: str) -> str:
        if kind == "email":
            local, _, domain = norm.rpartition("@")
            head, dot, zone, top = self._domain(domain)
            made = self._shape(kind, f"{local}@{head}" if dot else local)
            return f"{made}{dot}{zone}.{top}" if dot else f"{made}@{zone}.{top}"
        if kind == "ip":
            octets = norm
            while True:  # walk on to the next address that is written alike: no octet of 0 or over 254
                value = int.from_bytes(bytes(map(int, octets.split("."))))
                low, high = value & 0xFFFF, value >> 16
                for r in range(6):
                    low, high = high, (low + self._draw("ip", r, high)) & 0xFFFF
                octets = ".".join(str(b) for b in ((high << 16) | low).to_bytes(4))
                if all(1 <= int(b) <= 254 for b in octets.split(".")) or not all(1 <= int(b) <= 254 for b in norm.split(".")):
                    return octets
        if kind == "card":
            body, valid = norm[1:-1], _luhn(norm[:-1]) == int(norm[-1])
            if valid:
                made = norm[0] + self.permute(kind, body, ["0123456789"] * len(body))
                return made + str(_luhn(made))
            return norm[0] + self.permute("other card", norm[1:], ["0123456789"] * (len(norm) - 1))
        if kind == "iban":
            rest = self._shape(kind, norm[4:])
            return norm[:2] + _iban_check(norm[:2], rest) + rest
        if kind == "key":
            return norm[:4] + self._shape(kind, norm[4:], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        if kind == "secret":
            return self._shape(kind, norm, "0123456789abcdef" if norm.lower() == norm else "0123456789ABCDEF")
        if kind == "phone" and len(norm) > 10:  # the country code stays
            cut = len(norm) - 10
            return norm[:cut] + self.permute(kind, norm[cut:], ["0123456789"] * 10)
        return self.permute(kind, norm, ["0123456789"] * len(norm))

    def _domain(self, domain: str) -> tuple[str, str, str, str]:
        """What is before the registered name, its dot, the registered name's surrogate, the top level."""
        name, _, top = domain.rpartition(".")
        head, dot, zone = name.rpartition(".")
        if f"{zone}.{top}" not in PROVIDERS and zone not in RESERVED and top not in RESERVED:
            zone = self._shape("domain", zone)
        return head, dot, zone, top

    def _name(self, kind: str, norm: str, attempt: int) -> str:
        what, script = kind.split("-")
        if script not in SYLLABLES:
            # letters of the same script; a longer one where the shape is full
            made = norm + norm[-1:] * (max(attempt - WALKS, 0) // 4)
            for _ in range(attempt + 1):
                made = self._shape(kind, made)
            return made
        feminine = "a" if script == "latin" else "а"
        told = TOLD.get(norm, "u")
        if attempt < 8:
            pool = FAMILY[script] if what == "family" else [n for (s, g), names in GIVEN.items() if s == script and told in (g, "u") for n in names]
            made = pool[self._draw(kind, norm, attempt) % len(pool)].casefold()
        else:
            drawn, made = self._draw(kind, norm, attempt), ""
            for _ in range(3 + attempt // 16):
                drawn, at = divmod(drawn, len(SYLLABLES[script]))
                made += SYLLABLES[script][at]
            # composed given names of even draws are feminine
            made += feminine if what == "given" and (told == "f" or told == "u" and drawn % 2 == 0) else ""
        return made + feminine if what == "family" and script == "cyrillic" and norm.endswith(("ва", "на", "ая")) else made

    @staticmethod
    def gender(kind: str, made: str) -> str:
        """The gender that a given name's surrogate shows; u where it shows none."""
        what, _, script = kind.partition("-")
        if what != "given" or script not in SYLLABLES:
            return "u"
        return TOLD.get(made) or ("f" if made.endswith(("a", "а")) else "m")

    def _drawn(self, kind: str, norm: str, attempt: int) -> str:
        """A keyed draw for what its shape cannot give a surrogate: a letter more in an e-mail address, and the longer the later."""
        draw = lambda i, a: a[self._draw("drawn", kind, norm, attempt, i) % len(a)]
        more = max(attempt - WALKS, 0) // 4
        fresh = lambda n, a="0123456789": "".join(draw(i, a) for i in range(n + more))
        if kind == "email":
            local, _, domain = norm.rpartition("@")
            head, dot, zone, top = self._domain(domain)
            before = f"{local}@{head}" if dot else local
            made = "".join(draw(i, CLASSES[0] if c.isdigit() else CLASSES[1]) if c.isalnum() else c for i, c in enumerate(before))
            local, _, head = made.partition("@")
            local += "".join(draw(-1 - i, CLASSES[1]) for i in range(1 + more))
            return f"{local}@{head}{dot}{zone}.{top}" if dot else f"{local}@{zone}.{top}"
        if kind == "ip":
            return ".".join(str(1 + self._draw("drawn", kind, norm, attempt, i) % 254) for i in range(4))
        if kind == "card":
            made = norm[0] + fresh(len(norm) - 2)
            return made + str(_luhn(made))
        if kind == "iban":
            rest = fresh(len(norm) - 4)
            return norm[:2] + _iban_check(norm[:2], rest) + rest
        if kind == "key":
            return norm[:4] + fresh(len(norm) - 4, CLASSES[0] + CLASSES[2])
        if kind == "secret":
            return fresh(len(norm), "0123456789abcdef" if norm.lower() == norm else "0123456789ABCDEF")
        cut = max(len(norm) - 10, 0) if kind == "phone" else 0
        return norm[:cut] + fresh(len(norm) - cut)

    def of(self, kind: str, norm: str, attempt: int = 0) -> str:
        """The ``attempt``-th surrogate of an entity, never the entity itself."""
        if "-" in kind:
            return self._another(kind, norm, attempt)
        out = norm
        if attempt < WALKS:
            for _ in range(attempt + 1):
                out = self._once(kind, out)
        while out == norm:  # nothing to permute, the permutation comes back to it, or the shape may be full
            out, attempt = self._drawn(kind, norm, attempt), attempt + 101
        return out

    def _another(self, kind: str, norm: str, attempt: int) -> str:
        """The drawn name, or where that is the entity itself the next of a row of draws of the same length."""
        made, again = self._name(kind, norm, attempt), 0
        while made == norm:
            again += 1
            if kind.split("-")[1] not in SYLLABLES:
                made += norm[-1:]
            else:
                made = self._name(kind, f"{again}\x1f{norm}", attempt)
        return made

    @staticmethod
    def spelled(made: str, mention: Mention) -> str:
        """The surrogate in the mention's format: its separators, its case."""
        if "-" in mention.kind:
            return made.upper() if mention.text.isupper() and len(mention.text) > 1 else "-".join(p[:1].upper() + p[1:] for p in made.split("-"))
        if mention.kind in ("email",):
            return "".join(a.upper() if b.isupper() else a for a, b in zip(made, mention.text, strict=True)) if len(made) == len(mention.text) else made
        if mention.kind in ("card", "phone", "ssn", "iban"):
            got = iter(made)
            return "".join(next(got) if c.isalnum() else c for c in mention.text) + "".join(got)
        return made


def replace(text: str, mentions: list[Mention], surrogates: Surrogates, attempts: dict[tuple[str, str], int]) -> str:
    out, at = [], 0
    for m in mentions:
        made = surrogates.of(m.kind, m.norm, attempts.get((m.kind, m.norm), 0))
        out += [text[at : m.start], surrogates.spelled(made, m)]
        at = m.end
    return "".join([*out, text[at:]])


TYPE = "kind string, norm string"


def _read_entities(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in it:
        rows = []
        for at, t in zip(pdf.drop(columns="text").itertuples(index=False, name=None), pdf["text"], strict=True):
            mentions, genders = detect_with_gender(t)
            rows += [(*at, k, n, genders.get((k, n), "u")) for k, n in sorted({(m.kind, m.norm) for m in mentions})]
        yield pd.DataFrame(rows, columns=[*pdf.columns.drop("text"), "kind", "norm", "gender"])
    let_go()


def entities(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, kind, norm, gender``: the different entities of each document, in one pass over the texts."""
    taken = docs.select(*id_columns(id_col), F.col(text).alias("text"))
    found = taken.mapInPandas(_read_entities, f"known boolean, id long, {TYPE}, gender string")
    return found.select(F.when(F.col("known"), F.col("id")).alias("id"), "kind", "norm", "gender")


def assignments(found: DataFrame, key: bytes) -> DataFrame:
    """``kind, norm, made, attempt``: different surrogates for different entities, none of them a real entity.

    ``found``: ``kind, norm`` and ``gender`` (f, m, u), rows in any number for an entity.
    """

    def propose(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        surrogates = Surrogates(key)
        for pdf in it:
            made, fits = [], []
            for kind, norm, gender, attempt in zip(pdf["kind"], pdf["norm"], pdf["gender"], pdf["attempt"], strict=True):
                made.append(surrogates.of(kind, norm, attempt))
                fits.append("u" in (gender, shown := surrogates.gender(kind, made[-1])) or gender == shown)
            yield pdf.assign(made=made, fits=fits)

    each = found.groupBy("kind", "norm").agg(F.min("gender").alias("gender")).withColumn("attempt", F.lit(0))
    each = written(each, "entities")
    real = each.select("kind", F.col("norm").alias("made"))
    proposed = f"{TYPE}, gender string, attempt int, made string, fits boolean"
    settled, open_ = None, each
    while True:  # wider shapes end it
        now = written(open_.select("kind", "norm", "gender", "attempt").mapInPandas(propose, proposed), "proposed")
        free = now.filter("fits").join(real, ["kind", "made"], "left_anti")
        if settled is not None:  # what is settled stays
            free = free.join(settled.select("kind", "made"), ["kind", "made"], "left_anti")
        # of several the smallest
        won = written(free.groupBy("kind", "made").agg(F.min(F.struct("norm", "attempt")).alias("r")).select("kind", "r.norm", "made", "r.attempt"), "settled")
        settled = won if settled is None else settled.unionByName(won)
        open_ = now.join(won.select("kind", "norm"), ["kind", "norm"], "left_anti").withColumn("attempt", F.col("attempt") + 1)
        if open_.isEmpty():
            return settled.select("kind", "norm", "made", "attempt")


def _unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case."""
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def _changes(found: DataFrame, key: bytes, name: str) -> DataFrame:
    """``h1, h2`` of the texts that have entities with other than their first surrogate, and which, as JSON."""
    moved = assignments(found, key).filter("attempt > 0").select("kind", "norm", "attempt")
    of_text = found.select("h1", "h2", "kind", "norm").distinct().join(moved, ["kind", "norm"])
    return of_text.groupBy("h1", "h2").agg(F.to_json(F.collect_list(F.struct("kind", "norm", "attempt"))).alias(name))


def surrogate_texts(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the text's entities replaced, and ``n_entities`` (mentions replaced)."""
    if not key:
        raise ValueError("a key is needed: surrogates without a secret can be computed by anyone")
    docs = docs.drop("n_entities")
    hashes = F.coalesce(F.xxhash64(text), F.lit(0)).alias("h1"), F.coalesce(F.xxhash64(F.lit(1), F.col(text)), F.lit(0)).alias("h2")
    found = written(docs.select(*hashes, F.col(text).alias("text")).mapInPandas(_read_entities, f"h1 long, h2 long, {TYPE}, gender string"), "found")
    changes = _unused(docs, "changes")
    with scratch():
        of_text = written(_changes(found, key, changes), "changes", keep=True)
    forget(found)
    h1, h2 = _unused(docs, "h1"), _unused(docs, "h2")
    of_text = of_text.withColumnsRenamed({"h1": h1, "h2": h2})
    joined = docs.join(of_text, (hashes[0] == F.col(h1)) & (hashes[1] == F.col(h2)), "left").drop(h1, h2)

    def make():
        surrogates = Surrogates(key)

        def run(texts: list[str | None], changes: list[str | None]) -> list[list]:
            found = [detect(t) for t in texts]
            attempts = [{(x["kind"], x["norm"]): x["attempt"] for x in json.loads(c)} if c else {} for c in changes]
            return [[replace(t, m, surrogates, a) if m else t for t, m, a in zip(texts, found, attempts, strict=True)], [len(m) for m in found]]

        return run

    return appended(joined, text, make, f"`{text}` string, n_entities long", replace=True, drop=(changes,))
