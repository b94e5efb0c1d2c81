"""Personal data replaced by surrogates of the same type and format.

Numbers, addresses and secrets (e-mail, IPv4 and IPv6, phone, card and account numbers, US social
security numbers, IBAN, keys and passwords that are assigned or have a known prefix) go through a keyed permutation of all strings of their format, one without fixed points: so
equal entities get equal surrogates in every document, different ones different surrogates, and no
lookup is needed. Case, script, digits and separators stay; check digits are made right again.

Names come from a rule-made pool by gender and script. Distinct name parts of the whole corpus meet
in one table, where those that draw the same surrogate, or one that is a real name of the corpus,
are told apart. A part has one surrogate, of the gender that most texts give it, wherever it occurs,
in capitals too, so "Mr Smith" and "JOHN SMITH" follow "John Smith". Names are found behind a listed
title, given name or label; their parts are then found again wherever the same text repeats them.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import stored

#: Titles that a name follows, by the gender they tell.
TITLES = {
    "m": ["Mr", "Herr", "Señor", "Monsieur", "Signor", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Señorita", "Madame", "Mme", "Mlle", "Signora", "госпожа", "κυρία"],
    "u": ["Dr", "Prof"],
}
#: Given names that mark a full name where no title does, by gender.
GIVEN = {
    "m": ["John", "James", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Charles", "Daniel", "Matthew", "Peter", "Hans", "Klaus", "Wolfgang", "Jürgen", "Pierre", "François", "Jacques", "Carlos", "Javier", "Miguel", "Иван", "Дмитрий", "Алексей", "Νίκος", "Γιώργος"],
    "f": ["Mary", "Patricia", "Jennifer", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Margaret", "Emily", "Anna", "Ursula", "Ingrid", "Sabine", "Brigitte", "Françoise", "Nathalie", "Carmen", "Lucía", "Isabel", "Мария", "Елена", "Ольга", "Μαρία", "Ελένη"],
}
#: Syllables and endings that surrogate names are built from, by script.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za ze zo".split(),
    "cyrillic": "ба бе бо да де до ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то ва во за зо".split(),
    "greek": "βα βε βο δα δε δο κα κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε σο τα τε το".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "na", "u": "l", "s": "rt"},
    "cyrillic": {"m": "н", "f": "на", "u": "ль", "s": "рт"},
    "greek": {"m": "ς", "f": "να", "u": "ν", "s": "ρτς"},
}
#: Domains that belong to nobody.
RESERVED = ("example.com", "example.org", "example.net", "example", "test", "invalid", "localhost")

#: Small words inside names and what follows a surname; both stay.
SUFFIXES = ("Jr", "Sr", "JR", "SR", "II", "III", "IV")
PARTICLES = "von van de der den del della di da dos du la le ter zu bin al".split()


def _cased(names) -> list[str]:
    """The names and their forms in capitals, longest first."""
    return sorted({x for n in names for x in (n, n.upper())}, key=lambda n: (-len(n), n))


#: Labels that a full name follows.
LABELS = ("Name", "Contact", "Patient", "Customer", "Author", "Signed by")
_ANY_TITLE = _cased(t for v in TITLES.values() for t in v)
_ANY_GIVEN = _cased(n for v in GIVEN.values() for n in v)
#: The letters of small case in the scripts of the pools.
_SMALL = "".join(c for c in map(chr, [*range(0x530), *range(0x1E00, 0x2000)]) if c.islower())
_NAME = rf"[^\W\d_{_SMALL}][^\W\d_]*(?:[-'’][^\W\d_]+)*"
_TITLE = rf"(?:{'|'.join(_ANY_TITLE)})\b"
_WORD = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}(?!{_TITLE})(?:(?:[^\W\d_{_SMALL}]\.-?)+|{_NAME})"
#: A title or a listed given name, and all name words and initials that follow.
TITLED = re.compile(rf"\b((?:{_TITLE}\.? )+)({_WORD}(?: {_WORD})*)")
FULL = re.compile(rf"\b((?:{'|'.join(_ANY_GIVEN)})(?: {_WORD})+)")
_LABEL = rf"(?:{'|'.join(LABELS)}): ?"
LABELLED = re.compile(rf"\b{_LABEL}({_WORD}(?: {_WORD})+)")
#: What a text must hold to hold a name; also for Spark's own rlike.
_STARTS = "".join(sorted({n[0] for n in (*_ANY_TITLE, *_ANY_GIVEN, *LABELS)}))
MAY_NAME = rf"\b(?=[{_STARTS}])(?:(?:{'|'.join(_ANY_TITLE + _ANY_GIVEN)})\b|{_LABEL})"
#: Letters that a part of a name must have to be looked for elsewhere in its text.
_LEAST_PART = 3

EMAIL = re.compile(r"[\w.+-]*[\w+-]@(?:[\w-]+\.)+[^\W\d_]{2,}")
DIGIT = re.compile(r"\d[ .()-]{0,2}\d")
LONG = re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4})(?!\d)|(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]\d|\d)")
#: The shapes of other numbers, looked for inside the text, so that numbers beside them are not joined
#: to them: an international number's start, a number with an area code in brackets, US social security
#: and phone numbers, national numbers with a leading 0, account numbers. A digit's end may be an extension.
_EDGE = r"(?!(?!x\d)\w)"
_GROUPS = r"\d+(?:(?:[ .-]|[ -]?\(|\)[ .-]?)\d+)*\)?"
PLUS = re.compile(rf"(?<!\w)\+\(?{_GROUPS}{_EDGE}")
BRACKETS = re.compile(rf"(?<!\w)(?:\d{{1,4}}[ .-]?)?\(\d{{1,5}}\)(?:[ .-]?{_GROUPS}){_EDGE}")
SSN = re.compile(rf"(?<!\w)\d{{3}}-\d{{2}}-\d{{4}}{_EDGE}")
US_PHONE = re.compile(rf"(?<!\w)\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}{_EDGE}")
ZERO_PHONE = re.compile(rf"(?<!\w)0\d{{1,4}}[ -]\d{{3,4}}[ -]?\d{{3,4}}{_EDGE}")
ACCOUNT = re.compile(rf"(?<!\w)\d{{4}}(?:[ -]\d{{4}}){{2,3}}(?:[ -]\d{{1,3}})?{_EDGE}")
#: Country codes of one and two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Most digits behind a country code, where numbers are not as long as the 15 in all allow.
NATIONAL = {"1": 10, "7": 10, "30": 10, "31": 9, "32": 9, "33": 9, "34": 9, "41": 9, "44": 10, "45": 8, "47": 8, "48": 9, "49": 11, "61": 9, "86": 11, "90": 10, "91": 10, "351": 9, "420": 9, "421": 9}
#: Numbers that look like an address but count versions.
VERSION = re.compile(r"(?:\b(?:version|build|release|rev|revision|firmware)\.?|\bv\.?) ?$", re.IGNORECASE)
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![\w:])")
#: What a secret is assigned to, and how keys of well-known services begin.
SECRET_WORDS = ("token", "secret", "api_key", "api-key", "apikey", "access_key", "private_key", "password", "passwd", "pwd")
SECRET_HEADS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "glpat-", "xoxb-", "xoxp-", "sk-", "AIza")
ASSIGNED = re.compile(rf"(?i)\b\w*(?:{'|'.join(SECRET_WORDS)})\b[\"']? ?[:=] ?[\"']?([A-Za-z0-9+/_.=-]{{8,}})")
HEADED = re.compile(rf"(?<![A-Za-z0-9])(?:{'|'.join(SECRET_HEADS)})([A-Za-z0-9_-]{{16,}})")
_SECRET_HINTS = ("oken", "ecret", "key", "assw", "pwd", "TOKEN", "SECRET", "KEY", "PASSW", "Key")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_GENDER = {n.casefold(): g for g, v in GIVEN.items() for n in v}
_TITLE_GENDER = {t.casefold(): g for g, v in TITLES.items() for t in v}


class Permutation:
    """Keyed permutations of the numbers under n, without fixed points."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tag: bytes, i: int, x: int, bits: int) -> int:
        out = hashlib.blake2b(tag + bytes([i]) + x.to_bytes(32, "big"), key=self.key[:64], digest_size=32).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def _walk(self, x: int, n: int, tag: bytes, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << half) - 1
        while True:
            a, b = x >> half, x & mask
            for i in (range(7, -1, -1) if back else range(8)):
                a, b = (b ^ self._round(tag, i, a, half), a) if back else (b, a ^ self._round(tag, i, b, half))
            x = a << half | b
            if x < n:
                return x

    def __call__(self, x: int, n: int, tag: str) -> int:
        """The next number after x on one keyed cycle through all n numbers: never x, if n > 1."""
        t = tag.encode()[:64]
        return self._walk((self._walk(x, n, t, False) + 1) % n, n, t, True) if n > 1 else x


def _classes(c: str) -> str:
    """The characters that may stand for c: digits for digits, letters of its case for ASCII letters,
    letters of its script for others; other characters stand for themselves."""
    if "0" <= c <= "9":
        return "0123456789"
    if "a" <= c <= "z":
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z":
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in ("àâäçèéêëîïñóôöùûü", "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"):
        if c in letters:
            return letters
    return c


class Surrogates:
    """Detects entities of a text and gives their surrogates."""

    def __init__(self, key: bytes):
        self.permute = Permutation(hmac.new(key, b"surrogates", hashlib.sha512).digest())
        self.known: dict[tuple[str, str], str] = {}

    def _string(self, s: str, tag: str) -> str:
        """s with every character replaced inside its class."""
        classes = [_classes(c) for c in s]
        n = x = 0
        n = 1
        for c, k in zip(s, classes):
            x, n = x * len(k) + k.index(c), n * len(k)
        x = self.permute(x, n, f"{tag}:{'|'.join(k[0] for k in classes)}")
        out = []
        for k in reversed(classes):
            x, r = divmod(x, len(k))
            out.append(k[r])
        return "".join(reversed(out))

    def _digits(self, s: str, tag: str) -> str:
        return self._string(s, tag)

    def surrogate(self, kind: str, norm: str) -> str:
        got = self.known.get((kind, norm))
        if got is None:
            if len(self.known) > 200_000:
                self.known.clear()
            got = self.known[kind, norm] = getattr(self, f"_{kind}")(norm)
        return got

    def _email(self, norm: str) -> str:
        local, domain = norm.rsplit("@", 1)
        if not (domain in RESERVED or domain.endswith(tuple("." + r for r in RESERVED))):
            domain = ".".join(self._string(x, "domain") for x in domain.split(".")) + ".example"
        return f"{self._string(local, 'local')}@{domain}"

    def _ip(self, norm: str) -> str:
        parts = [int(p) for p in norm.split(".")]
        free = [k for k, p in enumerate(parts) if 1 <= p <= 254]
        x = 0
        for k in free:
            x = x * 254 + parts[k] - 1
        x = self.permute(x, 254 ** len(free), f"ip:{free}")
        for k in reversed(free):
            x, r = divmod(x, 254)
            parts[k] = r + 1
        return ".".join(map(str, parts))

    def _card(self, norm: str) -> str:
        """First digit kept, and the check digit right where it was."""
        if not luhn(norm):
            return self._avoid_luhn(norm)
        body = norm[0] + self._digits(norm[1:-1], f"card{norm[0]}")
        return next(body + d for d in "0123456789" if luhn(body + d))

    def _avoid_luhn(self, norm: str) -> str:
        """First digit kept, and the next number on the cycle whose check digit is wrong too: so numbers
        with and without a right one never meet."""
        while True:
            norm = norm[0] + self._digits(norm[1:], f"number{norm[0]}")
            if not luhn(norm):
                return norm

    def _ipv6(self, norm: str) -> str:
        return str(ipaddress.IPv6Address(self.permute(int(ipaddress.IPv6Address(norm)), 1 << 128, "ipv6")))

    def _secret(self, norm: str) -> str:
        """Digits for digits and letters for letters; a run of hexadecimal digits stays one."""
        if re.fullmatch(r"[0-9a-f]{16,}", norm) or re.fullmatch(r"[0-9A-F]{16,}", norm):
            new = f"{self.permute(int(norm, 16), 16 ** len(norm), 'hex')!s}"
            text = f"{int(new):0{len(norm)}x}"
            return text.upper() if norm.isupper() else text
        return self._string(norm, "secret")

    def _phone(self, norm: str) -> str:
        return self._digits(norm, "phone")

    def _ssn(self, norm: str) -> str:
        return self._digits(norm, "ssn")

    def _initial(self, norm: str) -> str:
        small = unicodedata.normalize("NFD", norm.lower())[0]
        new = self._string(small, "initial").upper()
        return new if new != norm and len(_classes(small)) > 1 else "X"

    def _iban(self, norm: str) -> str:
        body = self._string(norm[4:], "iban" + norm[:2])
        rest = "".join(str(int(c, 36)) for c in body + norm[:2]) + "00"
        return f"{norm[:2]}{98 - int(rest) % 97:02d}{body}"

    def _numbers(self, text: str) -> list[tuple[int, int, str, str]]:
        """Entities made of digits. Each shape is looked for in what those before it have left."""
        out: list[tuple[int, int, str, str]] = []

        def take(pattern: re.Pattern, measure) -> None:
            nonlocal text
            rest, at, m = [], 0, pattern.search(text)
            while m:
                start, end, kind, head = measure(text, m)
                if kind:
                    s = text[start:end]
                    norm = re.sub(r"\D", "", s)
                    new = self.surrogate(kind, s) if kind == "ip" else _shaped(s, norm[:head] + self.surrogate(kind, norm[head:]))
                    out.append((start, end, kind, new))
                    rest += [text[at:start], "\0" * (end - start)]
                    at = end
                m = pattern.search(text, end)
            if at:
                text = "".join(rest) + text[at:]

        take(LONG, lambda t, m: (m.start(), m.end(), digit_kind(m.group(), t[max(0, m.start() - 12):m.start()]), 0))
        if "+" in text:
            take(PLUS, _plus_phone)
        take(SSN, lambda t, m: (m.start(), m.end(), "ssn", 0))
        if "(" in text:
            take(BRACKETS, _bracket_phone)
        take(US_PHONE, lambda t, m: (m.start(), m.end(), "phone", 0))
        take(ZERO_PHONE, lambda t, m: (m.start(), m.end(), "phone", 0))
        take(ACCOUNT, lambda t, m: (m.start(), m.end(), "card", 0))
        return out

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, type, replacement), in order and apart, of all entities but names."""
        out: list[tuple[int, int, str, str]] = []
        if "@" in text:
            for m in EMAIL.finditer(text):
                s = m.group()
                new = self.surrogate("email", s.lower())
                out.append((m.start(), m.end(), "email", new.upper() if s.isupper() else new))
        if any(h in text for h in _SECRET_HINTS):
            out += [(m.start(1), m.end(1), "secret", self.surrogate("secret", m.group(1))) for m in ASSIGNED.finditer(text) if any(c.isdigit() for c in m.group(1))]
        if any(h in text for h in SECRET_HEADS):
            out += [(m.start(1), m.end(1), "secret", self.surrogate("secret", m.group(1))) for m in HEADED.finditer(text) if any(c.isdigit() for c in m.group(1))]
        if text.count(":") > 1:
            out += [(m.start(), m.end(), "ipv6", self.surrogate("ipv6", m.group())) for m in IPV6.finditer(text) if is_ipv6(m.group())]
        for m in IBAN.finditer(text):
            norm = m.group().replace(" ", "")
            if 15 <= len(norm) <= 34 and int("".join(str(int(c, 36)) for c in norm[4:] + norm[:4])) % 97 == 1:
                out.append((m.start(), m.end(), "iban", _shaped(m.group(), self.surrogate("iban", norm))))
        if DIGIT.search(text):
            out += self._numbers(text)
        return _apart(sorted(out))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def is_ipv6(s: str) -> bool:
    """Whether a text is an IPv6 address with at least two groups written out."""
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return sum(1 for g in s.split(":") if g) > 1


def digit_kind(s: str, before: str = "") -> str | None:
    """The type of what LONG finds; None for four numbers that are no address, or count versions."""
    if "." in s:
        return "ip" if all(int(p) < 256 for p in s.split(".")) and not VERSION.search(before) else None
    return "card"


def _group_end(text: str, start: int, end: int, least: int, most: int) -> int:
    """Where the number that starts at start ends: it takes group after group, up to most digits once
    it has the least, and none after a space or in brackets where it is long enough and another number begins."""
    n = last = 0
    at = start
    for g in re.finditer(r"\d+", text[start:end]):
        i = start + g.start()
        more = n + len(g.group())
        if n and (more > 15 or more > most and n >= least or text[i - 1] == "(" and text[start] == "("):
            break
        if n >= 7 and (text[i - 1] == "(" or text[i - 1] == " " and (n >= 10 or last >= 6 or SSN.match(text, i) or US_PHONE.match(text, i))):
            break
        n, last, at = more, len(g.group()), start + g.end()
    return at + (text[at:at + 1] == ")" and text.count("(", start, at) > text.count(")", start, at))


def _plus_phone(text: str, m: re.Match) -> tuple[int, int, str | None, int]:
    """(start, end, kind, digits kept) of an international number: its country code and a 0 in
    brackets stay, and it is no longer than numbers of its country are."""
    digits = re.sub(r"\D", "", m.group())
    code = next((digits[:k] for k in (1, 2) if digits[:k] in COUNTRY_CODES), digits[:3])
    head = 0 if code[0] == "0" else len(code)
    body = m.start()
    for _ in range(head):
        body = re.compile(r"\d").search(text, body).end()
    trunk = re.compile(r"[ .-]?\(0\)").match(text, body)
    if trunk:
        body, head = trunk.end(), head + 1
    first = re.compile(r"\d+").search(text, body, m.end())
    if not first:
        return m.start(), m.end(), None, 0
    most = NATIONAL.get(code, 15 - len(code)) if head else 15
    end = _group_end(text, body, m.end(), most if code in "17" else most - 2, most)
    n = len(re.sub(r"\D", "", text[m.start():end]))
    return m.start(), end, "phone" if 7 <= n <= 16 else None, head


def _bracket_phone(text: str, m: re.Match) -> tuple[int, int, str | None, int]:
    """(start, end, kind, digits kept) of a number with an area code in brackets. What stands before
    the bracket is a part of it only if the rest is too short to be a number with area code."""
    bracket = text.index("(", m.start())
    us = re.compile(r"\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}" + _EDGE).match(text, bracket)
    end = us.end() if us else _group_end(text, bracket, m.end(), 15, 15)
    before = len(re.sub(r"\D", "", text[m.start():bracket]))
    n = len(re.sub(r"\D", "", text[bracket:end]))
    start = m.start() if before and n < 10 and text[bracket + 1] != "0" and before + n <= 15 else bracket
    n += before if start < bracket else 0
    return start, end, "phone" if 7 <= n <= 15 else None, 0


def _shaped(pattern: str, chars: str) -> str:
    """chars in place of the letters and digits of pattern."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in pattern)


def script_of(name: str) -> str:
    first = unicodedata.name(name[0], "LATIN").split(" ")[0].lower()
    return first if first in SYLLABLES else "latin"


def find_names(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, part) of name parts: kind is m, f or u for given names, s for surnames, i for
    the letter of an initial. The last word is the surname, if no initial; small words and suffixes stay."""
    out: list[tuple[int, int, str, str]] = []
    inside = set()
    for m in TITLED.finditer(text):
        genders = [_TITLE_GENDER[t.rstrip(".").casefold()] for t in m.group(1).split(" ")[:-1]]
        inside.update(range(m.start(2), m.end(2)))
        out += _name_parts(m.group(2), m.start(2), next((g for g in genders if g != "u"), "u"))
    for pattern, group in ((FULL, 0), (LABELLED, 1)):
        for m in pattern.finditer(text):
            if m.start(group) not in inside:
                inside.update(range(m.start(group), m.end(group)))
                out += _name_parts(m.group(group), m.start(group), "u")
    again = {w: k for _, _, k, w in out if k != "i" and len(w) >= _LEAST_PART}
    if again:
        forms = {x: k for w, k in again.items() for x in (w, w.upper(), w.capitalize())}
        busy = {i for i, _, _, _ in out}
        repeated = re.compile(rf"(?<!\w)(?:{'|'.join(sorted(map(re.escape, forms), key=len, reverse=True))})(?!\w)")
        out += [(m.start(), m.end(), forms[m.group()], m.group()) for m in repeated.finditer(text) if m.start() not in busy]
    return _apart(sorted(out))


def _apart(spans: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Spans in order without those that begin inside the one before."""
    out: list[tuple[int, int, str, str]] = []
    for x in spans:
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _name_parts(name: str, start: int, gender: str) -> list[tuple[int, int, str, str]]:
    words = [(w.start(), re.sub("['’][sS]$", "", w.group())) for w in re.finditer("[^ ]+", name)]
    words = [(i, w) for i, w in words if w not in PARTICLES and w not in SUFFIXES]
    gender = next((_GENDER[w.casefold()] for _, w in words if w.casefold() in _GENDER), gender)
    out = []
    for k, (i, w) in enumerate(words):
        if "." in w or len(w) == 1:
            out += [(start + i + j, start + i + j + 1, "i", c) for j, c in enumerate(w) if c.isalpha()]
        else:
            kind = "s" if k == len(words) - 1 else _GENDER.get(w.casefold(), gender)
            out.append((start + i, start + i + len(w), kind, w))
    return out


def pool_name(kind: str, script: str, number: int, rank: int) -> str:
    """Name `number` of a pool; rank > 0 gives others that no number gives. Built from syllables: three,
    and for a rank a hyphen and its digits as syllables."""
    s, spell = SYLLABLES[script], []
    for _ in range(3):
        number, r = divmod(number, len(s))
        spell.append(s[r])
    name = "".join(spell).capitalize() + ENDINGS[script][kind]
    if rank:
        more = []
        while rank:
            rank, r = divmod(rank, len(s))
            more.append(s[r])
        name += "-" + "".join(more).capitalize() + ENDINGS[script]["s"]
    return name


def _cased_like(part: str, name: str) -> str:
    return name.upper() if part.isupper() else name


def name_table(mentions: DataFrame, key: bytes) -> DataFrame:
    """(part, surrogate) for the distinct name parts of mentions (kind, part), each of the kind that most
    mentions give it: one-to-one, and never a part that the corpus holds, in any case. Parts that draw
    one pool name meet in a small group and are ranked; a real name equal to the pool name takes the
    first rank. Mentions hold case-folded parts."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            script = [script_of(p) for p in b["part"]]
            number = [int.from_bytes(hmac.new(key, p.encode(), hashlib.sha256).digest()[:6], "big") % len(SYLLABLES[s]) ** 3 for p, s in zip(b["part"], script)]
            yield b.assign(script=script, number=number, drawn=[pool_name(k, s, n, 0).casefold() for k, s, n in zip(b["kind"], script, number)])

    counted = mentions.groupBy("part", "kind").agg(F.count(F.lit(1)).alias("n"))
    # A gender that some text tells weighs more than none told.
    told = F.when(F.col("kind") != "u", 1).otherwise(0)
    chosen = counted.groupBy("part").agg(F.max_by("kind", F.struct(told, "n", "kind")).alias("kind")).select("kind", "part")
    drawn = stored(chosen.mapInPandas(draw, "kind string, part string, script string, number long, drawn string"))
    real = drawn.select(F.lit("").alias("kind"), "part", F.col("part").alias("drawn"), F.lit(None).cast("string").alias("script"), F.lit(None).cast("long").alias("number"))
    group = Window.partitionBy("drawn").orderBy("kind", "part")
    ranked = drawn.select("kind", "part", "drawn", "script", "number").unionByName(real).withColumn("rank", F.row_number().over(group) - 1).where("kind <> ''")

    @F.pandas_udf("string")
    def spell(kind: pd.Series, script: pd.Series, number: pd.Series, rank: pd.Series) -> pd.Series:
        return pd.Series([pool_name(*x) for x in zip(kind, script, number.astype(int), rank.astype(int))], dtype="object")

    return ranked.select("part", spell("kind", "script", "number", "rank").alias("surrogate"))


def _replace(key: bytes, named: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Surrogates(key)
        for b in batches:
            texts, kinds, starts, ends = [], [], [], []
            for t, names in zip(b["text"], b["names"] if named else [None] * len(b)):
                spans = s.find(t) if t else []
                if t and named:
                    table = {x["part"]: x["surrogate"] for x in (names if names is not None else ())}
                    busy = [(x[0], x[1]) for x in spans]
                    spans += [(i, j, "name", s.surrogate("initial", p) if k == "i" else _cased_like(p, table[p.casefold()])) for i, j, k, p in find_names(t) if all(j <= a or i >= z for a, z in busy)]
                    spans.sort()
                out, at, w0, w1 = [], 0, [], []
                for i, j, _, new in spans:
                    out.append(t[at:i])
                    w0.append(i)
                    w1.append(j)
                    out.append(new)
                    at = j
                texts.append("".join(out) + t[at:] if spans else t)
                kinds.append([x[2] for x in spans])
                starts.append(w0)
                ends.append(w1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "n_entities": [len(x) for x in kinds], "kinds": kinds, "starts": starts, "ends": ends})

    return run


def replace_entities(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_entities, kinds, starts, ends) for every row of docs: its text with surrogates,
    and type and place (characters of the old text) of each entity.

    Texts without entities, null and empty ones stay as they are. Only rows that may hold a name are
    joined with the name table; the others are read and written where they lie. Names are collected
    for each distinct text, whatever ids its rows have; repeated rows are rewritten each, alike. Very long texts
    are worked on whole. An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text string, n_entities int, kinds array<string>, starts array<int>, ends array<int>"
    rows = docs.select("doc_id", "text")
    may = F.coalesce(F.rlike("text", F.lit(MAY_NAME)), F.lit(False))

    def mentions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(i, k, p) for i, t in zip(b["h"], b["text"]) for k, p in sorted({(k, p.casefold()) for _, _, k, p in find_names(t) if k != "i"})]
            yield pd.DataFrame(found, columns=["h", "kind", "part"])

    hashed = stored(rows.where(may).withColumn("h", F.md5(F.col("text").cast("binary"))))
    named = stored(hashed.select("h", "text").mapInPandas(mentions, "h string, kind string, part string").distinct())
    table = name_table(named, key)
    by_text = named.select("h", "part").distinct().join(table, "part").groupBy("h").agg(F.collect_list(F.struct("part", "surrogate")).alias("names"))
    with_names = hashed.join(by_text, "h", "left").select("doc_id", "text", "names")
    return rows.where(~may).mapInPandas(_replace(key, False), schema).unionByName(with_names.mapInPandas(_replace(key, True), schema))


def entity_table(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of the distinct entities of docs but names, as they are written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Surrogates(key)
        for b in batches:
            found = {(k, t[i:j], new) for t in b["text"] if t for i, j, k, new in own.find(t)}
            yield pd.DataFrame(sorted(found), columns=["kind", "entity", "surrogate"])

    return docs.select("text").mapInPandas(run, "kind string, entity string, surrogate string").distinct()


def collisions(entities: DataFrame) -> DataFrame:
    """Check over a whole corpus: (kind, surrogate, n_entities) of the surrogates that several entities of
    one kind and shape share, over entities (kind, entity, surrogate). None, as permutations have no
    two numbers go to one; entities that differ but in separators or case are one."""
    bare = lambda c: F.lower(F.regexp_replace(c, r"[\s().-]", ""))
    found = entities.select("kind", bare(F.col("entity")).alias("entity"), bare(F.col("surrogate")).alias("surrogate")).distinct()
    return found.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n_entities")).where("n_entities > 1")
