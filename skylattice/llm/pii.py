"""Personal data and secrets replaced by surrogates.

A mention has an identity: the digits of a phone or card number, an address
without case, the parts of a name without title.  Each identity of all documents gets one
surrogate made from a keyed digest, of the same kind, script and gender, which
every mention shows in its own format; so texts stay natural and what referred to
the same still does.  Surrogates that two identities share, or that are somebody's
real identity, are found by joins and drawn again until all are distinct; where a
format is too small for that, a keyed permutation of its words is taken.  Only
documents that have mentions are moved; all others pass as they are.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Titles before names, by gender ("" for either).
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña", "госпожа"],
    "": ["Dr", "Prof"],
}
#: Given names by script and gender.  One of them before a capitalised word is a
#: name without a title, and surrogates begin and end as they do.
GIVEN = {
    "latin": {
        "m": "James John Robert Michael William David Richard Thomas Daniel Matthew Anthony Andrew Peter Paul Martin Hans Klaus Jürgen Stefan Pierre Jacques Antoine Carlos José Miguel Diego Giovanni Marco Ahmed Omar".split(),
        "f": "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Anna Julia Laura Hannah Ursula Greta Ingrid Claudia Camille Chloé Sophie Carmen Lucía Isabel María Francesca Giulia Fatima Aisha".split(),
    },
    "cyrillic": {
        "m": "Иван Сергей Дмитрий Алексей Михаил Николай Павел Лев Олег Борис".split(),
        "f": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Вера".split(),
    },
    "greek": {"m": "Γιώργος Νίκος Δημήτρης Κώστας Παύλος Ανδρέας".split(), "f": "Μαρία Ελένη Κατερίνα Σοφία Άννα Ειρήνη".split()},
}
#: Family names by script, which surrogates begin and end as.
FAMILY = {
    "latin": "Smith Johnson Miller Davis Wilson Anderson Taylor Walker Robinson Mitchell Carter Turner Parker Collins Morgan Bennett Fischer Weber Wagner Becker Schneider Hoffmann Keller Lefèvre Moreau Girard Fontaine García Romero Navarro Rossi Ferrari Lindberg Novak Kowalski Haddad".split(),
    "cyrillic": "Соколов Морозов Волков Лебедев Козлов Новиков Макаров Орлов Никитин Захаров".split(),
    "greek": "Παπαδόπουλος Νικολαΐδης Γεωργίου Δημητρίου Αντωνίου Βλάχος".split(),
}
#: Syllables put in between when a name has to be drawn again.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ka ke la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si so ta te ti to va ve vi".split(),
    "cyrillic": "ба бе ва ве ви да де ди ка ки ла ле ли ло ма ми мо на не ни но ра ре ри ро са си та те ти".split(),
    "greek": "βα βε γα γο δα δι κα κο λα λε λι λο μα με μι να νε νι ρα ρι σα σι τα τε τι".split(),
}
#: Capitals of the Latin, Greek and Cyrillic alphabets.
_UP = "".join(c for c in map(chr, range(0x41, 0x530)) if c.isupper())
#: What stands in lower case before or between parts of names, and stays.
PARTICLES = "van von der den de del della di da do dos du la le el al bin ibn ben ten ter zu zum zur y af av фон де ван".split()
_PARTICLES = rf"(?:(?:{'|'.join(PARTICLES)})[ ]+)*"
_NAME = rf"(?:[dl]['’])?[{_UP}](?:['’](?=[{_UP}])|[^\W\d_])+"
_INITIAL = rf"[{_UP}]\.(?:[ ]+(?=[{_UP}])|(?=[{_UP}]))"
_MORE = rf"(?:(?:-|[ ]+{_PARTICLES}(?:{_INITIAL})*){_NAME})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_listed = [n for genders in GIVEN.values() for names in genders.values() for n in names]
_longest_first = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
#: In the order in which they win where two begin together; else the first does.
#: A group "v" marks the entity within the match.
PATTERNS = {
    "email": re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,}\b"),
    "key": re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    "secret": re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)(?:[_-][A-Za-z0-9]++|[A-Z][a-z0-9]++|\d++)*+[\"']?[ \t]*[:=][ \t]*[\"']?(?P<v>[^\s\"',;]{6,})"),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "ip": re.compile(rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)"),
    "phone": re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)"),
    "card": re.compile(r"(?<![\w.-])\d(?:[ -]?\d)*+"),
    "titled": re.compile(rf"\b(?P<title>{_longest_first(t for ts in TITLES.values() for t in ts)})\.?[ ]+(?P<v>{_PARTICLES}(?:{_INITIAL})*{_NAME}{_MORE}*)"),
    "listed": re.compile(rf"\b(?P<v>(?:{_longest_first(_listed)})(?!\w){_MORE}+)"),
}
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
GENDER_OF_NAME = {n.lower(): g for genders in GIVEN.values() for g, names in genders.items() for n in names}
#: Tries in which a secret or the local part of an address keeps its length.
STRICT_TRIES = 6


def luhn_ok(digits: str) -> bool:
    """The check that card numbers pass: doubled every second from the right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def name_parts(name: str) -> list[tuple[str, bool]]:
    """The pieces of a name in order, and whether each is a part that gets a
    surrogate of its own: spaces, hyphens, particles and initials aren't."""
    pieces = [p for p in re.split(r"([ -]|(?<=\.))", name) if p]
    return [(p, p not in (" ", "-") and p not in PARTICLES and p[-1] != ".") for p in pieces]


# --- finding -----------------------------------------------------------------


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, entity) in order.  Kinds of names carry the gender: name,
    name_m, name_f.  Names are those after a title or with a listed given name, and
    what else in the text is made of their parts (kind name)."""
    rank = {k: i for i, k in enumerate(PATTERNS)}
    all_of = sorted((x for k in _kinds(text) for x in _matches(text, k)), key=lambda x: (x[0], rank[x[4]]))
    found, end = [], 0
    for a, z, kind, entity, _ in all_of:
        if a >= end:
            found.append((a, z, kind, entity))
            end = z
    parts = {p for _, _, k, e in found if k.startswith("name") for p, own in name_parts(e) if own}
    if parts:
        part = "|".join(re.escape(p) for p in sorted(parts, key=lambda p: (-len(p), p)))
        taken = sorted((a, z) for a, z, _, _ in found)
        begins = [a for a, _ in taken]
        for m in re.finditer(rf"(?<!\w)(?:{part})(?:(?:-|[ ]+{_PARTICLES}(?:{_INITIAL})*)(?:{part})(?!\w))*(?!\w)", text):
            at = bisect_left(begins, m.end()) - 1  # the last entity that begins before the mention's end
            if at < 0 or taken[at][1] <= m.start():
                found.append((*m.span(), "name", m.group()))
        found.sort()
    return found


def _kinds(text: str) -> Iterator[str]:
    """The patterns that can match at all: most texts have no letter of most."""
    if "@" in text:
        yield "email"
    if re.search(r"\d", text):
        yield from ("iban", "ssn", "ip", "phone", "card")
    if any(w in text for w in ("AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_")):
        yield "key"
    low = text.lower()
    if any(w in low for w in ("passw", "pwd", "secret", "token", "api")):
        yield "secret"
    if any(t in text for t in GENDER):
        yield "titled"
    if any(n in text for n in _listed):
        yield "listed"


def _matches(text: str, pattern: str) -> Iterator[tuple[int, int, str, str, str]]:
    for m in PATTERNS[pattern].finditer(text):
        a, z = m.span("v" if "v" in m.re.groupindex else 0)
        entity, kind = text[a:z], pattern
        if pattern == "card":
            if re.match(r"[\w-]", text[z : z + 1]):  # the last group goes on as something else
                entity = entity[: max(entity.rfind(" "), entity.rfind("-"), 0)]
            yield from ((a + i, a + j, kind, entity[i:j], pattern) for i, j in cards(entity))
            continue
        if pattern == "iban":
            plain = entity.replace(" ", "")
            if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
                continue
        if pattern in ("titled", "listed"):
            first = next((p.lower() for p, own in name_parts(entity) if own), "")
            gender = GENDER[m.group("title")] if pattern == "titled" else ""
            gender = gender or GENDER_OF_NAME.get(first, "")
            kind = f"name_{gender}" if gender else "name"
        yield a, z, kind, entity, pattern


def cards(run: str) -> list[tuple[int, int]]:
    """Of digits in groups between single spaces or hyphens, (begin, end) of those
    groups that make a card number: 13 to 19 digits that pass the check."""
    groups = [m.span() for m in re.finditer(r"\d+", run)]
    out, i = [], 0
    while i < len(groups):
        for j in range(i, len(groups)):
            digits = re.sub(r"\D", "", run[groups[i][0] : groups[j][1]])
            if len(digits) > 19:
                j = len(groups)
                break
            if len(digits) >= 13 and luhn_ok(digits):
                out.append((groups[i][0], groups[j][1]))
                break
        else:
            j = len(groups)
        i = j + 1 if j < len(groups) else i + 1
    return out


# --- identities and surrogates -----------------------------------------------


def identities(kind: str, entity: str) -> list[tuple[str, str]]:
    """What surrogates are drawn for, the same for all spellings of one thing: (kind,
    identity), of a name one for each of its parts."""
    digits = re.sub(r"\D", "", entity)
    if kind.startswith("name"):
        parts = [p.lower() for p, own in name_parts(entity) if own]
        return [(kind if i == 0 and len(parts) > 1 else "name", p) for i, p in enumerate(parts)]
    if kind == "email":
        return [(kind, entity.lower())]
    if kind in ("card", "ssn"):
        return [(kind, digits)]
    if kind == "iban":
        return [(kind, entity.replace(" ", ""))]
    if kind == "phone":
        return [(kind, digits if entity[0] != "+" else digits[1:] if digits[0] == "1" and len(digits) == 11 else "+" + digits)]
    return [(kind, entity)]


class Stream:
    """A keyed stream of numbers for an identity and a try."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.n, self.have = key, "\0".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.have) < 8:
            self.have = hmac.new(self.key, self.what + self.n.to_bytes(4, "big"), hashlib.sha256).digest()
            self.n += 1
        x, self.have = int.from_bytes(self.have[:8], "big"), self.have[8:]
        return x % n

    def pick(self, letters):
        return letters[self.below(len(letters))]


def _like(s: Stream, text: str) -> str:
    """Each digit and letter by another of its kind (hex stays hex)."""
    hexa = len(text) >= 8 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text) is not None
    low, up = ("abcdef", "ABCDEF") if hexa else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    out = []
    for c in text:
        out.append(s.pick("0123456789") if c.isdigit() else s.pick(low) if "a" <= c <= "z" else s.pick(up) if "A" <= c <= "Z" else c)
    return "".join(out)


def script_of(word: str) -> str:
    letter = next((c for c in word if c.isalpha()), "a")
    return "cyrillic" if "\u0400" <= letter <= "\u052f" else "greek" if "\u0370" <= letter <= "\u03ff" else "latin"


def _name(s: Stream, kind: str, part: str, attempt: int) -> str:
    """Begins as one name of its script and gender and ends as another; each
    attempt but the first has one more syllable in between."""
    script = script_of(part)
    gender = kind.partition("_")[2]
    names = GIVEN[script][gender] if gender else FAMILY[script]
    head, tail = s.pick(names), s.pick(names)
    cut = 2 + s.below(2)
    return head[:cut].lower() + "".join(s.pick(SYLLABLES[script]) for _ in range(attempt)) + tail[cut - 1 :].lower()


DIGITS, LOW, UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


#: Kinds of a fixed format.
FIXED = ("phone", "card", "ssn", "ip", "iban")


def form(kind: str, identity: str) -> tuple[str, list[str]] | None:
    """Of kinds whose numbers have a fixed format: its name, and the letters that each
    free place may have.  All identities of a form are its words, so a permutation of
    these maps them one to one; forms have no word in common.  None for other kinds,
    whose surrogates can always be made longer."""
    if kind not in FIXED:
        return None
    if kind == "phone":
        head = identity[:3] if identity[0] == "+" else ""
        rest = identity[len(head) :]
        # No area or exchange begins with 0 or 1 where numbers have ten digits.
        part = lambda i, d: ("23456789" if d in "23456789" else "01") if i == 0 or i == 3 and len(rest) == 10 else DIGITS
        places = [part(i, d) for i, d in enumerate(rest)]
        return f"phone {head} " + " ".join(p if len(p) < 10 else "d" for p in places), places
    if kind == "card":
        return f"card {len(identity)} {identity[0]}", [DIGITS] * (len(identity) - 2)
    if kind == "ssn":
        return "ssn", [DIGITS] * 9
    if kind == "ip":
        fixed, places = _octets(identity)
        return f"ip {fixed} {' '.join(str(len(x)) for x in identity.split('.'))} {_is_private(identity)}", places
    places = [DIGITS if c.isdigit() else UP for c in identity[4:]]
    return f"iban {identity[:2]} " + "".join("9" if p is DIGITS else "A" for p in places), places


def _is_private(ip: str) -> bool:
    return ipaddress.ip_address(ip).is_private


def _octets(ip: str) -> tuple[str, list]:
    """What stays of an address, and the numbers that its other parts may be."""
    old = ip.split(".")
    fixed = {"10": 1, "172": 2, "192": 2, "127": 1}.get(old[0], 0) if _is_private(ip) else 0
    return ".".join(old[:fixed]), [{1: range(10), 2: range(10, 100), 3: range(100, 256)}[len(o)] for o in old[fixed:]]


def number_of(kind: str, identity: str) -> int:
    """The place of an identity among the words of its form."""
    _, places = form(kind, identity)
    free = {"card": identity[1:-1], "iban": identity[4:], "phone": identity[-len(places) :]}.get(kind, identity)
    parts = [int(o) for o in identity.split(".")[-len(places) :]] if kind == "ip" else free
    n = 0
    for p, x in zip(places, parts, strict=True):
        n = n * len(p) + p.index(x)
    return n


def word_of(kind: str, identity: str, n: int) -> str:
    """The ``n``-th word of an identity's form."""
    _, places = form(kind, identity)
    parts = []
    for p in reversed(places):
        n, at = divmod(n, len(p))
        parts.append(str(p[at]))
    return _word(kind, identity, parts[::-1])


def _word(kind: str, identity: str, parts: list[str]) -> str:
    """The word of the identity's form that has ``parts`` in its free places."""
    text = "".join(parts)
    if kind == "phone":
        return (identity[:3] if identity[0] == "+" else "") + text
    if kind == "card":
        return identity[0] + text + next(d for d in DIGITS if luhn_ok(identity[0] + text + d))
    if kind == "iban":
        return f"{identity[:2]}{98 - iban_rest(identity[:2] + '00' + text):02d}{text}"
    if kind == "ip":
        return ".".join([*identity.split(".")[: 4 - len(parts)], *parts])
    return text


def size_of(kind: str, identity: str) -> float:
    """How many surrogates ``surrogate`` draws from for an identity of a fixed format."""
    found = form(kind, identity)
    if found is None:
        return float("inf")
    if kind == "ssn":
        return 100 * 99 * 9999
    return float(math.prod(len(p) for p in found[1])) / (4 if kind == "ip" else 1)  # some words are drawn for nobody


class Permutation:
    """A keyed permutation of 0 .. n - 1 and its inverse: Feistel rounds over the next
    even number of bits, again until the result is below ``n``."""

    def __init__(self, key: bytes, name: str, n: int):
        self.key, self.name, self.n = key, name.encode(), n
        self.half = max(1, -(-(n - 1).bit_length() // 2))

    def _mix(self, k: int, x: int) -> int:
        data = hmac.new(self.key, b"%d\0%d\0" % (k, x) + self.name, hashlib.sha256).digest()
        return int.from_bytes(data, "big") & ((1 << self.half) - 1)

    def _once(self, x: int, rounds) -> int:
        a, b = x >> self.half, x & ((1 << self.half) - 1)
        for k in rounds:
            a, b = b, a ^ self._mix(k, b)
        return a << self.half | b

    def at(self, x: int) -> int:
        x = self._once(x, range(8))
        while x >= self.n:
            x = self._once(x, range(8))
        return x

    def back(self, y: int) -> int:
        swap = lambda v: (v & ((1 << self.half) - 1)) << self.half | v >> self.half
        once = lambda v: swap(self._once(swap(v), reversed(range(8))))
        y = once(y)
        while y >= self.n:
            y = once(y)
        return y


def permuted(key: bytes, kind: str, identity: str) -> str:
    """The word of the identity's form that stands for it where the form has too few
    words to leave all real ones out.  Distinct identities get distinct words, none
    its own: words are in a ring in keyed order, and each gets the next.  Words that no
    identity of the form can be (a public address that is private) are passed over."""
    name, places = form(kind, identity)
    n = math.prod(len(p) for p in places)
    order = Permutation(key, name, n)
    at = order.at(number_of(kind, identity))
    while True:  # ends at the identity itself at the latest
        at = (at + 1) % n
        word = word_of(kind, identity, order.back(at))
        if form(kind, word)[0] == name:
            return word


def surrogate(key: bytes, kind: str, identity: str, attempt: int) -> str:
    """The identity that stands for another one of the kind; another for each attempt."""
    s = Stream(key, kind, identity, str(attempt))
    if kind == "email":
        local, host = identity.split("@", 1)
        labels = host.split(".")
        # A host keeps one surrogate host, below a domain that is nobody's.
        h = Stream(key, "host", host)
        name = ".".join(_like(h, x) for x in labels[:-1]) or "mail"
        return f"{_like(s, local)}{_like(s, 'a' * _longer(local, attempt))}@{re.sub('^-|-$', 'x', name)}.example"
    if kind == "key":
        return identity[:4] + _like(s, identity[4:])
    if kind == "secret":
        return _like(s, identity) + _like(s, "a" * _longer(identity, attempt))
    if kind == "ssn":
        # Area numbers from 900 on are never given out.
        return f"9{s.below(100):02d}{1 + s.below(99):02d}{1 + s.below(9999):04d}"
    if kind == "ip":
        places = [range(max(p[0], 1), min(p[-1], 254) + 1) for p in _octets(identity)[1]]
        new = _word(kind, identity, [str(s.pick(p)) for p in places])
        while _is_private(new) != _is_private(identity):
            new = _word(kind, identity, [str(s.pick(p)) for p in places])
        return new
    if (found := form(kind, identity)) is not None:
        return _word(kind, identity, [s.pick(p) for p in found[1]])
    return _name(s, kind, identity, attempt)


def _longer(text: str, attempt: int) -> int:
    """Letters that a surrogate has more than ``text``: none at first, so its length is
    kept where that leaves enough to choose from."""
    return max(0, attempt - STRICT_TRIES + 1)


def shown(kind: str, entity: str, table: dict[tuple[str, str], str], secret: bytes) -> str:
    """The mention's surrogate in the mention's format.  ``table`` has (space,
    identity) of all that the mention has."""
    if kind.startswith("name"):
        out = []
        for p, own in name_parts(entity):
            if own:
                new = table["name", p.lower()]
                out.append(new.upper() if len(p) > 1 and p.isupper() else new[0].upper() + new[1:])
            elif p[-1] == ".":  # initials are too few to be distinct
                out.append(_name(Stream(secret, "initial", p), "name", p, 0)[0].upper() + ".")
            else:
                out.append(p)
        return "".join(out)
    ((_, identity),) = identities(kind, entity)
    new = table[kind, identity]
    if kind in ("card", "ssn", "phone"):
        digits = re.sub(r"\D", "", entity)
        whole = re.sub(r"\D", "", new)
        each = iter(digits[: len(digits) - len(whole)] + whole)
        return "".join(next(each) if c.isdigit() else c for c in entity)
    if kind == "iban":
        each = iter(new)
        return "".join(c if c == " " else next(each) for c in entity)
    if kind == "email":
        return "".join(c.upper() if i < len(entity) and entity[i].isupper() else c for i, c in enumerate(new))
    return new


# --- all documents -----------------------------------------------------------

#: All kinds of names are one namespace.
SPACE = "split_part(kind, '_', 1) AS space"


def assign(entities: DataFrame, secret: bytes, make=surrogate) -> DataFrame:
    """kind, entity and a surrogate for each, all distinct (all kinds of names are one).

    None is a real entity of its kind, but where more than a quarter of the words of a
    fixed format are real: there surrogates are other words of the format in a keyed
    order, each entity's other than itself (``permuted``), which is distinct without
    any draw.  All others draw, and those that meet a real entity or another's surrogate
    draw again; of entities that draw the same the least keeps it.  At least half of
    what a format has is free, or surrogates grow by a letter or syllable, so at least
    half of those left settle in a round on average.  ``make`` draws as ``surrogate`` does.
    """

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [make(secret, k, e, a) for k, e, a in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string()), b.column(2)], ["kind", "entity", "surrogate", "attempt"])

    def formed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(k, e, f[0], size_of(k, e)) for k, e in zip(*(c.to_pylist() for c in b.columns), strict=True) if (f := form(k, e))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], ["kind", "entity", "form", "size"])

    def ringed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([permuted(secret, k, e) for k, e in zip(*(c.to_pylist() for c in b.columns), strict=True)], pa.string())], ["kind", "entity", "surrogate"])

    entities = common.staged(entities.select("kind", "entity").distinct())
    real = entities.selectExpr(SPACE, "entity AS surrogate")
    left, settled, attempt = entities, None, 0
    if make is surrogate:
        forms = entities.filter(F.col("kind").isin(*FIXED)).mapInArrow(formed, "kind string, entity string, form string, size double")
        crowded = common.staged(forms.groupBy("form", "size").count().filter("4 * count > size").select("form"))
        if not crowded.isEmpty():
            full = forms.join(crowded.hint("merge"), "form", "left_semi").select("kind", "entity")
            settled = common.staged(full.mapInArrow(ringed, "kind string, entity string, surrogate string"))
            left = common.staged(left.join(settled.select("kind", "entity").hint("merge"), ["kind", "entity"], "left_anti"))
    while True:
        asked = left.select("kind", "entity", F.lit(attempt).alias("attempt"))
        drawn = common.staged(asked.mapInArrow(draw, "kind string, entity string, surrogate string, attempt int"))
        first = drawn.selectExpr(SPACE, "*").groupBy("space", "surrogate").agg(F.min(F.struct("entity", "kind")).alias("own"))
        won = first.join(real.hint("merge"), ["space", "surrogate"], "left_anti")
        if settled is not None:
            won = won.join(settled.selectExpr(SPACE, "surrogate").hint("merge"), ["space", "surrogate"], "left_anti")
        won = common.staged(won.select("own.kind", "own.entity", "surrogate"))
        settled = won if settled is None else settled.unionByName(won)
        left = common.staged(left.join(won.select("kind", "entity").hint("merge"), ["kind", "entity"], "left_anti"))
        if left.isEmpty():
            return settled
        attempt += 1


def replaced(docs: DataFrame, secret: bytes, text: str = "text") -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and n_replaced (long).

    All columns stay, whatever their names; a column n_replaced is replaced.  Null
    and empty texts stay as they are with 0 replaced, as do texts without entities.
    Every row is treated by its own text, so keys don't matter.  An empty table
    gives no rows.  Texts and entities of any length are worked on whole.  The same
    ``secret`` gives the same surrogates but for those that had to be drawn again,
    which depend on the other entities of the table.
    """
    plain = [c for c in docs.columns if c not in (text, "n_replaced")]
    row, own = common.free_name(docs, "_row"), common.free_name(docs, "_own")
    schema = docs.select(*plain, text).schema

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that have entities, numbered, with what surrogates are drawn for."""
        n = TaskContext.get().partitionId() << 33
        for batch, texts in common.text_chunks(batches, text):
            lists = [sorted({x for _, _, k, e in find(t.decode("utf-8", "replace")) for x in identities(k, e)}) for t in texts]
            use = [i for i, x in enumerate(lists) if x]
            if use:
                got = batch.take(pa.array(use))
                pairs = pa.array([[{"kind": k, "entity": e} for k, e in lists[i]] for i in use], pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.string())])))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(range(n, n + len(use)), pa.int64()), pairs], [*plain, text, row, own])
                n += len(use)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_chunks(batches, text):
            got = batch.take(pa.array([i for i, t in enumerate(texts) if not find(t.decode("utf-8", "replace"))], pa.int64()))
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array([0] * got.num_rows, pa.int64())], [*plain, text, "n_replaced"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in common.text_chunks(batches, text):
            tables = batch.column(batch.schema.get_field_index(own)).to_pylist()
            new, counts = [], []
            for t, pairs in zip(texts, tables, strict=True):
                table = {(x["space"], x["entity"]): x["surrogate"] for x in pairs}
                t, out, at = t.decode("utf-8", "replace"), [], 0
                found = find(t)
                for a, z, k, e in found:
                    out += [t[at:a], shown(k, e, table, secret)]
                    at = z
                new.append("".join([*out, t[at:]]))
                counts.append(len(found))
            keep = [batch.column(batch.schema.get_field_index(c)) for c in plain]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(new, pa.string()), pa.array(counts, pa.int64())], [*plain, text, "n_replaced"])

    source = docs.select(*plain, text)
    wide = docs.select(*plain, text, F.lit(0).cast("long").alias(row), F.lit(None).cast("array<struct<kind:string,entity:string>>").alias(own)).schema
    found = common.staged(source.mapInArrow(marked, wide))
    pairs = found.select(row, F.explode(own).alias("x")).select(row, "x.*")
    # A part of names has one surrogate, of a gender if any of its names tells it.
    kinds = pairs.selectExpr(SPACE, "kind", "entity").groupBy("space", "entity").agg(F.max("kind").alias("kind"))
    drawn = common.staged(assign(kinds, secret).selectExpr(SPACE, "entity", "surrogate"))
    # Both sides are shuffled afresh, so Spark can split an entity that many rows have.
    mine = pairs.selectExpr(f"`{row}`", SPACE, "entity").distinct().join(drawn.hint("merge"), ["space", "entity"])
    mine = common.staged(mine.groupBy(row).agg(F.collect_list(F.struct("space", "entity", "surrogate")).alias(own)))
    done = found.drop(own).join(mine.hint("merge"), row).drop(row)
    both = source.mapInArrow(others, schema.add("n_replaced", "long")).unionByName(done.mapInArrow(put, schema))
    order = [c for c in docs.columns if c != "n_replaced"]
    return both.select(*order, "n_replaced")


#: What the query and the pipeline use where the session names no secret of its own.
DEMO_SECRET = b"demonstration key"
SETTING = "spark.skylattice.pii.secret"


def secret(spark: SparkSession) -> bytes:
    """The key of surrogates: the session's or its context's ``SETTING``, else a public one."""
    own = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING)
    return own.encode() if own else DEMO_SECRET


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir).select("doc_id", "lang", "source", "text")
    return replaced(docs, secret(spark))
