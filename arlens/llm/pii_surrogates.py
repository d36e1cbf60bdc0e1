"""Surrogates for personal data: keyed replacements that keep type and format.

Entities: e-mail, IPv4 and IPv6 addresses, phone numbers, payment cards (issuer prefix
and check digit must hold), IBANs (check digits must hold), US social security
numbers, labelled secrets, and personal names after a form of address with their bare
mentions (whole name or surname) anywhere in the same text.

* An entity has a canonical form (case, separators, address form and script of digits removed), so
  all its spellings, in all documents, get one surrogate: coreference stays. In a text
  a surname alone stands for the only longer name that ends with it, and a name with an
  address that tells no gender for the only one of that name that has a gender; if there
  are several such names, it is a name of its own. A surname gets the surrogate's surname.
* A surrogate is drawn from HMAC-SHA256(key, type, canonical form, attempt). It
  keeps the format: separators, letter case, length and country prefixes; cards
  and IBANs keep valid check digits; a name keeps its script (Latin, Greek or
  Cyrillic), its number of words and the gender its form of address tells; equal
  mail domains get equal surrogate domains below a reserved name.
* Distinctness: surrogates of all distinct entities of the corpus are compared
  by a join. Of entities that drew the same surrogate the first by (attempt,
  canonical form) keeps it, the others draw again, as does one that drew any
  entity's real value, until no collision is left. Mails and names get longer with every
  GROW draws, so a format that is used up is no end. The entities are a table; only
  those with a redrawn surrogate travel back to their documents.

Two passes read the texts: one finds entities, one rewrites. The result depends
on the key and the set of entities only.

Defined results: null and empty texts stay as they are; overlapping finds go to
the first by place, then by the order above; repeated rows are rewritten alike;
a row without entities keeps its text byte for byte; other columns are left
alone, and an input column with the count's name stays: the count's then gets a "_" more.
A task holds one Arrow batch of texts.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arlens.llm.common import slices, stored, text_buffer

# Forms of address and the gender they tell (fixed values).
ADDRESS = {"Mr": "m", "Mister": "m", "Sir": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Herr": "m", "Frau": "f",
           "Monsieur": "m", "Madame": "f", "Mademoiselle": "f", "Señor": "m", "Señora": "f", "Señorita": "f",
           "Dr": "n", "Prof": "n", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
_NAME = r"[^\W\d_a-zß-öø-ÿа-яё][^\W\d_]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"token|secret|password|passwd|api[_-]?key|access[_-]?key"
FIND = re.compile("|".join((
    rf"(?P<secret>(?i:\b(?:{_LABEL})\b\s*[=:]\s*[\"']?)(?P<value>[A-Za-z0-9_+/-]{{16,}}))",
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][\w.+%-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)",
    r"(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))",
    r"(?P<card>(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]))",
    r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
    r"(?P<ip6>(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:]))",
    rf"(?P<ip>(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d))",
    r"(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?!\w)"
    r"|(?<![\w+])\+(?:\d{9,15}|\d{1,3}(?:[ .-]\d{1,4}){3,6})(?!\w))",
    rf"(?P<name>\b(?P<address>{'|'.join(ADDRESS)})\b\.? (?P<who>{_NAME}(?:[ -]{_NAME}){{0,2}}))")))
TYPES = ("secret", "email", "iban", "card", "ssn", "ip6", "ip", "phone", "name")
_SCRIPTS = ("abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщьюя")
_VOWELS = ("aeiou", "αεηιο", "аеиоу")
_CONSONANTS = ("bdfghklmnprstv", "βγδκλμνπρστφ", "бвгдзклмнпрст")
#: Draws after which a mail's local part and a name get longer, again and again: a corpus may hold as
#: many mails or names of a short format as there are.
GROW = 10
# Endings that tell gender in surrogate given names (by script: m, f, n).
_ENDINGS = ({"m": "o", "f": "a", "n": "i"}, {"m": "ος", "f": "α", "n": "ι"}, {"m": "", "f": "а", "n": "и"})


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def is_card(digits: str) -> bool:
    """A length and prefix payment card issuers use, and a valid check digit."""
    n, two, four = len(digits), int(digits[:2]), int(digits[:4])
    issuer = (digits[0] == "4" and n in (13, 16, 19)) or (n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)) \
        or (n == 15 and two in (34, 37)) or (n == 16 and (four == 6011 or two == 65 or 3528 <= four <= 3589))
    return issuer and luhn(digits)


def _iban_rest(compact: str) -> int:
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97


def ascii_digits(text: str) -> str:
    """``text`` with the decimal digits of every script as ASCII digits."""
    return text if text.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in text)


def is_ip6(text: str) -> bool:
    """An IPv6 address with four decimal digits or more (shorter ones are mostly code)."""
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(c.isdigit() for c in text) >= 4


Find = tuple[str, int, int, str]


def find(text: str) -> Iterator[Find]:
    """(type, start, end, canonical form) of the entities of ``text``, in order."""
    found = list(_marked(text))
    if any(k == "name" for k, *_ in found):
        found = _names_resolved(text, found)
    yield from found


def _names_resolved(text: str, found: list[Find]) -> list[Find]:
    """``found`` with each name as the identity it stands for, and the bare mentions."""
    ids = {what for k, _, _, what in found if k == "name"}

    def gendered(what: str) -> str:
        same = {x for x in ids if x[1:] == what[1:] and x[0] != "n"}
        return same.pop() if what[0] == "n" and len(same) == 1 else what

    known = {gendered(x) for x in ids}

    def identity(what: str) -> str:
        what = gendered(what)
        longer = {x for x in known if x[2:].endswith(" " + what[2:]) and ("n" in (x[0], what[0]) or x[0] == what[0])}
        return longer.pop() if len(longer) == 1 else what

    out = [(k, a, b, identity(what) if k == "name" else what) for k, a, b, what in found]
    spelled: dict[str, set[str]] = {}
    for k, a, b, what in out:
        if k == "name":
            for form in (text[a:b], text[a:b].split(" ")[-1]):
                spelled.setdefault(form, set()).add(what)
    bare = re.compile(r"(?<!\w)(?:" + "|".join(re.escape(x) for x in sorted(spelled, key=lambda x: (-len(x), x))) + r")(?!\w)")
    at, more = 0, []
    for m in bare.finditer(text):
        while at < len(out) and out[at][2] <= m.start():
            at += 1
        if (at == len(out) or m.end() <= out[at][1]) and len(spelled[m[0]]) == 1:
            more.append(("name", *m.span(), *spelled[m[0]]))
    return sorted(out + more, key=lambda f: f[1])


def _marked(text: str) -> Iterator[Find]:
    """The entities that a form or a mark before them tells."""
    for m in FIND.finditer(text):
        kind = next(t for t in TYPES if m[t] is not None)
        start, end = m.span(kind)
        if kind == "secret":
            start, end = m.span("value")
            if not re.search(r"\d", m["value"]):
                continue
            what = m["value"].lower() if re.fullmatch(r"[0-9a-fA-F]+", m["value"]) else m["value"]
        elif kind == "email":
            what = m[kind].lower()
        elif kind == "name":
            start, end = m.span("who")
            what = f"{ADDRESS[m['address']]}:{m['who'].casefold()}"
        elif kind == "ip":
            what = ascii_digits(m[kind])
        elif kind == "ip6":
            if not is_ip6(m[kind]):
                continue
            what = ipaddress.IPv6Address(m[kind]).compressed
        else:
            what = re.sub(r"[^0-9A-Za-z+]", "", ascii_digits(m[kind]))
            if kind == "card" and not is_card(what) or kind == "iban" and (not 15 <= len(what) <= 34 or _iban_rest(what) != 1) \
                    or kind == "phone" and not 9 <= len(what.strip("+")) <= 15:
                continue
        yield kind, start, end, what


class _Draw:
    """Numbers below given bounds from a keyed stream."""

    def __init__(self, key: bytes, *what: object):
        self.key, self.what, self.block, self.pool = key, "|".join(map(str, what)), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 40:
            digest = hmac.new(self.key, f"{self.what}#{self.block}".encode(), hashlib.sha256).digest()
            self.pool, self.left, self.block = int.from_bytes(digest), 1 << 256, self.block + 1
        self.pool, out = divmod(self.pool, n)
        self.left //= n
        return out

    def like(self, text: str, number: bool = False) -> str:
        """Letters for letters and digits for digits; hexadecimal stays so. The digits of a
        ``number``, however many, are never taken for hexadecimal."""
        hexa = not number and re.fullmatch(r"[0-9a-f]+", text) is not None and len(text) >= 16
        out = []
        for c in text:
            if hexa:
                out.append("0123456789abcdef"[self.below(16)])
            elif c.isdigit():
                out.append(str(self.below(10)))
            elif "a" <= c.lower() <= "z":
                x = chr(97 + self.below(26))
                out.append(x if c.islower() else x.upper())
            else:
                out.append(c)
        return "".join(out)


def surrogate(key: bytes, kind: str, what: str, attempt: int = 0) -> str:
    """The canonical form of the replacement of the entity ``what``."""
    draw = _Draw(key, kind, what, attempt)
    if kind == "email":
        local, domain = what.rsplit("@", 1)
        host = _Draw(key, "domain", domain)
        top = domain.rsplit(".", 1)[-1]
        label = "".join("abcdefghijklmnopqrstuvwxyz"[host.below(26)] for _ in range(10))
        new = draw.like(local) + "".join("abcdefghijklmnopqrstuvwxyz"[draw.below(26)] for _ in range(attempt // GROW))
        return f"{new}@{label}.example.{top if top in ('com', 'net', 'org') else 'com'}"
    if kind == "ip":
        return ".".join(str(x) for x in (1 + draw.below(223), draw.below(256), draw.below(256), 1 + draw.below(254)))
    if kind == "ip6":
        groups = ("123456789abcdef"[draw.below(15)] + "".join("0123456789abcdef"[draw.below(16)] for _ in g[1:]) if g else "" for g in what.split(":"))
        return ":".join(groups)
    if kind == "card":
        keep = 1 if what[0] == "4" else 4
        body = what[:keep] + draw.like(what[keep:-1], number=True)
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = draw.like(what[4:], number=True)
        return f"{what[:2]}{98 - _iban_rest(what[:2] + '00' + body):02d}{body}"
    if kind == "phone":
        # The digits before the last nine (country code) stay.
        cut = len(what) - 10 if what.startswith("+") and len(what) > 10 else 0
        return what[:cut] + draw.like(what[cut:])
    if kind == "name":
        gender, name = what.split(":", 1)
        script = next((i for i, s in enumerate(_SCRIPTS) if any(c in s for c in name)), 0)
        words = re.split(r"([ -])", name)
        for i in range(0, len(words), 2):
            size = max(2, (len(words[i]) + 1) // 2) + (attempt > 3) + attempt // GROW
            body = "".join(_CONSONANTS[script][draw.below(len(_CONSONANTS[script]))] + _VOWELS[script][draw.below(len(_VOWELS[script]))] for _ in range(size))
            words[i] = body[:-1] + _ENDINGS[script][gender] if i == 0 and len(words) > 1 else body
        return f"{gender}:{''.join(words)}"
    return draw.like(what)


def render(kind: str, found: str, core: str) -> str:
    """``core`` in the spelling of ``found``: its separators and its letter case."""
    if kind == "name":
        # A mention of the last words of a name gets those of its surrogate.
        words = re.split(r"([ -])", core.split(":", 1)[1])[-len(re.split(r"([ -])", found)):]
        return "".join(w.upper() if found.isupper() else w.capitalize() for w in words)
    if kind in ("card", "iban", "ssn", "phone"):
        rest = iter(core)
        new = (next(rest) if c.isalnum() or c == "+" else c for c in found)
        # A digit of another script gives way to one of the same script.
        return "".join(chr(ord(c) - unicodedata.decimal(c) + int(x)) if c.isdecimal() and not c.isascii() else x for c, x in zip(found, new, strict=True))
    return core.upper() if found.isupper() and any(c.isalpha() for c in found) else core


# What a text without an @ and with under four digits may still hold: a form of address or a
# secret's label before its sign. Letters that Python's re folds into ASCII ones are spelled out.
_HINT = "|".join((*ADDRESS, "(?i:" + _LABEL.replace("s", "[s\u017f]").replace("k", "[k\u212a]").replace("i", "[i\u0130\u0131]") + ")"))


def _suspects(col: pa.Array) -> np.ndarray:
    """Rows that may hold an entity: an @, four digits of any script, a form of
    address or a secret's label. No row that ``find`` finds something in is left out."""
    data, off = text_buffer(col)
    hot = np.zeros(len(col), bool)
    for i, j in slices(off):
        part, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
        digits = np.append(0, np.cumsum((part >= 48) & (part <= 57)))
        ats = np.append(0, np.cumsum(part == 64))
        hot[i:j] = (digits[o[1:]] - digits[o[:-1]] >= 4) | (ats[o[1:]] > ats[o[:-1]])
    if len(col):
        hot |= np.asarray(pc.fill_null(pc.match_substring_regex(col, _HINT), False))
        hot |= np.asarray(pc.fill_null(pc.match_substring_regex(col, r"[^\P{Nd}0-9]"), False))
    return np.flatnonzero(hot)


_FOUND = "array<struct<type:string,what:string>>"


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text_hash, type, what) of the entities of every row, stored."""
    kind = pa.list_(pa.struct([("type", pa.string()), ("what", pa.string())]))

    @F.arrow_udf(_FOUND)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in parts:
            out: list = [None] * len(col)
            for i in _suspects(col):
                out[i] = [{"type": k, "what": w} for k, w in sorted({(k, w) for k, _, _, w in find(col[int(i)].as_py())})]
            yield pa.array(out, kind)

    rows = docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.explode(run(F.col(text))).alias("e"))
    return stored(rows.select("doc_id", "text_hash", "e.type", "e.what"), "entities")


def settled(found: DataFrame, key: bytes, rounds: int = 50) -> DataFrame:
    """(type, what, attempt, core) of every distinct entity, all cores distinct per type."""
    @F.arrow_udf("string")
    def draw(kind: pa.Array, what: pa.Array, attempt: pa.Array) -> pa.Array:
        return pa.array([surrogate(key, k, w, a) for k, w, a in zip(kind.to_pylist(), what.to_pylist(), attempt.to_pylist(), strict=True)], pa.string())

    def drawn(rows: DataFrame) -> DataFrame:
        return rows.select("type", "what", "attempt", draw("type", "what", "attempt").alias("core"))

    now = stored(drawn(found.select("type", "what").distinct().withColumn("attempt", F.lit(0))), "surrogates")
    real = now.select(F.col("type").alias("rt"), F.col("what").alias("rw"))
    for _ in range(rounds):
        best = now.groupBy("type", "core").agg(F.min(F.struct("attempt", "what")).alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        twice = now.join(best, ["type", "core"]).filter(F.col("what") != F.col("best.what")).select("type", "what")
        taken = now.join(real, (F.col("type") == F.col("rt")) & (F.col("core") == F.col("rw")), "left_semi").select("type", "what")
        losers = stored(twice.unionByName(taken).distinct(), "collisions")
        if not losers.limit(1).count():
            return now
        again = drawn(now.join(losers, ["type", "what"], "left_semi").withColumn("attempt", F.col("attempt") + 1))
        now = stored(now.join(losers, ["type", "what"], "left_anti").unionByName(again), "surrogates")
    raise RuntimeError(f"surrogates still collide after {rounds} draws: too many entities for their format")


def pseudonymise(docs: DataFrame, key: str, text: str = "text", into: str | None = None, count: str = "n_entities") -> DataFrame:
    """``docs`` with entities replaced in ``into`` (default: the text column) and
    ``count``, the number of places replaced."""
    secret = key.encode()
    while count in docs.columns:
        count += "_"
    found = entities(docs, text)
    redrawn = stored(settled(found, secret).filter("attempt > 0"), "redrawn")
    kind = pa.struct([("text", pa.string()), ("n", pa.int64())])

    @F.arrow_udf("text string, n bigint")
    def rewrite(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for col, redo in parts:
            if isinstance(redo, pa.Scalar):
                redo = pa.nulls(len(col))
            changed: dict[int, str] = {}
            n = np.zeros(len(col), np.int64)
            for i in map(int, _suspects(col)):
                old, out, at = col[i].as_py(), [], 0
                attempts = {(x["type"], x["what"]): x["attempt"] for x in redo[i].as_py() or ()}
                for k, a, b, what in find(old):
                    out += [old[at:a], render(k, old[a:b], surrogate(secret, k, what, attempts.get((k, what), 0)))]
                    at, n[i] = b, n[i] + 1
                if out:
                    changed[i] = "".join(out) + old[at:]
            mask = np.zeros(len(col), bool)
            mask[list(changed)] = True
            new = pc.replace_with_mask(col, pa.array(mask), pa.array([changed[i] for i in sorted(changed)], col.type))
            yield pa.StructArray.from_arrays([new.cast(pa.string()), pa.array(n)], fields=list(kind))

    rows = docs
    if redrawn.limit(1).count():
        per_row = (found.join(redrawn, ["type", "what"]).groupBy(F.col("doc_id").alias("_pii_id"), F.col("text_hash").alias("_pii_hash"))
                   .agg(F.collect_set(F.struct("type", "what", "attempt")).alias("_pii_redo")))
        per_row = stored(per_row, "redrawn-rows")
        rows = docs.join(per_row, docs["doc_id"].eqNullSafe(per_row["_pii_id"]) & (F.xxhash64(docs[text]) == per_row["_pii_hash"]), "left").drop("_pii_id", "_pii_hash")
    else:
        rows = docs.withColumn("_pii_redo", F.lit(None).cast("array<struct<type:string,what:string,attempt:int>>"))
    rows = rows.withColumn("_pii", rewrite(F.col(text), F.col("_pii_redo")))
    return rows.withColumns({into or text: F.col("_pii")["text"], count: F.col("_pii")["n"]}).drop("_pii", "_pii_redo")
