"""Check digits and reserved ranges, on plain strings: what surrogates must fail and fall into."""

from __future__ import annotations

import re

from ..functions import checksums as C
from .dates import AGE_CAP, NO_DATE, Written
from .view import digits_only, match_key

# Domains that are reserved for examples, and types that are compared token by token.
RESERVED_DOMAINS = ("example.com", "example.org", "example.net")
TOKENWISE = frozenset(("person", "street_address", "locality", "organisation"))


def _weighted(digits: str, weights: tuple[int, ...]) -> int:
    return sum(int(d) * w for d, w in zip(digits, weights, strict=False))


def luhn(d: str) -> bool:
    return len(d) >= 2 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(entity_type: str, text: str) -> bool:
    """Does ``text`` pass its type's check digit?  False for types without one."""
    d = digits_only(text)
    if entity_type == "medicare":
        d = d[:10]
        return len(d) == 10 and d[0] in "23456" and d[9] != "0" and _weighted(d, C.MEDICARE) % 10 == int(d[8])
    if entity_type in ("ihi", "hpi"):
        return len(d) == 16 and d.startswith(C.IHI_PREFIXES) and luhn(d)
    if entity_type == "tfn":
        return len(d) in (8, 9) and _weighted(d, C.TFN_9 if len(d) == 9 else C.TFN_8) % 11 == 0
    if entity_type == "abn":
        return len(d) == 11 and d[0] != "0" and (_weighted(d, C.ABN) - C.ABN[0]) % 89 == 0
    if entity_type == "acn":
        return len(d) == 9 and (10 - _weighted(d, C.ACN) % 10) % 10 == int(d[8])
    if entity_type == "card_number":
        return luhn(d)
    if entity_type == "provider_number":
        code = "".join(c for c in text if c.isalnum()).upper()
        code = "0" + code if len(code) == 7 else code
        if len(code) != 8 or not code[:6].isdigit() or code[6] not in C.PROVIDER_LOCATIONS:
            return False
        return C.PROVIDER_CHECKS[(_weighted(code, C.PROVIDER) + 6 * C.PROVIDER_LOCATIONS.index(code[6])) % 11] == code[7]
    return False


def fictional_phone(value: str) -> bool:
    d = digits_only(value)
    d = "0" + d[2:] if d.startswith("61") else d
    return d in C.FICTIONAL_MOBILES or d in C.FICTIONAL_SPECIAL or (len(d) == 10 and d[0] == "0" and d[1] in "2378" and d[2:6] in ("5550", "7010"))


def reserved_domain(value: str) -> bool:
    return value.lower().rstrip("/").endswith(RESERVED_DOMAINS)


class Originals:
    """Keys of a document's removed values; ``near``: equal to one, or one edit away from one of five or more letters."""

    def __init__(self, keys):
        self.keys = {k for k in keys if k}
        #: The keys of five or more letters without one of them, and with a hole in one's place.
        self.shorter = {k[:i] + k[i + 1 :] for k in self.keys if len(k) >= 5 for i in range(len(k))}
        self.holes = {(i, k[:i], k[i + 1 :]) for k in self.keys if len(k) >= 5 for i in range(len(k))}

    def near(self, key: str) -> bool:
        if key in self.keys:
            return True
        if len(key) < 5:
            return False
        less = {key[:i] + key[i + 1 :] for i in range(len(key))}
        if key in self.shorter or any(x in self.keys and len(x) >= 5 for x in less):
            return True  # one letter more or less
        return any((i, key[:i], key[i + 1 :]) in self.holes for i in range(len(key)))  # one letter exchanged


def surrogate_problems(items: list[tuple[str, str, list[str]]], originals: set[str], shifted: list[tuple[str, str]], ages: list[str]) -> dict[str, int]:
    """Counts by kind of problem; ``items``: type, surrogate, and its words that replaced something."""
    near = Originals(originals)
    out = dict.fromkeys(("collision", "checksum_valid", "phone_not_reserved", "domain_not_reserved", "date_collision", "date_shift_inconsistent", "age_not_top_coded"), 0)
    for entity, text, words in items:
        parts = words if entity in TOKENWISE else [text]
        out["collision"] += any((k := match_key(p)) and near.near(k) for p in parts)
        out["checksum_valid"] += valid(entity, text)
        out["phone_not_reserved"] += entity == "phone" and not fictional_phone(text)
        out["domain_not_reserved"] += entity in ("email", "url") and not reserved_domain(text)
    offsets = set()
    for before, after in shifted:
        out["date_collision"] += match_key(after) in near.keys
        a, b = Written(before).date, Written(after).date
        if a and b:
            offsets.add((b - a).days)
        elif a and after.strip() != NO_DATE:
            out["date_shift_inconsistent"] += 1
    out["date_shift_inconsistent"] += len(offsets) > 1 or 0 in offsets
    out["age_not_top_coded"] = sum(any(int(n) >= AGE_CAP for n in re.findall(r"(?<!\d)(\d{2,3})(?![\d+])", a)) for a in ages)
    return out
