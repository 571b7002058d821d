"""Secret scans: a keyword automaton, anchored patterns at its hits, checksums inside the tokens."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievegate.llm.common import map_batches

# Keywords, token formats of public services, and the order of kinds.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "checked_token", "google_key", "jwt", "private_key", "card", "iban")
PATTERNS = {
    "checked_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
                      re.compile(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")),
    "google_key": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    "jwt": (("eyj",), re.compile(r"(eyJ[0-9A-Za-z_-]+)\.(eyJ[0-9A-Za-z_-]+)\.[0-9A-Za-z_-]+")),
    "private_key": (("-----begin ",), re.compile(
        r"-----BEGIN [A-Z ]*PRIVATE KEY-----[0-9A-Za-z+/=\s]+-----END [A-Z ]*PRIVATE KEY-----")),
    "card": (("card", "visa", "mastercard"), re.compile(
        r"(?i:card|visa|mastercard)[^0-9\n]{0,20}([0-9](?:[ -]?[0-9]){12,18})(?![0-9])", re.ASCII)),
    "iban": (("iban",), re.compile(
        r"(?i:iban)[^0-9A-Za-z\n]{0,5}([A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30})(?![0-9A-Za-z])", re.ASCII)),
}
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
TO_LOWER = {ord(c): ord(c.lower()) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
ADDED = ("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
         "secrets array<struct<kind:string,start:long,end:long,text:string>>")


def base62(value: int, width: int) -> str:
    digits = ""
    while value:
        value, digit = divmod(value, 62)
        digits = DIGITS62[digit] + digits
    return digits.rjust(width, "0")


def luhn(digits: str) -> bool:
    total = 0
    for i, digit in enumerate(reversed(digits)):
        doubled = int(digit) * (1 + i % 2)
        total += doubled - 9 * (doubled > 9)
    return total % 10 == 0


def sound(kind: str, match: re.Match) -> bool:
    """Checksum or structure inside a match."""
    if kind == "assign":
        return len(match.group(2)) >= 8
    if kind == "access":
        return len(match.group()) >= 16
    if kind == "checked_token":
        return base62(zlib.crc32(match.group(1).encode()), 6) == match.group(2)
    if kind == "jwt":
        part = match.group(1)
        try:
            return "alg" in json.loads(base64.urlsafe_b64decode(part + "=" * (-len(part) % 4)))
        except (ValueError, TypeError, binascii.Error):
            return False
    if kind == "card":
        return luhn(re.sub("[ -]", "", match.group(1)))
    if kind == "iban":
        code = match.group(1).replace(" ", "")
        return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1
    return True


def automaton() -> ahocorasick.Automaton:
    """Lower-cased keywords of all patterns but the hexadecimal run, which has none."""
    kinds: dict[str, list] = {}
    for word in ASSIGN_WORDS:
        kinds.setdefault(word, []).append(("assign", ASSIGN))
    kinds.setdefault("akia", []).append(("access", ACCESS))
    for kind, (words, pattern) in PATTERNS.items():
        for word in words:
            kinds.setdefault(word, []).append((kind, pattern))
    built = ahocorasick.Automaton()
    for word, found in kinds.items():
        built.add_word(word, (len(word), found))
    built.make_automaton()
    return built


def find_secrets(text: str, keywords: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and kind.

    A pattern is only tried where a keyword begins, and not inside the pattern's last match: the
    same matches as a search from left to right. The lower-cased copy has the same length, so that
    offsets hold; str.lower is taken where it keeps the length, else A-Z alone.
    """
    low = text.lower()
    if len(low) != len(text):
        low = text.translate(TO_LOWER)
    begins = sorted(
        ((last - length + 1, kind, pattern) for last, (length, kinds) in keywords.iter(low)
         for kind, pattern in kinds), key=lambda b: b[:2])
    spans, ends = [], dict.fromkeys(KINDS, 0)
    for start, kind, pattern in begins:
        if start >= ends[kind] and (match := pattern.match(text, start)):
            ends[kind] = match.end()
            if sound(kind, match):
                spans.append((start, match.end(), kind))
    spans += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add n_assign, n_access, n_hex, base_sha256, spans and secrets to every document.

    `spans` lists kind:start:end in code points, end exclusive, by start and then kind in the order
    of KINDS; base_sha256 is the digest of the first three kinds in that form. Spans of different
    kinds may overlap. Formats with a checksum inside count only if it holds. Null and empty texts
    have no secrets. Columns in `drop` are left out; columns of the added names are replaced. Whole texts are scanned, row by row.
    """

    def start():
        keywords = automaton()

        def work(texts):
            counts = {k: [] for k in KINDS[:3]}
            digests, listed, secrets = [], [], []
            for text in texts.to_pylist():
                found = find_secrets(text, keywords) if text else []
                said = [(k, f"{k}:{s}:{e}") for s, e, k in found]
                for kind, numbers in counts.items():
                    numbers.append(sum(k == kind for k, _ in said))
                base = ",".join(x for k, x in said if k in counts)
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                listed.append(",".join(x for _, x in said))
                secrets.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for s, e, k in found])
            return *counts.values(), digests, listed, secrets

        return work

    return map_batches(docs, [F.col("text").cast("string")], ADDED, start, drop)
