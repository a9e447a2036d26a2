"""Query text to typed segments; driver-side values, as a query is one short text."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

VERSION = re.compile(r"[vV]?\d+(?:\.\d+)+(?:[-+.]?[A-Za-z0-9]+)*")
SYMBOLS = frozenset("+#./-_@&*:")


class Segment(NamedTuple):
    type: str
    text: str


def is_cjk(char: str) -> bool:
    point = ord(char)
    return any(low <= point <= high for low, high in ((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0x20000, 0x2EBEF), (0xF900, 0xFAFF)))


def _emoji(char: str) -> bool:
    return any(low <= ord(char) <= high for low, high in ((0x1F300, 0x1FAFF), (0x2600, 0x27BF), (0x1F1E6, 0x1F1FF)))


def classify(token: str) -> Segment:
    """emoji, full-width block, version, digits, CJK, letters with digits, symbols, short or whole words, else CJK."""
    plain = unicodedata.normalize("NFKC", token)
    letters = sum(c.isascii() and c.isalpha() for c in plain)
    tests = (
        ("emoji", any(map(_emoji, token))),
        ("fullwidth", any(0xFF00 <= ord(c) <= 0xFFEF for c in token)),
        ("version", bool(VERSION.fullmatch(plain))),
        ("number", plain.isdigit()),
        ("cjk", any(map(is_cjk, token))),
        ("mixed", letters > 0 and any(c.isdigit() for c in plain)),
        ("symbol", any(c in SYMBOLS for c in plain)),
        ("ascii_short", 0 < letters < 3),
        ("ascii_word", letters > 0),
    )
    return Segment(next((name for name, holds in tests if holds), "cjk"), token)


def parse_query(query: str) -> list[Segment]:
    """NFKC, split at spaces and where CJK begins or ends, each part classified."""
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFC", query).strip())
    han = "[一-鿿㐀-䶿\U00020000-\U0002ebef豈-﫿]"
    return [classify(part) for part in re.findall(f"{han}+|[^\\s一-鿿㐀-䶿\U00020000-\U0002ebef豈-﫿]+", text)]


def expand_mixed(segments: list[Segment]) -> list[Segment]:
    """Segments of letters and digits that hold several runs, as those runs."""
    out: list[Segment] = []
    for s in segments:
        runs = re.findall(r"[A-Za-z]+|\d+", s.text) if s.type == "mixed" else []
        out += [classify(r) for r in runs] if len(runs) > 1 else [s]
    return out


def symbol_variants(token: str) -> list[str]:
    """The alphanumeric runs of a token with symbols; none where it is one run itself."""
    runs = re.findall(r"[A-Za-z0-9]+", token)
    return [] if runs == [token] else runs
