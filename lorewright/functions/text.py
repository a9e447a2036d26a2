"""Text functions. Columns where Spark can express them; Arrow-backed pandas UDFs for Unicode forms and the like."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: CJK ideographs (fixed ranges).
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2EBEF}\x{F900}-\x{FAFF}"
#: Technical terms spelled for slugs (fixed values).
SLUG_TERMS = {"C++": "cpp", "C#": "csharp", ".NET": "dotnet", "Node.js": "nodejs", "F#": "fsharp", "T-SQL": "tsql", "C/C++": "c-cpp"}
SLUG_LENGTH = 40
#: Full-width punctuation of front matter and its half-width forms (fixed values).
PUNCTUATION = ("　：，“”‘’", " :,\"\"''")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), for which value is worked out once a row however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _form(form: str):
    @F.pandas_udf("string")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize(form, s))

    return apply


def to_nfc(text: Column) -> Column:
    return _form("NFC")(text)


def to_nfkc(text: Column) -> Column:
    return _form("NFKC")(text)


def has_nfd_residual(text: Column) -> Column:
    """Whether the text is not in NFC; ASCII texts never leave the JVM's answer."""
    return F.when(text.rlike(r"^[\x00-\x7F]*$"), F.lit(False)).otherwise(to_nfc(text) != text)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def ascii_mask(text: Column) -> Column:
    """Non-ASCII characters become spaces."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", " ")


def fix_punctuation(text: Column) -> Column:
    return F.translate(text, *PUNCTUATION)


def body_spacing(text: Column) -> Column:
    return F.translate(text, "　", " ")


def is_cjk(char: Column) -> Column:
    return char.rlike(f"^[{CJK}]$")


def has_cjk_and_ascii(values: Column) -> Column:
    return F.exists(values, lambda v: v.rlike(f"[{CJK}]")) & F.exists(values, lambda v: v.rlike("[A-Za-z]"))


def slug(title: Column) -> Column:
    """Terms spelled out, other than CJK and ASCII letters, digits and dashes dashed, dashes collapsed, at most 40
    characters; null where nothing is left. The title is expected in NFC."""
    for term in sorted(SLUG_TERMS, key=len, reverse=True):
        title = F.replace(title, F.lit(term), F.lit(SLUG_TERMS[term]))
    dashed = F.regexp_replace(F.regexp_replace(title, f"[^{CJK}0-9A-Za-z-]", "-"), "-+", "-")
    cut = F.rtrim(F.substring(F.trim(dashed, F.lit("-")), 1, SLUG_LENGTH), F.lit("-"))
    return F.nullif(cut, F.lit(""))


def trigrams(text: Column) -> Column:
    """Character trigrams; a shorter text is itself, an empty one none."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast("array<string>")).when(n <= 3, F.array(text)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))


def content_hash(*parts: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, one a line."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 where a norm is."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a row of its table as the bits of one integer."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    row = whole
    for c in b:
        met = row & places.get(c, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """2 * LCS / (m + n); 1 for two empty texts."""
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def snippet(title: Column, body: Column, needles: list[str], before: int = 24, after: int = 36, plain: int = 96) -> Column:
    """Around the first needle (in the order given) found whatever its case, else the start; of the body, else the title."""
    text = F.coalesce(F.nullif(body, F.lit("")), title)
    low = F.lower(text)
    cuts = []
    for needle in needles:
        at = F.instr(low, needle.lower())
        start = F.greatest(at - before, F.lit(1))
        cuts.append(F.when(at > 0, F.substring(text, start, at + len(needle) + after - start)))
    return F.trim(F.coalesce(*cuts, F.substring(text, 1, plain)))


_LINK = re.compile(r"(!?\[[^\]]*\]\()(<[^>]*>|[^)\s]+)((?:\s+\"[^\"]*\")?\))")


def rewrite_links(body: str, old_path: str, new_path: str, moved: dict[str, str]) -> str:
    """Relative links of a file that moves from old_path to new_path, their targets moved as `moved` (paths) says. External
    links and bare fragments stay, as do fragments of moved targets and angle brackets."""
    import posixpath

    def one(m: re.Match) -> str:
        raw = m[2]
        angled = raw.startswith("<")
        target = raw[1:-1] if angled else raw
        path, mark, fragment = target.partition("#")
        if not path or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", path):
            return m[0]
        full = posixpath.normpath(posixpath.join(posixpath.dirname(old_path), path))
        there = posixpath.relpath(moved.get(full, full), posixpath.dirname(new_path) or ".")
        if full not in moved and posixpath.dirname(old_path) == posixpath.dirname(new_path):
            there = path
        spelled = there + mark + fragment
        return m[1] + (f"<{spelled}>" if angled else spelled) + m[3]

    return _LINK.sub(one, body)
