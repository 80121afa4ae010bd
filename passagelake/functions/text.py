"""Text functions as Column expressions; full Unicode folding and CJK terms as an Arrow UDF."""

from __future__ import annotations

import re
import unicodedata
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words without retrieval value, English and CJK (fixed values).
STOPWORDS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or",
    "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
]
CJK_STOPWORDS = ("的", "了", "和", "是", "在", "我", "有", "就", "不", "人", "都", "一", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "看", "好")
# A word of a folded text (fixed value).
WORD = r"[a-z0-9]++(?:['\-_][a-z0-9]++)*+"
# First and last code points of the scripts that are indexed by character (fixed values).
CJK_RANGES = [(0x1100, 0x11FF), (0x3040, 0x30FF), (0x3130, 0x318F), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xA960, 0xA97F), (0xD7B0, 0xD7FF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF)]


def _plain_letters() -> dict[str, str]:
    """Lower-case accented Latin letters and the letter each is without its marks."""
    out = {}
    for code in range(0xC0, 0x180):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and chr(code) == chr(code).lower():
            out[chr(code)] = base[0]
    return out


_PLAIN = _plain_letters()


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin script; texts in ASCII skip the slow translation."""
    low = F.lower(text)
    folded = F.translate(F.replace(low, F.lit("ß"), F.lit("ss")), "".join(_PLAIN), "".join(_PLAIN.values()))
    return F.when(F.octet_length(low) == F.char_length(low), low).otherwise(folded)


def words(text: Column, remove_stopwords: bool = True) -> Column:
    """Terms of Latin-script text, in order; without stop words and single letters unless told otherwise."""
    found = F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    if not remove_stopwords:
        return found
    return F.filter(found, lambda w: ~w.isin(STOPWORDS) & ((F.length(w) >= 2) | w.rlike("^[0-9]$")))


_CJK = "".join(f"{chr(a)}-{chr(b)}" for a, b in CJK_RANGES)
_STOP = frozenset(STOPWORDS)
_RUNS = re.compile(f"([{_CJK}]+)|({WORD})")


def folded(text: str) -> str:
    """Compatibility forms, lower case, no accents and no invisible characters; composed where a letter needs it."""
    if text.isascii():
        return text.lower()
    apart = unicodedata.normalize("NFD", unicodedata.normalize("NFKC", text).casefold())
    return unicodedata.normalize("NFC", apart.translate(_DROPPED))


class _Dropped(dict):
    """A translation that drops marks and format characters, and remembers those it has met."""

    def __missing__(self, code: int) -> int | None:
        self[code] = None if unicodedata.category(chr(code)) in ("Mn", "Cf") else code
        return self[code]


_DROPPED = _Dropped()


def terms(text: str | None, remove_stopwords: bool = True) -> list[str]:
    """Terms of any text: words, and for each run of CJK characters these and then their pairs."""
    out: list[str] = []
    for found in _RUNS.finditer(folded(text or "")):
        run, word = found.groups()
        if word:
            empty = remove_stopwords and (word in _STOP or len(word) == 1 and not word.isdigit())
            out += [] if empty else [word]
        else:
            out += [c for c in run if not remove_stopwords or c not in CJK_STOPWORDS]
            out += map("".join, pairwise(run))
    return out


def any_words(text: Column, remove_stopwords: bool = True) -> Column:
    """As :func:`words`, for every script: only texts that the expressions cannot fold go through Python."""

    @F.arrow_udf("array<string>")
    def by_python(batch: pa.Array) -> pa.Array:
        return pa.array([None if t is None else terms(t, remove_stopwords) for t in batch.to_pylist()], pa.list_(pa.string()))

    # Python gets nulls for all other texts and answers with nulls, so that each text is judged once; one in ASCII by its length.
    low = F.lower(text)
    simple = (F.octet_length(low) == F.char_length(low)) | low.rlike(f"^[\\x00-\\x7F]*+(?:[ß{''.join(_PLAIN)}]++[\\x00-\\x7F]*+)*+$")
    return F.coalesce(by_python(F.when(~simple, text)), words(text, remove_stopwords))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    """Sentences with their closing mark, white space between them dropped."""
    return F.filter(F.split(text, r"(?<=[.!?。！？;；…\n])\s*"), lambda s: strip(s) != "")


def hard_cut(text: Column, size: int, overlap: int) -> Column:
    """Windows of ``size`` characters at a stride of ``size - overlap``."""
    step = max(1, size - overlap)
    starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(size)))


def token_estimate(text: Column) -> Column:
    """A chunk's rough token count: a token for four characters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def message_tokens(text: Column, calls: Column | None = None) -> Column:
    """A message's rough token count: its text and four for the frame; for each tool call (name, arguments) these and six."""
    cost = text_tokens(text) + 4
    if calls is not None:
        each = F.transform(F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")), lambda c: text_tokens(c["name"]) + text_tokens(c["arguments"]) + 6)
        cost = cost + F.aggregate(each, F.lit(0).cast("long"), lambda s, x: s + x)
    return cost.cast("long")


def structural(line: Column) -> Column:
    """Headings, fences, rules, quotes: lines that carry no sentence."""
    return line.rlike(r"^\s*(#{1,6}\s|```|-{3,}|={3,}|>)")


def content_id(*parts: Column) -> Column:
    """The first 32 hex digits of the SHA-256 of the parts, joined by NUL."""
    joined = [x for p in parts for x in (F.lit("\0"), p.cast("string"))][1:]
    return F.substring(F.sha2(F.concat(*joined), 256), 1, 32)


# Names, beginnings and ends of names that credentials have (fixed values).
SENSITIVE_NAMES = [".netrc", ".pgpass", ".npmrc", ".pypirc", ".git-credentials", "credentials", "token", "tokens", "env"]
SENSITIVE_STARTS = [".env", "id_", "secret", "credential", "private_key", "keystore"]
SENSITIVE_ENDS = [".pem", ".key", ".p12", ".pfx", ".jks", ".keystore", ".kdbx", ".gpg", ".asc", ".env"]


def sensitive_name(name: Column) -> Column:
    """File names that look like credentials."""
    n = F.lower(name)
    found = n.isin(SENSITIVE_NAMES) | n.contains(".env")
    for s in SENSITIVE_STARTS:
        found = found | n.startswith(s)
    for s in SENSITIVE_ENDS:
        found = found | n.endswith(s)
    return found


def clipped(text: Column, limit: int) -> Column:
    """White space runs as one blank each, and at most ``limit`` characters, the last of them an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def first_clause(text: Column, limit: int) -> Column:
    """A preview of at most ``limit`` characters, cut at a blank if there is one, with an ellipsis."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    head = F.substring(flat, 1, limit)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(head, " [^ ]*$", ""), F.lit("…")))


def text_tokens(text: Column) -> Column:
    """A text's rough token count: four other characters or one CJK character."""
    t = F.coalesce(text, F.lit(""))
    cjk = F.regexp_count(t, F.lit("[\\u4E00-\\u9FFF\\u3040-\\u30FF\\uAC00-\\uD7AF\\u3400-\\u4DBF]"))
    return (F.ceil((F.length(t) - cjk) / 4) + cjk).cast("long")


# Types of files by suffix (fixed values); others are plain text.
MIME_TYPES = {
    "md": "text/markdown", "markdown": "text/markdown", "py": "text/x-python", "js": "text/javascript", "ts": "text/typescript", "json": "application/json",
    "yaml": "application/x-yaml", "yml": "application/x-yaml", "html": "text/html", "csv": "text/csv", "sql": "text/x-sql",
}


def mime_type(suffix: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.coalesce(known[F.lower(F.ltrim(suffix, F.lit(".")))], F.lit("text/plain"))
