"""Column expressions; none of them leaves the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Programming languages by file suffix.
LANGUAGES = {"php": "php", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "py": "python", "pyi": "python", "ts": "typescript", "tsx": "typescript", "go": "go", "cs": "csharp"}


def make_id(file: Column, symbol: Column) -> Column:
    return F.substring(F.sha2(F.concat(file, F.lit("::"), symbol), 256), 1, 16)


def point_id(key: Column) -> Column:
    """The key's MD5 modulo 2 ** 53."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 19, 14), 16, 10).cast("bigint").bitwiseAND(F.lit((1 << 53) - 1))


def bare_name(name: Column, dots: bool = True) -> Column:
    return F.element_at(F.split(name, r"::|\\|\." if dots else r"::|\\"), -1)


def callee(context: Column) -> Column:
    """Last `name(` of a call text; without one, its last piece."""
    calls = F.regexp_extract_all(context, F.lit(r"(?U)\b(\w+)\s*\("), F.lit(1))
    return F.coalesce(F.try_element_at(calls, F.lit(-1)), F.trim(F.element_at(F.split(context, r"[:.\s]"), -1)))


def search_tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-zA-Z0-9_]+"), lambda x: F.length(x) > 1)


def words(text: Column) -> Column:
    """Distinct Unicode words, lower-cased: the tokens that make `\\bname\\b` an equi-join."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\W+"), lambda x: x != ""))


def word_regex(name: str) -> str:
    return rf"(?iU)\b{re.sub(r'([^A-Za-z0-9_])', r'\\\1', name)}\b"


def contains_ci(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def path_segments(path: Column) -> Column:
    """Path without outer slashes, lower-cased, placeholders as *, by segment."""
    p = F.lower(F.trim(F.regexp_replace(path, "^/+|/+$", "")))
    p = F.regexp_replace(p, r"\$\{[^}]*\}", "*")
    p = F.regexp_replace(p, r"\{[^}]*\}|<[^>]*>", "*")
    return F.split(F.regexp_replace(p, r"(^|/):\w+", "$1*"), "/")


def paths_match(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: (x == y) | (x == "*") | (y == "*")), lambda v: v)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def csv_list(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def language_of(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"\.(\w+)$", 1))
    return F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix)


def first_array(text: Column, n: int) -> Column:
    """The JSON array of texts in an answer, fences and other words around it left out; always n entries, null where there is none."""
    bare = F.trim(F.regexp_replace(text, r"```[a-z]*\n?", ""))
    whole = F.from_json(bare, "array<string>")
    part = F.from_json(F.regexp_extract(bare, r"(?s)\[.*\]", 0), "array<string>")
    found = F.coalesce(F.when(F.forall(whole, lambda x: F.lit(True)) & (F.size(whole) == n), whole), part, F.array().cast("array<string>"))
    padded = F.slice(F.concat(found, F.array_repeat(F.lit(None).cast("string"), n)), 1, n)
    return F.transform(padded, lambda x: F.when(x != "", x))


def comment_text(raw: Column) -> Column:
    """A comment without its marks, cut at 500 characters; null below three."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^(?:/{2,}|/?\*+|#+|<!--)\s*|\s*(?:\*+/|-->)$", ""))
    return F.when(F.length(bare) >= 3, F.substring(bare, 1, 500))


def percent(x: Column) -> Column:
    return F.concat(F.round(100 * x).cast("int").cast("string"), F.lit("%"))


def bar(n: Column, most: int = 20) -> Column:
    return F.repeat(F.lit("\u2588"), F.least(n, F.lit(most)).cast("int"))


def brief(text: Column, most: int) -> Column:
    return F.substring(text, 1, most)
