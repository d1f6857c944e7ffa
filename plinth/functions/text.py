"""Text expressions: tokens, content words, the lexical gate of the cache, tokens of a budget, formatted blocks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One part of an identifier: an acronym before a capitalised word; letters and digits with a digit right
#: behind the capitals; a word with one capital at most; capitals alone.
_PART = r"([A-Z]+(?=[A-Z][a-z])|[A-Z]*[0-9][a-z0-9]*|[A-Z]?[a-z][a-z0-9]*|[A-Z]+)"

# Words that carry no content.
STOP_WORDS = (
    "a an the is are was were be been do does did what which who whom how where when why used use for to of in on at and or with about"
    " this that these those it its i you we they"
).split()

# For each category of easily confused terms, its alternatives with their variants.
CONFUSABLE: tuple[tuple[tuple[str, ...], ...], ...] = (
    (("backend", "back-end", "back end", "server-side", "serverside", "server"), ("frontend", "front-end", "front end", "client-side", "clientside", "client")),
    (("login", "log in", "signin", "sign in"), ("logout", "log out", "signout", "sign out"), ("register", "registration", "signup", "sign up")),
    (("get",), ("post",), ("put",), ("delete",), ("patch",)),
    (("read",), ("write",)),
    (("development", "dev"), ("production", "prod")),
    (("synchronous", "sync"), ("asynchronous", "async")),
)

BLOCK_SEPARATOR = "\n\n---\n\n"


def tokens(text: Column) -> Column:
    """Lower-cased identifier parts; empty for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_PART), 1), lambda x: F.lower(x))


def content_words(text: Column) -> Column:
    """Distinct ASCII words without stop words."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; two empty ones have 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def category_bits() -> list[int]:
    """The bits of :func:`named_terms` that belong to each category."""
    out, at = [], 0
    for category in CONFUSABLE:
        out.append(((1 << len(category)) - 1) << at)
        at += len(category)
    return out


def named_terms(text: Column) -> Column:
    """The alternatives of all categories that the text names as whole words, one bit for each.

    A plain search for the variants comes before the pattern, which few texts need.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    out, at = F.lit(0).cast("bigint"), 0
    for category in CONFUSABLE:
        for variants in category:
            held = reduce(lambda a, b: a | b, (F.contains(low, F.lit(v)) for v in variants))
            out = out + F.when(held & low.rlike(r"\b(?:" + "|".join(variants) + r")\b"), F.lit(1 << at)).otherwise(F.lit(0)).cast("bigint")
            at += 1
    return out


def terms_conflict(x: Column, y: Column) -> Column:
    """Whether two columns of :func:`named_terms` have alternatives of one category and none in common."""
    out = F.lit(False)
    for bits in category_bits():
        both = F.lit(bits).cast("bigint")
        out = out | ((x.bitwiseAND(both) != 0) & (y.bitwiseAND(both) != 0) & (x.bitwiseAND(y).bitwiseAND(both) == 0))
    return out


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """``use(x)`` with ``x`` computed once, however often it occurs."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def in_conflict(a: Column, b: Column) -> Column:
    """True if both name alternatives of one category and none in common."""
    return once(F.struct(named_terms(a).alias("x"), named_terms(b).alias("y")), lambda n: terms_conflict(n["x"], n["y"]))


def lexically_compatible(a: Column, b: Column, threshold: float = 0.5) -> Column:
    return ~in_conflict(a, b) & (jaccard(content_words(a), content_words(b)) >= threshold)


def token_count(text: Column) -> Column:
    """A quarter of the characters, rounded up; 0 for empty texts."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, F.lit(0)).otherwise(F.ceil(F.length(text) / 4)).cast("bigint")


def document_text(function: Column, cls: Column, bases: Column, code: Column) -> Column:
    """What the sparse index sees of a chunk: its names, then its code."""
    return F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in (function, cls, bases, code)))


# The labels of a context block, in their order.
BLOCK_LABELS = ("Repository", "File Path", "Language", "Chunk Type", "Function Name", "Class Name", "Raw Code")


def context_block(repository: Column, path: Column, language: Column, kind: Column, function: Column, cls: Column, code: Column) -> Column:
    name = lambda c: F.coalesce(F.nullif(c, F.lit("")), F.lit("None"))
    values = (repository, path, language, kind, name(function), name(cls))
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value) for label, value in zip(BLOCK_LABELS, values, strict=False)), F.lit(f"{BLOCK_LABELS[-1]}:"), code)


def lines_of(text: Column) -> Column:
    """The lines of a text with their line ends; none for empty texts."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([^\\n]*\\n|[^\\n]+)"), 1)


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start..end, counted from 1, as one text."""
    return F.array_join(F.slice(lines, start, end - start + 1), "")


def is_test_path(path: Column) -> Column:
    return F.lower(path).contains("test") | F.lower(path).contains("spec")


def is_cited(answer: Column, path: Column, function: Column, cls: Column) -> Column:
    """The answer holds the path, and the function's name (without one: the class's; without either: the path is enough)."""
    name = F.coalesce(F.nullif(function, F.lit("")), F.nullif(cls, F.lit("")))
    return F.contains(answer, path) & (name.isNull() | F.contains(answer, name))


def first_grade(text: Column) -> Column:
    """The first digit from 1 to 5, else 1."""
    return F.coalesce(F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), "[1-5]", 0), F.lit("")).cast("int"), F.lit(1))


def fallback_phrase(function: Column, path: Column) -> Column:
    """The search phrase for tests of a function: test, its name, the file's stem."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    return F.concat_ws(" ", F.lit("test"), F.nullif(function, F.lit("")), stem)


def palette_bucket(path: Column, colours: int = 12) -> Column:
    """A colour for a path: a 31-multiplier hash of its first two segments (one if there are just two, a fixed key at the root)."""
    parts = F.split(path, "/")
    key = F.when(F.size(parts) <= 1, F.lit("root")).when(F.size(parts) == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))
    return (F.aggregate(F.split(key, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))) % colours).cast("int")


def physics_scale(nodes: Column, base: float, step: float, cap: float, free: int = 250) -> Column:
    """Grows with the nodes beyond ``free``, up to ``cap``."""
    return F.least(F.lit(base) + F.lit(step) * F.greatest(F.lit(0), nodes - free), F.lit(cap))


def node_label(function: Column, cls: Column, kind: Column, path: Column, is_file: Column) -> Column:
    return F.when(is_file, F.element_at(F.split(path, "/"), -1)).otherwise(F.coalesce(F.nullif(function, F.lit("")), F.nullif(cls, F.lit("")), kind))


def edge_key(src: Column, dst: Column, kind: Column) -> Column:
    return F.concat(src, F.lit("->"), dst, F.lit(":"), kind)


def index_stem(owner: Column, name: Column, repository_id: Column) -> Column:
    return F.when(owner.isNotNull() & name.isNotNull(), F.concat_ws("_", owner, name)).otherwise(repository_id)
