"""Text functions of retrieval, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Limits of a query and of its terms.
MOST_TERM_BYTES, MOST_QUERY_BYTES, MOST_QUERY_TERMS, MOST_EXACT_BYTES = 254, 16_384, 256, 1024

#: Languages by file extension and by name.
LANGUAGE_BY_EXTENSION = {
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "cs": "csharp", "go": "go",
    "java": "java", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "kt": "kotlin", "kts": "kotlin",
    "py": "python", "pyi": "python", "rb": "ruby", "rs": "rust", "swift": "swift", "ts": "typescript", "mts": "typescript",
    "cts": "typescript", "tsx": "tsx",
}
LANGUAGE_BY_NAME = {
    "c": "c", "c++": "cpp", "cpp": "cpp", "c#": "csharp", "csharp": "csharp", "go": "go", "java": "java", "javascript": "javascript",
    "js": "javascript", "jsx": "jsx", "javascriptreact": "jsx", "kotlin": "kotlin", "python": "python", "ruby": "ruby", "rust": "rust",
    "swift": "swift", "typescript": "typescript", "ts": "typescript", "tsx": "tsx", "typescriptreact": "tsx",
}

#: Words that state, deny, or carry no context of an assertion.
STATING, DENYING = ("enabled", "true"), ("disabled", "false")
NO_CONTEXT = ("enabled", "disabled", "true", "false", "support", "supports", "supported", "must", "not", "no", "never", "do", "does")


def tokens(text: Column) -> Column:
    """Words of letters, digits and underscores in lower case; very long ones are left out."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda t: F.octet_length(t) <= MOST_TERM_BYTES)


def query_terms(query: Column) -> Column:
    """Distinct sorted terms of a query; fails for more than the limits."""
    terms = F.array_sort(F.array_distinct(tokens(query)))
    return (
        F.when(F.octet_length(query) > MOST_QUERY_BYTES, F.raise_error(F.lit("query is longer than 16384 bytes")).cast("array<string>"))
        .when(F.size(terms) > MOST_QUERY_TERMS, F.raise_error(F.lit("query has more than 256 terms")).cast("array<string>"))
        .otherwise(terms))


def exact_terms(query: Column) -> Column:
    """Parts between white space, trimmed of signs other than ``_ - / . : #``."""
    trimmed = F.transform(F.split(query, r"\s+"), lambda t: F.regexp_replace(t, r"^[^\p{L}\p{N}_/.:#-]+|[^\p{L}\p{N}_/.:#-]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(trimmed, lambda t: (t != "") & (F.octet_length(t) <= MOST_EXACT_BYTES))))


def path_terms(query: Column) -> Column:
    """The exact terms, and the whole trimmed query as a path."""
    whole = F.regexp_replace(query, r"^\s+|\s+$", "")
    return F.when(whole == "", exact_terms(query)).otherwise(F.array_union(exact_terms(query), F.array(whole)))


def looks_like_code(term: Column) -> Column:
    """Contains ``_``, ``:`` or ``#``, or a capital after the first byte."""
    return term.rlike(r"[_:#]") | term.rlike(r"(?s)^.+[A-Z]")


def identifier_terms(query: Column) -> Column:
    """Exact terms that look like code; a single term always does."""
    t = exact_terms(query)
    return F.when(F.size(t) == 1, t).otherwise(F.filter(t, looks_like_code))


def body_lines(text: Column) -> Column:
    """Lines without their ends; an end of line at the end opens no line."""
    return F.transform(F.split(F.regexp_replace(text, r"\n$", ""), "\n"), lambda x: F.regexp_replace(x, r"\r$", ""))


def line_excerpt(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` joined without a final end of line."""
    return F.array_join(F.slice(body_lines(text), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def exact_lines(text: Column, first: Column, last: Column) -> Column:
    """As :func:`line_excerpt`, null if the text has no such lines."""
    n = F.size(body_lines(text))
    return F.when((first >= 1) & (last >= first) & (last <= n), line_excerpt(text, first, last))


def kept_lines(text: Column) -> Column:
    """Lines with their ends."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"[^\n]*\n?"), F.lit(0)), lambda x: x != "")


def resolved_excerpt(text: Column, offset: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` with their ends, of a text that begins at line ``offset``."""
    return F.array_join(F.slice(kept_lines(text), F.greatest(F.lit(1), first - offset + 1), F.greatest(F.lit(0), last - first + 1)), "")


def excerpt_end(start: Column, most: Column, excerpt: Column) -> Column:
    """Last line of an excerpt that begins at ``start``, no more than ``most``."""
    n = F.when(excerpt == "", 0).otherwise(F.size(body_lines(excerpt)))
    return F.least(start + F.greatest(n - 1, F.lit(0)), most)


def base_revision(revision: Column) -> Column:
    return F.substring_index(revision, "+dirty.", 1)


def dirty_digest(revision: Column) -> Column:
    """What follows ``+dirty.``, null for a clean revision."""
    return F.when(F.instr(revision, "+dirty.") > 0, F.regexp_extract(revision, r"\+dirty\.(.*)$", 1))


def language_of_path(path: Column) -> Column:
    """Language by extension in any case; null for an unknown one."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGE_BY_EXTENSION.items() for x in kv])
    return table[F.lower(F.regexp_extract(path, r"(?:^|/)[^/]+\.([^./]+)$", 1))]


def language_with_overrides(path: Column, overrides: list[tuple[str, str]]) -> Column:
    """As :func:`language_of_path`; the last pattern that matches wins.

    Patterns are regular expressions; a name that is unknown gives null.
    """
    out = language_of_path(path)
    for pattern, name in overrides:
        out = F.when(path.rlike(pattern), F.lit(LANGUAGE_BY_NAME.get(name.lower()))).otherwise(out)
    return out


def citations(text: Column) -> Column:
    """Citations ```repo@rev:path#symbol:lines``` as array of (repo, path, symbol)."""
    found = F.regexp_extract_all(text, F.lit(r"`([^`]*)`"), F.lit(1))
    shape = r"(?s)^([^@:]+)@[^:]*:([^#]+)#([^:]+):.*$"
    return F.transform(F.filter(found, lambda x: x.rlike(shape)), lambda x: F.struct(
        F.regexp_extract(x, shape, 1).alias("repo"), F.regexp_extract(x, shape, 2).alias("path"), F.regexp_extract(x, shape, 3).alias("symbol")))


def assertion_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def _near(words: Column, word: tuple[str, ...], step: int, other: str, present: bool) -> Column:
    def hit(x: Column, i: Column) -> Column:
        beside = F.coalesce(F.get(words, i + step), F.lit(""))
        beside = F.when(i + step >= 0, beside).otherwise(F.lit(""))
        return x.isin(*word) & ((beside == other) if present else (beside != other))

    return F.exists(F.transform(words, hit), lambda b: b)


def states(words: Column) -> Column:
    """Whether words state something: enabled, true, supports, must."""
    return F.exists(words, lambda x: x.isin(*STATING)) | _near(words, ("support", "supports"), -1, "not", False) | _near(words, ("must",), 1, "not", False)


def denies(words: Column) -> Column:
    return F.exists(words, lambda x: x.isin(*DENYING)) | _near(words, ("support", "supports"), -1, "not", True) | _near(words, ("must",), 1, "not", True)


def context_words(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda x: ~x.isin(*NO_CONTEXT)))


def strong_overlap(a: Column, b: Column) -> Column:
    """At least three quarters of the larger set are shared; no set is empty."""
    return (F.size(a) > 0) & (F.size(b) > 0) & (F.size(F.array_intersect(a, b)) * 4 >= F.greatest(F.size(a), F.size(b)) * 3)


def slug(title: Column) -> Column:
    """File name of a title: ASCII letters and digits joined by single hyphens."""
    bad = title.rlike(r"[^A-Za-z0-9 _-]")
    out = F.regexp_replace(F.regexp_replace(F.lower(title), r"[ _-]+", "-"), r"^-|-$", "")
    return F.when(bad | (out == ""), F.raise_error(F.lit("title cannot be a file name")).cast("string")).otherwise(out)


def score_text(weight: Column, rank: Column) -> Column:
    return F.format_string("w=%.3f,r=%d", weight, rank)
