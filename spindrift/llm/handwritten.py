"""Generated, minified or vendored source files, told apart from hand-written ones.

Workers read every text once and keep its identifiers with their numbers; what
follows works on these. Character n-gram models of identifiers are trained for
each language (taken from the syntax of the text, since the recorded language is
null or written in several ways): first on all distinct texts that no place,
list or header gives away, then again without those that the first models find
unusual, so that the models know hand-written names only. A file is judged by
these legs, each of which may decide alone:

* ``entropy``, mangled names: the cross-entropy of its identifiers is far above
  the usual: minified and bundled scripts;
* ``diversity``, template-like names: next to no different names once digits are
  masked: output of a tool; ``nameless``: next to no names at all: data saved as
  code;
* ``style``, foreign naming: the cross-entropy is well above the usual, though
  not as that of mangled names; less is enough where a header hints at an owner;
* ``owner`` and ``tool``: a header of another owner, or of a tool;
* ``place``, ``name`` and ``list``: a place for other people's code, a name that
  tools give, or a digest in the list of third-party releases.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.operators.snapshots import normal_digest
from spindrift.tables import arrow_batches, broadcast_if_small, cut

#: Symbols of identifiers; all other letters count as the last.
ALPHABET = "^$abcdefghijklmnopqrstuvwxyz0_A?"
_SIZE = len(ALPHABET)
_AT = {c: i for i, c in enumerate(ALPHABET)}
_SYMBOL = np.full(128, _AT["?"], np.int64)
for _c in range(128):
    _ch = chr(_c)
    _SYMBOL[_c] = _AT["0"] if _ch.isdigit() else _AT["A"] if _ch.isupper() else _AT.get(_ch, _AT["?"]) if _ch not in "^$?" else _AT["?"]

#: Bits a character by which identifiers of a file exceed the usual: mangled
#: ones, those of a foreign style, and foreign ones in a file that names an owner.
MANGLED_EXCESS, FOREIGN_EXCESS, OWNED_EXCESS = 3.0, 2.2, 0.35
#: Bits beyond which a text is left out of the second training.
UNUSUAL_EXCESS = 0.3
LOW_DIVERSITY, NAMED_SHARE = 0.06, 0.1
#: Letters of names a text needs before its names are judged.
LEAST_NAMES = 12
#: What tells a language by its syntax.
SYNTAX = {
    "rust": ("fn ", "let mut ", "::", "&mut ", "impl "),
    "go": ("func ", ":= ", "!= nil", "defer "),
    "kotlin": ("fun ", "val ", "?: "),
    "ruby": ("\nend", ".each {", " unless ", " do |"),
    "python": ("def ", "):\n", " in ", "elif "),
    "java": ("public class ", "Map ", ".put(", "@Override", "static int "),
    "c": ("struct ", "->", "goto ", "#include", "void "),
    "script": ("function ", "function(", "=> ", "const ", "var ", "==="),
}

_IDENTIFIER = re.compile(r"\b[A-Za-z_][A-Za-z0-9_]*")
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'")
_COMMENT_LINE = re.compile(r"^[ \t]*(?://|#(?!include)|/\*|\*|--|;|<!--).*$", re.M)
#: Code that begins with ``;`` as scripts made to be joined do, or with ``*`` as an assignment through a pointer does.
_CODE_FIRST = re.compile(
    r";+(?:[!(]*(?:async\b|function\b|[\w$, ]*\)\s*=>)|\(\w+\)\(|\[.*\]\.\w|(?:var|let|const|window|self|this)\b[ .\[]|(?:if|for|while|try|return)\s*[({].*[;}])"
    r"|\*+(?:\([^()]*\)|[A-Za-z_][\w.\[\]>-]*)\s*[-+*/|&^]?=(?!=)")
_CLOSING = {"/*": "*/", "<!": "-->"}
#: Lines that stand before a header, and what opens a block of comment.
_PREAMBLE = re.compile(r"\s*(?:package [\w.]+;?|<\?php|<\?xml[^>]*\?>|[\"']use strict[\"'];?)\s*$")
_BLOCKS = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}

#: Headers of tools.
TOOL_HEADER = re.compile(
    r"auto-?generated|@generated\b|<auto-generated|(?:code|file|source|bindings?|stubs?) (?:is |was |were )?(?:auto(?:matically)?[- ])?generated"
    r"|generated (?:by|from|automatically|bindings|code|file|source)|(?:machine|tool)[- ](?:written|generated|made)"
    r"|(?:produced|emitted|written|created) (?:automatically )?by \w+ \d|manual (?:changes|edits) will be (?:lost|overwritten)"
    r"|automatisch (?:erzeugt|generiert|erstellt)|nicht bearbeiten|g[ée]n[ée]r[ée]e? (?:automatiquement|par)|ne pas (?:modifier|[ée]diter)"
    r"|generado (?:automáticamente|por)|no editar|do not edit[.!]? *(?:\*/)?$",
    re.I,
)
#: Headers of other owners, and words that only hint at one.
OWNER_HEADER = re.compile(
    r"\b(?:authors|contributors)\b.*\b(?:redistribut\w*|licen[cs]e\w*|copy|notice|rights)|third[- ]party code|upstream release"
    r"|redistributed under|vendored (?:from|copy)|copied from upstream|\bcopyright\b.*\b(?:authors|contributors|inc|ltd|gmbh|corp|foundation)\b"
    r"|spdx-license-identifier", re.I)
OWNER_HINT = re.compile(r"copyright|\(c\)|©|licen[cs]e|redistribut|upstream", re.I)
OWN_HEADER = re.compile(r"\bin the root\b|part of the [\w-]+ (?:workspace|repository|project|monorepo)", re.I)

#: Places of other people's code, names that tools and bundlers give.
VENDOR_PATH = (
    r"(^|/)(node_modules|bower_components|vendor|vendors|vendored|third[_-]?party|3rd[_-]?party|contrib|external|externals|extern|deps|_deps|pods|carthage"
    r"|site-packages|dist-packages|godeps|jspm_packages)/|^[a-z][a-z_-]*-[0-9]+([.][0-9]+)+/")
TOOL_PATH = (
    r"[.](pb|pb2|g|gen|generated|tab|yy|lex|designer|bindings|min|bundle|chunk)[.][a-z0-9]+$|_pb2(_grpc)?[.]pyi?$|_generated[.][a-z0-9]+$"
    r"|^(build|target|out|dist|obj|gen|generated)/|/(target|build|dist)/(out|gen|generated|release|debug)/")

COUNTS = "language string, gram int, n long"
READ = (
    "file_id string, chunk_id string, h1 long, h2 long, language string, distinct_names string, counts binary, names long, letters long, distinct long, "
    "chars long, named long, lines long, tool_header int, owner_header int, owner_hint int")


def language_of(text: str) -> str:
    best, most = "other", 0
    for name, marks in SYNTAX.items():
        n = sum(map(text.count, marks))
        if n > most:
            best, most = name, n
    return best


def comment_of(line: str) -> tuple[str, str]:
    """A line that begins like a comment as its comment and the code behind it.

    A block comment ends at its mark. A leading ``;`` or ``*`` opens a comment
    unless code follows it, as in scripts made to be joined.
    """
    t = line.lstrip(" \t")
    if mark := _CLOSING.get(t[:2]):
        at = t.find(mark, 2)
        return (line, "") if at < 0 else (t[: at + len(mark)], t[at + len(mark) :])
    if t[0] == "*" and (at := t.find("*/")) >= 0:
        return t[: at + 2], t[at + 2 :]
    if t[0] in ";*" and _CODE_FIRST.match(t):
        return "", line
    return line, ""


def without_comments(text: str) -> str:
    """The text without comments that begin a line; code behind them stays."""
    return _COMMENT_LINE.sub(lambda m: code_behind(m.group()), text)


def code_behind(line: str) -> str:
    """The code of a line that begins like a comment."""
    while _COMMENT_LINE.match(line):
        comment, rest = comment_of(line)
        if not comment:
            return line
        line = rest
    return line


def code_of(text: str) -> str:
    """The text without comment lines and without what strings hold."""
    code = without_comments(text)
    return _STRING.sub('""', code) if '"' in code or "'" in code else code


def grams_of(texts: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number, weight, row) of the trigrams of all names in texts read by :func:`read_texts`.

    A name stands between two marks of its beginning and one of its end.
    """
    counts = [np.frombuffer(c, np.int32) for c in texts["counts"]]
    size = np.array([len(c) for c in counts], np.int64)
    if not size.sum():
        return (np.zeros(0, np.int64),) * 3
    joined = "\n".join(n for n, k in zip(texts.distinct_names, size) if k) + "\n"
    b = np.frombuffer(joined.encode("ascii", "replace"), np.uint8)
    end = b == 10
    s = np.where(end, _AT["$"], _SYMBOL[b & 127])
    first = np.r_[True, end[:-1]]
    before, second = np.r_[0, s[:-1]], np.r_[0, 0, s[:-2]]
    before[first] = second[first] = second[1:][first[:-1]] = _AT["^"]
    name = np.cumsum(first) - 1
    return (second * _SIZE + before) * _SIZE + s, np.concatenate(counts)[name], np.repeat(np.arange(len(texts)), size)[name]


class Names:
    """Bits of each trigram given the two symbols before it, by language."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.bits, self.usual = {}, {}
        every = sum(counts.values(), np.zeros(_SIZE**3, np.int64))
        for language, n in {**counts, "": every}.items():
            table = n.reshape(-1, _SIZE) + 0.05
            p = table / table.sum(1, keepdims=True)
            self.bits[language] = -np.log2(p).ravel()
            self.usual[language] = float((n.reshape(-1) * self.bits[language]).sum() / max(1, n.sum()))

    def known(self, language: str) -> str:
        """The language, or "" for the model of all where it is not told apart or has no model."""
        return language if language != "other" and language in self.bits else ""

    def costs(self, texts: pd.DataFrame) -> np.ndarray:
        """Bits of the names of each text by the model of its language."""
        gram, weight, row = grams_of(texts)
        model = texts.language.map(self.known).to_numpy()
        out = np.zeros(len(texts))
        for language in set(model):
            own = model[row] == language
            out += np.bincount(row[own], self.bits[language][gram[own]] * weight[own], len(texts))
        return out

    def expected(self, texts: pd.DataFrame) -> np.ndarray:
        """Bits that so many letters usually take."""
        return texts.language.map(lambda x: self.usual[self.known(x)]).to_numpy(np.float64) * texts.letters.to_numpy()


def _counting(usual: Names | None):
    """Trigram counts of a partition by language, without texts that ``usual`` finds unusual."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for f in frames:
            if usual and len(f):
                f = f[usual.costs(f) <= usual.expected(f) + UNUSUAL_EXCESS * f.letters.to_numpy()]
            for language, own in f.groupby("language"):
                gram, weight, _ = grams_of(own)
                total[language] = total.get(language, 0) + np.bincount(gram, weight, _SIZE**3).astype(np.int64)
        for language, table in total.items():
            at = np.flatnonzero(table)
            yield pd.DataFrame({"language": language, "gram": at.astype(np.int32), "n": table[at]})

    return run


def _trained(texts: DataFrame, usual: Names | None) -> Names:
    """What reaches the driver is bounded by the alphabet: 32^3 counts for each language of :data:`SYNTAX`."""
    rows = texts.select("language", "distinct_names", "counts", "letters").mapInPandas(_counting(usual), COUNTS).groupBy("language", "gram").agg(F.sum("n").alias("n")).collect()
    counts: dict[str, np.ndarray] = {}
    for r in rows:
        counts.setdefault(r.language, np.zeros(_SIZE**3, np.int64))[r.gram] = r.n
    return Names(counts)


def train_names(texts: DataFrame, known: DataFrame) -> Names:
    """Models of hand-written names from texts read by :func:`read_texts`.

    Texts of ``known`` files and those with a header that gives them away take
    no part; of equal texts one does.
    """
    twice = texts.groupBy("h1", "h2").agg(F.min(F.struct("file_id", "chunk_id")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    own = (
        texts.filter("tool_header = 0 AND owner_header = 0").join(broadcast_if_small(known), "file_id", "left_anti")
        .join(broadcast_if_small(twice), ["h1", "h2"], "left").filter("first IS NULL OR (first.file_id = file_id AND first.chunk_id <=> chunk_id)")
    )
    return _trained(own, _trained(own, None))


def header(text: str) -> list[str]:
    """Comment lines before the first line of code, block comments and documentation strings included.

    What a comment quotes is a mention: callers take strings out.
    """
    out: list[str] = []
    closing = ""
    for line in text.split("\n"):
        code = line
        while code.strip():
            t = code.lstrip()
            if closing:
                at = code.find(closing)
                out.append(code if at < 0 else code[:at])
                code, closing = ("", closing) if at < 0 else (code[at + len(closing) :], "")
            elif (opened := next((o for o in _BLOCKS if t.startswith(o)), None)) and t.find(_BLOCKS[opened], len(opened)) < 0:
                out.append(t)
                code, closing = "", _BLOCKS[opened]
            elif opened and opened == _BLOCKS[opened]:
                at = t.find(opened, len(opened))
                out.append(t[len(opened) : at])
                code = t[at + len(opened) :]
            elif _COMMENT_LINE.match(code):
                comment, rest = comment_of(code)
                if not comment:
                    break
                out.append(comment)
                code = rest
            else:
                break
        if code.strip() and not _PREAMBLE.match(code):
            break
    return out


def facts_of(text: str) -> tuple:
    """The columns of :data:`READ` for one text, from ``language`` on."""
    language = language_of(text)
    body = without_comments(text)
    code = _STRING.sub('""', body) if '"' in body or "'" in body else body
    found = Counter(_IDENTIFIER.findall(code))
    total = letters = named = 0
    for w, n in found.items():
        size = len(w)
        total += n
        letters += (size + 1) * n
        if size > 2:
            named += size * n
    masked = len({w.rstrip("0123456789") for w in found})
    # What strings hold counts as characters without a name.
    chars = len(body) - sum(map(body.count, " \t\r\n"))
    own = [_STRING.sub("", x).strip() for x in header(text) if not OWN_HEADER.search(x)]
    return (language, "\n".join(found), np.fromiter(found.values(), np.int32, len(found)).tobytes(), total, letters, masked, chars, named, code.count("\n") + 1,
            int(any(map(TOOL_HEADER.search, own))), int(any(map(OWNER_HEADER.search, own))), int(any(map(OWNER_HINT.search, own))))


def _reading(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in READ.split(", ")]
    for f in frames:
        yield pd.DataFrame([(a, b, h1, h2, *facts_of(t)) for a, b, h1, h2, t in zip(f.file_id, f.chunk_id, f.h1, f.h2, f.text)], columns=columns)


def read_texts(chunks: DataFrame) -> DataFrame:
    """Identifiers and numbers of each chunk, texts left behind (:data:`READ`).

    One row for each (file_id, chunk_id); of different texts the one with the
    least hash counts.
    """
    arrow_batches(chunks.sparkSession, 1000)
    read = (
        chunks.filter("file_id IS NOT NULL AND text IS NOT NULL").select("file_id", "chunk_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(7), "text").alias("h2"), "text")
        .mapInPandas(_reading, READ)
    )
    rest = [c for c in read.columns if c not in ("file_id", "chunk_id")]
    return read.groupBy("file_id", "chunk_id").agg(F.min(F.struct(*rest)).alias("r")).select("file_id", "chunk_id", *[f"r.{c}" for c in rest])


def text_facts(texts: DataFrame, names: Names) -> DataFrame:
    """One row of numbers for each file: sums over its chunks, each by the model of its own language."""
    numbers = ("names", "letters", "distinct", "chars", "named", "lines")
    flags = ("tool_header", "owner_header", "owner_hint")
    schema = "file_id string, bits double, usual double, " + ", ".join(f"{c} long" for c in numbers) + ", " + ", ".join(f"{c} int" for c in flags)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["file_id", *numbers, *flags]].assign(bits=names.costs(f), usual=names.expected(f))

    return texts.drop("h1", "h2", "chunk_id").mapInPandas(run, schema).groupBy("file_id").agg(*(F.sum(c).alias(c) for c in ("bits", "usual", *numbers)), *(F.max(c).alias(c) for c in flags))


def file_facts(files: DataFrame, releases: DataFrame) -> DataFrame:
    """For each file whether a path or digest, in any generation, gives it away.

    The list of releases is joined by digest; it may be of any size.
    """
    path = F.lower(F.regexp_replace(F.regexp_replace("path", r"\\", "/"), r"^([.]?/)+", ""))
    listed = releases.select(normal_digest("content_digest").alias("digest")).filter("digest IS NOT NULL").distinct().withColumn("listed", F.lit(1))
    return (
        files.filter("file_id IS NOT NULL").select("file_id", path.alias("path"), normal_digest("content_digest").alias("digest")).distinct()
        .join(listed, "digest", "left")
        .groupBy("file_id").agg(
            F.max(F.coalesce(F.col("path").rlike(VENDOR_PATH), F.lit(False)).cast("int")).alias("vendor_path"),
            F.max(F.coalesce(F.col("path").rlike(TOOL_PATH), F.lit(False)).cast("int")).alias("tool_path"),
            F.max(F.coalesce("listed", F.lit(0))).alias("listed"))
    )


def judged_files(files: DataFrame, chunks: DataFrame, releases: DataFrame) -> DataFrame:
    """Every file with its reason not to count as hand-written, null if it does.

    Result: file_id, reason (``vendored``, ``generated``, ``data``, ``minified``
    or null, the first that holds in this order), evidence (the legs that hold,
    as named in the module's text, joined by commas; empty if none does). A file
    without text is judged by its path and digest alone; null paths, digests and
    texts say nothing; repeated rows count once; a chunk of a file that is not
    in ``files`` is not judged.
    """
    texts, about = cut(read_texts(chunks)), cut(file_facts(files, releases))
    names = train_names(texts, about.filter("vendor_path = 1 OR tool_path = 1 OR listed = 1").select("file_id"))
    f = about.join(text_facts(texts, names), "file_id", "left")
    over, letters = F.col("bits") - F.col("usual"), F.col("letters")
    enough = F.col("letters") >= LEAST_NAMES * 2
    legs = {
        "entropy": enough & (over >= MANGLED_EXCESS * letters),
        "diversity": (F.col("lines") >= 4) & (F.col("names") >= LEAST_NAMES) & (F.col("distinct") <= LOW_DIVERSITY * F.col("names")),
        "nameless": (F.col("chars") >= 40) & (F.col("named") <= NAMED_SHARE * F.col("chars")),
        "style": enough & (over < MANGLED_EXCESS * letters) & (over >= F.when(F.col("owner_hint") == 1, OWNED_EXCESS).otherwise(FOREIGN_EXCESS) * letters),
        "owner": F.col("owner_header") == 1, "tool": F.col("tool_header") == 1,
        "place": F.col("vendor_path") == 1, "name": F.col("tool_path") == 1, "list": F.col("listed") == 1,
    }
    f = f.select("file_id", *[F.coalesce(x, F.lit(False)).alias(leg) for leg, x in legs.items()])
    reason = (
        F.when(F.col("list") | F.col("place") | F.col("owner") | F.col("style"), "vendored").when(F.col("tool") | F.col("name"), "generated")
        .when(F.col("nameless"), "data").when(F.col("entropy"), "minified").when(F.col("diversity"), "generated")
    )
    return f.select("file_id", reason.alias("reason"), F.concat_ws(",", *[F.when(F.col(leg), leg) for leg in legs]).alias("evidence"))


def not_handwritten(judged: DataFrame) -> DataFrame:
    return judged.filter("reason IS NOT NULL").select("file_id")
