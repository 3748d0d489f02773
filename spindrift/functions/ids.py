"""Identities: framed hashes, remote names, sortable ids, fingerprints."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of Crockford's base 32.
BASE_32 = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def _length_le(part: Column) -> Column:
    """The byte length as eight bytes, least significant first."""
    n = F.hex(F.octet_length(part).cast("long"))
    padded = F.lpad(n, 16, "0")
    return F.unhex(F.concat(*[F.substring(padded, 15 - 2 * i, 2) for i in range(8)]))


def framed_id(kind: str, *parts: Column) -> Column:
    """``kind_`` and a SHA-256 over length and bytes of the kind and each part.

    Framing keeps ("ab", "c") and ("a", "bc") apart. A null part gives null.
    """
    framed = [x for p in (F.lit(kind), *parts) for x in (_length_le(p.cast("string")), F.encode(p.cast("string"), "UTF-8"))]
    return F.concat(F.lit(f"{kind}_"), F.sha2(F.concat(*framed), 256))


def file_id(repository: Column, path: Column) -> Column:
    return framed_id("file", repository, path)


def chunk_id(file: Column, start: Column, end: Column, ordinal: Column, digest: Column) -> Column:
    return framed_id("chunk", file, start, end, ordinal, digest)


def symbol_id(repository: Column, language: Column, semantic_name: Column) -> Column:
    return framed_id("symbol", repository, language, semantic_name)


def valid_id(col: Column) -> Column:
    return col.rlike(r"^[A-Za-z0-9._-]+$")


def valid_path(col: Column) -> Column:
    """Relative, with forward slashes, without empty, ``.`` or ``..`` parts."""
    return (col != "") & ~col.contains("\\") & ~F.exists(F.split(col, "/"), lambda p: p.isin("", ".", ".."))


def valid_lines(start: Column, end: Column) -> Column:
    return (start >= 1) & (end >= start)


def valid_revision(col: Column) -> Column:
    return col.rlike(r"^[0-9a-f]+(\+dirty\.[0-9a-f]+)?$")


def repository_name(remote: Column) -> Column:
    """Identity of a repository by its remote, null if it has none.

    The scheme and user are dropped, the host is written in lower case, one
    ``.git`` at the end is removed; what remains is framed part by part.
    """
    scheme = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^@/]*@)?([^/:]+)(?::\d+)?/(.+)$"
    scp = r"^(?:[^@/:]+@)?([^/:]+):(.+)$"
    shape = F.when(remote.rlike(scheme), F.lit(1)).when(remote.rlike(scp), F.lit(2))
    host = F.lower(F.when(shape == 1, F.regexp_extract(remote, scheme, 1)).otherwise(F.regexp_extract(remote, scp, 1)))
    path = F.when(shape == 1, F.regexp_extract(remote, scheme, 2)).otherwise(F.regexp_extract(remote, scp, 2))
    path = F.regexp_replace(F.regexp_replace(path, r"/+$", ""), r"\.git$", "")
    parts = F.filter(F.concat(F.array(host), F.split(path, "/")), lambda p: p != "")
    framed = F.array_join(F.transform(parts, lambda p: F.concat(F.octet_length(p).cast("string"), F.lit("."), p)), ".")
    return F.when(shape.isNotNull(), F.concat(F.lit("git."), framed))


def new_ulid(now: float | None = None, random: bytes | None = None) -> str:
    """Sortable id: 48 bits of time in milliseconds and 80 random bits."""
    n = int((time.time() if now is None else now) * 1000) << 80 | int.from_bytes(os.urandom(10) if random is None else random, "big")
    return "".join(BASE_32[n >> 5 * (25 - i) & 31] for i in range(26))


def model_fingerprint(parts: Column, dimension: Column, normalized: Column) -> Column:
    """Digest of a model's manifest, so that vectors of another model are refused."""
    return F.sha2(F.array_join(F.concat(parts, F.array(dimension.cast("string"), normalized.cast("string"))), "\0"), 256)
