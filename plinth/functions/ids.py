"""Deterministic ids: version-5 UUIDs as expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

# The namespaces of files, chunks and repositories.
FILE_SPACE = "2f6e1c0a-3f0a-4c8e-9a3d-2f8c1a6b7e10"
CHUNK_SPACE = "7b9e2d4c-1a5f-4e3b-8c6d-9f1a2b3c4d5e"
REPOSITORY_SPACE = "c9f1a2b3-4d5e-4f6a-8b7c-1d2e3f4a5b6c"


def uuid5(space: str, name: Column) -> Column:
    """SHA-1 of the namespace and the name, with version and variant set."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(space).hex)), F.encode(name, "utf-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def file_id(path: Column) -> Column:
    return uuid5(FILE_SPACE, path)


def repository_id(owner: Column, name: Column) -> Column:
    return uuid5(REPOSITORY_SPACE, F.concat(owner, F.lit("/"), name))


def chunk_id(file: Column, *parts: Column) -> Column:
    """Of a named chunk (name, start) or a range (``sliding`` or ``parent``, start, end)."""
    return uuid5(CHUNK_SPACE, F.concat_ws(":", file, *(p.cast("string") for p in parts)))
