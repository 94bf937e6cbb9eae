"""Fingerprints and hashes of file contents and of settings."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of each of the three slices that a fingerprint reads.
SPAN = 256 * 1024


def fingerprint(content: Column, size: Column | None = None, span: int = SPAN) -> Column:
    """'<size>-<32 hex>' of a binary column: SHA-256 over its first, middle and last ``span`` bytes (each the whole of a shorter one).

    Two contents of different length never share it; null stays null.
    """
    n = F.length(content) if size is None else size

    def at(start: Column) -> Column:
        return F.substring(content, F.greatest(start, F.lit(0)) + 1, F.lit(span))

    slices = F.concat(at(F.lit(0)), at(F.floor(n / 2).cast("int") - span // 2), at(n - span))
    return F.concat(n.cast("string"), F.lit("-"), F.substring(F.sha2(slices, 256), 1, 32))


def profile_hash(knobs: dict) -> str:
    """Twelve hex digits of settings, whatever their order."""
    return hashlib.sha256(json.dumps(knobs, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]
