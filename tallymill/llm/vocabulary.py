"""Vocabulary files of public tokenizers, read by the driver and sent to the tasks.

A vocabulary is bounded by its file (a few MB), so it is broadcast as bytes; each Python worker
parses it once.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

MAX_FILE_BYTES = 64 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def shared_file(spark: SparkSession, path: str | None) -> Broadcast:
    content = Path(path or default_path()).read_bytes()
    if len(content) > MAX_FILE_BYTES:
        raise ValueError(f"{path} has {len(content)} bytes; a vocabulary may have {MAX_FILE_BYTES}")
    return spark.sparkContext.broadcast(content)


@lru_cache(maxsize=2)
def parsed(content: bytes) -> dict:
    return json.loads(content)


@lru_cache(maxsize=1)
def byte_of_letter() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable Latin-1 stands for
    itself, the other bytes follow from U+0100 in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1),
             *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def as_bytes(token: str) -> bytes:
    letters = byte_of_letter()
    return bytes(letters[c] for c in token)
