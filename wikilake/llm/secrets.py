"""Secrets: fixed kinds, and a token-efficiency test that exposes random strings.

A public byte-level vocabulary packs natural text into few tokens; a random string takes
many.  A run of key-like characters that no fixed kind covers is a secret if it has few
characters per token, unless it is a known digest (of nothing or of a common test value,
or named as a checksum or revision just before it) or an identifier (a UUID, a number, or
words joined by punctuation or capital letters).  These spans have the kind `random`.

Nulls and empty texts have no spans.  A text of any length is scanned whole, and a run of any length is encoded
whole.  Repeated rows get equal results, one row each; rows with a null doc_id too.  Spans of a tied start come
in the order of kinds.  An empty table gives no rows.  Other columns, of whatever names, are not looked at.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wikilake.llm.common import only, table, tidy
from wikilake.llm.pii import counted, listed
from wikilake.llm.spanfind import SECRET, find

KINDS = (*(k for k, _ in SECRET), "random")
#: Least length of a candidate, and the most characters a token that still look random.
MIN_LENGTH, MAX_RATIO = 20, 2.2
# Lengths of the digests in use, their names, common values whose digests are known.
_DIGESTS = ("md5", "sha1", "sha224", "sha256", "sha384", "sha512")
_VALUES = (b"", b"\n", b"0", b"1", b"a", b"abc", b"test", b"hello", b"hello world", b"password", b"The quick brown fox jumps over the lazy dog")
_BEFORE = re.compile(r"(?ai)(?:md5|sha-?[0-9]{1,3}|digest|checksum|integrity|etag|commit|revision|blob|tree)[\"']?[\x20]*[:=@-]?[\x20]*[\"']?\Z")
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


def _known_digests() -> frozenset[str]:
    out = set()
    for v in _VALUES:
        for name in _DIGESTS:
            raw = hashlib.new(name, v).digest()
            out |= {raw.hex(), base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("=")}
    return frozenset(out)


KNOWN = _known_digests()


@lru_cache(maxsize=2)
def vocabulary(path: str):
    """A tiktoken encoding of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def identifier(run: str) -> bool:
    """Numbers, UUIDs, and what is made of a few longer words of letters, with numbers at most as parts of their own."""
    if _UUID.fullmatch(run) or not any(map(str.isalpha, run)):
        return True
    parts = _PART.findall(run)
    letters = [p for p in parts if p[0].isalpha()]
    return len(parts) - len(letters) <= 2 and sum(map(len, letters)) >= 4 * len(letters)


def ratio(run: str, path: str) -> float:
    """Characters for each token."""
    return len(run) / max(1, len(vocabulary(path).encode_ordinary(run)))


def random_spans(text: str, covered: list[tuple[int, int]], path: str) -> list[tuple[int, int]]:
    out = []
    for m in _RUN.finditer(text):
        s, e = m.start(), m.end()
        while s < e and text[s] in "=/+-_":
            s += 1
        run = text[s:e].rstrip("=/+-_")
        e = s + len(run)
        if len(run) < MIN_LENGTH or any(s < y and x < e for x, y in covered) or identifier(run) or run.lower() in KNOWN or run in KNOWN or _BEFORE.search(text, max(0, s - 40), s):
            continue
        if ratio(run, path) <= MAX_RATIO:
            out.append((s, e))
    return out


def found(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, base and spans (arrays of start, kind's number, end) of every row; one pass without a shuffle.
    path: a file of tiktoken ranks, at the same place on every machine."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("k", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, both = [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                spans = find(text, SECRET)
                more = [(s, len(SECRET), e) for s, e in random_spans(text, [(s, e) for s, _, e in spans], path)]
                for rows, to in ((spans, base), (sorted(spans + more), both)):
                    to.append([{"start": s, "k": k, "end": e} for s, k, e in rows])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(both, kind)], ["doc_id", "base", "spans"])

    spans = "array<struct<start:int,k:int,end:int>>"
    return only(documents, "doc_id", "text").mapInArrow(tidy(run), f"doc_id long, base {spans}, spans {spans}")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_secrets(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Spans of secrets in every text of documents."""
    out = found(table(spark, sf_dir, "documents"), path or vocabulary_path())
    return out.select("doc_id", *(counted("base", k).alias(f"n_{n}") for k, (n, _) in enumerate(SECRET)), F.sha2(listed("base", KINDS).cast("binary"), 256).alias("base_sha256"), listed("spans", KINDS).alias("spans"), counted("spans", len(SECRET)).alias("n_random"), F.size("spans").cast("long").alias("n_spans"))
