"""Byte-pair encoding as a streaming transducer with bounded lookahead, and its decoder.

Encoding.  A sequence of tokens is the encoding of its text if and only if each two
neighbours are stable: no merge across their boundary would have come before the merges
that built them.  So the last token of every prefix is unique, and it is found from the
last tokens of the prefixes at most one token's length shorter.  The transducer reads one
symbol at a time and emits a token as soon as `lookahead` further symbols have been read; that many
are sufficient for this merge list (see there), so nothing that follows can change it.  It keeps the last
tokens of twice that many prefixes at most, however long the word is.

Decoding runs ids through a byte-to-text state machine (`Decoder`) that holds at most the bytes of
one unfinished code point.

The file format is the public JSON one of the tokenizers library: NFC, lower case, a split
into words that drops white space, bytes as characters, and an end-of-word suffix.

Nulls and empty texts have no ids, and the digests of nothing.  A text of any length is encoded whole,
piece by piece.  Repeated rows get equal results, one row each; rows with a null doc_id too.  Ties of merges don't
occur, as each has a rank of its own.  An empty table gives no rows.  Other columns pass through; those named as
the results are replaced.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wikilake.llm.common import CACHES, only, table, tidy

#: Code points of a text split at once, and half of the results of a kind that a worker remembers.
PIECE, REMEMBERED = 1 << 16, 1 << 18
END = "</w>"
# The tokenizer's own pattern, with the white space of Unicode's White_Space property written out.
_SPACES = r"\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACES}\p{{L}}\p{{N}}]+")
_SHORT = (2, 1)
_NO_SPACE = regex.compile(rf"[^{_SPACES}]+")
_SEPARATORS = {"\x1c", "\x1d", "\x1e", "\x1f"}  # white space to Python, not to Unicode


def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if it is printable Latin-1, else the next free code point from 256 on."""
    keep = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in keep else next(spare)) for b in range(256)]


class Recent(dict):
    """Results by key: the latest `half` of them, and those that have been used again of the half before."""

    def __init__(self, make, half: int):
        super().__init__()
        self.make, self.half, self.before = make, half, {}

    def __missing__(self, key):
        out = self.before.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= self.half:
            self.before = dict(self)
            self.clear()
        self[key] = out
        return out

    def forget(self) -> None:
        self.before = {}
        self.clear()


class Transducer:
    """Encodes words, given as strings of symbols, by a merge list."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], remembered: int = REMEMBERED):
        self.vocab = vocab
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for r, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), r)
            self.parts.setdefault(a + b, (a, b))
        self.most = max((self.size(t) for t in vocab), default=1)
        # Sizes of tokens by their last three symbols, the longest first, for tokens within and at the end of a word.
        sizes: tuple[dict[str, set[int]], ...] = ({}, {})
        for t in vocab:
            n = self.size(t)
            if n > 2:
                sizes[n < len(t)].setdefault(t[n - 3 : n], set()).add(n)
        self._sizes = [{k: (*sorted(v, reverse=True), 2, 1) for k, v in by.items()} for by in sizes]
        self._right: dict[str, tuple] = {}
        self._left: dict[str, tuple] = {}
        self._stable = Recent(self._apart, remembered)

    @staticmethod
    def size(token: str) -> int:
        """Symbols of a token; the end of a word belongs to its last symbol."""
        return len(token) - len(END) if token.endswith(END) and token != END else len(token)

    @cached_property
    def lookahead(self) -> int:
        """A number of further symbols after which a token can't change any more.

        Compare the merging of a text with that of the same text and more behind it.  Both have the same tokens to
        the left of some boundary, at first the end of the shorter text.  It moves left only if one of them merges
        across it a token S, which both have, with a token X that begins there: by the size of S.  The next such merge
        needs a token X that begins where S began, so S stands on X's left edge, and merges come in
        the order of their ranks.  So the way that the boundary can go is the heaviest path in a graph of merges:
        (S, X) may follow (A, B) if it comes later and A stands on the left edge of X.  It is found in one pass over
        the merges in their order."""
        reach: dict[str, int] = {}  # the longest way of a merge so far, by its left part
        most = 0
        for s, x in self.rank:
            way = self.size(s) + max((reach.get(t, 0) for t, _ in self._spine(x, 0)), default=0)
            reach[s] = max(reach.get(s, 0), way)
            most = max(most, way)
        return most

    def _spine(self, token: str, side: int) -> tuple:
        """What stands at one edge of a token while it is built, with the rank of the merge that ends it."""
        kept = self._right if side else self._left
        if token not in kept:
            out, end, t = [(token, len(self.rank))], 0, token
            while t in self.parts:
                end = self.rank[self.parts[t]]
                t = self.parts[t][side]
                out.append((t, end))
            kept[token] = tuple(out)
        return kept[token]

    def stable(self, a: str, b: str) -> bool:
        """Whether a and b stay apart when one follows the other."""
        return self._stable[a, b]

    def _apart(self, pair: tuple[str, str]) -> bool:
        rank, left = self.rank.get, self._spine(pair[1], 0)
        for x, x_end in self._spine(pair[0], 1):
            for y, y_end in left:
                r = rank((x, y))
                if r is not None and r < x_end and r <= y_end:
                    return False
        return True

    def tokens(self, word: str) -> Iterable[str]:
        """The tokens of one word, as they become stable.  A prefix's last token is its longest one that is
        stable after the last token of the prefix before it."""
        n, ahead = len(word), self.lookahead
        if n < 2 * ahead:
            return self._at_once(word)
        return self._in_pieces(word, n, ahead)

    def _at_once(self, word: str) -> list[str]:
        """The tokens of a word that ends before the first of them could be emitted."""
        vocab, known, whole = self.vocab, self._stable, word + END
        n = len(word)
        last = [""]
        for p in range(1, n):
            for size in self._sizes[0].get(word[p - 3 : p], _SHORT) if p > 2 else _SHORT[-p:]:
                if size <= p and (t := word[p - size : p]) in vocab and (not (before := last[p - size]) or known[before, t]):
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no symbol for a part of {word[:40]!r}")
        for size in self._sizes[1].get(word[n - 3 :], _SHORT) if n > 2 else _SHORT[-n:]:
            if size <= n and (t := whole[n - size :]) in vocab and (not (before := last[n - size]) or known[before, t]):
                last.append(t)
                return self._chain(last, n)
        raise ValueError(f"the vocabulary has no symbol for the end of {word[-40:]!r}")

    def _in_pieces(self, word: str, n: int, ahead: int) -> Iterator[str]:
        vocab, known, inner = self.vocab, self._stable, self._sizes[0]
        last = [""]  # last token of each prefix from base on; with all single symbols known, each has one
        base = 0  # all before it has been emitted
        for p in range(1, n + 1):
            sizes, end = inner, p
            if p == n:  # the end of the word belongs to the last symbol
                sizes, word, end = self._sizes[1], word + END, n + len(END)
            for size in sizes.get(word[p - 3 : p], _SHORT) if p > 2 else _SHORT:
                i = p - size
                if i >= base and (t := word[i:end]) in vocab:
                    before = last[i - base]
                    if before and not known[before, t]:
                        continue
                    last.append(t)
                    break
            else:
                raise ValueError(f"the vocabulary has no symbol for a part of {word[:40]!r}")
            if p - base >= 2 * ahead and p < n:
                cut = p
                while cut > p - ahead:  # the last boundary that is settled
                    cut -= self.size(last[cut - base])
                if cut > base:
                    yield from self._chain(last, cut - base)
                    last = ["", *last[cut - base + 1 :]]
                    base = cut
        yield from self._chain(last, n - base)

    def _chain(self, last: list[str], end: int) -> list[str]:
        out = []
        while end > 0:
            out.append(last[end])
            end -= self.size(last[end])
        return out[::-1]


class Decoder:
    """A byte-to-text state machine: reads ids and gives the text as far as its code points are finished.  Its state is the
    bytes of an unfinished code point; what can't be finished is replaced."""

    def __init__(self, spelt: dict[int, bytes], between: bytes = b"", remembered: int = REMEMBERED):
        """spelt: the bytes of each id; between: those between two ids."""
        self.spelt, self.between = spelt, between
        def rest(ids: bytes) -> str:
            """The text of some ids read in the state without pending bytes, if they lead back to it."""
            text, pending = self.step(b"", ids)
            if pending:
                raise _Unfinished
            return text

        self.resting = Recent(rest, remembered)

    def step(self, pending: bytes, ids: bytes) -> tuple[str, bytes]:
        """(text, pending bytes) after some ids (little-endian, 32 bits)."""
        if not pending:  # whole code points, as a rule
            try:
                return b"".join([self.between + self.spelt[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(), b""
            except UnicodeDecodeError:
                pass
        state = codecs.getincrementaldecoder("utf-8")("replace")
        state.setstate((pending, 0))
        text = "".join(state.decode(self.between + self.spelt[i]) for i in np.frombuffer(ids, "<u4").tolist())
        return text, state.getstate()[0]

    def texts(self, groups: Iterable[list[bytes]]) -> Iterator[str]:
        """The text, a piece for each group of runs of ids, and what is left at the end."""
        pending, begun = b"", False
        for runs in groups:
            try:
                if pending:
                    raise _Unfinished
                text = "".join(map(self.resting.__getitem__, runs))
            except _Unfinished:
                text, pending = self.step(pending, b"".join(runs))
            if runs and not begun:
                text, begun = text[len(self.between) :], True
            yield text
        if pending:
            yield pending.decode("utf-8", "replace")


class _Unfinished(Exception):
    """A code point that goes on in the next ids."""


class WordBPE:
    """A tokenizer file: text to ids and back."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.transducer = Transducer(model["vocab"], merges, remembered)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        chars = byte_characters()
        self._map = {b: c for b, c in enumerate(chars)}
        self._bytes = {c: bytes([b]) for b, c in enumerate(chars)}
        self._packed = {t: i.to_bytes(4, "little") for t, i in model["vocab"].items()}
        names = {i: t.encode() for t, i in [*model["vocab"].items(), *self.special.items()]}
        #: What the library's decode gives for a file without a decoder: the tokens as they are, joined by spaces.
        self.joined = Decoder(names, b" ", remembered)
        #: Plain text: the bytes that the characters stand for, the end of a word as a space.
        self.plain = Decoder({i: t.encode() if t in self.special else b"".join(map(self._bytes.__getitem__, t.removesuffix(END))) + b" " * t.endswith(END) for t, i in [*model["vocab"].items(), *self.special.items()]})

        self._word, self._chunk = Recent(self._of_word, remembered), Recent(self._of_chunk, remembered)

    def forget(self) -> None:
        """Empties the caches."""
        for kept in (self._word, self._chunk, self.joined.resting, self.plain.resting, self.transducer._stable):
            kept.forget()

    def _of_word(self, word: str) -> bytes:
        symbols = word.encode("utf-8").decode("latin-1").translate(self._map)
        return b"".join(map(self._packed.__getitem__, self.transducer.tokens(symbols)))

    def _of_chunk(self, chunk: str) -> bytes:
        if chunk.isalpha():  # the pattern would find one word
            return self._word[chunk]
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():  # a word and a mark
            return self._word[chunk[:-1]] + self._word[chunk[-1]]
        return b"".join(map(self._word.__getitem__, _WORDS.findall(chunk)))

    @staticmethod
    def chunks(text: str) -> Iterator[list[str]]:
        """What stands between white space in a text without special tokens; a long text comes in pieces.
        No word crosses white space."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        split = str.split if _SEPARATORS.isdisjoint(text) else _NO_SPACE.findall
        at, n = 0, len(text)
        while at < n:
            end = n
            if n - at > PIECE:
                end = text.find(" ", at + PIECE)
                end = n if end < 0 else end
            yield split(text[at:end])
            at = end

    def encode(self, text: str) -> Iterator[list[bytes]]:
        """Little-endian 32-bit ids of each run without white space, piece by piece."""
        parts = self._special.split(text) if self._special and "<|" in text else [text]
        for part in parts:
            if part in self.special:
                yield [self.special[part].to_bytes(4, "little")]
            elif part:
                for chunks in self.chunks(part):
                    yield [x for x in map(self._chunk.__getitem__, chunks) if x]

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Plain text, token by token."""
        return self.plain.texts([i.to_bytes(4, "little")] for i in ids)


@lru_cache(maxsize=4)
def load(path: str, remembered: int = REMEMBERED) -> WordBPE:
    return WordBPE(path, remembered)


def encoded(documents: DataFrame, path: str, ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """documents with the columns n_tokens, ids (array of int) if wanted, ids_sha256 and decoded_sha256.

    path: the tokenizer file, at the same place on every machine.  A null is an empty text: no ids, and the
    digests of nothing.  One pass without a shuffle; a worker keeps one piece of a text and caches of twice `remembered` results
    of a kind, which are time for memory and change no result."""
    extra = [("n_tokens", pa.int64(), "long")] + [("ids", pa.list_(pa.int32()), "array<int>")] * ids + [(k, pa.string(), "string") for k in ("ids_sha256", "decoded_sha256")]
    documents = documents.drop(*(k for k, _, _ in extra))
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, remembered)
        CACHES["bpe"] = bpe.forget
        for batch in batches:
            rows: list[list] = [[] for _ in extra]
            for text in batch.column("text"):
                n, all_ids = 0, []
                of_ids, of_text = sha256(), sha256()

                def read(text=text.as_py() or "", all_ids=all_ids, of_ids=of_ids) -> Iterator[list[bytes]]:
                    for runs in bpe.encode(text):
                        piece = b"".join(runs)
                        of_ids.update(piece)
                        all_ids.append(piece if ids else len(piece) // 4)
                        yield runs

                for piece in bpe.joined.texts(read()):
                    of_text.update(piece.encode())
                n = sum(len(x) // 4 if ids else x for x in all_ids)
                row = [n, *((np.frombuffer(b"".join(all_ids), "<i4"),) if ids else ()), of_ids.hexdigest(), of_text.hexdigest()]
                for k, v in enumerate(row):
                    rows[k].append(v)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, t) for v, (_, t, _) in zip(rows, extra, strict=True))], [*names, *(k for k, _, _ in extra)])

    kinds = [f"`{k}` {t}" for k, t in documents.dtypes] + [f"{k} {t}" for k, _, t in extra]
    return documents.mapInArrow(tidy(run, "bpe"), ", ".join(kinds))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    """Ids and decoded text of every document, as digests."""
    docs = only(table(spark, sf_dir, "documents"), "doc_id", "text")
    return encoded(docs, path or tokenizer_path(), ids=False).drop("text")
