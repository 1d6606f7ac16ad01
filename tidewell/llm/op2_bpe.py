"""Byte-level BPE encoding and decoding by prefix dynamic programming.

In a vocabulary built by merges, the encoding of a byte string is the one sequence of tokens whose neighbours would
not have merged in another way. So each prefix of a string has exactly one last token, and the encoding of the prefix
is that token after the encoding of what stands before it. ``Prefixes`` keeps that last token for every prefix:
bytes can be appended exactly, and after an edit only the places near it are worked out anew.

A text is cut by the tokenizer's pattern into pieces; a piece that is itself in the vocabulary is one token.
Ranks must be 0..n-1, hold all 256 bytes, and each token must have come from two tokens of lower rank or be reachable
as a whole piece only; other vocabularies raise ValueError.

Defined results: a null text is an empty text, of no tokens; the digest columns are those of the empty string then.
Rows that repeat have equal results, one each. An empty table gives an empty one; other columns stay out unless they are
asked for, whatever their names. A very long text is encoded whole, piece by piece of the pattern; one very long piece
takes time that follows its length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewell.llm.common import FORGET

#: Distinct pieces whose ids a Python worker remembers before it starts afresh.
CACHE_PIECES = 120_000
#: Lengths of the beginnings that pieces share, longest first.
SHARED = (9, 6)
NONE = 1 << 40


def load_ranks(path: str) -> list[bytes]:
    """The tokens of a .tiktoken file in the order of their ranks."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    out = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in out] != list(range(len(out))):
        raise ValueError("ranks must be 0..n-1")
    return out


def _parts(token: bytes, rank: dict[bytes, int]) -> tuple[int, int] | None:
    """The two tokens whose merge gives this one when its bytes stand alone."""
    row = [token[i : i + 1] for i in range(len(token))]
    while len(row) > 2:
        best = min(range(len(row) - 1), key=lambda i: rank.get(row[i] + row[i + 1], NONE))
        if row[best] + row[best + 1] not in rank:
            return None
        row[best : best + 2] = [row[best] + row[best + 1]]
    return rank[row[0]], rank[row[1]]


class Vocabulary:
    """Tokens by rank, and the two parts of each: itself twice for a single byte, (-1, -1) for whole pieces only."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens)}
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("all 256 bytes must be tokens")
        self.left, self.right = [], []
        for i, t in enumerate(tokens):
            p = (i, i) if len(t) == 1 else _parts(t, self.rank) or (-1, -1)
            if len(t) > 1 and max(p) >= i:
                raise ValueError(f"token {i} would come before its parts")
            self.left.append(p[0])
            self.right.append(p[1])
        self.merge = {(a, b): i for i, (a, b) in enumerate(zip(self.left, self.right)) if len(tokens[i]) > 1 and a >= 0}
        # the ends of tokens, with the token where an end is one itself, else -1: a search to the left stops where no token can go on
        self.tails = {t[i:]: -1 for t, a in zip(tokens, self.left) if a >= 0 for i in range(len(t))}
        self.tails |= {t: i for i, (t, a) in enumerate(zip(tokens, self.left)) if a >= 0}
        self._fits: dict[int, bool] = {}

    def fits(self, a: int, b: int) -> bool:
        """Whether a and b, each made by its merges, stay apart side by side."""
        key = a << 32 | b
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > 300_000:
                self._fits.clear()
            known = self._fits[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        # Undo the later of the two tokens' last merges, step by step: at each stage the parts that face each other
        # must not have a merge that would have come before the one just undone.
        merge, left, right, first = self.merge, self.left, self.right, NONE
        while True:
            if merge.get((a, b), NONE) < first:
                return False
            inner_a, inner_b = right[a], left[b]
            if inner_a == a and inner_b == b:
                return True
            # of equal ranks the left merge came first, so the right one is undone before it
            if inner_b == b or (inner_a != a and a > b):
                first, a = a, inner_a
            else:
                first, b = b + 1, inner_b


class Prefixes:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        if data:
            self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend(len(self.data))

    def _extend(self, to: int) -> None:
        """The last tokens of the prefixes up to that length, after those that are there."""
        v, data, last = self.v, self.data, self.last
        tail, fits, apart = v.tails.get, v._fits.get, v.fits
        for end in range(len(last) + 1, to + 1):
            start = end - 1
            t = tail(data[start:end])
            while t is not None:
                if t >= 0:
                    if not start:
                        break
                    a = last[start - 1]
                    ok = fits(a << 32 | t)
                    if apart(a, t) if ok is None else ok:
                        break
                start -= 1
                t = tail(data[start:end]) if start >= 0 else None
            if t is None:
                raise ValueError("no token ends here: not a vocabulary of merges")
            last.append(t)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new for the bytes from start to end; returns how many places were worked out anew.

        Behind the edit, once as many places in a row as the longest token has bytes agree with what was there
        before, all later ones do: a last token depends on nothing further back."""
        old, tail = self.last, self.data[end:]
        self.data = self.data[:start] + new + tail
        self.last = last = old[:start]
        reach = max(map(len, self.v.tokens))
        same, done, place = 0, 0, end
        for stop in range(start + 1, len(self.data) + 1):
            self._extend(stop)
            done += 1
            if stop > start + len(new):
                same = same + 1 if last[-1] == old[place] else 0
                place += 1
                if same >= reach:
                    last.extend(old[place:])
                    break
        return done

    def encode(self) -> list[int]:
        out, at, tokens = [], len(self.data), self.v.tokens
        while at:
            t = self.last[at - 1]
            out.append(t)
            at -= len(tokens[t])
        return out[::-1]


class Encoder:
    """Whole texts to ids and back."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.v = Vocabulary(tokens)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.begun: dict[bytes, list[int]] = {}

    def piece(self, data: bytes) -> list[int]:
        whole = self.v.rank.get(data)
        if whole is not None:
            return [whole]
        p = Prefixes(self.v)
        p.data = data
        for size in SHARED:  # what another piece with the same beginning has found
            if len(data) > size and (head := self.begun.get(data[:size])):
                p.last = head.copy()
                break
        p._extend(len(data))
        if len(self.begun) >= CACHE_PIECES:
            self.begun.clear()
        for size in SHARED:
            if len(data) > size and data[:size] not in self.begun:
                self.begun[data[:size]] = p.last[:size]
        return p.encode()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), "<u4")

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        known = self.known
        out = []
        for p in self.find(text):
            got = known.get(p)
            if got is None:
                if len(known) >= CACHE_PIECES:
                    known.clear()
                got = np.asarray(self.piece(p.encode()), "<u4").tobytes()
                if len(p) <= 64:
                    known[p] = got
            out.append(got)
        return b"".join(out)

    def forget(self) -> None:
        """Lets go of the pieces seen so far, so that a worker that does other things holds the vocabulary only."""
        self.known.clear()
        self.begun.clear()

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def _encoder(tokens: tuple[bytes, ...], pattern: str) -> Encoder:
    out = Encoder(list(tokens), pattern)
    FORGET.append(out.forget)
    return out


def _strings(batch: pa.RecordBatch, column: str) -> Iterator[str]:
    for x in batch.column(batch.schema.get_field_index(column)):
        yield x.as_py() or ""


def encode_table(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, the columns in keep, n_tokens, ids_sha256, decoded_sha256) and, on request, ids array<int>, for every row of docs.

    The driver reads the vocabulary, whose size does not grow with the data, and broadcasts it."""
    held = docs.sparkSession.sparkContext.broadcast((tuple(load_ranks(path)), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(*held.value)
        for batch in batches:
            n, first, second, all_ids = [], [], [], []
            for text in _strings(batch, text_col):
                raw = enc.encode_bytes(text)
                got = np.frombuffer(raw, "<u4")
                n.append(len(got))
                first.append(hashlib.sha256(raw).hexdigest())
                second.append(hashlib.sha256(enc.decode(got)).hexdigest())
                if ids:
                    all_ids.append(got.astype(np.int32))
            columns = [*(batch.column(i) for i in range(1 + len(keep))), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = [id_col, *keep, "n_tokens", "ids_sha256", "decoded_sha256"]
            if ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    kinds = dict(docs.dtypes)
    first_columns = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep))
    return docs.select(id_col, *keep, text_col).mapInArrow(run, f"{first_columns}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidewell.llm.common import table

    return encode_table(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)
