"""Byte-level BPE by monoid tree reduction.

A piece (one match of the pre-tokeniser's pattern) is a list of bytes. Its encoding is built up
a balanced tree: leaves are single bytes, and the encodings of two neighbours are joined by
re-encoding a window around their boundary. A list of tokens is the encoding of its bytes if
and only if each two neighbouring tokens are the encoding of their joined bytes; so a window is
done once its outermost tokens are stable next to the tokens outside, and it grows otherwise.
Texts are lists of pieces, joined by concatenation; decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import arrow_map, table

DEFAULT_VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pieces remembered by a Python worker; the table is emptied when full, which changes no result.
REMEMBERED = 400_000
#: Subtrees of so many bytes are remembered: most pieces share theirs with other pieces.
REMEMBERED_BYTES = 16
NO_RANK = 1 << 60


class TreeBPE:
    """Encoder and decoder over a table of ranks (bytes to id)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = dict(zip(ranks.values(), ranks.keys()))
        self.decimal = {i: str(i) for i in self.bytes_of}
        self._stable: dict[tuple[bytes, bytes], bool] = {}
        self._halves: dict[bytes, list[bytes]] = {}

    def merged(self, raw: bytes) -> list[bytes]:
        """Encoding by repeatedly merging the leftmost pair of lowest rank."""
        if len(raw) > 64:
            return self._merged_by_heap(raw)
        parts, rank = [raw[i : i + 1] for i in range(len(raw))], self.ranks.get
        ranked = [rank(raw[i : i + 2], NO_RANK) for i in range(len(raw) - 1)]
        while ranked:
            best = min(ranked)
            if best == NO_RANK:
                break
            i = ranked.index(best)
            parts[i] += parts.pop(i + 1)
            del ranked[i]
            if i < len(ranked):
                ranked[i] = rank(parts[i] + parts[i + 1], NO_RANK)
            if i:
                ranked[i - 1] = rank(parts[i - 1] + parts[i], NO_RANK)
        return parts

    def _merged_by_heap(self, raw: bytes) -> list[bytes]:
        """The same for long windows, in n log n steps: parts are linked, pairs wait in a heap."""
        n, rank = len(raw), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # by a part's first byte; end 0: merged away
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(raw[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if not middle or middle == n or end[middle] != stop:
                continue
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := rank(raw[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if i and (r := rank(raw[before[i] : stop])) is not None:
                heapq.heappush(heap, (r, before[i], stop))
        parts, i = [], 0
        while i < n:
            parts.append(raw[i : end[i]])
            i = end[i]
        return parts

    def stable(self, left: bytes, right: bytes) -> bool:
        """Whether two neighbouring tokens are what their joined bytes encode to."""
        found = self._stable.get((left, right))
        if found is None:
            if len(self._stable) >= REMEMBERED:
                self._stable.clear()
            found = self._stable[left, right] = self.merged(left + right) == [left, right]
        return found

    def joined(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """Encoding of the bytes of ``left`` and ``right``, both encodings themselves."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = len(left) - 1, 1
        while True:
            window = self.merged(b"".join(left[i:]) + b"".join(right[:j]))
            grow_left = i > 0 and not self.stable(left[i - 1], window[0])
            grow_right = j < len(right) and not self.stable(window[-1], right[j])
            if not grow_left and not grow_right:
                return left[:i] + window + right[j:]
            step = max(1, len(left) - i)
            i = max(0, i - step) if grow_left else i
            j = min(len(right), j + step) if grow_right else j

    def tree(self, raw: bytes) -> list[bytes]:
        if len(raw) == 1:
            return [raw]
        found = self._halves.get(raw)
        if found is None:
            half = len(raw) // 2
            found = self.joined(self.tree(raw[:half]), self.tree(raw[half:]))
            if len(raw) <= REMEMBERED_BYTES:
                if len(self._halves) >= REMEMBERED:
                    self._halves.clear()
                self._halves[raw] = found
        return found

    def encode_piece(self, raw: bytes) -> tuple[int, ...]:
        """Ids of one piece; a piece that is a token by itself is that token."""
        known = self.ranks.get(raw)
        return (known,) if known is not None else tuple(map(self.ranks.__getitem__, self.tree(raw)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Pieces(dict):
    """Remembered pieces: ids."""

    def __init__(self, bpe: TreeBPE):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.bpe.encode_piece(piece.encode("utf-8", "surrogatepass"))
        if len(piece) <= 64:
            self[piece] = found
        return found


@lru_cache(maxsize=2)
def _loaded(path: str, pattern: str):
    import regex

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    bpe = TreeBPE(ranks)
    return regex.compile(pattern), bpe, _Pieces(bpe)


def encode(text: str | None, path: str, pattern: str) -> list[int]:
    """Ids of a whole text, without special tokens; null and empty texts have none."""
    find, _, pieces = _loaded(path, pattern)
    return list(chain.from_iterable(map(pieces.__getitem__, find.findall(text or ""))))


def decode(ids, path: str, pattern: str) -> bytes:
    return _loaded(path, pattern)[1].decode(ids)


def default_vocabulary() -> tuple[str, str]:
    """Path and pre-tokeniser pattern of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY), public_tokenizers.PATTERN


def bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of every row; null text is empty and has no ids. The
    vocabulary file must be readable on every worker."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    def run(batch):
        yield {"doc_id": batch["doc_id"], "ids": [encode(t, path, pattern) for t in batch["text"].to_pylist()]}

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, ids array<int>")


def bpe_decode(coded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the decoded bytes of rows (doc_id, ids); null ids give no bytes."""
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    def run(batch):
        yield {"doc_id": batch["doc_id"], "decoded": [b"" if ids is None else decode(ids, path, pattern) for ids in batch["ids"].to_pylist()]}

    return arrow_map(coded.select("doc_id", "ids"), run, "doc_id long, decoded binary")


def bpe_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256.

    Encodes and decodes each text in one pass without moving it. Null text is empty: 0 tokens
    and digests of nothing. A null doc_id stays null; repeated rows repeat; no rows give none.
    """
    path, pattern = (path, pattern) if path and pattern else default_vocabulary()

    def run(batch):
        n, ids_sha256, decoded_sha256, decimal = [], [], [], _loaded(path, pattern)[1].decimal
        for text in batch["text"]:  # one text at a time: a long one's ids are gone before the next
            ids = encode(text.as_py(), path, pattern)
            n.append(len(ids))
            ids_sha256.append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            decoded_sha256.append(hashlib.sha256(decode(ids, path, pattern)).hexdigest())
        yield {"doc_id": batch["doc_id"], "n_tokens": n, "ids_sha256": ids_sha256, "decoded_sha256": decoded_sha256}

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return arrow_map(own, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"))
