"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

Every match of the split pattern is encoded on its own. The matches of a batch that are not yet
known stand one after another in one linked list of byte tokens; a pair never spans two of them.
The queue has a bucket of list positions for each merge rank and three levels of bitmaps over
the ranks: find-first-set on each level gives the smallest rank that waits. A position whose
pair has changed since it was put in is stale and skipped. One merge costs the same whatever
the length, so a match of a million bytes is no special case.

Defined cases: a null or empty text has no ids; a null doc_id is carried; repeated rows are
encoded again; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Matches whose ids a worker keeps; beyond it, it starts anew.
CACHE_MATCHES = 700_000
CODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
CODED_IDS = CODED + ", ids array<int>, decoded binary"


class RankQueue:
    """Buckets per rank under three levels of 64-bit bitmaps."""

    def __init__(self, ranks: int):
        self.low, self.mid, self.top = [0] * ((ranks >> 6) + 1), [0] * ((ranks >> 12) + 1), 0
        self.buckets: dict[int, list[int]] = {}

    def put(self, rank: int, positions: list[int]) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.extend(positions)
            return
        self.buckets[rank] = positions
        a, b = rank >> 6, rank >> 12
        self.low[a] |= 1 << (rank & 63)
        self.mid[b] |= 1 << (a & 63)
        self.top |= 1 << b

    def first(self) -> int:
        """The smallest rank that waits; -1 if none does."""
        if not self.top:
            return -1
        b = (self.top & -self.top).bit_length() - 1
        word = self.mid[b]
        a = (b << 6) + (word & -word).bit_length() - 1
        word = self.low[a]
        return (a << 6) + (word & -word).bit_length() - 1

    def take(self, rank: int) -> list[int]:
        a, b = rank >> 6, rank >> 12
        self.low[a] &= ~(1 << (rank & 63))
        if not self.low[a]:
            self.mid[b] &= ~(1 << (a & 63))
            if not self.mid[b]:
                self.top &= ~(1 << b)
        return self.buckets.pop(rank)


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        import numpy as np
        import regex
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
        self.size = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * self.size
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        #: what two neighbouring ids merge to: by the left one, then the right one
        self.merged: list[dict[int, int]] = [{} for _ in range(self.size)]
        self.of_bytes = np.full((256, 256), -1, np.int64)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                left, right = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if left is not None and right is not None:
                    self.merged[left][right] = rank
            if len(token) == 2:
                self.of_bytes[token[0], token[1]] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, tuple[str, tuple[int, ...]]] = {}

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece (none empty)."""
        import numpy as np
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum([len(p) for p in pieces])
        n = len(flat)
        pair = np.full(n, -1, np.int64)
        pair[:-1] = self.of_bytes[flat[:-1], flat[1:]]
        pair[ends - 1] = -1
        queue = RankQueue(self.size)
        by_rank = np.argsort(pair, kind="stable")
        by_rank = by_rank[np.searchsorted(pair[by_rank], 0):]
        if len(by_rank):
            cuts = np.flatnonzero(np.diff(pair[by_rank])) + 1
            for group in np.split(by_rank, cuts):
                queue.put(int(pair[group[0]]), group.tolist())
        ids, waits = self.byte_ids[flat].tolist(), pair.tolist()
        after = np.arange(1, n + 1)
        after[ends - 1] = -1
        before = np.arange(-1, n - 1)
        before[0] = -1
        before[ends[:-1]] = -1
        after, before, alive = after.tolist(), before.tolist(), bytearray(b"\x01") * n
        merged, buckets, put = self.merged, queue.buckets, queue.put
        while (rank := queue.first()) >= 0:
            positions = queue.take(rank)
            positions.sort()  # equal ranks merge from the left
            to_right = merged[rank].get
            for k, at in enumerate(positions):
                if waits[at] != rank:  # stale
                    continue
                gone = after[at]
                ids[at] = rank
                alive[gone] = 0
                waits[gone] = -1
                right = after[gone]
                after[at] = right
                lowest = rank
                if right >= 0:
                    before[right] = at
                    new = to_right(ids[right], -1)
                    waits[at] = new
                    if new >= 0:
                        bucket = buckets.get(new)
                        if bucket is None:
                            put(new, [at])
                        else:
                            bucket.append(at)
                        if new < lowest:
                            lowest = new
                else:
                    waits[at] = -1
                left = before[at]
                if left >= 0:
                    new = merged[ids[left]].get(rank, -1)
                    waits[left] = new
                    if new >= 0:
                        bucket = buckets.get(new)
                        if bucket is None:
                            put(new, [left])
                        else:
                            bucket.append(left)
                        if new < lowest:
                            lowest = new
                if lowest < rank:  # a smaller rank goes first; the rest waits again
                    if rest := positions[k + 1:]:
                        put(rank, rest)
                    break
        live = np.frombuffer(alive, np.uint8).astype(bool)
        kept = np.array(ids, np.int64)[live].tolist()
        bounds = np.cumsum(live)[ends - 1].tolist()
        return [kept[a:b] for a, b in zip([0, *bounds], bounds)]

    def encode(self, texts: list[str], most: int = CACHE_MATCHES) -> list[tuple[str, list[int]]]:
        """Each text's ids, joined by a space and as a list."""
        split = [self.split(t) for t in texts]
        known = self.known
        new = {m for matches in split for m in matches if m not in known}
        if len(known) + len(new) > most:
            known.clear()
            new = {m for matches in split for m in matches}
        pieces, names = [], []
        for m in new:
            raw = m.encode()
            whole = self.ranks.get(raw)  # a match that is a token is that token
            if whole is None:
                pieces.append(raw)
                names.append(m)
            else:
                known[m] = (str(whole), (whole,))
        if pieces:
            for m, ids in zip(names, self.merge(pieces)):
                known[m] = (" ".join(map(str, ids)), tuple(ids))
        out = []
        for matches in split:
            parts = [known[m] for m in matches]
            out.append((" ".join([p[0] for p in parts]), [i for p in parts for i in p[1]]))
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@functools.cache
def coder(path: str, pattern: str) -> ByteBpe:
    """One per worker."""
    return ByteBpe(path, pattern)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; ``with_ids`` adds the
    ids and the decoded bytes."""
    def run(batches):
        import pyarrow as pa
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                coded = bpe.encode(some.column(1).to_pylist())
                back = [bpe.decode(ids) for _, ids in coded]
                columns = [some.column(0), pa.array([len(ids) for _, ids in coded], pa.int64()),
                           pa.array([hashlib.sha256(s.encode()).hexdigest() for s, _ in coded]),
                           pa.array([hashlib.sha256(b).hexdigest() for b in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns += [pa.array([ids for _, ids in coded], pa.list_(pa.int32())), pa.array(back, pa.binary())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col).alias("text")).mapInArrow(
        run, CODED_IDS if with_ids else CODED)
