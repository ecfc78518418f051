"""Packing token ids into sequences by concatenating and cutting.

Pass one tokenises and writes ids with each document's offset inside its partition. The
partitions' totals (one row per partition) give every partition its global offset by a prefix
sum. Pass two adds the two and cuts at multiples of the sequence length; each piece is a
boundary record. All sequences but the last are full.

Defined cases: a special token's string in a text gives its id, as the plain tokenizer does (no
other special ids are added); a null or empty text is the end id alone; repeated rows are packed again; a null
doc_id is carried; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import functools
import json
import struct
import sys
import unicodedata
import zlib
from array import array

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

LENGTH = 4096
END_ID = 2
#: Words whose ids a worker keeps; beyond it, it starts anew.
CACHE_WORDS = 400_000
IDS = "part int, before long, doc_id long, doc_tokens long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long")


@functools.cache
def _tokenizer(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


def _drops_white_space(tokenizer) -> bool:
    """Whether it lower-cases, drops white space and splits letters from the rest, byte by byte:
    then a text's ids are those of its words in order."""
    j = json.loads(tokenizer.to_str())
    rules = [x["type"] for x in (j["normalizer"] or {}).get("normalizers", [])]
    cuts = (j["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (rules == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["invert"] and r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" in cuts[0]["pattern"].get("Regex", "")
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"])


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit values, word by word where the tokenizer
    allows it: a word's ids are then looked up once."""

    def __init__(self, path: str, most: int = CACHE_WORDS):
        self.tokenizer, self.most = _tokenizer(path), most
        self.by_word = _drops_white_space(self.tokenizer)
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str | bytes, bytes] = {}
        from tokenizers.pre_tokenizers import ByteLevel
        self.as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str

    def encode(self, texts: list[bytes]) -> list[bytes]:
        import numpy as np
        if not self.by_word:
            whole = [t.decode(errors="replace") for t in texts]
            return [_packed(e.ids) for e in self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)]
        import pyarrow as pa
        import pyarrow.compute as pc
        # cut at ASCII white space, which the tokenizer cuts at as well; a word may be empty
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.view(pa.large_binary()).to_pylist()
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.most:
            known.clear()
            new = words
        if len(self.parts) > self.most:
            self.parts.clear()
        self._learn(new)
        ids = pa.array([known[w] for w in words], pa.large_binary()).take(coded.indices)
        raw = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], np.int64)[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [bytes(raw[a:b]) for a, b in zip(ends[:-1], ends[1:])]

    def _learn(self, words: list[bytes]) -> None:
        known, parts, tokenize, rest = self.known, self.parts, self.tokenizer.model.tokenize, []
        for w in words:
            if not w:
                known[w] = w
                continue
            core = w.rstrip(_PUNCTUATION)
            # letters, then marks at the end: the tokenizer cuts between them
            if core.isalpha():  # ASCII ones
                low = core.lower()
                ids = parts.get(low)
                if ids is None:
                    ids = parts[low] = _packed([t.id for t in tokenize(low.decode())])
            else:
                ids = self._letters(core.decode(errors="replace")) if core and not core.isascii() else None
            if ids is None:
                rest.append((w, w.decode(errors="replace")))
            else:
                known[w] = ids + self._whole(w[len(core):].decode()) if len(core) < len(w) else ids
        for i in range(0, len(rest), 5000):
            self._joined(rest[i:i + 5000])

    def _letters(self, word: str) -> bytes | None:
        """The ids of a word of letters alone, some not ASCII: one unit of the tokenizer's."""
        if "\u03a3" in word or not unicodedata.is_normalized("NFC", word):
            return None
        low = word.lower()
        if not (word.isalpha() and low.isalpha()):
            return None
        ids = self.parts.get(low)
        if ids is None:
            unit = low if low.isascii() else self.as_bytes(low)[0][0]
            ids = self.parts[low] = _packed([t.id for t in self.tokenizer.model.tokenize(unit)])
        return ids

    def _whole(self, word: str) -> bytes:
        ids = self.parts.get(word)
        if ids is None:
            ids = self.parts[word] = _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return ids

    def _joined(self, words: list[tuple[bytes, str]]) -> None:
        """Many words in one call, told apart by their places."""
        import numpy as np
        e = self.tokenizer.encode(" ".join([s for _, s in words]), add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        begins = np.array([a for a, _ in e.offsets], np.int64)
        ends = np.cumsum([len(s) + 1 for _, s in words])
        cuts = np.searchsorted(begins, ends)
        at = 0
        for (w, _), cut in zip(words, cuts.tolist()):
            self.known[w] = ids[at:cut].tobytes()
            at = cut


def _packed(ids: list[int]) -> bytes:
    return array("I", ids).tobytes() if _LITTLE else struct.pack(f"<{len(ids)}I", *ids)


_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())


@functools.cache
def word_ids(path: str) -> WordIds:
    """One per worker."""
    return WordIds(path)


def token_ids(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID) -> DataFrame:
    """Pass one: each document's ids, and how many ids stand before it in its partition."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        words, part, before = word_ids(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids = [x + end for x in words.encode(some.column(1).to_pylist())]
                counts = [len(x) // 4 for x in ids]
                starts = before + np.cumsum([0] + counts)
                before = int(starts[-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array(starts[:-1], pa.int64()),
                     some.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    ["part", "before", "doc_id", "doc_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), whole_text(text_col).cast("binary").alias("text")).mapInArrow(run, IDS)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text",
         end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """The boundary records of all pieces; ``with_ids`` adds each piece's ids."""
    stored = written(token_ids(docs, tokenizer, id_col, text_col, end_id), "packing-ids")
    # one row per partition of pass one; only these are put in order
    totals = stored.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_offset"))

    def cut(batches):
        import pyarrow as pa
        for batch in batches:
            rows: list[tuple] = []
            for before, doc, n, ids, base in zip(*(batch.column(i).to_pylist() for i in range(5))):
                at, start = base + before, 0
                ids = memoryview(ids)
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    size = min(n - start, length - offset)
                    piece = ids[4 * start:4 * (start + size)]
                    row = (doc, start, size, zlib.crc32(piece), n, sequence, offset)
                    rows.append(row + (bytes(piece),) if with_ids else row)
                    start += size
                    if len(rows) >= 20_000:
                        yield _batch(pa, rows, with_ids)
                        rows = []
            if rows:
                yield _batch(pa, rows, with_ids)

    schema = PIECES + (", ids binary" if with_ids else "")
    # at most one row per task of pass one, which bounds the broadcast
    return stored.join(F.broadcast(offsets), "part").select("before", "doc_id", "doc_tokens", "ids", "part_offset").mapInArrow(cut, schema)


def _batch(pa, rows: list[tuple], with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
