"""Fill-in-middle transformation by displacement scatter.

A batch's texts lie end to end in one byte array. One scan finds the bytes where a token starts
and so the two cuts of every text. A difference array holds, at the first byte of each segment
(prefix, middle, suffix), by how much its displacement differs from the one before; the cumulative
sum gives every byte its displacement, and one numpy scatter writes all outputs of the batch.
Restoring looks up the sentinels in the outputs, builds the displacements again from their places
alone and gathers every byte back.

Defined cases: a null text is empty, an empty text is plain and has 0 tokens; a null id hashes as
an empty id and is carried; repeated rows are transformed again, alike; a text that holds a
sentinel is plain; columns named in ``carry`` are kept, others are ignored (a carried column may
not be named like a result); an empty table gives an empty result. Texts are Spark strings (valid
UTF-8); a chunk holds whole texts, so a very long one is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Sentinels before prefix, suffix and middle (all of one length, none a part of two others).
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Of 100 texts, those that stay plain, and of the others those in the order suffix, prefix, middle.
PLAIN, SPM = 10, 20
#: Bytes of text that are laid end to end at once.
CHUNK = 1 << 20
FORMS = ["plain", "psm", "spm"]
MADE = "n long, form string, prefix_chars long, middle_chars long, output string"


def draws(id_col: str) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hash of the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _chunks(lengths, most: int) -> Iterator[tuple[int, int]]:
    """Rows [a, b) of at most ``most`` bytes, or one row."""
    a = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(lengths):
        yield a, len(lengths)


def _bytes(column):
    """The column's bytes end to end, and where each row begins (one more than rows)."""
    import numpy as np
    import pyarrow as pa
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    ends = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    text = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data else np.zeros(0, np.uint8)
    return text, ends - ends[0]


def _places(text, starts, sentinel: bytes):
    """Places of a sentinel that lie in one row, and their rows."""
    import numpy as np
    at = np.flatnonzero(text[:-2] == sentinel[0]) if len(text) > 2 else np.zeros(0, np.int64)
    at = at[(text[at + 1] == sentinel[1]) & (text[at + 2] == sentinel[2])]
    row = np.searchsorted(starts, at, "right") - 1
    inside = at + 3 <= starts[row + 1]
    return at[inside], row[inside]


def _displacement(size: int, begins, shifts):
    """Displacement of each of ``size`` bytes: ``shifts`` from ``begins`` on (segments in order,
    empty ones allowed), by the cumulative sum of a difference array."""
    import numpy as np
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, begins, np.diff(shifts, prepend=0))
    return np.cumsum(steps[:-1])


def scatter(text, starts, h):
    """(n, form number, prefix_chars, middle_chars, output bytes, output starts) of one chunk."""
    import numpy as np
    rows, size = len(starts) - 1, len(text)
    # a token starts at a code point that does not go on with a run of letters of the same row
    begins = (text & 0xC0) != 0x80
    letter = ((text | 0x20) >= 97) & ((text | 0x20) <= 122)
    goes_on = np.zeros(size, bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[starts[:-1][starts[:-1] < size]] = False
    tokens = np.flatnonzero(begins & ~goes_on)
    first = np.searchsorted(tokens, starts)
    n = np.diff(first)
    cuts = np.sort(np.stack([h[0] % (n + 1), h[1] % (n + 1)]), axis=0)
    ends = starts[1:]
    if len(tokens):
        cuts = np.where(cuts < n, tokens[np.minimum(first[:-1] + cuts, len(tokens) - 1)], ends)
    else:
        cuts = np.stack([ends, ends])
    held = np.zeros(rows, bool)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held[_places(text, starts, sentinel)[1]] = True
    plain = held | (n == 0) | (h[2] % 100 >= 100 - PLAIN)
    spm = ~plain & (h[3] % 100 < SPM)
    psm = ~plain & ~spm
    out_starts = starts + 9 * np.concatenate([[0], np.cumsum(~plain)])
    out = np.empty(out_starts[-1], np.uint8)
    moved = ~plain
    shifts, base = _segment_shifts(starts, cuts, out_starts, psm, spm)
    shift = _displacement(size, np.stack([starts[:-1], cuts[0], cuts[1]], 1).ravel(), shifts.ravel())
    out[np.arange(size) + shift] = text
    for k, sentinel in enumerate((PREFIX, SUFFIX, MIDDLE)):
        for i, byte in enumerate(sentinel):
            out[base[k][moved] + i] = byte
    chars = np.concatenate([[0], np.cumsum(begins)])
    prefix, middle = chars[cuts[0]] - chars[starts[:-1]], chars[cuts[1]] - chars[cuts[0]]
    return n, psm + 2 * spm, prefix, middle, out, out_starts


def _segment_shifts(starts, cuts, out_starts, psm, spm):
    """Displacements of each row's prefix, middle and suffix, and the places of the sentinels
    before prefix, suffix and middle in the output (of no meaning in plain rows)."""
    import numpy as np
    begin, end, at = starts[:-1], starts[1:], out_starts[:-1]
    suffix = end - cuts[1]
    prefix_at = np.where(spm, at + 3 + suffix, at)
    suffix_at = np.where(spm, at, at + 3 + cuts[0] - begin)
    middle_at = at + 6 + (cuts[0] - begin) + suffix
    own = at - begin
    moved = psm | spm
    shifts = [np.where(moved, place + 3 - segment, own)
              for place, segment in ((prefix_at, begin), (middle_at, cuts[0]), (suffix_at, cuts[1]))]
    return np.stack(shifts, 1), (prefix_at, suffix_at, middle_at)


def gather(out, out_starts, form):
    """(text bytes, starts) from the outputs of one chunk and their forms."""
    import numpy as np
    psm, spm = form == 1, form == 2
    moved = psm | spm
    starts = out_starts - 9 * np.concatenate([[0], np.cumsum(moved)])
    places = []
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        at, row = _places(out, out_starts, sentinel)
        place = out_starts[:-1].copy()
        place[row] = at  # a row that was moved has one; of others the place isn't read
        places.append(place)
    prefix_at, suffix_at, middle_at = places
    prefix = np.where(psm, suffix_at, middle_at) - prefix_at - 3
    middle = out_starts[1:] - middle_at - 3
    cuts = np.stack([np.where(moved, starts[:-1] + prefix, starts[1:]), np.where(moved, starts[:-1] + prefix + middle, starts[1:])])
    shifts, _ = _segment_shifts(starts, cuts, out_starts, psm, spm)
    shift = _displacement(int(starts[-1]), np.stack([starts[:-1], cuts[0], cuts[1]], 1).ravel(), shifts.ravel())
    return out[np.arange(starts[-1]) + shift], starts


def _strings(pa, data, starts):
    import numpy as np
    return pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data))


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("doc_id",),
              chunk: int = CHUNK) -> DataFrame:
    """``carry`` columns, n tokens, form, prefix_chars, middle_chars and the output text."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            texts = batch.column("_text")
            for a, b in _chunks(np.diff(_bytes(texts)[1]).tolist(), chunk):
                some = batch.slice(a, b - a)
                text, starts = _bytes(some.column("_text"))
                h = [some.column(f"_h{i}").to_numpy(zero_copy_only=False) for i in range(4)]
                n, form, prefix, middle, out, out_starts = scatter(text, starts, h)
                plain = form == 0
                yield pa.RecordBatch.from_arrays(
                    [some.column(c) for c in carry]
                    + [pa.array(n, pa.int64()), pa.DictionaryArray.from_arrays(form.astype(np.int8), FORMS).cast(pa.string()),
                       pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain),
                       _strings(pa, out, out_starts)],
                    [*carry, "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(*carry, whole_text(text_col).alias("_text"), *[h.alias(f"_h{i}") for i, h in enumerate(draws(id_col))])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema.fields)
    return rows.mapInArrow(run, ", ".join(x for x in (kept, MADE) if x))


def restore(made: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``made`` with the column ``restored``: each text rebuilt from its output and form alone."""
    names = made.columns

    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for a, b in _chunks(np.diff(_bytes(batch.column("output"))[1]).tolist(), chunk):
                some = batch.slice(a, b - a)
                form = np.array([FORMS.index(x) for x in some.column("form").to_pylist()], np.int8)
                text, starts = gather(*_bytes(some.column("output")), form)
                yield pa.RecordBatch.from_arrays([*some.columns, _strings(pa, text, starts)], [*names, "restored"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(run, kept + ", restored string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = restore(transform(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                       F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
c AS (
  SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS c1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS c2,
         ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM t),
p AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suf,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
