"""Brown class-based language model: exchange clustering, class transitions, word emissions.

Every word of the corpus is counted exactly. A word type is one of the ``FREQUENT`` most
frequent words of the training texts or else a word ending (``ENDINGS`` of them, by hash);
exchange clustering moves types between ``CLASSES`` classes: each round Spark counts every
type's left and right neighbour classes over all training tokens, and half of the types move to
the class with the highest likelihood. What a round sends to the driver is types x classes
numbers, whatever the input. The endings only start the other words: in a last round each of them
that training has moves on its own neighbours, counted exactly and dealt by word; a word that
training lacks has the class of its ending. A text's probability is the product of smoothed class transitions
and of word emissions, the end of a text being a class of its own.

1. Texts are coded once into chunks of documents: distinct words by 64-bit hash, and an index
   for each token (written).
2. Postings (word, document, frequency) are dealt by word; one pass gives every word's training
   count and every document's sums of logarithms.
3. Clustering rounds read the coded chunks. The last one deals the neighbours of the words that are
   not among the most frequent; their classes come back to the chunks, whose tokens are written as
   classes.
4. The final transition sums and the scores read those.

Defined cases: a null or empty text is the end alone; a null doc_id is carried and is training
text; repeated rows count again and are scored each; without training text nothing is known and
only the smoothing counts; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LARGE_ROWS, arrow_rows, joined_in_place, written, written_by_part

FREQUENT, ENDINGS, ENDING_BYTES = 8192, 8192, 3
TYPES = FREQUENT + ENDINGS
CLASSES = 64
ROUNDS = 6
#: Added to a word's count within its class, and to a transition's in units of class probability.
EMISSION_PRIOR, TRANSITION_PRIOR = 0.5, 20.0
#: A chunk of documents is closed at so many tokens or documents.
CHUNK_TOKENS, CHUNK_DOCS = 400_000, 60_000
FOLDS, HELD = 7, 2
#: Chunks that go to Python at once.
CHUNKS_AT_ONCE = 2
#: Types of one part of a neighbour table.
PART_TYPES = 512
#: Texts that go to Python at once.
TEXTS_AT_ONCE = 500
#: Counted neighbours whose gains are summed at once.
GAINS_AT_ONCE = 20_000

CODED = ("part int, chunk long, doc_ids array<long>, held array<boolean>, bounds binary, words binary, endings binary, "
         "index binary")


def _planes(x) -> bytes:
    """Unsigned 32-bit values by byte, which compresses well."""
    import numpy as np
    return np.ascontiguousarray(x.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _from_planes(raw):
    import numpy as np
    return np.ascontiguousarray(np.frombuffer(raw, "u1").reshape(4, -1).T).view("<u4").ravel()


def split_words(texts):
    """(words, bounds): the words, A-Z in lower case, of texts (UTF-8 bytes, null: none) in one Arrow
    array, and where each text's begin and end."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    whole = pa.array([t or b"" for t in texts], pa.large_binary()).view(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(whole))  # ASCII case and white space only
    words = split.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    before = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return words.filter(full).view(pa.large_binary()), before[split.offsets.to_numpy() - split.offsets[0].as_py()]


def code_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """CODED chunks of all documents, written."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        chunk = part << 24

        def told(held):
            nonlocal chunk
            words, bounds = split_words([t for _, _, t in held])
            coded = words.dictionary_encode()
            names = coded.dictionary.to_pylist()
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
            endings = np.fromiter((xxhash.xxh3_64_intdigest(w[-ENDING_BYTES:]) % ENDINGS for w in names), np.uint16, len(names))
            index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            # frequent words first: small numbers
            ways = np.argsort(-np.bincount(index, minlength=len(names)), kind="stable")
            place = np.empty(len(names), np.int64)
            place[ways] = np.arange(len(names))
            chunk += 1
            return pa.RecordBatch.from_pylist([{
                "part": part, "chunk": chunk, "doc_ids": [d for d, _, _ in held], "held": [h for _, h, _ in held],
                "bounds": bounds.astype("<i8").tobytes(), "words": hashes[ways].astype("<u8").tobytes(),
                "endings": endings[ways].astype("<u2").tobytes(), "index": _planes(place[index])}],
                schema=pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
                                  ("bounds", pa.binary()), ("words", pa.binary()), ("endings", pa.binary()), ("index", pa.binary())]))

        held, size = [], 0
        for batch in batches:
            for doc, out, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held.append((doc, out, text))
                size += len(text) // 6 if text else 0
                if size >= CHUNK_TOKENS or len(held) >= CHUNK_DOCS:
                    yield told(held)
                    held, size = [], 0
        if held:
            yield told(held)

    out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long"), out, F.col(text_col).cast("string").cast("binary"))
    with arrow_rows(docs.sparkSession, TEXTS_AT_ONCE):
        return written_by_part(rows.mapInArrow(run, CODED), "lm-coded", LARGE_ROWS)


def _chunk(row: dict):
    import numpy as np
    return (np.frombuffer(row["words"], "<u8"), np.frombuffer(row["endings"], "<u2").astype(np.int64),
            _from_planes(row["index"]).astype(np.int64), np.frombuffer(row["bounds"], "<i8"), np.array(row["held"], bool))


def count_words(coded: DataFrame) -> DataFrame:
    """Written rows of three kinds. chunk >= 0: sums and known tokens of the chunk's documents over
    the words of one part. chunk = -1: a part's most frequent words (hash, ending, count).
    chunk = -2: its distinct training words by ending."""
    parts = max(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                words, endings, index, bounds, held = _chunk(row)
                docs = np.repeat(np.arange(len(held)), np.diff(bounds))
                # (part, word, document), counted
                to = ((words >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
                by = np.argsort(to, kind="stable")
                rank = np.empty(len(words), np.int64)
                rank[by] = np.arange(len(words))
                pairs, tf = np.unique(rank[index] * len(held) + docs, return_counts=True)
                word, doc = pairs // max(len(held), 1), pairs % max(len(held), 1)
                used = np.bincount(word, minlength=len(words))
                ends = np.searchsorted(to[by], np.arange(parts), side="right")
                starts = np.concatenate([[0], ends[:-1]])
                at = np.concatenate([[0], np.cumsum(used)])
                for p in range(parts):
                    a, b = starts[p], ends[p]
                    if a < b:
                        x, y = at[a], at[b]
                        yield pa.RecordBatch.from_pylist([{
                            "part": p, "chunk": row["chunk"], "held": np.packbits(held).tobytes(), "docs": len(held),
                            "words": words[by[a:b]].tobytes(), "endings": endings[by[a:b]].astype("<u2").tobytes(),
                            "used": used[a:b].astype("<u4").tobytes(), "doc": doc[x:y].astype("<u2").tobytes(),
                            "tf": tf[x:y].astype("<u4").tobytes()}], schema=pa.schema(
                            [("part", pa.int32()), ("chunk", pa.int64()), ("held", pa.binary()), ("docs", pa.int64()),
                             *((k, pa.binary()) for k in ("words", "endings", "used", "doc", "tf"))]))

    def meet(batches):
        import numpy as np
        import pyarrow as pa
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int32()), ("sums", pa.binary()), ("soft", pa.binary()),
                            ("known", pa.binary())])
        rows = [r for batch in batches for r in batch.to_pylist()]
        for part in sorted({r["part"] for r in rows}):
            own = sorted((r for r in rows if r["part"] == part), key=lambda r: r["chunk"])
            each = [np.frombuffer(r["words"], "<u8") for r in own]
            words, inverse = np.unique(np.concatenate(each), return_inverse=True)
            cuts = np.cumsum([len(x) for x in each])[:-1]
            inverse = np.split(inverse, cuts)
            counts, endings = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for r, inv in zip(own, inverse):
                held = np.unpackbits(np.frombuffer(r["held"], "u1"), count=r["docs"]).astype(bool)
                word = np.repeat(inv, np.frombuffer(r["used"], "<u4"))
                train = ~held[np.frombuffer(r["doc"], "<u2")]
                counts += np.bincount(word[train], np.frombuffer(r["tf"], "<u4")[train], len(words)).astype(np.int64)
                endings[inv] = np.frombuffer(r["endings"], "<u2")
            base, soft = np.log10(counts + 1.0), np.log10(counts + EMISSION_PRIOR)
            for r, inv in zip(own, inverse):
                word = np.repeat(inv, np.frombuffer(r["used"], "<u4"))
                doc, tf = np.frombuffer(r["doc"], "<u2"), np.frombuffer(r["tf"], "<u4")
                yield pa.RecordBatch.from_pylist([{
                    "chunk": r["chunk"], "part": part, "sums": np.bincount(doc, tf * base[word], r["docs"]).tobytes(),
                    "soft": np.bincount(doc, tf * soft[word], r["docs"]).tobytes(),
                    "known": np.bincount(doc, tf * (counts[word] > 0), r["docs"]).tobytes()}], schema=schema)
            top = np.lexsort((words, -counts))[:FREQUENT]
            top = top[counts[top] > 0]
            kinds = np.bincount(endings[counts > 0], minlength=ENDINGS)
            yield pa.RecordBatch.from_pylist([
                {"chunk": -1, "part": part, "sums": words[top].tobytes(), "soft": endings[top].astype("<i8").tobytes(),
                 "known": counts[top].tobytes()},
                {"chunk": -2, "part": part, "sums": kinds.astype("<i8").tobytes(), "soft": b"", "known": b""}], schema=schema)

    dealt = coded.select("chunk", "held", "bounds", "words", "endings", "index").mapInArrow(
        deal, "part int, chunk long, held binary, docs long, words binary, endings binary, used binary, doc binary, tf binary")
    return written(dealt.repartition(parts, "part").mapInArrow(
        meet, "chunk long, part int, sums binary, soft binary, known binary"), "lm-counts", LARGE_ROWS)


def vocabulary(counted: DataFrame):
    """(hashes of the frequent words, sorted; their ranks; distinct training words by type)."""
    import numpy as np

    def words(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(row["sums"], "<i8")), pa.array(np.frombuffer(row["soft"], "<i8")),
                     pa.array(np.frombuffer(row["known"], "<i8"))], ["word", "ending", "n"])

    def kinds(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                n = np.frombuffer(row["sums"], "<i8")
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["ending", "n"])

    # at most FREQUENT rows and ENDINGS rows come to the driver
    top = counted.filter("chunk = -1").mapInArrow(words, "word long, ending long, n long").orderBy(
        F.desc("n"), "word").limit(FREQUENT).collect()
    distinct = np.zeros(TYPES + 1, np.int64)
    for r in counted.filter("chunk = -2").mapInArrow(kinds, "ending long, n long").groupBy("ending").agg(
            F.sum("n").alias("n")).collect():
        distinct[FREQUENT + r["ending"]] = r["n"]
    for r in top:
        distinct[FREQUENT + r["ending"]] -= 1
    distinct[:len(top)] = 1
    distinct[TYPES] = 1  # the end
    hashes = np.array([r["word"] for r in top], np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], order, distinct


def _types(words, endings, hashes, ranks):
    """The type of each word."""
    import numpy as np
    if not len(hashes):
        return FREQUENT + endings
    spot = np.minimum(np.searchsorted(hashes, words), len(hashes) - 1)
    return np.where(hashes[spot] == words, ranks[spot], FREQUENT + endings)


def _with_ends(index, bounds, end: int):
    """The tokens of a chunk's documents, each followed by ``end``; and each one's document."""
    import numpy as np
    n = np.diff(bounds)
    docs = np.repeat(np.arange(len(n)), n + 1)
    stream = np.full(len(docs), end, np.int64)
    inner = np.ones(len(docs), bool)
    inner[np.cumsum(n + 1) - 1] = False
    stream[inner] = index
    return stream, docs


def _stream(row, vocab):
    """Types of all tokens of a chunk's documents, each followed by the end; and each one's document."""
    import numpy as np
    words, endings, index, bounds, held = _chunk(row)
    stream, docs = _with_ends(index, bounds, len(words))
    return np.append(_types(words, endings, *vocab), TYPES)[stream], docs, held


def neighbours(coded: DataFrame, vocab, classes):
    """Counts over all training tokens: (type, class before) and (type, class after)."""
    import zlib

    import numpy as np
    spark = coded.sparkSession
    model = spark.sparkContext.broadcast((vocab, classes))
    wide = CLASSES + 1
    parts = -(-(TYPES + 1) // PART_TYPES)

    def count(batches):
        import pyarrow as pa
        vocab, classes = model.value
        left, right = np.zeros((TYPES + 1) * wide, np.int64), np.zeros((TYPES + 1) * wide, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                stream, docs, held = _stream(row, vocab)
                stream = stream[~held[docs]]
                own = classes[stream]
                # a text starts after an end; the chunk's last end stands before its first text
                before, after = np.roll(own, 1), np.roll(own, -1)
                left += np.bincount(stream * wide + before, minlength=len(left))
                right += np.bincount(stream * wide + after, minlength=len(right))
        left, right = left.reshape(-1, wide), right.reshape(-1, wide)
        for p in range(parts):
            a, b = p * PART_TYPES, (p + 1) * PART_TYPES
            if left[a:b].any() or right[a:b].any():
                raw = np.concatenate([left[a:b], right[a:b]]).astype("<i8").tobytes()
                yield pa.RecordBatch.from_pylist([{"part": p, "counts": zlib.compress(raw, 1)}],
                                                 schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    def add(batches):
        import pyarrow as pa
        total: dict[int, object] = {}
        for batch in batches:
            for p, c in zip(*(batch.column(i).to_pylist() for i in range(2))):
                n = np.frombuffer(zlib.decompress(c), "<i8")
                total[p] = total[p] + n if p in total else n.copy()
        for p, n in total.items():
            yield pa.RecordBatch.from_pylist([{"part": p, "counts": zlib.compress(n.tobytes(), 1)}],
                                             schema=pa.schema([("part", pa.int32()), ("counts", pa.binary())]))

    kind = "part int, counts binary"
    # types x classes numbers, whatever the input
    sums = coded.select("words", "endings", "index", "bounds", "held").mapInArrow(count, kind).repartition(
        min(parts, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))), "part").mapInArrow(add, kind).collect()
    left, right = np.zeros((TYPES + 1, wide), np.int64), np.zeros((TYPES + 1, wide), np.int64)
    for r in sums:
        n = np.frombuffer(zlib.decompress(r["counts"]), "<i8").reshape(2, -1, wide)
        a = r["part"] * PART_TYPES
        left[a:a + n.shape[1]], right[a:a + n.shape[1]] = n
    return left, right


def class_counts(right, classes):
    """Transitions between classes."""
    import numpy as np
    out = np.zeros((CLASSES + 1, CLASSES + 1), np.int64)
    np.add.at(out, classes, right)
    return out


def transition_logs(pairs):
    """log10 p(next class | class), smoothed."""
    import numpy as np
    each = pairs.sum(0) + 1.0
    share = each / each.sum()
    return np.log10((pairs + TRANSITION_PRIOR * share) / (pairs.sum(1, keepdims=True) + TRANSITION_PRIOR))


def exchange(left, right, classes, moving):
    """New classes: each moving type goes to the class that makes its tokens most likely."""
    import numpy as np
    steps = transition_logs(class_counts(right, classes))
    total = right.sum(1)
    size = np.bincount(classes, total, CLASSES + 1)
    gain = left @ steps + right @ steps.T - total[:, None] * np.log10(size + 1.0)
    gain[:, CLASSES] = -np.inf  # the end's own
    best = gain[:, :CLASSES].argmax(1)
    out = classes.copy()
    moves = moving & (total > 0)
    moves[TYPES] = False
    out[moves] = best[moves]
    return out


def cluster(coded: DataFrame, vocab, rounds: int = ROUNDS):
    """(class of each type, transitions between the classes)."""
    import numpy as np
    first = np.arange(TYPES + 1) % CLASSES  # frequent words are in order of frequency
    first[TYPES] = CLASSES
    classes = first
    for k in range(rounds):
        left, right = neighbours(coded, vocab, classes)
        classes = exchange(left, right, classes, (np.arange(TYPES + 1) * 2654435761 >> 7) % 2 == k % 2)
    left, right = neighbours(coded, vocab, classes)
    return classes, class_counts(right, classes)


def _dealt(words, types, parts: int):
    """Places of a chunk's words that are not among the most frequent, in order of their part, and
    where each part's begin and end."""
    import numpy as np
    rest = np.flatnonzero(types >= FREQUENT)
    to = ((words[rest] >> np.uint64(20)) % np.uint64(parts)).astype(np.int64)
    ways = np.argsort(to, kind="stable")
    return rest[ways], np.concatenate([[0], np.cumsum(np.bincount(to, minlength=parts))])


def best_classes(counts_of, codes, counts, steps, logs, now):
    """The class of each word that makes its tokens most likely, and its tokens. A word has
    ``counts_of`` of the neighbours ``codes`` (class before, or CLASSES + 1 + class after), in order of
    the words; without any it keeps its class."""
    import numpy as np
    table = np.concatenate([steps[:, :CLASSES], steps.T[:, :CLASSES]])
    ends = np.cumsum(counts_of)
    total = np.bincount(np.repeat(np.arange(len(now)), counts_of), np.where(codes <= CLASSES, counts, 0), len(now)).astype(np.int64)
    out = now.copy()
    some = np.flatnonzero(counts_of)
    # at most 2 * (CLASSES + 1) codes a word
    cuts = [0, *(np.flatnonzero(np.diff(ends[some] // GAINS_AT_ONCE)) + 1).tolist(), len(some)]
    for i, j in zip(cuts[:-1], cuts[1:]):
        own = some[i:j]
        if len(own):
            a, b = ends[own[0]] - counts_of[own[0]], ends[own[-1]]
            gains = np.add.reduceat(table[codes[a:b]] * counts[a:b, None], ends[own] - counts_of[own] - a, axis=0)
            out[own] = (gains - total[own, None] * logs[None, :]).argmax(1)
    return out, total


def move_words(coded: DataFrame, vocab, classes, pairs) -> tuple[DataFrame, int]:
    """(Rows of each chunk and part, the number of parts.) Written rows of two kinds. chunk >= 0: the classes of a chunk's words in one part (wpart) that are
    not among the most frequent, each by its own neighbours. chunk = -1: a part's distinct training words by class."""
    import numpy as np
    spark = coded.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    model = spark.sparkContext.broadcast((vocab, classes))
    steps, logs = transition_logs(pairs), np.log10(pairs.sum(1)[:CLASSES] + 1.0)
    wide = CLASSES + 1

    def deal(batches):
        import pyarrow as pa
        vocab, classes = model.value
        names = ["wpart", "part", "chunk", "words", "own", "n", "codes", "counts"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5]
        for batch in batches:
            for row in batch.to_pylist():
                words, endings, index, bounds, held = _chunk(row)
                types = _types(words, endings, *vocab)
                own = classes[types]
                at, ends = _dealt(words, types, parts)
                place = np.full(len(words) + 1, -1, np.int64)  # the last one: the end of a text
                place[at] = np.arange(len(at))
                stream, docs = _with_ends(index, bounds, len(words))
                stream = stream[~held[docs]]
                near = np.append(own, CLASSES)[stream]
                where = place[stream]
                rest = where >= 0
                pairs, n = np.unique(np.concatenate([
                    where[rest] * (2 * wide) + np.roll(near, 1)[rest],
                    where[rest] * (2 * wide) + wide + np.roll(near, -1)[rest]]), return_counts=True)
                many = np.bincount(pairs // (2 * wide), minlength=len(at))
                cuts = np.concatenate([[0], np.cumsum(many)])[ends]
                codes, n, mine = (pairs % (2 * wide)).astype("u1"), n.astype("<u4"), own[at].astype("u1")
                rows = [(p, row["part"], row["chunk"], words[at[a:b]].tobytes(), mine[a:b].tobytes(), many[a:b].astype("<u4").tobytes(),
                         codes[x:y].tobytes(), n[x:y].tobytes())
                        for p, (a, b, x, y) in enumerate(zip(ends[:-1], ends[1:], cuts[:-1], cuts[1:])) if a < b]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def meet(batches):
        import pyarrow as pa
        names = ["wpart", "part", "chunk", "classes"]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
        rows = [r for batch in batches for r in batch.to_pylist()]
        for wpart in sorted({r["wpart"] for r in rows}):
            held = [r for r in rows if r["wpart"] == wpart]
            each = [np.frombuffer(r["words"], "<u8") for r in held]
            words, inverse = np.unique(np.concatenate(each), return_inverse=True)
            inverse = np.split(inverse, np.cumsum([len(x) for x in each])[:-1])
            now = np.zeros(len(words), np.int64)
            keys, counts = [], []
            for r, inv in zip(held, inverse):
                now[inv] = np.frombuffer(r["own"], "u1")
                keys.append(np.repeat(inv, np.frombuffer(r["n"], "<u4")) * (2 * wide) + np.frombuffer(r["codes"], "u1"))
                counts.append(np.frombuffer(r["counts"], "<u4"))
            keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
            ways = np.argsort(keys, kind="stable")
            keys, counts = keys[ways], counts[ways]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            counts = np.add.reduceat(counts, first) if len(first) else counts
            keys = keys[first]
            new, total = best_classes(np.bincount(keys // (2 * wide), minlength=len(words)), keys % (2 * wide), counts, steps, logs, now)
            out = [(wpart, r["part"], r["chunk"], new[inv].astype("u1").tobytes()) for r, inv in zip(held, inverse)]
            out.append((wpart, -1, -1, np.bincount(new[total > 0], minlength=CLASSES).astype("<i8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    dealt = coded.select("part", "chunk", "held", "bounds", "words", "endings", "index").mapInArrow(
        deal, "wpart int, part int, chunk long, words binary, own binary, n binary, codes binary, counts binary")
    return written(dealt.repartition(parts, "wpart").mapInArrow(
        meet, "wpart int, part int, chunk long, classes binary"), "lm-moved"), parts


def class_streams(coded: DataFrame, vocab, classes, moved: DataFrame, parts: int) -> DataFrame:
    """Written: each chunk's tokens as classes, its texts each followed by the end."""
    spark = coded.sparkSession
    model = spark.sparkContext.broadcast((vocab, classes))

    def run(batches):
        import numpy as np
        import pyarrow as pa
        vocab, classes = model.value
        names = ["chunk", "doc_ids", "held", "bounds", "stream"]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.binary()]
        for batch in batches:
            for row in batch.to_pylist():
                words, endings, index, bounds, _ = _chunk(row)
                types = _types(words, endings, *vocab)
                own = np.append(classes[types], CLASSES).astype("u1")
                at, ends = _dealt(words, types, parts)
                for m in row["moved"] or ():
                    p = m["wpart"]
                    own[at[ends[p]:ends[p + 1]]] = np.frombuffer(m["classes"], "u1")
                stream, _ = _with_ends(index, bounds, len(words))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(
                    (row["chunk"], row["doc_ids"], row["held"], row["bounds"], own[stream].tobytes()), kinds)], names)

    to = moved.filter("chunk >= 0").groupBy("part", "chunk").agg(
        F.collect_list(F.struct("wpart", "classes")).alias("moved")).hint("shuffle_hash")
    with joined_in_place(spark, CHUNKS_AT_ONCE):
        return written(coded.join(to, ["part", "chunk"], "left").select(
            "chunk", "doc_ids", "held", "bounds", "words", "endings", "index", "moved").mapInArrow(
            run, "chunk long, doc_ids array<long>, held array<boolean>, bounds binary, stream binary"), "lm-streams", LARGE_ROWS)


def _told(row):
    """Classes of a chunk's tokens, each one's document, and the documents held out."""
    import numpy as np
    n = np.diff(np.frombuffer(row["bounds"], "<i8"))
    return np.frombuffer(row["stream"], "u1"), np.repeat(np.arange(len(n)), n + 1), np.array(row["held"], bool)


def transitions(streams: DataFrame):
    """Transitions between classes over all training tokens."""
    import numpy as np
    wide = CLASSES + 1

    def count(batches):
        import pyarrow as pa
        total = np.zeros(wide * wide, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                stream, docs, held = _told(row)
                own = stream[~held[docs]].astype(np.int64)
                total += np.bincount(np.roll(own, 1) * wide + own, minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    out = np.zeros(wide * wide, np.int64)
    for r in streams.select("held", "bounds", "stream").mapInArrow(count, "at long, n long").groupBy("at").agg(
            F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(wide, wide)


def class_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    import numpy as np
    spark = docs.sparkSession

    def by_class(batches):
        import pyarrow as pa
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES), pa.int32()), pa.array(
                    np.frombuffer(row["classes"], "<i8"))], ["class", "n"])

    coded = code_texts(docs, id_col, text_col)
    with arrow_rows(spark, CHUNKS_AT_ONCE):
        counted = count_words(coded)
        hashes, ranks, distinct = vocabulary(counted)
        vocab = (hashes, ranks)
        classes, pairs = cluster(coded, vocab, rounds)
        moved, parts = move_words(coded, vocab, classes, pairs)
        streams = class_streams(coded, vocab, classes, moved, parts)
        pairs = transitions(streams)
    # the end is a word too; it is known if there is any training text
    ends, train = int(pairs[:, CLASSES].sum()), int(pairs.sum())
    words = int(distinct[:TYPES].sum()) + (ends > 0)
    tokens = pairs.sum(1).astype(float)
    kinds = np.bincount(classes[:FREQUENT], distinct[:FREQUENT], CLASSES + 1)
    for r in moved.filter("chunk = -1").mapInArrow(by_class, "class int, n long").groupBy("class").agg(F.sum("n").alias("n")).collect():
        kinds[r["class"]] += r["n"]
    below = np.log10(tokens + EMISSION_PRIOR * (kinds + 1))
    below[CLASSES] = 0.0  # the end's class holds nothing else
    model = spark.sparkContext.broadcast(transition_logs(pairs) - below[None, :])

    def told(batches):
        import pyarrow as pa
        steps = model.value
        for batch in batches:
            for row in batch.to_pylist():
                own, docs, held = _told(row)
                before = np.concatenate([[CLASSES], own[:-1]])
                sums = np.bincount(docs, steps[before, own], len(held))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"]] * len(held), pa.int64()), pa.array(range(len(held)), pa.int64()),
                     pa.array(row["doc_ids"], pa.int64()), pa.array(row["held"], pa.bool_()),
                     pa.array(np.bincount(docs, minlength=len(held)), pa.int64()), pa.array(sums, pa.float64())],
                    ["chunk", "place", "doc_id", "held_out", "n_tokens", "steps"])

    def by_document(batches):
        import pyarrow as pa

        def total(chunk, sums):
            s, e, k = sums
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk] * len(s), pa.int64()), pa.array(range(len(s)), pa.int64()),
                 pa.array(s), pa.array(e), pa.array(k.astype(np.int64))], ["chunk", "place", "sums", "soft", "known"])

        last, held = None, None
        for batch in batches:  # in order of chunk and part
            for row in batch.to_pylist():
                own = [np.frombuffer(row[c], "<f8") for c in ("sums", "soft", "known")]
                if row["chunk"] != last:
                    if held is not None:
                        yield total(last, held)
                    last, held = row["chunk"], own
                else:
                    held = [x + y for x, y in zip(held, own)]
        if held is not None:
            yield total(last, held)

    with arrow_rows(spark, CHUNKS_AT_ONCE):
        steps = written(streams.mapInArrow(told, "chunk long, place long, doc_id long, held_out boolean, n_tokens long, steps double"), "lm-steps")
    with arrow_rows(spark, 50 * CHUNKS_AT_ONCE):
        sums = written(counted.filter("chunk >= 0").repartition("chunk").sortWithinPartitions("chunk", "part").mapInArrow(
            by_document, "chunk long, place long, sums double, soft double, known long"), "lm-sums")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))  # noqa: E731  (a document without words has no postings)
    return steps.join(sums, ["chunk", "place"], "left").select(
        "doc_id", "held_out", "n_tokens", (zero("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        (zero("sums") + float(np.log10(ends + 1)) - F.col("n_tokens") * float(np.log10(train + words + 1))).alias("base_score"),
        (zero("soft") + F.col("steps")).alias("score"))
