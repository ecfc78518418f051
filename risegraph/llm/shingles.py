"""Word hashes and word shingles of whole texts, as numpy arrays inside a task."""

from __future__ import annotations

_MIX = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD93


def lower_words(texts):
    """(words, bounds): the words, A-Z in lower case, of a batch of texts (UTF-8 bytes, null: none)
    in one Arrow array, and where each text's begin and end."""
    import numpy as np
    import pyarrow as pa
    split = [t.lower().split() if t else [] for t in texts]  # bytes: ASCII case and white space only
    flat = pa.array([w for words in split for w in words], pa.large_binary())
    return flat, np.cumsum([0] + [len(words) for words in split])


def word_hashes(words):
    """A 64-bit hash of each word."""
    import numpy as np
    import xxhash
    coded = words.dictionary_encode()
    names = coded.dictionary.to_pylist()
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))
    return table[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else np.zeros(0, np.uint64)


def mixed(x):
    """A bijective mix of 64-bit values."""
    import numpy as np
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_STEP)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_MIX)
    return x ^ (x >> np.uint64(32))


def rolled(hashes, size: int):
    """The hash of every run of ``size`` words, at its first word (``len(hashes) - size + 1``)."""
    import numpy as np
    n = max(0, len(hashes) - size + 1)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(_MIX) + hashes[i:i + n])
    return out


def shingle_sets(texts, size: int):
    """The sorted distinct shingle hashes of each text; a text with fewer words is one shingle
    of all its words, one without words has none."""
    import numpy as np
    words, bounds = lower_words(texts)
    hashes = word_hashes(words)
    runs = rolled(hashes, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = b - a
        if n >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        else:
            out.append(rolled(hashes[a:b], n) if n else np.zeros(0, np.uint64))
    return out
