"""The document operators against brute force, on a small corpus with every awkward case."""

import collections
import hashlib
import math
import re
import struct
import zlib

import pytest

from risegraph.llm import byte_bpe, class_lm, exact_dedup, ngram_join, packing, passages, pii, quality

from .fixtures import corpus, documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LABELS = "doc_id long, quality int, toxic int"


def key(x):
    return tuple((v is not None, v) for v in x)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def test_empty_tables(spark):
    docs, labels = documents(spark, []), spark.createDataFrame([], LABELS)
    tokenizers = pytest.importorskip("public_tokenizers")
    for frame in (
            quality.quality_rules(docs, labels), packing.pack(docs, tokenizers.path("word_bpe_49k.json")),
            ngram_join.ngram_join(docs), pii.find_pii(docs), class_lm.class_scores(docs, rounds=1),
            byte_bpe.encode_decode(docs, tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN),
            passages.repeated_passages(docs), exact_dedup.exact_dedup(docs)):
        assert frame.collect() == []


def test_exact_dedup(spark):
    rows = corpus()
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    expected, kept = [], set()
    for i, t in sorted(norm, key=lambda x: (x[0] is None, x[0] or 0)):
        ids = [x for x in groups[t] if x is not None]
        expected.append((i, min(ids) if ids else None, len(groups[t]), t not in kept, hashlib.sha256(t.encode()).hexdigest()))
        kept.add(t)
    same(exact_dedup.exact_dedup(documents(spark)).collect(), expected)
    # every head hot, in runs of 1, 3 and 64 salts
    for salts in (1, 3, 64):
        same(exact_dedup.exact_dedup(documents(spark), salts=salts, hot_from=0).collect(), expected)
    left = exact_dedup.drop_exact_copies(documents(spark))
    assert left.columns == documents(spark).columns
    assert sorted(re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in left.collect()) == sorted(groups)


def test_neighbours_find_the_copies(spark):
    rows = corpus()
    runs = exact_dedup.sorted_runs(documents(spark), "doc_id", "text").collect()
    texts = {re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows}
    assert not any(r["hot"] for r in runs)  # no head holds 64 rows here
    assert sum(r["place"] > 1 for r in runs) == len(rows) - len(texts) > 10
    many = rows + [(5000 + i, "one text " * 40) for i in range(150)]
    runs = exact_dedup.sorted_runs(documents(spark, many), "doc_id", "text", salts=8).collect()
    assert sum(r["hot"] for r in runs) == 150 and len({r["run"] for r in runs if r["hot"]}) == 8
    assert sum(r["norm"] is not None for r in runs) == 8
    kept = [r for r in exact_dedup.exact_dedup(documents(spark, many), salts=8).collect() if (r["doc_id"] or 0) >= 5000]
    assert {(r["keep_id"], r["group_size"]) for r in kept} == {(5000, 150)} and [r["doc_id"] for r in kept if r["kept"]] == [5000]


def brute_components(rows, least=75, size=5):
    sets = []
    for _, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= least * len(x | sets[j]):
                parent[root(i)] = root(j)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least_id[root(i)] = min(d, least_id.get(root(i), d))
    return [(d, len(s), least_id.get(root(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))], [root(i) for i in range(len(rows))]


def test_ngram_join(spark):
    expected, roots = brute_components(corpus())
    same(ngram_join.ngram_join(documents(spark)).collect(), expected)
    left = ngram_join.drop_near_copies(documents(spark))
    worded = [r for r, (_, t) in zip(roots, corpus()) if WORD.search(t or "")]
    wordless = len(roots) - len(worded)
    assert left.count() == len(set(worded)) + wordless
    assert left.columns == documents(spark).columns


def test_ngram_join_without_stars(spark, monkeypatch):
    """The matrix alone finds every link: grouping only saves work."""
    monkeypatch.setattr(ngram_join, "star_links", lambda nodes, sets, percent: spark.createDataFrame([], "a long, b long"))
    monkeypatch.setattr(ngram_join, "BLOCK", 200)
    monkeypatch.setattr(ngram_join, "QUERIES", 300)
    same(ngram_join.ngram_join(documents(spark)).collect(), brute_components(corpus())[0])


def test_quality_rules(spark):
    xxhash = pytest.importorskip("xxhash")
    rows = corpus()
    good = {*range(14), *range(100, 106)}
    held = {i for i in good if zlib.crc32(str(i).encode()) % 4 == 3}
    assert 2 < len(held) < len(good) - 2
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(200, 0, 0), (201, 1, 1), (None, 1, 0), (202, None, None)], LABELS)

    def grams(w):
        single = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]
        pairs = [xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) for a, b in zip(w, w[1:])]
        return [(x - (1 << 64) if x >> 63 else x) % quality.BUCKETS for x in single + pairs]

    raw, trusted = collections.Counter(), collections.Counter()
    for i, t in rows:
        g = grams(WORD.findall(t or ""))
        raw.update(g)
        if i in good - held:
            trusted.update(g)
    n, m, b = sum(raw.values()), sum(trusted.values()), quality.BUCKETS
    weight = [math.log((trusted[k] + 1) / (m + b)) - math.log((raw[k] + 1) / (n + b)) for k in range(b)]
    found = []
    for i, t in rows:
        w = WORD.findall(t or "")
        windows = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        often = collections.Counter(windows)
        covered = len({k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)})
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        g = grams(w)
        score = sum(weight[k] for k in g) / len(g) if g else 0.0
        failed = len(w) < 20 or 100 * covered > 30 * len(w)
        found.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), covered,
                      failed, score))
    own = sorted(r[-1] for r in found if r[0] in held and not r[-2])
    at = quality.REJECTED * (len(own) - 1)
    least = own[int(at)] + (at - int(at)) * (own[int(at) + 1] - own[int(at)])
    expected = collections.Counter((*r[:-1], round(r[-1], 4), not r[-2] and r[-1] >= least) for r in found)
    assert {r[-1] for r in expected if not r[-3]} == {True, False}
    got = collections.Counter(tuple(r[:7]) + (round(r["score"], 4), r["kept"])
                              for r in quality.quality_rules(documents(spark), labels).collect())
    assert got == expected
    assert quality.keep_good(documents(spark), labels).count() == sum(n for x, n in expected.items() if x[-1])
    # nothing held out: the base rule alone
    few = spark.createDataFrame([(i, 1, 0) for i in good - held], LABELS)
    assert all(r["kept"] != r["base_failed"] for r in quality.quality_rules(documents(spark), few).collect())


def test_quality_rules_trust_every_good_label(spark):
    n = 30_000
    from pyspark.sql import functions as F
    ids = spark.range(n).withColumnRenamed("id", "doc_id")
    labels = ids.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs = ids.select("doc_id", F.concat(F.lit("w"), (F.col("doc_id") % 3).cast("string")).alias("text")).union(
        spark.createDataFrame([(None, "w0 w1"), (n, "w2")], "doc_id long, text string"))
    own = quality.trusted_ids(labels)
    held = {i for i in range(n) if zlib.crc32(str(i).encode()) % 4 == 3}
    assert own.count() == n and {r["doc_id"] for r in own.filter("held").collect()} == held
    good = collections.Counter(i % 3 for i in range(n) if i not in held)
    trusted = quality.trusted_texts(docs, labels)
    counts = quality.bucket_counts(trusted.filter("not held"))
    assert sorted(x for x in counts if x) == sorted(good.values())
    table = quality.weights(docs, trusted)
    raw, seen = collections.Counter(i % 3 for i in range(n)) + collections.Counter([0, 1, 2]), sum(good.values())
    b = quality.BUCKETS
    expected = [math.log((good[k] + 1) / (seen + b)) - math.log((raw[k] + 1) / (n + 4 + b)) for k in range(3)]
    places = [k for k, x in enumerate(counts) if x]
    assert sorted(round(table[k], 9) for k in places) == sorted(round(x, 9) for x in expected)
    # the threshold is a quantile of all held-out texts past the base rule
    long = docs.withColumn("text", F.concat(F.repeat(F.concat("text", F.lit(" ")), 7), F.lit("a b c d e f g h i j k l m "), F.col("doc_id").cast("string")))
    trusted = quality.trusted_texts(long, labels)
    table = quality.weights(long, trusted)
    scored = quality.with_score(long.join(own.filter("held"), "doc_id").select("text"), "text", table)
    scores = sorted(r["score"] for r in scored.select("score", "base_failed").collect() if not r["base_failed"])
    assert len(scores) == len(held)
    at = quality.REJECTED * (len(scores) - 1)
    least = scores[int(at)] + (at - int(at)) * (scores[int(at) + 1] - scores[int(at)])
    assert abs(quality.threshold(trusted, table) - least) < 1e-12


def test_packing(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = corpus() + [(700, "a <|endoftext|> b"), (701, "x<|endoftext|>y <|startoftext|>"), (702, "<|ENDOFTEXT|> <|endof text|>")]
    assert 49407 in t.encode(rows[-3][1], add_special_tokens=False).ids
    pieces = packing.pack(documents(spark, rows), path, length=256, with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for i, text in rows:
        by_doc[i].append(t.encode(text or "", add_special_tokens=False).ids + [2])
    # every sequence but the last is full and gapless
    held = collections.defaultdict(list)
    for p in pieces:
        assert p["ids_crc32"] == zlib.crc32(p["ids"]) and len(p["ids"]) == 4 * p["length"]
        held[p["sequence_id"]].append(p)
    for s, own in held.items():
        own.sort(key=lambda p: p["offset"])
        assert [p["offset"] for p in own] == [sum(q["length"] for q in own[:k]) for k in range(len(own))]
        assert sum(p["length"] for p in own) == 256 or s == max(held)
    # read in order, the sequences are the documents one after another
    whole, ends = [], collections.Counter()
    for s in sorted(held):
        for p in held[s]:
            assert p["start"] == len(whole)
            whole += struct.unpack(f"<{p['length']}I", p["ids"])
            if len(whole) == p["doc_tokens"]:
                ends[(p["doc_id"], tuple(whole))] += 1
                whole = []
    assert not whole and ends == collections.Counter((i, tuple(x)) for i, xs in by_doc.items() for x in xs)


def test_word_ids_equal_whole_texts():
    tokenizers = pytest.importorskip("public_tokenizers")
    words = packing.WordIds(tokenizers.path("word_bpe_49k.json"), most=50)
    texts = ["", "á J̌ Å ΣΣ İ İx don't we'LL '' 's.", "<|endoftext|> x<|startoftext|>",
             "\x85 \x1c\x1d a\x1cb c  ", "1,234.5% –! 日本語\U0001f600 naïve", "w " * 300,
             " ".join(t or "" for _, t in corpus())]
    for text, ids in zip(texts, words.encode([x.encode() for x in texts])):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_word_ids_whatever_the_batch():
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    texts = ["", " ", "\x0b\x0c\r\n", " a  B,\t", "word, Word; WORD! wörd, WÖRD.", "x\x1cy z", "", *[t or "" for _, t in corpus()]]
    for size, most in ((1, 0), (3, 40), (len(texts), 10_000)):
        words = packing.WordIds(tokenizers.path("word_bpe_49k.json"), most=most)
        got = [x for k in range(0, len(texts), size) for x in words.encode([x.encode() for x in texts[k:k + size]])]
        for text, ids in zip(texts, got, strict=True):
            assert [*struct.unpack(f"<{len(ids) // 4}I", ids)] == t.encode(text, add_special_tokens=False).ids
        assert b"" in words.known and b"word," in words.known or most < 10_000


def test_byte_bpe(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.coder(path, tokenizers.PATTERN)
    own = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rows = corpus() + [(600, "a" * 30000), (601, "the" * 9000), (602, "I'm we'LL  don't\n\n\n \x1c\x85 x ")]
    expected = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                         hashlib.sha256((t or "").encode()).hexdigest()))
    same(byte_bpe.encode_decode(documents(spark, rows), path, tokenizers.PATTERN).collect(), expected)


def test_rank_queue_order():
    queue = byte_bpe.RankQueue(50_000)
    import random
    rnd = random.Random(1)
    wait = set()
    for _ in range(3000):
        if wait and rnd.random() < 0.5:
            assert queue.first() == min(wait)
            queue.take(min(wait))
            wait.remove(min(wait))
        else:
            r = rnd.randrange(50_000)
            queue.put(r, [1])
            wait.add(r)


BASE = {0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        1: re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), 2: re.compile(r"[0-9]([\x20-]?[0-9])+"),
        3: re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def brute_spans(t):
    out = []
    for k, rule in BASE.items():
        for m in rule.finditer(t):
            digits = re.sub("[^0-9]", "", m.group())
            if (k == 1 and any(int(x) > 255 for x in m.group().split("."))
                    or k == 2 and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or k == 3 and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_rules():
    import random
    rnd = random.Random(1)
    for _ in range(20000):
        t = "".join(rnd.choice("a1.@+- 2(9)_é0") for _ in range(rnd.randint(0, 26)))
        assert pii.base_spans(t) == brute_spans(t)
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []  # in linear time


def test_pii_bootstraps(spark):
    seeds = [(i, f"some words user id {i}.{i}@host.example.org and more") for i in range(10)]
    unseen = [(100 + i, f"other words user id K{i}77-991{i} and more") for i in range(2)]
    clean = [(200 + i, f"a plain text about the year {1990 + i} and nothing else") for i in range(5)]
    rows = seeds + unseen + clean + [(300, None), (301, ""), (None, "call +1 (212) 555-0123 now"), (0, seeds[0][1])]
    got = pii.find_pii(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        texts = {t or "" for i, t in rows if i == r["doc_id"]}
        spans = {pii.joined(brute_spans(t)) for t in texts}
        assert r["base_sha256"] in {hashlib.sha256(s.encode()).hexdigest() for s in spans}
        if r["doc_id"] in (100, 101):
            assert r["spans"] == "id:20:29" and r["n_id"] == 1
        else:
            assert r["spans"] in spans
    left = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, rows)).collect()}
    assert left[100] == "other words user id [ID] and more" and left[None] == "call [PHONE] now"
    assert left[300] is None and left[200] == clean[0][1]


def test_class_scores(spark):
    rows = corpus()
    got = class_lm.class_scores(documents(spark, rows), rounds=2).collect()
    texts = [(i, WORD.findall((t or "").translate(LOWER)) + [None]) for i, t in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = collections.Counter(w for i, ws in texts if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    same([(r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got],
         [(i, held(i), len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5))
          for i, ws in texts])
    assert all(r["score"] < 0 for r in got)
    # probabilities of the next class add up to one
    import numpy as np
    steps = class_lm.transition_logs(np.random.default_rng(1).integers(0, 9, (5, 5)))
    assert np.allclose((10 ** steps).sum(1), 1)


def test_classes_beat_the_base_on_unseen_text(spark):
    import random
    rnd = random.Random(5)
    kinds = [[f"{k}{j}" for j in range(60)] for k in "abcd"]
    rows = [(i, " ".join(rnd.choice(kinds[(i + j) % 4]) for j in range(80))) for i in range(120)]
    got = [r for r in class_lm.class_scores(documents(spark, rows), rounds=6).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_large_rows_are_not_one_page(spark):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F
    from risegraph.llm.common import LARGE_ROWS, written
    raw = F.transform(F.sequence(F.lit(0), F.lit(3999)), lambda k: F.sha2((F.col("id") * 4000 + k).cast("string").cast("binary"), 512))
    rows = spark.range(0, 90, 1, 1).select("id", F.array_join(raw, "").cast("binary").alias("value"))  # half a megabyte each
    stored = written(rows, "large-rows", LARGE_ROWS)
    [name] = stored.inputFiles()
    meta = pq.ParquetFile(name.removeprefix("file://").removeprefix("file:")).metadata
    assert meta.num_rows == 90 and meta.num_row_groups > 1
    assert meta.row_group(0).column(1).total_uncompressed_size < 40 << 20
    assert stored.exceptAll(rows).count() == rows.exceptAll(stored).count() == 0
    coded = class_lm.code_texts(documents(spark), "doc_id", "text")
    name = coded.inputFiles()[0]
    assert pq.ParquetFile(name.removeprefix("file://").removeprefix("file:")).metadata.row_group(0).column(0).compression == "ZSTD"


def test_every_training_word_moves_on_its_own_neighbours(spark):
    import numpy as np
    import random
    rnd = random.Random(3)
    names = [f"w{k}q" for k in range(14_000)]
    rows = [(i, " ".join(names[int(14_000 * rnd.random() ** 3)] for _ in range(rnd.randint(300, 700)))) for i in range(80)]
    rows += [(None, "W1q  w2Q"), (900, ""), (901, None)]
    coded = class_lm.code_texts(documents(spark, rows), "doc_id", "text")
    hashes, ranks, distinct = class_lm.vocabulary(class_lm.count_words(coded))
    vocab = (hashes, ranks)
    classes, pairs = class_lm.cluster(coded, vocab, 2)
    moved, parts = class_lm.move_words(coded, vocab, classes, pairs)
    streams = class_lm.class_streams(coded, vocab, classes, moved, parts)
    import xxhash
    rank = dict(zip(hashes.tolist(), ranks.tolist()))

    def kind(w):
        h = xxhash.xxh3_64_intdigest(w.encode())
        return rank.get(h, class_lm.FREQUENT + xxhash.xxh3_64_intdigest(w.encode()[-3:]) % class_lm.ENDINGS)

    texts = [(i, WORD.findall((t or "").translate(LOWER))) for i, t in rows]
    held = {i for i, _ in texts if i is not None and zlib.crc32(str(i).encode()) % 7 == 2}
    first = {w: int(classes[kind(w)]) for _, ws in texts for w in ws}
    end, steps, size = class_lm.CLASSES, class_lm.transition_logs(pairs), pairs.sum(1)
    near = collections.defaultdict(list)
    for i, ws in texts:
        own = [end, *(first[w] for w in ws), end]
        if i not in held:
            for k, w in enumerate(ws):
                near[w].append((own[k], own[k + 2]))
    expected = dict(first)
    for w, seen in near.items():
        if kind(w) >= class_lm.FREQUENT:
            gain = sum(steps[a, :end] + steps[:end, b] for a, b in seen) - len(seen) * np.log10(size[:end] + 1.0)
            expected[w] = gain
    rest = [w for w in near if kind(w) >= class_lm.FREQUENT]
    assert len(rest) > 500 and any(w not in near for w in first)
    got = collections.defaultdict(set)
    by_id = collections.defaultdict(list)
    for i, ws in texts:
        by_id[i].append(ws)
    for r in streams.collect():
        bounds, stream = np.frombuffer(r["bounds"], "<i8"), list(r["stream"])
        for k, i in enumerate(r["doc_ids"]):
            own = stream[bounds[k] + k:bounds[k + 1] + k + 1]
            [ws] = by_id[i]
            assert own[-1] == end and len(own) == len(ws) + 1
            for w, c in zip(ws, own):
                got[w].add(c)
    for w, seen in got.items():
        [c] = seen
        if isinstance(expected[w], int):
            assert c == expected[w]
        else:
            assert expected[w][c] >= expected[w].max() - 1e-9
    assert sum(first[w] not in got[w] for w in rest) > len(rest) // 2
    # distinct training words by class, and transitions, of the new classes
    kinds = sum(np.frombuffer(r["classes"], "<i8") for r in moved.filter("chunk = -1").collect())
    assert kinds.tolist() == [sum(c in got[w] for w in rest) for c in range(end)]
    wanted = collections.Counter()
    for i, ws in texts:
        if i not in held:
            own = [end, *(min(got[w]) for w in ws), end]
            wanted.update(zip(own, own[1:]))
    assert {(a, b): int(n) for (a, b), n in np.ndenumerate(class_lm.transitions(streams)) if n} == dict(wanted)


def test_passages(spark):
    got = passages.repeated_passages(documents(spark)).collect()
    pairs = {(r["doc_id"], r["other_id"]) for r in got}
    assert pairs == {(b, a) for a, b in pairs}
    named = {a for a, _ in pairs}
    assert set(range(100, 106)) <= named and set(range(200, 208)) <= named and 0 in named and set(range(300, 305)) <= named
    assert not named & {5, 6, 9, 10, 11, 12, 13, 500, 501, 503, 506}
    texts = {i: WORD.findall((t or "").translate(LOWER)) for i, t in corpus() if i is not None and i != 8}
    for r in got:
        if r["doc_id"] in range(100, 106) and r["other_id"] in range(100, 106):
            assert abs(r["n_words"] - 70) <= 4 and abs(r["start_word"] - 40) <= 4
            a = texts[r["doc_id"]][r["start_word"]:r["start_word"] + r["n_words"]]
            straight = sum(x == y for x, y in zip(a, texts[r["other_id"]][r["other_start"]:]))
            assert straight <= r["n_equal"] <= straight + 1  # the edits' own word may match aslant


def test_chains_equal_brute_force():
    import random
    rnd = random.Random(2)
    for _ in range(200):
        points = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(12)})
        best, score = 0.0, []
        for i, (x, y) in enumerate(points):
            before = [score[j] - passages.GAP * (x - a + y - b) for j, (a, b) in enumerate(points[:i]) if a < x and b < y]
            score.append(passages.GAIN + max([0.0, *before]))
            best = max(best, score[-1])
        tree = passages.Fenwick(41)
        for i, v in enumerate(score):
            tree.put(points[i][1], v, i)
        assert tree.upto(41)[0] == best
        found = passages.chains([p[0] for p in points], [p[1] for p in points])
        for chain in found:
            assert all(a < c and b < d for (a, b), (c, d) in zip(chain, chain[1:]))
