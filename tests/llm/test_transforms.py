"""Fill-in-middle, spelling variants and license scans against brute force."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from risegraph.llm import fill_middle, licenses, spelling

from .fixtures import corpus, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(x):
    return tuple((v is not None, v) for v in x)


def same(got, expected):
    assert sorted(map(tuple, got), key=key) == sorted(expected, key=key)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_fill(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


FILL_ROWS = corpus() + [(i, t) for i, t in enumerate(
    ["<P>", "a<S>b", "<M", "M>", "<<P", "P>>", "<", ">", "é", "🙂🙂", "x🙂y", "a1b2", "\n\n", "ab\ncd", "<P", "S>", "\x00a"] * 5, 2000)]


@pytest.mark.parametrize("chunk", [1, 50, 1 << 20])
def test_fill_middle(spark, chunk):
    docs = documents(spark, FILL_ROWS)
    made = fill_middle.restore(fill_middle.transform(docs, carry=("doc_id", "source", "row"), chunk=chunk), chunk)
    got = made.collect()
    same([(r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in got],
         [brute_fill(i, t) for i, t in FILL_ROWS])
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert all(r["restored"] == (FILL_ROWS[r["row"]][1] or "") and r["source"] == "s" for r in got)


def test_fill_middle_digests(spark):
    got = fill_middle.digests(documents(spark)).collect()
    expected = [brute_fill(i, t) for i, t in corpus()]
    same(got, [(*r[:5], sha(r[5]), sha(t or "")) for r, (_, t) in zip(expected, corpus())])


def brute_vocabulary(rows, least_count):
    count = collections.Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += len(run) >= 6
    return {w: n for w, n in count.items() if n >= least_count}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(a == b[:i] + b[i + 1:] for i in range(len(b)))


def brute_variants(rows, least_count, ratio=5):
    words = brute_vocabulary(rows, least_count)
    near = {w: [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in words}
    form = {}
    for w, around in near.items():
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return out


def variant_rows(seed=5):
    rnd = random.Random(seed)
    letters = "abcdeéß×"
    bases = ["".join(rnd.choice(letters) for _ in range(rnd.randint(6, 9))) for _ in range(25)]
    words = []
    for w in bases:
        words += [w] * rnd.choice([2, 10, 60, 300])
        for _ in range(12):
            i, c = rnd.randrange(len(w)), rnd.choice(letters)
            v = rnd.choice([w[:i] + w[i + 1:], w[:i] + c + w[i + 1:], w[:i] + c + w[i:]])
            words += [v.upper() if rnd.random() < 0.2 else v] * rnd.choice([1, 2, 3, 12])
    words += ["eeddcc"] * 4 + ["eeddca"] * 25 + ["eeddba"] * 150  # a chain of forms
    rnd.shuffle(words)
    rows = [(k, " ".join(words[k::40]) + rnd.choice(["", "1", "-", "\n"])) for k in range(40)]
    return rows + [(None, "abcdef " * 6), (3, None), (4, ""), (5, "abcde 12345 ÷÷÷÷÷÷"), (6, "abcdef" * 300), (6, "abcdef" * 300)]


@pytest.mark.parametrize("least_count", [1, 3])
def test_spelling_variants(spark, least_count):
    rows = variant_rows()
    got = spelling.variants(documents(spark, rows), least_count=least_count)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    expected = brute_variants(rows, least_count)
    same(got.collect(), expected)
    assert any(r[1] and r[2] != r[1] for r in expected)


def test_spelling_on_the_corpus_and_symbols(spark):
    same(spelling.variants(documents(spark), least_count=1).collect(), brute_variants(corpus(), 1))
    assert len(spelling.symbols_for(0)) == 4 and len(spelling.symbols_for(10 ** 7)) == 10
    assert len(spelling.symbols_for(10 ** 30)) == len(spelling.SYMBOLS)


def test_spelling_sends_no_table_to_the_driver(spark, monkeypatch):
    """Small tables would be broadcast, and neighbourhoods count as small."""
    plans, real = [], spelling.written

    def planned(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(spelling, "written", planned)
    out = spelling.variants(documents(spark, variant_rows()), least_count=1)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("Join" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)


def brute_licenses(rows, phrases=licenses.PHRASES, templates=licenses.TEMPLATES, containment=licenses.CONTAINMENT):
    ready = [licenses.Template(label, text, containment) for label, text in templates]
    out = []
    for i, t in rows:
        w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))]
        places = []
        for p, label in phrases:
            p = [x.encode() for x in p.split()]
            places += [(k, label) for k in range(len(w)) if w[k:k + len(p)] == p]
        met = [(x.label, len(x.words & set(w[k:k + 2 * x.step])) / len(x.words)) for x in ready
               for k in range(0, len(w), x.step) if len(x.words & set(w[k:k + 2 * x.step])) * 100 >= containment * len(x.words)]
        at = [k for k, _ in places]
        base = {label for _, label in places}
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
                    ",".join(sorted(base | {label for label, _ in met})),
                    1.0 if at else max((c for _, c in met), default=0.0)))
    return out


def license_rows(seed=3):
    rnd = random.Random(seed)
    vocabulary = sorted({w.decode() for _, t in licenses.TEMPLATES for w in licenses.words_of(t.encode())})
    filler = vocabulary + [f"w{i}" for i in range(200)]
    rows = []
    for k, (_, text) in enumerate(licenses.TEMPLATES):
        for edits in (0, 5, 15, 30):
            w = [rnd.choice(filler) if rnd.random() * 100 < edits else x for x in text.split()]
            around = [rnd.choice(filler) for _ in range(rnd.randint(0, 400))]
            at = rnd.randrange(len(around) + 1)
            rows.append((1000 + 100 * k + edits, " ".join(around[:at] + w + around[at:])))
    rows += [(3000, "The MIT License. the mit  license, CC-BY CC BY; cc by cc by-nc"), (3001, "gnu general public gnu general public license"),
             (3002, "apache\nlicense apache"), (3003, "Ünder çc by"), (3004, "mit licenses"), (3005, " ".join(vocabulary * 3)),
             (3006, " ".join(rnd.choice(filler) for _ in range(9000)))]
    return rows


def test_license_scan(spark):
    rows = corpus() + license_rows()
    found, blocks = licenses.license_scan(documents(spark, rows))
    expected = brute_licenses(rows)
    same(found.collect(), expected)
    assert {x for r in expected for x in r[6].split(",")} >= {label for label, _ in licenses.TEMPLATES}
    assert any(r[2] == 0 and 0 < r[7] < 1 for r in expected)
    by_doc = collections.defaultdict(set)
    for r in blocks.collect():
        by_doc[r["doc_id"]].add(r["label"])
        assert r["containment"] >= 0.8
    for r in expected:
        assert set(filter(None, r[6].split(","))) == by_doc[r[0]] | set(filter(None, r[5].split(",")))


def test_license_scan_equals_its_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = corpus() + license_rows()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    same(con.execute(licenses.oracle()).fetchall(), brute_licenses(rows))
    same(con.execute(fill_middle.ORACLE).fetchall(),
         [(*r[:5], sha(r[5]), sha(t or "")) for r, (_, t) in ((brute_fill(i, t), (i, t)) for i, t in rows)])


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert fill_middle.digests(docs).collect() == spelling.variants(docs).collect() == []
    assert [x.collect() for x in licenses.license_scan(docs)] == [[], []]


def test_text_ids(spark):
    docs = spark.createDataFrame([("a", "some words of text"), (None, "mit license")], "doc_id string, text string")
    same(fill_middle.transform(docs).collect(), [(i, *r[1:]) for i, r in
                                                 (("a", brute_fill("a", "some words of text")), (None, brute_fill(None, "mit license")))])
    same([r[:2] for r in licenses.license_scan(docs)[0].collect()], [("a", 4), (None, 2)])
