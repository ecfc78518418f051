"""Exact Jaccard self-join of word n-gram sets through a token-group matrix.

1. Every text's distinct shingles, by hash; texts with equal sets are one node.
2. Similar nodes are partitioned into groups: nodes that share a minimum under one of
   ``ROUNDS`` hash functions are compared with the smallest of them, and what links is a group.
   All links inside a group are verified, so its members need no further comparison.
3. The token-group matrix holds which groups have a token, for the tokens that matter: a pair
   that links shares one of the first n - ceil(t n) + 1 tokens of both sets in any fixed order
   (here rare tokens first), and in neither is that token so late that what follows is less than
   the overlap that the two sizes need. A node queries the other groups that have such a token.
4. Each such group, in blocks of bounded size, has the union of its members' tokens. The overlap
   of a query with the union bounds its overlap with any member: first over the low quarter of
   the tokens (all others counted as shared), then over all. Only blocks whose bound reaches the
   threshold are opened and their members compared.
5. Components of all links.

Group-to-group duplicates are avoided by letting the smaller group query the larger one. No step
is approximate: hash functions and the rare-first order only decide how much work is saved.
Sets are compared by 48-bit hashes of their shingles, counted by 64-bit ones.

Defined cases: null and empty texts have no shingles and are linked with nothing (their
component is their own id); a null doc_id is carried, and a component of null ids only is null;
rows that repeat an id and text are linked as any equal texts; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW_BITS, WORD, fetched, joined_in_place, whole_text, written, written_by_part
from .components import components
from .shingles import mixed, shingle_sets

SIZE = 5
#: Percent of the union that two linked sets share at least.
PERCENT = 75
#: Hash functions by whose minima groups are formed.
ROUNDS = 4
#: Counters by which tokens are put in order, rare ones first; tokens that share one count
#: together. Bounds what is sent to tasks. Any number gives the same links.
COUNTERS = 1 << 22
#: Pieces in which the counters are added up.
PIECES = 64
#: Shingles of a group's block, and of the queries that meet it in one task.
BLOCK, QUERIES = 1 << 16, 1 << 18
#: Parts over which rows that belong to one key are spread.
SALTS = 16

#: Hashes under it are a set's low tokens, about a quarter, and stand first.
LOW = 1 << 62

SETS = "part int, row long, doc_id long, text_key binary, n long, sig binary, minima array<long>, low int, tokens binary"


def _packed(tokens) -> bytes:
    """Sorted 64-bit hashes as 48-bit values, six bytes each."""
    return tokens.astype("<u8").view("u1").reshape(-1, 8)[:, 2:].tobytes()


def _tokens(packed):
    import numpy as np
    six = np.frombuffer(packed, "u1").reshape(-1, 6)
    out = np.zeros((len(six), 8), "u1")
    out[:, :6] = six
    return out.view("<u8").ravel()


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n with a set that it links to."""
    return -(-percent * n // 100)


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """SETS of every row, written by part."""
    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        row = part << ROW_BITS
        seeds = np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = shingle_sets(some.column(1).to_pylist(), size)
                minima = [[int(mixed(s ^ k).min()) - (1 << 63) for k in seeds] if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(sets), pa.int32()), pa.array(range(row, row + len(sets)), pa.int64()), some.column(0), some.column(2),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                     pa.array(minima, pa.list_(pa.int64())),
                     pa.array([int(np.searchsorted(s, LOW)) for s in sets], pa.int32()), pa.array([_packed(s) for s in sets], pa.binary())],
                    ["part", "row", "doc_id", "text_key", "n", "sig", "minima", "low", "tokens"])
                row += len(sets)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string").cast("binary").alias("text"), text_key(text_col))
    with joined_in_place(docs.sparkSession):
        return written_by_part(rows.mapInArrow(run, SETS), "ngram-sets")


def text_key(text_col: str):
    """Names a row's text, together with its id."""
    return F.unhex(F.md5(whole_text(text_col).cast("binary")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of nodes those that link."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            rows = []
            for a, b, x, y in zip(*(batch.column(i) for i in range(4))):
                x, y = _tokens(x.as_buffer()), _tokens(y.as_buffer())
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    rows.append((a.as_py(), b.as_py()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["a", "b"])

    # a salt from the member: the set that very many members meet is sent to SALTS places at most
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)))
    left = fetched(sets, salted, "a", F.col("tokens").alias("x"))
    right = fetched(sets, salted.select("b", "salt").distinct(), "b", F.col("tokens").alias("y"))
    return left.join(right, ["b", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def star_links(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between nodes and the smallest node that shares one of their minima."""
    marks = nodes.select("node", "n", F.posexplode("minima").alias("round", "minimum"))
    heads = marks.groupBy("round", "minimum").agg(
        F.min(F.struct("node", "n")).alias("head"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    pairs = marks.join(heads.select("round", "minimum", "head"), ["round", "minimum"]).filter(
        "node <> head.node").filter(
        (F.col("n") * percent <= 100 * F.col("head.n")) & (F.col("head.n") * percent <= 100 * F.col("n")))
    pairs = written(pairs.select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct(), "ngram-star-pairs")
    with joined_in_place(pairs.sparkSession):
        return written(verified(pairs, sets, percent), "ngram-star-links")


def token_counts(sets: DataFrame):
    """How many sets have a token of each counter (numpy, at most 65,535): every task counts its own
    sets, and the tasks' counters are added up piece by piece."""
    import numpy as np
    width = COUNTERS // PIECES

    def count(batches):
        import zlib

        import pyarrow as pa
        total, held, size = np.zeros(COUNTERS, np.uint32), [], 0

        def add():
            at, n = np.unique(np.concatenate(held), return_counts=True)
            total[at] += n.astype(np.uint32)

        for batch in batches:
            for x in batch.column(0):
                held.append((_tokens(x.as_buffer()) & np.uint64(COUNTERS - 1)).astype(np.uint32))
                size += len(held[-1])
                if size > 500_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        if total.any():
            pieces = [zlib.compress(total[i * width:(i + 1) * width].tobytes(), 1) for i in range(PIECES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "counts"])

    def add_up(batches):
        import zlib

        import pyarrow as pa
        total = {}
        for batch in batches:
            for piece, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.int64)
                total[piece] = total[piece] + own if piece in total else own
        some = {p: np.minimum(t, 0xFFFF).astype("<u2").tobytes() for p, t in total.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array(list(some.values()), pa.binary())], ["piece", "counts"])

    kind = "piece int, counts binary"
    rows = sets.select("tokens").mapInArrow(count, kind).repartition(PIECES, "piece").mapInArrow(add_up, kind).collect()
    out = np.zeros(COUNTERS, "<u2")
    for r in rows:
        out[r["piece"] * width:(r["piece"] + 1) * width] = np.frombuffer(r["counts"], "<u2")
    return out


def queries_of_groups(nodes: DataFrame, sets: DataFrame, counts, percent: int) -> DataFrame:
    """(a, g): node a has a leading token in common with a member of the other group g of fit size."""
    import numpy as np
    spark = nodes.sparkSession
    often = spark.sparkContext.broadcast(counts)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # a row for each part: its leading tokens and, by place, their nodes; group and size of those
    # nodes that are in groups of more than one
    names = ["part", "base", "tokens", "places", "spots", "rows", "sizes", "grouped", "groups", "members"]

    def deal(batches):
        import pyarrow as pa
        rank = often.value

        def told(base, held):
            lead = np.concatenate([h[4] for h in held])
            at = np.repeat(np.arange(len(held)), [len(h[4]) for h in held])
            spot = np.minimum(np.concatenate([np.arange(len(h[4])) for h in held]), 0xFFFF)
            part = (lead >> np.uint64(24)) % np.uint64(parts)
            ways = np.argsort(part, kind="stable")
            lead, at, spot, part = lead[ways], at[ways], spot[ways], part[ways]
            cuts = np.flatnonzero(np.diff(part)) + 1
            node, n, group, members = (np.array([h[i] for h in held], np.int64) for i in range(4))
            out = []
            for t, i, x, p in zip(np.split(lead, cuts), np.split(at, cuts), np.split(spot, cuts),
                                  part[np.concatenate([[0], cuts])]):
                used, short = np.unique(i, return_inverse=True)
                many = np.flatnonzero(members[used] > 1)
                out.append((int(p), base, _packed(t << np.uint64(16)), short.astype("<u2").tobytes(), x.astype("<u2").tobytes(),
                            (node[used] - base).astype("<u4").tobytes(), n[used].astype("<u4").tobytes(),
                            many.astype("<u2").tobytes(), group[used][many].tobytes(), members[used][many].astype("<u4").tobytes()))
            kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

        held, size, base = [], 0, None
        for batch in batches:
            for node, n, group, members, x in zip(*(batch.column(i) for i in range(5))):
                node = node.as_py()
                if held and (size > 500_000 or len(held) >= 60_000 or node >> ROW_BITS != base >> ROW_BITS):
                    yield told(base, held)
                    held, size = [], 0
                base = node >> ROW_BITS << ROW_BITS
                x = _tokens(x.as_buffer())
                lead = len(x) - needed(len(x), percent) + 1
                # rare tokens first, equally frequent ones by their hash
                x = x[np.argsort(rank[x & np.uint64(COUNTERS - 1)], kind="stable")]
                held.append((node, n.as_py(), group.as_py(), members.as_py(), x[:lead].copy()))
                size += lead
        if held:
            yield told(base, held)

    def meet(batches):
        import pyarrow as pa
        held = [x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(1, 10)))]
        if not held:
            return
        # most tokens have one holder: only the others' columns are built
        tokens = np.concatenate([_tokens(x[1]) for x in held])
        ways = np.argsort(tokens, kind="stable")
        same = np.flatnonzero(tokens[ways[1:]] == tokens[ways[:-1]])
        shared = np.zeros(len(tokens), bool)
        shared[ways[same]] = shared[ways[same + 1]] = True
        del ways, same
        tokens, columns, at = tokens[shared], [], 0
        for base, t, i, x, r, n, many, g, m in held:
            i = np.frombuffer(i, "<u2")
            own = shared[at:at + len(i)]
            at, i = at + len(i), i[own]
            node = np.frombuffer(r, "<u4").astype(np.int64) + base
            group, count = node.copy(), np.ones(len(node), np.int32)
            many = np.frombuffer(many, "<u2")
            group[many], count[many] = np.frombuffer(g, np.int64), np.frombuffer(m, "<u4")
            columns.append((np.frombuffer(x, "<u2")[own].astype(np.int32), node[i], np.frombuffer(n, "<u4")[i].astype(np.int64), group[i], count[i]))
        del held
        if not len(tokens):
            return
        spots, nodes_, sizes, groups, members = map(np.concatenate, zip(*columns))
        del columns
        # by token, then by group from small to large
        ways = np.lexsort((groups, members, tokens))
        tokens, spots, nodes_, sizes, groups, members = (x[ways] for x in (tokens, spots, nodes_, sizes, groups, members))
        same = np.concatenate([[False], tokens[1:] == tokens[:-1]])
        begins = np.flatnonzero(~same)
        ends = np.concatenate([begins[1:], [len(tokens)]])
        # runs of one token with more than one group
        several = groups[begins] != groups[ends - 1]
        found = set()
        for a, b in zip(begins[several].tolist(), ends[several].tolist()):
            n, spot = sizes[a:b], spots[a:b]
            # a pair shares least tokens or more, all of them from this one on in both orders
            for q in range(b - a - 1):
                later = slice(q + 1, b - a)
                least = -(-percent * (n[q] + n[later]) // (100 + percent))
                fit = (n[q] - spot[q] >= least) & (n[later] - spot[later] >= least) & (groups[a + q] != groups[a + q + 1:b])
                fit &= (n[q] * percent <= 100 * n[later]) & (n[later] * percent <= 100 * n[q])
                if fit.any():
                    node = int(nodes_[a + q])
                    found.update((node, g) for g in np.unique(groups[a + q + 1:b][fit]).tolist())
            if len(found) > 200_000:
                yield _packed_pairs(pa, found, parts)
                found = set()
        if found:
            yield _packed_pairs(pa, found, parts)

    def each_once(batches):
        import pyarrow as pa
        known = np.zeros((0, 2), np.int64)
        for batch in batches:
            own = [np.frombuffer(x.as_buffer(), "<i8").reshape(-1, 2) for x in batch.column(1)]
            known = np.unique(np.concatenate([known, *own]), axis=0)
        if len(known):
            yield pa.RecordBatch.from_arrays([pa.array(known[:, 0]), pa.array(known[:, 1])], ["a", "g"])

    leads = fetched(sets, nodes, "node", F.col("tokens")).select("node", "n", "grp", "members", "tokens").mapInArrow(
        deal, "part int, base long, " + ", ".join(f"{x} binary" for x in names[2:]))
    # a pair is found wherever it shares a token: its findings travel packed and are one row in the end
    found = leads.repartition(parts, "part").mapInArrow(meet, "part int, pairs binary")
    return found.repartition(parts, "part").mapInArrow(each_once, "a long, g long")


def _packed_pairs(pa, found, parts: int):
    """Rows (part of the query, its pairs as 64-bit values)."""
    import numpy as np
    pairs = np.array(sorted(found), np.int64)
    part = pairs[:, 0] % parts
    ways = np.argsort(part, kind="stable")
    pairs, part = pairs[ways], part[ways]
    cuts = np.flatnonzero(np.diff(part)) + 1
    return pa.RecordBatch.from_arrays(
        [pa.array(part[np.concatenate([[0], cuts])], pa.int32()),
         pa.array([x.astype("<i8").tobytes() for x in np.split(pairs, cuts)], pa.binary())], ["part", "pairs"])


def opened(queries: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) between queries and members of the groups that their bound opens."""
    asked = queries.groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    held = nodes.join(asked, F.col("grp") == F.col("g"), "left_semi")
    shape = held.groupBy("grp").agg(F.sum("n").alias("shingles")).select(
        F.col("grp").alias("g"), F.ceil(F.col("shingles") / BLOCK).cast("long").alias("blocks"))
    asks = queries.join(nodes.select(F.col("node").alias("a"), "n"), "a").groupBy("g").agg(
        F.ceil(F.sum("n") / QUERIES).cast("long").alias("turns"))
    shape = written(shape.join(asks, "g"), "ngram-shapes")
    each = lambda upto: F.explode(F.sequence(F.lit(0).cast("long"), F.col(upto) - 1))
    keys, low = ["g", "block", "turn"], F.expr("substring(tokens, 1, 6 * low)")

    def sides(queries, tokens):
        members = held.join(shape, F.col("grp") == F.col("g")).join(queries.select("g").distinct(), "g", "left_semi").select(
            "g", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"), each("turns").alias("turn"), "node", "n")
        members = fetched(sets, members, "node", tokens.alias("tokens")).select(*keys, "node", "n", "tokens")
        askers = queries.join(shape, "g").select(
            "g", "a", F.pmod(F.xxhash64("a"), F.col("turns")).alias("turn"), each("blocks").alias("block"))
        askers = askers.join(nodes.select(F.col("node").alias("a"), "n"), "a")
        askers = fetched(sets, askers, "a", tokens.alias("tokens")).select(*keys, "a", "n", "tokens")
        # columns of their own
        return askers.toDF(*askers.columns).groupBy(*keys), members.toDF(*members.columns).groupBy(*keys)

    def pairs_within(queries_, block):
        """(a, its size, its tokens inside the union, rest of it, member, size, tokens) that the bound leaves."""
        import numpy as np
        sets_ = [_tokens(x.as_buffer()) for x in block.column("tokens")]
        if not sets_:
            return
        names, sizes, union = block.column("node").to_pylist(), block.column("n").to_pylist(), np.unique(np.concatenate(sets_))
        for a, n, x in zip(queries_.column("a").to_pylist(), queries_.column("n").to_pylist(), queries_.column("tokens")):
            x = _tokens(x.as_buffer())
            inside = x[np.isin(x, union, assume_unique=True)]
            rest = n - len(x)  # of the set, not sent
            if len(inside) + rest < needed(n, percent):  # the bound: no member can reach the threshold
                continue
            for b, m, y in zip(names, sizes, sets_):
                if m * percent <= 100 * n and n * percent <= 100 * m:
                    both = len(np.intersect1d(inside, y, assume_unique=True)) + min(rest, m - len(y))
                    if 100 * both >= percent * (n + m - both):
                        yield a, b

    def told(pa, rows, names):
        a, b = zip(*rows) if rows else ((), ())
        return pa.table({names[0]: pa.array(a, pa.int64()), names[1]: pa.array(b, pa.int64())})

    def qualify(queries_, block):
        import pyarrow as pa
        group = block.column("g").to_pylist()[:1]
        return told(pa, sorted({(a, group[0]) for a, _ in pairs_within(queries_, block)}), ("a", "g"))

    def compare(queries_, block):
        import pyarrow as pa
        return told(pa, list(pairs_within(queries_, block)), ("a", "b"))

    # the low tokens bound the overlap of most pairs; whole sets go only to what is left
    askers, members = sides(queries, low)
    left = written(askers.cogroup(members).applyInArrow(qualify, "a long, g long").distinct(), "ngram-qualified")
    askers, members = sides(left, F.col("tokens"))
    return askers.cogroup(members).applyInArrow(compare, "a long, b long")


def similar_documents(docs: DataFrame, size: int = SIZE, percent: int = PERCENT, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text_key, n_shingles, component_id, first (whether it is its
    component's first row, by id)."""
    sets = sets_of(docs, id_col, text_col, size)
    # equal sets are one node, named by its first row
    classes = sets.filter("n > 0").groupBy("sig").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("least"))
    classes = written(classes, "ngram-classes")
    rows = sets.drop("tokens", "part")
    heads = rows.join(classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    stars = star_links(heads, sets, percent)
    groups = written(components(stars), "ngram-groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("members"))
    grouped = groups.join(sizes, "component").select(F.col("node").alias("_n"), F.col("component").alias("grp"), "members")
    nodes = written(heads.join(grouped, F.col("node") == F.col("_n"), "left").select(
        "node", "n", F.coalesce("grp", "node").alias("grp"), F.coalesce("members", F.lit(1).cast("long")).alias("members")),
        "ngram-nodes")
    with joined_in_place(docs.sparkSession):
        queries = written(queries_of_groups(nodes, sets, token_counts(sets), percent), "ngram-queries")
        links = written(opened(queries, nodes, sets, percent), "ngram-links")
    label = written(components(links.union(stars)), "ngram-components")
    parts = classes.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    firsts = parts.groupBy("component").agg(F.min("least").alias("head"))
    by_class = parts.join(firsts, "component").select("sig", "head").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    salted = rows.select("row", "doc_id", "text_key", "n", "sig", F.pmod(F.xxhash64("row"), F.lit(SALTS)).alias("salt"))
    return salted.join(by_class, ["sig", "salt"], "left").select(
        "doc_id", "text_key", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("head.doc_id")).otherwise(F.col("doc_id")).alias("component_id"),
        ((F.col("n") == 0) | (F.col("head.row") == F.col("row"))).alias("first"))


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similar_documents(docs, id_col=id_col, text_col=text_col).select("doc_id", "n_shingles", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the first row of each component, by id; texts without words all stay."""
    names = ["_id", "_none", "_key"]

    def named(doc_id: Column, key: Column) -> list[Column]:
        return [x.alias(n) for x, n in zip((F.coalesce(doc_id, F.lit(0).cast("long")), doc_id.isNull(), key), names)]

    stay = similar_documents(docs, id_col=id_col, text_col=text_col).filter("first").select(
        *named(F.col("doc_id"), F.col("text_key"))).distinct()
    # whole rows are moved once: the window keeps the join's partitioning
    rows = docs.select(F.struct("*").alias("_doc"), *named(F.col(id_col).cast("long"), text_key(text_col)))
    again = Window.partitionBy(*names, F.col("_doc")[id_col]).orderBy(F.lit(1))
    kept = rows.join(stay, names, "left_semi").withColumn("_again", F.row_number().over(again))
    return kept.filter((F.col("_again") == 1) | ~whole_text(f"_doc.{text_col}").rlike(WORD)).select("_doc.*")
