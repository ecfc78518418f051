"""Personal data by bootstrapped contextual extraction.

Pass one reads every whole text once: it marks the base entities (email, ip, card, phone), which
are the seeds, and all other identifier-like words (``MIN_CHARS`` characters with ``MIN_DIGITS``
digits) with the lexical patterns around each: the word before, the two words before, the word
after. Patterns and instances form a bipartite graph that Spark scores in ``ROUNDS`` rounds: a
pattern's confidence is the trust of the instances that it extracts over their number, an
unseen instance's trust follows from its patterns' confidences, a seed's trust is one. A pattern
counts with ``MIN_SEEDS`` different trusted instances at least. Words in a slot of a pattern of
``CONFIDENCE`` or more are personal data of kind ``id``.

Defined cases: a null or empty text has no spans; a null doc_id is carried; repeated rows are
marked each on its own; other columns are ignored (kept by ``redact``); an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

# fixed values: the base kinds, in the order of spans that start together
KINDS = ("email", "ip", "card", "phone")
EXTRA = "id"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive and begun at a run's start, so that long runs of digits take linear time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_GAP = re.compile(r"[\x20\x09-\x0D]")
_EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum())

MIN_CHARS, MIN_DIGITS = 6, 4
ROUNDS, MIN_SEEDS, CONFIDENCE = 3, 3, 0.8
#: Parts over which the edges of one pattern are spread.
SALTS = 16


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def emails(text: str):
    """The matches of the email rule, found from each @ in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base entities, in order."""
    spans = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                spans.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _NO_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text):
            if 10 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _word_bounds(text: str, at: int, low: int) -> tuple[int, int]:
    start = at
    while start > low and not _GAP.match(text[start - 1]):
        start -= 1
    gap = _GAP.search(text, at)
    return start, gap.start() if gap else len(text)


def _word_before(text: str, end: int) -> tuple[str, int]:
    while end and _GAP.match(text[end - 1]):
        end -= 1
    start = end
    while start and end - start < 64 and not _GAP.match(text[start - 1]):
        start -= 1
    return text[start:end], start


def _word_after(text: str, start: int) -> str:
    n = len(text)
    while start < n and not _GAP.match(text[start]):  # the rest of the instance's own word
        start += 1
    while start < n and _GAP.match(text[start]):
        start += 1
    end = start
    while end < n and end - start < 64 and not _GAP.match(text[end]):
        end += 1
    return text[start:end]


def _plain(word: str) -> str:
    w = word.strip(_EDGE).lower() or word
    return re.sub("[0-9]+", "0", w)


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around an instance; digits count alike, punctuation at edges not."""
    one, at = _word_before(text, start)
    two, _ = _word_before(text, at)
    right = _word_after(text, end)
    out = []
    if one:
        out.append("L " + _plain(one))
        if two:
            out.append("LL " + _plain(two) + " " + _plain(one))
    if right:
        out.append("R " + _plain(right))
    return out


def instances(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed): base spans, and the identifier-like words beside them."""
    out = [(a, b, True) for a, _, b in base]
    taken = sorted((a, b) for a, b, _ in out)
    at, i, low = _DIGIT.search(text), 0, 0
    while at:
        start, end = _word_bounds(text, at.start(), low)
        low = end
        word = text[start:end]
        core = word.strip(_EDGE)
        start += len(word) - len(word.lstrip(_EDGE))
        stop = start + len(core)
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        free = i == len(taken) or taken[i][0] >= stop
        if free and len(core) >= MIN_CHARS and sum(c.isascii() and c.isdigit() for c in core) >= MIN_DIGITS:
            out.append((start, stop, False))
        at = _DIGIT.search(text, end)
    return out


MARKED = ("row long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, "
          "spots array<struct<start: long, stop: long, seed: boolean, name: long, patterns: array<string>>>")


def mark(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """Pass one, written: the columns ``keep`` of ``docs``, each named with a leading
    underscore, and MARKED. The text is stored only if ``keep`` has it."""
    kept = docs.select(*[F.col(c).alias("_" + c) for c in keep], whole_text(text_col).alias("text"))
    n = len(keep)

    def run(batches):
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext
        row = TaskContext.get().partitionId() << 40
        spot = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("seed", pa.bool_()),
                                   ("name", pa.int64()), ("patterns", pa.list_(pa.string()))]))
        kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [spot]
        names = ["row", "n_email", "n_ip", "n_card", "n_phone", "base", "base_sha256", "spots"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = []
                for text in some.column(n).to_pylist():
                    base = base_spans(text)
                    spans = joined(base)
                    made.append((
                        row, *(sum(s[1] == i for s in base) for i in range(len(KINDS))), spans,
                        hashlib.sha256(spans.encode()).hexdigest(),
                        [{"start": a, "stop": b, "seed": seed, "patterns": patterns(text, a, b),
                          "name": xxhash.xxh3_64_intdigest(text[a:b].encode()) - (1 << 63)}
                         for a, b, seed in instances(text, base)]))
                    row += 1
                new = [pa.array(c, k) for c, k in zip(zip(*made), kinds)]
                yield pa.RecordBatch.from_arrays([*some.columns[:n], *new], some.schema.names[:n] + names)

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields[:n])
    return written(kept.mapInArrow(run, fields + MARKED), "pii-marked")


def confident_patterns(marked: DataFrame) -> DataFrame:
    """The patterns of ``CONFIDENCE`` or more after ``ROUNDS`` rounds over the graph."""
    spots = marked.select(F.explode("spots").alias("s")).select("s.name", "s.seed", F.explode("s.patterns").alias("pattern"))
    edges = written(spots.groupBy("pattern", "name").agg(F.max("seed").alias("seed")).withColumn(
        "salt", F.pmod(F.col("name"), F.lit(SALTS))), "pii-edges")
    trust = F.when(F.col("seed"), 1.0).otherwise(0.0)
    scored = edges.withColumn("trust", trust)
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>"))
    for k in range(ROUNDS):
        # partial sums by salt first: a frequent pattern is no single task's work
        sums = scored.groupBy("pattern", "salt").agg(
            F.sum("trust").alias("t"), F.count(F.lit(1)).alias("n"),
            F.sum(F.when(F.col("trust") >= CONFIDENCE, 1).otherwise(0)).alias("sure"))
        sums = sums.groupBy("pattern").agg(F.sum("t").alias("t"), F.sum("n").alias("n"), F.sum("sure").alias("sure"))
        patterns_ = written(sums.filter(F.col("sure") >= MIN_SEEDS).select(
            "pattern", (F.col("t") / F.col("n")).alias("confidence")), f"pii-patterns-{k}")
        if k + 1 < ROUNDS:
            # what an instance gathers from its patterns: 1 - product of their doubts
            spread = patterns_.withColumn("salt", salts)
            doubts = edges.filter(~F.col("seed")).join(spread, ["pattern", "salt"]).groupBy("name").agg(
                F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))).alias("doubt"))
            known = written(doubts.filter(F.col("doubt") < 0).select("name", (1 - F.exp("doubt")).alias("gathered")),
                            f"pii-trust-{k}")
            scored = edges.join(known, "name", "left").select(
                "pattern", "salt", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("gathered", F.lit(0.0))).alias("trust"))
    return patterns_.filter(F.col("confidence") >= CONFIDENCE).select("pattern")


def discovered(marked: DataFrame) -> DataFrame:
    """row, extra: the start and stop of the identifiers that confident patterns find."""
    sure = confident_patterns(marked).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<long>")))
    slots = marked.select("row", F.explode("spots").alias("s")).filter("not s.seed").select(
        "row", "s.start", "s.stop", F.pmod("s.name", F.lit(SALTS)).alias("salt"), F.explode("s.patterns").alias("pattern"))
    return slots.join(sure, ["pattern", "salt"], "left_semi").groupBy("row").agg(
        F.collect_set(F.struct("start", "stop")).alias("extra"))


def _all_spans(base, extra):
    """Base and extra spans as one string, by start, then kind."""
    def parts(s):
        p = F.split(s, ":")
        kind = F.array_position(F.array(*map(F.lit, KINDS)), p[0]).cast("long")
        return F.struct(p[1].cast("long").alias("start"), kind.alias("kind"), s.alias("text"))
    old = F.when(base == "", F.array().cast("array<struct<start:bigint,kind:bigint,text:string>>")).otherwise(
        F.transform(F.split(base, ","), parts))
    new = F.transform(F.coalesce(extra, F.array().cast("array<struct<start:bigint,stop:bigint>>")), lambda e: F.struct(
        e["start"].alias("start"), F.lit(len(KINDS) + 1).cast("long").alias("kind"),
        F.concat_ws(":", F.lit(EXTRA), e["start"].cast("string"), e["stop"].cast("string")).alias("text")))
    return F.when(extra.isNull(), base).otherwise(
        F.concat_ws(",", F.transform(F.array_sort(F.concat(old, new)), lambda x: x["text"])))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_id."""
    marked = mark(docs, text_col, [id_col])
    return marked.drop("spots").join(discovered(marked), "row", "left").select(
        F.col("_" + id_col).alias("doc_id"), "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        _all_spans(F.col("base"), F.col("extra")).alias("spans"),
        F.coalesce(F.size("extra"), F.lit(0)).cast("long").alias("n_id"))


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first to start."""
    out, end = [], 0
    for span in spans.split(",") if spans else ():
        kind, a, b = span.split(":")
        if int(a) >= end:
            out += [text[end:int(a)], f"[{kind.upper()}]"]
            end = int(b)
        elif int(b) > end:  # the rest of an overlapping one goes too
            end = int(b)
    return "".join(out) + text[end:]


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span masked by its kind; the text's length is renewed in ``n_chars``."""
    marked = mark(docs, text_col, docs.columns)
    found = marked.drop("spots").join(discovered(marked), "row", "left").withColumn(
        "spans", _all_spans(F.col("base"), F.col("extra")))
    given, at_text = docs.schema, docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            columns = list(batch.columns[:-1])
            texts = [t if t is None else masked(t, s) for t, s in zip(columns[at_text].to_pylist(), batch.columns[-1].to_pylist())]
            columns[at_text] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, given.names)

    out = found.select(*["_" + c for c in docs.columns], "spans").mapInArrow(run, given)
    if "n_chars" in docs.columns:
        kind = given["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(text_col).isNull(), F.col("n_chars")).otherwise(
            F.length(text_col)).cast(kind))
    return out
