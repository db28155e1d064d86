"""Personal data: fixed patterns, and bootstrapped contextual extraction of identifiers that no pattern knows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkwell.llm.common import free_name, hash_filter, in_filter, materialise, span_string
from inkwell.llm.shingles import _LOWER, _SPACE, hashed, mixed, raw_bytes, runs_of, slices

KINDS = ("email", "ip", "card", "phone", "context")
#: The base patterns; emails are found from their @, which finds the same matches in one pass.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Fixed value: marks that don't belong to a word at its ends.
TRIM = ".,;:!?()[]{}<>\"'*#%&$|=_"

#: Trusted instances that a pattern needs, the share of its occurrences that they must make, the trust that an instance needs, and what is never sure.
SUPPORT, CONFIDENT, TRUSTED, LEAK = 3, 0.7, 0.8, 0.05
#: The filters of patterns and instances have so many bits at most, 16 MB.
MOST_BITS = 27
#: Bytes of text that are looked at in one go.
SLICE = 1 << 20
_U = np.uint64
_SOLID, _DIGIT, _SMALL = np.ones(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_SOLID[[ord(c) for c in TRIM]] = False
_SOLID &= ~_SPACE
_DIGIT[ord("0") : ord("9") + 1] = True
_SMALL[ord("a") : ord("z") + 1] = _SMALL[0x80:] = True
_SHAPE = _LOWER.copy()
_SHAPE[ord("0") : ord("9") + 1] = ord("0")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns' matches, by start, then kind."""
    out = []
    if "@" in text:
        done, at = 0, text.find("@")
        while at >= 0:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((begin, 0, m.end()))
                done = m.end()
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.groups()):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


class Contexts:
    """The words of some texts, with the lexical patterns around them; all in arrays.

    A word is a blank-free run without the marks at its ends. Words with digits and without small letters that stand one blank
    apart are one instance, as numbers in groups are; any other word is an instance by itself. Four patterns surround it: the two words
    before it, the one before it, the one before and the one behind it, and the two behind it, A-Z as a-z and every digit as 0.
    """

    def __init__(self, texts: pa.Array):
        self.texts = texts.cast(pa.large_string())
        self.raw, self.offsets = raw_bytes(self.texts)
        begins, ends, _, count = runs_of(self.texts, ~_SPACE[self.raw], self.offsets)
        solid = np.flatnonzero(_SOLID[self.raw])
        first, last = np.searchsorted(solid, begins), np.searchsorted(solid, ends) - 1
        some = first <= last
        self.owner = np.repeat(np.arange(len(self.texts)), count)[some]
        self.begins, self.ends = (solid[first[some]], solid[last[some]] + 1) if len(solid) else (begins[:0], ends[:0])
        self.shape = hashed(_SHAPE[self.raw], self.begins, self.ends)
        self.low = _LOWER[self.raw]
        counts = lambda kind: np.concatenate(([0], np.cumsum(kind[self.raw])))
        within = lambda c: c[self.ends] > c[self.begins]
        code = within(counts(_DIGIT)) & ~within(counts(_SMALL))
        n = len(self.begins)
        on = np.zeros(n, bool)  # whether the next word belongs to the same instance
        if n > 1:
            blank = self.raw[np.minimum(self.ends[:-1], len(self.raw) - 1)] == ord(" ")
            on[:-1] = code[:-1] & code[1:] & (self.owner[:-1] == self.owner[1:]) & (self.begins[1:] == self.ends[:-1] + 1) & blank
        head = np.ones(n, bool)
        head[1:] = ~on[:-1]
        self.heads, self.tails = np.flatnonzero(head), np.flatnonzero(~on)
        self.instances = hashed(self.low, self.begins[self.heads], self.ends[self.tails])
        self.patterns = self.around(self.owner[self.heads], self.heads - 1, self.tails + 1)

    def around(self, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Four pattern hashes for each place between the words left and right; 0 where the text has no such words."""
        n = len(self.owner)

        def word(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            good = (k >= 0) & (k < n)
            at = np.where(good, k, 0)
            if not n:
                return good, np.zeros(len(k), np.uint64)
            good &= self.owner[at] == owner
            return good, self.shape[at]

        (l1, a1), (l2, a2), (r1, b1), (r2, b2) = word(left), word(left - 1), word(right), word(right + 1)
        none = np.zeros(len(left), np.uint64)
        pair = lambda x, y, kind: mixed(mixed(x + _U(kind)) + y * _U(0xD1342543DE82EF95)) | _U(1)
        columns = [(l1 & l2, pair(a2, a1, 2)), (l1, pair(a1, none, 1)), (l1 & r1, pair(a1, b1, 3)), (r1 & r2, pair(b1, b2, 4))]
        return np.stack([np.where(good, value, none) for good, value in columns], axis=1) if len(left) else np.zeros((0, 4), np.uint64)

    def base(self, owner: int) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        """The base spans of a text, and their begins and ends in bytes of the whole."""
        text = self.texts[owner].as_py() or ""
        spans = base_spans(text) if _SOME.search(text) else []
        at = lambda c: int(self.offsets[owner]) + len(text[:c].encode())
        return spans, np.array([(at(s), at(e)) for s, _, e in spans], np.int64).reshape(-1, 2)

    def seeds(self, owner: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patterns around base entities, and their hashes as instances; one that begins or ends within a word has none on that side."""
        left = np.searchsorted(self.ends, places[:, 0], "right") - 1
        right = np.searchsorted(self.begins, places[:, 1], "left")
        found = self.around(np.full(len(places), owner), left, right)
        inside = lambda k: _SOLID[self.raw[np.clip(k, 0, max(0, len(self.raw) - 1))]] & (k >= self.offsets[owner]) & (k < self.offsets[owner + 1])
        cut_left, cut_right = inside(places[:, 0] - 1), inside(places[:, 1])
        found[cut_left, :3] = 0
        found[cut_right, 2:] = 0
        hashes = [hashed(self.low, place[:1], place[1:])[0] for place in places]  # one by one, as spans may overlap
        return found, np.array(hashes, np.uint64)

    def free(self, which: np.ndarray) -> np.ndarray:
        """Those of the instances, in rising order, that meet no base span."""
        if not len(which):
            return which
        good = np.ones(len(which), bool)
        owners, first = np.unique(self.owner[self.heads[which]], return_index=True)
        for owner, low, high in zip(owners.tolist(), first.tolist(), [*first[1:].tolist(), len(which)], strict=True):
            _, places = self.base(owner)
            if len(places):
                mine = np.arange(low, high)
                begin, end = self.begins[self.heads[which[mine]]], self.ends[self.tails[which[mine]]]
                good[mine] = ~((places[None, :, 0] < end[:, None]) & (places[None, :, 1] > begin[:, None])).any(axis=1)
        return which[good]


_SPAN = "array<struct<start:int,kind:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_SEED_TYPE = pa.list_(pa.struct([("p", pa.int64()), ("i", pa.int64())]))


def read_texts(docs: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), base, base_sha256 and seeds (p, i: pattern and instance) of every row: what one pass over the texts finds."""

    def run(batches):
        for batch in batches:
            for begin, texts in slices(batch.column("text"), SLICE):
                base, sums, seeds, words = [], [], [], None
                for k, value in enumerate(texts):
                    text = value.as_py() or ""
                    spans = base_spans(text) if _SOME.search(text) else []
                    base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                    sums.append(hashlib.sha256(",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest())
                    seeds.append([])
                    if spans:
                        words = words or Contexts(texts)
                        found, instances = words.seeds(k, words.base(k)[1])
                        seeds[-1] = [{"p": p, "i": i} for row, i in zip(found.view(np.int64).tolist(), instances.view(np.int64).tolist(), strict=True) for p in row if p]
                columns = [batch.column(c).slice(begin, len(texts)) for c in ("doc_id", "h")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(base, _SPAN_TYPE), pa.array(sums, pa.string()), pa.array(seeds, _SEED_TYPE)], ["doc_id", "h", "base", "base_sha256", "seeds"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"doc_id long, h long, base {_SPAN}, base_sha256 string, seeds array<struct<p:bigint,i:bigint>>")


def _slices(batches) -> Iterator[tuple[pa.RecordBatch, int, Contexts]]:
    for batch in batches:
        for begin, texts in slices(batch.column("text"), SLICE):
            yield batch, begin, Contexts(texts)


def _hits(words: Contexts, table: np.ndarray, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(instance, which of its patterns) of the occurrences that the filter may hold and that meet no base span."""
    row, column = np.nonzero((words.patterns != 0) & in_filter(words.patterns.ravel(), table, n_bits).reshape(words.patterns.shape))
    good = np.isin(row, words.free(np.unique(row)))
    return row[good], column[good]


def occurring(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """p, n: how often each of the patterns (p) stands around anything but a base entity, in all texts."""
    bits, n_bits = hash_filter(patterns, "p", MOST_BITS)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = np.frombuffer(shipped.value, np.uint8)
        for _, _, words in _slices(batches):
            row, column = _hits(words, table, n_bits)
            p, n = np.unique(words.patterns[row, column], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n.astype(np.int64))], ["p", "n"])

    counted = docs.select("text").mapInArrow(run, "p long, n long").groupBy("p").agg(F.sum("n").alias("n"))
    return patterns.select("p").join(counted, "p", "left").select("p", F.coalesce("n", F.lit(0)).alias("n"))


def around_instances(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """p, i, n: the patterns around the instances (i), wherever these stand outside of base entities, and how often."""
    bits, n_bits = hash_filter(instances, "i", MOST_BITS)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = np.frombuffer(shipped.value, np.uint8)
        for _, _, words in _slices(batches):
            which = words.free(np.flatnonzero(in_filter(words.instances, table, n_bits)))
            p, i = words.patterns[which].ravel(), np.repeat(words.instances[which], 4)
            yield pa.RecordBatch.from_arrays([pa.array(p[p != 0].view(np.int64)), pa.array(i[p != 0].view(np.int64))], ["p", "i"])

    pairs = docs.select("text").mapInArrow(run, "p long, i long").groupBy("p", "i").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(instances.select("i"), "i", "left_semi").select("p", "i", "n")


def discovered(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, h, start, end, p, i: what stands in the kept patterns (p) outside of base entities; in code points."""
    bits, n_bits = hash_filter(kept, "p", MOST_BITS)
    shipped = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["doc_id", "h", "start", "end", "p", "i"]

    def run(batches):
        table = np.frombuffer(shipped.value, np.uint8)
        for batch, begin, words in _slices(batches):
            row, column = _hits(words, table, n_bits)
            points = np.concatenate(([0], np.cumsum((words.raw & 0xC0) != 0x80)))
            owner = words.owner[words.heads[row]]
            zero = points[words.offsets[owner]]
            place = lambda at: pa.array((points[at] - zero).astype(np.int32))
            ids = [batch.column(c).take(pa.array(owner + begin)) for c in ("doc_id", "h")]
            hashes = [pa.array(x.view(np.int64)) for x in (words.patterns[row, column], words.instances[row])]
            yield pa.RecordBatch.from_arrays([*ids, place(words.begins[words.heads[row]]), place(words.ends[words.tails[row]]), *hashes], names)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, start int, end int, p long, i long").join(kept.select("p"), "p", "left_semi").select(*names)


def bootstrapped(docs: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """What discovered() finds by confident patterns, or None if no pattern is confident.

    seeds: p, i, a row for each base entity and pattern around it. Each round scores the patterns that SUPPORT different trusted
    instances or more stand in: the share of a pattern's occurrences, in all texts, that trusted instances make. Those of CONFIDENT
    share are kept; an instance found in them is trusted if 1 - product of (1 - confidence) over its patterns, each confidence at
    most 1 - LEAK of itself, is TRUSTED; and the patterns around newly trusted ones are looked up in all texts. Trust only
    grows, so the rounds end, when none adds a pattern or an instance. Every round's results are written to the shared folder.
    """
    known = materialise(seeds.groupBy("p", "i").agg(F.count(F.lit(1)).alias("n")).withColumn("seed", F.lit(True)))
    totals, n_kept, found = None, 0, None
    while True:
        scores = known.groupBy("p").agg(F.count_distinct("i").alias("s"), F.sum("n").alias("good"), F.sum(F.when(F.col("seed"), F.lit(0)).otherwise(F.col("n"))).alias("own")).filter(F.col("s") >= SUPPORT)
        new = materialise(scores if totals is None else scores.join(totals, "p", "left_anti"))
        if new.limit(1).count():
            counted = materialise(occurring(docs, new))
            totals = counted if totals is None else totals.union(counted)
        if totals is None:
            return None
        # own occurrences, those outside of base entities, are among the n of all such
        share = F.col("good") / (F.col("good") - F.col("own") + F.greatest("n", "own"))
        kept = materialise(scores.join(totals, "p").select("p", share.alias("confidence")).filter(F.col("confidence") >= CONFIDENT))
        if kept.count() == n_kept:
            return found
        n_kept = kept.count()
        found = materialise(discovered(docs, kept))
        doubt = F.exp(F.sum(F.log(1 - (1 - LEAK) * F.col("confidence"))))
        held = found.select("p", "i").distinct().join(kept, "p").groupBy("i").agg((1 - doubt).alias("trust")).filter(F.col("trust") >= TRUSTED).select("i")
        trusted = materialise(held.join(known.filter("not seed").select("i"), "i", "left_anti"))
        if not trusted.limit(1).count():
            return found
        known = materialise(known.unionByName(around_instances(docs, trusted).withColumn("seed", F.lit(False))))


def found(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """What read_texts() finds, and for each (doc_id, h) with any, added: the spans that confident patterns discover; None if nowhere any."""
    rows = materialise(read_texts(docs))
    new = bootstrapped(docs, rows.select(F.explode("seeds").alias("s")).select("s.p", "s.i"))
    if new is None:
        return rows.drop("seeds"), None
    return rows.drop("seeds"), new.groupBy("doc_id", "h").agg(F.collect_set(F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")).alias("added"))


def _with_spans(rows: DataFrame, new: DataFrame | None, doc_id: str, h: str, added: str) -> DataFrame:
    """rows with the column added, null where there is none."""
    if new is None:
        return rows.withColumn(added, F.lit(None).cast(_SPAN))
    names = [free_name(f"__{c}", rows.columns, [added]) for c in ("id", "h")]
    keys = new.select(F.col("doc_id").alias(names[0]), F.col("h").alias(names[1]), F.col("added").alias(added))
    return rows.join(keys, rows[doc_id].cast("long").eqNullSafe(F.col(names[0])) & (rows[h] == F.col(names[1])), "left").drop(*names)


def documents_searched(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every whole text.

    A null text counts as empty and has none. Repeated rows have the same spans; an empty table stays empty.
    """
    rows, new = found(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    spans = F.concat("base", F.coalesce("added", F.array().cast(_SPAN)))
    return _with_spans(rows, new, "doc_id", "h", "added").select("doc_id", *[count(k) for k in range(4)], "base_sha256", span_string(spans, list(KINDS)).alias("spans"))


def hidden(text: str, added: list[tuple[int, int, int]]) -> str:
    """The text with each span as its kind in brackets; spans that meet become one, of the first one's kind."""
    out, done, last = [], 0, -1
    for start, kind, end in sorted(base_spans(text) + added):
        if start < last:
            last = max(last, end)
            done = max(done, end)
            continue
        out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = last = end
    return "".join(out) + text[done:]


def masked(docs: DataFrame) -> DataFrame:
    """docs with personal data in text replaced; n_chars, where there is one, is the new length.

    A null text stays null, an empty table empty; repeated rows are masked alike. Other columns pass as they are, whatever their names.
    """
    _, new = found(docs.select("doc_id", "text"))
    columns, h, added = docs.columns, free_name("__h", docs.columns), free_name("__added", docs.columns)
    rows = _with_spans(docs.withColumn(h, F.xxhash64("text")), new, "doc_id", h, added)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema])

    def run(batches):
        for batch in batches:
            for begin, some in slices(batch.column("text")):
                texts = []
                for value, more in zip(some, batch.column(added).slice(begin, len(some)), strict=True):
                    text = value.as_py()
                    spans = [(x["start"], x["kind"], x["end"]) for x in more.as_py() or ()]
                    texts.append(hidden(text, spans) if text and (spans or _SOME.search(text)) else text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == "text" else batch.column(c).slice(begin, len(some)) for c in columns], columns)

    out = rows.select(*[rows[c] for c in columns], added).mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in columns else out
