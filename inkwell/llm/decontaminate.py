"""Benchmark decontamination by template canonicalisation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import hash_filter, in_filter, materialise
from inkwell.llm.shingles import raw_bytes, slices, windows, words_of

WINDOW, SHARE = 8, 0.5
#: So many consecutive tokens of an item make a leak, whatever their share.
RUN = 13
#: The filter of benchmark windows has so many bits at most, 16 MB.
MOST_BITS = 27
#: Units that follow a number.
UNITS = """mm cm m km in ft yd mi inch inches foot feet yard yards mile miles metre metres meter meters mg g kg lb lbs oz gram grams kilogram
kilograms pound pounds ounce ounces ml l litre litres liter liters gallon gallons s sec second seconds min minute minutes h hr hour hours day days
week weeks month months year years hz khz mhz ghz w kw v a j n pa k c f percent degrees dollar dollars euro euros cent cents usd eur gbp""".split()
NUMBER, NAME, UNIT = (np.uint64(0xA5A5_0000_0000_0000 + k) for k in (1, 2, 3))

_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_INSIDE = _DIGIT.copy()
_INSIDE[ord("a") : ord("z") + 1] = _INSIDE[ord("A") : ord("Z") + 1] = _INSIDE[0x80:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n\r\""]] = True
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("A") : ord("Z") + 1] += 32


def _parts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits, and a point or comma between digits; Latin capitals lowered, accented ones too."""
    data, inside = _UPPER[raw], _INSIDE[raw]
    if len(raw) > 2:
        between = ((raw[1:-1] == ord(".")) | (raw[1:-1] == ord(","))) & _DIGIT[raw[:-2]] & _DIGIT[raw[2:]]
        inside[1:-1] |= between
    if len(raw) > 1:
        accented = np.flatnonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)) + 1
        data[accented] += 32
    return data, inside


def _unit_hashes() -> np.ndarray:
    return np.sort(words_of(pa.array([" ".join(UNITS)]), parts=_parts).hashes)


class Templates:
    """The tokens of a batch of texts as templates.

    A token with a digit is a number; a capitalised one that doesn't begin a sentence or line a name; a unit after a number a unit.
    template: the hash of the token, or its type; value: the hash of the token; literal: whether the token is itself.
    """

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        words = words_of(texts, parts=_parts)
        raw, _ = raw_bytes(texts)
        self.first, self.count, self.value = words.first, words.count, words.hashes
        begins, ends = words.begins, words.ends
        self.template = self.value.copy()
        if not len(begins):
            self.literal = np.zeros(0, bool)
            return
        digits = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
        number = digits[ends] > digits[begins]
        stops = np.concatenate(([0], np.cumsum(_STOP[raw])))
        opens = np.ones(len(begins), bool)
        opens[1:] = stops[begins[1:]] > stops[ends[:-1]]
        opens[words.first[words.count > 0]] = True
        capital = words.data[begins] != raw[begins]
        second = np.minimum(begins + 1, len(raw) - 1)
        capital |= (raw[begins] == 0xC3) & (words.data[second] != raw[second])
        name = capital & ~opens & ~number
        units = _unit_hashes()
        after = np.zeros(len(begins), bool)
        after[1:] = number[:-1]
        after[words.first[words.count > 0]] = False
        unit = after & (units[np.minimum(np.searchsorted(units, self.value), len(units) - 1)] == self.value)
        self.template[number], self.template[name], self.template[unit] = NUMBER, NAME, UNIT
        self.literal = ~(number | name | unit)

    def windows(self, size: int) -> list[tuple[bool, np.ndarray, np.ndarray]]:
        """(exact, hash of each window, whether it counts), of templates and of the tokens themselves, whatever their case.

        Windows lie within one text; of templates only those count that are half literal at least.
        """
        literal = np.concatenate(([0], np.cumsum(self.literal)))
        inside = np.zeros(max(0, len(self.value) - size + 1), bool)
        for at, n in zip(self.first.tolist(), self.count.tolist(), strict=True):
            if n >= size:
                inside[at : at + n - size + 1] = True
        mostly = 2 * (literal[size:] - literal[:-size]) >= size if len(inside) else inside
        return [(False, windows(self.template, size), mostly & inside), (True, windows(self.value, size), inside)]

    def slots(self, at: np.ndarray, size: int) -> np.ndarray:
        """For each window the values of its placeholders, 0 where a token is literal."""
        return np.where(self.literal, np.uint64(0), self.value | np.uint64(1))[at[:, None] + np.arange(size)]


_FOUND = "exact boolean, size int, pos long, hash long, slots array<long>"


def _rows(templates: Templates, which: np.ndarray, runs: np.ndarray, size: int, exact: bool) -> tuple[np.ndarray, list[pa.Array]]:
    """The text of each of the windows, and its columns."""
    owner = np.searchsorted(templates.first, which, "right") - 1
    slots = templates.slots(which, size).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(which) + 1, dtype=np.int32) * size), pa.array(slots.ravel()))
    return owner, [pa.array(np.full(len(which), exact)), pa.array(np.full(len(which), size, np.int32)), pa.array(which - templates.first[owner]), pa.array(runs[which].view(np.int64)), lists]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, form, n (windows of the item), n_usable (those with a template), usable (whether this is one), exact, size, pos, hash, slots.

    form: a digest of the item's tokens and template; items of one form are alike in all that is compared. An item of fewer tokens
    than a window is one window of its own size. Each window has a row of its tokens (exact), and one of its template if that counts.
    """

    def run(batches):
        for batch in batches:
            for begin, texts in slices(batch.column("text")):
                t = Templates(texts)
                forms = pa.array([hashlib.sha256(t.value[a : a + n].tobytes() + t.template[a : a + n].tobytes()).digest() for a, n in zip(t.first.tolist(), t.count.tolist(), strict=True)], pa.binary())
                for size in sorted({min(window, n) for n in t.count.tolist()} - {0}):
                    found = t.windows(size)
                    usable, every = found[0][2], found[1][2]
                    owners = lambda which: np.searchsorted(t.first, which, "right") - 1
                    n, n_usable = (np.bincount(owners(np.flatnonzero(x)), minlength=len(t.first)) for x in (every, usable))
                    for exact, runs, good in found:
                        which = np.flatnonzero(good)
                        which = which[np.minimum(t.count[owners(which)], window) == size]
                        owner, columns = _rows(t, which, runs, size, exact)
                        yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(owner + begin)), forms.take(pa.array(owner)), pa.array(n[owner]), pa.array(n_usable[owner]), pa.array(usable[which]), *columns], ["item_id", "form", "n", "n_usable", "usable", "exact", "size", "pos", "hash", "slots"])

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null").mapInArrow(run, f"item_id long, form binary, n long, n_usable long, usable boolean, {_FOUND}")


def document_windows(docs: DataFrame, bits: bytes, n_bits: int, sizes: list[int]) -> DataFrame:
    """doc_id, t (hash of the text), exact, size, pos, hash, slots of the windows whose hash the filter may hold."""
    shipped = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        table = np.frombuffer(shipped.value, np.uint8)
        for batch in batches:
            for begin, texts in slices(batch.column("text")):
                t = Templates(texts)
                for size in sizes:
                    for exact, runs, good in t.windows(size):
                        which = np.flatnonzero(good & in_filter(runs, table, n_bits))
                        owner, columns = _rows(t, which, runs, size, exact)
                        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(owner + begin)) for c in ("doc_id", "t")] + columns, ["doc_id", "t", "exact", "size", "pos", "hash", "slots"])

    return docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text").mapInArrow(run, f"doc_id long, t long, {_FOUND}")


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, run: int = RUN) -> DataFrame:
    """doc_id, item_id, n_windows, coverage, n_slots, reparameterised: the documents that hold at least share of an item's template windows.

    Windows meet by the hash of their tokens, whatever the case (exact copies), and by that of their templates where half of
    their tokens are literal. Those of one document and item with the same shift are an alignment. In it each slot value of the
    item takes the document's value that most template windows give it; windows that say otherwise don't count, so that a
    question asked anew with other numbers or names is found. reparameterised: some slot differs.

    n_windows and coverage are those of all windows or of those with a template, whichever cover more. run consecutive tokens
    that are equal make a leak of any share.

    Documents are scanned in one pass against a bit filter of the benchmark, of fixed greatest size; only windows that pass are
    shuffled, then joined exactly. Items of one form are searched once, and each of them has its row. Every text of a
    repeated doc_id or item_id is searched by itself, and of several the one with the highest coverage is told. A null text
    has no windows; a null doc_id or item_id can't be named and has no row; an empty table on either side gives no row. An
    item whose windows are all mostly placeholders is found only as it is, not with other values.
    """
    every_item = materialise(benchmark_windows(benchmark, window))
    members = every_item.select("form", "item_id").distinct()
    items = materialise(every_item.drop("item_id").dropDuplicates(["form", "exact", "size", "pos"]))
    bits, n_bits = hash_filter(items, "hash", MOST_BITS)
    sizes = [r.size for r in items.select("size").distinct().collect()]
    found = document_windows(docs, bits, n_bits, sorted(sizes))

    theirs = F.when(F.col("exact"), F.col("i.slots")).otherwise(F.col("d.slots"))
    met = found.alias("d").join(items.alias("i"), ["exact", "size", "hash"]).select(
        "doc_id", "t", "form", "n", "n_usable", "usable", "exact", (F.col("d.pos") - F.col("i.pos")).alias("shift"), F.col("i.pos").alias("pos"), F.arrays_zip(F.col("i.slots").alias("a"), theirs.alias("b")).alias("slots")
    )
    line = ["doc_id", "t", "form", "shift"]
    met = materialise(met.withColumn("slots", F.array_distinct(F.filter("slots", lambda s: s["a"] != 0))).distinct())
    votes = met.filter("not exact").select(*line, F.explode("slots").alias("s")).groupBy(*line, "s.a", "s.b").agg(F.count(F.lit(1)).alias("votes"))
    values = votes.groupBy(*line, "a").agg(F.max(F.struct("votes", (F.col("a") == F.col("b")).alias("same"), "b"))["b"].alias("b"))
    values = values.groupBy(*line).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("values"))
    agreed = met.join(values, line, "left").filter(F.col("exact") | F.forall("slots", lambda s: F.element_at("values", s["a"]) == s["b"]))
    lines = agreed.groupBy(*line, "n", "n_usable").agg(
        F.collect_set("pos").alias("at"), F.collect_set(F.when(F.col("usable"), F.col("pos"))).alias("usable_at"), F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("pos")))).alias("exact_at"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    # in a sorted array of distinct places, steps - 1 further on and as much greater: all between are there
    steps = max(1, run - window + 1)
    long_run = F.exists(F.transform("exact_at", lambda x, i: F.get("exact_at", i + steps - 1) == x + steps - 1), lambda x: F.coalesce(x, F.lit(False))) & (F.col("n") + window - 1 >= run)
    every = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    pairs = lines.groupBy("doc_id", "t", "form", "n", "n_usable").agg(
        every("at").alias("n_all"),
        every("usable_at").alias("n_with_template"),
        F.max(F.size("slots")).cast("long").alias("n_slots"),
        F.min(F.exists("slots", lambda s: s["a"] != s["b"])).alias("reparameterised"),
        F.max(long_run).alias("long_run"),
    )
    of_all, of_usable = F.col("n_all") / F.col("n"), F.when(F.col("n_usable") > 0, F.col("n_with_template") / F.col("n_usable")).otherwise(0.0)
    pairs = pairs.withColumn("coverage", F.greatest(of_all, of_usable)).withColumn("n_windows", F.when(of_usable > of_all, F.col("n_with_template")).otherwise(F.col("n_all")))
    pairs = pairs.filter((F.col("coverage") >= share) | F.col("long_run")).join(members, "form")
    best = F.max(F.struct("coverage", "n_windows", "n_slots", (~F.col("reparameterised")).alias("same")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.n_windows", "best.coverage", "best.n_slots", (~F.col("best.same")).alias("reparameterised"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs of which no benchmark item was found, as they are; those with a null doc_id stay."""
    found = leaks(docs, benchmark).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
