"""N-gram Jaccard join by PartEnum signatures, and the components of its links."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.common import materialise
from inkwell.llm.shingles import mixed, shingle_sets

WORDS, PERCENT = 4, 85
#: A set of copies of more than this share of all rows emits signatures only once; there are at most as many such sets.
HEAVY_SETS = 10_000
#: Bits of the number of classes of a profile, from and to; classes of a bucket that are compared at once, and bytes of their profiles.
LEAST_CLASSES, MOST_CLASSES, BLOCK, BLOCK_BYTES = 9, 20, 4096, 4 << 20
#: A signature that this many of about SAMPLE_ROWS documents have is hot: its rows are dealt to SALTS tasks. Results don't depend on these.
SAMPLE_ROWS, HOT_ROWS, SALTS = 5000, 50, 64
_U = np.uint64


class Bands:
    """Bands of sizes: a set links only with sets of its own band and the next ones to either side.

    Band i ends at edges[i]. Scheme i serves pairs whose smaller set lies in band i: both differ in at most
    differs(i) shingles. Cut into differs(i) + 1 + spare parts, at least 1 + spare parts are equal in both.
    """

    def __init__(self, percent: int = PERCENT):
        self.percent, self.edges = percent, [1]

    def reach(self, size: int) -> int:
        """The largest size that can link with size."""
        return size * 100 // self.percent

    def of(self, size: int) -> int:
        while self.edges[-1] < size:
            self.edges.append(max(self.edges[-1] + 1, self.reach(self.edges[-1] + 1)))
        low, high = 0, len(self.edges) - 1
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.edges[mid] < size else (low, mid)
        return low

    def differs(self, band: int) -> int:
        """100 |x & y| >= percent |x | y| leaves |x ^ y| = |x| + |y| - 2 |x & y| <= (100 - percent) (|x| + |y|) / (100 + percent)."""
        top = self.edges[band]
        return (100 - self.percent) * (top + self.reach(top)) // (100 + self.percent)


#: Sets that differ in fewer shingles get two levels of parts.
TWO_LEVELS, INNER = 7, 3


def spare(differs: int) -> int:
    """Parts beyond those that the differences can touch: with them, a pair shares a part that isn't empty unless both sets have more empty parts than this."""
    return 1 if differs < 15 else 3


def signatures(items: np.ndarray, bands: Bands) -> np.ndarray:
    """The signatures of a sorted set of 64-bit hashes: hashes of its items in subsets of the parts of the hash domain, even ranges all.

    Sets that differ in k < TWO_LEVELS items: k // 2 + 1 parts, in one of which they differ in one item at most; each is cut into
    INNER parts, all of which but one are equal there, so every subset of INNER - 1 of these is a signature. Larger k: the
    second level is one part, so that the subsets are single parts of the first, of which one at least is equal in both; empty
    ones count only in a set with more of them than spare(). Subsets of more parts would be more selective, but more: single
    parts, of five to six items here, are the least number of signatures that loses no pair.
    """
    n = len(items)
    if not n:
        return np.zeros(0, np.uint64)
    sums, own, out = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(items)))), bands.of(n), []
    for band in (own, own - 1):
        if band < 0 or bands.reach(bands.edges[band]) < n:
            continue
        differs, salt = bands.differs(band), mixed(np.array([band + 1], np.uint64))
        small = 0 < differs < TWO_LEVELS
        extra = 0 if differs < TWO_LEVELS else spare(differs)
        parts = (differs // 2 + 1) * INNER if small else differs + 1 + extra
        cuts = np.searchsorted(items, np.arange(1, parts, dtype=np.uint64) * _U(((1 << 64) - 1) // parts))
        cuts = np.concatenate(([0], cuts, [n]))
        held = sums[cuts[1:]] - sums[cuts[:-1]]
        if small:
            inner = held.reshape(-1, INNER)
            held = (inner.sum(axis=1, keepdims=True) - inner).ravel()  # all but one
        found = mixed(held + np.arange(parts, dtype=np.uint64) * _U(0x2545F4914F6CDD1D) + salt)
        full = cuts[1:] > cuts[:-1]
        out.append(found if small or parts - np.count_nonzero(full) > extra else found[full])
    return np.concatenate(out)


def digest_of(spread: np.ndarray, items: np.ndarray) -> tuple[int, int]:
    """The 128-bit digest of a set by its hashes, and these spread."""
    return int(np.add.reduce(spread).view(np.int64)), int(np.add.reduce(mixed(items ^ _U(0x5851F42D4C957F2D))).view(np.int64))


def digests(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, the set's 128-bit digest (f1, f2) and its profile."""

    def run(batches):
        for batch in batches:
            n, f1, f2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            profiles = []
            for i, s in enumerate(shingle_sets(batch.column("text"), size)):
                spread = mixed(s)
                n[i], (f1[i], f2[i]) = len(s), digest_of(spread, s) if len(s) else (0, 0)
                profiles.append(profile_of(spread))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(f1), pa.array(f2), pa.array(profiles, pa.binary())], ["doc_id", "n_shingles", "f1", "f2", "profile"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, f1 long, f2 long, profile binary")


def signature_rows(docs: DataFrame, heavy: dict[tuple[int, int], int], size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """sig, doc_id of the rows of docs that have a doc_id. Of the sets in heavy (digest: doc_id that stands for it) only that document has rows."""
    firsts = {f1 for f1, _ in heavy}

    def run(batches):
        bands = Bands(percent)
        for batch in batches:
            found, owners, held = [], [], 0
            for i, s in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), size), strict=True):
                if firsts and len(s) and int(np.add.reduce(spread := mixed(s)).view(np.int64)) in firsts and heavy.get(digest_of(spread, s), i) != i:
                    continue
                found.append(signatures(s, bands))
                owners.append(i)
                held += len(found[-1])
                if held >= 1 << 16:
                    yield _rows(found, owners)
                    found, owners, held = [], [], 0
            yield _rows(found, owners)

    return docs.filter("doc_id is not null").select("doc_id", "text").mapInArrow(run, "sig long, doc_id long")


def buckets_of(docs: DataFrame, heavy: dict[tuple[int, int], int], total: int, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """sig, doc_id, lead, many: the signature rows that are not alone, with the least doc_id of their signature and whether it has more than two rows.

    A signature that a sample shows to be hot is dealt to several tasks, and the least of each of these compared; there are at most
    as many such signatures as a HOT_ROWS-th of those of the sample. Which signatures are dealt changes nothing in the result.
    """
    some = docs.sample(min(1.0, SAMPLE_ROWS / max(total, 1)), 7)
    hot = materialise(signature_rows(some, heavy, size, percent).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= HOT_ROWS).select("sig"))
    rows, any_hot = signature_rows(docs, heavy, size, percent), hot.limit(1).count() > 0
    many = lambda rows: F.count(F.lit(1)).over(rows) > 2
    if not any_hot:
        one = Window.partitionBy("sig")
        seen = rows.select("sig", "doc_id", F.min("doc_id").over(one).alias("lead"), F.max("doc_id").over(one).alias("last"), many(one).alias("many"))
        return materialise(seen.filter("lead <> last").drop("last"))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    dealt = rows.join(F.broadcast(hot.withColumn("hot", F.lit(True))), "sig", "left").select("sig", "doc_id", salt.alias("salt"))
    one = Window.partitionBy("sig", "salt")
    seen = dealt.select("sig", "doc_id", F.col("salt").isNotNull().alias("hot"), F.min("doc_id").over(one).alias("lead"), F.max("doc_id").over(one).alias("last"), many(one).alias("many"))
    seen = materialise(seen.filter("hot or lead <> last"))
    whole = materialise(seen.filter("hot").groupBy("sig").agg(F.min("lead").alias("first"), F.max("last").alias("end"), (F.count(F.lit(1)) > 2).alias("more")))
    known = seen.join(F.broadcast(whole), "sig", "left").filter("not hot or first <> end")
    return known.select("sig", "doc_id", F.coalesce("first", "lead").alias("lead"), F.coalesce("more", "many").alias("many"))


def _rows(found: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
    sig = np.concatenate([np.zeros(0, np.uint64), *found])
    return pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(np.repeat(np.array(owners, np.int64), [len(f) for f in found]))], ["sig", "doc_id"])


def profile_of(spread: np.ndarray) -> bytes:
    """One bit for each class of hashes: whether an odd number of the set's fall into it; twice as many classes as hashes at least.

    Each hash that only one of two sets has turns one bit, so that sets differ in at least as many as their profiles do. With so
    many classes few turn back, and most sets that are alike but not enough are told apart without their texts.
    """
    classes = 1 << min(MOST_CLASSES, max(LEAST_CLASSES, (2 * len(spread)).bit_length()))
    return np.packbits(np.bincount((spread & _U(classes - 1)).astype(np.int64), minlength=classes).astype(np.uint8) & 1, bitorder="little").tobytes()


def folded(profile: np.ndarray, size: int) -> np.ndarray:
    """A profile as it would be with fewer classes."""
    while len(profile) > size:
        half = len(profile) // 2
        profile = profile[:half] ^ profile[half:]
    return profile


def apart_by(a: bytes, b: bytes) -> int:
    """In how many shingles two sets differ at least, by their profiles."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))


def near(pairs: DataFrame, profiles: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that may link by their sizes and profiles; of documents with several sets, by any of these."""

    def run(batches):
        for batch in batches:
            most = (100 - percent) * (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // (100 + percent)
            good = [apart_by(x, y) <= m for x, y, m in zip(batch.column("pa").to_pylist(), batch.column("pb").to_pylist(), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one = lambda k: profiles.select(F.col("rep").alias(k), F.col("profile").alias(f"p{k}"), F.col("n_shingles").alias(f"n{k}"))
    sized = pairs.join(one("a"), "a").join(one("b"), "b").filter(f"{percent} * greatest(na, nb) <= 100 * least(na, nb)")
    return sized.select("a", "b", "pa", "pb", "na", "nb").mapInArrow(run, "a long, b long").distinct()


def across(rows: DataFrame, percent: int, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (a, b), a < b, of classes of one bucket and different components that may link by sizes and profiles.

    rows: sig, rep, c, n_shingles, profile, one for each set of rep. A bucket is compared where it lies, so that only pairs that pass become rows; one
    of more than `block` classes, or of more bytes of profiles than block_bytes, is dealt into blocks, and each two blocks are a row, at most about twice that.
    """

    def run(batches):
        for batch in batches:
            every = batch.column("all")
            ends = np.cumsum([len(x) for x in every])
            flat = every.flatten()
            rep, c, n = (flat.field(k).to_numpy() for k in ("rep", "c", "n_shingles"))
            profile = flat.field("profile").to_pylist()
            least = 1 << LEAST_CLASSES - 3
            coarse = np.stack([folded(np.frombuffer(p, np.uint8), least) for p in profile]).view(np.uint64) if profile else np.zeros((0, least // 8), np.uint64)
            begin = 0
            for end in ends.tolist():
                for low in range(begin, end, 128):
                    high = min(end, low + 128)
                    most = (100 - percent) * (n[low:high, None] + n[None, begin:end]) // (100 + percent)
                    good = (c[low:high, None] != c[None, begin:end]) & (rep[low:high, None] < rep[None, begin:end]) & (np.abs(n[low:high, None] - n[None, begin:end]) <= most)
                    i, j = np.nonzero(good)
                    fits = np.bitwise_count(coarse[low + i] ^ coarse[begin + j]).sum(axis=1) <= most[i, j]
                    i, j = low + i[fits], begin + j[fits]
                    fits = [len(profile[x]) == least == len(profile[y]) or apart_by(profile[x], profile[y]) <= m for x, y, m in zip(i.tolist(), j.tolist(), most[i - low, j - begin].tolist(), strict=True)]
                    if any(fits):
                        yield pa.RecordBatch.from_arrays([pa.array(rep[i[fits]]), pa.array(rep[j[fits]])], ["a", "b"])
                begin = end

    # an aggregate and a join, which Spark can split, rather than a window over a bucket
    sizes = rows.groupBy("sig").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum(F.octet_length("profile")) / block_bytes)).cast("int").alias("__blocks"))
    dealt = rows.join(sizes, "sig").withColumn("__own", F.expr("cast(pmod(xxhash64(rep), __blocks) as int)"))
    dealt = dealt.withColumn("__with", F.explode(F.expr("sequence(0, __blocks - 1)")))
    grouped = dealt.groupBy("sig", F.least("__own", "__with").alias("i"), F.greatest("__own", "__with").alias("j")).agg(F.collect_list(F.struct("rep", "c", "n_shingles", "profile")).alias("all"))
    return grouped.filter(F.size("all") > 1).select("all").mapInArrow(run, "a long, b long").distinct()


def linked(pairs: DataFrame, texts: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose texts link, by their whole sets. Joins by id; a hot a is split by Spark's skew handling."""

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(shingle_sets(batch.column("ta"), size), shingle_sets(batch.column("tb"), size), strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(bool(both) and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable, of every node of edges (a, b); a, b not null.

    Alternates large-star and small-star steps, which never hang more than the edges together, until nothing changes. Each
    step is written to the shared folder.
    """
    def mark(df: DataFrame) -> tuple:
        """The number of edges and the sum of their hashes: equal for equal sets of edges."""
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = mark(edges)
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.filter("a <> b").distinct())
        low = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = low.groupBy("a").agg(F.min("b").alias("m"))
        small = low.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        small = materialise(small.filter("a <> b").distinct())
        edges, now = small, mark(small)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def joined(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs.

    Documents with equal sets are one class, held by the least doc_id; of classes that make more than a ten-thousandth of all rows only
    that document has signatures. Documents of different sets become candidates by a common signature. What sizes and profiles don't rule out is checked by the whole sets, in three rounds that leave no two
    documents of one bucket in different components unchecked: each class against the least one that it shares a bucket
    with; then against the least one of each of its buckets, where components still differ; then, in the buckets that
    still hold several components, all pairs across these. Pairs within a component need no check, so that a bucket of near copies
    never becomes all its pairs.

    A null text and one without words have no shingles and stand alone. Rows with the same doc_id are one document, with
    the links of all of them. A null doc_id has no links and a null component_id. An empty table stays empty.
    """
    docs = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    own = materialise(digests(docs, size))
    usable = own.filter("doc_id is not null and n_shingles > 0")
    classes = materialise(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    total = own.count()
    heavy = {(r.f1, r.f2): r.rep for r in classes.filter(F.col("n") > max(64, total // HEAVY_SETS)).select("f1", "f2", "rep").collect()}
    members = materialise(usable.join(classes, ["f1", "f2"]).select("doc_id", "rep", "f1", "f2", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("profile")).alias("profile")))
    profiles = materialise(members.filter("profile is not null").dropDuplicates(["rep", "f1", "f2"]).select("rep", "n_shingles", "profile"))
    placed = members.select("doc_id", "rep").distinct()

    buckets = buckets_of(docs, heavy, total, size, percent)
    met = materialise(buckets.filter("doc_id <> lead").groupBy("doc_id", "lead").agg(F.max("many").alias("many")))

    def classed(pairs: DataFrame) -> DataFrame:
        """Pairs of documents (x, y) as pairs of different classes (a, b), a < b."""
        known = pairs.join(placed.select(F.col("doc_id").alias("x"), F.col("rep").alias("x_rep")), "x").join(placed.select(F.col("doc_id").alias("y"), F.col("rep").alias("y_rep")), "y").filter("x_rep <> y_rep")
        return known.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()

    def texts_of(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
        return docs.join(wanted, "doc_id", "left_semi")

    pairs = materialise(near(classed(met.select(F.col("doc_id").alias("x"), F.col("lead").alias("y"))), profiles, percent))
    texts = materialise(texts_of(pairs))
    # the texts of one doc_id hang together
    several = placed.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("top")).filter("b <> top")
    links = placed.join(several, "doc_id").filter("rep <> b").select(F.col("rep").alias("a"), "b")
    links = materialise(links.union(linked(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), texts, size, percent)))

    labels = materialise(components(links))
    label = lambda df, key, name: df.join(labels.select(F.col("node").alias(key), F.col("component").alias(name)), key, "left").withColumn(name, F.coalesce(name, key))
    apart = materialise(label(label(pairs, "a", "ca"), "b", "cb").filter("ca <> cb").select("a", "b"))
    if apart.limit(1).count():
        links = materialise(links.union(linked(apart, texts, size, percent)))
        labels = materialise(components(links))

    component = label(placed, "rep", "c").select("doc_id", "c").distinct()
    lead = component.select(F.col("doc_id").alias("lead"), F.col("c").alias("lead_c"))
    split = materialise(met.filter("many").join(component, "doc_id").join(lead, "lead").filter("c <> lead_c").select("doc_id", "lead"))
    if split.limit(1).count():
        sigs = buckets.filter("many").join(split, ["doc_id", "lead"], "left_semi").select("sig").distinct()
        rest = buckets.filter("many and doc_id <> lead").join(sigs, "sig", "left_semi").join(placed, "doc_id").select("sig", "rep").distinct()
        # written once, clustered by class, so that a profile that goes with many buckets is stored once
        rest = materialise(label(rest, "rep", "c").join(profiles, "rep"))
        more = materialise(across(rest, percent).join(pairs, ["a", "b"], "left_anti"))
        if more.limit(1).count():
            links = materialise(links.union(linked(more, texts_of(more), size, percent)))
            labels = materialise(components(links))
    own_label = label(placed, "rep", "component").groupBy("doc_id").agg(F.min("component").alias("component"))
    return own.join(own_label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs without those whose component has a lesser doc_id; documents that link with nothing stay, and so do null ids.

    Repeated rows of a doc_id that stays all stay. Other columns pass as they are, whatever their names. An empty table stays empty.
    """
    gone = joined(docs, size, percent).filter("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


