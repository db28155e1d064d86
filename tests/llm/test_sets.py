"""Jaccard join, decontamination, chats, shards, urls, quality: each against a plain version."""

import collections
import glob
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkwell.llm import chats, decontaminate, jaccard, quality, shards, shingles, urls


def plain_components(texts, size, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()))
    ids = [i for i, _ in sets if i is not None]
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if None not in (i, j) and x & y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return collections.Counter((i, len(s), None if i is None else root(i)) for i, s in sets)


def edited(rnd, words, share):
    return [rnd.choice("abcdefgh") * 3 if rnd.random() < share else w for w in words]


@pytest.fixture(scope="module")
def copies():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 5)))
    texts = [None, "", "  ", "one", "ONE", "one two", "one two three", "One two\tthree four", "one two three four"]
    for n in (5, 9, 13, 30, 60, 200):
        base = [word() for _ in range(n)]
        texts += [" ".join(edited(rnd, base, s)) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1) for _ in range(3)]
        texts += [" ".join(base + [word() for _ in range(k)]) for k in (1, 2, n // 10, n // 5)]
    chain = [word() for _ in range(80)]
    for _ in range(15):  # neighbours link, ends don't
        chain = chain[4:] + [word() for _ in range(4)]
        texts.append(" ".join(chain))
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    return rows + [(3, "one two"), (7, "one two three"), (None, "one two three four"), (None, None)]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard(spark, copies, size, percent):
    df = spark.createDataFrame([(i, t, 1) for i, t in copies], "doc_id long, text string, component_id long").repartition(3)
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.joined(df, size, percent).collect())
    assert got == plain_components(copies, size, percent)


def test_jaccard_stage_and_empty(spark, copies):
    df = spark.createDataFrame([(i, t) for i, t in copies if i is not None], "doc_id long, text string")
    labels = plain_components([x for x in copies if x[0] is not None], 5, 80)
    kept = jaccard.one_of_each(df, 5, 80)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in labels}
    assert jaccard.joined(df.limit(0)).collect() == []


def test_jaccard_of_repeated_ids(spark):
    rnd = random.Random(5)
    words = lambda n: ["".join(rnd.choice("abcdefghij") for _ in range(4)) for _ in range(n)]
    rows = []
    for i in range(0, 80, 2):
        short, long = words(100), words(400)
        both = [(i, " ".join(short)), (i, " ".join(long))]
        rows += both if i % 4 else both[::-1]
        rows.append((i + 1, " ".join([*long[:200], "zzz", *long[201:]])))
    rows += [(90, rows[0][1]), (3, " ".join(words(50)))]
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows, 4, 85)


@pytest.mark.parametrize("hot_rows", [2, 50, 1 << 30])
def test_jaccard_of_large_groups(spark, monkeypatch, hot_rows):
    """A third of all rows copies of one text, a third edited copies of another, near the threshold on both sides."""
    monkeypatch.setattr(jaccard, "HOT_ROWS", hot_rows)
    rnd = random.Random(41)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 6)))
    same, base = " ".join(word() for _ in range(90)), [word() for _ in range(120)]
    texts = [same] * 150 + [" ".join(edited(rnd, base, rnd.choice((0.0, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04)))) for _ in range(150)] + [" ".join(word() for _ in range(rnd.randint(1, 200))) for _ in range(150)]
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    got = jaccard.joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == plain_components(rows, 4, 85)


def test_signatures_are_complete():
    rnd, bands = np.random.default_rng(4), jaccard.Bands()
    for n in [*range(1, 40), 57, 100, 333, 1000]:
        for _ in range(6):
            pool = rnd.integers(0, 1 << 63, 2 * n + 4, dtype=np.uint64)
            common = rnd.integers(max(1, int(0.8 * n)), n + 1)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate((pool[:common], pool[n : n + rnd.integers(0, max(1, n // 5) + 1)])))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both):
                assert np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands)).size, (len(a), len(b), both)


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (7, 9), (6, 6), (1, 5)]
    got = {r.node: r.component for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7}


def test_words_of_batches():
    texts = ["A b\x0bC", None, "", "x" * (3 * shingles.BLOCK) + " y", "  é É  ", "b c"]
    whole = pa.array(["pad", *texts])[1:]
    w = shingles.words_of(whole)
    assert w.count.tolist() == [3, 0, 0, 2, 2, 2] and w.hashes[1] == w.hashes[7] and w.hashes[2] == w.hashes[8]
    single = shingles.words_of(pa.array(["x" * (3 * shingles.BLOCK)]))
    assert single.hashes[0] == w.hashes[3]
    assert [len(x) for x in shingles.shingle_sets(whole, 2)] == [2, 0, 0, 1, 1, 1]


def test_leaks(spark):
    filler = "some quite ordinary words stand here before and after what matters. "
    bench = [(1, "A train leaves Boston with 40 cars and meets Anna after 3 km on the way to the old bridge."), (2, "Short one with five words."), (3, None), (4, ""), (None, "nothing has no name here at all so never found"), (5, "A train leaves Boston with 40 cars and meets Anna after 3 km on the way to the old bridge.")]
    docs = [
        (10, filler + bench[0][1] + " " + filler), (11, filler + "A train leaves Paris with 55 cars and meets Otto after 7 miles on the way to the old bridge."), (12, filler * 3), (13, None), (14, ""),
        (15, "Short one with five words."), (16, filler + "A train leaves Boston. " + filler), (None, bench[0][1]), (10, bench[0][1]), (17, ("a train leaves with cars. " + filler) * 50 + bench[0][1].upper()),
    ]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, item_id long")
    b = spark.createDataFrame([(*x, 2) for x in bench], "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id): r.reparameterised for r in decontaminate.leaks(d, b).collect()}
    assert got[10, 1] is False and got[11, 1] is True and got[15, 2] is False and not any(k[0] in (12, 13, 14, 16) for k in got)
    inconsistent = [(20, "4 apples and then 4 apples more were put beside the many green pears by her"), (21, "6 apples and then 7 apples more were put beside the many green pears by her"), (22, "6 apples and then 6 apples more were put beside the many green pears by her")]
    slots = decontaminate.leaks(spark.createDataFrame(inconsistent[1:], "doc_id long, text string"), spark.createDataFrame(inconsistent[:1], "item_id long, text string")).collect()
    assert (22, True) in {(r.doc_id, r.reparameterised) for r in slots}
    assert not any(r.doc_id == 21 and r.coverage == 1 for r in slots)
    left = decontaminate.without_leaks(d, b)
    assert left.columns == d.columns and {12, 13, 14, 16, None} <= {r.doc_id for r in left.collect()} and 10 not in {r.doc_id for r in left.collect()}
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def leaks_of(spark, docs, bench):
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    return {(r.doc_id, r.item_id): r for r in found.collect()}


def test_leaks_in_any_case_and_of_placeholders(spark):
    filler = "some quite ordinary words stand here before and after what matters. "
    item = "A train leaves Boston with 40 cars and meets Anna after 3 km on the way to the old bridge."
    sums, names = "What is 12 + 15 + 17 - 3?", "They are Anna, Otto, Bob, Carla, Dora, Emil, Fritz, Gerd and Hanna Schmidt."
    docs = [(k, filler + t + " " + filler) for k, t in enumerate((item.upper(), item.title(), item.lower(), sums, names, "What is 11 + 15 + 18 - 2?", "They are Max, Moritz, Rolf, Udo, Ines, Karl, Lena, Nora and Olga Meier."))]
    got = leaks_of(spark, docs, [(1, item), (2, sums), (3, names)])
    assert set(got) == {(0, 1), (1, 1), (2, 1), (3, 2), (4, 3)}
    assert all(r.coverage == 1 and not r.reparameterised for r in got.values())


def test_leaks_by_runs_and_with_merged_values(spark):
    filler = "some quite ordinary words stand here before and after what matters. "
    words = [f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for k in range(59)]
    item = "A man walks 3 km along the river and then 5 miles over the hill to the old mill by the sea."
    both = "A man walks 4 miles along the river and then 4 miles over the hill to the old mill by the sea."
    docs = [(1, filler + " ".join(words[10:42]) + " " + filler), (2, filler + " ".join(words[10:23]) + " " + filler), (3, filler + " ".join(words[10:22]) + " " + filler), (4, filler + both)]
    docs.append((5, filler + " ".join(words[10:22] + ["zzz"] + words[23:29])))
    got = leaks_of(spark, docs, [(1, " ".join(words)), (2, item)])
    assert set(got) == {(1, 1), (2, 1), (4, 2)}
    assert got[1, 1].n_windows == 25 and got[2, 1].n_windows == 6 and got[4, 2].coverage == 1 and got[4, 2].reparameterised


FIXED_UNITS = set(decontaminate.UNITS)


def plain_tokens(text):
    """(token, kind) of a text; kind None: literal."""
    out, before, stop = [], None, True
    for m in re.finditer(r"[.!?:\n\r\"]|(?:[0-9A-Za-z\x80-\U0010ffff]|(?<=[0-9])[.,](?=[0-9]))+", text or ""):
        if m.group() in '.!?:\n\r"':
            stop = True
            continue
        word = m.group()
        low = "".join(c.lower() if c.isascii() or (c in "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ") else c for c in word)
        kind = None
        if any(c in "0123456789" for c in word):
            kind = "number"
        elif low[0] != word[0] and not stop:
            kind = "name"
        elif before == "number" and low in FIXED_UNITS:
            kind = "unit"
        out.append((low, kind))
        before, stop = kind, False
    return out


def plain_leaks(docs, bench, window=8, share=0.5, run=13):
    """Every text against every item, window by window, shift by shift."""
    best = {}
    for item_id, item in bench:
        a = plain_tokens(item)
        size = min(window, len(a))
        if item_id is None or not size:
            continue
        places = range(len(a) - size + 1)
        usable = {p for p in places if 2 * sum(k is None for _, k in a[p : p + size]) >= size}
        for doc_id, text in docs:
            b = plain_tokens(text)
            if doc_id is None:
                continue
            lines = collections.defaultdict(lambda: (set(), set()))
            form = lambda t: t[0] if t[1] is None else (t[1],)
            for p in places:
                for q in range(len(b) - size + 1):
                    x, y = a[p : p + size], b[q : q + size]
                    if [t for t, _ in x] == [t for t, _ in y]:
                        lines[q - p][0].add(p)
                    if p in usable and 2 * sum(k is None for _, k in y) >= size and [form(t) for t in x] == [form(t) for t in y]:
                        lines[q - p][1].add(p)
            found = None
            for shift, (exact, alike) in lines.items():
                slots = {p: {(a[p + k][0], b[p + shift + k][0]) for k in range(size) if a[p + k][1]} for p in alike}
                votes = collections.Counter(s for ss in slots.values() for s in ss)
                values = {}
                for (v, w), n in votes.items():
                    values[v] = max(values.get(v, (0, False, "")), (n, v == w, w)) if v in values else (n, v == w, w)
                agreed = {p for p, ss in slots.items() if all(values[v][2] == w for v, w in ss)}
                at = exact | agreed
                long = len(a) >= run and any(all(p + k in exact for k in range(run - size + 1)) for p in exact) if run > size else bool(exact)
                found = found or [set(), set(), False]
                found[0] |= at
                found[1] |= at & usable
                found[2] |= long
            if found:
                whole, part = len(found[0]) / len(places), len(found[1]) / len(usable) if usable else 0.0
                if max(whole, part) >= share or found[2]:
                    best[doc_id, item_id] = max(best.get((doc_id, item_id), 0), whole, part)
    return best


def test_leaks_against_plain(spark):
    rnd = random.Random(17)
    words = "the a of train leaves walks with and meets buys apples after on way to old bridge before sells in total how many are there left".split()
    names, units = ["Anna", "Otto", "Paris", "Boston", "Zoë"], ["km", "miles", "kg", "hours"]

    def sentence(n):
        out = [rnd.choice(words)]
        while len(out) < n:
            out.append(rnd.choice([rnd.choice(words), rnd.choice(words), rnd.choice(names), str(rnd.randint(2, 99)), f"{rnd.randint(2, 99)} {rnd.choice(units)}"]))
        return " ".join(out).capitalize() + rnd.choice([".", "?", ""])

    items = [sentence(rnd.randint(3, 30)) for _ in range(12)]
    bench = [*enumerate(items), (3, sentence(20)), (50, items[4]), (51, items[5].replace("Anna", "Otto")), (60, None), (61, ""), (None, sentence(9))]

    def copied(item):
        kind = rnd.randrange(5)
        if kind == 0:
            return item
        if kind == 1:
            return rnd.choice([str.upper, str.lower, str.title])(item)
        if kind == 2:
            swap = {n: rnd.choice(names) for n in names} | {u: rnd.choice(units) for u in units}
            return " ".join(swap.get(w, str(int(w) + 3) if w.isdigit() else w) for w in item.split(" "))
        parts = item.split(" ")
        k = rnd.randint(0, max(0, len(parts) - 4))
        return " ".join(parts[k : k + rnd.randint(4, 20)])

    docs = [(k, " ".join([sentence(6), copied(rnd.choice(items)), sentence(5), copied(rnd.choice(items)), sentence(4)])) for k in range(60)]
    docs += [(7, items[2]), (7, copied(items[3])), (99, None), (None, items[0])]
    got = {(r.doc_id, r.item_id): r.coverage for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    want = plain_leaks(docs, bench)
    assert len(want) > 60 and got.keys() == want.keys()
    for key, coverage in want.items():
        assert abs(got[key] - coverage) < 1e-9, key


def test_leaks_of_repeated_ids_and_equal_items(spark):
    item = "A train leaves Boston with 40 cars and meets Anna after 3 km on the way to the old bridge."
    other = "They walk from Rome to the north for 12 days and rest near a lake that nobody has ever seen."
    again = item.replace("40", "55").replace("Anna", "Otto")
    got = leaks_of(spark, [(10, item), (10, again), (11, other)], [(1, item), (2, item), (3, item), (3, other)])
    assert set(got) == {(10, 1), (10, 2), (10, 3), (11, 3)}
    assert all(r.coverage == 1 and not r.reparameterised for r in got.values())


def plain_chats(rows):
    convs = collections.defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn, role, text))
    none = lambda x: (x is not None, x if x is not None else "")
    convs = {c: [(r, t) for _, r, t in sorted(v, key=lambda x: ((x[0] is not None, x[0] or 0), none(x[1]), none(x[2])))] for c, v in convs.items()}
    out = {}
    for c, v in convs.items():
        longer = any(len(w) > len(v) and w[: len(v)] == v for w in convs.values())
        equal = [k for k, w in convs.items() if w == v]
        if not longer and c == min((k for k in equal if k is not None), default=None):
            out[c] = ("".join(f"<|im_start|>{'unknown' if r is None else r}\n{t or ''}<|im_end|>\n" for r, t in v), len(v), len(equal))
    return out


def test_chats(spark):
    base = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes")]
    rows = [(c, t, *base[t]) for c, n in ((1, 2), (2, 4), (3, 4), (4, 1), (5, 3)) for t in range(n)]
    rows += [(6, t, "user", f"long {t}") for t in range(600)] + [(7, t, "user", f"long {t}") for t in range(20)] + [(8, 0, None, "a"), (8, None, "user", None), (9, 0, "user", "x"), (9, 0, "user", "x"), (10, 0, "user", "x")]
    rows += [(11, 0, "user", "word " * 60_000), (None, 1, "user", "nobody")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, pos int")
    for block in (4, 256):
        got = {r.conv_id: (r.text, r.n_turns, r.n_equal) for r in chats.formatted(df, block).collect()}
        assert got == plain_chats(rows)
    assert chats.formatted(df.limit(0)).collect() == []


class PlainTwister:
    """The Mersenne twister as the shuffle of arrays draws from it."""

    def __init__(self, seed):
        self.state = np.random.RandomState([seed >> 32 & 0xFFFFFFFF, seed & 0xFFFFFFFF])

    def below(self, n):
        draw = lambda: int(self.state.randint(0, 1 << 32, dtype=np.uint32)) >> 1
        if n & -n == n:
            return n * draw() >> 31
        while True:
            bits = draw()
            if bits - bits % n + n - 1 < 1 << 31:
                return bits % n


def plain_shards(rows, shards_=16, seed=shards.SEED, bucket_bytes=shards.BUCKET_BYTES):
    """Buckets by the seeded hash, each sorted and shuffled from its first item to its last; even runs of all."""
    import xxhash

    n_buckets = max(shards_, -(-sum(len((t or "").encode()) + 1 for _, t in rows) // bucket_bytes))
    buckets = collections.defaultdict(list)
    for doc_id, text in rows:
        h = xxhash.xxh64_intdigest(seed.to_bytes(4, "little"), 42)
        h = h if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little"), h)
        h = h if text is None else xxhash.xxh64_intdigest(text.encode(), h)
        h = h - (1 << 64) if h >> 63 else h
        buckets[h % n_buckets].append((doc_id, text))
    out, place, total = collections.Counter(), 0, max(1, len(rows))
    for b in range(n_buckets):
        mine = sorted(buckets[b], key=lambda r: ((r[0] is not None, r[0] or 0), (r[1] is not None, (r[1] or "").encode())))
        order, twister = [], PlainTwister(seed + b)
        for i in range(len(mine)):
            j = twister.below(i + 1)
            order.append(i)
            order[i], order[j] = order[j], i
        for k in order:
            shard = place * shards_ // total
            slot = place - -(-shard * total // shards_)
            text = mine[k][1] or ""
            out[mine[k][0], len(text.encode()) + 1, zlib.crc32(text.encode()), "rows", shard, slot, None] += 1
            place += 1
    return out


def test_shards_against_plain(spark):
    rnd = random.Random(6)
    rows = [(i, None if i % 50 == 0 else "é " * rnd.randint(0, 30)) for i in range(700)] + [(5, "same")] * 40 + [(None, ""), (None, None), (None, "x")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, slot int").repartition(3)
    got = collections.Counter((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.slot, r.grown_shard) for r in shards.documents_sharded(df).collect())
    assert got == plain_shards(rows)


def test_shards(spark):
    rows = [(i, None if i % 50 == 0 else "é" * (i % 7), "x") for i in range(1000)] + [(5, "same", "y")] * 40 + [(None, "", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(5)
    got = shards.documents_sharded(df).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"rows"}
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.grown_shard is None
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    key = lambda rs: sorted((r.shard, r.slot, r.doc_id or -1, r.size, r.text_crc32) for r in rs)
    assert key(got) == key(shards.documents_sharded(df.repartition(2)).collect())  # whatever the partitioning
    order = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot)) if r.doc_id is not None]
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.15
    assert shards.documents_sharded(df.limit(0)).collect() == []
    few = shards.documents_sharded(df.limit(3)).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0]


def test_shards_of_many_copies(spark):
    rows = [(i, f"text {i}") for i in range(400)] + [(5, "same")] * 300 + [(None, None)] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = []
    for n in (3, 7):
        made = shards.shuffled(df.repartition(n).withColumn("size", shards.byte_size(df["text"])), ["doc_id", "text", "size"], "size", least_copies=50)
        found.append(sorted((r.shard, r.slot, r.doc_id or -1, r.text or "") for r in made.collect()))
    assert found[0] == found[1] and len(found[0]) == len(rows)
    counts = collections.Counter(s for s, *_ in found[0])
    assert max(counts.values()) - min(counts.values()) <= 1 and all(sorted(x[1] for x in found[0] if x[0] == s) == list(range(n)) for s, n in counts.items())
    spread = collections.Counter(s for s, _, i, t in found[0] if t == "same")
    assert len(spread) == 16 and max(spread.values()) < 60  # not in one bucket, so not in one run of shards


def test_write_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "t" * i) for i in range(100)], "doc_id long, text string")
    shards.write_shards(df, str(tmp_path / "out"), identity=["doc_id"])
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and {r.shard for r in back.select("shard").distinct().collect()} == set(range(16))


def test_shards_hold_whole_texts(spark, monkeypatch):
    rows = [(i, None if i % 9 == 0 else f"{i} é\n" * (i % 40)) for i in range(600)]
    written, write = [], shards.write_shards

    def small_buckets(records, path, **options):
        write(records, path, **options, bucket_bytes=1000)
        written.append(path)

    monkeypatch.setattr(shards, "write_shards", small_buckets)
    got = shards.documents_sharded(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    texts = {(r.shard, r.slot): (r.doc_id, r.text) for r in spark.read.parquet(*written).collect()}
    assert sorted(texts.values()) == sorted(rows, key=lambda r: r[0])
    told = got.collect()
    assert len(told) == len(rows)
    for r in told:
        i, text = texts[r.shard, r.slot]
        assert (r.doc_id, r.size, r.text_crc32) == (i, len((text or "").encode()) + 1, zlib.crc32((text or "").encode()))
    for shard in range(16):  # files by name and rows in slot order
        files = sorted(glob.glob(f"{written[0].removeprefix('file:')}/shard={shard}/*.parquet"))
        slots = [x for f in files for x in pq.read_table(f, columns=["slot"], partitioning=None).column(0).to_pylist()]
        assert slots == list(range(len(slots))) and slots


def test_urls(spark):
    rules = [("block", "Example.com", "/en/"), ("allow", "com", "/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
    cases = {
        None: ("", "", None, "allow"), "": ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://WWW.Example.COM/en/a?x#y": ("www.example.com", "/en/a", "www.example.com/en/", "allow"),
        "https://a.b.example.com/en/": ("a.b.example.com", "/en/", "example.com/en/", "block"), "x://example.com": ("example.com", "", None, "allow"), "x://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "x://net/fr/": ("net", "/fr/", "net/fr/", "block"), "x://a.net/fr": ("a.net", "/fr", None, "allow"), "x://a.net?/fr/": ("a.net", "", None, "allow"), "x://É.com/://": ("É.com", "/://", "com/", "allow"),
        "x://a..com/z": ("a..com", "/z", "com/", "allow"), "x://com:80/": ("com:80", "/", None, "allow"), "y" * 100_000 + "://b.net/es/q": ("b.net", "/es/q", "net/es/", "block"),
    }
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)] + [(2, "no scheme", "x")], "page_id long, url string, host string")
    got = urls.filter_urls(df, rules).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == list(cases.values())[r.page_id], r.url
    assert urls.filter_urls(df.limit(0), rules).collect() == []
    assert {r.verdict for r in urls.filter_urls(df, []).collect()} == {"allow"}


def test_urls_confirm_collisions(tmp_path, monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda b: 7)
    path = tmp_path / "d"
    path.write_bytes(urls.build([("block", "a.com", "/"), ("block", "b.com", "/")]))
    assert (urls.DigestArray(str(path)).probe([b"b.com/", b"c.com/", b"a.com/"]) >= 0).tolist() == [True, False, True]


def test_quality(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    good = [" ".join(word() for _ in range(rnd.randint(5, 80))) + "." for _ in range(200)]
    bad = [" ".join(word() + rnd.choice(["***", "$$$"]) for _ in range(rnd.randint(5, 80))) if k % 2 else " ".join(w for w in [word() for _ in range(8)] for _ in range(6)) for k in range(200)]
    rows = [(i, t, "x") for i, t in enumerate(good + bad)] + [(900, None, "x"), (901, "", "x"), (None, "z", "x"), (0, good[0], "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(400)] + [(None, 1, 0), (5000, 0, 0), (3, None, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.documents_scored(df, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 400]
    assert len(held) > 80 and np.mean([r.predicted == int(r.doc_id < 200) for r in held]) > 0.95
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    kept = quality.good(df, labels)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert {r.predicted for r in quality.documents_scored(df, labels.limit(0)).collect()} == {1}
    assert quality.documents_scored(df.limit(0), labels).collect() == []
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    assert {(r.doc_id, r.score) for r in quality.documents_scored(df, flipped).collect()} == {(r.doc_id, r.score) for r in got}  # held-out labels teach nothing


def test_profiles_never_overstate():
    rnd = np.random.default_rng(8)
    for n in (1, 5, 140, 600, 3000):
        for share in (0.0, 0.05, 0.3, 1.0):
            pool = rnd.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
            a, b = pool[:n], np.concatenate((pool[: n - int(share * n)], pool[n : n + int(share * n)]))[: max(1, n - n // 8)]
            differ = len(np.setxor1d(a, b))
            bound = jaccard.apart_by(jaccard.profile_of(a), jaccard.profile_of(b))
            assert differ * 0.5 - 5 <= bound <= differ


def test_blocks_of_a_bucket(spark):
    rnd = np.random.default_rng(9)
    base = rnd.integers(0, 1 << 63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[k % 7 :], rnd.integers(0, 1 << 63, k % 5, dtype=np.uint64)))) for k in range(40)]
    rows = [(1, i, i % 6, len(s), bytearray(jaccard.profile_of(s))) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "sig long, rep long, c long, n_shingles long, profile binary")
    found = [{(r.a, r.b) for r in jaccard.across(df, 85, block).collect()} for block in (7, 4096)]
    assert found[0] == found[1]
    for i in range(40):
        for j in range(i + 1, 40):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i % 6 != j % 6 and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in found[0]


def plain_features(text):
    """The numbers of a text's n-grams, one by one."""
    make = quality.Featuriser()
    raw, words, grams = text.encode(), text.split(), []
    for n in (1, 2, 3):
        grams += [(int.from_bytes(raw[k : k + n], "big"), n) for k in range(len(raw) - n + 1)]
    marks = [next((lag for lag in (1, 2, 3, 4) if k >= lag and words[k] == words[k - lag]), 0) for k in range(len(words))]
    if len(words) > 1 and any(marks):
        for n in range(1, 5):
            for k in range(len(marks) - n + 1):
                value = 0
                for m in marks[k : k + n]:
                    value = value << 3 | m
                grams.append((value, 3 + n))
    return {int(make._hashed(np.array([g], np.uint32), kind)[0]) for g, kind in grams}


def plain_fit(sets, labels, cost=4.0, epochs=12, seed=7):
    """Weights by feature and the bias: ratios of smoothed shares, then one dual after another."""
    width, signs = quality.WIDTH, [1 if y == 1 else -1 for y in labels]
    counts = {s: collections.Counter(f for x, y in zip(sets, signs, strict=True) if y == s for f in x) for s in (1, -1)}
    totals = {s: width + sum(counts[s].values()) for s in (1, -1)}
    ratio = lambda f: math.log((counts[1][f] + 1) / totals[1] / ((counts[-1][f] + 1) / totals[-1]))
    examples = []
    for x in sets:
        v = {f: ratio(f) for f in x}
        length = math.sqrt(sum(w * w for w in v.values())) or 1.0
        examples.append({f: w / length for f, w in v.items()})
    caps = {s: cost * 0.5 / (signs.count(s) / len(signs)) for s in (1, -1)}
    weights, bias, duals, order = collections.Counter(), 0.0, [0.0] * len(sets), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in order.permutation(len(sets)):
            x, y = examples[i], signs[i]
            slack = y * (sum(weights[f] * w for f, w in x.items()) + bias) - 1
            dual = min(max(duals[i] - slack / (1 + sum(w * w for w in x.values())), 0.0), caps[y])
            for f, w in x.items():
                weights[f] += (dual - duals[i]) * y * w
            bias += (dual - duals[i]) * y
            duals[i] = dual

    def score(features):
        v = {f: ratio(f) for f in features}
        length = math.sqrt(sum(w * w for w in v.values())) or 1.0
        return 1 / (1 + math.exp(-2 * (sum(weights[f] * w for f, w in v.items()) / length + bias)))

    return score


def test_quality_against_plain(spark):
    rnd = random.Random(31)
    word = lambda: "".join(rnd.choice("abcdefghijé") for _ in range(rnd.randint(2, 7)))
    texts = {k: " ".join(word() for _ in range(25)) if k % 2 else " ".join(word() + rnd.choice("***$") for _ in range(6)) + " buy buy now now " * 3 for k in range(60)}
    texts |= {60: "", 61: "x", 62: "word " * 20_000, 63: "a a a a"}
    labels = [(k, k % 2, 0) for k in range(50)]
    docs = spark.createDataFrame([*texts.items(), (70, None)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.documents_scored(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    taught = [k for k, _, _ in labels if zlib.crc32(str(k).encode()) % 3 != 1]
    score = plain_fit([plain_features(texts[k]) for k in taught], [k % 2 for k in taught])
    for k, text in texts.items():
        assert abs(got[k] - score(plain_features(text))) < 1e-4, k
    assert abs(got[70] - got[60]) < 1e-9
    few = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), most_bytes=1)
    assert few.slope  # the first document of either class always counts
