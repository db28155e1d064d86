"""Secret scan: fixed patterns, and the entropy of sliding windows over candidate strings."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import free_name, let, running_sums, span_string

#: The base patterns. Runs that must have a least length state it, where that finds the same matches.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
LEAST_VALUE = 8


class Alphabet(NamedTuple):
    """A character class; a candidate is a maximal run of run that matches needs; high: bits in a window that make a secret."""

    name: str
    chars: str
    run: str
    needs: str
    window: int
    high: float


_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = (
    Alphabet("entropy_hex", _DIGITS + "abcdefABCDEF", r"(?<![0-9A-Za-z])[0-9a-fA-F]{24,}+(?![0-9A-Za-z])", r"[0-9].*[a-fA-F]|[a-fA-F].*[0-9]", 24, 3.0),
    Alphabet("entropy_base64", _LETTERS + _LETTERS.upper() + _DIGITS + "+/_=-", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+", r"(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])", 20, 3.7),
    Alphabet("entropy_lower", _LETTERS + _DIGITS, r"(?<![0-9A-Za-z])[a-z0-9]{20,}+(?![0-9A-Za-z])", r"[0-9].*[a-z]|[a-z].*[0-9]", 20, 3.6),
    Alphabet("entropy_upper", _LETTERS.upper() + _DIGITS, r"(?<![0-9A-Za-z])[A-Z0-9]{20,}+(?![0-9A-Za-z])", r"[0-9].*[A-Z]|[A-Z].*[0-9]", 20, 3.6),
    Alphabet("entropy_letters", _LETTERS + _LETTERS.upper(), r"(?<![0-9A-Za-z])[A-Za-z]{20,}+(?![0-9A-Za-z])", r"[a-z].*[A-Z]", 20, 3.8),
)
#: Candidates that are never a secret, whatever their entropy: UUIDs, paths of words.
ALLOWED = r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$|^/?([a-z]+/){2,}[a-z]*$"
#: Placeholders and alphabets: they part a candidate, and what stands beside them is judged without them.
PLACEHOLDER = r"(?i)example|placeholder|changeme|x{6,}|0123456789|abcdefgh" + "".join(f"{c}?" for c in "ijklmnopqrstuvwxyz")
KINDS = ("assign", "access", "hex", *(a.name for a in ALPHABETS))


def found(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """array<struct<start, kind, end>> of a pattern's matches, in code points.

    A match starts where the gaps and matches before it end. keep: (pattern group, its least length), else all are kept.
    """
    unit = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def placed(matches: Column) -> Column:
        """A gap and a match make a step; where a match stands is the sum of the steps before it, and its own gap."""
        sizes = F.transform(matches, F.length)
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        held = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0])), F.length) if keep else sizes
        return let(F.struct(sizes.alias("m"), gaps.alias("g"), held.alias("v")), lambda x: let(F.struct(x["m"].alias("m"), x["g"].alias("g"), x["v"].alias("v"), running_sums(F.zip_with(x["m"], F.slice(x["g"], 1, F.size(x["m"])), lambda m, g: m + g)).alias("s")), spans))

    def spans(x: Column) -> Column:
        begin = lambda i: F.get(x["s"], i) + F.get(x["g"], i)
        every = F.transform(x["m"], lambda m, i: F.struct(begin(i).alias("start"), F.lit(kind).alias("kind"), (begin(i) + m).alias("end")))
        return F.filter(every, lambda _, i: F.get(x["v"], i) >= keep[1]) if keep else every

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(unit))


def highest_entropy(s: Column, alphabet: Alphabet) -> Column:
    """The highest Shannon entropy, in bits, of any window of s; null if s is shorter than a window.

    The counts of the first window are taken in full; each step then lowers one count and raises another, and the sum of
    c log2 c changes by those two terms.
    """
    w = alphabet.window
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(w + 2)])
    term = lambda c: F.element_at(terms, c + 1)
    first = F.substring(s, 1, w)
    counts = F.transform(F.split(F.lit(alphabet.chars), ""), lambda c: F.length(first) - F.length(F.replace(first, c, F.lit(""))))
    code = lambda i: F.instr(F.lit(alphabet.chars), F.substr(s, i, F.lit(1)))

    def step(acc: Column, i: Column) -> Column:
        def moved(x: Column) -> Column:
            leaves, comes = x["leaves"], x["comes"]
            down = F.element_at(acc["counts"], leaves)
            up = F.element_at(acc["counts"], comes)
            total = acc["total"] - term(down) + term(down - 1) - term(up) + term(up + 1)
            counts = F.transform(acc["counts"], lambda c, j: c - F.when(j + 1 == leaves, 1).otherwise(0) + F.when(j + 1 == comes, 1).otherwise(0))
            same = leaves == comes
            return F.struct(
                F.when(same, acc["counts"]).otherwise(counts).alias("counts"),
                F.when(same, acc["total"]).otherwise(total).alias("total"),
                F.when(same, acc["least"]).otherwise(F.least(acc["least"], total)).alias("least"),
            )

        return let(F.struct(code(i).alias("leaves"), code(i + w).alias("comes")), moved)

    def over(c: Column) -> Column:
        total = F.aggregate(c, F.lit(0.0), lambda a, x: a + term(x))
        start = let(total, lambda t: F.struct(c.alias("counts"), t.alias("total"), t.alias("least")))
        steps = F.when(F.length(s) > w, F.sequence(F.lit(1), F.length(s) - w)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda acc: F.lit(math.log2(w)) - acc["least"] / w)

    return F.when(F.length(s) >= w, let(counts, over))


def entropy_spans(text: Column, candidates: Column, alphabet: Alphabet, allowed: str = ALLOWED) -> Column:
    """Those of the candidates of a class that are mixed enough and not allowed."""
    cut = lambda x: F.substr(text, x["start"] + 1, x["end"] - x["start"])
    mixed = lambda s: F.when(F.rlike(s, F.lit(alphabet.needs)), F.coalesce(highest_entropy(s, alphabet) >= alphabet.high, F.lit(False))).otherwise(False)
    secret = lambda s: F.when(F.rlike(s, F.lit(alphabet.needs)) & ~F.rlike(s, F.lit(allowed)), F.exists(F.split(s, PLACEHOLDER, -1), mixed)).otherwise(False)
    return F.filter(candidates, lambda x: let(cut(x), secret))


def _joined(spans: Column, added: Column) -> Column:
    """spans, and those added that meet none of them. Only where something is added are the two compared."""
    meets = lambda e: F.exists(spans, lambda b: (b["start"] < e["end"]) & (b["end"] > e["start"]))
    return F.when(F.size(added) == 0, spans).otherwise(F.concat(spans, F.filter(added, lambda e: ~meets(e))))


def scan(documents: DataFrame, text: str = "text") -> DataFrame:
    """documents with spans: array<struct<start, kind, end>> over the whole text, kind an index into KINDS.

    Base spans always stay; an entropy span is added where it meets neither a base span nor one of an earlier class.
    A null text counts as empty and has none. Repeated rows are scanned one by one; a column named spans gives way.
    An empty table stays empty. Time grows in proportion to a text and its matches.
    """
    kept = [c for c in documents.columns if c != "spans"]
    own = lambda k: free_name(f"__{k}", documents.columns)
    body, none = F.col(own("body")), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    guard = lambda holds, spans: F.when(holds, spans).otherwise(none)
    rows = documents.withColumn(own("body"), F.coalesce(documents[text], F.lit("")))
    matched = {
        "assign": guard(body.contains("=") | body.contains(":"), found(body, ASSIGN, 0, (2, LEAST_VALUE))),
        "access": guard(body.contains("AKIA"), found(body, ACCESS, 1)),
        "hex": found(body, HEX, 2),
    }
    for k, alphabet in enumerate(ALPHABETS, 3):
        matched[alphabet.name] = guard(F.rlike(body, F.lit("[0-9]")) if "0" in alphabet.chars else F.lit(True), found(body, alphabet.run, k))
    rows = rows.withColumns({own(name): spans for name, spans in matched.items()})
    for alphabet in ALPHABETS:
        rows = rows.withColumn(own(alphabet.name), entropy_spans(body, F.col(own(alphabet.name)), alphabet))
    rows = rows.withColumn("spans", F.concat(*[F.col(own(k)) for k in ("assign", "access", "hex")]))
    for alphabet in ALPHABETS:
        rows = rows.withColumn("spans", _joined(F.col("spans"), F.col(own(alphabet.name))))
    return rows.select(*kept, "spans")


def documents_scanned(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every whole text."""
    rows = scan(documents.select("doc_id", "text")).select("doc_id", "spans")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    names = list(KINDS)
    return rows.select("doc_id", *[count(k).alias(f"n_{names[k]}") for k in range(3)], F.sha2(span_string(base, names), 256).alias("base_sha256"), span_string(F.col("spans"), names).alias("spans"))
