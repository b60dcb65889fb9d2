"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame functions only.

A text is the set of the digests of its paragraphs (a paragraph ends at a line
end or a sentence end). Each digest goes to three cells; a cell holds a count,
the XOR of its digests and the XOR of their check hashes. Two sketches subtract
cell by cell; what both texts share cancels. Peeling then takes digests from
cells that hold just one and removes them from their other cells, until the
differing digests are all known. If it gets stuck the sketch was too small and
the subtraction is repeated with sixteen times the cells.

Sketches are kept as sorted arrays of their non-empty cells, so the work follows
the number of paragraphs whatever the number of cells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells of the fingerprint itself, a multiple of three.
CELLS = 60
GROWTH, RETRIES = 16, 6
#: More rounds than peeling below its threshold ever takes.
ROUNDS = 48
PARAGRAPH_END = r"[.!?\n]+\s*"
#: Documents that share a window when each is paired with the next.
BLOCK, SEGMENTS = 2000, 256


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def digests(text: Column) -> Column:
    """The distinct paragraph digests of a text; none for a null or blank one."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: F.length(p) > 0)
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(7))


def _entries(digest: Column, count: Column, cells: Column) -> Column:
    """What a digest adds to its three cells, one in each third of the sketch.

    The places come from the two halves of the digest and from its check hash.
    Every size of sketch divides the next, so digests that part in a small one
    stay apart in larger ones.
    """
    third = (cells / 3).cast("long")

    def three(check: Column) -> Column:
        places = (digest, F.shiftrightunsigned(digest, 32), check)
        return F.array(*(F.struct((F.pmod(x, third) + j * third).alias("c"), count.alias("n"), digest.alias("k"), check.alias("h")) for j, x in enumerate(places)))

    return _let(_check(digest), three)


def _combine(entries: Column) -> Column:
    """Entries summed by cell, sorted, without empty cells. Linear after the sort."""

    def both(a: Column, x: Column) -> Column:
        return F.struct(a["c"].alias("c"), (a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"), a["h"].bitwiseXOR(x["h"]).alias("h"))

    def by_cell(s: Column) -> Column:
        def groups(starts: Column) -> Column:
            def total(at: Column, size: Column) -> Column:
                # Most cells hold one entry once the sketch is large enough, or two when sketches subtract.
                first = F.get(s, at - 1)
                longer = F.aggregate(F.slice(s, at + 1, size - 1), first, both)
                return F.when(size == 1, first).when(size == 2, both(first, F.get(s, at))).otherwise(longer)

            return F.transform(starts, lambda at, i: _let(F.coalesce(F.get(starts, i + 1), F.size(s) + 1) - at, lambda size: total(at, size)))

        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1)["c"] != F.get(s, i - 2)["c"]))
        return F.filter(_let(starts, groups), lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))

    return _let(F.sort_array(entries), lambda s: F.when(F.size(s) == 0, s).otherwise(by_cell(s)))


def _adds(count: int, cells: Column) -> Callable[[Column], Column]:
    return lambda digest: _entries(digest, F.lit(count), cells)


def sketch(found: Column, cells: Column, count: int = 1) -> Column:
    """The sketch of a set of digests; ``count`` of -1 gives its negative."""
    return _combine(F.flatten(F.transform(found, lambda d: _entries(d, F.lit(count), cells))))


def _peel(difference: Column, cells: Column) -> Column:
    """The digests of a subtracted sketch with their sign; null if peeling gets stuck."""
    none = F.array(F.struct(F.lit(0).cast("long").alias("k"), F.lit(0).alias("n")))
    state = _let(difference, lambda d: F.struct(d.alias("cells"), F.slice(none, 1, 0).alias("found"), (F.size(d) > 0).alias("live")))

    def step(s: Column, _: Column) -> Column:
        def go(pure: Column) -> Column:
            gone = F.flatten(F.transform(pure, lambda p: _entries(p["k"], -p["n"], cells)))
            rest = _combine(F.concat(s["cells"], gone))
            return _let(rest, lambda r: F.struct(r.alias("cells"), F.concat(s["found"], pure).alias("found"), (F.size(r) > 0).alias("live")))

        def distinct(single: Column) -> Column:
            # By sign: numbers are made distinct by hashing, structs are not.
            def of(n: int) -> Column:
                keys = F.array_distinct(F.transform(F.filter(single, lambda x: x["n"] == n), lambda x: x["k"]))
                return F.transform(keys, lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))

            return F.concat(of(1), of(-1))

        single = F.filter(s["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"])))
        stuck = F.struct(s["cells"].alias("cells"), s["found"].alias("found"), F.lit(False).alias("live"))
        # Once all is found, or nothing can be taken, later rounds do nothing.
        return F.when(~s["live"], s).otherwise(_let(_let(single, distinct), lambda p: F.when(F.size(p) == 0, stuck).otherwise(go(p))))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step)
    return _let(done, lambda d: F.when(F.size(d["cells"]) == 0, d["found"]))


def difference(a: Column, b: Column, a_sketch: Column, b_sketch: Column) -> Column:
    """The digests in just one of two sets, recovered by subtracting sketches and peeling.

    The sketches of CELLS cells are given; sketches of sixteenfold size follow
    until peeling succeeds. Only if none of RETRIES sizes does (a pair of
    digests that share all cells every time) are the sets compared as they are.
    """
    negative = F.transform(b_sketch, lambda x: F.struct(x["c"].alias("c"), (-x["n"]).alias("n"), x["k"].alias("k"), x["h"].alias("h")))
    at_once = _peel(_combine(F.concat(a_sketch, negative)), F.lit(CELLS).cast("long"))

    def attempt(known: Column, i: Column) -> Column:
        cells = (F.lit(CELLS) * F.pow(F.lit(float(GROWTH)), i)).cast("long")
        # One pass over both sets: sketches subtract entry by entry as well.
        entries = lambda m: F.concat(*(F.flatten(F.transform(x, _adds(n, m))) for x, n in ((a, 1), (b, -1))))
        return F.when(known.isNotNull(), known).otherwise(_let(cells, lambda m: _peel(_combine(entries(m)), m)))

    peeled = F.aggregate(F.sequence(F.lit(1), F.lit(RETRIES - 1)), at_once, attempt)
    plain = F.concat(F.array_except(a, b), F.array_except(b, a))
    return _let(peeled, lambda p: F.when(p.isNotNull(), F.transform(p, lambda x: x["k"])).otherwise(plain))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two described texts (``set``, ``sketch``) from the size of their recovered difference; 1 for two empty ones."""
    both = F.size(a["set"]) + F.size(b["set"])
    return _let(F.size(difference(a["set"], b["set"], a["sketch"], b["sketch"])), lambda d: F.when(both == 0, F.lit(1.0)).otherwise((both - d) / (both + d)))


def described(found: Column) -> Column:
    """A set of digests with its sketch of CELLS cells."""
    return F.struct(found.alias("set"), sketch(found, F.lit(CELLS).cast("long")).alias("sketch"))


def fingerprint(cells: Column) -> Column:
    """A sketch as text: ``cell:count:digests:checks`` in hexadecimal."""
    return F.array_join(F.transform(cells, lambda x: F.concat_ws(":", F.hex(x["c"]), F.hex(x["n"].cast("long")), F.hex(x["k"]), F.hex(x["h"]))), " ")


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text, next_text``: each row with the text of the next in descending ``doc_id``, the first after the last.

    Null ids come last; rows of one id are in the order of their texts' hashes
    and then any. Ids are cut into ranges of about BLOCK rows: quantiles first,
    equal steps between them. A window orders each range alone, and the first
    row of the next range is copied to its end. One shuffle of the texts.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shape = rows.agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.percentile_approx("doc_id", [k / SEGMENTS for k in range(1, SEGMENTS)], 10_000).alias("cuts")).first()
    low, high = (shape["low"], shape["high"]) if shape["low"] is not None else (0, 0)
    blocks = max(1, shape["n"] // BLOCK)
    cuts = sorted({*(shape["cuts"] or []), high} - {low}) if blocks > 1 else []
    edges = [low, *cuts[:-1], high + 1] if cuts else [low, high + 1]
    steps = max(1, round(blocks / (len(edges) - 1)))
    segment = F.size(F.filter(F.array(*(F.lit(x) for x in edges[1:-1])) if len(edges) > 2 else F.array().cast("array<bigint>"), lambda x: x <= F.col("doc_id")))
    first = F.element_at(F.array(*(F.lit(x) for x in edges[:-1])), F.col("segment") + 1)
    width = F.element_at(F.array(*(F.lit(max(1, -(-(b - a) // steps))) for a, b in zip(edges, edges[1:]))), F.col("segment") + 1)
    ranged = rows.withColumn("segment", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(segment)).withColumn("step", F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.floor((F.col("doc_id") - first) / width)))
    heads = ranged.groupBy("segment", "step").agg(F.max_by(F.struct("doc_id", "text"), F.struct("doc_id", -F.xxhash64("text").cast("decimal(20,0)"))).alias("head"))
    slim = ranged.groupBy("segment", "step").agg(F.count(F.lit(1)).alias("n"))
    tops = {r["segment"]: r["step"] for r in slim.groupBy("segment").agg(F.max("step").alias("step")).collect()}  # SEGMENTS + 1 rows at most
    known = sorted(tops, reverse=True)
    following = {s: known[(k + 1) % len(known)] for k, s in enumerate(known)}
    order = Window.partitionBy("segment").orderBy(F.desc("step"))
    below = slim.withColumn("next_step", F.lead("step").over(order))
    after = F.create_map(*(F.lit(x) for s in known for x in (s, following[s]))) if known else F.create_map().cast("map<int,int>")
    after_step = F.create_map(*(F.lit(x) for s in known for x in (s, tops[following[s]]))) if known else F.create_map().cast("map<int,bigint>")
    targets = below.select(
        F.col("segment").alias("to_segment"),
        F.col("step").alias("to_step"),
        F.when(F.col("next_step").isNotNull(), F.col("segment")).otherwise(after[F.col("segment")]).alias("segment"),
        F.coalesce("next_step", after_step[F.col("segment")].cast("long")).alias("step"),
    )
    ghosts = heads.join(targets, ["segment", "step"]).select("head.doc_id", "head.text", F.col("to_segment").alias("segment"), F.col("to_step").alias("step"), F.lit(True).alias("ghost"))
    inside = Window.partitionBy("segment", "step").orderBy("ghost", F.desc("doc_id"), F.xxhash64("text"))
    paired = ranged.withColumn("ghost", F.lit(False)).unionByName(ghosts).withColumn("next_text", F.lead("text").over(inside))
    return paired.filter(~F.col("ghost")).select("doc_id", "text", "next_text")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last third (rounded down, in code points) replaced
    by as much of the next text. Null texts count as empty: the fingerprint of
    an empty text is empty, and two empty texts are alike (1). Repeated rows
    are each a document. An empty table gives an empty result.
    """
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    pairs = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), digests(F.col("text")).alias("own"), digests(F.col("next_text")).alias("next"))
    sets = pairs.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "own", digests(F.col("edited")).alias("changed"), "next")
    # One expression for all three texts, so that each sketch is made once.
    three = sets.select("doc_id", "n_chars", "edited_sha256", F.transform(F.array("own", "changed", "next"), described).alias("x"))
    near = _let(F.col("x"), lambda x: F.transform(F.slice(x, 2, 2), lambda other: likeness(F.get(x, F.lit(0)), other)))
    told = three.select("doc_id", "n_chars", "edited_sha256", F.transform(F.slice("x", 1, 2), lambda t: fingerprint(t["sketch"])).alias("prints"), near.alias("near"))
    return told.select("doc_id", "n_chars", "edited_sha256", F.col("prints")[0].alias("fingerprint"), F.col("prints")[1].alias("edited_fingerprint"), F.col("near")[0].alias("near_edited"), F.col("near")[1].alias("near_next"))
