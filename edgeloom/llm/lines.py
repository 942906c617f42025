"""Near-duplicate lines by a segment-partition edit join, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom.llm.linking import groups, narrowed
from edgeloom.llm.storage import bucketed, discard, stored, table
from edgeloom.operators.prefix import lookup

THRESHOLD = 2  # edits between linked lines
PARITY_WORDS = 4  # of 64 bits
MIN_CHARS = 20  # shorter lines have equal copies only: a few edits make another line of them


def probes(line: Column, threshold: int = THRESHOLD) -> list[Column]:
    """Bucket keys of a line.

    A line of length L is cut into ``threshold + 1`` segments of nearly equal
    length. Two lines within the threshold share one of the shorter line's
    segments, at places that differ by no more than the edits before and after
    allow. So for each length from L down to L - threshold, and each segment
    of a line of that length, the few substrings at those places are hashed
    together with that length and the segment's number. The line's own
    segments are among them.
    """
    length = F.char_length(line)
    keys = []
    for less in range(threshold + 1):
        other = length - less
        short = F.floor(other / (threshold + 1)).cast("int")
        longer = other - short * (threshold + 1)  # so many segments, the last ones, have one more
        for i in range(threshold + 1):
            begin = short * i + F.greatest(F.lit(0), longer - (threshold + 1 - i))
            size = short + F.when(longer > threshold - i, 1).otherwise(0)
            lo, hi = max(-i, less - (threshold - i)), min(i, less + (threshold - i))
            for shift in range(lo, hi + 1):
                keys.append(F.xxhash64(other, F.lit(i), F.substring(line, (begin + shift + 1).cast("int"), size.cast("int"))))
    return keys


def bigram_parity(line: Column) -> Column:
    """For each of ``64 * PARITY_WORDS`` bits, whether an odd number of the line's pairs of neighbouring characters hash to it.

    An edit takes away two such pairs at most and adds two, so lines within a
    distance of ``k`` differ in ``4 k`` bits at most.
    """
    def fold(chars: Column) -> Column:
        def flip(acc: Column, h: Column) -> Column:
            bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), h % 64)
            return F.transform(acc, lambda word, k: F.when(k == F.floor(h / 64), word.bitwiseXOR(bit)).otherwise(word))

        bucket = lambda k: F.pmod(F.hash(F.get(chars, k), F.get(chars, k + 1)), F.lit(64 * PARITY_WORDS))
        zero = F.array(*[F.lit(0).cast("bigint")] * PARITY_WORDS)
        return F.aggregate(F.sequence(F.lit(0), F.size(chars) - 2), zero, lambda acc, k: _let(bucket(k), lambda h: flip(acc, h)))

    return _let(F.split(line, ""), fold)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def edit_distance(x: Column, y: Column, threshold: int = THRESHOLD) -> Column:
    """Levenshtein distance of two strings, or ``threshold + 1`` if it is larger.

    Banded bit-parallel dynamic programming (Hyyrö 2003). The differences of
    neighbouring cells of a band around the diagonal are the bits of two
    integers, so a character of ``y`` costs a fixed number of bit operations.
    Both strings must be longer than the threshold.
    """
    width = 2 * threshold + 1
    mask, top = (1 << width) - 1, 1 << (width - 1)

    def invert(v: Column) -> Column:
        return v.bitwiseXOR(F.lit(mask))

    def step(a: Column, b: Column, m: Column, state: Column, j: Column) -> Column:
        # bit k of the band stands for row j + threshold - (width - 1) + k of the pattern
        rows = [j + (threshold - width + 1 + k) for k in range(width)]
        char = F.get(b, j)
        match = None
        for k, r in enumerate(rows):
            bit = F.when(F.get(a, F.when(r >= 0, r)) == char, F.lit(1 << k)).otherwise(F.lit(0))
            match = bit if match is None else match + bit
        vp, vn = state["vp"], state["vn"]

        def with_match(pm: Column) -> Column:
            d0 = ((pm.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(pm).bitwiseOR(vn).bitwiseAND(F.lit(mask))
            return _let(d0, with_d0)

        def with_d0(d: Column) -> Column:
            hp = vn.bitwiseOR(invert(d.bitwiseOR(vp)))
            return _let(F.struct(d.alias("d"), hp.alias("hp"), d.bitwiseAND(vp).alias("hn"),
                                 F.shiftright(d, 1).alias("s")), finish)

        def finish(t: Column) -> Column:
            diagonal = F.when(t["d"].bitwiseAND(F.lit(top)) == 0, 1).otherwise(0)
            at = F.call_function("shiftright", F.lit(top >> 1), F.greatest(F.lit(0), j - (m - threshold)))
            across = F.when(t["hp"].bitwiseAND(at) != 0, 1).when(t["hn"].bitwiseAND(at) != 0, -1).otherwise(0)
            return F.struct(
                t["hn"].bitwiseOR(invert(t["s"].bitwiseOR(t["hp"]))).alias("vp"),
                t["s"].bitwiseAND(t["hp"]).alias("vn"),
                (state["dist"] + F.when(j < m - threshold, diagonal).otherwise(across)).alias("dist"))

        return _let(match, with_match)

    first = ((1 << (threshold + 1)) - 1) << (width - threshold - 1)
    start = F.struct(F.lit(first).alias("vp"), F.lit(0).alias("vn"), F.lit(threshold).alias("dist"))

    def run(p: Column) -> Column:
        # a run that can no longer end below the threshold only passes its state on
        most = F.size(p["b"]) - F.size(p["a"]) + 2 * threshold
        return F.aggregate(
            F.sequence(F.lit(0), F.size(p["b"]) - 1), start,
            lambda s, j: F.when(s["dist"] > most, s).otherwise(step(p["a"], p["b"], F.size(p["a"]), s, j)),
            lambda s: F.least(s["dist"], F.lit(threshold + 1)))

    near = F.abs(F.char_length(x) - F.char_length(y)) <= threshold
    chars = F.struct(F.split(x, "").alias("a"), F.split(y, "").alias("b"))
    return F.when(near, _let(chars, run)).otherwise(F.lit(threshold + 1))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, line_no, line`` of the lines that take part."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter(
        F.char_length("line") >= min_chars)


def _key() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2")]


def line_classes(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = 1, near_chars: int = MIN_CHARS) -> DataFrame:
    """``doc_id, line_no, line_class, copies, first`` of every line that has an equal or a near copy.

    Lines of at least ``min_chars`` characters take part. Two lines of at least
    ``near_chars`` are near copies if their edit distance is at most ``threshold``;
    classes are what chains of near copies connect. ``first`` marks the one
    line of a class with the smallest (doc_id, line_no).
    """
    near_chars = max(min_chars, near_chars)
    names = [f"p{k}" for k in range(len(probes(F.lit(""), threshold)))]
    keyed = _lines(docs, min_chars).select(
        "doc_id", "line_no", *_key(), (F.char_length("line") >= near_chars).alias("near"),
        *[p.alias(name) for p, name in zip(probes(F.col("line"), threshold), names, strict=True)])
    # equal lines are one item: they meet by 128 bits of hash, combined before the shuffle
    distinct = stored(
        keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.max("near").alias("near"), *[F.max(x).alias(x) for x in names])
        .select("h1", "h2", "copies", "near", *[F.when(F.col("near"), F.col(x)).alias(x) for x in names])
        .withColumn("item", F.monotonically_increasing_id()), "lines")
    members = distinct.filter("near").select("item", F.explode(F.array(*names)).alias("bucket"))
    texts: list[DataFrame] = []

    def traits(items: DataFrame) -> DataFrame:
        wanted = stored(distinct.join(items, "item", "left_semi").select("h1", "h2", "item"), "wanted")
        # lines that are not wanted stay where they are, and copies are combined before the shuffle
        some = narrowed(_lines(docs, near_chars).select("line", *_key()), F.col("h1"), wanted.select("h1"))
        texts.append(bucketed(
            some.groupBy("h1", "h2").agg(F.min("line").alias("line")).join(wanted, ["h1", "h2"]).select("item", "line"), "item", "texts"))
        discard(wanted)
        return texts[0].select("item", F.char_length("line").alias("n"), bigram_parity(F.col("line")).alias("parity"))

    def may_link(p: str, q: str) -> Column:
        apart = sum((F.bit_count(F.col(f"{p}parity")[k].bitwiseXOR(F.col(f"{q}parity")[k])) for k in range(PARITY_WORDS)), F.lit(0))
        return (F.abs(F.col(f"{p}n") - F.col(f"{q}n")) <= threshold) & (apart <= 4 * threshold)

    def verify(pairs: DataFrame) -> DataFrame:
        t = texts[0]
        return (
            pairs.join(t.select(F.col("item").alias("a"), F.col("line").alias("x")), "a")
            .join(t.select(F.col("item").alias("b"), F.col("line").alias("y")), "b")
            .filter(edit_distance(F.col("x"), F.col("y"), threshold) <= threshold).select("a", "b")
        )

    roots, settled = groups(members, verify, traits, may_link)
    joined = distinct.select("h1", "h2", "item", "copies").join(roots, "item", "left")
    heads = roots.select("root").distinct().select(F.col("root").alias("item"), F.col("root").alias("head"))
    classed = stored(joined.join(heads, "item", "left").withColumn("line_class", F.coalesce("root", "head")).filter(
        "line_class is not null or copies > 1").select("h1", "h2", F.coalesce("line_class", "item").alias("line_class"), "copies"), "classed")
    discard(distinct, roots, settled, *texts)
    # lines and classes that fill a thousandth of all occurrences are looked up by broadcast, so no task gets all of them
    total = classed.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    occurring = stored(lookup(
        _lines(docs, min_chars).select("doc_id", "line_no", *_key()), classed.withColumn("weight", F.col("copies")),
        ["h1", "h2"], "weight", total, 0).drop("h1", "h2"), "occurring")
    first = stored(occurring.groupBy("line_class").agg(
        F.min(F.struct("doc_id", "line_no")).alias("at"), F.count(F.lit(1)).alias("weight")), "first")
    discard(classed)
    return lookup(occurring, first, ["line_class"], "weight", total, 0).withColumn(
        "first", F.struct("doc_id", "line_no").eqNullSafe(F.col("at"))).drop("at")


def dedup_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = 1, near_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out, and ``n_lines``, ``n_removed``.

    Of every class of equal or near-equal lines (see ``line_classes``) the
    line of the smallest (doc_id, line_no) stays, all others go, in the same
    document too. Lines are parts between line feeds; lines below
    ``min_chars`` characters (by default, empty ones) always stay, those below
    ``near_chars`` go only for an equal one.

    Null text stays null (0 lines); an empty text is one empty line. Rows with
    a null doc_id keep all their lines and lend none. Rows that share a doc_id
    lose the same line numbers; of repeated rows each keeps its first copies.
    Very long texts are taken whole, no rows give no rows. Other columns pass
    through, but ``n_lines`` and ``n_removed`` are replaced.
    """
    named = docs.filter("doc_id is not null").select("doc_id", "text")
    classes = line_classes(named, threshold, min_chars, near_chars)
    # which of a document's lines go, 64 to a word: whether a line does is one lookup, however many there are
    word = classes.filter("not first").select("doc_id", (F.col("line_no") / 64).cast("int").alias("w"), F.call_function(
        "shiftleft", F.lit(1).cast("bigint"), F.col("line_no") % 64).alias("bit")).groupBy("doc_id", "w").agg(F.bit_or("bit").alias("bits"))
    found = F.array_sort(F.collect_list(F.struct("w", "bits")))
    drops = stored(word.groupBy(F.col("doc_id").alias("_line_doc")).agg(
        found.alias("_line_words")), "drops")
    dense = F.transform(
        F.sequence(F.lit(0), F.element_at("_line_words", -1)["w"]),
        lambda w: F.coalesce(F.get(F.filter("_line_words", lambda x: x["w"] == w), 0)["bits"], F.lit(0).cast("bigint")))
    keep = [c for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    lines = F.split("text", "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("bigint").alias("n_lines")
    # documents that lose no line stay where they are; the drops grow with the corpus, so they are merged, not broadcast
    losing = drops.select("_line_doc")
    some, others = narrowed(docs, F.col("doc_id"), losing), narrowed(docs, F.col("doc_id"), losing, others=True)
    both = some.join(
        drops.withColumn("_line_bits", dense).drop("_line_words").hint("merge"), F.col("doc_id") == F.col("_line_doc"), "left")
    bit = lambda k: F.call_function("shiftright", F.coalesce(F.get("_line_bits", (k / 64).cast("int")), F.lit(0).cast("bigint")), k % 64)
    kept = F.filter(lines, lambda x, k: bit(k).bitwiseAND(F.lit(1)) == 0)
    touched = F.col("_line_bits").isNotNull() & F.col("text").isNotNull()
    cut = both.select(
        *keep,
        F.when(touched, F.array_join(kept, "\n")).otherwise(F.col("text")).alias("text"), n_lines,
        F.when(touched, F.size(lines) - F.size(kept)).otherwise(0).cast("bigint").alias("n_removed"),
    )
    return cut.unionByName(others.select(*keep, "text", n_lines, F.lit(0).cast("bigint").alias("n_removed")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many of them repeat others, and a digest of the text that is left."""
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
