"""Order MinHash fingerprints: sensitive to edit distance, as built-in functions only.

A text is cut at blanks and line ends into words, and words of more than ``PIECE`` characters into pieces of that
length, so that a text without blanks has members too (the later pieces of a word bear a mark). A start and an end
mark are put around them, and every ``k`` neighbours form a k-mer. K-mers that repeat are numbered by occurrence, so a text is a set of
(k-mer, number). For each of ``m`` orders of that set, the ``l`` least members are taken, put back into
their order in the text and hashed as a tuple; the signature is the ``m`` hashes. Two texts agree in one
of them about as often as the ``l`` least members of both together are shared and stand in the same
order, which falls with every edit and with every move.

The orders are rotations of one hash order: order i begins at the i-th of ``m`` evenly spaced points of
the hash circle. So one sort serves all of them: hash and position share a long, the points are sorted in
between, and the members behind each point are its least ones. Numbering and sorting stay inside the row;
nothing is shuffled to make a signature. A text with less than ``l`` members uses what it has.

Very long texts are fingerprinted whole; what they need grows with their members. Where something is put into or
taken out of a word of several pieces, its later pieces change too. A null text is empty; an empty text has the two marks alone. Equal texts have equal signatures. An empty
table gives an empty table, and columns named like the result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metriloom.llm.frames import whole_text

GRAM = 2
PIECE = 16
LEAST = 2
ORDERS = 64
#: the low bits of a long hold the position of a k-mer, the others its hash
POSITION_BITS = 30
LOW = (1 << POSITION_BITS) - 1


def members(text: Column, k: int = GRAM) -> Column:
    """Sorted longs, hash above position, of all occurrence-numbered k-mers of a text."""
    cut = F.regexp_replace(text, f"([^ \\n]{{{PIECE}}})(?=[^ \\n])", "$1 \x01")
    words = F.concat(F.array(F.lit("\x02")), F.split(F.replace(cut, F.lit("\n"), F.lit(" ")), " "), F.array(F.lit("\x03")))

    def of(w: Column) -> Column:
        high = F.lit(~LOW)
        grams = F.transform(
            F.sequence(F.lit(1), F.size(w) - (k - 1)),
            lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(k)]).bitwiseAND(high).bitwiseOR(i.cast("long")),
        )
        return F.sort_array(grams)

    return _with(_with(words, of), _numbered)


def _with(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _numbered(ordered: Column) -> Column:
    """Later occurrences of a k-mer get hashes of their own: with their number, by runs of equal hashes."""
    high = F.lit(~LOW)
    kinds = F.size(F.array_distinct(F.transform(ordered, lambda v: v.bitwiseAND(high))))

    def renumber(starts: Column) -> Column:
        """``starts``: first place (from 1) of each run."""
        runs = F.transform(
            starts,
            lambda s, r: F.transform(
                F.sequence(s, F.coalesce(F.get(starts, r + 1), F.size(ordered) + 1) - 1),
                lambda p: F.when(p == s, F.element_at(ordered, p)).otherwise(
                    F.xxhash64(F.element_at(ordered, p).bitwiseAND(high), p - s)
                    .bitwiseAND(high)
                    .bitwiseOR(F.element_at(ordered, p).bitwiseAND(F.lit(LOW)))
                ),
            ),
        )
        return F.sort_array(F.flatten(runs))

    places = F.sequence(F.lit(1), F.size(ordered))
    starts = F.filter(places, lambda p: (p == 1) | (F.element_at(ordered, p).bitwiseAND(high) != F.element_at(ordered, F.greatest(p - 1, F.lit(1))).bitwiseAND(high)))
    return F.when(kinds == F.size(ordered), ordered).otherwise(_with(starts, renumber))


def signature(text: Column, k: int = GRAM, least: int = LEAST, orders: int = ORDERS) -> Column:
    """``orders`` hashes of 32 bits."""
    step = (1 << 64) // orders
    points = F.array(*[F.lit(((i * step) & ~LOW) - (1 << 63)) for i in range(orders)])

    def pick(both: Column) -> Column:
        ordered, mixed = both["ordered"], both["mixed"]
        # a point has position 0, members count from 1; points before a member do not count for its place
        at = F.filter(F.sequence(F.lit(0), F.size(mixed) - 1), lambda p: F.get(mixed, p).bitwiseAND(F.lit(LOW)) == 0)
        n = F.size(ordered)

        def one(p: Column, i: Column) -> Column:
            chosen = [F.get(ordered, F.pmod(p - i + j, n)) for j in range(least)]
            by_place = F.array_sort(
                F.array(*[F.struct(c.bitwiseAND(F.lit(LOW)).alias("place"), F.shiftright(c, POSITION_BITS).alias("hash")) for c in chosen])
            )
            hashed = F.xxhash64(*[F.element_at(by_place, j + 1)["hash"] for j in range(least)])
            return F.shiftrightunsigned(hashed, 32)

        return F.transform(at, one)

    return _with(
        members(text, k),
        lambda v: _with(F.struct(v.alias("ordered"), F.sort_array(F.concat(v, points)).alias("mixed")), pick),
    )


def likeness(a: str | Column, b: str | Column) -> Column:
    """Share of equal hashes of two signatures, 0 to 1."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)).cast("double") / F.size(a)


def as_text(sig: str | Column) -> Column:
    """A signature as hexadecimal text, 8 digits for each hash."""
    sig = F.col(sig) if isinstance(sig, str) else sig
    return F.lower(F.array_join(F.transform(sig, lambda h: F.lpad(F.hex(h), 8, "0")), ""))


def fingerprints(df: DataFrame, text: str = "text", out: str = "signature", **parameters) -> DataFrame:
    """Append the signature of each whole text."""
    base = df.drop(out)
    return base.withColumn(out, signature(whole_text(text), **parameters))


def seated(df: DataFrame, order: str, partitions: int | None = None) -> DataFrame:
    """Rows dealt to buckets by ``order``, so that each row's next by descending order shares its bucket.

    Buckets lie between ``partitions`` quantiles of ``order``. The row that stands at a bound also visits
    the bucket above it as a guest (``_guest`` 1), and the highest row visits the lowest bucket (2), as it
    follows the last row. So one shuffle, by ``_bucket``, finds every neighbour with ``next_window``.
    Null orders come last; equal orders follow each other.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(order).cast("long"), F.lit(-(1 << 63)))
    shares = F.array(*[F.lit(i / n) for i in range(1, n)] or [F.lit(0.5)])
    found = df.agg(F.percentile_approx(key, shares, F.lit(20 * n)).alias("q"), F.max(key).alias("top")).first()
    bounds = sorted(set(found["q"] or []) - {found["top"]})
    # bucket b holds orders above bounds[b - 1] and up to bounds[b]; bounds are searched in groups
    width = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    group = F.size(F.filter(_longs([g[-1] for g in groups]), lambda v: v < F.col("_key")))
    inside = F.size(F.filter(F.get(F.array(*map(_longs, groups)), group), lambda v: v < F.col("_key")))
    home = F.when(group < len(groups), group * width + inside).otherwise(len(bounds)) if bounds else F.lit(0)
    rows = df.withColumn("_key", key).withColumn("_home", home.cast("int"))
    at_bound = F.col("_key") == F.get(_longs(bounds), F.col("_home"))
    seats = F.array(
        F.struct(F.col("_home").alias("bucket"), F.lit(0).alias("guest")),
        F.when(at_bound, F.struct((F.col("_home") + 1).alias("bucket"), F.lit(1).alias("guest"))),
        F.when(F.col("_key") == F.lit(found["top"]), F.struct(F.lit(0).alias("bucket"), F.lit(2).alias("guest"))),
    )
    tie = F.xxhash64(*[c for c, kind in df.dtypes if "map" not in kind])
    placed = rows.withColumn("_seat", F.explode(F.filter(seats, lambda s: s.isNotNull())))
    return placed.select(*df.columns, "_key", F.col("_seat.bucket").alias("_bucket"), F.col("_seat.guest").alias("_guest"), tie.alias("_tie"))


def _longs(values: list[int]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<bigint>")


def next_window() -> Window:
    return Window.partitionBy("_bucket").orderBy("_guest", F.desc("_key"), "_tie")


def edited_neighbours(df: DataFrame, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None, **parameters) -> DataFrame:
    """Per row: its signature, that of its edited text, and the likeness to that and to the next row's.

    The edited text has its last third replaced by the beginning of the next row's text, by descending id.
    """
    rows = df.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    w = next_window()
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("_next_text"), F.lit(1), third))
    paired = seated(rows, "doc_id", partitions).withColumn("_next_text", F.lead("text").over(w)).withColumn("_edited", F.coalesce(edited, F.col("text")))
    signed = paired.select(
        "doc_id",
        n.cast("bigint").alias("n_chars"),
        F.sha2("_edited", 256).alias("edited_sha256"),
        signature(F.col("text"), **parameters).alias("signature"),
        signature(F.col("_edited"), **parameters).alias("edited_signature"),
        "_bucket",
        "_guest",
        "_key",
        "_tie",
    )
    return signed.withColumn("_next", F.lead("signature").over(w)).where("_guest = 0").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "signature",
        "edited_signature",
        likeness("signature", "edited_signature").alias("near_edited"),
        likeness("signature", "_next").alias("near_next"),
    )
