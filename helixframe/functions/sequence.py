"""Column functions on DNA strings. Only A, C, G and T count as bases; operators drop windows with anything else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def complement(seq: ColumnOrName) -> Column:
    return F.translate(_c(seq), "ACGT", "TGCA")


def revcomp(seq: ColumnOrName) -> Column:
    return F.reverse(complement(seq))


def canonical(seq: ColumnOrName) -> Column:
    """The smaller of both strands."""
    return F.least(_c(seq), revcomp(seq))


def is_high(kmer: ColumnOrName) -> Column:
    """Whether a k-mer is represented by its reverse complement; a palindrome is."""
    return revcomp(kmer) <= _c(kmer)


def oriented(vertex: ColumnOrName, high: ColumnOrName) -> Column:
    """The letters of a vertex read on a strand."""
    return F.when(_c(high), revcomp(vertex)).otherwise(_c(vertex))


def fragments(seq: ColumnOrName) -> Column:
    """Parts between Ns, empty ones too."""
    return F.split(_c(seq), "N")


def windows(seq: ColumnOrName, size: int) -> Column:
    """All substrings of that size, step one; none if the sequence is shorter."""
    n = F.length(_c(seq)) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(_c(seq), i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def is_homopolymer(seq: ColumnOrName) -> Column:
    return F.length(F.replace(_c(seq), F.substring(_c(seq), 1, 1), F.lit(""))) == 0


def pack(seq: ColumnOrName) -> Column:
    """Up to 31 bases as a long, two bits each: A 0, C 1, G 2, T 3."""
    return F.conv(F.translate(_c(seq), "ACGT", "0123"), 4, 10).cast("long")


def unpack(code: ColumnOrName, k: int) -> Column:
    return F.translate(F.lpad(F.conv(_c(code).cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def varints(numbers: ColumnOrName) -> Column:
    """An array of numbers from 0 as bytes: each in groups of seven bits, lowest first, the last of them with the high bit set."""

    def groups(n: Column) -> Column:
        last = F.floor((F.length(F.bin(n)) - 1) / 7).cast("int")
        byte = lambda i: F.call_function("shiftright", n.cast("long"), i * 7).bitwiseAND(F.lit(127)) + F.when(i == last, 128).otherwise(0)
        return F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.lpad(F.hex(byte(i)), 2, "0")), "")

    return F.unhex(F.array_join(F.transform(_c(numbers), groups), ""))


def from_varints(data: ColumnOrName) -> Column:
    """The numbers that varints() has written; bytes of a number without its last are left out."""
    text = F.hex(_c(data))
    count = (F.length(text) / 2).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(1), count)).when(count == 0, F.array().cast("array<int>"))
    start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("shift"))

    def step(acc: Column, i: Column) -> Column:
        byte = F.conv(F.substr(text, i * 2 - 1, F.lit(2)), 16, 10).cast("long")
        n = acc["n"] + F.call_function("shiftleft", byte.bitwiseAND(F.lit(127)), acc["shift"])
        more = F.struct(acc["out"].alias("out"), n.alias("n"), (acc["shift"] + 7).alias("shift"))
        ended = F.struct(F.concat(acc["out"], F.array(n)).alias("out"), F.lit(0).cast("long").alias("n"), F.lit(0).alias("shift"))
        return F.when(byte >= 128, ended).otherwise(more)

    return F.aggregate(places, start, step, lambda acc: acc["out"])


def edit_distance(a: ColumnOrName, b: ColumnOrName, most: int | None = None) -> Column:
    """Unit-cost edit distance; -1 beyond `most`."""
    return F.levenshtein(_c(a), _c(b)) if most is None else F.levenshtein(_c(a), _c(b), most)


def ordered_pair(a: ColumnOrName, b: ColumnOrName) -> tuple[Column, Column, Column]:
    """(smaller, larger, whether a came first strictly)."""
    return F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)), _c(a) < _c(b)
