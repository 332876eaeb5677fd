"""Expressions over nucleotide strings. Strings keep the order of 2-bit codes, since A < C < G < T."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements.
BASES, COMPLEMENT = "ACGTacgt", "TGCAtgca"
IUPAC, IUPAC_COMPLEMENT = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
MAX_K = 63


def rc(x: Column | str) -> Column:
    """Reverse complement of ACGTacgt; other characters stay, case is kept."""
    return F.reverse(F.translate(x, BASES, COMPLEMENT))


def rc_iupac(x: Column | str) -> Column:
    return F.reverse(F.translate(x, IUPAC, IUPAC_COMPLEMENT))


def canon(x: Column) -> Column:
    """The smaller of a word and its reverse complement."""
    return F.least(x, rc(x))


def is_reverse(x: Column) -> Column:
    """Whether the canonical form is the other strand; palindromes are forward."""
    return rc(x) < x


def oriented(seq: Column | str, is_rev: Column | str, skip: Column | None = None) -> Column:
    """The bases of a traversal, less ``skip`` at its start (clipped to the length)."""
    seq, is_rev = (F.col(c) if isinstance(c, str) else c for c in (seq, is_rev))
    turned = F.when(is_rev, rc(seq)).otherwise(seq)
    return turned if skip is None else F.substring(turned, F.least(skip, F.length(seq)).cast("int") + 1, F.length(seq))


def check_k(k: int) -> int:
    if not 1 <= k <= MAX_K:
        raise ValueError(f"k must be between 1 and {MAX_K}, not {k}")
    return k


def runs(text: Column | str) -> Column:
    """Gap-free runs of bases, upper-cased."""
    return F.regexp_extract_all(F.upper(text), F.lit("([ACGT]+)"), F.lit(1))


def windows(run: Column, w: int) -> Column:
    """All windows of ``w`` characters of a run, as an array; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(run) - (w - 1))
    return F.when(F.length(run) >= w, F.transform(starts, lambda i: F.substring(run, i, F.lit(w)))).otherwise(F.array().cast("array<string>"))


#: Windows that are cut from one piece of a text: a substring costs as many steps as it starts from the left.
PIECE = 128


def pieces(text: Column, w: int) -> Column:
    """A long text as pieces that overlap by ``w`` - 1, so that each window of ``w`` characters is in one of them."""
    count = F.floor((F.length(text) - w) / PIECE).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE + w - 1)))
    return F.when(F.length(text) >= w, cut).otherwise(F.array().cast("array<string>"))


def cigar_overlap(cigar: Column) -> Column:
    """Sum of the M counts; ``*`` is 0; null where the CIGAR is malformed or the sum leaves 32 bits."""
    total = F.aggregate(F.regexp_extract_all(cigar, F.lit(r"(\d+)M"), F.lit(1)), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x.cast("decimal(20,0)")).cast("decimal(38,0)"))
    valid = cigar.rlike(r"^([0-9]{1,18}[MIDNSHPX=])+$") & (total < F.lit(1 << 32))
    return F.when(cigar == "*", F.lit(0).cast("long")).when(valid, total.cast("long"))


def canonical_int(text: Column | str) -> Column:
    """The integer that a string without sign or leading zero (18 digits at most) stands for, else null."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(r"^(0|[1-9][0-9]{0,17})$"), text.cast("long"))


# Values of single k-mers, for callers outside a query.


def kmer_rc(word: str) -> str:
    return word.translate(str.maketrans(BASES, COMPLEMENT))[::-1]


def encode_kmer(word: str) -> int:
    """2-bit code, first base most significant; any other character counts as A."""
    code = 0
    for c in word.upper():
        code = code << 2 | max(0, "ACGT".find(c))
    return code


def decode_kmer(code: int, k: int) -> str:
    return "".join("ACGT"[code >> 2 * i & 3] for i in range(k - 1, -1, -1))


def canonical_kmer(word: str) -> tuple[str, bool]:
    """Canonical form and whether it is the other strand."""
    other = kmer_rc(word)
    return (other, True) if other < word else (word, False)


def roll_kmer(word: str, base: str) -> str:
    """The next k-mer: first base dropped, ``base`` appended."""
    return decode_kmer(encode_kmer(word[1:] + base), len(word))
