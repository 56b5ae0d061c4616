"""Column functions on nucleotide strings: complements, codes, haplotypes, masks, searches."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-base codes and the bases they stand for, upper case for unphased or first-haplotype order.
CODES = "RKSYWM"
PAIRS = {"R": "GA", "K": "GT", "S": "GC", "Y": "TC", "W": "TA", "M": "CA"}
#: Codes with the first and the second haplotype of each; lower case swaps them.
HAP1 = ("RKSYWMrksywm", "GGGTTCATCCAA")
HAP2 = ("RKSYWMrksywm", "ATCCAAGGGTTC")


def revcomp(seq: Column) -> Column:
    """Reverse complement; other symbols stay."""
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def revcomp_text(seq: str) -> str:
    """Reverse complement of a constant, two-base codes included."""
    return seq.translate(str.maketrans("ACGTRYKM", "TGCAYRMK"))[::-1]


def revcomp_coded(seq: Column) -> Column:
    """Reverse complement of consensus text: codes and phase case kept."""
    return F.reverse(F.translate(seq, "ACGTRYKMrykm", "TGCAYRMKyrmk"))


def haplotype(seq: Column, which: int) -> Column:
    """First or second haplotype of a consensus."""
    return F.translate(seq, *(HAP1 if which == 1 else HAP2))


def code_of(a: Column, b: Column) -> Column:
    """The base itself, or the two-base code of two bases."""
    lookup = F.create_map(*[F.lit(x) for c, (p, q) in PAIRS.items() for x in (p + q, c)])
    return F.when(a == b, a).otherwise(F.coalesce(F.try_element_at(lookup, F.concat(a, b)), F.try_element_at(lookup, F.concat(b, a))))


def quality_mask(seq: Column, qual: Column, cut: str, least: int = 20, offset: int = 33) -> Column:
    """``cut`` over the first bases, then each base whose quality reaches ``least``, N otherwise."""
    n = len(cut)
    masked = F.zip_with(F.split(F.substring(seq, n + 1, 1 << 30), ""), F.split(F.substring(qual, n + 1, 1 << 30), ""), lambda s, q: F.when(F.ascii(q) - offset >= least, s).otherwise("N"))
    return F.concat(F.lit(cut), F.array_join(masked, ""))


def last_at(seq: Column, pattern: str) -> Column:
    """1-based start of the last occurrence of ``pattern``; 0 if none."""
    found = F.instr(F.reverse(seq), pattern[::-1])
    return F.when(found > 0, F.length(seq) - found - len(pattern) + 2).otherwise(0)


def resolutions(cut: str) -> list[str]:
    """A cut site as plain bases: itself, or both readings of its two-base code."""
    return [cut.replace(code, base) for code, pair in PAIRS.items() if code in cut for base in pair] or [cut]


def adapter_cut(seq: Column, cut: str, strict: int = 1, mate: int = 0) -> Column:
    """Where to cut before an adapter, from 0 and null for none; below 0 it counts from the end, as ``until`` reads it.

    The last cut site followed by the adapter's first bases decides, of both
    readings of a coded site the left one; then the last adapter core less the
    cut site and a base; then a cut site in the last bases.  A hit at the very
    start counts as none.  ``mate`` is 0 for single reads; mates of a pair look
    for one base more beside coded sites (1) and for a run of A (2).
    """
    sites = resolutions(cut)
    if mate == 2:
        looked = sites if strict == 2 else ["A" * 50]
    else:
        looked = [x + ("A" if strict == 2 else "AGAT" if mate and len(sites) > 1 else "AGA") for x in sites]
    found = [F.when(last_at(seq, x) > 1, last_at(seq, x) - 1) for x in looked]
    core = last_at(seq, "AGATCG" if strict == 2 else "AGATCGGA")
    back = len(cut) + (6 if mate == 2 else 1)
    end = F.when(F.contains(F.right(seq, F.lit(len(cut) + 5)), F.lit(cut)) & (last_at(seq, cut) > 1), last_at(seq, cut) - 1)
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.when((core > 0) & (core - 1 != back), core - 1 - back), end)


def until(seq: Column, at: Column) -> Column:
    """``seq`` up to a place from 0; below 0 from the end; whole where it is null."""
    return F.when(at.isNull(), seq).otherwise(F.substr(seq, F.lit(1), F.greatest(F.when(at < 0, F.length(seq) + at).otherwise(at), F.lit(0))))


def hamming(a: Column, b: Column) -> Column:
    """Positions at which two strings of one length differ; null for different lengths."""
    diff = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) == F.length(b), diff)


def trim_ends(seq: Column) -> Column:
    """Consensus without N at its ends."""
    return F.trim(seq, F.lit("N"))


def first_base(seq: Column) -> Column:
    """Place of the leftmost base from 0; the length where there are only gaps."""
    return F.length(seq) - F.length(F.ltrim(seq, F.lit("-")))


def last_base(seq: Column) -> Column:
    """Place behind the rightmost base; 1 where there are only gaps."""
    return F.greatest(F.length(F.rtrim(seq, F.lit("-"))), F.lit(1))


def first_mate(seq: Column) -> Column:
    """What stands before the separator of mates."""
    return F.split_part(seq, F.lit("nn"), F.lit(1))


def without_site(seq: Column, cut: str, second: str = "") -> Column:
    """``seq`` without the cut site it begins with and, for merged reads, the one it ends with."""
    return F.substr(seq, F.lit(len(cut) + 1), F.greatest(F.length(seq) - len(cut) - len(second), F.lit(0)))


def sample_name(file: Column) -> Column:
    """Name of a sample from its file: folders, suffixes of FASTQ files and mate marks go."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(file, r"^.*/", ""), r"(?i)(\.(fastq|fq|gz))+$", ""), r"_R[12](?=_|\.|$)", "")


def drop_repeat_n(seq: Column) -> Column:
    """Without each N whose three neighbours on one side are alike; next to an end, where they are fewer, it goes too."""
    a = F.split(seq, "")
    alike = lambda start: F.size(F.array_distinct(F.slice(a, start, F.lit(3)))) < 2
    return F.array_join(F.filter(a, lambda b, i: (b != "N") | ~((i < 3) | alike(F.greatest(i - 2, F.lit(1))) | alike(i + 2))), "")
