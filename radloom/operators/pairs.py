"""Paired and merged reads, barcodes of varying length, overhangs and haplotype counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from radloom.functions import dna


def mask_between(seq: Column, qual: Column, left: int, right: int = 0, least: int = 20, offset: int = 33) -> Column:
    """N for bases under quality ``least``, but for the first ``left`` and the last ``right``, which stay as read."""
    q = F.split(qual, "")
    inner = F.transform(F.split(seq, ""), lambda b, i: F.when((i < left) | (i >= F.length(seq) - right) | (F.ascii(F.get(q, i)) - offset >= least), b).otherwise("N"))
    return F.array_join(inner, "")


def concatenate(first: Column, second: Column, skip: int = 1) -> Column:
    """One sequence of both mates: the first without its last base, nnnn, and the second from ``skip`` on reversed."""
    return F.concat(F.substr(first, F.lit(1), F.greatest(F.length(first) - 1, F.lit(0))), F.lit("nnnn"), dna.revcomp(F.substr(second, F.lit(skip + 1))))


def barcode_before_cut(seq: Column, cut: str) -> Column:
    """What stands before the cut site; before the second one where there are more; null without any."""
    parts = F.split(seq, cut)
    return F.when(F.size(parts) == 2, parts[0]).when(F.size(parts) > 2, F.concat(parts[0], F.lit(cut), parts[1]))


def edit_pairs(mates: DataFrame, cut: str = "TGCAG", second: str = "", strict: int = 1, most_n: int = 4, trimkeep: int = 0, datatype: str = "pairddrad") -> DataFrame:
    """(read_id, kind, seq) of quality-masked mates (read_id, s1, s2): joined pairs, and what adapters leave of the others.

    ``pair``: first mate without its last base, nnnn, second mate reversed.
    ``trim1``: a trimmed first mate beside a placeholder; ``trim2``: for pairgbs
    the trimmed second mate too.  Mates of which the first has too many N or is
    short go; for pairgbs the second is cut to the first's length and counts too.
    """
    site2, skip = (dna.revcomp_text(second), 0) if second else (dna.revcomp_text(cut), 1)
    site1, least = dna.revcomp_text(cut), max(32, trimkeep)
    count_n = lambda c: F.length(c) - F.length(F.replace(c, F.lit("N"), F.lit("")))
    x = mates.where((count_n(F.col("s1")) <= most_n) & (F.length("s1") >= least)).select("read_id", "s1", F.substr("s2", F.lit(1), F.length("s1")).alias("s2") if datatype == "pairgbs" else F.col("s2"))
    if datatype == "pairgbs":
        x = x.where(count_n(F.col("s2")) <= most_n)
    x = x.withColumn("w1", dna.adapter_cut(F.col("s1"), site2, strict, 1) if strict else F.lit(None).cast("int")).withColumn("w2", dna.adapter_cut(F.col("s2"), site1, strict, 2) if strict else F.lit(None).cast("int"))
    at = F.when(F.col("w1").isNotNull() & F.col("w2").isNotNull(), F.least("w1", "w2")).otherwise(F.greatest("w1", "w2"))
    if strict:
        late = F.contains(F.right("s2", F.lit(16)), F.lit(site1)) | F.contains(F.right("s1", F.lit(10)), F.lit(site2))
        at = F.coalesce(at, F.nullif(F.when(late, F.length("s1") - 16), F.lit(0)))
    x = x.select("read_id", "s1", "s2", F.explode(F.array(at)).alias("at"))  # computed once a row
    both = F.concat(F.substr("s1", F.lit(1), F.length("s1") - 1), F.lit("nnnn"), dna.revcomp(F.substr("s2", F.lit(skip + 1))))
    row = lambda kind, seq: F.struct(F.lit(kind).alias("kind"), seq.alias("seq"))
    cut_off = [row("trim1", F.concat(dna.until(F.col("s1"), F.col("at")), F.lit("nnnnN")))]
    if datatype == "pairgbs":
        cut_off.append(row("trim2", F.concat(F.lit("Nnnnn"), dna.revcomp(F.substr("s2", F.lit(skip + 1), F.greatest(F.col("at") + 5 - skip, F.lit(0)))))))
    out = F.when(F.col("at").isNull(), F.array(row("pair", both))).when(F.col("at") > least, F.array(*cut_off))
    return x.select("read_id", F.explode(out).alias("o")).select("read_id", "o.kind", "o.seq")


def right_offset(merged: DataFrame, cut: str = "TGCAG", second: str = "") -> DataFrame:
    """One row: extra bases behind the second cut site that correctly merged reads mostly have, the fewest of equally common; 0 where there are over 3 or no such reads."""
    site = dna.revcomp_text(second or cut)
    good = merged.where(F.startswith("seq", F.lit(cut)) & F.contains(F.right("seq", F.lit(len(site) + 2)), F.lit(site)))
    extra = good.select((F.length("seq") - (dna.last_at(F.col("seq"), site) - 1) - len(site)).alias("extra")).groupBy("extra").agg(F.count("*").alias("n"))
    best = extra.agg(F.min(F.struct((-F.col("n")).alias("m"), "extra"))["extra"].alias("e"))
    return best.select(F.when(F.col("e") > 3, 0).otherwise(F.coalesce("e", F.lit(0))).cast("int").alias("offset"))


def trim_merged(merged: DataFrame, offset: int, cut: str = "TGCAG", second: str = "", most_n: int = 4, trimkeep: int = 0) -> DataFrame:
    """(read_id, seq) of masked merged reads (read_id, seq) between their cut sites; ``offset`` is the value of ``right_offset``.

    Right end: the offset where both sites stand at the ends; else the second
    site in the right half, a read's adapter core, its reverse, or the offset.
    Left end: the first site; reads without it go, as do those left too short.
    """
    other = second or cut
    site = dna.revcomp_text(other)
    count_n = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    x = merged.where(count_n <= most_n)
    seq, n = F.col("seq"), F.length("seq")
    last = lambda p: dna.last_at(seq, p) - 1
    whole = F.startswith(seq, F.lit(cut)) & F.contains(F.right(seq, F.lit(len(site) + 2)), F.lit(site))
    right = F.when(whole, n - offset).when(F.contains(F.substr(seq, F.floor(n / 2).cast("int") + 1), F.lit(site)), last(site) + len(site))
    right = right.when(last("AGATCG") >= 0, last("AGATCG") - len(other)).when(last("TCGGAAG") >= 0, last("TCGGAAG") - len(other) - 3).otherwise(n - offset)
    left = F.when(whole, 0).when(F.instr(seq, cut) > 0, F.instr(seq, cut) - 1)
    x = x.withColumn("l", left).where("l is not null").select("read_id", "seq", "l", F.explode(F.array(right)).alias("r"))  # computed once a row
    x = x.withColumn("r", F.greatest(F.when(F.col("r") < 0, n + F.col("r")).otherwise(F.col("r")), F.lit(0)))
    x = x.select("read_id", F.substr(seq, F.col("l") + 1, F.greatest(F.col("r") - F.col("l"), F.lit(0))).alias("seq"))
    return x.where((F.length("seq") > trimkeep) & (F.length("seq") >= max(36, trimkeep)))


def barcode_within(seq: Column, cut: str, longest: int) -> Column:
    """As ``barcode_before_cut``, but sites count only where the longest barcode lets them begin; '' for none or over two of them."""
    near = F.left(seq, F.lit(longest + len(cut)))
    n = F.floor((F.length(near) - F.length(F.replace(near, F.lit(cut), F.lit("")))) / len(cut))
    parts = F.split(seq, cut)
    return F.when(n == 1, parts[0]).when(n == 2, F.concat(parts[0], F.lit(cut), parts[1])).otherwise("")


def code_at_end(seq: Column, length: int, suffix: bool = False) -> Column:
    """Barcode of fixed length at the start of a read, or at its end."""
    return F.right(seq, F.lit(length)) if suffix else F.left(seq, F.lit(length))


def overhang(sites: DataFrame, least: int) -> DataFrame:
    """(xlocus, first, last): the outermost columns in which ``least`` taxa have a base; loci without such go."""
    cover = sites.groupBy("xlocus", "pos").agg(F.count_if(~F.col("base").isin("N", "-")).alias("c")).where(F.col("c") >= least)
    return cover.groupBy("xlocus").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))


def haplotype_rejects(derep: DataFrame, calls: DataFrame, ploidy: int = 2, share: float = 0.25) -> DataFrame:
    """(sample_id, locus_id, haplotypes, rejected) of loci with heterozygous calls.

    Haplotypes are the reads' bases at those sites; those with ``share`` of the
    locus's reads or less are no haplotypes, and more than ``ploidy`` reject it.
    Reads are counted by sequence before the join.
    """
    het = calls.where(F.col("call").isin(*dna.CODES)).groupBy("sample_id", "locus_id").agg(F.sort_array(F.collect_list("pos")).alias("at"))
    rows = derep.join(het, ["sample_id", "locus_id"]).select("sample_id", "locus_id", F.array_join(F.transform("at", lambda p: F.substr(F.col("seq"), p, F.lit(1))), "").alias("hap"), "n")
    haps = rows.groupBy("sample_id", "locus_id", "hap").agg(F.sum("n").alias("n"))
    per = haps.groupBy("sample_id", "locus_id").agg(F.collect_list("n").alias("ns"), F.sum("n").alias("total"))
    many = F.size(F.filter("ns", lambda n: n > F.col("total") * share)).cast("long")
    return per.select("sample_id", "locus_id", many.alias("haplotypes"), (many > ploidy).alias("rejected"))


def merge_pairs(mates: DataFrame, most_diffs: int = 6, truncate: int = 2, least: int = 36, least_merged: int = 50, overlap: int = 16, offset: int = 33) -> DataFrame:
    """(read_id, shift, diffs, seq, qual) of mates (read_id, s1, q1, s2, q2) that overlap: one read of both.

    Mates end before their first base of quality ``truncate`` or less and go
    when shorter than ``least``.  The second one is turned; ``shift`` is where
    it begins on the first, negative where the insert is shorter than the mates,
    whose ends beyond it are then cut off.  Of all shifts with ``overlap`` bases
    in common and ``most_diffs`` differences the one with the greatest sum of
    lesser qualities (plus one) of equal bases less that of different ones is
    taken, ties to the smaller shift.  Of two bases the one of higher quality
    counts, the first mate's if equal; its quality is the higher one, or the
    difference where they differ.
    """
    low = "[" + "".join("\\" + chr(c) if chr(c) in "\\]^-[" else chr(c) for c in range(33, offset + truncate + 1)) + "]"
    cut = lambda c, q: F.when(F.regexp_instr(q, F.lit(low)) > 0, F.substr(c, F.lit(1), F.regexp_instr(q, F.lit(low)) - 1)).otherwise(c)
    x = mates.select("read_id", cut(F.col("s1"), F.col("q1")).alias("a"), cut(F.col("q1"), F.col("q1")).alias("qa"), dna.revcomp(cut(F.col("s2"), F.col("q2"))).alias("b"), F.reverse(cut(F.col("q2"), F.col("q2"))).alias("qb"))
    x = x.where((F.length("a") >= least) & (F.length("b") >= least))
    # a base and its quality in one number; both computed once a row
    coded = lambda c, q: F.zip_with(F.split(c, ""), F.split(q, ""), lambda base, v: (F.ascii(v) - offset) * 128 + F.ascii(base))
    x = x.select("*", F.explode(F.array(F.struct(coded(F.col("a"), F.col("qa")).alias("a"), coded(F.col("b"), F.col("qb")).alias("b")))).alias("w"), F.length("a").alias("n"), F.length("b").alias("m"))
    wa, wb, n, m = F.col("w.a"), F.col("w.b"), F.col("n"), F.col("m")
    begin, common = (lambda o: F.greatest(o, F.lit(0))), (lambda o: F.least(n, o + m) - F.greatest(o, F.lit(0)))
    both = lambda o, f: F.zip_with(F.slice(wa, begin(o) + 1, common(o)), F.slice(wb, begin(-o) + 1, common(o)), f)
    q, base = (lambda v: F.floor(v / 128).cast("int")), (lambda v: v % 128)
    weight = lambda p, r: F.when(base(p) == base(r), 1).otherwise(-1) * (1 + F.least(q(p), q(r)))

    def judged(o):
        w = both(o, weight)
        return F.struct(F.size(F.filter(w, lambda v: v < 0)).alias("diffs"), F.aggregate(w, F.lit(0), lambda s, v: s + v).alias("score"), (-o).alias("back"))

    shifts = F.sequence(overlap - m, n - overlap)
    good = F.filter(F.transform(shifts, judged), lambda j: j["diffs"] <= most_diffs)
    best = F.array_max(F.transform(good, lambda j: F.struct(j["score"], j["back"], j["diffs"])))
    x = x.select("*", F.explode(F.array(best)).alias("best")).where("best is not null").withColumn("shift", -F.col("best.back"))
    o = F.col("shift")
    pick = lambda p, r: F.when(base(p) == base(r), F.greatest(q(p), q(r)) * 128 + base(p)).when(q(p) >= q(r), (q(p) - q(r)) * 128 + base(p)).otherwise((q(r) - q(p)) * 128 + base(r))
    x = x.select("read_id", "shift", F.col("best.diffs").alias("diffs"), F.explode(F.array(F.concat(F.slice(wa, F.lit(1), begin(o)), both(o, pick), F.slice(wb, F.least(n - o, m) + 1, F.greatest(o + m - n, F.lit(0)))))).alias("w"))
    text = lambda f: F.array_join(F.transform("w", lambda v: F.char(f(v))), "")
    return x.where(F.size("w") >= least_merged).select("read_id", "shift", "diffs", text(base).alias("seq"), text(lambda v: q(v) + offset).alias("qual"))


def unmerged(mates: DataFrame, merged: DataFrame) -> DataFrame:
    """Mates that found no partner in ``merged``, as they were."""
    return mates.join(merged.select("read_id"), "read_id", "left_anti")
