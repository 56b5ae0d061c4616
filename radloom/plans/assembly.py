"""Queries of adapters, pairs, merged reads, hits and likelihood inputs, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import clusters, genotypes, loci, pairs, reads as rd
from radloom.plans import fixtures as fx
from radloom.plans.queries import NEEDS, PARTS, _locus_derep, query


def _last(x: str, p: str) -> str:
    """SQL: place from 0 of the last ``p`` in ``x``; -1 if none."""
    return f"(case when contains({x}, '{p}') then length({x}) - length('{p}') - instr(reverse({x}), reverse('{p}')) + 1 else -1 end)"


def _adapter(x: str, sites: list[str], cut: str, core: str, back: int) -> str:
    """SQL: place before the adapter, by the three rules in their order."""
    first = ", ".join(f"nullif(nullif({_last(x, s)}, -1), 0)" for s in sites)
    middle = f"case when contains({x}, '{core}') then nullif({_last(x, core)} - {back}, 0) end"
    end = f"case when contains(right({x}, {len(cut) + 5}), '{cut}') then nullif({_last(x, cut)}, 0) end"
    return f"coalesce(list_min([{first}]), {middle}, {end})"


def _until(x: str, w: str) -> str:
    return f"(case when {w} is null then {x} when {w} < 0 then substr({x}, 1, greatest(length({x}) + {w}, 0)) else substr({x}, 1, {w}) end)"


# Reads with adapters planted, 40 bases and more, and their mates.
_TAILS = ("CTGCAAGATT", "AGATCGGAAG", "CTGCAT", "", "", "CTGCAATTTT", "TTCAGCAAGA", "", "ACGT")
_HEADS = {3: "AGATCGGA", 4: "CTGCAAGA"}
_TAILS2 = ("", "A" * 50, "CTGCAGGTT", "AGATCGGAAGAGC", "CTGCA", "", "")
_cases = lambda of, values: "case " + " ".join(f"when {of} = {k} then '{v}'" for k, v in values if v) + " else '' end"
_PLANTED = {
    "s1": f"concat({_cases('read_id % 9', _HEADS.items())}, 'TGCAG', substr(seq, 6), substr(reverse(seq), 1, 8), {_cases('read_id % 9', enumerate(_TAILS))})",
    "s2": f"concat(reverse(seq), substr(seq, 1, 8), {_cases('read_id % 7', enumerate(_TAILS2))})",
}
PARTS["mates"] = "select read_id, sample_id, " + ", ".join(f"{e} as {c}" for c, e in _PLANTED.items()) + " from reads"
NEEDS["mates"] = ["reads"]


def _mates(s, d):
    planted = ", ".join(f"{e} as {c}" for c, e in _PLANTED.items())  # exploded, so that the planner copies them nowhere
    return fx.reads(s, d).selectExpr("read_id", "sample_id", f"inline(array(struct({planted})))")


def _shown(c):
    """A cut with -1000 for none."""
    return F.coalesce(c, F.lit(-1000)).alias(c)


_one = _adapter("s1", ["CTGCAAGA"], "CTGCA", "AGATCGGA", 6)
_cuts = {"strict1": _one, "strict2": _adapter("s1", ["CTGCAA"], "CTGCA", "AGATCG", 6), "coded": _adapter("s1", ["CTGCAAGA", "CAGCAAGA"], "CWGCA", "AGATCGGA", 6)}
query("adapter_trim", "select read_id, " + ", ".join(f"coalesce({e}, -1000)::int as {c}" for c, e in _cuts.items()) + f", {_until('s1', f'({_one})')} as kept from mates", "mates")(
    lambda s, d: _mates(s, d).select("read_id", "s1", dna.adapter_cut(F.col("s1"), "CTGCA").alias("strict1"), dna.adapter_cut(F.col("s1"), "CTGCA", 2).alias("strict2"), dna.adapter_cut(F.col("s1"), "CWGCA").alias("coded")).select("read_id", *[_shown(c) for c in ("strict1", "strict2", "coded")], dna.until(F.col("s1"), F.col("strict1")).alias("kept"))
)
_A50 = "A" * 50
_pair_cuts = {
    "first1": _adapter("s1", ["CTGCAAGA"], "CTGCA", "AGATCGGA", 6),
    "first2": _adapter("s1", ["CTGCAA"], "CTGCA", "AGATCG", 6),
    "first_coded": _adapter("s1", ["CTGCAAGAT", "CAGCAAGAT"], "CWGCA", "AGATCGGA", 6),
    "second1": _adapter("s2", [_A50], "CTGCA", "AGATCGGA", 11),
    "second2": _adapter("s2", ["CTGCA"], "CTGCA", "AGATCG", 11),
    "second_coded": _adapter("s2", ["CTGCA", "CAGCA"], "CWGCA", "AGATCG", 11),
}
query("adapter_trim_pair", "select read_id, " + ", ".join(f"coalesce({e}, -1000)::int as {c}" for c, e in _pair_cuts.items()) + " from mates", "mates")(
    lambda s, d: _mates(s, d).select(
        "read_id", dna.adapter_cut(F.col("s1"), "CTGCA", 1, 1).alias("first1"), dna.adapter_cut(F.col("s1"), "CTGCA", 2, 1).alias("first2"), dna.adapter_cut(F.col("s1"), "CWGCA", 1, 1).alias("first_coded"),
        dna.adapter_cut(F.col("s2"), "CTGCA", 1, 2).alias("second1"), dna.adapter_cut(F.col("s2"), "CTGCA", 2, 2).alias("second2"), dna.adapter_cut(F.col("s2"), "CWGCA", 2, 2).alias("second_coded"),
    ).select("read_id", *[_shown(c) for c in _pair_cuts])
)


def _pair_sql(first: str, second: str, cut2: str, s2: str, skip: int, gbs: bool) -> str:
    rc = lambda x: f"reverse(translate({x}, 'ACGT', 'TGCA'))"
    late = f"case when contains(right(s2, 16), 'CTGCA') or contains(right(s1, 10), '{cut2}') then nullif(length(s1) - 16, 0) end"
    decided = f"select read_id, s1, s2, coalesce(case when w1 is not null and w2 is not null then least(w1, w2) else coalesce(w1, w2) end, {late}) as w from (select read_id, s1, s2, {first} as w1, {second} as w2 from (select read_id, s1, {s2} as s2 from mates) where length(s1) >= 32)"
    out = f"select read_id, 'pair' as kind, substr(s1, 1, length(s1) - 1) || 'nnnn' || {rc(f'substr(s2, {skip + 1})')} as seq from t where w is null union all select read_id, 'trim1', substr(s1, 1, w) || 'nnnnN' from t where w > 32"
    if gbs:
        out += f" union all select read_id, 'trim2', 'Nnnnn' || {rc(f'substr(s2, {skip + 1}, w + 5 - {skip})')} from t where w > 32"
    return f"select * from (with t as ({decided}) {out})"


query("pair_edit", _pair_sql(_adapter("s1", ["AATTAGA"], "AATT", "AGATCGGA", 5), _adapter("s2", [_A50], "CTGCA", "AGATCGGA", 11), "AATT", "s2", 0, False), "mates")(lambda s, d: pairs.edit_pairs(_mates(s, d), second="AATT"))
query("pair_edit_gbs", _pair_sql(_adapter("s1", ["CTGCAA"], "CTGCA", "AGATCG", 6), _adapter("s2", ["CTGCA"], "CTGCA", "AGATCG", 11), "CTGCA", "substr(s2, 1, length(s1))", 1, True), "mates")(lambda s, d: pairs.edit_pairs(_mates(s, d), strict=2, datatype="pairgbs"))

# Merged reads: the second site at or near the end, adapters behind it, bases before the first.
_ENDS = ("CTGCA", "CTGCAG", "CTGCAGG", "AGATCGG", "TCGGAAGA", "AACTGCATTTTTTTT", "GGGG", "CTGCAG")
_MERGED = f"concat(case when read_id % 5 = 0 then 'CC' else '' end, 'TGCAG', substr(seq, 6), {_cases('read_id % 8', enumerate(_ENDS))}, case when read_id % 11 = 0 then 'NNNNN' else '' end)"
PARTS["merged"] = f"select read_id, {_MERGED} as seq from reads"
NEEDS["merged"] = ["reads"]
_good = "starts_with(seq, 'TGCAG') and contains(right(seq, 7), 'CTGCA')"
PARTS["moved"] = f"select coalesce(any_value(case when extra > 3 then 0 else extra end), 0)::int as \"offset\" from (select length(seq) - {_last('seq', 'CTGCA')} - 5 as extra from merged where {_good} group by 1 order by count(*) desc, 1 limit 1)"
NEEDS["moved"] = ["merged"]


def _merged(s, d):
    return fx.reads(s, d).selectExpr("read_id", f"explode(array({_MERGED})) as seq")


query("merged_offset", 'select "offset" from moved', "moved")(lambda s, d: pairs.right_offset(_merged(s, d)))
_right = f"case when {_good} then n - o when contains(substr(seq, n // 2 + 1), 'CTGCA') then {_last('seq', 'CTGCA')} + 5 when contains(seq, 'AGATCG') then {_last('seq', 'AGATCG')} - 5 when contains(seq, 'TCGGAAG') then {_last('seq', 'TCGGAAG')} - 8 else n - o end"
_left = f"case when {_good} then 0 when contains(seq, 'TGCAG') then instr(seq, 'TGCAG') - 1 end"
query("merged_trim", f"select read_id, substr(seq, l + 1, greatest(case when r < 0 then n + r else r end - l, 0)) as seq from (select read_id, seq, n, {_left} as l, {_right} as r from (select *, length(seq) as n, (select \"offset\" from moved) as o from merged where length(seq) - length(replace(seq, 'N', '')) <= 4)) where l is not null and greatest(case when r < 0 then n + r else r end - l, 0) >= 36", "moved")(
    lambda s, d: pairs.trim_merged(_merged(s, d), pairs.right_offset(_merged(s, d)).first()["offset"])
)

# Single reads as edited: masked, trimmed, filtered; trimmed ones are kept from a length on.
_masked = "'TGCAG' || substr(s1, 6)"
PARTS["edited"] = f"select read_id, sample_id, case when w is null then 'r1' else 'c1' end as kind, {_until('x', 'w')} as seq from (select *, {_adapter('x', ['CTGCAAGA'], 'CTGCA', 'AGATCGGA', 6)} as w from (select read_id, sample_id, {_masked} as x from mates))"
NEEDS["edited"] = ["mates"]
query("edit_single", "select * from edited where length(seq) >= 36", "edited")(lambda s, d: rd.edit_single(_mates(s, d).withColumnRenamed("s1", "seq"), trimkeep=36))
query("edit_counts", "select sample_id, count(*) as nreads, count(*) filter (length(seq) >= 36 and kind = 'r1') as passed, count(*) filter (length(seq) >= 36 and kind = 'c1') as trimmed, count(*) filter (length(seq) >= 36) as total from edited group by 1", "edited")(lambda s, d: rd.edit_counts(_mates(s, d).withColumnRenamed("s1", "seq"), trimkeep=36))

query("barcode_fixed", "select read_id, left(s1, 6) as before, right(s1, 6) as behind from mates", "mates")(lambda s, d: _mates(s, d).select("read_id", pairs.code_at_end(F.col("s1"), 6).alias("before"), pairs.code_at_end(F.col("s1"), 6, True).alias("behind")))
_b = f"concat({fx.OBSERVED}, case when read_id % 5 = 0 then '' else 'TGCAG' end, case when read_id % 7 = 0 then 'TGCAG' else '' end, seq)"
query("barcode_window", f"select read_id, case (11 - length(replace(left(x, 11), 'TGCAG', ''))) // 5 when 1 then string_split(x, 'TGCAG')[1] when 2 then string_split(x, 'TGCAG')[1] || 'TGCAG' || string_split(x, 'TGCAG')[2] else '' end as barcode from (select read_id, {_b} as x from reads)", "reads")(
    lambda s, d: fx.reads(s, d).select("read_id", F.expr(_b).alias("x")).select("read_id", pairs.barcode_within(F.col("x"), "TGCAG", 6).alias("barcode"))
)
query("first_mates", "select read_id, substr(s1, 1, length(s1) - 1) as first, substr(s1, 6, greatest(length(s1) - 5, 0)) as bare, substr(s1, 6, greatest(length(s1) - 10, 0)) as bare_merged from mates", "mates")(
    lambda s, d: _mates(s, d).select("read_id", dna.first_mate(pairs.concatenate(F.col("s1"), F.col("s2"))).alias("first"), dna.without_site(F.col("s1"), "TGCAG").alias("bare"), dna.without_site(F.col("s1"), "TGCAG", "CTGCA").alias("bare_merged"))
)
_file = "concat('/data/x.y/S_R1', cast(read_id % 50 as varchar(9)), case read_id % 4 when 0 then '_R1.fastq.gz' when 1 then '_R1_003.fq' when 2 then '.FastQ' else '_R2.fq.gz' end)"
query("sample_names", f"select read_id, 'S_R1' || (read_id % 50) || case read_id % 4 when 1 then '_003' else '' end as name from reads", "reads")(lambda s, d: fx.reads(s, d).select("read_id", dna.sample_name(F.expr(_file)).alias("name")))

# Hits within a sample: uniques at one differing base from an earlier one, the earliest of these.
PARTS["uniques"] = "select sample_id, seq, n, row_number() over (partition by sample_id order by n desc, seq) as ord from derep"
PARTS["near1"] = "select sample_id::bigint * 1000000000 + ord as query, sample_id::bigint * 1000000000 + first as target, case when ord % 3 = 0 then '-' else '+' end as strand, (ord % 5)::int as gaps, (84 + ord % 16)::int as qcov from (select sample_id, ord, min(lead) as first from (select sample_id, ord, min(ord) over (partition by sample_id, p, substr(seq, 1, p - 1), substr(seq, p + 1)) as lead from uniques, range(1, 33) t(p)) where lead < ord group by 1, 2)"
NEEDS |= {"uniques": ["derep"], "near1": ["uniques"]}


def uniques(s, d):
    return clusters.ranked(rd.dereplicate(fx.reads(s, d)))


def near_hits(s, d, *carried):
    hits = clusters.one_off_hits(uniques(s, d), *carried)
    return hits.selectExpr(*carried, "sample_id * 1000000000L + ord as query", "sample_id * 1000000000L + first as target", "case when ord % 3 = 0 then '-' else '+' end as strand", "cast(ord % 5 as int) as gaps", "cast(84 + ord % 16 as int) as qcov")


query("one_off_hits", "select * from near1", "near1")(near_hits)
query("two_hop_hits", "select seed, member, min(strand) as strand from (select target as seed, query as member, strand from near1 union all select a.target, b.query, case when a.strand = b.strand then '+' else '-' end from near1 a join near1 b on a.query = b.target) group by 1, 2", "near1")(lambda s, d: clusters.two_hop_hits(near_hits(s, d)))
query("seed_antijoin", "select id, seq from (select sample_id::bigint * 1000000000 + ord as id, seq from uniques) where id not in (select query from near1 union all select target from near1)", "near1")(lambda s, d: clusters.unhit_seeds(uniques(s, d).selectExpr("sample_id * 1000000000L + ord as id", "seq"), near_hits(s, d)))
query("hit_filters", "select query, target, strand from (select *, max(gaps) over (partition by target) as most from near1) where most <= 3 and (strand = '-' or qcov >= 90)", "near1")(lambda s, d: clusters.good_hits(near_hits(s, d), 3).select("query", "target", "strand"))
query("hit_sequences", "select target, query, strand, case when strand = '-' then reverse(translate(seq, 'ACGT', 'TGCA')) else seq end as seq from near1 join (select sample_id::bigint * 1000000000 + ord as query, seq from uniques) using (query)", "near1")(lambda s, d: clusters.hit_sequences(near_hits(s, d), uniques(s, d).selectExpr("sample_id * 1000000000L + ord as id", "seq")))
query("tier_seeds", "select target as seed, count(*) + 1 as hits from near1 group by 1 having count(*) + 1 >= 3", "near1")(lambda s, d: clusters.tier_seeds(near_hits(s, d), 3))
query("top200_members", "select target, query, rank from (select target, query, row_number() over (partition by target order by n desc, query)::int as rank from near1 join (select sample_id::bigint * 1000000000 + ord as query, n from uniques) using (query)) where rank <= 200", "near1")(
    lambda s, d: clusters.top_members(near_hits(s, d, "n"))
)

# Genotype calls between the two depths, and of sites deeper than the cap.
PARTS["low"] = "select sample_id, locus_id, pos, case when n1 + n2 >= 8 then case when greatest(aa, bb, ab) / (aa + bb + ab) < 0.95 then 'N' when ab = greatest(aa, bb, ab) then case when b1 || b2 in ('AG', 'GA') then 'R' when b1 || b2 in ('GT', 'TG') then 'K' when b1 || b2 in ('GC', 'CG') then 'S' when b1 || b2 in ('TC', 'CT') then 'Y' when b1 || b2 in ('TA', 'AT') then 'W' else 'M' end when aa = greatest(aa, bb, ab) then b1 else b2 end when n1 + n2 >= 3 then b1 else 'N' end as call from post"
NEEDS["low"] = ["post"]


def _counts(s, d):
    return genotypes.site_counts(_locus_derep(s, d), dealt=True)


query("low_depth_calls", "select * from low", "low")(lambda s, d: genotypes.call_genotypes(_counts(s, d), mindepth=8, lowcounts=3))
PARTS["deep"] = "select sample_id, locus_id, pos, na * 40 as na, nc * 40 as nc, nt * 40 as nt, ng * 40 as ng from site_counts"
PARTS["deep2"] = "select sample_id, locus_id, pos, -t[1].m as n1, -t[2].m as n2 from (select *, list_sort([struct_pack(m := -na, i := 0), struct_pack(m := -nc, i := 1), struct_pack(m := -nt, i := 2), struct_pack(m := -ng, i := 3)]) as t from deep)"
NEEDS |= {"deep": ["site_counts"], "deep2": ["deep"]}
query("depth_cap", "select sample_id, locus_id, pos, case when n1 + n2 > 500 then round(500 * n1 / (n1 + n2)) else n1 end::bigint as m1, case when n1 + n2 > 500 then 500 - round(500 * n1 / (n1 + n2)) else n2 end::bigint as m2 from deep2", "deep2")(
    lambda s, d: genotypes.capped(genotypes.top_two(_counts(s, d).select("sample_id", "locus_id", "pos", *[(F.col(f"n{b}") * 40).alias(f"n{b}") for b in genotypes.BASES]))).select("sample_id", "locus_id", "pos", "m1", F.col("m2").cast("long").alias("m2"))
)

# Estimates of H and E as a step writes them, of samples with loci enough; means are the priors of the next step.
PARTS["he"] = "select sample_id, count(distinct locus_id) / 100000.0 as h, count(*) / 10000000.0 as e from reads group by 1"
NEEDS["he"] = ["reads"]


def _he(s, d):
    return fx.reads(s, d).groupBy("sample_id").agg((F.count_distinct("locus_id") / 100000.0).alias("h"), (F.count("*") / 10000000.0).alias("e"))


query("mean_he", "select round(coalesce(avg(h), 0.01), 9) as h, round(coalesce(avg(e), 0.001), 9) as e, count(*) as samples from he", "he")(lambda s, d: genotypes.mean_he(_he(s, d)))
query("mean_he_fallback", "select round(coalesce(avg(h), 0.01), 9) as h, round(coalesce(avg(e), 0.001), 9) as e, count(*) as samples from he where h < 0", "he")(lambda s, d: genotypes.mean_he(_he(s, d).where("h < 0")))
