"""Queries over the operators, with the same results in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import clusters, genotypes, introgression, loci, pairs, reads as rd
from radloom.plans import fixtures as fx
from radloom.session import shared_dir
from radloom.sinks import text as out
from radloom.sources import text as src

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
O: dict[str, str] = {}

_F = fx.SQL
# Shared oracle parts, by name; each needs those before it in its own list.
PARTS = {
    "reads": _F["reads"],
    "barcodes": _F["barcodes"],
    "observed": _F["observed"],
    "sites": _F["sites"],
    "pops": _F["pops"],
    "near": "select code, sample_id, barcode, mismatches from (select c.code, b.sample_id, b.barcode, hamming(c.code, b.barcode)::int as mismatches, row_number() over (partition by c.code order by hamming(c.code, b.barcode), b.barcode) as r from (select distinct code from observed) c join barcodes b on length(c.code) = length(b.barcode) and hamming(c.code, b.barcode) <= 1) where r = 1",
    "masked": "select *, length(masked) - length(replace(masked, 'N', '')) as n_count from (select read_id, sample_id, 'TGCAG' || array_to_string([case when ascii(substr(qual, i::int, 1)) - 33 >= 20 then substr(seq, i::int, 1) else 'N' end for i in range(6, 33)], '') as masked from reads)",
    "derep": "select sample_id, seq, count(*) as n from reads group by 1, 2",
    "depth": "select sample_id, locus_id, count(*) as depth from reads group by 1, 2",
    "site_counts": "select sample_id, locus_id, pos, count(*) filter (b = 'A') as na, count(*) filter (b = 'C') as nc, count(*) filter (b = 'T') as nt, count(*) filter (b = 'G') as ng from (select sample_id, locus_id, p::int as pos, substr(seq, p::int, 1) as b from reads, range(1, 33) t(p)) group by 1, 2, 3",
    "patterns": "select sample_id, na, nc, nt, ng, count(*) as multiplicity from site_counts where na + nc + nt + ng >= 5 group by all",
    "tops": "select *, list_sort([struct_pack(m := -na, i := 0, b := 'A'), struct_pack(m := -nc, i := 1, b := 'C'), struct_pack(m := -nt, i := 2, b := 'T'), struct_pack(m := -ng, i := 3, b := 'G')]) as t from site_counts",
    "two": "select sample_id, locus_id, pos, -t[1].m as n1, t[1].b as b1, -t[2].m as n2, t[2].b as b2, -t[3].m as n3, na + nc + nt + ng as n from tops",
    "scores": "select *, lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1) as c from two",
    "post": "select *, 0.495 * exp(c + n2 * ln(0.001) + n1 * ln(0.999)) as aa, 0.495 * exp(c + n1 * ln(0.001) + n2 * ln(0.999)) as bb, 0.01 * exp(c - (n1 + n2) * ln(2)) as ab from scores",
    "calls": "select sample_id, locus_id, pos, case when n1 + n2 < 6 then 'N' when greatest(aa, bb, ab) / (aa + bb + ab) < 0.95 then 'N' when ab = greatest(aa, bb, ab) then case when b1 || b2 in ('AG', 'GA') then 'R' when b1 || b2 in ('GT', 'TG') then 'K' when b1 || b2 in ('GC', 'CG') then 'S' when b1 || b2 in ('TC', 'CT') then 'Y' when b1 || b2 in ('TA', 'AT') then 'W' else 'M' end when aa = greatest(aa, bb, ab) then b1 else b2 end as call from post",
    "cons": "select sample_id, locus_id, string_agg(call, '' order by pos) as seq, count(*) filter (call in ('R','K','S','Y','W','M')) as n_het, count(*) filter (call = 'N') as n_n from calls group by 1, 2",
    "haps": "select xlocus, taxon, pos, h::int as hap, translate(base, 'RKSYWM', case when h = 0 then 'GGGTTC' else 'ATCCAA' end) as allele from sites, range(0, 2) t(h) where base <> 'N'",
    "acounts": "select xlocus, pos, allele, count(*) as n from haps where hap = 0 or (xlocus, taxon, pos) in (select (xlocus, taxon, pos) from sites where base in ('R','K','S','Y','W','M')) group by 1, 2, 3",
    "acounts2": "select xlocus, pos, allele, count(*) as n from (select xlocus, pos, translate(base, 'RKSYWM', 'GGGTTC') as allele from sites where base <> 'N' union all select xlocus, pos, translate(base, 'RKSYWM', 'ATCCAA') from sites where base in ('R','K','S','Y','W','M')) group by 1, 2, 3",
    "classes": "select s.xlocus, s.pos, case when nd < 2 then ' ' when coalesce(t2, 0) > 1 then '*' else '-' end as cls from (select xlocus, pos, count(distinct case when base <> 'N' then base end) as nd from sites group by 1, 2) s left join (select xlocus, pos, count(*) filter (n > 1) as t2 from acounts2 group by 1, 2) a on s.xlocus = a.xlocus and s.pos = a.pos",
    "persite": "select xlocus, pos, greatest(count(*) filter (base = 'R'), count(*) filter (base = 'K'), count(*) filter (base = 'S'), count(*) filter (base = 'Y'), count(*) filter (base = 'W'), count(*) filter (base = 'M')) as h from sites group by 1, 2",
    "summary": "select v.xlocus, v.length, t.ntaxa, v.nsnp, v.npis, h.maxhet, t.maxgaps from (select xlocus, count(*) as length, count(*) filter (cls <> ' ') as nsnp, count(*) filter (cls = '*') as npis from classes group by 1) v join (select xlocus, max(h) as maxhet from persite group by 1) h using (xlocus) join (select xlocus, count(*) filter (called > 0) as ntaxa, max(gaps) as maxgaps from (select xlocus, taxon, count(*) filter (base = '-') as gaps, count(*) filter (base <> 'N') as called from sites group by 1, 2) group by 1) t using (xlocus)",
    "flagged": "select *, case when maxhet > 1 then '%P' else '' end || case when nsnp > 22 or length < 32 then '%S' else '' end || case when maxgaps > 3 then '%I' else '' end as flags from summary where ntaxa >= 4",
    "chosen": "select xlocus, pos from (select c.xlocus, c.pos, row_number() over (partition by c.xlocus order by -v.cover, (a.k > 2)::int, md5('112233-' || c.xlocus || '-' || c.pos), c.pos) as r from classes c join (select xlocus, pos, count(*) as k from acounts2 group by 1, 2) a using (xlocus, pos) join (select xlocus, pos, sum(case when base = 'N' then 0 when base = '-' then 1 else 2 end) as cover from sites group by 1, 2) v using (xlocus, pos) where cls <> ' ') where r = 1",
    "covered": "select xlocus from (select xlocus, gid, count(*) >= max(minhits) as ok from (select distinct xlocus, taxon from sites where base <> 'N') join pops using (taxon) group by 1, 2) group by 1 having count(*) filter (ok) = 2",
    "quartets": "select xlocus, pos, max(case when taxon = 1 then base end) as p1, max(case when taxon = 2 then base end) as p2, max(case when taxon = 3 then base end) as p3, max(case when taxon = 4 then base end) as p4, max(case when taxon = 5 then base end) as o from sites group by 1, 2",
    "d4": "select xlocus, count(*) filter (p1 <> p2 and p1 = p4 and p2 = p3) as abba, count(*) filter (p1 <> p2 and p1 = p3 and p2 = p4) as baba from quartets where p1 in ('A','C','G','T') and p2 in ('A','C','G','T') and p3 in ('A','C','G','T') and p4 in ('A','C','G','T') group by 1",
    "biallelic": "select *, coalesce(case when p1 <> o then p1 end, case when p2 <> o then p2 end, case when p3 <> o then p3 end, case when p4 <> o then p4 end) as alt from quartets where p1 in ('A','C','G','T') and p2 in ('A','C','G','T') and p3 in ('A','C','G','T') and p4 in ('A','C','G','T') and o in ('A','C','G','T')",
    "pat5": "select xlocus, case when p1 = o then 'A' else 'B' end || case when p2 = o then 'A' else 'B' end || case when p3 = o then 'A' else 'B' end || case when p4 = o then 'A' else 'B' end || 'A' as pattern, count(*) as n from biallelic where alt is not null and p1 in (o, alt) and p2 in (o, alt) and p3 in (o, alt) and p4 in (o, alt) group by 1, 2",
    "rolefreq": "select xlocus, pos, allele, count(*) filter (taxon = 1) as p1, count(*) filter (taxon = 2) as p2, count(*) filter (taxon = 3) as p3, count(*) filter (taxon > 3) as o from haps group by 1, 2, 3",
}
NEEDS = {
    "observed": ["reads"], "near": ["observed", "barcodes"], "masked": ["reads"], "derep": ["reads"], "depth": ["reads"], "site_counts": ["reads"], "patterns": ["site_counts"], "tops": ["site_counts"], "two": ["tops"], "scores": ["two"], "post": ["scores"], "calls": ["post"], "cons": ["calls"],
    "haps": ["sites"], "acounts2": ["sites"], "classes": ["acounts2", "sites"], "persite": ["sites"], "summary": ["classes", "persite"], "flagged": ["summary"], "chosen": ["classes", "acounts2"], "covered": ["sites", "pops"], "quartets": ["sites"], "d4": ["quartets"], "biallelic": ["quartets"], "pat5": ["biallelic"], "rolefreq": ["haps"],
}


def oracle(sql: str, *parts: str) -> str:
    """``sql`` below the shared parts that it names, and theirs."""
    order: list[str] = []

    def add(p: str) -> None:
        for q in NEEDS.get(p, []):
            add(q)
        if p not in order:
            order.append(p)

    for p in parts:
        add(p)
    if not order:
        return sql
    return "with " + ", ".join(f"{p} as materialized ({PARTS[p]})" if p in ("sites", "classes", "reads") else f"{p} as ({PARTS[p]})" for p in order) + " " + sql


def query(name: str, sql: str | None = None, *parts: str):
    def register(f):
        Q[name] = f
        if sql:
            O[name] = oracle(sql, *parts)
        return f

    return register


def _observed(s, d):
    return fx.reads(s, d).selectExpr("read_id", "sample_id", f"{fx.OBSERVED} as code")


def _locus_derep(s, d):
    return fx.by_locus(fx.reads(s, d), "sample_id", "locus_id").groupBy("sample_id", "locus_id", "seq").agg(F.count("*").alias("n"))


def _counts(s, d):
    return genotypes.site_counts(_locus_derep(s, d), dealt=True)


def _patterns(s, d):
    return genotypes.count_patterns(_counts(s, d))


def _cons(s, d):
    return genotypes.consensus(genotypes.call_genotypes(_counts(s, d)))


def _summary(s, d):
    x = fx.sites(s, d)
    return loci.locus_summary(x, loci.site_class(x))


def _flagged(s, d):
    return loci.locus_flags(_summary(s, d), max_shared=1, max_snps=22)


query("reads", "select * from reads", "reads")(lambda s, d: fx.reads(s, d))
query("revcomp", "select read_id, reverse(translate(seq, 'ACGT', 'TGCA')) as rc from reads", "reads")(lambda s, d: fx.reads(s, d).select("read_id", dna.revcomp(F.col("seq")).alias("rc")))
query("iupac_haplotypes", "select xlocus, taxon, translate(seq, 'RKSYWMrksywm', 'GGGTTCATCCAA') as hap1, translate(seq, 'RKSYWMrksywm', 'ATCCAAGGGTTC') as hap2, reverse(translate(seq, 'ACGTRYKMrykm', 'TGCAYRMKyrmk')) as rc from (select xlocus, taxon, string_agg(base, '' order by pos) as seq from sites group by 1, 2)", "sites")(
    lambda s, d: loci.sequences(fx.sites(s, d)).select("xlocus", "taxon", dna.haplotype(F.col("seq"), 1).alias("hap1"), dna.haplotype(F.col("seq"), 2).alias("hap2"), dna.revcomp_coded(F.col("seq")).alias("rc"))
)
query("quality_mask", "select read_id, masked from masked", "masked")(lambda s, d: rd.edit(fx.reads(s, d)).select("read_id", "masked"))
query("read_filters", "select sample_id, count(*) as nreads, count(*) filter (n_count <= 4 and length(masked) >= 32) as passed, sum(n_count)::bigint as n_bases from masked group by 1", "masked")(lambda s, d: rd.edit_stats(rd.edit(fx.reads(s, d))))
query("barcode_hamming_join", "select * from near", "near")(lambda s, d: rd.demultiplex(_observed(s, d), fx.barcodes(s)))
query("barcode_report", "select sample_id as matched, barcode, o.code, o.n from (select code, count(*) as n from observed group by 1) o left join near using (code)", "near")(lambda s, d: rd.barcode_report(_observed(s, d), rd.demultiplex(_observed(s, d), fx.barcodes(s))))
query("derep", "select * from derep", "derep")(lambda s, d: rd.dereplicate(fx.reads(s, d)))
query("derep_both_strands", "select sample_id, least(seq, reverse(translate(seq, 'ACGT', 'TGCA'))) as seq, count(*) as n from reads group by 1, 2 having count(*) >= 2", "reads")(lambda s, d: rd.dereplicate(fx.reads(s, d), least=2, both_strands=True))
query("top200_uniques", "select * from (select *, row_number() over (partition by sample_id order by n desc, seq)::int as rank from derep) where rank <= 200", "derep")(lambda s, d: rd.top_uniques(rd.dereplicate(fx.reads(s, d))))
query("depth_stats", "select sample_id, count(*) as n, round(avg(depth), 3) as mean, round(stddev_pop(depth), 3) as sd, count(*) filter (depth >= 6) as n_kept, round(avg(depth) filter (depth >= 6), 3) as mean_kept, round(stddev_pop(depth) filter (depth >= 6), 3) as sd_kept from depth group by 1", "depth")(lambda s, d: rd.depth_stats(rd.depths(fx.reads(s, d))))
query("depth_histogram", "select sample_id, case when depth >= 500 then 500 when depth >= 250 then 250 when depth >= 100 then 100 when depth >= 50 then 50 when depth >= 40 then 40 else depth // 5 * 5 end::int as low, count(*) as loci from depth group by 1, 2", "depth")(lambda s, d: rd.depth_histogram(rd.depths(fx.reads(s, d))))
query("locus_depth_window", "select d.* from depth d join (select sample_id, greatest(500.0, avg(depth) filter (depth >= 6) + 2.5 * stddev_pop(depth) filter (depth >= 6)) as upper from depth group by 1) u using (sample_id) where depth >= 6 and depth < coalesce(upper, 500.0)", "depth")(lambda s, d: rd.depth_window(rd.depths(fx.reads(s, d))))
query("site_counts", "select * from site_counts", "site_counts")(_counts)
query("count_patterns", "select * from patterns", "patterns")(_patterns)
query("base_freqs", "select sample_id, " + ", ".join(f"round(sum(n{b} * multiplicity) / sum((na + nc + nt + ng) * multiplicity), 6) as p{b}" for b in "actg") + " from patterns group by 1", "patterns")(lambda s, d: genotypes.base_freqs(_patterns(s, d)))
_pm = lambda k, s, q: f"exp(lgamma({s} + 1) - lgamma({k} + 1) - lgamma(({s}) - ({k}) + 1) + ({k}) * ln({q}) + (({s}) - ({k})) * ln(1 - {q}))"
_one = " + ".join(f"p{b} * {_pm(f's - n{b}', 's', '0.001')}" for b in "actg")
_two = " + ".join(f"2 * p{a} * p{b} * {_pm(f's - n{a} - n{b}', 's', '(0.002 / 3)')} * {_pm(f'n{a}', f'(n{a} + n{b})', '0.5')}" for i, a in enumerate("actg") for b in "actg"[i + 1 :])
query("he_loglik_fixed", f"select sample_id, round(-sum(multiplicity * ln(0.99 * ({_one}) + 0.01 * ({_two}) / (1 - pa * pa - pc * pc - pt * pt - pg * pg))), 4) as loglik from (select *, na + nc + nt + ng as s from patterns join (select sample_id, " + ", ".join(f"sum(n{b} * multiplicity) / sum((na + nc + nt + ng) * multiplicity) as p{b}" for b in "actg") + " from patterns group by 1) using (sample_id)) group by 1", "patterns")(lambda s, d: genotypes.fixed_loglik(_patterns(s, d)))
query("genotype_calls", "select * from calls", "calls")(lambda s, d: genotypes.call_genotypes(_counts(s, d)))
query("third_base_filter", "select sample_id, locus_id, bool_or(n3 / n > 0.2) as rejected from two group by 1, 2", "two")(lambda s, d: genotypes.third_base_rejects(_counts(s, d)))
query("consensus", "select * from cons", "cons")(_cons)
query("consensus_stats", "select sample_id, count(*) as nloci, count(*) filter (n_het <= 5) as f1loci, count(*) filter (n_het <= 5 and n_n <= 5 and length(seq) >= 32) as f2loci, sum(case when n_het <= 5 and n_n <= 5 and length(seq) >= 32 then length(seq) else 0 end)::bigint as nsites, sum(case when n_het <= 5 and n_n <= 5 and length(seq) >= 32 then n_het else 0 end)::bigint as npoly from cons group by 1", "cons")(lambda s, d: genotypes.consensus_stats(_cons(s, d)))
query("he_optimum")(lambda s, d: genotypes.estimate_he(_patterns(s, d)))
query("het_codes", "select xlocus, pos, " + ", ".join(f"count(*) filter (base = '{c}') as {c.lower()}" for c in dna.CODES) + " from sites group by 1, 2", "sites")(lambda s, d: fx.sites(s, d).groupBy("xlocus", "pos").agg(*[F.count_if(F.col("base") == c).alias(c.lower()) for c in dna.CODES]))
query("site_class", "select * from classes", "classes")(lambda s, d: loci.site_class(fx.sites(s, d)))
query("locus_summary", "select * from summary", "summary")(_summary)
query("shared_het_filter", "select xlocus, maxhet, maxhet > 1 as rejected from summary", "summary")(lambda s, d: _summary(s, d).select("xlocus", "maxhet", (F.col("maxhet") > 1).alias("rejected")))
query("locus_filters", "select * from flagged", "flagged")(_flagged)
query("locus_stage_totals", "select count(*) as loci, count(*) filter (contains(flags, '%P')) as npara, count(*) filter (contains(flags, '%S')) as nmsnp, count(*) filter (contains(flags, '%I')) as nindel, count(*) filter (flags = '') as nloci from flagged", "flagged")(lambda s, d: loci.stage_totals(_flagged(s, d)))
for _name, _column in (("coverage_distribution", "ntaxa"), ("snp_distribution", "nsnp"), ("pis_distribution", "npis")):
    query(_name, f"select value, loci, sum(loci) over w::bigint as running, sum(value * loci) over w::bigint as weighted from (select {_column} as value, count(*) as loci from summary group by 1) window w as (order by value desc rows between unbounded preceding and current row)", "summary")(lambda s, d, c=_column: loci.distribution(_summary(s, d), c))
query("taxon_locus_counts", "select taxon, count(distinct xlocus) as loci from sites where base <> 'N' group by 1", "sites")(lambda s, d: fx.sites(s, d).where("base <> 'N'").select("taxon", "xlocus").distinct().groupBy("taxon").agg(F.count("*").alias("loci")))
query("partitions", "select xlocus, (stop - length + 1)::bigint as start, stop::bigint as stop from (select xlocus, length, sum(length) over (order by xlocus) as stop from summary)", "summary")(lambda s, d: loci.partitions(_summary(s, d)))
query("snps", "select xlocus, taxon, string_agg(base, '' order by pos) as snps from sites join classes using (xlocus, pos) where cls <> ' ' group by 1, 2", "classes")(lambda s, d: loci.snps(fx.sites(s, d), loci.site_class(fx.sites(s, d))))
query("unlinked_snps", "select * from chosen", "chosen")(lambda s, d: loci.unlinked_snps(fx.sites(s, d), loci.site_class(fx.sites(s, d))))
query("structure_codes", "select xlocus, pos, taxon, h::int as hap, case translate(base, 'RKSYWM', case when h = 0 then 'GGGTTC' else 'ATCCAA' end) when 'A' then 0 when 'T' then 1 when 'G' then 2 when 'C' then 3 else -9 end::int as code from sites, range(0, 2) t(h)", "sites")(lambda s, d: loci.structure_rows(fx.sites(s, d)))
query("geno_codes", "select s.xlocus, s.pos, s.taxon, case when base = 'N' then 9 else (translate(base, 'RKSYWM', 'GGGTTC') = ref)::int + (translate(base, 'RKSYWM', 'ATCCAA') = ref)::int end::int as geno from sites s join (select xlocus, pos, arg_min(translate(base, 'RKSYWM', 'GGGTTC'), taxon) as ref from sites where base <> 'N' group by 1, 2 having count(distinct base) > 1) r on s.xlocus = r.xlocus and s.pos = r.pos", "sites")(lambda s, d: loci.geno_rows(fx.sites(s, d)))
query("treemix_counts", "select h.xlocus, h.pos, gid, count(*) filter (h.allele = a1) as c1, count(*) filter (h.allele = a2) as c2 from haps h join (select xlocus, pos, max(case when r = 1 then allele end) as a1, max(case when r = 2 then allele end) as a2 from (select a.*, row_number() over (partition by xlocus, pos order by n desc, allele) as r from acounts2 a) join chosen using (xlocus, pos) group by 1, 2 having a2 is not null) t on h.xlocus = t.xlocus and h.pos = t.pos join pops using (taxon) group by 1, 2, 3", "haps", "chosen", "pops")(lambda s, d: loci.treemix_rows(fx.sites(s, d), loci.unlinked_snps(fx.sites(s, d), loci.site_class(fx.sites(s, d))), fx.pops(s)))
query("vcf_rows", "select a.xlocus, a.pos, (list(allele order by n desc, allele))[1] as ref, array_to_string((list(allele order by n desc, allele))[2:], ',') as alt, any_value(ns) as ns from acounts2 a join (select xlocus, pos, count(*) as ns from sites where base <> 'N' group by 1, 2) s on a.xlocus = s.xlocus and a.pos = s.pos group by 1, 2 having count(*) > 1", "acounts2")(lambda s, d: loci.vcf_rows(fx.sites(s, d)))
query("migrate_counts", "select xlocus, gid, count(distinct case when base <> 'N' then taxon end) as taxa, max(pos) as length from sites join covered using (xlocus) join pops using (taxon) group by 1, 2", "covered")(lambda s, d: loci.migrate_counts(fx.sites(s, d), fx.pops(s)))
query("pop_min_coverage", "select * from covered", "covered")(lambda s, d: loci.populations_covered(fx.sites(s, d), fx.pops(s)))
query("gphocs_rows", "select xlocus, taxon, string_agg(base, '' order by pos) as seq from sites group by 1, 2", "sites")(lambda s, d: loci.sequences(fx.sites(s, d)))
query("alleles", "select xlocus, taxon, hap, string_agg(allele, '' order by pos) as seq from haps group by 1, 2, 3", "haps")(lambda s, d: loci.alleles(fx.sites(s, d)).groupBy("xlocus", "taxon", "hap").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "allele"))), lambda x: x["allele"]), "").alias("seq")))
_dt = "round((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 6) as d, round(count(*) filter (abba <> baba) / count(*), 6) as pdisc"
query("d4_fixed", f"select sum(abba)::bigint as abba, sum(baba)::bigint as baba, {_dt} from d4", "d4")(lambda s, d: introgression.d_total(introgression.d4_loci(fx.sites(s, d))))
query("d4_freq", "select xlocus, sum((1 - f1) * f2 * f3) as abba, sum(f1 * (1 - f2) * f3) as baba from (select xlocus, pos, b.p1 / n1 as f1, b.p2 / n2 as f2, b.p3 / n3 as f3 from (select xlocus, pos, sum(p1) as n1, sum(p2) as n2, sum(p3) as n3, sum(o) as no, min(case when p3 > 0 and o = 0 then struct_pack(m := -p3, allele := allele, p1 := p1, p2 := p2, p3 := p3) end) as b from rolefreq group by 1, 2) where b is not null and n1 > 0 and n2 > 0 and no > 0) group by 1", "rolefreq")(lambda s, d: introgression.d4_frequencies(fx.sites(s, d)))
query("d4_bootstrap", "select rep, sum(abba)::bigint as abba, sum(baba)::bigint as baba, round((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 6) as d from (select r as rep, ('0x' || substr(md5(r || '-' || j), 1, 8))::bigint % (select count(*) from d4) as k from range(0, 50) a(r), range(0, (select count(*) from d4)) b(j)) join (select *, row_number() over (order by xlocus) - 1 as i from d4) on i = k group by 1", "d4")(lambda s, d: introgression.bootstrap(introgression.d4_loci(fx.sites(s, d))))


def _stat(which: dict) -> str:
    quoted = lambda p: ", ".join(f"'{x}'" for x in p)
    return ", ".join(f"round((count_l_{k} - count_r_{k}) / nullif(count_l_{k} + count_r_{k}, 0), 6) as {k}" for k in which), ", ".join(f"sum(case when pattern in ({quoted(a)}) then n else 0 end) as count_l_{k}, sum(case when pattern in ({quoted(b)}) then n else 0 end) as count_r_{k}" for k, (a, b) in which.items())


_ALT = {k: tuple(tuple(x for x in p if x not in introgression.TERMINAL) for p in v) for k, v in introgression.FOIL.items()}
for _name, _which, _make in (("part_d", introgression.PARTITIONED, lambda p: introgression.pattern_statistics(p, introgression.PARTITIONED)), ("dfoil", introgression.FOIL, introgression.foil), ("dfoil_alt", _ALT, lambda p: introgression.foil(p, terminal=False))):
    _a, _b = _stat(_which)
    query(_name, f"select {_a} from (select {_b} from pat5)", "pat5")(lambda s, d, f=_make: f(introgression.patterns5(fx.sites(s, d))))
query("shuffle_order", "select sample_id, seq, row_number() over (partition by sample_id order by length(seq) desc, md5('112233-' || seq), seq)::int as place from (select distinct sample_id, seq from reads)", "reads")(
    lambda s, d: clusters.shuffle_order(fx.reads(s, d).select("sample_id", "seq").distinct().select("sample_id", "seq", F.col("seq").alias("name"), F.length("seq").alias("length"), F.lit(False).alias("outgroup"))).select("sample_id", "seq", F.expr("cast(row_number() over (partition by sample_id order by key, seq) as int)").alias("place"))
)


def _uniques(s, d):
    return clusters.ranked(rd.dereplicate(fx.reads(s, d)))


query("within_cluster")(lambda s, d: clusters.greedy_clusters(_uniques(s, d)))


def _fastq(s, d):
    path = f"{shared_dir(s)}/radloom/fastq-{uuid.uuid4().hex}"
    out.write_text(out.fastq(fx.reads(s, d).select(F.col("read_id").cast("string").alias("header"), "seq", "qual")), path)
    return src.read_fastq(s, path).select(F.col("header").cast("long").alias("read_id"), "seq", "qual")


def _loci_file(s, d):
    path = f"{shared_dir(s)}/radloom/loci-{uuid.uuid4().hex}"
    x = fx.sites(s, d)
    out.write_text(out.loci_text(x, loci.site_class(x)), path, "xlocus")
    return src.read_loci(s, path).select("xlocus", F.col("taxon").cast("int").alias("taxon"), "seq")


_marks = "(select xlocus, string_agg(cls, '' order by pos) as marks from classes group by 1)"
_by_taxon = "(select xlocus, taxon, string_agg(base, '' order by pos) as seq from sites group by 1, 2)"
query("fastq_scan", "select read_id, seq, qual from reads", "reads")(_fastq)
query("loci_scan", f"select * from {_by_taxon}", "sites")(_loci_file)
query("loci_text", f"select xlocus, string_agg(rpad('>' || taxon, 12, ' ') || seq, chr(10) order by taxon) || chr(10) || rpad('//', 12, ' ') || any_value(marks) || '|' || xlocus || '|' as text from {_by_taxon} join {_marks} using (xlocus) group by 1", "classes")(
    lambda s, d: out.loci_text(fx.sites(s, d), loci.site_class(fx.sites(s, d)))
)
query("gphocs_text", f"select xlocus, 'locus' || xlocus || ' ' || count(*) || ' ' || max(length(seq)) || chr(10) || string_agg(taxon || chr(9) || replace(seq, '-', 'N'), chr(10) order by taxon) as text from {_by_taxon} group by 1", "sites")(lambda s, d: out.gphocs_text(fx.sites(s, d)))
query("phylip_blocks", "select xlocus, string_agg(seq, chr(10) order by taxon) as text from (select xlocus, taxon, string_agg(base, '' order by pos) as seq from sites where (xlocus, pos) in (select (xlocus, pos) from sites where base <> 'N') group by 1, 2) group by 1", "sites")(lambda s, d: out.phylip_blocks(fx.sites(s, d), fx.pops(s)))
query("vcf_text", "select xlocus, pos, concat_ws(chr(9), xlocus, pos, '.', a[1], array_to_string(a[2:], ','), '20', 'PASS', 'NS=' || ns || ';DP=6', 'GT', gts) as text from (select xlocus, pos, any_value(a) as a, count(*) filter (base <> 'N') as ns, string_agg(case when base = 'N' then './.' else (list_position(a, translate(base, 'RKSYWM', 'GGGTTC')) - 1) || '|' || (list_position(a, translate(base, 'RKSYWM', 'ATCCAA')) - 1) end, chr(9) order by taxon) as gts from sites join (select xlocus, pos, list(allele order by n desc, allele) as a from acounts2 group by 1, 2 having count(*) > 1) using (xlocus, pos) group by 1, 2)", "acounts2")(lambda s, d: out.vcf_text(fx.sites(s, d)))
query("quality_mask_second", "select read_id, substr(seq, 1, 5) || array_to_string([case when ascii(substr(qual, i::int, 1)) - 33 >= 20 then substr(seq, i::int, 1) else 'N' end for i in range(6, 33)], '') as masked from reads", "reads")(lambda s, d: fx.reads(s, d).select("read_id", pairs.mask_between(F.col("seq"), F.col("qual"), 5).alias("masked")))
query("quality_mask_merged", "select read_id, substr(seq, 1, 5) || array_to_string([case when ascii(substr(qual, i::int, 1)) - 33 >= 20 then substr(seq, i::int, 1) else 'N' end for i in range(6, 29)], '') || substr(seq, 29) as masked from reads", "reads")(lambda s, d: fx.reads(s, d).select("read_id", pairs.mask_between(F.col("seq"), F.col("qual"), 5, 4).alias("masked")))
query("pair_concat", "select read_id, substr(seq, 1, 31) || 'nnnn' || reverse(translate(substr(reverse(seq), 2), 'ACGT', 'TGCA')) as seq from reads", "reads")(lambda s, d: fx.reads(s, d).select("read_id", pairs.concatenate(F.col("seq"), F.reverse("seq")).alias("seq")))
query("barcode_before_cut", f"select read_id, case len(p) when 1 then null when 2 then p[1] else p[1] || 'TGCAG' || p[2] end as barcode from (select read_id, string_split({fx.OBSERVED} || case when read_id % 5 = 0 then '' else 'TGCAG' end || seq, 'TGCAG') as p from reads)", "reads")(
    lambda s, d: fx.reads(s, d).select("read_id", F.expr(f"concat({fx.OBSERVED}, case when read_id % 5 = 0 then '' else 'TGCAG' end, seq)").alias("x")).select("read_id", pairs.barcode_before_cut(F.col("x"), "TGCAG").alias("barcode"))
)
query("overhang_trim", "select xlocus, min(pos) as first, max(pos) as last from (select xlocus, pos from sites where base <> 'N' group by 1, 2 having count(*) >= 5) group by 1", "sites")(lambda s, d: pairs.overhang(fx.sites(s, d), 5))
query("haplotype_filter", "select sample_id, locus_id, count(*) filter (n > 0.25 * total) as haplotypes, count(*) filter (n > 0.25 * total) > 2 as rejected from (select *, sum(n) over (partition by sample_id, locus_id) as total from (select sample_id, locus_id, hap, sum(n) as n from (select sample_id, locus_id, seq, any_value(n) as n, string_agg(substr(seq, pos, 1), '' order by pos) as hap from (select sample_id, locus_id, seq, count(*) as n from reads group by 1, 2, 3) join calls using (sample_id, locus_id) where call in ('R','K','S','Y','W','M') group by 1, 2, 3) group by 1, 2, 3)) group by 1, 2", "calls")(
    lambda s, d: pairs.haplotype_rejects(_locus_derep(s, d), genotypes.call_genotypes(_counts(s, d)))
)
_c = "substr(seq, (i + {})::int, 1)"
_left = f"({_c.format(-1)} = {_c.format(-2)} and {_c.format(-2)} = {_c.format(-3)})"
_right = f"({_c.format(2)} in ('', {_c.format(1)}) and {_c.format(3)} in ('', {_c.format(1)}))"
query("repeat_n_filter", f"select xlocus, taxon, array_to_string([substr(seq, i::int, 1) for i in range(1, length(seq) + 1) if substr(seq, i::int, 1) <> 'N' or not (i <= 3 or {_left} or {_right})], '') as seq from {_by_taxon}", "sites")(
    lambda s, d: loci.sequences(fx.sites(s, d)).select("xlocus", "taxon", dna.drop_repeat_n(F.col("seq")).alias("seq"))
)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: depth statistics of the dereplicated reads of each sample."""
    return Q["depth_stats"](spark, sf_dir)
