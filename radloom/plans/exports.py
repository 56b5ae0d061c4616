"""Queries of loci, tests of introgression, stacks and exported text, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import clusters, introgression, loci, pairs
from radloom.plans import fixtures as fx
from radloom.plans.assembly import near_hits, uniques
from radloom.plans.queries import NEEDS, PARTS, query
from radloom.sinks import text as out

# Sites with phase by case and with gaps.
_PHASED = "case when base in ('R', 'K', 'S', 'Y', 'W', 'M') and (xlocus + pos) % 3 = 0 then lower(base) when (xlocus * 7 + taxon * 3 + pos) % 29 = 0 or (pos < 4 and taxon = 2) then '-' else base end"
PARTS["phased"] = f"select xlocus, taxon, pos, {_PHASED} as base from sites"
PARTS["pclasses"] = "select xlocus, pos, case when nd < 2 then ' ' when t2 > 1 then '*' else '-' end as cls from (select xlocus, pos, count(distinct case when base not in ('N', '-') then upper(base) end) as nd from phased group by 1, 2) join (select xlocus, pos, (sum((a = 'A')::int) > 1)::int + (sum((a = 'C')::int) > 1)::int + (sum((a = 'G')::int) > 1)::int + (sum((a = 'T')::int) > 1)::int as t2 from (select xlocus, pos, unnest(case when base in ('N', '-') then [''] when upper(base) in ('R', 'K', 'S', 'Y', 'W', 'M') then [translate(upper(base), 'RKSYWM', 'GGGTTC'), translate(upper(base), 'RKSYWM', 'ATCCAA')] else [base] end) as a from phased) group by 1, 2) using (xlocus, pos)"
PARTS["bounds"] = "select xlocus, min(pos) as first, max(pos) as last from (select xlocus, pos from phased where base not in ('N', '-') group by 1, 2 having count(*) >= 4) group by 1"
NEEDS |= {"phased": ["sites"], "pclasses": ["phased"], "bounds": ["phased"]}


def phased(s, d):
    return fx.sites(s, d).selectExpr("xlocus", "taxon", "pos", f"{_PHASED} as base")


query("site_class_phased", "select * from pclasses", "pclasses")(lambda s, d: loci.site_class(phased(s, d)))
query("geno_codes_phased", "select s.xlocus, s.pos, s.taxon, case when base in ('N', '-') then 9 else (translate(base, 'RKSYWMrksywm', 'GGGTTCATCCAA') = ref)::int + (translate(base, 'RKSYWMrksywm', 'ATCCAAGGGTTC') = ref)::int end::int as geno from phased s join (select xlocus, pos, arg_min(translate(base, 'RKSYWMrksywm', 'GGGTTCATCCAA'), taxon) as ref from phased where base not in ('N', '-') group by 1, 2 having count(distinct upper(base)) > 1) r on s.xlocus = r.xlocus and s.pos = r.pos", "phased")(lambda s, d: loci.geno_rows(phased(s, d)))
_het = ", ".join(f"count(*) filter (upper(base) = '{c}')" for c in dna.CODES)
PARTS["windowed"] = f"select t.xlocus, ntaxa, length, nsnp, maxgaps, maxhet from (select xlocus, count(*) filter (called > 0) as ntaxa, max(gaps) as maxgaps from (select xlocus, taxon, count(*) filter (base = '-' and pos between first and last) as gaps, count(*) filter (base <> 'N') as called from phased join bounds using (xlocus) group by 1, 2) group by 1) t join (select xlocus, max(h) as maxhet from (select xlocus, pos, greatest({_het}) as h from phased group by 1, 2) group by 1) h using (xlocus) join (select xlocus, count(*) filter (cls <> ' ') as nsnp, count(*) as length from pclasses join bounds using (xlocus) where pos between first and last group by 1) v using (xlocus)"
NEEDS["windowed"] = ["phased", "pclasses", "bounds"]
for _name, _limit, _share in (("window_filters", "2", False), ("window_filters_share", "0.35 * ntaxa", True)):
    query(_name, f"select *, case when maxhet > {_limit} then '%P' else '' end || case when nsnp > 20 or length < 30 then '%S' else '' end || case when maxgaps > 2 then '%I' else '' end as flags from windowed", "windowed")(
        lambda s, d, share=_share: loci.window_flags(phased(s, d), loci.site_class(phased(s, d)), pairs.overhang(phased(s, d), 4), 0.35 if share else 2, 20, 2, 30, share)
    )
query("site_mode", "select xlocus, pos, base from (select *, row_number() over (partition by xlocus, pos order by n desc, first) as r from (select xlocus, pos, base, count(*) as n, min(taxon) as first from phased group by 1, 2, 3)) where r = 1", "phased")(lambda s, d: loci.commonest(phased(s, d)))
# Members of loci: taxa of which some come twice, by name.
_MEMBERS = "select xlocus, taxon, concat('t', cast(taxon as varchar(9)), case when taxon > 3 then 'x' else '' end) as name from (select distinct xlocus, taxon from {0} where base <> 'N' union all select xlocus, taxon from {0} where pos = 1 and (xlocus + taxon) % 17 = 0)"
PARTS["members"] = _MEMBERS.format("sites")
NEEDS["members"] = ["sites"]


def members(s, d):
    x = fx.sites(s, d)
    rows = x.where("base <> 'N'").select("xlocus", "taxon").distinct().unionByName(x.where("pos = 1 and (xlocus + taxon) % 17 = 0").select("xlocus", "taxon"))
    return rows.selectExpr("xlocus", "taxon", "concat('t', taxon, if(taxon > 3, 'x', '')) as name")


query("duplicate_taxa", "select xlocus, case when count(*) > count(distinct taxon) then '%D' else '' end as flags from members group by 1", "members")(lambda s, d: loci.duplicate_taxa(members(s, d)))
query("taxon_roles", "select distinct name, name <> 't1' as ingroup from members where contains(name, 't') and name <> 't2'", "members")(lambda s, d: loci.taxon_roles(members(s, d), "t", ("t2",), ("t1",)))
query("ingroup_loci", "select xlocus, count(*) as ingroup from members where name not in ('t1', 't2') group by 1 having count(*) >= 3", "members")(lambda s, d: loci.ingroup_loci(members(s, d), loci.taxon_roles(members(s, d), "t", ("t2",), ("t1",)), 3))

# D statistics with Z: loci as often as the Poisson law says for a hash of replicate and locus.
_t = " + ".join(f"(u >= {x!r})::int" for x in introgression.poisson_steps())


def _z(names: list[str], source: str, reps: int = 50) -> str:
    columns = [f"{side}_{k}" for k in names for side in "lr"]
    sums = ", ".join(f"sum(t * {c}) as {c}" for c in columns)
    ds = ", ".join(f"coalesce((l_{k} - r_{k}) / nullif(l_{k} + r_{k}, 0), 0) as {k}" for k in names)
    own, sd = "max(case when rep = 0 then {0} end)", "stddev_pop(case when rep > 0 then {0} end)"
    final = ", ".join(f"round({own.format(k)}, 6) as d_{k}, round(case when {sd.format(k)} < 1e-5 then 0.0 else abs({own.format(k)}) / {sd.format(k)} end, 4) as z_{k}" for k in names)
    return f"select {final} from (select rep, {ds} from (select rep, {sums} from (select *, case when rep = 0 then 1 else {_t} end as t from (select *, ('0x' || substr(md5(rep || '-' || xlocus), 1, 8))::bigint / 4294967296.0::double as u from ({source}), range(0, {reps + 1}) r(rep))) group by 1))"


def _sides(which: dict) -> str:
    count = lambda p: "sum(case when pattern in (" + ", ".join(f"'{x}'" for x in p) + ") then n else 0 end)"
    return "select xlocus, " + ", ".join(f"{count(p)} as {side}_{k}" for k, v in which.items() for side, p in zip("lr", v, strict=True)) + " from pat5 group by 1"


def _pattern_z(s, d, which):
    return introgression.z_scores(introgression.sides(introgression.patterns5(fx.sites(s, d)), which), list(which))


query("d4_z", _z(["d4"], "select xlocus, abba as l_d4, baba as r_d4 from d4"), "d4")(lambda s, d: introgression.z_scores(introgression.d4_loci(fx.sites(s, d)).withColumnsRenamed({"abba": "l_d4", "baba": "r_d4"}), ["d4"]))
_ALT = {k: tuple(tuple(x for x in p if x not in introgression.TERMINAL) for p in v) for k, v in introgression.FOIL.items()}
for _name, _which in (("part_d_z", introgression.PARTITIONED), ("dfoil_z", introgression.FOIL), ("dfoil_alt_z", _ALT)):
    query(_name, _z(list(_which), _sides(_which)), "pat5")(lambda s, d, which=_which: _pattern_z(s, d, which))
_foil = list(introgression.FOIL)
query("dfoil_sign", "select " + " || ".join(f"case when z_{k} <= 3.5 then '0' when d_{k} > 0 then '+' else '-' end" for k in _foil) + f" as signs from ({_z(_foil, _sides(introgression.FOIL))})", "pat5")(
    lambda s, d: _pattern_z(s, d, introgression.FOIL).select(introgression.signs([F.col(f"z_{k}") for k in _foil], [F.col(f"d_{k}") for k in _foil]).alias("signs"))
)
# Two tests of a specification: single taxa, and groups of two.
_TESTS = [(1, "p1", 1), (1, "p2", 2), (1, "p3", 3), (1, "o", 5), (2, "p1", 1), (2, "p2", 2), (2, "p2", 3), (2, "p3", 4), (2, "o", 5)]
PARTS["tests"] = "select * from (values " + ", ".join(f"({i}, '{r}', {t})" for i, r, t in _TESTS) + ") t(test_id, role, taxon)"
PARTS["grouped"] = "select test_id, xlocus, sum((1 - f1) * f2 * f3) as abba, sum(f1 * (1 - f2) * f3) as baba from (select test_id, xlocus, b.p1 / n1 as f1, b.p2 / n2 as f2, b.p3 / n3 as f3 from (select test_id, xlocus, pos, sum(p1) as n1, sum(p2) as n2, sum(p3) as n3, sum(o) as no, min(case when p3 > 0 and o = 0 then struct_pack(m := -p3, allele := allele, p1 := p1, p2 := p2, p3 := p3) end) as b from (select test_id, xlocus, pos, allele, count(*) filter (role = 'p1') as p1, count(*) filter (role = 'p2') as p2, count(*) filter (role = 'p3') as p3, count(*) filter (role = 'o') as o from haps join tests using (taxon) group by 1, 2, 3, 4) group by 1, 2, 3) where b is not null and n1 > 0 and n2 > 0 and no > 0) group by 1, 2"
NEEDS["grouped"] = ["haps", "tests"]


def _grouped(s, d):
    return introgression.group_frequencies(fx.sites(s, d), s.createDataFrame(_TESTS, "test_id int, role string, taxon int"))


query("d_groups", "select test_id, xlocus, round(abba, 9) as abba, round(baba, 9) as baba from grouped", "grouped")(lambda s, d: _grouped(s, d).select("test_id", "xlocus", F.round("abba", 9).alias("abba"), F.round("baba", 9).alias("baba")))
query("d_test_results", "select test_id, count(*) as loci, round(sum(abba), 6) as abba, round(sum(baba), 6) as baba, round(coalesce((sum(abba) - sum(baba)) / nullif(sum(abba) + sum(baba), 0), 0), 6) as d, round(count(*) filter (abs(abba - baba) > 1e-9) / count(*), 6) as pdisc from grouped group by 1", "grouped")(lambda s, d: introgression.test_results(_grouped(s, d)))

# Stacks: seeds and their hits, with gaps at both ends as aligned to their seed.
_A = "concat(repeat('-', cast(member % 6 as int)), substr(seq, cast(member % 6 as int) + 1, 32 - cast(member % 6 as int) - cast(member % 5 as int) - cast(member % 3 as int)), repeat('-', cast(member % 3 as int)), case when member % 3 > 0 then 'A' else '' end, repeat('-', cast(member % 5 as int)))"
PARTS["stacks"] = f"select locus, member, strand, size, is_seed, {_A} as aligned from (select target as locus, query as member, strand, n as size, false as is_seed, seq from near1 join (select sample_id::bigint * 1000000000 + ord as query, n, seq from uniques) using (query) union all select id, id, '+', n, true, seq from (select sample_id::bigint * 1000000000 + ord as id, n, seq from uniques) where id in (select target from near1))"
NEEDS["stacks"] = ["near1", "uniques"]


def stacks(s, d):
    """(locus, member, strand, size, is_seed, seq) of seeds and their hits."""
    hits, u = near_hits(s, d), uniques(s, d).selectExpr("sample_id * 1000000000L + ord as id", "n as size", "seq")
    seeds = u.join(hits.select(F.col("target").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("locus"), F.col("id").alias("member"), F.lit("+").alias("strand"), "size", F.lit(True).alias("is_seed"), "seq")
    return hits.join(u.withColumnRenamed("id", "query"), "query").select(F.col("target").alias("locus"), F.col("query").alias("member"), "strand", "size", F.lit(False).alias("is_seed"), "seq").unionByName(seeds)


def _aligned(s, d):
    return stacks(s, d).selectExpr("locus", "member", "strand", "size", "is_seed", f"{_A} as aligned")


query("stack_crop", "select locus, member, substr(case when r is null then aligned else left(aligned, greatest(r, 0)) end, coalesce(l, 0) + 1) as aligned from stacks join (select locus, min(case when is_seed then length(aligned) - length(regexp_replace(aligned, '^[-N]+', '')) end) as l, min(case when strand = '-' and regexp_matches(aligned, '[ACGT]') then length(regexp_replace(aligned, '[^ACGT]+$', '')) end) as r from stacks group by 1) using (locus)", "stacks")(lambda s, d: clusters.crop_stacks(_aligned(s, d)))
query("stack_filter", "select locus, member, strand, size, is_seed, substr(aligned, l + 1) as aligned from (select *, max(case when is_seed then length(aligned) - length(ltrim(aligned, '-')) end) over (partition by locus) as l from stacks) where length(trim(aligned, '-')) - length(replace(trim(aligned, '-'), '-', '')) <= 1 and (strand <> '-' or left(aligned, 4) = '----')", "stacks")(lambda s, d: clusters.filter_aligned(_aligned(s, d), 1))
_mate = "split_part(aligned, 'nnnn', 2)"
query("bad_pairs", f"select locus, bool_or(replace({_mate}, '-', '') <> 'N' and length(trim({_mate}, '-')) - length(replace(trim({_mate}, '-'), '-', '')) > 1) as bad from (select locus, left(aligned, 10) || 'nnnn' || case when member % 7 = 0 then 'N' else aligned end as aligned from stacks) group by 1", "stacks")(
    lambda s, d: clusters.bad_pairs(_aligned(s, d).selectExpr("locus", "left(aligned, 10) || 'nnnn' || if(member % 7 = 0, 'N', aligned) as aligned"), 1)
)
query("stack_alignment")(lambda s, d: clusters.align_stacks(stacks(s, d).withColumn("seq", F.when(F.col("member") % 4 == 0, F.substr("seq", F.lit(1), F.lit(28))).otherwise(F.col("seq")))))

# Exported text.
_names = [1, 2, 3, 4, 5]
PARTS["kept"] = "select xlocus, pos, row_number() over (order by xlocus, pos) - 1 as place from (select distinct xlocus, pos from phased where base not in ('N', 'n', '-'))"
NEEDS["kept"] = ["phased"]
query("phylip_parts", "select place // 1000 as block, taxon, string_agg(base, '' order by place) as seq from phased join kept using (xlocus, pos) group by 1, 2", "kept")(lambda s, d: out.concatenated_blocks(phased(s, d), _names, 1000))
query("nexus_text", "select place // 100 as block, taxon, '  ' || rpad(taxon::varchar, 12, ' ') || string_agg(base, '' order by place) as text from phased join kept using (xlocus, pos) group by 1, 2", "kept")(lambda s, d: out.nexus_text(out.concatenated_blocks(phased(s, d), _names)))
query("nexus_sets", "select xlocus, '  CHARSET p' || xlocus || '=' || (stop - length + 1)::bigint || '-' || stop::bigint || ';' as text from (select xlocus, length, sum(length) over (order by xlocus) as stop from (select xlocus, count(*) as length from classes group by 1))", "classes")(
    lambda s, d: out.nexus_sets(fx.sites(s, d).groupBy("xlocus").agg(F.count_distinct("pos").alias("length")))
)
query("snps_text", "select xlocus, taxon, case when s is null then '_ ' else s || ' ' end as text from (select xlocus, taxon, string_agg(case when cls <> ' ' then base end, '' order by pos) as s from phased join pclasses using (xlocus, pos) group by 1, 2)", "pclasses")(lambda s, d: out.snps_text(phased(s, d), loci.site_class(phased(s, d))))


def _chosen(s, d):
    return loci.unlinked_snps(fx.sites(s, d), loci.site_class(fx.sites(s, d)))


query("unlinked_text", "select xlocus, taxon, base as text from sites join chosen using (xlocus, pos)", "chosen")(lambda s, d: out.unlinked_text(fx.sites(s, d), _chosen(s, d)))
query("structure_text", "select xlocus, taxon, h::int as hap, case translate(base, 'RKSYWM', case when h = 0 then 'GGGTTC' else 'ATCCAA' end) when 'A' then '0' when 'T' then '1' when 'G' then '2' when 'C' then '3' else '-9' end as text from sites join chosen using (xlocus, pos), range(0, 2) t(h)", "chosen")(lambda s, d: out.structure_text(fx.sites(s, d), _chosen(s, d)))
query("geno_text", "select s.xlocus, s.pos, string_agg(case when base = 'N' then 9 else (translate(base, 'RKSYWM', 'GGGTTC') = ref)::int + (translate(base, 'RKSYWM', 'ATCCAA') = ref)::int end::varchar, '' order by taxon) as text from sites s join (select xlocus, pos, arg_min(translate(base, 'RKSYWM', 'GGGTTC'), taxon) as ref from sites where base <> 'N' group by 1, 2 having count(distinct base) > 1) r on s.xlocus = r.xlocus and s.pos = r.pos group by 1, 2", "sites")(lambda s, d: out.geno_text(fx.sites(s, d)))
query("treemix_text", "select xlocus, pos, string_agg(c1 || ',' || c2, ' ' order by gid) as text from (select h.xlocus, h.pos, gid, count(*) filter (h.allele = a1) as c1, count(*) filter (h.allele = a2) as c2 from haps h join (select xlocus, pos, max(case when r = 1 then allele end) as a1, max(case when r = 2 then allele end) as a2 from (select a.*, row_number() over (partition by xlocus, pos order by n desc, allele) as r from acounts2 a) join chosen using (xlocus, pos) group by 1, 2 having a2 is not null) t on h.xlocus = t.xlocus and h.pos = t.pos join pops using (taxon) group by 1, 2, 3) group by 1, 2 having min(c1 + c2) > 0", "haps", "chosen", "pops")(lambda s, d: out.treemix_text(loci.treemix_rows(fx.sites(s, d), _chosen(s, d), fx.pops(s))))
query("migrate_text", "select gid, xlocus, string_agg(rpad(left(gid, 8) || '_' || (k - 1), 10, ' ') || seq, chr(10) order by k) as text from (select gid, xlocus, seq, row_number() over (partition by gid, xlocus order by taxon) as k from (select xlocus, taxon, string_agg(base, '' order by pos) as seq from sites where xlocus in (select xlocus from covered) group by 1, 2) join pops using (taxon) where replace(seq, 'N', '') <> '') group by 1, 2", "covered")(lambda s, d: out.migrate_text(fx.sites(s, d), fx.pops(s)))
_marks = "(select xlocus, string_agg(cls, '' order by pos) as marks from pclasses group by 1)"
query("excluded_text", f"select xlocus, string_agg(rpad('>' || taxon, 12, ' ') || seq, chr(10) order by taxon) || chr(10) || rpad('//' || any_value(flags), 12, ' ') || any_value(marks) || '|' || xlocus || '|' as text from (select xlocus, taxon, upper(string_agg(base, '' order by pos)) as seq from phased group by 1, 2) join {_marks} using (xlocus) join (select xlocus, case when maxgaps > 2 then '%I' else '%S' end as flags from windowed where maxgaps > 2 or nsnp > 20) using (xlocus) group by 1", "windowed")(
    lambda s, d: out.excluded_text(phased(s, d), loci.site_class(phased(s, d)), loci.window_flags(phased(s, d), loci.site_class(phased(s, d)), pairs.overhang(phased(s, d), 4), 9, 20, 2, 1).withColumn("flags", F.when(F.col("maxgaps") > 2, "%I").when(F.col("nsnp") > 20, "%S").otherwise("")))
)
query("alleles_text", "select xlocus, string_agg(rpad('>' || taxon || '_0', 12, ' ') || translate(seq, 'RKSYWMrksywm', 'GGGTTCATCCAA') || chr(10) || rpad('>' || taxon || '_1', 12, ' ') || translate(seq, 'RKSYWMrksywm', 'ATCCAAGGGTTC'), chr(10) order by taxon) as text from (select xlocus, taxon, string_agg(base, '' order by pos) as seq from phased group by 1, 2) group by 1", "phased")(lambda s, d: out.alleles_text(phased(s, d)))
_info = ", ".join(f"'##{kind}=<ID={i},Number={n},Type={t},Description=\"{text}\">'" for kind, i, n, t, text in out.VCF_FIELDS)
_columns = ", ".join(f"'{c}'" for c in out.VCF_COLUMNS)
query("vcf_head", f"select (generate_subscripts(l, 1) - 1)::int as line, unnest(l) as text from (select ['##fileformat=VCFv4.1', '##fileDate=20200101', '##source=radloom', '##reference=common_allele_at_each_locus', {_info}, concat_ws(chr(9), {_columns}, names)] as l from (select string_agg(taxon::varchar, chr(9) order by taxon) as names from (select distinct taxon from sites)))", "sites")(
    lambda s, d: out.vcf_head_rows(fx.sites(s, d), "20200101")
)
query("stats_text", "select value, value || chr(9) || loci || chr(9) || (sum(loci) over (order by value desc rows between unbounded preceding and current row))::bigint as text from (select ntaxa as value, count(*) as loci from summary group by 1)", "summary")(lambda s, d: out.stats_text(loci.distribution(loci.locus_summary(fx.sites(s, d), loci.site_class(fx.sites(s, d))), "ntaxa")))
query("locus_edges", "select xlocus, taxon, length(seq) - length(ltrim(seq, '-')) as first, greatest(length(rtrim(seq, '-')), 1) as last, trim(replace(seq, '-', 'N'), 'N') as bare from (select xlocus, taxon, string_agg(base, '' order by pos) as seq from phased group by 1, 2)", "phased")(
    lambda s, d: loci.sequences(phased(s, d)).select("xlocus", "taxon", dna.first_base(F.col("seq")).alias("first"), dna.last_base(F.col("seq")).alias("last"), dna.trim_ends(F.translate("seq", "-", "N")).alias("bare"))
)
