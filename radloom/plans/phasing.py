"""Queries of merged mates, phased consensus and haploid likelihoods, with the same results in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.operators import genotypes, pairs
from radloom.plans import fixtures as fx
from radloom.plans.queries import NEEDS, PARTS, _counts, _locus_derep, _one, _patterns, query
from radloom.session import parts

# Mates of inserts of 34 to 98 bases, read for 44 bases; a base of the first is wrong, and every 13th pair is of two inserts.
_HEX = "'0123456789abcdef', 'ACGTACGTACGTACGT'"
_BASES = "concat(" + ", ".join(f"translate(md5(concat('{x}', cast(k as varchar(20)))), {_HEX})" for x in "LMV") + ")"
_TAIL = "'AGATCGGAAGAGCACACGTCTGAACTCCAGTCACAGATCGGAAG'"
_QUAL = "translate(concat(md5(concat('{0}', cast(k as varchar(20)))), md5(concat('{0}-', cast(k as varchar(20))))), '0123456789abcdef', '-0369<?BEHKNQQQQ')"
_SIZE = "cast(34 + k % 65 as int)"
_E = "cast(k % 53 as int)"
_RC = "reverse(translate({}, 'ACGT', 'TGCA'))"
_ROW = f"select k as read_id, case when {_E} between 1 and 44 then concat(substr(r1, 1, {_E} - 1), translate(substr(r1, {_E}, 1), 'ACGT', 'CGTA'), substr(r1, {_E} + 1)) else r1 end as s1, r2 as s2, q1, q2 from (select k, substr(concat(ins, {_TAIL}), 1, 44) as r1, substr(concat({_RC.format('other')}, {_TAIL}), 1, 44) as r2, case when k % 11 = 0 then concat(substr(q1, 1, 40), '!', substr(q1, 42, 3)) else substr(q1, 1, 44) end as q1, substr(q2, 1, 44) as q2 from (select k, substr(bases, 1, {_SIZE}) as ins, case when k % 13 = 0 then substr(reverse(bases), 1, {_SIZE}) else substr(bases, 1, {_SIZE}) end as other, q1, q2 from (select k, {_BASES} as bases, {_QUAL.format('q')} as q1, {_QUAL.format('r')} as q2 from {{0}})))"
PARTS["inserts"] = _ROW.format("(select p_partkey as k from part)")
_cut = lambda c, q: f"case when instr({q}, '!') > 0 then substr({c}, 1, instr({q}, '!') - 1) else {c} end"
PARTS["turned"] = f"select read_id, a, qa, {_RC.format('b')} as b, reverse(qb) as qb, length(a) as n, length(b) as m from (select read_id, {_cut('s1', 'q1')} as a, {_cut('q1', 'q1')} as qa, {_cut('s2', 'q2')} as b, {_cut('q2', 'q2')} as qb from inserts) where length(a) >= 36 and length(b) >= 36"
PARTS["shifted"] = "select read_id, o, i, i >= greatest(o, 0) and i < least(n, o + m) as inside, substr(a, (i + 1)::int, 1) as x, substr(b, (i - o + 1)::int, 1) as y, ascii(substr(qa, (i + 1)::int, 1)) - 33 as p, ascii(substr(qb, (i - o + 1)::int, 1)) - 33 as q from turned, range(-28, 29) t(o), range(0, 44) u(i) where o >= 16 - m and o <= n - 16"
PARTS["bestshift"] = "select * from (select read_id, o, count(*) filter (inside and x <> y) as diffs, row_number() over (partition by read_id order by sum(case when x = y then 1 else -1 end * (1 + least(p, q))) filter (inside) desc, o) as r from shifted group by 1, 2 having count(*) filter (inside and x <> y) <= 6) where r = 1"
PARTS["mergedpairs"] = """select read_id, o::int as shift, diffs::int as diffs, substr(a, 1, greatest(o, 0)::int) || mid || case when o + m > n then substr(b, (n - o + 1)::int) else '' end as seq, substr(qa, 1, greatest(o, 0)::int) || qmid || case when o + m > n then substr(qb, (n - o + 1)::int) else '' end as qual from turned join bestshift using (read_id) join (select read_id, o, string_agg(case when p >= q then x else y end, '' order by i) as mid, string_agg(chr(33 + case when x = y then greatest(p, q) else abs(p - q) end), '' order by i) as qmid from shifted where inside group by 1, 2) using (read_id, o) where greatest(o, 0) + length(mid) + greatest(o + m - n, 0) >= 50"""
NEEDS |= {"turned": ["inserts"], "shifted": ["turned"], "bestshift": ["shifted"], "mergedpairs": ["bestshift"]}


def _inserts(s, d):
    """Mates of every part, dealt over all tasks: the file of parts is one split, and a pair is compared at all shifts."""
    keys = fx.table(s, d, "part").selectExpr("p_partkey as k")
    keys.repartition(parts(s, keys.count(), fx.LOCI), "k").createOrReplaceTempView("part_keys")
    return s.sql(_ROW.format("part_keys"))


query("pair_merge", "select * from mergedpairs", "mergedpairs")(lambda s, d: pairs.merge_pairs(_inserts(s, d)))
query("pair_unmerged", "select * from inserts where read_id not in (select read_id from mergedpairs)", "mergedpairs")(lambda s, d: pairs.unmerged(_inserts(s, d), pairs.merge_pairs(_inserts(s, d))))

# Phase: reads of two haplotypes at two or three sites, with errors between them, beside what the reads have.
_SITES = "5 + cast(l_partkey % 4 as int)"
_ALT = "translate(substr(seq, {0}, 1), 'ACGT', 'GTAC')"
_COIN = "cast((l_orderkey + l_linenumber) % 2 as int)"
_H = f"case when {_COIN} = 0 then seq else concat(substr(seq, 1, spot - 1), {_ALT.format('spot')}, substr(seq, spot + 1, 9), case when l_partkey % 3 = 0 then substr(seq, spot + 10, 1) else {_ALT.format('spot + 10')} end, substr(seq, spot + 11)) end"
_X = f"case when {_COIN} = 0 and l_partkey % 3 = 0 then concat(substr(h, 1, spot + 9), {_ALT.format('spot + 10').replace('seq', 'h')}, substr(h, spot + 11)) else h end"
_LAST = "case when l_orderkey % 31 = 0 then concat(substr(x, 1, spot - 1), 'T', substr(x, spot + 1)) else x end"
_LOCUS = f"translate(md5(concat('L', cast(l_partkey as varchar(20)))), {_HEX})"
_PLANTED = f"select l_partkey as locus_id, cast(l_suppkey % 2 as int) as sample_id, {_LAST} as seq from (select *, {_X} as x from (select *, {_H} as h from (select l_partkey, l_suppkey, l_orderkey, l_linenumber, {_SITES} as spot, {_LOCUS} as seq from lineitem)))"


def _haplotype_reads(s, d):
    """(sample_id, locus_id, seq, n); each step is exploded, so that the planner copies none into the next."""
    x = fx.table(s, d, "lineitem").selectExpr("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", f"{_SITES} as spot", f"explode(array({_LOCUS})) as seq")
    x = x.selectExpr("*", f"explode(array({_H})) as h").selectExpr("*", f"explode(array({_X})) as x")
    x = x.selectExpr("l_partkey as locus_id", "cast(l_suppkey % 2 as int) as sample_id", f"{_LAST} as seq")
    return fx.by_locus(x, "sample_id", "locus_id").groupBy("sample_id", "locus_id", "seq").agg(F.count("*").alias("n"))


PARTS["haploreads"] = "select sample_id, locus_id, seq, count(*) as n from (" + _PLANTED + ") group by 1, 2, 3"
PARTS["haplocounts"] = "select sample_id, locus_id, pos, " + ", ".join(f"sum(case when substr(seq, pos, 1) = '{b}' then n else 0 end)::bigint as n{b.lower()}" for b in "ACTG") + " from haploreads, (select unnest(range(1, 33))::int as pos) group by 1, 2, 3"


def _called(counts: str) -> str:
    """SQL: calls of the two commonest bases, as the queries of genotypes make them."""
    top = f"select *, list_sort([struct_pack(m := -na, i := 0, b := 'A'), struct_pack(m := -nc, i := 1, b := 'C'), struct_pack(m := -nt, i := 2, b := 'T'), struct_pack(m := -ng, i := 3, b := 'G')]) as t from {counts}"
    two = f"select sample_id, locus_id, pos, -t[1].m as n1, -t[2].m as n2, t[1].b as b1, t[2].b as b2 from ({top})"
    ln = "lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1)"
    post = f"select *, 0.495 * exp({ln} + n2 * ln(0.001) + n1 * ln(0.999)) as aa, 0.495 * exp({ln} + n1 * ln(0.001) + n2 * ln(0.999)) as bb, 0.01 * exp({ln} - (n1 + n2) * ln(2)) as ab from ({two})"
    code = "case " + " ".join(f"when b1 || b2 in ('{p}{q}', '{q}{p}') then '{c}'" for c, (p, q) in genotypes.dna.PAIRS.items()) + " end"
    return f"select sample_id, locus_id, pos, case when n1 + n2 < 6 or greatest(aa, bb, ab) / (aa + bb + ab) < 0.95 then 'N' when ab = greatest(aa, bb, ab) then {code} when aa = greatest(aa, bb, ab) then b1 else b2 end as call from ({post})"


PARTS["haplocalls"] = _called("haplocounts")
NEEDS |= {"haplocounts": ["haploreads"], "haplocalls": ["haplocounts"]}
_side = lambda b, c: f"case when {b} = translate({c}, 'RKSYWM', 'GGGTTC') then 1 when {b} = translate({c}, 'RKSYWM', 'ATCCAA') then -1 else 0 end"
_flip = f"select sample_id, locus_id, pos from (select r.sample_id, r.locus_id, k.pos, sum(r.n * {_side('substr(r.seq, f.pos, 1)', 'f.call')} * {_side('substr(r.seq, k.pos, 1)', 'k.call')}) as v from haploreads r join (select sample_id, locus_id, min(pos) as pos, arg_min(call, pos) as call from haplocalls where call in ('R','K','S','Y','W','M') group by 1, 2) f using (sample_id, locus_id) join haplocalls k using (sample_id, locus_id) where k.call in ('R','K','S','Y','W','M') and k.pos > f.pos group by 1, 2, 3) where v < 0"
query("phase_alleles", f"select sample_id, locus_id, string_agg(case when f.pos is not null then lower(call) else call end, '' order by c.pos) as seq, count(f.pos) as flipped from haplocalls c left join ({_flip}) f using (sample_id, locus_id, pos) group by 1, 2", "haplocalls")(lambda s, d: _phased(s, d))


def _phased(s, d):
    derep = _haplotype_reads(s, d)
    return genotypes.phase_alleles(derep, genotypes.call_genotypes(genotypes.site_counts(derep, dealt=True)))


query("phase_reads")(lambda s, d: genotypes.phase_alleles(_locus_derep(s, d), genotypes.call_genotypes(_counts(s, d))))
query("he_haploid", f"select sample_id, round(-sum(multiplicity * ln({_one})), 4) as loglik from (select *, na + nc + nt + ng as s from patterns join (select sample_id, " + ", ".join(f"sum(n{b} * multiplicity) / sum((na + nc + nt + ng) * multiplicity) as p{b}" for b in "actg") + " from patterns group by 1) using (sample_id)) group by 1", "patterns")(lambda s, d: genotypes.fixed_loglik(_patterns(s, d), haploid=True))
query("haploid_optimum")(lambda s, d: genotypes.estimate_haploid(_patterns(s, d)))
