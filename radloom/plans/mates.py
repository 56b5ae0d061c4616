"""Queries of consensus and loci of mates, with the same results in DuckDB SQL; a locus's mates are two neighbouring parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.functions import dna
from radloom.operators import genotypes, loci, mates
from radloom.plans.exports import phased
from radloom.plans.queries import NEEDS, PARTS, _counts, _left, _right, query

_codes = "(" + ", ".join(f"'{c}'" for c in dna.CODES) + ")"
_calls = "select sample_id, locus_id // 2 as locus_id, (locus_id % 2 + 1)::int as mate, pos, call from calls"
PARTS["matecons"] = f"select sample_id, locus_id, coalesce(string_agg(call, '' order by pos) filter (mate = 1), '') as one, coalesce(replace(string_agg(call, '' order by pos) filter (mate = 2), '-', 'N'), '') as two, count(*) filter (mate = 1 and call in {_codes}) as h1, count(*) filter (call in {_codes}) as n_het, count(*) filter (mate = 1 and call = 'N') as n from ({_calls}) group by 1, 2"
_bare = f"array_to_string([substr(seq, i::int, 1) for i in range(1, length(seq) + 1) if substr(seq, i::int, 1) <> 'N' or not (i <= 3 or {_left} or {_right})], '')"
PARTS["matebare"] = f"select * exclude (seq), {_bare} as bare from (select *, replace(rtrim(one, 'N'), '-', 'N') as seq from matecons)"
NEEDS |= {"matecons": ["calls"], "matebare": ["matecons"]}


def _pair_calls(s, d):
    c = genotypes.call_genotypes(_counts(s, d))
    return c.select("sample_id", F.floor(F.col("locus_id") / 2).alias("locus_id"), (F.col("locus_id") % 2 + 1).cast("int").alias("mate"), "pos", "call")


query("pair_consensus", "select sample_id, locus_id, bare || 'nnnn' || two as seq, n_het, case when n > 8 then 'N' when h1 >= 1 then 'H1' when n_het > 1 then 'H' when length(bare) < 28 or length(two) < 28 then 'L' end as reason from matebare", "matebare")(lambda s, d: mates.pair_consensus(_pair_calls(s, d), 8, 1, 28))

# Overhangs of single loci by every option, and of mates by four.
PARTS["limits"] = "select xlocus, taxon, coalesce(min(pos) filter (base <> '-'), max(pos)) as l, coalesce(max(pos) filter (base <> '-'), 1) as r, max(pos) as n from phased group by 1, 2"
NEEDS["limits"] = ["phased"]
_k = "least(4, count(*))::int"
query("overhang_options", f"select xlocus, min(l) as first0, max(r) as last0, (list(l order by l))[{_k}] as first1, (list(r order by r desc))[{_k}] as last1, max(l) as first2, min(r) as last2 from limits group by 1", "limits")(
    lambda s, d: _options(phased(s, d))
)


def _options(x):
    out = mates.overhang_bounds(x, 0, 0).withColumnsRenamed({"first": "first0", "last": "last0"})
    for k in (1, 2):
        out = out.join(mates.overhang_bounds(x, k, k).withColumnsRenamed({"first": f"first{k}", "last": f"last{k}"}).hint("shuffle_hash"), "xlocus")
    return out


PARTS["pairsites"] = "select xlocus // 2 as xlocus, (xlocus % 2 + 1)::int as mate, taxon, pos, base from phased"
PARTS["pairclasses"] = "select xlocus // 2 as xlocus, (xlocus % 2 + 1)::int as mate, pos, cls from pclasses"
PARTS["pairlimits"] = "select xlocus // 2 as xlocus, (xlocus % 2 + 1)::int as mate, l, r, n from limits"
_of = lambda m: f"(select xlocus, count(*) as c, max(n) as n, list(l order by l) as ls, list(r order by r desc) as rs from pairlimits where mate = {m} group by 1)"
PARTS["pairbounds"] = f"select xlocus, a.ls[least(4, a.c)::int] as first1, a.rs[-1] as last1, b.ls[-1] as first2, b.n as last2 from {_of(1)} a full join {_of(2)} b using (xlocus)"
NEEDS |= {"pairsites": ["phased"], "pairclasses": ["pclasses"], "pairlimits": ["limits"], "pairbounds": ["pairlimits"]}


def _pair_sites(s, d):
    return phased(s, d).select(F.floor(F.col("xlocus") / 2).alias("xlocus"), (F.col("xlocus") % 2 + 1).cast("int").alias("mate"), "taxon", "pos", "base")


def _bounds(s, d):
    return mates.pair_bounds(_pair_sites(s, d), (1, 2, 2, 0))


query("pair_overhang", "select * from pairbounds", "pairbounds")(_bounds)
_gaps = "select xlocus, max(g1) as gaps1, max(g2) as gaps2, any_value(length1)::bigint as length1 from (select xlocus, taxon, count(*) filter (base = '-' and mate = 1 and pos >= first1) as g1, count(*) filter (base = '-' and mate = 2 and pos <= last2) as g2, any_value(coalesce(last1 - first1 + 1, 0)) as length1 from pairsites join pairbounds using (xlocus) group by 1, 2) group by 1"
_shared = "select xlocus, max(greatest(" + ", ".join(f"c{c}" for c in dna.CODES) + ")) as maxhet from (select xlocus, mate, pos, " + ", ".join(f"count(*) filter (upper(base) = '{c}') as c{c}" for c in dna.CODES) + " from pairsites group by 1, 2, 3) group by 1"
_snps = "select xlocus, count(*) filter (cls <> ' ' and mate = 1) as nsnp1, count(*) filter (cls <> ' ' and mate = 2) as nsnp2 from pairclasses group by 1"
_s = "case when nsnp1 > 20 then '%S1' when nsnp2 > 21 then '%S2' else '' end"
_i = f"case when {_s} <> '' then '' when gaps1 > 2 then '%I1' when gaps2 > 3 then '%I2' else '' end"
query("pair_filters", f"select *, case when maxhet > 2 and length1 < 29 then '%P%S' when maxhet > 2 then '%P' when length1 < 29 then '%S' || {_i} else {_s} || {_i} end as flags from ({_snps}) join ({_gaps}) using (xlocus) join ({_shared}) using (xlocus)", "pairsites", "pairclasses", "pairbounds")(
    lambda s, d: mates.pair_flags(_pair_sites(s, d), _pair_classes(s, d), _bounds(s, d), 2, (20, 21), (2, 3), 29)
)


def _pair_classes(s, d):
    return loci.site_class(phased(s, d)).select(F.floor(F.col("xlocus") / 2).alias("xlocus"), (F.col("xlocus") % 2 + 1).cast("int").alias("mate"), "pos", "cls")
