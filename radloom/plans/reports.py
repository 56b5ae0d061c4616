"""Queries of whole report files, with the same lines in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from radloom.operators import loci
from radloom.operators import reads as rd
from radloom.plans import exports, fixtures as fx
from radloom.plans.queries import NEEDS, PARTS, _flagged, query
from radloom.sinks import report
from radloom.sinks import text as out

PARTS["kept_loci"] = "select xlocus, ntaxa, nsnp, npis from flagged where flags = ''"
PARTS["site_counts_of_loci"] = "select v.value, (select count(*) from kept_loci where nsnp = v.value) as var, (select count(*) from kept_loci where npis = v.value) as pis from (select unnest(range(0, (select max(nsnp) from kept_loci) + 1)) as value) v"
PARTS["site_sums"] = "select *, (sum(value * var) over (order by value))::bigint as sumvar, (sum(value * pis) over (order by value))::bigint as sumpis from site_counts_of_loci"
NEEDS |= {"kept_loci": ["flagged"], "site_counts_of_loci": ["kept_loci"], "site_sums": ["site_counts_of_loci"]}


def _lines(section: int, texts: tuple[str, ...]) -> str:
    return " union all ".join(f"select {section}, {i - len(texts)}, replace('{t}', '~', chr(9)) where exists (select 1 from kept_loci)" for i, t in enumerate(x.replace("\t", "~") for x in texts))


def _tabs(*parts: str) -> str:
    return "concat_ws(chr(9), " + ", ".join(parts) + ")"


_SQL = f"""
select 1 as section, i::bigint as line, rpad(n::varchar, 12, ' ') || t as text from (
  select unnest([0, 1, 2]) as i, unnest([kept + para + snps, kept + snps, kept]) as n, unnest(['{"', '".join(report.TOTALS)}']) as t
  from (select count(*) filter (flags = '') as kept, count(*) filter (contains(flags, '%P')) as para, count(*) filter (contains(flags, '%S')) as snps from flagged))
union all {_lines(2, report.TAXA)}
union all select 2, row_number() over (order by taxon::varchar) - 1, {_tabs("rpad(taxon::varchar, 12, ' ')", "n")} from (select taxon, count(distinct xlocus) as n from sites join kept_loci using (xlocus) where base <> 'N' group by 1)
union all {_lines(3, report.COVERAGE)}
union all select 3, value, case when value = 1 then '1' || chr(9) || '-' when value < 4 then value || chr(9) || '-' || chr(9) || chr(9) || '-'
  else {_tabs("value", "(select count(*) from kept_loci where ntaxa = value)", "'*'", "(select count(*) from kept_loci where ntaxa >= value)")} end
  from (select unnest(range(1, (select max(ntaxa) from kept_loci) + 1)) as value)
union all {_lines(4, report.VARIABLE)}
union all select 4, value, {_tabs("value", "var", "sumvar", "pis", "sumpis")} from site_sums
union all select 4, max(value) + 1, 'total var= ' || max(sumvar) from site_sums having max(value) is not null
union all select 4, max(value) + 2, 'total pis= ' || max(sumpis) from site_sums having max(value) is not null
"""


def _taxa(s, d):
    return fx.sites(s, d).where("base <> 'N'").select("xlocus", "taxon").distinct()


query("statistics_file", _SQL, "flagged", "sites", "kept_loci", "site_sums")(lambda s, d: report.statistics(_flagged(s, d), _taxa(s, d), 4))

_BLOCKS = "select place // 1000 as block, taxon, string_agg(base, '' order by place) as seq from phased join kept using (xlocus, pos) group by 1, 2"
query("phylip_file", f"select taxon, block, case when block = 0 then rpad(taxon::varchar, 12, ' ') else '' end || seq as text from ({_BLOCKS})", "kept")(
    lambda s, d: report.phylip(out.concatenated_blocks(exports.phased(s, d), exports._names, 1000))
)


def _ranges(s, d):
    """Ranges of the loci among the columns that the phylip file keeps."""
    x = exports.phased(s, d).groupBy("xlocus", "pos").agg(F.bool_or(~F.col("base").isin("N", "n", "-")).alias("k")).where("k")
    return loci.partitions(x.groupBy("xlocus").agg(F.count("*").alias("length")))


query("partition_file", "select xlocus, 'DNA, p' || xlocus || '=' || (min(place) + 1) || '-' || (max(place) + 1) as text from kept group by 1", "kept")(lambda s, d: report.partition_lines(_ranges(s, d)))


_MEANS = "coalesce(round(avg(depth){0}, 3)::varchar, 'na'), coalesce(round(stddev_pop(depth){0}, 3)::varchar, 'na')"
_KEPT = " filter (depth >= 6)"
_EDGES = ", ".join(map(str, rd.DEPTH_EDGES[:-1]))
_TOPS = ", ".join(map(str, rd.DEPTH_EDGES[1:-1])) + ", 1000000000000"
_CLUSTERS = f"""
select 0 as section, '' as sample, 0 as line, {_tabs("'taxa'", "'total'", "'dpt.me'", "'dpt.sd'", "'d>5.tot'", "'d>5.me'", "'d>5.sd'", "'badpairs'")} as text
union all select 1, sample_id::varchar, 0, {_tabs("sample_id", "count(*)", _MEANS.format(""), f"count(*){_KEPT}", _MEANS.format(_KEPT), "0")} from depth group by sample_id
union all select 2, '', unnest(range(0, {len(report.CLUSTER_NOTES)})), unnest(['{"', '".join(report.CLUSTER_NOTES)}'])
union all select 3, sample_id::varchar, unnest([0, 1, 2]), unnest(['sample: ' || sample_id, {", ".join("replace('" + t.replace(chr(9), "~") + "', '~', chr(9))" for t in report.HISTOGRAM)}]) from (select distinct sample_id from depth)
union all select 3, sample_id::varchar, i + 3, low || ' ' || chr(9) || case when loci > 0 then '*' else ' ' end || rpad(repeat('*', round(loci * 30 / whole)::int), 34, ' ') || loci from (
  select sample_id, i, low, count(*) filter (depth >= low and depth < top) as loci, count(*) as whole
  from depth, (select unnest(range(0, {len(rd.DEPTH_EDGES) - 1})) as i, unnest([{_EDGES}]) as low, unnest([{_TOPS}]) as top) group by 1, 2, 3)
"""
query("cluster_statistics_file", _CLUSTERS, "depth")(lambda s, d: report.cluster_statistics(rd.depths(fx.reads(s, d))))
