"""Queries of D test runs, with the same results in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from radloom.operators import dtests, introgression
from radloom.params import ROLES
from radloom.plans import fixtures as fx
from radloom.plans.queries import NEEDS, PARTS, query
from radloom.session import shared_dir

# Tests by kind: single taxa, and groups that share some.
_SPEC = {"4": ["1 2 3 5 ## single taxa", "1 [2,3] 4 5 ## a group"], "part": ["1 2 3 4 5 ## single taxa", "[1,2] [2,3] 3 4 [5,1] ## groups"], "foil": ["1 2 3 4 5", "[1,2] [2,3] 3 4 [5,1]"]}
_SPEC["foilalt"] = _SPEC["foil"]


def specification(kind: str, loci: str = "sites") -> str:
    """A test file: seven settings, a rule, a test a line."""
    settings = [("50", "draws"), (loci, "loci"), ("out", "output"), (kind, "test"), ("2", "processors"), ("1", "lists"), ("1", "boots")]
    return "\n".join([f"{v}    ## {k}" for v, k in settings] + ["-" * 40, *_SPEC[kind]]) + "\n"


def _run(s, d, kind):
    path = f"{shared_dir(s)}/radloom/tests-{uuid.uuid4().hex}"
    s.range(1).select(F.lit(specification(kind)).alias("value")).coalesce(1).write.text(path)
    return dtests.d_run(s, path, fx.sites(s, d))


def _loci_sql(kind: str) -> str:
    """SQL: sums of pattern weights of each test and locus."""
    roles, which = ROLES[kind], dtests.STATISTICS[kind]
    rows = [(i, r, t) for i, line in enumerate(_SPEC[kind]) for r, name in zip(roles, line.split("##")[0].split(), strict=True) for t in name.strip("[]").split(",")]
    tests = "(values " + ", ".join(f"({i}, '{r}', {t})" for i, r, t in rows) + ") t(test_id, role, taxon)"
    single = ", ".join(str(i) for i, line in enumerate(_SPEC[kind]) if "[" not in line)
    own = ", ".join(f"count(*) filter (role = '{r}') as {r}" for r in roles)
    cnt = f"cnt as materialized (select test_id, xlocus, pos, allele, {own} from haps join {tests} using (taxon) group by 1, 2, 3, 4)"
    top = "(list(allele order by p3 desc, allele) filter (p3 > 0 and o = 0))[1] as derived, null as minor" if kind == "4" else "null as derived, (list(allele order by o desc, allele))[1] as minor"
    lacks = "bool_or((p3a > 0 or p3b > 0) and o = 0)" if kind == "part" else "true"
    alone = " and ".join(f"max({r}) = sum({r})" for r in roles)
    tot = f"tot as (select test_id, xlocus, pos, {', '.join(f'sum({r}) as n_{r}' for r in roles)}, {top}, {lacks} as ok, count(*) = 2 and {alone} as fixed from cnt group by 1, 2, 3 having {' and '.join(f'sum({r}) > 0' for r in roles)})"
    if kind == "4":
        der = "der as (select *, derived as major from tot where derived is not null)"
    else:
        der = f"der as (select t.*, m.major from tot t join (select c.test_id, c.xlocus, c.pos, (list(allele order by {' + '.join(f'c.{r}' for r in roles)} desc, allele))[1] as major from cnt c join tot using (test_id, xlocus, pos) where allele <> tot.minor group by 1, 2, 3) m using (test_id, xlocus, pos) where ok)"
    extra = ", (c.p3a + c.p3b) / (n_p3a + n_p3b) as f_pooled" if kind == "part" else ""
    freq = f"freq as (select test_id, xlocus, {', '.join(f'c.{r} / n_{r} as f_{r}' for r in roles)}{extra} from der join cnt c using (test_id, xlocus, pos) where c.allele = major and (fixed or test_id not in ({single})))"

    def weight(p: str) -> str:
        joint = kind == "part" and p[2:4] == "BB"
        out = [f"f_{r}" if x == "B" else f"(1 - f_{r})" for r, x in zip(roles, p, strict=True) if not (joint and r in ("p3a", "p3b"))]
        return " * ".join(out + ([f"case when test_id in ({single}) then f_p3a * f_p3b else f_pooled end"] if joint else []))

    sums = ", ".join(f"sum({' + '.join(weight(p) for p in side)}) as {s}_{k}" for k, v in which.items() for s, side in zip("lr", v, strict=True))
    columns = [f"{s}_{k}" for k in which for s in "lr"]
    return f"(with {cnt}, {tot}, {der}, {freq} select test_id, xlocus, {', '.join(f'coalesce({c}, 0) as {c}' for c in columns)} from (select distinct test_id, xlocus from sites, (select distinct test_id from {tests})) left join (select test_id, xlocus, {sums} from freq group by 1, 2) using (test_id, xlocus))"


_t = " + ".join(f"(u >= {x!r})::int" for x in introgression.poisson_steps())


def _results_sql(kind: str, boots: bool = False) -> str:
    which = dtests.STATISTICS[kind]
    columns = [f"{s}_{k}" for k in which for s in "lr"]
    parts = []
    for k in which:
        d = f"select test_id, rep, coalesce((sum(t * l_{k}) - sum(t * r_{k})) / nullif(sum(t * l_{k}) + sum(t * r_{k}), 0), 0) as d from drawn group by 1, 2"
        if boots:
            parts.append(f"select test_id, '{k}' as stat, rep::int as rep, round(d, 6) as d from ({d}) where rep > 0")
            continue
        x = f"select test_id, max(case when rep = 0 then d end) as d, stddev_pop(case when rep > 0 then d end) as sd from ({d}) group by 1"
        parts.append(f"select test_id, '{k}' as stat, round(d, 6) as d, round(case when sd < 1e-5 then 0 else sd end, 6) as sd, round(case when sd < 1e-5 then 0 else abs(d / sd) end, 4) as z, round(l, 6) as l, round(r, 6) as r, nloci, round(pdisc, 6) as pdisc from ({x}) join (select test_id, sum(l_{k}) as l, sum(r_{k}) as r, count(*) as nloci, count(*) filter (abs(l_{k} - r_{k}) > 1e-9) / count(*) as pdisc from loci group by 1) using (test_id)")
    draws = f"select *, case when rep = 0 then 1 else {_t} end as t from (select test_id, xlocus, {', '.join(columns)}, rep, ('0x' || substr(md5(rep || '-' || xlocus), 1, 8))::bigint / 4294967296.0::double as u from loci, range(0, 51) r(rep))"
    return f"select * from (with loci as materialized {_loci_sql(kind)}, drawn as materialized ({draws}) {' union all '.join(parts)})"


def _rounded(results):
    return results.select("test_id", "stat", *[F.round(c, 6).alias(c) for c in ("d", "sd", "l", "r", "pdisc")], F.round("z", 4).alias("z"), "nloci")


for _kind, _name in (("4", "d_run"), ("part", "part_d_freq"), ("foil", "dfoil_freq"), ("foilalt", "dfoil_alt_freq")):
    query(_name, _results_sql(_kind), "haps")(lambda s, d, k=_kind: _rounded(_run(s, d, k).results))
query("d_run_boots", _results_sql("4", boots=True), "haps")(lambda s, d: _run(s, d, "4").boots.select("test_id", "stat", "rep", F.round("d", 6).alias("d")))
query("d_run_lists", f"select test_id, 'd' as stat, case when l_d > r_d then 'ABBA' else 'BABA' end as side, xlocus from {_loci_sql('4')} where abs(l_d - r_d) > 1e-9", "haps")(lambda s, d: _run(s, d, "4").lists)
_note = "case test_id when 0 then 'single taxa' else 'a group' end"
query("d_run_lines", f"select test_id, printf('%.3f', d) || chr(9) || printf('%.3f', sd) || chr(9) || printf('%.2f', z) || chr(9) || printf('%.2f', r) || chr(9) || printf('%.2f', l) || chr(9) || nloci || chr(9) || '50' || chr(9) || printf('%.2f', pdisc) || chr(9) || {_note} as text from ({_results_sql('4')})", "haps")(
    lambda s, d: dtests.result_lines(_round_run(_run(s, d, "4")))
)


def _round_run(run):
    """Results as the oracle has them before they are written out."""
    run.results = _rounded(run.results).join(run.results.select("test_id", "stat", "note"), ["test_id", "stat"])
    return run
