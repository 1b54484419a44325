"""The whole analysis as plain SQL for another engine: independent of the Spark plans, slow, and exact on small tables."""

from __future__ import annotations

from hapdiff.functions.permutations import plan
from hapdiff.functions.stats import t_critical
from hapdiff.plans.fixture import GROUPS, POSITIONS_SQL, READS_SQL, SAMPLES

LABELLINGS = [GROUPS, *plan(GROUPS, 10)[0]]
#: The covariate of each sample in the general design that is checked.
COVARIATE = [0.1, 0.7, 0.3, 0.4, 0.2, 0.9]
_COVARIATE = ", ".join(f"('{s}', {v}, {g - 1})" for s, v, g in zip(SAMPLES, COVARIATE, GROUPS, strict=True))
_LABELS = ", ".join(f"({k}, '{s}', {g})" for k, own in enumerate(LABELLINGS) for s, g in zip(SAMPLES, own, strict=True))
_T = ", ".join(f"({d}, {t_critical(d)!r})" for d in range(1, 300))



def _normal(w: str) -> str:
    """The sums of the three normal equations with weight w."""
    terms = {"a": "1", "b": "g", "c": "v", "d": "g*g", "e": "g*v", "f": "v*v", "p": "z", "q": "g*z", "r": "v*z"}
    return ", ".join(f"sum(({w})*{x}) as {name}" for name, x in terms.items())


def _solved() -> str:
    """Their solution by determinants, and v1, the variance of the second unknown."""
    det = "(a*(d*f-e*e) - b*(b*f-e*c) + c*(b*e-d*c))"
    return (
        f"(p*(d*f-e*e) - b*(q*f-e*r) + c*(q*e-d*r))/{det} as x0, (a*(q*f-e*r) - p*(b*f-e*c) + c*(b*r-q*c))/{det} as x1, "
        f"(a*(d*r-q*e) - b*(b*r-q*c) + p*(b*e-d*c))/{det} as x2, (a*f-c*c)/{det} as v1"
    )


STEPS = {
    "cpg": POSITIONS_SQL.format(text="varchar"),
    "reads": READS_SQL.format(text="varchar", cpg="cpg"),
    "numbered": "select *, row_number() over () as rid from reads",
    "mapped": """
select r.*, bad_hap, ok, coalesce(a.ci, 0)+1 as ci_start, coalesce(b.ci, 0) as ci_end
from (select *, not regexp_matches(hap, '^[01]+$') as bad_hap,
             chr is not null and read_start <= read_end and cnt > 0 and strand in ('+','-') and regexp_matches(hap, '^[01]+$') as ok from numbered) r
asof left join cpg a on r.chr = a.chr and r.read_start - 1 >= a.pos
asof left join cpg b on r.chr = b.chr and r.read_end >= b.pos""",
    "flagged": """
select *, ok and ci_end < ci_start as missing_annotation, ok and ci_end >= ci_start and ci_end-ci_start+1 <> length(hap) as length_mismatch,
       ok and ci_end >= ci_start and ci_end-ci_start+1 = length(hap) as mapping_valid, contains(hap, '1') as state from mapped""",
    "loci": """
select sample, e.chr as chr, c.pos as pos, t, s, s/t as m from (
  select sample, chr, ci, sum(cnt) as t, sum(case when state then cnt else 0 end) as s
  from (select sample, chr, cnt, state, unnest(range(ci_start, ci_end+1)) as ci from flagged where mapping_valid) group by all) e
join cpg c on c.chr = e.chr and c.ci = e.ci""",
    "totals": """
select chr, pos, sum(t)/6 as cov_mean, coalesce(sum(t) filter (sample in ('s1','s2','s3')), 0) as t1, coalesce(sum(t) filter (sample in ('s4','s5','s6')), 0) as t2
from loci group by chr, pos""",
    "kept": "select * from totals where t1 > 0 and t2 > 0",
    "parameters": """
select (select quantile_cont(cov_mean, 0.75) from kept) as cov_q75,
       (select avg(d) from (select 30.0*(max(pos)-min(pos)+1)/count(*) as d from kept group by chr)) as density_span""",
    "labels": f"select * from (values {_LABELS}) x(perm_id, sample, g)",
    "rates": """
select * exclude (m1, m2), case when n_covered_group1=1 and n_covered_group2=1 then 1 when n_covered_group1=1 and n_covered_group2>=2 then m2 else m1 end as mad_group1,
       case when n_covered_group1=1 and n_covered_group2=1 then 1 when n_covered_group2=1 and n_covered_group1>=2 then m1 else m2 end as mad_group2
from (select perm_id, chr, pos, k.cov_mean as cov_mean, sum(s) filter (g=1)/nullif(sum(t) filter (g=1), 0) as group1_pooled,
             sum(s) filter (g=2)/nullif(sum(t) filter (g=2), 0) as group2_pooled,
             1.4826*mad(s/t) filter (g=1 and t>0) as m1, 1.4826*mad(s/t) filter (g=2 and t>0) as m2,
             count(*) filter (g=1 and t>0) as n_covered_group1, count(*) filter (g=2 and t>0) as n_covered_group2
      from loci join kept k using (chr, pos) join labels using (sample) group by perm_id, chr, pos, k.cov_mean)""",
    "spread": """
select *, group1_pooled - group2_pooled as beta,
       case when mad_group1 is not null and mad_group2 is not null then greatest(1.4826*sqrt(mad_group1*mad_group1 + mad_group2*mad_group2), 1e-5) end as sd_raw from rates""",
    "blocked": """
select chr, pos, sum(new) over (partition by chr order by pos) as block from (
  select chr, pos, case when pos - lag(pos) over (partition by chr order by pos) <= 2500 then 0 else 1 end as new from kept)""",
    "stats": """
select s.*, block, density_span, case when sd_raw is not null then least(cov_mean, cov_q75)/greatest(sd_raw, 1/greatest(cov_mean, 5)) end as weight, beta/(sd_raw*2/sqrt(6)) as beta_raw_std
from spread s join blocked using (chr, pos), parameters""",
    "bands": """
select perm_id, chr, block, count(*) as n, count(beta) as n_fit, count(*) < 5 or count(beta) < 5 as is_short,
       least(any_value(density_span)/(max(pos)-min(pos)+1), 30.0/count(*), 0.75) as nn from stats group by perm_id, chr, block""",
    "near": """
select a.perm_id as perm_id, a.chr as chr, a.pos as x0, list_sort(list(abs(b.pos-a.pos)))[greatest(1, least(any_value(n_fit), floor(any_value(n_fit)*any_value(nn)+1e-8)))::int] as dk
from stats a join bands w using (perm_id, chr, block) join stats b using (perm_id, chr, block) where not is_short and b.beta is not null
group by a.perm_id, a.chr, a.pos""",
    "parts": """
select a.perm_id as perm_id, a.chr as chr, a.pos as pos, (b.pos-a.pos)/greatest(dk, 1000.0) as u, b.beta as y,
       b.weight*power(1-power(abs((b.pos-a.pos)/greatest(dk, 1000.0)), 3), 3) as w
from stats a join near on near.perm_id=a.perm_id and near.chr=a.chr and near.x0=a.pos
join stats b on b.perm_id=a.perm_id and b.chr=a.chr and b.block=a.block where b.beta is not null and abs(b.pos-a.pos) < greatest(dk, 1000.0)""",
    "moments": """
select perm_id, chr, pos, sum(w) as a, sum(w*u) as b, sum(w*u*u) as c, sum(w*u*u*u) as d, sum(w*u*u*u*u) as e,
       sum(w*y) as f, sum(w*u*y) as g, sum(w*u*u*y) as h from parts group by perm_id, chr, pos""",
    "fitted": "select perm_id, chr, pos, (f*(c*e-d*d) - b*(g*e-d*h) + c*(g*d-c*h))/(a*(c*e-d*d) - b*(b*e-d*c) + c*(b*d-c*c)) as value from moments",
    "signals": """
select s.*, case when is_short then beta_raw_std else value end as signal, not is_short as smoothed
from stats s join bands using (perm_id, chr, block) left join fitted using (perm_id, chr, pos)""",
    "clustered": """
select *, sum(new) over (partition by perm_id, chr order by pos) as cluster from (
  select *, case when pos - lag(pos) over (partition by perm_id, chr order by pos) <= 1000 then 0 else 1 end as new from signals)""",
    "directed": """
select *, case when signal <= -0.1 then -1 when signal >= 0.1 or abs(signal-0.1) <= 1.4901161193847656e-8 then 1 else 0 end as dir,
       case when beta_raw_std <= -0.1 then -1 when beta_raw_std >= 0.1 or abs(beta_raw_std-0.1) <= 1.4901161193847656e-8 then 1 else 0 end as raw_dir
from clustered where signal is not null""",
    "segmented": """
select * exclude (brk), sum(brk) over (partition by perm_id, chr order by pos) as segment from (
  select *, case when lag(cluster) over w = cluster and lag(dir) over w = dir then 0 else 1 end as brk from directed window w as (partition by perm_id, chr order by pos))""",
    "placed": """
select *, row_number() over (partition by perm_id, chr, segment order by pos) as i, count(*) over (partition by perm_id, chr, segment) as n from segmented where dir <> 0""",
    "ends": """
select *, min(case when raw_dir=dir then i end) over (partition by perm_id, chr, segment) as lo, max(case when raw_dir=dir then i end) over (partition by perm_id, chr, segment) as hi from placed""",
    "trimmed": """
select * exclude (i, n), signal*dir as x, row_number() over (partition by perm_id, chr, segment order by pos) as i, count(*) over (partition by perm_id, chr, segment) as n
from ends where not (n > 5 and coalesce(hi-lo+1 >= 5, false)) or i between lo and hi""",
    "peaks": """
select perm_id, chr, segment, any_value(n) as n, arg_min(i, (-x, i)) as mid, max(x) as mx, min(x) as mn, (0.5*(max(x)-min(x))+min(x)+0.75*avg(x))/2 as cut from trimmed group by perm_id, chr, segment""",
    "shapes": """
select t.perm_id as perm_id, t.chr as chr, t.segment as segment, p.n as n, mid, mx, mn,
       min(case when x >= cut and i <= mid then i end) as fi, max(case when x >= cut and i >= mid then i end) as la,
       count(*) filter (i<=mid) as ln, regr_sxx(x, i) filter (i<=mid) as lxx, regr_syy(x, i) filter (i<=mid) as lyy, regr_sxy(x, i) filter (i<=mid) as lxy,
       count(*) filter (i>=mid) as rn, regr_sxx(x, i) filter (i>=mid) as rxx, regr_syy(x, i) filter (i>=mid) as ryy, regr_sxy(x, i) filter (i>=mid) as rxy
from trimmed t join peaks p using (perm_id, chr, segment) group by all""",
    "tt": f"select * from (values {_T}) x(df, tc)",
    "limits0": """
select s.*, case when ln > 4 and lxy > 0 and power(lxy/lxx, 2) > a.tc*a.tc*(lyy-lxy*lxy/lxx)/((ln-2)*lxx)
                 then least(greatest(1, round_even(mid-0.125*n, 0)), greatest(1, mid-2), coalesce(fi, mid)) else 1 end as f0,
            case when rn > 4 and rxy < 0 and power(rxy/rxx, 2) > b.tc*b.tc*(ryy-rxy*rxy/rxx)/((rn-2)*rxx)
                 then greatest(least(n, round_even(mid+0.125*n, 0)), least(n, mid+2), coalesce(la, mid)) else n end as l0
from shapes s left join tt a on a.df = ln-2 left join tt b on b.df = rn-2""",
    "limits": """
select perm_id, chr, segment, n, case when u then f0 else 1 end as f, case when u then l0 else n end as l from (
  select *, n > 5 and ((mn=0 and mx>0) or (mn<>0 and mx/nullif(mn,0) > 4.0/3)) and l0-f0+1 >= 5 as u from limits0)""",
    "candidates": """
select * from (
  select perm_id, chr, min(pos) as start, max(pos) as "end", case when any_value(dir) > 0 then '+' else '-' end as direction, max(abs(signal)) as max_abs_smooth,
         avg(signal) as mean_smooth, count(*) as n_loci, arg_min(block, pos) as block, count(*) filter (smoothed) as n_smoothed
  from trimmed join limits using (perm_id, chr, segment) where i between f and l group by perm_id, chr, segment) where n_loci >= 5""",
    "regions": "select *, concat_ws(':', chr, start, \"end\", direction) as region_id from candidates",
    "sums": """
select perm_id, region_id, sample, sum(s) as s, sum(t) as t from regions r join loci l on l.chr=r.chr and l.pos between r.start and r."end" group by all""",
    "spans": """
select r.*, (select count(*) from cpg c where c.chr=r.chr and c.pos <= r.start-1)+1 as r_start, (select count(*) from cpg c where c.chr=r.chr and c.pos <= r."end") as r_end from regions r""",
    "pairs": """
select perm_id, region_id, sample, read_start, read_end, hap, strand, state, cnt, greatest(0, least(ci_end, r_end)-greatest(ci_start, r_start)+1) as n
from spans r join flagged f on f.chr=r.chr and f.read_start <= r."end" and f.read_end >= r.start where mapping_valid""",
    "squares": "select perm_id, region_id, sample, sum(cnt*n*n) as nsq from pairs where n > 0 group by all",
    "matrices": "select * from sums join squares using (perm_id, region_id, sample)",
    "whole": """
select m.* from matrices m join (select perm_id, region_id from matrices where t > 0 and nsq > 0 group by all having count(*) = 6) using (perm_id, region_id)""",
    "linked": """
select w.*, g, greatest(t*t/nsq, 1) as kappa, asin(greatest(-1, least(1, 2*(s+0.5)/(t+1)-1))) as z from whole w join labels using (perm_id, sample)""",
    "means": "select perm_id, region_id, g, sum(kappa*z)/sum(kappa) as mu from linked group by all",
    "phis": """
select perm_id, region_id, case when sum(kappa-1) <= 1.4901161193847656e-8 then 0.001
       else greatest(0.001, least(0.999, 6*(sum(kappa*power(z-mu, 2))/4 - 1)/sum(kappa-1))) end as phi
from linked join means using (perm_id, region_id, g) group by perm_id, region_id""",
    "weighted": """
select perm_id, region_id, phi, g, sum(kappa/(1+(kappa-1)*phi)) as w, sum(z*kappa/(1+(kappa-1)*phi)) as wz from linked join phis using (perm_id, region_id) group by all""",
    "fits": """
select a.perm_id as perm_id, a.region_id as region_id, a.phi as phi, b.wz/b.w - a.wz/a.w as estimate, (b.wz/b.w - a.wz/a.w)/sqrt(1/a.w+1/b.w) as wald
from weighted a join weighted b on a.perm_id=b.perm_id and a.region_id=b.region_id and a.g=1 and b.g=2""",
    # the normal equations of an intercept, group 2 and a covariate, first weighted by kappa, then by what phi leaves of it
    "design": f"select region_id, kappa, z, v, x.g as g from linked join (values {_COVARIATE}) x(sample, v, g) using (sample) where perm_id = 0",
    "normal1": f"select region_id, {_normal('kappa')} from design group by region_id",
    "solved1": f"select *, {_solved()} from normal1",
    "phi3": """
select region_id, case when sum(kappa-1) <= 1.4901161193847656e-8 then 0.001
       else greatest(0.001, least(0.999, 6*(sum(kappa*power(z-x0-x1*g-x2*v, 2))/3 - 1)/sum(kappa-1))) end as phi
from design join solved1 using (region_id) group by region_id""",
    "normal2": f"select region_id, phi, {_normal('kappa/(1+(kappa-1)*phi)')} from design join phi3 using (region_id) group by region_id, phi",
    "walds": f"select region_id, phi, x1/sqrt(v1) as statistic from (select *, {_solved()} from normal2)",
    # erfc by the series of positive terms of erf: exp(-x*x) * 2/sqrt(pi) * sum of 2^n x^(2n+1) / (2n+1)!!
    "covariate": """
select region_id, statistic, phi, case when x > 6 then 0.0 else 1 - 2/sqrt(pi())*exp(-x*x)*list_sum([exp((2*n+1)*ln(greatest(x, 1e-300)) + 2*n*ln(2.0) - lgamma(2*n+2.0) + lgamma(n+1.0)) for n in range(0, 200)]) end as p_value
from (select *, abs(statistic)/sqrt(2.0) as x from walds)""",
    "tested": """
select r.*, wald, ((select count(*) from fits n where n.perm_id > 0 and abs(n.wald) >= abs(f.wald))+1.0)/((select count(*) from fits where perm_id > 0)+1) as p,
       (select count(*) from fits where perm_id > 0) as null_pool_size
from regions r join fits f using (perm_id, region_id) where r.perm_id = 0""",
    "called": """
select *, least(1, min(p*m/rk) over (order by rk desc rows between unbounded preceding and current row)) as fdr from (
  select *, count(*) over () as m, row_number() over (order by p) as rk from tested)""",
}
NAMES = list(STEPS)


def sql(last: str, select: str) -> str:
    """select over the steps up to `last`."""
    parts = [f"{name} as ({STEPS[name]})" for name in NAMES[: NAMES.index(last) + 1]]
    return f"with {', '.join(parts)} {select}"
