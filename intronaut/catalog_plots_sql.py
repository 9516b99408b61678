"""DuckDB SQL twins of the queries over plot tables, result tables and models."""

from __future__ import annotations

import re

from intronaut.catalog_files_sql import FILLED, TESTED
from intronaut.catalog_sql import ALL, ANNOTATED, CLUSTERS, GROUPS, MATCHED, PVALUES, TRANSCRIPTS, E, J, _with
from intronaut.functions.special import digamma, trigamma
from intronaut.sources.derived import CASSETTES, JUNCTIONS, SCATTERED


def _coords(source: str, by: str) -> str:
    """CTE ``coords``: the axis of the introns of each ``by``."""
    return f"""
coords as (select {by}, position, sum(ln(1 + coalesce(position - before, 0))) over (partition by {by} order by position rows unbounded preceding) as coord
  from (select {by}, position, lag(position) over (partition by {by} order by position) as before from (select {by}, a as position from {source} union select {by}, b from {source}))),
totals as (select {by}, max(coord) as total from coords group by {by}),
knots as (select {by}, position as k, coord as c, lead(position) over w as nk, lead(coord) over w as nc, row_number() over w as i from coords window w as (partition by {by} order by position))"""


def _edges(source: str, by: str) -> str:
    """CTE ``arcs``: introns of ``source`` on the axis."""
    return f"""
arcs as (select e.*, x.coord as x0, y.coord as x1, (1 + sqrt(y.coord - x.coord)) * (case when i % 2 = 1 then 1.0::double else -1.0 end) as height, total
  from (select *, dense_rank() over (partition by {by} order by a, b) as i from {source}) e join coords x on x.{by} = e.{by} and x.position = e.a join coords y on y.{by} = e.{by} and y.position = e.b join totals t on t.{by} = e.{by})"""


def _mapped(points: str, by: str) -> str:
    """CTE ``mapped``: places of ``points`` (by, p) on the axis."""
    return f"""
mapped as (select distinct p.{by}, p, case when p < k or nk is null then c else c + (p - k) / (nk - k) * (nc - c) end as x
  from (select distinct * from {points}) p join knots on knots.{by} = p.{by} where (p >= k and (nk is null or p < nk)) or (i = 1 and p < k))"""


INTRONS = "introns as (select distinct clu, a, b from clu)"
DIFF = ", ".join([ALL, GROUPS, INTRONS, _coords("introns", "clu").strip(), _edges("introns", "clu").strip()]) + """,
means as (select clu, a, b, grp, avg(n) as mean_n, avg(n / nullif(tot, 0)) as mean_psi from counts join groups using (sample) group by all),
drawn_arcs as (select * from arcs join means using (clu, a, b) where mean_n <> 0)"""
NEAR = """near as (select s.clu, start_pos, end_pos, strand, gene_name from exons join (select clu, min(chrom) as chrom, min(a) as low, max(b) as high from clu group by clu) s on chr = chrom
      where (start_pos between low and high or end_pos between low and high) and (end_pos - start_pos <= 500 or end_pos = low or start_pos = high)
        and (exists (select 1 from clu c where c.clu = s.clu and c.b = start_pos) or exists (select 1 from clu c where c.clu = s.clu and c.a = end_pos)))"""


def _drawn(source: str, by: str) -> str:
    """CTE ``drawn``: exons of ``source`` on the axis."""
    return f"""
ends as (select {by}, unnest([start_pos, end_pos]) as p from {source}),{_mapped("ends", by)},
drawn as (select {by}, x, xend, min(gene_name) as label from (
    select n.{by}, s.x, greatest(e.x, s.x + 0.5) as xend, n.gene_name from {source} n join mapped s on s.{by} = n.{by} and s.p = start_pos join mapped e on e.{by} = n.{by} and e.p = end_pos) group by all)"""


PLOT = ", ".join([DIFF, E, NEAR]) + "," + _drawn("near", "clu") + """,
sizes as (select clu, gene_name, count(*) as k, case when min(strand) = max(strand) then min(strand) end as strand from near group by all),
principal as (select clu, arg_min(struct_pack(s := strand), struct_pack(k := -k, g := gene_name)).s as strand from sizes group by clu),
free as (select * from (select clu, x as high, max(xend) over (partition by clu order by x, xend rows between unbounded preceding and 1 preceding) as low from drawn) join totals using (clu) where low < high and high - low > 0.025 * total)"""
GENE = ", ".join([TESTED, E]) + """,
genes as (select gene_name, chr, min(start_pos) as first, max(end_pos) as last from exons group by all),
introns as (select gene_name, clu, concat('clu_', clu, '_', strand) as name, a, b, n from clu join genes on chr = chrom and a >= first and b <= last),""" + _coords("introns", "gene_name") + "," + _edges("introns", "gene_name") + """,
known_p as (select clu, p_adjust from tested where clu % 3 > 0),
span as (select gene_name, min(position) as low, max(position) as high, max(coord) as edge from coords group by gene_name),
up as (select *, min(start_pos) over w as k0, max(end_pos) over w as k1 from exons join span using (gene_name) where start_pos < low window w as (partition by gene_name)),
down as (select *, min(start_pos) over w as k0, max(end_pos) over w as k1 from exons join span using (gene_name) where end_pos > high window w as (partition by gene_name)),
extent as (select gene_name, clu, name, min(x0) as "start", max(x1) as "end", min(height) as low, max(height) as high from arcs group by all),
labels as (select *, ("start" + "end") / 2 as middle, row_number() over (partition by gene_name order by ("start" + "end") / 2, clu) as i, min(low) over (partition by gene_name) as least, max(high) over (partition by gene_name) as most from extent left join known_p using (clu))"""
SMOOTH = """
wide as (select clu, a, b, sample, n + 1 as y from counts),
shares as (select clu, a, b, sum(y) / sum(sum(y)) over (partition by clu) as share from wide group by clu, a, b),
taken as (select clu from (select clu, count(distinct (a, b)) as size from counts group by clu) join (select clu, count(*) filter (t >= 20) as covered from (select clu, sample, sum(n) as t from counts group by all) group by clu) using (clu) where size between 2 and 10 and covered >= 2),
cells as (select w.clu, w.a, w.b, sample, y, share, sum(y) over (partition by w.clu, sample) as total, 20 * share as al, 20 - 20 * share as be from wide w join shares using (clu, a, b) join taken on taken.clu = w.clu),
kinds as (select distinct y, total, al, be from cells),
pmf as (select y, total, al, be, k, exp(lgamma(total + 1) - lgamma(k + 1) - lgamma(total - k + 1) + lgamma(k + al) + lgamma(total - k + be) - lgamma(total + al + be) + lgamma(al + be) - lgamma(al) - lgamma(be)) as q from (select *, unnest(range(cast(y as bigint) + 1)) as k from kinds)),
sums as (select y, total, al, be, least(greatest(1 - coalesce(sum(q) filter (k < y), 0), 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double) as hi, least(greatest(sum(q), 2.220446049250313e-16::double), 1 - 2.220446049250313e-16::double) as lo from pmf group by all),
tails as (select clu, a, b, sample, least(1.0::double, 2 * least(hi, lo)) as p, y / total - share as effect from cells join sums using (y, total, al, be))"""
SCALED = ALL + """,
shown as (select clu, a, b, sample, n / nullif(tot, 0) as psi from counts),
centred as (select *, coalesce(psi, m) - m as x from (select *, avg(psi) over w as m, count(psi) over w as k from shown window w as (partition by clu, a, b)) where k >= 8 * 0.6),
usage as (select * from (select *, sqrt(sum(x * x) over (partition by clu, a, b) / 7) as sd from centred) where sd > 0),
z as (select clu, a, b, sample, x / sd as z from usage)"""
TESTABLE = """,
status as (select clu from (
    select clu, count(*) as size, count(*) filter (used >= 5) as usable from (select clu, a, b, count(*) filter (n > 0) as used from counts group by all) group by clu)
  join (select clu, sum(covered) as covered, count(*) filter (covered >= 3) as g from (select clu, grp, count(*) filter (t >= 20) as covered from (select clu, sample, grp, sum(n) as t from counts join groups using (sample) group by all) group by all) group by clu) using (clu)
  where size between 2 and {size} and covered > 1 and usable >= 2 and g >= 2),
used as (select clu, count(*) as k from (select clu, a, b from counts join status using (clu) group by clu, a, b having count(*) filter (n > 0) >= 5) group by clu)"""
FIT = ", ".join([ALL, GROUPS]) + TESTABLE
TWO = """,
two as (
  select clu, a, 0 as b, sample, sum(n) as n
  from (select clu, sample, n, case when a = min(a) over (partition by clu) then 1 else 2 end as a from counts) group by clu, a, sample)"""


def _series(f: str) -> str:
    return re.sub(r"(?<![\w.])(\d[\d.]*(?:e-?\d+)?)D", r"\1::double", f)


def _fitted(rounds: int = 60) -> str:
    """CTE ``fit``: parameters of each cluster by damped Newton steps, the system solved as a diagonal less one product of vectors."""
    change = lambda f: f"list_transform(range(1, k + 1), lambda j: list_sum(list_transform(rows, lambda r: {_series(f('(a[j] + r[j])'))} - {_series(f('a[j]'))})))"
    overall = lambda f: f"list_sum(list_transform(totals, lambda n: {_series(f('s'))} - {_series(f('(s + n)'))}))"
    each = lambda e: f"list_transform(range(1, k + 1), lambda j: {e})"
    lg = lambda x: f"lgamma({x})"
    return SMOOTH.split("cells as")[0] + f"""
obs as (select clu, any_value(k) as k, list(y order by sample) as rows, list(n order by sample) as totals from (
  select clu, sample, count(*) as k, list(y::double order by a, b) as y, sum(y)::double as n from wide join taken using (clu) group by clu, sample) group by clu),
means as (select *, {each("list_sum(list_transform(rows, lambda r: r[j])) / len(rows) + 0.5::double")} as m from obs),
fit as (
  select clu, 0 as i, {each("ln(m[j] / list_sum(m) * 10)")} as trial, {each("0.0::double")} as t, '-inf'::double as v, 0.01::double as damping, false as done, cast(null as double[]) as g, cast(null as double[]) as q, cast(null as double) as z from means
  union all
  select clu, i, case when good then {each("least(greatest(t[j] + least(greatest(u[j] + w[j] * z * list_dot_product(av, u) / (1 - z * list_dot_product(av, w)), -3.0::double), 3.0::double), -20 - ln(k)), 20 - ln(k))")} else t end,
         t, v, case when good or done then damping else greatest(damping * 20, 0.001::double) end, done, g, q, z
  from (
    select *, not done and len(list_filter(e, lambda x: x <= 0)) = 0 and 1 - z * list_dot_product(av, w) > 0 as good
    from (select *, {each("g[j] / e[j]")} as u, {each("av[j] / e[j]")} as w
    from (select *, {each("q[j] + damping * (abs(q[j] - z * av[j] * av[j]) + 1e-6::double) + 1e-9::double")} as e
    from (select *, {each("exp(t[j])")} as av
    from (
      select clu, k, i, better, case when better then trial else t end as t, case when better then nv else v end as v, case when better then ng else g end as g, case when better then nq else q end as q, case when better then nz else z end as z,
             (better and nv - v < 1e-7::double and damping < 0.001::double) or (not better and damping > 1e9) as done,
             case when better then greatest(damping / 5, 1e-7::double) else greatest(damping * 4, 0.001::double) end as damping
      from (select *, coalesce(nv >= v - 1e-9::double and not isnan(nv), false) as better
      from (select *, {each("- a[j] * a[j] * d2[j] - ng[j]")} as nq
      from (select *, {each("a[j] * (d + d1[j])")} as ng
      from (select *, {overall(lg)} + list_sum({change(lg)}) as nv, {overall(digamma)} as d, {overall(trigamma)} as nz, {change(digamma)} as d1, {change(trigamma)} as d2
      from (select *, list_sum(a) as s from (select fit.* exclude (i), i + 1 as i, k, rows, totals, {each("exp(trial[j])")} as a from fit join obs using (clu) where not done and i < {rounds})))))))))))),
ends as (select clu, arg_max(t, i) as t, arg_max(v, i) as v, bool_or(done) as converged from fit group by clu)"""


def _two_categories() -> str:
    """CTEs ``ends``: log posterior and logits of the first category, without and with a group, one concentration for both groups.

    The system of a Newton step is that of the logits, which don't know of each other, bordered by the concentration.
    """
    each = lambda e: f"list_transform(range(1, len(gs) + 1), lambda i: {e})"
    change = lambda f, a, y: each(f"list_sum(list_transform(gs[i], lambda r: {_series(f(f'({a} + {y})'))} - {_series(f(a))}))")
    overall = lambda f: each(f"list_sum(list_transform(gs[i], lambda r: {_series(f('c'))} - {_series(f('(c + r[1] + r[2])'))}))")
    lg = lambda x: f"lgamma({x})"
    return f"""
pairs as (select clu, sample, grp, [coalesce(sum(n) filter (a = 1), 0)::double, coalesce(sum(n) filter (a = 2), 0)::double] as y from two join status using (clu) join groups using (sample) group by all having sum(n) > 0),
given as (
  select clu, false as grouped, [list(y order by sample)] as gs from pairs group by clu
  union all select clu, true, [list(y order by sample) filter (grp = 'A'), list(y order by sample) filter (grp = 'B')] from pairs group by clu),
fit as (
  select clu, grouped, 0 as step, gs, {each("ln((list_sum(list_transform(gs[i], lambda r: r[1])) + 0.5::double) / (list_sum(list_transform(gs[i], lambda r: r[2])) + 0.5::double))")} as e1, ln(10.0::double) as g1,
         cast(null as double[]) as e, cast(null as double) as g, '-inf'::double as v, 0.01::double as damping, false as done, cast(null as double[]) as de, cast(null as double[]) as he, cast(null as double[]) as k, cast(null as double) as dg, cast(null as double) as hg
  from given
  union all
  select clu, grouped, step, gs, case when good then {each("e[i] + least(greatest((de[i] - k[i] * move) / h[i], -3.0::double), 3.0::double)")} else e end, case when good then least(greatest(g + least(greatest(move, -3.0::double), 3.0::double), -20.0::double), 20.0::double) else g end,
         e, g, v, case when good or done then damping else greatest(damping * 20, 0.001::double) end, done, de, he, k, dg, hg
  from (select *, not done and s > 0 and len(list_filter(h, lambda x: x <= 0)) = 0 as good, (dg - list_sum({each("k[i] * de[i] / h[i]")})) / s as move
  from (select *, hd - list_sum({each("k[i] * k[i] / h[i]")}) as s
  from (select *, {each("he[i] + damping * (abs(he[i]) + 1e-6::double) + 1e-9::double")} as h, hg + damping * (abs(hg) + 1e-6::double) + 1e-9::double as hd
  from (
    select clu, grouped, step, gs, case when better then e1 else e end as e, case when better then g1 else g end as g, case when better then nv else v end as v,
           case when better then nde else de end as de, case when better then nhe else he end as he, case when better then nk else k end as k, case when better then ndg else dg end as dg, case when better then nhg else hg end as hg,
           (better and nv - v < 1e-7::double and damping < 0.001::double) or (not better and damping > 1e9) as done,
           case when better then greatest(damping / 5, 1e-7::double) else greatest(damping * 4, 0.001::double) end as damping
    from (select *, coalesce(nv >= v - 1e-9::double and not isnan(nv), false) as better
    from (select *, list_sum(ll) + 0.0001::double * g1 - 0.0001::double * c as nv, {each("c * q[i] * (1 - q[i]) * (u1[i] - u2[i])")} as nde,
                 {each("-(c * c * q[i] * q[i] * (1 - q[i]) * (1 - q[i]) * (t1[i] + t2[i]) + c * q[i] * (1 - q[i]) * (1 - 2 * q[i]) * (u1[i] - u2[i]))")} as nhe,
                 {each("-c * q[i] * (1 - q[i]) * (u1[i] - u2[i] + a1[i] * t1[i] - a2[i] * t2[i])")} as nk,
                 list_sum({each("a1[i] * u1[i] + a2[i] * u2[i] + c * w[i]")}) + 0.0001::double - 0.0001::double * c as ndg,
                 -list_sum({each("a1[i] * u1[i] + a2[i] * u2[i] + c * w[i] + a1[i] * a1[i] * t1[i] + a2[i] * a2[i] * t2[i] + c * c * z[i]")}) + 0.0001::double * c as nhg
    from (select *, {each("l0[i] + l1[i] + l2[i]")} as ll
    from (select *, {overall(lg)} as l0, {change(lg, "a1[i]", "r[1]")} as l1, {change(lg, "a2[i]", "r[2]")} as l2, {overall(digamma)} as w, {overall(trigamma)} as z,
                 {change(digamma, "a1[i]", "r[1]")} as u1, {change(digamma, "a2[i]", "r[2]")} as u2, {change(trigamma, "a1[i]", "r[1]")} as t1, {change(trigamma, "a2[i]", "r[2]")} as t2
    from (select *, {each("c * q[i]")} as a1, {each("c * (1 - q[i])")} as a2
    from (select fit.* exclude (step), step + 1 as step, {each("1 / (1 + exp(-e1[i]))")} as q, exp(g1) as c from fit where not done and step < 60))))))))))),
ends as (select clu, grouped, arg_max(e, step) as e, arg_max(v, step) as v, bool_or(done) as converged from fit group by clu, grouped)"""


# the shares of the smoothed twin, at fitted parameters
AT_FIT = """,
named as (select clu, a, b, row_number() over (partition by clu order by a, b) as j from (select distinct clu, a, b from wide)),
alphas as (select clu, a, b, exp(t[j]) as al, list_sum(list_transform(t, lambda x: exp(x))) as s from named join ends using (clu)),
cells as (select w.clu, w.a, w.b, sample, y, sum(y) over (partition by w.clu, sample) as total, al, s - al as be from wide w join alphas using (clu, a, b)),""" + SMOOTH[SMOOTH.index("\nkinds as"):].replace("y / total - share as effect", "y / total - al / (al + be) as effect, y / total as share, al / (al + be) as mean_share")
SIGNIFICANT = ", ".join([TESTED, E, TRANSCRIPTS]) + MATCHED + ", chosen as (select * from tested where p_adjust <= 0.1)"
CASES = f"cass as ({CASSETTES.format(lineitem='lineitem')})"
FAR = f"far as ({SCATTERED.format(junctions=JUNCTIONS.format(lineitem='lineitem'))})"

SQL: dict[str, str] = {
    "differential_plot_edges": _with(DIFF, "select clu, a, b, grp, i, round(x0, 6) as x0, round(x1, 6) as x1, round(height, 6) as height, round(mean_n, 6) as mean_n from drawn_arcs"),
    "differential_plot_curves": _with(DIFF, """select clu, a, b, grp, cast(t as int) as t,
        round(x0 * pow(1 - u, 4) + 4 * (x0 - 0.1 * total) * u * pow(1 - u, 3) + 3 * (x0 + x1) * pow(u, 2) * pow(1 - u, 2) + 4 * (x1 + 0.1 * total) * pow(u, 3) * (1 - u) + x1 * pow(u, 4), 6) + 0.0::double as x,
        round(4 * (2 * height / 3) * (u * pow(1 - u, 3) + pow(u, 3) * (1 - u)) + 6 * height * pow(u, 2) * pow(1 - u, 2), 6) + 0.0::double as y, round(log10(1 + mean_n) * sin(u * pi()), 6) + 0.0::double as weight
      from (select *, t / 4.0::double as u from (select *, unnest(range(5)) as t from drawn_arcs))"""),
    "cluster_plot_edges": _with(DIFF, "select clu, a, b, grp, i, round(height, 9) as height, round(mean_psi, 9) as mean_psi from arcs join means using (clu, a, b) where mean_psi > 0"),
    "cluster_plot_exons": _with(PLOT, "select clu, round(x, 6) as x, round(xend, 6) as xend, label from drawn"),
    "cluster_plot_arrows": _with(PLOT, """select clu, round(case when strand = '+' then low else (low + high) / 2 end, 6) as x, round(case when strand = '+' then (low + high) / 2 else high end, 6) as xend, strand from free join principal using (clu) where strand is not null"""),
    "gene_plot_edges": _with(GENE, "select gene_name, clu, a, b, i, round(x0, 6) as x0, round(height, 6) as height, coalesce(p_adjust < 0.1, false) as significant, coalesce(cast(p_adjust as varchar), '.') as fdr from arcs left join known_p using (clu)"),
    "gene_plot_outer": _with(GENE, """select gene_name, start_pos, end_pos, 'up' as side, round(-ln(1 + k1 - k0) + (start_pos - k0) / (k1 - k0) * ln(1 + k1 - k0), 6) as x, round(-ln(1 + k1 - k0) + (end_pos - k0) / (k1 - k0) * ln(1 + k1 - k0), 6) as xend from up
      union all select gene_name, start_pos, end_pos, 'down', round(edge + (start_pos - k0) / (k1 - k0) * ln(1 + k1 - k0), 6), round(edge + (end_pos - k0) / (k1 - k0) * ln(1 + k1 - k0), 6) from down"""),
    "gene_plot_labels": _with(GENE, """select gene_name, clu, round("start", 6) as "start", round("end", 6) as "end", round(middle, 6) as middle, concat('clu', chr(10), clu, case when p_adjust is null then '' else concat(chr(10), p_adjust) end) as label,
        round(case when i % 2 = 1 then 0.8 * least else 0.8 * most end, 6) as label_y from labels"""),
    "exon_gaps": _with(E, """select gene_name, low, high from (select gene_name, start_pos as high, max(end_pos) over (partition by gene_name order by start_pos, end_pos rows between unbounded preceding and 1 preceding) as low from exons)
      join (select gene_name, max(end_pos) - min(start_pos) as total from exons group by gene_name) using (gene_name) where low < high and high - low > 0.1 * total""", False),
    "qq_points": _with(PVALUES, "select l_suppkey, round(-log10(p), 9) + 0.0::double as observed, round(-log10((row_number() over (partition by l_suppkey order by p) - 0.5) / count(*) over (partition by l_suppkey)), 9) + 0.0::double as expected from pv where p is not null", False),
    "qq_points_all": _with(PVALUES, "select round(-log10(p), 9) + 0.0::double as observed, round(-log10((row_number() over (order by p) - 0.5) / count(*) over ()), 9) + 0.0::double as expected from pv where p is not null", False),
    "gene_exons": _with(E, "select * from (select chr, start_pos, cast(end_pos + ((start_pos / 100) % 7 + 7) % 7 * 150 as bigint) as end_pos, strand, gene_name from exons) where end_pos - start_pos <= 1000", False),
    "group_sizes": _with(GROUPS, "select grp, count(*) as samples from groups group by grp", False),
    "cluster_sizes": _with(CLUSTERS, "select clu, count(*) as size from clu group by clu"),
    "status_summary": _with(", ".join([ALL, GROUPS]) + """,
cells as (select counts.*, grp from counts join groups using (sample)),
per_intron as (select clu, count(*) as size, count(*) filter (used >= 7) as usable from (select clu, a, b, count(*) filter (n > 0) as used from cells group by clu, a, b) group by clu),
per_group as (select clu, grp, count(*) filter (t > 0) as seen, count(*) filter (t >= 40) as covered from (select clu, sample, grp, sum(n) as t from cells group by all) group by all),
valid as (select clu, sum(seen) as seen, sum(covered) as covered, count(*) filter (covered >= 4) as g from per_group group by clu)""",
        """select case when size > 4 then 'Too many introns in cluster' when size <= 1 then '<=1 junction in cluster' when seen <= 1 then '<=1 sample with coverage>0'
      when covered <= 1 then '<=1 sample with coverage>min_coverage' when usable < 2 then '<2 introns used in >=min_samples_per_intron samples' when g < 2 then 'Not enough valid samples' end as status, count(*) as n from per_intron join valid using (clu) group by 1"""),
    "constitutive_scores": _with(", ".join([CLUSTERS, E, TRANSCRIPTS]) + """,
shared as (select distinct c.clu, c.chrom, c.a, c.b, c.strand, s.transcript from clu c join known s on s.chr = c.chrom and s.a = c.a join known t on t.chr = c.chrom and t.b = c.b and t.transcript = s.transcript)""",
        "select c.clu, c.chrom, c.a, c.b, round(case when total > 0 then own / total else 0 end, 9) as constitutive from (select c.clu, c.chrom, c.a, c.b, (select count(distinct transcript) from shared where shared.clu = c.clu) as total, (select count(distinct transcript) from shared where shared.clu = c.clu and shared.a = c.a and shared.b = c.b) as own from clu c) c"),
    "first_exons": _with(E, "select gene_name, arg_min(chr, start_pos) as chr, min(start_pos) as start_pos from exons group by gene_name", False),
    "outlier_testable": _with(ALL, "select clu from (select clu, count(distinct (a, b)) as size from counts group by clu) join (select clu, count(*) filter (t >= 50) as covered from (select clu, sample, sum(n) as t from counts group by all) group by clu) using (clu) where size between 2 and 6 and covered >= 2"),
    "outlier_fit": _with(ALL + "," + _fitted() + AT_FIT, "select clu, a, b, sample, round(p, 4) as p, round(effect, 4) as effect, round(share, 9) as share, round(mean_share, 4) as mean_share from tails"),
    "outlier_parameters": _with(ALL + "," + _fitted(), "select clu, round(v, 4) as loglik, case when converged then 'Success' else 'timeout' end as status from ends"),
    "outlier_few_rounds": _with(ALL + "," + _fitted(5), "select clu, round(v, 4) as loglik, case when converged then 'Success' else 'timeout' end as status from ends"),
    "outlier_tails": _with(ALL + "," + SMOOTH, "select clu, a, b, sample, round(p, 6) as p, round(effect, 9) as effect from tails"),
    "outlier_clusters": _with(ALL + "," + SMOOTH, "select clu, sample, round(1 - pow(1 - min(p), count(*)), 5) as p from tails group by clu, sample"),
    "design_matrix": _with(GROUPS, "select sample, case when grp = 'A' then 0.0::double else 1.0 end as \"group\", round((age - avg(age) over ()) / stddev_samp(age) over (), 9) as age, (batch = 'b1')::int::double as batchb1 from groups", False),
    "dm_loglik": _with(ALL, """select clu, round(sum(ll), 5) as loglik from (
      select clu, sample, lgamma(12) - lgamma(12 + sum(n)) + sum(lgamma(12.0::double / k + n) - lgamma(12.0::double / k)) as ll from (select *, count(*) over (partition by clu, sample) as k from counts) group by clu, sample) group by clu"""),
    "bb_loglik": _with(ALL, "select clu, a, b, round(sum(lgamma(7 * 0.4::double + n) - lgamma(7 * 0.4::double) + lgamma(7 * 0.6::double + tot - n) - lgamma(7 * 0.6::double) + lgamma(7) - lgamma(7 + tot)), 5) as loglik from counts group by clu, a, b"),
    "bb_fit": _with(", ".join([ALL, GROUPS]) + TWO + TESTABLE.format(size=2).replace("counts", "two") + "," + _two_categories(), """select clu, status, 1 as df, round(h, 3) + 0.0::double as loglr, round(case when h <= 0 then 1 else 1 - (select sum(exp(-h + (i + 0.5::double) * ln(h) - lgamma(i + 1.5::double))) from range(400) t(i)) end, 3) + 0.0::double as p, round(shift, 3) + 0.0::double as deltapsi
      from (select clu, case when bool_and(converged) then 'Success' else 'timeout' end as status, max(v) filter (grouped) - max(v) filter (not grouped) as h, 1 / (1 + exp(-any_value(e[2]) filter (grouped))) - 1 / (1 + exp(-any_value(e[1]) filter (grouped))) as shift from ends group by clu)"""),
    "ds_identities": _with(FIT.format(size=10), "select clu, k - 1 as df, k as introns, true as p_fits, true as sums, true as better from used"),
    "ds_single_concentration": _with(FIT.format(size=10), "select clu, k - 1 as df from used"),
    # even degrees by a finite sum of Poisson terms, odd ones by the complement of a series of the incomplete gamma function
    "chi_square_p": """select x, cast(df as int) as df, round(case when df % 2 = 0 then sum(case when i < df // 2 then exp(-x / 2 + i * ln(x / 2) - lgamma(i + 1)) else 0 end) else 1 - sum(exp(-x / 2 + (i + df / 2.0::double) * ln(x / 2) - lgamma(i + df / 2.0::double + 1))) end, 9) as p
      from (select x, df, unnest(range(200)) as i from (select distinct l_quantity as x, unnest([2 * l_linenumber, 2 * l_linenumber - 1]) as df from lineitem)) group by x, df""",
    "pca_products": _with(SCALED, "select s.sample, t.sample as other, round(sum(s.z * t.z), 4) + 0.0::double as g from z s join z t using (clu, a, b) group by all"),
    "pca_by_group": _with(", ".join([SCALED, GROUPS]), "select grp, round(sum(z * z), 4) as g from z join groups using (sample) group by grp"),
    "phen_covariance": _with(FILLED, "select s.sample, t.sample as other, round(covar_samp(s.value, t.value), 8) + 0.0::double as covariance from ready s join ready t using (clu, chrom, strand, a, b) group by all"),
    "significant_introns": _with(SIGNIFICANT, "select clu, chrom, a, b, gene, verdict, round(deltapsi, 3) as deltapsi from judged join chosen using (clu) join effects using (clu, a, b)"),
    "significant_clusters": _with(SIGNIFICANT, """select clu, concat(min(chrom), ':', min(a), '-', max(b)) as coord, min(gene) as gene, case when bool_or(regexp_matches(verdict, 'cryptic|novel annotated pair')) then 'cryptic' else 'annotated' end as annotation,
        min(df) + 1 as N, min(p_adjust) as FDR from judged join chosen using (clu) where p_adjust < 0.1 group by clu"""),
    "annotation_counts": _with(SIGNIFICANT, """select annotation, count(*) as n from (select clu, case when bool_or(regexp_matches(verdict, 'cryptic|novel annotated pair')) then 'cryptic' else 'annotated' end as annotation from judged join chosen using (clu) group by clu) group by annotation"""),
    "intron_letters": _with(TESTED, "select clu, a, b, chr(cast(96 + row_number() over (partition by clu order by abs(deltapsi) desc, a, b) as int)) as label from effects"),
    "browser_links": _with(CLUSTERS, """select clu, concat('http://genome.ucsc.edu/cgi-bin/hgTracks?', ['&org=human', '&org=mouse', ''][clu % 3 + 1], '&db=', ['hg38', 'mm10', 'dm6'][clu % 3 + 1], '&position=', min(chrom), ':', min(a) - 100, '-', max(b) + 100) as url from clu group by clu"""),
    "intron_meta": _with(CLUSTERS, """select chrom as chr, a as "start", b as "end", concat('clu_', clu) as clu, (a + b) * 0.5::double as middle from clu"""),
    "usage_models": """with x as (select l_orderkey, l_linenumber, l_tax * 10 as x from lineitem), s as (select *, exp(x) / sum(exp(x)) over (partition by l_orderkey) as softmax, count(*) over (partition by l_orderkey) as k from x)
      select l_orderkey, l_linenumber, round(1 / (1 + exp(0.4::double - x)), 9) as logistic, round(softmax, 9) as softmax, round((softmax - 1 / k) * 5, 9) + 0.0::double as real from s""",
    "text_helpers": """select s_suppkey, s_name as line, concat('<i>', s_name, '</i>') as tagged, s_name as plain, round(case when s_acctbal = 0 then 0 else round(s_acctbal / e) * e end, 4) as two_digits, case when s_suppkey % 3 > 0 then regexp_replace(cast(round(s_suppkey / 8, 3) as varchar), '^$', '') else '.' end as shown
      from (select *, pow(10.0::double, floor(log10(abs(s_acctbal))) - 1) as e from supplier)""",
    "constitutive_scattered": _with(FAR + """,
pool as (select chrom, strand, a, b, cast(sum(n) as bigint) as n from far where b - a <= 100000 group by all having sum(n) >= 3),
islands as (select *, sum(opens) over (partition by chrom, strand order by a, b rows unbounded preceding) as island from (select *, case when a <= max(b) over (partition by chrom, strand order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from pool))""",
        "select chrom, strand, a, b, n from (select *, count(*) over (partition by chrom, strand, island) as c from islands) where c = 1 and n >= 30", False),
    "library_qc_flagged": _with(J, "select sample, count(*) as n_rows, count(distinct chrom) as n_chroms, count(distinct chrom) < max(count(distinct chrom)) over () as flagged from (select sample, case when sample in ('S1', 'S4', 'S6') and chrom = 'chr3' then 'chr2' else chrom end as chrom from j) group by sample", False),
    "common_chroms_partial": _with(J, "select chrom from (select sample, case when sample = 'S2' and chrom in ('chr1', 'chr4') then 'chr2' else chrom end as chrom from j) group by chrom having count(distinct sample) = (select count(distinct sample) from j)", False),
    "gene_span_wide": _with(E, """select gene_name, first, last, last - first as length, cast(case when last - first > 1000000 then 5000 when last - first > 500000 and last - first < 1000000 then 3000 when last - first > 150000 and last - first <= 500000 then 2000 end as int) as pixels
      from (select gene_name, min(start_pos) as first, max(end_pos + (start_pos - 1) % 1000 * 1500 + start_pos) as last from exons group by gene_name)""", False),
    "cassette_shapes": _with(CASES + """,
numbered as (select *, row_number() over (partition by clu order by a, b) as i, count(*) over (partition by clu) as k from cass),
three as (select x.clu, x.deltapsi as d1, y.deltapsi as d2, z.deltapsi as d3, x.verdict as v1, y.verdict as v2, z.verdict as v3,
    y.a = least(x.a, y.a, z.a) and y.b = greatest(x.b, y.b, z.b) and x.b <= z.a and x.a = y.a and z.b = y.b as shape
  from numbered x join numbered y on x.clu = y.clu and y.i = 2 join numbered z on z.clu = x.clu and z.i = 3 where x.i = 1 and x.k = 3)""",
        """select c.clu, case when shape then concat(
        case when d1 > 0 and d2 < 0 and d3 > 0 then 'cassette exon - increased' when d1 < 0 and d2 > 0 and d3 < 0 then 'cassette exon - decreased' else '.' end,
        case when v1 = 'annotated' and v2 = 'annotated' and v3 = 'annotated' then ' - annotated' when v2 = 'annotated' and v1 <> 'annotated' and v3 <> 'annotated' then ' - cryptic'
             when v2 = 'novel annotated pair' and v1 = 'annotated' and v3 = 'annotated' then ' - skiptic' else '' end) else '.' end as classification
      from (select distinct clu from cass) c left join three using (clu)""", False),
}
