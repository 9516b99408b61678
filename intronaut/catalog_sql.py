"""DuckDB SQL twins of the splicing queries, made of shared common table expressions."""

from __future__ import annotations

from intronaut.sources.derived import EXONS, JUNCTIONS
from intronaut.sources.derived import GROUPS as DERIVED_GROUPS


def _linked(source: str, name: str, extra: str = "") -> str:
    """CTEs ``name``: rows of ``source`` with ``root``, the least id of their component; singletons dropped."""
    on = "x.chrom = y.chrom and x.strand = y.strand and x.island = y.island" + (f" and x.{extra} = y.{extra}" if extra else "")
    return f"""
{name}_reach(id, root) as (
  select id, id from {source}
  union
  select y.id, r.root from {name}_reach r join {source} x on x.id = r.id
  join {source} y on {on} and (x.a = y.a or x.a = y.b or x.b = y.a or x.b = y.b)),
{name}_root as (select id, min(root) as root from {name}_reach group by id),
{name} as (
  select * from (select s.*, r.root, count(*) over (partition by r.root) as members from {source} s join {name}_root r using (id)) where members > 1)"""


J = f"j as ({JUNCTIONS.format(lineitem='lineitem')})"
E = f"exons as ({EXONS.format(sites='supplier, part')})"
POOL = "pool as (select chrom, strand, a, b, cast(sum(n) as bigint) as n from j where strand <> '?' and b - a <= 100000 group by all having sum(n) >= 3)"
ISLANDS = """islands as (
  select chrom, strand, a, b, n, cast(sum(opens) over (partition by chrom, strand order by a, b rows unbounded preceding) as bigint) as island
  from (select *, case when a <= max(b) over (partition by chrom, strand order by a, b rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens from pool))"""
LARGE = """large as (
  select *, row_number() over (order by chrom, strand, a, b) as id
  from (select *, count(*) over w as c, sum(n) over w as t from islands window w as (partition by chrom, strand, island)) where c >= 2 and t >= 30)"""
PARTS = _linked("large", "comp")
KEPT = "kept as (select chrom, strand, island, a, b, n, id, root as parent from (select *, sum(n) over (partition by root) as total from comp) where n / total >= 0.001 and n >= 5)"
AGAIN = _linked("kept", "part2", "parent")
CLU = "clu as (select cast(dense_rank() over (order by chrom, strand, island, parent, root) as bigint) as clu, chrom, strand, a, b, n from part2)"
COUNTS = """counts as (
  select clu, chrom, strand, a, b, sample, n, cast(sum(n) over (partition by clu, sample) as bigint) as tot from (
    select c.clu, c.chrom, c.strand, c.a, c.b, s.sample, cast(coalesce(k.n, 0) as bigint) as n
    from clu c cross join (select distinct sample from j) s
    left join (select sample, chrom, strand, a, b, sum(n) as n from j group by all) k
      on k.sample = s.sample and k.chrom = c.chrom and k.strand = c.strand and k.a = c.a and k.b = c.b))"""
BASE = ", ".join([J, POOL, ISLANDS, LARGE])
CLUSTERS = ", ".join([BASE, PARTS, KEPT, AGAIN, CLU])
ALL = ", ".join([CLUSTERS, COUNTS])
PHEN = ALL + """,
ratio as (select clu, chrom, strand, a, b, sample, case when tot >= 1 then (n + 0.5) / (tot + 0.5) end as ratio from counts where chrom not in ('X', 'Y')),
filled as (select *, coalesce(ratio, avg(ratio) over w) as value from (select *, count(*) over w as m, count(ratio) over w as k from ratio window w as (partition by clu, chrom, strand, a, b)) where m - k <= 0.4 * m window w as (partition by clu, chrom, strand, a, b)),
imputed as (select clu, chrom, strand, a, b, sample, ratio, value from (select *, stddev_pop(value) over (partition by clu, chrom, strand, a, b) as sd from filled) where sd >= 0.005),
scaled as (select *, (value - avg(value) over w) / stddev_pop(value) over w as z from imputed window w as (partition by clu, chrom, strand, a, b))"""
GROUPS = f"groups as ({DERIVED_GROUPS.format(supplier='supplier')})"
TRANSCRIPTS = """transcripts as (
  select chr, start_pos, end_pos, strand, gene_name as gene, gene_name as gene_id, concat('T', gene_name) as transcript, 'protein_coding' as biotype from exons),
known as (
  select chr, end_pos as a, next as b, gene, gene_id, strand, transcript,
         cast(case when strand = '-' then row_number() over (partition by transcript order by end_pos desc, next desc) else row_number() over (partition by transcript order by end_pos, next) end as bigint) as intron_number, biotype
  from (select *, lead(start_pos) over (partition by transcript order by start_pos, end_pos) as next from transcripts) where next > end_pos)"""
MATCHED = """,
votes as (
  select clu, gene, gene_strand, count(*) as n from (
    select c.clu, k.gene, k.strand as gene_strand from clu c join known k on k.chr = c.chrom and k.a = c.a
    union all select c.clu, k.gene, k.strand from clu c join known k on k.chr = c.chrom and k.b = c.b) group by all),
best as (select clu, gene from (select clu, gene, row_number() over (partition by clu order by sum(n) desc, gene) as i from votes group by clu, gene) where i = 1),
strands as (select clu, case when min(gene_strand) = max(gene_strand) then min(gene_strand) end as gene_strand from votes group by clu),
judged as (
  select c.clu, c.chrom, c.a, c.b, c.n, coalesce(best.gene, '.') as gene,
         case when gene_strand is null then 'unknown_strand' when u5 and u3 then 'cryptic_unanchored'
              when (gene_strand = '+' and u3) or (gene_strand = '-' and u5) then 'cryptic_threeprime'
              when u5 or u3 then 'cryptic_fiveprime' when pair then 'annotated' else 'novel annotated pair' end as verdict
  from (select c.*, not exists (select 1 from known k where k.chr = c.chrom and k.a = c.a) as u5, not exists (select 1 from known k where k.chr = c.chrom and k.b = c.b) as u3,
               exists (select 1 from known k where k.chr = c.chrom and k.a = c.a and k.b = c.b) as pair from clu c) c
  left join best using (clu) left join strands using (clu))"""
PVALUES = "pv as (select l_orderkey, l_linenumber, l_suppkey, case when l_orderkey % 9 = 0 then null else least(1.0, round((l_discount + l_tax + 0.001) / 0.2, 6)) end as p from lineitem)"
ANNOTATED = ", ".join([CLUSTERS, E, TRANSCRIPTS]) + MATCHED


def _with(ctes: str, select: str, recursive: bool = True) -> str:
    return f"with {'recursive ' if recursive else ''}{ctes} {select}"


def _polynomial(x: str, c: tuple[float, ...]) -> str:
    out = f"{c[-1]!r}::double"
    for v in c[-2::-1]:
        out = f"({out} * ({x}) + {v!r}::double)"
    return out


def _quantile(p: str) -> str:
    from intronaut.functions.stats import AS241

    ratio = lambda kind, x: f"{_polynomial(x, AS241[kind][0])} / {_polynomial(x, AS241[kind][1])}"
    q, r = f"({p} - 0.5)", f"sqrt(-ln(least({p}, 1.0 - {p})))"
    tail = f"(case when {r} <= 5 then {ratio('near', r + ' - 1.6')} else {ratio('far', r + ' - 5.0')} end)"
    return f"(case when abs({q}) <= 0.425 then {q} * {ratio('central', f'0.180625 - {q} * {q}')} when {q} < 0 then -{tail} else {tail} end)"


CELLS = "clu, chrom, strand, a, b"
SQL: dict[str, str] = {
    "pool_introns": _with(", ".join([J, POOL]), "select * from pool"),
    "overlap_islands": _with(", ".join([J, POOL, ISLANDS]), "select * from islands"),
    "linked_components": _with(", ".join([BASE, PARTS]), "select chrom, strand, island, cast(dense_rank() over (partition by chrom, strand, island order by root) as bigint) as component, a, b, n from comp"),
    "refined_clusters": _with(CLUSTERS, "select * from clu"),
    "constitutive_introns": _with(", ".join([J, POOL, ISLANDS]), "select chrom, strand, a, b, n from (select *, count(*) over (partition by chrom, strand, island) as c from islands) where c = 1 and n >= 30"),
    "perind_counts": _with(ALL, "select * from counts"),
    "perind_numers_wide": _with(ALL, "select intron, " + ", ".join(f"cast(max(n) filter (sample = 'S{i}') as bigint) as S{i}" for i in range(8)) + " from (select *, concat_ws(':', chrom, a, b, concat('clu_', clu, '_', strand)) as intron from counts) group by intron"),
    "perind_ratios_wide": _with(ALL, "select intron, " + ", ".join(f"max(concat(n, '/', tot)) filter (sample = 'S{i}') as S{i}" for i in range(8)) + " from (select *, concat_ws(':', chrom, a, b, concat('clu_', clu, '_', strand)) as intron from counts) group by intron"),
    "library_qc": _with(J, "select sample, count(*) as n_rows, count(distinct chrom) as n_chroms, count(distinct chrom) < max(count(distinct chrom)) over () as flagged from j group by sample"),
    "common_chroms": _with(J, "select chrom from j group by chrom having count(distinct sample) = (select count(distinct sample) from j)"),
    "intron_usage_stats": _with(ALL, f"select {CELLS}, round(avg(u), 9) as mean_usage, round(median(u), 9) as median_usage, round(min(u), 9) as min_usage, round(max(u), 9) as max_usage from (select *, n / (tot + 1) as u from counts) group by {CELLS}"),
    "usage_ratio": _with(ALL, f"select {CELLS}, sample, round(n / nullif(tot, 0), 9) as psi from counts"),
    "phen_ratio": _with(PHEN, f"select {CELLS}, sample, round(ratio, 9) as ratio from ratio"),
    "phen_imputed": _with(PHEN, f"select {CELLS}, sample, round(value, 9) as value from imputed"),
    "phen_zscore": _with(PHEN, f"select {CELLS}, sample, round(z, 6) + 0.0::double as z from scaled"),
    "phen_qqnorm": _with(PHEN + f""",
ranked as (select *, rank() over (partition by sample order by zr) + (count(*) over (partition by sample, zr) - 1) / 2 as r, count(*) over (partition by sample) as m from (select *, round(z, 9) as zr from scaled)),
shifted as (select *, case when m <= 10 then 0.375::double else 0.5::double end as s from ranked),
placed as (select *, (r - s) / (m + 1 - 2 * s) as u from shifted)""", f"select {CELLS}, sample, round({_quantile('u')}, 6) + 0.0::double as q from placed"),
    "phen_ave": _with(PHEN, f"select {CELLS}, round(min(ratio), 9) as min_ratio, round(max(ratio), 9) as max_ratio, round(avg(ratio), 9) as mean_ratio from imputed group by {CELLS}"),
    "exons_distinct": _with(E, "select * from exons", False),
    "transcript_introns": _with(", ".join([E, TRANSCRIPTS]), "select * from known", False),
    "splice_sites": _with(", ".join([E, TRANSCRIPTS]), "select 'five' as side, chr, a as site, a + 1 as site_end, gene, gene_id, strand, transcript, intron_number, biotype from known union all select 'three', chr, b, b + 1, gene, gene_id, strand, transcript, intron_number, biotype from known", False),
    "clusters_to_genes": _with(", ".join([CLUSTERS, E]), """select clu, string_agg(gene_name, ',' order by side, gene_name) as genes from (
      select clu, gene_name, min(side) as side from (
        select clu, gene_name, 0 as side from clu join exons on chrom = chr and b = start_pos union all select clu, gene_name, 1 from clu join exons on chrom = chr and a = end_pos) group by clu, gene_name) group by clu"""),
    "intron_gene_lookup": _with(", ".join([CLUSTERS, E]) + """,
sites as (select chr, site, arg_max(gene_name, struct_pack(x := start_pos, y := end_pos, z := gene_name)) as gene from (select *, unnest([start_pos, end_pos]) as site from exons) group by chr, site)""",
        "select clu, chrom, strand, a, b, n, coalesce(s.gene, e.gene, '?') as gene from clu left join sites s on s.chr = chrom and s.site = a left join sites e on e.chr = chrom and e.site = b"),
    "bh_fdr": _with(PVALUES, """select l_orderkey, l_linenumber, round(p, 9) as p, round(case when p is not null then least(1.0, min(x) over (order by p desc range between unbounded preceding and current row)) end, 9) as q
      from (select *, p * count(p) over () / row_number() over (order by p nulls last) as x from pv)""", False),
    "bonferroni_min": _with(PVALUES, "select l_suppkey, round(least(1.0, min(p) * count(p)), 9) as p_min from pv group by l_suppkey", False),
    "fisher_combined": _with(PVALUES + """,
halves as (select l_suppkey, -sum(ln(p)) as h, count(p) as m from pv group by l_suppkey)""",
        "select l_suppkey, round(sum(exp(-h + k * ln(h) - lgamma(k + 1))), 6) as p_fisher from (select *, unnest(range(m)) as k from halves where m > 0) group by l_suppkey", False),
    "outlier_cluster_p": _with(PVALUES, "select l_suppkey, round(1 - pow(1 - min(p), count(*)), 6) as p_cluster from pv where p is not null group by l_suppkey", False),
    "ds_testability_status": _with(", ".join([ALL, GROUPS]) + """,
cells as (select counts.*, grp from counts join groups using (sample)),
per_intron as (select clu, count(*) as size, count(*) filter (used >= 5) as usable from (select clu, a, b, count(*) filter (n > 0) as used from cells group by clu, a, b) group by clu),
per_sample as (select clu, sample, grp, sum(n) as t from cells group by all),
per_group as (select clu, grp, count(*) filter (t > 0) as seen, count(*) filter (t >= 20) as covered from per_sample group by all),
valid as (select clu, sum(seen) as seen, sum(covered) as covered, count(*) filter (covered >= 4) as g from per_group group by clu)""",
        """select clu, case when size > 10 then 'Too many introns in cluster' when size <= 1 then '<=1 junction in cluster' when seen <= 1 then '<=1 sample with coverage>0'
      when covered <= 1 then '<=1 sample with coverage>min_coverage' when usable < 2 then '<2 introns used in >=min_samples_per_intron samples' when g < 2 then 'Not enough valid samples' end as status from per_intron join valid using (clu)"""),
    "junction_verdict": _with(ANNOTATED, "select clu, chrom, a, b, n, gene, verdict from judged"),
    "cassette_class": _with(ANNOTATED + """,
numbered as (select *, row_number() over (partition by clu order by a, b) as i, count(*) over (partition by clu) as k, round(((n % 7) - 3) / 10.0::double, 1) as d from judged),
three as (select x.clu, x.d as d1, y.d as d2, z.d as d3, x.verdict as v1, y.verdict as v2, z.verdict as v3,
    y.a = least(x.a, y.a, z.a) and y.b = greatest(x.b, y.b, z.b) and x.b <= z.a and x.a = y.a and z.b = y.b as shape
  from numbered x join numbered y on x.clu = y.clu and y.i = 2 join numbered z on z.clu = x.clu and z.i = 3 where x.i = 1 and x.k = 3)""",
        """select c.clu, case when shape then concat(
        case when d1 > 0 and d2 < 0 and d3 > 0 then 'cassette exon - increased' when d1 < 0 and d2 > 0 and d3 < 0 then 'cassette exon - decreased' else '.' end,
        case when v1 = 'annotated' and v2 = 'annotated' and v3 = 'annotated' then ' - annotated' when v2 = 'annotated' and v1 <> 'annotated' and v3 <> 'annotated' then ' - cryptic'
             when v2 = 'novel annotated pair' and v1 = 'annotated' and v3 = 'annotated' then ' - skiptic' else '' end) else '.' end as classification
      from (select distinct clu from judged) c left join three using (clu)"""),
    "cluster_summary": _with(ANNOTATED, """select clu, min(chrom) as chrom, min(a) as first, max(b) as last, count(*) as introns, min(gene) as gene,
      case when bool_or(regexp_matches(verdict, 'cryptic|novel annotated pair')) then 'cryptic' else 'annotated' end as annotation, concat(min(chrom), ':', min(a), '-', max(b)) as coord from judged group by clu"""),
    "intron_summary": _with(ANNOTATED, "select verdict, count(*) as n from judged group by verdict"),
    "plot_coords": _with(CLUSTERS, """select clu, position, round(sum(ln(1 + coalesce(position - lag_position, 0))) over (partition by clu order by position rows unbounded preceding), 6) as coord
      from (select *, lag(position) over (partition by clu order by position) as lag_position from (select clu, a as position from clu union select clu, b from clu))"""),
    "gene_span": _with(E, """select gene_name, first, last, last - first as length, cast(case when last - first > 1000000 then 5000 when last - first > 500000 and last - first < 1000000 then 3000 when last - first > 150000 and last - first <= 500000 then 2000 end as int) as pixels
      from (select gene_name, min(start_pos) as first, max(end_pos) as last from exons group by gene_name)""", False),
    "introns_in_genes": _with(", ".join([CLUSTERS, E]), """select gene_name, chrom, a, b from (select distinct chrom, a, b from clu) c
      join (select gene_name, chr, min(start_pos) as first, max(end_pos) as last from exons group by all) g on g.chr = c.chrom and c.a >= first and c.b <= last"""),
    "exons_near_cluster": _with(", ".join([CLUSTERS, E]), """select s.clu, chr, start_pos, end_pos, strand, gene_name from exons join (select clu, min(chrom) as chrom, min(a) as low, max(b) as high from clu group by clu) s on chr = chrom
      where (start_pos between low and high or end_pos between low and high) and (end_pos - start_pos <= 500 or end_pos = low or start_pos = high)
        and (exists (select 1 from clu c where c.clu = s.clu and c.b = start_pos) or exists (select 1 from clu c where c.clu = s.clu and c.a = end_pos))"""),
    "group_usage": _with(", ".join([ALL, GROUPS]), "select clu, a, b, grp, round(avg(n / nullif(tot, 0)), 9) as mean_psi, cast(sum(n) as bigint) as reads from counts join groups using (sample) group by clu, a, b, grp"),
    "top_clusters": _with(CLUSTERS + ", scored as (select clu, sum(n) as t, 1.0::double / sum(n) as fdr from clu group by clu)", "select clu, round(fdr, 9) as fdr from scored where fdr < 0.01 order by scored.fdr, clu limit 30"),
    "sam_blocks": """with sam as (select l_orderkey, l_linenumber, l_partkey * 10 + 1 as pos, cast(l_quantity as bigint) as q, 60 + l_linenumber * 10 as gap, l_linenumber as k from lineitem)
      select l_orderkey, l_linenumber, pos - 1 as chrom_start, concat_ws(',', case k % 4 when 1 then 10 + 8 when 2 then 10 + 3 + 8 else 10 end, q + 5) as block_sizes, concat_ws(',', 0, gap + case k % 4 when 1 then 18 when 2 then 21 else 10 end) as block_starts from sam""",
    "bed_junctions": """with sam as (select concat('chr', 1 + l_suppkey % 5) as chrom, case when l_linestatus = 'O' then '+' else '-' end as strand, (l_partkey % 50) * 10 as start, 60 + l_linenumber * 10 as gap, case l_linenumber % 4 when 1 then 18 when 2 then 21 else 10 end as size from lineitem)
      select chrom, start + size as "start", start + size + gap as "end", strand, count(*) as n from sam group by all""",
    "spliced_read_filter": "select l_orderkey, l_linenumber from lineitem where cast(l_quantity as int) >= 10 and 40 + l_linenumber * 5 > 50 and cast(l_quantity as int) % 12 >= 6",
}
