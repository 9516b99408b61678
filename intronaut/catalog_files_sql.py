"""DuckDB SQL twins of the queries over text formats: what a file must give back."""

from __future__ import annotations

from intronaut.catalog_sql import ALL, CLUSTERS, COUNTS, GROUPS, ISLANDS, PHEN, POOL, TRANSCRIPTS, E, J, _with

ID = "concat_ws(':', chrom, a, b, concat('clu_', clu, '_', strand))"
DOT = "concat('RNA.', sample, '_CEU.chr1.bam')"
BED = J + """,
made as (select case when a % 17 = 0 then concat('Un_', chrom) else chrom end as chrom, case when b % 7 = 0 then '?' else strand end as strand, sample, a, b, n from j where a % 13 <> 0 and a % 19 <> 0),
bed as (select * from made where chrom not like 'Un%')"""
GTF = E + """,
gtf as (select chr, start_pos, end_pos, strand, gene_name as gene_id, case when start_pos % 7 <> 0 then concat('N', gene_name) end as name, case when start_pos // 100 % 5 = 0 then null when start_pos // 100 % 5 = 1 then 'TX' else concat('T', gene_name) end as transcript, start_pos * 10 + cast(substr(chr, 4) as bigint) as line,
    case when end_pos % 3 = 0 then 'lnc' when end_pos // 100 % 4 = 0 then 'coding' else 'Unknown' end as biotype, case when end_pos % 11 = 0 then 'CDS' else 'exon' end as feature, end_pos % 3 = 0 as lnc, end_pos // 100 % 4 = 0 as coding from exons)"""
TESTED = CLUSTERS + """,
tested as (select clu, cast(count(*) - 1 as bigint) as df, round(1.0::double / sum(n), 6) as p, round(0.001::double + least(0.9::double, 9.0::double / sum(n)), 3) as p_adjust from clu group by clu),
effects as (select clu, a, b, round(psi, 6) as baseline, round(1 - psi, 6) as perturbed, round(1 - 2 * psi, 6) as deltapsi from (select *, n / sum(n) over (partition by clu) as psi from clu))"""
OUTLIERS = ALL + f""",
shares as (select *, round(n / (tot + 1), 6) as share, round((n + 1) / (tot + 2), 6) as p from counts),
cells as (select clu, {DOT} as sample, p, round(share - 0.25::double, 6) as effect, share from shares),
per as (select clu, sample, min(p) as p from cells group by all)"""
FILLED = PHEN + """,
ready as (select clu, chrom, strand, a, b, sample, round(ratio, 9) as ratio, round(value, 9) as value, concat_ws(':', chrom, a, b, concat('clu_', clu)) as id from imputed)"""
BLOCKS = """sam as (select l_orderkey, l_linenumber, concat('chr', 1 + l_suppkey % 5) as chrom, case when l_linestatus = 'O' then '+' else '-' end as strand, l_partkey * 10 as start, cast(l_quantity as bigint) as q, 60 + l_linenumber * 10 as gap,
    case l_linenumber % 4 when 1 then 18 when 2 then 21 else 10 end as size from lineitem)"""

SQL: dict[str, str] = {
    "bed12_file": _with(BED, "select chrom, strand, sample, a, b, n from bed", False),
    "bed12_pooled": _with(BED, "select chrom, strand, a, b, cast(sum(n) as bigint) as n from bed where strand <> '?' and b - a <= 3000 group by all having sum(n) >= 3", False),
    "junction_file": _with(J, "select chrom, strand, a, b, n from j", False),
    "manifest_file": _with(J, "select sample, 'NA' as strand, count(*) as n_rows, cast(sum(n) as bigint) as n from j where sample < 'S5' group by sample", False),
    "cluster_file": _with(CLUSTERS, "select * from clu"),
    "quantified_clusters": _with(ALL, "select clu, sample, count(*) as introns, cast(sum(n) as bigint) as n, max(tot) as tot from counts group by clu, sample"),
    "pooled_file": _with(", ".join([J, POOL, ISLANDS]), "select concat(chrom, ':', strand, ' ', string_agg(concat(a, ':', b, ':', n), ' ' order by a, b)) as value from islands group by chrom, strand, island having count(*) > 1"),
    "count_file": _with(ALL, f"select concat('clu_', clu, '_', strand) as clu, chrom, a, b, {DOT} as sample, n, tot from counts"),
    "numers_file": _with(ALL, f"select {ID} as id, {', '.join(f"max(n) filter (sample = 'S{i}') as S{i}" for i in range(8))} from counts group by all"),
    "matrices_file": _with(ALL, f"select {ID} as id, sample, case when clu % 2 = 0 then cast(n as varchar) else concat(n, '/', tot) end as value from counts where clu % 2 = 0 or sample in ('S0', 'S2', 'S4', 'S6')"),
    "sample_files": _with(ALL, f"select sample, concat({ID}, ' ', n, '/', tot) as value from counts union all select distinct sample, concat('chrom ', sample) from j"),
    "sample_files_order": _with(ALL, f"""select sample, value, rank() over (partition by sample order by k nulls first, x, y) as place from (
      select sample, chrom as k, cast(a as varchar) as x, cast(b as varchar) as y, concat({ID}, ' ', n, '/', tot) as value from counts
      union all select distinct sample, null, null, null, concat('chrom ', sample) from j)"""),
    "groups_file": f"with {GROUPS} select sample, grp, cast(age as varchar) as x1, batch as x2 from groups",
    "exons_file": _with(E, "select * from exons", False),
    "gtf_exons": _with(GTF, "select distinct chr, start_pos, end_pos, strand, coalesce(name, gene_id) as gene_name from gtf where feature = 'exon'", False),
    "gtf_features": _with(GTF, "select distinct chr, start_pos, end_pos, strand, coalesce(name, gene_id) as gene_name from gtf where feature = 'CDS'", False),
    "gtf_transcripts": _with(GTF, "select chr, start_pos, end_pos, strand, coalesce(name, gene_id) as gene, gene_id, transcript, biotype from (select *, first(struct_pack(c := chr, s := strand, g := gene_id)) over (partition by transcript order by line) as head from gtf where feature = 'exon' and transcript is not null) where head.c = chr and head.s = strand and head.g = gene_id", False),
    "gtf_attributes": _with(GTF, """select chr, start_pos as "start", end_pos as "end", concat_ws(',', 'exon_number', case when coding then 'gene_biotype' end, 'gene_id', 'gene_name', 'tag', case when transcript is not null then 'transcript_id' end, case when lnc then 'transcript_type' end) as keys, 'x,y' as tags, gene_id from gtf""", False),
    "gtf_site_genes": _with(GTF, "select chr, site, arg_max(gene_id, line) as gene from (select *, unnest([start_pos, end_pos]) as site from gtf where feature = 'exon') group by chr, site", False),
    "annotation_introns_file": _with(", ".join([E, TRANSCRIPTS]), "select * from known", False),
    "annotation_sites_file": _with(", ".join([E, TRANSCRIPTS]), "select 'fiveprime' as side, chr, a, a + 1 as b, gene, transcript, intron_number from known union all select 'threeprime', chr, b, b + 1, gene, transcript, intron_number from known", False),
    "result_bundle": _with(", ".join([CLUSTERS, E]), "select chrom, introns, n, exons from (select chrom, count(*) as introns, cast(sum(n) as bigint) as n from clu group by chrom) join (select chr as chrom, count(*) as exons from exons group by chr) using (chrom)"),
    "bed_file": _with(BLOCKS, """select concat_ws(chr(9), chrom, start, start + size + gap + q + 5, concat(l_orderkey, ':', l_linenumber), 1, strand, start, start + size + gap + q + 5, 0, 2, concat(size, ',', q + 5), concat('0,', size + gap)) as value from sam""", False),
    "significance_file": _with(TESTED, "select clu, 'Success' as status, df, p_adjust, least, most from tested join (select clu, min(baseline) as least, max(perturbed) as most from effects group by clu) using (clu)"),
    "outlier_files": _with(OUTLIERS, """select 'pVals' as file, sample, count(*) as k, round(sum(p), 4) as total from cells group by sample union all select 'effSize', sample, count(*), round(sum(effect), 4) from cells group by sample
      union all select 'clusterPvals', sample, count(*), round(sum(p), 4) from per group by sample union all select 'test', sample, count(*), round(sum(share), 4) from cells group by sample
      union all select 'controlMean', 'all', count(*), round(0.25 * count(*), 4) from clu"""),
    "phenotype_files": _with(FILLED, 'select chrom as chr, a as "start", b as "end", id, sample, value from ready'),
    "phenotype_summary_files": _with(FILLED, """select 'ave' as file, concat_ws(' ', id, round(min(ratio), 6), round(max(ratio), 6), round(avg(ratio), 6)) as line from ready group by id
      union all select 'prepare', unnest([concat('bgzip -f ratios.qqnorm_', chrom), concat('tabix -p bed ratios.qqnorm_', chrom, '.gz')]) from (select distinct chrom from ready) union all select 'PCs', '16'"""),
    "phenotype_blacklist": _with(ALL, "select chrom, count(*) as cells, count(*) filter (tot >= 1) as known from counts where chrom not in ('chr2', 'chr5') group by chrom"),
    "cluster_genes_file": _with(", ".join([CLUSTERS, COUNTS, E]) + """,
sites as (select chr, site, arg_max(gene_name, struct_pack(x := start_pos, y := end_pos, z := gene_name)) as gene from (select *, unnest([start_pos, end_pos]) as site from exons) group by chr, site),
used as (select clu, chrom, strand, a, b, min(n / (tot + 1)) as low, max(n / (tot + 1)) as high from counts group by all)""",
        "select clu, chrom, a, b, coalesce(s.gene, e.gene, '?') as gene, round(low, 2) as min_usage, round(high, 2) as max_usage from used left join sites s on s.chr = chrom and s.site = a left join sites e on e.chr = chrom and e.site = b"),
    "sam_flags": "select l_orderkey, l_linenumber, " + ", ".join(f"(l_orderkey >> {i}) & 1 = 1 as {n}" for i, n in enumerate(("paired", "proper", "unmapped", "mate_unmapped", "reverse", "mate_reverse", "first_read"))) + " from lineitem",
    "sam_tags": """select concat(l_orderkey, ':', l_linenumber) as qname, own as read_strand, case l_linenumber % 4 when 0 then '-' when 3 then own else '+' end as rna_strand, cast(case when l_suppkey % 3 = 0 then l_suppkey else 0 end as int) as score, l_partkey % 2 = 0 as "unique"
      from (select *, case when (l_orderkey >> 4) & 1 = 1 then '-' else '+' end as own from lineitem)""",
    "read_selection": "select concat(l_orderkey, ':', l_linenumber) as qname, cast(case when (l_orderkey >> 6) & 1 = 1 then 1 else 2 end as int) as mate from lineitem where l_partkey % 2 = 0 and (l_orderkey >> 2) & 1 = 0 and l_orderkey & 1 = 1",
}
