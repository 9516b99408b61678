"""Decontamination, mixing, WARC, URL filters and licences: SQL twins, round trips, brute force, edge cases."""

import glob
import os
import random
import re
from collections import Counter
from datetime import date

import duckdb
import pandas as pd
import pytest

from intronaut.scratch import materialize
from intronaut.llm import decontaminate, licenses, mixing, queries, url_filter, warc

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def normal(df, columns):
    clean = lambda v: None if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return Counter(tuple(clean(v) for v in r) for r in df[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    mine, other = queries.queries()[name](spark, SF).toPandas(), duck.sql(queries.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(other.columns)
    assert normal(mine, sorted(mine.columns)) == normal(other, sorted(mine.columns))


WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def hits(docs, items, window):
    split = lambda t: WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    wins = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            for k in range(max(1, len(w) - window + 1)):
                wins.setdefault(tuple(w[k : k + window]), set()).add(str(i))
    out = []
    for a, t in docs:
        w, hit, found = split(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        out.append((a, len(w), len(hit), tuple(sorted(found)), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return Counter(out)


@pytest.mark.parametrize("block", [20_000, 3])
def test_contaminated_words_equal_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rnd = random.Random(4)
    word = lambda: f"w{rnd.randrange(40)}"
    items = [(1, " ".join(word() for _ in range(20))), (2, "It's  a-b É\\x 'q"), (3, None), (4, "?!"), (None, "w1 w2"), (5, "w7 w7"), (6, " ".join(["rare", *(word() for _ in range(13))])), (6, "other text of six"), (7, " ".join(["w1"] * 15))]
    docs = [(1, None), (2, ""), (3, "W7,w7;w7"), (4, items[0][1].upper()), (5, "it S A b é\\X q"), (6, " ".join(word() for _ in range(3000)) + " " + items[0][1]), (7, " ".join(["w1"] * 40)), (7, "again w7 w7"), (None, items[6][1]), (8, "w7 w7"), (8, "w7 w7")]
    frames = spark.createDataFrame([(*d, "w") for d in docs], "doc_id long, text string, word string"), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, size int")
    got = decontaminate.contaminated_words(*frames, 13).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in got) == hits(docs, items, 13)
    assert decontaminate.contaminated_words(frames[0], frames[1].limit(0)).where("n_hit > 0").count() == 0
    assert decontaminate.contaminated_words(frames[0].limit(0), frames[1]).count() == 0


def test_mixing_meets_targets(spark):
    rnd, rows = random.Random(6), []
    for s, n in (("a", 400), ("b", 100), ("c", 30), ("Z", 300), (None, 50)):
        rows += [(len(rows) + k, " ".join("x" * rnd.choice([1, 5, 40, 200])), s, "t") for k in range(n)]
    rows += [(9000, None, "a", "t"), (9001, "", "void", "t"), (None, "x y", "a", "t"), (1, "x y", "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string").repartition(5)
    got = mixing.mix_sources(docs).toPandas()
    total, own = got["size"].sum(), got.groupby("source", dropna=False)["size"].sum()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"), most=("size", "max"))
    assert abs(by.target.sum() - total) < 1e-6 * total
    assert (by.target <= 3 * own + 1e-6).all() and ((by.taken - by.target).abs() <= 3 * by.most).all()
    again = mixing.mix_sources(docs.repartition(2)).toPandas()
    assert Counter(map(tuple, got[["doc_id", "size", "taken"]].fillna(-1).to_numpy())) == Counter(map(tuple, again[["doc_id", "size", "taken"]].fillna(-1).to_numpy()))
    copies = mixing.emitted(docs).groupBy("doc_id").count().toPandas().set_index("doc_id")["count"]
    assert copies.max() <= 6 and abs(copies.sum() - got.copies.sum()) <= 2
    assert mixing.mix_sources(docs.limit(0)).count() == 0


def test_warc_round_trip(spark):
    rows = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (None, "u", "only"), (None, "u", "<p>é</p>"), (6, "u", "line\r\n\r\nWARC/1.1\r\n"), (2, "again", "other"), (1, "http://a/", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = warc.scratch_path(spark, "warc-test")
    index = warc.write_archives(pages, folder)
    got = warc.read_archives(index, folder).collect()
    assert len(got) == len(rows) == index.count()
    payload = {r.payload_digest: bytes(r.payload) for r in got if r.record_type == "response"}
    assert Counter((r.page_id, payload[r.payload_digest]) for r in got) == Counter((p, (h or "").encode()) for p, _, h in rows)
    assert all(r.payload_bytes == len(payload[r.payload_digest]) for r in got)
    assert {r.page_id: r.refers_to for r in got if r.record_type == "revisit"} == {2: 1, 4: 3, None: 1}
    some = warc.read_archives(index.where("page_id in (5, 6)"), folder).collect()
    assert {r.page_id for r in some} == {5, 6}
    assert warc.round_trip(pages.limit(0)).count() == 0
    least = warc.write_archives(pages, least_bytes=5)
    assert {r.page_id for r in least.where("record_type = 'revisit'").collect()} == {2, None}


def test_warc_records_are_whole(spark):
    """Mandatory fields, ids that never repeat, blocks that are HTTP responses."""
    import gzip
    from pathlib import Path

    rows = [(1, "http://a/", "same"), (1, "http://a/", "same"), (2, "http://b/", "same"), (None, None, None)]
    folder = warc.scratch_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), folder, dated="2024-01-31T12:00:00Z").collect()
    records = [warc.parse(gzip.decompress(Path(r.file).read_bytes()[r.offset : r.offset + r.length])) for r in index]
    assert len({f["WARC-Record-ID"] for f, _ in records}) == len(rows)
    assert all({"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length", "Content-Type"} <= set(f) for f, _ in records)
    assert all(b.startswith(b"HTTP/1.1 200 OK\r\n") and f["WARC-Date"] == "2024-01-31T12:00:00Z" for f, b in records)
    assert [(f["WARC-Refers-To-Target-URI"], b.endswith(b"\r\n\r\n")) for f, b in records if f["WARC-Type"] == "revisit"] == [("http://a/", True)]


def test_ranges_are_coalesced():
    gap = warc.GAP_BYTES
    assert warc.ranges([(0, 10), (10, 10), (20 + gap, 5), (26 + 2 * gap, 5)]) == [(0, 3, 0, 25 + gap), (3, 4, 26 + 2 * gap, 31 + 2 * gap)]


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_url_filters_follow_the_list_in_time(spark, broadcast, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", broadcast)
    entries = [("bad.org", "add", date(2024, 1, 10)), ("bad.org", "remove", date(2024, 2, 1)), ("BAD.org", "add", date(2024, 3, 1)), ("x.ok.org/p/q", "add", date(2024, 1, 1)), ("bad.org", "add", date(2024, 1, 12)), ("late.org", "remove", date(2024, 1, 5)), (None, "add", date(2024, 1, 1)), ("null.org", "add", None), ("tie.org", "add", date(2024, 1, 1)), ("tie.org", "remove", date(2024, 1, 1)), ("a.bad.org", "add", date(2024, 1, 1)), ("Case.org/Foo", "add", date(2024, 1, 1))]
    asks = [(1, "http://www.BAD.org/x", date(2024, 1, 9), False), (2, "http://www.bad.org:80/x", date(2024, 1, 10), True), (3, "http://bad.org", date(2024, 2, 1), False), (4, "https://u@bad.org/#f", date(2024, 3, 5), True), (5, "http://notbad.org/", date(2024, 1, 15), False), (6, "http://x.ok.org/p/q/r?z", date(2024, 1, 2), True), (7, "http://x.ok.org/p/qq", date(2024, 1, 2), False), (8, None, date(2024, 1, 15), False), (9, "no url", date(2024, 1, 15), False), (10, "http://bad.org/", None, False), (11, "http://tie.org/", date(2024, 5, 1), False), (12, "http://a.bad.org/", date(2024, 1, 15), True), (2, "http://www.bad.org:80/x", date(2024, 1, 10), True), (13, "http://case.ORG/Foo/a", date(2024, 1, 2), True), (14, "http://case.org/foo/a", date(2024, 1, 2), False), (15, "http://bad.org./y", date(2024, 1, 15), True), (16, "http://case.org./Foo", date(2024, 1, 2), True), (17, "http://./Foo", date(2024, 1, 2), False)]
    captures = spark.createDataFrame([(*a, "k") for a in asks], "page_id long, url string, fetched_at date, want boolean, key string")
    listed = spark.createDataFrame([(*e, "s") for e in entries], "pattern string, action string, dated date, since string")
    got = url_filter.filter_urls(captures, listed).collect()
    assert Counter((r.page_id, r.blocked) for r in got) == Counter((a[0], a[3]) for a in asks)
    assert {r.pattern for r in got if r.page_id == 12} == {"a.bad.org"} and {r.since for r in got if r.page_id == 2} == {date(2024, 1, 10)}
    assert url_filter.filter_urls(captures.limit(0), listed).count() == 0
    assert url_filter.filter_urls(captures, listed.limit(0)).where("blocked").count() == 0


def test_captures_without_a_url_are_not_joined(spark):
    """One URL and no URL, a third of the rows each: rows without one stay out of the shuffle, the others come out once each."""
    rows = spark.range(60_000).selectExpr("id as page_id", "case when id % 3 = 0 then null when id % 3 = 1 then 'http://bad.org/' else concat('http://h', id, '.org/') end as url", "date'2024-01-15' as fetched_at")
    rows = materialize(rows, "captures")
    listed = spark.createDataFrame([("bad.org", "add", date(2024, 1, 10))], "pattern string, action string, dated date")
    got = url_filter.filter_urls(rows, listed)
    assert got.groupBy("blocked").count().orderBy("blocked").collect() == [(False, 40_000), (True, 20_000)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(url), IsNotNull(fetched_at)]") == 1 and "PushedFilters: [Or(IsNull(url),IsNull(fetched_at))]" in plan


def test_short_items_write_no_context(spark):
    """An item of one word is settled by the word itself, one of two by the word beside it."""
    docs = spark.createDataFrame([(1, "a b c d e f g " * 50), (2, "x a y"), (3, "e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a"), (2, "e f")], "item_id long, text string")
    windows, _ = decontaminate.item_windows(items, 13)
    keys = decontaminate.prefixes(docs, windows).select("key", "before", "after").distinct()
    found = decontaminate.places(docs.withColumn("row", docs.doc_id), keys).where("place >= 0").collect()
    assert len(found) == 102 and max(len(r.context) for r in found) == 2 and {len(r.context) for r in found if r.key == "a"} == {1}
    got = {r.doc_id: (r.n_hit, r["items"]) for r in decontaminate.contaminated_words(docs, items).collect()}
    assert got == {1: (150, ["1", "2"]), 2: (1, ["1"]), 3: (2, ["2"])}


def test_licences_are_found_and_inherited(spark):
    filler = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, "r/LICENSE", "Released under the MIT License."), (2, "r/a/x.py", filler), (3, "r/a/b/LICENSE.txt", f"{filler}\nLicensed under the Apache License, Version 2.0."), (4, "r/a/b/y.py", "text"), (5, "r/a/b/c/z.py", None), (6, "r/a/own.py", f"# Licensed under CC BY-NC 4.0\n{filler}"), (7, "s/x.py", "a license of some kind"), (8, None, "text"), (9, "top.py", ""), (4, "r/a/b/y.py", "text"), (10, "r/a/COPYING", "nothing")]
    files = spark.createDataFrame([(*r, "w", 1.0) for r in rows], "file_id long, path string, text string, license string, cosine double")
    got = licenses.scan_licenses(files).collect()
    assert len(got) == len(rows)
    assert {r.file_id: (r.license, r.origin, r.inherited_from) for r in got} == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "r"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "inherited", "r/a/b"), 5: ("Apache-2.0", "inherited", "r/a/b"),
        6: ("CC-BY-NC-4.0", "own", None), 7: (None, "none", None), 8: (None, "none", None), 9: (None, "none", None), 10: ("MIT", "inherited", "r"),
    }
    assert licenses.scan_licenses(files.limit(0)).count() == 0


def test_heavy_words_lose_no_line():
    import pyarrow as pa

    rnd, notices = random.Random(8), [w for _, t in licenses.TEMPLATES for w in t.split()]
    lines = [" ".join(rnd.choice([rnd.choice(notices), f"w{rnd.randrange(9)}"]) for _ in range(rnd.randrange(1, 12))) for _ in range(400)]
    lines += [" ".join(rnd.sample(t.split(), max(1, len(t.split()) - 1))) for _, t in licenses.TEMPLATES for _ in range(5)]
    scanner = licenses.Scanner(licenses.TEMPLATES, 50, {}, 0.8)
    names, _ = scanner.scan(pa.array(lines), [False] * len(lines))
    want = [scanner.best(v) for v in licenses._vectors(lines)]
    assert names == [n if c >= 0.8 else None for c, n in want] and any(names)
