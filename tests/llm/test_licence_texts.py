"""Full licence texts, standard headers, and notices that are not a line of their own."""

import random
import re
from collections import Counter

import pyarrow as pa

from intronaut.llm import licenses


def test_texts_headers_and_wrapped_notices(spark):
    full, headers = dict(licenses.full_texts()), dict(licenses.HEADERS[5:10])
    filler = "\n".join(" ".join(f"w{i}x{k}" for k in range(12)) for i in range(60))
    comment = lambda text: "\n".join("# " + " ".join(text.split()[i : i + 9]) for i in range(0, len(text.split()), 9))
    rows = [(f"t-{name}", f"{name}/LICENSE", text, name) for name, text in full.items()]
    rows += [(f"h-{name}", f"{name}/x.py", f"{filler}\n{comment(text)}\n{filler}", name) for name, text in headers.items()]
    rows += [
        ("title", "q/a.py", "GNU GENERAL PUBLIC LICENSE Version 3", "GPL-3.0"),
        ("mit", "q/b.py", "The MIT License (MIT)", "MIT"),
        ("within", "q/c.py", "Copyright 2020 Foo. Released under the MIT License. See LICENSE for details", "MIT"),
        ("wrapped", "q/d.py", f"{filler}\n# Licensed under the Apache\n# License, Version 2.0\n{filler}", "Apache-2.0"),
        ("none", "q/e.py", f"the license of this work is general\n{filler}", None),
    ]
    files = spark.createDataFrame([(i, path, text) for i, (_, path, text, _) in enumerate(rows)], "file_id long, path string, text string").repartition(3)
    got = {r.file_id: r.license for r in licenses.scan_licenses(files).where("origin <> 'inherited'").collect()}
    assert {rows[i][0]: name for i, name in got.items()} == {key: want for key, _, _, want in rows}


def test_windows_equal_brute_force():
    rnd, notices = random.Random(2), [w for _, t in licenses.TEMPLATES for w in t.split()]
    texts = ["\n".join(" ".join(rnd.choice([rnd.choice(notices), f"w{rnd.randrange(9)}"]) for _ in range(rnd.randrange(9))) for _ in range(3)) for _ in range(60)]
    texts += [f"w1 w2\n{' '.join(rnd.sample(t.split(), len(t.split()) - 1))} w3" for _, t in licenses.TEMPLATES]
    scanner = licenses.Scanner(licenses.TEMPLATES, 50, {}, 0.8)
    codes = [[next(iter(v)) for v in licenses._vectors(re.findall("[A-Za-z0-9]+", t))] for t in texts]
    want = []
    for c in codes:
        found = [(sum(x * scanner.unit(Counter(c[i : i + m])).get(w, 0.0) for w, x in t.items()), m, name) for name, m, t in scanner.sliding for i in range(max(1, len(c) - m + 1)) if c]
        want.append(min(((-round(x, 9), -m, name) for x, m, name in found if x >= 0.8 - 1e-9), default=(0, 0, None))[2])
    assert scanner.scan_windows(pa.array(texts))[0] == want and any(want)


def test_weights_and_inheritance_equal_brute_force(spark):
    """Document frequencies over all files decide cosines; the nearest directory with a licence file decides what is inherited."""
    import math

    rnd = random.Random(12)
    templates = [("A", "alpha beta gamma delta"), ("B", "alpha beta omega sigma"), ("C", "kappa kappa lambda")]
    pool = [w for _, t in templates for w in t.split()] + ["x", "y"]
    rows = []
    for i in range(160):
        path = "/".join(rnd.choice("pq") for _ in range(rnd.randrange(5)))
        name = rnd.choice(["LICENSE", "COPYING.md", f"f{i}.py", f"g{i}.py", f"h{i}.py"])
        text = rnd.choice([None, "", "\n".join(" ".join(rnd.choice(pool) for _ in range(rnd.randrange(6))) for _ in range(3)), rnd.choice(templates)[1], "alpha beta " * 3])
        rows.append((i, f"{path}/{name}" if path else name, text))
    rows += [(160, None, "alpha beta gamma delta"), (161, None, None), (162, "z/big.py", "alpha filler\n" * 120_000)]
    n, df = len(rows), Counter(w for _, _, t in rows for w in set((t or "").split()))
    idf = lambda w: math.log((1 + n) / (1 + (df[w] if w in {x for _, t in templates for x in t.split()} else 0))) + 1

    def unit(words):
        v = {w: (1 + math.log(c)) * idf(w) for w, c in Counter(words).items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    def own(path, text):
        units, best = [(name, len(t.split()), unit(t.split())) for name, t in templates], []
        licence_file = path is not None and re.sub(r"\.[^.]*$", "", path.split("/")[-1]).lower() in licenses.LICENCE_FILES
        words = (text or "").split()
        pieces = [line.split() for line in (text or "").split("\n")] + ([words] if licence_file else [])
        for name, m, t in units:
            windows = [words[i : i + m] for i in range(max(1, len(words) - m + 1))] if len(words) < 10_000 else []
            best += [(round(sum(x * unit(w).get(k, 0.0) for k, x in t.items()), 9), name) for w in [*pieces, *windows] if w]
        top = max((c for c, _ in best), default=0)
        return (None, 0) if top < 0.8 else (sorted(name for c, name in best if c == top)[0], top)

    small = [r for r in rows if r[0] != 162]
    mine = {i: own(p, t) for i, p, t in small} | {162: (None, 0)}
    holders = {}
    for i, p, _ in rows:
        if p is not None and mine[i][0] and re.sub(r"\.[^.]*$", "", p.split("/")[-1]).lower() in licenses.LICENCE_FILES:
            d = "/".join(p.split("/")[:-1])
            holders[d] = min(holders.get(d, (0, "~")), (-mine[i][1], mine[i][0]))
    files = spark.createDataFrame(rows, "file_id long, path string, text string").repartition(4)
    got = {r.file_id: r for r in licenses.scan_licenses(files, templates).collect()}
    assert len(got) == len(rows) and len({r.origin for r in got.values()}) == 3
    for i, p, _ in rows:
        if mine[i][0]:
            assert got[i].origin == "own" and abs(got[i].cosine - mine[i][1]) < 1e-6
            continue
        above = ["/".join(p.split("/")[:k]) for k in range(len(p.split("/")) - 1, -1, -1)] if p is not None else []
        home = next((d for d in above if d in holders), None)
        assert (got[i].license, got[i].inherited_from) == ((holders[home][1], home) if home is not None else (None, None))


def test_near_texts_and_unknown_licences(spark):
    """The nearer of two texts decides over the notice that both begin with; an unknown licence isn't covered by one further up."""
    full = dict(licenses.full_texts())
    varied = full["BSD-2-Clause"].replace("COPYRIGHT HOLDERS", "AUTHOR").replace("COPYRIGHT HOLDER", "AUTHOR")
    strange = "Foo License. Copyright holders give permission to look at this, without warranty, and to redistribute nothing."
    rows = [
        ("COPYING", full["Unlicense"], "Unlicense", "own"), ("a/LICENSE", full["BSD-2-Clause"], "BSD-2-Clause", "own"), ("b/LICENSE", varied, "BSD-2-Clause", "own"), ("c/LICENSE", full["BSD-3-Clause"], "BSD-3-Clause", "own"),
        ("d/LICENSE", f"Copyright 2020 Foo\n\n{full['ISC']}", "ISC", "own"), ("e/LICENSE", strange, None, "unrecognised"), ("e/x.py", "pass", None, "none"), ("e/f/LICENSE", "todo", None, "none"), ("a/b/x.py", "pass", "BSD-2-Clause", "inherited"),
        ("g/x.py", "Redistribution and use in source and binary forms, with or without modification, are permitted", "BSD-3-Clause", "own"), ("h/y.py", None, "Unlicense", "inherited"), (None, None, None, "none"), ("h/y.py", None, "Unlicense", "inherited"),
        ("i/LICENSE", full["GPL-3.0"].replace("GNU GENERAL PUBLIC LICENSE\n", "GNU AFFERO GENERAL PUBLIC LICENSE\n", 1).replace("GNU General Public License", "GNU Affero General Public License") + " Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network (if your version supports such interaction) an opportunity to receive the Corresponding Source of your version", "AGPL-3.0", "own"),
    ]
    files = spark.createDataFrame([(i, p, t, "x") for i, (p, t, _, _) in enumerate(rows)], "file_id long, path string, text string, unknown string")
    got = {r.file_id: (r.license, r.origin) for r in licenses.scan_licenses(files).collect()}
    assert got == {i: (name, origin) for i, (_, _, name, origin) in enumerate(rows)}
