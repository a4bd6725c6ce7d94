import datetime as dt
import math
import random
import time
from itertools import product

import numpy as np
import pytest

from skein.llm.provenance import _DIR, _FILE, DIRECTORY_NAMES, LABELS, comments, evidence, label_files

HAND = "import os\n\ndef load_things(items):\n    # Helpers for the files generated by make_x; this module itself is kept by hand.\n    total = 0\n    for item in items:\n        total += item.size\n    return total\n"
GENERATED = "// Code generated by toolgen v1.2. DO NOT EDIT.\n" + "".join(f"func (m *Msg) Get{i:03d}() int {{ return m.f[{i}] }}\n" for i in range(9))
MINIFIED = "!function(a){a.b=a.c||[],a.d=void 0}(this);" * 30
VENDORED = "// This is a third-party component (corvexa); report problems upstream.\n" + HAND.replace("#", "//")
BLOB = "export const T = [\n" + "".join("    " + ", ".join(str((i * 7919 + k * 31) % 65536) for k in range(12)) + ",\n" for i in range(30)) + "];\n"
SCHEMA = "file_id long, repo string, path string, content string, recorded_at timestamp, label string, dir string"


def label_of(text, path="src/a.py", repo="own-repo-1"):
    e = evidence(repo, path, text)
    return LABELS[max(range(5), key=lambda i: e[i])]


def test_evidence_of_one_file():
    assert [label_of(t) for t in (HAND, GENERATED, MINIFIED, VENDORED, BLOB, "")] == ["handwritten", "generated", "minified", "vendored", "blob", "handwritten"]


def test_what_only_mentions_such_things():
    for text in (
        'const f = (out) => out.write("// AUTO-GENERATED, DO NOT EDIT\\n");\n', 'BANNER = "# Code generated by the report tool. DO NOT EDIT."\n', "// Copyright (c) 2020 the own-repo-1 maintainers\nlet a = 1\n", "LIMITS = [1, 2, 3, 4, 5, 6, 7, 8]\n" + HAND,
        'const HELP = "' + "This is a long help text that goes on and on. " * 20 + '"\n' + HAND,
    ):
        assert label_of(text) == "handwritten", text[:50]
    assert label_of(HAND, "src/admin.minutes.js") == label_of(HAND, "lib/generators/vendors/build_vendor_list.py") == "handwritten"


def test_markers_in_other_places_and_languages():
    for mark in ("# Ce fichier est produit par ravengen, ne pas modifier.", "/*\n * Automatisch erzeugt von x - nicht von Hand ändern.\n */", "// @GENERATED BY X"):
        assert label_of("a = load_things(b)\n" * 3 + mark + "\n") == "generated", mark


def test_notices_and_markers_on_any_line_of_any_length():
    for line in (0, 25, 60):
        for long in ("", " and more words about it" * 30):
            lines = (HAND * 8).replace("#", "//").split("\n")
            lines.insert(line, "// Imported unchanged from corvexa" + long)
            assert label_of("\n".join(lines), "src/a.js") == "vendored", (line, long[:9])
            lines[line] = "// Code generated by toolgen." + long
            assert label_of("\n".join(lines), "src/a.js") == "generated", (line, long[:9])
    bundle = "/*! corvexa v3.2.1 | MIT */" + "function load_things(items){return items.length}" * 20 + "/* copyright 2019 the ravenet authors */"
    assert evidence("own-repo-1", "src/a.js", bundle)[3] > 8
    assert comments("a = 1 /* x */ + /** y */ 2\n/* open\n * z */ b /* w */\n<!-- q -->") == ["x", "y", "open", "z", "w", "q"]


def test_long_texts_take_linear_time():
    began = time.time()
    for part in ("/*", "*", '"', "'", "`", "// copyright 2019 ", "generated by ", "x1 ", "1,", "a" * 50 + " "):
        evidence("r", "a.js", part * (200_000 // len(part)))
    assert time.time() - began < 20


def t(d):
    return dt.datetime(2025, 1, d)


def test_place_and_siblings(spark):
    rows = [(1, "r", "vendor/x/a.py", HAND, t(1), None, None), (2, "r", "src/a.py", HAND, t(1), None, None), (3, "r", "src/gen/x.py", HAND, t(1), None, None), (4, "r", "a.py", HAND, t(1), None, None)]
    rows += [(10 + i, "r", f"src/copied/c{i}.js", VENDORED, t(1), None, None) for i in range(12)] + [(30, "r", "src/copied/plain.js", HAND, t(1), None, None)]
    rows += [(40 + i, "r", f"app/mixed/h{i}.js", HAND, t(1), None, None) for i in range(9)] + [(60, "r", "app/mixed/v.js", VENDORED, t(1), None, None)]
    rows += [(70, None, "a/b.py", GENERATED, t(1), None, None), (71, "r", None, HAND, t(1), None, None), (72, "r", "n.py", None, t(1), None, None), (None, "r", "n.py", HAND, t(1), None, None), (73, "r", "z.py", GENERATED, t(1), None, None), (73, "r", "z.py", HAND, t(2), None, None)]
    got = {r.file_id: r.label for r in label_files(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: got[k] for k in (1, 2, 3, 4, 60, 70, 71, 73)} == {1: "vendored", 2: "handwritten", 3: "generated", 4: "handwritten", 60: "vendored", 70: "generated", 71: "handwritten", 73: "handwritten"}
    assert all(got[10 + i] == "vendored" for i in range(12)) and got[30] == "vendored"
    assert all(got[40 + i] == "handwritten" for i in range(9))
    assert 72 not in got and None not in got
    assert label_files(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_beliefs(files):
    """The tree's marginals by plain recursion: file_id -> log potentials."""
    below, inside = {}, {}
    for key, parts, f in files:
        for d in range(len(parts) + 1):
            below.setdefault(tuple(parts[:d]), set())
            if d:
                below[tuple(parts[: d - 1])].add(tuple(parts[:d]))
        inside.setdefault(tuple(parts), []).append((key, f))
    lse = lambda xs: max(xs) + math.log(sum(math.exp(x - max(xs)) for x in xs))
    said, belief, out = {}, {}, {}
    up = lambda v, table: [lse([v[y] + math.log(table[x][y]) for y in range(5)]) for x in range(5)]
    down = lambda v, u, table: [lse([v[x] - u[x] + math.log(table[x][y]) for x in range(5)]) for y in range(5)]
    for d in sorted(below, key=len, reverse=True):
        name, odds = DIRECTORY_NAMES.get(d[-1], (None, 0)) if d else (None, 0)
        belief[d] = [odds * (LABELS[i] == name) + sum(said[c][i] for c in below[d]) + sum(up(f, _FILE)[i] for _, f in inside.get(d, ())) for i in range(5)]
        said[d] = up(belief[d], _DIR)
    for d in sorted(below, key=len):
        told = down(belief[d[:-1]], said[d], _DIR) if d else [math.log(x) for x in _DIR[0]]
        belief[d] = [a + b for a, b in zip(belief[d], told)]
        for key, f in inside.get(d, ()):
            out[key] = [a + b for a, b in zip(f, down(belief[d], up(f, _FILE), _FILE))]
    return out


@pytest.mark.parametrize("partitions", [1, 3, 7])
def test_deep_and_wide_trees_cut_over_partitions(spark, partitions):
    rng = random.Random(5)
    paths = ["/".join(f"d{k}" for k in range(depth)) + "/f.py" for depth in (3, 50, 99, 100)] + [f"wide/w{i}/x.py" for i in range(40)] + [f"hot/f{i}.py" for i in range(120)] + ["top.py", "/odd.py", "a//b.py", "a-b/c.py", "a/c.py", "a.b/c.py"]
    paths += ["/".join(rng.choice(["src", "gen", "vendor", "a", "a-b"]) for _ in range(rng.randint(0, 6))).strip("/") + f"/r{i}.py" for i in range(150)]
    texts = [HAND, GENERATED, VENDORED, MINIFIED, BLOB]
    files = [(i, "r" if i % 9 else "q", p, rng.choice(texts[:1] * 6 + texts)) for i, p in enumerate(paths)]
    want = {}
    for repo in ("r", "q"):
        want |= plain_beliefs([(i, p.split("/")[:-1], evidence(r, p, x)) for i, r, p, x in files if r == repo])
    df = spark.createDataFrame([(i, r, p, x, t(1), None, None) for i, r, p, x in files], SCHEMA)
    got = label_files(df, partitions=partitions).collect()
    assert len(got) == len(files)
    for row in got:
        scores = want[row.file_id]
        assert row.label == LABELS[max(range(5), key=lambda i: scores[i])], row
        assert abs(row.confidence - 1 / sum(math.exp(x - max(scores)) for x in scores)) < 1e-5


def test_exact_marginals(spark):
    """Two passes give what summing over all labellings gives."""
    paths = ["vendor/a.py", "vendor/x/b.py", "c.py"]
    texts = [HAND, VENDORED, GENERATED]
    dirs = ["", "vendor", "vendor/x"]
    parent = {"vendor": "", "vendor/x": "vendor"}
    weight = np.zeros((3, 5))
    for ds in product(range(5), repeat=3):
        at = dict(zip(dirs, ds))
        base = math.log(_DIR[0][at[""]]) + sum(math.log(_DIR[at[parent[d]]][at[d]]) for d in parent)
        name, odds = DIRECTORY_NAMES["vendor"]
        base += odds * (LABELS[at["vendor"]] == name)
        for fs in product(range(5), repeat=3):
            w = base + sum(math.log(_FILE[at[p.rpartition("/")[0]]][f]) + evidence("r", p, x)[f] for p, x, f in zip(paths, texts, fs))
            for i, f in enumerate(fs):
                weight[i, f] += math.exp(w)
    want = weight / weight.sum(axis=1, keepdims=True)
    rows = [(i, "r", p, x, t(1), None, None) for i, (p, x) in enumerate(zip(paths, texts))]
    for r in label_files(spark.createDataFrame(rows, SCHEMA)).collect():
        assert r.label == LABELS[int(want[r.file_id].argmax())]
        assert abs(r.confidence - want[r.file_id].max()) < 1e-5
