"""Single operators on fabricated inputs, edges included."""

import itertools

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import color, scalar
from siftwork.operators import cluster, curate, navigate, projects, scope, select, tagging, tournament
from siftwork.plans import runs
from siftwork.sources import catalog, export


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def shots(spark, times, hashes):
    return spark.createDataFrame([(1, i, t, h) for i, (t, h) in enumerate(zip(times, hashes), 1)], "project_id long, image_id long, captured_at long, hash long")


@pytest.mark.parametrize(
    "times, hashes, want",
    [
        ([1000, 1005, 1008], [7, 7, 7], [(3, [1, 2, 3])]),
        ([1000, 1011], [7, 7], []),
        ([1000, 1010], [7, 7], [(2, [1, 2])]),
        ([1000, 1002], [7, ~7], []),
        ([1000, 1002, 1004], [0, 0b111, 0b111111], [(3, [1, 2, 3])]),
        ([1000, 1002, 1004, 1006], [0, -1, 1, -2], [(3, [1, 3]), (4, [2, 4])]),
        ([1000, 1004, 1002], [7, 7, 7], [(2, [1, 2, 3])]),
        ([1000, 1004, 1004], [7, 7, 7], [(2, [1, 2, 3])]),
        ([1000, 1002, 1004], [7, None, 7], [(3, [1, 3])]),
        ([None, None], [7, 7], []),
    ],
)
def test_find_duplicates(spark, times, hashes, want):
    assert rows(cluster.find_duplicates(shots(spark, times, hashes), 10, 5), "representative", "members") == want


def test_banding_loses_no_pair(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(2**62), 2**62, 6)
    hashes = [int(b) ^ sum(1 << int(i) for i in set(rng.integers(0, 63, rng.integers(0, 6)))) for b in base for _ in range(8)]
    df = shots(spark, [1000] * len(hashes), hashes)
    got = rows(cluster.find_duplicates(df, 10, 6), "members")
    edges = [(i, j) for i, j in itertools.combinations(range(len(hashes)), 2) if bin((hashes[i] ^ hashes[j]) & (2**64 - 1)).count("1") <= 6]
    label = list(range(len(hashes)))
    for _ in label:
        for i, j in edges:
            label[i] = label[j] = min(label[i], label[j])
    groups = [[i + 1 for i, x in enumerate(label) if x == k] for k in sorted(set(label))]
    assert got == sorted(([g] for g in groups if len(g) > 1), key=repr) or got == sorted(((g,) for g in groups if len(g) > 1), key=repr)


def test_scopes(spark):
    images = spark.createDataFrame([(i, 100 - i, f"p{i}") for i in range(1, 5)], "image_id long, captured_at long, file_path string")
    tags = spark.createDataFrame([(1, "Best of", True), (2, scope.REJECT, False)], "tag_id long, name string, is_ordered boolean")
    entries = spark.createDataFrame([(1, 1, 2, 5), (3, 1, 1, 6), (4, 2, None, 1), (3, 2, None, 1)], "image_id long, tag_id long, position long, tagged_at long")
    of = lambda text, **k: scope.resolve(scope.parse(text), images, tags, entries, **k)
    assert rows(of('#"bEST oF"')[0], "ordinal", "image_id") == [(1, 3), (2, 1)]
    assert rows(of("*")[0], "ordinal", "image_id") == [(1, 1), (2, 2), (3, 3), (4, 4)]
    assert rows(of("#Reject")[0], "ordinal", "image_id") == [(1, 3), (2, 4)]
    explicit = spark.createDataFrame([(1, 9)], "ordinal long, image_id long")
    assert rows(of(".", explicit=explicit)[0], "image_id") == [(9,)]
    for text, kind, more in (("x", "invalid_syntax", {}), ("#none", "tag_not_found", {}), ("#reject", "system_tag_not_allowed", {"allow_system": False}), (".", "no_explicit_set", {})):
        with pytest.raises(scope.ScopeError) as e:
            of(text, **more)
        assert e.value.kind == kind
    ids = images.select("image_id")
    assert rows(scope.exclude(ids, tags, entries, ["best OF", scope.REJECT]), "image_id") == [(2,)]
    assert rows(scope.exclude(ids, tags, entries, ["best OF", scope.REJECT], scope_tag=2), "image_id") == [(2,), (4,)]
    assert scope.folded("É") != scope.folded("é")


def tag_tables(spark):
    tags = spark.createDataFrame([(1, 1, "Pick", 2, True, False), (2, 1, scope.DUPLICATE, None, False, True), (3, 2, "other", None, False, False)], "id long, project_id long, name string, cap long, is_ordered boolean, is_system boolean")
    images = spark.createDataFrame([(i, 1) for i in range(1, 6)] + [(9, 2)], "id long, project_id long")
    entries = spark.createDataFrame([(1, 1, 1, 10)], "image_id long, tag_id long, position long, tagged_at long")
    return tags, images, entries


def ids(spark, *xs):
    return spark.createDataFrame(list(enumerate(xs, 1)), "ordinal long, image_id long")


def test_tagging(spark):
    tags, images, entries = tag_tables(spark)
    add = lambda *xs: tagging.add_entries(entries, tags, images, 1, ids(spark, *xs), 20)
    assert rows(add(3, 1, 3), "image_id", "position", "tagged_at") == [(1, 1, 10), (3, 2, 20)]
    with pytest.raises(tagging.TagError) as e:
        add(3, 4)
    assert e.value.kind == "cap_exceeded" and e.value.entries == [1]
    full = add(3)
    assert rows(tagging.add_entries(full, tags, images, 1, ids(spark, 1, 3), 30), "image_id") == [(1,), (3,)]  # there already, at the cap
    with pytest.raises(tagging.TagError, match="other_project"):
        add(9)
    assert rows(tagging.replace_entry(full, 1, 1, 5, 40), "image_id", "position") == [(3, 2), (5, 1)]
    assert rows(tagging.remove_entry(full, 1, 77), "image_id") == [(1,), (3,)]
    assert tagging.clear_tag(full, 1).count() == 0
    with pytest.raises(tagging.TagError, match="system_tag"):
        tagging.delete_tag(tags, entries, 2)
    assert rows(tagging.delete_tag(tags, entries, 1)[0], "id") == [(2,), (3,)]
    with pytest.raises(tagging.TagError, match="exists"):
        tagging.create_tag(tags, 1, "pICK")
    assert tagging.create_tag(tags, 2, "Pick").filter("id = 4 and project_id = 2").count() == 1
    assert tagging.ensure_system_tags(tags, 1).count() == 4
    t, e2, ok = tagging.apply_tag(tags, entries, images, 1, "new", ids(spark, 2), 50)
    assert ok and t.count() == 4 and e2.count() == 2
    assert tagging.apply_tag(tags, full, images, 1, "Pick", ids(spark, 2), 50, "skip")[2] is False


def test_rescan(spark):
    scan = lambda *r: spark.createDataFrame(list(r), "file_path string, kind string, captured_at long, emitted boolean")
    cat = lambda *r: spark.createDataFrame(list(r), "id long, file_path string, kind string, captured_at long")
    jpeg = cat((5, "d/IMG_001.jpg", "jpeg", None))
    both = scan(("d/IMG_001.jpg", "jpeg", 4, False), ("d/IMG_001.dng", "raw", 4, True))
    aware = projects.rescan_actions(both, jpeg, raw_aware=True, support_raw=True)
    assert rows(aware.filter("action = 'upgrade'"), "file_path", "id") == [("d/IMG_001.dng", 5)]
    first = projects.rescan_actions(both, jpeg, raw_aware=False, support_raw=True)
    assert rows(first.filter("action = 'insert_raw'"), "name") == [("IMG_001_raw.dng",)]
    assert rows(first.filter("file_path like '%.jpg'"), "action") == [("backfill",)]
    gone = cat((1, "a.jpg", "jpeg", 1), (2, "b.dng", "raw", 1))
    nothing = scan(("c.jpg", "jpeg", 1, True))
    acts = lambda **k: rows(projects.rescan_actions(nothing, gone, False, **k), "file_path", "action")
    assert acts(support_raw=False) == [("a.jpg", "prune"), ("b.dng", "keep"), ("c.jpg", "insert")]
    assert acts(support_raw=True, prune=False) == [("a.jpg", "keep"), ("b.dng", "keep"), ("c.jpg", "insert")]
    t = projects.rescan_totals(projects.rescan_actions(nothing, gone, False, True)).first()
    assert (t.added, t.upgraded, t.removed, t.total) == (1, 0, 2, 1)


def test_projects_and_recipes(spark):
    p = spark.createDataFrame([], catalog.SCHEMAS["projects"])
    i = spark.createDataFrame([], catalog.SCHEMAS["images"])
    files = spark.createDataFrame([("x/a.JPG", 3), ("x/a.dng", 4), ("b.txt", 5)], "file_path string, file_size long")
    scan = catalog.scan_media(files, True)
    assert rows(scan, "file_path", "emitted") == [("x/a.JPG", False), ("x/a.dng", True)]
    p2, i2 = projects.create_project(p, i, "one", "/r", scan, 9)
    assert rows(i2, "id", "file_name", "kind") == [(1, "a.dng", "raw")]
    with pytest.raises(projects.ProjectError, match="name_exists"):
        projects.create_project(p2, i2, "one", "/r", scan, 9)
    with pytest.raises(projects.ProjectError, match="no_images_raw_ignored"):
        projects.create_project(p2, i2, "two", "/r", scan.limit(0), 9, raw_ignored=True)
    r = spark.createDataFrame([(1, None, "Film", None), (2, 1, "v1", None), (3, 1, "v2", 5), (4, 1, "v3", None)], "id long, parent_id long, name string, deleted_at long")
    assert rows(projects.resolve_address(r, "Film:2"), "id") == [(4,)]
    assert rows(projects.resolve_address(r, "Film"), "id") == [(1,)]
    assert projects.resolve_address(r, "Film:0").count() == 0
    with pytest.raises(projects.ProjectError, match="preset_protected"):
        projects.delete_version(r, 1, 9)
    with pytest.raises(projects.ProjectError, match="recipe_deleted"):
        projects.set_recipe(i2, r, spark.createDataFrame([(1,)], "image_id long"), 3)
    assert rows(projects.set_recipe(i2, r, spark.createDataFrame([(1,)], "image_id long"), 4), "recipe_id") == [(4,)]
    assert rows(projects.looks(r), "id", "preset_name") == [(1, "Film"), (2, "Film"), (3, "Film"), (4, "Film")]


def test_evaluations(spark):
    e = spark.createDataFrame([(1, '{"assessment":"a","unusable":true,"content":"c"}'), (2, '{"assessment":"a","unusable":"yes"}'), (3, '{"assessment":"a","unusable":false}'), (4, "not json")], "image_id long, result_json string")
    got = {r.image_id: (r.evaluated, r.result.unusable if r.result else None) for r in projects.read_evaluations(e).collect()}
    assert got == {1: (True, True), 2: (True, None), 3: (True, False), 4: (True, None)}
    assert rows(projects.rejects_from(e), "image_id") == [(1,)]


@pytest.mark.parametrize("multiple, count, n, want", [(2.0, 9, 100, 18), (1.0, 4, 100, 6), (1.6, 4, 100, 7), (2.0, 4, 5, 5), (2.0, 4, 0, 0), (2.0, 0, 9, 0)])
def test_preselection(multiple, count, n, want):
    assert select.preselection_size(multiple, count, n) == want


@pytest.mark.parametrize("picks, pool, n, want", [([2, 5, 1], 3, 2, [2, 1]), ([2, 2, 1, 2], 3, 2, [2, 1]), ([1, 7], 3, 2, []), ([], 3, 2, []), ([True, 1, 2], 3, 2, [1, 2])])
def test_cleaning(picks, pool, n, want):
    assert select.clean_selection(picks, pool, n) == want


def test_diversity(spark):
    df = spark.createDataFrame([(1, 1, 1000), (1, 2, 1005), (1, 3, 100000), (1, 4, 200000)], "project_id long, winner long, captured_at long")
    assert rows(select.diverse_top(df, 2), "ordinal", "winner") == [(1, 4), (2, 1)]


def test_tournaments():
    order = lambda rank: (lambda a, b: rank[a] > rank[b])
    for m in (1, 2, 3, 5, 8, 13, 16, 40):
        rank = {i: (37 * i + 11) % 101 for i in range(m)}
        want = sorted(rank, key=lambda i: -rank[i])
        for k in {1, 2, m // 2, m}:
            got, made = tournament.top_k(list(range(m)), order(rank), k)
            assert got == want[:k] and made <= tournament.comparison_bound(m, k)
        winner, made, ok = tournament.single_elimination(list(range(m)), order(rank), 0)
        assert (winner, made, ok) == (want[0], m - 1, True)
    assert [tournament.comparison_bound(*x) for x in ((1, 1), (2, 1), (2, 2), (8, 1), (8, 8), (40, 20))] == [0, 1, 2, 7, 28, 153]
    assert tournament.top_k([1, 2, 3], lambda a, b: None, 2)[0] is None
    assert tournament.single_elimination([1, 2, 3], lambda a, b: None, 3) == (3, 1, False)
    beats = {(1, 2), (2, 3), (3, 1)}  # not transitive: pairing decides
    assert tournament.single_elimination([1, 2, 3], lambda a, b: (a, b) in beats, 0)[0] == 3
    assert tournament.top_k([], order({}), 3) == ([], 0)
    a, b = {"decodable": False, "captured_at": None, "id": 1}, {"decodable": False, "captured_at": 900, "id": 2}
    assert not tournament.without_pictures(a, b) and tournament.without_pictures({**b, "id": 1}, b)
    assert tournament.pick_cost(6, 3, 2) == {"candidates": 6, "champions": 3, "first_stage": 3, "max_comparisons": 3 + tournament.comparison_bound(3, 2), "rejects": 4}


def test_answers():
    assert curate.parse_answer('```json\n{"winner": "a", "n": 1}\n```', {"winner": str}) == {"winner": "a", "n": 1}
    assert curate.parse_answer('{"n": true}', {"n": int}) is None
    with pytest.raises(ValueError):
        curate.style_choice({"style": "x"}, ["y"])


def test_navigation(spark):
    r = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "project_id long, image_id long, rank int")
    tagged = spark.createDataFrame([(2,), (3,)], "image_id long")
    assert rows(navigate.next_untagged(r, tagged), "image_id", "next_untagged") == [(1, 4), (2, 4), (3, 4), (4, 5), (5, 1)]
    one = r.filter("image_id = 1")
    assert rows(navigate.next_previous(one), "next_id", "previous_id") == [(1, 1)]
    assert rows(navigate.neighbourhood(r, 1).filter("image_id = 1"), "priority", "neighbour") == [(0, 1), (1, 2), (2, 5)]


def collided(names):
    """The rule as a loop: the first free name, in order."""
    out = []
    for n in names:
        stem, dot, ext = n.rpartition(".") if "." in n[1:] else (n, "", "")
        name, k = n, 2
        while name in out:
            name, k = f"{stem}_{k}{dot}{ext}", k + 1
        out.append(name)
    return out


def test_collisions(spark):
    rng = random.Random(2)
    pool = ["x.jpg", "x_2.jpg", "x_3.jpg", "x_2_2.jpg", "x_02.jpg", "y.jpg", "IMG_7.jpg", "IMG_8.jpg", ".x", "n", "n_2", "x.JPG", "a.b_2.jpg", "a.b.jpg"]
    folders = [["x.jpg", "x.jpg", "x_2.jpg"], ["x.jpg", "x_2.jpg", "x.jpg"], *([rng.choice(pool) for _ in range(rng.randrange(1, 60))] for _ in range(12))]
    assert collided(folders[0]) == ["x.jpg", "x_2.jpg", "x_2_2.jpg"]
    df = spark.createDataFrame([(f, i, n) for f, names in enumerate(folders) for i, n in enumerate(names)], "tag_id long, ordinal long, target string").repartition(3)
    got = {}
    for r in export.resolve_collisions(df, ["tag_id"]).orderBy("ordinal").collect():
        got.setdefault(r.tag_id, []).append(r.target)
    assert got == {f: collided(names) for f, names in enumerate(folders)}


def test_export_batches(spark):
    images = spark.createDataFrame([(1, "a/x.jpg", "jpeg", None), (2, "b/x.jpg", "jpeg", 5), (3, "c/x.dng", "raw", None), (4, "gone.jpg", "jpeg", None), (5, "d/y.jpg", "jpeg", None)], "id long, file_path string, kind string, recipe_id long")
    tags = spark.createDataFrame([(1, "best", True), (2, scope.REJECT, False), (3, scope.DUPLICATE, False)], "tag_id long, name string, is_ordered boolean")
    held = spark.createDataFrame([(i, 1, p, 0) for i, p in ((5, 1), (4, 2), (3, 3), (2, 4), (1, 5))] + [(1, 2, None, 7), (5, 3, None, 8)], "image_id long, tag_id long, position long, tagged_at long")
    present = images.filter("id <> 4").select("file_path")
    plain = lambda m: rows(m, "image_id", "ordinal", "target", "route", "reason")
    assert plain(export.export_tag(1, tags, held, images, present=present)) == [(2, 3, "03_x.jpg", "bake", None), (3, 2, "02_x.jpg", "decode", None), (4, 1, None, None, "source_missing")]
    assert plain(export.export_tag(1, tags, held, images, True, True))[0] == (1, 5, "05_x.jpg", "copy", None)
    assert plain(export.export_tag(2, tags, held, images)) == [(1, 1, "x.jpg", "copy", None)]  # the scope itself isn't left out
    ids = spark.createDataFrame([(1, 3), (2, 99), (3, 2), (4, 1), (5, 5)], "ordinal long, image_id long")
    assert plain(export.export_images(ids, tags, held, images)) == [(2, 2, "x_2.jpg", "bake", None), (3, 1, "x.jpg", "decode", None)]
    assert plain(export.export_images(ids, tags, held, images, include_dup=True))[-1] == (5, 3, "y.jpg", "copy", None)
    assert plain(export.export_image(1, images)) == [(1, 1, "x.jpg", "copy", None)]
    assert rows(export.outcome(export.export_tag(1, tags, held, images, present=present)), "outcome", "n") == [("exported", 2), ("source_missing", 1)]
    with pytest.raises(scope.ScopeError):
        export.export_image(9, images)
    with pytest.raises(scope.ScopeError):
        export.export_tag(9, tags, held, images)


def test_export(spark):
    df = spark.createDataFrame([(1, 1, 1, "a/x.jpg"), (1, 2, 2, "b/x.jpg"), (1, 3, 3, "c/x_2.jpg"), (1, 4, 4, "d/x.dng")], "tag_id long, ordinal long, image_id long, file_path string")
    got = export.resolve_collisions(export.target_names(df, False, ["tag_id"]), ["tag_id"])
    assert [r.target for r in got.orderBy("ordinal").collect()] == ["x.jpg", "x_2.jpg", "x_2_2.jpg", "x_3.jpg"]
    assert [r.target for r in export.target_names(df, True, ["tag_id"]).orderBy("ordinal").collect()] == ["01_x.jpg", "02_x.jpg", "03_x_2.jpg", "04_x.jpg"]

    def write(row):
        if row["image_id"] == 2:
            raise OSError("no room")

    assert rows(export.write_batch(df.select("image_id"), write), "image_id", "exported", "reason") == [(1, True, None), (2, False, "no room"), (3, True, None), (4, True, None)]


def test_scalars(spark):
    grid = [(c * 7 + r * 3) % 11 for r in range(8) for c in range(9)]
    want = sum(1 << (r * 8 + c) for r in range(8) for c in range(8) if grid[r * 9 + c] > grid[r * 9 + c + 1])
    got = spark.createDataFrame([(grid,)], "g array<int>").select(scalar.dhash(F.col("g")).alias("h")).first().h
    assert got & (2**64 - 1) == want
    row = spark.range(1).select(scalar.fit_within(F.lit(400), F.lit(200), 100, 100).alias("a"), scalar.fit_within(F.lit(40), F.lit(20), 100, 100).alias("b"), scalar.integer_picks(F.array(F.lit("1"), F.lit("x"), F.lit("2.5"), F.lit("3"))).alias("p"), scalar.strip_fence(F.lit("```json\n{}\n```")).alias("s"), scalar.hamming(F.lit(-1), F.lit(0).cast("int")).alias("d")).first()
    assert (row.a.w, row.a.h, row.b.w) == (100, 50, 40) and row.p == [1, 3] and row.s == "{}"


def shown(px, x, row, lut, k, grain_amount):
    """One pixel through table, knobs and grain, in single precision and one step after another."""
    f = np.float32
    one = lambda v: min(max(v, f(0)), f(1))
    v = [f(p) / f(255) for p in px]
    if lut is not None:
        n = len(lut)
        at = [c * f(n - 1) for c in v]
        lo = [int(a) for a in at]
        t = [a - f(i) for a, i in zip(at, lo)]
        hi = [min(i + 1, n - 1) for i in lo]
        mix = lambda a, b, w: a * (f(1) - w) + b * w
        v = [mix(*[mix(*[mix(lut[i, j, lo[2], ch], lut[i, j, hi[2], ch], t[2]) for j in (lo[1], hi[1])], t[1]) for i in (lo[0], hi[0])], t[0]) for ch in range(3)]
        v = [f(int(one(c) * f(255) + f(0.5))) / f(255) for c in v]
    if not k.neutral():
        lum = lambda r, g, b: f(0.299) * r + f(0.587) * g + f(0.114) * b
        y = lum(*v)
        d = f(k.highlights / 100) * one((y - f(0.5)) / f(0.5)) + f(k.shadows / 100) * one((f(0.5) - y) / f(0.5)) + f(k.whites / 100) * one((y - f(0.8)) / f(0.2)) + f(k.blacks / 100) * one((f(0.2) - y) / f(0.2))
        v = [one(v[0] * f(1 + k.red / 100) + d), one(v[1] + d), one(v[2] * f(1 + k.blue / 100) + d)]
        v = [one((c - f(0.5)) * f(1 + k.contrast / 100) + f(0.5)) for c in v]
        y = lum(*v)
        v = [one(y + (c - y) * f(1 + k.saturation / 100)) for c in v]
        v = [f(int(c * f(255) + f(0.5))) / f(255) for c in v]
    if grain_amount > 0:
        h = (x * color.GRAIN_X + row * color.GRAIN_Y) % 2**32
        h = (h ^ h >> 13) * color.GRAIN_MIX % 2**32
        h ^= h >> 16
        n = (f(h & 0xFFFF) / f(65535) * f(2) - f(1)) * (f(grain_amount) * f(color.GRAIN_LIMIT))
        v = [one(c + n) for c in v]
    return tuple(int(c * f(255) + f(0.5)) for c in v)


def test_color(spark):
    px = np.array([[0, 0, 0], [255, 255, 255], [12, 200, 99]], np.uint8)
    for n in (2, 17):
        assert (color.apply_lut(px, color.identity_lut(n)) == px).all()
    assert color.graded_lut(5) == pytest.approx(color.identity_lut(5), abs=1e-6)


def test_renders_against_loops(spark):
    rng = random.Random(3)
    px = [(i, rng.randrange(5000), rng.randrange(5000), *(rng.choice((0, 255, rng.randrange(256))) for _ in range(3))) for i in range(400)]
    df = spark.createDataFrame(px, "id long, x int, y int, r int, g int, b int")
    knobs = [color.Adjust(), color.Adjust(15, -20, 30, -40, 12, -9, 25, -100), color.Adjust(red=100.0), color.Adjust(shadows=-100, whites=80, contrast=-50, saturation=60)]
    for name, k in zip((color.ORIGIN, "Havana 1959", "Munich 1951", "New York 1994"), knobs):
        amount = color.PRESETS[name][5] if name in color.PRESETS else 0.0
        lut = color.preset_lut(name)
        got = {r.id: (r.r, r.g, r.b) for r in color.rendered(df, lut, k, amount).collect()}
        assert got == {p[0]: shown(p[3:], p[1], p[2], lut, k, amount) for p in px}
    grid = {(r.id, r.r, r.g, r.b): (r.red, r.green, r.blue) for r in color.preset_grid(spark).filter("(r * 289 + g * 17 + b) % 37 = 0").collect()}
    for i, name in enumerate(color.PRESETS, 2):
        lut = color.preset_lut(name)
        assert all(lut[k[1:]] == pytest.approx(v, abs=2e-7) for k, v in grid.items() if k[0] == i)


def test_settings_and_schema(spark):
    assert catalog.Settings.load('{"dedup_window": 7, "dedup_threshold": "x"}') == catalog.Settings(dedup_window=7)
    assert catalog.Settings.load("{") == catalog.Settings()
    old = spark.createDataFrame([(1, "p")], "id long, name string")
    assert catalog.conform(old, "projects", 0).columns[:2] == ["id", "name"] and len(catalog.conform(old, "projects").columns) == 6
    with pytest.raises(catalog.SchemaTooNew):
        catalog.conform(old, "projects", 2)


def test_list_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jpg").write_bytes(b"12")
    (tmp_path / "y.dng").write_bytes(b"1")
    assert rows(catalog.list_files(spark, str(tmp_path)), "file_path", "file_size") == [("a/x.jpg", 2), ("y.dng", 1)]
    assert catalog.list_files(spark, str(tmp_path / "none")).count() == 0


def plan(**gates):
    ai = {"ai_enabled": False, "provider": "local"}
    params = {"dedup": ai, "curate": {**ai, "count": None if gates.get("curate") == "required" else 9, "apply_tag": "t"}, "style": {"provider": "local"}}
    return [runs.StagePlan(n, dict(params.get(n, {})), gates.get(n, "off")) for n in runs.SHAPES[0]]


def stages(log, fail=None):
    def make(name):
        def run(inputs, params):
            log.append(name)
            if name == fail:
                raise RuntimeError("broken")
            return name

        return run

    names = runs.SHAPES[0]
    return {n: runs.Stage(n, make(n), tuple(names[max(0, i - 1) : i]), critical=n != "style") for i, n in enumerate(names)}


def test_runs():
    runs.validate_plan(plan())
    runs.validate_plan(plan(curate="required"))
    for bad in (plan()[1:], plan(style="maybe")):
        with pytest.raises(runs.PlanError):
            runs.validate_plan(bad)
    p = plan()
    p[2].params["count"] = True
    with pytest.raises(runs.PlanError):
        runs.validate_plan(p)
    log = []
    names = list(runs.SHAPES[0])
    r = runs.Run(plan(curate="courtesy", style="required"), stages(log))
    assert r.advance() == "waiting" and r.waiting == "curate" and log == names[:2]  # a gate stops its stage, not what follows
    assert r.timed_out() == "waiting" and r.waiting == "style" and r.timed_out() == "waiting" and log == names[:3]
    assert r.answer() == "review" and log == names
    assert r.approve() == "done"
    with pytest.raises(runs.PlanError):
        r.approve()
    log.clear()
    assert r.adjust("style") == "waiting" and log == []  # asked again before anything runs
    assert r.rerun("style", answered=True, provider="gemini") == "review" and log == names[3:] and r.plan[3].params["provider"] == "gemini"
    assert r.adjust("style") == "review"
    assert r.rearm("style") == "waiting" and r.states["style"] == "pending"
    log.clear()
    assert r.answer(False) == "cancelled" and log == [] and r.states["style"] == "pending"
    held = runs.Run(plan(curate="courtesy"), stages(log))
    held.plan[2].on_timeout = "hold"
    assert held.advance() == "waiting" and held.timed_out() == "cancelled" and log == names[:2]
    assert runs.Run(plan(), stages([], "dedup")).advance() == "failed"
    optional = runs.Run(plan(), stages([], "style"))
    assert optional.advance() == "review" and optional.states["style"] == "skipped"


def test_a_rescan_is_applied(spark):
    images = spark.createDataFrame([(1, 1, "a/x.jpg", "x.jpg", 10, 0, 5, "jpeg", "/c/1", None), (2, 1, "y.jpg", "y.jpg", 10, 0, None, "jpeg", None, 3), (4, 1, "z.jpg", "z.jpg", 10, 0, None, "jpeg", None, None)], catalog.SCHEMAS["images"])
    scan = spark.createDataFrame([("a/x.dng", "raw", 9, True, 77), ("z.jpg", "jpeg", 8, True, 10), ("n.jpg", "jpeg", None, True, 11), ("b.jpg", "jpeg", 6, True, 12)], "file_path string, kind string, captured_at long, emitted boolean, file_size long")
    actions = projects.rescan_actions(scan, images, raw_aware=True, support_raw=True)
    done = projects.apply_rescan(images, actions, scan, 1, 99)
    assert done.columns == images.columns
    assert rows(done, "id", "file_path", "file_name", "kind", "captured_at", "recipe_id", "preview_cache_path", "file_size") == [
        (1, "a/x.dng", "x.dng", "raw", 9, 5, None, 77), (4, "z.jpg", "z.jpg", "jpeg", 8, None, None, 10), (5, "b.jpg", "b.jpg", "jpeg", 6, None, None, 12), (6, "n.jpg", "n.jpg", "jpeg", None, None, None, 11)]
    assert rows(done.filter("id > 4"), "imported_at", "project_id") == [(99, 1), (99, 1)]
    tags = spark.createDataFrame([(1, 7), (2, 7)], "image_id long, tag_id long")
    assert rows(projects.without_images(tags, actions), "image_id") == [(1,)]
    again = projects.rescan_actions(scan, done, raw_aware=True, support_raw=True)
    assert again.filter("action not in ('match', 'keep')").count() == 0


def test_versions_are_created(spark):
    recipes = spark.createDataFrame([(1, None, "Origin"), (3, None, "Rome 1960")], "id long, parent_id long, name string").withColumns({"is_system": F.lit(True), "contrast": F.lit(20.0), "deleted_at": F.lit(None).cast("long")})
    more, new = projects.create_version(recipes, 3, None, {"contrast": 12}, 5)
    assert new == 4 and rows(more.filter("id = 4"), "parent_id", "name", "is_system", "contrast", "deleted_at") == [(3, None, False, 12.0, None)]
    for bad in (4, 9):
        with pytest.raises(projects.ProjectError):
            projects.create_version(more, bad, "n", {}, 5)
    with pytest.raises(ValueError):
        projects.create_version(recipes, 3, "n", {"grain": 1}, 5)
