"""Commands, tournaments, replies and stores on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import text
from siftwork.operators import commands, curate, navigate, replies, scope, select, tournament
from siftwork.plans import runs
from siftwork.streaming import store

rows = lambda df, *cols: sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def project(spark, shots, rejected=(), held=()):
    """shots: (image_id, captured_at, hash); tags reject 1, duplicate 2, best 3."""
    images = spark.createDataFrame([(i, 1, t, h, f"p/{i}.jpg") for i, t, h in shots], "image_id long, project_id long, captured_at long, hash long, file_path string")
    tags = spark.createDataFrame([(1, 1, scope.REJECT, None, False, True), (2, 1, scope.DUPLICATE, None, False, True), (3, 1, "best", None, True, False)], "id long, project_id long, name string, cap long, is_ordered boolean, is_system boolean")
    image_tags = spark.createDataFrame([(i, 1, None, 0) for i in rejected] + list(held), "image_id long, tag_id long, position long, tagged_at long")
    return images, tags, image_tags


# two groups (1 2 3, 4 5), two alone, one without a time
SHOTS = [(1, 1000, 0), (2, 1002, 0), (3, 1004, 0), (4, 2000, 7), (5, 2003, 7), (6, 3000, 255), (7, 9000, 0), (8, None, 0)]
bigger = lambda a, b: a["image_id"] > b["image_id"]
smaller = lambda a, b: a["image_id"] < b["image_id"]


def tagged(out, tag):
    return [r[0] for r in rows(out.image_tags.filter(F.col("tag_id") == tag), "image_id")]


def test_dedup_tags_losers_and_clears_the_scope(spark):
    images, tags, held = project(spark, SHOTS, rejected=[5], held=[(7, 2, None, 0), (5, 2, None, 0), (7, 3, 1, 0)])
    ids = images.select("image_id")
    out = commands.dedup(1, ids, images, tags, held, 9)
    assert (out.outcome, out.groups, out.tagged, out.skipped, out.fallbacks, out.remaining) == ("done", 1, 2, 1, 0, 5)
    assert tagged(out, 2) == [1, 2] and tagged(out, 1) == [5] and tagged(out, 3) == [7]
    heard = []
    first = commands.dedup(1, ids, images, tags, held.filter("tag_id <> 1"), 9, compare=smaller, gate=lambda c: heard.append(c) or True)
    assert heard == [{"groups": 2, "comparisons": 3, "candidates": 5}] and tagged(first, 2) == [2, 3, 5]
    failing = commands.dedup(1, ids, images, tags, held.filter("tag_id <> 1"), 9, compare=lambda a, b: None if a["image_id"] in (4, 5) else a["image_id"] < b["image_id"])
    assert failing.fallbacks == 1 and tagged(failing, 2) == [2, 3, 4]  # the latest stays where the comparator failed
    declined = commands.dedup(1, ids, images, tags, held, 9, compare=smaller, gate=lambda c: False)
    assert declined.outcome == "declined" and tagged(declined, 2) == [5, 7]
    assert commands.dedup(1, ids, images, tags, held, 9, cancelled=lambda: True).outcome == "cancelled"
    assert commands.dedup(1, ids.limit(0), images, tags, held, 9).outcome == "empty"


def test_curate_applies_the_tag_anew_in_order(spark):
    images, tags, held = project(spark, SHOTS, rejected=[7], held=[(6, 3, 1, 0), (3, 2, None, 0)])
    ids = images.select("image_id")
    out = commands.curate(1, ids, images, tags, held, 2, "BEST", 9)
    assert rows(out.selected, "ordinal", "image_id", "file_path") == [(1, 6, "p/6.jpg"), (2, 2, "p/2.jpg")]
    assert rows(out.image_tags.filter("tag_id = 3"), "position", "image_id") == [(1, 6), (2, 2)]
    new = commands.curate(1, ids, images, tags, held, 2, "album", 9, exclude=spark.createDataFrame([(6,)], "image_id long"))
    assert rows(new.tags.filter("name = 'album'"), "id", "is_ordered") == [(4, True)] and [r[1] for r in rows(new.selected, "ordinal", "image_id")] == [5, 2]
    assert commands.curate(1, ids.limit(0), images, tags, held, 2, "best", 9).outcome == "empty"
    # the scope of the duplicate tag itself isn't left out
    assert rows(commands.curate(1, ids.filter("image_id = 3"), images, tags, held, 2, "best", 9, scope_tag=2).selected, "image_id") == [(3,)]


def test_curate_with_a_model(spark):
    images, _, _ = project(spark, SHOTS[:7])
    answer = lambda i: {"assessment": "a", "unusable": i == 7, "content": f"c{i}"}
    seen, heard = [], []

    def pick(candidates, n):
        seen.append([(x["number"], x["image_id"], x.get("unusable")) for x in candidates])
        return [2, 1, 2], " cap "

    got = curate.curate(images, 2, window=10, threshold=5, evaluate=answer, choose=pick, gate=lambda c: heard.append(c) or True)
    # all of the preselection is shown, what is unusable too
    assert seen == [[(1, 3, False), (2, 5, False), (3, 6, False), (4, 7, True)]] and heard == [{"comparisons": 0, "evaluations": 4}]
    assert (got.ids, got.caption, sorted(got.evaluated), got.selection_fallback) == ([5, 3], "cap", [3, 5, 6, 7], False)
    cached = spark.createDataFrame([(i, '{"assessment":"a","unusable":true,"content":"c"}') for i in (3, 5, 6, 7)], "image_id long, result_json string")
    heard.clear()
    none = curate.curate(images, 2, window=10, threshold=5, evaluations=cached, evaluate=answer, choose=lambda d, n: ([9], "x"), gate=lambda c: heard.append(c) or False)
    assert (none.ids, none.selection_fallback, none.evaluated, heard) == ([7, 3], True, [], [])  # nothing to evaluate: no gate
    both = curate.curate(images, 2, window=10, threshold=5, evaluate=answer, choose=lambda d, n: None, compare=smaller, gate=lambda c: heard.append(c) or True)
    assert heard == [{"comparisons": 3, "evaluations": 4}] and both.ids == [7, 1] and sorted(both.evaluated) == [1, 4, 6, 7]
    few = curate.curate(images, 9, window=10, threshold=5, evaluate=lambda i: 1 / 0, choose=lambda d, n: 1 / 0)
    assert few.ids == [7, 6, 5, 3] and few.evaluated == []  # fewer clusters than asked for: all of them, nothing is paid
    assert curate.curate(images, 2, window=10, threshold=5, evaluate=answer, choose=pick, gate=lambda c: False).outcome == "declined"
    calls = []
    late = curate.curate(images, 2, window=10, threshold=5, evaluate=lambda i: calls.append(i) or answer(i), choose=pick, cancelled=lambda: len(calls) >= 2)
    assert late.outcome == "cancelled" and len(late.evaluated) == 2 and late.ids == []
    failed = curate.curate(images, 2, window=10, threshold=5, evaluate=lambda i: None, choose=lambda d, n: ([1, 2], ""), compare=lambda a, b: 1 / 0)
    assert failed.comparison_fallbacks == 2 and failed.ids == [3, 5]


def test_pick_rejects_all_others_or_writes_nothing(spark):
    images, tags, held = project(spark, SHOTS, rejected=[7], held=[(6, 2, None, 0)])
    ids, heard = images.select("image_id"), []
    out = commands.pick(1, ids, images, tags, held, 1, bigger, 9, 10, 5, gate=lambda c: heard.append(c) or True)
    cost = {"candidates": 6, "champions": 3, "first_stage": 3, "max_comparisons": 3 + tournament.comparison_bound(3, 1), "rejects": 5}
    assert heard == [cost] and out.cost == cost and out.comparisons <= cost["max_comparisons"]
    assert rows(out.selected, "ordinal", "image_id") == [(1, 8)] and tagged(out, 1) == [1, 2, 3, 4, 5, 7]
    all_champions = commands.pick(1, ids, images, tags, held, 4, bigger, 9, 10, 5)
    assert sorted(r[0] for r in rows(all_champions.selected, "image_id")) == [3, 5, 8] and tagged(all_champions, 1) == [1, 2, 4, 7]
    for o, kind in ((commands.pick(1, ids, images, tags, held, 6, bigger, 9), "insufficient"), (commands.pick(1, ids, images, tags, held, 0, bigger, 9), "insufficient"), (commands.pick(1, ids, images, tags, held, 1, bigger, 9, gate=lambda c: False), "declined"), (commands.pick(1, ids, images, tags, held, 1, bigger, 9, cancelled=lambda: True), "cancelled"), (commands.pick(1, ids, images, tags, held, 1, lambda a, b: None, 9, 10, 5), "cancelled")):
        assert o.outcome == kind and tagged(o, 1) == [7]


def test_grouped_tournaments(spark):
    rng = random.Random(1)
    data = [(g, g * 100 + i, rng.random(), i % 3 > 0, i * 10) for g in range(5) for i in range(1 + g * 3)]
    df = spark.createDataFrame(data, "g long, image_id long, score double, decodable boolean, captured_at long").repartition(4)
    better = lambda a, b: a["score"] > b["score"]
    plain = df.withColumn("decodable", F.lit(True)).withColumn("fallback", F.col("image_id"))
    for g, rank, i in rows(tournament.top_k_in_groups(plain, better, 3, ["g"]), "g", "rank", "image_id"):
        assert i == sorted((x for x in data if x[0] == g), key=lambda x: -x[2])[rank - 1][1]
    won = {r.g: r for r in tournament.eliminated(plain, better, ["g"]).collect()}
    assert all(won[g].winner == max((x for x in data if x[0] == g), key=lambda x: x[2])[1] and won[g].comparisons == g * 3 and not won[g].failed for g in won)
    blind = tournament.eliminated(df.withColumn("decodable", F.lit(False)).withColumn("fallback", F.col("image_id")), lambda a, b: 1 / 0, ["g"])
    assert {r.winner for r in blind.collect()} == {max(x[1] for x in data if x[0] == g) for g in range(5)}  # the later one, without asking
    bad = tournament.top_k_in_groups(plain, lambda a, b: None, 2, ["g"])
    assert rows(bad.filter("image_id is null"), "g") == [(1,), (2,), (3,), (4,)]
    beats = {(0, 1), (1, 2), (2, 0), (2, 3), (3, 0), (1, 3)}
    cyclic = spark.createDataFrame([(1, i) for i in range(4)], "g long, image_id long")
    order = [i for _, i in rows(tournament.top_k_in_groups(cyclic, lambda a, b: (a["image_id"], b["image_id"]) in beats, 4, ["g"]), "rank", "image_id")]
    # bracket (0 1) (2 3): 0 and 2 meet, 2 wins; then 3 and 0 meet, 3 wins; then 0; then 1
    assert order == [2, 3, 0, 1]


def test_diverse_top_by_a_loop(spark):
    def loop(points, count):
        timed, out = {i: t for i, t in points if t is not None}, []
        while timed.keys() - set(out) and len(out) < count:
            far = lambda i: min((abs(timed[i] - timed[j]) for j in out), default=timed[i])
            out.append(min(timed.keys() - set(out), key=lambda i: (-far(i), i)))
        return (out + sorted(i for i, t in points if t is None))[:count]

    rng = random.Random(5)
    groups = {p: [(p * 1000 + i, rng.choice([None, rng.randrange(60)])) for i in range(rng.randrange(1, 25))] for p in range(12)}
    df = spark.createDataFrame([(p, i, t) for p, g in groups.items() for i, t in g], "project_id long, winner long, captured_at long")
    for count in (0, 1, 3, 9):
        got = {}
        for r in select.diverse_top(df, count).orderBy("ordinal").collect():
            got.setdefault(r.project_id, []).append(r.winner)
        assert got == ({p: loop(g, count) for p, g in groups.items()} if count else {})


def test_next_untagged_is_linear(spark):
    n = 60_000  # a quadratic frame takes minutes
    r = spark.range(1, n + 1).select(F.lit(1).alias("project_id"), F.col("id").alias("image_id"), F.col("id").alias("rank"))
    got = navigate.next_untagged(r, r.filter("image_id % 3 = 0"))
    assert got.filter("next_untagged = case when image_id = 60000 then 1 when image_id % 3 = 2 then if(image_id + 2 > 60000, 1, image_id + 2) else image_id + 1 end").count() == n


def test_narrowing(spark):
    view = spark.createDataFrame([(1, 5), (2, 3), (3, 9)], "ordinal long, image_id long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "image_id long")
    kept, cursor = commands.narrowed(view, ids(9, 3, 3), 9)
    assert rows(kept, "ordinal", "image_id") == [(2, 3), (3, 9)] and cursor == 9
    assert commands.narrowed(view, ids(9, 3), 5)[1] == 3 and commands.narrowed(view, ids(1), 5) is None


def test_replies(spark):
    assert replies.gate({"action": "approve"}, []).action == "approve"
    with pytest.raises(replies.ReplyError, match="unknown_action"):
        replies.gate({"action": "ok"}, [])
    assert replies.adjustment({"action": "set_count", "count": 4, "selection_brief": ""}, []).values == {"count": 4, "selection_brief": ""}
    assert replies.adjustment({"action": "set_count", "count": 4, "selection_brief": None}, []).values == {"count": 4}
    assert replies.gate({"action": "swap_out", "index": 2}, ["a", "b"], ["x"]).values == {"exclude": ["x", "b"]}
    assert replies.gate({"action": "swap_out", "index": 1}, ["a", "b"], ["a"]).values == {"exclude": ["a"]}
    for index in (0, 3, "1", True, None):
        with pytest.raises(replies.ReplyError, match="index_out_of_range"):
            replies.adjustment({"action": "swap_out", "index": index}, ["a", "b"])
    with pytest.raises(replies.ReplyError, match="missing_selection_brief"):
        replies.adjustment({"action": "set_selection_brief"}, [])
    proposed = {"count": 3, "apply_tag": "t", "ai_enabled": True, "provider": "claude", "selection_brief": "old"}
    assert replies.confirmation({"action": "confirmed", "count": 6, "selection_brief": None}, proposed).values == {**proposed, "count": 6}
    assert replies.confirmation({"action": "confirmed", "selection_brief": ""}, proposed).values["selection_brief"] == ""
    assert replies.dedup_followup({"action": "narrow", "count": 2, "selection_brief": ""}).values == {"count": 2, "apply_tag": None, "selection_brief": None}
    with pytest.raises(replies.ReplyError, match="hallucinated"):
        replies.style_of({"recipe_name": "x"}, ["y"])
    m = spark.createDataFrame([(1, "stop"), (2, "?"), (3, "hm")], "message_id long, text string")
    answers = {"stop": '{"action": "cancel"}', "?": '{"action": "approve"}', "hm": "no json"}
    assert rows(replies.classify(m, lambda r: answers[r["text"]], "running"), "message_id", "action", "error") == [(1, "cancel", None), (2, None, "parse_error"), (3, None, "parse_error")]


def test_plans_of_intents():
    plain = replies.plan_of({})
    runs.validate_plan(plain)
    by = {s.name: s for s in plain}
    assert list(by) == ["ingest", "curate", "style", "style_all", "deliver"] and by["curate"].params["count"] == 9 and by["curate"].gate == "off"
    first = replies.plan_of({"dedup_requested": True, "ai_enabled": True, "provider": "gemini", "apply_tag": "ins", "selection_brief": "b"})
    runs.validate_plan(first)
    assert [s.name for s in first][:3] == ["ingest", "dedup", "curate"] and first[2].gate == "required" and first[2].params == {"count": None, "apply_tag": "ins", "ai_enabled": True, "provider": "gemini", "selection_brief": "b"}
    assert [s.name for s in replies.plan_of({"dedup_requested": True, "count": 5})] == list(by)  # a number makes dedup unnecessary
    for bad in ({"provider": "other"}, {"ai_enabled": "yes"}, {"count": 51}, {"count": True}, {"apply_tag": 3}, {"selection_brief": 7}):
        with pytest.raises(runs.PlanError):
            runs.validate_plan(replies.plan_of(bad))


def test_texts(spark):
    assert [text.positive_int(x) for x in ("5", " 07 ", "", "0", "-1", "1.5", "2147483647", "2147483648", "٣")] == [5, 7, None, None, None, None, 2147483647, None, None]
    assert text.take_scope_token('  #"two words" rest of it') == ('#"two words"', "rest of it") and text.take_scope_token('#"open x') == ('#"open', "x") and text.take_scope_token("  ") == ("", "")
    assert text.console_command("/pick   3 *") == ("pick", "3 *") and [text.is_scope_token(x) for x in ("*", ".", "#a", "a", "")] == [True, True, True, False, False]
    assert (text.home_path("~/a", "/h"), text.home_path("~", "/h"), text.home_path("~b", "/h"), text.home_path("~/a", "")) == ("/h/a", "/h", "~b", "~/a")
    assert [text.minutes_of_calls(*x) for x in ((0, 0, "local"), (1, 0, "local"), (3, 6, "local"), (3, 6, "gemini"))] == [None, 1, 6, None]
    assert len(text.new_run_id()) == 11
    lines = ["a\r\nb", "x" * 240, "x" * 241, "é" * 121, "x" * 239 + "é", "x" * 238 + "日" * 3, "x" * 237 + "😀" * 2, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = {r.i: r.t for r in df.select("i", text.log_line(F.col("t")).alias("t")).collect()}
    assert got == {0: "a  b", 1: "x" * 240, 2: "x" * 240 + "...", 3: "é" * 120 + "...", 4: "x" * 239 + "...", 5: "x" * 238 + "...", 6: "x" * 237 + "...", 7: None}


def test_stores(spark):
    old = spark.createDataFrame([("a", "active", 1, 7), ("b", "done", 2, 7)], "run_id string, status string, updated_at long, chat_id long")
    new = spark.createDataFrame([("b", "waiting", 5, 7), ("b", "failed", 4, 7), ("c", "collecting", 3, 8)], old.schema)
    runs_ = store.save(old, new)
    assert rows(runs_, "run_id", "status") == [("a", "active"), ("b", "waiting"), ("c", "collecting")] and store.active(runs_).count() == 3
    ids = runs_.filter("run_id = 'b'")
    marks = store.mark_cancelling(ids.limit(0), ids.unionAll(ids))
    assert marks.count() == 1 and store.clear_cancelling(marks, ids).count() == 0 and [d.count() for d in store.delete(runs_, marks, ids)] == [2, 0]
    photos = spark.createDataFrame([(7, "z.jpg", 1), (7, "a.jpg", 2), (7, "a.jpg", 3), (8, "q.jpg", 4)], "chat_id long, name string, at long")
    now, wait = store.arrivals(photos, runs_)
    assert rows(now, "name") == [("q.jpg",)] and rows(store.drained(wait, spark.createDataFrame([(7, "n")], "chat_id long, run_id string")), "run_id", "ordinal", "name") == [("n", 1, "a.jpg"), ("n", 2, "z.jpg")]
    assert store.allowed(photos, [8]).count() == 1
    shown = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3)], "run_id string, image_id long")
    tags = spark.createDataFrame([(2, 2), (2, 9), (3, 9)], "image_id long, tag_id long")
    assert rows(store.batch_view(shown, tags, 2, runs_), "run_id", "photos", "tagged", "remaining", "at_gate") == [("a", 3, 1, 2, False), ("b", 0, 0, 0, True), ("c", 0, 0, 0, False)]


def test_evaluation_sink(spark):
    held = [spark.createDataFrame([(1, "old", None, "p")], "image_id long, result_json string, extra_guidance string, provider string")]
    lost = []
    ask = lambda r: '{"assessment": "a", "unusable": false, "content": "c"}' if r["image_id"] != 3 else "broken"
    sink = store.evaluation_sink(ask, "local", lambda: held[-1], lambda df: held.append(spark.createDataFrame(df.collect(), df.schema)), lambda df: lost.extend(df.collect()))
    requests = spark.createDataFrame([(1,), (2,), (2,), (3,)], "image_id long")
    for _ in range(2):  # a batch that is run again
        sink(requests, 0)
    assert rows(held[-1], "image_id", "provider") == [(1, "local"), (2, "local")] and {r.image_id for r in lost} == {3}


def test_a_run_from_intent_to_delivery(spark):
    from siftwork.plans import stages

    images, tags, held = project(spark, SHOTS)
    images = images.withColumns({"kind": F.lit("jpeg"), "recipe_id": F.lit(None).cast("long")})
    recipes = spark.createDataFrame([(1, None, "Origin", None), (2, None, "Rome 1960", None)], "id long, parent_id long, name string, deleted_at long")
    cat = stages.Catalog(1, images, tags, held, recipes, spark.createDataFrame([], "signature string, image_id long"))
    out, broken = [], [True]

    def send(row):
        if broken and len(out) == 1:
            broken.clear()
            raise OSError("no line")
        out.append((row["image_id"], row["target"], row["route"]))

    services = stages.Services(send, match=lambda text, names: {"recipe_name": names[1]})
    chosen = lambda r: [x.image_id for x in r.outputs["curate"]["selection"].orderBy("ordinal").collect()]
    run = stages.start({"count": 2, "apply_tag": "best"}, cat, services, 9, description="warm")
    assert (run.status, run.waiting) == ("waiting", "style") and chosen(run) == [7, 3]
    assert cat.images.filter("recipe_id = 2").count() == 0  # nothing is touched before the answer
    assert run.answer() == "waiting" and run.waiting == "style_all" and cat.images.filter("recipe_id = 2").count() == 1
    assert run.answer() == "failed" and len(out) == 1 and cat.sent.count() == 1 and cat.images.filter("recipe_id = 2").count() == 2
    assert run.adjust("deliver") == "review" and len(out) == 2 and out[0][2] == "bake"  # goes on where it stopped
    assert run.adjust("deliver") == "review" and len(out) == 2  # nothing is sent twice
    assert run.outputs["deliver"]["delivered"] and run.approve() == "done"
    # another order, selection or style is another delivery
    again = stages.start({"count": 2, "apply_tag": "best"}, cat, services, 9, gates=False)
    assert again.status == "review" and len(out) == 4
    first = stages.start({"dedup_requested": True, "apply_tag": "best"}, cat, services, 9)
    assert (first.status, first.waiting, first.outputs.get("curate")) == ("waiting", "curate", None)
    assert first.outputs["dedup"] == {"tagged": 3, "remaining": 5}
    assert first.rerun("curate", count=1) == "waiting" and chosen(first) == [7] and first.waiting == "style"
    # proceeding without a number: all survivors pass through, and the tag holds them alone
    second = stages.start({"dedup_requested": True, "apply_tag": "best"}, cat, services, 9)
    second.plan[2].params["exclude"] = [r.file_path for r in cat.images.filter("image_id = 7").collect()]
    assert second.answer() == "waiting" and second.waiting == "style"
    duplicates = {r.image_id for r in cat.image_tags.join(cat.tags.filter(F.col("name") == scope.DUPLICATE).select(F.col("id").alias("tag_id")), "tag_id").collect()}
    rejects = {r.image_id for r in cat.image_tags.join(cat.tags.filter(F.col("name") == scope.REJECT).select(F.col("id").alias("tag_id")), "tag_id").collect()}
    survivors = sorted({r.image_id for r in cat.images.collect()} - duplicates - rejects - {7})
    assert chosen(second) == survivors and len(survivors) >= 3 and len(duplicates) == 3
    tagged = cat.image_tags.join(cat.tags.filter("name = 'best'").select(F.col("id").alias("tag_id")), "tag_id")
    assert [r.image_id for r in tagged.orderBy("position").collect()] == survivors
    before = len(out)
    assert second.answer() == "waiting" and second.answer() == "review" and len(out) == before + len(survivors)
