"""Further registered queries: small operators of the inventory, each with its oracle."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions import color, scalar, text
from siftwork.operators import commands, models, projects, replies, scope, select, tagging, tournament
from siftwork.plans.catalogue import query
from siftwork.sources import catalog as c
from siftwork.sources import containers
from siftwork.streaming import queue, sessions, store

c.VIEWS["recipes"] = """recipes AS (SELECT p_partkey AS id, CASE WHEN p_partkey > 20 THEN p_partkey % 20 + 1 END AS parent_id, 'r' || CAST(p_partkey AS VARCHAR) AS name, CASE WHEN p_partkey > 20 AND p_partkey % 7 = 0 THEN 5 END AS deleted_at FROM part)"""


def _recipes(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as recipes: twenty presets, the others their versions."""
    k = F.col("p_partkey")
    return c.table(spark, sf, "part").select(k.alias("id"), F.when(k > 20, k % 20 + 1).alias("parent_id"), F.concat(F.lit("r"), k.cast("string")).alias("name"), F.when((k > 20) & (k % 7 == 0), 5).cast("long").alias("deleted_at"))


@query("SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS n FROM recipes WHERE parent_id IS NOT NULL AND deleted_at IS NULL", "recipes")
def recipe_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Live versions and their numbers."""
    return projects.live_versions(_recipes(spark, sf)).select("id", "parent_id", "n")


@query(
    """live AS (SELECT id, parent_id, row_number() OVER (PARTITION BY parent_id ORDER BY id) AS n FROM recipes WHERE parent_id IS NOT NULL AND deleted_at IS NULL)
SELECT 'r3:2' AS address, id FROM live WHERE parent_id = 3 AND n = 2 UNION ALL SELECT 'r3', id FROM recipes WHERE name = 'r3' AND parent_id IS NULL UNION ALL SELECT 'r5:1', id FROM live WHERE parent_id = 5 AND n = 1""",
    "recipes",
)
def recipe_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses of presets and versions; `r3:0` has none."""
    r, out = _recipes(spark, sf), None
    for address in ("r3:2", "r3", "r5:1", "r3:0"):
        part = projects.resolve_address(r, address).select(F.lit(address).alias("address"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT r.id, coalesce(r.parent_id, r.id) AS preset_id, p.name AS preset_name FROM recipes r LEFT JOIN recipes p ON p.id = coalesce(r.parent_id, r.id)", "recipes")
def recipe_looks(spark: SparkSession, sf: str) -> DataFrame:
    """Each recipe's preset."""
    return projects.looks(_recipes(spark, sf)).select("id", "preset_id", "preset_name")


@query("SELECT id, CASE WHEN id = 30 THEN 'renamed' ELSE name END AS name, CASE WHEN id = 31 THEN 9 ELSE deleted_at END AS deleted_at FROM recipes", "recipes")
def recipe_changes(spark: SparkSession, sf: str) -> DataFrame:
    """A version renamed and another softly deleted."""
    return projects.delete_version(projects.rename_version(_recipes(spark, sf), 30, "renamed"), 31, 9).select("id", "name", "deleted_at")


@query("SELECT image_id AS id, CASE WHEN image_id % 4 = 0 THEN 22 END AS recipe_id FROM items", "items")
def recipe_batch(spark: SparkSession, sf: str) -> DataFrame:
    """A recipe set on a batch."""
    images = c.items(spark, sf).select(F.col("image_id").alias("id"), F.lit(None).cast("long").alias("recipe_id"))
    return projects.set_recipe(images, _recipes(spark, sf), c.items(spark, sf).filter("image_id % 4 = 0").select("image_id"), 22)


@query("SELECT image_id, row_number() OVER (ORDER BY image_id) + 3 AS position FROM items WHERE image_id NOT IN (0, 50, 100) UNION ALL SELECT image_id, image_id // 50 + 1 FROM items WHERE image_id IN (0, 50, 100)", "items")
def position_allocation(spark: SparkSession, sf: str) -> DataFrame:
    """All items added to an ordered tag, each twice; what is there keeps its position, repeats count once."""
    tags = spark.createDataFrame([(1, 1, "t", None, True, False)], "id long, project_id long, name string, cap long, is_ordered boolean, is_system boolean")
    held = spark.createDataFrame([(i, 1, i // 50 + 1, 0) for i in (0, 50, 100)], "image_id long, tag_id long, position long, tagged_at long")
    e = c.items(spark, sf).select(F.col("image_id").alias("ordinal"), "image_id")
    images = c.items(spark, sf).select(F.col("image_id").alias("id"), F.lit(1).cast("long").alias("project_id"))
    return tagging.add_entries(held, tags, images, 1, e.unionAll(e), 1).select("image_id", "position")


@query("SELECT image_id, tag_id FROM image_tags WHERE tag_id <> 2 AND NOT (tag_id = 1 AND image_id % 9 = 0)", "items tags image_tags")
def tag_removal(spark: SparkSession, sf: str) -> DataFrame:
    """Entries removed and a tag deleted with its entries."""
    it = c.image_tags(spark, sf)
    t = c.tags(spark, sf).withColumnRenamed("tag_id", "id").withColumn("is_system", F.lit(False))
    _, left = tagging.delete_tag(t, it, 2)
    return tagging.remove_entries(left, 1, c.items(spark, sf).filter("image_id % 9 = 0").select("image_id")).select("image_id", "tag_id")


@query("SELECT project_id, image_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, file_path, image_id) AS k, count(*) OVER (PARTITION BY project_id) AS n FROM items", "items")
def list_positions(spark: SparkSession, sf: str) -> DataFrame:
    """K of n."""
    return select.list_positions(select.browse_rank(c.items(spark, sf))).select("project_id", "image_id", F.col("rank").alias("k"), "n")


@query("WITH t AS (SELECT p_partkey AS tag_id, p_brand AS project, p_name AS name, p_size % 5 = 0 AS is_system FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY tag_id) AS k, count(*) OVER (PARTITION BY project) AS n FROM t WHERE NOT is_system) SELECT project, tag_id, name, greatest(0, n - 8) AS hidden FROM k WHERE k <= 8")
def tag_menu(spark: SparkSession, sf: str) -> DataFrame:
    """Each project's menu of tags and how many it hides."""
    part = c.table(spark, sf, "part").select(F.col("p_partkey").alias("tag_id"), F.col("p_brand").alias("project"), F.col("p_name").alias("name"), (F.col("p_size") % 5 == 0).alias("is_system"))
    return scope.menu(part, "project").select("project", "tag_id", "name", "hidden")


@query(
    """r AS (SELECT project_id, image_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, image_id) AS rank FROM items WHERE image_id % 3 <> 0)
SELECT project_id, image_id, rank FROM r WHERE rank <= 4""",
    "items",
)
def exclude_then_head(spark: SparkSession, sf: str) -> DataFrame:
    """Excludes dropped, then the head of each list."""
    e = c.items(spark, sf)
    return select.head_without(select.delivery_rank(e), e.filter("image_id % 3 = 0"), 4).select("project_id", "image_id", "rank")


@query("SELECT row_number() OVER (ORDER BY captured_at DESC NULLS LAST, file_path, image_id) AS ordinal, image_id FROM items", "items")
def scope_all(spark: SparkSession, sf: str) -> DataFrame:
    """The scope of all images, numbered over the whole table without a single-partition window."""
    return scope.resolve(scope.parse("*"), c.items(spark, sf), None, None)[0]


@query("SELECT project_id, bool_and(event_type = 'view') AS delivered, count(*) FILTER (event_type <> 'view') AS missing FROM items GROUP BY project_id", "items")
def already_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a selection is a subset of what was sent."""
    e = c.items(spark, sf)
    return select.already_delivered(e, e.filter("event_type = 'view'"))


@query(
    """WITH p AS (SELECT * FROM (VALUES ('dedup', ['拒']), ('curate', ['拒', '重复']), ('pick', ['拒', '重复']), ('export', ['拒', '重复']), ('evaluate', ['拒'])) AS t(command, names)),
held AS (SELECT event_id AS image_id, CASE event_id % 4 WHEN 0 THEN ['拒'] WHEN 1 THEN ['重复'] WHEN 2 THEN [] ELSE ['拒', '重复'] END AS names FROM events)
SELECT command, image_id FROM held, p WHERE NOT list_has_any(held.names, p.names)"""
)
def exclusion_policy(spark: SparkSession, sf: str) -> DataFrame:
    """The candidates that each command keeps of the whole table."""
    e = c.table(spark, sf, "events").select(F.col("event_id").alias("image_id"))
    tags = spark.createDataFrame([(1, scope.REJECT), (2, scope.DUPLICATE)], "id bigint, name string")
    held = e.withColumn("tag_id", F.explode(F.expr("case image_id % 4 when 0 then array(1L) when 1 then array(2L) when 2 then array() else array(1L, 2L) end")))
    out = None
    for command in scope.EXCLUDED:
        part = commands.candidates(command, e, tags, held).select(F.lit(command).alias("command"), "image_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """SELECT vec_id, CAST(least(vec_id * 3 + 1, floor((vec_id * 3 + 1) * s)) AS INTEGER) AS w, CAST(greatest(1, floor((vec_id + 1) * s)) AS INTEGER) AS h, to_base64(encode('v' || CAST(vec_id AS VARCHAR))) AS code
FROM (SELECT vec_id, least(1.0, 1024.0 / (vec_id * 3 + 1), 1024.0 / (vec_id + 1)) AS s FROM (SELECT vec_id * 16 AS vec_id FROM embeddings))"""
)
def fit_and_encode(spark: SparkSession, sf: str) -> DataFrame:
    """Size within a box, base64."""
    e = c.table(spark, sf, "embeddings").select((F.col("vec_id") * 16).alias("vec_id"))
    fit = scalar.fit_within((F.col("vec_id") * 3 + 1).cast("double"), (F.col("vec_id") + 1).cast("double"), 1024, 1024)
    return e.select("vec_id", fit.getField("w").alias("w"), fit.getField("h").alias("h"), F.base64(F.concat(F.lit("v"), F.col("vec_id").cast("string")).cast("binary")).alias("code"))


@query(
    """g AS (SELECT vec_id, list_transform(range(72), lambda i: (vec_id * (i + 3) * 7 + i * i) % 256) AS g FROM embeddings)
SELECT vec_id, array_to_string(list_transform(range(63, -1, -1), lambda i: CASE WHEN g[(i // 8) * 9 + i % 8 + 1] > g[(i // 8) * 9 + i % 8 + 2] THEN '1' ELSE '0' END), '') AS bits FROM g""".replace("g AS (", "WITH g AS (", 1)
)
def difference_hash(spark: SparkSession, sf: str) -> DataFrame:
    """the difference hash of a 9 x 8 grid, bit by bit, the highest first."""
    v = F.col("vec_id")
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: (v * (i + 3) * 7 + i * i) % 256)
    return c.table(spark, sf, "embeddings").select("vec_id", F.lpad(F.bin(scalar.dhash(grid)), 64, "0").alias("bits"))


@query("SELECT event_id, event_id % 256 AS r, (event_id * 7) % 256 AS g, (event_id * 13) % 256 AS b FROM events")
def lut_identity(spark: SparkSession, sf: str) -> DataFrame:
    """the identity grade through a 17-step table leaves every pixel as it is."""
    px = c.table(spark, sf, "events").select("event_id", *[((F.col("event_id") * k) % 256).alias(n) for n, k in (("r", 1), ("g", 7), ("b", 13))])
    return color.looked_up(px, color.graded_lut(17)).select("event_id", *[F.col(n).cast("long").alias(n) for n in "rgb"])


@query()
def preset_renders(spark: SparkSession, sf: str) -> DataFrame:
    """every pixel under each preset and one version: table, knobs, grain. Held against loops over pixels in the tests."""
    e, out = F.col("event_id"), None
    px = c.table(spark, sf, "events").select("event_id", (e % 4096).alias("x"), F.expr("event_id div 4096").alias("y"), *[((e * k) % 256).alias(n) for n, k in (("r", 1), ("g", 7), ("b", 13))])
    for name in (color.ORIGIN, *color.PRESETS):
        amount = 0.0 if name == color.ORIGIN else color.PRESETS[name][5]
        part = color.rendered(px, color.preset_lut(name), color.Adjust(contrast=10.0, red=-5.0), amount).select(F.lit(name).alias("preset"), "event_id", *[F.col(n).cast("int").alias(n) for n in "rgb"])
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT image_id, 'item ' || CAST(image_id AS VARCHAR) AS assessment, image_id % 3 = 0 AS unusable, 'c' AS content, CASE WHEN image_id % 11 = 0 THEN 'parse_error' END AS error FROM evaluations WHERE image_id % 11 <> 0 UNION ALL SELECT image_id, NULL, NULL, NULL, 'parse_error' FROM evaluations WHERE image_id % 11 = 0", "evaluations")
def evaluate_batch(spark: SparkSession, sf: str) -> DataFrame:
    """An injected evaluator over a batch; an answer of a wrong type is a parse error."""

    def ask(row: dict) -> str:
        i = row["image_id"]
        return "```json\n" + json.dumps({"assessment": f"item {i}", "unusable": "yes" if i % 11 == 0 else i % 3 == 0, "content": "c"}) + "\n```"

    return models.evaluate(c.evaluations(spark, sf), ask)


@query(
    """WITH g AS (SELECT label AS project_id, count(*) AS c, count(DISTINCT vec_id % 10) AS m FROM embeddings GROUP BY label)
SELECT project_id, c AS candidates, m AS champions, c - m AS first_stage, c - m + CASE WHEN 3 >= m THEN 0 ELSE m - 1 + 2 * CAST(ceil(log2(m)) AS BIGINT) END AS max_comparisons, c - least(3, m) AS rejects FROM g"""
)
def pick_costs(spark: SparkSession, sf: str) -> DataFrame:
    """What a pick will cost, for each project."""
    g = c.table(spark, sf, "embeddings").groupBy(F.col("label").alias("project_id")).agg(F.count("*").alias("candidates"), F.countDistinct(F.col("vec_id") % 10).alias("champions"))
    return tournament.pick_costs(g, 3)


@query("SELECT conv_id, turn AS seq FROM (SELECT *, max((turn * 7 + conv_id) % 5) OVER (PARTITION BY conv_id ORDER BY turn) AS latest FROM conversations) WHERE (turn * 7 + conv_id) % 5 >= latest OR role = 'system'")
def stale_events(spark: SparkSession, sf: str) -> DataFrame:
    """ST3: events of an earlier generation are dropped."""
    m = c.table(spark, sf, "conversations").select("conv_id", F.col("turn").alias("seq"), ((F.col("turn") * 7 + F.col("conv_id")) % 5).alias("generation"), F.col("role").alias("kind"))
    return sessions.drop_stale(m, "conv_id", ("system",)).select("conv_id", "seq")


@query(
    """g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 2 HOUR THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts)) + 7200000000 AS idle_at, count(*) AS n FROM s GROUP BY user_id, k""".replace("g AS (", "WITH g AS (", 1)
)
def idle_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """ST4: periods of activity that end after two idle hours."""
    e = c.table(spark, sf, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return sessions.idle_sessions(e, "user_id", "ts", "2 hours").select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("idle_at").alias("idle_at"), "n")


@query("SELECT user_id, min(event_id) AS event_id FROM (SELECT user_id, event_id, ts, min(ts) OVER (PARTITION BY user_id) AS first FROM events) WHERE ts = first GROUP BY user_id")
def in_flight(spark: SparkSession, sf: str) -> DataFrame:
    """ST11: the first request for an id; later ones are dropped."""
    e = c.table(spark, sf, "events").select("user_id", "event_id", F.struct(F.col("ts").cast("timestamp"), "event_id").alias("ts"))
    return sessions.drop_in_flight(e, "user_id", "ts").select("user_id", "event_id")


REQUESTS = """WITH e AS (SELECT user_id % 3 AS queue_id, event_id AS seq, user_id AS image_id, CASE WHEN event_type IN ('error', 'purchase') THEN 'finish' WHEN event_type = 'signup' THEN 'looked' ELSE 'request' END AS kind, CASE WHEN event_type = 'error' THEN 'error ' || CAST(event_id AS VARCHAR) END AS error FROM events),
d AS (SELECT *, coalesce(kind <> lag(kind) OVER (PARTITION BY image_id ORDER BY seq), kind = 'request') AS taken FROM e WHERE kind <> 'looked'),
f AS (SELECT queue_id, seq, image_id, kind, error, taken FROM d UNION ALL SELECT queue_id, seq, image_id, kind, error, false FROM e WHERE kind = 'looked'),
book AS (SELECT queue_id, seq, image_id, kind, error, taken, CAST(count(*) FILTER (taken AND kind = 'request') OVER w AS BIGINT) AS ticket, CAST(count(*) FILTER (taken AND kind = 'finish') OVER w AS BIGINT) AS generation,
  CAST(count(*) FILTER (taken AND error IS NOT NULL) OVER w AS BIGINT) AS failed FROM f WINDOW w AS (PARTITION BY queue_id ORDER BY seq))"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and purchases as completions, views and clicks as requests for the user, in three queues."""
    kind = F.when(F.col("event_type").isin("error", "purchase"), "finish").when(F.col("event_type") == "signup", "looked").otherwise("request")
    error = F.when(F.col("event_type") == "error", F.concat(F.lit("error "), F.col("event_id").cast("string")))
    events = c.table(spark, sf, "events")
    return queue.ledger(events.select((F.col("user_id") % 3).alias("queue_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("image_id"), kind.alias("kind"), error.alias("error")))


@query(REQUESTS + " SELECT queue_id, seq, taken, ticket, generation, failed, ticket - generation AS pending FROM book")
def evaluation_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """ST11, ST15: which requests are taken, which completions release, and the counters behind each."""
    return _ledger(spark, sf).select("queue_id", "seq", "taken", "ticket", "generation", "failed", "pending")


@query(
    REQUESTS
    + """, l AS (SELECT queue_id, max(ticket) - max(generation) AS pending, max(failed) AS failed, max(generation) AS generation FROM book GROUP BY 1),
x AS (SELECT queue_id, image_id, error FROM book WHERE taken AND error IS NOT NULL QUALIFY row_number() OVER (PARTITION BY queue_id ORDER BY seq DESC) = 1)
SELECT queue_id, greatest(pending - 1, 0) AS queued, pending > 0 AS processing, failed, generation, image_id AS failed_image, error FROM l LEFT JOIN x USING (queue_id)"""
)
def evaluation_status(spark: SparkSession, sf: str) -> DataFrame:
    """A13, ST15: each queue's state and its latest failure."""
    book = _ledger(spark, sf)
    latest = queue.news(book, spark.createDataFrame([], "queue_id long, generation long")).select("queue_id", "failed_image", "error")
    return queue.status(book).join(latest, "queue_id", "left")


@query(
    REQUESTS
    + """, p AS (SELECT queue_id, image_id, ticket, kind FROM book WHERE taken QUALIFY row_number() OVER (PARTITION BY queue_id, image_id ORDER BY seq DESC) = 1)
SELECT queue_id, row_number() OVER (PARTITION BY queue_id ORDER BY ticket) AS position, image_id FROM p WHERE kind = 'request'"""
)
def evaluation_waiting(spark: SparkSession, sf: str) -> DataFrame:
    """ST15: what is in flight, first come first."""
    return queue.waiting(_ledger(spark, sf))


@query(
    """r AS (SELECT o_custkey AS chat_id, CAST(o_orderkey AS VARCHAR) AS run_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' ELSE 'waiting' END AS status, o_orderkey % 97 AS updated_at FROM orders),
a AS (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY updated_at DESC, run_id DESC) AS k FROM r WHERE status <> 'done')
SELECT chat_id, run_id, CASE WHEN k = 1 THEN 'resume' ELSE 'cancel' END AS action FROM a""".replace("r AS (", "WITH r AS (", 1)
)
def resumed_runs(spark: SparkSession, sf: str) -> DataFrame:
    """ST7: the latest active run of a chat resumes, others are cancelled."""
    o = c.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active").otherwise("waiting")
    return sessions.resume(o.select(F.col("o_custkey").alias("chat_id"), F.col("o_orderkey").cast("string").alias("run_id"), status.alias("status"), (F.col("o_orderkey") % 97).alias("updated_at")))


@query("SELECT o_orderkey AS run_id FROM orders WHERE o_orderstatus = 'F' AND epoch(o_orderdate) < 883612800 - 7 * 86400")
def expired_runs(spark: SparkSession, sf: str) -> DataFrame:
    """ST6: ended runs beyond their time to live."""
    o = c.table(spark, sf, "orders")
    r = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("active").alias("status"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("updated_at"))
    return sessions.expired(r, 883612800).select("run_id")


@query("SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 10 = 0 AS dead FROM events")
def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """ST2: messages that parse, and those that are set aside."""
    body = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).otherwise(F.col("props"))
    good, bad = sessions.split_bad(c.table(spark, sf, "events").withColumn("body", body), scalar.strict_json(F.col("body"), "struct<k: bigint>", ["k"]))
    return good.select("event_id", F.col("parsed.k").alias("k"), F.lit(False).alias("dead")).unionByName(bad.select("event_id", F.lit(None).cast("long").alias("k"), F.lit(True).alias("dead")))


@query("SELECT project_id, max(captured_at) AS captured_at, arg_max(image_id, (captured_at IS NOT NULL, coalesce(captured_at, 0), -image_id)) AS winner FROM items GROUP BY project_id", "items")
def pictureless_winner(spark: SparkSession, sf: str) -> DataFrame:
    """Without pictures the later one wins, no time being oldest, then the smaller id."""
    rule = [F.col("captured_at").isNotNull().desc(), F.desc("captured_at"), F.asc("image_id")]
    return tournament.top_k_total_order(c.items(spark, sf), rule, 1, "project_id").select("project_id", "captured_at", F.col("image_id").alias("winner"))


@query(
    """left_ AS (SELECT image_id FROM items WHERE project_id <> 7)
SELECT 'project' AS what, project_id AS id, count(*) AS n FROM (SELECT DISTINCT project_id FROM items) WHERE project_id <> 7 GROUP BY ALL UNION ALL SELECT 'image', image_id, 1 FROM left_
UNION ALL SELECT 'tag', project_id, 1 FROM (SELECT DISTINCT project_id FROM items) WHERE project_id <> 7 UNION ALL SELECT 'entry', image_id, count(*) FROM image_tags JOIN left_ USING (image_id) GROUP BY ALL
UNION ALL SELECT 'evaluation', image_id, count(*) FROM evaluations WHERE image_id NOT IN (SELECT image_id FROM items WHERE project_id = 7) GROUP BY ALL""",
    "items tags image_tags evaluations",
)
def project_deletion(spark: SparkSession, sf: str) -> DataFrame:
    """A project deleted with all that belongs to it: what is left of the five tables."""
    e = c.items(spark, sf)
    p = e.select(F.col("project_id").alias("id")).distinct()
    it = c.image_tags(spark, sf).select("image_id", "tag_id")
    left = projects.delete_project(p, e.withColumn("id", F.col("image_id")), e.select("project_id").distinct(), it, c.evaluations(spark, sf), 7)
    out = None
    for what, key, df in zip(("project", "image", "tag", "entry", "evaluation"), ("id", "image_id", "project_id", "image_id", "image_id"), left):
        part = df.groupBy(F.lit(what).alias("what"), F.col(key).alias("id")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, CASE WHEN event_id % 4000 = 0 THEN NULL ELSE greatest(1, CAST(round_even(event_id % 4000 * 40 / 60.0, 0) AS INTEGER)) END AS minutes FROM events")
def cost_minutes(spark: SparkSession, sf: str) -> DataFrame:
    """How long a local model takes for so many calls."""
    e = c.table(spark, sf, "events")
    return e.select("event_id", text.minutes(F.col("event_id") % 4000).alias("minutes"))


@query("SELECT doc_id, CASE WHEN strlen(f) <= 240 THEN f ELSE left(f, cut) || '...' END AS line FROM (SELECT *, (SELECT max(k) FROM (SELECT unnest(range(57, 241)) AS k) WHERE strlen(left(f, k)) <= 240) AS cut FROM (SELECT doc_id, translate(text, chr(10) || chr(13), '  ') AS f FROM documents))")
def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """texts as lines of the log, cut between characters."""
    return c.table(spark, sf, "documents").select("doc_id", text.log_line(F.col("text")).alias("line"))


@query("SELECT o_custkey AS chat_id, 'c' || CAST(o_custkey AS VARCHAR) AS run_id, row_number() OVER (PARTITION BY o_custkey ORDER BY name) AS ordinal, name FROM (SELECT DISTINCT o_custkey, 'p' || CAST(o_orderkey % 100 AS VARCHAR) AS name FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'))")
def drained_queue(spark: SparkSession, sf: str) -> DataFrame:
    """S30, ST10: photos that came while a run was under way, given to the next one in order of name."""
    o = c.table(spark, sf, "orders")
    busy = o.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("chat_id"), F.lit("active").alias("status"))
    photos = o.select(F.col("o_custkey").alias("chat_id"), F.concat(F.lit("p"), (F.col("o_orderkey") % 100).cast("string")).alias("name"), F.col("o_orderkey").alias("at"))
    _, pending = store.arrivals(photos, busy)
    runs = o.select(F.col("o_custkey").alias("chat_id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("run_id")).distinct()
    done = store.drained(pending, runs)
    return done.select(F.substring("run_id", 2, 20).cast("long").alias("chat_id"), "run_id", "ordinal", "name")


@query("""r AS (SELECT o_orderkey % 500 AS run_id, o_orderkey AS updated_at, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'active' ELSE 'waiting' END AS status FROM orders)
SELECT run_id, arg_max(status, updated_at) AS status, max(updated_at) AS updated_at FROM r GROUP BY run_id HAVING arg_max(status, updated_at) <> 'done'""".replace("r AS (", "WITH r AS (", 1))
def active_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs stored one after another, the last of each counts; those that haven't ended."""
    o = c.table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "active").otherwise("waiting")
    r = o.select((F.col("o_orderkey") % 500).alias("run_id"), F.col("o_orderkey").alias("updated_at"), status.alias("status"))
    return store.active(store.save(r.limit(0), r)).select("run_id", "status", "updated_at")


@query("SELECT image_id, CASE WHEN image_id % 3 = 0 THEN ['a', 'b'] WHEN image_id % 3 = 1 THEN ['a', 'c'] ELSE ['c'] END AS excluded FROM items", "items")
def swapped_out(spark: SparkSession, sf: str) -> DataFrame:
    """U8: one more excluded item, each once, in order."""
    held = F.when(F.col("image_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("image_id") % 3 == 1, F.array(F.lit("a")))
    path = F.when(F.col("image_id") % 3 == 0, "b").otherwise("c")
    return c.items(spark, sf).select("image_id", replies.swapped_out(held, path).alias("excluded"))


@query("SELECT count(*) FILTER (event_type = 'view') AS queued, count(*) FILTER (event_type = 'click') AS processing, count(*) FILTER (event_type = 'error') AS failed FROM events")
def task_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation tasks by state."""
    state = F.expr("case event_type when 'view' then 'queued' when 'click' then 'processing' when 'error' then 'failed' else 'other' end")
    return store.counters(c.table(spark, sf, "events").select(state.alias("state")))


@query("SELECT t.image_id, t.tag_id, g.name, count(*) OVER (PARTITION BY t.tag_id) AS n_images FROM image_tags t JOIN tags g USING (tag_id)", "items tags image_tags")
def image_tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Each image's tags, with how many images carry them."""
    return tagging.tags_of_images(c.tags(spark, sf).select("tag_id", "name"), c.image_tags(spark, sf)).select("image_id", "tag_id", "name", "n_images")


@query("SELECT image_id, CASE WHEN image_id % 7 <> 0 THEN captured_at // 1000000 END AS captured_at FROM items", "items")
def exif_times(spark: SparkSession, sf: str) -> DataFrame:
    """Capture times walked out of the bytes of JPEG and TIFF files, of both byte orders, some with a segment in front, some cut off."""
    text = F.date_format(F.timestamp_micros("captured_at"), "yyyy:MM:dd HH:mm:ss").cast("binary")
    i = F.col("image_id")
    bare = lambda x: F.unhex(F.lit(x.replace(" ", "")))
    little = bare("49492A0008000000 0100 6987 0400 01000000 1A000000 00000000 0100 0390 0200 14000000 2C000000 00000000")
    big = bare("4D4D002A00000008 0001 8769 0004 00000001 0000001A 00000000 0001 9003 0002 00000014 0000002C 00000000")
    tiff = F.concat(F.when(i % 2 == 0, little).otherwise(big), text, bare("00"))
    front = F.when(i % 3 == 0, bare("FFE0 0010 4A46494600 010200000100010000")).otherwise(bare(""))
    jpeg = F.concat(bare("FFD8"), front, bare("FFE1 0048 457869660000"), tiff, bare("FFDA0002FFD9"))
    whole = F.when(i % 5 == 0, tiff).otherwise(jpeg)
    content = F.when(i % 7 == 0, F.expr("substring(whole, 1, 60)")).otherwise(F.col("whole"))
    files = c.items(spark, sf).select("image_id", whole.alias("whole")).select("image_id", content.alias("content"))
    return containers.capture_times(files, ["image_id"]).select("image_id", "captured_at")
