"""Every registered query of the curation engine, with its SQL oracle.

The names follow what a query does; each runs over whole tables. Queries that SQL can't express have no oracle and are held against
brute force in the tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import color, scalar
from siftwork.operators import bracket, cluster, navigate, projects, scope, select, tagging, tournament
from siftwork.plans.lineage import cut
from siftwork.sources import catalog as c
from siftwork.sources import export

QUERIES: dict = {}
ORACLES: dict = {}

HOUR = 3_600_000_000
SHOT_WINDOW, SHOT_BITS = 60, 18
TOP, MULTIPLE = 5, 2.0


def query(sql: str | None = None, views: str = "", recursive: bool = False):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = c.with_views(views, sql, recursive) if views else sql
        return f

    return keep


# SQL of time blocks and group labels; 60 and 18 are SHOT_WINDOW and SHOT_BITS
c.VIEWS["blocks"] = """gaps AS (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY project_id ORDER BY captured_at, image_id) > 60 THEN 1 ELSE 0 END AS fresh FROM shots WHERE captured_at IS NOT NULL),
blocks AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY project_id ORDER BY captured_at, image_id) AS BIGINT) AS block FROM gaps)"""
c.VIEWS["labelled"] = """links AS (SELECT a.image_id AS a, b.image_id AS b FROM blocks a JOIN blocks b ON a.project_id = b.project_id AND a.block = b.block AND a.image_id <> b.image_id
  WHERE a.bits IS NOT NULL AND b.bits IS NOT NULL AND list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) <= 18),
reach(a, b) AS (SELECT image_id, image_id FROM blocks UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
labelled AS (SELECT k.*, r.component FROM blocks k JOIN (SELECT a AS image_id, min(b) AS component FROM reach GROUP BY a) r USING (image_id))"""


# ---- scans and sources ------------------------------------------------------------


@query(
    """kinds AS (SELECT *, lower(regexp_extract(file_path, '\\.([^./]+)$', 1)) AS ext FROM (SELECT DISTINCT file_path FROM items)),
media AS (SELECT file_path, CASE WHEN ext IN ('jpg', 'jpeg') THEN 'jpeg' ELSE 'raw' END AS kind, regexp_replace(file_path, '\\.[^./]+$', '') AS stem FROM kinds WHERE ext IN ('jpg', 'jpeg', 'dng', 'raf'))
SELECT file_path, regexp_extract(file_path, '([^/]*)$', 1) AS file_name, kind, stem,
       NOT (kind = 'jpeg' AND stem IN (SELECT stem FROM media WHERE kind = 'raw')) AS emitted FROM media""",
    "items",
)
def scan_media(spark: SparkSession, sf: str) -> DataFrame:
    """Media classification and displacement of JPEGs by raw siblings."""
    files = c.items(spark, sf).select("file_path").distinct().withColumn("file_size", F.lit(0).cast("long"))
    return c.scan_media(files, True).select("file_path", "file_name", "kind", c.stem_key(F.col("file_path")).alias("stem"), "emitted")


@query(
    """SELECT image_id, CASE WHEN captured_at IS NOT NULL THEN captured_at // 1000000 END AS exif, CASE WHEN image_id % 10 <> 0 THEN image_id % 10 END AS raw_time,
  CASE WHEN image_id % 4 = 0 AND image_id % 3 = 0 THEN '/cache/' || CAST(image_id AS VARCHAR) ELSE '/root/' || file_path END AS preview FROM items""",
    "items",
)
def capture_times(spark: SparkSession, sf: str) -> DataFrame:
    """EXIF and raw capture times, preview path."""
    e = c.items(spark, sf)
    text = F.date_format(F.timestamp_micros("captured_at"), "yyyy:MM:dd HH:mm:ss")
    cache = F.when(F.col("image_id") % 3 == 0, F.concat(F.lit("/cache/"), F.col("image_id").cast("string")))
    kind = F.when(F.col("image_id") % 4 == 0, "raw").otherwise("jpeg")
    return e.select("image_id", c.capture_seconds(text).alias("exif"), c.raw_capture_seconds(F.col("image_id") % 10).alias("raw_time"), c.preview_path(F.lit("/root"), F.col("file_path"), kind, cache).alias("preview"))


_PRESET_SQL = """presets AS (SELECT * FROM (VALUES (1, 'Origin', NULL, NULL, NULL, NULL, NULL, 0), (2, 'Havana 1959', 15, -10, 35, 10, 5, 0.25), (3, 'Tokyo 1966', 12, -8, -25, -15, 8, 0.25), (4, 'Paris 1974', 10, -6, -15, -15, 5, 0.25), (5, 'Miami 1986', 0, 0, 40, 25, 0, 0.25),
  (6, 'New York 1994', -8, 10, -30, 20, -5, 0.55), (7, 'Shanghai 2010', -5, 5, 35, 18, 3, 0.10), (8, 'Munich 1951', 0, 0, -100, 45, -5, 0.55), (9, 'Rome 1960', 0, 0, -100, -10, 10, 0.25), (10, 'Berlin 1989', 0, 0, -100, 20, -8, 0.55)) AS t(id, name, wr, wb, s, c, br, grain))"""
c.VIEWS["presets"] = _PRESET_SQL


@query("SELECT CAST(id AS BIGINT) AS id, name, CAST(wr AS DOUBLE) AS wb_shift_r, CAST(wb AS DOUBLE) AS wb_shift_b, CAST(s AS DOUBLE) AS saturation, CAST(c AS DOUBLE) AS contrast, CAST(br AS DOUBLE) AS brightness, CAST(grain AS DOUBLE) AS grain_amount FROM presets", "presets")
def preset_seed(spark: SparkSession, sf: str) -> DataFrame:
    """The seeded presets, their grades and grain."""
    return color.presets(spark)


@query(
    """cell AS (SELECT id, k // 289 AS r, k // 17 % 17 AS g, k % 17 AS b, CAST(1.0 + wr / 100.0 AS FLOAT) AS gr, CAST(1.0 + wb / 100.0 AS FLOAT) AS gb, CAST(br / 100.0 AS FLOAT) AS lift, CAST(1.0 + c / 100.0 AS FLOAT) AS gc, CAST(1.0 + s / 100.0 AS FLOAT) AS gs
  FROM (SELECT *, unnest(range(4913)) AS k FROM presets WHERE wr IS NOT NULL)),
one AS (SELECT *, (CAST(r AS FLOAT) / 16::FLOAT * gr + lift - 0.5::FLOAT) * gc + 0.5::FLOAT AS x, (CAST(g AS FLOAT) / 16::FLOAT + lift - 0.5::FLOAT) * gc + 0.5::FLOAT AS y, (CAST(b AS FLOAT) / 16::FLOAT * gb + lift - 0.5::FLOAT) * gc + 0.5::FLOAT AS z FROM cell),
two AS (SELECT *, 0.299::FLOAT * x + 0.587::FLOAT * y + 0.114::FLOAT * z AS l FROM one)
SELECT CAST(id AS BIGINT) AS id, CAST(r AS INTEGER) AS r, CAST(g AS INTEGER) AS g, CAST(b AS INTEGER) AS b, CAST(round(greatest(0::FLOAT, least(1::FLOAT, l + (x - l) * gs)) * 65535::FLOAT) AS BIGINT) AS red,
  CAST(round(greatest(0::FLOAT, least(1::FLOAT, l + (y - l) * gs)) * 65535::FLOAT) AS BIGINT) AS green, CAST(round(greatest(0::FLOAT, least(1::FLOAT, l + (z - l) * gs)) * 65535::FLOAT) AS BIGINT) AS blue FROM two""",
    "presets",
)
def preset_luts(spark: SparkSession, sf: str) -> DataFrame:
    """Every cell of the presets' lookup tables, to 16 bits."""
    deep = [F.round(F.col(n) * color.single(65535)).cast("long").alias(n) for n in ("red", "green", "blue")]
    return color.preset_grid(spark).select("id", "r", "g", "b", *deep)


@query(
    """named AS (SELECT t.image_id, t.tag_id, row_number() OVER (PARTITION BY t.tag_id ORDER BY CASE WHEN g.is_ordered THEN t.position ELSE t.tagged_at END, t.image_id) AS ordinal,
  CASE WHEN lower(i.file_path) LIKE '%.dng' THEN regexp_replace(regexp_extract(i.file_path, '([^/]*)$', 1), '\\.[^./]+$', '') || '.jpg' ELSE regexp_extract(i.file_path, '([^/]*)$', 1) END AS base,
  count(*) OVER (PARTITION BY t.tag_id) AS n FROM image_tags t JOIN tags g USING (tag_id) JOIN items i USING (image_id))
SELECT image_id, tag_id, ordinal, CASE WHEN ordinal >= 10 ** greatest(2, length(CAST(n AS VARCHAR))) THEN CAST(ordinal AS VARCHAR) ELSE lpad(CAST(ordinal AS VARCHAR), CAST(greatest(2, length(CAST(n AS VARCHAR))) AS INTEGER), '0') END || '_' || base AS target FROM named""",
    "items tags image_tags",
)
def export_tag(spark: SparkSession, sf: str) -> DataFrame:
    """Each tag's entries in tag order with numbered target names."""
    rows = _in_tag_order(spark, sf).join(c.items(spark, sf).select("image_id", "file_path"), "image_id")
    return export.target_names(rows, True, ["tag_id"]).select("image_id", "tag_id", "ordinal", "target")


@query(
    """named AS (SELECT t.image_id, t.tag_id, row_number() OVER (PARTITION BY t.tag_id ORDER BY CASE WHEN g.is_ordered THEN t.position ELSE t.tagged_at END, t.image_id) AS ordinal,
  CASE WHEN lower(i.file_path) LIKE '%.dng' THEN regexp_replace(regexp_extract(i.file_path, '([^/]*)$', 1), '\\.[^./]+$', '') || '.jpg' ELSE regexp_extract(i.file_path, '([^/]*)$', 1) END AS base
  FROM image_tags t JOIN tags g USING (tag_id) JOIN items i USING (image_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY tag_id, base ORDER BY ordinal) AS k FROM named)
SELECT image_id, tag_id, CASE WHEN k = 1 THEN base ELSE regexp_extract(base, '^(.*)\\.', 1) || '_' || CAST(k AS VARCHAR) || regexp_extract(base, '(\\.[^.]*)$', 1) END AS target FROM k""",
    "items tags image_tags",
)
def export_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Collision suffixes of unnumbered targets, for each tag."""
    rows = _in_tag_order(spark, sf).join(c.items(spark, sf).select("image_id", "file_path"), "image_id")
    return export.resolve_collisions(export.target_names(rows, False, ["tag_id"]), ["tag_id"]).select("image_id", "tag_id", "target")


@query(
    """named AS (SELECT image_id, CASE WHEN lower(file_path) LIKE '%.dng' THEN regexp_replace(regexp_extract(file_path, '([^/]*)$', 1), '\\.[^./]+$', '') || '.jpg' ELSE regexp_extract(file_path, '([^/]*)$', 1) END AS base,
  CASE WHEN captured_at IS NULL THEN 'no time' END AS reason FROM items),
k AS (SELECT *, count(*) OVER (PARTITION BY base) + CASE WHEN reason IS NULL THEN count(*) FILTER (reason IS NULL) OVER (PARTITION BY base ORDER BY image_id) END AS k FROM named)
SELECT image_id, reason, regexp_extract(base, '^(.*)\\.', 1) || '_' || CAST(k AS VARCHAR) || regexp_extract(base, '(\\.[^.]*)$', 1) AS target FROM k""",
    "items",
)
def export_again(spark: SparkSession, sf: str) -> DataFrame:
    """All items exported to the folder that an export of all has filled; those without a time fail and leave their names to the next."""
    items = c.items(spark, sf)
    images = items.select(F.col("image_id").alias("id"), "file_path", c.media_kind(F.col("file_path")).alias("kind"), F.lit(None).cast("long").alias("recipe_id"))
    entries = items.select(F.col("image_id").alias("ordinal"), "image_id")
    plan = cut(export.planned(entries, images), "plan")  # of both exports
    first = export.settled(plan)
    failed = items.filter("captured_at is null").select("image_id", F.lit("no time").alias("__reason"))
    tried = plan.join(failed, "image_id", "left").withColumn("reason", F.coalesce("reason", "__reason"))
    return export.settled(tried, first).select("image_id", "reason", "target")


@query(
    """SELECT i.image_id, i.file_path, e.image_id IS NOT NULL AS evaluated, e.unusable, CASE WHEN g.is_system THEN [] ELSE [g.name] END AS tags, CASE WHEN g.is_system THEN [g.name] ELSE [] END AS system_tags
FROM items i LEFT JOIN (SELECT image_id, bool_or(unusable) AS unusable FROM evaluations GROUP BY 1) e USING (image_id) JOIN image_tags t USING (image_id) JOIN tags g USING (tag_id)""",
    "items tags image_tags evaluations",
)
def listing(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog listing with evaluation and tags."""
    ev = c.evaluations(spark, sf).groupBy("image_id").agg(F.bool_or("unusable").alias("unusable"))
    return export.listing(c.items(spark, sf), ev, c.image_tags(spark, sf), c.tags(spark, sf))


@query(
    """SELECT image_id, '{"image_id":' || CAST(image_id AS VARCHAR) || ',"path":"' || file_path || '"}' AS json, coalesce(CAST(json_extract(props, '$.k') AS BIGINT), -1) AS k FROM items JOIN (SELECT event_id AS image_id, props FROM events) USING (image_id)""",
    "items",
)
def json_records(spark: SparkSession, sf: str) -> DataFrame:
    """JSON written and parsed."""
    props = c.table(spark, sf, "events").select(F.col("event_id").alias("image_id"), "props")
    e = c.items(spark, sf).join(props, "image_id")
    return e.select("image_id", F.to_json(F.struct("image_id", F.col("file_path").alias("path"))).alias("json"), F.coalesce(scalar.strict_json(F.col("props"), "struct<k: bigint>", ["k"]).getField("k"), F.lit(-1)).alias("k"))


# ---- filters and scopes ---------------------------------------------------------------


def _in_tag_order(spark: SparkSession, sf: str) -> DataFrame:
    e = c.image_tags(spark, sf).join(c.tags(spark, sf).select("tag_id", "is_ordered"), "tag_id")
    return scope.in_tag_order(e, F.col("is_ordered")).drop("is_ordered")


@query("SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, file_path, image_id) AS rank, image_id FROM items", "items")
def browse_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each project's images in browse order."""
    return select.browse_rank(c.items(spark, sf)).select("project_id", "rank", "image_id")


@query(
    """SELECT 'view' AS what, image_id FROM items WHERE event_type = 'view' UNION ALL SELECT 'path', image_id FROM items WHERE file_path = 'd1/IMG_10.JPG' UNION ALL
SELECT 'timed', i.image_id FROM items i WHERE captured_at IS NOT NULL AND EXISTS (SELECT 1 FROM evaluations e WHERE e.image_id = i.image_id)""",
    "items evaluations",
)
def point_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """Lookups by folded name and path, semi-joins and the capture-time filter."""
    e = c.items(spark, sf)
    by_name = e.filter(scope.fold(F.col("event_type")) == scope.folded("VIEW")).select(F.lit("view").alias("what"), "image_id")
    by_path = e.filter(F.col("file_path") == "d1/IMG_10.JPG").select(F.lit("path").alias("what"), "image_id")
    timed = e.filter("captured_at is not null").join(c.evaluations(spark, sf).select("image_id"), "image_id", "left_semi").select(F.lit("timed").alias("what"), "image_id")
    return by_name.unionByName(by_path).unionByName(timed)


@query("SELECT row_number() OVER (ORDER BY CASE WHEN g.is_ordered THEN position ELSE tagged_at END, image_id) AS ordinal, image_id FROM image_tags JOIN tags g USING (tag_id) WHERE g.name = 'click'", "items tags image_tags")
def scope_tag(spark: SparkSession, sf: str) -> DataFrame:
    """The scope of one tag."""
    return scope.resolve(scope.parse('#"CLICK"'), c.items(spark, sf), c.tags(spark, sf), c.image_tags(spark, sf))[0]


@query(
    """SELECT i.image_id FROM items i WHERE i.image_id NOT IN (SELECT t.image_id FROM image_tags t JOIN tags g USING (tag_id) WHERE g.name IN ('error', 'view'))""",
    "items tags image_tags",
)
def scope_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Exclusion by tag names, an unknown one among them."""
    return scope.exclude(c.items(spark, sf).select("image_id"), c.tags(spark, sf), c.image_tags(spark, sf), ["Error", "view", "no such tag"])


@query(
    """SELECT word, image_id FROM (
 SELECT 'unevaluated' AS word, image_id FROM items WHERE image_id NOT IN (SELECT image_id FROM evaluations)
 UNION ALL SELECT 'fail', image_id FROM items WHERE image_id IN (SELECT image_id FROM evaluations WHERE unusable)
 UNION ALL SELECT 'reject', image_id FROM items WHERE event_type = 'error'
 UNION ALL SELECT 'dup', image_id FROM items WHERE event_type = 'click'
 UNION ALL SELECT 'fine', image_id FROM items WHERE event_type NOT IN ('error', 'click') UNION ALL SELECT 'clear', image_id FROM items)""",
    "items evaluations",
)
def console_filters(spark: SparkSession, sf: str) -> DataFrame:
    """The console's keywords."""
    e, ev = c.items(spark, sf), c.evaluations(spark, sf)
    rej, dup = e.filter("event_type = 'error'"), e.filter("event_type = 'click'")
    out = None
    for word in ("unevaluated", "fail", "reject", "dup", "fine", "clear"):
        part = scope.console_filter(e.select("image_id"), word, ev, rej, dup).select(F.lit(word).alias("word"), "image_id")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """SELECT image_id FROM items WHERE event_type NOT IN ('error', 'click') AND image_id NOT IN (SELECT image_id FROM evaluations WHERE unusable)""",
    "items evaluations",
)
def pass_through(spark: SparkSession, sf: str) -> DataFrame:
    """Survivors without engine tags or explicit excludes."""
    marks = F.expr("case event_type when 'error' then array('Reject') when 'click' then array('Duplicate', 'x') when 'view' then array('x') end")
    return scope.pass_through(c.items(spark, sf).select("image_id", marks.alias("system_tags")), c.evaluations(spark, sf).filter("unusable")).select("image_id")


# ---- joins and aggregates ---------------------------------------------------------------


@query(
    """p AS (SELECT DISTINCT project_id AS id FROM items UNION SELECT -1)
SELECT p.id, count(i.image_id) AS n_images FROM p LEFT JOIN items i ON i.project_id = p.id GROUP BY p.id""",
    "items",
)
def project_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Images per project, none included."""
    e = c.items(spark, sf)
    p = e.select(F.col("project_id").alias("id")).unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("id"))).distinct()
    return projects.image_counts(p, e)


@query("SELECT g.tag_id, g.name, count(t.image_id) AS n_images, coalesce(max(t.position), 0) + 1 AS next_position FROM tags g LEFT JOIN image_tags t USING (tag_id) GROUP BY ALL", "items tags image_tags")
def tag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Entries of each tag and its next position."""
    t, it = c.tags(spark, sf).select("tag_id", "name"), c.image_tags(spark, sf)
    return tagging.tag_counts(t, it).join(tagging.next_positions(it), "tag_id", "left").withColumn("next_position", F.coalesce("next_position", F.lit(1)))


@query(
    """pairs AS (SELECT a.image_id AS a, b.image_id AS b, list_sum(list_transform(list_zip(a.bits, b.bits), lambda z: CASE WHEN z[1] <> z[2] THEN 1 ELSE 0 END)) AS distance
  FROM blocks a JOIN blocks b ON a.project_id = b.project_id AND a.block = b.block AND a.image_id < b.image_id WHERE a.bits IS NOT NULL AND b.bits IS NOT NULL)
SELECT a, b, CAST(distance AS BIGINT) AS distance FROM pairs WHERE distance <= 18""",
    "shots blocks",
)
def similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one time block within a Hamming distance."""
    return cluster.all_pairs(cluster.time_blocks(c.shots(spark, sf), SHOT_WINDOW), SHOT_BITS).select("a", "b", F.col("distance").cast("long").alias("distance"))


@query("SELECT image_id, project_id, component FROM labelled", "shots blocks labelled", recursive=True)
def duplicate_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Transitive closure of similarity within time blocks."""
    return cluster.group_labels(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS).select("image_id", "project_id", "component")


@query(
    """SELECT project_id, block, component, arg_max(image_id, (captured_at, -image_id)) AS representative, count(*) AS size, list_sort(list(image_id)) AS members
FROM labelled GROUP BY project_id, block, component HAVING count(*) >= 2""",
    "shots blocks labelled",
    recursive=True,
)
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of two or more with representative and members."""
    return cluster.find_duplicates(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS)


@query(
    """g AS (SELECT project_id, block, component, count(*) AS size FROM labelled GROUP BY ALL)
SELECT count(*) FILTER (size >= 2) AS groups, coalesce(CAST(sum(size - 1) FILTER (size >= 2) AS BIGINT), 0) AS comparison_total,
  count(*) + (SELECT count(*) FROM shots WHERE captured_at IS NULL) AS candidate_total, (SELECT count(*) FROM shots WHERE captured_at IS NULL) AS skipped FROM g""",
    "shots blocks labelled",
    recursive=True,
)
def dedup_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of groups, comparisons, candidates and untimed rows."""
    chosen = cluster.cluster_and_choose(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS)
    return chosen.agg(
        F.count_if(F.col("size") >= 2).alias("groups"),
        F.coalesce(F.sum(F.col("size") - 1), F.lit(0)).alias("comparison_total"),
        F.count("*").alias("candidate_total"),
        F.count_if(F.col("captured_at").isNull()).alias("skipped"),
    )


@query(
    """marked AS (SELECT *, CASE WHEN captured_at - lag(captured_at) OVER (PARTITION BY project_id ORDER BY captured_at, image_id) > 7200000000 THEN 1 ELSE 0 END AS fresh FROM items WHERE captured_at IS NOT NULL),
b AS (SELECT *, CAST(sum(fresh) OVER (PARTITION BY project_id ORDER BY captured_at, image_id) AS BIGINT) AS block FROM marked)
SELECT project_id, block, arg_max(image_id, (captured_at, -image_id)) AS representative, count(*) AS size FROM b GROUP BY ALL""",
    "items",
)
def dedup_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Bursts of each user's events and their representatives (the flagship)."""
    return cluster.representatives(cluster.time_blocks(c.items(spark, sf), 2 * HOUR), ["project_id", "block"])


@query("SELECT event_type, count(*) AS n, CAST(avg(CAST(round(value * 1000) AS BIGINT)) AS DOUBLE) AS mean, quantile_disc(CAST(round(value * 1000) AS BIGINT), 0.95) AS p95, max(CAST(round(value * 1000) AS BIGINT)) AS most FROM events GROUP BY event_type")
def latency_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Count, mean, nearest-rank p95 and maximum."""
    e = c.table(spark, sf, "events").select("event_type", F.round(F.col("value") * 1000).cast("long").alias("v"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.expr("percentile_disc(0.95) within group (order by v)").cast("long").alias("p95"), F.max("v").alias("most"))


@query("""r AS (SELECT image_id, CASE WHEN image_id % 3 = 0 THEN image_id % 7 END AS recipe_id FROM items), ids AS (SELECT image_id FROM items UNION ALL SELECT image_id * 2 FROM items)
SELECT count(r.recipe_id) AS n FROM ids JOIN r USING (image_id)""", "items")
def recipe_count(spark: SparkSession, sf: str) -> DataFrame:
    """Ids with a recipe, repeats counted each time, unknown ones not at all."""
    e = c.items(spark, sf)
    images = e.select(F.col("image_id").alias("id"), F.when(F.col("image_id") % 3 == 0, F.col("image_id") % 7).alias("recipe_id"))
    ids = e.select("image_id").unionByName(e.select((F.col("image_id") * 2).alias("image_id")))
    return projects.count_with_recipe(ids, images)


# ---- navigation ----------------------------------------------------------------------------

RANKED = """ranked AS (SELECT project_id, image_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, file_path, image_id) AS rank, event_type FROM items)"""
c.VIEWS["ranked"] = RANKED


def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return select.browse_rank(c.items(spark, sf)).select("project_id", "image_id", "rank", "event_type")


@query(
    """SELECT project_id, image_id, coalesce(lead(image_id) OVER w, first_value(image_id) OVER w) AS next_id, coalesce(lag(image_id) OVER w, last_value(image_id) OVER (PARTITION BY project_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_id
FROM ranked WINDOW w AS (PARTITION BY project_id ORDER BY rank)""",
    "items ranked",
)
def next_previous(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours around the ends."""
    return navigate.next_previous(_ranked(spark, sf)).select("project_id", "image_id", "next_id", "previous_id")


@query(
    """free AS (SELECT project_id, rank, image_id FROM ranked WHERE event_type <> 'view'),
n AS (SELECT project_id, max(rank) AS n FROM ranked GROUP BY 1)
SELECT r.project_id, r.image_id, arg_min(f.image_id, CASE WHEN f.rank > r.rank THEN f.rank - r.rank ELSE f.rank - r.rank + n.n END) AS next_untagged
FROM ranked r JOIN n USING (project_id) LEFT JOIN free f ON f.project_id = r.project_id GROUP BY ALL""",
    "items ranked",
)
def next_untagged(spark: SparkSession, sf: str) -> DataFrame:
    """The next row without a tag, circular."""
    r = _ranked(spark, sf)
    return navigate.next_untagged(r, r.filter("event_type = 'view'")).select("project_id", "image_id", "next_untagged")


@query(
    """n AS (SELECT project_id, max(rank) AS n FROM ranked GROUP BY 1), s AS (SELECT * FROM (VALUES (0, 0), (1, 1), (2, -1), (3, 2), (4, -2)) AS t(priority, step)),
w AS (SELECT r.project_id, r.image_id, ((r.rank - 1 + s.step) % n.n + n.n) % n.n + 1 AS rank, min(s.priority) AS priority FROM ranked r JOIN n USING (project_id) CROSS JOIN s GROUP BY ALL)
SELECT w.project_id, w.image_id, w.priority, r.image_id AS neighbour FROM w JOIN ranked r ON r.project_id = w.project_id AND r.rank = w.rank""",
    "items ranked",
)
def neighbourhood(spark: SparkSession, sf: str) -> DataFrame:
    """The circular neighbourhood in order of priority."""
    return navigate.neighbourhood(_ranked(spark, sf).drop("event_type"), 2)


# ---- selection and tournaments ------------------------------------------------------------------


@query("SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, image_id) AS rank, image_id FROM items", "items")
def delivery_order(spark: SparkSession, sf: str) -> DataFrame:
    """T5: delivery order."""
    return select.delivery_rank(c.items(spark, sf)).select("project_id", "rank", "image_id")


@query(
    """picks AS (SELECT project_id AS key, row_number() OVER (PARTITION BY project_id ORDER BY image_id) AS ordinal, image_id % 13 AS pick, 10 AS pool FROM items),
ok AS (SELECT key, pick, min(ordinal) AS ordinal FROM picks WHERE pick BETWEEN 1 AND pool GROUP BY ALL),
r AS (SELECT key, pick, row_number() OVER (PARTITION BY key ORDER BY ordinal) AS rank, count(*) OVER (PARTITION BY key) AS n FROM ok)
SELECT key, rank, pick FROM r WHERE rank <= 8 AND n >= 8""",
    "items",
)
def selection_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    """Picks outside the pool and repeats go; too few means none."""
    from pyspark.sql import Window

    picks = c.items(spark, sf).select(F.col("project_id").alias("key"), F.row_number().over(Window.partitionBy("project_id").orderBy("image_id")).alias("ordinal"), (F.col("image_id") % 13).alias("pick"), F.lit(10).alias("pool"))
    return select.clean_selection_rows(picks, 8)


DIVERSE = """cand AS (SELECT project_id, arg_max(image_id, (captured_at, -image_id)) AS winner, max(captured_at) AS captured_at FROM labelled GROUP BY project_id, block, component
  UNION ALL SELECT project_id, image_id, NULL FROM shots WHERE captured_at IS NULL),
timed AS (SELECT project_id, list(struct_pack(i := winner, t := captured_at)) FILTER (captured_at IS NOT NULL) AS pool FROM cand GROUP BY project_id),
pick(project_id, pool, chosen) AS (
  SELECT project_id, pool, [list_reduce(pool, lambda a, b: CASE WHEN b.t > a.t OR (b.t = a.t AND b.i < a.i) THEN b ELSE a END)] FROM timed WHERE len(pool) > 0
  UNION ALL SELECT project_id, pool, list_append(chosen, list_reduce(list_filter(pool, lambda p: NOT list_contains(chosen, p)), lambda a, b: CASE
      WHEN list_min(list_transform(chosen, lambda x: abs(x.t - b.t))) > list_min(list_transform(chosen, lambda x: abs(x.t - a.t)))
        OR (list_min(list_transform(chosen, lambda x: abs(x.t - b.t))) = list_min(list_transform(chosen, lambda x: abs(x.t - a.t))) AND b.i < a.i) THEN b ELSE a END))
  FROM pick WHERE len(chosen) < 5 AND len(chosen) < len(pool)),
full_pick AS (SELECT project_id, arg_max(chosen, len(chosen)) AS chosen FROM pick GROUP BY project_id)"""
c.VIEWS["diverse"] = DIVERSE


@query("SELECT project_id, CAST(unnest(range(1, len(chosen) + 1)) AS BIGINT) AS ordinal, unnest(list_transform(chosen, lambda x: x.i)) AS winner FROM full_pick", "shots blocks labelled diverse", recursive=True)
def diverse_top(spark: SparkSession, sf: str) -> DataFrame:
    """Farthest-point choice among the candidates."""
    return select.diverse_top(cluster.cluster_and_choose(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS), TOP)


@query(
    """rows AS (SELECT project_id, unnest(chosen) AS x FROM full_pick)
SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY x.t DESC, x.i) AS rank, x.i AS winner FROM rows""",
    "shots blocks labelled diverse",
    recursive=True,
)
def curate(spark: SparkSession, sf: str) -> DataFrame:
    """C4 without a model: clusters, winners, diverse choice, delivery order."""
    chosen = cluster.cluster_and_choose(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS)
    return select.delivered(select.diverse_top(chosen, TOP).drop("ordinal"), chosen)


@query("SELECT project_id, block, component, arg_max(image_id, ((image_id * 7919) % 1009, -image_id)) AS winner, count(*) - 1 AS comparisons FROM labelled GROUP BY project_id, block, component HAVING count(*) >= 2", "shots blocks labelled", recursive=True)
def tournament_winners(spark: SparkSession, sf: str) -> DataFrame:
    """Single elimination in each group by an injected comparator, here a total order, in rounds of a table."""
    labels = cluster.group_labels(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS).withColumn("score", (F.col("image_id") * 7919) % 1009)
    keys = ["project_id", "block", "component"]
    several = labels.join(labels.groupBy(*keys).count().filter("count >= 2").drop("count"), keys, "left_semi")
    rows = several.select(*keys, "image_id", "score", F.col("image_id").alias("fallback"))
    return bracket.eliminated(rows, lambda a, b: a["score"] >= b["score"], keys).drop("failed")


@query("SELECT project_id, image_id, rank FROM (SELECT project_id, image_id, row_number() OVER (PARTITION BY project_id ORDER BY (image_id * 7919) % 1009 DESC, image_id) AS rank FROM items) WHERE rank <= 5", "items")
def top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Top-k of each project under a total order."""
    scored = c.items(spark, sf).withColumn("score", (F.col("image_id") * 7919) % 1009)
    return tournament.top_k_total_order(scored, [F.desc("score"), F.col("image_id")], 5, "project_id").select("project_id", "image_id", "rank")


@query(
    """cand AS (SELECT project_id, arg_max(image_id, ((image_id * 7919) % 1009, -image_id)) AS champion FROM labelled GROUP BY project_id, block, component),
top AS (SELECT * FROM (SELECT project_id, champion, row_number() OVER (PARTITION BY project_id ORDER BY (champion * 7919) % 1009 DESC, champion) AS rank FROM cand) WHERE rank <= 5)
SELECT l.project_id, l.image_id, t.champion IS NOT NULL AS selected FROM labelled l LEFT JOIN top t ON t.champion = l.image_id""",
    "shots blocks labelled",
    recursive=True,
)
def pick(spark: SparkSession, sf: str) -> DataFrame:
    """Champions of the groups, the best of them selected, all others rejected."""
    labels = cluster.group_labels(c.shots(spark, sf), SHOT_WINDOW, SHOT_BITS).withColumn("score", (F.col("image_id") * 7919) % 1009)
    better = lambda a, b: (a["score"], -a["image_id"]) > (b["score"], -b["image_id"])
    keys = ["project_id", "block", "component"]
    champions = bracket.top_k(labels.select(*keys, "image_id", "score"), better, 1, keys).select("project_id", "image_id")
    best = bracket.top_k(champions.withColumn("score", (F.col("image_id") * 7919) % 1009), better, 5, ["project_id"]).select("image_id", F.lit(True).alias("selected"))
    return labels.join(best, "image_id", "left").select("project_id", "image_id", F.coalesce("selected", F.lit(False)).alias("selected"))


@query(
    """m AS (SELECT unnest([1, 2, 2, 8, 8, 40]) AS m, unnest([1, 1, 2, 1, 8, 20]) AS k)
SELECT m, k, m - 1 + (k - 1) * CAST(ceil(log2(m)) AS BIGINT) AS bound, CAST(least(ceil(greatest(1.5, 2.0) * k), m) AS BIGINT) AS preselection FROM m"""
    .replace("m AS (", "WITH m AS (", 1)
)
def bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Comparison bound and preselection size."""
    m = spark.createDataFrame([(1, 1), (2, 1), (2, 2), (8, 1), (8, 8), (40, 20)], "m int, k int")
    bound = F.col("m") - 1 + (F.col("k") - 1) * scalar.ceil_log2(F.col("m"))
    return m.select("m", "k", bound.cast("long").alias("bound"), F.least(F.ceil(F.greatest(F.lit(1.5), F.lit(MULTIPLE)) * F.col("k")), F.col("m")).cast("long").alias("preselection"))


# ---- tables that change --------------------------------------------------------------------------


@query(
    """losers AS (SELECT l.image_id FROM labelled l WHERE l.image_id NOT IN (SELECT arg_max(image_id, (captured_at, -image_id)) FROM labelled GROUP BY project_id, block, component))
SELECT image_id, 2 AS tag_id FROM losers UNION ALL SELECT image_id, 1 FROM shots WHERE image_id % 5 = 0""",
    "shots blocks labelled",
    recursive=True,
)
def dedup_tagging(spark: SparkSession, sf: str) -> DataFrame:
    """The duplicate tag anew over the scope; other tags stay."""
    shots = c.shots(spark, sf)
    held = shots.filter("image_id % 5 = 0").select("image_id", F.lit(1).cast("long").alias("tag_id"), F.lit(None).cast("long").alias("position"), F.lit(0).cast("long").alias("tagged_at"))
    stale = shots.filter("image_id % 3 = 0").select("image_id", F.lit(2).cast("long").alias("tag_id"), F.lit(None).cast("long").alias("position"), F.lit(0).cast("long").alias("tagged_at"))
    labels = cluster.group_labels(shots, SHOT_WINDOW, SHOT_BITS)
    keep = cluster.representatives(labels, ["project_id", "block", "component"]).select(F.col("representative").alias("image_id"))
    losers = labels.select("image_id").join(keep, "image_id", "left_anti")
    done = tagging.tag_duplicates(held.unionByName(stale), shots, losers, 2, 1)
    return done.select("image_id", F.col("tag_id").cast("int").alias("tag_id"))


@query(
    r"""s AS (SELECT DISTINCT file_path FROM items WHERE image_id % 3 <> 0 AND file_path NOT LIKE '%.txt'),
cat AS (SELECT file_path, min(image_id) AS id, min(image_id) % 2 = 0 AS timed FROM items WHERE image_id % 2 = 0 AND file_path NOT LIKE '%.txt' GROUP BY 1)
SELECT coalesce(s.file_path, cat.file_path) AS file_path, cat.id, CASE WHEN s.file_path IS NOT NULL AND cat.id % 4 = 0 THEN 'backfill' WHEN s.file_path IS NOT NULL AND cat.id IS NOT NULL THEN 'match'
  WHEN cat.id IS NULL AND s.file_path LIKE '%.DNG' AND regexp_replace(s.file_path, '\.[^./]+$', '') IN (SELECT regexp_replace(file_path, '\.[^./]+$', '') FROM cat WHERE file_path NOT LIKE '%.DNG') THEN 'insert_raw'
  WHEN cat.id IS NULL THEN 'insert' ELSE 'prune' END AS action FROM s FULL JOIN cat ON s.file_path = cat.file_path""",
    "items",
)
def rescan(spark: SparkSession, sf: str) -> DataFrame:
    """What a rescan does with each file and row."""
    e = c.items(spark, sf).filter("file_path not like '%.txt'").withColumn("kind", c.media_kind(F.col("file_path")))
    scan = e.filter("image_id % 3 <> 0").select("file_path", "kind", F.lit(7).cast("long").alias("captured_at"), F.lit(True).alias("emitted")).distinct()
    cat = e.filter("image_id % 2 = 0").groupBy("file_path", "kind").agg(F.min("image_id").alias("id")).withColumn("captured_at", F.when(F.col("id") % 4 != 0, 1).cast("long"))
    return projects.rescan_actions(scan, cat, raw_aware=False, support_raw=True).select("file_path", "id", "action")


@query(
    r"""s AS (SELECT DISTINCT file_path FROM items WHERE image_id % 3 <> 0 AND file_path NOT LIKE '%.txt'),
cat AS (SELECT file_path, min(image_id) AS id, CASE WHEN min(image_id) % 4 <> 0 THEN 1 END AS captured_at FROM items WHERE image_id % 2 = 0 AND file_path NOT LIKE '%.txt' GROUP BY 1),
new AS (SELECT s.file_path, regexp_extract(s.file_path, '([^/]*)$', 1) AS base, s.file_path LIKE '%.DNG' AND regexp_replace(s.file_path, '\.[^./]+$', '') IN (SELECT regexp_replace(file_path, '\.[^./]+$', '') FROM cat WHERE file_path NOT LIKE '%.DNG') AS twin
        FROM s WHERE file_path NOT IN (SELECT file_path FROM cat))
SELECT id, file_path, regexp_extract(file_path, '([^/]*)$', 1) AS file_name, coalesce(captured_at, 7) AS captured_at FROM cat JOIN s USING (file_path)
UNION ALL SELECT (SELECT max(id) FROM cat) + row_number() OVER (ORDER BY file_path), file_path, CASE WHEN twin THEN regexp_replace(base, '(\.[^.]+)$', '_raw\1') ELSE base END, 7 FROM new""",
    "items",
)
def rescanned(spark: SparkSession, sf: str) -> DataFrame:
    """D3: the table after a rescan's actions."""
    e = c.items(spark, sf).filter("file_path not like '%.txt'").withColumn("kind", c.media_kind(F.col("file_path")))
    scan = e.filter("image_id % 3 <> 0").select("file_path", "kind", F.lit(7).cast("long").alias("captured_at"), F.lit(True).alias("emitted")).distinct()
    cat = e.filter("image_id % 2 = 0").groupBy("file_path", "kind").agg(F.min("image_id").alias("id")).withColumn("captured_at", F.when(F.col("id") % 4 != 0, 1).cast("long"))
    images = cat.withColumns({"project_id": F.lit(1).cast("long"), "file_name": c.file_name(F.col("file_path"))})
    actions = projects.rescan_actions(scan, cat, raw_aware=False, support_raw=True)
    return projects.apply_rescan(images, actions, scan, 1, 0).select("id", "file_path", "file_name", "captured_at")


@query(
    """e AS (SELECT image_id, bool_or(unusable) AS unusable FROM evaluations GROUP BY 1)
SELECT image_id, unusable, image_id % 2 = 0 AS renewed FROM (SELECT image_id, CASE WHEN image_id % 2 = 0 THEN NOT unusable ELSE unusable END AS unusable FROM e)""",
    "evaluations",
)
def evaluation_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """D12, M1's storage, F19: evaluations written as JSON, renewed, and read back under the strict rule."""
    e = c.evaluations(spark, sf).groupBy("image_id").agg(F.bool_or("unusable").alias("unusable"))

    def stored(df: DataFrame, provider: str) -> DataFrame:
        result = F.to_json(F.struct(F.lit("a").alias("assessment"), "unusable", F.lit("c").alias("content")))
        return df.select("image_id", result.alias("result_json"), F.lit(None).cast("string").alias("extra_guidance"), F.lit(provider).alias("provider"))

    table = projects.upsert_evaluations(stored(e, "old"), stored(e.filter("image_id % 2 = 0").withColumn("unusable", ~F.col("unusable")), "new"))
    return projects.read_evaluations(table).join(table.select("image_id", "provider"), "image_id").select("image_id", F.col("result.unusable").alias("unusable"), (F.col("provider") == "new").alias("renewed"))


# ---- scalar functions -------------------------------------------------------------------------------


@query(
    """SELECT doc_id, CASE WHEN b >= 1073741824 THEN format('{:.1f} GB', floor(b * 10 / 1073741824 + 0.5) / 10) WHEN b >= 1048576 THEN format('{:.1f} MB', floor(b * 10 / 1048576 + 0.5) / 10) WHEN b >= 1024 THEN format('{:.1f} KB', floor(b * 10 / 1024 + 0.5) / 10) ELSE CAST(b AS VARCHAR) || ' B' END AS human,
  CASE WHEN doc_id + 1 <= 1 THEN 0 ELSE CAST(ceil(log2(doc_id + 1)) AS INTEGER) END AS ceil_log, (299 * (b % 256) + 587 * (doc_id % 256) + 114 * 7) // 1000 AS luma FROM (SELECT doc_id, n_chars * doc_id AS b FROM documents)"""
)
def scalar_functions(spark: SparkSession, sf: str) -> DataFrame:
    """luma, integer logarithm and readable sizes."""
    d = c.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") * F.col("doc_id")).alias("b"))
    return d.select("doc_id", scalar.human_size(F.col("b")).alias("human"), scalar.ceil_log2(F.col("doc_id") + 1).cast("int").alias("ceil_log"), scalar.luma(F.col("b") % 256, F.col("doc_id") % 256, F.lit(7)).cast("long").alias("luma"))


@query(
    """r AS (SELECT project_id, file_path, event_type, row_number() OVER (PARTITION BY project_id ORDER BY captured_at DESC NULLS LAST, image_id) AS k FROM items)
SELECT project_id, substr(sha256(string_agg(file_path, '|' ORDER BY k) || '||' || string_agg(file_path || '=' || CASE WHEN event_type = 'view' THEN '' ELSE event_type END, '|' ORDER BY k)), 1, 16) AS signature FROM r GROUP BY project_id""",
    "items",
)
def delivery_signature(spark: SparkSession, sf: str) -> DataFrame:
    """signature of a delivered selection, in its order and with each item's style."""
    r = select.delivery_rank(c.items(spark, sf)).select("project_id", "rank", "file_path", F.when(F.col("event_type") != "view", F.col("event_type")).alias("style"))
    g = r.groupBy("project_id").agg(F.sort_array(F.collect_list(F.struct("rank", "file_path", "style"))).alias("picked"))
    return g.select("project_id", scalar.delivery_signature(F.col("picked.file_path"), F.col("picked.style")).alias("signature"))


# an event as a pixel; knobs of the query below
_PX = "px AS (SELECT event_id, event_id % 4096 AS x, event_id // 4096 AS y, CAST(event_id % 256 AS FLOAT) / 255::FLOAT AS r, CAST((event_id * 7) % 256 AS FLOAT) / 255::FLOAT AS g, CAST((event_id * 13) % 256 AS FLOAT) / 255::FLOAT AS b FROM events)"
_KNOBS = color.Adjust(highlights=-20.0, shadows=30.0, blacks=-15.0, whites=10.0, red=12.0, blue=-8.0, contrast=25.0, saturation=-30.0)


def _pixels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    px = c.table(spark, sf, "events").select("event_id", (e % 4096).alias("x"), F.expr("event_id div 4096").alias("y"), *[((e * k) % 256).alias(n) for n, k in (("r", 1), ("g", 7), ("b", 13))])
    return px


@query(
    f"""WITH {_PX},
lum AS (SELECT *, 0.299::FLOAT * r + 0.587::FLOAT * g + 0.114::FLOAT * b AS l FROM px),
tone AS (SELECT *, CAST(-0.2 AS FLOAT) * greatest(0::FLOAT, least(1::FLOAT, (l - 0.5::FLOAT) / 0.5::FLOAT)) + CAST(0.3 AS FLOAT) * greatest(0::FLOAT, least(1::FLOAT, (0.5::FLOAT - l) / 0.5::FLOAT))
  + CAST(0.1 AS FLOAT) * greatest(0::FLOAT, least(1::FLOAT, (l - 0.8::FLOAT) / 0.2::FLOAT)) + CAST(-0.15 AS FLOAT) * greatest(0::FLOAT, least(1::FLOAT, (0.2::FLOAT - l) / 0.2::FLOAT)) AS d FROM lum),
one AS (SELECT event_id, greatest(0::FLOAT, least(1::FLOAT, r * CAST(1.12 AS FLOAT) + d)) AS r, greatest(0::FLOAT, least(1::FLOAT, g + d)) AS g, greatest(0::FLOAT, least(1::FLOAT, b * CAST(0.92 AS FLOAT) + d)) AS b FROM tone),
two AS (SELECT event_id, greatest(0::FLOAT, least(1::FLOAT, (r - 0.5::FLOAT) * 1.25::FLOAT + 0.5::FLOAT)) AS r, greatest(0::FLOAT, least(1::FLOAT, (g - 0.5::FLOAT) * 1.25::FLOAT + 0.5::FLOAT)) AS g, greatest(0::FLOAT, least(1::FLOAT, (b - 0.5::FLOAT) * 1.25::FLOAT + 0.5::FLOAT)) AS b FROM one),
three AS (SELECT *, 0.299::FLOAT * r + 0.587::FLOAT * g + 0.114::FLOAT * b AS l FROM two)
SELECT event_id, CAST(floor(greatest(0::FLOAT, least(1::FLOAT, l + (r - l) * CAST(0.7 AS FLOAT))) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS r, CAST(floor(greatest(0::FLOAT, least(1::FLOAT, l + (g - l) * CAST(0.7 AS FLOAT))) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS g,
  CAST(floor(greatest(0::FLOAT, least(1::FLOAT, l + (b - l) * CAST(0.7 AS FLOAT))) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS b FROM three"""
)
def color_adjust(spark: SparkSession, sf: str) -> DataFrame:
    """all knobs of the adjustment, in its order of clamping."""
    return color.adjusted(_pixels(spark, sf), _KNOBS).select("event_id", "r", "g", "b")


@query(
    f"""WITH {_PX},
h1 AS (SELECT *, (CAST(x AS HUGEINT) * 374761393 + CAST(y AS HUGEINT) * 668265263) % 4294967296 AS h FROM px),
h2 AS (SELECT *, (CAST(xor(CAST(h AS BIGINT), CAST(h AS BIGINT) >> 13) AS HUGEINT) * 1274126177) % 4294967296 AS k FROM h1),
h3 AS (SELECT *, (CAST(xor(CAST(k AS BIGINT), CAST(k AS BIGINT) >> 16) & 65535 AS FLOAT) / 65535::FLOAT * 2::FLOAT - 1::FLOAT) * (0.55::FLOAT * 0.12::FLOAT) AS n FROM h2)
SELECT event_id, CAST(floor(greatest(0::FLOAT, least(1::FLOAT, r + n)) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS r, CAST(floor(greatest(0::FLOAT, least(1::FLOAT, g + n)) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS g,
  CAST(floor(greatest(0::FLOAT, least(1::FLOAT, b + n)) * 255::FLOAT + 0.5::FLOAT) AS INTEGER) AS b FROM h3"""
)
def grain(spark: SparkSession, sf: str) -> DataFrame:
    """F8: grain by place."""
    return color.grained(_pixels(spark, sf), 0.55).select("event_id", "r", "g", "b")


from siftwork.plans import further  # noqa: E402,F401  registers the rest
