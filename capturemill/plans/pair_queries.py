"""Queries over image pairs and tracks."""

from pyspark.sql import functions as F

from capturemill.functions.columns import encode_pair
from capturemill.operators import graph, images, matching, pairs, summaries, tracks
from capturemill.plans.catalog import query
from capturemill.session import checkpointed

DECODED = "pair_id // 2147483647 AS image_id1, pair_id % 2147483647 AS image_id2"
MATCHING = """
    tested AS (SELECT capture_id, count(*) AS images, count(*) * (count(*) - 1) // 2 AS pairs_tested
               FROM images GROUP BY 1),
    matched AS (SELECT capture_id, count(*) AS n, CAST(sum(rows) AS BIGINT) AS s FROM pairs WHERE rows > 0 GROUP BY 1),
    matching AS (
      SELECT t.capture_id, images, pairs_tested, coalesce(n, 0) AS pairs_matched,
             round(coalesce(n, 0) / greatest(pairs_tested, 1) * 100, 6) AS success_pct,
             round(coalesce(s, 0) / greatest(coalesce(n, 0), 1), 6) AS avg_matches,
             CASE WHEN coalesce(n, 0) < pairs_tested * 0.3 THEN 'POOR' ELSE 'OK' END AS verdict
      FROM tested t LEFT JOIN matched m ON t.capture_id = m.capture_id)"""
TOP = """
    top AS (SELECT capture_id, pair_id, rows, rank FROM (
              SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY rows DESC, pair_id) AS rank
              FROM pairs WHERE rows > 0) r WHERE rank <= 5)"""
NAMES = f"""
    named AS (SELECT p.capture_id, p.pair_id, p.image_id1, p.image_id2,
                     coalesce(a.name, 'Img ' || p.image_id1) AS name1, coalesce(b.name, 'Img ' || p.image_id2) AS name2,
                     p.rows
              FROM (SELECT *, {DECODED} FROM pairs) p
              LEFT JOIN images a ON a.capture_id = p.capture_id AND a.image_id = p.image_id1
              LEFT JOIN images b ON b.capture_id = p.capture_id AND b.image_id = p.image_id2)"""


SHARED = """
    shared AS (SELECT a.capture_id, a.image_id AS image_id1, b.image_id AS image_id2, count(*) AS shared
      FROM observations a JOIN observations b
        ON a.capture_id = b.capture_id AND a.point3d_id = b.point3d_id AND a.image_id < b.image_id
      GROUP BY 1, 2, 3)"""


@query("match_report", "images", "observations", sql=f"""
    WITH {SHARED}, pairs AS (SELECT capture_id, image_id1 * 2147483647 + image_id2 AS pair_id, shared AS rows FROM shared),
    {MATCHING}, {TOP}, {NAMES}
    SELECT t.capture_id, t.rank, n.name1, n.name2, t.rows, m.pairs_tested, m.pairs_matched, m.success_pct, m.verdict
    FROM top t JOIN named n ON n.capture_id = t.capture_id AND n.pair_id = t.pair_id
    JOIN matching m ON m.capture_id = t.capture_id""")
def match_report(spark, lens):
    """Which pairs match best in each capture, and is the capture good enough?"""
    found = tracks.covisibility(lens("observations")).select(
        "capture_id", encode_pair(F.col("image_id1"), F.col("image_id2")).alias("pair_id"), F.col("shared").alias("rows"),
    )
    # both the ranking and the summary read the pairs: write them once
    found = checkpointed(found)
    named = pairs.name_pairs(pairs.top_pairs(found), lens("images"))
    summary = summaries.matching_summary(lens("images"), found)
    return named.join(summary, "capture_id").select(
        "capture_id", "rank", "name1", "name2", "rows", "pairs_tested", "pairs_matched", "success_pct", "verdict"
    )


@query("verified_pairs", "pairs", sql="SELECT capture_id, pair_id, rows FROM pairs WHERE rows > 0")
def verified_pairs(spark, lens):
    return pairs.verified_pairs(lens("pairs"))


@query("strong_pairs", "pairs", sql="SELECT capture_id, pair_id, rows FROM pairs WHERE rows >= 15")
def strong_pairs(spark, lens):
    return pairs.strong_pairs(lens("pairs"))


@query("seed_pairs", "pairs", sql="SELECT capture_id, pair_id, rows FROM pairs WHERE rows >= 10")
def seed_pairs(spark, lens):
    return pairs.seed_pairs(lens("pairs"), min_inliers=10)


@query("decode_pair", "pairs", sql=f"""
    SELECT *, image_id1 * 2147483647 + image_id2 AS encoded FROM (SELECT capture_id, pair_id, rows, {DECODED} FROM pairs) p""")
def decode_pair(spark, lens):
    return pairs.with_image_ids(lens("pairs")).withColumn(
        "encoded", encode_pair(F.col("image_id1"), F.col("image_id2"))
    )


@query("name_pairs", "pairs", "images", sql=f"WITH {NAMES} SELECT * FROM named")
def name_pairs(spark, lens):
    return pairs.name_pairs(lens("pairs"), lens("images"))


@query("exhaustive_pairs", "images", sql="""
    SELECT capture_id, image_id, position, CASE WHEN n > position THEN position + 1 END AS first_partner,
           CASE WHEN n > position THEN n END AS last_partner, n - position AS partners
    FROM (SELECT capture_id, image_id, row_number() OVER (PARTITION BY capture_id ORDER BY image_id) AS position,
                 count(*) OVER (PARTITION BY capture_id) AS n FROM images) p""")
def exhaustive_pairs(spark, lens):
    return pairs.exhaustive_pairs(lens("images"))


@query("pair_blocks", "images", sql="""
    WITH placed AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY image_id) AS p,
                           count(*) OVER (PARTITION BY capture_id) AS n FROM images)
    SELECT capture_id, (p - 1) // 10 + 1 AS block, max((n - 1) // 10 + 1) AS last_block, count(*) AS images,
           min_by(name, p) AS first_name, max_by(name, p) AS last_name,
           CAST(sum(n - p) AS BIGINT) AS image_pairs
    FROM placed GROUP BY 1, 2""")
def pair_blocks(spark, lens):
    return pairs.pair_blocks(lens("images"), block=10)


@query("top_pairs", "pairs", sql=f"WITH {TOP} SELECT * FROM top")
def top_pairs(spark, lens):
    return pairs.top_pairs(lens("pairs"))


@query("matching_summary", "images", "pairs", sql=f"WITH {MATCHING} SELECT * FROM matching")
def matching_summary(spark, lens):
    return summaries.matching_summary(lens("images"), lens("pairs"))


@query("registration_groups", "pairs", sql=f"""
    WITH e AS (SELECT capture_id, {DECODED} FROM pairs WHERE rows >= 15),
    b AS (SELECT capture_id, image_id1 AS u, image_id2 AS v FROM e UNION ALL
          SELECT capture_id, image_id2, image_id1 FROM e),
    reach(capture_id, u, v) AS (SELECT DISTINCT capture_id, u, u FROM b UNION
              SELECT r.capture_id, r.u, b.v FROM reach r JOIN b ON b.capture_id = r.capture_id AND b.u = r.v)
    SELECT capture_id, u AS image_id, min(v) AS component FROM reach GROUP BY 1, 2""")
def registration_groups(spark, lens):
    return graph.registration_groups(pairs.with_image_ids(pairs.strong_pairs(lens("pairs"))))


# --- tracks --------------------------------------------------------------------------------------

NEIGHBORS = """
    ranked AS (SELECT *, row_number() OVER (PARTITION BY capture_id, image_id ORDER BY shared DESC, neighbor_id) AS rank
      FROM (SELECT capture_id, image_id1 AS image_id, image_id2 AS neighbor_id, shared FROM shared UNION ALL
            SELECT capture_id, image_id2, image_id1, shared FROM shared) s)"""


@query("covisibility", "observations", sql=f"WITH {SHARED} SELECT * FROM shared")
def covisibility(spark, lens):
    return tracks.covisibility(lens("observations"))


@query("covisibility_long_tracks", "observations", sql=f"WITH {SHARED} SELECT * FROM shared")
def covisibility_long_tracks(spark, lens):
    """The same counts with every track of over two images cut into chunks."""
    return tracks.covisibility(lens("observations"), chunk=2)


@query("neighbor_views", "observations", sql=f"""
    WITH {SHARED}, {NEIGHBORS} SELECT capture_id, image_id, neighbor_id, shared, rank FROM ranked WHERE rank <= 4""")
def neighbor_views(spark, lens):
    return tracks.best_views(lens("observations"), 4)


@query("neighbor_views_hot_points", "observations", sql=f"""
    WITH {SHARED}, {NEIGHBORS} SELECT capture_id, image_id, neighbor_id, shared, rank FROM ranked WHERE rank <= 4""")
def neighbor_views_hot_points(spark, lens):
    """The same, with points that more than two images see counted for candidates only, as long as bounds allow."""
    return tracks.best_views(lens("observations"), 4, degree=2, growth=4)


PRESET_OF = """
    SELECT DISTINCT capture_id, CASE capture_id WHEN 0 THEN 'preview' WHEN 1 THEN 'high' ELSE 'custom' END AS preset
    FROM images"""
PRESET_VIEWS = "CASE capture_id WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 8 END"
ADAPTED = f"""
    stats AS (SELECT o.capture_id, o.images, p.points FROM
        (SELECT capture_id, count(DISTINCT image_id) AS images FROM observations GROUP BY 1) o
        LEFT JOIN (SELECT capture_id, count(*) AS points FROM points3d GROUP BY 1) p ON o.capture_id = p.capture_id),
    adapted AS (SELECT capture_id, CAST(CASE WHEN points < 500 OR images < 15 THEN least(v, greatest(2, images - 1))
                                   ELSE v END AS BIGINT) AS number_views,
                CAST(CASE WHEN points < 500 OR images < 15 THEN 1 ELSE 2 END AS BIGINT) AS fuse_views
         FROM (SELECT *, {PRESET_VIEWS} AS v FROM stats) s)"""


def _captures(lens):
    """Captures with a preset chosen by their number; one name is unknown on purpose."""
    chosen = F.when(F.col("capture_id") == 0, "preview").when(F.col("capture_id") == 1, "high").otherwise("custom")
    return lens("images").select("capture_id").distinct().withColumn("preset", chosen)


def _adapted(lens):
    stats = summaries.model_stats(lens("points3d"), lens("observations"))
    return summaries.adapt_densify(stats, images.capture_settings(_captures(lens)))


@query("adapt_densify", "images", "observations", "points3d", sql=f"WITH {ADAPTED} SELECT * FROM adapted")
def adapt_densify(spark, lens):
    return _adapted(lens)


@query("neighbor_views_by_preset", "observations", "points3d", sql=f"""
    WITH {SHARED}, {NEIGHBORS}, {ADAPTED}
    SELECT r.capture_id, image_id, neighbor_id, shared, rank FROM ranked r JOIN adapted a ON a.capture_id = r.capture_id
    WHERE rank <= number_views""")
def neighbor_views_by_preset(spark, lens):
    return tracks.best_views(lens("observations"), _adapted(lens))


@query("capture_settings", "images", sql="""
    SELECT DISTINCT capture_id,
      CASE capture_id WHEN 0 THEN 'preview' WHEN 1 THEN 'high' ELSE 'ultra' END AS preset,
      CAST(CASE capture_id WHEN 0 THEN 1024 WHEN 1 THEN 3200 END AS BIGINT) AS max_dim,
      CAST(CASE capture_id WHEN 0 THEN 4096 WHEN 1 THEN 12288 ELSE 16384 END AS BIGINT) AS max_features,
      CAST(CASE capture_id WHEN 0 THEN 16384 WHEN 1 THEN 32768 ELSE 65536 END AS BIGINT) AS max_matches,
      CAST(CASE capture_id WHEN 0 THEN 0 ELSE -1 END AS BIGINT) AS first_octave,
      CAST(CASE capture_id WHEN 0 THEN 0 ELSE 1 END AS BIGINT) AS guided, CAST(0.8 AS DOUBLE) AS ratio,
      CAST(CASE capture_id WHEN 0 THEN 3 ELSE 5 END AS BIGINT) AS ba_refine, capture_id > 0 AS extra_ba,
      CAST(CASE capture_id WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS densify_res,
      CAST(CASE capture_id WHEN 0 THEN 3 WHEN 1 THEN 5 ELSE 8 END AS BIGINT) AS densify_views,
      CAST(CASE capture_id WHEN 0 THEN 1920 WHEN 1 THEN 3200 ELSE 4096 END AS BIGINT) AS max_res,
      CAST(CASE capture_id WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS BIGINT) AS refine_scales,
      CAST(CASE capture_id WHEN 0 THEN 2 ELSE 0 END AS BIGINT) AS refine_res,
      CAST(CASE capture_id WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS texture_res
    FROM images""")
def capture_settings(spark, lens):
    return images.capture_settings(_captures(lens))


@query("min_views", "points3d", "observations", sql="""
    SELECT p.capture_id, p.point3d_id, round(x, 6) AS x, y, z, r, g, b, error FROM points3d p JOIN (SELECT capture_id, point3d_id FROM observations GROUP BY 1, 2
      HAVING count(DISTINCT image_id) >= 3) v ON v.capture_id = p.capture_id AND v.point3d_id = p.point3d_id""")
def min_views(spark, lens):
    return tracks.min_views(lens("points3d"), 3, lens("observations")).select(*lens("points3d").columns)


@query("track_length_stats", "observations", sql="""
    WITH by_point AS (SELECT capture_id, point3d_id, count(*) AS n FROM observations GROUP BY 1, 2),
    by_image AS (SELECT capture_id, image_id, count(*) AS n FROM observations GROUP BY 1, 2)
    SELECT p.*, i.images, i.avg_observations_per_image
    FROM (SELECT capture_id, count(*) AS points, CAST(sum(n) AS BIGINT) AS observations,
                 round(round(avg(n), 9), 6) AS avg_track_length, max(n) AS max_track_length FROM by_point GROUP BY 1) p
    JOIN (SELECT capture_id, count(*) AS images, round(round(avg(n), 9), 6) AS avg_observations_per_image
          FROM by_image GROUP BY 1) i ON i.capture_id = p.capture_id""")
def track_length_stats(spark, lens):
    return tracks.track_length_stats(lens("observations"))


GRADE = "CASE WHEN avg(error) < 1 THEN 'good' WHEN avg(error) < 2 THEN 'high' ELSE 'poor' END AS grade"


@query("reprojection_by_image", "points3d", "observations", sql=f"""
    SELECT o.capture_id, o.image_id, count(*) AS observations, round(round(avg(error), 9), 6) AS mean_error, {GRADE}
    FROM observations o JOIN points3d p ON p.capture_id = o.capture_id AND p.point3d_id = o.point3d_id GROUP BY 1, 2""")
def reprojection_by_image(spark, lens):
    return tracks.reprojection_by_image(lens("points3d"), lens("observations"))


@query("reprojection_by_capture", "points3d", sql=f"""
    SELECT capture_id, count(*) AS points, round(round(avg(error), 9), 6) AS mean_error, {GRADE} FROM points3d GROUP BY 1""")
def reprojection_by_capture(spark, lens):
    return tracks.reprojection_by_capture(lens("points3d"))


# --- summaries -----------------------------------------------------------------------------------

FEATURES = """
    features AS (SELECT capture_id, count(*) AS images, round(round(avg(rows), 9), 6) AS avg_features, min(rows) AS min_features,
      max(rows) AS max_features, CAST(sum(rows) AS BIGINT) AS total_features,
      CASE WHEN avg(rows) < 3000 THEN 'LOW' ELSE 'OK' END AS verdict FROM keypoints GROUP BY 1)"""
REGISTRATION = """
    registration AS (
      SELECT *, CASE WHEN registered_pct < 50 THEN 'CRITICAL' WHEN registered_pct < 75 THEN 'WARN' ELSE 'GOOD' END AS verdict
      FROM (SELECT i.capture_id, n AS total_images, coalesce(r, 0) AS registered, n - coalesce(r, 0) AS failed,
                   round(coalesce(r, 0) / n * 100, 6) AS registered_pct, coalesce(points, 0) AS points, mean_error
            FROM (SELECT capture_id, count(*) AS n FROM images GROUP BY 1) i
            LEFT JOIN (SELECT capture_id, count(DISTINCT image_id) AS r FROM registered GROUP BY 1) o
              ON o.capture_id = i.capture_id
            LEFT JOIN (SELECT capture_id, count(*) AS points, round(round(avg(error), 9), 6) AS mean_error
                       FROM points3d GROUP BY 1) p ON p.capture_id = i.capture_id) s)"""
# Images whose track points have a small mean error count as registered, so that captures differ.
REGISTERED = """
    registered AS (SELECT o.capture_id, o.image_id FROM observations o JOIN points3d p
      ON p.capture_id = o.capture_id AND p.point3d_id = o.point3d_id
      GROUP BY 1, 2 HAVING avg(error) < 1.49 + o.capture_id * 0.004)"""


def _registered(lens):
    graded = tracks.reprojection_by_image(lens("points3d"), lens("observations"))
    return graded.where(summaries.settled(F.col("mean_error")) < 1.49 + F.col("capture_id") * 0.004)


@query("feature_summary", "keypoints", sql=f"WITH {FEATURES} SELECT * FROM features")
def feature_summary(spark, lens):
    return summaries.feature_summary(lens("keypoints"))


@query("registration_summary", "images", "observations", "points3d", sql=f"""
    WITH {REGISTERED}, {REGISTRATION} SELECT * FROM registration""")
def registration_summary(spark, lens):
    return summaries.registration_summary(lens("images"), _registered(lens), lens("points3d"))


@query("model_stats", "points3d", "observations", sql="""
    SELECT i.capture_id, images, points, mean_error FROM
      (SELECT capture_id, count(DISTINCT image_id) AS images FROM observations GROUP BY 1) i
      JOIN (SELECT capture_id, count(*) AS points, round(round(avg(error), 9), 6) AS mean_error FROM points3d GROUP BY 1) p
      ON p.capture_id = i.capture_id""")
def model_stats(spark, lens):
    return summaries.model_stats(lens("points3d"), lens("observations"))


@query("verdicts", "images", "observations", "points3d", "keypoints", "pairs", sql=f"""
    WITH {FEATURES}, {MATCHING}, {REGISTERED}, {REGISTRATION}
    SELECT r.capture_id, f.verdict AS features, m.verdict AS matching,
      CASE WHEN registered = 0 THEN 'FAILED' ELSE r.verdict END AS registration,
      concat_ws(',', CASE WHEN registered = 0 THEN 'HIGHER_PRESET' END, CASE WHEN registered = 0 THEN 'MORE_OVERLAP' END,
        CASE WHEN f.verdict = 'LOW' THEN 'LOW_FEATURES' END, CASE WHEN m.verdict = 'POOR' THEN 'INSUFFICIENT_OVERLAP' END,
        CASE WHEN registered > 0 AND r.verdict = 'CRITICAL' THEN 'INCOMPLETE_RECONSTRUCTION' END,
        CASE WHEN r.verdict = 'WARN' THEN 'GAPS_IN_WEAK_AREAS' END) AS suggestions
    FROM registration r LEFT JOIN matching m ON m.capture_id = r.capture_id
    LEFT JOIN features f ON f.capture_id = r.capture_id""")
def verdicts(spark, lens):
    return summaries.verdicts(
        summaries.feature_summary(lens("keypoints")),
        summaries.matching_summary(lens("images"), lens("pairs")),
        summaries.registration_summary(lens("images"), _registered(lens), lens("points3d")),
    ).withColumn("suggestions", F.array_join("suggestions", ","))


# --- descriptors ---------------------------------------------------------------------------------

def _accepted(ratio, limit="", source="descriptors"):
    return f"""
      SELECT capture_id, image_id1, image_id2, feature1, feature2, round(d1, 6) AS distance FROM (
        SELECT capture_id, image_id1, image_id2, feature1, feature2, d AS d1, rank,
               lead(d) OVER (PARTITION BY capture_id, image_id1, image_id2, feature1 ORDER BY d, feature2) AS d2
        FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, image_id1, image_id2, feature1
                                           ORDER BY d, feature2) AS rank FROM distances) r) s
      WHERE rank = 1 AND d1 < {ratio} * d2 {limit}"""


DISTANCES = """
    distances AS (SELECT p.capture_id, p.image_id1, p.image_id2, a.feature_id AS feature1, b.feature_id AS feature2,
        list_distance(CAST(a.descriptor AS DOUBLE[]), CAST(b.descriptor AS DOUBLE[])) AS d
      FROM descriptor_pairs p
      JOIN descriptors a ON a.capture_id = p.capture_id AND a.image_id = p.image_id1
      JOIN descriptors b ON b.capture_id = p.capture_id AND b.image_id = p.image_id2)"""


@query("match_descriptors", "descriptors", "descriptor_pairs", sql=f"WITH {DISTANCES} {_accepted(0.95)}")
def match_descriptors(spark, lens):
    return matching.match_descriptors(lens("descriptors"), lens("descriptor_pairs"), ratio=0.95)


@query("match_counts", "descriptors", "descriptor_pairs", sql=f"""
    WITH {DISTANCES}, m AS ({_accepted(0.95, "AND d1 <= 1.1")}),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture_id, image_id1, image_id2
                                                 ORDER BY distance, feature1) AS k FROM m) r WHERE k <= 5)
    SELECT p.capture_id, p.image_id1 * 2147483647 + p.image_id2 AS pair_id, count(b.feature1) AS rows
    FROM descriptor_pairs p LEFT JOIN best b
      ON b.capture_id = p.capture_id AND b.image_id1 = p.image_id1 AND b.image_id2 = p.image_id2 GROUP BY 1, 2""")
def match_counts(spark, lens):
    found = matching.match_descriptors(
        lens("descriptors"), lens("descriptor_pairs"), ratio=0.95, max_distance=1.1, max_matches=5
    )
    return matching.match_counts(found, lens("descriptor_pairs"))


@query("match_with_relaxed_retry", "descriptors", "descriptor_pairs", sql=f"""
    WITH {DISTANCES}, first AS ({_accepted(0.8)}), second AS ({_accepted(0.95, "AND d1 <= 1.1")})
    SELECT *, false AS relaxed FROM first UNION ALL
    SELECT *, true FROM second WHERE capture_id NOT IN (SELECT capture_id FROM first) AND capture_id IN
      (SELECT capture_id FROM descriptors GROUP BY 1 HAVING count(DISTINCT image_id) > 1)""")
def match_with_relaxed_retry(spark, lens):
    return matching.match_with_relaxed_retry(
        lens("descriptors"), lens("descriptor_pairs"), retry_max_distance=1.1
    )
