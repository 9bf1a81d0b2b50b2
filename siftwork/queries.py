"""Registered queries of the curation operators on the relational tables, and their SQL.

No images or videos come with the tables, so each query runs its operator on a
stated stand-in: documents for media files, an embedding's 64 numbers for an 8 x 8
raster, a user's events for a video's timeline, line items for pixels. Nothing
here claims a visual meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwork.functions import color as C
from siftwork.functions import hashing as H
from siftwork.functions import numeric as N
from siftwork.functions import text as T
from siftwork.operators import dedupe, layout, palette, quality, timeline
from siftwork.plans import reports
from siftwork.session import dealt, prepare, stored, table

DAY = 86_400.0
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Documents as media items: the text is the content, its length the quality."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("sha256"), F.col("n_chars").cast("double").alias("quality"), "source", F.when(F.col("n_chars") < 50, "filtered").otherwise("pending").alias("status"))


_EXACT = """
WITH items AS (SELECT doc_id AS id, sha256(text) AS sha256, n_chars AS quality, source, CASE WHEN n_chars < 50 THEN 'filtered' ELSE 'pending' END AS status FROM documents),
marked AS (
  SELECT *, CASE WHEN status = 'pending' AND sha256 IS NOT NULL THEN first_value(id) OVER (PARTITION BY sha256, status ORDER BY quality DESC, id) END AS best FROM items)
SELECT id, sha256, source, CASE WHEN status = 'pending' AND best <> id THEN 'duplicate' ELSE status END AS status, CASE WHEN best <> id THEN best END AS keeper FROM marked
"""


@query(_EXACT)
def exact_duplicates(spark, d):
    return dedupe.mark_exact(_items(spark, d)).select("id", "sha256", "source", "status", "keeper")


@query(f"SELECT source, count(*) AS total, count(*) FILTER (status = 'kept') AS kept, count(*) FILTER (status = 'filtered') AS filtered, count(*) FILTER (status = 'duplicate') AS duplicate, count(*) FILTER (status = 'failed') AS failed FROM (SELECT source, replace(status, 'pending', 'kept') AS status FROM ({_EXACT})) GROUP BY source")
def dedupe_summary(spark, d):
    marked = dedupe.mark_exact(_items(spark, d))
    return dedupe.status_summary(marked.withColumn("status", F.replace("status", F.lit("pending"), F.lit("kept"))), "source")


def _names(spark, d):
    """Documents as files whose names end in one of twelve extensions."""
    kinds = F.array(*[F.lit(x) for x in (".JPG", ".png", ".webp", ".mp4", ".MOV", ".mkv", ".txt", ".gif", ".bmp", ".avi", "", ".tiff")])
    name = F.concat(F.lit("Clip "), F.col("doc_id"), F.get(kinds, (F.col("doc_id") % 12).cast("int")))
    return table(spark, d, "documents").select("doc_id", name.alias("name"), F.concat("source", F.lit("/"), name).alias("path"))


_NAMES = "SELECT doc_id, 'Clip ' || doc_id || x AS name, source || '/' || 'Clip ' || doc_id || x AS path FROM (SELECT *, (['.JPG', '.png', '.webp', '.mp4', '.MOV', '.mkv', '.txt', '.gif', '.bmp', '.avi', '', '.tiff'])[doc_id % 12 + 1] AS x FROM documents)"
_KIND = "CASE WHEN regexp_matches(lower(name), '\\.(jpe?g|png|webp|tiff?|bmp|gif)$') THEN 'image' WHEN regexp_matches(lower(name), '\\.(mp4|mov|mkv|avi|webm|m4v|mts|m2ts|wmv)$') THEN 'video' ELSE 'unsupported' END"


@query(f"SELECT doc_id, name, {_KIND} AS media_type FROM ({_NAMES})")
def media_classify(spark, d):
    return _names(spark, d).select("doc_id", "name", quality.media_type(F.col("name")).alias("media_type"))


@query(f"""
SELECT doc_id, media_type, CASE media_type WHEN 'image' THEN 'IMG' WHEN 'video' THEN 'VID' ELSE 'UNSUPPORTED' END || '-' || CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS asset_id
FROM (SELECT *, row_number() OVER (PARTITION BY media_type ORDER BY lower(path), path) AS n FROM (SELECT *, {_KIND} AS media_type FROM ({_NAMES})))
""")
def stable_ids(spark, d):
    return quality.asset_ids(_names(spark, d)).select("doc_id", "media_type", "asset_id")


@query("""
SELECT doc_id, n.n AS running FROM documents JOIN (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS n FROM documents) n USING (doc_id)
""")
def running_numbers(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return quality.numbered(docs, ["source"], [F.col("n_chars"), F.col("doc_id")], "running").select("doc_id", "running")


@query("""
SELECT doc_id, CASE WHEN reason IS NULL THEN 'pending' ELSE 'filtered' END AS status, reason AS filter_reason, reason IS NULL AND share * 1000 < 150 AS review_required
FROM (SELECT *, CASE WHEN mean < 6 AND share > 0.985 THEN 'black_frame' WHEN mean > 249 AND bright > 0.985 THEN 'white_frame' WHEN least(n_chars, 4000) < 360 THEN 'short_edge_below_360' END AS reason
  FROM (SELECT doc_id, n_chars, len(text) - len(replace(text, ' ', '')) AS blanks, (len(text) - len(replace(text, ' ', '')))::DOUBLE / greatest(len(text), 1) AS share, 1000.0 * n_chars / 4000 AS mean, n_chars / 4000.0 AS bright FROM documents))
""")
def quality_ladder(spark, d):
    docs = table(spark, d, "documents")
    blanks = F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))
    share = blanks.cast("double") / F.greatest(F.length("text"), F.lit(1))
    status, reason, review = quality.quality_ladder(F.col("n_chars"), F.lit(4000), F.col("n_chars") * 1000.0 / 4000, share, F.col("n_chars") / 4000.0, share * 1000, blur=150.0)
    return docs.select("doc_id", status.alias("status"), reason.alias("filter_reason"), review.alias("review_required"))


@query("SELECT p_partkey, round(10 * log2(greatest(p_size * 40, 1)) + least(ln(1 + greatest(p_retailprice, 0)), 6), 6) AS quality FROM part")
def quality_score(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(N.quality_score(F.col("p_size"), F.lit(40), F.col("p_retailprice")), 6).alias("quality"))


_RASTER = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings"
_BITS = "(list_reduce(list_prepend(0::HUGEINT, list_transform({bits}, lambda b: CASE WHEN b THEN 1::HUGEINT ELSE 0::HUGEINT END)), lambda a, b: a * 2 + b))"
_SIGNED = "(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END)::BIGINT"
_PHASH = f"SELECT vec_id, {_SIGNED} AS hash FROM (SELECT vec_id, {_BITS.format(bits='list_transform(e, lambda x: x > list_median(e[2:]))')} AS h FROM ({_RASTER}))"


@query(_PHASH)
def hash_bits_median(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select("vec_id", e.alias("e")).select("vec_id", H.median_hash(F.col("e")).alias("hash"))


@query(f"SELECT vec_id, {_SIGNED} AS hash, lower(lpad(to_hex(h), 16, '0')) AS hash_hex FROM (SELECT vec_id, {_BITS.format(bits='list_transform(list_filter(range(0, 64), lambda i: i % 8 > 0), lambda i: e[i + 1] > e[i])')} AS h FROM ({_RASTER}))")
def hash_bits_gradient(spark, d):
    """Neighbour comparison over rows of eight cells: 56 bits."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    hashed = rows.select("vec_id", H.difference_hash(F.col("e"), 8).alias("hash"))
    return hashed.select("vec_id", "hash", N.hash_hex(F.col("hash")).alias("hash_hex"))


@query(f"WITH h AS ({_PHASH}) SELECT a.vec_id AS left_id, b.vec_id AS right_id, bit_count(xor(a.hash, b.hash))::INTEGER AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.hash, b.hash)) <= 20")
def hamming_pairs(spark, d):
    h = hash_bits_median(spark, d)
    pairs = dedupe.hamming_pairs(h, h, 20, "hash", F.col("a.vec_id") < F.col("b.vec_id"))
    return pairs.select(F.col("a.vec_id").alias("left_id"), F.col("b.vec_id").alias("right_id"), N.hamming(F.col("a.hash"), F.col("b.hash")).cast("int").alias("distance"))


_HIST = "SELECT doc_id, list_transform(range(26), lambda i: len(t) - len(replace(t, chr(97 + i::INT), ''))) AS hist FROM (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL)"


def _letters(spark, d):
    """A document's 26 letter counts as its histogram; 64 of their comparisons as its hashes."""
    t = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hist = F.array(*[F.length(t) - F.length(F.replace(t, F.lit(chr(97 + i)), F.lit(""))) for i in range(26)])
    return table(spark, d, "documents").filter("text is not null").select("doc_id", "n_chars", "source", hist.alias("histogram"))


@query(f"""
WITH h AS ({_HIST}), p AS (SELECT a.doc_id AS left_id, b.doc_id AS right_id, unnest(a.hist) AS x, unnest(b.hist) AS y FROM h a JOIN h b ON b.doc_id = a.doc_id + 1)
SELECT left_id, right_id, round(coalesce(nullif(corr(x, y), 'nan'::DOUBLE), 1), 5) AS correlation FROM p GROUP BY ALL
""")
def histogram_corr(spark, d):
    h = stored(_letters(spark, d).select("doc_id", "histogram"), "letters")  # both sides of the join read it
    a, b = h.select(F.col("doc_id").alias("left_id"), F.col("histogram").alias("x"), (F.col("doc_id") + 1).alias("right_id")), h.select(F.col("doc_id").alias("right_id"), F.col("histogram").alias("y"))
    return a.join(b, "right_id").select("left_id", "right_id", F.round(H.correlation(F.col("x"), F.col("y")), 5).alias("correlation"))


_NEAR = f"""
WITH RECURSIVE h AS MATERIALIZED (SELECT d.doc_id, n_chars, hist FROM ({_HIST}) x JOIN documents d USING (doc_id)),
combos AS (SELECT i, j, row_number() OVER (ORDER BY i, j) - 1 AS n FROM range(26) AS a(i), range(26) AS b(j) WHERE i < j),
chosen AS (SELECT list([i + 1, j + 1] ORDER BY n) FILTER (n % 4 = 0 AND n < 256) AS p, list([i + 1, j + 1] ORDER BY n) FILTER (n % 4 = 1 AND n < 257) AS q FROM combos),
hashed AS (
  SELECT doc_id, n_chars, hist, min(doc_id) OVER (PARTITION BY hist, n_chars) AS best, {_BITS.format(bits="list_transform(p, lambda c: hist[c[1]] > hist[c[2]])")} AS p, {_BITS.format(bits="list_transform(q, lambda c: hist[c[1]] > hist[c[2]])")} AS q
  FROM h, chosen),
r AS MATERIALIZED (SELECT doc_id, list_transform(hist, lambda v: v::DOUBLE) AS x, p, q, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM hashed WHERE best = doc_id),
s AS MATERIALIZED (SELECT *, list_sum(x) AS total, list_dot_product(x, x) - list_sum(x) * list_sum(x) / 26 AS spread FROM r),
near AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.rank AS better, b.rank AS worse, bit_count(xor(a.p, b.p)) AS dp, bit_count(xor(a.q, b.q)) AS dq,
      CASE WHEN abs(a.spread * b.spread) > 1e-12 THEN (list_dot_product(a.x, b.x) - a.total * b.total / 26) / sqrt(a.spread * b.spread) ELSE 1 END AS c
    FROM s a JOIN s b ON a.rank < b.rank AND bit_count(xor(a.p, b.p)) <= 6 AND bit_count(xor(a.q, b.q)) <= 8) WHERE c >= 0.85),
beside AS MATERIALIZED (SELECT r.rank, list(better ORDER BY better) FILTER (better IS NOT NULL) AS l FROM r LEFT JOIN near ON worse = r.rank GROUP BY r.rank),
scan AS (
  SELECT 0::BIGINT AS rank, NULL::BIGINT AS keeper, []::BIGINT[] AS kept
  UNION ALL
  SELECT rank, keeper, CASE WHEN keeper IS NULL THEN list_append(kept, rank) ELSE kept END
  FROM (SELECT b.rank, list_filter(coalesce(b.l, []), lambda z: list_contains(scan.kept, z))[1] AS keeper, scan.kept FROM scan JOIN beside b ON b.rank = scan.rank + 1)),
told AS (SELECT r.doc_id, k.doc_id AS keeper, dp, dq, c FROM scan JOIN r USING (rank) LEFT JOIN r k ON k.rank = scan.keeper LEFT JOIN near ON better = scan.keeper AND worse = scan.rank)
SELECT hashed.doc_id AS id, CASE WHEN best <> hashed.doc_id OR keeper IS NOT NULL THEN 'duplicate' ELSE 'kept' END AS status, CASE WHEN best <> hashed.doc_id THEN best ELSE keeper END AS keeper,
  CASE WHEN best <> hashed.doc_id THEN 'exact_duplicate' WHEN keeper IS NOT NULL THEN 'near_duplicate' END AS filter_reason, dp::INTEGER AS phash_distance, dq::INTEGER AS dhash_distance, round(round_even(c, 6), 5) AS histogram_correlation
FROM hashed LEFT JOIN told USING (doc_id)
"""


@query(_NEAR)
def near_duplicates(spark, d):
    """The full item de-duplication at its production limits, on letter histograms: 64 comparisons of letter counts as one hash, 64 others as the second.

    Texts of one language have much the same letters, so a large share of all pairs is near; they are held against keepers in blocks.
    """
    pairs = [(i, j) for i in range(26) for j in range(i + 1, 26)]
    bits = lambda chosen: H.pack_bits(F.array(*[F.get("histogram", i) > F.get("histogram", j) for i, j in chosen]))
    items = _letters(spark, d).select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("ord"), F.lit("pending").alias("status"), F.col("n_chars").cast("double").alias("quality"), F.xxhash64("histogram", "n_chars").cast("string").alias("sha256"),
        bits(pairs[0:256:4]).alias("phash"), bits(pairs[1:257:4]).alias("dhash"), "histogram",
    )
    out = dedupe.deduplicate(items)
    return out.select("id", "status", "keeper", "filter_reason", "phash_distance", "dhash_distance", F.round("histogram_correlation", 5).alias("histogram_correlation"))


def _events(spark, d):
    e = table(spark, d, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    start = F.min(seconds).over(Window.partitionBy("user_id"))
    return e.select("user_id", "event_id", (seconds / 3600.0).alias("h"), ((seconds - start) / 3600.0).alias("t"), "value")


_EV = "SELECT user_id, event_id, epoch_us(ts) / 1e6 / 3600.0 AS h, (epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (PARTITION BY user_id)) / 3600.0 AS t, value FROM events"
_SCORE = f"SELECT user_id, event_id, t, coalesce(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY t, event_id)) / 200.0, 0) AS score FROM ({_EV})"


@query(f"SELECT user_id, event_id, round(score, 6) AS score FROM ({_SCORE})")
def scene_scores(spark, d):
    return timeline.change_scores(_events(spark, d), "user_id", "t", "event_id", "value", 200.0).select("user_id", "event_id", F.round("score", 6).alias("score"))


_TARGET = "CASE WHEN {x} <= 30 THEN {a} WHEN {x} <= 120 THEN {b} WHEN {x} <= 300 THEN {c} WHEN {x} <= 1200 THEN {e} WHEN {x} <= 3600 THEN {f} ELSE {g} END"
_RAW, _KEPT = (dict(zip("abcefg", v)) for v in ((18, 30, 45, 75, 120, 160), (18, 28, 40, 70, 100, 120)))
_SPANS = f"SELECT user_id, duration, {_TARGET.format(x='duration', **_RAW)} AS raw_target, {_TARGET.format(x='duration', **_KEPT)} AS max_kept FROM (SELECT user_id, max(t) AS duration FROM ({_EV}) GROUP BY user_id)"


def _spans(spark, d):
    raw, kept = N.target_counts(F.col("duration"))
    return _events(spark, d).groupBy("user_id").agg(F.max("t").alias("duration")).withColumn("raw_target", raw).withColumn("max_kept", kept)


@query(f"SELECT user_id, round(duration, 4) AS duration, raw_target, max_kept FROM ({_SPANS})")
def target_counts(spark, d):
    return _spans(spark, d).select("user_id", F.round("duration", 4).alias("duration"), "raw_target", "max_kept")


@query(f"""
WITH s AS ({_SCORE}), tried(ord, threshold) AS (VALUES (0, 0.32), (1, 0.26), (2, 0.20), (3, 0.38), (4, 0.45), (5, 0.55)),
n AS (SELECT p.user_id, ord, threshold, greatest(4, round_even(raw_target * 0.62, 0)) AS wanted, (SELECT count(*) FROM s WHERE s.user_id = p.user_id AND score > threshold) AS scenes FROM ({_SPANS}) p, tried),
stop AS (SELECT *, min(CASE WHEN scenes BETWEEN wanted * 0.65 AND wanted * 1.35 THEN ord END) OVER (PARTITION BY user_id) AS last FROM n),
best AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(scenes - wanted), ord) AS r FROM stop WHERE ord <= coalesce(last, 5))
SELECT user_id, threshold::DOUBLE AS threshold, scenes, wanted::INTEGER AS wanted FROM best WHERE r = 1
""")
def adaptive_threshold(spark, d):
    scored = timeline.change_scores(_events(spark, d), "user_id", "t", "event_id", "value", 200.0)
    return timeline.adaptive_threshold(scored, _spans(spark, d).select("user_id", F.col("raw_target").alias("target")), "user_id")


_THIN = f"""
WITH RECURSIVE m AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM ({_EV}) WHERE t > 0),
f AS (
  SELECT user_id, 1 AS i, t AS last, true AS taken FROM m WHERE i = 1
  UNION ALL SELECT m.user_id, m.i, CASE WHEN m.t - f.last >= 6 THEN m.t ELSE f.last END, m.t - f.last >= 6 FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1)
SELECT user_id, last AS t, row_number() OVER (PARTITION BY user_id ORDER BY i)::INTEGER AS sequence FROM f WHERE taken
"""


@query(f"SELECT user_id, round(t, 5) AS t, sequence FROM ({_THIN})")
def scene_thinning(spark, d):
    return timeline.thin(_events(spark, d), "user_id", "t", 6.0).select("user_id", F.round("t", 5).alias("t"), "sequence")


_FILL = f"""
WITH RECURSIVE ev AS MATERIALIZED ({_EV}),
m AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM ev WHERE t > 0),
f AS (
  SELECT user_id, 1 AS i, t AS last, true AS taken FROM m WHERE i = 1
  UNION ALL SELECT m.user_id, m.i, CASE WHEN m.t - f.last >= 24 THEN m.t ELSE f.last END, m.t - f.last >= 24 FROM f JOIN m ON m.user_id = f.user_id AND m.i = f.i + 1),
accepted AS (SELECT user_id, list(last) AS have FROM (SELECT user_id, last, row_number() OVER (PARTITION BY user_id ORDER BY i) AS n FROM f WHERE taken) WHERE n <= 20 GROUP BY user_id),
s AS (
  SELECT user_id, duration, coalesce(have, []) AS have, greatest(1, raw_target - len(coalesce(have, []))) AS needed, least(0.5, duration * 0.08) AS margin
  FROM ({_SPANS.replace(_EV, "SELECT * FROM ev")}) LEFT JOIN accepted USING (user_id)),
g AS (
  SELECT user_id, 0 AS i, []::DOUBLE[] AS kept FROM s
  UNION ALL
  SELECT user_id, i, CASE WHEN len(kept) < needed AND len(list_filter(have, lambda y: abs(y - x) < 6)) = 0 AND len(list_filter(kept, lambda y: abs(y - x) < 6)) = 0 THEN list_append(kept, x) ELSE kept END
  FROM (SELECT g.user_id, g.i + 1 AS i, g.kept, s.have, s.needed, s.margin + (greatest(s.margin, s.duration - s.margin) - s.margin) / (2 * s.needed + 1) * (g.i + 1) AS x FROM g JOIN s USING (user_id) WHERE g.i < 2 * s.needed)),
filled AS (SELECT user_id, unnest(kept) AS t, unnest(range(1, len(kept) + 1)) AS sequence FROM g JOIN s USING (user_id) WHERE g.i = 2 * s.needed),
near AS (SELECT filled.user_id, filled.t, sequence, event_id, row_number() OVER (PARTITION BY filled.user_id, filled.t ORDER BY abs(ev.t - filled.t), ev.t) AS r FROM filled JOIN ev USING (user_id))
SELECT user_id, round(t, 5) AS t, sequence::INTEGER AS sequence, event_id FROM near WHERE r = 1
"""


@query(_FILL)
def uniform_fill(spark, d):
    e = _events(spark, d)
    spans = _spans(spark, d).select("user_id", "duration", F.col("raw_target").alias("target"))
    accepted = timeline.thin(e, "user_id", "t", 24.0, 20)
    filled = timeline.uniform_fill(spans, accepted, "user_id", 6.0)
    near = timeline.nearest_moment(filled, e, "user_id", "t", ["event_id"])
    return filled.join(near, ["user_id", "t"]).select("user_id", F.round("t", 5).alias("t"), "sequence", F.col("row.event_id").alias("event_id"))


@query(f"SELECT user_id, unnest(range(1, 21)) AS i, round(m + (greatest(m, duration - m) - m) / 21 * unnest(range(1, 21)), 5) AS t FROM (SELECT *, least(0.5, duration * 0.08) AS m FROM ({_SPANS}))")
def even_times(spark, d):
    times = N.evenly_spaced(F.col("duration"), F.lit(20))
    return _spans(spark, d).select("user_id", F.posexplode(times).alias("i", "t")).select("user_id", (F.col("i") + 1).cast("long").alias("i"), F.round("t", 5).alias("t"))


@query(f"""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ({_EV})),
chosen AS (SELECT DISTINCT user_id, CASE WHEN n <= 18 THEN i ELSE round_even(k * (n - 1)::DOUBLE / 17, 0)::BIGINT END AS i FROM r, range(18) AS t(k))
SELECT event_id, r.user_id, CASE WHEN c.i IS NULL THEN 'filtered' ELSE 'kept' END AS status, CASE WHEN c.i IS NULL THEN 'max_kept_limit' END AS filter_reason FROM r LEFT JOIN chosen c ON r.user_id = c.user_id AND r.i = c.i
""")
def even_downsample(spark, d):
    frames = _events(spark, d).withColumns({"status": F.lit("kept"), "filter_reason": F.lit(None).cast("string"), "most": F.lit(18)})
    return quality.limit_kept(frames, ["user_id"], ["t", "event_id"], "most").select("event_id", "user_id", "status", "filter_reason")


@query(f"SELECT event_id, 'FRM-' || user_id || '-' || lpad(n::VARCHAR, 4, '0') AS frame_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ({_EV}))")
def frame_ids(spark, d):
    return timeline.frame_ids(_events(spark, d), "user_id", "t", "event_id").select("event_id", "frame_id")


@query(f"""
SELECT event_id, name, regexp_extract(name, '__([0-9]{{12}})__', 1)::BIGINT AS timestamp_ms, regexp_extract(name, '__(scene|uniform|boundary)__', 1) AS method,
  CASE WHEN ms >= 3600000 THEN printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) ELSE printf('%02d:%02d.%03d', ms // 60000 % 60, ms // 1000 % 60, ms % 1000) END AS shown
FROM (SELECT event_id, ms, printf('VID-%04d__%012d__%s__%04d.jpg', user_id, ms, CASE WHEN event_id % 2 = 0 THEN 'scene' ELSE 'uniform' END, event_id % 10000) AS name FROM (SELECT *, event_id * 1543 AS ms FROM events))
""")
def frame_names(spark, d):
    method = F.when(F.col("event_id") % 2 == 0, "scene").otherwise("uniform")
    name = T.frame_name(F.format_string("VID-%04d", "user_id"), F.col("event_id") * 1543 / 1000.0, method, F.col("event_id") % 10000)
    rows = table(spark, d, "events").select("event_id", name.alias("name")).withColumn("p", T.frame_parts(F.col("name")))
    return rows.select("event_id", "name", F.col("p.timestamp_ms").alias("timestamp_ms"), F.col("p.method").alias("method"), T.format_timestamp(F.col("p.timestamp_ms")).alias("shown"))


@query("""
SELECT doc_id, source, n AS n_items, ceil(n / 30.0)::INTEGER AS pages, (i // 30 + 1)::INTEGER AS page, (i % 30 // 5)::INTEGER AS "row", (i % 5)::INTEGER AS "column", (i % 5 * 332 + 24)::INTEGER AS x, (i % 30 // 5 * 252 + 24)::INTEGER AS y
FROM (SELECT doc_id, source, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)
""")
def contact_pages(spark, d):
    return layout.place(table(spark, d, "documents").select("doc_id", "source"), ["source"], ["doc_id"])


def _pixels(spark, d):
    """Line items as pixels: quantity, discount and tax scaled to 0 … 255; the order is the image, the flag the group."""
    li = table(spark, d, "lineitem")
    r, g, b = (F.floor(x).cast("int") for x in (F.col("l_quantity") * 5, F.round(F.col("l_discount") * 100) * 25, F.round(F.col("l_tax") * 100) * 31))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", F.least(r, F.lit(255)).alias("r"), F.least(g, F.lit(255)).alias("g"), F.least(b, F.lit(255)).alias("b"))


_PIX = "SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, least(floor(l_quantity * 5), 255)::INTEGER AS r, least(round(l_discount * 100) * 25, 255)::INTEGER AS g, least(round(l_tax * 100) * 31, 255)::INTEGER AS b FROM lineitem"
_DIST = f"SELECT DISTINCT r, g, b FROM ({_PIX})"
_HLS = f"""SELECT r, g, b, CASE WHEN hi = lo THEN 0 ELSE (turn / 6 - floor(turn / 6)) * 360 END AS hue, (hi + lo) / 2.0 AS light,
  CASE WHEN hi = lo THEN 0 WHEN (hi + lo) / 2.0 <= 0.5 THEN (hi - lo) / (hi + lo) ELSE (hi - lo) / (2 - hi - lo) END AS sat
FROM (SELECT *, CASE WHEN x = hi THEN (hi - z) / s - (hi - y) / s WHEN y = hi THEN 2 + (hi - x) / s - (hi - z) / s ELSE 4 + (hi - y) / s - (hi - x) / s END AS turn
  FROM (SELECT *, nullif(hi - lo, 0) AS s FROM (SELECT *, greatest(x, y, z) AS hi, least(x, y, z) AS lo FROM (SELECT r, g, b, r / 255.0 AS x, g / 255.0 AS y, b / 255.0 AS z FROM ({_DIST})))))"""


def _colors(spark, d):
    return _pixels(spark, d).select("r", "g", "b").distinct()


@query(f"SELECT r, g, b, printf('#%02X%02X%02X', r, g, b) AS hex FROM ({_DIST})")
def color_hex(spark, d):
    return _colors(spark, d).withColumn("hex", C.hex_of(F.col("r"), F.col("g"), F.col("b")))


@query(f"SELECT r, g, b, round(hue, 5) AS hue, round(light, 6) AS light, round(sat, 6) AS sat, round(least(abs(hue - 210), 360 - abs(hue - 210)), 5) AS from_blue FROM ({_HLS})")
def color_hls(spark, d):
    hue, light, sat = C.hls(F.col("r"), F.col("g"), F.col("b"))
    return _colors(spark, d).select("r", "g", "b", F.round(hue, 5).alias("hue"), F.round(light, 6).alias("light"), F.round(sat, 6).alias("sat"), F.round(C.hue_distance(hue, F.lit(210.0)), 5).alias("from_blue"))


_LIN = "CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END"
_LINS = f"SELECT r, g, b, {_LIN.format(c='r')} AS x, {_LIN.format(c='g')} AS y, {_LIN.format(c='b')} AS z FROM ({_DIST})"


@query(f"SELECT r, g, b, round(l, 6) AS luminance, l < 0.32 AS white_text FROM (SELECT *, 0.2126 * x + 0.7152 * y + 0.0722 * z AS l FROM ({_LINS}))")
def color_luminance(spark, d):
    rgb = F.col("r"), F.col("g"), F.col("b")
    return _colors(spark, d).select("r", "g", "b", F.round(C.luminance(*rgb), 6).alias("luminance"), C.white_text(*rgb).alias("white_text"))


_F = "CASE WHEN {t} > 0.008856 THEN pow({t}, 1.0 / 3) ELSE 7.787 * {t} + 16.0 / 116 END"
_LAB = f"""SELECT r, g, b, CASE WHEN v > 0.008856 THEN 116 * fv - 16 ELSE 903.3 * v END AS l, 500 * (fu - fv) AS a, 200 * (fv - fw) AS bb
FROM (SELECT *, {_F.format(t='u')} AS fu, {_F.format(t='v')} AS fv, {_F.format(t='w')} AS fw
  FROM (SELECT r, g, b, (0.412453 * x + 0.357580 * y + 0.180423 * z) / 0.950456 AS u, 0.212671 * x + 0.715160 * y + 0.072169 * z AS v, (0.019334 * x + 0.119193 * y + 0.950227 * z) / 1.088754 AS w FROM ({_LINS})))"""


@query(f"SELECT r, g, b, round(l, 4) AS lab_l, round(a, 4) AS lab_a, round(bb, 4) AS lab_b, round(sqrt(a * a + bb * bb), 4) AS chroma, round(sqrt((l - 50) * (l - 50) + a * a + bb * bb), 4) AS from_grey FROM ({_LAB})")
def color_lab(spark, d):
    p = F.col("p")
    grey = F.struct(F.lit(50.0).alias("l"), F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    rows = _colors(spark, d).withColumn("p", C.lab(F.col("r"), F.col("g"), F.col("b")))
    return rows.select("r", "g", "b", F.round(p["l"], 4).alias("lab_l"), F.round(p["a"], 4).alias("lab_a"), F.round(p["b"], 4).alias("lab_b"), F.round(C.chroma(p), 4).alias("chroma"), F.round(C.delta_e(p, grey), 4).alias("from_grey"))


@query(f"""
SELECT r, g, b, CASE WHEN greatest(r, g, b) <= 22 THEN '墨黑' WHEN sat < 0.10 THEN CASE WHEN light < 0.12 THEN '墨黑' WHEN light < 0.30 THEN '炭灰' WHEN light < 0.58 THEN '中灰' WHEN light < 0.82 THEN '浅灰' ELSE '灰白' END
  WHEN light > 0.78 THEN '浅' || base WHEN light < 0.18 AND base[1] NOT IN ('深', '暗') THEN '深' || base ELSE base END AS name
FROM (SELECT *, CASE WHEN hue < 15 OR hue >= 345 THEN CASE WHEN light < 0.38 THEN '酒红' WHEN light > 0.62 THEN '珊瑚红' ELSE '砖红' END
  WHEN hue < 45 THEN CASE WHEN sat < 0.28 THEN '灰褐' WHEN hue < 25 THEN if(light < 0.48, '赤褐', '陶红') WHEN hue < 36 THEN if(light < 0.5, '赭石棕', '焦糖橙') ELSE if(light < 0.5, '黄褐', '驼棕') END
  WHEN hue < 72 THEN if(sat < 0.42, '卡其黄', '金黄') WHEN hue < 155 THEN CASE WHEN light < 0.34 THEN '墨绿' WHEN sat < 0.45 THEN '橄榄绿' ELSE '草绿' END
  WHEN hue < 190 THEN if(light < 0.36, '深青', '青绿') WHEN hue < 250 THEN CASE WHEN light < 0.32 THEN '靛蓝' WHEN sat > 0.48 THEN '钴蓝' ELSE '雾蓝' END
  WHEN hue < 290 THEN if(light < 0.38, '深紫', '紫罗兰') ELSE if(light < 0.42, '暗玫红', '玫瑰粉') END AS base FROM ({_HLS}))
""")
def color_names(spark, d):
    return _colors(spark, d).withColumn("name", C.name(F.col("r"), F.col("g"), F.col("b")))


@query("""
WITH c AS (SELECT label, vec_id % 20 AS image, count(*) AS n FROM embeddings GROUP BY ALL), i AS (SELECT image, sum(n) AS total FROM c GROUP BY image), w AS (SELECT sum(total) AS whole, count(*) AS images FROM i)
SELECT label AS cluster, round(sum(n)::DOUBLE / any_value(whole), 6) AS weight, round(count(*) FILTER (n / total >= 0.05)::DOUBLE / any_value(images), 6) AS recurrence FROM c JOIN i USING (image), w GROUP BY label
""")
def cluster_weight_recurrence(spark, d):
    members = table(spark, d, "embeddings").select(F.lit("all").alias("grp"), (F.col("vec_id") % 20).alias("image"), F.col("label").alias("cluster"))
    out = palette.cluster_shares(members, "grp", "image", 0.05)
    return out.select("cluster", F.round("weight", 6).alias("weight"), F.round("recurrence", 6).alias("recurrence"))


@query()
def kmeans_palette(spark, d):
    """Palettes of the three return flags, from pixels sampled per part."""
    prepare(spark)
    pixels = _pixels(spark, d).select(F.col("l_returnflag").alias("grp"), (F.col("l_partkey") % 12).cast("string").alias("image"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("pixel"), "r", "g", "b")
    guidance = pixels.select("grp").distinct().withColumn("guidance", F.when(F.col("grp") == "R", "暗红主调，少量青绿点缀").otherwise("暖黄与墨绿，局部橙"))
    return palette.build_palettes(pixels, guidance, "grp", "image", "pixel")


@query("""
SELECT d.doc_id, 'unlabelled' AS finding FROM documents d ANTI JOIN labels l USING (doc_id) UNION ALL SELECT l.doc_id, 'orphan' FROM labels l ANTI JOIN documents d USING (doc_id)
UNION ALL SELECT c_custkey, 'no orders' FROM customer ANTI JOIN orders ON c_custkey = o_custkey
""")
def label_coverage(spark, d):
    docs, labels, customers, orders = (table(spark, d, n) for n in ("documents", "labels", "customer", "orders"))
    parts = [
        docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit("unlabelled").alias("finding")),
        labels.join(docs, "doc_id", "left_anti").select("doc_id", F.lit("orphan").alias("finding")),
        customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select(F.col("c_custkey").alias("doc_id"), F.lit("no orders").alias("finding")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""
SELECT o_orderkey, coalesce(n, 0) AS items, round(o_totalprice, 2) AS declared, round(coalesce(total, 0), 2) AS found, coalesce(n, 0) < 3 AS too_few
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(o_totalprice - coalesce(total, 0)) > 0.01
""")
def count_reconcile(spark, d):
    orders, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    seen = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.sum("l_extendedprice").alias("total"))
    rows = orders.join(seen, "o_orderkey", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("total", F.coalesce("total", F.lit(0.0)))
    return rows.filter(F.abs(F.col("o_totalprice") - F.col("total")) > 0.01).select("o_orderkey", F.col("n").alias("items"), F.round("o_totalprice", 2).alias("declared"), F.round("total", 2).alias("found"), (F.col("n") < 3).alias("too_few"))


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS repeats FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count(F.lit(1)) - 1).alias("repeats")).filter("repeats > 0")


@query("""
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, a.doc_id IS NOT NULL AS in_documents, b.doc_id IS NOT NULL AS in_labels
FROM (SELECT DISTINCT doc_id FROM documents) a FULL JOIN (SELECT DISTINCT doc_id + 1 AS doc_id FROM labels) b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL
""")
def set_equality(spark, d):
    """Documents against the successors of labelled ones: what only one side has."""
    a = table(spark, d, "documents").select("doc_id").distinct().withColumn("a", F.lit(True))
    b = table(spark, d, "labels").select((F.col("doc_id") + 1).alias("doc_id")).distinct().withColumn("b", F.lit(True))
    both = a.join(b, "doc_id", "full_outer").filter("a is null or b is null")
    return both.select("doc_id", F.col("a").isNotNull().alias("in_documents"), F.col("b").isNotNull().alias("in_labels"))


@query("""
SELECT doc_id, first_doc FROM (
  SELECT doc_id, first_value(doc_id) OVER w AS first_doc, row_number() OVER w AS n FROM (SELECT *, replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))), 'ß', 'ss') AS f FROM documents WHERE text IS NOT NULL)
  WINDOW w AS (PARTITION BY f ORDER BY doc_id)) WHERE n > 1
""")
def fingerprint_unique(spark, d):
    """Texts whose normal form an earlier document has; the first holder is aggregated and joined back."""
    rows = table(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2(T.normalized(F.col("text")), 256).alias("f"))
    first = rows.groupBy("f").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return rows.join(first, "f").filter("doc_id <> first_doc").select("doc_id", "first_doc")


@query("""
WITH f AS (
  SELECT user_id AS sheet, event_id AS pos, 'frame-' || (event_id % 97) || '.jpg' AS filename, event_id % 3 <> 0 AS kept, CASE WHEN event_id % 5 <> 0 THEN event_id * 10 END AS ms, CASE WHEN event_id % 7 <> 0 THEN 'scene' END AS method,
    'FRM-' || event_id AS frame_id
  FROM events),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet, filename ORDER BY pos DESC) AS r FROM f WHERE kept) WHERE r = 1)
SELECT sheet, name, coalesce(ms, 0) AS timestamp_ms, coalesce(method, 'frame') AS method, coalesce(frame_id, replace(name, '.jpg', '')) AS label
FROM (SELECT DISTINCT sheet, filename AS name FROM f) x LEFT JOIN last USING (sheet) WHERE last.filename = name
UNION ALL SELECT sheet, name, 0, 'frame', replace(name, '.jpg', '') FROM (SELECT DISTINCT sheet, filename AS name FROM f) x WHERE NOT EXISTS (SELECT 1 FROM last WHERE last.sheet = x.sheet AND last.filename = x.name)
""")
def frame_items(spark, d):
    """Frame files of each user with what the last kept row of that name says."""
    e = F.col("event_id")
    frames = table(spark, d, "events").select(
        F.col("user_id").alias("sheet"), e.alias("pos"), F.concat(F.lit("frame-"), (e % 97).cast("string"), F.lit(".jpg")).alias("filename"), F.when(e % 3 != 0, "kept").otherwise("filtered").alias("status"),
        F.when(e % 5 != 0, e * 10).alias("timestamp_ms"), F.when(e % 7 != 0, "scene").alias("method"), F.concat(F.lit("FRM-"), e.cast("string")).alias("frame_id"),
    )
    return reports.frame_items(frames.select("sheet", F.col("filename").alias("name")).distinct(), frames)


_STORED = "SELECT p_partkey, p_partkey % 4 AS m, CASE p_partkey % 10 WHEN 0 THEN [1, 2] WHEN 1 THEN [300, 0, 0] WHEN 2 THEN NULL ELSE [p_size, p_partkey % 256, 100] END AS rgb FROM part"


@query(f"""
WITH c AS ({_STORED}), lab AS ({_LAB.replace(_DIST, "SELECT DISTINCT rgb[1] AS r, rgb[2] AS g, rgb[3] AS b FROM c WHERE len(rgb) = 3 AND rgb[1] <= 255")})
SELECT p_partkey, CASE WHEN coalesce(len(rgb), -1) <> 3 THEN 'no rgb' WHEN rgb[1] > 255 THEN 'rgb out of range' END AS error, round(l, 4) AS lightness, round(sqrt(a * a + bb * bb), 4) AS chroma, CASE WHEN m = 0 THEN 0 ELSE 0.25 END::DOUBLE AS weight, 0.0::DOUBLE AS recurrence
FROM c LEFT JOIN lab ON rgb[1] = r AND rgb[2] = g AND rgb[3] = b
""")
def palette_candidates(spark, d):
    """Stored colours read back: some without rgb, some out of range, some without a share."""
    k = F.col("p_partkey")
    rgb = F.when(k % 10 == 0, F.array(F.lit(1), F.lit(2))).when(k % 10 == 1, F.array(F.lit(300), F.lit(0), F.lit(0))).when(k % 10 > 2, F.array(F.col("p_size").cast("int"), (k % 256).cast("int"), F.lit(100)))
    rows = table(spark, d, "part").select("p_partkey", rgb.alias("rgb"), F.when(k % 4 != 0, 0.25).alias("sample_share"), F.lit(None).cast("double").alias("image_recurrence"))
    out = reports.palette_candidates(rows)
    return out.select("p_partkey", "error", F.round("lightness", 4).alias("lightness"), F.round("chroma", 4).alias("chroma"), "weight", "recurrence")


#: Words and their folded forms.
_FOLDED = (("Straße", "strasse"), ("ΟΔΟΣ Οδος", "οδοσ οδοσ"), ("ﬁne ﬂow", "fine flow"), ("ſong", "song"), ("ŉ ǰ", "ʼn j\u030c"), ("Plain", "plain"), ("ÀÉ Ñ", "àé ñ"))
_FOLDS_SQL = ", ".join(f"({i}, '{want}')" for i, (_, want) in enumerate(_FOLDED))


@query(f"SELECT p_partkey, want || ' ' || p_partkey AS folded FROM part JOIN (VALUES {_FOLDS_SQL}) AS f(i, want) ON p_partkey % {len(_FOLDED)} = i")
def folded_names(spark, d):
    word = F.get(F.array(*[F.lit(w) for w, _ in _FOLDED]), (F.col("p_partkey") % len(_FOLDED)).cast("int"))
    return table(spark, d, "part").select("p_partkey", T.normalized(F.concat(F.lit(" "), word, F.lit(" \t "), F.col("p_partkey").cast("string"))).alias("folded"))


def _sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


@query(f"""
SELECT doc_id, regexp_matches(text, {_sql_text(T.EMAIL)}) AS email, regexp_matches(text, {_sql_text(T.UNIX_HOME)}) AS home, regexp_matches(text, {_sql_text(T.SIGNED_URL)}) AS signed,
  regexp_matches(text, {_sql_text(T.CREDENTIAL)}) AS credential, regexp_matches(replace(text, '\\\\', '\\'), {_sql_text(T.WINDOWS_HOME)}) AS windows
FROM documents WHERE email OR home OR signed OR credential OR windows
""")
def privacy_scan(spark, d):
    t = F.col("text")
    windows = F.replace(t, F.lit("\\\\"), F.lit("\\")).rlike(T.WINDOWS_HOME)
    rows = table(spark, d, "documents").select(
        "doc_id", t.rlike(T.EMAIL).alias("email"), t.rlike(T.UNIX_HOME).alias("home"), t.rlike(T.SIGNED_URL).alias("signed"), t.rlike(T.CREDENTIAL).alias("credential"), windows.alias("windows")
    )
    return rows.filter("email or home or signed or credential or windows")


@query("""
SELECT page_id, regexp_replace('see /home/user' || page_id || '/x.png and ' || url, '/(?:Users|home)/[^/\\s]+(?:/[^\\s"'']*)?', '<private-path>', 'g') AS shown FROM pages
""")
def redaction(spark, d):
    message = F.concat(F.lit("see /home/user"), F.col("page_id"), F.lit("/x.png and "), F.col("url"))
    return table(spark, d, "pages").select("page_id", T.redact(message).alias("shown"))


_ODD_NAMES = "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'plain ' || event_id || '.jpg' WHEN 1 THEN 'VID-0001__000000001500__scene__x.jpg' WHEN 2 THEN 'VID-12__000000001500__scene__0001.jpg' ELSE printf('VID-%04d__%012d__uniform__%04d-extra.png', user_id % 10000, event_id * 7, event_id % 10000) END AS name FROM events"
_PREFIX = "'^(VID-[0-9]{4})__([0-9]{12})__(scene|uniform|boundary)__[0-9]{4}'"


@query(f"""
SELECT event_id, CASE WHEN hit THEN regexp_extract(name, {_PREFIX}, 2)::BIGINT ELSE 0 END AS timestamp_ms, CASE WHEN hit THEN regexp_extract(name, {_PREFIX}, 3) ELSE 'frame' END AS method,
  CASE WHEN hit THEN regexp_extract(name, {_PREFIX}, 1) ELSE regexp_replace(name, '\\.[^.]*$', '') END AS label,
  row_number() OVER (PARTITION BY event_id % 3 ORDER BY CASE WHEN hit THEN regexp_extract(name, {_PREFIX}, 2)::BIGINT ELSE 0 END, lower(name), event_id) AS place
FROM (SELECT *, regexp_matches(name, {_PREFIX}) AS hit FROM ({_ODD_NAMES}))
""")
def sheet_order(spark, d):
    """Items of three sheets in order: by the time in a frame's name, else by name."""
    e = F.col("event_id")
    usual = F.format_string("VID-%04d__%012d__uniform__%04d-extra.png", F.col("user_id") % 10000, e * 7, e % 10000)
    name = F.when(e % 5 == 0, F.concat(F.lit("plain "), e.cast("string"), F.lit(".jpg"))).when(e % 5 == 1, "VID-0001__000000001500__scene__x.jpg").when(e % 5 == 2, "VID-12__000000001500__scene__0001.jpg").otherwise(usual)
    rows = table(spark, d, "events").select("event_id", (e % 3).alias("sheet"), name.alias("name")).withColumn("p", T.frame_identity(F.col("name")))
    rows = rows.select("event_id", "sheet", "p.timestamp_ms", "p.method", "p.label", T.casefold(F.col("name")).alias("fold"))
    return quality.numbered(rows, ["sheet"], [F.col("timestamp_ms"), F.col("fold"), F.col("event_id")], "place").drop("sheet", "fold")


@query("""
SELECT source, page, CASE WHEN pages > 1 THEN printf('%s-%02d.jpg', source, page) ELSE source || '.jpg' END AS file
FROM (SELECT source, ceil(count(*) / 30.0)::INTEGER AS pages FROM documents WHERE source IS NOT NULL GROUP BY source), unnest(range(1, pages + 1)) AS t(page)
""")
def page_names(spark, d):
    sheets = table(spark, d, "documents").filter("source is not null").groupBy("source").agg(layout.page_count(F.count(F.lit(1)), 5, 6).alias("pages"))
    rows = sheets.select("source", "pages", F.explode(F.sequence(F.lit(1), F.col("pages"))).alias("page"))
    return rows.select("source", F.col("page").cast("long").alias("page"), T.page_name(F.col("source"), F.lit(".jpg"), F.col("page"), F.col("pages")).alias("file"))


@query("""
SELECT event_id, CASE WHEN x < 0 OR isnan(x) THEN NULL ELSE x END AS seconds, coalesce(((coalesce(trunc(try_cast(tag AS DOUBLE)), side, 0)::BIGINT % 360) + 360) % 360, 0)::INTEGER AS rotation, transfer IN ('smpte2084', 'arib-std-b67') OR primaries = 'bt2020' AS tone_mapped
FROM (SELECT event_id, try_cast(raw AS DOUBLE) AS x, tag, side, lower(transfer) AS transfer, lower(primaries) AS primaries FROM (
  SELECT event_id, ([value::VARCHAR, '-2', 'abc', 'nan', NULL])[event_id % 5 + 1] AS raw, (['90', 'x', NULL, '-90.0', '450'])[event_id % 5 + 1] AS tag, ([270, 180])[event_id % 2 + 1] AS side,
    (['SMPTE2084', 'arib-std-b67', 'bt709'])[event_id % 3 + 1] AS transfer, (['bt709', 'BT2020'])[event_id % 2 + 1] AS primaries FROM events))
""")
def probe_values(spark, d):
    """Values as probes report them: numbers that may be unreadable, rotation tags and side data, colour transfer."""
    e = F.col("event_id")
    of = lambda n, *xs: F.get(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (e % n).cast("int"))
    raw = of(5, F.col("value").cast("string"), "-2", "abc", "nan", F.lit(None).cast("string"))
    turned = N.rotation(of(5, "90", "x", F.lit(None).cast("string"), "-90.0", "450"), F.array(F.lit("bad"), of(2, "270", "180")))
    return table(spark, d, "events").select("event_id", N.parse_float(raw).alias("seconds"), turned.alias("rotation"), N.tone_mapped(of(3, "SMPTE2084", "arib-std-b67", "bt709"), of(2, "bt709", "BT2020")).alias("tone_mapped"))


@query(f"SELECT user_id, count(*) FILTER (value > 250) AS kept FROM ({_EV}) GROUP BY user_id HAVING count(*) FILTER (value > 250) < 3")
def kept_guard(spark, d):
    """Subjects with fewer than three kept moments."""
    frames = _events(spark, d).withColumn("status", F.when(F.col("value") > 250, "kept").otherwise("filtered"))
    return timeline.kept_guard(frames, "user_id")


#: Guidance texts, the families that they name and their accents in order.
_GUIDANCE = (
    ("大面积蓝，少量橙点缀；局部红", "蓝 红 橙", "橙 红"), ("蓝色为主", "蓝", ""), ("孔雀蓝与青绿", "蓝 绿", ""), ("局部青，点缀在远处的一大片蓝", "蓝 青", "青 蓝"),
    ("点缀青绿与一块红；红少量", "红 绿 青", "红 绿 青"), ("局部蓝与少量青", "蓝 青", "蓝"), ("紫罗兰和玫瑰粉。金黄一块", "黄 紫 粉", "黄"),
)
_GUIDES = ", ".join(f"({i}, '{named}', '{accents}')" for i, (_, named, accents) in enumerate(_GUIDANCE))


@query(f"SELECT p_partkey, named, accents FROM part JOIN (VALUES {_GUIDES}) AS g(i, named, accents) ON p_partkey % {len(_GUIDANCE)} = i")
def hue_words(spark, d):
    text = F.get(F.array(*[F.lit(g) for g, _, _ in _GUIDANCE]), (F.col("p_partkey") % len(_GUIDANCE)).cast("int"))
    families = lambda x: F.array_join(F.transform(x, lambda t: t["family"]), " ")
    return dealt(table(spark, d, "part").select("p_partkey"), "p_partkey").select("p_partkey", families(C.hue_targets(text)).alias("named"), families(C.accent_targets(text)).alias("accents"))


@query(f"SELECT r, g, b, [r, g, b] AS back, round(r * 100.0 / 255, 6) AS lab_l, (g - 128)::DOUBLE AS lab_a, (b - 128)::DOUBLE AS lab_b FROM ({_DIST})")
def color_bytes(spark, d):
    rgb = F.col("r"), F.col("g"), F.col("b")
    p = C.lab_from_bytes(*rgb)
    return _colors(spark, d).select("r", "g", "b", C.rgb_of(C.hex_of(*rgb)).alias("back"), F.round(p["l"], 6).alias("lab_l"), p["a"].alias("lab_a"), p["b"].alias("lab_b"))


@query("""
SELECT n_nationkey, i, (i % 5 * 384)::INTEGER AS x0, (i // 5 * 540)::INTEGER AS y0, (i % 5 * 384 + 384)::INTEGER AS x1, (i // 5 * 540 + 540)::INTEGER AS y1, (i % 5 * 384 + 192)::INTEGER AS cx, (i // 5 * 540 + 270)::INTEGER AS cy,
  1974 AS overview_width, (ceil((n_nationkey + 1) / 2.0) * 558 + 18)::INTEGER AS overview_height
FROM nation, unnest(range(10)) AS t(i)
""")
def card_cells(spark, d):
    """Ten cells of each nation's card, and the size of an overview of so many groups as its key says."""
    rows = table(spark, d, "nation").select("n_nationkey", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("i"))
    width, height = layout.overview_size(F.col("n_nationkey") + 1)
    return layout.card_cells(rows, "n_nationkey", F.col("i")).withColumns({"overview_width": width, "overview_height": height})


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Given' WHEN doc_id % 3 = 1 THEN lang ELSE 'pack ' || doc_id END AS title FROM documents WHERE doc_id % 3 <> 1 OR trim(lang) <> ''")
def titles(spark, d):
    """Explicit title, project, or the folder's name without its suffix."""
    i = F.col("doc_id")
    named = T.title(F.when(i % 3 == 0, " Given "), F.when(i % 3 == 1, F.col("lang")), F.concat(F.lit("pack "), i.cast("string"), F.lit("-风格包-v2")))
    return table(spark, d, "documents").filter("doc_id % 3 <> 1 or trim(lang) <> ''").select("doc_id", named.alias("title"))


@query("""
SELECT page_id, p AS path, coalesce(regexp_matches(p, '\\S') AND NOT contains(p, '\\') AND NOT regexp_matches(p, '^[A-Za-z]:') AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..'), false) AS portable
FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_extract(url, '://[^/]*/(.*)$', 1) WHEN 2 THEN '../' || page_id ELSE regexp_extract(url, '://[^/]*(.*)$', 1) END AS p FROM pages)
""")
def portable_paths(spark, d):
    tail, whole = F.regexp_extract("url", "://[^/]*/(.*)$", 1), F.regexp_extract("url", "://[^/]*(.*)$", 1)
    kind = F.col("page_id") % 4
    p = F.when(kind == 0, F.col("url")).when(kind == 1, tail).when(kind == 2, F.concat(F.lit("../"), F.col("page_id"))).otherwise(whole)
    return table(spark, d, "pages").select("page_id", p.alias("path")).withColumn("portable", T.portable_path(F.col("path")))


@query(f"""
WITH used AS (SELECT l_returnflag AS flag, printf('#%02X%02X%02X', r, g, b) AS hex FROM ({_PIX})), allowed AS (SELECT DISTINCT printf('#%02X%02X%02X', least(p_size * 5, 255), p_partkey % 11 * 25, p_partkey % 9 * 31) AS hex FROM part)
SELECT flag, hex, count(*) AS places FROM used ANTI JOIN allowed USING (hex) GROUP BY ALL
""")
def hex_reference_check(spark, d):
    """Colours written into texts that are not part of the allowed palette."""
    p = _pixels(spark, d)
    texts = p.select(F.col("l_returnflag").alias("flag"), F.concat(F.lit("tone "), F.lower(C.hex_of(F.col("r"), F.col("g"), F.col("b"))), F.lit(" here")).alias("text"))
    shade = [x.cast("int") for x in (F.least(F.col("p_size") * 5, F.lit(255)), F.col("p_partkey") % 11 * 25, F.col("p_partkey") % 9 * 31)]
    allowed = table(spark, d, "part").select(C.hex_of(*shade).alias("hex")).distinct()
    used = texts.select("flag", F.explode(T.hex_tokens(F.col("text"))).alias("hex"))
    return used.groupBy("flag", "hex").agg(F.count(F.lit(1)).alias("places")).join(allowed, "hex", "left_anti")


@query("""
SELECT sum(CASE WHEN finding = 'unlabelled' THEN 1 ELSE 0 END)::BIGINT AS warnings, sum(CASE WHEN finding <> 'unlabelled' THEN 1 ELSE 0 END)::BIGINT AS errors, CASE WHEN sum(CASE WHEN finding <> 'unlabelled' THEN 1 ELSE 0 END) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
FROM (SELECT 'unlabelled' AS finding FROM documents ANTI JOIN labels USING (doc_id) UNION ALL SELECT 'repeated' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
""")
def validation_report(spark, d):
    unlabelled = label_coverage(spark, d).filter("finding = 'unlabelled'").select(F.lit("warning").alias("severity"))
    found = unlabelled.unionByName(duplicate_keys(spark, d).select(F.lit("error").alias("severity")))
    errors = F.count_if(F.col("severity") == "error")
    return found.agg(F.count_if(F.col("severity") == "warning").alias("warnings"), errors.alias("errors"), F.when(errors == 0, "PASS").otherwise("FAIL").alias("status"))


@query("""
SELECT source, doc_id, CASE WHEN n = 1 THEN name ELSE 'clip__' || n || '.jpg' END AS destination
FROM (SELECT source, doc_id, 'clip.jpg' AS name, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)
""")
def unique_names(spark, d):
    files = table(spark, d, "documents").select("source", "doc_id", F.lit("clip.jpg").alias("name"))
    return quality.unique_names(files, ["source"], "name", ["doc_id"]).select("source", "doc_id", "destination")


@query("""
SELECT x AS value, CASE WHEN x IN ('', '0/0', 'N/A') THEN NULL WHEN x LIKE '%/%' THEN try_cast(split_part(x, '/', 1) AS DOUBLE) / nullif(try_cast(split_part(x, '/', 2) AS DOUBLE), 0) ELSE try_cast(x AS DOUBLE) END AS rate
FROM (SELECT o_orderkey::VARCHAR || '/' || (o_orderkey % 7)::VARCHAR AS x FROM orders UNION ALL SELECT unnest(['30000/1001', '25', 'N/A', '0/0', '', 'x/2']))
""")
def parse_fractions(spark, d):
    made = table(spark, d, "orders").select(F.concat_ws("/", F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 7).cast("string")).alias("value"))
    fixed = spark.createDataFrame([(x,) for x in ("30000/1001", "25", "N/A", "0/0", "", "x/2")], "value string")
    return made.unionByName(fixed).select("value", N.parse_fraction(F.col("value")).alias("rate"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
