"""Domain views over the driver's tables, as DataFrames and as the same SQL.

An order is an image: its lines are the tags of its caption, after a front of
rating, people count and artist; parts are the tag knowledge base; embeddings
are features, their labels artists; conversations are read lines; events are
edits. Every view is deterministic, so both engines see the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAG_TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
#: kind of a tag by its part's type, in both engines
KINDS = {"ECONOMY": "general", "LARGE": "general", "MEDIUM": "character", "PROMO": "copyright", "SMALL": "meta", "STANDARD": "general"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, n, tag): the tags of an order in the order of its lines, with repeats."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("l_orderkey").alias("key"), F.row_number().over(order).alias("n"), F.col("p_name").alias("tag"))


OCCURRENCES = """occurrences AS (
  SELECT l_orderkey AS key, p_name AS tag,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def fronts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, rating, people, artist, solo) of an order."""
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 7
    people = F.when(k == 0, "1girl").when(k == 1, "2girls").when(k == 2, "multiple_girls").when(k == 3, "1boy").when(k == 4, "6+girls").when(k == 5, "solo").otherwise("3others")
    rating = F.when(F.col("o_orderstatus") == "F", "safe").when(F.col("o_orderstatus") == "O", "general").otherwise("explicit")
    artist = F.concat(F.lit("@"), F.translate(F.lower("o_orderpriority"), " -", "__"))
    return orders.select(F.col("o_orderkey").alias("key"), rating.alias("rating"), people.alias("people"), artist.alias("artist"), k.isin(0, 3, 5).alias("solo"))


FRONTS = """fronts AS (
  SELECT o_orderkey AS key,
         CASE o_orderstatus WHEN 'F' THEN 'safe' WHEN 'O' THEN 'general' ELSE 'explicit' END AS rating,
         CASE o_orderkey % 7 WHEN 0 THEN '1girl' WHEN 1 THEN '2girls' WHEN 2 THEN 'multiple_girls' WHEN 3 THEN '1boy'
                             WHEN 4 THEN '6+girls' WHEN 5 THEN 'solo' ELSE '3others' END AS people,
         '@' || translate(lower(o_orderpriority), ' -', '__') AS artist,
         o_orderkey % 7 IN (0, 3, 5) AS solo
  FROM orders)"""


def emitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, pos, tag): front and tags, positions from 0."""
    front = fronts(spark, sf_dir).select("key", F.posexplode(F.array("rating", "people", "artist")).alias("pos", "tag"))
    return front.unionByName(occurrences(spark, sf_dir).select("key", (F.col("n") + 2).alias("pos"), "tag"))


EMITTED = (
    OCCURRENCES
    + ",\n"
    + FRONTS
    + """,
emitted AS (
  SELECT key, 0 AS pos, rating AS tag FROM fronts UNION ALL SELECT key, 1, people FROM fronts
  UNION ALL SELECT key, 2, artist FROM fronts UNION ALL SELECT key, CAST(n + 2 AS INTEGER), tag FROM occurrences)"""
)


def bags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, tags): the ordered bag of each image. A bag is one caption's, so small."""
    rows = emitted(spark, sf_dir).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("x"))
    return rows.select("key", F.transform("x", lambda p: p["tag"]).alias("tags"))


BAGS = EMITTED + ",\nbags AS (SELECT key, list(tag ORDER BY pos) AS tags FROM emitted GROUP BY key)"


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tag, kind, path, posts): one row per tag; of several parts the one with most posts, then the first brand."""
    part = table(spark, sf_dir, "part")
    best = part.groupBy(F.col("p_name").alias("tag")).agg(F.max(F.struct("p_size", F.col("p_brand").alias("brand"), "p_type")).alias("b"))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return best.select("tag", F.element_at(kinds, F.col("b.p_type")).alias("kind"), F.concat_ws(" > ", "b.brand", "b.p_type").alias("path"), F.col("b.p_size").cast("int").alias("posts"))


KNOWLEDGE = (
    """knowledge AS (
  SELECT tag, CASE p_type """
    + " ".join(f"WHEN '{t}' THEN '{k}'" for t, k in KINDS.items())
    + """ END AS kind, p_brand || ' > ' || p_type AS path, CAST(p_size AS INTEGER) AS posts
  FROM (SELECT p_name AS tag, p_size, p_brand, p_type,
               row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_brand DESC, p_type DESC) AS r FROM part)
  WHERE r = 1)"""
)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, box, x0, y0, x1, y1, score): the lines of an order as detections."""
    line = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    rows = line.select(
        F.col("l_orderkey").alias("image"), F.row_number().over(order).alias("box"), (8 * F.col("l_quantity")).alias("x0"), F.floor(F.col("l_extendedprice") % 400).cast("double").alias("y0"),
        (40 + 60 * F.col("l_linenumber")).cast("double").alias("w"), F.round(120 + 500 * F.col("l_tax"), 0).alias("h"), F.round(1 - F.col("l_discount"), 2).alias("score"),
    )
    return rows.select("image", "box", "x0", "y0", (F.col("x0") + F.col("w")).alias("x1"), (F.col("y0") + F.col("h")).alias("y1"), "score")


BOXES = """boxes AS (
  SELECT image, box, x0, y0, x0 + w AS x1, y0 + h AS y1, score FROM (
    SELECT l_orderkey AS image,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) AS box,
           8 * l_quantity AS x0, CAST(floor(l_extendedprice % 400) AS DOUBLE) AS y0, CAST(40 + 60 * l_linenumber AS DOUBLE) AS w,
           round(120 + 500 * l_tax, 0) AS h, round(1 - l_discount, 2) AS score
    FROM lineitem))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, tag, score, truth): cosine of each vector to each label's mean, to six places."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("d", "x"))
    centre = e.groupBy(F.col("label").alias("tag"), "d").agg(F.avg("x").alias("c"))
    # labels are a fixed handful, so the centres are a bounded table
    both = e.join(F.broadcast(centre), "d").groupBy("vec_id", "label", "tag").agg((F.sum(F.col("x") * F.col("c")) / F.sqrt(F.sum(F.col("x") * F.col("x")) * F.sum(F.col("c") * F.col("c")))).alias("s"))
    return both.select(F.col("vec_id").alias("sample"), "tag", F.round((1 + F.col("s")) / 2, 6).alias("score"), (F.col("tag") == F.col("label")).cast("int").alias("truth"))


SCORES = """e AS (SELECT vec_id, label, unnest(range(64)) AS d, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
centre AS (SELECT label AS tag, d, avg(x) AS c FROM e GROUP BY label, d),
scores AS (
  SELECT vec_id AS sample, tag, round((1 + sum(x * c) / sqrt(sum(x * x) * sum(c * c))) / 2, 6) AS score, CAST(tag = label AS INTEGER) AS truth
  FROM e JOIN centre USING (d) GROUP BY vec_id, label, tag)"""

#: Captions that reach every corner of the grammar.
CAPTIONS = (
    "1girl, long hair, blue eyes",
    "safe, 2girls, @sincos, smile. On the left, red hair, dress. On the right, blue_hair, hat.",
    "2girls, On the left, red hair, In the middle, hat",
    'solo, comic. Japanese text reads as "やあ, 元気", "うん". on the right, smile.',
    "multiple views, 1girl, light blue dress, two-tone hair, ...",
    "4koma, 2girls, 1boy, blue_hair, Blue Hair, hair bow, bowtie, bow",
    "multiple_girls, very long hair, long hair, absurdly long hair, no pants, pants",
    "pov, 1girl, 2boys, genshin impact, ayaka (genshin impact), :d",
    "2023, score_9, masterpiece, highres, original, kuronuma mayu (kat (bu-kunn)), @kat (bu-kunn)",
    "",
    "  1boy ,, on the beach ,\n@ @, dark-skinned female, white background.",
    'nsfw, 3others, "a, b. On the left, c", 「x, y」, end.',
)


def captions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(CAPTIONS)], "id int, text string")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


CAPTIONS_SQL = "captions(id, text) AS (VALUES " + ", ".join(f"({i}, {quoted(c)})" for i, c in enumerate(CAPTIONS)) + ")"
