"""Readers and writers: each query writes what a table holds in a format, reads it again and gives the rows; the SQL gives them from the table."""

from __future__ import annotations

import sqlite3

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import vectors as V
from tessella.plans import query, table
from tessella.sources import files as S
from tessella.sources import lists as L
from tessella.sources import model as M
from tessella.sources import tables as T
from tessella.sources import vectors as X

DIM = 64


def rounded(column, places=6):
    return F.transform(column, lambda v: F.round(v.cast("double"), places) + 0.0)


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def folder_of(spark, build, name):
    """A new folder that build has written to."""
    folder = S.new_folder(spark, name)
    build(folder)
    return folder


ROUNDED = "list_transform(embedding, lambda v: round(v::DOUBLE, 6) + 0.0)"


@query("src_idvec_bin", f"SELECT vec_id AS id, {ROUNDED} AS embedding FROM embeddings")
def src_idvec_bin(spark, sf_dir):
    folder = folder_of(spark, lambda f: X.write_idvec(vectors(spark, sf_dir), f, DIM, normalise=False), "idvec")
    return X.read_idvec(spark, folder, DIM).select(F.col("id").cast("long").alias("id"), rounded("embedding").alias("embedding"))


@query("snk_idvec_bin", "SELECT vec_id AS id, list_transform(embedding, lambda v: round(v::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) + 0.0) AS embedding FROM embeddings WHERE vec_id % 7 <> 3")
def snk_idvec_bin(spark, sf_dir):
    """From text `id,f<2>f..`; every seventh vector is one number short and left out. Written floats round to 5 places as the numbers do."""
    short = F.when(F.expr("id % 7 = 3"), F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding"))
    at = S.new_folder(spark, "idvec-text")
    vectors(spark, sf_dir).select(F.concat(F.col("id").cast("string"), F.lit(","), F.array_join(F.transform(short, lambda v: v.cast("double").cast("string")), "\x02"))).write.text(at)
    parts = spark.read.text(at).select(F.split("value", ",").alias("p")).select(F.get("p", F.lit(0)).alias("id"), F.transform(F.split(F.get("p", F.lit(1)), "\x02"), lambda v: v.cast("float")).alias("embedding"))
    folder = folder_of(spark, lambda f: X.write_idvec(parts, f, DIM, places=5), "idvec")
    return X.read_idvec(spark, folder, DIM).select(F.col("id").cast("long").alias("id"), rounded("embedding", 5).alias("embedding"))


@query("src_csv_vec", f"SELECT vec_id AS id, {ROUNDED} AS embedding FROM embeddings WHERE vec_id % 10 <> 4")
def src_csv_vec(spark, sf_dir):
    """Every tenth line is one number short."""
    at = S.new_folder(spark, "csv")
    short = F.when(F.expr("id % 10 = 4"), F.slice("embedding", 1, DIM - 1)).otherwise(F.col("embedding"))
    vectors(spark, sf_dir).select(F.concat_ws(",", F.col("id").cast("string"), F.array_join(F.transform(short, lambda v: v.cast("double").cast("string")), ","))).write.text(at)
    return X.read_csv_vectors(spark, at, DIM).select(F.col("id").cast("long").alias("id"), rounded("embedding").alias("embedding"))


@query("src_raw_float", f"SELECT row_number() OVER (ORDER BY vec_id) - 1 AS frame, {ROUNDED} AS embedding FROM embeddings")
def src_raw_float(spark, sf_dir):
    folder = folder_of(spark, lambda f: X.write_raw_floats(vectors(spark, sf_dir), f, "id"), "raw")
    return X.read_raw_floats(spark, folder, DIM).select("frame", rounded("embedding").alias("embedding"))


@query("src_mat_bin", f"SELECT 'm' || label AS name, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS \"row\", {ROUNDED} AS \"values\" FROM embeddings")
def src_mat_bin(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("m"), F.col("label").cast("string")).alias("name"), (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).alias("row"), F.col("embedding").alias("values"))
    return X.read_matrices(spark, folder_of(spark, lambda f: X.write_matrices(e, f), "mat")).select("name", "row", rounded("values").alias("values"))


KEYPOINTS = "SELECT 'b' || p_size AS name, (row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1)::INT AS idx, (p_partkey % 640)::DOUBLE AS x, (p_partkey % 480 + 0.5)::DOUBLE AS y, (p_partkey % 360)::DOUBLE AS angle, (p_partkey % 30 + 1.25)::DOUBLE AS size, (p_partkey % 8 / 8.0)::DOUBLE AS response, -1 AS class_id, (p_partkey % 5)::INT AS octave FROM part"


def keypoints(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("idx", F.row_number().over(W.partitionBy("p_size").orderBy("p_partkey")) - 1)
    return p.selectExpr("concat('b', p_size) AS name", "idx", "cast(p_partkey % 640 AS float) AS x", "cast(p_partkey % 480 + 0.5 AS float) AS y", "cast(p_partkey % 360 AS float) AS angle", "cast(p_partkey % 30 + 1.25 AS float) AS size", "cast(p_partkey % 8 / 8.0 AS float) AS response", "-1 AS class_id", "cast(p_partkey % 5 AS int) AS octave")


def wide(df):
    return df.select(*(F.col(c).cast("double").alias(c) if t == "float" else F.col(c) for c, t in df.dtypes))


for own in X.KEYPOINT_ORDERS:

    @query("src_kps_bin" if own == "point_first" else "snk_kps_bin", KEYPOINTS)
    def kps_bin(spark, sf_dir, own=own):
        return wide(X.read_keypoints(spark, folder_of(spark, lambda f: X.write_keypoints(keypoints(spark, sf_dir), f, own), "kps"), own))


@query("src_geoinfo", KEYPOINTS.replace("AS idx,", "AS id, (p_partkey % 97)::INT AS relate_id,"))
def src_geoinfo(spark, sf_dir):
    rows = keypoints(spark, sf_dir).withColumnRenamed("idx", "id")
    own = table(spark, sf_dir, "part").selectExpr("concat('b', p_size) AS name", "cast(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS int) AS id", "cast(p_partkey % 97 AS int) AS relate_id")
    return wide(X.read_geoinfo(spark, folder_of(spark, lambda f: X.write_geoinfo(rows.join(own, ["name", "id"]), f), "geo")))


@query("src_sift_text", "SELECT 'i' || s_nationkey AS name, (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1)::INT AS idx, s_suppkey % 100 + 0.5::DOUBLE AS x, (s_suppkey % 60)::DOUBLE AS y, 1.5::DOUBLE AS scale, 0.25::DOUBLE AS orientation, list_transform(range(128), lambda j: ((s_suppkey * (j + 1)) % 256)::INT) AS descriptor FROM supplier")
def src_sift_text(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("idx", F.row_number().over(W.partitionBy("s_nationkey").orderBy("s_suppkey")) - 1)
    rows = s.selectExpr("concat('i', s_nationkey) AS name", "idx", "s_suppkey % 100 + 0.5D AS x", "s_suppkey % 60 AS y", "1.5D AS scale", "0.25D AS orientation", "transform(sequence(0, 127), j -> cast((s_suppkey * (j + 1)) % 256 AS int)) AS descriptor")
    return wide(X.read_feature_text(spark, folder_of(spark, lambda f: X.write_feature_text(rows, f), "features")))


@query("src_pgm", "SELECT n_nationkey::VARCHAR || '.pgm' AS name, 4 AS \"rows\", 6 AS cols, list_transform(range(24), lambda i: ((i * (n_nationkey + 3)) % 256)::INT) AS pixels FROM nation")
def src_pgm(spark, sf_dir):
    body = F.expr("concat(encode(concat('P5', chr(10), '# made', chr(10), '6 4', chr(10), '255', chr(10)), 'utf-8'), unhex(array_join(transform(sequence(0, 23), i -> lpad(hex((i * (n_nationkey + 3)) % 256), 2, '0')), '')))")
    rows = table(spark, sf_dir, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".pgm")).alias("name"), body.alias("content"))
    return X.read_pgm(spark, folder_of(spark, lambda f: S.save_files(rows, f), "pgm"))


@query("src_list_file", "SELECT 'data/' || p_name || '.jpg' AS line FROM part")
def src_list_file(spark, sf_dir):
    """With blank lines between, and white space around."""
    at = S.new_folder(spark, "list")
    table(spark, sf_dir, "part").select(F.concat(F.lit("  data/"), "p_name", F.lit(".jpg \n"))).write.text(at)
    return L.read_lines(spark, at)


def small_files(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b"), F.lit("/"), "n_name", F.when(F.col("n_nationkey") % 3 == 0, ".jpg").otherwise(".txt")).alias("name"), F.repeat(F.lit("x"), F.col("n_nationkey") + 1).cast("binary").alias("content"))
    folder = S.new_folder(spark, "files")
    for part in ("a", "b"):
        S.save_files(rows.where(F.col("name").startswith(f"{part}/")).withColumn("name", F.substring("name", 3, 1000)), f"{folder}/{part}")
    return folder


@query("src_glob", "SELECT n_name || '.jpg' AS name, (n_nationkey + 1)::BIGINT AS bytes FROM nation WHERE n_nationkey % 3 = 0 AND n_nationkey % 2 = 0")
def src_glob(spark, sf_dir):
    return S.paths(spark, f"{small_files(spark, sf_dir)}/a", "*.jpg").select(F.element_at(F.split("path", "/"), -1).alias("name"), "bytes")


@query("src_dir_recursive", "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'a' ELSE 'b' END AS folder, n_name || CASE WHEN n_nationkey % 3 = 0 THEN '.jpg' ELSE '.txt' END AS name FROM nation")
def src_dir_recursive(spark, sf_dir):
    parts = F.split(F.replace("path", F.lit("%20"), F.lit(" ")), "/")
    return S.paths(spark, small_files(spark, sf_dir), recursive=True).select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"))


NAMED = "SELECT s_suppkey AS id, s_name AS name FROM supplier"


def images(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.regexp_replace("s_name", " ", "_").alias("name"))


PAIRS = "SELECT DISTINCT least(a, b) AS id1, greatest(a, b) AS id2 FROM (SELECT l_suppkey AS a, (l_suppkey * 7 + l_linenumber) % (SELECT count(*) + 2 FROM supplier) + 1 AS b FROM lineitem) WHERE b <= (SELECT max(s_suppkey) FROM supplier)"


def named_pairs(spark, sf_dir):
    """Pairs of suppliers by name, in either order; some names are not known."""
    n = table(spark, sf_dir, "supplier").count() + 2
    pairs = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS a", f"(l_suppkey * 7 + l_linenumber) % {n} + 1 AS b", "l_orderkey")
    named = images(spark, sf_dir)
    one, two = named.select(F.col("id").alias("a"), F.col("name").alias("name1")), named.select(F.col("id").alias("b"), F.col("name").alias("name2"))
    return pairs.join(F.broadcast(one), "a").join(F.broadcast(two), "b", "left").withColumn("name2", F.coalesce("name2", F.lit("nobody")))  # a name for each supplier


@query("src_match_list", PAIRS)
def src_match_list(spark, sf_dir):
    at = S.new_folder(spark, "pairs")
    named_pairs(spark, sf_dir).select(F.when(F.col("l_orderkey") % 2 == 0, F.concat(F.lit(" "), "name1", F.lit(" "), "name2", F.lit("\n# a comment\n"))).otherwise(F.concat_ws(" ", "name2", "name1"))).write.text(at)
    return L.read_pairs(spark, at, images(spark, sf_dir)).select(F.least("id1", "id2").alias("id1"), F.greatest("id1", "id2").alias("id2"))


@query("src_match_blocks", "SELECT s_suppkey AS id1, s_suppkey + 1 AS id2, j::INT AS idx1, (j * 3 % 11)::INT AS idx2 FROM supplier, range(5) t(j) WHERE s_suppkey < (SELECT max(s_suppkey) FROM supplier)")
def src_match_blocks(spark, sf_dir):
    """A file for each nation; in each the block after the last has an unknown name, which ends it."""
    named = images(spark, sf_dir)
    after = named.select((F.col("id") - 1).alias("id"), F.col("name").alias("name2"))
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: F.concat_ws(" ", j.cast("string"), (j * 3 % 11).cast("string"))), "\n")
    blocks = named.join(after, "id").groupBy((F.col("id") % 7).cast("string").alias("name")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.concat_ws(" ", F.col("name"), F.col("name2")), F.lit("\n"), lines))), "\n\n").alias("text"))
    content = F.concat("text", F.lit("\n\n\nnobody at_all\n1 2\n\n")).cast("binary").alias("content")
    at = folder_of(spark, lambda f: S.save_files(blocks.select("name", content), f), "blocks")
    return L.read_match_blocks(spark, at, named)


@query("src_label_list", "SELECT 'img/' || p_brand || ' ' || p_partkey || '.jpg' AS path, (p_size % 13)::INT AS label FROM part")
def src_label_list(spark, sf_dir):
    at = S.new_folder(spark, "labels")
    table(spark, sf_dir, "part").selectExpr("concat('img/', p_brand, ' ', p_partkey, '.jpg ', p_size % 13)").write.text(at)
    return L.read_labels(spark, at, seed=5)


CAMERA_SQL = "SELECT n_nationkey::BIGINT AS camera_id, CASE WHEN n_nationkey % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_RADIAL' END AS model, 640::BIGINT AS width, (480 + n_nationkey)::BIGINT AS height, [500.5, 320.0, 240.0, (n_nationkey / 64)::DOUBLE] AS params FROM nation"
IMAGE_SQL = "SELECT s_suppkey AS image_id, [0.5, 0.5, -0.5, 0.5]::DOUBLE[] AS qvec, [(s_suppkey / 8)::DOUBLE, 0.0, -1.5] AS tvec, s_nationkey::BIGINT AS camera_id, 'view' || s_suppkey || '.png' AS name, list_transform(range(s_suppkey % 4), lambda i: (i * 2.5)::DOUBLE) AS xs, list_transform(range(s_suppkey % 4), lambda i: (CASE WHEN i = 1 THEN -1 ELSE s_suppkey + i END)::BIGINT) AS point_ids FROM supplier"
POINT_SQL = "SELECT p_partkey AS point3d_id, [(p_partkey / 4)::DOUBLE, p_size::DOUBLE, -2.0] AS xyz, [p_size % 256, 7, 255]::INT[] AS rgb, (p_size / 32)::DOUBLE AS error, list_transform(range(p_partkey % 3), lambda i: (p_partkey + i)::BIGINT) AS track_images, list_transform(range(p_partkey % 3), lambda i: i::INT) AS track_points FROM part"


def cameras(spark, sf_dir):
    return table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey AS bigint) AS camera_id", "CASE WHEN n_nationkey % 2 = 0 THEN 'PINHOLE' ELSE 'SIMPLE_RADIAL' END AS model", "640L AS width", "cast(480 + n_nationkey AS bigint) AS height", "array(500.5D, 320D, 240D, n_nationkey / 64D) AS params")


def model_images(spark, sf_dir):
    points = f"cast(CASE WHEN s_suppkey % 4 = 0 THEN array() ELSE transform(sequence(0, cast(s_suppkey % 4 - 1 AS int)), i -> named_struct('x', i * 2.5D, 'y', 3D, 'point3d_id', CASE WHEN i = 1 THEN -1L ELSE s_suppkey + i END)) END AS {M.POINT2D}) AS points2d"
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS image_id", "array(0.5D, 0.5D, -0.5D, 0.5D) AS qvec", "array(s_suppkey / 8D, 0D, -1.5D) AS tvec", "cast(s_nationkey AS bigint) AS camera_id", "concat('view', s_suppkey, '.png') AS name", points)


def model_points(spark, sf_dir):
    track = f"cast(CASE WHEN p_partkey % 3 = 0 THEN array() ELSE transform(sequence(0, cast(p_partkey % 3 - 1 AS int)), i -> named_struct('image_id', p_partkey + i, 'point2d_idx', i)) END AS {M.TRACK}) AS track"
    return table(spark, sf_dir, "part").selectExpr("p_partkey AS point3d_id", "array(p_partkey / 4D, cast(p_size AS double), -2D) AS xyz", "array(p_size % 256, 7, 255) AS rgb", "p_size / 32D AS error", track)


def flat_images(df):
    return df.select("image_id", "qvec", "tvec", "camera_id", "name", F.transform("points2d", lambda p: p["x"]).alias("xs"), F.transform("points2d", lambda p: p["point3d_id"]).alias("point_ids"))


def flat_points(df):
    return df.select("point3d_id", "xyz", "rgb", "error", F.transform("track", lambda t: t["image_id"]).alias("track_images"), F.transform("track", lambda t: t["point2d_idx"]).alias("track_points"))


def text_copy(spark, df, write, read, name):
    at = S.new_folder(spark, name)
    write(df, at)
    return read(spark, at)


@query("src_model_text", CAMERA_SQL)
def src_model_text(spark, sf_dir):
    return text_copy(spark, cameras(spark, sf_dir), M.write_cameras_text, M.read_cameras_text, "cameras")


@query("src_model_text_images", IMAGE_SQL)
def src_model_text_images(spark, sf_dir):
    return flat_images(text_copy(spark, model_images(spark, sf_dir), M.write_images_text, M.read_images_text, "images"))


@query("src_model_text_points", POINT_SQL)
def src_model_text_points(spark, sf_dir):
    return flat_points(text_copy(spark, model_points(spark, sf_dir), M.write_points_text, M.read_points_text, "points"))


def binary_copy(spark, df, kind):
    return M.read_binary(spark, folder_of(spark, lambda f: M.write_binary(df, f, kind), kind), kind)


@query("src_model_bin", CAMERA_SQL)
def src_model_bin(spark, sf_dir):
    return binary_copy(spark, cameras(spark, sf_dir), "cameras")


@query("src_model_bin_images", IMAGE_SQL)
def src_model_bin_images(spark, sf_dir):
    return flat_images(binary_copy(spark, model_images(spark, sf_dir), "images"))


@query("src_model_bin_points", POINT_SQL)
def src_model_bin_points(spark, sf_dir):
    return flat_points(binary_copy(spark, model_points(spark, sf_dir), "points"))


for own in ("text", "binary"):

    @query(f"snk_ply_{own}", "SELECT 'c' || p_size % 5 AS name, (row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1)::INT AS idx, (p_partkey / 4)::DOUBLE AS x, p_size::DOUBLE AS y, -2.0::DOUBLE AS z, (p_size % 256)::INT AS r, 7 AS g, 255 AS b FROM part")
    def snk_ply(spark, sf_dir, own=own):
        rows = table(spark, sf_dir, "part").selectExpr("concat('c', p_size % 5) AS name", "cast(row_number() OVER (PARTITION BY p_size % 5 ORDER BY p_partkey) - 1 AS int) AS idx", "p_partkey / 4D AS x", "cast(p_size AS double) AS y", "-2D AS z", "p_size % 256 AS r", "7 AS g", "255 AS b")
        return M.read_ply(spark, folder_of(spark, lambda f: M.write_ply(rows, f, own == "binary"), "ply"))


@query("src_sqlite", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_nationkey IS NOT NULL")
def src_sqlite(spark, sf_dir):
    """The file is made by the driver in the shared folder, then read in ranges of 1,000 rows."""
    folder = S.new_folder(spark, "sqlite").removeprefix("file:")
    S.save_files(spark.createDataFrame([("empty", b"")], "name string, content binary"), folder)
    with sqlite3.connect(f"{folder}/store.db") as c:
        c.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL)")
        c.executemany("INSERT INTO customer VALUES (?, ?, ?)", (tuple(r) for r in table(spark, sf_dir, "customer").where("c_nationkey IS NOT NULL").select("c_custkey", "c_name", "c_acctbal").toLocalIterator()))
    return T.read_sqlite(spark, f"{folder}/store.db", "customer", "c_custkey long, c_name string, c_acctbal double", 1000)


@query("src_lmdb", "SELECT p_name || p_partkey AS key, p_brand AS value, (p_size)::INT AS label FROM part")
def src_lmdb(spark, sf_dir):
    at = S.new_folder(spark, "keyed")
    T.write_keyed(table(spark, sf_dir, "part").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("key"), F.encode("p_brand", "utf-8").alias("value"), F.col("p_size").cast("int").alias("label")), at)
    return T.read_keyed(spark, at).select("key", F.decode("value", "utf-8").alias("value"), "label")


@query("snk_index_flat", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 5) AS total, 64 AS dim FROM embeddings WHERE vec_id % 2 = 1")
def snk_index_flat(spark, sf_dir):
    """Two versions; the last is loaded."""
    at = S.new_folder(spark, "index")
    T.save_index({"vectors": vectors(spark, sf_dir)}, at, "flat", dim=DIM)
    T.save_index({"vectors": vectors(spark, sf_dir).where("id % 2 = 1")}, at, "flat", dim=DIM)
    parts, parameters = T.load_index(spark, at, "flat")
    return parts["vectors"].select("id", V.rounded(V.total(V.doubles(F.col("embedding"))), 5).alias("total"), F.lit(parameters["dim"]).alias("dim"))
