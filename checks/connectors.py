"""Checks of readers, writers, images, hooks and streams, on files that Spark writes from the given tables."""

from pyspark.sql import functions as F

from checks.common import check, load, rounded
from checks.modelling import _D, _X, graded, li
from millrace.operators import models
from millrace.plans.hooks import Hooks, map_chunks
from millrace.plans.sizing import scratch_path
from millrace.plans.spec import Recipe
from millrace.sources import images, readers, writers
from millrace.streaming import jobs


def _at(spark, tag):
    return scratch_path(spark, tag)


@check("io1_csv_round_trip", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def io1(spark, sf):
    o, path = load(spark, sf, "orders"), _at(spark, "csv")
    writers.export_to_csv(o.withColumn("o_orderdate", F.col("o_orderdate").cast("string")), path)
    out = readers.load_csv(spark, path, parse_dates=["o_orderdate"], schema="o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate string, o_orderpriority string")
    return out.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@check("io1b_csv_null_tokens", """SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status FROM orders""")
def io1b(spark, sf):
    path = _at(spark, "tokens")
    o = load(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_totalprice AS STRING) END AS price", "CASE WHEN o_orderkey % 3 = 0 THEN 'None' ELSE o_orderstatus END AS status")
    writers.export_to_csv(o, path, sep="|")
    return readers.load_csv(spark, path, delimiter="|", null_tokens=True)


@check("io2_json_flatten", "SELECT o_orderkey AS \"id\", o_orderstatus AS \"order.status\", o_totalprice AS \"order.price.total\" FROM orders")
def io2(spark, sf):
    path = _at(spark, "json")
    o = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("price")).alias("order"))
    writers.export_to_json(o, path)
    return readers.load_json(spark, path, flatten=True)


@check("io3_xml_round_trip", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region_id FROM nation")
def io3(spark, sf):
    path = _at(spark, "xml")
    n = load(spark, sf, "nation").select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("_id")).alias("region"))
    n.write.format("xml").option("rowTag", "nation").option("rootTag", "nations").save(path)
    out = readers.load_xml(spark, path, "nation")
    return out.select(F.col("key").cast("int").alias("key"), "name", F.col("region_id").cast("int").alias("region_id"))


@check("io4_parquet_pruned", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_discount > 0.05")
def io4(spark, sf):
    return readers.load_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity"], "l_discount > 0.05")


@check("io6_query_tables", "SELECT o_orderpriority, COUNT(*) AS n, ROUND(SUM(l_quantity), 4) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def io6(spark, sf):
    return rounded(readers.query_tables(spark, "SELECT o_orderpriority, COUNT(*) AS n, SUM(l_quantity) AS quantity FROM {o} JOIN {l} ON l_orderkey = o_orderkey GROUP BY 1",
                                        o=load(spark, sf, "orders"), l=load(spark, sf, "lineitem")))


@check("io7_multiple_files", "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL AS nation FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_nationkey FROM supplier")
def io7(spark, sf):
    a, b = _at(spark, "many"), _at(spark, "many")
    writers.export_to_csv(load(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance"), a)
    writers.export_to_csv(load(spark, sf, "supplier").selectExpr("s_nationkey AS nation", "s_suppkey AS id", "s_name AS name"), b)
    return readers.load_multiple_files(spark, [a, b], "csv").select("id", "name", "balance", "nation")


@check("io9_text_files", "SELECT string_agg(p_name, chr(10) ORDER BY p_partkey) || chr(10) AS content FROM part GROUP BY p_brand")
def io9(spark, sf):
    path = _at(spark, "text")
    parts = load(spark, sf, "part").select("p_brand", "p_partkey", "p_name").repartition("p_brand").sortWithinPartitions("p_brand", "p_partkey")
    parts.select("p_brand", "p_name").write.partitionBy("p_brand").text(path)
    return readers.load_text_files(spark, path, "part-*", recursive=True).select("content")


@check("io10_yaml", "SELECT c_custkey AS id, c_mktsegment AS \"info.segment\", c_acctbal AS \"info.balance\" FROM customer")
def io10(spark, sf):
    path = _at(spark, "yaml")
    load(spark, sf, "customer").selectExpr("concat('- {id: ', c_custkey, ', info: {segment: ', c_mktsegment, ', balance: ', CAST(c_acctbal AS DECIMAL(12,2)), '}}') AS v").write.text(path)
    return readers.load_yaml(spark, path, "part-*").select("id", "`info.segment`", "`info.balance`")


@check("io13_flatten_records", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"p.k\" FROM events")
def io13(spark, sf):
    return readers.flatten_records(load(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p")))


@check("io14_infer_file_types", "SELECT * FROM (VALUES ('csv'), ('json'), ('xml'), ('parquet'), ('text')) t(format)")
def io14(spark, sf):
    base = _at(spark, "mixed")
    n = load(spark, sf, "nation").coalesce(1)
    n.write.option("header", True).csv(base + "/a")
    n.write.json(base + "/b")
    n.write.format("xml").option("rowTag", "nation").save(base + "/c")
    n.write.parquet(base + "/d")
    n.select("n_name").write.text(base + "/e")
    return readers.infer_file_types(spark, base, "part-*", recursive=True).select("format").distinct()


@check("io15_list_files", "SELECT * FROM (VALUES ('benchmark'), ('conversations'), ('customer'), ('documents'), ('embeddings'), ('events'), ('labels'), ('lineitem'), ('nation'), ('orders'), ('pages'), ('part'), ('region'), ('supplier')) t(name)")
def io15(spark, sf):
    return readers.list_files(spark, sf, extensions=["parquet"]).where("size > 0").select(F.regexp_replace("name", "[.]parquet$", "").alias("name"))


@check("out2_parquet_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def out2(spark, sf):
    path = _at(spark, "parts")
    writers.export_to_parquet(load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, "zstd", ["o_orderstatus"])
    return readers.load_parquet(spark, path, where="o_orderstatus = 'F'")


@check("out4_save_load", "SELECT p_partkey, p_name, p_size FROM part")
def out4(spark, sf):
    path = _at(spark, "orc")
    writers.save_dataframe(load(spark, sf, "part").select("p_partkey", "p_name", "p_size"), path, "orc")
    return writers.load_dataframe(spark, path, "orc")


def pictures(spark, sf):
    """Grey 4 x 4 pictures whose pixels are the first 16 embedding values scaled to 0..255."""
    level = lambda x: F.lpad(F.hex(F.greatest(F.lit(0), F.least(F.lit(255), F.floor((x + 1) * 127.5))).cast("long")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 16), level), ""))
    return load(spark, sf, "embeddings").select("vec_id", F.struct(F.lit(4).alias("height"), F.lit(4).alias("width"), F.lit(1).alias("nChannels"), data.alias("data")).alias("image"))


_PX = "GREATEST(0, LEAST(255, FLOOR((CAST(embedding[{i}] AS DOUBLE) + 1) * 127.5)))"


@check("i1_resize_normalize", "SELECT vec_id, height, width, channels, ROUND((" + " + ".join(_PX.format(i=i) for i in (1, 2, 5, 6)) + ") / 4 / 255, 4) AS top_left FROM embeddings, (SELECT 2 AS height, 2 AS width, 3 AS channels) d")
def i1(spark, sf):
    out = images.process(pictures(spark, sf), "vec_id", [{"type": "resize", "width": 2, "height": 2}, {"type": "normalize"}])
    return rounded(out.select("vec_id", "height", "width", "channels", F.get("values", 0).cast("double").alias("top_left")))


@check("i2_histograms", "SELECT vec_id, 16 AS red, 48 AS every FROM embeddings")
def i2(spark, sf):
    h = images.histograms(pictures(spark, sf), "vec_id")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("int")
    return h.select("vec_id", total(F.slice("histogram", 1, 256)).alias("red"), total("histogram").alias("every"))


@check("i3_augment_flips", "SELECT vec_id, CAST(c AS INT) AS copy, CAST(48 AS INT) AS n FROM embeddings, range(1, 3) t(c)")
def i3(spark, sf):
    return images.augment_flips(pictures(spark, sf), "vec_id", 2).select("vec_id", "copy", F.size("values").alias("n"))


@check("u3_map_chunks", "SELECT l_orderkey, ROUND(l_extendedprice * 2, 4) AS doubled FROM lineitem")
def u3(spark, sf):
    return rounded(map_chunks(li(spark, sf).select("l_orderkey", "l_extendedprice"), lambda p: p.assign(doubled=p.l_extendedprice * 2)[["l_orderkey", "doubled"]], "l_orderkey long, doubled double"))


@check("u4_custom_bootstrap")
def u4(spark, sf):
    from millrace.operators.hypothesis import bootstrap_ci

    return bootstrap_ci(load(spark, sf, "orders"), "o_totalprice", "o_orderkey", statistic=lambda s: (s["square"] / s["count"]) ** 0.5, n_bootstrap=200)


@check("u5_hooks_around_scoring", "SELECT COUNT(*) AS n, CAST(SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM labels JOIN documents USING (doc_id) WHERE n_chars > 100")
def u5(spark, sf):
    hooks = Hooks()
    hooks.register("data_source", "graded", lambda s, **k: graded(s, **k))
    hooks.register("before_prediction", "long_only", lambda d: d.where("text_char_count > 100"))
    hooks.register("after_prediction", "count", lambda d: d.agg(F.count("*").alias("n"), F.count_if(F.col("quality") == 1).alias("good")))
    df = hooks.load_source(spark, "graded", sf=sf)
    return hooks.score(models.train_model(df, "quality", _D, "decision_tree_classifier"), df)


@check("stream_resample", "SELECT date_trunc('day', ts) AS start, event_type, ROUND(AVG(value), 6) AS value, COUNT(*) AS count FROM events GROUP BY 1, 2")
def stream_resample(spark, sf):
    s = jobs.read_stream(spark, sf, load(spark, sf, "events").schema, "events.parquet")
    out = jobs.run_to_table(jobs.stream_resample(s, "ts", "value", by=["event_type"]), "complete")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "value", "count"), 6)


@check("stream_prepare_rows", """WITH e AS (SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END AS value FROM events), f AS (SELECT event_id, COALESCE(value, (SELECT AVG(value) FROM e)) AS value FROM e),
 s AS (SELECT AVG(value) AS m, STDDEV_POP(value) AS s FROM f) SELECT event_id, ROUND((value - m) / s, 4) AS value FROM f, s""")
def stream_prepare(spark, sf):
    hide = lambda d: d.withColumn("value", F.expr("CASE WHEN event_id % 4 IN (1, 2) THEN NULL ELSE value END")).select("event_id", "value")
    batch = load(spark, sf, "events")
    fitted = Recipe().add("fill_mean", ["value"]).add("standard", ["value"]).fit(hide(batch))
    s = jobs.read_stream(spark, sf, batch.schema, "events.parquet")
    return rounded(jobs.run_to_table(fitted.transform(hide(s))))


@check("stream_scoring", "SELECT COUNT(*) AS n FROM lineitem")
def stream_scoring(spark, sf):
    m = models.train_model(li(spark, sf), "l_extendedprice", _X[:1], "linear_regression")
    s = jobs.read_stream(spark, sf, load(spark, sf, "lineitem").schema, "lineitem.parquet")
    return jobs.run_to_table(models.score(m, s.select("l_orderkey", "l_quantity"))).where("Predicted_Value is not null").agg(F.count("*").alias("n"))
