"""Scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.vectors import cosine, dot
from lodeframe.operators.nearest import nearest
from lodeframe.plans.registry import query, table


@query("""SELECT c_custkey, upper(c_name) AS up, length(c_name)::BIGINT AS len, substr(c_name, 2, 4) AS sub, replace(c_name, '#', '-') AS rep, lpad(c_mktsegment, 12, '*') AS padded,
 reverse(c_name) AS rev, concat_ws('/', c_name, c_mktsegment) AS joined, instr(c_name, '#')::BIGINT AS at, ascii(c_name)::BIGINT AS code, repeat('ab', 3) AS again,
 split_part(c_name, '#', 2) AS part, levenshtein(c_mktsegment, 'MACHINERY')::BIGINT AS distance FROM customer""")
def scalar_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, s = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.upper(n).alias("up"), F.length(n).cast("long").alias("len"), F.substring(n, 2, 4).alias("sub"), F.replace(n, F.lit("#"), F.lit("-")).alias("rep"), F.lpad(s, 12, "*").alias("padded"),
        F.reverse(n).alias("rev"), F.concat_ws("/", n, s).alias("joined"), F.instr(n, "#").cast("long").alias("at"), F.ascii(n).cast("long").alias("code"), F.repeat(F.lit("ab"), 3).alias("again"),
        F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), F.levenshtein(s, F.lit("MACHINERY")).cast("long").alias("distance"),
    )


@query("""SELECT doc_id, length(text)::BIGINT AS chars, strlen(text)::BIGINT AS bytes, lower(text) AS low, len(regexp_split_to_array(text, '\\s+'))::BIGINT AS words, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents""")
def scalar_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).cast("long").alias("chars"), F.octet_length(t).cast("long").alias("bytes"), F.lower(t).alias("low"), F.size(F.split(t, r"\s+")).cast("long").alias("words"), F.size(F.split(t, "\n")).cast("long").alias("lines"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS digits, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, len(regexp_extract_all(p_name, '[a-z]+'))::BIGINT AS runs, regexp_matches(p_type, '^[A-S]') AS early FROM part""")
def scalar_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.regexp_extract("p_brand", "([0-9]+)", 1).alias("digits"), F.regexp_replace("p_name", "[aeiou]", "_").alias("masked"), F.regexp_count("p_name", F.lit("[a-z]+")).cast("long").alias("runs"), F.col("p_type").rlike("^[A-S]").alias("early"))


@query("SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")
def scalar_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("m"), F.sha2("text", 256).alias("s"))


@query("SELECT doc_id, upper(replace(text, 'ß', 'ss')) AS up FROM documents")
def scalar_upper_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharp s has two upper-case forms, of which engines choose either; it is spelled out first."""
    return table(spark, sf_dir, "documents").select("doc_id", F.upper(F.replace("text", F.lit("ß"), F.lit("ss"))).alias("up"))


@query()
def scalar_xxhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH64 with seed 42, which DuckDB lacks."""
    return table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("h"))


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS w, dayofweek(o_orderdate) AS dow,
 date_trunc('month', o_orderdate)::TIMESTAMP AS month_start, (o_orderdate + INTERVAL 10 DAY)::TIMESTAMP AS later, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS days, strftime(o_orderdate, '%Y/%m') AS ym FROM orders""")
def scalar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("o_orderdate")
    parts = {"y": F.year(t), "m": F.month(t), "d": F.day(t), "q": F.quarter(t), "doy": F.dayofyear(t), "w": F.weekofyear(t), "dow": F.dayofweek(t) - 1}
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", *(c.cast("long").alias(n) for n, c in parts.items()), F.date_trunc("month", t).cast("timestamp_ntz").alias("month_start"), (t + F.expr("INTERVAL 10 DAY")).cast("timestamp_ntz").alias("later"),
        F.datediff(t.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"), F.date_format(t, "yyyy/MM").alias("ym"),
    )


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, abs(l_quantity - 25) AS a, sqrt(l_quantity) AS s, ln(l_quantity) AS l, exp(l_discount) AS e, pow(l_quantity, 2) AS p, ceil(l_extendedprice)::BIGINT AS c, floor(l_extendedprice)::BIGINT AS f,
 sign(l_quantity - 25)::DOUBLE AS g, (l_orderkey % 7)::BIGINT AS r, (l_orderkey // 7)::BIGINT AS i, round(l_extendedprice::DECIMAL(12, 2), 1)::DOUBLE AS d FROM lineitem""")
def scalar_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.abs(q - 25).alias("a"), F.sqrt(q).alias("s"), F.ln(q).alias("l"), F.exp("l_discount").alias("e"), F.pow(q, F.lit(2.0)).alias("p"), F.ceil(p).cast("long").alias("c"), F.floor(p).cast("long").alias("f"),
        F.sign(q - 25).cast("double").alias("g"), (F.col("l_orderkey") % 7).alias("r"), F.expr("l_orderkey div 7").alias("i"), F.round(p.cast("decimal(12,2)"), 1).cast("double").alias("d"),
    )


@query("""SELECT vec_id, len(embedding)::BIGINT AS n, len(list_filter(embedding, lambda x: x > 0))::BIGINT AS positive, embedding[3]::DOUBLE AS third,
 list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS squares FROM embeddings""")
def scalar_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.size(e).cast("long").alias("n"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"), F.element_at(e, 3).cast("double").alias("third"), dot(e, e).alias("squares"))


@query("""SELECT a_id, b_id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY a_id ORDER BY cosine DESC, b_id) AS r FROM (
 SELECT a.vec_id AS a_id, b.vec_id AS b_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS cosine
 FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0)) WHERE r <= 10""")
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of all vectors for every 20th, the stated query set."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e.where("id % 20 = 0"), e, 10)


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) / sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])), 9) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_cosine_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector with the one behind it, in column functions."""
    e = table(spark, sf_dir, "embeddings")
    ahead = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return e.join(ahead, "vec_id").select("vec_id", F.round(cosine(F.col("embedding"), F.col("b")), 9).alias("cosine"))


@query("SELECT item_id, unnest(range(len(w)))::BIGINT AS pos, unnest(w) AS word FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def scalar_posexplode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).select("item_id", F.col("pos").cast("long").alias("pos"), "word")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def scalar_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events")
def scalar_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.sum(F.variant_get(F.parse_json("props"), "$.k", "bigint")).alias("total"))


@query("SELECT n_regionkey::BIGINT AS n_regionkey, max(CASE WHEN n_name = 'CHINA' THEN n_nationkey END)::BIGINT AS china, count(*) AS n FROM nation GROUP BY 1")
def scalar_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.map_from_entries(F.collect_list(F.struct("n_name", "n_nationkey")))
    return table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("n_regionkey")).agg(names.alias("m")).select("n_regionkey", F.try_element_at("m", F.lit("CHINA")).cast("long").alias("china"), F.size(F.map_keys("m")).cast("long").alias("n"))


@query("SELECT s_suppkey, s.name AS name, s.balance AS balance FROM (SELECT s_suppkey, {'name': s_name, 'balance': s_acctbal} AS s FROM supplier)")
def scalar_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", s.alias("s")).select("s_suppkey", "s.name", "s.balance")


@query("SELECT s_suppkey, s_acctbal / nullif(s_nationkey, 0) AS ratio FROM supplier")
def scalar_safe_division(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANSI division by zero is an error; try_divide gives null."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.try_divide("s_acctbal", F.col("s_nationkey").cast("double")).alias("ratio"))
