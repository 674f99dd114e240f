"""Queries over the text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeframe.functions.html import BLOCK, html_to_text
from lodeframe.operators.contamination import contaminated_by_ngrams
from lodeframe.operators.languages import identify_languages
from lodeframe.operators.minhash import near_duplicate_classes
from lodeframe.plans.registry import query, table

#: Words of a text, A-Z in lower case, as DuckDB cuts them.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"


_BLOCKS = "|".join(BLOCK)


@query(rf"""SELECT page_id, trim(regexp_replace(regexp_replace(t, ' *\n *', chr(10), 'g'), '\n+', chr(10), 'g'), ' ' || chr(10)) AS plain FROM (
 SELECT page_id, regexp_replace(replace(replace(replace(regexp_replace(t, '&amp;?', '&', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), ' +', ' ', 'g') AS t FROM (
 SELECT page_id, regexp_replace(regexp_replace(t, '</?({_BLOCKS})\b[^>]*(>|$)', chr(10), 'gi'), '</?[a-z][^>]*(>|$)|<[!?][^>]*(>|$)', '', 'gi') AS t FROM (
 SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<(script|style|title)\b[^>]*>.*?(</(script|style|title)\s*>|$)', '', 'gis'), '\s+', ' ', 'g') AS t FROM pages)))""")
def text_of_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible lines of pages.  The SQL knows the markup of these pages only; the tests hold other markup against a parser."""
    return table(spark, sf_dir, "pages").select("page_id", html_to_text("html").alias("plain"))


def _fold(column: str) -> str:
    """Three sixteenths of all ids, by their MD5."""
    return f"substr(md5(CAST({column} AS {{}})), 1, 1) IN ('0', '1', '2')"


@query(f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce({_fold("doc_id").format("VARCHAR")}, false) AS held_out, lower(text) AS t FROM documents),
 grams AS (SELECT r, (unicode(t[i]) * 1000003 + unicode(t[i + 1]) * 8191 + unicode(t[i + 2])) % 65536 AS b, n FROM (
  SELECT r, g AS t, 1 AS i, count(*) AS n FROM (SELECT r, unnest(list_transform(range(1, length(t) - 1), lambda i: t[i:i + 2])) AS g FROM docs) GROUP BY ALL)),
 models AS (SELECT lang AS model, b, sum(n) AS c FROM grams JOIN docs USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
 sizes AS (SELECT model, sum(c) AS total FROM models GROUP BY 1),
 priors AS (SELECT lang AS model, ln(count(*) / sum(count(*)) OVER ()) AS prior FROM docs WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1),
 scores AS (SELECT r, p.model, any_value(prior) + sum(g.n * ln((coalesce(c, 0) + 1) / (total + 65536))) AS score FROM grams g CROSS JOIN priors p JOIN sizes USING (model) LEFT JOIN models m ON m.model = p.model AND m.b = g.b GROUP BY ALL)
 SELECT doc_id, lang, held_out, predicted FROM docs LEFT JOIN (SELECT r, arg_max(model, score) AS predicted FROM scores GROUP BY r) USING (r)""")
def text_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    return identify_languages(table(spark, sf_dir, "documents"), F.expr(_fold("doc_id").format("STRING")))


def _grams(rows: str, key: str) -> str:
    return f"SELECT DISTINCT {key}, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {_WORDS} AS w FROM {rows}))"


@query(f"""SELECT doc_id, count(*) AS shared FROM ({_grams("(SELECT *, row_number() OVER () AS r FROM documents)", "r, doc_id")}) WHERE g IN (SELECT g FROM ({_grams("benchmark", "item_id")})) GROUP BY r, doc_id""")
def text_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share an 8-gram of words with the benchmark."""
    return contaminated_by_ngrams(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY 1")
def text_pages_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host")).agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n, avg(quality) AS quality, sum(toxic)::BIGINT AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def text_labels_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.avg("quality").alias("quality"), F.sum("toxic").alias("toxic"))


@query("SELECT conv_id, string_agg(role, '>' ORDER BY turn) AS roles, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1")
def text_conversation_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda s: s["role"]), ">")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(roles.alias("roles"), F.sum(F.length("text")).alias("chars"))


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1")
def text_chars_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(f"""WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
 shingles AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) > 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [''] END) AS s FROM docs),
 sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
 links AS (SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.r != y.r GROUP BY 1, 2) JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE shared >= 0.8 * (p.n + q.n - shared)),
 reach(r, t) AS (SELECT r, r FROM docs UNION SELECT reach.r, b FROM reach JOIN links ON a = t)
 SELECT any_value(d.doc_id) AS doc_id, min(e.doc_id) AS class_id FROM reach JOIN docs d ON d.r = reach.r JOIN docs e ON e.r = t GROUP BY reach.r""")
def text_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose 5-word shingles have a Jaccard similarity of 0.8 at least, found by MinHash bands."""
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
