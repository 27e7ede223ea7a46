"""Queries over text functions, statistics and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sampling, stats
from ..sources.fixtures import table
from .registry import query

_MARKS = (tx.ASCII_MARKS + tx.CJK_MARKS).replace("'", "''")


def sql_norm(x: str) -> str:
    """DuckDB form of answer normalisation."""
    num = f"lower(coalesce({x}, ''))"
    for _ in range(3):
        num = rf"regexp_replace({num}, '([0-9]),([0-9]{{3}})\b', '\1\2', 'g')"
    return rf"trim(regexp_replace(translate({num}, '{_MARKS}', ''), '\s+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


@query("txt05_normalize", f"SELECT doc_id, md5({sql_norm('text')}) AS norm_md5, length({sql_norm('text')}) AS n FROM documents")
def txt05(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", tx.normalize_answer(F.col("text")).alias("t"))
    return d.select("doc_id", F.md5("t").alias("norm_md5"), F.length("t").cast("long").alias("n"))


@query("txt01_nfkc", "SELECT doc_id, md5(text) AS nfkc_md5 FROM documents")
def txt01(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.md5(tx.nfkc("text")).alias("nfkc_md5"))


@query("txt02_03_04_steps", rf"""SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS collapsed, md5(translate(text, '{_MARKS}', '')) AS bare,
 md5(regexp_replace(regexp_replace(text, '([0-9]),([0-9]{{3}})\b', '\1\2', 'g'), '([0-9]),([0-9]{{3}})\b', '\1\2', 'g')) AS numbers FROM documents""")
def txt02(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return docs(spark, sf).select("doc_id", F.md5(tx.collapse(t)).alias("collapsed"), F.md5(tx.without_marks(t)).alias("bare"), F.md5(tx.plain_numbers(t)).alias("numbers"))


@query("txt11_token_len", f"SELECT doc_id, len({sql_tokens(sql_norm('text'))}) AS n_tokens, len(list_distinct({sql_tokens(sql_norm('text'))})) AS n_types FROM documents")
def txt11(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", tx.tokens(tx.normalize_answer(F.col("text"))).alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query("txt07_occurrences", f"""WITH t AS (SELECT doc_id, {sql_norm('text')} AS n FROM documents), q AS (SELECT doc_id, n, array_to_string(({sql_tokens('n')})[1:1], ' ') AS a FROM t)
SELECT doc_id, a <> '' AND contains(n, a) AS found, CASE WHEN a = '' THEN 0 ELSE CAST((length(n) - length(replace(n, a, ''))) / length(a) AS INT) END AS n_found FROM q""")
def txt07(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", tx.normalize_answer(F.col("text")).alias("n"))
    d = d.withColumn("a", F.coalesce(F.try_element_at(tx.tokens(F.col("n")), F.lit(1)), F.lit("")))
    return d.select("doc_id", tx.contains_answer(F.col("n"), F.col("a")).alias("found"), tx.occurrences(F.col("n"), F.col("a")).alias("n_found"))


def turn_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Successive turns of a conversation: conv_id, turn, p and g (normalised texts)."""
    c = table(spark, sf, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.select("conv_id", "turn", tx.normalize_answer(F.col("text")).alias("p"), F.lead(tx.normalize_answer(F.col("text"))).over(w).alias("g"))
    return rows.filter(F.col("g").isNotNull())


_PAIRS = f"pr AS (SELECT conv_id, turn, {sql_norm('text')} AS p, lead({sql_norm('text')}) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM conversations), pt AS (SELECT conv_id, turn, p, g, {sql_tokens('p')} AS a, {sql_tokens('g')} AS b FROM pr WHERE g IS NOT NULL)"


@query("txt08_09_em_f1", f"""WITH {_PAIRS}, bag AS (SELECT conv_id, turn, t, sum(l) AS na, sum(r) AS nb FROM (
  SELECT conv_id, turn, unnest(a) AS t, 1 AS l, 0 AS r FROM pt UNION ALL SELECT conv_id, turn, unnest(b), 0, 1 FROM pt) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(na, nb)) AS same FROM bag GROUP BY ALL)
SELECT conv_id, turn, p = g AS em, round(CASE WHEN len(a) = 0 AND len(b) = 0 THEN 1.0 WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE 2.0::DOUBLE * same / (len(a) + len(b)) END, 6)::DOUBLE AS f1 FROM pt LEFT JOIN s USING (conv_id, turn)""")
def txt09(spark: SparkSession, sf: str) -> DataFrame:
    d = turn_pairs(spark, sf)
    return d.select("conv_id", "turn", (F.col("p") == F.col("g")).alias("em"), F.round(tx.token_f1(tx.tokens(F.col("p")), tx.tokens(F.col("g"))), 6).alias("f1"))


@query("txt10_overlap", f"""WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(a), list_distinct(b)))::DOUBLE / len(list_distinct(a)) END, 6)::DOUBLE AS overlap FROM pt""")
def txt10(spark: SparkSession, sf: str) -> DataFrame:
    return turn_pairs(spark, sf).select("conv_id", "turn", F.round(tx.token_overlap(tx.tokens(F.col("p")), tx.tokens(F.col("g"))), 6).alias("overlap"))


@query("txt12_cer", """WITH q AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS r, lower(replace(p_name, 'a', 'e')) AS h FROM part)
SELECT p_partkey, round(levenshtein(r, h)::DOUBLE / length(r), 6) AS cer FROM q""")
def txt12(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.round(tx.cer(F.concat_ws(" ", "p_name", "p_type"), F.regexp_replace("p_name", "a", "e")), 6).alias("cer"))


@query("txt14_similarity")
def txt14(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", tx.text_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")).alias("similarity"))


@query("txt15_16_character_loss")
def txt16(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", tx.character_loss(F.concat_ws(" ", "p_name", "p_type"), F.col("p_name")).alias("loss"))


@query("txt18_bad_chars", r"SELECT doc_id, round(CASE WHEN text = '' THEN 1.0 ELSE length(regexp_replace(text, '[^\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'))::DOUBLE / length(text) END, 9)::DOUBLE AS bad FROM documents")
def txt18(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).select("doc_id", F.round(tx.bad_char_ratio(F.col("text")), 9).alias("bad"))


#: Each document's lines in DuckDB.
LINES_SQL = r"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?])\s+', '\1' || chr(10), 'g'), '[\n\r]+'), lambda s: trim(regexp_replace(s, '\s+', ' ', 'g'))), lambda s: length(s) BETWEEN 8 AND 220) AS l FROM documents"""


@query("txt20_lines", f"WITH p AS ({LINES_SQL}) SELECT doc_id, CAST(len(l) AS INT) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM p")
def txt20(spark: SparkSession, sf: str) -> DataFrame:
    lines = tx.split_lines(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(lines).alias("n_lines"), F.md5(F.array_join(lines, "\n")).alias("lines_md5"))


@query("txt23_windows", """WITH n AS (SELECT doc_id, text, CASE WHEN length(text) <= 700 THEN 1 ELSE CAST(ceil((length(text) - 700) / 620.0) AS INT) + 1 END AS k FROM documents),
w AS (SELECT doc_id, i, substr(text, i * 620 + 1, 700) AS t FROM (SELECT doc_id, text, unnest(range(k)) AS i FROM n))
SELECT doc_id, CAST(i AS INT) AS i, length(t) AS n, md5(t) AS window_md5 FROM w""")
def txt23(spark: SparkSession, sf: str) -> DataFrame:
    d = docs(spark, sf).select("doc_id", F.posexplode(tx.windows(F.col("text"), 700, 80)).alias("i", "t"))
    return d.select("doc_id", "i", F.length("t").cast("long").alias("n"), F.md5("t").alias("window_md5"))


@query("txt25_hashes", "SELECT page_id, sha256(html) AS html_sha, sha256('{\"page_id\":' || page_id || ',\"url\":\"' || url || '\"}') AS row_sha FROM pages")
def txt25(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.sha2("html", 256).alias("html_sha"), F.sha2(F.to_json(F.struct("page_id", "url")), 256).alias("row_sha"))


@query("txt26_question_styles", r"""SELECT item_id, regexp_matches(lower(text), '^(is|are|was|were|do|does|did|can|could|has|have)\b') AS yes_no, regexp_matches(lower(text), '\b(summary|summarize|main idea)\b') AS summary FROM benchmark""")
def txt26(spark: SparkSession, sf: str) -> DataFrame:
    t = F.lower("text")
    return table(spark, sf, "benchmark").select("item_id", t.rlike(r"^(is|are|was|were|do|does|did|can|could|has|have)\b").alias("yes_no"), t.rlike(r"\b(summary|summarize|main idea)\b").alias("summary"))


@query("txt29_casts", """SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE CAST(value AS VARCHAR) END AS DOUBLE) AS v FROM events""")
def txt29(spark: SparkSession, sf: str) -> DataFrame:
    cell = F.when(F.col("event_id") % 5 == 0, "NaN").when(F.col("event_id") % 5 == 1, " ").otherwise(F.col("value").cast("string"))
    return table(spark, sf, "events").select("event_id", tx.to_number(cell).alias("v"))


@query("stat01_pearson", """SELECT l_returnflag AS g, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def stat01(spark: SparkSession, sf: str) -> DataFrame:
    return stats.pearson(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_quantity", "l_extendedprice", ["g"]).select("g", "n", F.round("r", 6).alias("r"))


@query("stat02_spearman", """WITH r AS (SELECT event_type AS g, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0::DOUBLE AS rx,
 rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS ry FROM events)
SELECT g, count(*) AS n, round(corr(rx, ry), 6) AS r FROM r GROUP BY g""")
def stat02(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumnRenamed("event_type", "g")
    return stats.spearman(e, "user_id", "value", ["g"]).select("g", "n", F.round("r", 6).alias("r"))


@query("stat04_r2", """SELECT o_orderstatus AS g, count(*) AS n, round(regr_r2(o_totalprice, o_custkey::DOUBLE), 6) AS r2 FROM orders GROUP BY 1""")
def stat04(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "g")
    return stats.r_squared(o, "o_custkey", "o_totalprice", ["g"]).select("g", "n", F.round("r2", 6).alias("r2"))


@query("win01_average_rank", "SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0::DOUBLE AS rk FROM part")
def win01(spark: SparkSession, sf: str) -> DataFrame:
    return stats.average_rank(table(spark, sf, "part"), "p_size", [], "rk").select("p_partkey", "rk")


@query("agg21_summary", """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS median, min(value) AS lo, max(value) AS hi, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1""")
def agg21(spark: SparkSession, sf: str) -> DataFrame:
    s = stats.summary(table(spark, sf, "events"), "value", ["event_type"])
    return s.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"), "lo", "hi", F.round("std", 6).alias("std"))


@query("agg26_upper_median", "WITH r AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT l_orderkey % 7 AS g, n, row_number() OVER (PARTITION BY l_orderkey % 7 ORDER BY n) AS i, count(*) OVER (PARTITION BY l_orderkey % 7) AS c FROM r) SELECT g, n AS upper_median FROM s WHERE i = c // 2 + 1")
def agg26(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).select((F.col("l_orderkey") % 7).alias("g"), "n")
    return stats.upper_median(n, "n", ["g"])


@query("agg23_mean_of_ratios", "SELECT l_returnflag AS g, round(avg(CASE WHEN l_quantity > 0 THEN l_extendedprice / l_quantity END), 4) AS efficiency FROM lineitem GROUP BY 1")
def agg23(spark: SparkSession, sf: str) -> DataFrame:
    m = stats.mean_of_ratios(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "g"), "l_extendedprice", "l_quantity", ["g"])
    return m.select("g", F.round("efficiency", 4).alias("efficiency"))


@query("agg28_value_counts", "SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2")
def agg28(spark: SparkSession, sf: str) -> DataFrame:
    return stats.value_counts(docs(spark, sf), ["lang", "source"])


@query("agg28_missing", "SELECT 'lang' AS field, count(*) FILTER (lang IS NULL OR lower(trim(lang)) IN ('', 'unknown')) AS missing FROM documents UNION ALL SELECT 'text', count(*) FILTER (text IS NULL OR lower(trim(text)) IN ('', 'unknown')) FROM documents")
def agg28_missing(spark: SparkSession, sf: str) -> DataFrame:
    return stats.missing_counts(docs(spark, sf), ["lang", "text"])


@query("agg31_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def agg31(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("agg32_grouping_sets", "SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY GROUPING SETS ((lang, source), (lang), ())")
def agg32(spark: SparkSession, sf: str) -> DataFrame:
    return docs(spark, sf).groupingSets([["lang", "source"], ["lang"], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("win13_random_sample", "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100")
def win13(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.random_sample(docs(spark, sf).select("doc_id", "source"), "doc_id", 100, "42")


_SHARES = {"en": 0.145, "de": 0.464, "fr": 0.391}
_Q = sampling.quotas(100, _SHARES)


@query("win14_stratified_sample", f"""WITH h AS (SELECT doc_id, lang, md5('42:' || doc_id) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) <= CASE lang {' '.join(f"WHEN '{k}' THEN {v}" for k, v in _Q.items())} ELSE 0 END AS i FROM h)
SELECT doc_id, lang FROM r ORDER BY i DESC, h, doc_id LIMIT 100""")
def win14(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_sample(docs(spark, sf).select("doc_id", "lang"), "doc_id", "lang", 100, _SHARES, "42")




@query("win15_level_sample", """WITH n AS (SELECT l_orderkey AS page_id, count(*) AS n FROM lineitem GROUP BY 1),
c AS (SELECT l_orderkey AS page_id, l_returnflag AS t, count(*)::DOUBLE AS k FROM lineitem GROUP BY ALL), p AS (SELECT page_id, k / sum(k) OVER (PARTITION BY page_id) AS p FROM c), e AS (SELECT page_id, sum(-p * log2(p)) AS h FROM p GROUP BY 1),
l AS (SELECT page_id, CASE WHEN n <= 8 AND h < 1.5 THEN 'simple' WHEN n > 18 OR h >= 2.5 THEN 'complex' ELSE 'medium' END AS level FROM n JOIN e USING (page_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY level ORDER BY md5('42:' || page_id), page_id) AS r FROM l)
SELECT page_id, level FROM r WHERE r <= CASE level WHEN 'simple' THEN 60 WHEN 'medium' THEN 80 ELSE 60 END""")
def win15(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.masks import layout_entropy

    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.col("l_returnflag").alias("category"))
    pages = line.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).join(layout_entropy(line, ["page_id"], by_area=False), "page_id")
    pages = pages.select("page_id", sampling.complexity(F.col("n"), F.col("entropy")).alias("level"))
    return sampling.level_sample(pages, "page_id", "level", 200, {"simple": 0.3, "medium": 0.4, "complex": 0.3}, "42")


@query("win03_first_n", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def win03(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.first_per_group(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 4)


@query("win04_diverse_first", """WITH k AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) > 1 AS rest FROM conversations)
SELECT conv_id, turn, role FROM k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY rest, turn) <= 4""")
def win04(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.diverse_first(table(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "role", "turn", 4)


@query("src22_last_wins", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def src22(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.last_per_key(table(spark, sf, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("set07_dedupe_candidates", """WITH e AS (SELECT *, user_id * 7 % 50 AS path FROM events WHERE NOT (event_type = 'error')), a AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1)
SELECT event_id, user_id, path FROM a QUALIFY row_number() OVER (PARTITION BY path ORDER BY event_id) = 1""")
def set07(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("path", F.col("user_id") * 7 % 50)
    return sampling.dedupe_candidates(e, "user_id", "path", "event_id", F.when(F.col("event_type") == "error", "error")).select("event_id", "user_id", "path")


_A, _B = "SELECT doc_id FROM labels WHERE quality = 1", "SELECT doc_id FROM documents WHERE lang = 'en'"


@query("set02_union_intersect_except", f"""SELECT 'union' AS op, count(*) AS n FROM ({_A} UNION {_B}) UNION ALL SELECT 'intersect', count(*) FROM ({_A} INTERSECT {_B})
UNION ALL SELECT 'except', count(*) FROM ({_A} EXCEPT {_B}) UNION ALL SELECT 'union_all', count(*) FROM ({_A} UNION ALL {_B})""")
def set02(spark: SparkSession, sf: str) -> DataFrame:
    a, b = table(spark, sf, "labels").filter("quality = 1").select("doc_id"), docs(spark, sf).filter("lang = 'en'").select("doc_id")
    made = {"union": a.unionByName(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.unionByName(b)}
    out = None
    for name, df in made.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("set05_subset", f"SELECT count(*) = 0 AS is_subset FROM ({_A} EXCEPT SELECT doc_id FROM documents)")
def set05(spark: SparkSession, sf: str) -> DataFrame:
    extra = table(spark, sf, "labels").filter("quality = 1").join(docs(spark, sf).select("doc_id"), "doc_id", "left_anti")
    return extra.agg((F.count(F.lit(1)) == 0).alias("is_subset"))


@query("set06_multiset", f"""WITH {_PAIRS}, bag AS (SELECT t, sum(l) AS na, sum(r) AS nb FROM (SELECT unnest(a) AS t, 1 AS l, 0 AS r FROM pt UNION ALL SELECT unnest(b), 0, 1 FROM pt) GROUP BY ALL)
SELECT CAST(sum(least(na, nb)) AS BIGINT) AS shared FROM bag""")
def set06(spark: SparkSession, sf: str) -> DataFrame:
    d = turn_pairs(spark, sf)
    side = lambda c, l, r: d.select(F.explode(tx.tokens(F.col(c))).alias("t"), F.lit(l).alias("l"), F.lit(r).alias("r"))  # noqa: E731, E741
    bag = side("p", 1, 0).unionByName(side("g", 0, 1)).groupBy("t").agg(F.sum("l").alias("na"), F.sum("r").alias("nb"))
    return bag.agg(F.sum(F.least("na", "nb")).alias("shared"))
