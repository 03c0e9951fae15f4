"""Queries over descriptions, tags and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions import text as X
from tessella.functions import vector as V
from tessella.operators import descriptions as D
from tessella.operators import tfidf
from tessella.plans.tables import table
from tessella.plans.vectors import rounded


def described(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as descriptions: words of the name are adjectives; type and brand are tags, weighted by the size."""
    p = table(spark, sf, "part")
    tags = F.create_map(F.lower("p_type"), F.col("p_size") / 50.0, F.lower("p_brand"), F.lit(0.25))
    return p.select(F.col("p_partkey").alias("key"), F.split("p_name", " ").alias("adjectives"), tags.alias("tags"), F.col("p_name").alias("plain_text"))


def _brands(spark: SparkSession, sf: str) -> DataFrame:
    """Brands as descriptions: each word of their parts' names, weighted by its share."""
    p = table(spark, sf, "part")
    n = p.groupBy("p_brand").agg(F.count("*").alias("n"))
    words = p.select("p_brand", F.explode(F.split("p_name", " ")).alias("tag")).groupBy("p_brand", "tag").agg(F.count("*").alias("c")).join(n, "p_brand")
    return words.groupBy(F.col("p_brand").alias("key")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("tag", (F.col("c") / F.col("n")).alias("w"))))).alias("tags"))


def tag_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return D.vocabulary(described(spark, sf), 10)


def sorted_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return D.vocabulary(described(spark, sf), 1).select("tag").distinct().withColumn("place", F.row_number().over(W.orderBy("tag")))


def pos_weight(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf)
    return rounded(D.positive_weights(d, D.vocabulary(d, 10)))


def multi_hot(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf)
    vocab = D.vocabulary(d, 10).agg(F.transform(F.array_sort(F.collect_list(F.struct("tag_idx", "tag"))), lambda x: x["tag"]).alias("vocab"))
    hot = d.crossJoin(F.broadcast(vocab)).select("key", V.multi_hot(D.tag_list(), "vocab").alias("hot"))  # one row
    return hot.select("key", F.array_join(F.col("hot").cast("array<string>"), "").alias("hot"), F.aggregate("hot", F.lit(0), lambda a, x: a + x).alias("n"))


def strong_weak_tags(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf)
    part = lambda f: F.array_join(F.array_sort(F.map_keys(F.map_filter("tags", f))), ",")
    return d.select("key", part(lambda k, w: w > 0.3).alias("strong"), part(lambda k, w: w <= 0.3).alias("weak"))


def tag_map_ops(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf)
    low = F.array_min(F.map_values("tags"))
    high = F.array_max(F.map_values("tags"))
    jaccard = V.weighted_jaccard("tags", F.create_map(F.lit("large"), F.lit(0.5), F.lit("small"), F.lit(0.1)))
    return rounded(d.select("key", F.size("tags").alias("n"), low.alias("low"), high.alias("high"), F.coalesce(F.try_element_at("tags", F.lit("large")), F.lit(-1.0)).alias("large"), jaccard.alias("jaccard")))


def weighted_jaccard_top4(spark: SparkSession, sf: str) -> DataFrame:
    return D.similar(_brands(spark, sf), 4).select("key", "other", F.round("sim", 6).alias("sim"), "rank")


def tag_union_size(spark: SparkSession, sf: str) -> DataFrame:
    return described(spark, sf).select("key", F.size(F.array_union("adjectives", F.map_keys("tags"))).alias("n"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("name"))


def _keys(spark: SparkSession, sf: str) -> DataFrame:
    """Some first words, some full names."""
    p = table(spark, sf, "part")
    return p.where("p_size > 25").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("key")).union(p.where("p_size > 48").select("p_name")).where("key NOT LIKE 'r%'").distinct()


def longest_prefix_join(spark: SparkSession, sf: str) -> DataFrame:
    return D.longest_prefix(_names(spark, sf), _keys(spark, sf)).select("p_partkey", "name", "key")


def described_share(spark: SparkSession, sf: str) -> DataFrame:
    found = D.longest_prefix(_names(spark, sf), _keys(spark, sf))
    return rounded(found.agg(F.avg(F.col("key").isNotNull().cast("double")).alias("share")))


def described_only(spark: SparkSession, sf: str) -> DataFrame:
    return D.longest_prefix(_names(spark, sf), _keys(spark, sf)).where("key IS NOT NULL").select("p_partkey", "name", "key")


def generic_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier-made names, some with a generic prefix in front."""
    p = table(spark, sf, "part")
    named = p.select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, (*[g.title() for g in D.GENERIC], ""))), (F.col("p_partkey") % 7 + 1).cast("int")), F.lit(" "), F.col("p_name")).alias("name"))
    return named.where(~F.lower("name").rlike("^(" + "|".join(D.GENERIC) + ")"))


def override_union(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    first = p.select(F.col("p_name").alias("key"), F.col("p_brand").alias("value"), F.col("p_partkey").alias("seq"))
    second = first.where("seq % 3 = 0").withColumn("value", F.concat(F.lit("second "), "value"))
    last = lambda df: D.last_wins(df, ["key"], "seq")
    return D.override_union([last(first), last(second)])


def tag_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    d = p.groupBy(F.col("p_name").alias("key")).agg(F.create_map(F.lit("own"), F.lit(1.0)).alias("tags"))
    fam = p.where("p_size > 40").select(F.col("p_name").alias("family"), F.col("p_type").alias("tag"), (F.col("p_size") / 100.0).alias("weight"), F.col("p_partkey").alias("seq"))
    merged = D.merge_tags(d, fam)
    return rounded(merged.select("key", F.explode("tags").alias("tag", "weight")))


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    """A query text for each part, with negations, stop words and punctuation."""
    p = table(spark, sf, "part")
    w = lambda k: F.split_part("p_name", F.lit(" "), F.lit(k))
    text = F.concat(F.lit("not very "), w(1), F.lit(", the "), w(2), F.lit("s without; "), F.lower("p_type"), F.lit(" less of "), F.lower(F.replace("p_brand", F.lit("#"))))
    return p.select(F.col("p_partkey").alias("id"), text.alias("text"))


def negation_scope_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return D.signed_terms(D.tokens(_queries(spark, sf)))


def _weights(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    words = p.select(F.explode(F.split("p_name", " ")).alias("tag")).union(p.select(F.lower("p_type"))).distinct()
    vocab = words.select((F.row_number().over(W.orderBy("tag")) - 1).alias("tag_idx"), "tag")
    return D.query_weights(D.signed_terms(D.tokens(_queries(spark, sf))), vocab)


def query_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _weights(spark, sf).select("id", "tag_idx", "tag", F.round("weight", 6).alias("weight"))


def tag_search(spark: SparkSession, sf: str) -> DataFrame:
    fonts = _brands(spark, sf).select(F.col("key").alias("font"), F.explode("tags").alias("tag", "p"))
    return rounded(D.tag_search(fonts, _weights(spark, sf).where("id = 1"), 100))


def tags_for(spark: SparkSession, sf: str) -> DataFrame:
    fonts = _brands(spark, sf).select(F.col("key").alias("font"), F.explode("tags").alias("tag", "p"))
    return rounded(D.tags_for(fonts, F.lit("Brand#2"), 10))


def adjective_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark words; the length of a word stands for its tag."""
    b = table(spark, sf, "benchmark")
    toks = b.select(F.col("item_id").alias("id"), F.posexplode(F.split("text", " ")).alias("pos", "text"))
    return D.adjectives(toks.withColumn("tag", F.when(F.length("text") % 3 == 0, "ADJ").otherwise("NOUN")))


def prompt_text(spark: SparkSession, sf: str) -> DataFrame:
    d = described(spark, sf)
    return d.select("key", X.prompt(F.col("adjectives"), F.col("tags"), F.col("plain_text")).alias("text"))


def contrastive_prompt(spark: SparkSession, sf: str) -> DataFrame:
    """Each brand's prompt with a line for each of the brands most like it."""
    d = _brands(spark, sf)
    strong = F.array_join(F.array_sort(F.map_keys(F.map_filter("tags", lambda k, w: w > 0.15))), ", ")
    lines = D.similar(d, 4).join(d.select(F.col("key").alias("other"), strong.alias("strong")), "other")
    text = lines.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("  - "), "other", F.lit(": "), "strong").alias("line")))), lambda x: x["line"]), "\n").alias("text"))
    return text


def json_query_list(spark: SparkSession, sf: str) -> DataFrame:
    """Model output of several shapes: plain and fenced lists, a list with a number, an object, no JSON."""
    p = table(spark, sf, "part")
    a, fence = F.concat(F.lit('["'), F.replace("p_name", F.lit(" "), F.lit('", "')), F.lit('"]')), "```"
    shapes = F.array(a, F.concat(F.lit(f"{fence}json\n"), a, F.lit(f"\n{fence}")), F.concat(F.lit(f" {fence}\n"), a, F.lit(f"\n{fence} ")), F.lit('["x", 3]'), F.lit('{"a": 1}'), F.col("p_name"))
    out = p.select("p_partkey", X.parsed_list(F.get(shapes, (F.col("p_partkey") % 6).cast("int"))).alias("list"))
    return out.select("p_partkey", F.array_join("list", "|").alias("items"), F.coalesce(F.size("list"), F.lit(-1)).alias("n"))


def description_sample(spark: SparkSession, sf: str) -> DataFrame:
    return D.sampled(described(spark, sf))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct texts under their least id."""
    return table(spark, sf, "documents").groupBy("text").agg(F.min("doc_id").alias("id")).select("id", "text")


def tfidf_similar_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return tfidf.similar_pairs(_texts(spark, sf)).select("i", "j", F.round("sim", 6).alias("sim"))


def tfidf_similar_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents: the class of each, and the pairs of similar classes."""
    return rounded(tfidf.similar_documents(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")))


QUERIES = {
    f.__name__: f
    for f in (
        tag_vocab, sorted_vocab, pos_weight, multi_hot, strong_weak_tags, tag_map_ops, weighted_jaccard_top4, tag_union_size, longest_prefix_join, described_share,
        described_only, generic_filter, override_union, tag_merge, negation_scope_tokens, query_weights, tag_search, tags_for, adjective_state_machine, prompt_text,
        contrastive_prompt, json_query_list, description_sample, tfidf_similar_pairs, tfidf_similar_documents,
    )
}

_D = "d AS (SELECT p_partkey AS key, string_split(p_name, ' ') AS adj, lower(p_type) AS t1, p_size / 50.0::DOUBLE AS w1, lower(p_brand) AS t2, 0.25::DOUBLE AS w2, p_name FROM part)"
_A = "a AS (SELECT key, unnest(list_concat(adj, [t1, t2])) AS tag FROM d)"
_B = "b AS (SELECT p_brand AS key, tag, count(*) / any_value(n) AS w FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS tag, n FROM (SELECT *, count(*) OVER (PARTITION BY p_brand) AS n FROM part)) GROUP BY p_brand, tag)"
_SIM = """s AS (SELECT x.key, y.key AS other, sum(least(x.w, y.w)) AS l FROM b x JOIN b y ON x.tag = y.tag AND x.key <> y.key GROUP BY ALL), tt AS (SELECT key, sum(w) AS t FROM b GROUP BY key),
r AS (SELECT s.key, other, l / (p.t + q.t - l) AS sim FROM s JOIN tt p ON s.key = p.key JOIN tt q ON other = q.key), k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round(sim, 9) DESC, other) AS rank FROM r)"""
_K = "keys AS (SELECT DISTINCT key FROM (SELECT split_part(p_name, ' ', 1) AS key FROM part WHERE p_size > 25 UNION ALL SELECT p_name FROM part WHERE p_size > 48) WHERE key NOT LIKE 'r%')"
_LP = f"WITH {_K}, n AS (SELECT p_partkey, p_name || ' ' || p_brand AS name FROM part), l AS (SELECT p_partkey, name, key FROM n LEFT JOIN keys ON starts_with(name, key) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(key) DESC) = 1)"
_STOP = "(" + ", ".join(f"'{w}'" for w in D.STOP_WORDS) + ")"
_NEG = "(" + ", ".join(f"'{w}'" for w in D.NEGATIONS) + ")"
_T = f"""q AS (SELECT p_partkey AS id, 'not very ' || split_part(p_name, ' ', 1) || ', the ' || split_part(p_name, ' ', 2) || 's without; ' || lower(p_type) || ' less of ' || lower(replace(p_brand, '#', '')) AS text FROM part),
m AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+|[^a-z0-9\\s]') AS ts FROM q), t0 AS (SELECT id, unnest(range(len(ts))) AS pos, unnest(ts) AS text FROM m),
t1 AS (SELECT *, CASE WHEN regexp_matches(text, '^[a-z]{{3,}}[^s]s$') THEN left(text, length(text) - 1) ELSE text END AS lemma, CASE WHEN text IN {_NEG} THEN 1 WHEN text IN {_STOP} THEN NULL ELSE 0 END AS ev FROM t0),
t2 AS (SELECT *, coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1, false) AS negative FROM t1),
terms AS (SELECT id, pos, text, lemma, negative FROM t2 WHERE ev = 0 AND regexp_matches(text, '^[a-z0-9]+$'))"""
_W = f"""{_T}, vocab AS (SELECT tag, row_number() OVER (ORDER BY tag) - 1 AS tag_idx FROM (SELECT DISTINCT unnest(list_append(string_split(p_name, ' '), lower(p_type))) AS tag FROM part)),
hit AS (SELECT id, tag_idx, tag, negative, CASE WHEN lemma = tag THEN 1.0 ELSE 0.5 END AS m FROM terms JOIN vocab ON lemma = tag OR contains(tag, text) OR contains(tag, lemma)),
wt AS (SELECT id, tag_idx, tag, coalesce(max(m) FILTER (NOT negative), 0) - coalesce(max(m) FILTER (negative), 0) AS weight FROM hit GROUP BY ALL)"""

ORACLE = {
    "tag_vocab": f"WITH {_D}, {_A} SELECT tag, count(*) AS n, row_number() OVER (ORDER BY tag) - 1 AS tag_idx FROM a GROUP BY tag HAVING count(*) >= 10",
    "sorted_vocab": f"WITH {_D}, {_A} SELECT tag, row_number() OVER (ORDER BY tag) AS place FROM (SELECT DISTINCT tag FROM a)",
    "pos_weight": f"WITH {_D}, {_A}, v AS (SELECT tag FROM a GROUP BY tag HAVING count(*) >= 10) SELECT tag, round(least(50.0, ((SELECT count(*) FROM part) - count(DISTINCT key)) / greatest(count(DISTINCT key), 1)), 6) AS w FROM v JOIN a USING (tag) GROUP BY tag",
    "multi_hot": f"WITH {_D}, {_A}, v AS (SELECT list(tag ORDER BY tag) AS vs FROM (SELECT tag FROM a GROUP BY tag HAVING count(*) >= 10)), h AS (SELECT key, list_transform(vs, lambda t: CASE WHEN list_contains(list_concat(adj, [t1, t2]), t) THEN 1 ELSE 0 END) AS h FROM d, v) SELECT key, array_to_string(h, '') AS hot, list_sum(h) AS n FROM h",
    "strong_weak_tags": f"WITH {_D}, e AS (SELECT key, unnest([t1, t2]) AS t, unnest([w1, w2]) AS w FROM d) SELECT key, coalesce(string_agg(t, ',' ORDER BY t) FILTER (w > 0.3), '') AS strong, coalesce(string_agg(t, ',' ORDER BY t) FILTER (w <= 0.3), '') AS weak FROM e GROUP BY key",
    "tag_map_ops": f"""WITH {_D}, e AS (SELECT *, CASE WHEN t1 = 'large' THEN w1 ELSE 0 END AS l, CASE WHEN t1 = 'small' THEN w1 ELSE 0 END AS s FROM d)
        SELECT key, 2 AS n, round(least(w1, w2), 6) AS low, round(greatest(w1, w2), 6) AS high, round(CASE WHEN t1 = 'large' THEN w1 ELSE -1 END, 6) AS large,
        round((least(l, 0.5) + least(s, 0.1)) / (greatest(l, 0.5) + greatest(s, 0.1) + w2 + CASE WHEN t1 IN ('large', 'small') THEN 0 ELSE w1 END), 6) AS jaccard FROM e""",
    "weighted_jaccard_top4": f"WITH {_B}, {_SIM} SELECT key, other, round(sim, 6) AS sim, rank FROM k WHERE rank <= 4",
    "tag_union_size": f"WITH {_D} SELECT key, len(list_distinct(list_concat(adj, [t1, t2]))) AS n FROM d",
    "longest_prefix_join": f"{_LP} SELECT * FROM l",
    "described_share": f"{_LP} SELECT round(avg((key IS NOT NULL)::INT), 6) AS share FROM l",
    "described_only": f"{_LP} SELECT * FROM l WHERE key IS NOT NULL",
    "generic_filter": "WITH n AS (SELECT p_partkey, [" + ", ".join(f"'{g.title()}'" for g in (*D.GENERIC, "")) + "][(p_partkey % 7 + 1)::INT] || ' ' || p_name AS name FROM part) SELECT * FROM n WHERE " + " AND ".join(f"NOT starts_with(lower(name), '{g}')" for g in D.GENERIC),
    "override_union": "SELECT key, CASE WHEN s2 IS NOT NULL THEN 'second ' || v2 ELSE v1 END AS value, coalesce(s2, s1) AS seq FROM (SELECT p_name AS key, max(p_partkey) AS s1, max_by(p_brand, p_partkey) AS v1, max(p_partkey) FILTER (p_partkey % 3 = 0) AS s2, max_by(p_brand, p_partkey) FILTER (p_partkey % 3 = 0) AS v2 FROM part GROUP BY p_name)",
    "tag_merge": "WITH f AS (SELECT p_name AS family, p_type AS tag, max_by(p_size / 100.0, p_partkey) AS weight FROM part WHERE p_size > 40 GROUP BY ALL) SELECT family AS key, tag, round(weight, 6) AS weight FROM f UNION ALL SELECT DISTINCT p_name, 'own', 1.0 FROM part WHERE p_name NOT IN (SELECT family FROM f)",
    "negation_scope_tokens": f"WITH {_T} SELECT * FROM terms",
    "query_weights": f"WITH {_W} SELECT id, tag_idx, tag, round(weight, 6) AS weight FROM wt",
    "tag_search": f"WITH {_W}, {_B}, sc AS (SELECT key, sum(w * weight) AS score FROM b JOIN wt ON wt.tag = b.tag AND id = 1 GROUP BY key) SELECT f.key AS font, round(coalesce(score, 0), 6) AS score FROM (SELECT DISTINCT key FROM b) f LEFT JOIN sc USING (key) ORDER BY score DESC, font LIMIT 100",
    "tags_for": f"WITH {_B} SELECT tag, round(w, 6) AS p FROM b WHERE key = 'Brand#2' ORDER BY w DESC, tag DESC LIMIT 10",
    "adjective_state_machine": "WITH s AS (SELECT item_id AS id, string_split(text, ' ') AS ws FROM benchmark), t AS (SELECT id, unnest(range(len(ws))) AS pos, unnest(ws) AS text FROM s), n AS (SELECT *, lead(text) OVER (PARTITION BY id ORDER BY pos) AS nx FROM t) SELECT id, pos, text FROM n WHERE length(text) % 3 = 0 AND length(nx) % 3 <> 0",
    "prompt_text": f"WITH {_D} SELECT key, 'Adjectives: ' || array_to_string(adj, ', ') || CASE WHEN w1 > 0.3 THEN chr(10) || 'Strong style tags: ' || t1 ELSE '' END || chr(10) || 'Possible style tags: ' || CASE WHEN w1 > 0.3 THEN t2 ELSE array_to_string(list_sort([t1, t2]), ', ') END || chr(10) || 'Description: ' || p_name AS text FROM d",
    "contrastive_prompt": f"WITH {_B}, {_SIM}, st AS (SELECT key, coalesce(string_agg(tag, ', ' ORDER BY tag) FILTER (w > 0.15), '') AS strong FROM b GROUP BY key) SELECT k.key, string_agg('  - ' || other || ': ' || strong, chr(10) ORDER BY rank) AS text FROM k JOIN st ON st.key = other WHERE rank <= 4 GROUP BY k.key",
    "json_query_list": "SELECT p_partkey, CASE WHEN p_partkey % 6 < 3 THEN replace(p_name, ' ', '|') END AS items, CASE WHEN p_partkey % 6 < 3 THEN len(string_split(p_name, ' ')) ELSE -1 END AS n FROM part",
    "tfidf_similar_pairs": f"""WITH x AS (SELECT min(doc_id) AS id, text FROM documents GROUP BY text), ws AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda w: w NOT IN {_STOP}) AS w FROM x),
        tm AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM ws), tf AS (SELECT id, term, count(*) AS tf FROM tm GROUP BY ALL),
        st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 50000), rw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM x)) / (1 + df)) + 1) AS w FROM tf JOIN st USING (term)),
        nw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rw)
        SELECT a.id AS i, b.id AS j, round(sum(a.w * b.w), 6) AS sim FROM nw a JOIN nw b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.35""",
    "tfidf_similar_documents": f"""WITH c AS (SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS class, text FROM documents), ws AS (SELECT id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{2,}}'), lambda w: w NOT IN {_STOP}) AS w FROM c),
        tm AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM ws), tf AS (SELECT id, term, count(*) AS tf FROM tm GROUP BY ALL),
        st AS (SELECT term, count(*) AS df, sum(tf) AS cf FROM tf GROUP BY term ORDER BY cf DESC, term LIMIT 50000), rw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN st USING (term)),
        nw AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM rw WHERE id IN (SELECT class FROM c))
        SELECT 'member' AS kind, class AS i, id AS j, NULL::DOUBLE AS sim FROM c
        UNION ALL SELECT 'pair', a.id, b.id, round(sum(a.w * b.w), 6) FROM nw a JOIN nw b ON a.term = b.term AND a.id <= b.id GROUP BY a.id, b.id HAVING sum(a.w * b.w) >= 0.35""",
}
