"""Queries of text mining, threads and vectors."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import documents, threads
from ..sources import tables as T
from .registry import query

TOK = X.SQL_TOKENS.format(T.WORDING)
_DOCS = {"d": f"SELECT symbol, id, {TOK} AS t FROM news", "c": "SELECT symbol, id, len(t) AS l, unnest(t) AS token FROM d", "k": "SELECT symbol, id, l, token, count(*) AS n FROM c GROUP BY ALL"}
_TFIDF = _DOCS | {"w": """SELECT k.symbol, k.id, k.token, k.n / k.l * ln(1 + x.docs / y.df) AS weight FROM k JOIN (SELECT symbol, count(*) AS docs FROM d GROUP BY symbol) x USING (symbol)
  JOIN (SELECT symbol, token, count(*) AS df FROM k GROUP BY ALL) y USING (symbol, token)"""}
_SIM = _TFIDF | {"u": "SELECT symbol, id, token, weight / sqrt(sum(weight ^ 2) OVER (PARTITION BY symbol, id)) AS w FROM w",
    "s": "SELECT symbol, a, b, sim FROM (SELECT u.symbol, u.id AS a, v.id AS b, sum(u.w * v.w) AS sim FROM u JOIN u v ON u.symbol = v.symbol AND u.token = v.token AND u.id < v.id GROUP BY ALL) WHERE sim > 0.25"}
#: Threads of the sample: judged articles of two neighbouring categories, in two halves.
MEMBERS = "SELECT n.symbol, 'T' || (n.id::INT % 17 // 2) || '-' || (n.id::INT % 2) AS thread, n.id, n.title, n.description, n.published_at, r.decision, r.category FROM news n JOIN relevance r ON n.id = r.article_id AND n.symbol = r.symbol"


def members(spark, sf_dir):
    r = T.relevance(spark, sf_dir).select(F.col("article_id").alias("id"), "symbol", "decision", "category")
    rows = T.news(spark, sf_dir).select("id", "symbol", "title", "description", "published_at").join(r, ["id", "symbol"])
    n = F.col("id").cast("int")
    return rows.withColumn("thread", F.concat(F.lit("T"), F.floor(n % 17 / 2).cast("string"), F.lit("-"), (n % 2).cast("string")))


@query(T.oracle("news", **_DOCS) + "SELECT id, token, n FROM k")
def t1_tokens(spark, sf_dir):
    rows = T.news(spark, sf_dir).select("id", F.explode(X.tokens(T.wording())).alias("token"))
    return rows.groupBy("id", "token").agg(F.count("*").alias("n"))


@query(T.oracle("news", **_DOCS) + "SELECT symbol, token, count(*) AS df, sum(n)::BIGINT AS occurrences FROM k GROUP BY ALL")
def a12_document_frequency(spark, sf_dir):
    rows = T.news(spark, sf_dir).select("symbol", "id", F.explode(X.tokens(T.wording())).alias("token"))
    return rows.groupBy("symbol", "token").agg(F.count_distinct("id").alias("df"), F.count("*").alias("occurrences"))


@query(T.oracle("news", **_TFIDF) + "SELECT symbol, id, token, round_even(weight, 8) AS weight FROM w")
def t2_tfidf(spark, sf_dir):
    return threads.weights(T.news(spark, sf_dir)).withColumn("weight", F.bround("weight", 8))


@query(T.oracle("news", **_SIM) + "SELECT symbol, a, b, round_even(sim, 6) AS similarity FROM s")
def t3_similar(spark, sf_dir):
    return threads.similar_texts(T.news(spark, sf_dir)).withColumn("similarity", F.bround("similarity", 6))


@query("WITH RECURSIVE " + T.oracle("news", **_SIM, p="SELECT symbol, id, row_number() OVER (PARTITION BY symbol ORDER BY published_at DESC, id) AS pos FROM news",
    e="SELECT symbol, a, b FROM s UNION SELECT symbol, b, a FROM s")[5:].rstrip() + """, reach(symbol, id, other) AS (SELECT symbol, id, id FROM p UNION SELECT r.symbol, r.id, e.b FROM reach r JOIN e ON r.symbol = e.symbol AND r.other = e.a)
SELECT r.symbol, r.id, min(p.pos) AS cluster FROM reach r JOIN p ON p.symbol = r.symbol AND p.id = r.other GROUP BY r.symbol, r.id""")
def t4_single_linkage(spark, sf_dir):
    news = T.news(spark, sf_dir)
    return threads.single_linkage(threads.numbered(news.select("symbol", "id", "published_at")), threads.similar_texts(news, forest=True))


@query()
def t5_average_linkage(spark, sf_dir):
    """At a threshold that the sample's vectors reach; merge order has no SQL form."""
    v = T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id")
    docs = threads.newest(T.news(spark, sf_dir).join(v, "id"))
    return threads.average_linkage(docs, 0.2)


@query()
def t5_linkage_log(spark, sf_dir):
    """T5: what average linkage merged, in its order, and the pairs that came nearest to it; merge order has no SQL form."""
    v = T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id")
    return threads.linkage_log(threads.newest(T.news(spark, sf_dir).join(v, "id")), 0.2)


_COS = "list_dot_product(a.vector::DOUBLE[], b.vector::DOUBLE[]) / (sqrt(list_dot_product(a.vector::DOUBLE[], a.vector::DOUBLE[])) * sqrt(list_dot_product(b.vector::DOUBLE[], b.vector::DOUBLE[])))"


@query(T.oracle("vectors", c=f"SELECT a.article_id AS q, b.article_id AS id, {_COS} AS sim FROM vectors a JOIN vectors b ON a.article_id <> b.article_id WHERE a.article_id::INT % 100 = 0") + """
SELECT q, id, round_even(sim, 6) AS similarity, row_number() OVER (PARTITION BY q ORDER BY sim DESC, id) AS rank FROM c WHERE sim >= 0.2 QUALIFY rank <= 10""")
def t6_nearest_vectors(spark, sf_dir):
    """The ten nearest vectors of every hundredth one."""
    v = T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id")
    out = threads.nearest(v.where(F.col("id").cast("int") % 100 == 0).select(F.col("id").alias("q"), "vector"), v, 10, 0.2)
    return out.withColumn("similarity", F.bround("similarity", 6))


@query(T.oracle("news", "relevance", m=MEMBERS, v="SELECT symbol, thread, category, count(*) AS n, max(published_at) AS p FROM m WHERE decision = 'RELEVANT' GROUP BY ALL") + """SELECT m.symbol, m.thread, count(*) AS n_articles, min(published_at) AS span_start, max(published_at) AS span_end,
  max({'n': length(title), 'k': -(id::BIGINT), 't': title}).t AS representative_title, round_even(avg(CASE WHEN decision <> 'UNCERTAIN' THEN (decision = 'RELEVANT')::INT END), 4) AS relevance_rate,
  (SELECT max({'n': v.n, 'p': v.p, 'c': v.category}).c FROM v WHERE v.symbol = m.symbol AND v.thread = m.thread) AS top_category FROM m GROUP BY m.symbol, m.thread""")
def a13_thread_attributes(spark, sf_dir):
    """Of categories with as many votes the one seen first, from the newest article on."""
    return threads.attributes(members(spark, sf_dir))


@query(T.oracle("news", "relevance", m=MEMBERS, c=f"SELECT symbol, thread, unnest({TOK}) AS term FROM m") + "SELECT symbol, thread, term, count(*) AS n, row_number() OVER (PARTITION BY symbol, thread ORDER BY count(*) DESC, term) AS rank FROM c GROUP BY symbol, thread, term QUALIFY rank <= 3")
def a22_top_terms(spark, sf_dir):
    """A22, T7."""
    return threads.top_terms(members(spark, sf_dir))


@query(T.oracle("news", "relevance", **_TFIDF, m=MEMBERS, s="SELECT m.symbol, m.thread, w.token AS term, sum(weight) AS weight FROM m JOIN w ON m.symbol = w.symbol AND m.id = w.id GROUP BY ALL") + "SELECT symbol, thread, term, round_even(weight, 6) AS weight, row_number() OVER (PARTITION BY symbol, thread ORDER BY round_even(weight, 9) DESC, term) AS rank FROM s QUALIFY rank <= 3")
def t7_weighted_labels(spark, sf_dir):
    """Labels by summed TF-IDF weights."""
    return threads.weighted_terms(members(spark, sf_dir), T.news(spark, sf_dir)).withColumn("weight", F.bround("weight", 6))


@query(T.oracle("news", "relevance", "vectors", m=MEMBERS, x="SELECT symbol, thread, id, vector FROM m JOIN vectors ON article_id = id") + f"""
SELECT symbol, thread, n, round_even(c, 3) AS cohesion FROM (SELECT symbol, thread, count(*) AS n FROM x GROUP BY ALL) LEFT JOIN (SELECT a.symbol, a.thread, avg({_COS}) AS c FROM x a JOIN x b ON a.symbol = b.symbol AND a.thread = b.thread AND a.id < b.id GROUP BY ALL) USING (symbol, thread)""")
def a21_cohesion(spark, sf_dir):
    return threads.cohesion(members(spark, sf_dir), T.vectors(spark, sf_dir))


@query(T.oracle("news", "relevance", "vectors", m=MEMBERS, x="SELECT symbol, thread, unnest(range(len(vector))) AS dim, unnest(vector)::DOUBLE AS v FROM m JOIN vectors ON article_id = id", y="SELECT symbol, thread, dim, avg(v) AS m FROM x GROUP BY ALL") + "SELECT symbol, thread, dim::INT AS dim, round_even(m / sqrt(sum(m ^ 2) OVER (PARTITION BY symbol, thread)), 6) AS value FROM y")
def a19_mean_pool(spark, sf_dir):
    return threads.mean_pool(members(spark, sf_dir), T.vectors(spark, sf_dir)).withColumn("value", F.bround("value", 6))


#: Best cosine from which threads of two symbols are told, in the sample, whose vectors are further apart than real ones (the feature's own is 0.70).
ACROSS = 0.1
_TERMS = {
    "c": f"SELECT symbol, thread, unnest({TOK}) AS term FROM m",
    "t": "SELECT symbol, thread, list(term ORDER BY rank) AS terms FROM (SELECT symbol, thread, term, row_number() OVER (PARTITION BY symbol, thread ORDER BY count(*) DESC, term) AS rank FROM c GROUP BY symbol, thread, term QUALIFY rank <= 6) GROUP BY ALL",
}


def label_terms(spark, sf_dir):
    """symbol, thread, terms: the six label terms of each thread in their order."""
    top = threads.top_terms(members(spark, sf_dir), 6)
    return top.groupBy("symbol", "thread").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))


@query(T.oracle("news", "relevance", "vectors", m=MEMBERS, **_TERMS, x="SELECT symbol, thread, id, vector FROM m JOIN vectors ON article_id = id WHERE symbol IN ('Brand#2', 'Brand#7')",
    p=f"SELECT a.thread AS thread_a, b.thread AS thread_b, count(*) AS pairs, max({_COS}) AS best, avg({_COS}) AS mean FROM x a JOIN x b ON a.symbol = 'Brand#2' AND b.symbol = 'Brand#7' AND a.id <> b.id GROUP BY ALL") + f"""
SELECT thread_a, thread_b, pairs, round_even(best, 3) AS similarity, round_even(mean, 3) AS mean, coalesce(array_to_string(list_filter(ta.terms, lambda t: list_contains(tb.terms, t)), ','), '') AS shared, (SELECT count(*) FROM p WHERE best >= 0.999) AS duplicates
FROM p LEFT JOIN t ta ON ta.symbol = 'Brand#2' AND ta.thread = thread_a LEFT JOIN t tb ON tb.symbol = 'Brand#7' AND tb.thread = thread_b WHERE best >= {ACROSS} AND best < 0.999 QUALIFY row_number() OVER (ORDER BY round_even(best, 3) DESC, thread_a, thread_b) <= 10""")
def j17_threads_across(spark, sf_dir):
    """The ten nearest pairs of threads of two asked symbols, with their shared terms; the same content twice is counted."""
    x = members(spark, sf_dir).join(T.vectors(spark, sf_dir).withColumnRenamed("article_id", "id"), "id")
    return documents.threads_across(x, label_terms(spark, sf_dir), "Brand#2", "Brand#7", ACROSS)


@query(T.oracle("news", "relevance", m=MEMBERS, **_TERMS) + """
SELECT a.thread AS thread_a, b.thread AS thread_b, array_to_string(list_filter(a.terms, lambda x: list_contains(b.terms, x)), ',') AS shared FROM t a JOIN t b ON a.symbol = 'Brand#2' AND b.symbol = 'Brand#7' WHERE len(list_intersect(a.terms, b.terms)) >= 1""")
def l9_shared_terms(spark, sf_dir):
    """The label terms that threads of two asked symbols share, in the first one's order (joined by term)."""
    t = label_terms(spark, sf_dir).select("symbol", "thread", F.posexplode("terms").alias("rank", "term"))
    a = t.where("symbol = 'Brand#2'").select(F.col("thread").alias("thread_a"), "rank", "term")
    b = t.where("symbol = 'Brand#7'").select(F.col("thread").alias("thread_b"), "term")
    both = a.join(b, "term").groupBy("thread_a", "thread_b").agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("_x"))  # six terms at most
    return both.select("thread_a", "thread_b", F.array_join(F.transform(F.slice("_x", 1, 6), lambda x: x["term"]), ",").alias("shared"))


#: Symbols of one comparison.
COMPARED = ("Brand#2", "Brand#7", "Brand#11", "Brand#13")


@query()
def j23_shared_groups(spark, sf_dir):
    """Threads of the compared symbols, grouped greedily by two common label terms; the order decides, so there is no SQL."""
    t = label_terms(spark, sf_dir).where(F.col("symbol").isin(*COMPARED))
    pick = F.array_position(F.array(*[F.lit(s) for s in COMPARED]), F.col("symbol"))
    return documents.shared_groups(t.select(F.lit("compare").alias("request"), F.concat(pick.cast("string"), F.lit(" "), "thread").alias("place"), "symbol", "thread", "terms"))


_GROUND = ["thing", "thand", "tion"]


@query(T.oracle("news", f=f"SELECT *, list_position({list(COMPARED)}, symbol) AS p FROM news WHERE symbol IN {COMPARED} AND len(list_intersect({TOK}, {_GROUND})) >= 2 QUALIFY row_number() OVER (ORDER BY p, published_at DESC, id) <= 8",
    u="SELECT *, row_number() OVER w AS position, sum(length('[' || symbol || '] ' || title) + 1 + length(coalesce(description, ''))) OVER w AS used FROM f WINDOW w AS (ORDER BY p, published_at DESC, id)") + "SELECT position, symbol, id, used::BIGINT AS used, '[' || symbol || '] ' || title AS heading, substr(coalesce(description, ''), 1, 1500) AS body FROM u WHERE used <= 60000")
def t9_grounding(spark, sf_dir):
    """What a brief of a shared thread is grounded on; eight articles and 60,000 characters are the feature's limits."""
    return documents.grounding(T.news(spark, sf_dir), list(COMPARED), _GROUND)


@query(T.oracle("relevance") + "SELECT symbol, count(*) FILTER (decision IN ('RELEVANT', 'USER_APPROVED')) AS relevant, count(*) FILTER (decision IN ('RELEVANT', 'USER_APPROVED')) < 5 AS expands FROM relevance GROUP BY symbol")
def t18_expansion_trigger(spark, sf_dir):
    """Whether a symbol's articles ask for a search by keyword variations."""
    return documents.expands(T.relevance(spark, sf_dir), "gdelt")


@query("""WITH c AS (SELECT doc_id, unnest(range(greatest(ceil(length(coalesce(text, '')) / 1000), 1)::INT)) AS k, coalesce(text, '') AS t FROM documents), p AS (SELECT doc_id, substr(t, k * 1000 + 1, 1000) AS c FROM c),
v AS (SELECT doc_id, unnest([0, 1, 2, 3]) AS dim, unnest([length(c), length(regexp_replace(c, '[^e]', '', 'g')), length(regexp_replace(c, '[^ ]', '', 'g')), length(regexp_replace(c, '[^0-9]', '', 'g'))]) AS x FROM p)
SELECT doc_id, dim, round_even(avg(x), 9) AS value FROM v GROUP BY doc_id, dim""")
def a20_chunk_pooling(spark, sf_dir):
    """Whole texts as the mean of their chunks' vectors (counts of characters stand in for a model)."""
    count = lambda c, one: F.length(c) - F.length(F.replace(c, F.lit(one), F.lit("")))
    embed = lambda c: F.array(*[x.cast("double") for x in (F.length(c), count(c, "e"), count(c, " "), F.regexp_count(c, F.lit("[0-9]")))])
    out = documents.pooled(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", embed)
    return out.select("doc_id", F.posexplode("vector").alias("dim", "value")).withColumn("value", F.bround("value", 9))


@query(T.oracle("news", "relevance", m=MEMBERS) + "SELECT symbol, thread, min(published_at)::DATE AS first_day, max(published_at)::DATE AS last_day, string_agg(id || '=' || published_at::DATE, ',' ORDER BY id) AS dates FROM m GROUP BY symbol, thread")
def a15_article_dates(spark, sf_dir):
    """Span of a thread, and the day of each of its articles by id."""
    out = threads.article_dates(members(spark, sf_dir))
    days = F.map_values("dates")
    told = F.array_join(F.transform(F.map_entries("dates"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("symbol", "thread", F.array_min(days).alias("first_day"), F.array_max(days).alias("last_day"), told.alias("dates"))


@query(T.oracle(b=f"SELECT item_id, len(list_distinct(list_intersect({X.SQL_TOKENS.format('text')}, ['thing', 'tion', 'ently', 'onen', 'thand', 'edou', 'hathe', 'inged']))) AS score FROM benchmark") + "SELECT item_id, score, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM b WHERE score > 0 QUALIFY rank <= 3")
def t8_section_retrieval(spark, sf_dir):
    """The three sections that share most tokens with a question."""
    question = F.lit("thing tion ently onen thand edou hathe inged the of")
    rows = T.table(spark, sf_dir, "benchmark").withColumn("score", F.size(F.array_intersect(X.tokens(F.col("text")), X.tokens(question)))).where("score > 0")
    best = rows.select("item_id", "score").orderBy(F.col("score").desc(), "item_id").limit(3)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), "item_id")))  # three rows


_CLEAN = "coalesce(html, '')"
for _hidden in ("(?is)<ix:header.*?</ix:header>", "(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", "(?is)<!--.*?-->", "<[^>]+>"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_hidden}', ' ', 'g')"
for _name, _char in (("nbsp", "chr(160)"), ("lt", "'<'"), ("gt", "'>'"), ("quot", "chr(34)"), ("#39", "chr(39)"), ("copy", "chr(169)"), ("middot", "chr(183)"), ("amp", "'&'")):
    _CLEAN = f"replace({_CLEAN}, '&{_name};', {_char})"
_STRIP = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_CLEAN}, '[ \t\xA0]+', ' ', 'g'), ' ?\n ?', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\xA0]+|[\s\xA0]+$', '', 'g')"


@query(f"SELECT page_id, {_STRIP} AS text FROM pages")
def t16_html_strip(spark, sf_dir):
    return T.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))


@query(f"WITH t AS (SELECT page_id, {_STRIP} AS text FROM pages) SELECT page_id, ceil(length(text) / 3000)::BIGINT AS pages, len(regexp_extract_all(lower(text), '\\bthe\\b'))::BIGINT AS hits FROM t")
def t14_term_frequency(spark, sf_dir):
    """Pages of a text, and whole-word hits of a term."""
    t = T.table(spark, sf_dir, "pages").select("page_id", X.strip_html(F.col("html")).alias("text"))
    return t.select("page_id", F.ceil(F.length("text") / 3000).cast("long").alias("pages"), F.regexp_count(F.lower("text"), F.lit(X.EDGE + "the" + X.EDGE)).cast("long").alias("hits"))


_HEAD = r"(?im)^[^\S\n]{0,8}ITEM\s+(\d+[A-Z]?)\.?\s*([^\n]{0,120})"
_PLANTED = "CASE WHEN doc_id % 5 = 0 THEN text ELSE 'Item 1. Business' || chr(10) || coalesce(text, '') || chr(10) || 'Item 1A. Risk Factors' || chr(10) || 'more' END"


@query(f"""WITH d AS (SELECT doc_id, {_PLANTED} AS text FROM documents), p AS (SELECT doc_id, text, string_split(regexp_replace(text, '{_HEAD.replace("(?im)", "(?im)(")})', chr(57344) || '\\1', 'g'), chr(57344)) AS parts FROM d WHERE trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) <> ''),
e AS (SELECT doc_id, unnest(parts[2:]) AS x, generate_subscripts(parts[2:], 1) - 1 AS n FROM p WHERE len(parts) > 1)
SELECT doc_id, n::INT AS n, 'ITEM ' || upper(regexp_extract(x, '{_HEAD}', 1)) || CASE WHEN trim(regexp_extract(x, '{_HEAD}', 2)) <> '' THEN ' — ' || trim(regexp_extract(x, '{_HEAD}', 2)) ELSE '' END AS heading, regexp_replace(x, '^\\s+|\\s+$', '', 'g') AS body FROM e
UNION ALL SELECT doc_id, 0, 'FULL TEXT', text FROM p WHERE len(parts) = 1""")
def t12_sections(spark, sf_dir):
    """Spans between item headings of a text, or the full text; headings are planted into four of five documents."""
    planted = F.concat(F.lit("Item 1. Business\n"), F.coalesce("text", F.lit("")), F.lit("\nItem 1A. Risk Factors\nmore"))
    d = T.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(planted).alias("text"))
    return documents.sections(d, "doc_id", "text")


@query()
def t13_sentences(spark, sf_dir):
    """Sentences of 40 to 800 characters; the pattern looks around, which the SQL engine's patterns can't."""
    d = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    return documents.sentences(d, "doc_id", "text")


@query()
def t15_extractive_pick(spark, sf_dir):
    """The sentences with most hits of a term, in the document's order."""
    return documents.extractive(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ("the", "and"), 5)


@query()
def t15_size_ladder(spark, sf_dir):
    """What of a text is read on by its pages; the steps are lower than the feature's own, so that the sample's texts reach them."""
    return documents.sized(T.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", ("the", "and", "tion"), full=2, by_section=8, budget=40_000, most=12)


@query()
def t10_batches(spark, sf_dir):
    """Turns of a conversation in batches of a character budget, numbered over the batches."""
    c = T.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return documents.batches(c, "conv_id", "turn", "text", 1200)


@query(T.oracle("news", "relevance", e="SELECT unnest(['than', 'thing', 'erent', 'oui']) AS variation") + """SELECT e.variation, count(*) AS hits, count(*) FILTER (r.article_id IS NULL) AS candidates FROM e JOIN news n ON contains(lower(concat_ws(' ', n.title, n.description)), e.variation)
  LEFT JOIN (SELECT DISTINCT article_id FROM relevance) r ON r.article_id = n.id GROUP BY e.variation""")
def t17_query_expansion(spark, sf_dir):
    """Articles that the keyword variations find, and those without a verdict yet."""
    return documents.expansion(T.news(spark, sf_dir), T.relevance(spark, sf_dir), ["than", "thing", "erent", "oui"])
