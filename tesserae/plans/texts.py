"""Text operators over documents and pages: folding, tokens, similarity joins, clusters, search.

Similarity joins never pair all rows: they meet on shared shingles, only the rarest of a set, and verify exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import grams, numeric, text
from tesserae.operators.graph import components
from tesserae.operators.similar import every, forest, senior, similar
from tesserae.sources.scratch import stored
from tesserae.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_NORM = "trim(regexp_replace(lower(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))"
_WORDS = f"string_split({_NORM}, ' ')"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


@query(f"SELECT doc_id, md5({_NORM}) AS folded, length({_NORM}) AS n FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    n = text.normalize_text(F.col("text"))
    return _docs(spark, d).select("doc_id", F.md5(n.cast("binary")).alias("folded"), F.length(n).cast("bigint").alias("n"))


@query(f"SELECT doc_id, len(list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, greatest(len(w) - 1, 2))])) AS shingles FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def shingle_stats(spark: SparkSession, d: str) -> DataFrame:
    w = F.split(text.normalize_text(F.col("text")), " ")
    return _docs(spark, d).select("doc_id", w.alias("w")).select("doc_id", F.size(text.shingles(F.col("w"), 3)).cast("bigint").alias("shingles"))


@query("""SELECT doc_id, list_sort(list_distinct(list_filter([replace(replace(x, '.', ''), ',', '') FOR x IN regexp_extract_all(text, '([0-9][0-9.,]*)', 1)], lambda x: length(x) >= 2 AND NOT regexp_matches(x, '^(19|20)[0-9][0-9]$')))) AS numbers FROM documents""")
def number_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.sort_array(text.number_tokens(F.col("text"))).alias("numbers"))


@query("""SELECT doc_id, regexp_matches(lower(text), '[ăâđêôơưáàảãạấầẩẫậắằẳẵặéèẻẽẹếềểễệíìỉĩịóòỏõọốồổỗộớờởỡợúùủũụứừửữựýỳỷỹỵ]') AS vietnamese, CASE WHEN regexp_matches(lower(text), 'licen[sc]e|copyright|rights reserved') THEN 'legal' WHEN regexp_matches(lower(text), '@|http') THEN 'contact' WHEN regexp_matches(text, '[0-9]{4,}') THEN 'figures' ELSE 'other' END AS domain FROM documents""")
def classify_domain(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    domain = F.when(F.lower(t).rlike("licen[sc]e|copyright|rights reserved"), "legal").when(F.lower(t).rlike("@|http"), "contact").when(t.rlike("[0-9]{4,}"), "figures").otherwise("other")
    return _docs(spark, d).select("doc_id", text.is_vietnamese(t).alias("vietnamese"), domain.alias("domain"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS text FROM pages""")
def html_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.clean_html(F.col("html")).alias("text"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '([?&])((utm_|ref_|mc_)[^=&]*|fbclid|gclid)=[^&]*', '\1', 'g'), '[?]&+', '?', 'g'), '&&+', '&', 'g'), '[?&]+$', ''), '/$', '') AS url,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages""")
def url_canonical(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", text.canonical_url(u).alias("url"), F.regexp_extract(u, "^https?://([^/?#]+)", 1).alias("host"))


@query("""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\\pL\\pN])(the|der|les)([^\\pL\\pN]|$)') AND NOT regexp_matches(lower(text), '(^|[^\\pL\\pN])idiot([^\\pL\\pN]|$)')""")
def keyword_match(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    wanted = text.has_word(t, "the") | text.has_word(t, "der") | text.has_word(t, "les")
    return _docs(spark, d).filter(wanted & ~text.has_word(t, "idiot")).select("doc_id")


@query("SELECT doc_id, substr(sha256(doc_id || chr(10) || lower(text)), 1, 32) AS hash FROM documents")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.substring(F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), F.lower("text")), 256), 1, 32).alias("hash"))


@query(f"""WITH k AS (SELECT doc_id, source, lang, {_NORM} AS key FROM documents), r AS (SELECT *, min(doc_id) OVER (PARTITION BY key) AS lead, count(*) OVER (PARTITION BY key) AS n FROM k)
  SELECT lead AS doc_id, count(*) AS copies, list_sort(list(DISTINCT source)) AS sources FROM r GROUP BY lead""")
def dedupe_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """By raw text first (cheap, partial aggregates), then by normalised text of what is left; appearances are merged."""
    raw = _docs(spark, d).groupBy(F.sha2("text", 256).alias("h")).agg(F.min(F.struct("doc_id", "text")).alias("m"), F.count("*").alias("c"), F.collect_set("source").alias("s"))
    key = F.sha2(text.normalize_text(F.col("m.text")), 256)
    out = raw.groupBy(key.alias("k")).agg(F.min("m.doc_id").alias("doc_id"), F.sum("c").alias("copies"), F.array_distinct(F.flatten(F.collect_list("s"))).alias("s"))
    return out.select("doc_id", "copies", F.sort_array("s").alias("sources"))


_TITLE = "regexp_extract(text, '^[^\\n]*', 0)"
_TNORM = _NORM.replace("text", _TITLE)
_SH = f"""t AS (SELECT doc_id, string_split({_TNORM}, ' ') AS w FROM documents), s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i+2], ' ') FOR i IN range(1, greatest(len(w) - 1, 2))]) AS sh FROM t WHERE len(w) >= 6)"""
_PAIRS = f"""{_SH}, c AS (SELECT md5(array_to_string(list_sort(sh), '|')) AS cls, min(doc_id) AS rep, any_value(sh) AS sh FROM s GROUP BY 1), u AS (SELECT rep, len(sh) AS n, unnest(sh) AS h FROM c),
  p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM u a JOIN u b ON a.h = b.h AND a.rep < b.rep GROUP BY 1, 2)"""


def titled(docs: DataFrame) -> DataFrame:
    """(doc_id, sh): shingles of the first line, for titles of six words or more."""
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    w = F.split(text.normalize_text(title), " ")
    return docs.select("doc_id", w.alias("w")).filter(F.size("w") >= 6).select("doc_id", text.shingles(F.col("w"), 3).alias("sh"))


def classed(titles: DataFrame) -> DataFrame:
    """titles with cls, a digest of the set."""
    return titles.withColumn("cls", F.sha2(F.concat_ws("|", F.sort_array("sh")), 256))


def similar_titles(titles: DataFrame, least: float = 0.6, keep=every) -> DataFrame:
    """(a, b, sim): pairs of different title sets, by the smallest ids that have them, with Jaccard of least or more; of them what keep leaves.

    Equal sets meet first in one class, so that copies are never paired. titles: doc_id, sh, cls.
    """
    classes = titles.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("sh").alias("sh")).filter("rep is not null").select("rep", "sh")
    return similar(stored(classes, "classes"), least, keep)


@query(f"WITH {_PAIRS} SELECT a, b, round(i / (na + nb - i), 6) AS sim FROM p WHERE round(i / (na + nb - i), 6) >= 0.6")
def jaccard_pairs(spark: SparkSession, d: str) -> DataFrame:
    return similar_titles(classed(titled(_docs(spark, d))))


@query(f"""WITH RECURSIVE {_PAIRS}, e AS (SELECT a, b FROM p WHERE round(i / (na + nb - i), 6) >= 0.6), g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
  r(node, reach) AS (SELECT a, a FROM g UNION SELECT g.b, r.reach FROM r JOIN g ON r.node = g.a AND r.reach < g.b) SELECT node, min(reach) AS component FROM r GROUP BY node""")
def near_dup_components(spark: SparkSession, d: str) -> DataFrame:
    """Wire copies: components over similar titles, from as few pairs as link the same titles."""
    return components(similar_titles(classed(titled(_docs(spark, d))), keep=forest).select("a", "b"))


@query(f"""WITH {_PAIRS}, m AS (SELECT s.doc_id, c.rep FROM s JOIN c ON md5(array_to_string(list_sort(s.sh), '|')) = c.cls), e AS (SELECT a, b, round(i / (na + nb - i), 6) AS sim FROM p WHERE round(i / (na + nb - i), 6) >= 0.6),
  k AS (SELECT doc_id AS child, rep AS parent, CAST(1 AS DOUBLE) AS sim FROM m WHERE rep < doc_id UNION ALL SELECT doc_id, a, sim FROM m JOIN e ON b = rep WHERE a < doc_id UNION ALL SELECT doc_id, b, sim FROM m JOIN e ON a = rep WHERE b < doc_id), r AS (SELECT *, row_number() OVER (PARTITION BY child ORDER BY sim DESC, parent) AS rn FROM k)
  SELECT child, parent, sim, CASE WHEN sim >= 0.8 AND x.source <> y.source THEN 'syndicated' ELSE 'rewritten' END AS relation FROM r JOIN documents x ON x.doc_id = child JOIN documents y ON y.doc_id = parent WHERE rn = 1""")
def lineage_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Each document's best senior parent by title similarity, ties to the most senior: copied from another source, or rewritten."""
    docs = table(spark, d, "documents")
    t = stored(classed(titled(_docs(spark, d))), "titles")
    member = t.join(t.groupBy("cls").agg(F.min("doc_id").alias("rep")), "cls").select(F.col("doc_id").alias("child"), "rep")
    near = similar_titles(t, keep=senior).select(F.col("b").alias("rep"), F.col("a").alias("parent"), "sim")
    near = near.groupBy("rep").agg(F.max(F.struct("sim", (-F.col("parent")).alias("p"))).alias("b")).select("rep", (-F.col("b.p")).alias("parent"), "b.sim")
    other = member.join(near, "rep").filter("child = rep or sim = 1")  # a copy's parent is its class's first one, unless an older set's similarity rounds to 1
    found = other.select("child", "parent", "sim").unionByName(member.select("child", F.col("rep").alias("parent"), F.lit(1.0).alias("sim"))).filter("parent < child")
    best = found.groupBy("child").agg(F.max(F.struct("sim", (-F.col("parent")).alias("p"))).alias("b")).select("child", (-F.col("b.p")).alias("parent"), F.col("b.sim").alias("sim"))
    source = lambda c: docs.select(F.col("doc_id").alias(c), F.col("source").alias(f"{c}_source"))
    j = best.join(source("child"), "child").join(source("parent"), "parent")
    return j.select("child", "parent", "sim", F.when((F.col("sim") >= 0.8) & (F.col("child_source") != F.col("parent_source")), "syndicated").otherwise("rewritten").alias("relation"))


@query("""WITH v AS (SELECT vec_id, label, [CAST(x AS DOUBLE) FOR x IN embedding] AS e FROM embeddings ORDER BY label DESC, vec_id LIMIT 80) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.e, b.e), 4) AS sim FROM v a JOIN v b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.e, b.e), 4) >= 0.25""")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The 80 best vectors (by label here) against each other: the head's size is the feature, so the join is of 80 x 80 rows whatever the table."""
    head = table(spark, d, "embeddings").orderBy(F.desc("label"), "vec_id").limit(80).select("vec_id", "embedding")
    a, b = head.select(F.col("vec_id").alias("a"), F.col("embedding").alias("ea")), head.select(F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", F.round(numeric.cosine(F.col("ea"), F.col("eb")), 4).alias("sim")).filter("sim >= 0.25")


@query(f"""WITH w AS (SELECT source, lang, unnest(list_distinct({_WORDS})) AS word FROM documents WHERE lang IN ('en', 'de')), c AS (SELECT lang, word, count(*) AS n FROM w WHERE length(word) >= 4 GROUP BY 1, 2),
  x AS (SELECT c.* FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.word = c.word AND o.lang <> c.lang)), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM x) SELECT lang, word, n, rank FROM r WHERE rank <= 4""")
def framing_diff(spark: SparkSession, d: str) -> DataFrame:
    """Words that only one side uses, its four most frequent: one count by (word, side) tells both counts and their difference."""
    w = _docs(spark, d).filter("lang in ('en', 'de')").select("lang", F.explode(F.array_distinct(F.split(text.normalize_text(F.col("text")), " "))).alias("word")).filter("length(word) >= 4")
    c = w.groupBy("word").agg(F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("lang") == "de").alias("de")).filter("en = 0 or de = 0")
    one = c.select("word", F.when(F.col("en") > 0, "en").otherwise("de").alias("lang"), (F.col("en") + F.col("de")).alias("n"))
    return one.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter("rank <= 4").select("lang", "word", "n", "rank")


@query("""WITH q AS (SELECT ['green', 'red', 'large'] AS t), p AS (SELECT p_partkey, p_retailprice, string_split(p_name || ' ' || lower(p_type), ' ') AS w, string_split(p_name, ' ') AS e FROM part),
  s AS (SELECT p_partkey, p_retailprice, len(list_intersect(t, e)) AS ents, len(list_intersect(t, w)) AS toks FROM p, q), r AS (SELECT p_partkey, p_retailprice, round(least(1.0, 0.7 * ents / 3 + 0.3 * toks / 3 + CASE WHEN ents > 0 THEN 0.15 ELSE 0 END), 6) AS score FROM s)
  SELECT p_partkey, score FROM r WHERE score >= 0.2 ORDER BY score DESC, p_partkey LIMIT 20""")
def search_score(spark: SparkSession, d: str) -> DataFrame:
    """Entity share .7, token share .3, .15 for any entity; .2 at least; the 20 best."""
    terms = F.array(*(F.lit(t) for t in ("green", "red", "large")))
    p = table(spark, d, "part").select("p_partkey", F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " ").alias("w"), F.split("p_name", " ").alias("e"))
    ents, toks = F.size(F.array_intersect(terms, "e")), F.size(F.array_intersect(terms, "w"))
    score = F.round(F.least(F.lit(1.0), ents * 0.7 / 3 + toks * 0.3 / 3 + F.when(ents > 0, 0.15).otherwise(0.0)), 6)
    return p.select("p_partkey", score.alias("score")).filter("score >= 0.2").orderBy(F.desc("score"), "p_partkey").limit(20)


@query(f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, unnest(list_distinct([array_to_string(w[i:i+1], ' ') FOR i IN range(1, len(w))])) AS gram FROM w WHERE len(w) > 1)
  SELECT gram, count(*) AS n FROM g GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, gram LIMIT 25""")
def bigram_trending(spark: SparkSession, d: str) -> DataFrame:
    """Folded and counted task by task in numpy, so that only each task's distinct pairs are rows; then summed by pair."""
    g = table(spark, d, "documents").select(F.col("text").cast("binary")).mapInArrow(grams.counted(grams.marks(spark)), "gram string, n long")
    return g.groupBy("gram").agg(F.sum("n").alias("n")).filter("n >= 2").orderBy(F.desc("n"), "gram").limit(25)
