"""Queries over texts and URLs: scalars, filters, dedup."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import dedup as D
from ..storage import table

_WORDS = r"""CASE WHEN trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), ' ') END"""
_NORM = r"trim(regexp_replace(lower(coalesce({0}, '')), '\s+', ' ', 'g'))"
_STOP = "(" + ", ".join(f"'{w}'" for w in T.QUERY_STOPWORDS) + ")"
_ENGLISH = "(" + ", ".join(f"'{w}'" for w in T.ENGLISH_WORDS) + ")"
TERMS = r"list_filter(regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+'), lambda t: length(t) > 2 AND t NOT IN " + _STOP + ")"


def docs(spark, sf):
    return table(spark, sf, "documents")


def text_normalize_hash(spark, sf):
    return docs(spark, sf).select("doc_id", T.content_hash(F.col("text")).alias("hash"), F.length(T.normalize(F.col("text"))).alias("size"))


def token_estimate(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", F.size(T.words(t)).alias("n_words"), T.token_count(t).alias("tokens"), F.length(T.trim_tokens(t, 32)).alias("trimmed_chars")
    )


def sentence_split(spark, sf):
    s = T.sentences(F.col("text"))
    return docs(spark, sf).select("doc_id", F.size(s).alias("n_sentences"), F.length(F.element_at(s, 1)).alias("first_chars"))


def meaningful_terms(spark, sf):
    m = T.meaningful_terms(F.col("text"))
    return docs(spark, sf).select(
        "doc_id", F.size(m).alias("n_terms"), F.size(F.array_distinct(m)).alias("n_distinct"), F.md5(F.array_join(m, " ")).alias("terms_md5"),
        F.size(T.adjacent_pairs(m)).alias("n_pairs"),
    )


def english_heuristic(spark, sf):
    return docs(spark, sf).select("doc_id", T.looks_english(F.col("text")).alias("english"))


def rerank_truncation(spark, sf):
    t = F.col("text")
    return docs(spark, sf).select(
        "doc_id", F.md5(T.truncate_for_rerank(t)).alias("cut_md5"), F.md5(T.preview(t)).alias("preview_md5"), F.md5(T.tidy_markdown(t)).alias("tidy_md5")
    )


def query_variants(spark, sf):
    b = table(spark, sf, "benchmark")
    return b.select("item_id", F.posexplode(T.query_variants(F.col("text"))).alias("position", "variant"))


def price_cleaning(spark, sf):
    p = table(spark, sf, "part")
    raw = F.concat(F.lit("AED "), F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ","))
    state = F.when(F.col("p_size") % 3 == 0, "In Stock").when(F.col("p_size") % 3 == 1, "sold-out").otherwise("On request ")
    return p.select("p_partkey", T.clean_price(raw).alias("price"), T.simple_availability(state).alias("availability"))


def _page_urls(spark, sf):
    p = table(spark, sf, "pages")
    made = F.concat(
        F.lit("HTTPS://WWW.Example.COM/"),
        F.element_at(F.array(*[F.lit(x) for x in ("cart", "fr/a", "en-us/b", "collections/all", "cartoons", "xx-yy/c", "blog/", "img/a.PNG")]), (F.col("page_id") % 8 + 1).cast("int")),
        F.element_at(F.array(F.lit(""), F.lit("?variant="), F.lit("?variant=12&x=1"), F.lit("?sort=#top")), (F.floor(F.col("page_id") / 8) % 4 + 1).cast("int")),
    )
    return p.select("page_id", F.lit("given").alias("kind"), F.col("url")).unionByName(p.select("page_id", F.lit("made").alias("kind"), made.alias("url")))


def url_normalize(spark, sf):
    u = F.col("url")
    return _page_urls(spark, sf).select(
        "page_id", "kind", U.normalize_url(u).alias("normal"), U.host(u).alias("host"), U.sitemap_url(u).alias("sitemap"),
        U.is_valid_url(u).alias("valid"), U.is_asset_url(u).alias("asset"), U.slug(u).alias("slug"),
    )


def url_skip_reason(spark, sf):
    u = F.col("url")
    return _page_urls(spark, sf).select(
        "page_id", "kind", U.skip_reason(u).alias("reason"), U.is_english_url(u).alias("english"),
        U.allowed_domain(U.host(u), F.array(F.lit("example.com"))).alias("allowed"), U.private_host(U.host(u)).alias("private"),
    )


def exact_dedup(spark, sf):
    return D.exact_dedup(docs(spark, sf)).select("doc_id", "hash", "first_id", "copies", "kept")


def shingle_counts(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(T.shingle_hashes(F.col("text"))).alias("n_shingles"))


def near_dup_pairs(spark, sf):
    return D.similar_pairs(docs(spark, sf)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def near_dup_keep(spark, sf):
    return D.greedy_keep(docs(spark, sf))


def ordered_distinct(spark, sf):
    e = table(spark, sf, "events")
    return D.distinct_in_order(e.select(F.col("event_type").alias("key"), "event_id"), "key", "event_id")


_URLS = r"""
SELECT page_id, 'given' AS kind, url FROM pages UNION ALL
SELECT page_id, 'made', 'HTTPS://WWW.Example.COM/' || ['cart', 'fr/a', 'en-us/b', 'collections/all', 'cartoons', 'xx-yy/c', 'blog/', 'img/a.PNG'][page_id % 8 + 1]
  || ['', '?variant=', '?variant=12&x=1', '?sort=#top'][(page_id // 8) % 4 + 1] FROM pages"""
_PARTS = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
_PARSED = rf"""
u AS ({_URLS}),
p AS (SELECT *, lower(regexp_extract(url, {_PARTS}, 1)) AS scheme, regexp_replace(lower(regexp_extract(url, {_PARTS}, 2)), '^www\.', '') AS host,
  regexp_extract(url, {_PARTS}, 3) AS path, regexp_extract(url, {_PARTS}, 4) AS query FROM u),
n AS (SELECT *, CASE WHEN path IN ('', '/') THEN '/' ELSE regexp_replace(regexp_replace(path, ';[^/]*$', ''), '/+$', '') END AS npath FROM p)"""

_SETS = rf"""
base AS (SELECT {_NORM.format('text')} AS t, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, string_split(t, ' ') AS w FROM base WHERE t <> ''),
sh AS (SELECT DISTINCT id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w)),
sz AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pairs AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
near AS (SELECT a, b, c / (p.n + q.n - c) AS similarity FROM pairs JOIN sz p ON p.id = a JOIN sz q ON q.id = b WHERE c / (p.n + q.n - c) >= 0.85)"""

QUERIES = {
    "text_normalize_hash": (text_normalize_hash, rf"SELECT doc_id, sha256({_NORM.format('text')}) AS hash, length({_NORM.format('text')})::INT AS size FROM documents"),
    "token_estimate": (
        token_estimate,
        rf"""SELECT doc_id, len(w)::INT AS n_words, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE greatest(1, floor(len(w) * 1.3::DOUBLE))::INT END AS tokens,
             length(array_to_string(w[1:32], ' '))::INT AS trimmed_chars FROM (SELECT *, {_WORDS.format('text')} AS w FROM documents)""",
    ),
    "sentence_split": (
        sentence_split,
        r"""SELECT doc_id, len(s)::INT AS n_sentences, length(s[1])::INT AS first_chars
            FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents)""",
    ),
    "meaningful_terms": (
        meaningful_terms,
        f"""SELECT doc_id, len(m)::INT AS n_terms, len(list_distinct(m))::INT AS n_distinct, md5(array_to_string(m, ' ')) AS terms_md5, greatest(len(m) - 1, 0)::INT AS n_pairs
            FROM (SELECT doc_id, {TERMS.format('text')} AS m FROM documents)""",
    ),
    "english_heuristic": (
        english_heuristic,
        rf"""SELECT doc_id, length(t) >= 100 AND len(w) >= 20 AND (k >= 2 OR k / greatest(len(w), 1) >= 0.03) AS english FROM (
             SELECT doc_id, t, w, len(list_filter(w, lambda x: x IN {_ENGLISH})) AS k FROM (
             SELECT doc_id, {_NORM.format('text')} AS t, regexp_extract_all({_NORM.format('text')}, '[a-z'']+') AS w FROM documents))""",
    ),
    "rerank_truncation": (
        rerank_truncation,
        r"""SELECT doc_id, md5(array_to_string((string_split(rtrim(substr(t, 1, 1800)), ' '))[1:256], ' ')) AS cut_md5, md5(substr(t, 1, 180)) AS preview_md5,
            md5(CASE WHEN tidy = '' THEN '' ELSE tidy || chr(10) END) AS tidy_md5
            FROM (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t,
              regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS tidy FROM documents)""",
    ),
    "query_variants": (query_variants, None),
    "price_cleaning": (
        price_cleaning,
        """SELECT p_partkey, printf('%.2f', p_retailprice) AS price,
           CASE p_size % 3 WHEN 0 THEN 'InStock' WHEN 1 THEN 'OutOfStock' ELSE 'On request' END AS availability FROM part""",
    ),
    "url_normalize": (
        url_normalize,
        rf"""WITH {_PARSED}
        SELECT page_id, kind, (CASE WHEN scheme = '' THEN 'https' ELSE scheme END) || '://' || host || npath || (CASE WHEN query = '' THEN '' ELSE '?' || query END) AS normal,
          host, (CASE WHEN scheme = '' THEN 'https' ELSE scheme END) || '://' || host || '/sitemap.xml' AS sitemap, scheme IN ('http', 'https') AND host <> '' AS valid,
          regexp_matches(lower(path), '\.(jpg|jpeg|png|gif|webp|svg|ico|css|js|json|xml|pdf|zip|mp4|mp3|woff|woff2|ttf|eot)$') AS asset,
          substr(regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug FROM n""",
    ),
    "url_skip_reason": (
        url_skip_reason,
        rf"""WITH {_PARSED},
        s AS (SELECT *, list_filter(string_split(regexp_replace(lower(path), '/+$', ''), '/'), lambda x: x <> '') AS seg, regexp_replace(lower(path), '/+$', '') AS lp, lower(query) AS lq,
          replace(lower(string_split(regexp_replace(npath, '^/+|/+$', '', 'g'), '/')[1]), '_', '-') AS lang FROM n)
        SELECT page_id, kind, CASE WHEN seg[1] IN ('cart', 'checkout', 'account', 'search') THEN 'blocked path ' || seg[1]
          WHEN seg[1] = 'collections' AND seg[2] = 'all' THEN 'blocked path collections/all'
          WHEN regexp_matches(lq, '(?:^|&)variant=(?:=|&|$)') THEN 'blocked query parameter variant='
          WHEN regexp_matches(lq, '(?:^|&)sort=(?:=|&|$)') THEN 'blocked query parameter sort='
          WHEN regexp_matches(lq, '(?:^|&)page=(?:=|&|$)') THEN 'blocked query parameter page='
          WHEN contains(lp, '/cart') THEN 'blocked path /cart' WHEN contains(lp, '/checkout') THEN 'blocked path /checkout'
          WHEN contains(lp, '/account') THEN 'blocked path /account' WHEN contains(lp, '/search') THEN 'blocked path /search'
          WHEN contains(lp, '/collections/all') THEN 'blocked path /collections/all' END AS reason,
          lang = '' OR lang IN ('en', 'en-us', 'en-gb') OR NOT regexp_matches(lang, '^[a-z]{{2}}(?:-[a-z]{{2}})?$') AS english,
          host = 'example.com' OR host LIKE '%.example.com' AS allowed,
          regexp_matches(host, '^(localhost$|127\.|10\.|192\.168\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS private FROM s""",
    ),
    "exact_dedup": (
        exact_dedup,
        rf"""SELECT doc_id, hash, min(doc_id) OVER g AS first_id, count(*) OVER g AS copies, doc_id = min(doc_id) OVER g AS kept
             FROM (SELECT doc_id, sha256({_NORM.format('text')}) AS hash FROM documents) WINDOW g AS (PARTITION BY hash)""",
    ),
    "shingle_counts": (
        shingle_counts,
        rf"""SELECT doc_id, CASE WHEN t = '' THEN 0 WHEN len(w) < 5 THEN 1 ELSE len(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')))) END::INT AS n_shingles
             FROM (SELECT doc_id, {_NORM.format('text')} AS t, string_split({_NORM.format('text')}, ' ') AS w FROM documents)""",
    ),
    "near_dup_pairs": (near_dup_pairs, f"WITH {_SETS} SELECT a, b, round(similarity, 6) AS similarity FROM near"),
    "near_dup_keep": (
        near_dup_keep,
        rf"""WITH {_SETS},
        e AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY {_NORM.format('text')}) AS first FROM documents)
        SELECT doc_id, doc_id = first AND doc_id NOT IN (SELECT b FROM near) AS kept FROM e""",
    ),
    "ordered_distinct": (ordered_distinct, "SELECT event_type AS key, min(event_id) AS event_id FROM events GROUP BY 1"),
}
