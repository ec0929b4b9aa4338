"""The registered queries of the engine and their DuckDB twins, over whole tables.

`pages` alone reaches few branches, so some queries add fixed variants to each row by its
id; both sides build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import classify, html, routes, text, urls
from textloom.operators import jobs, scrape, url_list
from textloom.plans import duck
from textloom.schemas import ITEM_LOG
from textloom.sources.tables import scratch, table

#: Appended to a page by page_id % 8.
VARIANTS = [
    "<noscript>x</noscript><p>a&amp;lt;b</p>",
    "<svg><path d='1'/></svg>1 < 2</p>x",
    "<iframe src='u'>inner</iframe>&NBSP;end",
    "<script>var open = 1;",
    "<div>Enable JavaScript to go on</div>",
    "<p>&lt;b&gt;bold&lt;/b&gt; &quot;q&quot; &#39;s&#x27;</p>",
    "<script id=\"__NEXT_DATA__\">{}</script><!-- c\nd --><stylex>kept</stylex>",
    "<p>Ã¼ber Å\u009f â€” Â© cafÃ©</p>",
]
NUMERIC = [" x&#38;&#65;y&#287;", " &#38;#66; &#1114112; &#00067;", " none", " &#128512; &amp;#68;"]
HOSTS = ["localhost", "a.localhost", "printer.local", "127.0.0.1", "10.1.2.3", "10.example.com", "192.168.7.7", "169.254.1.1",
         "172.15.0.1", "172.16.0.1", "172.31.9.9", "172.32.0.1", "0.0.0.0", "[::1]", "fcbarcelona.com", "fdic.gov", "example.com"]


def pick(key: str, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def sql_pick(key: str, values: list[str]) -> str:
    return f"list_extract([{', '.join(map(duck.lit, values))}], ({key} % {len(values)} + 1)::INTEGER)"


Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("html_text", f"""
SELECT page_id, title, text, length(text)::BIGINT AS text_length
FROM (SELECT page_id, {duck.title('html')} AS title, {duck.body('html')} AS text FROM pages)""")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    return html.extract(table(spark, d, "pages", "page_id", "html")).select("page_id", "title", "text", "text_length")


INJECTED = f"html || {sql_pick('page_id', VARIANTS)}"


def injected(spark, d) -> DataFrame:
    return table(spark, d, "pages", "page_id", "url", "html").withColumn("html", F.concat("html", pick("page_id", VARIANTS)))


@query("html_text_injected", f"""
SELECT page_id, {duck.title('h')} AS title, {duck.body('h')} AS text FROM (SELECT page_id, {INJECTED} AS h FROM pages)""")
def html_text_injected(spark, d):
    return html.extract(injected(spark, d)).select("page_id", "title", "text")


_num = f"(url || {sql_pick('page_id', NUMERIC)})"


@query("entities_numeric", f"SELECT page_id, {duck.decimal_entities('u')} AS decoded FROM (SELECT page_id, {duck.named(_num)} AS u FROM pages)")
def entities_numeric(spark, d):
    c = F.concat("url", pick("page_id", NUMERIC))
    return table(spark, d, "pages", "page_id", "url").select("page_id", text.decode_entities(c).alias("decoded"))


HEX = [" x&#x26;y&#X41;", " &#x26;#65;", " none", " &#x1F600; &#x110000; &#x00043;"]
_hex = f"(url || {sql_pick('page_id', HEX)})"


@query("entities_hex", f"SELECT page_id, {duck.hex_entities('u')} AS decoded FROM (SELECT page_id, {_hex} AS u FROM pages)")
def entities_hex(spark, d):
    c = F.concat("url", pick("page_id", HEX))
    return table(spark, d, "pages", "page_id", "url").select("page_id", text.decode_hex_entities(c).alias("decoded"))


_broken = ["", " Ã¼ Â® x", " ÃÂ‡", " Â lead", " â€™sÂ"]


@query("mojibake_fix", f"""
SELECT doc_id, {duck.mojibake('t')} AS fixed, length(regexp_replace(t, '[^{text.MOJIBAKE_MARKS}]', '', 'g'))::BIGINT AS score
FROM (SELECT doc_id, coalesce(text, '') || {sql_pick('doc_id', _broken)} AS t FROM documents)""")
def mojibake_fix(spark, d):
    c = F.concat(F.coalesce("text", F.lit("")), pick("doc_id", _broken))
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", c.alias("t"))
    return t.select("doc_id", text.repair_mojibake(F.col("t")).alias("fixed"), text.mojibake_score(F.col("t")).cast("bigint").alias("score"))


@query("normalize_text", f"SELECT doc_id, {duck.normalize('coalesce(text, $$$$)')} AS clean FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.normalize_text(F.col("text")).alias("clean"))


@query("decode_choice", "SELECT doc_id, coalesce(text, '') AS decoded FROM documents")
def decode_choice(spark, d):
    """Text to UTF-8 bytes and back through the charset chooser, which must find UTF-8."""
    return table(spark, d, "documents", "doc_id", "text").select(
        "doc_id", text.decode_body(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("decoded")
    )


@query("text_truncate", f"""
SELECT doc_id, length(t)::BIGINT AS text_length, left(t, {text.MAX_TEXT_LENGTH}) AS kept
FROM (SELECT doc_id, repeat(coalesce(text, ''), 1 + (doc_id % 3)::INTEGER) AS t FROM documents)""")
def text_truncate(spark, d):
    t = table(spark, d, "documents", "doc_id", "text").select("doc_id", F.repeat(F.coalesce("text", F.lit("")), (1 + F.col("doc_id") % 3).cast("int")).alias("t"))
    return t.select("doc_id", text.utf16_length(F.col("t")).alias("text_length"), text.truncate_text(F.col("t")).alias("kept"))


_STATUS = "[200, 404, 301, 503, 204][(page_id % 5 + 1)::INTEGER]"
_TYPE = sql_pick("page_id", ["text/html", "TEXT/HTML; charset=utf-8", "application/pdf", ""])


def judged(spark, d) -> DataFrame:
    p = injected(spark, d).withColumns({
        "status": F.element_at(F.array(*map(F.lit, [200, 404, 301, 503, 204])), (F.col("page_id") % 5 + 1).cast("int")),
        "content_type": pick("page_id", ["text/html", "TEXT/HTML; charset=utf-8", "application/pdf", ""]),
    })
    return html.extract(p)


@query("page_routing", f"""
SELECT page_id, needs, CASE WHEN NOT contains(lower(content_type), 'text/html')
  THEN {duck.lit(classify.REASON_NOT_HTML)} || CASE WHEN content_type = '' THEN {duck.lit(classify.UNKNOWN_TYPE)} ELSE content_type END
  WHEN needs THEN {duck.lit(classify.REASON_SCRIPTED)} END AS reason, status BETWEEN 200 AND 299 AS fetch_ok
FROM (SELECT page_id, status, content_type, {duck.needs_browser('status', 'h', 't')} AS needs
  FROM (SELECT *, {duck.body('h')} AS t FROM (SELECT page_id, {INJECTED} AS h, {_STATUS} AS status, {_TYPE} AS content_type FROM pages)))""")
def page_routing(spark, d):
    p = judged(spark, d)
    needs = classify.needs_browser(F.col("status"), F.col("html"), F.col("text"))
    reason = classify.fallback_reason(F.lit(False), F.lit(None).cast("string"), F.col("content_type"), F.col("status"), F.col("html"), F.col("text"))
    return p.select("page_id", needs.alias("needs"), reason.alias("reason"), classify.fetch_success(F.col("status")).alias("fetch_ok"))


@query("routing_special", f"""
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN {duck.lit(classify.REASON_SPECIAL)} WHEN page_id % 5 = 1 THEN 'no route ' || page_id
  WHEN NOT contains(lower(content_type), 'text/html') THEN {duck.lit(classify.REASON_NOT_HTML)} || CASE WHEN content_type = '' THEN {duck.lit(classify.UNKNOWN_TYPE)} ELSE content_type END
  WHEN needs THEN {duck.lit(classify.REASON_SCRIPTED)} END AS reason
FROM (SELECT page_id, content_type, {duck.needs_browser('status', 'h', 't')} AS needs
  FROM (SELECT *, {duck.body('h')} AS t FROM (SELECT page_id, {INJECTED} AS h, {_STATUS} AS status, {_TYPE} AS content_type FROM pages)))""")
def routing_special(spark, d):
    """The reason with every branch: a special site, a fetch error, another type, a page that needs a browser."""
    made = F.concat(F.lit("https://www.flashscore.com"), F.when(F.col("page_id") % 3 == 0, "/mac/").otherwise("/m/"), F.col("page_id").cast("string"))
    error = F.when(F.col("page_id") % 5 == 1, F.concat(F.lit("no route "), F.col("page_id").cast("string")))
    reason = classify.fallback_reason(urls.is_special_site(made), error, F.col("content_type"), F.col("status"), F.col("html"), F.col("text"))
    return judged(spark, d).select("page_id", reason.alias("reason"))


_PATHS = ["/", "/scrape", "/scrape-many", "/jobs", "/jobs/a%20b+{}", "/jobs/{}/results", "/jobs/{}/x", "/batch", "/jobs/", "/other"]
_VERBS = ["GET", "POST", "OPTIONS"]


@query("routes", f"""
SELECT page_id, CASE WHEN verb = 'OPTIONS' THEN '{routes.PREFLIGHT}' WHEN verb = 'POST' THEN CASE k WHEN 2 THEN 'scrape_many' WHEN 3 THEN 'create_job' WHEN 7 THEN 'batch' END
  ELSE CASE WHEN k <= 1 THEN 'single' WHEN k = 4 THEN 'job' WHEN k = 5 THEN 'job_results' END END AS endpoint,
  CASE WHEN verb = 'GET' AND k = 4 THEN 'a b+' || page_id WHEN verb = 'GET' AND k = 5 THEN page_id::VARCHAR END AS job_id
FROM (SELECT page_id, page_id % {len(_PATHS)} AS k, {sql_pick('page_id', _VERBS)} AS verb FROM pages)""")
def route_requests(spark, d):
    path = F.replace(pick("page_id", _PATHS), F.lit("{}"), F.col("page_id").cast("string"))
    return table(spark, d, "pages", "page_id").withColumn("r", routes.match_route(pick("page_id", _VERBS), path)).select("page_id", "r.endpoint", "r.job_id")


@query("json_rows", """SELECT '{"event_id":' || event_id || ',"event_type":"' || event_type || '","error":null}' AS body FROM events""")
def json_rows(spark, d):
    return routes.to_json(table(spark, d, "events", "event_id", "event_type").withColumn("error", F.lit(None).cast("string")))


_phrases = ["", " Loading...", " Access DENIED", " unusual traffic", ""]


def _sql_outcome(t: str) -> tuple[str, str]:
    shown = f"lower(role || ' ' || {t})"
    return duck.any_of(shown, classify.BLOCKED_PHRASES), f"(contains({t}, 'Loading...') OR length({t}) < 80)"


_whole, _edge = _sql_outcome("t"), _sql_outcome("e")


@query("render_outcome", f"""
SELECT conv_id, turn, {_whole[0]} AS blocked, {_whole[1]} AS loading, NOT {_whole[1]} AND NOT {_whole[0]} AND length(t) > 80 AS success,
  {_edge[1]} AS edge_loading, NOT {_edge[1]} AND NOT {_edge[0]} AND length(e) > 80 AS edge_success
FROM (SELECT conv_id, turn, role, text || {sql_pick('conv_id', _phrases)} AS t, repeat('x', 78 + (turn % 5)::INTEGER) AS e FROM conversations)""")
def render_outcome(spark, d):
    """Every whole text with a phrase by conversation; beside it texts of about the least length that succeeds."""
    c = table(spark, d, "conversations").withColumns({"t": F.concat("text", pick("conv_id", _phrases)), "e": F.repeat(F.lit("x"), (78 + F.col("turn") % 5).cast("int"))})
    role, t, e = F.col("role"), F.col("t"), F.col("e")
    return c.select(
        "conv_id", "turn", classify.is_blocked(role, t).alias("blocked"), classify.still_loading(t).alias("loading"), classify.rendered_success(role, t).alias("success"),
        classify.still_loading(e).alias("edge_loading"), classify.rendered_success(role, e).alias("edge_success"),
    )


def _sql_private(h: str) -> str:
    return (
        f"({h} IN ('localhost', '0.0.0.0', '::1') OR suffix({h}, '.localhost') OR suffix({h}, '.local') OR regexp_matches({h}, '^(127|10|192\\.168|169\\.254)\\.')"
        f" OR regexp_matches({h}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') OR regexp_matches({h}, '^(fc|fd|fe80:)'))"
    )


_HOST = "regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1)"


@query("url_private", f"SELECT page_id, h AS host, {_sql_private('h')} AS private, own_host, {_sql_private('own_host')} AS own_private FROM (SELECT page_id, {sql_pick('page_id', HOSTS)} AS h, {_HOST} AS own_host FROM pages)")
def url_private(spark, d):
    """The host of every page, and beside it one of each shape that the rules name."""
    h = table(spark, d, "pages", "page_id", "url").select("page_id", pick("page_id", HOSTS).alias("host"), urls.host_of(F.col("url")).alias("own_host"))
    return h.select("page_id", "host", urls.is_private_host(F.col("host")).alias("private"), "own_host", urls.is_private_host(F.col("own_host")).alias("own_private"))


@query("url_special", f"SELECT page_id, page_id % 3 = 0 AS special, contains({_HOST}, 'flashscore.') AND contains(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/mac/') AS own_special FROM pages")
def url_special(spark, d):
    made = F.concat(F.lit("https://www.flashscore.com"), F.when(F.col("page_id") % 3 == 0, "/mac/").otherwise("/m/"), F.col("page_id").cast("string"))
    return table(spark, d, "pages", "page_id", "url").select("page_id", urls.is_special_site(made).alias("special"), urls.is_special_site(F.col("url")).alias("own_special"))


_SHAPES = ["HTTPS://EX{}.com:443/a/../b", "http://ex.com/./x{}", "http://[::1]/{}", "ftp://ex.com/{}", "nonsense {}", "http://10.0.0.1/{}", "http://ex.com/p q{}"]
_EXPECTED = ["'https://ex' || p || '.com/b'", "'http://ex.com/x' || p", "'http://[::1]/' || p", "NULL", "NULL", "NULL", "'http://ex.com/p%20q' || p"]
_ERRORS = {3: urls.ONLY_HTTP, 4: urls.INVALID_URL, 5: urls.PRIVATE_HOST}


@query("url_canonical", "SELECT page_id, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(_EXPECTED)) + " END AS canonical, CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {duck.lit(e)}" for i, e in _ERRORS.items()) + " END AS error, url AS own_canonical FROM (SELECT page_id, url, page_id::VARCHAR AS p FROM pages)")
def url_canonical(spark, d):
    """The URL of every page, which is canonical, and beside it one of each other shape."""
    p, shaped = F.col("page_id").cast("string"), F.lit(None).cast("string")
    for i, s in enumerate(_SHAPES):
        shaped = F.when(F.col("page_id") % len(_SHAPES) == i, F.replace(F.lit(s), F.lit("{}"), p)).otherwise(shaped)
    u = table(spark, d, "pages", "page_id", "url").withColumns({"p": urls.parse_url(shaped), "own": urls.parse_url(F.col("url"))})
    return u.select("page_id", "p.canonical", "p.error", F.col("own.canonical").alias("own_canonical"))


@query("url_distinct", "SELECT u AS canonical, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS u FROM pages) GROUP BY u")
def url_distinct(spark, d):
    u = table(spark, d, "pages", "page_id", "url").withColumn("canonical", urls.parse_url(F.regexp_replace("url", "[?#].*$", ""))["canonical"])
    return url_list.distinct_urls(u.select("canonical", "page_id"), order="page_id")


@query("url_list_requests", f"""
SELECT page_id, CASE WHEN page_id % 5 IN (0, 2) THEN [url, url || '#x'] END AS urls,
  CASE page_id % 5 WHEN 1 THEN {duck.lit(urls.NOT_A_LIST)} WHEN 3 THEN {duck.lit(urls.INVALID_URL)} WHEN 4 THEN {duck.lit(urls.NOT_JSON)} END AS error
FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)""")
def url_list_requests(spark, d):
    u = F.regexp_replace("url", "[?#].*$", "")
    body = (
        F.when(F.col("page_id") % 5 == 0, F.format_string('{"urls": [" %s ", 5, "%s#x", "%s", null]}', u, u, u))
        .when(F.col("page_id") % 5 == 1, F.lit('{"urls": "no"}'))
        .when(F.col("page_id") % 5 == 4, F.format_string('{"urls": ["%s"', u))
        .when(F.col("page_id") % 5 == 2, F.format_string('{"urls": ["%s", "", "%s#x"]}', u, u))
        .otherwise(F.format_string('{"urls": ["%s", "nonsense"]}', u))
    )
    requests = url_list.parse_request(table(spark, d, "pages", "page_id", "url").withColumn("body", body))
    return url_list.normalize_lists(requests, 20, key="page_id")


def _fixture_pages(spark, d) -> DataFrame:
    """Pages with a place of their own: what tells them apart, as ids may repeat or lack."""
    place = F.struct("page_id", "url", F.sha2("html", 256).alias("digest"))
    return judged(spark, d).select(place.alias("pos"), "url", "html", F.col("status").alias("http_status"), "content_type")


def scraped(spark, d) -> DataFrame:
    """The pipeline over stored pages; what needs a browser is rendered from the page's title and text.

    Pages go by their own place: a URL or an id may have been stored several times. Pages alike in all are one
    request, whose row is repeated.
    """
    from textloom.sources.pages import stored_pages, stored_renders

    p = _fixture_pages(spark, d)
    renders = html.extract(p).select("pos", F.col("title").alias("raw_title"), F.col("text").alias("raw_text"), F.lit(0).alias("http_status"))
    places = p.groupBy("pos").agg(F.count("*").cast("int").alias("copies"))
    out = scrape.scrape(places.select("pos", "pos.url"), stored_pages(p), stored_renders(renders)).join(places, "pos")
    return out.withColumn("pos", F.explode(F.array_repeat(F.col("pos.page_id").cast("int"), F.col("copies")))).drop("copies")


_SCRAPED = f"""
WITH p AS (SELECT page_id, url, {INJECTED} AS h, {_STATUS} AS status, {_TYPE} AS content_type FROM pages),
t AS (SELECT *, {duck.title('h')} AS title, {duck.body('h')} AS text FROM p),
r AS (SELECT *, CASE WHEN NOT contains(lower(content_type), 'text/html')
    THEN {duck.lit(classify.REASON_NOT_HTML)} || CASE WHEN content_type = '' THEN {duck.lit(classify.UNKNOWN_TYPE)} ELSE content_type END
    WHEN {duck.needs_browser('status', 'h', 'text')} THEN {duck.lit(classify.REASON_SCRIPTED)} END AS reason,
  {duck.any_of("lower(title || ' ' || text)", classify.BLOCKED_PHRASES)} AS blocked, contains(text, 'Loading...') OR length(text) < 80 AS loading FROM t),
s AS (SELECT page_id::INTEGER AS pos, url AS "requestedUrl", CASE WHEN reason IS NULL THEN status BETWEEN 200 AND 299 ELSE NOT loading AND NOT blocked AND length(text) > 80 END AS success,
  CASE WHEN reason IS NULL THEN 'fetch' ELSE 'browser' END AS method, CASE WHEN reason IS NULL THEN status ELSE 200 END AS status, title, length(text)::BIGINT AS "textLength",
  CASE WHEN reason IS NOT NULL THEN loading END AS "stillLoading", reason IS NOT NULL AND blocked AS blocked, left(text, {text.MAX_TEXT_LENGTH}) AS text, reason AS "fallbackReason" FROM r)
"""


@query("scrape_results", _SCRAPED + "SELECT * FROM s")
def scrape_results(spark, d):
    return scraped(spark, d).drop("finalUrl", "error", "durationMs")


@query("scrape_summary", _SCRAPED + """SELECT 'sync' AS mode, count_if(success) > 0 AS success, count(*) AS requested, count_if(success)::BIGINT AS successful,
count(*) - count_if(success)::BIGINT AS failed, count_if(method = 'fetch')::BIGINT AS "fetchCount", count_if(method = 'browser')::BIGINT AS "browserCount" FROM s""")
def scrape_summary(spark, d):
    return scrape.summarize(scraped(spark, d))


_ITEM_STATUS = "CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'processing' ELSE 'queued' END"


def event_items(spark, d) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts", "user_id", "event_type").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("job_id"), F.expr(_ITEM_STATUS).alias("status"), "ts"
    )


_ROLL = f"""SELECT user_id AS job_id, count(*) AS total, count_if(s IN ('completed', 'failed'))::BIGINT AS completed, count_if(s = 'completed')::BIGINT AS successful,
count_if(s = 'failed')::BIGINT AS failed FROM (SELECT user_id, {_ITEM_STATUS} AS s FROM events) GROUP BY user_id"""


@query("job_rollup", _ROLL)
def job_rollup(spark, d):
    return jobs.rollup(event_items(spark, d))


@query("job_view", f"""SELECT job_id, {duck.status_of('completed', 'total', 'failed')} AS status, total, completed, successful, failed, greatest(0, total - completed) AS pending,
CASE WHEN total > 0 THEN floor(completed / total * 100 + 0.5)::BIGINT ELSE 0 END AS progress FROM ({_ROLL})""")
def job_view(spark, d):
    return jobs.job_view(event_items(spark, d))


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"


@query("jobs", f"""SELECT job_id, {duck.status_of('completed', 'total', 'failed')} AS status, total, completed, successful, failed, created_at, updated_at
FROM ({_ROLL}) JOIN (SELECT user_id AS job_id, {_ISO.format('min(ts)')} AS created_at, {_ISO.format('max(ts)')} AS updated_at FROM events GROUP BY user_id) USING (job_id)""")
def job_rows(spark, d):
    """A row a job, as a store of jobs has it: made with the items' first and changed with their last transition."""
    at = jobs.iso(F.col("ts"))
    items = event_items(spark, d).withColumns({"created_at": at, "updated_at": at})
    return jobs.job_view(items).select("job_id", "status", "total", "completed", "successful", "failed", "created_at", "updated_at")


@query("job_view_override", f"""SELECT job_id, CASE WHEN lost THEN 'failed' ELSE {duck.status_of('completed', 'total', 'failed')} END AS status, total,
CASE WHEN lost THEN total ELSE completed END AS completed, CASE WHEN lost THEN 0 ELSE successful END AS successful, CASE WHEN lost THEN total ELSE failed END AS failed,
CASE WHEN lost THEN 0 ELSE greatest(0, total - completed) END AS pending, CASE WHEN lost THEN 100 ELSE floor(completed / total * 100 + 0.5)::BIGINT END AS progress
FROM (SELECT *, job_id % 5 = 0 AS lost FROM ({_ROLL}))""")
def job_view_override(spark, d):
    items = event_items(spark, d)
    log = items.filter("job_id % 5 = 0").select(F.col("job_id").alias("id"), F.lit("enqueue_failed").alias("kind"))
    return jobs.job_view(items, log)


@query("job_items_latest", """
WITH l AS (SELECT user_id, event_id, event_type, value, CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN 'dead' WHEN 'signup' THEN 'retry' ELSE 'processing' END AS kind FROM events)
SELECT user_id::VARCHAR AS id, arg_max(CASE kind WHEN 'result' THEN 'completed' WHEN 'dead' THEN 'failed' WHEN 'retry' THEN 'queued' ELSE 'processing' END, event_id) AS status,
arg_max(CASE WHEN kind IN ('dead', 'retry') THEN {v: 'e' || event_id} ELSE {v: NULL} END, event_id).v AS error,
coalesce(arg_max(event_id, CASE WHEN kind = 'result' THEN event_id END), 0)::BIGINT AS text_length, arg_max('t' || event_id, CASE WHEN kind = 'result' THEN event_id END) AS title
FROM l GROUP BY user_id""")
def job_items_latest(spark, d):
    e = F.col("event_type")
    kind = F.when(e == "purchase", "result").when(e == "error", "dead").when(e == "signup", "retry").otherwise("processing")
    status = F.when(e == "purchase", "completed").when(e == "error", "failed").when(e == "signup", "queued").otherwise("processing")
    tag = F.col("event_id").cast("string")
    log = table(spark, d, "events", "event_id", "user_id", "event_type").select(
        F.col("user_id").cast("string").alias("id"), F.lit("j").alias("job_id"), F.lit("u").alias("url"), F.col("event_id").alias("seq"), kind.alias("kind"), status.alias("status"),
        F.lit("fetch").alias("method"), F.concat(F.lit("t"), tag).alias("title"), F.lit("x").alias("text"), F.col("event_id").alias("text_length"), F.lit("u").alias("final_url"),
        F.when(kind.isin("dead", "retry"), F.concat(F.lit("e"), tag)).alias("error"), F.lit(1).alias("duration_ms"), F.lit("now").alias("ts"),
    )
    return jobs.latest_items(log).select("id", "status", "error", "text_length", "title")


@query("results_page", """SELECT event_id::VARCHAR AS id, event_type AS status FROM events WHERE user_id = (SELECT min(user_id) FROM events)
ORDER BY ts::DATE, event_id::VARCHAR LIMIT 7 OFFSET 7""")
def results_page(spark, d):
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type")
    first = e.agg(F.min("user_id")).first()[0]
    none = {c: F.lit(None).cast("string") for c in ("url", "method", "title", "final_url", "error", "updated_at")}
    items = e.select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("job_id"), F.col("event_type").alias("status"), F.to_date("ts").cast("string").alias("created_at"),
        F.lit(0).alias("text_length"), F.lit(0).alias("duration_ms"), *[v.alias(k) for k, v in none.items()],
    )
    return jobs.results_page(items, str(first), "2", "7").select("id", "status")


@query("result_positions", """SELECT event_id::VARCHAR AS id, user_id::VARCHAR AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY ts::DATE, event_id::VARCHAR) - 1 AS position FROM events""")
def result_positions(spark, d):
    """Where each item stands in its job, for all jobs: what pages are read by."""
    from textloom.streaming.paging import positions

    items = table(spark, d, "events", "event_id", "ts", "user_id").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("job_id"), F.to_date("ts").cast("string").alias("created_at")
    )
    return positions(items).select("id", "job_id", "position")


@query("retry_plan", """SELECT conv_id, turn, CASE WHEN turn >= 3 THEN 'fail' ELSE 'retry' END AS action,
CASE WHEN turn < 3 THEN least(30, greatest(2, pow(2, turn)))::BIGINT END AS delay_s FROM conversations""")
def retry_plan(spark, d):
    plan = jobs.retry_plan(F.col("turn"), text.retry_delay_seconds(F.col("turn")))
    return table(spark, d, "conversations", "conv_id", "turn").withColumn("p", plan).select("conv_id", "turn", "p.action", "p.delay_s")


@query("message_filter", """SELECT event_id FROM events WHERE event_id % 3 <> 1 AND event_id % 5 <> 2""")
def message_filter(spark, d):
    body = F.concat(
        F.lit('{"type": "'), F.when(F.col("event_id") % 3 == 1, "other").otherwise("scrape_url"), F.lit('", "jobId": "'), F.when(F.col("event_id") % 5 == 2, "").otherwise("j"),
        F.lit('", "itemId": "i", "url": "u"}'),
    )
    m = F.from_json(body, "type string, jobId string, itemId string, url string")
    return table(spark, d, "events", "event_id").filter(jobs.valid_message(m)).select("event_id")


@query("consume_idempotent", f"SELECT event_id::VARCHAR AS id, user_id AS job_id FROM events WHERE ({_ITEM_STATUS}) NOT IN ('completed', 'failed')")
def consume_idempotent(spark, d):
    from textloom.streaming.consumer import accept

    items = event_items(spark, d).withColumn("url", F.lit("u"))
    m = jobs.messages(items.select("id", "job_id", "url"))
    return accept(m.unionByName(m), items).select("id", "job_id")


@query("job_create", """SELECT 'item_' || lpad(pos::VARCHAR, greatest(3, length(pos::VARCHAR))::INTEGER, '0') || '_' || sha256(url)[1:8] AS id, job_id, url, 'queued' AS status, 'now' AS created_at
FROM (SELECT 'job_' || (page_id // 50) AS job_id, url, row_number() OVER (PARTITION BY page_id // 50 ORDER BY page_id) AS pos FROM pages)""")
def job_create(spark, d):
    """Lists of at most 50 URLs, as requests are."""
    p = table(spark, d, "pages", "page_id", "url").withColumn("j", F.floor(F.col("page_id") / 50))
    lists = p.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("page_id", "url"))).alias("l")).select("j", F.transform("l", lambda x: x["url"]).alias("urls"))
    made = jobs.create_job(lists, F.concat(F.lit("job_"), F.col("j").cast("string")), F.substring(F.sha2("url", 256), 1, 8), F.lit("now"))
    return made.drop("updated_at")


_TURN_STATUS = "CASE WHEN role = 'user' THEN 'processing' WHEN length(text) % 3 = 0 THEN 'failed' WHEN length(text) % 3 = 1 THEN 'completed' ELSE 'queued' END"


@query("job_counters", f"""
SELECT conv_id % 20 AS job_id, count(*) AS total, count_if(s IN ('completed', 'failed'))::BIGINT AS completed, count_if(s = 'completed')::BIGINT AS successful, count_if(s = 'failed')::BIGINT AS failed
FROM (SELECT conv_id, arg_max({_TURN_STATUS}, turn) AS s FROM conversations GROUP BY conv_id) GROUP BY conv_id % 20""")
def job_counters(spark, d):
    """Counters from the changes of item states: a conversation is an item, its turns are transitions, read as a stream."""
    from textloom.streaming import states

    at = scratch(spark, "counters")
    turns = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    log = spark.readStream.schema(turns.schema).parquet(f"{d}/conversations.parquet*")
    log = log.select(F.col("conv_id").cast("string").alias("id"), (F.col("conv_id") % 20).cast("string").alias("job_id"), F.col("turn").alias("seq"), F.expr(_TURN_STATUS).alias("status"))
    states.keep_changes(log, f"{at}/changes", f"{at}/c1").awaitTermination()
    changes = spark.readStream.schema(states.CHANGE).option("recursiveFileLookup", "true").parquet(f"{at}/changes")
    states.keep_counters(changes, lambda rows, n: rows.write.mode("overwrite").parquet(f"{at}/totals/batch_id={n}"), f"{at}/c2").awaitTermination()
    last = spark.read.parquet(f"{at}/totals").groupBy("job_id").agg(F.max_by(F.struct(*states.COUNTERS), "batch_id").alias("t"))
    return last.select(F.col("job_id").cast("bigint").alias("job_id"), "t.*")


@query("log_snapshot", """
WITH l AS (SELECT conv_id, turn, text, length(text) AS n, CASE WHEN role = 'user' THEN 'retry' WHEN length(text) % 3 = 0 THEN 'dead' ELSE 'result' END AS kind FROM conversations)
SELECT conv_id::VARCHAR AS id, arg_max(CASE kind WHEN 'result' THEN 'completed' WHEN 'dead' THEN 'failed' ELSE 'queued' END, turn) AS status,
arg_max(CASE WHEN kind <> 'result' THEN {v: 'e' || turn} ELSE {v: NULL} END, turn).v AS error,
nullif(arg_max(CASE WHEN kind = 'result' THEN text END, CASE WHEN kind = 'result' THEN turn END), '') AS text,
coalesce(arg_max(n, CASE WHEN kind = 'result' THEN turn END), 0)::BIGINT AS text_length FROM l GROUP BY conv_id""")
def log_snapshot(spark, d):
    """Item states from a snapshot, folded in twice, and the tail since: turns as transitions, two to a batch."""
    from textloom.streaming import store

    log = scratch(spark, "log")
    kind = F.when(F.col("role") == "user", "retry").when(F.length("text") % 3 == 0, "dead").otherwise("result")
    status = F.when(F.col("kind") == "result", "completed").when(F.col("kind") == "dead", "failed").otherwise("queued")
    result = lambda c: F.when(F.col("kind") == "result", c)
    rows = table(spark, d, "conversations", "conv_id", "turn", "role", "text").withColumn("kind", kind).withColumns({
        "id": F.col("conv_id").cast("string"), "job_id": F.lit("j"), "url": F.lit("u"), "seq": F.col("turn"), "status": status, "method": result(F.lit("fetch")), "title": result(F.lit("t")),
        "text": result(F.col("text")), "text_length": result(F.length("text")), "final_url": result(F.lit("u")), "error": F.when(F.col("kind") != "result", F.concat(F.lit("e"), "turn")),
        "duration_ms": result(F.lit(1)), "ts": F.lit("now"),
    })
    rows = rows.select(F.least(F.floor(F.col("turn") / 2), F.lit(4)).alias("batch_id"), *[F.col(f.name).cast(f.dataType) for f in ITEM_LOG.fields])
    rows.repartition("batch_id", F.pmod(F.xxhash64("id"), F.lit(8))).write.partitionBy("batch_id").parquet(log)
    for through in (0, 1):
        store.compact(spark, log, through)
    return jobs.latest_items(store.read_log(spark, log)).select("id", "status", "error", "text", "text_length")
