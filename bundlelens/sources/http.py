"""Captured HTTP traffic as tables: what would be requested, with which headers and cookies, and where it ends.

The engine reads captured rows. Nothing here opens a connection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bundlelens import rules
from bundlelens.functions import numbers, urls
from bundlelens.operators.graphs import aliases


def distinct_requests(refs: DataFrame, order: str) -> DataFrame:
    """The first of the references with equal type and url."""
    first = refs.groupBy("type", "url").agg(F.min_by(F.struct(*[c for c in refs.columns if c not in ("type", "url")]), order).alias("_r"))
    return first.select("type", "url", "_r.*")


def _resource(type_: Column, field: int) -> Column:
    found = F.lit(rules.RESOURCE_TYPES[-1][field])
    for row in rules.RESOURCE_TYPES[:-1]:
        found = F.when(type_ == row[0], row[field]).otherwise(found)
    return found


def request_headers(url: Column, type_: Column, referrer: Column, cookie: Column, user_initiated: Column) -> Column:
    """array<struct<name, value>>: a browser's headers in their order, which documents and other resources differ in."""
    mode, where = _resource(type_, 2), urls.fetch_site(url, referrer)
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    fixed = lambda name, value: h(name, F.lit(value))
    document = [
        fixed("sec-ch-ua", rules.SEC_CH_UA), fixed("sec-ch-ua-mobile", "?0"), fixed("sec-ch-ua-platform", rules.PLATFORM), fixed("upgrade-insecure-requests", "1"), fixed("user-agent", rules.USER_AGENT),
        h("accept", _resource(type_, 1)), h("sec-fetch-site", where), h("sec-fetch-mode", mode), h("sec-fetch-user", F.when(F.coalesce(user_initiated, F.lit(True)), "?1")), h("sec-fetch-dest", _resource(type_, 3)),
    ]
    other = [
        fixed("sec-ch-ua-platform", rules.PLATFORM), fixed("user-agent", rules.USER_AGENT), fixed("sec-ch-ua", rules.SEC_CH_UA), fixed("sec-ch-ua-mobile", "?0"), h("accept", _resource(type_, 1)),
        h("origin", F.when((mode == "cors") & referrer.isNotNull() & (urls.origin(referrer) != urls.origin(url)), urls.origin(referrer))), h("sec-fetch-site", where), h("sec-fetch-mode", mode), h("sec-fetch-dest", _resource(type_, 3)),
    ]
    last = [h("referer", urls.referer(url, referrer)), fixed("accept-encoding", rules.ACCEPT_ENCODING), fixed("accept-language", rules.ACCEPT_LANGUAGE), h("cookie", cookie), h("priority", _resource(type_, 4))]
    return F.filter(F.concat(F.when(type_ == "document", F.array(*document)).otherwise(F.array(*other)), F.array(*last)), lambda x: x["value"].isNotNull() & (x["value"] != ""))


def retry_plan(requests: DataFrame, most: int = 2) -> DataFrame:
    """Adds retryable and the waits before each further try to rows with a status (null: no answer)."""
    again = F.col("status").isNull() | F.col("status").isin(rules.RETRYABLE)
    waits = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda n: numbers.backoff_ms(n))
    return requests.withColumn("retryable", again).withColumn("waits_ms", F.when(again, waits).otherwise(F.array().cast("array<bigint>")))


def follow_redirects(redirects: DataFrame, most: int = rules.MAX_REDIRECTS) -> DataFrame:
    """(url, final_url, hops, failed): where redirects (src, dst) end; failed where they go on after `most` hops."""
    ends = aliases(redirects, most)
    more = redirects.select(F.col("src").alias("_more")).distinct()
    return ends.join(more, F.col("dst") == F.col("_more"), "left").select(F.col("src").alias("url"), F.col("dst").alias("final_url"), "hops", F.col("_more").isNotNull().alias("failed"))


def parse_cookies(headers: DataFrame) -> DataFrame:
    """Adds cookie (null if it is rejected) to rows with url and set_cookie; `now` is the time column if there is one."""
    pair = F.regexp_extract("set_cookie", r"^([^;]*)", 1)
    attributes = F.transform(F.slice(F.split("set_cookie", ";"), 2, 1 << 16), lambda a: F.struct(F.lower(F.trim(F.regexp_extract(a, r"^([^=]*)", 1))).alias("k"), F.trim(F.regexp_extract(a, r"=(.*)$", 1)).alias("v")))
    rows = headers.withColumn("_a", attributes)
    last = lambda key, test=None: F.try_element_at(F.filter("_a", lambda a: (a["k"] == key) & (test(a["v"]) if test else F.lit(True))), F.lit(-1))["v"]
    host, p = urls.host(F.col("url")), urls.path(F.col("url"))
    domain = F.lower(F.regexp_replace(last("domain", lambda v: v != ""), r"^\.", ""))
    directory = F.regexp_replace(p, r"/[^/]*$", "")
    same_site = F.lower(last("samesite"))
    max_age = last("max-age", lambda v: v.rlike(r"^-?\d{1,15}$")).cast("long")
    expires = F.try_to_timestamp(F.regexp_replace(last("expires"), r"^\w+, | GMT$|-", " "), F.lit(" dd MMM yyyy HH:mm:ss "))
    accepted = pair.rlike("^[^=]+=") & (domain.isNull() | (host == domain) | host.endswith(F.concat(F.lit("."), domain)))
    cookie = F.struct(
        F.trim(F.regexp_extract(pair, r"^([^=]*)", 1)).alias("name"), F.trim(F.regexp_extract(pair, r"=(.*)$", 1)).alias("value"), F.coalesce(domain, host).alias("domain"), domain.isNull().alias("host_only"),
        F.coalesce(last("path", lambda v: v.startswith("/")), F.when(directory == "", "/").otherwise(directory)).alias("path"), F.exists("_a", lambda a: a["k"] == "secure").alias("secure"),
        F.when(same_site.isin("none", "strict"), same_site).otherwise("lax").alias("same_site"), max_age.alias("max_age"), expires.alias("expires"),
    )
    return rows.withColumn("cookie", F.when(accepted, cookie)).drop("_a")


def store_cookies(headers: DataFrame, order: Column, now: Column) -> DataFrame:
    """(domain, path, name, value, host_only, secure, same_site, expires_at): the jar after all Set-Cookie headers (url,
    set_cookie) in `order`. The last one of a domain, path and name counts; expired ones are no more."""
    parsed = parse_cookies(headers.withColumn("_order", order)).where("cookie IS NOT NULL").select("cookie.*", "_order")
    # a relative age counts from `now`: this is a capture, not a running client
    ends = F.when(F.col("max_age").isNotNull(), F.timestamp_seconds(F.unix_timestamp(now) + F.col("max_age"))).otherwise(F.col("expires"))
    rows = parsed.withColumn("expires_at", ends)
    kept = rows.groupBy("domain", "path", "name").agg(F.max_by(F.struct("value", "host_only", "secure", "same_site", "expires_at"), "_order").alias("c")).select("domain", "path", "name", "c.*")
    return kept.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def cookie_headers(requests: DataFrame, jar: DataFrame) -> DataFrame:
    """(request_id, cookie): the Cookie header of requests (request_id, url, cross_site); no row where none applies.

    Requests meet cookies by the suffixes of their host, so the join is on equality; paths are tested after it.
    """
    labels = F.split(urls.host(F.col("url")), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = requests.select("request_id", "cross_site", urls.scheme(F.col("url")).alias("_scheme"), urls.host(F.col("url")).alias("_host"), urls.path(F.col("url")).alias("_path"), F.explode(suffixes).alias("domain"))
    met = asked.join(jar, "domain")
    below = F.when(F.col("path").endswith("/"), F.col("path")).otherwise(F.concat(F.col("path"), F.lit("/")))
    fits = ((F.col("_host") == F.col("domain")) | ~F.col("host_only")) & ((F.col("_path") == F.col("path")) | F.col("_path").startswith(below)) & (~F.col("secure") | (F.col("_scheme") == "https")) & (~F.col("cross_site") | (F.col("same_site") == "none"))
    sent = met.where(fits).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct((-F.length("path")).alias("n"), "name", "value"))).alias("c"))
    return sent.select("request_id", F.array_join(F.transform("c", lambda c: F.concat(c["name"], F.lit("="), c["value"])), "; ").alias("cookie"))


def sitemap_pages(files: DataFrame, origin: Column) -> DataFrame:
    """(url, nested): what captured sitemaps (url, body) list within `origin`; nested ones are sitemaps themselves."""
    maps = files.where(F.col("body").rlike(r"<(urlset|sitemapindex)\b"))
    found = maps.select("url", F.explode(F.regexp_extract_all("body", F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), 1)).alias("loc"))
    listed = found.select(urls.resolve(F.replace("loc", F.lit("&amp;"), F.lit("&")), F.col("url")).alias("url")).where(urls.origin(F.col("url")) == origin).distinct()
    return listed.withColumn("nested", urls.path(F.col("url")).rlike(r"(?i)\.xml$"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """(url) of the sitemaps that robots.txt bodies name."""
    return robots.select(F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)).alias("url")).distinct()


def capped(responses: DataFrame, most: int = 50 << 20) -> DataFrame:
    """Responses whose bodies are no larger than the cap."""
    return responses.where(F.octet_length("body") <= most)


def frontier(pages: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """The next pages to visit: links (depth, page_ord, link_ord, link) not yet among `pages` (url), in the order of
    their discovery, `most` of them (the crawl's limit)."""
    keyed = links.withColumn("key", urls.page_key(F.col("link"))).where(~F.col("link").rlike(rules.NON_PAGE))
    known = pages.select(urls.page_key(F.col("url")).alias("key")).distinct()
    first = keyed.join(known, "key", "left_anti").groupBy("key").agg(F.min(F.struct("depth", "page_ord", "link_ord", "link")).alias("at"))
    return first.orderBy("at").limit(most).select("key", "at.*")


def page_of_entry(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds pageref to log entries (entry_id, url, initiator): the first page (ord, url) that is the entry or its
    initiator, else the first page of all."""
    first = F.lit(pages.agg(F.min("ord")).first()[0])
    initiator = F.regexp_replace("initiator", r"^[\w-]+:", "")
    keys = entries.select("entry_id", F.explode(F.array_distinct(F.array("url", initiator))).alias("_u"))
    met = keys.join(pages.select(F.col("url").alias("_u"), "ord"), "_u").groupBy("entry_id").agg(F.min("ord").alias("_o"))
    return entries.join(met, "entry_id", "left").withColumn("pageref", F.concat(F.lit("page_"), F.coalesce("_o", first).cast("string"))).drop("_o")


def har_entries(log: DataFrame) -> DataFrame:
    """(entry): a HAR 1.2 entry as JSON for every row of a network log with pageref."""
    query = F.transform(F.filter(F.split(F.substring(urls.query(F.col("url")), 2, 1 << 20), "&"), lambda x: x != ""), lambda x: F.struct(F.url_decode(F.regexp_extract(x, r"^([^=]*)", 1)).alias("name"), F.coalesce(F.try_url_decode(F.regexp_extract(x, r"=(.*)$", 1)), F.lit("")).alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    request = F.struct(F.lit("GET").alias("method"), "url", F.lit("HTTP/1.1").alias("httpVersion"), F.col("request_headers").alias("headers"), query.alias("queryString"), none.alias("cookies"), F.lit(-1).alias("headersSize"), F.lit(0).alias("bodySize"))
    content = F.struct("size", F.col("mime_type").alias("mimeType"))
    response = F.struct("status", F.coalesce("error", "status_text").alias("statusText"), F.lit("HTTP/1.1").alias("httpVersion"), F.col("response_headers").alias("headers"), none.alias("cookies"), content.alias("content"), F.coalesce("redirect_to", F.lit("")).alias("redirectURL"), F.lit(-1).alias("headersSize"), F.col("size").alias("bodySize"))
    timings = F.struct(F.lit(0).alias("send"), F.col("time_ms").alias("wait"), F.lit(0).alias("receive"))
    entry = F.struct("pageref", numbers.iso(F.col("started_at")).alias("startedDateTime"), F.col("time_ms").alias("time"), request.alias("request"), response.alias("response"), F.create_map().cast("map<string,string>").alias("cache"), timings.alias("timings"), F.col("type").alias("_resourceType"), F.col("initiator").alias("_initiator"))
    return log.select(F.to_json(entry).alias("entry"))
