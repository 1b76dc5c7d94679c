"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from tracegraph.functions import sqlfuncs, text, urls
from tracegraph.plans.base_sql import DOM, ENT, HOSTS, I, NETLOC, PATH, QUERY, R, SCHEME, sql
from tracegraph.plans.cat_rules import C48, HOSTN
from tracegraph.plans.registry import query

PARAM = lambda q: (f"len(list_distinct(list_transform(list_filter(string_split({q}, '&'), lambda x: regexp_matches(x, '^[^=]*=.+')), "
                   "lambda x: split_part(x, '=', 1))))")


@query("url_functions", sql(HOSTS, f"""SELECT page_id, source, {SCHEME('url')} AS scheme, {NETLOC('url')} AS netloc, {PATH('url')} AS path,
  {QUERY('url')} AS query, {HOSTN('url')} AS hostname, {DOM('url')} AS domain, {I(PARAM(QUERY('url')))} AS n_params FROM hosts"""))
def _(t):
    return t.hosts.select("page_id", "source", urls.scheme("url").alias("scheme"), urls.netloc("url").alias("netloc"), urls.path("url").alias("path"),
                          urls.query("url").alias("query"), urls.hostname("url").alias("hostname"), urls.domain_of("url").alias("domain"),
                          urls.num_params("url").alias("n_params"))


@query("text_entropy", sql(HOSTS, f"SELECT doc_id, {R(ENT('text'))} AS entropy FROM documents"))
def _(t):
    return t.raw("documents").select("doc_id", text.entropy("text").alias("entropy"))


@query("char_counts", sql(HOSTS, """SELECT doc_id, length(text)::BIGINT AS n_chars, length(regexp_replace(text, '[^0-9]', '', 'g'))::BIGINT AS n_digits,
  (length(text) - length(replace(text, '-', '')))::BIGINT AS n_dashes, substr(md5(text), 1, 12) AS short_hash, substr(md5(text), 1, 16) AS hash16 FROM documents"""))
def _(t):
    return t.raw("documents").select("doc_id", F.length("text").alias("n_chars"), text.count_digits("text").alias("n_digits"),
                                     text.count_char("text", "-").cast("long").alias("n_dashes"), text.short_md5("text").alias("short_hash"),
                                     text.short_md5("text", 16).alias("hash16"))


@query("sql_functions", sql(HOSTS, f"SELECT page_id, source, {DOM('url')} AS domain, {R(ENT('domain'))} AS entropy, {C48('url')} AS code FROM hosts"))
def _(t):
    sqlfuncs.register(t.spark)
    t.hosts.createOrReplaceTempView("tracegraph_hosts")
    return t.spark.sql("SELECT page_id, source, tg_domain_of(url) AS domain, tg_entropy(domain) AS entropy, tg_code48(url) AS code FROM tracegraph_hosts")
