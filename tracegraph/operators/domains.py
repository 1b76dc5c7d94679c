"""Domain, URL, query and search-result scoring.

The word lists are fixed and short, so they sit inside the expressions: no
join, no shuffle, nothing that grows with the data is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions import fixed, urls
from tracegraph.functions.text import any_word, compute_once, count_char, ends_with_any, entropy, word_hits
from tracegraph.operators.views import flag


def lit_array(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


# ------------------------------------------------------------------ predicates
def is_web_page_url(url: str) -> Column:
    return ~F.lower(urls.path(url)).rlike(fixed.BINARY_EXT_PATTERN) & ~F.col(url).rlike(fixed.IP_SINGLE_LETTER_PATTERN)


def is_browsable_domain(domain: str) -> Column:
    d = F.trim(F.lower(F.col(domain)))
    return ~d.rlike(fixed.INFRA_PATTERN) & ~ends_with_any(d, fixed.INFRA_SUFFIXES)


def is_browsable_ranked(domain: str) -> Column:
    d = F.lower(F.col(domain))
    return (~any_word(d, fixed.RANKED_INFRA_WORDS) & ~ends_with_any(d, ["." + t for t in fixed.RANKED_INFRA_TLDS])
            & ~d.rlike(urls.IP_RE))


def _is_allowed() -> Column:
    return F.col("_reg").isin(fixed.ALLOWED_DOMAINS) | F.col("_d").isin(fixed.ALLOWED_DOMAINS)


def allowlist_semi(df: DataFrame, domain: str = "domain") -> DataFrame:
    return _domain_parts(df, domain).filter(_is_allowed()).select(*df.columns)


def is_interesting(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add ``interesting``: worth a visit by brand, suspicious ending with keyword, or shape."""
    x = _domain_parts(df, domain)
    full, suffix, d = F.concat("_sub", F.lit("."), "_sld"), F.col("_suffix"), F.col("_d")
    official = ends_with_any(F.concat(F.lit("."), suffix), ["." + s for s in fixed.OFFICIAL_SUFFIXES])
    infra = F.contains(d, F.lit("sslproxy.gateway")) | F.contains(d, F.lit(".internal."))
    wanted = (any_word(full, fixed.FEED_BRANDS) | (suffix.isin(fixed.FEED_TLDS) & any_word(full, fixed.FEED_KEYWORDS))
              | (F.length("_sub") > 30) | (count_char("_sld", "-") >= 3))
    return compute_once(x, {"interesting": ~_is_allowed() & ~official & ~infra & wanted}).select(*df.columns, "interesting")


# ------------------------------------------------------------------ 0..1 score
def brand_impersonation(domain: Column, label: Column) -> Column:
    brands = lit_array(fixed.TARGET_BRANDS)
    inside = F.exists(brands, lambda b: F.contains(label, b) & (b != label))
    near = F.exists(lit_array([b for b in fixed.TARGET_BRANDS if len(b) > 4]), lambda b: (
        (F.abs(F.length(b) - F.length(label)) <= 2) & ~(F.contains(label, b) & (b != label))
        & (F.levenshtein(b, label, 2) >= 0)))
    anywhere = F.exists(brands, lambda b: F.contains(domain, b)) & (F.size(F.split(domain, r"\.")) > 2)
    return F.when(near, 0.4).when(inside, 0.35).when(anywhere, 0.3).otherwise(0.0)


def keyword_axis(domain: Column) -> Column:
    n = word_hits(domain, fixed.PHISH_KEYWORDS)
    return F.when(n >= 3, 0.2).when(n >= 2, 0.15).when(n >= 1, 0.08).otherwise(0.0)


def structure_axis(domain: Column, label: Column) -> Column:

    def part(cond, value):
        return F.when(cond, F.lit(value)).otherwise(F.lit(0.0))

    total = (part(F.size(F.split(domain, r"\.")) > 4, 0.08) + part(F.length(domain) > 50, 0.05)
             + part(count_char(domain, "-") >= 3, 0.07) + part(domain.rlike(r"\d{1,3}[-\.]\d{1,3}[-\.]\d{1,3}"), 0.05)
             + part((F.length(label) > 8) & (entropy(label) > 3.5), 0.05))
    return F.least(total, F.lit(0.15))


def domain_score(df: DataFrame, domain: str = "domain") -> DataFrame:
    """Add the five axes, the capped score and the reasons."""
    low = F.trim(F.lower(F.col(domain)))
    base = compute_once(df, {"_d": low, "_label": F.split_part(low, F.lit("."), F.lit(1))})
    d, label = F.col("_d"), F.col("_label")
    axes = {
        "brand_impersonation": brand_impersonation(d, label), "suspicious_keywords": keyword_axis(d),
        "high_risk_tld": F.when(ends_with_any(d, ["." + t for t in fixed.HIGH_RISK_TLDS]), 0.15).otherwise(0.0),
        "structural_anomaly": structure_axis(d, label),
        "abused_hosting": F.when(ends_with_any(d, fixed.ABUSED_HOSTS), 0.1).otherwise(0.0)}
    out = compute_once(base, axes)
    total = F.col("brand_impersonation")
    for k in list(axes)[1:]:
        total = total + F.col(k)
    reasons = F.filter(F.array(*[F.when(F.col(k) > 0, F.format_string(k + ":%.2f", F.col(k))) for k in axes]),
                       lambda x: x.isNotNull())
    out = compute_once(out, {"score": F.least(F.round(total, 6), F.lit(1.0)), "reasons": reasons})
    return out.select(*df.columns, "score", "reasons")


def score_bands(score: str = "score") -> Column:
    return F.when(F.col(score) >= 0.7, "high").when(F.col(score) >= 0.4, "medium").otherwise("low")


# ------------------------------------------------------------------ points score
def brand_contains(sld: Column, sub: Column, brands) -> Column:
    """First brand, in dictionary order, with a keyword in the label or the subdomain."""
    expr = None
    for brand, kws in brands:
        cond = any_word(sld, kws) | any_word(sub, kws)
        expr = F.when(cond, F.lit(brand)) if expr is None else expr.when(cond, F.lit(brand))
    return expr


def official_suffix(registered: Column, brand: Column, official: dict) -> Column:
    expr = None
    for b, ends in official.items():
        cond = (brand == b) & ends_with_any(registered, ends)
        expr = cond if expr is None else expr | cond
    return expr


def _domain_parts(df: DataFrame, domain: str) -> DataFrame:
    d = F.trim(F.replace(F.lower(F.col(domain)), F.lit("*."), F.lit("")))
    x = compute_once(df, {"_d": d})
    return compute_once(x, {"_sld": urls.sld_of("_d"), "_sub": urls.subdomain_of("_d"), "_suffix": urls.suffix_of("_d"),
                            "_reg": urls.registered_of("_d")})


def _points(tlds, indicators) -> Column:
    c = F.col
    hits = word_hits(c("_d"), indicators)
    hy = count_char(c("_sld"), "-")
    subs = F.size(F.filter(F.split(c("_sub"), r"\."), lambda s: s != ""))
    return (15 * F.least(hits, F.lit(3)) + F.when(c("_suffix").isin(tlds), 20).otherwise(0)
            + F.when(F.length("_sld") > 20, 10).otherwise(0) + F.when(hy >= 2, 10 * F.least(hy.cast("int"), F.lit(3))).otherwise(0)
            + F.when(subs >= 2, 5 * subs).otherwise(0))


def domain_points_ct(df: DataFrame, domain: str = "domain") -> DataFrame:
    x = compute_once(_domain_parts(df, domain),
                     {"brand": brand_contains(F.col("_sld"), F.col("_sub"), fixed.CT_BRAND_KEYWORDS)})
    more = (F.when(F.col("_sld").rlike("[0-9]"), 10).otherwise(0)
            + F.when(any_word(F.col("_d"), fixed.CT_HOSTING), 15).otherwise(0))
    score = (F.when(F.col("brand").isNull(), 0).when(official_suffix(F.col("_reg"), F.col("brand"), fixed.CT_OFFICIAL), -1)
             .otherwise(30 + _points(fixed.CT_TLDS, fixed.CT_INDICATORS) + more))
    return compute_once(x, {"points": score.cast("int")}).select(*df.columns, "brand", "points")


def domain_points_live(df: DataFrame, domain: str = "domain") -> DataFrame:
    x = compute_once(_domain_parts(df, domain),
                     {"brand": brand_contains(F.col("_sld"), F.col("_sub"), fixed.LIVE_BRAND_KEYWORDS)})
    score = (F.when(F.col("brand").isNotNull() & official_suffix(F.col("_reg"), F.col("brand"), fixed.LIVE_OFFICIAL), -1)
             .otherwise(F.when(F.col("brand").isNotNull(), 30).otherwise(0) + _points(fixed.LIVE_TLDS, fixed.LIVE_INDICATORS)))
    return compute_once(x, {"points": score.cast("int")}).select(*df.columns, "brand", "points")


def brand_edit(df: DataFrame, domain: str = "domain", distance: int = 2) -> DataFrame:
    """Brands within the edit distance of the first label, one row per match."""
    label = F.split_part(F.lower(F.col(domain)), F.lit("."), F.lit(1))
    near = F.filter(lit_array([b for b in fixed.TARGET_BRANDS if len(b) > 4]), lambda b: (
        (F.abs(F.length(b) - F.length(label)) <= distance) & (F.levenshtein(b, label, distance) >= 0)))
    return df.select("*", F.explode(near).alias("brand"), label.alias("label"))


# ------------------------------------------------------------------ queries and search results
def query_score(df: DataFrame, query: str = "query", category: str = "category") -> DataFrame:
    q = F.lower(F.col(query))
    weight = F.lit(1.0)
    for name, w, _ in fixed.QUERY_CATEGORIES:
        weight = F.when(F.col(category) == name, F.lit(w)).otherwise(weight)
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))

    def capped(ws, unit, top):
        return F.least(word_hits(q, ws) * F.lit(unit), F.lit(top))

    score = (weight * 0.1 + capped([b.lower() for b in fixed.QUERY_BRANDS], 0.15, 0.3) + capped(fixed.QUERY_ACTIONS, 0.1, 0.2)
             + capped(fixed.QUERY_URGENCY, 0.1, 0.2) + capped(fixed.QUERY_TECHNICAL, 0.05, 0.1)
             + F.when(words >= 3, 0.05).otherwise(0.0))
    return df.withColumn("expected_toxicity", F.least(F.round(score, 6), F.lit(1.0)))


def query_generate(brands: DataFrame, urgency_brands: int = 20, samples: int = 3, max_queries: int | None = None) -> DataFrame:
    """Queries from brands (brand, brand_rank) and fixed phrase lists; a repeated text keeps its last writer.

    The phrase lists are exploded per brand row, so the work is linear in the
    number of brands. Where a random sample of phrases is called for, the first
    ``samples`` by md5 of brand and phrase are taken.
    """
    c = F.col

    def rows(phrases, fmt, category, source, stage, cond=F.lit(True)):
        e = brands.filter(cond).select("brand", "brand_rank", F.posexplode(lit_array(phrases)).alias("i", "p"))
        return e.select(fmt(c("brand"), c("p")).alias("query"), F.lit(category).alias("category"),
                        F.lit(source).alias("source"), F.struct(F.lit(stage).alias("s"), c("brand_rank").cast("long").alias("b"),
                                                                c("i").cast("long").alias("i")).alias("seq"))

    def sampled(phrases):
        ranked = F.slice(F.array_sort(F.transform(lit_array(phrases), lambda p: F.struct(
            F.md5(F.concat(c("brand"), F.lit("|"), p)).alias("h"), p.alias("p")))), 1, samples)
        return F.transform(ranked, lambda x: x["p"])

    def join2(a, b):
        return F.concat(a, F.lit(" "), b)

    out = rows(fixed.QUERY_ACTIONS, join2, "credential_harvest", "brand_action_template", 0).unionByName(
        rows(fixed.QUERY_URGENCY, join2, "urgency_social_eng", "brand_urgency_template", 1, c("brand_rank") < urgency_brands))
    stage = 2
    for category, _, templates in fixed.QUERY_CATEGORIES:
        for template in templates:
            slot = "{urgency}" if "{urgency}" in template else "{tech_pattern}" if "{tech_pattern}" in template else ""
            fills = (sampled(fixed.QUERY_URGENCY) if slot == "{urgency}" else sampled(fixed.QUERY_TECHNICAL)
                     if slot else F.array(F.lit("")))
            e = brands.select("brand", "brand_rank", F.posexplode(fills).alias("i", "p"))
            text = F.replace(F.lit(template), F.lit("{brand}"), c("brand"))
            text = F.replace(text, F.lit(slot), c("p")) if slot else text
            out = out.unionByName(e.select(text.alias("query"), F.lit(category).alias("category"),
                                           F.lit("category_template").alias("source"),
                                           F.struct(F.lit(stage).alias("s"), c("brand_rank").cast("long").alias("b"),
                                                    c("i").cast("long").alias("i")).alias("seq")))
            stage += 1
    out = query_dedup(out)
    scored = query_score(out)
    return scored if max_queries is None else scored.orderBy(F.desc("expected_toxicity"), "query_key").limit(max_queries)


def query_dedup(queries: DataFrame) -> DataFrame:
    """One row per lower-cased query; the last writer by ``seq`` wins."""
    return queries.groupBy(F.lower("query").alias("query_key")).agg(
        F.max_by(F.struct("query", "category", "source"), "seq").alias("r")).select("query_key", "r.*")


def serp_score(serp: DataFrame) -> DataFrame:
    scored = domain_score(serp).withColumnRenamed("score", "domain_part").drop("reasons")
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    low = F.lower("url")
    title, dom = F.lower("title"), F.lower("domain")
    mismatch = F.exists(lit_array(fixed.TARGET_BRANDS), lambda b: F.contains(title, b) & ~F.contains(dom, b))
    score = (F.col("domain_part") * 0.4 + F.least(word_hits(text, fixed.SNIPPET_PHRASES) * F.lit(0.08), F.lit(0.25))
             + F.when(low.rlike(r"https?://\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"), 0.15).otherwise(0.0)
             + F.least(word_hits(low, fixed.SERP_PATHS) * F.lit(0.05), F.lit(0.15))
             + F.when(F.col("position") > 10, 0.05).when(F.col("position") > 5, 0.03).otherwise(0.0)
             + F.when(F.col("title_mismatch") == 1, 0.2).otherwise(0.0))
    scored = compute_once(scored, {"title_mismatch": flag(mismatch)})
    return compute_once(scored, {"score": F.least(F.round(score, 6), F.lit(1.0))}).drop("domain_part")


def query_toxicity(scored: DataFrame, threshold: float = 0.25) -> DataFrame:
    return scored.groupBy("query").agg(
        F.count(F.lit(1)).alias("results"), F.count_if(F.col("score") >= threshold).alias("suspicious"),
        F.avg((F.col("score") >= threshold).cast("int")).alias("toxicity"))


# ------------------------------------------------------------------ squatting shapes
def squat_generate(keywords: DataFrame, indicators=fixed.SQUAT_INDICATORS, tlds=fixed.SQUAT_TLDS) -> DataFrame:
    """Candidate domains of each keyword row: three shapes per indicator and top-level domain."""
    e = keywords.select("keyword", F.explode(lit_array(indicators)).alias("ind")).select(
        "keyword", "ind", F.explode(lit_array(tlds)).alias("tld"))
    k, i, t, dash, dot = F.col("keyword"), F.col("ind"), F.col("tld"), F.lit("-"), F.lit(".")
    shapes = F.array(F.concat(k, dash, i, dot, t), F.concat(i, dash, k, dot, t), F.concat(k, i, dot, t))
    return e.select("keyword", F.explode(shapes).alias("domain"))


def affix_generate(keywords: DataFrame) -> DataFrame:
    """Prefix and suffix shapes."""
    both = F.array_union(F.transform(lit_array(fixed.AFFIX_PREFIXES), lambda p: F.concat(p, F.col("keyword"))),
                         F.transform(lit_array(fixed.AFFIX_SUFFIXES), lambda s: F.concat(F.col("keyword"), s)))
    e = keywords.select("keyword", F.explode(both).alias("name")).select(
        "keyword", "name", F.explode(lit_array(fixed.AFFIX_TLDS)).alias("tld"))
    return e.select("keyword", F.concat_ws(".", "name", "tld").alias("domain"))


def squat_hits(observed: DataFrame, candidates: DataFrame) -> DataFrame:
    """Observed domains that are candidates (name resolution is outside; observation stands in for it)."""
    return observed.join(candidates.select("domain").distinct(), "domain", "left_semi")
