"""URL, HTML, date and JSON functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

URL = r"https?://[^\s<>\"'`\[\](){}|\\^]*[^\s<>\"'`\[\](){}|\\^.,;:!?]"
# Names of the own machine.
LOCAL_NAMES = ("localhost", "0.0.0.0", "broadcasthost", "ip6-localhost", "ip6-loopback", "::1", "::")


def urls(text: Column) -> Column:
    """The http(s) URLs of a text in order, each once; closing punctuation does not belong to them."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(URL), F.lit(0)))


def url_host(url: Column) -> Column:
    """Host with port, as written; null without one."""
    host = F.regexp_extract(url, r"^[^:]*://([^/]*)", 1)
    return F.when(host != "", host)


def bare_host(url: Column) -> Column:
    """Lower-case host without user and port; an IPv6 literal without brackets."""
    authority = F.regexp_extract(url, r"^[^:]*://([^/]*)", 1)
    own = F.regexp_replace(authority, r"^.*@", "")
    v6 = F.regexp_extract(own, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(own.startswith("["), v6).otherwise(F.regexp_replace(own, r":[^:]*\z", "")))


def is_safe_url(url: Column) -> Column:
    """Whether a URL may be fetched: http(s), a host, and none of the own machine or a private network, by its text alone."""
    host = bare_host(url)
    octet = lambda i: F.regexp_extract(host, r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})\z", i).try_cast("int")
    a, b, c, d = (octet(i) for i in (1, 2, 3, 4))
    v4 = a.isNotNull() & (a < 256) & (b < 256) & (c < 256) & (d < 256)
    private = v4 & ((a == 127) | (a == 10) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 0) & (b == 0) & (c == 0) & (d == 0)) | ((a == 255) & (b == 255) & (c == 255) & (d == 255)))
    v6 = host.contains(":") & host.rlike(r"^(?:f[cd][0-9a-f]{2}|fe[89ab][0-9a-f]):")
    own = host.isin(*LOCAL_NAMES) | host.endswith(".localhost")
    return F.coalesce(url.rlike(r"^https?://") & (host != "") & ~own & ~F.coalesce(private, F.lit(False)) & ~v6, F.lit(False))


def html_title(html: Column) -> Column:
    """Trimmed text of the first title; null without one."""
    got = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"^[ \t\r\n\f]+|[ \t\r\n\f]+\z", "")
    return F.when(got != "", got)


def rfc3339(text: Column) -> Column:
    """Epoch seconds of an integer or a time with Z or an offset; null for anything else."""
    form = r"^(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(?:Z|([+-])(\d{2}):(\d{2}))"
    base = F.unix_seconds(F.try_to_timestamp(F.concat(F.regexp_extract(text, form, 1), F.lit("+00:00")), F.lit("yyyy-MM-dd'T'HH:mm:ssXXX")))
    hours, minutes = (F.regexp_extract(text, form, i).try_cast("int") for i in (3, 4))
    off = F.coalesce(hours * 3600 + minutes * 60, F.lit(0))
    stamp = F.when(F.regexp_extract(text, form, 2) == "-", base + off).otherwise(base - off)
    return F.when(text.rlike(r"^-?\d+\z"), text.try_cast("long")).otherwise(F.when(text.rlike(form), stamp))


def delay_seconds(text: Column) -> Column:
    """Seconds of '1h30m', '2d' or a bare number; null for anything else and for no time at all."""
    part = lambda unit, n: F.aggregate(F.regexp_extract_all(text, F.lit(rf"(\d+){unit}"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * n)
    total = part("d", 86400) + part("h", 3600) + part("m", 60) + part("s", 1)
    return F.when(text.rlike(r"^-?\d+\z"), text.try_cast("long")).when(text.rlike(r"^(?:\d+[dhms])+\z") & (total > 0), total)


def allow_rules(rules: DataFrame) -> DataFrame:
    """(key, wild) of rules(rule): one entry a row, `#` begins a comment, case does not count."""
    entry = F.lower(F.trim(F.substring_index("rule", "#", 1)))
    own = rules.select(entry.alias("rule")).filter("rule <> ''")
    return own.select(F.regexp_replace("rule", r"^\*?\.", "").alias("key"), F.col("rule").rlike(r"^\*?\.").alias("wild")).filter("key <> ''").distinct()


def host_ends(host: Column) -> Column:
    """array<struct<key, whole>>: a host's own endings at its dots, the first the host itself."""
    parts = F.split(F.lower(F.regexp_replace(host, r"\.+\z", "")), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.array_join(F.slice(parts, i, F.size(parts)), ".").alias("key"), (i == 1).alias("whole")))


def allowed(hosts: DataFrame, rules: DataFrame, column: str = "host") -> DataFrame:
    """hosts with a column ok: the host is a rule's, or below a rule that starts with `*.` or a dot, or its apex.

    Hosts are joined by their own endings, so that many rules meet many hosts
    through an equi-join; a null or empty host is not allowed.
    """
    unique = hosts.select(column).distinct().filter(F.col(column).isNotNull())
    met = unique.select(column, F.explode(host_ends(F.col(column))).alias("e")).select(column, "e.key", "e.whole").join(allow_rules(rules), "key").filter("wild OR whole")
    good = met.select(column).distinct().withColumn("ok", F.lit(True))
    return hosts.join(good, column, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def is_allowed(host: Column, exact: list[str], wild: list[str]) -> Column:
    """allowed() for a short allowlist as an expression, where a stream cannot be joined to itself."""
    hit = lambda e: (F.lit(False) if not wild else e["key"].isin(wild)) | (F.lit(False) if not exact else e["whole"] & e["key"].isin(exact))
    return F.coalesce(F.exists(host_ends(host), lambda e: (e["key"] != "") & hit(e)), F.lit(False))


def flat_content(content: Column) -> Column:
    """Text of a transcript message: a JSON string as it is, the texts of an array of typed parts joined by line feeds."""
    parts = F.from_json(content, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull()), lambda p: p["text"])
    plain = F.from_json(F.concat(F.lit('{"t":'), content, F.lit("}")), "struct<t:string>")["t"]
    return F.when(F.ltrim(content).startswith("["), F.array_join(texts, "\n")).otherwise(plain)
