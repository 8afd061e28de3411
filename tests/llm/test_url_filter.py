from pyspark.sql import functions as F

from vacantia.llm.url_filter import Rule, domain_of, filter_urls, host_of, host_reputation, path_of, suffix_of

RULES = [
    Rule("allow", "com/"),
    Rule("block", "example.com/en/"),
    Rule("allow", "www.example.com/en/"),
    Rule("block", "net/es/"),
]
URLS = {
    "https://www.Example.COM/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://a.example.com/en/x?q=/en/": ("a.example.com", "/en/x", "example.com/en/", "block"),
    "http://a.example.com/fr/x": ("a.example.com", "/fr/x", "com/", "allow"),
    "http://a.example.com": ("a.example.com", "", None, "allow"),
    "http://xcom/": ("xcom", "/", None, "allow"),
    "ftp://b.net/es/#top": ("b.net", "/es/", "net/es/", "block"),
    "http://ÀB.net/es": ("Àb.net", "/es", None, "allow"),
    "http://h?x://y/z": ("h", "", None, "allow"),
    "http://h/a\nb#c": ("h", "/a\nb", None, "allow"),
    "no scheme": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
}


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, url, "x") for i, url in enumerate(URLS)], "page_id bigint, url string, host string")
    outcomes = spark.createDataFrame([], "host string, bad int")
    found = {row.page_id: row for row in filter_urls(pages, outcomes, RULES).collect()}
    assert len(found) == len(URLS)
    for i, wanted in enumerate(URLS.values()):
        assert (found[i].host, found[i].path, found[i].rule, found[i].verdict) == wanted


def test_empty_pages_and_repeated_rows(spark):
    schema = "page_id bigint, url string"
    outcomes = spark.createDataFrame([("h.org", 1)], "host string, bad int")
    assert filter_urls(spark.createDataFrame([], schema), outcomes, RULES).collect() == []
    twice = spark.createDataFrame([(1, "http://h.org/"), (1, "http://h.org/"), (None, None)], schema)
    assert filter_urls(twice, outcomes, []).count() == 3


def test_hosts_are_shrunk_to_their_domain(spark):
    rows = [("bad.x.org", 1)] * 60 + [("bad.x.org", 0)] * 2 + [("good.x.org", 0)] * 60 + [("new.x.org", 1)]
    rows += [("other.org", 0)] * 30 + [("unseen.x.org", None)] * 3
    found = {row.host: row for row in host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert found["bad.x.org"].bad_at_least > 0.5 > found["new.x.org"].bad_at_least
    # One bad page alone is weaker than many, and a host without labels has its domain's rate.
    assert found["good.x.org"].bad_rate < found["unseen.x.org"].bad_rate < found["new.x.org"].bad_rate < found["bad.x.org"].bad_rate
    assert found["unseen.x.org"].seen == 0


def test_bad_host_is_blocked_unless_a_rule_allows(spark):
    outcomes = spark.createDataFrame([("spam.org", 1)] * 50 + [("fine.org", 0)] * 50, "host string, bad int")
    pages = spark.createDataFrame([(1, "http://spam.org/a"), (2, "http://fine.org/a"), (3, "http://spam.org/ok/a")], "page_id bigint, url string")
    found = filter_urls(pages, outcomes, [Rule("allow", "spam.org/ok/")]).collect()
    assert {row.page_id: row.verdict for row in found} == {1: "block", 2: "allow", 3: "allow"}


def test_parts_of_a_url(spark):
    row = spark.range(1).select(host_of(F.lit("s://H:80/p?q")).alias("h"), path_of(F.lit("s://H:80/p?q")).alias("p")).first()
    assert (row.h, row.p) == ("h:80", "/p")


def test_registered_domains_suffixes_ports_and_addresses(spark):
    wanted = {
        "a.b.example.com:8080": ("example.com", "com"),
        "shop.a.co.uk": ("a.co.uk", "co.uk"),
        "co.uk": ("co.uk", "co.uk"),
        "10.0.0.1:80": ("10.0.0.1", ""),
        "[2001:db8::1]:443": ("[2001:db8::1]", ""),
        "localhost": ("localhost", "localhost"),
        "": ("", ""),
        "x.y.blog.test": ("blog.test", "test"),
    }
    hosts = spark.createDataFrame([(h,) for h in wanted], "host string")
    found = hosts.select("host", domain_of(F.col("host")).alias("d"), suffix_of(F.col("host")).alias("s")).collect()
    assert {r.host: (r.d, r.s) for r in found} == wanted
    own = hosts.select("host", domain_of(F.col("host"), ["blog.test"]).alias("d"), suffix_of(F.col("host"), ["blog.test"]).alias("s"))
    assert ("x.y.blog.test", "y.blog.test", "blog.test") in [tuple(r) for r in own.collect()]
