"""robots.txt of many hosts against the rules of each."""

from quern.sources import robots

FILES = {
    "a.org": "User-agent: *\nDisallow: /x\n\nuser-agent: quern\nDisallow: /own\n disallow: /two\nUser-agent: Quernbot\nDisallow: /long",
    "b.org": "# User-agent: *\nDisallow: /early\nUser-Agent : *\r\nDisallow:\r\nDisallow: /b:c\r\nno colon here\nUSER-AGENT: other\nDisallow: /",
    "c.org": "User-agent: quern\nUser-agent: *\nDisallow: /all\nUser-agent: quern\nDisallow: /again",
    "d.org": "",
    "e.org": None,
    "": "User-agent: *\nDisallow: /",
}


def test_rules_of_each_host_are_those_of_its_file_alone(spark):
    files = spark.createDataFrame(list(FILES.items()), "host string, content string")
    for agent in ("Quern/1.0", "quernbot/2", "other", "zzz"):
        got = {(r["host"], r["prefix"]) for r in robots.rules_of_hosts(files, agent).collect()}
        want = set()
        for host, content in FILES.items():
            if content and (rules := robots.rules_table(spark, content)) is not None:
                want |= {(host, r["prefix"]) for r in robots.rules_for_agent(rules, agent).collect()}
        assert got == want


def test_pages_by_host(spark):
    rules = spark.createDataFrame([("a.org", "/own"), ("a.org", "/ö"), ("b.org", "/"), ("c.org", "/long/prefix")], "host string, prefix string")
    urls = ["http://a.org/own/x", "http://a.org/ow", "http://a.org/öx?q", "http://b.org", "http://c.org/long", "http://c.org/long/prefixes", "http://d.org/own", "no url", None, "http://a.org/ow"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    assert sorted(r["page_id"] for r in robots.allowed_by_host(pages, rules).collect()) == [1, 4, 6, 7, 8, 9]
