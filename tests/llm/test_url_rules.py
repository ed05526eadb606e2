"""op3 against a plain reading of its contract, and against its SQL, on odd urls."""

import duckdb

from vitalgrid.llm.queries import op3_url_filter
from vitalgrid.llm.sql import OP3

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "block"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
HOSTS = ["com", "COM", "example.com", "a.Example.COM", "xexample.com", "..com", ".com", "com.", "example.com:80", "u@example.com", "x.example.net", "net", "a.org", "a\nb.org", "org\n", "é.org", "İ.com", "", " com", "com "]
PATHS = ["", "/", "/en/", "/en/71", "/en/8", "/EN/", "/de/", "/de/88?x", "/es/é", "/es", "?/en/", "#/en/", "/en/7#", "/en/?7", "//en/", "/en\n/", "/es/\x00"]


def first_of(text, marks):
    return min((text.find(m) for m in marks if m in text), default=len(text))


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = first_of(rest, "/?#")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:][: first_of(rest[cut:], "?#")]
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_verdicts_on_odd_urls(spark, tmp_path):
    urls = [None, "", "com/en/", "://", "://com/en/", "http:/com/en/", "x?u=http://com/en/", "http://http://com/en/", *[f"http://{h}{p}" for h in HOSTS for p in PATHS]]
    urls += urls[:60]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r[0]: tuple(r)[1:] for r in op3_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: plain(u) for i, u in enumerate(urls)}
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: tuple(r[1:]) for r in con.execute(OP3).fetchall()}
