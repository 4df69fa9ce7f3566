"""Web queries against their SQL on pages that the given tables do not hold."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry_module
from tests import harness

HTML = [
    "<p>a&nbsp;b &lt;c&gt; &#39;d&#39; &eacute;&#233;&#xE9; &hellip;</p>",
    "&notit; &not; &ampamp;lt; &amp;lt; &amp &copy2 &nosuch; &unknown &;& &#; &#x; &1;",
    "&#0; &#128; &#x81; &#13;|&#11;|&#xD800; &#x110000; &#99999999999999999999; &#xFFFFFFFFFFFFFFFFFFFF; &#xFDD0; &#x1F600;",
    '<a title="x > y">one</a> <b title=\'2 > 1\'>two</b> <i title="odd>three</i> <4 <é>',
    "<style>a <script> b </style>c</script>d<SCRIPT\t>e</ScRiPt >f<scripts>g</scripts><script>open",
    "<!doctype html><!-- > --><?x?>h<br/>\r\ni\rj é k",
    "&nbsp; 　", "", None, "&acE;&NotEqualTilde;&fjlig; &amp;amp; &am<b>p;</b>",
]
URLS = ["http://a.example/x", "http://a.example/x", "ftp://b.example/", "http:///c", "http://u:p@d.example/", "://?", "http://e.example/1"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("pages")
    rows = [(i, URLS[i % len(URLS)] if i % 3 else f"http://f.example/{i % 40}", HTML[i % len(HTML)]) for i in range(120)]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    con.execute(f"COPY pages TO '{path}/pages.parquet' (FORMAT parquet)")
    return str(path)


@pytest.mark.parametrize("key", ["existing_sources", "html_to_text", "page_text", "register_sources"])
def test_query_equals_sql_on_odd_pages(spark, tables, key):
    result = entry_module.queries()[key](spark, tables)
    assert harness.difference(result, harness.connect(tables), entry_module.oracle_sql()[key]) is None
