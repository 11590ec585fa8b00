import zipfile
from datetime import date

from siteaudit.sources import providers, sinks, sitemaps


def test_sitemap():
    s = sitemaps.parse('<?xml version="1.0"?><urlset xmlns="x"><url><loc> https://a/1 </loc><image:loc>n</image:loc></url><ns:url><ns:loc><![CDATA[https://a/2?x&y]]></ns:loc></ns:url><url><loc>https://a/3&amp;z</loc></url><url><loc>https://a/4')
    assert s.urls == ["https://a/1", "n", "https://a/2?x&y", "https://a/3&z"] and not s.sitemaps


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'q"q'), (None, ""), ("x\ny", "z")], "h1 string, h2 string").coalesce(1)
    sinks.write_csv(str(tmp_path / "x.csv"), df)
    assert (tmp_path / "x.csv").read_bytes() == b'\xef\xbb\xbfh1,h2\r\n"a,b","q""q"\r\n,\r\n"x\ny",z\r\n'


def test_xlsx_is_deterministic(tmp_path):
    sheets = [("A/b" * 20, ["x", "y"], [["1", None], ["<&\x01", ""]]), ("A/b" * 20, ["z"], [])]
    for n in ("1", "2"):
        sinks.write_xlsx(str(tmp_path / n), sheets)
    assert (tmp_path / "1").read_bytes() == (tmp_path / "2").read_bytes()
    with zipfile.ZipFile(tmp_path / "1") as z:
        sheet = z.read("xl/worksheets/sheet1.xml").decode()
        assert '<c r="A3" t="inlineStr"><is><t xml:space="preserve">&lt;&amp;</t></is></c><c r="B3"' in sheet and 'r="B2"' not in sheet
    assert sinks.column_letters(0) == "A" and sinks.column_letters(26) == "AA" and sinks.column_letters(701) == "ZZ"
    names = sinks.sheet_names(["a" * 40, "a" * 40, "[x]"])
    assert len(set(names)) == 3 and all(len(n) <= 31 for n in names)
    assert sinks.file_name("www.e.com", "Page Titles", date(2024, 1, 2), "csv") == "www-e-com-page-titles-2024-01-02.csv"


def test_providers():
    body = {"lighthouseResult": {"categories": {"performance": {"score": 0.5}}, "audits": {"total-blocking-time": {"numericValue": 12}}}, "loadingExperience": {"metrics": {"CUMULATIVE_LAYOUT_SHIFT_SCORE": {"percentile": 7, "category": "FAST"}}, "overall_category": "SLOW"}}
    got = {r[2]: r[3:] for r in providers.pagespeed("u", body)}
    assert got == {"Lighthouse Performance": (50.0, None), "Lab TBT": (12.0, None), "CWV CLS": (0.07, "FAST"), "CWV Assessment": (None, "SLOW")}
    assert providers.search_console({"rows": [{"keys": ["u"], "clicks": 1, "ctr": "0.5"}, {"keys": ["v"], "clicks": 2}]}, {"u"}) == [("u", "gsc", "Clicks", 1.0, None), ("u", "gsc", "CTR", 0.5, None)]
    assert providers.analytics({"rows": [{"dimensionValues": [{"value": "/p"}], "metricValues": [{"value": "3"}]}]}, {"/p": "u"}) == [("u", "ga4", "Sessions", 3.0, None)]
    assert providers.moz(["u"], {"results": [{"domain_authority": 4}]}) == [("u", "moz", "Domain authority", 4.0, None)]


def test_enrich_goes_on_after_failure(spark):
    def ask(batch):
        if "bad" in batch:
            raise ValueError("no")
        return [(u, "pagespeed", "m", 1.0, None) for u in batch]

    rows = providers.enrich(spark.createDataFrame([("ok",), ("bad",), ("fine",)], "url string").coalesce(1), "pagespeed", ask).collect()
    assert sorted((r.url, r.metric) for r in rows if r.metric) == [("fine", "m"), ("ok", "m")]
    assert [r.text for r in rows if not r.metric] == ["ValueError: no"]
