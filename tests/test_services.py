import json
from datetime import date

import pytest

from siteaudit.sources import services as S

C = S.Credentials("k", "id", "se&cret", "r", "sc-domain:e.com", "77", "ah", "mj", "u", "p")


def test_requests():
    r = S.request("pagespeed", ["https://e.com/?a=1"], C)
    assert r.url == "https://www.googleapis.com/pagespeedonline/v5/runPagespeed?url=https%3A%2F%2Fe.com%2F%3Fa%3D1&strategy=mobile&key=k&category=performance&category=seo&category=accessibility" and r.body is None
    r = S.request("gsc", [], C, "tok", date(2024, 3, 10))
    assert "/sites/sc-domain%3Ae.com/" in r.url and json.loads(r.body)["startDate"] == "2024-02-11" and r.headers["Authorization"] == "Bearer tok"
    assert json.loads(S.request("ga4", [], C, "tok").body)["dateRanges"] == [{"startDate": "28daysAgo", "endDate": "today"}]
    assert S.request("ahrefs", ["u"], C).headers == {"Authorization": "Bearer ah"}
    assert S.request("majestic", ["a", "b"], C).url.endswith("items=2&item0=a&item1=b")
    r = S.request("moz", ["a"], C)
    assert json.loads(r.body) == {"targets": ["a"]} and r.headers["Authorization"] == "Basic dTpw"
    assert S.refresh(C).body == b"client_id=id&client_secret=se%26cret&refresh_token=r&grant_type=refresh_token"


def test_asking():
    asked = []

    def ask(request):
        asked.append(request.url)
        if "oauth2" in request.url:
            return {"access_token": "T"}
        return {"rows": [{"dimensionValues": [{"value": "/p"}], "metricValues": [{"value": "3"}]}, {"keys": ["https://e.com/p"], "clicks": 2}]}

    assert S.asker("ga4", C, ask)(["https://e.com/p?q"]) == [("https://e.com/p?q", "ga4", "Sessions", 3.0, None)]
    assert S.asker("gsc", C, ask)(["https://e.com/p"]) == [("https://e.com/p", "gsc", "Clicks", 2.0, None)]
    assert sum("oauth2" in u for u in asked) == 2
    assert S.read("moz", ["a", "b"], {"results": [{"page": "b", "spam_score": 1}]}) == [("b", "moz", "Spam score", 1.0, None)]
    with pytest.raises(S.ServiceError, match="ahrefs_token"):
        S.asker("ahrefs", S.Credentials(), ask)
    with pytest.raises(S.ServiceError, match="access_token"):
        S.access_token(C, lambda r: {})
