import pytest

from qanat.llm import queries
from qanat.llm.url_filters import MAX_RULES, Rule, index, judge
from tests.compare import connect, difference

CASES = [
    ("http://a.org/x", "a.org", "/x", "org/", "allow"),
    ("https://WWW.Example.ORG/es/1?x#y", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("https://example.org/ES/1", "example.org", "/ES/1", "org/", "allow"),
    ("https://example.org/en/123", "example.org", "/en/123", "example.org/en/1", "block"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
    ("http://x.com/fr", "x.com", "/fr", None, "allow"),
    ("http://x.com/de/a\nb", "x.com", "/de/a\nb", "com/de/", "block"),
    ("http://a.org", "a.org", "", None, "allow"),
    ("http://a.org?x/", "a.org", "", None, "allow"),
    ("http://cheap-pills.example.com/fr/1", "cheap-pills.example.com", "/fr/1", "com/fr/", "allow"),
    ("http://www.cheap-pills.example.com/it/1", "www.cheap-pills.example.com", "/it/1", None, "block"),
    ("http://x.net/casino/1", "x.net", "/casino/1", None, "block"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("a://b.org/c://d", "b.org", "/c://d", "org/", "allow"),
]


def test_cases_and_repeated_rows(spark):
    rows = [(i, c[0], "mine", "mine") for i, c in enumerate(CASES)] * 2 + [(None, CASES[0][0], "", "")]
    found = judge(spark.createDataFrame(rows, "page_id long, url string, rule string, host string"), queries.URL_RULES).collect()
    assert len(found) == len(rows)
    for r in found:
        case = CASES[r.page_id or 0]
        assert (r.host, r.path, r.rule, r.verdict) == case[1:], r
    assert judge(spark.createDataFrame([], "page_id long, url string"), queries.URL_RULES).count() == 0


def test_against_asking_every_rule(spark):
    import random
    import re

    rng = random.Random(2)
    words = ["a", "b", "shop", "x-1", "example", "com", "org"]
    rules = [Rule(".".join(rng.choices(words, k=rng.randint(1, 3))) + "/" + "/".join(rng.choices(words, k=rng.randint(0, 2))), rng.choice(["allow", "block"])) for _ in range(60)]
    rules += [Rule(p, v, True) for p, v in (("||shop.*", "block"), ("*x-1*", "block"), ("*/a/*|", "allow"), ("*.b.com/", "block"), ("*", "allow"))][:4]
    urls = ["http://" + ".".join(rng.choices(words, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(words, k=rng.randint(0, 3))) for _ in range(400)]
    found = judge(spark.createDataFrame([(u,) for u in urls], "url string"), rules).collect()
    for r in found:
        text = f"{r.host}\n{r.path}"
        fitting = [x for x in rules if re.match(x.pattern(), text)]
        exact = sorted((x for x in fitting if not x.wildcard), key=lambda x: (-len(x.text), x.text))
        assert r.rule == (exact[0].text if exact else None)
        if not exact:
            verdicts = {x.verdict for x in fitting}
            assert r.verdict == ("allow" if "allow" in verdicts or not verdicts else "block")


def test_index_files_rules_under_their_rarest_token():
    filed = {e["rule"]: e["token"] for bucket in index([Rule("example.org/", "allow"), Rule("rare.example.org/", "block"), Rule("*x*", "block", True)]) for e in bucket}
    assert filed["rare.example.org/"] == "rare" and filed["*x*"] == ""
    with pytest.raises(ValueError):
        index([Rule(f"h{i}.org/", "allow") for i in range(MAX_RULES + 1)])


def test_query_matches_sql_without_python_or_shuffle(spark):
    df = queries.op5_url_filters(spark, "/root/testdata/sf0.01")
    assert difference(df, connect("/root/testdata/sf0.01"), queries.ORACLES["op5_url_filters"]) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
