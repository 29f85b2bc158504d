"""URL rules: the automaton against regular expressions, the odd URLs."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from taxomatch.llm import url_rules as U


def _regex(glob: str) -> re.Pattern:
    out = re.sub(r"\*\*|\*|\?|.", lambda m: {"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(m[0], re.escape(m[0])),
                 glob, flags=re.DOTALL)
    return re.compile(out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab/*?.", max_size=8), min_size=1, max_size=40), st.lists(st.text("ab/.", max_size=12), max_size=8))
def test_automaton_fits_like_regular_expressions(globs, texts):
    hit = U.Automaton.compile(globs).run([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert hit[i].tolist() == [bool(_regex(g).fullmatch(t)) for g in globs]


def test_many_words_of_patterns():
    globs = [f"*{'ab' * n}{n}*" for n in range(60)]  # several thousand states
    auto = U.Automaton.compile(globs)
    assert len(auto.start) > 30
    hit = auto.run([f"x{'ab' * n}{n}y".encode() for n in range(60)])
    assert all(hit[n, n] for n in range(60))


def test_rules_and_odd_urls(spark):
    urls = {
        "http://A.Example.NET/en/1": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "http://example.net/EN/1": ("example.net", "/EN/1", "net/", "block"),
        "https://x.net": ("x.net", "", None, "allow"),
        "https://net/?q": ("net", "/", "net/", "block"),
        "https://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "https://m.example.com/de/x#y": ("m.example.com", "/de/x", "example.com/de/", "block"),
        "https://org/fr/": ("org", "/fr/", "org/fr/", "allow"),
        "https://spam-farm.example.org/fr/1": ("spam-farm.example.org", "/fr/1", "org/fr/", "allow"),
        "https://spam-farm.example.org/en/1": ("spam-farm.example.org", "/en/1", None, "block"),
        "https://example.org/spam-farm/": ("example.org", "/spam-farm/", None, "allow"),
        "https://x.org/a.net/": ("x.org", "/a.net/", None, "allow"),
        "x.net/en/": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "://": ("", "", None, "allow"), "a://É.NET/x\n://b": ("É.net", "/x\n://b", "net/", "block"),
        "http://u@x.net:80/": ("u@x.net:80", "/", None, "allow"),
        "http://" + "a" * 20_000 + ".net/" + "b" * 20_000: ("a" * 20_000 + ".net", "/" + "b" * 20_000, "net/", "block"),
    }
    rows = [(i, u, "c", "c") for i, u in enumerate([*urls, *urls])]
    df = spark.createDataFrame(rows, "page_id long, url string, Host string, verdict string")
    got = U.judge_urls(df).collect()
    assert len(got) == 2 * len(urls)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == urls[r.url], r.url
    assert U.judge_urls(df.limit(0)).count() == 0
