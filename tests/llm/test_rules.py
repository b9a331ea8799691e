"""Quality rules, URL filters, HTML extraction and licence scans: brute force, planted cases and edges."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kinema.llm import html, licence_texts, licences, quality, urls

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def brute_quality(text):
    t = text or ""
    words = re.findall(f"[^{SPACE}]+", t)
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(i, i + 5)}
    rows = [x for x in t.split("\n") if re.search(f"[^{SPACE}]", x)]
    n, rep = len(words), len(inside)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(rows) - len(set(rows)), rep, n < 10 or 100 * rep > 20 * n


def test_quality_base(spark):
    rng = random.Random(1)
    docs = [(0, None), (1, ""), (2, " \n\t"), (3, "one two three four"), (4, "a b c d e " * 30), (5, "x #* $%\n&|<> x\nx\nx\n \n y"), (6, "  lead\n trail  \r\n\x0bvt\x0c"), (7, "é ü\u00a0x " * 5)]
    for i in range(8, 60):
        words = [rng.choice("abcdefg") * rng.randint(1, 2) for _ in range(rng.randint(5, 60))]
        docs.append((i, " ".join(words) + rng.choice(["", "\n", "\nsame\nsame", "\nA b c d e f A b c d e f"])))
    docs.append((59, docs[-1][1]))
    df = spark.createDataFrame([(i, t, None if i % 5 == 0 else "en", 3, "k") for i, t in docs], "doc_id long, text string, lang string, n_words int, kept string")
    rows = quality.quality_rules(df).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_quality(dict(docs)[r.doc_id]), r
        assert not (r.kept and r.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_quality_divergence(spark):
    rng = random.Random(2)
    common = ["the", "of", "and", "to", "in"]
    say = lambda: " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("etaoinshr") for _ in range(rng.randint(3, 9))) for _ in range(120))
    docs = [(i, say()) for i in range(60)] + [(100, say().upper()), (101, "".join(c + "%#" if c != " " else c for c in say())), (102, say()[:60])]
    rows = quality.quality_rules(spark.createDataFrame([(i, t, "en") for i, t in docs], "doc_id long, text string, lang string")).collect()
    assert {r.doc_id for r in rows if not r.kept} == {100, 101}


def brute_rule(url):
    i = url.find("://") if url is not None else -1
    if i < 0:
        return "", "", None
    rest = url[i + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text), default=None)


def test_urls(spark):
    some = [
        None, "", "no scheme", "http://", "https://Example.COM/en/7?x=1", "https://example.com/en/8", "x://a.net/de/9#t", "https://example.net/de/8", "https://b.example.net/de/80", "http://org/es/1", "http://myorg/es/1",
        "http://h.org?/es/", "http://A.b.org/es/#q", "https://com/en/", "http://com/en", "ftp://É.com/en/é", "a://b://c.com/en/1", "http://x.com//en/", "http://x.com\n/en/1",
    ]
    pages = [(i, u) for i, u in enumerate(some)] + [(3, some[4]), (None, some[5])]
    rng = random.Random(3)
    for i in range(100, 400):
        bad = i % 3 == 0
        pages.append((i, f"https://{'bad' if bad else 'good'}.site{rng.randint(0, 4)}.info/{rng.choice(['xx', 'yy'])}/{i}"))
    df = spark.createDataFrame([(i, u, "r", 1) for i, u in pages], "page_id long, url string, rule string, tokens int")
    labels = spark.createDataFrame([(i, 0 if i % 3 == 0 else 1, 0) for i in range(100, 300)] + [(None, 0, 1), (101, None, None)], "doc_id long, quality int, toxic int")
    rows = urls.filter_urls(df, labels).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path, rule = brute_rule(r.url)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text), r
        if rule:
            assert r.verdict == rule.verdict and r.mined is None
        else:
            assert r.verdict == ("block" if host.startswith("bad.") else "allow"), r
    assert {r.mined for r in rows} == {None, "w:bad"}
    assert urls.filter_urls(df.limit(0), labels).count() == 0
    assert urls.filter_urls(df, labels.limit(0)).count() == len(pages)


PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a='</p><p>no';</script></head><body><header>Site</header><nav><ul><li><a href=/>Home</a><li>Two</ul></nav>"
    "<div class='cookie-notice'>We use</div>{body}<aside>side</aside><form><p>mail</p></form><footer>&copy; foot</footer></body></html>"
)


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<article><h1>T &amp; x</h1><p><b>a<i>b</i> c.<br><p>d\n  e</p><div id=comments><p>me</p></div><ul><li>l1<li>l2</ul></article>", "T & x ab c. d e l1 l2"),
        ("<main><header><h1>H</h1></header><p>x</p><div class=ad>buy</div></main>", "H x"),
        ("<article><p>cut off here<p>and &quot;th", 'cut off here and "th side mail © foot'),
        ("<article></article>", ""),
        ("<article><p>a<!-- no -->b<script>c</script><p hidden>h<table><tr><td>1<td>2</table>", None),
    ],
)
def test_main_text(body, text):
    page = PAGE.replace("{body}", body)
    got = html.main_text(page if text is not None else PAGE.partition("{body}")[0] + body, set())
    if text is None:
        assert got == "ab 1 2"
    elif "cut off" in text:
        assert got.startswith('cut off here and "th')
    else:
        assert got == text


def test_extract(spark):
    plain = "<html><body><div class=top>My shop</div><div class=txt>Body number {i} of this page</div><p>Call us now</p></body></html>"
    pages = [(i, f"http://s.com/{i}", plain.replace("{i}", str(i))) for i in range(8)]
    article = PAGE.replace("{body}", "<article><h1>Same</h1><p>Same copy</p></article>")
    pages += [(100 + i, f"http://c.com/{i}", article) for i in range(6)] + [(200, None, None), (201, "x", ""), (202, "http://one.org/", "<p>alone &lt;</p>"), (203, "http://s.com/", "<div>broken <b"), (203, "http://s.com/", "<div>broken <b")]
    df = spark.createDataFrame([(*r, 4, "o") for r in pages], "page_id long, url string, html string, n_chars int, host string")
    out = html.extract_main_text(df)
    rows = out.collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(pages) and "host" in out.columns
    assert all(got[i] == f"Body number {i} of this page" for i in range(8))
    assert all(got[100 + i] == "Same Same copy" for i in range(6))
    assert got[200] == got[201] == "" and got[202] == "alone <" and got[203] == "broken"
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html.extract_main_text(df.limit(0)).count() == 0


def test_quality_names_and_long_text(spark):
    text = "the cat sat on a mat of the house and it is in the garden with us " * 20_000
    df = spark.createDataFrame([(1, text, "en", "m", "l", 7), (2, None, None, "n", "k", 8)], "doc_id long, text string, lang string, __m string, __lang_of string, n_words int")
    rows = {r.doc_id: r for r in quality.quality_rules(df).collect()}
    assert rows[1]["__m"] == "m" and rows[2]["__lang_of"] == "k" and rows[1].n_words == 17 * 20_000 and rows[1].base_failed and rows[2].n_words == 0
    assert quality.quality_rules(df).columns[:5] == ["doc_id", "text", "lang", "__m", "__lang_of"]


def test_licences(spark):
    body, bsd = licence_texts.MIT, licence_texts.BSD_GRANT + licence_texts.BSD_NAME + licence_texts.BSD_DISCLAIMER
    prose = "the licence of the birds is to sing in all the trees of the long green valley\n" * 3
    comment = "\n".join(f"# {x}" for x in licence_texts.gnu_header(licence_texts.GPL, "2").strip().split("\n"))
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/x.py", "code\nno notice here"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\n" + "code " * 50), ("a/b/c/z.py", "code " * 20),
        ("d/e/f.txt", "nothing"), ("d/LICENSE", None), ("top.txt", ""), (None, "All rights reserved."), ("g/h.txt", prose),
        ("a/b/LICENSE", "This work is licensed under the GNU General Public License, version 3."), ("a/b/x.py", "code\nno notice here"),
        ("m/LICENSE", "Copyright (c) 2020 A. Person\n" + body), ("m/n/o/p.c", "int x;"), ("k/COPYING", "Copyright (c) 1999, The Group. All rights reserved.\n\n" + bsd), ("k/l/x.c", "int x;"), ("k/l/isc.c", licence_texts.ISC),
        ("q/gpl.py", comment + "\n\n" + "x = y + z\n" * 400), ("q/r/s/t/u.py", "pass"), ("q/spdx.py", "# SPDX-License-Identifier: BSD-2-Clause\n" + prose), ("q/both.txt", "All rights reserved.\nReleased under the MIT License.\n" + prose),
        ("v/GPL-2", "This work is licensed under the GNU General Public License, version 2."), ("long.txt", "word " * 200_000 + "\nLicensed under the Apache License, Version 2.0.\n" + "more " * 1000),
    ]
    df = spark.createDataFrame([(p, t, 1, "l", "x") for p, t in files], "path string, text string, n_notices int, licence string, __text string")
    rows = licences.scan_licences(df).collect()
    assert len(rows) == len(files)
    got = {r.path: (r.licence, r.inherited_from) for r in rows}
    assert got["a/LICENSE"] == ("MIT", None) and got["a/b/x.py"] == ("GPL-3.0", "a/b") and got["a/b/c/y.py"] == ("Apache-2.0", None) and got["a/b/c/z.py"] == ("GPL-3.0", "a/b")
    assert got["d/e/f.txt"] == ("Proprietary", "") and got[None] == ("Proprietary", None) and got["g/h.txt"][1] == ""
    assert got["m/LICENSE"] == ("MIT", None) and got["m/n/o/p.c"] == ("MIT", "m") and got["k/COPYING"] == ("BSD-3-Clause", None) and got["k/l/x.c"] == ("ISC", "k/l") and got["k/l/isc.c"] == ("ISC", None)
    assert got["q/gpl.py"] == ("GPL-2.0", None) and got["q/r/s/t/u.py"] == ("Proprietary", "") and got["q/spdx.py"] == ("BSD-2-Clause", None) and got["q/both.txt"] == ("MIT", None)
    assert got["v/GPL-2"] == ("GPL-2.0", None) and got["long.txt"] == ("Apache-2.0", None)
    assert {r.path for r in rows if r.is_licence_file} == {"a/LICENSE", None, "a/b/LICENSE", "m/LICENSE", "k/COPYING", "k/l/isc.c", "v/GPL-2"}
    tie = licences.scan_licences(df.where("path = 'v/GPL-2'"), templates=[("b", "licensed under one"), ("a", "licensed under one"), ("a", "work is licensed gnu general public license version")]).collect()
    assert [r.licence for r in tie] == ["a"]
    assert licences.scan_licences(df.limit(0)).count() == 0


def test_rare_tokens_lose_no_text():
    rows, rng = licences.template_weights(licences.TEMPLATES), random.Random(4)
    vectors, rare, idf = {}, {}, {}
    for i, _, token, weight, f, is_rare in rows:
        vectors.setdefault(i, {})[token] = weight
        idf[token] = f
        if is_rare:
            rare.setdefault(i, set()).add(token)
    for i, v in vectors.items():
        assert abs(sum(w * w for w in v.values()) - 1) < 1e-9
        for _ in range(50):
            some = {t: idf[t] for t in v if t not in rare[i] and rng.random() < 0.9}
            norm = sum(w * w for w in some.values()) ** 0.5 or 1
            assert sum(w * v[t] for t, w in some.items()) / norm < licences.LEAST_COSINE


#: How published licences begin, as their files have it, and words that may follow.
PUBLISHED = {
    "Apache-2.0": "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n      \"License\" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n",
    "GPL-2.0": "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc.,\n 59 Temple Place, Suite 330, Boston, MA  02111-1307  USA\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n\n  The licenses for most software are designed to take away your\nfreedom to share and change it.\n",
    "LGPL-3.0": "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <http://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n\n  This version of the GNU Lesser General Public License incorporates\nthe terms and conditions of version 3 of the GNU General Public\nLicense, supplemented by the additional permissions listed below.\n",
}


def test_long_licences_are_told_by_their_opening(spark):
    """Complete texts are far from any short template; their openings name them, and their directories inherit."""
    import pathlib

    rest = "\n\n" + "other terms of this work follow here in many a clause and section\n" * 40
    texts = {name: text + rest for name, text in PUBLISHED.items()} | {name: text + rest for name, text in licence_texts.OPENINGS}
    for name, file in {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}.items():
        path = pathlib.Path("/usr/share/common-licenses") / file
        if path.exists():
            texts[f"{name} whole"] = path.read_text(encoding="utf-8", errors="replace")
    files = [row for name, text in texts.items() for row in ((f"{name}/LICENSE", text), (f"{name}/src/deep/a.c", "int x;"))]
    quoted = "Our guide says: " + licence_texts.OPENINGS[0][1][:80] + " and so on\n" + "prose of another kind altogether, line by line\n" * 40
    rows = {r.path: r for r in licences.scan_licences(spark.createDataFrame([*files, ("guide/g.md", quoted), ("guide/x/y.c", "y")], "path string, text string")).collect()}
    for name in texts:
        r = rows[f"{name}/LICENSE"]
        assert r.is_licence_file and r.licence == name.removesuffix(" whole"), (name, r)
        deep = rows[f"{name}/src/deep/a.c"]
        assert (deep.licence, deep.inherited_from) == (r.licence, name)
    assert not rows["guide/g.md"].is_licence_file and rows["guide/x/y.c"].licence is None


def test_bound_by_unknown_words_loses_none(spark):
    """Whatever is near a template may be near by the bound, and prose with a few of its words may not."""
    weights, n = licences.template_weights(licences.TEMPLATES, licences.OPENINGS), len(licences.TEMPLATES) + len(licences.OPENINGS)
    idf, unknown, rng = {t: w for _, _, t, _, w, _ in weights}, math.log((1 + n) / 2) + 1, random.Random(5)
    vectors = {}
    for i, _, t, w, _, _ in weights:
        vectors.setdefault(i, {})[t] = w
    units = []
    for v in vectors.values():
        for k in range(12):
            words = [t for t in v for _ in range(rng.choice([1, 1, 1, 2, 5]))] + [f"new{rng.randint(0, 400)}" for _ in range(rng.choice([0, 1, len(v), 4 * len(v)]))]
            words = rng.sample(words, max(1, round(len(words) * rng.uniform(0.3, 1))))
            tf = Counter(words)
            norm = math.sqrt(sum(((1 + math.log(c)) * idf.get(t, unknown)) ** 2 for t, c in tf.items()))
            cosine = max(sum((1 + math.log(c)) * idf[t] * u.get(t, 0) for t, c in tf.items() if t in u) / norm for u in vectors.values())
            units.append((words, len([t for t in tf if t not in idf]), cosine))
    df = spark.createDataFrame(units, "tokens array<string>, n_unknown int, cosine double")
    rows = df.select("cosine", licences.may_be_near(F.col("tokens"), F.col("n_unknown"), weights, n).alias("may")).collect()
    assert all(r.may for r in rows if r.cosine >= licences.LEAST_COSINE) and sum(not r.may for r in rows) > len(rows) / 10
