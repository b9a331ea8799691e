"""SimHash, decontamination, suffix-array dedup and line dedup against brute force, and their edge cases."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from kinema.llm import decontaminate, graph, lines, simhash, suffix

DOCS = "doc_id long, text string, component_id int, fp string, doc string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], DOCS)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, near):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and near(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(40, 90))) for _ in range(12)]
    out = []
    for i in range(60):
        t = rng.choice(base).split()
        if i % 3:
            t[rng.randrange(len(t))] = "changed"
        out.append((i, " ".join(t)))
    return [*out, (60, None), (61, ""), (62, " \t\n"), (63, "Two WORDS"), (64, "two words"), (65, "É ÉÉ é x y"), (66, "a" * 50_000 + " b" * 20_000), (66, "a" * 50_000 + " b" * 20_000)]


@pytest.mark.parametrize("pairwise", [64, 1])
def test_simhash_components(spark, texts, monkeypatch, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    fp = {i: brute_fingerprint(t) for i, t in texts}
    want = components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 2)
    rows = simhash.simhash_components(frame(spark, texts)).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in fp}


def test_simhash_split_keys(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRWISE", 1)
    rng = random.Random(1)
    start = rng.getrandbits(64)
    values = [start]
    for _ in range(80):
        values.append(values[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    for distance in (2, 1, 0):
        want = components(values, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= distance)
        links = simhash.near_links(spark.createDataFrame([(v,) for v in values], "fp long"), distance=distance)
        got = {r.node: r.component for r in graph.connected_components(links).collect()}
        assert {v: got.get(v, v) for v in values} == want


def test_near_dedup_null_ids_and_empty(spark, texts):
    out = simhash.near_dedup(frame(spark, [*texts, (None, "only here without an id"), (None, None)]))
    assert out.columns == ["doc_id", "text", "component_id", "fp", "doc"]
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(66) == 1 and ids.count(None) == 1
    assert simhash.near_dedup(frame(spark, [])).count() == 0
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def brute_hits(docs, items, size=10):
    norm = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = norm(t)
        for k in range(max(1, len(w) - size + 1)):
            if w:
                windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = norm(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= ids
        names = sorted(str(i) for i in found if i is not None)
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit))
    return out


@pytest.mark.parametrize("at_once", [500_000, 7])
def test_decontaminate(spark, at_once):
    rng = random.Random(2)
    words = [f"k{i}" for i in range(40)] + ["Ünï", "x9"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(12, 25))) for i in range(8)] + [(8, "Short Item here"), (9, ""), (10, None), (11, say(10)), (11, say(10)), (None, say(11))]
    docs = [(0, None), (1, ""), (2, "!!! ..."), (3, "a short ITEM, here.. short item")]
    for i in range(4, 60):
        t = rng.choice(items)[1] or ""
        docs.append((i, say(20) + " (" + (t.upper().replace(" ", " -\n") if i % 3 else t[: len(t) // 2]) + ") " + say(9)))
    docs.append((59, docs[-1][1]))
    made = decontaminate.decontaminate(
        spark.createDataFrame([(i, t, 1, "z") for i, t in docs], "doc_id long, text string, n_words int, item_id string"),
        spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, windows string"),
        windows_at_once=at_once,
    )
    rows = made.collect()
    assert len(rows) == len(docs)
    want = brute_hits(docs, items)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]
        inside = " ".join((r.text or "")[s.start : s.end] for s in r.spans)
        assert len(re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", inside)) == r.n_hit
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(frame(spark, [(1, "a")]), none).first().contaminated is False
    assert decontaminate.decontaminate(frame(spark, []), none).count() == 0


def brute_repeats(docs, w=100):
    seen, out = set(), []
    for i, t in docs:
        t = (t or "").encode()
        cover = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - w + 1):
            if t[k : k + w] in seen:
                cover[k : k + w] = True
            seen.add(t[k : k + w])
        runs = int((np.diff(np.concatenate(([0], cover.astype(int)))) == 1).sum())
        kept = bytes(b for b, c in zip(t, cover, strict=False) if not c)
        out.append((i, len(t), int(cover.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("split", "run"), [(10_000, 16), (2, 64)])
def test_remove_repeats(spark, monkeypatch, split, run):
    monkeypatch.setattr(suffix, "SPLIT", split)
    monkeypatch.setattr(suffix, "RUN", run)
    monkeypatch.setattr(suffix, "CHUNK", 257)
    rng = random.Random(4)
    base = ["".join(rng.choice("abcé ") for _ in range(500)) for _ in range(4)]
    docs = [(0, None), (1, ""), (2, "short"), (3, "aaaa " * 300), (4, "x" * 99), (5, "x" * 101)]
    for i in range(6, 60):
        t = ""
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, 400)
            t += rng.choice(base)[k : k + rng.randint(50, 300)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 30)))
        docs.append((i, t))
    rows = suffix.remove_repeats(frame(spark, docs)).collect()
    assert sorted(tuple(r) for r in rows) == brute_repeats(docs)


def test_remove_repeats_odd_ids(spark):
    t = "".join(chr(97 + i % 26) + str(i) for i in range(80))
    docs = [(1, "b" + t), (1, "a" + t), (2, t), (None, t), (None, None)]
    rows = suffix.remove_repeats(frame(spark, docs), texts_out=True).collect()
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in rows}
    n = len(t)
    assert got == {(1, n + 1, 0), (1, n + 1, n), (2, n, n), (None, n, n), (None, 0, 0)} and len(rows) == 5
    assert suffix.remove_repeats(frame(spark, [])).count() == 0


def test_suffix_order():
    rng = random.Random(5)
    docs = [[rng.randint(0, 3) for _ in range(rng.randint(1, 12))] for _ in range(60)]
    ends = np.cumsum([len(x) for x in docs])
    doc, length, bwt, lcp = suffix.suffix_order(np.concatenate([np.array(x, np.uint32) for x in docs]), ends, 5)
    made = [docs[i][len(docs[i]) - k :] for i, k in zip(doc, length, strict=True)]
    assert len(made) == ends[-1] and made == sorted(made)
    for k in range(1, len(made)):
        c = 0
        while c < min(5, len(made[k]), len(made[k - 1])) and made[k][c] == made[k - 1][c]:
            c += 1
        assert lcp[k] == c
    for i, k, b in zip(doc, length, bwt, strict=True):
        assert k == len(docs[i]) or b == docs[i][len(docs[i]) - k - 1]


def test_line_dedup(spark):
    docs = [
        (1, "Page 12 of 90 pages\nunique one here today\n\nshort"), (2, "Page 3 of 7 pages\nanother line of mine\nshort"), (3, "other text for three\nPage 5 of 5 pages\nPage 6 of 5 pages"),
        (4, "login accepted for alice at home\ntwo of two\n"), (5, "login accepted for bob at home\nfive"), (6, "login accepted for carol at home\nsix"), (7, "seven\nlogin accepted for dave at home"),
        (8, None), (9, ""), (10, "two of two"), (None, "Page 1 of 2 pages\nlast words of all"),
    ]
    out = lines.drop_recurring_lines(spark.createDataFrame([(i, t, 5, "d") for i, t in docs], "doc_id long, text string, n_lines int, drop string"))
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in out.collect()}
    assert got[1] == (docs[0][1], 4, 0)
    assert got[2] == ("another line of mine\nshort", 3, 1)
    assert got[3] == ("other text for three", 3, 2)
    assert got[4] == (docs[3][1], 3, 0)
    assert [got[i][0] for i in (5, 6, 7)] == ["five", "six", "seven"]
    assert got[8] == (None, 0, 0) and got[9] == ("", 1, 0) and got[10] == ("two of two", 1, 0)
    assert got[None] == ("last words of all", 2, 1)
    assert "drop" in out.columns
    assert lines.drop_recurring_lines(frame(spark, [])).count() == 0


def test_line_dedup_of_any_length(spark):
    long = " ".join(f"w{chr(97 + i)}" for i in range(26)) * 2
    kinds = {
        "one": lambda i: "}", "digits": lambda i: str(i), "long": lambda i: f"{long} by n{chr(97 + i)} {long}",
        "first": lambda i: f"the user has name k{chr(97 + i)} logged in from here", "second": lambda i: f"the user has paid m{chr(97 + i)} coins to his friend",
    }
    own = [[f"own{chr(97 + i)}{chr(97 + k)} text of" for k in range(12)] for i in range(8)]
    docs = [(i, "\n".join([*own[i], *(f(i) for f in kinds.values())])) for i in range(8)]
    out = {r.doc_id: r.text.split("\n") for r in lines.drop_recurring_lines(frame(spark, docs)).collect()}
    assert out[0] == docs[0][1].split("\n")
    assert all(out[i] == [*own[i], str(i)] for i in range(1, 8))
    all_gone = lines.drop_recurring_lines(frame(spark, docs), keep_first=False).collect()
    assert {r.doc_id: r.n_dropped for r in all_gone} == {i: 4 for i in range(8)}


def test_line_dedup_leaves_copies(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [" ".join(word() for _ in range(9)) for _ in range(12)]
    copies = [(i, "\n".join([*base[: i % 12], word(), *base[i % 12 + 1 :]])) for i in range(12)]
    foot = "all rights of this page are ours"
    others = [(20 + i, "\n".join([" ".join(word() for _ in range(9)), foot])) for i in range(5)]
    twice = [(40, f"{word()} {word()}\n{foot}"), (40, f"{foot}\n{word()} {word()}")]
    out = lines.drop_recurring_lines(frame(spark, copies + others + twice)).collect()
    assert {r.doc_id: r.text for r in out if r.doc_id < 20} == dict(copies)
    assert {r.doc_id: r.text for r in out if 20 < r.doc_id < 40} == {i: t.split("\n")[0] for i, t in others[1:]}
    assert sorted(r.text for r in out if r.doc_id == 40) == sorted(t.replace(foot, "").strip("\n") for _, t in twice)


def test_line_dedup_keeps_prose(spark):
    rng = random.Random(6)
    words = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    docs = [(i, "\n".join(" ".join(["the", "of", *(rng.choice(words) for _ in range(8))]) for _ in range(6))) for i in range(50)]
    out = lines.drop_recurring_lines(frame(spark, docs)).collect()
    assert {r.doc_id: r.text for r in out} == dict(docs)
