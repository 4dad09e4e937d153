"""Every corpus operator on awkward rows, and against brute force, round trips or held-out rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparquarry.llm import chat, decontamination, minhash, quality, quality_rules, token_output, toxicity
from sparquarry.llm.components import connected_components
from sparquarry.llm.decontamination import contamination
from sparquarry.llm.mixing import mixture
from sparquarry.llm.sentence_dedup import drop_repeated_spans
from sparquarry.llm.url_filters import url_verdicts

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n string, key string, g string, version string, score_ string, h string, bin string, component string"
LONG = " ".join(f"word{i % 3000}" for i in range(60_000))


def documents(spark, rows):
    """(doc_id, text, lang, source) with columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * 9) for r in rows], SCHEMA)


AWKWARD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "some text without an id at all", "en", "b"), (None, None, None, None),
    (4, "one two three four five six seven eight nine ten", "de", "b"), (4, "one two three four five six seven eight nine ten", "de", "b"), (4, "other words under an id that came before", "de", None),
    (5, LONG, "fr", "c"), (6, "A  b \n c\td é日本 \x1c z", "xx", "c"), (7, "one", "en", "d"), (8, "one", "en", "d"),
]


def brute_components(sets, percent=80):
    up = {i: i for i in sets}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            k = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in ids}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    rows = []
    for size in (30, 80, 120):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(50):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 13])):
                w[rng.randrange(size)] = rng.choice(words)
            rows.append((len(rows), " ".join(w), "en", "a"))
    rows += [(1000 + i, " ".join(rng.choice(words[:30]) for _ in range(rng.randrange(20))), "en", "a") for i in range(40)]
    got = minhash.near_duplicates(documents(spark, rows), 2).collect()
    sets = {r[0]: shingles(r[1], 2) for r in rows}
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(sets)
    assert all(r["n_shingles"] == len(sets[r["doc_id"]]) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_awkward(spark):
    got = minhash.near_duplicates(documents(spark, AWKWARD), 2).collect()
    assert len(got) == len(AWKWARD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert {r["component_id"] for r in by[8]} == {7} and not by[8][0]["kept"] and by[7][0]["kept"]
    assert all(r["component_id"] is None and r["kept"] for r in by[None]) and by[1][0]["n_shingles"] == 0 and {r["component_id"] for r in by[4]} == {4}
    assert minhash.near_duplicates(documents(spark, []), 2).count() == 0


def test_near_duplicates_of_rows_under_one_id(spark):
    rng = random.Random(11)
    a, b, c = ([f"w{rng.randrange(9999)}" for _ in range(60)] for _ in range(3))
    near = lambda w: [*w[:30], "other", *w[31:]]
    rows = [(10, a), (10, b), (11, near(a)), (12, near(b)), (20, c), (9, near(c)), (10, b)]
    got = minhash.near_duplicates(documents(spark, [(i, " ".join(w), "en", "a") for i, w in rows]), 2).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {10: 10, 11: 10, 12: 10, 20: 9, 9: 9} and len(got) == len(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, i) for i in range(51, 90)] + [(3, 3), (None, 4), (100, 99)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, **{i: 50 for i in range(50, 90)}, 99: 99, 100: 99}
    assert connected_components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_token_file(spark):
    got = token_output.encoded_corpus(documents(spark, AWKWARD), public_tokenizers.path("byte_bpe_50k.json"))
    rows = got.orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = [np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for _, x, _, _ in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))]
    assert [bytes(r["ids"]) for r in rows] == [w.tobytes() for w in want]
    assert [r["start"] for r in rows] == list(np.cumsum([0, *map(len, want)])[:-1]) and [r["n"] for r in rows] == [len(w) for w in want]
    assert token_output.encoded_corpus(documents(spark, []), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 700])
def test_range_coder_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, n).clip(0, 400).astype(np.uint32)
    coder = token_output.RangeCoder(token_output.scaled_frequencies(np.bincount(ids), 12), 12, lanes=8, every=4)
    assert (coder.decode(*coder.encode(ids), n) == ids).all()


def test_damage_is_found(spark):
    blocks = token_output.token_blocks(documents(spark, AWKWARD), public_tokenizers.path("byte_bpe_50k.json"))
    from sparquarry.llm.common import new_path, stored

    path = new_path(spark, "damaged")
    token_output.write_token_file(stored(blocks, "raw"), path)
    bad = spark.read.parquet(f"{path}/blocks").withColumn("stream_crc32", F.col("stream_crc32") + 1)
    bad.write.parquet(f"{path}/more")
    import shutil

    shutil.rmtree(f"{path}/blocks".removeprefix("file://"))
    shutil.move(f"{path}/more".removeprefix("file://"), f"{path}/blocks".removeprefix("file://"))
    with pytest.raises(Exception, match="damaged"):
        token_output.read_token_file(spark, path).count()


def test_piece_coder_forgets(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 40)
    coder = token_output.PieceCoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rng = random.Random(4)
    for _ in range(200):
        texts = [" ".join(f"w{int(rng.paretovariate(0.6)) % 500}" for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))]
        assert [list(x) for x in coder.encode(texts)] == [coder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_piece_coder_equals_tokenizer():
    coder = token_output.PieceCoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    rng, parts = random.Random(1), ["a", " ", "\n", "'s", "1", "!", "é", "\x1f", "日", "\t", "word", "<|endoftext|>", ".", "\u0301", "ª", "'", "_", '"', "ß"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert list(coder.encode([text])[0]) == coder.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_added_tokens_as_the_library_has_them(spark):
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert fresh.get_added_tokens_decoder()
    coder = token_output.PieceCoder(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read())
    added = [t.content for t in fresh.get_added_tokens_decoder().values()]
    texts = [x for t in added for x in (f"a {t} b", t, f"a{t}b\nc", f"{t} {t}", f"no{t[:-1]} {t[1:]}")] + ["a plain text\nof two lines"]
    assert [list(x) for x in coder.encode(texts)] == [fresh.encode(t, add_special_tokens=False).ids for t in texts]
    got = token_output.encoded_corpus(documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), public_tokenizers.path("byte_bpe_50k.json"))
    assert [r["n"] for r in got.orderBy("start").collect()] == [len(fresh.encode(t, add_special_tokens=False).ids) + 1 for t in texts]


def test_mixture_targets(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = mixture(docs, bins=3).toPandas().merge(docs.toPandas(), on="doc_id")
    assert len(got) == docs.count() and (got["size"] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in got["text"]]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    names = sorted(by.index)
    weight, left, rest, want = {s: i % 3 + 1 for i, s in enumerate(names)}, float(by["size"].sum()), set(names), {}
    while True:
        share = left / sum(weight[s] for s in rest)
        cut = [s for s in rest if share * weight[s] > 3 * by["size"][s] + 1e-6]
        if not cut:
            break
        want.update({s: 3.0 * by["size"][s] for s in cut})
        rest, left = rest - set(cut), by["size"].sum() - sum(want[s] for s in want) - sum(3.0 * by["size"][s] for s in cut if s not in want)
    want.update({s: share * weight[s] for s in rest})
    assert all(abs(by["target"][s] - want[s]) < 1e-6 and abs(by["taken"][s] - want[s]) <= 1 for s in names)
    assert (got["taken"] <= 3 * got["size"]).all()
    again = mixture(docs.repartition(7), bins=3).toPandas().set_index("doc_id")["taken"]
    assert (again.sort_index() == got.set_index("doc_id")["taken"].sort_index()).all()


def test_mixture_caps_and_awkward(spark):
    rows = [(1, "a " * 10, "en", "x"), (2, "b " * 1000, "en", "y"), (3, None, "en", "z"), (4, "c", "en", None)]
    got = {r["doc_id"]: r for r in mixture(documents(spark, rows)).collect()}
    assert got[1]["target"] == 30 and got[1]["taken"] == 30 and got[3]["target"] == 0 and got[3]["taken"] == 0 and got[4]["target"] == 3
    assert abs(got[2]["target"] - (1011 - 33)) < 1e-6 and got[2]["taken"] == 978
    assert mixture(documents(spark, AWKWARD)).count() == len(AWKWARD) and mixture(documents(spark, [])).count() == 0


def brute_mixture(rows, weights, most, value):
    """rows: (id, text, source). Keys as the operator makes them, everything else row by row."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    own, key = defaultdict(list), {}
    for i, t, s in rows:
        own[s].append(i)
        u = (int(hashlib.md5(f"17|{i}|{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / (1 << 52)
        key[i] = -math.log(u) / value[i]
    names = sorted((s for s in own if s is not None)) + ([None] if None in own else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total = {s: sum(size[i] for i in own[s]) for s in names}
    target, left = {}, set(names)
    while left:
        share = (sum(total.values()) - sum(target.values())) / sum(weight[s] for s in left)
        over = [s for s in left if share * weight[s] > most * total[s]]
        if not over:
            target |= {s: share * weight[s] for s in left}
            break
        target |= {s: most * total[s] for s in over}
        left -= set(over)
    taken = {}
    for s in names:
        epochs = int(target[s] // total[s]) if total[s] else 0
        rest = math.floor(target[s] - epochs * total[s] + 1e-6)
        for i in sorted(own[s], key=key.get):
            more = min(size[i], rest)
            rest -= more
            taken[i] = epochs * size[i] + more
    return taken


@pytest.mark.parametrize("low", [1.0, 0.02])
def test_mixture_picks(spark, low):
    rng = random.Random(12)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(40))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    value = {i: (low if i % 2 else 1.0) for i, _, _ in rows}
    docs = documents(spark, [(i, t, "en", s) for i, t, s in rows])
    got = {r["doc_id"]: r["taken"] for r in mixture(docs, bins=5, weight=F.when(F.col("doc_id") % 2 == 1, low).otherwise(F.lit(1.0))).collect()}
    assert got == brute_mixture(rows, (1, 2, 3), 3.0, value)
    if low < 1:
        # Of the source that isn't taken whole, heavy documents come first.
        part = [i for i, t, s in rows if s == "a" and t]
        assert sum(got[i] > 0 for i in part if i % 2 == 0) > 2 * sum(got[i] > 0 for i in part if i % 2)


def test_mixture_of_repeated_rows(spark):
    rows = [(1, "a b c d", "en", "x")] * 40 + [(2, "e f g", "en", "y")] * 3
    got = mixture(documents(spark, rows).repartition(5), weights=(1, 9), bins=2).collect()
    x = sorted(r["taken"] for r in got if r["doc_id"] == 1)
    assert sum(x) == 169 - 27 and set(x) <= {0, 2, 4} and all(r["taken"] == 9 for r in got if r["doc_id"] == 2)


def test_url_verdicts_of_random_graphs(spark):
    rng = random.Random(13)
    n = 300
    url = lambda i: f"http://h{i % 60}.{('com', 'org', 'net')[i % 3]}/p{i}"
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(120)] + [(0, i) for i in range(200, 240)] + [(i, i + 1) for i in range(250, 280)]
    hosts = {i: url(i).split("/")[2] for i in range(n)}
    action = {i: rng.choices([None, "block", "allow"], (80, 15, 5))[0] for i in range(n)}
    rules = spark.createDataFrame([(hosts[i], f"/p{i}", a) for i, a in action.items() if a], "host string, path string, action string")
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        up[max(top(a), top(b))] = min(top(a), top(b))
    of = defaultdict(set)
    fits = lambda i: max(((len(f"/p{j}"), a) for j, a in action.items() if a and hosts[j] == hosts[i] and f"/p{i}".startswith(f"/p{j}")), default=(0, None))[1]
    own = {i: fits(i) for i in range(n)}
    for i in range(n):
        of[top(i)].add(own[i])
    want = {i: own[i] or ("block" if "block" in of[top(i)] and "allow" not in of[top(i)] else "allow") for i in range(n)}
    pages = spark.createDataFrame([(i, url(i), None) for i in list(range(n)) + [5, 5]], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(url(a), url(b)) for a, b in edges], "from_url string, to_url string")
    got = url_verdicts(pages, rules, redirects).collect()
    assert len(got) == n + 2 and {r["page_id"]: r["verdict"] for r in got} == want


def test_relative_links(spark):
    from sparquarry.llm.url_filters import page_links

    cases = {"q": "/a/b/q", "../q": "/a/q", "./q?x=1": "/a/b/q", "../../../q": "/q", "?id=3": "/a/b/c", "/x/./y/../z": "/x/z", "..": "/a/", "mailto:me@x": None, "https://o.org/z#t": "/z"}
    html = "".join(f"<link rel=canonical href='{t}'>" for t in cases)
    got = [r["b_path"] for r in page_links(spark.createDataFrame([("http://h.org/a/b/c?k", html)], "url string, html string")).collect()]
    assert got == [v for v in cases.values() if v]


def test_url_verdicts(spark):
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow")], "host string, path string, action string")
    link = '<html><LINK href="{}" rel=canonical></html>'
    pages = [
        (1, "http://A.Example.com/en/1?x", None), (2, "http://a.example.com/en/7", None), (3, None, None), (4, "no scheme", None), (5, "http://x.org/p", link.format("http://b.com/en/9")),
        (6, "http://y.org/p", '<meta http-equiv="refresh" content="0; url=/q">'), (7, "http://y.org/q", link.format("//x.org/p")), (8, "http://z.org/a", link.format("http://example.com/en/77")), (9, "http://z.org/b", link.format("http://z.org/a")), (9, "http://notcom/en/", None),
        (10, "http://z.org/b", link.format("http://b.com/en/9")),
    ]
    got = url_verdicts(spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, rule string, node string"), rules).collect()
    by = {(r["page_id"], r["host"]): (r["rule"], r["verdict"]) for r in got}
    assert by[1, "a.example.com"] == ("com/en/", "block") and by[2, "a.example.com"] == ("example.com/en/7", "allow") and by[3, ""] == (None, "allow") and by[4, ""] == (None, "allow")
    # One page ties the blocked group to an allowed address: the explicit allow wins for all unnamed aliases.
    assert by[8, "z.org"] == (None, "allow") and by[5, "x.org"] == (None, "allow") and by[9, "notcom"] == (None, "allow")
    got = url_verdicts(spark.createDataFrame(pages[:7], "page_id long, url string, html string"), rules).collect()
    assert {r["page_id"]: r["verdict"] for r in got if r["page_id"] >= 5} == {5: "block", 6: "block", 7: "block"}
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string, html string"), rules).count() == 0


def test_url_filters_query_by_its_contract(spark, tmp_path):
    from sparquarry.llm.queries import op2_url_filters

    link = "<link rel=canonical href='{}'>"
    cases = [
        ("http://a.example.com/en/6", None, "com/en/", "block"), ("http://other.com/en/7", None, "com/en/", "block"), ("http://example.com/en/70?q", None, "example.com/en/7", "allow"),
        ("http://A.Net/de/1#x", None, "net/de/", "allow"), ("http://example.net/de/7", None, "net/de/", "allow"), ("http://m.example.net/de/81", None, "example.net/de/8", "block"),
        ("http://b.org/es/", None, "org/es/", "block"), ("http://b.org/es", None, None, "allow"), ("http://anet/de/1", None, None, "allow"), (None, None, None, "allow"), ("//a.net/de/1", None, None, "allow"),
        # What no rule names goes by what it is tied to: an allow by net/de/ never blocks it, and lifts the block of another alias.
        ("http://c.info/1", link.format("http://a.net/de/2"), None, "allow"), ("http://c.info/2", link.format("http://example.net/de/8"), None, "block"),
        ("http://c.info/3", link.format("http://a.net/de/3") + link.format("http://b.org/es/3"), None, "allow"),
    ]
    spark.createDataFrame([(i, u, h) for i, (u, h, _, _) in enumerate(cases)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in op2_url_filters(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, (_, _, rule, verdict) in enumerate(cases)}


def test_decontamination(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(5000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate((30, 16, 8, 4, 60))] + [(9, None), (10, "")]
    clean = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(20)]
    edited = items[0][1].split()
    edited[5], edited[17] = "zz", "yy"
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)]
    rows += [(100, clean[0] + " " + items[0][1].upper() + "!", "en", "a"), (101, clean[1] + " " + " ".join(edited) + " end", "en", "a"), (102, items[2][1], "en", "a"), (103, " ".join(items[4][1].split()[20:40]), "en", "a"), (104, " ".join(items[4][1].split()[20:29]), "en", "a"), (105, items[3][1], "en", "a"), (106, "x " + items[3][1], "en", "a")]
    got = {r["doc_id"]: r for r in contamination(documents(spark, rows + AWKWARD), spark.createDataFrame(items, "item_id long, text string")).collect() if (r["doc_id"] or 0) >= 100}
    assert {i: (got[i]["contaminated"], got[i]["items"]) for i in got} == {100: (True, [0]), 101: (True, [0]), 102: (True, [2]), 103: (True, [4]), 104: (False, None), 105: (True, [3]), 106: (False, None)}
    every = contamination(documents(spark, rows + AWKWARD), spark.createDataFrame(items, "item_id long, text string"))
    assert every.count() == len(rows + AWKWARD) and every.where("contaminated and doc_id < 100").count() == 0
    nothing = contamination(documents(spark, AWKWARD), spark.createDataFrame([], "item_id long, text string"))
    assert nothing.where("kept").count() == len(AWKWARD) and contamination(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert "Python" not in every._jdf.queryExecution().executedPlan().toString()


def test_masks_fit_every_accepted_pattern():
    for n in range(5, 17):
        masks = [own for low, own in decontamination.MASKS if low <= n][-1]
        for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
            assert any(all(i + j not in gone for j, c in enumerate(m) if c == "1") for m in masks for i in range(n - len(m) + 1)), (n, gone)


def test_decontamination_of_replaced_words(spark):
    rng, names = random.Random(9), [f"t{i}" for i in range(5000)]
    items = [(n, [rng.choice(names) for _ in range(n)]) for n in (5, 7, 9, 10, 12, 15, 16, 17, 20, 30)]
    rows, want = [], {}
    for n, t in items:
        span, first = min(n, 16), rng.randrange(max(1, n - 15))
        for more in (0, 1):
            for _ in range(15):
                gone = {first + i for i in rng.sample(range(span), span - math.ceil(0.8 * span) + more)}
                # Outside the window nothing is left of the item.
                edited = [w if first <= i < first + span and i not in gone else f"x{i}" for i, w in enumerate(t)]
                want[len(rows)] = not more
                rows.append((len(rows), " ".join([*rng.choices(names, k=20), *edited, *rng.choices(names, k=20)]), "en", "a"))
    rows.append((len(rows), " ".join(w if i % 5 else "zz" for i, w in enumerate(items[-1][1])), "en", "a"))
    want[len(rows) - 1] = True
    got = contamination(documents(spark, rows), spark.createDataFrame([(n, " ".join(t)) for n, t in items], "item_id long, text string"))
    assert {r["doc_id"]: r["contaminated"] for r in got.collect()} == want


def test_sentence_spans(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho. Sigma tau upsilon phi chi psi omega one two three."
    rows = [(2, f"Own start of two. {passage} Own end of two here.", "en", "a"), (1, f"First. {passage}", "en", "a"), (3, "Nothing here repeats. It is short.", "en", "a"), (4, "Nothing here repeats. It is short.", "en", "a"), (5, f"{passage} Middle part. {passage}", "en", "a")]
    got = {r["doc_id"]: r for r in drop_repeated_spans(documents(spark, rows)).collect()}
    assert got[1]["n_removed"] == 0 and got[1]["text"] == rows[1][1]
    assert got[2]["text"] == "Own start of two. Own end of two here." and got[2]["first_docs"] == [1] and got[2]["n_removed"] == 3
    assert got[3]["n_removed"] == 0 and got[4]["n_removed"] == 2 and got[4]["text"] == "" and not got[4]["kept"] and got[5]["text"] == "Middle part. " and got[5]["kept"]
    floor = {r["doc_id"]: r for r in drop_repeated_spans(documents(spark, rows), least_words=20).collect()}
    assert floor[4]["n_removed"] == 0 and floor[2]["n_removed"] == 3
    same = {r["doc_id"]: r for r in drop_repeated_spans(documents(spark, AWKWARD)).where("doc_id is not null").collect()}
    assert same[1]["text"] is None and same[1]["kept"] and same[5]["text"] == LONG and drop_repeated_spans(documents(spark, AWKWARD)).count() == len(AWKWARD)
    assert drop_repeated_spans(documents(spark, [])).count() == 0


def test_sentence_spans_against_brute_force(spark):
    rng, names = random.Random(8), [f"w{i}" for i in range(4000)]
    sentence = lambda n: " ".join(rng.choice(names) for _ in range(n)) + "."
    passages = [[sentence(rng.randint(3, 9)) for _ in range(rng.randint(4, 9))] for _ in range(15)]
    texts = []
    for _ in range(60):
        out = [sentence(rng.randint(3, 12)) for _ in range(3)]
        for p in rng.sample(passages, 2):
            a = rng.randrange(len(p) - 2)
            out += p[a : rng.randint(a + 2, len(p))] + [sentence(rng.randint(3, 12)) for _ in range(2)]
        texts.append(out)
    got = {r["doc_id"]: r for r in drop_repeated_spans(documents(spark, [(i, " ".join(t), "en", "a") for i, t in enumerate(texts)])).collect()}
    places, shared = defaultdict(set), 0
    for i, t in enumerate(texts):
        gone = {j for a in range(len(t) - 1) if places[tuple(t[a : a + 2])] for j in (a, a + 1)}
        left = got[i]["text"]
        assert left.split() == " ".join(x for j, x in enumerate(t) if j not in gone).split(), i
        assert (got[i]["first_docs"] or []) == sorted({min(places[tuple(t[a : a + 2])]) for a in range(len(t) - 1) if places[tuple(t[a : a + 2])]})
        shared += len(gone)
        for a in range(len(t) - 1):
            places[tuple(t[a : a + 2])].add(i)
    assert shared > 100


def test_sentence_spans_of_rows_under_one_id(spark):
    passage = "Alpha beta gamma delta epsilon zeta eta theta. Iota kappa lambda mu nu xi omicron pi rho. Sigma tau upsilon phi chi psi omega one two three."
    rows = [(1, passage, "en", "a"), (2, passage, "en", "a"), (2, "Own first. Own second. Own third.", "en", "a"), (2, passage, "en", "a")]
    got = sorted(r["text"] for r in drop_repeated_spans(documents(spark, rows)).collect())
    assert got == ["", "", passage, "Own first. Own second. Own third."]
    # Two texts under one id and two without an id are rows like all others; a row with an id comes first.
    short = "Pay by card only here today please. Call us before noon on any weekday."
    rows = [(7, f"{short} One.", "en", "a"), (7, f"{short} Two.", "en", "a"), (None, f"Three. {short}", "en", "a"), (None, f"Four. {short}", "en", "a"), (9, short, "en", "a"), (None, passage, "en", "a"), (None, passage, "en", "a"), (None, passage, "en", "b")]
    got = drop_repeated_spans(documents(spark, rows)).collect()
    texts = [r["text"] for r in got]
    assert len(got) == len(rows) and sum(short in t for t in texts) == 1 and sum(t == passage for t in texts) == 1 and texts.count("") == 3
    assert sorted(t for r in got for t in [r["text"].strip()] if r["doc_id"] is None and t != passage) == ["", "", "Four.", "Three."]
    assert all(r["first_docs"] == [7] for r in got if r["doc_id"] == 9 or (r["n_removed"] and r["doc_id"] == 7)) and all(r["first_docs"] in (None, [7], []) for r in got if r["doc_id"] is None)


def test_sentence_spans_of_three_sentences_and_a_third_of_all_rows_equal(spark):
    rows = [(i, f"A {i}. B {i}. C one. D two. E three. F four.", "en", "a") for i in range(40)] + [(None, "Same row. Of all. And more. Always.", "en", "a")] * 60
    got = drop_repeated_spans(documents(spark, rows), least=3).collect()
    assert sum(r["n_removed"] for r in got if r["doc_id"] is not None) == 39 * 4 and sum(r["n_removed"] == 0 for r in got if r["doc_id"] is None) == 1
    assert all(r["text"] == f"A {r['doc_id']}. B {r['doc_id']}. " and r["first_docs"] == [0] for r in got if r["doc_id"])


def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at, covered, seen, dup = defaultdict(list), set(), set(), 0
    for i in range(len(w) - 2):
        at[tuple(w[i : i + 3])].append(i)
    for v in at.values():
        if len(v) > 1:
            covered.update(j for i in v for j in (i, i + 1, i + 2))
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_rules(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in docs] + [(5000, "a b a b a b a", "en", "a"), (5001, "x y z x y z", None, None)]
    got = quality_rules.quality_rules(documents(spark, rows + AWKWARD))
    found = got.collect()
    assert len(found) == len(rows + AWKWARD)
    texts = {r[0]: r[1] for r in rows if r[0] not in {a[0] for a in AWKWARD}}
    for r in found:
        if r["doc_id"] in texts:
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base_counts(texts[r["doc_id"]])
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
            assert r["kept"] <= (not r["base_failed"])
    assert quality_rules.quality_rules(documents(spark, [])).count() == 0
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_robust_outlier_is_rejected(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "tere") for b in ("ra", "s", "t", "von", "p")]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(80, 400))), "en", "a") for i in range(200)]
    rows += [(900, " ".join(f"word{i}$$$###" for i in range(150)), "en", "a")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert not got[900] and sum(got.values()) == 200
    assert abs(quality_rules.chi2_quantile(0.975, 5) - 12.8325) < 1e-3


@pytest.mark.parametrize("share, copies", [(0.3, False), (0.4, False), (0.4, True)])
def test_much_junk_is_rejected(spark, share, copies):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "tere") for b in ("ra", "s", "t", "von", "p")]
    rows = [(i, " ".join(rng.choice(words) + str(rng.randrange(99)) for _ in range(rng.randrange(80, 400))), "en", "a") for i in range(300)]
    line = " ".join(f"word{i}$" for i in range(10))
    junk = round(300 * share / (1 - share))
    rows += [(1000 + i, "\n".join([" ".join(f"{x if copies else i}word{x}$" for x in range(150)), *[f"line{j} {line[:7]}" for j in range(30) for _ in (0, 1)]]), "en", "a") for i in range(junk)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(documents(spark, rows)).collect()}
    assert not any(got[i]["base_failed"] for i in got)
    assert not any(got[i]["kept"] for i in got if i >= 1000) and sum(r["kept"] for r in got.values()) >= 297


@pytest.mark.parametrize("op, label", [(toxicity.toxicity, "toxic"), (quality.quality, "quality")])
def test_classifiers(spark, op, label):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = op(docs, labels).drop("toxic").toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got["held_out"]]
    assert (held["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in held["doc_id"]]).all()
    assert ((held["predicted"] == held[label]).mean()) > 0.9 and got["score"].between(0, 1).all()
    odd = op(documents(spark, AWKWARD), labels).collect()
    assert len(odd) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in odd)
    assert op(documents(spark, []), labels.limit(0)).count() == 0


def test_long_text_scores_as_a_whole():
    model = toxicity.train_conv([toxicity.word_buckets(t, 256) for t in ("good fine", "vile thing")] * 20, np.array([0.0, 1.0] * 20), np.ones(40), 256)
    long = toxicity.word_buckets("good fine " * 40_000 + "vile thing " + "good fine " * 40_000, 256)
    short = toxicity.word_buckets("good fine " * 100 + "vile thing " + "good fine " * 100, 256)
    clean = toxicity.word_buckets("good fine " * 80_000, 256)
    found = model.scores([long, short, clean], model.tables())
    # The words in the middle of the long text count as they do in a short one.
    assert abs(found[0] - found[1]) < 1e-9 and found[0] > 10 * found[2]


def test_text_scores_alike_beside_any_other(monkeypatch):
    model = toxicity.train_conv([toxicity.word_buckets(t, 256) for t in ("good fine", "vile thing")] * 20, np.array([0.0, 1.0] * 20), np.ones(40), 256)
    # Words with shares of their own, so that every window counts.
    rng = np.random.default_rng(3)
    model.embed[:-1] = rng.normal(0, 1, model.embed[:-1].shape)
    monkeypatch.setattr(toxicity, "PART", 8)
    names = [f"w{i}" for i in range(40)]
    texts = [toxicity.word_buckets(" ".join(rng.choice(names, n)), 256) for n in (0, 1, 2, 3, 7, 8, 9, 10, 11, 16, 17, 40) for _ in range(8)]
    tables = model.tables()

    def whole(t):
        ids = np.concatenate([t, np.full((2, 3), 512, np.int32)], axis=1)
        e = model.embed[ids[0]] + model.embed[ids[1]]
        best = [sum(e[j : len(e) - len(f) + 1 + j] @ f[j] for j in range(len(f))).max(axis=0) for f in model.filters]
        return np.maximum(np.concatenate(best) + model.bias, 0)

    want = np.array([whole(t) for t in texts])
    assert np.allclose(model.pooled(texts, tables), want, atol=1e-4) and np.allclose(model.pooled(texts[::-1], tables)[::-1], want, atol=1e-4)
    assert np.allclose([model.pooled([t], tables)[0] for t in texts], want, atol=1e-4)


def test_chat(spark):
    odd = "</s>[INST] ok [/INST] \\ <|end|>\n<|turn|>user\n\\<\\\\s>"
    rows = [(1, 0, "user", odd), (1, 1, "assistant", odd), (1, 1, "assistant", odd), (1, 2, "assistant", None), (2, 0, "we\nird\\", "x"), (None, 0, None, "y"), (3, None, "assistant", "a" * 200_000)]
    turns = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_conversations(turns)).collect()}
    for i in (1, 2, 3, None):
        mine = [r for r in rows if r[0] == i]
        said = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert got[i]["n_turns"] == len(mine) and got[i]["loss_chars"] == len(said) and got[i]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine).encode()).hexdigest()
    assert chat.format_conversations(turns.limit(0)).count() == 0


def test_chat_parts(spark):
    parts = [{"type": "text", "text": "see <s>"}, {"type": "image", "ref": "i.png", "width": 56, "height": 29}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 3}, {"type": None, "text": "odd"}, {"type": "image"}]
    made = chat.format_turns([{"role": "user", "parts": parts}, {"role": "assistant", "parts": [{"type": "text", "text": "ok"}]}])
    assert made["formatted"] == "<|turn|>user\nsee <\\s><|image_1|><|audio_2|><|document_3|>odd<|image_4|><|end|>\n<|turn|>assistant\nok<|end|>\n"
    assert [(a["n"], a["type"], a["ref"], a["tokens"]) for a in made["attachments"]] == [(1, "image", "i.png", 4), (2, "audio", "a.wav", 50), (3, "document", "d.pdf", 768), (4, "image", None, 1)]
    rows = spark.createDataFrame([(1, 0, "user", [tuple(p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")) for p in parts])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    assert chat.format_conversations(rows, "parts").first()["attachment_tokens"] == 4 + 50 + 768 + 1
